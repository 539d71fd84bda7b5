"""Goldens of the trust graph: exact expectations, contexts, decay, ownership, views, streaming."""

from __future__ import annotations

import sys

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings as hyp, strategies as st
from pyspark.sql import functions as F

from vouchgraph.functions import kernel, rng
from vouchgraph.operators import contexts, decay, neighbors, paths, polls, registry, scores, walks
from vouchgraph.plans.engine import TrustEngine
from vouchgraph.plans.service import TrustService
from vouchgraph.settings import Settings
from vouchgraph.sources import oplog

F1 = [("U1", "U2", 2), ("U1", "U3", 1), ("U2", "U3", 3)]
SMALL = Settings(num_walks=10_000, zero_opinion_factor=0.0, reverse="none")


def ops(spark, edges, context="", magnitude=0):
    rows = [(i, e[3] if len(e) > 3 else context, e[0], e[1], float(e[2]), e[4] if len(e) > 4 else magnitude) for i, e in enumerate(edges)]
    return oplog.log(spark.createDataFrame(rows, "op_idx long, context string, src string, dst string, amount double, magnitude long"))


def engine(spark, edges, settings=SMALL):
    return TrustEngine(ops(spark, edges), settings)


def values(df, key="dst", value="score_value_of_dst"):
    return {r[key]: r[value] for r in df.collect()}


@pytest.mark.parametrize("edges, ego, want", [
    ([(0, 1, 2), (0, 2, 1), (1, 2, 3)], 0, [0.428878, 0.243031, 0.328091]),
    ([(0, 1, 2), (0, 2, 1), (2, 1, 3)], 0, [0.478278, 0.386210, 0.135512]),
    ([(0, 1, 2), (0, 2, 1), (2, 1, 3), (1, 0, 4)], 1, [0.367229, 0.432034, 0.200736]),
    ([(0, 1, 3), (0, 2, 1), (1, 0, 2), (1, 2, 4), (2, 0, 3), (2, 1, 2)], 2, [0.300774, 0.298746, 0.400480]),
    ([(0, 1, 1), (0, 2, -1)], 0, [0.540541, 0.229730, -0.229730]),
    ([(0, 1, -1), (0, 2, 1), (1, 2, 1), (2, 1, 1), (2, 0, 1)], 0, [0.216090, -0.120944, -0.025572]),
    ([(0, 1, -1), (0, 2, 10), (2, 1, 1)], 0, [0.398912, 0.231188, 0.308250]),
])
def test_walks_near_expectation(edges, ego, want):
    s, d, w = (np.array(x) for x in zip(*edges))
    n, nodes = 40_000, int(max(s.max(), d.max())) + 1
    assert kernel.exact(s, d, w.astype(float), ego, nodes, 0.85) == pytest.approx(want, abs=2e-6)
    adj = kernel.Adjacency(s, d, np.abs(w) * 10**6, w < 0)
    _, node, pos, neg = kernel.hits(adj, np.full(n, ego), np.arange(n), 1, 0.85)
    got = np.zeros(nodes)
    got[node] = (pos - neg) / (pos + neg).sum()
    assert got == pytest.approx(want, abs=4 / np.sqrt(n))
    assert pos[node == ego][0] == n


@given(st.lists(st.tuples(st.integers(0, 8), st.integers(0, 8), st.sampled_from([-3, -1, 1, 2, 5])).filter(lambda e: e[0] != e[1]), min_size=1, max_size=25, unique_by=lambda e: e[:2]))
@hyp(max_examples=40, deadline=None)
def test_walk_invariants(edges):
    s, d, w = (np.array(x) for x in zip(*edges))
    adj = kernel.Adjacency(s, d, np.abs(w) * 10**6, w < 0)
    index, node, phase = kernel.walk(adj, np.zeros(200, np.int64), np.arange(200), 3, 0.85)
    pairs = {(a, b): c for a, b, c in edges}
    for i in range(200):
        own = index == i
        path, ph = node[own].tolist(), phase[own].tolist()
        assert path[0] == 0 and ph[0] == 0 and ph == sorted(ph)
        for a, b, p, q in zip(path, path[1:], ph, ph[1:]):
            assert (a, b) in pairs and (pairs[a, b] > 0 or (p, q) == (0, 1))


def test_random_numbers_agree(spark):
    h, v = np.arange(1, 500, dtype=np.int64) * 4_099_999 % rng.P, np.arange(1, 500, dtype=np.int64) * 77
    got = spark.createDataFrame(pd.DataFrame({"h": h, "v": v})).select(rng.mix_col(F.col("h"), F.col("v")).alias("m")).toPandas().m.to_numpy()
    assert (got == rng.mix(h, v)).all()
    import duckdb

    con = duckdb.connect()
    con.register("t", pd.DataFrame({"h": h, "v": v}))
    assert [r[0] for r in con.sql(f"SELECT {rng.mix_sql('h', 'v')} FROM t").fetchall()] == got.tolist()
    u = rng.mix(np.arange(200_000, dtype=np.int64), np.int64(5)) / rng.P
    assert abs(u.mean() - 0.5) < 0.003 and np.histogram(u, 20, (0, 1))[0].std() < 300


def test_joined_walks_equal_kernel(spark):
    g = engine(spark, [("U1", "U2", 2), ("U1", "U3", -1), ("U2", "U3", 3), ("U3", "U1", 1), ("B1", "U2", 1), ("U2", "B1", 4)], Settings(num_walks=300)).graph_of()
    egos = g.all_users()
    key = lambda df: sorted(map(tuple, df.select("ego", "node", "pos_hits", "neg_hits").collect()))
    assert key(walks.hits(g.links, egos, Settings(num_walks=300))) == key(walks.joined_hits(g.links, egos, Settings(num_walks=300)))


def _far(spark):
    """Sources that no edge leads to, targets without edges, an own edge back, a hub of 300 edges."""
    edges = [("U1", "U2", 2), ("U1", "U3", -1), ("U2", "U3", 3), ("U3", "U1", 1), ("U7", "U1", 4), ("U7", "U8", -2), ("U7", "U9", 1), ("B1", "U2", 1)]
    return engine(spark, [*edges, *(("U2", f"B{i}", 1 + i % 5 if i % 3 else -2) for i in range(2, 300)), *((f"U{i}", "U1", i) for i in range(10, 90))], Settings(num_walks=300)).graph_of()


def test_only_nodes_that_edges_lead_to_are_broadcast(spark, monkeypatch):
    g = _far(spark)
    key = lambda df: sorted(map(tuple, df.select("ego", "node", "pos_hits", "neg_hits").collect()))
    own = walks.Network(g.links, g.settings)
    got = key(own.hits(g.all_users()))
    names = {r["node_id"]: r["name"] for r in g.nodes.collect()}
    assert not {"U7", "U10", "B1"} & {names[i] for i in own._core[0].value.ids} and len(own._core[0].value.to) < 700
    assert got == key(own.joined_hits(g.all_users())) and {names[e] for e, *_ in got} >= {"U7", "U8", "U9", "U89"}
    for name, value in ((walks, "_DRIVER_EDGES"), (kernel, "_MARKS"), (kernel, "_GUIDED")):
        monkeypatch.setattr(name, value, 0)
    assert got == key(walks.hits(g.links, g.all_users(), g.settings))
    many = Settings(num_walks=walks._BLOCK + 500)
    two = g.all_users().where("ego < 2")
    assert key(walks.hits(g.links, two, many)) == key(walks.joined_hits(g.links, two, many))


def test_few_walks_let_edges_lie(spark, monkeypatch):
    g = _far(spark)
    plans, stage = {}, walks.stage
    monkeypatch.setattr(walks, "stage", lambda df, label: plans.setdefault(label, []).append(df._jdf.queryExecution().toString()) or stage(df, label))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        walks.joined_hits(g.links, g.all_users().where("ego < 3"), g.settings).collect()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    steps = plans["walk"][1:]  # the first is the start
    assert len(steps) > 5 and not any("SortMergeJoin" in p or "hashpartitioning" in p for p in steps)


def test_routing_to_one_context(spark):
    edges = [("U1", "U2", 2, "X"), ("U1", "B1", 3, "Y"), ("B1", "U2", 1, "X"), ("U2", "U3", 0, "Y"), ("U3", "V1", 1, "X"), ("B1", "O1", 1, "X"), ("U4", "U4", 1, "Z"), ("X1", "U1", 1, "X"), ("U2", "U1", 5, "Y"), ("C1", "U1", 1, ""), ("P1", "U1", 1, "X"), (None, "U1", 1, "X"), ("U1", None, 1, "X"), ("V1", "P1", 1, "Y")]
    log = ops(spark, edges).withColumn("kind", F.when(F.col("op_idx") == 3, "delete_edge").otherwise(F.col("kind")))
    key = lambda df: sorted(map(tuple, df.select("op_idx", "context", "src", "dst", "amount", "magnitude").collect()))
    every = contexts.route(log)
    for context in ("", "X", "Y", "Z", "none"):
        assert key(contexts.route_to(log, context)) == key(every.where(F.col("context") == context))
    load = log.where("op_idx < 3")
    assert key(contexts.route_to(log.where("op_idx > 3"), "X", load)) == key(contexts.route(log.where("op_idx > 3"), load).where("context = 'X'"))


def test_registry_needs_no_sort(spark):
    routed = contexts.route_to(ops(spark, [("U1", "U2", 2), ("B1", "U3", 1), ("O1", "U3", 1), ("U4", "B1", 1), ("B1", "U1", 1), ("U9", "O2", 1)]), "")
    found = registry.first_seen(routed)
    assert {(r["name"], r["at"], r["owner"]) for r in found.collect()} == {("U1", 0, None), ("U2", 1, None), ("U3", 2, None), ("B1", 3, "U3"), ("O1", 5, "U3"), ("U4", 6, None), ("U9", 10, None), ("O2", 11, None)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "HashAggregate" in plan and "min_by" not in plan


def test_calm_decay_reads_and_shuffles_once(spark):
    routed = contexts.route_to(ops(spark, [("U1", "U2", 2), ("U1", "U3", 1), ("U2", "U3", 3), ("U1", "U2", 5)]), "")
    found = decay.decayed(routed)
    assert {(r["src"], r["dst"]): r["weight"] for r in found.collect()} == {("U1", "U2"): 5.0, ("U1", "U3"): 1.0, ("U2", "U3"): 3.0}
    plan = found._jdf.queryExecution().sparkPlan().toString() + found._jdf.queryExecution().executedPlan().toString()
    assert "InPandas" not in plan and "Union" not in plan


def test_bulk_compares_names_cheaply(spark):
    edges = [("U1", "U2", 2, "X"), ("U1", "B1", 3, "Y"), ("V1", "U2", 1, "X"), ("B1", "O1", 1, "X"), ("U4", "U4", 1, "Z"), ("X1", "U1", 1, "X"), (None, "U1", 1, "X"), ("U1", None, 1, "X")]
    found = contexts.bulk(ops(spark, edges))
    want = {(c, "U1", "U2") for c in ("", "X", "Y", "Z")} | {(c, "U1", "B1") for c in ("", "Y")} | {(c, "V1", "U2") for c in ("", "X")}
    assert {(r["context"], r["src"], r["dst"]) for r in found.collect()} == want
    assert "CASE WHEN substring" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_edges_are_made_once_for_two_paths(spark, monkeypatch):
    from vouchgraph.plans import reads

    made = []
    monkeypatch.setattr(reads, "_user_edges", lambda s, sf: contexts.last_write(contexts.route_to(ops(s, [("U1", "U3", 1), ("U3", "U99", 1)]), "")))
    monkeypatch.setattr(reads.paths, "cheapest_path", lambda edges, start, goal: made.append(edges._jdf.queryExecution().executedPlan().toString()) or paths.cheapest(paths.costs(edges), start, goal))
    assert [r["node"] for r in reads.shortest_path(spark, "").collect()] == ["U1", "U3", "U1", "U3", "U99"]
    assert len(made) == 2 and not any("Aggregate" in p for p in made)


def test_scores_and_node_score(spark):
    e = engine(spark, F1)
    assert values(e.scores("U1")) == pytest.approx({"U1": 0.428878, "U2": 0.243031, "U3": 0.328091}, abs=0.04)
    assert [r["dst"] for r in e.scores("U1").collect()] == ["U1", "U3", "U2"]
    assert e.scores("U9").count() == e.scores("B1").count() == 0
    assert set(values(e.scores("U1", gte=0.3))) == {"U1", "U3"} and set(values(e.scores("U1", index=1, count=1))) == {"U3"}
    assert e.node_score("U1", "U2").first()["score_value_of_dst"] == values(e.scores("U1"))["U2"]
    assert e.scores("U1", index=50).count() == 0


def test_clusters(spark):
    e = engine(spark, [("U1", "B1", 3), ("B1", "U1", 1), ("U1", "C1", 4), ("C1", "U1", 1)])
    assert set(values(e.scores("U1"), value="score_cluster_of_dst").values()) == {100}
    two = values(engine(spark, [("U1", "U2", 1)]).scores("U1"), value="score_cluster_of_dst")
    assert two == {"U1": 100, "U2": 1}


def test_quantile_bounds(spark):
    s = spark.createDataFrame([(0, i, float(v)) for i, v in enumerate([10, 20, 30, 40, 50])], "ego long, node long, score double")
    n = spark.createDataFrame([(i, "U") for i in range(5)], "node_id long, kind string")
    assert scores.quantile_bounds(s, n, 4).first()["bounds"] == [15.0, 25.0, 35.0]


def test_omit_negative_and_compat(spark):
    edges = [("U1", "U2", -1), ("U1", "U3", 10), ("U3", "U2", 1)]
    assert "U2" in values(engine(spark, edges).scores("U1"))
    assert "U2" not in values(engine(spark, edges, Settings(num_walks=2000, omit_neg_edges_scores=True)).scores("U1"))
    row = spark.createDataFrame([(1.0,)], "s double")
    assert row.where(scores.in_bounds(F.col("s"), gt=1.0)).count() == 0
    assert row.where(scores.in_bounds(F.col("s"), gt=1.0, compat=True)).count() == 1


def test_mutual(spark):
    e = engine(spark, [("U1", "U2", 3), ("U1", "U3", 1), ("U2", "U1", 2), ("U2", "U3", 4), ("U3", "U1", 3), ("U3", "U2", 2)])
    got = {r["dst"]: (r["score_value_of_dst"], r["score_value_of_src"]) for r in e.mutual_scores("U1").collect()}
    assert got["U2"] == pytest.approx((0.318886, 0.286549), abs=0.04) and got["U3"] == pytest.approx((0.280513, 0.300774), abs=0.04)


def test_neighbors(spark):
    e = engine(spark, [("U1", "U2", 1), ("U2", "U3", 2), ("U3", "U1", 3)], Settings(num_walks=100, reverse="none"))
    names = lambda d: set(values(e.neighbors("U1", "U2", d)))
    assert names(0) == {"U1", "U3"} and names(2) == {"U1"} and names(1) == {"U3"}
    o = engine(spark, [("O2", "U2", 1), ("O3", "U3", 1), ("U3", "O2", 1), ("O2", "U3", 2), ("U2", "O3", 1)], Settings(num_walks=100, reverse="none"))
    assert set(values(o.neighbors("U3", "U3", 2, kind="O"))) == {"O2"}
    with pytest.raises(ValueError):
        e.neighbors("U1", "U2", 3)


def test_contexts(spark):
    w = lambda edges, c: {(r["src"], r["dst"]): r["weight"] for r in TrustEngine(edges, with_decay=False).graph_of(c).edges.collect()}
    two = ops(spark, [("B1", "U2", 1, "X"), ("B1", "U2", 2, "Y")])
    assert w(two, "") == {("B1", "U2"): 2.0} and w(two, "X") == {("B1", "U2"): 1.0}
    gone = ops(spark, [("B1", "U2", 1, "X"), ("B1", "U2", 2, "Y"), ("B1", "U2", 0, "X")])
    assert w(gone, "") == {} and w(gone, "Y") == {("B1", "U2"): 2.0}
    made = ops(spark, [("U1", "U2", 1, "X"), ("U1", "U3", 2, "X"), ("U1", "C2", 1, "X")]).unionByName(oplog.log(spark.createDataFrame([(9, "Y")], "op_idx long, context string"), "create_context"))
    assert w(made, "Y") == {("U1", "U2"): 1.0, ("U1", "U3"): 2.0}
    bulk = ops(spark, [("U1", "U9", 1)]).unionByName(ops(spark, [("U1", "U2", 1, ""), ("U1", "U3", 1, "X"), ("U2", "U3", 1, "X")]).withColumn("kind", F.lit("bulk_load")).withColumn("op_idx", F.col("op_idx") + 10))
    assert len(w(bulk, "")) == 3 and len(w(bulk, "X")) == 3
    dead = ops(spark, [("U1", "U2", 1), ("U2", "U1", 1)]).unionByName(oplog.log(spark.createDataFrame([(8, "U1"), (9, "U2")], "op_idx long, node string"), "delete_node"))
    assert w(dead, "") == {}
    bad = contexts.classify(ops(spark, [("U1", "U1", 1), ("B1", "C1", 1), ("U1", "V1", 1), ("B1", "V1", 1), ("x", "U1", 1), ("V1", "P1", 1)]))
    assert [r["route"] for r in bad.orderBy("op_idx").collect()] == ["rejected", "rejected", "ignored", "rejected", "rejected", "ignored"]


def test_registry(spark):
    routed = contexts.route(ops(spark, [("O1", "U1", 1), ("O1", "U2", 1), ("U3", "B1", 1), ("B1", "U3", 1)]))
    n = registry.register(routed)
    assert [(r["name"], r["owner"]) for r in n.orderBy("node_id").collect()] == [("U1", None), ("O1", "U1"), ("U2", None), ("U3", None), ("B1", None)]


def test_dense_ids_across_partitions(spark):
    sparse = spark.range(0, 5000, 1, 7).selectExpr("if(id % 5 = 0, 'a', 'b') ctx", "id * 1000003 * if(id % 2 = 0, 1, -1) at")
    got = registry.dense_ids(sparse, "ctx", ["at"], "n").toPandas().sort_values(["ctx", "at"])
    assert all((own.n.to_numpy() == np.arange(len(own))).all() for _, own in got.groupby("ctx"))


def test_decay_golden(spark):
    s = Settings(vsids_bump=1.06)
    edges = [("U1", "U4", 3, "", 0), ("U1", "U2", 3, "", 0), ("U1", "U3", 1, "", 20), ("U1", "U4", 1, "", 200)]
    three = {r["dst"]: r["weight"] for r in decay.decayed(contexts.route(ops(spark, edges[:3])), s).collect()}
    assert three["U3"] == pytest.approx(3.207, abs=1e-3) and set(three) == {"U2", "U3", "U4"}
    assert [r["dst"] for r in decay.decayed(contexts.route(ops(spark, edges)), s).collect()] == ["U4"]


@given(st.lists(st.tuples(st.integers(0, 5), st.sampled_from([-2.0, 0.0, 0.5, 1.0, 3.0]), st.integers(0, 60)), min_size=1, max_size=30))
@hyp(max_examples=60, deadline=None)
def test_decay_fold_matches_closed_form(log):
    s = Settings(vsids_bump=1.4)
    p = pd.DataFrame([("", "U", f"U{d}", i, a, m) for i, (d, a, m) in enumerate(log)], columns=["context", "src", "dst", "op_idx", "amount", "magnitude"])
    p["s"] = p.amount * s.vsids_bump**p.magnitude
    most, last = p.s.abs().max(), p.op_idx.max()
    final = p.sort_values("op_idx").groupby("dst").tail(1)
    want = {r.dst: r.s for r in final.itertuples() if abs(r.s) > 1e-6 and (r.op_idx == last or abs(r.s) > most * s.deletion_ratio)}
    got = {r.dst: r.weight for r in decay.fold(p, s).itertuples()}
    assert got == pytest.approx(want)


def test_rescaling(spark):
    s = Settings(vsids_bump=2.0, rescale_threshold=100.0)
    got = {r["dst"]: r["weight"] for r in decay.decayed(contexts.route(ops(spark, [("U1", "U2", 64, "", 0), ("U1", "U3", 4, "", 6)])), s).collect()}
    assert got == {"U2": 1.0, "U3": 4.0}


def test_graph_view(spark):
    s = Settings(num_walks=100, reverse="none")
    rows = lambda df: [(r["src"], r["dst"], round(r["weight"], 4)) for r in df.orderBy("position").collect()]
    apart = [("U31", "B1", 1), ("U32", "U33", 1), ("U32", "B2", 1)]
    more = [("U11", "U12", 2), ("U11", "U13", 1), ("U12", "U13", 3), ("U12", "U11", 4)]
    long = [("U20", "U21", 5), ("U21", "U22", 4), ("U22", "U23", 3), ("U23", "U24", 2), ("U23", "U25", 4), ("U23", "U26", 8)]
    e = engine(spark, [*F1, *more, *long, *apart], s)
    assert rows(e.graph("U1", "U2")) == [("U1", "U2", 0.6667), ("U2", "U3", 1.0)]
    for case, ego, focus, args, want in [
        ("normalised", "U11", "U12", {}, [("U11", "U12", 0.6667), ("U12", "U11", 0.5714), ("U12", "U13", 0.4286)]),
        ("no path", "U31", "U32", {}, [("U32", "U33", 0.5)]),
        ("forced", "U31", "U32", {"force": True}, [("U31", "U32", 1.0), ("U32", "U33", 0.5)]),
    ]:
        assert rows(paths.view(e.graph_of().edges, ego, focus, **args)) == want, case
    targets = lambda **args: [d for _, d, _ in rows(paths.view(e.graph_of().edges, "U20", "U23", **args))]
    assert targets(count=2) == ["U21", "U22", "U23"]
    assert targets(count=10) == ["U21", "U22", "U23", "U26", "U25", "U24"]
    assert targets(index=4, count=1) == ["U25"]


def test_contraction():
    assert paths.contract(["U1", "B1", "U2", "U3"], {("U1", "B1"): 0.5, ("B1", "U2"): 0.5, ("U2", "U3"): 1.0}) == [("U1", "U2", 0.25), ("U2", "U3", 1.0)]


def test_cheapest_path(spark):
    links = spark.createDataFrame([("a", "b", 5.0), ("a", "c", 3.0), ("b", "d", 4.0), ("c", "e", 1.0), ("d", "f", 10.0), ("e", "g", 1.0), ("g", "h", 1.0), ("h", "f", 1.0), ("x", "f", 0.5), ("f", "c", 1.0)], "src string, dst string, cost double")
    assert paths.cheapest(links, "a", "f") == ["a", "c", "e", "g", "h", "f"]
    assert paths.cheapest(links, "a", "x") is None and paths.cheapest(links, "a", "a") == ["a"] and paths.cheapest(links, "x", "c") == ["x", "f", "c"]


def _op(spark, kind, *rows):
    """Operations (op_idx, context, src, dst, amount, node) of one kind."""
    return oplog.log(spark.createDataFrame([*rows], "op_idx long, context string, src string, dst string, amount double, node string"), kind)


def _weights(log, **args):
    found: dict[str, dict] = {}
    for r in TrustEngine(log, **{"with_decay": False, **args}).all_edges().collect():
        found.setdefault(r["context"], {})[r["src"], r["dst"]] = round(r["weight"], 4)
    return found


def test_log_goes_on_after_a_bulk_load(spark):
    load = _op(spark, "bulk_load", (10, "", "U1", "B1", 1.0, "x"), (11, "X", "U1", "U2", 1.0, "x"), (12, "", "U3", "B1", 2.0, "x"), (13, "Y", "U4", "B2", 1.0, "x"))
    before = _op(spark, "edge", (1, "Z", "U7", "U8", 1.0, None))
    zero = oplog.log(spark.createDataFrame([(2, "U7", 0.5)], "op_idx long, node string, score double"), "zero_opinion")
    after = _op(spark, "edge", (20, "", "U1", "B1", 5.0, None), (21, "", "U2", "U3", 1.0, None)).unionByName(_op(spark, "delete_edge", (22, "", "U3", "B1", None, None))).unionByName(_op(spark, "delete_node", (23, "Y", None, None, None, "U4")))
    e = TrustEngine(before.unionByName(zero).unionByName(load).unionByName(after), with_decay=False)
    got = _weights(e.ops)
    assert got == {"": {("U1", "U2"): 1.0, ("U1", "B1"): 5.0, ("U2", "U3"): 1.0}, "X": {("U1", "U2"): 1.0, ("U2", "U3"): 1.0}, "Y": {("U1", "U2"): 1.0, ("U2", "U3"): 1.0}}
    assert e.graph_of().zero.count() == 0 and [r["node"] for r in e.nodelist().collect()] == ["U1", "U2", "B1", "U3", "U4", "B2"]


def test_bulk_loads_and_resets_replace(spark):
    a = _op(spark, "bulk_load", (1, "", "U1", "U2", 1.0, "a"), (2, "X", "U1", "U3", 1.0, "a"))
    b = _op(spark, "bulk_load", (3, "", "U5", "U6", 2.0, "b"))
    assert _weights(a.unionByName(b)) == {"": {("U5", "U6"): 2.0}}
    reset = _op(spark, "reset", (4, "", None, None, None, None))
    assert _weights(a.unionByName(b).unionByName(reset)) == {}
    late = _op(spark, "edge", (5, "X", "U1", "U9", 3.0, None))
    assert _weights(a.unionByName(reset).unionByName(late)) == {"": {("U1", "U9"): 3.0}, "X": {("U1", "U9"): 3.0}}


def test_created_context_gets_decayed_edges_of_nodes_left(spark):
    edges = ops(spark, [("U1", "U2", 1, "", 10), ("U3", "U4", 1, "", 0), ("U1", "B1", 1, "", 0), ("U5", "U1", -1, "", 0)])
    gone = _op(spark, "delete_node", (7, "", None, None, None, "U3"))
    made = _op(spark, "create_context", (8, "X", None, None, None, None), (9, "X", None, None, None, None))
    got = _weights(edges.unionByName(gone).unionByName(made), with_decay=True)
    assert got["X"] == {("U1", "U2"): 1.3439, ("U5", "U1"): -1.0} and got[""][("U1", "U2")] == 1.3439
    load = _op(spark, "bulk_load", (1, "", "U1", "U2", 1.0, None), (2, "", "U1", "B2", 1.0, None))
    assert _weights(load.unionByName(_op(spark, "create_context", (3, "X", None, None, None, None)))) == {"": {("U1", "U2"): 1.0, ("U1", "B2"): 1.0}, "X": {("U1", "U2"): 1.0}}


def test_calculate_registers_users_and_zero_opinions_need_nodes(spark):
    log = ops(spark, [("U1", "U2", 1)]).unionByName(_op(spark, "calculate", (5, "", None, None, None, "U9"), (6, "", None, None, None, "B9")))
    zero = oplog.log(spark.createDataFrame([(3, "U9", 0.5), (4, "U2", 0.25), (7, "U9", 0.75), (8, "U1", 0.1)], "op_idx long, node string, score double"), "zero_opinion")
    g = TrustEngine(log.unionByName(zero.where("op_idx < 7")), with_decay=False).graph_of()
    assert [r["name"] for r in g.nodes.orderBy("node_id").collect()] == ["U1", "U2", "U9"]
    assert {r["node"]: r["z"] for r in g.zero.collect()} == {1: 0.25}


def test_untouched_egos_keep_their_hits(spark):
    e = engine(spark, [("U1", "U2", 1), ("U3", "U4", 1), ("U2", "U1", 1), ("U4", "U3", 1)], Settings(num_walks=50))
    first = e.graph_of()
    for name in ("U1", "U3"):
        first.hits(first.node_id(name))
    more = ops(spark, [("U4", "U9", 2)]).withColumn("op_idx", F.lit(100).cast("long"))
    after = e.apply(more).graph_of()
    assert list(after._hits) == [first.node_id("U1")]
    fresh = TrustEngine(e.ops.unionByName(more), e.settings).graph_of()
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(after.hits(0)) == key(fresh.hits(0)) and key(after.hits(2)) == key(fresh.hits(2)) != key(first.hits(2))


def test_null_arguments(spark):
    e = engine(spark, F1)
    for call in (lambda: e.scores(None), lambda: e.node_score("U1", None), lambda: e.neighbors(None, "U1"), lambda: e.neighbors("U1", None), lambda: e.mutual_scores(None), lambda: e.graph(None, "U1"), lambda: e.graph("U1", None), lambda: e.connected(None)):
        with pytest.raises(ValueError, match="should not be null"):
            call()


def test_exact_is_for_small_graphs():
    with pytest.raises(ValueError, match="too many"):
        kernel.exact(np.array([0]), np.array([1]), np.array([1.0]), 0, kernel.EXACT_NODES + 1, 0.85)


def test_exact_beyond_dense_graphs(spark, monkeypatch):
    core = [("U0", "U1", 2), ("U1", "U2", 3), ("U2", "U0", -1), ("U1", "U0", 1), ("U2", "U1", 4)]
    g = engine(spark, [*core, *((f"U{i}", "U0", 1) for i in range(3, kernel.EXACT_NODES + 10))]).graph_of()
    small = engine(spark, core).graph_of()
    want = {r["node"]: r["score"] for r in small.exact(small.node_id("U0")).collect()}
    got = {r["node"]: r["score"] for r in g.exact(g.node_id("U0")).collect()}
    assert len(got) == kernel.EXACT_NODES + 10 and {k: got[k] for k in want} == pytest.approx(want, abs=1e-12)
    assert not any(v for k, v in got.items() if k not in want)
    rand = np.random.default_rng(5)
    edges = {(int(a), int(b)): int(w) for a, b, w in zip(rand.integers(0, 40, 300), rand.integers(0, 40, 300), rand.choice([-2, 1, 3], 300)) if a != b}
    g = engine(spark, [(f"U{a}", f"U{b}", w) for (a, b), w in edges.items()]).graph_of()
    dense = [r["score"] for r in g.exact(3).orderBy("node").collect()]
    monkeypatch.setattr(kernel, "EXACT_NODES", 10)
    assert [r["score"] for r in g.exact(3).orderBy("node").collect()] == pytest.approx(dense, abs=1e-12)


def test_two_hops(spark):
    e = contexts.last_write(contexts.route(ops(spark, [("U1", "B1", -1), ("B1", "U2", 1), ("U1", "U3", 3), ("B1", "U1", 1)])))
    assert {r["dst"]: r["weight"] for r in neighbors.focus_neighbors(e, "U1").collect()} == pytest.approx({"U2": -0.125, "U3": 0.75})


def test_sources(spark, tmp_path):
    (tmp_path / "e.csv").write_text("src, dst, weight\n1, 2, 3.5\n2, 3, -1\n")
    assert [(r["src"], r["dst"], r["amount"]) for r in oplog.read_csv(spark, str(tmp_path / "e.csv")).collect()] == [("1", "2", 3.5), ("2", "3", -1.0)]
    with pytest.raises(ValueError):
        oplog.from_arrays(spark, ["U1"], ["U2"], [1.0, 2.0], [0], [""])
    assert oplog.from_arrays(spark, ["U1"], ["U2"], [1.0], [-3], [None]).first()["magnitude"] == 0
    nan = spark.createDataFrame([(0, float("nan")), (1, float("inf")), (2, 1.0)], "op_idx long, amount double")
    assert oplog.log(nan).count() == 1
    with pytest.raises(ValueError):
        oplog.bounds(1.0, 1.0, None, None)


def test_polls_and_others(spark):
    votes = spark.createDataFrame([(1, "U1", "a", 1.0), (2, "U1", "b", 1.0), (3, "U2", "a", 1.0), (4, "U3", "a", 1.0), (5, "U3", "a", 0.0)], "op_idx long, user string, option string, amount double")
    options = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p")], "option string, poll string")
    s = spark.createDataFrame([("U1", "U1", 0.6), ("U1", "U2", 0.2), ("U1", "U3", 0.9)], "ego string, user string, score double")
    assert {r["option"]: (round(r["share"], 6), r["votes"]) for r in polls.poll_results(votes, options, s).collect()} == {"a": (0.25, 1), "b": (0.75, 1), "c": (0.0, 0)}
    ring = spark.createDataFrame([(0, 1), (1, 2), (2, 0)], "src long, dst long")
    assert {r["node"]: round(r["rank"] / 1e12, 3) for r in polls.pagerank(ring).collect()} == {0: 0.333, 1: 0.333, 2: 0.333}
    v = polls.consensus(spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 6.0)], "node long, value double"), ring.union(spark.createDataFrame([(0, 2)], "src long, dst long")), 10)
    assert all(abs(r["value"] - 3.0) < 0.2 for r in v.collect())
    names = spark.createDataFrame([("U1", "U2"), ("U1", "B3")], "ego string, name string")
    assert polls.maybe_seen(names, polls.bloom(names)).where("seen").count() == 2
    assert tuple(polls.latency(spark.range(1, 101).selectExpr("cast(id as double) value")).first()) == (50.0, 96.0, 100.0, 1.0, 100.0, 100)


def test_streaming(spark, tmp_path):
    from vouchgraph.streaming.oplog_stream import Published, decay_stream, read_stream

    inbox = tmp_path / "in"
    log = ops(spark, [("U1", "U2", 2), ("U1", "U3", 1), ("U2", "U3", 3), ("U1", "U2", 0)])
    log.where("op_idx < 3").coalesce(1).write.mode("append").parquet(str(inbox))
    seen = Published(spark, str(tmp_path / "log"), Settings(num_walks=100))
    q = seen.start(read_stream(spark, str(inbox)), str(tmp_path / "cp"))
    try:
        seen.sync(q)
        first = seen.engine
        assert first.edgelist().count() == 3
        log.where("op_idx = 3").coalesce(1).write.mode("append").parquet(str(inbox))
        assert seen.sync(q) == 1 and seen.engine is not first and seen.engine.edgelist().count() == 2
    finally:
        q.stop()
    routed = read_stream(spark, str(inbox)).select("op_idx", "context", "src", "dst", "amount", "magnitude")
    q = decay_stream(routed).writeStream.outputMode("update").format("memory").queryName("edges_now").start()
    try:
        q.processAllAvailable()
        assert spark.table("edges_now").where("src = 'U1' and dst = 'U2' and weight = 0").count() == 1
    finally:
        q.stop()


def test_cache_of_egos(spark):
    g = engine(spark, F1, Settings(num_walks=10, walks_cache_size=1)).graph_of()
    g.hits(0), g.hits(1)
    assert list(g._hits) == [1]
    g.clear()
    assert not g._hits


def test_entry_without_corpus(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


def test_entry_without_what_the_corpus_needs(monkeypatch):
    import __spark_entry__ as e

    graphs = set(e.graphs.QUERIES)
    for name in [m for m in sys.modules if m.startswith("vouchgraph.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, "tiktoken", None)
    assert set(e.queries()) == graphs and set(e.oracle_sql()) <= graphs


def test_service_and_sql(spark):
    s = TrustService(spark, Settings(num_walks=300, num_score_quantiles=10))
    for a, b, w in [("U1", "U2", 3), ("U1", "U3", 1), ("U2", "U1", 2), ("U2", "U3", 4), ("U3", "U1", 3), ("B1", "U2", 1), ("U1", "B1", 2), ("U3", "U2", -2)]:
        s.put_edge(a, b, w)
    with pytest.raises(ValueError, match="weight should not be null"):
        s.put_edge("U1", "U2", None)
    s.register_functions()
    key = lambda df: sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.drop("position").collect())
    for sql, want in [("trust_scores('U1')", s.scores("U1")), ("trust_scores('U1', kind => 'U', gte => 0.1, index => 1, count => 1)", s.scores("U1", kind="U", gte=0.1, index=1, count=1)),
                      ("trust_scores('U2', hide_personal => true)", s.scores("U2", hide_personal=True)), ("trust_node_score('U1', 'B1')", s.node_score("U1", "B1")), ("trust_mutual_scores('U1')", s.mutual_scores("U1")),
                      ("trust_neighbors('U1', 'U2')", s.neighbors("U1", "U2")), ("trust_neighbors('U1', 'U2', 1)", s.neighbors("U1", "U2", 1)), ("trust_connected('U1')", s.connected("U1")), ("trust_edgelist()", s.edgelist()), ("trust_nodelist()", s.nodelist())]:
        assert key(spark.sql(f"SELECT * FROM {sql}")) == key(want), sql
    first = {r["dst"] for r in s.fetch_new_edges("U1", "U").collect()}
    assert "U2" in first and s.fetch_new_edges("U1", "U").count() == 0 and s.fetch_new_edges("U1", "B").count() == 1
    kept = s.get_new_edges_filter("U1")
    s.put_edge("U1", "U7", 9)
    assert {r["dst"] for r in s.fetch_new_edges("U1").collect()} == {"U7"}
    s.set_new_edges_filter("U1", kept)
    assert {r["dst"] for r in s.fetch_new_edges("U1").collect()} == {"U7"}
    s.bulk_load_edges(["U1", "U1"], ["U3", "U4"], [1.0, 1.0], [0, 0], ["", ""])
    assert {(r["src"], r["dst"]) for r in s.edgelist().collect()} == {("U1", "U3"), ("U1", "U4")}
    top = {r["name"]: r["score"] for r in s.recompute_zero_opinions(top=2).collect()}
    assert set(top) == {"U3", "U4"} and {round(r["z"], 9) for r in s.sync().graph_of().zero.collect()} == {round(x, 9) for x in top.values()}
    s.reset()
    assert s.nodelist().count() == 0


def test_poll_view(spark):
    votes = spark.createDataFrame([(1, "U1", "a", 1.0), (2, "U2", "b", 1.0), (3, "U3", "a", 1.0), (4, "U9", "b", 1.0)], "op_idx long, user string, option string, amount double")
    options = spark.createDataFrame([("a", "p"), ("b", "p"), ("c", "p")], "option string, poll string")
    own = spark.createDataFrame([("U1", "U1", 0.6), ("U1", "U2", 0.3), ("U1", "U3", 0.1), ("U1", "U4", 0.1), ("U8", "U8", 1.0)], "ego string, user string, score double")
    bounds = spark.createDataFrame([("U1", [0.1, 0.2])], "ego string, bounds array<double>")
    totals = spark.createDataFrame([("U1", 1.0), ("U2", 1.0), ("U3", 2.0), ("U9", 9.0)], "user string, score double")
    got = {(r["ego"], r["option"]): (round(r["share"], 6), round(r["global_share"], 6), r["circle"], r["votes"]) for r in polls.poll_view(votes, options, own, totals, bounds, 1.0).collect()}
    assert got["U1", "a"] == (0.333333, 0.5, 75, 2) and got["U1", "b"] == (0.666667, 0.5, 75, 1) and got["U1", "c"] == (0.0, 0.0, 75, 0)
    assert got["U8", "a"] == (0.0, 0.5, 0, 0)
