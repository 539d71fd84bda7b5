"""Corner cases and brute-force twins of the corpus operators."""

from __future__ import annotations

import functools
import gzip
import html.parser
import math
import random
import tracemalloc
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from vouchgraph.llm import bpe, chat, common, embed, groups, langid, lm, minhash, mixing, pages, quality, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep string, bin string, tokens string, node string, digest string, words string"
WORDS = {"en": "the of and that house river stone light under over walks slowly bright".split(), "de": "der die und nicht haus fluss stein licht unter über geht langsam hell".split()}


def _text(rng: random.Random, lang: str, n: int) -> str:
    return " ".join(rng.choice(WORDS[lang]) for _ in range(n))


def corpus(spark, n: int = 120, seed: int = 1):
    """Documents with nulls, empty and long texts, copies, repeated rows, and extra columns of clashing names."""
    rng = random.Random(seed)
    rows = [(i, _text(rng, lang := rng.choice(["en", "de"]), rng.randint(20, 90)), lang, f"s{i % 3}") for i in range(n)]
    rows += [(1000, None, "en", "s0"), (1001, "", "de", None), (None, "the of and stone", None, "s1"), (1002, "x", None, "s1"), (1003, "  \n\t ", "en", "s2")]
    rows += [(1004, rows[3][1], rows[3][2], "s1"), rows[5], rows[5], (1005, rows[7][1] + " river", rows[7][2], None), (1006, "wort " * 30_000, "de", "s2"), (1007, "z" * 50_000, None, "s0")]
    return spark.createDataFrame([(*r, 1, "a", "b", "c", "d", "e", "f") for r in rows], DOCS)


def labels(spark):
    return spark.createDataFrame([(i, int(i % 7 != 0), int(i % 11 == 0)) for i in range(0, 120, 2)] + [(None, 1, 0), (4, None, 0)], "doc_id long, quality int, toxic int")


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def against_duckdb(df, sql: str, **views) -> None:
    con = duckdb.connect()
    for name, v in views.items():
        con.register(name, v.toArrow())
    got = con.sql(sql)
    cols = sorted(df.columns)
    assert cols == sorted(got.columns)
    want = [tuple(r[got.columns.index(c)] for c in cols) for r in got.fetchall()]
    assert rows(df.select(*cols)) == sorted(want, key=repr)


def test_empty_tables(spark):
    none = corpus(spark).limit(0)
    lab = labels(spark).limit(0)
    assert langid.identify(none).count() == langid.keep_identified(none).count() == 0
    assert quality.score(none, lab).count() == quality.keep_good(none, lab).count() == 0
    assert minhash.near_duplicates(none).count() == minhash.keep_one(none).count() == 0
    assert mixing.mix(none).count() == mixing.mixed_documents(none).count() == 0
    assert bpe.decode(bpe.encode(none)).count() == lm.score(none).count() == 0
    assert pages.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert warc.deduplicate(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert embed.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_filters_keep_columns(spark):
    docs = corpus(spark)
    for kept in (langid.keep_identified(docs), quality.keep_good(docs, labels(spark)), minhash.keep_one(docs), mixing.mixed_documents(docs)):
        assert kept.columns == docs.columns
        assert 0 < kept.count() <= docs.count()


# --- language identification ---


def _slow_kn(counts: dict[str, int], order: int):
    """Interpolated Kneser-Ney by dictionaries, one character at a time."""
    grams = [Counter() for _ in range(order)]
    for w, c in counts.items():
        s = "\x02" + w + "\x02"
        for i in range(1, len(s)):
            for k in range(order):
                if i - k >= 0:
                    grams[k][s[i - k : i + 1]] += c
    use = [None] * order
    use[-1] = grams[-1]
    for k in range(order - 2, -1, -1):
        left = defaultdict(set)
        for g in grams[k + 1]:
            left[g[1:]].add(g[0])
        use[k] = {g: (c if k and g[0] == "\x02" and g in starts(grams[k], counts, k) else len(left[g]) or c) for g, c in grams[k].items()}
    out = []
    for k in range(order):
        ones, twos = (sum(v == x for v in use[k].values()) for x in (1, 2))
        d = ones / (ones + 2 * twos) if ones and twos else 0.5
        total, kinds = Counter(), Counter()
        for g, c in use[k].items():
            total[g[:-1]] += c
            kinds[g[:-1]] += 1
        out.append((use[k], d, total, kinds))
    return out


def starts(grams, counts, k):
    return {("\x02" + w + "\x02")[: k + 1] for w in counts}


def test_langid_matches_slow_model():
    rng = random.Random(2)
    counts = {c: dict(Counter(rng.choices(WORDS[c], k=400))) for c in WORDS}
    model = langid.fit(counts)
    chars = {ch for c in counts for w in counts[c] for ch in w} | {"\x02"}
    tests = ["stone", "über", "qqq", "the", "hausriver"]
    bits, n = model.bits(tests)
    for li, c in enumerate(model.langs):
        slow = _slow_kn(counts[c], langid.ORDER)
        for wi, w in enumerate(tests):
            s, cost = "\x02" + w + "\x02", 0
            for i in range(1, len(s)):
                p = 1 / (len(chars) + 1)
                for k in range(min(langid.ORDER, i + 1)):
                    use, d, total, kinds = slow[k]
                    ctx, g = s[i - k : i], s[i - k : i + 1]
                    if total[ctx]:
                        p = max(use.get(g, 0) - d, 0) / total[ctx] + d * kinds[ctx] / total[ctx] * p
                cost += math.floor(-1000 * math.log2(p) + 0.5)
            assert abs(int(bits[wi, li]) - cost) <= n[wi]


def test_langid_accuracy_and_rejection(spark):
    docs = corpus(spark)
    got = {r["doc_id"]: r for r in langid.identify(docs).collect()}
    truth = {r["doc_id"]: r["lang"] for r in docs.where("lang is not null and doc_id < 1000").collect()}
    assert np.mean([got[i]["predicted"] == lang for i, lang in truth.items()]) > 0.97
    assert all(got[i]["accepted"] for i in truth)
    assert not got[1000]["accepted"] and not got[1001]["accepted"] and got[1000]["predicted"] is None
    assert not got[1007]["accepted"]
    assert len(rows(langid.identify(docs))) == docs.count()
    unlabelled = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert langid.identify(unlabelled).where("accepted and predicted is null").count() == docs.count()


def test_langid_limit_is_the_quantile(spark, monkeypatch):
    rng = np.random.default_rng(10)
    per, n = rng.normal(2, 0.1, 2000), np.full(2000, 100)
    per[7] = 6.0  # one odd document doesn't open the language
    mean, a, b, most = langid._limits(per, n)
    z = (per - mean) / np.sqrt(a + b / n)
    assert np.sum(z > most) in (1, 2) and most < z[7]
    own, sizes = langid._limits, []
    monkeypatch.setattr(langid, "_limits", lambda per, n: sizes.append(len(per)) or own(per, n))
    draw = random.Random(11)
    docs = spark.createDataFrame([(i, _text(draw, lang, 8), lang) for lang in WORDS for i in range(2200)], "doc_id long, text string, lang string")
    langid.train(docs)
    assert len(sizes) == 2 and min(sizes) >= 999  # enough for a quantile of 0.999


# --- quality, mixing, chat: against DuckDB ---


def test_quality_sql(spark):
    docs, lab = corpus(spark), labels(spark)
    against_duckdb(quality.score(docs, lab), quality.SQL, documents=docs, labels=lab)
    assert quality.score(docs, lab.limit(0)).where("keep").count() == docs.count()
    kept = quality.score(docs, lab).where("keep").count()
    assert quality.keep_good(docs, lab).count() == kept


def test_mixing_sql(spark):
    docs = corpus(spark)
    against_duckdb(mixing.mix(docs), mixing.SQL, documents=docs)
    assert mixing.mixed_documents(docs).count() == mixing.mix(docs).count()
    levels = [mixing.mix(docs, fractions=(f,)).select("doc_id").count() for f in mixing.FRACTIONS]
    assert levels == sorted(levels)
    assert {r["source"] for r in mixing.mix(docs, {"s1": 1.0}).collect()} <= {"s1"} | {r["source"] for r in mixing.mix(docs, {"s1": 1.0}).where("tokens = 0").collect()}


def test_mixing_meets_weights_under_skew(spark):
    hot = [(i, "w " * 10, "hot") for i in range(1900)]
    docs = spark.createDataFrame(hot + [(10_000 + i, "w " * 10, f"s{i % 19}") for i in range(1900)], "doc_id long, text string, source string")
    by = {(r["source"], r["fraction"]): r for r in mixing.shares(docs).collect()}
    assert len(by) == 60 and by["hot", 1.0]["target"] == 0.05
    assert by["hot", 1.0]["share"] == pytest.approx(1 / 11, abs=1e-3)  # as SQL has it: the small ones can't fill their budgets
    by = {(r["source"], r["fraction"]): r for r in mixing.shares(docs, balanced=True).collect()}
    assert all(abs(r["share"] - r["target"]) < 2e-3 for r in by.values())
    assert by["s3", 1.0]["taken"] == by["s3", 1.0]["own"] == 1000 == by["hot", 1.0]["taken"]
    got = Counter(r["source"] for r in mixing.mix(docs, balanced=True).collect())
    assert got == Counter(r["source"] for r in mixing.mixed_documents(docs, balanced=True).collect()) and set(got.values()) == {100}
    by = {r["source"]: r for r in mixing.shares(docs, {"hot": 3.0, "s1": 1.0, "gone": 4.0}, (1.0,), balanced=True).collect()}
    assert by["gone"]["taken"] == 0 and by["gone"]["target"] == 0.5 and by["hot"]["taken"] == 3 * by["s1"]["taken"] == 3000
    assert by["s2"]["taken"] == 0


def test_chat_sql(spark):
    data = [(1, 0, "user", "hi <|end|>"), (1, 1, "user", "again"), (1, 2, "assistant", None), (1, 2, "assistant", "b"), (1, 2, "assistant", "b"), (1, None, None, "first"), (None, 0, "user", "lost"), (2, 5, "system", ""), (3, 0, "user", "w " * 30_000)]
    turns = spark.createDataFrame([(*r, "x") for r in data], "conv_id long, turn long, role string, text string, formatted string")
    against_duckdb(chat.format_chats(turns), chat.SQL, conversations=turns)


# --- near-dedup ---


def _components(pairs, nodes):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(3)
    pairs = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(180)] + [(400 + i, 401 + i) for i in range(60)] + [(7, 7), (1, 2), (2, 1)]
    want = _components(pairs, {x for p in pairs for x in p})
    got = {r["node"]: r["root"] for r in groups.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: r for n, r in want.items() if n in got}
    assert set(got) >= {x for a, b in pairs if a != b for x in (a, b)}


def _near_corpus(rng):
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.randint(30, 200))) for _ in range(150)]
    passage = " ".join(rng.choices(vocabulary, k=25))
    texts += [passage + " " + " ".join(rng.choices(vocabulary, k=120)) for _ in range(40)]
    for k in range(60):  # near copies, one group of many
        w = texts[k if k < 25 else 0].split()
        for _ in range(max(1, len(w) // 25)):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        texts.append(" ".join(w))
    return texts + [texts[2], texts[2], texts[9].upper() + "."]


def test_minhash_recall(spark):
    texts = _near_corpus(random.Random(4))
    sets = [set(minhash.shingles(t.encode()).tolist()) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.6]
    got = {r["doc_id"]: r["group_id"] for r in minhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert np.mean([got[i] == got[j] for i, j in pairs]) >= 0.9
    want = _components([(i, j) for i in range(len(texts)) for j in range(i) if len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= 0.35], range(len(texts)))
    assert all(want[i] == want[g] for i, g in got.items())  # nothing else was joined


def test_minhash_corner_cases(spark):
    docs = corpus(spark)
    found = minhash.near_duplicates(docs)
    assert found.count() == docs.count()
    by = defaultdict(list)
    for r in found.collect():
        by[r["doc_id"]].append(r)
    assert by[1000][0]["keep"] and by[1000][0]["group_size"] == 1
    assert by[1004][0]["group_id"] == 3 and not by[1004][0]["keep"]
    assert sum(r["keep"] for r in by[5]) == 1 and len(by[5]) == 3
    assert by[1005][0]["group_id"] == 7
    kept = minhash.keep_one(docs)
    assert rows(kept.select("doc_id")) == rows(found.where("keep").select("doc_id"))
    assert minhash.signature(b"  .. ") is None


def test_minhash_region_is_complete_when_small_and_connected_when_large():
    out: list = []
    minhash._region(0, 10, 3, np.full(10, 5), out)
    assert np.concatenate(out, axis=1).shape[1] == 45
    shared = np.array([0] + [random.Random(i).randint(3, 8) for i in range(499)])
    out = []
    minhash._region(0, 500, 3, shared, out)
    pairs = np.concatenate(out, axis=1).T.tolist()
    assert len(set(_components(pairs, range(500)).values())) == 1 and len(pairs) < 500 * 20


def test_embedding_recall(spark):
    rng = np.random.default_rng(5)
    base = rng.standard_normal((300, 32))
    near = base[:60] + rng.standard_normal((60, 32)) * 0.18
    many = base[:1] + rng.standard_normal((200, 32)) * 0.1
    x = np.concatenate([base, near, many])
    data = [(i, v.tolist(), "z") for i, v in enumerate(x)] + [(900, None, "z"), (901, [0.0] * 32, "z"), (902, [], "z"), (903, [1.0, float("nan")], "z"), (None, base[0].tolist(), "z"), (5, base[5].tolist(), "z"), (904, base[3][:16].tolist(), "z")]
    vectors = spark.createDataFrame(data, "vec_id long, embedding array<double>, group_id string")
    found = embed.near_duplicates(vectors)
    assert found.count() == len(data)
    got = {r["vec_id"]: r["group_id"] for r in found.collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u @ u.T
    pairs = [(i, j) for i, j in zip(*np.nonzero(np.triu(s >= embed.LEAST_COSINE, 1)))]
    assert len(pairs) > 1000 and np.mean([got[i] == got[j] for i, j in pairs]) >= 0.9
    want = _components(pairs, range(len(x)))
    assert all(want[i] == want[g] for i, g in got.items() if i is not None and i < len(x))
    assert all(got[i] == i for i in (900, 901, 902, 903, 904))
    assert found.where("vec_id = 5 and keep").count() == 1


def test_embedding_plan_and_sketches():
    assert embed.plan(10**6)[0] > embed.plan(10**4)[0] and embed.plan(10**6, mean=0.5)[0] > embed.plan(10**6)[0]
    rng = np.random.default_rng(6)
    x = rng.standard_normal((4000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    z = rng.standard_normal((4000, 64))
    z -= (z * x).sum(axis=1, keepdims=True) * x
    y = embed.LEAST_COSINE * x + math.sqrt(1 - embed.LEAST_COSINE**2) * z / np.linalg.norm(z, axis=1, keepdims=True)
    signs = rng.standard_normal((64, embed.SKETCH))
    apart = ((x @ signs > 0) != (y @ signs > 0)).sum(axis=1)
    assert (apart <= embed._furthest(embed.LEAST_COSINE)).all()  # pairs at the least cosine always get their vectors


def test_many_equal_vectors_and_texts(spark):
    same = spark.range(50_000).selectExpr("id vec_id", "array(1.0D, 2.0D, 3.0D) embedding").unionByName(spark.range(50_000, 50_010).selectExpr("id vec_id", "array(cast(id - 50000 as double), -1.0D, 0.5D * (id % 3)) embedding"))
    got = embed.near_duplicates(same).where("vec_id < 50000").agg(F.count("*"), F.count_if("keep"), F.min("group_size"), F.max("group_id")).first()
    assert tuple(got)[:3] == (50_000, 1, 50_000) and got[3] == 0
    texts = spark.range(50_000).selectExpr("id doc_id", "'one text that comes again and again' text").unionByName(spark.range(3).selectExpr("cast(null as long) doc_id", "'one text that comes again and again' text"))
    got = minhash.near_duplicates(texts).agg(F.count("*"), F.count_if("keep"), F.min("group_size"), F.max("group_id")).first()
    assert tuple(got) == (50_003, 1, 50_003, 0) and minhash.keep_one(texts).collect()[0]["doc_id"] == 0


# --- BPE, LM, HTML, WARC ---


def test_bpe_equals_the_tokenizer(spark):
    docs = corpus(spark).unionByName(spark.createDataFrame([(2000, "a  b  c\n\n\td 's don't 'll ½ 123 😀👍🏽 \u0085z\x1c　x  ", "en", "s", 1, "", "", "", "", "", "")], DOCS))
    e = bpe.encoder(bpe.ranks())
    got = bpe.decode(bpe.encode(docs)).select("doc_id", "n_tokens", "token_ids", "decoded").collect()
    want = sorted(((r["doc_id"], None if r["text"] is None else e.encode_ordinary(r["text"]), r["text"]) for r in docs.collect()), key=repr)
    assert sorted(((r["doc_id"], r["token_ids"], r["decoded"]) for r in got), key=repr) == want
    assert all(r["n_tokens"] == len(r["token_ids"] or []) for r in got)


def test_bpe_blocks_may_be_small(spark, monkeypatch):
    docs = corpus(spark, 40)
    want = rows(bpe.encode(docs))
    monkeypatch.setattr(bpe, "BLOCK_WORDS", 100)
    assert rows(bpe.encode(docs)) == want


def test_bpe_counts_of_huge_words(monkeypatch):
    class Huge:
        def encode_ordinary(self, w):
            return range((1 << 24) + 3) if w == "huge" else [1]

    fromiter = np.fromiter
    monkeypatch.setattr(bpe, "encoder", lambda pieces: Huge())
    monkeypatch.setattr(np, "fromiter", lambda it, *a: np.zeros(1, np.int64) if not isinstance(it, map) else fromiter(it, *a))  # the ids aren't needed
    words = bpe._pack(bpe.pa.array(["a", "huge"], bpe.pa.large_string()))
    t = bpe.pa.record_batch({"block": [0], "part": [0], "payload": bpe.pa.array([words], bpe.pa.binary())})
    reply = next(bpe._encode(type("B", (), {"value": None}))(iter([t]))).column("reply")[0].as_py()
    assert bpe._from_planes(bpe._unpack(bpe._split(reply)[0])).tolist() == [1, (1 << 24) + 3]


def test_bpe_bad_ids_decode(spark):
    bad = spark.createDataFrame([(1, [10**6]), (2, None), (3, [])], "doc_id long, token_ids array<int>")
    assert [r["decoded"] for r in bpe.decode(bad).orderBy("doc_id").collect()] == ["", None, ""]
    assert [r["decoded"] for r in bpe.decode_by_join(bad).orderBy("doc_id").collect()] == ["", None, ""]


def test_bpe_keeps_columns_and_leaves_no_table(spark, monkeypatch):
    docs = corpus(spark, 20).withColumn("n_words", F.lit("own")).withColumn("a.b", F.struct(F.lit(1).alias("x"), F.lit(None).cast("string").alias("y")))
    monkeypatch.setattr(bpe, "_MEMO_WORDS", 5)  # the memo starts anew all the time
    got = bpe.encode(docs, keep=tuple(c for c in docs.columns if c != "text"))
    assert got.columns == [c for c in docs.columns if c not in ("text", "n_words")] + ["n_words", "n_tokens", "token_ids"]
    assert rows(got.select("doc_id", "source", "`a.b`")) == rows(docs.select("doc_id", "source", "`a.b`"))
    once = common.stage(got, "test-tokens")
    assert rows(bpe.decode(once)) == rows(bpe.decode_by_join(once).select(*[f"`{c}`" for c in once.columns], "decoded"))
    assert any(t.name.startswith("bpe_blocks") for t in spark.catalog.listTables())
    common.drop_staged()
    assert not any(t.name.startswith("bpe_blocks") for t in spark.catalog.listTables())


def _slow_lm(table, text: bytes) -> float:
    """Context mixing of one text, one bit at a time, in float32 like the fast one."""
    f, total, most = np.float32, 0.0, (1 << 32) - 1
    w = np.tile(np.array(lm._START, f), (8, 1))
    own = [np.zeros(16 << lm.ONLINE_BITS, f) for _ in lm.ONLINE]
    middle = (np.arange(lm._BUCKETS) + 0.5) / lm._BUCKETS * 16 - 8
    refine = (1 / (1 + np.exp(-middle))).astype(f)
    for i in range(len(text)):
        before = (b"\0\0\0\0" + text)[i : i + 4]
        base = [int(lm._base(o, np.array([int.from_bytes(before, "big")], np.uint32))[0]) for o in lm.ORDERS]
        hashes = []
        for o in lm.ONLINE:
            h = (int.from_bytes(before[-o:], "big") + (o << 24)) * 0x9E3779B1 & most
            hashes.append((h, (h ^ ((text[i] >> 4) + 1) * 0x85EBCA6B & most) * 0xC2B2AE35 & most))
        node = 1
        for j in range(8):
            bit = (text[i] >> (7 - j)) & 1
            part = node if j < 4 else node & ((1 << (j - 4)) - 1) | (1 << (j - 4))
            slot = [((pair[j >= 4] >> (33 - lm.ONLINE_BITS)) * 2 + (j >= 4)) * 16 + part for pair in hashes]
            z = np.array([table[((b + node * int(lm._SPREAD)) & ((1 << lm.SLOT_BITS[k]) - 1)) + lm._OFFSETS[k]] / lm._SCALE for k, b in enumerate(base)] + [own[k][x] for k, x in enumerate(slot)], f)
            x = float(w[j] @ z)
            p = 1 / (1 + math.exp(-x))
            w[j] += z * f((bit - p) * lm._RATES[0, 0])
            for k, at in enumerate(slot):
                own[k][at] += f((bit - 1 / (1 + math.exp(-float(own[k][at])))) * lm._RATES[1, 0])
            cell = int(min(max(x * lm._BUCKETS / 16 + lm._BUCKETS / 2, 0), lm._BUCKETS - 0.01))
            q = float(refine[cell])
            refine[cell] += f((bit - q) * lm._MAP_RATE)
            p = (p + q) / 2
            total -= math.log2(max(p if bit else 1 - p, 1 / 4096))
            node = node * 2 + bit
    return total


def test_lm_matches_slow_coder(spark):
    docs = corpus(spark, 30)
    table = lm.train(docs)
    texts = [b"the of and stone \xc3\xbcber", b"", b"q" * 40, ("river light " * 120).encode()]
    fast = lm.Coder(table).bits(texts)
    assert fast == pytest.approx([_slow_lm(table, t) for t in texts], rel=2e-3, abs=0.2)
    slow = Counter()
    for r in docs.collect():
        t = (r["text"] or "").encode()
        for i in range(len(t)):
            slow[int.from_bytes((b"\0\0\0\0" + t)[i : i + 5], "big")] += 1
    got = docs.select("text").where("text is not null").mapInArrow(lm._count, "gram long, n long").groupBy("gram").sum("n").collect()
    assert {r[0]: r[1] for r in got} == slow


def test_lm_contexts_never_share_counts(spark, monkeypatch):
    rng = random.Random(8)
    docs = spark.createDataFrame([(i, "".join(chr(rng.randrange(0x4E00, 0x9FFF)) for _ in range(500))) for i in range(40)], "doc_id long, text string")
    table = lm.train(docs)
    ones, n = Counter(), Counter()
    for r in docs.collect():
        t = b"\0\0\0\0" + r["text"].encode()
        for i in range(4, len(t)):
            for k, o in enumerate(lm.ORDERS):
                for j in range(8):
                    key = (k, int.from_bytes(t[i - o : i], "big"), (t[i] | 256) >> (8 - j))
                    n[key] += 1
                    ones[key] += t[i] >> (7 - j) & 1
    for k, o in enumerate(lm.ORDERS):
        keys = [x for x in n if x[0] == k]
        base = lm._base(o, np.array([x[1] for x in keys], np.uint32)).astype(np.int64)
        slot = ((base + np.array([x[2] for x in keys]) * int(lm._SPREAD)) & ((1 << lm.SLOT_BITS[k]) - 1)) + lm._OFFSETS[k]
        p = np.array([(ones[x] + 0.4) / (n[x] + 0.8) for x in keys])
        assert np.array_equal(table[slot], np.clip(np.round(np.log(p / (1 - p)) * lm._SCALE), -127, 127))
    whole = {r["doc_id"]: r["bits"] for r in lm.score(docs).collect()}
    monkeypatch.setattr(lm, "GROUP_BYTES", 5000)  # many groups look their grams up: nothing changes
    assert {r["doc_id"]: r["bits"] for r in lm.score(docs).collect()} == pytest.approx(whole, abs=0.01)
    texts = [r["text"].encode() for r in docs.orderBy("doc_id").collect()]
    assert lm.Coder(table).bits(texts) == pytest.approx([whole[i] for i in range(len(texts))], abs=0.01)


def test_lm_codes_long_texts_whole(spark):
    rng = random.Random(9)
    phrase = bytes(rng.randrange(33, 127) for _ in range(30))
    texts = [phrase * 100, b"the of and stone " * 3, ("haus fluss stein " * 250).encode(), b"z" * 5000]
    table = lm.train(corpus(spark, 30))
    fast = lm.Coder(table).bits(texts)
    assert fast == pytest.approx([_slow_lm(table, t) for t in texts], rel=2e-3, abs=0.2)


def test_lm_learns_within_a_text(spark):
    rng = random.Random(13)
    table = lm.train(corpus(spark, 30))
    noise = [bytes(rng.randrange(200, 256) for _ in range(40)) for _ in range(40)]  # nothing the corpus has
    again, fresh = lm.Coder(table).bits([noise[0] * 40, b"".join(noise)])
    assert again < 0.6 * fresh  # only predictors that learn online can tell


def test_lm_groups_texts_of_similar_length(spark):
    docs = spark.createDataFrame([(i, "x" * n) for i, n in enumerate([0, 5, 1000, 1024, 2000, 2048, 70_000])] + [(7, None)], "doc_id long, text string")
    by = {r["doc_id"]: r["grp"] >> 40 for r in lm._grouped(docs).collect()}
    assert by == {0: 10, 1: 10, 2: 10, 3: 10, 4: 10, 5: 11, 6: 16, 7: 10}


def test_lm_lays_out_slots_block_by_block():
    rng = random.Random(17)
    texts = [bytes(rng.choices(b"abcd", k=3000)) for _ in range(1000)]
    coder = lm.Coder(lm.Table(np.zeros(0, np.int64), np.zeros(0, np.int8)))
    tracemalloc.start()
    try:
        coder.bits(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 25 * sum(map(len, texts))  # some 17; with the slots of all bytes at once 33


def test_lm_texts_that_end_within_a_block(spark, monkeypatch):
    rng = random.Random(16)
    texts = [bytes(rng.choice(b"the of and") for _ in range(n)) for n in (1, lm.BLOCK - 1, lm.BLOCK, 0, lm.BLOCK + 1, 3 * lm.BLOCK + 5, 2)]
    table = lm.train(corpus(spark, 30))
    whole = lm.Coder(table).bits(texts)
    assert whole == pytest.approx([_slow_lm(table, t) for t in texts], rel=2e-3, abs=0.2)
    assert np.array_equal(whole, [lm.Coder(table).bits([t])[0] for t in texts])
    for lanes, block in ((2, 16), (1024, 1), (3, 7)):
        monkeypatch.setattr(lm, "LANES", lanes)
        monkeypatch.setattr(lm, "BLOCK", block)
        assert np.array_equal(lm.Coder(table).bits(texts), whole)


def test_lm_scores(spark):
    docs = corpus(spark)
    got = lm.score(docs)
    assert got.count() == docs.count()
    by = {r["doc_id"]: r for r in got.collect()}
    assert by[1000]["bits_per_byte"] is None and by[1001]["bits"] == 0
    assert by[3]["bits"] == by[1004]["bits"]
    assert np.mean([by[i]["bits_per_byte"] for i in range(100)]) < 3


PAGE = '<html><head><title>t</title><script>var a="</p><div>x</div>";</script></head><body><nav><a href="#">home</a></nav><div class="post-{n}"><h1>Head {n}</h1><p>First &amp; <b>bold</b> text of page {n}.<p>Second line that goes on for a while.</div><!-- <p>no</p> --><footer>foot</footer>'


def test_pages(spark):
    data = [(i, f"http://WWW.site.org:80/{i}", PAGE.format(n=i)) for i in range(6)]
    data += [(7, "http://site.org/x", "<body><div class='other'><p>only this here</div></body>"), (8, None, PAGE.format(n=8)), (9, "http://e.org", None), (10, "http://e.org", ""), (11, "no url", "just text <b"), (0, "http://site.org/0", PAGE.format(n=0)), (12, "http://big.org", "<div><p>" + "word " * 50_000)]
    got = pages.extract(spark.createDataFrame([(*r, "x", "y") for r in data], "page_id long, url string, html string, path string, host string"))
    by = {r["page_id"]: r for r in got.collect()}
    assert got.count() == len(data)
    assert by[1]["text"] == "Head 1\nFirst & bold text of page 1.\nSecond line that goes on for a while."
    assert by[1]["path"] == "html>body>div.post-#" and by[1]["method"] == "consensus" and by[1]["host"] == "site.org"
    assert by[7]["text"] == "only this here" and by[7]["method"] == "own"
    assert by[8]["method"] == "own" and by[8]["text"].startswith("Head 8")
    assert by[9]["text"] is None and by[10]["text"] == "" and by[11]["text"] == "just text <b"
    assert len(by[12]["text"].split()) == 50_000


def test_pages_vote_for_every_path(spark):
    rng = random.Random(12)
    data = []
    for i in range(40):
        names = ["".join(rng.choices("bcdfghjklmnp", k=8)) for _ in range(6)]
        data.append((i, "http://h.org/%d" % i, "<body>" + "".join(f"<div class='{n}'>" for n in names) + f"<p>Only text of page {i}, long enough to be scored.</p>" + "</div>" * 6))
    got = pages.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert {r["method"] for r in got} == {"consensus"} and len({r["path"] for r in got}) == 1
    assert all(r["text"] == f"Only text of page {r['page_id']}, long enough to be scored." for r in got)


def test_pages_nested_and_quoted():
    deep = pages.Page("<div class='a1'>" * 100_000 + "<p>deep text</p>" + "</section>" * 100_000)
    best = deep.best()
    assert deep.depth[best] == 100_000 and deep.text(best) == "deep text" and len(deep.digest) == 100_001
    page = pages.Page('<body><div class="x" title="a > b"><p title=\'x > y\' data-a=1>hello</p></div>')
    assert page.text(page.best()) == "hello" and page.name(page.best()) == "body>div.x"
    assert pages.Page("<body><p>seen<script>var a = 1 < 2").text(None) == "seen"
    assert pages.Page("<body><p>seen<script>if (a > 1) b").text(None) == "seen" == pages.Page("<body><p>seen<!-- <b> no").text(None)
    assert pages.Page('<body><div title="open><p>still seen</p>').text(None) == "still seen"
    assert pages.Page("<a " * 200_000).text(None).startswith("<a <a")


class _Tree(html.parser.HTMLParser):
    """Another parser of well-formed pages: nested lists (kind, tag, children), strings, and (link, string)."""

    def __init__(self, text):
        super().__init__()
        self.root = ("", "", [])
        self.open, self.link = [self.root], False
        self.feed(text)
        self.close()

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = True
        elif tag in pages._BOX:
            name = (dict(attrs).get("class") or "").split()
            kind = tag + ("." + "".join("#" if c.isdigit() and not (i and name[0][i - 1].isdigit()) else "" if c.isdigit() else c for i, c in enumerate(name[0])).lower() if name else "")
            node = (kind, tag, [])
            self.open[-1][2].append(node)
            self.open.append(node)

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = False
        elif tag in pages._BOX:
            self.open.pop()

    def handle_data(self, data):
        self.open[-1][2].append((self.link, data))


def _slow_scores(text):
    """Score and text of each path of a page, by recursion over the other parser's tree."""
    scores, texts = Counter(), defaultdict(list)

    def visit(node, path):
        kind, tag, inside = node
        here = path + (kind,)
        plain = sum(len(x[1].strip()) for x in inside if len(x) == 2 and not x[0])
        link = sum(len(x[1].strip()) for x in inside if len(x) == 2 and x[0])
        total = plain * plain / (plain + link) if plain else 0.0
        parts = []
        for x in inside:
            if len(x) == 2:
                parts.append(x[1])
            else:
                got, words = visit(x, here)
                total += 0.6 * got
                parts += [] if x[1] in pages._ASIDE else words
        if tag:
            total *= pages._FAVOUR.get(tag, 1.0)
            scores[here[1:]] += total
            texts[here[1:]] += parts
        return total, parts

    visit(_Tree(text).root, ())
    return {p: s for p, s in scores.items() if s > 0}, texts


def _random_page(rng, depth=0):
    """A container with text, links and others in it; no two nested ones have one kind."""
    tag = rng.choice(["div", "section", "article", "nav", "footer", "main"]) if depth else "body"
    name = f' class="{rng.choice(["a", "b7", "c12", "d"])}{depth}"' if depth and rng.random() < 0.8 else ""
    inside = "".join(rng.choice([f"<p>{_text(rng, 'en', rng.randint(1, 12))}</p>", f"<a href='#'>{_text(rng, 'de', 2)}</a> ", f"<b>{_text(rng, 'en', 3)}</b> "]) for _ in range(rng.randint(0, 4)))
    inside += "".join(_random_page(rng, depth + 1) for _ in range(rng.randint(0, 3))) if depth < 4 else ""
    return f"<{tag}{name}>{inside}</{tag}>"


def test_pages_match_brute_force(spark):
    rng = random.Random(21)
    data = [(i, f"http://h{i % 7}.org/{i}", _random_page(rng)) for i in range(150)] + [(500, "http://h1.org/again", None)]
    data += [(501, data[3][1], data[3][2]), (501, data[3][1], data[3][2])]
    slow = {i: _slow_scores(x) for i, _, x in data if x}
    votes = defaultdict(Counter)
    for i, url, x in data:
        if x:
            most = max(slow[i][0].values(), default=1.0)
            votes[url.split("/")[2]].update({p: round(1000 * s / most) for p, s in slow[i][0].items()})
    digest = lambda p: functools.reduce(lambda d, k: xxhash.xxh3_128_digest(d + k.encode()), p, b"")
    won = {h: min(v, key=lambda p: (-v[p], len(p), digest(p))) for h, v in votes.items()}
    got = pages.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    assert len(got) == len(data)
    for r in got:
        if r["page_id"] == 500:
            assert r["method"] == "none"
            continue
        scores, texts = slow[r["page_id"]]
        win = won[r["host"]]
        want = win if win in texts else min(scores, key=lambda p: (-scores[p], len(p), digest(p))) if scores else None
        assert r["path"] == (">".join(want) if want else None) and r["method"] == ("consensus" if want == win else "own" if want else "whole")
        if want:
            assert r["text"].split() == " ".join(texts[want]).split()


def test_warc_archives_stay_in_a_folder(spark, tmp_path):
    table = spark.createDataFrame([(i, f"http://a.org/{i}", f"<p>{i // 2}</p>") for i in range(8)], "page_id long, url string, html string")
    want = rows(warc.deduplicate(table).drop("file", "offset", "length"))
    got = warc.deduplicate(table, f"file://{tmp_path}/out")
    common.drop_staged()  # as at the end of Python
    assert rows(got.drop("file", "offset", "length")) == want
    for r in spark.read.parquet(f"file://{tmp_path}/out/index").collect():
        assert r["file"].startswith(f"{tmp_path}/out/archives/")
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            assert warc.parse(f.read(r["length"]))[0]["WARC-Record-ID"] == r["record_id"]


def test_warc_round_trip(spark):
    data = [(i, f"http://a.org/{i}", f"<p>{i // 2}</p>") for i in range(8)] + [(20, None, "x"), (None, "http://n.org\r\nEvil: 1", "y"), (21, "http://z.org", None), (22, "http://e.org", ""), (3, "http://a.org/3", "<p>1</p>"), (24, "http://l.org", "w" * 100_000)]
    table = spark.createDataFrame([(*r, "z") for r in data], "page_id long, url string, html string, file string")
    got = warc.deduplicate(table)
    against_duckdb(got.drop("file", "offset", "length"), warc.SQL, pages=table)
    payload = {}
    for r in sorted(got.collect(), key=lambda r: r["warc_type"]):  # responses first
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            headers, block = warc.parse(f.read(r["length"]))
        assert headers["WARC-Type"] == r["warc_type"] and headers["WARC-Record-ID"] == r["record_id"] and "Evil" not in headers
        assert int(headers["Content-Length"]) == len(block) == r["content_length"]
        if r["warc_type"] == "response":
            payload[r["record_id"]] = block.partition(b"\r\n\r\n")[2]
        else:
            assert r["refers_to"] in payload and headers["WARC-Refers-To"] == r["refers_to"]
    assert set(payload.values()) == {r[2].encode() for r in data if r[2] is not None}


def test_warc_string_ids(spark):
    table = spark.createDataFrame([(f"p{i}", f"http://a.org/{i}", f"<p>{i // 2}</p>") for i in range(12)] + [(None, None, "x")], "page_id string, url string, html string")
    got = warc.deduplicate(table).collect()
    captures = Counter(r["page_id"] for r in got)
    assert captures == {k: 2 if warc._again(k) else 1 for k in captures} and len(captures) == 13 and 2 in captures.values()
    assert sum(r["action"] == "original" for r in got) == 7


def _foreign(kind, name, digest, block, extra=b"", uri=b"http://f.org/x"):
    """A record as other writers make it: folded headers, odd case, no blanks."""
    head = b"WARC/1.0\r\nwarc-type:" + kind + b"\r\nWARC-Record-ID: <" + name + b">\r\nWARC-Target-URI:\r\n " + uri + b"\r\nWARC-Date:2024-03-01T00:00:0" + name[-1:] + b"Z\r\n"
    return head + (b"WARC-Payload-Digest: " + digest + b"\r\n" if digest else b"") + extra + b"Content-Type: application/http; msgtype=response\r\nContent-Length: " + str(len(block)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_warc_archives_of_other_writers(spark, tmp_path):
    http = b"HTTP/1.1 200 OK\r\nX: y\r\n\r\n"
    big = bytes(random.Random(1).randrange(256) for _ in range(3_000_000))
    one = [_foreign(b"warcinfo", b"i0", None, b"software: x"), _foreign(b"response", b"a1", None, http + b"same"), _foreign(b"response", b"a2", b"sha1:Q", http + big), _foreign(b"request", b"q3", None, b"GET / HTTP/1.1\r\n\r\n")]
    two = [_foreign(b"response", b"b4", None, http + b"same"), _foreign(b"revisit", b"b5", b"sha1:Q", http), _foreign(b"revisit", b"b6", None, http), _foreign(b"revisit", b"b7", b"sha1:none", http)]
    (tmp_path / "one.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in one))
    (tmp_path / "two.warc").write_bytes(b"".join(two))
    (tmp_path / "cut.warc").write_bytes(_foreign(b"response", b"c8", None, http + b"cut off here")[:-12])
    index = warc.index_archives(spark, [str(tmp_path / n) for n in ("one.warc.gz", "two.warc", "cut.warc")])
    assert index.count() == 8
    got = {r["page_id"]: r for r in warc.rewrite(warc.resolve(index), f"file://{tmp_path}/out").collect()}
    assert {k.strip("<>"): r["action"] for k, r in got.items()} == {"i0": "other", "a1": "original", "a2": "original", "q3": "other", "b4": "revisit", "b5": "revisit", "b6": "unresolved", "b7": "unresolved"}
    read = {}
    for r in got.values():
        with open(r["file"], "rb") as f:
            f.seek(r["offset"])
            read[r["page_id"].strip("<>")] = warc.parse(f.read(r["length"]))
    assert read["a2"][1] == http + big and read["b4"][1] == http and read["q3"][1].startswith(b"GET") and read["i0"][1] == b"software: x"
    assert read["b4"][0]["WARC-Refers-To"] == read["a1"][0]["WARC-Record-ID"] and read["b5"][0]["WARC-Refers-To"] == read["a2"][0]["WARC-Record-ID"]
    assert read["a1"][0]["WARC-Target-URI"] == "http://f.org/x" and read["a1"][0]["WARC-Payload-Digest"].startswith("sha256:")
    again = warc.index_archives(spark, sorted({r["file"] for r in got.values()}))
    assert again.count() == 8 and warc.resolve(again).where("action = 'revisit'").count() == 2


def test_unresolved_revisit(spark):
    index = spark.createDataFrame([(1, 0, "revisit", "<a>", "u", "d", "sha256:x", "f", 0, 1), (2, 0, "response", "<b>", "u", "d", None, "f", 1, 1)], warc._INDEX.format(kind="long"))
    assert sorted((r["page_id"], r["action"]) for r in warc.resolve(index).collect()) == [(1, "unresolved"), (2, "original")]


def test_checked_broadcast(spark):
    small = spark.range(10)
    assert "broadcast" in common.checked(small, 8)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in common.checked(small, 8, 10)._jdf.queryExecution().logical().toString().lower()
