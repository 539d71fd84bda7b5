"""The pipeline, each stage held against a brute-force version of its decision on its own input."""

from __future__ import annotations

from collections import Counter

import duckdb
import pytest

import corpus_pipeline
from vouchgraph.llm import bpe, langid, minhash, mixing, quality

SF = "/root/testdata/sf0.001"


def _sql(docs, sql: str) -> list[tuple]:
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    con.execute(f"CREATE VIEW labels AS SELECT * FROM '{SF}/labels.parquet'")
    got = con.sql(sql)
    return [dict(zip(got.columns, r)) for r in got.fetchall()]


def _groups(texts: list[str]) -> list[int]:
    sets = [set(minhash.shingles(t.encode()).tolist()) for t in texts]
    group = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if texts[i] == texts[j] or (sets[i] and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= minhash.AGREE):
                group = [group[j] if g == group[i] else g for g in group]
    return group


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of each stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        path = str(tmp_path_factory.mktemp("pipeline") / name)
        stage(spark, docs, SF).write.parquet(path)
        out[name] = (docs, docs := spark.read.parquet(path))
    return out


def _ids(df) -> Counter:
    return Counter(r[0] for r in df.select("doc_id").collect())


def test_columns(stages):
    assert [name for name, _ in corpus_pipeline.STAGES] == list(stages)
    for before, after in list(stages.values())[:-1]:
        assert after.dtypes == before.dtypes


def test_language(stages):
    before, after = stages["language_id"]
    model = langid.train(before)
    want = Counter()
    for r in before.collect():
        bits, n = model.bits([langid.letters(w) for w in (r["text"] or "").split()] or [""])
        if model.choose(bits.sum(axis=0)[None], n.sum(keepdims=True))[2][0]:
            want[r["doc_id"]] += 1
    assert _ids(after) == want


def test_quality(stages):
    before, after = stages["quality_rules"]
    assert _ids(after) == Counter(r["doc_id"] for r in _sql(before, quality.SQL) if r["keep"])


def test_near_duplicates(stages):
    before, after = stages["minhash_dedup"]
    rows = sorted((r["doc_id"], r["text"]) for r in before.select("doc_id", "text").collect())
    first: dict[int, int] = {}
    for (i, _), g in zip(rows, _groups([t for _, t in rows])):
        first.setdefault(g, i)
    assert _ids(after) == Counter(first.values())


def test_mixing(stages):
    before, after = stages["source_mixing"]
    assert _ids(after) == Counter(r["doc_id"] for r in _sql(before, mixing.SQL))


def test_bpe(stages):
    before, after = stages["bpe_encoding"]
    e = bpe.encoder(bpe.ranks())
    want = {r["doc_id"]: (e.encode_ordinary(r["text"]), r["text"]) for r in before.collect()}
    assert {r["doc_id"]: (r["token_ids"], r["decoded"]) for r in after.collect()} == want


def _corner_corpus(spark):
    """sf0.001's documents with nulls, empty and very long texts, ties, repeated rows and columns of clashing names."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    first = docs.orderBy("doc_id").limit(3)
    odd = [(None, docs.first()["text"], "en", "web"), (90_001, None, "en", None), (90_002, "", None, "web"), (90_003, " \n\t", "de", None), (90_004, "word " * 60_000, "en", "web"), (90_005, "y" * 250_000, None, "web"), (None, None, None, None)]
    more = spark.createDataFrame([(*r, 1) for r in odd], "doc_id long, text string, lang string, source string, n_chars long").to(docs.schema)
    both = docs.unionByName(first).unionByName(first).unionByName(more).unionByName(more)
    extra = {"digest": "1", "keep": "'k'", "bin": "cast(null as string)", "tokens": "2", "node": "'n'", "words": "array(1)", "__q_id": "3", "block": "4", "decoded": "'own'", "h": "5", "k": "'6'"}
    return both.selectExpr("*", *[f"{v} as `{c}`" for c, v in extra.items()])


def test_run_on_corner_cases(spark, tmp_path):
    docs = _corner_corpus(spark)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    for folder in (tmp_path, tmp_path / "none"):
        spark.read.parquet(f"{SF}/labels.parquet").write.parquet(str(folder / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [c for c in docs.columns if c not in ("text", "decoded")] + ["n_words", "n_tokens", "token_ids", "decoded"]
    e, texts = bpe.encoder(bpe.ranks()), {(r["doc_id"], r["text"]) for r in docs.collect()}
    got = out.collect()
    assert len(got) > 50 and all((r["doc_id"], r["decoded"]) in texts for r in got)
    assert all(e.encode_ordinary(r["decoded"]) == r["token_ids"] and r["n_tokens"] == len(r["token_ids"]) for r in got)
    assert all(r["node"] == "n" and r["words"] == [1] and r["block"] == 4 and r["k"] == "6" for r in got)
    assert max(Counter(r["decoded"] for r in got).values()) == 1  # copies and repeated rows are one
    none = corpus_pipeline.run(spark, str(tmp_path / "none"))
    assert none.columns == out.columns and none.count() == 0
