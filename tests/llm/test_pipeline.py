from __future__ import annotations

import corpus_pipeline as c
from cosmolake.llm import line_dedup, near_dup, op9_byte_bpe, op10_line_crf, quality_crf

SF = "/root/testdata/sf0.001"


def test_stages_follow_each_other(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    kept = docs
    for name, stage in c.STAGES[:-1]:
        after = stage(spark, kept, SF).cache()
        assert after.columns == docs.columns
        before, left = {r["doc_id"] for r in kept.collect()}, {r["doc_id"] for r in after.collect()}
        assert left < before or name == "line_dedup" and left <= before
        assert left
        kept = after
    last = c.STAGES[-1][1](spark, kept, SF)
    want = sorted(map(tuple, op9_byte_bpe.digests(kept).collect()))
    assert sorted(tuple(r)[:4] for r in last.collect()) == want
    assert {r["doc_id"] for r in c.run(spark, SF).select("doc_id").collect()} == {w[0] for w in want}


def test_each_stage_equals_its_operator(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = op10_line_crf.model(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    good = {r["doc_id"] for r in quality_crf.score(docs, "text", model).where("score >= 0.7").collect()}
    assert {r["doc_id"] for r in c.quality(spark, docs, SF).collect()} == good
    texts = {r["doc_id"]: r["text"] for r in line_dedup.dedup(docs).collect()}
    chars = {r["doc_id"]: (r["text"], r["n_chars"]) for r in docs.collect()}
    for r in c.line_dedup_stage(spark, docs, SF).collect():
        text, n = chars[r["doc_id"]]
        assert r["text"] == texts[r["doc_id"]] and r["n_chars"] == (n if r["text"] == text else len(r["text"]))
    roots = {r["component_id"] for r in near_dup.groups(docs).collect()}
    assert {r["doc_id"] for r in c.near_dedup(spark, docs, SF).collect()} == roots


def test_empty_documents(spark):
    none = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in c.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_odd_rows_pass_every_stage(spark):
    """Nulls in any column, repeated ids and clashing names: each stage gives the columns of documents and loses no clean row."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    good = [r["text"] for r in docs.where("lang = 'en' and length(text) between 400 and 2000").orderBy("doc_id").limit(40).collect()]
    rows = [(90_000 + k, t, None if k % 3 else "en", None if k % 2 else "s", len(t)) for k, t in enumerate(good)]
    rows += [(None, "alone with no id " + good[0][::-1], "en", "s", None), (1, None, "en", "s", None), (2, "", "en", "s", 0), rows[5], rows[5]]
    x = spark.createDataFrame([(*r, "g", "h", "t") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, _gone string, _ht string, _t string")
    for name, stage in c.STAGES[:-1]:
        got = stage(spark, x, SF)
        assert got.columns == docs.columns, name
        assert got.count() <= len(rows)
    assert c.STAGES[-1][1](spark, x, SF).count() == len(rows)


def test_line_dedup_counts_the_text_it_leaves(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    removed = {r["doc_id"]: r for r in line_dedup.dedup(docs).where("n_removed > 0").collect()}
    got = [r for r in c.line_dedup_stage(spark, docs, SF).collect() if r["doc_id"] in removed]
    assert got and all(r["n_chars"] == len(r["text"]) and r["text"] == removed[r["doc_id"]]["text"] for r in got)
