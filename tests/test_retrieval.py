"""Retrieval where readers see only part of the notes, duplicates, and the lexical index against a plain BM25."""

import math
import re

from pyspark.sql import functions as F

from inkgrove.operators import retrieval as R
from inkgrove.plans import retrieval_queries as Q
from inkgrove.plans import shared


def now():
    return F.lit("2024-06-01").cast("timestamp")


def corpus(spark):
    long = "the same long sentence about costs that several notes hold, word for word and line for line " * 2
    rows = [(i, f"n{i}", i % 5, "xyz"[i % 3] if i % 7 else None, (f"costs {'rent ' * (i % 4)}item{i}" if i % 3 else long), "2024-01-01", i, f"r{i % 5}-{i:012x}") for i in range(40)]
    b = spark.createDataFrame(rows, "id int, name string, ring int, bereich string, text string, updated string, idx int, citation string").withColumn("updated", F.to_timestamp("updated"))
    own = F.when(F.col("id") == 4, "n7").when(F.col("id") == 5, "unknown")
    n = b.select("id", "name", "ring", "bereich", "updated", F.to_timestamp(F.lit("2024-01-01")).alias("created"), F.lit(None).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("invalid_at"), own.alias("superseded_by"), F.array().cast("array<string>").alias("supersedes"))
    return b, n


def test_a_hidden_successor_is_not_named(spark):
    b, n = corpus(spark)
    index, every = R.build_index(b), R.RecallOptions(n=100)
    seen = {r.id: r for r in R.recall(index, b, n, "costs", now(), options=every).collect()}
    part = {r.id: r for r in R.recall(index, b, n, "costs", now(), visible=n.where("id <> 7").select("id"), options=every).collect()}
    assert seen[4].replaced_by == "n7" and seen[4].outdated and seen[5].replaced_by == "unknown"
    assert part[4].replaced_by is None and not part[4].outdated and part[4].demoted and 7 not in part
    assert part[5].replaced_by is None and part[5].demoted
    assert {r.caveat: r.n for r in R.caveats(R.recall(index, b, n, "costs", now(), visible=n.where("id <> 7").select("id"), options=every), R.recall(index, b, n, "costs", now(), visible=n.where("id <> 7").select("id"), options=every), 3).collect()} == {"successor-not-shown": 2, "blocks-without-vector": 3}


def test_a_hidden_note_leaves_no_trace(spark):
    b, n = corpus(spark)
    ids = n.where("id % 4 <> 1").select("id")
    got = R.recall(R.build_index(b), b, n, "costs", now(), visible=ids, options=R.RecallOptions(n=100, k_lexical=7)).collect()
    smaller = b.join(ids, "id", "left_semi")
    want = R.recall(R.build_index(smaller), smaller, n.join(ids, "id", "left_semi"), "costs", now(), options=R.RecallOptions(n=100, k_lexical=7)).collect()
    assert {r.citation for r in got} == {r.citation for r in want}


def test_scope_plan_reads_no_text_for_the_ranking(spark):
    b, _ = corpus(spark)
    plan = R.bm25(R.build_index(b), "costs", 5, R.admits(["x"]))._jdf.queryExecution().executedPlan().toString()
    assert "StringStartsWith(term,costs)" in plan and "text#" not in plan


def test_bm25_plain(spark):
    b, _ = corpus(spark)
    texts = {r.citation: [w for w in re.split(r"[^\w]+", r.text.lower()) if w] for r in b.collect()}
    mean = sum(map(len, texts.values())) / len(texts)
    score = dict.fromkeys(texts, 0.0)
    for term in ("rent", "item3"):
        tf = {c: sum(w.startswith(term) for w in ws) for c, ws in texts.items()}
        n = sum(x > 0 for x in tf.values())
        idf = max(math.log((len(texts) - n + 0.5) / (n + 0.5)), 1e-6)
        for c, x in tf.items():
            score[c] += idf * x * 2.2 / (x + 1.2 * (0.25 + 0.75 * len(texts[c]) / mean))
    want = sorted(((-s, c) for c, s in score.items() if s > 0))[:10]
    got = R.bm25(b, "rent item3", 10).collect()
    assert [r.citation for r in got] == [c for _, c in want] and all(abs(r.score + s) < 1e-9 for r, (s, _) in zip(got, want))


def test_duplicates_collapse_to_the_most_trusted(spark):
    b, _ = corpus(spark)
    out = R.collapse_duplicates(b.withColumn("score", F.col("id") * 1.0)).collect()
    many = next(r for r in out if r.copies > 1)
    assert many.copies == 14 and many.ring == 0 and many.id == 30 and many.score == 39.0 and len(out) == 27


def test_index_is_built_once_and_again_for_new_rows(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alpha beta", "en", "s", 10)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    first = Q.index_of(spark, str(tmp_path))
    assert Q.index_of(spark, str(tmp_path)) is first
    docs.union(docs).write.mode("append").parquet(str(tmp_path / "documents.parquet"))
    assert Q.index_of(spark, str(tmp_path)).rows == 3


def test_canary_pairs_beyond_the_broadcast(spark, monkeypatch, tmp_path):
    docs = [(1, "Before. A canary passage, number ONE! after"), (2, "a canary passage number two"), (3, None), (4, ""), (5, "A Canary\npassage number one; a canary passage number two")]
    spark.createDataFrame([(i, t, "en", "s", 0) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(10, "a canary passage number one"), (11, "A canary passage number two."), (12, "too short"), (13, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    want = {(10, 1), (11, 2), (10, 5), (11, 5)}
    assert {tuple(r) for r in Q.canary_pairs(spark, str(tmp_path)).collect()} == want
    for module, name, value in ((Q, "CANARY_BROADCAST", 0), (shared, "BROADCAST_BYTES", -1)):
        monkeypatch.setattr(module, name, value)
        assert {tuple(r) for r in Q.canary_pairs(spark, str(tmp_path)).collect()} == want
