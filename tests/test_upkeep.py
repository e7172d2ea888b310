"""Lookups, replacing and deleting notes, the embedder, appends, bundles and reports on small tables."""

import math
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from inkgrove.operators import audit as A
from inkgrove.operators import embedding as E
from inkgrove.operators import fleet as L
from inkgrove.operators import index as I
from inkgrove.operators import ingest as G
from inkgrove.operators import notes as N
from inkgrove.functions import scalars as S
from inkgrove.operators import usage as U
from inkgrove.plans.catalogue import ORACLES, QUERIES
from inkgrove.plans.shared import cut
from inkgrove.sources import readers as R
from tests.oracle import SF, same


def log(spark, n=30, devices=2):
    return spark.range(1, n + 1).select(F.col("id").alias("seq"), F.concat(F.lit("d"), F.col("id") % devices).alias("device"), F.lit("a").alias("actor"), F.lit("x").alias("action"), F.lit(None).cast("string").alias("subject"), F.lit("{}").alias("detail"))


def test_embedder_means_and_unknown_words(spark):
    vocabulary = cut(spark.createDataFrame([("alpha", [1.0, 0.0]), ("beta", [0.0, 1.0])], "term string, vector array<float>"), "v")
    texts = spark.createDataFrame([(1, "Alpha alpha BETA unknown"), (2, "nothing here"), (3, None), (4, "")], "id int, text string")
    out = {r.id: r for r in E.embed(texts, vocabulary, 2).collect()}
    assert out[1].known == 3 and all(abs(x - y) < 1e-12 for x, y in zip(out[1].vector, (2 / math.sqrt(5), 1 / math.sqrt(5))))
    assert all(out[i].vector == [0.0, 0.0] and out[i].known == 0 for i in (2, 3, 4))


def test_profiles_are_not_mixed(spark):
    v = spark.createDataFrame([("c1", "p"), ("c2", "q"), ("c3", None)], "citation string, profile string")
    good, others = E.usable(v, "p")
    assert [r.citation for r in good.collect()] == ["c1"] and others.first()[:] == (1, 1)
    blocks = spark.createDataFrame([("c1",), ("c2",), ("c9",)], "citation string")
    assert {r.citation for r in E.needs_vectors(blocks, v, "p").collect()} == {"c2", "c9"} and E.profile_id("m", 2) != E.profile_id("m", 3)


def tables(spark):
    return {
        "notes": spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string"), "blocks": spark.createDataFrame([(1, 0), (1, 1), (2, 0)], "id int, idx int"),
        "links": spark.createDataFrame([(1, "b"), (2, "a"), (2, "lost")], "from_id int, to_name string"), "vectors": spark.createDataFrame([(1,), (2,)], "id int"),
    }


def test_replacing_a_note_replaces_what_is_derived_and_renames_links(spark):
    held = tables(spark)
    out = N.replace(held, {"notes": spark.createDataFrame([(1, "a2"), (3, "c")], "id int, name string"), "blocks": spark.createDataFrame([(1, 0)], "id int, idx int"), "links": held["links"].limit(0)})
    rows = lambda k: sorted(map(tuple, out[k].collect()))
    assert rows("notes") == [(1, "a2"), (2, "b"), (3, "c")] and rows("blocks") == [(1, 0), (2, 0)] and rows("links") == [(2, "a2"), (2, "lost")] and rows("vectors") == [(2,)]


def test_deleting(spark):
    out, counts = N.delete(tables(spark), spark.createDataFrame([(2,), (2,), (9,)], "id int"))
    assert {r.kind: r.removed for r in counts.collect()} == {"notes": 1, "blocks": 1, "links": 2, "vectors": 1} and out["blocks"].count() == 2


def test_what_must_not_be_written(spark):
    notes = spark.createDataFrame([(1, "good", 2), (2, "Bad Name", 2), (3, "fine", 7)], "id int, name string, ring int")
    blocks = spark.createDataFrame([(1, 0), (1, 1), (2, 0), (2, 2)], "id int, idx int")
    vectors = spark.createDataFrame([(3, [1.0])], "id int, vector array<double>")
    assert {tuple(r) for r in N.problems(notes, blocks, 2, vectors).collect()} == {(2, "name characters"), (3, "ring"), (2, "places"), (3, "dimensions")}


def test_empty_selection_names_what_there_is(spark):
    rows = log(spark)
    with pytest.raises(N.NothingSelected, match="there are: x"):
        N.selected(rows, rows.where("action = 'y'"))
    assert N.selected(rows, rows).count() == 30 and N.selected(rows.limit(0), rows.limit(0)).count() == 0


def test_anchored_definitions(spark):
    symbols = spark.createDataFrame([("a.rs", 5, 9), ("a.rs", 20, 22)], "path string, line int, end_line int")
    anchors = spark.createDataFrame([(1, "a.rs", 9, 12), (2, "b.rs", 5, 9)], "id int, path string, first int, last int")
    assert [(r.line, r.note_id) for r in N.anchored(symbols, anchors).collect()] == [(5, 1)]


def test_append_continues_the_head_or_is_refused(spark):
    sealed = cut(A.seal(log(spark)), "sealed")
    rows = log(spark, 4).withColumn("seq", F.col("seq") + 100)
    after, refused = A.append(sealed, rows)
    assert after.count() == 34 and refused.count() == 0 and all(r.first_break is None for r in A.verify_chain(after).collect())
    moved = A.unsealed_heads(sealed).withColumn("hash", F.when(F.col("device") == "d1", "old").otherwise(F.col("hash")))
    after, refused = A.append(sealed, rows, moved)
    assert after.count() == 32 and {r.device for r in refused.collect()} == {"d1"}
    assert A.append(sealed.limit(0), rows)[0].count() == 4


def test_bundles_are_verified(spark, monkeypatch):
    monkeypatch.setattr(A, "DIGEST_RANGE", 3)  # several levels
    lines = cut(A.export_lines(A.seal(log(spark))), "bundle")
    assert A.verify_bundle(lines).first().whole
    wrong = {
        "row": lines.withColumn("value", F.replace("value", F.lit('"seq":7,'), F.lit('"seq":8,'))), "lost": lines.where(~F.contains("value", F.lit('"seq":7,'))), "garbage": lines.union(spark.createDataFrame([("{broken",)], "value string")),
        "version": lines.withColumn("value", F.replace("value", F.lit('"format":1'), F.lit('"format":2'))), "footer": lines.where("value not like '%digest%'"),
    }
    assert {k: A.verify_bundle(v).first().whole for k, v in wrong.items()} == dict.fromkeys(wrong, False)


def test_copies_and_gaps(spark):
    sealed = cut(A.seal(log(spark)), "sealed")
    assert all(r.ok for r in L.verify_copy(sealed, sealed).collect())
    assert {r.device: r.ok for r in L.verify_copy(sealed, sealed.where("seq <> 9")).collect()} == {"d0": True, "d1": False}
    assert [(r.seq, r.state) for r in A.continues(sealed.where("seq <> 9")).collect()] == [(11, "gap")]


def test_shared_blocks_of_notes_that_share_one_line(spark):
    line = "one line of the licence that every note of this corpus repeats in the same words as all the others do"
    own = lambda i, k: f"sentence {k} of note number {i} that is in no other note and is long enough to count as a block here"
    rows = [(f"n{i:03}", t) for i in range(60) for t in (line, own(i, 1), own(i, 2))] + [("tiny1", line), ("twin", line), ("pair1", own(1, 1)), ("pair1", own(1, 2))]
    out = {(r.a, r.b): (r.shared, r.smaller) for r in I.shared_blocks(spark.createDataFrame(rows, "name string, text string")).collect()}
    want = {(f"n{i:03}", "tiny1"): (1, 1) for i in range(60)} | {("tiny1", "twin"): (1, 1), ("n001", "pair1"): (2, 2)}
    assert out == want


def test_collisions_of_one_hot_name(spark):
    rows = [("same", f"p{i:03}", "body") for i in range(50)] + [("two", "q1", "x"), ("two", "q2", "y"), ("one", "r", "z")]
    out = {r.path: (r.outcome, r.final_name) for r in G.resolve_collisions(spark.createDataFrame(rows, "name string, path string, body string")).collect()}
    assert out["p000"] == ("written", "same") and out["p049"] == ("duplicate", "same") and out["q1"] == ("collided", None) and out["r"] == ("written", "one")
    hashed = {r.path: r.final_name for r in G.resolve_collisions(spark.createDataFrame(rows, "name string, path string, body string"), "hash").collect()}
    assert hashed["q1"] != hashed["q2"] and hashed["q1"].startswith("two-")


def test_pages_tell_what_there_is(spark):
    rows = A.page(log(spark), 10, before=21).collect()
    assert [r.seq for r in rows] == list(range(20, 10, -1)) and rows[0].total == 20 and rows[0].more
    assert not A.page(log(spark), 50).first().more


def test_signed_text_must_be_the_present_one(spark):
    notes = spark.createDataFrame([("a", "h1"), ("b", "h2")], "name string, body_hash string")
    told = spark.createDataFrame([("a", "u", "h1"), ("b", "u", "old")], "subject string, actor string, body_hash string")
    assert [(r.name, r.signed_by) for r in A.signed(notes, told).collect()] == [("a", "u")]


def test_occurrences_with_places(spark):
    df = spark.createDataFrame([("An(n) ANN, annä xann ann",), ("none",), (None,), ("ann",)], "t string")
    out = [r[0] and [tuple(x) for x in r[0]] for r in df.select(S.occurrence_spans(F.col("t"), "ann")).collect()]
    assert out == [[(6, 9, True), (11, 14, False), (17, 20, False), (21, 24, True)], [], [], [(0, 3, True)]]
    cited = spark.createDataFrame([("r1-0123456789ab then r2-0123456789ab and r1-0123456789ab",)], "t string")
    assert cited.select(S.mentions_newest(F.col("t"))).first()[0] == ["r1-0123456789ab", "r2-0123456789ab"]


def test_tags_hashes_and_places(spark):
    tags = spark.createDataFrame([(1, ["trust:trusted", "trust:untrusted"]), (2, ["trust:maybe"]), (3, ["src::"]), (4, ["src:mail", "x"]), (5, [])], "i int, tags array<string>")
    assert [r[0] for r in tags.orderBy("i").select(S.tag_problem(F.col("tags"))).collect()] == ["both-trusts", "unknown-trust", "no-source", None, None]
    assert [r[0] for r in tags.orderBy("i").select(S.stamp_untrusted(F.col("tags"), F.lit("c"))).collect()][3:] == [["src:mail", "x", "trust:untrusted"], ["trust:untrusted", "src:c"]]
    hashes = spark.createDataFrame([("a",), ("a",), ("b",)], "t string").select(S.short_hash(F.col("t")).alias("h")).collect()
    assert hashes[0] == hashes[1] != hashes[2] and len(hashes[0].h) == 8
    parts = spark.createDataFrame([(" p 1 ", "x"), ("a\nb", "x"), ("a --> b", "x"), (None, "x")], "p string, t string").select(S.located_part(F.col("p"), F.col("t")).alias("b"))
    assert [r.b for r in parts.collect()] == ["<!-- at: p 1 -->\nx", "x", "x", "x"]


def test_usage_with_damaged_lines(spark):
    rows = spark.createDataFrame([("recall", "2024-01-02", 1, 2, 3, None), ("recall", "2024-01-01", 4, 5, 6, None), (None, None, None, None, None, "{broken")], "op string, at string, returned int, full int, hits int, _corrupt string")
    assert {r.op: r[1:] for r in U.summary(rows).collect()} == {"recall": (2, 5, 7, 9, "2024-01-01", 0), None: (0, None, None, None, None, 1)}


def test_source_walk_keeps_to_ignore_rules(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(R, "MAX_FILE_BYTES", 100)
    for name, text in {"a.py": "x = 1", "target/b.py": "y", "deep/target/c.py": "z", "docs/keep.log": "k", "docs/no.log": "n", "big.txt": "b" * 500, "Cargo.lock": "l", "bin.dat": "\0"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    rules = ["# comment", "target/", "*.log", "!docs/keep.log"]
    out = {r.path.split(str(tmp_path) + "/")[1]: (r.skipped, r.content) for r in R.source_files(spark, str(tmp_path), rules).collect()}
    assert {k: v[0] for k, v in out.items()} == {"a.py": None, "target/b.py": "ignored", "deep/target/c.py": "ignored", "docs/keep.log": None, "docs/no.log": "ignored", "big.txt": "too large", "Cargo.lock": "lock file", "bin.dat": "binary"}
    assert out["a.py"][1] == "x = 1" and out["big.txt"][1] is None and R.counted_apart(spark, str(tmp_path)) == len(out)


def test_numbered_embedder_adds_up_in_slices(spark, monkeypatch):
    """Vectors in many slices, texts in many chunks: as every token's vector looked up one by one, with repeated, short and missing vectors and repeated, null and empty texts."""
    vectors = [(i, [float(i), 1.0 - i]) for i in range(40)] + [(7, [0.5, 0.25]), (8, None), (9, [3.0]), (None, [9.0, 9.0])]
    texts = [(i, " ".join(f"w{(i * k) % 60}" for k in range(i % 25))) for i in range(90)] + [(3, "w7 w9"), (None, "w1"), (100, None), (101, ""), (102, "w55"), (103, "w8"), (104, "w7 W7, w7")]
    want = {}
    for i, text in texts:
        total = want.setdefault(i, [0, 0.0, 0.0])
        for word in (text or "").replace(",", "").lower().split():
            for number, v in vectors if i is not None else []:
                if number == int(word[1:]):
                    total[0], total[1], total[2] = total[0] + 1, total[1] + (v[0] if v else 0), total[2] + (v[1] if v and len(v) > 1 else 0)
    held, table = spark.createDataFrame(texts, "id int, text string"), spark.createDataFrame(vectors, "vec_id long, vector array<float>")
    for slice_bytes, chars in ((64 << 20, 96_000_000), (80, 40)):
        monkeypatch.setattr(E, "SLICE_BYTES", slice_bytes)
        monkeypatch.setattr(E, "SLICE_CHARS", chars)
        out = E.embed_numbered(held, table, 2, lambda words: [int(w[1:]) for w in words]).collect()
        assert sorted(str(r.id) for r in out) == sorted(str(i) for i, _ in texts)
        for r in out:
            known, a, b = want[r.id]
            size = math.hypot(a, b)
            assert r.known == known and all(abs(x - (y / size if size else 0.0)) < 1e-9 for x, y in zip(r.vector, (a, b)))


def test_embed_documents_keeps_no_table_of_tokens(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(E, "cut", lambda df, label: kept.append(label) or cut(df, label))
    out = QUERIES["embed_documents"](spark, SF)
    assert kept == [] and out.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_doctor_counts_names_as_its_sql(spark, tmp_path):
    """Names of Latin letters with accents are no problem; capitals among these, a line end and an empty name are."""
    for path in Path(SF).glob("*.parquet"):
        if path.name != "documents.parquet":
            (tmp_path / path.name).symlink_to(path)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, text in enumerate(("enenréoution and more", "ÉNENRéoution and more", "elevensigns\nand more", "a-b-\u00df-d-\u017c-f and", "", "has space and more")):
        docs = docs.withColumn("text", F.when(F.col("doc_id") == i, F.lit(text)).otherwise(F.col("text")))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    same(spark, QUERIES["doctor_all"], ORACLES["doctor_all"], str(tmp_path))
    names = spark.createDataFrame([("für",), ("FÜR",), ("für\n",), ("",)], "name string")
    assert [r[0] for r in names.select(S.name_problem(F.col("name"))).collect()] == [None, "characters", "characters", "empty"]
