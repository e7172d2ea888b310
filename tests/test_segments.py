"""An index that grows by segments ranks as one built anew; manifests have one writer each."""

import uuid

import pytest
from pyspark.sql import functions as F

from inkgrove.operators import retrieval as R
from inkgrove.operators import segments as SEG
from inkgrove.plans import manifests
from inkgrove.plans.shared import scratch, shared_root


def blocks(spark, texts):
    rows = [(i, t, f"c{i}-{k}", k, i % 3, "x") for i, t in texts.items() for k, t in enumerate(t.split("\n"))]
    return spark.createDataFrame(rows, "id long, text string, citation string, idx int, ring int, bereich string")


def ids(spark, found):
    return spark.createDataFrame([(i,) for i in found], "id long")


def ranking(index, query="alpha beta gamma"):
    return [(r.citation, round(r.score, 9)) for r in R.bm25(index, query).collect()]


@pytest.fixture
def root(spark):
    return f"{shared_root(spark)}/test-{uuid.uuid4().hex}"


def same_as_anew(spark, root, texts):
    index, anew = SEG.open_index(spark, root), R.build_index(blocks(spark, texts))
    assert (index.rows, round(index.mean, 9)) == (anew.rows, round(anew.mean, 9))
    assert ranking(index) == ranking(anew) and ranking(index, "beta") == ranking(anew, "beta")
    assert index.places.count() == anew.places.count() and set(anew.places.columns) == set(index.places.columns)


def test_upserts_deletes_and_compaction(spark, root):
    texts = {i: f"alpha {'beta ' * (i % 4)}\ngamma {i} delta" for i in range(30)}
    SEG.upsert(root, blocks(spark, texts), ids(spark, []))
    same_as_anew(spark, root, texts)
    for step in range(3):
        change = {i: f"beta {step} alpha alpha" for i in (step, 7, 100 + step)}
        assert SEG.upsert(root, blocks(spark, change), ids(spark, [*change, 20 + step, 20 + step, 999])) == step + 2
        texts = {i: t for i, t in (texts | change).items() if i != 20 + step}
        same_as_anew(spark, root, texts)
    before = SEG.open_index(spark, root)
    assert SEG.compact(spark, root) == 5 and SEG.compact(spark, root) == 5
    body = manifests.latest(spark, root)[1]
    assert len(body["segments"]) == 1 and body["gone"] == []
    same_as_anew(spark, root, texts)
    assert ranking(before) == ranking(SEG.open_index(spark, root)) and before.generation == 4  # readers of the older generation are not disturbed


def test_refresh_indexes_only_what_changed(spark, root):
    texts = {i: f"alpha {i}\nbeta" for i in range(10)}
    state = lambda t: blocks(spark, t).groupBy("id").agg(F.sha2(F.array_join(F.sort_array(F.collect_list("text")), "|"), 256).alias("hash"))
    SEG.refresh(root, state(texts), blocks(spark, texts))
    texts = {i: t for i, t in texts.items() if i != 3} | {4: "gamma alpha", 11: "beta beta"}
    SEG.refresh(root, state(texts), blocks(spark, texts), {"source": "x"})
    body = manifests.latest(spark, root)[1]
    assert [s["rows"] for s in body["segments"]] == [20, 2] and body["mark"]["source"] == "x"
    same_as_anew(spark, root, texts)
    SEG.refresh(root, state(texts), blocks(spark, texts))
    assert manifests.latest(spark, root)[1]["segments"][-1]["rows"] == 0


def test_compaction_is_due():
    many = {"segments": [{"rows": 1}] * 17, "rows": 17}
    assert SEG.compaction_due(many) and SEG.compaction_due({"segments": [{"rows": 10}], "rows": 6}) and not SEG.compaction_due({"segments": [{"rows": 10}], "rows": 8}) and not SEG.compaction_due({})


def test_a_number_is_published_once(spark, root):
    assert manifests.latest(spark, root) == (0, {})
    assert manifests.publish(spark, root, 1, {"a": 1}) and not manifests.publish(spark, root, 1, {"a": 2})
    assert manifests.latest(spark, root) == (1, {"a": 1})


def test_losers_try_again_and_fail_closed(spark, root):
    seen = []

    def raced(number, body):
        seen.append(number)
        if len(seen) < 4:
            manifests.publish(spark, root, number + 1, {"other": number})
        return {**body, "mine": True}

    assert manifests.commit(spark, root, raced) == 4 and seen == [0, 1, 2, 3] and manifests.latest(spark, root)[1]["mine"]
    with pytest.raises(manifests.Refused):
        manifests.commit(spark, root, lambda n, b: manifests.publish(spark, root, n + 1, {"other": n}) and {"lost": True}, retries=2)
    assert "lost" not in manifests.latest(spark, root)[1]


def test_the_query_index_survives_scratch_and_follows_the_table(spark, tmp_path):
    from inkgrove.plans.retrieval_queries import index_of
    from tests.oracle import SF

    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(60).coalesce(1)
    for i in range(3):
        docs.where(f"doc_id % 3 = {i}").write.parquet(str(tmp_path / f"w{i}"))
        next((tmp_path / f"w{i}").glob("part*")).rename((tmp_path / "documents.parquet" / f"part-{i}.parquet") if (tmp_path / "documents.parquet").mkdir(exist_ok=True) is None else None)
    with scratch(spark):
        first = index_of(spark, str(tmp_path))
    assert ranking(first, "the") and index_of(spark, str(tmp_path)).generation == first.generation
    middle = docs.where("doc_id % 3 = 1").withColumn("text", F.lit("Licensed words\nnew"))
    middle.write.parquet(str(tmp_path / "again"))
    next((tmp_path / "again").glob("part*")).replace(tmp_path / "documents.parquet" / "part-1.parquet")
    spark.catalog.refreshByPath(str(tmp_path / "documents.parquet"))
    second = index_of(spark, str(tmp_path))
    assert second.generation > first.generation and any(r.id % 3 == 1 for r in R.bm25(second, "Licensed").collect())


def test_a_segment_takes_less_than_its_texts(spark, root):
    """A posting repeats nothing of its block's place: words and places together take less disk than the table of texts."""
    from inkgrove.plans.shared import _status
    from inkgrove.sources import corpus
    from tests.oracle import SF

    held = corpus.blocks(spark, SF)
    SEG.upsert(root, held, held.select("id").limit(0))
    assert _status(spark, f"{root}/segments").getLength() < _status(spark, f"{SF}/documents.parquet").getLength()


def test_postings_name_their_segment_and_compaction_keeps_it(spark, root):
    """Blocks have the same numbers in every segment; equal rows are ranked one by one."""
    SEG.upsert(root, blocks(spark, {1: "alpha", 2: "beta beta"}), ids(spark, []))
    SEG.upsert(root, blocks(spark, {3: "beta", 4: "alpha alpha"}), ids(spark, [2]))
    same_as_anew(spark, root, {1: "alpha", 3: "beta", 4: "alpha alpha"})
    SEG.compact(spark, root)
    same_as_anew(spark, root, {1: "alpha", 3: "beta", 4: "alpha alpha"})
    twice = blocks(spark, {1: "alpha", 2: "gamma delta"})
    index = R.build_index(twice.union(twice))
    found = R.bm25(index, "alpha").collect()
    assert index.rows == 4 and [r.citation for r in found] == ["c1-0", "c1-0"] and found[0].score == found[1].score
