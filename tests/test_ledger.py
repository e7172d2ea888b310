"""Appends that race, deliveries that are replayed, sessions that end."""

import datetime as dt
import uuid

import pytest
from pyspark.sql import functions as F

from inkgrove.operators import audit as A
from inkgrove.operators import ledger as L
from inkgrove.plans import manifests
from inkgrove.plans.shared import shared_root
from inkgrove.streaming.sessions import session_states


@pytest.fixture
def root(spark):
    return f"{shared_root(spark)}/test-{uuid.uuid4().hex}"


def rows(spark, first, n, device="d"):
    return spark.range(first, first + n).select(F.lit(device).alias("device"), F.col("id").alias("seq"), F.lit("a").alias("actor"), F.lit("x").alias("action"), F.lit(None).cast("string").alias("subject"), F.concat(F.lit("n"), "id").alias("detail"))


def whole(spark, root):
    return {r.device: (r.rows, r.first_break) for r in A.verify_chain(L.read(spark, root)).collect()}


def test_two_writers_and_both_chains_whole(spark, root, monkeypatch):
    assert L.append_chained(root, rows(spark, 1, 5)) == 1
    publish, raced = manifests.publish, []

    def slower(spark_, root_, number, body):  # another writer is faster, twice
        if len(raced) < 2:
            raced.append(number)
            monkeypatch.setattr(manifests, "publish", publish)
            L.append_chained(root, rows(spark, 1, 3, "d" if len(raced) == 1 else "e"))
            monkeypatch.setattr(manifests, "publish", slower)
        return publish(spark_, root_, number, body)

    monkeypatch.setattr(manifests, "publish", slower)
    assert L.append_chained(root, rows(spark, 50, 4).union(rows(spark, 1, 2, "f"))) == 4 and raced == [2, 3]
    assert whole(spark, root) == {"d": (12, None), "e": (3, None), "f": (2, None)}
    log = L.read(spark, root)
    assert sorted(r.seq for r in log.where("device = 'd'").collect()) == list(range(1, 13))
    assert {r.device: r.seq for r in L.heads(spark, root).collect()} == {"d": 12, "e": 3, "f": 2}
    assert L.append_chained(root, rows(spark, 1, 0)) == 4


def test_a_writer_that_always_loses_leaves_nothing(spark, root, monkeypatch):
    L.append_chained(root, rows(spark, 1, 2))
    monkeypatch.setattr(manifests, "publish", lambda *_: False)
    with pytest.raises(manifests.Refused):
        L.append_chained(root, rows(spark, 1, 2), retries=1)
    assert whole(spark, root) == {"d": (2, None)}


def test_a_replayed_batch_changes_nothing(spark, root):
    sealed = A.seal(rows(spark, 1, 30).union(rows(spark, 1, 20, "e")))
    take = L.deliver(root, "hub")
    take(sealed.where("seq <= 10"), 0)
    take(sealed.where("seq <= 10"), 0)
    assert whole(spark, root) == {"d": (10, None), "e": (10, None)}
    edited = sealed.where("seq > 10").withColumn("detail", F.when((F.col("device") == "d") & (F.col("seq") == 15), "other").otherwise(F.col("detail")))
    take(edited, 1)
    take(edited, 1)
    assert whole(spark, root) == {"d": (14, None), "e": (20, None)}
    refused = spark.read.parquet(f"{root}/refused/hub").collect()
    assert sorted((r.device, r.seq, r.reason) for r in refused)[:2] == [("d", 15, "hash does not match"), ("d", 16, "follows a refused row")] and len(refused) == 16
    take(sealed.where("device = 'd' and seq > 14"), 2)  # sent again, right this time
    take(sealed.where("device = 'd' and seq > 20"), 3)  # sent twice: does not continue the chain any more
    assert whole(spark, root) == {"d": (30, None), "e": (20, None)} and spark.read.parquet(f"{root}/refused/hub/batch=3").count() == 10


def test_deliveries_by_a_stream(spark, root, tmp_path):
    sealed = A.seal(rows(spark, 1, 40)).coalesce(1).sortWithinPartitions("seq")
    for low in (1, 21):
        sealed.where(f"seq between {low} and {low + 19}").write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sealed.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    run = lambda where: stream.writeStream.foreachBatch(L.deliver(root, "s")).option("checkpointLocation", str(tmp_path / where)).trigger(availableNow=True).start().awaitTermination()
    run("c1")
    assert whole(spark, root) == {"d": (40, None)}
    run("c2")  # a lost checkpoint replays both batches under their old numbers
    assert whole(spark, root) == {"d": (40, None)}


def test_session_states_end(spark, tmp_path):
    day = lambda n, hour=0: dt.datetime(2024, 1, 1, hour) + dt.timedelta(days=n)
    batches = [[("a", day(0), "s1"), ("a", day(0, 2), "s2"), ("b", day(1), "t1")], [("a", day(20), "s3"), ("b", day(0), "late")], [("c", day(40), "u1")], [("c", day(41), "u2"), ("a", day(20), "zz")]]
    for i, found in enumerate(batches):
        spark.createDataFrame(found, "session string, at timestamp, state string").coalesce(1).write.parquet(str(tmp_path / "w" / str(i)))
        (tmp_path / "in").mkdir(exist_ok=True)
        next((tmp_path / "w" / str(i)).glob("part*")).rename(tmp_path / "in" / f"{i}.parquet")
    stream = spark.readStream.schema("session string, at timestamp, state string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    was = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    try:
        session_states(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", was)
    out = [(r.session, r.state, r.ended) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("at", "state").collect()]
    assert ("b", "t1", True) in out and ("a", "s3", False) in out and ("c", "u2", False) in out
    assert not any(s == "late" or e and n in ("a", "c") for n, s, e in out)
    # Which sessions are live in the end: as the batch operator keeps them.
    last = {n: (s, e) for n, s, e in out}
    assert {n for n, (_, e) in last.items() if not e} == {"a", "c"} and last["c"][0] == "u2"
