"""An append-only log in a shared folder: chained rows, published by numbered manifests.

A manifest names the log's parts, the last row of each device's chain, and the last batch of each delivering stream. Rows, heads and batch numbers become
visible together, so a writer that lost a race seals its rows again after the new heads, and a batch that is replayed after a
failure changes nothing."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.operators.audit import preceded, row_hash, seal_after
from inkgrove.plans import manifests


def read(spark: SparkSession, root: str, body: dict | None = None) -> DataFrame | None:
    """All rows of the log; None if there are none yet."""
    parts = (manifests.latest(spark, root)[1] if body is None else body).get("parts", [])
    return spark.read.parquet(*parts) if parts else None


def heads(spark: SparkSession, root: str, body: dict | None = None) -> DataFrame | None:
    """(device, seq, hash) of each chain's last row."""
    path = (manifests.latest(spark, root)[1] if body is None else body).get("heads")
    return spark.read.parquet(path) if path else None


def _write(df: DataFrame, root: str, what: str) -> tuple[DataFrame, str]:
    path = f"{root}/{what}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def _moved(old: DataFrame | None, part: DataFrame) -> DataFrame:
    """The heads after a part."""
    new = part.groupBy("device").agg(F.max(F.struct("seq", "hash")).alias("h")).select("device", "h.seq", "h.hash")
    return new if old is None else old.join(new.select("device"), "device", "left_anti").unionByName(new)


def append_chained(root: str, rows: DataFrame, retries: int = manifests.RETRIES) -> int:
    """Seal rows (device, seq, actor, action, subject, detail) after the log's heads and publish them; the number of the manifest.

    seq only orders the rows of a device; numbers continue the chain's. Where another writer was faster, the rows are sealed after what it wrote, retries times at
    most; then manifests.Refused is raised and nothing of them is visible. An empty table changes nothing."""
    spark = rows.sparkSession
    held, _ = _write(rows, root, "offered")
    if held.isEmpty():
        return manifests.latest(spark, root)[0]

    def attempt(number: int, body: dict) -> dict:
        last = heads(spark, root, body)
        part, path = _write(seal_after(held, last), root, "parts")
        _, head = _write(_moved(last, part), root, "heads")
        return {**body, "parts": body.get("parts", []) + [path], "heads": head}

    return manifests.commit(spark, root, attempt, retries)


def deliver(root: str, stream: str) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: take over sealed rows (device, seq, actor, action, subject, detail, prev, hash) of a stream that continue their device's chain.

    Of each device the rows up to the first that does not follow the chain, or whose hash is wrong, are taken; the others are written to root/refused
    with the reason. The batch's number is published with the rows: a batch that was taken before is passed over."""

    def batch(rows: DataFrame, number: int) -> None:
        spark = rows.sparkSession

        def attempt(_: int, body: dict) -> dict | None:
            if body.get("batches", {}).get(stream, -1) >= number:
                return None
            last = heads(spark, root, body)
            anchored = preceded(rows, "hash")
            if last is not None:
                anchored = anchored.join(last.select("device", F.col("hash").alias("_anchor")), "device", "left").withColumn("_before", F.when(F.col("_first"), F.col("_anchor")).otherwise(F.col("_before")))
            wrong = F.when(~F.col("prev").eqNullSafe(F.col("_before")), "does not continue the chain").when(~row_hash(F.col("prev")).eqNullSafe(F.col("hash")), "hash does not match")
            judged, _path = _write(anchored.withColumn("_wrong", wrong).select(*rows.columns, "_wrong"), root, "judged")
            breaks = judged.where("_wrong is not null").groupBy("device").agg(F.min("seq").alias("_break"))
            split = judged.join(breaks, "device", "left")
            taken = F.col("_break").isNull() | (F.col("seq") < F.col("_break"))
            part, path = _write(split.where(taken).select(*rows.columns), root, "parts")
            split.where(~taken).select(*rows.columns, F.coalesce("_wrong", F.lit("follows a refused row")).alias("reason"), F.lit(number).alias("batch")).write.mode("overwrite").parquet(f"{root}/refused/{stream}/batch={number}")
            _, head = _write(_moved(last, part), root, "heads")
            return {**body, "parts": body.get("parts", []) + [path], "heads": head, "batches": {**body.get("batches", {}), stream: number}}

        manifests.commit(spark, root, attempt)

    return batch
