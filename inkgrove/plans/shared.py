"""Cut points in the shared folder, and joins whose strategy follows a measured size."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes in memory, as cut_bytes() estimates them, up to which a cut table is broadcast; beyond, the join shuffles.
BROADCAST_BYTES = 16 << 20
#: Rows up to which a counted table is broadcast; beyond, the join shuffles.
BROADCAST_ROWS = 100_000
#: A key with more than total / HOT_SHARE rows is hot; there are fewer than HOT_SHARE such keys.
HOT_SHARE = 1000
#: How much larger than on disk columns of no fixed width are in memory, about.
UNPACKED = 4

_scopes: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """The folder the cluster shares (spark.checkpoint.dir). Only on this machine alone is a local one used where none is set."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found
    there = spark.sparkContext._jsc.sc().getCheckpointDir()
    if there.isDefined():
        return there.get()
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"file:/tmp/checkpoints/{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder, which scratch() deletes."""
    path = f"{shared_root(spark)}/inkgrove/{label}-{uuid.uuid4().hex}"
    if _scopes:
        _scopes[-1].append(path)
    return path


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: lineage ends there,
    and a lost executor costs a reread, not a recomputation. scratch() deletes such tables."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.cut_path = path
    return out


def cut_bytes(df: DataFrame) -> int:
    """Bytes in memory, about, of a table made by cut(): its rows by the widths of its fixed columns, and the others by their size on disk."""
    fixed = sum(8 for f in df.schema.fields if isinstance(f.dataType, (T.NumericType, T.BooleanType, T.DateType, T.TimestampType)))
    on_disk = _status(df.sparkSession, df.cut_path).getLength()
    if on_disk > BROADCAST_BYTES or fixed == 8 * len(df.schema.fields):
        return max(on_disk, df.count() * (fixed + 8))
    return max(on_disk * UNPACKED, df.count() * (fixed + 8))


def _status(spark: SparkSession, path: str):
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    return jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(jvm_path)


def table_state(spark: SparkSession, files: list[str]) -> str:
    """A hash of the path, time and size of every file of a table: it changes with any of them. Folders are listed once."""
    folders = sorted({f.rsplit("/", 1)[0] for f in files})
    state, wanted = hashlib.sha256(), {f.rsplit("/", 1)[1] for f in files}
    for folder in folders:
        there = spark._jvm.org.apache.hadoop.fs.Path(folder)
        found = [(s.getPath().toString(), s.getModificationTime(), s.getLen()) for s in there.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(there) if s.isFile()]
        state.update(repr(sorted(x for x in found if x[0].rsplit("/", 1)[1] in wanted)).encode())
    return state.hexdigest()


def delete(spark: SparkSession, path: str) -> None:
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path, True)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that cut() writes inside, at the end: what still reads them must be written or collected by then."""
    _scopes.append([])
    try:
        yield
    finally:
        for path in _scopes.pop():
            delete(spark, path)


def join_sized(left: DataFrame, right: DataFrame, on: list[str] | Column, how: str = "left") -> DataFrame:
    """Join a cut table: broadcast if its measured size is small, else a shuffled hash join or
    sort-merge join as Spark sees fit, with adaptive splitting of skewed partitions."""
    return left.join(F.broadcast(right) if cut_bytes(right) <= BROADCAST_BYTES else right, on, how)


def join_back(left: DataFrame, per_key: DataFrame, keys: list[str], count: str, total: int) -> DataFrame:
    """Left join of per-key results onto rows, safe for hot keys.

    Keys with more than total / HOT_SHARE rows, fewer than HOT_SHARE of them, are broadcast and
    joined without a shuffle; the rest of the rows are shuffled by key, where no key holds more
    than that share. left and per_key should be cut tables, as both are read twice. Null keys
    match nothing."""
    bound = total / HOT_SHARE
    values = [c for c in per_key.columns if c not in keys]
    hot = F.broadcast(per_key.filter(F.col(count) > bound)).withColumn("_ink_hot", F.lit(True))
    found = left.join(hot, keys, "left")
    map_side = found.filter("_ink_hot").drop("_ink_hot")
    rest = found.filter("_ink_hot is null").drop("_ink_hot", *values)
    return map_side.unionByName(rest.join(per_key.filter(F.col(count) <= bound), keys, "left"))


def tune_arrow(spark: SparkSession) -> None:
    """Arrow batches small enough for very long texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(32 << 20))
