"""Sessions for local runs and tests; on a cluster the caller brings its own."""

from __future__ import annotations

from pyspark.sql import SparkSession


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, app: str = "inkgrove") -> SparkSession:
    """A session on this machine, in UTC, with adaptive execution."""
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )


#: Sizes between which a table of fewer files than there are cores is dealt out anew.
SMALL_BYTES, LARGE_BYTES = 1 << 20, 256 << 20
#: Tables of long texts, where one file in one task would leave the other cores idle.
TEXT_TABLES = ("documents", "pages", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the input tables, read lazily. A text table in few small files is dealt to all cores; larger ones are split by the scan itself."""
    path = f"{sf_dir}/{name}.parquet"
    rows = spark.read.parquet(path)
    if name not in TEXT_TABLES:
        return rows
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    held, cores = there.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(there), spark.sparkContext.defaultParallelism
    few = held.getFileCount() < cores and SMALL_BYTES <= held.getLength() <= LARGE_BYTES
    return rows.repartition(cores) if few else rows
