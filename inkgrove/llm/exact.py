"""Exact deduplication with a heavy-hitter split.

Digests of the normalised texts are summarised by Misra-Gries counters, so every digest with more than
1 / (COUNTERS + 1) of the rows is a candidate. Candidates are counted exactly, and the winners of those
found heavy are broadcast (at most COUNTERS of them): their copies are removed map-side. The remaining
digests, none of which is heavy, are settled by an ordinary shuffle.
"""

from __future__ import annotations

import hashlib
import math
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.plans.shared import cut, tune_arrow

COUNTERS = 512


def misra_gries(items: Iterable[tuple[bytes, int]], counters: int = COUNTERS) -> dict[bytes, int]:
    """Weighted Misra-Gries: keeps every item with more than 1 / (counters + 1) of the weight.

    Also merges summaries, given as items. Runs up to twice the counters before it cuts back."""
    held: Counter[bytes] = Counter()
    for item, weight in items:
        held[item] += weight
        if len(held) > 2 * counters:
            held = _cut_back(held, counters)
    return dict(_cut_back(held, counters))


def _cut_back(held: Counter[bytes], counters: int) -> Counter[bytes]:
    if len(held) <= counters:
        return held
    level = sorted(held.values(), reverse=True)[counters]
    return Counter({k: v - level for k, v in held.items() if v > level})


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        bodies = batch.column("_ink_body").to_pylist()
        found = [hashlib.sha256((x or b"").lower()).digest() for x in bodies]  # bytes.lower() changes A-Z only
        names = [n for n in batch.schema.names if n != "_ink_body"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(found, pa.binary())], [*names, "_ink_digest"])


def with_digest(rows: DataFrame, text: str) -> DataFrame:
    """rows with _ink_digest: SHA-256 of the text in UTF-8 with A-Z lower-cased; a null text counts as empty."""
    tune_arrow(rows.sparkSession)
    shape = T.StructType([*rows.schema.fields, T.StructField("_ink_digest", T.BinaryType())])
    return rows.select("*", F.col(text).cast("binary").alias("_ink_body")).mapInArrow(_digests, shape)


def frequent_digests(digests: DataFrame) -> list[bytes]:
    """Candidates from Misra-Gries summaries of the partitions, merged in two levels; at most COUNTERS."""

    def summary(column: str, weight: str | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            items = ((k, n) for b in batches for k, n in zip(b.column(column).to_pylist(), b.column(weight).to_pylist() if weight else [1] * b.num_rows))
            held = misra_gries(items)
            yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["_ink_digest", "n"])

        return run

    shape = "_ink_digest binary, n bigint"
    first = digests.select("_ink_digest").mapInArrow(summary("_ink_digest", None), shape)
    merged = first.repartition(max(1, math.isqrt(digests.rdd.getNumPartitions()))).mapInArrow(summary("_ink_digest", "n"), shape)
    return list(misra_gries((bytes(r._ink_digest), r.n) for r in merged.toLocalIterator()))


def _placed_digests(docs: DataFrame, text: str, id_col: str) -> DataFrame:
    """(_ink_id, _ink_digest, _ink_place) of docs as a cut table; the place tells repeated rows apart."""
    rows = with_digest(docs.select(F.col(id_col).alias("_ink_id"), F.col(text).alias("_ink_text")), "_ink_text").drop("_ink_text")
    return cut(rows.withColumn("_ink_place", F.monotonically_increasing_id()), "digests")


def _winners(digests: DataFrame) -> DataFrame:
    """(_ink_digest, _ink_win, _ink_size) of the heavy digests, verified by exact counts; _ink_win is a struct of id and place."""
    spark = digests.sparkSession
    total = digests.count()
    candidates = spark.createDataFrame([(x,) for x in frequent_digests(digests)], "_ink_digest binary")
    win = F.max(F.struct("_ink_id", "_ink_place"))
    exact = digests.join(F.broadcast(candidates), "_ink_digest").groupBy("_ink_digest").agg(win.alias("_ink_win"), F.count("*").alias("_ink_size"))
    heavy = exact.where(F.col("_ink_size") > total / (COUNTERS + 1))
    return spark.createDataFrame(heavy.collect(), heavy.schema)  # at most COUNTERS rows


def duplicate_groups(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """One row per document: id_col, keep_id, group_size, kept, text_sha256 (hex).

    Of equal texts the row with the largest id stays, null ids counting as smallest; of rows that share
    that id one is kept. A null text counts as empty. Very long texts are hashed whole. An empty table gives an empty
    result; other columns are not read."""
    digests = _placed_digests(docs, text, id_col)
    marked = digests.join(F.broadcast(_winners(digests)), "_ink_digest", "left")
    heavy = marked.where("_ink_size is not null")
    group = Window.partitionBy("_ink_digest")
    rest = marked.where("_ink_size is null").withColumn("_ink_win", F.max(F.struct("_ink_id", "_ink_place")).over(group)).withColumn("_ink_size", F.count("*").over(group))
    kept = F.col("_ink_place") == F.col("_ink_win._ink_place")
    return heavy.unionByName(rest).select(
        F.col("_ink_id").alias(id_col), F.col("_ink_win._ink_id").alias("keep_id"), F.col("_ink_size").alias("group_size"), kept.alias("kept"), F.lower(F.hex("_ink_digest")).alias("text_sha256")
    )


def drop_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs without the rows that duplicate_groups() does not keep; columns stay as they are, whatever their names.

    Copies of heavy texts other than the winner go before the shuffle, and so do, in each task, all but one of rows
    alike in id and text; the text rides through one shuffle."""
    if docs.isEmpty():
        return docs
    winners = _winners(_placed_digests(docs, text, id_col))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_ink_row"), F.col(id_col).alias("_ink_id"), F.col(text).alias("_ink_text"))
    marked = with_digest(rows, "_ink_text").drop("_ink_text").join(F.broadcast(winners), "_ink_digest", "left")
    left = marked.where(F.col("_ink_size").isNull() | F.col("_ink_id").eqNullSafe(F.col("_ink_win._ink_id")))
    best = Window.partitionBy("_ink_digest").orderBy(F.col("_ink_id").desc_nulls_last())
    return left.withColumn("_ink_rank", F.row_number().over(best)).where("_ink_rank = 1").select("_ink_row.*")
