"""Line deduplication across documents, in DataFrame functions only.

Each long line becomes a row (two 64-bit hashes of its key, document, position). Rows are dealt out by
ranges of the hash and sorted by hash, document (largest first) and position, so one pass over the sorted rows sees each
key's first occurrence, the one that stays, followed by the others. Dropped positions return as compressed
bitmaps (non-zero 64-bit words only), and only those are joined back to the documents. Keys that alone
would fill a task's share of the lines are found by a frequent-items sketch, counted with
map-side aggregation and settled by a broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrove.plans.shared import cut, join_sized

MIN_CHARS, MIN_DOCUMENTS = 40, 5
#: Counters of the sketch, which finds every key with more than 1 / COUNTERS of the lines; there are fewer than COUNTERS of these.
COUNTERS = 10_000
_BLANK = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    """The line without blanks at its ends, A-Z lower-cased. lower() does the same, and faster, where no
    other letter has a lower case; translate() is for the rest."""
    bare = F.btrim(line, F.lit(_BLANK))
    ascii_only = F.octet_length(bare) == F.length(bare)
    other = bare.rlike(r"[\p{IsUppercase}\p{Lt}&&[^\x00-\x7F]]")
    return F.when(ascii_only | ~other, F.lower(bare)).otherwise(F.translate(bare, _UPPER, _LOWER))


def long_lines(rows: DataFrame) -> DataFrame:
    """(h1, h2, id, row, pos) of the lines with keys of MIN_CHARS at least. row tells documents with one id apart."""
    lines = rows.select("_ink_id", F.xxhash64("_ink_text").alias("row"), F.posexplode(F.split("_ink_text", "\n")).alias("pos", "line"))
    keyed = lines.where(F.length("line") >= MIN_CHARS).withColumn("key", line_key(F.col("line"))).where(F.length("key") >= MIN_CHARS)
    return keyed.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"), F.col("_ink_id").alias("id"), "row", "pos")


def hot_hashes(lines: DataFrame) -> list[int]:
    """First hashes of the keys with more lines than a task's even share; fewer than COUNTERS."""
    tasks = int(lines.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    bound = lines.count() / min(COUNTERS, tasks)
    frequent = lines.agg(F.expr(f"approx_top_k(h1, {COUNTERS}, {COUNTERS})").alias("k")).select(F.explode("k").alias("k")).select("k.*")
    return [r[0] for r in frequent.where(F.col("count") > bound).select("item").collect()]


def dropped_of_hot(hot: DataFrame) -> DataFrame:
    """(id, row, pos) of the lines to drop, for few keys of any number of lines: per-document and per-key counts combine map-side."""
    in_document = hot.groupBy("h1", "h2", "id", "row").agg(F.lit(1).alias("one"))
    verdict = in_document.groupBy("h1", "h2").agg(F.count("*").alias("documents"), F.max("id").alias("last")).where(F.col("documents") >= MIN_DOCUMENTS)
    return hot.join(F.broadcast(verdict), ["h1", "h2"]).where(~F.col("id").eqNullSafe(F.col("last"))).select("id", "row", "pos")  # fewer than COUNTERS verdicts, but for hashes that clash


def dropped_in_ranges(lines: DataFrame) -> DataFrame:
    """(id, row, pos) of the lines to drop, by one pass over ranges of the hash, sorted by hash, document and position."""
    order = ("h1", "h2", F.col("id").desc_nulls_last(), "row", "pos")
    ranged = lines.repartitionByRange("h1", "h2").sortWithinPartitions(*order)
    key = Window.partitionBy("h1", "h2")
    so_far = key.orderBy(F.col("id").desc_nulls_last(), "row", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # A line begins a document of its key if the line before it is of another one.
    before = F.lag(F.struct("id", "row")).over(key.orderBy(F.col("id").desc_nulls_last(), "row", "pos"))
    passed = ranged.withColumn("first", F.first("id").over(so_far)).withColumn("begins", (~before.eqNullSafe(F.struct("id", "row"))).cast("int"))
    counted = passed.withColumn("documents", F.sum("begins").over(key))
    return counted.where((F.col("documents") >= MIN_DOCUMENTS) & ~F.col("first").eqNullSafe(F.col("id"))).select("id", "row", "pos")


def dropped_lines(lines: DataFrame) -> DataFrame:
    """(id, row, pos) of the lines to drop, out of a cut table of long_lines()."""
    hot = hot_hashes(lines)
    if not hot:
        return dropped_in_ranges(lines)
    keys = F.broadcast(lines.sparkSession.createDataFrame([(x,) for x in hot], "h1 bigint"))
    return dropped_of_hot(lines.join(keys, "h1", "left_semi")).unionByName(dropped_in_ranges(lines.join(keys, "h1", "left_anti")))


def drop_bitmaps(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(id, row, words) as a cut table: for each document that loses lines, the non-zero 64-bit words of the bitmap of dropped positions."""
    rows = docs.select(F.col(id_col).alias("_ink_id"), F.coalesce(F.col(text), F.lit("")).alias("_ink_text"))
    dropped = dropped_lines(cut(long_lines(rows), "lines"))
    bits = dropped.groupBy("id", "row", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, pos & 63)")).alias("bits"))
    return cut(bits.groupBy("id", "row").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("words")), "bitmaps")


def dedup_lines(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, n_lines, n_dropped, drop_words (bitmap of dropped positions, null if none) and kept_text of every document.

    A line's key is the line without blanks at its ends, A-Z lower-cased. Keys of MIN_CHARS code points at least that
    MIN_DOCUMENTS documents hold lose all their lines but those in the largest id holding it, null being smallest. Rows
    that share an id count as one document if their texts are equal too, else as two, of which the largest
    id's all keep the line. A null or empty text is one empty line. A very long text is split whole in one row. An empty table
    gives an empty result; other columns are not read."""
    bitmaps = drop_bitmaps(docs, text, id_col)
    rows = docs.select(F.col(id_col).alias("_ink_id"), F.coalesce(F.col(text), F.lit("")).alias("_ink_text")).withColumn("_ink_row", F.xxhash64("_ink_text"))
    same = F.col("_ink_id").eqNullSafe(F.col("id")) & (F.col("_ink_row") == F.col("row"))
    found = join_sized(rows, bitmaps, same)
    split = F.split("_ink_text", "\n")
    stays = F.filter(split, lambda x, i: F.coalesce(F.try_element_at("words", F.shiftright(i, 6)), F.lit(0).cast("bigint")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("bigint"), i.bitwiseAND(F.lit(63)))) == 0)
    lines = F.length("_ink_text") - F.length(F.replace("_ink_text", F.lit("\n"), F.lit(""))) + 1
    lost = F.aggregate(F.map_values("words"), F.lit(0).cast("bigint"), lambda a, w: a + F.bit_count(w))
    return found.select(
        F.col("_ink_id").alias(id_col), lines.cast("bigint").alias("n_lines"), F.coalesce(lost, F.lit(0)).cast("bigint").alias("n_dropped"), F.col("words").alias("drop_words"),
        F.when(F.col("words").isNull(), F.col("_ink_text")).otherwise(F.array_join(stays, "\n")).alias("kept_text"),
    )
