"""Collocations of two and three words, by exact counts in every language of a corpus.

Identical pieces (between punctuation) are collapsed into one with a multiplicity. Tasks turn pieces into n-grams
weighted by it and add up what they hold; the partial counts are dealt to hash buckets, and a task counts its bucket out of core in
duckdb. The longest n-grams follow in a second pass, only where their parts were frequent. A phrase and its parts lie in different buckets: each candidate sends lookup requests for the counts of its parts, which are shuffled to
where the counts are, and the answers are shuffled back.
"""

from __future__ import annotations

import itertools
import os
import shutil
import tempfile
from collections.abc import Iterator

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrove.llm.hashing import slice_hashes
from inkgrove.plans.shared import cut, join_back, tune_arrow

MIN_COUNT, LONGEST, TOP = 10, 3, 2000
#: Of a longer candidate, in hundredths of a shorter one's occurrences, from which the shorter one goes.
CONTAINED = 50
#: Words of the pieces that are turned into n-grams at once.
WORDS_AT_ONCE = 1 << 20
#: The filter of frequent phrases has so many bits for each, in all FILTER_BITS at most; it is made in chunks.
FILTER_BITS_EACH, FILTER_BITS, CHUNK_BITS = 16, 1 << 29, 1 << 20
#: Memory of duckdb in a task; beyond, it spills to the task's own folder, which goes with the task.
COUNTING_MB = 256
#: At each step of the ranking a task ranks so many groups of TOP phrases of a language at most.
RANKED_TOGETHER = 32
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def pieces(docs: DataFrame, text: str = "text", lang: str = "lang") -> DataFrame:
    """(lang, piece, words, copies): the different pieces of a language, their words joined by one blank, and how often they occur."""
    named = [F.col("`" + c.replace("`", "``") + "`") for c in (lang, text)]
    rows = docs.select(F.coalesce(named[0], F.lit("und")).alias("lang"), F.coalesce(named[1], F.lit("")).alias("text"))
    # lower() does the same as translate(), and faster, in texts of ASCII.
    ascii_only = F.octet_length("text") == F.length("text")
    lower = F.when(ascii_only, F.lower("text")).otherwise(F.translate("text", _UPPER, _LOWER))
    split = rows.select("lang", F.explode(F.split(lower, r"[.,;:!?\x0A-\x0D]")).alias("piece"))
    tidy = split.select("lang", F.regexp_replace(F.btrim("piece", F.lit(" \t")), "[ \t]+", " ").alias("piece")).where("piece <> ''")
    counted = tidy.groupBy("lang", "piece").agg(F.count("*").alias("copies"))
    words = F.length("piece") - F.length(F.replace("piece", F.lit(" "), F.lit(""))) + 1
    return counted.select("lang", "piece", words.cast("bigint").alias("words"), "copies")


_PARTIAL = pa.schema([("lang", pa.string()), ("phrase", pa.string()), ("size", pa.int32()), ("f", pa.int64())])


def weighted_ngrams(lang: pa.Array, piece: pa.Array, copies: np.ndarray, sizes: tuple[int, ...], frequent: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, size, f) of all n-grams of these sizes in the pieces, each once with its weight. With frequent, a filter of the phrases one word shorter, only
    those that may be frequent at both ends.

    An n-gram is a path: its number is that of the pair (number of its beginning, last word), so strings are made of different n-grams only."""
    split = pc.split_pattern(piece, " ")
    words = pc.dictionary_encode(split.flatten())
    codes, texts = words.indices.to_numpy().astype(np.int64), words.dictionary
    langs = pc.dictionary_encode(lang)
    lengths = pc.list_value_length(split).to_numpy(zero_copy_only=False).astype(np.int64)
    weights = np.repeat(copies, lengths)
    left = np.repeat(np.cumsum(lengths), lengths) - np.arange(len(codes))  # words up to the end of the piece
    grams, names = np.repeat(langs.indices.to_numpy().astype(np.int64), lengths), None
    spoken, open_at = np.arange(len(langs.dictionary)), np.ones(len(codes), bool)
    for size in range(1, max(sizes) + 1):
        starts = np.flatnonzero((left >= size) & open_at)
        if not len(starts):
            return
        numbers, inverse = np.unique(grams[starts] * len(texts) + codes[starts + size - 1], return_inverse=True)
        before, last = numbers // len(texts), pa.array(numbers % len(texts))
        spoken = spoken[before]
        names = texts.take(last) if names is None else pc.binary_join_element_wise(names.take(pa.array(before)), texts.take(last), " ")
        tongues = langs.dictionary.take(pa.array(spoken))
        if size in sizes:
            sums = np.zeros(len(numbers), np.int64)
            np.add.at(sums, inverse, weights[starts])
            yield pa.RecordBatch.from_arrays([tongues, names, pa.array(np.full(len(numbers), size, np.int32)), pa.array(sums)], schema=_PARTIAL)
        grams = np.full(len(codes), -1, np.int64)
        grams[starts] = inverse
        if frequent is not None and size == max(sizes) - 1:
            at = places(tongues, names, 8 * len(frequent))
            hit = (frequent[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)
            open_at = (grams >= 0) & hit[grams]
            open_at[:-1] &= open_at[1:]  # of the last word of a piece, left decides


def places(lang: pa.Array, phrase: pa.Array, bits: int) -> np.ndarray:
    """The place of each phrase in a filter of so many bits, a power of two."""
    joined = pc.binary_join_element_wise(lang, phrase, "\n").cast(pa.large_binary())
    offsets = np.frombuffer(joined.buffers()[1], np.int64)[joined.offset : joined.offset + len(joined) + 1]
    data = np.frombuffer(joined.buffers()[2] or b"", np.uint8)
    return (slice_hashes(data, offsets[:-1], offsets[1:]) & np.uint64(bits - 1)).astype(np.int64)


def frequent_filter(counts: DataFrame) -> np.ndarray:
    """A filter, FILTER_BITS at most, of the phrases of counts: none is missed, and what passes by chance is only counted in vain."""
    bits = CHUNK_BITS
    wanted = FILTER_BITS_EACH * counts.count()
    while bits < min(wanted, FILTER_BITS):
        bits *= 2

    def placed(batches):
        for batch in batches:
            if batch.num_rows:
                at = np.unique(places(batch.column("lang"), batch.column("phrase"), bits))
                yield pa.RecordBatch.from_arrays([pa.array(at // CHUNK_BITS), pa.array(at % CHUNK_BITS)], ["chunk", "at"])

    def packed(key, group):
        held = np.zeros(CHUNK_BITS, bool)
        held[group["at"]] = True
        return pd.DataFrame({"chunk": [key[0]], "held": [np.packbits(held, bitorder="little").tobytes()]})

    chunks = counts.select("lang", "phrase").mapInArrow(placed, "chunk bigint, at bigint").distinct().groupBy("chunk").applyInPandas(packed, "chunk bigint, held binary")
    out = np.zeros(bits // 8, np.uint8)
    for r in chunks.toLocalIterator():  # bits in all
        out[r.chunk * CHUNK_BITS // 8 : (r.chunk + 1) * CHUNK_BITS // 8] = np.frombuffer(r.held, np.uint8)
    return out


def _ngrams_of(sizes: tuple[int, ...], frequent):
    """Pieces to partial counts, WORDS_AT_ONCE at a time."""

    def partial(held: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        column = lambda name: table.column(name).chunk(0)
        for batch in weighted_ngrams(column("lang"), column("piece"), column("copies").to_numpy(), sizes, frequent and frequent.value):
            for i in range(0, batch.num_rows, 1 << 16):
                yield batch.slice(i, 1 << 16)

    def in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [], 0
        for batch in batches:
            for i in range(0, batch.num_rows, 4096):
                part = batch.slice(i, 4096)
                held.append(part)
                words += pc.sum(part.column("words")).as_py()
                if words >= WORDS_AT_ONCE:
                    yield from partial(held)
                    held, words = [], 0
        if held:
            yield from partial(held)

    return in_turn


def _counted_out_of_core(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds up the partial counts of one hash bucket; phrases of MIN_COUNT occurrences at least remain."""
    first = next((b for b in batches if b.num_rows), None)
    if first is None:
        return
    folder = tempfile.mkdtemp(prefix="phrases-")
    try:
        with duckdb.connect(os.path.join(folder, "bucket.db"), config={"threads": 1, "memory_limit": f"{COUNTING_MB}MB", "temp_directory": folder, "preserve_insertion_order": False}) as c:
            incoming = pa.RecordBatchReader.from_batches(first.schema, itertools.chain([first], batches))
            c.register("incoming", incoming)
            counted = c.sql(f"SELECT lang, phrase, size, CAST(sum(f) AS BIGINT) AS f FROM incoming GROUP BY lang, phrase, size HAVING sum(f) >= {MIN_COUNT}")
            for batch in counted.to_arrow_reader(1 << 16):
                yield batch.cast(_PARTIAL)
    finally:
        shutil.rmtree(folder, ignore_errors=True)


def phrase_counts(different: DataFrame) -> DataFrame:
    """(lang, phrase, size, f) out of cut tables: all phrases of up to LONGEST words with MIN_COUNT occurrences at least.

    The longest ones, most of which are rare, are counted in a second pass, where both ends passed the first."""
    spark, schema = different.sparkSession, "lang string, phrase string, size int, f bigint"
    tune_arrow(spark)

    def counted(sizes: tuple[int, ...], frequent=None) -> DataFrame:
        partial = different.select("lang", "piece", "words", "copies").mapInArrow(_ngrams_of(sizes, frequent), schema)
        buckets = partial.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "lang", "phrase")
        return cut(buckets.mapInArrow(_counted_out_of_core, schema), "phrases")

    shorter = counted(tuple(range(1, LONGEST)))
    frequent = spark.sparkContext.broadcast(frequent_filter(shorter.where(F.col("size") == LONGEST - 1)))
    longest = counted((LONGEST,), frequent)
    frequent.unpersist()
    return shorter.unionByName(longest)


def _part(words: Column, start: Column | int, size: Column) -> Column:
    return F.array_join(F.slice(words, start, size), " ")


def cut_scores(counts: DataFrame) -> DataFrame:
    """(lang, phrase, size, a, l, r, score) of all candidates, by their lowest-scoring cut."""
    words = F.split("phrase", " ")
    per_cut = counts.where("size > 1").select("lang", "phrase", words.alias("words"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    both = F.explode(F.array(F.struct(F.lit("l").alias("side"), _part(F.col("words"), 1, F.col("k")).alias("part")), F.struct(F.lit("r").alias("side"), _part(F.col("words"), F.col("k") + 1, F.size("words") - F.col("k")).alias("part"))))
    requests = cut(per_cut.select("lang", "phrase", "k", both.alias("x")).select("lang", "x.part", "phrase", "k", "x.side"), "requests")
    asked = requests.groupBy("lang", "part").agg(F.count("*").alias("asked"))
    held = cut(asked.join(counts.select("lang", F.col("phrase").alias("part"), F.col("f").alias("held")), ["lang", "part"]), "asked")
    answers = join_back(requests, held, ["lang", "part"], "asked", requests.count())
    sides = [F.max(F.when((F.col("k") == k) & (F.col("side") == s), F.col("held"))).alias(f"{s}{k}") for k in range(1, LONGEST) for s in "lr"]
    found = answers.groupBy("lang", "phrase").agg(*sides).join(counts.where("size > 1").select("lang", "phrase", "size", F.col("f").alias("a")), ["lang", "phrase"])

    def scored(k: int) -> Column:
        # Up to 15 digits of a, and 19 of the parts, the products are exact.
        score = F.expr(f"cast(1000000 as decimal(7,0)) * (cast(a as decimal(15,0)) * cast(a as decimal(15,0))) div (cast(l{k} as decimal(19,0)) * cast(r{k} as decimal(19,0)))")
        return F.when(F.col("size") > k, F.struct(score.alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))

    best = F.array_min(F.array_compact(F.array(*[scored(k) for k in range(1, LONGEST)])))
    return found.select("lang", "phrase", "size", "a", best.alias("best")).select("lang", "phrase", "size", "a", "best.l", "best.r", "best.score")


def without_contained(scored: DataFrame) -> DataFrame:
    """The candidates that no longer one with CONTAINED hundredths of their occurrences holds."""
    words = F.split("phrase", " ")
    inside = F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("size") - 1), lambda n: F.transform(F.sequence(F.lit(1), F.col("size") - n + 1), lambda i: _part(words, i, n)))))
    longer = scored.where("size > 2").select("lang", inside.alias("phrase"), F.col("a").alias("f")).groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = F.coalesce(F.lit(100) * F.col("longer").cast("decimal(20,0)") < F.lit(CONTAINED) * F.col("a").cast("decimal(20,0)"), F.lit(True))
    return scored.join(longer, ["lang", "phrase"], "left").where(kept).drop("longer")


def best_of_each(scored: DataFrame, top: int = TOP) -> DataFrame:
    """The first top candidates of each language with their rank. A language's candidates are first ranked in groups by hash, RANKED_TOGETHER of which meet at the next step."""
    order = (F.desc("score"), F.desc("a"), F.asc("phrase"))
    tasks = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    groups = 1
    while groups * RANKED_TOGETHER < tasks:
        groups *= RANKED_TOGETHER
    rows = scored.withColumn("_group", F.pmod(F.xxhash64("phrase"), F.lit(groups * RANKED_TOGETHER)))
    while True:
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_group").orderBy(*order))).where(F.col("rank") <= top)
        if groups == 0:
            return rows.drop("_group")
        rows, groups = rows.withColumn("_group", F.pmod(F.col("_group"), F.lit(groups))), 0 if groups == 1 else groups // RANKED_TOGETHER


def collocations(docs: DataFrame, text: str = "text", lang: str = "lang", top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first top phrases.

    A null lang is "und", a null or empty text has no words; a very long text or piece is taken whole. Repeated rows count each. Ties in score go by a, then
    by phrase in byte order. An empty table gives an empty result; other columns are not read, whatever their names."""
    different = cut(pieces(docs, text, lang), "pieces")
    totals = different.groupBy("lang").agg(F.sum(F.col("words") * F.col("copies")).alias("n"))
    scored = cut(cut_scores(phrase_counts(different)), "scored")
    best = best_of_each(without_contained(scored), top)
    totals = cut(totals.join(scored.select("lang").distinct(), "lang", "left_semi"), "totals")
    long = [F.col(c).cast("bigint").alias(c) for c in ("a", "l", "r", "n", "score")]
    return best.join(totals, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", *long)
