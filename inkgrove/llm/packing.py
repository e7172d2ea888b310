"""Best-fit packing of token sequences by large-item matching.

Only lengths matter to the packing, and there are at most CAPACITY different ones, so the plan is made from the
counts per length: one packing of the whole corpus, on a table of bounded size. Pieces above a third of
the capacity are matched greedily, at most two to a sequence, each with the longest partner that fits;
shorter pieces then go, longest first, where they leave the smallest gap. The plan assigns ranks within a length to
places in runs of sequences, and every piece looks its place up by its rank.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.llm.vocab import encoder
from inkgrove.llm.worker import frugal
from inkgrove.plans.shared import cut, join_sized, tune_arrow

CAPACITY, END_ID = 2048, 0
#: Pieces that get their ranks in one task, about.
RANKED_TOGETHER = 50_000


@dataclass
class Run:
    """Pieces of one length with ranks first, first + 1, ...: each to a sequence, each times in the same one."""

    length: int
    first: int
    count: int
    sequence: int
    offset: int
    each: int


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> tuple[list[Run], int]:
    """Places for counts[length] pieces of each length, and the number of sequences."""
    left = {n: c for n, c in counts.items() if c}
    used = dict.fromkeys(left, 0)
    runs: list[Run] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # room left: (first sequence, how many), last in first out
    rooms: list[int] = []
    sequences = 0

    def put(length: int, count: int, sequence: int, offset: int, each: int) -> None:
        runs.append(Run(length, used[length], count, sequence, offset, each))
        used[length] += count
        left[length] -= count

    def leave(room: int, sequence: int, count: int) -> None:
        if room and count:
            if room not in gaps:
                gaps[room] = []
                insort(rooms, room)
            gaps[room].append((sequence, count))

    large = sorted(n for n in left if n * 3 > capacity)
    while large:
        n = large[-1]
        at = bisect_left(large, capacity - n + 1) - 1
        if at >= 0 and large[at] == n and left[n] < 2:
            at -= 1
        if at < 0:  # no partner fits
            c = left[n]
            put(n, c, sequences, 0, 1)
            leave(capacity - n, sequences, c)
        else:
            m = large[at]
            c = left[n] // 2 if m == n else min(left[n], left[m])
            if m == n:
                put(n, 2 * c, sequences, 0, 2)
            else:
                put(n, c, sequences, 0, 1)
                put(m, c, sequences, n, 1)
            leave(capacity - n - m, sequences, c)
        sequences += c
        large = [x for x in large if left[x]]
    for n in sorted((x for x in left if x * 3 <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(rooms, n)
            if at == len(rooms):  # no gap fits: open sequences
                each = capacity // n
                full, rest = divmod(left[n], each)
                if full:
                    put(n, full * each, sequences, 0, each)
                    leave(capacity - n * each, sequences, full)
                    sequences += full
                if rest:
                    put(n, rest, sequences, 0, rest)
                    leave(capacity - n * rest, sequences, 1)
                    sequences += 1
                continue
            room = rooms[at]
            start, many = gaps[room].pop()
            if not gaps[room]:
                del gaps[room], rooms[at]
            each = room // n
            full, rest = min(many, left[n] // each), 0
            if full < many:
                rest = left[n] - full * each
                rest = min(rest, each - 1)
            if full:
                put(n, full * each, start, capacity - room, each)
                leave(room - n * each, start, full)
            if rest:
                put(n, rest, start + full, capacity - room, rest)
                leave(room - n * rest, start + full, 1)
            leave(room, start + full + bool(rest), many - full - bool(rest))
    return runs, sequences


def pieces(docs: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = False, plain_specials: bool = False) -> DataFrame:
    """id_col, piece, start, length, ids_crc32 (and ids, if with_ids) of each document's pieces.

    A document is its ids and END_ID. Only one longer than the capacity is cut, into pieces of the
    capacity with the shorter piece first. A null text counts as empty; of a very long one all ids are held at once. Strings of the
    vocabulary's special tokens become these tokens, unless plain_specials."""
    tune_arrow(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias("_ink_id"), F.col(text).cast("binary").alias("_ink_body"))
    names = ["_ink_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    types = (rows.schema["_ink_id"].dataType, T.IntegerType(), *[T.LongType()] * 3, T.ArrayType(T.IntegerType()))
    schema = T.StructType([T.StructField(n, t) for n, t in zip(names, types)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = [x or b"" for x in batch.column("_ink_body").to_pylist()]
            of, piece, start, length, crc, ids = [], [], [], [], [], []
            for row, found in enumerate(encoder(vocabulary, plain_specials).encode(bodies)):
                whole = np.append(found, np.uint32(END_ID)).astype("<u4")
                head = len(whole) % capacity or capacity
                for k, (a, b) in enumerate([(0, head), *((x, x + capacity) for x in range(head, len(whole), capacity))]):
                    of.append(row)
                    piece.append(k)
                    start.append(a)
                    length.append(b - a)
                    crc.append(zlib.crc32(whole[a:b]))
                    if with_ids:
                        ids.append(whole[a:b].astype(np.int32))
            columns = [batch.column("_ink_id").take(pa.array(of, pa.int64())), pa.array(piece, pa.int32()), *(pa.array(x, pa.int64()) for x in (start, length, crc))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names)

    return rows.mapInArrow(frugal(run), schema).withColumnRenamed("_ink_id", id_col)


def pack(docs: DataFrame, vocabulary: str, text: str = "text", id_col: str = "doc_id", capacity: int = CAPACITY, with_ids: bool = False, plain_specials: bool = False) -> DataFrame:
    """pieces() with sequence_id and offset: every piece of every document has its place, without gaps.

    Repeated rows are packed each for itself, in any order among them; null ids are allowed; an empty table
    gives an empty result; other columns are not read."""
    found = pieces(docs, vocabulary, text, id_col, capacity, with_ids, plain_specials).withColumn("_ink_place", F.monotonically_increasing_id())
    kept, found = found.columns[:-1], cut(found, "pieces")
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    runs, _ = plan(counts, capacity)
    by_length: dict[int, tuple[np.ndarray, ...]] = {}
    for n in counts:
        own = [r for r in runs if r.length == n]
        by_length[n] = tuple(np.array([getattr(r, k) for r in own], np.int64) for k in ("first", "sequence", "offset", "each"))
    places = docs.sparkSession.sparkContext.broadcast(by_length)
    # A length with many pieces is ranked in as many parts as keep each within a task's share.
    share = max(1, min(RANKED_TOGETHER, sum(counts.values()) // int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    parts = [(n, -(-c // share)) for n, c in counts.items()]  # at most capacity rows
    dealt = docs.sparkSession.createDataFrame(parts, "length bigint, _ink_parts bigint")
    rows = found.join(F.broadcast(dealt), "length").withColumn("_ink_part", F.pmod(F.xxhash64("_ink_place"), F.col("_ink_parts")))
    group = Window.partitionBy("length", "_ink_part")
    rows = rows.withColumn("_ink_rank", F.row_number().over(group.orderBy("_ink_place")) - 1)
    if any(k > 1 for _, k in parts):
        sizes = found.join(F.broadcast(dealt), "length").groupBy("length", F.pmod(F.xxhash64("_ink_place"), F.col("_ink_parts")).alias("_ink_part")).count()
        before = F.sum("count").over(Window.partitionBy("length").orderBy("_ink_part").rowsBetween(Window.unboundedPreceding, -1))
        sizes = cut(sizes.select("length", "_ink_part", F.coalesce(before, F.lit(0)).alias("_ink_before")), "ranks")
        rows = join_sized(rows, sizes, ["length", "_ink_part"]).withColumn("_ink_rank", F.col("_ink_rank") + F.col("_ink_before"))
    rows = rows.select(*[F.col(f"`{c}`") for c in kept], F.col("_ink_rank").cast("bigint").alias("_ink_rank"))
    schema = T.StructType([*(f for f in found.schema.fields if f.name in kept), T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "_ink_rank"))
            sequence, offset = np.zeros(len(rank), np.int64), np.zeros(len(rank), np.int64)
            for n in np.unique(length):
                first, run_sequence, run_offset, each = places.value[int(n)]
                own = np.flatnonzero(length == n)
                k = np.searchsorted(first, rank[own], side="right") - 1
                inside = rank[own] - first[k]
                sequence[own] = run_sequence[k] + inside // each[k]
                offset[own] = run_offset[k] + inside % each[k] * n
            names = [x for x in batch.schema.names if x != "_ink_rank"]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    return rows.mapInArrow(place, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pack(..., with_ids=True): each sequence's ids in their places; at most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"))
