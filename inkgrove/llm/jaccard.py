"""N-gram Jaccard join by grouped prefixes.

A document's set is its distinct WORDS-word shingles as 64-bit hashes. Two sets with Jaccard similarity of at
least PERCENT / 100 share an element among the first n - ceil(n * PERCENT / 100) + 1 of either, in any order fixed for the
whole corpus; here shingles of many documents come last, so passages that many documents share stay out of
most prefixes. Documents with the same size and prefix form one group. Postings (prefix element, group) meet by ranges of
the hash, in compressed blocks; groups of one posting whose sizes allow the similarity become pairs; pairs expand to
members with different sets, whose whole sets are recomputed and compared.

A posting over LONG groups is not paired off: each group is paired with a hub (the group with the fewest rarer elements)
and with the next one, and the links found join most of it. Tasks do this to their own part of a posting first and hand on
its hub alone, so no posting meets whole. Groups of it that then still lie in different components are held against each
other in a second round, block by block, so no link between components is missed and no group of near copies is squared. There the
parities of the sets' elements by hash bucket tell most pairs apart: two sets differ in at least as many elements as buckets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from inkgrove.llm.components import components
from inkgrove.llm.hashing import mix, slice_hashes
from inkgrove.llm.vocab import forget_encoders
from inkgrove.llm.worker import frugal
from inkgrove.plans.shared import cut, join_back, join_sized, tune_arrow

WORDS, PERCENT = 5, 80
#: Groups up to which a posting is paired off at once.
LONG = 16
#: Shingles of OFTEN documents at least come later in the order, by powers of two; the MOST_FREQUENT of them at most.
OFTEN, MOST_FREQUENT = 8, 4_000_000
#: Shingles, and postings, a task holds before it hands out blocks; shingles of one hash range, about; bytes of text hashed at once.
HELD, HELD_POSTINGS, IN_RANGE, BLOCK = 500_000, 200_000, 1_000_000, 1 << 20
#: Bits of the ranges in which tasks hand out blocks; where more are needed, a second pass splits these ranges.
COARSE_BITS = 12
#: Members of a posting held against as many others in one group of the second round, about; rows of such groups in one task, about.
ROUND_BLOCK, ROUND_ROWS = 1000, 50_000
#: Sets compared with one copy of a set that many are compared with.
AROUND_HUB = 64
#: Bits of a set's parities.
PARITIES = 1024
#: Shingles are counted by the upper bits of their hash.
COUNTED_SHIFT = np.uint64(20)

_BLANKS = np.zeros(256, bool)
_BLANKS[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STEPS = [np.uint64(pow(0x9E3779B97F4A7C15, k + 1, 2**64)) for k in range(WORDS)]


def shingle_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each UTF-8 text, A-Z lower-cased, words cut at space and \\t to \\r."""
    at = 0
    while at < len(texts):
        until, size = at, 0
        while until < len(texts) and (size < BLOCK or until == at):
            size += len(texts[until])
            until += 1
        yield from _block_sets(texts[at:until])
        at = until


def _block_sets(texts: list[bytes]) -> Iterator[np.ndarray]:
    data = _LOWER[np.frombuffer(b" ".join(texts) + b" ", np.uint8)]
    ends = np.cumsum([len(t) + 1 for t in texts])
    blank = _BLANKS[data]
    starts = np.flatnonzero(~blank & np.concatenate([[True], blank[:-1]]))
    stops = np.flatnonzero(blank[1:] & ~blank[:-1]) + 1
    words = slice_hashes(data, starts, stops)
    bounds = np.concatenate([[0], np.searchsorted(starts, ends)])
    shingles = np.zeros(max(0, len(words) - WORDS + 1), np.uint64)
    for k, step in enumerate(_STEPS):
        shingles += words[k : k + len(shingles)] * step
    shingles = mix(shingles)
    for a, b in zip(bounds[:-1], bounds[1:]):
        if b - a >= WORDS:
            yield np.unique(shingles[a : b - WORDS + 1])
        elif b > a:
            short = words[a:b]
            yield mix(np.array([sum(int(w) * int(s) for w, s in zip(short, _STEPS)) + len(short) & (2**64 - 1)], np.uint64))
        else:
            yield np.zeros(0, np.uint64)


def prefix_length(n: int) -> int:
    return n - -(-n * PERCENT // 100) + 1


class _Ranges:
    """Gathers hashes with payload and hands them out as one compressed block per hash range, after reduce(), if given, has cut them down."""

    def __init__(self, bits: int, reduce=None):
        self.bits, self.reduce, self.parts, self.size = bits, reduce, [], 0

    def add(self, *columns: np.ndarray) -> None:
        self.parts.append(columns)
        self.size += len(columns[0])

    def flush(self) -> Iterator[tuple[int, bytes]]:
        if not self.size:
            return
        columns = [np.concatenate(c) for c in zip(*self.parts)]
        self.parts, self.size = [], 0
        if self.reduce:
            columns = self.reduce(*columns)
        order = np.argsort(columns[0])
        columns = [c[order] for c in columns]
        of = columns[0] >> np.uint64(64 - self.bits)
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(of)), bool), of[1:] != of[:-1]]))
        for a, b in zip(first, np.append(first[1:], len(of))):
            yield int(of[a]), pack_block([c[a:b] for c in columns])


def _finer(blocks: DataFrame, bits: int) -> DataFrame:
    """Blocks (range, block) of COARSE_BITS bits as blocks of that many bits; range after range, so that they are not torn to single hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = _Ranges(bits), None
        for batch in batches:
            for k, block in zip(batch.column("range").to_pylist(), batch.column("block").to_pylist()):
                if k != now or held.size >= HELD:
                    yield from map(_block_row, held.flush())
                now = k
                held.add(*unpack_block(block))
        yield from map(_block_row, held.flush())

    return blocks.repartition("range").sortWithinPartitions("range").mapInArrow(frugal(run), "range int, block binary")


def pack_block(columns: list[np.ndarray]) -> bytes:
    """Sorted hashes as differences in byte planes, other columns as indexes of their distinct values."""
    steps = np.diff(columns[0], prepend=np.uint64(0))
    parts = [np.array([len(steps), len(columns) - 1], "<u4").tobytes(), np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes()]
    for c in columns[1:]:
        values, index = np.unique(c, return_inverse=True)
        parts += [np.array([len(values)], "<u4").tobytes(), values.astype("<u8").tobytes(), np.ascontiguousarray(index.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def unpack_block(block: bytes) -> list[np.ndarray]:
    raw = zstandard.ZstdDecompressor().decompress(block)
    n, more = np.frombuffer(raw, "<u4", 2)
    at = 8 + 8 * int(n)
    columns = [np.cumsum(np.ascontiguousarray(np.frombuffer(raw, np.uint8, 8 * n, 8).reshape(8, -1).T).view("<u8").ravel())]
    for _ in range(more):
        k = int(np.frombuffer(raw, "<u4", 1, at)[0])
        values = np.frombuffer(raw, "<u8", k, at + 4)
        index = np.ascontiguousarray(np.frombuffer(raw, np.uint8, 4 * n, at + 4 + 8 * k).reshape(4, -1).T).view("<u4").ravel()
        columns.append(values[index])
        at += 4 + 8 * k + 4 * int(n)
    return columns


def _frequent(rows: DataFrame, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted counting keys of the shingles of many documents, and their levels. At most MOST_FREQUENT."""

    def counted_once(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        keys, n = np.unique(keys, return_counts=True)
        return keys, n.astype(np.uint64)

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Ranges(min(bits, COARSE_BITS), counted_once)
        for batch in batches:
            for found in shingle_sets([x or b"" for x in batch.column("body").to_pylist()]):
                held.add((found >> COUNTED_SHIFT) << COUNTED_SHIFT)
                if held.size >= HELD:
                    yield from map(_block_row, held.flush())
        yield from map(_block_row, held.flush())

    def count(frame: pd.DataFrame) -> pd.DataFrame:
        keys, n = (np.concatenate(c) for c in zip(*map(unpack_block, frame["block"])))
        keys, where = np.unique(keys, return_inverse=True)
        n = np.bincount(where, weights=n)
        often = n >= OFTEN
        level = np.minimum(np.log2(n[often]).astype(np.uint64), np.uint64(60))
        out = [(int(v), int((level == v).sum()), pack_block([keys[often][level == v]])) for v in np.unique(level)]
        return pd.DataFrame(out, columns=["level", "n", "keys"])

    found = rows.select("body").mapInArrow(frugal(blocks, forget_encoders), "range int, block binary")
    found = _finer(found, bits) if bits > COARSE_BITS else found
    counted = cut(found.groupBy("range").applyInPandas(count, "level int, n bigint, keys binary"), "frequent")
    room, least = MOST_FREQUENT, 64
    for r in counted.groupBy("level").agg(F.sum("n").alias("n")).orderBy(F.desc("level")).collect():  # 61 levels at most
        if r.n > room:
            break
        room, least = room - r.n, r.level
    keys, levels = [np.zeros(0, np.uint64)], [np.zeros(0, np.uint8)]
    for r in counted.where(F.col("level") >= least).toLocalIterator():  # at most MOST_FREQUENT keys
        keys.append(unpack_block(bytes(r["keys"]))[0])
        levels.append(np.full(r.n, r.level, np.uint8))
    keys, levels = np.concatenate(keys), np.concatenate(levels)
    order = np.argsort(keys)
    return keys[order], levels[order]


def _block_row(found: tuple[int, bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([found[0]], pa.int32()), pa.array([found[1]], pa.binary())], ["range", "block"])


def _signature(found: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(found.tobytes())


def _parities(found: np.ndarray) -> bytes:
    """For each of PARITIES hash buckets, whether an odd number of the elements falls there."""
    return np.packbits(np.bincount((found % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) % 2 == 1).tobytes()


_MARKED = ["id", "row", "n", "sig", "odd", "grp", "range", "block", "posting", "a", "b"]


def _marked_batch(kinds: dict, size: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns[c] if c in columns else pa.nulls(size, kinds[c]) for c in _MARKED], _MARKED)


def _mark(rows: DataFrame, bits: int, frequent) -> DataFrame:
    """A row (id, row, n, sig, grp) for each document; rows (range, block) of postings (prefix element, group, size, place, reduced); and
    for what a task has settled of long postings, pairs (a, b) of groups and members (posting, a: group, b: place, n)."""
    kinds = {"id": to_arrow_type(rows.schema["id"].dataType), "sig": pa.binary(), "odd": pa.binary(), "range": pa.int32(), "block": pa.binary()}
    kinds = {c: kinds.get(c, pa.int64()) for c in _MARKED}
    shape = T.StructType([T.StructField("id", rows.schema["id"].dataType)] + [T.StructField(c, {"sig": T.BinaryType(), "odd": T.BinaryType(), "block": T.BinaryType(), "range": T.IntegerType()}.get(c, T.LongType())) for c in _MARKED[1:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, levels = frequent.value
        settled: list[pa.RecordBatch] = []

        def hubs_only(element, group, n, place):
            left, right, members, kept = _starred(element, group, n.astype(np.int64), place.astype(np.int64), np.zeros(len(element), np.uint64), all_short=False)
            for columns in ({"a": left, "b": right}, members):
                if size := len(columns["a"]):
                    settled.append(_marked_batch(kinds, size, **{c: pa.array(v.astype(np.int64)) for c, v in columns.items()}))
            return kept

        def handed_out() -> Iterator[pa.RecordBatch]:
            for k, block in held.flush():
                yield _marked_batch(kinds, 1, range=pa.array([k], pa.int32()), block=pa.array([block], pa.binary()))
            yield from settled
            settled.clear()

        held = _Ranges(min(bits, COARSE_BITS), hubs_only)
        for batch in batches:
            sizes, sigs, odd, groups = [], [], [], []
            for found in shingle_sets([x or b"" for x in batch.column("body").to_pylist()]):
                n = len(found)
                sizes.append(n)
                sigs.append(_signature(found))
                odd.append(_parities(found))
                if not n:
                    groups.append(0)
                    continue
                prefix = found
                if len(keys):
                    key = (found >> COUNTED_SHIFT) << COUNTED_SHIFT
                    at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    level = np.where(keys[at] == key, levels[at], 0)
                    if level.any():
                        prefix = found[np.argsort(level, kind="stable")]
                prefix = prefix[: prefix_length(n)]
                place = np.argsort(prefix)
                prefix = prefix[place]
                group = np.frombuffer(xxhash.xxh3_64_digest(prefix.tobytes(), n), ">u8")[0]
                groups.append(int(group.astype(np.int64)))
                held.add(prefix, np.full(len(prefix), group, np.uint64), np.full(len(prefix), n, np.uint64), place.astype(np.uint64))
            yield _marked_batch(kinds, batch.num_rows, id=batch.column("id"), row=batch.column("row"), n=pa.array(sizes, pa.int64()), sig=pa.array(sigs, pa.binary()), odd=pa.array(odd, pa.binary()), grp=pa.array(groups, pa.int64()))
            if held.size >= HELD_POSTINGS:
                yield from handed_out()
        yield from handed_out()

    return rows.select("id", "row", "body").mapInArrow(frugal(run, forget_encoders), shape)


def _can_link(n1: np.ndarray, place1: np.ndarray, n2: np.ndarray, place2: np.ndarray) -> np.ndarray:
    """Whether two sets whose first common element stands at these places of their orders can have the similarity:
    what stands before it is not shared. A pair that fails this where it is not the first passes where it is."""
    least = -(-PERCENT * (n1 + n2) // (100 + PERCENT))
    return np.minimum(n1 - place1, n2 - place2) >= least


def _near_enough(n1: np.ndarray, odd1: np.ndarray, n2: np.ndarray, odd2: np.ndarray) -> np.ndarray:
    """Whether two sets can have the similarity by their parities (rows of 64-bit words): a bucket of unlike parity holds an element of only one of them."""
    least = -(-PERCENT * (n1 + n2) // (100 + PERCENT))
    return np.bitwise_count(odd1 ^ odd2).sum(axis=-1, dtype=np.int64) <= n1 + n2 - 2 * least


def _starred(element: np.ndarray, group: np.ndarray, n: np.ndarray, place: np.ndarray, reduced: np.ndarray, all_short: bool):
    """Pairs (a, b) of groups that share an element, members (posting, a: group, b: place, n) of long postings, and the columns of
    what is left once of each long posting only its hub is.

    Pairs are, of long postings, each group with the hub, the one with the fewest elements before the shared one, and with
    the next; of the others, if all_short, all. A posting counts as long if a part of it was reduced before."""
    order = np.lexsort((group, n, place, element))
    element, group, n, place, reduced = (c[order] for c in (element, group, n, place, reduced))
    if not len(element):
        none = np.zeros(0, np.uint64)
        return none, none, {"posting": none, "a": none, "b": none, "n": none}, [none] * 5
    new = np.concatenate([[True], (element[1:] != element[:-1]) | (group[1:] != group[:-1])])
    run = np.cumsum(new) - 1
    reduced = np.maximum.reduceat(reduced, np.flatnonzero(new))
    element, group, n, place = element[new], group[new], n[new], place[new]
    first = np.flatnonzero(np.concatenate([[True], element[1:] != element[:-1]]))
    size = np.diff(np.append(first, len(element)))
    run_size, run_first = np.repeat(size, size), np.repeat(first, size)
    pairs = [(np.zeros(0, np.uint64),) * 2]

    def pair(i: np.ndarray, j: np.ndarray) -> None:
        fits = _can_link(n[i], place[i], n[j], place[j])
        i, j = i[fits], j[fits]
        pairs.append((np.minimum(group[i], group[j]), np.maximum(group[i], group[j])))

    for d in range(1, LONG):
        i = np.flatnonzero((run_size > d) & ((all_short & (run_size <= LONG)) | ((d == 1) & (run_size > LONG))))
        i = i[i + d < run_first[i] + run_size[i]]
        pair(i, i + d)
    far = np.flatnonzero((run_size > LONG) & (np.arange(len(element)) > run_first))
    pair(run_first[far], far)
    left, right = (np.concatenate(side) for side in zip(*pairs))
    order = np.lexsort((right, left))
    left, right = left[order], right[order]
    new = np.concatenate([np.ones(min(1, len(left)), bool), (left[1:] != left[:-1]) | (right[1:] != right[:-1])])
    # A member that cannot link even with the least place and the best size of others is of no use in the second round.
    least = -(-PERCENT * (n + -(-n * PERCENT // 100)) // (100 + PERCENT))
    before = np.repeat(np.maximum.reduceat(reduced, first), size) > 0
    member = ((run_size > LONG) | before) & (n - place >= least)
    members = {"posting": element[member], "a": group[member], "b": place[member], "n": n[member]}
    kept = (run_size <= LONG) | (np.arange(len(element)) == run_first)
    reduced = np.maximum(reduced, (run_size > LONG).astype(np.uint64))
    return left[new], right[new], members, [element[kept], group[kept], n[kept].astype(np.uint64), place[kept].astype(np.uint64), reduced[kept]]


def _meet(frame: pd.DataFrame) -> pd.DataFrame:
    """The pairs (a, b) and members (posting, a, b, n) that _starred() finds in the blocks of one hash range."""
    element, group, n, place, reduced = (np.concatenate(c) for c in zip(*map(unpack_block, frame["block"])))
    left, right, members, _ = _starred(element, group, n.astype(np.int64), place.astype(np.int64), reduced, all_short=True)
    members = {c: v.astype(np.int64) for c, v in members.items()}
    rows = [pd.DataFrame({"posting": pd.array([None] * len(left), "Int64"), "a": left.astype(np.int64), "b": right.astype(np.int64), "n": 0})]
    rows.append(pd.DataFrame(members | {"posting": pd.array(members["posting"], "Int64")}))
    return pd.concat(rows)


def _apart(frame: pd.DataFrame) -> pd.DataFrame:
    """Pairs (u, v) of signatures in different components that one posting holds and that can link; of pairs of blocks (x, y) of postings."""
    found = [np.zeros((0, 2), object)]
    for (_, x, y), own in frame.groupby(["posting", "x", "y"], sort=False):
        label, sig = pd.factorize(own["label"])[0], own["sig"].to_numpy()
        n, place, block = (own[c].to_numpy() for c in ("n", "place", "block"))
        odd = np.frombuffer(b"".join(own["odd"]), np.uint64).reshape(len(own), -1)
        one, two = np.flatnonzero(block == x), np.flatnonzero(block == y)
        for i in one:
            js = two[two > i] if x == y else two
            js = js[(label[js] != label[i]) & _can_link(n[i], place[i], n[js], place[js])]
            js = js[_near_enough(n[i], odd[i], n[js], odd[js])]
            found.append(np.stack([np.full(len(js), sig[i], object), sig[js]], axis=1))
    pairs = np.concatenate(found)
    low = [(min(u, v), max(u, v)) for u, v in pairs.tolist()]
    return pd.DataFrame(list(dict.fromkeys(low)), columns=["u", "v"])


def _between_components(held: DataFrame) -> DataFrame | None:
    """Pairs (u, v) of members of held (posting, sig, n, odd, place, label), a cut table, that share a posting but no component and can link.

    The members of a posting stand in blocks of about ROUND_BLOCK: a component with more has blocks of its own, the others share
    some. Only blocks of different components meet, each pair of blocks as one group. None if no posting has two components."""
    sizes = cut(held.groupBy("posting", "label").agg(F.count("*").alias("members")), "sizes")
    large = F.col("members") > ROUND_BLOCK
    apart = sizes.groupBy("posting").agg(F.count("*").alias("labels"), F.sum(F.when(~large, F.col("members"))).alias("_rest")).where("labels > 1")
    sizes = cut(sizes.join(apart, "posting").select("posting", "label", "members", F.ceil(F.coalesce("_rest", F.lit(0)) / ROUND_BLOCK).alias("_shared")), "sizes")
    if sizes.isEmpty():
        return None
    own = F.concat(F.hex("label"), F.lit("/"), F.pmod(F.xxhash64("sig"), F.ceil(F.col("members") / ROUND_BLOCK)))
    block = F.when(large, own).otherwise(F.concat(F.lit("/"), F.pmod(F.xxhash64("label"), F.greatest("_shared", F.lit(1)))))
    members = cut(held.join(sizes, ["posting", "label"]).select("posting", "sig", "n", "odd", "place", "label", block.alias("block"), F.when(large, F.col("label")).alias("_whose")), "members")
    blocks = cut(members.groupBy("posting", "block").agg(F.first("_whose").alias("_whose")), "blocks")
    one, two = blocks.select("posting", F.col("block").alias("x"), F.col("_whose").alias("_x")), blocks.select("posting", F.col("block").alias("y"), F.col("_whose").alias("_y"))
    meet = one.join(two, "posting").where((F.col("x") <= F.col("y")) & ~F.coalesce(F.col("_x") == F.col("_y"), F.lit(False))).select("posting", "x", "y")
    meet = cut(meet, "meet")
    sides = members.join(meet.select("posting", F.col("x").alias("block"), "x", "y"), ["posting", "block"]).unionByName(members.join(meet.where("x <> y").select("posting", F.col("y").alias("block"), "x", "y"), ["posting", "block"]))
    sides = cut(sides.select("posting", "x", "y", "sig", "n", "odd", "place", "label", "block"), "sides")
    parts = max(1, sides.count() // ROUND_ROWS)
    return sides.withColumn("part", F.pmod(F.xxhash64("posting", "x", "y"), F.lit(parts))).groupBy("part").applyInPandas(_apart, "u binary, v binary").distinct()


def _verified(pairs: DataFrame, classes: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs (u, v) of signatures whose sets reach the similarity, as a cut table.

    Of a pair, the one in more pairs is the hub: sets of the others are dealt out to groups of about AROUND_HUB with one copy of the hub's, which streams first."""
    ends = pairs.select(F.col("u").alias("sig"), F.col("v").alias("other")).unionByName(pairs.select(F.col("v").alias("sig"), F.col("u").alias("other")))
    degrees = cut(ends.groupBy("sig").agg(F.count("*").alias("degree")), "degrees")
    needed = cut(degrees.join(classes, "sig").select(F.col("one.id").alias("id2"), F.col("one.row").alias("row2"), "sig"), "needed")
    whose = join_sized(rows, needed, rows["id"].eqNullSafe(needed["id2"]) & (rows["row"] == needed["row2"]), "inner").select("sig", "body")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()  # rows alike in id and text give one set a task
        for batch in batches:
            new = [i for i, sig in enumerate(batch.column("sig").to_pylist()) if not (sig in seen or seen.add(sig))]
            found = [x.tobytes() for x in shingle_sets([x or b"" for x in batch.column("body").take(pa.array(new, pa.int64())).to_pylist()])]
            yield pa.RecordBatch.from_arrays([batch.column("sig").take(pa.array(new, pa.int64())), pa.array(found, pa.binary())], ["sig", "elements"])

    whole = cut(whose.mapInArrow(frugal(sets), "sig binary, elements binary"), "sets")
    side = lambda c: degrees.select(F.col("sig").alias(c), F.col("degree").alias(f"degree_{c}"))
    sided = pairs.select("u", "v").join(side("u"), "u").join(side("v"), "v")
    first = F.col("degree_u") >= F.col("degree_v")
    dealt = sided.select(F.when(first, F.col("u")).otherwise(F.col("v")).alias("hub"), F.when(first, F.col("v")).otherwise(F.col("u")).alias("leaf"), F.ceil(F.greatest("degree_u", "degree_v") / AROUND_HUB).alias("deals"))
    dealt = cut(dealt.select("hub", "leaf", F.pmod(F.xxhash64("leaf"), F.col("deals")).alias("deal")), "dealt")
    hubs = dealt.groupBy("hub", "deal").agg(F.lit(None).cast("binary").alias("leaf"))
    asked = dealt.select("hub", "deal", "leaf", F.col("leaf").alias("sig")).unionByName(hubs.select("hub", "deal", "leaf", F.col("hub").alias("sig")))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a = np.zeros(0, np.uint64)
        for batch in batches:
            keep = []
            for leaf, elements in zip(batch.column("leaf").to_pylist(), batch.column("elements").to_pylist()):
                b = np.frombuffer(elements, np.uint64)
                if leaf is None:
                    a = b
                    keep.append(False)
                    continue
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([batch.column("hub"), batch.column("leaf")], ["u", "v"]).filter(pa.array(keep, pa.bool_()))

    groups = asked.join(whole, "sig").repartition("hub", "deal").sortWithinPartitions("hub", "deal", F.col("leaf").asc_nulls_first())
    return cut(groups.select("hub", "leaf", "elements").mapInArrow(frugal(compare), "u binary, v binary"), "links")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id_col, row (hash of the text), n_shingles, component_id of every document.

    Documents link at Jaccard similarity PERCENT / 100 or more of their shingle sets; component_id is the smallest
    id that links reach, the own one included. Documents of equal sets form a class and are linked. A text
    without words, or null, has an empty set and is linked with nothing; one of fewer than WORDS words is one
    shingle. Null ids take part, but are no component_id unless all of a component are null. Repeated rows are
    alike; an empty table gives an empty result; other columns are not read. Shingles are compared by 64-bit hashes;
    a text and its set are held in memory whole, one at a time."""
    spark = docs.sparkSession
    tune_arrow(spark)
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(body).alias("row"), body.cast("binary").alias("body"))
    volume = rows.agg(F.sum(F.length("body"))).first()[0] or 0
    bits = max(4, int(np.ceil(np.log2(max(1, volume / 12 / IN_RANGE)))))
    frequent = spark.sparkContext.broadcast(_frequent(rows, bits))
    marked = cut(_mark(rows, bits, frequent), "marked")
    frequent.unpersist()  # the table is written
    members = marked.where("sig is not null").select("id", "row", "n", "sig", "odd", "grp")
    blocks = marked.where("range is not null").select("range", "block")
    blocks = _finer(blocks, bits) if bits > COARSE_BITS else blocks
    met = cut(blocks.groupBy("range").applyInPandas(_meet, "posting bigint, a bigint, b bigint, n bigint"), "met")
    met = met.select("posting", "a", "b").unionByName(marked.where("a is not null").select("posting", "a", "b"))
    classes = cut(members.where("n > 0").groupBy("sig").agg(F.min(F.struct("id", "row")).alias("one"), F.min("id").alias("least"), F.count("*").alias("rows"), F.first("grp").alias("grp"), F.first("n").alias("n"), F.first("odd").alias("odd")), "classes")
    groups = cut(classes.groupBy("grp").agg(F.min("sig").alias("sig"), F.count("*").alias("many")), "groups")

    pairs = cut(met.where("posting is null").select("a", "b").distinct(), "group_pairs")
    across = pairs.join(groups.select(F.col("grp").alias("a"), F.col("sig").alias("u")), "a").join(groups.select(F.col("grp").alias("b"), F.col("sig").alias("v")), "b").select("u", "v")
    inside = classes.select("grp", F.col("sig").alias("v")).join(groups.where("many > 1").select("grp", F.col("sig").alias("u")), "grp").where("u <> v").select("u", "v")
    tried = cut(across.unionByName(inside).distinct(), "pairs")
    links = _verified(tried, classes, rows)
    labels = cut(components(links), "labels")

    # What the first round has not joined: long postings, groups with several sets, and pairs with such a group.
    several = groups.where("many > 1").select("grp")
    marks = lambda c: several.select(F.col("grp").alias(c), F.lit(True).alias(f"several_{c}"))
    mixed = pairs.join(marks("a"), "a", "left").join(marks("b"), "b", "left").where("several_a or several_b").select("a", "b")
    mixed = mixed.select(F.xxhash64("a", "b").alias("posting"), F.explode(F.array("a", "b")).alias("grp")).unionByName(several.select(F.col("grp").alias("posting"), "grp"))
    posted = met.where("posting is not null").select("posting", F.col("a").alias("grp"), F.col("b").alias("place")).unionByName(mixed.withColumn("place", F.lit(0).cast("bigint")))
    held = posted.join(classes.select("grp", "sig", "n", "odd"), "grp").join(labels.select(F.col("node").alias("sig"), "label"), "sig", "left").select("posting", "sig", "n", "odd", "place", F.coalesce("label", "sig").alias("label"))
    held = cut(held, "held")
    again = _between_components(held)
    if again is not None:
        tried = tried.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v"))
        more = _verified(cut(again.join(tried, ["u", "v"], "left_anti"), "pairs"), classes, rows)
        if not more.isEmpty():
            labels = cut(components(links.unionByName(more)), "labels")
    known = labels.select(F.col("node").alias("sig"), "label")
    joined = classes.join(known, "sig", "left").withColumn("label", F.coalesce("label", "sig"))
    least = joined.groupBy("label").agg(F.min("least").alias("component_id"))
    per_class = cut(joined.join(least, "label").select("sig", "rows", "component_id"), "components")
    out = join_back(members, per_class, ["sig"], "rows", members.count())
    own = F.when(F.col("n") == 0, F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "row", F.col("n").alias("n_shingles"), own.alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each component of near_duplicates() stays, that of the smallest id; columns stay as they are.

    Rows alike in id and text are one document here. Where all ids of a component are null, all stay. Other columns may have any names."""
    found = near_duplicates(docs)
    lost = cut(found.where("component_id is not null and not doc_id <=> component_id").select(F.col("doc_id").alias("_ink_id"), F.col("row").alias("_ink_row")).distinct(), "lost")
    boxed = docs.select(F.struct("*").alias("_ink_doc"))  # whatever the columns' names
    same = F.col("_ink_doc.doc_id").eqNullSafe(F.col("_ink_id")) & (F.xxhash64(F.coalesce("_ink_doc.text", F.lit(""))) == F.col("_ink_row"))
    return join_sized(boxed, lost, same, "left_anti").select("_ink_doc.*")
