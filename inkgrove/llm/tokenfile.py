"""Token-ID files: independent zstandard frames with a trailing seek table and per-frame checksums.

A shard is a sequence of frames, each of at most FRAME_IDS ids unless one document is longer, followed by a
skippable frame with the seek table of the public zstd seekable format: compressed size, decompressed size and the
low 32 bits of XXH64 of the contents for each frame, then the number of frames, a flags byte and the magic number. A second
skippable frame before it lists the documents (id, its first token, its frame), so a reader fetches the
two tables from the end of the file and decompresses only the frames that hold the documents asked for.

Shards are written under names of their own and count only if the manifest lists them, so a task
that runs twice leaves a file that nobody reads.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.llm.vocab import encoder
from inkgrove.plans.shared import shared_root, tune_arrow

END_ID = 1
FRAME_IDS = 1 << 16
#: Fixed values of the zstd seekable format.
SKIPPABLE_MAGIC, SEEKABLE_MAGIC, CHECKSUM_FLAG = 0x184D2A5E, 0x8F92EAB1, 0x80
#: Skippable frame of the document table; it ends with a checksum, the number of documents, and of those without an id, which come first.
DOCUMENTS_MAGIC = 0x184D2A5D
_TAIL = struct.Struct("<III")


def _filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri.removeprefix("file:"))


class ShardWriter:
    """Writes documents in the order given; close() returns how many documents and ids there are."""

    def __init__(self, sink, level: int = 3):
        self.sink, self.compressor = sink, zstandard.ZstdCompressor(level=level, write_content_size=True)
        self.held: list[bytes] = []
        self.held_ids = self.ids = self.documents = self.nulls = 0
        self.entries: list[tuple[int, int, int]] = []
        self.table: list[tuple[int, int, int]] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        if self.held and self.held_ids + len(ids) > FRAME_IDS:
            self._flush()
        self.nulls += doc_id is None
        self.table.append((doc_id or 0, self.ids, len(self.entries)))
        self.held.append(ids.astype("<u4").tobytes())
        self.held_ids += len(ids)
        self.ids += len(ids)
        self.documents += 1

    def _flush(self) -> None:
        raw = b"".join(self.held)
        frame = self.compressor.compress(raw)
        self.sink.write(frame)
        self.entries.append((len(frame), len(raw), xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
        self.held, self.held_ids = [], 0

    def close(self) -> tuple[int, int]:
        if self.held:
            self._flush()
        table = np.array([*self.table, (0, self.ids, len(self.entries))], "<i8").T.tobytes()
        packed = self.compressor.compress(table) + _TAIL.pack(xxhash.xxh64_intdigest(table) & 0xFFFFFFFF, len(self.table), self.nulls)
        self.sink.write(struct.pack("<II", DOCUMENTS_MAGIC, len(packed)) + packed)
        seek = b"".join(struct.pack("<III", *e) for e in self.entries)
        # As the seekable format asks, entries cover every frame before the table; the document table is one, of no contents.
        seek += struct.pack("<III", len(packed) + 8, 0, xxhash.xxh64_intdigest(b"") & 0xFFFFFFFF)
        seek += struct.pack("<IBI", len(self.entries) + 1, CHECKSUM_FLAG, SEEKABLE_MAGIC)
        self.sink.write(struct.pack("<II", SKIPPABLE_MAGIC, len(seek)) + seek)
        return self.documents, self.ids


class ShardReader:
    """Random access to the documents of one shard; raises ValueError where a checksum or a magic number is wrong."""

    def __init__(self, source):
        self.source, size = source, source.size()
        count, flags, magic = struct.unpack("<IBI", self._read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags != CHECKSUM_FLAG:
            raise ValueError("no seek table")
        start = size - 9 - 12 * count
        if struct.unpack("<II", self._read(start - 8, 8)) != (SKIPPABLE_MAGIC, 12 * count + 9):
            raise ValueError("broken seek table")
        entries = np.frombuffer(self._read(start, 12 * count), "<u4").reshape(-1, 3)
        self.entries, tail = entries[:-1], int(entries[-1, 0])
        self.at = np.concatenate([[0], np.cumsum(self.entries[:, 0], dtype=np.int64)])
        magic, length = struct.unpack("<II", (head := self._read(int(self.at[-1]), tail))[:8])
        check, documents, self.nulls = _TAIL.unpack(head[-_TAIL.size :])
        table = zstandard.ZstdDecompressor().decompress(head[8 : -_TAIL.size])
        if magic != DOCUMENTS_MAGIC or length != tail - 8 or xxhash.xxh64_intdigest(table) & 0xFFFFFFFF != check:
            raise ValueError("broken document table")
        self.ids, self.starts, self.frames = np.frombuffer(table, "<i8").reshape(3, documents + 1)
        self._frame = (-1, np.zeros(0, np.uint32), 0)

    def _read(self, at: int, size: int) -> bytes:
        self.source.seek(at)
        return self.source.read(size)

    def __len__(self) -> int:
        return len(self.ids) - 1

    def frame(self, k: int) -> np.ndarray:
        if self._frame[0] != k:
            raw = zstandard.ZstdDecompressor().decompress(self._read(int(self.at[k]), int(self.entries[k, 0])))
            if len(raw) != self.entries[k, 1] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != self.entries[k, 2]:
                raise ValueError(f"frame {k} does not match its checksum")
            first = int(self.starts[np.searchsorted(self.frames, k)])
            self._frame = (k, np.frombuffer(raw, "<u4"), first)
        return self._frame[1]

    def document(self, i: int) -> tuple[int | None, int, np.ndarray]:
        """Id, first token and ids of the i-th document."""
        ids = self.frame(int(self.frames[i]))
        a, b = int(self.starts[i]) - self._frame[2], int(self.starts[i + 1]) - self._frame[2]
        return (None if i < self.nulls else int(self.ids[i])), int(self.starts[i]), ids[a:b]

    def find(self, doc_id: int) -> list[np.ndarray]:
        """The documents with this id; only their frames are decompressed."""
        known = self.ids[self.nulls : -1]
        a, b = self.nulls + np.searchsorted(known, doc_id, "left"), self.nulls + np.searchsorted(known, doc_id, "right")
        return [self.document(i)[2] for i in range(a, b)]


def write_token_files(docs: DataFrame, vocabulary: str, folder: str | None = None, text: str = "text", id_col: str = "doc_id", plain_specials: bool = False) -> str:
    """Encode every whole text, end it with END_ID and write all in ascending id order, null ids first. Returns the folder.

    The order runs through the shards as the manifest lists them. folder is a path or URI that all
    executors reach; by default one in the cluster's shared folder. A null text counts as empty; rows that
    share an id stand in the order of a hash of their texts; an empty table gives a manifest without shards. Ids are 64-bit integers.
    Of a very long text all ids are held at once, and it makes one frame. Strings of the vocabulary's special tokens become these
    tokens, unless plain_specials."""
    spark = docs.sparkSession
    tune_arrow(spark)
    folder = folder or f"{shared_root(spark)}/inkgrove/tokens-{uuid.uuid4().hex}"
    fs, path = _filesystem(folder)
    fs.create_dir(path, recursive=True)
    rows = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text).cast("binary").alias("body"))
    rows = rows.withColumn("h", F.xxhash64("body"))  # ranges are sampled by small keys, not by texts
    ordered = rows.repartitionByRange("id", "h").sortWithinPartitions(F.col("id").asc_nulls_first(), "h")
    ordered = ordered.select("id", "body", F.spark_partition_id().alias("part"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        writer, name, part, least, most = None, f"{uuid.uuid4().hex}.tokens", 0, None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                part = batch.column("part")[0].as_py()
                sink = _filesystem(folder)[0].open_output_stream(f"{path}/{name}")
                writer = ShardWriter(sink)
            bodies = [x or b"" for x in batch.column("body").to_pylist()]
            for doc_id, ids in zip(batch.column("id").to_pylist(), encoder(vocabulary, plain_specials).encode(bodies)):
                writer.add(doc_id, np.append(ids, np.uint32(END_ID)))
                least, most = doc_id if least is None else least, doc_id
        if writer is not None:
            documents, ids = writer.close()
            sink.close()
            numbers = [pa.array([x], pa.int64()) for x in (documents, ids, least, most)]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([name]), *numbers], ["part", "name", "documents", "ids", "least", "most"])

    written = ordered.mapInArrow(run, "part int, name string, documents bigint, ids bigint, least bigint, most bigint").collect()  # one row a shard
    shards = [r.asDict() for r in sorted(written, key=lambda r: r.part)]
    with fs.open_output_stream(f"{path}/manifest.json") as out:
        out.write(json.dumps({"end_id": END_ID, "shards": [{k: v for k, v in s.items() if k != "part"} for s in shards]}).encode())
    return folder


def manifest(folder: str) -> list[dict]:
    """The shards in order, with the number of ids before each as start."""
    fs, path = _filesystem(folder)
    with fs.open_input_stream(f"{path}/manifest.json") as f:
        shards, start = json.loads(f.read())["shards"], 0
    for s in shards:
        s["start"] = start
        start += s["ids"]
    return shards


def read_token_files(spark: SparkSession, folder: str, with_ids: bool = False) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids, if with_ids) of every document, shard by shard in parallel."""
    shards = [(s["name"], s["start"]) for s in manifest(folder)]
    names = ["doc_id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids]
    listed = spark.createDataFrame(shards, "name string, start bigint").repartition(max(1, len(shards)), "name")

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in rows], pa.int64()) for k in range(4)]
        return pa.RecordBatch.from_arrays(columns + ([pa.array([r[4] for r in rows], pa.list_(pa.int64()))] if with_ids else []), names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, path = _filesystem(folder)
        for name, start in ((n, s) for b in batches for n, s in zip(b.column("name").to_pylist(), b.column("start").to_pylist())):
            with fs.open_input_file(f"{path}/{name}") as source:
                reader, rows = ShardReader(source), []
                for i in range(len(reader)):
                    doc_id, at, ids = reader.document(i)
                    rows.append((doc_id, start + at, len(ids), zlib.crc32(ids), *[ids.astype(np.int64)] * with_ids))
                    if len(rows) == 1000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return listed.mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids)


def read_documents(folder: str, doc_ids: Iterable[int]) -> dict[int, list[np.ndarray]]:
    """The ids of single documents: opens only the shards whose range of ids, by the manifest, holds them, and decompresses only their frames."""
    fs, path = _filesystem(folder)
    out: dict[int, list[np.ndarray]] = {doc_id: [] for doc_id in doc_ids}
    for s in manifest(folder):
        wanted = [i for i in out if s["most"] is not None and (s["least"] is None or s["least"] <= i) and i <= s["most"]]
        if wanted:
            with fs.open_input_file(f"{path}/{s['name']}") as source:
                reader = ShardReader(source)
                for doc_id in sorted(wanted):
                    out[doc_id] += reader.find(doc_id)
    return out
