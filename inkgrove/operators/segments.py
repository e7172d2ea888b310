"""A lexical index that grows by segments: a change indexes only what changed.

Every change writes one immutable segment (a table of its blocks' words and places) and the list of the notes that it replaces or removes. A manifest names the
segments in force, the lists, and the number and total length of the live blocks, so that a ranking has the statistics of a whole index. A block
is dead if its note is on a list younger than its segment. Compaction copies what is alive into one segment. A manifest's number is the index's generation:
readers that hold an older one keep reading its files until they are removed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.operators.retrieval import BLOCK, LexicalIndex, write_index, written_places, written_postings
from inkgrove.plans import manifests
from inkgrove.plans.shared import BROADCAST_ROWS

#: Compaction is due with more segments than this, or more dead blocks than this share.
MAX_SEGMENTS, MAX_DEAD = 16, 0.3


def _segment(blocks: DataFrame, path: str) -> dict:
    """Write the words and places of blocks."""
    write_index(blocks, f"{path}/rows")
    rows, words = written_places(blocks.sparkSession.read.parquet(f"{path}/rows")).agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
    return {"path": path, "rows": rows, "words": words}


def _read(spark: SparkSession, body: dict) -> DataFrame:
    """The places of all segments, with the generation of each."""
    out = None
    for s in body["segments"]:
        rows = written_places(spark.read.parquet(f"{s['path']}/rows")).withColumn("_generation", F.lit(s["generation"]))
        out = rows if out is None else out.unionByName(rows)
    return out


def _rows(spark: SparkSession, body: dict) -> DataFrame:
    """Words and places of all segments, of dead blocks too."""
    return spark.read.parquet(*[f"{s['path']}/rows" for s in body["segments"]])


def _gone(spark: SparkSession, body: dict) -> DataFrame | None:
    """(id, _until): each replaced note's blocks of an earlier generation than _until are dead."""
    out = None
    for g in body.get("gone", []):
        rows = spark.read.parquet(g["path"]).select("id", F.lit(g["generation"]).alias("_until"))
        out = rows if out is None else out.unionByName(rows)
    return None if out is None else out.groupBy("id").agg(F.max("_until").alias("_until"))


def _judged(spark: SparkSession, body: dict, how: str) -> DataFrame:
    """Places that a list names (left_semi) or that none does (left_anti)."""
    gone = _gone(spark, body)
    if gone is None:
        return _read(spark, body) if how == "left_anti" else _read(spark, body).limit(0)
    few = sum(g["rows"] for g in body["gone"]) <= BROADCAST_ROWS
    gone = gone.withColumnRenamed("id", "_gone")
    return _read(spark, body).join(F.broadcast(gone) if few else gone, (F.col("id") == F.col("_gone")) & (F.col("_generation") < F.col("_until")), how)


def live(spark: SparkSession, body: dict) -> DataFrame:
    """Places of the live blocks of a manifest, which must have a segment."""
    return _judged(spark, body, "left_anti").drop("_generation")


def open_index(spark: SparkSession, root: str) -> LexicalIndex:
    """The index as of its latest generation."""
    number, body = manifests.latest(spark, root)
    if not body.get("segments"):
        raise FileNotFoundError(f"no index at {root}")
    return LexicalIndex(written_postings(_rows(spark, body)), live(spark, body), float(body["rows"]), body["words"] / body["rows"] if body["rows"] else 0.0, number)


def upsert(root: str, blocks: DataFrame, ids: DataFrame, mark: dict | None = None) -> int:
    """Replace the blocks of the notes ids (id) by blocks; a note without blocks is removed. Returns the generation.

    Only blocks is tokenised. Repeated ids count once, null ids match nothing. mark goes into the manifest. A
    concurrent change makes this one look again: its segment stays as it is, only what it replaces is counted anew."""
    spark, path = blocks.sparkSession, f"{root}/segments/{uuid.uuid4().hex}"
    added = _segment(blocks, path)
    ids.select("id").where("id is not null").distinct().write.parquet(f"{path}/gone")
    gone = spark.read.parquet(f"{path}/gone")
    n_gone = gone.count()

    def attempt(number: int, body: dict) -> dict:
        rows, words = body.get("rows", 0), body.get("words", 0)
        if body.get("segments") and n_gone:
            dead = live(spark, body).join(F.broadcast(gone) if n_gone <= BROADCAST_ROWS else gone, "id", "left_semi")
            lost = dead.agg(F.count("*"), F.coalesce(F.sum("dl"), F.lit(0))).first()
            rows, words = rows - lost[0], words - lost[1]
        lists = body.get("gone", []) + ([{"path": f"{path}/gone", "generation": number + 1, "rows": n_gone}] if body.get("segments") and n_gone else [])
        segments = body.get("segments", []) + [added | {"generation": number + 1}]
        return {"segments": segments, "gone": lists, "rows": rows + added["rows"], "words": words + added["words"], **_marks(body, mark)}

    return manifests.commit(spark, root, attempt)


def _marks(body: dict, mark: dict | None) -> dict:
    return {"mark": mark if mark is not None else body.get("mark")}


def compaction_due(body: dict) -> bool:
    held = sum(s["rows"] for s in body.get("segments", []))
    return len(body.get("segments", [])) > MAX_SEGMENTS or held - body.get("rows", 0) > MAX_DEAD * max(held, 1)


def compact(spark: SparkSession, root: str) -> int:
    """Copy what is alive into one segment, without tokenising anything; the lists of replaced notes end. Refused if others kept changing the index."""

    def attempt(number: int, body: dict) -> dict | None:
        if not body.get("segments") or len(body["segments"]) == 1 and not body["gone"]:
            return None
        path = f"{root}/segments/{uuid.uuid4().hex}"
        dead = _judged(spark, body, "left_semi").select(*BLOCK)
        few = sum(s["rows"] for s in body["segments"]) - body["rows"] <= BROADCAST_ROWS
        kept = _rows(spark, body).join(F.broadcast(dead) if few else dead, [*BLOCK], "left_anti")
        kept.sortWithinPartitions("term", *BLOCK).write.option("compression", "zstd").parquet(f"{path}/rows")
        return {"segments": [{"path": path, "rows": body["rows"], "words": body["words"], "generation": number + 1}], "gone": [], "rows": body["rows"], "words": body["words"], **_marks(body, None)}

    return manifests.commit(spark, root, attempt)


def refresh(root: str, notes: DataFrame, blocks: DataFrame, mark: dict | None = None) -> int:
    """Bring the index to the state of notes (id, hash) and their blocks: only notes whose hash is new or changed are indexed, and those
    that are no longer there are removed. The hashes of the indexed state are kept beside the index."""
    spark = notes.sparkSession
    _, body = manifests.latest(spark, root)
    states = f"{root}/states/{uuid.uuid4().hex}"
    # Notes that share an id change if any of them does.
    notes.where("id is not null").groupBy("id").agg(F.concat_ws(":", F.count("*"), F.min("hash"), F.max("hash"), F.bit_xor(F.xxhash64("hash"))).alias("hash")).write.parquet(states)
    now = spark.read.parquet(states)
    before = (body.get("mark") or {}).get("states")
    if before is None:
        return upsert(root, blocks, now.select("id").limit(0) if not body.get("segments") else live(spark, body).select("id"), {**(mark or {}), "states": states})
    old = spark.read.parquet(before).select("id", F.col("hash").alias("was"))
    changed = now.join(old, "id", "full").where(~F.col("hash").eqNullSafe(F.col("was"))).select("id")
    path = f"{root}/changed/{uuid.uuid4().hex}"
    changed.write.parquet(path)
    ids = spark.read.parquet(path)
    few = ids.count() <= BROADCAST_ROWS
    return upsert(root, blocks.join(F.broadcast(ids) if few else ids, "id", "left_semi"), ids, {**(mark or {}), "states": states})
