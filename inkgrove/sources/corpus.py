"""The corpus views that the queries run on, derived from the input tables.

The input has documents but no notes, rings or validity, so those follow from doc_id by fixed rules, stated
once here and once, in the same terms, in SQL (NOTES_SQL and the rest)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.functions.scalars import citation
from inkgrove.session import table

#: 2024-01-01 UTC, and the moment the queries call now (2024-03-01 UTC).
EPOCH, NOW = 1704067200, 1709251200


def notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("doc_id")
    at = lambda seconds: F.timestamp_seconds(seconds)
    created = F.lit(EPOCH) + i * 3600
    return table(spark, sf_dir, "documents").select(
        i.alias("id"),
        F.concat(F.lit("note-"), i).alias("name"),
        (i % 5).cast("int").alias("ring"),
        F.when(i % 11 != 0, F.col("source")).alias("bereich"),
        "lang",
        "text",
        at(created).alias("created"),
        at(created + i % 13 * 86400).alias("updated"),
        F.when(i % 17 == 0, at(created + 864000)).alias("valid_from"),
        F.when(i % 19 == 0, at(created + 8640000)).alias("invalid_at"),
        F.when(i % 23 == 0, F.concat(F.lit("note-"), i + 1)).alias("superseded_by"),
        F.when(i % 29 == 0, F.array(F.concat(F.lit("note-"), i - 1), F.concat(F.lit("note-"), i - 6))).otherwise(F.array().cast("array<string>")).alias("supersedes"),
        F.when(i % 7 == 0, "P30D").when(i % 7 == 1, "P1Y").when(i % 7 == 2, "P1M").when(i % 7 == 3, "soon").alias("retention"),
    )


NOTES_SQL = f"""notes AS (
    SELECT doc_id AS id, 'note-' || doc_id AS name, CAST(doc_id % 5 AS INT) AS ring, CASE WHEN doc_id % 11 <> 0 THEN source END AS bereich, lang, text,
           {EPOCH} + doc_id * 3600 AS created, {EPOCH} + doc_id * 3600 + doc_id % 13 * 86400 AS updated,
           CASE WHEN doc_id % 17 = 0 THEN {EPOCH} + doc_id * 3600 + 864000 END AS valid_from,
           CASE WHEN doc_id % 19 = 0 THEN {EPOCH} + doc_id * 3600 + 8640000 END AS invalid_at,
           CASE WHEN doc_id % 23 = 0 THEN 'note-' || (doc_id + 1) END AS superseded_by,
           CASE WHEN doc_id % 29 = 0 THEN ['note-' || (doc_id - 1), 'note-' || (doc_id - 6)] ELSE [] END AS supersedes,
           CASE doc_id % 7 WHEN 0 THEN 'P30D' WHEN 1 THEN 'P1Y' WHEN 2 THEN 'P1M' WHEN 3 THEN 'soon' END AS retention
    FROM documents)"""


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per non-empty line, with ring, department and name carried along so filters need no join."""
    return blocks_of(notes(spark, sf_dir))


def blocks_of(rows: DataFrame) -> DataFrame:
    """The blocks of notes."""
    lines = rows.select("id", "name", "ring", "bereich", "created", "updated", F.posexplode(F.split("text", "\n")).alias("idx", "text")).where("text <> ''")
    return lines.withColumn("citation", citation(F.col("ring"), F.col("id"), F.col("idx"), F.col("text")))


BLOCKS_SQL = """blocks AS (
    SELECT id, name, ring, bereich, created, updated, i - 1 AS idx, lines[i] AS text,
           'r' || ring || '-' || substr(sha256(id || ':' || (i - 1) || ':' || lines[i]), 1, 12) AS citation
    FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS lines FROM notes))
    WHERE lines[i] <> '')"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(from_id, pos, to_name): two links from every note to names over the whole table and a little beyond, where no note is."""
    d = table(spark, sf_dir, "documents")
    n = d.count() * 13 // 10 + 1
    to = lambda a, b: F.concat(F.lit("note-"), (F.col("doc_id") * a + b) % n)
    return d.select(F.col("doc_id").alias("from_id"), F.posexplode(F.array(to(7, 3), to(13, 5))).alias("pos", "to_name"))


LINKS_SQL = """links AS (
    SELECT doc_id AS from_id, p.pos, 'note-' || (CASE p.pos WHEN 0 THEN doc_id * 7 + 3 ELSE doc_id * 13 + 5 END % n) AS to_name
    FROM documents, (VALUES (0), (1)) p(pos), (SELECT count(*) * 13 // 10 + 1 AS n FROM documents))"""


def audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event stream as an audit log: seq, at, actor, action, subject, detail (JSON)."""
    return table(spark, sf_dir, "events").select(
        F.col("event_id").alias("seq"), F.col("ts").alias("at"), F.concat(F.lit("user-"), "user_id").alias("actor"), F.concat(F.lit("note."), "event_type").alias("action"), F.concat(F.lit("note-"), F.col("user_id") % 40).alias("subject"), F.col("props").alias("detail"), "value"
    )


AUDIT_SQL = """audit AS (
    SELECT event_id AS seq, ts AS "at", 'user-' || user_id AS actor, 'note.' || event_type AS action, 'note-' || (user_id % 40) AS subject, props AS detail, value FROM events)"""


def with_sql(*views: str) -> str:
    return "WITH " + ", ".join({"notes": NOTES_SQL, "blocks": BLOCKS_SQL, "links": LINKS_SQL, "audit": AUDIT_SQL}[v] for v in views)
