"""Notes and what is derived from them: lookups, expansion of citations, replacing and deleting, reading lists within a budget."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrove.functions.scalars import name_problem
from inkgrove.plans.shared import cut, join_sized


#: Hits that a reading list is made from at most.
MOST_READ = 1000


def lookup(notes: DataFrame, ids: list | None = None, names: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Notes by id, by name, or by the beginning of the name; a literal list, so that the scan is pruned."""
    fits: Column = F.lit(False)
    if ids:
        fits = fits | F.col("id").isin(ids)
    if names:
        fits = fits | F.col("name").isin(names)
    if prefix:
        fits = fits | F.col("name").startswith(prefix)
    return notes.where(fits)


def expand(places: DataFrame, blocks: DataFrame, cited: DataFrame, around: int = 1) -> DataFrame:
    """(citation, id, idx, text, distance) of the blocks up to so many places before and after each cited one, of the same note.

    places (citation, id, idx) tells where a citation stands, without text; cited (citation), a cut table, is what is asked for. A citation that no
    block has gives nothing."""
    found = cut(join_sized(places.select("citation", "id", "idx"), cited, ["citation"], "inner").select(F.col("citation").alias("asked"), "id", F.col("idx").alias("_at")), "asked")
    near = join_sized(blocks.select("citation", "id", "idx", "text"), found, ["id"], "inner").where(F.abs(F.col("idx") - F.col("_at")) <= around)
    return near.select("asked", "citation", "id", "idx", "text", (F.col("idx") - F.col("_at")).alias("distance"))


def problems(notes: DataFrame, blocks: DataFrame, dims: int | None = None, vectors: DataFrame | None = None) -> DataFrame:
    """(id, problem) of what must not be written: a bad name or ring, places that are not 0, 1, 2 and so on, vectors of other dimensions."""
    named = notes.select("id", F.coalesce(F.concat(F.lit("name "), name_problem(F.col("name"))), F.when(~F.coalesce(F.col("ring").between(0, 4), F.lit(False)), "ring")).alias("problem"))
    gaps = blocks.groupBy("id").agg(F.count("*").alias("n"), F.count_distinct("idx").alias("d"), F.max("idx").alias("last"))
    gaps = gaps.select("id", F.when((F.col("n") != F.col("d")) | (F.col("last") != F.col("n") - 1), "places").alias("problem"))
    out = named.unionByName(gaps)
    if vectors is not None and dims is not None:
        out = out.unionByName(vectors.where(F.size("vector") != dims).select("id", F.lit("dimensions").alias("problem")))
    return out.where("problem is not null").distinct()


def replace(tables: dict[str, DataFrame], new: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """tables (notes, blocks, links, vectors, each with id or from_id) with all rows of the notes in new["notes"] replaced by those of new.

    Links of other notes point at names: those that named a note under its old name point at the new one."""
    gone = cut(new["notes"].select("id").distinct(), "replaced")
    keys = {"links": "from_id"}
    out = {}
    for kind, rows in tables.items():
        key = keys.get(kind, "id")
        kept = join_sized(rows, gone, rows[key] == gone["id"], "left_anti")
        out[kind] = kept.unionByName(new[kind].select(*rows.columns)) if kind in new else kept
    before = tables["notes"].select("id", F.col("name").alias("to_name"))
    renamed = cut(before.join(new["notes"].select("id", F.col("name").alias("_now")), "id").where("to_name <> _now").select("to_name", "_now"), "renamed")
    if "links" in out and not renamed.isEmpty():
        links = out["links"]
        out["links"] = join_sized(links, renamed, ["to_name"]).withColumn("to_name", F.coalesce("_now", "to_name")).select(*links.columns)
    return out


def delete(tables: dict[str, DataFrame], ids: DataFrame) -> tuple[dict[str, DataFrame], DataFrame]:
    """(tables without what belongs to the notes in ids, (kind, removed) counts). Links of other notes to them stay, and dangle."""
    gone = cut(ids.select("id").distinct(), "deleted")
    out, counts = {}, None
    for kind, rows in tables.items():
        key = "from_id" if kind == "links" else "id"
        out[kind] = join_sized(rows, gone, rows[key] == gone["id"], "left_anti")
        row = join_sized(rows, gone, rows[key] == gone["id"], "left_semi").agg(F.lit(kind).alias("kind"), F.count("*").alias("removed"))
        counts = row if counts is None else counts.unionByName(row)
    return out, counts


def within_budget(hits: DataFrame, budget: int, tokens: str = "token_count", score: str = "score", key: str = "citation") -> DataFrame:
    """The best hits, MOST_READ at most, with shown: each as long as the tokens of those before leave room for it; one that is too long is passed over
    only together with all after it."""
    hits = hits.orderBy(F.desc(score), key).limit(MOST_READ)
    best = Window.orderBy(F.desc(score), key).rowsBetween(Window.unboundedPreceding, 0)
    return hits.withColumn("shown", F.sum(tokens).over(best) <= budget)


def anchored(symbols: DataFrame, anchors: DataFrame) -> DataFrame:
    """Definitions (path, line, end_line) with the notes whose anchors (id, path, first, last) lie over them."""
    spans = anchors.select(F.col("id").alias("note_id"), "path", "first", "last")
    return symbols.join(spans, "path").where((F.col("first") <= F.col("end_line")) & (F.col("last") >= F.col("line")))


class NothingSelected(ValueError):
    """A filter that matches nothing in a log that is not empty; names what could have been asked for."""


def selected(log: DataFrame, found: DataFrame, column: str = "action", most: int = 50) -> DataFrame:
    """found, unless it is empty though log is not: then NothingSelected, with up to most different values of the column."""
    if found.isEmpty() and not log.isEmpty():
        there = [r[0] for r in log.select(column).distinct().orderBy(column).limit(most).collect()]
        raise NothingSelected(f"no such {column}; there are: {', '.join(map(str, there))}")
    return found
