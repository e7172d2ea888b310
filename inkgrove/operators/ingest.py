"""Import plans: groups, cutting, names, collisions, ledgers and stale notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.functions.scalars import MAX_NAME, glob_regex
from inkgrove.plans.shared import cut, join_back


def assign_group(files: DataFrame, skips: list[str], groups: list[tuple[str, list[str]]]) -> DataFrame:
    """files (path) with group: the first whose globs match; "skipped" where a skip glob does, null where nothing does."""
    match = lambda globs: F.lit(False) if not globs else F.col("path").rlike("|".join(f"(?:{glob_regex(g)})" for g in globs))
    out = F.when(match(skips), "skipped")
    for name, globs in groups:
        out = out.when(match(globs), name)
    return files.withColumn("group", out)


def cut_sections(files: DataFrame, content: str = "content", by: str = "heading", delimiter: str = "---") -> DataFrame:
    """One row per part (idx, part); joined again, the parts are the whole content."""
    pattern = r"(?m)(?=^#{1,6}[ \t])" if by == "heading" else rf"(?m)(?<=^{delimiter}\n)"
    parts = F.array(F.col(content)) if by == "file" else F.filter(F.split(content, pattern), lambda p: p != "")
    return files.select("*", F.posexplode(parts).alias("idx", "part"))


def resolve_collisions(items: DataFrame, mode: str = "report") -> DataFrame:
    """items (name, path, body) with outcome and final_name; paths are unique.

    The first path of a name that bodies share keeps it and the others are its duplicates; where bodies differ, all collide, or in mode
    "hash" each gets a suffix of its body's hash. Names are summed up map-side and joined back safely, so one name may hold most items."""
    rows = cut(items.withColumn("_d", F.sha2("body", 256)), "items")
    per = cut(rows.groupBy("name").agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"), F.min("path").alias("_path"), F.count("*").alias("_n")), "names")
    rows = join_back(rows, per, ["name"], "_n", rows.count())
    same = F.col("_lo") == F.col("_hi")
    suffix = F.concat(F.substring("name", 1, MAX_NAME - 9), F.lit("-"), F.substring("_d", 1, 8))
    outcome = F.when(same & (F.col("path") == F.col("_path")), "written").when(same, "duplicate").otherwise(F.lit("collided" if mode == "report" else "written"))
    final = F.when(same, F.col("name")).otherwise(F.lit(None) if mode == "report" else suffix)
    return rows.select(*items.columns, outcome.alias("outcome"), final.alias("final_name"))


OUTCOMES = ("written", "unchanged", "updated", "held", "duplicate", "collided", "exists", "failed")


def ledger(items: DataFrame) -> DataFrame:
    """One row: found, a count for each outcome, and balanced (the outcomes add up to found)."""
    counts = [F.count_if(F.col("outcome") == o).alias(o) for o in OUTCOMES]
    return items.agg(F.count("*").alias("found"), *counts).withColumn("balanced", F.col("found") == sum((F.col(o) for o in OUTCOMES), F.lit(0)))


def stale(notes: DataFrame, sources: DataFrame) -> DataFrame:
    """Notes whose src: tag names a source that is gone; notes (name, tags), sources (source)."""
    tagged = notes.select("name", F.explode(F.filter("tags", lambda t: t.startswith("src:"))).alias("tag"))
    return tagged.withColumn("source", F.expr("substring(tag, 5)")).join(sources, "source", "left_anti").select("name", "source").distinct()


def resident_projection(items: DataFrame, tokens: Column, cap: int = 8192) -> DataFrame:
    """(resident_tokens, fits) of what rings 0 and 1 would hold."""
    return items.where("ring <= 1").agg(F.coalesce(F.sum(tokens), F.lit(0)).alias("resident_tokens")).withColumn("fits", F.col("resident_tokens") <= cap)


def heads(files: DataFrame, parsed: DataFrame) -> DataFrame:
    """files (path, content) with head: none without an opening fence, own where parsed (path, error) could read it, else foreign, with the reason."""
    first = F.substring_index(F.regexp_replace("content", "^\\x{FEFF}", ""), "\n", 1)
    fenced = F.regexp_replace(first, "\\r+$", "") == "---"
    told = files.join(parsed.select("path", "error"), "path", "left")
    head = F.when(~fenced, "none").when(F.col("error").isNull(), "own").otherwise("foreign")
    return told.select(*files.columns, head.alias("head"), F.when(fenced, F.col("error")).alias("reason"))


def suggest_groups(files: DataFrame, min_files: int = 3) -> DataFrame:
    """(folder, files, bytes, with_head, suggestion) of a tree's files (path, size, head): import folders of min_files Markdown files at least, review those with
    fewer, skip those without. Largest first."""
    folder = F.when(F.col("path").contains("/"), F.regexp_extract("path", "^(.*)/[^/]*$", 1)).otherwise(F.lit("."))
    markdown = F.lower("path").rlike(r"\.(?:md|markdown)$")
    per = files.groupBy(folder.alias("folder")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_if(markdown).alias("_md"), F.count_if(F.col("head") == "own").alias("with_head"))
    word = F.when(F.col("_md") >= min_files, "import").when(F.col("_md") > 0, "review").otherwise("skip")
    return per.select("folder", "files", "bytes", "with_head", word.alias("suggestion")).orderBy(F.desc("files"), "folder")
