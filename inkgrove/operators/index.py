"""Index analytics: counts, integrity, links, shared blocks, components, and incremental maintenance."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrove.functions.scalars import dedup_key
from inkgrove.plans.shared import cut, join_back

SHARED_PERCENT = 50


def stats(notes: DataFrame, blocks: DataFrame, links: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row of counts; dangling links point at no note."""
    dangling = unresolved(links, notes).agg(F.count("*").alias("dangling"))
    one = lambda df, name: df.agg(F.count("*").alias(name))
    return one(notes, "notes").crossJoin(one(blocks, "blocks")).crossJoin(one(links, "links")).crossJoin(dangling).crossJoin(one(vectors, "vectors"))


def resolve(links: DataFrame, notes: DataFrame) -> DataFrame:
    """links with to_id, null where no note has the name."""
    return links.join(notes.select(F.col("name").alias("to_name"), F.col("id").alias("to_id")), "to_name", "left")


def unresolved(links: DataFrame, notes: DataFrame) -> DataFrame:
    return links.join(notes.select(F.col("name").alias("to_name")), "to_name", "left_anti")


def degrees(notes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, links_out, links_in, dangling) of every note."""
    edges = resolve(links, notes)
    out = edges.groupBy(F.col("from_id").alias("id")).agg(F.count("*").alias("links_out"), F.count_if(F.col("to_id").isNull()).alias("dangling"))
    into = edges.where("to_id is not null").groupBy(F.col("to_id").alias("id")).agg(F.count("*").alias("links_in"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("links_out", "links_in", "dangling")]
    return notes.select("id").join(out, "id", "left").join(into, "id", "left").select("id", *zero)


def link_lists(links: DataFrame) -> DataFrame:
    """(from_id, targets): names in the order of their places."""
    ordered = F.array_sort(F.collect_list(F.struct("pos", "to_name")))
    return links.groupBy("from_id").agg(F.transform(ordered, lambda x: x["to_name"]).alias("targets"))


def integrity(notes: DataFrame, blocks: DataFrame, links: DataFrame, vectors: DataFrame) -> DataFrame:
    """(check, problems) for each rule that rows must keep; anti joins throughout."""
    ids = notes.select("id")
    rules = {
        "blocks-without-note": blocks.join(ids, "id", "left_anti"),
        "links-without-note": links.join(ids.withColumnRenamed("id", "from_id"), "from_id", "left_anti"),
        "links-unresolved": unresolved(links, notes),
        "vectors-without-block": vectors.join(blocks.select("citation"), "citation", "left_anti"),
        "notes-without-block": ids.join(blocks.select("id"), "id", "left_anti"),
        "ring-mismatch": blocks.select("id", "ring").join(notes.select("id", F.col("ring").alias("note_ring")), "id").where("ring <> note_ring"),
        "citation-twice": blocks.groupBy("citation").count().where("count > 1"),
    }
    out = None
    for name, bad in rules.items():
        row = bad.agg(F.lit(name).alias("check"), F.count("*").alias("problems"))
        out = row if out is None else out.unionByName(row)
    return out


def shared_blocks(blocks: DataFrame, min_percent: int = SHARED_PERCENT) -> DataFrame:
    """(a, b, shared, smaller): notes of which at least min_percent of the smaller one's different long blocks are the other's too.

    Notes with the same keys are one class: pairs are found between the classes' least notes, and each other note
    of a class is paired with that one, so a block in very many copies is not squared. Of different notes, the smaller of a pair shares one of its
    rarest blocks: only these look for partners, so a line of many different notes meets the notes that hold little else. The partners found are then counted whole."""
    keys = blocks.select("name", dedup_key(F.col("text")).alias("key")).where("key is not null").distinct()
    bags = cut(keys.groupBy("name").agg(F.array_sort(F.collect_list("key")).alias("keys")).withColumn("bag", F.sha2(F.concat_ws(",", "keys"), 256)).withColumn("n", F.size("keys").cast("bigint")), "bags")
    least = cut(bags.groupBy("bag").agg(F.min("name").alias("least"), F.first("n").alias("n")), "least")
    twins = bags.join(least.select("bag", "least"), "bag").where("name <> least").select(F.col("least").alias("a"), F.col("name").alias("b"), F.col("n").alias("shared"), F.col("n").alias("smaller"))
    held = bags.join(least.select(F.col("least").alias("name")), "name", "left_semi")
    each = cut(held.select("name", "n", F.explode("keys").alias("key")), "keys")
    often = cut(each.groupBy("key").agg(F.count("*").alias("often")), "often")
    ranked = join_back(each, often, ["key"], "often", each.count()).where("often > 1")
    # An own block that no other note holds takes a place among the rarest all the same.
    rarest = Window.partitionBy("name").orderBy("often", "key")
    alone = F.col("n") - F.count("*").over(Window.partitionBy("name"))
    need = F.ceil(F.col("n") * min_percent / 100)
    asking = ranked.withColumn("_place", F.row_number().over(rarest) + alone).where(F.col("_place") <= F.col("n") - need + 1)
    one = asking.select("key", F.col("name").alias("x"), F.col("n").alias("nx"))
    met = one.join(each.select("key", F.col("name").alias("y"), F.col("n").alias("ny")), "key").where("x <> y and nx <= ny")
    pairs = met.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()
    of = lambda side: held.select(F.col("name").alias(side), F.col("keys").alias(f"k{side}"))
    counted = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", F.size(F.array_intersect("ka", "kb")).cast("bigint").alias("shared"), F.least(F.size("ka"), F.size("kb")).cast("bigint").alias("smaller"))
    return counted.where(F.col("shared") * 100 >= F.col("smaller") * min_percent).unionByName(twins)


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, root): root is the least node that edges (a, b) reach; min-label rounds with pointer jumping.

    Each round ends in a table in the shared folder; rounds go with the logarithm of the longest chain."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    now = cut(nodes.select(F.col("node"), F.col("node").alias("root")), "roots")
    while True:
        near = both.join(now.select(F.col("node").alias("b"), F.col("root").alias("r")), "b").groupBy(F.col("a").alias("node")).agg(F.min("r").alias("r"))
        hooked = now.join(near, "node", "left").select("node", "root", F.least("root", F.coalesce("r", "root")).alias("next"))
        jump = hooked.select(F.col("node").alias("next"), F.col("next").alias("j"))
        after = cut(hooked.join(jump, "next", "left").select("node", "root", F.least("next", F.coalesce("j", "next")).alias("next")), "roots")
        now = after.select("node", F.col("next").alias("root"))
        if after.where("root <> next").isEmpty():
            return now


def copies_of(blocks: DataFrame, min_percent: int = SHARED_PERCENT) -> DataFrame:
    """(root, members, pairs): groups of notes that share blocks, largest first."""
    pairs = shared_blocks(blocks, min_percent)
    nodes = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    roots = connected(nodes, pairs)
    members = roots.groupBy("root").agg(F.count("*").alias("members"))
    counted = pairs.join(roots, pairs["a"] == roots["node"]).groupBy("root").agg(F.count("*").alias("pairs"))
    return members.join(counted, "root")


def snapshot_diff(stored: DataFrame, found: DataFrame) -> DataFrame:
    """(id, state) from stored and found (id, hash, mtime, has_vectors): new, changed, needs-vectors, touched, gone or unchanged."""
    f = found.select("id", F.col("hash").alias("f_hash"), F.col("mtime").alias("f_mtime"), F.lit(True).alias("f"))
    both = stored.withColumn("s", F.lit(True)).join(f, "id", "full")
    state = (
        F.when(F.col("s").isNull(), "new").when(F.col("f").isNull(), "gone").when(~F.col("hash").eqNullSafe(F.col("f_hash")), "changed").when(~F.coalesce("has_vectors", F.lit(False)), "needs-vectors")
        .when(~F.col("mtime").eqNullSafe(F.col("f_mtime")), "touched").otherwise("unchanged")
    )
    return both.select("id", state.alias("state"))


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """old with the rows of new in place of those with the same key."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def delete_counts(ids: DataFrame, **tables: tuple[DataFrame, str]) -> DataFrame:
    """(kind, removed): how many rows of each table (frame, key column) go with the notes in ids."""
    out = None
    for kind, (frame, key) in tables.items():
        row = frame.join(ids.select(F.col("id").alias(key)), key, "left_semi").agg(F.lit(kind).alias("kind"), F.count("*").alias("removed"))
        out = row if out is None else out.unionByName(row)
    return out


def sample_blocks(blocks: DataFrame, n: int, total: int) -> DataFrame:
    """Every (total / n)-th block in citation order, the first n. Places come from counts per range of
    the citation and ranks within a range, so no task sorts all blocks."""
    step = max(1, total // n)
    part = F.substring("citation", 1, 5)
    rows = blocks.withColumn("_p", part)
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    sizes = rows.groupBy("_p").count().withColumn("_before", F.coalesce(F.sum("count").over(before), F.lit(0)))  # at most 5 * 16^2 ranges
    placed = rows.join(F.broadcast(sizes), "_p").withColumn("_i", F.row_number().over(Window.partitionBy("_p").orderBy("citation")) - 1 + F.col("_before"))
    return placed.where((F.col("_i") % step == 0) & (F.col("_i") < step * n)).select(*blocks.columns)


def blocks_containing(blocks: DataFrame, needle: str) -> DataFrame:
    return blocks.where(F.contains(F.lower("text"), F.lower(F.lit(needle))))


def note_page(notes: DataFrame, ring: int | None = None, lang: str | None = None, q: str | None = None, tags: Column | None = None, order: str = "updated", offset: int = 0, limit: int = 50) -> DataFrame:
    """One page of notes with total; q is looked for in the name and tags, any case; by updated (newest first), name or ring."""
    rows = notes if ring is None else notes.where(F.col("ring") == ring)
    if lang is not None:
        rows = rows.where(F.col("lang") == lang)
    if q is not None:
        hit = F.contains(F.lower("name"), F.lower(F.lit(q)))
        if tags is not None:
            hit = hit | F.exists(tags, lambda t: F.contains(F.lower(t), F.lower(F.lit(q))))
        rows = rows.where(hit)
    keys = {"updated": [F.desc("updated"), "name"], "name": ["name"], "ring": ["ring", "name"]}[order]
    total = rows.agg(F.count("*").alias("total"))
    return rows.orderBy(*keys).offset(offset).limit(limit).crossJoin(F.broadcast(total))


def anchor_drift(anchors: DataFrame, files: DataFrame) -> DataFrame:
    """(id, path, state): anchors (id, path, sha256) against the current (path, sha256): same, changed or missing."""
    now = files.select("path", F.col("sha256").alias("now"))
    state = F.when(F.col("now").isNull(), "missing").when(F.col("now") == F.col("sha256"), "same").otherwise("changed")
    return anchors.join(now, "path", "left").select("id", "path", state.alias("state"))


def doctor(**checks: DataFrame) -> DataFrame:
    """(severity, check, detail): one row for each check's count of problem rows; errors first."""
    out = None
    for name, bad in checks.items():
        row = bad.agg(F.lit(name.replace("_", "-")).alias("check"), F.count("*").alias("n"))
        out = row if out is None else out.unionByName(row)
    return out.select(F.when(F.col("n") == 0, "ok").otherwise("problem").alias("severity"), "check", F.concat(F.col("n"), F.lit(" found")).alias("detail"))
