"""Mixing sources to target weights by Pareto order sampling.

Within a source a document's expected copies go with the number of binary digits of its size, as far as the limit of copies
allows, and are scaled so that the expected words are the source's target: long documents are taken rather than
short ones. The whole part of the expected copies is certain. The rest, p, is an inclusion probability: documents are ranked by
q = (U / (1 - U)) / (p / (1 - p)), U a uniform number made from a hash of seed, id and text, and taken in the order of q until
the source's words come nearest to the rest of its target. The cut lies near q = 1. It is found from the words per source and
bucket of q / (1 + q), bucket within bucket, so only a last small bucket of a source is ever sorted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkgrove.plans.shared import BROADCAST_ROWS, cut

WEIGHTS, SHARE, MOST_COPIES = (5, 2, 1), 1.5, 2
HASH_BITS, SEED = 52, "mix"
#: A step splits a bucket by so many bits; steps go on until no source has more rows in its bucket.
BUCKET_BITS, BUCKET_ROWS, MOST_BITS = 12, 20_000, 48
WORD = r"[^\x20\x09-\x0D]++"


def _keyed(source: Column) -> Column:
    """The source as text that is never null; null ones sort last."""
    return F.when(source.isNull(), F.lit("1")).otherwise(F.concat(F.lit("0"), source.cast("string")))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES) -> DataFrame:
    """(_ink_s, source_size, target) of sizes (_ink_s, source_size), as a cut table.

    share of all sizes is dealt by weight, which the sources take in turn in their order; none gets more than most times its size, and what the
    limits leave over is dealt again: the target is min(limit, level * weight). The level rises until no further source
    reaches its limit; a step is one aggregation over the sources."""
    ranged = cut(sizes.repartitionByRange("_ink_s").withColumn("_part", F.spark_partition_id()), "sources")
    before = F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = ranged.groupBy("_part").agg(F.count("*").alias("n")).select("_part", before.alias("_start"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("_part").orderBy("_ink_s")) - 1 + F.col("_start")
    listed = ranged.join(F.broadcast(starts), "_part").withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.pmod(place, F.lit(len(weights))) + 1).cast("int")))
    listed = cut(listed.select("_ink_s", "source_size", "weight", (float(most) * F.col("source_size")).alias("_most")), "weights")
    level = 0.0
    while True:
        free = F.col("_most") > level * F.col("weight")
        words, full, weight = listed.agg(F.sum("source_size"), F.coalesce(F.sum(F.when(~free, F.col("_most"))), F.lit(0.0)), F.sum(F.when(free, F.col("weight")))).first()
        after = (share * words - full) / weight if weight else level
        if after <= level:
            break
        level = after
    return cut(listed.select("_ink_s", "source_size", F.least("_most", level * F.col("weight")).alias("target")), "targets")


def expected_copies(classes: DataFrame, most: int = MOST_COPIES) -> DataFrame:
    """classes (_ink_s, odds, words, target) with expected: min(most, scale * odds), the scale such that a source's expected words are its target.

    A source has few classes of odds. Those of the greatest odds reach the limit first: the scale is that of the first set of
    classes, greatest odds first, beyond which no class reaches it."""
    down = Window.partitionBy("_ink_s").orderBy(F.desc("odds"))
    full = float(most) * F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.sum(F.col("words") * F.col("odds")).over(down.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    rows = classes.withColumn("_scale", F.try_divide(F.col("target") - full, left))
    fits = rows.withColumn("_fits", F.when(F.col("_scale") * F.col("odds") <= most, F.struct("odds", "_scale")))
    scale = F.max("_fits").over(Window.partitionBy("_ink_s"))["_scale"]
    return fits.withColumn("expected", F.coalesce(F.least(F.lit(float(most)), scale * F.col("odds")), F.lit(float(most)))).drop("_scale", "_fits")


def mix(docs: DataFrame, text: str = "text", source: str = "source", id_col: str = "doc_id", weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST_COPIES, seed: str = SEED, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id_col, carry, size (words), source_size, target (its source's words), expected (copies), copies, taken (words).

    Sources in code point order, null last as a source of its own, take the weights in turn. A null text
    has no words; documents without words are never taken; a very long text is counted whole. Rows alike in id and text have the same
    rank and go in any order among them. Reruns agree. An empty table gives an empty result. carry columns
    are passed on."""
    body = F.coalesce(F.col(text), F.lit(""))
    h = F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(id_col).cast("string"), F.lit("")), body))
    size = F.regexp_count(body, F.lit(WORD)).cast("bigint")
    u = (F.conv(F.substring(h, 1, HASH_BITS // 4), 16, 10).cast("bigint") + 0.5) / float(1 << HASH_BITS)
    rows = docs.select(F.col(id_col).alias("_ink_id"), _keyed(F.col(source)).alias("_ink_s"), size.alias("size"), u.alias("_ink_u"), *[F.col(f"`{c}`") for c in carry])
    rows = cut(rows, "sizes")
    rows = rows.withColumn("_ink_odds", F.length(F.bin("size")))
    classes = cut(rows.groupBy("_ink_s", F.col("_ink_odds").alias("odds")).agg(F.sum("size").alias("words")), "classes")
    goal = source_targets(classes.groupBy("_ink_s").agg(F.sum("words").alias("source_size")), weights, share, most)
    plan = expected_copies(classes.join(goal, "_ink_s"), most)
    whole = F.floor("expected")
    p = F.col("expected") - whole
    rest = F.col("target") - F.sum(whole * F.col("words")).over(Window.partitionBy("_ink_s"))
    plan = plan.select(F.col("_ink_s").alias("_ink_k"), F.col("odds").alias("_ink_o"), "source_size", "target", "expected", whole.alias("_ink_whole"), (p / (1 - p)).alias("_ink_p"), rest.alias("_ink_rest"))
    plan = cut(plan, "plan")
    few = plan.count() <= BROADCAST_ROWS
    rows = rows.join(F.broadcast(plan) if few else plan, (F.col("_ink_s") == F.col("_ink_k")) & (F.col("_ink_odds") == F.col("_ink_o")), "left")
    q = (F.col("_ink_u") / (1 - F.col("_ink_u"))) / F.when((F.col("_ink_p") > 0) & (F.col("size") > 0), F.col("_ink_p"))
    rows = rows.withColumn("_ink_v", q / (1 + q))
    edges = _edges(rows)
    rows = rows.join(F.broadcast(edges) if few else edges, "_ink_s", "left")
    bucket = F.floor(F.col("_ink_v") * F.pow(F.lit(2.0), F.col("_ink_bits")))
    at_edge = F.coalesce(bucket == F.col("_ink_edge"), F.lit(False))
    settled = rows.where(~at_edge).withColumn("copies", F.col("_ink_whole") + F.coalesce(bucket < F.col("_ink_edge"), F.lit(False)).cast("int"))
    order = Window.partitionBy("_ink_s").orderBy("_ink_v", "_ink_u", "size").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("_ink_before") + F.sum("size").over(order)
    edge_rows = rows.where(at_edge).withColumn("copies", F.col("_ink_whole") + (2 * reached - F.col("size") <= 2 * F.col("_ink_rest")).cast("int"))
    out = settled.unionByName(edge_rows)
    n = F.when(F.col("size") > 0, F.col("copies")).otherwise(0).cast("bigint")
    return out.select(F.col("_ink_id").alias(id_col), *[F.col(f"`{c}`") for c in carry], "size", "source_size", "target", "expected", n.alias("copies"), (n * F.col("size")).alias("taken"))


def _edges(rows: DataFrame) -> DataFrame:
    """(_ink_s, _ink_bits, _ink_edge, _ink_before) of each source: the bucket floor(v * 2 ** bits) where the words in the order of v reach the rest
    of the target, and the words before it; as a cut table. A source whose words do not reach it has a bucket behind all."""
    ranked = rows.where("_ink_v is not null").select("_ink_s", "_ink_v", "size", "_ink_rest")
    edges, bits = None, 0
    while True:
        bits += BUCKET_BITS
        bucket = F.floor(F.col("_ink_v") * float(1 << bits))
        near = ranked.withColumn("bucket", bucket).withColumn("_ink_base", F.lit(0).cast("bigint"))
        if edges is not None:
            past = edges.select("_ink_s", F.col("_ink_edge").alias("_e"), F.col("_ink_before").alias("_b"))
            past = F.broadcast(past) if past.count() <= BROADCAST_ROWS else past
            near = near.join(past, "_ink_s").where(F.shiftright("bucket", BUCKET_BITS) == F.col("_e")).withColumn("_ink_base", F.col("_b"))
        filled = near.groupBy("_ink_s", "bucket").agg(F.sum("size").alias("words"), F.count("*").alias("n"), F.first("_ink_rest").alias("rest"), F.first("_ink_base").alias("base"))
        before = F.col("base") + F.coalesce(F.sum("words").over(Window.partitionBy("_ink_s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        found = filled.withColumn("before", before).withColumn("_over", F.when(F.col("before") + F.col("words") > F.col("rest"), F.struct("bucket", "before", "n")))
        least = F.coalesce(F.min("_over"), F.struct((F.max("bucket") + 1).alias("bucket"), F.sum("words").alias("before"), F.lit(0).cast("bigint").alias("n")))
        found = found.groupBy("_ink_s").agg(least.alias("x")).select("_ink_s", F.lit(bits).alias("_ink_bits"), F.col("x.bucket").alias("_ink_edge"), F.col("x.before").alias("_ink_before"), F.col("x.n").alias("_n"))
        if edges is not None:  # sources without rows in their bucket stay as they are
            same = edges.join(found.select("_ink_s"), "_ink_s", "left_anti").select("_ink_s", F.lit(bits).alias("_ink_bits"), F.shiftleft("_ink_edge", BUCKET_BITS).alias("_ink_edge"), "_ink_before", F.lit(0).cast("bigint").alias("_n"))
            found = found.unionByName(same)
        edges = cut(found, "edges")
        if bits + BUCKET_BITS > MOST_BITS or not edges.where(F.col("_n") > BUCKET_ROWS).take(1):
            return edges.drop("_n")


def apply_mix(docs: DataFrame) -> DataFrame:
    """docs with every document as often as the mix takes it; columns stay as they are."""
    whole = docs.select("doc_id", "text", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_ink_row"))
    mixed = mix(whole, carry=("_ink_row",))
    return mixed.where("copies > 0").withColumn("_ink_copy", F.explode(F.sequence(F.lit(1).cast("bigint"), "copies"))).select("_ink_row.*")
