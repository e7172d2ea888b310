"""Hybrid retrieval: lexical and vector candidates, rank fusion, trust and recency weights, validity, duplicates.

Filters stand below every top-k, never after it. Statistics of the lexical ranking cover all rows, hidden
ones too. A ranking reads the postings of its terms from an index; blocks are read only for the notes of the candidates.
"""

from __future__ import annotations

import hashlib
import json
import re
import uuid
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from inkgrove.functions.scalars import STRIPPED_FROM, STRIPPED_TO, cosine, dedup_key, recency_weight, ring_weight, tokens
from inkgrove.plans.shared import scratch_path

#: Fixed values of the retrieval model.
RRF_K, K_LEXICAL, K_SEMANTIC, TOP_N, MAX_N, MAX_TERMS, PREFIX_CHARS, NEWER_LINKS = 60, 50, 50, 8, 1000, 32, 4, 3
OUTDATED_FACTOR = 0.5
#: BM25 as in the full-text engine: rows count once per phrase, and a phrase's weight has this floor.
K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def compile_query(query: str) -> list[tuple[str, bool]]:
    """(term, is_prefix) of a query, at most MAX_TERMS, or-ed; terms of PREFIX_CHARS characters or more match prefixes."""
    words = [w for w in re.split(r"[^\w]+", query) if w][:MAX_TERMS]
    return [(w, len(w) >= PREFIX_CHARS) for w in words]


def admits(scope: list[str] | None = None, bereich: str | None = None, ring: int | None = None) -> Column:
    """Condition on rows (ring, bereich) of a ring, a department and a list of departments; an empty list admits nothing, nor does any list a null."""
    out = F.lit(True)
    if ring is not None:
        out = out & (F.col("ring") == ring)
    if bereich is not None:
        out = out & (F.col("bereich") == bereich)
    if scope is not None:
        out = out & (F.col("bereich").isin(scope) if scope else F.lit(False))
    return out


def in_scope(df: DataFrame, scope: list[str] | None = None, bereich: str | None = None, ring: int | None = None) -> DataFrame:
    return df.where(admits(scope, bereich, ring))


#: Columns of blocks that the index keeps, as far as there are any, and what names a block in it.
PLACE = ("citation", "id", "idx", "ring", "bereich")
BLOCK = ("origin", "block")


@dataclass
class LexicalIndex:
    """postings (term, origin, block), a row for each word, sorted by term within files, so that a reader skips what its terms do not need; places
    (origin, block, citation, id, idx, ring, bereich, dl) of the blocks that count; their number and mean length; the generation of an index that grows by segments."""

    postings: DataFrame
    places: DataFrame
    rows: float
    mean: float
    generation: int = 0


def write_index(blocks: DataFrame, path: str) -> None:
    """One table of a row for each word (term, origin, block) and one for each block, which has no term but its place.

    Blocks are tokenised and numbered once; each task sorts and writes its own, nothing is shuffled, and no posting repeats its block's place. origin tells
    the numbers of one such table from those of others."""
    kept = [c for c in PLACE if c in blocks.columns]
    words = blocks.select(F.monotonically_increasing_id().alias("block"), *kept, tokens(F.coalesce("text", F.lit(""))).alias("_w"))
    each = words.select("block", *kept, F.size("_w").alias("dl"), F.posexplode(F.concat(F.array(F.lit(None).cast("string")), "_w")).alias("_pos", "term"))
    rows = each.select("term", "block", F.when(F.col("_pos") == 0, F.struct(*kept, "dl")).alias("_place")).sortWithinPartitions("term", "block")
    origin = F.lit(uuid.uuid4().int >> 65).alias("origin")
    rows.select("term", origin, "block", *[F.col("_place")[c].alias(c) for c in (*kept, "dl")]).write.option("compression", "zstd").parquet(path)


def written_places(rows: DataFrame) -> DataFrame:
    return rows.where("term is null").drop("term")


def written_postings(rows: DataFrame) -> DataFrame:
    return rows.where("term is not null").select("term", *BLOCK)


def build_index(blocks: DataFrame) -> LexicalIndex:
    """The index of blocks as they are, in the shared folder."""
    spark = blocks.sparkSession
    path = scratch_path(spark, "index")
    write_index(blocks, path)
    rows = spark.read.parquet(path)
    places = written_places(rows)
    total = places.agg(F.count("*").cast("double"), F.coalesce(F.avg("dl"), F.lit(0.0))).first()
    return LexicalIndex(written_postings(rows), places, total[0], total[1])


def bm25(index: LexicalIndex | DataFrame, query: str, k: int = K_LEXICAL, admitted: Column | None = None, visible: DataFrame | None = None) -> DataFrame:
    """(citation, id, idx, score) of the k best blocks, by score, then citation. Nothing for a query without terms.

    index may be a table of blocks, which is then indexed for this query alone. admitted is a condition on ring and bereich, visible the (id) of notes to admit; neither changes the statistics."""
    terms = compile_query(query)
    index = index if isinstance(index, LexicalIndex) else build_index(index)
    place = [c for c in PLACE if c in index.places.columns]
    shown = [c for c in place if c not in ("ring", "bereich")]
    if not terms:
        return index.places.select(*shown, F.lit(0.0).alias("score")).limit(0)
    hits = [_matching(term, prefix) for term, prefix in terms]
    any_hit = hits[0]
    for hit in hits[1:]:
        any_hit = any_hit | hit
    tf = [F.count_if(hit).cast("double").alias(f"_tf{i}") for i, hit in enumerate(hits)]
    rows = index.postings.where(any_hit).groupBy(*BLOCK).agg(*tf).join(index.places.select(*BLOCK, *place, "dl"), [*BLOCK])
    stats = rows.agg(*[F.sum((F.col(f"_tf{i}") > 0).cast("double")).alias(f"_n{i}") for i in range(len(terms))])
    score = F.lit(0.0)
    for i in range(len(terms)):
        idf = F.greatest(F.log((index.rows - F.col(f"_n{i}") + 0.5) / (F.col(f"_n{i}") + 0.5)), F.lit(LEAST_IDF))
        f = F.col(f"_tf{i}")
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("dl").cast("double") / index.mean))
    found = rows if admitted is None else rows.where(admitted)
    if visible is not None:
        found = found.join(visible.select("id"), "id", "left_semi")
    scored = found.crossJoin(F.broadcast(stats)).select(*shown, score.alias("score"))  # stats is one row
    return scored.orderBy(F.desc("score"), "citation").limit(k)


def _matching(term: str, prefix: bool) -> Column:
    folded = _fold_word(term)
    return F.col("term").startswith(folded) if prefix else F.col("term") == folded


def _fold_word(term: str) -> str:
    """A query word as the index holds it."""
    return term.lower().translate(str.maketrans(STRIPPED_FROM, STRIPPED_TO))


def vector_top_k(vectors: DataFrame, query: list[float], k: int = K_SEMANTIC, min_cosine: float = 0.0, vector: str = "embedding", key: str = "citation") -> DataFrame:
    """The k nearest rows with a cosine above min_cosine, by cosine, then key. A zero query finds nothing."""
    if not any(query):
        return vectors.withColumn("cosine", F.lit(0.0)).limit(0)
    target = F.array(*[F.lit(float(x)) for x in query])
    return vectors.withColumn("cosine", cosine(F.col(vector), target)).where(F.col("cosine") > min_cosine).orderBy(F.desc("cosine"), key).limit(k)


def ranked(top: DataFrame, score: str, key: str = "citation") -> DataFrame:
    """(key, rank) of a short list, from 1; ties by key. For at most MAX_N rows, as one task ranks them."""
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc(score), key))).select(key, "rank")


def rrf(*lists: DataFrame, key: str = "citation") -> DataFrame:
    """Reciprocal rank fusion of (key, rank) lists: the sum of 1 / (RRF_K + rank)."""
    union = lists[0]
    for other in lists[1:]:
        union = union.unionByName(other)
    return union.groupBy(key).agg(F.sum(1.0 / (RRF_K + F.col("rank"))).alias("fused"))


def superseded(notes: DataFrame, at: Column, names: list[str] | None = None) -> DataFrame:
    """(old, new): notes replaced as of at, of all or of those named; the first successor by name wins.

    What a note says of itself (superseded_by) counts once its successor has begun, or if that is unknown. What a successor claims
    (supersedes) counts once it has begun and if it is as trusted as the note it replaces, or that is unknown. A note begins at valid_from, else at created."""
    begun = F.coalesce("valid_from", "created")
    wanted = (lambda c: F.col(c).isin(names)) if names is not None else (lambda c: F.lit(True))
    said = notes.where(wanted("name")).select(F.col("name").alias("old"), F.col("superseded_by").alias("new")).where("new is not null")
    later = notes.where(begun > at).select(F.col("name").alias("new"))
    said = said.join(later, "new", "left_anti").select("old", "new")
    claimed = notes.where(F.coalesce(begun <= at, F.lit(True))).select(F.explode("supersedes").alias("old"), F.col("name").alias("new"), F.col("ring").alias("trust")).where(wanted("old"))
    rings = notes.where(wanted("name")).select(F.col("name").alias("old"), "ring")
    claimed = claimed.join(rings, "old", "left").where(F.coalesce(F.col("trust") <= F.col("ring"), F.lit(True))).select("old", "new")
    return said.unionByName(claimed).where("old <> new").groupBy("old").agg(F.min("new").alias("new"))


def outdated(notes: DataFrame, at: Column, ids: list | None = None, admitted: DataFrame | None = None) -> DataFrame:
    """notes, or those with the ids, with replaced_by, not_yet, ended, outdated and demoted as of at.

    With admitted (name), a successor that is not among them is not named, and alone does not show the note as outdated; it only demotes it."""
    own = notes if ids is None else notes.where(F.col("id").isin(ids))
    names = None if ids is None else [r[0] for r in own.select("name").collect()]  # as many as ids
    gone = superseded(notes, at, names).select(F.col("old").alias("name"), F.col("new").alias("_new"))
    if admitted is not None:
        gone = gone.join(admitted.select(F.col("name").alias("_new"), F.lit(True).alias("_seen")), "_new", "left")
    else:
        gone = gone.withColumn("_seen", F.lit(True))
    flagged = own.join(gone, "name", "left").withColumn("replaced_by", F.when(F.col("_seen"), F.col("_new")))
    flagged = flagged.withColumn("not_yet", F.coalesce(F.col("valid_from") > at, F.lit(False))).withColumn("ended", F.coalesce(F.col("invalid_at") <= at, F.lit(False)))
    flagged = flagged.withColumn("outdated", F.col("replaced_by").isNotNull() | F.col("not_yet") | F.col("ended"))
    return flagged.withColumn("demoted", F.col("outdated") | F.col("_new").isNotNull()).drop("_new", "_seen")


def weighted(hits: DataFrame, now: Column) -> DataFrame:
    """hits (fused, ring, updated, demoted) with score: the fused score times ring weight, recency and, once, OUTDATED_FACTOR."""
    factor = ring_weight(F.col("ring")) * recency_weight(F.col("updated"), now) * F.when(F.col("demoted"), OUTDATED_FACTOR).otherwise(1.0)
    return hits.withColumn("score", F.col("fused") * factor)


def collapse_duplicates(hits: DataFrame) -> DataFrame:
    """One hit for each long text: the most trusted, then newest copy, with the best score of the group. Short texts stay apart.

    An aggregation, so that copies of a frequent text combine map-side."""
    key = F.coalesce(dedup_key(F.col("text")), F.col("citation"))
    age = F.coalesce(-F.unix_micros("updated"), F.lit((1 << 63) - 1))
    row = F.struct("ring", age.alias("_age"), (-F.col("score")).alias("_low"), "citation", F.struct(*[c for c in hits.columns if c != "score"]).alias("_row"))
    best = hits.groupBy(key.alias("_key")).agg(F.min(row).alias("_best"), F.max("score").alias("score"), F.count("*").alias("copies"))
    return best.select("_best._row.*", "score", "copies")


@dataclass
class RecallOptions:
    n: int = TOP_N
    k_lexical: int = K_LEXICAL
    k_semantic: int = K_SEMANTIC
    min_cosine: float = 0.0
    ring: int | None = None
    bereich: str | None = None
    scope: list[str] | None = None
    with_residents: bool = True


def recall(index: LexicalIndex, blocks: DataFrame, notes: DataFrame, query: str, now: Column, at: Column | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None, visible: DataFrame | None = None, options: RecallOptions | None = None) -> DataFrame:
    """Ranked hits: the columns of blocks, score, outdated, replaced_by, demoted, copies.

    visible (id) admits notes before anything is ranked; a note that it or the scope leaves out is not named as a successor
    either. at judges validity and supersession, now recency; vectors (citation, embedding) take part if given with a query
    vector. The order is score, then citation; n is held to 1..MAX_N. The candidates, k of each list at most, pass through the driver, and
    only their notes' rows of blocks are read."""
    o = options or RecallOptions()
    fits = admits(o.scope, o.bereich, o.ring)
    lists = [ranked(bm25(index, query, o.k_lexical, fits, visible), "score")]
    if vectors is not None and query_vector:
        pool = index.places.where(fits)
        pool = pool if visible is None else pool.join(visible.select("id"), "id", "left_semi")
        near = vectors.join(pool.select("citation"), "citation", "left_semi")
        lists.append(ranked(vector_top_k(near, query_vector, o.k_semantic, o.min_cosine), "cosine"))
    found = index.places.join(F.broadcast(rrf(*lists)), "citation").select("citation", "id", "fused").collect()
    spark, ids = blocks.sparkSession, sorted({r["id"] for r in found})
    fused = spark.createDataFrame([(r["citation"], r["fused"]) for r in found], "citation string, fused double")
    admitted = None
    if o.scope is not None or visible is not None:
        admitted = notes.where(admits(o.scope)) if visible is None else notes.where(admits(o.scope)).join(visible.select("id"), "id", "left_semi")
    states = outdated(notes, at if at is not None else now, ids, admitted).select("id", "outdated", "replaced_by", "demoted")
    hits = blocks.where(F.col("id").isin(ids)).join(F.broadcast(fused), "citation").join(states, "id")
    hits = collapse_duplicates(weighted(hits, now))
    if not o.with_residents:
        hits = hits.where("ring > 1")
    return hits.orderBy(F.desc("score"), "citation").limit(min(MAX_N, max(1, o.n)))


def logged_search(hits: DataFrame, query: str, key: str, requested: str | None = None) -> tuple[DataFrame, Callable[[], dict]]:
    """(hits to run, a function that gives the search's log row once they were run).

    The row's counts are observed while the hits, MAX_N at most, are made, so nothing runs twice. It holds a keyed hash instead of the query: detail is JSON of query,
    hits, bereiche (sorted), per_bereich and, if one was asked for, requested_bereich; hits without a department count under no name."""
    seen = Observation()
    watched = hits.observe(seen, F.count(F.lit(1)).alias("hits"), F.collect_list(F.coalesce("bereich", F.lit(""))).alias("bereiche"))

    def row() -> dict:
        found = seen.get
        counts = Counter(b for b in found["bereiche"] if b)
        hashed = hashlib.sha256(f"{key}|{' '.join(query.split()).lower()}".encode()).hexdigest()
        detail = {"query": hashed, "hits": found["hits"], "bereiche": sorted(counts), "per_bereich": dict(sorted(counts.items())), **({"requested_bereich": requested} if requested is not None else {})}
        return {"action": "search", "subject": None, "detail": json.dumps(detail, ensure_ascii=False)}

    return watched, row


def caveats(hits: DataFrame, all_hits: DataFrame, uncovered: int = 0) -> DataFrame:
    """(caveat, n) of what a reader should know: hits demoted for a successor that is not named, resident hits left out of all_hits, blocks without vectors."""
    hidden = all_hits.agg(F.lit("successor-not-shown").alias("caveat"), F.count_if(F.col("demoted") & ~F.col("outdated")).alias("n"))
    left_out = all_hits.where("ring <= 1").join(hits.select("citation"), "citation", "left_anti").agg(F.lit("residents-left-out").alias("caveat"), F.count("*").alias("n"))
    missing = hits.sparkSession.createDataFrame([("blocks-without-vector", uncovered)], "caveat string, n bigint")
    return hidden.unionByName(left_out).unionByName(missing).where("n > 0")


def newer_links(hits: DataFrame, notes: DataFrame, links: DataFrame) -> DataFrame:
    """(name, linked_by, linked_updated): the NEWER_LINKS newest notes that link to a hit's note and are newer than it."""
    target = hits.select(F.col("id").alias("hit_id"), F.col("name").alias("hit_name"), F.col("updated").alias("hit_updated")).distinct()
    source = notes.select(F.col("id").alias("from_id"), F.col("name").alias("linked_by"), F.col("updated").alias("linked_updated"))
    found = links.select("from_id", F.col("to_name").alias("hit_name")).distinct().join(target, "hit_name").join(source, "from_id")
    newer = found.where((F.col("from_id") != F.col("hit_id")) & (F.col("linked_updated") > F.col("hit_updated")))
    first = Window.partitionBy("hit_id").orderBy(F.desc("linked_updated"), "linked_by")
    return newer.withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= NEWER_LINKS).select(F.col("hit_name").alias("name"), "linked_by", "linked_updated")


def coverage(blocks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row: blocks, with_vector, missing."""
    missing = blocks.join(vectors.select("citation"), "citation", "left_anti").agg(F.count("*").alias("missing"))
    return blocks.agg(F.count("*").alias("blocks")).crossJoin(missing).select("blocks", (F.col("blocks") - F.col("missing")).alias("with_vector"), "missing")


def retrieval_metrics(rankings: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 3, 5, 10)) -> DataFrame:
    """One row of means over queries (query, doc, rank) against (query, doc): n, r_at_k, rall_at_10, mrr, ndcg_at_10."""
    wanted = relevant.groupBy("query").agg(F.count("*").alias("m"))
    hits = relevant.join(rankings, ["query", "doc"]).groupBy("query").agg(F.min("rank").alias("first"), F.count_if(F.col("rank") <= 10).alias("in10"), F.sum(F.when(F.col("rank") <= 10, 1 / F.log2(F.col("rank") + 1))).alias("dcg"))
    rows = wanted.join(hits, "query", "left")
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("m", F.lit(10)).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
    recalls = [F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"r_at_{k}") for k in ks]
    return rows.withColumn("_ideal", ideal).agg(
        F.count("*").alias("n"), *recalls, F.avg(F.coalesce((F.col("in10") == F.col("m")).cast("double"), F.lit(0.0))).alias("rall_at_10"), F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce(F.col("dcg"), F.lit(0.0)) / F.col("_ideal")).alias("ndcg_at_10")
    )


def conflict_sides(verdicts: DataFrame, hits: DataFrame) -> DataFrame:
    """(winner, loser) of contradicting pairs (a, b): the more trusted ring wins, pairs within one ring drop out."""
    side = lambda c: hits.select(F.col("citation").alias(c), F.col("ring").alias(f"ring_{c}"))
    pairs = verdicts.join(side("a"), "a").join(side("b"), "b").where("ring_a <> ring_b")
    first = F.col("ring_a") < F.col("ring_b")
    return pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("winner"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("loser"))
