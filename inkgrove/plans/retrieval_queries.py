"""Queries on ranked retrieval and validity."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import functions as F

from inkgrove.functions import scalars as S
from inkgrove.operators import ledger as LEDGER
from inkgrove.operators import retrieval as R
from inkgrove.operators import segments as SEG
from inkgrove.plans import manifests
from inkgrove.plans.registry import query
from inkgrove.plans.shared import BROADCAST_BYTES, cut, cut_bytes, join_sized, shared_root, table_state
from inkgrove.session import table
from inkgrove.sources.corpus import NOW, blocks, blocks_of, links, notes, with_sql

#: Letters and digits of a passage that can be told from chance.
CANARY_LEAST = 12
#: Passages up to which each is looked for in every document.
CANARY_BROADCAST = 200

TEXT_QUERY, PREFIX_QUERY = "Licensed under the Apache License", "stupid worth the"


#: The index opened last; what a generation names never changes.
_opened: dict[tuple, R.LexicalIndex] = {}


def index_of(spark, sf_dir) -> R.LexicalIndex:
    """The lexical index of the documents, kept in the shared folder outside of any scratch(). A change of any of the table's files
    makes the index catch up: only documents whose text is new or changed are indexed."""
    root = f"{shared_root(spark)}/inkgrove/lexical2-{hashlib.sha256(sf_dir.encode()).hexdigest()[:16]}"
    state = table_state(spark, table(spark, sf_dir, "documents").inputFiles())
    _, body = manifests.latest(spark, root)
    if (body.get("mark") or {}).get("source") != state:
        SEG.refresh(root, notes(spark, sf_dir).select("id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("hash")), blocks(spark, sf_dir), {"source": state})
        if SEG.compaction_due(manifests.latest(spark, root)[1]):
            SEG.compact(spark, root)
    key = (spark.sparkContext.applicationId, root, manifests.latest(spark, root)[0])
    if key not in _opened:
        _opened.clear()
        _opened[key] = SEG.open_index(spark, root)
    return _opened[key]


def _now():
    return F.timestamp_seconds(F.lit(NOW))


_AT = NOW - 2_000_000


def _bm25_sql(text: str, k: int, where: str = "true") -> str:
    terms = R.compile_query(text)
    tf = ", ".join(f"CAST(len(list_filter(w, lambda x: {f'starts_with(x, {t.lower()!r})' if p else f'x = {t.lower()!r}'})) AS DOUBLE) AS tf{i}" for i, (t, p) in enumerate(terms))
    n = ", ".join(f"CAST(count(*) FILTER (tf{i} > 0) AS DOUBLE) AS n{i}" for i in range(len(terms)))
    score = " + ".join(f"greatest(ln((rows - n{i} + 0.5) / (n{i} + 0.5)), 1e-6) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * dl / avg))" for i in range(len(terms)))
    hit = " + ".join(f"tf{i}" for i in range(len(terms)))
    return f"""w AS (SELECT *, list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\\pL\\pN]+'), lambda x: x <> '') AS w FROM blocks),
        t AS (SELECT *, CAST(len(w) AS DOUBLE) AS dl, {tf} FROM w), st AS (SELECT CAST(count(*) AS DOUBLE) AS rows, avg(dl) AS avg, {n} FROM t),
        lex AS (SELECT t.*, {score} AS score FROM t, st WHERE {hit} > 0 AND {where} ORDER BY score DESC, citation LIMIT {k})"""


@query(f"{with_sql('notes', 'blocks')}, {_bm25_sql(TEXT_QUERY, 50)} SELECT citation, id, idx, round(score, 6) AS score FROM lex")
def bm25_topk(spark, sf_dir):
    return R.bm25(index_of(spark, sf_dir), TEXT_QUERY).select("citation", "id", "idx", F.round("score", 6).alias("score"))


@query(f"{with_sql('notes', 'blocks')}, {_bm25_sql(PREFIX_QUERY, 20)} SELECT citation, id, idx, round(score, 6) AS score FROM lex")
def bm25_prefix_topk(spark, sf_dir):
    return R.bm25(index_of(spark, sf_dir), PREFIX_QUERY, 20).select("citation", "id", "idx", F.round("score", 6).alias("score"))


_LATER = "CASE WHEN doc_id % 50 = 7 THEN 'Licensed afresh. ' || text ELSE text END"
_UPSERTED = f"""WITH documents2 AS (SELECT * REPLACE ({_LATER} AS text) FROM documents WHERE doc_id % 50 <> 9), {with_sql('notes', 'blocks')[5:].replace('FROM documents)', 'FROM documents2)')}"""


@query(f"{_UPSERTED}, {_bm25_sql(TEXT_QUERY, 50)} SELECT citation, id, idx, round(score, 6) AS score FROM lex")
def index_upsert(spark, sf_dir):
    """The index of the documents after one in fifty was changed and one in fifty removed: ranks as an index built anew."""
    root = f"{shared_root(spark)}/inkgrove/upsert-{uuid.uuid4().hex}"
    held = blocks(spark, sf_dir)
    SEG.upsert(root, held, held.select("id").limit(0))
    changed = notes(spark, sf_dir).where("id % 50 = 7").withColumn("text", F.concat(F.lit("Licensed afresh. "), "text"))
    ids = notes(spark, sf_dir).where("id % 50 in (7, 9)").select("id")
    SEG.upsert(root, blocks_of(changed), ids)
    return R.bm25(SEG.open_index(spark, root), TEXT_QUERY).select("citation", "id", "idx", F.round("score", 6).alias("score"))


_SEARCHES = (TEXT_QUERY, PREFIX_QUERY, "no such words zzzz")


def _search_sql(i: int) -> str:
    text = _SEARCHES[i]
    hashed = hashlib.sha256(f"k|{text.lower()}".encode()).hexdigest()
    return f"""SELECT {i + 1} AS seq, '{hashed}' AS query, (SELECT count(*) FROM ({_only_lex(text)})) AS hits,
        (SELECT coalesce(string_agg(bereich || '=' || n, ',' ORDER BY bereich), '') FROM (SELECT bereich, count(*) AS n FROM ({_only_lex(text)}) WHERE bereich IS NOT NULL GROUP BY bereich)) AS departments"""


def _only_lex(text: str) -> str:
    return f"{with_sql('notes', 'blocks')}, {_bm25_sql(text, 50)} SELECT * FROM lex"


@query(" UNION ALL ".join(_search_sql(i) for i in range(len(_SEARCHES))))
def search_log(spark, sf_dir):
    """A row of the log for each search, counted within the search's own run, chained in a ledger and read back."""
    index, root = index_of(spark, sf_dir), f"{shared_root(spark)}/inkgrove/searches-{uuid.uuid4().hex}"
    for i, text in enumerate(_SEARCHES):
        found = R.bm25(index, text).join(index.places.select("citation", "bereich"), "citation")
        watched, row = R.logged_search(found, text, "k")
        watched.write.format("noop").mode("overwrite").save()
        log = spark.createDataFrame([("here", i, "user-1", *row().values())], "device string, seq bigint, actor string, action string, subject string, detail string")
        LEDGER.append_chained(root, log)
    detail = lambda path: F.get_json_object("detail", path)
    counts = F.from_json(detail("$.per_bereich"), "map<string,bigint>")
    departments = F.array_join(F.transform(F.array_sort(F.map_entries(counts)), lambda e: F.concat_ws("=", e["key"], e["value"])), ",")
    return LEDGER.read(spark, root).select(F.col("seq").cast("int").alias("seq"), detail("$.query").alias("query"), detail("$.hits").cast("bigint").alias("hits"), departments.alias("departments"))


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label", (F.col("vec_id") % 5).cast("int").alias("ring"), F.col("vec_id").alias("citation"))


def _query_vector(spark, sf_dir):
    found = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(found[0]) if found else []


_COS = "list_cosine_similarity(CAST(embedding AS DOUBLE[]), (SELECT CAST(embedding AS DOUBLE[]) FROM embeddings WHERE vec_id = 0))"


@query(f"SELECT vec_id, round({_COS}, 6) AS cosine FROM embeddings WHERE {_COS} > 0 ORDER BY {_COS} DESC, vec_id LIMIT 50")
def vector_topk(spark, sf_dir):
    return R.vector_top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir)).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT vec_id, round({_COS}, 6) AS cosine FROM embeddings WHERE vec_id % 5 = 2 AND {_COS} > 0 ORDER BY {_COS} DESC, vec_id LIMIT 10")
def vector_topk_ring(spark, sf_dir):
    return R.vector_top_k(R.in_scope(_vectors(spark, sf_dir), ring=2), _query_vector(spark, sf_dir), 10).select("vec_id", F.round("cosine", 6).alias("cosine"))


@query(f"SELECT vec_id, label, round({_COS}, 6) AS cosine FROM embeddings WHERE {_COS} > 0.3 ORDER BY {_COS} DESC, vec_id LIMIT 1000")
def vector_min_cosine(spark, sf_dir):
    return R.vector_top_k(_vectors(spark, sf_dir), _query_vector(spark, sf_dir), 1000, 0.3).select("vec_id", "label", F.round("cosine", 6).alias("cosine"))


@query(f"{with_sql('notes', 'blocks')} SELECT count(*) AS blocks, count(*) FILTER (id IN (SELECT vec_id FROM embeddings)) AS with_vector, count(*) FILTER (id NOT IN (SELECT vec_id FROM embeddings)) AS missing FROM blocks")
def vector_coverage(spark, sf_dir):
    b = blocks(spark, sf_dir).select(F.col("id").alias("citation"))
    return R.coverage(b, _vectors(spark, sf_dir))


# Hybrid queries: a block takes the vector of its note, so the semantic list ranks first lines of notes that have one.
_SEM = f"""sem AS (SELECT citation, {_COS.replace("embedding AS", "e.embedding AS", 1)} AS cosine FROM blocks JOIN embeddings e ON e.vec_id = id WHERE idx = 0 AND %s
        AND {_COS.replace("embedding AS", "e.embedding AS", 1)} > 0 ORDER BY cosine DESC, citation LIMIT 50)"""
_FUSED = """fused AS (SELECT citation, sum(1.0 / (60 + rank)) AS fused FROM (
        SELECT citation, row_number() OVER (ORDER BY score DESC, citation) AS rank FROM lex
        UNION ALL SELECT citation, row_number() OVER (ORDER BY cosine DESC, citation) FROM sem) GROUP BY citation)"""


def _superseded_sql(at: int, seen: str = "true") -> str:
    """seen is a condition on notes s whose names may be told."""
    return f"""begun AS (SELECT name, ring, supersedes, coalesce(valid_from, created) AS since FROM notes),
    said AS (SELECT name, superseded_by AS successor FROM notes WHERE superseded_by NOT IN (SELECT name FROM begun WHERE since > {at})),
    claims AS (SELECT unnest(supersedes) AS name, name AS successor, ring AS trust FROM begun WHERE since <= {at}),
    trusted AS (SELECT claims.name, successor FROM claims LEFT JOIN begun ON begun.name = claims.name WHERE begun.ring IS NULL OR trust <= begun.ring),
    sup AS (SELECT name, min(successor) AS successor FROM (SELECT * FROM said UNION ALL SELECT * FROM trusted) WHERE name <> successor GROUP BY name),
    told AS (SELECT sup.*, CASE WHEN {"true" if seen == "true" else f"successor IN (SELECT name FROM notes WHERE {seen})"} THEN successor END AS replaced_by FROM sup),
    marks AS (SELECT id, name, coalesce(valid_from > {at}, false) AS not_yet, coalesce(invalid_at <= {at}, false) AS ended FROM notes),
    states AS (SELECT marks.*, replaced_by, replaced_by IS NOT NULL OR not_yet OR ended AS outdated, successor IS NOT NULL OR not_yet OR ended AS demoted FROM marks LEFT JOIN told USING (name))"""


_RECENCY = f"(1 - 0.015 + 0.03 * pow(0.5, greatest(({NOW} - updated) / 86400.0, 0.0) / 90.0))"
_COLLAPSED = r"lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\s+', ' ', 'g'))"
_HITS = f"""hits AS (
        SELECT b.*, outdated, replaced_by, fused * [1.15, 1.10, 1.00, 0.92, 0.80][ring + 1] * {_RECENCY} * CASE WHEN demoted THEN 0.5 ELSE 1.0 END AS score
        FROM blocks b JOIN fused USING (citation) JOIN (SELECT id, outdated, demoted, replaced_by FROM states) USING (id)),
    keyed AS (SELECT *, CASE WHEN length({_COLLAPSED}) >= 80 THEN {_COLLAPSED} ELSE citation END AS key FROM hits),
    shown AS (SELECT citation, id, ring, outdated, replaced_by, max(score) OVER (PARTITION BY key) AS score, count(*) OVER (PARTITION BY key) AS copies,
              row_number() OVER (PARTITION BY key ORDER BY ring, updated DESC, score DESC, citation) AS r FROM keyed)"""
_LEX_QUERY = "Licensed thor reserved rights"


def _recall_sql(at: int = NOW, where: str = "true", tail: str = "", n: int = 8) -> str:
    return f"""{with_sql('notes', 'blocks')}, {_bm25_sql(_LEX_QUERY, 50, where)}, {_SEM % where}, {_FUSED}, {_superseded_sql(at, where)}, {_HITS}
        SELECT citation, id, ring, outdated, replaced_by, copies, round(score, 6) AS score FROM shown WHERE r = 1 {tail} ORDER BY shown.score DESC, citation LIMIT {n}"""


def _recall(spark, sf_dir, at: int = NOW, visible=None, **options):
    index, b, n = index_of(spark, sf_dir), blocks(spark, sf_dir), notes(spark, sf_dir)
    vectors = index.places.where("idx = 0").select("citation", "id").join(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "embedding"), "id").select("citation", "embedding")
    out = R.recall(index, b, n, _LEX_QUERY, _now(), F.timestamp_seconds(F.lit(at)), vectors, _query_vector(spark, sf_dir), visible(n) if visible else None, R.RecallOptions(**options))
    return out.select("citation", "id", "ring", "outdated", "replaced_by", "copies", F.round("score", 6).alias("score"))


@query(f"{with_sql('notes', 'blocks')}, {_bm25_sql(_LEX_QUERY, 50)}, {_SEM % 'true'}, {_FUSED} SELECT citation, round(fused, 9) AS fused FROM fused")
def rrf_fuse(spark, sf_dir):
    index = index_of(spark, sf_dir)
    near = index.places.where("idx = 0").select("citation", "id").join(_vectors(spark, sf_dir).select(F.col("vec_id").alias("id"), "embedding"), "id")
    lists = R.ranked(R.bm25(index, _LEX_QUERY), "score"), R.ranked(R.vector_top_k(near, _query_vector(spark, sf_dir)), "cosine")
    return R.rrf(*lists).select("citation", F.round("fused", 9).alias("fused"))


@query(_recall_sql(n=50))
def recall_weighted(spark, sf_dir):
    return _recall(spark, sf_dir, n=50)


@query(_recall_sql(at=_AT, n=50))
def recall_as_of(spark, sf_dir):
    return _recall(spark, sf_dir, at=_AT, n=50)


@query(_recall_sql(where="bereich IN ('src1', 'src2', 'src3', 'src4')"))
def recall_scoped(spark, sf_dir):
    return _recall(spark, sf_dir, scope=["src1", "src2", "src3", "src4"])


@query(_recall_sql(where="id % 4 <> 1"))
def recall_visible(spark, sf_dir):
    return _recall(spark, sf_dir, visible=lambda n: n.where("id % 4 <> 1").select("id"))


@query(_recall_sql(tail="AND ring > 1"))
def resident_skip(spark, sf_dir):
    return _recall(spark, sf_dir, with_residents=False)


@query(f"""{with_sql('notes', 'blocks')}, keyed AS (SELECT citation, ring, updated, {_COLLAPSED} AS c, CASE WHEN length({_COLLAPSED}) >= 80 THEN {_COLLAPSED} ELSE citation END AS key FROM blocks)
    SELECT citation, copies FROM (SELECT citation, count(*) OVER (PARTITION BY key) AS copies, row_number() OVER (PARTITION BY key ORDER BY ring, updated DESC, citation) AS r FROM keyed) WHERE r = 1 AND copies > 1""")
def recall_dedup(spark, sf_dir):
    return R.collapse_duplicates(blocks(spark, sf_dir).withColumn("score", F.lit(1.0))).where("copies > 1").select("citation", "copies")


@query(f"""{with_sql('notes', 'links')}
    SELECT name, linked_by, linked_updated FROM (
        SELECT h.name, s.name AS linked_by, s.updated AS linked_updated, row_number() OVER (PARTITION BY h.id ORDER BY s.updated DESC, s.name) AS r
        FROM (SELECT DISTINCT from_id, to_name FROM links) l JOIN notes h ON h.name = l.to_name JOIN notes s ON s.id = l.from_id WHERE s.id <> h.id AND s.updated > h.updated) WHERE r <= 3""")
def newer_links(spark, sf_dir):
    n = notes(spark, sf_dir)
    return R.newer_links(n, n, links(spark, sf_dir)).withColumn("linked_updated", F.unix_timestamp("linked_updated"))


@query(f"{with_sql('notes')}, {_superseded_sql(NOW)} SELECT name AS old, successor AS new FROM sup")
def superseded_at(spark, sf_dir):
    return R.superseded(notes(spark, sf_dir), _now())


@query(f"{with_sql('notes')}, {_superseded_sql(_AT)} SELECT id, replaced_by, not_yet, ended, outdated FROM states WHERE outdated")
def outdated_flags(spark, sf_dir):
    return R.outdated(notes(spark, sf_dir), F.timestamp_seconds(F.lit(_AT))).where("outdated").select("id", "replaced_by", "not_yet", "ended", "outdated")


@query(f"{with_sql('notes')} SELECT id, round({_RECENCY}, 9) AS weight FROM notes")
def recency_weight(spark, sf_dir):
    return notes(spark, sf_dir).select("id", F.round(S.recency_weight(F.col("updated"), _now()), 9).alias("weight"))


@query(f"""{with_sql('notes')} SELECT id, name, {NOW} - updated AS age FROM notes WHERE ring IN (2, 3) AND contains(name, '7') AND (invalid_at IS NULL OR invalid_at > {NOW}) AND {NOW} - updated <= 60 * 86400
    ORDER BY updated > {NOW}, updated DESC, name LIMIT 1""")
def handoff_latest(spark, sf_dir):
    n = notes(spark, sf_dir)
    age = F.unix_timestamp(_now()) - F.unix_timestamp("updated")
    fits = F.col("ring").isin(2, 3) & F.col("name").contains("7") & (F.col("invalid_at").isNull() | (F.col("invalid_at") > _now())) & (age <= 60 * 86400)
    return n.where(fits).orderBy(F.col("updated") > _now(), F.desc("updated"), "name").limit(1).select("id", "name", age.alias("age"))


CANARIES_SQL = """marks AS (SELECT item_id, regexp_replace(lower(text), '[^\\pL\\pN]+', '', 'g') AS passage FROM benchmark), forms AS (SELECT doc_id, regexp_replace(lower(text), '[^\\pL\\pN]+', '', 'g') AS form FROM documents),
    canaries AS (SELECT item_id, doc_id FROM marks JOIN forms ON length(passage) >= 12 AND contains(form, passage))"""


@query(f"""WITH {CANARIES_SQL}, r AS (SELECT item_id AS query, doc_id AS doc FROM canaries),
    k AS (SELECT query, doc, row_number() OVER (PARTITION BY query ORDER BY (doc * 7919) % 1000, doc) AS rank FROM r),
    q AS (SELECT query, count(*) AS m, min(rank) AS first, count(*) FILTER (rank <= 10) AS in10, sum(1 / log2(rank + 1)) FILTER (rank <= 10) AS dcg FROM k GROUP BY query)
    SELECT count(*) AS n, avg(CAST(first <= 1 AS DOUBLE)) AS r_at_1, avg(CAST(first <= 3 AS DOUBLE)) AS r_at_3, avg(CAST(first <= 5 AS DOUBLE)) AS r_at_5, avg(CAST(first <= 10 AS DOUBLE)) AS r_at_10,
        round(avg(CAST(in10 = m AS DOUBLE)), 6) AS rall_at_10, round(avg(1.0 / first), 6) AS mrr, round(avg(dcg / list_sum(list_transform(range(1, least(m, 10) + 1), lambda i: 1 / log2(i + 1)))), 6) AS ndcg_at_10 FROM q""")
def retrieval_metrics(spark, sf_dir):
    from pyspark.sql import Window

    found = canary_pairs(spark, sf_dir)
    order = Window.partitionBy("query").orderBy(F.col("doc") * 7919 % 1000, "doc")
    out = R.retrieval_metrics(found.withColumn("rank", F.row_number().over(order)), found)
    return out.select("n", *[c for c in out.columns if c.startswith("r_at")], *[F.round(c, 6).alias(c) for c in ("rall_at_10", "mrr", "ndcg_at_10")])


def canary_pairs(spark, sf_dir):
    """(query, doc): benchmark passages that documents contain, by letters and digits in lower case. A passage of fewer than CANARY_LEAST of
    these is never matched. Passages meet the documents that hold their first CANARY_LEAST letters, then are looked for whole; only
    where the passages are few and short enough for a broadcast of proven size are they looked for in every document at once."""
    marks = cut(table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query"), S.canary_form(F.col("text")).alias("passage")).where(F.length("passage") >= CANARY_LEAST), "marks")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), S.canary_form(F.col("text")).alias("form"))
    begins = marks.withColumn("begin", F.substring("passage", 1, CANARY_LEAST))
    if cut_bytes(marks) <= BROADCAST_BYTES and marks.count() <= CANARY_BROADCAST:
        return docs.join(F.broadcast(marks), F.col("form").contains(F.col("passage"))).select("query", "doc")
    places = F.sequence(F.lit(1), F.length("form") - CANARY_LEAST + 1)
    grams = F.array_distinct(F.transform(places, lambda i: F.substring(F.col("form"), i, F.lit(CANARY_LEAST))))
    held = docs.where(F.length("form") >= CANARY_LEAST).select("doc", "form", F.explode(grams).alias("begin"))
    known = join_sized(held.select("doc", "begin"), cut(begins.select("begin").distinct(), "begins"), ["begin"], "left_semi")
    meet = cut(known.join(begins.select("begin", "query", "passage"), "begin").select("doc", "query", "passage").distinct(), "meet")
    return join_sized(docs, meet, ["doc"], "inner").where(F.col("form").contains(F.col("passage"))).select("query", "doc").distinct()


@query(f"""{with_sql('notes', 'blocks')}, f AS (SELECT id, min(citation) AS citation, any_value(ring) AS ring FROM blocks GROUP BY id)
    SELECT CASE WHEN a.ring < b.ring THEN a.citation ELSE b.citation END AS winner, CASE WHEN a.ring < b.ring THEN b.citation ELSE a.citation END AS loser FROM f a JOIN f b ON b.id = a.id + 5 - a.id % 3 WHERE a.ring <> b.ring""")
def conflict_sides(spark, sf_dir):
    first = blocks(spark, sf_dir).groupBy("id").agg(F.min("citation").alias("citation"), F.first("ring").alias("ring"))
    other = first.select((F.col("id")).alias("to"), F.col("citation").alias("b"))
    verdicts = first.select((F.col("id") + 5 - F.col("id") % 3).alias("to"), F.col("citation").alias("a")).join(other, "to").select("a", "b")
    return R.conflict_sides(verdicts, first)
