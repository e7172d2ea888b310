"""Queries on the index: counts, links, integrity, copies, incremental maintenance."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrove.operators import index as I
from inkgrove.plans.registry import query
from inkgrove.plans.retrieval_queries import CANARIES_SQL, canary_pairs
from inkgrove.session import table
from inkgrove.sources.corpus import blocks, links, notes, with_sql

_V = "SELECT vec_id FROM embeddings"
_KEY = r"(CASE WHEN length(lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\s+', ' ', 'g'))) >= 80 THEN lower(regexp_replace(trim(regexp_replace(text, '\s+', ' ', 'g')), '\s+', ' ', 'g')) END)"


@query(f"""{with_sql('notes', 'blocks', 'links')} SELECT (SELECT count(*) FROM notes) AS notes, (SELECT count(*) FROM blocks) AS blocks, (SELECT count(*) FROM links) AS links,
    (SELECT count(*) FROM links WHERE to_name NOT IN (SELECT name FROM notes)) AS dangling, (SELECT count(*) FROM embeddings) AS vectors""")
def index_stats(spark, sf_dir):
    return I.stats(notes(spark, sf_dir), blocks(spark, sf_dir), links(spark, sf_dir), table(spark, sf_dir, "embeddings"))


@query(f"{with_sql('notes')} SELECT ring, count(*) AS notes FROM notes GROUP BY ring")
def notes_per_ring(spark, sf_dir):
    return notes(spark, sf_dir).groupBy("ring").agg(F.count("*").alias("notes"))


@query(f"""{with_sql('notes', 'blocks', 'links')}, n AS (SELECT * FROM notes WHERE id % 10 <> 3), b AS (SELECT id, CASE WHEN id % 13 = 5 THEN ring + 1 ELSE ring END AS ring FROM blocks WHERE id % 8 <> 1)
    SELECT 'blocks-without-note' AS "check", (SELECT count(*) FROM b WHERE id NOT IN (SELECT id FROM n)) AS problems UNION ALL SELECT 'links-without-note', count(*) FROM links WHERE from_id NOT IN (SELECT id FROM n)
    UNION ALL SELECT 'links-unresolved', count(*) FROM links WHERE to_name NOT IN (SELECT name FROM n)
    UNION ALL SELECT 'vectors-without-block', count(*) FROM embeddings WHERE vec_id NOT IN (SELECT id FROM b)
    UNION ALL SELECT 'notes-without-block', count(*) FROM n WHERE id NOT IN (SELECT id FROM b)
    UNION ALL SELECT 'ring-mismatch', count(*) FROM b JOIN n USING (id) WHERE b.ring <> n.ring UNION ALL SELECT 'citation-twice', count(*) FROM (SELECT id FROM b GROUP BY id HAVING count(*) > 1)""")
def integrity_checks(spark, sf_dir):
    i = F.col("id")
    b = blocks(spark, sf_dir).where(i % 8 != 1).withColumn("citation", i).withColumn("ring", F.when(i % 13 == 5, F.col("ring") + 1).otherwise(F.col("ring")))
    return I.integrity(notes(spark, sf_dir).where(i % 10 != 3), b, links(spark, sf_dir), table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "citation"))


@query(f"{with_sql('notes', 'links')} SELECT from_id, pos, to_name FROM links WHERE to_name NOT IN (SELECT name FROM notes)")
def dangling_links(spark, sf_dir):
    return I.unresolved(links(spark, sf_dir), notes(spark, sf_dir)).select("from_id", "pos", "to_name")


@query(f"""{with_sql('notes', 'links')}, e AS (SELECT from_id, id AS to_id FROM links LEFT JOIN notes ON name = to_name)
    SELECT n.id, coalesce(o.n, 0) AS links_out, coalesce(i.n, 0) AS links_in, coalesce(o.d, 0) AS dangling FROM notes n
    LEFT JOIN (SELECT from_id, count(*) AS n, count(*) FILTER (to_id IS NULL) AS d FROM e GROUP BY from_id) o ON o.from_id = n.id
    LEFT JOIN (SELECT to_id, count(*) AS n FROM e WHERE to_id IS NOT NULL GROUP BY to_id) i ON i.to_id = n.id""")
def link_degrees(spark, sf_dir):
    return I.degrees(notes(spark, sf_dir), links(spark, sf_dir))


@query(f"{with_sql('links')} SELECT from_id, string_agg(to_name, ',' ORDER BY pos) AS targets FROM links GROUP BY from_id")
def note_link_lists(spark, sf_dir):
    return I.link_lists(links(spark, sf_dir)).select("from_id", F.array_join("targets", ",").alias("targets"))


_PAIRS = f"""k AS (SELECT DISTINCT name, {_KEY} AS key FROM blocks WHERE {_KEY} IS NOT NULL), s AS (SELECT name, count(*) AS n, md5(string_agg(key, chr(1) ORDER BY key)) AS bag FROM k GROUP BY name),
    l AS (SELECT bag, min(name) AS least, any_value(n) AS n FROM s GROUP BY bag),
    p AS (SELECT a.name AS a, b.name AS b, count(*) AS shared FROM k a JOIN k b USING (key) WHERE a.name < b.name AND a.name IN (SELECT least FROM l) AND b.name IN (SELECT least FROM l) GROUP BY 1, 2),
    pairs AS (SELECT a, b, shared, least(x.n, y.n) AS smaller FROM p JOIN s x ON x.name = a JOIN s y ON y.name = b WHERE shared * 100 >= 50 * least(x.n, y.n)
        UNION ALL SELECT least, name, s.n, s.n FROM s JOIN l USING (bag) WHERE name <> least)"""


@query(f"{with_sql('notes', 'blocks')}, {_PAIRS} SELECT a, b, shared, smaller FROM pairs")
def shared_blocks(spark, sf_dir):
    return I.shared_blocks(blocks(spark, sf_dir))


@query(f"""WITH RECURSIVE {with_sql('notes', 'blocks')[5:]}, {_PAIRS}, e AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs),
    r(node, root) AS (SELECT a, a FROM e UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node), roots AS (SELECT node, min(root) AS root FROM r GROUP BY node)
    SELECT root, count(*) AS members, (SELECT count(*) FROM pairs JOIN roots q ON q.node = a WHERE q.root = roots.root) AS pairs FROM roots GROUP BY root""")
def copy_components(spark, sf_dir):
    return I.copies_of(blocks(spark, sf_dir)).select("root", "members", "pairs")


@query("""WITH s AS (SELECT doc_id AS id, md5(text) AS hash, doc_id % 7 AS mtime, doc_id % 13 <> 0 AS has_vectors FROM documents WHERE doc_id % 10 <> 3),
    f AS (SELECT doc_id AS id, CASE WHEN doc_id % 17 = 0 THEN 'x' ELSE md5(text) END AS hash, CASE WHEN doc_id % 5 = 0 THEN -1 ELSE doc_id % 7 END AS mtime FROM documents WHERE doc_id % 11 <> 4)
    SELECT coalesce(s.id, f.id) AS id, CASE WHEN s.id IS NULL THEN 'new' WHEN f.id IS NULL THEN 'gone' WHEN s.hash <> f.hash THEN 'changed' WHEN NOT has_vectors THEN 'needs-vectors' WHEN s.mtime <> f.mtime THEN 'touched' ELSE 'unchanged' END AS state
    FROM s FULL JOIN f ON s.id = f.id""")
def scan_diff(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.md5("text").alias("h"))
    stored = d.where(i % 10 != 3).select(i.alias("id"), F.col("h").alias("hash"), (i % 7).alias("mtime"), (i % 13 != 0).alias("has_vectors"))
    found = d.where(i % 11 != 4).select(i.alias("id"), F.when(i % 17 == 0, "x").otherwise(F.col("h")).alias("hash"), F.when(i % 5 == 0, -1).otherwise(i % 7).alias("mtime"))
    return I.snapshot_diff(stored, found)


@query(f"""{with_sql('notes', 'blocks')} SELECT citation FROM (SELECT citation, row_number() OVER (ORDER BY citation) - 1 AS i, greatest(1, count(*) OVER () // 40) AS step FROM blocks) WHERE i % step = 0 AND i < step * 40""")
def sample_blocks(spark, sf_dir):
    b = blocks(spark, sf_dir)
    return I.sample_blocks(b, 40, b.count()).select("citation")


@query(f"{with_sql('notes', 'blocks')} SELECT citation, id FROM blocks WHERE contains(lower(text), 'apache')")
def blocks_containing(spark, sf_dir):
    return I.blocks_containing(blocks(spark, sf_dir), "Apache").select("citation", "id")


@query(f"{with_sql('notes')} SELECT name, ring, (SELECT count(*) FROM notes WHERE lang = 'en' AND contains(name, '1')) AS total FROM notes WHERE lang = 'en' AND contains(name, '1') ORDER BY updated DESC, name LIMIT 25 OFFSET 10")
def note_page(spark, sf_dir):
    return I.note_page(notes(spark, sf_dir), lang="en", q="1", offset=10, limit=25).select("name", "ring", "total")


@query(f"""{with_sql('notes', 'blocks', 'links')}, t AS (SELECT id FROM notes WHERE id % 50 = 7)
    SELECT 'notes' AS kind, count(*) AS removed FROM notes WHERE id IN (SELECT id FROM t) UNION ALL SELECT 'blocks', count(*) FROM blocks WHERE id IN (SELECT id FROM t)
    UNION ALL SELECT 'links', count(*) FROM links WHERE from_id IN (SELECT id FROM t) UNION ALL SELECT 'vectors', count(*) FROM embeddings WHERE vec_id IN (SELECT id FROM t)""")
def delete_counts(spark, sf_dir):
    n = notes(spark, sf_dir)
    return I.delete_counts(n.where("id % 50 = 7").select("id"), notes=(n, "id"), blocks=(blocks(spark, sf_dir), "id"), links=(links(spark, sf_dir), "from_id"), vectors=(table(spark, sf_dir, "embeddings"), "vec_id"))


@query("""WITH n AS (SELECT doc_id AS id, md5(text) AS h FROM documents WHERE doc_id % 4 <> 0), u AS (SELECT doc_id AS id, 'new' AS h FROM documents WHERE doc_id % 6 = 0)
    SELECT h = 'new' AS fresh, count(*) AS n FROM (SELECT * FROM n WHERE id NOT IN (SELECT id FROM u) UNION ALL SELECT * FROM u) GROUP BY 1""")
def upsert_notes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.md5("text").alias("h"))
    return I.upsert(d.where("id % 4 <> 0"), d.where("id % 6 = 0").withColumn("h", F.lit("new"))).groupBy((F.col("h") == "new").alias("fresh")).agg(F.count("*").alias("n"))


@query("""WITH a AS (SELECT doc_id AS id, 'src/' || (doc_id % 60) || '.md' AS path, md5('v' || doc_id % 60) AS sha256 FROM documents),
    f AS (SELECT 'src/' || i || '.md' AS path, md5(CASE WHEN i % 4 = 0 THEN 'w' ELSE 'v' END || i) AS sha256 FROM range(50) t(i))
    SELECT id, path, CASE WHEN f.sha256 IS NULL THEN 'missing' WHEN f.sha256 = a.sha256 THEN 'same' ELSE 'changed' END AS state FROM a LEFT JOIN f USING (path)""")
def anchor_drift(spark, sf_dir):
    i = F.col("doc_id")
    path = lambda k: F.concat(F.lit("src/"), k, F.lit(".md"))
    a = table(spark, sf_dir, "documents").select(i.alias("id"), path(i % 60).alias("path"), F.md5(F.concat(F.lit("v"), i % 60)).alias("sha256"))
    k = F.col("id")
    f = spark.range(50).select(path(k).alias("path"), F.md5(F.concat(F.when(k % 4 == 0, "w").otherwise("v"), k)).alias("sha256"))
    return I.anchor_drift(a, f)


@query(f"""{with_sql('notes', 'links')}, {CANARIES_SQL} SELECT CASE WHEN n = 0 THEN 'ok' ELSE 'problem' END AS severity, "check", n || ' found' AS detail FROM (
    SELECT 'dangling-links' AS "check", (SELECT count(*) FROM links WHERE to_name NOT IN (SELECT name FROM notes)) AS n
    UNION ALL SELECT 'no-department', (SELECT count(*) FROM notes WHERE bereich IS NULL) UNION ALL SELECT 'bad-retention', (SELECT count(*) FROM notes WHERE retention = 'soon')
    UNION ALL SELECT 'empty-text', (SELECT count(*) FROM notes WHERE coalesce(text, '') = '') UNION ALL SELECT 'contaminated', (SELECT count(DISTINCT doc_id) FROM canaries))""")
def doctor(spark, sf_dir):
    n = notes(spark, sf_dir)
    return I.doctor(
        dangling_links=I.unresolved(links(spark, sf_dir), n), no_department=n.where("bereich is null"), bad_retention=n.where("retention = 'soon'"), empty_text=n.where("coalesce(text, '') = ''"), contaminated=canary_pairs(spark, sf_dir).select("doc").distinct()
    )
