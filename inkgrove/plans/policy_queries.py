"""Queries on policy, ingest and the fleet."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrove.functions import scalars as S
from inkgrove.operators import ingest as G
from inkgrove.operators import pii as P
from inkgrove.operators import policy as Y
from inkgrove.plans.registry import query
from inkgrove.session import table
from inkgrove.sources.corpus import NOW, audit, blocks, notes, with_sql


def _now():
    return F.timestamp_seconds(F.lit(NOW))


_EXPIRES = "(to_timestamp(created) AT TIME ZONE 'UTC') + CASE retention WHEN 'P30D' THEN INTERVAL 30 DAY WHEN 'P1Y' THEN INTERVAL 1 YEAR WHEN 'P1M' THEN INTERVAL 1 MONTH END"
_RETENTION = f"""r AS (SELECT id, name, ring, retention, CASE WHEN retention IN ('P30D', 'P1Y', 'P1M') THEN CAST(epoch({_EXPIRES}) AS BIGINT) END AS expires FROM notes),
    q AS (SELECT *, CASE WHEN retention IS NULL THEN 'indefinite' WHEN expires IS NULL THEN 'invalid' WHEN expires <= {NOW} THEN 'due' ELSE 'pending' END AS status FROM r)"""


@query(f"{with_sql('notes')}, {_RETENTION} SELECT id, status, expires FROM q WHERE status <> 'indefinite'")
def retention_queue(spark, sf_dir):
    q = Y.retention(notes(spark, sf_dir), _now()).where("status <> 'indefinite'")
    return q.orderBy(*Y.retention_order(q)).select("id", "status", F.unix_timestamp("expires").alias("expires"))


@query(f"{with_sql('notes')}, {_RETENTION} SELECT status, count(*) AS n FROM q GROUP BY status")
def retention_totals(spark, sf_dir):
    return Y.retention(notes(spark, sf_dir), _now()).groupBy("status").agg(F.count("*").alias("n"))


@query(f"""{with_sql('notes', 'blocks', 'audit')} SELECT 'block' AS kind, citation AS ref, ring FROM blocks WHERE contains(lower(text), '@mail')
    UNION ALL SELECT 'audit', CAST(seq AS VARCHAR), NULL FROM audit WHERE contains(lower(actor || ' ' || action || ' ' || subject || ' ' || detail), '@mail')""")
def subject_access(spark, sf_dir):
    return Y.subject_access(blocks(spark, sf_dir), audit(spark, sf_dir), "@mail").select("kind", "ref", "ring")


@query(f"{with_sql('notes', 'blocks')} SELECT citation, lower(substr(text, greatest(1, strpos(lower(text), 'license') - 60), strpos(lower(text), 'license') - greatest(1, strpos(lower(text), 'license') - 60) + 67)) AS excerpt FROM blocks WHERE contains(lower(text), 'license')")
def excerpts(spark, sf_dir):
    b = blocks(spark, sf_dir).where(F.contains(F.lower("text"), F.lit("license")))
    return b.select("citation", F.lower(S.excerpt(F.col("text"), F.lit("license"))).alias("excerpt"))


@query("WITH t(id) AS (SELECT * FROM range(0, 2000, 150)) SELECT id, id IN (SELECT doc_id FROM documents) AS found, (SELECT count(*) FROM conversations WHERE conv_id = t.id AND turn = 1) AS residue FROM t")
def erasure_receipt(spark, sf_dir):
    left = table(spark, sf_dir, "conversations").where("turn = 1").select(F.col("conv_id").alias("id"))
    return Y.erasure_receipt(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")), spark.range(0, 2000, 150), left)


_MAIL = r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"


@query(f"SELECT doc_id, len(regexp_extract_all(text, '{_MAIL}')) AS n FROM documents WHERE regexp_matches(text, '{_MAIL}')")
def pii_email(spark, sf_dir):
    d = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@")) & F.col("text").rlike(_MAIL))
    return d.select("doc_id", F.regexp_count("text", F.lit(_MAIL)).cast("bigint").alias("n"))


@query()
def pii_counts(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", F.explode(P.findings(F.col("text"))).alias("f"))
    return found.groupBy("f.kind", "f.confidence").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("documents"))


_LOCAL = r"[A-Za-z0-9][A-Za-z0-9._%+''-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)*\.[A-Za-z]{2,24}"
_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"


@query(rf"""WITH e AS (SELECT 'email' AS kind, lower(unnest(regexp_extract_all(text, '{_LOCAL}'))) AS found FROM documents),
    i AS (SELECT 'ipv4' AS kind, unnest(regexp_extract_all(text, '\b{_OCTET}(?:\.{_OCTET}){{3}}\b')) AS found FROM documents)
    SELECT kind, CASE WHEN regexp_matches(found, '@example\.(com|org|net)$|\.(example|invalid|test)$|^git@|^noreply|^no-reply@') THEN 'low' ELSE 'high' END AS confidence, count(*) AS n FROM e GROUP BY 1, 2
    UNION ALL SELECT kind, CASE WHEN regexp_matches(found, '^(10\.|127\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|192\.0\.2\.|198\.51\.100\.|203\.0\.113\.|0\.0\.0\.0$|255\.255\.255\.255$)') THEN 'low' ELSE 'high' END, count(*) FROM i GROUP BY 1, 2""")
def pii_addresses(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select(F.explode(P.findings(F.col("text"))).alias("f")).where(F.col("f.kind").isin("email", "ipv4"))
    return found.groupBy("f.kind", "f.confidence").agg(F.count("*").alias("n"))


@query()
def redact(spark, sf_dir):
    clean = table(spark, sf_dir, "documents").select("doc_id", P.redact(F.col("text")).alias("clean"))
    return clean.select("doc_id", F.sha2("clean", 256).alias("sha256"), F.regexp_count("clean", F.lit(r"\[redacted:")).alias("n"))


@query()
def write_gate(spark, sf_dir):
    return P.write_gate(table(spark, sf_dir, "documents").select("doc_id", "text"), choice=F.when(F.col("doc_id") % 2 == 0, "flagged")).groupBy("pii").agg(F.count("*").alias("n"))




@query(f"""SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN 'pending' WHEN event_id % 7 = 0 THEN 'closed' WHEN epoch(date_trunc('second', ts)) + 60 * 86400 >= {NOW} THEN 'open' ELSE 'closed' END AS state FROM events""")
def access_window(spark, sf_dir):
    k = F.col("event_id")
    approved = F.when(k % 3 != 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    expires = F.when(k % 7 == 0, F.col("event_type")).otherwise(F.date_format(F.expr("ts + INTERVAL 60 DAY"), "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "events").select(k.alias("id"), S.window_state(approved, expires, _now()).alias("state"))


@query(f"""SELECT event_id AS id, CASE WHEN event_id % 6 <= 1 THEN 'open' WHEN event_id % 6 = 5 OR ahead <= 0 THEN 'expired' WHEN ahead <= 7 * 86400 THEN 'soon' ELSE 'valid' END AS state
    FROM (SELECT event_id, CASE WHEN event_id % 6 = 3 THEN epoch(date_trunc('day', ts)) ELSE epoch(date_trunc('second', ts)) END + 50 * 86400 - {NOW} AS ahead FROM events)""")
def token_expiry(spark, sf_dir):
    k, until = F.col("event_id") % 6, F.expr("ts + INTERVAL 50 DAY")
    raw = F.when(k == 0, F.lit(None)).when(k == 1, "").when(k == 3, F.date_format(until, "yyyy-MM-dd")).when(k == 5, F.col("props")).otherwise(F.date_format(until, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), S.token_state(raw, _now()).alias("state"))


_GRANTS = """g AS (SELECT 'dev-' || (s_suppkey % 4) AS device, 'src' || (s_suppkey % 12) AS bereich, ['in', 'out', 'both'][s_suppkey % 3 + 1] AS direction, s_suppkey % 5 < 2 AS effective, s_suppkey % 5 = 2 AS pending FROM supplier)"""


@query(f"""{with_sql('notes')}, {_GRANTS}, o AS (SELECT 'dev-' || (id % 4) AS device, name, ring, bereich, CASE WHEN id % 2 = 0 THEN 'in' ELSE 'out' END AS direction FROM notes),
    f AS (SELECT o.name, any_value(o.ring) AS ring, any_value(o.bereich) AS bereich, count(g.direction) AS n, bool_or(effective AND (g.direction = 'both' OR g.direction = o.direction)) AS ok, bool_or(effective) AS e, bool_or(pending) AS p
        FROM o LEFT JOIN g ON g.device = o.device AND g.bereich = o.bereich GROUP BY o.name)
    SELECT name, CASE WHEN ring <= 1 THEN 'ring-never-leaves' WHEN bereich IS NULL THEN 'no-department' WHEN n = 0 THEN 'no-grant' WHEN ok THEN 'allowed' WHEN e THEN 'wrong-direction' WHEN p THEN 'awaiting' ELSE 'revoked' END AS decision FROM f""")
def may_move(spark, sf_dir):
    s = F.col("s_suppkey")
    grants = table(spark, sf_dir, "supplier").select(F.concat(F.lit("dev-"), s % 4).alias("device"), F.concat(F.lit("src"), s % 12).alias("bereich"), F.element_at(F.array(*map(F.lit, ("in", "out", "both"))), (s % 3 + 1).cast("int")).alias("direction"), (s % 5 < 2).alias("effective"), (s % 5 == 2).alias("pending"))
    offers = notes(spark, sf_dir).select(F.concat(F.lit("dev-"), F.col("id") % 4).alias("device"), "name", "ring", "bereich", F.when(F.col("id") % 2 == 0, "in").otherwise("out").alias("direction"))
    return Y.may_move(offers, grants).select("name", "decision")


@query("""WITH h AS (SELECT doc_id, 'n' || doc_id AS name, doc_id % 9 AS updated, lang AS body FROM documents WHERE doc_id % 4 <> 0),
    o AS (SELECT doc_id, 'n' || doc_id AS name, CASE WHEN doc_id % 3 = 0 THEN doc_id % 9 ELSE 50 END AS updated, lang AS body, CASE WHEN doc_id % 5 < 3 THEN doc_id % 9 ELSE 1 END AS based_on FROM documents)
    SELECT o.name, CASE WHEN o.doc_id % 10 = 7 THEN 'erased' WHEN h.name IS NULL THEN 'stored' WHEN h.updated = o.updated AND h.body = o.body THEN 'unchanged' WHEN based_on = h.updated THEN 'stored' ELSE 'conflict' END AS outcome FROM o LEFT JOIN h USING (name)""")
def sync_merge(spark, sf_dir):
    i = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("n"), i).alias("name"), F.col("lang").alias("body"))
    held = d.where(i % 4 != 0).withColumn("updated", i % 9)
    offers = d.withColumn("updated", F.when(i % 3 == 0, i % 9).otherwise(50)).withColumn("based_on", F.when(i % 5 < 3, i % 9).otherwise(1))
    return Y.sync_merge(held, offers, d.where(i % 10 == 7))


@query("SELECT count(*) AS rows, count(*) FILTER (doc_id % 6 = 0) AS resolved FROM documents")
def conflict_resolution(spark, sf_dir):
    i = F.col("doc_id")
    held = table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), i).alias("name"), i.alias("updated"), F.lit("held").alias("body"), i)
    conflicts = held.where(i % 3 == 0).select(i.alias("conflict_id"), "name", "updated", F.lit("offered").alias("body"))
    decisions = held.where(i % 3 == 0).select(i.alias("conflict_id"), F.when(i % 2 == 0, "offered").otherwise("held").alias("keep"))
    return Y.resolve_conflicts(held.drop("doc_id"), conflicts, decisions).agg(F.count("*").alias("rows"), F.count_if(F.col("body") == "offered").alias("resolved"))


@query("SELECT 'n' || doc_id AS name FROM documents WHERE doc_id % 10 <> 7")
def tombstones(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("n"), "doc_id").alias("name"))
    return d.join(d.where("doc_id % 10 = 7").select("name"), "name", "left_anti").select("name")


@query("""SELECT s_suppkey AS id, CASE WHEN s_suppkey % 11 = 0 THEN '' ELSE array_to_string(list_filter([CASE WHEN s_suppkey % 7 = 0 THEN 'never-reported' WHEN s_suppkey % 10 >= 2 THEN 'quiet' END, CASE WHEN s_suppkey % 13 = 0 THEN 'refused' END,
    CASE s_suppkey % 6 WHEN 3 THEN 'token-expiring' WHEN 2 THEN 'token-expired' WHEN 5 THEN 'token-expired' END, CASE WHEN s_suppkey % 4 = 1 THEN 'behind' END], lambda x: x IS NOT NULL), ',') END AS concerns FROM supplier""")
def fleet_concerns(spark, sf_dir):
    k = F.col("s_suppkey")
    t = k % 6
    devices = table(spark, sf_dir, "supplier").select(
        k.alias("id"), (k % 11 != 0).alias("active"), F.when(k % 7 != 0, F.timestamp_seconds(F.lit(NOW) - k % 10 * 86400)).alias("last_seen"), F.when(k % 13 == 0, "bad chain").alias("last_refusal"),
        F.when(t == 1, "").when(t == 2, "2024-02-29T23:59:59Z").when(t == 3, "2024-03-05").when(t == 4, "2024-12-30T00:00:00Z").when(t == 5, "garbage").alias("expires_at"),
        F.element_at(F.array(*map(F.lit, ("1.10.0", "1.9.9", "dev", "2.0.0-rc1"))), (k % 4 + 1).cast("int")).alias("version"),
    )
    return Y.concerns(devices, _now(), "1.10.0").select("id", F.array_join("concerns", ",").alias("concerns"))


@query("SELECT 'user-' || user_id AS device, count(*) AS failures FROM events WHERE event_type IN ('click', 'view') AND user_id % 40 < 10 AND ts >= TIMESTAMP '2024-01-03' GROUP BY 1")
def governance_failures(spark, sf_dir):
    log = audit(spark, sf_dir).where(F.col("action").isin("note.click", "note.view") & F.col("subject").rlike("^note-[0-9]$") & (F.col("at") >= F.lit("2024-01-03").cast("timestamp")))
    return log.groupBy(F.col("actor").alias("device")).agg(F.count("*").alias("failures"))


@query("SELECT count(DISTINCT coalesce(CASE WHEN o_custkey % 3 = 0 THEN 'm' || (o_custkey % 50) END, 'c' || o_custkey)) AS seats FROM orders")
def seats_distinct(spark, sf_dir):
    k = F.col("o_custkey")
    machine = F.when(k % 3 == 0, F.concat(F.lit("m"), k % 50))
    return table(spark, sf_dir, "orders").agg(F.count_distinct(F.coalesce(machine, F.concat(F.lit("c"), k))).alias("seats"))


@query("""WITH a AS (SELECT 'k' || (event_id % 300) AS key FROM events GROUP BY 1), s AS (SELECT 'k' || (s_suppkey * 2 - 1) AS key, max(s_suppkey % 40) AS ago FROM supplier GROUP BY 1)
    SELECT a.key FROM a LEFT JOIN s USING (key) WHERE ago IS NULL OR ago >= 24""")
def alerts_due(spark, sf_dir):
    alerts = table(spark, sf_dir, "events").select(F.concat(F.lit("k"), F.col("event_id") % 300).alias("key")).distinct()
    s = F.col("s_suppkey")
    sent = table(spark, sf_dir, "supplier").select(F.concat(F.lit("k"), s * 2 - 1).alias("key"), F.timestamp_seconds(F.lit(NOW) - s % 40 * 3600).alias("at"))
    return Y.alerts_due(alerts, sent, _now(), 24).select("key")


@query("SELECT event_id % 16 AS device, count(*) AS rows FROM events WHERE event_id % 16 IN (2, 4, 6) AND ts >= TIMESTAMP '2024-01-05' AND ts <= TIMESTAMP '2024-01-15' GROUP BY 1")
def disclosure_window(spark, sf_dir):
    log = audit(spark, sf_dir).withColumn("device", F.col("seq") % 16)
    day = lambda d: F.lit(d).cast("timestamp")
    requests = spark.range(8).select(F.col("id").alias("request_id"), F.col("id").alias("device"), day("2024-01-05").alias("from"), day("2024-01-15").alias("to"), (F.col("id") % 2 == 0).alias("approved"), F.when(F.col("id") == 0, day("2024-02-01")).otherwise(day("2024-06-01")).alias("until"))
    return Y.disclose(log, requests, _now()).groupBy("device").agg(F.count("*").alias("rows"))


@query("""WITH i AS (SELECT 'n' || (doc_id % 400) AS name, 'p' || lpad(CAST(doc_id AS VARCHAR), 7, '0') AS path, CASE WHEN doc_id % 400 < 100 THEN 'same' ELSE lang END AS body FROM documents),
    w AS (SELECT *, min(body) OVER (PARTITION BY name) = max(body) OVER (PARTITION BY name) AS same, row_number() OVER (PARTITION BY name ORDER BY path) AS r FROM i)
    SELECT path, CASE WHEN same AND r = 1 THEN 'written' WHEN same THEN 'duplicate' ELSE 'collided' END AS outcome FROM w""")
def name_collisions(spark, sf_dir):
    return G.resolve_collisions(_items(spark, sf_dir)).select("path", "outcome")


def _items(spark, sf_dir):
    i = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(F.concat(F.lit("n"), i % 400).alias("name"), F.concat(F.lit("p"), F.lpad(i.cast("string"), 7, "0")).alias("path"), F.when(i % 400 < 100, "same").otherwise(F.col("lang")).alias("body"))


@query("""WITH i AS (SELECT 'n' || (doc_id % 400) AS name, doc_id, CASE WHEN doc_id % 400 < 100 THEN 'same' ELSE lang END AS body FROM documents),
    w AS (SELECT min(body) OVER (PARTITION BY name) = max(body) OVER (PARTITION BY name) AS same, row_number() OVER (PARTITION BY name ORDER BY doc_id) AS r FROM i)
    SELECT count(*) AS found, count(*) FILTER (same AND r = 1) AS written, 0 AS unchanged, 0 AS updated, 0 AS held, count(*) FILTER (same AND r > 1) AS duplicate, count(*) FILTER (NOT same) AS collided, 0 AS "exists", 0 AS failed, true AS balanced FROM w""")
def import_ledger(spark, sf_dir):
    return G.ledger(G.resolve_collisions(_items(spark, sf_dir)))


@query("""SELECT CASE WHEN doc_id % 5 = 0 THEN 'skipped' WHEN source IN ('src1', 'src2') THEN 'first' WHEN doc_id % 2 = 0 THEN 'rest' END AS "group", count(*) AS n FROM documents GROUP BY 1""")
def import_groups(spark, sf_dir):
    i = F.col("doc_id")
    path = F.concat(F.lit("tree/"), "source", F.lit("/"), F.when(i % 5 == 0, "tmp/").otherwise(""), i, F.when(i % 2 == 0, ".md").otherwise(".txt"))
    files = table(spark, sf_dir, "documents").select(path.alias("path"))
    return G.assign_group(files, ["tmp/**"], [("first", ["/tree/src1/**", "/tree/src2/**"]), ("rest", ["*.md"])]).groupBy("group").agg(F.count("*").alias("n"))


@query(f"{with_sql('notes')} SELECT CAST(sum(length(text)) AS BIGINT) AS resident_tokens, sum(length(text)) <= 8192 AS fits FROM notes WHERE ring <= 1")
def resident_projection(spark, sf_dir):
    return G.resident_projection(notes(spark, sf_dir), F.length("text"))


@query("SELECT 'note-' || doc_id AS name, source FROM documents WHERE source IN ('src3', 'src4')")
def stale_notes(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("note-"), "doc_id").alias("name"), F.array(F.lit("x"), F.concat(F.lit("src:"), "source")).alias("tags"))
    live = table(spark, sf_dir, "documents").select("source").where("source not in ('src3', 'src4')").distinct()
    return G.stale(d, live)
