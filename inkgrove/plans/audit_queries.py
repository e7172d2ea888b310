"""Queries on the audit log and on usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from inkgrove.operators import audit as A
from inkgrove.operators import usage as U
from inkgrove.plans.registry import query
from inkgrove.session import table
from inkgrove.sources.corpus import audit, blocks, with_sql

_LOG = with_sql("audit")


@query(f"""{_LOG} SELECT seq, actor, action FROM audit WHERE "at" >= TIMESTAMP '2024-01-02' AND "at" <= TIMESTAMP '2024-01-20' AND contains(lower(actor || ' ' || action || ' ' || subject || ' ' || detail), 'click')""")
def audit_filter(spark, sf_dir):
    return A.audit_filter(audit(spark, sf_dir), since=F.lit("2024-01-02").cast("timestamp"), until=F.lit("2024-01-20").cast("timestamp"), contains="CLICK").select("seq", "actor", "action")


@query(f"{_LOG} SELECT action, count(*) AS n FROM audit WHERE action = 'note' OR starts_with(action, 'note.') GROUP BY action")
def audit_action_family(spark, sf_dir):
    return A.audit_filter(audit(spark, sf_dir), action="note", family=True).groupBy("action").agg(F.count("*").alias("n"))


@query(f"{_LOG} SELECT seq, action, (SELECT count(*) FROM audit WHERE action = 'note.view' AND seq < 900) AS total, (SELECT count(*) FROM audit WHERE action = 'note.view' AND seq < 900) > 50 AS more FROM audit WHERE action = 'note.view' AND seq < 900 ORDER BY seq DESC LIMIT 50")
def audit_page(spark, sf_dir):
    return A.page(A.audit_filter(audit(spark, sf_dir), action="note.view"), 50, before=900).select("seq", "action", "total", "more")


@query(f"{_LOG} SELECT count(*) AS n, max(seq) AS last FROM audit WHERE seq > 500")
def audit_cursor(spark, sf_dir):
    return A.after_cursor(audit(spark, sf_dir), 500).agg(F.count("*").alias("n"), F.max("seq").alias("last"))


def _devices(spark, sf_dir):
    return audit(spark, sf_dir).withColumn("device", F.concat(F.lit("dev-"), F.col("seq") % 16))


@query("""SELECT 'dev-' || (event_id % 16) AS device, count(*) AS rows, min(CASE WHEN event_id % 16 < 8 AND event_id % 1000 IN (7, 336) AND event_id > 100 THEN event_id END) AS first_break FROM events GROUP BY 1""")
def chain_verify(spark, sf_dir):
    sealed = A.seal(_devices(spark, sf_dir))
    edited = (F.col("seq") % 16 < 8) & (F.col("seq") % 1000).isin(7, 336) & (F.col("seq") > 100)
    return A.verify_chain(sealed.withColumn("detail", F.when(edited, "{}x").otherwise(F.col("detail"))))


@query("SELECT count(*) AS broken FROM events WHERE event_id % 97 = 5")
def chain_verify_each(spark, sf_dir):
    sealed = A.seal(_devices(spark, sf_dir))
    return A.verify_each(sealed.withColumn("subject", F.when(F.col("seq") % 97 == 5, "other").otherwise(F.col("subject")))).agg(F.count("*").alias("broken"))


@query("SELECT 'dev-' || (event_id % 16) AS device, count(*) AS forked FROM (SELECT event_id FROM events WHERE event_id % 40 = 3 AND event_id >= 16) GROUP BY 1")
def chain_fork(spark, sf_dir):
    sealed = A.seal(_devices(spark, sf_dir))
    twice = sealed.unionByName(sealed.where("seq % 40 = 3").withColumn("subject", F.lit("fork")))
    return A.forks(twice).groupBy("device").agg(F.count("*").alias("forked"))


_CUT = "2024-01-10 00:00:00"


@query(f"""WITH l AS (SELECT 'dev-' || (event_id % 16) AS device, event_id AS seq, ts FROM events), b AS (SELECT device, coalesce(min(seq) FILTER (ts >= TIMESTAMP '{_CUT}'), max(seq) + 1) AS boundary FROM l GROUP BY device)
    SELECT device, boundary, count(*) FILTER (seq < boundary) AS rows FROM l JOIN b USING (device) GROUP BY device, boundary""")
def purge_plan(spark, sf_dir):
    return A.purge_plan(_devices(spark, sf_dir), F.lit(_CUT).cast("timestamp"))


@query(f"SELECT max(event_id) FILTER (ts < TIMESTAMP '{_CUT}') AS through FROM events")
def prune_boundary(spark, sf_dir):
    return A.prune_boundary(audit(spark, sf_dir), F.lit(_CUT).cast("timestamp"))


@query(f"{_LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY seq DESC) AS r FROM audit WHERE action IN ('note.view', 'note.purchase', 'note.click')) SELECT subject, seq, actor FROM l WHERE r = 1 AND action = 'note.click'")
def standing_signoff(spark, sf_dir):
    log = audit(spark, sf_dir)
    three = log.where(F.col("action").isin("note.view", "note.purchase", "note.click")).withColumn("action", F.when(F.col("action") == "note.click", "sign").otherwise("withdraw"))
    return A.standing_signoffs(three, "sign", "withdraw").select("subject", "seq", "actor")


@query(f"{_LOG}, l AS (SELECT *, row_number() OVER (PARTITION BY actor ORDER BY seq DESC) AS r FROM audit) SELECT actor, seq FROM l WHERE r = 1 AND action = 'note.view'")
def open_proposals(spark, sf_dir):
    return A.latest_per(audit(spark, sf_dir), "actor").where("action = 'note.view'").select("actor", "seq")


@query("""WITH s AS (SELECT o_custkey AS client, o_orderkey AS seq, ['p' || (o_orderkey % 3), 'q' || (o_orderkey % 5)] AS items FROM orders), l AS (SELECT *, coalesce(lag(items) OVER (PARTITION BY client ORDER BY seq), []) AS old FROM s),
    d AS (SELECT client, seq, list_sort(list_filter(items, lambda x: NOT list_contains(old, x))) AS added, list_sort(list_filter(old, lambda x: NOT list_contains(items, x))) AS removed FROM l)
    SELECT client, seq, array_to_string(added, ',') AS added, array_to_string(removed, ',') AS removed FROM d WHERE len(added) > 0 OR len(removed) > 0""")
def config_diff(spark, sf_dir):
    k = F.col("o_orderkey")
    s = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("client"), k.alias("seq"), F.array(F.concat(F.lit("p"), k % 3), F.concat(F.lit("q"), k % 5)).alias("items"))
    return A.config_changes(s, "client").select("client", "seq", F.array_join("added", ",").alias("added"), F.array_join("removed", ",").alias("removed"))


@query("""SELECT event_id AS seq, array_to_string(list_sort(list_distinct(list_concat(['a', CASE WHEN user_id % 2 = 0 THEN 'b' ELSE 'a1' END, 'x' || user_id % 4, 'y', 'z' || user_id % 7],
    CASE WHEN user_id % 3 = 0 THEN ['r' || event_id % 5] ELSE [] END))), ',') AS departments FROM events""")
def detail_departments(spark, sf_dir):
    user, own = F.col("user_id"), F.when(F.col("user_id") % 2 == 0, "b").otherwise("a1")
    named = lambda prefix, number: F.concat(F.lit(prefix), number)
    added = F.create_map(F.lit("c1"), F.array(named("x", user % 4)), F.lit("c2"), F.array().cast("array<string>"))
    after = F.struct(F.create_map(F.lit("c1"), F.array(F.lit("y"), named("x", user % 4))).alias("bereiche"))
    fields = [own.alias("bereich"), F.array(F.lit("a"), own).alias("bereiche"), F.when(user % 3 == 0, named("r", F.col("event_id") % 5)).alias("requested_bereich"), added.alias("added"), F.create_map(user.cast("string"), F.array(named("z", user % 7))).alias("removed"), after.alias("after")]
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.array_join(A.detail_departments(F.to_json(F.struct(*fields))), ",").alias("departments"))


def _usage(spark, sf_dir):
    k = F.get_json_object("props", "$.k").cast("bigint")
    return table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("at"), F.col("event_type").alias("op"), k.alias("returned"), (k * 3).alias("full"), (k % 9).alias("hits"), "value", "user_id")


@query("SELECT event_type AS op, count(*) AS ops, CAST(sum(k) AS BIGINT) AS returned, CAST(sum(3 * k) AS BIGINT) AS \"full\", CAST(sum(k % 9) AS BIGINT) AS hits, CAST(epoch(date_trunc('second', min(ts))) AS BIGINT) AS \"first\", 0 AS unreadable FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1")
def usage_summary(spark, sf_dir):
    return U.summary(_usage(spark, sf_dir)).withColumn("first", F.unix_timestamp("first"))


@query("""WITH axis AS (SELECT CAST(DATE '2024-01-31' - CAST(i AS INT) AS DATE) AS day FROM range(45) t(i))
    SELECT CAST(axis.day AS VARCHAR) AS day, count(event_id) AS ops, round(coalesce(sum(value), 0), 4) AS total FROM axis LEFT JOIN events ON CAST(ts AS DATE) = axis.day GROUP BY 1""")
def usage_by_day(spark, sf_dir):
    out = U.by_day(_usage(spark, sf_dir), 45, F.lit("2024-01-31 12:00:00").cast("timestamp"))
    return out.select(F.col("day").cast("string").alias("day"), "ops", F.round("total", 4).alias("total"))


@query("""SELECT event_type AS task, count(*) AS calls, count(*) FILTER (user_id % 7 = 0) AS failed, CAST(coalesce(sum(k) FILTER (k % 4 <> 0), 0) AS BIGINT) AS prompt, CAST(sum(k % 9) AS BIGINT) AS completion, CAST(coalesce(sum(k % 5) FILTER (k % 3 = 0), 0) AS BIGINT) AS cached, count(*) FILTER (k % 4 = 0) AS without_counts, count(*) FILTER (k % 4 <> 0 AND k % 3 <> 0) AS without_cache_report,
    min(event_id) AS first, max(event_id) AS last FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY 1""")
def inference_by_task(spark, sf_dir):
    u = _usage(spark, sf_dir)
    rows = u.select(F.col("op").alias("task"), F.when(F.col("user_id") % 7 == 0, "error").otherwise("ok").alias("outcome"), F.when(F.col("returned") % 4 != 0, F.col("returned")).alias("prompt"), F.col("hits").alias("completion"), F.when(F.col("returned") % 3 == 0, F.col("returned") % 5).alias("cached"), F.col("event_id").alias("at"))
    return U.inference_by_task(rows)


@query("SELECT event_type AS op, count(*) AS rows, round(avg(CASE WHEN event_id % 3 <> 0 THEN value END), 6) AS mean_load, count(*) FILTER (event_id % 3 = 0) AS missing_load FROM events GROUP BY 1")
def load_means(spark, sf_dir):
    rows = _usage(spark, sf_dir).withColumn("load", F.when(F.col("event_id") % 3 != 0, F.col("value")))
    return U.load_means(rows, "op", "load").withColumn("mean_load", F.round("mean_load", 6))


@query("SELECT source AS bereich, count(*) AS hits FROM documents WHERE contains(text, 'license') OR contains(text, 'License') GROUP BY 1")
def hits_per_bereich(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.where(F.contains("text", F.lit("license")) | F.contains("text", F.lit("License"))).groupBy(F.col("source").alias("bereich")).agg(F.count("*").alias("hits"))


@query(f"{with_sql('notes', 'blocks')}, c AS (SELECT citation, id FROM blocks WHERE contains(lower(text), 'apache')) SELECT CAST((SELECT sum(length(text)) FROM blocks WHERE citation IN (SELECT citation FROM c)) AS BIGINT) AS returned, CAST((SELECT sum(length(text)) FROM blocks WHERE id IN (SELECT id FROM c)) AS BIGINT) AS \"full\"")
def recall_accounting(spark, sf_dir):
    b = blocks(spark, sf_dir).withColumn("tokens", F.length("text"))
    return U.accounting(b, b.where(F.contains(F.lower("text"), F.lit("apache"))).select("citation"))


@query("SELECT event_type AS op, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95 FROM events GROUP BY 1")
def latency_percentiles(spark, sf_dir):
    return U.percentiles(_usage(spark, sf_dir), "value", 0.5, 0.95, by="op")


@query("SELECT op, value AS p95 FROM (SELECT event_type AS op, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events) WHERE i = CAST(round((n - 1) * 0.95) AS BIGINT)")
def latency_rounded_percentile(spark, sf_dir):
    return U.rounded_percentile(_usage(spark, sf_dir), "value", 0.95, "op")


@query("SELECT conv_id, turn, role FROM (SELECT *, sum(length(text) + 2) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS s FROM conversations) WHERE s <= 1200")
def transcript_tail(spark, sf_dir):
    return U.transcript_tail(table(spark, sf_dir, "conversations"), 1200).select("conv_id", "turn", "role")
