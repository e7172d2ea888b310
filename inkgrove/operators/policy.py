"""Retention, subject access, erasure, access windows, note movement and synchronisation, fleet concerns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.functions.scalars import duration_ok, duration_parts, excerpt, older_version, query_hash, token_state, whole_word
from inkgrove.plans.shared import cut, join_sized

QUIET_HOURS = 48


def retention(notes: DataFrame, now: Column) -> DataFrame:
    """notes with status (due, pending, invalid, indefinite) and expires; the clock starts at created.

    Each different duration is parsed once."""
    kinds = cut(notes.select("retention").where("retention is not null").distinct().select("retention", duration_ok(F.col("retention")).alias("_ok"), *[p.alias(f"_{k}") for k, p in enumerate(duration_parts(F.col("retention")))]), "durations")
    rows = join_sized(notes, kinds, ["retention"])
    span = F.make_interval(*[F.col(f"_{k}") for k in range(7)])
    expires = F.when(F.col("_ok"), F.col("created") + span)
    status = F.when(F.col("retention").isNull(), "indefinite").when(~F.col("_ok"), "invalid").when(expires <= now, "due").otherwise("pending")
    return rows.withColumns({"status": status, "expires": expires}).select(*notes.columns, "status", "expires")


def retention_apply(queue: DataFrame, actor: str, dry_run: bool = True) -> tuple[DataFrame, DataFrame]:
    """(audit rows, ids to erase) for the due notes of a queue made by retention().

    Each due note has a row (actor, action, subject, detail) that stands whether or not it is erased; with dry_run nothing is to be erased."""
    due = queue.where("status = 'due'")
    detail = F.to_json(F.struct("name", "ring", "retention", "created", F.col("expires").alias("expired_at"), F.lit(dry_run).alias("dry_run")))
    rows = due.select(F.lit(actor).alias("actor"), F.lit("retention.expired").alias("action"), F.concat(F.lit("note:"), "id").alias("subject"), detail.alias("detail"))
    return rows, due.select("id").limit(0) if dry_run else due.select("id")


def erasure_rows(targets: DataFrame, found: DataFrame, removed: DataFrame, actor: str, note: str | None = None) -> DataFrame:
    """(id, step, actor, action, subject, detail): for each target (id) what an erasure writes: a request first, then completed with the counts of
    removed (id, kind, n), or failed where no note is found (id). note says what may be left elsewhere."""
    counts = removed.groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("kind", "n"))).alias("removed"))  # a few kinds a note
    known = found.select("id").distinct().withColumn("_known", F.lit(True))
    rows = targets.select("id").distinct().join(known, "id", "left").join(counts, "id", "left")
    asked = rows.select("id", F.lit(0).alias("step"), F.lit("erasure.requested").alias("action"), F.lit("{}").alias("detail"))
    done = rows.select("id", F.lit(1).alias("step"), F.when(F.col("_known"), "erasure.completed").otherwise("erasure.failed").alias("action"), F.to_json(F.struct("removed", F.when(F.col("_known"), F.lit(note)).alias("residue"))).alias("detail"))
    return asked.unionByName(done).select("id", "step", F.lit(actor).alias("actor"), "action", F.concat(F.lit("note:"), "id").alias("subject"), "detail")


def retention_order(queue: DataFrame) -> list[Column]:
    """Due first, then pending, each by expiry, then invalid."""
    return [F.when(F.col("status") == "due", 0).when(F.col("status") == "pending", 1).otherwise(2), F.col("expires").asc_nulls_last(), F.col("name")]


def subject_access(blocks: DataFrame, log: DataFrame, subject: str) -> DataFrame:
    """(kind, ref, ring, whole_word, excerpt): blocks that name the subject and audit rows that hold it, by ring and reference."""
    needle = F.lit(subject)
    hit = lambda c: F.contains(F.lower(c), F.lower(needle))
    b = blocks.where(hit(F.col("text"))).select(F.lit("block").alias("kind"), F.col("citation").alias("ref"), "ring", whole_word(F.col("text"), subject).alias("whole_word"), excerpt(F.col("text"), needle).alias("excerpt"))
    held = F.concat_ws(" ", "actor", "action", "subject", "detail")
    a = log.where(hit(held)).select(F.lit("audit").alias("kind"), F.col("seq").cast("string").alias("ref"), F.lit(None).cast("int").alias("ring"), whole_word(held, subject).alias("whole_word"), excerpt(held, needle).alias("excerpt"))
    return b.unionByName(a)


def subject_access_by_hash(log: DataFrame, forms: DataFrame, key: str) -> DataFrame:
    """(subject, kind, ref, form): log rows (seq, detail) that hold only a keyed hash of a form by which a subject was searched for.

    forms (subject, form) are the names, addresses and the like of each subject; case and runs of blanks make no difference, and forms alike
    count once, the least of them. Empty or null forms, and rows without a hash, match nothing. A row may answer several subjects. Few forms are broadcast,
    so a form that most rows hold is no hot key; many are joined by a shuffle that splits skewed partitions."""
    hashed = forms.where(F.trim("form") != "").groupBy("subject", query_hash(F.col("form"), key).alias("_hash")).agg(F.min("form").alias("form"))
    rows = log.select(F.col("seq").cast("string").alias("ref"), F.get_json_object("detail", "$.query").alias("_hash")).where("_hash is not null")
    return join_sized(rows, cut(hashed, "forms"), ["_hash"], "inner").select("subject", F.lit("audit-hash").alias("kind"), "ref", "form")


def erasure_receipt(notes: DataFrame, targets: DataFrame, left: DataFrame) -> DataFrame:
    """(id, found, residue): which targets there were, and rows of them still left after erasure."""
    found = notes.select("id", F.lit(True).alias("f"))
    residue = left.groupBy("id").agg(F.count("*").alias("residue"))
    return targets.join(found, "id", "left").join(residue, "id", "left").select("id", F.coalesce("f", F.lit(False)).alias("found"), F.coalesce("residue", F.lit(0)).alias("residue"))


def may_move(offers: DataFrame, grants: DataFrame) -> DataFrame:
    """offers (device, name, ring, bereich, direction) with decision: allowed, or the first reason against.

    grants (device, bereich, direction in, out or both, effective, pending). Rings 0 and 1 never move; a note without a department
    moves nowhere; then a grant must cover the direction; else wrong direction, awaiting or revoked, in this order."""
    covers = (F.col("g_direction") == "both") | (F.col("g_direction") == F.col("direction"))
    g = grants.select("device", "bereich", F.col("direction").alias("g_direction"), "effective", "pending")
    keys = [c for c in offers.columns]
    facts = offers.join(g, ["device", "bereich"], "left").groupBy(*keys).agg(
        F.count("g_direction").alias("n"), F.coalesce(F.bool_or(F.col("effective") & covers), F.lit(False)).alias("ok"), F.coalesce(F.bool_or("effective"), F.lit(False)).alias("any"), F.coalesce(F.bool_or("pending"), F.lit(False)).alias("wait")
    )
    reason = F.when(F.col("ring") <= 1, "ring-never-leaves").when(F.col("bereich").isNull(), "no-department").when(F.col("n") == 0, "no-grant").when(F.col("ok"), "allowed").when(F.col("any"), "wrong-direction").when(F.col("wait"), "awaiting").otherwise("revoked")
    return facts.select(*keys, reason.alias("decision"))


def sync_merge(held: DataFrame, offers: DataFrame, tombstones: DataFrame) -> DataFrame:
    """(name, outcome) of offers (name, updated, body, based_on) against held (name, updated, body): erased, stored, unchanged or conflict."""
    h = held.select("name", F.col("updated").alias("h_updated"), F.col("body").alias("h_body"))
    t = tombstones.select("name", F.lit(True).alias("dead"))
    same = (F.col("updated") == F.col("h_updated")) & (F.col("body") == F.col("h_body"))
    outcome = F.when(F.col("dead"), "erased").when(F.col("h_updated").isNull(), "stored").when(same, "unchanged").when(F.col("based_on").eqNullSafe(F.col("h_updated")), "stored").otherwise("conflict")
    return offers.join(h, "name", "left").join(t, "name", "left").select("name", outcome.alias("outcome"))


def resolve_conflicts(held: DataFrame, conflicts: DataFrame, decisions: DataFrame) -> DataFrame:
    """held after decisions (conflict_id, keep: held or offered) on conflicts (conflict_id, name, updated, body)."""
    taken = conflicts.join(decisions.where("keep = 'offered'"), "conflict_id", "left_semi").select("name", "updated", "body")
    return held.join(taken.select("name"), "name", "left_anti").unionByName(taken)


def concerns(devices: DataFrame, now: Column, hub_version: str) -> DataFrame:
    """devices with concerns: never-reported, quiet, refused, token-expiring, token-expired, behind; revoked devices have none."""
    hours = F.floor((F.unix_timestamp(now) - F.unix_timestamp("last_seen")) / 3600)
    token = token_state(F.col("expires_at"), now)
    found = [
        F.when(F.col("last_seen").isNull(), "never-reported").when(hours >= QUIET_HOURS, "quiet"),
        F.when(F.col("last_refusal").isNotNull(), "refused"),
        F.when(token == "soon", "token-expiring").when(token == "expired", "token-expired"),
        F.when(older_version(F.col("version"), F.lit(hub_version)), "behind"),
    ]
    none = F.array().cast("array<string>")
    return devices.withColumn("concerns", F.when(F.col("active"), F.array_compact(F.array(*found))).otherwise(none))


def alerts_due(alerts: DataFrame, sent: DataFrame, now: Column, every_hours: int) -> DataFrame:
    """Alerts (key, text) not sent within the interval; sent (key, at) is what went out before."""
    last = sent.groupBy("key").agg(F.max("at").alias("last"))
    due = F.col("last").isNull() | (F.unix_timestamp(now) - F.unix_timestamp("last") >= every_hours * 3600)
    return alerts.join(last, "key", "left").where(due).drop("last")


def disclose(log: DataFrame, requests: DataFrame, now: Column) -> DataFrame:
    """Log rows inside the period of an open, approved request (request_id, device, from, to, approved, until)."""
    open_ = requests.where(F.col("approved") & (F.col("until") >= now)).select("request_id", "device", F.col("from").alias("_a"), F.col("to").alias("_b"))
    return log.join(open_, "device").where((F.col("at") >= F.col("_a")) & (F.col("at") <= F.col("_b"))).drop("_a", "_b")
