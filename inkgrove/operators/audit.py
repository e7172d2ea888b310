"""Audit log: filters, pages, hash chains, forks, purge boundaries, standing decisions, configuration changes."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkgrove.functions.scalars import chain_hash
from inkgrove.plans.shared import cut, join_sized


def audit_filter(log: DataFrame, since: Column | None = None, until: Column | None = None, actor: str | None = None, action: str | None = None, family: bool = False, subject: str | None = None, contains: str | None = None) -> DataFrame:
    """Rows of a period (both ends in), actor, action (or its family: the action and what begins with it and a dot) and
    subject; contains is looked for, any case, in actor, action, subject and detail."""
    if since is not None:
        log = log.where(F.col("at") >= since)
    if until is not None:
        log = log.where(F.col("at") <= until)
    if actor is not None:
        log = log.where(F.col("actor") == actor)
    if action is not None:
        log = log.where((F.col("action") == action) | F.col("action").startswith(action + ".") if family else F.col("action") == action)
    if subject is not None:
        log = log.where(F.col("subject") == subject)
    if contains is not None:
        log = log.where(F.contains(F.lower(F.concat_ws(" ", "actor", "action", "subject", "detail")), F.lower(F.lit(contains))))
    return log


def latest_page(log: DataFrame, limit: int, before: int | None = None) -> DataFrame:
    """The newest rows below a sequence number, newest first; 1 to 1000."""
    rows = log if before is None else log.where(F.col("seq") < before)
    return rows.orderBy(F.desc("seq")).limit(min(1000, max(1, limit)))


def page(log: DataFrame, limit: int, before: int | None = None) -> DataFrame:
    """latest_page() with total, the number of rows below before, and more, whether there are further ones."""
    rows = log if before is None else log.where(F.col("seq") < before)
    total = rows.agg(F.count("*").alias("total"))
    return latest_page(rows, limit).crossJoin(F.broadcast(total)).withColumn("more", F.col("total") > min(1000, max(1, limit)))  # total is one row


def latest_ascending(log: DataFrame, limit: int) -> DataFrame:
    return latest_page(log, limit).orderBy("seq")


def after_cursor(log: DataFrame, cursor: int) -> DataFrame:
    return log.where(F.col("seq") > cursor)


CHAINED = ("seq", "actor", "action", "subject", "detail")


def row_hash(prev: Column) -> Column:
    """A row's hash: its chained fields, length-prefixed, after the hash of the row before."""
    return chain_hash(prev, *[F.col(c) for c in CHAINED])


def seal(log: DataFrame, partition: str = "device", after: str | None = None) -> DataFrame:
    """log with prev and hash, each log chained in seq order, from the hash in the column after if given. Sealing is sequential by
    nature: rows stream through one task per log in sorted order, and only the last hash is held."""
    fields = [*log.schema.fields]
    shape = T.StructType([*fields, T.StructField("prev", T.StringType()), T.StructField("hash", T.StringType())])
    ordered = log.repartition(partition).sortWithinPartitions(partition, "seq")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, last = None, None
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in CHAINED]
            prevs, hashes = [], []
            starts = batch.column(after).to_pylist() if after else [None] * batch.num_rows
            for whose, start, *values in zip(batch.column(partition).to_pylist(), starts, *columns):
                if not hashes and now is None or whose != now:
                    now, last = whose, start
                text = "".join(f"{len(v.encode())}:{v}" for v in ("" if x is None else str(x) for x in values))
                prevs.append(last)
                last = hashlib.sha256(f"{last or ''}|{text}".encode()).hexdigest()
                hashes.append(last)
            names = [f.name for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], [*names, "prev", "hash"])

    return ordered.mapInArrow(run, shape)


def preceded(log: DataFrame, value: str, partition: str = "device") -> DataFrame:
    """log with _before, the value of the row before it in its log by seq (of equal seq by value), and _first, whether it is its log's first.

    Rows are dealt out by ranges of log and seq, so one log of all rows is spread over all tasks. Within a range a row finds its predecessor beside it; the first
    row of a range takes it from the last row of the range before, and only these last rows, one for each range, meet in one place."""
    kind = log.schema[value].dataType
    shape = T.StructType([*log.schema.fields, T.StructField("_log", T.StringType()), T.StructField("_before", kind), T.StructField("_first", T.BooleanType()), T.StructField("_edge", T.BooleanType()), T.StructField("_last", T.BooleanType()), T.StructField("_range", T.IntegerType())])
    named = log.withColumn("_log", F.coalesce(F.concat(F.lit("="), F.col(partition).cast("string")), F.lit("")))
    ranged = named.repartitionByRange("_log", "seq").sortWithinPartitions("_log", "seq", value)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        place, whose, what, held = TaskContext.get().partitionId(), None, None, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            if held is not None:
                yield _with_last(held, False)
            logs, values = batch.column("_log"), batch.column(value)
            before = pa.concat_arrays([pa.array([what], values.type), values.slice(0, n - 1)])
            same = pc.fill_null(pc.equal(logs, pa.concat_arrays([pa.array([whose], logs.type), logs.slice(0, n - 1)])), False)
            shown = pc.if_else(same, pa.array(range(n), pa.int32()), pa.scalar(None, pa.int32()))
            edge = pa.array([held is None, *[False] * (n - 1)])
            columns = [*batch.columns, before.take(shown), pc.invert(same), edge, pa.array([place] * n, pa.int32())]
            held, whose, what = pa.RecordBatch.from_arrays(columns, [*batch.schema.names, "_before", "_first", "_edge", "_range"]), logs[-1].as_py(), values[-1].as_py()
        if held is not None:
            yield _with_last(held, True)

    def _with_last(batch: pa.RecordBatch, last: bool) -> pa.RecordBatch:
        flags = pa.array([*[False] * (batch.num_rows - 1), last])
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], flags, batch.columns[-1]], [*batch.schema.names[:-1], "_last", "_range"])

    rows = cut(ranged.mapInArrow(run, shape), "ranges")
    ends = rows.where("_last").select("_range", F.col("_log").alias("_end_log"), F.col(value).alias("_end"))
    order = Window.orderBy("_range")  # one row for each range
    ends = ends.select("_range", *[F.lag(c).over(order).alias(c) for c in ("_end_log", "_end")]).withColumn("_edge", F.lit(True))
    joined = rows.join(F.broadcast(ends), ["_range", "_edge"], "left")
    goes_on = F.col("_edge") & F.col("_log").eqNullSafe(F.col("_end_log"))
    found = joined.withColumn("_before", F.when(goes_on, F.col("_end")).otherwise(F.col("_before"))).withColumn("_first", F.col("_first") & ~goes_on)
    return found.select(*log.columns, "_before", "_first")


def verify_each(log: DataFrame) -> DataFrame:
    """Rows whose hash does not match their fields; rows stand for themselves, so any selection can be checked."""
    return log.where(row_hash(F.col("prev")) != F.col("hash"))


def verify_chain(log: DataFrame, partition: str = "device", anchors: DataFrame | None = None) -> DataFrame:
    """(partition, rows, first_break): the least seq whose hash or predecessor is wrong, null for a whole chain.

    anchors (partition, floor_hash) is what the first row must continue after a purge. Checking is parallel, also within a log: every row
    is recomputed on its own, its predecessor comes by preceded()."""
    rows = preceded(log, "hash", partition)
    if anchors is not None:
        firsts = rows.where("_first").join(anchors, partition, "left").withColumn("_before", F.col("floor_hash")).drop("floor_hash")
        rows = rows.where("not _first").unionByName(firsts)
    right = row_hash(F.col("prev")) == F.col("hash")
    broken = ~right | ~F.col("prev").eqNullSafe(F.col("_before"))
    return rows.groupBy(partition).agg(F.count("*").alias("rows"), F.min(F.when(broken, F.col("seq"))).alias("first_break"))


def forks(log: DataFrame, partition: str = "device") -> DataFrame:
    """(partition, prev, rows): hashes that more than one row continues."""
    return log.where("prev is not null").groupBy(partition, "prev").agg(F.count("*").alias("rows")).where("rows > 1")


def unsigned_after_signed(log: DataFrame, partition: str = "device") -> DataFrame:
    """Rows without a signature after one with."""
    since = cut(log.where("signed").groupBy(partition).agg(F.min("seq").alias("_since")), "signed")
    return join_sized(log.where("not signed"), since, [partition], "inner").where(F.col("seq") > F.col("_since")).select(*log.columns)


def purge_plan(log: DataFrame, cutoff: Column, partition: str = "device") -> DataFrame:
    """(partition, boundary, rows): a purge takes the prefix before the first row at or after cutoff."""
    bounds = log.groupBy(partition).agg(F.coalesce(F.min(F.when(F.col("at") >= cutoff, F.col("seq"))), F.max("seq") + 1).alias("boundary"))
    return log.join(bounds, partition).groupBy(partition, "boundary").agg(F.count_if(F.col("seq") < F.col("boundary")).alias("rows"))


def prune_boundary(log: DataFrame, cutoff: Column) -> DataFrame:
    return log.agg(F.max(F.when(F.col("at") < cutoff, F.col("seq"))).alias("through"))


def latest_per(log: DataFrame, key: str, order: str = "seq") -> DataFrame:
    """The last row of each key, by order; aggregation, so hot keys combine map-side."""
    whole = F.struct(order, *[c for c in log.columns if c != order])
    return log.groupBy(F.col(key).alias("_k")).agg(F.max_by(whole, F.col(order)).alias("_row")).select("_row.*")


def standing_signoffs(log: DataFrame, signed: str, withdrawn: str) -> DataFrame:
    """Subjects whose last sign-off row signs."""
    return latest_per(log.where(F.col("action").isin(signed, withdrawn)), "subject").where(F.col("action") == signed)


def signed(notes: DataFrame, signoffs: DataFrame) -> DataFrame:
    """notes (name, body_hash) whose standing sign-off (subject, actor, body_hash) is of the text as it is now, with signed_by."""
    of = signoffs.select(F.col("subject").alias("name"), F.col("actor").alias("signed_by"), F.col("body_hash").alias("_signed"))
    return notes.join(of, "name").where(F.col("_signed") == F.col("body_hash")).drop("_signed")


def config_changes(states: DataFrame, partition: str, items: str = "items") -> DataFrame:
    """(partition, seq, added, removed) against the state before, where anything changed."""
    old = F.coalesce("_before", F.array().cast("array<string>"))
    rows = preceded(states, items, partition).withColumn("_old", old).select(partition, "seq", F.array_sort(F.array_except(items, "_old")).alias("added"), F.array_sort(F.array_except("_old", items)).alias("removed"))
    return rows.where((F.size("added") > 0) | (F.size("removed") > 0))


def _texts(values: Column) -> Column:
    """The texts among the values of a JSON array, given as array<variant>."""
    return F.transform(F.filter(values, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.variant_get(v, "$", "string"))


def detail_departments(detail: Column) -> Column:
    """Different department labels that a row's detail names, sorted: what a search returned (bereiche) and asked for (requested_bereich), a single bereich, and
    the lists of each client that a change of configuration added, removed or left in force (added, removed, after.bereiche). Other types of values name none; text that is no JSON object neither."""
    held = F.try_parse_json(detail)
    at = lambda path, kind: F.try_variant_get(held, path, kind)
    singles = [F.when(F.schema_of_variant(at(p, "variant")) == "STRING", at(p, "string")) for p in ("$.requested_bereich", "$.bereich")]
    many = [_texts(at("$.bereiche", "array<variant>"))]
    for path in ("$.added", "$.removed", "$.after.bereiche"):
        lists = F.transform(F.map_values(at(path, "map<string,variant>")), lambda v: _texts(F.try_variant_get(v, "$", "array<variant>")))
        many.append(F.flatten(F.filter(lists, lambda x: x.isNotNull())))
    none = F.array().cast("array<string>")
    return F.array_sort(F.array_distinct(F.concat(F.array_compact(F.array(*singles)), *[F.coalesce(m, none) for m in many])))


#: Digests hashed together at each level of a bundle's digest.
DIGEST_RANGE = 10_000
BUNDLE_FORMAT, BUNDLE_ROW = 1, "seq bigint, device string, actor string, action string, subject string, detail string, prev string, hash string"


def bundle_digest(log: DataFrame) -> DataFrame:
    """(digest): one digest for each range of DIGEST_RANGE sequence numbers, one for each such range of digests, and so on up to one."""
    top = log.agg(F.max("seq")).first()[0]
    level = log.select(F.col("seq").alias("k"), F.col("hash").alias("d"))
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), "")
        level = level.groupBy(F.floor(F.col("k") / DIGEST_RANGE).alias("k")).agg(F.sha2(joined, 256).alias("d"))
        top = (top or 0) // DIGEST_RANGE
        if not top:
            return level.agg(F.max("d").alias("digest"))


def export_lines(log: DataFrame) -> DataFrame:
    """(value): a header, one JSON line for each row in order, and a footer with count and digest of the hashes."""
    body = log.select(F.lit(1).alias("o"), F.col("seq").alias("k"), F.to_json(F.struct(*log.columns)).alias("value"))
    footer = bundle_digest(log).crossJoin(log.agg(F.count("*").alias("rows")))  # one row each
    head = log.sparkSession.createDataFrame([(0, 0, json.dumps({"format": BUNDLE_FORMAT}, separators=(",", ":")))], "o int, k bigint, value string")
    return head.unionByName(body).unionByName(footer.select(F.lit(2).alias("o"), F.lit(0).cast("bigint").alias("k"), F.to_json(F.struct("rows", "digest")).alias("value"))).orderBy("o", "k").select("value")


def verify_bundle(lines: DataFrame, row: str = BUNDLE_ROW) -> DataFrame:
    """One row of what the (value) lines of a bundle show: format, rows, broken_rows (unreadable or not matching their hash), counted, digest_ok, and whole, if all is right."""
    value = F.col("value")
    parsed = lines.select(value, F.from_json(value, row).alias("r"), F.get_json_object(value, "$.format").try_cast("int").alias("format"), F.get_json_object(value, "$.digest").alias("digest"), F.get_json_object(value, "$.rows").try_cast("bigint").alias("n"))
    is_row = F.col("r.seq").isNotNull()
    known = is_row | F.col("format").isNotNull() | F.col("digest").isNotNull()
    rows = parsed.where(is_row).select("r.*")
    facts = parsed.agg(
        F.max("format").alias("format"), F.count_if(is_row).alias("rows"), F.max("n").alias("counted"), F.max(F.when(~is_row, F.col("digest"))).alias("_told"), F.count_if(~known).alias("_unread"),
        F.count_if(F.col("value").isNull()).alias("_null"),
    )
    broken = verify_each(rows).agg(F.count("*").alias("_broken"))
    out = facts.crossJoin(broken).crossJoin(bundle_digest(rows))  # one row each
    out = out.select("format", "rows", (F.col("_broken") + F.col("_unread")).alias("broken_rows"), "counted", F.col("_told").eqNullSafe(F.col("digest")).alias("digest_ok"))
    right = F.col("format").eqNullSafe(BUNDLE_FORMAT) & (F.col("broken_rows") == 0) & F.col("counted").eqNullSafe(F.col("rows")) & F.col("digest_ok")
    return out.withColumn("whole", right)


def unsealed_heads(log: DataFrame, partition: str = "device") -> DataFrame:
    """(partition, seq, hash) of each log's last row: what an append must continue."""
    return log.groupBy(partition).agg(F.max(F.struct("seq", "hash")).alias("_h")).select(partition, "_h.seq", "_h.hash")


def _sealed_after(rows: DataFrame, partition: str) -> DataFrame:
    """rows numbered and chained in seq order after the head (_seq, _head) of their log, null where there is none."""
    first = Window.partitionBy(partition).orderBy("seq")
    numbered = rows.withColumn("seq", F.coalesce("_seq", F.lit(0)) + F.row_number().over(first)).drop("_seq")
    return seal(numbered, partition, "_head").drop("_head")


def seal_after(rows: DataFrame, heads: DataFrame | None, partition: str = "device") -> DataFrame:
    """rows with prev and hash, continuing heads (partition, seq, hash)."""
    if heads is None:
        return _sealed_after(rows.withColumns({"_seq": F.lit(None).cast("bigint"), "_head": F.lit(None).cast("string")}), partition)
    return _sealed_after(rows.join(heads.select(partition, F.col("seq").alias("_seq"), F.col("hash").alias("_head")), partition, "left"), partition)


def append(log: DataFrame, rows: DataFrame, expected: DataFrame | None = None, partition: str = "device") -> tuple[DataFrame, DataFrame]:
    """(log with rows sealed after each log's head, rows refused).

    expected (partition, hash) is the head a writer saw: where it has moved since, its rows are refused, to be offered again against the new
    head. Sequence numbers continue the head's. Refusing is all or nothing for a log, so nothing is half written."""
    heads = unsealed_heads(log, partition).select(partition, F.col("seq").alias("_seq"), F.col("hash").alias("_head"))
    asked = rows.join(heads, partition, "left")
    if expected is not None:
        seen = expected.select(partition, F.col("hash").alias("_seen"))
        asked = asked.join(seen, partition, "left").withColumn("_moved", ~F.col("_head").eqNullSafe(F.col("_seen")))
    else:
        asked = asked.withColumn("_seen", F.lit(None).cast("string")).withColumn("_moved", F.lit(False))
    refused = asked.where("_moved").select(*rows.columns)
    sealed = _sealed_after(asked.where("not _moved").drop("_seen", "_moved"), partition)
    return log.unionByName(sealed.select(*log.columns)), refused


def continues(log: DataFrame, partition: str = "device") -> DataFrame:
    """(partition, seq, state) of rows that do not continue the row before: fork where an earlier row is already continued by another, else gap."""
    rows = preceded(log, "hash", partition)
    loose = rows.where(~F.col("prev").eqNullSafe(F.col("_before")) & ~(F.col("_first") & F.col("prev").isNull())).select(partition, "seq", "prev")
    known = log.select(partition, F.col("hash").alias("prev")).distinct().withColumn("_known", F.lit(True))
    return loose.join(known, [partition, "prev"], "left").select(partition, "seq", F.when(F.col("_known"), "fork").otherwise("gap").alias("state"))


def pruned_digest(log: DataFrame, boundary: Column, partition: str = "device") -> DataFrame:
    """(partition, rows, digest) over the rows before boundary that a purge takes: what the purge row keeps of them. Digests of ranges of rows
    combine level by level as in a bundle, within each log."""
    gone = log.where(F.col("seq") < boundary)
    top = gone.agg(F.max("seq")).first()[0]
    level = gone.select(partition, F.col("seq").alias("k"), F.col("hash").alias("d"), F.lit(1).cast("bigint").alias("n"))
    while True:
        joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "d"))), lambda x: x["d"]), "")
        level = level.groupBy(partition, F.floor(F.col("k") / DIGEST_RANGE).alias("k")).agg(F.sha2(joined, 256).alias("d"), F.sum("n").alias("n"))
        top = (top or 0) // DIGEST_RANGE
        if not top:
            return level.select(partition, F.col("n").alias("rows"), F.col("d").alias("digest"))
