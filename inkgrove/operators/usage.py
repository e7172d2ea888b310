"""Usage and load time series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(rows: DataFrame) -> DataFrame:
    """(op, ops, returned, full, hits, first, unreadable) per operation of rows (op, at, returned, full, hits); lines that could not be read (_corrupt, if there is
    such a column) are counted apart, under an op of null."""
    corrupt = F.col("_corrupt").isNotNull() if "_corrupt" in rows.columns else F.lit(False)
    return rows.groupBy(F.when(~corrupt, F.col("op")).alias("op")).agg(
        F.count_if(~corrupt).alias("ops"), F.sum("returned").alias("returned"), F.sum("full").alias("full"), F.sum("hits").alias("hits"), F.min("at").alias("first"), F.count_if(corrupt).alias("unreadable")
    )


def by_day(rows: DataFrame, days: int, until: Column, at: str = "at") -> DataFrame:
    """(day, ops, total) of the last so many UTC days up to until, days without rows as zero."""
    last = F.to_date(until)
    axis = rows.sparkSession.range(days).select(F.date_sub(last, F.col("id").cast("int")).alias("day"))
    counted = rows.where((F.to_date(at) > F.date_sub(last, days)) & (F.to_date(at) <= last)).groupBy(F.to_date(at).alias("day")).agg(F.count("*").alias("ops"), F.sum("value").alias("total"))
    return axis.join(counted, "day", "left").select("day", F.coalesce("ops", F.lit(0)).alias("ops"), F.coalesce("total", F.lit(0.0)).alias("total"))


def day_of(text: Column) -> Column:
    """The day of an RFC 3339 text by its first ten characters; null for a damaged one."""
    return F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd")


def inference_by_task(rows: DataFrame) -> DataFrame:
    """Per task: calls, failed, prompt, completion and cached tokens, calls without counts, calls that report no cache, first and last. Unknown counts add nothing."""
    cached = F.col("cached") if "cached" in rows.columns else F.lit(None).cast("bigint")
    return rows.groupBy("task").agg(
        F.count("*").alias("calls"), F.count_if(F.col("outcome") != "ok").alias("failed"), F.coalesce(F.sum("prompt"), F.lit(0)).alias("prompt"), F.coalesce(F.sum("completion"), F.lit(0)).alias("completion"),
        F.coalesce(F.sum(cached), F.lit(0)).alias("cached"), F.count_if(F.col("prompt").isNull()).alias("without_counts"), F.count_if(F.col("prompt").isNotNull() & cached.isNull()).alias("without_cache_report"),
        F.min("at").alias("first"), F.max("at").alias("last"),
    )


def load_means(rows: DataFrame, by: str, *columns: str) -> DataFrame:
    """Means over the rows that have a sample, and how many have none: a missing sample is never a zero."""
    return rows.groupBy(by).agg(F.count("*").alias("rows"), *[F.avg(c).alias(f"mean_{c}") for c in columns], *[F.count_if(F.col(c).isNull()).alias(f"missing_{c}") for c in columns])


def accounting(blocks: DataFrame, cited: DataFrame) -> DataFrame:
    """(returned, full): tokens of the cited blocks, and of the whole notes they are from."""
    returned = blocks.join(cited, "citation", "left_semi")
    full = blocks.join(returned.select("id").distinct(), "id", "left_semi")
    return returned.agg(F.sum("tokens").alias("returned")).crossJoin(full.agg(F.sum("tokens").alias("full")))


def percentiles(rows: DataFrame, value: str, *points: float, by: str | None = None) -> DataFrame:
    """Exact nearest-rank percentiles: the value at place ceil(p * n)."""
    cols = [F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY {value})").alias(f"p{round(p * 100)}") for p in points]
    return rows.groupBy(by).agg(*cols) if by else rows.agg(*cols)


def rounded_percentile(rows: DataFrame, value: str, p: float, by: str) -> DataFrame:
    """The other rule: the value at index round((n - 1) * p), per group. Values are counted first, map-side, so a group's different values must fit a sort, not its rows."""
    counted = rows.where(F.col(value).isNotNull()).groupBy(by, value).agg(F.count("*").alias("_c"))
    upto = Window.partitionBy(by).orderBy(value)
    placed = counted.withColumn("_end", F.sum("_c").over(upto.rowsBetween(Window.unboundedPreceding, 0))).withColumn("_n", F.sum("_c").over(Window.partitionBy(by)))
    index = F.round((F.col("_n") - 1) * p).cast("bigint")
    return placed.where((index < F.col("_end")) & (index >= F.col("_end") - F.col("_c"))).select(by, F.col(value).alias(f"p{round(p * 100)}"))


def last_sample(rows: DataFrame, by: str, at: str = "at") -> DataFrame:
    """The newest row of each group, by at; an aggregation."""
    whole = F.struct(at, *[c for c in rows.columns if c != at])
    return rows.groupBy(F.col(by).alias("_k")).agg(F.max(whole).alias("_row")).select("_row.*")


def transcript_tail(turns: DataFrame, budget: int) -> DataFrame:
    """The newest turns of each conversation whose lengths, with two characters between, stay within the budget."""
    newest = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    return turns.withColumn("_sum", F.sum(F.length("text") + 2).over(newest)).where(F.col("_sum") <= budget).drop("_sum")


#: How long a measured check speaks for the next one.
CHECK_FRESH_SECONDS = 86_400


def check_plans(calls: DataFrame, checks: DataFrame) -> DataFrame:
    """calls with plan and last_ms: whether the check beside a search is worth starting within budget_ms, by how the endpoint's last one before it ended.

    calls (endpoint, at, seq, budget_ms), checks (endpoint, at, seq, took_ms, completed); earlier is earlier by (at, seq). A budget of 0 means "run-unbounded". Else a
    last check that was cut off means "skip-abandoned", one that took longer than the budget "skip-slow", and no check, or none of the last CHECK_FRESH_SECONDS,
    "run". An as-of lookup: as only a day's checks count, it needs a day's rows of an endpoint at a time, and the last check of the day before."""
    day = F.floor(F.unix_timestamp("at") / CHECK_FRESH_SECONDS)
    ended = F.struct("at", "took_ms", "completed")
    measured = checks.select("endpoint", "at", "seq", ended.alias("_check"), day.alias("_day"))
    asked = calls.withColumn("_day", day)
    both = asked.withColumn("_check", F.lit(None).cast(measured.schema["_check"].dataType)).unionByName(measured, allowMissingColumns=True)
    earlier = Window.partitionBy("endpoint", "_day").orderBy("at", "seq").rowsBetween(Window.unboundedPreceding, -1)
    within = both.withColumn("_is_call", F.col("_check").isNull()).withColumn("_last", F.last("_check", ignorenulls=True).over(earlier)).where("_is_call")
    before = measured.groupBy("endpoint", (F.col("_day") + 1).alias("_day")).agg(F.max_by("_check", F.struct("at", "seq")).alias("_before"))
    found = within.join(before, ["endpoint", "_day"], "left").withColumn("_last", F.coalesce("_last", "_before"))
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    fresh = micros("at") - micros("_last.at") <= CHECK_FRESH_SECONDS * 1_000_000
    last = F.when(fresh, F.col("_last"))
    plan = F.when(F.col("budget_ms") == 0, "run-unbounded").when(~last["completed"], "skip-abandoned").when(last["took_ms"] > F.col("budget_ms"), "skip-slow").otherwise("run")
    return found.withColumns({"plan": plan, "last_ms": last["took_ms"]}).select(*calls.columns, "plan", "last_ms")
