"""Reports on devices: order of a fleet, planted passages that turned up, copies of a log that are verified."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkgrove.operators.audit import verify_chain


def fleet_order(devices: DataFrame, name: str = "name") -> DataFrame:
    """devices (concerns) with those that have concerns first, then by name."""
    return devices.orderBy(F.when(F.size("concerns") > 0, 0).otherwise(1), name)


def canary_summary(hits: DataFrame) -> DataFrame:
    """(device, subject, canaries, hits, last_hit) of hits (device, subject, canary, at)."""
    return hits.groupBy("device", "subject").agg(F.count_distinct("canary").alias("canaries"), F.count("*").alias("hits"), F.max("at").alias("last_hit"))


def failures_by_device(log: DataFrame, devices: DataFrame, actions: list[str]) -> DataFrame:
    """(device, name, failures) of known devices (device, name), those without failures too."""
    n = log.where(F.col("action").isin(actions)).groupBy("device").agg(F.count("*").alias("failures"))
    return devices.select("device", "name").join(n, "device", "left").select("device", "name", F.coalesce("failures", F.lit(0)).alias("failures"))


def verify_copy(original: DataFrame, copy: DataFrame, partition: str = "device") -> DataFrame:
    """(partition, rows, copied, first_break, ok): a copy is good where it has all rows of a log and its chain is whole; logs the original does not have count too."""
    held = original.groupBy(partition).agg(F.count("*").alias("rows"))
    got = verify_chain(copy, partition).select(partition, F.col("rows").alias("copied"), "first_break")
    both = held.join(got, partition, "full").withColumns({"rows": F.coalesce("rows", F.lit(0)), "copied": F.coalesce("copied", F.lit(0))})
    return both.select(partition, "rows", "copied", "first_break", ((F.col("copied") >= F.col("rows")) & F.col("first_break").isNull()).alias("ok"))


def session_states(states: DataFrame, now, days: int = 30) -> DataFrame:
    """States (session, at) that are kept: the newest of a session, unless it is older than so many days."""
    newest = states.groupBy("session").agg(F.max(F.struct("at", *[c for c in states.columns if c not in ("session", "at")])).alias("_s"))
    return newest.select("session", "_s.*").where(F.col("at") > now - F.make_dt_interval(F.lit(days)))


#: Facts a model card must state; fixed values.
CARD_FIELDS = ("purpose", "provider", "data", "limits", "oversight", "contact")


def card_gaps(models: DataFrame) -> DataFrame:
    """(model, missing): for each model (model, card: map of text) the facts its card does not state, in order."""
    fields = F.array(*map(F.lit, CARD_FIELDS))
    missing = F.filter(fields, lambda f: F.coalesce(F.trim(F.try_element_at("card", f)), F.lit("")) == "")
    return models.select("model", F.when(F.col("card").isNull(), fields).otherwise(missing).alias("missing"))
