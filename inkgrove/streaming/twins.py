"""Streaming counterparts: dropping repeats, daily usage, and deliveries that must continue a device's chain."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Repeats of one payload within so long are one event.
REPEAT_SECONDS = 2


def drop_repeats(events: DataFrame, at: str = "at", keys: tuple[str, ...] = ("actor", "action", "detail"), seconds: int = REPEAT_SECONDS) -> DataFrame:
    """(keys, at) of events but those within so many seconds of the last one kept with the same keys.

    A key's state is one timestamp, and goes once the watermark has passed its window."""
    shape = ", ".join(f"`{c}` {events.schema[c].dataType.simpleString()}" for c in keys) + f", `{at}` timestamp"

    def keep(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last, out = (state.get[0] if state.exists else None), []
        for t in sorted(pd.concat(list(frames))[at]):
            ms = int(t.timestamp() * 1000)
            if last is None or ms - last > seconds * 1000:
                out.append((*key, t))
                last = ms
        state.update((last,))
        state.setTimeoutTimestamp(max(last, state.getCurrentWatermarkMs()) + seconds * 1000 + 1)
        yield pd.DataFrame(out, columns=[*keys, at])

    return events.select(*keys, at).withWatermark(at, f"{seconds} seconds").groupBy(*keys).applyInPandasWithState(keep, shape, "last bigint", "append", GroupStateTimeout.EventTimeTimeout)


def daily_usage(events: DataFrame, at: str = "at", late: str = "1 day") -> DataFrame:
    """(day, op, ops, total) per UTC day, final once the watermark has passed the day."""
    windowed = events.withWatermark(at, late).groupBy(F.window(at, "1 day"), "op")
    return windowed.agg(F.count("*").alias("ops"), F.sum("value").alias("total")).select(F.to_date("window.start").alias("day"), "op", "ops", "total")


def session_counts(events: DataFrame, at: str = "at", gap: str = "30 minutes", late: str = "1 hour") -> DataFrame:
    """(actor, start, end, events) of sessions that a gap ends."""
    return events.withWatermark(at, late).groupBy("actor", F.session_window(at, gap)).agg(F.count("*").alias("events")).select("actor", F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def _continue(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Rows that continue the anchor are accepted in seq order; the anchor moves with them; others are refused with a reason."""
    rows = pd.concat(list(frames)).sort_values("seq")
    anchor = state.get[0] if state.exists else None
    out = []
    for r in rows.itertuples():
        prev = None if pd.isna(r.prev) else r.prev
        good = prev == anchor
        out.append((key[0], r.seq, good, None if good else ("no anchor" if anchor is None else "does not continue the anchor")))
        if good:
            anchor = r.hash
    if anchor is not None:
        state.update((anchor,))
    yield pd.DataFrame(out, columns=["device", "seq", "accepted", "reason"])


def accept_deliveries(rows: DataFrame) -> DataFrame:
    """(device, seq, accepted, reason) of delivered rows (device, seq, prev, hash): a forked or out-of-order delivery is refused.

    The state of a device is one hash."""
    return rows.select("device", "seq", "prev", "hash").groupBy("device").applyInPandasWithState(_continue, "device string, seq bigint, accepted boolean, reason string", "anchor string", "append", GroupStateTimeout.NoTimeout)


def arrival_order(rows: DataFrame, start: int = 0) -> DataFrame:
    """Rows of one micro-batch with sync_seq in arrival order after start; use within foreachBatch.

    Numbers come from counts per partition, so no task orders the whole batch."""
    numbered = rows.withColumn("_p", F.spark_partition_id()).withColumn("_m", F.monotonically_increasing_id())
    sizes = {r["_p"]: r["count"] for r in numbered.groupBy("_p").count().collect()}
    base, before = {}, start
    for p in sorted(sizes):
        base[p], before = before, before + sizes[p]
    offsets = F.create_map(*[x for p, b in base.items() for x in (F.lit(p), F.lit(b))]) if base else F.lit(None)
    return numbered.withColumn("sync_seq", offsets[F.col("_p")] + (F.col("_m") - F.shiftleft(F.col("_p").cast("bigint"), 33)) + 1).drop("_p", "_m")
