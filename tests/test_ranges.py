"""Predecessors by ranges, departments from all keys, names and scopes of queries."""

import json
import random

import pytest
from pyspark.sql import functions as F

from inkgrove.operators import audit as A
from inkgrove.operators import symbols as Y
from inkgrove.plans.shared import cut


@pytest.fixture
def ranges(spark):
    """Small tables are dealt to all tasks, too."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_predecessors_cross_ranges(spark, ranges, monkeypatch):
    kept = []
    monkeypatch.setattr(A, "cut", lambda df, label: kept.append(cut(df, label)) or kept[-1])
    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None, "hot", "hot", "hot"]), i, f"h{i}" if i % 9 else None) for i in range(500)]
    df = spark.createDataFrame(rows, "device string, seq long, hash string").repartition(11)
    last, want = {}, {}
    for d, i, h in rows:
        want[i] = (last.get(d), d not in last)
        last[d] = h
    got = {r.seq: (r._before, r._first) for r in A.preceded(df, "hash").collect()}
    assert got == want
    assert kept[0].select("_range").distinct().count() > 1 and kept[0].where("device = 'hot'").select("_range").distinct().count() > 1
    assert A.preceded(df.limit(0), "hash").count() == 0


def test_one_log_in_many_ranges(spark, ranges):
    log = spark.range(2000).select(F.col("id").alias("seq"), F.lit("d").alias("device"), *[F.lit("x").alias(c) for c in ("actor", "action", "subject", "detail")])
    sealed = A.seal(log)
    assert A.verify_chain(sealed).first()[:] == ("d", 2000, None)
    assert A.verify_chain(sealed.where("seq <> 700")).first()[:] == ("d", 1999, 701)
    anchor = sealed.where("seq = 99").select("device", F.col("hash").alias("floor_hash"))
    assert A.verify_chain(sealed.where("seq >= 100"), anchors=anchor).first()[:] == ("d", 1900, None)
    assert A.verify_chain(sealed.where("seq >= 100")).first().first_break == 100


def test_unsigned_after_signed(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, True), ("a", 3, False), ("b", 1, False), (None, 1, True), (None, 2, False)], "device string, seq long, signed boolean")
    assert [r.seq for r in A.unsigned_after_signed(df.where("device is not null")).collect()] == [3]


@pytest.mark.parametrize(
    "detail, names",
    [
        ({"bereich": "a", "bereiche": ["b", 3, None, "a"], "requested_bereich": "c"}, ["a", "b", "c"]),
        ({"added": {"k": ["d"], "m": "no", "n": [1]}, "removed": {"k": ["e", "d"]}, "after": {"bereiche": {"k": ["f"]}}}, ["d", "e", "f"]),
        ({"bereich": 7, "bereiche": "a", "added": ["x"], "after": {"bereiche": ["y"]}}, []),
        ("not json", []),
        (None, []),
        ([1], []),
    ],
)
def test_departments(spark, detail, names):
    text = detail if isinstance(detail, str) or detail is None else json.dumps(detail)
    assert spark.createDataFrame([(text,)], "d string").select(A.detail_departments(F.col("d"))).first()[0] == names


@pytest.mark.parametrize(
    "query, want",
    [
        ("10. Code index", ("10. Code index", "")), ("a.b.c", ("c", "a.b")), ("A::B::run", ("run", "a.b")), ("::run", ("run", "")), ("Type#go", ("go", "type")), ("#go", ("#go", "")),
        ("v1.2 notes", ("v1.2 notes", "")), ("file.name", ("name", "file")), ("..x", ("..x", "")), ("  plain  ", ("plain", "")), ("", ("", "")), ("a b#c", ("c", "a b")),
    ],
)
def test_asked(query, want):
    assert Y.asked(query) == want
