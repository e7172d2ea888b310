"""Whether a check is worth its budget, by how the last one ended."""

import datetime as dt

from inkgrove.operators import usage as U


def test_check_plans(spark):
    at = lambda hours: dt.datetime(2024, 1, 1) + dt.timedelta(hours=hours)
    checks = [("e", at(1), 1, 5000, True), ("e", at(30), 2, 100, True), ("e", at(31), 3, 3000, False), ("f", at(1), 4, 1, True), ("f", at(1), 6, 9000, True)]
    calls = [("e", at(0), 10, 3000), ("e", at(2), 11, 3000), ("e", at(2), 12, 6000), ("e", at(25), 13, 3000), ("e", at(26), 14, 3000), ("e", at(30.5), 15, 3000), ("e", at(32), 16, 3000), ("e", at(40), 17, 0), ("f", at(1), 5, 3000), ("f", at(1), 7, 3000), ("g", at(1), 8, 3000), (None, at(1), 9, 1)]
    out = {r.seq: (r.plan, r.last_ms) for r in U.check_plans(spark.createDataFrame(calls, "endpoint string, at timestamp, seq long, budget_ms long"), spark.createDataFrame(checks, "endpoint string, at timestamp, seq long, took_ms long, completed boolean")).collect()}
    assert out == {
        10: ("run", None), 11: ("skip-slow", 5000), 12: ("run", 5000), 13: ("skip-slow", 5000), 14: ("run", None), 15: ("run", 100), 16: ("skip-abandoned", 3000), 17: ("run-unbounded", 3000),
        5: ("run", 1), 7: ("skip-slow", 9000), 8: ("run", None), 9: ("run", None),
    }
