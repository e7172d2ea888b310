"""Log rows that name a subject only by a keyed hash."""

import hashlib
import json

from inkgrove.operators import policy


def test_rows_by_hash(spark):
    h = lambda q, key="k": json.dumps({"query": hashlib.sha256(f"{key}|{q}".encode()).hexdigest()})
    rows = [(1, h("ann lee")), (2, h("bob")), (3, None), (4, "no json"), (5, h("ann lee", "other")), (6, h("a@b.de")), (6, h("a@b.de")), (7, h(""))]
    log = spark.createDataFrame(rows, "seq bigint, detail string")
    forms = spark.createDataFrame([("ann", "Ann  Lee"), ("ann", "ann lee"), ("ann", "A@b.de"), ("eve", "ann lee"), ("eve", " "), ("eve", None)], "subject string, form string")
    got = sorted(tuple(r) for r in policy.subject_access_by_hash(log, forms, "k").collect())
    assert got == [("ann", "audit-hash", "1", "Ann  Lee"), ("ann", "audit-hash", "6", "A@b.de"), ("ann", "audit-hash", "6", "A@b.de"), ("eve", "audit-hash", "1", "ann lee")]
    assert policy.subject_access_by_hash(log.limit(0), forms, "k").count() == 0
    assert policy.subject_access_by_hash(log, forms.limit(0), "k").count() == 0
