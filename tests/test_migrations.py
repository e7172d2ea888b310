"""A store brought from its first version to the present one."""

import uuid

import pytest

from inkgrove.operators import migrations as M
from inkgrove.plans import manifests
from inkgrove.plans.shared import shared_root


@pytest.fixture
def root(spark):
    return f"{shared_root(spark)}/test-{uuid.uuid4().hex}"


def first_version(spark, root):
    assert M.migrate(spark, root, 1) == 1
    notes = spark.createDataFrame([(1, "a", 0), (2, "b", 1), (3, "c", 1), (None, None, None)], "id long, name string, ring int")
    blocks = spark.createDataFrame([("x0", 1, 0, "one", 0), ("x4", 1, 4, "two", 0), ("y2", 2, 2, "", 1), ("y3", 2, 3, None, 1)], "citation string, id long, idx int, text string, ring int")
    M.insert(spark, root, {"notes": notes, "blocks": blocks, "searched": blocks}, version=1)


def test_first_version_to_present(spark, root):
    first_version(spark, root)
    with pytest.raises(M.NotUnderstood):
        M.read(spark, root, "notes")
    before = manifests.latest(spark, root)[1]["tables"]
    assert M.migrate(spark, root) == M.VERSION
    number, body = manifests.latest(spark, root)
    assert M.migrate(spark, root) == M.VERSION and M.migrate(spark, root, 3) == M.VERSION and manifests.latest(spark, root) == (number, body)
    assert {r.citation: r.name for r in M.read(spark, root, "searched").collect()} == {"x0": "a", "x4": None, "y2": "b", "y3": None}
    rows = M.read(spark, root, "notes").collect()
    assert sorted(r.id or 0 for r in rows) == [0, 1, 2, 3] and all(r.supersedes == [] and r.bereich is r.superseded_by is r.valid_from is None for r in rows)
    assert [body["tables"][t]["parts"] == before[t]["parts"] for t in ("notes", "blocks", "searched")] == [True, True, False]
    assert M.read(spark, root, "anchors").count() == 0 and "locator" in M.read(spark, root, "blocks").columns
    late = spark.createDataFrame([(9, "n", ["a"], "clash")], "id long, name string, supersedes array<string>, other string")
    M.insert(spark, root, {"notes": late})
    assert {r.id: r.supersedes for r in M.read(spark, root, "notes").collect()} == {None: [], 1: [], 2: [], 3: [], 9: ["a"]}


def test_failed_step_is_taken_up_again(spark, root, monkeypatch):
    first_version(spark, root)

    def fails(draft):
        draft.replace("notes", draft.read("notes").limit(0))
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(M, "STEPS", [*M.STEPS[:3], fails, *M.STEPS[4:]])
        with pytest.raises(OSError):
            M.migrate(spark, root)
    assert M.version_of(spark, root) == 3
    assert M.migrate(spark, root) == M.VERSION and M.read(spark, root, "notes").count() == 4


def test_two_writers_take_each_step_once(spark, root, monkeypatch):
    first_version(spark, root)
    taken, step = [], M.STEPS[2]

    def slow(draft):
        step(draft)
        taken.append(1)
        if len(taken) == 1:
            M.migrate(spark, root, 3)

    monkeypatch.setattr(M, "STEPS", [*M.STEPS[:2], slow, *M.STEPS[3:]])
    assert M.migrate(spark, root) == M.VERSION
    assert [c for c, *_ in manifests.latest(spark, root)[1]["tables"]["notes"]["columns"]].count("bereich") == 1


def test_unknown_versions_are_refused(spark, root):
    M.migrate(spark, root)
    number, body = manifests.latest(spark, root)
    assert manifests.publish(spark, root, number + 1, {**body, "version": M.VERSION + 1})
    for refused in (lambda: M.migrate(spark, root), lambda: M.read(spark, root, "notes"), lambda: M.insert(spark, root, {}), lambda: M.migrate(spark, root, M.VERSION + 1)):
        with pytest.raises(M.NotUnderstood):
            refused()
