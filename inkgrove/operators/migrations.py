"""A store of tables with a version, brought to the present one by ordered steps.

A numbered manifest names the version and, for each table, its columns with their defaults and its parts. A step that adds columns changes the manifest alone: rows
written before get the default as they are read, so no table is rewritten for it. A step that changes rows writes a new part and points to it. Each step is
published in a manifest of its own: one that fails or loses its executors leaves nothing visible, and the next run goes on after the last step that was published."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from inkgrove.plans import manifests


class NotUnderstood(RuntimeError):
    """The store's version is not one that this code reads or writes."""


class Draft:
    """A store's contents while a step changes them."""

    def __init__(self, spark: SparkSession, root: str, body: dict):
        self.spark, self.root = spark, root
        self.tables = {name: {"columns": [*t["columns"]], "parts": [*t["parts"]]} for name, t in body.get("tables", {}).items()}

    def create(self, name: str, /, **types: str) -> None:
        """A table without rows; every column is null where a part lacks it."""
        self.tables[name] = {"columns": [[c, t, "null"] for c, t in types.items()], "parts": []}

    def add(self, name: str, column: str, kind: str, default: str = "null") -> None:
        """A column whose value in all rows so far is the SQL expression default."""
        self.tables[name]["columns"].append([column, kind, default])

    def read(self, name: str) -> DataFrame:
        table = self.tables[name]
        whole = self.spark.createDataFrame([], ", ".join(f"`{c}` {t}" for c, t, _ in table["columns"]))
        for path in table["parts"]:
            whole = whole.unionByName(_shaped(self.spark.read.parquet(path), table["columns"]))
        return whole

    def write(self, name: str, rows: DataFrame) -> None:
        """One more part of a table, with its present columns; other columns of rows are not kept."""
        path = f"{self.root}/{name}/{uuid.uuid4().hex}"
        _shaped(rows, self.tables[name]["columns"]).write.parquet(path)
        self.tables[name]["parts"].append(path)

    def replace(self, name: str, rows: DataFrame) -> None:
        old = self.tables[name]["parts"]
        self.tables[name] = {"columns": self.tables[name]["columns"], "parts": []}
        try:
            self.write(name, rows)
        except Exception:
            self.tables[name]["parts"] = old
            raise


def _shaped(rows: DataFrame, columns: list[list[str]]) -> DataFrame:
    there = set(rows.columns)
    return rows.select(*((F.col(f"`{c}`") if c in there else F.expr(default)).cast(kind).alias(c) for c, kind, default in columns))


def _first(d: Draft) -> None:
    d.create("notes", id="bigint", name="string", ring="int", created="timestamp", updated="timestamp", retention="string")
    d.create("blocks", citation="string", id="bigint", idx="int", text="string")
    d.create("searched", citation="string", ring="int", text="string")
    d.create("vectors", citation="string", vec="array<float>")
    d.create("links", from_id="bigint", pos="int", to_name="string")


def _names_searched(d: Draft) -> None:
    """A note's name can be found, on its first block alone, so that a word of it does not match every block."""
    d.add("searched", "name", "string")
    if d.tables["searched"]["parts"]:
        firsts = d.read("blocks").groupBy("id").agg(F.min(F.struct("idx", "citation")).alias("first")).join(d.read("notes").select("id", "name"), "id")
        d.replace("searched", d.read("searched").drop("name").join(firsts.select("first.citation", "name"), "citation", "left"))


def _departments(d: Draft) -> None:
    d.add("notes", "bereich", "string")


def _successors(d: Draft) -> None:
    d.add("notes", "supersedes", "array<string>", "array()")
    d.add("notes", "superseded_by", "string")


def _validity(d: Draft) -> None:
    d.add("notes", "valid_from", "timestamp")
    d.add("notes", "invalid_at", "timestamp")


def _locators(d: Draft) -> None:
    d.add("blocks", "locator", "string")


def _anchors(d: Draft) -> None:
    d.create("anchors", id="bigint", path="string", lines="string", sha256="string", at="timestamp")
    d.create("anchor_files", path="string", mtime="timestamp", size="bigint", sha256="string")


#: Step k brings version k to k + 1. A published step is never changed; new ones follow it.
STEPS: list[Callable[[Draft], None]] = [_first, _names_searched, _departments, _successors, _validity, _locators, _anchors]
VERSION = len(STEPS)


def version_of(spark: SparkSession, root: str) -> int:
    """A store's version; 0 where there is none."""
    return manifests.latest(spark, root)[1].get("version", 0)


def migrate(spark: SparkSession, root: str, to: int = VERSION) -> int:
    """Bring a store to a version, step by step; the version it then has. Nothing happens where it is there or beyond.

    A version beyond VERSION raises NotUnderstood. Where another writer publishes first, the step is taken again from what that one left."""

    def attempt(number: int, body: dict) -> dict | None:
        at = body.get("version", 0)
        if at > VERSION:
            raise NotUnderstood(f"{root} has version {at}, this code knows up to {VERSION}")
        if at >= to:
            return None
        draft = Draft(spark, root, body)
        STEPS[at](draft)
        return {**body, "version": at + 1, "tables": draft.tables}

    if to > VERSION:
        raise NotUnderstood(f"version {to} is not known, the last is {VERSION}")
    while version_of(spark, root) < to or version_of(spark, root) > VERSION:
        manifests.commit(spark, root, attempt)
    return version_of(spark, root)


def insert(spark: SparkSession, root: str, rows: dict[str, DataFrame], version: int = VERSION) -> int:
    """Rows for several tables, visible together; the number of the manifest. A store of another version, or a table it lacks, raises NotUnderstood."""

    def attempt(number: int, body: dict) -> dict:
        draft = Draft(spark, root, body)
        if body.get("version", 0) != version or not rows.keys() <= draft.tables.keys():
            raise NotUnderstood(f"{root} has version {body.get('version', 0)} and tables {sorted(draft.tables)}")
        for name, df in rows.items():
            draft.write(name, df)
        return {**body, "tables": draft.tables}

    return manifests.commit(spark, root, attempt)


def read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of a store of the present version."""
    body = manifests.latest(spark, root)[1]
    if body.get("version", 0) != VERSION:
        raise NotUnderstood(f"{root} has version {body.get('version', 0)}, not {VERSION}: migrate it first")
    return Draft(spark, root, body).read(name)
