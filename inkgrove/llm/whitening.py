"""Whitening of embeddings by a tall-skinny QR, without ever forming their covariance.

Entries become whole numbers, so sums over all rows are exact and every row is centred by them. Each partition
reduces its centred rows to one upper triangle R, triangles are merged pairwise in a tree of Spark jobs, and the singular value
decomposition of the last one gives the components: its right vectors are the eigenvectors of the covariance, its singular
values, squared over n, the eigenvalues. What passes through the driver is one triangle, dimensions x dimensions.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from inkgrove.plans.shared import cut, tune_arrow

#: An entry c becomes floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 64, 1_000_000
#: Whole numbers beyond this are held at it: they still fit a long after the shift.
LARGEST = 1 << 60
COMPONENTS = 32
#: Triangles merged in one task at each level of the tree.
FAN_IN = 4
#: Entries of the rows that are stacked on a triangle at once.
STACKED = 1 << 20
_INT64 = 1 << 63


@dataclass(frozen=True)
class Whitening:
    """Of n rows with the per-dimension sums; vectors has one component per column, spread its standard deviations, explained its shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    spread: np.ndarray
    explained: np.ndarray


def whole(batch: pa.RecordBatch, size: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, rows of whole numbers) of the usable vectors of a batch's column vector, for each length of vector, or for the one given."""
    vectors = batch.column("vector")
    lengths = np.asarray(vectors.value_lengths().fill_null(-1))
    for d in np.unique(lengths[lengths >= 1]) if size is None else [size]:
        places = np.flatnonzero(lengths == d)
        held = vectors.take(pa.array(places)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(places), d)
        fine = np.isfinite(held).all(axis=1)
        with np.errstate(over="ignore"):
            x = np.clip(np.floor(SCALE * held[fine]), -float(LARGEST), float(LARGEST)).astype(np.int64) + SHIFT
        yield places[fine], x


def exact(x: np.ndarray, factor: int) -> np.ndarray:
    """x as integers that can be multiplied by factor: Python's own where 64 bits are not enough."""
    return x if not x.size or max(abs(int(x.max())), abs(int(x.min()))) * factor < _INT64 else x.astype(object)


def centred_exactly(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - sums, exact."""
    fits = not x.size or 2 * n * (max(abs(int(x.max())), abs(int(x.min()))) + 1) < _INT64
    return n * x - np.array(sums, np.int64) if fits else n * x.astype(object) - np.array(sums, object)


def centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """x - sums / n: the exact difference, rounded once."""
    return (centred_exactly(x, n, sums) / n).astype(np.float64)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Of each row the sum of (n * x - sums)^2, exact."""
    d = centred_exactly(x, n, sums)
    largest = max(abs(int(d.max())), abs(int(d.min()))) if d.size else 0
    squares = exact(d, max(largest, 1) * x.shape[1]) ** 2
    return [int(v) for v in squares.sum(axis=1)]


def _vectors(docs: DataFrame, vector: str) -> DataFrame:
    return docs.select(F.col(_named(vector)).cast("array<double>").alias("vector"))


def _named(column: str) -> str:
    return "`" + column.replace("`", "``") + "`"


def exact_sums(docs: DataFrame, vector: str = "embedding") -> tuple[int, list[int]]:
    """n and the sums of the vectors of the commonest length (of equally common ones the longest)."""

    def partial(batches):
        for batch in batches:
            found = list(whole(batch))
            if found:
                sums = [[int(v) for v in exact(x, len(x)).sum(axis=0)] for _, x in found]
                columns = [[x.shape[1] for _, x in found], [len(x) for _, x in found], [[str(v) for v in s] for s in sums]]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.list_(pa.string()))], ["size", "n", "sums"])

    parts = cut(_vectors(docs, vector).mapInArrow(partial, "size int, n bigint, sums array<string>"), "sums")
    best = parts.where("n > 0").groupBy("size").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("size")).first()
    if best is None:
        return 0, []
    per_place = parts.where(F.col("size") == best.size).select(F.posexplode("sums").alias("place", "s")).groupBy("place").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    return best.n, [int(r.s) for r in per_place.orderBy("place").collect()]  # one row per dimension


def stacked(r: np.ndarray | None, rows: np.ndarray) -> np.ndarray:
    """The triangle of rows below the triangle r."""
    return np.linalg.qr(rows if r is None else np.vstack([r, rows]), mode="r")


def _triangle(part: int, r: np.ndarray | None) -> dict:
    return {"part": [part], "rows": [len(r)], "r": [r.tobytes()]}


def triangle(docs: DataFrame, n: int, sums: list[int], vector: str = "embedding") -> np.ndarray:
    """The triangle of all centred rows: one of each partition, merged FAN_IN at a time."""
    size, schema = len(sums), "part bigint, rows int, r binary"

    def of_partition(batches):
        from pyspark import TaskContext

        r, step = None, max(1, STACKED // size)
        for batch in batches:
            for _, x in whole(batch, size):
                rows = centred(x, n, sums)
                for i in range(0, len(rows), step):
                    r = stacked(r, rows[i : i + step])
        if r is not None:
            yield pa.RecordBatch.from_pydict(_triangle(TaskContext.get().partitionId(), r), pa.schema([("part", pa.int64()), ("rows", pa.int32()), ("r", pa.binary())]))

    def merged(key, group):
        r = None
        for rows, data in zip(group["rows"], group["r"]):
            r = stacked(r, np.frombuffer(data).reshape(rows, size))
        return pd.DataFrame(_triangle(key[0], r))

    level = cut(_vectors(docs, vector).mapInArrow(of_partition, schema), "triangles")
    last = level.agg(F.max("part")).first()[0]
    while last > 0:
        last //= FAN_IN
        level = cut(level.groupBy(F.floor(F.col("part") / FAN_IN).alias("part")).applyInPandas(merged, schema), "triangles")
    found = level.first()
    return np.frombuffer(found.r).reshape(found.rows, size)


def fit(docs: DataFrame, vector: str = "embedding", components: int = COMPONENTS) -> Whitening | None:
    """None if no row has a usable vector. The sign of a component is such that its largest entry is positive."""
    tune_arrow(docs.sparkSession)
    n, sums = exact_sums(docs, vector)
    if not n:
        return None
    _, values, right = np.linalg.svd(triangle(docs, n, sums, vector), full_matrices=True)
    values = np.concatenate([values, np.zeros(len(right) - len(values))])
    right = right * np.sign(right[np.arange(len(right)), np.abs(right).argmax(axis=1)])[:, None]
    total = float((values**2).sum())
    k = min(components, len(sums))
    explained = values[:k] ** 2 / total if total else np.zeros(k)
    flat = values <= values[0] * max(n, len(sums)) ** 0.5 * np.finfo(float).eps * 8
    return Whitening(n, sums, right[:k].T.copy(), np.where(flat, np.nan, values / np.sqrt(n))[:k], explained)


def whiten(docs: DataFrame, fitted: Whitening, vector: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """(id_col, deviation decimal(38,0), whitened array<double>) of every row whose vector is of the fitted length and finite.

    An entry of whitened is null where the component has no variance. A deviation beyond 38 digits is null."""
    size, n, sums = len(fitted.sums), fitted.n, fitted.sums
    shared = docs.sparkSession.sparkContext.broadcast((fitted.vectors / fitted.spread, np.isnan(fitted.spread)))  # dimensions x components

    def rows(batches):
        onto, flat = shared.value
        for batch in batches:
            for places, x in whole(batch, size):
                if len(places):
                    y = centred(x, n, sums) @ np.nan_to_num(onto)
                    items = pa.array(y.ravel(), mask=np.tile(flat, len(y)))
                    found = [str(v) if v < 10**38 else None for v in deviations(x, n, sums)]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(y) + 1) * y.shape[1], pa.int32()), items)
                    yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(places)), pa.array(found, pa.string()), lists], ["id", "deviation", "whitened"])

    kind = docs.select(F.col(_named(id_col)).alias("id")).schema["id"].dataType.simpleString()
    asked = docs.select(F.col(_named(id_col)).alias("id"), F.col(_named(vector)).cast("array<double>").alias("vector"))
    out = asked.mapInArrow(rows, f"id {kind}, deviation string, whitened array<double>")
    return out.select(F.col("id").alias(id_col), F.col("deviation").cast("decimal(38,0)").alias("deviation"), "whitened")


def identity_error(whitened: DataFrame, components: int) -> float | None:
    """Largest absolute entry of the covariance of whitened (components with variance only) minus the identity; centred before multiplying."""
    rows = whitened.select("whitened")
    means = rows.select(F.posexplode("whitened").alias("place", "w")).groupBy("place").agg(F.avg("w").alias("m")).collect()  # one row per component
    mean = np.zeros(components)
    live = np.zeros(components, bool)
    for m in means:
        if m.m is not None:
            mean[m.place], live[m.place] = m.m, True
    if not live.any():
        return None

    def products(batches):
        total, n = np.zeros((components, components)), 0
        for batch in batches:
            flat = batch.column(0).flatten().to_numpy(zero_copy_only=False)
            w = np.where(live, flat.reshape(batch.num_rows, components), 0) - np.where(live, mean, 0)
            total, n = total + w.T @ w, n + len(w)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel()), pa.array(np.full(total.size, n), pa.int64())], ["cell", "s", "n"])

    summed = rows.mapInArrow(products, "cell int, s double, n bigint").groupBy("cell").agg((F.sum("s") / F.sum("n")).alias("c"))
    covariance = np.zeros(components * components)
    for r in summed.collect():  # components x components
        covariance[r.cell] = r.c
    apart = np.abs(covariance.reshape(components, components) - np.eye(components))
    return float(apart[np.ix_(live, live)].max())


def whitened_components(docs: DataFrame, vector: str = "embedding", id_col: str = "vec_id", components: int = COMPONENTS) -> DataFrame:
    """id_col, component (from 1), n, deviation, whitened, explained and identity_error, one row for each row and component.

    Rows whose vector is null, empty or holds a null or non-finite entry are dropped, as are those of another length than the
    commonest (of equally common lengths the longest). Entries c become floor(64 * c) + 1000000, held within 2**60. Repeated rows count each; null ids stay.
    A component without variance (equal rows, fewer rows than dimensions) keeps its rows with a null whitened. deviation is null beyond 38 digits. An empty table
    gives an empty result; other columns are not read, whatever their names."""
    kind = docs.select(F.col(_named(id_col))).schema[0].dataType.simpleString()
    fitted = fit(docs, vector, components)
    if fitted is None:
        return docs.sparkSession.createDataFrame([], f"`{id_col}` {kind}, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double")
    k = len(fitted.explained)
    held = cut(whiten(docs, fitted, vector, id_col), "whitened")
    error = identity_error(held, k)
    shares: Column = F.array(*map(F.lit, fitted.explained.tolist()))
    rows = held.select(_named(id_col), "deviation", F.posexplode("whitened").alias("place", "whitened"))
    return rows.select(
        _named(id_col), (F.col("place") + 1).alias("component"), F.lit(fitted.n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(shares, F.col("place") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
