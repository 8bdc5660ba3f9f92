"""Embedding whitening: leading components of the covariance, and projections on them (operator 11).

Entries become whole numbers, ``floor(64 * c) + 1000000``, of which all sums are exact:
one pass adds up numbers and dimensions, one the products of what is left after taking
the rounded mean away, so that every covariance is that of centred vectors, rounded once
at the end, whatever the order of tasks. Its eigenpairs come from ``symmetric``; the
mean and at most ``COMPONENTS`` vectors travel to the tasks, which project row by row.
A last pass measures how far the covariance of the projections is from the identity.
Nothing but tables of the vectors' width reaches the driver.

Rows whose vector is null, empty or holds null or non-finite entries go, as do vectors
of another length than the most frequent one (of equally frequent ones the longest).
Rows without id and repeated rows stay. Components without variance (up to rounding)
have no scale and are left out, so equal vectors, a single one and empty tables give
no rows. Entries whose whole number is beyond 2**62 stop there; where numbers are so
far apart that products don't fit doubles exactly, they are added up as doubles, and
a ``deviation`` beyond the range of long is null. Other columns are left behind,
whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkplane.llm.common import valid_vector
from inkplane.llm.symmetric import eigenpairs

COMPONENTS = 32
SCALE, OFFSET, LIMIT = 64.0, 1_000_000, 1 << 62
#: Doubles hold whole numbers up to here.
EXACT = 1 << 53
#: Vectors of a task that are looked at together.
ROWS = 2048


def _whole(m: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.clip(np.floor(SCALE * m), -float(LIMIT), float(LIMIT)).astype(np.int64) + OFFSET


def _blocks(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS):
            part = batch.slice(start, ROWS)
            yield part, _whole(part.column("v").flatten().to_numpy(zero_copy_only=False).reshape(-1, width))


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(width, i, n, s, low, high) of the vectors of each width in a batch."""
    names = ["width", "i", "n", "s", "low", "high"]
    for batch in batches:
        sizes = np.array([len(v) for v in batch.column("v")])
        for width in np.unique(sizes).tolist():
            x = _whole(batch.column("v").filter(pa.array(sizes == width)).flatten().to_numpy(zero_copy_only=False).reshape(-1, width))
            safe = int(np.abs(x).max()) < (1 << 62) // len(x)
            total = x.sum(axis=0) if safe else x.astype(object).sum(axis=0)
            columns = [np.full(width, width), np.arange(width), np.full(width, len(x)), None, x.min(axis=0), x.max(axis=0)]
            arrays = [pa.array([Decimal(int(t)) for t in total], pa.decimal128(38, 0)) if c is None else pa.array(c.astype(np.int64)) for c in columns]
            yield pa.RecordBatch.from_arrays(arrays, names)


@dataclass
class Model:
    """What a projection needs: ``n`` vectors of width ``len(centre)``, sums ``centre * n + rest``, eigenpairs, trace, error."""

    n: int
    centre: np.ndarray
    rest: np.ndarray
    reach: int
    values: np.ndarray
    vectors: np.ndarray
    trace: float
    error: float = 0.0

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return (self.offsets(x) @ self.vectors) / np.sqrt(self.values)

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """Distances from the exact mean, as doubles."""
        y = x - self.centre
        return (y * self.n - self.rest) / self.n if self.reach * self.n < LIMIT else y - self.rest / self.n

    def deviations(self, x: np.ndarray) -> list[int | None]:
        far = self.reach * self.n + self.n
        if far * far * max(1, len(self.centre)) < LIMIT:
            return (((x - self.centre) * self.n - self.rest) ** 2).sum(axis=1).tolist()
        far_off = (x - self.centre).astype(object) * self.n - self.rest.astype(object)
        totals = [sum(int(v) ** 2 for v in row) for row in far_off]
        return [t if t < 1 << 63 else None for t in totals]


def _upper(batches: Iterator[pa.RecordBatch], width: int, centre: np.ndarray, reach: int) -> Iterator[pa.RecordBatch]:
    """(i, j, s) with i <= j: sums of products over all of a task's vectors, exact where ``reach`` allows."""
    exact = reach * reach <= EXACT
    step = max(1, EXACT // max(1, reach * reach)) if exact else ROWS
    total = np.zeros((width, width), object if exact else float)
    part, held = np.zeros((width, width)), 0
    for _, x in _blocks(batches, width):
        y = (x - centre).astype(float)
        for start in range(0, len(y), step):
            piece = y[start : start + step]
            if held + len(piece) > step:  # what doubles hold is full
                total += part.astype(np.int64).astype(object) if exact else part
                part, held = np.zeros((width, width)), 0
            part, held = part + piece.T @ piece, held + len(piece)
    total += part.astype(np.int64).astype(object) if exact else part
    i, j = np.triu_indices(width)
    values = total[i, j].tolist()
    s = pa.array([Decimal(int(v)) for v in values], pa.decimal128(38, 0)) if exact else pa.array(values, pa.float64())
    yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), s], ["i", "j", "s"])


def _products(rows: DataFrame, width: int, centre: np.ndarray, reach: int) -> np.ndarray:
    kind = "decimal(38,0)" if reach * reach <= EXACT else "double"
    made = rows.select("v").mapInArrow(lambda it: _upper(it, width, centre, reach), f"i int, j int, s {kind}").groupBy("i", "j").agg(F.sum("s").alias("s"))
    out = np.zeros((width, width), object)
    for r in made.collect():  # the width's square
        out[r.i, r.j] = out[r.j, r.i] = int(r.s) if kind != "double" else r.s
    return out


def _second(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """(i, j, s) with i <= j: products of the projections; those of j = -1 are their sums."""
    width, k = len(model.centre), len(model.values)
    total, first = np.zeros((k, k)), np.zeros(k)
    for _, x in _blocks(batches, width):
        w = model.whitened(x)
        total, first = total + w.T @ w, first + w.sum(axis=0)
    i, j = np.triu_indices(k)
    columns = [np.concatenate([i, np.arange(k)]).astype(np.int32), np.concatenate([j, np.full(k, -1)]).astype(np.int32), np.concatenate([total[i, j], first])]
    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["i", "j", "s"])


def _rows(vectors: DataFrame) -> DataFrame:
    return vectors.filter(valid_vector("embedding")).select("vec_id", F.col("embedding").cast("array<double>").alias("v"))


def fit(vectors: DataFrame, components: int = COMPONENTS) -> Model | None:
    """The model of all usable vectors (vec_id, embedding); none without any."""
    rows = _rows(vectors)
    facts = rows.select("v").mapInArrow(_sums, "width long, i long, n long, s decimal(38,0), low long, high long")
    facts = facts.groupBy("width", "i").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.min("low").alias("low"), F.max("high").alias("high")).persist()
    try:
        most = facts.filter("i = 0").orderBy(F.desc("n"), F.desc("width")).limit(1).collect()
        if not most:
            return None
        n, width = most[0].n, most[0].width
        found = sorted(facts.filter(F.col("width") == width).collect(), key=lambda r: r.i)  # a row for each dimension
    finally:
        facts.unpersist()
    centre = [int(r.s) // n for r in found]
    rest = [int(r.s) - n * c for r, c in zip(found, centre, strict=True)]
    reach = max(max(r.high - c, c - r.low, 1) for r, c in zip(found, centre, strict=True))
    rows = rows.filter(F.size("v") == width)
    centre_ = np.array(centre, np.int64)
    sums = _products(rows, width, centre_, reach)
    covariance = np.array([[(n * sums[i, j] - rest[i] * rest[j]) / (n * n) for j in range(width)] for i in range(width)], float)
    values, directions = eigenpairs(covariance, min(components, width))
    trace = float(np.trace(covariance))
    some = values > width * np.finfo(float).eps * max(trace, 0.0)
    model = Model(n, centre_, np.array(rest, np.int64), reach, values[some], directions[:, some], trace)
    if some.any():
        made = rows.select("v").mapInArrow(lambda it: _second(it, model), "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
        mean = np.array([s for _, s in sorted((r.i, r.s) for r in made if r.j < 0)]) / n
        model.error = float(max(abs(r.s / n - mean[r.i] * mean[r.j] - (r.i == r.j)) for r in made if r.j >= 0))
    return model


def transform(vectors: DataFrame, model: Model | None) -> DataFrame:
    """(vec_id, deviation, whitened) of every usable vector: squared distance from the mean, scaled, and its projections."""
    rows, width = _rows(vectors), len(model.centre) if model else 0
    kind = T.StructType([rows.schema["vec_id"], T.StructField("deviation", T.LongType()), T.StructField("whitened", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in _blocks(batches, width):
            w = model.whitened(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array(model.deviations(x), pa.int64()), lists], ["vec_id", "deviation", "whitened"])

    return rows.filter(F.size("v") == width).mapInArrow(run, kind)


def components(vectors: DataFrame, model: Model | None) -> DataFrame:
    """A row for each usable vector and component, with what the model says about both."""
    made = transform(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    shares = (model.values / model.trace).tolist() if model else []
    explained = F.element_at(F.array(*[F.lit(x) for x in shares]), F.col("at") + 1) if shares else F.lit(0.0)
    return made.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        explained.alias("explained"), F.lit(model.error if model else 0.0).alias("identity_error"),
    )


def whiten(vectors: DataFrame) -> DataFrame:
    return components(vectors, fit(vectors))
