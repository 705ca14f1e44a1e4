"""Embedding whitening by a QR of tall matrices: the covariance is never formed.

Entries become longs x = floor(1024 * c) + 100000. Exact integer sums give the
mean; each partition centres its rows and reduces them to a triangular factor R
by QR, one Arrow batch at a time; factors are merged in a tree of groups of
FAN_IN until one is left. With its singular values s and right vectors v,
e = s^2 / n are the eigenvalues of the covariance and v its eigenvectors, so
projecting centred rows on v / sqrt(e) whitens them.

What a task holds is a batch of rows and two factors of the dimension; what
reaches the driver are the sums and the last factor. The whitened rows' own
covariance is measured by one more pass.

Defined cases: rows whose vector is null or empty or holds null or non-finite
entries are dropped, and so are entries too large for x in a long; of vectors of
several lengths the most frequent length is fitted and returned (ties: the
longer); with fewer than ``most`` dimensions there are as many components;
components without variance (one row, equal rows, dependent dimensions) whiten
to 0 and explain 0, and count as no error; deviation is null where it exceeds a
long; repeated rows and ids count each; null ids are kept; an empty table gives
an empty result; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import keep

MOST = 8
#: The scale and the shift of an entry (fixed values).
SCALE, SHIFT = 1024, 100000
#: Factors that one task merges.
FAN_IN = 16
#: Entries from here on have no x in a long.
LARGEST = float(1 << 52)
_HALF = 32
_RESULT = "vec_id long, component int, n long, deviation long, whitened double, explained double"


def fit_rows(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, c): the rows that take part, before their length is judged."""
    c = F.col(vec_col).cast("array<double>")
    fine: Column = F.forall(c, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < LARGEST))
    return rows.where(F.coalesce(fine & (F.size(c) > 0), F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), c.alias("c"))


def _integers(batch: pa.RecordBatch, column: int) -> np.ndarray:
    """x of each entry, as rows."""
    lists = batch.column(column)
    c = np.asarray(lists.flatten(), float).reshape(len(lists), -1)
    return np.floor(SCALE * c).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(at, high, low): sums of x by dimension in two halves, so no long overflows."""
    high = low = None
    for batch in batches:
        if batch.num_rows:
            x = _integers(batch, 0)
            parts = (x >> _HALF).sum(axis=0), (x & ((1 << _HALF) - 1)).sum(axis=0)
            high, low = parts if high is None else (high + parts[0], low + parts[1])
    if high is not None:
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(high), dtype=np.int32)), pa.array(high), pa.array(low)], names=["at", "high", "low"])


def _scaled(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n * x - S, exactly: longs where they fit, else Python's integers."""
    large = max(int(np.abs(x).max(initial=0)) * n, max(map(abs, sums)))
    if 2 * large < 1 << 63:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _factor(n: int, sums: list[int]):
    """(part, r): the triangular factor of a partition's centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = np.zeros((0, len(sums)))
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                some = batch.slice(lo, 4096)
                centred = _scaled(_integers(some, 1), n, sums).astype(float) / n
                r = np.linalg.qr(np.concatenate([r, centred]), mode="r")
                part = some.column(0)[0].as_py()
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["part", "r"])

    return run


def _stacked(dim: int):
    """One factor from those of a group (part, r), in their order."""

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("part")
        rows = [np.frombuffer(v.as_buffer(), "<f8").reshape(-1, dim) for v in table.column("r")]
        r = np.linalg.qr(np.concatenate(rows), mode="r")
        part = table.column("part")[0].as_py() // FAN_IN
        return pa.Table.from_arrays([pa.array([part], pa.int64()), pa.array([r.astype("<f8").tobytes()], pa.binary())], names=["part", "r"])

    return run


def merged_factor(factors: DataFrame, dim: int) -> np.ndarray:
    """The one factor that kept factors (part, r) merge to; parts are numbers from 0."""
    total = (factors.agg(F.max("part")).first()[0] or 0) + 1
    while total > 1:
        factors = factors.groupBy((F.col("part") / FAN_IN).cast("long").alias("group")).applyInArrow(_stacked(dim), "part long, r binary")
        total = -(-total // FAN_IN)
    return np.frombuffer(factors.first()["r"], "<f8").reshape(-1, dim)


@dataclass(frozen=True)
class Whitening:
    """The fitted transform: n rows with sums S, eigenvectors as rows, eigenvalues, trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    def apply(self, centred: np.ndarray) -> np.ndarray:
        """Centred rows, whitened."""
        out = np.zeros((len(centred), len(self.values)))
        real = self.values > 0
        out[:, real] = (centred @ self.vectors[real].T) / np.sqrt(self.values[real])
        return out


def fit(rows: DataFrame, n: int, most: int = MOST) -> Whitening:
    """The transform of the ``n`` rows (vec_id, c), which have one length."""
    sums = rows.select("c").mapInArrow(_sums, "at int, high long, low long")
    sums = sums.groupBy("at").agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"))
    total = [(int(r.high) << _HALF) + int(r.low) for r in sums.orderBy("at").collect()]
    dim = len(total)
    factors = rows.select(F.spark_partition_id().cast("long").alias("part"), "c").mapInArrow(_factor(n, total), "part long, r binary")
    r = merged_factor(keep(factors, "factors"), dim)
    _, s, v = np.linalg.svd(r, full_matrices=False)
    s = np.concatenate([s, np.zeros(dim - len(s))])
    v = np.concatenate([v, np.zeros((dim - len(v), dim))])
    # Below this, singular values are rounding.
    s[s <= (s[0] if len(s) else 0.0) * np.finfo(float).eps * dim * n**0.5] = 0.0
    values = s**2 / n
    return Whitening(n, total, v[:most], values[:most], float(values.sum()))


def _products(w: Whitening):
    """(at, x): sums of the whitened rows and of their products, by place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        total, first = np.zeros((k, k)), np.zeros(k)
        for batch in batches:
            if batch.num_rows:
                out = w.apply(_scaled(_integers(batch, 0), w.n, w.sums).astype(float) / w.n)
                total, first = total + out.T @ out, first + out.sum(axis=0)
        flat = np.concatenate([first, total.ravel()])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat), dtype=np.int32)), pa.array(flat)], names=["at", "x"])

    return run


def identity_error(rows: DataFrame, w: Whitening) -> float:
    """The largest entry of the whitened rows' covariance minus the identity, by
    a pass over the rows; components without variance are left out."""
    sums = rows.select("c").mapInArrow(_products(w), "at int, x double").groupBy("at").agg(F.sum("x").alias("x"))
    flat = np.array([r.x for r in sums.orderBy("at").collect()]) / w.n
    k, real = len(w.values), w.values > 0
    mean = flat[:k]
    off = flat[k:].reshape(k, k) - np.outer(mean, mean) - np.eye(k)
    return float(np.abs(off[np.ix_(real, real)]).max(initial=0.0))


def _deviations(gaps: np.ndarray) -> pa.Array:
    """Sums of squares, exactly; null beyond a long."""
    if gaps.dtype != object and gaps.shape[1] * int(np.abs(gaps).max(initial=0)) ** 2 < 1 << 63:
        return pa.array((gaps**2).sum(axis=1))
    whole = (gaps.astype(object) ** 2).sum(axis=1)
    return pa.array([int(v) if v < 1 << 63 else None for v in whole], pa.int64())


def _whitened(w: Whitening):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(w.values)
        share = w.values / w.trace if w.trace else np.zeros(k)
        for batch in batches:
            for lo in range(0, batch.num_rows, 4096):
                some = batch.slice(lo, 4096)
                gaps = _scaled(_integers(some, 1), w.n, w.sums)
                out = w.apply(gaps.astype(float) / w.n)
                rows = len(out)
                at = pa.array(np.repeat(np.arange(rows), k))
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(at), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)), pa.array(np.full(rows * k, w.n)),
                        _deviations(gaps).take(at), pa.array(out.ravel()), pa.array(np.tile(share, rows)),
                    ],
                    names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
                )

    return run


def whiten(rows: DataFrame, most: int = MOST, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error):
    up to ``most`` whitened components of each row that takes part."""
    fine = fit_rows(rows, id_col, vec_col)
    size = fine.groupBy(F.size("c").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    if size is None:
        return fine.sparkSession.createDataFrame([], f"{_RESULT}, identity_error double")
    fine = fine.where(F.size("c") == size["dim"])
    w = fit(fine, size["n"], most)
    return fine.mapInArrow(_whitened(w), _RESULT).withColumn("identity_error", F.lit(identity_error(fine, w)))
