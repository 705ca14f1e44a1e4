"""Exact nearest vectors by squared Euclidean distance."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK = 1024


def squared_distance(a: Column, b: Column) -> Column:
    """Sum of squared differences, in double, left to right."""
    gaps = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(gaps, F.lit(0.0).cast("double"), lambda s, x: s + x)


def top_k(vectors: DataFrame, query: list[float], k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(rank, id, distance) of the k nearest to one query; ties by id.

    Stays in the JVM: a projection and a top-k that keeps k rows per task.
    """
    q = F.array(*[F.lit(float(x)) for x in query])
    near = vectors.withColumn("distance", squared_distance(F.col(vec_col), q)).orderBy("distance", id_col).limit(k)
    rank = F.row_number().over(Window.orderBy("distance", id_col))
    return near.select(rank.alias("rank"), id_col, "distance")


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks of ids and little-endian float64 vectors."""
    for batch in batches:
        for lo in range(0, batch.num_rows, BLOCK):
            part = batch.slice(lo, BLOCK)
            vectors = part.column(1)
            ok = np.flatnonzero(np.asarray(vectors.is_valid()))
            if len(ok) < part.num_rows:
                part = part.take(pa.array(ok))
                vectors = part.column(1)
            if not part.num_rows:
                continue
            flat = np.asarray(vectors.flatten(), "<f8")
            yield pa.RecordBatch.from_arrays([pa.array([part.column(0).to_pylist()], pa.list_(pa.int64())), pa.array([flat.tobytes()], pa.binary())], names=["ids", "block"])


def nearest_of(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, x: np.ndarray, k: int, ok: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, distance): of the rows ``x`` the k nearest to each of ``q``,
    of those that ``ok`` allows for it."""
    out_q, out_i, out_d = [], [], []
    q_norm, x_norm = (q**2).sum(axis=1), (x**2).sum(axis=1)
    near = q_norm[:, None] + x_norm[None, :] - 2 * q @ x.T
    if ok is not None:
        near[~ok] = np.inf
    # The fast form cancels: its error follows the norms, not the distance.
    slack = 1e-9 + 64 * np.finfo(float).eps * q.shape[1] * (q_norm + x_norm.max(initial=0.0))
    for i in range(len(q_ids)):
        # A few more than k by the fast form, then exactly, then ties by id.
        take = min(len(ids), k + 8)
        edge = np.partition(near[i], take - 1)[take - 1] + 2 * slack[i]
        at = np.flatnonzero(near[i] <= edge if ok is None else (near[i] <= edge) & ok[i])
        exact = ((x[at] - q[i]) ** 2).sum(axis=1)
        best = np.lexsort((ids[at], exact))[:k]
        out_q.append(np.full(len(best), q_ids[i]))
        out_i.append(ids[at][best])
        out_d.append(exact[best])
    return np.concatenate(out_q), np.concatenate(out_i), np.concatenate(out_d)


def _block(batch: pa.RecordBatch, row: int, ids: int, vectors: int) -> tuple[np.ndarray, np.ndarray]:
    """A packed block's ids and vectors."""
    keys = np.asarray(batch.column(ids)[row].values)
    return keys, np.frombuffer(batch.column(vectors)[row].as_buffer(), "<f8").reshape(len(keys), -1)


def _nearest(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                found = nearest_of(*_block(batch, row, 0, 1), *_block(batch, row, 2, 3), k)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], names=["query_id", "id", "distance"])

    return run


def top_k_batch(queries: DataFrame, vectors: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest of each query, exactly.

    Both sides are packed into blocks of up to 1,024 vectors; each pair of
    blocks is one matrix product that leaves k rows for each query. What is
    shuffled is k rows for each query and block, not pairs of vectors.
    """
    wide = F.col(vec_col).cast("array<double>")
    q = queries.select(F.col(id_col).cast("long"), wide).mapInArrow(_packed, "ids array<long>, block binary").select(F.col("ids").alias("q_ids"), F.col("block").alias("q_block"))
    x = vectors.select(F.col(id_col).cast("long"), wide).mapInArrow(_packed, "ids array<long>, block binary")
    found = x.crossJoin(q).select("q_ids", "q_block", "ids", "block").mapInArrow(_nearest(k), "query_id long, id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "distance")


def nested_result(found: DataFrame, docs: DataFrame, id_col: str = "vec_id") -> DataFrame:
    """(query_id, ids, documents, distances) as lists in rank order."""
    both = found.join(docs.select(F.col("id").alias(id_col), "document"), id_col)
    rows = F.array_sort(F.collect_list(F.struct("rank", F.col(id_col).alias("id"), "document", "distance")))
    out = both.groupBy("query_id").agg(rows.alias("r"))
    return out.select("query_id", F.col("r.id").alias("ids"), F.col("r.document").alias("documents"), F.col("r.distance").alias("distances"))
