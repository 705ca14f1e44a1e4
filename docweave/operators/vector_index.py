"""A stored vector index: inverted lists by a coarse quantiser, searched by probes.

Centroids are fitted by k-means on a bounded sample; every vector is then put on
its nearest centroid's list, and lists are stored in folders of their own. A
search compares a query with the lists of its nearest centroids (``probes``) and
opens no other folder. ``calibrated_probes`` measures how many are needed for a
recall; ``exact`` goes on to all lists that may still hold a nearer vector, by
each list's radius, so that its rows are those of a search over everything.

Neighbouring lists make a shelf; there are at most ``SHELVES`` whatever the number
of rows. A query goes once to each shelf that it needs, with the numbers of its
lists there, so what a search shuffles follows the rows and the queries, not
queries times lists; blocks of queries and vectors meet in a join of both by
shelf, which is never broadcast: repeated vectors make them look small on disk.

Vectors that are null or hold null entries take no part; all others have one length.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.operators.vector import BLOCK, _block, nearest_of
from docweave.sources import store

#: Rows that the centroids are fitted on, and lists, at most.
FIT_ROWS, MAX_LISTS = 20_000, 4096
#: Rounds of k-means.
ROUNDS = 10
#: Runs of lists that a query is sent to once, at most.
SHELVES = 64
_SHELVED = "shelf int, id long, vector array<double>, lists array<int>"


@dataclass
class VectorIndex:
    """Stored lists (id, vector, distance, list), and the centroids in the order of their lists."""

    lists: DataFrame
    centres: np.ndarray
    numbers: np.ndarray
    radius: np.ndarray
    rows: np.ndarray

    @property
    def shelf(self) -> np.ndarray:
        """The lists' shelves, of about as many rows each."""
        before = np.cumsum(self.rows) - self.rows
        return (before * SHELVES // max(int(self.rows.sum()), 1)).astype(np.int32)


def _rows(column: pa.Array) -> np.ndarray:
    return np.asarray(column.flatten(), "<f8").reshape(len(column), -1)


def _gaps(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Squared distances of rows and centres, in the fast form."""
    return np.maximum((x**2).sum(axis=1)[:, None] + (centres**2).sum(axis=1)[None, :] - 2 * x @ centres.T, 0.0)


def k_means(x: np.ndarray, lists: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centres of the rows of ``x``: the first rows to begin with, then Lloyd's rounds."""
    centres = np.unique(x[:lists], axis=0)
    for _ in range(rounds):
        near = np.concatenate([_gaps(x[lo : lo + BLOCK], centres).argmin(axis=1) for lo in range(0, len(x), BLOCK)])
        order = np.argsort(near, kind="stable")
        found, first = np.unique(near[order], return_index=True)
        centres = np.add.reduceat(x[order], first, axis=0) / np.diff(np.append(first, len(x)))[:, None]
    return centres


def _fitted(lists: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_rows(b.column(0)) for b in batches if b.num_rows]
        if parts:
            centres = k_means(np.concatenate(parts), lists)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(centres), dtype=np.int32)), pa.array(list(centres), pa.list_(pa.float64()))], names=["list", "centre"])

    return run


def _assigned(centres: np.ndarray):
    """(id, vector, distance, list) of rows (id, vector)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = _rows(part.column(1))
                near = _gaps(x, centres).argmin(axis=1).astype(np.int32)
                far = np.sqrt(((x - centres[near]) ** 2).sum(axis=1))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(far), pa.array(near)], names=["id", "vector", "distance", "list"])

    return run


def _vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vector = F.col(vec_col).cast("array<double>")
    return df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector")).where(F.coalesce(F.forall("vector", lambda x: x.isNotNull()), F.lit(False)))


def build_index(vectors: DataFrame, path: str, lists: int | None = None, fit_rows: int = FIT_ROWS, id_col: str = "vec_id", vec_col: str = "embedding") -> VectorIndex:
    """Fits the centroids, stores the lists at ``path`` and returns the index;
    there are the square root of the rows' number of lists if it isn't given."""
    spark, rows = vectors.sparkSession, _vectors(vectors, id_col, vec_col)
    lists = lists or min(MAX_LISTS, max(1, round(math.sqrt(rows.count()))))
    sample = rows.orderBy(F.xxhash64("id", "vector")).limit(fit_rows).select("vector")
    centres = sample.coalesce(1).mapInArrow(_fitted(lists), "list int, centre array<double>").orderBy("list").toPandas()
    centres = np.stack(centres["centre"]) if len(centres) else np.zeros((0, 0))
    placed = rows.mapInArrow(_assigned(centres), "id long, vector array<double>, distance double, list int")
    # A list that holds most rows goes to several files.
    store.write_table(placed.hint("rebalance", "list"), f"{path}/lists", partition_by=["list"])
    stored = spark.read.parquet(f"{path}/lists") if len(centres) else spark.createDataFrame([], "id long, vector array<double>, distance double, list int")
    sizes = stored.groupBy("list").agg(F.max("distance").alias("radius"), F.count("*").alias("rows"))
    table = spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "list int, centre array<double>")
    store.write_table(table.join(sizes, "list").coalesce(1), f"{path}/centres")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> VectorIndex:
    """A stored index; lists that no vector is on are left out."""
    table = spark.read.parquet(store.first_existing(spark, f"{path}/centres")).orderBy("list").toPandas()
    centres = np.stack(table["centre"]) if len(table) else np.zeros((0, 0))
    kind = "id long, vector array<double>, distance double, list int"
    lists = spark.read.schema(kind).parquet(f"{path}/lists") if len(table) else spark.createDataFrame([], kind)
    return VectorIndex(lists, centres, table["list"].to_numpy(np.int32), table["radius"].to_numpy(float), table["rows"].to_numpy(np.int64))


def _probed(index: VectorIndex, probes: int, within: bool):
    """(shelf, id, vector, lists): each query once for each shelf with lists that it
    is compared with: its nearest ``probes``, or, with ``within``, the others that may
    hold a vector nearer than its ``most``."""
    centres, numbers, radius, shelf = index.centres, index.numbers, index.radius, index.shelf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK):
                part = batch.slice(lo, BLOCK)
                x = _rows(part.column(1))
                gaps = _gaps(x, centres)
                order = np.argsort(gaps, axis=1, kind="stable")
                ok = np.zeros(gaps.shape, bool)
                np.put_along_axis(ok, order[:, :probes], True, axis=1)
                if within:
                    most = np.sqrt(part.column(2).to_numpy(zero_copy_only=False))
                    # The fast form of a distance is off by what its norms lose.
                    norms = (x**2).sum(axis=1) + (centres**2).sum(axis=1).max(initial=0.0)
                    slack = 1e-9 * (most + np.sqrt(norms)) + 8 * np.sqrt(np.finfo(float).eps * x.shape[1] * norms)
                    ok = ~ok & (np.sqrt(gaps) - radius[None, :] <= (most + slack)[:, None])
                for one in np.unique(shelf):
                    here = np.flatnonzero(shelf == one)
                    part_ok = ok[:, here]
                    row = np.flatnonzero(part_ok.any(axis=1))
                    ends = np.concatenate([[0], np.cumsum(part_ok[row].sum(axis=1))]).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(numbers[here[np.nonzero(part_ok[row])[1]]]))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(row), one, np.int32)), part.column(0).take(take), part.column(1).take(take), lists], names=["shelf", "id", "vector", "lists"])

    return run


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shelf, ids, block, ends, lists): rows (shelf, id, vector, lists) in blocks
    of one shelf each; ``lists`` one after another, each row's up to its end."""
    for batch in batches:
        at = np.asarray(batch.column(0))
        order = np.argsort(at, kind="stable")
        batch, at = batch.take(pa.array(order)), at[order]
        cuts = np.flatnonzero(np.diff(at)) + 1
        for start, end in zip([0, *cuts], [*cuts, len(at)], strict=True):
            for lo in range(start, end, BLOCK):
                part = batch.slice(lo, min(BLOCK, end - lo))
                ends = np.cumsum(np.asarray(pa.compute.list_value_length(part.column(3)))).astype(np.int32)
                one = [pa.array([int(at[lo])], pa.int32()), *(pa.array([v], pa.list_(t)) for v, t in ((np.asarray(part.column(1)), pa.int64()), (ends, pa.int32()), (np.asarray(part.column(3).flatten()), pa.int32())))]
                yield pa.RecordBatch.from_arrays([*one, pa.array([_rows(part.column(2)).tobytes()], pa.binary())], names=["shelf", "ids", "ends", "lists", "block"])


_BLOCKS = "shelf int, ids array<long>, ends array<int>, lists array<int>, block binary"


def _shelved(index: VectorIndex):
    """Rows (list, id, vector) as :func:`_packed` takes them."""
    numbers, shelf = index.numbers, index.shelf

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = np.asarray(batch.column(0)).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32)), pa.array(own))
            yield pa.RecordBatch.from_arrays([pa.array(shelf[np.searchsorted(numbers, own)]), batch.column(1), batch.column(2), lists], names=["shelf", "id", "vector", "lists"])

    return lambda batches: _packed(run(batches))


def _nearest_listed(k: int):
    """(query_id, id, distance): the k nearest of each query in a batch, of those on its lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for row in range(batch.num_rows):
                ends, asked, own = (np.asarray(batch.column(i)[row].values) for i in (2, 3, 6))
                lists, at = np.unique(own, return_inverse=True)
                place = np.minimum(np.searchsorted(lists, asked), len(lists) - 1)
                on = lists[place] == asked
                ok = np.zeros((len(ends), len(lists)), bool)
                ok[np.searchsorted(ends, np.flatnonzero(on), side="right"), place[on]] = True
                some = ok.any(axis=1)
                if some.any():
                    q_ids, q = _block(batch, row, 0, 1)
                    found.append(nearest_of(q_ids[some], q[some], *_block(batch, row, 4, 5), k, ok[some][:, at]))
            if found:
                q_ids, ids, gaps = (np.concatenate(x) for x in zip(*found, strict=True))
                order = np.lexsort((ids, gaps, q_ids))
                q_ids, ids, gaps = q_ids[order], ids[order], gaps[order]
                best = np.arange(len(q_ids)) - np.searchsorted(q_ids, q_ids) < k
                yield pa.RecordBatch.from_arrays([pa.array(x[best]) for x in (q_ids, ids, gaps)], names=["query_id", "id", "distance"])

    return run


def _compared(asked: DataFrame, index: VectorIndex, k: int) -> DataFrame:
    """(query_id, id, distance): at least the k nearest of each query (shelf, id,
    vector, lists) in its lists; only folders of lists that are asked for are read."""
    asked = store.keep(asked, "probes")
    wanted = [r[0] for r in asked.select(F.explode("lists")).distinct().collect()]  # MAX_LISTS numbers at most
    q = asked.hint("rebalance", "shelf").mapInArrow(_packed, _BLOCKS).select("shelf", F.col("ids").alias("q_ids"), F.col("block").alias("q_block"), "ends", F.col("lists").alias("asked"))
    x = index.lists.where(F.col("list").isin(wanted)).select("list", "id", "vector").mapInArrow(_shelved(index), _BLOCKS).drop("ends")
    both = x.join(q.hint("merge"), "shelf").select("q_ids", "q_block", "ends", "asked", "ids", "block", "lists")
    return both.mapInArrow(_nearest_listed(k), "query_id long, id long, distance double")


def _best(found: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(queries: DataFrame, index: VectorIndex, k: int = 5, probes: int = 8, exact: bool = False, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): the k nearest found for each query, by
    squared distance, ties by id."""
    asked = _vectors(queries, id_col, vec_col)
    if not len(index.numbers):
        return asked.sparkSession.createDataFrame([], f"query_id long, rank int, {id_col} long, distance double")
    found = _compared(asked.mapInArrow(_probed(index, probes, False), _SHELVED), index, k)
    if exact:
        found = store.keep(_best(found, k).select("query_id", "id", "distance"), "probed")
        most = found.groupBy("query_id").agg(F.when(F.count("*") >= k, F.max("distance")).otherwise(float("inf")).alias("most"))
        rest = asked.join(most, F.col("id") == F.col("query_id"), "left").select("id", "vector", F.coalesce("most", F.lit(float("inf"))).alias("most"))
        found = found.union(_compared(rest.mapInArrow(_probed(index, probes, True), _SHELVED), index, k))
    return _best(found, k).select("query_id", "rank", F.col("id").alias(id_col), "distance")


def _rank_of(index: VectorIndex):
    """(place): how many lists are nearer to a query (vector, list) than the given one."""
    centres, numbers = index.centres, index.numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                gaps = _gaps(_rows(batch.column(0)), centres)
                own = np.searchsorted(numbers, np.asarray(batch.column(1)))
                place = (gaps < gaps[np.arange(len(own)), own][:, None]).sum(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(place.astype(np.int64))], names=["place"])

    return run


def calibrated_probes(index: VectorIndex, recall: float = 0.95, k: int = 10, queries: int = 256) -> int:
    """The fewest probes with which ``recall`` of the k nearest others of a
    bounded sample of stored vectors are on a probed list."""
    sample = store.keep(index.lists.orderBy(F.xxhash64("id")).limit(queries).select(F.col("id").alias("vec_id"), F.col("vector").alias("embedding")), "sample")
    near = search(sample, index, k + 1, exact=True).where("vec_id <> query_id").select("query_id", F.col("vec_id").alias("id"))
    near = store.keep(near, "near")
    placed = index.lists.select("id", "list").join(store.maybe_broadcast(near, 16), "id").join(sample.withColumnRenamed("vec_id", "query_id"), "query_id")
    place = placed.select("embedding", "list").mapInArrow(_rank_of(index), "place long").agg(F.percentile("place", recall)).first()[0]
    return 1 if place is None else min(math.ceil(place) + 1, max(len(index.numbers), 1))


def share_compared(queries: DataFrame, index: VectorIndex, probes: int, id_col: str = "vec_id", vec_col: str = "embedding") -> float:
    """The share of all pairs of queries and vectors that a search compares."""
    if not len(index.numbers):
        return 0.0
    rows: Column = F.element_at(F.array(*[F.lit(int(n)) for n in index.rows]), F.array_position(F.array(*[F.lit(int(n)) for n in index.numbers]), F.col("list")).cast("int"))
    asked = _vectors(queries, id_col, vec_col)
    pairs = asked.mapInArrow(_probed(index, probes, False), _SHELVED).select(F.explode("lists").alias("list")).agg(F.sum(rows)).first()[0] or 0
    return pairs / max(asked.count() * int(index.rows.sum()), 1)
