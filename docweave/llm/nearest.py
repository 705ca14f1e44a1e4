"""Approximate nearest neighbours by inner product: a navigable small-world graph
of several layers for each shard, shard results merged.

Equal vectors are one node. A node carries its least k + 1 ids: ties go to
smaller ids and a query leaves out only its own, so no other id of a node can
be among a query's k nearest. Nodes are dealt by hash to shards; each shard's
graph is built in one task and stored as a row of flat arrays. Shards grow with
the root of the number of nodes, from SHARD_ROWS to MOST_ROWS: a query walks
through every shard, so as many of them as rows would make the search grow with
the square of the table.

Graph: vectors are scaled to the shard's longest one and get one more component
that makes all of them equally long, so the largest inner product is the
smallest distance. A node's level is drawn from its hash, and nodes are put in
the order of their levels, so each layer is a prefix. A node's candidates in a
layer are its nearest in the whole layer and in shrinking prefixes of it (as a
graph that grows by insertion would have met them), taken from blocks of matrix
products; of these it keeps those that are nearer to it than to any one kept
before, and every link is offered to its other end by the same rule.

Search: blocks of query vectors meet each shard; a beam goes down the layers,
widest in the lowest one, for all queries of a block at once. What it ends with
is scored again on the original vectors in double precision, summed from left to
right, so equal vectors have equal scores. Query blocks times shards is what a
search costs: it grows to the power 1.5 of the rows, and with their square from
about a million on, where shards are as large as a task may hold; larger ones
lower it (``shard_rows``).

Defined cases: vectors that are null, empty or zero, or hold null or non-finite
components, and rows with a null id take no part; vectors are compared with
those of their own length only; rows of one id count once, with the least
vector; infinite scores are kept, undefined ones (infinities that cancel) are
not; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import BROADCAST_BYTES, keep, maybe_broadcast

#: Nodes of a shard, about: at least, for each node of the table under the root, and at most, a bound
#: of what one task holds and of the products that its graph takes.
SHARD_ROWS, ROOTED, MOST_ROWS = 8192, 4096, 65536
#: Links of a node in an upper layer; twice as many in the lowest.
LINKS = 16
#: Candidates from the whole layer, and from each shrinking prefix.
NEAR, FAR = 48, 8
#: Width of the beam in the lowest layer and in the others; nodes opened in one step, an eighth of the beam at most.
BEAM, NARROW, STEP = 256, 8, 16
#: Query vectors of a block, rows of a product, and numbers that one gathers at most.
BLOCK, ROWS, GATHERED = 256, 1024, 1 << 23
_SHARD = "dim int, shard int, n int, vectors binary, ids array<long>, ends array<int>, sizes array<int>, links array<binary>"


def usable(vector: Column) -> Column:
    """Whether a vector takes part."""
    wide = vector.cast("array<double>")
    finite = F.forall(wide, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(finite & F.exists(wide, lambda x: x != 0), F.lit(False))


def _slices(n: int, most: int, width: int) -> Iterator[tuple[int, int]]:
    """Runs of up to ``most`` rows that gather ``width`` numbers each."""
    step = max(1, min(most, GATHERED // max(width, 1)))
    return ((lo, min(lo + step, n)) for lo in range(0, n, step))


# --- graph of a shard ---


def _rounded(vectors: np.ndarray) -> np.ndarray:
    """Scaled to at most 1 and filled up to equal length, in single precision."""
    top = np.abs(vectors).max(initial=0.0) or 1.0
    x = vectors / top
    size = (x**2).sum(axis=1)
    x = np.column_stack([x, np.sqrt(np.maximum(size.max(initial=0.0) - size, 0.0))])
    return (x / np.sqrt(size.max(initial=0.0) or 1.0)).astype(np.float32)


def _thinned(x: np.ndarray, own: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
    """For each node of ``own`` up to ``most`` of its candidates ``near`` (-1:
    none), nearest first: one that is nearer to a kept candidate than to the
    node gives way; places left are filled with the nearest of those."""
    sim = np.where(near >= 0, np.matmul(x[near], x[own][:, :, None])[:, :, 0], -np.inf)
    order = np.argsort(-sim, axis=1, kind="stable")
    near, sim = np.take_along_axis(near, order, 1), np.take_along_axis(sim, order, 1)
    twice = np.zeros(near.shape, bool)
    ranked = np.sort(near, axis=1)
    if (ranked[:, 1:] == ranked[:, :-1]).any():  # equal candidates: the first stays
        for j in range(1, near.shape[1]):
            twice[:, j] = (near[:, :j] == near[:, j : j + 1]).any(axis=1)
    among = np.matmul(x[near], x[near].transpose(0, 2, 1))
    kept, full = np.zeros(near.shape, bool), np.zeros(len(own), int)
    open_ = (near >= 0) & ~twice
    for j in range(near.shape[1]):
        hidden = (kept & (among[:, j, :] > sim[:, j : j + 1])).any(axis=1)
        kept[:, j] = open_[:, j] & ~hidden & (full < most)
        full += kept[:, j]
    turn = np.where(kept, 0, np.where(open_, 1, 2))
    best = np.argsort(turn, axis=1, kind="stable")[:, :most]
    out = np.where(np.take_along_axis(turn, best, 1) < 2, np.take_along_axis(near, best, 1), -1)
    return np.pad(out, ((0, 0), (0, most - out.shape[1])), constant_values=-1).astype(np.int32)


def _candidates(x: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """Candidates of the nodes lo to hi: nearest in the layer and in prefixes of it."""
    sim = x[lo:hi] @ x.T
    sim[np.arange(hi - lo), np.arange(lo, hi)] = -np.inf
    found, size, take = [], len(x), NEAR
    while size > 1:
        take = min(take, size - 1)
        part = sim[:, :size]
        at = np.argpartition(-part, take - 1, axis=1)[:, :take]
        found.append(np.where(np.isneginf(np.take_along_axis(part, at, 1)), -1, at))
        size, take = size // 4, FAR
    return np.concatenate(found, axis=1) if found else np.full((hi - lo, 1), -1)


def layer_links(x: np.ndarray, most: int) -> np.ndarray:
    """The links of a layer of nodes ``x``: a row of ``most`` places for each, -1 where free."""
    n, dim = x.shape
    out = np.full((n, most), -1, np.int32)
    for lo, hi in _slices(n, ROWS, max(2 * NEAR * dim, n)):
        out[lo:hi] = _thinned(x, np.arange(lo, hi), _candidates(x, lo, hi), most)
    # Every link is offered to its other end.
    start, place = np.nonzero(out >= 0)
    end = out[start, place]
    sim = np.zeros(len(start), np.float32)
    for lo, hi in _slices(len(start), len(start), 2 * dim):
        sim[lo:hi] = np.einsum("ij,ij->i", x[start[lo:hi]], x[end[lo:hi]])
    order = np.lexsort((start, -sim, end))
    start, end = start[order], end[order]
    first = np.searchsorted(end, np.arange(n))
    rank = np.arange(len(end)) - first[end]
    offered = np.full((n, 2 * most), -1, np.int32)
    offered[end[rank < 2 * most], rank[rank < 2 * most]] = start[rank < 2 * most]
    both = np.concatenate([out, offered], axis=1)
    for lo, hi in _slices(n, ROWS, 3 * most * dim):
        out[lo:hi] = _thinned(x, np.arange(lo, hi), both[lo:hi], most)
    return out


def layer_sizes(levels: np.ndarray) -> list[int]:
    """Nodes of each layer, from the lowest up, of nodes in falling order of level."""
    return [int((levels >= k).sum()) for k in range(int(levels.max(initial=0)) + 1)]


def _beam(x: np.ndarray, links: np.ndarray, asked: np.ndarray, enter: np.ndarray, width: int) -> np.ndarray:
    """For each row of ``asked`` the ``width`` nodes (-1: none) that a best-first
    walk from the nodes ``enter`` ends with."""
    n, rows = len(x), len(asked)
    at = np.full((rows, width), -1, np.int32)
    enter = enter[:, :width]
    at[:, : enter.shape[1]] = enter
    sim = np.where(at >= 0, np.matmul(x[at], asked[:, :, None])[:, :, 0], -np.inf).astype(np.float32)
    opened = at < 0
    seen = np.zeros((rows, n + 1), bool)  # the last column takes what is no node
    seen[np.arange(rows)[:, None], at] = True
    seen[:, n] = True
    stamp = np.zeros(rows * (n + 1), np.int32)
    live = np.arange(rows)
    while len(live):
        score = np.where(opened[live], -np.inf, sim[live])
        pick = np.argpartition(-score, min(STEP, width) - 1, axis=1)[:, : max(1, min(STEP, width // 8))]
        real = ~np.isneginf(np.take_along_axis(score, pick, 1))
        going = real.any(axis=1)
        live, pick, real = live[going], pick[going], real[going]
        if not len(live):
            break
        opened[live[:, None], pick] = True
        chosen = np.where(real, at[live[:, None], pick], 0)
        new = np.where(real[:, :, None], links[chosen], -1).reshape(len(live), -1)
        new = np.where(new < 0, n, new)
        # Nodes that a row has not seen, each once, moved to its left end.
        q, c = np.nonzero(~seen[live[:, None], new])
        node = new[q, c]
        key, turn = live[q] * (n + 1) + node, np.arange(len(q), dtype=np.int32)
        stamp[key] = turn
        once = stamp[key] == turn
        q, node = q[once], node[once]
        seen[live[q], node] = True
        place = np.arange(len(q)) - np.searchsorted(q, q)
        new = np.zeros((len(live), max(int(place.max(initial=0)) + 1, 1)), np.int32)
        fresh = np.zeros(new.shape, bool)
        new[q, place], fresh[q, place] = node, True
        near = np.where(fresh, np.matmul(x[new], asked[live][:, :, None])[:, :, 0], -np.inf).astype(np.float32)
        all_sim = np.concatenate([sim[live], near], axis=1)
        all_at = np.concatenate([at[live], np.where(fresh, new, -1)], axis=1)
        all_open = np.concatenate([opened[live], ~fresh], axis=1)
        best = np.argpartition(-all_sim, width - 1, axis=1)[:, :width]
        sim[live], at[live], opened[live] = (np.take_along_axis(a, best, 1) for a in (all_sim, all_at, all_open))
    return at


def walk(x: np.ndarray, sizes: list[int], links: list[np.ndarray], asked: np.ndarray, width: int) -> np.ndarray:
    """The nodes that the beam ends with in the lowest layer, for each query."""
    enter = np.tile(np.arange(min(NARROW, sizes[-1]), dtype=np.int32), (len(asked), 1))
    for k in range(len(sizes) - 1, -1, -1):
        enter = _beam(x[: sizes[k]], links[k], asked, enter, min(width if k == 0 else NARROW, sizes[k]))
    return enter


def graph(vectors: np.ndarray, levels: np.ndarray) -> tuple[list[int], list[np.ndarray]]:
    """(sizes, links) of the layers of nodes in falling order of level."""
    x, sizes = _rounded(vectors), layer_sizes(levels)
    return sizes, [layer_links(x[:n], LINKS if k else 2 * LINKS) for k, n in enumerate(sizes)]


def _levels(draws: np.ndarray) -> np.ndarray:
    """Levels from hashes: each holds a LINKS-th of the one below."""
    u = (draws.astype(np.uint64) >> np.uint64(11)).astype(float) / float(1 << 53)
    return np.floor(-np.log(np.maximum(u, 2.0**-53)) / np.log(LINKS)).astype(int)


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A column of lists of one length as rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), "<f8").reshape(len(column), -1)


def _built(table: pa.Table) -> pa.Table:
    """A shard's row from its nodes (dim, shard, k1, k2, vector, ids)."""
    draws = table.column("k2").to_numpy().astype(np.int64)
    levels = _levels(draws)
    order = np.lexsort((table.column("k1").to_numpy(), draws, -levels))
    table, levels = table.take(pa.array(order)), levels[order]
    vectors = _matrix(table.column("vector"))
    sizes, links = graph(vectors, levels)
    ids = table.column("ids").combine_chunks()
    ends = np.cumsum(np.asarray(pa.compute.list_value_length(ids)))
    row = {
        "dim": table.column("dim")[0].as_py(), "shard": table.column("shard")[0].as_py(), "n": len(vectors), "vectors": vectors.tobytes(),
        "ids": np.asarray(ids.flatten()), "ends": ends.astype(np.int32), "sizes": sizes, "links": [a.astype("<i4").tobytes() for a in links],
    }
    types = [pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.binary())]
    return pa.Table.from_arrays([pa.array([row[c]], t) for c, t in zip(row, types, strict=True)], names=list(row))


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks (dim, keys, block) of query vectors (k1, k2, vector) of one length."""
    for batch in batches:
        size = np.asarray(pa.compute.list_value_length(batch.column(2)))
        for dim in np.unique(size):
            rows = np.flatnonzero(size == dim)
            for lo in range(0, len(rows), BLOCK):
                part = batch.take(pa.array(rows[lo : lo + BLOCK]))
                keys = np.column_stack([part.column(0).to_numpy(), part.column(1).to_numpy()]).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(dim)], pa.int32()), pa.array([keys], pa.list_(pa.int64())), pa.array([_matrix(part.column(2)).tobytes()], pa.binary())], names=["dim", "keys", "block"]
                )


def exact_scores(asked: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products of rows asked (q, d) and vectors (q, c, d), summed from left to right."""
    out = np.zeros(vectors.shape[:2])
    with np.errstate(over="ignore", invalid="ignore"):
        for j in range(asked.shape[1]):
            out += asked[:, j, None] * vectors[:, :, j]
    return out


def _best_ids(asked, vectors, x, sizes, links, ids, ends, most: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of asked, id, score): up to ``most`` ids for each row, best first."""
    unit = asked / np.abs(asked).max(axis=1, keepdims=True)
    at = walk(x, sizes, links, np.column_stack([unit, np.zeros(len(unit))]).astype(np.float32), width)
    score = np.where(at >= 0, exact_scores(asked, vectors[at]), np.nan)
    # Nodes become their ids; the best of each query stay.
    starts = np.concatenate([[0], ends[:-1]])
    q, c = np.nonzero(~np.isnan(score))
    node, s = at[q, c], score[q, c]
    count = ends[node] - starts[node]
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    found = ids[np.repeat(starts[node], count) + inside]
    q, s = np.repeat(q, count), np.repeat(s, count)
    order = np.lexsort((found, -s, q))
    q, s, found = q[order], s[order], found[order]
    ok = np.arange(len(q)) - np.searchsorted(q, q) < most
    return q[ok], found[ok], s[ok]


def _searched(most: int, width: int):
    """(k1, k2, id, score): up to ``most`` ids of a shard for each query of a block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, x = None, None
        for batch in batches:
            for r in range(batch.num_rows):
                row = {name: batch.column(i)[r] for i, name in enumerate(batch.schema.names)}
                n, dim = row["n"].as_py(), row["dim"].as_py()
                vectors = np.frombuffer(row["vectors"].as_buffer(), "<f8").reshape(n, dim)
                if held != (dim, row["shard"].as_py()):
                    held, x = (dim, row["shard"].as_py()), _rounded(vectors)
                sizes = row["sizes"].as_py()
                links = [np.frombuffer(b.as_buffer(), "<i4").reshape(s, -1) for b, s in zip(row["links"], sizes, strict=True)]
                keys = np.asarray(row["keys"].values).reshape(-1, 2)
                asked = np.frombuffer(row["block"].as_buffer(), "<f8").reshape(len(keys), dim)
                ids, ends = np.asarray(row["ids"].values), np.asarray(row["ends"].values)
                for lo, hi in _slices(len(keys), BLOCK, max(width * dim, n)):
                    q, found, s = _best_ids(asked[lo:hi], vectors, x, sizes, links, ids, ends, most, width)
                    yield pa.RecordBatch.from_arrays([pa.array(a) for a in (keys[lo + q, 0], keys[lo + q, 1], found, s)], names=["k1", "k2", "id", "score"])

    return run


# --- whole run ---


def _vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vector, k1, k2): one row for each id; the keys are two hashes of the vector."""
    wide = F.transform(F.col(vec_col).cast("array<double>"), lambda x: F.when(x == 0, F.lit(0.0)).otherwise(x))
    each = rows.where(usable(F.col(vec_col)) & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), wide.alias("vector"))
    one = each.groupBy("id").agg(F.min("vector").alias("vector"))
    return one.select("id", "vector", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2"))


def rows_of_shards(n: int) -> int:
    """Nodes of a shard, about, of a table of ``n``."""
    return min(max(SHARD_ROWS, math.isqrt(ROOTED * n)), MOST_ROWS)


def build_index(vectors: DataFrame, k: int, shard_rows: int | None = None) -> DataFrame:
    """The kept shards of vectors (id, vector, k1, k2)."""
    # A node's least ids; the limit is applied before the shuffle too.
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    least = vectors.withColumn("place", place).where(F.col("place") <= k + 1)
    vector = F.min(F.when(F.col("place") == 1, F.col("vector"))).alias("vector")
    nodes = least.groupBy("k1", "k2").agg(vector, F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = keep(nodes.withColumn("dim", F.size("vector")), "nodes")
    n = nodes.count()
    shards = -(-n // (shard_rows or rows_of_shards(n))) or 1
    dealt = nodes.withColumn("shard", F.pmod("k1", F.lit(shards)).cast("int")).select("dim", "shard", "k1", "k2", "vector", "ids")
    return keep(dealt.groupBy("dim", "shard").applyInArrow(_built, _SHARD), "shards")


def search(queries: DataFrame, shards: DataFrame, k: int, width: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for queries (id,
    vector, k1, k2), each without its own id."""
    asked = queries.groupBy("k1", "k2").agg(F.min("vector").alias("vector"))
    blocks = asked.mapInArrow(_packed, "dim int, keys array<long>, block binary")
    numbers = shards.groupBy("dim").agg(F.collect_list("shard").alias("shard"))
    numbers = F.broadcast(numbers) if 8 * shards.count() <= BROADCAST_BYTES else numbers
    met = blocks.join(numbers, "dim").withColumn("shard", F.explode("shard"))
    met = met.join(shards, ["dim", "shard"])
    found = met.select("dim", "shard", "n", "vectors", "ids", "ends", "sizes", "links", "keys", "block").mapInArrow(_searched(k + 1, width), "k1 long, k2 long, id long, score double")
    place = F.row_number().over(Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "id"))
    best = found.withColumn("place", place).where(F.col("place") <= k + 1)
    lists = keep(best.groupBy("k1", "k2").agg(F.sort_array(F.collect_list(F.struct("place", F.col("id").alias("vec_id"), "score"))).alias("best")), "found")
    # Many queries may share a vector: its list meets them where it is broadcast, or in a join that AQE splits.
    own = queries.select("id", "k1", "k2").join(maybe_broadcast(lists, 64 + 24 * (k + 1)), ["k1", "k2"])
    others = F.slice(F.filter("best", lambda b: b["vec_id"] != F.col("id")), 1, k)
    each = own.select(F.col("id").alias("query_id"), F.posexplode(others).alias("at", "one"))
    return each.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("one.vec_id").alias("vec_id"), F.col("one.score").alias("score"))


def nearest(rows: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding", shard_rows: int | None = None, width: int = BEAM) -> DataFrame:
    """(query_id, rank, vec_id, score): for the rows that ``is_query`` marks (by
    ``id``), the k nearest found among all other rows."""
    vectors = keep(_vectors(rows, id_col, vec_col), "vectors")
    return search(vectors.where(is_query), build_index(vectors, k, shard_rows), k, width)


#: The query's rows in SQL, by comparing every pair; where a shard holds the whole table and the beam most of it, the graph finds them all.
ORACLE_SQL = """
with v as (select vec_id, list_transform(embedding, lambda x: cast(x as double)) as e from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0),
s as (select q.vec_id as query_id, c.vec_id, list_reduce(list_transform(list_zip(q.e, c.e), lambda z: z[1] * z[2]), lambda a, b: a + b) as score
  from v q, v c where q.vec_id % 20 = 0 and q.vec_id <> c.vec_id and len(q.e) = len(c.e)),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= 20"""
