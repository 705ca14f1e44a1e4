"""Nearest neighbours and whitening against plain numpy over all rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from docweave.llm import nearest, whitening


def table(spark, rows):
    """rows (id, vector or None), with columns whose names an operator might use."""
    rows = [(i, v if v is None else [None if x is None else float(x) for x in v], 1, "x") for i, v in rows]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, shard int, score string")


def brute(rows, k, every):
    """The k nearest of each query by sorting all candidates; one row for each id."""
    least = {}
    for i, v in rows:
        if i is not None and v and None not in v and np.isfinite(v).all() and any(v):
            least[i] = min(least.get(i, list(v)), list(v))
    out = {}
    for i, q in least.items():
        if i % every == 0:
            scored = []
            for j, v in least.items():
                if j != i and len(v) == len(q):
                    s = 0.0
                    for a, b in zip(q, v, strict=True):
                        s += a * b
                    scored.append((-s, j))
            out[i] = [(j, -s) for s, j in sorted(scored)[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


@pytest.mark.parametrize("unit", [True, False])
def test_recall_over_several_shards(spark, unit):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 24)) + 2 * rng.normal(size=(12, 24))[rng.integers(0, 12, 3000)]
    x = x / np.linalg.norm(x, axis=1, keepdims=True) if unit else x * rng.uniform(0.2, 3, (3000, 1))
    rows = [(i, v) for i, v in enumerate(x.tolist())]
    got = found(nearest.nearest(table(spark, rows).repartition(5), F.col("id") % 20 == 0, 20, shard_rows=900))
    want = brute(rows, 20, 20)
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    same = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert same >= 0.97 * 20 * len(want)
    for q, pairs in got.items():
        assert q not in {j for j, _ in pairs}
        exact = dict(brute([(q, rows[q][1]), *[(j, rows[j][1]) for j, _ in pairs]], 99, 1)[q])
        assert all(exact[j] == s for j, s in pairs)
        assert pairs == sorted(pairs, key=lambda p: (-p[1], p[0]))


def test_near_copies_and_outliers_are_reached(spark):
    rng = np.random.default_rng(4)
    centre = rng.normal(size=16)
    close = centre + 1e-3 * rng.normal(size=(1500, 16))
    rows = [(i, v) for i, v in enumerate(np.concatenate([close, rng.normal(size=(700, 16))]).tolist())]
    got, want = found(nearest.nearest(table(spark, rows), F.col("id") % 20 == 0, 20, shard_rows=4000)), brute(rows, 20, 20)
    same = sum(len({j for j, _ in got[q]} & {j for j, _ in want[q]}) for q in want)
    assert same >= 0.95 * 20 * len(want)


def test_defined_cases_of_a_search(spark):
    one, two = [1.0, 0.0, 0.5], [0.0, 2.0, 0.0]
    rows = [(i, one) for i in range(60)] + [(100 + i, two) for i in range(3)]
    rows += [(20, one), (7, [9.0, 9.0, 9.0]), (200, None), (201, []), (202, [0.0, 0.0, 0.0]), (203, [1.0, None, 1.0]), (204, [float("nan"), 1.0, 1.0]), (205, [float("inf"), 1.0, 1.0])]
    rows += [(None, one), (300, [1.0, 1.0]), (301, [-1.0, 3.0]), (400, [5.0]), (60, [-0.0, -1.0, 0.0]), (61, [0.0, -1.0, 0.0])]
    got, want = found(nearest.nearest(table(spark, rows), F.col("id") % 20 == 0, 20)), brute(rows, 20, 20)
    assert got == {q: v for q, v in want.items() if v}  # a lone vector of its length finds none
    assert [j for j, _ in got[0]] == list(range(1, 21)) and [j for j, _ in got[40]] == list(range(20))
    assert [j for j, _ in got[300]] == [301]
    again = found(nearest.nearest(table(spark, rows).repartition(7), F.col("id") % 20 == 0, 20))
    assert again == got


def test_shards_grow_slower_than_the_table(spark):
    # Every query walks through every shard: from 10,256 to 51,282 vectors there were 2 and 7 of them.
    shards = {n: -(-n // nearest.rows_of_shards(n)) for n in (500, 10_256, 51_282, 205_128, 820_512)}
    assert shards == {500: 1, 10_256: 2, 51_282: 4, 205_128: 8, 820_512: 15}
    assert nearest.rows_of_shards(10**9) == nearest.MOST_ROWS
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(33_000, 4)).tolist())]
    index = nearest.build_index(nearest._vectors(table(spark, rows), "vec_id", "embedding"), 5).select("shard", "n").collect()
    assert len(index) == 3 and sum(r.n for r in index) == 33_000  # of about 11,626; there were 5


def test_a_walk_sees_each_node_once():
    # Many of a step's nodes share neighbours: the beam still ends with different nodes, and the nearest ones.
    rng = np.random.default_rng(9)
    v, asked = rng.normal(size=(1500, 12)), rng.normal(size=(40, 12))
    levels = np.sort(rng.geometric(1 - 1 / nearest.LINKS, len(v)) - 1)[::-1]
    sizes, links = nearest.graph(v, levels)
    at = nearest.walk(nearest._rounded(v), sizes, links, np.column_stack([asked, np.zeros(40)]).astype(np.float32), 128)
    assert all(len(set(row[row >= 0])) == (row >= 0).sum() == 128 for row in at)
    best = np.argsort(-(asked @ v.T), axis=1)[:, :20]
    assert sum(len(set(a) & set(b)) for a, b in zip(at, best, strict=True)) >= 0.98 * best.size


def test_empty_tables(spark):
    none = table(spark, [(1, None)])
    assert nearest.nearest(none, F.col("id") % 20 == 0, 20).collect() == []
    assert nearest.nearest(none.where("false"), F.col("id") % 20 == 0, 20).collect() == []
    assert whitening.whiten(none).collect() == [] and whitening.whiten(none.where("false")).collect() == []
    assert whitening.whiten(none).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]


def check_whitening(spark, rows, parts):
    ids, c = [i for i, _ in rows], np.array([v for _, v in rows], float)
    out = whitening.whiten(table(spark, rows).repartition(parts)).collect()
    x = (np.floor(1024 * c) + 100000).astype(object)
    n, s = len(x), x.sum(axis=0)
    deviation = dict(zip(ids, ((n * x - s) ** 2).sum(axis=1), strict=True))
    centred = np.array((n * x - s) / n, float)
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(8, c.shape[1])
    assert len(out) == n * k and {r.n for r in out} == {n} and len({r.identity_error for r in out}) == 1
    at = {i: a for a, i in enumerate(ids)}
    white = np.full((n, k), np.nan)
    for r in out:
        white[at[r.vec_id], r.component - 1] = r.whitened
        assert r.deviation == deviation[r.vec_id]
        assert r.explained == pytest.approx(values[r.component - 1] / values.sum(), rel=1e-9)
    want = centred @ vectors[:, :k] / np.sqrt(values[:k])
    signs = np.sign((white * want).sum(axis=0))
    assert np.allclose(white, want * signs, atol=1e-7)
    error = np.abs(np.cov(white.T, bias=True) - np.eye(k)).max()
    assert error < 1e-9 and abs(out[0].identity_error - error) < 1e-9


@pytest.mark.parametrize("parts", [1, 40])
def test_whitening_equals_an_eigendecomposition(spark, parts):
    rng = np.random.default_rng(5)
    check_whitening(spark, list(enumerate((rng.normal(size=(400, 12)) * np.linspace(0.2, 3, 12)).tolist())), parts)
    check_whitening(spark, list(enumerate((rng.normal(size=(60, 3)) * [5, 1, 0.5] - 7).tolist())), parts)


def test_defined_cases_of_whitening(spark):
    nan, inf = float("nan"), float("inf")
    good = [(None, [1.0, 2.0]), (5, [2.0, 4.0]), (5, [2.0, 4.0]), (6, [-3.0, -6.0])]
    rows = [*good, (7, None), (8, []), (9, [1.0, None]), (10, [nan, 1.0]), (11, [inf, 1.0]), (12, [1e300, 1.0]), (13, [1.0, 2.0, 3.0])]
    out = whitening.whiten(table(spark, rows)).collect()
    assert len(out) == 8 and {r.n for r in out} == {4}
    # The second dimension follows from the first: it has no variance of its own.
    assert {(r.whitened, r.explained) for r in out if r.component == 2} == {(0.0, 0.0)}
    assert {r.explained for r in out if r.component == 1} == {1.0} and out[0].identity_error < 1e-9
    lone = whitening.whiten(table(spark, [(1, [3.0, 4.0])])).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in lone] == [(1, 1, 0, 0.0, 0.0, 0.0), (2, 1, 0, 0.0, 0.0, 0.0)]
    wide = whitening.whiten(table(spark, [(1, [1e12]), (2, [-1e12]), (3, [0.5])])).collect()
    assert [r.deviation for r in sorted(wide, key=lambda r: r.vec_id)][:2] == [None, None]
    big = whitening.whiten(table(spark, [(1, [1e6]), (2, [-1e6])])).collect()
    assert {r.deviation for r in big} == {(2 * 1024 * 10**6) ** 2}
