"""Inverted lists against plain sorting of all distances."""

import numpy as np
import pytest

from docweave.functions.embed import hashed
from docweave.operators import vector_index
from docweave.plans import lifecycles


def table(spark, rows):
    return spark.createDataFrame([(i, v if v is None else [None if x is None else float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def brute(rows, queries, k):
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    out = {}
    for i, q in queries:
        d = ((x - np.array(q)) ** 2).sum(axis=1)
        out[i] = [int(ids[a]) for a in np.lexsort((ids, d))[:k]]
    return out


def found(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append(r.vec_id)
    return out


@pytest.fixture(scope="module")
def clustered():
    rng = np.random.default_rng(7)
    centres = 4 * rng.normal(size=(30, 8))
    where = np.where(rng.random(3000) < 0.4, 0, rng.integers(0, 30, 3000))  # one cluster holds two fifths
    return list(enumerate((centres[where] + 0.3 * rng.normal(size=(3000, 8))).tolist()))


def test_exact_and_probed_rows(spark, tmp_path, clustered):
    index = vector_index.build_index(table(spark, clustered).repartition(6), str(tmp_path))
    assert index.rows.sum() == 3000 and sorted(index.numbers) == list(index.numbers) and len(index.numbers) <= 55
    queries = clustered[::40] + [(9000, [100.0] * 8)]
    want = brute(clustered, queries, 7)
    assert found(vector_index.search(table(spark, queries), index, 7, probes=1, exact=True)) == want
    assert found(vector_index.search(table(spark, queries), index, 7, probes=len(index.numbers))) == want
    probes = vector_index.calibrated_probes(index, 0.95)
    assert probes < len(index.numbers) / 2
    got = found(vector_index.search(table(spark, queries), index, 7, probes))
    assert sum(len(set(got[q]) & set(want[q])) for q in want) >= 0.95 * 7 * len(want)
    assert vector_index.share_compared(table(spark, queries), index, probes) < 0.6
    # Opened again, it is the same; a search reads the folders that it asks for.
    again = vector_index.open_index(spark, str(tmp_path))
    assert (again.centres == index.centres).all() and found(vector_index.search(table(spark, queries), again, 7, probes)) == got
    plan = index.lists.where("list in (0, 1)")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in plan


def test_far_from_the_origin(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = list(enumerate((1e6 + rng.normal(size=(400, 4))).tolist()))
    index = vector_index.build_index(table(spark, rows), str(tmp_path), lists=12)
    assert found(vector_index.search(table(spark, rows[::20]), index, 5, probes=1, exact=True)) == brute(rows, rows[::20], 5)


def test_defined_cases(spark, tmp_path):
    rows = [(1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, None), (4, [1.0, None]), (5, [2.0, 2.0])]
    index = vector_index.build_index(table(spark, rows), f"{tmp_path}/a", lists=10)
    assert found(vector_index.search(table(spark, rows), index, 5, probes=10)) == {1: [1, 2, 5], 2: [1, 2, 5], 5: [5, 1, 2]}
    assert vector_index.calibrated_probes(index) <= 2
    empty = vector_index.build_index(table(spark, []), f"{tmp_path}/b")
    assert vector_index.search(table(spark, rows), empty, 5, exact=True).count() == 0
    assert vector_index.calibrated_probes(empty) == 1 and vector_index.share_compared(table(spark, rows), empty, 3) == 0


def test_a_collection_searched_by_its_lists(spark, tmp_path):
    docs = spark.createDataFrame([(i, f"arrest number {i} and warrant {i % 7}") for i in range(60)], "doc_id long, text string")
    stored = lifecycles.build_corpus(docs, f"{tmp_path}/c")
    lists = lifecycles.index_collection(stored, f"{tmp_path}/lists")
    asked = spark.createDataFrame([(0, "warrant 3"), (1, "arrest number 12")], "query_id int, query string")
    row = lambda df: sorted(map(tuple, df.select("query_id", "rank", "id").collect()))
    by_lists = lifecycles.vector_search(stored, hashed, lists, probes=len(lists.numbers))(asked, 4)
    assert row(by_lists) == row(lifecycles.vector_search(stored)(asked, 4))


def test_a_query_goes_once_to_a_shelf_and_blocks_are_never_broadcast(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = list(enumerate(rng.normal(size=(3000, 6)).tolist()))
    df = table(spark, rows)
    index = vector_index.build_index(df.repartition(4), str(tmp_path), lists=200)
    asked = vector_index._vectors(df.where("vec_id % 100 = 0"), "vec_id", "embedding")
    sent = asked.mapInArrow(vector_index._probed(index, 200, False), vector_index._SHELVED).collect()
    assert len(sent) <= 30 * vector_index.SHELVES and sum(len(r.lists) for r in sent) == 30 * len(index.numbers)
    got = vector_index.search(df.where("vec_id % 100 = 0"), index, 5, exact=True)
    assert found(got) == brute(rows, [r for r in rows if r[0] % 100 == 0], 5)
    assert "BroadcastHashJoin" not in got._jdf.queryExecution().toString()
