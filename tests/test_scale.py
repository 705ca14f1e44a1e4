"""Results and sizes that only larger tables show, on small ones."""

import random
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave import queries
from docweave.functions import embed
from docweave.functions import text as X
from docweave.operators import cached, chunking, retrieval


@pytest.mark.parametrize("text", ["!! THIS.!! WAS!!", " keit beßö.", "in oran.", "a"])
def test_tokens_that_cancel_have_a_vector(text):
    assert np.linalg.norm(embed.hashed_vector(text)) == pytest.approx(1, abs=1e-6)


def test_digits_as_printf_shows_them(spark):
    values = [36.15045, 31.49235, 0.00005, 2.5, 12345.67895, 1e-9]
    got = spark.createDataFrame([(v,) for v in values], "v double").select("v", queries._four_digits(F.col("v"))).collect()
    assert [r[1] for r in got] == [f"{r.v:.4f}" for r in got]


def test_blocks_of_scores(spark, monkeypatch):
    """Several blocks, frequent and rare terms, slices of queries, equal documents, text ids."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(200)]
    texts = [" ".join(rng.choices(words, [1 / (i + 1) for i in range(200)], k=rng.randint(0, 40))) for _ in range(150)]
    docs = spark.createDataFrame([(f"d{i}", t) for i, t in enumerate(texts * 2)], "doc_id string, text string")
    asked = spark.createDataFrame([(i, " ".join(rng.choices(words, k=9))) for i in range(40)] + [(40, "absent"), (41, None)], "query_id long, query string")
    index = retrieval.bm25_index(docs)
    weights = retrieval._weights(asked, index)
    hits = retrieval._hits(index, weights, retrieval.K1, retrieval.B)
    parts = hits.join(weights.select("query_id", "number", "idf"), "number")
    every = parts.groupBy("query_id", "id").agg(F.round(F.sum(F.col("idf") * F.col("gain")), 6).alias("score"))
    want = sorted(map(tuple, retrieval._ranked(every, 7, "doc_id").collect()))
    totals = {r.query_id: r["count"] for r in every.groupBy("query_id").count().collect()}
    monkeypatch.setattr(retrieval, "DOCUMENTS", 64)
    monkeypatch.setattr(retrieval, "CELLS", 512)
    for often in (0.0, 0.1, 1.0):
        monkeypatch.setattr(retrieval, "OFTEN", often)
        assert sorted(map(tuple, retrieval.bm25(asked, index, 7).collect())) == want
        got = retrieval.explained_bm25(asked, index, 7).collect()
        assert {r.query_id: r.total_found for r in got} == totals
        assert sorted((r.query_id, r["rank"], r.doc_id, r.score) for r in got) == want


def test_no_row_for_a_query_and_a_document(spark):
    """Every query shares a word with every document; what is shuffled is k rows for each query."""
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("the w"), F.col("id").cast("string")).alias("text"))
    asked = spark.range(200).select(F.col("id").alias("query_id"), F.concat(F.lit("the w"), F.col("id").cast("string")).alias("query"))
    index = retrieval.bm25_index(docs)
    weights = retrieval._weights(asked, index)
    rows = retrieval._sums(retrieval._hits(index, weights, retrieval.K1, retrieval.B), weights, index.n, 2)
    assert rows.count() == 400
    assert {r.total_found for r in retrieval.explained_bm25(asked, index, 2).collect()} == {3000}


def test_few_texts_at_a_time(monkeypatch):
    """A batch of many texts doesn't become Python's strings and chunks as a whole."""
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000)), pa.array(["word " * 400] * 1000)], names=["id", "text"])

    class Frame:
        """Stands for the DataFrame: what the batches of the operator's function are."""

        schema = {"id": SimpleNamespace(dataType=SimpleNamespace(simpleString=lambda: "long"))}

        def select(self, *_):
            return self

        def mapInArrow(self, run, _):
            self.out = list(run(iter([batch])))
            return self

        def withColumnRenamed(self, *_):
            return self

    monkeypatch.setattr(chunking.F, "col", lambda c: SimpleNamespace(alias=lambda _: c))
    out = chunking.recursive_chunks(Frame(), size=300, overlap=60).out
    assert max(b.num_rows for b in out) <= 64 * 20 and len(out) > 1
    want = [(i, n, c) for i in range(1000) for n, c in enumerate(chunking.recursive_split("word " * 400, 300, 60))]
    assert [tuple(r.values()) for b in out for r in b.to_pylist()] == want


def test_items_are_made_for_missing_keys_only(spark, tmp_path):
    """A call that finds all keys makes and writes nothing."""
    path, calls = str(tmp_path / "c"), []
    items = spark.createDataFrame([("a", 1), ("a", 1), ("b", 2)], "key string, n int")

    def make(fresh):
        calls.append(fresh.count())
        return fresh.select("key", (F.col("n") * 2).alias("twice"))

    first = sorted(map(tuple, cached.computed_once(items, path, make).select("key", "twice").collect()))
    assert first == sorted(map(tuple, cached.computed_once(items, path, make).select("key", "twice").collect())) == [("a", 2), ("b", 4)]
    assert calls == [2]


def test_uncut_sections_and_guarded_statutes(spark):
    """What is skipped gives what a full look gives."""
    texts = ["", "  \n\n ", " a \n\n\n\n b ", "x" * 3000, "p" * 600 + "\n\n" + "q" * 600, "M.G.L. c. 90, § 24", "mgl c 265 s. 13A", "GENERAL LAWS chapter 276 section 1", "General Law c. 1, § 2", "M.GL c. 3 § 4", "none", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: (r.c, r.s) for r in rows.select("i", chunking.semantic_split(F.col("t")).alias("c"), X.statute_citations(F.col("t")).alias("s")).collect()}
    assert [got[i][0] for i in range(5)] == [[], [], ["a\n\nb"], ["x" * 3000], ["p" * 600, "q" * 600]]
    assert [len(got[i][1]) for i in range(5, 11)] == [1, 1, 1, 1, 1, 0] and got[11][1] is None
