"""Keyword counts as maps, derived evaluation cases, stream paths."""

from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.operators import evaluate
from docweave.sources import store


def test_keyword_counts(spark):
    df = spark.createDataFrame([(1, "A.b a.B x+y aaa"), (2, None), (3, "")], "i int, t string")
    words = {"dot": ["a.b"], "plus": ["x+y", "zz"], "run": ["aa"], "none": ["q"]}
    got = {r.i: r.c for r in df.select("i", X.keyword_counts(F.col("t"), words).alias("c")).collect()}
    assert got == {1: {"dot": 2, "plus": 1, "run": 1}, 2: {}, 3: {}}
    built_in = df.select(X.keyword_counts(F.lit("Arrest, arrest on a warrant")).alias("c")).first().c
    assert built_in["arrest"] == 2


def test_cases_from_known_answers(spark):
    rows = [(1, "What about the Warrant and the arrest?", "An arrest on probable cause, M.G.L. c. 276, § 28"), (2, "short", None), (3, None, "plain")]
    got = {r.query_id: r for r in evaluate.cases_from(spark.createDataFrame(rows, "query_id int, query string, answer string")).collect()}
    assert got[1].required_terms == ["warrant", "arrest", "about"] and got[1].expected_citations == ["M.G.L. c. 276, § 28"]
    assert "arrest" in got[1].expected_concepts and got[1].difficulty == "advanced"
    assert (got[2].required_terms, got[2].difficulty, got[3].required_terms) == (["short"], "basic", [])
    # They are cases as the metrics take them.
    found = spark.createDataFrame([(1, "arrest warrant about M.G.L. c. 276, § 28"), (2, "short")], "query_id int, content string")
    metrics = {r.query_id: r for r in evaluate.retrieval_metrics(evaluate.cases_from(spark.createDataFrame(rows, "query_id int, query string, answer string")), found).collect()}
    assert (metrics[1].relevance, metrics[1].citation_preservation, metrics[2].relevance, metrics[3].relevance) == (1.0, 1.0, 1.0, 0.0)


def test_stream_paths(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "f.parquet").write_bytes(b"x")
    assert store.stream_path(spark, f"{tmp_path}/d") == f"{tmp_path}/d"
    assert store.stream_path(spark, f"{tmp_path}/f.parquet") == f"{tmp_path}/f.parque[t]"
    assert store.stream_path(spark, f"{tmp_path}/absent") == f"{tmp_path}/absent"
