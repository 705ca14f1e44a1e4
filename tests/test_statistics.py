"""Selection by histograms, stored statistics, and the paragraph fold, against plain code."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from docweave.functions import patterns as P
from docweave.operators import chunking, evaluate


def test_exact_median(spark):
    rng = random.Random(2)
    cases = [
        [rng.gauss(0, 1) for _ in range(5000)],
        [rng.choice([1.0, 2.0]) for _ in range(1000)],
        [10.0 ** rng.randint(-300, 300) * rng.choice([-1, 1]) for _ in range(801)],
        [5.0], [1.0, 4.0], [0.0, -0.0, 1.0], [-1.7e308, 1.7e308, 1.0, 2.0], [1e-320, 2e-320, 3e-320],
    ]
    for values in cases:
        df = spark.createDataFrame([(v,) for v in values] + [(None,)], "x double").repartition(3)
        assert evaluate.exact_median(df, "x") == statistics.median(values)
        order = sorted(values)
        for rank in {0, len(order) // 3, len(order) - 1}:
            assert evaluate.ranked_value(df.where("x is not null"), rank, "x") == order[rank]
    assert evaluate.exact_median(spark.createDataFrame([(None,)], "x double"), "x") is None
    nan = spark.createDataFrame([(float("nan"),), (1.0,), (2.0,)], "x double")
    assert evaluate.exact_median(nan, "x") == 2.0 and evaluate.exact_median(nan.where("isnan(x)"), "x") != evaluate.exact_median(nan, "x")


def test_statistics_kept_over_appends(spark, tmp_path):
    text = "CHAPTER {0}: A\nSection {0}.1 X\nArrest on a warrant. See M.G.L. c. {0}, § 2"
    pages = spark.createDataFrame([(i, n, text.format(i % 4)) for i in range(12) for n in (1, 2)] + [(99, 1, "plain"), (98, 1, None)], "doc_id long, page_number int, text string")
    chunks = chunking.legal_chunks(pages)
    for part in range(3):
        evaluate.add_statistics(chunks.where(F.col("doc_id") % 3 == part), str(tmp_path))
    got = evaluate.stored_statistics(spark, str(tmp_path)).first().asDict()
    want = evaluate.corpus_report(chunks).first().asDict() | {k: v for k, v in evaluate.system_stats(chunks).first().asDict().items() if k != "total_chunks"}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k]) for k in want)
    assert spark.read.parquet(f"{tmp_path}/values").groupBy("kind", "value").count().where("count > 1").count() == 0
    evaluate.add_statistics(chunks.limit(0), str(tmp_path / "none"))
    assert evaluate.stored_statistics(spark, str(tmp_path / "none")).first().total_chunks == 0


def test_semantic_split_matches_a_plain_fold(spark):
    rng = random.Random(6)
    bits = ["arrest", "magistrate", "warrant", "This means that", "defined as", "for Example", "The elements are:", "1. first thing", "plain words", "x" * 400, "y" * 900, " ", "deadly force"]
    texts = ["\n\n".join(" ".join(rng.choices(bits, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 14))) for _ in range(150)]

    def concepts(t):
        return {c for c, ws in P.CONCEPTS.items() if any(w.lower() in t.lower() for w in ws)}

    import re

    def fold(text):
        done, cur = [], ""
        for p in [p.strip() for p in text.split("\n\n") if p.strip()]:
            test = f"{cur}\n\n{p}" if cur else p
            lists = re.search(r"(?i)(?:elements?|requirements?|conditions?).*?(?:are|include)?:?\s*$", cur) and re.search(r"(?m)^\s*(\d+)\.?\s+(.+)$", p)
            example = ("means" in cur or "defined as" in cur) and "example" in p.lower()
            if len(test) > 1000 and not lists and not example and not concepts(cur) & concepts(p):
                done += [cur] if cur else []
                cur = p
            else:
                cur = test
        return done + ([cur] if cur else [])

    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.c for r in df.select("i", chunking.semantic_split(F.col("t"), small=0).alias("c")).collect()}
    assert got == {i: fold(t) for i, t in enumerate(texts)} and sum(len(c) > 1 for c in got.values()) > 30


def test_metrics_without_a_list_of_concepts(spark):
    cases = evaluate.cases_table(spark).limit(2)
    found = spark.createDataFrame([(0, "An arrest on probable cause."), (1, None)], "query_id int, content string")
    bare = evaluate.retrieval_metrics(cases, found).collect()
    from docweave.functions import text as X

    full = evaluate.retrieval_metrics(cases, found.withColumn("concepts", X.concepts(F.coalesce("content", F.lit(""))))).collect()
    assert sorted(map(str, bare)) == sorted(map(str, full))
