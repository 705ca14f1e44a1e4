"""Dictionaries as tables against a plain search for each keyword."""

import random

from pyspark.sql import functions as F

from docweave.functions import dictionary
from docweave.functions import text as X


def test_thousands_of_keywords(spark, tmp_path, monkeypatch):
    rng = random.Random(4)
    letters = "abcdeé "
    words = sorted({"".join(rng.choices(letters, k=rng.randint(2, 5))) for _ in range(5000)})
    rows = [(f"c{rng.randrange(400)}", w.upper() if i % 3 else w) for i, w in enumerate(words)]
    texts = [(i, "".join(rng.choices(letters + "\nXY", k=rng.randint(0, 60)))) for i in range(200)] + [(900, None), (901, ""), (902, "É" * 3)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    path = str(tmp_path / "d.jsonl")
    spark.createDataFrame(rows, "concept string, keyword string").write.json(path)
    table = dictionary.read_dictionary(spark, path)
    want = {i: sorted({c for c, w in rows if t is not None and w.lower() in t.lower()}) for i, t in texts}
    got = {r.doc_id: r.legal_concepts for r in dictionary.tagged(docs, table).collect()}
    assert got == want and sum(map(len, want.values())) > 1000
    monkeypatch.setattr(dictionary, "AUTOMATON_CHARS", 3000)  # several automata
    assert {r.doc_id: r.legal_concepts for r in dictionary.tagged(docs, table).collect()} == want


def test_order_and_defined_cases(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Arrest on PC."), (2, None), (3, "upcoming")], "doc_id long, text string")
    built_in = dictionary.from_mapping(spark)
    both = dictionary.tagged(docs.where("text is not null"), built_in, name="a").withColumn("b", X.concepts(F.col("text")))
    assert all(r.a == r.b for r in both.collect()) and both.where("size(a) > 0").count() == 2
    odd = spark.createDataFrame([("z", "arrest", 0), ("a", "arrest", 1), ("every", "", 2), (None, "pc", 3), ("none", None, 4)], "concept string, keyword string, place int")
    assert {r.doc_id: r.x for r in dictionary.tagged(docs, odd, name="x").collect()} == {1: ["z", "a", "every"], 2: [], 3: ["every"]}
    assert {tuple(r.x) for r in dictionary.tagged(docs, odd.limit(0), name="x").collect()} == {()}
    odd.select("concept", "keyword").where("keyword = 'arrest'").write.csv(str(tmp_path / "d.csv"), header=True)
    assert dictionary.tagged(docs, dictionary.read_dictionary(spark, str(tmp_path / "d.csv")), name="x").where("doc_id = 1").first().x == ["a", "z"]
