"""Results made once, models in batches, and collections changed by id."""

import numpy as np
from pyspark.sql import functions as F

from docweave.functions import embed
from docweave.operators import cached
from docweave.sources import store


def test_embeddings_are_made_for_new_texts_only(spark, tmp_path):
    path = str(tmp_path / "c")
    one = spark.createDataFrame([("a", "x y"), ("b", "x y"), ("c", None), ("d", "")], "id string, document string")
    got = {r.id: list(r.embedding) for r in cached.cached_embeddings(one, path).collect()}
    assert got == {i: embed.hashed_vector(t).tolist() for i, t in one.collect()}
    assert cached.made_in_last_run(one, path) == 2  # "x y" and the empty text
    two = one.union(spark.createDataFrame([("e", "z")], "id string, document string"))
    assert cached.cached_embeddings(two, path).count() == 5
    assert spark.read.parquet(path).count() == 3
    assert cached.cached_embeddings(two.limit(0), path).count() == 0


def test_failed_answers_are_tried_again(spark, tmp_path):
    path, log = str(tmp_path / "c"), tmp_path / "calls"
    asked = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "good"), (4, None)], "query_id int, prompt string")

    def speak(broken):
        def answer(text):
            with open(log, "a") as f:
                f.write(f"{text}\n")
            if broken and text == "bad":
                raise ValueError("no answer")
            return text.upper()

        return cached.guarded(answer)

    rows = lambda df: {r.query_id: (r.answer, r.error) for r in df.collect()}
    first = rows(cached.cached_answers(asked, path, speak(True)))
    assert first == {1: ("GOOD", None), 2: (None, "ValueError: no answer"), 3: ("GOOD", None), 4: ("", None)}
    assert sorted(log.read_text().splitlines()) == ["", "bad", "good"]
    assert rows(cached.cached_answers(asked, path, speak(True))) == first
    assert log.read_text().splitlines().count("bad") == 2 and log.read_text().splitlines().count("good") == 1
    assert rows(cached.cached_answers(asked, path, speak(False)))[2] == ("BAD", None)
    assert rows(cached.cached_answers(asked, path, speak(True)))[2] == ("BAD", None)
    assert log.read_text().splitlines().count("bad") == 3


def test_a_failure_is_given_up_after_some_attempts(spark, tmp_path):
    asked = spark.createDataFrame([(1, "bad")], "query_id int, prompt string")

    def fail(text):
        raise RuntimeError(text)

    for _ in range(4):
        row = cached.cached_answers(asked, str(tmp_path / "c"), cached.guarded(fail), attempts=2).first()
    assert row.error == "RuntimeError: bad" and spark.read.parquet(str(tmp_path / "c")).count() == 2


def test_models_are_called_in_batches(spark):
    docs = spark.createDataFrame([(i, f"text {i}" if i else None) for i in range(50)], "id int, text string").coalesce(1)

    def load():
        return lambda texts: np.array([[len(texts), len(t)] for t in texts], float)

    got = docs.select("id", embed.batched(load, 2, batch_size=16)(F.col("text")).alias("v")).collect()
    assert {r.v[0] for r in got} == {16.0, 2.0} and {r.id: r.v[1] for r in got}[0] == 0.0
    same = docs.select((embed.batched(embed.hashed_model, 64)(F.coalesce("text", F.lit(""))) == embed.hashed(F.coalesce("text", F.lit("")))).alias("same"))
    assert same.where("not same").count() == 0


def test_upserts_change_their_folders_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "ID_BUCKETS", 8)
    path = str(tmp_path / "c")
    make = lambda rows: spark.createDataFrame([(i, d, (0,)) for i, d in rows], "id string, document string, metadata struct<n: int>")
    read = lambda df: {r.id: r.document for r in df.collect()}
    first = store.upsert_collection(make([(f"d{i}", f"text {i}") for i in range(40)]), path, embed.with_embedding)
    assert read(first) == {f"d{i}": f"text {i}" for i in range(40)} and first.where("size(embedding) = 64").count() == 40
    files = set(first.inputFiles())
    change = make([("d3", "changed"), ("new", "b"), ("new", "a")])
    want = read(first) | {"d3": "changed", "new": "b"}
    for _ in range(2):
        again = store.upsert_collection(change, path, embed.with_embedding)
        assert read(again) == want
    assert len(files - set(again.inputFiles())) <= 2  # two folders at most were written again
    less = store.upsert_collection(make([]), path, embed.with_embedding, spark.createDataFrame([("d3",), ("d4",), ("absent",)], "id string"))
    assert read(less) == {k: v for k, v in want.items() if k not in ("d3", "d4")}
    none = store.upsert_collection(make([]), path, embed.with_embedding, less.select("id"))
    assert none.count() == 0
