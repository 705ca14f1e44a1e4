"""The jobs: repeated runs, growing input, runs after a failure, command lines."""

import os
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from docweave.functions.embed import hashed
from jobs import embed_new_documents, publish_chunks
from jobs.common import names, settings

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TEXT = "An arrest needs probable cause. See M.G.L. c. 276, § 28 on a warrant."


def rows(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


def legal(spark, path, docs):
    """(doc_id, text, source, lang) as one more file of a folder."""
    spark.createDataFrame(docs, "doc_id long, text string, source string, lang string").coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def base(tmp_path):
    return str(tmp_path)


def test_publishing_again_changes_nothing(spark, base):
    documents, out = f"{base}/in", f"{base}/out"
    legal(spark, documents, [(1, TEXT, "01", "en"), (2, TEXT + " More.", "", "en"), (3, TEXT, None, None), (4, None, "01", "en"), (5, "plain", "01", "en"), (6, TEXT, "web", "fr")])
    publish_chunks.run(spark, documents, out)
    chunks, report = publish_chunks.published(spark, out)
    got = {(r.doc_id, r.source, r.lang) for r in chunks.collect()}
    assert got == {(1, "01", "en"), (2, None, "en"), (3, None, None), (6, "web", "fr")}  # folders are read as strings, "" as null
    assert {(r.source, r.lang, r.n_chunks, r.n_cited) for r in report.collect()} == {("01", "en", 1, 1), (None, "en", 1, 1), (None, None, 1, 1), ("web", "fr", 1, 1)}
    before = rows(chunks), rows(report)
    publish_chunks.run(spark, documents, out)
    assert (rows(publish_chunks.published(spark, out)[0]), rows(publish_chunks.published(spark, out)[1])) == before


def test_publishing_some_sources_leaves_the_others(spark, base):
    one, two, out = f"{base}/one", f"{base}/two", f"{base}/out"
    legal(spark, one, [(1, TEXT, "a", "en"), (2, TEXT, "b", "en")])
    publish_chunks.run(spark, one, out)
    legal(spark, two, [(3, TEXT, "a", "en"), (4, TEXT, "b", "en")])
    for _ in range(2):
        publish_chunks.run(spark, two, out, {"sources": "a"})
        chunks, report = publish_chunks.published(spark, out)
        assert {(r.doc_id, r.source) for r in chunks.collect()} == {(3, "a"), (2, "b")}
        assert {(r.source, r.n_documents) for r in report.collect()} == {("a", 1), ("b", 1)}
    publish_chunks.run(spark, one, out)  # all sources: what is gone from the input goes from the output
    assert {(r.doc_id, r.source) for r in publish_chunks.published(spark, out)[0].collect()} == {(1, "a"), (2, "b")}
    legal(spark, f"{base}/none", [])
    publish_chunks.run(spark, f"{base}/none", out)
    assert publish_chunks.published(spark, out)[0].count() == 0


def test_only_new_files_are_taken_and_new_texts_embedded(spark, base):
    documents, out, mark = f"{base}/in", f"{base}/out", f"{base}/mark"
    given = spark.read.parquet(f"{SF}/documents.parquet")
    given.where("doc_id % 3 > 0").coalesce(1).write.parquet(documents)
    embed_new_documents.run(spark, documents, out, mark)
    first = rows(embed_new_documents.current(spark, out))
    embed_new_documents.run(spark, documents, out, mark)
    assert rows(embed_new_documents.current(spark, out)) == first
    given.where("doc_id % 3 = 0").coalesce(1).write.mode("append").parquet(documents)
    embed_new_documents.run(spark, documents, out, mark)
    chunks, vectors = (embed_new_documents.stored(spark, out, n) for n in ("chunks", "vectors"))
    assert sorted(r.batch for r in chunks.select("batch").distinct().collect()) == [0, 1]
    # Each different text has been embedded once, at the batch that brought it.
    want = chunks.groupBy("text_key").agg(F.min("batch").alias("batch"))
    assert rows(vectors.select("text_key", "batch")) == rows(want)
    assert want.where("batch = 1").count() < chunks.where("batch = 1").select("text_key").distinct().count()
    # At once, the same chunks come out.
    embed_new_documents.run(spark, documents, f"{base}/other", f"{base}/other-mark")
    once = embed_new_documents.current(spark, f"{base}/other")
    assert rows(embed_new_documents.current(spark, out).drop("batch", "embedded")) == rows(once.drop("batch", "embedded"))


def test_a_failed_batch_is_run_again(spark, base):
    documents, out, mark = f"{base}/in", f"{base}/out", f"{base}/mark"
    legal(spark, documents, [(1, "one text", "a", "en"), (2, None, "a", "en"), (3, "one text", "a", "en")])
    embed_new_documents.run(spark, documents, out, mark)
    legal(spark, documents, [(1, "another text", "a", "en"), (4, "one text", "a", "en")])

    def broken(text):
        return F.when(text.isNotNull(), F.raise_error(F.lit("no model"))).otherwise(F.array(F.lit(0.0).cast("float")))

    with pytest.raises(Exception, match="no model"):
        embed_new_documents.run(spark, documents, out, mark, embed=broken)
    embed_new_documents.run(spark, documents, out, mark, embed=hashed)
    got = {(r.doc_id, r.text, r.batch, r.embedded) for r in embed_new_documents.current(spark, out).collect()}
    assert got == {(1, "another text", 1, 1), (2, "", 0, 0), (3, "one text", 0, 0), (4, "one text", 1, 0)}


def test_a_stream_of_many_files(spark, base):
    documents, out = f"{base}/in", f"{base}/out"
    for n in range(3):
        legal(spark, documents, [(n, f"text {n} " * 300, "a", "en")])
    embed_new_documents.run(spark, documents, out, f"{base}/mark", {"max_files": 1, "chunk_size": 500, "overlap": 0})
    got = embed_new_documents.current(spark, out)
    assert got.select("batch").distinct().count() == 3
    assert max(r.n for r in got.select(F.length("text").alias("n")).collect()) == 500
    joined = {r.doc_id: "".join(t.text for t in sorted(r.c, key=lambda x: x.chunk_index)) for r in got.groupBy("doc_id").agg(F.collect_list(F.struct("chunk_index", "text")).alias("c")).collect()}
    assert joined == {n: (f"text {n} " * 300).strip() for n in range(3)}


def test_output_and_checkpoint_belong_together(spark, base):
    legal(spark, f"{base}/in", [(1, "text", "a", "en")])
    embed_new_documents.run(spark, f"{base}/in", f"{base}/out", f"{base}/mark")
    with pytest.raises(ValueError, match="another checkpoint"):
        embed_new_documents.run(spark, f"{base}/in", f"{base}/out", f"{base}/new-mark")


def test_an_empty_table(spark, base):
    legal(spark, f"{base}/in", [])
    embed_new_documents.run(spark, f"{base}/in", f"{base}/out", f"{base}/mark")
    assert embed_new_documents.current(spark, f"{base}/out").count() == 0


def test_settings(spark):
    found = settings(spark, f"{ROOT}/jobs/publish_chunks.yaml", publish_chunks.DEFAULTS)
    assert found == publish_chunks.DEFAULTS
    assert settings(spark, f"{ROOT}/jobs/embed_new_documents.yaml", embed_new_documents.DEFAULTS) == embed_new_documents.DEFAULTS
    assert settings(spark, None, {"a": 1}) == {"a": 1}
    assert names(" a, b,,c ") == ["a", "b", "c"]


def test_command_line(spark, base):
    legal(spark, f"{base}/in", [(1, TEXT, "a", "en"), (2, "plain", "a", "en")])
    args = [sys.executable, "-m", "jobs.publish_chunks", "--config", f"{ROOT}/jobs/publish_chunks.yaml", "--documents", f"{base}/in", "--output", f"{base}/out"]
    done = subprocess.run(args, cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
    assert "holds 1 chunks of 1 documents in 1 folders" in done.stderr
    assert publish_chunks.published(spark, f"{base}/out")[0].count() == 1
