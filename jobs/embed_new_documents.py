"""Chunks and embeds the documents of newly arrived files; nothing is embedded twice.

    python -m jobs.embed_new_documents --config jobs/embed_new_documents.yaml \\
        --documents IN --output OUT --checkpoint MARK

IN holds Parquet files of documents (doc_id long, text string, any others). A
file stream with a checkpoint at MARK takes the files that no run has taken, and ends when there are no more. A micro-batch writes its cleaned chunks
to OUT/chunks/batch=N with the hash of each text, then embeds the texts whose
hash is not in OUT/vectors yet, to OUT/vectors/batch=N. A batch that is run again
after a failure replaces its own folders and doesn't count its own vectors as
known, so the output is the same as without the failure. OUT and MARK belong
together: to start anew, both go.

A document that arrives again replaces its earlier version: ``current`` reads the
chunks of each document's latest batch, with their vectors.

Defined cases: null texts are empty ones, and an empty text has one empty chunk
with a vector of zeros; rows of one id in one batch are kept side by side; null
ids are documents of one id; extra columns are ignored; an empty table gives an
empty output.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.functions.embed import hashed, with_embedding
from docweave.operators import chunking
from docweave.sources import store
from jobs.common import log, main, write_parts

DEFAULTS = {"chunk_size": chunking.SIZE, "overlap": chunking.OVERLAP, "max_files": 0}
DOCUMENTS = "doc_id long, text string"
CHUNKS = "doc_id long, chunk_index int, text string, text_key string, batch long"
VECTORS = "text_key string, embedding array<float>, batch long"


def stored(spark: SparkSession, output: str, name: str) -> DataFrame:
    """OUT/chunks or OUT/vectors as they stand; empty before the first batch."""
    kind, path = {"chunks": CHUNKS, "vectors": VECTORS}[name], f"{output}/{name}"
    return spark.read.schema(kind).parquet(path) if store.exists(spark, path) else spark.createDataFrame([], kind)


def current(spark: SparkSession, output: str) -> DataFrame:
    """(doc_id, chunk_index, text, text_key, batch, embedding, embedded): the
    latest version of each document; ``embedded`` is the batch of its vector."""
    chunks = stored(spark, output, "chunks")
    latest = chunks.groupBy("doc_id").agg(F.max("batch").alias("latest")).withColumnRenamed("doc_id", "id")
    kept = chunks.join(latest, chunks["doc_id"].eqNullSafe(latest["id"]) & (F.col("batch") == F.col("latest"))).drop("id", "latest")
    return kept.join(stored(spark, output, "vectors").withColumnRenamed("batch", "embedded"), "text_key")


def take(batch: DataFrame, number: int, output: str, chosen: dict, embed: Callable[[Column], Column]) -> None:
    """One micro-batch: its chunks, then the vectors of texts not seen before."""
    spark = batch.sparkSession
    docs = batch.select(F.col("doc_id").cast("long").alias("doc_id"), X.clean_text(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    chunks = chunking.sliding_chunks(docs, size=chosen["chunk_size"], overlap=chosen["overlap"])
    chunks = chunks.select("doc_id", "chunk_index", "text", F.sha2("text", 256).alias("text_key"), F.lit(number).cast("long").alias("batch"))
    write_parts(chunks, f"{output}/chunks", ["batch"])
    own = stored(spark, output, "chunks").where(F.col("batch") == number)
    texts = own.groupBy("text_key").agg(F.first("text").alias("text"))  # texts of one hash are equal
    # Of the store, which grows, only the keys of this batch are shuffled where these are few.
    keys = store.maybe_broadcast(texts.select("text_key"), 80)
    known = stored(spark, output, "vectors").where(F.col("batch") != number).select("text_key").join(keys, "text_key", "left_semi")
    vectors = with_embedding(texts.join(known, "text_key", "left_anti"), "text", embed)
    write_parts(vectors.select("text_key", "embedding", F.lit(number).cast("long").alias("batch")), f"{output}/vectors", ["batch"])
    made = stored(spark, output, "vectors").where(F.col("batch") == number).count()
    log.info("batch %d: wrote %d chunks, embedded %d texts", number, own.count(), made)


def run(spark: SparkSession, documents: str, output: str, checkpoint: str, settings: dict | None = None, embed: Callable[[Column], Column] = hashed) -> None:
    """Takes the files at a path that no run with this checkpoint has taken."""
    if store.exists(spark, f"{output}/chunks") and not store.exists(spark, checkpoint):
        raise ValueError(f"{output} holds batches of another checkpoint than {checkpoint}: they belong together")
    chosen = DEFAULTS | (settings or {})
    arriving = spark.readStream.schema(DOCUMENTS)
    if chosen["max_files"]:
        arriving = arriving.option("maxFilesPerTrigger", chosen["max_files"])
    log.info("reading new files of %s", documents)
    writer = arriving.parquet(store.stream_path(spark, documents)).writeStream.trigger(availableNow=True).option("checkpointLocation", checkpoint)
    stream = writer.foreachBatch(lambda batch, number: take(batch, number, output, chosen, embed)).start()
    stream.awaitTermination()
    progress = stream.recentProgress
    log.info("took %d new rows in %d batches; %s holds %d chunks", sum(p["numInputRows"] for p in progress), len([p for p in progress if p["numInputRows"]]), output, stored(spark, output, "chunks").count())


if __name__ == "__main__":
    main(run, DEFAULTS, ["documents", "output", "checkpoint"])
