"""Incremental ingestion of chunk files (an extension: the same operators over a stream)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docweave.functions import text as X


def read_stream(spark: SparkSession, path: str, schema: str = "doc_id long, text string, ts timestamp") -> DataFrame:
    """Documents as their Parquet files arrive."""
    return spark.readStream.schema(schema).parquet(path)


def cleaned_stream(docs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Cleaned and annotated documents; repeats of an id within the delay are
    dropped, and the state of older ids is let go."""
    once = docs.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["doc_id"])
    text = X.clean_text(F.col("text"))
    return once.select("doc_id", "ts", text.alias("text")).withColumn("citations", X.citations(F.col("text"))).withColumn("legal_concepts", X.concepts(F.col("text")))


def concept_counts(cleaned: DataFrame, width: str = "10 minutes") -> DataFrame:
    """(window, concept, n): documents by concept over event-time windows."""
    each = cleaned.select("ts", F.explode("legal_concepts").alias("concept"))
    return each.groupBy(F.window("ts", width), "concept").agg(F.count("*").alias("n"))


def append_to(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends the stream to a Parquet table; each file lands once."""
    writer = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
