"""Publishes the annotated chunks of a document table, by source and language.

    python -m jobs.publish_chunks --config jobs/publish_chunks.yaml --documents IN --output OUT

Texts are cleaned, split along their structure and annotated; chunks that score
``min_score`` or more go to OUT/chunks in folders source=/lang=, and a report by
source and language to OUT/report, likewise. A run over all sources replaces the
output; a run over some ``sources`` replaces their folders alone. Either gives
the same output when it is run again.

Defined cases: null texts have no chunks; a null or empty source or language is
a folder of its own and reads as null; documents of one id are pages of one
document in no set order of their sections, so ids should differ; extra columns
are ignored; an empty table gives an empty output.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.operators import chunking
from docweave.sources import store
from jobs.common import log, main, names, write_parts

DEFAULTS = {"min_score": 0.25, "sources": ""}
PARTS = ["source", "lang"]
CHUNKS = (
    "doc_id long, section_idx int, chunk_idx int, content string, chapter string, section string, citations array<string>, "
    "legal_concepts array<string>, confidence_score double, source string, lang string"
)
REPORT = "n_chunks long, n_documents long, n_cited long, n_with_concepts long, mean_score double, source string, lang string"


def chunks_of(documents: DataFrame, min_score: float) -> DataFrame:
    """The chunks to publish, with their documents' source and language."""
    part = {c: F.nullif(F.col(c).cast("string"), F.lit("")) for c in PARTS}
    doc = F.struct(F.col("doc_id").cast("long").alias("doc_id"), *[v.alias(c) for c, v in part.items()])
    pages = documents.select(doc.alias("doc"), F.lit(1).alias("page_number"), X.clean_text(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"))
    chunks = chunking.legal_chunks(pages, "doc").where(F.col("confidence_score") >= min_score)
    return chunks.select("doc.doc_id", "section_idx", "chunk_idx", "content", "chapter", "section", "citations", "legal_concepts", "confidence_score", *[f"doc.{c}" for c in PARTS])


def report_of(chunks: DataFrame) -> DataFrame:
    """Counts and the mean score by source and language."""
    return chunks.groupBy(*PARTS).agg(
        F.count("*").alias("n_chunks"), F.count_distinct("doc_id").alias("n_documents"), F.count_if(F.size("citations") > 0).alias("n_cited"),
        F.count_if(F.size("legal_concepts") > 0).alias("n_with_concepts"), F.avg("confidence_score").alias("mean_score"),
    )


def published(spark: SparkSession, output: str) -> tuple[DataFrame, DataFrame]:
    """(chunks, report) as they are stored."""
    empty = lambda kind: spark.createDataFrame([], kind)
    read = lambda name, kind: spark.read.schema(kind).parquet(f"{output}/{name}") if store.exists(spark, f"{output}/{name}") else empty(kind)
    return read("chunks", CHUNKS), read("report", REPORT)


def run(spark: SparkSession, documents: str, output: str, settings: dict | None = None) -> None:
    """Publishes the chunks of the documents at a path."""
    chosen = DEFAULTS | (settings or {})
    wanted = names(chosen["sources"])
    docs = spark.read.parquet(documents)
    if wanted:
        docs = docs.where(F.col("source").isin(wanted))
    # A source that holds most of the rows is split over tasks, small ones share a task.
    chunks = chunks_of(docs, chosen["min_score"]).hint("rebalance", *PARTS)
    log.info("reading %s (%s)", documents, ", ".join(wanted) or "all sources")
    write_parts(chunks, f"{output}/chunks", PARTS, replace_all=not wanted)
    stored = published(spark, output)[0]
    report = report_of(stored.where(F.col("source").isin(wanted)) if wanted else stored)
    write_parts(report.hint("rebalance"), f"{output}/report", PARTS, replace_all=not wanted)
    total = published(spark, output)[1].agg(F.sum("n_chunks"), F.sum("n_documents"), F.count("*")).first()
    log.info("read %d documents; %s holds %d chunks of %d documents in %d folders", docs.count(), output, total[0] or 0, total[1] or 0, total[2])


if __name__ == "__main__":
    main(run, DEFAULTS, ["documents", "output"])
