"""The registered queries of this subpackage: one for each operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontaminate, html_extract, line_dedup, mixing, nearest, quality, quality_rules, secrets_scan, toxicity, url_filter, whitening
from docweave.llm.near_dedup import near_dedup


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the lines that repeat, exactly or nearly, earlier ones."""
    return line_dedup.dedup_lines(_table(spark, sf_dir, "documents")).select("doc_id", "n_lines", "n_dropped", "text")


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents."""
    return secrets_scan.scan_secrets(_table(spark, sf_dir, "documents"))


def op3_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on all page urls."""
    return url_filter.filter_urls(_table(spark, sf_dir, "pages"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, base failures and policy verdicts of all documents."""
    return quality_rules.judged(_table(spark, sf_dir, "documents"))


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return html_extract.extract_pages(_table(spark, sf_dir, "pages"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark hits of all documents, and the items of near matches."""
    return decontaminate.digest(decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=decontaminate.SLOP), near=True)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores of all documents."""
    return toxicity.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the mix takes of each document."""
    mixed = mixing.mix_sources(_table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "expected", "copies")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents."""
    return quality.judged(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with its near-duplicate class."""
    return near_dedup(_table(spark, sf_dir, "documents")).drop("text_key", "worded")


def op11_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twenty nearest vectors found for every twentieth vector, among all others."""
    return nearest.nearest(_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight whitened components of all vectors."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_line_dedup,
        op2_secret_scan,
        op3_url_filter,
        op4_quality_rules,
        op5_html_extract,
        op6_decontaminate,
        op7_toxicity,
        op8_mix_sources,
        op9_quality,
        op10_near_dedup,
        op11_nearest,
        op12_whitening,
    )
}
ORACLES: dict[str, str] = {
    "op3_url_filter": url_filter.ORACLE_SQL,
    "op4_quality_rules": quality_rules.ORACLE_SQL,
    "op5_html_extract": html_extract.ORACLE_SQL,
    "op6_decontaminate": decontaminate.ORACLE_SQL,
    "op8_mix_sources": mixing.ORACLE_SQL,
    "op11_nearest": nearest.ORACLE_SQL,
}
