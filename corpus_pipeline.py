"""Corpus preparation: the stages in order, each over all its predecessor kept.

Each stage takes (spark, docs, sf_dir); what it returns is written as Parquet
and read again as the next one's documents. All but the last return the
columns of documents; the last adds ``copies``, how often the mix repeats a
document.

Defined cases, for all stages: a null or empty text is a clean document: it is
scored as an empty one, has no lines to lose, resembles nothing, is not
contaminated, and the mix gives it one copy (it takes no words). Null ids are
ids like any other that order last. Of repeated rows (equal id and text) one
keeps its lines and stays; which one follows from a hash of the rows' columns.
Ties (equal lines, equal members of a class) go to the least id, then text. Very
long texts are taken whole. Empty tables give empty tables; extra columns,
whatever their names, are carried.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm import decontaminate, learned, line_dedup, mixing, near_dedup, toxicity
from docweave.llm.shared import drop_kept, keep, maybe_broadcast


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored at the toxicity threshold or above go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    score = toxicity.train(docs.select("doc_id", "text"), labels, use=~(toxicity.part_of("doc_id", 3) == 1))
    scored = learned.scored(_rows(docs), score, "row", "text")
    return scored.where(F.col("score") < toxicity.THRESHOLD).select("row.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of lines that are alike one stays. A document goes only if it had text
    and all of it went; the others keep their place with n_chars renewed."""
    out = line_dedup.dedup_lines(_rows(docs))
    # As an array's only item the text is made once: else the filter and the columns would do it again.
    out = out.select("row", "n_dropped", F.explode(F.array("text")).alias("text"))
    emptied = (F.col("n_dropped") > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    row = F.when(F.col("n_dropped") > 0, F.col("row").withField("text", F.col("text")).withField("n_chars", F.length("text").cast("long"))).otherwise(F.col("row"))
    return out.where(~emptied).select(row.alias("row")).select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate class stays."""
    return near_dedup.keep_first_of_class(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a twentieth of their words inside benchmark windows go.
    The index holds hashes of the texts, not rows: whole texts pass through
    Python and its batches once, and the few hashes that were found come back."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    key = F.xxhash64("text")
    found = decontaminate.decontaminate(docs.select(key.alias("__dw_text"), "text"), benchmark, "__dw_text")
    gone = found.where(decontaminate.contaminated(F.col("n_words"), F.col("n_hit"))).select("__dw_text").distinct()
    return docs.join(maybe_broadcast(keep(gone, "contaminated"), 8), key == F.col("__dw_text"), "left_anti")


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their number of copies."""
    return mixing.apply_mix(docs)


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, text, row): the whole row rides along, so no column's name can
    clash with an operator's."""
    return docs.select("doc_id", "text", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_contaminated),
    ("mix", mix),
]
#: Learned scores and sketches have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; a stage's table goes once
    the next one's is written."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        done = keep(stage(spark, docs, sf_dir), name)
        drop_kept(docs)
        docs = done
    return docs
