"""Chunk records: normalising, positions, ids, metadata, batches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.sources.store import keep


def variant_text(df: DataFrame, names=("text", "content", "page_content", "raw")) -> Column:
    """A chunk's text, whichever of the columns holds it; a missing one is skipped."""
    have = [F.col(f"`{n}`").cast("string") for n in names if n in df.columns]
    return F.coalesce(*have) if have else F.lit(None).cast("string")


def with_position(df: DataFrame, order: list[str], name: str = "position", partitions: int | None = None) -> DataFrame:
    """``df`` with a row number from 0 in the given order, over all rows.

    Rows are dealt by ranges of the order and kept; each part numbers its own
    rows, and starts where the counts of the parts before it end. The only
    thing ordered in one place is one count for each part.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keep(df.repartitionByRange(n, *order).withColumn("_part", F.spark_partition_id()), "positions")
    counts = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_start"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return dealt.withColumn("_own", own).join(F.broadcast(starts), "_part").withColumn(name, F.col("_start") + F.col("_own")).drop("_part", "_own", "_start")


def index_records(chunks: DataFrame, position: str = "position", text_col: str = "text", source: str | None = None) -> DataFrame:
    """(id, document, metadata): blank chunks are left out after the ids are
    given, so ids keep their gaps."""
    origin = F.col("source") if "source" in chunks.columns and source is None else F.lit(source or "corpus")
    meta = F.struct(F.col(position).cast("long").alias("chunk_index"), origin.alias("source"), F.length(text_col).alias("chunk_length"))
    rows = chunks.where(~X.is_blank(F.col(text_col)))
    return rows.select(F.concat(F.lit("chunk_"), F.col(position).cast("string")).alias("id"), F.col(text_col).alias("document"), meta.alias("metadata"))


def flat_records(chunks: DataFrame, position: str = "position", text_col: str = "text", source: str = "corpus") -> DataFrame:
    """(chunk_id, text, chunk_index, source): blank chunks stay."""
    return chunks.select(F.concat(F.lit("chunk_"), F.col(position).cast("string")).alias("chunk_id"), text_col, F.col(position).cast("long").alias("chunk_index"), F.lit(source).alias("source"))


def batches(records: DataFrame, position: str, size: int = 100) -> DataFrame:
    """With ``batch``, from 0: runs of ``size`` records by position."""
    return records.withColumn("batch", F.floor(F.col(position) / size).cast("long"))


def rendered_text(df: DataFrame, names=("text", "content", "page_content", "raw")) -> Column:
    """A chunk's text if one of the columns holds it, else the whole row as JSON."""
    return F.coalesce(variant_text(df, names), F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))


def cleaned_variants(df: DataFrame, names=("text", "content", "page_content")) -> DataFrame:
    """``df`` with each text column cleaned where it stands; rows without one,
    and other columns, pass unchanged."""
    out = df
    for n in names:
        if n in df.columns:
            out = out.withColumn(n, X.clean_text(F.col(f"`{n}`")))
    return out


def nested_records(chunks: DataFrame, position: str = "position", text_col: str = "text", source: str = "corpus") -> DataFrame:
    """(id, text, metadata): metadata (source, chunk_index, char_count); blank chunks stay."""
    meta = F.struct(F.lit(source).alias("source"), F.col(position).cast("long").alias("chunk_index"), F.length(text_col).alias("char_count"))
    return chunks.select(F.concat(F.lit("chunk_"), F.col(position).cast("string")).alias("id"), F.col(text_col).alias("text"), meta.alias("metadata"))


def page_records(chunks: DataFrame, position: str = "position", text_col: str = "content", page_col: str = "page") -> DataFrame:
    """(id, document, metadata): ids ``id_0``, ``id_1``...; metadata (page)."""
    return chunks.select(F.concat(F.lit("id_"), F.col(position).cast("string")).alias("id"), F.col(text_col).alias("document"), F.struct(F.col(page_col).alias("page")).alias("metadata"))


def inspect(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """(container, rows, columns, first_type, first_keys, first_text): what a
    table holds, and what its first row looks like: its kind (``str`` for a
    single text column, else ``dict``), the names of its values that are not
    null, and the preview of its text.

    The first row is that by ``order``; without one, the first that is read.
    """
    keys = F.filter(F.array(*[F.when(F.col(f"`{c}`").isNotNull(), F.lit(c)) for c in df.columns]), lambda x: x.isNotNull())
    text = F.concat_ws(",", keys)
    one = df.orderBy(*order) if order else df
    one = one.limit(1).select(text.alias("first_keys"), X.preview_dots(variant_text(df), 200).alias("first_text"))
    kind = "str" if [t for _, t in df.dtypes] == ["string"] else "dict"
    rows = df.agg(F.lit("table").alias("container"), F.count("*").alias("rows"), F.lit(",".join(df.columns)).alias("columns"), F.lit(kind).alias("first_type"))
    return rows.join(one, F.lit(True), "left")  # two single rows
