"""Retrieval metrics, A/B comparison and corpus reports."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import patterns as P
from docweave.functions import text as X
from docweave.sources.store import exists, keep


def cases_table(spark) -> DataFrame:
    """The evaluation cases with an ordinal ``query_id`` from 0."""
    rows = [(i, *c) for i, c in enumerate(P.EVAL_CASES)]
    return spark.createDataFrame(rows, "query_id int, query string, expected_concepts array<string>, expected_citations array<string>, required_terms array<string>, difficulty string")


def cases_from(asked: DataFrame, terms: int = 3) -> DataFrame:
    """Evaluation cases, as :func:`cases_table` has them, from asked(query_id,
    query, answer) with known answers: the concepts and citations of the answer
    are expected, and the query's ``terms`` longest words (ties: the first by
    name) are required. The difficulty follows from what is expected."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("query", F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    ranked = F.array_sort(F.transform(words, lambda w: F.struct((-F.length(w)).alias("n"), w.alias("w"))))
    answer = F.coalesce("answer", F.lit(""))
    out = asked.select("query_id", "query", X.concepts(answer).alias("expected_concepts"), X.citations(answer).alias("expected_citations"), F.transform(F.slice(ranked, 1, terms), lambda r: r["w"]).alias("required_terms"))
    n = F.size("expected_concepts") + F.size("expected_citations")
    return out.withColumn("difficulty", F.when(n == 0, "basic").when(n <= 2, "intermediate").otherwise("advanced"))


def retrieval_metrics(cases: DataFrame, retrieved: DataFrame) -> DataFrame:
    """(query_id, query, difficulty, relevance, concept_coverage,
    citation_preservation) from retrieved(query_id, content, concepts, citations).

    Relevance: per chunk the share of required terms in it, averaged over the
    chunks, at most 1; 0 without chunks or terms. Concept coverage: the share
    of expected concepts found in any chunk; 1 without expectation. Citation
    preservation: the share of expected citations that are part of a found
    one; 1 without expectation, 0 if none is found. Where a chunk has no list
    of citations or concepts, those in its content count.
    """
    none = F.array().cast("array<string>")
    terms, want_k, want_c = (F.coalesce(c, none) for c in ("required_terms", "expected_concepts", "expected_citations"))
    # A question's chunks leave what they share with its expectations, so lists
    # never grow over them; sets of these are made by partial aggregates.
    cited = F.col("citations") if "citations" in retrieved.columns else F.lit(None).cast("array<string>")
    if "content" in retrieved.columns:  # without a list, the text is searched
        cited = F.coalesce(cited, X.citations(F.coalesce("content", F.lit(""))))
    named = F.col("concepts") if "concepts" in retrieved.columns else F.lit(None).cast("array<string>")
    if "content" in retrieved.columns:
        named = F.coalesce(named, X.concepts(F.coalesce("content", F.lit(""))))
    both = cases.join(retrieved.withColumn("citations", cited).withColumn("concepts", named), "query_id", "left")
    inside = F.size(F.filter(terms, lambda t: F.lower(F.col("content")).contains(F.lower(t))))
    share = F.when(F.col("content").isNotNull(), F.when(F.size(terms) > 0, inside / F.size(terms)).otherwise(0.0))
    held = F.filter(want_c, lambda e: F.exists(F.coalesce("citations", none), lambda f: f.contains(e)))
    rows = both.select("query_id", share.alias("share"), F.array_intersect(want_k, F.coalesce("concepts", none)).alias("k"), held.alias("c"), (F.size("citations") > 0).alias("cited"))
    means = rows.groupBy("query_id").agg(F.least(F.coalesce(F.avg("share"), F.lit(0.0)), F.lit(1.0)).alias("relevance"), F.coalesce(F.bool_or("cited"), F.lit(False)).alias("any_cited"))
    items = rows.select("query_id", F.lit("k").alias("kind"), F.explode("k").alias("item")).union(rows.select("query_id", F.lit("c"), F.explode("c"))).distinct()
    seen = items.groupBy("query_id").agg(F.count_if(F.col("kind") == "k").alias("seen_k"), F.count_if(F.col("kind") == "c").alias("seen_c"))
    out = cases.join(means, "query_id").join(seen, "query_id", "left").fillna(0, ["seen_k", "seen_c"])
    coverage = F.when(F.size(want_k) == 0, 1.0).otherwise(F.col("seen_k") / F.size(want_k))
    kept = F.when(F.size(want_c) == 0, 1.0).when(~F.col("any_cited"), 0.0).otherwise(F.col("seen_c") / F.size(want_c))
    return out.select("query_id", "query", "difficulty", "relevance", coverage.alias("concept_coverage"), kept.alias("citation_preservation"))


METRICS = ("relevance", "concept_coverage", "citation_preservation")


def metric_rollup(metrics: DataFrame) -> DataFrame:
    """One row of means; queries with the same text count once (the last)."""
    last = metrics.groupBy("query").agg(*[F.max_by(m, "query_id").alias(m) for m in METRICS])
    means = last.agg(*[F.avg(m).alias(f"avg_{m}") for m in METRICS])
    return means.withColumn("overall_score", sum((F.col(f"avg_{m}") for m in METRICS), F.lit(0.0)) / 3)


def compare_variants(baseline: DataFrame, challenger: DataFrame) -> DataFrame:
    """(query_id, query, latency_delta, citation_gain, identical_answer) from
    two tables (query_id, query, latency, answer, citations)."""
    b, c = baseline.alias("b"), challenger.alias("c")
    both = b.join(c, F.col("b.query_id") == F.col("c.query_id"))
    return both.select(
        "b.query_id",
        "b.query",
        (F.col("b.latency") - F.col("c.latency")).alias("latency_delta"),
        (F.size("c.citations") - F.size("b.citations")).alias("citation_gain"),
        (X.strip(F.col("b.answer")) == X.strip(F.col("c.answer"))).alias("identical_answer"),
    )


#: Cells of a selection's histogram.
CELLS = 1024


def ranked_value(values: DataFrame, rank: int, col: str) -> float | None:
    """The value of 0-based ``rank`` among a column's doubles (no nulls or NaNs).

    A histogram of the range shows the cell that holds the rank, then one of
    that cell, until a cell has one value: a few passes of partial counts, and
    no sort or set of all values in one place.
    """
    v = F.col(col)
    n, lo, hi = values.agg(F.count(v), F.min(v), F.max(v)).first()
    if not 0 <= rank < n:
        return None
    while lo < hi:
        width = hi / CELLS - lo / CELLS
        cell = F.least(F.floor((v - lo) / width), F.lit(CELLS - 1)) if width > 0 and math.isfinite(width) else (v > lo).cast("long")
        cells = values.where(v.between(lo, hi)).groupBy(cell.alias("cell")).agg(F.count("*").alias("n"), F.min(v).alias("lo"), F.max(v).alias("hi")).orderBy("cell").collect()
        for c in cells:  # CELLS rows at most
            if rank < c.n:
                lo, hi = c.lo, c.hi
                break
            rank -= c.n
    return lo


def exact_median(df: DataFrame, col: str) -> float | None:
    """The median of a column's doubles, the mean of the middle two; nulls don't
    count, and a NaN counts as the largest value."""
    values = keep(df.select(F.col(col).cast("double").alias(col)).where(F.col(col).isNotNull()), "values")
    total = values.count()
    if not total:
        return None
    real = values.where(~F.isnan(col))
    middle = [ranked_value(real, r, col) for r in {(total - 1) // 2, total // 2}]
    return float("nan") if None in middle else sum(middle) / len(middle)


def comparison_summary(rows: DataFrame) -> DataFrame:
    """Median speed-up in ms, mean citation gain, share of identical answers; nulls if empty."""
    p50 = exact_median(rows, "latency_delta")
    return rows.agg(
        F.lit(None if p50 is None else p50 * 1000).cast("double").alias("p50_speedup_ms"), F.avg("citation_gain").alias("avg_citation_gain"), F.avg(F.col("identical_answer").cast("double")).alias("identical_ratio")
    )


def corpus_report(chunks: DataFrame) -> DataFrame:
    """One row over annotated chunks; ratios are null if there is none."""
    return chunks.agg(
        F.count("*").alias("total_chunks"),
        F.avg("confidence_score").alias("average_quality"),
        F.count_if(F.size("citations") > 0).alias("chunks_with_citations"),
        F.count_if(F.size("legal_concepts") > 0).alias("chunks_with_concepts"),
        F.avg((F.size("citations") > 0).cast("double")).alias("citation_coverage"),
        F.avg((F.size("legal_concepts") > 0).cast("double")).alias("concept_coverage"),
        F.count_distinct(F.nullif("chapter", F.lit(""))).alias("chapters_identified"),
        F.count_distinct(F.nullif("section", F.lit(""))).alias("sections_identified"),
        F.avg(F.length("content")).alias("average_chars"),
    )


def recommendations(report: DataFrame) -> DataFrame:
    """(recommendations): what the report's figures call for."""

    def below(col: str, least: float, advice: str) -> Column:
        return F.when(F.col(col) < least, F.lit(advice))

    advice = F.array(
        below("average_quality", P.MIN_QUALITY, "raise chunk quality: detect more structure"),
        below("citation_coverage", P.MIN_CITATIONS, "raise citation coverage: extend the citation patterns"),
        below("concept_coverage", P.MIN_CONCEPTS, "raise concept coverage: extend the concept keywords"),
    )
    return report.select(F.filter(advice, lambda x: x.isNotNull()).alias("recommendations"))


def best_chunks(chunks: DataFrame, n: int = 3, id_col: str = "doc_id") -> DataFrame:
    """The n chunks of the highest quality; ties in document order."""
    return chunks.orderBy(F.desc("confidence_score"), id_col, "page_number", "section_idx", "chunk_idx").limit(n)


def system_stats(chunks: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(total_chunks, total_pages, unique_citations)."""
    cited = chunks.select(F.explode("citations").alias("c")).agg(F.count_distinct("c").alias("unique_citations"))
    sizes = chunks.agg(F.count("*").alias("total_chunks"), F.count_distinct(id_col, "page_number").alias("total_pages"))
    return sizes.crossJoin(F.broadcast(cited))  # two single rows


def add_statistics(chunks: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Adds annotated chunks to the stored statistics at ``path``.

    Sums are one row for each call; of what is counted once (chapters, sections,
    citations, pages) the different values are stored, each by the call that
    first had it. Chunks are read by this call alone.
    """
    spark = chunks.sparkSession
    own = keep(chunks.select("chapter", "section", "citations", "legal_concepts", "confidence_score", "page_number", F.col(id_col).cast("string").alias("doc"), F.length("content").alias("chars")), "annotated")
    page = F.concat_ws(":", F.col("page_number").cast("string"), F.coalesce("doc", F.lit("")))
    kinds = {"chapter": F.nullif("chapter", F.lit("")), "section": F.nullif("section", F.lit("")), "page": page}
    named = F.array(*[F.struct(F.lit(k).alias("kind"), v.alias("value")) for k, v in kinds.items()])
    cited = F.transform("citations", lambda c: F.struct(F.lit("citation").alias("kind"), c.alias("value")))
    values = own.select(F.explode(F.concat(named, cited)).alias("v")).select("v.*").where("value is not null").distinct()
    if exists(spark, f"{path}/values"):
        values = values.join(spark.read.parquet(f"{path}/values").select("kind", "value"), ["kind", "value"], "left_anti")
    values.write.mode("append").partitionBy("kind").parquet(f"{path}/values")
    sums = own.agg(
        F.count("*").alias("chunks"), F.count("confidence_score").alias("scored"), F.sum("confidence_score").alias("quality"), F.count_if(F.size("citations") > 0).alias("cited"),
        F.count_if(F.size("legal_concepts") > 0).alias("tagged"), F.sum("chars").alias("chars"),
    )
    sums.write.mode("append").parquet(f"{path}/sums")


def stored_statistics(spark: SparkSession, path: str) -> DataFrame:
    """The columns of :func:`corpus_report` and :func:`system_stats` from stored
    statistics; no chunk is read."""
    total = F.sum("chunks")
    share = lambda c: F.try_divide(F.sum(c), total)
    sums = spark.read.parquet(f"{path}/sums").agg(
        F.coalesce(total, F.lit(0)).alias("total_chunks"), F.try_divide(F.sum("quality"), F.sum("scored")).alias("average_quality"), F.coalesce(F.sum("cited"), F.lit(0)).alias("chunks_with_citations"),
        F.coalesce(F.sum("tagged"), F.lit(0)).alias("chunks_with_concepts"), share("cited").alias("citation_coverage"), share("tagged").alias("concept_coverage"), share("chars").alias("average_chars"),
    )
    values = spark.read.schema("value string, kind string").parquet(f"{path}/values")
    once = values.agg(*[F.count_if(F.col("kind") == k).alias(n) for k, n in (("chapter", "chapters_identified"), ("section", "sections_identified"), ("page", "total_pages"), ("citation", "unique_citations"))])
    return sums.join(once, F.lit(True))  # two single rows


def page_sizes(pages: DataFrame, doc_col: str = "doc_id", first: int = 3, n: int = 200) -> DataFrame:
    """(doc, pages, chars, head): page count, characters of the first pages, and the start of their joined text."""
    early = F.when(F.col("page_number") <= first, F.struct("page_number", "text"))
    out = pages.groupBy(doc_col).agg(F.count("*").alias("pages"), F.sum(F.when(F.col("page_number") <= first, F.length("text"))).alias("chars"), F.array_sort(F.collect_list(early)).alias("r"))
    return out.select(doc_col, "pages", "chars", F.substring(F.array_join(F.col("r.text"), ""), 1, n).alias("head"))
