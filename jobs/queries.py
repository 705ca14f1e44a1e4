"""The jobs as registered queries: each runs twice into one new folder of the
shared scratch space and returns the whole output as it then stands."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave import queries as documents
from docweave.sources.store import scratch_dir
from jobs import embed_new_documents, publish_chunks


def _folder(spark: SparkSession, name: str) -> str:
    return f"{scratch_dir(spark)}/docweave-{name}-{uuid.uuid4().hex}"


def job1_publish_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published chunks with the report's figures of their source and language."""
    output = _folder(spark, "job1")
    for _ in range(2):
        publish_chunks.run(spark, f"{sf_dir}/documents.parquet", output)
    chunks, report = publish_chunks.published(spark, output)
    same = [F.col(c).eqNullSafe(F.col(f"of_{c}")) for c in publish_chunks.PARTS]
    both = chunks.join(report.withColumnsRenamed({c: f"of_{c}" for c in publish_chunks.PARTS}), same[0] & same[1])
    lists = [F.array_join(c, " ; ").alias(c) for c in ("citations", "legal_concepts")]
    return both.select(
        "source", "lang", "doc_id", "section_idx", "chunk_idx", "content", "chapter", "section", *lists, F.round("confidence_score", 6).alias("confidence_score"),
        "n_chunks", "n_documents", "n_cited", "n_with_concepts", F.round("mean_score", 6).alias("mean_score"),
    )


_CLEANED = f"legal as (select doc_id, 1 as page_number, {documents.clean_sql('text')} as text from (select doc_id, coalesce(text, '') as text from documents))"
_PUBLISHED = f"""with {documents.chunks_sql(_CLEANED)},
good as (select nullif(d.source, '') as source, nullif(d.lang, '') as lang, s.* from scored s join documents d using (doc_id) where confidence_score >= 0.25),
report as (select source, lang, count(*) as n_chunks, count(distinct doc_id) as n_documents, count(*) filter (len(citations) > 0) as n_cited,
  count(*) filter (len(legal_concepts) > 0) as n_with_concepts, round(avg(confidence_score), 6) as mean_score from good group by all)
select g.source, g.lang, doc_id, section_idx, chunk_idx, content, chapter, section, array_to_string(citations, ' ; ') as citations,
  array_to_string(legal_concepts, ' ; ') as legal_concepts, round(confidence_score, 6) as confidence_score, n_chunks, n_documents, n_cited, n_with_concepts, mean_score
from good g join report r on g.source is not distinct from r.source and g.lang is not distinct from r.lang"""


def job2_embed_new_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the size and length of their vectors."""
    output = _folder(spark, "job2")
    for _ in range(2):
        embed_new_documents.run(spark, f"{sf_dir}/documents.parquet", f"{output}/store", f"{output}/checkpoint")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    out = embed_new_documents.current(spark, f"{output}/store")
    return out.select("doc_id", "chunk_index", "text", "text_key", "batch", "embedded", F.size("embedding").alias("dim"), F.round(norm, 4).alias("norm"))


_EMBEDDED = f"""with d as (select doc_id, {documents.clean_sql('text')} as t from (select doc_id, coalesce(text, '') as text from documents)),
p as (select doc_id, t, unnest(generate_series(0, greatest(len(t) - 1, 0), 800)) as p from d),
c as (select doc_id, cast(p // 800 as int) as chunk_index, substr(t, cast(p + 1 as bigint), 1000) as text from p)
select *, sha256(text) as text_key, cast(0 as bigint) as batch, cast(0 as bigint) as embedded, cast(64 as int) as dim,
  case when regexp_matches(text, '[\\p{{L}}\\p{{N}}]') then cast(1 as double) else cast(0 as double) end as norm from c"""

QUERIES = {
    "job1_publish_chunks": (job1_publish_chunks, _PUBLISHED),
    "job2_embed_new_documents": (job2_embed_new_documents, _EMBEDDED),
}
