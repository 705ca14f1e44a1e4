"""Whole runs composed of the operators: build, ask, evaluate, compare."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.functions.embed import hashed, with_embedding
from docweave.operators import chunking, evaluate, index, retrieval, vector, vector_index
from docweave.sources import store

#: A search takes queries(query_id, query) and k and returns (query_id, rank, id, document).
Search = Callable[[DataFrame, int], DataFrame]


def build_corpus(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", source: str = "corpus", embed: Callable[[Column], Column] = hashed) -> DataFrame:
    """Clean, split, number, embed and store; returns the stored collection
    (id, document, metadata, embedding). A chunk table with blank chunks still
    in it is stored beside it."""
    cleaned = docs.select(id_col, X.clean_text(F.coalesce(F.col(text_col), F.lit(""))).alias(text_col))
    chunks = index.with_position(chunking.recursive_chunks(cleaned, id_col, text_col), [id_col, "chunk_index"])
    store.write_table(index.flat_records(chunks, source=source), f"{path}/chunks")
    return store.build_collection(index.index_records(chunks, source=source), f"{path}/vectors", lambda r: with_embedding(r, embed=embed))


def build_system(docs: DataFrame, path: str, force_rebuild: bool = False, **options) -> dict:
    """Builds the collection at ``path`` unless it is there; returns the status
    (``built`` or ``present``), the path and the number of records."""
    spark = docs.sparkSession
    there = store.exists(spark, f"{path}/vectors")
    if force_rebuild or not there:
        build_corpus(docs, path, **options)
    return {"status": "present" if there and not force_rebuild else "built", "path": path, "records": store.open_collection(spark, f"{path}/vectors").count()}


def add_records(records: DataFrame, path: str, embed: Callable[[Column], Column] = hashed) -> DataFrame:
    """Embeds records (id, document, metadata) and appends them to a collection."""
    store.write_table(with_embedding(records, embed=embed), path, mode="append")
    return store.open_collection(records.sparkSession, path)


def index_smoke(search: Search, spark, query: str = "What is in this collection?", k: int = 3) -> dict:
    """One query after a build: whether anything comes back, and the previews of what does."""
    rows = search(spark.createDataFrame([(0, query)], "query_id int, query string"), k).orderBy("rank").select("id", X.preview_dots(F.col("document"), 100).alias("preview")).collect()
    return {"ok": bool(rows), "found": len(rows), "ids": [r.id for r in rows], "previews": [r.preview for r in rows]}


def index_collection(collection: DataFrame, path: str, lists: int | None = None) -> vector_index.VectorIndex:
    """Stores the inverted lists of a collection's vectors at ``path``."""
    return vector_index.build_index(collection.select(F.xxhash64("id").alias("vec_id"), "embedding"), path, lists)


def vector_search(collection: DataFrame, embed: Callable[[Column], Column] = hashed, lists: vector_index.VectorIndex | None = None, probes: int = 8) -> Search:
    """Nearest stored vectors of the embedded query: all are compared, or, with
    the collection's inverted ``lists``, those on the lists that are probed."""

    def search(queries: DataFrame, k: int = 5) -> DataFrame:
        numbered = collection.select(F.xxhash64("id").alias("vec_id"), "id", "document", "embedding")
        asked = queries.select(F.col("query_id").cast("long").alias("vec_id"), embed(F.col("query")).alias("embedding"))
        if lists is None:
            found = vector.top_k_batch(asked, numbered.select("vec_id", "embedding"), k)
        else:
            found = vector_index.search(asked, lists, k, probes)
        return found.join(numbered.drop("embedding"), "vec_id").select("query_id", "rank", "id", "document", "distance")

    return search


def lexical_search(collection: DataFrame) -> Search:
    """BM25 over the stored documents."""

    def search(queries: DataFrame, k: int = 5) -> DataFrame:
        found = retrieval.bm25(queries, collection, k, "id", "document")
        return found.join(collection.select("id", "document"), "id").select("query_id", "rank", "id", "document")

    return search


def hybrid_search(collection: DataFrame, embed: Callable[[Column], Column] = hashed, depth: int = 50) -> Search:
    """Both, fused by reciprocal ranks over ``depth`` results of either."""

    def search(queries: DataFrame, k: int = 5) -> DataFrame:
        lists = [vector_search(collection, embed)(queries, depth), lexical_search(collection)(queries, depth)]
        found = retrieval.reciprocal_rank_fusion(*lists, k=k, id_col="id")
        return found.join(collection.select("id", "document"), "id").select("query_id", "rank", "id", "document", "score")

    return search


def search_response(stored: retrieval.Bm25Index, docs: DataFrame, queries: DataFrame, k: int = 5, id_col: str = "doc_id") -> DataFrame:
    """(query_id, results, total_found, search_time, search_type) of a lexical
    search of docs(id, document) by their stored index: each result with its
    score, best passage, citations, terms and what made it relevant; the time is
    that of the whole batch of queries, in seconds, until the results were stored."""
    began = time.perf_counter()
    top = store.maybe_broadcast(store.keep(retrieval.explained_bm25(queries, stored, k, id_col), "found"), 256)
    found = store.keep(docs.select(id_col, F.coalesce("document", F.lit("")).alias("document")).join(top, id_col), "found-documents")
    cards = retrieval.best_passages(found, queries, id_col)
    text = F.col("document")
    cards = cards.select("query_id", "rank", id_col, "score", "total_found", "highlighted_content", F.slice(X.citations(text), 1, 3).alias("citations"), F.slice(X.concepts(text), 1, 5).alias("legal_terms"), "relevance_explanation")
    cards = store.keep(cards, "cards")
    return retrieval.search_result(cards, time.perf_counter() - began, "lexical")


def ask(search: Search, questions: DataFrame, k: int = 5, generate=retrieval.extractive) -> DataFrame:
    """(query_id, question, prompt, answer, sources, legal_citations): the
    citations of the sources and the answer, each once."""
    out = retrieval.answer(questions, search(questions, k), generate)
    return out.withColumn("legal_citations", F.array_distinct(X.citations(F.concat_ws("\n\n", F.array_join("sources", "\n\n"), "answer"))))


def evaluate_search(search: Search, cases: DataFrame, k: int = 5) -> DataFrame:
    """Metrics of each case for what the search returns."""
    found = search(cases.select("query_id", "query"), k)
    text = F.col("document")
    return evaluate.retrieval_metrics(cases, found.select("query_id", text.alias("content"), X.concepts(text).alias("concepts"), X.citations(text).alias("citations")))


def compare_searches(baseline: DataFrame, challenger: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, summary) of two answer tables (query_id, query, latency, answer, citations)."""
    rows = evaluate.compare_variants(baseline, challenger)
    return rows, evaluate.comparison_summary(rows)


def timed_answers(search: Search, questions: DataFrame, k: int = 5, generate=retrieval.extractive) -> DataFrame:
    """Answers with the wall-clock seconds that each question took; questions
    are asked one by one, as a latency needs, so this is for a short list."""
    spark, rows = questions.sparkSession, []
    for q in questions.orderBy("query_id").toLocalIterator():
        began = time.perf_counter()
        one = spark.createDataFrame([(q.query_id, q.query)], "query_id int, query string")
        got = ask(search, one, k, generate).select("answer", "sources").first()
        rows.append((q.query_id, q.query, time.perf_counter() - began, got.answer, got.sources))
    out = spark.createDataFrame(rows, "query_id int, query string, latency double, answer string, sources array<string>")
    return out.withColumn("citations", X.citations(F.array_join("sources", "\n\n")))


def interactive(search: Search, spark, read: Callable[[], str] = input, say: Callable[[str], None] = print) -> None:
    """A loop on the driver: blank lines are skipped, an exit word or the end of input ends it."""
    from docweave.functions.patterns import EXIT_WORDS

    while True:
        try:
            line = read()
        except EOFError:
            return
        if line.strip().lower() in EXIT_WORDS:
            return
        if not line.strip():
            continue
        try:
            got = ask(search, spark.createDataFrame([(0, line)], "query_id int, query string")).first()
            say(got.answer)
            for n, s in enumerate(got.sources, 1):
                say(f"[{n}] {s[:100]}{'...' if len(s) > 100 else ''}")
        except Exception as e:  # a failed question doesn't end the session
            say(f"failed: {e}")
