"""Lexical and hybrid search, context and prompt assembly, answers."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.functions import text as X
from docweave.sources import store

TOKEN = r"[\p{L}\p{N}]+"
K1, B = 1.5, 0.75


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


#: Folders that an index deals its terms to.
BUCKETS = 64
#: Documents that are scored together, about; the share of them from which on a
#: term's gains are a row of a matrix; cells of a matrix.
DOCUMENTS, OFTEN, CELLS = 8192, 0.02, 1 << 20
#: Words of a passage.
PASSAGE = 40
_SPACES = r"[ \t\n\r\f]+"


@dataclass
class Bm25Index:
    """An inverted index: postings (term, id, dl, tf, bucket) in folders by the
    hash of the term, so that a search opens its terms' folders only; the terms
    (term, df, bucket), likewise, if they are stored; and the corpus' totals."""

    postings: DataFrame
    n: int
    avgdl: float
    terms: DataFrame | None = None

    def of(self, table: DataFrame, terms: DataFrame) -> DataFrame:
        """The rows of postings or terms whose term is among kept terms (term)."""
        if "bucket" in table.columns:
            wanted = [r[0] for r in terms.select(_bucket(F.col("term")).alias("b")).distinct().collect()]  # BUCKETS numbers at most
            table = table.where(F.col("bucket").isin(wanted))
        return table.join(store.maybe_broadcast(terms.select("term").distinct(), 64), "term", "left_semi")


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, dl, term, tf): each text's different words (id, w) with their counts;
    a text without words has one row with a null term."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            words = part.column(1)
            size = np.asarray(pa.compute.list_value_length(words)).astype(np.int32)
            coded = words.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(size)), size)
            key, tf = np.unique(row * max(len(coded.dictionary), 1) + np.asarray(coded.indices), return_counts=True)
            row, code = np.divmod(key, max(len(coded.dictionary), 1))
            bare = np.flatnonzero(size == 0)
            row, tf = np.concatenate([row, bare]), np.concatenate([tf, np.ones(len(bare), np.int64)])
            term = pa.concat_arrays([coded.dictionary.take(pa.array(code)), pa.nulls(len(bare), coded.dictionary.type)])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(size[row]), term, pa.array(tf)], names=["id", "dl", "term", "tf"])


def bm25_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None) -> Bm25Index:
    """Tokenises the documents once and stores their postings, at ``path`` or in
    scratch, with the terms and totals beside them. What is shuffled is one row
    for each document and different term."""
    path = path or f"{store.scratch_dir(docs.sparkSession)}/docweave-postings-{uuid.uuid4().hex}"
    words = docs.select(F.col(id_col).alias("id"), tokens(F.coalesce(F.col(text_col), F.lit(""))).alias("w"))
    tf = words.mapInArrow(_counted, f"id {words.schema['id'].dataType.simpleString()}, dl int, term string, tf long")
    # Frequent terms' folders are written by several tasks, each in the order of terms.
    dealt = tf.withColumn("bucket", _bucket(F.col("term"))).hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "id")
    store.write_table(dealt, path, partition_by=["bucket"])
    postings = docs.sparkSession.read.parquet(path)
    df = postings.where("term is not null").groupBy("bucket", "term").agg(F.count("*").alias("df"))
    store.write_table(df.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term"), f"{path}.terms", partition_by=["bucket"])
    found = open_bm25(postings)
    store.write_table(docs.sparkSession.createDataFrame([(found.n, float(found.avgdl))], "n long, avgdl double"), f"{path}.totals")
    return open_bm25_index(docs.sparkSession, path)


def open_bm25_index(spark: SparkSession, path: str) -> Bm25Index:
    """A stored index; FileNotFoundError if it isn't there or wasn't finished."""
    totals = spark.read.parquet(store.first_existing(spark, f"{path}.totals")).first()
    terms = spark.read.schema("term string, df long, bucket int").parquet(f"{path}.terms")
    return Bm25Index(spark.read.parquet(path), totals.n, totals.avgdl, terms)


def open_bm25(postings: DataFrame) -> Bm25Index:
    """Stored postings with their totals. A document without a token has one row
    with a null term, so it counts; each document's length is read at one row."""
    sums = postings.agg(F.sum(F.when(F.col("term").isNull(), 0).otherwise(F.col("tf"))).alias("length"), F.sum(F.when(F.col("term").isNull(), 1.0).otherwise(F.col("tf") / F.col("dl"))).alias("n")).first()
    n = round(sums["n"] or 0)  # a document's shares of its length add up to one
    return Bm25Index(postings, n, (sums["length"] or 0) / n if n else 0.0)


def _weights(queries: DataFrame, index: Bm25Index) -> DataFrame:
    """(query_id, term, number, idf), kept: the different terms of the queries
    that the index has, each term with a number of its own."""
    asked = store.keep(queries.select("query_id", F.explode(F.array_distinct(tokens(F.col("query")))).alias("term")), "query-terms")
    df = index.of(index.terms, asked) if index.terms is not None else index.of(index.postings, asked).groupBy("term").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.lit(index.n) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    known = store.keep(df.select("term", F.monotonically_increasing_id().alias("number"), idf.alias("idf")), "terms")
    return store.keep(asked.join(known, "term").select("query_id", "term", "number", "idf"), "query-weights")


def _saturated(index: Bm25Index, k1: float, b: float) -> Column:
    """What a posting adds to a score for each unit of its term's idf."""
    return F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.lit(index.avgdl)))


def _hits(index: Bm25Index, weights: DataFrame, k1: float, b: float) -> DataFrame:
    """(id, term, number, gain): the postings of the weights' terms."""
    hits = index.of(index.postings, weights)
    return hits.join(store.maybe_broadcast(weights.select("term", "number").distinct(), 72), "term").select("id", "term", "number", _saturated(index, k1, b).alias("gain"))


def _placed(keys: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """The different keys in rising order, and each row's place among them."""
    every = pa.compute.unique(keys)
    every = every.take(pa.compute.sort_indices(every, null_placement="at_start"))
    return every, np.asarray(pa.compute.index_in(keys, value_set=every)).astype(np.int64)


def _scored(k: int):
    """Scores of a block's documents (id, number, gain) for all queries
    (query_id, number, idf): the k best of each, and how many have a term of it."""

    def run(postings: pa.Table, weights: pa.Table) -> pa.Table:
        kind = [weights.schema.field("query_id"), postings.schema.field("id"), pa.field("score", pa.float64()), pa.field("found", pa.int64())]
        if not postings.num_rows or not weights.num_rows:
            return pa.schema(kind).empty_table()
        ids, doc = _placed(postings.column("id"))
        asked, query = _placed(weights.column("query_id"))
        numbers, term = np.unique(np.asarray(postings.column("number")), return_inverse=True)
        gain, idf = np.asarray(postings.column("gain")), np.asarray(weights.column("idf"))
        wanted = np.asarray(weights.column("number"))
        at = np.minimum(np.searchsorted(numbers, wanted), len(numbers) - 1)
        here = numbers[at] == wanted
        at, query, idf = at[here], query[here], idf[here]
        # Terms of many documents are rows of a matrix, those of few are lists.
        docs, size = len(ids), np.bincount(term, minlength=len(numbers))
        often = np.flatnonzero(size > docs * OFTEN)[: max(CELLS // docs, 1)]
        row = np.full(len(numbers), -1)
        row[often] = np.arange(len(often))
        dense = row[term] >= 0
        matrix = np.bincount(row[term[dense]] * docs + doc[dense], gain[dense], len(often) * docs).reshape(len(often), docs)
        order = np.argsort(term[~dense], kind="stable")
        doc, gain = doc[~dense][order], gain[~dense][order]
        size[often] = 0
        start = np.cumsum(size) - size
        order = np.argsort(query, kind="stable")
        at, query, idf = at[order], query[order], idf[order]
        step, out = max(CELLS // docs, 1), []
        for lo in range(0, len(asked), step):
            n = min(step, len(asked) - lo)
            own = slice(*np.searchsorted(query, [lo, lo + n]))
            a, q, w = at[own], query[own] - lo, idf[own]
            in_row = row[a] >= 0
            scores = np.bincount(q[in_row] * len(often) + row[a[in_row]], w[in_row], n * len(often)).reshape(n, len(often)) @ matrix
            a, q, w = a[~in_row], q[~in_row], w[~in_row]
            many = size[a]
            ends = np.cumsum(many)
            place = np.arange(many.sum()) + np.repeat(start[a] - ends + many, many)
            scores += np.bincount(np.repeat(q, many) * docs + doc[place], np.repeat(w, many) * gain[place], n * docs).reshape(n, docs)
            held = scores > 0
            # Ties of rounded scores go by id, that is by place.
            scores = np.where(held, np.rint(scores * 1e6), -1.0)
            first = min(k, docs)
            edge = -np.partition(-scores, first - 1, axis=1)[:, first - 1]
            above = np.count_nonzero(scores > edge[:, None], axis=1)
            level = scores == edge[:, None]
            level &= np.cumsum(level, axis=1) <= (first - above)[:, None]
            at_q, at_d = np.nonzero(((scores > edge[:, None]) | level) & held)
            found = np.where(np.diff(at_q, prepend=-1) > 0, np.count_nonzero(held, axis=1)[at_q], 0)
            out.append((at_q + lo, at_d, scores[at_q, at_d] / 1e6, found))
        at_q, at_d, scores, found = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.Table.from_arrays([asked.take(pa.array(at_q)), ids.take(pa.array(at_d)), pa.array(scores), pa.array(found)], schema=pa.schema(kind))

    return run


def _sums(hits: DataFrame, weights: DataFrame, n: int, k: int) -> DataFrame:
    """(query_id, id, score, found): the k best documents at least of each query;
    ``found`` adds up to the documents with a term of the query.

    Documents are dealt to blocks of about DOCUMENTS by the hash of their ids;
    each block is scored for all queries by one product, so what is shuffled is
    the postings of the queries' terms, the queries once for each block, and k
    rows for each query and block: never a row for a query and a document.
    """
    blocks = -(-max(n, 1) // DOCUMENTS)
    dealt = hits.select(F.pmod(F.xxhash64("id"), F.lit(blocks)).alias("block"), "id", "number", "gain")
    every = weights.select("query_id", "number", "idf").crossJoin(weights.sparkSession.range(blocks).withColumnRenamed("id", "block"))
    kinds = [f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((weights, "query_id"), (hits, "id"))]
    return dealt.groupBy("block").cogroup(every.groupBy("block")).applyInArrow(lambda p, w: _scored(k)(p, w), f"{', '.join(kinds)}, score double, found long")


def _ranked(sums: DataFrame, k: int, id_col: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "id"))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", F.col("id").alias(id_col), "score")


def bm25(queries: DataFrame, docs: DataFrame | Bm25Index, k: int = 5, id_col: str = "doc_id", text_col: str = "text", k1: float = K1, b: float = B) -> DataFrame:
    """(query_id, rank, id, score): Okapi BM25 of queries(query_id, query) over
    documents or their stored index.

    Only postings of the queries' terms leave the scan. Terms of a query count
    once; repeated ids are documents of their own for the totals and one for
    the rank; ties go by id.
    """
    index = docs if isinstance(docs, Bm25Index) else bm25_index(docs, id_col, text_col)
    weights = _weights(queries, index)
    return _ranked(_sums(_hits(index, weights, k1, b), weights, index.n, k), k, id_col)


def explained_bm25(queries: DataFrame, index: Bm25Index, k: int = 5, id_col: str = "doc_id", n_terms: int = 3) -> DataFrame:
    """The rows of :func:`bm25` with ``total_found``, the number of documents
    with a word of the query, and ``relevance_explanation``: the ``n_terms``
    terms that add most to the score, with their shares of it."""
    weights = _weights(queries, index)
    hits = _hits(index, weights, K1, B)
    sums = store.keep(_sums(hits, weights, index.n, k), "scores")
    totals = sums.groupBy("query_id").agg(F.sum("found").alias("total_found"))
    top = store.keep(_ranked(sums, k, id_col).join(totals, "query_id"), "top")
    pairs = top.select("query_id", F.col(id_col).alias("id")).distinct().join(weights, "query_id").select("query_id", "id", "number", "idf")
    own = hits.join(store.maybe_broadcast(pairs, 64), ["id", "number"]).select("query_id", "id", "term", (F.col("idf") * F.col("gain")).alias("part"))
    each = own.groupBy("query_id", "id", "term").agg(F.round(F.sum("part"), 6).alias("part"))
    lists = each.groupBy("query_id", "id").agg(F.sum("part").alias("all"), F.sort_array(F.collect_list(F.struct((-F.col("part")).alias("less"), "term"))).alias("terms"))
    share = lambda t: F.concat(t["term"], F.lit(" "), F.round(-100 * t["less"] / F.col("all")).cast("int").cast("string"), F.lit(" %"))
    said = lists.select("query_id", F.col("id").alias(id_col), F.array_join(F.transform(F.slice("terms", 1, n_terms), share), ", ").alias("relevance_explanation"))
    return top.join(said, ["query_id", id_col])


def best_passages(found: DataFrame, queries: DataFrame, id_col: str = "doc_id", text_col: str = "document", words: int = PASSAGE, before: str = "**", after: str = "**") -> DataFrame:
    """``found`` (query_id, id, document) with ``highlighted_content``: the run of
    ``words`` words that holds most different terms of the query (ties: most
    words that hold one, then the first), each such word between marks.

    A passage begins with a word that holds a term; a document without one
    shows its first words.
    """
    terms = queries.select("query_id", F.array_distinct(tokens(F.col("query"))).alias("__terms"))
    both = found.join(terms, "query_id", "left").withColumn("__words", F.split(F.coalesce(F.col(text_col), F.lit("")), _SPACES, -1))
    each = both.select("query_id", id_col, "__terms", F.posexplode("__words").alias("at", "word"))
    hits = each.select("query_id", id_col, "at", F.explode(F.array_intersect(tokens(F.col("word")), "__terms")).alias("term"))
    ahead = Window.partitionBy("query_id", id_col).orderBy("at").rangeBetween(0, words - 1)
    scored = hits.select("query_id", id_col, F.struct(F.size(F.collect_set("term").over(ahead)).alias("terms"), F.count("*").over(ahead).alias("hits"), (-F.col("at")).alias("first")).alias("run"))
    best = scored.groupBy("query_id", id_col).agg((-F.max("run")["first"]).alias("__start"))
    held = lambda w: F.arrays_overlap(tokens(w), F.coalesce("__terms", F.array().cast("array<string>")))
    shown = F.transform(F.slice("__words", F.coalesce("__start", F.lit(0)) + 1, words), lambda w: F.when(held(w), F.concat(F.lit(before), w, F.lit(after))).otherwise(w))
    out = both.join(best, ["query_id", id_col], "left")
    return out.withColumn("highlighted_content", F.array_join(shown, " ")).drop("__terms", "__words", "__start")


def reciprocal_rank_fusion(*ranked: DataFrame, k: int = 5, id_col: str = "doc_id", c: float = 60.0) -> DataFrame:
    """(query_id, rank, id, score): lists (query_id, rank, id) fused by the sum of 1 / (c + rank)."""
    every = None
    for r in ranked:
        one = r.select("query_id", id_col, (1.0 / (c + F.col("rank"))).alias("part"))
        every = one if every is None else every.union(one)
    sums = every.groupBy("query_id", id_col).agg(F.round(F.sum("part"), 9).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), id_col))
    return sums.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", id_col, "score")


def context(found: DataFrame, by: str = "query_id", joiner: str = "\n\n") -> DataFrame:
    """(query_id, context, documents): documents(rank, document) in rank order."""
    rows = F.array_sort(F.collect_list(F.struct("rank", "document")))
    return found.groupBy(by).agg(rows.alias("r")).select(by, F.array_join(F.col("r.document"), joiner).alias("context"), F.col("r.document").alias("documents"))


def prompt(question: Column, passages: Column) -> Column:
    return F.concat(
        F.lit("Answer from the passages below only. Say so if they hold no answer.\n\nPassages:\n"), passages, F.lit("\n\nQuestion: "), question, F.lit("\nAnswer:")
    )


def extractive(prompts: Column, documents: Column) -> Column:
    """Offline stand-in for a language model: the first passage's preview."""
    return F.coalesce(X.preview(F.get(documents, F.lit(0)), 500), F.lit(""))


def answer(questions: DataFrame, found: DataFrame, generate: Callable[[Column, Column], Column] = extractive, n_sources: int = 3) -> DataFrame:
    """(query_id, question, prompt, answer, sources) for questions(query_id,
    query) and found(query_id, rank, document). ``generate`` makes the answer
    from the prompt and the documents; it may be a pandas UDF around a model."""
    both = questions.join(context(found), "query_id", "left")
    both = both.withColumn("documents", F.coalesce("documents", F.array().cast("array<string>"))).withColumn("prompt", prompt(F.col("query"), F.coalesce("context", F.lit(""))))
    return both.select("query_id", F.col("query").alias("question"), "prompt", generate(F.col("prompt"), F.col("documents")).alias("answer"), F.slice("documents", 1, n_sources).alias("sources"))


def search_cards(found: DataFrame, n: int = 300) -> DataFrame:
    """found(rank, document, citations, concepts, score) as a result page shows it."""
    return found.select(
        "*", X.preview_dots(F.col("document"), n).alias("highlighted_content"), F.slice("citations", 1, 3).alias("top_citations"), F.slice("concepts", 1, 5).alias("legal_terms"),
        F.format_string("rank %d of the fused lists", F.col("rank")).alias("relevance_explanation"),
    )


def search_result(found: DataFrame, took: float = 0.0, kind: str = "hybrid") -> DataFrame:
    """(query_id, results, total_found, search_time, search_type): the envelope
    of a search, its cards as a list in rank order. What was found in all is the
    cards' ``total_found`` if they have it, else their number."""
    card = F.struct("rank", *[c for c in found.columns if c not in ("query_id", "rank", "total_found")])
    total = F.max("total_found") if "total_found" in found.columns else F.count("*").cast("int")
    lists = found.groupBy("query_id").agg(F.array_sort(F.collect_list(card)).alias("results"), total.alias("total_found"))
    return lists.select("query_id", "results", "total_found", F.lit(took).alias("search_time"), F.lit(kind).alias("search_type"))
