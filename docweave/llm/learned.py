"""Labelled samples, learned term weights and model scoring, for the classifiers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.features import term_keys
from docweave.llm.shared import keep, maybe_broadcast, small_batches
from docweave.llm.textbuf import Words, give_back, pieces

#: Labelled rows used for fitting at most; they are drawn by a hash of the id.
SAMPLE_ROWS = 20_000


def part_of(id_col, parts: int):
    """crc32 of the id as text, modulo the number of parts; a null id is in part 0."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts, F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, label: str, use, id_col: str, text_col: str, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(id, label, text) of the labelled documents that satisfy ``use``, one row
    for each id (of repeated ids the least text); above ``rows`` of them, a
    sample by a hash of the id, about that many."""
    known = labels.where(F.col(label).isNotNull() & F.col(id_col).isNotNull()).where(use)
    known = known.groupBy(id_col).agg(F.max(F.col(label).cast("int")).alias("label"))
    total = known.count()
    if total > rows:
        known = known.where(F.pmod(F.xxhash64(F.col(id_col), F.lit("sample")), F.lit(1 << 30)) < int((1 << 30) * rows / total))
    # In the order of a hash, so that a rerun fits the same rows.
    known = known.withColumnRenamed(id_col, "id").orderBy(F.xxhash64("id", F.lit("order")), "id").limit(int(rows * 1.1))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    # One row for each id, by a partial aggregate: repeated ids don't widen the
    # sample. It is kept, so that the corpus is read for it once.
    sample = texts.join(maybe_broadcast(keep(known, "labels"), 64), "id").groupBy("id", "label").agg(F.min("text").alias("text"))
    return keep(sample, "labelled")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(kind, term, label): one for each distinct term of a row."""
    for batch in batches:
        label = np.asarray(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        for lo, hi, raw, off in pieces(batch.column(1)):
            words = Words(raw, off)
            for kind, keys in enumerate(term_keys(words)):
                use = keys != 0
                both = np.unique(np.column_stack([words.doc[use].astype(np.uint64), keys[use]]), axis=0)
                mine = label[lo:hi][both[:, 0].astype(np.int64)]
                term = both[:, 1]
                got, at = np.unique(term, return_inverse=True)
                n1 = np.bincount(at, mine, len(got)).astype(np.int64)
                n0 = np.bincount(at, 1 - mine, len(got)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(got), kind), pa.int64()), pa.array(got.view(np.int64)), pa.array(n1), pa.array(n0)], names=["kind", "term", "n1", "n0"])
    give_back()


def term_weights(sample: DataFrame, top: int = 400, least: int = 6, z: float = 4.0) -> list[tuple[np.ndarray, np.ndarray]]:
    """For words and each prefix length: (sorted terms, log-odds) of the terms
    that mark label 1 beyond ``z`` standard errors; at most ``top`` of each."""
    totals = sample.agg(F.sum("label"), F.sum(1 - F.col("label"))).first()
    n1, n0 = float(totals[0] or 0), float(totals[1] or 0)
    out = [(np.zeros(0, np.uint64), np.zeros(0)) for _ in range(6)]
    if not n1 or not n0:
        return out
    counts = sample.select("label", "text").mapInArrow(_terms, "kind long, term long, n1 long, n0 long").groupBy("kind", "term").agg(F.sum("n1").alias("a"), F.sum("n0").alias("b"))
    a, b = F.col("a") + 0.5, F.col("b") + 0.5
    odds = F.log(a / (n1 - F.col("a") + 0.5)) - F.log(b / (n0 - F.col("b") + 0.5))
    error = F.sqrt(1 / a + 1 / b)
    good = counts.where(F.col("a") >= least).withColumn("odds", odds).withColumn("z", odds / error).where(F.col("z") >= z).where("odds >= 1.5")
    rows = good.orderBy(F.desc("z"), "kind", "term").limit(top * 6).collect()
    for kind in range(6):
        mine = sorted((r.term % (1 << 64), r.odds) for r in rows if r.kind == kind)
        out[kind] = (np.array([t for t, _ in mine], np.uint64), np.array([w for _, w in mine]))
    return out


def weigh(keys: np.ndarray, terms: np.ndarray, odds: np.ndarray) -> np.ndarray:
    """Each key's log-odds, 0 for unknown terms."""
    if not len(terms) or not len(keys):
        return np.zeros(len(keys))
    at = np.searchsorted(terms, keys)
    at[at == len(terms)] = 0
    return np.where(terms[at] == keys, odds[at], 0.0)


def gather(sample: DataFrame, extract: Callable) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, features, labels) of a bounded sample, on the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in pieces(batch.column(2)):
                x = extract(raw, off)
                flat = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo).cast(pa.string()), batch.column(1).slice(lo, hi - lo).cast(pa.int64()), flat], names=["id", "label", "x"])
        give_back()

    rows = sample.select("id", "label", "text").mapInArrow(run, "id string, label long, x array<double>").toArrow()
    x = np.asarray(rows.column("x").combine_chunks().flatten() if rows.num_rows else [], float)
    order = np.argsort(np.array(rows.column("id").to_pylist(), dtype=object).astype(str), kind="stable") if rows.num_rows else np.zeros(0, int)
    ids = np.array(rows.column("id").to_pylist(), dtype=object)[order] if rows.num_rows else np.zeros(0, object)
    x = x.reshape(rows.num_rows, -1) if rows.num_rows else np.zeros((0, 0))
    return ids, x[order], rows.column("label").to_numpy()[order]


def scored(docs: DataFrame, score: Callable, id_col: str, text_col: str, keep_cols: list[str] | None = None) -> DataFrame:
    """``docs``' id (and ``keep_cols``) with score(raw, off) of each text."""
    from pyspark.sql import types as T

    small_batches(docs.sparkSession)
    rest = [c for c in (keep_cols or []) if c not in (id_col, "score")]
    frame = docs.select(F.col(text_col).cast("string").alias("__dw_text"), F.col(id_col), *[F.col(f"`{c}`") for c in rest])
    schema = T.StructType([*frame.schema.fields[1:], T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in pieces(batch.column(0)):
                others = [batch.column(i).slice(lo, hi - lo) for i in range(1, batch.num_columns)]
                yield pa.RecordBatch.from_arrays([*others, pa.array(score(raw, off))], names=names)
        give_back()

    return frame.mapInArrow(run, schema)
