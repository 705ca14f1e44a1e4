"""Splitting documents into chunks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.functions import patterns as P
from docweave.functions import text as X

SIZE, OVERLAP = 1000, 200
SEPARATORS = ("\n\n", "\n", " ", "")


def sliding_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP) -> DataFrame:
    """(id, chunk_index, text): windows of ``size`` characters, each beginning
    ``size - overlap`` after the one before; an empty text has one empty chunk."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text_col) - 1, F.lit(0)), F.lit(size - overlap))
    parts = F.transform(starts, lambda p: F.substring(F.col(text_col), p + 1, F.lit(size)))
    return docs.select(id_col, F.posexplode(parts).alias("chunk_index", "text"))


def recursive_split(text: str, size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS, length=len) -> list[str]:
    """Pieces of at most ``size`` where the separators allow it.

    The first separator that occurs splits the text and stays at the head of
    the piece after it; pieces that are too long are split again by the later
    separators. Neighbouring short pieces are joined up to ``size``; the next
    chunk begins with the last pieces of up to ``overlap``. Chunks are
    stripped and empty ones dropped.
    """
    at = next((i for i, s in enumerate(separators) if s == "" or s in text), len(separators) - 1)
    mark, later = separators[at], separators[at + 1 :]
    if mark:
        first, *rest = text.split(mark)
        units = [first, *(mark + r for r in rest)]
    else:
        units = list(text)
    out: list[str] = []
    short: list[str] = []

    def flush() -> None:
        window: list[str] = []
        total = 0
        for u in short:
            n = length(u)
            if window and total + n > size:
                out.append("".join(window).strip())
                while window and (total > overlap or total + n > size):
                    total -= length(window.pop(0))
            window.append(u)
            total += n
        if window:
            out.append("".join(window).strip())
        short.clear()

    for u in units:
        if not u:
            continue
        if length(u) < size:
            short.append(u)
            continue
        flush()
        out += recursive_split(u, size, overlap, later, length) if later else [u]
    flush()
    return [c for c in out if c]


def recursive_chunks(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, overlap: int = OVERLAP, separators: tuple[str, ...] = SEPARATORS, length=len) -> DataFrame:
    """(id, chunk_index, text) by :func:`recursive_split`, in Arrow batches.
    ``length`` measures a text, for instance in a model's tokens."""
    frame = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = frame.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # A few texts at a time become Python's: a batch of them with their chunks is large.
            for lo in range(0, batch.num_rows, 64):
                part = batch.slice(lo, 64)
                every = [recursive_split(t, size, overlap, separators, length) if t else [] for t in part.column(1).to_pylist()]
                row = np.repeat(np.arange(len(every)), [len(c) for c in every])
                number = pa.array([n for c in every for n in range(len(c))], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int64())), number, pa.array([x for c in every for x in c], pa.string())], names=["id", "chunk_index", "text"])

    return frame.mapInArrow(run, f"id {kind}, chunk_index long, text string").withColumnRenamed("id", id_col)


def split_sections(text: Column) -> Column:
    """Parts before chapter lines, then before section lines; stripped, without empty ones."""
    parts = F.flatten(F.transform(F.split(text, P.SPLIT_CHAPTER, -1), lambda c: F.split(c, P.SPLIT_SECTION, -1)))
    return F.filter(F.transform(parts, X.strip), lambda x: x != "")


def sections(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_number", text_col: str = "text") -> DataFrame:
    """(doc, page, section_idx, section_text, chapter, section).

    A chapter or section heading holds until the next one, over pages too; a
    new chapter keeps the section. Both are '' before any heading.
    """
    each = pages.select(doc_col, page_col, F.posexplode(split_sections(F.col(text_col))).alias("section_idx", "section_text"))
    walk = Window.partitionBy(doc_col).orderBy(page_col, "section_idx").rowsBetween(Window.unboundedPreceding, 0)

    def held(pattern: str) -> Column:
        own = F.nullif(F.regexp_extract("section_text", pattern, 1), F.lit(""))
        return F.coalesce(F.last(own, ignorenulls=True).over(walk), F.lit(""))

    return each.withColumn("chapter", held(P.CHAPTER)).withColumn("section", held(P.SECTION))


def semantic_split(text: Column, small: int = 1500, large: int = 1000) -> Column:
    """A section's chunks: itself if it is short and coherent; otherwise its
    paragraphs, joined until the text would be longer than ``large`` and the
    next paragraph has no concept in common. There is no upper bound.

    Paragraphs are looked at once and never joined before the end: of the text so
    far the fold carries its length, its concepts (no keyword spans a paragraph's
    end), whether it holds a defining word, and its last paragraph's number, so
    it is linear in the paragraphs.
    """
    units = F.filter(F.transform(F.split(text, "\n\n", -1), X.strip), lambda p: p != "")
    strings, numbers = "array<string>", "array<int>"
    seen = F.transform(
        units,
        lambda p: F.struct(
            F.length(p).alias("n"), X.concepts(p).alias("k"), p.rlike(P.ELEMENTS).alias("lists"), p.rlike(P.NUMBERED).alias("numbered"),
            (p.contains("means") | p.contains("defined as")).alias("defines"), F.lower(p).contains("example").alias("example"),
        ),
    )
    start = F.struct(F.array().cast(numbers).alias("cuts"), F.lit(0).alias("at"), F.lit(0).alias("n"), F.array().cast(strings).alias("k"), F.lit(False).alias("lists"), F.lit(False).alias("defines"))

    def step(acc: Column, u: Column) -> Column:
        first = acc["at"] == 0
        joined = F.when(first, u["n"]).otherwise(acc["n"] + 2 + u["n"])
        # As text.breaks_unity has it, from what is known of both.
        apart = ~(acc["lists"] & u["numbered"]) & ~(acc["defines"] & u["example"]) & ~F.arrays_overlap(acc["k"], u["k"])
        cut = (joined > large) & apart & ~first
        return F.struct(
            F.when(cut, F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"]).alias("cuts"), (acc["at"] + 1).alias("at"), F.when(cut, u["n"]).otherwise(joined).alias("n"),
            F.when(cut, u["k"]).otherwise(F.array_union(acc["k"], u["k"])).alias("k"), u["lists"].alias("lists"), F.when(cut, u["defines"]).otherwise(acc["defines"] | u["defines"]).alias("defines"),
        )

    ends = F.aggregate(seen, start, step, lambda acc: F.when(acc["at"] > 0, F.concat(acc["cuts"], F.array(acc["at"]))).otherwise(acc["cuts"]))
    bounds = F.transform(F.array(F.struct(ends.alias("ends"), units.alias("units"))), lambda b: F.transform(b["ends"], lambda e, i: F.array_join(F.slice(b["units"], _before(b["ends"], i) + 1, e - _before(b["ends"], i)), "\n\n")))
    whole = (F.length(text) < small) & X.coherent(text, X.concepts(text), X.citations(text))
    # Where nothing can be cut, no paragraph is looked at.
    uncut = (F.length(text) <= large) | (F.size(units) <= 1)
    joined = F.when(F.size(units) > 0, F.array(F.array_join(units, "\n\n"))).otherwise(F.array().cast(strings))
    return F.when(whole, F.array(text)).when(uncut, joined).otherwise(bounds[0])


def _before(ends: Column, i: Column) -> Column:
    """The end before the i-th one."""
    return F.when(i == 0, F.lit(0)).otherwise(F.get(ends, i - 1))


def legal_chunks(pages: DataFrame, doc_col: str = "doc_id", page_col: str = "page_number", text_col: str = "text") -> DataFrame:
    """Annotated chunks of all pages: (doc, page_number, section_idx, chunk_idx,
    content, chapter, section, subsection, citations, legal_concepts,
    document_type, confidence_score)."""
    each = sections(pages, doc_col, page_col, text_col)
    chunks = each.select(doc_col, page_col, "section_idx", "chapter", "section", F.posexplode(semantic_split(F.col("section_text"))).alias("chunk_idx", "content"))
    chunks = chunks.withColumn("citations", X.citations(F.col("content"))).withColumn("legal_concepts", X.concepts(F.col("content")))
    return chunks.select(
        doc_col, page_col, "section_idx", "chunk_idx", "content", "chapter", "section", F.lit(None).cast("string").alias("subsection"), "citations", "legal_concepts",
        F.lit("unknown").alias("document_type"), X.chunk_quality(F.col("content"), F.col("citations"), F.col("legal_concepts")).alias("confidence_score"),
    )
