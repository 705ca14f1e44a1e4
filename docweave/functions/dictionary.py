"""Concept dictionaries as tables: thousands of keywords in one pass over a text.

A dictionary is a table (concept, keyword) and, if the order of concepts matters,
``place``. A concept is found where one of its keywords stands in the text, in
any case, within words too, as ``text.concepts`` has it for a few keywords.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import patterns as P

#: Characters of the keywords that one automaton holds; larger dictionaries take several.
AUTOMATON_CHARS = 4 << 20


def from_mapping(spark: SparkSession, concepts: dict[str, list[str]] | None = None) -> DataFrame:
    """(concept, keyword, place) of a mapping; the built-in one by default."""
    rows = [(name, w, n) for n, (name, words) in enumerate((concepts or P.CONCEPTS).items()) for w in words]
    return spark.createDataFrame(rows, "concept string, keyword string, place int")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """A dictionary stored as CSV with a header, JSON lines or Parquet."""
    end = path.rstrip("/").rsplit(".", 1)[-1]
    return spark.read.csv(path, header=True) if end == "csv" else spark.read.json(path) if end in ("json", "jsonl") else spark.read.parquet(path)


def _parts(entries: list[tuple[str, int]]) -> Iterator[list[tuple[str, int]]]:
    part, size = [], 0
    for word, number in entries:
        part.append((word, number))
        size += len(word)
        if size >= AUTOMATON_CHARS:
            yield part
            part, size = [], 0
    if part:
        yield part


def _finder(entries: list[tuple[str, int]]):
    """Numbers of the concepts with a keyword in the folded texts."""

    @F.pandas_udf("array<int>")
    def find(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        numbers: dict[str, set[int]] = {}
        for word, n in entries:
            numbers.setdefault(word, set()).add(n)
        always = numbers.pop("", set())
        automaton = ahocorasick.Automaton()
        for word, those in numbers.items():
            automaton.add_word(word, tuple(those))
        automaton.make_automaton()
        search = automaton.iter if numbers else lambda _: ()
        for texts in batches:
            yield pd.Series([[] if t is None else sorted(always.union(*(those for _, those in search(t)))) for t in texts], dtype=object)

    return find


def concept_finder(dictionary: DataFrame):
    """A function from a text column to the array of its concepts, in the order
    of ``place`` (of names without it). The dictionary is read by the driver."""
    place = F.min("place") if "place" in dictionary.columns else F.lit(0)
    kept = dictionary.where("concept is not null and keyword is not null")
    names = [r.concept for r in kept.groupBy("concept").agg(place.alias("p")).orderBy("p", "concept").collect()]
    number = {name: n for n, name in enumerate(names)}
    words = sorted((r.w, number[r.concept]) for r in kept.select("concept", F.lower("keyword").alias("w")).distinct().collect())
    finders = [_finder(part) for part in _parts(words)]
    known = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")

    def found(text: Column) -> Column:
        if not finders:
            return known
        hits = [find(F.lower(text)) for find in finders]
        every = hits[0] if len(hits) == 1 else F.array_sort(F.array_distinct(F.flatten(F.array(*hits))))
        return F.transform(every, lambda n: F.get(known, n))

    return found


def tagged(df: DataFrame, dictionary: DataFrame, text_col: str = "text", name: str = "legal_concepts") -> DataFrame:
    """``df`` with the concepts of its texts; a null text has none."""
    return df.withColumn(name, concept_finder(dictionary)(F.col(text_col)))
