"""Quality classifier: histogram gradient-boosted trees over document statistics.

The statistics are shape only (lengths, character classes, repetition, lines,
distinct words), so the score does not follow topics. The trees lie in flat
arrays and all rows of a piece walk down together in numpy.

Defined cases: a null text is scored as an empty one, an empty text has a
score like any other; repeated rows are scored each on their own, equal texts
alike; a very long text is one row of statistics; without labels of both kinds
all scores are the smoothed base rate; an empty table gives an empty one; extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.features import statistics
from docweave.llm.gbt import fit
from docweave.llm.learned import SAMPLE_ROWS, gather, labelled, part_of, scored

THRESHOLD = 0.3


def extract(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    return statistics(raw, off)[0]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", use=None, rows: int = SAMPLE_ROWS):
    """score(raw, off) fitted on labelled rows that satisfy ``use``."""
    _, x, y = gather(labelled(docs, labels, label, F.lit(True) if use is None else use, id_col, text_col, rows), extract)
    if not len(y) or y.min() == y.max():
        rate = (float(y.sum()) + 0.5) / (len(y) + 1.0)
        return lambda raw, off: np.full(len(off) - 1, rate)
    forest = fit(x, y, trees=100, depth=4, rate=0.1)
    return lambda raw, off: forest.probability(extract(raw, off))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", use=None, keep_cols: list[str] | None = None) -> DataFrame:
    """The id (and ``keep_cols``) with ``score`` for each document."""
    return scored(docs, train(docs, labels, id_col, text_col, use=use), id_col, text_col, keep_cols)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns: labels of a fifth of the ids are never used."""
    held = part_of(id_col, 5) == 0
    out = quality(docs, labels, id_col, text_col, use=~held)
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
