"""Toxicity: gradient-boosted trees over dense features, calibrated.

Features of the whole text: densities of a fixed lexicon of insults, of the
terms and word beginnings that the training labels mark, and of words that
turn into insults when digits and symbols are read as letters; second-person
words close to any of these; capitals, punctuation, obfuscation. The trees'
scores are made probabilities by isotonic regression on a third of the
training rows that the trees have not seen.

Defined cases: a null text is scored as an empty one, an empty text has a
score of its own like any other; rows are scored each on their own whatever
their id; without labels of both kinds all scores are the smoothed base rate;
extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm import features as feats
from docweave.llm.gbt import fit, isotonic
from docweave.llm.learned import SAMPLE_ROWS, gather, labelled, part_of, scored, term_weights, weigh
from docweave.llm.textbuf import Words

THRESHOLD = 0.7
NEAR = 3
_LEXICON = feats.word_hashes(feats.INSULTS)
_SECOND = feats.word_hashes(feats.SECOND_PERSON)


def extractor(weights: list[tuple[np.ndarray, np.ndarray]]):
    """features(raw, off) for the given term weights."""

    def run(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        rows = len(off) - 1
        base, _, plain = feats.statistics(raw, off)
        n = np.maximum(plain.count, 1)
        by = lambda v, w=plain: np.bincount(w.doc, v, rows)
        insult = feats._member(plain.hash, _LEXICON)
        second = feats._member(plain.hash, _SECOND)
        folded = Words(raw, off)
        learned = [weigh(k, *w) for k, w in zip(feats.term_keys(folded), weights, strict=True)]
        m = np.maximum(folded.count, 1)
        leet = Words(raw, off, feats._LEET)
        hidden = feats._member(leet.hash, _LEXICON)
        bad_words = insult | (feats._member(plain.hash, weights[0][0]) if len(weights[0][0]) else False)
        # Second person within NEAR words of a bad word.
        close = np.zeros(len(bad_words), bool)
        for j in range(1, NEAR + 1):
            close[j:] |= bad_words[j:] & second[:-j] & (plain.doc[j:] == plain.doc[:-j])
            close[:-j] |= bad_words[:-j] & second[j:] & (plain.doc[j:] == plain.doc[:-j])
        best = np.max(learned, axis=0) if len(folded.hash) else np.zeros(0)
        top = np.zeros(rows)
        np.maximum.at(top, folded.doc, best)
        hits = by((best > 0).astype(float), folded)
        columns = [
            by(insult) / n,
            np.log1p(by(insult)),
            by(learned[0] > 0, folded) / m,
            by(np.max(learned[1:], axis=0) > 0 if len(folded.hash) else best, folded) / m,
            by(best, folded) / m,
            top,
            np.log1p(hits),
            hits / m,
            by(second) / n,
            by(close) / n,
            np.maximum(by(hidden, leet) - by(insult), 0) / np.maximum(leet.count, 1),
        ]
        return np.column_stack([*columns, base])

    return run


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic", use=None, rows: int = SAMPLE_ROWS):
    """score(raw, off) fitted on labelled rows that satisfy ``use``."""
    sample = labelled(docs, labels, label, F.lit(True) if use is None else use, id_col, text_col, rows)
    # The third for calibration is kept from the term weights too.
    third = F.crc32(F.concat(F.lit("calibrate:"), F.col("id").cast("string")).cast("binary")) % 3 == 0
    weights = term_weights(sample.where(~third))
    extract = extractor(weights)
    ids, x, y = gather(sample, extract)
    if not len(y) or y.min() == y.max():
        rate = (float(y.sum()) + 0.5) / (len(y) + 1.0)
        return lambda raw, off: np.full(len(off) - 1, rate)
    fold = np.array([zlib.crc32(f"calibrate:{i}".encode()) % 3 == 0 for i in ids])
    if y[fold].sum() < 5 or y[~fold].sum() < 5:
        fold[:] = False
    forest = fit(x[~fold], y[~fold], trees=60, depth=3)
    hold = fold if fold.any() else ~fold
    knots, values = isotonic(forest.probability(x[hold]), y[hold])

    def score(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        raw_score = forest.probability(extract(raw, off))
        # Ties of the calibration's steps are broken by the trees' own score.
        return np.clip(0.999 * np.interp(raw_score, knots, values) + 0.001 * raw_score, 0.0, 1.0)

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", use=None, keep_cols: list[str] | None = None) -> DataFrame:
    """The id (and ``keep_cols``) with ``score`` for each document."""
    return scored(docs, train(docs, labels, id_col, text_col, use=use), id_col, text_col, keep_cols)


def judged(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The contract's columns: labels of a third of the ids are never used."""
    held = part_of(id_col, 3) == 1
    out = toxicity(docs, labels, id_col, text_col, use=~held)
    return out.select(id_col, held.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
