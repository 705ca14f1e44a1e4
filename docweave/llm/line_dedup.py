"""Fuzzy line deduplication by MinHash, with DataFrame functions only.

A line is lower-cased and trimmed of spaces. Its shingles are all runs of
SHINGLE characters (UTF-16 units). Two lines are alike if the Jaccard index of
their shingle sets is 0.8 or more.

Equal lines are one node, counted before anything is hashed. Signature: one
permutation hashing; a shingle's hash falls into one of SLOTS cells, a cell's
value is its least hash, and a cell without one borrows from the next ones.
Bands are ROWS slots each, by GROUPS different divisions of the slots. Lines
that share a band are compared with the band's lead by exact Jaccard, and what
that leaves open is compared too (shared.linked); before any comparison, pairs
whose signatures differ in more than APART slots are passed over. Verified
links are joined to components by distributed union-find, and one line of each
component stays: the first by document id, text and line number.

Lines at exactly 0.8 share a band with a chance of 0.98 and pass the
signatures with one of 0.999; lines of one language that are not alike share one
with chances of some 10^-7.

Defined cases: lines under ``min_chars`` characters (blank ones too) and null
texts are left alone; of a document's repeated rows (equal id and text) one
keeps the lines that stay, the others lose all judged lines; null ids order
last; a text whose lines all go becomes empty; other columns, whatever their
names, are kept.
"""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import Lanes, keep, linked, maybe_broadcast, odd_sketches, release, scratch, split_repeats

SHINGLE = 6
SLOTS = 25
ROWS = 5
GROUPS = 4
THRESHOLD = 0.8
MIN_CHARS = 20
#: Slots in which lines may differ and still be compared.
APART = 12
#: Hashes kept for each slot, on average, before the least is taken: a slot
#: loses its value with a chance of e to the minus this.
SPARE = 6
#: Slots that an empty slot looks through for a value.
BORROW = 6
#: Slots of a part of the signature.
PART = 5
_VALUE_BITS = 28
LANES = Lanes(tuple(f"p{i}" for i in range(-(-SLOTS // 8))), 8, APART)


def _divisions() -> list[list[int]]:
    """The slots of each band: GROUPS divisions of all slots into bands of ROWS."""
    draw, out = random.Random(1), []
    for _ in range(GROUPS):
        order = draw.sample(range(SLOTS), SLOTS)
        out += [sorted(order[i : i + ROWS]) for i in range(0, SLOTS, ROWS)]
    return out


def _norm(line: Column) -> Column:
    return F.lower(F.trim(line))


def _doc_key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col), F.col(text_col))


def _split_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(doc, id, line_no, norm) of the judged lines; doc is the hash of id and text."""
    lines = F.posexplode(F.split(F.col(text_col).cast("string"), "\n", -1)).alias("line_no", "line")
    each = docs.select(_doc_key(id_col, text_col).alias("doc"), F.col(id_col).alias("id"), lines)
    # As an array's only item a line is normalised once: else the filter and the columns would do it again.
    return each.select("doc", "id", "line_no", F.explode(F.array(_norm(F.col("line")))).alias("norm")).where(F.length("norm") >= min_chars)


def distinct_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(node, norm, n): each different line with its number, dealt by node."""
    each = _split_lines(docs, id_col, text_col, min_chars).select(F.xxhash64("norm").alias("node"), "norm")
    return each.groupBy("node").agg(F.min("norm").alias("norm"), F.count("*").alias("n"))


def signatures(lines: DataFrame) -> DataFrame:
    """(node, s0, s1, ...): a slot's least hash, null where it has none.

    The shingles of a line are rows only within one task's generated code: where
    lines are dealt by node already, nothing of them is shuffled. A hash that is
    too large to be its slot's least in all likelihood is left out at once. Each
    of the others meets the slots of its own part alone, and parts become one row.
    """
    coded = lines.select("node", F.encode("norm", "UTF-16BE").alias("coded")).withColumn("size", F.greatest(F.expr(f"octet_length(coded) div 2 - {SHINGLE - 1}"), F.lit(1)))
    each = coded.select("node", "size", F.explode(F.expr("sequence(1, 2 * size - 1, 2)")).alias("at"), "coded")
    each = each.select("node", "size", F.expr(f"xxhash64(substring(coded, at, {2 * SHINGLE}))").alias("hash"))
    slot, value = f"cast(shiftright(shiftrightunsigned(hash, 40) * {SLOTS}, 24) as int)", f"cast(hash & {(1 << _VALUE_BITS) - 1} as int)"
    each = each.select("node", "size", F.expr(slot).alias("slot"), F.expr(value).alias("value"))
    few = SPARE * SLOTS
    each = each.where(f"size <= {few} or value < cast({float(few << _VALUE_BITS)}D / size as int)")
    each = each.select("node", F.expr(f"slot div {PART}").cast("int").alias("part"), F.expr(f"slot % {PART}").alias("slot"), "value")
    parts = each.groupBy("node", "part").agg(*[F.expr(f"min(if(slot = {i}, value, null))").alias(f"v{i}") for i in range(PART)])
    return parts.groupBy("node").agg(*[F.expr(f"min(if(part = {i // PART}, v{i % PART}, null))").alias(f"s{i}") for i in range(SLOTS)])


def _filled(signed: DataFrame) -> DataFrame:
    """Empty slots borrow from those after them; the loan is marked by its distance."""
    full = [F.coalesce(F.col(f"s{i}"), *[F.col(f"s{(i + j) % SLOTS}") + (j << _VALUE_BITS) for j in range(1, BORROW + 1)], F.lit(0)).alias(f"s{i}") for i in range(SLOTS)]
    return signed.select("node", *full)


def signed_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int) -> DataFrame:
    """(node, norm, n, s0, s1, ...): the different lines with their filled
    signatures, null for a line without any.

    Lines are dealt by node once: the signatures are made where the lines lie,
    and meet them there (both sides read one shuffle).
    """
    lines = distinct_lines(docs, id_col, text_col, min_chars)
    # The number is asked for so that both sides have the same shuffle.
    return lines.join(_filled(signatures(lines.where("n > 0"))), "node", "left")


def _banded(signed: DataFrame) -> DataFrame:
    """(bucket, node, lanes)."""
    lanes = [F.expr(" | ".join(f"shiftleft(xxhash64(s{8 * k + j}) & 255, {8 * j})" for j in range(min(8, SLOTS - 8 * k)))).alias(c) for k, c in enumerate(LANES.columns)]
    bands = F.array(*[F.xxhash64(F.lit(n), *[F.col(f"s{i}") for i in slots]) for n, slots in enumerate(_divisions())])
    return signed.select(F.explode(bands).alias("bucket"), "node", *lanes)


def _shingles(line: str) -> Column:
    """The hashes of a line's shingles, one for each place. 32 bits hold them: with
    some thousand shingles in a pair, one in thousands of pairs is off by one."""
    # The line is bound as a lambda's variable: else each shingle would encode it anew.
    hashes = f"transform(sequence(1, greatest(octet_length(coded) - {2 * SHINGLE - 1}, 1), 2), at -> hash(substring(coded, at, {2 * SHINGLE})))"
    return F.expr(f"transform(array(encode({line}, 'UTF-16BE')), coded -> {hashes})[0]")


def _judged(edges: DataFrame, texts: DataFrame) -> DataFrame:
    """edges(a, b) with the exact Jaccard index of the lines' sets: what is
    shuffled are lines, and their sets are made where both are."""
    one, two = texts.toDF("a", "one"), texts.toDF("b", "two")
    both = edges.join(one, "a").join(two, "b").select("a", "b", _shingles("one").alias("x"), _shingles("two").alias("y"))
    similarity = F.size(F.array_intersect("x", "y")) / F.size(F.array_union("x", "y"))
    return keep(both.select("a", "b", similarity.alias("similarity")), "line-judged")


class _Texts:
    """The lines that have been needed so far."""

    def __init__(self, lines: DataFrame):
        self.lines, self.known = lines, None

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, norm)."""
        if self.known is not None:
            nodes = nodes.join(self.known.select("node"), "node", "left_anti")
        nodes = keep(nodes, "line-nodes")
        fresh = keep(self.lines.select("node", "norm").join(maybe_broadcast(nodes, 8), "node", "left_semi"), "line-texts")
        self.known = fresh if self.known is None else self.known.union(fresh)
        return self.known

    def judge(self, edges: DataFrame) -> DataFrame:
        return _judged(edges, self.of(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()))

    def sketches(self, nodes: DataFrame) -> DataFrame:
        return keep(odd_sketches(self.tokens(nodes)), "line-sketches")

    def tokens(self, nodes: DataFrame) -> DataFrame:
        own = self.of(nodes.distinct()).join(nodes, "node", "left_semi")
        return own.select("node", F.explode(F.array_distinct(_shingles("norm"))).alias("token"))


def line_classes(docs: DataFrame, id_col: str, text_col: str, min_chars: int, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(lines, classes): lines (node, norm, n) of the different judged lines, classes (node, root) of those that are linked to another."""
    signed = keep(signed_lines(docs, id_col, text_col, min_chars), "lines")
    lines, rows = signed.select("node", "norm", "n"), signed.drop("norm", "n").where("s0 is not null")
    texts = _Texts(lines)
    return lines, linked(_banded(rows), texts.judge, texts.tokens, threshold, LANES, 1024, texts.sketches)[1]


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """(doc, dropped): line numbers to drop for each document that loses any;
    doc is xxhash64 of id and text."""
    with scratch() as made:
        lines, classes = line_classes(docs, id_col, text_col, min_chars, threshold)
        met = lines.select("node", "n").join(maybe_broadcast(classes, 16), "node", "left").where("n > 1 or root is not null")
        met = keep(met.select("node", F.coalesce("root", "node").alias("class")), "line-met")
        # Where these lines stand: the others are of no further interest.
        places = _split_lines(docs, id_col, text_col, min_chars).select(F.xxhash64("norm").alias("node"), "id", "doc", "line_no")
        places = keep(places.join(maybe_broadcast(met, 16), "node").drop("node"), "line-places")
        order = F.struct(F.col("id").isNull(), "id", "doc", "line_no")
        firsts = places.groupBy("class").agg(F.min(order).alias("first")).select("class", F.col("first.doc").alias("first_doc"), F.col("first.line_no").alias("first_no"))
        lost = places.join(maybe_broadcast(keep(firsts, "line-firsts"), 24), "class").where("doc <> first_doc or line_no <> first_no")
        out = keep(lost.groupBy("doc").agg(F.collect_set("line_no").alias("dropped")), "line-dropped")
    return release(made, out)


def _without_lines(docs: DataFrame, lost: DataFrame, text_col: str, repeated: bool, min_chars: int) -> DataFrame:
    """``docs`` (with __dw_doc) without the lines in ``lost``, and counts; of
    repeated rows those that are not marked first lose all judged lines."""
    out = docs.join(lost, "__dw_doc", "left")
    dropped = F.col("__dw_dropped")
    if repeated:
        numbered = F.transform(F.split(F.col(text_col), "\n", -1), lambda x, i: F.when(F.length(_norm(x)) >= min_chars, i))
        dropped = F.when(F.col("__dw_first"), dropped).otherwise(F.filter(numbered, lambda i: i.isNotNull()))
    out = out.withColumn("__dw_dropped", F.when(F.size(dropped) > 0, dropped))
    out = out.withColumn("__dw_lines", F.when(F.col("__dw_dropped").isNotNull(), F.split(F.col(text_col), "\n", -1)))
    left = "array_join(transform(array_except(sequence(0, size(__dw_lines) - 1), __dw_dropped), i -> __dw_lines[i]), '\n')"
    text = F.when(F.col("__dw_dropped").isNull(), F.col(text_col)).otherwise(F.expr(left))
    n_lines = F.coalesce(F.octet_length(text_col) - F.octet_length(F.replace(F.col(text_col), F.lit("\n"), F.lit(""))) + 1, F.lit(0))
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped", "__dw_doc", "__dw_tag", "__dw_first")]
    columns = [text.alias(c) if c == text_col else F.col(f"`{c}`") for c in names]
    return out.select(*columns, n_lines.cast("long").alias("n_lines"), F.coalesce(F.size("__dw_dropped"), F.lit(0)).cast("long").alias("n_dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with the text without its dropped lines, and two columns:
    ``n_lines`` and ``n_dropped``."""
    lost = dropped_lines(docs, id_col, text_col, min_chars, threshold)
    lost = lost.select(F.col("doc").alias("__dw_doc"), F.col("dropped").alias("__dw_dropped"))
    total = lost.agg(F.count("*"), F.coalesce(F.sum(F.size("__dw_dropped")), F.lit(0))).first()
    if 32 * total[0] + 4 * total[1] <= (16 << 20):
        lost = F.broadcast(lost)
    alone, many = split_repeats(docs.withColumn("__dw_doc", _doc_key(id_col, text_col)), "__dw_doc")
    out = _without_lines(alone, lost, text_col, False, min_chars)
    return out if many is None else out.unionByName(_without_lines(many, lost, text_col, True, min_chars))
