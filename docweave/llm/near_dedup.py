"""Near-duplicate documents: BagMinHash signatures, banding, verification.

A document is the multiset of its five-word windows (words are runs of
letters and digits, A-Z lowered; a text of fewer words is one window).
Similarity is the weighted Jaccard of those multisets: sum of smaller counts
over sum of larger counts.

Defined cases: a null or empty text, or one without words, resembles nothing
and is a class of its own; rows whose word sequence is equal are one class
whatever their ids; null ids stay as they are (a class of null ids only has a
null class id); columns besides the two named ones are ignored; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import ODD, ODD_COLUMNS, Lanes, keep, linked, maybe_broadcast, one_of_repeats, release, scratch, small_batches
from docweave.llm.textbuf import Words, give_back, mix, pieces, shingles

ROWS, BANDS = 6, 20
SLOTS = ROWS * BANDS
_EMPTY = np.float64(np.inf)
#: Lanes of 4 bits, one for each slot. Texts at 0.8 differ in 22.5 of 120 on
#: average, with a deviation of 4.3; those that differ in more than APART are
#: taken as not alike, which loses two in a thousand at 0.8.
LANE_BITS = 4
APART = 35


def _counted(doc: np.ndarray, shingle: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle id of 54 bits, count), by row and id; under 1024 rows."""
    key = np.sort((doc.astype(np.uint64) << np.uint64(54)) | (shingle >> np.uint64(10)))
    if not len(key):
        return np.zeros(0, np.int64), key, np.zeros(0, np.int64)
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    count = np.diff(np.append(at, len(key)))
    key = key[at]
    return (key >> np.uint64(54)).astype(np.int64), key & np.uint64((1 << 54) - 1), count


def _uniform(x: np.ndarray) -> np.ndarray:
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def bag_signatures(rows: int, doc: np.ndarray, shingle: np.ndarray, count: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """BagMinHash of each row: (rows, slots) of 64-bit values, 0 for no slot.

    Weight is cut into the dyadic intervals [0,1), [1,2), [2,4), [4,8)...;
    every (shingle, interval) owns a Poisson process over time whose rate is
    slots * width, and each of its points falls on a slot and on a weight
    within the interval. A bag sees the points below its own weight; a slot's
    value is its earliest point. Two bags agree on a slot with a probability
    of their weighted Jaccard. Points come in order of time, so a process
    stops once its next point is later than all of the bag's slots.
    """
    top = np.where(count > 1, np.ceil(np.log2(np.maximum(count, 1))).astype(np.int64), 0)
    rep = np.repeat(np.arange(len(doc)), top + 1)
    level = np.arange(len(rep)) - np.repeat(np.cumsum(top + 1) - (top + 1), top + 1)
    low = np.where(level > 0, 2.0 ** (level - 1), 0.0)
    width = np.where(level > 0, low, 1.0)
    own, weight = doc[rep], count[rep].astype(np.float64)
    seed = mix(shingle[rep] * np.uint64(0xD1342543DE82EF95) + level.astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D) + np.uint64(1))

    best = np.full(rows * slots, _EMPTY)
    mark = np.zeros(rows * slots, np.uint64)
    now, step, block = np.zeros(len(seed)), 0, 1
    while len(seed):
        turn = np.arange(step + 1, step + block + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        r = mix(seed[:, None] + turn[None, :])
        gaps = -np.log(_uniform(r)) / (slots * width)[:, None]
        t = now[:, None] + np.cumsum(gaps, axis=1)
        r2 = mix(r ^ np.uint64(0xA0761D6478BD642F))
        slot = (r2 % np.uint64(slots)).astype(np.int64)
        place = low[:, None] + width[:, None] * _uniform(mix(r2))
        at = own[:, None] * slots + slot
        good = (place < weight[:, None]) & (t < best[at])
        # Of the points that meet on a slot, the earliest stays.
        gi, gt, gm = at[good], t[good], r2[good]
        if len(gi):
            np.minimum.at(best, gi, gt)
            won = best[gi] == gt
            mark[gi[won]] = gm[won]
        limit = best.reshape(rows, slots).max(axis=1)
        now = t[:, -1]
        alive = now < limit[own]
        seed, now, own, weight, low, width = (x[alive] for x in (seed, now, own, weight, low, width))
        step += block
        block = 8 if len(seed) > 2000 else 64
    return mark.reshape(rows, slots)


def _lanes(sig: np.ndarray) -> np.ndarray:
    """The slots' hashes cut to LANE_BITS, packed into longs."""
    per = 64 // LANE_BITS
    wide = np.zeros((len(sig), -(-sig.shape[1] // per) * per), np.uint64)
    wide[:, : sig.shape[1]] = mix(sig) & np.uint64((1 << LANE_BITS) - 1)
    at = np.arange(per, dtype=np.uint64) * np.uint64(LANE_BITS)
    return np.bitwise_or.reduce(wide.reshape(len(sig), -1, per) << at, axis=2).view(np.int64)


def _sketch(id_col: str, k: int, band_rows: int, bands: int):
    slots = band_rows * bands
    salt = mix(np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x8CB92BA72F3D8DD7))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0), batch.column(1)
            for lo, hi, raw, off in pieces(batch.column(2)):
                words = Words(raw, off)
                doc, sh = shingles(words, k)
                d, s, c = _counted(doc, sh)
                sig = bag_signatures(hi - lo, d, s, c, slots)
                acc = np.zeros((hi - lo, bands), np.uint64)
                for j in range(band_rows):
                    acc = mix(acc + sig[:, j::band_rows] + np.uint64(j + 1))
                band = mix(acc + salt).view(np.int64)
                # The word sequence's own key: position-dependent sum.
                place = np.arange(len(words.hash)) - np.repeat(words.first[:-1], words.count)
                each = mix(words.hash + mix(place.astype(np.uint64) + np.uint64(7)))
                total = np.zeros(len(each) + 1, np.uint64)
                np.cumsum(each, out=total[1:])
                seq = mix(total[words.first[1:]] - total[words.first[:-1]] + words.count.astype(np.uint64)).view(np.int64)
                lists = [pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32)), pa.array(x.reshape(-1))) for x in (band, _lanes(sig))]
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(lo, hi - lo), keys.slice(lo, hi - lo), pa.array(seq), pa.array(words.count.astype(np.int64)), *lists],
                    names=["id", "text_key", "seq_key", "n_words", "bands", "lanes"],
                )
        give_back()

    return run


def _bags(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, raw, off in pieces(batch.column(1)):
                doc, sh = shingles(Words(raw, off), k)
                key = np.sort((doc.astype(np.uint64) << np.uint64(54)) | (sh >> np.uint64(10)))
                cut = np.searchsorted(key >> np.uint64(54), np.arange(hi - lo + 1, dtype=np.uint64))
                bag = (key & np.uint64((1 << 54) - 1)).astype("<u8")
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array([bag[a:b].tobytes() for a, b in zip(cut[:-1], cut[1:], strict=True)], pa.binary())], names=["node", "bag"]
                )
        give_back()

    return run


def multiset_jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Of two sorted arrays with repeats."""
    if not len(a) or not len(b):
        return 0.0
    ua, ca = np.unique(a, return_counts=True)
    ub, cb = np.unique(b, return_counts=True)
    _, ia, ib = np.intersect1d(ua, ub, assume_unique=True, return_indices=True)
    both = int(np.minimum(ca[ia], cb[ib]).sum())
    return both / (len(a) + len(b) - both)


def _judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        left, right = batch.column(2), batch.column(3)
        sims = [multiset_jaccard(np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")) for x, y in zip(left, right, strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sims, pa.float64())], names=["a", "b", "similarity"])
    give_back()


class _Bags:
    """The multisets of the texts that have been needed so far."""

    def __init__(self, by_text: DataFrame, sig: DataFrame, k: int):
        self.by_text, self.sig, self.k, self.known = by_text, sig, k, None

    def of(self, nodes: DataFrame) -> DataFrame:
        """(node, bag); the few keys go first, so that the scan of whole texts
        meets a small table."""
        if self.known is not None:
            nodes = nodes.join(self.known.select("node"), "node", "left_anti")
        keys = keep(self.sig.select("node", "text_key").join(nodes, "node", "left_semi"), "keys")
        # One text for each key, by an aggregate: copies are never gathered.
        texts = self.by_text.join(maybe_broadcast(keys, 16), "text_key").groupBy("node").agg(F.min("text").alias("text"))
        fresh = keep(texts.mapInArrow(_bags(self.k), "node long, bag binary"), "bags")
        self.known = fresh if self.known is None else self.known.union(fresh)
        return self.known

    def judge(self, edges: DataFrame) -> DataFrame:
        return _judged(edges, self.of(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct()))

    def sketches(self, nodes: DataFrame) -> DataFrame:
        bags = self.of(nodes).join(nodes, "node", "left_semi").select("node", "bag")
        return keep(bags.mapInArrow(_odd, "node long, size long, " + ", ".join(f"{c} long" for c in ODD_COLUMNS)), "sketches")

    def tokens(self, nodes: DataFrame) -> DataFrame:
        return self.of(nodes.distinct()).join(nodes, "node", "left_semi").select("node", "bag").mapInArrow(_tokens, "node long, token long")


def _judged(edges: DataFrame, bags: DataFrame) -> DataFrame:
    """edges(a, b) with the similarity of their multisets."""
    one, two = bags.select(F.col("node").alias("a"), F.col("bag").alias("x")), bags.select(F.col("node").alias("b"), F.col("bag").alias("y"))
    return keep(edges.join(one, "a").join(two, "b").select("a", "b", "x", "y").mapInArrow(_judge, "a long, b long, similarity double"), "judged")


def _tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, token): a bag as a set, each repeat of a window a token of its own."""
    for batch in batches:
        for lo in range(0, batch.num_rows, 200):
            part = batch.slice(lo, 200)
            bags = [np.frombuffer(x.as_buffer(), "<u8") for x in part.column(1)]
            for node, bag in zip(part.column(0).to_pylist(), bags, strict=True):
                turn = np.arange(len(bag)) - np.searchsorted(bag, bag)
                token = mix(bag + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(bag), node, np.int64)), pa.array(token)], names=["node", "token"])
    give_back()


def _odd(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """shared.odd_sketches of bags, by the same tokens as :func:`_tokens`."""
    for batch in batches:
        sizes, maps = [], np.zeros((batch.num_rows, ODD), np.uint64)
        for row, x in enumerate(batch.column(1)):
            bag = np.frombuffer(x.as_buffer(), "<u8")
            turn = np.arange(len(bag)) - np.searchsorted(bag, bag)
            at = mix(bag + turn.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(64 * ODD)
            odd = np.bincount(at.astype(np.int64), minlength=64 * ODD) & 1
            maps[row] = np.packbits(odd.astype(np.uint8), bitorder="little").view("<u8")
            sizes.append(len(bag))
        columns = [pa.array(maps[:, i].copy().view(np.int64)) for i in range(ODD)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), *columns], names=["node", "size", *ODD_COLUMNS])
    give_back()


def near_duplicate_classes(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 5, threshold: float = 0.8, band_rows: int = ROWS, bands: int = BANDS
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(membership, classes, links).

    membership: (id, text_key, seq_key, n_words), one row for each row of
    ``docs``; classes: (node, root) over the seq_keys that have a link; links:
    (a, b, similarity) between seq_keys, verified on the whole multisets.

    Every bucket's nodes are compared with the bucket's lead, and what that
    leaves open is compared too, so that alike texts that share a band end in
    one class (shared.linked). Texts of one class are not all compared.
    """
    small_batches(docs.sparkSession)
    texts = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_key"), F.col(text_col).cast("string").alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    schema = f"id {kind}, text_key long, seq_key long, n_words long, bands array<long>, lanes array<long>"
    member = keep(texts.mapInArrow(_sketch("id", k, band_rows, bands), schema), "members")
    # Equal word sequences are one node, by a partial aggregate.
    nodes = member.where("n_words > 0").groupBy(F.col("seq_key").alias("node")).agg(F.min(F.struct("text_key", "bands", "lanes")).alias("one"))
    width = -(-band_rows * bands * LANE_BITS // 64)
    lanes = Lanes(tuple(f"p{i}" for i in range(width)), LANE_BITS, round(APART * band_rows * bands / SLOTS) if band_rows * bands >= SLOTS else band_rows * bands)
    sig = keep(nodes.select("node", "one.text_key", "one.bands", *[F.col("one.lanes")[i].alias(c) for i, c in enumerate(lanes.columns)]), "nodes")
    have = _Bags(texts.select("text_key", "text"), sig, k)
    links, classes = linked(sig.select("node", F.explode("bands").alias("bucket"), *lanes.columns), have.judge, have.tokens, threshold, lanes, 1024, have.sketches)
    return member, classes, links


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """(id, class_id, class_size, n_links, kept, text_key, worded) for each row of ``docs``.

    class_id is the least id of the class; n_links counts the verified links
    of the row's text to different texts, those to leads and those that the
    leads left open, not all pairs of its class; kept is true for one row of each
    class, the first by id, then by text; of repeated rows one is kept.
    text_key is xxhash64 of the text; worded tells whether it has a word.
    """
    with scratch() as made:
        member, classes, links = near_duplicate_classes(docs, id_col, text_col, **options)
        degree = links.select(F.col("a").alias("node")).union(links.select("b")).groupBy("node").agg(F.count("*").alias("n_links"))
        known = classes.join(degree, "node", "left").select(F.col("node").alias("seq_key"), "root", "n_links")
        # A table of its own, so that the join can split the largest group of copies.
        known = keep(known, "linked")
        rows = member.join(maybe_broadcast(known, 24), "seq_key", "left").select(
            "id", "text_key", (F.col("n_words") > 0).alias("worded"), F.coalesce("root", "seq_key").alias("class_key"), F.coalesce("n_links", F.lit(0)).alias("n_links"), F.monotonically_increasing_id().alias("rank")
        )
        rows = keep(rows, "classed")
    release(made, rows)
    order = F.struct(F.col("id").isNull(), F.col("id"), F.col("text_key"), F.col("rank"))
    firsts = rows.where("worded").groupBy("class_key").agg(F.min(order).alias("first"), F.count("*").alias("class_size"))
    firsts = keep(firsts.select("class_key", F.col("first.id").alias("class_id"), F.col("first.rank").alias("first_rank"), "class_size"), "class-firsts")
    # A table of its own, so that the join can split the largest class.
    out = rows.where("worded").join(maybe_broadcast(firsts, 40), "class_key")
    out = out.select("id", "class_id", "class_size", "n_links", (F.col("rank") == F.col("first_rank")).alias("kept"), "text_key", "worded")
    lone = rows.where("not worded").select("id", F.col("id").alias("class_id"), F.lit(1).cast("long").alias("class_size"), "n_links", F.lit(True).alias("kept"), "text_key", "worded")
    return out.union(lone).withColumnRenamed("id", id_col)


def keep_first_of_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with one row of each near-duplicate class, columns unchanged;
    of repeated rows (equal id and text) that whose columns hash least."""
    key = F.xxhash64(F.col(id_col), F.xxhash64(F.col(text_col)))
    chosen = near_dedup(docs.select(id_col, text_col), id_col, text_col, **options).where("kept")
    chosen = keep(chosen.select(F.xxhash64(F.col(id_col), F.col("text_key")).alias("__dw_key"), F.col("worded").alias("__dw_worded")).distinct(), "chosen")
    both = docs.withColumn("__dw_key", key).join(maybe_broadcast(chosen, 16), "__dw_key")
    names = [F.col(f"`{c}`") for c in docs.columns]
    # Rows without words are classes of their own, repeated ones too.
    return one_of_repeats(both.where("__dw_worded"), "__dw_key").select(*names).union(both.where("not __dw_worded").select(*names))
