"""Benchmark decontamination over a distributed positional inverted index.

Training documents are dealt into shards; each shard is one row of an index
table with the postings (term, positions) of the terms that occur in the test
items. A window of 13 consecutive item words (an item of fewer words is one
window) is looked up from its rarest term: that term's positions, less the
term's place in the window, are the candidate starts, and each further term's
positions, from rare to common, are intersected with them. A near match has the
rarest term in its place and each other one within ``slop`` words of its own.

Words: A-Z lowered, runs of other bytes than ASCII punctuation and spaces.

Defined cases: a null or empty text has no words and no hits; a null item text
has no windows; items with a null id count as hits but are in no list; items
that share an id count once; a document's repeated rows are judged each on
their own; columns besides the named ones are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.llm.shared import keep, small_batches
from docweave.llm.textbuf import Words, give_back, pieces

WINDOW = 13
#: Places by which a term may stand off in a near match, in the registered query.
SLOP = 1
#: Bytes of a block of test items as it is broadcast: for each item word 13, and its ids.
BLOCK_BYTES = 16 << 20
#: Different words of the test items that share an index, in bytes; a larger test
#: set is searched in groups, each with an index of its own.
VOCABULARY_BYTES = 64 << 20
#: Windows looked up at once.
AT_ONCE = 50_000


@dataclass
class Terms:
    """A block of test items: their words as numbers of the vocabulary, one
    window for each entry of ``start``."""

    codes: np.ndarray  # int32, the items' words one after another
    start: np.ndarray  # int32, a window's first word
    width: np.ndarray  # uint8, its words
    item: np.ndarray  # int32, number of its item's id
    ids: list  # item ids; None where the id is null


def _words(rows: list) -> Iterator[tuple[int, int, Words]]:
    for lo, hi, raw, off in pieces(pa.array([t for _, t in rows], pa.string())):
        yield lo, hi, Words(raw, off)


def read_vocabulary(rows: list) -> np.ndarray:
    """The sorted term hashes of (item_id, text) pairs."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *(w.hash for _, _, w in _words(rows))]))


def read_groups(blocks: Iterator[list]) -> list[tuple[int, np.ndarray]]:
    """(blocks, vocabulary) of each group: as many blocks, in their order, as
    have few enough different words; one block always has."""
    groups: list[tuple[int, np.ndarray]] = []
    for rows in blocks:
        own = read_vocabulary(rows)
        both = np.union1d(groups[-1][1], own) if groups else own
        if groups and both.nbytes <= VOCABULARY_BYTES:
            groups[-1] = groups[-1][0] + 1, both
        else:
            groups.append((1, own))
    return groups


def read_items(rows: list, vocabulary: np.ndarray, width: int = WINDOW) -> Terms:
    """Terms of (item_id, text) pairs."""
    codes, starts, widths, owners = [], [], [], []
    ids = list(dict.fromkeys(i for i, _ in rows))
    number = {i: n for n, i in enumerate(ids)}
    at = 0
    for lo, hi, words in _words(rows):
        codes.append(np.searchsorted(vocabulary, words.hash).astype(np.int32))
        for r in range(hi - lo):
            first, n = int(words.first[r]) + at, int(words.count[r])
            if n:
                windows = max(n - width + 1, 1)
                starts.append(np.arange(first, first + windows, dtype=np.int32))
                widths.append(np.full(windows, min(n, width), np.uint8))
                owners.append(np.full(windows, number[rows[lo + r][0]], np.int32))
        at += len(words.hash)
    join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts])
    return Terms(join(codes, np.int32), join(starts, np.int32), join(widths, np.uint8), join(owners, np.int32), ids)


INDEX = "shard long, ids binary, n_words array<long>, terms array<int>, ends array<long>, positions binary"


def _index(vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = vocabulary.value
        part, n = TaskContext.get().partitionId(), 0
        for batch in batches:
            for lo, hi, raw, off in pieces(batch.column(1)):
                words = Words(raw, off)
                at = np.searchsorted(vocab, words.hash)
                at[at == len(vocab)] = 0
                hit = np.flatnonzero(vocab[at] == words.hash) if len(vocab) else np.zeros(0, np.int64)
                term = at[hit]
                order = np.argsort(term, kind="stable")
                terms, counts = np.unique(term, return_counts=True)
                ids = pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo)], names=["id"])
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, ids.schema) as w:
                    w.write_batch(ids)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([(part << 32) | n], pa.int64()),
                        pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                        pa.array([words.count.astype(np.int64)], pa.list_(pa.int64())),
                        pa.array([terms.astype(np.int32)], pa.list_(pa.int32())),
                        pa.array([np.cumsum(counts)], pa.list_(pa.int64())),
                        pa.array([hit[order].astype("<i4").tobytes()], pa.binary()),
                    ],
                    names=["shard", "ids", "n_words", "terms", "ends", "positions"],
                )
                n += 1
        give_back()

    return run


def build_index(docs: DataFrame, vocabulary: np.ndarray, id_col: str, text_col: str) -> DataFrame:
    """The index table: one row for each shard of about a MB of text."""
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)
    return keep(docs.select(id_col, F.col(text_col).cast("string")).mapInArrow(_index(sent), INDEX), "postings")


def term_counts(index: DataFrame) -> DataFrame:
    """(term, n) over the whole corpus."""
    sizes = F.expr("transform(ends, (e, i) -> e - if(i = 0, 0, ends[i - 1]))")
    each = index.select(F.explode(F.arrays_zip(F.col("terms").alias("term"), sizes.alias("n"))).alias("x"))
    return each.groupBy(F.col("x.term").alias("term")).agg(F.sum("x.n").alias("n"))


def _search(plan, corpus_counts, slop: int, width: int, id_name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (items, rare), counts_of = plan.value, corpus_counts.value
        rare_term = items.codes[items.start + rare]
        for batch in batches:
            for row in range(batch.num_rows):
                counts = np.asarray(batch.column(2)[row].values, np.int64)
                terms = np.asarray(batch.column(3)[row].values, np.int64)
                ends = np.asarray(batch.column(4)[row].values, np.int64)
                pos = np.frombuffer(batch.column(5)[row].as_buffer(), "<i4").astype(np.int64)
                docs = pa.ipc.open_stream(batch.column(1)[row].as_buffer()).read_all().column(0).combine_chunks()
                total = int(counts.sum())
                first = np.concatenate(([0], np.cumsum(counts)))
                begin = np.concatenate(([0], ends[:-1])) if len(ends) else ends
                # The postings inverted once: which term stands at a position.
                stands = np.full(total + 1, -2, np.int64)
                stands[pos] = np.repeat(terms, ends - begin)
                doc_of = np.repeat(np.arange(len(counts)), counts)
                # Where a window's rarest term has its postings in this shard, if it does.
                posting = np.minimum(np.searchsorted(terms, rare_term), max(len(terms) - 1, 0))
                mark = np.zeros(total + 1, np.int64)
                found = [(np.zeros(0, np.int64),) * 4]
                have_all = np.flatnonzero(terms[posting] == rare_term) if len(terms) else posting[:0]
                for at in range(0, len(have_all), AT_ONCE):
                    have = have_all[at : at + AT_ONCE]
                    wide = items.width[have].astype(np.int64)
                    grid = items.start[have, None].astype(np.int64) + np.minimum(np.arange(width), wide[:, None] - 1)
                    grid = np.where(np.arange(width) < wide[:, None], items.codes[grid], -1)
                    # From the rarest term of a window to the commonest; what is past its end comes last.
                    order = np.argsort(np.where(grid >= 0, counts_of[grid], np.iinfo(np.int64).max), axis=1, kind="stable")
                    slot = posting[have]
                    n = (ends - begin)[slot]
                    win = np.repeat(np.arange(len(have)), n)
                    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
                    start = pos[np.repeat(begin[slot], n) + inner] - order[win, 0]
                    near_win, near_start = win, start
                    ok = (start >= 0) & (start + wide[win] <= total)
                    win, start = win[ok], start[ok]
                    ok = doc_of[start] == doc_of[start + wide[win] - 1]
                    win, start = win[ok], start[ok]
                    for j in range(1, width):
                        place = order[win, j]
                        want = grid[win, place]
                        ok = (want < 0) | (stands[np.minimum(start + place, total)] == want)
                        win, start = win[ok], start[ok]
                    np.add.at(mark, start, 1)
                    np.add.at(mark, start + wide[win], -1)
                    home = near_win[:0]
                    if slop:
                        # Proximity: the rarest term stands, every other within slop of its place.
                        home = doc_of[near_start + order[near_win, 0]]
                        for j in range(1, width):
                            place = order[near_win, j]
                            want = grid[near_win, place]
                            ok = want < 0
                            for s in range(-slop, slop + 1):
                                p = near_start + place + s
                                fits = (p >= 0) & (p < total)
                                p = np.clip(p, 0, max(total - 1, 0))
                                ok |= fits & (stands[p] == want) & (doc_of[p] == home)
                            near_win, near_start, home = near_win[ok], near_start[ok], home[ok]
                    found.append((doc_of[start], items.item[have[win]], home, items.item[have[near_win]] if slop else home))
                hit_doc, hit_item, near_doc, near_item = (np.concatenate(x) for x in zip(*found, strict=True))
                covered = np.concatenate(([0], np.cumsum(np.cumsum(mark)[:total] > 0)))
                n_hit = covered[first[1:]] - covered[first[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(counts), batch.column(0)[row].as_py()), pa.int64()),
                        pa.array(np.arange(len(counts)), pa.int64()),
                        docs,
                        pa.array(counts),
                        pa.array(n_hit.astype(np.int64)),
                        _positions(covered, first),
                        _lists(hit_doc, hit_item, items.ids, len(counts)),
                        _lists(near_doc, near_item, items.ids, len(counts)),
                    ],
                    names=["shard", "row", id_name, "n_words", "n_hit", "hit_positions", "items", "near_items"],
                )
        give_back()

    return run


def _positions(covered: np.ndarray, first: np.ndarray) -> pa.Array:
    """The hit word positions of each document, from 0."""
    at = np.flatnonzero(np.diff(covered))
    cut = np.searchsorted(at, first)
    inner = at - np.repeat(first[:-1], np.diff(cut))
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(inner.astype(np.int32)))


def _lists(doc: np.ndarray, item: np.ndarray, ids: list, rows: int) -> pa.Array:
    both = np.unique(np.column_stack([doc, item]), axis=0) if len(doc) else np.zeros((0, 2), np.int64)
    both = both[[ids[i] is not None for i in both[:, 1]]] if len(both) else both
    cut = np.searchsorted(both[:, 0], np.arange(rows + 1))
    return pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array([str(ids[i]) for i in both[:, 1]], pa.string()))


def _counts(index: DataFrame, vocabulary: np.ndarray) -> np.ndarray:
    """Corpus counts of the vocabulary's terms, which are bounded in number."""
    n = np.zeros(len(vocabulary), np.int64)
    for r in term_counts(index).toLocalIterator():
        n[r.term] = r.n
    return n


def _plan(spark: SparkSession, items: Terms, counts: np.ndarray):
    """The block with the place of each window's rarest term, for the executors."""
    rare = np.zeros(len(items.start), np.uint8)
    for at in range(0, len(rare), AT_ONCE):
        start, wide = items.start[at : at + AT_ONCE, None].astype(np.int64), items.width[at : at + AT_ONCE, None].astype(np.int64)
        place = np.arange(int(wide.max()))
        here = counts[items.codes[start + np.minimum(place, wide - 1)]]
        rare[at : at + AT_ONCE] = np.where(place < wide, here, np.iinfo(np.int64).max).argmin(axis=1)
    return spark.sparkContext.broadcast((items, rare))


def _blocks(benchmark: DataFrame, id_col: str, text_col: str) -> Iterator[list]:
    """Item rows in blocks of bounded size, streamed to the driver."""
    block, size = [], 0
    for r in benchmark.select(F.col(id_col).alias("i"), F.col(text_col).cast("string").alias("t")).toLocalIterator():
        block.append((r.i, r.t))
        # A word has two bytes at least with its space.
        size += 13 * ((len((r.t or "").encode()) + 1) // 2) + 64
        if size > BLOCK_BYTES:
            yield block
            block, size = [], 0
    if block:
        yield block


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", width: int = WINDOW, slop: int = 0
) -> DataFrame:
    """(id, n_words, n_hit, items, near_items, hit_positions) for each document.

    n_hit counts the document's words inside exact occurrences of windows;
    items are the ids (as strings) of items with one; near_items those whose
    window terms all stand within ``slop`` words of their places (empty where
    slop is 0). A test set is searched in blocks of BLOCK_BYTES.
    """
    spark = docs.sparkSession
    small_batches(spark)
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = f"shard long, row long, id {id_type}, n_words long, n_hit long, hit_positions array<int>, items array<string>, near_items array<string>"
    found, blocks = [], _blocks(benchmark, item_col, item_text_col)
    for size, vocabulary in read_groups(_blocks(benchmark, item_col, item_text_col)) or [(1, np.zeros(0, np.uint64))]:
        # The documents are read once for a group: its blocks search the same shards.
        index = build_index(docs, vocabulary, id_col, text_col)
        counts = _counts(index, vocabulary)
        sent = spark.sparkContext.broadcast(counts)
        for _ in range(size):
            items = read_items(next(blocks, []), vocabulary, width)
            found.append(index.mapInArrow(_search(_plan(spark, items, counts), sent, slop, width, "id"), schema))
    out = found[0]
    if len(found) > 1:
        for more in found[1:]:
            out = out.union(more)
        flat = [F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("hit_positions", "items", "near_items")]
        out = out.groupBy("shard", "row").agg(F.first("id").alias("id"), F.first("n_words").alias("n_words"), *flat).withColumn("n_hit", F.size("hit_positions").cast("long"))
    return out.select(F.col("id").alias(id_col), "n_words", "n_hit", "items", "near_items", "hit_positions")


def contaminated(n_words, n_hit):
    """A document is contaminated where a twentieth of its words is hit."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)


def digest(found: DataFrame, id_col: str = "doc_id", near: bool = False) -> DataFrame:
    """The contract's columns, and with ``near`` the items of near matches, likewise."""
    listed = lambda c: F.sha2(F.array_join(F.array_sort(c), ","), 256)
    more = [F.size("near_items").cast("long").alias("n_near"), listed("near_items").alias("near_sha256")] if near else []
    return found.select(
        id_col, "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), listed("items").alias("items_sha256"), contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"), *more
    )


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = "[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
#: The digest in SQL, by joining every window of the documents with the items' windows.
ORACLE_SQL = f"""
with i as (select item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as w from benchmark),
iw as (select distinct item_id, n, g from (select item_id, least(len(w), {WINDOW}) as n, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') as g
  from (select item_id, w, unnest(range(1, greatest(len(w) - {WINDOW} + 1, 1) + 1)) as k from i where len(w) > 0))),
d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '{_WORD}') as w from documents),
s as (select doc_id, w, n, unnest(range(1, len(w) - n + 2)) as k from d, (select distinct n from iw) where len(w) >= n),
h as (select s.doc_id, k, s.n, item_id from s join iw on s.n = iw.n and array_to_string(w[k:k + s.n - 1], ' ') = iw.g),
c as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(k, k + n)) as p from h) group by doc_id),
m as (select doc_id, list_sort(list(distinct cast(item_id as varchar))) as ids from h group by doc_id),
pt as (select doc_id, pos, w[pos] as term from (select doc_id, w, unnest(range(1, len(w) + 1)) as pos from d) where w[pos] in (select unnest(w) from i)),
cn as (select term, count(*) as c from pt group by term),
wn as (select row_number() over () as wid, item_id, n, string_split(g, ' ') as t from iw),
wt as (select wid, item_id, n, j, t[j] as term from (select *, unnest(range(1, n + 1)) as j from wn)),
ra as (select wid, item_id, n, first(j order by coalesce(c, 0), j) as r, first(term order by coalesce(c, 0), j) as term from wt left join cn using (term) group by wid, item_id, n),
ca as (select wid, item_id, n, doc_id, pos - r as start from ra join pt using (term)),
ne as (select ca.wid, ca.item_id, ca.doc_id, ca.start from ca join wt on ca.wid = wt.wid join pt on pt.doc_id = ca.doc_id and pt.term = wt.term
  and pt.pos between ca.start + wt.j - {SLOP} and ca.start + wt.j + {SLOP} group by ca.wid, ca.item_id, ca.doc_id, ca.start, ca.n having count(distinct wt.j) = ca.n),
nm as (select doc_id, list_sort(list(distinct cast(item_id as varchar))) as near from ne group by doc_id)
select d.doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, cast(coalesce(len(ids), 0) as bigint) as n_items,
  sha256(coalesce(array_to_string(ids, ','), '')) as items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated,
  cast(coalesce(len(near), 0) as bigint) as n_near, sha256(coalesce(array_to_string(near, ','), '')) as near_sha256
from d left join c on d.doc_id = c.doc_id left join m on d.doc_id = m.doc_id left join nm on d.doc_id = nm.doc_id"""
