"""Near matches against plain loops, and test sets of several groups."""

import os
import random
import re
import subprocess
import sys
from collections import Counter

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.llm import decontaminate
from docweave.llm.shared import BATCH_BYTES, small_batches

DOC, ITEM = "doc_id long, text string", "item_id long, text string"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())


def near(docs, items, slop, width=13):
    """{doc: items} whose window's rarest term stands and the others are within slop of their places."""
    texts = {i: words(t) for i, t in docs}
    count = Counter(w for ws in texts.values() for w in ws)
    out = {i: set() for i in texts}
    for item, t in items:
        ws = words(t)
        n = min(len(ws), width)
        for k in range(max(len(ws) - width + 1, 1) if ws else 0):
            window = ws[k : k + n]
            rare = min(range(n), key=lambda j: (count[window[j]], j))
            for i, ts in texts.items():
                for p, w in enumerate(ts):
                    start = p - rare
                    if w == window[rare] and all(window[j] in ts[max(start + j - slop, 0) : max(start + j + slop + 1, 0)] for j in range(n)):
                        out[i].add(str(item))
    return out


@pytest.fixture(scope="module")
def case():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)]
    items = [(n, " ".join(rng.choices(vocabulary, k=k))) for n, k in enumerate([20, 30, 13, 5, 1, 14])] + [(7, None), (8, "...")]
    docs = []
    for i in range(90):
        ws = rng.choices(vocabulary, k=rng.randint(0, 40))
        own = words(items[i % 6][1])
        for _ in range(i % 3):  # swapped neighbours, a word more or less
            j = rng.randrange(max(len(own) - 1, 1))
            kind = rng.randrange(3)
            own = own[:j] + (own[j : j + 2][::-1] if kind == 0 else ["extra", *own[j : j + 2]] if kind == 1 else own[j + 1 : j + 2]) + own[j + 2 :]
        docs.append((i, " ".join(own + ws if i % 4 == 0 else ws + own)))
    return [*docs, (98, None), (99, "w1")], items


@pytest.mark.parametrize("slop", [1, 3])
def test_near_matches(spark, case, slop):
    docs, items = case
    found = decontaminate.decontaminate(spark.createDataFrame(docs, DOC).repartition(3), spark.createDataFrame(items, ITEM), slop=slop).collect()
    want = near(docs, items, slop)
    assert {r.doc_id: set(r.near_items) for r in found} == want
    assert all(set(r["items"]) <= want[r.doc_id] for r in found) and sum(len(want[r.doc_id]) > len(r["items"]) for r in found) > 5


def test_a_test_set_of_several_groups(spark, case, monkeypatch):
    docs, items = case
    d, b = spark.createDataFrame(docs, DOC), spark.createDataFrame(items, ITEM)
    rows = lambda: sorted(map(tuple, decontaminate.digest(decontaminate.decontaminate(d, b, slop=1), near=True).collect()))
    whole = rows()
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 100)
    several = decontaminate.read_groups(decontaminate._blocks(b, "item_id", "text"))
    assert [n for n, _ in several] == [len(list(decontaminate._blocks(b, "item_id", "text")))]
    assert rows() == whole
    monkeypatch.setattr(decontaminate, "VOCABULARY_BYTES", 8 * 30)
    assert len(decontaminate.read_groups(decontaminate._blocks(b, "item_id", "text"))) > 2
    assert rows() == whole


def test_a_batch_of_large_rows_is_bounded_in_bytes(spark):
    # 40 rows of 200 KB in one task: the shards of an index are as large and more.
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    try:
        spark.conf.unset(name)
        small_batches(spark)
        rows = spark.range(40).coalesce(1).select(F.expr("repeat('x', 200000)").alias("text"))
        sizes = rows.mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.nbytes])], names=["n"]) for b in batches), "n long").collect()
        assert sum(r.n for r in sizes) >= 8_000_000 and max(r.n for r in sizes) <= BATCH_BYTES + 500_000
        spark.conf.set(name, "5m")
        small_batches(spark)
        assert spark.conf.get(name) == "5m"
    finally:
        spark.conf.set(name, before)


def test_workers_do_not_load_pandas():
    # Each worker of an executor would hold it for itself.
    code = "import docweave.llm.decontaminate, docweave.llm.near_dedup, docweave.llm.toxicity, sys; print('pandas' in sys.modules)"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(decontaminate.__file__) + "/../..", capture_output=True, text=True).stdout.strip() == "False"
