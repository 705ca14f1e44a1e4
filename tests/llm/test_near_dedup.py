import os
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docweave.llm import shared
from docweave.llm.near_dedup import bag_signatures, keep_first_of_class, multiset_jaccard, near_dedup
from docweave.llm.shared import components
from docweave.llm.textbuf import Words, pieces, shingles

SCHEMA = "doc_id long, text string"


def _words(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choices("abcdefghij", k=6)) for _ in range(n)]


def test_words_follow_rows_and_letters():
    texts = ["Ab, c-é 9", None, "", "x\x00Y", "...", "end"]
    for lo, hi, raw, off in pieces(pa.array(texts), limit=6, rows=3):
        w = Words(raw, off)
        found = [bytes(w.mapped[a:b]).decode() for a, b in zip(w.start, w.end)]
        want = [x for t in texts[lo:hi] for x in {"Ab, c-é 9": ["ab", "c", "é", "9"], "x\x00Y": ["x", "y"], "end": ["end"]}.get(t, [])]
        assert found == want


def test_equal_words_hash_equal_wherever_they_stand():
    raw = np.frombuffer(b"token other token", np.uint8)
    h = Words(raw, np.array([0, len(raw)])).hash
    assert h[0] == h[2] != h[1]


def test_shingles_of_few_words():
    raw = np.frombuffer(b"a b ca b c d e f", np.uint8)
    doc, sh = shingles(Words(raw, np.array([0, 5, 5, 16])), 5)
    assert doc.tolist() == [0, 2, 2] and len(set(sh.tolist())) == 3


@pytest.mark.parametrize("heavy", [1, 7])
def test_bag_signatures_estimate_weighted_jaccard(heavy):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 2**54, 300, dtype=np.uint64)
    count = rng.integers(1, heavy + 1, 300)
    other = np.maximum(count + rng.integers(-1, 2, 300), 0)
    use = other > 0
    doc = np.concatenate([np.zeros(300, np.int64), np.ones(int(use.sum()), np.int64)])
    sig = bag_signatures(2, doc, np.concatenate([base, base[use]]), np.concatenate([count, other[use]]), 4096)
    true = np.minimum(count, other).sum() / np.maximum(count, other).sum()
    assert abs((sig[0] == sig[1]).mean() - true) < 0.04
    assert (sig != 0).all()


def test_multiset_jaccard():
    assert multiset_jaccard(np.array([1, 1, 2]), np.array([1, 2, 2])) == 0.5
    assert multiset_jaccard(np.array([]), np.array([])) == 0.0


def test_components_of_chains_stars_and_loops(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, i) for i in range(101, 140)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and all(got[i] == 100 for i in range(100, 140))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("few", [True, False])
def test_components_of_few_edges_shuffle_only_aggregates(spark, monkeypatch, few):
    plans, keep = [], shared.keep

    def kept(df, label):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, label)

    monkeypatch.setattr(shared, "keep", kept)
    if not few:
        monkeypatch.setattr(shared, "FEW_BYTES", 0)
    rng = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 60)] + [(200, i) for i in range(201, 240)] + [(rng.randrange(300, 360), rng.randrange(300, 360)) for _ in range(60)] + [(300, i) for i in range(340, 360)]
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    try:
        assert {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()} == root
    finally:
        spark.conf.set(name, before)
    # The first plan makes the edges of the pass that follows.
    assert len(plans) > 2 and all(("SortMergeJoin" not in x) == few for x in plans[1:])


def _brute(rows):
    bags = []
    for _, t in rows:
        w = [x.lower() for x in (t or "").split()]
        bags.append(Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))) if w else Counter())
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            both, any_ = sum((bags[i] & bags[j]).values()), sum((bags[i] | bags[j]).values())
            if any_ and both / any_ >= 0.8:
                a, b = label[i], label[j]
                label = [min(a, b) if x in (a, b) else x for x in label]
    return label


def test_classes_match_brute_force_and_defined_cases(spark):
    rows = []
    for d in range(12):
        base = _words(60, d)
        for v in range(4):
            w = list(base)
            for k in range(v):
                w[10 + 17 * k] = f"new{d}{v}{k}"
            rows.append((len(rows), " ".join(w)))
    rows += [(200, None), (201, ""), (202, "..."), (203, "one two"), (204, "One two"), (205, "one two three"), (206, " ".join(["again"] * 4000)), (207, " ".join(["again"] * 3500)), (3, rows[3][1])]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, bucket string, class_id int")
    got = near_dedup(df).collect()
    label = _brute(rows)
    first = {}
    for (i, _), c in zip(rows, label):
        first[c] = min(first.get(c, i), i)
    want = Counter((i, first[c] if (t or "").strip(".") else i) for (i, t), c in zip(rows, label))
    assert Counter((r.doc_id, r.class_id) for r in got) == want
    assert sum(r.kept for r in got) == len({c for _, c in want})
    kept = keep_first_of_class(df)
    assert kept.columns == df.columns and kept.count() == sum(r.kept for r in got)


def test_null_ids_and_empty_table(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "a b c d e f"), (None, None)], SCHEMA)
    got = near_dedup(df).collect()
    assert sorted((r.doc_id is None, r.kept) for r in got) == [(False, True), (True, False), (True, True)]
    assert near_dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_large_group_of_near_copies_is_one_class(spark):
    base = _words(120, 99)
    rows = []
    for i in range(400):
        w = list(base)
        w[(i * 7) % 120] = f"edit{i}"
        rows.append((i, " ".join(w)))
    got = near_dedup(spark.createDataFrame(rows, SCHEMA))
    assert got.where("kept").count() == 1 and got.agg(F.max("class_size")).first()[0] == 400


def test_alike_texts_within_half_alike_families(spark):
    # Families share a passage of 85 % of their windows (0.74 of each other),
    # so that any text of the family may lead a bucket; bands of one slot make
    # all alike texts share one.
    rows, rng = [], random.Random(4)
    for d in range(4):
        shared = _words(170, 1000 + d)
        for v in range(50):
            own = _words(30, 5000 + 100 * d + v)
            rows.append((len(rows), " ".join(shared + own)))
            own[rng.randrange(12, 18)] = "edit"
            own[5] = "edit"
            rows.append((len(rows), " ".join(shared + own)))
    got = {r.doc_id: r.class_id for r in near_dedup(spark.createDataFrame(rows, SCHEMA), band_rows=1, bands=6).collect()}
    assert all(got[2 * i] == got[2 * i + 1] for i in range(len(rows) // 2))


def test_what_a_lead_leaves_open_is_judged_whatever_its_number(spark):
    # One bucket of 200 sets that are 0.5 alike, and pairs of 0.9 among them.
    from docweave.llm import shared

    sets = {}
    for i in range(100):
        sets[2 * i] = set(range(20)) | {1000 + 50 * i + k for k in range(10)}
        sets[2 * i + 1] = (sets[2 * i] - {1000 + 50 * i}) | {1000 + 50 * i + 40}

    def judge(edges):
        rows = [(r.a, r.b, len(sets[r.a] & sets[r.b]) / len(sets[r.a] | sets[r.b])) for r in edges.collect()]
        judged.append(len(rows))
        return shared.keep(spark.createDataFrame(rows, "a long, b long, similarity double"), "judged")

    def tokens(nodes):
        return spark.createDataFrame([(r.node, t) for r in nodes.collect() for t in sets[r.node]], "node long, token long")

    judged = []
    _, classes = shared.linked(spark.createDataFrame([(1, n) for n in sets], "bucket long, node long"), judge, tokens, 0.8)
    root = {r.node: r.root for r in classes.collect()}
    assert root == {n: n // 2 * 2 for n in sets} and sum(judged) < 1000


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_alike_texts_of_the_tables_share_a_class(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    bags = []
    for r in docs.collect():
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), r.text or ""))
        if w:
            bags.append((r.doc_id, Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))))
    bags = sorted(((sum(b.values()), i, b) for i, b in bags), key=lambda x: x[:2])
    pairs = []
    for k, (n, i, a) in enumerate(bags):
        for m, j, b in bags[k + 1 :]:
            if n < 0.8 * m:
                break
            if len(a.keys() & b.keys()) >= 0.5 * len(a):
                both = sum((a & b).values())
                if both / (n + m - both) >= 0.8:
                    pairs.append((i, j))
    got = {r.doc_id: r.class_id for r in near_dedup(docs).collect()}
    assert len(pairs) > 50 and sum(got[i] == got[j] for i, j in pairs) >= 0.99 * len(pairs)


def test_repeated_rows_keep_one_whatever_their_order(spark):
    rows = [(1, "a b c d e f g", k) for k in "xyz"] + [(2, "a b c d e f g", "w"), (None, None, "n"), (None, None, "n")]
    df = spark.createDataFrame(rows, SCHEMA + ", kind string")
    one = sorted(map(str, keep_first_of_class(df).collect()))
    two = sorted(map(str, keep_first_of_class(df.orderBy(F.desc("kind")).repartition(3)).collect()))
    assert one == two and len(one) == 3 and sum("doc_id=1" in r for r in one) == 1


def test_long_sets_that_one_hot_bucket_leaves_open(spark):
    """Thousands of tokens a set: no row holds a set's tokens or all its rare ones."""
    from docweave.llm import shared

    rng = np.random.default_rng(6)
    families = [rng.integers(0, 1 << 40, 1200) for _ in range(3)]
    sets = {}
    for i in range(90):
        own = np.concatenate([families[i % 3], rng.integers(0, 1 << 40, 700)])
        sets[2 * i] = set(own.tolist())
        sets[2 * i + 1] = (set(own.tolist()) - set(own[: 100 if i % 2 else 300].tolist())) | set(rng.integers(0, 1 << 40, 100 if i % 2 else 300).tolist())
    pairs = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    table = spark.createDataFrame([(n, list(v)) for n, v in sets.items()], "node long, set array<long>")
    table = shared.keep(table, "sets")

    def judge(edges):
        one, two = table.toDF("a", "x"), table.toDF("b", "y")
        both = edges.join(one, "a").join(two, "b").withColumn("n", F.size(F.array_intersect("x", "y")))
        return shared.keep(both.select("a", "b", (F.col("n") / (F.size("x") + F.size("y") - F.col("n"))).alias("similarity")), "judged")

    def tokens(nodes):
        return table.join(nodes, "node", "left_semi").select("node", F.explode("set").alias("token"))

    links, classes = shared.linked(spark.createDataFrame([(1, n) for n in sets], "bucket long, node long"), judge, tokens, 0.8, paired=4)
    assert {(r.a, r.b) for r in links.collect()} == pairs and len(pairs) == 45
    root = {r.node: r.root for r in classes.collect()}
    assert all(root[a] == root[b] for a, b in pairs) and len(root) == 90
