import os
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from docweave.llm.line_dedup import MIN_CHARS, SHINGLE, THRESHOLD, dedup_lines, line_classes, signed_lines


def shingles(line):
    """All runs of SHINGLE characters, by a plain loop."""
    return {line[i : i + SHINGLE] for i in range(max(len(line) - SHINGLE + 1, 1))}


def brute(rows):
    """Texts after dropping, by the definition."""
    sets, places = {}, []
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        for n, line in enumerate((t or "").split("\n")):
            x = line.strip(" ").lower()
            if len(x) >= MIN_CHARS:
                places.append((i, n, x))
                sets.setdefault(x, shingles(x))
    root = {x: x for x in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    names = list(sets)
    for i, x in enumerate(names):
        for y in names[:i]:
            both = len(sets[x] & sets[y])
            if both and both / len(sets[x] | sets[y]) >= THRESHOLD:
                root[find(x)] = find(y)
    seen, drop = set(), defaultdict(set)
    for i, n, x in places:
        c = find(x)
        if c in seen:
            drop[i].add(n)
        seen.add(c)
    return {i: None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop[i]) for i, t in rows}


def test_matches_brute_force(spark):
    rng = random.Random(5)
    words = ["".join(rng.choices("abcdefghijklm", k=rng.randint(3, 9))) for _ in range(600)]
    lines = [" ".join(rng.choices(words, k=rng.randint(5, 60))) for _ in range(60)]
    rows = []
    for i in range(60):
        part = []
        for _ in range(rng.randint(1, 6)):
            w = rng.choice(lines).split()
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = rng.choice(words)
            part.append(" ".join(w).capitalize() if rng.random() < 0.3 else " ".join(w))
        rows.append((i, "\n".join(part)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.text for r in dedup_lines(df).collect()}
    assert got == brute(rows)


def test_defined_cases(spark):
    a = "the same long line that is found in several texts"
    b = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(200))
    rows = [(1, f"{a}\nshort\n\nshort"), (2, f"  {a.upper()}\nother words that stand only here"), (3, None), (4, ""), (None, a), (5, a), (6, b), (7, b + "か"), (8, "z" * 30_000), (9, "z" * 29_990 + "!" * 10)]
    df = spark.createDataFrame([(*r, "k", 7, "d") for r in rows], "doc_id long, text string, key string, n_lines int, __dw string")
    got = {r.doc_id: r for r in dedup_lines(df).collect()}
    assert len(got) == len(rows)
    assert got[1].text == rows[0][1] and got[1].n_lines == 4 and got[1].n_dropped == 0
    assert got[2].text == "other words that stand only here" and got[2].n_dropped == 1
    assert got[3].text is None and got[3].n_lines == 0 and got[4].text == "" and got[5].text == "" and got[None].text == ""
    assert got[6].text == b and got[7].text == "" and got[1]["key"] == "k"


def test_repeated_rows_and_empty_table(spark):
    # One line of a component stays, repeated rows or not; which row it is
    # follows from the rows' other columns, not from their order.
    a = "a line that repeats within one document and its copy"
    rows = [(1, f"{a}\n{a}\nend", k) for k in "xyxz"] + [(2, f"{a}!\nshort", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, kind string")
    got = sorted((r.doc_id, r.kind, r.text, r.n_dropped) for r in dedup_lines(df).collect())
    assert Counter((i, t) for i, _, t, _ in got) == {(1, f"{a}\nend"): 1, (1, "end"): 3, (2, "short"): 1}
    assert got == sorted((r.doc_id, r.kind, r.text, r.n_dropped) for r in dedup_lines(df.orderBy("kind", F.desc("doc_id")).repartition(3)).collect())
    assert dedup_lines(df.limit(0)).count() == 0


def test_alike_lines_within_half_alike_families(spark):
    # A template of 31 words and 9 of each line's own; the two lines of a pair
    # differ by two words, and any line of the family may lead their bucket.
    rng = random.Random(11)

    def some(n):
        return ["".join(rng.choices("abcdefghijklm", k=12)) for _ in range(n)]

    rows = []
    for _ in range(5):
        shared = some(31)
        for _ in range(60):
            line = shared + some(9)
            rows.append((len(rows), " ".join(line)))
            line = list(line)
            for k in (35, 38):
                line[k] = some(1)[0]
            rows.append((len(rows), " ".join(line)))
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute(rows)
    assert sum(not t for t in want.values()) >= 300
    assert sum(got[i] != want[i] for i in got) == 0


def test_copies_of_lines_without_spaces(spark):
    # One character more or changed anywhere; other lines differ throughout.
    rng = random.Random(3)
    kinds = ["abcdefgh0123456789\t", "".join(map(chr, range(0x0E01, 0x0E2F))), "".join(map(chr, range(0x1780, 0x17A3))), "abcdef/?&=._-"]
    pairs = []
    for n in range(24):
        letters = kinds[n % 4]
        line = rng.choice(letters[:8]) + "".join(rng.choices(letters, k=300)) + rng.choice(letters[:8])
        at = [0, 1, 150, 301][n // 4 % 4]
        pairs.append((line, line[:at] + "x" + line[at + (n >= 12) :]))
    rows = [(i, t) for i, t in enumerate(t for p in pairs for t in p)]
    for a, b in pairs:
        x, y = ({t[i : i + 12] for i in range(len(t) - 11)} for t in (a, b))
        assert len(x & y) / len(x | y) >= 0.8
    got = {r.doc_id: r.text for r in dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i] == (t if i % 2 == 0 else "") for i, t in rows)


def alike_pairs(lines):
    """All pairs of different lines with a Jaccard index of THRESHOLD or more."""
    sets = sorted(((shingles(x), x) for x in set(lines)), key=lambda p: len(p[0]))
    out = []
    for i, (a, x) in enumerate(sets):
        for b, y in sets[i + 1 :]:
            if len(a) < THRESHOLD * len(b):
                break
            n = len(a & b)
            if n / (len(a) + len(b) - n) >= THRESHOLD:
                out.append((x, y))
    return out


def recall(spark, lines):
    """(share of the alike pairs that end in one class, their number)."""
    df = spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")
    found, classes = line_classes(df, "doc_id", "text", MIN_CHARS, THRESHOLD)
    root = {r.norm: r.root for r in found.join(classes, "node").select("norm", "root").collect()}
    pairs = alike_pairs(lines)
    return sum(root.get(x, x) == root.get(y, y) for x, y in pairs) / len(pairs), len(pairs)


def test_lines_are_dealt_and_normalised_once(spark):
    rows = [(1, "A line that stands twice here\na line that stands twice here \nshort"), (2, "a line that stands only here"), (3, None)]
    df = signed_lines(spark.createDataFrame(rows, "doc_id long, text string"), "doc_id", "text", MIN_CHARS)
    plan = df._jdf.queryExecution().executedPlan().toString().splitlines()
    # The shuffle of the lines, for either side of a join that reads it once; none for signatures.
    assert sum("Exchange hashpartitioning(node" in x for x in plan) == 2 and sum("Exchange" in x for x in plan) == 2
    assert not any("lower(" in x for x in plan if "Filter" in x)
    got = {r.norm: (r.n, r.s0 is not None and r.s24 is not None) for r in df.collect()}
    assert got == {"a line that stands twice here": (2, True), "a line that stands only here": (1, True)}


def test_recall_on_lines_with_one_character_changed(spark):
    rng = random.Random(31)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 9))) for _ in range(2000)]
    lines = []
    for _ in range(400):
        line = " ".join(rng.choices(words, k=60))[: rng.randint(40, 200)].strip()
        at = rng.randrange(len(line))
        lines += [line, line[:at] + ("x" if line[at] != "x" else "y") + line[at + 1 :]]
    share, n = recall(spark, lines)
    assert n > 300 and share >= 0.98


SF = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables")
def test_recall_on_the_tables_lines(spark):
    texts = [r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 500").select("text").collect()]
    lines = [x.strip(" ").lower() for t in texts for x in t.split("\n")]
    share, n = recall(spark, [x for x in lines if len(x) >= MIN_CHARS])
    assert n > 50 and share >= 0.98
