"""The stored index, passages and explanations against plain loops."""

import math
import random
import re
from collections import Counter

import pytest

from docweave.operators import retrieval


def words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(60)]
    weights = [1 / (i + 1) for i in range(60)]
    rows = [(i, ", ".join(rng.choices(vocabulary, weights, k=rng.randint(0, 150)))) for i in range(300)]
    return [*rows, (300, None), (301, "..."), (302, "w59 W59\tw3\nw58")]


def plain(corpus, query, k):
    """(total, [(id, score, parts)]) by the formula."""
    counts = {i: Counter(words(t)) for i, t in corpus}
    n, mean = len(counts), sum(sum(c.values()) for c in counts.values()) / len(counts)
    out = []
    for i, c in counts.items():
        parts = {}
        for t in dict.fromkeys(words(query)):
            if c[t]:
                df = sum(t in x for x in counts.values())
                idf = math.log(1 + (n - df + 0.5) / (df + 0.5))
                parts[t] = idf * c[t] * 2.5 / (c[t] + 1.5 * (0.25 + 0.75 * sum(c.values()) / mean))
        if parts:
            out.append((i, round(sum(parts.values()), 6), parts))
    return len(out), sorted(out, key=lambda r: (-r[1], r[0]))[:k]


def passage(text, query, size):
    """The best run by trying every start."""
    asked, parts = set(words(query)), re.split(r"[ \t\n\r\f]+", text or "")
    held = [set(words(w)) & asked for w in parts]
    starts = [i for i, h in enumerate(held) if h]
    best = max(starts, key=lambda i: (len(set().union(*held[i : i + size])), sum(map(len, held[i : i + size])), -i), default=0)
    return " ".join(f"**{w}**" if h else w for w, h in zip(parts[best : best + size], held[best : best + size], strict=True))


def test_stored_index_explained(spark, tmp_path, corpus):
    docs = spark.createDataFrame(corpus, "doc_id long, text string")
    index = retrieval.bm25_index(docs.repartition(3), path=str(tmp_path / "i"))
    again = retrieval.open_bm25_index(spark, str(tmp_path / "i"))
    assert (again.n, again.avgdl) == (index.n, index.avgdl) and index.n == len(corpus)
    asked = [(0, "w0 w5 w40"), (1, "W59 w58!"), (2, "nothing here"), (3, "")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    got = {(r.query_id, r["rank"]): r for r in retrieval.explained_bm25(queries, again, 4, n_terms=2).collect()}
    short = {(r.query_id, r["rank"]): (r.doc_id, r.score) for r in retrieval.bm25(queries, again, 4).collect()}
    assert short == {k: (r.doc_id, r.score) for k, r in got.items()}
    for q, text in asked:
        total, want = plain(corpus, text, 4)
        assert [(got[q, i + 1].doc_id, got[q, i + 1].total_found) for i in range(len(want))] == [(i, total) for i, _, _ in want]
        for place, (_, score, parts) in enumerate(want):
            row = got[q, place + 1]
            assert row.score == pytest.approx(score, abs=2e-6)
            top = sorted(parts.items(), key=lambda p: (-round(p[1], 6), p[0]))[:2]
            said = [(s.rsplit(" ", 2)[0], int(s.rsplit(" ", 2)[1])) for s in row.relevance_explanation.split(", ")]
            assert [t for t, _ in said] == [t for t, _ in top]
            assert all(abs(p - 100 * parts[t] / sum(parts.values())) <= 0.51 for t, p in said)
    assert sorted(q for q, _ in got) == [0] * 4 + [1] * min(plain(corpus, "W59 w58!", 4)[0], 4)


def test_a_search_opens_its_terms_folders(spark, tmp_path, corpus):
    index = retrieval.bm25_index(spark.createDataFrame(corpus, "doc_id long, text string"), path=str(tmp_path / "i"))
    terms = spark.createDataFrame([("w1",), ("w2",)], "term string")
    plan = index.of(index.postings, terms)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan or "PartitionFilters: [isnotnull(bucket" in plan
    assert {r.term for r in index.of(index.postings, terms).select("term").distinct().collect()} == {"w1", "w2"}
    with pytest.raises(FileNotFoundError):
        retrieval.open_bm25_index(spark, str(tmp_path / "none"))


def test_passages(spark, corpus):
    asked = [(0, "w0 w5 w40"), (1, "w59 W58"), (2, "absent")]
    queries = spark.createDataFrame(asked, "query_id int, query string")
    found = spark.createDataFrame([(q, i, t) for q, _ in asked for i, t in corpus[::7] + corpus[-3:]], "query_id int, doc_id long, document string")
    for size in (1, 6, 500):
        for r in retrieval.best_passages(found, queries, words=size).collect():
            assert r.highlighted_content == passage(r.document, asked[r.query_id][1], size), (r, size)
