import random

import pytest
from pyspark.sql import functions as F

from docweave.functions import config, embed
from docweave.operators import chunking, evaluate, index, retrieval, vector
from docweave.plans import lifecycles
from docweave.sources import store
from docweave.streaming import ingest


# --- chunking ---
def test_sections_carry_headings(spark):
    text = "Intro\nCHAPTER 1: A\nSection 1.1 X\nbody\n§ 2 Y\nCHAPTER 2: B"
    rows = chunking.sections(spark.createDataFrame([(1, 1, text), (1, 2, "next page"), (2, 1, "other")], "doc_id long, page_number int, text string")).orderBy("doc_id", "page_number", "section_idx").collect()
    assert [(r.section_text, r.chapter, r.section) for r in rows] == [
        ("Intro", "", ""), ("CHAPTER 1: A", "1", ""), ("Section 1.1 X\nbody\n§ 2 Y", "1", "1.1"), ("CHAPTER 2: B", "2", "1.1"), ("next page", "2", "1.1"), ("other", "", ""),
    ]


def test_semantic_chunks_fold_by_concepts(spark):
    part = lambda w: (w + " " + "x" * 600)[:600]
    text = "\n\n".join([part("arrest"), part("arrest"), part("magistrate")])
    pages = spark.createDataFrame([(1, 1, text)], "doc_id long, page_number int, text string")
    got = chunking.legal_chunks(pages).orderBy("chunk_idx").collect()
    assert [len(r.content) for r in got] == [1202, 600]
    assert got[0].legal_concepts == ["arrest"] and got[0].document_type == "unknown" and got[0].subsection is None


def test_recursive_split():
    text = "para one.\n\n" + "word " * 500 + "\n\n" + "y" * 2500 + "\n\nend"
    parts = chunking.recursive_split(text)
    assert all(0 < len(p) <= 1000 for p in parts)
    assert "".join("".join(p.split()) for p in chunking.recursive_split(text, overlap=0)) == "".join(text.split())
    assert chunking.recursive_split("short") == ["short"] and chunking.recursive_split(" \n ") == [] and chunking.recursive_split("") == []
    overlapped = chunking.recursive_split(" ".join(f"w{i}" for i in range(1000)))
    assert all(a.split()[-1] in b.split() for a, b in zip(overlapped, overlapped[1:]))


def test_recursive_and_sliding_tables(spark):
    df = spark.createDataFrame([(1, "a" * 2100), (2, ""), (3, None)], "doc_id long, text string")
    assert chunking.recursive_chunks(df).count() == 3
    got = chunking.sliding_chunks(df.where("text is not null")).orderBy("doc_id", "chunk_index").collect()
    assert [(r.doc_id, r.chunk_index, len(r.text)) for r in got] == [(1, 0, 1000), (1, 1, 1000), (1, 2, 500), (2, 0, 0)]


# --- records ---
def test_positions_ids_and_batches(spark):
    df = spark.createDataFrame([(0, "a"), (1, " "), (2, "b")], "idx long, text string")
    rec = index.index_records(index.with_position(df, ["idx"])).orderBy("id").collect()
    assert [r.id for r in rec] == ["chunk_0", "chunk_2"] and rec[0].metadata.chunk_length == 1
    many = spark.range(0, 5000).selectExpr("id * 7 % 5000 as k")
    pos = index.batches(index.with_position(many, ["k"]), "position")
    assert pos.where("position <> k or batch <> floor(k / 100)").count() == 0
    assert index.flat_records(index.with_position(df, ["idx"])).count() == 3
    seen = index.inspect(df).first()
    assert (seen.rows, seen.columns) == (3, "idx,text")


# --- vectors ---
def test_top_k_matches_brute_force(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.5, 1.0]) for _ in range(4)]) for i in range(3000)] + [(9000, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    queries = df.where("vec_id % 500 = 0")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.distance) for r in vector.top_k_batch(queries, df, 7).collect()}
    for q, e in rows[::500][:6]:
        want = sorted((sum((a - b) ** 2 for a, b in zip(e, x)), i) for i, x in rows if x)[:7]
        assert [got[q, k + 1] for k in range(7)] == [(i, d) for d, i in want]
        single = vector.top_k(df.where("embedding is not null"), e, 7).orderBy("rank").collect()
        assert [(r.vec_id, r.distance) for r in single] == [(i, d) for d, i in want]


# --- retrieval and evaluation ---
def test_bm25_and_fusion(spark):
    docs = spark.createDataFrame([(1, "red apple"), (2, "red red car"), (3, "blue"), (4, None)], "doc_id long, text string")
    q = spark.createDataFrame([(0, "red RED apple"), (1, "nothing")], "query_id int, query string")
    got = retrieval.bm25(q, docs).orderBy("rank").collect()
    assert [r.doc_id for r in got] == [1, 2] and got[0].score > got[1].score
    other = spark.createDataFrame([(0, 1, 2), (0, 2, 3)], "query_id int, rank int, doc_id long")
    fused = retrieval.reciprocal_rank_fusion(retrieval.bm25(q, docs), other, k=2).orderBy("rank").collect()
    assert [r.doc_id for r in fused] == [2, 1]


def test_answers_keep_rank_order(spark):
    found = spark.createDataFrame([(0, 2, "b"), (0, 1, "a"), (0, 3, "c"), (0, 4, "d")], "query_id int, rank int, document string")
    q = spark.createDataFrame([(0, "why?"), (1, "none?")], "query_id int, query string")
    got = {r.query_id: r for r in retrieval.answer(q, found).collect()}
    assert got[0].sources == ["a", "b", "c"] and got[0].answer == "a" and "a\n\nb\n\nc\n\nd" in got[0].prompt
    assert got[1].sources == [] and got[1].answer == ""


def test_metrics(spark):
    cases = spark.createDataFrame(
        [(0, "q0", ["x", "y"], ["M.G.L. c. 90"], ["a", "b"], "basic"), (1, "q1", None, ["Z"], ["a"], "basic"), (2, "q2", [], None, [], "hard"), (3, "q0", ["x"], [], ["a"], "hard")],
        "query_id int, query string, expected_concepts array<string>, expected_citations array<string>, required_terms array<string>, difficulty string",
    )
    found = spark.createDataFrame([(0, "A b", ["x"], ["M.G.L. c. 90, § 24"]), (0, "a", [], []), (1, "zzz", [], [])], "query_id int, content string, concepts array<string>, citations array<string>")
    m = evaluate.retrieval_metrics(cases, found)
    got = {r.query_id: (r.relevance, r.concept_coverage, r.citation_preservation) for r in m.collect()}
    assert got == {0: (0.75, 0.5, 1.0), 1: (0.0, 1.0, 0.0), 2: (0.0, 1.0, 1.0), 3: (0.0, 0.0, 1.0)}
    roll = evaluate.metric_rollup(m).first()
    assert roll.avg_relevance == 0.0 and roll.avg_citation_preservation == pytest.approx(2 / 3)
    assert evaluate.cases_table(spark).count() == 5


def test_comparison(spark):
    make = lambda rows: spark.createDataFrame(rows, "query_id int, query string, latency double, answer string, citations array<string>")
    base = make([(0, "q", 1.0, "x", ["c"]), (1, "q", 2.0, "x", ["c"] * 3), (2, "q", 4.0, "u", []), (3, "q", 8.0, "v", [])])
    new = make([(0, "q", 0.0, "x ", ["c"] * 3), (1, "q", 0.0, "y", ["c"] * 3), (2, "q", 0.0, "u", []), (3, "q", 0.0, "w", [])])
    s = evaluate.comparison_summary(evaluate.compare_variants(base, new)).first()
    assert (s.p50_speedup_ms, s.avg_citation_gain, s.identical_ratio) == (3000.0, 0.5, 0.5)


def test_report_over_nothing(spark):
    empty = chunking.legal_chunks(spark.createDataFrame([], "doc_id long, page_number int, text string"))
    r = evaluate.corpus_report(empty).first()
    assert r.total_chunks == 0 and r.average_quality is None and r.citation_coverage is None
    assert evaluate.recommendations(evaluate.corpus_report(empty)).first().recommendations == []


# --- stores, settings, lifecycles, streams ---
def test_stores(spark, tmp_path):
    df = spark.createDataFrame([("a", "x\ny", 1)], "id string, text string, chunks int")
    store.write_table(df, f"{tmp_path}/t")
    assert store.read_chunks(spark, f"{tmp_path}/missing", f"{tmp_path}/t", columns=["id"]).columns == ["id"]
    with pytest.raises(FileNotFoundError):
        store.read_chunks(spark, f"{tmp_path}/missing")
    store.write_report(df, f"{tmp_path}/r.json")
    assert store.read_chunks(spark, f"{tmp_path}/r.json").columns == ["id", "text"]
    store.write_texts(df, f"{tmp_path}/x")
    assert spark.read.text(f"{tmp_path}/x").count() == 2
    (tmp_path / "q.txt").write_text("one\n\nthree\n")
    assert [(r.query_id, r.query) for r in store.read_queries(spark, str(tmp_path / "q.txt")).orderBy("query_id").collect()] == [(0, "one"), (1, ""), (2, "three")]
    assert store.read_documents(spark, str(tmp_path / "q.txt")).first().text == "one\n\nthree\n"
    (tmp_path / "d.pdf").write_bytes(b"p1|p2")
    pages = store.read_pages(spark, str(tmp_path), lambda b: b.decode().split("|"))
    assert [(r.page_number, r.text) for r in pages.orderBy("page_number").collect()] == [(1, "p1"), (2, "p2")]
    assert store.page_texts(pages).first().text == "p1p2" and store.list_files(spark, str(tmp_path)).count() == 1
    assert evaluate.page_sizes(pages).first().head == "p1p2"


def test_settings(tmp_path, monkeypatch):
    got = config.validate(config.parse("# c\nocr:\n  default_dpi: 150 # low\nextra: 'x'\n"))
    assert got["ocr"]["default_dpi"] == 150 and got["chunking"]["overlap"] == 100 and got["extra"] == "x"
    assert config.parse("") == {}
    got["chunking"]["overlap"] = 1
    assert config.DEFAULTS["chunking"]["overlap"] == 100
    for bad in ({"ocr": 3}, {"chunking": {"overlap": "x"}}):
        with pytest.raises(TypeError):
            config.validate(bad)
    assert config.validate({"embedding": {"batch_size": True}})["embedding"]["batch_size"] is True
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    with pytest.raises(ValueError):
        config.require_key("NO_SUCH_KEY")


def test_lifecycles(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Page 1 of 2\nArrest needs probable cause. M.G.L. c. 276, § 28."), (2, "Consent to search a car."), (3, "  "), (4, None)], "doc_id long, text string")
    stored = lifecycles.build_corpus(docs, str(tmp_path / "c"))
    assert stored.count() == 2 and "Page" not in stored.orderBy("id").first().document
    assert len(stored.first().embedding) == 64 and store.open_collection(spark, str(tmp_path / "c/vectors")).count() == 2
    asked = spark.createDataFrame([(0, "probable cause for arrest"), (1, "consent search")], "query_id int, query string")
    for search in (lifecycles.vector_search(stored), lifecycles.lexical_search(stored), lifecycles.hybrid_search(stored)):
        got = {r.query_id: r for r in lifecycles.ask(search, asked, 2).collect()}
        assert got[0].answer.startswith("Arrest") and got[1].answer.startswith("Consent")
    assert lifecycles.evaluate_search(lifecycles.lexical_search(stored), evaluate.cases_table(spark)).count() == 5
    timed = lifecycles.timed_answers(lifecycles.lexical_search(stored), asked.limit(1))
    rows, summary = lifecycles.compare_searches(timed, timed)
    assert summary.first().identical_ratio == 1.0 and rows.count() == 1
    said, lines = [], iter(["", "consent", "EXIT"])
    lifecycles.interactive(lifecycles.lexical_search(stored), spark, lambda: next(lines), said.append)
    assert said[0].startswith("Consent")
    assert (embed.hashed_vector(None) == 0).all()


def test_stream(spark, tmp_path):
    rows = [(1, "OUI stop", "2025-01-01 00:00:00"), (1, "OUI stop", "2025-01-01 00:01:00"), (2, "a warrant", "2025-01-01 00:02:00")]
    spark.createDataFrame(rows, "doc_id long, text string, ts string").selectExpr("doc_id", "text", "cast(ts as timestamp) ts").write.parquet(f"{tmp_path}/in")
    cleaned = ingest.cleaned_stream(ingest.read_stream(spark, f"{tmp_path}/in"))
    ingest.append_to(cleaned, f"{tmp_path}/out", f"{tmp_path}/cp").awaitTermination()
    out = spark.read.parquet(f"{tmp_path}/out")
    assert out.count() == 2
    assert {r.concept: r.n for r in ingest.concept_counts(out).collect()} == {"oui_dui": 1, "search_warrant": 1}


def test_system_build_smoke_and_reports(spark, tmp_path):
    docs = spark.createDataFrame([(1, "Arrest needs probable cause. M.G.L. c. 276, § 28."), (2, "Consent to search a car.")], "doc_id long, text string")
    path = str(tmp_path / "s")
    assert lifecycles.build_system(docs, path)["status"] == "built" and lifecycles.build_system(docs, path) == {"status": "present", "path": path, "records": 2}
    assert lifecycles.build_system(docs.limit(1), path, force_rebuild=True) == {"status": "built", "path": path, "records": 1}
    more = index.page_records(spark.createDataFrame([(5, "A page on warrants.", 9)], "position int, content string, page int"))
    assert more.first().asDict(True) == {"id": "id_5", "document": "A page on warrants.", "metadata": {"page": 9}}
    pages = str(tmp_path / "p")
    assert lifecycles.add_records(more, pages).count() == 1 and lifecycles.add_records(more, pages).count() == 2
    stored = store.open_collection(spark, f"{path}/vectors")
    smoke = lifecycles.index_smoke(lifecycles.lexical_search(stored), spark, "probable cause")
    assert smoke["ok"] and smoke["found"] == 1 and smoke["previews"][0].startswith("Arrest")
    assert not lifecycles.index_smoke(lifecycles.lexical_search(stored), spark, "zzz")["ok"]
    got = lifecycles.ask(lifecycles.lexical_search(stored), spark.createDataFrame([(0, "arrest")], "query_id int, query string")).first()
    assert got.legal_citations == ["M.G.L. c. 276, § 28."]
    text = store.report_text(evaluate.corpus_report(chunking.legal_chunks(spark.createDataFrame([(1, 1, "CHAPTER 1: A\nArrest.")], "doc_id long, page_number int, text string"))), "Corpus")
    assert text.startswith("Corpus\n======\n") and "total chunks: 1" in text
    (tmp_path / "b.pdf").write_bytes(b"x")
    (tmp_path / "a.pdf").write_bytes(b"x")
    assert store.first_file(spark, str(tmp_path)).endswith("a.pdf") and store.first_file(spark, str(tmp_path), "*.none") is None


def test_stored_index_gives_the_same_scores(spark, tmp_path):
    rng = random.Random(5)
    docs = spark.createDataFrame([(i, " ".join(rng.choices("abcdefgh", k=rng.randint(0, 30)))) for i in range(200)] + [(500, None)], "doc_id long, text string")
    asked = spark.createDataFrame([(0, "a b b"), (1, "H zz"), (2, "")], "query_id int, query string")
    stored = retrieval.bm25_index(docs, path=str(tmp_path / "i"))
    again = retrieval.open_bm25(spark.read.parquet(str(tmp_path / "i")))
    assert (stored.n, stored.avgdl) == (again.n, again.avgdl) == (201, pytest.approx(docs.selectExpr("sum(size(regexp_extract_all(coalesce(text, ''), '[a-z]+', 0))) / 201").first()[0]))
    one, two = (sorted(map(tuple, retrieval.bm25(asked, x, 5).collect())) for x in (docs, again))
    assert one == two and {r[0] for r in one} == {0, 1}


def test_recursive_split_by_another_length(spark):
    docs = spark.createDataFrame([(1, " ".join(f"w{i}" for i in range(100)))], "doc_id long, text string")
    rows = chunking.recursive_chunks(docs, size=10, overlap=2, length=lambda t: len(t.split())).collect()
    assert all(len(r.text.split()) <= 10 for r in rows) and len(rows) > 9


def test_chunks_without_a_citation_list_are_searched(spark):
    cases = spark.createDataFrame([(0, "q", [], ["M.G.L. c. 90"], [], "basic")], "query_id int, query string, expected_concepts array<string>, expected_citations array<string>, required_terms array<string>, difficulty string")
    found = spark.createDataFrame([(0, "See M.G.L. c. 90, § 24 now", [])], "query_id int, content string, concepts array<string>")
    assert evaluate.retrieval_metrics(cases, found).first().citation_preservation == 1.0


def test_variants_are_rendered_and_cleaned_in_place(spark):
    df = spark.createDataFrame([("Page 1 of 2 a", None, 3), (None, "b  c", 4), (None, None, 5)], "text string, content string, n int")
    got = index.cleaned_variants(df)
    assert [(r.text, r.content, r.n) for r in got.orderBy("n").collect()] == [("a", None, 3), (None, "b c", 4), (None, None, 5)]
    assert [r.t for r in got.orderBy("n").select(index.rendered_text(got).alias("t")).collect()] == ["a", "b c", '{"n":5}']
    assert index.inspect(got, ["n"]).first().asDict() == {"container": "table", "rows": 3, "columns": "text,content,n", "first_type": "dict", "first_keys": "text,n", "first_text": "a..."}


def _split_plainly(text, size, overlap, marks):
    """Pieces by repeated searching and joining, character positions first: the
    text is cut before each mark, long cuts are cut again by the next marks, and
    runs of short cuts are joined greedily, each chunk going back over whole cuts
    of up to ``overlap`` characters."""
    mark = next((m for m in marks if not m or m in text), marks[-1])
    later = marks[marks.index(mark) + 1 :]
    edges = [0]
    at = text.find(mark, 0) if mark else -1
    while at >= 0:
        edges.append(at)
        at = text.find(mark, at + len(mark))
    cuts = [text[a:b] for a, b in zip(edges, [*edges[1:], len(text)]) if text[a:b]] if mark else list(text)
    out, run = [], []

    def join():
        first, end, n = 0, 0, 0
        while end < len(run):
            if n + len(run[end]) > size and end > first:
                out.append("".join(run[first:end]).strip())
                while n > overlap or (n and n + len(run[end]) > size):
                    n -= len(run[first])
                    first += 1
            n += len(run[end])
            end += 1
        out.append("".join(run[first:end]).strip())
        run.clear()

    for c in cuts:
        if len(c) < size:
            run.append(c)
        else:
            join()
            out.extend(_split_plainly(c, size, overlap, later) if later else [c])
    join()
    return [c for c in out if c]


def test_recursive_split_matches_a_plain_one():
    rng = random.Random(17)
    for _ in range(300):
        text = "".join(rng.choice(["word", "a", " ", " ", "\n", "\n\n", "longer-part", "x" * 25]) for _ in range(rng.randint(0, 120)))
        for size, overlap in ((40, 10), (20, 0), (100, 30)):
            assert chunking.recursive_split(text, size, overlap) == _split_plainly(text, size, overlap, ["\n\n", "\n", " ", ""])
