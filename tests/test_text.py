"""Golden rows of the text functions."""

import pytest
from pyspark.sql import functions as F

from docweave.functions import patterns as P
from docweave.functions import text as X


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "t string").select(column(F.col("t")).alias("r")).first().r


@pytest.mark.parametrize(
    ("text", "cleaned"),
    [
        ("Page 12 of 30\nHello  world\t!", "Hello world !"),
        ("HomePage 9 rest", "Homerest"),
        ("see page 3 of 9 for", "see for"),
        ("a\n\n42\n\nb", "a\n\nb"),
        ("a\n\n\n\n\nb", "a\n\nb"),
        ("- 7 -\ntext||tail -----end", "texttail end"),
        ("Chapter IV\nBody", "Body"),
        ("chapter iv\nBody", "chapter iv\nBody"),
        ("MASSACHUSETTS CRIMINAL LAW 2025\nArrest | search", "Arrest | search"),
        ("   ", ""),
        ("", ""),
        (" x \x1c", "x"),
    ],
)
def test_clean_text(spark, text, cleaned):
    assert one(spark, text, X.clean_text) == cleaned


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("M.G.L. c. 90, § 24.", ["M.G.L. c. 90, § 24."]),
        ("MGL c 265 s. 13A", ["M.G.L. c. 265, § 13"]),
        ("General Laws chapter 276 section 1 applies", ["M.G.L. c. 276, § 1"]),
        ("G.L. c. 41, § 98", []),
        ("m.g.l. c. 94C, § 32", []),
        ("see M.G.L. c. 90 §24 and MGL c.90, s.10", ["M.G.L. c. 90, § 24", "M.G.L. c. 90, § 10"]),
        (
            "Held in Commonwealth v. Cast, 407 Mass. 891 (1990) and later. Smith v. Jones, 12 Mass. 34; done.",
            ["Held in Commonwealth v. Cast, 407 Mass. 891 (1990)", "Smith v. Jones, 12 Mass. 34"],
        ),
        ("A v. B, 1 Mass. 2 C v. D, 3 Mass. 4", ["A v. B, 1 Mass. 2", "C v. D, 3 Mass. 4"]),
        ("A v. B, 1 U.S. 2", []),
        ("", []),
    ],
)
def test_citations(spark, text, found):
    assert one(spark, text, X.citations) == found


def test_case_pattern_is_linear_on_long_runs(spark):
    text = "word " * 60_000 + "Smith v. Jones, 12 Mass. 34."
    assert one(spark, text, X.citations)[0].endswith("Smith v. Jones, 12 Mass. 34")
    assert one(spark, "word " * 60_000 + " v. mass. no", X.citations) == []


def test_case_pattern_finds_what_the_plain_one_does(spark):
    import random
    import re

    plain = re.compile(r"(\w+(?:\s+\w+)*)\s+v\.\s+(\w+(?:\s+\w+)*),\s*(\d+)\s+Mass\.\s*(\d+)(?:\s*\((\d{4})\))?", re.I)
    rng = random.Random(0)
    parts = ["A", "b", " ", "v.", " v. ", ", 1 Mass. 2", ", 3 mass.4 (1999)", ".", "x y", ",", "\n", "9", " v. B, 1 Mass. 2"]
    rows = [("".join(rng.choices(parts, k=rng.randint(1, 14))),) for _ in range(3000)]
    got = spark.createDataFrame(rows, "t string").select("t", *[F.regexp_extract_all("t", F.lit(P.CASE), F.lit(i)).alias(f"g{i}") for i in range(1, 6)]).collect()
    assert sum(len(r.g1) for r in got) > 300
    for r in got:
        assert list(zip(r.g1, r.g2, r.g3, r.g4, r.g5)) == plain.findall(r.t)


@pytest.mark.parametrize(
    ("text", "headings", "score"),
    [
        ("CHAPTER 3: Arrest\nSection 2.1 Scope\nSee M.G.L. c. 90, § 24\n1. first\n2. second", True, 0.7999999999999999),
        ("plain", False, 0.0),
        ("CHAPTER 1 A\nSection 1 B\nM.G.L. c. 90, § 24\n1. x\nA v. B, 1 Mass. 2", True, 0.9999999999999999),
    ],
)
def test_structure(spark, text, headings, score):
    assert one(spark, text, X.has_headings) is headings
    assert one(spark, text, X.structure_score) == score


def test_chapter_number_backtracks_without_a_title(spark):
    assert one(spark, "CHAPTER 12", lambda t: F.regexp_extract(t, P.CHAPTER, 1)) == "1"
    assert one(spark, "CHAPTER 5", X.has_headings) is False


@pytest.mark.parametrize(("text", "found"), [("The elements are:", True), ("The elements are:\n1. x", False), ("conditions of release", True)])
def test_elements_stand_on_the_last_line(spark, text, found):
    assert one(spark, text, lambda t: t.rlike(P.ELEMENTS)) is found


def test_concepts_and_quality(spark):
    text = "Police may arrest on probable cause. M.G.L. c. 276, § 28."
    assert one(spark, text, X.concepts) == ["probable_cause", "arrest"]
    assert one(spark, text, lambda t: X.chunk_quality(t, X.citations(t), X.concepts(t))) == pytest.approx(0.6)
    assert one(spark, "upcoming", X.concepts) == ["probable_cause"]
    assert one(spark, "any key", lambda t: X.concepts(t, {"k": ["KEY"]})) == ["k"]


@pytest.mark.parametrize(("text", "unit"), [('"Probable cause" means facts.', True), ("Text about arrest. M.G.L. c. 90, § 24", True), ("plain", False), ("requirements\n1. a\n2. b\nThe conditions", True)])
def test_coherent(spark, text, unit):
    assert one(spark, text, lambda t: X.coherent(t, X.concepts(t), X.citations(t))) is unit


@pytest.mark.parametrize(("a", "b", "cut"), [("The elements are:", "1. operation", False), ("a", "b", True), ("arrest", "arrests", False), ("x means y", "an Example", False)])
def test_breaks_unity(spark, a, b, cut):
    df = spark.createDataFrame([(a, b)], "a string, b string")
    assert df.select(X.breaks_unity(F.col("a"), F.col("b"), X.concepts(F.col("a")), X.concepts(F.col("b"))).alias("r")).first().r is cut


def test_previews_and_normalise(spark):
    assert [one(spark, t, lambda c: X.preview(c, 5)) for t in ("abcde", "abcdef")] == ["abcde", "abcde..."]
    assert one(spark, "ab", lambda c: X.preview_dots(c, 5)) == "ab..." and one(spark, "abc", lambda c: X.prefix(c, 2)) == "ab"
    df = spark.createDataFrame([(None, "x"), ("a", "y")], "text string, content string")
    assert [r.r for r in df.select(X.normalise(F.col("text"), F.col("content")).alias("r")).collect()] == ["x", "a"]
    assert one(spark, "Quit", X.wants_exit) is True
    assert one(spark, "An OUI, an oui", lambda t: X.highlight(t, "oui")) == "An **OUI**, an **oui**"
