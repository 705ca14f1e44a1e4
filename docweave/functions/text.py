"""Column functions over text. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from docweave.functions import patterns as P


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode's and U+001C to U+001F too."""
    return F.regexp_replace(text, r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z", "")


def clean_text(text: Column) -> Column:
    """Extraction artefacts removed by the cleaning rules in order, then stripped."""
    for pattern, replacement in P.CLEANING:
        text = F.regexp_replace(text, pattern, replacement)
    return strip(text)


def is_blank(text: Column) -> Column:
    return strip(text) == ""


def preview(text: Column, n: int) -> Column:
    """The first n characters, with ... only where there are more."""
    return F.when(F.length(text) > n, F.concat(F.substring(text, 1, n), F.lit("..."))).otherwise(text)


def preview_dots(text: Column, n: int) -> Column:
    """The first n characters and always ..."""
    return F.concat(F.substring(text, 1, n), F.lit("..."))


def prefix(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def normalise(*candidates: Column) -> Column:
    """The first of the candidate texts that is there: a chunk may come as a
    plain string, under one of several names, or as something to be rendered."""
    return F.coalesce(*candidates)


def has_headings(text: Column) -> Column:
    return text.rlike(P.CHAPTER) | text.rlike(P.SECTION)


def _when(condition: Column, weight: float) -> Column:
    return F.when(condition, F.lit(weight)).otherwise(F.lit(0.0))


def structure_score(text: Column) -> Column:
    """Share of structure marks, added in this order and at most 1."""
    score = _when(text.rlike(P.CHAPTER), 0.3)
    for pattern, weight in ((P.SECTION, 0.2), (P.STATUTE, 0.2), (P.CASE, 0.2), (P.NUMBERED, 0.1)):
        score = score + _when(text.rlike(pattern), weight)
    return F.least(score, F.lit(1.0))


def statute_citations(text: Column) -> Column:
    both = F.arrays_zip(F.regexp_extract_all(text, F.lit(P.STATUTE), F.lit(1)).alias("c"), F.regexp_extract_all(text, F.lit(P.STATUTE), F.lit(2)).alias("s"))
    full = F.transform(both, lambda x: F.concat(F.lit("M.G.L. c. "), x["c"], F.lit(", § "), x["s"]))
    # Only texts that name a collection of laws are searched.
    return F.when(F.lower(text).rlike(r"m\.?g\.?l|general law"), full).when(text.isNotNull(), F.array().cast("array<string>"))


def case_citations(text: Column) -> Column:
    """Empty without a look where the reporter's or the versus mark is missing."""
    names = "pdvgy"
    zipped = F.arrays_zip(*[F.regexp_extract_all(text, F.lit(P.CASE), F.lit(i + 1)).alias(n) for i, n in enumerate(names)])
    year = lambda x: F.when(x["y"] != "", F.concat(F.lit(" ("), x["y"], F.lit(")"))).otherwise("")
    full = F.transform(zipped, lambda x: F.concat(x["p"], F.lit(" v. "), x["d"], F.lit(", "), x["v"], F.lit(" Mass. "), x["g"], year(x)))
    return F.when(F.lower(text).contains("mass.") & text.rlike(r"(?iU)\sv\.\s"), full).otherwise(F.array().cast("array<string>"))


def citations(text: Column) -> Column:
    """Statutes in text order, then cases; repeats stay."""
    return F.concat(statute_citations(text), case_citations(text))


def concepts(text: Column, dictionary: dict[str, list[str]] | None = None) -> Column:
    """Concepts with a keyword in the text (any case, within words too), in dictionary order."""

    def held(low: Column) -> Column:
        found = []
        for name, words in (dictionary or P.CONCEPTS).items():
            hit = None
            for w in words:
                one = low.contains(w.lower())
                hit = one if hit is None else hit | one
            found.append(F.when(hit, F.lit(name)))
        return F.filter(F.array(*found), lambda x: x.isNotNull())

    # The folded text is bound as a variable: else each keyword would fold it anew.
    return F.transform(F.array(F.lower(text)), held)[0]


def keyword_counts(text: Column, dictionary: dict[str, list[str]] | None = None) -> Column:
    """A map from each concept that is found to how often its keywords stand in
    the text (any case, occurrences of one keyword apart from each other)."""

    def counted(low: Column) -> Column:
        every = []
        for name, words in (dictionary or P.CONCEPTS).items():
            n = sum((F.size(F.split(low, r"\Q" + w.lower() + r"\E", -1)) - 1 for w in words), F.lit(0))
            every.append(F.struct(F.lit(name).alias("key"), n.alias("value")))
        return F.map_filter(F.map_from_entries(F.array(*every)), lambda _, n: n > 0)

    return F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), counted)[0]


def coherent(text: Column, concepts_col: Column, citations_col: Column) -> Column:
    """Whether a short text is one unit: a definition, an element list, or few concepts with a citation."""
    listed = text.rlike(P.ELEMENTS) & (F.regexp_count(text, F.lit(P.NUMBERED)) >= 2)
    # Few texts have a citation, so that concepts are looked for in few.
    return text.rlike(P.DEFINITION) | listed | ((F.size(citations_col) > 0) & (F.size(concepts_col) <= 2))


def breaks_unity(current: Column, new: Column, current_concepts: Column, new_concepts: Column) -> Column:
    """Whether a paragraph should begin another chunk than the current text's."""
    listing = current.rlike(P.ELEMENTS) & new.rlike(P.NUMBERED)
    example = (current.contains("means") | current.contains("defined as")) & F.lower(new).contains("example")
    return F.when(listing, False).when(example, False).otherwise(~F.arrays_overlap(current_concepts, new_concepts))


def chunk_quality(text: Column, citations_col: Column, concepts_col: Column) -> Column:
    """Quality of a chunk, added in this order and at most 1."""
    n, k = F.length(text), F.size(concepts_col)
    size = F.when(n.between(200, 1000), F.lit(0.2)).when(n.between(100, 1500), F.lit(0.1)).otherwise(F.lit(0.0))
    score = _when(F.size(citations_col) > 0, 0.3) + _when(k > 0, 0.2) + size
    score = score + _when(text.rlike(P.NUMBERED) | text.rlike(P.DEFINITION), 0.2) + _when(k.between(1, 3), 0.1)
    return F.least(score, F.lit(1.0))


def highlight(text: Column, word: str, before: str = "**", after: str = "**") -> Column:
    """Occurrences of a word, any case, between marks."""
    import re

    return F.regexp_replace(text, f"(?iu)({re.escape(word)})", f"{before}$1{after}")


def wants_exit(line: Column, words=P.EXIT_WORDS) -> Column:
    return F.lower(line).isin(*words)
