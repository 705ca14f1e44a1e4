"""Registered queries of the document operators, each with its SQL oracle.

The given documents hold hardly any heading, citation or artefact, so most
queries run on a legal view: each whole text with marks added by document id,
by the same SQL text in both engines, as two pages for each document.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docweave.functions import dictionary, embed
from docweave.functions import patterns as P
from docweave.functions import text as X
from docweave.operators import cached, chunking, evaluate, index, retrieval, vector, vector_index
from docweave.plans import lifecycles
from docweave.sources import store

_NL = "chr(10)"
_PAGE_1 = f"""
  case when doc_id % 2 = 0 then 'CHAPTER ' || cast(doc_id % 7 + 1 as string) || ': Arrest and custody' || {_NL} else '' end ||
  case when doc_id % 3 = 0 then 'Section ' || cast(doc_id % 5 + 1 as string) || '.' || cast(doc_id % 4 as string) || ' Scope of search' || {_NL} else '' end ||
  coalesce(text, '') ||
  case when doc_id % 5 = 0 then {_NL} || {_NL} || 'See M.G.L. c. 90, § 24 and General Laws chapter 276 section 1 on a warrant.' else '' end ||
  case when doc_id % 6 = 1 then {_NL} || {_NL} || '(Held in Commonwealth v. Cast, 407 Mass. 891 (1990) and later. Smith v. Jones, 12 Mass. 34; done.' else '' end ||
  case when doc_id % 7 = 3 then {_NL} || 'Page ' || cast(doc_id % 90 as string) || ' of 90' || {_NL} || '12' || {_NL} || {_NL} || {_NL} || '- 7 -' || {_NL} || 'tail  ||| end -----' || {_NL} || 'Chapter IV' else '' end"""
_PAGE_2 = f"""
  case when doc_id % 4 = 0 then 'CHAPTER 9 - Evidence' || {_NL} else '' end || 'Opening lines of page two on consent.' ||
  case when doc_id % 3 = 1 then {_NL} || 'Section 9.1: Items' || {_NL} || 'A warrant is needed. PC is probable cause.' || {_NL} || {_NL} else '' end ||
  case when doc_id % 4 = 1 then {_NL} || {_NL} || '"Probable cause" means facts that support reasonable belief.' else '' end ||
  case when doc_id % 4 = 2 then {_NL} || {_NL} || '1. first element' || {_NL} || '2. second element of arrest' else '' end ||
  case when doc_id % 9 = 0 then {_NL} || {_NL} || coalesce(text, '') || {_NL} || {_NL} || 'The elements are:' else '' end ||
  case when doc_id % 11 = 0 then {_NL} || 'CHAPTER 3: More' || {_NL} || '§ 3.2 Force' || {_NL} || 'Deadly force and frisk. See MGL c 265 s. 13A' else '' end"""
LEGAL = f"select doc_id, 1 as page_number, {_PAGE_1} as text from documents union all select doc_id, 2 as page_number, {_PAGE_2} as text from documents"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def legal_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, page_number, text) of the legal view."""
    docs = _table(spark, sf_dir, "documents")
    one = docs.select("doc_id", F.lit(1).alias("page_number"), F.expr(_PAGE_1).alias("text"))
    return one.union(docs.select("doc_id", F.lit(2).alias("page_number"), F.expr(_PAGE_2).alias("text")))


# --- SQL spellings for the oracles (RE2 has no lookaround; \w is spelt out) ---
_W = r"[\p{L}\p{N}_]"
# The patterns in the SQL dialect.
_SQL = {
    "chapter": r"(?im)^CHAPTER\s+(\d+)[:\-]?\s*(.+)$",
    "section": r"(?im)^(?:Section|§)\s*([\d.]+)[:\-]?\s*(.+)$",
    "statute": r"(?i)(?:M\.?G\.?L\.?|General Laws?)\s*c(?:hapter|\.)?\s*(\d+)[,\s]*(?:§|s(?:ection|\.))\s*([\d\.]+)",
    "case": rf"(?i)({_W}(?:[\p{{L}}\p{{N}}_\s]*{_W})?)\s+v\.\s+({_W}(?:[\p{{L}}\p{{N}}_\s]*{_W})?),\s*(\d+)\s+Mass\.\s*(\d+)(?:\s*\((\d{{4}})\))?",
    "definition": r'(?i)"([^"]+)"\s+(?:means?|is defined as)',
    "elements": r"(?i)(?:elements?|requirements?|conditions?).*?(?:are|include)?:?\s*$",
    "numbered": r"(?m)^\s*(\d+)\.?\s+(.+)$",
}
# The cleaning rules in the SQL dialect.
_CLEAN_SQL = [
    (r"(?i)Page\s+\d+\s*(of\s+\d+)?", "''"),
    (r"(?m)^\s*\d+\s*$", "''"),
    (r"(?m)^\s*[-–—]\s*\d+\s*[-–—]\s*$", "''"),
    (r"(?i)Massachusetts\s+Criminal\s+Law\s+\d{4}", "''"),
    (r"(?m)^\s*Chapter\s+[IVXLCDM]+\s*$", "''"),
    (r"\n{3,}", "chr(10) || chr(10)"),
    (r"[ \t]+", "' '"),
    (r"[|]{2,}", "''"),
    (r"[-]{4,}", "''"),
]


def _strip(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def _clean(x: str) -> str:
    for pattern, by in _CLEAN_SQL:
        x = f"regexp_replace({x}, '{pattern}', {by}, 'g')"
    return _strip(x)


def _has(x: str, name: str) -> str:
    return f"regexp_matches({x}, '{_SQL[name]}')"


def _all(x: str, name: str, group: int) -> str:
    return f"regexp_extract_all({x}, '{_SQL[name]}', {group})"


def _concepts(x: str) -> str:
    parts = []
    for name, words in P.CONCEPTS.items():
        hits = " or ".join(f"contains(lower({x}), '{w.lower()}')" for w in words)
        parts.append(f"case when {hits} then '{name}' end")
    return f"list_filter([{', '.join(parts)}], lambda z: z is not null)"


def _citations(x: str) -> str:
    statutes = f"list_transform(list_zip({_all(x, 'statute', 1)}, {_all(x, 'statute', 2)}), lambda z: 'M.G.L. c. ' || z[1] || ', § ' || z[2])"
    groups = ", ".join(_all(x, "case", i) for i in range(1, 6))
    year = "case when coalesce(z[5], '') <> '' then ' (' || z[5] || ')' else '' end"
    cases = f"list_transform(list_zip({groups}), lambda z: z[1] || ' v. ' || z[2] || ', ' || z[3] || ' Mass. ' || z[4] || {year})"
    guarded = f"case when contains(lower({x}), 'mass.') then {cases} else [] end"
    return f"list_concat({statutes}, {guarded})"


def _score(x: str) -> str:
    marks = (("chapter", 0.3), ("section", 0.2), ("statute", 0.2), ("case", 0.2), ("numbered", 0.1))
    return "least(" + " + ".join(f"(case when {_has(x, n)} then cast({w} as double) else 0.0 end)" for n, w in marks) + ", cast(1.0 as double))"


def _quality(x: str, cits: str, cons: str) -> str:
    return f"""least((case when len({cits}) > 0 then cast(0.3 as double) else 0 end) + (case when len({cons}) > 0 then cast(0.2 as double) else 0 end)
  + (case when len({x}) between 200 and 1000 then cast(0.2 as double) when len({x}) between 100 and 1500 then cast(0.1 as double) else 0 end)
  + (case when {_has(x, "numbered")} or {_has(x, "definition")} then cast(0.2 as double) else 0 end)
  + (case when len({cons}) between 1 and 3 then cast(0.1 as double) else 0 end), cast(1.0 as double))"""


_LEGAL_CTE = f"legal as ({LEGAL})"
_SECTIONS = rf"""
{_LEGAL_CTE},
parts as (select doc_id, page_number, list_filter(list_transform(string_split(
    regexp_replace(regexp_replace(text, '\n(CHAPTER\s+\d+)', chr(1) || '\1', 'g'), '\n(Section\s+[\d.]+)', chr(1) || '\1', 'g'), chr(1)),
    lambda z: {_strip("z")}), lambda z: z <> '') as s from legal),
each as (select doc_id, page_number, cast(unnest(generate_series(0, len(s) - 1)) as int) as section_idx, unnest(s) as section_text from parts),
secs as (select *, coalesce(last_value(nullif(regexp_extract(section_text, '{_SQL["chapter"]}', 1), '') ignore nulls) over w, '') as chapter,
  coalesce(last_value(nullif(regexp_extract(section_text, '{_SQL["section"]}', 1), '') ignore nulls) over w, '') as section
  from each window w as (partition by doc_id order by page_number, section_idx rows between unbounded preceding and current row))"""
_CHUNKS = rf"""{_SECTIONS},
units as (select *, list_filter(list_transform(string_split(section_text, chr(10) || chr(10)), lambda z: {_strip("z")}), lambda z: z <> '') as u,
  (len(section_text) < 1500 and ({_has("section_text", "definition")}
    or ({_has("section_text", "elements")} and len({_all("section_text", "numbered", 0)}) >= 2)
    or (len({_concepts("section_text")}) <= 2 and len({_citations("section_text")}) > 0))) as whole from secs),
folded as (select *, case when whole then null else list_reduce(list_prepend({{'done': cast([] as varchar[]), 'cur': ''}},
    list_transform(u, lambda p: {{'done': cast([] as varchar[]), 'cur': p}})),
  lambda a, x: case
    when len(case when a.cur = '' then x.cur else a.cur || chr(10) || chr(10) || x.cur end) > 1000
      and not ({_has("a.cur", "elements")} and {_has("x.cur", "numbered")})
      and not ((contains(a.cur, 'means') or contains(a.cur, 'defined as')) and contains(lower(x.cur), 'example'))
      and not list_has_any({_concepts("a.cur")}, {_concepts("x.cur")})
    then {{'done': case when a.cur <> '' then list_append(a.done, a.cur) else a.done end, 'cur': x.cur}}
    else {{'done': a.done, 'cur': case when a.cur = '' then x.cur else a.cur || chr(10) || chr(10) || x.cur end}} end) end as f from units),
lists as (select doc_id, page_number, section_idx, chapter, section, case when whole then [section_text] when f.cur <> '' then list_append(f.done, f.cur) else f.done end as c from folded),
flat as (select doc_id, page_number, section_idx, chapter, section, cast(unnest(generate_series(0, len(c) - 1)) as int) as chunk_idx, unnest(c) as content from lists),
chunks as (select *, {_citations("content")} as citations, {_concepts("content")} as legal_concepts from flat),
scored as (select *, {_quality("content", "citations", "legal_concepts")} as confidence_score from chunks)"""


def clean_sql(x: str) -> str:
    """The cleaned text of an SQL expression."""
    return _clean(x)


def chunks_sql(pages: str) -> str:
    """The CTEs up to ``scored`` (annotated chunks) over ``pages``, a CTE named legal."""
    return _CHUNKS.replace(_LEGAL_CTE, pages)


def _joined(c: str) -> str:
    return f"array_to_string({c}, ' ; ')"


def knn_batch(spark, sf_dir):
    """The five nearest vectors of every hundredth vector, among all."""
    e = _table(spark, sf_dir, "embeddings")
    return vector.top_k_batch(e.where("vec_id % 100 = 0"), e, 5).select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


_DIST = "list_sum(list_transform(list_zip({a}, {b}), lambda z: (cast(z[1] as double) - cast(z[2] as double)) ** 2))"
_KNN = f"""with d as (select q.vec_id as query_id, e.vec_id, {_DIST.format(a="e.embedding", b="q.embedding")} as d from embeddings e, embeddings q where q.vec_id % 100 = 0),
r as (select *, row_number() over (partition by query_id order by d, vec_id) as rank from d) select query_id, cast(rank as int) as rank, vec_id, round(d, 6) as distance from r where rank <= 5"""


def _vector_index(spark, sf_dir):
    """The embeddings' inverted lists, built in a new scratch folder."""
    return vector_index.build_index(_table(spark, sf_dir, "embeddings"), f"{store.scratch_dir(spark)}/docweave-lists-{uuid.uuid4().hex}")


def knn_from_index(spark, sf_dir):
    """The rows of the exact batch search, from the inverted lists."""
    asked = _table(spark, sf_dir, "embeddings").where("vec_id % 100 = 0")
    found = vector_index.search(asked, _vector_index(spark, sf_dir), 5, exact=True)
    return found.select("query_id", "rank", "vec_id", F.round("distance", 6).alias("distance"))


def index_recall(spark, sf_dir):
    """Whether as many probes as calibrated find 95 % of the ten nearest of every
    hundredth vector, and whether they compare fewer pairs than all."""
    e = _table(spark, sf_dir, "embeddings")
    asked, stored = e.where("vec_id % 100 = 0"), _vector_index(spark, sf_dir)
    probes = vector_index.calibrated_probes(stored, 0.97)
    found = vector_index.search(asked, stored, 10, probes).select("query_id", "vec_id")
    same = vector.top_k_batch(asked, e, 10).select("query_id", "vec_id").join(found, ["query_id", "vec_id"], "left_semi")
    fewer = F.lit(vector_index.share_compared(asked, stored, probes) < 1)
    return asked.agg(F.count("*").alias("queries")).join(same.agg(F.count("*").alias("same")), F.lit(True)).select("queries", (F.col("same") >= 9.5 * F.col("queries")).alias("recall_reached"), fewer.alias("fewer_pairs"))


_RECALLED = "select count(*) as queries, true as recall_reached, true as fewer_pairs from embeddings where vec_id % 100 = 0"


def _four_digits(value: Column) -> Column:
    """A number from 0 on as printf("%.4f") shows it: from its exact binary value.
    Java's formatter rounds the shortest decimal instead, and its decimal format
    takes 0.00005, which is above the half, for the half."""
    low = F.when(value < 5e-5, "0.0000").otherwise("0.0001")
    return F.when(value < 1e-4, low).otherwise(F.call_function("format_number", value, F.lit("0.0000")))


def _first_vector(spark, sf_dir):
    return list(_table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()[0])


def knn_single(spark, sf_dir):
    """The five nearest of one vector, by expressions, with the score as displayed."""
    found = vector.top_k(_table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 5)
    return found.select("rank", "vec_id", _four_digits(F.col("distance")).alias("score"))


_KNN_ONE = f"""with d as (select e.vec_id, {_DIST.format(a="e.embedding", b="q.embedding")} as d from embeddings e, embeddings q where q.vec_id = 0)
select cast(row_number() over (order by d, vec_id) as int) as rank, vec_id, printf('%.4f', d) as score from d order by d, vec_id limit 5"""


def page_structure(spark, sf_dir):
    """Heading flag and structure score of all pages."""
    t = F.col("text")
    return legal_pages(spark, sf_dir).select("doc_id", "page_number", X.has_headings(t).alias("has_headings"), X.structure_score(t).alias("structure_score"))


_STRUCTURE = f"with legal as ({LEGAL}) select doc_id, page_number, {_has('text', 'chapter')} or {_has('text', 'section')} as has_headings, {_score('text')} as structure_score from legal"


def text_clean(spark, sf_dir):
    return legal_pages(spark, sf_dir).select("doc_id", "page_number", X.clean_text(F.col("text")).alias("cleaned"))


_CLEANED = f"with legal as ({LEGAL}) select doc_id, page_number, {_clean('text')} as cleaned from legal"


def previews(spark, sf_dir):
    t = F.coalesce("text", F.lit(""))
    return _table(spark, sf_dir, "documents").select(
        "doc_id", X.preview(t, 100).alias("short"), X.preview(t, 300).alias("medium"), X.preview_dots(t, 200).alias("dotted"), X.prefix(t, 200).alias("bare"), X.is_blank(t).alias("blank")
    )


_PREVIEWS = f"""with d as (select doc_id, coalesce(text, '') as t from documents) select doc_id,
  case when len(t) > 100 then t[1:100] || '...' else t end as short, case when len(t) > 300 then t[1:300] || '...' else t end as medium,
  t[1:200] || '...' as dotted, t[1:200] as bare, {_strip("t")} = '' as blank from d"""


def citation_extract(spark, sf_dir):
    pages = legal_pages(spark, sf_dir)
    return pages.select("doc_id", "page_number", F.array_join(X.citations(F.col("text")), " ; ").alias("citations"))


_CITED = f"with legal as ({LEGAL}) select doc_id, page_number, {_joined(_citations('text'))} as citations from legal"


def concept_tags(spark, sf_dir):
    pages = legal_pages(spark, sf_dir)
    return pages.select("doc_id", "page_number", F.array_join(X.concepts(F.col("text")), ",").alias("concepts"))


_TAGGED = f"with legal as ({LEGAL}) select doc_id, page_number, array_to_string({_concepts('text')}, ',') as concepts from legal"


def sliding_chunks(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return chunking.sliding_chunks(docs)


_SLIDING = """with d as (select doc_id, coalesce(text, '') as t from documents), p as (select doc_id, t, unnest(generate_series(0, greatest(len(t) - 1, 0), 800)) as p from d)
select doc_id, cast(p // 800 as int) as chunk_index, substr(t, cast(p + 1 as bigint), 1000) as text from p"""


def recursive_chunks(spark, sf_dir):
    return chunking.recursive_chunks(_table(spark, sf_dir, "documents"))


def _recursive(docs: str, size: int = chunking.SIZE, overlap: int = chunking.OVERLAP) -> str:
    """CTEs from ``docs`` (doc_id, text) to ``chunked`` (doc_id, chunk_index, text).

    Each of four rounds splits what is too long at the first separator that it
    holds; neighbouring short units are joined by a fold over their running
    lengths, whose state is the first unit of the open chunk and the cuts made.
    """
    strip = r"regexp_replace({x}, '^[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+|[\s\x0B\x1C-\x1F\x{{85}}\p{{Z}}]+$', '', 'g')"
    seps = ("chr(10) || chr(10)", "chr(10)", "' '")
    out = f"q0 as (select doc_id, cast([] as int[]) as path, text, 0 as lv from ({docs}) where text <> '')"
    at = "case " + " ".join(f"when lv <= {i} and contains(text, {x}) then {i}" for i, x in enumerate(seps)) + " else 3 end"
    mark = "case sep " + " ".join(f"when {i} then {x}" for i, x in enumerate(seps)) + " end"
    for r in range(4):
        out += f""",
a{r} as (select doc_id, path, text, sep, {mark} as mark from (select *, {at} as sep from q{r})),
c{r} as (select doc_id, list_append(path, cast(p as int)) as path, 0 as n, substr(text, cast({size - overlap} * p + 1 as bigint), {size}) as chunk
  from (select *, unnest(range(0, 1 + cast(ceil(greatest(len(text) - {size}, 0) / {size - overlap}.0) as bigint))) as p from a{r} where sep = 3)),
s{r} as (select doc_id, path, sep, mark, string_split(text, mark) as parts from a{r} where sep < 3),
u{r} as (select doc_id, path, sep, unnest(generate_series(1, len(parts))) as k, unnest(list_transform(generate_series(1, len(parts)), lambda i: case when i = 1 then parts[1] else mark || parts[i] end)) as unit from s{r}),
v{r} as (select *, len(unit) >= {size} as long, cast(sum(cast(len(unit) >= {size} as int)) over (partition by doc_id, path order by k) as int) as g from u{r} where unit <> ''),
g{r} as (select doc_id, list_append(path, 2 * g) as path, list(unit order by k) as u from v{r} where not long group by doc_id, path, g),
p{r} as (select *, list_transform(generate_series(0, len(u)), lambda i: coalesce(list_sum(list_transform(u[1:i], lambda x: len(x))), 0)) as ps from g{r}),
f{r} as (select *, list_reduce(list_prepend({{'cuts': cast([] as bigint[][]), 's': cast(0 as bigint), 'i': cast(0 as bigint)}}, list_transform(generate_series(1, len(u)), lambda i: {{'cuts': cast([] as bigint[][]), 's': cast(0 as bigint), 'i': cast(i as bigint)}})),
  lambda a, x: case when x.i - 1 > a.s and ps[x.i + 1] - ps[a.s + 1] > {size} then {{'cuts': list_append(a.cuts, [a.s, x.i - 1]),
      's': greatest(a.s, cast(len(list_filter(ps, lambda t: t < ps[x.i] - least({overlap}, {size} - (ps[x.i + 1] - ps[x.i])))) as bigint)), 'i': x.i}} else {{'cuts': a.cuts, 's': a.s, 'i': x.i}} end) as f from p{r}),
d{r} as (select doc_id, path, unnest(generate_series(0, len(f.cuts))) as n, unnest(list_transform(list_append(f.cuts, [f.s, cast(len(u) as bigint)]), lambda c: array_to_string(u[c[1] + 1:c[2]], ''))) as chunk from f{r}),
q{r + 1} as (select doc_id, list_append(path, 2 * g - 1) as path, unit as text, sep + 1 as lv from v{r} where long)"""
    every = " union all ".join(f"select doc_id, path, n, chunk from {x}{r}" for r in range(4) for x in "cd")
    return out + f""",
pieces as (select doc_id, path, n, {strip.format(x="chunk")} as text from ({every})),
chunked as (select doc_id, row_number() over (partition by doc_id order by path, n) - 1 as chunk_index, text from pieces where text <> '')"""


_RECURSIVE = f"with {_recursive('select doc_id, text from documents')} select doc_id, chunk_index, text from chunked"


def short_recursive_chunks(spark, sf_dir):
    """The recursive splitter with other lengths than its own."""
    return chunking.recursive_chunks(_table(spark, sf_dir, "documents"), size=300, overlap=60)


_SHORT = f"with {_recursive('select doc_id, text from documents', 300, 60)} select doc_id, chunk_index, text from chunked"


def structure_sections(spark, sf_dir):
    return chunking.sections(legal_pages(spark, sf_dir))


_SECTIONED = f"with {_SECTIONS} select doc_id, page_number, section_idx, section_text, chapter, section from secs"


def semantic_chunks(spark, sf_dir):
    out = chunking.legal_chunks(legal_pages(spark, sf_dir))
    flat = [F.array_join(c, " ; ").alias(c) for c in ("citations", "legal_concepts")]
    return out.select("doc_id", "page_number", "section_idx", "chunk_idx", "content", "chapter", "section", "document_type", *flat, F.round("confidence_score", 6).alias("confidence_score"))


_SEMANTIC = f"""with {_CHUNKS} select doc_id, page_number, section_idx, chunk_idx, content, chapter, section, 'unknown' as document_type,
  {_joined("citations")} as citations, {_joined("legal_concepts")} as legal_concepts, round(confidence_score, 6) as confidence_score from scored"""


def corpus_report(spark, sf_dir):
    r = evaluate.corpus_report(chunking.legal_chunks(legal_pages(spark, sf_dir)))
    return r.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])


_REPORT = f"""with {_CHUNKS} select count(*) as total_chunks, round(avg(confidence_score), 6) as average_quality,
  count(*) filter (len(citations) > 0) as chunks_with_citations, count(*) filter (len(legal_concepts) > 0) as chunks_with_concepts,
  round(avg(cast(len(citations) > 0 as double)), 6) as citation_coverage, round(avg(cast(len(legal_concepts) > 0 as double)), 6) as concept_coverage,
  count(distinct nullif(chapter, '')) as chapters_identified, count(distinct nullif(section, '')) as sections_identified, round(avg(len(content)), 6) as average_chars from scored"""


def report_advice(spark, sf_dir):
    out = evaluate.recommendations(evaluate.corpus_report(chunking.legal_chunks(legal_pages(spark, sf_dir))))
    return out.select(F.array_join("recommendations", " | ").alias("advice"))


_ADVICE = f"""with {_CHUNKS}, r as (select avg(confidence_score) as q, avg(cast(len(citations) > 0 as double)) as c, avg(cast(len(legal_concepts) > 0 as double)) as k from scored)
select array_to_string(list_filter([case when q < 0.6 then 'raise chunk quality: detect more structure' end, case when c < 0.3 then 'raise citation coverage: extend the citation patterns' end,
  case when k < 0.5 then 'raise concept coverage: extend the concept keywords' end], lambda z: z is not null), ' | ') as advice from r"""


def best_chunks(spark, sf_dir):
    out = evaluate.best_chunks(chunking.legal_chunks(legal_pages(spark, sf_dir)), 3)
    return out.select("doc_id", "page_number", "section_idx", "chunk_idx", F.round("confidence_score", 6).alias("confidence_score"), X.preview_dots(F.col("content"), 150).alias("preview"))


_BEST = f"""with {_CHUNKS} select doc_id, page_number, section_idx, chunk_idx, round(confidence_score, 6) as confidence_score, content[1:150] || '...' as preview
from scored order by scored.confidence_score desc, doc_id, page_number, section_idx, chunk_idx limit 3"""


def system_stats(spark, sf_dir):
    return evaluate.system_stats(chunking.legal_chunks(legal_pages(spark, sf_dir)))


_STATS = f"""with {_CHUNKS} select count(*) as total_chunks, count(distinct (doc_id, page_number)) as total_pages,
  (select count(distinct c) from (select unnest(citations) as c from scored)) as unique_citations from scored"""


def page_sizes(spark, sf_dir):
    return evaluate.page_sizes(legal_pages(spark, sf_dir))


_SIZES = f"""with legal as ({LEGAL}) select doc_id, count(*) as pages, cast(sum(len(text)) as bigint) as chars, string_agg(text, '' order by page_number)[1:200] as head from legal group by doc_id"""


def index_records(spark, sf_dir):
    """Positions over all chunks, ids with gaps where chunks are blank, metadata, batches of 100."""
    chunks = index.with_position(legal_pages(spark, sf_dir).withColumn("text", F.when(F.col("doc_id") % 13 == 0, " ").otherwise(F.col("text"))), ["doc_id", "page_number"])
    rec = index.index_records(chunks)
    return index.batches(rec.withColumn("p", F.col("metadata.chunk_index")), "p").select("id", "document", F.col("p").alias("chunk_index"), F.col("metadata.chunk_length").alias("chunk_length"), F.col("metadata.source").alias("source"), "batch")


_INDEXED = f"""with legal as ({LEGAL}), c as (select case when doc_id % 13 = 0 then ' ' else text end as text, row_number() over (order by doc_id, page_number) - 1 as p from legal)
select 'chunk_' || p as id, text as document, p as chunk_index, cast(len(text) as int) as chunk_length, 'corpus' as source, p // 100 as batch from c where {_strip("text")} <> ''"""


def flat_store(spark, sf_dir):
    """The flat chunk table, written as Parquet and read again."""
    from docweave.sources.store import keep

    chunks = index.with_position(legal_pages(spark, sf_dir), ["doc_id", "page_number"])
    return keep(index.flat_records(chunks), "flat")


_FLAT = f"""with legal as ({LEGAL}), c as (select text, row_number() over (order by doc_id, page_number) - 1 as p from legal)
select 'chunk_' || p as chunk_id, text, p as chunk_index, 'corpus' as source from c"""


#: Stored indexes by session and tables: searches of one session share one.
_INDEXES: dict[tuple[str, str], str] = {}


def _documents_index(spark, sf_dir):
    """The inverted index of all documents, built by the first search that needs it."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _INDEXES or not store.exists(spark, f"{_INDEXES[key]}.totals"):
        path = f"{store.scratch_dir(spark)}/docweave-postings-{uuid.uuid4().hex}"
        retrieval.bm25_index(_table(spark, sf_dir, "documents"), path=path)
        _INDEXES[key] = path
    return retrieval.open_bm25_index(spark, _INDEXES[key])


def _questions(spark, sf_dir):
    """The opening user turns of each hundredth conversation."""
    asked = _table(spark, sf_dir, "conversations").where("role = 'user' and turn = 0 and conv_id % 100 = 0")
    return asked.select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))


def bm25_search(spark, sf_dir):
    """BM25 over all documents for the opening user turns of each hundredth conversation."""
    return retrieval.bm25(_questions(spark, sf_dir), _documents_index(spark, sf_dir))


_BM25_CTE = """
q as (select conv_id as query_id, text as query from conversations where role = 'user' and turn = 0 and conv_id % 100 = 0),
terms as (select query_id, unnest(list_distinct(regexp_extract_all(lower(query), '[\\p{L}\\p{N}]+'))) as term from q),
w as (select doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\\p{L}\\p{N}]+') as w from documents),
stat as (select count(*) as n, avg(len(w)) as avgdl from w),
tok as (select doc_id, len(w) as dl, unnest(w) as term from w),
tf as (select doc_id, dl, term, count(*) as tf from tok where term in (select term from terms) group by all),
df as (select term, count(*) as df from tf group by term),
s as (select query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl))), 6) as score
  from tf join df using (term) join terms using (term), stat group by all),
bm as (select query_id, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank, doc_id, score from s)"""
_BM25 = f"with {_BM25_CTE} select query_id, rank, doc_id, score from bm where rank <= 5"


def hybrid_search(spark, sf_dir):
    """BM25 and vector ranks fused; vectors are taken as the documents' by number."""
    e, asked = _table(spark, sf_dir, "embeddings"), _questions(spark, sf_dir)
    lexical = retrieval.bm25(asked, _documents_index(spark, sf_dir), 20)
    near = vector.top_k_batch(e.join(asked.select(F.col("query_id").alias("vec_id")), "vec_id", "left_semi"), e, 20)
    return retrieval.reciprocal_rank_fusion(lexical, near.withColumnRenamed("vec_id", "doc_id"))


_HYBRID = f"""with {_BM25_CTE},
d as (select q.vec_id as query_id, e.vec_id as doc_id, {_DIST.format(a="e.embedding", b="q.embedding")} as d from embeddings e, embeddings q where q.vec_id in (select query_id from q)),
v as (select query_id, row_number() over (partition by query_id order by d, doc_id) as rank, doc_id from d),
u as (select query_id, doc_id, rank from bm where rank <= 20 union all select query_id, doc_id, rank from v where rank <= 20),
f as (select query_id, doc_id, round(sum(1.0 / (60.0 + rank)), 9) as score from u group by all),
r as (select query_id, cast(row_number() over (partition by query_id order by score desc, doc_id) as int) as rank, doc_id, score from f)
select query_id, rank, doc_id, score from r where rank <= 5"""


def _with_documents(found: DataFrame, docs: DataFrame) -> DataFrame:
    """Found rows with their documents, of which only those are shuffled that were found."""
    return docs.join(store.maybe_broadcast(store.keep(found, "found"), 256), "doc_id")


def answer_context(spark, sf_dir):
    """Context, prompt length, offline answer and sources for the searched questions."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"))
    found = _with_documents(bm25_search(spark, sf_dir), docs)
    out = retrieval.answer(_questions(spark, sf_dir), found.select("query_id", "rank", "document"))
    return out.select("query_id", "question", F.length("prompt").alias("prompt_chars"), "answer", F.array_join("sources", " # ").alias("sources"))


_PROMPT_CHARS = len("Answer from the passages below only. Say so if they hold no answer.\n\nPassages:\n") + len("\n\nQuestion: ") + len("\nAnswer:")
_ANSWERED = f"""with {_BM25_CTE},
c as (select query_id, list(text order by rank) as d from bm join documents using (doc_id) where rank <= 5 group by query_id)
select q.query_id, query as question, cast({_PROMPT_CHARS} + len(coalesce(array_to_string(d, chr(10) || chr(10)), '')) + len(query) as int) as prompt_chars,
  coalesce(case when len(d[1]) > 500 then d[1][1:500] || '...' else d[1] end, '') as answer, coalesce(array_to_string(d[1:3], ' # '), '') as sources from q left join c using (query_id)"""


def _retrieved(spark, sf_dir):
    text = F.col("text")
    return legal_pages(spark, sf_dir).select((F.col("doc_id") % 7).cast("int").alias("query_id"), text.alias("content"), X.concepts(text).alias("concepts"), X.citations(text).alias("citations"))


def retrieval_eval(spark, sf_dir):
    """The three metrics of each evaluation case for pages dealt to the cases."""
    m = evaluate.retrieval_metrics(evaluate.cases_table(spark), _retrieved(spark, sf_dir))
    return m.select("query_id", "difficulty", *[F.round(c, 6).alias(c) for c in evaluate.METRICS])


def _list(words) -> str:
    return "cast([" + ", ".join("'" + w.replace("'", "''") + "'" for w in words or []) + "] as varchar[])"


_CASES = "select * from (values " + ", ".join(f"({i}, '{q}', {_list(k)}, {_list(c)}, {_list(t)}, '{d}')" for i, (q, k, c, t, d) in enumerate(P.EVAL_CASES)) + ") t(query_id, query, k, c, t, difficulty)"
_METRICS = f"""legal as ({LEGAL}), cases as ({_CASES}),
r as (select doc_id % 7 as query_id, text, {_concepts("text")} as cons, {_citations("text")} as cits from legal),
j as (select cases.*, text, cons, cits, len(list_filter(t, lambda z: contains(lower(text), lower(z)))) / len(t) as share from cases left join r on cases.query_id = r.query_id),
m as (select query_id, any_value(query) as query, any_value(difficulty) as difficulty, any_value(k) as k, any_value(c) as c,
  least(coalesce(avg(case when text is not null then share end), 0.0), 1.0) as relevance, list_distinct(flatten(list(coalesce(cons, [])))) as sk, list_distinct(flatten(list(coalesce(cits, [])))) as sc from j group by query_id),
g as (select query_id, query, difficulty, relevance, case when len(k) = 0 then 1.0 else len(list_intersect(k, sk)) / len(k) end as concept_coverage,
  case when len(c) = 0 then 1.0 when len(sc) = 0 then 0.0 else len(list_filter(c, lambda e: len(list_filter(sc, lambda f: contains(f, e))) > 0)) / len(c) end as citation_preservation from m)"""
_EVAL = f"with {_METRICS} select query_id, difficulty, round(relevance, 6) as relevance, round(concept_coverage, 6) as concept_coverage, round(citation_preservation, 6) as citation_preservation from g"


def eval_rollup(spark, sf_dir):
    r = evaluate.metric_rollup(evaluate.retrieval_metrics(evaluate.cases_table(spark), _retrieved(spark, sf_dir)))
    return r.select(*[F.round(c, 6).alias(c) for c in r.columns])


_ROLLUP = f"""with {_METRICS}, a as (select avg(relevance) as r, avg(concept_coverage) as k, avg(citation_preservation) as c from g)
select round(r, 6) as avg_relevance, round(k, 6) as avg_concept_coverage, round(c, 6) as avg_citation_preservation, round((r + k + c) / 3, 6) as overall_score from a"""


def _variants(spark, sf_dir):
    """Two answer tables over all opening turns, made from the conversations."""
    first = _table(spark, sf_dir, "conversations").where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    lat = lambda n: ((F.col("query_id") * n) % 97).cast("double") / 16
    cites = lambda n: F.array_repeat(F.lit("c"), (F.col("query_id") % n).cast("int"))
    base = first.select("query_id", "query", lat(31).alias("latency"), F.col("query").alias("answer"), cites(4).alias("citations"))
    new = first.select("query_id", "query", lat(17).alias("latency"), F.when(F.col("query_id") % 3 == 0, F.concat("query", F.lit(" \n"))).otherwise("other").alias("answer"), cites(5).alias("citations"))
    return base, new


def ab_rows(spark, sf_dir):
    return evaluate.compare_variants(*_variants(spark, sf_dir))


_AB = """select conv_id as query_id, text as query, cast((conv_id * 31) % 97 as double) / 16 - cast((conv_id * 17) % 97 as double) / 16 as latency_delta,
  cast(conv_id % 5 - conv_id % 4 as int) as citation_gain, trim(text, ' ' || chr(10) || chr(9)) = trim(case when conv_id % 3 = 0 then text || ' ' || chr(10) else 'other' end, ' ' || chr(10) || chr(9)) as identical_answer from conversations where turn = 0"""


def ab_summary(spark, sf_dir):
    s = evaluate.comparison_summary(evaluate.compare_variants(*_variants(spark, sf_dir)))
    return s.select(*[F.round(c, 6).alias(c) for c in s.columns])


_AB_SUM = f"with r as ({_AB}) select round(median(latency_delta) * 1000, 6) as p50_speedup_ms, round(avg(citation_gain), 6) as avg_citation_gain, round(avg(cast(identical_answer as double)), 6) as identical_ratio from r"


def coherence_rules(spark, sf_dir):
    """Coherence of each page, and whether its second page would break the first one's unity."""
    t = F.col("text")
    p = legal_pages(spark, sf_dir).select("doc_id", "page_number", "text", X.concepts(t).alias("k"), X.citations(t).alias("c"))
    p = p.withColumn("unit", X.coherent(t, F.col("k"), F.col("c")))
    one, two = (p.where(F.col("page_number") == n).select("doc_id", *[F.col(c).alias(f"{c}{n}") for c in ("text", "k", "unit")]) for n in (1, 2))
    both = one.join(two, "doc_id")
    return both.select("doc_id", F.col("unit1").alias("unit_one"), F.col("unit2").alias("unit_two"), X.breaks_unity(F.col("text1"), F.col("text2"), F.col("k1"), F.col("k2")).alias("breaks"))


def _unit(x: str) -> str:
    return f"({_has(x, 'definition')} or ({_has(x, 'elements')} and len({_all(x, 'numbered', 0)}) >= 2) or (len({_concepts(x)}) <= 2 and len({_citations(x)}) > 0))"


_COHERENT = f"""with p as (select doc_id, {_PAGE_1} as a, {_PAGE_2} as b from documents)
select doc_id, {_unit("a")} as unit_one, {_unit("b")} as unit_two, case when {_has("a", "elements")} and {_has("b", "numbered")} then false
  when (contains(a, 'means') or contains(a, 'defined as')) and contains(lower(b), 'example') then false else not list_has_any({_concepts("a")}, {_concepts("b")}) end as breaks from p"""


def report_json(spark, sf_dir):
    """The corpus report's counts as one JSON row."""
    from docweave.sources.store import report_json as as_json

    r = evaluate.corpus_report(chunking.legal_chunks(legal_pages(spark, sf_dir)))
    return as_json(r.select("total_chunks", "chapters_identified", "sections_identified"))


_JSON = f"""with {_CHUNKS} select '{{"total_chunks":' || count(*) || ',"chapters_identified":' || count(distinct nullif(chapter, '')) || ',"sections_identified":' || count(distinct nullif(section, '')) || '}}' as json from scored"""

def variant_texts(spark, sf_dir):
    """Texts that come under different names, normalised; what is blank afterwards is marked."""
    docs = _table(spark, sf_dir, "documents")
    mixed = docs.select(
        "doc_id",
        F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("text"),
        F.when(F.col("doc_id") % 3 == 1, F.col("text")).alias("content"),
        F.when(F.col("doc_id") % 5 == 2, F.lit("  ")).alias("page_content"),
        F.concat(F.lit("raw "), F.col("lang")).alias("raw"),
    )
    text = index.variant_text(mixed)
    return mixed.select("doc_id", text.alias("chunk"), X.is_blank(text).alias("blank"))


_VARIANTS = f"""with v as (select doc_id, coalesce(case when doc_id % 3 = 0 then text end, case when doc_id % 3 = 1 then text end, case when doc_id % 5 = 2 then '  ' end, 'raw ' || lang) as chunk from documents)
select doc_id, chunk, {_strip("chunk")} = '' as blank from v"""


def inspect_table(spark, sf_dir):
    """Size, columns and the first row's kind, keys and text."""
    return index.inspect(_table(spark, sf_dir, "documents"), ["doc_id"])


_INSPECTED = """with f as (select * from documents order by doc_id limit 1) select 'table' as container, (select count(*) from documents) as rows, 'doc_id,text,lang,source,n_chars' as columns, 'dict' as first_type,
  array_to_string(list_filter([case when doc_id is not null then 'doc_id' end, case when text is not null then 'text' end, case when lang is not null then 'lang' end,
  case when source is not null then 'source' end, case when n_chars is not null then 'n_chars' end], lambda x: x is not null), ',') as first_keys, text[1:200] || '...' as first_text from f"""


def rendered_chunks(spark, sf_dir):
    """Texts that come under different names or none, rendered; those with a text cleaned in place."""
    docs = _table(spark, sf_dir, "documents")
    mixed = docs.select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.col("text")).alias("text"), F.when(F.col("doc_id") % 3 == 1, F.col("text")).alias("content"), "lang")
    clean = index.cleaned_variants(mixed)
    return clean.select("doc_id", "content", index.rendered_text(clean).alias("chunk"))


_RENDERED = f"""with m as (select doc_id, {_clean("case when doc_id % 3 = 0 then text end")} as text, {_clean("case when doc_id % 3 = 1 then text end")} as content, lang from documents)
select doc_id, content, coalesce(text, content, '{{"doc_id":' || doc_id || case when lang is not null then ',"lang":"' || lang || '"' else '' end || '}}') as chunk from m"""


def record_shapes(spark, sf_dir):
    """The other two shapes of records: nested metadata, and pages with their numbers."""
    pages = index.with_position(legal_pages(spark, sf_dir), ["doc_id", "page_number"])
    one = index.nested_records(pages).select("id", "text", F.col("metadata.chunk_index").alias("n"), F.col("metadata.char_count").alias("size"), F.col("metadata.source").alias("source"))
    two = index.page_records(pages, text_col="text", page_col="page_number")
    return one.unionByName(two.select("id", F.col("document").alias("text"), F.col("metadata.page").cast("long").alias("n"), F.length("document").alias("size"), F.lit("page").alias("source")))


_SHAPES = f"""with legal as ({LEGAL}), c as (select *, row_number() over (order by doc_id, page_number) - 1 as p from legal)
select 'chunk_' || p as id, text, p as n, cast(len(text) as int) as size, 'corpus' as source from c
union all select 'id_' || p, text, cast(page_number as bigint), cast(len(text) as int), 'page' from c"""


def search_envelope(spark, sf_dir):
    """The search's cards as a list for each question, with how many were found."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("document"))
    found = _with_documents(bm25_search(spark, sf_dir), docs)
    found = found.withColumn("citations", X.citations(F.col("document"))).withColumn("concepts", X.concepts(F.col("document")))
    out = retrieval.search_result(retrieval.search_cards(found).select("query_id", "rank", "doc_id", "highlighted_content", "legal_terms"), kind="lexical")
    return out.select("query_id", "total_found", "search_type", "search_time", F.array_join(F.transform("results", lambda r: F.concat_ws("|", r["doc_id"].cast("string"), F.array_join(r["legal_terms"], ","), r["highlighted_content"])), " # ").alias("results"))


_ENVELOPE = f"""with {_BM25_CTE},
j as (select query_id, rank, cast(doc_id as varchar) || '|' || array_to_string(list_slice({_concepts("coalesce(text, '')")}, 1, 5), ',') || '|' || coalesce(text, '')[1:300] || '...' as r from bm join documents using (doc_id) where rank <= 5)
select query_id, cast(count(*) as int) as total_found, 'lexical' as search_type, cast(0 as double) as search_time, string_agg(r, ' # ' order by rank) as results from j group by query_id"""


def search_page(spark, sf_dir):
    """What a result page shows: the number found, the best passage with its
    marks, and what made the document relevant."""
    asked = _table(spark, sf_dir, "conversations").where("role = 'user' and turn = 0 and conv_id % 20 = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"))
    found = _with_documents(retrieval.explained_bm25(asked, _documents_index(spark, sf_dir)), docs)
    return retrieval.best_passages(found, asked).select("query_id", "rank", "doc_id", "total_found", "relevance_explanation", "highlighted_content")


_TOKENS_OF = "list_distinct(regexp_extract_all(lower({x}), '[\\p{{L}}\\p{{N}}]+'))"
_PAGE = f"""with {_BM25_CTE.replace("conv_id % 100 = 0", "conv_id % 20 = 0")},
pt as (select query_id, doc_id, term, round(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (1 - 0.75 + 0.75 * dl / avgdl)), 6) as part
  from tf join df using (term) join terms using (term), stat),
why as (select query_id, doc_id, sum(part) as total, list(struct_pack(part := part, term := term) order by part desc, term) as t from pt group by all),
top as (select query_id, rank, bm.doc_id, text, {_TOKENS_OF.format(x="query")} as qt from bm join q using (query_id) join documents d on d.doc_id = bm.doc_id where rank <= 5),
ws as (select *, regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f]+') as w from top),
ex as (select query_id, doc_id, qt, unnest(w) as word, cast(unnest(generate_series(0, len(w) - 1)) as int) as pos from ws),
hit as (select query_id, doc_id, pos, unnest(list_intersect({_TOKENS_OF.format(x="word")}, qt)) as term from ex),
run as (select query_id, doc_id, pos, count(distinct term) over w as terms, count(*) over w as hits from hit window w as (partition by query_id, doc_id order by pos range between current row and 39 following)),
best as (select query_id, doc_id, first(pos order by terms desc, hits desc, pos) as start from run group by all),
totals as (select query_id, count(*) as total_found from bm group by query_id)
select query_id, rank, doc_id, total_found, array_to_string(list_transform(t[1:3], lambda z: z.term || ' ' || cast(cast(round(100 * z.part / total) as int) as varchar) || ' %'), ', ') as relevance_explanation,
  array_to_string(list_transform(list_slice(w, start + 1, start + 40), lambda z: case when list_has_any({_TOKENS_OF.format(x="z")}, qt) then '**' || z || '**' else z end), ' ') as highlighted_content
from ws join best using (query_id, doc_id) join why using (query_id, doc_id) join totals using (query_id)"""


def search_response(spark, sf_dir):
    """The search's whole answer, its results flattened; the time is told as positive."""
    asked = _table(spark, sf_dir, "conversations").where("role = 'user' and turn = 0 and conv_id % 20 = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"))
    out = lifecycles.search_response(_documents_index(spark, sf_dir), docs, asked)
    flat = F.transform("results", lambda r: F.concat_ws("|", r["doc_id"].cast("string"), _four_digits(r["score"]), r["highlighted_content"], F.array_join(r["citations"], ","), F.array_join(r["legal_terms"], ","), r["relevance_explanation"]))
    return out.select("query_id", "total_found", "search_type", (F.col("search_time") > 0).alias("timed"), F.array_join(flat, " # ").alias("results"))


_RESPONSE = f"""with p as ({_PAGE}), s as (with {_BM25_CTE.replace("conv_id % 100 = 0", "conv_id % 20 = 0")} select query_id, doc_id, score from bm where rank <= 5),
c as (select p.*, s.score, {_citations("coalesce(text, '')")} as cits, {_concepts("coalesce(text, '')")} as cons from p join s using (query_id, doc_id) join documents using (doc_id))
select query_id, any_value(total_found) as total_found, 'lexical' as search_type, true as timed,
  string_agg(doc_id || '|' || printf('%.4f', score) || '|' || highlighted_content || '|' || array_to_string(cits[1:3], ',') || '|' || array_to_string(cons[1:5], ',') || '|' || relevance_explanation, ' # ' order by rank) as results from c group by query_id"""


def concept_changes(spark, sf_dir):
    """Concepts of a map of keywords after additions and removals, as values found by key with a default."""
    t = _table(spark, sf_dir, "documents")
    words = F.create_map(*[F.lit(x) for pair in (("and", "joins"), ("the", "article"), ("zzz", "never")) for x in pair])
    counts = F.map_from_arrays(F.map_keys(words), F.transform(F.map_keys(words), lambda w: F.size(F.split(F.lower(F.coalesce("text", F.lit(""))), w)) - 1))
    some = F.map_filter(counts, lambda k, v: v > 0)
    return t.select("doc_id", F.array_join(F.array_sort(F.map_keys(some)), ",").alias("seen"), F.coalesce(F.element_at(some, F.lit("and")), F.lit(0)).alias("n_and"), F.coalesce(F.element_at(words, F.lit("missing")), F.lit("none")).alias("fallback"))


_CHANGES = """with c as (select doc_id, lower(coalesce(text, '')) as t from documents)
select doc_id, array_to_string(list_filter([case when contains(t, 'and') then 'and' end, case when contains(t, 'the') then 'the' end, case when contains(t, 'zzz') then 'zzz' end], lambda x: x is not null), ',') as seen,
  cast(len(string_split(t, 'and')) - 1 as int) as n_and, 'none' as fallback from c"""


def dictionary_tags(spark, sf_dir):
    """The concepts of all pages by a stored dictionary, in one pass."""
    path = f"{store.scratch_dir(spark)}/docweave-dictionary-{uuid.uuid4().hex}"
    dictionary.from_mapping(spark).write.parquet(path)
    pages = dictionary.tagged(legal_pages(spark, sf_dir), dictionary.read_dictionary(spark, path), name="concepts")
    return pages.select("doc_id", "page_number", F.array_join("concepts", ",").alias("concepts"))


def keyword_items(spark, sf_dir):
    """Which benchmark items' longer words stand in which documents: a dictionary of thousands."""
    words = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}]{6,}"), F.lit(0)))).alias("keyword")
    known = _table(spark, sf_dir, "benchmark").select(F.col("item_id").cast("string").alias("concept"), words, F.col("item_id").alias("place"))
    found = dictionary.tagged(_table(spark, sf_dir, "documents"), known, name="items")
    return found.select("doc_id", F.size("items").alias("n_items"), F.array_join("items", ",").alias("items"))


_KEYWORDS = """with k as (select distinct item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}]{6,}')) as word from benchmark),
w as (select word, list(item_id) as those from k group by word),
h as (select distinct doc_id, unnest(those) as item_id from documents join w on contains(lower(text), word)),
g as (select doc_id, count(*) as n, string_agg(cast(item_id as varchar), ',' order by item_id) as items from h group by doc_id)
select d.doc_id, cast(coalesce(n, 0) as int) as n_items, coalesce(items, '') as items from documents d left join g on d.doc_id = g.doc_id"""


def _chunk_records(spark, sf_dir):
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return chunking.sliding_chunks(docs).select(F.concat_ws(":", F.col("doc_id").cast("string"), F.col("chunk_index").cast("string")).alias("id"), F.col("text").alias("document"))


def embedding_cache(spark, sf_dir):
    """How many chunks and different texts there are, and how many the first and
    a second call embed."""
    path = f"{store.scratch_dir(spark)}/docweave-cache-{uuid.uuid4().hex}"
    records = _chunk_records(spark, sf_dir)
    rows = cached.cached_embeddings(records, path).count()
    first = cached.made_in_last_run(records, path)
    again = cached.cached_embeddings(records, path).where(F.size("embedding") == 64).count()
    made = spark.read.parquet(path).count()
    return records.agg(F.count_distinct("document").alias("texts")).select(F.lit(rows).cast("long").alias("chunks"), "texts", F.lit(first).cast("long").alias("made_first"), F.lit(made - first).cast("long").alias("made_again"), F.lit(again).cast("long").alias("chunks_again"))


_CACHED = f"""with s as ({_SLIDING}) select count(*) as chunks, count(distinct text) as texts, count(distinct text) as made_first, cast(0 as bigint) as made_again, count(*) as chunks_again from s"""


def model_batches(spark, sf_dir):
    """Vectors by a model in batches beside those of the column function."""
    t = _table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = t.select("doc_id", embed.hashed(F.col("text")).alias("one"), embed.batched(embed.hashed_model, 64)(F.col("text")).alias("two"))
    return both.agg(F.count("*").alias("documents"), F.count_if(F.col("one") == F.col("two")).alias("equal"))


_BATCHED = "select count(*) as documents, count(*) as equal from documents"


def answer_cache(spark, sf_dir):
    """Answers to all opening turns, asked twice; how many runs it took to make each."""
    path = f"{store.scratch_dir(spark)}/docweave-answers-{uuid.uuid4().hex}"
    asked = _table(spark, sf_dir, "conversations").where("turn = 0").select("conv_id", F.col("text").alias("prompt"))
    speak = cached.guarded(lambda t: t[:80] + "...")
    cached.cached_answers(asked, path, speak).count()
    again = cached.cached_answers(asked, path, speak)
    return again.select("conv_id", "answer", F.lit(spark.read.parquet(path).select("key").distinct().count() == spark.read.parquet(path).count()).alias("made_once"))


_ANSWERS = "select conv_id, substr(coalesce(text, ''), 1, 80) || '...' as answer, true as made_once from conversations where turn = 0"


def collection_upsert(spark, sf_dir):
    """A collection after a change of every fifth record, ten new ones and the end of every seventh."""
    path = f"{store.scratch_dir(spark)}/docweave-upsert-{uuid.uuid4().hex}"
    docs = _table(spark, sf_dir, "documents")
    record = lambda text: [F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("id"), text.alias("document"), F.struct(F.col("lang").alias("source")).alias("metadata")]
    text = F.coalesce("text", F.lit(""))
    store.upsert_collection(docs.select(*record(text)), path, embed.with_embedding)
    changed = docs.where("doc_id % 5 = 0").select(*record(F.concat(F.lit("new "), text)))
    added = docs.where("doc_id < 10").withColumn("doc_id", F.col("doc_id") + 1_000_000).select(*record(text))
    out = store.upsert_collection(changed.union(added), path, embed.with_embedding, docs.where("doc_id % 7 = 0").select(record(text)[0]))
    return out.select("id", "document", F.col("metadata.source").alias("source"), F.size("embedding").alias("dim"))


_UPSERTED = """select 'doc_' || doc_id as id, case when doc_id % 5 = 0 then 'new ' else '' end || coalesce(text, '') as document, lang as source, cast(64 as int) as dim from documents where doc_id % 7 <> 0
union all select 'doc_' || (doc_id + 1000000), coalesce(text, ''), lang, 64 from documents where doc_id < 10"""


def stored_statistics(spark, sf_dir):
    """The corpus report and the system's figures from statistics that were kept
    while chunks arrived in three parts."""
    path = f"{store.scratch_dir(spark)}/docweave-statistics-{uuid.uuid4().hex}"
    chunks = store.keep(chunking.legal_chunks(legal_pages(spark, sf_dir)), "chunks")
    for part in range(3):
        evaluate.add_statistics(chunks.where(F.pmod("doc_id", F.lit(3)) == part), path)
    r = evaluate.stored_statistics(spark, path)
    return r.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in r.dtypes])


_STORED = f"""with {_CHUNKS} select count(*) as total_chunks, round(avg(confidence_score), 6) as average_quality,
  count(*) filter (len(citations) > 0) as chunks_with_citations, count(*) filter (len(legal_concepts) > 0) as chunks_with_concepts,
  round(avg(cast(len(citations) > 0 as double)), 6) as citation_coverage, round(avg(cast(len(legal_concepts) > 0 as double)), 6) as concept_coverage,
  count(distinct nullif(chapter, '')) as chapters_identified, count(distinct nullif(section, '')) as sections_identified, round(avg(len(content)), 6) as average_chars,
  count(distinct (doc_id, page_number)) as total_pages, (select count(distinct c) from (select unnest(citations) as c from scored)) as unique_citations from scored"""


def joined_pages(spark, sf_dir):
    """Each document's page texts in page order, without a separator."""
    return store.page_texts(legal_pages(spark, sf_dir))


_JOINED = f"with legal as ({LEGAL}) select doc_id, string_agg(text, '' order by page_number) as text from legal group by doc_id"


def fallback_scan(spark, sf_dir):
    """Two columns of chunks in JSON lines, found after a Parquet path that isn't there."""
    path = f"{store.scratch_dir(spark)}/docweave-chunks-{uuid.uuid4().hex}"
    _chunk_records(spark, sf_dir).withColumn("source", F.lit("corpus")).write.json(f"{path}.jsonl")
    return store.read_chunks(spark, f"{path}.parquet", f"{path}.jsonl", columns=["id", "document"])


_SCANNED = f"with s as ({_SLIDING}) select doc_id || ':' || chunk_index as id, text as document from s"


def text_dump(spark, sf_dir):
    """All texts written as lines, and how often each line that is read back stands there."""
    path = f"{store.scratch_dir(spark)}/docweave-dump-{uuid.uuid4().hex}"
    store.write_texts(_table(spark, sf_dir, "documents").where("text is not null"), path)
    return spark.read.text(path, lineSep="\n").groupBy("value").agg(F.count("*").alias("n"))


_DUMPED = "select value, count(*) as n from (select unnest(string_split(text, chr(10))) as value from documents where text is not null) group by value"


def keyword_counts(spark, sf_dir):
    """How often the keywords of each concept stand in the pages, from the maps' entries."""
    counts = F.map_entries(X.keyword_counts(F.col("text")))
    said = F.transform(F.array_sort(counts), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return legal_pages(spark, sf_dir).select("doc_id", "page_number", F.array_join(said, ",").alias("counts"))


def _counted_sql(x: str) -> str:
    parts = []
    for name, words in P.CONCEPTS.items():
        n = " + ".join(f"(len(string_split(lower({x}), '{w.lower()}')) - 1)" for w in words)
        parts.append(f"{{'k': '{name}', 'n': {n}}}")
    kept = f"list_sort(list_filter([{', '.join(parts)}], lambda z: z.n > 0))"
    return f"array_to_string(list_transform({kept}, lambda z: z.k || '=' || cast(z.n as varchar)), ',')"


_KEYWORD_COUNTS = f"with legal as ({LEGAL}) select doc_id, page_number, {_counted_sql('text')} as counts from legal"


def derived_cases(spark, sf_dir):
    """Evaluation cases from all conversations' opening turns and their answers."""
    t = _table(spark, sf_dir, "conversations")
    asked = t.where("turn = 0").select(F.col("conv_id").alias("query_id"), F.col("text").alias("query"))
    answers = t.where("turn = 1").select(F.col("conv_id").alias("query_id"), F.concat(F.coalesce("text", F.lit("")), F.when(F.col("conv_id") % 4 == 0, F.lit(" A warrant: M.G.L. c. 276, § 1.")).otherwise("")).alias("answer"))
    c = evaluate.cases_from(asked.join(answers, "query_id", "left"))
    return c.select("query_id", "query", *[F.array_join(n, ",").alias(n) for n in ("expected_concepts", "expected_citations", "required_terms")], "difficulty")


_DERIVED = f"""with a as (select conv_id, coalesce(text, '') || case when conv_id % 4 = 0 then ' A warrant: M.G.L. c. 276, § 1.' else '' end as answer from conversations where turn = 1),
j as (select o.conv_id as query_id, o.text as query, coalesce(answer, '') as answer from conversations o left join a on o.conv_id = a.conv_id where o.turn = 0),
m as (select *, {_concepts("answer")} as k, {_citations("answer")} as c, list_distinct(regexp_extract_all(lower(coalesce(query, '')), '[\\p{{L}}\\p{{N}}]+')) as w from j)
select query_id, query, array_to_string(k, ',') as expected_concepts, array_to_string(c, ',') as expected_citations,
  array_to_string(list_transform(list_sort(list_transform(w, lambda z: {{'n': -len(z), 'w': z}}))[1:3], lambda z: z.w), ',') as required_terms,
  case when len(k) + len(c) = 0 then 'basic' when len(k) + len(c) <= 2 then 'intermediate' else 'advanced' end as difficulty from m"""


def searched_eval(spark, sf_dir):
    """The three metrics of each evaluation case for what the lexical search returns."""
    stored = _documents_index(spark, sf_dir)
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("document"))

    def search(queries: DataFrame, k: int) -> DataFrame:
        return _with_documents(retrieval.bm25(queries, stored, k), docs)

    m = lifecycles.evaluate_search(search, evaluate.cases_table(spark), 20)
    return m.select("query_id", "difficulty", *[F.round(c, 6).alias(c) for c in evaluate.METRICS])


_SEARCHED = f"""with cases as ({_CASES}), {_BM25_CTE.replace("select conv_id as query_id, text as query from conversations where role = 'user' and turn = 0 and conv_id % 100 = 0", "select query_id, query from cases")},
r as (select query_id, coalesce(text, '') as text, {_concepts("coalesce(text, '')")} as cons, {_citations("coalesce(text, '')")} as cits from bm join documents using (doc_id) where rank <= 20),
{_METRICS[_METRICS.index("j as (select cases"):]} select query_id, difficulty, round(relevance, 6) as relevance, round(concept_coverage, 6) as concept_coverage, round(citation_preservation, 6) as citation_preservation from g"""


def exit_words(spark, sf_dir):
    """Lines of the conversations that would end or not reach an interactive session."""
    t = _table(spark, sf_dir, "conversations")
    line = F.when(F.col("conv_id") % 4 == 0, F.lit("Quit")).when(F.col("conv_id") % 4 == 1, F.lit(" \t")).otherwise(F.col("text"))
    return t.select("conv_id", "turn", X.wants_exit(line).alias("ends"), X.is_blank(line).alias("skipped"))


_EXITS = f"""with l as (select conv_id, turn, case when conv_id % 4 = 0 then 'Quit' when conv_id % 4 = 1 then ' ' || chr(9) else text end as t from conversations)
select conv_id, turn, lower(t) in ('quit', 'exit', 'q') as ends, {_strip("t")} = '' as skipped from l"""


def eval_cases(spark, sf_dir):
    c = evaluate.cases_table(spark)
    lists = [F.array_join(F.coalesce(n, F.array().cast("array<string>")), ",").alias(n) for n in ("expected_concepts", "expected_citations", "required_terms")]
    return c.select("query_id", "query", *lists, "difficulty")


_CASE_ROWS = f"select query_id, query, array_to_string(k, ',') as expected_concepts, array_to_string(c, ',') as expected_citations, array_to_string(t, ',') as required_terms, difficulty from ({_CASES})"


def nested_result(spark, sf_dir):
    """The batch search in its nested form: lists in rank order for each query."""
    e = _table(spark, sf_dir, "embeddings")
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), X.preview(F.coalesce("text", F.lit("")), 100).alias("document"))
    out = vector.nested_result(vector.top_k_batch(e.where("vec_id % 100 = 0"), e, 5), docs)
    return out.select("query_id", F.array_join("ids", ",").alias("ids"), F.array_join("documents", " # ").alias("documents"))


_NESTED = f"""with n as ({_KNN}), j as (select query_id, rank, vec_id, case when len(coalesce(text, '')) > 100 then text[1:100] || '...' else coalesce(text, '') end as d from n join documents on vec_id = doc_id)
select query_id, string_agg(cast(vec_id as varchar), ',' order by rank) as ids, string_agg(d, ' # ' order by rank) as documents from j group by query_id"""


def vector_collection(spark, sf_dir):
    """Clean, split, number, embed and store all documents; the stored collection without its vectors."""
    stored = lifecycles.build_corpus(_table(spark, sf_dir, "documents"), f"{store.scratch_dir(spark)}/docweave-collection-{uuid.uuid4().hex}")
    return stored.select("id", F.length("document").alias("chars"), "metadata.chunk_index", F.size("embedding").alias("dim"))


_COLLECTED = f"""with {_recursive(f"select doc_id, {_clean('text')} as text from (select doc_id, coalesce(text, '') as text from documents)")},
n as (select *, row_number() over (order by doc_id, chunk_index) - 1 as p from chunked)
select 'chunk_' || p as id, cast(len(text) as int) as chars, p as chunk_index, cast(64 as int) as dim from n"""


def page_chars(spark, sf_dir):
    return legal_pages(spark, sf_dir).select("doc_id", "page_number", F.length("text").alias("chars"), F.size(F.split("text", "\n", -1)).alias("lines"))


_PAGE_CHARS = f"with legal as ({LEGAL}) select doc_id, page_number, cast(len(text) as int) as chars, cast(len(string_split(text, chr(10))) as int) as lines from legal"

QUERIES = {
    "r4_knn_batch": (knn_batch, _KNN),
    "r3_knn_from_index": (knn_from_index, _KNN),
    "r3_index_recall": (index_recall, _RECALLED),
    "r2_knn_single": (knn_single, _KNN_ONE),
    "p9_page_structure": (page_structure, _STRUCTURE),
    "t1_clean_text": (text_clean, _CLEANED),
    "p8_previews": (previews, _PREVIEWS),
    "t8_citations": (citation_extract, _CITED),
    "t9_concepts": (concept_tags, _TAGGED),
    "t2_recursive_chunks": (recursive_chunks, _RECURSIVE),
    "t2s_sliding_chunks": (sliding_chunks, _SLIDING),
    "t3_sections": (structure_sections, _SECTIONED),
    "t5_semantic_chunks": (semantic_chunks, _SEMANTIC),
    "t6_coherence": (coherence_rules, _COHERENT),
    "a15_corpus_report": (corpus_report, _REPORT),
    "p15_report_advice": (report_advice, _ADVICE),
    "k7_report_json": (report_json, _JSON),
    "o1_best_chunks": (best_chunks, _BEST),
    "x1_system_stats": (system_stats, _STATS),
    "s3_page_sizes": (page_sizes, _SIZES),
    "p3_index_records": (index_records, _INDEXED),
    "k2_flat_store": (flat_store, _FLAT),
    "x3_bm25": (bm25_search, _BM25),
    "x3_hybrid": (hybrid_search, _HYBRID),
    "r6_answer_context": (answer_context, _ANSWERED),
    "a7_retrieval_eval": (retrieval_eval, _EVAL),
    "a10_eval_rollup": (eval_rollup, _ROLLUP),
    "a14_ab_rows": (ab_rows, _AB),
    "a11_ab_summary": (ab_summary, _AB_SUM),
    "p1_variant_text": (variant_texts, _VARIANTS),
    "p7_inspect": (inspect_table, _INSPECTED),
    "p1_rendered_chunks": (rendered_chunks, _RENDERED),
    "p4_record_shapes": (record_shapes, _SHAPES),
    "x3_search_envelope": (search_envelope, _ENVELOPE),
    "x3_search_page": (search_page, _PAGE),
    "x3_search_response": (search_response, _RESPONSE),
    "d8_map_functions": (concept_changes, _CHANGES),
    "p11_exit_words": (exit_words, _EXITS),
    "s1_joined_pages": (joined_pages, _JOINED),
    "s4_fallback_scan": (fallback_scan, _SCANNED),
    "s13_derived_cases": (derived_cases, _DERIVED),
    "k1_text_dump": (text_dump, _DUMPED),
    "u3_short_recursive_chunks": (short_recursive_chunks, _SHORT),
    "d8_keyword_counts": (keyword_counts, _KEYWORD_COUNTS),
    "u5_dictionary_tags": (dictionary_tags, _TAGGED),
    "u5_keyword_items": (keyword_items, _KEYWORDS),
    "u1_embedding_cache": (embedding_cache, _CACHED),
    "u1_model_batches": (model_batches, _BATCHED),
    "r8_answer_cache": (answer_cache, _ANSWERS),
    "k6_collection_upsert": (collection_upsert, _UPSERTED),
    "x2_stored_statistics": (stored_statistics, _STORED),
    "a7_searched_eval": (searched_eval, _SEARCHED),
    "s13_eval_cases": (eval_cases, _CASE_ROWS),
    "d10_nested_result": (nested_result, _NESTED),
    "k5_vector_collection": (vector_collection, _COLLECTED),
    "a16_page_chars": (page_chars, _PAGE_CHARS),
}
