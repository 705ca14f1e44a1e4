"""URL filter by a path-template tree, with DataFrame functions only.

Explicit rules (host, path, verdict) judge the urls that they fit, and serve
as labels. For the others: per host, path segments become a tree. Segments that
look variable (numbers, ids) become a wildcard of their kind; at a node with
more than KIDS children, those with under a KIDS-th of its urls become one
wildcard. Level by level, branches of one node that have the same shape below
are merged, if their labelled shares are no further apart than chance allows;
branches without labels have none to differ by, so they join the labelled ones
of their shape.

A template's labelled purity is smoothed along its path. At a host each labelled
branch has one vote, its share of blocked labels, and the corpus' share has
SMOOTH votes: one branch, however large, doesn't speak for its siblings of other
shapes. The host's purity counts as SMOOTH labels at its branches, a branch's at
its own branches, and so on down. So a template without labels of its own has
the purity of those that it is merged with, or of its host. It is rejected from PURITY on, if
its host has LEAST_LABELS labels at least.

Per-url work is one pass; the tree is built from counts by template, so a host
that holds a third of all urls is never gathered in one task. Nodes are hashes of
the segments above them, and all levels are counted together: the number of jobs
follows from how often wildcards or merges lie one below the other, not from the
length of paths. ORACLE_SQL has three levels, as paths at hand do.

Defined cases: a null url or one without :// has an empty host and path, which
are judged like any other; repeated urls count each; urls on a host without
labels are allowed; extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.llm.shared import keep, maybe_broadcast

#: The contract's rules: host, path, verdict (fixed values).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
KIDS = 20
PURITY = 0.8
LEAST_LABELS = 3
LEAST_MERGE = 5
SMOOTH = 2
#: Shorter paths are filled up to so many segments; longer ones keep all of theirs.
LEVELS = 3
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path)."""
    text = F.coalesce(url.cast("string"), F.lit(""))
    return F.translate(F.regexp_extract(text, _URL, 1), _UPPER, _LOWER), F.regexp_extract(text, _URL, 2)


def rule_for(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits, as struct (rule, verdict); null if none."""
    cases = None
    for h, p, verdict in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        value = F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))
        cases = F.when(fits, value) if cases is None else cases.when(fits, value)
    return cases if cases is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def _kind(segment: Column) -> Column:
    """A segment, or the wildcard of its kind."""
    return (
        F.when(segment.rlike(r"^[0-9]+$"), F.lit("{num}"))
        .when(segment.rlike(r"^[0-9]+\.[a-z]+$"), F.concat(F.lit("{num}"), F.regexp_extract(segment, r"(\.[a-z]+)$", 1)))
        .when(segment.rlike(r"^[0-9a-f-]{8,}$") | (segment.rlike("[0-9]") & (F.length(segment) >= 12)), F.lit("{id}"))
        .otherwise(segment)
    )


def _keys(path: str) -> str:
    """The nodes along a path: the host's, then one after each segment."""
    return f"aggregate(transform({path}, x -> xxhash64(x)), array(xxhash64(host)), (a, x) -> concat(a, array(xxhash64(element_at(a, -1), x))))"


#: Hashes of what is left of g after each segment.
_BELOW = "reverse(slice(aggregate(reverse(transform(g, x -> xxhash64(x))), array(0L), (a, x) -> concat(a, array(xxhash64(element_at(a, -1), x)))), 1, size(g)))"


def _zipped(**arrays: str) -> Column:
    """Arrays of one length as one array of structs."""
    return F.arrays_zip(*[F.expr(e).alias(name) for name, e in arrays.items()])


def _renamed(rows: DataFrame, hit: DataFrame, key: str, path: str) -> DataFrame:
    """``rows`` with the segment at one level of ``path`` renamed where ``hit`` (key, level, new) says so."""
    out = rows.join(maybe_broadcast(hit, 128), key, "left")
    return out.withColumn(path, F.expr(f"if(level is null, {path}, transform({path}, (x, i) -> if(i = level, new, x)))")).drop("level", "new")


def _generalised(counts: DataFrame) -> DataFrame:
    """``counts`` (row, host, t, n, bad, known) with g: t with * for the rare
    children of crowded nodes, from the top down.

    A round counts the children of all nodes of all paths at once, and renames
    below the uppermost crowded node of each path; there are as many rounds as
    crowded nodes lie one below the other, whatever the length of paths.
    """
    cur = counts.withColumn("g", F.col("t"))
    while True:
        each = cur.select("row", "n", F.posexplode(_zipped(node=f"slice({_keys('g')}, 1, size(g))", seg="g")).alias("level", "at")).select("row", "n", "level", "at.node", "at.seg")
        kids = each.groupBy("node", "seg").agg(F.sum("n").alias("kid_n"))
        crowded = keep(kids.groupBy("node").agg(F.count("*").alias("kids"), F.sum("kid_n").alias("node_n")).where(F.col("kids") > KIDS).drop("kids"), "crowded")
        if crowded.isEmpty():
            return cur
        rare = kids.join(maybe_broadcast(crowded, 16), "node").where((F.col("kid_n") * KIDS < F.col("node_n")) & (F.col("seg") != "*"))
        hit = each.join(maybe_broadcast(keep(rare.select("node", "seg"), "rare"), 128), ["node", "seg"]).groupBy("row").agg(F.min("level").alias("level"))
        hit = keep(hit.withColumn("new", F.lit("*")), "renamed")
        if hit.isEmpty():
            return cur
        cur = keep(_renamed(cur, hit, "row", "g"), "tree")


def _merged(leaves: DataFrame) -> DataFrame:
    """``leaves`` (leaf, host, g, bad, known) with m: g with one name for branches
    that are merged, from the top down, in rounds like those above."""
    leaves = leaves.withColumn("m", F.col("g"))
    labelled = F.col("known") >= LEAST_MERGE
    while True:
        zipped = _zipped(node=f"slice({_keys('m')}, 1, size(m))", seg="g", name="m", below=_BELOW)
        each = leaves.select("leaf", "bad", "known", F.posexplode(zipped).alias("level", "at")).select("leaf", "bad", "known", "level", "at.*").where("seg <> ''")
        parts = each.groupBy("node", "seg", "below").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known"))
        kids = parts.groupBy("node", "seg").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known"), F.struct(F.count("*"), F.bit_xor("below")).alias("shape"))
        pools = kids.groupBy("node", "shape").agg(
            F.count("*").alias("kids"), F.sum(F.when(labelled, F.col("bad"))).alias("pool_bad"), F.sum(F.when(labelled, F.col("known"))).alias("pool_known"), F.min(F.when(labelled, F.col("seg"))).alias("lead")
        )
        pools = pools.where("kids > 1 and pool_known > 0").select("node", "shape", "lead", ((F.col("pool_bad") + 1) / (F.col("pool_known") + 2)).alias("p"))
        pools = keep(pools, "pools")
        if pools.isEmpty():
            return leaves
        near = (F.col("known") == 0) | (F.abs(F.try_divide("bad", "known") - F.col("p")) <= 2 * F.sqrt(F.try_divide(F.col("p") * (1 - F.col("p")), F.col("known"))))
        names = kids.join(maybe_broadcast(pools, 128), ["node", "shape"]).where(near).select("node", "seg", F.concat(F.lit("~"), "lead").alias("new"))
        hit = each.join(maybe_broadcast(keep(names, "names"), 192), ["node", "seg"]).where("new <> name")
        hit = keep(hit.groupBy("leaf").agg(F.min_by("new", "level").alias("new"), F.min("level").alias("level")), "renamed")
        if hit.isEmpty():
            return leaves
        leaves = keep(_renamed(leaves, hit, "leaf", "m"), "leaves")


def _smoothed(leaves: DataFrame) -> DataFrame:
    """``leaves`` (with the host's purity) with that of their template: counts of
    all nodes at once, folded along each path."""
    each = leaves.select("leaf", "bad", "known", F.posexplode(_zipped(node=f"slice({_keys('m')}, 2, size(m))", seg="g")).alias("level", "at"))
    each = each.select("leaf", "bad", "known", "level", "at.*").where("seg <> ''")
    own = keep(each.groupBy("node").agg(F.sum("bad").alias("b"), F.sum("known").alias("k")), "shares")
    met = each.select("leaf", "level", "node").join(maybe_broadcast(own, 24), "node").groupBy("leaf").agg(F.sort_array(F.collect_list(F.struct("level", "b", "k"))).alias("walk"))
    down = F.expr(f"aggregate(coalesce(walk, array()), purity, (p, x) -> (x.b + {SMOOTH} * p) / (x.k + {SMOOTH}))")
    return leaves.join(met, "leaf", "left").withColumn("purity", down).drop("walk")


def path_templates(urls: DataFrame) -> DataFrame:
    """(host, t, template, purity, labelled, rejected) from urls(host, t, label);
    t is the array of all segments, LEVELS at least; label is 1 for blocked, 0
    for allowed, null for unknown; labelled counts the host's labels."""
    counts = urls.groupBy("host", "t").agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("bad"), F.count("label").alias("known"))
    counts = keep(counts.withColumn("row", F.xxhash64("host", "t")), "paths")
    whole = counts.agg(F.sum("bad"), F.sum("known")).first()
    share = ((whole[0] or 0) + 1) / ((whole[1] or 0) + 2)
    counts = _generalised(counts)
    leaves = counts.groupBy("host", "g").agg(F.sum("bad").alias("bad"), F.sum("known").alias("known"))
    branches = leaves.groupBy("host", F.get("g", F.lit(0)).alias("branch")).agg(F.sum("bad").alias("b"), F.sum("known").alias("k"))
    vote = F.when(F.col("k") > 0, F.col("b") / F.col("k"))
    hosts = branches.groupBy("host").agg(F.sum("k").alias("labelled"), F.coalesce(F.sum(vote), F.lit(0.0)).alias("votes"), F.count(vote).alias("voters"))
    hosts = keep(hosts.select("host", "labelled", ((F.col("votes") + SMOOTH * F.lit(share)) / (F.col("voters") + SMOOTH)).alias("purity")), "hosts")
    leaves = keep(leaves.join(maybe_broadcast(hosts, 64), "host").withColumn("leaf", F.xxhash64("host", "g")), "leaves")
    leaves = _smoothed(_merged(leaves))
    # A template's name has the merged segments that aren't filled up, then a mark for each that is.
    name = F.expr("concat_ws('/', host, array_join(transform(m, (x, i) -> if(g[i] = '', '', x)), '/'))")
    rejected = (F.col("purity") >= PURITY) & (F.col("labelled") >= LEAST_LABELS)
    leaves = keep(leaves.select("leaf", name.alias("template"), "purity", "labelled", rejected.alias("rejected")), "named")
    return counts.withColumn("leaf", F.xxhash64("host", "g")).join(maybe_broadcast(leaves, 256), "leaf").select("host", "t", "template", "purity", "labelled", "rejected")


def filter_urls(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, labels: DataFrame | None = None) -> DataFrame:
    """(id, host, path, rule, verdict, template, purity) of each row. ``labels``
    (url, label) adds labelled urls to those that the rules label."""
    host, path = split_url(F.col(url_col))
    parsed = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))

    def shaped(df: DataFrame) -> DataFrame:
        parts = F.transform(F.filter(F.split(F.col("path"), "/", -1), lambda x: x != ""), _kind)
        return df.withColumn("t", F.concat(parts, F.array_repeat(F.lit(""), F.greatest(F.lit(0), LEVELS - F.size(parts)))))

    judged = shaped(parsed).withColumn("_rule", rule_for(F.col("host"), F.col("path"), rules))
    judged = judged.select("*", F.col("_rule.rule").alias("rule"), F.col("_rule.verdict").alias("said")).drop("_rule")
    seen = judged.select("host", "t", F.when(F.col("said") == "block", 1).when(F.col("said") == "allow", 0).alias("label"))
    if labels is not None:
        h, p = split_url(F.col("url"))
        more = shaped(labels.select(h.alias("host"), p.alias("path"), "label"))
        seen = seen.union(more.select("host", "t", F.col("label").cast("int")))
    tree = keep(path_templates(seen), "templates").select("host", "t", "template", "purity", "rejected")
    out = judged.join(maybe_broadcast(tree, 256), ["host", "t"], "left")
    verdict = F.coalesce("said", F.when(F.col("rejected"), "block").otherwise("allow"))
    return out.select(F.col("id").alias(id_col), "host", "path", "rule", verdict.alias("verdict"), "template", "purity")


def held_out(pages: DataFrame, share: int = 5, url_col: str = "url", rules=RULES) -> DataFrame:
    """One row (hidden, blocked, found, wrong): the tree against labels that it
    hasn't seen. Of the urls that a rule judges, a hash hides one in ``share``
    from it: hidden counts them, blocked those that the rules block, found those
    of them that the tree blocks too, wrong those that it blocks alone."""
    host, path = split_url(F.col(url_col))
    said = pages.select(F.col(url_col).cast("string").alias("url"), rule_for(host, path, rules)["verdict"].alias("said"))
    hide = F.pmod(F.xxhash64("url"), F.lit(share)) == 0
    known = said.where(F.col("said").isNotNull() & ~hide).select("url", (F.col("said") == "block").cast("int").alias("label"))
    judged = filter_urls(said.withColumn("hidden", hide), "said", rules=[], labels=known, url_col="url")
    pairs = judged.select("host", "path", F.col("said"), (F.col("verdict") == "block").alias("tree"))
    full = said.where(hide).select(*[c.alias(n) for c, n in zip(split_url(F.col("url")), ("host", "path"), strict=True)]).distinct()
    pairs = pairs.where(F.col("said").isNotNull()).join(full, ["host", "path"], "left_semi")
    block = F.col("said") == "block"
    return pairs.agg(F.count("*").alias("hidden"), F.count_if(block).alias("blocked"), F.count_if(block & F.col("tree")).alias("found"), F.count_if(~block & F.col("tree")).alias("wrong"))


_SQL_KIND = """case when regexp_matches({s}, '^[0-9]+$') then '{{num}}'
  when regexp_matches({s}, '^[0-9]+\\.[a-z]+$') then '{{num}}' || regexp_extract({s}, '(\\.[a-z]+)$', 1)
  when regexp_matches({s}, '^[0-9a-f-]{{8,}}$') or (regexp_matches({s}, '[0-9]') and len({s}) >= 12) then '{{id}}' else {s} end"""


def _oracle() -> str:
    fits = [
        (f"(host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}')", h + p, v)
        for h, p, v in sorted(RULES, key=lambda r: (-len(r[0] + r[1]), r))
    ]
    rule = "case " + " ".join(f"when {f} then '{r}'" for f, r, _ in fits) + " end"
    said = "case " + " ".join(f"when {f} then '{v}'" for f, _, v in fits) + " end"
    kinds = ", ".join(_SQL_KIND.format(s=f"coalesce(parts[{i}], '')") + f" as t{i}" for i in (1, 2, 3))
    sql = f"""
with u as (select page_id, coalesce(url, '') as url from pages),
p as (select page_id, translate(regexp_extract(url, '{_URL}', 1), '{_UPPER}', '{_LOWER}') as host, regexp_extract(url, '{_URL}', 2) as path from u),
q as (select *, list_filter(string_split(path, '/'), lambda x: x <> '') as parts from p),
j as (select page_id, host, path, {kinds}, len(parts) > 3 as deep, {rule} as rule, {said} as said from q),
c0 as (select host, t1, t2, t3, deep, count(*) as n, sum(case said when 'block' then 1 else 0 end) as bad, count(said) as known from j group by all)"""
    for i in (1, 2, 3):
        above = ", ".join(["host", *(f"g{k}" for k in range(1, i))])
        sql += f""",
k{i} as (select {above}, t{i}, sum(n) as kid_n from c{i - 1} group by all),
n{i} as (select {above}, count(*) as kids, sum(kid_n) as node_n from k{i} group by all),
o{i} as (select {above}, t{i}, case when kids > {KIDS} and kid_n * {KIDS} < node_n then '*' else t{i} end as g{i} from k{i} join n{i} using ({above})),
c{i} as (select * from c{i - 1} join o{i} using ({above}, t{i}))"""
    sql += f""",
tot as (select (sum(bad) + 1) / (sum(known) + 2) as share from c3),
vo as (select host, g1, sum(bad) as b, sum(known) as k from c3 group by all),
ho as (select host, sum(k) as labelled, (coalesce(sum(b / k) filter (k > 0), 0) + {SMOOTH} * any_value(share)) / (count(*) filter (k > 0) + {SMOOTH}) as p0 from vo, tot group by host),
w0 as (select c3.*, labelled, p0 from c3 join ho using (host))"""
    for i in (1, 2, 3):
        above = ", ".join(["host", *(f"m{k}" for k in range(1, i))])
        rest = ", ".join(["'/'", *(f"g{k}" for k in range(i + 1, 4)), "cast(deep as varchar)"])
        sql += f""",
b{i} as (select {above}, g{i}, sum(bad) as bad, sum(known) as known, array_to_string(list_sort(list_distinct(list(concat_ws({rest})))), '|') as shape from w{i - 1} where g{i} <> '' group by {above}, g{i}),
p{i} as (select {above}, shape, (sum(bad) filter (known >= {LEAST_MERGE}) + 1) / (sum(known) filter (known >= {LEAST_MERGE}) + 2) as p, min(g{i}) filter (known >= {LEAST_MERGE}) as lead
  from b{i} group by {above}, shape having count(*) > 1 and max(known) >= {LEAST_MERGE}),
e{i} as (select {above}, g{i}, case when known = 0 or abs(bad / known - p) <= 2 * sqrt(p * (1 - p) / known) then coalesce('~' || lead, g{i}) else g{i} end as m{i} from b{i} left join p{i} using ({above}, shape)),
x{i} as (select w{i - 1}.*, coalesce(m{i}, '') as m{i} from w{i - 1} left join e{i} using ({above}, g{i})),
y{i} as (select {above}, m{i}, sum(bad) as nb, sum(known) as nk from x{i} group by {above}, m{i}),
w{i} as (select x{i}.*, case when m{i} = '' then p{i - 1} else (nb + {SMOOTH} * p{i - 1}) / (nk + {SMOOTH}) end as p{i} from x{i} join y{i} using ({above}, m{i}))"""
    return (
        sql
        + f""",
tr as (select host, t1, t2, t3, deep, host || '/' || m1 || '/' || m2 || '/' || m3 as template, p3 as purity, p3 >= {PURITY} and labelled >= {LEAST_LABELS} as rejected from w3)
select page_id, j.host, path, rule, coalesce(said, case when rejected then 'block' else 'allow' end) as verdict, template, purity
from j left join tr on j.host = tr.host and j.t1 = tr.t1 and j.t2 = tr.t2 and j.t3 = tr.t3 and j.deep = tr.deep"""
    )


ORACLE_SQL = _oracle()
