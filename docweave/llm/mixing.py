"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words by weight, at most ``most`` times its own
size, the excess shared again by weight among the others. Within a source a
document's expected number of copies is min(most, level * weight): its weight
falls with its length (it halves for every fourfold length from LONG words on),
so that a few very long documents do not make up a mix, and the level is what
meets the source's target; documents that reach ``most`` are certain and leave
the others a higher level. The whole part of that number is given to every
document. The rest of the target goes to a Pareto order sample with the
fractional part as inclusion probability: a document's rank is its random odds
divided by its inclusion odds, and documents are taken in the order of ranks
until the rest is met, so the sample has a fixed size in words.

The order is found without sorting a source in one task: sums over a grid of
rank cells give the cell where the rest is met, then the same inside that cell,
and only a last cell's documents are put in order, equal ones as one row.

Defined cases: a null text has size 0; null is a source of its own and comes
last; a document of size 0 takes 0 words; if all sizes are 0, all targets are;
repeated rows (equal id and text) share a rank, and where the rest ends among
them as many of them as it holds are taken; columns besides the named ones are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docweave.llm.shared import keep, maybe_broadcast, row_hash

WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2
#: Binary digits of a size up to which documents weigh 1 (under 512 words).
LONG = 9
#: Cells of the rank grid at each of its levels.
CELLS, LEVELS = 256, 3


def word_count(text: Column) -> Column:
    """Runs of other characters than space and U+0009 to U+000D."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _level(rows: DataFrame, total: str, by: list[str]) -> DataFrame:
    """``rows`` with ``level``: sum(min(most, level * weight)) = ``total`` over
    each group of ``by``; null where all are full.

    Rows are full in the order of most / weight, so the level follows from
    running sums in that order, taking each row as the first that is not full.
    A group has one row for each source, or for each length class of a source.
    """
    fill = Window.partitionBy(*by).orderBy(F.col("most") / F.col("weight"), "place")
    whole = fill.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = rows.withColumn("full", F.coalesce(F.sum("most").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    out = out.withColumn("open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    out = out.withColumn("one", (F.col(total) - F.col("full")) / F.col("open"))
    level = F.first(F.when(F.col("one") * F.col("weight") < F.col("most"), F.col("one")), ignorenulls=True).over(whole)
    return out.withColumn("level", level).drop("full", "open", "one")


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size); one row for
    each source is all that is put in order."""
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("place", F.row_number().over(by_name) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    ranked = ranked.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most))).withColumn("all", F.lit(0))
    ranked = ranked.withColumn("total", F.sum("source_size").over(Window.partitionBy("all")) * F.lit(float(share)))
    ranked = _level(ranked, "total", ["all"])
    target = F.when(F.col("level").isNull(), F.col("most")).otherwise(F.least("most", F.col("level") * F.col("weight")))
    return ranked.select("source", "source_size", target.alias("target"))


def expected_copies(classes: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """(source, digits, source_size, target, copies, rest) from classes (source,
    digits, words) of documents by the binary digits of their size: copies is a
    document's expected number; rest is what whole copies leave of the target."""
    own = classes.withColumnRenamed("source", "s").join(maybe_broadcast(goals, 64), F.col("s").eqNullSafe(F.col("source"))).drop("s")
    halvings = F.greatest(F.floor((F.col("digits") - (LONG - 1)) / 2), F.lit(0)).cast("int")
    own = own.withColumn("single", 1.0 / F.call_function("shiftleft", F.lit(1).cast("long"), halvings)).withColumn("place", F.col("digits"))
    own = own.withColumn("weight", F.col("single") * F.col("words")).withColumn("most", F.col("words") * F.lit(float(most)))
    filled = _level(own.where("words > 0"), "target", ["source"])
    copies = F.when(F.col("level").isNull(), F.lit(float(most))).otherwise(F.least(F.lit(float(most)), F.col("level") * F.col("single")))
    filled = filled.withColumn("copies", copies)
    rest = F.col("target") - F.sum(F.floor("copies") * F.col("words")).over(Window.partitionBy("source"))
    return filled.select("source", "digits", "source_size", "target", "copies", rest.alias("rest"))


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from 48 bits of an MD5 of the key."""
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(f":{seed}"))), 1, 12), 16, 10).cast("double")
    return (bits + 0.5) / float(1 << 48)


def _digits(size: str) -> Column:
    return F.length(F.bin(F.col(size)))


def _within(rows: DataFrame, edge: DataFrame, cell: Column) -> DataFrame:
    """The rows in the cell where their source's rest is met, with what is ahead."""
    told = edge.select(F.col("source").alias("s"), F.col("cell").alias("c"), F.col("ahead").alias("base"))
    return rows.join(maybe_broadcast(told, 64), F.col("source").eqNullSafe(F.col("s")) & (cell == F.col("c"))).drop("s", "c")


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix") -> DataFrame:
    """(id, text_key, size, source, source_size, target, expected, copies, taken),
    one row for each document."""
    text = F.col(text_col).cast("string")
    key = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(text, F.lit(""))))
    sized = docs.select(
        F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(text).alias("size"), F.xxhash64(F.col(text_col)).alias("text_key"), uniform(key, seed).alias("u")
    )
    sized = keep(sized.withColumn("row", F.monotonically_increasing_id()), "sized")
    classes = keep(sized.groupBy("source", _digits("size").alias("digits")).agg(F.sum("size").alias("words")), "classes")
    goals = keep(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most), "targets")
    plan = keep(expected_copies(classes, goals, most), "plan")
    told = plan.select(F.col("source").alias("s"), F.col("digits").alias("d"), F.col("copies").alias("expected"), "rest")
    rows = sized.join(maybe_broadcast(told, 96), F.col("source").eqNullSafe(F.col("s")) & (_digits("size") == F.col("d")) & (F.col("size") > 0), "left").drop("s", "d")
    part = F.col("expected") - F.floor("expected")
    odds = F.when(part > 0, (F.col("u") / (1 - F.col("u"))) / (part / (1 - part)))
    # Ranks are mapped onto (0, 1), so that they can be dealt into cells; 1 is never drawn.
    rows = keep(rows.withColumn("rank", F.coalesce(odds / (1 + odds), F.lit(1.0))).drop("u"), "ranked")
    drawn = rows.where("rank < 1")

    edge = None
    for level in range(1, LEVELS + 1):
        cell = lambda n: F.floor(F.col("rank") * CELLS**n).cast("long")
        inside = drawn.withColumn("base", F.lit(0).cast("long")) if edge is None else _within(drawn, edge, cell(level - 1))
        sums = inside.groupBy("source", "rest", "base", cell(level).alias("cell")).agg(F.sum("size").alias("words"))
        ordered = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, 0)
        sums = sums.withColumn("ahead", F.col("base") + F.sum("words").over(ordered) - F.col("words"))
        edge = keep(sums.where("ahead <= rest and ahead + words > rest").select("source", "cell", "ahead"), "edge")
    # Equal documents are one row here, so the last cell is a few rows.
    last = _within(drawn, edge, cell(LEVELS)).groupBy("source", "rest", "base", "rank", "id", "text_key", "size").agg(F.count("*").alias("n"))
    ordered = Window.partitionBy("source").orderBy("rank", "id", "text_key").rowsBetween(Window.unboundedPreceding, 0)
    last = last.withColumn("ahead", F.col("base") + F.sum(F.col("n") * F.col("size")).over(ordered) - F.col("n") * F.col("size"))
    # A document in which the rest is met is taken if that ends nearer to it.
    room = F.least(F.greatest(F.floor((F.col("rest") - F.col("ahead")) / F.col("size") + 0.5), F.lit(0)), F.col("n"))
    last = keep(last.select(F.col("source").alias("s"), F.col("rank").alias("r"), F.col("id").alias("i"), F.col("text_key").alias("k"), "n", room.alias("room")), "last")

    bounds = edge.select(F.col("source").alias("s"), F.col("cell").alias("edge"))
    out = rows.join(maybe_broadcast(bounds, 64), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")
    at = F.floor(F.col("rank") * CELLS**LEVELS).cast("long")
    in_edge = out.where((F.col("rank") < 1) & (at == F.col("edge"))).join(
        maybe_broadcast(last, 64), F.col("source").eqNullSafe(F.col("s")) & (F.col("rank") == F.col("r")) & F.col("id").eqNullSafe(F.col("i")) & (F.col("text_key") == F.col("k"))
    )
    # Of equal documents that are taken in part, the first by row; they are
    # numbered within the partition that they were read in, from its offset.
    some = in_edge.withColumn("file", F.shiftrightunsigned("row", 33))
    offsets = some.groupBy("s", "i", "k", "file").agg(F.count("*").alias("own"))
    offsets = offsets.withColumn("before", F.sum("own").over(Window.partitionBy("s", "i", "k").orderBy("file").rowsBetween(Window.unboundedPreceding, 0)) - F.col("own"))
    offsets = offsets.select(F.col("s").alias("s2"), F.col("i").alias("i2"), F.col("k").alias("k2"), F.col("file").alias("f2"), "before")
    turn = F.row_number().over(Window.partitionBy("s", "i", "k", "file").orderBy("row"))
    some = some.withColumn("turn", turn).join(offsets, F.col("s").eqNullSafe(F.col("s2")) & F.col("i").eqNullSafe(F.col("i2")) & (F.col("k") == F.col("k2")) & (F.col("file") == F.col("f2")))
    chosen = keep(some.where(F.col("before") + F.col("turn") <= F.col("room")).select(F.col("row").alias("taken_row")), "chosen")

    out = out.join(maybe_broadcast(chosen, 8), F.col("row") == F.col("taken_row"), "left")
    # A source without an edge takes all that has a chance.
    extra = F.when((F.col("rank") < 1) & (F.col("edge").isNull() | (at < F.col("edge")) | F.col("taken_row").isNotNull()), 1).otherwise(0)
    copies = F.when(F.col("size") > 0, F.floor("expected") + extra).otherwise(1)
    out = out.withColumnRenamed("source", "own").join(maybe_broadcast(goals.withColumnRenamed("source", "s"), 64), F.col("own").eqNullSafe(F.col("s")))
    out = out.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    return out.select(F.col("id").alias(id_col), "text_key", "size", F.col("own").alias("source"), F.col("source_size").cast("long"), "target", "expected", "copies", "taken")


def apply_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with a column ``copies``: how often the mix repeats the row;
    documents that it does not take are dropped. Of repeated rows (equal id,
    text and source) that get different copies, those whose columns hash least get
    the more, whatever the order of rows."""
    key = lambda text_key: F.xxhash64(F.col(id_col), text_key, F.col(source_col))
    drawn = mix_sources(docs.select(id_col, text_col, source_col), id_col, text_col, source_col, **options)
    source = F.col("source")
    drawn = drawn.groupBy(F.xxhash64(F.col(id_col), F.col("text_key"), source).alias("__dw_key")).agg(
        F.min("copies").alias("__dw_copies"), F.sum(F.col("copies")).alias("__dw_sum"), F.count("*").alias("__dw_n")
    )
    drawn = keep(drawn.withColumn("__dw_more", F.col("__dw_sum") - F.col("__dw_copies") * F.col("__dw_n")).drop("__dw_sum", "__dw_n"), "drawn")
    keyed = docs.withColumn("__dw_key", key(F.xxhash64(F.col(text_col))))
    names = [F.col(f"`{c}`") for c in docs.columns if c != "copies"]
    even = keyed.join(maybe_broadcast(drawn.where("__dw_more = 0 and __dw_copies > 0"), 24), "__dw_key").select(*names, F.col("__dw_copies").alias("copies"))
    uneven = keep(drawn.where("__dw_more > 0"), "uneven")
    if uneven.isEmpty():
        return even
    part = keyed.join(maybe_broadcast(uneven, 24), "__dw_key").withColumn("__dw_hash", row_hash(docs))
    part = keep(part.withColumn("__dw_tag", F.monotonically_increasing_id()), "part")
    # Those whose columns hash least get the more; rows that are equal in all columns are one group.
    groups = part.groupBy("__dw_key", "__dw_hash", "__dw_more").agg(F.count("*").alias("__dw_n"))
    ahead = F.sum("__dw_n").over(Window.partitionBy("__dw_key").orderBy("__dw_hash").rowsBetween(Window.unboundedPreceding, 0)) - F.col("__dw_n")
    room = F.least(F.greatest(F.col("__dw_more") - ahead, F.lit(0)), F.col("__dw_n"))
    groups = keep(groups.select("__dw_key", "__dw_hash", room.alias("__dw_room")), "rooms")
    # Equal rows are numbered within the partition that they were read in, from its offset.
    file = F.shiftrightunsigned("__dw_tag", 33)
    before = part.groupBy("__dw_key", "__dw_hash", file.alias("__dw_file")).agg(F.count("*").alias("__dw_own"))
    up_to = Window.partitionBy("__dw_key", "__dw_hash").orderBy("__dw_file").rowsBetween(Window.unboundedPreceding, 0)
    before = before.withColumn("__dw_before", F.sum("__dw_own").over(up_to) - F.col("__dw_own")).drop("__dw_own")
    turn = F.row_number().over(Window.partitionBy("__dw_key", "__dw_hash", "__dw_file").orderBy("__dw_tag"))
    told = part.withColumn("__dw_file", file).withColumn("__dw_turn", turn).join(before, ["__dw_key", "__dw_hash", "__dw_file"]).join(maybe_broadcast(groups, 24), ["__dw_key", "__dw_hash"])
    copies = F.col("__dw_copies") + F.when(F.col("__dw_before") + F.col("__dw_turn") <= F.col("__dw_room"), 1).otherwise(0)
    return even.unionByName(told.select(*names, copies.alias("copies")).where("copies > 0"))


#: The query's rows in SQL: the sample by running sums in rank order, without the grid.
ORACLE_SQL = f"""
with s as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size, md5(coalesce(text, '')) as h from documents),
g as (select source, cast(sum(size) as bigint) as source_size from s group by source),
r as (select *, row_number() over (order by source is null, source) - 1 as place from g),
w as (select *, case place % {len(WEIGHTS)} {" ".join(f"when {i} then {float(x)}" for i, x in enumerate(WEIGHTS))} end::double as weight, source_size * {float(MOST)}::double as most from r),
f as (select *, sum(source_size) over () * {float(SHARE)}::double as total,
  coalesce(sum(most) over (order by most / weight, place rows between unbounded preceding and 1 preceding), 0) as filled,
  sum(weight) over (order by most / weight, place rows between current row and unbounded following) as remaining from w),
l as (select *, (total - filled) / remaining as level from f),
a as (select *, first_value(case when level * weight < most then level end ignore nulls) over (order by most / weight, place rows between unbounded preceding and unbounded following) as lvl from l),
t as (select source, source_size, case when lvl is null then most else least(most, lvl * weight) end as target from a),
k as (select source, len(bin(size)) as digits, cast(sum(size) as double) as words from s where size > 0 group by all),
kw as (select k.*, target, 1.0::double / (1 << cast(greatest(floor((digits - {LONG - 1}) / 2), 0) as int)) as single from k join t on k.source is not distinct from t.source),
kf as (select *, coalesce(sum(words * {float(MOST)}::double) over (partition by source order by digits rows between unbounded preceding and 1 preceding), 0) as filled,
  sum(words * single) over (partition by source order by digits rows between current row and unbounded following) as remaining from kw),
kl as (select *, (target - filled) / remaining as level from kf),
ka as (select *, first_value(case when level * single < {float(MOST)} then level end ignore nulls) over (partition by source order by digits rows between unbounded preceding and unbounded following) as lvl from kl),
ke as (select *, case when lvl is null then {float(MOST)}::double else least({float(MOST)}::double, lvl * single) end as expected from ka),
kr as (select *, target - sum(floor(expected) * words) over (partition by source) as rest from ke),
d as (select s.doc_id, s.h, s.size, s.source, expected, expected - floor(expected) as part, rest,
  (cast('0x' || substr(md5(coalesce(cast(s.doc_id as varchar), '') || ':' || s.h || ':mix'), 1, 12) as bigint) + 0.5::double) / {float(1 << 48)}::double as u
  from s left join kr on s.source is not distinct from kr.source and len(bin(s.size)) = kr.digits and s.size > 0),
o as (select *, case when part > 0 then (u / (1 - u)) / (part / (1 - part)) end as odds from d),
q as (select *, coalesce(odds / (1 + odds), 1.0) as rank from o),
c as (select *, coalesce(sum(case when rank < 1 then size else 0 end) over (partition by source order by rank, doc_id rows between unbounded preceding and 1 preceding), 0) as ahead from q),
n as (select *, case when size > 0 then floor(expected) + (case when rank < 1 and ahead + size / 2 <= rest then 1 else 0 end) else 1 end as copies from c)
select n.doc_id, n.size, t.source_size, t.target, cast(copies * n.size as bigint) as taken, n.source, n.expected, cast(copies as bigint) as copies
from n join t on n.source is not distinct from t.source"""
