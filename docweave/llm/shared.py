"""Tables kept between jobs, and connected components over edge tables."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docweave.sources.store import BROADCAST_BYTES, maybe_broadcast, scratch_dir


#: Rows and bytes of an Arrow batch between the JVM and Python.
BATCH_ROWS = 1000
BATCH_BYTES = 2 << 20
#: Spark's default of the bytes of a batch.
ARROW_BYTES = "67108864b"


def small_batches(spark: SparkSession) -> None:
    """Bounds the memory of Arrow batches of whole texts, and of rows that hold
    many texts: Spark's defaults are lowered to BATCH_ROWS and BATCH_BYTES for
    the session, since plans read them when they run; another setting stays."""
    most = "spark.sql.execution.arrow.max"
    for name, default, own in ((f"{most}RecordsPerBatch", "10000", BATCH_ROWS), (f"{most}BytesPerBatch", ARROW_BYTES, BATCH_BYTES)):
        if spark.conf.get(name) == default:
            spark.conf.set(name, str(own))


@contextmanager
def _cleaned_up(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the writes within go once these have ended, not when
    the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name, "false")
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def keep(df: DataFrame, label: str) -> DataFrame:
    """Writes ``df`` as Parquet to the shared folder and reads it back, which
    cuts the lineage: a lost executor costs only the tasks it was running."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/docweave-{label}-{uuid.uuid4().hex}"
    schema = df.schema
    with _cleaned_up(spark):
        df.write.parquet(path)
    kept = spark.read.schema(schema).parquet(path)
    kept._docweave_path = path
    if _SCOPES:
        _SCOPES[-1].append(kept)
    return kept


_SCOPES: list[list[DataFrame]] = []


@contextmanager
def scratch() -> Iterator[list[DataFrame]]:
    """Collects the tables that :func:`keep` writes within; pass them to
    :func:`release` once a last table holds what they led to."""
    _SCOPES.append([])
    try:
        yield _SCOPES[-1]
    finally:
        _SCOPES.pop()


def release(made: list[DataFrame], result: DataFrame) -> DataFrame:
    """Deletes the tables of a scope but ``result``, which must be kept itself."""
    drop_kept(*(t for t in made if t._docweave_path != result._docweave_path))
    if _SCOPES:
        _SCOPES[-1].append(result)
    return result


def drop_kept(*tables: DataFrame) -> None:
    """Deletes tables written by :func:`keep` that nothing reads any more."""
    for df in tables:
        path = getattr(df, "_docweave_path", None)
        if path is None:
            continue
        spark = df.sparkSession
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


#: Minima of a pass that are broadcast, in bytes: two nodes of 16 for each edge.
FEW_BYTES = 4 << 20


def components(edges: DataFrame, rounds: int = 40) -> DataFrame:
    """(node, root) of every node in ``edges(a, b)``; root is the component's
    least node.

    Distributed union-find by alternating large-star and small-star passes:
    each pass joins the edges with one minimum per node, so a hub's edges are
    never gathered in one row, and AQE may split a hub's join partition. Where a
    count has shown the edges to be few, the minima are broadcast, and only
    aggregates shuffle. Every pass is written to the shared folder; the loop
    ends when all edges point at their roots, which takes O(log n) passes.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    cur = keep(pairs.where("u <> v").distinct(), "cc")
    for _ in range(rounds):
        both = cur.select("u", "v").union(cur.select(F.col("v").alias("u"), F.col("u").alias("v")))
        few = cur.count() * 32 <= FEW_BYTES
        sent = F.broadcast if few else lambda df: df
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(sent(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Two joins read what was shuffled; without a shuffle repeats cost less than one.
        large = large if few else large.distinct()
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(sent(down), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.union(down.select("u", F.col("m").alias("v")))
        small = small.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        nxt = keep(small.where("u <> v").distinct(), "cc")
        drop_kept(cur)
        cur = nxt
        # Settled when every node has one parent and no parent has a parent.
        ends = cur.selectExpr("u as node", "1 as up", "0 as down").union(cur.selectExpr("v", "0", "1"))
        ends = ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
        if not ends.where("up > 1 or up = 1 and down = 1").agg(F.count("*")).first()[0]:
            break
    else:
        raise RuntimeError("components did not settle")
    roots = cur.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return cur.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)


def row_hash(df: DataFrame) -> Column:
    """A hash of all columns but maps, which have none."""
    return F.xxhash64(*[F.col(f"`{f.name}`") for f in df.schema.fields if "map<" not in f.dataType.simpleString()])


def split_repeats(df: DataFrame, key: str) -> tuple[DataFrame, DataFrame | None]:
    """(rows that are alone with their ``key``, the others or None).

    The others, which are few where ids are unique, are kept with two columns:
    ``__dw_tag`` tells rows apart, ``__dw_first`` marks one row of each key: that
    whose columns hash least, whatever the order of rows. Counts and marks come
    from partial aggregates, so no group of repeats is gathered.
    """
    often = keep(df.groupBy(key).agg(F.count("*").alias("n")).where("n > 1").select(key), "often")
    total = often.count()
    if not total:
        return df, None
    known = F.broadcast(often) if total * 8 <= BROADCAST_BYTES else often
    many = keep(df.withColumn("__dw_hash", row_hash(df)).join(known, key, "left_semi").withColumn("__dw_tag", F.monotonically_increasing_id()), "repeats")
    first = many.groupBy(key).agg(F.min(F.struct("__dw_hash", "__dw_tag")).alias("__dw_least"))
    first = keep(first.select(F.col("__dw_least.__dw_tag").alias("__dw_won")), "firsts")
    many = many.drop("__dw_hash").join(maybe_broadcast(first, 8), F.col("__dw_tag") == F.col("__dw_won"), "left")
    return df.join(known, key, "left_anti"), many.withColumn("__dw_first", F.col("__dw_won").isNotNull()).drop("__dw_won")


def one_of_repeats(df: DataFrame, key: str) -> DataFrame:
    """``df`` with one row of those that share ``key``."""
    alone, many = split_repeats(df, key)
    return alone if many is None else alone.unionByName(many.where("__dw_first").drop("__dw_tag", "__dw_first"))


@dataclass(frozen=True)
class Lanes:
    """Packed signatures that ride along with nodes, to skip comparisons.

    ``columns`` are longs of 64 / ``bits`` lanes, one for each signature slot;
    pairs that differ in more than ``most`` lanes are taken as not alike.
    """

    columns: tuple[str, ...] = ()
    bits: int = 8
    most: int = 0

    def near(self, a: str, b: str) -> Column:
        """Whether the columns with the prefixes ``a`` and ``b`` are near enough."""
        if not self.columns:
            return F.lit(True)
        low, total = sum(1 << (self.bits * i) for i in range(64 // self.bits)), F.lit(0)
        for c in self.columns:
            x, step = F.col(a + c).bitwiseXOR(F.col(b + c)), self.bits // 2
            while step:  # each lane's lowest bit becomes the union of its bits
                x, step = x.bitwiseOR(F.shiftrightunsigned(x, step)), step // 2
            total = total + F.bit_count(x.bitwiseAND(F.lit(low)))
        return total <= self.most

    def named(self, prefix: str) -> list[Column]:
        return [F.col(c).alias(prefix + c) for c in self.columns]


def led_buckets(rows: DataFrame, lanes: Lanes = Lanes()) -> tuple[DataFrame, DataFrame]:
    """(met, led) of rows (bucket, node, lanes) without repeats: met has the rows
    whose bucket has two nodes or more, led (bucket, node, lead, near) those among
    them that are not their bucket's lead.

    The lead is the bucket's node that shares the most of its buckets, so that
    the centre of a group of variants leads it; ties go by a hash of
    node and bucket. Which buckets have several nodes comes from a partial
    aggregate, and leads are a table of their own, so that a join can split a
    huge bucket; what is broadcast has been counted small.
    """
    shared = rows.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
    shared = keep(shared, "shared")
    met = keep(rows.join(maybe_broadcast(shared, 8), "bucket"), "met")
    degree = met.groupBy("node").agg(F.count("*").alias("degree"))
    top = F.max(F.struct("degree", F.xxhash64("node", "bucket").alias("turn"), "node", *lanes.columns)).alias("top")
    leads = met.join(degree, "node").groupBy("bucket").agg(top)
    leads = keep(leads.select("bucket", F.col("top.node").alias("lead"), *[F.col(f"top.{c}").alias(f"lead_{c}") for c in lanes.columns]), "leads")
    led = met.join(maybe_broadcast(leads, 16 + 8 * len(lanes.columns)), "bucket").where("node <> lead")
    return met, led.select("bucket", "node", "lead", lanes.near("", "lead_").alias("near"))


#: Open pairs of a bucket up to which they are compared without dealing them again: the square of this.
PAIRED = 64


def _left_open(met: DataFrame, classes: DataFrame, lanes: Lanes) -> DataFrame:
    """(bucket, node, class, most, pairs, lanes) of the buckets with more than
    one class; most is the bucket's largest class, pairs bounds the pairs of
    different classes. Of two nodes one is the lead, so they are not open."""
    each = met.join(maybe_broadcast(classes.select("node", "root"), 16), "node", "left").select("bucket", "node", *lanes.columns, F.coalesce("root", "node").alias("class"))
    each = keep(each, "apart")
    sizes = each.groupBy("bucket", "class").agg(F.count("*").alias("size"))
    sizes = sizes.groupBy("bucket").agg(F.max(F.struct("size", "class")).alias("top"), F.sum("size").alias("n"), F.count("*").alias("classes"))
    sizes = sizes.where("classes > 1 and n > 2").select("bucket", F.col("top.class").alias("most"), ((F.col("n") - F.col("top.size")) * F.col("n")).alias("pairs"))
    return keep(each.join(maybe_broadcast(keep(sizes, "sizes"), 24), "bucket"), "open")


#: Longs of an odd sketch, and deviations by which it may be off.
ODD, DEVIATIONS = 16, 3.0
ODD_COLUMNS = tuple(f"o{i}" for i in range(ODD))


def odd_sketches(tokens: DataFrame) -> DataFrame:
    """(node, size, o0, o1, ...) of sets (node, token): for each set a bitmap in
    which each token flips one bit."""
    bits = 64 * ODD
    at = F.pmod(F.col("token"), F.lit(bits)).cast("int")
    each = tokens.select("node", at.alias("at"))
    flips = [F.expr(f"bit_xor(if(shiftright(at, 6) = {i}, shiftleft(1L, at & 63), 0L))").alias(c) for i, c in enumerate(ODD_COLUMNS)]
    return each.groupBy("node").agg(F.count("*").alias("size"), *flips)


def _odd_near(a: str, b: str, threshold: float) -> Column:
    """Whether two sketched sets may be alike.

    Alike sets differ in at most m = (1 - t) / (1 + t) of the tokens of both. The
    bits in which their sketches differ are then n / 2 (1 - exp(-2 m / n)) on
    average, with a variance of n / 4 (1 - (1 + x) exp(-x)), x = 4 m / n; pairs
    that lie DEVIATIONS above are taken as not alike.
    """
    n = float(64 * ODD)
    differ = sum((F.bit_count(F.col(a + c).bitwiseXOR(F.col(b + c))) for c in ODD_COLUMNS), F.lit(0))
    most = (F.col(a + "size") + F.col(b + "size")) * ((1 - threshold) / (1 + threshold))
    x = most * (4 / n)
    return differ <= n / 2 * (1 - F.exp(-x / 2)) + DEVIATIONS * F.sqrt(F.greatest(n / 4 * (1 - (1 + x) * F.exp(-x)), F.lit(0.0))) + 1


#: Groups of the buckets of rare tokens: of these a row carries its node's own group.
GROUPS = 256


def _open_pairs(rest: DataFrame, judged: DataFrame, lanes: Lanes, sketches: Callable[[DataFrame], DataFrame] | None, threshold: float, groups: int = 1) -> DataFrame:
    """edges(a, b) not judged yet of the open nodes of one bucket and different
    classes; the largest class is not compared with itself. Pairs whose lanes or
    sketches are far apart never leave the join.

    A pair meets only in the least of its common buckets of a group, so a row
    carries its node's buckets of that group: all of a node's bands, but of a long
    text's thousands of tokens a ``groups``-th."""
    rest = rest.withColumn("group", F.pmod("bucket", F.lit(groups)))
    rest = rest.join(rest.groupBy("node", "group").agg(F.collect_set("bucket").alias("open")), ["node", "group"]).drop("group")
    extra: tuple[str, ...] = ("open",)
    if sketches is not None:
        extra += ("size", *ODD_COLUMNS)
        rest = rest.join(sketches(keep(rest.select("node").distinct(), "open-nodes")), "node")
    named = lambda prefix: [*lanes.named(prefix), *[F.col(c).alias(prefix + c) for c in extra]]
    one = rest.where("class <> most").select(F.col("bucket").alias("at"), F.col("node").alias("x"), F.col("class").alias("c"), *named("x_"))
    two = rest.select("bucket", F.col("node").alias("y"), F.col("class").alias("d"), "most", *named("y_"))
    ok = (F.col("c") != F.col("d")) & ((F.col("d") == F.col("most")) | (F.col("x") < F.col("y"))) & lanes.near("x_", "y_")
    if sketches is not None:
        ok = ok & _odd_near("x_", "y_", threshold)
    ok = ok & (F.array_min(F.array_intersect("x_open", "y_open")) == F.col("at"))
    pairs = one.join(two, (F.col("at") == F.col("bucket")) & ok)
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct().join(judged.select("a", "b"), ["a", "b"], "left_anti")


def _by_rare_tokens(nodes: DataFrame, tokens: Callable[[DataFrame], DataFrame], threshold: float) -> DataFrame:
    """(bucket, node): a bucket for each token among a node's rarest ones.

    Prefix filter: of two sets whose Jaccard index reaches the threshold, the
    rarest n - ceil(threshold * n) + 1 tokens of either have one in common.
    """
    each = keep(tokens(nodes), "tokens")
    own = Window.partitionBy("node")
    told = each.join(each.groupBy("token").agg(F.count("*").alias("n")), "token")
    told = told.withColumn("place", F.row_number().over(own.orderBy("n", "token"))).withColumn("size", F.count("*").over(own))
    rare = told.where(f"place <= size - cast(ceil({threshold} * size - 1e-9) as int) + 1 and n > 1")
    return keep(rare.select(F.col("token").alias("bucket"), "node"), "rare")


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """``classes`` after more links(a, b) between their nodes or new ones."""
    root = maybe_broadcast(classes.select("node", "root"), 16)
    ends = links.select("a", "b").join(root.toDF("a", "u"), "a", "left").join(root.toDF("b", "v"), "b", "left")
    over = components(ends.select(F.coalesce("u", "a").alias("a"), F.coalesce("v", "b").alias("b")))
    over = over.toDF("old", "new")
    moved = classes.select("node", "root").join(over, F.col("root") == F.col("old"), "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = over.join(root, F.col("old") == F.col("node"), "left_anti").select(F.col("old").alias("node"), F.col("new").alias("root"))
    return keep(moved.union(fresh), "joined")


def linked(
    rows: DataFrame, judge: Callable[[DataFrame], DataFrame], tokens: Callable[[DataFrame], DataFrame], threshold: float, lanes: Lanes = Lanes(), paired: int = PAIRED,
    sketches: Callable[[DataFrame], DataFrame] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(links, classes) of the rows (bucket, node, lanes): links (a, b,
    similarity) that reach the threshold, classes (node, root) by them.

    Any two alike nodes that share a bucket, and whose lanes are near, end in
    one class. A bucket's nodes are compared with its lead. Where that leaves
    several classes in a bucket, nodes of different classes are compared pair
    by pair, if that makes at most ``paired`` squared pairs. Larger buckets are
    split by their nodes' rarest tokens, which loses no alike pair, and led once
    more; then what is open is compared in pairs whatever its number. Pairs of
    one class are left out. ``judge`` turns edges(a, b) into a kept table with
    their similarity; ``tokens`` gives (node, token) of nodes(node), as sets;
    ``sketches``, if given, the kept odd sketches of nodes(node).
    """
    judged = None
    classes = None
    for last in (False, True):
        met, led = led_buckets(rows, lanes)
        edges = led.where("near").select(F.least("node", "lead").alias("a"), F.greatest("node", "lead").alias("b")).distinct()
        edges = keep(edges if judged is None else edges.join(judged.select("a", "b"), ["a", "b"], "left_anti"), "edges")
        new = judge(edges)
        judged = new if judged is None else judged.union(new)
        good = new.where(F.col("similarity") >= threshold)
        classes = keep(components(good), "classes") if classes is None else _joined(classes, good)
        rest = _left_open(met, classes, lanes)
        pairs = keep(_open_pairs(rest if last else rest.where(F.col("pairs") <= paired**2), judged, lanes, sketches, threshold, GROUPS if last else 1), "pairs")
        if not pairs.isEmpty():
            new = judge(pairs)
            judged = judged.union(new)
            good = new.where(F.col("similarity") >= threshold)
            if not good.isEmpty():
                classes = _joined(classes, good)
        large = rest.where(F.col("pairs") > paired**2)
        if last or large.isEmpty():
            break
        nodes = large.groupBy("node").agg(*[F.min(c).alias(c) for c in lanes.columns], F.count("*").alias("n")).drop("n")
        nodes = keep(nodes, "large")
        rows = _by_rare_tokens(nodes.select("node"), tokens, threshold).join(nodes, "node").select("bucket", "node", *lanes.columns)
    return judged.where(F.col("similarity") >= threshold), classes
