"""Quality rules as a ledger of failure bits.

Every rule is evaluated once for each document; the ledger keeps the
measurements and one bit for each rule that failed. Policies are named masks
over these bits, so another policy, or what a rule alone costs, is bitwise
arithmetic over the ledger and never reads a text again.

Only DataFrame functions are used. A text's word windows are hashed to longs
within its row; repeats are found by sorting (hash, position) packed in one
long, so a text of n words takes n log n steps and no row leaves its task.

Defined cases: a null text has no words, no symbols and no lines, and fails
the rule on few words; so does an empty text; repeated rows are judged each on
their own; a column of the ledger replaces one of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Characters counted as symbols (fixed values).
SYMBOLS = "#*$%&|<>"
#: Characters between words (fixed values): U+0020 and U+0009 to U+000D.
SPACES = " \t\n\x0b\x0c\r"
SPAN = 5

#: name, bit, failure as SQL over the measurements. A rule keeps its bit for good.
RULES = [
    ("few_words", 0, "n_words < 10"),
    ("repeated_windows", 1, "100 * n_repeat_words > 20 * n_words"),
    ("symbols", 2, "n_words >= 10 and n_symbols > n_words"),
    ("duplicate_lines", 3, "n_lines >= 4 and 100 * n_dup_lines > 50 * n_lines"),
    ("short_words", 4, "n_words >= 10 and word_chars < 2 * n_words"),
    ("long_words", 5, "n_words >= 10 and word_chars > 25 * n_words"),
    ("exclamation", 6, "n_words >= 10 and 2 * n_exclaim > n_words"),
]
BITS = {name: 1 << bit for name, bit, _ in RULES}
#: Versioned policies: a document fails one if it fails any of its rules.
POLICIES = {
    "base": ("few_words", "repeated_windows"),
    "v1": ("few_words", "repeated_windows", "symbols", "duplicate_lines"),
    "v2": tuple(name for name, _, _ in RULES),
}


def mask(policy: str) -> int:
    return sum(BITS[name] for name in POLICIES[policy])


def _without(text: Column, chars: str) -> Column:
    for c in chars:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


def measure(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements as columns."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    out = docs.withColumn("__dw_t", text)
    out = out.withColumn("__dw_w", F.regexp_extract_all("__dw_t", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)))
    lines = F.filter(F.split("__dw_t", "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = out.withColumn("__dw_lines", lines)
    size = F.length("__dw_t")
    out = out.select(
        *[F.col(f"`{c}`") for c in docs.columns if c not in MEASURES],
        "__dw_w",
        F.size("__dw_w").cast("long").alias("n_words"),
        F.length(_without(F.col("__dw_t"), SPACES)).cast("long").alias("word_chars"),
        (size - F.length(_without(F.col("__dw_t"), SYMBOLS))).cast("long").alias("n_symbols"),
        F.size("__dw_lines").cast("long").alias("n_lines"),
        (F.size("__dw_lines") - F.size(F.array_distinct("__dw_lines"))).cast("long").alias("n_dup_lines"),
        ((size - F.length(F.replace("__dw_t", F.lit("!!"), F.lit("")))) / 2).cast("long").alias("n_exclaim"),
    )
    # Window hashes; element i is the window from word i on.
    window = f"transform(sequence(0, size(__dw_w) - {SPAN}), i -> xxhash64({', '.join(f'__dw_w[i + {j}]' for j in range(SPAN))}))"
    out = out.withColumn("__dw_h", F.expr(f"case when size(__dw_w) >= {SPAN} then {window} else cast(array() as array<bigint>) end"))
    out = out.withColumn("__dw_bits", F.expr("cast(ceil(log2(size(__dw_h) + 2)) as int)"))
    # (hash, position) in one long: equal hashes come to stand side by side.
    packed = "sort_array(transform(__dw_h, (x, i) -> shiftleft(x, __dw_bits) | cast(i as bigint)))"
    out = out.withColumn("__dw_s", F.expr(f"case when size(array_distinct(__dw_h)) < size(__dw_h) then {packed} end"))
    out = out.withColumn("__dw_m", F.expr("shiftleft(1L, __dw_bits) - 1"))
    twin = "filter(__dw_s, (x, j) -> coalesce(__dw_h[cast(x & __dw_m as int)] = __dw_h[cast(get(__dw_s, j - 1) & __dw_m as int)], false) or coalesce(__dw_h[cast(x & __dw_m as int)] = __dw_h[cast(get(__dw_s, j + 1) & __dw_m as int)], false))"
    out = out.withColumn("__dw_p", F.expr(f"case when __dw_s is not null then sort_array(transform({twin}, x -> x & __dw_m)) end"))
    covered = f"aggregate(sequence(1, size(__dw_p) - 1), {SPAN}L, (a, j) -> a + least({SPAN}L, __dw_p[j] - __dw_p[j - 1]))"
    out = out.withColumn("n_repeat_words", F.expr(f"case when __dw_p is null or size(__dw_p) < 2 then 0L else {covered} end"))
    return out.drop("__dw_w", "__dw_h", "__dw_bits", "__dw_s", "__dw_m", "__dw_p")


MEASURES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_exclaim", "n_repeat_words")


def ledger(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with the measurements and ``failed_bits``."""
    bits = None
    for _, bit, failure in RULES:
        one = F.when(F.expr(failure), F.lit(1 << bit)).otherwise(F.lit(0))
        bits = one if bits is None else bits.bitwiseOR(one)
    return measure(docs, text_col).withColumn("failed_bits", bits.cast("long"))


def passes(policy: str, bits: Column | str = "failed_bits") -> Column:
    """Whether a document passes the policy."""
    return F.col(bits).bitwiseAND(F.lit(mask(policy))) == 0 if isinstance(bits, str) else bits.bitwiseAND(F.lit(mask(policy))) == 0


def ablation(led: DataFrame, policy: str) -> DataFrame:
    """(rule, failed, failed_alone, kept_without): for each rule of the policy,
    the documents that fail it, those that fail no other, and those that the
    policy without this rule keeps. One pass: counts by bit pattern first."""
    patterns = led.select(F.col("failed_bits").bitwiseAND(F.lit(mask(policy))).alias("bits")).groupBy("bits").agg(F.count("*").alias("n"))
    parts = [
        F.struct(
            F.lit(name).alias("rule"),
            F.when(F.col("bits").bitwiseAND(F.lit(BITS[name])) != 0, F.col("n")).otherwise(0).alias("failed"),
            F.when(F.col("bits") == BITS[name], F.col("n")).otherwise(0).alias("failed_alone"),
            F.when(F.col("bits").bitwiseAND(F.lit(mask(policy) & ~BITS[name])) == 0, F.col("n")).otherwise(0).alias("kept_without"),
        )
        for name in POLICIES[policy]
    ]
    each = patterns.select(F.explode(F.array(*parts)).alias("x")).select("x.*")
    return each.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("failed", "failed_alone", "kept_without")])


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = "v1") -> DataFrame:
    """The contract's columns."""
    led = ledger(docs.select(id_col, text_col), text_col)
    return led.select(
        id_col, "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", (~passes("base")).alias("base_failed"), passes(policy).alias("kept"), "failed_bits"
    )


_REP = f"""
with t as (select doc_id, coalesce(text, '') as x from documents),
w as (select doc_id, x, regexp_extract_all(x, '[^\\x20\\x09-\\x0D]+') as w,
  list_filter(string_split(x, chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines from t),
n as (select doc_id, x, w, len(w) as n, lines,
  [array_to_string(w[i:i + {SPAN - 1}], chr(1)) for i in range(1, greatest(len(w) - {SPAN - 2}, 1))] as h from w),
e as (select doc_id, unnest(h) as h, generate_subscripts(h, 1) as i from n where len(h) > len(list_distinct(h))),
d as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, h) as c from e) where c > 1),
p as (select doc_id, sum(least({SPAN}, coalesce(nxt - i, {SPAN}))) as r from (select doc_id, i, lead(i) over (partition by doc_id order by i) as nxt from d) group by doc_id),
m as (select n.doc_id, cast(n as bigint) as n_words, cast(len(array_to_string(w, '')) as bigint) as word_chars,
  cast(len(x) - len(regexp_replace(x, '[#*$%&|<>]', '', 'g')) as bigint) as n_symbols,
  cast(len(lines) as bigint) as n_lines, cast(len(lines) - len(list_distinct(lines)) as bigint) as n_dup_lines,
  cast((len(x) - len(replace(x, '!!', ''))) // 2 as bigint) as n_exclaim,
  cast(coalesce(r, 0) as bigint) as n_repeat_words from n left join p on n.doc_id = p.doc_id)
"""
ORACLE_SQL = (
    _REP
    + "select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (b & 3) <> 0 as base_failed, (b & "
    + str(mask("v1"))
    + ") = 0 as kept, b as failed_bits from (select *, cast("
    + " + ".join(f"(case when {failure} then {1 << bit} else 0 end)" for _, bit, failure in RULES)
    + " as bigint) as b from m)"
)
