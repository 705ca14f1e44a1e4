"""Results that are made once: embeddings by content, answers by prompt.

A cache is a Parquet table of a key, what was made for it, and ``error`` where
making it failed. A call makes what is asked for and not there yet, appends it as
one run, and reads all back. Spark shows a run's files when all of its tasks are
done, so a run that dies leaves nothing half made; lost tasks are made again
within their run. One run at a time writes to a cache.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docweave.functions.embed import hashed
from docweave.sources import store


def computed_once(items: DataFrame, path: str, make: Callable[[DataFrame], DataFrame], key: str = "key", attempts: int = 3) -> DataFrame:
    """The rows that ``make`` gives for the different keys of ``items`` (key and
    any columns), from the table at ``path``; keys that aren't there are made.

    Rows that ``make`` gives an ``error`` are made again by later calls, up to
    ``attempts`` times in all, and come with their last error. Keys that are null
    have no row.
    """
    spark = items.sparkSession
    asked = items.where(F.col(key).isNotNull())
    # Keys are kept: the items are made anew only for what is missing.
    keys = store.keep(asked.select(key).distinct(), "keys")
    few = store.maybe_broadcast(keys, 80)
    stored, missing = None, keys
    if store.exists(spark, path):
        stored = spark.read.parquet(path)
        tried = stored.groupBy(key).agg(F.count("*").alias("tries"), F.bool_or(F.col("error").isNull()).alias("made"))
        # Of the cache, which grows, only what is asked for is shuffled where that is little.
        tried = tried.join(few, key, "left_semi")
        missing = store.keep(keys.join(tried.where(f"made or tries >= {attempts}"), key, "left_anti"), "missing")
    if stored is None or not missing.isEmpty():
        fresh = (asked if stored is None else asked.join(store.maybe_broadcast(missing, 80), key, "left_semi")).dropDuplicates([key])
        made = make(fresh)
        if "error" not in made.columns:
            made = made.withColumn("error", F.lit(None).cast("string"))
        run = 0 if stored is None else (stored.agg(F.max("run")).first()[0] or 0) + 1
        made.withColumn("run", F.lit(run)).write.mode("append").parquet(path)
    every = spark.read.parquet(path).join(few, key, "left_semi")
    # The row without an error, or else the last one.
    best = F.max_by(F.struct(*[F.col(f"`{c}`") for c in every.columns if c != key]), F.struct(F.col("error").isNull(), F.col("run")))
    return every.groupBy(key).agg(best.alias("best")).select(key, "best.*")


def made_in_last_run(df: DataFrame, path: str) -> int:
    """How many rows the last run added that made any."""
    table = df.sparkSession.read.parquet(path)
    last = table.agg(F.max("run")).first()[0]
    return 0 if last is None else table.where(F.col("run") == last).count()


def guarded(answer: Callable[[str], str]) -> Callable[[Column], Column]:
    """A column function (value, error) from a function of one text: what it
    raises becomes the row's error and doesn't end the run."""

    @F.pandas_udf("value string, error string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            try:
                rows.append((answer(t), None))
            except Exception as e:  # one row's failure is that row's
                rows.append((None, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(rows, columns=["value", "error"])

    return run


def cached_embeddings(records: DataFrame, path: str, text_col: str = "document", embed: Callable[[Column], Column] = hashed) -> DataFrame:
    """``records`` with ``embedding``; a text that the cache at ``path`` has seen,
    in whichever record, isn't embedded again."""
    keyed = records.withColumn("__key", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    items = keyed.select(F.col("__key").alias("key"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    known = computed_once(items, path, lambda fresh: fresh.select("key", embed(F.col("text")).alias("embedding")))
    return keyed.join(known.select(F.col("key").alias("__key"), "embedding"), "__key").drop("__key")


def cached_answers(prompts: DataFrame, path: str, generate: Callable[[Column], Column], prompt_col: str = "prompt", attempts: int = 3) -> DataFrame:
    """``prompts`` with ``answer`` and ``error``; ``generate`` gives (value, error),
    as :func:`guarded` does, and sees each different prompt once until it succeeds."""
    keyed = prompts.withColumn("__key", F.sha2(F.coalesce(F.col(prompt_col), F.lit("")), 256))
    items = keyed.select(F.col("__key").alias("key"), F.coalesce(F.col(prompt_col), F.lit("")).alias("prompt"))

    def make(fresh: DataFrame) -> DataFrame:
        return fresh.select("key", generate(F.col("prompt")).alias("out")).select("key", F.col("out.value").alias("answer"), F.col("out.error").alias("error"))

    known = computed_once(items, path, make, attempts=attempts)
    return keyed.join(known.select(F.col("key").alias("__key"), "answer", "error"), "__key").drop("__key")
