"""What the jobs share: settings, command line, logging, writers."""

from __future__ import annotations

import argparse
import logging
from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from docweave.functions import config

log = logging.getLogger("docweave.jobs")


def settings(spark: SparkSession, path: str | None, defaults: dict[str, Any]) -> dict[str, Any]:
    """Settings of a file in any store that Spark reads, over ``defaults``."""
    text = spark.read.text(path, wholetext=True).first()[0] if path else ""
    return config.validate(config.parse(text), defaults)


def names(value: str) -> list[str]:
    """The parts of a comma-separated setting."""
    return [v.strip() for v in value.split(",") if v.strip()]


def write_parts(df: DataFrame, path: str, by: list[str], replace_all: bool = False) -> None:
    """Parquet in folders by the columns ``by``. Folders that the rows go to are
    replaced, and with ``replace_all`` the others are removed."""
    mode = "static" if replace_all else "dynamic"
    df.write.mode("overwrite").option("partitionOverwriteMode", mode).partitionBy(*by).parquet(path)


def main(run: Callable[..., Any], defaults: dict[str, Any], paths: list[str], args: list[str] | None = None) -> None:
    """Runs a job from a command line: a settings file and one path for each of ``paths``."""
    parser = argparse.ArgumentParser(description=run.__doc__)
    parser.add_argument("--config", help="settings file")
    for name in paths:
        parser.add_argument(f"--{name}", required=True)
    given = vars(parser.parse_args(args))
    logging.basicConfig(level=logging.INFO, format="%(asctime)s %(name)s %(message)s")
    spark = SparkSession.builder.appName(run.__module__).getOrCreate()
    try:
        run(spark, *(given[name] for name in paths), settings(spark, given["config"], defaults))
    finally:
        spark.stop()
