"""Tables in shared storage: scratch tables, chunk and vector stores, files."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``, which all machines share. Where it is unset, a
    run on one machine (tests) gets a temporary folder, once for the session; a
    cluster gets an error."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("docweave.scratch.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all machines share")
        path = tempfile.mkdtemp(prefix="docweave-")
        spark.conf.set("docweave.scratch.dir", path)
    return path.rstrip("/")


#: Rows of at most this many bytes in all are sent to every executor.
BROADCAST_BYTES = 16 << 20


def maybe_broadcast(small: DataFrame, row_bytes: int) -> DataFrame:
    """``small`` with a broadcast hint if a count proves that it is small;
    otherwise unchanged, for a shuffle join whose hot keys AQE splits."""
    return F.broadcast(small) if small.count() * row_bytes <= BROADCAST_BYTES else small


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written to shared scratch and read back, which cuts its lineage."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/docweave-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whichever file system it names."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p))


def stream_path(spark: SparkSession, path: str) -> str:
    """A path as file streams take it: folders as they are, a single file as a
    pattern that only it matches (a stream's plain path has to be a folder)."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    return f"{path[:-1]}[{path[-1]}]" if fs.exists(p) and fs.getFileStatus(p).isFile() else path


def first_existing(spark: SparkSession, *paths: str) -> str:
    """The first path that is there; FileNotFoundError if none is."""
    for path in paths:
        if exists(spark, path):
            return path
    raise FileNotFoundError(f"none of these is there: {', '.join(paths)}")


def read_chunks(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """Chunks from the first existing Parquet or JSON-lines path, pruned to ``columns``."""
    path = first_existing(spark, *paths)
    df = spark.read.json(path) if path.rstrip("/").endswith((".json", ".jsonl")) else spark.read.parquet(path)
    return df.select(*columns) if columns else df


def read_pages(spark: SparkSession, path: str, extract: Callable[[bytes], list[str]], pattern: str = "*.pdf") -> DataFrame:
    """(doc_id, page_number, text) of binary files; ``extract`` turns a file's
    bytes into page texts. Files are read by the executors."""
    import pandas as pd  # here only: the workers of the operators in llm have no use for it

    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, content in zip(b["path"], b["content"], strict=True):
                texts = extract(bytes(content))
                yield pd.DataFrame({"doc_id": p, "page_number": range(1, len(texts) + 1), "text": texts})

    return files.select("path", "content").mapInPandas(run, "doc_id string, page_number int, text string")


def list_files(spark: SparkSession, path: str, pattern: str = "*.pdf") -> DataFrame:
    """(path, megabytes) of the files found, without reading them."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    return files.select("path", (F.col("length") / 1024 / 1024).alias("megabytes"))


def first_file(spark: SparkSession, path: str, pattern: str = "*.pdf") -> str | None:
    """The first file's path by name, or None if there is none."""
    row = list_files(spark, path, pattern).agg(F.min("path").alias("path")).first()
    return row.path


def page_texts(pages: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """(doc, text): a document's page texts in page order, without a separator."""
    rows = F.array_sort(F.collect_list(F.struct("page_number", "text")))
    return pages.groupBy(doc_col).agg(F.array_join(rows["text"], "").alias("text"))


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole text files."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, query): a file's lines from 0, blank ones too. A query file
    is for people to write, so its lines are numbered from one whole text."""
    whole = spark.read.text(path, wholetext=True)
    text = F.regexp_replace(F.col("value"), r"(\r\n|\r|\n)\z", "")
    return whole.select(F.posexplode(F.split(text, r"\r\n|\r|\n", -1)).alias("query_id", "query"))


def write_table(df: DataFrame, path: str, mode: str = "overwrite", partition_by: list[str] | None = None) -> None:
    """Parquet, replacing what is there."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def write_texts(df: DataFrame, path: str, text_col: str = "text") -> None:
    """One line for each row; a text with line feeds can't be read back by line."""
    df.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)


def write_report(df: DataFrame, path: str, drop: tuple[str, ...] = ("chunks",)) -> None:
    """JSON lines, without the columns too large for a report."""
    df.drop(*drop).write.mode("overwrite").json(path)


def report_json(df: DataFrame) -> DataFrame:
    """(json): each row as JSON."""
    return df.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])).alias("json"))


def report_text(df: DataFrame, title: str = "Report") -> str:
    """A report of one row or few as lines for a console: a title, a rule, and
    each column's name and value; numbers below 1 as they are, others rounded."""
    out = [title, "=" * len(title)]
    for n, row in enumerate(df.limit(100).collect()):
        out += [""] * bool(n)
        for name, value in row.asDict(recursive=True).items():
            shown = f"{value:.3f}" if isinstance(value, float) else ", ".join(map(str, value)) if isinstance(value, list) else str(value)
            out.append(f"{name.replace('_', ' ')}: {shown}")
    return "\n".join(out)


def build_collection(records: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Replaces the collection at ``path`` by records (id, document, metadata)
    with the ``embedding`` that ``embed`` adds; returns it."""
    write_table(embed(records), path)
    return open_collection(records.sparkSession, path)


def open_collection(spark: SparkSession, path: str) -> DataFrame:
    """A stored collection; FileNotFoundError if it isn't there."""
    return spark.read.parquet(first_existing(spark, path))


#: Folders of a collection that is changed by id.
ID_BUCKETS = 64


def _by_id(records: DataFrame) -> DataFrame:
    return records.withColumn("bucket", F.pmod(F.xxhash64("id"), F.lit(ID_BUCKETS)).cast("int"))


def upsert_collection(records: DataFrame, path: str, embed: Callable[[DataFrame], DataFrame], deleted: DataFrame | None = None) -> DataFrame:
    """Puts records (id, document, metadata), with the embedding that ``embed``
    adds, into the collection at ``path``: those of known ids replace the stored
    ones, others are added, and ids in ``deleted`` (id) go. Returns the collection.

    Records lie in folders by the hash of their ids, and only folders that change
    are written again, so the same call again gives the same collection. Of
    records with one id the one with the greatest document stays.
    """
    spark = records.sparkSession
    one = records.groupBy("id").agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in records.columns]), F.coalesce("document", F.lit(""))).alias("r")).select("r.*")
    fresh = keep(_by_id(embed(one)), "upserts")
    if not exists(spark, path):
        fresh.write.partitionBy("bucket").parquet(path)
        if deleted is None:
            return open_collection(spark, path)
    gone = fresh.select("id", "bucket") if deleted is None else fresh.select("id", "bucket").union(_by_id(deleted.select("id")))
    stored = open_collection(spark, path)
    changed = [r.bucket for r in gone.select("bucket").distinct().collect()]
    old = stored.where(F.col("bucket").isin(changed)).join(maybe_broadcast(keep(gone.select("id").distinct(), "gone"), 64), "id", "left_anti")
    # The old rows are kept first: a write can't read the folders that it replaces.
    new = keep(old.unionByName(fresh if deleted is None else fresh.join(deleted.select("id"), "id", "left_anti")), "merged")
    emptied = set(changed) - {r.bucket for r in new.select("bucket").distinct().collect()}
    new.hint("rebalance", "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    for bucket in emptied:  # a folder that no row goes to isn't replaced by the writer
        p = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/bucket={bucket}")
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
    return spark.read.schema(stored.schema).parquet(path)
