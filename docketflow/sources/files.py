"""File scans with declared schemas, and sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.functions.text import file_name, strip_controls

# Declared schemas of the tables as text files.
REGISTER_RAW = "doc_num STRING, doc_url STRING, subject STRING, source STRING, date STRING"
PROPOSALS = "doc_num STRING, proposal_link STRING, proposal_title STRING, proposer STRING, count STRING, proposal_for_1 STRING, proposal_for_2 STRING"
RELEASES = "Year STRING, Date DATE, Version STRING"


def read_csv(spark: SparkSession, path: str, schema: str, pattern: str | None = None) -> DataFrame:
    """CSV with a header; nothing is inferred. ``pattern`` chooses files by name."""
    reader = spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"')
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).csv(path)


def read_parquet(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Parquet files whose name fits, with the file's name."""
    return spark.read.option("pathGlobFilter", pattern).parquet(path).select("*", F.col("_metadata.file_name").alias("file_name"))


def with_texts(df: DataFrame, spark: SparkSession, path: str, key: str = "doc_num") -> DataFrame:
    """Add ``text``: the whole file named after the key, '' where there is none."""
    blobs = spark.read.text(path, wholetext=True).select(F.regexp_replace(F.col("_metadata.file_name"), r"\.[^.]*$", "").alias("_name"), F.col("value").alias("text"))
    return df.withColumn("_name", file_name(F.col(key))).join(blobs, "_name", "left").drop("_name").withColumn("text", F.coalesce("text", F.lit("")))


def flat(df: DataFrame) -> DataFrame:
    """Nested columns as JSON, control characters removed: what a text file can hold."""
    nested = ("array", "map", "struct")
    cell = lambda c, kind: F.to_json(c) if kind.startswith(nested) else strip_controls(F.col(c)) if kind == "string" else F.col(c)
    return df.select(*(cell(c, kind).alias(c) for c, kind in df.dtypes))


def write_csv(df: DataFrame, path: str, quote_all: bool = False) -> None:
    flat(df).write.mode("overwrite").option("header", True).option("quoteAll", quote_all).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_lines(df: DataFrame, column: str, path: str) -> None:
    """Distinct values in order, one a line; range partitions keep the order over the files."""
    df.select(F.col(column).cast("string").alias("value")).filter(F.col("value").isNotNull()).distinct().orderBy("value").write.mode("overwrite").text(path)


def write_reports(df: DataFrame, name: Column, body: Column, path: str) -> None:
    """One partition folder per report, written by the executors."""
    df.select(file_name(name).alias("report"), body.alias("value")).write.mode("overwrite").partitionBy("report").text(path)


def unprocessed(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Rows whose key has no row in ``done``: what a resumed run has left."""
    return df.join(done.select(key), key, "left_anti")


def with_defaults(df: DataFrame, defaults: dict[str, Column]) -> DataFrame:
    """Add the columns that are absent."""
    return df.withColumns({c: v for c, v in defaults.items() if c not in df.columns})


def snake_names(df: DataFrame) -> DataFrame:
    """Column names in lower case with underscores."""
    import re

    return df.toDF(*(re.sub(r"\W+", "_", c.strip().lower()).strip("_") for c in df.columns))


def sample_rows(df: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows at random by a hash of key and seed: the same rows for the same seed, whatever their order."""
    return df.orderBy(F.md5(F.concat(F.col(key).cast("string"), F.lit(seed))), key).limit(n)


def filtered(df: DataFrame, keep: Column | None = None) -> DataFrame:
    """Rows that a condition given by the caller keeps; all without one."""
    return df if keep is None else df.filter(keep)


def each_text(df: DataFrame, change: Callable[[Column], Column], but: list[str] | None = None) -> DataFrame:
    """One function over all text columns but those named."""
    return df.select(*(change(F.col(c)).alias(c) if kind == "string" and c not in (but or []) else F.col(c) for c, kind in df.dtypes))


def replace_table(df: DataFrame, path: str) -> None:
    """Replace a Parquet table as a whole: the new one is written beside it and takes its name when it is complete.

    Whoever reads finds the old table, the new one, or for the moment between two
    renames none, but never a part; if writing fails, the old one stays.
    """
    spark = df.sparkSession
    jvm = spark._jvm
    old, new, gone = (jvm.org.apache.hadoop.fs.Path(path.rstrip("/") + tail) for tail in ("", ".new", ".old"))
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(path.rstrip("/") + ".new")
    if fs.exists(old):
        fs.delete(gone, True)
        fs.rename(old, gone)
    fs.rename(new, old)
    fs.delete(gone, True)


def append_batch(df: DataFrame, path: str, batch: int) -> None:
    """Write one batch of results as a folder of its own; writing it again replaces it."""
    df.write.mode("overwrite").parquet(f"{path.rstrip('/')}/batch={batch}")


def last_batch(spark: SparkSession, path: str) -> int | None:
    """The highest batch number written, or null: where a run resumes."""
    jvm = spark._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
    return max((int(n[6:]) for n in names if n.startswith("batch=")), default=None)


def write_sheets(sheets: dict[str, DataFrame], path: str) -> None:
    """Several tables of one report, each in a folder of its name."""
    for name, df in sheets.items():
        write_csv(df, f"{path.rstrip('/')}/{name}")


def read_workbook(spark: SparkSession, path: str, schema: str, sheet: str | int = 0) -> DataFrame:
    """One sheet of a workbook, read on the driver, as workbooks are small; needs a reader for the format to be installed."""
    import pandas as pd

    columns = [c.split()[0] for c in schema.split(", ")]
    rows = pd.read_excel(path, sheet_name=sheet, usecols=columns, dtype=str)[columns]
    return spark.createDataFrame([tuple(None if pd.isna(x) else x for x in r) for r in rows.itertuples(index=False)], ", ".join(f"{c} string" for c in columns))
