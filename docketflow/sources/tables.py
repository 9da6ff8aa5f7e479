"""Parquet scans of the project's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from docketflow.functions.taxonomy import WORD
from docketflow.runtime import ship


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table; column pruning and filters reach the scan."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumnsRenamed({c: pictograph_name(c) for c in df.columns if WORD in c})


def pictograph_name(column: str) -> str:
    """The library's name of a column that is named after the word for a pictograph."""
    return column.replace(WORD, "pictograph")


def in_tables(sql: str) -> str:
    """SQL over the library's column names as SQL over the tables' own."""
    return sql.replace("pictograph_", f"{WORD}_")
