"""Counts and shares of hierarchical labels."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketflow.functions.taxonomy import OTHERS


def flatten(df: DataFrame, column: str, keep: list[str]) -> DataFrame:
    """One row per category and subcategory of a label map; null and empty maps are Others, a category without subcategory has ''."""
    one = F.array(F.struct(F.lit(OTHERS).alias("key"), F.array().cast("array<string>").alias("value")))
    entries = F.when(F.coalesce(F.size(column), F.lit(0)) > 0, F.map_entries(column)).otherwise(one)
    rows = df.select(*keep, F.explode(entries).alias("e"))
    return rows.select(*keep, F.col("e.key").alias("category"), F.explode_outer("e.value").alias("sub")).select(*keep, "category", F.coalesce("sub", F.lit("")).alias("subcategory"))


def shares(df: DataFrame, group: list[str], of: list[str]) -> DataFrame:
    """Counts per group and its percentage within ``of``."""
    counted = df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("pct", 100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(*of)))


def top_per_group(counted: DataFrame, group: list[str], k: int, *ties: str) -> DataFrame:
    """The k rows of greatest n per group, ties by the named columns."""
    window = Window.partitionBy(*group).orderBy(F.desc("n"), *ties)
    return counted.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def year_over_year(counted: DataFrame, year: str, value: str, group: list[str]) -> DataFrame:
    """Difference of a value to the year before it in the table."""
    return counted.withColumn("change", F.col(value) - F.lag(value).over(Window.partitionBy(*group).orderBy(year)))


def pivot_counts(rows: DataFrame, row: str, column: str, values: list[str]) -> DataFrame:
    """Counts by row and each of the ``values`` of column, zeros filled in, columns in order of their totals (then as given)."""
    wide = rows.groupBy(row).pivot(column, values).count().na.fill(0, values)
    totals = {r[0]: r[1] for r in rows.filter(F.col(column).isin(values)).groupBy(column).count().collect()}
    return wide.select(row, *sorted(values, key=lambda v: (-totals.get(v, 0), values.index(v))))


def top_crosstab(counted: DataFrame, a: str, b: str, k: int) -> DataFrame:
    """Counts of the k greatest values of ``a`` by those of ``b``, zeros included: k times k rows at most."""
    top = lambda c: counted.groupBy(c).agg(F.sum("n").alias("t")).orderBy(F.desc("t"), c).limit(k).select(c)
    grid = top(a).withColumn("_one", F.lit(1)).join(top(b).withColumn("_one", F.lit(1)), "_one").drop("_one")
    return grid.join(counted, [a, b], "left").na.fill(0, ["n"])
