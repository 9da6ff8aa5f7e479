"""Pieces for keys that hold a large part of all rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Pieces over which rows without a key are spread.
NULL_PIECES = 1024


def heavy_threshold(total: int, share: float) -> int:
    """Rows from which a key is heavy. At most ``1 / share`` keys reach it, whatever the data."""
    return max(2, math.ceil(total * share))


def heavy_keys(counted: DataFrame, key: str, pieces: int | None = None) -> DataFrame:
    """(key, salts) of ``counted`` (key, n): keys with more rows than one of ``pieces`` equal parts, and over how many parts to spread them.

    pieces is the session's number of shuffle partitions, which bounds the rows of the result.
    """
    pieces = pieces or int(counted.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = counted.agg(F.sum("n")).first()[0] or 0
    part = max(1.0, total / pieces)
    return counted.filter((F.col("n") > F.lit(part)) & F.col(key).isNotNull()).select(key, F.ceil(F.col("n") / F.lit(part)).cast("int").alias("salts"))


def salted_join(rows: DataFrame, lookup: DataFrame, heavy: DataFrame, key: str, by: list[str], how: str = "inner") -> DataFrame:
    """Equi-join of ``rows`` with ``lookup`` that no heavy key can unbalance, in one pass over ``rows``.

    ``heavy`` (key, salts) holds at most as many keys as there are shuffle
    partitions (``heavy_keys``), so it is broadcast. Rows of a heavy key are
    spread by a hash of the columns ``by``, its lookup rows are repeated for each
    part. Rows with a null key match nothing and are spread too.
    """
    marked = F.broadcast(heavy.select(key, F.col("salts").alias("_salts")))
    spread = F.xxhash64(*by)
    salt = F.when(F.col("_salts").isNotNull(), F.pmod(spread, F.col("_salts"))).when(F.col(key).isNull(), F.pmod(spread, F.lit(NULL_PIECES))).otherwise(F.lit(0))
    left = rows.join(marked, key, "left").withColumn("_salt", salt.cast("int")).drop("_salts")
    each = F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1)).alias("_salt")
    right = lookup.join(marked, key, "left").select(*lookup.columns, each)
    return left.join(right, [key, "_salt"], how).drop("_salt")


def lookup_split(rows: DataFrame, lookup: DataFrame, heavy: DataFrame, key: str, how: str = "inner") -> DataFrame:
    """Equi-join of ``rows`` with ``lookup`` (unique in ``key``) that no heavy key can unbalance.

    ``heavy`` holds the heavy keys, at most ``1 / share`` of them by arithmetic.
    Their lookup rows are broadcast and their rows stay where they are; the rest
    is joined by a shuffle. Rows with a null key match nothing. ``rows`` is
    evaluated twice; give a table.
    """
    keys = F.broadcast(heavy.select(key))
    hot = rows.join(keys, key, "left_semi").join(F.broadcast(lookup.join(keys, key, "left_semi")), key, how)
    cold = rows.join(keys, key, "left_anti").join(lookup.join(keys, key, "left_anti"), key, how)
    return hot.unionByName(cold)


def month_of(ts: Column) -> Column:
    """``yyyy-MM`` of a timestamp, null for null."""
    return F.date_format(ts, "yyyy-MM")
