"""Per-key results where a few keys hold most rows (problem 3).

Counts, distinct items and means come from aggregates that combine before the
shuffle. Exact quantiles come from distributed selection: per key, a histogram
of mergeable counts between the least and greatest candidate narrows the
interval that holds each rank, until it holds one value. No task ever gathers
the values of a key.

Cases: null keys are left out; null, NaN and infinite values count as rows but not in mean or
quantiles; a key without values has null mean and quantiles; ties resolve to the
value itself; quantile q of n values is the one of rank max(1, ceil(q n)).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.operators.skew import heavy_keys, lookup_split
from docketflow.runtime import cut

BINS = 64


def _rank(q: float | Callable[[Column], Column], n: Column) -> Column:
    if callable(q):
        return q(n).cast("long")
    return F.greatest(F.lit(1), F.ceil(F.lit(q) * n - F.lit(1e-9))).cast("long")


def exact_quantiles(histogram: DataFrame, heavy: DataFrame, quantiles: dict[str, float | Callable[[Column], Column]], bins: int = BINS) -> DataFrame:
    """(key, total, one column per quantile) of ``histogram`` (key, value, n), whose counts may be split over rows.

    A quantile is a share, or a function from the number of values to the rank.
    total is the number of values among which ranks were resolved; ``heavy`` (key,
    salts) are the keys of many distinct values.
    """
    values = histogram.filter(F.abs("value") < F.lit(float("inf")))
    ends = values.groupBy("key").agg(F.sum("n").alias("total"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    wanted = F.explode(F.array(*(F.struct(F.lit(name).alias("q"), _rank(q, F.col("total")).alias("rank")) for name, q in quantiles.items())))
    state = cut(ends.select("key", "total", "lo", "hi", wanted.alias("w")).select("key", "total", "w.q", "w.rank", "lo", "hi"), "quantiles")
    done = state.filter("lo = hi").select("key", "total", "q", F.col("lo").alias("value"))
    while True:
        open_ = state.filter("lo < hi")
        if open_.isEmpty():
            break
        # one row per key, so that the lookup stays unique in it
        asked = open_.groupBy("key").agg(F.collect_list(F.struct("total", "q", "rank", "lo", "hi")).alias("asked"))
        inside = (
            lookup_split(values, asked, heavy, "key")
            .select("key", "value", "n", F.explode("asked").alias("a"))
            .select("key", "value", "n", "a.*")
            .filter(F.col("value").between(F.col("lo"), F.col("hi")))
            .withColumn("bin", F.least(F.lit(bins - 1), F.floor((F.col("value") / 2 - F.col("lo") / 2) / (F.col("hi") / 2 - F.col("lo") / 2) * bins)))
        )
        counted = inside.groupBy("key", "total", "q", "rank", "bin").agg(F.sum("n").alias("n"), F.min("value").alias("lo"), F.max("value").alias("hi"))
        upto = F.sum("n").over(Window.partitionBy("key", "q").orderBy("bin"))  # at most `bins` rows
        state = cut(
            counted.withColumn("upto", upto)
            .filter((F.col("upto") >= F.col("rank")) & (F.col("upto") - F.col("n") < F.col("rank")))
            .select("key", "total", "q", (F.col("rank") - (F.col("upto") - F.col("n"))).alias("rank"), "lo", "hi"),
            "quantiles",
        )
        done = done.unionByName(state.filter("lo = hi").select("key", "total", "q", F.col("lo").alias("value")))
    return done.groupBy("key", "total").agg(*(F.max(F.when(F.col("q") == name, F.col("value"))).alias(name) for name in quantiles))


def key_profiles(
    rows: DataFrame, key: Column, item: Column, value: Column, heavy_from: float = 0.02, quantiles: dict[str, float] | None = None
) -> DataFrame:
    """(key, n_rows, n_items, mean_value, one column per quantile, heavy) per key."""
    quantiles = quantiles or {"q25": 0.25, "median": 0.5, "q75": 0.75}
    base = rows.select(key.alias("key"), item.alias("item"), value.cast("double").alias("value")).filter(F.col("key").isNotNull())
    histogram = cut(base.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")), "value-counts")
    items = base.filter(F.col("item").isNotNull()).groupBy("key", "item").agg(F.lit(1).alias("one")).groupBy("key").agg(F.count(F.lit(1)).alias("n_items"))
    # sums of a key's values, and its rows without one; its other rows are those among which the ranks were resolved
    has = F.coalesce(F.abs("value") < F.lit(float("inf")), F.lit(False))
    per_key = histogram.groupBy("key").agg(
        F.sum(F.when(~has, F.col("n")).otherwise(0)).alias("n_without"),
        F.sum(F.when(has, F.col("value") * F.col("n"))).alias("sum_value"),
        F.count(F.lit(1)).alias("n"),
    )
    picked = exact_quantiles(histogram, cut(heavy_keys(per_key.select("key", "n"), "key"), "value-heavy"), quantiles)
    joined = cut(
        per_key.join(picked, "key", "left").join(items, "key", "left").select(
            "key", (F.col("n_without") + F.coalesce("total", F.lit(0))).alias("n_rows"), F.coalesce("n_items", F.lit(0)).alias("n_items"), (F.col("sum_value") / F.col("total")).alias("mean_value"), *quantiles
        ),
        "key-profiles",
    )
    total = joined.agg(F.sum("n_rows")).first()[0] or 0
    return joined.select("*", (F.col("n_rows") >= F.lit(heavy_from * total)).alias("heavy"))
