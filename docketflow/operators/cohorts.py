"""Statistics of two cohorts, from counts per distinct value.

Ranks come from running totals over distinct values, so a value shared by most
rows is one row here, and no task sees a whole cohort.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.operators.hot_keys import exact_quantiles
from docketflow.operators.prefix import running_totals
from docketflow.operators.skew import heavy_keys
from docketflow.runtime import cut


def rank_sums(df: DataFrame, metrics: list[str], in_a: str) -> DataFrame:
    """Per metric (metric, n_a, n_b, u_a, tie_term, z, p_value): two-sided rank-sum test of the rows with ``in_a`` against the others.

    Null values and rows without cohort are left out; without two cohorts the
    statistics are null. p_value is exact for small cohorts without ties, as in
    common practice, else by the normal form with tie and continuity correction.
    All metrics are ranked in one pass.
    """
    each = F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in metrics)))
    counted = (
        df.select(F.col(in_a).alias("in_a"), each)
        .filter(F.col("v").isNotNull() & F.col("in_a").isNotNull())
        .groupBy("metric", "v")
        .agg(F.count_if("in_a").alias("a"), F.count(F.lit(1)).alias("t"))
    )
    ranked = cut(running_totals(counted, ["metric", "v"], {"upto": "t"}), "ranked")
    # ranks begin anew with each metric
    base = F.broadcast(ranked.groupBy("metric").agg(F.min(F.col("upto") - F.col("t")).alias("base")))
    mid = F.col("upto") - F.col("base") - (F.col("t") - 1) / 2.0
    sums = ranked.join(base, "metric").groupBy("metric").agg(
        F.sum("a").alias("a"), F.sum(F.col("t") - F.col("a")).alias("b"), F.sum(mid * F.col("a")).alias("ranks"), F.sum(F.col("t").cast("double") ** 3 - F.col("t")).alias("ties")
    )
    found, rows = {r["metric"]: r for r in sums.collect()}, []
    for metric in metrics:
        row = found.get(metric)
        n_a, n_b, rank_a, ties = (row["a"], row["b"], row["ranks"], row["ties"]) if row else (0, 0, 0.0, 0.0)
        u = z = p = None
        if n_a and n_b:
            u = float(rank_a) - n_a * (n_a + 1) / 2
            z, p = normal_form(u, n_a, n_b, ties)
            if ties == 0 and min(n_a, n_b) <= 8:
                p = exact_p(u, n_a, n_b)
        rows.append((metric, n_a, n_b, u, float(ties), z, p))
    return df.sparkSession.createDataFrame(rows, "metric string, n_a bigint, n_b bigint, u_a double, tie_term double, z double, p_value double")


def rank_sum(df: DataFrame, value: str, in_a: str) -> DataFrame:
    """One row (n_a, n_b, u_a, tie_term, z, p_value), as ``rank_sums`` for one metric."""
    return rank_sums(df, [value], in_a).drop("metric")


def normal_form(u: float, n_a: int, n_b: int, ties: float) -> tuple[float, float]:
    n = n_a + n_b
    variance = n_a * n_b / 12 * ((n + 1) - ties / (n * (n - 1))) if n > 1 else 0.0
    if variance <= 0:
        return 0.0, 1.0
    z = max(0.0, abs(u - n_a * n_b / 2) - 0.5) / math.sqrt(variance)
    return z, min(1.0, math.erfc(z / math.sqrt(2)))


def exact_p(u: float, n_a: int, n_b: int) -> float:
    """Two-sided p by the number of arrangements for each u; one cohort has at most eight values."""
    if n_a > n_b:
        n_a, n_b, u = n_b, n_a, n_a * n_b - u
    # ways[k][s]: choices of k values with rank sum excess s
    ways = [[0] * (n_a * n_b + 1) for _ in range(n_a + 1)]
    ways[0][0] = 1
    for j in range(n_a + n_b):
        for k in range(min(n_a, j + 1), 0, -1):
            shift = j - (k - 1)
            if shift <= n_b:
                for s in range(n_a * n_b, shift - 1, -1):
                    ways[k][s] += ways[k - 1][s - shift]
    total = math.comb(n_a + n_b, n_a)
    low = int(min(u, n_a * n_b - u))
    return min(1.0, 2 * sum(ways[n_a][: low + 1]) / total)


def cohort_stats(df: DataFrame, metrics: list[str], cohort: str) -> DataFrame:
    """(metric, cohort, n, mean, sd, median) of each metric, all in one aggregation.

    Medians come from distributed selection over counts per distinct value; of an
    even number of values, it is the mean of the two in the middle.
    """
    long = df.select(cohort, F.inline(F.array(*(F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics)))).filter(
        F.col("value").isNotNull() & F.col(cohort).isNotNull()
    )
    keyed = long.withColumn("key", F.concat_ws("\u0001", "metric", F.col(cohort).cast("string")))
    histogram = cut(keyed.groupBy("key", "value").agg(F.count(F.lit(1)).alias("n")), "cohort-values")
    heavy = heavy_keys(histogram.groupBy("key").agg(F.count(F.lit(1)).alias("n")), "key")
    middle = exact_quantiles(histogram, heavy, {"low": lambda n: F.ceil(n / 2), "high": lambda n: F.floor(n / 2) + 1})
    stats = keyed.groupBy("key", "metric", cohort).agg(F.count(F.lit(1)).alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("sd"))
    return stats.join(middle, "key").select("metric", cohort, "n", "mean", "sd", ((F.col("low") + F.col("high")) / 2).alias("median"))
