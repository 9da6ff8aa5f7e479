"""Running totals over a total order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketflow.runtime import cut


def running_totals(df: DataFrame, order: list[str], totals: dict[str, str], partitions: int | None = None) -> DataFrame:
    """Add, per ``totals`` (new column: summed column), the sum over all rows up to and with each row.

    Rows are range-partitioned by ``order`` (which must be unique for a defined
    result); each partition sums its own rows, and the partitions' totals, one row
    for each of the session's shuffle partitions, give the offsets. Null values
    count as zero.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(partitions, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    sums = sorted(ranged.groupBy("_p").agg(*(F.sum(F.coalesce(c, F.lit(0))).alias(n) for n, c in totals.items())).collect())
    out, window = ranged, Window.partitionBy("_p").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    for i, (name, column) in enumerate(totals.items(), 1):
        offsets, at = [F.lit(0)], 0
        for row in sums:
            offsets += [F.lit(row[0]), F.lit(at)]
            at += row[i]
        before = F.element_at(F.create_map(*offsets[1:]), F.col("_p")) if sums else F.lit(0)
        out = out.withColumn(name, F.sum(F.coalesce(column, F.lit(0))).over(window) + before)
    return out.drop("_p")


def forward_fill(df: DataFrame, group: str, order: list[str], value: str, filled: str, partitions: int | None = None) -> DataFrame:
    """Add ``filled``: the last value that is not null up to each row in its group, in the given unique order.

    Rows are range-partitioned by group and order, so that a group may lie in
    many tasks; what a partition hands on to the next is one row of it. Rows with
    a null group are a group.
    """
    partitions = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = cut(df.repartitionByRange(partitions, group, *order).withColumn("_p", F.spark_partition_id()), "ranged")
    at = F.struct(F.col(group).isNotNull(), group, *order)
    last = ranged.groupBy("_p", group).agg(F.max(at).alias("at"), F.max_by(F.col(value), F.when(F.col(value).isNotNull(), at)).alias("v"))
    ends = last.groupBy("_p").agg(F.max(F.struct("at", F.struct(F.col(group).alias("g"), "v").alias("end"))).alias("x")).select("_p", "x.end.g", "x.end.v").orderBy("_p").collect()
    carried, g, v = [], None, None
    for row in ends:
        if v is not None:
            carried.append((row["_p"], g, v))
        g, v = (row["g"], row["v"] if row["v"] is not None else (v if row["g"] == g else None))
    kinds = dict(df.dtypes)
    before = df.sparkSession.createDataFrame(carried, f"_p int, _g {kinds[group]}, _v {kinds[value]}")
    window = Window.partitionBy("_p", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = ranged.withColumn("_f", F.last(value, ignorenulls=True).over(window)).join(F.broadcast(before), "_p", "left")
    return inside.withColumn(filled, F.coalesce("_f", F.when(F.col(group).eqNullSafe(F.col("_g")), F.col("_v")))).drop("_p", "_f", "_g", "_v")
