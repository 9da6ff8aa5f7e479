"""References to records that do not exist (problem 2).

References are read once into a table and pre-aggregated per key and period.
Keys that hold more than an equal share of all references are checked against a
broadcast of their own targets; the periods of all other keys go through shuffle
joins: an anti-join with the records that exist leaves those of missing and
withdrawn records, an equi-join with the times of the others those of late ones.
The verdicts are united. Where rows are needed again, those of heavy keys are
spread over many tasks.

Cases: null or blank references and those without a number are none; a row that
repeats a number counts once; a row without a time is never late; a target whose
times are all null is never late; empty inputs give empty results; columns other
than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.functions.docnum import doc_number, doc_numbers, doc_numbers_of_array
from docketflow.operators.skew import heavy_keys, month_of, salted_join
from docketflow.runtime import cut


def references(df: DataFrame, tab: str, id_col: str, ref_col: str, ts_col: str) -> DataFrame:
    """(tab, row_id, ref, ts): one row per input row and distinct number in ``ref_col`` (string or array)."""
    is_array = dict(df.dtypes)[ref_col].startswith("array")
    numbers = doc_numbers_of_array(F.col(ref_col)) if is_array else F.array_distinct(doc_numbers(F.col(ref_col)))
    return df.select(
        F.lit(tab).alias("tab"), F.col(id_col).alias("row_id"), F.explode(numbers).alias("ref"), F.col(ts_col).alias("ts")
    )


def targets(register: DataFrame, carryover: DataFrame, withdrawals: DataFrame) -> DataFrame:
    """(ref, there, first_ts, withdrawn) per known number; first_ts is null where a reference can't be late."""
    known = (
        register.select(doc_number("doc_num").alias("ref"), F.col("ingest_ts").alias("ts"), F.lit(1).alias("r"), F.lit(0).alias("c"), F.lit(0).alias("w"))
        .unionByName(carryover.select(doc_number("doc_num").alias("ref"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(0).alias("r"), F.lit(1).alias("c"), F.lit(0).alias("w")))
        .unionByName(withdrawals.select(doc_number("doc_num").alias("ref"), F.lit(None).cast("timestamp_ntz").alias("ts"), F.lit(0).alias("r"), F.lit(0).alias("c"), F.lit(1).alias("w")))
        .filter(F.col("ref").isNotNull())
    )
    return known.groupBy("ref").agg(F.min("ts").alias("ts"), F.max("r").alias("r"), F.max("c").alias("c"), F.max("w").alias("w")).select(
        "ref",
        ((F.col("r") == 1) | (F.col("c") == 1)).alias("there"),
        F.when(F.col("c") == 0, F.col("ts")).alias("first_ts"),
        (F.col("w") == 1).alias("withdrawn"),
    )


def _judge(refs: DataFrame, known: DataFrame, heavy_share: float | None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The references as a table, the heavy keys, and the periods (ref, tab, month, n, min_ts, max_ts, timed, kind, first_ts) that have orphans."""
    refs = cut(refs, "references")
    periods = cut(
        refs.groupBy("ref", "tab", month_of(F.col("ts")).alias("month")).agg(
            F.count(F.lit(1)).alias("n"), F.min("ts").alias("min_ts"), F.max("ts").alias("max_ts"), F.count("ts").alias("timed")
        ),
        "reference-periods",
    )
    heavy = cut(heavy_keys(periods.groupBy("ref").agg(F.sum("n").alias("n")), "ref", heavy_share and max(1, int(1 / heavy_share))), "reference-heavy")
    # at most as many heavy keys as shuffle partitions, and one target for each
    keys = F.broadcast(heavy.select("ref"))
    hot = periods.join(keys, "ref", "left_semi").join(F.broadcast(known.join(keys, "ref", "left_semi")), "ref", "left")
    cold = periods.join(keys, "ref", "left_anti")
    there = known.filter("there")
    absent = cold.join(there.select("ref"), "ref", "left_anti").join(known.filter("NOT there"), "ref", "left")
    late = cold.join(there.filter(F.col("first_ts").isNotNull()), "ref")
    kind = F.when(F.coalesce("there", F.lit(False)), "late").when(F.coalesce("withdrawn", F.lit(False)), "withdrawn").otherwise("missing")
    judged = hot.unionByName(absent).unionByName(late).withColumn("kind", kind)
    return refs, heavy, cut(judged.filter((F.col("kind") != "late") | (F.col("min_ts") < F.col("first_ts"))).drop("there", "withdrawn"), "reference-verdicts")


def orphan_rows(refs: DataFrame, known: DataFrame, heavy_share: float | None = None) -> DataFrame:
    """(tab, row_id, ref_doc_num, kind): each reference whose target is missing, withdrawn or late.

    Keys with more than ``heavy_share`` of all references are heavy; by default, more than an equal share of a shuffle partition.
    """
    refs, heavy, judged = _judge(refs, known, heavy_share)
    suspects = judged.groupBy("ref", "kind").agg(F.min("first_ts").alias("first_ts"))
    found = salted_join(refs, suspects, heavy, "ref", ["tab", "row_id"])
    return found.filter((F.col("kind") != "late") | (F.col("ts") < F.col("first_ts"))).select(
        "tab", "row_id", F.col("ref").alias("ref_doc_num"), "kind"
    )


def orphan_counts(refs: DataFrame, known: DataFrame, heavy_share: float | None = None) -> DataFrame:
    """(tab, month, kind, n_refs, n_numbers) from the pre-aggregated periods.

    Only periods in which a target appeared, so that some references are late
    and others aren't, need their rows again.
    """
    refs, heavy, judged = _judge(refs, known, heavy_share)
    absent = F.col("kind") != "late"
    whole = judged.filter(absent | (F.col("max_ts") < F.col("first_ts"))).select(
        "tab", "month", "kind", "ref", F.when(absent, F.col("n")).otherwise(F.col("timed")).alias("n")
    )
    # a target appears once, so a number has at most one such month in each table
    mixed = judged.filter(~absent & (F.col("max_ts") >= F.col("first_ts"))).select("ref", F.col("tab").alias("in_tab"), F.col("month").alias("in_month"), "first_ts")
    late = (
        salted_join(refs, mixed, heavy, "ref", ["tab", "row_id"])
        .filter((F.col("tab") == F.col("in_tab")) & (month_of(F.col("ts")) == F.col("in_month")) & (F.col("ts") < F.col("first_ts")))
        .groupBy("tab", F.col("in_month").alias("month"), "ref")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("kind", F.lit("late"))
    )
    return whole.unionByName(late).groupBy("tab", "month", "kind").agg(F.sum("n").alias("n_refs"), F.count(F.lit(1)).alias("n_numbers"))
