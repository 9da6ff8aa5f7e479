"""Timelines of proposals through the citation graph, and what is measured on them.

One fact table (proposal, document) is built by equi-joins on normalised
numbers; every metric is an aggregate of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.functions.dates import whole_days
from docketflow.functions.text import normal_id


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """One row per key, the first in the given order. Null keys are a key."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")


def citation_edges(docs: DataFrame, normalize: bool = True) -> DataFrame:
    """(src, dst): document row id to each distinct number that it cites."""
    norm = (lambda c: normal_id(c)) if normalize else (lambda c: c)
    refs = F.array_distinct(F.filter(F.transform("refs", norm), lambda x: x.isNotNull() & (x != "")))
    return docs.select(F.col("row_id").alias("src"), F.explode(refs).alias("dst"))


def build(proposals: DataFrame, docs: DataFrame, normalize: bool = True) -> DataFrame:
    """Timeline rows (proposal_id, row_id, doc_num, ts, reference_type) of documents that are, or cite, a proposal.

    docs: (row_id, doc_num, ts, refs). A document number appears once per
    proposal, preferably as the proposal itself, then by row id.
    """
    norm = normal_id if normalize else (lambda c: c)
    ids = proposals.select(norm(F.col("doc_num")).alias("proposal_id")).filter("proposal_id <> ''").distinct()
    facts = docs.select("row_id", "doc_num", "ts", norm(F.col("doc_num")).alias("own"))
    direct = facts.join(ids, F.col("own") == F.col("proposal_id")).select("proposal_id", "row_id", "doc_num", "ts", F.lit(0).alias("rank"))
    cited = citation_edges(docs, normalize).join(ids, F.col("dst") == F.col("proposal_id")).select("proposal_id", F.col("src").alias("row_id"))
    cited = cited.join(facts.drop("own"), "row_id").select("proposal_id", "row_id", "doc_num", "ts", F.lit(1).alias("rank"))
    rows = first_by(direct.unionByName(cited), ["proposal_id", "doc_num"], F.col("rank"), F.col("row_id"))
    kind = F.when(normal_id(F.col("doc_num")) == F.col("proposal_id"), "Original Proposal").otherwise("Reference")
    return rows.select("proposal_id", "row_id", "doc_num", "ts", kind.alias("reference_type"))


def _ordered() -> Window:
    return Window.partitionBy("proposal_id").orderBy(F.col("ts").asc_nulls_last(), F.col("row_id"))


def lifecycle(timeline: DataFrame) -> DataFrame:
    """Span, velocity and dormancy per proposal; null where the span is zero or no date is known."""
    gaps = timeline.withColumn("gap", whole_days(F.lag("ts").over(_ordered()), F.col("ts")))
    month = F.year("ts") * 12 + F.month("ts")
    per = gaps.groupBy("proposal_id").agg(
        (F.count(F.lit(1)) - 1).alias("reference_count"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.max("gap").alias("max_dormancy_days"),
        F.avg("gap").alias("mean_gap_days"),
        F.stddev_samp("gap").alias("gap_sd"),
        (F.max(F.year("ts")) - F.min(F.year("ts")) + 1 - F.count_distinct(F.year("ts"))).alias("dormant_years"),
        (F.max(month) - F.min(month) + 1 - F.count_distinct(month)).alias("dormant_months"),
    )
    days = whole_days(F.col("first_ts"), F.col("last_ts"))
    per = per.withColumn("span_days", days)
    rate = lambda unit: F.when(F.col("span_days") > 0, F.col("reference_count") / (F.col("span_days") / F.lit(unit)))
    return per.select("*", rate(365.25).alias("velocity_per_year"), rate(30.44).alias("velocity_per_month"))


def positions(timeline: DataFrame) -> DataFrame:
    """Where in its span each proposal's documents lie: thirds, mean position, pattern."""
    whole = Window.partitionBy("proposal_id")
    dated = timeline.filter(F.col("ts").isNotNull())
    span = whole_days(F.min("ts").over(whole), F.max("ts").over(whole))
    at = whole_days(F.min("ts").over(whole), F.col("ts"))
    rows = dated.select("proposal_id", span.alias("span"), F.when(span > 0, at / span).otherwise(F.lit(0.0)).alias("pos"))
    per = rows.groupBy("proposal_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max("span").alias("span"),
        F.count_if(F.col("pos") <= 0.33).alias("early"),
        F.count_if((F.col("pos") > 0.33) & (F.col("pos") <= 0.67)).alias("middle"),
        F.count_if(F.col("pos") > 0.67).alias("late"),
        F.avg("pos").alias("mean_position"),
    )
    pattern = (
        F.when(F.col("n") < 2, "insufficient_data")
        .when(F.col("span") <= 0, "single_day")
        .when(F.col("early") / F.col("n") > 0.5, "head_heavy")
        .when(F.col("late") / F.col("n") > 0.5, "tail_heavy")
        .otherwise("balanced")
    )
    return per.select("proposal_id", "n", "early", "middle", "late", "mean_position", pattern.alias("pattern"))


def members(timeline: DataFrame, docs: DataFrame, column: str) -> DataFrame:
    """(proposal_id, row_id, ts, name): elements of an array column of the timeline's documents; null and blank ones are none."""
    names = docs.select("row_id", F.explode(column).alias("name")).filter(F.trim("name") != "")
    return timeline.select("proposal_id", "row_id", "ts").join(names, "row_id")


def novelty(named: DataFrame) -> DataFrame:
    """(proposal_id, year, new_names): names first seen in each year."""
    first = named.filter(F.col("ts").isNotNull()).groupBy("proposal_id", "name").agg(F.min(F.year("ts")).alias("year"))
    return first.groupBy("proposal_id", "year").agg(F.count(F.lit(1)).alias("new_names"))


def drift(named: DataFrame) -> DataFrame:
    """(proposal_id, added, lost): names of the last dated year that the first lacks, and the reverse."""
    yearly = named.filter(F.col("ts").isNotNull()).select("proposal_id", F.year("ts").alias("year"), "name").distinct()
    whole = Window.partitionBy("proposal_id")
    ends = yearly.select("proposal_id", "name", F.col("year"), F.min("year").over(whole).alias("first"), F.max("year").over(whole).alias("last")).filter("year = first OR year = last")
    per = ends.groupBy("proposal_id", "name").agg(F.max(F.col("year") == F.col("first")).alias("in_first"), F.max(F.col("year") == F.col("last")).alias("in_last"))
    return per.groupBy("proposal_id").agg(F.count_if(F.col("in_last") & ~F.col("in_first")).alias("added"), F.count_if(F.col("in_first") & ~F.col("in_last")).alias("lost"))


def top_names(named: DataFrame, k: int = 5) -> DataFrame:
    """(proposal_id, rank, name, n): the k most frequent names; ties go to the earlier first document, then by name."""
    counted = named.groupBy("proposal_id", "name").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.col("ts").isNull(), "ts", "row_id")).alias("seen"))
    rank = F.row_number().over(Window.partitionBy("proposal_id").orderBy(F.desc("n"), "seen", "name"))
    return counted.select("proposal_id", rank.alias("rank"), "name", "n").filter(F.col("rank") <= k)


def outcome_dates(timeline: DataFrame, docs: DataFrame, category: str = "Meeting Documents") -> DataFrame:
    """(proposal_id, start_ts, end_ts, days, nature): last reference by a document of a category, else by any; days from the original."""
    flagged = timeline.join(docs.select("row_id", F.coalesce(F.map_contains_key("doc_type", F.lit(category)), F.lit(False)).alias("meeting")), "row_id")
    reference = F.col("reference_type") == "Reference"
    per = flagged.groupBy("proposal_id").agg(
        F.min(F.when(~reference, F.col("ts"))).alias("start_ts"),
        F.coalesce(F.max(F.when(reference & F.col("meeting"), F.col("ts"))), F.max(F.when(reference, F.col("ts")))).alias("end_ts"),
    )
    days = whole_days(F.col("start_ts"), F.col("end_ts"))
    return per.select("proposal_id", "start_ts", "end_ts", days.alias("days"), F.when((days > 0) & (days <= 1000), "normal").otherwise("exception").alias("nature"))


def edges(timeline: DataFrame) -> DataFrame:
    """(proposal_id, doc_num, next_doc_num): consecutive documents of each timeline."""
    return timeline.select("proposal_id", "doc_num", F.lead("doc_num").over(_ordered()).alias("next_doc_num")).filter(F.col("next_doc_num").isNotNull())


def yearly(timeline: DataFrame, mails: DataFrame) -> DataFrame:
    """(proposal_id, year, documents, mails): over all years in which a proposal has documents or mails (proposal_id, year)."""
    docs = timeline.filter(F.col("ts").isNotNull()).groupBy("proposal_id", F.year("ts").alias("year")).agg(F.count(F.lit(1)).alias("documents"))
    mail = mails.filter(F.col("year").isNotNull()).groupBy("proposal_id", "year").agg(F.count(F.lit(1)).alias("mails"))
    return docs.join(mail, ["proposal_id", "year"], "full_outer").na.fill(0, ["documents", "mails"])
