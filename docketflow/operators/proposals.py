"""Tables of measures per proposal, and their comparison between cohorts.

All are aggregates of one timeline (``timeline.build``), the members named in
its documents, and the mails of each proposal; no proposal is visited on its own.

Cases: a proposal without documents or mails keeps its row with zeros and nulls;
documents without a date count, but in no span; equal dates are ordered by row
id; null and blank names are none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.functions.dates import whole_days
from docketflow.functions.text import digits_or_zero
from docketflow.operators.cohorts import cohort_stats, rank_sums
from docketflow.operators.prefix import running_totals
from docketflow.operators.timeline import first_by, positions, top_names

#: Array columns of a document and what their distinct members are called.
KINDS = {"people": "people", "entities": "entities", "chars": "pictographs"}


def named_members(timeline: DataFrame, docs: DataFrame) -> DataFrame:
    """(proposal_id, row_id, ts, kind, name) of all kinds; docs: (row_id, people, entities, chars)."""
    each = [docs.select("row_id", F.lit(kind).alias("kind"), F.explode(column).alias("name")) for column, kind in KINDS.items()]
    names = each[0].unionByName(each[1]).unionByName(each[2]).filter(F.trim("name") != "")
    return timeline.select("proposal_id", "row_id", "ts").join(names, "row_id")


def _per_kind(members: DataFrame, keys: list[str], prefix: str = "", lists: bool = False) -> DataFrame:
    """Distinct members of each kind per key: counts, and sorted lists if wanted."""
    distinct = members.select(*keys, "kind", "name").distinct()
    of = lambda kind: F.when(F.col("kind") == kind, F.col("name"))
    out = [F.count(of(k)).alias(f"{prefix}{k}_count") for k in KINDS.values()]
    if lists:
        out += [F.array_join(F.array_sort(F.collect_list(of(k))), ", ").alias(f"{k}_list") for k in KINDS.values()]
    return distinct.groupBy(*keys).agg(*out)


def summary(proposals: DataFrame, timeline: DataFrame, members: DataFrame, mails: DataFrame) -> DataFrame:
    """One row per proposal of ``proposals`` (proposal_id, proposal_title, proposer, count); mails: (proposal_id, people)."""
    dates = timeline.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("date_first"), F.max("ts").alias("date_last"))
    mailed = mails.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("email_count"))
    writers = mails.select("proposal_id", F.explode("people").alias("name")).filter(F.trim("name") != "").distinct().groupBy("proposal_id").agg(F.count(F.lit(1)).alias("email_people_count"))
    joined = proposals
    for part in (dates, _per_kind(members, ["proposal_id"]), mailed, writers):
        joined = joined.join(part, "proposal_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return joined.select(
        "proposal_id", "proposal_title", "proposer", digits_or_zero(F.col("count")).alias("pictographs_total"), whole_days(F.col("date_first"), F.col("date_last")).alias("velocity_days"),
        F.greatest(zero("n") - 1, F.lit(0)).alias("reference_count"), *(zero(f"{k}_count").alias(f"{k}_count") for k in KINDS.values()),
        zero("email_count").alias("email_count"), zero("email_people_count").alias("email_people_count"), "date_first", "date_last",
    )


def yearly_summary(timeline: DataFrame, members: DataFrame) -> DataFrame:
    """(proposal_id, year, reference_count, counts of members) for each year with a document; references are documents less one."""
    year = F.year("ts").alias("year")
    docs = timeline.filter(F.col("ts").isNotNull()).groupBy("proposal_id", year).agg((F.count(F.lit(1)) - 1).alias("reference_count"))
    per = _per_kind(members.filter(F.col("ts").isNotNull()).withColumn("year", F.year("ts")), ["proposal_id", "year"])
    return docs.join(per, ["proposal_id", "year"], "left").na.fill(0, [f"{k}_count" for k in KINDS.values()])


def temporal(proposals: DataFrame, timeline: DataFrame, members: DataFrame, mails: DataFrame) -> DataFrame:
    """(proposal, year) over years with documents or mails, with lists and days from the first document to the last reference and mail.

    mails: (proposal_id, year, ts). A proposal without either has one row with a null year.
    """
    docs = timeline.filter(F.col("ts").isNotNull()).groupBy("proposal_id", F.year("ts").alias("year")).agg((F.count(F.lit(1)) - 1).alias("reference_count"))
    per = _per_kind(members.filter(F.col("ts").isNotNull()).withColumn("year", F.year("ts")), ["proposal_id", "year"], lists=True)
    mailed = mails.filter(F.col("year").isNotNull()).groupBy("proposal_id", "year").agg(F.count(F.lit(1)).alias("email_count"))
    years = docs.join(mailed, ["proposal_id", "year"], "full_outer").join(per, ["proposal_id", "year"], "left")
    ends = timeline.groupBy("proposal_id").agg(F.min("ts").alias("first"), F.max("ts").alias("last")).join(mails.groupBy("proposal_id").agg(F.max("ts").alias("last_mail")), "proposal_id", "full_outer")
    joined = proposals.select("proposal_id", "proposal_title", "proposer").join(years, "proposal_id", "left").join(ends, "proposal_id", "left")
    counts = ["reference_count", "email_count", *(f"{k}_count" for k in KINDS.values())]
    return joined.na.fill(0, counts).na.fill("", [f"{k}_list" for k in KINDS.values()]).select(
        "proposal_id", "proposal_title", "proposer", "year", *counts, whole_days(F.col("first"), F.col("last")).alias("days_to_last_reference"),
        whole_days(F.col("first"), F.col("last_mail")).alias("days_to_last_email"), *(f"{k}_list" for k in KINDS.values()),
    )


def _lines(rows: DataFrame, key: str, line: Column, name: str) -> DataFrame:
    """One string per proposal of its lines in the order of ``key``; a proposal has few lines, one a year."""
    return rows.groupBy("proposal_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.col(key).alias("k"), line.alias("v")))), lambda x: x["v"]), "; ").alias(name))


def attention(proposals: DataFrame, timeline: DataFrame, members: DataFrame, mails: DataFrame) -> DataFrame:
    """Who and what is named over time: distinct people and entities, most frequent people, people a year, newcomers a year, change from first to last year, references a year, mails per reference."""
    zero = lambda c: F.coalesce(c, F.lit(0))
    overall = _per_kind(members, ["proposal_id"], lists=True).drop("pictographs_count", "pictographs_list")
    people = members.filter("kind = 'people'")
    best = _lines(top_names(people), "rank", F.col("name"), "key_contributors")
    dated = members.filter(F.col("ts").isNotNull()).withColumn("year", F.year("ts"))
    docs = timeline.filter(F.col("ts").isNotNull()).groupBy("proposal_id", F.year("ts").alias("year")).agg((F.count(F.lit(1)) - 1).alias("n"))
    of_year = docs.join(dated.filter("kind = 'people'").groupBy("proposal_id", "year").agg(F.count_distinct("name").alias("k")), ["proposal_id", "year"], "left")
    labelled = lambda v: F.concat(F.col("year").cast("string"), F.lit(": "), v)
    span = _lines(of_year, "year", labelled(zero("k").cast("string")), "attention_span")
    speed = _lines(of_year, "year", labelled(F.col("n").cast("string")), "velocity_per_year")
    first = dated.groupBy("proposal_id", "kind", "name").agg(F.min("year").alias("year")).filter("kind <> 'pictographs'")
    new = first.groupBy("proposal_id", "year").agg(
        F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == "people", F.col("name")))), ", ").alias("p"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == "entities", F.col("name")))), ", ").alias("e")
    )
    shifts = _lines(new, "year", labelled(F.concat(F.col("p"), F.lit(" | "), F.col("e"))), "attention_shifts")
    joined = proposals.select("proposal_id", "proposal_title", "proposer")
    per = timeline.groupBy("proposal_id").agg((F.count(F.lit(1)) - 1).alias("references"))
    for part in (per, overall, best, span, speed, shifts, drift_lists(timeline, members), mails.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("mails"))):
        joined = joined.join(part, "proposal_id", "left")
    texts = ["people_list", "entities_list", "key_contributors", "attention_span", "velocity_per_year", "attention_shifts", *(f"{k}_{w}" for k in KINDS.values() for w in ("added", "lost"))]
    return joined.na.fill(0, ["people_count", "entities_count"]).na.fill("", texts).select(
        "proposal_id", "proposal_title", "proposer", F.col("people_count").alias("unique_people_count"), F.col("entities_count").alias("unique_entities_count"), *texts,
        F.when(F.col("references") > 0, zero("mails") / F.col("references")).alias("email_vs_doc_attention"),
    )


def drift_lists(timeline: DataFrame, members: DataFrame) -> DataFrame:
    """Members of each kind that the last dated year has and the first lacks, and the reverse, as sorted lists."""
    ends = timeline.filter(F.col("ts").isNotNull()).groupBy("proposal_id").agg(F.year(F.min("ts")).alias("first"), F.year(F.max("ts")).alias("last"))
    yearly = members.filter(F.col("ts").isNotNull()).select("proposal_id", "kind", "name", F.year("ts").alias("year")).distinct().join(ends, "proposal_id")
    per = yearly.groupBy("proposal_id", "kind", "name").agg(F.max(F.col("year") == F.col("first")).alias("a"), F.max(F.col("year") == F.col("last")).alias("b"))
    listed = lambda kind, is_in: F.array_join(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & is_in, F.col("name")))), ", ")
    added, lost = F.col("b") & ~F.col("a"), F.col("a") & ~F.col("b")
    return per.groupBy("proposal_id").agg(*(listed(k, x).alias(f"{k}_{w}") for k in KINDS.values() for w, x in (("added", added), ("lost", lost))))


def _gaps(timeline: DataFrame) -> DataFrame:
    ordered = Window.partitionBy("proposal_id").orderBy("ts", "row_id")
    gaps = timeline.filter(F.col("ts").isNotNull()).select("proposal_id", whole_days(F.lag("ts").over(ordered), F.col("ts")).alias("gap"))
    return gaps.groupBy("proposal_id").agg(F.coalesce(F.max("gap"), F.lit(0)).alias("max_dormancy_days"), F.coalesce(F.avg("gap"), F.lit(0.0)).alias("avg_gap_days"))


def processing(timeline: DataFrame, docs: DataFrame, members: DataFrame, mails: DataFrame, category: str = "Meeting Documents") -> DataFrame:
    """From the original (else the first document) to the last document of a category (else the last of all).

    docs: (row_id, doc_type); mails: (proposal_id, ts, confidence_score). Rates
    are 0 where no day has passed; references leave the original out.
    """
    flagged = timeline.join(docs.select("row_id", F.coalesce(F.map_contains_key("doc_type", F.lit(category)), F.lit(False)).alias("meeting")), "row_id")
    ends = flagged.groupBy("proposal_id").agg(
        (F.count(F.lit(1)) - 1).alias("reference_count"),
        F.coalesce(F.min(F.when(F.col("reference_type") == "Original Proposal", F.col("ts"))), F.min("ts")).alias("first_date"),
        F.coalesce(F.max(F.when(F.col("meeting"), F.col("ts"))), F.max("ts")).alias("last_date"),
    )
    mailed = mails.groupBy("proposal_id").agg(
        F.count(F.lit(1)).alias("email_count"), F.min("ts").alias("first_email_date"), F.max("ts").alias("last_email_date"), F.avg("confidence_score").alias("avg_email_confidence"), F.max("confidence_score").alias("max_email_confidence")
    )
    days = whole_days(F.col("first_date"), F.col("last_date"))
    joined = ends.withColumn("processing_days", days)
    for part in (_gaps(timeline), _per_kind(members, ["proposal_id"], "unique_"), mailed):
        joined = joined.join(part, "proposal_id", "left")
    rate = lambda unit: F.when(F.col("processing_days") > 0, F.col("reference_count") / (F.col("processing_days") / F.lit(unit))).otherwise(F.lit(0.0))
    return joined.na.fill(0, ["email_count", "max_dormancy_days", "avg_gap_days", *(f"unique_{k}_count" for k in KINDS.values())]).select(
        "*", (F.col("processing_days") / F.lit(365.25)).alias("processing_years"), rate(365.25).alias("velocity_per_year"), rate(30.44).alias("velocity_per_month"),
        whole_days(F.col("first_email_date"), F.col("last_email_date")).alias("email_span_days"),
    )


def clipped(timeline: DataFrame, bounds: DataFrame) -> DataFrame:
    """Documents of each timeline within its bounds (proposal_id, start_ts, end_ts), both included; undated ones and open bounds drop out."""
    return timeline.join(bounds.select("proposal_id", "start_ts", "end_ts"), "proposal_id").filter((F.col("ts") >= F.col("start_ts")) & (F.col("ts") <= F.col("end_ts"))).drop("start_ts", "end_ts")


def clipped_processing(timeline: DataFrame, bounds: DataFrame, members: DataFrame, distribution: bool = True) -> DataFrame:
    """Measures within bounds; the count includes the original. With ``distribution``, where in the span the documents lie.

    A proposal without a document in its bounds has count 0 and no dormancy.
    """
    within = clipped(timeline, bounds)
    every = timeline.select("proposal_id").distinct()
    parts = [within.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("reference_count")), _gaps(within).drop("avg_gap_days")]
    parts.append(_per_kind(members.join(within.select("proposal_id", "row_id"), ["proposal_id", "row_id"], "left_semi"), ["proposal_id"], "unique_"))
    if distribution:
        at, pct = positions(within), lambda c: 100.0 * F.col(c) / F.col("n")
        spread = F.col("pattern").isin("head_heavy", "tail_heavy", "balanced")
        single = F.col("pattern") == "single_day"
        share = lambda c, alone: F.when(spread, pct(c)).when(single, F.lit(alone)).otherwise(F.lit(0.0))
        parts.append(
            at.select(
                "proposal_id", share("early", 100.0).alias("early_pct"), share("middle", 0.0).alias("middle_pct"), share("late", 0.0).alias("late_pct"), F.when(spread, F.col("mean_position")).otherwise(F.lit(0.0)).alias("mean_position"), "pattern"
            )
        )
    joined = every
    for part in parts:
        joined = joined.join(part, "proposal_id", "left")
    zeros = ["reference_count", *(f"unique_{k}_count" for k in KINDS.values()), *(["early_pct", "middle_pct", "late_pct", "mean_position"] if distribution else [])]
    joined = joined.na.fill(0, zeros)
    return joined.na.fill("insufficient_data", ["pattern"]) if distribution else joined


def ranked_by_references(timeline: DataFrame, members: DataFrame) -> DataFrame:
    """(rank, proposal_id, reference_count, counts of members, first and last date): most references first, then by id."""
    per = timeline.groupBy("proposal_id").agg((F.count(F.lit(1)) - 1).alias("reference_count"), F.min("ts").alias("date_first"), F.max("ts").alias("date_last"))
    joined = per.join(_per_kind(members, ["proposal_id"]), "proposal_id", "left").na.fill(0, [f"{k}_count" for k in KINDS.values()])
    numbered = running_totals(joined.withColumn("_one", F.lit(1)).withColumn("_less", -F.col("reference_count")), ["_less", "proposal_id"], {"rank": "_one"})
    return numbered.drop("_one", "_less")


def volume_rates(df: DataFrame, date: str, era: str, status: str, statuses: list[str]) -> DataFrame:
    """Per era: rows, active months, rows a month, rows a month and percentage of each status; 0 where nothing is divided by."""
    ratio = lambda a, b, k=1.0: F.when(b != 0, k * a / b).otherwise(F.lit(0.0))
    per = df.filter(F.col(era).isNotNull()).groupBy(era).agg(
        F.count(F.lit(1)).alias("total"), F.count_distinct(F.date_trunc("month", F.col(date))).alias("months"), *(F.count_if(F.coalesce(F.col(status) == s, F.lit(False))).alias(s) for s in statuses)
    )
    months, total = F.col("months"), F.col("total")
    return per.select(era, "total", "months", ratio(total, months).alias("per_month"), *statuses, *(ratio(F.col(s), months).alias(f"{s}_per_month") for s in statuses), *(ratio(F.col(s), total, 100.0).alias(f"{s}_pct") for s in statuses))


def percent_change(before: Column, after: Column) -> Column:
    """Null where there is nothing to compare with."""
    return F.when(before != 0, (after - before) / before * 100)


def improved(metric: Column, before: Column, after: Column) -> Column:
    """Less is better for days and dormancy, nearer to the middle for positions, a change by over five points for shares; else more."""
    return (
        F.when(metric == "mean_position", F.abs(after - 0.5) < F.abs(before - 0.5))
        .when(metric.isin("early_pct", "late_pct"), F.abs(after - before) > 5)
        .when(metric.isin("processing_days", "max_dormancy_days"), after < before)
        .otherwise(after > before)
    )


def compare(df: DataFrame, metrics: list[str], is_after: str) -> DataFrame:
    """(metric, n, mean, sd and median of both cohorts, percent_change, improved, u, p_value, significant) of rows without and with ``is_after``.

    Metrics that the table lacks, or that are null in a whole cohort, have no row.
    """
    metrics = [m for m in metrics if m in df.columns]
    stats = cohort_stats(df, metrics, is_after)
    side = lambda flag, name: stats.filter(F.col(is_after) == flag).select("metric", *(F.col(c).alias(f"{c}_{name}") for c in ("n", "mean", "sd", "median")))
    both = side(False, "before").join(side(True, "after"), "metric")
    # one row per metric
    tests = rank_sums(df, metrics, is_after).select("metric", F.col("u_a").alias("u"), "p_value")
    before, after = F.col("mean_before"), F.col("mean_after")
    return both.join(F.broadcast(tests), "metric").select(
        "*", percent_change(before, after).alias("percent_change"), improved(F.col("metric"), before, after).alias("improved"), (F.col("p_value") < 0.05).alias("significant")
    )


def first_titles(proposals: DataFrame) -> DataFrame:
    """(proposal_id, proposal_title, proposer, count): of the rows with one normalised number, the first by number as written."""
    return first_by(proposals, ["proposal_id"], F.col("doc_num"))
