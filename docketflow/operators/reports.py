"""Reports in Markdown as string columns, one row per report; sinks write them.

Cases: a proposal without documents or mails has its heading and empty sections;
null texts are left out; pipes and line breaks in table cells are escaped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.functions.text import cut_text, display_sender, one_line, title_case
from docketflow.operators.proposals import KINDS

TOP_NAMES, TOP_MAILS, SUMMARY, CELL = 30, 3, 500, 40


def _ordered(rows: DataFrame, key: str, order: list[Column], line: Column, name: str, between: str = "\n") -> DataFrame:
    """One string per key of its lines in order. A report holds all lines of its key, so its size is that of the key."""
    sorted_lines = F.array_sort(F.collect_list(F.struct(*(c.alias(f"k{i}") for i, c in enumerate(order)), line.alias("line"))))
    return rows.groupBy(key).agg(F.array_join(F.transform(sorted_lines, lambda x: x["line"]), between).alias(name))


def _cell(c: Column | str, most: int = CELL) -> Column:
    return F.coalesce(cut_text(one_line(F.col(c) if isinstance(c, str) else c), most), F.lit(""))


def member_sections(members: DataFrame, most: int = TOP_NAMES) -> DataFrame:
    """(proposal_id, named): per kind the number of distinct members and the first of them by name."""
    distinct = members.select("proposal_id", "kind", "name").distinct()
    ranked = distinct.withColumn("r", F.row_number().over(Window.partitionBy("proposal_id", "kind").orderBy("name")))
    per = ranked.groupBy("proposal_id", "kind").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.array_sort(F.collect_list(F.when(F.col("r") <= most, F.col("name")))), ", ").alias("names"))
    line = F.concat(F.lit("- "), title_case(F.col("kind")), F.lit(" ("), F.col("n").cast("string"), F.lit("): "), F.col("names"))
    place = F.array_position(F.array(*(F.lit(k) for k in KINDS.values())), F.col("kind"))
    return _ordered(per, "proposal_id", [place], line, "named")


def mail_sections(mails: DataFrame, top: int = TOP_MAILS) -> DataFrame:
    """(proposal_id, mailed): number of mails, a table of the best by score (then earliest), and the very best in detail."""
    ranked = mails.withColumn("r", F.row_number().over(Window.partitionBy("proposal_id").orderBy(F.desc_nulls_last("confidence_score"), F.col("ts").asc_nulls_last(), "match_id")))
    counted = mails.groupBy("proposal_id").agg(F.count(F.lit(1)).alias("n"))
    best = ranked.filter(F.col("r") <= 10)
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("undated"))
    sender = display_sender(F.col("from_name"), F.col("from_email"))
    row = F.concat(F.lit("| "), day, F.lit(" | "), _cell(sender), F.lit(" | "), _cell("subject"), F.lit(" | "), F.coalesce(F.col("confidence_score").cast("string"), F.lit("")), F.lit(" |"))
    detail = F.concat(F.lit("#### "), F.coalesce(one_line(F.col("subject")), F.lit("no subject")), F.lit("\n"), sender, F.lit(", "), day, F.lit(", "), F.coalesce("match_type", F.lit("")), F.lit("\n"), F.coalesce(cut_text(F.col("summary"), SUMMARY), F.lit("")))
    tables = _ordered(best, "proposal_id", [F.col("r")], row, "rows")
    details = _ordered(best.filter(F.col("r") <= top), "proposal_id", [F.col("r")], detail, "details", "\n\n")
    head = F.concat(F.lit("Mails: "), F.col("n").cast("string"), F.lit("\n\n| date | sender | subject | score |\n|---|---|---|---|\n"))
    return counted.join(tables, "proposal_id").join(details, "proposal_id").select("proposal_id", F.concat(head, "rows", F.lit("\n\n"), "details").alias("mailed"))


def timeline_sections(timeline: DataFrame, docs: DataFrame) -> DataFrame:
    """(proposal_id, documents): an entry per document in order of date."""
    rows = timeline.join(docs.select("row_id", "subject", "source", "summary"), "row_id")
    day = F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("undated"))
    entry = F.concat(
        F.lit("### "), day, F.lit(" "), F.coalesce("doc_num", F.lit("")), F.lit(" ("), F.col("reference_type"), F.lit(")\n"), F.coalesce(one_line(F.col("subject")), F.lit("")), F.lit("\nSource: "), F.coalesce(one_line(F.col("source")), F.lit("")),
        F.coalesce(F.concat(F.lit("\n"), cut_text(F.col("summary"), SUMMARY)), F.lit("")),
    )
    return _ordered(rows, "proposal_id", [F.col("ts").isNull(), F.col("ts"), F.col("row_id")], entry, "documents", "\n\n")


def proposal_reports(proposals: DataFrame, timeline: DataFrame, docs: DataFrame, members: DataFrame, mails: DataFrame) -> DataFrame:
    """(proposal_id, report): heading, who and what is named, documents in order, mails."""
    joined = proposals.select("proposal_id", "proposal_title", "proposer")
    for part in (member_sections(members), timeline_sections(timeline, docs), mail_sections(mails)):
        joined = joined.join(part, "proposal_id", "left")
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return joined.select(
        "proposal_id",
        F.concat(F.lit("# "), "proposal_id", F.lit(" "), text("proposal_title"), F.lit("\nProposer: "), text("proposer"), F.lit("\n\n## Named\n"), text("named"), F.lit("\n\n## Documents\n"), text("documents"), F.lit("\n\n## Mails\n"), text("mailed")).alias("report"),
    )


def index_report(ranked: DataFrame, proposals: DataFrame, top: int = 10) -> DataFrame:
    """One row (section, lines) for the most referenced proposals and for each letter of all others' numbers, so that no task holds them all."""
    rows = ranked.join(proposals.select("proposal_id", "proposal_title"), "proposal_id", "left")
    link = F.concat(F.lit("- ["), "proposal_id", F.lit("]("), F.regexp_replace("proposal_id", "[^A-Za-z0-9_.-]+", "_"), F.lit(".md) "), _cell("proposal_title", 80), F.lit(", references: "), F.col("reference_count").cast("string"))
    best = rows.filter(F.col("rank") <= top).select(F.lit("top").alias("section"), F.col("rank").alias("at"), link.alias("line"))
    every = rows.select(F.substring("proposal_id", 1, 5).alias("section"), F.col("rank").alias("at"), link.alias("line"))
    return _ordered(best.unionByName(every), "section", [F.col("at")], F.col("line"), "lines")


def cohort_report(compared: DataFrame) -> DataFrame:
    """One row (report): a table of measures, a few dozen rows at most."""
    number = lambda c: F.coalesce(F.format_number(c, 2), F.lit("-"))
    row = F.concat(
        F.lit("| "), title_case(F.col("metric")), F.lit(" | "), number("mean_before"), F.lit(" ± "), number("sd_before"), F.lit(" | "), number("mean_after"), F.lit(" ± "), number("sd_after"), F.lit(" | "), number("percent_change"),
        F.lit(" | "), F.coalesce(F.format_number("p_value", 4), F.lit("-")), F.lit(" | "), F.when(F.col("improved"), "yes").otherwise("no"), F.lit(" |"),
    )
    whole = _ordered(compared.withColumn("all", F.lit(1)), "all", [F.col("metric")], row, "rows")
    return whole.select(F.concat(F.lit("| measure | before | after | change % | p | improved |\n|---|---|---|---|---|---|\n"), "rows").alias("report"))
