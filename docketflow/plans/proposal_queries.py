"""Queries of the tables of measures per proposal, their comparison and reports, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.functions import text
from docketflow.operators import proposals as measures
from docketflow.operators import reports, timeline
from docketflow.plans.pipeline_queries import MATCHES, REGISTER
from docketflow.plans.reference_queries import _T, _days, _norm
from docketflow.sources.tables import in_tables, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
ERA = "2017-01-01 00:00:00"


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = in_tables(sql)
        return f

    return keep


class Inputs:
    """The tables that all measures start from."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        register, matches, listed = load(spark, sf_dir, REGISTER), load(spark, sf_dir, MATCHES), load(spark, sf_dir, "proposals")
        self.docs = register.select(
            F.col("reg_id").alias("row_id"), "doc_num", F.col("ingest_ts").alias("ts"), F.col("extracted_doc_refs").alias("refs"), "people", "entities", F.col("pictograph_chars").alias("chars"), "doc_type", "subject", "source", "summary"
        )
        self.timeline = timeline.build(listed, self.docs)
        self.members = measures.named_members(self.timeline, self.docs)
        named = listed.withColumn("proposal_id", text.normal_id(F.col("doc_num"))).filter("proposal_id <> ''")
        self.proposals = measures.first_titles(named).select("proposal_id", "proposal_title", "proposer", "count")
        mails = matches.withColumn("proposal_id", text.normal_id(F.col("proposal_doc_num"))).join(self.proposals.select("proposal_id"), "proposal_id", "left_semi")
        self.mails = mails.select("proposal_id", "match_id", "year", F.col("loaded_ts").alias("ts"), "people", "confidence_score", "from_name", "from_email", "subject", "summary", "match_type")
        self.bounds = timeline.outcome_dates(self.timeline, self.docs)


_KINDS = ("people", "entities", "pictographs")
_M = (
    _T
    + f""", mem AS (SELECT proposal_id, row_id, ts, kind, name FROM t JOIN (
  SELECT reg_id AS row_id, 'people' AS kind, unnest(people) AS name FROM utc_doc_reg_df UNION ALL SELECT reg_id, 'entities', unnest(entities) FROM utc_doc_reg_df
  UNION ALL SELECT reg_id, 'pictographs', unnest(pictograph_chars) FROM utc_doc_reg_df) USING (row_id) WHERE trim(name, ' ') <> ''),
p AS (SELECT proposal_id, proposal_title, proposer, n AS listed FROM (
  SELECT {_norm('doc_num')} AS proposal_id, proposal_title, proposer, "count" AS n, row_number() OVER (PARTITION BY {_norm('doc_num')} ORDER BY doc_num) AS r FROM proposals WHERE coalesce(doc_num, '') <> '') WHERE r = 1),
ml AS (SELECT {_norm('proposal_doc_num')} AS proposal_id, match_id, year, loaded_ts AS ts, people, confidence_score FROM email_match_df WHERE {_norm('proposal_doc_num')} IN (SELECT proposal_id FROM p)),
d AS (SELECT proposal_id, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts FROM t GROUP BY 1),
mc AS (SELECT proposal_id, count(*) AS n, max(ts) AS last_mail FROM ml GROUP BY 1)
"""
)


def _counts(prefix: str = "") -> str:
    return ", ".join(f"count(DISTINCT name) FILTER (kind = '{k}') AS {prefix}{k}_count" for k in _KINDS)


def _zeros(prefix: str = "") -> str:
    return ", ".join(f"coalesce({prefix}{k}_count, 0) AS {prefix}{k}_count" for k in _KINDS)


def _lists() -> str:
    return ", ".join(f"string_agg(DISTINCT name, ', ' ORDER BY name) FILTER (kind = '{k}') AS {k}_list" for k in _KINDS)


@query(
    _M
    + f""", k AS (SELECT proposal_id, {_counts()} FROM mem GROUP BY 1),
w AS (SELECT proposal_id, count(DISTINCT name) AS email_people_count FROM (SELECT proposal_id, unnest(people) AS name FROM ml) WHERE trim(name, ' ') <> '' GROUP BY 1)
SELECT p.proposal_id, proposal_title, proposer, CASE WHEN regexp_full_match(listed, '\\d{{1,18}}') THEN CAST(listed AS BIGINT) ELSE 0 END AS pictographs_total, {_days('first_ts', 'last_ts')} AS velocity_days,
  greatest(coalesce(d.n, 0) - 1, 0) AS reference_count, {_zeros()}, coalesce(mc.n, 0) AS email_count, coalesce(email_people_count, 0) AS email_people_count, first_ts AS date_first, last_ts AS date_last
FROM p LEFT JOIN d USING (proposal_id) LEFT JOIN k USING (proposal_id) LEFT JOIN mc USING (proposal_id) LEFT JOIN w USING (proposal_id)"""
)
def c1_full_summary(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return measures.summary(i.proposals, i.timeline, i.members, i.mails.select("proposal_id", "people"))


@query(
    _M
    + f""", y AS (SELECT proposal_id, year(ts) AS year, count(*) - 1 AS reference_count FROM t WHERE ts IS NOT NULL GROUP BY 1, 2),
k AS (SELECT proposal_id, year(ts) AS year, {_counts()} FROM mem WHERE ts IS NOT NULL GROUP BY 1, 2)
SELECT y.proposal_id, y.year, reference_count, {_zeros()} FROM y LEFT JOIN k ON y.proposal_id = k.proposal_id AND y.year = k.year"""
)
def c1_yearly(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return measures.yearly_summary(i.timeline, i.members)


@query(
    _M
    + f""", y AS (SELECT proposal_id, year(ts) AS year, count(*) - 1 AS reference_count FROM t WHERE ts IS NOT NULL GROUP BY 1, 2),
my AS (SELECT proposal_id, year, count(*) AS email_count FROM ml WHERE year IS NOT NULL GROUP BY 1, 2),
k AS (SELECT proposal_id, year(ts) AS year, {_counts()}, {_lists()} FROM mem WHERE ts IS NOT NULL GROUP BY 1, 2),
yy AS (SELECT coalesce(y.proposal_id, my.proposal_id) AS proposal_id, coalesce(y.year, my.year) AS year, reference_count, email_count FROM y FULL JOIN my ON y.proposal_id = my.proposal_id AND y.year = my.year)
SELECT p.proposal_id, proposal_title, proposer, yy.year, coalesce(reference_count, 0) AS reference_count, coalesce(email_count, 0) AS email_count, {_zeros()},
  {_days('first_ts', 'last_ts')} AS days_to_last_reference, {_days('first_ts', 'last_mail')} AS days_to_last_email, {', '.join(f"coalesce({k}_list, '') AS {k}_list" for k in _KINDS)}
FROM p LEFT JOIN yy ON p.proposal_id = yy.proposal_id LEFT JOIN k ON yy.proposal_id = k.proposal_id AND yy.year = k.year LEFT JOIN d ON p.proposal_id = d.proposal_id LEFT JOIN mc ON p.proposal_id = mc.proposal_id"""
)
def c4_temporal(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return measures.temporal(i.proposals, i.timeline, i.members, i.mails.select("proposal_id", "year", "ts"))


_DRIFT = ", ".join(
    f"coalesce(string_agg(name, ', ' ORDER BY name) FILTER (kind = '{k}' AND {x}), '') AS {k}_{w}" for k in _KINDS for w, x in (("added", "b AND NOT a"), ("lost", "a AND NOT b"))
)


@query(
    _M
    + f""", k AS (SELECT proposal_id, {_counts()}, {_lists()} FROM mem GROUP BY 1),
c AS (SELECT proposal_id, name, count(*) AS n FROM mem WHERE kind = 'people' GROUP BY 1, 2),
s AS (SELECT proposal_id, name, ts, row_id, row_number() OVER (PARTITION BY proposal_id, name ORDER BY ts NULLS LAST, row_id) AS k FROM mem WHERE kind = 'people'),
best AS (SELECT proposal_id, string_agg(name, '; ' ORDER BY rank) AS key_contributors FROM (
  SELECT c.proposal_id, c.name, row_number() OVER (PARTITION BY c.proposal_id ORDER BY n DESC, ts NULLS LAST, row_id, c.name) AS rank FROM c JOIN s ON c.proposal_id = s.proposal_id AND c.name = s.name AND k = 1) WHERE rank <= 5 GROUP BY 1),
y AS (SELECT proposal_id, year(ts) AS year, count(*) - 1 AS n FROM t WHERE ts IS NOT NULL GROUP BY 1, 2),
yp AS (SELECT proposal_id, year(ts) AS year, count(DISTINCT name) AS k FROM mem WHERE kind = 'people' AND ts IS NOT NULL GROUP BY 1, 2),
sp AS (SELECT y.proposal_id, string_agg(y.year || ': ' || coalesce(k, 0), '; ' ORDER BY y.year) AS attention_span, string_agg(y.year || ': ' || n, '; ' ORDER BY y.year) AS velocity_per_year
  FROM y LEFT JOIN yp ON y.proposal_id = yp.proposal_id AND y.year = yp.year GROUP BY 1),
f AS (SELECT proposal_id, kind, name, min(year(ts)) AS year FROM mem WHERE ts IS NOT NULL AND kind <> 'pictographs' GROUP BY 1, 2, 3),
fy AS (SELECT proposal_id, year, year || ': ' || coalesce(string_agg(name, ', ' ORDER BY name) FILTER (kind = 'people'), '') || ' | ' || coalesce(string_agg(name, ', ' ORDER BY name) FILTER (kind = 'entities'), '') AS line FROM f GROUP BY 1, 2),
sh AS (SELECT proposal_id, string_agg(line, '; ' ORDER BY year) AS attention_shifts FROM fy GROUP BY 1),
yn AS (SELECT DISTINCT mem.proposal_id, kind, name, year(ts) AS year, year(first_ts) AS fy, year(last_ts) AS ly FROM mem JOIN d ON mem.proposal_id = d.proposal_id WHERE ts IS NOT NULL),
ab AS (SELECT proposal_id, kind, name, bool_or(year = fy) AS a, bool_or(year = ly) AS b FROM yn GROUP BY 1, 2, 3),
dr AS (SELECT proposal_id, {_DRIFT} FROM ab GROUP BY 1)
SELECT p.proposal_id, proposal_title, proposer, coalesce(people_count, 0) AS unique_people_count, coalesce(entities_count, 0) AS unique_entities_count, coalesce(people_list, '') AS people_list, coalesce(entities_list, '') AS entities_list,
  coalesce(key_contributors, '') AS key_contributors, coalesce(attention_span, '') AS attention_span, coalesce(velocity_per_year, '') AS velocity_per_year, coalesce(attention_shifts, '') AS attention_shifts,
  {', '.join(f"coalesce({k}_{w}, '') AS {k}_{w}" for k in _KINDS for w in ('added', 'lost'))}, CASE WHEN d.n > 1 THEN coalesce(mc.n, 0) / (d.n - 1)::DOUBLE END AS email_vs_doc_attention
FROM p LEFT JOIN d ON p.proposal_id = d.proposal_id LEFT JOIN k ON p.proposal_id = k.proposal_id LEFT JOIN best ON p.proposal_id = best.proposal_id LEFT JOIN sp ON p.proposal_id = sp.proposal_id
  LEFT JOIN sh ON p.proposal_id = sh.proposal_id LEFT JOIN dr ON p.proposal_id = dr.proposal_id LEFT JOIN mc ON p.proposal_id = mc.proposal_id"""
)
def c3_attention(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return measures.attention(i.proposals, i.timeline, i.members, i.mails.select("proposal_id"))


_GAPS = f""", g AS (SELECT proposal_id, {_days("lag(ts) OVER (PARTITION BY proposal_id ORDER BY ts, row_id)", "ts")} AS gap FROM {{0}} WHERE ts IS NOT NULL),
gg AS (SELECT proposal_id, coalesce(max(gap), 0) AS max_dormancy_days, coalesce(avg(gap), 0) AS avg_gap_days FROM g GROUP BY 1)
"""
_MEETING = "coalesce(list_contains(map_keys(doc_type), 'Meeting Documents'), false)"


@query(
    _M
    + _GAPS.format("t")
    + f""", e AS (SELECT t.proposal_id, count(*) - 1 AS reference_count, coalesce(min(ts) FILTER (reference_type = 'Original Proposal'), min(ts)) AS first_date,
  coalesce(max(ts) FILTER ({_MEETING}), max(ts)) AS last_date FROM (SELECT t.*, doc_type FROM t JOIN facts USING (row_id)) t GROUP BY 1),
x AS (SELECT *, {_days('first_date', 'last_date')} AS processing_days FROM e),
k AS (SELECT proposal_id, {_counts('unique_')} FROM mem GROUP BY 1),
mm AS (SELECT proposal_id, count(*) AS email_count, min(ts) AS first_email_date, max(ts) AS last_email_date, avg(confidence_score) AS avg_email_confidence, max(confidence_score) AS max_email_confidence FROM ml GROUP BY 1)
SELECT x.proposal_id, reference_count, first_date, last_date, processing_days, coalesce(max_dormancy_days, 0) AS max_dormancy_days, round(coalesce(avg_gap_days, 0), 6) AS avg_gap_days, {_zeros('unique_')},
  coalesce(email_count, 0) AS email_count, first_email_date, last_email_date, round(avg_email_confidence, 6) AS avg_email_confidence, max_email_confidence, round(processing_days / 365.25::DOUBLE, 6) AS processing_years,
  round(CASE WHEN processing_days > 0 THEN reference_count / (processing_days / 365.25::DOUBLE) ELSE 0 END, 6) AS velocity_per_year, round(CASE WHEN processing_days > 0 THEN reference_count / (processing_days / 30.44::DOUBLE) ELSE 0 END, 6) AS velocity_per_month,
  {_days('first_email_date', 'last_email_date')} AS email_span_days
FROM x LEFT JOIN gg ON x.proposal_id = gg.proposal_id LEFT JOIN k ON x.proposal_id = k.proposal_id LEFT JOIN mm ON x.proposal_id = mm.proposal_id"""
)
def c5_processing(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    rounded = ["avg_gap_days", "avg_email_confidence", "processing_years", "velocity_per_year", "velocity_per_month"]
    return measures.processing(i.timeline, i.docs, i.members, i.mails.select("proposal_id", "ts", "confidence_score")).withColumns({c: F.round(c, 6) for c in rounded})


_OUT = f""", o AS (SELECT proposal_id, min(ts) FILTER (reference_type <> 'Reference') AS start_ts, coalesce(max(ts) FILTER (reference_type = 'Reference' AND meeting), max(ts) FILTER (reference_type = 'Reference')) AS end_ts
  FROM (SELECT t.*, {_MEETING} AS meeting FROM t JOIN facts USING (row_id)) GROUP BY 1),
tc AS (SELECT t.* FROM t JOIN o ON t.proposal_id = o.proposal_id AND ts >= start_ts AND ts <= end_ts)
"""
_CLIPPED = (
    _M
    + _OUT
    + _GAPS.format("tc")
    + f""", n AS (SELECT proposal_id, count(*) AS reference_count FROM tc GROUP BY 1),
k AS (SELECT mem.proposal_id, {_counts('unique_')} FROM mem JOIN tc ON mem.proposal_id = tc.proposal_id AND mem.row_id = tc.row_id GROUP BY 1),
base AS (SELECT ids.proposal_id, coalesce(reference_count, 0) AS reference_count, max_dormancy_days, {_zeros('unique_')} FROM (SELECT DISTINCT proposal_id FROM t) ids
  LEFT JOIN n ON ids.proposal_id = n.proposal_id LEFT JOIN gg ON ids.proposal_id = gg.proposal_id LEFT JOIN k ON ids.proposal_id = k.proposal_id)
"""
)


@query(_CLIPPED + "SELECT * FROM base")
def c6_clipped(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return measures.clipped_processing(i.timeline, i.bounds, i.members, distribution=False)


_PROCESSED = (
    _CLIPPED
    + f""", s AS (SELECT proposal_id, {_days('min(ts) OVER w', 'max(ts) OVER w')} AS span, {_days('min(ts) OVER w', 'ts')} AS day FROM tc WINDOW w AS (PARTITION BY proposal_id)),
ps AS (SELECT proposal_id, span, CASE WHEN span > 0 THEN day / span::DOUBLE ELSE 0 END AS pos FROM s),
a AS (SELECT proposal_id, count(*) AS n, max(span) AS span, count(*) FILTER (pos <= 0.33::DOUBLE) AS early, count(*) FILTER (pos > 0.33::DOUBLE AND pos <= 0.67::DOUBLE) AS middle, count(*) FILTER (pos > 0.67::DOUBLE) AS late, avg(pos) AS mp FROM ps GROUP BY 1),
z AS (SELECT proposal_id, CASE WHEN n < 2 THEN 'insufficient_data' WHEN span <= 0 THEN 'single_day' WHEN early / n::DOUBLE > 0.5 THEN 'head_heavy' WHEN late / n::DOUBLE > 0.5 THEN 'tail_heavy' ELSE 'balanced' END AS pattern, n, early, middle, late, mp FROM a),
q AS (SELECT proposal_id, pattern, pattern IN ('head_heavy', 'tail_heavy', 'balanced') AS wide, n, early, middle, late, mp FROM z),
r AS (SELECT base.*, round(CASE WHEN wide THEN 100.0::DOUBLE * early / n WHEN pattern = 'single_day' THEN 100 ELSE 0 END, 6) AS early_pct, round(CASE WHEN wide THEN 100.0::DOUBLE * middle / n ELSE 0 END, 6) AS middle_pct,
  round(CASE WHEN wide THEN 100.0::DOUBLE * late / n ELSE 0 END, 6) AS late_pct, round(CASE WHEN wide THEN mp ELSE 0 END, 6) AS mean_position, coalesce(pattern, 'insufficient_data') AS pattern FROM base LEFT JOIN q ON base.proposal_id = q.proposal_id)
"""
)


@query(_PROCESSED + "SELECT * FROM r")
def c7_distribution(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return measures.clipped_processing(i.timeline, i.bounds, i.members).withColumns({c: F.round(c, 6) for c in ("early_pct", "middle_pct", "late_pct", "mean_position")})


@query(
    _M
    + f""", k AS (SELECT proposal_id, {_counts()} FROM mem GROUP BY 1)
SELECT row_number() OVER (ORDER BY d.n DESC, d.proposal_id) AS rank, d.proposal_id, d.n - 1 AS reference_count, {_zeros()}, first_ts AS date_first, last_ts AS date_last FROM d LEFT JOIN k ON d.proposal_id = k.proposal_id"""
)
def c11_ranked(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return measures.ranked_by_references(i.timeline, i.members)


# cohorts: proposals whose first document lies before and after a date


def _cohorts(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = Inputs(spark, sf_dir)
    measured = measures.clipped_processing(i.timeline, i.bounds, i.members).withColumns({c: F.round(c, 6) for c in ("early_pct", "middle_pct", "late_pct", "mean_position")}).join(i.bounds.select("proposal_id", "start_ts", "nature", F.col("days").alias("processing_days")), "proposal_id")
    after = F.col("start_ts") >= F.lit(ERA).cast("timestamp_ntz")
    return measured.withColumn("after", after).withColumn("era", F.when(after, "after").when(~after, "before"))


_COHORTS = (
    _PROCESSED
    + f""", c AS (SELECT r.*, start_ts, {_days('start_ts', 'end_ts')} AS processing_days, CASE WHEN {_days('start_ts', 'end_ts')} > 0 AND {_days('start_ts', 'end_ts')} <= 1000 THEN 'normal' ELSE 'exception' END AS nature,
  start_ts >= TIMESTAMP '{ERA}' AS "after", CASE WHEN start_ts >= TIMESTAMP '{ERA}' THEN 'after' WHEN start_ts < TIMESTAMP '{ERA}' THEN 'before' END AS era FROM r JOIN o ON r.proposal_id = o.proposal_id)
"""
)
_METRICS = ["reference_count", "max_dormancy_days", "unique_people_count", "unique_entities_count", "processing_days", "mean_position", "early_pct", "late_pct"]


@query(_COHORTS + "SELECT proposal_id, era, nature FROM c WHERE era IS NOT NULL")
def c8_eras(spark, sf_dir):
    return _cohorts(spark, sf_dir).filter("era IS NOT NULL").select("proposal_id", "era", "nature")


def _ratio(a: str, b: str, k: str = "1.0") -> str:
    return f"round(CASE WHEN {b} <> 0 THEN {k}::DOUBLE * {a} / {b} ELSE 0 END, 6)"


@query(
    _COHORTS
    + """, v AS (SELECT era, count(*) AS total, count(DISTINCT date_trunc('month', start_ts)) AS months, count(*) FILTER (nature = 'normal') AS normal, count(*) FILTER (nature = 'exception') AS exception FROM c WHERE era IS NOT NULL GROUP BY 1)
"""
    + f"SELECT era, total, months, {_ratio('total', 'months')} AS per_month, normal, exception, {_ratio('normal', 'months')} AS normal_per_month, {_ratio('exception', 'months')} AS exception_per_month, {_ratio('normal', 'total', '100.0')} AS normal_pct, {_ratio('exception', 'total', '100.0')} AS exception_pct FROM v"
)
def a18_rates_by_era(spark, sf_dir):
    """Volume a month and composition by status, per era."""
    rates = measures.volume_rates(_cohorts(spark, sf_dir), "start_ts", "era", "nature", ["normal", "exception"])
    return rates.withColumns({c: F.round(c, 6) for c in rates.columns if c.endswith(("month", "pct"))})


def _stat(side: str, name: str) -> str:
    return f"count(v) FILTER ({side}) AS n_{name}, round(avg(v) FILTER ({side}), 6) AS mean_{name}, round(stddev_samp(v) FILTER ({side}), 6) AS sd_{name}, median(v) FILTER ({side}) AS median_{name}, avg(v) FILTER ({side}) AS m_{name}"


@query(
    _COHORTS
    + ", l2 AS ("
    + " UNION ALL ".join(f"SELECT '{m}' AS metric, {m}::DOUBLE AS v, \"after\" AS f FROM c" for m in _METRICS)
    + f"""), k2 AS (SELECT metric, {_stat('NOT f', 'before')}, {_stat('f', 'after')} FROM l2 WHERE v IS NOT NULL AND f IS NOT NULL GROUP BY 1),
rk AS (SELECT metric, f, rank() OVER (PARTITION BY metric ORDER BY v) + (count(*) OVER (PARTITION BY metric, v) - 1) / 2.0 AS r FROM l2 WHERE v IS NOT NULL AND f IS NOT NULL),
u2 AS (SELECT metric, sum(r) FILTER (f)::DOUBLE - count(*) FILTER (f) * (count(*) FILTER (f) + 1) / 2.0::DOUBLE AS u FROM rk GROUP BY 1)
SELECT k2.metric, n_before, mean_before, sd_before, median_before, n_after, mean_after, sd_after, median_after, round(CASE WHEN m_before <> 0 THEN (m_after - m_before) / m_before * 100 END, 4) AS percent_change,
  CASE WHEN k2.metric = 'mean_position' THEN abs(m_after - 0.5::DOUBLE) < abs(m_before - 0.5::DOUBLE) WHEN k2.metric IN ('early_pct', 'late_pct') THEN abs(m_after - m_before) > 5 WHEN k2.metric IN ('processing_days', 'max_dormancy_days') THEN m_after < m_before ELSE m_after > m_before END AS improved, u
FROM k2 JOIN u2 ON k2.metric = u2.metric WHERE n_before > 0 AND n_after > 0"""
)
def a16_compared(spark, sf_dir):
    """Measures of both eras side by side; p values come with a16_tested."""
    rounded = {c: F.round(c, 6) for c in ("mean_before", "sd_before", "mean_after", "sd_after")} | {"percent_change": F.round("percent_change", 4)}
    return measures.compare(_cohorts(spark, sf_dir), _METRICS, "after").withColumns(rounded).drop("p_value", "significant")


@query()
def a16_tested(spark, sf_dir):
    return measures.compare(_cohorts(spark, sf_dir), _METRICS, "after").select("metric", "u", "p_value", "significant", "improved")


@query(_COHORTS + "SELECT nature, count(*) AS n, round(avg(processing_days), 6) AS mean, median(processing_days)::DOUBLE AS median FROM c WHERE processing_days IS NOT NULL GROUP BY 1")
def a21_by_nature(spark, sf_dir):
    from docketflow.operators.cohorts import cohort_stats

    return cohort_stats(_cohorts(spark, sf_dir), ["processing_days"], "nature").select("nature", "n", F.round("mean", 6).alias("mean"), "median")


@query(
    _COHORTS
    + f""", e AS (SELECT t.proposal_id, coalesce(min(ts) FILTER (reference_type = 'Original Proposal'), min(ts)) AS a, max(ts) AS b FROM t GROUP BY 1),
x AS (SELECT c.nature AS first_nature, CASE WHEN {_days('a', 'b')} > 0 AND {_days('a', 'b')} <= 1000 THEN 'normal' ELSE 'exception' END AS second_nature FROM c JOIN e ON c.proposal_id = e.proposal_id)
SELECT first_nature, second_nature, count(*) AS n FROM x GROUP BY 1, 2"""
)
def a21_transitions(spark, sf_dir):
    """How the nature of proposals changes from one way to date them to the other."""
    i = Inputs(spark, sf_dir)
    other = i.timeline.groupBy("proposal_id").agg(F.coalesce(F.min(F.when(F.col("reference_type") == "Original Proposal", F.col("ts"))), F.min("ts")).alias("a"), F.max("ts").alias("b"))
    days = measures.whole_days(F.col("a"), F.col("b"))
    second = other.select("proposal_id", F.when((days > 0) & (days <= 1000), "normal").otherwise("exception").alias("second_nature"))
    return i.bounds.select("proposal_id", F.col("nature").alias("first_nature")).join(second, "proposal_id").groupBy("first_nature", "second_nature").agg(F.count(F.lit(1)).alias("n"))


# reports


@query()
def r1_full_reports(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return reports.proposal_reports(i.proposals, i.timeline, i.docs, i.members, i.mails)


@query()
def r3_index(spark, sf_dir):
    i = Inputs(spark, sf_dir)
    return reports.index_report(measures.ranked_by_references(i.timeline, i.members), i.proposals)


@query()
def r4_cohort_report(spark, sf_dir):
    compared = measures.compare(_cohorts(spark, sf_dir), _METRICS, "after")
    return reports.cohort_report(compared)
