"""Register, proposal, mail and cohort analytics: one query per operator group, with the SQL that gives the same rows."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docketflow.functions import dates, text
from docketflow.operators import cohorts, labels, prefix, relate, timeline
from docketflow.plans.pipeline_queries import MATCHES, REGISTER
from docketflow.sources.tables import in_tables, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = in_tables(sql)
        return f

    return keep


def _norm(x: str) -> str:
    p = r"[Ll]2/(\d{2})[-–—](\d{3,})"
    return f"CASE WHEN regexp_matches({x}, '{p}') THEN 'L2/' || regexp_extract({x}, '{p}', 1) || '-' || regexp_extract({x}, '{p}', 2) ELSE coalesce({x}, '') END"


_DAYS = "CAST(floor((epoch_us({1}) - epoch_us({0})) / 86400000000.0) AS INTEGER)"


def _days(a: str, b: str) -> str:
    return _DAYS.format(a, b)


_T = f"""
WITH ids AS (SELECT DISTINCT {_norm('doc_num')} AS proposal_id FROM proposals WHERE coalesce(doc_num, '') <> ''),
facts AS (SELECT reg_id AS row_id, doc_num, ingest_ts AS ts, {_norm('doc_num')} AS own, people, entities, doc_type FROM utc_doc_reg_df),
cites AS (SELECT DISTINCT reg_id AS src, {_norm('r')} AS dst FROM (SELECT reg_id, unnest(extracted_doc_refs) AS r FROM utc_doc_reg_df) WHERE coalesce(r, '') <> ''),
rows AS (
  SELECT proposal_id, row_id, doc_num, ts, 0 AS rank FROM facts JOIN ids ON own = proposal_id
  UNION ALL SELECT proposal_id, row_id, doc_num, ts, 1 FROM cites JOIN ids ON dst = proposal_id JOIN facts ON src = row_id
),
t AS (
  SELECT proposal_id, row_id, doc_num, ts, CASE WHEN {_norm('doc_num')} = proposal_id THEN 'Original Proposal' ELSE 'Reference' END AS reference_type
  FROM (SELECT *, row_number() OVER (PARTITION BY proposal_id, doc_num ORDER BY rank, row_id) AS r FROM rows) WHERE r = 1
)
"""


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, REGISTER).select(
        F.col("reg_id").alias("row_id"), "doc_num", F.col("ingest_ts").alias("ts"), F.col("extracted_doc_refs").alias("refs"), "people", "entities", "doc_type"
    )


def _timeline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _docs(spark, sf_dir)
    return timeline.build(load(spark, sf_dir, "proposals"), docs), docs


@query(_T + "SELECT * FROM t")
def j5_timeline(spark, sf_dir):
    return _timeline(spark, sf_dir)[0]


@query(
    "WITH r AS (SELECT DISTINCT reg_id, unnest(extracted_doc_refs) AS ref FROM utc_doc_reg_df) SELECT p.doc_num AS proposal_id, count(*) AS n_citing FROM "
    "(SELECT DISTINCT doc_num FROM proposals) p JOIN r ON r.ref = p.doc_num GROUP BY 1"
)
def j6_raw_citations(spark, sf_dir):
    edges = timeline.citation_edges(_docs(spark, sf_dir), normalize=False)
    return edges.join(load(spark, sf_dir, "proposals").select(F.col("doc_num").alias("dst")).distinct(), "dst").groupBy(F.col("dst").alias("proposal_id")).agg(F.count(F.lit(1)).alias("n_citing"))


_LIFE = (
    _T
    + f""", g AS (SELECT *, {_days("lag(ts) OVER (PARTITION BY proposal_id ORDER BY ts NULLS LAST, row_id)", "ts")} AS gap FROM t),
life AS (
  SELECT proposal_id, count(*) - 1 AS reference_count, {_days('min(ts)', 'max(ts)')} AS span_days, max(gap) AS max_dormancy_days, round(avg(gap), 6) AS mean_gap_days,
    round(stddev_samp(gap), 6) AS gap_sd, max(year(ts)) - min(year(ts)) + 1 - count(DISTINCT year(ts)) AS dormant_years,
    max(year(ts) * 12 + month(ts)) - min(year(ts) * 12 + month(ts)) + 1 - count(DISTINCT year(ts) * 12 + month(ts)) AS dormant_months, min(ts) AS first_ts, max(ts) AS last_ts
  FROM g GROUP BY proposal_id
)
"""
)


@query(
    _LIFE
    + "SELECT *, CASE WHEN span_days > 0 THEN round(reference_count / (span_days / 365.25::DOUBLE), 6) END AS velocity_per_year, "
    "CASE WHEN span_days > 0 THEN round(reference_count / (span_days / 30.44::DOUBLE), 6) END AS velocity_per_month FROM life"
)
def c2_lifecycle(spark, sf_dir):
    rounded = ["mean_gap_days", "gap_sd", "velocity_per_year", "velocity_per_month"]
    return timeline.lifecycle(_timeline(spark, sf_dir)[0]).withColumns({c: F.round(c, 6) for c in rounded})


@query(
    _T
    + f""", s AS (SELECT proposal_id, ts, {_days('min(ts) OVER w', 'max(ts) OVER w')} AS span, {_days('min(ts) OVER w', 'ts')} AS day FROM t WHERE ts IS NOT NULL WINDOW w AS (PARTITION BY proposal_id)),
p AS (SELECT proposal_id, span, CASE WHEN span > 0 THEN day / span::DOUBLE ELSE 0 END AS pos FROM s),
a AS (SELECT proposal_id, count(*) AS n, max(span) AS span, count(*) FILTER (pos <= 0.33::DOUBLE) AS early, count(*) FILTER (pos > 0.33::DOUBLE AND pos <= 0.67::DOUBLE) AS middle,
  count(*) FILTER (pos > 0.67::DOUBLE) AS late, round(avg(pos), 6) AS mean_position FROM p GROUP BY 1)
SELECT proposal_id, n, early, middle, late, mean_position, CASE WHEN n < 2 THEN 'insufficient_data' WHEN span <= 0 THEN 'single_day' WHEN early / n::DOUBLE > 0.5 THEN 'head_heavy'
  WHEN late / n::DOUBLE > 0.5 THEN 'tail_heavy' ELSE 'balanced' END AS pattern FROM a"""
)
def w5_positions(spark, sf_dir):
    return timeline.positions(_timeline(spark, sf_dir)[0]).withColumn("mean_position", F.round("mean_position", 6))


@query(
    _T
    + """, y AS (SELECT proposal_id, year(ts) AS year, count(*) AS documents FROM t WHERE ts IS NOT NULL GROUP BY 1, 2),
m AS (SELECT """
    + _norm("proposal_doc_num")
    + """ AS proposal_id, year, count(*) AS mails FROM email_match_df WHERE year IS NOT NULL AND """
    + _norm("proposal_doc_num")
    + """ IN (SELECT proposal_id FROM ids) GROUP BY 1, 2)
SELECT coalesce(y.proposal_id, m.proposal_id) AS proposal_id, coalesce(y.year, m.year) AS year, coalesce(documents, 0) AS documents, coalesce(mails, 0) AS mails
FROM y FULL JOIN m ON y.proposal_id = m.proposal_id AND y.year = m.year"""
)
def c4_yearly(spark, sf_dir):
    t, _ = _timeline(spark, sf_dir)
    ids = load(spark, sf_dir, "proposals").select(text.normal_id(F.col("doc_num")).alias("proposal_id")).filter("proposal_id <> ''").distinct()
    mails = load(spark, sf_dir, MATCHES).select(text.normal_id(F.col("proposal_doc_num")).alias("proposal_id"), "year").join(ids, "proposal_id", "left_semi")
    return timeline.yearly(t, mails)


_NAMED = _T + ", named AS (SELECT proposal_id, row_id, ts, name FROM t JOIN (SELECT row_id, unnest(people) AS name FROM facts) USING (row_id) WHERE trim(name, ' ') <> '')\n"


@query(
    _NAMED
    + """, e AS (SELECT proposal_id, count(DISTINCT name) AS unique_people FROM named GROUP BY 1)
SELECT t.proposal_id, count(*) - 1 AS reference_count, coalesce(max(unique_people), 0) AS unique_people FROM t LEFT JOIN e ON t.proposal_id = e.proposal_id GROUP BY 1"""
)
def c1_summary(spark, sf_dir):
    t, docs = _timeline(spark, sf_dir)
    people = timeline.members(t, docs, "people").groupBy("proposal_id").agg(F.count_distinct("name").alias("unique_people"))
    return t.groupBy("proposal_id").agg((F.count(F.lit(1)) - 1).alias("reference_count")).join(people, "proposal_id", "left").na.fill(0, ["unique_people"])


@query(
    _NAMED
    + ", f AS (SELECT proposal_id, name, min(year(ts)) AS year FROM named WHERE ts IS NOT NULL GROUP BY 1, 2) SELECT proposal_id, year, count(*) AS new_names FROM f GROUP BY 1, 2"
)
def w6_novelty(spark, sf_dir):
    t, docs = _timeline(spark, sf_dir)
    return timeline.novelty(timeline.members(t, docs, "people"))


@query(
    _NAMED
    + """, y AS (SELECT DISTINCT proposal_id, year(ts) AS y, name FROM named WHERE ts IS NOT NULL),
b AS (SELECT *, min(y) OVER (PARTITION BY proposal_id) AS f, max(y) OVER (PARTITION BY proposal_id) AS l FROM y),
n AS (SELECT proposal_id, name, bool_or(y = f) AS in_first, bool_or(y = l) AS in_last FROM b WHERE y = f OR y = l GROUP BY 1, 2)
SELECT proposal_id, count(*) FILTER (in_last AND NOT in_first) AS added, count(*) FILTER (in_first AND NOT in_last) AS lost FROM n GROUP BY 1"""
)
def w7_drift(spark, sf_dir):
    t, docs = _timeline(spark, sf_dir)
    return timeline.drift(timeline.members(t, docs, "people"))


@query(
    _NAMED
    + """, c AS (SELECT proposal_id, name, count(*) AS n FROM named GROUP BY 1, 2),
s AS (SELECT proposal_id, name, ts, row_id, row_number() OVER (PARTITION BY proposal_id, name ORDER BY ts NULLS LAST, row_id) AS k FROM named)
SELECT proposal_id, rank, name, n FROM (
  SELECT c.proposal_id, c.name, n, row_number() OVER (PARTITION BY c.proposal_id ORDER BY n DESC, ts NULLS LAST, row_id, c.name) AS rank
  FROM c JOIN s ON c.proposal_id = s.proposal_id AND c.name = s.name AND k = 1) WHERE rank <= 5"""
)
def o5_key_contributors(spark, sf_dir):
    t, docs = _timeline(spark, sf_dir)
    return timeline.top_names(timeline.members(t, docs, "people"))


@query(
    _T
    + f""", m AS (SELECT t.*, coalesce(list_contains(map_keys(doc_type), 'Meeting Documents'), false) AS meeting FROM t JOIN facts USING (row_id)),
o AS (SELECT proposal_id, min(ts) FILTER (reference_type <> 'Reference') AS start_ts,
  coalesce(max(ts) FILTER (reference_type = 'Reference' AND meeting), max(ts) FILTER (reference_type = 'Reference')) AS end_ts FROM m GROUP BY 1)
SELECT proposal_id, start_ts, end_ts, {_days('start_ts', 'end_ts')} AS days, CASE WHEN {_days('start_ts', 'end_ts')} > 0 AND {_days('start_ts', 'end_ts')} <= 1000 THEN 'normal' ELSE 'exception' END AS nature FROM o"""
)
def c9_outcomes(spark, sf_dir):
    return timeline.outcome_dates(*_timeline(spark, sf_dir))


@query(
    _T
    + "SELECT * FROM (SELECT proposal_id, doc_num, lead(doc_num) OVER (PARTITION BY proposal_id ORDER BY ts NULLS LAST, row_id) AS next_doc_num FROM t) WHERE next_doc_num IS NOT NULL"
)
def w8_path_edges(spark, sf_dir):
    return timeline.edges(_timeline(spark, sf_dir)[0])


# joins

_FIRST = "SELECT doc_num, min(ingest_ts) AS first_ts FROM utc_doc_reg_df WHERE doc_num IS NOT NULL GROUP BY 1"


@query(
    f"WITH b AS ({_FIRST}) SELECT b.doc_num, first_ts, (SELECT min(loaded_ts) FROM email_match_df m WHERE m.proposal_doc_num = b.doc_num AND loaded_ts > first_ts) AS next_ts FROM b"
)
def j11_next_mail(spark, sf_dir):
    base = load(spark, sf_dir, REGISTER).filter("doc_num IS NOT NULL").groupBy("doc_num").agg(F.min("ingest_ts").alias("first_ts"))
    mails = load(spark, sf_dir, MATCHES).select(F.col("proposal_doc_num").alias("doc_num"), "loaded_ts")
    return relate.next_after(base, mails, "doc_num", "first_ts", "loaded_ts")


@query("SELECT doc_num, proposal_title FROM proposals p WHERE EXISTS (SELECT 1 FROM utc_doc_reg_df r WHERE r.doc_num = p.doc_num)")
def j12_semi(spark, sf_dir):
    return load(spark, sf_dir, "proposals").select("doc_num", "proposal_title").join(load(spark, sf_dir, REGISTER).select("doc_num"), "doc_num", "left_semi")


@query("SELECT doc_num, proposal_title FROM proposals p WHERE NOT EXISTS (SELECT 1 FROM utc_doc_reg_df r WHERE r.doc_num = p.doc_num)")
def j13_anti(spark, sf_dir):
    return load(spark, sf_dir, "proposals").select("doc_num", "proposal_title").join(load(spark, sf_dir, REGISTER).select("doc_num"), "doc_num", "left_anti")


@query(
    "WITH a AS (SELECT affiliation AS k, count(*) AS n_people FROM contributors GROUP BY 1), b AS (SELECT proposer AS k, count(*) AS n_proposals FROM proposals GROUP BY 1) "
    "SELECT coalesce(a.k, b.k) AS k, n_people, n_proposals FROM a FULL JOIN b ON a.k IS NOT DISTINCT FROM b.k"
)
def j2_full_outer_null_safe(spark, sf_dir):
    a = load(spark, sf_dir, "contributors").groupBy(F.col("affiliation").alias("ka")).agg(F.count(F.lit(1)).alias("n_people"))
    b = load(spark, sf_dir, "proposals").groupBy(F.col("proposer").alias("kb")).agg(F.count(F.lit(1)).alias("n_proposals"))
    return a.join(b, F.col("ka").eqNullSafe(F.col("kb")), "full_outer").select(F.coalesce("ka", "kb").alias("k"), "n_people", "n_proposals")


@query(
    "WITH r AS (SELECT doc_num, subject, feed FROM (SELECT *, row_number() OVER (PARTITION BY doc_num ORDER BY reg_id) AS k FROM utc_doc_reg_df) WHERE k = 1) "
    "SELECT p.doc_num, proposal_title, subject, zone_name FROM proposals p LEFT JOIN r ON p.doc_num = r.doc_num LEFT JOIN feeds f ON r.feed = f.feed"
)
def j4_left_register(spark, sf_dir):
    first = timeline.first_by(load(spark, sf_dir, REGISTER).select("reg_id", "doc_num", "subject", "feed"), ["doc_num"], F.col("reg_id")).drop("reg_id")
    joined = load(spark, sf_dir, "proposals").select("doc_num", "proposal_title").join(first, "doc_num", "left")
    return joined.join(load(spark, sf_dir, "feeds").select("feed", "zone_name"), "feed", "left").select("doc_num", "proposal_title", "subject", "zone_name")


_PHRASES = "SELECT DISTINCT phrase FROM (SELECT proposal_for_1 AS phrase FROM proposals UNION ALL SELECT proposal_for_2 FROM proposals) WHERE trim(phrase, ' ') <> ''"
_HITS = f"""
WITH ph AS ({_PHRASES}),
w AS (SELECT phrase, string_split(trim(phrase, ' '), ' ') AS w FROM ph),
g AS (
  SELECT phrase, lower(trim(phrase, ' ')) AS gram FROM ph
  UNION ALL SELECT phrase, lower(array_to_string(w[i:i+1], ' ')) FROM (SELECT phrase, w, unnest(range(1, len(w))) AS i FROM w)
  UNION ALL SELECT phrase, lower(array_to_string(w[i:i+2], ' ')) FROM (SELECT phrase, w, unnest(range(1, len(w) - 1)) AS i FROM w)
),
gt AS (SELECT phrase, gram, count(*) AS times FROM g GROUP BY 1, 2),
x AS (SELECT match_id AS row_id, 'subject' AS field, lower(subject) AS txt FROM email_match_df UNION ALL SELECT match_id, 'summary', lower(summary) FROM email_match_df
  UNION ALL SELECT match_id, 'shortcodes', lower(array_to_string(pictograph_shortcodes, ' ')) FROM email_match_df),
dx AS (SELECT DISTINCT txt FROM x WHERE txt IS NOT NULL),
h AS (SELECT txt, gram FROM dx, (SELECT DISTINCT gram FROM gt) WHERE regexp_matches(txt, '(^|[^\\p{{L}}\\p{{N}}_])' || gram || '($|[^\\p{{L}}\\p{{N}}_])')),
s AS (SELECT phrase, row_id, sum(times) AS score FROM x JOIN h USING (txt) JOIN gt USING (gram) GROUP BY 1, 2)
"""


def _hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    proposals, mails = load(spark, sf_dir, "proposals"), load(spark, sf_dir, MATCHES)
    phrases = proposals.select(F.explode(F.array("proposal_for_1", "proposal_for_2")).alias("phrase")).filter(F.trim("phrase") != "")
    return relate.phrase_hits(phrases, _fields(mails))


def _fields(mails: DataFrame) -> DataFrame:
    texts = {"subject": F.col("subject"), "summary": F.col("summary"), "shortcodes": F.array_join("pictograph_shortcodes", " ")}
    return mails.select(F.col("match_id").alias("row_id"), F.inline(F.array(*(F.struct(F.lit(k).alias("field"), v.alias("text")) for k, v in texts.items()))))


@query(_HITS + "SELECT * FROM s")
def j8_phrase_hits(spark, sf_dir):
    return _hits(spark, sf_dir)


@query(
    _HITS
    + """, py AS (SELECT doc_num, phrase, CASE WHEN substr(doc_num, 4, 2)::INT < 50 THEN 2000 ELSE 1900 END + substr(doc_num, 4, 2)::INT AS py
  FROM (SELECT doc_num, proposal_for_1 AS phrase FROM proposals UNION SELECT doc_num, proposal_for_2 FROM proposals) WHERE trim(phrase, ' ') <> '' AND regexp_matches(doc_num, '^.{3}\\d{2}.')),
yearly AS (SELECT phrase, m.year, count(*) AS mails, sum(score) AS score FROM s JOIN email_match_df m ON s.row_id = m.match_id WHERE m.year IS NOT NULL GROUP BY 1, 2)
SELECT doc_num, sum(mails) AS n_hits, sum(score) AS total_score FROM py JOIN yearly ON py.phrase = yearly.phrase AND yearly.year BETWEEN py - 2 AND py + 2 GROUP BY 1"""
)
def j7_year_window(spark, sf_dir):
    """Hits of each proposal's phrases in mails at most two years apart; mails are counted per phrase and year before they meet proposals."""
    proposals, mails = load(spark, sf_dir, "proposals"), load(spark, sf_dir, MATCHES)
    phrases = F.explode(F.array_distinct(F.array("proposal_for_1", "proposal_for_2"))).alias("phrase")
    wanted = proposals.select("doc_num", text.id_year(F.col("doc_num")).alias("py"), phrases).filter((F.trim("phrase") != "") & F.col("py").isNotNull()).distinct()
    years = mails.filter("year IS NOT NULL").select(F.col("match_id").alias("row_id"), "year")
    yearly = _hits(spark, sf_dir).join(years, "row_id").groupBy("phrase", "year").agg(F.count(F.lit(1)).alias("mails"), F.sum("score").alias("score"))
    return relate.year_window(wanted, yearly, "py", "year", 2, ["phrase"]).groupBy("doc_num").agg(F.sum("mails").alias("n_hits"), F.sum("score").alias("total_score"))


@query(
    _HITS
    + f""", sf AS (SELECT phrase, row_id, field, sum(times) AS score FROM x JOIN h USING (txt) JOIN gt USING (gram) GROUP BY 1, 2, 3),
py AS (SELECT DISTINCT doc_num, phrase, CASE WHEN substr(doc_num, 4, 2)::INT < 50 THEN 2000 ELSE 1900 END + substr(doc_num, 4, 2)::INT AS py
  FROM (SELECT doc_num, proposal_for_1 AS phrase FROM proposals UNION ALL SELECT doc_num, proposal_for_2 FROM proposals) WHERE regexp_matches(doc_num, '^.{{3}}\\d{{2}}.')),
ph_hits AS (SELECT py.doc_num, sf.row_id, sf.field, sf.score FROM py JOIN sf ON py.phrase = sf.phrase JOIN email_match_df m ON sf.row_id = m.match_id WHERE m.year BETWEEN py - 2 AND py + 2),
refs AS (SELECT DISTINCT match_id, year, {_norm('r')} AS ref FROM (SELECT match_id, year, unnest(extracted_doc_refs) AS r FROM email_match_df)),
rf AS (SELECT DISTINCT py.doc_num, match_id AS row_id, 'reference' AS field, 1 AS score FROM (SELECT DISTINCT doc_num, py FROM py) py JOIN refs ON {_norm('py.doc_num')} = ref WHERE year BETWEEN py - 2 AND py + 2)
SELECT doc_num, row_id, sum(score) AS score, string_agg(DISTINCT field, '; ' ORDER BY field) AS match_types FROM (SELECT * FROM ph_hits UNION ALL SELECT * FROM rf) GROUP BY 1, 2"""
)
def j8_scored_matches(spark, sf_dir):
    """Mails at most two years from a proposal that name it: one point for each n-gram of its phrases in each field, and one for its number among their references."""
    proposals, mails = load(spark, sf_dir, "proposals"), load(spark, sf_dir, MATCHES)
    year = text.id_year(F.col("doc_num")).alias("py")
    dated = proposals.select("doc_num", year, F.explode(F.array_distinct(F.array("proposal_for_1", "proposal_for_2"))).alias("phrase")).filter(F.col("py").isNotNull()).distinct()
    years = mails.filter("year IS NOT NULL").select(F.col("match_id").alias("row_id"), "year")
    # spellings that differ by case have the same hits
    wanted = dated.filter(F.trim("phrase") != "").withColumn("phrase", F.lower("phrase"))
    hits = relate.phrase_field_hits(wanted.select("phrase"), _fields(mails)).join(years, "row_id")
    refs = mails.filter("year IS NOT NULL").select(F.col("match_id").alias("row_id"), "year", F.explode("extracted_doc_refs").alias("r")).select("row_id", "year", text.normal_id(F.col("r")).alias("ref")).distinct()
    numbers = dated.select("doc_num", "py", text.normal_id(F.col("doc_num")).alias("ref")).distinct()
    by_number = relate.year_window(numbers, refs, "py", "year", 2, ["ref"]).select("doc_num", "row_id").distinct()
    return relate.scored_window_pairs(wanted, hits, by_number, "reference")


@query(
    "WITH RECURSIVE e AS (SELECT doc_id AS id, lag(doc_id) OVER (PARTITION BY thread_key ORDER BY posted_ts NULLS LAST, doc_id) AS parent FROM documents WHERE thread_key IS NOT NULL "
    "UNION ALL SELECT doc_id, NULL FROM documents WHERE thread_key IS NULL), "
    "r AS (SELECT id, id AS root FROM e WHERE parent IS NULL UNION ALL SELECT e.id, r.root FROM e JOIN r ON e.parent = r.id) SELECT id, root FROM r"
)
def j17_thread_roots(spark, sf_dir):
    """The first document of each thread, by pointers to the one before: chains as long and uneven as the threads are."""
    docs = load(spark, sf_dir, "documents").select("doc_id", "thread_key", "posted_ts")
    before = F.lag("doc_id").over(Window.partitionBy("thread_key").orderBy(F.col("posted_ts").asc_nulls_last(), "doc_id"))
    return relate.roots(docs.select(F.col("doc_id").alias("id"), F.when(F.col("thread_key").isNotNull(), before).alias("parent")))


# labels, counts, shares

_FLAT = """
WITH e AS (SELECT reg_id, ingest_ts, feed, unnest(CASE WHEN coalesce(cardinality(doc_type), 0) > 0 THEN map_entries(doc_type) ELSE [{'key': 'Others/Miscellaneous', 'value': []::VARCHAR[]}] END) AS e FROM utc_doc_reg_df),
f AS (SELECT reg_id, ingest_ts, feed, e.key AS category, coalesce(s, '') AS subcategory FROM (
  SELECT reg_id, ingest_ts, feed, e, unnest(CASE WHEN len(coalesce(e.value, [])) > 0 THEN e.value ELSE [NULL] END) AS s FROM e))
"""


def _flat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return labels.flatten(load(spark, sf_dir, REGISTER), "doc_type", ["reg_id", "ingest_ts", "feed"])


@query(_FLAT + "SELECT reg_id, category, subcategory FROM f")
def pr16_flat_labels(spark, sf_dir):
    return _flat(spark, sf_dir).select("reg_id", "category", "subcategory")


@query(_FLAT + "SELECT year(ingest_ts) AS year, category, subcategory, count(*) AS n FROM f WHERE ingest_ts IS NOT NULL GROUP BY 1, 2, 3")
def a1_label_counts(spark, sf_dir):
    return _flat(spark, sf_dir).filter("ingest_ts IS NOT NULL").groupBy(F.year("ingest_ts").alias("year"), "category", "subcategory").agg(F.count(F.lit(1)).alias("n"))


@query(
    _FLAT
    + "SELECT feed, category, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY feed), 6) AS pct FROM f GROUP BY 1, 2"
)
def a4_share_within(spark, sf_dir):
    return labels.shares(_flat(spark, sf_dir), ["feed", "category"], ["feed"]).withColumn("pct", F.round("pct", 6))


@query(
    "SELECT year(ingest_ts) AS year, count(*) FILTER (pictograph_relevant) AS relevant, count(*) FILTER (NOT pictograph_relevant) AS irrelevant, count(*) FILTER (pictograph_relevant IS NULL) AS unknown "
    "FROM utc_doc_reg_df WHERE ingest_ts IS NOT NULL GROUP BY 1"
)
def a6_pivot(spark, sf_dir):
    kind = F.when(F.col("pictograph_relevant"), "relevant").when(~F.col("pictograph_relevant"), "irrelevant").otherwise("unknown")
    rows = load(spark, sf_dir, REGISTER).filter("ingest_ts IS NOT NULL").select(F.year("ingest_ts").alias("year"), kind.alias("kind"))
    return rows.groupBy("year").pivot("kind", ["relevant", "irrelevant", "unknown"]).count().na.fill(0)


@query(
    "WITH y AS (SELECT year(ingest_ts) AS year, count(*) AS n, count(*) FILTER (pictograph_relevant) AS k FROM utc_doc_reg_df WHERE ingest_ts IS NOT NULL GROUP BY 1), "
    "p AS (SELECT year, n, round_even(100.0::DOUBLE * k / n, 1) AS pct FROM y) SELECT year, n, pct, round(pct - lag(pct) OVER (ORDER BY year), 6) AS change FROM p"
)
def w2_year_over_year(spark, sf_dir):
    per = load(spark, sf_dir, REGISTER).filter("ingest_ts IS NOT NULL").groupBy(F.year("ingest_ts").alias("year")).agg(F.count(F.lit(1)).alias("n"), F.count_if("pictograph_relevant").alias("k"))
    pct = per.select("year", "n", F.bround(100.0 * F.col("k") / F.col("n"), 1).alias("pct"))
    return labels.year_over_year(pct, "year", "pct", []).withColumn("change", F.round("change", 6))


@query("SELECT reg_id, row_number() OVER (ORDER BY ingest_ts, reg_id) AS cumulative FROM utc_doc_reg_df WHERE ingest_ts IS NOT NULL")
def w1_cumulative(spark, sf_dir):
    rows = load(spark, sf_dir, REGISTER).filter("ingest_ts IS NOT NULL").select("reg_id", "ingest_ts", F.lit(1).alias("one"))
    return prefix.running_totals(rows, ["ingest_ts", "reg_id"], {"cumulative": "one"}).select("reg_id", "cumulative")


@query(
    "WITH s AS (SELECT source, pictograph_relevant FROM documents_x), a AS (SELECT DISTINCT source FROM s WHERE pictograph_relevant AND source IS NOT NULL), b AS (SELECT DISTINCT source FROM s WHERE NOT pictograph_relevant AND source IS NOT NULL) "
    "SELECT count(*) FILTER (b.source IS NULL) AS only_a, count(*) FILTER (a.source IS NOT NULL AND b.source IS NOT NULL) AS both, count(*) FILTER (a.source IS NULL) AS only_b, "
    "count(*) FILTER (a.source IS NOT NULL AND b.source IS NOT NULL)::DOUBLE / count(*) FILTER (a.source IS NOT NULL) AS recall, "
    "count(*) FILTER (a.source IS NOT NULL AND b.source IS NOT NULL)::DOUBLE / count(*) FILTER (b.source IS NOT NULL) AS precision FROM a FULL JOIN b ON a.source = b.source".replace("documents_x", "utc_doc_reg_df")
)
def u4_overlap(spark, sf_dir):
    r = load(spark, sf_dir, REGISTER).select("source", "pictograph_relevant")
    return relate.overlap(r.filter("pictograph_relevant"), r.filter("NOT pictograph_relevant"), "source")


@query(
    _FLAT
    + "SELECT * FROM (SELECT category, subcategory, n, row_number() OVER (PARTITION BY category ORDER BY n DESC, subcategory) AS rank FROM (SELECT category, subcategory, count(*) AS n FROM f GROUP BY 1, 2)) WHERE rank <= 2"
)
def o4_top_per_group(spark, sf_dir):
    counted = _flat(spark, sf_dir).groupBy("category", "subcategory").agg(F.count(F.lit(1)).alias("n"))
    return labels.top_per_group(counted, ["category"], 2, "subcategory")


@query(
    _FLAT
    + """, tf AS (SELECT feed FROM f GROUP BY 1 ORDER BY count(*) DESC, feed LIMIT 3), tc AS (SELECT category FROM f GROUP BY 1 ORDER BY count(*) DESC, category LIMIT 3)
SELECT tf.feed, tc.category, (SELECT count(*) FROM f WHERE f.feed = tf.feed AND f.category = tc.category) AS n FROM tf, tc"""
)
def a11_top_crosstab(spark, sf_dir):
    """Counts of the three greatest feeds by the three greatest categories, zeros included."""
    flat = _flat(spark, sf_dir).groupBy("feed", "category").agg(F.count(F.lit(1)).alias("n"))
    top = lambda c: flat.groupBy(c).agg(F.sum("n").alias("k")).orderBy(F.desc("k"), c).limit(3).select(c)
    grid = top("feed").withColumn("one", F.lit(1)).join(top("category").withColumn("one", F.lit(1)), "one").drop("one")
    return grid.join(flat, ["feed", "category"], "left").na.fill(0, ["n"])


@query("SELECT min(month) AS peak_month, n FROM (SELECT month(ingest_ts) AS month, count(*) AS n, max(count(*)) OVER () AS top FROM utc_doc_reg_df WHERE ingest_ts IS NOT NULL GROUP BY 1) WHERE n = top GROUP BY n")
def a24_peak_month(spark, sf_dir):
    per = load(spark, sf_dir, REGISTER).filter("ingest_ts IS NOT NULL").groupBy(F.month("ingest_ts").alias("month")).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.max_by("month", F.struct("n", (-F.col("month")).alias("m"))).alias("peak_month"), F.max("n").alias("n"))


@query("SELECT term, n FROM (SELECT w AS term, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(summary), '[\\p{L}\\p{N}_]{5,}')) AS w FROM utc_doc_reg_df) WHERE w NOT IN ('about', 'which', 'their', 'there', 'these') GROUP BY 1) ORDER BY n DESC, term LIMIT 30")
def a15_terms(spark, sf_dir):
    words = load(spark, sf_dir, REGISTER).select(F.explode(F.regexp_extract_all(F.lower("summary"), F.lit(r"[\p{L}\p{N}_]{5,}"), F.lit(0))).alias("term"))
    kept = words.filter(~F.col("term").isin("about", "which", "their", "there", "these"))
    return kept.groupBy("term").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "term").limit(30)


@query(
    "SELECT year, count(*) AS n, count(DISTINCT month) AS active_months, round(count(*) / count(DISTINCT month)::DOUBLE, 6) AS per_active_month FROM email_match_df WHERE year IS NOT NULL AND month IS NOT NULL GROUP BY 1"
)
def a18_volume_rates(spark, sf_dir):
    per = load(spark, sf_dir, MATCHES).filter("year IS NOT NULL AND month IS NOT NULL").groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("month").alias("active_months"))
    return per.withColumn("per_active_month", F.round(F.col("n") / F.col("active_months"), 6))


_METRICS = (
    "WITH l AS (SELECT pictograph_relevant, 'confidence_score' AS metric, confidence_score::DOUBLE AS value FROM email_match_df UNION ALL SELECT pictograph_relevant, 'people', len(people)::DOUBLE FROM email_match_df) "
)


def _mail_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, MATCHES).select("pictograph_relevant", "confidence_score", F.when(F.col("people").isNotNull(), F.size("people")).alias("people"))


@query(
    _METRICS
    + "SELECT metric, pictograph_relevant AS relevant, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS sd, median(value) AS median FROM l WHERE value IS NOT NULL AND pictograph_relevant IS NOT NULL GROUP BY 1, 2"
)
def a16_cohort_stats(spark, sf_dir):
    return cohorts.cohort_stats(_mail_metrics(spark, sf_dir), ["confidence_score", "people"], "pictograph_relevant").withColumns({c: F.round(c, 6) for c in ("mean", "sd")}).withColumnRenamed("pictograph_relevant", "relevant")


@query(
    "WITH x AS (SELECT confidence_score AS v, pictograph_relevant AS a, rank() OVER (ORDER BY confidence_score) + (count(*) OVER (PARTITION BY confidence_score) - 1) / 2.0 AS r FROM email_match_df "
    "WHERE confidence_score IS NOT NULL AND pictograph_relevant IS NOT NULL), t AS (SELECT sum(k * k * k - k) AS ties FROM (SELECT count(*)::DOUBLE AS k FROM x GROUP BY v)) "
    "SELECT count(*) FILTER (a) AS n_a, count(*) FILTER (NOT a) AS n_b, sum(r) FILTER (a)::DOUBLE - count(*) FILTER (a) * (count(*) FILTER (a) + 1) / 2.0::DOUBLE AS u_a, (SELECT ties FROM t) AS tie_term FROM x"
)
def st1_rank_sum(spark, sf_dir):
    return cohorts.rank_sum(load(spark, sf_dir, MATCHES), "confidence_score", "pictograph_relevant").select("n_a", "n_b", "u_a", "tie_term")


@query()
def st1_p_value(spark, sf_dir):
    return cohorts.rank_sum(load(spark, sf_dir, MATCHES), "confidence_score", "pictograph_relevant")


# dedupe, sets, projections


@query("SELECT doc_num, reg_id, subject FROM (SELECT *, row_number() OVER (PARTITION BY doc_num ORDER BY ingest_ts NULLS LAST, reg_id) AS r FROM utc_doc_reg_df WHERE doc_num IS NOT NULL) WHERE r = 1")
def pr11_first_by_key(spark, sf_dir):
    rows = load(spark, sf_dir, REGISTER).filter("doc_num IS NOT NULL").select("doc_num", "reg_id", "subject", "ingest_ts")
    return timeline.first_by(rows, ["doc_num"], F.col("ingest_ts").asc_nulls_last(), F.col("reg_id")).drop("ingest_ts")


@query(
    "SELECT doc_num, origin FROM (SELECT *, row_number() OVER (PARTITION BY doc_num ORDER BY origin DESC) AS r FROM (SELECT DISTINCT doc_num, 'proposals' AS origin FROM proposals UNION ALL SELECT doc_num, 'carryover' FROM register_carryover)) WHERE r = 1"
)
def pr12_prefer_source(spark, sf_dir):
    both = load(spark, sf_dir, "proposals").select("doc_num", F.lit("proposals").alias("origin")).distinct()
    both = both.unionByName(load(spark, sf_dir, "register_carryover").select("doc_num", F.lit("carryover").alias("origin")))
    return timeline.first_by(both, ["doc_num"], F.desc("origin"))


@query("SELECT doc_num FROM proposals INTERSECT SELECT doc_num FROM utc_doc_reg_df")
def u3_intersect(spark, sf_dir):
    return load(spark, sf_dir, "proposals").select("doc_num").intersect(load(spark, sf_dir, REGISTER).select("doc_num"))


@query("SELECT doc_num FROM proposals EXCEPT SELECT doc_num FROM utc_doc_reg_df")
def u3_difference(spark, sf_dir):
    return load(spark, sf_dir, "proposals").select("doc_num").subtract(load(spark, sf_dir, REGISTER).select("doc_num"))


@query(
    "SELECT reg_id AS row_id, feed, ingest_ts AS ts, NULL::INT AS confidence_score FROM utc_doc_reg_df UNION ALL SELECT match_id, feed, loaded_ts, confidence_score FROM email_match_df"
)
def u1_union_by_name(spark, sf_dir):
    r = load(spark, sf_dir, REGISTER).select(F.col("reg_id").alias("row_id"), "feed", F.col("ingest_ts").alias("ts"))
    m = load(spark, sf_dir, MATCHES).select(F.col("match_id").alias("row_id"), "feed", F.col("loaded_ts").alias("ts"), "confidence_score")
    return r.unionByName(m, allowMissingColumns=True)


# text and dates

_REFS = "list_sort(list_distinct([regexp_replace(x, '[‐–—−]', '-', 'g') for x in regexp_extract_all(coalesce(text, ''), 'L2/\\d{2}[-‐–—−]\\d{3,}')]))"


@query(
    f"SELECT doc_id, array_to_string({_REFS}, ',') AS refs, coalesce({_REFS}[1], '') AS first_ref, array_to_string(list_sort(list_distinct(regexp_extract_all(coalesce(text, ''), ':([a-z0-9_\\-+]+):', 1))), ',') AS shortcodes, "
    "array_to_string(list_sort(list_distinct(list_concat(regexp_extract_all(coalesce(text, ''), '[Uu]\\+([0-9A-F]{4,6})', 1), regexp_extract_all(coalesce(text, ''), 'code[\\s-]?point[\\s:]+([0-9A-F]{4,6})', 1), "
    "regexp_extract_all(coalesce(text, ''), '\\\\u([0-9A-F]{4,6})', 1), regexp_extract_all(coalesce(text, ''), '&#x([0-9A-F]{4,6});', 1), regexp_extract_all(coalesce(text, ''), '\\\\x\\{([0-9A-F]{4,6})\\}', 1)))), ',') AS code_points FROM documents"
)
def f7_mined(spark, sf_dir):
    t = F.col("text")
    refs = text.mined_refs(t)
    return load(spark, sf_dir, "documents").select(
        "doc_id", F.array_join(refs, ",").alias("refs"), F.coalesce(F.get(refs, F.lit(0)), F.lit("")).alias("first_ref"), F.array_join(text.shortcodes(t), ",").alias("shortcodes"),
        F.array_join(text.code_points(t), ",").alias("code_points"),
    )


@query(
    f"SELECT match_id, {_norm('proposal_doc_num')} AS normal_id, CASE WHEN length(proposal_doc_num) >= 6 AND regexp_matches(substr(proposal_doc_num, 4, 2), '^\\d{{2}}$') "
    "THEN CASE WHEN substr(proposal_doc_num, 4, 2)::INT < 50 THEN 2000 ELSE 1900 END + substr(proposal_doc_num, 4, 2)::INT END AS id_year FROM email_match_df"
)
def f9_normal_ids(spark, sf_dir):
    return load(spark, sf_dir, MATCHES).select("match_id", text.normal_id(F.col("proposal_doc_num")).alias("normal_id"), text.id_year(F.col("proposal_doc_num")).alias("id_year"))


def _kw_sql(column: str, words: list[str]) -> str:
    return f"regexp_matches({column}, '(?i)(^|[^\\p{{L}}\\p{{N}}_])(" + "|".join(re.escape(w).replace("\\ ", " ").replace("\\#", "#").replace("\\-", "-") for w in words) + ")($|[^\\p{L}\\p{N}_])')"


def _classify_sql() -> str:
    parts = [
        f"SELECT reg_id, '{cat}' AS category, '{sub}' AS subcategory FROM utc_doc_reg_df WHERE {_kw_sql('subject', words)}"
        for cat, subs in text.DOCUMENT_TYPES.items()
        for sub, words in subs.items()
    ]
    hit = " UNION ALL ".join(parts)
    return f"WITH h AS ({hit}) SELECT * FROM h UNION ALL SELECT reg_id, 'Others/Miscellaneous', '' FROM utc_doc_reg_df WHERE reg_id NOT IN (SELECT reg_id FROM h)"


@query(_classify_sql())
def f2_classified(spark, sf_dir):
    return labels.flatten(load(spark, sf_dir, REGISTER).select("reg_id", text.classify(F.col("subject")).alias("labels")), "labels", ["reg_id"])


@query(f"SELECT reg_id, CASE WHEN {_kw_sql('subject', text.SUBJECT_KEYWORDS)} THEN '{text.RELEVANT}' ELSE '{text.IRRELEVANT}' END AS relevance FROM utc_doc_reg_df")
def f3_relevance(spark, sf_dir):
    return load(spark, sf_dir, REGISTER).select("reg_id", text.relevance(F.col("subject")).alias("relevance"))


@query(
    "SELECT doc_id, array_to_string(list_filter([" + ", ".join(f"CASE WHEN {_kw_sql('text', [k])} THEN '{k}' END" for k in text.TEXT_KEYWORDS) + "], lambda x: x IS NOT NULL), ',') AS hits FROM documents"
)
def f4_keyword_hits(spark, sf_dir):
    return load(spark, sf_dir, "documents").select("doc_id", F.array_join(F.coalesce(text.keyword_hits(F.col("text")), F.array().cast("array<string>")), ",").alias("hits"))


_TAIL = rf"(?i)(\s*\[{text.WORD} proposal\]|(\s+unicode)?\s+{text.WORD}( proposal)?)$"


@query(
    f"WITH b AS (SELECT doc_num, proposal_title AS t, regexp_replace(proposal_title, '{_TAIL}', '') AS bare FROM proposals) SELECT doc_num, trim(CASE "
    f"WHEN regexp_matches(bare, '(?i)^proposal for {text.WORD}[:\\s-]\\s*.') THEN regexp_replace(bare, '(?i)^proposal for {text.WORD}[:\\s-]\\s*', '') "
    "WHEN bare <> t THEN regexp_replace(bare, '(?i)^proposal for\\s+', '') ELSE t END, ' ') AS subject FROM b"
)
def f27_proposed(spark, sf_dir):
    return load(spark, sf_dir, "proposals").select("doc_num", text.proposed_subject(F.col("proposal_title")).alias("subject"))


@query(
    "SELECT event_id, year(ts) || '-Q' || quarter(ts) AS quarter, strftime(ts, '%Y-%m') AS month, CASE WHEN length(props) > 8 THEN substr(props, 1, 8) || '...' ELSE props END AS short FROM events"
)
def f37_calendar(spark, sf_dir):
    return load(spark, sf_dir, "events").select(
        "event_id", dates.quarter_label(F.col("ts")).alias("quarter"), F.date_format("ts", "yyyy-MM").alias("month"), text.cut_text(F.col("props"), 8).alias("short")
    )


@query(
    f"WITH f AS ({_FIRST}), w AS (SELECT doc_num, withdrawn_ts FROM register_withdrawals) SELECT r.doc_num, {_days('m.first_ts', 'r.withdrawn_ts')} AS days FROM w r JOIN (SELECT proposal_doc_num AS doc_num, min(loaded_ts) AS first_ts FROM email_match_df GROUP BY 1) m ON r.doc_num = m.doc_num"
)
def f38_whole_days(spark, sf_dir):
    mails = load(spark, sf_dir, MATCHES).groupBy(F.col("proposal_doc_num").alias("doc_num")).agg(F.min("loaded_ts").alias("first_ts"))
    return load(spark, sf_dir, "register_withdrawals").join(mails, "doc_num").select("doc_num", dates.whole_days(F.col("first_ts"), F.col("withdrawn_ts")).alias("days"))


@query(
    "SELECT match_id, CASE WHEN trim(from_name, ' ') <> '' AND trim(from_email, ' ') <> '' THEN trim(from_name, ' ') || ' <' || trim(from_email, ' ') || '>' ELSE coalesce(nullif(trim(from_name, ' '), ''), nullif(trim(from_email, ' '), ''), '') END AS sender FROM email_match_df"
)
def f50_sender(spark, sf_dir):
    return load(spark, sf_dir, MATCHES).select("match_id", text.display_sender(F.col("from_name"), F.col("from_email")).alias("sender"))


@query(
    _T
    + "SELECT proposal_id, '# ' || proposal_id || chr(10) || string_agg('- ' || coalesce(strftime(ts, '%Y-%m-%d'), 'undated') || ' ' || doc_num, chr(10) ORDER BY ts NULLS LAST, row_id) AS report FROM t GROUP BY 1"
)
def r1_reports(spark, sf_dir):
    """A Markdown timeline per proposal."""
    t, _ = _timeline(spark, sf_dir)
    line = F.concat(F.lit("- "), F.coalesce(F.date_format("ts", "yyyy-MM-dd"), F.lit("undated")), F.lit(" "), F.col("doc_num"))
    per = t.groupBy("proposal_id").agg(F.array_sort(F.collect_list(F.struct(F.col("ts").isNull().alias("u"), "ts", "row_id", line.alias("line")))).alias("rows"))
    return per.select("proposal_id", F.concat(F.lit("# "), "proposal_id", F.lit("\n"), F.array_join(F.transform("rows", lambda r: r["line"]), "\n")).alias("report"))
