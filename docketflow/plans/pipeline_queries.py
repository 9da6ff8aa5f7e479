"""Queries of the core operators for training-data pipelines (problems 2, 3, 4 and 7)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.functions.docnum import doc_number
from docketflow.operators import hot_keys, instants, orphans, packed_values
from docketflow.runtime import fresh_path
from docketflow.sources.tables import load

REGISTER, MATCHES = "utc_doc_reg_df", "email_match_df"
#: The directory of contributors is a fixed table; its bodies' names are constants of the split.
MAX_NAMES = 10_000


def _references(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    register = load(spark, sf_dir, REGISTER)
    refs = orphans.references(register, REGISTER, "reg_id", "extracted_doc_refs", "ingest_ts").unionByName(
        orphans.references(load(spark, sf_dir, MATCHES), MATCHES, "match_id", "proposal_doc_num", "loaded_ts")
    )
    known = orphans.targets(register, load(spark, sf_dir, "register_carryover"), load(spark, sf_dir, "register_withdrawals"))
    return refs, known


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_rows(*_references(spark, sf_dir))


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return orphans.orphan_counts(*_references(spark, sf_dir))


def p3_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, distinct senders, mean and exact quartiles of the score per proposal; ``heavy`` from 2 % of all rows.

    A sender is the e-mail address, else the name, in lower case; blank ones are none.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.lower(F.trim(c)))
    sender = F.coalesce(blank(F.col("from_email")), blank(F.col("from_name")))
    return hot_keys.key_profiles(load(spark, sf_dir, MATCHES), doc_number(F.col("proposal_doc_num")), sender, F.col("confidence_score")).select(
        F.col("key").alias("doc_num"), "n_rows", F.col("n_items").alias("n_senders"), F.col("mean_value").alias("mean_confidence"), "q25", "median", "q75", "heavy"
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_profiles(spark, sf_dir).filter("heavy").select("doc_num")


def _dated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        load(spark, sf_dir, REGISTER)
        .select(F.lit(REGISTER).alias("tab"), F.col("reg_id").alias("row_id"), F.col("date").alias("text"), "feed")
        .unionByName(load(spark, sf_dir, MATCHES).select(F.lit(MATCHES).alias("tab"), F.col("match_id").alias("row_id"), F.col("date").alias("text"), "feed"))
    )


def p4_instants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The instant of every row, null where its text denotes none or several."""
    return instants.normalise(_dated(spark, sf_dir), load(spark, sf_dir, "feeds")).select("tab", "row_id", "utc_micros")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = instants.normalise(_dated(spark, sf_dir), load(spark, sf_dir, "feeds"))
    plain = F.col("text").rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$")
    return done.filter(F.col("utc_micros").isNotNull() & ~plain).select("tab", "row_id", "utc_micros")


def p4_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As p4_instants, in two runs with one dictionary: the register's texts are parsed by the first, the second parses only the matches' new ones."""
    rows, feeds, path = _dated(spark, sf_dir), load(spark, sf_dir, "feeds"), fresh_path(spark, "instants")
    first = instants.normalise(rows.filter(F.col("tab") == REGISTER), feeds, path)
    first.write.format("noop").mode("overwrite").save()
    return instants.normalise(rows, feeds, path).select("tab", "row_id", "utc_micros")


def body_names(spark: SparkSession, sf_dir: str) -> list[str]:
    """Names of the bodies in the directory, a fixed table; refuses one that has grown out of bounds."""
    rows = load(spark, sf_dir, "contributors").filter((F.col("kind") == "org") & F.col("full_name").isNotNull()).select("full_name").limit(MAX_NAMES + 1).collect()
    if len(rows) > MAX_NAMES:
        raise ValueError(f"more than {MAX_NAMES} listed bodies")
    return sorted(r[0] for r in rows)


def p7_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of every source, also where there is only one."""
    return packed_values.explode_values(load(spark, sf_dir, REGISTER), "reg_id", "source", body_names(spark, sf_dir)).select(
        F.col("row_id").alias("reg_id"), "pos", "item"
    )


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values = packed_values.explode_values(load(spark, sf_dir, REGISTER), "reg_id", "source", body_names(spark, sf_dir))
    return values.filter("n_values > 1").select(F.col("row_id").alias("reg_id"), "pos", "item")


QUERIES = {f.__name__: f for f in (p2_found, p2_counts, p3_found, p3_profiles, p4_found, p4_instants, p4_incremental, p7_found, p7_values)}

_NUM = r"[Ll]2\s*/\s*(\d{2})\s*[\-\x{2010}-\x{2015}\x{2212}\x{fe58}\x{fe63}\x{ff0d}]\s*(\d{3,})"


def _num(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '{_NUM}') THEN 'L2/' || regexp_extract({x}, '{_NUM}', 1) || '-' || regexp_extract({x}, '{_NUM}', 2) END"


_ORPHANS = f"""
WITH refs AS (
  SELECT DISTINCT 'utc_doc_reg_df' AS tab, reg_id AS row_id, {_num('r')} AS ref, ts
  FROM (SELECT reg_id, ingest_ts AS ts, unnest(extracted_doc_refs) AS r FROM utc_doc_reg_df)
  UNION ALL
  SELECT 'email_match_df', match_id, {_num('proposal_doc_num')}, loaded_ts FROM email_match_df
),
reg AS (SELECT {_num('doc_num')} AS ref, min(ingest_ts) AS first_ts FROM utc_doc_reg_df GROUP BY 1),
car AS (SELECT DISTINCT {_num('doc_num')} AS ref FROM register_carryover),
wd AS (SELECT DISTINCT {_num('doc_num')} AS ref FROM register_withdrawals),
found AS (
  SELECT refs.tab, refs.row_id, refs.ref AS ref_doc_num, refs.ts,
    CASE WHEN car.ref IS NOT NULL THEN NULL
         WHEN reg.ref IS NOT NULL THEN CASE WHEN reg.first_ts > refs.ts THEN 'late' END
         WHEN wd.ref IS NOT NULL THEN 'withdrawn' ELSE 'missing' END AS kind
  FROM refs LEFT JOIN reg ON refs.ref = reg.ref LEFT JOIN car ON refs.ref = car.ref LEFT JOIN wd ON refs.ref = wd.ref
  WHERE refs.ref IS NOT NULL
)
"""

_PROFILES = f"""
WITH rows AS (
  SELECT {_num('proposal_doc_num')} AS doc_num, CAST(confidence_score AS DOUBLE) AS v,
    coalesce(nullif(lower(trim(from_email, ' ')), ''), nullif(lower(trim(from_name, ' ')), '')) AS sender
  FROM email_match_df
),
kept AS (SELECT * FROM rows WHERE doc_num IS NOT NULL),
agg AS (SELECT doc_num, count(*) AS n_rows, count(DISTINCT sender) AS n_senders, avg(v) AS mean_confidence, count(v) AS n FROM kept GROUP BY doc_num),
ranked AS (SELECT doc_num, v, row_number() OVER (PARTITION BY doc_num ORDER BY v) AS r FROM kept WHERE v IS NOT NULL),
q AS (
  SELECT a.doc_num,
    max(CASE WHEN r = greatest(1, CAST(ceil(0.25 * n - 1e-9) AS BIGINT)) THEN v END) AS q25,
    max(CASE WHEN r = greatest(1, CAST(ceil(0.5 * n - 1e-9) AS BIGINT)) THEN v END) AS median,
    max(CASE WHEN r = greatest(1, CAST(ceil(0.75 * n - 1e-9) AS BIGINT)) THEN v END) AS q75
  FROM agg a JOIN ranked k ON a.doc_num = k.doc_num GROUP BY a.doc_num
),
done AS (
  SELECT a.doc_num, n_rows, n_senders, mean_confidence, q25, median, q75,
    n_rows >= 0.02 * (SELECT count(*) FROM kept) AS heavy
  FROM agg a LEFT JOIN q ON a.doc_num = q.doc_num
)
"""

SQL = {
    "p2_found": _ORPHANS + "SELECT tab, row_id, ref_doc_num, kind FROM found WHERE kind IS NOT NULL",
    "p2_counts": _ORPHANS
    + "SELECT tab, strftime(ts, '%Y-%m') AS month, kind, count(*) AS n_refs, count(DISTINCT ref_doc_num) AS n_numbers FROM found WHERE kind IS NOT NULL GROUP BY 1, 2, 3",
    "p3_found": _PROFILES + "SELECT doc_num FROM done WHERE heavy",
    "p3_profiles": _PROFILES + "SELECT * FROM done",
}
