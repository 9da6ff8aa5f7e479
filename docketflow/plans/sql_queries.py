"""Aggregations, reshaping and small joins as SQL that Spark and DuckDB read alike; ``{table}`` stands for a table.

Where the dialects differ, the DuckDB form is given beside it.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from docketflow.sources.tables import in_tables, load

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _add(name: str, sql: str, duck: str | None = None) -> None:
    names = sorted(set(re.findall(r"\{(\w+)\}", sql)))

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return spark.sql(sql, **{t: load(spark, sf_dir, t) for t in names})

    run.__name__ = name
    QUERIES[name], SQL[name] = run, in_tables(re.sub(r"\{(\w+)\}", r"\1", duck or sql))


# projections and filters
_add("pr1_dropna", "SELECT reg_id, doc_num, source FROM {utc_doc_reg_df} WHERE doc_num IS NOT NULL AND source IS NOT NULL")
_add("pr3_year_range", "SELECT match_id, year FROM {email_match_df} WHERE year BETWEEN 2013 AND 2016")
_add("pr4_date_window", "SELECT reg_id FROM {utc_doc_reg_df} WHERE ingest_ts >= timestamp_ntz'2013-01-01 00:00:00' AND ingest_ts <= timestamp_ntz'2015-12-31 00:00:00'",
     "SELECT reg_id FROM {utc_doc_reg_df} WHERE ingest_ts >= TIMESTAMP '2013-01-01 00:00:00' AND ingest_ts <= TIMESTAMP '2015-12-31 00:00:00'")
_add("pr5_any_flag", "SELECT reg_id FROM {utc_doc_reg_df} WHERE coalesce(pictograph_relevant, false) OR coalesce(is_pictograph_relevant, false)")
_add("pr6_has_label", "SELECT reg_id, coalesce(map_contains_key(doc_type, 'Meeting Documents'), false) AS meeting FROM {utc_doc_reg_df}",
     "SELECT reg_id, coalesce(list_contains(map_keys(doc_type), 'Meeting Documents'), false) AS meeting FROM {utc_doc_reg_df}")
_add("pr13_distinct_pairs", "SELECT DISTINCT feed, file_extension FROM {utc_doc_reg_df}")
_add("pr17_split_list", "SELECT reg_id, trim(s) AS part FROM (SELECT reg_id, explode(split(source, ',')) AS s FROM {utc_doc_reg_df}) WHERE trim(s) <> ''",
     "SELECT reg_id, trim(s, ' ') AS part FROM (SELECT reg_id, unnest(string_split(source, ',')) AS s FROM {utc_doc_reg_df}) WHERE trim(s, ' ') <> ''")
_add("pr18_struct_columns", "SELECT reg_id, token_usage.prompt_tokens, token_usage.completion_tokens, token_usage.total_tokens FROM {utc_doc_reg_df}")
_add("pr20_era", "SELECT match_id, CASE WHEN loaded_ts < timestamp_ntz'2017-01-01 00:00:00' THEN 'pre_2017' ELSE 'post_2017' END AS era FROM {email_match_df} WHERE loaded_ts IS NOT NULL",
     "SELECT match_id, CASE WHEN loaded_ts < TIMESTAMP '2017-01-01 00:00:00' THEN 'pre_2017' ELSE 'post_2017' END AS era FROM {email_match_df} WHERE loaded_ts IS NOT NULL")
# joins
_add("j1_left_fixed", "SELECT r.reg_id, f.zone_name FROM {utc_doc_reg_df} r LEFT JOIN {feeds} f ON r.feed = f.feed")
_add("j3_counts_with_metadata", "SELECT c.proposal_doc_num, c.n, p.proposal_title FROM (SELECT proposal_doc_num, count(*) AS n FROM {email_match_df} WHERE proposal_doc_num IS NOT NULL GROUP BY 1) c LEFT JOIN {proposals} p ON c.proposal_doc_num = p.doc_num")
_add("j14_authors", "SELECT p.doc_num, count(DISTINCT r.source) AS n_sources FROM {proposals} p JOIN {utc_doc_reg_df} r ON p.doc_num = r.doc_num GROUP BY 1")
_add("j15_first_title", "SELECT m.match_id, p.title FROM {email_match_df} m JOIN (SELECT doc_num, min(proposal_title) AS title FROM {proposals} GROUP BY 1) p ON m.proposal_doc_num = p.doc_num")
_add("j16_aligned_months", "SELECT coalesce(a.m, b.m) AS month, coalesce(a.n, 0) AS documents, coalesce(b.n, 0) AS mails FROM (SELECT month(ingest_ts) AS m, count(*) AS n FROM {utc_doc_reg_df} WHERE ingest_ts IS NOT NULL GROUP BY 1) a FULL JOIN (SELECT month AS m, count(*) AS n FROM {email_match_df} WHERE month IS NOT NULL GROUP BY 1) b ON a.m = b.m")
# aggregates and reshaping
_add("a3_source_years", "SELECT feed, year(ingest_ts) AS year, count(*) AS n, sum(count(*)) OVER (PARTITION BY feed) AS total FROM {utc_doc_reg_df} WHERE ingest_ts IS NOT NULL GROUP BY feed, year(ingest_ts)")
_add("a5_top_sources_by_pair", "SELECT * FROM (SELECT feed, file_extension, year, n, row_number() OVER (PARTITION BY feed, file_extension ORDER BY n DESC, year) AS r FROM (SELECT feed, file_extension, year(ingest_ts) AS year, count(*) AS n FROM {utc_doc_reg_df} WHERE ingest_ts IS NOT NULL GROUP BY 1, 2, 3)) WHERE r <= 3")
_add("a7_unpivot", "SELECT reg_id, what, n FROM (SELECT reg_id, token_usage.prompt_tokens AS prompt, token_usage.completion_tokens AS completion FROM {utc_doc_reg_df}) UNPIVOT (n FOR what IN (prompt, completion))")
_add("a10_value_counts", "SELECT match_type, count(*) AS n FROM {email_match_df} GROUP BY 1")
_add("a12_distinct_members", "SELECT feed, count(DISTINCT p) AS n_people FROM (SELECT feed, explode(people) AS p FROM {utc_doc_reg_df}) WHERE p IS NOT NULL GROUP BY 1",
     "SELECT feed, count(DISTINCT p) AS n_people FROM (SELECT feed, unnest(people) AS p FROM {utc_doc_reg_df}) WHERE p IS NOT NULL GROUP BY 1")
_add("a13_date_range", "SELECT feed, min(ingest_ts) AS first_ts, max(ingest_ts) AS last_ts FROM {utc_doc_reg_df} GROUP BY 1")
_add("a14_counts_without", "SELECT proposal_doc_num, count(*) AS n FROM {email_match_df} m WHERE NOT EXISTS (SELECT 1 FROM {register_withdrawals} w WHERE w.doc_num = m.proposal_doc_num) AND proposal_doc_num IS NOT NULL GROUP BY 1")
_add("a17_strata", "SELECT coalesce(match_type, 'overall') AS stratum, count(*) AS n, round(avg(confidence_score), 6) AS mean FROM {email_match_df} WHERE match_type IS NOT NULL GROUP BY GROUPING SETS ((match_type), ())")
_add("a19_composition", "SELECT year, count(*) AS n, round(100.0D * sum(CASE WHEN pictograph_relevant THEN 1 ELSE 0 END) / count(*), 6) AS pct FROM {email_match_df} WHERE year IS NOT NULL GROUP BY 1",
     "SELECT year, count(*) AS n, round(100.0::DOUBLE * sum(CASE WHEN pictograph_relevant THEN 1 ELSE 0 END) / count(*), 6) AS pct FROM {email_match_df} WHERE year IS NOT NULL GROUP BY 1")
_add("a22_mail_confidence", "SELECT proposal_doc_num, round(avg(confidence_score), 6) AS mean, max(confidence_score) AS most, min(loaded_ts) AS first_ts, max(loaded_ts) AS last_ts FROM {email_match_df} WHERE proposal_doc_num IS NOT NULL GROUP BY 1")
_add("a23_token_totals", "SELECT feed, sum(token_usage.total_tokens) AS tokens FROM {utc_doc_reg_df} GROUP BY 1")
_add("a25_mails_per_year", "SELECT year, count(*) AS n FROM {email_match_df} GROUP BY 1")
_add("a26_categories_of_proposal", "SELECT p.doc_num, array_join(array_sort(collect_set(c)), ',') AS categories FROM {proposals} p JOIN (SELECT doc_num, explode(map_keys(doc_type)) AS c FROM {utc_doc_reg_df}) r ON p.doc_num = r.doc_num GROUP BY 1",
     "SELECT p.doc_num, string_agg(DISTINCT c, ',' ORDER BY c) AS categories FROM {proposals} p JOIN (SELECT doc_num, unnest(map_keys(doc_type)) AS c FROM {utc_doc_reg_df}) r ON p.doc_num = r.doc_num GROUP BY 1")
# windows, top-k, sets
_add("w9_forward_fill", "SELECT match_id, last_value(proposal_for_2) IGNORE NULLS OVER (PARTITION BY proposal_doc_num ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM {email_match_df} WHERE proposal_doc_num IS NOT NULL",
     "SELECT match_id, last_value(proposal_for_2 IGNORE NULLS) OVER (PARTITION BY proposal_doc_num ORDER BY match_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM {email_match_df} WHERE proposal_doc_num IS NOT NULL")
_add("o3_top_ten", "SELECT doc_id, n_chars FROM {documents} WHERE n_chars IS NOT NULL ORDER BY n_chars DESC, doc_id LIMIT 10")
_add("o7_top_years", "SELECT year, n FROM (SELECT year, count(*) AS n FROM {email_match_df} WHERE year IS NOT NULL GROUP BY 1) ORDER BY n DESC, year LIMIT 10")
_add("u2_labelled_union", "SELECT * FROM (SELECT 'relevant' AS cohort, feed, count(*) AS n FROM {utc_doc_reg_df} WHERE pictograph_relevant GROUP BY feed ORDER BY n DESC, feed LIMIT 3) UNION ALL SELECT * FROM (SELECT 'other' AS cohort, feed, count(*) AS n FROM {utc_doc_reg_df} WHERE NOT pictograph_relevant GROUP BY feed ORDER BY n DESC, feed LIMIT 3)")
_add("u6_year_spine", "SELECT DISTINCT y FROM (SELECT year(ingest_ts) AS y FROM {utc_doc_reg_df} UNION SELECT year FROM {email_match_df}) WHERE y IS NOT NULL")
_add("c10_summary", "SELECT coalesce(cast(pictograph_relevant AS STRING), 'unknown') AS cohort, count(*) AS documents, count(DISTINCT source) AS sources, count(DISTINCT feed) AS feeds, min(year(ingest_ts)) AS first_year, max(year(ingest_ts)) AS last_year, round(avg(file_size_kb), 6) AS mean_kb FROM {utc_doc_reg_df} GROUP BY 1")
# text
_add("f18_stripped", r"SELECT reg_id, length(regexp_replace(subject, '[\\x00-\\x08\\x0B\\x0C\\x0E-\\x1F\\x7F-\\x9F]', '')) AS n FROM {utc_doc_reg_df}",
     r"SELECT reg_id, length(regexp_replace(subject, '[\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F]', '', 'g'))::INT AS n FROM {utc_doc_reg_df}")
_add("f20_mail_address", "SELECT match_id, replace(trim(from_email), '_at_', '@') AS address FROM {email_match_df}", "SELECT match_id, replace(trim(from_email, ' '), '_at_', '@') AS address FROM {email_match_df}")
_add("f25_extension", r"SELECT reg_id, lower(regexp_extract(coalesce(doc_url, ''), '\\.([^./]+)$', 1)) AS extension FROM {utc_doc_reg_df}", r"SELECT reg_id, lower(regexp_extract(coalesce(doc_url, ''), '\.([^./]+)$', 1)) AS extension FROM {utc_doc_reg_df}")
_add("f46_joined_members", "SELECT reg_id, array_join(array_sort(array_distinct(people)), ', ') AS people FROM {utc_doc_reg_df} WHERE people IS NOT NULL",
     "SELECT reg_id, array_to_string(list_sort(list_distinct(people)), ', ') AS people FROM {utc_doc_reg_df} WHERE people IS NOT NULL")
