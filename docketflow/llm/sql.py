"""DuckDB SQL for the queries of this package that SQL can express."""

from docketflow.llm.confusables import digest_sql

# DuckDB has the same functions as the operator's embedded query; the letters of the public data don't occur in the tables
_FORMS = f"WITH f AS ({digest_sql({}, 'documents')})"

_PAIRS = """
WITH cells AS (
  SELECT doc_num, unnest(people) AS item FROM utc_doc_reg_df
  UNION ALL SELECT doc_num, unnest(entities) FROM utc_doc_reg_df
),
single AS (
  SELECT DISTINCT doc_num, regexp_replace(item, '^\\s+|\\s+$', '', 'g') AS item
  FROM cells WHERE doc_num IS NOT NULL AND item IS NOT NULL AND regexp_replace(item, '^\\s+|\\s+$', '', 'g') <> ''
),
n AS (SELECT count(DISTINCT doc_num) AS n_records FROM utc_doc_reg_df WHERE doc_num IS NOT NULL),
one AS (SELECT item, count(*) AS k FROM single GROUP BY item),
two AS (
  SELECT a.item AS item_a, b.item AS item_b, count(*) AS n_ab
  FROM single a JOIN single b ON a.doc_num = b.doc_num AND a.item < b.item GROUP BY 1, 2
),
done AS (
  SELECT item_a, item_b, a.k AS n_a, b.k AS n_b, n_ab, n_records,
    CAST(n_ab AS DOUBLE) * n_records / a.k / b.k AS lift,
    (n_ab + 0.5::DOUBLE) * (n_records - a.k - b.k + n_ab + 0.5::DOUBLE) / ((a.k - n_ab + 0.5::DOUBLE) * (b.k - n_ab + 0.5::DOUBLE)) AS odds_ratio
  FROM two JOIN one a ON item_a = a.item JOIN one b ON item_b = b.item, n
  WHERE n_ab >= 3 AND n_ab >= 0.003 * n_records
)
"""

SQL = {
    "p1_found": _PAIRS + "SELECT item_a, item_b FROM done WHERE n_ab * n_records >= 5 * n_a * n_b",
    "p1_pairs": _PAIRS + "SELECT * FROM done",
    "p10_found": _FORMS + " SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM f a JOIN f b ON a.form = b.form AND a.raw <> b.raw AND a.doc_id < b.doc_id",
    "p10_forms": _FORMS + " SELECT doc_id, form AS form_class, count(DISTINCT raw) OVER (PARTITION BY form) AS n_spellings FROM f",
}
