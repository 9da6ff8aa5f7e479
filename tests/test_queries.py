"""Every core query with SQL gives the rows of its SQL; the others run."""

import pytest

import __spark_entry__ as entry
from tests.oracle import canonical, connect


def _names():
    from docketflow.plans import pipeline_queries, proposal_queries, reference_queries, source_queries, sql_queries, text_queries

    return [n for m in (pipeline_queries, reference_queries, proposal_queries, text_queries, source_queries, sql_queries) for n in m.QUERIES]


@pytest.mark.parametrize("name", _names())
def test_query(spark, data, name):
    got = entry.queries()[name](spark, data).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql is None:
        assert len(got.columns)
    else:
        assert canonical(got) == canonical(connect(data).execute(sql).df())


def test_entry(spark, data):
    assert entry.entry(spark).columns == ["tab", "row_id", "ref_doc_num", "kind"]


def test_dictionary_of_an_earlier_run(spark, data):
    """Two runs with one dictionary give what one run gives."""
    q = entry.queries()
    assert canonical(q["p4_incremental"](spark, data).toPandas()) == canonical(q["p4_instants"](spark, data).toPandas())


def test_reports(spark, data):
    q = entry.queries()
    reports = q["r1_full_reports"](spark, data).toPandas()
    listed = q["c1_full_summary"](spark, data).toPandas().set_index("proposal_id")
    assert len(reports) == len(listed)
    for proposal, report in zip(reports["proposal_id"], reports["report"]):
        assert report.startswith(f"# {proposal} ") and "## Documents" in report and "## Mails" in report
        assert report.count("\n### ") == listed["reference_count"][proposal] + (listed["date_first"][proposal] == listed["date_first"][proposal])
        assert (f"Mails: {listed['email_count'][proposal]}" in report) == (listed["email_count"][proposal] > 0)
    assert {s for s in q["r3_index"](spark, data).toPandas()["section"] if s != "top"} == {p[:5] for p in q["c11_ranked"](spark, data).toPandas()["proposal_id"]}
    assert q["r4_cohort_report"](spark, data).first()["report"].count("\n") == 1 + q["a16_tested"](spark, data).count()
