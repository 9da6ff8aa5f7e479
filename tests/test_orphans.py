from datetime import datetime as D

import pytest

from docketflow.operators import orphans

REG = "reg_id bigint, doc_num string, extracted_doc_refs array<string>, ingest_ts timestamp_ntz, ref string, kind string"
KEY = "doc_num string, withdrawn_ts timestamp_ntz"


def _known(spark, register, carryover=(), withdrawn=()):
    return orphans.targets(
        spark.createDataFrame(register, REG),
        spark.createDataFrame([(x, None) for x in carryover], KEY),
        spark.createDataFrame([(x, None) for x in withdrawn], KEY),
    )


REGISTER = [
    (1, "L2/20-001", ["L2/20-001", "see UTC l2 / 20–002R3.", None, "", "L2/TBD", "L2/19-777", "L2/19-777R"], D(2020, 1, 5), "x", "y"),
    (2, "L2/20-002R", ["L2/20-003", "L2/18-009"], D(2020, 1, 9), None, None),
    (2, "L2/20-002R", None, D(2020, 1, 7), None, None),
    (3, None, [], None, None, None),
    (4, "L2/20-004", ["L2/20-002"], None, None, None),
]


@pytest.mark.parametrize("share", [0.001, 0.4])
def test_kinds(spark, rows, share):
    register = spark.createDataFrame(REGISTER, REG)
    refs = orphans.references(register, "r", "reg_id", "extracted_doc_refs", "ingest_ts")
    found = orphans.orphan_rows(refs, _known(spark, REGISTER, ["L2/18-009"], ["L2/20-003", "L2/18-009"]), share)
    assert rows(found) == [("r", 1, "L2/19-777", "missing"), ("r", 1, "L2/20-002", "late"), ("r", 2, "L2/20-003", "withdrawn")]


@pytest.mark.parametrize("share", [0.001, 0.3])
def test_heavy_keys_and_counts(spark, rows, share):
    """A third of the references share one missing key; counts agree with the rows."""
    many = [(k, f"L2/21-{k % 97:03d}", ["L2/09-500"] if k % 3 == 0 else [f"L2/21-{k % 150:03d}"], D(2021, 1 + k % 12, 1 + k % 28), None, None) for k in range(3000)]
    register = spark.createDataFrame(many, REG)
    refs = orphans.references(register, "r", "reg_id", "extracted_doc_refs", "ingest_ts")
    known = _known(spark, many)
    found = orphans.orphan_rows(refs, known, share).collect()
    first = {}
    for _, number, _, ts, _, _ in many:
        first[number] = min(ts, first.get(number, ts))
    expected = sorted((k, r[0], "late" if r[0] in first else "missing") for k, _, r, ts, _, _ in many if r[0] not in first or first[r[0]] > ts)
    assert sorted((r[1], r[2], r[3]) for r in found) == expected
    counts = orphans.orphan_counts(refs, known, share).collect()
    by_kind = {}
    for r in counts:
        by_kind[r["kind"]] = by_kind.get(r["kind"], 0) + r["n_refs"]
    assert by_kind == {k: sum(x[2] == k for x in expected) for k in {x[2] for x in expected}}


def test_empty(spark):
    register = spark.createDataFrame([], REG)
    refs = orphans.references(register, "r", "reg_id", "extracted_doc_refs", "ingest_ts")
    assert orphans.orphan_rows(refs, _known(spark, [])).count() == 0
    assert orphans.orphan_counts(refs, _known(spark, [])).count() == 0
