import itertools
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa

from docketflow.llm import cooccurrence

SCHEMA = "doc_num string, people array<string>, entities array<string>, item string, code string, n bigint"


def _expected(data, least, share):
    records = defaultdict(set)
    for doc, people, entities in data:
        if doc is not None:
            records[doc] |= {x.strip() for x in (*(people or ()), *(entities or ())) if x and x.strip()}
    n, one, two = len(records), Counter(), Counter()
    for items in records.values():
        one.update(items)
        two.update(itertools.combinations(sorted(items), 2))
    return {(a, b, one[a], one[b], k, n) for (a, b), k in two.items() if k >= least and k >= share * n}


def _got(spark, data, **kw):
    df = spark.createDataFrame([(*d, "clash", "clash", 1) for d in data], SCHEMA)
    return cooccurrence.item_pairs(df, "doc_num", ["people", "entities"], **kw)


def test_against_brute_force(spark):
    rng = random.Random(1)
    names = [f"n{k}" for k in range(25)] + ["Zoë", "😀", "ﬁ"]
    data = [(f"d{k % 300}", [rng.choice(names) for _ in range(rng.randrange(6))] + ["hot"] * (k % 3 == 0), [None, " ", "", " org ", "org"][: rng.randrange(6)]) for k in range(400)]
    data += [(None, ["n1", "n2"], None), ("e", None, None), ("long", ["x" * 100_000, "n1"], None)]
    found = {(r["item_a"], r["item_b"], r["n_a"], r["n_b"], r["n_ab"], r["n_records"]) for r in _got(spark, data).collect()}
    assert found == _expected(data, 3, 0.003)
    assert len({(a, b) for a, b, *_ in found}) == len(found)


def test_odds_ratio(spark):
    data = [("1", ["a", "b"], None), ("2", ["a", "b"], None), ("3", ["a"], None), ("4", ["c"], None), ("5", None, None)]
    r = next(r for r in _got(spark, data, min_records=1, min_share=0).collect() if r["item_b"] == "b")
    assert (r["n_a"], r["n_b"], r["n_ab"], r["n_records"]) == (3, 2, 2, 5)
    assert abs(r["odds_ratio"] - 2.5 * 2.5 / (1.5 * 0.5)) < 1e-9 and abs(r["lift"] - 2 * 5 / 6) < 1e-9


def test_runs_over_batches():
    codes = np.array([1, 1, 2, 2, 2, 5, 5, 9])
    batches = [pa.RecordBatch.from_arrays([pa.array(codes[a:b], pa.int64())], names=["code"]) for a, b in ((0, 1), (1, 3), (3, 3), (3, 7), (7, 8))]
    out = [x for b in cooccurrence._runs(iter(batches)) for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
    assert out == [(1, 2), (2, 3), (5, 2), (9, 1)]


def test_empty(spark):
    assert _got(spark, []).count() == 0
    assert _got(spark, [("a", ["x"], None), ("b", None, [])]).count() == 0


def test_least_counts_leave_no_pair_uncounted(spark, monkeypatch):
    """Pairs of rare items are counted too; the least counts choose among the counted pairs."""
    data = [(f"d{k}", [f"rare{k}", f"rare{k // 2}", "hot", "warm"], [f"one{k}"]) for k in range(40)]
    counted, count_codes = [], cooccurrence.count_codes
    monkeypatch.setattr(cooccurrence, "count_codes", lambda codes: counted.append(count_codes(codes)) or counted[-1])
    found = {(r["item_a"], r["item_b"], r["n_a"], r["n_b"], r["n_ab"], r["n_records"]) for r in _got(spark, data, min_records=3, min_share=0.5).collect()}
    assert found == _expected(data, 3, 0.5) == {("hot", "warm", 40, 40, 40, 40)}
    every = _expected(data, 1, 0)
    assert sorted(r["n"] for r in counted[0].collect()) == sorted(k for *_, k, _ in every)
