import math

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docketflow.operators import hot_keys

SCHEMA = "k string, who string, v double, value string, n string"


def _profile(spark, data, **kw):
    df = spark.createDataFrame([(*r, "clash", "clash") for r in data], SCHEMA)
    return {r["key"]: r for r in hot_keys.key_profiles(df, F.col("k"), F.col("who"), F.col("v"), **kw).collect()}


def _expected(values, q):
    s = sorted(values)
    return s[max(1, math.ceil(q * len(s) - 1e-9)) - 1] if s else None


def test_against_sorting(spark):
    data = [("hot", f"s{k % 7}", float((k * 7919) % 1009) / 8) for k in range(4000)] + [(f"c{k % 50}", None if k % 5 else "x", None if k % 4 == 0 else float(k % 3)) for k in range(300)]
    data += [(None, "x", 1.0), ("none", None, None), ("one", "a", 5.0), ("nan", "a", float("nan")), ("nan", "a", float("inf")), ("nan", "a", -2.0)]
    got = _profile(spark, data)
    assert None not in got
    for key in {d[0] for d in data} - {None}:
        own = [d for d in data if d[0] == key]
        values = [d[2] for d in own if d[2] is not None and math.isfinite(d[2])]
        r = got[key]
        assert r["n_rows"] == len(own)
        assert r["n_items"] == len({d[1] for d in own} - {None})
        assert [r["q25"], r["median"], r["q75"]] == [_expected(values, q) for q in (0.25, 0.5, 0.75)]
        assert r["heavy"] == (len(own) >= 0.02 * (len(data) - 1))
    assert got["hot"]["heavy"] and not got["one"]["heavy"]


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(-1e6, 1e6, allow_nan=False), min_size=1, max_size=60))
def test_any_values(spark, values):
    r = _profile(spark, [("k", None, v) for v in values])["k"]
    assert [r["q25"], r["median"], r["q75"]] == [_expected(values, q) for q in (0.25, 0.5, 0.75)]


def test_empty(spark):
    assert _profile(spark, []) == {}
