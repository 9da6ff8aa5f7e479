from collections import Counter, defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docketflow.llm import packing
from docketflow.llm.tokens import VOCABULARY, token_ids

DOCS = "doc_id bigint, text string, part string, k string, n_tokens string"


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(0, 50), st.integers(1, 40), max_size=30), st.integers(50, 80), st.integers(1, 30))
def test_histogram_plan(histogram, capacity, block):
    patterns = packing.pack_histogram(histogram, capacity)
    assert len(patterns) <= 2 * max(1, len(histogram))
    assert all(space == capacity - sum(length * k for length, k in times.items()) >= 0 for _, space, times in patterns)
    placed = Counter()
    for count, _, times in patterns:
        for length, k in times.items():
            placed[length] += k * count
    assert placed == Counter({length: n for length, n in histogram.items() if length})
    rows, sizes, opened = packing.rank_ranges(histogram, capacity, block)
    used, free = Counter(), {}
    for length, n in histogram.items():
        met = 0
        for rank in range(n):
            of_block = [r for r in rows if r[:2] == (length, rank // sizes[length])]
            met += len(of_block)
            ((_, _, first, _, container, boxes, space),) = [r for r in of_block if r[2] <= rank < r[2] + r[3]]
            box = container + (rank - first) % boxes
            used[box] += length
            free[box] = space
        assert met <= 4 * n
    assert set(used) <= set(range(opened)) and all(capacity - used[box] == space for box, space in free.items())


LIMITS = [(1, 16), (2, 64)]


def _check(spark, texts, block=packing.BLOCK):
    df = spark.createDataFrame([(k, t, "clash", "clash", "clash") for k, t in enumerate(texts)], DOCS).repartition(3)
    rows = packing.pack(packing.count_tokens(df), LIMITS, block).collect()
    tokens = [len(token_ids(t, VOCABULARY)) if t else 0 for t in texts]
    for limit, capacity in LIMITS:
        own = [r for r in rows if r["limit_id"] == limit]
        per_doc, boxes, free = Counter(), Counter(), {}
        pieces = defaultdict(set)
        for r in own:
            per_doc[r["doc_id"]] += r["piece_tokens"]
            boxes[r["container_id"]] += r["piece_tokens"]
            assert free.setdefault(r["container_id"], r["unused_tokens"]) == r["unused_tokens"]
            assert r["piece"] not in pieces[r["doc_id"]]
            pieces[r["doc_id"]].add(r["piece"])
        assert per_doc == Counter(dict(enumerate(tokens))) and set(pieces) == set(range(len(texts)))
        assert all(capacity - boxes[c] == free[c] >= 0 for c in boxes)
        assert all(len(p) == 1 or tokens[d] > capacity for d, p in pieces.items())
    return rows


@pytest.mark.parametrize("block", [1, packing.BLOCK])
def test_documents(spark, block):
    texts = ["one two three " * (k % 9) for k in range(200)] + ["same text"] * 150 + [None, "", " ", "word " * 5000, " a" * 16, " a" * 32, "퟿‍ é"]
    rows = _check(spark, texts, block)
    # ids are numbered without gaps
    for limit, _ in LIMITS:
        ids = {r["container_id"] for r in rows if r["limit_id"] == limit}
        assert ids == set(range(len(ids)))


def test_only_empty_texts_and_none(spark):
    assert {r["container_id"] for r in _check(spark, ["", None])} == {0}
    assert {r["container_id"] for r in _check(spark, ["", None, "", "", ""], 1)} == {0}
    assert _check(spark, []) == []


def test_only_oversize_and_empty(spark):
    """The rest of each is nothing, so that empty texts have the one shared container."""
    rows = _check(spark, [" a" * 128, " a" * 192, "", None])
    assert {r["container_id"] for r in rows if r["limit_id"] == 2} == set(range(6))
    assert {r["container_id"] for r in rows if r["piece_tokens"] == 0} == {0}


def test_plan_has_no_join_but_equi_joins(spark):
    df = spark.createDataFrame([(1, "one two", "", "", "")], DOCS)
    plan = packing.pack(packing.count_tokens(df), LIMITS)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_long_text_in_pieces():
    text = ("Some words, and  blanks\n\n 12345 — naïve 😀 " * 400).strip()
    assert token_ids(text, VOCABULARY, piece=1000) == token_ids(text, VOCABULARY)
