import pytest

from docketflow.llm import confusables

DOCS = "doc_id bigint, text string, form string, raw string"
SAME = [
    ["Résumé of L2/16-007", "Résumé of L2/16-007", "Ｒésumé of L2/16-007", "Résumé of L2/16‑007", "Rés​umé of　L2/16-007", "R­ésumé ﻿of L2/16-007", "Résumé оf L2/16-007"],
    ["ガイド Ω µm", "ｶﾞｲﾄﾞ Ω μm", "ガイド Ω μm"],
    ["👩‍💻 x", "👩‍💻​ x", "👩‍💻 х"],
    ["a; b", "a; b"],
]
APART = ["x² 2", "x2 2", "ﬁn", "fin", "👩💻 x", "resume", "Resume", "résume", "½", "1/2", "a – b", "a — b", "a - b", "ℵ", "א", "\u0261o", "go", "1\ufe0f\u20e3", "1\u20e3"]
APART += ["\U0001f3f4" + "".join(chr(0xE0000 + ord(c)) for c in code) + "\U000e007f" for code in ("gbeng", "gbsct")]


def _pairs(spark, texts):
    df = spark.createDataFrame([(k, t, "clash", "clash") for k, t in enumerate(texts)], DOCS)
    return {(r[0], r[1]) for r in confusables.comparable_pairs(df).collect()}


def test_groups(spark):
    texts = [t for g in SAME for t in g] + APART + [None, "", " ", " \n", "　"]
    group = [k for k, g in enumerate(SAME) for _ in g]
    n = len(group)
    expected = {(a, b) for a in range(n) for b in range(a + 1, n) if group[a] == group[b]}
    assert _pairs(spark, texts) == expected


def test_copies_are_no_pairs(spark):
    texts = ["same"] * 500 + ["sаme"] * 2 + ["other"] * 3
    assert _pairs(spark, texts) == {(a, b) for a in range(500) for b in (500, 501)}
    df = spark.createDataFrame([(k, t, None, None) for k, t in enumerate(texts)], DOCS)
    assert {(r["n_spellings"]) for r in confusables.membership(df).filter("doc_id < 502").collect()} == {2}


def test_long_and_empty(spark):
    assert _pairs(spark, ["a" * 300_000, "а" + "a" * 299_999]) == {(0, 1)}
    assert _pairs(spark, []) == set()


@pytest.mark.parametrize("text", ["'quoted' \\1 $x %", "plain"])
def test_form_of_plain_text_is_itself(spark, text):
    assert confusables.consistent_texts(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).first()["form"] == text
