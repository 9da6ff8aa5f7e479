import random

import numpy as np
import pytest

from docketflow.llm import mixing

DOCS = "doc_id bigint, source string, text string, n_tokens string, label string"
TARGETS = "source string, target_share double, max_repeats int"
WORDS = {"mail": "reply thread list subject wrote", "minutes": "meeting agenda motion carried adjourned", "forms": "applicant glyph submit frequency image"}


def _corpus(n, seed=0, unlabelled=0.1):
    rng, rows, truth = random.Random(seed), [], {}
    for k in range(n):
        source = rng.choices(list(WORDS), [6, 3, 1])[0]
        truth[k] = source
        text = " ".join(rng.choice(WORDS[source].split()) for _ in range(rng.randrange(5, 120)))
        rows.append((k, None if rng.random() < unlabelled else source, text, "clash", "clash"))
    return rows, truth


def test_shares_and_repeats(spark):
    rows, _ = _corpus(4000)
    rows += [(10_000, "mail", None, None, None), (10_001, "mail", "", None, None), (10_002, "elsewhere", "reply thread list " * 30, None, None), (10_003, None, "é" * 100_000, None, None)]
    docs = spark.createDataFrame(rows, DOCS)
    targets = spark.createDataFrame([("mail", 0.4, 1), ("minutes", 0.35, 2), ("forms", 0.25, 3), ("absent", 0.0, 2)], TARGETS)
    drawn = mixing.mix(docs, targets).collect()
    most = {"mail": 1, "minutes": 2, "forms": 3}
    assert len({r["doc_id"] for r in drawn}) == len(drawn)
    assert all(1 <= r["draws"] <= most[r["drawn_as"]] for r in drawn)
    assert not {10_000, 10_001} & {r["doc_id"] for r in drawn}
    report = {r["source"]: r for r in mixing.shares_report(mixing.mix(docs, targets), targets).collect()}
    for source, share in (("mail", 0.4), ("minutes", 0.35), ("forms", 0.25)):
        assert abs(report[source]["reached_share"] - share) < 0.02
    assert report["absent"]["tokens"] == 0
    # the scarcest source is used up
    assert any(report[s]["most_used"] == most[s] for s in most)


def test_classifier_on_held_out_documents(spark):
    rows, truth = _corpus(1500, 5, unlabelled=0.3)
    docs = spark.createDataFrame(rows, DOCS)
    sources = sorted(WORDS)
    members = mixing.memberships(docs, sources, mixing.fit_sources(docs, sources)).filter("label IS NULL").collect()
    right = sum(sources[int(np.argmax(r["member"]))] == truth[r["doc_id"]] for r in members)
    assert len(members) > 300 and right / len(members) > 0.95


@pytest.mark.parametrize("rows", [[], [(1, None, "some text", None, None)]])
def test_little_data(spark, rows):
    targets = spark.createDataFrame([("mail", 1.0, 1)], TARGETS)
    drawn = mixing.mix(spark.createDataFrame(rows, DOCS), targets)
    assert drawn.count() <= len(rows)
    assert mixing.mix(spark.createDataFrame(rows, DOCS), targets.limit(0)).count() == 0


def _mixed_members(spark, seed, concentration, n=3000, k=8):
    """Skewed sources, a third of the documents without label and of mixed membership."""
    rng = np.random.default_rng(seed)
    often = 0.6 ** np.arange(k) / (0.6 ** np.arange(k)).sum()
    label = rng.choice(k, n, p=often)
    p, unlabelled = np.eye(k)[label], rng.random(n) < 0.33
    p[unlabelled] = [rng.dirichlet(concentration * k * (0.5 * often + 0.5 * np.eye(k)[c])) for c in label[unlabelled]]
    p = p.astype(np.float32).astype(float)
    tokens = np.exp(rng.normal(5, 1.2, n)).astype(int) + 1
    rows = [(i, None, int(tokens[i]), None if u else int(label[i]), p[i].tolist() if u else None) for i, u in enumerate(unlabelled)]
    return spark.createDataFrame(rows, mixing.MEMBER).coalesce(4), p, tokens, rng.integers(1, 5, k).astype(float)


@pytest.mark.parametrize(("seed", "concentration", "reachable"), [(4, 0.03, True), (3, 0.2, False)])
def test_fit_goes_on_while_least_squares_fall(spark, seed, concentration, reachable):
    """A source at its repeat cap doesn't end the fit for the others; the end is the tolerance or the least sum of squares."""
    members, p, tokens, most = _mixed_members(spark, seed, concentration)
    shares = np.full(len(most), 1 / len(most))
    start, steps = mixing.fit_rates(members, shares, most)
    cap, stock = most[p.argmax(1)], tokens @ p
    size = ((cap * tokens) @ p / shares).min()
    residual = lambda w: (w * tokens) @ p - shares * size
    squares = lambda w: float((residual(w) ** 2 / stock).sum())
    reached = mixing._rates(p, most, start, steps)
    sums = [squares(mixing._rates(p, most, start, steps[:i])) for i in range(len(steps) + 1)]
    assert all(b < a for a, b in zip(sums, sums[1:]))
    if reachable:
        assert np.abs(residual(reached)).max() <= 1e-4 * size
    else:
        w = np.clip(p @ start, 0, cap)
        for _ in range(3000):  # plain steps come to the least sum from above
            w = np.clip(w - p @ (residual(w) / stock), 0, cap)
        assert squares(reached) <= squares(w) * (1 + 1e-9)
