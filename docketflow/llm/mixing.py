"""Mixing sources to target weights (problem 9).

Soft-membership mixing: a classifier fitted on labelled documents gives each
document its probabilities of the sources. A recorded source is evidence beside
the text: ``trust`` is the weight of it, the classifier's posterior has the rest.
With the default of 1 a labelled document belongs to its source and posteriors
serve the others, as shares are asked for by recorded source. Distributed projected-gradient least squares
then fits a rate per document, between zero and the greatest number of uses, so
that the expected tokens per source meet the targets. The steps are scaled by
the tokens of each document and source, so that documents of equal membership
keep equal rates whatever their length. Rates become whole numbers of uses by
carrying what is owed in tokens from the longest document to the shortest.

Only the classifier is fitted on a sample: the ``train_docs`` labelled documents
whose ids have the least hashes. Every document is counted, scored and drawn
from.

Cases: null and empty texts have no tokens and are never drawn; a null source,
or one without a target, is no label; a source of the targets without documents
gets nothing and is reported with share zero; a target of zero draws nothing.
Without labelled documents, memberships are uniform.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.llm.tokens import VOCABULARY, token_ids
from docketflow.runtime import cut

FEATURES = 4096
TRAIN_DOCS = 4_000
MAX_SOURCES = 1_000
BUCKET_ROWS = 50_000
DAMPING = [4.0**-i for i in range(12)]
MEMBER = "doc_id bigint, source string, n_tokens int, label int, member array<float>"


def _hashed(ids: list[int]) -> np.ndarray:
    return np.asarray(ids, np.int64) * 2654435761 % 2**32 % FEATURES


class SourceModel:
    """Multinomial naive Bayes over hashed token ids; the posteriors' sharpness is fitted on documents held out."""

    def __init__(self, n_sources: int):
        self.weights = np.zeros((FEATURES, n_sources), np.float32)
        self.prior = np.full(n_sources, 1.0 / n_sources)
        self.scale = 1.0

    def fit(self, labels: np.ndarray, features: list[np.ndarray]) -> "SourceModel":
        k = self.weights.shape[1]
        held = np.arange(len(labels)) % 4 == 3
        self._count([x for x, h in zip(features, held) if not h], labels[~held], k)
        kept = [(self.mean_log(x), y) for x, y, h in zip(features, labels, held) if h and len(x)]
        if kept:
            logs, truth = np.array([x for x, _ in kept]), np.array([y for _, y in kept])
            loss = lambda s: -np.log(np.maximum(_softmax(s * logs + np.log(self.prior))[np.arange(len(truth)), truth], 1e-12)).mean()
            self.scale = float(min((1.0, 3.0, 10.0, 30.0, 100.0, 300.0), key=loss))
        self._count(features, labels, k)
        return self

    def _count(self, features: list[np.ndarray], labels: np.ndarray, k: int) -> None:
        counts = np.full((FEATURES, k), 0.1)
        for x, y in zip(features, labels):
            counts[:, y] += np.bincount(x, minlength=FEATURES)
        self.weights = np.log(counts / counts.sum(0)).astype(np.float32)
        n = np.bincount(labels, minlength=k) + 1.0
        self.prior = n / n.sum()

    def mean_log(self, x: np.ndarray) -> np.ndarray:
        return self.weights[x].mean(0)

    def posterior(self, x: np.ndarray) -> np.ndarray:
        return _softmax((self.scale * self.mean_log(x) + np.log(self.prior))[None])[0] if len(x) else self.prior


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def fit_sources(documents: DataFrame, sources: list[str], vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS) -> SourceModel:
    """Fit on the ``train_docs`` labelled documents with the least id hashes."""
    labelled = documents.filter(F.col("source").isin(sources) & F.col("text").isNotNull())
    n_labelled = labelled.count()
    hashed = F.xxhash64("doc_id")
    # twice the share wanted passes before the sort; a hash of 64 bits is uniform enough for that at any size
    below = F.lit(2.0 * train_docs / max(1, n_labelled) * 2.0**64 - 2.0**63)
    sample = labelled.filter(hashed.cast("double") <= below).orderBy(hashed, "doc_id").limit(train_docs).select("source", "text")
    index = {s: k for k, s in enumerate(sources)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(index[s.as_py()], _hashed(token_ids(t.as_py(), vocabulary)).astype(np.int16).tolist()) for s, t in zip(b.column(0), b.column(1))]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.list_(pa.int16()))], names=["label", "x"])

    rows = sample.mapInArrow(run, "label int, x array<smallint>").toArrow()
    labels = rows.column("label").to_numpy().astype(np.int64)
    if n_labelled and not len(labels):
        raise RuntimeError(f"no training document among {n_labelled} labelled ones")
    model = SourceModel(len(sources))
    return model.fit(labels, [np.asarray(x, np.int64) for x in rows.column("x").to_pylist()]) if len(labels) else model


def memberships(documents: DataFrame, sources: list[str], model: SourceModel, vocabulary: str = VOCABULARY, trust: float = 1.0) -> DataFrame:
    """(doc_id, source, n_tokens, label, member): probabilities of the sources, or the index of the one that it belongs to."""
    index = {s: k for k, s in enumerate(sources)}
    shared = documents.sparkSession.sparkContext.broadcast((model.weights, model.prior, model.scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = SourceModel(len(sources))
        own.weights, own.prior, own.scale = shared.value
        for b in batches:
            n_tokens, labels, members = [], [], []
            for source, text in zip(b.column(1).to_pylist(), b.column(2)):
                ids = token_ids(text.as_py(), vocabulary) if text.is_valid else []
                label = index.get(source)
                n_tokens.append(len(ids))
                sure = label is not None and trust >= 1
                labels.append(label if sure else None)
                p = None if sure or not ids else own.posterior(_hashed(ids))
                if p is not None and label is not None:
                    p = (1 - trust) * p
                    p[label] += trust
                members.append(None if p is None else p.tolist())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n_tokens, pa.int32()), pa.array(labels, pa.int32()), pa.array(members, pa.list_(pa.float32()))],
                names=["doc_id", "source", "n_tokens", "label", "member"],
            )

    return cut(documents.select("doc_id", "source", "text").mapInArrow(run, MEMBER).filter("n_tokens > 0"), "memberships")


def _matrix(labels: np.ndarray, members: list, k: int) -> np.ndarray:
    p = np.zeros((len(labels), k))
    known = ~np.isnan(labels)
    p[np.flatnonzero(known), labels[known].astype(int)] = 1.0
    for i in np.flatnonzero(~known):
        p[i] = members[i]
    return p


def _rates(p: np.ndarray, most: np.ndarray, start: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Rates after the given projected steps; each step is the scaled gradient per source."""
    cap = most[p.argmax(1)]
    w = np.clip(p @ start, 0, cap)
    for g in steps:
        w = np.clip(w - p @ g, 0, cap)
    return w


def _totals(members: DataFrame, most: np.ndarray, start: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """Expected tokens per source, added up over all documents."""
    k = len(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(k)
        for b in batches:
            labels = b.column(1).to_numpy(zero_copy_only=False).astype(float)
            p = _matrix(labels, b.column(2).to_pylist(), k)
            total += (_rates(p, most, start, steps) * b.column(0).to_numpy()) @ p
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(total)], names=["k", "total"])

    rows = members.select("n_tokens", "label", "member").mapInArrow(run, "k int, total double").groupBy("k").agg(F.sum("total")).collect()
    out = np.zeros(k)
    for i, total in rows:
        out[i] = total
    return out


def _along(members: DataFrame, most: np.ndarray, start: np.ndarray, steps: list[np.ndarray], tried: list[np.ndarray]) -> np.ndarray:
    """Per gradient tried as the next step: the part of an implicit step's potential that documents add up to, then the tokens per source."""
    k = len(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((len(tried), k + 1))
        for b in batches:
            p, n = _matrix(b.column(1).to_numpy(zero_copy_only=False).astype(float), b.column(2).to_pylist(), k), b.column(0).to_numpy()
            w, cap = _rates(p, most, start, steps), most[p.argmax(1)]
            for i, g in enumerate(tried):
                x = w - p @ g
                c = np.clip(x, 0, cap)
                sums[i] += [n @ (c * x - c * c / 2), *((c * n) @ p)]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size), pa.int32()), pa.array(sums.ravel())], names=["at", "total"])

    rows = members.select("n_tokens", "label", "member").mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total")).collect()
    out = np.zeros(len(tried) * (k + 1))
    for i, total in rows:
        out[i] = total
    return out.reshape(len(tried), k + 1)


def _curvature(members: DataFrame, most: np.ndarray, start: np.ndarray, steps: list[np.ndarray]) -> np.ndarray:
    """How tokens per source change with the last step, from the documents whose rates are at neither bound."""
    k = len(most)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k, k))
        for b in batches:
            p = _matrix(b.column(1).to_numpy(zero_copy_only=False).astype(float), b.column(2).to_pylist(), k)
            x = _rates(p, most, start, steps[:-1]) - p @ steps[-1]
            free = (x > 0) & (x < most[p.argmax(1)])
            total += (p[free].T * b.column(0).to_numpy()[free]) @ p[free]
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total.ravel()[at])], names=["at", "total"])

    out = np.zeros(k * k)
    for i, total in members.select("n_tokens", "label", "member").mapInArrow(run, "at int, total double").groupBy("at").agg(F.sum("total")).collect():
        out[i] = total
    return out.reshape(k, k)


def _implicit_step(members: DataFrame, most: np.ndarray, start: np.ndarray, steps: list[np.ndarray], first: np.ndarray, target: np.ndarray, weight: np.ndarray, enough: float) -> np.ndarray:
    """The scaled gradient at the end of a projected step whose length is stock / weight.

    It is the minimum of a convex potential, found by damped Newton steps.
    """
    g = first

    def potential(tried: list[np.ndarray]) -> list[tuple[float, np.ndarray]]:
        sums = _along(members, most, start, steps, tried)
        return [(float((t * t * weight).sum() / 2 + target @ t + x[0]), weight * t + target - x[1:]) for t, x in zip(tried, sums)]

    ((value, slope),) = potential([g])
    while np.abs(slope).max() > enough:
        curve = np.diag(weight) + _curvature(members, most, start, [*steps, g])
        newton = np.linalg.lstsq(curve, slope, rcond=None)[0]
        tried = [g - t * newton for t in DAMPING]
        reached = potential(tried)
        best = min(range(len(tried)), key=lambda i: reached[i][0])
        if not reached[best][0] < value:
            break
        g, (value, slope) = tried[best], reached[best]
    return g


def fit_rates(members: DataFrame, shares: np.ndarray, most: np.ndarray, tolerance: float = 1e-4) -> tuple[np.ndarray, list[np.ndarray]]:
    """Start rate per source and projected-gradient steps of least squares.

    The total is the greatest that all targets allow: the scarcest source, with
    every document used as often as it may be, sets it. Steps end when every
    source is within ``tolerance`` of the total from its target, or when the sum
    of squares (each weighted by its source's tokens) no longer falls; every step
    that lowers it is kept. The first step is explicit. Rates at their bounds make
    such steps slow, so later ones are implicit, each ten times as long as the
    one before; they come to the least sum after a few.
    """
    k = len(shares)
    # documents of equal membership have equal rates
    members = cut(members.groupBy("label", "member").agg(F.sum(F.col("n_tokens").cast("long")).alias("n_tokens")), "distinct-memberships")
    stock = _totals(members, np.full(k, np.inf), np.ones(k), [])
    reach = _totals(members, most, np.full(k, 1e9), [])
    wanted = (shares > 0) & (reach > 0)
    if not wanted.any():
        return np.zeros(k), []
    size = (reach[wanted] / shares[wanted]).min()
    target = np.where(wanted, shares * size, 0.0)
    start = np.where(wanted, target / np.maximum(stock, 1e-9), 0.0)
    scale = np.where(stock > 0, stock, 1.0)
    steps: list[np.ndarray] = []
    residual, length = _totals(members, most, start, steps) - target, 1.0
    while np.abs(residual).max() > tolerance * size:
        step = residual / scale
        if length > 1:
            step = _implicit_step(members, most, start, steps, step, target, scale / length, tolerance * size / 1000)
        after = _totals(members, most, start, [*steps, step]) - target
        if not (after**2 / scale).sum() < (residual**2 / scale).sum():
            break
        steps.append(step)
        residual, length = after, max(100.0, length * 10)
    return start, steps


def draw(members: DataFrame, sources: list[str], most: np.ndarray, start: np.ndarray, steps: list[np.ndarray]) -> DataFrame:
    """(doc_id, source, drawn_as, n_tokens, draws) of every document drawn at least once."""
    k = len(sources)
    buckets = max(1, -(-members.count() // BUCKET_ROWS))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            labels = b.column(3).to_numpy(zero_copy_only=False).astype(float)
            p = _matrix(labels, b.column(4).to_pylist(), k)
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:3], pa.array(p.argmax(1), pa.int32()), pa.array(_rates(p, most, start, steps))], names=["doc_id", "source", "n_tokens", "s", "rate"]
            )

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["s", "n_tokens", "rate", "doc_id"], ascending=[True, False, True, True], ignore_index=True)
        base = np.floor(pdf["rate"].to_numpy() + 1e-9)
        extra, n, s = pdf["rate"].to_numpy() - base, pdf["n_tokens"].to_numpy(), pdf["s"].to_numpy()
        draws = base.astype("int32")
        # runs of documents alike in source, length and rate; longest first, as many of each get one use more as bring
        # the tokens drawn so far nearest to those expected
        starts = np.flatnonzero(np.r_[True, (s[1:] != s[:-1]) | (n[1:] != n[:-1]) | (extra[1:] != extra[:-1])]) if len(pdf) else np.array([], int)
        owed, last = 0.0, None
        for i, end in zip(starts, np.r_[starts[1:], len(pdf)]):
            owed, last, count = (0.0 if s[i] != last else owed) + extra[i] * n[i] * (end - i), s[i], end - i
            if extra[i] > 1e-9:
                more = int(min(count, max(0.0, np.floor(owed / n[i] + 0.5))))
                draws[i : i + more] += 1
                owed -= more * n[i]
        pdf["draws"] = draws
        pdf["drawn_as"] = [sources[k] for k in s]
        return pdf.loc[pdf["draws"] > 0, ["doc_id", "source", "drawn_as", "n_tokens", "draws"]]

    rated = members.mapInArrow(rate, "doc_id bigint, source string, n_tokens int, s int, rate double")
    # documents of one source spread evenly over the buckets, as ids are unique
    spread = rated.withColumn("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(buckets)))
    return spread.groupBy("bucket").applyInPandas(whole, "doc_id bigint, source string, drawn_as string, n_tokens int, draws int")


def mix(documents: DataFrame, targets: DataFrame, vocabulary: str = VOCABULARY, train_docs: int = TRAIN_DOCS, trust: float = 1.0) -> DataFrame:
    """Draws that meet ``targets`` (source, target_share, max_repeats), a short fixed table."""
    rows = sorted(targets.filter(F.col("source").isNotNull()).select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect())
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    if not rows:
        return documents.sparkSession.createDataFrame([], "doc_id bigint, source string, drawn_as string, n_tokens int, draws int")
    sources = [r[0] for r in rows]
    shares, most = np.array([r[1] or 0.0 for r in rows], float), np.array([r[2] or 0 for r in rows], float)
    members = memberships(documents, sources, fit_sources(documents, sources, vocabulary, train_docs), vocabulary, trust)
    return draw(members, sources, most, *fit_rates(members, shares / max(shares.sum(), 1e-12), most))


def shares_report(drawn: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, reached_share, recorded_share, tokens, documents, most_used) per source of the targets.

    A document counts for its most probable source, in recorded_share for the one
    it was recorded with. A row with a null source has the recorded share of
    documents whose own source has no target, if any are drawn.
    """
    draws = cut(drawn.withColumn("all_tokens", F.col("n_tokens").cast("long") * F.col("draws")), "draws")
    per = draws.groupBy(F.col("drawn_as").alias("source")).agg(F.sum("all_tokens").alias("tokens"), F.count(F.lit(1)).alias("documents"), F.max("draws").alias("most_used"))
    known = F.broadcast(targets.select(F.col("source").alias("known")).distinct())
    recorded = draws.join(known, F.col("source") == F.col("known"), "left").groupBy(F.col("known").alias("source")).agg(F.sum("all_tokens").alias("recorded"))
    others = recorded.filter(F.col("source").isNull()).select("source", F.lit(0.0).alias("target_share"), F.lit(0).cast("long").alias("tokens"), F.lit(0).cast("long").alias("documents"), F.lit(0).alias("most_used"), "recorded")
    joined = targets.select("source", "target_share").join(per, "source", "left").join(recorded, "source", "left").unionByName(others).na.fill(0, ["tokens", "documents", "most_used", "recorded"])
    total = float(per.agg(F.sum("tokens")).first()[0] or 1)
    share = lambda c: F.col(c) / F.lit(total)
    return joined.select("source", "target_share", share("tokens").alias("reached_share"), share("recorded").alias("recorded_share"), "tokens", "documents", "most_used")
