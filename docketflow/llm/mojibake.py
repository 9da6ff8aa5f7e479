"""Garbled text from wrong character encoding (problem 6).

Distinct texts with non-ASCII characters are joined on what is left of them
without these: near-twins are equal there and differ only in the runs of
non-ASCII characters at the same places. Of the runs of one length at one place,
the most frequent in the corpus is taken as clean, and every other one is aligned
with it character by character: either as the bytes of its UTF-8 form, which
tells the byte that each character shown stands for, or one to one. From counts of such
aligned characters, tables are inferred (``charsets.infer_*``), with no codec as
a hypothesis about a text: where an inferred table agrees with a codec of the
platform, that completes it with the characters not met. Learned tables are
applied to all distinct texts, with sequences checked for validity and results
for plausibility in the corpus, and the repaired ones are joined back to the
rows. Characters lost to U+FFFD are restored from a whole near-twin, else from
the same word elsewhere.

Texts of the rows cross the network once, so that copies have no vote; after that
digests and counted runs do. The driver sees counts of aligned characters, of
characters and of neighbouring letters below U+0500: the alphabets bound these,
and the tables that are broadcast. A text without ASCII letters or digits has no
near-twins, as nothing is left of it; learned tables are applied to it as well.

Cases: null, blank and ASCII texts are never garbled; a U+FFFD that the text
itself names is correct; repeated rows are cases of their own; an empty corpus
learns nothing. A wrong decoding is learned from at least three (UTF-8) or four
(single-byte) aligned characters.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.llm.charsets import LOST, Repairer, align_single, align_utf8, infer_single, infer_utf8, stripped_runs, word_sides
from docketflow.operators.skew import heavy_keys, salted_join
from docketflow.runtime import cut

MAX_PENDING = 200_000
#: Letters whose neighbours are counted: the alphabets of single-byte codecs lie below.
LETTERS_TO = "Ԁ"
_ANCHOR = re.compile("[A-Za-z0-9]")
REPAIRED = "text string, restored string, whole boolean"


def _digest(text: str) -> str:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).hexdigest()


def _counts(rows: Callable[[pa.RecordBatch], Iterator[tuple]], names: list[str]):
    """An Arrow function that adds up counts by string keys before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pending: Counter = Counter()

        def flush() -> pa.RecordBatch:
            keys, n = list(pending), list(pending.values())
            pending.clear()
            return pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.string()) for i in range(len(names))), pa.array(n, pa.int64())], names=[*names, "n"])

        for b in batches:
            for *key, n in rows(b):
                pending[tuple(key)] += n
            if len(pending) > MAX_PENDING:
                yield flush()
        yield flush()

    return run


def distinct_texts(values: DataFrame) -> DataFrame:
    """(d, text, n): the distinct texts that can be garbled at all, with their digest and number of rows."""
    return cut(non_ascii(values).groupBy("text").agg(F.count(F.lit(1)).alias("n")).select(F.md5("text").alias("d"), "text", "n"), "distinct-texts")


def non_ascii(values: DataFrame) -> DataFrame:
    return values.filter(F.col("text").rlike(r"[^\x00-\x7f]"))


def count_runs(texts: DataFrame) -> DataFrame:
    """(side, run, n): runs by their place in the stripped text, counted over distinct texts; side is null where nothing is left of the text."""

    def rows(b: pa.RecordBatch) -> Iterator[tuple]:
        for text in b.column(0).to_pylist():
            stripped, runs = stripped_runs(text)
            side = _digest(stripped) if _ANCHOR.search(stripped) else None
            for place, run in runs:
                yield side and f"{side}:{place}", run, 1

    return cut(texts.select("text").mapInArrow(_counts(rows, ["side", "run"]), "side string, run string, n bigint").groupBy("side", "run").agg(F.sum("n").alias("n")), "runs")


def near_twins(runs: DataFrame, words: DataFrame) -> DataFrame:
    """(run, clean, how, n, n_clean): different runs at one place of near-twins that can be one text read in two ways.

    how is ``bytes`` where clean has as many UTF-8 bytes as the run has
    characters, ``chars`` where it has as many characters. Of several that have,
    clean is the one of most texts in the corpus, so each run has one of either kind.
    """
    sided = runs.filter(F.col("side").isNotNull())
    several = sided.groupBy("side").agg(F.count(F.lit(1)).alias("k")).filter("k > 1").select("side")
    met = salted_join(sided.join(several, "side", "left_semi").select("side", "run"), words, heavy_keys(words, "run"), "run", ["side"])
    sizes = F.inline(F.array(F.struct(F.lit("bytes").alias("how"), F.octet_length("run").alias("size")), F.struct(F.lit("chars").alias("how"), F.length("run").alias("size"))))
    whole = met.filter(~F.contains("run", F.lit(LOST))).select("side", "run", "n", sizes)
    best = whole.groupBy("side", "how", "size").agg(F.max(F.struct("n", "run")).alias("best")).select("side", "how", "size", F.col("best.run").alias("clean"), F.col("best.n").alias("n_clean"))
    ways = met.select("side", "run", "n", F.length("run").alias("size"), F.explode(F.array(F.lit("bytes"), F.lit("chars"))).alias("how"))
    joined = ways.join(best, ["side", "how", "size"]).filter(F.col("run") != F.col("clean"))
    return cut(joined.select("run", "clean", "how", "n", "n_clean").distinct(), "near-twins")


def _collect(df: DataFrame) -> dict[tuple[str, str], int]:
    return {(a, b): n for a, b, n in df.collect()}


def learn(runs: DataFrame) -> Repairer:
    """Tables inferred from near-twins, and the corpus's counts of characters and letter pairs."""
    words = cut(runs.groupBy("run").agg(F.sum("n").alias("n")), "run-words")
    twins = near_twins(runs, words)
    schema, pair = "a string, b string, n bigint", ["a", "b"]

    def utf8(b: pa.RecordBatch) -> Iterator[tuple]:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            for seq, char in align_utf8(x, y):
                yield seq, char, 1

    multi = infer_utf8(_collect(twins.filter("how = 'bytes'").select("run", "clean").mapInArrow(_counts(utf8, pair), schema).groupBy("a", "b").agg(F.sum("n"))))
    reader = Repairer(multi, [], {}, {})

    def one_to_one(b: pa.RecordBatch) -> Iterator[tuple]:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if not reader.undo_utf8(x) and not reader.undo_utf8(y):
                for shown, meant in align_single(x, y):
                    yield shown, meant, 1

    rarer = twins.filter((F.col("how") == "chars") & (F.col("n") < F.col("n_clean"))).select("run", "clean")
    single = infer_single(_collect(rarer.mapInArrow(_counts(one_to_one, pair), schema).groupBy("a", "b").agg(F.sum("n"))))
    reader = Repairer(multi, single, {}, {})

    def misread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(r, n, other) for r, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for other in reader.single_readings(r) if other != r]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in found], k) for i, k in enumerate((pa.string(), pa.int64(), pa.string()))], names=["misread", "m", "run"])

    # a run that a learned table reads as a more frequent one has no vote on which letters stand side by side
    silent = words.mapInArrow(misread, "misread string, m bigint, run string").join(words, "run").filter("m < n").select(F.col("misread").alias("run")).distinct().withColumn("silent", F.lit("x"))
    voters = words.join(silent, "run", "left").select("run", "n", "silent")

    def grams(b: pa.RecordBatch) -> Iterator[tuple]:
        for r, n, mute in zip(*(c.to_pylist() for c in b.columns)):
            votes = not mute and not reader.undo_utf8(r)
            for i, c in enumerate(r):
                yield c, n
                if votes and i and c.isalpha() and c < LETTERS_TO and r[i - 1] < LETTERS_TO:
                    yield r[i - 1] + c, n

    counts = voters.mapInArrow(_counts(grams, ["gram"]), "gram string, n bigint").groupBy("gram").agg(F.sum("n").alias("n")).toArrow().to_pydict()
    known = {g: n for g, n in zip(counts["gram"], counts["n"]) if len(g) == 1 and g != LOST}
    return Repairer(multi, single, known, {g: n for g, n in zip(counts["gram"], counts["n"]) if len(g) == 2})


def repair(values: DataFrame) -> DataFrame:
    """(tab, fld, row_id, text, restored, whole) of every garbled value of ``values`` (tab, fld, row_id, text).

    whole is false where a part could not be recovered.
    """
    texts = distinct_texts(values)
    shared = values.sparkSession.sparkContext.broadcast(learn(count_runs(texts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            done = [(text, restored, whole) for text in b.column(0).to_pylist() for restored, garbled, whole in [shared.value.repair(text)] if garbled]
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], k) for i, k in enumerate((pa.string(), pa.string(), pa.bool_()))], names=["text", "restored", "whole"])

    repaired = _restore_lost(cut(texts.select("text").mapInArrow(run, REPAIRED), "repaired"), texts, shared)
    rows = non_ascii(values).select("tab", "fld", "row_id", F.md5("text").alias("d"))
    return salted_join(rows, repaired.withColumn("d", F.md5("text")), heavy_keys(texts.select("d", "n"), "d"), "d", ["tab", "fld", "row_id"]).select(
        "tab", "fld", "row_id", "text", "restored", "whole"
    )


def _sides(text: str) -> Iterator[tuple[int, int, str, str]]:
    """(number of the run, level, side, run): whole stripped text first, then the word."""
    stripped, runs = stripped_runs(text)
    if _ANCHOR.search(stripped):
        for k, (place, run) in enumerate(runs):
            yield k, 0, f"{_digest(stripped)}:{place}", run
    for side, run, k in word_sides(text):
        if _ANCHOR.search(side.rpartition("\x00")[0]):
            yield k, 1, side, run


def _restore_lost(repaired: DataFrame, texts: DataFrame, shared) -> DataFrame:
    """Fill what is lost from the most frequent readable run at the same place of near-twins, else of the same words, where it fits what is left."""
    lost = repaired.filter(~F.col("whole"))
    schema = "restored string, k int, level int, gap string, side string"

    def gaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [(text, k, level, run, side) for text in set(b.column(0).to_pylist()) for k, level, side, run in _sides(text) if LOST in run]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=[c.split()[0] for c in schema.split(", ")])

    def readable(b: pa.RecordBatch) -> Iterator[tuple]:
        for text in b.column(0).to_pylist():
            for _, _, side, run in _sides(text):
                if LOST not in run and not shared.value.repair(run)[1]:
                    yield side, run, 1

    asked = cut(lost.select("restored").distinct().mapInArrow(gaps, schema), "gaps")
    there = texts.select("text").mapInArrow(_counts(readable, ["side", "run"]), "side string, run string, n bigint").join(asked.select("side").distinct(), "side", "left_semi")
    counted = there.groupBy("side", "run").agg(F.sum("n").alias("n")).groupBy("side").agg(F.max_by("run", F.struct("n", "run")).alias("clean"))
    fits = F.rlike("clean", F.concat(F.lit("^"), F.regexp_replace("gap", f"{LOST}+", ".{1,3}"), F.lit("$")))
    found = asked.join(counted, "side").filter(fits).groupBy("restored", "k").agg(F.min_by("clean", "level").alias("clean"))
    fills = found.groupBy("restored").agg(F.collect_list(F.struct("k", "clean")).alias("fills"))

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text, fills_ in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                by, pieces, at = {f["k"]: f["clean"] for f in fills_}, [], 0
                for k, (_, run) in enumerate(stripped_runs(text)[1]):
                    start = text.index(run, at)
                    pieces += [text[at:start], by.get(k) or run]
                    at = start + len(run)
                out.append("".join(pieces) + text[at:])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array([LOST not in x for x in out], pa.bool_())], names=["restored", "filled", "filled_whole"])

    filled = fills.mapInArrow(fill, "restored string, filled string, filled_whole boolean")
    return repaired.join(filled, "restored", "left").select(
        "text", F.coalesce("filled", "restored").alias("restored"), F.when(F.col("whole"), True).otherwise(F.coalesce("filled_whole", F.lit(False))).alias("whole")
    )
