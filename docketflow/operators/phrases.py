"""Key phrases and summaries of texts.

A phrase is a run of words between stop words and punctuation. Its words score by
degree over frequency: how many words stand in phrases with them, over how often
they occur, in the whole corpus. A summary is the sentences nearest to the main
direction of a text's own sentence-by-word matrix.

Cases: null and empty texts have no phrases and a null summary; texts of few
sentences are their own summary.
"""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Words that end a phrase.
STOP_WORDS = (
    "a about after all also an and any are as at be because been before between both but by can could did do does for from had has have he her his how if in into is it its may "
    "more most must no not of on only or other our out over should so some such than that the their them then there these they this those through to under up was we were what when where which while who will with would you your"
).split()


def candidate_phrases(df: DataFrame, key: str, text: str, most: int = 4) -> DataFrame:
    """(key, phrase, n): runs of up to ``most`` words between stop words, numbers and punctuation, with how often each text has them."""
    stops = "|".join(STOP_WORDS)
    marked = F.regexp_replace(F.lower(text), rf"(?U)(?<![\w'-])(?:{stops})(?![\w'-])|[^\p{{L}}\s'-]+", "|")
    pieces = df.select(key, F.explode(F.split(marked, r"\|+")).alias("p")).select(key, F.trim(F.regexp_replace("p", r"(?U)\s+", " ")).alias("phrase"))
    kept = pieces.filter((F.length("phrase") > 2) & (F.size(F.split("phrase", " ")) <= most))
    return kept.groupBy(key, "phrase").agg(F.count(F.lit(1)).alias("n"))


def key_phrases(df: DataFrame, key: str, text: str, share: float = 0.01, most: int = 4) -> DataFrame:
    """(key, rank, phrase, score): of each text's phrases the best ``share``, at least one; equal scores by phrase."""
    found = candidate_phrases(df, key, text, most)
    # per phrase first, so that frequent words are added up before they travel
    phrases = found.groupBy("phrase").agg(F.sum("n").alias("n"))
    words = phrases.select("n", F.size(F.split("phrase", " ")).alias("size"), F.explode(F.split("phrase", " ")).alias("word"))
    weight = words.groupBy("word").agg((F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("w"))
    scored = phrases.select("phrase", F.explode(F.split("phrase", " ")).alias("word")).join(weight, "word").groupBy("phrase").agg(F.sum("w").alias("score"))
    of_text = Window.partitionBy(key)
    ranked = found.join(scored, "phrase").withColumn("rank", F.row_number().over(of_text.orderBy(F.desc("score"), "phrase"))).withColumn("total", F.count(F.lit(1)).over(of_text))
    return ranked.filter(F.col("rank") <= F.greatest(F.lit(1), F.ceil(F.col("total") * share))).select(key, "rank", "phrase", F.round("score", 6).alias("score"))


def _summary(text: str | None, sentences: int) -> str | None:
    if text is None or not text.strip():
        return None
    parts = [p.strip() for p in re.split(r"(?<=[.!?])\s+", text.strip()) if p.strip()]
    if len(parts) <= sentences:
        return " ".join(parts)
    bags = [[w for w in re.findall(r"\w{3,}", p.lower()) if w not in STOP_WORDS] for p in parts]
    index = {w: i for i, w in enumerate(sorted({w for bag in bags for w in bag}))}
    matrix = np.zeros((len(index), len(parts)))
    for j, bag in enumerate(bags):
        for w in bag:
            matrix[index[w], j] += 1
    if not len(index):
        return " ".join(parts[:sentences])
    _, sizes, rows = np.linalg.svd(matrix, full_matrices=False)
    score = np.sqrt(((sizes[:, None] * rows) ** 2)[: min(3, len(sizes))].sum(0))
    best = sorted(sorted(range(len(parts)), key=lambda j: (-score[j], j))[:sentences])
    return " ".join(parts[j] for j in best)


def summaries(sentences: int = 5):
    """Column function: the most telling sentences of a text in their order."""

    @F.pandas_udf(StringType())
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: _summary(t, sentences))

    return run
