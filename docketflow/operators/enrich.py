"""Enrichment of texts by a provider, such as a language model behind a service.

A provider is a picklable callable from a list of prompts to a list of JSON
replies. It is called in Arrow batches on the executors; an error becomes a
column, never a failed job. The default provider needs no network and always
gives the same reply to the same prompt.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docketflow.functions.taxonomy import WORD
from docketflow.functions.text import cut_text, fill_template

Provider = Callable[[list[str]], list[str]]

# Declared reply schemas.
DOCUMENT_REPLY = "relevant boolean, people array<string>, references array<string>, entities array<string>, summary string, description string, other_details string"
KEYWORD_REPLY = "keywords array<string>"
LABEL_REPLY = "labels map<string, array<string>>, is_proposal boolean"
SALIENCE_REPLY = "explicitness string, coverage_pct int, subthemes array<string>, evidence array<struct<quote: string, loc: string>>, confidence int"


# What is asked of a provider, by kind; {title} and {text} are filled in, texts cut to a length.
PROMPTS = {
    "document": ("Read a paper of a register. Reply with JSON: relevant, people, references, entities, summary, description, other_details.\nTitle: {title}\nText: {text}", 12_000),
    "mail": ("Read a mail of a list. Reply with JSON: relevant, people, references, entities, summary, other_details.\nSubject: {title}\nText: {text}", 8_000),
    "keywords": ("Name the keywords of a proposal. Reply with JSON: keywords.\nTitle: {title}\nText: {text}", 8_000),
    "labels": ("Label a paper by the taxonomy. Reply with JSON: labels, is_proposal.\nTitle: {title}\nText: {text}", 12_000),
    "salience": ("Say how much of a text is about the topic. Reply with JSON: explicitness, coverage_pct, subthemes, evidence, confidence.\nTitle: {title}\nText: {text}", 12_000),
}


def prompt_for(kind: str, **fields: Column) -> Column:
    """The prompt of a kind with its fields, each cut to the kind's length."""
    template, most = PROMPTS[kind]
    return fill_template(template, **{name: cut_text(c, most) for name, c in fields.items()})


def cost(usage: Column, per_prompt: float, per_completion: float) -> Column:
    """Cost of a struct of token counts at given rates; missing counts are zero."""
    count = lambda name: F.coalesce(usage[name], F.lit(0))
    return count("prompt_tokens") * F.lit(per_prompt) + count("completion_tokens") * F.lit(per_completion)


def used(done: DataFrame) -> Column:
    """Rough count of tokens of each reply, four characters each, as a provider without network reports none."""
    return F.ceil(F.length(F.to_json("reply")) / 4)


def local_provider(prompts: list[str]) -> list[str]:
    """Replies from the prompt's own words."""

    def reply(prompt: str) -> str:
        names = sorted(set(re.findall(r"[^\W\d_a-z][^\W\d_]+ [^\W\d_a-z][^\W\d_]+", prompt)))
        words = sorted(set(re.findall(r"\w{5,}", prompt.lower())))
        return json.dumps(
            {
                "relevant": WORD in prompt.lower(), "people": names[:5], "references": sorted(set(re.findall(r"L2/\d{2}-\d{3,}", prompt))), "entities": [],
                "summary": prompt[:200], "description": "", "other_details": "", "keywords": words[:10], "labels": {}, "is_proposal": "proposal" in prompt.lower(),
                "explicitness": "none", "coverage_pct": 0, "subthemes": [], "evidence": [], "confidence": 1,
            }
        )

    return [reply(p) for p in prompts]


def enrich(df: DataFrame, key: str, prompt: Column, schema: str, provider: Provider = local_provider, batch: int = 50, tries: int = 1) -> DataFrame:
    """(key, reply, error): the parsed reply to each row's prompt. Null prompts are not sent and have a null reply.

    A batch whose call fails is sent up to ``tries`` times.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            replies: list[str | None] = [None] * len(b)
            errors: list[str | None] = [None] * len(b)
            sent = [i for i, p in enumerate(b["prompt"]) if p is not None]
            for start in range(0, len(sent), batch):
                part = sent[start : start + batch]
                for left in reversed(range(tries)):
                    try:
                        for i, reply in zip(part, provider([b["prompt"].iloc[i] for i in part]), strict=True):
                            replies[i] = reply
                        break
                    except Exception as e:  # noqa: BLE001
                        for i in part if not left else ():
                            errors[i] = str(e)
            yield pd.DataFrame({"key": b["key"], "raw": replies, "error": errors})

    kind = dict(df.dtypes)[key]
    done = df.select(F.col(key).alias("key"), prompt.alias("prompt")).mapInPandas(run, f"key {kind}, raw string, error string")
    parsed = F.from_json("raw", schema, {"mode": "PERMISSIVE"})
    bad = F.col("raw").isNotNull() & F.try_parse_json("raw").isNull()
    return done.select(F.col("key").alias(key), parsed.alias("reply"), F.when(bad, F.lit("reply is no JSON")).otherwise(F.col("error")).alias("error"))
