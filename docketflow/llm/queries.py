"""Queries of the text-corpus operators (problems 1, 5, 6, 8, 9 and 10) and their SQL where there is one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketflow.llm import confusables, cooccurrence, mixing, mojibake, names, packing
from docketflow.llm.sql import SQL  # noqa: F401
from docketflow.operators import packed_values
from docketflow.plans.pipeline_queries import MATCHES, REGISTER, body_names
from docketflow.sources.tables import load

MAX_LIMITS = 1_000


def p1_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pair in at least three and 0.3 % of the documents, with its counts and how far it exceeds chance."""
    return cooccurrence.item_pairs(load(spark, sf_dir, REGISTER), "doc_num", ["people", "entities"])


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    exceeds = F.col("n_ab") * F.col("n_records") >= 5 * F.col("n_a") * F.col("n_b")
    return p1_pairs(spark, sf_dir).filter(exceeds).select("item_a", "item_b")


def _mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    register, matches = load(spark, sf_dir, REGISTER), load(spark, sf_dir, MATCHES)
    none = F.lit(None).cast("string").alias("hint")
    people = register.select(F.lit(REGISTER).alias("tab"), F.lit("people").alias("fld"), F.col("reg_id").alias("row_id"), F.posexplode("people").alias("p", "text"))
    sources = packed_values.explode_values(register, "reg_id", "source", body_names(spark, sf_dir))
    local = F.regexp_replace(F.regexp_extract("from_email", r"^\s*(.*?)\s*(?:@|_at_|\sat\s)", 1), r"^$", "")
    return (
        people.select("tab", "fld", "row_id", (F.col("p") + 1).cast("int").alias("pos"), "text", none)
        .unionByName(sources.select(F.lit(REGISTER).alias("tab"), F.lit("source").alias("fld"), "row_id", "pos", F.col("item").alias("text"), none))
        .unionByName(
            matches.select(
                F.lit(MATCHES).alias("tab"), F.lit("from_name").alias("fld"), F.col("match_id").alias("row_id"), F.lit(1).alias("pos"), F.col("from_name").alias("text"),
                F.when(local != "", local).alias("hint"),
            )
        )
    )


def p5_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mention of an entry, also those written as in the directory."""
    return names.link(_mentions(spark, sf_dir), load(spark, sf_dir, "contributors")).drop("spelling")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    contributors = load(spark, sf_dir, "contributors")
    listed = contributors.select("contributor_id", F.col("full_name").alias("spelling"))
    return names.link(_mentions(spark, sf_dir), contributors).join(listed, ["contributor_id", "spelling"], "left_anti").select("tab", "fld", "row_id", "pos", "contributor_id")


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    def of(tab: str, id_col: str, fld: str) -> DataFrame:
        return load(spark, sf_dir, tab).select(F.lit(tab).alias("tab"), F.lit(fld).alias("fld"), F.col(id_col).alias("row_id"), F.col(fld).alias("text"))

    return of(REGISTER, "reg_id", "subject").unionByName(of(REGISTER, "reg_id", "summary")).unionByName(of(MATCHES, "match_id", "subject"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mojibake.repair(_texts(spark, sf_dir)).select("tab", "fld", "row_id")


def p6_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each garbled value with its restored text; ``whole`` is false where a part is lost."""
    return mojibake.repair(_texts(spark, sf_dir))


def _limits(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    rows = load(spark, sf_dir, "pack_limits").filter("capacity_tokens > 0").select("limit_id", "capacity_tokens").limit(MAX_LIMITS + 1).collect()
    if len(rows) > MAX_LIMITS:
        raise ValueError(f"more than {MAX_LIMITS} container sizes")
    return sorted((r[0], r[1]) for r in rows)


def p8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers of each size with their documents, or pieces of one, and their unused space."""
    return packing.pack(packing.count_tokens(load(spark, sf_dir, "documents")), _limits(spark, sf_dir))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, unused space and the least possible number of containers of each size."""
    return packing.fill_report(p8_packing(spark, sf_dir), _limits(spark, sf_dir))


def p9_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen documents and how often each is used."""
    return mixing.mix(load(spark, sf_dir, "documents"), load(spark, sf_dir, "mix_targets"))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and reached share of all tokens per source."""
    return mixing.shares_report(p9_draws(spark, sf_dir), load(spark, sf_dir, "mix_targets"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return confusables.comparable_pairs(load(spark, sf_dir, "documents"))


def p10_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class of each readable text by its consistent form, and how many spellings share it."""
    return confusables.membership(load(spark, sf_dir, "documents"))


QUERIES = {
    f.__name__: f for f in (p1_found, p1_pairs, p5_found, p5_mentions, p6_found, p6_repaired, p8_packing, p8_fill, p9_draws, p9_shares, p10_found, p10_forms)
}
