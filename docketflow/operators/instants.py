"""Mixed timestamp notations to one instant per row (problem 4).

Raw strings are reduced to a dictionary of distinct (text, zone, day order)
entries; each entry is parsed once, in Arrow batches, and the dictionary is
persisted. A later run with the same dictionary path parses only texts it has
not seen. The instants are joined back to the rows; rows of an entry that holds many
are spread over many tasks.

Cases: null, blank and unparsable texts have a null instant; an unknown feed
gives no zone and no day order, so only texts that carry a zone have an instant;
repeated rows are cases of their own.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docketflow.functions.instants import parse_instant
from docketflow.operators.skew import heavy_keys, salted_join
from docketflow.runtime import bounded_broadcast, cut, fresh_path

MAX_FEEDS = 10_000
ENTRY = "text string, zone_name string, day_first boolean, utc_micros bigint"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        texts, zones, orders = (b.column(k).to_pylist() for k in range(3))
        micros = pa.array([parse_instant(*x) for x in zip(texts, zones, orders)], pa.int64())
        yield pa.RecordBatch.from_arrays([*b.columns[:3], micros], names=["text", "zone_name", "day_first", "utc_micros"])


def _exists(df: DataFrame, path: str) -> bool:
    jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
    target = jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(sc._jsc.hadoopConfiguration()).exists(target)


def extend_dictionary(entries: DataFrame, path: str) -> DataFrame:
    """Parse the entries (text, zone_name, day_first) that the dictionary at ``path`` lacks, append them, and return it."""
    spark = entries.sparkSession
    if _exists(entries, path):
        known = spark.read.schema(ENTRY).parquet(path).alias("k")
        same = [F.col(f"e.{c}").eqNullSafe(F.col(f"k.{c}")) for c in ("text", "zone_name", "day_first")]
        entries = entries.alias("e").join(known, same, "left_anti")
    entries.select("text", "zone_name", "day_first").mapInArrow(_parse, ENTRY).write.mode("append").parquet(path)
    # two runs that extend one dictionary at the same time may both have added a text
    return spark.read.schema(ENTRY).parquet(path).dropDuplicates(["text", "zone_name", "day_first"])


def with_zone(rows: DataFrame, feeds: DataFrame) -> DataFrame:
    """Add zone_name and day_first of each row's feed; rows of unknown feeds keep nulls."""
    return rows.join(bounded_broadcast(feeds.select("feed", "zone_name", "day_first"), MAX_FEEDS), "feed", "left")


def normalise(rows: DataFrame, feeds: DataFrame, dictionary_path: str | None = None) -> DataFrame:
    """(tab, row_id, text, utc_micros) of ``rows`` (tab, row_id, text, feed); utc_micros is null where there is no instant."""
    keys = ["text", "zone_name", "day_first"]
    # one string, so that null zones compare equal
    key = F.concat_ws("\u0001", F.coalesce("zone_name", F.lit("")), F.coalesce(F.col("day_first").cast("string"), F.lit("")), "text")
    zoned = with_zone(rows.select("tab", "row_id", "text", "feed"), feeds.dropDuplicates(["feed"])).select("tab", "row_id", *keys, key.alias("k"))
    counted = cut(zoned.filter(F.col("text").isNotNull()).groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), "instant-entries")
    heavy = cut(heavy_keys(counted.select(key.alias("k"), "n"), "k"), "instant-heavy")
    dictionary = extend_dictionary(counted, dictionary_path or fresh_path(rows.sparkSession, "instants"))
    lookup = dictionary.filter(F.col("utc_micros").isNotNull()).select(key.alias("k"), "utc_micros")
    return salted_join(zoned, lookup, heavy, "k", ["tab", "row_id"], "left").select("tab", "row_id", "text", "utc_micros")
