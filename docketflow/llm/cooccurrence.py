"""Items that appear together (problem 1).

Pairs are counted by an external sort of packed 64-bit codes. Every item gets a
32-bit number in code point order; a pair is
``a << 32 | b`` with a < b. Each partition sorts its codes (spilling sorted runs
that Spark's sorter merges), counts run lengths, and only these counted runs are
shuffled; after the shuffle the runs are sorted, merged and counted again. The
counted pairs get observed-to-expected ratio and the odds ratio with a
continuity correction of one half.

All pairs of all records are formed and counted, also those of rare items; the
least counts of ``item_pairs`` only choose among the counted pairs. The work is
that of the records' squared sizes, whatever these parameters are.

Cases: null and blank items, null records and null arrays count nothing; an item
repeated in a record counts once; records that share an id are one record, whose
items are united; a record of one item has no pairs but counts in N; an empty
input has no pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docketflow.runtime import bounded_broadcast, cut

MAX_ITEMS = 2_000_000
RUN = "code bigint, n bigint"


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Codes of all pairs of each record's sorted item numbers."""
    for b in batches:
        lists = b.column(0)
        offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
        numbers = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        codes, size = [], 0
        for start, end in zip(offsets[:-1], offsets[1:]):
            own = np.sort(numbers[start:end])
            for k in range(len(own) - 1):
                codes.append((own[k] << 32) | own[k + 1 :])
                size += len(codes[-1])
                if size > 1_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes))], names=["code"])
                    codes, size = [], 0
        if codes:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(codes))], names=["code"])


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Run lengths of a sorted stream of codes, or of counted codes; a run may go on over batches."""
    code, count = None, 0
    for b in batches:
        codes = b.column(0).to_numpy()
        if not len(codes):
            continue
        weights = b.column(1).to_numpy() if b.num_columns > 1 else np.ones(len(codes), np.int64)
        starts = np.flatnonzero(np.concatenate(([True], codes[1:] != codes[:-1])))
        keys, sums = codes[starts], np.add.reduceat(weights, starts)
        if code is not None and keys[0] == code:
            sums[0] += count
        elif code is not None:
            yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([count], pa.int64())], names=["code", "n"])
        code, count = int(keys[-1]), int(sums[-1])
        if len(keys) > 1:
            yield pa.RecordBatch.from_arrays([pa.array(keys[:-1], pa.int64()), pa.array(sums[:-1], pa.int64())], names=["code", "n"])
    if code is not None:
        yield pa.RecordBatch.from_arrays([pa.array([code], pa.int64()), pa.array([count], pa.int64())], names=["code", "n"])


def count_codes(codes: DataFrame) -> DataFrame:
    """(code, n): how often each 64-bit code occurs, by external sort and run lengths."""
    runs = codes.sortWithinPartitions("code").mapInArrow(_runs, RUN)
    return runs.repartition("code").sortWithinPartitions("code").mapInArrow(_runs, RUN)


def item_pairs(df: DataFrame, record: str, arrays: list[str], min_records: int = 3, min_share: float = 0.003) -> DataFrame:
    """(item_a, item_b, n_a, n_b, n_ab, n_records, lift, odds_ratio) of pairs in at least ``min_records`` and ``min_share`` of the records."""
    empty = F.array().cast("array<string>")
    trim = lambda x: F.regexp_replace(x, r"(?U)^\s+|\s+$", "")
    items = F.array_distinct(F.transform(F.concat(*(F.coalesce(a, empty) for a in arrays)), trim))
    rows = df.filter(F.col(record).isNotNull()).select(F.col(record).alias("record"), F.filter(items, lambda x: x.isNotNull() & (x != "")).alias("items"))
    # one row per record and item; an id shared by many rows combines before the shuffle
    single = cut(rows.select("record", F.explode_outer("items").alias("item")).groupBy("record", "item").agg(F.lit(1).alias("one")).drop("one"), "record-items")
    n = single.agg(F.count_distinct("record")).first()[0]
    least = max(min_records, 1)
    counts = single.filter(F.col("item").isNotNull()).groupBy("item").agg(F.count(F.lit(1)).alias("n_item"))
    numbered = cut(_number(counts), "numbered-items")
    lookup = bounded_broadcast(numbered, MAX_ITEMS)
    records = single.join(lookup.select("item", "code"), "item").groupBy("record").agg(F.collect_list("code").alias("codes"))
    pairs = count_codes(records.select("codes").filter(F.size("codes") > 1).mapInArrow(_pairs, "code bigint"))
    kept = pairs.filter((F.col("n") >= least) & (F.col("n") >= F.lit(min_share) * n))
    a = lookup.select(F.col("code").alias("a"), F.col("item").alias("item_a"), F.col("n_item").alias("n_a"))
    b = lookup.select(F.col("code").alias("b"), F.col("item").alias("item_b"), F.col("n_item").alias("n_b"))
    joined = (
        kept.select(F.shiftright("code", 32).alias("a"), F.col("code").bitwiseAND(F.lit(0xFFFFFFFF)).alias("b"), F.col("n").alias("n_ab"))
        .join(a, "a")
        .join(b, "b")
        .withColumn("n_records", F.lit(n).cast("long"))
    )
    return joined.select("item_a", "item_b", "n_a", "n_b", "n_ab", "n_records", lift().alias("lift"), odds_ratio().alias("odds_ratio"))


def lift() -> Column:
    """Observed over expected count of records that hold both."""
    return F.col("n_ab").cast("double") * F.col("n_records") / F.col("n_a") / F.col("n_b")


def odds_ratio() -> Column:
    """Odds ratio of the 2 x 2 table with half a record added to each cell."""
    both, only_a, only_b = F.col("n_ab"), F.col("n_a") - F.col("n_ab"), F.col("n_b") - F.col("n_ab")
    none = F.col("n_records") - F.col("n_a") - F.col("n_b") + F.col("n_ab")
    return (both + 0.5) * (none + 0.5) / ((only_a + 0.5) * (only_b + 0.5))


def _number(items: DataFrame) -> DataFrame:
    """Consecutive numbers in code point order, without a global window: counts per range partition, then offsets.

    The number of partitions, not of items, bounds what the driver sees.
    """
    ranged = cut(items.repartitionByRange(8, "item").sortWithinPartitions("item").withColumn("p", F.spark_partition_id()), "ranged-items")
    starts, at = {}, 0
    for p, k in sorted(ranged.groupBy("p").count().collect()):
        starts[p] = at
        at += k
    rank = F.row_number().over(Window.partitionBy("p").orderBy("item")) - 1
    offset = F.coalesce(*(F.when(F.col("p") == p, F.lit(s)) for p, s in starts.items()), F.lit(0))
    return ranged.select("item", "n_item", (rank + offset).cast("long").alias("code"))
