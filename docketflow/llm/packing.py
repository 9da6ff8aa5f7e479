"""Filling fixed-capacity containers with documents (problem 8).

Shortest-pack-first over the length histogram: lengths are placed longest first,
each into the containers with the most free space. Containers of equal content
are one pattern with a count; placing a length updates the counts. The driver's
work and memory depend on the number of lengths, which the capacity bounds, and
not on the number of documents: a length adds at most two patterns, so there are
at most twice as many patterns as lengths, and a pattern holds at most
sqrt(2 * capacity) different lengths.

Patterns are joined back to documents by rank: a pattern takes a range of the
ranks of each of its lengths. Ranges are cut into blocks of ranks, so that
(limit, length, block) is an equi-join. A length's blocks are as long as its
ranges are on average, hence a document meets three ranges on average at most,
and no block is longer than ``BLOCK`` ranks, however frequent a length is.

A document longer than the capacity fills containers of its own; only its rest is
packed with others. Ranks come from counts per scan partition and length, so that
no length, however frequent, is gathered in one task.

Cases: null and empty texts have no tokens; they are spread over the containers
and take no space (if nothing else is packed, one empty container holds them).
Equal texts are documents of their own. An empty table gives no rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docketflow.llm.tokens import VOCABULARY, token_ids
from docketflow.operators.prefix import running_totals
from docketflow.runtime import cut

COUNTED = "doc_id bigint, n_tokens int, part int, k bigint"
PLAN = "limit_id int, rest int, block bigint, first bigint, n bigint, container bigint, boxes bigint, unused int"
BLOCK = 1_000_000


def count_tokens(documents: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, n_tokens, part, k): token count, scan partition, and rank within the partition among equal counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), {}
        for b in batches:
            counts, ranks = [], []
            for text in b.column(1):
                n = len(token_ids(text.as_py(), vocabulary)) if text.is_valid else 0
                counts.append(n)
                ranks.append(seen.get(n, 0))
                seen[n] = ranks[-1] + 1
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(counts, pa.int32()), pa.array([part] * len(counts), pa.int32()), pa.array(ranks, pa.int64())],
                names=["doc_id", "n_tokens", "part", "k"],
            )

    return cut(documents.select("doc_id", "text").mapInArrow(run, COUNTED), "token-counts")


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[int, int, dict[int, int]]]:
    """Patterns (containers, free space, {length: times}) in which the documents of ``histogram`` (length: documents) fit."""
    # free space -> patterns (containers, content); content is a chain (length, content before it)
    spaces: dict[int, list[tuple[int, tuple | None]]] = {}
    order: list[int] = []  # heap of negated free spaces

    def put(space: int, count: int, content: tuple | None) -> None:
        if space not in spaces:
            spaces[space] = []
            heapq.heappush(order, -space)
        spaces[space].append((count, content))

    for length in sorted((x for x in histogram if x > 0), reverse=True):
        left = histogram[length]
        while left:
            if not order or -order[0] < length:
                put(capacity, -(-left // (capacity // length)), None)
            space = -order[0]
            count, content = spaces[space].pop()
            if not spaces[space]:
                del spaces[space]
                heapq.heappop(order)
            taken = min(count, left)
            put(space - length, taken, (length, content))
            if count > taken:
                put(space, count - taken, content)
            left -= taken
    patterns = []
    for space, same in sorted(spaces.items()):
        for count, content in same:
            times: dict[int, int] = {}
            while content is not None:
                times[content[0]] = times.get(content[0], 0) + 1
                content = content[1]
            patterns.append((count, space, times))
    return patterns


def block_size(n_documents: int, n_ranges: int, most: int) -> int:
    """Ranks per block: the mean length of a range, so that meeting all ranges of a block stays linear in the documents."""
    return max(1, min(most, n_documents // max(1, n_ranges)))


def rank_ranges(histogram: dict[int, int], capacity: int, most: int = BLOCK) -> tuple[list[tuple[int, int, int, int, int, int, int]], dict[int, int], int]:
    """Ranges (length, block, first rank, ranks, first container, containers, free space), ranks per block by length, and the number of containers.

    Documents without tokens go round all containers.
    """
    patterns = pack_histogram(histogram, capacity)
    opened = sum(count for count, _, _ in patterns)
    empty = histogram.get(0, 0)
    if empty and not opened:
        patterns, opened = [(1, capacity, {})], 1
    ranges: dict[int, list[tuple[int, int, int, int]]] = {}
    at = 0
    for count, space, times in patterns:
        for length, k in times.items():
            ranges.setdefault(length, []).append((k * count, at, count, space))
        if empty:
            ranges.setdefault(0, []).append((-(-empty // opened) * count, at, count, space))
        at += count
    rows, sizes = [], {}
    for length, of_length in ranges.items():
        size = sizes[length] = block_size(histogram[length], len(of_length), most)
        first = 0
        for n, container, boxes, space in of_length:
            end = min(first + n, histogram[length])
            rows += [(length, block, first, n, container, boxes, space) for block in range(first // size, -(-end // size) if end > first else first // size)]
            first += n
    return rows, sizes, opened


def pack(counted: DataFrame, limits: list[tuple[int, int]], block: int = BLOCK) -> DataFrame:
    """(limit_id, container_id, doc_id, piece, piece_tokens, unused_tokens) for each (limit_id, capacity).

    ``limits`` is a short list of sizes to try. piece counts from 0 within a
    document; unused_tokens is the free space of the container.
    """
    spark = counted.sparkSession
    cells = cut(counted.groupBy("n_tokens", "part").agg(F.count(F.lit(1)).alias("n")), "token-histogram")
    sizes = F.array(*(F.struct(F.lit(limit).cast("int").alias("limit_id"), F.lit(capacity).cast("int").alias("capacity")) for limit, capacity in limits))
    over = F.col("n_tokens") > F.col("capacity")
    by_limit = (
        cells.select("*", F.inline(sizes))
        .select(
            "*",
            F.when(over, F.col("n_tokens") % F.col("capacity")).otherwise(F.col("n_tokens")).alias("rest"),
            F.when(over, F.floor(F.col("n_tokens") / F.col("capacity"))).otherwise(F.lit(0)).cast("long").alias("whole"),
        )
        .withColumn("packed", (F.col("rest") > 0) | (F.col("n_tokens") == 0))
    )
    # at most `capacity` rows per limit
    histograms: dict[int, dict[int, int]] = {limit: {} for limit, _ in limits}
    for limit, rest, n in by_limit.filter("packed").groupBy("limit_id", "rest").agg(F.sum("n")).collect():
        histograms[limit][rest] = n
    plan, spans, opened = [], [], {}
    for limit, capacity in limits:
        ranges, sizes_of, opened[limit] = rank_ranges(histograms[limit], capacity, block)
        plan += [(limit, *r) for r in ranges]
        spans += [(limit, length, size) for length, size in sizes_of.items()]
    names = [c.split()[0] for c in PLAN.split(", ")]
    plan_table = cut(spark.createDataFrame(pd.DataFrame(plan, columns=names).astype("int64"), PLAN), "packing-plan")
    span_table = spark.createDataFrame(pd.DataFrame(spans, columns=["limit_id", "rest", "size"]).astype("int64"), "limit_id int, rest int, size bigint")

    before = Window.partitionBy("limit_id", "rest").orderBy("n_tokens", "part").rowsBetween(Window.unboundedPreceding, -1)
    starts = by_limit.filter("packed").withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0))).join(span_table, ["limit_id", "rest"])
    ranked = counted.join(starts.select("limit_id", "n_tokens", "part", "rest", "whole", "start", "size"), ["n_tokens", "part"]).withColumn("rank", F.col("start") + F.col("k"))
    packed = (
        ranked.withColumn("block", F.floor(F.col("rank") / F.col("size")).cast("long"))
        .join(plan_table, ["limit_id", "rest", "block"])
        .filter((F.col("rank") >= F.col("first")) & (F.col("rank") < F.col("first") + F.col("n")))
        .select(
            "limit_id", (F.col("container") + (F.col("rank") - F.col("first")) % F.col("boxes")).alias("container_id"), "doc_id",
            F.col("whole").cast("int").alias("piece"), F.col("rest").alias("piece_tokens"), F.col("unused").alias("unused_tokens"),
        )
    )
    return packed.unionByName(_pieces(counted, by_limit.filter("whole > 0"), opened))


def _pieces(counted: DataFrame, large: DataFrame, opened: dict[int, int]) -> DataFrame:
    """Containers filled by one piece of an oversize document each, numbered after those that are shared."""
    totals = running_totals(large.withColumn("full", F.col("n") * F.col("whole")), ["limit_id", "n_tokens", "part"], {"upto": "full"})
    # a limit's numbers begin after the pieces of the limits before it, which come first in that order
    base, per_limit = 0, dict(totals.groupBy("limit_id").agg(F.sum("full")).collect())
    offset = F.lit(None).cast("long")
    for limit in sorted(opened):
        offset = F.when(F.col("limit_id") == limit, F.lit(opened[limit] - base).cast("long")).otherwise(offset)
        base += per_limit.get(limit, 0)
    starts = totals.select("limit_id", "capacity", "n_tokens", "part", "whole", (F.col("upto") - F.col("full") + offset).alias("start"))
    each = counted.join(starts, ["n_tokens", "part"]).select("limit_id", "capacity", "doc_id", (F.col("start") + F.col("k") * F.col("whole")).alias("start"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("piece"))
    return each.select(
        "limit_id", (F.col("start") + F.col("piece")).alias("container_id"), "doc_id", F.col("piece").cast("int").alias("piece"), F.col("capacity").alias("piece_tokens"), F.lit(0).alias("unused_tokens")
    )


def fill_report(placed: DataFrame, limits: list[tuple[int, int]]) -> DataFrame:
    """(limit_id, capacity_tokens, n_containers, used_tokens, unused_tokens, least_containers) per size."""
    capacity = placed.sparkSession.createDataFrame(limits, "limit_id int, capacity_tokens int")
    boxes = placed.groupBy("limit_id", "container_id").agg(F.sum("piece_tokens").alias("used"))
    per = boxes.groupBy("limit_id").agg(F.count(F.lit(1)).alias("n_containers"), F.sum("used").alias("used_tokens"))
    return per.join(F.broadcast(capacity), "limit_id").select(
        "limit_id",
        "capacity_tokens",
        "n_containers",
        "used_tokens",
        (F.col("n_containers") * F.col("capacity_tokens") - F.col("used_tokens")).alias("unused_tokens"),
        F.ceil(F.col("used_tokens") / F.col("capacity_tokens")).alias("least_containers"),
    )
