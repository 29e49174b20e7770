"""Shards of near equal bytes by longest-processing-time scheduling.

Method: groups that must stay together are sorted by size, largest first, and
each goes to the least-loaded shard through a heap (Graham 1969). Groups of
equal size are interchangeable, so the schedule is made from the histogram of
sizes: a size with few groups goes through the heap one by one, of a size with
many the heap's outcome is computed at once. Groups of a size are then handed
out by their rank in a hash order, which is a distributed prefix sum. So every
group is scheduled as the method has it, at any scale.

The histogram is what reaches the driver. It has one row for each distinct group
size, so n bytes of text give at most the square root of 2 * n rows (14 million
for 100 TB, if there are groups of every size up to 14 MB), 16 bytes each.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators.prefix_sums import KEY_BITS, exclusive_sums, hash_key
from quern.plans.stage_table import stage_table

SHARDS = 16
#: Groups that hold at least one in so many rows are joined by a broadcast; there are at most as many.
HOT = 4096
#: Sizes up to which their schedule is broadcast; more are joined by a shuffle.
SMALL = 100_000


def longest_first(sizes: np.ndarray, counts: np.ndarray, shards: int) -> np.ndarray:
    """How many groups of each size each shard gets, a row for each of the sizes, which are in falling order.

    Largest first, each group to the shard with the least load, of equal ones to
    the first.
    """
    loads = [(0, s) for s in range(shards)]
    out = np.zeros((len(sizes), shards), np.int64)
    for row, size, count in zip(out, sizes.tolist(), counts.tolist(), strict=True):
        if count > 4 * shards:
            # As many whole levels as fit: all groups that a heap hands out below a load that all shards reach.
            now = np.array([load for load, _ in sorted(loads, key=lambda x: x[1])], dtype=object)
            low, high = int(now.min()), int(now.max()) + size * count
            below = lambda level: [max(0, -((load - level) // size)) for load in now]  # noqa: B023, E731
            while low < high:
                level = (low + high + 1) // 2
                low, high = (level, high) if sum(below(level)) <= count else (low, level - 1)
            given = below(low)
            row += given
            count -= sum(given)
            loads = [(load + n * size, s) for s, (load, n) in enumerate(zip(now, given, strict=True))]
            heapq.heapify(loads)
        for _ in range(count):
            load, shard = loads[0]
            heapq.heapreplace(loads, (load + size, shard))
            row[shard] += 1
    return out


def _cuts(sizes: np.ndarray, given: np.ndarray) -> pa.Table:
    """``(size, cuts)``: from which rank on groups of a size go to which shard."""
    row, shard = np.nonzero(given)
    before = (given.cumsum(1) - given)[row, shard]
    offsets = np.append(0, np.cumsum((given > 0).sum(1)))
    pairs = pa.StructArray.from_arrays([pa.array(before), pa.array(shard.astype(np.int32))], ["from", "shard"])
    return pa.table({"size": pa.array(sizes, pa.int64()), "cuts": pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pairs)})


def assign_shards(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS) -> DataFrame:
    """One row per document: ``id_col, size, text_crc32, law, shard, slot, grown_shard``.

    Rows of equal texts are one group; null counts as the empty text. The size
    is the text's UTF-8 bytes plus 1, a group's the sum of its rows'. ``law`` is
    ``bytes``: the shards' sizes are nearly equal, unless one group alone passes
    the mean. ``slot`` counts each shard's rows from 0 without gaps, in the
    order of a hash of id and text; repeated rows have any order among them.
    ``grown_shard`` is null under this law. An empty table gives an empty one, a
    null id stays null, a very long text costs its checksums. Other columns are
    ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col), F.lit("")).cast("binary")
    rows = docs.select(F.col(id_col).alias("id_"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.md5(text)).alias("group_"))
    rows = stage_table(rows.withColumn("key", hash_key("id_", F.hex("group_"))), "rows")
    n_rows = rows.count()
    one = F.lit(1).cast("long")
    groups = stage_table(rows.groupBy("group_").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("n")), "groups")
    histogram = groups.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).toArrow()
    sizes, counts = (histogram.column(c).to_numpy() for c in ("size", "n"))
    cuts = spark.createDataFrame(_cuts(sizes, longest_first(sizes, counts, shards)), "size long, cuts array<struct<from:long,shard:int>>")
    ranked = groups.withColumn("key", F.conv(F.substring(F.hex("group_"), 1, KEY_BITS // 4), 16, 10).cast("long")).withColumn("one", one)
    ranked = exclusive_sums(ranked, ["size"], "key", "one", "rank", int(counts.sum()), ("group_",))
    chosen = F.element_at(F.filter("cuts", lambda c: c["from"] <= F.col("rank")), -1)["shard"]
    placed = ranked.join(F.broadcast(cuts) if len(sizes) <= SMALL else cuts, "size").select("group_", "n", chosen.alias("shard"))
    placed = stage_table(placed, "placed")

    hot = placed.where(F.col("n") * HOT >= n_rows)
    found = rows.join(F.broadcast(hot.select("group_", "shard")), "group_", "left")
    rest = found.where("shard is null").drop("shard").join(placed.where(F.col("n") * HOT < n_rows).select("group_", "shard"), "group_")
    columns = ["id_", "size", "text_crc32", "shard", "key"]
    found = found.where("shard is not null").select(columns).union(rest.select(columns)).withColumn("one", one)
    out = exclusive_sums(stage_table(found, "shards"), ["shard"], "key", "one", "slot", n_rows)
    return out.select(F.col("id_").alias(id_col), "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
