"""A choice in order by several keys, as a loop would make it, in rounds."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.plans.stage_table import drop_stage_table, stage_table

#: Rows that are left after a round and that one task may then settle in order.
TAIL = 100_000


def first_choice(rows: DataFrame, order: str, *keys: str, tail: int = TAIL, rounds: list[int] | None = None) -> DataFrame:
    """JON-02 within a batch: rows in ``order`` are kept unless a kept one before has one of their ``keys``.

    A row that isn't kept bars none after it, so a key's first row doesn't
    decide by itself. A null key equals none. Rows of equal ``order`` must be equal
    and count once.

    In a round each row that is the first of all its live keys is kept, and
    those that share a key with a kept one go; the first live row of all is always
    kept, so rounds end. Where repeats are plain copies the first round settles
    all; what a loop needs more rounds for are chains of rows that share the
    one key with the row before and the other with the row after. Once ``tail``
    rows are live or fewer, one task settles these in order. Only order and keys
    travel; ``rounds`` gets the number of live rows before each round.
    """
    named = [f"k{i}_" for i in range(len(keys))]
    live = rows.select(F.col(order).alias("o_"), *[F.col(k).alias(n) for k, n in zip(keys, named, strict=True)]).distinct()
    free = reduce(lambda a, b: a & b, [F.col(n).isNull() for n in named])
    live = stage_table(live, "live")
    kept, live = [live.where(free).select("o_")], stage_table(live.where(~free), "live")
    while (n := live.count()) > tail:
        if rounds is not None:
            rounds.append(n)
        best = live
        for k in named:
            first = live.where(F.col(k).isNotNull()).groupBy(F.col(k).alias("key_")).agg(F.min("o_").alias("first_")).withColumn("is_first_", F.lit(True))
            # Joined by key and order, so that a key that many rows share is not one task's.
            best = best.join(first, (F.col(k) == F.col("key_")) & (F.col("o_") == F.col("first_")), "left").where(F.col("is_first_") | F.col(k).isNull()).select("o_", *named)
        best = stage_table(best, "chosen")
        rest = live
        for k in named:
            rest = rest.join(best.where(F.col(k).isNotNull()).select(k), k, "left_anti")
        rest = stage_table(rest.select("o_", *named), "live")
        kept.append(best.select("o_"))
        drop_stage_table(live)
        live = rest

    def settle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: list[set] = [set() for _ in named]
        for batch in batches:
            take = []
            for at, own in enumerate(zip(*(batch.column(n).to_pylist() for n in named), strict=True)):
                if not any(v in s for v, s in zip(own, seen, strict=True)):
                    take.append(at)
                    for v, s in zip(own, seen, strict=True):
                        if v is not None:
                            s.add(v)
            yield batch.select(["o_"]).take(pa.array(take, pa.int64()))

    kind = live.select("o_").schema
    kept.append(live.repartition(1).sortWithinPartitions("o_").mapInArrow(settle, kind))
    chosen = reduce(DataFrame.union, kept).withColumnRenamed("o_", "kept_")
    # The join has put equal orders together, so that repeats of a kept row go without another exchange.
    return rows.join(chosen, F.col(order) == F.col("kept_"), "left_semi").dropDuplicates([order])
