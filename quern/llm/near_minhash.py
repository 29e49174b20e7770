"""Near-duplicate documents by SetSketch registers over word shingles.

Method: every document's set of five-word shingles is summed up in registers
``floor(1 - log_b(min_d h_i(d)))`` of exponentially distributed hashes, the
exponentially spaced truncated minima of the SetSketch paper (Ertl 2021).
Registers are mergeable by their maximum and equal with about the probability
of the Jaccard similarity; runs of registers are band keys. Candidates of a
band are first compared by the maximum-likelihood joint estimate from their
registers, then by their full shingle sets.

Completeness: bands and rows follow from the threshold, so that a pair at it is
missed with probability 3e-6 at most (at 0.85 by 40 bands of 8 registers, at 0.80
by 42 of 6). In a band every document is compared with the band's most
central one; where these links leave a band in several components, its
documents are compared across components by an exact join on their rarest
shingles, so no link that would join two classes stays untested, however large
a band is. Only documents that some band puts together are shuffled with their
texts, the others are left where they are if the ids to choose are few.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.components import connected_components
from quern.llm.text_bytes import LOWER, chunks, frugal, mix, random_words, run_hashes, words
from quern.plans.stage_table import drop_stage_table, stage_table

SHINGLE = 5
REGISTERS = 320
#: Probability that no band holds a pair at the threshold.
MISS = 3e-6
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: A candidate whose joint estimate lies this far below the threshold is dropped
#: (more than five standard deviations of the estimate).
SLACK = 0.12
#: Members of one leader that are verified in one group.
GROUP = 128
#: Documents of a shingle that are compared in one block.
BLOCK = 4096
#: Ids up to which a table of them is broadcast (8 MB), so that only the rows that they name are shuffled.
SMALL = 1_000_000

_PLACES = random_words(SHINGLE + 1, 11) | np.uint64(1)
_A = (random_words(REGISTERS, 21) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_B = (random_words(REGISTERS, 22) >> np.uint64(32)).astype(np.uint32)


def bands_and_rows(percent: int) -> tuple[int, int]:
    """As many registers a band as leave a pair at ``percent`` missed with probability ``MISS`` at most."""
    for rows in range(REGISTERS, 0, -1):
        alike = (percent / 100) ** rows
        bands = math.ceil(math.log(MISS) / math.log1p(-alike)) if alike < 1 else 1
        if bands * rows <= REGISTERS:
            return bands, rows
    return REGISTERS, 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each row; shorter rows give one hash, empty ones none."""
    data = LOWER[data]
    starts, ends, row = words(data, offsets)
    word = run_hashes(data, starts, ends, 1)
    n_rows = len(offsets) - 1
    first = np.searchsorted(row, np.arange(n_rows + 1))
    out = [np.zeros(0, np.uint64)] * n_rows
    if len(word) >= SHINGLE:
        run = len(word) - SHINGLE + 1
        joint = np.zeros(run, np.uint64)
        for k in range(SHINGLE):
            joint += word[k : k + run] * _PLACES[k]
        joint = mix(joint)
    for i in range(n_rows):
        n = first[i + 1] - first[i]
        if n >= SHINGLE:
            out[i] = np.unique(joint[first[i] : first[i + 1] - SHINGLE + 1])
        elif n:
            few = word[first[i] : first[i + 1]]
            out[i] = mix((few * _PLACES[:n]).sum(dtype=np.uint64, keepdims=True) + _PLACES[SHINGLE : SHINGLE + 1] * np.uint64(n))
    return out


def registers(shingles: np.ndarray) -> np.ndarray:
    """The SetSketch registers of a set that isn't empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    least = np.full(REGISTERS, np.iinfo(np.uint32).max, np.uint32)
    for at in range(0, len(x), 2048):
        np.minimum(least, (_A[:, None] * x[None, at : at + 2048] + _B[:, None]).min(axis=1), out=least)
    drawn = -np.log1p(-(least.astype(np.float64) + 0.5) / 2.0**32) / RATE
    return np.clip(np.floor(1 - np.log(drawn) / np.log(BASE)), 0, LIMIT + 1).astype("<u2")


def joint_estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Maximum-likelihood Jaccard similarities of register rows with known set sizes."""
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = a.shape[1] - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    scale = np.log(BASE)

    def chance(x: np.ndarray) -> np.ndarray:
        return np.maximum(-np.log1p(-x * (BASE - 1) / BASE) / scale, 1e-12)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = chance(np.maximum(u - v * j, 0)), chance(np.maximum(v - u * j, 0))
        return more * np.log(p) + less * np.log(q) + same * np.log(np.maximum(1 - p - q, 1e-12))

    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)
    for _ in range(40):  # the likelihood has one maximum
        left, right = low + (high - low) / 3, high - (high - low) / 3
        rising = likelihood(left) < likelihood(right)
        low, high = np.where(rising, left, low), np.where(rising, high, right)
    return (low + high) / 2


@frugal
def _sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(1)):
            sets = shingle_sets(data, offsets)
            regs = [registers(s).tobytes() if len(s) else None for s in sets]
            hi = [int(mix(s * np.uint64(3)).sum(dtype=np.uint64).view(np.int64)) if len(s) else None for s in sets]
            lo = [int(np.bitwise_xor.reduce(mix(s + np.uint64(7))).view(np.int64)) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, end - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(hi, pa.int64()), pa.array(lo, pa.int64()), pa.array(regs, pa.binary())],
                ["id", "n_shingles", "key_hi", "key_lo", "regs"],
            )


def _verified(percent: int):
    """Rows (leader, part, id, text), a leader's own first -> (a, b) of confirmed links."""

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, leaders = None, []
        for batch in batches:
            group, part, ids = (batch.column(i).to_pylist() for i in range(3))
            a, b = [], []
            for first, _, data, offsets in chunks(batch.column(3)):
                for k, s in enumerate(shingle_sets(data, offsets), first):
                    if key != (group[k], part[k]):
                        key, leaders = (group[k], part[k]), []
                    if ids[k] == group[k]:
                        leaders.append(s)
                        continue
                    for other in leaders:
                        common = len(s) + len(other) - len(np.union1d(s, other))
                        if 100 * common >= percent * (len(s) + len(other) - common):
                            a.append(group[k])
                            b.append(ids[k])
                            break
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def _likely(threshold: float):
    @F.pandas_udf("boolean")
    def likely(a: pd.Series, b: pd.Series, n_a: pd.Series, n_b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=bool)
        x, y = (np.frombuffer(b"".join(s), "<u2").reshape(len(s), REGISTERS) for s in (a, b))
        return pd.Series(joint_estimate(x, y, n_a.to_numpy(float), n_b.to_numpy(float)) >= threshold)

    return likely


def _named(rows: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows with these ids, chosen in place where the ids are few; else all rows, for a join to choose from."""
    return rows.join(F.broadcast(ids), "id", "left_semi") if ids.count() <= SMALL else rows


def confirmed_links(pairs: DataFrame, sketches: DataFrame, texts: DataFrame, percent: int, spent: list[DataFrame]) -> DataFrame:
    """``pairs(leader, node)`` -> those whose full sets reach ``percent``, as ``(a, b)``; ``spent`` gets the tables on the way."""
    asked = stage_table(pairs.select(F.explode(F.array("leader", "node")).alias("id")).distinct(), "asked")
    own = _named(sketches.where("regs is not null").select("id", "n_shingles", "regs"), asked)
    left = own.select(F.col("id").alias("leader"), F.col("n_shingles").alias("n_a"), F.col("regs").alias("regs_a"))
    right = own.select(F.col("id").alias("node"), F.col("n_shingles").alias("n_b"), F.col("regs").alias("regs_b"))
    likely = (
        pairs.join(right.hint("merge"), "node")
        .join(left.hint("merge"), "leader")
        .where(F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b"))
        .where(_likely(percent / 100 - SLACK)("regs_a", "regs_b", "n_a", "n_b"))
        .select("leader", "node")
        .distinct()
    )
    likely = stage_table(likely, "likely")
    parts = likely.groupBy("leader").agg(F.ceil(F.count(F.lit(1)) / GROUP).cast("int").alias("parts"))
    members = likely.join(parts, "leader").select("leader", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int").alias("part"), F.col("node").alias("id"))
    heads = parts.select("leader", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("leader").alias("id"))
    asked = stage_table(members.union(heads), "asked")
    spent += [likely, asked]
    return (
        _named(texts, asked.select("id").distinct())
        .join(asked.hint("merge"), "id")
        .select("leader", "part", "id", "text")
        .repartition("leader", "part")
        .sortWithinPartitions("leader", "part", F.col("id") != F.col("leader"))
        .mapInArrow(_verified(percent), "a long, b long")
    )


@frugal
def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(2)):
            sets = [s.view(np.int64) for s in shingle_sets(data, offsets)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), batch.column(1).slice(first, end - first), pa.array(sets, pa.list_(pa.int64()))], ["node", "c", "shingles"])


def remaining_links(nodes: DataFrame, texts: DataFrame, percent: int, spent: list[DataFrame] | None = None) -> DataFrame:
    """Confirmed links ``(a, b)`` between different components ``c`` of ``nodes(node, c)``, none left out.

    Two sets at the threshold share one of the rarest shingles of each, as many
    as the smaller may lack, so only documents that share one of these are
    compared. In a group of edited copies these are the edits themselves: what
    all copies have in common brings no pair together. A shingle of many
    documents is dealt out in blocks: each document once to one block, and once
    to all as one to be compared with.
    """
    spent = spent if spent is not None else []
    nodes = stage_table(nodes, "left")
    sets = _named(texts, nodes.select(F.col("node").alias("id")).distinct()).join(nodes.hint("merge"), F.col("id") == F.col("node")).select("node", "c", "text")
    sets = stage_table(sets.mapInArrow(_sets, "node long, c long, shingles array<long>"), "sets")
    single = sets.select("node", "c", F.size("shingles").alias("n"), F.explode("shingles").alias("shingle"))
    used = single.groupBy("shingle").agg(F.count(F.lit(1)).alias("uses"))
    ranked = single.join(used.hint("merge"), "shingle")
    rarest = Window.partitionBy("node").orderBy("uses", "shingle")
    most = F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1
    ranked = ranked.withColumn("i", F.row_number().over(rarest)).where((F.col("i") <= most) & (F.col("uses") > 1))
    blocks = F.ceil(F.col("uses") / BLOCK).cast("int")
    rare = stage_table(ranked.select("shingle", "node", "c", "n", "i", blocks.alias("blocks")), "rare")
    spent += [nodes, sets, rare]
    # The smaller set looks at fewer shingles yet, and what follows both places must suffice.
    other = rare.withColumn("at", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    other = other.select("at", F.col("shingle").alias("s"), F.col("node").alias("leader"), F.col("c").alias("d"), F.col("n").alias("k"), F.col("i").alias("j"))
    other = other.where(F.col("j") <= F.col("k") - F.ceil(F.lit(2 * percent) * F.col("k") / (100 + percent)) + 1)
    smaller = (F.col("k") < F.col("n")) | ((F.col("k") == F.col("n")) & (F.col("leader") < F.col("node")))
    enough = F.least(F.col("n") - F.col("i"), F.col("k") - F.col("j")) + 1 >= F.ceil(F.lit(percent) * (F.col("n") + F.col("k")) / (100 + percent))
    dealt = rare.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    near = (F.col("shingle") == F.col("s")) & (F.col("block") == F.col("at")) & smaller & enough & (F.col("c") != F.col("d")) & (100 * F.col("k") >= percent * F.col("n"))
    pairs = dealt.join(other, near).select("leader", "node").distinct()
    a = sets.select(F.col("node").alias("leader"), F.col("shingles").alias("x"))
    both = pairs.join(sets.select("node", F.col("shingles").alias("y")).hint("merge"), "node").join(a.hint("merge"), "leader")
    common = F.size(F.array_intersect("x", "y"))
    return both.where(100 * common >= percent * (F.size("x") + F.size("y") - common)).select(F.col("leader").alias("a"), F.col("node").alias("b"))


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: ``id_col, n_shingles, component_id, kept``.

    Two documents are linked when 100 * intersection >= ``percent`` * union of
    their distinct five-word shingles (A-Z lower-cased, words of ASCII white
    space); with fewer words the whole sequence is one shingle. Null, empty and
    blank texts have no shingle and are linked with nothing. Rows with equal ids
    and different texts each have the class of their text, but an id that is the
    smallest of two classes joins them; a row whose id is null is linked with
    nothing and has a null component. Equal sets are one class from the
    start, so groups of copies cost one comparison. An empty table gives an
    empty one; a very long text is hashed by itself, in some 60 times its size.
    Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    sketches = stage_table(texts.mapInArrow(_sketches, "id long, n_shingles long, key_hi long, key_lo long, regs binary"), "sketches")
    classes = sketches.where("regs is not null and id is not null").groupBy("key_hi", "key_lo", "n_shingles").agg(F.min("id").alias("rep"))
    classes = stage_table(classes, "classes")
    own = classes.select(F.col("rep").alias("id"))
    reps = sketches.where("regs is not null").join(F.broadcast(own) if classes.count() <= SMALL else own.hint("merge"), "id", "left_semi")
    n_bands, n_rows = bands_and_rows(percent)
    bands = F.transform(F.sequence(F.lit(0), F.lit(n_bands - 1)), lambda i: F.xxhash64(i, F.substring("regs", i * 2 * n_rows + 1, F.lit(2 * n_rows))))
    rows = stage_table(reps.select(F.col("id").alias("node"), F.explode(bands).alias("band")), "bands")
    shared = rows.groupBy("band").agg(F.count(F.lit(1)).alias("size"), F.min("node").alias("first"), F.max("node").alias("last")).where("first <> last")
    together = stage_table(rows.join(shared.select("band", "size").hint("merge"), "band"), "members")
    drop_stage_table(rows)
    # The member that shares bands with most documents leads: in a group of near copies, the one they were made from.
    central = together.groupBy("node").agg(F.sum("size").alias("score"))
    members = together.join(central.hint("merge"), "node")
    leaders = members.groupBy("band").agg(F.max(F.struct("score", (-F.col("node")).alias("by"))).alias("top")).select("band", (-F.col("top.by")).alias("leader"))
    members = stage_table(members.select("band", "node").join(leaders.hint("merge"), "band"), "members")
    drop_stage_table(together)
    spent: list[DataFrame] = [members]
    links = stage_table(confirmed_links(members.where("node <> leader").select("leader", "node").distinct(), sketches, texts, percent, spent), "links")
    found = stage_table(connected_components(links), "components")

    # Bands whose members the leaders have not brought together.
    placed = members.join(found.hint("merge"), "node", "left").select("band", "node", F.coalesce("component", "node").alias("c"))
    mixed = placed.groupBy("band").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("band")
    left = placed.join(mixed.hint("merge"), "band").select("node", "c").distinct()
    more = stage_table(remaining_links(left, texts, percent, spent), "links")
    if not more.isEmpty():
        found = stage_table(connected_components(links.union(more)), "components")
    for done in (*spent, links, more):  # the result reads only sketches, classes and components
        drop_stage_table(done)

    placed = classes.join(found, classes["rep"] == found["node"], "left").select("key_hi", "key_lo", F.col("n_shingles").alias("n"), F.coalesce("component", "rep").alias("class"))
    whole = sketches.join(placed, (sketches["key_hi"] == placed["key_hi"]) & (sketches["key_lo"] == placed["key_lo"]) & (sketches["n_shingles"] == placed["n"]) & F.col("id").isNotNull(), "left")
    component = F.coalesce("class", "id")
    return whole.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(False)).alias("kept"))
