"""Packing of documents into windows by non-negative least squares.

Method (Krell et al. 2021): documents longer than a window are cut into whole
windows and a rest. Lengths fall into classes of ``GRID`` tokens, rounded up.
Every combination of at most three classes that fills a window exactly is
enumerated; non-negative least squares finds how often to repeat each so that
the classes' histogram is used up, measured in tokens. The counts are rounded to
what the histogram holds, and the pieces that remain are packed greedily, the
longest first, each into the fullest sequence that still has room.

Scale: only the histogram, one number a class, reaches the driver, so the
solution costs the same for any number of documents. It says which ranks of a
class go to which sequences. Pieces get their rank within the class by
distributed prefix sums over a hash order and find their sequence by a lookup in
that plan, which has some thousand entries at the most.
"""

from __future__ import annotations

import bisect
import json
import os
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.operators.prefix_sums import exclusive_sums, hash_key
from quern.plans.stage_table import stage_table

WINDOW = 2048
#: Tokens of a class of lengths.
GRID = 8
#: The id that ends every document.
END = 1
#: Characters of a piece of a longer text.
RUN = 1 << 19
#: A space that no token joins to what stands before it, so that both sides are encoded alike on their own.
_CUT = re.compile("(?<=[A-Za-z0-9.,]) (?=[A-Za-z0-9])")
# Fixed values of byte-level vocabularies: what cuts a text before merging.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRE_TOKENIZER = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


def shallow_combinations(classes: int) -> np.ndarray:
    """All multisets of one to three classes that fill a window, a row each; ``classes`` fills it alone, 0 stands for none."""
    pairs = [(a, classes - a, 0) for a in range(1, classes // 2 + 1)]
    triples = [(a, b, classes - a - b) for a in range(1, classes // 3 + 1) for b in range(a, (classes - a) // 2 + 1)]
    return np.array([(classes, 0, 0), *pairs, *triples], np.int64)


def non_negative_least_squares(combos: np.ndarray, wanted: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Repeat counts ``x >= 0`` of the combinations that minimise the weighted squares of ``wanted`` minus use.

    ``wanted`` and ``weight`` have an entry a class, entry 0 being none's. The
    active set method of Lawson and Hanson (1974): the combination with the
    steepest gradient enters, those driven to zero leave.
    """
    square = weight**2
    square[0] = 0
    x, passive = np.zeros(len(combos)), np.zeros(0, np.int64)
    used = np.zeros((len(wanted), 0))
    tolerance = 1e-9 * max(1.0, float((square * wanted).max()))
    for _ in range(6 * len(wanted)):
        rest = wanted - used @ x[passive]
        gradient = (square * rest)[combos].sum(1)
        gradient[passive] = -np.inf
        enters = int(gradient.argmax())
        if gradient[enters] <= tolerance:
            break
        passive = np.append(passive, enters)
        column = np.bincount(combos[enters], minlength=len(wanted)).astype(float)
        used = np.column_stack([used, column])
        while len(passive):
            scaled = used * square[:, None]
            gram = used.T @ scaled
            best = np.linalg.solve(gram + 1e-12 * gram.diagonal().max() * np.eye(len(gram)), scaled.T @ wanted)
            if best.min() > 0:
                x[passive] = best
                break
            now = x[passive]
            down = best <= 0
            step = float((now[down] / np.maximum(now[down] - best[down], 1e-300)).min())
            now = now + step * (best - now)
            stays = (now > 1e-12 * max(1.0, now.max())) & ~(down & (now <= 1e-9))
            x[passive] = np.where(stays, now, 0)
            passive, used = passive[stays], used[:, stays]
    return x


def _rounded(combos: np.ndarray, x: np.ndarray, left: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """``(repeats, {class: pieces})`` of the combinations, the most frequent first; ``left`` loses what they use."""
    out = []
    for k in np.argsort(-x, kind="stable")[: np.count_nonzero(x > 0)]:
        pieces = {int(c): int(n) for c, n in zip(*np.unique(combos[k][combos[k] > 0], return_counts=True), strict=True)}
        repeats = min([int(np.rint(x[k])), *(int(left[c]) // n for c, n in pieces.items())])
        if repeats:
            for c, n in pieces.items():
                left[c] -= repeats * n
            out.append((repeats, pieces))
    return out


def _greedy(left: np.ndarray) -> list[tuple[int, dict[int, int]]]:
    """The remaining pieces, longest first, each into the fullest sequences with room; equal sequences are one entry."""
    full = len(left) - 1
    done, room, open_ = [], [], []  # sequences by falling fullness: ``room`` is sorted, ``open_`` goes with it

    def put(repeats: int, pieces: dict[int, int], free: int) -> None:
        if repeats:
            if free == 0:
                done.append((repeats, pieces))
            else:
                at = bisect.bisect_left(room, free)
                room.insert(at, free)
                open_.insert(at, (repeats, pieces))

    for c in range(full, 0, -1):
        n = int(left[c])
        while n:
            at = bisect.bisect_left(room, c)
            free, (repeats, pieces) = (room.pop(at), open_.pop(at)) if at < len(room) else (full, (n, {}))
            each = free // c
            whole = min(repeats, n // each)
            put(whole, pieces | {c: each}, free - each * c)
            n -= whole * each
            rest = repeats - whole if pieces else 0
            if n and whole < repeats:  # the last sequence takes what is left
                put(1, pieces | {c: n}, free - n * c)
                n, rest = 0, max(rest - 1, 0)
            put(rest, pieces, free)
    return done + open_


def packing_plan(histogram: dict[int, int], classes: int) -> list[tuple[int, dict[int, int]]]:
    """How many sequences hold how many pieces of each class; ``histogram`` counts pieces by class."""
    left = np.zeros(classes + 1, np.int64)
    for c, n in histogram.items():
        left[c] += n
    combos = shallow_combinations(classes)
    # Combinations with a class that has no piece can't be used.
    present = left > 0
    present[0] = True
    combos = combos[present[combos].all(1)]
    plan = []
    if len(combos):
        weight = np.arange(classes + 1) / classes
        plan = _rounded(combos, non_negative_least_squares(combos, left.astype(float), weight), left)
    return plan + _greedy(left)


def _runs(plan: list[tuple[int, dict[int, int]]]) -> pa.Table:
    """``(class, runs)``: from which rank on the pieces of a class go to which sequences, how many to each, and after how many others."""
    taken: dict[int, int] = defaultdict(int)
    runs: dict[int, list[dict]] = defaultdict(list)
    first = 0
    for repeats, pieces in plan:
        slot = 0
        for c, each in sorted(pieces.items(), reverse=True):
            runs[c].append({"from": taken[c], "first": first, "each": each, "slot": slot})
            taken[c] += repeats * each
            slot += each
        first += repeats
    kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("from", "first", "each", "slot")]))
    return pa.table({"class": pa.array(list(runs), pa.int32()), "runs": pa.array(list(runs.values()), kind)})


def _byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}


@lru_cache(maxsize=1)
def _unsettled() -> re.Pattern:
    """Characters whose class, letter, number or other, has changed since Unicode 3.2 or wasn't there then."""
    kind = lambda c: c[0] if c[0] in "LN" else "Z" if c == "Zs" else "-" if c not in ("Cn", "Cs") else c
    old, new = unicodedata.ucd_3_2_0.category, unicodedata.category
    settled = [k for k in range(0x110000) if old(chr(k)) != "Cn" and kind(old(chr(k))) == kind(new(chr(k)))]
    runs, first = [], settled[0]
    for k, after in zip(settled, [*settled[1:], -1], strict=True):
        if after != k + 1:
            runs.append((first, k))
            first = after
    return re.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in runs) + "]")


class Ids:
    """The ids that the tokenizers library gives a text.

    Both libraries cut a text by the same pattern and merge by the same ranks, and
    tiktoken takes a fifth of the time. They may differ on what is a letter or
    number, which Unicode's versions settle. So texts of characters that have had
    their class since Unicode 3.2 go through tiktoken with the ranks of the same
    file, texts with any other character or with a special token's string through
    tokenizers, as do all texts if the file's ids don't follow its ranks.
    """

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer, self.fast, held = Tokenizer.from_str(spec), None, json.loads(spec)
        self.special = [t["content"] for t in held["added_tokens"]]
        vocab, merges = held["model"]["vocab"], held["model"]["merges"]
        made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in merges]
        if made == sorted(made) and held["normalizer"] is None and held["pre_tokenizer"] == PRE_TOKENIZER and len({*made}) + 256 == len(vocab.keys() - {*self.special}):
            import tiktoken

            letters = _byte_letters()
            ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in self.special}
            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def of(self, text: str) -> np.ndarray:
        if self.fast and not any(s in text for s in self.special) and (text.isascii() or not _unsettled().search(text)):
            return np.array(self.fast.encode_ordinary(text), "<u4")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4")


@lru_cache(maxsize=1)
def _encoder(spec: str) -> Ids:
    """The encoder of a tokenizer file's text, which a worker keeps from task to task."""
    return Ids(spec)


def document_ids(spec: str, texts: Iterable[str]) -> Iterator[np.ndarray]:
    """The ids of each text and ``END``; a long text is encoded by pieces that end before a space."""
    encoder = _encoder(spec)
    for text in texts:
        at, parts = 0, []
        while len(text) - at > RUN and (cut := _CUT.search(text, at + RUN)):
            parts.append(encoder.of(text[at : cut.start()]))
            at = cut.start()
        yield np.concatenate([*parts, encoder.of(text[at:]), np.array([END], "<u4")])


def cut_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """``id, start, length, ids_crc32, doc_tokens`` and ``ids`` of every piece: whole windows of a document, then its rest."""
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, start, length, crc, tokens, ids = [], [], [], [], [], []
            for row, whole in enumerate(document_ids(spec.value, (t.as_py() or "" for t in batch.column(1)))):
                for at in range(0, len(whole), window):
                    piece = whole[at : at + window]
                    of.append(row)
                    start.append(at)
                    length.append(len(piece))
                    crc.append(zlib.crc32(piece.tobytes()))
                    tokens.append(len(whole))
                    if with_ids:
                        ids.append(piece)
            columns = [batch.column(0).take(pa.array(of, pa.int64())), *(pa.array(v, pa.int64()) for v in (start, length, crc, tokens))]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                flat = np.concatenate(ids) if ids else np.zeros(0, "<u4")
                columns.append(pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(length)), pa.int32()), pa.array(flat.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids)


def pack_documents(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, grid: int = GRID, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """One row per piece: ``id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset``, and its ``ids`` unless told otherwise.

    Sequences are numbered from 0, their pieces lie from offset 0 on without
    gaps and hold at most ``window`` tokens together. A null text counts as
    empty: the id that ends documents alone. Strings of the special tokens
    within a text are these tokens, as the library has it. A very long text is
    encoded by pieces and cut into whole windows. Repeated rows are documents of
    their own, a null id stays null, an empty table gives an empty one; other
    columns are ignored. ``window`` is a multiple of ``grid``.
    """
    if window % grid:
        raise ValueError("the window is a multiple of the grid")
    spark = docs.sparkSession
    pieces = cut_documents(docs, tokenizer_path, window, id_col, text_col, with_ids)
    pieces = pieces.withColumn("class", F.ceil(F.col("length") / grid).cast("int")).withColumn("key", hash_key("id", "start", "ids_crc32"))
    pieces = stage_table(pieces, "pieces")
    histogram = {r["class"]: r["n"] for r in pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(_runs(packing_plan(histogram, window // grid)), "class int, runs array<struct<from:long,first:long,each:long,slot:long>>")
    carried = ["id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
    ranked = exclusive_sums(pieces.withColumn("one", F.lit(1).cast("long")), ["class"], "key", "one", "rank", sum(histogram.values()), ("id", "start", "ids_crc32"))
    run = F.element_at(F.filter("runs", lambda r: r["from"] <= F.col("rank")), -1)
    placed = ranked.join(F.broadcast(runs), "class").withColumn("run", run).withColumn("place", F.col("rank") - F.col("run.from"))
    placed = placed.select(*carried, (F.col("run.first") + F.floor(F.col("place") / F.col("run.each"))).cast("long").alias("sequence_id"), (F.col("run.slot") + F.col("place") % F.col("run.each")).alias("slot"))
    before = F.sum("length").over(Window.partitionBy("sequence_id").orderBy("slot"))
    return placed.withColumn("offset", (before - F.col("length")).cast("long")).select(F.col("id").alias(id_col), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def packed_sequences(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``sequence_id, ids, starts, doc_ids``: each sequence's ids in order, where its pieces begin, and whose they are.

    ``pieces`` are what :func:`pack_documents` returns with ids. Null ids stay as nulls within the list.
    """
    held = F.sort_array(F.collect_list(F.struct("offset", F.col(id_col).alias("doc"), "ids")))
    return pieces.groupBy("sequence_id").agg(held.alias("held")).select(
        "sequence_id", F.flatten("held.ids").alias("ids"), F.col("held.offset").alias("starts"), F.col("held.doc").alias("doc_ids")
    )
