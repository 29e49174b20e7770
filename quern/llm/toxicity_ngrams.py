"""Toxicity of whole texts by a linear classifier over character n-grams.

Method: the presence of hashed byte n-grams (a word's, with its borders) is
scaled by naive Bayes log-count ratios and weighed by a regularised logistic
regression (Wang & Manning 2012). Counts come from a bounded sample of labelled
documents (``labelled.FIT_ROWS``) in one distributed aggregation; the ``SLOTS``
n-grams whose rates differ most between the classes become features, and only
their occurrences in the sample reach the driver. Scoring is one pass.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.labelled import FIT_ROWS, fit_rows, scored
from quern.llm.text_bytes import LOWER, chunks, mix, random_words
from quern.plans.stage_table import stage_table

SIZES = (4, 5, 6)
BITS = 20
SLOTS = 2048
SMOOTHING, PENALTY, STEPS = 0.5, 2e-4, 400

_BORDER = np.array([not (chr(c).isalnum() or c >= 128) for c in range(256)])
_PLACES = random_words(8, 31) | np.uint64(1)


def ngram_codes(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, code) of every n-gram of each size; borders count only at its ends."""
    data = LOWER[data]
    border = _BORDER[data]
    # A border in front of each text, so that a first word starts as any other does.
    padded = np.full(len(data) + len(offsets), 32, np.uint8)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at = np.arange(len(data)) + row + 1
    padded[at] = np.where(border, 32, data)
    owner = np.zeros(len(padded), np.int64)
    owner[at] = row
    owner[np.arange(len(offsets)) + offsets] = np.minimum(np.arange(len(offsets)), max(len(offsets) - 2, 0))
    inner = np.concatenate([[0], np.cumsum(padded == 32)])
    value = padded.astype(np.uint64) + np.uint64(1)
    for n in SIZES:
        run = len(padded) - n + 1
        if run <= 0:
            continue
        plain = np.flatnonzero(inner[n - 1 : n - 1 + run] - inner[1 : 1 + run] == 0)
        code = np.full(len(plain), n, np.uint64)
        for k in range(n):
            code += value[plain + k] * _PLACES[k]
        # An n-gram that ends on the next text's border belongs to the text it starts in.
        yield owner[np.minimum(plain + 1, len(padded) - 1)], (mix(code) >> np.uint64(64 - BITS)).astype(np.int64)


def _present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) -> (code, with label 1, with label 0), summed up for the task; code -1 counts documents."""
    counts = np.zeros((2, 1 << BITS), np.int64)
    seen = [0, 0]
    for batch in batches:
        y = batch.column(1).to_numpy()
        for first, end, data, offsets in chunks(batch.column(0), 1 << 18):
            parts = list(ngram_codes(data, offsets))
            if parts:
                pairs = np.unique(np.concatenate([r * (1 << BITS) + c for r, c in parts]))
                own = y[first + (pairs >> BITS)]
                for v in (0, 1):
                    counts[v] += np.bincount(pairs[own == v] & ((1 << BITS) - 1), minlength=1 << BITS)
        for v in (0, 1):
            seen[v] += int((y == v).sum())
    code = np.flatnonzero(counts.sum(0))
    yield pa.RecordBatch.from_arrays([pa.array(np.append(code, -1)), pa.array(np.append(counts[1][code], seen[1])), pa.array(np.append(counts[0][code], seen[0]))], ["code", "pos", "neg"])


class RatioScaledModel:
    """Slots of n-gram codes, their log-count ratios times weights, and a bias."""

    def __init__(self, codes: np.ndarray, ratios: np.ndarray):
        self.codes, self.ratios = codes, ratios
        self.weights, self.bias = np.zeros(len(codes)), 0.0

    def slot_table(self) -> np.ndarray:
        slots = np.full(1 << BITS, -1, np.int32)
        slots[self.codes] = np.arange(len(self.codes))
        return slots

    def fit(self, rows: np.ndarray, slots: np.ndarray, y: np.ndarray) -> RatioScaledModel:
        """Accelerated gradient descent on the penalised logistic loss of the scaled features."""
        if not len(y):
            return self
        n, k = len(y), len(self.codes)
        x = self.ratios[slots]
        forward = lambda w: np.bincount(rows, x * w[slots], n)
        back = lambda r: np.bincount(slots, r[rows] * x, k)
        top = np.ones(k)
        for _ in range(20):  # the largest curvature, by power iteration
            top = back(forward(top / max(np.linalg.norm(top), 1e-300)))
        rate_w, rate_b = 1 / (np.linalg.norm(top) / n / 4 + PENALTY + 0.25), 1.0
        w = last_w = np.zeros(k)
        b = last_b = float(np.log((y.sum() + 0.5) / (n - y.sum() + 0.5)))
        for step in range(STEPS):
            ahead = step / (step + 3)
            v, c = w + ahead * (w - last_w), b + ahead * (b - last_b)
            off = 1 / (1 + np.exp(-np.clip(forward(v) + c, -500, 500))) - y
            last_w, last_b = w, b
            w, b = v - rate_w * (back(off) / n + PENALTY * v), c - rate_b * off.mean()
        self.weights, self.bias = w, float(b)
        return self

    def score(self, n: int, rows: np.ndarray, slots: np.ndarray) -> np.ndarray:
        z = self.bias + np.bincount(rows, (self.ratios * self.weights)[slots], n)
        return 1 / (1 + np.exp(-np.clip(z, -500, 500)))


def hits(data: np.ndarray, offsets: np.ndarray, slot_of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (row, slot) of the texts."""
    found = []
    for row, code in ngram_codes(data, offsets):
        slot = slot_of[code]
        own = slot >= 0
        found.append(row[own] * SLOTS + slot[own])
    pairs = np.unique(np.concatenate(found)) if found else np.zeros(0, np.int64)
    return pairs // SLOTS, pairs % SLOTS


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 5, remainder: int = 0, most: int = FIT_ROWS) -> RatioScaledModel:
    """Fit on the labelled documents whose id checksum doesn't leave ``remainder``."""
    rows = stage_table(fit_rows(docs, labels, label, modulus, remainder, most=most), "labelled")
    counts = stage_table(rows.mapInArrow(_present, "code long, pos long, neg long").groupBy("code").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")), "ngrams")
    total = counts.where("code = -1").first()
    n_pos, n_neg = (total["pos"], total["neg"]) if total else (0, 0)
    p, q = F.col("pos") / max(n_pos, 1), F.col("neg") / max(n_neg, 1)
    rate = (F.col("pos") + F.col("neg") + 1) / (n_pos + n_neg + 2)
    apart = F.abs(p - q) / F.sqrt(rate * (1 - rate) * (1 / max(n_pos, 1) + 1 / max(n_neg, 1)))
    best = counts.where("code >= 0 and pos + neg >= 3").orderBy(F.desc(apart), "code").limit(SLOTS).toArrow()
    pos, neg = (best.column(c).to_numpy().astype(float) for c in ("pos", "neg"))
    ratios = np.log((pos + SMOOTHING) / (n_pos + 2 * SMOOTHING)) - np.log((neg + SMOOTHING) / (n_neg + 2 * SMOOTHING))
    model = RatioScaledModel(best.column("code").to_numpy(), ratios)
    slot_of = model.slot_table()

    def matrix(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(0)):
                row, slot = hits(data, offsets, slot_of)
                ends = np.searchsorted(row, np.arange(end - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(pa.array(ends), pa.array(slot.astype(np.int32))), batch.column(1).slice(first, end - first)], ["slots", "y"])

    seen = rows.mapInArrow(matrix, "slots array<int>, y int").toArrow()
    if not seen.num_rows:
        return model
    lists, y = seen.column("slots").combine_chunks(), seen.column("y").to_numpy().astype(float)
    sizes = np.diff(lists.offsets.to_numpy())
    return model.fit(np.repeat(np.arange(len(y)), sizes), lists.flatten().to_numpy(), y)


def score_toxicity(docs: DataFrame, labels: DataFrame, modulus: int = 5, remainder: int = 0) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Null and empty texts hold no n-gram and get the score of the bias. Without
    labels every score is 0.5. Repeated rows are scored alike, other columns are
    ignored; a null id isn't held out, an empty table gives an empty one. A very
    long text takes some 80 times its size of memory by itself. What fitting sends
    to the driver is bounded by ``FIT_ROWS`` times ``SLOTS`` small numbers, and is
    about a hundredth of that, whatever the number of documents.
    """
    model = fit_toxicity(docs, labels, modulus=modulus, remainder=remainder)
    slot_of = model.slot_table()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                row, slot = hits(data, offsets, slot_of)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(model.score(end - first, row, slot))], ["id", "score"])

    return scored(docs, score, modulus, remainder)
