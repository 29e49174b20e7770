"""Quality of whole texts by a generalised additive model with pairwise interactions.

Method: cyclic boosting fits one shallow tree per feature in turn on quantile
bins, so that every feature ends as one lookup table; the pairs of features
that explain the residuals best get tables of their own the same way (Lou et
al. 2013, "Accurate intelligible models with pairwise interactions"). A score
is the logistic of the sum of the looked-up bins.

Features are shape and repetition figures of the text alone. Fitting takes a
bounded sample (``labelled.FIT_ROWS``), of which only the figures reach the
driver; scoring is one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quern.llm.labelled import FIT_ROWS, fit_rows, scored
from quern.llm.text_bytes import chunks, frugal, run_hashes, words

FEATURES = ["bytes", "words", "word_bytes", "upper", "digits", "stops", "symbols", "word_symbols", "repeats", "longest_run", "distinct", "top_word", "distinct_runs", "lines", "repeated_lines", "word_spread"]
BINS, PAIR_BINS, PAIRS = 48, 12, 8
ROUNDS, PAIR_ROUNDS, RATE = 150, 60, 0.15

_UPPER, _DIGIT, _STOP, _SYMBOL = (np.zeros(256, bool) for _ in range(4))
_UPPER[65:91] = True
_DIGIT[48:58] = True
_STOP[[44, 46]] = True
_SYMBOL[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,;:'\"()-"]] = True
_NOT_LINE = np.zeros(256, bool)
_NOT_LINE[[10, 13]] = True


def text_features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``FEATURES`` for each text; all 0 where it is empty or blank."""
    n = len(offsets) - 1
    out = np.zeros((n, len(FEATURES)))
    starts, ends, row = words(data, offsets)
    if not len(starts):
        return out
    sizes = np.diff(offsets)
    count = lambda table: np.diff(np.concatenate([[0], np.cumsum(table[data])])[offsets])
    hashes, long = run_hashes(data, starts, ends, 5), (ends - starts).astype(float)
    symbol_end = _SYMBOL[data[ends - 1]]
    line_starts, line_ends, line_row = words(data, offsets, _NOT_LINE)
    lines = run_hashes(data, line_starts, line_ends, 6)
    upper, digits, stops, symbols = (count(t) for t in (_UPPER, _DIGIT, _STOP, _SYMBOL))
    first, line_first = np.searchsorted(row, np.arange(n + 1)), np.searchsorted(line_row, np.arange(n + 1))
    for i in range(n):
        w = hashes[first[i] : first[i + 1]]
        k = len(w)
        if not k:
            continue
        here = long[first[i] : first[i + 1]]
        _, times = np.unique(w, return_counts=True)
        same = w[1:] == w[:-1]
        breaks = np.flatnonzero(np.concatenate([[True], ~same, [True]]))
        runs = len(np.unique(w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7))) / (k - 2) if k > 2 else 1.0
        l = lines[line_first[i] : line_first[i + 1]]
        out[i] = (
            np.log1p(sizes[i]), np.log1p(k), here.mean(), upper[i] / sizes[i], digits[i] / sizes[i], stops[i] / k, symbols[i] / sizes[i],
            symbol_end[first[i] : first[i + 1]].mean(), same.mean() if k > 1 else 0.0, np.diff(breaks).max() / k, len(times) / k, times.max() / k, runs,
            np.log1p(len(l)), 1 - len(np.unique(l)) / max(len(l), 1), here.std(),
        )
    return out


def _steps(g: np.ndarray, h: np.ndarray, leaves: int = 4) -> np.ndarray:
    """Bin values of a tree that cuts the ordered bins into at most ``leaves`` runs."""
    sg, sh = np.concatenate([[0], g.cumsum()]), np.concatenate([[0], h.cumsum()])
    value = lambda lo, hi: (sg[hi] - sg[lo]) / (sh[hi] - sh[lo] + 1.0)
    gain = lambda lo, hi: (sg[hi] - sg[lo]) ** 2 / (sh[hi] - sh[lo] + 1.0)
    parts = [(0, len(g))]
    while len(parts) < leaves:
        best = (1e-9, None, None)
        for p, (lo, hi) in enumerate(parts):
            if hi - lo > 1:
                cut = np.arange(lo + 1, hi)
                better = gain(lo, cut) + gain(cut, hi) - gain(lo, hi)
                if better.max() > best[0]:
                    best = (better.max(), p, int(cut[better.argmax()]))
        if best[1] is None:
            break
        lo, hi = parts.pop(best[1])
        parts += [(lo, best[2]), (best[2], hi)]
    out = np.zeros(len(g))
    for lo, hi in parts:
        out[lo:hi] = value(lo, hi)
    return out


def _quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best tree with one cut on either side of a pair of binned features."""
    pad = lambda x: np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    sg, sh = pad(g), pad(h)
    parts = []
    for s in (sg, sh):
        a = s[1:-1, 1:-1]
        parts.append((a, s[1:-1, -1:] - a, s[-1:, 1:-1] - a, s[-1, -1] - s[1:-1, -1:] - s[-1:, 1:-1] + a))
    if not parts[0][0].size:
        return 0.0, np.zeros_like(g)
    gain = sum(x * x / (y + 1.0) for x, y in zip(*parts, strict=True)) - sg[-1, -1] ** 2 / (sh[-1, -1] + 1.0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    v = [x[i, j] / (y[i, j] + 1.0) for x, y in zip(*parts, strict=True)]
    out = np.empty_like(g)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return float(gain[i, j]), out


class PairwiseAdditiveModel:
    """Lookup tables of binned features and of pairs of them."""

    def __init__(self, n_features: int):
        self.base = 0.0
        self.edges = [np.zeros(0)] * n_features
        self.tables = [np.zeros(1)] * n_features
        self.pair_edges = [np.zeros(0)] * n_features
        self.pairs: dict[tuple[int, int], np.ndarray] = {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> PairwiseAdditiveModel:
        """Without rows the score is 0.5 throughout; with one class, nearly that class."""
        if not len(y):
            return self
        n, m = x.shape
        p = (y.sum() + 0.5) / (n + 1)
        self.base = float(np.log(p / (1 - p)))
        cuts = lambda c, k: np.unique(np.quantile(c, np.arange(1, k) / k, method="lower"))
        self.edges, self.pair_edges = [cuts(c, BINS) for c in x.T], [cuts(c, PAIR_BINS) for c in x.T]
        bins = [np.searchsorted(e, c, side="right") for e, c in zip(self.edges, x.T, strict=True)]
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        total = np.full(n, self.base)
        for _ in range(ROUNDS):
            for f in range(m):
                p = 1 / (1 + np.exp(-total))
                k = len(self.tables[f])
                step = RATE * _steps(np.bincount(bins[f], y - p, k), np.bincount(bins[f], p * (1 - p), k))
                self.tables[f] += step
                total += step[bins[f]]
        bins = [np.searchsorted(e, c, side="right") for e, c in zip(self.pair_edges, x.T, strict=True)]

        def grids(f: int, g: int) -> tuple[float, np.ndarray, np.ndarray]:
            shape = len(self.pair_edges[f]) + 1, len(self.pair_edges[g]) + 1
            p, code = 1 / (1 + np.exp(-total)), bins[f] * shape[1] + bins[g]
            add = lambda w: np.bincount(code, w, shape[0] * shape[1]).reshape(shape)
            return *_quadrants(add(y - p), add(p * (1 - p))), code

        ranked = sorted(((grids(f, g)[0], f, g) for f in range(m) for g in range(f)), reverse=True)
        self.pairs = {(f, g): np.zeros((len(self.pair_edges[f]) + 1, len(self.pair_edges[g]) + 1)) for _, f, g in ranked[:PAIRS]}
        for _ in range(PAIR_ROUNDS):
            for (f, g), table in self.pairs.items():
                _, step, code = grids(f, g)
                table += RATE * step
                total += RATE * step.ravel()[code]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        for e, t, c in zip(self.edges, self.tables, x.T, strict=True):
            total += t[np.searchsorted(e, c, side="right")]
        for (f, g), table in self.pairs.items():
            total += table[np.searchsorted(self.pair_edges[f], x[:, f], side="right"), np.searchsorted(self.pair_edges[g], x[:, g], side="right")]
        return 1 / (1 + np.exp(-np.clip(total, -500, 500)))


@frugal
def _figures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first, end, data, offsets in chunks(batch.column(0)):
            x = text_features(data, offsets)
            yield pa.RecordBatch.from_arrays([pa.array(list(x), pa.list_(pa.float64())), batch.column(1).slice(first, end - first)], ["x", "y"])


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1, most: int = FIT_ROWS) -> PairwiseAdditiveModel:
    """Fit on the labelled documents whose id checksum doesn't leave ``remainder``."""
    rows = fit_rows(docs, labels, label, modulus, remainder, most=most).mapInArrow(_figures, "x array<double>, y int").toArrow()
    y = rows.column("y").to_numpy().astype(float)
    x = rows.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1) if len(y) else np.zeros((0, len(FEATURES)))
    order = np.lexsort((*x.T, y)) if len(y) else []  # the same sums whatever order the rows came in
    return PairwiseAdditiveModel(len(FEATURES)).fit(x[order], y[order])


def keep_good(docs: DataFrame, labels: DataFrame, text_col: str = "text", modulus: int = 3, remainder: int = 1) -> DataFrame:
    """The documents that score 0.5 or more, with all their columns, in one pass without a shuffle.

    Null, empty and blank texts are judged by figures of 0 throughout, repeated
    rows alike. Without labels all stay; an empty table gives an empty one.
    """
    model = fit_quality(docs, labels, modulus=modulus, remainder=remainder)

    @frugal
    def scores(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            parts = [model.score(text_features(data, offsets)) for _, _, data, offsets in chunks(texts)]
            yield pa.array(np.concatenate(parts) if parts else np.zeros(0))

    @F.arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from scores(batches)

    return docs.where(score(text_col) >= 0.5)


def score_quality(docs: DataFrame, labels: DataFrame, modulus: int = 3, remainder: int = 1) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document.

    Null, empty and blank texts have figures of 0 throughout and get the score
    of those. Without labels every score is 0.5. Repeated rows are scored alike,
    other columns are ignored; a null id isn't held out, an empty table gives an
    empty one. A very long text takes some 60 times its size of memory by itself.
    """
    model = fit_quality(docs, labels, modulus=modulus, remainder=remainder)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, end, data, offsets in chunks(batch.column(1)):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, end - first), pa.array(model.score(text_features(data, offsets)))], ["id", "score"])

    return scored(docs, score, modulus, remainder)
