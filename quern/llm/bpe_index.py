"""Byte-pair encoding by a pair occurrence index.

Method: the distinct words of a run of texts that aren't known yet are laid out
as one linked list of symbols. An index maps mergeable pairs to all of their
positions, by their ranks. Active ranks are taken in ascending order: a rank's
merges are applied at all its positions at once, and the lists of the pairs to
the left and right are updated. The index's keys are groups of successive ranks,
at most ``GROUPS``: frequent ranks are a group of their own, rare ones share one,
so that the work is done by numpy on long rows however the positions spread. The
order is kept all the same: groups are taken in ascending order, within a group
each word's lowest active rank goes first, and words don't touch each other; a
merge that makes a pair of a lower group active returns to that group at once.
Equal words are encoded once; texts are put together from their words' ids.

The vocabulary file is a parameter. It is read once by the driver and
broadcast as one compressed value of fixed size.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache
from hashlib import sha256
from itertools import chain, compress, islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.text_bytes import frugal

#: Tokens between white space of one generation of a worker's memory, which holds two.
REMEMBERED = 100_000
#: Ids of a generation for each of its tokens.
IDS_EACH = 8
#: Characters of text whose new words are encoded together, and of a piece of a longer text.
RUN = 1 << 19
#: Positions that ranks taken together have on average, and most groups of ranks.
TOGETHER, GROUPS = 4096, 192

#: White space as Unicode's White_Space property has it.
_WHITE = "\\t\\n\\x0b\\x0c\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"

# Fixed values of Unicode 16 and 17: what later versions than Python's 15.1 assign.
# First and last code points of Unicode 16's new letters, and of its new numbers.
_LATER_LETTERS = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D4A, 0x10D65), (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389),
    (0x1138B, 0x1138B), (0x1138E, 0x1138E), (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x11BC0, 0x11BE0), (0x13460, 0x143FA),
    (0x16100, 0x1611D), (0x16D40, 0x16D6C), (0x18CFF, 0x18CFF), (0x1E5D0, 0x1E5ED), (0x1E5F0, 0x1E5F0),
)
_LATER_NUMBERS = ((0x10D40, 0x10D49), (0x116D0, 0x116E3), (0x11BF0, 0x11BF9), (0x16130, 0x16139), (0x16D70, 0x16D79), (0x1CCF0, 0x1CCF9), (0x1E5F1, 0x1E5FA))
# First and last capitals of Unicode 16 and 17, and the small letter of the first.
_LATER_CAPITALS = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x0264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF), (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB),
    (0xA7DC, 0xA7DC, 0x019B), (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)


def _filled(ranges: Iterable[tuple[int, int]], by: str) -> dict[int, str]:
    return {c: by for first, last in ranges for c in range(first, last + 1)}


#: Code points as the tokenizer's pattern classes them: letters, numbers, and neither.
_CLASSES = _filled(_LATER_LETTERS, "a") | _filled(_LATER_NUMBERS, "0")
_NEITHER = chr(0xFFFF)
_SMALL = {c: small + c - first for first, last, small in _LATER_CAPITALS for c in range(first, last + 1)}


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def _spans(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The places of consecutive spans in one row."""
    ends = sizes.cumsum()
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + sizes, sizes)


def _distinct(at: np.ndarray) -> np.ndarray:
    """Places in order, each once."""
    at = np.sort(at)
    return at[np.append(True, at[1:] != at[:-1])] if len(at) else at


class Numbering(dict):
    """Tokens by number; one that is asked for the first time gets the next."""

    def __missing__(self, token: str) -> int:
        number = self[token] = len(self)
        return number


class Generation:
    """Numbered tokens and their ids, in one row by number."""

    def __init__(self):
        self.at = Numbering()
        self.ends = np.zeros(1, np.int64)
        self.ids = np.zeros(0, np.int32)

    def add(self, tokens: Iterable[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        """Ids of the tokens that follow those with ids; they may have their numbers already."""
        deque(map(self.at.__getitem__, tokens), maxlen=0)
        self.ids = np.concatenate([self.ids, ids.astype(np.int32)])
        self.ends = np.concatenate([self.ends, self.ends[-1] + sizes.cumsum()])

    def of(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of numbered tokens in one row, and how many each has."""
        starts = self.ends[numbers]
        sizes = self.ends[numbers + 1] - starts
        return self.ids[_spans(starts, sizes)], sizes

    def numbers(self, tokens: list[str]) -> np.ndarray:
        return np.fromiter(map(self.at.__getitem__, tokens), np.int64, len(tokens))

    @property
    def full(self) -> bool:
        return len(self.at) > REMEMBERED or len(self.ids) > IDS_EACH * REMEMBERED


class PairIndexBpe:
    """Encoder and decoder of a tokenizer file with word ends, as its library reads it.

    ValueError for a file of another kind: it must normalise by NFC, white space
    and lower case, split by one pattern into words of bytes, and have no decoder.
    """

    def __init__(self, spec: dict):
        model, steps = spec["model"], [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
        parts = {p["type"]: p for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])}
        added = spec.get("added_tokens", [])
        plain = all(not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"]) and not regex.search(r"\s", t["content"]) for t in added)
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or {*parts} != {"Split", "ByteLevel"} or spec.get("decoder") or not plain:
            raise ValueError("not a tokenizer file of lower-cased words with word ends")
        suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in added}
        names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        self.names = [names.get(i, "") for i in range(max(names) + 1)]
        self.numbers = list(map(str, range(len(self.names))))
        pairs = [p if not isinstance(p, str) else p.split(" ") for p in model["merges"]]
        self.wide = len(self.names)
        keys = np.array([vocab[a] * self.wide + vocab[b] for a, b in pairs], np.int64)
        self.whole_of = np.array([vocab[a + b] for a, b in pairs], np.int32)
        order = keys.argsort(kind="stable")
        self.pair_keys, self.pair_ranks = keys[order], order.astype(np.int32)
        # Whether a merge can bring up a rank below its own; trained files have none that does.
        first_use = np.full(self.wide, len(pairs))
        np.minimum.at(first_use, keys // self.wide, np.arange(len(pairs)))
        np.minimum.at(first_use, keys % self.wide, np.arange(len(pairs)))
        self.rising = bool((first_use[self.whole_of] > np.arange(len(pairs))).all())
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.final = np.array([vocab.get(c + suffix, -1) for c in letters], np.int32)
        pattern = parts["Split"]["pattern"]["Regex"].replace("\\s", _WHITE)
        self.word = regex.compile(pattern)
        #: Words of tokens of lower-case ASCII, and the line ends between these.
        self.ascii_word = re.compile(pattern.replace("\\p{L}", "a-z").replace("\\p{N}", "0-9") + "|\\n")
        self.special_at = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.space = regex.compile(f"[{_WHITE}]+")
        #: What Python's split takes for white space and the tokenizer doesn't.
        self.separators = regex.compile("[\\x1c-\\x1f]")
        self.old = self._new_generation()
        self.young = self._new_generation()

    @classmethod
    def from_file(cls, path: str) -> PairIndexBpe:
        with open(path, encoding="utf-8") as file:
            return cls(json.load(file))

    def _new_generation(self) -> Generation:
        out = Generation()
        out.add([*self.special], np.array([*self.special.values()]), np.ones(len(self.special), np.int64))
        return out

    def tokens_of(self, text: str) -> list[str]:
        """A text cut at white space, and around its special tokens."""
        if any(s in text for s in self.special):
            return [t for k, part in enumerate(self.special_at.split(text)) for t in ([part] if k % 2 else self.space.split(part)) if t]
        return text.split() if not self.separators.search(text) else [t for t in self.space.split(text) if t]

    def words_of(self, token: str) -> list[str]:
        """The words of a token without white space, normalised."""
        token = unicodedata.normalize("NFC", token).replace("Σ", "σ")  # lower-casing looks at single letters
        token = token.lower()
        if token.isprintable():
            return self.word.findall(token)
        # Code points that Python doesn't know are classed as the tokenizer does, which the pattern's library may not.
        token = token.translate(_SMALL)
        plain = "".join([_CLASSES.get(ord(c), _NEITHER) if unicodedata.category(c) == "Cn" else c for c in token])
        return [token[m.start() : m.end()] for m in self.word.finditer(plain)]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs; the number of ranks where there is no merge."""
        key = left.astype(np.int64) * self.wide + right
        if not len(self.pair_keys):
            return np.zeros(len(key), np.int32)
        found = np.minimum(self.pair_keys.searchsorted(key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[found] == key, self.pair_ranks[found], np.int32(len(self.pair_keys)))

    def encode_words(self, new: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words in one row, and how many each word has; no word is empty."""
        if not new:
            return np.zeros(0, np.int32), np.zeros(0, np.int64)
        parts = [w.encode("utf-8", "surrogatepass") for w in new]
        row = np.frombuffer(b"".join(parts), np.uint8)
        ends = np.cumsum([len(p) for p in parts])
        symbol = self.inner[row]
        symbol[ends - 1] = self.final[row[ends - 1]]
        word = np.repeat(np.arange(len(new)), np.diff(ends, prepend=0))
        if (symbol < 0).any():  # bytes that the vocabulary lacks are left out
            word, symbol = word[symbol >= 0], symbol[symbol >= 0]
        n, none = len(symbol), len(self.pair_keys)
        if n:
            self._merge(symbol, word, none)
        return symbol[symbol >= 0], np.bincount(word[symbol >= 0], minlength=len(new))

    def _merge(self, symbol: np.ndarray, word: np.ndarray, none: int) -> None:
        """All merges of the symbols of words; what a merge takes in becomes -1."""
        n = len(symbol)
        last = np.append(word[1:] != word[:-1], True)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[last] = -1
        before[np.append(True, last[:-1])] = -1
        rank = np.full(n, none, np.int32)
        inner = np.flatnonzero(~last)
        rank[inner] = self._ranks(symbol[inner], symbol[inner + 1])
        inner = inner[rank[inner] < none]

        # Ranks are grouped so that their positions are many at a time; frequent ones are low and stand alone.
        groups = int(np.clip(len(inner) // TOGETHER, 1, GROUPS))
        edges = np.unique(np.geomspace(1, none + 1, groups + 1).astype(int))[1:-1] if none else np.zeros(0, int)
        group_of = edges.searchsorted(np.arange(none + 1), side="right")
        group_of[none] = -1  # no merge
        own = np.full(n, -1)
        own[inner] = group_of[rank[inner]]
        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def enter(at: np.ndarray) -> None:
            at = at[own[at].argsort(kind="stable")]
            groups = own[at]
            cuts = np.flatnonzero(np.diff(groups, prepend=-1))
            for g, a, b in zip(groups[cuts].tolist(), cuts.tolist(), [*cuts[1:].tolist(), len(at)], strict=False):
                if g in index:
                    index[g].append(at[a:b])
                else:
                    index[g] = [at[a:b]]
                    heapq.heappush(active, g)

        enter(inner)
        while active:
            group = heapq.heappop(active)
            at = _distinct(np.concatenate(index.pop(group)))
            while len(at := at[own[at] == group]):  # without pairs that have gone meanwhile
                mine, of = rank[at], word[at]
                first = np.flatnonzero(np.diff(of, prepend=-1))
                now = at[mine == np.repeat(np.minimum.reduceat(mine, first), np.diff(first, append=len(at)))]
                if not self.rising:  # a lower rank may come up, so one merge of a word at a time
                    now = now[np.diff(word[now], prepend=-1) > 0]
                taken = after[now]
                chained = np.append(False, taken[:-1] == now[1:])
                if chained.any():  # of equal pairs that overlap every second from the left
                    place = np.arange(len(now))
                    now = now[(place - np.maximum.accumulate(np.where(chained, 0, place))) % 2 == 0]
                    taken = after[now]
                far = after[taken]
                symbol[now], symbol[taken], own[taken], after[now], own[now] = self.whole_of[rank[now]], -1, -1, far, -1
                more = far >= 0
                right, far = now[more], far[more]
                before[far] = right
                left = before[now]
                left = left[left >= 0]
                touched, other = np.concatenate([right, left]), np.concatenate([far, after[left]])
                rank[touched] = new = self._ranks(symbol[touched], symbol[other])
                own[touched] = groups = group_of[new]
                enter(touched[(groups >= 0) & (groups != group)])
                if (groups == group).any():
                    at = _distinct(np.concatenate([at, touched[groups == group]]))
                if active and active[0] < group:  # the lower ranks first
                    enter(at[own[at] >= 0])
                    break

    def _cut(self, fresh: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Words of tokens in one list, how many each token has, and the tokens' order in it; remembered ones are their own words."""
        kinds: tuple[list[int], list[int], list[int]] = [], [], []
        for i, t in enumerate(fresh):
            kinds[0 if t in self.old.at else 1 if t.isascii() else 2].append(i)
        flat = [fresh[i] for i in kinds[0]]
        sizes = [np.ones(len(flat), np.int64)]
        if kinds[1]:
            words = self.ascii_word.findall("\n".join([fresh[i] for i in kinds[1]]).lower())
            ends = np.flatnonzero(np.fromiter(map("\n".__eq__, words), bool, len(words)))
            sizes.append(np.diff(ends, prepend=-1, append=len(words)) - 1)
            flat += [w for w in words if w != "\n"]
        several = [self.words_of(fresh[i]) for i in kinds[2]]
        flat += chain.from_iterable(several)
        sizes.append(np.array([len(ws) for ws in several], np.int64))
        return flat, np.concatenate(sizes), np.array([*kinds[0], *kinds[1], *kinds[2]], np.int64)

    def _learn(self, fresh: list[str]) -> None:
        """Ids of the young generation's tokens that have a number but no ids yet."""
        young, old, first = self.young, self.old, len(self.young.ends) - 1
        flat, sizes, order = self._cut(fresh)
        run = Numbering()
        words = np.fromiter(map(run.__getitem__, flat), np.int64, len(flat))
        here = np.fromiter((young.at.get(w, first) for w in run), np.int64, len(run))
        there = np.fromiter((-1 if known else old.at.get(w, -1) for w, known in zip(run, (here < first).tolist(), strict=True)), np.int64, len(run))
        lack = (here >= first) & (there < 0)
        new = list(compress(run, lack.tolist()))
        new_ids, new_sizes = self.encode_words(new)
        # Every word's place in the row of both generations' and the new words' ids.
        pool = np.concatenate([young.ids, old.ids, new_ids])
        ends = np.concatenate([young.ends, len(young.ids) + old.ends, len(young.ids) + len(old.ids) + np.append(0, new_sizes.cumsum())])
        at = np.where(here < first, here, len(young.ends) + there)
        at[lack] = len(young.ends) + len(old.ends) + np.arange(len(new))
        at = at[words]
        each = ends[at + 1] - ends[at]
        ids = pool[_spans(ends[at], each)]
        sizes = np.diff(np.append(0, each.cumsum())[np.append(0, sizes.cumsum())])
        back = order.argsort()
        young.add(fresh, ids[_spans((sizes.cumsum() - sizes)[back], sizes[back])], sizes[back])
        more = np.fromiter((w not in young.at for w in new), bool, len(new))
        young.add(compress(new, more.tolist()), new_ids[np.repeat(more, new_sizes)], new_sizes[more])

    def rows(self, texts: Iterable[str]) -> Iterator[tuple[np.ndarray, bool]]:
        """Ids of each text, or of the pieces of a long one in turn; whether a text goes on."""
        run, size = [], 0
        for text in texts:
            at = 0
            while len(text) - at > RUN and (gap := self.space.search(text, at + RUN)):
                run.append((text[at : gap.start()], True))
                yield from self._run(run)
                run, size, at = [], 0, gap.end()
            run.append((text[at:] if at else text, False))
            size += len(run[-1][0])
            if size >= RUN:
                yield from self._run(run)
                run, size = [], 0
        yield from self._run(run)

    def _run(self, run: list[tuple[str, bool]]) -> Iterator[tuple[np.ndarray, bool]]:
        young, first = self.young, len(self.young.at)
        numbers = [young.numbers(self.tokens_of(t)) for t, _ in run]
        fresh = list(islice(young.at, first, None))
        if fresh:
            self._learn(fresh)
        lengths = np.cumsum([0, *map(len, numbers)])
        ids, sizes = young.of(np.concatenate(numbers)) if run else (young.ids[:0], lengths[:0])
        bounds = np.append(0, sizes.cumsum())[lengths].tolist()
        if young.full:  # tokens that have not been met since the last change are forgotten
            self.old, self.young = self.young, self._new_generation()
        for (_, more), a, b in zip(run, bounds, bounds[1:], strict=False):
            yield ids[a:b], more

    def joined(self, row: list[int]) -> tuple[str, str]:
        """Ids joined by spaces, and the decoded text."""
        return " ".join(map(self.numbers.__getitem__, row)), " ".join(map(self.names.__getitem__, row))

    def encoded(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, ids joined by spaces and decoded text of each text."""
        whole: list[int] = []
        for row, more in self.rows(texts):
            whole += row.tolist()
            if not more:
                yield len(whole), *self.joined(whole)
                whole = []

    def digests(self, texts: Iterable[str]) -> Iterator[tuple[int, str, str]]:
        """Number of ids, and SHA-256 of the ids joined by spaces and of the decoded text; a long text goes by pieces."""
        n, hashes = 0, (sha256(), sha256())
        for row, more in self.rows(texts):
            if len(row):
                for h, part in zip(hashes, self.joined(row.tolist()), strict=True):
                    h.update((" " + part if n else part).encode("utf-8", "surrogatepass"))
            n += len(row)
            if not more:
                yield n, hashes[0].hexdigest(), hashes[1].hexdigest()
                n, hashes = 0, (sha256(), sha256())


@lru_cache(maxsize=1)
def encoder_of(spec: str) -> PairIndexBpe:
    """The encoder of a tokenizer file's text, which a worker keeps from task to task with what it remembers."""
    return PairIndexBpe(json.loads(spec))


def encode(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False) -> DataFrame:
    """Ids and decoded text of every whole text.

    Returns ``id_col, n_tokens, ids, decoded``, or with ``digests`` ``id_col,
    n_tokens, ids_sha256, decoded_sha256`` (lower-case hex of the ids joined by
    one space, and of the decoded text in UTF-8). Null counts as empty: no ids,
    an empty text. Strings of the special tokens within a text are these tokens,
    as the library has it; decoding joins token strings by spaces, as it does
    for a file without a decoder. Repeated rows give repeated rows, an empty table
    an empty one; a null id stays null. A text of more than ``RUN`` characters is
    encoded by pieces that end at white space, so with ``digests`` only a piece is
    held at a time (or one word, where that is longer). Other columns are ignored.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        spec = docs.sparkSession.sparkContext.broadcast(file.read())
    kind = dict(docs.dtypes)[id_col]

    @frugal
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder_of(spec.value)
        for batch in batches:
            texts = (t.as_py() or "" for t in batch.column(1))
            if digests:
                n, a, b = zip(*bpe.digests(texts), strict=True) if batch.num_rows else ((), (), ())
                rest = [pa.array(a, pa.string()), pa.array(b, pa.string())]
            else:
                got = list(bpe.encoded(texts))
                n = [g[0] for g in got]
                rest = [pa.array([[int(i) for i in g[1].split()] for g in got], pa.list_(pa.int32())), pa.array([g[2] for g in got], pa.string())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), *rest], ["id", "n_tokens", "a", "b"])

    out = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, n_tokens long, a {'string' if digests else 'array<int>'}, b string")
    return out.select(F.col("id").alias(id_col), "n_tokens", F.col("a").alias("ids_sha256" if digests else "ids"), F.col("b").alias("decoded_sha256" if digests else "decoded"))
