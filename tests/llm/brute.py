"""Plain re-implementations that the queries are compared with."""

from __future__ import annotations

import hashlib
import heapq
import math
import re
import zlib
from collections import defaultdict

import numpy as np

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def components(nodes, links):
    parent = {n: n for n in nodes}

    def find(n):
        while parent[n] != n:
            parent[n] = parent[parent[n]]
            n = parent[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def shingles(text):
    words = SPACE.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def near_classes(docs, percent=85):
    """{id: (n_shingles, component)} of (id, text) rows, by an index of all shingles."""
    sets = {i: shingles(t) for i, t in docs}
    by_set, reps = {}, {}
    for i, s in sorted(sets.items()):
        reps[i] = by_set.setdefault(frozenset(s), i) if s else i
    firsts = [i for i in sorted(sets) if reps[i] == i and sets[i]]
    posting = defaultdict(list)
    common = defaultdict(int)
    order = defaultdict(int)
    for i in firsts:
        for s in sets[i]:
            order[s] += 1
    for i in firsts:
        # A pair at the threshold shares one of the rarest shingles of either set.
        own = sorted(sets[i], key=lambda s: (order[s], s))
        for s in own[: len(own) - -(-len(own) * percent // 100) + 1]:
            for j in posting[s]:
                common[j, i] = 1
            posting[s].append(i)
    links = [(reps[i], i) for i in sets]
    for i, j in common:
        n = len(sets[i] & sets[j])
        if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n):
            links.append((i, j))
    found = components(list(sets), links)
    return {i: (len(sets[i]), found[i]) for i in sets}


KINDS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text):
    out = []
    for place, (kind, pattern) in enumerate(KINDS.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")), "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15}[kind]
            if ok:
                out.append((m.start(), place, m.end(), kind))
    return sorted(out)


def pii_row(text):
    spans = base_spans(text)
    joined = ",".join(f"{k}:{s}:{e}" for s, _, e, k in spans)
    return *(sum(s[3] == k for s in spans) for k in KINDS), hashlib.sha256(joined.encode()).hexdigest()


WORD = re.compile(r"[^\W_]+")


def disclosing(texts, reach=64, doubt=0.5, bound=1.645, least=0.85):
    """{term: share} of the terms that disclose an entity, counted over the different texts."""
    joint, uses, total = defaultdict(set), defaultdict(set), 0
    terms = lambda t: {w for w in WORD.findall(t.lower()) if len(w) >= 3 and any(c.isalpha() for c in w)}
    for n, t in enumerate({t for t in texts if t}):
        total += len(WORD.findall(t))
        for w in terms(t):
            uses[w].add(n)
        for s, _, e, kind in base_spans(t):
            value = t[s:e].lower() if kind in ("email", "ip") else re.sub("[^0-9]", "", t[s:e])
            left, right = t[max(0, s - reach) : s], t[e : e + reach]
            left = re.sub(r"^[^\W_]+", "", left) if s > reach else left
            for w in terms(left + " " + re.sub(r"[^\W_]+$", "", right)):
                joint[kind, value, w].add(n)
    words, out = defaultdict(int), {}
    for (kind, value, _), at in joint.items():
        words[kind, value] += len(at)
    for (kind, value, w), at in joint.items():
        n, k = max(len(uses[w]), len(at)), len(at)
        content = -math.log2(min(words[kind, value] / max(total, 2), 0.5))
        p = k / n
        low = (p + bound**2 / 2 / n - bound * math.sqrt(p * (1 - p) / n + bound**2 / 4 / n / n)) / (1 + bound**2 / n)
        share = (math.log2(k / (n + doubt)) + content) / content
        if min(share, (math.log2(low) + content) / content) >= least:
            out[w] = max(out.get(w, 0), share)
    return out


def all_spans(text, shares, remove=0.95):
    """Base spans and those of disclosing terms outside of them, as (start, end, kind)."""
    base = base_spans(text)
    out = [(s, e, k) for s, _, e, k in base]
    for m in WORD.finditer(text or ""):
        if (share := shares.get(m[0].lower())) and not any(s < m.end() and m.start() < e for s, _, e, _ in base):
            out.append((m.start(), m.end(), "removed" if share >= remove else "general"))
    return sorted(out)


def targets(sizes, weights=(3, 1, 2), share=1.5, most=2.0):
    """{source: target} of {source: size}, by repeated sharing."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[i % 3] for i, s in enumerate(names)}
    full, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        over = {s for s in open_ if left * weight[s] / total > most * sizes[s]}
        if not over:
            return full | {s: left * weight[s] / total for s in open_}
        for s in over:
            full[s] = most * sizes[s]
            left -= full[s]
        open_ -= over
    return full


def vector_links(rows, cosine=0.93):
    """{id: (n_links, component)} of (id, vector, label) rows."""
    unit, by_label = {}, defaultdict(list)
    for i, v, label in rows:
        if i is None or v is None or label is None or any(x is None or not np.isfinite(x) for x in v) or not any(v):
            continue
        v = np.array(v, float)
        unit[i] = v / np.linalg.norm(v)
        by_label[label, len(v)].append(i)
    n, links = defaultdict(int), []
    for ids in by_label.values():
        x = np.stack([unit[i] for i in ids])
        for at in range(0, len(ids), 1000):
            for a, b in zip(*np.nonzero(x[at : at + 1000] @ x.T >= cosine), strict=True):
                if a + at != b:
                    n[ids[a + at]] += 1
                    links.append((ids[a + at], ids[b]))
    found = components([r[0] for r in rows if r[0] is not None], links)
    return {i: (n[i], c) for i, c in found.items()}


def media_row(text):
    data = (text or "").encode()
    payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))
    return len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:])


RULES = {"com/en/": "block", "example.com/en/7": "allow", "net/de/": "block", "example.net/de/8": "block", "org/es/": "block"}


def url_row(url):
    if url is None or "://" not in url:
        return "", "", None
    host, path = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1], re.S).groups()
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in RULES if ((h := r.split("/")[0]) == host or host.endswith("." + h)) and path.startswith(r[len(h) :])]
    return host, path, max(fits, key=len, default=None)


def bpe_rows(texts, path):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    t.no_padding()
    t.no_truncation()
    for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False):
        yield len(e.ids), hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest(), hashlib.sha256(t.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()


def sharded(rows, shards=16):
    """Loads of the shards, and {size of a group: sorted shards of its groups}, by a heap over all groups of (text) rows."""
    sizes = defaultdict(int)
    for t in rows:
        sizes[t or ""] += len((t or "").encode()) + 1
    loads, out = [(0, s) for s in range(shards)], defaultdict(list)
    for size in sorted(sizes.values(), reverse=True):
        load, shard = loads[0]
        heapq.heapreplace(loads, (load + size, shard))
        out[size].append(shard)
    return {s: load for load, s in loads}, {k: sorted(v) for k, v in out.items()}, sizes


def verdicts(pages, rules):
    """{page_id: verdict} of (page_id, url, [links]) with absolute links: own rule, else whether any address of the component is blocked."""
    own = lambda u: rules.get(url_row(u)[2])
    links = [(u, v) for _, u, vs in pages for v in vs]
    found = components({u for _, u, _ in pages} | {v for _, v in links}, links)
    blocked = {found[u] for u in found if own(u) == "block"}
    return {i: own(u) or ("block" if found[u] in blocked else "allow") for i, u, _ in pages}


def media_features(text):
    """The figures of a text's audio, one sample at a time, by the formulas of the standards."""
    data = (text or "").encode()
    payload = data + b"\0" * (max(64, -(-len(data) // 64) * 64) - len(data))

    def mu(b):
        b = ~b & 255
        size = (((b & 15) * 8 + 132) << ((b >> 4) & 7)) - 132
        return -size if b & 128 else size

    def alaw(b):
        b ^= 0x55
        part, low = (b >> 4) & 7, (b & 15) * 16
        size = low + 8 if part == 0 else (low + 264) << (part - 1)
        return size if b & 128 else -size

    linear = [mu(b) for b in payload]
    adpcm = [x for at in range(0, len(payload), 64) for x in scalar_adpcm(payload[at : at + 64])]
    rms = lambda xs: int(math.sqrt(sum(x * x for x in xs) / len(xs)))
    crossings = sum((a < 0) != (b < 0) for a, b in zip(linear, linear[1:]))
    twice = [x for a, b in zip(linear, [*linear[1:], linear[-1]]) for x in (a, (a + b) // 2)]
    pcm = b"".join(x.to_bytes(2, "little", signed=True) for x in twice)
    return f"mu_rms={rms(linear)};a_rms={rms(map_list(alaw, payload))};adpcm_rms={rms(adpcm)};crossings={crossings};pcm16k_samples={len(twice)};pcm16k_crc32={zlib.crc32(pcm)}"


def map_list(f, xs):
    return [f(x) for x in xs]


def scalar_adpcm(block):
    """The standard's decoder, one sample at a time."""
    from quern.llm.telephony_audio import STEPS as steps

    value, index, out = int.from_bytes(bytes(block[:2]), "little", signed=True), min(block[2], 88), []
    out.append(value)
    for byte in block[4:]:
        for code in (byte & 15, byte >> 4):
            step = int(steps[index])
            move = (step >> 3) + (step >> 2) * (code & 1) + (step >> 1) * (code >> 1 & 1) + step * (code >> 2 & 1)
            value = max(-32768, min(32767, value - move if code & 8 else value + move))
            index = max(0, min(88, index + [-1, -1, -1, -1, 2, 4, 6, 8][code & 7]))
            out.append(value)
    return out


def additive_score(model, x):
    """A pairwise additive model's score of one row of figures, table by table."""
    place = lambda edges, v: sum(1 for e in edges if e <= v)
    z = model.base + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, x))
    for (f, g), table in model.pairs.items():
        z += table[place(model.pair_edges[f], x[f])][place(model.pair_edges[g], x[g])]
    return 1 / (1 + math.exp(-z))


def ngrams(text, sizes=(4, 5, 6)):
    """Distinct n-grams of a text's lower-cased bytes as the toxicity model takes them: borders only at either end."""
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    data = b" " + bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in data) + b" "
    return {data[i : i + n] for n in sizes for i in range(len(data) - n + 1) if 32 not in data[i + 1 : i + n - 1]}
