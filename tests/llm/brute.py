"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict


def lower(text) -> bytes:
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def components(nodes, links):
    parent = {n: n for n in nodes}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def shingles(text, n=5):
    words = re.findall(rb"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def near_copies(docs):
    """doc -> (shingles, component) for unique ids."""
    sets = {i: shingles(t) for i, t in docs}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    part = components(ids, links)
    return {i: (len(sets[i]), part[i]) for i in ids}


def contamination(docs, items, window=13):
    """doc -> (words, hit, items, digest, contaminated)."""

    def split(t):
        return re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))

    windows = defaultdict(set)
    for i, t in items:
        w = split(t)
        m = min(window, len(w))
        for k in range(len(w) - m + 1 if w else 0):
            windows[tuple(w[k : k + m])].add(i)
    out = {}
    for d, t in docs:
        w = split(t)
        hit, found = set(), set()
        for m in {len(k) for k in windows}:
            for k in range(len(w) - m + 1):
                if own := windows.get(tuple(w[k : k + m])):
                    found |= own
                    hit |= set(range(k, k + m))
        digest = hashlib.sha256(",".join(sorted(map(str, found))).encode()).hexdigest()
        out[d] = (len(w), len(hit), len(found), digest, len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


def repeats(docs, length=100):
    """doc -> (bytes, removed, spans, digest); docs in order."""
    seen, out = set(), {}
    for d, t in docs:
        b = (t or "").encode()
        gone = bytearray(len(b))
        for i in range(len(b) - length + 1):
            if b[i : i + length] in seen:
                gone[i : i + length] = b"\1" * length
            seen.add(b[i : i + length])
        spans = sum(1 for i in range(len(b)) if gone[i] and (i == 0 or not gone[i - 1]))
        rest = bytes(c for c, g in zip(b, gone, strict=True) if not g)
        out[d] = (len(b), sum(gone), spans, hashlib.sha256(rest).hexdigest())
    return out


def katz(docs, discounts, k=5, reserved=0.5):
    """doc -> (tokens, known, total, base, score)."""

    def tokens(t):
        return re.findall(rb"[^\x20\x09-\x0D]+", lower(t)) + [b" end"]

    training = [tokens(t) for i, t in docs if i is not None and zlib.crc32(str(i).encode()) % 10]
    words = Counter(w for t in training for w in t)
    pairs = Counter(p for t in training for p in zip([b" begin", *t[:-1]], t, strict=True))
    history = Counter(h for t in training for h in [b" begin", *t[:-1]])
    total, types = sum(words.values()), len(words)

    def by_count(counts):
        import numpy as np

        return np.array([sum(1 for c in counts.values() if c == r) for r in range(1, k + 2)])

    d1, d2 = discounts(by_count(words)), discounts(by_count(pairs))
    p = {w: (d1[c] if c <= k else 1) * c / (total + reserved) for w, c in words.items()}
    unknown = 1 - sum(p.values())
    taken, lower_mass = defaultdict(float), defaultdict(float)
    for (h, w), c in pairs.items():
        taken[h] += (d2[c] if c <= k else 1) * c / (history[h] + reserved)
        lower_mass[h] += p[w]
    # every history's probabilities, one unknown word included, add up to one
    for h in list(history)[:20]:
        seen = sum(p[w] for a, w in pairs if a == h)
        alpha = (1 - taken[h]) / (1 - lower_mass[h])
        assert abs(taken[h] + alpha * (sum(p.values()) - seen + unknown) - 1) < 1e-9
    out = {}
    for i, t in docs:
        own = tokens(t)
        base = sum(math.log10((words[w] + 0.1) / (total + 0.1 * (types + 1))) for w in own)
        score = 0.0
        for h, w in zip([b" begin", *own[:-1]], own, strict=True):
            c = pairs[h, w]
            if c:
                q = (d2[c] if c <= k else 1) * c / (history[h] + reserved)
            else:
                q = p.get(w, unknown) * ((1 - taken[h]) / (1 - lower_mass[h]) if history[h] else 1)
            score += math.log10(q)
        out[i] = (len(own), sum(w in words for w in own), total, base, score)
    return out
