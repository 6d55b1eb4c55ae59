"""The contracts once more, in plain Python over small tables, sharing no code with the operators."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

PLAIN = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPACED = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def leaks(docs, items, window=10):
    """{doc_id: (n_words, n_hit, n_items, sha, contaminated)}; docs and items are (id, text)."""
    by_phrase = defaultdict(set)
    for item, text in items:
        w = PLAIN.findall((text or "").translate(LOWER))
        for i in range(max(1, len(w) - window + 1) if w else 0):
            by_phrase[tuple(w[i : i + window])].add(item)
    lengths = {len(p) for p in by_phrase}
    out = {}
    for doc, text in docs:
        w = PLAIN.findall((text or "").translate(LOWER))
        hit, found = set(), set()
        for n in lengths:
            for i in range(len(w) - n + 1):
                if (p := tuple(w[i : i + n])) in by_phrase:
                    hit.update(range(i, i + n))
                    found |= by_phrase[p]
        names = ",".join(sorted(str(x) for x in found))
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(names.encode()).hexdigest(), bool(hit))
    return out


def line_counts(text):
    w = SPACED.findall(text or "")
    windows = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    repeat = {k for i in range(len(w) - 7) if windows[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n")]
    dup = sum(bool(SPACED.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    failed = len(w) < 20 or 100 * len(repeat) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(repeat), failed


def near(docs, shingle=2, percent=80):
    """{doc_id: (n_shingles, component_id)} over all pairs."""
    sets = {}
    for doc, text in docs:
        w = SPACED.findall((text or "").translate(LOWER))
        sets[doc] = {tuple(w[i : i + shingle]) for i in range(len(w) - shingle + 1)} or ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and 100 * min(len(x), len(y)) >= percent * max(len(x), len(y)):
                both = len(x & y)
                if 100 * both >= percent * (len(x) + len(y) - both):
                    p, q = sorted((root(a), root(b)))
                    parent[q] = p
    return {d: (len(sets[d]), root(d)) for d in ids}


def encoded(docs, tokenizer, end_id=2):
    """{doc_id: (start, n_tokens, crc32)} in ascending order, each text encoded whole."""
    at, out = 0, {}
    for doc, text in sorted(docs):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, end_id]
        out[doc] = (at, len(ids), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in ids)))
        at += len(ids)
    return out
