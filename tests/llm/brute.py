"""Plain versions of the operators for small tables: lists of (doc_id, text)."""

import hashlib
import re
from collections import Counter, defaultdict


def words(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in re.findall(r"[^\x20\x09-\x0D]+", text or "")]


def shingles(text, size=5):
    w = words(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())


def components(rows):
    """{doc_id: smallest linked doc_id} of rows with an id."""
    sets = [(d, shingles(t)) for d, t in rows if d is not None]
    up = {d: d for d, _ in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for k, (d, s) in enumerate(sets):
        for j, shared in Counter(j for x in s for j in where[x]).items():
            if 100 * shared >= 75 * (len(s) + len(sets[j][1]) - shared):
                a, b = find(d), find(sets[j][0])
                up[max(a, b)] = min(a, b)
        for x in s:
            where[x].append(k)
    return {d: find(d) for d in up}


def repeated_bytes(texts, length):
    """For each text its bytes, those removed, the spans, and the digest of the rest."""
    data = [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + length] for d in data for i in range(len(d) - length + 1))
    out = []
    for d in data:
        mark = bytearray(len(d))
        for i in range(len(d) - length + 1):
            if seen[d[i : i + length]] > 1:
                mark[i : i + length] = b"\1" * length
        rest = bytes(c for c, m in zip(d, mark) if not m)
        out.append((len(d), sum(mark), len(re.findall(b"\1+", bytes(mark))), hashlib.sha256(rest).hexdigest()))
    return out
