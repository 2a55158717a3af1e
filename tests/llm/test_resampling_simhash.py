import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from cloudweave.llm import resampling, simhash
from cloudweave.llm.common import text_bytes
from tests.llm import brute


def ngrams(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return w, [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def plain_resampling(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = (Counter(bucket(f) for x in texts for f in ngrams(x)[1]) for texts in ([x for _, x in rows], target))
    S, T = sum(s.values()) + 10_000, sum(t.values()) + 10_000
    out = []
    for d, x in rows:
        w, f = ngrams(x)
        weight = sum(math.floor(1000 * math.log((t[b] + 1) * S / ((s[b] + 1) * T))) for b in map(bucket, f))
        score = None
        if d is not None:
            h = int(hashlib.sha256(f"42:{d}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append([d, len(f), weight, score, None, len(w)])
    fit = sorted((r for r in out if r[5] >= 20 and r[0] is not None), key=lambda r: (-r[3], r[0], r[1]))
    for k, r in enumerate(fit[: 5 * len(fit) // 100], 1):
        r[4] = k
    return sorted((tuple(r[:5]) for r in out), key=str)


def resampled(docs, target):
    return sorted(map(tuple, resampling.resample(docs, target).collect()), key=str)


def test_resampling_equals_a_plain_version(spark, documents, sf_dir):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    assert resampled(documents.repartition(7), target) == plain_resampling(rows, [r.text for r in target.collect()])


def test_resampling_takes_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()] * 3
    big = odd.union(odd).union(odd)
    target = ["word1 of1 text1 and more", None, ""]
    frame = spark.createDataFrame([(t, 1) for t in target], "text string, rank int")
    assert resampled(big, frame) == plain_resampling(rows, target)
    assert resampled(odd, empty) == plain_resampling(rows[: len(rows) // 3], [])
    assert resampled(empty, frame) == []
    long = spark.createDataFrame([(1, "a" * 300_000 + " b"), (2, "word " * 200_000), (3, None)], "doc_id long, text string")
    assert resampled(long, frame) == plain_resampling([(r.doc_id, r.text) for r in long.collect()], target)


@pytest.mark.parametrize("limit", [0, 1, 37, 500, 10_000])
def test_ranks_by_regular_sampling(spark, tmp_path, limit):
    """Ties in the leading columns, and one group of equal leading columns that holds a third of all rows."""
    rng = random.Random(limit)
    rows = [(rng.randrange(20), rng.randrange(5), i) for i in range(1000)] + [(7, 3, i) for i in range(1000, 1500)]
    rng.shuffle(rows)
    spark.createDataFrame(rows, "a long, b long, c long").repartition(6).write.parquet(str(tmp_path / "rows"))
    table = spark.read.parquet(str(tmp_path / "rows"))
    got = resampling.first_ranks(table, ["a", "b", "c"], limit, ranges=5).collect()
    want = {r: k if k <= limit else None for k, r in enumerate(sorted(rows), 1)}
    assert {(r.a, r.b, r.c): r["rank"] for r in got} == want and len(got) == len(rows)


def plain_print(text):
    w = brute.words(text)
    h = [xxhash.xxh64_intdigest(" ".join(x).encode(), seed=42) for x in ([w[i : i + 3] for i in range(len(w) - 2)] if len(w) > 2 else [w] if w else [])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_simhash(rows):
    prints = [(d, plain_print(t)) for d, t in rows]
    up = {d: d for d, _ in prints if d is not None}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    known = [(d, p) for d, p in prints if d is not None]
    for i, (a, p) in enumerate(known):
        for b, q in known[:i]:
            if a != b and (p ^ q).bit_count() <= 3:
                x, y = find(a), find(b)
                up[max(x, y)] = min(x, y)
    return sorted(((d, f"{p:016x}", None if d is None else find(d)) for d, p in prints), key=str)


def near(docs, **options):
    return sorted(map(tuple, simhash.near_duplicates(docs, **options).collect()), key=str)


def test_hashes_equal_the_library():
    rng = random.Random(0)
    data = [rng.randbytes(n) for n in [*range(100), 1000]]
    buf, offsets = text_bytes(pa.array(data, pa.binary()))
    assert simhash.xxh64(buf, offsets[:-1], np.diff(offsets)).tolist() == [xxhash.xxh64_intdigest(d, seed=42) for d in data]


def test_golay_code_is_perfect():
    """Every word is within three bits of one codeword, and words at distance one share a list."""
    words = np.random.default_rng(0).integers(0, 1 << 23, 2000)
    own, five, wide = simhash.codewords(words)
    listed = [{int(o)} for o in own]
    looked = [set(x) for x in listed]
    for at, more in zip(wide.tolist(), five.tolist(), strict=True):
        looked[at] |= set(more)
        assert len(looked[at]) == 6
    assert len({*simhash.codewords(np.arange(1 << 23))[0].tolist()}) == 1 << 12
    for k in range(23):
        other = simhash.codewords(words ^ (1 << k))[0]
        assert all(int(o) in looked[i] for i, o in enumerate(other))


@pytest.mark.parametrize("errors", [1, 2, 3])
def test_close_fingerprints_share_a_list(errors):
    rng = random.Random(errors)
    a = np.random.default_rng(errors).integers(0, 1 << 64, 1500, dtype=np.uint64)
    b = a ^ np.array([sum(1 << k for k in rng.sample(range(64), errors)) for _ in a], np.uint64)
    lists = []
    for fp in (a, b):
        at, key, listed = simhash.keys(fp)
        mine = [(set(), set()) for _ in fp]
        for i, k, y in zip(at.tolist(), key.tolist(), listed.tolist(), strict=True):
            mine[i][0].add(k)
            if y:
                mine[i][1].add(k)
        lists.append(mine)
    assert all(x[0] & y[1] or x[1] & y[0] for x, y in zip(*lists, strict=True))


def test_simhash_equals_a_plain_version(documents):
    rows = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    assert near(documents.repartition(5)) == plain_simhash(rows)


@pytest.mark.parametrize("limit", [2, simhash.LIST])
def test_long_lists_lose_no_link(spark, limit):
    """Fingerprints round a few centres, so that lists are long at every level."""
    rng = random.Random(3)
    centres = [rng.getrandbits(64) for _ in range(3)]
    prints = sorted({rng.choice(centres) ^ sum(1 << k for k in rng.sample(range(64), rng.randrange(9))) for _ in range(500)})
    frame = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "fp long").repartition(3)
    found = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(frame, limit).collect()]
    true = [(p, q) for i, p in enumerate(prints) for q in prints[:i] if (p ^ q).bit_count() <= 3]

    def groups(pairs):
        up = {p: p for p in prints}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in pairs:
            up[find(a)] = find(b)
        out = {}
        for p in prints:
            out.setdefault(find(p), []).append(p)
        return sorted(out.values())

    assert groups(found) == groups(true)


def test_simhash_takes_odd_rows(spark, odd, empty):
    rows = [(r.doc_id, r.text) for r in odd.collect()]
    got, want = near(odd), plain_simhash(rows)
    # one doc_id with two texts: links of either are links of the id
    assert got == want
    assert near(empty) == []
    long = [(1, "a b " * 150_000), (2, "a b " * 150_001 + "c"), (3, "x" * 200_000), (4, None), (5, "")]
    assert near(spark.createDataFrame(long, "doc_id long, text string")) == plain_simhash(long)
