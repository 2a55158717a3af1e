"""SimHash near-dedup with fuzzy hashing by the perfect Golay code.

Each text has a fingerprint of 64 bits, the majority of its shingles' hashes bit by bit. Fingerprints that differ in
at most three bits are linked. Candidates share a key, and whatever shares a key is verified:

* two of three errors or less hit one half at most, so the other half has one error or none. If one half has none,
  it is a key itself.
* otherwise one half has exactly one error and the other at most two. Of the other's three parts one has none, and
  goes into the key. Of the half, 23 bits are decoded to the nearest codeword of the Golay code, and its 9 further bits
  stand beside it; if these hold the error, the 23 bits themselves stand for the half.
* words at distance one have one nearest codeword, unless both are at distance three of theirs; then the nearest of one is
  among the five at distance four of the other. So a word is listed by its nearest codeword, and such a word also looks
  up those five.

A list of many fingerprints is dealt again: of four classes of 16 bits one has no error, so its rows go to four
lists by their bits in each class, under another partition of the bits at each level, until lists are short.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.llm import common
from cloudweave.llm.graph import components, contract

#: Words of a shingle; seed of its hash; bits that linked fingerprints differ in at most.
WORDS, SEED, ERRORS = 3, 42, 3
#: Rows of a list that is searched as it is; levels that longer ones are dealt again on, after which about 6 bits are open.
LIST, LEVELS = 2048, 8

#: One row in so many, and a fingerprint's rows are not gathered.
FREQUENT = 1000

# Fixed values of XXH64: its five primes.
PRIMES = (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5)
_P1, _P2, _P3, _P4, _P5 = (np.uint64(p) for p in PRIMES)
#: Fixed value: the generator polynomial of the Golay code of 23 bits, x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GOLAY = 0b110001110101


def _turn(x: np.ndarray, by: int) -> np.ndarray:
    return (x << np.uint64(by)) | (x >> np.uint64(64 - by))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _turn(acc + lane * _P2, 31) * _P1


def xxh64(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray, seed: int = SEED) -> np.ndarray:
    """XXH64 of each byte range of buf (which has 16 bytes to spare)."""
    with np.errstate(over="ignore"):
        words, seed = common.unaligned_u64(buf), np.uint64(seed)
        h = np.full(len(starts), seed + _P5, np.uint64)
        stripes = lengths // 32
        wide = np.flatnonzero(stripes)
        if len(wide):
            acc = np.empty((4, len(wide)), np.uint64)
            acc[:] = np.array([seed + _P1 + _P2, seed + _P2, seed, seed - _P1])[:, None]
            live, step = np.arange(len(wide)), 0
            while len(live):
                at = starts[wide[live]] + 32 * step
                for j in range(4):
                    acc[j, live] = _round(acc[j, live], words[at + 8 * j])
                step += 1
                live = live[stripes[wide[live]] > step]
            x = _turn(acc[0], 1) + _turn(acc[1], 7) + _turn(acc[2], 12) + _turn(acc[3], 18)
            for j in range(4):
                x = (x ^ _round(np.zeros(len(wide), np.uint64), acc[j])) * _P1 + _P4
            h[wide] = x
        h += lengths.astype(np.uint64)
        rest, at = lengths % 32, starts + 32 * stripes
        for k in range(3):
            live = np.flatnonzero(rest >= 8 * k + 8)
            if len(live):
                lane = _round(np.zeros(len(live), np.uint64), words[at[live] + 8 * k])
                h[live] = _turn(h[live] ^ lane, 27) * _P1 + _P4
        live = np.flatnonzero(rest & 4)
        h[live] = _turn(h[live] ^ ((words[at[live] + (rest[live] & 24)] & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3
        for k in range(3):
            live = np.flatnonzero((rest & 3) > k)
            h[live] = _turn(h[live] ^ (buf[at[live] + (rest[live] & 28) + k].astype(np.uint64) * _P5), 11) * _P1
        h = (h ^ (h >> np.uint64(33))) * _P2
        h = (h ^ (h >> np.uint64(29))) * _P3
        return h ^ (h >> np.uint64(32))


def _joined(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words end to end with one space behind each, and where each begins."""
    begins = np.concatenate(([0], np.cumsum(lengths + 1)))
    out = buf[np.repeat(starts - begins[:-1], lengths + 1) + np.arange(begins[-1])]
    out[begins[1:] - 1] = 32
    return np.concatenate([out, np.zeros(16, np.uint8)]), begins[:-1]


def majority(h: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """For each run of hashes the bits that over half of them set; zero for a run of none."""
    counts, out = np.diff(firsts), np.zeros(len(firsts) - 1, np.uint64)
    full = np.flatnonzero(counts)
    if not len(full):
        return out
    parts = -(-counts[full] // 255)  # sums of up to 255 bits fit a byte
    rows = np.concatenate(([0], np.cumsum(parts)))
    cuts = np.repeat(firsts[full] - 255 * rows[:-1], parts) + 255 * np.arange(rows[-1])
    for b in range(8):
        lanes = np.add.reduceat((h >> np.uint64(b)) & np.uint64(0x0101010101010101), cuts)
        sums = np.add.reduceat(lanes.view(np.uint8).reshape(-1, 8), rows[:-1], axis=0, dtype=np.int64)
        most = (2 * sums > counts[full, None]).astype(np.uint64)
        out[full] |= (most << (np.arange(0, 64, 8, dtype=np.uint64) + np.uint64(b))).sum(1, dtype=np.uint64)
    return out


def fingerprints(column: pa.Array, size: int = WORDS) -> np.ndarray:
    """The fingerprint of each text."""
    buf, offsets = common.text_bytes(column)
    buf = common.lower_ascii(buf)
    starts, lengths, firsts = common.word_spans(buf, offsets)
    buf, begins = _joined(buf, starts, lengths)
    words = np.diff(firsts)
    counts = np.where(words >= size, words - size + 1, np.minimum(words, 1))
    rows = np.concatenate(([0], np.cumsum(counts)))
    head = np.repeat(firsts[:-1] - rows[:-1], counts) + np.arange(rows[-1])
    last = head + np.repeat(np.minimum(words, size), counts) - 1
    return majority(xxh64(buf, begins[head], begins[last] + lengths[last] - begins[head]), rows)


def _code() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of 23 bits: remainders by the generator of the low 12 and of the high 11 bits; for each remainder the error that leads to
    the nearest codeword, and the five errors of weight four, zero if the nearest is at distance two or less."""
    bits = np.zeros(23, np.int64)
    bits[0] = 1
    for k in range(1, 23):
        bits[k] = bits[k - 1] << 1
        bits[k] ^= GOLAY * (bits[k] >> 11)
    rest = np.zeros(1 << 12, np.int64)
    high = np.zeros(1 << 11, np.int64)
    for k in range(23):
        table, at = (rest, k) if k < 12 else (high, k - 12)
        table ^= np.where(np.arange(len(table)) >> at & 1, bits[k], 0)
    near, far = np.zeros(1 << 11, np.int64), np.zeros((1 << 11, 5), np.int64)
    used = np.zeros(1 << 11, np.int64)
    for weight in range(1, 5):
        for at in combinations(range(23), weight):
            s, word = int(np.bitwise_xor.reduce(bits[list(at)])), sum(1 << k for k in at)
            if weight < 4:
                near[s] = word
            else:
                far[s, used[s]] = word
                used[s] += 1
    return np.concatenate([rest, high]), near, far


_REST, _NEAR, _FAR = _code()


def codewords(word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For words of 23 bits the number of the nearest codeword; for those at distance three of it, also of the five at distance four, with the words' places."""
    s = _REST[word & 4095] ^ _REST[4096 + (word >> 12)]
    wide = np.flatnonzero(_FAR[s, 0])
    return (word ^ _NEAR[s]) >> 11, (word[wide, None] ^ _FAR[s[wide]]) >> 11, wide


def keys(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, key, listed): the lists of each fingerprint. It is listed under some and only looks up the others."""
    halves = (fp >> np.uint64(32)).astype(np.int64), (fp & np.uint64(0xFFFFFFFF)).astype(np.int64)
    every = np.arange(len(fp))
    out: list[tuple[np.ndarray, np.ndarray, int]] = []

    def put(kind: int, place: np.ndarray, value: np.ndarray, listed: int) -> None:
        out.append((place, (np.int64(kind) << 48 | value).view(np.uint64), listed))

    for k, (half, other) in enumerate((halves, halves[::-1])):
        put(16 * k, every, half, 1)
        word, beside = half >> 9, half & 511
        own, five, wide = codewords(word)
        for j, part in enumerate((other >> 21, other >> 10 & 2047, other & 1023)):
            put(16 * k + 1 + j, every, word << 11 | part, 1)
            tail = beside << 11 | part
            put(16 * k + 4 + j, every, own << 20 | tail, 1)
            put(16 * k + 4 + j, np.repeat(wide, 5), (five << 20 | tail[wide, None]).ravel(), 0)
    return np.concatenate([p for p, _, _ in out]), common.mix(np.concatenate([v for _, v, _ in out])), np.concatenate([np.full(len(p), y, np.int8) for p, _, y in out])


def _classes_of_bits() -> np.ndarray:
    """For each level four masks of 16 bits that make up the 64."""
    rng, out = np.random.default_rng(0), np.zeros((LEVELS, 4), np.uint64)
    for level in out:
        for i, bit in enumerate(rng.permutation(64)):
            level[i % 4] |= np.uint64(1) << np.uint64(bit)
    return out


_MASKS = _classes_of_bits()
_ROWS = "key long, fp long, listed byte"


def _rows(key: np.ndarray, fp: np.ndarray, listed: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(fp.view(np.int64)), pa.array(listed)], names=["key", "fp", "listed"])


def _listed(prints: DataFrame, rows: int = 1 << 14) -> DataFrame:
    """The rows of all lists, of (fp)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = batch.column("fp").to_numpy().view(np.uint64)
            for a in range(0, len(fps), rows):
                fp = fps[a : a + rows]
                place, key, listed = keys(fp)
                yield _rows(key, fp[place], listed)

    return prints.mapInArrow(run, _ROWS)


def _dealt_again(rows: DataFrame, level: int) -> DataFrame:
    """Each row in four lists, by its bits in each class of the level."""
    masks = _MASKS[level]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key, fp = (batch.column(n).to_numpy().view(np.uint64) for n in ("key", "fp"))
            for j, mask in enumerate(masks):
                yield _rows(common.mix(common.mix(key + np.uint64(j)) ^ (fp & mask)), fp, batch.column("listed").to_numpy())

    return rows.mapInArrow(run, _ROWS)


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of rows that come sorted by key, those listed first."""
    held = [np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int8)]
    for batch in batches:
        new = [batch.column("key").to_numpy(), batch.column("fp").to_numpy().view(np.uint64), batch.column("listed").to_numpy()]
        held = [np.concatenate(x) for x in zip(held, new, strict=True)]
        cut = int(np.searchsorted(held[0], held[0][-1])) if len(held[0]) else 0
        yield from _links(*(x[:cut] for x in held))
        held = [x[cut:] for x in held]
    yield from _links(*held)


def _links(key: np.ndarray, fp: np.ndarray, listed: np.ndarray) -> Iterator[pa.RecordBatch]:
    live, step = np.flatnonzero(listed), 1
    while len(live):
        live = live[live + step < len(key)]
        live = live[key[live] == key[live + step]]
        a, b = fp[live], fp[live + step]
        near = np.bitwise_count(a ^ b) <= ERRORS
        if near.any():
            yield pa.RecordBatch.from_arrays([pa.array(a[near].view(np.int64)), pa.array(b[near].view(np.int64))], names=["a", "b"])
        step += 1


def links(prints: DataFrame, limit: int = LIST) -> DataFrame:
    """(a, b): enough pairs of fingerprints that differ in at most ERRORS bits to join all that such pairs join. prints: (fp), a row for each fingerprint.

    All pairs of a list are compared; tasks hand out only what joins theirs.
    """
    rows, found = _listed(prints), []
    for level in range(LEVELS + 1):
        if level < LEVELS:
            long = common.materialize(rows.groupBy("key").agg(F.count("*").alias("c")).where(F.col("c") > limit).select("key"))
            more = long.limit(1).count() > 0
        else:
            more = False
        short = rows.join(long, "key", "left_anti") if more else rows
        found.append(common.materialize(short.repartition("key").sortWithinPartitions("key", F.desc("listed")).mapInArrow(lambda batches: contract(_pairs(batches)), "a long, b long")))
        if not more:
            break
        rows = common.materialize(_dealt_again(rows.join(long, "key", "left_semi"), level))
    out = found[0]
    for x in found[1:]:
        out = out.union(x)
    return out


def near_duplicates(docs: DataFrame, limit: int = LIST) -> DataFrame:
    """(doc_id, fingerprint, component_id) of every row of docs (doc_id, text).

    A text without words, empty or null has the fingerprint zero, which links like any other. A null doc_id has a
    fingerprint, takes no part in links and has a null component. Rows of one doc_id keep their own fingerprints; a link of
    either is a link of the id. An empty table gives no rows. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(fingerprints(part.column("text")).view(np.int64))], names=["doc_id", "fp"])

    prints = common.materialize(docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text()).mapInArrow(run, "doc_id long, fp long"))
    known = prints.where("doc_id is not null")
    classes = common.materialize(known.groupBy("fp").agg(F.min("doc_id").alias("root"), F.count("*").alias("c")))
    found = links(classes.select("fp"), limit)
    # Fingerprints that one doc_id has in several rows are joined by it.
    several = known.groupBy("doc_id").agg(F.min("fp").alias("a"), F.max("fp").alias("z")).where("a <> z")
    found = found.union(known.join(several, "doc_id").where("fp <> a").select("a", F.col("fp").alias("b")))
    joined = classes.join(components(found).withColumnRenamed("id", "fp"), "fp")
    least = joined.groupBy("component").agg(F.min("root").alias("component_id"))
    moved = joined.join(least, "component").where("component_id < root").select("fp", "component_id")
    placed = classes.join(moved, "fp", "left").select("fp", "c", F.coalesce("component_id", "root").alias("component_id"))
    # A fingerprint of a thousandth of all rows or more would gather in one task; there are a thousand of them at most.
    many = F.broadcast(placed.where(F.col("c") * FREQUENT >= known.count()).select("fp", "component_id"))
    out = prints.join(many, "fp").unionByName(prints.join(many, "fp", "left_anti").join(placed.select("fp", "component_id"), "fp", "left"))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
