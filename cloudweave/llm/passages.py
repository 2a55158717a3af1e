"""Substring dedup by compact windows: near-duplicate passages across documents.

A document is its sequence of five-word shingles. For each of HASHES hash functions a Cartesian tree over the
shingles' hashes gives compact windows (l, c, r): every subsequence [i, j] with l <= i <= c <= j <= r has the
hash of c as its min-hash. Only windows that hold LEAST shingles are made, about two for LEAST shingles.
Windows of one function and one min-hash meet in a list; each is linked with the list's first and with the NEAR
before it, which joins copies to classes at little cost. Then nothing is left out: each document's places where windows of
ENOUGH functions meet are listed by these min-hashes, and all places of a list that are of different classes are compared,
by sketches of their shingles first, which tell most pairs that hold no similar passage and leave none that do out.
Where ENOUGH min-hashes join two documents at one place, the passage is verified: from its first shared shingle to its last
it holds LEAST shingles or more and the two sets' Jaccard similarity is SIMILAR or more.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.llm import common, graph, jaccard

WORDS, LEAST, HASHES, ENOUGH, SIMILAR = 5, 46, 6, 3, 0.75
#: Windows before it in its list that one is linked with.
NEAR = 2
#: Rows of a list that meet in one task, where all do.
CELL = 512
#: Lists of about PART windows or more are dealt in parts of that size, as a sample of one document in SAMPLED tells; HOT of them at most.
PART, SAMPLED, HOT = 1 << 14, 64, 1 << 14
#: One document in BRIDGE of such a list also stands in a list that joins its parts, about 64 from each part.
BRIDGE = 256
#: Least run that a passage is grown from, pairs of equal shingles that a step holds.
SEED, POINTS = 8, 1 << 16
#: Windows that a task puts together at a time, equal codes of two places.
HELD, SHARED = 1 << 15, 1 << 20
#: Seeds up to this many are grown without a look at their neighbours first.
FEW = 6


def compact_windows(h: np.ndarray, least: int, firsts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """l, c, r of the windows of least elements or more, by c. Of equal hashes the leftmost is the smaller.

    firsts are the bounds of sequences that no window crosses; without them h is one.
    Only elements that are the least of some least neighbours can have such a window, and so have their parents
    in the Cartesian tree; the tree over these alone gives the same windows.
    """
    m = len(h)
    firsts = np.array([0, m]) if firsts is None else firsts
    none = np.zeros(0, np.int64)
    if m < least:
        return none, none, none
    place = np.uint64(max(1, int(m).bit_length()))
    value = (h >> place << place) | np.arange(m, dtype=np.uint64)
    low, width = value, 1
    while 2 * width <= least:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < least:
        low = np.minimum(low[: len(low) - (least - width)], low[least - width :])
    # The least element of a sliding window moves to the right only; windows across a bound do not count.
    within = np.zeros(m + 1, np.int64)
    long = np.diff(firsts) >= least
    np.add.at(within, firsts[:-1][long], 1)
    np.add.at(within, firsts[1:][long] - least + 1, -1)
    low = low[np.cumsum(within)[: len(low)] > 0]
    if not len(low):
        return none, none, none
    chosen = low[np.append(True, low[1:] != low[:-1])]
    c = (chosen & ((np.uint64(1) << place) - np.uint64(1))).astype(np.int64)
    row = np.searchsorted(firsts, c, "right") - 1
    left, right = firsts[row], firsts[row + 1] - 1
    spots, stack, before = c.tolist(), [], -1
    for k, (v, own) in enumerate(zip(value[c].tolist(), row.tolist(), strict=True)):
        if own != before:
            stack, before = [], own
        while stack and stack[-1][0] > v:
            right[stack.pop()[1]] = spots[k] - 1
        if stack:
            left[k] = spots[stack[-1][1]] + 1
        stack.append((v, k))
    keep = right - left + 1 >= least
    return left[keep], c[keep], right[keep]


def windows(docs: DataFrame, hot: tuple[np.ndarray, np.ndarray] | None = None, bridged: int = BRIDGE) -> DataFrame:
    """(token, part, doc_id, l, c, r): the compact windows; token mixes function and min-hash.

    hot: tokens in order, and the parts that each one's list is dealt in, by documents. A part of -1 joins the
    others of its list. All other windows are in part 0.
    """
    seeds = common.mix(np.arange(1, HASHES + 1, dtype=np.uint64) * common._GOLD)
    known, parts = hot or (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in common.slices(batch):
                h, firsts = common.row_shingles(piece.column("text"), WORDS)
                ids = piece.column("doc_id").to_numpy(zero_copy_only=False)
                tokens, owners, places = [], [], []
                for seed in seeds:
                    mixed = common.mix(h ^ seed)
                    left, c, right = compact_windows(mixed, LEAST, firsts)
                    row = np.searchsorted(firsts, c, "right") - 1
                    # The low bits of hashes give way to places, in the order alone.
                    tokens.append(common.mix(mixed[c] + seed))
                    owners.append(ids[row])
                    places.append((np.stack([left, c, right]) - firsts[row]).astype(np.int32))
                token, owner, place = np.concatenate(tokens).view(np.int64), np.concatenate(owners).astype(np.int64), np.concatenate(places, 1)
                if not len(token):
                    continue
                part = np.zeros(len(token), np.int32)
                if len(known):
                    at = np.minimum(np.searchsorted(known, token), len(known) - 1)
                    split = np.flatnonzero(known[at] == token)
                    spot = common.mix(owner[split].view(np.uint64))
                    part[split] = spot % parts[at[split]].astype(np.uint64)
                    bridge = split[(spot >> np.uint64(40)) % np.uint64(bridged) == 0]
                    token, owner, place = np.append(token, token[bridge]), np.append(owner, owner[bridge]), np.append(place, place[:, bridge], 1)
                    part = np.append(part, np.full(len(bridge), -1, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (token, part, owner, *place)], names=["token", "part", "doc_id", "l", "c", "r"])

    return docs.mapInArrow(run, "token long, part int, doc_id long, l int, c int, r int")


def _hot(docs: DataFrame, size: int = PART, sampled: int = SAMPLED) -> tuple[np.ndarray, np.ndarray]:
    """The tokens of long lists, in order, and in how many parts they are dealt.

    An estimate from some documents: it says where windows are dealt to and leaves none out. A long list that it
    misses goes through one task as a stream.
    """
    some = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(sampled)) == 0)
    counts = windows(some).groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") * sampled >= size)
    rows = sorted((r["token"], -(-r["c"] * sampled // size)) for r in counts.orderBy(F.desc("c"), "token").limit(HOT).toLocalIterator())
    return tuple(np.array(rows, np.int64).reshape(-1, 2).T)


def _links(lists: DataFrame, near: int = NEAR) -> DataFrame:
    """(a, b, windows of either, token): windows of a and b that met; a > b. Where b is null: a window of a list of two rows or more.

    Windows of a list stand by group, then by document. One is linked with the first of its list (or part) and with the near
    before its group, so never within one. A window of a list dealt in parts is given too, once, whoever is in its part.
    A task holds 2 near + 1 windows of a list besides a batch.
    """
    names = ["a", "b", "la", "ca", "ra", "lb", "cb", "rb", "token"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        grown = False  # whether the last list is longer than one
        for batch in batches:
            if not batch.num_rows:
                continue
            old = len(held[0]) if held else 0
            columns = [c.to_numpy() for c in batch.columns]
            if held:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            token, part, group, doc, left, c, right = columns
            n = len(token)
            new = np.append(True, (token[1:] != token[:-1]) | (part[1:] != part[:-1]))
            first = np.maximum.accumulate(np.where(new, np.arange(n), 0))
            own = np.maximum.accumulate(np.where(new | np.append(True, group[1:] != group[:-1]), np.arange(n), 0))
            at = np.arange(old, n)
            rows, other = np.concatenate([np.stack([at, first[at]]), *(np.stack([at, own[at] - 1 - k]) for k in range(near))], 1)
            ok = (other < own[rows]) & (other >= first[rows])
            rows, other = np.divmod(np.unique(rows[ok] * n + other[ok]), n)
            up = doc[rows] > doc[other]
            x, y = np.where(up, rows, other), np.where(up, other, rows)
            place = (left, c, right)
            yield pa.RecordBatch.from_arrays([pa.array(v) for v in (doc[x], doc[y], *(v[x] for v in place), *(v[y] for v in place), token[x])], names=names)
            starts = np.flatnonzero(new)
            long = np.diff(np.append(starts, n)) > 1
            long[0] |= grown
            given = long[np.cumsum(new) - 1] & (part == 0)
            given[:old] &= not grown
            given[old:] |= part[old:] > 0
            more = np.flatnonzero(given)
            none = pa.nulls(len(more), pa.int32())
            if len(more):
                yield pa.RecordBatch.from_arrays([pa.array(doc[more]), pa.nulls(len(more), pa.int64()), *(pa.array(v[more]) for v in place), none, none, none, pa.array(token[more])], names=names)
            grown, begin, start = bool(long[-1]), int(first[-1]), int(own[-1])
            keep = np.unique(np.concatenate([[begin], np.arange(max(begin, start - near), start), np.arange(max(begin, n - near), n)])) if grown else np.arange(begin, n)
            held = [v[keep] for v in columns]

    dealt = lists.repartition("token", "part").sortWithinPartitions("token", "part", "group", "doc_id", "c", "l", "r")
    return dealt.select("token", "part", "group", "doc_id", "l", "c", "r").mapInArrow(run, "a long, b long, la int, ca int, ra int, lb int, cb int, rb int, token long")


def meetings(doc: np.ndarray, token: np.ndarray, left: np.ndarray, c: np.ndarray, right: np.ndarray, enough: int = ENOUGH, last: np.ndarray | None = None) -> np.ndarray:
    """The sets of enough windows (by index, a row each) that hold one passage of LEAST shingles with the min-hash of each.

    Windows stand by doc, then by c. Those that do so two by two do so together. Two of one function never do.
    last: windows stand for several of their token (see joined), with c to last; then no set is left out, some may hold no such passage.
    """
    far = np.cumsum(np.append(True, doc[1:] != doc[:-1])[: len(doc)]) << 33
    left, c, last, right = left + far, c + far, (c if last is None else last) + far, right + far

    def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        apart = (left[y] > last[x]) | (c[y] > right[x]) | (left[x] > last[y]) | (c[x] > right[y]) | (token[x] == token[y])
        return ~apart & (np.minimum(right[x], right[y]) - np.maximum(left[x], left[y]) + 1 >= LEAST)

    def grow(sets: np.ndarray, low: np.ndarray, high: np.ndarray, other: np.ndarray) -> np.ndarray:
        """Sets with one more window of other[low:high] that fits all of theirs; POINTS are tried at a time."""
        counts = np.maximum(high - low, 0)
        upto, out, at = np.concatenate(([0], np.cumsum(counts))), [sets[:0, :1].repeat(sets.shape[1] + 1, 1)], 0
        while at < len(sets):
            end = max(at + 1, int(np.searchsorted(upto, upto[at] + POINTS, "right")) - 1)
            own = np.repeat(np.arange(at, end), counts[at:end])
            y = other[np.arange(len(own)) + np.repeat(low[at:end] - upto[at:end] + upto[at], counts[at:end])]
            for k in range(sets.shape[1]):
                ok = fit(sets[own, k], y)
                own, y = own[ok], y[ok]
            out.append(np.column_stack([sets[own], y]))
            at = end
        return np.concatenate(out)

    each = np.arange(len(c))
    sets = pairs = grow(each[:, None], each + 1, np.searchsorted(c, right, "right"), each)
    for _ in range(enough - 2):
        ends = np.searchsorted(pairs[:, 0], sets[:, 0], "right")
        after = np.searchsorted(pairs[:, 0] * max(1, len(c)) + pairs[:, 1], sets[:, 0] * max(1, len(c)) + sets[:, -1], "right")
        sets = grow(sets, after, ends, pairs[:, 1])
    return sets


def joined(token: np.ndarray, doc: np.ndarray, left: np.ndarray, c: np.ndarray, last: np.ndarray, right: np.ndarray) -> list[np.ndarray]:
    """The same columns, windows of one document and token that overlap as one, by document and c: a phrase that repeats makes many."""
    by = np.lexsort((left, token, doc))
    token, doc, left, c, last, right = (v[by] for v in (token, doc, left, c, last, right))
    new = np.append(True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]))[: len(token)]
    far = np.cumsum(new) << 33
    begin = np.flatnonzero(np.append(True, (left + far)[1:] > np.maximum.accumulate(right + far)[:-1])[: len(token)])
    if not len(begin):
        return [token, doc, left, c, last, right]
    out = [token[begin], doc[begin], left[begin], np.minimum.reduceat(c, begin), np.maximum.reduceat(last, begin), np.maximum.reduceat(right, begin)]
    by = np.lexsort((out[3], out[1]))
    return [v[by] for v in out]


def _met(left: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(token, doc_id, l, c, r): a row for each place of a document and enough min-hashes that meet there; token mixes these.

    left: (token, doc_id, l, c, r). Places of one document and token that overlap are one. A task holds HELD windows, a batch and the windows of one document.
    """
    names = ["token", "doc_id", "l", "c", "r"]

    def sets(token: np.ndarray, doc: np.ndarray, left: np.ndarray, c: np.ndarray, right: np.ndarray) -> pa.RecordBatch:
        token, doc, left, c, last, right = joined(token, doc, left, c, c, right)
        at = meetings(doc, token, left, c, right, enough, last)
        mixed = np.sort(token[at].view(np.uint64), 1)
        key = np.zeros(len(at), np.uint64)
        for k in range(enough):
            key = common.mix(key * common._GOLD + mixed[:, k])
        places = (left[at].max(1), c[at].min(1), last[at].max(1), right[at].min(1)) if len(at) else (np.zeros(0, np.int64),) * 4
        key, doc, left, c, _, right = joined(key.view(np.int64), doc[at[:, 0]], *places)
        return pa.RecordBatch.from_arrays([pa.array(key), pa.array(doc), *(pa.array(v.astype(np.int32)) for v in (left, c, right))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[list[np.ndarray]] = []  # windows of whole documents, and the last one's, which may go on
        size = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            held.append([v.to_numpy().astype(np.int64) for v in batch.columns])
            size += batch.num_rows
            if size < HELD:
                continue
            columns = [np.concatenate(v) for v in zip(*held, strict=True)]
            done = int(np.searchsorted(columns[1], columns[1][-1]))
            if done:
                yield sets(*(v[:done] for v in columns))
            held = [[v[done:] for v in columns]]
            size = len(held[0][0])
        if held:
            yield sets(*(np.concatenate(v) for v in zip(*held, strict=True)))

    dealt = left.select(*names).repartition("doc_id").sortWithinPartitions("doc_id")
    return dealt.mapInArrow(run, "token long, doc_id long, l int, c int, r int")


def _neighbours(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each element the place of the equal one before it (or -1) and after it (or len(x))."""
    by = np.argsort(x, kind="stable")
    same = np.flatnonzero(x[by][1:] == x[by][:-1])
    before, after = np.full(len(x), -1), np.full(len(x), len(x))
    before[by[same + 1]] = by[same]
    after[by[same]] = by[same + 1]
    return before, after


def different(before: np.ndarray, least: int = LEAST) -> np.ndarray:
    """How many different elements each stretch of least has, given the places of the equal ones before."""
    n = len(before) - least + 1
    if n < 1:
        return np.zeros(0, np.int64)
    # An element is one again in the stretches that hold the equal one before it too.
    low, high = np.maximum(np.arange(len(before)) - least + 1, 0), np.minimum(before, n - 1)
    ok = high >= low
    again = np.bincount(low[ok], minlength=n + 1) - np.bincount(high[ok] + 1, minlength=n + 1)
    return least - np.cumsum(again)[:n]


def sketches(h: np.ndarray, places: list[tuple[int, int]]) -> Iterator[tuple[int, int, bytes]]:
    """need, lost, codes: what promising needs of each place (first, last) of a document with the shingles h (halves of hashes).

    need: how many shingles a passage of it shares at least with a similar one. codes: 23 bits of each different one, in order,
    and whether they come again; of those with equal bits the first. lost: how many others there are.
    """
    code = h >> np.uint32(9)
    (before, _), (earlier, later) = _neighbours(h), _neighbours(code)
    counts, code = different(before), (code << np.uint32(1)).astype("<u4")
    for low, high in places:
        own = slice(low, high + 1)
        first = earlier[own] < low
        codes = (code[own] | (later[own] <= high))[first]
        stretches = counts[low : max(low, high + 2 - LEAST)]
        need = -int(-100 * SIMILAR * int(stretches.min()) // 100) if len(stretches) else 1 << 30
        yield need, int(np.count_nonzero(before[own] < low)) - len(codes), codes.astype("<u4").view(np.uint8).reshape(-1, 4)[:, :3].tobytes()


def _codes(texts: list[pa.BinaryScalar]) -> tuple[np.ndarray, np.ndarray]:
    """How many codes each has, and all, one after another."""
    parts = [np.frombuffer(v.as_buffer(), np.uint8) for v in texts]
    wide = np.zeros((sum(map(len, parts)) // 3, 4), np.uint8)
    wide[:, :3] = np.concatenate(parts).reshape(-1, 3)
    return np.array([len(v) // 3 for v in parts], np.int64), wide.view("<u4").ravel().astype(np.int64)


def promising(x: tuple[np.ndarray, ...], y: tuple[np.ndarray, ...], wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted pairs (a row for each place of x, a column for each of y) may hold similar passages: none that do are left out.

    x, y: need, lost, the numbers of codes, and the codes one after another. Two passages that are similar share need shingles or more.
    Where no shared code comes again and all stand in one order in both, such passages can begin and end with shared ones, and the others
    between must be few enough.
    """
    (need_x, lost_x, len_x, codes_x), (need_y, lost_y, len_y, codes_y) = x, y
    row_x, row_y = (np.repeat(np.arange(len(n)), n) for n in (len_x, len_y))
    rank_x, rank_y = (np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) for n in (len_x, len_y))
    by = np.argsort(codes_y >> 1, kind="stable")
    ranked = codes_y[by] >> 1
    begin = np.searchsorted(ranked, codes_x >> 1, "left")
    counts = np.searchsorted(ranked, codes_x >> 1, "right") - begin
    ends = np.cumsum(len_x)
    upto = np.concatenate(([0], np.cumsum(counts)))
    odds = int(SIMILAR / (1 - SIMILAR))
    out = np.zeros(wanted.shape, bool)
    at = 0
    while at < len(len_x):
        # Rows of x with about SHARED equal codes together, or one.
        start = int(ends[at] - len_x[at])
        end = max(at + 1, int(np.searchsorted(upto[ends], upto[start] + SHARED, "right")))
        part = slice(start, int(ends[end - 1]))
        e = np.repeat(np.arange(part.start, part.stop), counts[part])
        f = by[np.arange(len(e)) + np.repeat(begin[part] - upto[part] + upto[start], counts[part])]
        pair = (row_x[e] - at) * len(len_y) + row_y[f]
        shared = np.bincount(pair, minlength=(end - at) * len(len_y)).reshape(end - at, -1)
        need = np.maximum(need_x[at:end, None], need_y) - np.minimum(lost_x[at:end, None], lost_y)
        ok = wanted[at:end] & (shared >= need)
        keep = np.flatnonzero(ok.ravel()[pair])
        if len(keep):
            keep = keep[np.argsort(pair[keep], kind="stable")]
            e, f, pair = e[keep], f[keep], pair[keep]
            i, k = np.diff(rank_x[e], prepend=0), np.diff(rank_y[f], prepend=0)
            new = np.append(True, pair[1:] != pair[:-1])
            first, own = np.flatnonzero(new), np.cumsum(new) - 1
            loose = np.logical_or.reduceat(((codes_x[e] | codes_y[f]) & 1 > 0) | (~new & (k < 0)), first)
            # 1 for each shared code, odds less for each other: from any to the (need - 1)th after it or a later one the sum must not be below 0.
            place = np.arange(len(pair)) - first[own]
            total = place - odds * np.cumsum(np.where(new, 0, i + k - 2))
            far = (total.max() - total.min() + 1) * own
            least = np.minimum.accumulate(total - far) + far
            back = np.maximum(need.ravel()[pair], 1) - 1
            late = np.flatnonzero(place >= back)
            fit = np.zeros(len(pair), bool)
            fit[late] = total[late] - least[late - back[late]] + 1 >= 0
            ok.ravel()[pair[first]] = np.logical_or.reduceat(fit, first) | loose
        out[at:end] = ok
        at = end
    return out


def _all_links(rows: DataFrame, docs: DataFrame, limit: int = CELL) -> DataFrame:
    """(a, b, windows of either, token): every two rows of a list whose groups differ and that may hold similar passages; a > b.

    rows: (token, group, doc_id, l, c, r). Each goes to its cells with a sketch of its shingles.
    """
    names = ["a", "b", "la", "ca", "ra", "lb", "cb", "rb", "token"]
    fields = ["token", "i", "j", "right", "outside", "group", "l", "c", "r"]
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
    wanted = jaccard.dealt(rows, "group", "doc_id", limit).groupBy("doc_id").agg(F.collect_list(F.struct(*fields)).alias("cuts"))

    def sketched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                h, firsts = common.row_shingles(part.column("text"), WORDS)
                h = (h >> np.uint64(32)).astype(np.uint32)
                for k, doc in enumerate(part.column("doc_id").to_pylist()):
                    own, cuts = h[firsts[k] : firsts[k + 1]], part.column("cuts")[k].values
                    every = sorted(set(zip(cuts.field("l").to_pylist(), cuts.field("r").to_pylist(), strict=True)))
                    made = dict(zip(every, sketches(own, every), strict=True))
                    for at in range(0, len(cuts), 2000):
                        some = [cuts.field(v).slice(at, 2000) for v in fields]
                        places = list(zip(some[6].to_pylist(), some[8].to_pylist(), strict=True))
                        rest = zip(*(made[p] for p in places), strict=True)
                        yield pa.RecordBatch.from_arrays([pa.array(v, t) if isinstance(v, (list, tuple)) else v.cast(t) for v, t in zip([*some, [doc] * len(places), *rest], kinds, strict=True)], names=[*fields, "doc_id", "need", "lost", "codes"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
        """Cells of 256 rows together or more, and the number of each row's."""
        held: list[pa.RecordBatch] = []
        for table in jaccard.tables_of_cells(batches):
            held.append(table)
            if sum(t.num_rows for t in held) >= 256:
                yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], np.repeat(np.arange(len(held)), [t.num_rows for t in held])
                held = []
        if held:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], np.repeat(np.arange(len(held)), [t.num_rows for t in held])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, cell in several(batches):
            right, outside = (table.column(v).to_numpy(zero_copy_only=False) for v in ("right", "outside"))
            token, group, doc, need, lost = (table.column(v).to_numpy() for v in ("token", "group", "doc_id", "need", "lost"))
            place = [table.column(v).to_numpy() for v in ("l", "c", "r")]
            texts = table.column("codes")

            def side(at: np.ndarray) -> tuple[np.ndarray, ...]:
                counts, codes = _codes([texts[k] for k in at.tolist()])
                return need[at], lost[at], counts, codes + (np.repeat(cell[at], counts) << 24)

            x, y = np.flatnonzero(~right), np.flatnonzero(right)
            if not len(x) or not len(y):
                continue
            of_y = side(y)
            for at in range(0, len(x), 256):
                p = x[at : at + 256]
                # Two rows outside the largest group meet in two cells.
                i, j = np.nonzero(promising(side(p), of_y, (cell[p, None] == cell[y]) & (group[p, None] != group[y]) & (~outside[p, None] | (doc[p, None] < doc[y]))))
                i, j = p[i], y[j]
                up = doc[i] > doc[j]
                i, j = np.where(up, i, j), np.where(up, j, i)
                yield pa.RecordBatch.from_arrays([pa.array(v) for v in (doc[i], doc[j], *(v[i] for v in place), *(v[j] for v in place), token[i])], names=names)

    kind = "token long, i int, j int, right boolean, outside boolean, group long, l int, c int, r int, doc_id long, need int, lost int, codes binary"
    cells = docs.join(wanted, "doc_id").select("doc_id", "text", "cuts").mapInArrow(sketched, kind).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")
    return cells.mapInArrow(run, "a long, b long, la int, ca int, ra int, lb int, cb int, rb int, token long")


def _places(links: DataFrame, enough: int = ENOUGH) -> DataFrame:
    """(a, b, la, ra, lb, rb): where windows of enough min-hashes join two documents, along neighbouring diagonals.

    A pair's windows fall apart where diagonals are more than LEAST apart, then where neither text's overlap.
    """
    names = ["a", "b", "la", "ra", "lb", "rb"]

    def places(a: np.ndarray, b: np.ndarray, diagonal: np.ndarray, ca: np.ndarray, la: np.ndarray, ra: np.ndarray, lb: np.ndarray, rb: np.ndarray, token: np.ndarray) -> pa.RecordBatch:
        apart = (a[1:] != a[:-1]) | (b[1:] != b[:-1]) | (diagonal[1:] - diagonal[:-1] > LEAST)
        group = np.concatenate(([0], np.cumsum(apart)))
        order = np.lexsort((token, rb, lb, ra, la, diagonal, ca, group))
        la, ra, lb, rb, token = (x[order] for x in (la, ra, lb, rb, token))
        far = group << 32
        past = (la + far)[1:] > np.maximum.accumulate(ra + far)[:-1]
        past |= (lb + far)[1:] > np.maximum.accumulate(rb + far)[:-1]
        begin = np.flatnonzero(np.append(True, past))
        place = np.concatenate(([0], np.cumsum(past)))
        by = np.lexsort((token, place))
        fresh = np.append(True, (place[by][1:] != place[by][:-1]) | (token[by][1:] != token[by][:-1]))
        met = np.bincount(place[by][fresh], minlength=len(begin)) >= enough
        out = (a[order][begin], b[order][begin], np.minimum.reduceat(la, begin), np.maximum.reduceat(ra, begin), np.minimum.reduceat(lb, begin), np.maximum.reduceat(rb, begin))
        return pa.RecordBatch.from_arrays([pa.array(x[met]) for x in out], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []  # the last pair's windows, which may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [c.to_numpy().astype(np.int64) for c in batch.columns]
            if held:
                columns = [np.concatenate(c) for c in zip(held, columns, strict=True)]
            a, b = columns[:2]
            done = np.flatnonzero((a != a[-1]) | (b != b[-1]))
            done = int(done[-1]) + 1 if len(done) else 0
            if done:
                yield places(*(c[:done] for c in columns))
            held = [c[done:] for c in columns]
        if held:
            yield places(*held)

    diagonal = (F.col("ca") - F.col("cb")).alias("diagonal")
    dealt = links.select("a", "b", diagonal, "ca", "la", "ra", "lb", "rb", "token").repartition("a", "b").sortWithinPartitions("a", "b", "diagonal")
    return dealt.mapInArrow(run, "a long, b long, la long, ra long, lb long, rb long")


def _verify(places: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id, other_id, start, n_shingles, other_start, other_n_shingles, similarity of the verified passages."""
    keyed = places.withColumn("place", F.xxhash64("a", "b", "la", "lb"))
    sides = keyed.select("place", F.explode(F.array(F.struct(F.col("a").alias("doc"), F.col("la").alias("lo"), F.col("ra").alias("hi"), F.lit(0).alias("side")), F.struct(F.col("b").alias("doc"), F.col("lb").alias("lo"), F.col("rb").alias("hi"), F.lit(1).alias("side")))).alias("s")).select("place", "s.*")
    wanted = sides.groupBy("doc").agg(F.collect_list(F.struct("place", "lo", "hi", "side")).alias("cuts"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                h, firsts = common.row_shingles(part.column("text"), WORDS)
                # Half of each hash is enough to compare two passages.
                h = (h >> np.uint64(32)).astype(np.uint32)
                rows = [(x["place"], x["side"], doc, x["lo"], h[firsts[k] + x["lo"] : firsts[k] + x["hi"] + 1].tobytes()) for k, (doc, cuts) in enumerate(zip(part.column("doc").to_pylist(), part.column("cuts").to_pylist(), strict=True)) for x in cuts]
                kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary())
                for i in range(0, len(rows), 2000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[i : i + 2000], strict=True), kinds, strict=True)], names=["place", "side", "doc", "lo", "h"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x0, y0, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(x, np.uint32), np.frombuffer(y, np.uint32)
                for i, j, k, m, s in same_passages(x, y):
                    out.append((a, b, x0 + i, j - i, y0 + k, m - k, s))
            if out:
                kinds = (*[pa.int64()] * 6, pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=names)

    names = ["doc_id", "other_id", "start", "n_shingles", "other_start", "other_n_shingles", "similarity"]
    texts = docs.withColumnRenamed("doc_id", "doc").join(wanted, "doc").mapInArrow(cut, "place long, side int, doc long, lo long, h binary")
    both = texts.groupBy("place").agg(*(F.max(F.when(F.col("side") == k, F.struct("doc", "lo", "h"))).alias(f"s{k}") for k in (0, 1)))
    both = both.where("s0 is not null and s1 is not null").select("s0.doc", F.col("s1.doc").alias("other"), "s0.lo", F.col("s1.lo").alias("lo1"), "s0.h", F.col("s1.h").alias("h1"))
    return both.mapInArrow(compare, "doc_id long, other_id long, start long, n_shingles long, other_start long, other_n_shingles long, similarity double")


def _likeness(x: np.ndarray, y: np.ndarray) -> Callable[[int, int, int, int], float]:
    """The Jaccard similarity of x[i:j] and y[k:m]; what all calls need is made once."""
    names, code = np.unique(np.concatenate([x, y]), return_inverse=True)
    cx, cy = code[: len(x)], code[len(x) :]
    held = np.zeros(len(names), bool)

    def before(c: np.ndarray) -> np.ndarray:
        order = np.argsort(c, kind="stable")
        out = np.full(len(c), -1)
        same = np.flatnonzero(c[order][1:] == c[order][:-1])
        out[order[same + 1]] = order[same]
        return out

    px, py = before(cx), before(cy)

    def alike(i: int, j: int, k: int, m: int) -> float:
        own = cx[i:j][px[i:j] < i]
        held[own] = True
        other = cy[k:m][py[k:m] < k]
        shared = int(np.count_nonzero(held[other]))
        held[own] = False
        return shared / max(1, len(own) + len(other) - shared)

    return alike


def _runs(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """i, k, n: all longest runs x[i:i+n] = y[k:k+n], at every place of a shingle. POINTS pairs of places are held at a time."""
    order = np.argsort(y, kind="stable")
    ranked = y[order]
    low = np.searchsorted(ranked, x, "left")
    n = np.searchsorted(ranked, x, "right") - low
    upto = np.concatenate(([0], np.cumsum(n)))
    firsts, lasts, at = [], [], 0
    while at < len(x):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + POINTS, "right")) - 1)
        i = np.repeat(np.arange(at, end), n[at:end])
        k = order[np.arange(len(i)) + upto[at] - upto[i] + low[i]]
        first = (i == 0) | (k == 0) | (x[i - 1] != y[k - 1])
        last = (i == len(x) - 1) | (k == len(y) - 1) | (x[(i + 1) % len(x)] != y[(k + 1) % len(y)])
        firsts.append(np.stack([i[first], k[first]]))
        lasts.append(i[last] * np.array([[1], [1]]) - np.stack([0 * k[last], k[last]]))
        at = end
    i, k = np.concatenate(firsts, 1)
    j, diagonal = np.concatenate(lasts, 1)
    order = np.lexsort((i, i - k))
    i, k = i[order], k[order]
    return i, k, j[np.lexsort((j, diagonal))] + 1 - i


def _sums(own: np.ndarray, other: np.ndarray) -> list[np.ndarray]:
    """Of own's places before each one: how many have an equal in other, how many of the rest are a shingle's first."""
    shared = np.isin(own, other)
    new = np.zeros(len(own), bool)
    new[np.unique(own, return_index=True)[1]] = True
    return [np.concatenate(([0], np.cumsum(c))) for c in (shared, new & ~shared)]


def _first_steps(sums: list[list[np.ndarray]], i0: np.ndarray, k0: np.ndarray, n: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Whether a run after each seed may be joined with it: no seed that same_passages would grow so is left out.

    Counts of the seed and the run tell if they suffice. If not, the shared shingles are at most the places that
    have an equal one anywhere in the other text, and the others at least the first ones among the rest.
    """
    order = np.argsort(i0, kind="stable")
    begin, other, length, ends = i0[order], k0[order], n[order], np.maximum.accumulate((i0 + n)[order])
    q, s = (i0 + n)[seeds], (k0 + n)[seeds]
    low, high = np.searchsorted(ends, q, "right"), np.searchsorted(begin, q + LEAST, "right")
    counts = np.maximum(high - low, 0)
    upto = np.concatenate(([0], np.cumsum(counts)))
    (mx, ax), (my, ay) = sums
    out = np.zeros(len(seeds), bool)
    at = 0
    while at < len(seeds):
        end = max(at + 1, int(np.searchsorted(upto, upto[at] + POINTS, "right")) - 1)
        seed = np.repeat(np.arange(at, end), counts[at:end])
        t = np.arange(len(seed)) + np.repeat(low[at:end] - upto[at:end] + upto[at], counts[at:end])
        # Most runs lie elsewhere in y.
        off = other[t] - np.repeat(s[at:end], counts[at:end])
        close = np.flatnonzero((off <= LEAST) & (off + length[t] > 0))
        seed, t = seed[close], order[t[close]]
        past = np.maximum(np.maximum(q[seed] - i0[t], s[seed] - k0[t]), 0)
        rest = n[t] - past
        u, v = i0[t] + past - q[seed], k0[t] + past - s[seed]
        near = np.flatnonzero((rest > 0) & (np.maximum(u, v) <= LEAST) & (rest >= np.abs(u - v)))
        seed, rest, u, v = seed[near], rest[near], u[near], v[near]
        k = seeds[seed]
        both = n[k] + rest
        j, m = q[seed] + u + rest, s[seed] + v + rest
        most = np.minimum(mx[j] - mx[i0[k]], my[m] - my[k0[k]])
        fit = (both >= SIMILAR * (j - i0[k] + m - k0[k] - both)) | (most >= SIMILAR * (most + ax[j] - ax[i0[k]] + ay[m] - ay[k0[k]]))
        out[seed[fit]] = True
        at = end
    return out


def _seeds(x: np.ndarray, y: np.ndarray, i0: np.ndarray, k0: np.ndarray, n: np.ndarray, used: np.ndarray) -> Iterator[tuple[int, bool]]:
    """Runs to start a passage from, longest first, and whether they may grow; not those used meanwhile or too short in the end."""
    order = np.argsort(-n, kind="stable")
    order = order[n[order] >= SEED]
    if len(order):
        yield int(order[0]), True
    rest = order[1:][~used[order[1:]]]
    grows = np.ones(len(rest), bool)
    if len(rest) > FEW:
        sums = [_sums(x, y), _sums(y, x)]
        grows = _first_steps(sums, i0, k0, n, rest)
        back = [[c[-1] - c[::-1] for c in own] for own in sums]
        grows |= _first_steps(back, len(x) - i0 - n, len(y) - k0 - n, n, rest)
        kept = grows | (n[rest] >= LEAST)
        rest, grows = rest[kept], grows[kept]
    yield from ((t, grow) for t, grow in zip(rest.tolist(), grows.tolist(), strict=True) if not used[t])


def _after(i0: np.ndarray, k0: np.ndarray, n: np.ndarray) -> Callable[[int, int], list[tuple[int, int, int, int, int]]]:
    """What of each run lies beyond a passage that ends at (q, s) and not far off: (rank, run, steps in x and y, length), best first."""
    order = np.argsort(i0, kind="stable")
    begin, other, length, ends = (c.tolist() for c in (i0[order], k0[order], n[order], np.maximum.accumulate((i0 + n)[order])))
    order = order.tolist()

    def near(q: int, s: int) -> list[tuple[int, int, int, int, int]]:
        out = []
        for t in range(bisect_right(ends, q), bisect_right(begin, q + LEAST)):
            i, k = begin[t], other[t]
            if k - s > LEAST or k + length[t] <= s:
                continue
            past = max(q - i, s - k, 0)
            rest, u, v = length[t] - past, i + past - q, k + past - s
            if rest > 0 and u <= LEAST and v <= LEAST and abs(u - v) <= rest:
                out.append((max(u, v) - rest, order[t], u + rest, v + rest, rest))
        return sorted(out)

    return near


def same_passages(x: np.ndarray, y: np.ndarray) -> list[tuple[int, int, int, int, float]]:
    """(i, j, k, m, similarity): x[i:j] and y[k:m] are alike, each of LEAST or more.

    From the longest run on, a run is joined with those after and before it as long as the whole stays similar.
    A passage is given if LEAST of its shingles, in x or in y, are in none given before. A passage that is similar
    enough has a run of SEED: it may lose one of seven shingles, and a changed word takes five.
    """
    if len(x) == len(y) and np.array_equal(x, y):
        return [(0, len(x), 0, len(y), 1.0)] if len(x) >= LEAST else []
    if not len(x) or not len(y):
        return []
    i0, k0, n = _runs(x, y)
    alike = None
    used = np.zeros(len(n), bool)
    seen_x, seen_y = np.zeros(len(x), bool), np.zeros(len(y), bool)
    upto_x, upto_y = [0] * (len(x) + 1), [0] * (len(y) + 1)
    found = []
    for seed, more in _seeds(x, y, i0, k0, n, used):
        p, r, shared = int(i0[seed]), int(k0[seed]), int(n[seed])
        q, s = p + shared, r + shared
        if not more and upto_x[q] - upto_x[p] > shared - LEAST and upto_y[s] - upto_y[r] > shared - LEAST:
            continue
        if alike is None:
            alike, after, before = _likeness(x, y), _after(i0, k0, n), _after(-i0 - n, -k0 - n, n)
        alone = (p, q, r, s)
        while more:
            more = False
            for near in (after, before):
                for _, _, e, f, rest in near(q, s) if near is after else near(-p, -r):
                    both = shared + rest
                    to = (p, q + e, r, s + f) if near is after else (p - e, q, r - f, s)
                    # Counts tell mostly; the sets do where they do not.
                    if both >= SIMILAR * (to[1] - to[0] + to[3] - to[2] - both) or alike(*to) >= SIMILAR:
                        (p, q, r, s), shared, more = to, both, True
                        break
        used |= (i0 >= p) & (i0 + n <= q) & (k0 >= r) & (k0 + n <= s)
        for i, j, k, m in ((p, q, r, s), alone):
            if min(j - i, m - k) >= LEAST and (similar := alike(i, j, k, m)) >= SIMILAR:
                if max(j - i - upto_x[j] + upto_x[i], m - k - upto_y[m] + upto_y[k]) >= LEAST:
                    seen_x[i:j] = seen_y[k:m] = True
                    upto_x, upto_y = ([0, *np.cumsum(seen).tolist()] for seen in (seen_x, seen_y))
                    found.append((i, j, k, m, similar))
                break
        if max(len(x) - upto_x[-1], len(y) - upto_y[-1]) < LEAST:
            break
    return sorted(found)


def _groups(found: DataFrame) -> DataFrame:
    """(doc_id, group): the smallest document that passages reach from it, of those that share any."""
    return common.materialize(graph.components(found.select(F.col("doc_id").alias("a"), F.col("other_id").alias("b"))).select(F.col("id").alias("doc_id"), F.col("component").alias("group")))


def _mixed(long: DataFrame) -> DataFrame:
    """The windows of lists whose documents are in several groups."""
    lists = long.groupBy("token").agg(F.min("group").alias("low"), F.max("group").alias("high")).where("low <> high").select("token")
    return long.join(common.materialize(lists), "token")


def _copies(docs: DataFrame, groups: DataFrame) -> DataFrame:
    """(doc_id): documents whose text an earlier one of their group has too. One that has several rows stays."""
    whole = docs.select("doc_id", F.xxhash64("text").alias("x"), F.xxhash64(F.reverse("text")).alias("y")).join(groups, "doc_id")
    single = whole.groupBy("doc_id", "group").agg(F.count("*").alias("n"), F.first("x").alias("x"), F.first("y").alias("y")).where("n = 1")
    first = single.groupBy("group", "x", "y").agg(F.min("doc_id").alias("first"))
    return single.join(first, ["group", "x", "y"]).where("doc_id <> first").select("doc_id")


def near_passages(docs: DataFrame) -> DataFrame:
    """Near-duplicate passages of LEAST shingles (50 words) or more between documents, and whose they are.

    doc_id, other_id (the smaller id), start and n_shingles in doc_id, other_start and other_n_shingles,
    similarity, class_id (the smallest doc_id that passages reach: the membership of both documents).
    Copies are linked with one of theirs that came first and with their neighbour, not all with all; their class joins them.
    Then all windows of lists that hold several classes are compared across these: any two places of different classes
    that ENOUGH min-hashes share are verified, unless their sketches show that nothing in them is similar. Words are lower-cased (A-Z). Null, empty and short texts have no passages; a null doc_id takes no part;
    rows that repeat a doc_id are one document for linking, and their passages are verified against either
    text. An empty table gives no rows. Other columns play no part.
    """
    table = docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text())
    met = common.materialize(_links(windows(table, _hot(table)).withColumn("group", F.col("doc_id"))))
    places = common.materialize(_places(met.where("b is not null")))
    tables = [common.materialize(_verify(places, table))]
    groups = _groups(tables[0])
    grouped = lambda lists: lists.join(groups, "doc_id", "left").withColumn("group", F.coalesce("group", "doc_id"))
    more = met.where("b is null").select("token", F.col("a").alias("doc_id"), F.col("la").alias("l"), F.col("ca").alias("c"), F.col("ra").alias("r"))
    copies = common.materialize(_copies(table, groups))
    left = common.materialize(_met(_mixed(grouped(more).join(copies, "doc_id", "left_anti"))))
    common.discard(met, places)
    rest = common.materialize(_places(_all_links(grouped(left), table), 1))
    tables.append(common.materialize(_verify(rest, table)))
    common.discard(left, rest)
    found = reduce(DataFrame.union, tables)
    if not tables[1].isEmpty():
        common.discard(groups)
        groups = _groups(found)
    return found.join(groups, "doc_id").withColumnRenamed("group", "class_id").select(*tables[0].columns, "class_id")
