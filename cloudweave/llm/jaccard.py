"""N-gram Jaccard join: rare-first prefix filtering with length, positional and suffix filters.

Documents are sets of five-word shingles; two link when 100 * |A and B| >= 75 * |A or B|. The steps:

1. a profile of each document: its set's 128-bit fingerprint, its size n and two summaries for the suffix filter.
   Documents of equal sets are one class, and only classes are compared. The same pass counts shingles of all
   documents in BUCKETS cells, a table of fixed size, which puts shingles in an order: those of rare cells first.
   Any order gives whole results; a rare-first one gives short lists. What costs most are the most frequent
   shingles, and a cell that holds one of them stands out however many others share it.
2. the first n - ceil(3n/4) + 1 shingles of each set are its prefix: linked sets share one. Rows of a shingle
   that one set alone has are dropped.
3. two star rounds over lists of more than FEW rows: a set is paired with its neighbours in the list, in an order
   that differs from list to list, and with the list's first, if their components differ and the length, positional
   and suffix filters allow. Of its pairs each set has the BEST closest ones verified; links give components.
4. now only pairs of different components matter. All of them that share a list pass the length filter and the
   suffix filter, are counted over all lists, and go on if the count is what two linked sets must share in their
   prefixes. Each is verified once. So no link between components is lost. A long list is dealt into cells of
   at most 2 LIST rows; the rows of its largest component are copied only as often as the others need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloudweave.llm import common
from cloudweave.llm.graph import components

#: Cells of the frequency table and the ranges that it is added up in; rows of a list that meet in one task; bytes of
#: a hash that sets are compared by.
BUCKETS, RANGES, LIST, KEPT = 1 << 22, 16, 512, 6
#: Rows of a list that takes no part in the star rounds, rows before a row that it is paired with, pairs of a set
#: that a round verifies, rounds.
FEW, NEAR, BEST, ROUNDS = 4, 2, 2, 2
#: Bits of a set's parity map; cells of the table of sets that verification reads.
BITS, WANTED = 2048, 1 << 27


_SEEDS = common.mix(np.arange(1, 3, dtype=np.uint64))


def set_rows(column: pa.Array) -> list[np.ndarray]:
    """The distinct shingle hashes of each row, ascending."""
    h, firsts = common.row_shingles(column)
    return [np.unique(h[a:b]) for a, b in zip(firsts[:-1], firsts[1:], strict=True)]


def slices(s: np.ndarray) -> bytes:
    """Counts, up to 255, of a set's hashes by equal ranges, a power of two of them: the finer, the larger the set."""
    bits = min(max(len(s).bit_length() - 2, 3), 14)
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def least_difference(a: bytes, b: bytes) -> int:
    """A number that two sets differ by at least: the sum of what their counts differ by."""
    if len(a) < len(b):
        a, b = b, a
    x, y = np.frombuffer(a, np.uint8).astype(np.int32), np.frombuffer(b, np.uint8).astype(np.int32)
    if len(x) > len(y):  # a count that met its limit stands for more, so such ranges are left out
        full = (x == 255).reshape(len(y), -1).any(1) | (y == 255)
        return int(np.abs(np.where(full, 0, x.reshape(len(y), -1).sum(1) - y)).sum())
    return int(np.abs(x - y).sum())


def parities(flat: np.ndarray, owner: np.ndarray, rows: int) -> np.ndarray:
    """BITS bits of each row's set, in words: whether a cell of hashes holds an odd number of its shingles.

    Two sets differ by at least as many shingles as their bits differ, for a shingle of both flips both.
    """
    cell = (common.mix(flat + _SEEDS[0]) >> np.uint64(64 - BITS.bit_length() + 1)).astype(np.int64)
    out = np.zeros(rows * (BITS // 64), np.uint64)
    np.bitwise_xor.at(out, owner * (BITS // 64) + (cell >> 6), np.uint64(1) << (cell & 63).astype(np.uint64))
    return out.reshape(rows, BITS // 64)


def _words(column: pa.Array) -> np.ndarray:
    """Binary rows of equal length as a matrix of words."""
    data, _ = common.text_bytes(column)
    return data[:-16].view(np.uint64).reshape(len(column), -1 if len(column) else BITS // 64)


def _cells(h: np.ndarray) -> np.ndarray:
    return (common.mix(h) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)


def profile(docs: DataFrame) -> DataFrame:
    """A row for each document (doc_id, h1, h2, n, slices, bits), and RANGES for each task with its counts by cell."""
    shape = pa.schema([("doc_id", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("n", pa.int64()), ("slices", pa.binary()), ("bits", pa.binary()), ("part", pa.int32()), ("counts", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(BUCKETS, np.uint32)
        for batch in batches:
            for part in common.slices(batch):
                sets = set_rows(part.column("text"))
                sizes = np.array([len(s) for s in sets], np.int64)
                flat = np.concatenate([*sets, np.zeros(0, np.uint64)])
                np.add.at(counts, _cells(flat), 1)
                sums = np.zeros((2, len(sets) + 1), np.uint64)
                at = np.concatenate(([0], np.cumsum(sizes)))
                for k in range(2):
                    ends = np.zeros(len(flat) + 1, np.uint64)
                    np.cumsum(common.mix(flat + _SEEDS[k]), out=ends[1:])
                    sums[k, :-1] = common.mix(ends[at[1:]] - ends[at[:-1]])
                bits = parities(flat, np.repeat(np.arange(len(sets)), sizes), len(sets))
                own = [part.column("doc_id"), *(pa.array(x[:-1].view(np.int64)) for x in sums), pa.array(sizes), pa.array([slices(x) for x in sets], pa.binary()), pa.array([x.tobytes() for x in bits], pa.binary())]
                yield pa.RecordBatch.from_arrays([*own, pa.nulls(len(sets), pa.int32()), pa.nulls(len(sets), pa.binary())], schema=shape)
        if counts.any():
            blobs = [zstandard.ZstdCompressor(1).compress(x.tobytes()) for x in counts.reshape(RANGES, -1)]
            yield pa.RecordBatch.from_arrays([*(pa.nulls(RANGES, t.type) for t in shape if t.name not in ("part", "counts")), pa.array(np.arange(RANGES), pa.int32()), pa.array(blobs, pa.binary())], schema=shape)

    return docs.mapInArrow(run, "doc_id long, h1 long, h2 long, n long, slices binary, bits binary, part int, counts binary")


def frequencies(profiles: DataFrame) -> np.ndarray:
    """Eight times the binary logarithm of each cell's count over all documents: BUCKETS bytes, whatever the input.

    Tasks' tables are added range by range, first in eight sums of a range, then these.
    """

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("counts").to_pylist(), strict=True):
                raw = zstandard.ZstdDecompressor().decompress(blob)
                sums[part] = sums.get(part, 0) + np.frombuffer(raw, np.uint32 if len(raw) * RANGES == 4 * BUCKETS else np.uint64).astype(np.uint64)
        blobs = [zstandard.ZstdCompressor(1).compress(x.tobytes()) for x in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(blobs, pa.binary()), pa.array([np.minimum(8 * np.log2(x + 1.0), 255).astype(np.uint8).tobytes() for x in sums.values()], pa.binary())], names=["part", "counts", "logs"])

    shape = "part int, counts binary, logs binary"
    tables = profiles.where("counts is not null").select("part", "counts", F.lit(b"").alias("logs"))
    sums = tables.repartition("part", F.pmod(F.xxhash64("counts"), F.lit(8))).mapInArrow(total, shape).repartition("part").mapInArrow(total, shape)
    out = np.zeros(BUCKETS, np.uint8).reshape(RANGES, -1)
    for part, logs in sums.select("part", "logs").toLocalIterator():
        out[part] = np.frombuffer(logs, np.uint8)
    return out.ravel()


def prefixes(docs: DataFrame, logs: np.ndarray) -> DataFrame:
    """(token, id, size): the rare-first prefix of each set; id is the set's h1, size packs n and the place.

    Equal sets give equal rows, which are merged where lists are made.
    """
    shared = docs.sparkSession.sparkContext.broadcast(logs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        freq, seen = shared.value, set()
        for batch in batches:
            for part in common.slices(batch):
                out: list[tuple] = []
                for s in set_rows(part.column("text")):
                    n = len(s)
                    if not n or (key := (n, s.tobytes() if n < 4 else hash(s.tobytes()))) in seen:
                        continue
                    seen.add(key)
                    first = n - -(-3 * n // 4) + 1
                    id_ = common.mix(common.mix(s + _SEEDS[0]).sum(dtype=np.uint64, keepdims=True))
                    # Order: rarer cell, then smaller hash.
                    order = np.lexsort((s, freq[_cells(s)]))[:first]
                    out.append((s[order], id_[0], n, first))
                if out:
                    sizes = np.array([o[3] for o in out])
                    pos = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)
                    size = (np.repeat(np.array([o[2] for o in out], np.int64), sizes) << 32) | pos
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([o[0] for o in out]).view(np.int64)), pa.array(np.repeat(np.array([o[1] for o in out], np.uint64).view(np.int64), sizes)), pa.array(size)], names=["token", "id", "size"])

    return docs.mapInArrow(run, "token long, id long, size long")


def _linked_share(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The least number of shingles that linked sets of these sizes share."""
    return -(-3 * (n1 + n2) // 7)


def _length(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The length filter."""
    return 4 * np.minimum(n1, n2) >= 3 * np.maximum(n1, n2)


def room(n1: np.ndarray, p1: np.ndarray, n2: np.ndarray, p2: np.ndarray) -> np.ndarray:
    """The positional filter: negative if sets whose first shared shingle stands at p1 and p2 cannot link.

    They share it and at most what follows it in either. In lists of later shared shingles it may be negative for
    linked sets too, so its greatest value over a pair's lists counts.
    """
    return np.minimum(n1 - p1, n2 - p2) - _linked_share(n1, n2)


def least_count(n1: np.ndarray, n2: np.ndarray) -> np.ndarray:
    """The least number of shingles that linked sets share in their prefixes.

    The set whose prefix ends first in the order of shingles has all shared ones that are not in both prefixes
    behind its own, and that holds ceil(3n/4) - 1.
    """
    return _linked_share(n1, n2) - -(-3 * np.maximum(n1, n2) // 4) + 1


def differ(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The number that two sets differ by at least, by their parities."""
    return np.bitwise_count(x ^ y).sum(-1, dtype=np.int64)


def shared_rows(rows: DataFrame, once: str | None = None) -> DataFrame:
    """The rows whose shingle another row has too; rows that are equal in once as well are one row.

    One shuffle, and a task holds two rows of a list at most.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.RecordBatch | None = None  # the last row so far, and whether the one before has its shingle
        matched = False
        for batch in batches:
            if once and batch.num_rows:
                new = np.ones(batch.num_rows, bool)
                key = [batch.column(c).to_numpy() for c in ("token", once)]
                new[1:] = (key[0][1:] != key[0][:-1]) | (key[1][1:] != key[1][:-1])
                new[0] = held is None or any(held.column(c)[0].as_py() != k[0] for c, k in zip(("token", once), key, strict=True))
                batch = batch.filter(pa.array(new))
            if not batch.num_rows:
                continue
            token = batch.column("token").to_numpy()
            same = token[1:] == token[:-1]
            keep = np.zeros(len(token), bool)
            keep[1:] |= same
            keep[:-1] |= same
            if held is not None:
                joins = held.column("token")[0].as_py() == token[0]
                keep[0] |= joins
                if joins or matched:
                    yield held
                matched = bool(joins) if len(token) == 1 else bool(same[-1])
            else:
                matched = bool(len(token) > 1 and same[-1])
            yield batch.slice(0, len(token) - 1).filter(pa.array(keep[:-1]))
            held = batch.slice(len(token) - 1)
        if held is not None and matched:
            yield held

    return rows.repartition("token").sortWithinPartitions("token", *([once] if once else [])).mapInArrow(run, rows.schema)


def star_pairs(rows: DataFrame, near: int = NEAR, best: int = BEST) -> DataFrame:
    """At most best pairs (a, b) for each set: the closest by their parities, of those with the near rows before it in
    a list, the last before it of another component and the list's first, that differ in component and pass the filters.

    rows: (token, id, size, component, bits). The order within a list is by size, coarsely, then by a hash that
    differs from list to list, so that sets of many lists meet many others. The pairs left out matter only if
    components stay apart, and then they come again from long_pairs.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, words = [np.zeros(0, np.int64)] * 4, np.zeros((0, BITS // 64), np.uint64)
        old = 0  # rows that are held of the list that may go on
        for batch in batches:
            if not batch.num_rows:
                continue
            token, id_, size, comp = (np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("token", "id", "size", "component"), strict=True))
            words = np.concatenate([words, _words(batch.column("bits"))])
            n, pos = size >> 32, size & 0xFFFFFFFF
            new = np.append(True, token[1:] != token[:-1])
            turn = new | np.append(True, comp[1:] != comp[:-1])
            first, run_ = (np.maximum.accumulate(np.where(x, np.arange(len(token)), 0)) for x in (new, turn))
            at = np.arange(old, len(token))
            found = []
            for other in (*(at - 1 - k for k in range(near)), run_[at] - 1, first[at]):
                ok = (other >= first[at]) & (other < at)
                i, j = at[ok], other[ok]
                ok = (comp[i] != comp[j]) & _length(n[i], n[j]) & (room(n[i], pos[i], n[j], pos[j]) >= 0)
                i, j = i[ok], j[ok]
                d = differ(words[i], words[j])
                ok = 7 * d <= n[i] + n[j]
                found.append(np.stack([id_[i], id_[j], d])[:, ok])
            out = np.unique(np.concatenate(found, 1), axis=1)
            begin = int(first[-1])
            keep = np.unique(np.concatenate([[begin, max(begin, int(run_[-1]) - 1)], np.arange(max(begin, len(token) - near), len(token))]))
            held, words, old = [c[keep] for c in (token, id_, size, comp)], words[keep], len(keep)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["a", "b", "d"])

    order = ["token", F.floor(4 * F.log(F.shiftright("size", 32).cast("double"))), F.xxhash64("token", "id")]
    found = rows.repartition("token").sortWithinPartitions(*order).mapInArrow(run, "a long, b long, d long").distinct()
    closest = Window.partitionBy("a").orderBy("d", "b")
    return found.withColumn("_r", F.row_number().over(closest)).where(F.col("_r") <= best).select("a", "b")


_PAIRS = "a long, b long, room long, least long, c long"
#: Rows of pairs that a task adds up at a time.
HELD = 1 << 18


def _pair_rows(ids: np.ndarray, n: np.ndarray, pos: np.ndarray, i: np.ndarray, j: np.ndarray) -> pa.RecordBatch:
    columns = (np.minimum(ids[i], ids[j]), np.maximum(ids[i], ids[j]), room(n[i], pos[i], n[j], pos[j]), least_count(n[i], n[j]), np.ones(len(i), np.int64))
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["a", "b", "room", "least", "c"])


def added_up(batches: Iterator[pa.RecordBatch], most: int = HELD) -> Iterator[pa.RecordBatch]:
    """The rows of _pair_rows, those of one pair as one with their number in c; most are held at a time."""

    def total(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        a, b, room_, least, c = (np.concatenate(x) for x in zip(*([v.to_numpy() for v in batch.columns] for batch in held), strict=True))
        by = np.lexsort((b, a))
        a, b, room_, least, c = (x[by] for x in (a, b, room_, least, c))
        first = np.flatnonzero(np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])))
        columns = (a[first], b[first], np.maximum.reduceat(room_, first), np.maximum.reduceat(least, first), np.add.reduceat(c, first))
        return pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=held[0].schema.names)

    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += batch.num_rows
        if size >= most:
            yield total(held)
            held, size = [], 0
    if held:
        yield total(held)


def short_pairs(rows: DataFrame, few: int = FEW) -> DataFrame:
    """A row for each list and pair in it whose components differ, as far as the length filter lets it; lists of few rows.

    rows: (token, id, size, component).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64)] * 4
        for batch in batches:
            old = len(held[0])
            held = [np.concatenate([h, batch.column(c).to_numpy()]) for h, c in zip(held, ("token", "id", "size", "component"), strict=True)]
            token, id_, size, comp = held
            n, pos = size >> 32, size & 0xFFFFFFFF
            for k in range(1, few):
                j = np.arange(max(old, k), len(token))
                i = j - k
                ok = (token[i] == token[j]) & (comp[i] != comp[j]) & _length(n[i], n[j])
                yield _pair_rows(id_, n, pos, i[ok], j[ok])
            held = [c[max(0, len(c) - few + 1) :] for c in held]

    return rows.repartition("token").sortWithinPartitions("token").mapInArrow(run, _PAIRS)


def cells(rows: DataFrame, component: str, id_: str, limit: int) -> DataFrame:
    """What dealt gives, by cell (token, i, j)."""
    return dealt(rows, component, id_, limit).repartition("token", "i", "j").sortWithinPartitions("token", "i", "j")


def dealt(rows: DataFrame, component: str, id_: str, limit: int) -> DataFrame:
    """rows of lists of several components with i, j, right and outside: a row for each cell (token, i, j).

    All rows of a list are dealt by one hash into parts of about limit, those outside its largest component by another,
    and each part of the former (not right) meets each of the latter (right). So a row of the largest component is
    copied once for every limit rows outside it.
    """
    counts = rows.groupBy("token", component).agg(F.count("*").alias("c"))
    mixed = counts.groupBy("token").agg(F.sum("c").alias("total"), F.count("*").alias("several"), F.max(F.struct("c", component)).alias("main")).where("several > 1")
    names = rows.columns
    rows = rows.join(mixed, "token").withColumn("outside", F.col(component) != F.col(f"main.{component}"))
    parts = F.ceil(F.col("total") / limit).cast("int")
    others = F.ceil((F.col("total") - F.col("main.c")) / limit).cast("int")
    own = F.pmod(F.xxhash64(id_), parts).cast("int")
    mate = F.pmod(F.xxhash64(id_, F.lit(1)), others).cast("int")
    left = F.transform(F.sequence(F.lit(0), others - 1), lambda j: F.struct(own.alias("i"), j.alias("j"), F.lit(False).alias("right")))
    right = F.transform(F.sequence(F.lit(0), parts - 1), lambda i: F.struct(i.alias("i"), mate.alias("j"), F.lit(True).alias("right")))
    found = rows.withColumn("cell", F.explode(F.when(F.col("outside"), F.concat(left, right)).otherwise(left)))
    return found.select("cell.i", "cell.j", "cell.right", "outside", *names)


def long_pairs(rows: DataFrame, limit: int = LIST) -> DataFrame:
    """The pairs of each list whose components differ, as far as the length and suffix filters let them; c is in how many lists.

    rows: (token, id, size, component, bits). A pair has a row for each task that finds it, not for each list.
    """
    dealt = cells(rows, "component", "id", limit)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in tables_of_cells(batches):
            right, outside = (table.column(c).to_numpy(zero_copy_only=False) for c in ("right", "outside"))
            id_, size, comp = (table.column(c).to_numpy() for c in ("id", "size", "component"))
            n, pos, words = size >> 32, size & 0xFFFFFFFF, _words(table.column("bits"))
            x, y = np.flatnonzero(~right), np.flatnonzero(right)
            for at in range(0, len(x), 256):
                p = x[at : at + 256]
                # Two rows outside the largest component meet in two cells.
                ok = (comp[p, None] != comp[y]) & _length(n[p, None], n[y]) & (~outside[p, None] | (id_[p, None] < id_[y]))
                r, c = np.nonzero(ok)
                i, j = p[r], y[c]
                ok = 7 * differ(words[i], words[j]) <= n[i] + n[j]
                yield _pair_rows(id_, n, pos, i[ok], j[ok])

    return dealt.mapInArrow(lambda batches: added_up(run(batches)), _PAIRS)


def tables_of_cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each (token, i, j), which stand together."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = [batch.column(c).to_numpy() for c in ("token", "i", "j")]
        edges = np.flatnonzero(np.logical_or.reduce([k[1:] != k[:-1] for k in keys])) + 1
        if held and any(held[-1].column(c)[0].as_py() != k[0] for c, k in zip(("token", "i", "j"), keys, strict=True)):
            edges = np.append(0, edges)
        start = 0
        for e in edges.tolist():
            if e > start:
                held.append(batch.slice(start, e - start))
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]
            held, start = [], e
        held.append(batch.slice(start))
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def verify(pairs: DataFrame, docs: DataFrame, classes: DataFrame) -> DataFrame:
    """The pairs of sets (a, b) that link, as documents (a, b): the finer suffix filter, then the sets, once a pair.

    Which sets are wanted is marked in a table of WANTED cells, so that few others are read into sets and moved.
    """

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("na", "nb", "sa", "sb")), strict=True)
            ok = [7 * least_difference(s, t) <= m + n for m, n, s, t in rows]
            yield batch.filter(pa.array(ok, pa.bool_())).select(["a", "b"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = np.zeros(batch.num_rows, bool)
            for k, (x, y) in enumerate(zip(batch.column("sa"), batch.column("sb"), strict=True)):
                kept = np.concatenate([np.frombuffer(s.as_buffer(), np.uint8).reshape(-1, KEPT) for s in (x, y)])
                both = np.zeros((len(kept), 8), np.uint8)
                both[:, :KEPT] = kept
                both = both.view(np.uint64).ravel()
                both.sort()
                shared = int((both[1:] == both[:-1]).sum())
                ok[k] = 100 * shared >= 75 * (len(both) - shared)
            yield batch.filter(pa.array(ok)).select(["a", "b"])

    brief = classes.select("id", "root", "n", "slices")
    joined = pairs.join(brief.toDF("a", "ra", "na", "sa"), "a").join(brief.toDF("b", "rb", "nb", "sb"), "b")
    near = common.materialize(joined.select(F.col("ra").alias("a"), F.col("rb").alias("b"), "na", "nb", "sa", "sb").mapInArrow(far, "a long, b long"))
    held = common.materialize(_sets(docs, _marked(near.select(F.explode(F.array("a", "b")).alias("id")))))
    both = near.join(held.toDF("a", "sa"), "a").join(held.toDF("b", "sb"), "b")
    found = common.materialize(both.select("a", "b", "sa", "sb").mapInArrow(compare, "a long, b long"))
    common.discard(near, held)
    return found


def _spot(ids: np.ndarray) -> np.ndarray:
    return (common.mix(ids.astype(np.int64).view(np.uint64)) & np.uint64(WANTED - 1)).astype(np.int64)


def _marked(ids: DataFrame) -> np.ndarray:
    """A bit for each cell that one of the ids falls into: WANTED bits, whatever the input, added up range by range."""
    span = WANTED // 8 // RANGES

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spots = [np.unique(_spot(batch.column("id").to_numpy())) for batch in batches if batch.num_rows]
        spots = np.unique(np.concatenate([*spots, np.zeros(0, np.int64)]))
        for part in np.unique(spots // (8 * span)).tolist():
            bits = np.zeros(span, np.uint8)
            own = spots[spots // (8 * span) == part] - part * 8 * span
            np.bitwise_or.at(bits, own >> 3, np.uint8(1) << (own & 7).astype(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([zstandard.ZstdCompressor(1).compress(bits.tobytes())], pa.binary())], names=["part", "bits"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, blob in zip(batch.column("part").to_pylist(), batch.column("bits").to_pylist(), strict=True):
                sums[part] = sums.get(part, np.zeros(span, np.uint8)) | np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zstandard.ZstdCompressor(1).compress(x.tobytes()) for x in sums.values()], pa.binary())], names=["part", "bits"])

    shape = "part int, bits binary"
    out = np.zeros((RANGES, span), np.uint8)
    for part, blob in ids.mapInArrow(mark, shape).repartition("part").mapInArrow(total, shape).toLocalIterator():
        out[part] = np.frombuffer(zstandard.ZstdDecompressor().decompress(blob), np.uint8)
    return out.ravel()


def _sets(docs: DataFrame, marks: np.ndarray) -> DataFrame:
    """(id, set) of the documents whose cell is marked: KEPT bytes of each shingle's hash."""
    shared = docs.sparkSession.sparkContext.broadcast(marks)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spot = _spot(batch.column("doc_id").to_numpy())
            batch = batch.filter(pa.array((shared.value[spot >> 3] >> (spot & 7).astype(np.uint8) & 1).astype(bool)))
            for part in common.slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([np.ascontiguousarray(s.view(np.uint8).reshape(-1, 8)[:, :KEPT]).tobytes() for s in set_rows(part.column("text"))], pa.binary())], names=["id", "set"])

    return docs.mapInArrow(run, "id long, set binary")


def join(docs: DataFrame, few: int = FEW, limit: int = LIST) -> DataFrame:
    """(doc_id, n_shingles, component_id): links at a Jaccard similarity of 0.75 of five-word shingles.

    The words are those between white space, A-Z lower-cased; fewer than five words are one shingle. Null texts
    and those without words have an empty set and no links. Rows that repeat a doc_id keep their own
    n_shingles; a link of either's text is a link of the id. A null doc_id takes no part in links and comes out with a null component. An empty table
    gives no rows. Other columns play no part.
    """
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text())
    known = table.where("doc_id is not null")
    profiles = common.materialize(profile(table))
    full = profiles.where("n > 0 and doc_id is not null")
    classes = common.materialize(full.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("root"), F.min(F.struct("slices", "bits")).alias("s")).select(F.col("h1").alias("id"), "h2", "n", "root", "s.slices", "s.bits"))
    same = full.select(F.col("h1").alias("id"), "h2", "n", "doc_id").join(classes.select("id", "h2", "n", "root"), ["id", "h2", "n"]).where("doc_id <> root").select(F.col("doc_id").alias("a"), F.col("root").alias("b"))
    lists = common.materialize(shared_rows(prefixes(known, frequencies(profiles)), "id"))
    tokens = lists.groupBy("token").agg(F.count("*").alias("c")).where(F.col("c") > few).select("token")
    long = common.materialize(lists.join(tokens, "token").join(classes.select("id", "bits"), "id").select("token", "id", "size", "bits"))
    edges = [common.materialize(same)]
    placed = classes.select("id", F.col("root").alias("component"))
    member = None
    for _ in range(ROUNDS):
        edges.append(verify(star_pairs(long.join(placed, "id")), known, classes))
        member, old = common.materialize(components(_all(edges))), member
        common.discard(*([old] if old else []))
        placed = classes.join(member.withColumnRenamed("id", "root"), "root", "left").select("id", F.coalesce("component", "root").alias("component"))
    short = lists.join(tokens, "token", "left_anti")
    pairs = short_pairs(short.join(placed, "id"), few).union(long_pairs(long.join(placed, "id"), limit))
    counted = pairs.groupBy("a", "b").agg(F.sum("c").alias("c"), F.max("room").alias("room"), F.max("least").alias("least")).where("room >= 0 and c >= least")
    edges.append(verify(counted.select("a", "b"), known, classes))
    common.discard(lists, long)
    if edges[-1].limit(1).count():
        member = components(_all(edges))
    sizes = profiles.where("slices is not null").select("doc_id", F.col("n").alias("n_shingles"))
    out = sizes.join(member.withColumnRenamed("id", "doc_id"), "doc_id", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))


def _all(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.union(t)
    return out


def distinct_documents(docs: DataFrame) -> DataFrame:
    """One document of each group of linked ones, that of the smallest doc_id, with all columns.

    Rows with a null doc_id stay; rows of one doc_id stay or go together.
    """
    first = join(docs).where("doc_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_anti").select(*docs.columns)
