"""Suffix-array dedup: bytes covered by a string of LENGTH bytes that starts anywhere else too.

1. Runs. The smallest hash of the GRAM-byte strings inside a window of LENGTH bytes is the window's key. Equal
   windows have equal keys, so only windows of one key need comparing. Neighbouring windows mostly share their
   key; a maximal run of them is one row (key, hash of the run's bytes, doc_id, first window, windows), about one
   for 80 bytes of text.
2. Rows of a key that no other row has are dropped, if their own windows cannot repeat either. Of the rest, runs with equal
   bytes (exact copies, the inside of long repeated passages) are one class: with two members or more all their
   windows repeat. One member of each class stands for it.
3. Keys with several classes (the edges of passages) are compared by a suffix array over their windows, ordered
   by deep-shallow sorting (see sorting.py) as far as LENGTH bytes: windows that share LENGTH bytes with a
   neighbour in the array repeat. A key of more than BLOCK classes is dealt into blocks; windows that stay alone
   in their block meet those of the other blocks by hash, one row for each distinct window of a block.
4. The ranges of repeated windows return to their documents, and are cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.llm import common
from cloudweave.llm.sorting import repeated_windows

LENGTH, GRAM = 200, 32
#: Windows of one row at most, and classes of one key that are compared in one block.
RUN, BLOCK = 4096, 1 << 15
#: Windows that are sorted at a time; a larger group's are dealt by their first bytes.
SORTED = 1 << 19
#: Bytes of a text from which runs are found at a time, and context bytes that one suffix array covers.
PIECE, CONTEXT = 1 << 20, 1 << 19

_R = np.uint64(0xD6E8FEB86659FD93)


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of _R and of its inverse modulo 2**64."""
    inverse = np.uint64(pow(int(_R), -1, 1 << 64))
    out = []
    for base in (_R, inverse):
        p = np.full(n, base, np.uint64)
        p[0] = 1
        out.append(np.cumprod(p, dtype=np.uint64))
    return out[0], out[1]


_POWERS: list[np.ndarray] = []


def prefix_sums(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sums of bytes times powers, from which the hash of any range follows; and the inverse powers."""
    if not _POWERS or len(_POWERS[0]) < len(buf) + 1:
        _POWERS[:] = _powers(max(len(buf) + 1, PIECE + 4 * LENGTH))
    # Bytes first become words without pattern, so that no two short texts sum alike by design.
    words = _LETTERS[buf]
    sums = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(words * _POWERS[0][: len(buf)], out=sums[1:])
    return sums, _POWERS[1]


_LETTERS = common.mix(np.arange(1, 257, dtype=np.uint64) * common._GOLD)


def range_hash(sums: np.ndarray, inverse: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return common.mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64) * common._GOLD)


def window_runs(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(row, first window, windows, inner, key, hash of the bytes) of all runs in the rows of buf.

    inner: windows of the run may repeat each other. Then the run's bytes have a period, so the string of least
    hash leaves the window at some step and the key stays; only such runs are marked.
    """
    n = int(offsets[-1])
    sizes = np.diff(offsets)
    none = np.zeros(0, np.int64)
    if n < LENGTH or not (sizes >= LENGTH).any():
        return none, none, none, none.astype(bool), none.view(np.uint64), none.view(np.uint64)
    sums, inverse = prefix_sums(buf[:n])
    grams = n - GRAM + 1
    h = common.mix((sums[GRAM:] - sums[:-GRAM]) * inverse[:grams])
    # The least of LENGTH - GRAM + 1 neighbours, by doubling.
    need, width, low = LENGTH - GRAM + 1, 1, h
    while 2 * width <= need:
        low = np.minimum(low[:-width], low[width:])
        width *= 2
    if width < need:
        low = np.minimum(low[: len(low) - (need - width)], low[need - width :])
    valid = np.zeros(len(low), bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        if b - a >= LENGTH:
            valid[a : b - LENGTH + 1] = True
    at = np.flatnonzero(valid)
    key = low[at]
    row = np.searchsorted(offsets, at, "right") - 1
    new = np.append(True, (key[1:] != key[:-1]) | (at[1:] != at[:-1] + 1) | (row[1:] != row[:-1]))
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(at)))
    leaves = h[at] == key
    leaves[np.append(first[1:], len(at)) - 1] = False
    inner = np.logical_or.reduceat(leaves, first)
    if (count > RUN).any():
        pieces = -(-count // RUN)
        step = np.arange(int(pieces.sum())) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, left = np.repeat(first, pieces) + step * RUN, np.repeat(count, pieces) - step * RUN
        count, inner = np.minimum(left, RUN), np.repeat(inner, pieces)
    begin = at[first]
    return row[first], begin - offsets[row[first]], count, inner, key[first], range_hash(sums, inverse, begin, begin + count - 1 + LENGTH)


def runs(docs: DataFrame, piece: int = PIECE) -> DataFrame:
    """(key, run, doc_id, start, n, inner) of all windows of all texts. A long text is read in pieces that overlap."""

    def out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch):
                buf, offsets = common.text_bytes(part.column("text"))
                ids = part.column("doc_id")
                spans = [(buf, offsets, 0, 0)]
                if offsets[-1] > 2 * piece:
                    own = [(k, buf[a:b]) for k, (a, b) in enumerate(zip(offsets[:-1], offsets[1:], strict=True)) if b > a]
                    spans = [(x[a : a + piece + LENGTH - 1], None, a, k) for k, x in own for a in range(0, len(x), piece)]
                for data, off, shift, base in spans:
                    off = np.array([0, len(data)]) if off is None else off
                    row, start, n, inner, key, run = window_runs(data, off)
                    if len(row):
                        yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(run.view(np.int64)), ids.take(pa.array(row + base)), pa.array((start + shift).astype(np.int64)), pa.array(n.astype(np.int32)), pa.array(inner)], names=["key", "run", "doc_id", "start", "n", "inner"])

    return docs.mapInArrow(out, "key long, run long, doc_id long, start long, n int, inner boolean")


def _contexts(chosen: DataFrame, texts: DataFrame) -> DataFrame:
    """The bytes of each chosen run: (key, block, doc_id, start, n, bytes)."""
    spans = chosen.groupBy("doc_id").agg(F.collect_list(F.struct("key", "block", "start", "n", "alone")).alias("runs"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ("key", "block", "start", "n", "alone")
        for batch in batches:
            for part in common.slices(batch):
                lists = part.column("runs")
                flat = lists.flatten()
                buf, offsets = common.text_bytes(part.column("text"))
                owner = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
                columns = [flat.field(k) for k in range(5)]
                begin = offsets[owner] + columns[2].to_numpy()
                size = columns[3].to_numpy().astype(np.int64) + LENGTH - 1
                raw = memoryview(buf)
                data = pa.array([bytes(raw[a : a + s]) for a, s in zip(begin.tolist(), size.tolist(), strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*columns, part.column("doc_id").take(pa.array(owner)), data], names=[*names, "doc_id", "bytes"])

    return texts.join(spans, "doc_id").mapInArrow(cut, "key long, block int, start long, n int, alone boolean, doc_id long, bytes binary")


def _compare(batches: Iterator[pa.RecordBatch], most: int = SORTED) -> Iterator[pa.RecordBatch]:
    """Repeated windows of each (key, block), rows sorted by them: (doc_id, start, n, key, h1, h2).

    A row with h1 null says that n windows from start on repeat. Where a key has other blocks, each window that
    did not is a row with its hash, and so is one of each set of windows that did (n = 0).
    """

    def rows(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        key, block, start, n, doc = (table.column(c) for c in ("key", "block", "start", "n", "doc_id"))
        buf, offsets = common.text_bytes(table.column("bytes"))
        counts = n.to_numpy().astype(np.int64)
        group = np.cumsum(np.append(True, (np.diff(key.to_numpy()) != 0) | (np.diff(block.to_numpy()) != 0))) - 1
        owner = np.repeat(np.arange(len(counts), dtype=np.int32), counts)
        offset = (np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)).astype(np.int32)
        at = offsets[owner] + offset
        again, first = np.zeros(len(at), bool), np.zeros(len(at), bool)
        passes = -(-len(at) // most)
        deal = (common.mix(common.unaligned_u64(buf)[at]) % np.uint64(passes)).astype(np.uint16) if passes > 1 else None
        for k in range(passes):
            own = slice(None) if deal is None else np.flatnonzero(deal == k)
            again[own], first[own] = repeated_windows(buf, at[own], group[owner[own]], LENGTH)
        # Ranges of windows that repeat, within a run.
        hit = np.flatnonzero(again)
        new = np.append(True, (np.diff(hit) != 1) | (owner[hit[1:]] != owner[hit[:-1]])) if len(hit) else np.zeros(0, bool)
        edge = np.flatnonzero(new)
        head = hit[edge]
        length = np.diff(np.append(edge, len(hit)))
        starts = start.to_numpy()
        out = [(owner[head], starts[owner[head]] + offset[head], length, None)]
        alone = table.column("alone").to_numpy(zero_copy_only=False)
        if not alone.all():
            open_ = np.flatnonzero(~alone[owner] & (~again | first))
            sums, inverse = prefix_sums(buf)
            h = range_hash(sums, inverse, at[open_], at[open_] + LENGTH)
            h2 = common.span_hashes(buf, at[open_], np.full(len(open_), LENGTH))
            out.append((owner[open_], starts[owner[open_]] + offset[open_], np.where(again[open_], 0, 1), (h, h2)))
        parts = []
        for o, s, c, h in out:
            hashes = [pa.nulls(len(o), pa.int64())] * 2 if h is None else [pa.array(x.view(np.int64)) for x in h]
            parts.append(pa.RecordBatch.from_arrays([doc.take(pa.array(o)), pa.array(s), pa.array(c.astype(np.int32)), *hashes], names=["doc_id", "start", "n", "h1", "h2"]))
        return pa.Table.from_batches(parts).combine_chunks().to_batches()

    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in common.slices(batch, CONTEXT, "bytes"):
            key, block = part.column("key").to_numpy(), part.column("block").to_numpy()
            edges = np.flatnonzero((np.diff(key) != 0) | (np.diff(block) != 0)) + 1
            if held and (held[-1].column("key")[-1].as_py() != key[0] or held[-1].column("block")[-1].as_py() != block[0]):
                edges = np.append(0, edges)
            if size >= CONTEXT and len(edges):  # a group is never split
                cut = int(edges[0])
                if cut:
                    held.append(part.slice(0, cut))
                yield from rows(held)
                held, size, part = [], 0, part.slice(cut)
            held.append(part)
            size += part.column("bytes").nbytes
    if held:
        yield from rows(held)


def repeated_ranges(docs: DataFrame, texts: DataFrame, piece: int = PIECE, most: int = SORTED) -> DataFrame:
    """(doc_id, start, n): windows from start on that repeat. docs and texts: (doc_id, text), texts as they join."""
    table = common.materialize(runs(docs, piece))
    keys = table.groupBy("key").agg(F.count("*").alias("c"), F.max("inner").alias("inner")).where("c > 1 or inner").select("key")
    shared = common.materialize(table.join(keys, "key"))
    classes = common.materialize(shared.groupBy("key", "run", "n").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "start")).alias("first"), F.max("inner").alias("inner")))
    whole = shared.join(classes.where("c > 1").select("key", "run", "n"), ["key", "run", "n"], "left_semi").select("doc_id", "start", "n")
    several = classes.groupBy("key").agg(F.count("*").alias("classes"), F.min("c").alias("least"), F.max("inner").alias("inner")).where("least = 1 and (classes > 1 or inner)").drop("inner")
    blocks = F.ceil(F.col("classes") / BLOCK).cast("int")
    chosen = classes.join(several.withColumn("blocks", blocks), "key").select(
        "key", F.pmod(F.col("run"), F.col("blocks")).cast("int").alias("block"), F.col("first.doc_id").alias("doc_id"), F.col("first.start").alias("start"), "n", (F.col("blocks") == 1).alias("alone")
    )
    dealt = _contexts(chosen, texts).repartition("key", "block").sortWithinPartitions("key", "block")
    compared = common.materialize(dealt.mapInArrow(lambda batches: _compare(batches, most), "doc_id long, start long, n int, h1 long, h2 long"))
    inside = compared.where("h1 is null").select("doc_id", "start", "n")
    open_ = compared.where("h1 is not null")
    met = open_.groupBy("h1", "h2").agg(F.count("*").alias("c")).where("c > 1").select("h1", "h2")
    across = open_.where("n = 1").join(met, ["h1", "h2"], "left_semi").select("doc_id", "start", "n")
    return whole.union(inside).union(across)


def _with_spans(docs: DataFrame, own: list[str], **limits: int) -> DataFrame:
    """docs with further columns, named by own: the id, the whole text, and the ranges of windows that repeat.

    A row's key is its id, or a 64-bit hash of id and text where ids are missing or repeat.
    """
    id_, text, spans = own
    (key,) = common.fresh(docs, "_key")
    table = docs.withColumn(id_, F.col("doc_id").cast("long")).withColumn(text, common.whole_text())
    clash = table.groupBy(id_).agg(F.count("*").alias("c")).where(f"c > 1 or `{id_}` is null").limit(1).count()
    table = table.withColumn(key, F.xxhash64(id_, text) if clash else F.col(id_))
    texts = table.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    found = repeated_ranges(texts, texts, **limits)
    ranges = found.groupBy(F.col("doc_id").alias(key)).agg(F.collect_list(F.struct("start", "n")).alias(spans))
    return table.join(ranges, key, "left").select(*docs.columns, *own)


def covered(windows: list[dict]) -> list[tuple[int, int]]:
    """The maximal byte ranges that the windows cover."""
    out: list[tuple[int, int]] = []
    for a, b in sorted((x["start"], x["start"] + x["n"] - 1 + LENGTH) for x in windows):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def without(data: bytes, ranges: list[tuple[int, int]]) -> bytes:
    edges = [0, *(x for r in ranges for x in r), len(data)]
    return b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def dedup(docs: DataFrame, **limits: int) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of each document.

    A byte goes if a LENGTH-byte string that covers it also starts anywhere else, in this document or another;
    all strings are judged on the input. Null and empty texts have no bytes. Rows that share a doc_id, or
    have none, are documents of their own, told apart by a 64-bit hash of id and text; rows equal in both lose
    the same bytes. An empty table gives no rows. Other columns play no part. limits: piece, the bytes of a long text
    that are read at a time, and most, the windows that are sorted at a time; neither changes the result.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.slices(batch, column="_text"):
                rows = []
                for text, got in zip(part.column("_text").to_pylist(), part.column("_spans").to_pylist(), strict=True):
                    data, ranges = text.encode(), covered(got or [])
                    rows.append((len(data), sum(b - a for a, b in ranges), len(ranges), hashlib.sha256(without(data, ranges)).hexdigest()))
                columns = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (*[pa.int64()] * 3, pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("_id"), *columns], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return _with_spans(docs.select("doc_id", "text"), ["_id", "_text", "_spans"], **limits).select("_id", "_text", "_spans").mapInArrow(cut, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cut_documents(docs: DataFrame) -> DataFrame:
    """docs with what is left of each text; a character that a cut divides is dropped.

    A null text stays null, an empty one empty. All places of a repeated string are cut, so of equal rows, with one id or several, none keeps a text of 200
    bytes or more. An empty table stays empty; other columns stay as they are, whatever their names.
    """
    names = docs.columns
    own = common.fresh(docs, "_id", "_text", "_spans")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [text if not got else without(text.encode(), covered(got)).decode("utf-8", "ignore") for text, got in zip(batch.column("text").to_pylist(), batch.column(own[2]).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(kept, pa.string()) if n == "text" else batch.column(n) for n in names], names=names)

    return _with_spans(docs, own).select(*names, own[2]).mapInArrow(cut, docs.schema)
