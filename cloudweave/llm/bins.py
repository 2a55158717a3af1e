"""Token-id output: best-fit-decreasing packing with a segment tree over capacities, as id matrices."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.llm import common, tokens

#: Ids that a task packs at a time: more pack better, fewer hold less memory.
SPAN = 1 << 22


@dataclass(frozen=True)
class Config:
    tokenizer: str = ""
    window: int = tokens.WINDOW
    end: int = tokens.END
    pad: int = 0


class Capacities:
    """Open bins by the room they have left; the fullest that still fits is found in log(window) steps."""

    def __init__(self, window: int):
        self.size = 1 << window.bit_length()
        self.count = [0] * (2 * self.size)
        self.bins: list[list[int]] = [[] for _ in range(window + 1)]

    def put(self, room: int, number: int) -> None:
        self.bins[room].append(number)
        self._change(room, 1)

    def _change(self, room: int, by: int) -> None:
        i = room + self.size
        while i:
            self.count[i] += by
            i >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """The bin of least room >= need, with its room; None if there is none."""
        i = need + self.size
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.size
        self._change(room, -1)
        return room, self.bins[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Each piece's bin and offset there, longest pieces first, and the number of bins. Lengths: 1 to window."""
    tree, bins, offsets, made = Capacities(window), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        found = tree.take(n)
        room, number = found if found else (window, made)
        made += found is None
        bins[i], offsets[i] = number, window - room
        if room > n:
            tree.put(room - n, number)
    return bins, offsets, made


def matrices(docs: DataFrame, conf: Config = Config()) -> DataFrame:
    """Packed sequences: sequence_id, ids (window of them), cu_seqlens, positions, doc_ids, starts.

    cu_seqlens are the cumulative lengths of the segments in a sequence, from 0; positions count from 0 again
    in each segment (and in the padding). doc_ids and starts say which ids of which document a segment is. A
    document longer than a window is split into whole windows and a rest, so nothing is lost. A null or empty
    text is the end id alone; repeated ids are packed each; a null id stays null. An empty table gives no rows.
    Each task packs its own rows, SPAN ids at a time; no row moves to another.
    """
    path = conf.tokenizer or tokens.default_path()
    window = conf.window

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base, made = TaskContext.get().partitionId() << 36, 0
        words, end = tokens.tokenizer(path), np.array([conf.end], "<i4").tobytes()
        held: list[tuple[int | None, bytes]] = []
        size = 0
        for batch in batches:
            for part in common.slices(batch, 1 << 22):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    held.append((doc, words.ids(text) + end))
                    size += len(held[-1][1]) // 4
                    if size >= SPAN:
                        for out, n in _sequences(held, window, conf.pad, base + made):
                            made += n
                            yield out
                        held, size = [], 0
        if held:
            for out, _ in _sequences(held, window, conf.pad, base + made):
                yield out

    shape = "sequence_id long, ids array<int>, cu_seqlens array<int>, positions array<int>, doc_ids array<long>, starts array<long>"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text()).mapInArrow(run, shape)


def _sequences(held: list[tuple[int | None, bytes]], window: int, pad: int, base: int) -> Iterator[tuple[pa.RecordBatch, int]]:
    pieces = [(d, s, min(window, len(ids) // 4 - s)) for d, (_, ids) in enumerate(held) for s in range(0, len(ids) // 4, window)]
    bins, offsets, made = best_fit(np.array([p[2] for p in pieces]), window)
    order = np.lexsort((offsets, bins)).tolist()
    firsts = np.searchsorted(bins[order], np.arange(made + 1)).tolist()
    for at in range(0, made, 256):
        n = min(256, made - at)
        ids, pos = np.full((n, window), pad, np.int32), np.tile(np.arange(window, dtype=np.int32), (n, 1))
        cu, docs, starts = [], [], []
        for b in range(n):
            used, c, row_docs, row_starts = 0, [0], [], []
            for i in order[firsts[at + b] : firsts[at + b + 1]]:
                d, s, m = pieces[i]
                ids[b, used : used + m] = np.frombuffer(held[d][1], "<i4", m, 4 * s)
                pos[b, used:] -= pos[b, used] if used < window else 0
                used += m
                c.append(used)
                row_docs.append(held[d][0])
                row_starts.append(s)
            if used < window:
                pos[b, used:] -= pos[b, used]
            cu.append(c)
            docs.append(row_docs)
            starts.append(row_starts)
        grid = pa.array(np.arange(0, (n + 1) * window, window, dtype=np.int32))
        yield pa.RecordBatch.from_arrays([
            pa.array(base + at + np.arange(n, dtype=np.int64)), pa.ListArray.from_arrays(grid, pa.array(ids.ravel())), pa.array(cu, pa.list_(pa.int32())),
            pa.ListArray.from_arrays(grid, pa.array(pos.ravel())), pa.array(docs, pa.list_(pa.int64())), pa.array(starts, pa.list_(pa.int64())),
        ], names=["sequence_id", "ids", "cu_seqlens", "positions", "doc_ids", "starts"]), n


def write(docs: DataFrame, path: str, conf: Config = Config()) -> None:
    """The sequences as Parquet; ids and positions as little-endian 32-bit binary, ready for np.frombuffer. Rows as matrices gives them; an empty table writes none."""
    packed = matrices(docs, conf)

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            columns = dict(zip(b.schema.names, b.columns, strict=True))
            for name in ("ids", "positions"):
                rows = columns[name].flatten().to_numpy().astype("<i4").reshape(-1, conf.window)
                columns[name] = pa.array([r.tobytes() for r in rows], pa.binary())
            yield pa.RecordBatch.from_pydict(columns)

    packed.mapInArrow(flat, "sequence_id long, ids binary, cu_seqlens array<int>, positions binary, doc_ids array<long>, starts array<long>").write.parquet(path)


def digests(docs: DataFrame, conf: Config = Config()) -> DataFrame:
    """A row for each packed segment, checked against the matrices: doc_id, start, length, sequence_id, offset, ids_crc32, positions_ok.

    Null and empty texts are the end id alone; rows of one id are packed each, and a null id stays null. An empty table gives no
    rows. Other columns play no part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: dict[str, list] = {n: [] for n in ("doc_id", "start", "length", "sequence_id", "offset", "ids_crc32", "positions_ok")}
            ids, pos = (b.column(n).flatten().to_numpy().reshape(-1, conf.window) for n in ("ids", "positions"))
            for r, (seq, cu, docs, starts) in enumerate(zip(*(b.column(n).to_pylist() for n in ("sequence_id", "cu_seqlens", "doc_ids", "starts")), strict=True)):
                for a, z, d, s in zip(cu[:-1], cu[1:], docs, starts, strict=True):
                    got = (d, s, z - a, seq, a, zlib.crc32(ids[r, a:z].astype("<u4").tobytes()), bool(pos[r, a] == 0 and pos[r, z - 1] == z - a - 1))
                    for n, v in zip(rows, got, strict=True):
                        rows[n].append(v)
            kinds = {n: pa.bool_() if n == "positions_ok" else pa.int64() for n in rows}
            yield pa.RecordBatch.from_pydict({n: pa.array(v, kinds[n]) for n, v in rows.items()})

    return matrices(docs, conf).mapInArrow(run, "doc_id long, start long, length long, sequence_id long, offset long, ids_crc32 long, positions_ok boolean")
