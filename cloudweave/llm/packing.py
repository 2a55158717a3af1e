"""Packing: order-preserving dynamic programming over document and sentence boundaries."""

from __future__ import annotations

import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.llm import common, tokens

#: What a cut costs, in tokens of padding: after a document, after a sentence, anywhere else.
DOCUMENT_CUT, SENTENCE_CUT, FREE_CUT = 0, 8, 64
#: What a sequence costs besides, so that powers of two do not make many short ones; tokens between free cuts.
NEW_WINDOW, FREE_STEP = 4, 32
#: Sequences shorter than 2**LEAST_POWER are only for the end of a range of documents.
LEAST_POWER = 7
#: Tokens over which one program runs; the rest of less than a window goes on to the next.
SPAN = 1 << 18


@dataclass(frozen=True)
class Config:
    tokenizer: str = ""
    window: int = tokens.WINDOW
    end: int = tokens.END
    #: Ids after which a sentence ends; found from the tokenizer where empty.
    stops: tuple[int, ...] = ()


def cuts(at: np.ndarray, price: np.ndarray, window: int, last: bool) -> list[int]:
    """Positions of the cuts that cost least, from at[0] on; at: where cuts may be, ascending, at most window apart.

    A window from at[i] to at[j] costs its padding (none where its length is a power of two, else window less
    its length) and price[j]. The least of cost[i] + at[i] over the starts within a window of j is kept in a
    monotone queue, so a step takes constant time, and each power of two adds one look-up. Unless last, the
    program ends at the cheapest boundary within a window of the end.
    """
    spots, prices = at.tolist(), (price + NEW_WINDOW).tolist()
    exact: dict[int, list[int]] = {}  # boundary -> those a power of two before it
    for w in (1 << b for b in range(0 if last else LEAST_POWER, window.bit_length()) if 1 << b <= window):
        before = np.searchsorted(at, at - w)
        for j in np.flatnonzero(at[np.minimum(before, len(at) - 1)] == at - w).tolist():
            exact.setdefault(j, []).append(int(before[j]))
    cost, back = [0.0] * len(spots), [0] * len(spots)
    queue: deque[tuple[float, int]] = deque([(float(spots[0]), 0)])
    for j in range(1, len(spots)):
        p = spots[j]
        while spots[queue[0][1]] < p - window:
            queue.popleft()
        best, i = queue[0]
        best += window - p
        if j in exact:
            for k in exact[j]:
                if cost[k] < best:
                    best, i = cost[k], k
        cost[j] = best = best + prices[j]
        back[j] = i
        value = best + p
        while queue and queue[-1][0] >= value:
            queue.pop()
        queue.append((value, j))
    j = len(spots) - 1
    if not last:
        near = range(int(np.searchsorted(at, spots[-1] - window, "right")), len(spots))
        j = min((k for k in near if k), key=lambda k: cost[k] + spots[-1] - spots[k])
    out = []
    while j:
        out.append(spots[j])
        j = back[j]
    return out[::-1]


class Packer:
    """Takes documents in order, gives pieces (document, start, sequence, offset, ids)."""

    def __init__(self, conf: Config, stops: np.ndarray, span: int = SPAN):
        self.conf, self.stops, self.span = conf, stops, span
        self.parts: list[np.ndarray] = []  # ids that wait, a part for each document
        self.docs: list[tuple] = []  # (document, ids of it already out)
        self.held = 0
        self.sequence = 0

    def add(self, doc: object, ids: np.ndarray) -> Iterator[tuple]:
        self.parts.append(ids)
        self.docs.append((doc, 0))
        self.held += len(ids)
        if self.held >= self.span:
            yield from self.flush(False)

    def flush(self, last: bool) -> Iterator[tuple]:
        if not self.held:
            return
        window, ids = self.conf.window, np.concatenate(self.parts)
        ends = np.cumsum([len(p) for p in self.parts])
        price = np.full(len(ids) + 1, FREE_CUT, np.float64)
        price[1:][self.stops[ids]] = SENTENCE_CUT
        price[ends] = DOCUMENT_CUT
        price[0] = 0
        allowed = price < FREE_CUT
        allowed[-1] = True
        if last:
            # Powers of two add up to whatever is left, so the last sequences need no padding.
            allowed[max(0, len(ids) - window) :] = True
        at = np.flatnonzero(allowed)
        wide = np.flatnonzero(np.diff(at) > window // 8)
        if len(wide):  # where no sentence ends for long, cuts may be inside
            extra = np.concatenate([np.arange(at[i] + FREE_STEP, at[i + 1], FREE_STEP) for i in wide])
            at = np.union1d(at, extra)
        found = cuts(at, price[at], window, last)
        bounds = np.union1d(np.array([0, *found]), ends[ends < found[-1]]) if found else np.array([0])
        edges = np.array([0, *found])
        starts = np.concatenate(([0], ends[:-1]))
        owner = np.searchsorted(ends, bounds[:-1], "right")
        seq = np.searchsorted(edges, bounds[:-1], "right") - 1
        for a, b, d, s in zip(bounds[:-1].tolist(), bounds[1:].tolist(), owner.tolist(), seq.tolist(), strict=True):
            doc, out = self.docs[d]
            yield doc, a - int(starts[d]) + out, self.sequence + s, a - int(edges[s]), ids[a:b]
        self.sequence += len(found)
        done = int(edges[-1])
        first = int(np.searchsorted(ends, done, "right"))
        rest = []
        for d in range(first, len(self.parts)):
            cut = max(0, done - int(starts[d]))
            rest.append((self.parts[d][cut:], (self.docs[d][0], self.docs[d][1] + cut)))
        self.parts, self.docs = [r[0] for r in rest], [r[1] for r in rest]
        self.held = sum(map(len, self.parts))


def sentence_stops(path: str, size: int) -> np.ndarray:
    """For each id whether a sentence ends after it: its text ends in . ! or ?."""
    from tokenizers import Tokenizer

    out = np.zeros(size, bool)
    for word, i in Tokenizer.from_file(path).get_vocab().items():
        out[i] = word.removesuffix("</w>")[-1:] in (".", "!", "?") and len(word) > 4
    return out


def pack(docs: DataFrame, conf: Config = Config()) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids.

    Documents keep the order of their ids; each range of ids is packed by itself, without padding at its end.
    Each id lies in one piece. A null or empty text is the end id alone; equal ids are packed each, in order
    of text; null ids come first. An empty table gives no rows. sequence_id counts within a range of ids.
    """
    path = conf.tokenizer or tokens.default_path()
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text())
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = table.repartitionByRange(parts, F.col("doc_id").asc_nulls_first()).sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "text")
    return pack_partitions(ranged, conf, path)


def pack_partitions(ranged: DataFrame, conf: Config, path: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        base = TaskContext.get().partitionId() << 36
        words = tokens.tokenizer(path)
        stops = np.isin(np.arange(1 << 20), conf.stops) if conf.stops else sentence_stops(path, 1 << 20)
        packer, rows = Packer(conf, stops), []
        end = np.array([conf.end], "<i4").tobytes()

        def out(pieces: Iterator[tuple]) -> None:
            for (doc, total), start, seq, offset, ids in pieces:
                rows.append((doc, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, base + seq, offset, ids))

        for batch in batches:
            for part in common.slices(batch, 1 << 22):
                for doc, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist(), strict=True):
                    ids = np.frombuffer(words.ids(text) + end, "<i4")
                    out(packer.add((doc, len(ids)), ids))
                if rows:
                    yield _batch(rows)
                    rows.clear()
        out(packer.flush(True))
        if rows:
            yield _batch(rows)

    return ranged.mapInArrow(run, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids array<int>")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    columns = [pa.array([r[i] for r in rows], pa.int64()) for i in range(7)]
    sizes = np.concatenate(([0], np.cumsum([len(r[7]) for r in rows]))).astype(np.int32)
    columns.append(pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.concatenate([r[7] for r in rows]).astype(np.int32))))
    return pa.RecordBatch.from_arrays(columns, names=[*names, "ids"])


