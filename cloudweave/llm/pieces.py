"""SentencePiece encoding and decoding by suffix-array matching.

A batch's distinct units (a run of spaces and the letters after it, or the marks, digits and so on: cut wherever
no piece holds the two neighbouring characters) are put end to end and indexed by a suffix array. Every piece of the vocabulary is looked up
there by binary search; its range of the array is its occurrences, the edges of the units' lattices. Sorted
by position they are relaxed. The vocabulary file is of the BPE kind, whose segmentation is by the order of
merges and not by the sum of scores; so an edge is relaxed when it joins two neighbouring segments and no
edge of a better rank can (a Viterbi pass over the same edges would give other ids).
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.llm import common

SPACE = "▁"
#: Distinct units that a worker remembers; characters that one suffix array covers.
UNITS, INDEX_CHARS = 250_000, 1 << 18
#: An edge's key is its start times SLOT (more than the longest piece) and its length; units above LONG use a heap.
SLOT, NONE, LONG = 1 << 10, 1 << 60, 96


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Pieces:
    def __init__(self, path: str):
        import sentencepiece

        # The file is read for its pieces and their scores alone.
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.texts = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        special = [model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i) for i in range(len(self.texts))]
        self.bytes = {int(t[3:5], 16): i for i, t in enumerate(self.texts) if model.is_byte(i)}
        self.of_byte = {i: b for b, i in self.bytes.items()}
        self.special = {i for i, s in enumerate(special) if s and i not in self.of_byte}
        self.unknown = model.unk_id()
        usable = [i for i, s in enumerate(special) if not s]
        self.longer = sorted((i for i in usable if len(self.texts[i]) > 1), key=lambda i: self.texts[i])
        self.inner = {c for i in self.longer for c in self.texts[i]}
        self.pattern = self._units_pattern()
        self.raw = [bytes([self.of_byte[i]]) if i in self.of_byte else b"" if i in self.special else t.encode() for i, t in enumerate(self.texts)]
        self.raw[self.unknown] = " ⁇ ".encode()
        self.width = max((len(self.texts[i]) for i in self.longer), default=1)
        #: Characters by number, from 2 on in order: 0 ends a piece, 1 is any character of no longer piece.
        self.code = {c: n for n, c in enumerate(sorted(self.inner), 2)}
        keys = np.zeros((len(self.longer), self.width), ">u2")
        tops = np.full((len(self.longer), self.width), 0xFFFF, ">u2")
        for row, i in enumerate(self.longer):
            keys[row, : len(self.texts[i])] = tops[row, : len(self.texts[i])] = [self.code[c] for c in self.texts[i]]
        self.keys, self.tops = (k.view(f"S{2 * self.width}").ravel() for k in (keys, tops))
        self.sizes = np.array([len(self.texts[i]) for i in self.longer], np.int64)
        scores = np.array([model.get_score(i) for i in self.longer])
        self.rank = np.unique(-scores, return_inverse=True)[1]  # equal scores share a rank
        self.bytes_of = {self.texts[i]: np.array([i], "<i4").tobytes() for i in usable}
        self.known: dict[str, bytes] = {}

    def _units_pattern(self) -> re.Pattern:
        """Marks of spaces with a run of characters that pieces join, directly or through others; else one character.

        No piece has a mark inside, so marks only begin units; a merge never crosses the end of one.
        """
        group = {c: c for c in self.inner}

        def find(c: str) -> str:
            while group[c] != c:
                group[c] = c = group[group[c]]
            return c

        for i in self.longer:
            for a, b in zip(self.texts[i], self.texts[i][1:], strict=False):
                if SPACE not in (a, b):
                    group[find(a)] = find(b)
        runs: dict[str, list[str]] = {}
        for c in self.inner - {SPACE}:
            runs.setdefault(find(c), []).append(c)
        classes = ["[" + "".join(map(re.escape, sorted(r))) + "]+" for r in sorted(runs.values(), key=len, reverse=True)]
        return re.compile("|".join(f"{SPACE}*{c}" for c in classes) + f"|{SPACE}+|.", re.S)

    def edges(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Keys (start * SLOT + length, ascending) and ranks of all occurrences of pieces in text."""
        table = np.ones(0x110000 if max(text) > "\uffff" else 0x10000, ">u2")
        table[[ord(c) for c in self.code]] = list(self.code.values())
        codes = np.ones(len(text) + self.width, ">u2")
        codes[: len(text)] = table[np.frombuffer(text.encode("utf-32-le"), "<u4")]
        view = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(codes, self.width)[: len(text)])
        suffixes = view.view(f"S{2 * self.width}").ravel()
        order = np.argsort(suffixes)
        array = suffixes[order]
        low, high = np.searchsorted(array, self.keys), np.searchsorted(array, self.tops, "right")
        hit = np.flatnonzero(high > low)
        count = (high - low)[hit]
        at = order[np.repeat(low[hit] - np.concatenate(([0], np.cumsum(count)[:-1])), count) + np.arange(int(count.sum()))]
        keys = at * SLOT + np.repeat(self.sizes[hit], count)
        by = np.argsort(keys)
        return keys[by], np.repeat(self.rank[hit], count)[by]

    def relax(self, keys: np.ndarray, ranks: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Segments (unit, start, length) of all units, by unit and start.

        A round relaxes one edge of every unit that has one left: that of the best rank, the leftmost on ties,
        among the edges that join two neighbouring segments. Units without one are done and leave.
        """

        def rank(start: np.ndarray, size: np.ndarray) -> np.ndarray:
            want = start * SLOT + np.minimum(size, SLOT - 1)
            i = np.minimum(np.searchsorted(keys, want), max(0, len(keys) - 1))
            return np.where(keys[i] == want, ranks[i], NONE) if len(keys) else np.full(len(want), NONE)

        unit = np.repeat(np.arange(len(sizes)), sizes)
        start = np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes) + np.repeat(starts, sizes)
        size = np.ones(len(start), np.int64)
        last = np.append(unit[1:] != unit[:-1], True) if len(unit) else np.zeros(0, bool)
        join = np.where(last, NONE, rank(start, np.full(len(start), 2)))
        done = []
        while len(unit):
            first = np.flatnonzero(np.append(True, unit[1:] != unit[:-1]))
            least = np.minimum.reduceat(join, first)
            length = np.diff(np.append(first, len(unit)))
            over = np.repeat(least == NONE, length)
            if over.any():
                done.append((unit[over], start[over], size[over]))
                live = ~over
                unit, start, size, join = unit[live], start[live], size[live], join[live]
                least, length = least[least < NONE], length[least < NONE]
                if not len(unit):
                    break
            hit = np.flatnonzero(join == np.repeat(least, length))
            i = hit[np.append(True, unit[hit[1:]] != unit[hit[:-1]])]
            size[i] += size[i + 1]
            keep = np.ones(len(unit), bool)
            keep[i + 1] = False
            unit, start, size, join = unit[keep], start[keep], size[keep], join[keep]
            i = i - np.arange(len(i))
            for k in (i[np.append(unit[1:] == unit[:-1], False)[i]], i[np.append(False, unit[1:] == unit[:-1])[i]] - 1):
                join[k] = rank(start[k], size[k] + size[k + 1])
            join[i[~np.append(unit[1:] == unit[:-1], False)[i]]] = NONE
        if not done:
            return (np.zeros(0, np.int64),) * 3
        unit, start, size = (np.concatenate(x) for x in zip(*done, strict=True))
        by = np.lexsort((start, unit))
        return unit[by], start[by], size[by]

    def relax_long(self, n: int, edges: dict[int, int]) -> list[int]:
        """The same for one long unit, its edges in a heap: where its segments begin, and n."""
        ends, begin, alive = list(range(1, n + 1)), list(range(n)), [True] * n
        heap = [(r, key // SLOT, key // SLOT + 2) for key, r in edges.items() if key % SLOT == 2]
        heapq.heapify(heap)
        while heap:
            _, a, b = heapq.heappop(heap)
            if not alive[a] or (m := ends[a]) >= b or not alive[m] or ends[m] != b:
                continue
            alive[m] = False
            ends[a], begin[b - 1] = b, a
            for x, y in (((a, ends[b]),) if b < n else ()) + (((begin[a - 1], b),) if a else ()):
                if y - x < SLOT and (r := edges.get(x * SLOT + y - x)) is not None:
                    heapq.heappush(heap, (r, x, y))
        return [*(a for a in range(n) if alive[a]), n]

    def letter(self, c: str) -> bytes:
        """The ids of a character that is no piece: those of its bytes, or the unknown one."""
        got = [self.bytes.get(b) for b in c.encode()]
        self.bytes_of[c] = out = np.array([self.unknown] if None in got else got, "<i4").tobytes()
        return out

    def learn(self, units: list[str]) -> None:
        if len(self.known) + len(units) > UNITS:
            self.known.clear()
        start, held = 0, 0
        for i in range(len(units) + 1):
            if start < i and (i == len(units) or held > INDEX_CHARS):
                self._learn(units[start:i])
                start, held = i, 0
            if i < len(units):
                held += len(units[i])

    def _learn(self, units: list[str]) -> None:
        text = "\0".join(units) + "\0"
        keys, ranks = self.edges(text)
        sizes = np.array([len(u) for u in units], np.int64)
        starts = np.concatenate(([0], np.cumsum(sizes + 1)[:-1]))
        short = sizes <= LONG
        of, at, size = self.relax(keys, ranks, starts[short], sizes[short])
        names = [text[a : a + n] for a, n in zip(at.tolist(), size.tolist(), strict=True)]
        self._keep([u for u, s in zip(units, short.tolist(), strict=True) if s], of, names)
        for k in np.flatnonzero(~short).tolist():
            i, j = np.searchsorted(keys, [starts[k] * SLOT, (starts[k] + sizes[k]) * SLOT])
            cut = self.relax_long(int(sizes[k]), dict(zip((keys[i:j] - starts[k] * SLOT).tolist(), ranks[i:j].tolist(), strict=True)))
            self._keep([units[k]], np.zeros(len(cut) - 1, np.int64), [units[k][a:b] for a, b in zip(cut, cut[1:], strict=False)])

    def _keep(self, units: list[str], of: np.ndarray, names: list[str]) -> None:
        """Remember the ids of units; names are their segments in order, of the unit that each is in."""
        parts = [self.bytes_of[n] if n in self.bytes_of else self.letter(n) for n in names]
        bounds = np.searchsorted(of, np.arange(len(units) + 1)).tolist()
        for u, i, j in zip(units, bounds, bounds[1:], strict=False):
            self.known[u] = b"".join(parts[i:j])

    def units(self, text: str) -> list[str]:
        """text with its spaces marked, cut where no piece crosses."""
        return self.pattern.findall(SPACE + text.replace(" ", SPACE)) if text else []

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit bytes."""
        units = [self.units(t) for t in texts]
        new = {u for row in units for u in row} - self.known.keys()
        if new:
            if len(self.known) + len(new) > UNITS:
                new = {u for row in units for u in row}
            self.learn(sorted(new))
        known = self.known
        return [b"".join([known[u] for u in row]) for row in units]

    def decode(self, ids: list[int]) -> str:
        """The text: pieces put together, marks as spaces again, the first space dropped, bytes as UTF-8."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text.removeprefix(SPACE).replace(SPACE, " ")


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def rows_of(column: pa.ListArray) -> Iterator[np.ndarray]:
    """The ids of each row, as views of the column's values; null rows have none."""
    flat, offsets = column.values.to_numpy().astype("<i4", copy=False), column.offsets.to_pylist()
    for i, j, null in zip(offsets, offsets[1:], column.is_null().to_pylist(), strict=False):
        yield flat[i : i if null else j]


def encode(docs: DataFrame, path: str = "") -> DataFrame:
    """doc_id, ids of each whole text. Null and empty texts have no ids; repeated rows have their own; a null id stays null."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part in common.slices(batch, 1 << 21):
                rows = model.encode(part.column("text").to_pylist())
                sizes = np.concatenate(([0], np.cumsum([len(r) // 4 for r in rows]))).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(sizes), pa.array(np.frombuffer(b"".join(rows), "<i4")))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text()).mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str = "") -> DataFrame:
    """doc_id, text of each row of ids; null ids give an empty text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = [model.decode(ids.tolist()) for ids in rows_of(batch.column("ids"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, path: str = "") -> DataFrame:
    """doc_id, n_pieces, ids_crc32, decoded_sha256: whole texts encoded, and decoded from their ids again.

    Null and empty texts have no pieces and decode to the empty text. Every row has its own, also where ids repeat or are null, and
    texts of any length are whole. An empty table gives no rows. Other columns play no part.
    """
    import hashlib

    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for b in batches:
            ids = list(rows_of(b.column("ids")))
            yield pa.RecordBatch.from_pydict({
                "doc_id": b.column("doc_id"), "n_pieces": pa.array([len(i) for i in ids], pa.int64()),
                "ids_crc32": pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                "decoded_sha256": [hashlib.sha256(model.decode(i.tolist()).encode()).hexdigest() for i in ids],
            })

    return encode(docs, path).mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, decoded_sha256 string")
