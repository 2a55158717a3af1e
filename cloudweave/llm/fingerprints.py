"""Document fingerprints: a homomorphic multiset hash over paragraphs.

A paragraph (a line that is not empty) hashes to a wide vector of 32-bit lanes; a document's fingerprint is
the sum of its paragraphs' vectors, lane by lane, modulo 2**32. So the order of paragraphs does not matter, and
``add`` and ``remove`` change a fingerprint by a paragraph without the rest of the text. The first EXACT lanes
are a full-width hash of the paragraph, for equality; the other LIKE lanes add a sign for each of its word
triples (a count sketch), so that the distance of two sums tells how much of two texts is unlike.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from cloudweave.llm import common

EXACT, LIKE, WORDS = 64, 256, 3


def vectors(texts: list[str]) -> np.ndarray:
    """A fingerprint (EXACT + LIKE lanes of unsigned 32 bits) for each text."""
    column = pa.array([t.encode("utf-8", "surrogatepass") for t in texts], pa.large_binary())
    buf, offsets = common.text_bytes(column)
    n = int(offsets[-1])
    # Lines, cut at the texts' borders too.
    breaks = np.flatnonzero(buf[:n] == 10)
    starts = np.unique(np.concatenate([offsets[:-1][offsets[:-1] < n], breaks[breaks + 1 < n] + 1]))
    stops = np.concatenate([starts[1:], [n]])[: len(starts)]
    stops = stops - ((buf[stops - 1] == 10) & (stops > starts)) if len(starts) else stops
    full = stops > starts
    starts, stops = starts[full], stops[full]
    owner = np.searchsorted(offsets, starts, "right") - 1
    out = np.zeros((len(texts), EXACT + LIKE), np.uint32)
    raw = buf.tobytes()
    if len(starts):
        lanes = np.frombuffer(b"".join(hashlib.shake_128(raw[a:b]).digest(4 * EXACT) for a, b in zip(starts.tolist(), stops.tolist(), strict=True)), "<u4").reshape(-1, EXACT)
        first = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        out[owner[first], :EXACT] = np.add.reduceat(lanes, first, axis=0, dtype=np.uint32)
    # Word triples within a paragraph; a shorter one is a triple of its own.
    w_at, w_len, _ = common.word_spans(buf, offsets)
    h = common.span_hashes(buf, w_at, w_len)
    firsts = np.searchsorted(w_at, np.append(starts, n))
    triples, rows = common.shingle_hashes(h, firsts, WORDS)
    doc = np.repeat(owner, np.diff(rows))
    lane = (triples >> np.uint64(40)) % np.uint64(LIKE)
    sign = np.where(triples & np.uint64(1), 1.0, -1.0)
    sums = np.bincount(doc * LIKE + lane.astype(np.int64), weights=sign, minlength=len(texts) * LIKE)
    out[:, EXACT:] = sums.astype(np.int64).reshape(len(texts), LIKE).astype(np.uint32)
    return out


def add(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a + b).astype(np.uint32)


def remove(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a - b).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """From 0 to 1 for each pair of rows: 1 for equal fingerprints, else the cosine of the sketches, 0 at least."""
    x, y = (v[:, EXACT:].astype(np.int32).astype(np.float64) for v in (a, b))
    norm = np.sqrt((x * x).sum(1) * (y * y).sum(1))
    cosine = np.divide((x * y).sum(1), norm, out=np.zeros(len(x)), where=norm > 0)
    return np.where((a == b).all(1), 1.0, np.clip(cosine, 0.0, 1.0 - 1e-9))


def edited(text: str, following: str) -> str:
    """The last quarter of text (code points, rounded down) replaced by the first as many of following."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def _successors(docs: DataFrame) -> DataFrame:
    """(bucket, ahead, doc_id, text): ranges of ids; the rows that begin the next bucket come again, as ahead.

    The cuts are ids of the table (quantiles), so each bucket begins at a known id, and which rows must be
    seen from the bucket before is known from the id alone: no row count, no window over the whole table.
    """
    spark = docs.sparkSession
    n = max(1, 4 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    least, cuts = docs.agg(F.min("doc_id"), F.expr(f"approx_percentile(doc_id, array({','.join(f'{i}/{n}D' for i in range(1, n))}), 10000)" if n > 1 else "array()")).head()
    starts = sorted({least, *(cuts or ())} - {None})
    if docs.where("doc_id is null").limit(1).count():
        starts = [None, *starts]  # nulls come first
    keys = np.array([np.iinfo(np.int64).min if s is None else s for s in starts], np.int64)
    shape = StructType([StructField(n, t) for n, t in (("bucket", docs.schema["doc_id"].dataType), ("ahead", docs.schema["doc_id"].dataType), ("doc_id", docs.schema["doc_id"].dataType), ("text", StringType()))])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("doc_id").fill_null(int(np.iinfo(np.int64).min)).to_numpy()
            bucket = np.searchsorted(keys, ids, "right") - 1
            begins = np.flatnonzero(ids == keys[bucket]) if len(ids) else np.zeros(0, np.int64)
            for rows, at, flag in ((batch, bucket, 0), (batch.take(pa.array(begins)), (bucket[begins] - 1) % max(1, len(keys)), 1)):
                if rows.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int64)), pa.array(np.full(rows.num_rows, flag, np.int64)), rows.column("doc_id"), rows.column("text")], names=["bucket", "ahead", "doc_id", "text"])

    return docs.mapInArrow(deal, shape)


def fingerprint(docs: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, and how like they are.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next.
    The next document is that of the next doc_id, after the last the first; equal ids are taken in order of
    text, null ids before all others. A null text is empty. A table of one row has itself as its next; an
    empty table gives no rows. Other columns play no part.
    """
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text())
    ranged = _successors(table).repartition("bucket").sortWithinPartitions("bucket", "ahead", F.col("doc_id").asc_nulls_first(), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None  # bucket, id, text, fingerprint of the row that waits for its next
        done: int | None = None  # the bucket whose last row has met its next
        for batch in batches:
            for part in common.slices(batch):
                buckets, ahead = part.column("bucket").to_pylist(), part.column("ahead").to_pylist()
                ids, texts = part.column("doc_id").to_pylist(), part.column("text").to_pylist()
                prints = vectors(texts)
                before, after = [], []
                for i, b in enumerate(buckets):
                    if b == done:
                        continue
                    if held and held[0] == b:
                        before.append(held)
                        after.append((texts[i], prints[i]))
                    held = None if ahead[i] else (b, ids[i], texts[i], prints[i])
                    done = b if ahead[i] else done
                if before:
                    yield _rows(before, after)

    return ranged.mapInArrow(run, "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def _rows(before: list[tuple], after: list[tuple]) -> pa.RecordBatch:
    new = [edited(x[2], y[0]) for x, y in zip(before, after, strict=True)]
    own, its, following = np.array([x[3] for x in before]), vectors(new), np.array([y[1] for y in after])
    return pa.RecordBatch.from_pydict({
        "doc_id": pa.array([x[1] for x in before], pa.int64()), "n_chars": pa.array([len(x[2]) for x in before], pa.int64()),
        "edited_sha256": [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in new],
        "fingerprint": [v.astype("<u4").tobytes().hex() for v in own], "edited_fingerprint": [v.astype("<u4").tobytes().hex() for v in its],
        "near_edited": likeness(own, its), "near_next": likeness(own, following),
    })
