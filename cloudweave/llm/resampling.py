"""Importance resampling towards a target distribution of hashed word n-grams.

A document's weight is the sum of its features' gains, log ratios of how often a feature's bucket occurs in the
target and in the corpus. Weights are taken from arrays: a task hashes all n-grams of a batch at once, a CRC of
a longer n-gram being that of its first words, shifted, and that of its last. Gumbel noise turns the highest
scores into a draw without replacement in proportion to the weights.

The draw's ranks come from parallel sorting by regular sampling: every partition is a sorted run, of which rows at
regular distances are samples; samples give splitters; counts of the ranges between splitters, added up, tell
which ranges the draw reaches and at what rank each begins. Only those ranges are exchanged and merged.
"""

from __future__ import annotations

import math
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.llm import common

#: Buckets of features; words of the longest one; per cent of the documents drawn; words that a drawn one has at least.
BUCKETS, RUN, PER_CENT, LEAST_WORDS, SEED = 10_000, 3, 5, 20, 42
#: Ranges that ranks are told in, and samples that reach the driver, at most.
RANGES, SAMPLES = 1024, 1 << 20

#: What stands between words, after A-Z are lower-cased: ``[\x00-\x2F\x3A-\x60\x7B-\x7F]``.
_SPACE = np.zeros(256, bool)
_SPACE[[*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]] = True

#: Lengths up to which a CRC is shifted in one step.
_SHORT = 64


def byte_crcs() -> np.ndarray:
    """What a step of CRC-32 adds for each byte."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0xEDB88320), one >> 1)
    return one


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """byte_crcs; for lengths below _SHORT, and for _SHORT << i, what each byte of a CRC becomes behind so many zero bytes."""
    one = byte_crcs()
    near = np.empty((_SHORT + 1, 4, 256), np.uint32)
    near[0] = np.arange(256, dtype=np.uint32) << (8 * np.arange(4, dtype=np.uint32))[:, None]
    for k in range(_SHORT):
        near[k + 1] = one[near[k] & 255] ^ (near[k] >> 8)
    far = [near[_SHORT]]
    while len(far) < 32:
        far.append(_apply(far[-1], far[-1]))
    return one, near[:_SHORT].reshape(-1), np.array(far)


def _apply(table: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return table[0][crc & 255] ^ table[1][crc >> 8 & 255] ^ table[2][crc >> 16 & 255] ^ table[3][crc >> 24]


_ONE, _NEAR, _FAR = _tables()


def shifted(crc: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """What a text's CRC adds to that of the text with lengths more bytes behind it."""
    at = (lengths & (_SHORT - 1)) * 1024
    out = _NEAR[at + (crc & 255)] ^ _NEAR[at + 256 + (crc >> 8 & 255)] ^ _NEAR[at + 512 + (crc >> 16 & 255)] ^ _NEAR[at + 768 + (crc >> 24)]
    rest = lengths // _SHORT
    for i in range(int(rest.max(initial=0)).bit_length()):
        live = np.flatnonzero(rest >> i & 1)
        out[live] = _apply(_FAR[i], out[live])
    return out


def word_crcs(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    live = np.flatnonzero(lengths <= _SHORT)
    step = 0
    while len(live):
        live = live[lengths[live] > step]
        c = out[live]
        out[live] = _ONE[(c ^ buf[starts[live] + step]) & 255] ^ (c >> 8)
        step += 1
    out = ~out
    for i in np.flatnonzero(lengths > _SHORT):
        out[i] = zlib.crc32(buf[starts[i] : starts[i] + lengths[i]])
    return out


def feature_buckets(column: pa.Array, buckets: int = BUCKETS) -> tuple[list[np.ndarray], np.ndarray]:
    """For runs of 1, 2 ... RUN words: the bucket of the run that begins at each word (-1 where the row ends first); and each row's first word (n + 1)."""
    buf, offsets = common.text_bytes(column)
    buf = common.lower_ascii(buf)
    starts, lengths, firsts = common.word_spans(buf, offsets, _SPACE)
    own = word_crcs(buf, starts, lengths)
    spaced = shifted(np.full(len(own), zlib.crc32(b" "), np.uint32), lengths) ^ own
    left = np.repeat(firsts[1:], np.diff(firsts)) - np.arange(len(own))
    out, crc = [(own % np.uint32(buckets)).astype(np.int64)], own
    for k in range(1, RUN):
        crc = shifted(crc[:-1], lengths[k:] + 1) ^ spaced[k:]
        at = np.full(len(own), -1, np.int64)
        at[: len(crc)] = crc % np.uint32(buckets)
        at[left <= k] = -1
        out.append(at)
    return out, firsts


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """How many features of all texts fall in each bucket. A task sends at most a row for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in common.slices(batch):
                for at in feature_buckets(part.column("text"), buckets)[0]:
                    total += np.bincount(at + 1, minlength=buckets + 1)[1:]
        full = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), pa.array(total[full])], names=["bucket", "c"])

    out = np.zeros(buckets, np.int64)
    for bucket, c in texts.mapInArrow(run, "bucket int, c long").groupBy("bucket").agg(F.sum("c")).collect():
        out[bucket] = c
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the smoothed ratio of a bucket's share in the target and in the corpus)."""
    n = len(corpus)
    S, T = float(corpus.sum() + n), float(target.sum() + n)
    return np.array([math.floor(1000 * math.log(((t + 1) * S) / ((s + 1) * T))) for s, t in zip(corpus.astype(float).tolist(), target.astype(float).tolist(), strict=True)], np.int64)


def weights(texts: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight) of (doc_id, text). gain is an array of fixed length and goes with the tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        padded = np.append(gain, 0)  # -1 finds the last
        for batch in batches:
            for part in common.slices(batch):
                found, firsts = feature_buckets(part.column("text"), len(gain))
                total = np.concatenate(([0], np.cumsum(sum(padded[at] for at in found))))
                words = np.diff(firsts)
                n = sum(np.maximum(words - k, 0) for k in range(RUN))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(words), pa.array(n), pa.array(total[firsts[1:]] - total[firsts[:-1]])], names=["doc_id", "n_words", "n_features", "weight"])

    return texts.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def _columns(batch: pa.RecordBatch, names: list[str]) -> list[np.ndarray]:
    return [batch.column(n).to_numpy() for n in names]


def _range_of(keys: list[np.ndarray], splitters: list[tuple]) -> np.ndarray:
    """How many splitters stand before or at each key."""
    heads = np.array([s[0] for s in splitters], np.int64)
    out, end = np.searchsorted(heads, keys[0], "left"), np.searchsorted(heads, keys[0], "right")
    for i in np.flatnonzero(out < end):  # ties with a splitter's first column
        out[i] = bisect_right(splitters, tuple(int(k[i]) for k in keys))
    return out


def first_ranks(rows: DataFrame, order: list[str], limit: int, ranges: int | None = None, samples: int = SAMPLES) -> DataFrame:
    """rows with rank: 1, 2, 3 ... up to limit by ascending order, null beyond.

    rows is a written table and order names columns of longs that tell all rows apart, so that a group of rows
    with equal leading columns is split too.
    """
    spark = rows.sparkSession
    total = rows.count()
    ranges = max(1, min(RANGES, ranges or int(spark.conf.get("spark.sql.shuffle.partitions"))))
    runs = max(1, rows.rdd.getNumPartitions())
    stride = max(1, -(-total // (runs * max(1, min(ranges, samples // runs)))))

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        skip = stride // 2
        for batch in batches:
            yield batch.take(pa.array(np.arange(skip, batch.num_rows, stride)))
            skip = (skip - batch.num_rows) % stride if batch.num_rows > skip else skip - batch.num_rows

    keys = rows.select(*order)
    found = keys.sortWithinPartitions(*order).mapInArrow(sample, keys.schema).toPandas().sort_values(order).itertuples(index=False, name=None)
    found = list(found)
    splitters = sorted({found[len(found) * i // ranges] for i in range(1, ranges)}) if found else []

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = _range_of(_columns(batch, order), splitters)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at.astype(np.int32))], names=[*batch.schema.names, "range"])

    dealt = rows.mapInArrow(deal, rows.select("*", F.lit(0).alias("range")).schema)
    counts = np.zeros(len(splitters) + 1, np.int64)
    for k, c in dealt.groupBy("range").count().collect():
        counts[k] = c
    before = np.concatenate(([0], np.cumsum(counts)[:-1]))
    reached = int((before < limit).sum()) if limit > 0 else 0

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, done = -1, 0
        for batch in batches:
            at = batch.column("range").to_numpy()
            first = np.searchsorted(at, at)  # batches come sorted by range
            place = np.arange(len(at)) - first + np.where(at == last, done, 0)
            rank = before[at] + place + 1
            last, done = (int(at[-1]), int(place[-1]) + 1) if len(at) else (last, done)
            kept = batch.drop_columns(["range"])
            yield pa.RecordBatch.from_arrays([*kept.columns, pa.array(rank, mask=rank > limit)], names=[*kept.schema.names, "rank"])

    shape = rows.select("*", F.lit(None).cast("long").alias("rank")).schema
    drawn = dealt.where(F.col("range") < reached).repartition(max(1, reached), "range").sortWithinPartitions("range", *order).mapInArrow(merge, shape)
    return drawn.union(dealt.where(F.col("range") >= reached).drop("range").withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, per_cent: int = PER_CENT, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row; rank is null for those not drawn.

    docs has doc_id and text, target has text. Null texts have no words, no features and weight 0. A row with a
    null doc_id counts in the corpus, but has no score and is neither drawn nor one of the documents of which a
    share is drawn. Rows of one doc_id are documents of their own; of equal scores they are drawn by ascending
    n_features. An empty table gives no rows, an empty target makes all targets' counts 0. Other columns play no part.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text())
    gain = gains(bucket_counts(texts), bucket_counts(target.select(common.whole_text())))
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.col("doc_id").cast("string")), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))
    scored = weights(texts, gain).withColumn("score", F.col("weight") + noise)
    scored = common.materialize(scored.select("*", (-F.col("score")).alias("down"), F.monotonically_increasing_id().alias("tie")))
    fit = (F.col("n_words") >= least_words) & F.col("doc_id").isNotNull()
    drawn = first_ranks(scored.where(fit), ["down", "doc_id", "n_features", "tie"], per_cent * scored.where(fit).count() // 100)
    rest = scored.where(~fit).withColumn("rank", F.lit(None).cast("long"))
    return drawn.union(rest).select("doc_id", "n_features", "weight", "score", "rank")
