"""Quality classifier: hashed word n-gram logistic regression, trained by follow-the-regularised-leader."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.llm import common

#: Byte classes of the tokens: white space 0, letters 1, digits 2, marks 3.
_CLASS = np.full(256, 3, np.uint8)
_CLASS[common._SPACE] = 0
_CLASS[48:58] = 2
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_REPEAT = np.uint64(0x52455045)


@dataclass(frozen=True)
class Config:
    """bits: 2**bits weights. sample: most labelled rows that train (those of least md5). steps: FTRL updates, over and over the sample."""

    bits: int = 18
    ngrams: int = 2
    sample: int = 8000
    steps: int = 24_000
    alpha: float = 1.0
    beta: float = 1.0
    l1: float = 0.05
    l2: float = 0.01
    threshold: float = 0.3


def features(column: pa.Array, conf: Config) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each text its weights' numbers and values: n-gram counts over the root of their squares' sum.

    Tokens are runs of letters (ASCII folded), digits or marks; a token like the one before counts as a
    repeat, whatever it is. The empty text has no features, so its score is that of the bias.
    """
    buf, offsets = common.text_bytes(column)
    n = int(offsets[-1])
    kind = _CLASS[buf[:n]]
    edge = np.ones(n, bool)
    edge[1:] = kind[1:] != kind[:-1]
    cuts = offsets[1:-1]
    edge[cuts[cuts < n]] = True
    starts = np.flatnonzero(edge)
    lengths = np.diff(np.append(starts, n))
    word = kind[starts] > 0
    starts, lengths = starts[word], lengths[word]
    h = common.span_hashes(common.lower_ascii(buf), starts, lengths)
    firsts = np.searchsorted(starts, offsets)
    mask = np.uint64((1 << conf.bits) - 1)
    out = []
    for a, b in zip(firsts[:-1], firsts[1:], strict=True):
        t = h[a:b]
        grams, acc = [common.mix(t)], t
        for k in range(1, min(conf.ngrams, len(t))):
            acc = common.mix(acc[:-1] * common._GOLD + t[k:])
            grams.append(np.where(t[k:] == t[k - 1 : -1], common.mix(_REPEAT + np.uint64(k) * np.ones(1, np.uint64)), acc))
        idx, count = np.unique(np.concatenate(grams) & mask, return_counts=True)
        value = count / np.sqrt(max(1.0, float((count * count).sum())))
        out.append((idx.astype(np.int64), value))
    return out


def train(rows: DataFrame, conf: Config) -> tuple[float, np.ndarray]:
    """Bias and weights from (key, text, label) rows, at most conf.sample of them, in order of key.

    One task reads the bounded sample, since each FTRL step starts from the last; no rows give zeros.
    """

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << conf.bits
        z, sq = np.zeros(size + 1), np.zeros(size + 1)
        seen: list[tuple[np.ndarray, np.ndarray, float]] = []
        for batch in batches:
            for part in common.slices(batch):
                for (idx, value), y in zip(features(part.column("text"), conf), part.column("label").to_pylist(), strict=True):
                    seen.append((np.append(idx, size).astype(np.int32), np.append(value, 1.0).astype(np.float32), float(y)))

        def weights(i: np.ndarray | slice) -> np.ndarray:
            l1 = np.where(np.arange(size + 1)[i] == size, 0.0, conf.l1)
            return np.where(np.abs(z[i]) <= l1, 0.0, -(z[i] - np.sign(z[i]) * l1) / ((conf.beta + np.sqrt(sq[i])) / conf.alpha + conf.l2))

        for _ in range(-(-conf.steps // max(1, len(seen)))):
            for idx, value, y in seen:
                w = weights(idx)
                g = (1 / (1 + np.exp(-np.clip(w @ value, -35, 35))) - y) * value
                z[idx] += g - (np.sqrt(sq[idx] + g * g) - np.sqrt(sq[idx])) / conf.alpha * w
                sq[idx] += g * g
        w = weights(slice(None)).astype(np.float32)
        yield pa.RecordBatch.from_pydict({"weights": pa.array([w.tobytes()], pa.binary())})

    sample = rows.orderBy("key").limit(conf.sample)
    got = sample.repartition(1).sortWithinPartitions("key").mapInArrow(fit, "weights binary").head()
    w = np.frombuffer(got[0], np.float32) if got else np.zeros((1 << conf.bits) + 1, np.float32)
    return float(w[-1]), w[:-1]


def fit(docs: DataFrame, labels: DataFrame, conf: Config = Config()) -> tuple[float, np.ndarray]:
    """Train on the labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    The sample is drawn from the label rows, before any text is read; it is bounded by conf.sample, so it
    is broadcast. Rows without an id or a label train nothing; a doc_id labelled twice counts once for each label.
    """
    key = F.col("doc_id").cast("string")
    chosen = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & (F.crc32(key) % 5 != 0))
        .select("doc_id", F.col("quality").cast("int").alias("label"), F.md5(key).alias("key")).distinct()
        .orderBy("key", "label").limit(conf.sample)
    )
    rows = docs.select("doc_id", common.whole_text()).join(F.broadcast(chosen), "doc_id").select("key", "text", "label")
    return train(rows, conf)


def score(docs: DataFrame, model: tuple[float, np.ndarray], conf: Config = Config(), column: str = "score") -> DataFrame:
    """docs with the probability of label 1 of each whole text in another column."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    out_type = docs.withColumn(column, F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bias, w = shared.value
        for batch in batches:
            found = np.empty(batch.num_rows)
            at = 0
            for part in common.slices(batch):
                for idx, value in features(part.column("text"), conf):
                    found[at] = 1 / (1 + np.exp(-np.clip(bias + w[idx] @ value, -35, 35)))
                    at += 1
            keep = [i for i, f in enumerate(batch.schema.names) if f != column]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(found)], names=[*(batch.schema.names[i] for i in keep), column])

    return docs.mapInArrow(run, out_type)


def classify(docs: DataFrame, labels: DataFrame, conf: Config = Config()) -> DataFrame:
    """doc_id, held_out, score, predicted for each document.

    Null and empty texts get the bias's score; a null doc_id is not held out; repeated rows are scored each.
    An empty table gives no rows; without labels every score is 0.5. Other columns play no part.
    """
    scored = score(docs.select("doc_id", common.whole_text()), fit(docs, labels, conf), conf)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= conf.threshold).cast("int").alias("predicted"))


def good_documents(docs: DataFrame, labels: DataFrame, conf: Config = Config()) -> DataFrame:
    """The documents that the classifier accepts, with all their columns, whatever these are called. Null and empty texts are scored as classify does; an empty table stays empty."""
    name = common.fresh(docs, "_quality")[0]
    texts = docs if "text" in docs.columns else docs.withColumn("text", F.lit(""))
    return score(texts, fit(docs, labels, conf), conf, name).where(F.col(name) >= conf.threshold).select(*docs.columns)
