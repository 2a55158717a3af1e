"""Secret scan: candidates by pattern, false positives removed by a random forest.

The forest sees a candidate's length, its character transitions under the corpus's own, how much of it is made of
the corpus's common words, the document's path (its source) and the neighbouring words: five tests for telling
ones, and all of them hashed into cells. It learns from labelled findings. Where none are given they are planted in the corpus's
own texts (planting.py): secrets and look-alikes of many kinds, whose labels do not follow from the features.
Besides, the corpus's own candidates in plain text that do not look random are taken for false positives. What looks
random there may be either and trains nothing; so does what is assigned to a name.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloudweave.llm import common, planting

#: Labelled findings that train at most (those of least hash); false positives of the corpus among them; trees, depth; cells of the table of words.
SAMPLE, OWN, TREES, DEPTH, CELLS = 20_000, 2_000, 40, 10, 1 << 18
#: Entropy, in bits a character, from which a value looks random; mail and web addresses do not.
RANDOM, ADDRESS = 2.75, r"^[^@]+@[^@]+\.[A-Za-z]+$|^https?://|^www\."

#: A run in plain text: printable ASCII but quotes, brackets, commas, semicolons and bars; LONG ones need no digit.
CANDIDATE, LONG = re.compile(r"[!#-&*+\--:=?@A-Z\\^_a-z~]{8,}"), 16
ENDS = "!#$%&*.:?@\\^~"
DIGIT = re.compile(r"[0-9]")
#: Names that secrets are assigned to; words that mark stand-ins; words of paths of tests.
NAMES = re.compile(r"(?:token|secret|passw(?:or)?d|passwd|api[_-]?key|access[_-]?key|auth|credential|bearer|private[_-]?key)\W{0,4}$", re.I)
STAND_INS = re.compile(r"example|dummy|sample|placeholder|checksum|sha\d*|md5|commit|fingerprint|uuid|digest|licen[cs]e", re.I)
TEST_PATHS = re.compile(r"test|example|sample|mock|fixture|doc", re.I)
#: A name, what assigns, and the value: all between quotes on one line, else all up to white space.
VALUE = re.compile(r"(?:token|secret|passw(?:or)?d|passwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)(?:s|[_-]\w{1,20})?[\"'`\])}]{0,2}[ \t]{0,4}(?::=|=>|[=:]{1,3})\s{0,4}(?:\"([^\"\n]+)\"|'([^'\n]+)'|`([^`\n]+)`|(\S+))|bearer[ \t:=]{1,4}[\"'`]?([^\s\"'`]+)", re.I)
#: A private key in its armour, over several lines.
KEY_BLOCK = re.compile(r"-----BEGIN ([A-Z0-9 ]{0,40})PRIVATE KEY-----[^-]{1,100000}-----END \1PRIVATE KEY-----")
ASSIGNED = re.compile(r"[=:]\s*[\"'`]?$")
WORD = re.compile(r"[A-Za-z]{3,}")

STRING = ("length", "entropy", "digits", "upper", "other", "distinct", "transitions", "covered")
#: Cells that the neighbouring words before and behind a candidate, and the words of its path, are hashed into.
BEFORE, AFTER, PATH = 16, 8, 8
CONTEXT = ("named", "assigned", "quoted", "stand_in", "test_path", *(f"before_{k}" for k in range(BEFORE)), *(f"after_{k}" for k in range(AFTER)), *(f"path_{k}" for k in range(PATH)))
FEATURES = (*STRING, *CONTEXT)


def corpus_statistics(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Log-probabilities of byte transitions (128 x 128), and counts of lower-cased words by cell, over all documents.

    Both tables have a fixed size; tasks' tables are added on the executors. No transition or word spans two texts,
    so the tables do not depend on how the rows are dealt out.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, cells = np.zeros(1 << 14, np.int64), np.zeros(CELLS, np.int64)
        for batch in batches:
            for part in common.slices(batch):
                buf, offsets = common.text_bytes(part.column("text"))
                buf = np.where(buf > 127, 1, buf).astype(np.uint8)
                n = int(offsets[-1])
                begins = np.zeros(n + 1, bool)  # where a text begins, and behind the last
                begins[offsets] = True
                two = (buf[: max(0, n - 1)].astype(np.int32) << 7) | buf[1 : max(1, n)]
                pairs += np.bincount(two[~begins[1:n]], minlength=1 << 14)
                low = common.lower_ascii(buf)
                letter = (low >= 97) & (low <= 122)
                letter[n:] = False
                starts = np.flatnonzero(letter[:n] & (begins[:n] | ~np.append(False, letter[: n - 1])[:n]))
                ends = np.flatnonzero(letter[:n] & (begins[1 : n + 1] | ~letter[1 : n + 1])) + 1
                long = ends - starts >= 3
                h = common.span_hashes(low, starts[long], (ends - starts)[long])
                np.add.at(cells, (h & np.uint64(CELLS - 1)).astype(np.int64), 1)
        yield pa.RecordBatch.from_arrays([pa.array([pairs.tobytes()], pa.binary()), pa.array([cells.tobytes()], pa.binary())], names=["pairs", "cells"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = [np.zeros(1 << 14, np.int64), np.zeros(CELLS, np.int64)]
        for batch in batches:
            for s, c in zip(sums, batch.columns, strict=True):
                for raw in c.to_pylist():
                    s += np.frombuffer(raw, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array([s.tobytes()], pa.binary()) for s in sums], names=["pairs", "cells"])

    shape = "pairs binary, cells binary"
    got = docs.mapInArrow(count, shape).repartition(8).mapInArrow(total, shape).repartition(1).mapInArrow(total, shape).head()
    pairs = np.frombuffer(got[0], np.int64).reshape(128, 128) + 0.5
    return np.log(pairs / pairs.sum(1, keepdims=True)), np.frombuffer(got[1], np.int64)


def word_cells(text: str, cells: int) -> list[float]:
    """1 for each cell that one of the text's words, lower-cased, is hashed into."""
    out = [0.0] * cells
    for w in WORD.findall(text):
        out[zlib.crc32(w.lower().encode()) % cells] = 1.0
    return out


def string_features(value: str, transitions: np.ndarray, common_word) -> list[float]:
    raw = np.frombuffer(value.encode(), np.uint8)
    raw = np.where(raw > 127, 1, raw)
    counts = np.unique(raw, return_counts=True)[1] / len(raw)
    digits = float(((raw >= 48) & (raw <= 57)).mean())
    upper = float(((raw >= 65) & (raw <= 90)).mean())
    lower = float(((raw >= 97) & (raw <= 122)).mean())
    covered = sum(len(w) for w in WORD.findall(value) if common_word(w)) / len(value)
    return [float(len(value)), float(-(counts * np.log2(counts)).sum()), digits, upper, 1 - digits - upper - lower, len(counts) / len(value), float(transitions[raw[:-1], raw[1:]].mean()) if len(raw) > 1 else 0.0, covered]


def spans(text: str) -> Iterator[tuple[int, int, bool]]:
    """Start, end and whether named or a key block, of every candidate of a text; candidates never overlap."""
    at = 0
    for m in KEY_BLOCK.finditer(text):
        yield from _values(text, at, m.start())
        yield m.start(), m.end(), True
        at = m.end()
    yield from _values(text, at, len(text))


def _values(text: str, at: int, stop: int) -> Iterator[tuple[int, int, bool]]:
    for m in VALUE.finditer(text, at, stop):
        start, end = m.span(m.lastindex)
        if m.lastindex >= 4:  # without quotes, what closes a sentence or a bracket is not the value's
            end = start + len(text[start:end].rstrip("\"'`,;)]}>").rstrip(".") or text[start:end])
        yield from _runs(text, at, start)
        yield start, end, True
        at = end
    yield from _runs(text, at, stop)


def _runs(text: str, begin: int, end: int) -> Iterator[tuple[int, int, bool]]:
    for m in CANDIDATE.finditer(text, begin, end):
        if len(m[0]) >= LONG or DIGIT.search(m[0]):
            value = m[0].lstrip(ENDS)
            start = m.end() - len(value)
            value = value.rstrip(ENDS)
            if len(value) >= LONG or (len(value) >= 8 and DIGIT.search(value)):
                yield start, start + len(value), False


def candidates(docs: DataFrame, statistics: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """row_key, doc_id, start (characters), value and FEATURES of every candidate of every whole text.

    A candidate is any value assigned to a name, of any length and alphabet, a private key's block, or a run of
    CANDIDATE that has 16 characters, or 8 and a digit.
    """
    shared = docs.sparkSession.sparkContext.broadcast(statistics)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        transitions, cells = shared.value
        often = max(20.0, float(cells.sum()) / CELLS * 20)
        seen: dict[str, bool] = {}

        def common_word(w: str) -> bool:
            if len(seen) > 100_000:
                seen.clear()
            if w not in seen:
                raw = np.frombuffer(w.lower().encode() + bytes(16), np.uint8)
                h = common.span_hashes(raw.copy(), np.zeros(1, np.int64), np.array([len(w)]))
                seen[w] = bool(cells[int(h[0] & np.uint64(CELLS - 1))] >= often)
            return seen[w]

        for batch in batches:
            rows: dict[str, list] = {n: [] for n in ("row_key", "doc_id", "start", "value", *FEATURES)}
            for key, doc, path, text in zip(*(batch.column(n).to_pylist() for n in ("row_key", "doc_id", "path", "text")), strict=True):
                for start, end, given in spans(text):
                    value, before, after = text[start:end], text[max(0, start - 40) : start], text[end : end + 20]
                    assigned = given or bool(ASSIGNED.search(before))
                    named = given or bool(NAMES.search(before))
                    context = [float(named), float(assigned), float(before[-1:] in "\"'`" and before[-1:] == after[:1] and before != ""), float(bool(STAND_INS.search(before) or STAND_INS.search(after))), float(bool(TEST_PATHS.search(path)))]
                    context += [*word_cells(before, BEFORE), *word_cells(after, AFTER), *word_cells(path, PATH)]
                    got = [key, doc, start, value, *string_features(value, transitions, common_word), *context]
                    for n, v in zip(rows, got, strict=True):
                        rows[n].append(v)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), *[pa.float64()] * len(FEATURES)]
            yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(rows.values(), kinds, strict=True)], names=list(rows))

    shape = "row_key long, doc_id long, start long, value string, " + ", ".join(f"{n} double" for n in FEATURES)
    return docs.mapInArrow(run, shape)


def weak_labels(found: DataFrame) -> DataFrame:
    """False positives of the corpus, one for each distinct value: value, label (0) and FEATURES.

    They stand in plain text. A value of digits and letters at RANDOM bits a character has no label.
    """
    digits = F.col("digits")
    random = (digits > 0) & (digits + F.col("other") < 1) & (F.col("entropy") >= RANDOM) & ~F.col("value").rlike(ADDRESS)
    rows = found.where((F.col("named") == 0) & ~random).groupBy("value").agg(*(F.max(n).alias(n) for n in FEATURES))
    return rows.select("value", F.lit(0.0).alias("label"), *FEATURES)


def planted_findings(table: DataFrame, statistics: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """value, label, kind and FEATURES of findings planted in table's texts."""
    made = common.materialize(planting.planted(table))
    found = candidates(made, statistics).withColumn("length", F.char_length("value").cast("long"))
    return found.join(made.select("row_key", "start", "length", "label", "kind"), ["row_key", "start", "length"]).select("value", "label", "kind", *FEATURES)


def labelled_findings(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """FEATURES, value and label of findings that people labelled: labels (doc_id, start, length, label), start in characters.

    Labels that are no candidate of their document train nothing. The corpus's statistics are those of docs.
    """
    table = _rows(docs)
    found = candidates(table, corpus_statistics(table.select("text"))).withColumn("length", F.char_length("value"))
    given = labels.select("doc_id", "start", "length", F.col("label").cast("double").alias("label"))
    return found.join(given, ["doc_id", "start", "length"]).select("value", "label", *FEATURES)


def fit(labelled: DataFrame):
    """The forest, from rows of FEATURES, label and value; None where one of the two labels is missing.

    At most SAMPLE rows of each label train: those whose value has the least hash.
    """
    rows = [labelled.where(F.col("label") == y).orderBy(F.md5("value")).limit(SAMPLE // 2) for y in (0.0, 1.0)]
    sample = common.materialize(rows[0].union(rows[1]))
    if sample.select("label").distinct().count() < 2:
        return None
    sample = sample.repartition(4, "value").sortWithinPartitions("value")
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, featureSubsetStrategy="onethird", seed=7, featuresCol="features", labelCol="label")
    return forest.fit(VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample))


def _rows(docs: DataFrame) -> DataFrame:
    path = F.coalesce(F.col("source").cast("string"), F.lit("")) if "source" in docs.columns else F.lit("")
    table = docs.select(F.col("doc_id").cast("long").alias("doc_id"), common.whole_text(), path.alias("path"))
    return table.select(F.xxhash64("doc_id", "text").alias("row_key"), "doc_id", "path", "text")


def findings(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """row_key, doc_id, start, length, value, score, is_secret of every candidate."""
    table = _rows(docs)
    statistics = corpus_statistics(table.select("text"))
    found = common.materialize(candidates(table, statistics))
    if labelled is None:
        own = weak_labels(found).orderBy(F.md5("value")).limit(OWN)
        labelled = planted_findings(table, statistics).drop("kind").unionByName(own)
    model = fit(labelled)
    if model is None:
        scored = found.withColumn("score", F.col("named") * F.col("assigned"))
    else:
        assembled = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(found)
        scored = model.transform(assembled).withColumn("score", vector_to_array("probability")[1])
    return scored.select("row_key", "doc_id", "start", F.char_length("value").cast("long").alias("length"), "value", "score", (F.col("score") >= 0.5).alias("is_secret"))


def scan(docs: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """doc_id, start, length, value_sha256, score, is_secret: a row for each candidate; start counts characters.

    Null and empty texts have none; repeated rows have theirs each; a null id stays null. An empty table
    gives no rows. Without findings of both labels the score is 1 for a candidate assigned to a name, else 0.
    """
    return findings(docs, labelled).select("doc_id", "start", "length", F.sha2("value", 256).alias("value_sha256"), F.round("score", 6).alias("score"), "is_secret")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """docs with every secret replaced by mask in text; other columns and all rows stay. A null text stays null.

    A secret that a row's text repeats is masked wherever it stands. An empty table gives no rows.
    """
    key, spans_ = common.fresh(docs, "_key", "_spans")
    found = findings(docs).where("is_secret").groupBy(F.col("row_key").alias(key)).agg(F.collect_list(F.struct("start", "length")).alias(spans_))
    keyed = docs.withColumn(key, F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit(""))))
    joined = keyed.join(found, key, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans, texts = batch.column(spans_).to_pylist(), batch.column("text").to_pylist()
            out = []
            for text, cuts in zip(texts, spans, strict=True):
                # Rows that are equal share their findings, so a span may come more than once.
                for s in sorted({(x["start"], x["length"]) for x in cuts or ()}, reverse=True):
                    text = text[: s[0]] + mask + text[s[0] + s[1] :]
                out.append(text)
            columns = [pa.array(out, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = docs.columns
    return joined.select(*names, spans_).mapInArrow(run, docs.schema)
