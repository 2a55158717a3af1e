"""What the operators share: tables in the checkpoint folder, text batches, hashes of words."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one NumPy step holds.
CHUNK_BYTES = 1 << 20
#: Spark's settings for the write of a table in between: a query's shuffle files are deleted once it has ended, and Python
#: workers get texts by so many rows, since each holds a batch, and what it makes of it, whole.
WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "2000"}

_GOLD = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)
_S27, _S30, _S31 = np.uint64(27), np.uint64(30), np.uint64(31)

#: White space of the word rule ``[^\x20\x09-\x0D]+``.
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@lru_cache(maxsize=1)
def _own_dir() -> str:
    return "file://" + tempfile.mkdtemp(prefix="cloudweave-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. A local master does with one of its own where that is unset."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _own_dir()
    return f"{base.rstrip('/')}/cloudweave-{uuid.uuid4().hex}"


def materialize(df: DataFrame) -> DataFrame:
    """Write df as Parquet into the shared folder and read it back: cuts the lineage, survives executors.

    The write's shuffle files, which nothing reads again, go when it ends; the session's settings (WRITING) are put back.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    before = {k: spark.conf.get(k, None) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete what materialize wrote, once nothing that is still to run reads it."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(name), F.lit("")).alias("text")


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, with underscores added where df has such a column."""
    used = {c.lower() for c in df.columns}
    out = []
    for n in names:
        while n.lower() in used:
            n += "_"
        out.append(n)
    return out


def slices(batch: pa.RecordBatch, max_bytes: int = CHUNK_BYTES, column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows whose texts hold about max_bytes together (one row at least)."""
    lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    start, held = 0, 0
    for i, n in enumerate(lengths):
        if held and held + n > max_bytes:
            yield batch.slice(start, i - start)
            start, held = i, 0
        held += int(n)
    if start < len(lengths):
        yield batch.slice(start)


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all rows end to end, padded by 16 zero bytes, and the n + 1 offsets."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    out = np.zeros(int(offsets[-1] - offsets[0]) + 16, np.uint8)
    if data is not None:
        out[:-16] = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]
    return out, offsets - offsets[0]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that scatters all bits (splitmix64's last steps)."""
    x = (x ^ (x >> _S30)) * _M1
    x = (x ^ (x >> _S27)) * _M2
    return x ^ (x >> _S31)


def unaligned_u64(buf: np.ndarray) -> np.ndarray:
    """buf's little-endian 8-byte words at every byte offset, as a view."""
    return np.ndarray((len(buf) - 7,), "<u8", buf.data, 0, (1,))


def span_hashes(buf: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each byte range of buf (which has 16 bytes to spare)."""
    words = unaligned_u64(buf)
    h = lengths.astype(np.uint64) * _GOLD
    live, at, left = slice(None), starts, lengths
    while len(at):
        word = words[at]
        short = left < 8
        word[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        h[live] = mix(h[live] ^ word) + _GOLD
        more = np.flatnonzero(left > 8)
        live = more if isinstance(live, slice) else live[more]
        at, left = at[more] + 8, left[more] - 8
    return h


def word_spans(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = _SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and lengths of the words of all rows, and for each row the number of its first word (n + 1).

    space tells for each byte whether it stands between words.
    """
    n = int(offsets[-1])
    inside = ~space[buf[: n + 1]]
    inside[n] = False
    begin = inside[:n].copy()
    begin[1:] &= ~inside[: n - 1]
    cuts = offsets[1:-1]
    cuts = cuts[cuts < n]
    begin[cuts] = inside[cuts]
    starts = np.flatnonzero(begin)
    # A word ends where the next byte is white space or the next row begins.
    last = inside[:n] & ~inside[1 : n + 1]
    last[cuts[cuts > 0] - 1] = inside[cuts[cuts > 0] - 1]
    ends = np.flatnonzero(last) + 1
    return starts, ends - starts, np.searchsorted(starts, offsets)


def lower_ascii(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def shingle_hashes(words: np.ndarray, firsts: np.ndarray, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of size words within a row, in order, and each row's first (n + 1).

    A row of fewer words has its whole sequence as its one shingle; one without words has none.
    """
    counts = np.diff(firsts)
    out_counts = np.where(counts >= size, counts - size + 1, np.minimum(counts, 1))
    out_firsts = np.concatenate(([0], np.cumsum(out_counts)))
    full = max(0, len(words) - size + 1)
    acc = np.full(full, np.uint64(size), np.uint64)
    for j in range(size):
        acc = mix(acc * _GOLD + words[j : j + full])
    keep = np.zeros(len(words), bool)
    row = np.repeat(np.arange(len(counts)), counts)
    keep[:] = np.arange(len(words)) + size <= firsts[1:][row] if len(words) else False
    out = np.empty(int(out_firsts[-1]), np.uint64)
    long_rows = counts >= size
    slot = np.repeat(long_rows, out_counts)
    out[slot] = acc[np.flatnonzero(keep)]
    for r in np.flatnonzero((counts > 0) & ~long_rows):
        h = np.full(1, np.uint64(counts[r]), np.uint64)
        for w in words[firsts[r] : firsts[r + 1]]:
            h = mix(h * _GOLD + w)
        out[out_firsts[r]] = h[0]
    return out, out_firsts


def row_shingles(column: pa.Array, size: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of lower-cased texts in order, and each row's first (n + 1)."""
    buf, offsets = text_bytes(column)
    buf = lower_ascii(buf)
    starts, lengths, firsts = word_spans(buf, offsets)
    return shingle_hashes(span_hashes(buf, starts, lengths), firsts, size)
