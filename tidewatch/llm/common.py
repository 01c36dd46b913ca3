"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Text handled at once inside a Python task; arrays of eight bytes a character then stay small.
SLICE_CHARS = 250_000
#: Bytes and rows of a batch handed to Python; Arrow's buffers hold a whole batch, in the JVM and in Python.
BATCH_BYTES, BATCH_ROWS = 2 << 20, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; where it is unset, one of our own, on a single machine only."""
    sc = spark.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="tidewatch-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame) -> DataFrame:
    """Materialise in the shared folder and forget the lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def text_batches(df: DataFrame) -> DataFrame:
    """The same table, in a session that hands at most BATCH_BYTES (or one row) and BATCH_ROWS at once to Python.

    Spark reads these settings when the plan runs, so they stay in the session; lower ones of the caller's are kept.
    """
    conf = df.sparkSession.conf
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", conf.get(name))
        if not now or not 0 < int(now[1]) <= most:
            conf.set(name, most)
    return df


def unused(name: str, columns: list[str]) -> str:
    """The name, with more to it if a column has it (Spark does not tell capital letters apart)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batch: pa.RecordBatch, column: str = "text", chars: int = SLICE_CHARS) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Cut a batch into runs of rows with a bounded amount of text; a null text counts as empty.

    A single row longer than the bound makes a slice of its own.
    """
    for at in range(0, batch.num_rows, 512):
        part = batch.slice(at, 512)
        texts = [t or "" for t in part.column(column).to_pylist()]
        begin, size = 0, 0
        for i, t in enumerate(texts):
            if i > begin and size + len(t) > chars:
                yield part.slice(begin, i - begin), texts[begin:i]
                begin, size = i, 0
            size += len(t)
        yield part.slice(begin), texts[begin:]
    release()


def release() -> None:
    """Give freed memory back to the system: a Python worker waits for its next task beside the JVM, with what it has kept."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def mix64(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes (the shifts and multipliers of SplitMix64, fixed values)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def window_hashes(data: np.ndarray, width: int) -> np.ndarray:
    """Hash of the ``width`` bytes from each place on.

    Hashes of 2, 4, 8, ... bytes are made of two of half the length, with a step that is not linear, so no text has
    the hash of another by its construction.  A width that is no power of two takes two windows that overlap.
    """
    h, n = mix64(data.astype(np.uint64) + np.uint64(1)), 1
    while 2 * n <= width:
        h = mix64(h[:-n] * np.uint64(0x9E3779B97F4A7C15) + (h[n:] ^ np.uint64(n)))
        n *= 2
    if n < width:
        last = width - n
        h = mix64(h[:-last] * np.uint64(0x9E3779B97F4A7C15) + (h[last:] ^ np.uint64(width)))
    return h


#: Bytes of a span that ``span_words`` takes as they are.
EXACT = 24


def span_words(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The first EXACT bytes of each [start, end), as words with zeros behind the end."""
    padded = np.concatenate([data, np.zeros(EXACT, np.uint8)])
    words = np.ndarray((len(data) + EXACT - 7,), "<u8", padded, strides=(1,))
    mask = np.append((np.uint64(1) << np.arange(0, 64, 8, dtype=np.uint64)) - np.uint64(1), np.uint64(2**64 - 1))
    size = end - start
    return np.stack([words[np.minimum(start + at, len(data))] & mask[np.clip(size - at, 0, 8)] for at in range(0, EXACT, 8)])


def span_hashes(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of spans from what ``span_words`` gives; different for most, to be told apart by words and size where it counts."""
    h = mix64(size.astype(np.uint64) + np.uint64(1))
    for w in words:
        h = mix64(h * np.uint64(0x9E3779B97F4A7C15) + w)
    return h


def ragged(flat: np.ndarray, offset: np.ndarray, count: np.ndarray) -> np.ndarray:
    """Concatenate flat[offset[i] : offset[i] + count[i]] over all i."""
    total = int(count.sum())
    begin = np.cumsum(count) - count
    return flat[np.repeat(offset - begin, count) + np.arange(total)]


def store(df: DataFrame, name: str) -> DataFrame:
    """Like ``cut``, as a compressed table in the shared folder."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


def whole_groups(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Batches of rows sorted by keys, cut only between groups."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        change = np.zeros(batch.num_rows, bool)
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            change[1:] |= v[1:] != v[:-1]
            change[0] |= bool(held) and held[-1].column(k)[-1].as_py() != v[0]
        at = np.flatnonzero(change)
        if len(at):
            if held or at[-1]:
                yield pa.Table.from_batches([*held, batch.slice(0, int(at[-1]))])
            held = [batch.slice(int(at[-1]))]
        else:
            held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
    release()
