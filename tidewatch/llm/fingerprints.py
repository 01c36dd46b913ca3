"""Document fingerprints by content-defined chunking.

A gear hash of the last ``WINDOW`` bytes runs over each text.  A chunk ends where the hash meets a mask: a strict one
up to the normal length, a loose one beyond it, and at the longest length in any case (normalised chunking), so an edit
moves only the boundaries near it.  A fingerprint is the set of chunk digests with their lengths; two are compared by
the bytes of the chunks that they share, over the bytes of the smaller set: the containment of one in the other.

Null texts count as empty.  An empty text has the empty fingerprint, which is like another empty one (1) and unlike
any other (0).  Equal texts have equal fingerprints.  Repeated rows, ties of doc_id (in the order of their compressed texts), a null doc_id
(it comes first) and an empty table (empty result) need no special care; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import shuffle_partitions, slices, store, text_batches

WINDOW, NORMAL, LONGEST = 32, 64, 256
STRICT, LOOSE = np.uint32(0x7F << 25), np.uint32(0x1F << 27)
GEAR = np.random.default_rng(7).integers(0, 2**32, 256, dtype=np.uint32)

Chunks = dict[str, int]


def gear(data: np.ndarray) -> np.ndarray:
    """Hash of the WINDOW bytes that end at each byte: the sum of gear values, shifted by one bit for each byte since."""
    h = GEAR[data]
    step = 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h


def chunk_texts(encoded: list[bytes]) -> list[Chunks]:
    """Digest and length of each distinct chunk of each text.

    The hash runs over all texts together: no chunk ends before its WINDOW-th byte, so none depends on the text before.
    """
    joined = b"".join(encoded)
    h = gear(np.frombuffer(joined, np.uint8))
    loose = np.flatnonzero((h & LOOSE) == 0)
    strict = loose[(h[loose] & STRICT) == 0].tolist()
    loose = loose.tolist()
    strict.append(len(joined) + LONGEST)
    loose.append(len(joined) + LONGEST)
    out, start, digest = [], 0, xxhash.xxh3_64_hexdigest
    for text in encoded:
        end, found = start + len(text), {}
        while start < end:
            cutoff = strict[bisect_left(strict, start + WINDOW - 1)]
            if cutoff >= start + NORMAL:
                cutoff = min(loose[bisect_left(loose, start + NORMAL - 1)], start + LONGEST - 1)
            cutoff = min(cutoff + 1, end)
            found[digest(joined[start:cutoff])] = cutoff - start
            start = cutoff
        out.append(found)
    return out


def to_string(chunks: Chunks) -> str:
    """The fingerprint as text: digest:length of each chunk, in the order of the digests."""
    return " ".join(f"{d}:{n}" for d, n in sorted(chunks.items()))


def from_string(fingerprint: str) -> Chunks:
    return {d: int(n) for d, _, n in (x.partition(":") for x in fingerprint.split())}


def containment(a: Chunks, b: Chunks) -> float:
    """Bytes in shared chunks over the bytes of the smaller set."""
    least = min(sum(a.values()), sum(b.values()))
    if not least:
        return float(not a and not b)
    if len(b) < len(a):
        a, b = b, a
    return sum(n for d, n in a.items() if d in b) / least


def fingerprint(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                found = chunk_texts([t.encode() for t in texts])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(map(to_string, found), pa.string())], ["doc_id", "fingerprint"])

    docs = text_batches(docs).select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, fingerprint string")


COLUMNS = "n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compare(texts: list[str], following: list[str]) -> list[pa.Array]:
    """The columns of COLUMNS for texts and those that follow them."""
    cuts = [len(t) // 2 for t in texts]
    edited = [(t[: len(t) - c] + f[:c]).encode() for t, c, f in zip(texts, cuts, following)]
    alone = not all(a is b for a, b in zip(texts[1:], following))
    own = chunk_texts([t.encode() for t in texts] + ([f.encode() for f in following] if alone else [following[-1].encode()]))
    after = own[len(texts) :] if alone else own[1:]
    own = own[: len(texts)]
    changed = chunk_texts(edited)
    return [
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array([hashlib.sha256(e).hexdigest() for e in edited]),
        pa.array(map(to_string, own), pa.string()),
        pa.array(map(to_string, changed), pa.string()),
        pa.array(map(containment, own, changed), pa.float64()),
        pa.array(map(containment, own, after), pa.float64()),
    ]


def edit_likeness(docs: DataFrame) -> DataFrame:
    """Fingerprint each text and the text whose last half makes way for the beginning of the next document, and compare.

    Documents are dealt by ranges of doc_id.  In a range each text meets the next one; the last of a range and the
    first (one each) are carried on with their texts, and meet over the ranges' numbers; the last of all meets the first.
    """
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    kind = docs.schema["doc_id"].dataType.simpleString()

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([press.compress(t.encode()) for t in texts], pa.binary())], ["doc_id", "packed"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, held_id, held, press = None, None, None, zstandard.ZstdDecompressor()
        for whole in batches:
            for k in range(0, whole.num_rows, 256):
                part = whole.slice(k, 256)
                ids, texts = part.column("doc_id"), [press.decompress(p).decode() for p in part.column("packed").to_pylist()]
                if held is None:
                    first = texts[0]
                else:
                    ids, texts = pa.concat_arrays([held_id, ids]), [held, *texts]
                held_id, held = ids[-1:], texts[-1]
                if n := len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([ids[:n], *_compare(texts[:n], texts[1:]), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], ["doc_id", *names, "last", "first"])
        if held is not None:
            empty = [pa.nulls(1, t) for t in (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())]
            yield pa.RecordBatch.from_arrays([held_id, *empty, pa.array([held]), pa.array([first])], ["doc_id", *names, "last", "first"])

    def finish(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *_compare(batch.column("last").to_pylist(), batch.column("next").to_pylist())], ["doc_id", *names])

    docs = text_batches(docs).select("doc_id", "text")
    packed = docs.mapInArrow(pack, f"doc_id {kind}, packed binary")  # texts go compressed through the shuffle
    ordered = packed.repartitionByRange(shuffle_partitions(docs.sparkSession), "doc_id").sortWithinPartitions("doc_id", "packed")
    rows = store(ordered.mapInArrow(run, f"doc_id {kind}, {COLUMNS}, last string, first string").withColumn("range", F.spark_partition_id()), "fingerprints")
    ends = rows.filter("last IS NOT NULL")
    # One row for each range of documents, whose number is that of the shuffle partitions.
    order = Window.orderBy("range")
    met = ends.select("doc_id", "last", F.coalesce(F.lead("first").over(order), F.first("first").over(order)).alias("next"))
    return rows.filter("last IS NULL").select("doc_id", *names).unionByName(met.mapInArrow(finish, f"doc_id {kind}, {COLUMNS}"))
