"""Removal of long repeated byte strings by distributed prefix doubling over sampled suffixes.

Which bytes are covered by a string of ``length`` bytes that also starts elsewhere?  A row for each byte would be many
times the input, so suffixes are taken only at anchors: the position with the least hash of ``GRAM`` bytes among
``spread`` positions in a row.  Each string of that length has one anchor near its start, the same one wherever it
stands, and contains the 4 * ``base`` bytes behind it.

Spark doubles the ranks of the anchors.  The first rank is the name (a 64-bit hash) of the base bytes behind an anchor.
In each round the pairs of an anchor's rank and of the name of the bytes that follow, as many again, are counted, those
that only one anchor has are dropped, and the others are sorted; the place in that order is the new rank, of
twice the length.  The last round goes past the threshold: the name is that of all bytes of all strings of the anchor.
Anchors that share the last rank have all their strings repeated.  Where anchors share the rank before but differ in
the last, single strings are decided: one anchor of each last rank gives a row for each of its strings, and those that
meet an equal one are repeated.  Equality thus rests on several names of 64 bits together.

A null text is empty.  Texts shorter than the length lose nothing.  Repeated rows are texts of their own: each of at least
so many bytes loses everything.  Rows with the same doc_id are told apart by their text; a null doc_id is handled as any
other.  An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh3_64_intdigest

from tidewatch.llm.common import cut, mix64, shuffle_partitions, slices, store, text_batches, whole_groups, window_hashes

#: Bytes of a repeated string; bytes that are hashed to choose anchors; rounds that double a rank.
LENGTH, GRAM, ROUNDS = 400, 16, 2


def layout(length: int) -> tuple[int, int]:
    """spread and base for strings of so many bytes."""
    if not 64 <= length <= 512:
        raise ValueError("strings of 64 to 512 bytes")
    spread = length * 12 // 25
    return spread, (length - spread) >> ROUNDS


class Bytes:
    """The texts of a slice in one array."""

    def __init__(self, texts: list[str]):
        self.encoded = [t.encode() for t in texts]
        self.size = np.array([len(e) for e in self.encoded], np.int64)
        self.begin = np.cumsum(self.size) - self.size
        self.joined = b"".join(self.encoded)
        self.view = memoryview(self.joined)

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit names of the spans [start, end)."""
        return np.fromiter((xxh3_64_intdigest(self.view[a:b]) for a, b in zip(start.tolist(), end.tolist())), np.uint64, len(start))


def anchors(b: Bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text, position, and first and last start of the strings of each anchor (places in the array of all texts)."""
    n, (spread, _) = len(b.joined), layout(length)
    if n < length:
        return (np.zeros(0, np.int64),) * 4
    # The hash above, the position below: the least is the leftmost of the least hashes.
    key = window_hashes(np.frombuffer(b.joined, np.uint8), GRAM) >> np.uint64(36) << np.uint64(36) | np.arange(n - GRAM + 1, dtype=np.uint64)
    width = 1
    while 2 * width <= spread:
        key = np.minimum(key[:-width], key[width:])
        width *= 2
    if width < spread:
        key = np.minimum(key[: len(key) - (spread - width)], key[spread - width :])
    place = (key & np.uint64((1 << 36) - 1)).astype(np.int64)
    starts = np.maximum(b.size - length + 1, 0)
    text = np.repeat(np.arange(len(starts)), starts)
    first = np.arange(len(text)) + np.repeat(b.begin - (np.cumsum(starts) - starts), starts)
    place = place[first]
    new = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (text[1:] != text[:-1])])) if len(text) else np.zeros(0, np.int64)
    last = np.append(new[1:], len(text)) - 1 if len(new) else new
    return text[new], place[new], first[new], first[last]


#: Last ranks of one rank before, above which their strings are counted in rows of their own.
MANY = 1_024


def tagged(docs: DataFrame) -> DataFrame:
    """doc_id, text and tag: 64 bits of the text's SHA-256, so that rows with the same doc_id, or none, are told apart."""
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", text.alias("text"), F.xxhash64(F.sha2(text, 256)).alias("tag"), *(["row"] if "row" in docs.columns else []))


#: Names of the bytes that each round adds to an anchor's rank; the first is the first rank.
NAMES = [f"name{k}" for k in range(ROUNDS + 2)]


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """The names of each anchor, its document (doc_id, tag) and span: the first start * 2**8 + how many more."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    spread, base = layout(length)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                b = Bytes(texts)
                text, at, lo, hi = anchors(b, length)
                edges = [0, *(base << k for k in range(ROUNDS + 1))]
                names = [b.names(at + x, at + y) for x, y in zip(edges, edges[1:])]
                shape = (at - lo).astype(np.uint64) << np.uint64(32) | (hi - at + spread).astype(np.uint64)
                names.append(mix64(b.names(lo, hi + length) + mix64(shape)))
                take = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [*(pa.array(x.view(np.int64)) for x in names), part.column("doc_id").take(take), part.column("tag").take(take), pa.array((lo - b.begin[text]) << 8 | (hi - lo))],
                    [*NAMES, "doc_id", "tag", "span"],
                )

    return docs.mapInArrow(run, ", ".join(f"{n} long" for n in NAMES) + f", doc_id {kind}, tag long, span long")


def rerank(rows: DataFrame, name: str) -> DataFrame:
    """One round: rows whose pair of rank and name others have too, with the pair's place in the order of all pairs as rank."""
    pairs = rows.groupBy("rank", name).agg(F.count("*").alias("n")).filter("n > 1").select("rank", name)
    # Increasing over the ranges and in each of them; written out, as a second run might cut the ranges elsewhere.
    ordered = cut(pairs.repartitionByRange(shuffle_partitions(rows.sparkSession), "rank", name).sortWithinPartitions("rank", name).withColumn("next", F.monotonically_increasing_id()))
    return rows.join(ordered, ["rank", name]).drop("rank", name).withColumnRenamed("next", "rank")


def packed(docs: DataFrame) -> DataFrame:
    """Texts compressed, for a shuffle; ``row`` goes with them if there is one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = ["row"] if "row" in docs.columns else []

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        for batch in batches:
            for part, texts in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("tag"), pa.array([press.compress(t.encode()) for t in texts], pa.binary()), *map(part.column, rest)], ["doc_id", "tag", "packed", *rest])

    schema = f"doc_id {kind}, tag long, packed binary" + "".join(f", row {docs.schema['row'].dataType.simpleString()}" for _ in rest)
    return docs.mapInArrow(run, schema)


#: Bytes of texts that are unpacked at once; single strings are several dozen times as large.
UNPACKED = 1 << 18


def unpacked(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Cut a batch of packed texts into runs of rows with a bounded amount of text (or one text)."""
    press = zstandard.ZstdDecompressor()
    begin, size, texts = 0, 0, []
    for i, p in enumerate(batch.column("packed")):
        text = press.decompress(p.as_py())
        if texts and size + len(text) > UNPACKED:
            yield batch.slice(begin, i - begin), texts
            begin, size, texts = i, 0, []
        texts.append(text)
        size += len(text)
    if texts:
        yield batch.slice(begin), texts


def _same_document(a: DataFrame, b: DataFrame) -> Column:
    return a["doc_id"].eqNullSafe(b["doc_id"]) & (a["tag"] == b["tag"])


def _contexts(docs: DataFrame, chosen: DataFrame, length: int, strings: bool) -> DataFrame:
    """The bytes of all strings of each chosen anchor (rank, alone, doc_id, tag, span); or with ``strings`` the hash of each one."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    lists = chosen.groupBy("doc_id", "tag").agg(F.collect_list(F.struct("rank", "alone", "span")).alias("list"))
    texts = packed(docs.select("doc_id", "text", "tag"))
    joined = texts.join(lists, _same_document(texts, lists)).select(texts["doc_id"], texts["tag"], "packed", "list")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, text in unpacked(whole):
                lists_ = batch.column("list")
                of = np.repeat(np.arange(batch.num_rows), pa.compute.list_value_length(lists_).to_numpy())
                flat = lists_.flatten()
                rank, alone, span = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
                lo, more = span >> 8, span & 255
                owner = [batch.column("doc_id").take(pa.array(of)), batch.column("tag").take(pa.array(of))]
                if not strings:
                    parts = [text[t][a : a + n + length] for t, a, n in zip(of.tolist(), lo.tolist(), more.tolist())]
                    yield pa.RecordBatch.from_arrays([pa.array(rank), pa.array(alone), *owner, pa.array(lo), pa.array(parts, pa.binary())], ["rank", "alone", "doc_id", "tag", "lo", "part"])
                    continue
                size = np.array([len(t) for t in text])
                string = window_hashes(np.frombuffer(b"".join(text), np.uint8), length)
                row = np.repeat(np.arange(len(lo)), more + 1)
                start = lo[row] + np.arange(len(row)) - np.repeat(np.cumsum(more + 1) - more - 1, more + 1)
                place = start + (np.cumsum(size) - size)[of[row]]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(rank).take(take), pa.array(string[place].view(np.int64)), pa.array(alone).take(take), owner[0].take(take), owner[1].take(take), pa.array(start)], ["rank", "string", "alone", "doc_id", "tag", "lo"])

    head = "rank long, string long" if strings else "rank long"
    return joined.mapInArrow(run, f"{head}, alone boolean, doc_id {kind}, tag long, lo long" + ", part binary" * (not strings))


def _repeated_in_groups(rows: DataFrame, length: int, kind: str) -> DataFrame:
    """doc_id, tag, lo and hi: runs of starts of strings that another anchor of the same rank has too."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["rank"]):
            t = t.combine_chunks()
            parts = t.column("part").to_pylist()
            size = np.array([len(p) for p in parts])
            string = window_hashes(np.frombuffer(b"".join(parts), np.uint8), length)
            count = size - length + 1
            row = np.repeat(np.arange(len(parts)), count)
            inside = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
            place = inside + (np.cumsum(size) - size)[row]
            string = mix64(string[place] + mix64(t.column("rank").to_numpy().view(np.uint64)[row]))
            _, inverse, times = np.unique(string, return_inverse=True, return_counts=True)
            hit = (times[inverse] > 1) & t.column("alone").to_numpy()[row]
            edge = np.flatnonzero(hit & ~np.concatenate([[False], hit[:-1] & (row[1:] == row[:-1])]))
            end = np.flatnonzero(hit & ~np.concatenate([hit[1:] & (row[1:] == row[:-1]), [False]]))
            take, lo = pa.array(row[edge]), t.column("lo").to_numpy()[row[edge]]
            doc, tag = (t.column(c).combine_chunks().take(take) for c in ("doc_id", "tag"))
            yield pa.RecordBatch.from_arrays([doc, tag, pa.array(lo + inside[edge]), pa.array(lo + inside[end])], ["doc_id", "tag", "lo", "hi"])

    spread = shuffle_partitions(rows.sparkSession)
    return rows.repartition(spread, "rank").sortWithinPartitions("rank").mapInArrow(run, f"doc_id {kind}, tag long, lo long, hi long")


def repeated_starts(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """doc_id, tag, lo and hi: runs of starts of repeated strings; docs as ``tagged`` gives them."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = anchor_rows(docs.select("doc_id", "text", "tag"), length).withColumnRenamed(NAMES[0], "rank")
    for k, name in enumerate(NAMES[1:-1], 1):
        rows = store(rerank(rows, name), f"anchors{k}")
    left = rows.withColumnRenamed(NAMES[-1], "name")
    last = store(left.groupBy("rank", "name").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "tag", "span")).alias("one")), "ranks")
    certain = left.join(last.filter("n > 1").select("rank", "name"), ["rank", "name"])
    found = certain.select("doc_id", "tag", F.shiftright("span", 8).alias("lo"), (F.shiftright("span", 8) + F.col("span").bitwiseAND(255)).alias("hi"))
    mixed = cut(last.groupBy("rank").agg(F.count("*").alias("names")).filter("names > 1"))
    open_ = last.join(mixed, "rank").select("rank", "names", (F.col("n") == 1).alias("alone"), "one.*")
    few, many = open_.filter(F.col("names") <= MANY).drop("names"), open_.filter(F.col("names") > MANY).drop("names")
    found = found.unionByName(_repeated_in_groups(_contexts(docs, few, length, strings=False), length, kind))
    if mixed.filter(F.col("names") > MANY).take(1):
        strings = store(_contexts(docs, many, length, strings=True), "strings")
        repeated = cut(strings.groupBy("rank", "string").agg(F.count("*").alias("n")).filter("n > 1").select("rank", "string"))
        found = found.unionByName(strings.filter("alone").join(repeated, ["rank", "string"]).select("doc_id", "tag", "lo", F.col("lo").alias("hi")))
    return found


FORMS = {"kept": ("binary", pa.binary(), lambda b: b), "kept_sha256": ("string", pa.string(), lambda b: hashlib.sha256(b).hexdigest()), "text": ("string", pa.string(), lambda b: b.decode("utf-8", "ignore"))}


def remove_repeats(docs: DataFrame, form: str | tuple[str, ...] = "kept", length: int = LENGTH) -> DataFrame:
    """doc_id, tag, n_bytes, n_removed, n_spans and the remaining bytes, in one form or more: as they are (kept), as kept_sha256, or as text without cut characters."""
    forms = (form,) if isinstance(form, str) else form
    docs = tagged(text_batches(docs))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rest = ["row"] if "row" in docs.columns else []
    spans = repeated_starts(docs, length).groupBy("doc_id", "tag").agg(F.collect_set(F.struct("lo", "hi")).alias("runs"))  # repeated rows have the same runs
    texts = packed(docs)
    joined = texts.join(spans, _same_document(texts, spans), "left").select(texts["doc_id"], texts["tag"], "packed", "runs", *rest)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch, texts in unpacked(whole):
                sizes, removed, count, kept = [], [], [], [[] for _ in forms]
                for text, runs in zip(texts, batch.column("runs").to_pylist()):
                    at, out, n = 0, [], 0
                    for lo, hi in merged([(r["lo"], r["hi"] + length) for r in runs or []]):
                        out.append(text[at:lo])
                        at, n = hi, n + 1
                    left = b"".join([*out, text[at:]])
                    sizes.append(len(text))
                    removed.append(len(text) - len(left))
                    count.append(n)
                    for column, name in zip(kept, forms):
                        column.append(FORMS[name][2](left))
                columns = [pa.array(c, pa.int64()) for c in (sizes, removed, count)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("tag"), *columns, *(pa.array(c, FORMS[name][1]) for c, name in zip(kept, forms)), *map(batch.column, rest)], ["doc_id", "tag", "n_bytes", "n_removed", "n_spans", *forms, *rest])

    schema = f"doc_id {kind}, tag long, n_bytes long, n_removed long, n_spans long" + "".join(f", {name} {FORMS[name][0]}" for name in forms)
    return joined.mapInArrow(run, schema + "".join(f", row {docs.schema['row'].dataType.simpleString()}" for _ in rest))


def strip(docs: DataFrame, length: int = LENGTH) -> DataFrame:
    """The documents, with all their columns, without the repeated bytes of their texts; a character that is cut goes."""
    names, kinds = docs.columns, dict(docs.dtypes)
    others = [F.col(n) for n in names if n != "text"]
    kept = remove_repeats(docs.select("doc_id", "text", F.struct(*others).alias("row")), "text", length)
    out = kept.select(*(F.col("row")[n].alias(n) for n in names if n != "text"), "text")
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(kinds["n_chars"]))
    return out.select(*names)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Spans [lo, hi) that overlap or touch, as one."""
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(out[-1][1], hi)
        else:
            out.append((lo, hi))
    return out
