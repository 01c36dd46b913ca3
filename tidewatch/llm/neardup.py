"""Near duplicates by a chosen-path set similarity join.

A document is the set of its word shingles.  Equal texts are one class, which goes through what follows once.  In each of several independent trees a set follows, from the root, one coordinate of its MinHash
signature, and with some chance a second one, that the node chooses; the value there leads to the child.  The
expected number of children that a pair of the wanted similarity shares stays one, so a pair is likely to meet in some
leaf of some tree.  In a leaf all pairs are compared by sketches (two bits of each signature coordinate), and what passes
is kept as a spanning forest of the leaf.  Every leaf has the same depth, whatever its size, as each level more loses
pairs; leaves with very many sets are compared in pairs of blocks, each in a task of its own.

The forest's components are clusters of candidates.  In them full sets, made anew from the texts, are compared pair by
pair, again in blocks, so a cluster of any size is the work of many tasks; a link of the result is always one of
full sets (as 64-bit hashes of shingles, which are not linear in the words' bytes).  All links of a cluster are found, though only a spanning forest of them is
written.

With the trees and levels set here a pair at the threshold itself is missed with a probability under 1 in 1000, and
a pair of similarity 0.9 with one under 1 in a million, unless others connect them.

A null, empty or blank text has no shingles and is linked with nothing; one with fewer words than a shingle has its
whole sequence as the only shingle.  Rows with the same doc_id count as one document: what one of them links, all are
linked with.  A row without doc_id links others, but gives no name to a component; where nobody has an id, the
component is null and the rows of one text of it are kept.  Other columns are ignored; an empty table gives an empty
table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.classes import class_components, class_texts, text_class, with_class
from tidewatch.llm.common import EXACT, cut, mix64, shuffle_partitions, slices, span_hashes, span_words, store, text_batches, unused, whole_groups
from tidewatch.llm.components import components, spanning

#: Signature coordinates; trees, levels and the chance of a second child (its expectation is that of 1 / 0.8).
COORDINATES, TREES, LEVELS, SECOND = 64, 10, 4, 0.25
#: Sets in a leaf above which it comes in blocks of half as many; members and shingles of a block of full sets.
LEAF, BLOCK, BLOCK_SHINGLES = 8_192, 1_024, 500_000
#: Classes that a task remembers to have seen.
SEEN = 500_000

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(92)
_PLACE = _RANDOM.integers(0, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_A = _RANDOM.integers(0, 2**63, COORDINATES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RANDOM.integers(0, 2**64, COORDINATES, dtype=np.uint64)


def shingle_sets(texts: list[str], words: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of each text's shingles."""
    encoded = [t.encode() for t in texts]
    data = _LOWER[np.frombuffer(b" ".join([*encoded, b""]) or b" ", np.uint8)]
    inside = ~_SPACE[data]
    edge = np.diff(inside.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    word = span_hashes(span_words(data, start, end), end - start)
    for i in np.flatnonzero(end - start > EXACT).tolist():
        word[i] = xxhash.xxh3_64_intdigest(data[start[i] : end[i]].tobytes())
    ends = np.cumsum([len(e) + 1 for e in encoded])
    bounds = [0, *np.searchsorted(start, ends).tolist()]
    place = np.resize(_PLACE, max(words, 1))
    rows = np.zeros(len(word), np.uint64)
    for k in range(min(words, len(word))):
        rows[: len(word) - k] += word[k:] * place[k]
    rows = mix64(rows)
    out = []
    for a, b in zip(bounds, bounds[1:]):
        if b - a >= words:
            out.append(np.unique(rows[a : b - words + 1]))
        elif b > a:
            out.append(mix64(np.array([(word[a:b] * place[: b - a]).sum() + np.uint64(b - a)], np.uint64)))
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash: the least of the shingles' images under each of the functions."""
    out = np.full(COORDINATES, 2**32 - 1, np.uint64)
    for i in range(0, len(shingles), 4_096):
        out = np.minimum(out, ((shingles[None, i : i + 4_096] * _A[:, None] + _B[:, None]) >> np.uint64(32)).min(axis=1))
    return out.astype(np.uint32)


def signatures(texts: DataFrame, words: int) -> DataFrame:
    """doc_id, class and n (shingles) of every row; the signature in the first row that a task sees of a class, in others nothing."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part, own in slices(batch):
                sets = shingle_sets(own, words)
                sigs = []
                for c, s in zip(part.column("class").to_pylist(), sets):
                    sigs.append(signature(s).tobytes() if len(s) and c not in seen else b"")
                    seen.add(c)
                if len(seen) > SEEN:
                    seen.clear()
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("class"), pa.array([len(s) for s in sets], pa.int64()), pa.array(sigs, pa.binary())], ["doc_id", "class", "n", "signature"])

    return text_batches(texts).mapInArrow(run, "doc_id long, class long, n long, signature binary")


def _branch(sig: np.ndarray, node: np.ndarray, row: np.ndarray, levels: int) -> tuple[np.ndarray, np.ndarray]:
    """Nodes so many levels below, and the rows of sig that lead there."""
    for _ in range(levels):
        second = np.flatnonzero(mix64(node + np.uint64(2)) < np.uint64(int(SECOND * 2**64)))
        up = np.concatenate([node, node[second]])
        rows = np.concatenate([row, row[second]])
        chosen = mix64(up + np.concatenate([np.full(len(node), 3, np.uint64), np.full(len(second), 4, np.uint64)])) % np.uint64(COORDINATES)
        node, row = mix64(up + mix64((chosen << np.uint64(32)) + sig[rows, chosen.astype(np.int64)].astype(np.uint64))), rows
    return node, row


def _sketches(sig: np.ndarray) -> np.ndarray:
    """Two bits of each coordinate, as two words."""
    pairs = ((sig >> np.uint32(7)) & np.uint32(3)).astype(np.uint64).reshape(len(sig), 2, 32)
    return (pairs << (np.arange(32, dtype=np.uint64) * np.uint64(2))).sum(axis=2, dtype=np.uint64)


LEAF_ROW = "node long, doc_id long, n long, s1 long, s2 long"


def leaves(classes: DataFrame) -> DataFrame:
    """A row for each leaf of each tree that a class (doc_id, n, signature) comes to."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for i in range(0, whole.num_rows, 4_096):
                batch = whole.slice(i, 4_096)
                n = batch.num_rows
                sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(n, COORDINATES)
                roots = mix64(np.arange(1, TREES + 1, dtype=np.uint64))
                node, row = _branch(sig, np.repeat(roots, n), np.tile(np.arange(n), TREES), LEVELS)
                sketch = _sketches(sig).view(np.int64)[row]
                take = pa.array(row)
                yield pa.RecordBatch.from_arrays([pa.array(node.view(np.int64)), batch.column("doc_id").take(take), batch.column("n").take(take), pa.array(np.ascontiguousarray(sketch[:, 0])), pa.array(np.ascontiguousarray(sketch[:, 1]))], ["node", "doc_id", "n", "s1", "s2"])

    return classes.mapInArrow(run, LEAF_ROW)


def candidate_links(rows: DataFrame, similarity: float, spread: int) -> DataFrame:
    """Compare all pairs of each node (rows in blocks i and j, or all with i = j) by sketches: a and b, a forest of each node."""
    # Coordinates that agree: similarity + a quarter of the rest, and four deviations less.
    expected = similarity + (1 - similarity) / 4
    least = int(np.floor(COORDINATES * (expected - 4 * np.sqrt(expected * (1 - expected) / COORDINATES))))
    even = np.uint64(0x5555555555555555)

    def alike(s: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        ok = np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9
        same = np.zeros(ok.shape, np.uint8)
        for k in range(2):
            d = s[x, k] ^ s[y, k]
            same = same + np.bitwise_count(~(d | d >> np.uint64(1)) & even)
        return ok & (same >= least)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["node", "i", "j"]):
            node, i, j, ids, n, block = (t.column(c).to_numpy() for c in ("node", "i", "j", "doc_id", "n", "own"))
            s = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2")], axis=1)
            new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            size = np.diff(np.append(new, len(node)))
            a, b = [], []
            small = np.repeat(size <= 32, size)
            group = np.repeat(np.arange(len(new)), size)
            for lag in range(1, min(32, int(size.max()))):
                x = np.flatnonzero(small[:-lag] & (group[:-lag] == group[lag:]))
                x = x[alike(s, n, x, x + lag)]
                a.append(x)
                b.append(x + lag)
            for g in np.flatnonzero(size > 32).tolist():
                rows_ = np.arange(new[g], new[g] + size[g])
                left = rows_ if i[new[g]] == j[new[g]] else rows_[block[rows_] == i[new[g]]]
                right = rows_ if i[new[g]] == j[new[g]] else rows_[block[rows_] == j[new[g]]]
                label = np.arange(size[g])
                for p in range(0, len(left), 256):  # only the forest is kept, as all pairs of a large leaf may be alike
                    x, y = np.nonzero(alike(s, n, left[p : p + 256, None], right[None, :]))
                    x, y = label[left[p + x] - new[g]], label[right[y] - new[g]]
                    apart = x != y
                    if apart.any():
                        label = spanning(int(size[g]), x[apart], y[apart])[label]
                own = np.flatnonzero(label != np.arange(size[g]))
                a.append(new[g] + own)
                b.append(new[g] + label[own])
            if a:
                x, y = np.concatenate(a), np.concatenate(b)
                keep = ids[x] != ids[y]
                yield pa.RecordBatch.from_arrays([pa.array(ids[x[keep]]), pa.array(ids[y[keep]])], ["a", "b"])

    return rows.repartition(spread, "node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(run, "a long, b long")


def in_blocks(rows: DataFrame, key: str, cuts: DataFrame | None) -> DataFrame:
    """Add own, i and j: groups in ``cuts`` (key and blocks) come in so many blocks, a row in all pairs of blocks with its own; others whole."""
    if cuts is None:
        return rows.select("*", F.lit(0).alias("own"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    own = F.pmod(F.xxhash64("doc_id"), F.coalesce("blocks", F.lit(1))).cast("int")
    dealt = rows.join(cuts, key, "left").withColumn("own", own)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)))
    return dealt.select(*rows.columns, "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))


def exact_links(rows: DataFrame, words: int, similarity: float, spread: int) -> DataFrame:
    """a and b, a forest of the links of full sets in each cluster (rows with text, in blocks)."""
    percent = round(100 * similarity)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["cluster", "i", "j"]):
            t = t.combine_chunks()
            cluster, i, j, own = (t.column(c).to_numpy() for c in ("cluster", "i", "j", "own"))
            new = np.flatnonzero(np.concatenate([[True], (cluster[1:] != cluster[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            a, b = [], []
            for at, end in zip(new.tolist(), [*new[1:].tolist(), len(cluster)]):
                if end - at < 2:
                    continue
                ids = t.column("doc_id").slice(at, end - at).to_numpy()
                sets = []
                group = t.slice(at, end - at).select(["text"]).to_batches()
                for batch in group:
                    for _, texts in slices(batch):
                        sets += shingle_sets(texts, words)
                x, y = linked(sets, percent)
                if i[at] != j[at]:
                    side = own[at:end]
                    across = side[x] != side[y]
                    x, y = x[across], y[across]
                label = spanning(len(ids), x, y)
                has = np.flatnonzero(label != np.arange(len(ids)))
                a.append(ids[has])
                b.append(ids[label[has]])
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    return rows.repartition(spread, "cluster", "i", "j").sortWithinPartitions("cluster", "i", "j").mapInArrow(run, "a long, b long")


def linked(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """All pairs with 100 * intersection >= percent * union."""
    size = np.array([len(s) for s in sets])
    m = len(sets)
    if m == 2:
        common = np.array([[0, len(np.intersect1d(*sets, assume_unique=True))], [0, 0]])
    else:
        _, term, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        of = np.repeat(np.arange(m), size)
        shared = times[term] > 1
        _, column = np.unique(term[shared], return_inverse=True)
        of = of[shared]
        order = np.argsort(column, kind="stable")
        column, of = column[order], of[order]
        common = np.zeros((m, m), np.float32)
        step = max(256, 4_000_000 // m)
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, step):
            lo, hi = np.searchsorted(column, [c, c + step])
            part = np.zeros((m, step), np.float32)
            part[of[lo:hi], column[lo:hi] - c] = 1
            common += part @ part.T
    common = np.rint(common).astype(np.int64)
    union = size[:, None] + size[None, :] - common
    x, y = np.nonzero(np.triu((100 * common >= percent * union) & (common > 0), 1))
    return x, y


def _components(docs: DataFrame, words: int, similarity: float) -> DataFrame:
    """doc_id, class, n, component_id and kept of every row."""
    spread = shuffle_partitions(docs.sparkSession)
    texts = with_class(docs)
    signed = store(signatures(texts, words), "signatures")
    heads = signed.filter("length(signature) > 0").dropDuplicates(["class"]).select(F.col("class").alias("doc_id"), "n", "signature")
    rows = store(leaves(heads), "leaves")
    large = cut(rows.groupBy("node").agg(F.count("*").alias("n")).filter(F.col("n") > LEAF).select("node", F.ceil(F.col("n") / (LEAF // 2)).cast("int").alias("blocks")))
    candidates = candidate_links(in_blocks(rows, "node", large if large.take(1) else None), similarity, spread)
    clusters = cut(components(candidates.distinct()).withColumnRenamed("id", "doc_id").withColumnRenamed("component", "cluster"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    sizes = signed.filter("length(signature) > 0").select(F.col("class").alias("doc_id"), "n").distinct()
    giants = cut(clusters.join(sizes, "doc_id").groupBy("cluster").agg(blocks.alias("blocks")).filter("blocks > 1"))
    links = exact_links(in_blocks(class_texts(texts, clusters), "cluster", giants if giants.take(1) else None), words, similarity, spread)
    found = class_components(signed.select("doc_id", "class", "n"), links)
    named = F.col("component_id").isNotNull() | (F.col("n") == 0) | (F.col("class") == F.col("first"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")) & named).drop("first")


def near_duplicates(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every document."""
    return _components(docs, words, similarity).select("doc_id", F.col("n").alias("n_shingles"), "component_id", "kept")


def one_of_each(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The documents, with all their columns, without those that are near duplicates of one of a smaller id."""
    own, text = (unused(c, docs.columns) for c in ("kept_id", "kept_class"))
    kept = _components(docs, words, similarity).filter("kept").select(F.col("doc_id").alias(own), F.col("class").alias(text)).distinct()
    return docs.join(kept, F.col("doc_id").cast("long").eqNullSafe(F.col(own)) & (text_class(F.col("text")) == F.col(text)), "left_semi")
