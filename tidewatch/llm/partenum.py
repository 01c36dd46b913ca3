"""Jaccard join of documents' shingle sets by PartEnum signatures.

Sets are sorted into bands of size, so wide that a set's partners lie in its own band and the two beside it.  For a band and the
one above it the similarity bounds by how many elements two partners can differ (k).  The domain of shingles is cut
into parts, and each part into cells, by hash.  Of two partners' parts only so many can differ in more than a few
elements; in every other part some subset of cells of a stated size is the same in both.  Each set therefore has a
signature for each subset of each part (its elements there), and partners share one, whatever their elements are: no
link is lost by chance.

There are some parts more than needed, so partners agree in several.  A set with less than that many parts in which
some subset is empty leaves out the signatures of empty subsets; partners then still share another one.  Else all sets
of a band that are empty there would meet.

Equal texts are one class, told apart by 64 bits of their SHA-256.  Signatures are packed by buckets before they are
shuffled, and those of one class alone are dropped.  Classes with a common signature are compared by sketches (two bits of each of
64 minwise hashes, six deviations of slack: a pair at the threshold fails that with a chance of under one in a million);
in groups of any size, in blocks.  What passes is a cluster of candidates, in which full sets, made anew from the texts,
are compared in blocks.  All links of a cluster are found, though only a spanning forest of them is written.

A null, empty or blank text has no shingles and is linked with nothing; one with fewer words than a shingle has its
whole sequence as the only shingle.  Rows with the same doc_id are one document, whatever their texts: what one of
them links, all are linked with.  A row without doc_id links others as any row does, but gives no name to
their component; where nobody has an id, the component is null.  Other columns are ignored; an empty table gives an
empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.classes import class_components, class_texts, with_class
from tidewatch.llm.common import cut, mix64, release, shuffle_partitions, slices, text_batches, whole_groups
from tidewatch.llm.components import components, spanning
from tidewatch.llm.neardup import BLOCK, BLOCK_SHINGLES, COORDINATES, _sketches, exact_links, in_blocks, shingle_sets, signature

#: Buckets of signatures for each partition; signatures packed at once; classes that a task remembers to have seen.
BUCKETS, PACKED, SEEN = 4, 1_000_000, 500_000
#: Members of a group of one signature above which it comes in blocks of half as many; deviations of slack of sketches.
GROUP, SLACK = 8_192, 6
_STEPS = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], np.uint64)


@dataclass(frozen=True)
class Scheme:
    """How sets that differ in at most k elements are signed: parts, cells of a part, how many of its cells a signature takes, and in how many parts partners agree at least."""

    k: int
    parts: int
    cells: int
    taken: int
    agreed: int


@cache
def scheme(k: int) -> Scheme:
    """A part of a few differences for small k; else three cells, of which one may differ in a part."""
    if k < 4:
        return Scheme(k, 1, k + 2 if k else 1, 2 if k else 1, 1)
    worse = k // 2  # parts with more than one difference
    agreed = 1 + worse // 8
    return Scheme(k, worse + agreed, 3, 2, agreed)


@cache
def bands(percent: int, largest: int) -> tuple[np.ndarray, list[Scheme]]:
    """First sizes of the bands, and of each band the scheme that its sets share with those of the next."""
    first, schemes = [1], []
    while first[-1] <= largest:
        beyond = 100 * first[-1] // percent + 1
        a = beyond - 1
        b = 100 * a // percent
        schemes.append(scheme((a + b) * (100 - percent) // (100 + percent)))
        first.append(beyond)
    return np.array(first), schemes


def signed(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of the sets: owner (index of the set), upper (1 if it is signed as one of the larger band), and signature."""
    size = np.array([len(s) for s in sets], np.int64)
    owners, uppers, found = [], [], []
    first, schemes = bands(percent, max(1, 1 << int(size.max(initial=1)).bit_length()))
    band = np.searchsorted(first, size, "right") - 1
    for upper in (0, 1):
        family = band - upper
        shape = np.array([(schemes[f].cells, schemes[f].taken) if f >= 0 and n else (0, 0) for f, n in zip(family.tolist(), size.tolist())]).reshape(-1, 2)
        for cells, taken in sorted(set(map(tuple, shape.tolist())) - {(0, 0)}):
            chosen = np.flatnonzero((shape[:, 0] == cells) & (shape[:, 1] == taken))
            parts = np.array([schemes[f].parts for f in family[chosen].tolist()])
            agreed = np.array([schemes[f].agreed for f in family[chosen].tolist()])
            flat = np.concatenate([sets[i] for i in chosen.tolist()])
            of = np.repeat(np.arange(len(chosen)), size[chosen])
            begin = np.cumsum(parts) - parts
            cell = begin[of] * cells + (((flat >> np.uint64(32)) * (parts * cells)[of].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
            total = int(parts.sum()) * cells
            content = np.zeros(total, np.uint64)
            np.add.at(content, cell, flat)
            content = mix64(content).reshape(-1, cells)
            number = np.bincount(cell, minlength=total).reshape(-1, cells)
            part_of = np.repeat(np.arange(len(chosen)), parts)
            tag = mix64((family[chosen][part_of].astype(np.uint64) << np.uint64(40)) + (np.arange(len(part_of)) - begin[part_of]).astype(np.uint64) + np.uint64(1))
            subsets = list(combinations(range(cells), taken))
            empty = np.stack([number[:, list(s)].sum(axis=1) == 0 for s in subsets])
            light = np.bincount(part_of, empty.any(axis=0), len(chosen))
            everything = (light >= agreed)[part_of]
            for number_of, (s, none) in enumerate(zip(subsets, empty)):
                sig = tag + np.uint64(number_of)
                for x in s:
                    sig = mix64(sig * _STEPS[number_of % 5] + content[:, x])
                keep = ~none | everything
                owners.append(chosen[part_of[keep]])
                uppers.append(np.full(int(keep.sum()), upper))
                found.append(sig[keep])
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(uppers), np.concatenate(found)


def sketched(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, class, n (size of the set) and sketch (s1, s2) of every row of ``with_class``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                sets = shingle_sets(texts, words)
                sketch = _sketches(np.stack([signature(s) for s in sets])).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("class"), pa.array([len(s) for s in sets], pa.int64()), pa.array(np.ascontiguousarray(sketch[:, 0])), pa.array(np.ascontiguousarray(sketch[:, 1]))],
                    ["doc_id", "class", "n", "s1", "s2"],
                )

    return text_batches(docs).mapInArrow(run, "doc_id long, class long, n long, s1 long, s2 long")


def packed_signatures(docs: DataFrame, words: int, percent: int, buckets: int) -> DataFrame:
    """Signatures of the rows' classes by bucket: a row has many of one bucket, with runs of their classes (odd: signed as the larger band)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> pa.RecordBatch:
            member, sig = (np.concatenate(x) for x in zip(*held))
            held.clear()
            bucket = sig % np.uint64(buckets)
            order = np.lexsort((member, bucket))
            member, sig, bucket = member[order], sig[order], bucket[order]
            at = np.flatnonzero(np.diff(bucket, prepend=bucket[0] ^ np.uint64(1)))
            rows = []
            for lo, hi in zip(at.tolist(), [*at[1:].tolist(), len(sig)]):
                own = member[lo:hi]
                runs = np.flatnonzero(np.diff(own, prepend=own[0] ^ 1))
                rows.append((int(bucket[lo]), own[runs].tobytes(), np.diff(np.append(runs, hi - lo)).astype(np.uint32).tobytes(), sig[lo:hi].tobytes()))
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "members", "times", "signatures"])

        for batch in batches:
            for part, texts in slices(batch):
                classes = part.column("class").to_pylist()
                new = [i for i, c in enumerate(classes) if c not in seen and not seen.add(c)]
                if len(seen) > SEEN:
                    seen.clear()
                if not new:
                    continue
                sets = shingle_sets([texts[i] for i in new], words)
                owner, upper, sig = signed(sets, percent)
                if len(sig):
                    held.append((np.array([classes[i] for i in new], np.int64)[owner] + upper, sig))
                if sum(len(s) for _, s in held) >= PACKED:
                    yield flush()
        if held:
            yield flush()
        release()

    return text_batches(docs.select("class", "text")).mapInArrow(run, "bucket long, members binary, times binary, signatures binary")


def shared(packed: DataFrame, spread: int) -> DataFrame:
    """Groups of classes that share a signature, a row for each member: node (a hash of all members), doc_id (the class) and blocks.

    The same group under several signatures of a bucket is given once.  Groups without a set of the smaller band
    are those of another family too.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        given: set[int] = set()
        for t in whole_groups(batches, ["bucket"]):
            member = np.repeat(*(np.frombuffer(b"".join(t.column(c).to_pylist()), d) for c, d in (("members", np.int64), ("times", np.uint32))))
            sig = np.frombuffer(b"".join(t.column("signatures").to_pylist()), np.uint64)
            order = np.argsort(sig)
            member, sig = member[order], sig[order]
            same = sig[1:] == sig[:-1]
            often = np.append(same, False) | np.append(False, same)
            member, sig = member[often], sig[often]
            order = np.lexsort((member, sig))
            member, sig = member[order], sig[order]
            if not len(sig):
                continue
            once = np.append(True, (member[1:] != member[:-1]) | (sig[1:] != sig[:-1]))
            member, sig = member[once], sig[once]
            begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1]))
            size = np.diff(np.append(begin, len(sig)))
            lower = np.add.reduceat(member & 1 == 0, begin) > 0 if len(begin) else np.zeros(0, bool)
            node = mix64(np.add.reduceat(mix64((member & ~1).view(np.uint64)), begin) + size.astype(np.uint64))
            _, one = np.unique(node, return_index=True)
            good = np.zeros(len(begin), bool)
            good[one] = True
            # A group is known by its members; the same ones may come as sets of the smaller band under another signature.
            mixed = np.zeros(len(begin), bool)
            has = np.unique(node[lower & (size > 1)])
            mixed[np.isin(node, has)] = True
            good &= mixed & np.array([x not in given for x in node.tolist()], bool)
            given.update(node[good].tolist())
            if len(given) > SEEN:
                given.clear()
            rows = np.repeat(good, size)
            if rows.any():
                blocks = np.where(size > GROUP, -(-size // (GROUP // 2)), 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(node, size)[rows].view(np.int64)), pa.array(member[rows] & ~1), pa.array(np.repeat(blocks, size)[rows])], ["node", "doc_id", "blocks"])
        release()

    return packed.repartition(spread, "bucket").sortWithinPartitions("bucket").mapInArrow(run, "node long, doc_id long, blocks int")


def alike_links(rows: DataFrame, similarity: float, spread: int) -> DataFrame:
    """a and b, a forest of the pairs of each group (node, i, j) that are alike by size and sketch.

    One member is held against all others first; only with those that it isn't like are all pairs looked at.
    """
    expected = similarity + (1 - similarity) / 4
    least = int(np.floor(COORDINATES * (expected - SLACK * np.sqrt(expected * (1 - expected) / COORDINATES))))
    even = np.uint64(0x5555555555555555)

    def alike(s: np.ndarray, n: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        same = np.zeros(np.broadcast_shapes(x.shape, y.shape), np.uint8)
        for k in range(2):
            d = s[x, k] ^ s[y, k]
            same = same + np.bitwise_count(~(d | d >> np.uint64(1)) & even)
        return (same >= least) & (np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y]) - 1e-9)

    def forest(s: np.ndarray, n: np.ndarray, left: np.ndarray, right: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Labels joined by what is alike of left and right."""

        def join(x: np.ndarray, y: np.ndarray) -> None:
            nonlocal label
            x, y = label[x], label[y]
            apart = x != y
            if apart.any():
                label = spanning(len(label), x[apart], y[apart])[label]

        near_right = alike(s, n, left[:1], right)
        near_left = alike(s, n, right[:1], left)
        join(np.repeat(left[:1], int(near_right.sum())), right[near_right])
        join(left[near_left], np.repeat(right[:1], int(near_left.sum())))
        for some, others in ((right[~near_right], left), (left[~near_left], right)):
            for p in range(0, len(some), 256):
                x, y = np.nonzero(alike(s, n, some[p : p + 256, None], others[None, :]))
                join(some[p + x], others[y])
        return label

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in whole_groups(batches, ["node", "i", "j"]):
            node, i, j, ids, n, block = (t.column(c).to_numpy() for c in ("node", "i", "j", "doc_id", "n", "own"))
            s = np.stack([t.column(c).to_numpy().view(np.uint64) for c in ("s1", "s2")], axis=1)
            new = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])]))
            size = np.diff(np.append(new, len(node)))
            pairs = new[size == 2]
            pairs = pairs[alike(s, n, pairs, pairs + 1)]
            a, b = [pairs], [pairs + 1]
            for g in np.flatnonzero(size > 2).tolist():
                members = np.arange(new[g], new[g] + size[g])
                own = slice(new[g], new[g] + size[g])
                local = np.arange(size[g])
                left = local if i[members[0]] == j[members[0]] else local[block[members] == i[members[0]]]
                right = local if i[members[0]] == j[members[0]] else local[block[members] == j[members[0]]]
                if len(left) and len(right):
                    label = forest(s[own], n[own], left, right, local)
                    far = np.flatnonzero(label != local)
                    a.append(new[g] + far)
                    b.append(new[g] + label[far])
            x, y = np.concatenate(a), np.concatenate(b)
            edges = np.unique(np.stack([np.maximum(ids[x], ids[y]), np.minimum(ids[x], ids[y])], axis=1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(edges[:, 0])), pa.array(np.ascontiguousarray(edges[:, 1]))], ["a", "b"])

    return rows.repartition(spread, "node", "i", "j").sortWithinPartitions("node", "i", "j").mapInArrow(run, "a long, b long")


def join(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    spread = shuffle_partitions(docs.sparkSession)
    percent = round(100 * similarity)
    texts = with_class(docs)
    rows = cut(sketched(texts, words))
    sketches = rows.filter("n > 0").select(F.col("class").alias("doc_id"), "n", "s1", "s2").distinct()
    groups = shared(packed_signatures(texts, words, percent, BUCKETS * spread), spread)
    met = groups.join(sketches, "doc_id").distinct()
    own = F.pmod(F.xxhash64("doc_id"), F.col("blocks")).cast("int")
    dealt = met.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("node", "doc_id", "n", "s1", "s2", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    near = components(alike_links(dealt, similarity, spread))
    clusters = cut(near.withColumnRenamed("id", "doc_id").withColumnRenamed("component", "cluster"))
    blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int")
    giants = cut(clusters.join(sketches.select("doc_id", "n"), "doc_id").groupBy("cluster").agg(blocks.alias("blocks")).filter("blocks > 1"))
    links = exact_links(in_blocks(class_texts(texts, clusters), "cluster", giants if giants.take(1) else None), words, similarity, spread)
    return class_components(rows, links).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
