"""A Merkle manifest of a table of documents: a content-addressed graph of digests, and proofs read by descending in it.

A leaf is the digest of a row.  Within a language leaves ascend by doc_id; every eight consecutive nodes become the
node above them, until one is left, the language's subroot.  The subroots, by language, become the root in the same
way.  The manifest stores a record for each digest: the digests of its children.  Equal digests have equal children,
so a record is stored once, however often its content occurs.

A request names a leaf by its language and rank.  Its way down from the root is given by the digits of base eight of
its rank (and, above the subroots, of its language's rank).  Requests with a common beginning go down together as one
row, so the upper records are read once and not by every leaf; at each step the children that no digit selects are
collected, and the collected segments, reversed, are the proof from leaf to root.

Numbering is by range partitions and their sizes; a hot language is spread over many tasks.  A record has eight
children at most, so no group grows.  All of it is DataFrame work: no Python functions, and the driver learns only the
heights of the two trees and the root.

Fields that are null count as ``-``.  Rows without lang form the first language.  Rows without doc_id come first in
their language; rows with the same doc_id are ordered by their leaf, so equal rows are interchangeable.  An empty
table has no root and gives an empty table.  Other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, scratch

#: Children of a node, and the bits of a rank that choose one of them.
FAN, BITS = 8, 3


def digest(*parts: Column) -> Column:
    """32 bytes, half as many as the text of a digest has."""
    return F.unhex(F.sha2(F.concat(*parts), 256))


def told(digest: Column) -> Column:
    """A digest, or several behind each other, as text."""
    return F.lower(F.hex(digest))


def field(value: Column) -> Column:
    """``-`` if null, else the length in UTF-8 bytes, ``:`` and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(text: Column) -> Column:
    """Digest of a row of documents that has this text."""
    return digest(field(F.col("doc_id")), field(F.col("source")), field(F.col("lang")), field(F.col("n_chars")), field(text))


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Add rank (from 0) within the group, nulls first, and n, the group's size.

    Rows are sorted by range; what a group has in each partition is counted, and only those counts are summed up in
    order, one row for a partition and group.
    """
    placed = cut(df.repartitionByRange(F.col(group).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(group, *order).withColumn("_at", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_at", 33)))
    pieces = placed.groupBy(group, "_part").agg(F.min("_at").alias("_first"), F.count("*").alias("_size"))
    same = Window.partitionBy(group)
    pieces = pieces.select(F.col(group).alias("_group"), F.col("_part").alias("_piece"), "_first", (F.sum("_size").over(same.orderBy("_part")) - F.col("_size")).alias("_before"), F.sum("_size").over(same).alias("n"))
    out = placed.join(pieces, placed[group].eqNullSafe(pieces["_group"]) & (placed["_part"] == pieces["_piece"]))
    return out.withColumn("rank", F.col("_at") - F.col("_first") + F.col("_before")).drop("_at", "_part", "_group", "_piece", "_first", "_before")


def height(n: int) -> int:
    """Steps from so many nodes to one."""
    steps = 0
    while n > 1:
        n, steps = -(-n // FAN), steps + 1
    return steps


def fold(nodes: DataFrame, steps: int) -> list[DataFrame]:
    """Tables of (tree, rank, n, digest, children), one for each height from 1 on, over nodes (tree, rank, n, digest); n is the nodes of the tree at the row's height."""
    levels = []
    for _ in range(steps):
        members = F.sort_array(F.collect_list(F.struct("rank", "digest")))
        above = nodes.filter("n > 1").groupBy("tree", F.shiftright("rank", BITS).alias("up")).agg(members.alias("m"), F.max("n").alias("n"))
        above = above.select("tree", F.col("up").alias("rank"), F.ceil(F.col("n") / FAN).cast("long").alias("n"), F.col("m.digest").alias("children"))
        nodes = cut(above.select("tree", "rank", "n", digest(F.concat_ws("", F.transform("children", told))).alias("digest"), "children"))
        levels.append(nodes)
    return levels


@dataclass
class Manifest:
    """leaves: the rows with lang, rank, n and leaf; records: folder of (digest, children) by tree and height; subroots: lang, n and digest, ranked; tops and heights of the two trees."""

    leaves: DataFrame
    records: str
    subroots: DataFrame
    root: bytes | None
    leaf_height: int
    lang_height: int


def build(docs: DataFrame, *more: Column) -> Manifest:
    """The manifest of documents; ``more`` are columns to keep beside the leaves."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), leaf(F.col("text")).alias("leaf"), *more)
    leaves = cut(ranked(rows, "lang", "doc_id", "leaf"))
    most = leaves.agg(F.max("n")).first()[0]
    folder = scratch(spark, "merkle")
    if not most:
        return Manifest(leaves, folder, leaves.select("lang", "n", F.col("leaf").alias("digest"), F.lit(0).cast("long").alias("tree"), "rank"), None, 0, 0)
    lower = fold(leaves.select(F.col("lang").alias("tree"), "rank", "n", F.col("leaf").alias("digest")), height(most))
    tops = leaves.filter("n = 1").select("lang", F.col("leaf").alias("digest"), F.lit(0).alias("height"))
    for h, level in enumerate(lower, 1):
        tops = tops.unionByName(level.filter("n = 1").select(F.col("tree").alias("lang"), "digest", F.lit(h).alias("height")))
    subroots = cut(ranked(tops.withColumn("tree", F.lit(0).cast("long")), "tree", "lang"))
    langs = subroots.agg(F.max("n")).first()[0]
    upper = fold(subroots.select("tree", "rank", "n", "digest"), height(langs))
    for tree, levels in (("leaf", lower), ("lang", upper)):
        for h, level in enumerate(levels, 1):
            level.select("digest", "children").dropDuplicates(["digest"]).write.parquet(f"{folder}/tree={tree}/height={h}", compression="zstd")
    root = bytes((upper[-1] if upper else subroots).select("digest").first()[0])
    return Manifest(leaves, folder, subroots, root, height(most), height(langs))


SEGMENTS = "array<struct<left:binary,right:binary>>"


def _step(manifest: Manifest, now: DataFrame, tree: str, at: int, wanted: DataFrame) -> DataFrame:
    """From nodes (tree, rank, digest, path) of this height to the wanted ones (tree, rank and more) below them.

    A record is met by its digest; each wanted child then takes its digest out of the record by the last digit of its
    rank, and adds the children left and right of it to the path.  So a path is moved once for a record, never for each child.
    """
    records = manifest.leaves.sparkSession.read.parquet(f"{manifest.records}/tree={tree}/height={at}")
    met = now.join(records, "digest").select(F.col("tree").alias("_tree"), F.col("rank").alias("_above"), F.col("path").alias("_path"), "children")
    down = wanted.join(met, wanted["tree"].eqNullSafe(met["_tree"]) & (F.shiftright(wanted["rank"], BITS) == met["_above"]))
    digit = F.col("rank").bitwiseAND(FAN - 1).cast("int")
    together = lambda digests: F.aggregate(digests, F.lit(b""), lambda a, b: F.concat(a, b))
    segment = F.struct(together(F.slice("children", F.lit(1), digit)).alias("left"), together(F.slice("children", digit + 2, F.lit(FAN))).alias("right"))
    return down.select(*wanted.columns, F.get("children", digit).alias("digest"), F.concat("_path", F.array(segment)).alias("path"))


def prove(manifest: Manifest, requests: DataFrame) -> DataFrame:
    """Every request (lang, rank and more) with digest (its leaf, as found by the descent) and path: the segments (left, right) from its leaf up to the root."""
    spark = requests.sparkSession
    langs = requests.select(F.col("lang").alias("_lang")).distinct()
    tops = manifest.subroots
    chosen = cut(tops.join(langs, tops["lang"].eqNullSafe(F.col("_lang")), "left_semi").select("tree", "rank", "lang", "height"))
    root, empty = F.lit(manifest.root).alias("digest"), F.array().cast(SEGMENTS).alias("path")
    now = spark.range(1).select(F.lit(0).cast("long").alias("tree"), F.lit(0).cast("long").alias("rank"), root, empty)
    if not manifest.lang_height:
        now = chosen.select("*", root, empty)  # the only subroot is the root
    for at in range(manifest.lang_height, 0, -1):
        wanted = chosen if at == 1 else chosen.select("tree", F.shiftright("rank", BITS * (at - 1)).alias("rank")).distinct()
        now = _step(manifest, now, "lang", at, wanted)
    ways = cut(now.select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("rank"), "digest", "path", "height"))
    asked = requests.withColumnRenamed("lang", "tree")
    above = cut(asked.select("tree", F.shiftright("rank", BITS).alias("rank")).distinct())
    columns = ["tree", "rank", "digest", "path"]
    now = ways.filter(F.col("height") == manifest.leaf_height).select(columns)
    for at in range(manifest.leaf_height, 1, -1):
        wanted = above.select("tree", F.shiftright("rank", BITS * (at - 2)).alias("rank")).distinct()
        now = _step(manifest, now, "leaf", at, wanted).select(columns).unionByName(ways.filter(F.col("height") == at - 1).select(columns))
    alone = ways.filter("height = 0").select(F.col("tree").alias("_tree"), "digest", "path")
    found = asked.join(alone, asked["tree"].eqNullSafe(alone["_tree"])).drop("_tree")
    if manifest.leaf_height:
        found = _step(manifest, now, "leaf", 1, asked).unionByName(found)
    return found.withColumnRenamed("tree", "lang").withColumn("path", F.reverse("path"))


def folded(start: Column, path: str = "path") -> Column:
    """The root that a leaf and the segments of its path lead to."""
    return F.aggregate(path, told(start), lambda now, s: F.sha2(F.concat(told(s["left"]), now, told(s["right"])), 256))


def siblings(path: str = "path") -> Column:
    """All digests of a path, from the leaf up and left to right."""
    return F.concat_ws("", F.transform(path, lambda s: told(F.concat(s["left"], s["right"]))))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def proofs(docs: DataFrame) -> DataFrame:
    """Each row's leaf, subroot, root and proof, and the root that its leaf folds to; in rows where 3 divides crc32(doc_id) that leaf is made of the text in small letters."""
    tampered = F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0, leaf(lower_ascii(F.col("text"))))
    manifest = build(docs, tampered.alias("tampered"))
    tops = manifest.subroots.select(F.col("lang").alias("_lang"), F.col("digest").alias("subroot"))
    if manifest.root is None:
        found = manifest.leaves.withColumn("digest", F.col("leaf")).withColumn("path", F.array().cast(SEGMENTS))
    else:
        found = prove(manifest, manifest.leaves.select("doc_id", "lang", "rank", "tampered"))
    out = found.join(tops, found["lang"].eqNullSafe(tops["_lang"]))
    root = F.lit(manifest.root.hex() if manifest.root else None).cast("string")
    out = out.select("doc_id", told(F.col("digest")).alias("leaf"), told(F.col("subroot")).alias("subroot"), root.alias("root"), F.sha2(siblings(), 256).alias("proof_sha256"), folded(F.coalesce("tampered", "digest")).alias("folded_root"))
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))
