"""Mixing sources to target weights in fixed-length blocks of words.

The words of a source, document after document, are packed into blocks of ``block`` words; a document lies in the
blocks that its place in the row covers.  How many slots of the mix each source fills follows from its target; the
slots are dealt to output shards by multinomial draws from what each source still has to fill.  A source's k-th slot
stands for the block with that index under a pseudorandom permutation, a new one for each pass over the source.  Slots
and blocks meet in a join by source and block index.

Only figures of sources and shards are held by the driver; slots, blocks and documents never are.  The order of
documents in a source comes from a hash of id and text, in buckets of few documents, and the buckets are summed up in
groups, so a source of any size is numbered by many tasks.

A null text has size 0 and is never taken; a null source is a source of its own, last in order; a source without words
has target 0.  Repeated rows count as often as they occur.  An empty table gives an empty table.  The same table gives
the same mix.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, mix64, shuffle_partitions, slices, store, text_batches, unused

WORD = r"[^\x20\x09-\x0D]+"
BLOCK, SHARDS, BUCKET_ROWS, RUN = 128, 256, 250, 20_000
#: Buckets that are summed up in one group.
GROUP = 1_000


def targets(sizes: Sequence[int], weights: Sequence[float], total: float, most: float = 2.0) -> list[float]:
    """Share ``total`` by weight; nobody gets over ``most`` times its size, and the excess goes to the others by weight."""
    out, open_ = [0.0] * len(sizes), [i for i, n in enumerate(sizes) if n]
    while open_:
        share = (total - sum(out)) / sum(weights[i] for i in open_)
        full = [i for i in open_ if share * weights[i] >= most * sizes[i]]
        if not full:
            for i in open_:
                out[i] = share * weights[i]
            break
        for i in full:
            out[i] = most * sizes[i]
        open_ = [i for i in open_ if i not in full]
    return out


def draw(slots: Sequence[int], shards: int, seed: int) -> list[tuple[int, int, int, int]]:
    """(shard, source, first slot, number of slots), one for each shard and source: multinomial counts, from what is left of each source."""
    rng = np.random.default_rng(seed)
    left = np.array(slots, np.int64)
    next_slot = np.zeros(len(left), np.int64)
    out = []
    for shard in range(shards):
        want = int(left.sum()) // (shards - shard)
        taken = np.zeros_like(left)
        while want > taken.sum():  # what goes beyond a source's rest is drawn again among the others
            rest = left - taken
            taken += np.minimum(rng.multinomial(want - int(taken.sum()), rest / rest.sum()), rest)
        out += [(shard, source, int(next_slot[source]), int(taken[source])) for source in np.flatnonzero(taken).tolist()]
        next_slot += taken
        left -= taken
    return out


def permute(index: np.ndarray, size: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Pseudorandom permutation of 0..size-1 for each key: four Feistel rounds, repeated until back in range."""
    half = np.uint64(1)
    bits = np.maximum((np.ceil(np.log2(np.maximum(size, 2))).astype(np.uint64) + half) // np.uint64(2), half)
    mask = (half << bits) - half
    out, todo = index.astype(np.uint64), np.arange(len(index))
    while len(todo):
        b, m, k = bits[todo], mask[todo], key[todo].astype(np.uint64)
        left, right = out[todo] >> b, out[todo] & m
        for turn in range(4):
            left, right = right, left ^ mix64(right + mix64(k + np.uint64(turn))) & m
        out[todo] = left << b | right
        todo = todo[out[todo] >= size[todo].astype(np.uint64)]
    return out.astype(np.int64)


def source_figures(sized: DataFrame, weights: Sequence[float], share: float) -> pd.DataFrame:
    """One row for each source, in order: source, rows, words, target and slots."""
    found = sized.groupBy("source").agg(F.count("*").alias("rows"), F.sum("size").alias("words")).collect()  # as many as sources
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    out = pd.DataFrame({"source": [r["source"] for r in found], "rows": [r["rows"] for r in found], "words": [r["words"] for r in found]}, index=range(len(found)))
    out["number"] = range(len(out))
    out["target"] = targets(out["words"].tolist(), [weights[i % len(weights)] for i in range(len(out))], share * float(out["words"].sum()))
    out["blocks"] = -(-out["words"] // BLOCK)
    passes = [int(t / n + 1e-9) if n else 0 for t, n in zip(out["target"], out["words"])]
    out["slots"] = [p * b + min(b, max(0, round((t - p * n) / BLOCK))) for p, b, t, n in zip(passes, out["blocks"], out["target"], out["words"])]
    return out


def numbered(docs: DataFrame, keep: Sequence[str]) -> DataFrame:
    """Stored once: a number of its own for every row (n), the columns to keep, source, size and a hash of the text."""
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    hashed = F.xxhash64("doc_id", "text")
    return store(docs.select(F.monotonically_increasing_id().alias("n"), *keep, F.col("doc_id").alias("id"), F.col("source").alias("its_source"), size.alias("size"), hashed.alias("hash")), "sized")


def place(rows: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5) -> tuple[DataFrame, pd.DataFrame]:
    """n, number (of the source), size and place (of the first word in its source's row); figures of sources."""
    spark = rows.sparkSession
    sized = rows.select("n", "id", "its_source", "size", "hash")
    figures = source_figures(sized.select(F.col("its_source").alias("source"), "size"), weights, share)
    numbers = spark.createDataFrame([(s, int(k)) for s, k in zip(figures["source"], figures["number"])], "source string, number int")
    sized = sized.join(numbers, F.col("its_source").eqNullSafe(F.col("source"))).drop("source", "its_source")  # broadcast as far as Spark's limit goes
    buckets = max(1, int(figures["rows"].max() if len(figures) else 0) // BUCKET_ROWS)
    sized = sized.withColumn("bucket", F.pmod("hash", F.lit(buckets)))
    sums = cut(sized.groupBy("number", "bucket").agg(F.sum("size").alias("words")).withColumn("group", F.floor(F.col("bucket") / GROUP)))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    groups = sums.groupBy("number", "group").agg(F.sum("words").alias("words"))
    groups = groups.select("number", "group", F.coalesce(F.sum("words").over(before("number", "group")), F.lit(0)).alias("start"))
    inner = sums.select("number", "group", "bucket", F.coalesce(F.sum("words").over(before("number", "group", "bucket")), F.lit(0)).alias("inner"))
    starts = cut(inner.join(groups, ["number", "group"]).select("number", "bucket", (F.col("start") + F.col("inner")).alias("base")))
    inside = Window.partitionBy("number", "bucket").orderBy("hash", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    sized = sized.withColumn("within", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = sized.join(starts, ["number", "bucket"])
    return placed.select("n", "number", "size", (F.col("base") + F.col("within")).alias("place")), figures


def drawn_blocks(spark: SparkSession, figures: pd.DataFrame, seed: int = 1) -> DataFrame:
    """number, block and draws: how many slots of the mix each drawn block fills."""
    sizes = dict(zip(figures["number"], figures["blocks"]))
    rows = [(shard, number, first, n, int(sizes[number])) for shard, number, first, n in draw(figures["slots"].tolist(), SHARDS, seed)]
    dealt = spark.createDataFrame(rows, "shard int, number int, first long, n long, blocks long")
    # Runs of slots are made and dealt to tasks before single slots are.
    runs = dealt.select("number", "blocks", (F.col("first") + F.col("n")).alias("end"), F.explode(F.sequence("first", F.col("first") + F.col("n") - 1, F.lit(RUN).cast("long"))).alias("run"))
    runs = runs.repartition(shuffle_partitions(spark))
    slots = runs.select("number", "blocks", F.explode(F.sequence("run", F.least(F.col("run") + RUN, "end") - 1)).alias("slot"))

    @F.pandas_udf("long")
    def block_of(number: pd.Series, slot: pd.Series, blocks: pd.Series) -> pd.Series:
        n, size = slot.to_numpy(), blocks.to_numpy()
        key = mix64(np.uint64(seed) + mix64(number.to_numpy().astype(np.uint64) << np.uint64(32) | (n // size).astype(np.uint64)))
        return pd.Series(permute(n % size, size, key))

    return slots.select("number", block_of("number", "slot", "blocks").alias("block")).groupBy("number", "block").agg(F.count("*").alias("draws"))


def pieces(placed: DataFrame, figures: pd.DataFrame, seed: int = 1) -> DataFrame:
    """A row for each document (n, size) and block it lies in: from_word, to_word (in the document) and draws."""
    first, last = F.floor(F.col("place") / BLOCK), F.floor((F.col("place") + F.col("size") - 1) / BLOCK)
    parts = placed.filter("size > 0").withColumn("block", F.explode(F.sequence(first, last)))
    parts = parts.withColumn("from_word", F.greatest(F.col("block") * BLOCK - F.col("place"), F.lit(0)))
    parts = parts.withColumn("to_word", F.least((F.col("block") + 1) * BLOCK - F.col("place"), F.col("size")))
    drawn = drawn_blocks(placed.sparkSession, figures, seed)
    # The planner takes what explode() makes of a few rows for small; as many rows as blocks must not be broadcast.
    joined = parts.join(drawn.hint("merge"), ["number", "block"], "left")
    return joined.select("n", "number", "size", "from_word", "to_word", F.coalesce("draws", F.lit(0)).alias("draws"))


def taken_words(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, seed: int = 1) -> DataFrame:
    """doc_id, size, source_size, target (both of its source) and taken, the words that the mix takes of the document."""
    rows = numbered(docs, ["doc_id"])
    placed, figures = place(rows, weights, share)
    of_source = docs.sparkSession.createDataFrame([(s, int(w), float(t)) for s, w, t in zip(figures["source"], figures["words"], figures["target"])], "source string, source_size long, target double")
    taken = pieces(placed, figures, seed).groupBy("n").agg(F.sum((F.col("to_word") - F.col("from_word")) * F.col("draws")).alias("taken"))
    out = rows.join(taken, "n", "left").join(of_source, F.col("its_source").eqNullSafe(F.col("source")))
    return out.select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, seed: int = 1) -> DataFrame:
    """The mixed documents, with the columns they had: the words that were drawn of each text, once for each pass."""
    names = text_batches(docs).columns
    rows = numbered(docs, [F.struct(*names).alias("row")])
    placed, figures = place(rows, weights, share)
    copies = pieces(placed, figures, seed).filter("draws > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("draws").cast("int"))))
    taken = copies.groupBy("n", "copy").agg(F.sort_array(F.collect_list(F.struct("from_word", "to_word"))).alias("parts"))
    # Texts meet a hash table of narrow rows, so they needn't be sorted.
    joined = rows.select("n", "row").join(taken.hint("shuffle_hash"), "n")
    schema, drawn_parts = docs.schema, unused("drawn_parts", names)

    def cut_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                lists = part.column(drawn_parts).to_pylist()
                own = [join_words(t, [(p["from_word"], p["to_word"]) for p in ps]) for t, ps in zip(texts, lists)]
                new = {"text": own, "n_chars": [len(t) for t in own]}
                columns = [pa.array(new[n], part.schema.field(n).type) if n in new else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays(columns, names)

    return joined.select(*(F.col("row")[n].alias(n) for n in names), F.col("parts").alias(drawn_parts)).mapInArrow(cut_words, schema)


def join_words(text: str, parts: list[tuple[int, int]]) -> str:
    """The text from the first to the last word of each part, parts that follow each other as one; a line feed between others."""
    spans = [m.span() for m in re.finditer(WORD, text)]
    runs: list[list[int]] = []
    for a, b in parts:
        if runs and runs[-1][1] == a:
            runs[-1][1] = b
        else:
            runs.append([a, b])
    return "\n".join(text[spans[a][0] : spans[b - 1][1]] for a, b in runs)
