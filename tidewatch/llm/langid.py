"""Language identification by bit-sliced Bloom filters of n-grams.

Training counts the n-grams (four bytes of lower-cased text, signs and digits as spaces) of each language.  A language
keeps the n-grams that make up at least ``min_share`` of all its n-grams each, which bounds how many it keeps to
1 / min_share, whatever other languages have.  All languages share the rows of one table: bit l of a row belongs to language l, and the rows of an n-gram, and-ed, give every language that has it.

For a text the bits are counted for each language.  The share of n-grams that hit is corrected for those that hit by
chance, of which the filling of the language's slice tells the rate.  The highest corrected share decides; ties go to
the language that sorts first.  ``score`` is its part of the sum of all languages' corrected shares.

A text that is null or without a letter is ``und`` with score 0.  A text with letters but no known n-gram gets the
language with most training documents, with score 0.  Repeated rows are predicted alike; other columns are ignored; an
empty table gives an empty table; without any training row all texts are ``und``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import mix64, slices, text_batches

UNKNOWN = "und"
HASHES = 3
_BYTES = np.arange(256, dtype=np.uint8)
_BYTES[:128] = [c if chr(c).isalpha() else 32 for c in range(128)]
_LETTER = regex.compile(r"\p{L}")


@dataclass
class Model:
    languages: list[str]
    fallback: str
    rows: np.ndarray  # masks of languages
    chance: np.ndarray  # for each language, how many of unknown n-grams hit


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """N-grams of all texts, and where each text's begin (one entry more than texts)."""
    encoded = [f" {t.lower()} ".encode() for t in texts]
    b = _BYTES[np.frombuffer(b"".join(encoded) + b"    ", np.uint8)]
    ends = np.cumsum([len(e) for e in encoded])
    b32 = b.astype(np.uint32)
    code = b32[:-3] | b32[1:-2] << np.uint32(8) | b32[2:-1] << np.uint32(16) | b32[3:] << np.uint32(24)
    inside = (b[1:-2] != 32) & (b[2:-1] != 32)  # which also leaves out those over the borders of texts
    at = np.flatnonzero(inside)
    return code[at], np.concatenate([[0], np.searchsorted(at, ends)])


def positions(code: np.ndarray, size: int) -> list[np.ndarray]:
    h = mix64(code.astype(np.uint64))
    return [(h >> np.uint64(20 * k)) & np.uint64(size - 1) for k in range(HASHES)]


def train(labelled: DataFrame, sample: int = 20_000, min_share: float = 2e-5) -> Model:
    """Fit on rows with text and lang; of each language on about ``sample`` documents, chosen by a hash of the text."""
    labelled = text_batches(labelled).select("text", "lang").filter("text IS NOT NULL AND lang IS NOT NULL")
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}
    if len(sizes) > 64:
        raise ValueError("a mask has 64 bits: at most 64 languages")
    languages = sorted(sizes)
    if not languages:
        return Model([], UNKNOWN, np.zeros(1, np.uint64), np.zeros(0))
    part = F.create_map(*[F.lit(x) for lang in languages for x in (lang, min(1.0, sample / sizes[lang]))])
    chosen = labelled.filter(F.pmod(F.xxhash64("text"), F.lit(1 << 20)) < part[F.col("lang")] * (1 << 20))

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def out(lang: str) -> pa.RecordBatch:
            code, n = held.pop(lang)
            return pa.RecordBatch.from_arrays([pa.array([lang] * len(code), pa.string()), pa.array(code.astype(np.int64)), pa.array(n)], ["lang", "gram", "n"])

        for batch in batches:
            for part, texts in slices(batch):
                of = part.column("lang").to_pylist()
                for lang in sorted(set(of)):
                    code, n = np.unique(grams([t for t, x in zip(texts, of) if x == lang])[0], return_counts=True)
                    if lang in held:
                        both, place = np.unique(np.concatenate([held[lang][0], code]), return_inverse=True)
                        sums = np.zeros(len(both), np.int64)
                        np.add.at(sums, place, np.concatenate([held[lang][1], n]))
                        code, n = both, sums
                    held[lang] = code, n.astype(np.int64)
                    if len(code) > 300_000:
                        yield out(lang)
        yield from (out(lang) for lang in sorted(held))

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    totals = counts.groupBy("lang").agg(F.sum("n").alias("total"))
    shares = counts.join(F.broadcast(totals), "lang").select("lang", "gram", (F.col("n") / F.col("total")).alias("share"))  # 64 rows at most
    kept = shares.filter(F.col("share") >= min_share).toPandas()  # at most 1 / min_share rows for each language
    size = 1 << max(10, int(16 * kept.groupby("lang").size().max() if len(kept) else 1).bit_length())
    rows = np.zeros(size, np.uint64)
    for bit, lang in enumerate(languages):
        for p in positions(kept.loc[kept["lang"] == lang, "gram"].to_numpy(np.uint32), size):
            rows[p] |= np.uint64(1 << bit)
    fill = np.array([np.mean(rows >> np.uint64(bit) & np.uint64(1)) for bit in range(len(languages))])
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if len(languages) <= 8 * np.dtype(k).itemsize)
    return Model(languages, min(languages, key=lambda x: (-sizes[x], x)), rows.astype(kind), fill**HASHES)


def predict_texts(model: Model, texts: list[str]) -> tuple[list[str], np.ndarray]:
    code, bounds = grams(texts)
    mask = np.full(len(code), -1, np.int64).astype(model.rows.dtype)
    for p in positions(code, len(model.rows)):
        mask &= model.rows[p]
    n = np.diff(bounds)
    share = np.zeros((len(texts), len(model.languages)))
    for bit in range(len(model.languages)):
        hits = np.concatenate([[0], np.cumsum(mask >> np.array(bit, mask.dtype) & np.array(1, mask.dtype), dtype=np.int64)])[bounds]
        share[:, bit] = np.maximum((np.diff(hits) / np.maximum(n, 1) - model.chance[bit]) / (1 - model.chance[bit]), 0)
    total = share.sum(axis=1)
    best = share.argmax(axis=1) if model.languages else np.zeros(len(texts), int)
    score = np.divide(share.max(axis=1, initial=0), total, out=np.zeros(len(texts)), where=total > 0)
    names = [(model.languages[b] if s > 0 else model.fallback) if _LETTER.search(t) else UNKNOWN for t, b, s in zip(texts, best.tolist(), total.tolist())]
    return names, np.where([x == UNKNOWN for x in names], 0.0, np.minimum(score, 1.0))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by min_share

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                names, score = predict_texts(shared.value, texts)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    docs = text_batches(docs).select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")


def accept(docs: DataFrame, model: Model) -> DataFrame:
    """The documents in a language, with the columns they had; ``lang`` becomes the predicted one, ``und`` goes."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # its size is bounded by min_share
    at = docs.columns.index("lang")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                names = pa.array(predict_texts(shared.value, texts)[0], part.schema.field(at).type)
                part = part.set_column(at, part.schema.field(at), names)
                yield part.filter(pa.compute.not_equal(names, UNKNOWN))

    return text_batches(docs).mapInArrow(run, docs.schema)


def held_out() -> Column:
    """Whether a document is kept from training: every third by the checksum of its id; never for a null id."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
