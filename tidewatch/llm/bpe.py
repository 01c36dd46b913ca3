"""Byte-level BPE as a lazily determinised transducer, and streaming decoding.

The merges are never run over a whole piece.  A state is what the transducer remembers after some bytes of a piece:
the last token that is settled, the bytes behind it, and for each boundary in them at which a longer token may still
begin, the token that ends there.  Reading a byte finds the one token that can end at the new boundary next to its
predecessor, and settles every token that all boundaries still open have in common; the lookahead is thus bounded by
the longest token.  States and transitions are made when first needed and kept (up to a limit) for the next piece.

``encode`` and ``decode`` give rows: a null text is empty, empty texts have no ids, repeated rows are encoded alike,
a null ``doc_id`` is kept as it is, other columns are ignored, and an empty table gives an empty table.
"""

from __future__ import annotations

import base64
import gc
import hashlib
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewatch.llm.common import ragged, slices, text_batches
from tidewatch.llm.pretokens import PieceCache


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a file with a base64 token and its rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Transducer:
    """Tokens are their ranks; a text from a boundary on is the node of the tokens' trie that it leads to, 0 being the root."""

    def __init__(self, ranks: dict[bytes, int], limit: int = 150_000):
        self.ranks, self.limit = ranks, limit
        self.tokens = {i: t for t, i in ranks.items()}
        # Of each node: its children by node << 8 | byte, its token or -1, and whether longer tokens begin with it.
        self.children: dict[int, int] = {}
        self.token, self.longer = [-1], [True]
        for t, i in ranks.items():
            node = 0
            for byte in t:
                self.longer[node] = True
                key = node << 8 | byte
                if (node := self.children.get(key, -1)) < 0:
                    node = self.children[key] = len(self.token)
                    self.token.append(-1)
                    self.longer.append(False)
            self.token[node] = i
        self.profiles: dict[int, tuple | None] = {}
        #: By two tokens, whether the second can come after the first.
        self.fits: dict[int, bool] = {}
        self._reset()

    def _reset(self) -> None:
        # A state: nodes of the open boundaries, and for each the last settled token (-1 at first) and those from there to it.
        # The path to the end of what was read is the last one; it tells states apart, as its tokens spell the bytes.
        self.states: list[tuple[tuple[int, ...], tuple[tuple[int, ...], ...]]] = [((0,), ((-1,),))]
        self.numbers: dict[tuple[int, ...], int] = {}
        #: By state << 8 | byte the next state; its complement, if tokens are settled on the way.
        self.moves: dict[int, int] = {}
        self.emitted: dict[int, tuple[int, ...]] = {}

    def _profile(self, token: int) -> tuple[list[tuple[bytes, int]], list[tuple[bytes, int]]] | None:
        """The part at the right end and at the left end while the token's own merges run, each with the rank that ends it.

        None if the merges don't give the token.
        """
        if token in self.profiles:
            return self.profiles[token]
        get, never, self.profiles[token] = self.ranks.get, 1 << 60, None
        text = self.tokens[token]
        parts, right, left, now = [text[i : i + 1] for i in range(len(text))], [], [], -1
        while len(parts) > 1:
            pairs = [get(x + y, never) for x, y in zip(parts, parts[1:])]
            rank = min(pairs)
            if rank == never:
                return None
            i, now = pairs.index(rank), max(now, rank)
            if i == len(parts) - 2:
                right.append((parts[-1], now))
            if i == 0:
                left.append((parts[0], now))
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        out = self.profiles[token] = (*right, (text, never)), (*left, (text, never))
        return out

    def _fit(self, a: int, b: int) -> bool:
        """Whether b can come after a (-1: at the beginning): the merges of both side by side keep them apart, at no time is a pair across their border next."""
        if (second := self._profile(b)) is None:
            return False
        if a < 0:
            return True
        right, left, i, j = self._profile(a)[0], second[1], 0, 0
        while True:
            x, until_x = right[i]
            y, until_y = left[j]
            rank = self.ranks.get(x + y)
            if rank is not None and rank < until_x and rank <= until_y:
                return False
            if until_x <= until_y:
                i += 1
                if i == len(right):
                    return True
            else:
                j += 1

    def _move(self, state: int, byte: int) -> int:
        nodes, paths = self.states[state]
        children, tokens, longer, fits = self.children, self.token, self.longer, self.fits
        path, still, befores = None, [], []
        for node, before in zip(nodes, paths):  # boundaries in ascending order, so that the longest token comes first
            if (node := children.get(node << 8 | byte)) is None:
                continue
            if path is None and (token := tokens[node]) >= 0:
                pair = before[-1] << 32 | token
                if (fit := fits.get(pair)) is None:
                    if len(fits) >= 2 * self.limit:
                        fits.clear()
                    fit = fits[pair] = self._fit(before[-1], token)
                if fit:
                    path = (*before, token)
            if longer[node]:
                still.append(node)
                befores.append(before)
        if path is None:
            raise ValueError("the ranks lack a single byte or contradict each other")
        common = len(path)
        for other in befores:  # the earliest boundary has the shortest path, so this mostly ends at once
            if common == 1:
                break
            most, common = min(common, len(other)), 1
            while common < most and path[common] == other[common]:
                common += 1
        still.append(0)
        befores.append(path)
        key = state << 8 | byte
        if common > 1:
            self.emitted[key] = path[1:common]
            befores = [p[common - 1 :] for p in befores]
            path = befores[-1]
        if (number := self.numbers.get(path)) is None:
            number = self.numbers[path] = len(self.states)
            self.states.append((tuple(still), tuple(befores)))
        if common > 1:
            number = ~number
        self.moves[key] = number
        return number

    def encode_piece(self, piece: bytes) -> list[int]:
        if (whole := self.ranks.get(piece)) is not None:
            return [whole]
        if len(self.moves) > self.limit:
            self._reset()
        state, out, moves, limit = 0, [], self.moves, self.limit
        for byte in piece:
            key = state << 8 | byte
            if (move := moves.get(key)) is None:
                if len(moves) > limit:  # in a long piece: on from the present state alone
                    present = self.states[state]
                    self._reset()
                    state, moves = len(self.states), self.moves
                    self.states.append(present)
                    self.numbers[present[1][-1]] = state
                    key = state << 8 | byte
                move = self._move(state, byte)
            if move < 0:
                out += self.emitted[key]
                state = ~move
            else:
                state = move
        out += self.states[state][1][-1][1:]
        return out

    def encode_pieces(self, pieces: list[str]) -> list[list[int]]:
        # States and ids hold no cycles, yet the collector would go through all that are kept again and again.
        running = gc.isenabled()
        gc.disable()
        try:
            return [self.encode_piece(p.encode("utf-8", "surrogatepass")) for p in pieces]
        finally:
            if running:
                gc.enable()


class Utf8Stream:
    """Incremental UTF-8: feed bytes in any portions, get the characters that are complete; a wrong byte gives U+FFFD."""

    def __init__(self) -> None:
        self.pending = b""

    def feed(self, portion: bytes, last: bool = False) -> str:
        data = self.pending + portion
        keep = 0
        if not last:
            for back in range(1, min(4, len(data) + 1)):  # the lead byte of a character that is not complete
                b = data[-back]
                if b >= 0xC0:
                    keep = back if back < (2 if b < 0xE0 else 3 if b < 0xF0 else 4) else 0
                    break
                if b < 0x80:
                    break
        self.pending = data[len(data) - keep :]
        return data[: len(data) - keep].decode("utf-8", "replace")


class Vocabulary:
    """Bytes of every id, laid out for gathering."""

    def __init__(self, ranks: dict[bytes, int]):
        size = max(ranks.values()) + 1
        self.count = np.zeros(size, np.int64)
        tokens = [b""] * size
        for t, i in ranks.items():
            tokens[i] = t
            self.count[i] = len(t)
        self.offset = np.cumsum(self.count) - self.count
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)
        self.decimal = np.array([str(i) for i in range(size)], object)

    def decode(self, ids: np.ndarray) -> bytes:
        return ragged(self.flat, self.offset[ids], self.count[ids]).tobytes()


@cache
def codec(path: str) -> tuple[PieceCache, Vocabulary]:
    """One for each Python worker and file."""
    ranks = read_ranks(path)
    return PieceCache(Transducer(ranks).encode_pieces), Vocabulary(ranks)


#: Ids that are turned into text at once.
PORTION = 65_536


def decode_stream(vocabulary: Vocabulary, ids: np.ndarray, portion: int = PORTION) -> Iterator[str]:
    """Text of the ids, portion by portion of ids."""
    stream = Utf8Stream()
    for i in range(0, len(ids), portion):
        yield stream.feed(vocabulary.decode(ids[i : i + portion]))
    yield stream.feed(b"", last=True)


def encode(docs: DataFrame, path: str) -> DataFrame:
    """doc_id and ids (array of int) of every text, by the rank file at ``path``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached, _ = codec(path)
        for batch in batches:
            for part, texts in slices(batch):
                ids, count = cached.encode_texts(texts)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]), pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), lists], ["doc_id", "ids"])

    docs = text_batches(docs).select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids; bytes that are not UTF-8 give U+FFFD."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, vocabulary = codec(path)
        for batch in batches:
            lists = batch.column("ids")
            texts = ["".join(decode_stream(vocabulary, x.values.to_numpy(zero_copy_only=False).astype(np.int64) if x.is_valid else np.zeros(0, np.int64))) for x in lists]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    encoded = text_batches(encoded).select("doc_id", "ids")
    return encoded.mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def round_trip(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: what ``encode`` and ``decode`` give, as digests, in one pass; ids if asked for."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached, vocabulary = codec(path)
        for batch in batches:
            for part, texts in slices(batch):
                ids, count = cached.encode_texts(texts)
                bounds = np.concatenate([[0], np.cumsum(count)]).tolist()
                names, digests = [], []
                for a, b in zip(bounds, bounds[1:]):
                    name, sha = hashlib.sha256(), hashlib.sha256()
                    for c in range(a, b, PORTION):
                        name.update(b"," * (c > a) + ",".join(vocabulary.decimal[ids[c : min(c + PORTION, b)]].tolist()).encode())
                    for text in decode_stream(vocabulary, ids[a:b]):
                        sha.update(text.encode())
                    names.append(name.hexdigest())
                    digests.append(sha.hexdigest())
                columns = [part.column("doc_id"), pa.array(count, pa.int64()), pa.array(names), pa.array(digests)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32())))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"][: len(columns)])

    docs = text_batches(docs).select("doc_id", "text")
    return docs.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)
