"""Splitting text as the byte-level BPE pattern does, over arrays of code points, and a cache of encoded pieces.

The pattern is that of ``public_tokenizers.PATTERN``: contractions, then letters, digits or other signs with at
most one space before them, then white space, of which the last character stays with what follows.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache
from itertools import chain

import numpy as np
import regex
import tiktoken

from tidewatch.llm.common import EXACT, SLICE_CHARS, ragged, span_hashes, span_words

SPACE, LETTER, DIGIT, OTHER, END = range(5)


def matched_by_tiktoken(pattern: str, text: str) -> str:
    """What of a text the pattern matches, by the version of Unicode that the tiktoken library was built with: it leaves out the rest."""
    single = {bytes((b,)): b for b in range(256)}
    encoding = tiktoken.Encoding("single bytes", pat_str=pattern, mergeable_ranks=single, special_tokens={})
    return encoding.decode(encoding.encode_ordinary(text))


def matched_by_regex(pattern: str, text: str) -> str:
    return "".join(regex.findall(pattern, text))


@cache
def char_classes(matched: Callable[[str, str], str] = matched_by_tiktoken) -> np.ndarray:
    """Class of every code point, by the library whose splitting is wanted."""
    out = np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (*range(0xD800), *range(0xE000, 0x110000))))
    for kind, pattern in ((LETTER, r"\p{L}"), (DIGIT, r"\p{N}"), (SPACE, r"\s")):
        out[np.frombuffer(matched(pattern, every).encode("utf-32-le"), "<u4")] = kind
    return out


def split(texts: list[str], matched: Callable[[str, str], str] = matched_by_tiktoken) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, str]:
    """Starts and ends of the pieces of all texts, the number of pieces of each text, the code points, and the joined text."""
    joined = "\x00".join(texts) + "\x00"
    cp = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), "<u4")
    kind = char_classes(matched)[cp]
    ends = np.cumsum([len(t) + 1 for t in texts]) - 1
    kind[ends] = END
    first = np.ones(len(cp), bool)
    first[1:] = kind[1:] != kind[:-1]
    first[ends] = True
    # The last white space before other characters: a space joins them, anything else stands alone.
    last = np.flatnonzero((kind[:-1] == SPACE) & (kind[1:] != SPACE) & (kind[1:] != END))
    first[last] = True
    first[last[cp[last] == 32] + 1] = False
    # Contractions, only where an apostrophe begins a piece.
    i = np.flatnonzero((cp[:-1] == 39) & first[:-1] & (kind[1:] == LETTER))
    if len(i):
        padded = np.concatenate([cp, np.zeros(3, cp.dtype)])
        a, b = padded[i + 1], padded[i + 2]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = ((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))
        for at, n in ((i[one], 2), (i[two], 3)):
            first[at + 1] = False
            after = at + n
            first[after[kind[after] == LETTER]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(cp))
    keep = kind[start] != END
    start, end = start[keep], end[keep]
    return start, end, np.diff(np.searchsorted(start, ends), prepend=0), cp, joined


_CUT = re.compile(r"(?<=\S)[ \n]")


def parts(text: str, most: int) -> Iterator[str]:
    """Cut a text into parts of about ``most`` characters, before white space behind other characters: a piece always begins there."""
    at = 0
    while len(text) - at > most and (m := _CUT.search(text, at + most)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


class PieceCache:
    """Ids of the pieces seen so far, found by a 64-bit hash in a sorted array and compared byte by byte.

    When it reaches its limit, the half that was seen most often stays.  Pieces over EXACT bytes, and those whose hash another piece has, are encoded without being kept.  An entry takes
    some 60 bytes, so the limit bounds a Python worker's memory.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = 800_000, matched: Callable[[str, str], str] = matched_by_tiktoken):
        self.encode, self.limit, self.matched = encode, limit, matched
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(0, np.uint64)
        self.entry = np.zeros(0, np.int32)
        self.words = np.zeros((EXACT // 8, 1 << 12), np.uint64)
        self.size = np.zeros(1 << 12, np.uint8)
        self.flat = np.zeros(1 << 14, np.int32)
        self.offset = np.zeros(1 << 12, np.int32)
        self.count = np.zeros(1 << 12, np.int32)
        self.hits = np.zeros(1 << 12, np.int32)
        self.used = 0

    def _shrink(self) -> None:
        """Keep the half with most hits, which count half as much from now on."""
        keep = np.sort(np.argpartition(-self.hits[self.entry], self.limit // 2)[: self.limit // 2])
        keys, old = self.keys[keep], self.entry[keep]
        words, size, hits, count = self.words[:, old], self.size[old], self.hits[old] // 2, self.count[old]
        flat = ragged(self.flat, self.offset[old], count)
        self.clear()
        self.keys, self.entry, self.used = keys, np.arange(len(keep), dtype=np.int32), len(flat)
        self.words, self.size, self.hits, self.count, self.offset, self.flat = words, size, hits, count, np.cumsum(count, dtype=np.int32) - count, flat

    def _put(self, n: int, encoded: list[list[int]]) -> None:
        """Ids as entries n, n + 1, ..."""
        m = len(encoded)
        count = np.fromiter(map(len, encoded), np.int32, m)
        total = int(count.sum())
        if self.used + total > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(total, len(self.flat) // 2), np.int32)])
        if n + m > len(self.offset):
            more = max(m, len(self.offset) // 2)
            self.offset, self.count, self.size, self.hits = (np.concatenate([x, np.zeros(more, x.dtype)]) for x in (self.offset, self.count, self.size, self.hits))
            self.words = np.concatenate([self.words, np.zeros((len(self.words), more), np.uint64)], axis=1)
        self.flat[self.used : self.used + total] = np.fromiter(chain.from_iterable(encoded), np.int32, total)
        self.offset[n : n + m] = self.used + np.cumsum(count) - count
        self.count[n : n + m] = count
        self.used += total

    def encode_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each has; long texts in parts."""
        whole = [[*parts(t, SLICE_CHARS)] for t in texts] if max(map(len, texts), default=0) > 2 * SLICE_CHARS else None
        if whole is None:
            return self._encode(texts)
        runs, counts = [], []
        for cut in whole:
            found = [self._encode([part])[0] for part in cut]
            runs += found
            counts.append(sum(map(len, found)))
        return np.concatenate(runs), np.array(counts, np.int64)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        nothing = np.zeros(0, np.int32), np.zeros(len(texts), np.int64)
        if not any(texts):
            return nothing
        start, end, pieces, cp, joined = split(texts, self.matched)
        if not len(start):
            return nothing
        if len(self.keys) > self.limit:
            self._shrink()
        data = np.frombuffer(joined.encode("utf-8", "surrogatepass"), np.uint8)
        if len(data) == len(cp):
            low, high = start, end
        else:
            place = np.concatenate([[0], np.cumsum(1 + (cp > 0x7F) + (cp > 0x7FF) + (cp > 0xFFFF))])
            low, high = place[start], place[end]
        size = high - low
        words = span_words(data, low, high)
        keys, first, inverse = np.unique(span_hashes(words, size), return_index=True, return_inverse=True)
        odd = (size > EXACT) | (size != size[first][inverse]) | (words != words[:, first][:, inverse]).any(axis=0)
        at = np.searchsorted(self.keys, keys)
        known = np.zeros(len(keys), bool)
        inside = at < len(self.keys)
        known[inside] = self.keys[at[inside]] == keys[inside]
        held = self.entry[at[known]]
        self.hits[held] += 1
        same = (self.size[held] == size[first[known]]) & (self.words[:, held] == words[:, first[known]]).all(axis=0)
        other = np.zeros(len(keys), bool)
        other[np.flatnonzero(known)[~same]] = True
        odd |= other[inverse]
        n = len(self.keys)
        new = np.flatnonzero(~known & ~odd[first])
        if len(new):
            own = first[new]
            self._put(n, self.encode([joined[a:b] for a, b in zip(start[own].tolist(), end[own].tolist())]))
            self.words[:, n : n + len(new)], self.size[n : n + len(new)] = words[:, own], size[own]
            where = np.searchsorted(self.keys, keys[new])
            self.keys = np.insert(self.keys, where, keys[new])
            self.entry = np.insert(self.entry, where, np.arange(n, n + len(new), dtype=np.int32))
            n += len(new)
        index = np.zeros(len(start), np.int64)
        if len(self.keys):
            index = self.entry[np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)][inverse].astype(np.int64)
        used = self.used
        if odd.any():
            own = np.flatnonzero(odd)
            numbers: dict[str, int] = {}
            index[own] = [n + numbers.setdefault(joined[a:b], len(numbers)) for a, b in zip(start[own].tolist(), end[own].tolist())]
            self._put(n, self.encode([*numbers]))
        count = self.count[index]
        ids = ragged(self.flat, self.offset[index], count)
        self.used = used  # what was encoded without being kept goes
        total = np.concatenate([[0], np.cumsum(count)])
        bounds = np.concatenate([[0], np.cumsum(pieces)])
        return ids, np.diff(total[bounds])
