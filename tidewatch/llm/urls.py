"""URL filters by a bit-parallel wildcard automaton.

Glob rules are laid side by side in one long bit vector of several 64-bit words (Shift-And masks): a bit is the state
of one rule after one of its characters.  For each character of a canonical URL all states of all rules move at once,
by a shift over the words, the mask of the character, and the mask of the states that a wildcard holds.  URLs of a
batch run together, as the rows of an array.

``*`` stands for any characters and ``^`` for any characters but ``/``; a rule covers the whole URL.  The canonical URL
is ``.host/path`` with the host in lower case, so the rules of ``host_rule`` fit a host and all its subdomains.

A null URL, and one without ``://``, has an empty host and path and meets no rule; a URL that meets none gets the
default verdict.  Repeated rows are judged alike, a null page_id is kept, other columns are ignored, an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: host, path, verdict
Rule = tuple[str, str, str]


def host_rule(host: str, path: str) -> str:
    """The glob for a host with its subdomains and the beginning of a path."""
    return f"^.{host}{path}*"


def split_url(url: str | None) -> tuple[str, str]:
    """Host and path, both empty without ``://``."""
    _, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for sign in "?#":
        rest = rest.partition(sign)[0]
    host, slash, path = rest.partition("/")
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host), slash + path


class ShiftAnd:
    """All globs in one automaton over bytes."""

    def __init__(self, globs: list[str]):
        reads: list[int | None] = []  # the byte that leads into each state; none for the state before a rule's first
        holds: dict[str, list[int]] = {"*": [], "^": []}
        starts, self.ends = [], []
        for glob in globs:
            starts.append(len(reads))
            reads.append(None)
            for c in glob:
                if c in holds:
                    holds[c].append(len(reads) - 1)
                else:
                    reads += c.encode()
            self.ends.append(len(reads) - 1)
        self.words = max(1, -(-len(reads) // 64))
        self.start = self._mask(starts)
        self.reads = np.stack([self._mask([i for i, r in enumerate(reads) if r == byte]) for byte in range(256)])
        self.stays = np.stack([self._mask(holds["*"] + (holds["^"] if byte != ord("/") else [])) for byte in range(256)])

    def _mask(self, bits: list[int]) -> np.ndarray:
        out = np.zeros(self.words, np.uint64)
        for i in bits:
            out[i // 64] |= np.uint64(1 << i % 64)
        return out

    def matches(self, texts: list[bytes]) -> np.ndarray:
        """Texts by globs: which glob covers which whole text."""
        length = np.array([len(t) for t in texts])
        order = np.argsort(-length, kind="stable")
        state = np.tile(self.start, (len(texts), 1))
        offset = np.cumsum(length) - length
        data = np.frombuffer(b"".join(texts), np.uint8)
        active = len(texts)
        for i in range(int(length.max(initial=0))):
            active = int(np.searchsorted(-length[order[:active]], -i, "left"))  # those with more than i bytes
            rows = order[:active]
            byte, now = data[offset[rows] + i], state[rows]
            moved = now << np.uint64(1)
            moved[:, 1:] |= now[:, :-1] >> np.uint64(63)
            state[rows] = moved & self.reads[byte] | now & self.stays[byte]
        ends = np.array(self.ends, np.int64)
        return (state[:, ends // 64] >> (ends % 64).astype(np.uint64) & np.uint64(1)).astype(bool)


def judge(pages: DataFrame, rules: list[Rule], default: str = "allow") -> DataFrame:
    """page_id, host, path, the longest rule that fits (the first of those as long) and its verdict."""
    by_length = sorted(rules, key=lambda r: -len(r[0] + r[1]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = ShiftAnd([host_rule(host, path) for host, path, _ in by_length])
        names = [host + path for host, path, _ in by_length] + [None]
        verdicts = [verdict for *_, verdict in by_length] + [default]
        for batch in batches:
            parts = [split_url(u) for u in batch.column("url").to_pylist()]
            fits = automaton.matches([f".{host}{path}".encode() if host or path else b"" for host, path in parts])
            best = np.where(fits.any(axis=1), fits.argmax(axis=1), len(by_length)).tolist() if rules else [0] * len(parts)
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), pa.array([h for h, _ in parts], pa.string()), pa.array([p for _, p in parts], pa.string()), pa.array([names[i] for i in best], pa.string()), pa.array([verdicts[i] for i in best], pa.string())],
                ["page_id", "host", "path", "rule", "verdict"],
            )

    pages = pages.select("page_id", "url")
    return pages.mapInArrow(run, f"page_id {pages.schema['page_id'].dataType.simpleString()}, host string, path string, rule string, verdict string")
