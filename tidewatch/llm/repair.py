"""Repair of the structure of conversations: the cheapest edits that give role initials ``(s?(ua)+)?``.

A row becomes a symbol: what its role begins with (s, u, a or other) and its first fault.  Where a conversation is
cheapest to repair from depends on the symbols still to come alone, so conversations share their ends: the distinct
suffixes of all symbol strings are the nodes of a minimal acyclic automaton read from the end.  Strings are sorted
by their reverse over range partitions, so those with a common end are neighbours; a task keeps the nodes of the
present string on a stack, goes back to what the next one shares with it, and works out cost-to-go and the best
audit for each node and each state of the grammar once for all conversations that come through it.

A conversation of any length is cut into pieces of at most PIECE rows or PIECE_CHARS characters (or one row), and at
the borders of partitions.  The costs of going through a piece, four states to four, are summed up from the last piece to
the first; so each piece knows what the rest costs from each state, up to a constant.  These few values are part of its
node.  The pieces' audits are then followed from the first on.  Edits have a letter that says what comes next, so the
least letter on a cheapest way, taken from the front, gives the least audit.

Rows are in order of turn (nulls first), then role, text and copy.  Null values count as one space.  A row is a
duplicate if its role and text stand in an earlier row of its conversation.  Rows without conv_id are one
conversation.  A repaired text is hashed as it streams by, in order, and never held; the rows of one conversation
are therefore hashed by one task.  Numbers of gaps beyond 64 bits come as the largest one.  Other columns are ignored;
an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.common import cut, release, text_batches

#: Rows and characters of a piece of a conversation.
PIECE, PIECE_CHARS = 512, 250_000
KEEP, REROLE, DELETE, INSERT, CUT_OFF = 0, 2, 3, 2, 1
#: States of the grammar: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES, FAR = 4, 1 << 40
#: What an edited row of a role leads to, and the role that an inserted or renamed row has to have.
NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
MADE = {START: "user", SYSTEM: "user", USER: "assistant", ASSISTANT: "user"}
#: Cost-to-go behind the last row.
ENDED = (0, FAR, FAR, 0)
#: A symbol: capital letters for rows that are cut off, ``d`` for those that must go, ``x`` for other roles.
GONE = "d"

Options = list[tuple[int, str, int]]


def _insertions(options: Options) -> Options:
    """For each state the best of going on and of inserting rows first: cost, audit, state reached."""
    best = list(options)
    for _ in range(STATES):
        for s in range(STATES):
            cost, audit, out = best[NEXT[MADE[s][0], s]]
            best[s] = min(best[s], (cost + INSERT, "I" + audit, out))
    return best


def before(symbol: str, after: Options) -> Options:
    """Cost, audit and last state from each state in front of a row, from those behind it."""
    out = []
    kind, cut_off = symbol.lower(), CUT_OFF * symbol.isupper()
    for s in range(STATES):
        cost, audit, end = after[s]
        ways = [(cost + DELETE, "D" + audit, end)]
        if symbol != GONE:
            if (kind, s) in NEXT:
                cost, audit, end = after[NEXT[kind, s]]
                ways.append((cost + KEEP + cut_off, "K" + audit, end))
            cost, audit, end = after[NEXT[MADE[s][0], s]]
            ways.append((cost + REROLE + cut_off, "R" + audit, end))
        out.append(min(ways))
    return _insertions(out)


def behind(end: tuple[int, ...]) -> Options:
    """Behind the last row of a piece; rows are inserted there only at the end of the conversation, else in front of the next row."""
    options = [(cost, "", s) for s, cost in enumerate(end)]
    return _insertions(options) if end == ENDED else options


class Automaton:
    """The nodes of one string, from its end: what neighbours in the order of reversed strings share is kept."""

    def __init__(self, end: tuple[int, ...]):
        self.string, self.nodes, self.made = "", [behind(end)], 0

    def solve(self, backwards: str) -> Options:
        same = next((i for i, (a, b) in enumerate(zip(backwards, self.string)) if a != b), min(len(backwards), len(self.string)))
        del self.nodes[same + 1 :]
        for symbol in backwards[same:]:
            self.nodes.append(before(symbol, self.nodes[-1]))
            self.made += 1
        self.string = backwards
        return self.nodes[-1]


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conv_id, turn, role and text (not null), some of them damaged, and copy: 0, or 1 for what is repeated."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat_ws(":", spaced("conv_id"), spaced("turn")).cast("binary")) % 20
    rows = conversations.select("conv_id", "turn", spaced("role").alias("role"), spaced("text").alias("text"), kind.alias("kind")).filter("kind <> 0")
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("kind") == 4, "user").otherwise(F.col("role"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(copies).alias("copy"))


def _last_mark(text: Column) -> Column:
    """The last character that is no white space, if there is one."""
    return F.regexp_extract(text, r"([^\x20\x09-\x0D])[\x20\x09-\x0D]*\z", 1)


def with_faults(rows: DataFrame) -> DataFrame:
    """The rows with fault: blank, repeated (an earlier turn has the same role and text; within a turn such rows are neighbours) or cut off."""
    said = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = rows.withColumn("said", said)
    first = rows.groupBy("conv_id", "said").agg(F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first"), F.count("*").alias("times")).filter("times > 1")
    first = first.select(F.col("conv_id").alias("_conv"), F.col("said").alias("_said"), "first")
    met = rows.join(first, rows["conv_id"].eqNullSafe(first["_conv"]) & (rows["said"] == first["_said"]), "left")
    later = F.coalesce(F.struct(F.col("turn").isNotNull().alias("known"), "turn") > F.col("first"), F.lit(False))
    mark = _last_mark(F.col("text"))
    fault = F.when(mark == "", "blank").when(later, "duplicate").when(~mark.isin(".", "!", "?"), "truncated")
    return met.select("conv_id", "turn", "role", "text", "copy", fault.alias("fault"))


PIECE_ROW = "conv_id long, at long, symbols string, turns array<long>, roles array<string>, texts array<string>, blank long, duplicate long, truncated long"


def pieces(rows: DataFrame) -> DataFrame:
    """Pieces of conversations in order: a row has the symbols (from the last row to the first), turns, roles and texts of at most PIECE rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        done: list[tuple] = []
        size = chars = 0
        previous = None

        def close() -> None:
            nonlocal held, chars
            if held:
                symbols, turns, roles, texts, faults = zip(*((s, t, r, x, f) for _, _, s, t, r, x, f in held))
                done.append((held[0][0], held[0][1], "".join(reversed(symbols)), list(turns), list(roles), list(texts), faults.count("blank"), faults.count("duplicate"), faults.count("truncated")))
            held, chars = [], 0

        def flush() -> pa.RecordBatch:
            nonlocal done, size
            names = ["conv_id", "at", "symbols", "turns", "roles", "texts", "blank", "duplicate", "truncated"]
            types = [pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.string()), pa.list_(pa.string()), pa.int64(), pa.int64(), pa.int64()]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
            done, size = [], 0
            return out

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                for conv, at, turn, role, text, fault in zip(*(part.column(c).to_pylist() for c in ("conv_id", "at", "turn", "role", "text", "fault"))):
                    row = (conv, turn, role, text)
                    fault = "duplicate" if fault != "blank" and row == previous else fault
                    if held and (conv != held[0][0] or len(held) == PIECE or chars + len(text) > PIECE_CHARS):
                        close()
                    previous = row
                    kind = role[:1] if role[:1] in ("s", "u", "a") else "x"
                    symbol = GONE if fault in ("blank", "duplicate") else kind.upper() if fault == "truncated" else kind
                    held.append((conv, at, symbol, turn, role, text, fault))
                    chars += len(text)
                    size += len(text) + 64
                    if size > PIECE_CHARS * 4 and done:
                        yield flush()
        close()
        if done:
            yield flush()
        release()

    # Equal rows go to the same partition: a copy has its original before it.
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role")]
    dealt = rows.repartitionByRange(*order, F.substring("text", 1, 64)).sortWithinPartitions(*order, "text").withColumn("at", F.monotonically_increasing_id())
    return text_batches(dealt).mapInArrow(run, PIECE_ROW)


def costs(strings: DataFrame) -> DataFrame:
    """symbols and cost (16 numbers: from each state to each) of each distinct string of symbols."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ends = [Automaton(tuple(FAR * (s != t) for t in range(STATES))) for s in range(STATES)]
        for batch in batches:
            symbols = batch.column("symbols").to_pylist()
            solved = [[e.solve(x) for e in ends] for x in symbols]
            out = [[min(way[t][s][0], FAR) for s in range(STATES) for t in range(STATES)] for way in solved]
            yield pa.RecordBatch.from_arrays([pa.array(symbols, pa.string()), pa.array(out, pa.list_(pa.int64()))], ["symbols", "cost"])

    return strings.select("symbols").distinct().repartitionByRange("symbols").sortWithinPartitions("symbols").mapInArrow(run, "symbols string, cost array<long>")


def rests(parts: DataFrame, spread: int) -> DataFrame:
    """conv_id, at and rest of pieces (conv_id, at, cost): the cost-to-go from each state behind the piece, less the least of them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, now, known = None, ENDED, False
        for batch in batches:
            out = []
            for c, cost in zip(batch.column("conv_id").to_pylist(), batch.column("cost").to_pylist()):
                if not known or c != conv:
                    # Behind the last piece rows may still be inserted.
                    conv, now, known = c, ENDED, True
                out.append(list(now))
                reach = [x[0] for x in behind(now)]
                through = [min(cost[s * STATES + t] + reach[t] for t in range(STATES)) for s in range(STATES)]
                least = min(through)
                now = tuple(min(x - least, FAR) for x in through)
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("at"), pa.array(out, pa.list_(pa.int64()))], ["conv_id", "at", "rest"])

    order = [F.col("conv_id").asc_nulls_first(), F.col("at").desc()]
    return parts.repartition(spread, "conv_id").sortWithinPartitions(*order).select("conv_id", "at", "cost").mapInArrow(run, "conv_id long, at long, rest array<long>")


def audits(strings: DataFrame) -> DataFrame:
    """For each distinct rest and string of symbols: audit, cost and last state from each of the states in front."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, automaton = None, None
        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                part = batch.slice(start, 256)
                rows = list(zip(part.column("rest").to_pylist(), part.column("symbols").to_pylist()))
                audit, reached = [], []
                for r, x in rows:
                    if r != rest:
                        rest, automaton = r, Automaton(tuple(r))
                    solved = automaton.solve(x)
                    audit.append([a for _, a, _ in solved])
                    reached.append([s for _, _, s in solved])
                yield pa.RecordBatch.from_arrays(
                    [part.column("rest"), part.column("symbols"), pa.array(audit, pa.list_(pa.string())), pa.array(reached, pa.list_(pa.int64()))],
                    ["rest", "symbols", "audit", "reached"],
                )

    distinct = strings.select("rest", "symbols").distinct()
    return distinct.repartitionByRange("rest", "symbols").sortWithinPartitions("rest", "symbols").mapInArrow(run, "rest array<long>, symbols string, audit array<string>, reached array<long>")


@dataclass
class _Repaired:
    """What is known of a conversation after some of its pieces."""

    conv: int | None
    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    cost: int = 0
    state: int = START
    least: int | None = None
    most: int | None = None
    turns: int = 0
    initial: str | None = None
    audit: list[str] = field(default_factory=list)
    text: object = field(default_factory=hashlib.sha256)
    begun: bool = False

    def _write(self, role: str, text: str) -> None:
        self.text.update(f"{chr(10) if self.begun else ''}{role}:{text}".encode())
        self.begun = True
        self.state = NEXT[role[:1], self.state]

    def add(self, symbols: str, turns: list, roles: list[str], texts: list[str], audit: list[str]) -> None:
        letters = audit[self.state]
        self.audit.append(letters)
        at = 0
        for letter in letters:
            if letter == "I":
                self._write(MADE[self.state], "")
                self.cost += INSERT
                continue
            if letter == "D":
                self.cost += DELETE
            else:
                self._write(MADE[self.state] if letter == "R" else roles[at], texts[at])
                self.cost += REROLE * (letter == "R") + CUT_OFF * symbols[-1 - at].isupper()
            at += 1
        for turn in (t for t in turns if t is not None):
            self.turns += turn != self.most
            self.least = turn if self.least is None else self.least
            self.most = turn
        for role in roles:
            if self.initial is not None:
                self.illegal += self.initial + role[:1] not in ("su", "ua", "au")
            self.initial = role[:1]

    def row(self) -> tuple:
        gaps = 0 if self.most is None else min(self.most - self.least + 1 - self.turns, 2**63 - 1)
        return self.conv, gaps, self.blank, self.duplicate, self.truncated, self.illegal, self.cost, "".join(self.audit), self.text.hexdigest()


REPAIRED_ROW = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def followed(parts: DataFrame, spread: int) -> DataFrame:
    """A row for each conversation, from its pieces with their audits, read in order."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: _Repaired | None = None
        done: list[tuple] = []

        def flush() -> pa.RecordBatch:
            nonlocal done
            types = [pa.int64()] * 7 + [pa.string()] * 2
            names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), types)], names)
            done = []
            return out

        for batch in batches:
            for start in range(0, batch.num_rows, 64):
                part = batch.slice(start, 64)
                for conv, symbols, turns, roles, texts, blank, duplicate, truncated, audit in zip(*(part.column(c).to_pylist() for c in ("conv_id", "symbols", "turns", "roles", "texts", "blank", "duplicate", "truncated", "audit"))):
                    if now is None or now.conv != conv:
                        if now is not None:
                            done.append(now.row())
                        now = _Repaired(conv)
                    now.blank += blank
                    now.duplicate += duplicate
                    now.truncated += truncated
                    now.add(symbols, turns, roles, texts, audit)
                if len(done) >= 1_000:
                    yield flush()
        if now is not None:
            done.append(now.row())
            yield flush()
        release()

    dealt = parts.repartition(spread, "conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), "at")
    return text_batches(dealt).mapInArrow(run, REPAIRED_ROW)


def repaired(rows: DataFrame) -> DataFrame:
    """A row for each conversation among rows of conv_id, turn, role, text and copy (as ``damaged`` gives them)."""
    spread = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = cut(pieces(with_faults(rows)))
    ends = F.array(*(F.lit(x).cast("long") for x in ENDED))
    last = cuts.groupBy("conv_id").agg(F.count("*").alias("n")).filter("n > 1").select(F.col("conv_id").alias("_conv"))
    several = cuts.join(last, cuts["conv_id"].eqNullSafe(last["_conv"]), "left_semi").select("conv_id", "at", "symbols")
    several = cut(several)
    rest = rests(several.join(costs(several), "symbols"), spread).select(F.col("at").alias("_at"), "rest")
    placed = cuts.join(rest, cuts["at"] == rest["_at"], "left").withColumn("rest", F.coalesce("rest", ends)).drop("_at")
    placed = cut(placed)
    known = audits(placed).select(F.col("rest").alias("_rest"), F.col("symbols").alias("_symbols"), "audit")
    return followed(placed.join(known, (placed["rest"] == known["_rest"]) & (placed["symbols"] == known["_symbols"])), spread)


def repair(conversations: DataFrame) -> DataFrame:
    """Damage the conversations, find their faults and the cheapest repair: a row for each conv_id of the table, also for those of which no row is left."""
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    found = repaired(damaged(conversations.withColumn("conv_id", F.col("conv_id").cast("long")).withColumn("turn", F.col("turn").cast("long"))))
    found = found.withColumnRenamed("conv_id", "_conv")
    out = ids.join(found, ids["conv_id"].eqNullSafe(found["_conv"]), "left")
    numbers = [F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))
