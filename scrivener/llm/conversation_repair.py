"""Conversation structure repair: the cheapest edits that give a conversation the turns of `(s?(ua)+)?`.

Each conversation is a path through a lattice whose nodes are (rows consumed, state of the grammar) and whose edges are
edits: Keep, Rerole, Delete a row, Insert an empty one. Dijkstra's search runs on it with the key (cost, audit), where
the audit is the edits' initials, and stops at the first popped node that has consumed all rows in an accepting state.
That node's key is the cheapest cost and, of its audits, the least in ASCII order. This holds as the cost of an audit is
fixed by its letters: of two audits of one node and one cost neither begins the other, so appending keeps their order.

A conversation is read as a stream in the order of its turns; nothing but a block of its rows (512, or 8 MB of text), up
to four audits and as many running hashes is held. Between blocks the search keeps the best key of each grammar state.
The hash and the audit of a conversation are one value each over all its rows, so a conversation is one task's work.

Rows sort by turn (nulls first), then role, then text; repeated rows are duplicates. A null conv_id is a conversation of
its own. Null roles and texts count as one space. A role that is empty, or whose initial isn't s, u or a, can't be kept.
An empty table gives no rows. Columns other than the four are not read.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scrivener.llm.shared import arrow_batches

#: Fixed by the contract: costs of edits, and characters that are blank or end a sentence.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
BLANK, STOPS = "\x20\x09\x0a\x0b\x0c\x0d", ".!?"

#: States of the grammar: nothing yet, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
ACCEPTING = (START, ASSISTANT)
NEXT = (USER, USER, ASSISTANT, USER)  # where an inserted or reroled row leads
NAMES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
KEPT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
BLOCK_ROWS, BLOCK_CHARS = 512, 8 << 20

Row = tuple[str, str, bool, bool]  # role, text, must be deleted, truncated
Labels = dict[int, tuple[int, str]]  # cost and audit per state


def cheapest(rows: list[Row], labels: Labels, last: bool) -> Labels:
    """Dijkstra's search from `labels`, over rows. Returns the keys at the end: of every state, or if the rows are the last,
    of the accepting state that is popped first."""
    heap = [(cost, audit, 0, state) for state, (cost, audit) in labels.items()]
    heapq.heapify(heap)
    done, found, n = set(), {}, len(rows)
    while heap:
        cost, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        if i == n:
            found[state] = cost, audit
            if last and state in ACCEPTING:
                return {state: found[state]}
            if len(found) == 4:
                break
        heapq.heappush(heap, (cost + INSERT, audit + "I", i, NEXT[state]))
        if i < n:
            role, _, delete, truncated = rows[i]
            heapq.heappush(heap, (cost + DELETE, audit + "D", i + 1, state))
            if not delete:
                more = TRUNCATED * truncated
                heapq.heappush(heap, (cost + REROLE + more, audit + "R", i + 1, NEXT[state]))
                if (kept := KEPT.get((state, role[:1]))) is not None:
                    heapq.heappush(heap, (cost + more, audit + "K", i + 1, kept))
    return found


def stand_ins(labels: Labels) -> dict[int, str]:
    """A short text per audit. Texts that go on from the stand-ins compare as those that go on from the audits: an audit
    that begins another one is followed there by inserts alone, all others differ before their ends."""
    order = sorted(labels, key=lambda s: labels[s][1])
    short, root = {}, None
    for rank, state in enumerate(order):
        audit = labels[state][1]
        if root is None or not audit.startswith(labels[root][1]):
            root, short[state] = state, str(rank)
        else:
            short[state] = short[root] + audit[len(labels[root][1]) :]
    return short


class Hash:
    """SHA-256 of the lines fed so far."""

    def __init__(self, state=None, empty: bool = True):
        self.state, self.empty = state or hashlib.sha256(), empty

    def fed(self, edits: str, state: int, rows: list[Row]) -> Hash:
        out, at = Hash(self.state.copy(), self.empty), 0
        for edit in edits:
            role, text = rows[at][:2] if edit != "I" else ("", "")
            at += edit != "I"
            if edit == "D":
                continue
            state = KEPT[state, role[:1]] if edit == "K" else NEXT[state]
            out.state.update((("" if out.empty else "\n") + f"{role if edit == 'K' else NAMES[state]}:{text}").encode())
            out.empty = False
        return out


class Repair:
    """The search over one conversation, fed row by row."""

    def __init__(self) -> None:
        self.labels: Labels = {START: (0, "")}
        self.hashes, self.rows, self.chars, self.begun = {START: Hash()}, [], 0, ""

    def add(self, row: Row) -> None:
        self.rows.append(row)
        self.chars += len(row[1])
        if len(self.rows) == BLOCK_ROWS or self.chars > BLOCK_CHARS:
            self.close(last=False)

    def close(self, last: bool) -> None:
        short = stand_ins(self.labels)
        source = {text: state for state, text in short.items()}
        ends = cheapest(self.rows, {s: (cost, short[s]) for s, (cost, _) in self.labels.items()}, last)
        labels, hashes = {}, {}
        for state, (cost, audit) in ends.items():
            # A source whose stand-in begins another's is the right one only for audits that don't go on from the other
            # one; both give the same audit and the same text, so any will do.
            text = next(t for t in source if audit.startswith(t))
            begin = source[text]
            labels[state] = cost, self.labels[begin][1] + audit[len(text) :]
            hashes[state] = self.hashes[begin].fed(audit[len(text) :], begin, self.rows)
        common = commonprefix([a for _, a in labels.values()])
        self.begun += common
        self.labels, self.hashes = {s: (c, a[len(common) :]) for s, (c, a) in labels.items()}, hashes
        self.rows, self.chars = [], 0

    def result(self) -> tuple[int, str, str]:
        """Cost, audit and hash."""
        self.close(last=True)
        ((state, (cost, audit)),) = self.labels.items()
        return cost, self.begun + audit, self.hashes[state].state.hexdigest()


def damaged(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `gone`: the rows as the contract damages them, by CRC-32 of conv_id and turn. Dropped
    rows stay, marked as gone and without text, so that no conversation is lost."""
    rows = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")))
    key = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    rows = rows.withColumn("kind", F.crc32(key.cast("binary")) % 20).withColumn("gone", F.col("kind") == 0)
    text = F.when(F.col("kind") <= 1, "").when(F.col("kind") == 2, F.translate("text", STOPS, "")).otherwise(F.col("text"))
    rows = rows.withColumn("text", text).withColumn("role", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")))
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def faults() -> tuple[Column, Column]:
    """Blank and, if it isn't, truncated."""
    end = F.rtrim(F.col("text"), F.lit(BLANK))
    return end == "", ~F.substring(end, -1, 1).isin(*STOPS)


NUMBERS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
SCHEMA = "conv_id long, " + ", ".join(f"{c} long" for c in NUMBERS) + ", audit string, repaired_sha256 string"


def repaired(rows: DataFrame) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text, and `gone`, true for rows that only name their conversation): its
    faults, and the cost, audit and hash of the cheapest repair."""
    arrow_batches(rows.sparkSession)
    blank, truncated = faults()
    # One shuffle: the window's and the sort's groups are parts of a conversation. A conversation's rows are sorted with
    # spilling, never held.
    spaces = [F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")]
    dealt = rows.select("conv_id", "turn", *spaces, "gone").repartition("conv_id")
    equal = F.row_number().over(Window.partitionBy("conv_id", "gone", "role", "text").orderBy(F.col("turn").asc_nulls_first()))
    marked = dealt.withColumn("equal", equal).withColumn("fault", F.when(blank, 1).when(F.col("equal") > 1, 2).when(truncated, 3).otherwise(0))
    ordered = marked.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text", "equal").select("conv_id", "turn", "role", "text", "gone", "fault")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, fold, ready = None, None, []
        for batch in batches:
            for conv, turn, role, text, gone, fault in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if fold is None or conv != current:
                    if fold is not None:
                        ready.append((current, *fold.result()))
                    current, fold = conv, Counted()
                if not gone:
                    fold.add(turn, role, text, fault)
            yield rows_out(ready)
            ready = []
        if fold is not None:
            yield rows_out([(current, *fold.result())])

    return ordered.mapInArrow(run, SCHEMA)


class Counted:
    """The counts of a conversation beside its repair, fed in order."""

    def __init__(self) -> None:
        self.repair, self.faults, self.illegal = Repair(), [0] * 4, 0
        self.first = self.turn = self.initial = None
        self.turns = 0

    def add(self, turn: int | None, role: str, text: str, fault: int) -> None:
        if turn is not None and (self.turns == 0 or turn != self.turn):
            self.first = turn if self.turns == 0 else self.first
            self.turn, self.turns = turn, self.turns + 1
        if self.initial is not None and self.initial + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.initial = role[:1]
        self.faults[fault] += 1
        self.repair.add((role, text, fault in (1, 2), fault == 3))

    def result(self) -> tuple:
        gaps = self.turn - self.first + 1 - self.turns if self.turns else 0
        return (gaps, *self.faults[1:], self.illegal, *self.repair.result())


def rows_out(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True)) or [()] * 9
    types = [pa.int64()] * 7 + [pa.string()] * 2
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], ["conv_id", *NUMBERS, "audit", "repaired_sha256"])
