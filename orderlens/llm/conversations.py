"""Conversation structure repair: the cheapest edits that make the roles read ``(s?(ua)+)?``, by a Viterbi search
whose decided edits leave memory as soon as they are decided.

Each state of the role pattern keeps one survivor: its cheapest path so far, of equally cheap ones the one whose
edit letters are ASCII-least. The paths share a tree of back pointers with reference counts: a path that loses frees
the nodes that only it held, and what all survivors have in common (the root's only child) is final and is given
out at once. Two paths that meet in a state with equal cost are compared over all their undecided letters. Neither
can be a prefix of the other: both have used the same rows, so the longer one would hold further insertions and
cost more; the first difference therefore decides, whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: ASCII white space, as the blank and truncated tests read it.
SPACE = " \t\n\x0b\x0c\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
NONE, BLANK, DUPLICATE, CUT = range(4)
#: States of the pattern: nothing yet, after ``s``, after ``u``, after ``a``; a conversation may end in the first and last.
START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ASSISTANT): USER, ("a", USER): ASSISTANT}
#: The role that an insertion or a new role must have in each state, and where it leads.
_FITS = {START: ("user", USER), SYSTEM: ("user", USER), ASSISTANT: ("user", USER), USER: ("assistant", ASSISTANT)}


class _Node:
    """One edit of the tree: its letter and the row it leaves behind (None: a deletion)."""

    __slots__ = ("parent", "letter", "row", "depth", "refs", "children")

    def __init__(self, parent: _Node | None, letter: str, row: tuple[str, str] | None):
        self.parent, self.letter, self.row = parent, letter, row
        self.depth = parent.depth + 1 if parent else 0
        self.refs, self.children = 0, set()
        if parent:
            parent.refs += 1
            parent.children.add(self)


def _release(node: _Node) -> None:
    """One holder less; nodes without a holder leave the tree, up to the first that others hold."""
    node.refs -= 1
    while node.refs == 0 and node.parent is not None:
        parent = node.parent
        parent.children.discard(node)
        node.parent = None
        parent.refs -= 1
        node = parent


def _first_difference(one: _Node, two: _Node, end: str = "", end_two: str = "") -> int:
    """-1, 0, 1: how the letters of two paths compare, each followed by an ending, from their last common node on."""
    x, y = [end], [end_two]
    while one is not two:
        if one.depth >= two.depth:
            x.append(one.letter)
            one = one.parent
        else:
            y.append(two.letter)
            two = two.parent
    a, b = "".join(reversed(x)), "".join(reversed(y))
    return (a > b) - (a < b)


class Repair:
    """The search over one conversation. ``give`` gets every final edit in order: its letter and the row it leaves."""

    def __init__(self, give):
        self.give, self.root = give, _Node(None, "", None)
        self.root.refs = 1
        self.live: dict[int, tuple[int, _Node]] = {START: (0, self.root)}

    @property
    def undecided(self) -> int:
        """Length of the longest undecided path."""
        return max(node.depth for _, node in self.live.values()) - self.root.depth

    def _keep_best(self, offers: dict[int, tuple], state: int, offer: tuple) -> None:
        """``offer``: (cost, parent node, letter, row); an empty letter is the parent itself."""
        held = offers.get(state)
        if held is None or offer[0] < held[0] or (offer[0] == held[0] and _first_difference(offer[1], held[1], offer[2], held[2]) < 0):
            offers[state] = offer

    def _settle(self, offers: dict[int, tuple]) -> None:
        before = [node for _, node in self.live.values()]
        self.live = {}
        for state, (cost, parent, letter, row) in offers.items():
            node = _Node(parent, letter, row) if letter else parent
            node.refs += 1
            self.live[state] = (cost, node)
        for node in before:
            _release(node)

    def _insert(self) -> None:
        """Insertions before the next row: at most one ``user`` and one ``assistant``, more lead back and only cost."""
        for target, role, sources in ((USER, "user", (START, SYSTEM, ASSISTANT)), (ASSISTANT, "assistant", (USER,))):
            offers = {state: (cost, node, "", None) for state, (cost, node) in self.live.items()}
            for state in sources:
                if state in self.live:
                    cost, node = self.live[state]
                    self._keep_best(offers, target, (cost + INSERT, node, "I", (role, "")))
            self._settle(offers)

    def row(self, role: str, text: str, fault: int) -> None:
        self._insert()
        offers: dict[int, tuple] = {}
        more = TRUNCATED if fault == CUT else 0
        for state, (cost, node) in self.live.items():
            self._keep_best(offers, state, (cost + DELETE, node, "D", None))
            if fault in (BLANK, DUPLICATE):
                continue
            to = _NEXT.get((role[:1], state))
            if to is not None:
                self._keep_best(offers, to, (cost + KEEP + more, node, "K", (role, text)))
            new, to = _FITS[state]
            self._keep_best(offers, to, (cost + REROLE + more, node, "R", (new, text)))
        # what the first two states can still do, the last one can do for 4 more at most (a kept system row deleted)
        # or for nothing more; a path that is dearer by more can neither win nor tie
        if ASSISTANT in offers:
            best = offers[ASSISTANT]
            if START in offers and offers[START][0] > best[0] + DELETE:
                del offers[START]
            if SYSTEM in offers and (offers[SYSTEM][0] > best[0] or offers[SYSTEM][0] == best[0]
                                     and _first_difference(best[1], offers[SYSTEM][1], best[2], offers[SYSTEM][2]) < 0):
                del offers[SYSTEM]
        self._settle(offers)
        self._give_common()

    def _give_common(self) -> None:
        held = {node for _, node in self.live.values()}
        while self.root not in held and len(self.root.children) == 1:
            child = next(iter(self.root.children))
            self.root.children.clear()
            child.parent = None
            self.root = child
            self.give(child.letter, child.row)

    def finish(self) -> int:
        """The cost of the cheapest repair; its remaining edits are given out."""
        self._insert()
        offers: dict[int, tuple] = {}
        for state in (START, ASSISTANT):
            if state in self.live:
                cost, node = self.live[state]
                self._keep_best(offers, 0, (cost, node, "", None))
        cost, node = offers[0][:2]
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            self.give(node.letter, node.row)
        return cost


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
           text_col: str = "text") -> DataFrame:
    """``conv_id, turn, role, text, copy, present`` after a damage drawn by crc32(``conv_id:turn``) % 20.

    0 drops the row (it stays here with ``present`` false, so that its conversation is not lost), 1 empties its text,
    2 removes ``[.!?]`` from it, 3 repeats the row (``copy`` 1), 4 sets its role to user. Nulls count as one space in
    the key, role and text; the turn stays null.
    """
    conv, turn = F.col(conv_col).cast("long"), F.col(turn_col).cast("long")
    space = F.lit(" ")
    key = F.concat(F.coalesce(conv.cast("string"), space), F.lit(":"), F.coalesce(turn.cast("string"), space))
    role, text = F.coalesce(F.col(role_col).cast("string"), space), F.coalesce(F.col(text_col).cast("string"), space)
    out = rows.select(conv.alias("conv_id"), turn.alias("turn"), role.alias("role"), text.alias("text"),
                      (F.crc32(key.cast("binary")) % 20).alias("draw"))
    return out.select(
        "conv_id", "turn", F.when(F.col("draw") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        (F.col("draw") != 0).alias("present"))


def _in_order(rows: DataFrame) -> DataFrame:
    """The rows with their first fault, each conversation in one partition and in order. One shuffle by ``conv_id``:
    the window over equal rows and the final order both sort inside its partitions, and spill."""
    same = Window.partitionBy("conv_id", "role", "text").orderBy(F.col("present").desc(), F.col("turn").asc_nulls_first(), "copy")
    said = F.rtrim(F.col("text"), F.lit(SPACE))
    fault = F.when(said == "", BLANK).when(F.col("nth") > 1, DUPLICATE).when(~F.right(said, F.lit(1)).isin(".", "!", "?"), CUT).otherwise(NONE)
    return rows.repartition("conv_id").withColumn("nth", F.row_number().over(same)).withColumn("fault", fault) \
        .select("conv_id", "turn", "role", "text", "fault", "present", "copy") \
        .sortWithinPartitions(F.col("conv_id"), F.col("turn").asc_nulls_first(), "role", "text", "copy") \
        .drop("copy")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """(conv_id, its present rows) one after the other; a conversation streams through and is never gathered."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("conv_id", "turn", "role", "text", "fault", "present")))

    from itertools import groupby
    for conv, group in groupby(rows(), key=lambda r: r[0]):
        yield conv, (r[1:5] for r in group if r[5])


class _Counts:
    """What is counted over the rows of one conversation as they pass."""

    def __init__(self):
        self.faults, self.illegal, self.turns = [0, 0, 0, 0], 0, 0
        self.first = self.last = self.role = None

    def add(self, turn: int | None, role: str, fault: int) -> None:
        self.faults[fault] += 1
        if self.role is not None and self.role + role[:1] not in ("su", "ua", "au"):
            self.illegal += 1
        self.role = role[:1]
        if turn is not None and turn != self.last:
            self.turns += 1
            self.first = turn if self.first is None else self.first
            self.last = turn

    @property
    def gaps(self) -> int:
        return 0 if self.first is None else self.last - self.first + 1 - self.turns


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
ROWS = "conv_id long, place long, edit string, role string, text string"


def repair_report(rows: DataFrame) -> DataFrame:
    """One row per conversation: ``conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256``.

    ``rows`` has ``conv_id, turn, role, text, copy, present`` (see ``damage``). A conversation's rows are taken by turn
    (nulls first), equal turns by role, text and copy; rows with ``present`` false only name their conversation. Each row's
    first fault counts: blank (white space alone), duplicate (role and text seen earlier), truncated (the last character
    that is not white space is none of ``.!?``). ``illegal`` counts neighbours whose role initials are not su, ua or au.
    ``audit`` holds the initials of the cheapest edits (Keep 0, Rerole 3, Delete 4, Insert 3, 3 more for a truncated row that
    is not deleted), of equally cheap ones the ASCII-least; ``repaired_sha256`` is taken of the repaired ``role:text`` lines.

    Conversations of any length stream through their task: only undecided edits, with their texts, are in memory. The
    digest and the audit of a conversation are sequential, so one conversation is one task's work. Rows without a
    conversation id form one conversation (id null); an empty role cannot be kept; repeated rows are duplicates; an empty
    table gives no rows; other columns are not read.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, group in _conversations(batches):
            counts, letters, digest, begun = _Counts(), [], hashlib.sha256(), False

            def give(letter, row):
                nonlocal begun
                letters.append(letter)
                if row is not None:
                    digest.update((("\n" if begun else "") + row[0] + ":" + row[1]).encode())
                    begun = True

            search = Repair(give)
            for turn, role, text, fault in group:
                counts.add(turn, role, fault)
                search.row(role, text, fault)
            cost = search.finish()
            out.append((conv, counts.gaps, *counts.faults[1:], counts.illegal, cost, "".join(letters), digest.hexdigest()))
            if len(out) >= 4096:
                yield _batch(out, _REPORT_SCHEMA)
                out = []
        if out:
            yield _batch(out, _REPORT_SCHEMA)

    return _in_order(rows).mapInArrow(run, REPORT)


def repaired_rows(rows: DataFrame) -> DataFrame:
    """The repaired conversations themselves: ``conv_id, place, edit, role, text``, one row per edit, ``place`` from 0; role
    and text are null where the edit deletes. Same input and rules as ``repair_report``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, group in _conversations(batches):
            place = 0

            def give(letter, row):
                nonlocal place
                out.append((conv, place, letter, *(row or (None, None))))
                place += 1

            search = Repair(give)
            for _, role, text, fault in group:
                search.row(role, text, fault)
                if len(out) >= 4096:
                    yield _batch(out, _ROWS_SCHEMA)
                    out.clear()
            search.finish()
        if out:
            yield _batch(out, _ROWS_SCHEMA)

    return _in_order(rows).mapInArrow(run, ROWS)


_KINDS = {"long": pa.int64(), "string": pa.string()}
_REPORT_SCHEMA, _ROWS_SCHEMA = (pa.schema([(name, _KINDS[kind]) for name, kind in (c.split() for c in text.split(", "))])
                                for text in (REPORT, ROWS))


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
