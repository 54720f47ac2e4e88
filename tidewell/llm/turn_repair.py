"""Cheapest edits that make a conversation's turns follow each other: one system turn at most, then user and assistant in turn.

A turn's first fault counts: blank (nothing but white space), duplicate (role and text were there before), truncated (the last
character that is no white space isn't one of ``.!?``). Keep costs nothing, Rerole (to user or assistant) 3, Delete 4, Insert (an
empty user or assistant turn) 3; a truncated turn that stays costs 3 more; blank and duplicate turns have to go. Of the
cheapest ways, the one goes whose edits' initials come first as ASCII text.

Rank-compressed dynamic programme. A layer follows each turn and has four states by what has been given out last: nothing, system,
user, assistant. A step between layers is a macro edit: a run of inserts and what becomes of the turn, K, R or D. Macro
edits are a prefix-free code (only their last letter isn't I), so texts of equally many of them compare by the first that
differs: by the rank of what stands before it in its layer, then by the code itself. A layer therefore holds four costs and
four ranks, no texts, and a step one number, the pointers of its states to their parents. Runs of three inserts come back
to a state, so none is longer than two. Steps depend on the turn's kind and on the layer's differences alone, so each one is
worked out once for a worker. The edits are read back from the pointers.

Plan. A first pass deals out turns without their texts (initial, flags, a digest) by conversation, in order, and streams them: it holds two
bytes a turn for the pointers, and a digest for each different turn. Its report, edits included, is then put before the conversation's
turns in a second pass, which streams texts and gives out the repaired turns in order. No conversation is held whole.
A conversation's turns do go through one task, one after the other: their edits and their digest are sequential.

Defined results: a null role or text counts as one space; null turns come first, and turns of the same number are in order of role and
digest of the text; rows with a null conversation are one conversation; roles count by their first letter; rows that aren't
``there`` only make their conversation known; one without turns has an empty audit and no repaired turn; very long texts stream
row by row; repeated rows are duplicates; other columns are left out; an empty table gives no row.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..cluster import partitions
from .common import free_memory

NOTHING, SYSTEM, USER, ASSISTANT = range(4)
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
SPACES = " \t\n\x0b\x0c\r"
#: What may follow each state, by the initial of its role.
FOLLOWS = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
#: The inserts that end a conversation from each state.
ENDINGS = ("", "II", "I", "")
COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
REPORT = StructType([StructField(c, LongType()) for c in COUNTS] + [StructField("audit", StringType())])


def _inserted(state: int) -> int:
    return ASSISTANT if state == USER else USER


@lru_cache(maxsize=16)
def moves(initial: str, must_go: bool, truncated: bool) -> tuple[tuple[int, int, int, str], ...]:
    """(parent state, next state, cost, code) of a turn's macro edits, the best for each pair of states."""
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for parent in range(4):
        state, run = parent, ""
        while len(run) <= 2:
            options = [(state, DELETE, "D")]
            if not must_go:
                more = TRUNCATED if truncated else 0
                options.append((_inserted(state), REROLE + more, "R"))
                if initial in FOLLOWS[state]:
                    options.append((FOLLOWS[state][initial], KEEP + more, "K"))
            for after, cost, letter in options:
                found = (INSERT * len(run) + cost, run + letter)
                best[parent, after] = min(found, best.get((parent, after), found))
            state, run = _inserted(state), run + "I"
    return tuple((p, s, c, code) for (p, s), (c, code) in best.items())


@lru_cache(maxsize=100_000)
def step(kind: tuple[str, bool, bool], layer: tuple[tuple[int, int] | None, ...]) -> tuple[int, tuple[tuple[int, int] | None, ...], tuple[tuple[int, str] | None, ...]]:
    """What all costs grow by, the next layer, and each state's parent and code. A layer has (cost above the least, rank) by state."""
    found: list[tuple[int, int, str, int] | None] = [None] * 4
    for parent, state, cost, code in moves(*kind):
        if layer[parent] is not None:
            new = (layer[parent][0] + cost, layer[parent][1], code, parent)
            found[state] = new if found[state] is None else min(found[state], new)
    done = found[ASSISTANT]
    for state, least in ((NOTHING, 4), (SYSTEM, 0), (USER, 3)):
        # From the assistant's turn, deleting or inserting one turn leads on as cheaply as from here, so a dearer state is no use.
        if done is not None and found[state] is not None and found[state][0] > done[0] + least:
            found[state] = None
    base = min(x[0] for x in found if x is not None)
    order = sorted((x[1], x[2]) for x in found if x is not None)
    after = tuple(None if x is None else (x[0] - base, order.index((x[1], x[2]))) for x in found)
    return base, after, tuple(None if x is None else (x[3], x[2]) for x in found)


class Repair:
    """One conversation's turns, added in order."""

    #: Numbers of the pointers that steps give, and the pointers by number: one table for a worker.
    numbers: dict[tuple, int] = {}
    pointers: list[tuple] = []

    def __init__(self):
        self.layer: tuple = ((0, 0), None, None, None)
        self.cost, self.back, self.seen = 0, array("H"), set()
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None

    def add(self, turn: int | None, initial: str, digest: bytes, blank: bool, truncated: bool) -> None:
        if turn is not None:
            self.first = turn if self.first is None else self.first
            self.turns += turn != self.last
            self.last = turn
        self.illegal += self.before is not None and self.before + initial not in ("su", "ua", "au")
        self.before = initial
        duplicate = not blank and digest in self.seen
        if not blank:
            self.seen.add(digest)
        truncated = truncated and not blank and not duplicate
        self.blank, self.duplicate, self.truncated = self.blank + blank, self.duplicate + duplicate, self.truncated + truncated
        more, self.layer, back = step((initial, blank or duplicate, truncated), self.layer)
        self.cost += more
        if back not in self.numbers:
            self.numbers[back] = len(self.pointers)
            self.pointers.append(back)
        self.back.append(self.numbers[back])

    def report(self) -> dict:
        cost, _, ending, state = min((x[0] + INSERT * len(ENDINGS[s]), x[1], ENDINGS[s], s) for s, x in enumerate(self.layer) if x is not None)
        codes = [ending]
        for number in reversed(self.back):
            state, code = self.pointers[number][state]
            codes.append(code)
        gaps = 0 if self.first is None else self.last - self.first + 1 - self.turns
        return {"gaps": gaps, "blank": self.blank, "duplicate": self.duplicate, "truncated": self.truncated, "illegal": self.illegal, "cost": self.cost + cost, "audit": "".join(reversed(codes))}


def _reports(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(conv, report) from turns sorted by conversation: conv, turn, initial, digest, blank, truncated, there."""
    none = object()
    conv, own, done = none, Repair(), []

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], schema.field(i).type) for i in range(2)], schema=schema)

    for b in batches:
        for name, there, *turn in zip(*(b.column(i).to_pylist() for i in (0, 6, 1, 2, 3, 4, 5))):
            if name != conv:
                if conv is not none:
                    done.append((conv, own.report()))
                conv, own = name, Repair()
            if there:
                own.add(*turn)
        yield out()
        done = []
    if conv is not none:
        done = [(conv, own.report())]
        yield out()
    free_memory()


def _repaired(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(conv, place, report, edit, role, text) from each conversation's report and then its turns: conv, report, role, text."""
    conv, audit, at, place, last, done = None, "", 0, 0, "", []

    def give(edit: str, role: str, text: str) -> None:
        nonlocal place, last
        place += 1
        last = role[:1]
        done.append((conv, place, None, edit, role, text))

    def inserts() -> None:
        nonlocal at
        while audit[at : at + 1] == "I":
            give("I", "assistant" if last == "u" else "user", "")
            at += 1

    for b in batches:
        for name, report, role, text in zip(*(c.to_pylist() for c in b.columns)):
            if report is not None:
                inserts()  # those at the end of the conversation before
                conv, audit, at, place, last = name, report["audit"], 0, 0, ""
                done.append((conv, 0, report, None, None, None))
                continue
            inserts()
            edit, at = audit[at], at + 1
            if edit != "D":
                give(edit, role if edit == "K" else "assistant" if last == "u" else "user", text)
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], schema.field(i).type) for i in range(6)], schema=schema)
            done = []
    inserts()
    if done:
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in done], schema.field(i).type) for i in range(6)], schema=schema)
    free_memory()


def repair(rows: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", there: Column | None = None) -> DataFrame:
    """``(conv_id, place, report, edit, role, text)``: each conversation's report at place 0, then its repaired turns from 1.

    A conversation's rows lie together and in order in one partition. ``there`` is false for rows that only make their conversation
    known. report has gaps (missing numbers between the least and the largest turn), the counts of faults, illegal (neighbours whose
    roles can't follow each other), cost and audit (the edits' initials).
    """
    kind, n = rows.schema[conv].dataType, partitions(rows)
    said = lambda c: F.coalesce(F.col(c), F.lit(" "))
    own = rows.select(F.col(conv).alias("conv_id"), F.col(turn).cast("bigint").alias("turn"), said(role).alias("role"), said(text).alias("text"), (F.lit(True) if there is None else there).alias("there"))
    own = own.withColumn("digest", F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)))
    end, first = F.rtrim(F.col("text"), F.lit(SPACES)), F.left("role", F.lit(1))
    order = ["conv_id", "turn", "role", "digest"]
    flags = own.select("conv_id", "turn", F.when(first.isin("s", "u", "a"), first).otherwise("").alias("initial"), "digest", (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"), "there", "role")
    sorted_flags = flags.repartition(n, "conv_id").sortWithinPartitions(*order).drop("role")
    known = StructType([StructField("conv_id", kind), StructField("report", REPORT)])
    reports = sorted_flags.mapInArrow(with_schema(_reports, known), known)

    turns = own.where("there").select("conv_id", F.lit(None).cast(REPORT).alias("report"), "turn", "role", "text", "digest")
    heads = reports.select("conv_id", "report", *(F.lit(None).cast(t).alias(c) for c, t in (("turn", "bigint"), ("role", "string"), ("text", "string"), ("digest", "binary"))))
    dealt = heads.unionByName(turns).repartition(n, "conv_id").sortWithinPartitions("conv_id", F.col("report").isNull(), *order[1:])
    schema = StructType([*known.fields[:1], StructField("place", LongType()), known.fields[1], *(StructField(c, StringType()) for c in ("edit", "role", "text"))])
    return dealt.select("conv_id", "report", "role", "text").mapInArrow(with_schema(_repaired, schema), schema)


def with_schema(run, schema: StructType):
    arrow = to_arrow_schema(schema)
    return lambda batches: run(batches, arrow)


def turns(repaired: DataFrame) -> DataFrame:
    """The repaired turns alone."""
    return repaired.where("place > 0").drop("report")


def reports(repaired: DataFrame) -> DataFrame:
    """``(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit)`` of each conversation."""
    return repaired.where("place = 0").select("conv_id", "report.*")
