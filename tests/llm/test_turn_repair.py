"""Conversation repair against a search over all edits, and the registered query against a brute-force version."""

import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewell.llm import queries, turn_repair

TYPES = "conv_id long, turn long, role string, text string"
LEGAL = re.compile(r"(s?(ua)+)?")


def _faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        last = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not last else "duplicate" if (role, text) in seen else "truncated" if last not in ".!?" else ""
        seen.add((role, text))
        out.append(fault)
    return out


def _full(rows):
    """Every sequence of edits of a short conversation, without any sharing."""
    faults, done = _faults(rows), []

    def go(i, roles, cost, audit, told):
        if LEGAL.fullmatch(roles) and i == len(rows):
            done.append((cost, audit, told))
        if not re.fullmatch(r"s?(ua)*u?", roles):
            return
        if len(audit) - i < 5:
            for r in "ua":
                go(i, roles + r, cost + 3, audit + "I", (*told, ({"u": "user", "a": "assistant"}[r], "")))
        if i < len(rows):
            _, role, text = rows[i]
            go(i + 1, roles, cost + 4, audit + "D", told)
            if faults[i] not in ("blank", "duplicate"):
                more = 3 * (faults[i] == "truncated")
                go(i + 1, roles + (role[:1] or "?"), cost + more, audit + "K", (*told, (role, text)))
                for r in "ua":
                    go(i + 1, roles + r, cost + 3 + more, audit + "R", (*told, ({"u": "user", "a": "assistant"}[r], text)))

    go(0, "", 0, "", ())
    return min(done, key=lambda x: x[:2])


def _own(rows):
    """The operator's programme on rows of one conversation."""
    own, seen = turn_repair.Repair(), _faults(rows)
    for (turn, role, text), fault in zip(rows, seen):
        first = role[:1] if role[:1] in ("s", "u", "a") else ""
        own.add(turn, first, f"{len(role)}:{role}{text}".encode(), fault == "blank", text.rstrip()[-1:] not in (".", "!", "?"))
    return own.report()


def test_programme_is_the_cheapest_and_least():
    rng = np.random.default_rng(4)
    for _ in range(250):
        rows = [(i, str(rng.choice(["system", "user", "user", "assistant", "assistant", "tool", ""])), str(rng.choice(["a.", "b.", f"{i}.", f"{i}!", f"cut {i}", " "]))) for i in range(int(rng.integers(0, 5)))]
        cost, audit, _ = _full(rows)
        got = _own(rows)
        assert (got["cost"], got["audit"]) == (cost, audit), rows


def test_long_conversation_has_few_steps():
    rng, rows = np.random.default_rng(1), []
    for i in range(20_000):
        rows.append((i, str(rng.choice(["user", "assistant", "system"])), f"{i}" + str(rng.choice([".", ""]))))
    got = _own(rows)
    assert len(got["audit"].replace("I", "")) == 20_000 and len(turn_repair.Repair.pointers) < 2000


def _damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        said = [" " if x is None else str(x) for x in (conv, turn, role, text)]
        h = zlib.crc32(f"{said[0]}:{said[1]}".encode()) % 20
        text = "" if h == 1 else re.sub("[.!?]", "", said[3]) if h == 2 else said[3]
        row = (conv, turn, "user" if h == 4 else said[2], text)
        out.append((row, 0 if h == 0 else 2 if h == 3 else 1))
    return out


def _expected(rows):
    """The contract's columns for each conversation, by a table of (last initial) with whole audits: quadratic, but plain."""
    groups, want = {}, {}
    for row, times in _damaged(rows):
        groups.setdefault(row[0], []).extend([row[1:]] * times)
    for conv, own in groups.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(f"{len(r[1])}:{r[1]}{r[2]}".encode()).digest()))
        faults, ts = _faults(own), [t for t, _, _ in own if t is not None]
        best = {"": (0, "", [])}
        after = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
        names = {"u": "user", "a": "assistant"}

        def with_inserts(table):
            table = dict(table)
            for _ in range(3):
                for state, (cost, audit, told) in list(table.items()):
                    r = "a" if state == "u" else "u"
                    item = (cost + 3, audit + "I", [*told, (names[r], "")])
                    if r not in table or item[:2] < table[r][:2]:
                        table[r] = item
            return table

        for (_, role, text), fault in zip(own, faults):
            new = {}
            for state, (cost, audit, told) in best.items():
                paths, here = [(state, cost, audit, told)], state
                for _ in range(2):
                    r = "a" if here == "u" else "u"
                    paths.append((r, paths[-1][1] + 3, paths[-1][2] + "I", [*paths[-1][3], (names[r], "")]))
                    here = r
                for at, c, a, t in paths:
                    options = [(at, 4, "D", [])]
                    if fault not in ("blank", "duplicate"):
                        more, r = 3 * (fault == "truncated"), "a" if at == "u" else "u"
                        options.append((r, 3 + more, "R", [(names[r], text)]))
                        if role[:1] in after[at]:
                            options.append((role[:1], more, "K", [(role, text)]))
                    for to, more, e, what in options:
                        item = (c + more, a + e, t + what)
                        if to not in new or item[:2] < new[to][:2]:
                            new[to] = item
            best = new
        ends = with_inserts(best)
        ends = [best[""]] if "" in best and "a" not in ends else [ends[s] for s in ("", "a") if s in ends]
        cost, audit, told = min(ends, key=lambda x: x[:2])
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(own, own[1:])]
        want[conv] = (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in told).encode()).hexdigest())
    return want


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


@pytest.fixture(scope="module")
def made():
    rng, rows = np.random.default_rng(8), []
    for conv in range(120):
        for turn in range(int(rng.integers(1, 12))):
            role = ["user", "assistant"][turn % 2] if rng.random() < 0.85 else str(rng.choice(["system", "tool", "user", ""]))
            rows.append((conv, turn + int(rng.random() < 0.05), role, str(rng.choice([f"Say {turn}.", "Again!", f"cut {turn}", "é\n?", ""]))))
    rows += [(500, 0, "user", "x"), (None, 1, None, None), (None, None, "user", "one."), (None, None, "user", "one."), (None, 2, "assistant", "two?"), (600, None, "umpire", "All."), (600, None, "assistant", "y" * 200_000 + ".")]
    rows += [(700, t, "user", "same.") for t in range(40)] + [(800 + i, i, "user", None) for i in range(25)]
    return rows


def test_query_equals_brute_force(spark, made, tmp_path):
    spark.createDataFrame([(*r, 1) for r in made], TYPES + ", place int").repartition(4).write.parquet(f"{tmp_path}/conversations.parquet")
    got = queries.op13_turn_repair(spark, str(tmp_path)).collect()
    want = _expected(made)
    assert len(got) == len(want) and {r["conv_id"]: tuple(r[c] for c in COLUMNS) for r in got} == want
    assert any(len(set(r["audit"])) == 4 for r in got) and any(r["audit"] == "" for r in got)


def test_empty_table_and_turns(spark, made, tmp_path):
    spark.createDataFrame([], TYPES).write.parquet(f"{tmp_path}/conversations.parquet")
    assert queries.op13_turn_repair(spark, str(tmp_path)).collect() == []
    rows = spark.createDataFrame([(1, 0, "assistant", "Hi."), (1, 1, "user", "Yes."), (1, 2, "user", "No.")], TYPES)
    out = turn_repair.repair(rows)
    assert [(r["edit"], r["role"], r["text"]) for r in turn_repair.turns(out).orderBy("place").collect()] == [("I", "user", ""), ("K", "assistant", "Hi."), ("K", "user", "Yes."), ("R", "assistant", "No.")]
    assert turn_repair.reports(out).where(F.col("audit") == "IKKR").count() == 1
