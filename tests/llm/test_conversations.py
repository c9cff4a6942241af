"""Conversation repair against a plain search over all edits, in Python alone."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from orderlens.llm import conversations as cv
from orderlens.llm.queries import op13_conversation_repair

KIND = "conv_id long, turn long, role string, text string"
MOVES = {("s", ""): "s", ("u", ""): "u", ("u", "s"): "u", ("u", "a"): "u", ("a", "u"): "a"}


def damaged(rows):
    """The rules of the damage, row by row."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        out[conv]
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if draw == 0:
            continue
        text = "" if draw == 1 else re.sub("[.!?]", "", text) if draw == 2 else text
        out[conv] += [(turn, "user" if draw == 4 else role, text)] * (2 if draw == 3 else 1)
    return {c: sorted(r, key=lambda x: (x[0] is not None, x[0] or 0, x[1].encode(), x[2].encode())) for c, r in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        said = text.rstrip(" \t\n\x0b\x0c\r")
        out.append(1 if not said else 2 if (role, text) in seen else 3 if said[-1] not in ".!?" else 0)
        seen.add((role, text))
    return out


def cheapest(rows, fault):
    """(cost, audit) by recursion over what is left: (cost, letters) of the best ending, compared as a whole."""
    @lru_cache(None)
    def best(i, state, inserted):
        options = []
        if i == len(rows) and state in ("", "a"):
            options.append((0, ""))
        if inserted < 3:
            cost, rest = best(i, "a" if state == "u" else "u", inserted + 1)
            options.append((cost + 3, "I" + rest))
        if i < len(rows):
            cost, rest = best(i + 1, state, 0)
            options.append((cost + 4, "D" + rest))
            if fault[i] not in (1, 2):
                more = 3 if fault[i] == 3 else 0
                to = MOVES.get((rows[i][1][:1], state))
                if to:
                    cost, rest = best(i + 1, to, 0)
                    options.append((cost + more, "K" + rest))
                cost, rest = best(i + 1, "a" if state == "u" else "u", 0)
                options.append((cost + 3 + more, "R" + rest))
        return min(options, default=(10 ** 9, ""))
    return best(0, "", 0)


def replay(rows, audit):
    state, left, lines = "", iter(rows), []
    for letter in audit:
        new = "assistant" if state == "u" else "user"
        if letter == "I":
            lines.append((new, ""))
        else:
            _, role, text = next(left)
            if letter == "D":
                continue
            lines.append((role if letter == "K" else new, text))
        state = lines[-1][0][:1]
    assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in lines))
    return lines


def expected(rows):
    out = {}
    for conv, kept in damaged(rows).items():
        fault = faults(kept)
        turns = sorted({t for t, _, _ in kept if t is not None})
        initials = [r[:1] for _, r, _ in kept]
        cost, audit = cheapest(tuple(kept), tuple(fault))
        text = "\n".join(f"{r}:{t}" for r, t in replay(kept, audit))
        out[conv] = (turns[-1] - turns[0] + 1 - len(turns) if turns else 0, *(fault.count(k) for k in (1, 2, 3)),
                     sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
                     hashlib.sha256(text.encode()).hexdigest())
    return out


def report(rows_df):
    got = cv.repair_report(cv.damage(rows_df)).collect()
    out = {r["conv_id"]: tuple(r)[1:] for r in got}
    assert len(out) == len(got)
    return out


def random_rows(seed, conversations, longest):
    rnd, rows = random.Random(seed), []
    for c in range(conversations):
        for t in range(rnd.randint(1, longest)):
            rows.append((c if rnd.random() < 0.98 else None, t * rnd.choice((1, 1, 1, 2)) if rnd.random() < 0.95 else None,
                         rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]),
                         rnd.choice(["Yes.", "No!", "what", "", " \n", "a ", "Why? ", None, f"text {rnd.randint(0, 99)}."])))
    return rows


@pytest.mark.parametrize("seed,longest", [(1, 5), (2, 14), (3, 40)])
def test_against_plain_search(spark, seed, longest):
    rows = random_rows(seed, 120, longest)
    df = spark.createDataFrame(rows, KIND).withColumns({c: F.lit("x") for c in ("copy", "present", "fault", "draw", "nth")})
    assert report(df.repartition(7)) == expected(rows)


def test_query_on_the_table(spark):
    path = "/root/testdata/sf0.01/conversations.parquet"
    rows = [tuple(r) for r in spark.read.parquet(path).select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in op13_conversation_repair(spark, "/root/testdata/sf0.01").collect()}
    assert got == expected(rows)


def test_rows_follow_the_audit(spark):
    rows = random_rows(5, 60, 12)
    df = cv.damage(spark.createDataFrame(rows, KIND))
    want = {conv: replay(kept, cheapest(tuple(kept), tuple(faults(kept)))[1]) for conv, kept in damaged(rows).items()}
    got = defaultdict(list)
    for r in cv.repaired_rows(df).orderBy("conv_id", "place").collect():
        if r["edit"] != "D":
            got[r["conv_id"]].append((r["role"], r["text"]))
    assert {c: v for c, v in got.items() if v} == {c: v for c, v in want.items() if v}


def test_conversation_whose_rows_are_all_dropped(spark):
    conv = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    got = report(spark.createDataFrame([(conv, 0, "user", "Hi.")], KIND))
    assert got == {conv: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}
    assert report(spark.createDataFrame([], KIND)) == {}


def test_memory_is_bounded_while_edits_are_decided():
    """A legal conversation of 50,000 rows, with very long texts now and then: a handful of rows is ever undecided."""
    given, most = [], 0
    search = cv.Repair(lambda letter, row: given.append(letter))
    for k in range(50_000):
        search.row(("user", "assistant")[k % 2], "x" * (1_000_000 if k % 10_000 == 0 else 3) + ".", cv.NONE)
        most = max(most, search.undecided)
    assert search.finish() == 0 and "".join(given) == "K" * 50_000 and most <= 4


def test_undecided_paths_are_compared_whole():
    """Long runs that no state decides (system rows alone): cost and letters still equal the plain search."""
    for length in (1, 2, 7, 30, 61):
        rows = [(k, "system", f"Note {k}.") for k in range(length)]
        letters = []
        search = cv.Repair(lambda letter, row: letters.append(letter))
        for _, role, text in rows:
            search.row(role, text, cv.NONE)
        assert (search.finish(), "".join(letters)) == cheapest(tuple(rows), (0,) * length)
