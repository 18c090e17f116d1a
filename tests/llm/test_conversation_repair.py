import hashlib
import random
import zlib

import pytest
from llm.conftest import read

from cohortwarn.llm import conversation_repair as cr
from cohortwarn.llm.queries import QUERIES

SCHEMA = "conv_id long, turn long, role string, text string"


def plain_path(rows, first=cr.NOTHING, goals=cr.ENDS, tail=True):
    """Cheapest edits by a table over all nodes from the end, inserts behind one another at most twice in a row."""
    best = {(len(rows), q): (0, "") if q in goals else None for q in range(4)}
    for at in range(len(rows), -1, -1):
        if at < len(rows):
            c, must_go, cut = rows[at]
            for q in range(4):
                ways = [(3 + x[0], "D" + x[1]) for x in [best[at + 1, q]] if x]
                for sign, to in cr.NEXT[q].items():
                    after = best[at + 1, to]
                    if after and not must_go:
                        ways += [(cut + after[0], "K" + after[1])] * (sign == c)
                        ways += [(2 + cut + after[0], "R" + after[1])] * (sign in "ua")
                best[at, q] = min(ways, default=None)
        if at < len(rows) or tail:
            for _ in range(6):
                for q in range(4):
                    ways = [best[at, q]] if best[at, q] else []
                    for sign, to in cr.NEXT[q].items():
                        if sign != "s" and best[at, to]:
                            ways.append((2 + best[at, to][0], "I" + best[at, to][1]))
                    best[at, q] = min(ways, default=None)
    return best[0, first]


def brute(table):
    """Everything from rows (conv_id, turn, role, text), in plain Python."""
    out = {}
    for conv in {r[0] for r in table}:
        rows = []
        for _, turn, role, text in sorted(
                (r for r in table if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0)):
            role, text = " " if role is None else role, " " if text is None else text
            key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
            code = zlib.crc32(key.encode()) % 20
            if code == 0:
                continue
            text = "" if code == 1 else "".join(c for c in text if c not in ".!?") if code == 2 else text
            rows += [(turn, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
        counts, seen, lattice = {"blank": 0, "duplicate": 0, "truncated": 0}, set(), []
        for _, role, text in rows:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = "blank" if not bare else "duplicate" if (role, text) in seen else \
                "truncated" if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                counts[fault] += 1
            lattice.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(lattice, lattice[1:], strict=False))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        cost, audit = plain_path(lattice)
        lines, state, at = [], 0, 0
        for e in audit:
            sign = rows[at][1][:1] if e == "K" else "a" if state == cr.USER else "u"
            if e == "K":
                lines.append(f"{rows[at][1]}:{rows[at][2]}")
            elif e in "RI":
                lines.append(f"{cr.ROLES[sign]}:{rows[at][2] if e == 'R' else ''}")
            state = state if e == "D" else cr.NEXT[state][sign]
            at += e != "I"
        digest = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out[conv] = (conv, gaps, *counts.values(), illegal, cost, audit, digest)
    return out


def collect(df):
    found = [tuple(r) for r in df.collect()]
    assert len(found) == len({r[0] for r in found})
    return {r[0]: r for r in found}


def some_rows(rng, n):
    return [(rng.choice("suuaaax"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n)]


def test_search_from_both_ends_finds_the_least_list():
    rng = random.Random(1)
    for i in range(1500):
        rows = some_rows(rng, rng.randint(0, 9))
        assert cr.cheapest(rows) == plain_path(rows)
        a, b = rng.randrange(4), rng.randrange(4)
        assert cr.cheapest(rows, a, (b,), tail=False) == plain_path(rows, a, (b,), tail=False)


def test_segments_combine_to_the_whole():
    rng = random.Random(2)
    for _ in range(300):
        rows = some_rows(rng, rng.randint(2, 14))
        cuts = sorted({0, len(rows), *(rng.randrange(1, len(rows)) for _ in range(3))})
        parts = [rows[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
        found = [cr.matrix(p, p is parts[-1]) for p in parts]
        whole, between = cr.chain(found)
        edits = []
        for p, (a, b) in zip(parts, cr.route(between, cr.NOTHING, cr.NOTHING), strict=True):
            last = p is parts[-1]
            edits.append(cr.cheapest(p, a, cr.ENDS if last else (b,), tail=last)[1])
        assert (whole[0, 0][0], "".join(edits)) == plain_path(rows)


@pytest.mark.parametrize("segment", [256, 3])
def test_query_against_plain_python(spark, medium, monkeypatch, segment):
    monkeypatch.setattr(cr, "SEGMENT", segment)
    rows = read(spark, medium, "conversations")
    want = brute([tuple(r) for r in rows.select("conv_id", "turn", "role", "text").collect()])
    assert collect(cr.repair_damaged(rows)) == want
    if segment > 3:
        assert collect(QUERIES["op11_conversation_repair"](spark, medium)) == want


def test_one_conversation_in_many_parts(spark):
    rng = random.Random(3)
    rows = [(7, i, rng.choice(["user", "assistant", "system", "tool"]), rng.choice(["Yes.", "No", "", f"w{i}!", "why?"]))
            for i in range(3000)] + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert collect(cr.repair_damaged(df)) == brute(rows)


def test_odd_rows(spark):
    long = "word and word. " * 40_000
    rows = [(None, None, None, None), (None, 1, "user", "x."), (1, None, "user", "a"), (1, None, None, "b."),
            (2, 1, "assistant", long), (2, 5, "User", "c."), (3, 0, "", " \t\n"), (4, 2, "user", "Ok!"),
            (4, 2, "user", "Ok!"), (4, 2, "user", "Ok!"), (5, -3, "system", " "), (5, 9_000_000_000, "a", "é?")]
    names = ", part string, no string, inner string, fault string, conv string, _id string, _digest string, copy string"
    df = spark.createDataFrame([(*r, *["x"] * 8) for r in rows], SCHEMA + names)
    # Rows of one turn that differ have no order in the plain version.
    want = brute(rows)
    got = collect(cr.repair_damaged(df))
    assert {k: v for k, v in got.items() if k != 1} == {k: v for k, v in want.items() if k != 1}
    assert got[1][:3] == want[1][:3] and set(got) == set(want)
    assert cr.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0


def test_conversations_that_damage_leaves_empty(spark):
    dropped = [i for i in range(2000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    df = spark.createDataFrame([(i, 0, "user", "Hi.") for i in dropped], SCHEMA)
    empty = hashlib.sha256(b"").hexdigest()
    assert collect(cr.repair_damaged(df)) == {i: (i, 0, 0, 0, 0, 0, 0, "", empty) for i in dropped}
