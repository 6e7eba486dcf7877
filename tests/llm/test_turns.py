"""Repair of conversations against brute force over edits, in one stretch and in many."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from millrace.llm import queries, turns

SCHEMA = "conv_id long, turn long, role string, text string, conv string, copies2 int, seq long"
DELTA = {"": "su", "s": "u", "u": "a", "a": "u"}


def plain_damage(rows):
    for conv, turn, role, text in rows:
        n = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        text = "" if n == 1 else re.sub("[.!?]", "", text) if n == 2 else text
        yield from [(conv, turn, "user" if n == 4 else role, text)] * (0 if n == 0 else 2 if n == 3 else 1)


def plain_best(rows):
    """rows: (role, text, must go, truncated). Dijkstra without any matrix: all cheapest (cost, audit, turns) by last role, over turns and insertions."""
    best = {"": (0, "", ())}

    def insert(best):
        for _ in range(3):
            for last, (cost, audit, made) in list(best.items()):
                for r in DELTA[last].replace("s", ""):
                    z = (cost + 3, audit + "I", made + (({"u": "user", "a": "assistant"}[r], ""),))
                    if r not in best or z[:2] < best[r][:2]:
                        best[r] = z
        return best

    best = insert(best)
    for role, text, go, cut in rows:
        new = {}
        for last, (cost, audit, made) in best.items():
            options = [(last, cost + 4, audit + "D", made)]
            if not go:
                options += [(r, cost + 3 + 3 * cut, audit + "R", made + (({"u": "user", "a": "assistant"}[r], text),)) for r in DELTA[last].replace("s", "")]
                if role[:1] and role[0] in DELTA[last]:
                    options.append((role[0], cost + 3 * cut, audit + "K", made + ((role, text),)))
            for r, *z in options:
                if r not in new or tuple(z[:2]) < new[r][:2]:
                    new[r] = tuple(z)
        best = insert(new)
    return min(best[r] for r in ("", "a") if r in best)


def exhaustive(rows):
    """Every audit with at most two insertions at a place, for a few turns."""
    found = []
    for edits in itertools.product(*(["D"] if go else "DKR" for _, _, go, _ in rows)):
        for gaps in itertools.product(range(3), repeat=len(rows) + 1):
            audit = "I" * gaps[0] + "".join(e + "I" * g for e, g in zip(edits, gaps[1:]))
            cost, kept, at = 0, [], 0
            for e in audit:
                row = rows[at] if e != "I" else None
                at += e != "I"
                cost += {"D": 4, "K": 0, "R": 3, "I": 3}[e] + (3 if e in "KR" and row[3] else 0)
                if e != "D":
                    kept.append(row[0][:1] if e == "K" else "?")
            for fill in itertools.product("ua", repeat=kept.count("?")):
                it = iter(fill)
                if re.fullmatch("(s?(ua)+)?", "".join(next(it) if c == "?" else c or "-" for c in kept)):
                    found.append((cost, audit))
    return min(found)


def plain(rows, ids):
    convs = defaultdict(list)
    for r in rows:
        convs[r[0]].append(r)
    out = {}
    for conv in ids:
        ordered = sorted(convs[conv], key=lambda r: (r[1] is not None, r[1] or 0, r[2], r[3]))
        seen, marked, counts = set(), [], [0, 0, 0]
        for _, _, role, text in ordered:
            bare = text.rstrip(" \t\n\v\f\r")
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else 3
            seen.add((role, text))
            if fault < 3:
                counts[fault] += 1
            marked.append((role, text, fault < 2, fault == 2))
        numbers = [r[1] for r in ordered if r[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        pairs = [(a[2][:1] + "-")[0] + (b[2][:1] + "-")[0] for a, b in zip(ordered, ordered[1:])]
        cost, audit, made = plain_best(marked)
        if len(marked) < 4:
            assert (cost, audit) == exhaustive(marked)
        out[conv] = (gaps, *counts, sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest(), made)
    return out


def odd_rows():
    rng = random.Random(3)
    texts = ["Yes.", "no", "what?", "", " \t\n", None, "long " * 4000, "x!", "é ", "ok. \r", "a\nb:c."]
    rows = []
    for conv in [*range(60), None]:
        for turn in range(rng.randint(1, 9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None, -turn]), rng.choice(["user", "assistant", "user", "assistant", "system", None, "tool", "", "uranus"]), rng.choice(texts)))
    rows += rows[:20] + [rows[5]] * 4
    rows += [(900, t, ("user", "assistant")[t % 2 if rng.random() < 0.8 else 1], rng.choice(texts[:8]) or "a") for t in range(300)]
    rng.shuffle(rows)
    return rows


def got(df):
    return {r["conv_id"]: (r["gaps"], r["blank"], r["duplicate"], r["truncated"], r["illegal"], r["cost"], r["audit"], r["repaired_sha256"]) for r in df.collect()}


@pytest.fixture
def frame(spark):
    return spark.createDataFrame([(*r, "x", 5, 7) for r in odd_rows()], SCHEMA).repartition(3)


@pytest.mark.parametrize("stretch,fan", [(2048, 64), (3, 2), (7, 4)])
def test_repair(spark, frame, monkeypatch, stretch, fan):
    """Many short stretches over many partitions give what one stretch gives."""
    monkeypatch.setattr(turns, "STRETCH", stretch)
    monkeypatch.setattr(turns, "FAN", fan)
    rows = odd_rows()
    assert got(turns.repair(frame)) == {k: v[:-1] for k, v in plain([(c, t, " " if r is None else r, " " if x is None else x) for c, t, r, x in rows], {r[0] for r in rows}).items()}


def test_damaged(spark, frame):
    rows = odd_rows()
    expected = plain(list(plain_damage(rows)), {r[0] for r in rows})
    assert got(turns.repair(turns.damage(frame))) == {k: v[:-1] for k, v in expected.items()}
    made = defaultdict(list)
    for r in turns.repaired(turns.damage(frame)).orderBy("conv_id", "position").collect():
        made[r["conv_id"]].append((r["role"], r["text"]))
    assert made == {k: list(v[-1]) for k, v in expected.items() if v[-1]}


def test_query(spark, sf):
    rows = [tuple(r[c] for c in ("conv_id", "turn", "role", "text")) for r in spark.read.parquet(f"{sf}/conversations.parquet").collect()]
    assert got(queries.op13_turns(spark, sf)) == {k: v[:-1] for k, v in plain(list(plain_damage(rows)), {r[0] for r in rows}).items()}


def test_empty(spark):
    none = spark.createDataFrame([], SCHEMA)
    assert turns.repair(turns.damage(none)).count() == 0
    assert turns.repaired(none).count() == 0


def test_copies(spark):
    """One turn repeated thousands of times is one row until it is counted."""
    rows = [(1, 0, "user", "Hm.")] * 3000 + [(1, 1, "assistant", "Yes.")]
    r = turns.repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    assert (r["duplicate"], r["illegal"], r["cost"], r["audit"]) == (2999, 2999, 4 * 2999, "K" + "D" * 2999 + "K")
