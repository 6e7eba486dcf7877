"""Repair of conversation structure: a min-plus matrix scan over turns.

A repaired conversation has role initials `(s?(ua)+)?`, an automaton of four states. A turn is a 4x4 matrix whose element
(p, q) is the cheapest (cost, audit) edit that leads from state p to q; the matrix takes in the closure of insertions behind
the turn. Elements add by the least of both (cost, then audit in ASCII order) and multiply by adding costs and joining
audits. That is associative, and distributive too: for one stretch of turns the letters of an audit determine its cost, so
of two audits of equal cost neither is a proper prefix of the other. A stretch's matrix is the product of its turns'; long
conversations are cut into stretches over all partitions, whose matrices are multiplied in a tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache, reduce

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import join_small, map_batches, materialise

STATES, ACCEPTED = 4, (0, 3)
#: State after a role initial: nothing yet, system, user, assistant.
STEPS = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (2, "a"): 3, (3, "u"): 2}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
ROLES = {"u": "user", "a": "assistant"}
#: Turns and characters of a stretch, and stretches that are multiplied in one group; no result depends on them.
STRETCH, STRETCH_CHARS, FAN = 2048, 1 << 24, 64
SPACES = " \t\n\v\f\r"
ORDER = ("conv", "turn", "role", "text")
COUNTS = "blank long, duplicate long, truncated long, illegal long"
PARTS = f"conv string, seq long, {COUNTS}, lo long, hi long, n_turns long, first_turn long, last_turn long, first string, last string, costs array<long>, audits array<string>"
FOUND = f"conv string, gaps long, {COUNTS}, cost long, audit string"

Element = tuple[int, str] | None
Matrix = list[list[Element]]


def times(a: Matrix, b: Matrix) -> Matrix:
    out: Matrix = []
    for row in a:
        line: list[Element] = [None] * STATES
        for x, across in zip(row, b):
            if x is not None:
                for q, y in enumerate(across):
                    if y is not None:
                        z = (x[0] + y[0], x[1] + y[1])
                        if line[q] is None or z < line[q]:
                            line[q] = z
        out.append(line)
    return out


def _insertions() -> Matrix:
    one: Matrix = [[(0, "") if p == q else None for q in range(STATES)] for p in range(STATES)]
    for (p, initial), q in STEPS.items():
        if initial in ROLES:
            one[p][q] = (INSERT, "I")
    closed = one
    for _ in range(STATES):  # a cheapest run of insertions visits no state twice
        closed = times(closed, one)
    return closed


CLOSURE = _insertions()


@lru_cache
def turn_matrix(kind: str) -> Matrix:
    """kind: a role's initial (x: none of s, u, a), upper case if the text is truncated; "-" if the turn must go."""
    out: Matrix = [[None] * STATES for _ in range(STATES)]
    more = TRUNCATED if kind.isupper() else 0
    for p in range(STATES):
        out[p][p] = (DELETE, "D")
        for r in ROLES if kind != "-" else ():
            if (q := STEPS.get((p, r))) is not None:
                out[p][q] = (REROLE + more, "R")
        if (q := STEPS.get((p, kind.lower()))) is not None:
            out[p][q] = (more, "K")
    return times(out, CLOSURE)


@lru_cache(4096)
def stretch_matrix(kinds: str) -> Matrix:
    """The product of the turns' matrices, halves first; few different stretches are short, so they are remembered."""
    if len(kinds) <= 4:
        return reduce(times, map(turn_matrix, kinds), CLOSURE)
    return times(stretch_matrix(kinds[: len(kinds) // 2]), stretch_matrix.__wrapped__(kinds[len(kinds) // 2 :]))


def cheapest(matrix: Matrix) -> tuple[int, str]:
    return min(x for q in ACCEPTED if (x := matrix[0][q]) is not None)


class Walk:
    """Goes through an audit along the turns and gives the repaired ones: roles follow from the state alone."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, 0

    def _next(self, role: str | None) -> str:
        role = role if role is not None else ROLES["a" if self.state == 2 else "u"]
        self.state = STEPS[self.state, role[:1]]
        return role

    def inserted(self) -> Iterator[tuple[str, str]]:
        while self.audit[self.at : self.at + 1] == "I":
            self.at += 1
            yield self._next(None), ""

    def turn(self, role: str, text: str, copies: int) -> Iterator[tuple[str, str]]:
        for _ in range(copies):
            yield from self.inserted()
            edit = self.audit[self.at]
            self.at += 1
            if edit != "D":
                yield self._next(role if edit == "K" else None), text
        yield from self.inserted()


class Digest:
    def __init__(self):
        self.sha, self.some = hashlib.sha256(), False

    def add(self, turns: Iterator[tuple[str, str]]) -> None:
        for role, text in turns:
            self.sha.update((b"\n" if self.some else b"") + f"{role}:{text}".encode("utf-8", "replace"))
            self.some = True


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and copies (0: the turn is dropped) by crc32("conv_id:turn") % 20; a null is one space."""
    d = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return turns.select(
        "conv_id", "turn", F.when(d == 4, "user").otherwise(role).alias("role"),
        F.when(d == 1, "").when(d == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(d == 0, 0).when(d == 3, 2).otherwise(1).alias("copies"),
    )


def ordered(turns: DataFrame) -> DataFrame:
    """One written row per different turn: conv (the id as text), turn, role, text, copies, and again: the first turn with this role and text
    is an earlier one. Equal turns come as one row with their number, so however often one is repeated, it is no hot key."""
    copies = F.col("copies").cast("long") if "copies" in turns.columns else F.lit(1).cast("long")
    given = turns.select(F.coalesce(F.col("conv_id").cast("long").cast("string"), F.lit("null")).alias("conv"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), copies.alias("copies"))
    same = F.unhex(F.sha2(F.concat("conv", F.lit("/"), F.length("role").cast("string"), F.lit("/"), "role", "text"), 256))
    rows, _ = materialise(given.groupBy(*ORDER).agg(F.sum("copies").alias("copies")).withColumn("same", same), "turns")
    first = rows.filter("copies > 0").groupBy("same").agg(F.min(F.struct("turn")).alias("since"), F.count("*").alias("n"))
    first, _ = materialise(first.filter("n > 1").select("same", F.col("since.turn").alias("since")), "repeats")
    joined = join_small(rows, first.withColumn("met", F.lit(True)), "same")
    again = F.col("met") & ~F.col("turn").eqNullSafe(F.col("since"))
    return materialise(joined.select(*ORDER, "copies", F.coalesce(again, F.lit(False)).alias("again")), "ordered")[0]


class Stretch:
    """Some turns of one conversation in a row: their kinds, counts, and (while it isn't too long) the turns themselves."""

    def __init__(self, conv: str):
        self.conv, self.kinds, self.turns, self.chars = conv, [], [], 0
        self.facts = dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "n_turns"), 0) | dict.fromkeys(("lo", "hi", "first_turn", "last_turn", "first", "last"))

    def add(self, turn: int | None, role: str, text: str, copies: int, again: bool) -> None:
        if not copies:
            return
        f, bare, initial = self.facts, text.rstrip(SPACES), role[:1] if role[:1] and role[0] in "sua" else "x"
        extra = copies - 1
        if not bare:
            kind = "-"
            f["blank"] += copies
        else:
            f["duplicate"] += extra + again
            cut = not again and bare[-1] not in ".!?"
            f["truncated"] += cut
            kind = "-" if again else initial.upper() if cut else initial
        self.kinds.append(kind + "-" * extra)
        f["illegal"] += extra + (f["last"] is not None and f["last"] + initial not in ("su", "ua", "au"))
        f["first"], f["last"] = f["first"] or initial, initial
        if turn is not None:
            f["n_turns"] += turn != f["last_turn"]
            f["lo"], f["hi"] = turn if f["lo"] is None else f["lo"], turn
            f["first_turn"], f["last_turn"] = turn if f["first_turn"] is None else f["first_turn"], turn
        self.turns.append((role, text, copies))
        self.chars += len(text) + copies

    def full(self) -> bool:
        return len(self.turns) >= STRETCH or self.chars >= STRETCH_CHARS

    def part(self, seq: int) -> dict:
        flat = [x for row in stretch_matrix.__wrapped__("".join(self.kinds)) for x in row]
        return {"conv": self.conv, "seq": seq, **self.facts, "costs": [x and x[0] for x in flat], "audits": [x and x[1] for x in flat]}

    def result(self) -> dict:
        """The conversation's own result, if this is all of it."""
        kinds = "".join(self.kinds)
        cost, audit = cheapest(stretch_matrix(kinds) if len(kinds) < 64 else stretch_matrix.__wrapped__(kinds))
        return summed(self.conv, self.facts, cost, audit) | {"repaired_sha256": digest(audit, self.turns)}


def digest(audit: str, turns: list[tuple[str, str, int]]) -> str:
    walk, out = Walk(audit), Digest()
    out.add(walk.inserted())
    for t in turns:
        out.add(walk.turn(*t))
    return out.sha.hexdigest()


def summed(conv: str, facts: dict, cost: int, audit: str) -> dict:
    gaps = facts["hi"] - facts["lo"] + 1 - facts["n_turns"] if facts["lo"] is not None else 0
    return {"conv": conv, "gaps": gaps, **{k: facts[k] for k in ("blank", "duplicate", "truncated", "illegal")}, "cost": cost, "audit": audit}


def joined(a: dict, b: dict) -> dict:
    """Two stretches that follow each other as one."""
    matrix = lambda x: [[None if x["costs"][4 * p + q] is None else (int(x["costs"][4 * p + q]), x["audits"][4 * p + q]) for q in range(STATES)] for p in range(STATES)]
    flat = [x for row in times(matrix(a), matrix(b)) for x in row]
    out = {k: a[k] + b[k] for k in ("blank", "duplicate", "truncated", "illegal", "n_turns")}
    out["illegal"] += a["last"] is not None and b["first"] is not None and a["last"] + b["first"] not in ("su", "ua", "au")
    out["n_turns"] -= a["last_turn"] is not None and a["last_turn"] == b["first_turn"]
    for k, x, y in (("lo", a, b), ("first_turn", a, b), ("first", a, b), ("hi", b, a), ("last_turn", b, a), ("last", b, a)):
        out[k] = x[k] if x[k] is not None else y[k]
    return out | {"conv": a["conv"], "seq": a["seq"], "costs": [x and x[0] for x in flat], "audits": [x and x[1] for x in flat]}


def tree(parts: list[dict]) -> dict:
    while len(parts) > 1:
        parts = [joined(*parts[i : i + 2]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
    return parts[0]


def columns(rows: list[dict], schema: str) -> dict:
    names = [x.split()[0] for x in schema.split(", ")]
    return {n: [r.get(n) for r in rows] for n in names}


def _rows(batches) -> Iterator[tuple]:
    for b in batches:
        yield from zip(*(c.to_pylist() for c in b.columns))


def scan(rows: DataFrame) -> DataFrame:
    """FOUND and repaired_sha256 of conversations that lie whole in one stretch of a partition; of others PARTS, one row per stretch."""

    def run(batches):
        seq, out, open_, last = TaskContext.get().partitionId() << 24, [], True, None
        for row in _rows(batches):
            if last is None or last.conv != row[0] or last.full():
                cut = last is not None and last.conv == row[0]
                if last is not None:
                    # The partition's first conversation may have begun before it; one that was cut goes on behind.
                    out.append(last.part(seq) if open_ or cut else last.result())
                    open_ = cut
                seq += 1
                last = Stretch(row[0])
            last.add(*row[1:])
            if len(out) >= 256:
                yield columns(out, schema)
                out = []
        if last is not None:
            out.append(last.part(seq))
        yield columns(out, schema)

    schema = f"{PARTS}, gaps long, cost long, audit string, repaired_sha256 string"
    dealt = rows.select(*ORDER, "copies", "again").repartitionByRange(*ORDER).sortWithinPartitions(*ORDER)
    return map_batches(dealt, run, schema)


def multiplied(parts: DataFrame) -> DataFrame:
    """One row per conversation from its stretches, a tree of groups of at most FAN; each level is written."""
    names = [x.split()[0] for x in PARTS.split(", ")]

    def group(batches):
        import pandas as pd

        whole = tree(batches.sort_values("seq").to_dict("records"))
        return pd.DataFrame([whole], columns=names).astype({"lo": "Int64", "hi": "Int64", "first_turn": "Int64", "last_turn": "Int64"})

    def clean(pdf):
        records = pdf.astype(object).where(pdf.notna(), None)
        for c in ("costs", "audits"):
            records[c] = [[None if x is None or x != x else x for x in v] for v in pdf[c]]
        return group(records)

    level = 0
    while True:
        counts, _ = materialise(parts.groupBy("conv").agg(F.count("*").alias("n")), "stretches")
        many, more = counts.agg(F.max(F.col("n") > 1), F.max(F.col("n") > FAN)).first()
        if not many:
            return parts
        level += 1
        shift = int(FAN).bit_length() - 1
        wide = join_small(parts, counts, "conv")
        block = F.when(F.col("n") <= FAN, 0).otherwise(F.shiftright("seq", shift * level))
        parts, _ = materialise(wide.withColumn("block", block).groupBy("conv", "block").applyInPandas(clean, PARTS), "stretches")
        if not more:
            return parts


def finished(parts: DataFrame) -> DataFrame:
    def run(batches):
        for b in batches:
            out = []
            for p in b.to_pylist():
                ends = [(p["costs"][q], p["audits"][q]) for q in ACCEPTED if p["costs"][q] is not None]
                out.append(summed(p["conv"], p, *min(ends)))
            yield columns(out, FOUND)

    return map_batches(parts, run, FOUND)


def streamed(rows: DataFrame, found: DataFrame, fn, schema: str) -> DataFrame:
    """fn over partitions in which each conversation's row of `found` comes before its turns in order."""
    ids = found.select("conv", F.lit(True).alias("met"))
    turns = join_small(rows, ids, "conv", "inner").select(F.lit(1).alias("kind"), *ORDER, "copies", F.lit(None).cast("string").alias("audit"))
    heads = found.select(F.lit(0).alias("kind"), "conv", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"), "audit")
    dealt = heads.unionByName(turns).repartition("conv").sortWithinPartitions("conv", "kind", "turn", "role", "text")
    return map_batches(dealt.select("kind", "conv", "role", "text", "copies", "audit"), fn, schema)


def _hashes(batches):
    conv = walk = out = None
    for kind, name, role, text, copies, audit in _rows(batches):
        if not kind:
            if out:
                yield {"conv": [conv], "repaired_sha256": [out.sha.hexdigest()]}
            conv, walk, out = name, Walk(audit), Digest()
            out.add(walk.inserted())
        else:
            out.add(walk.turn(role, text, copies))
    if out:
        yield {"conv": [conv], "repaired_sha256": [out.sha.hexdigest()]}


def _repaired(batches):
    conv, walk, position, out = None, None, 0, {"conv": [], "position": [], "role": [], "text": []}
    for kind, name, role, text, copies, audit in _rows(batches):
        if not kind:
            conv, walk, position = name, Walk(audit), 0
        for r, t in walk.turn(role, text, copies) if kind else walk.inserted():
            for k, v in zip(out, (conv, position, r, t)):
                out[k].append(v)
            position += 1
        if len(out["conv"]) >= 512:
            yield out
            out = {k: [] for k in out}
    yield out


def _id(df: DataFrame) -> DataFrame:
    return df.select(F.when(F.col("conv") != "null", F.col("conv").cast("long")).alias("conv_id"), *(c for c in df.columns if c != "conv"))


def _found(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Results of conversations that one stretch holds, and FOUND of the others."""
    scanned, _ = materialise(scan(rows), "scanned")
    names = [x.split()[0] for x in FOUND.split(", ")]
    whole = scanned.filter("repaired_sha256 IS NOT NULL").select(*names, "repaired_sha256")
    parts = scanned.filter("repaired_sha256 IS NULL").select(*(x.split()[0] for x in PARTS.split(", ")))
    return whole, materialise(finished(multiplied(parts)), "audits")[0]


def repair(turns: DataFrame) -> DataFrame:
    """Per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    turns has conv_id, turn, role, text and, if it likes, copies (a turn of 0 copies isn't there, but its conversation is). Turns go by
    number, nulls first; ties by role and text. Equal rows are copies of one turn. A null role or text is one space (so a null text is
    blank, a null role none of the three); turns of a null conv_id are one conversation; an empty table gives no rows; other columns are ignored.
    A conversation that lies in one stretch is done there; others are multiplied from stretches of at most STRETCH turns, and their turns
    stream once more through the task that digests them (a digest of one text is sequential; what that task holds is an audit, not the turns).
    """
    rows = ordered(turns)
    whole, found = _found(rows)
    hashes = streamed(rows, found, _hashes, "conv string, repaired_sha256 string")
    return _id(whole.unionByName(found.join(hashes, "conv")))


def repaired(turns: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, position (from 0), role, text; of conversations of which nothing stays there is no row."""
    rows = ordered(turns)
    whole, found = _found(rows)
    return _id(streamed(rows, whole.select(*found.columns).unionByName(found), _repaired, "conv string, position long, role string, text string"))
