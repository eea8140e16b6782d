"""Repair of the structure of conversations: the cheapest edits that give an optional system turn and then
pairs of user and assistant, by dynamic programming over single big integers."""

from __future__ import annotations

from collections import Counter
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_slices

_BLANK = " \t\n\x0b\x0c\r"
#: Costs of edits, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
#: Digits of the audit letters, in the order of the letters; 0 pads the end. Three bits hold one.
_LETTERS = " DIKR"
_D, _I, _K, _R = 1, 2, 3, 4
_BITS = 3
#: States by what has been written: nothing, system, user, assistant. From each, what comes next.
_START, _SYSTEM, _USER, _ASSISTANT = range(4)
_NEXT = (_USER, _USER, _ASSISTANT, _USER)
_ROLE = {_USER: "user", _ASSISTANT: "assistant"}
#: Fault of a row, and what a row says to the program: its role's initial and its fault.
GOOD, BLANK, DUPLICATE, CUT_OFF = range(4)


def _after(state: int, initial: str) -> int | None:
    """State after a kept row, if it may stand there."""
    if initial == "s":
        return _SYSTEM if state == _START else None
    return {"u": _USER, "a": _ASSISTANT}.get(initial) if _NEXT[state] == {"u": _USER, "a": _ASSISTANT}.get(initial) else None


def cheapest(rows: list[tuple[str, int]]) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of rows (initial of the role, fault), audits at a tie by ASCII.

    A weight is one integer: its high digits are the cost, its low digits, as many as an audit can have
    letters, are the letters left-aligned, with zeros after the end, so that the lesser integer is the cheaper
    edit and at a tie the audit that comes first, whatever the lengths. The best weight of all that follows a
    row is found from the last row to the first, for each state: an edit adds its cost to the high digits,
    moves the low ones by one place and writes its letter before them. At most two insertions stand in one gap
    (a third leads to a state that one of them reaches)."""
    width = _BITS * (3 * len(rows) + 2)
    low, top = (1 << width) - 1, width - _BITS

    def before(weight: int, cost: int, letter: int) -> int:
        return (((weight >> width) + cost) << width) | (letter << top) | ((weight & low) >> _BITS)

    def gap(best: list[int | None]) -> list[int | None]:
        out = []
        for state in range(4):
            ways = [best[state]]
            one, two = best[_NEXT[state]], best[_NEXT[_NEXT[state]]]
            if one is not None:
                ways.append(before(one, INSERT, _I))
            if two is not None:
                ways.append(before(before(two, INSERT, _I), INSERT, _I))
            out.append(min((w for w in ways if w is not None), default=None))
        return out

    best = gap([0, None, None, 0])
    for initial, fault in reversed(rows):
        must_go, stays = fault in (BLANK, DUPLICATE), TRUNCATED if fault == CUT_OFF else 0
        here = []
        for state in range(4):
            ways = [before(best[state], DELETE, _D)]
            if not must_go:
                kept = _after(state, initial)
                if kept is not None:
                    ways.append(before(best[kept], stays, _K))
                ways.append(before(best[_NEXT[state]], stays + REROLE, _R))
            here.append(min(ways))
        best = gap(here)
    weight = best[_START]
    digits, audit = weight & low, []
    while digits:
        audit.append(_LETTERS[digits >> top])
        digits = (digits << _BITS) & low
    return weight >> width, "".join(audit)


@lru_cache(1 << 14)
def _short(rows: tuple[tuple[str, int], ...]) -> tuple[int, str]:
    """Short conversations often ask the same."""
    return cheapest(list(rows))


def apply_edits(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """The repaired turns; the letters and the state decide the roles that edits give."""
    out, state, rows = [], _START, iter(turns)
    for letter in audit:
        if letter == "I":
            role, text = _ROLE[_NEXT[state]], ""
        else:
            role, text = next(rows)
            if letter == "D":
                continue
            if letter == "R":
                role = _ROLE[_NEXT[state]]
        out.append((role, text))
        state = _SYSTEM if letter == "K" and role[:1] == "s" else _NEXT[state]
    return out


def faults(turns: list[tuple[str, str]]) -> list[int]:
    """The first fault of each turn (role, text): blank, a role and text seen before, or cut off."""
    seen: set[tuple[str, str]] = set()
    out = []
    for role, text in turns:
        said = text.rstrip(_BLANK)
        out.append(BLANK if not said else DUPLICATE if (role, text) in seen else CUT_OFF if said[-1] not in ".!?" else GOOD)
        seen.add((role, text))
    return out


def repair(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", present: str | None = None) -> DataFrame:
    """One row for each conversation: conv_id (from key), gaps, blank, duplicate, truncated, illegal, cost,
    audit, and its repaired turns (role, text).

    Rows go by turn, NULL first, at a tie by role and text; repeated rows are duplicates. NULL roles and texts
    are empty, so such texts are blank. `present` may name a boolean column: rows where it is not true are no
    turns, they only name their conversation, which then has a row in any case. A NULL key is one conversation;
    other columns are not read, whatever their names; an empty table gives an empty result. One conversation is
    repaired in one task and needs memory for its turns and for 4 numbers of 9 bits a turn, whatever its
    texts; time grows with the square of its turns."""
    c = lambda name: F.col(f"`{name}`")
    there = F.lit(True) if present is None else F.coalesce(c(present), F.lit(False))
    few = rows.select(c(key).alias("conv_id"), c(turn).cast("long").alias("turn"), F.coalesce(c(role), F.lit("")).alias("role"), F.coalesce(c(text), F.lit("")).alias("text"), there.alias("there"))
    ordered = few.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    turns_type = T.ArrayType(T.StructType([T.StructField("role", T.StringType()), T.StructField("text", T.StringType())]))
    schema = T.StructType([ordered.schema["conv_id"], *[T.StructField(n, T.LongType()) for n in counts], T.StructField("audit", T.StringType()), T.StructField("turns", turns_type)])
    arrow_turns = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))

    def one(numbers: list, turns: list[tuple[str, str]]):
        known = [n for n in numbers if n is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        found = faults(turns)
        each = Counter(found)
        program = [(r[:1] if r[:1] in ("s", "u", "a") else "", f) for (r, _), f in zip(turns, found, strict=True)]
        illegal = sum(a + b not in ("su", "ua", "au") for (a, _), (b, _) in zip(program, program[1:], strict=False))
        cost, audit = _short(tuple(program)) if len(program) <= 32 else cheapest(program)
        fixed = apply_edits(turns, audit)
        return gaps, each[BLANK], each[DUPLICATE], each[CUT_OFF], illegal, cost, audit, [{"role": r, "text": t} for r, t in fixed]

    def run(it):
        for table, _ in key_slices(it, "conv_id", "text"):
            keys, out = table["conv_id"].to_pylist(), []
            numbers, there_, roles, texts = (table[n].to_pylist() for n in ("turn", "there", "role", "text"))
            at = 0
            while at < len(keys):
                to = at
                while to < len(keys) and keys[to] == keys[at]:
                    to += 1
                inside = [i for i in range(at, to) if there_[i]]
                out.append((keys[at], *one([numbers[i] for i in inside], [(roles[i], texts[i]) for i in inside])))
                at = to
            columns = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], table["conv_id"].type), *[pa.array(v, pa.int64()) for v in columns[1:7]], pa.array(columns[7], pa.string()), pa.array(columns[8], arrow_turns)], schema.names)

    return ordered.mapInArrow(run, schema)
