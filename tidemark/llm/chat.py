"""Chat formatting by columnar byte assembly: lengths of segments, running offsets and scatter indices in
numpy; heads and contents of all turns go into one preallocated Arrow buffer."""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import key_slices, runs

#: Bytes of text put together at once, and of a conversation above which it is given in parts.
PART_BYTES = 1 << 22
_BACKSLASH = 92


@dataclass(frozen=True)
class Template:
    """A turn is mark + label + colon + escaped text + end. Roles without a label are written as "=" and the
    escaped role. A backslash goes before each backslash of a text, before each "#" that starts the mark and
    before each "<" that starts the end; in roles before each ":" too."""

    mark: str = "###"
    colon: str = ": "
    stop: str = "</turn>"
    labels: tuple[tuple[str, str], ...] = (("system", "System"), ("user", "User"), ("assistant", "Assistant"))
    learned: tuple[str, ...] = ("assistant",)

    def head(self, role: str) -> bytes:
        known = dict(self.labels).get(role)
        if known is None:
            controls = "|".join(re.escape(c[0]) + f"(?={re.escape(c[1:])})" for c in (self.mark, self.stop))
            known = "=" + re.sub(rf"\\|:|{controls}", lambda m: "\\" + m[0], role)
        return f"{self.mark} {known}{self.colon}".encode()

    @property
    def end(self) -> bytes:
        return f"{self.stop}\n".encode()


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of a column of strings, and the offsets of its values in them; NULL counts as empty."""
    column = pc.fill_null(column, "")
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = column.buffers()[2]
    return (np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.empty(0, np.uint8)), offsets - offsets[0]


def _escaped(data: np.ndarray, offsets: np.ndarray, controls: tuple[bytes, ...]) -> np.ndarray:
    """Positions before which a backslash goes: backslashes, and starts of control strings within one text."""
    found = [np.flatnonzero(data == _BACKSLASH)]
    for c in controls:
        at = np.flatnonzero(data == c[0])
        at = at[at + len(c) <= len(data)]
        for i in range(1, len(c)):
            at = at[data[at + i] == c[i]]
        found.append(at[at + len(c) <= offsets[np.searchsorted(offsets, at, "right")]])
    return np.sort(np.concatenate(found))


def _scatter(out: np.ndarray, starts: np.ndarray, pieces: list[bytes], which: np.ndarray) -> None:
    """Copies pieces[which[i]] to starts[i] for all i."""
    flat, size = np.frombuffer(b"".join(pieces), np.uint8), np.array([len(p) for p in pieces], np.int64)
    first, n = (np.cumsum(size) - size)[which], size[which]
    within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    out[np.repeat(starts, n) + within] = flat[np.repeat(first, n) + within]


def assemble(roles: pa.Array, texts: pa.Array, template: Template = Template()) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All turns, one after the other, as bytes; each turn's start; start and length of its escaped text."""
    data, offsets = _bytes_of(texts)
    known = pc.fill_null(roles, "").dictionary_encode()
    which, heads = known.indices.to_numpy(zero_copy_only=False), [template.head(r) for r in known.dictionary.to_pylist()]
    size = np.diff(offsets)
    marks = _escaped(data, offsets, (template.mark.encode(), template.stop.encode()))
    before = np.searchsorted(marks, offsets)
    body = size + np.diff(before)
    head = np.array([len(h) for h in heads], np.int64)[which]
    edge = np.concatenate(([0], np.cumsum(head + body + len(template.end))))
    starts, out = edge[:-1], np.empty(edge[-1], np.uint8)

    _scatter(out, starts, heads, which)
    _scatter(out, edge[1:] - len(template.end), [template.end], np.zeros(len(size), np.int64))
    place = np.arange(len(data)) + np.repeat(starts + head - offsets[:-1] - before[:-1], size)
    if len(marks):
        step = np.zeros(len(data), np.int64)
        step[marks] = 1
        place += np.cumsum(step)
    out[place] = data
    out[place[marks] - 1] = _BACKSLASH
    return out, edge, starts + head, body


def format_chats(rows: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", template: Template = Template(), part_bytes: int = PART_BYTES) -> DataFrame:
    """conv_id (from key), part, n_turns, formatted, loss: the turns of each conversation as one text, and the
    places (start, length in UTF-8 bytes) of the escaped texts of learned roles in it.

    Turns go by turn, NULL first, at a tie by role and text; repeated rows are all written; NULL texts and
    roles are empty; a NULL key is one conversation. A conversation of more than part_bytes comes in several
    rows, cut between turns and numbered by part, so memory is bounded by that and by the longest text. Other
    columns are not read, whatever their names; an empty table gives an empty result. The rows of one
    conversation stand one after the other in one partition."""
    few = rows.select(F.col(f"`{key}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"), F.col(f"`{role}`").alias("role"), F.col(f"`{text}`").alias("text"))
    ordered = few.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    kind = ordered.schema["conv_id"]
    place = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())])
    schema = T.StructType([kind, T.StructField("part", T.IntegerType()), T.StructField("n_turns", T.LongType()), T.StructField("formatted", T.StringType()), T.StructField("loss", T.ArrayType(place))])

    def run(it):
        part, last = 0, None  # of the conversation that goes on
        for table, goes_on in key_slices(it, "conv_id", "text", part_bytes):
            first = runs(table["conv_id"])
            out, edge, at, size = assemble(table["role"], table["text"], template)
            turns = np.diff(np.append(first, len(table)))
            learned = np.flatnonzero(pc.is_in(table["role"], pa.array(template.learned)).to_numpy(zero_copy_only=False))
            at = (at - np.repeat(edge[first], turns))[learned]
            lists = np.append(np.searchsorted(learned, first), len(learned))
            places = pa.StructArray.from_arrays([pa.array(at, pa.int64()), pa.array(size[learned], pa.int64())], ["start", "length"])
            parts = np.zeros(len(first), np.int32)
            parts[0] = part if part and table["conv_id"][0].as_py() == last else 0
            part, last = (int(parts[-1]) + 1, table["conv_id"][len(table) - 1].as_py()) if goes_on else (0, None)
            formatted = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.append(edge[first], edge[-1]).astype(np.int32)), pa.py_buffer(out))
            yield pa.RecordBatch.from_arrays([table["conv_id"].take(pa.array(first)), pa.array(parts), pa.array(turns, pa.int64()), formatted, pa.ListArray.from_arrays(pa.array(lists, pa.int32()), places)], schema.names)

    return ordered.mapInArrow(run, schema)


def _unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


def read_turns(formatted: str, template: Template = Template()):
    """The turns (role, text) of a formatted text. Raises ValueError where it is none."""
    mark, colon, stop = (re.escape(x) for x in (template.mark, template.colon, template.stop))
    a = re.escape(template.stop[0])
    turn = re.compile(rf"{mark} (=?)([^\\:]*+(?:\\.[^\\:]*+)*+){colon}([^\\{a}]*+(?:(?:\\.|(?!{stop}){a})[^\\{a}]*+)*+){stop}\n", re.S)
    roles, at = {label: role for role, label in template.labels}, 0
    while at < len(formatted):
        m = turn.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        yield _unescape(m[2]) if m[1] else roles[m[2]], _unescape(m[3])


def read_loss(formatted: bytes, places) -> list[str]:
    """The texts under the loss mask, unescaped."""
    return [_unescape(formatted[p["start"] : p["start"] + p["length"]].decode()) for p in places]


def digests(chats: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars of what format_chats gives,
    read back from its texts and places alone; parts are taken one after the other."""
    import hashlib

    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [chats.schema["conv_id"].dataType, T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType()]
    schema = T.StructType([T.StructField(n, k) for n, k in zip(names, kinds, strict=True)])

    def run(it):
        open_ = None  # key, turns, hash of turns, characters and hash of the loss, characters

        def batch(done):
            return pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa_kind), *[pa.array(v) for v in zip(*[(d[1], d[2].hexdigest(), d[3], d[4].hexdigest(), d[5]) for d in done], strict=True)]], names)

        pa_kind = None
        for b in it:
            pa_kind, done = b.column(0).type, []
            for key, part, text, loss in zip(b.column("conv_id").to_pylist(), b.column("part").to_pylist(), b.column("formatted").to_pylist(), b.column("loss").to_pylist(), strict=True):
                if part == 0:
                    if open_ is not None:
                        done.append(open_)
                    open_ = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, said in read_turns(text, template):
                    open_[1] += 1
                    open_[2].update(f"{role}\n{said}\n".encode())
                for said in read_loss(text.encode(), loss):
                    open_[3] += len(said)
                    open_[4].update(said.encode())
                open_[5] += len(text)
            if done:
                yield batch(done)
        if open_ is not None:
            yield batch([open_])

    return chats.mapInArrow(run, schema)
