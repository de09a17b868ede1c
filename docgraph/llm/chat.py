"""Chat formatting by columnar byte assembly."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docgraph.llm.common import utf8

# Fixed values of the template: what stands before and after a turn of each role; other roles are named in the mark.
MARKS = {"user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>"), "system": ("[SYS] ", " [/SYS]")}
# Inside texts the characters that begin a mark are written as escapes, so no text can contain one.
ESCAPES = {"\\": "\\\\", "<": "\\l", "[": "\\b", "]": "\\c"}
_CODE = np.zeros(256, np.uint8)
for _k, _v in ESCAPES.items():
    if _k != "]":
        _CODE[ord(_k)] = ord(_v[1])
_UNDO = {v[1]: k for k, v in ESCAPES.items()}
_TURN = re.compile(r"\[INST\] ([^<\[]*) \[/INST\]|<s>([^<\[]*)</s>|\[SYS\] ([^<\[]*) \[/SYS\]|\[TURN:([^<\[\]]*)\] ([^<\[]*) \[/TURN\]")
_SCHEMA = "conv_id long, n_turns long, formatted string, loss array<long>"


def _marks(role: str) -> tuple[bytes, bytes]:
    before, after = MARKS.get(role) or ("[TURN:" + "".join(ESCAPES.get(c, c) for c in role) + "] ", " [/TURN]")
    return before.encode(), after.encode()


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: _UNDO[m[1]], text) if "\\" in text else text


def _scatter(out: np.ndarray, to: np.ndarray, source: np.ndarray, begin: np.ndarray, size: np.ndarray) -> None:
    """Copies pieces of source to their places in out."""
    within = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    out[np.repeat(to, size) + within] = source[np.repeat(begin, size) + within]


def assemble(table: pa.Table) -> pa.RecordBatch:
    """Whole conversations, rows in order, as formatted texts and loss masks: every byte is placed once, in one buffer."""
    conv = table.column("conv_id").to_numpy()
    buf, off = utf8(table.column("text"))
    roles = pc.dictionary_encode(table.column("role").combine_chunks())
    code = roles.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = roles.dictionary.to_pylist()
    marks = [_marks(r) for r in names]
    heads, tails = b"".join(a for a, _ in marks), b"".join(b for _, b in marks)
    head_size, tail_size = np.array([len(a) for a, _ in marks], np.int64), np.array([len(b) for _, b in marks], np.int64)
    # lengths: header, escaped text, footer of each turn; their running sum places them
    special = _CODE[buf] > 0
    before = np.r_[0, np.cumsum(special)]
    size = np.diff(off) + before[off[1:]] - before[off[:-1]]
    lengths = np.stack([head_size[code], size, tail_size[code]], 1)
    if lengths.sum() >= 1 << 31:
        raise OverflowError("a conversation's formatted text has 2 GiB or more, which no string column holds")
    place = (np.cumsum(lengths) - lengths.ravel()).reshape(-1, 3)
    out = np.empty(int(lengths.sum()), np.uint8)
    _scatter(out, place[:, 0], np.frombuffer(heads, np.uint8), (np.cumsum(head_size) - head_size)[code], lengths[:, 0])
    _scatter(out, place[:, 2], np.frombuffer(tails, np.uint8), (np.cumsum(tail_size) - tail_size)[code], lengths[:, 2])
    to = np.repeat(place[:, 1] - off[:-1] - before[off[:-1]], np.diff(off)) + np.arange(len(buf)) + before[:-1]
    out[to] = np.where(special, np.uint8(92), buf)
    out[to[special] + 1] = _CODE[buf[special]]
    # the mask in code points, from each conversation's start
    chars = np.r_[0, np.cumsum((out & 0xC0) != 0x80)]
    first = np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]])
    turns = np.diff(np.r_[first, len(conv)])
    begin = place[first, 0]
    ends = np.r_[begin[1:], len(out)]
    is_assistant = np.array([n == "assistant" for n in names], bool)[code]
    base = np.repeat(chars[begin], turns)
    spans = np.stack([chars[place[:, 1]] - base, chars[place[:, 1] + size] - base], 1)
    rows = np.flatnonzero(is_assistant)
    per = np.add.reduceat(is_assistant.astype(np.int64), first)
    loss = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(2 * per)].astype(np.int32)), pa.array(spans[rows].ravel()))
    text = pa.StringArray.from_buffers(len(first), pa.py_buffer(np.r_[begin, ends[-1:]].astype(np.int32)), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays([pa.array(conv[first]), pa.array(turns.astype(np.int64)), text, loss], ["conv_id", "n_turns", "formatted", "loss"])


def _pieces(batches):
    """Tables of whole conversations from batches sorted by conversation: a batch's last one waits for its end."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        ids = batch.column(0).to_numpy()
        cut = int(np.searchsorted(ids, ids[-1]))
        if cut or (held and held[-1].column(0)[-1].as_py() != ids[0]):
            yield pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])])
            held = []
        held.append(batch.slice(cut))
    if held:
        yield pa.Table.from_batches(held)


def _bounded(table: pa.Table, most: int = 1 << 29):
    """The table in runs of whole conversations of at most so many bytes of text, or of one conversation where it has more."""
    conv, size = table.column("conv_id").to_numpy(), pc.fill_null(pc.binary_length(table.column("text")), 0).to_numpy().astype(np.int64)
    first = np.r_[np.flatnonzero(np.r_[True, conv[1:] != conv[:-1]]), len(conv)]
    upto = np.r_[0, np.cumsum(size)][first]
    i = 0
    while i < len(first) - 1:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, side="right")) - 1)
        yield table.slice(first[i], first[j] - first[i])
        i = j


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss) per conversation of rows (conv_id, turn, role, text, ...).

    Turns stand in the order of turn (null first), then role and text. loss: begin and end code point in `formatted` of each
    assistant text, in turn. Control strings inside texts are escaped and come back by `read_back`. Null texts and roles
    are empty; rows without conv_id are one conversation of their own, with null id; repeated rows are turns of their own;
    an empty table gives no rows. Rows are dealt by conv_id and sorted by Spark; a task holds a batch and one conversation.
    A conversation whose formatted text would have 2 GiB or more raises, as no string holds it.
    """
    none = F.lit(-(1 << 63))
    t = rows.select(F.coalesce(F.col("conv_id").cast("long"), none).alias("conv_id"), F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    t = t.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    out = t.mapInArrow(lambda batches: (assemble(y) for x in _pieces(batches) for y in _bounded(x)), _SCHEMA)
    return out.withColumn("conv_id", F.nullif("conv_id", none))


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted conversation. Raises ValueError where it is not one."""
    out, at = [], 0
    for m in _TURN.finditer(formatted):
        if m.start() != at:
            break
        at = m.end()
        user, assistant, system, role, other = m.groups()
        name = next((n for n, x in (("user", user), ("assistant", assistant), ("system", system)) if x is not None), None)
        out.append((name, unescape(next(x for x in (user, assistant, system) if x is not None))) if name else (unescape(role), unescape(other)))
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return out


def digests(formatted: DataFrame) -> DataFrame:
    """What the formatted texts and masks say when read back: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""

    def run(batches):
        for batch in batches:
            rows = []
            for text, loss in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                turns = read_back(text)
                said = [unescape(text[a:b]) for a, b in zip(loss[::2], loss[1::2])]
                rows.append((len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), sum(map(len, said)), hashlib.sha256("".join(said).encode()).hexdigest(), len(text)))
            n, turns, chars, said, size = zip(*rows) if rows else [()] * 5
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, k) for x, k in zip((n, turns, chars, said, size), kinds))], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return formatted.select("conv_id", "formatted", "loss").mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
