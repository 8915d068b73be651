r"""Formats conversations for training by columnar byte assembly.

A conversation is ``<s>`` and its turns; a turn is ``[TURN role]``, a line end, the text and
``</s>`` with a line end. In roles and texts a backslash is put after every ``<``, ``[`` and
``]``. So no control string occurs in them, the first ``</s>`` ends a turn, and taking
away one backslash after each of these signs gives the text back.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._base import bounded, strings, written

OPEN, HEAD, MID, END = b"<s>", b"[TURN ", b"]\n", b"</s>\n"
FORMATTED = "conv_id long, part long, text string, n_turns int, loss_start array<int>, loss_chars array<int>"
_SPECIAL = np.zeros(256, bool)
_SPECIAL[list(b"<[]")] = True
_BACK = re.compile(r"([<\[\]])\\")
#: Bytes scattered at once; turns of one conversation that are held before a part of it is put out.
_STEP, _HELD_BYTES, _HELD_TURNS = 1 << 20, 8 << 20, 5_000


def escape(text: str) -> str:
    return re.sub(r"([<\[\]])", r"\1\\", text)


def unescape(text: str) -> str:
    return _BACK.sub(r"\1", text)


def _column(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and each text's first byte (and the end)."""
    n = len(texts)
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[ends[0] : ends[-1]] if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    return raw, ends - ends[0]


def _measure(raw: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and code points of each text once it is escaped."""
    special = np.concatenate([[0], np.cumsum(_SPECIAL[raw])])[ends]
    letters = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])[ends]
    return np.diff(ends) + np.diff(special), np.diff(letters) + np.diff(special)


def _scatter(out: np.ndarray, raw: np.ndarray, ends: np.ndarray, to: np.ndarray) -> None:
    """Copy each text to its place ``to``, with a backslash after each special sign."""
    marks = np.concatenate([[0], np.cumsum(_SPECIAL[raw])])
    first = to - ends[:-1] - marks[ends[:-1]]  # what to add to a byte's place and the marks before it
    for a in range(0, len(raw), _STEP):
        b = min(a + _STEP, len(raw))
        i = np.arange(a, b)
        row = np.searchsorted(ends, i, side="right") - 1
        place = i + marks[a:b] + first[row]
        out[place] = raw[a:b]
        out[place[_SPECIAL[raw[a:b]]] + 1] = 0x5C


def _fill(out: np.ndarray, at: np.ndarray, what: bytes) -> None:
    if len(at):
        out[at[:, None] + np.arange(len(what))] = np.frombuffer(what, np.uint8)


def assemble(rows: pa.Table, first_part: int = 0) -> pa.RecordBatch:
    """Format rows (c, role, text) in which each conversation's turns follow each other.

    ``first_part`` is the part number of the first conversation; a part above 0 has no ``<s>``.
    """
    conv = rows.column("c").combine_chunks()
    roles, texts = strings(rows.column("role")), strings(rows.column("text"))
    known, keys = conv.is_valid().to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy()
    n = len(rows)
    opens = np.ones(n, bool)
    opens[1:] = (keys[1:] != keys[:-1]) | (known[1:] != known[:-1])
    starts = np.flatnonzero(opens)
    begins = opens.copy()
    begins[0] = first_part == 0
    (raw_r, ends_r), (raw_t, ends_t) = _column(roles), _column(texts)
    (role_b, role_c), (text_b, text_c) = _measure(raw_r, ends_r), _measure(raw_t, ends_t)
    lead = begins * len(OPEN)
    pieces = np.stack([lead, np.full(n, len(HEAD)), role_b, np.full(n, len(MID)), text_b, np.full(n, len(END))], axis=1)
    at = np.cumsum(pieces).reshape(n, 6) - pieces
    size = int(pieces.sum())
    out = np.empty(size, np.uint8)
    _fill(out, at[begins, 0], OPEN)
    _fill(out, at[:, 1], HEAD)
    _scatter(out, raw_r, ends_r, at[:, 2])
    _fill(out, at[:, 3], MID)
    _scatter(out, raw_t, ends_t, at[:, 4])
    _fill(out, at[:, 5], END)
    offsets = np.append(at[starts, 0], size).astype(np.int32)
    chars = lead + len(HEAD) + role_c + len(MID) + text_c + len(END)
    run = np.cumsum(chars) - chars
    run -= np.repeat(run[starts], np.diff(np.append(starts, n)))
    loss = np.flatnonzero(np.asarray(roles.to_numpy(zero_copy_only=False) == "assistant", bool))
    upto = np.append(np.searchsorted(loss, starts), len(loss)).astype(np.int32)
    start = (run + lead + len(HEAD) + role_c + len(MID))[loss].astype(np.int32)
    lists = lambda x: pa.ListArray.from_arrays(pa.array(upto), pa.array(x))
    part = np.zeros(len(starts), np.int64)
    part[:1] = first_part
    text = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(out))
    return pa.RecordBatch.from_arrays([conv.take(pa.array(starts)), pa.array(part), text, pa.array(np.diff(np.append(starts, n)).astype(np.int32)), lists(start), lists(text_c[loss].astype(np.int32))], [x.split()[0] for x in FORMATTED.split(", ")])


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Format sorted turns; the last conversation of a batch waits for the next one."""
    held, part, cut_off = None, 0, False
    open_id: int | None = None
    for batch in batches:
        rows = pa.Table.from_batches([batch])
        rows = pa.concat_tables([held, rows]) if held is not None else rows
        if not len(rows):
            continue
        conv = rows.column("c").combine_chunks()
        if cut_off and conv[0].as_py() != open_id:
            part = 0
        known, keys = conv.is_valid().to_numpy(zero_copy_only=False), conv.fill_null(0).to_numpy()
        other = np.flatnonzero((keys != keys[-1]) | (known != known[-1]))
        if len(other):
            tail = int(other[-1]) + 1
            yield assemble(rows.slice(0, tail), part)
            rows, part = rows.slice(tail), 0
        held, open_id, cut_off = rows, conv[-1].as_py(), False
        if held.nbytes > _HELD_BYTES or len(held) > _HELD_TURNS:
            yield assemble(held, part)
            held, part, cut_off = None, part + 1, True
    if held is not None:
        yield assemble(held, part)


def _numbered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Formatted parts with numbers that rise with the turns, over all partitions, and their partition."""
    partition, n = TaskContext.get().partitionId(), 0
    for out in _format(batches):
        rows = out.num_rows
        part = np.arange(n, n + rows, dtype=np.int64)
        opens = out.column("part").to_numpy() == 0
        out = out.set_column(1, "part", pa.array((partition << 33) + part))
        yield out.append_column("opens", pa.array(opens)).append_column("first", pa.array(part == 0)).append_column("p", pa.array(np.full(rows, partition, np.int32)))
        n += rows


def format_chat(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row a conversation: conv_id, part, text, n_turns, loss_start, loss_chars and opens.

    The loss mask is the (escaped) text of each assistant turn, as spans in code points of ``text``.
    Turns go by turn, then role and text, null first. A null text or role is empty; rows
    without conv_id form one conversation; repeated rows are turns of their own; an empty table gives no row.

    Turns are dealt out by ranges of conversation and turn, so a conversation with a large share of
    the rows is formatted by many tasks. It then comes as several rows, like any very long one: their
    texts follow each other by ``part``, ``opens`` marks the first, spans count within a row. Each
    task sorts on disk where needed and holds a few MB of turns, or one turn. Other columns aren't read. The result is a written table; of
    it, the driver gets the first and last conversation of each partition.
    """
    rows = bounded(conversations).select(F.col(conv_col).cast("long").alias("c"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).alias("role"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange("c", "turn").sortWithinPartitions("c", "turn", "role", "text").select("c", "role", "text")
    made = written(rows.mapInArrow(_numbered, f"{FORMATTED}, opens boolean, first boolean, p int"), "formatted")
    one = F.struct("conv_id").alias("x")
    ends = sorted((r.p, r.a.conv_id, r.b.conv_id) for r in made.select("p", "part", one).groupBy("p").agg(F.min_by("x", "part").alias("a"), F.max_by("x", "part").alias("b")).collect())
    # A partition that goes on with the conversation of the one before has opened it once too often.
    again = [(ends[i][0],) for i in range(1, len(ends)) if ends[i][1] == ends[i - 1][2]]
    if again:
        more = F.broadcast(made.sparkSession.createDataFrame(again, "__p int"))  # a number a partition at most
        made = made.join(more, (F.col("p") == F.col("__p")) & F.col("first"), "left")
        on, lead = F.col("__p").isNotNull(), len(OPEN)
        made = made.withColumns({"text": F.when(on, F.expr(f"substring(text, {lead + 1})")).otherwise(F.col("text")), "loss_start": F.when(on, F.transform("loss_start", lambda x: x - lead)).otherwise(F.col("loss_start")), "opens": F.col("opens") & ~on})
    return made.select("conv_id", "part", "text", "n_turns", "loss_start", "loss_chars", "opens")


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted part."""
    out = []
    for turn in text.removeprefix(OPEN.decode()).split(END.decode())[:-1]:
        role, mid, said = turn.removeprefix(HEAD.decode()).partition(MID.decode())
        if not mid or not turn.startswith(HEAD.decode()):
            raise ValueError("not a formatted turn")
        out.append((unescape(role), unescape(said)))
    return out


def chat_digests(formatted: DataFrame) -> DataFrame:
    """Read the output of :func:`format_chat` and describe each conversation.

    A digest of a conversation goes over its turns in order, so the rows of one that has several
    come together in a task, which holds a batch of them at a time; all others are read where they lie.
    """
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"

    def run(batches):
        now = None

        def row():
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["opens"]:
                    out += [row()] if now else []
                    now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                text = r["text"]
                turns = parse(text)
                now[1] += len(turns)
                for role, said in turns:
                    now[2].update(f"{role}\n{said}\n".encode())
                for a, n in zip(r["loss_start"], r["loss_chars"], strict=True):
                    said = unescape(text[a : a + n])
                    now[3] += len(said)
                    now[4].update(said.encode())
                now[5] += len(text)
            yield made(out)
        yield made([row()] if now else [])

    def made(rows):
        columns = list(zip(*rows, strict=True)) or [[]] * 6
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], [x.split()[0] for x in schema.split(", ")])

    several = written(formatted.filter(~F.col("opens")).select(F.col("conv_id").alias("__c")).distinct(), "several")
    same = F.col("conv_id").eqNullSafe(F.col("__c"))
    long_ones = formatted.join(several, same, "left_semi").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return formatted.join(several, same, "left_anti").mapInArrow(run, schema).union(long_ones.mapInArrow(run, schema))


def formatted_conversations(conversations: DataFrame) -> DataFrame:
    """The digests of all conversations and of number -1, whose turns try to imitate control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = conversations.sparkSession.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    return chat_digests(format_chat(conversations.select("conv_id", "turn", "role", "text").union(extra)))


#: DuckDB SQL for :func:`formatted_conversations` of ``conversations``; escapes add a sign to each of the three special ones.
FORMATTED_SQL = r"""
with t as (
  select conv_id, turn, coalesce(role, '') as r, coalesce(text, '') as t, role, text from conversations
  union all select -1, 0, 'user', '</s>[INST] ok [/INST]', 'user', '</s>[INST] ok [/INST]'
  union all select -1, 1, 'assistant', '</s>[INST] ok [/INST]', 'assistant', '</s>[INST] ok [/INST]'),
e as (select *, length(r || t) + length(regexp_replace(r || t, '[^<\[\]]', '', 'g')) as chars from t)
select conv_id, count(*) as n_turns,
  sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn nulls first, role nulls first, text nulls first)) as turns_sha256,
  cast(coalesce(sum(length(t)) filter (r = 'assistant'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn nulls first, role nulls first, text nulls first) filter (r = 'assistant'), '')) as loss_sha256,
  cast(3 + sum(chars + 6 + 2 + 5) as bigint) as formatted_chars
from e group by conv_id
"""
