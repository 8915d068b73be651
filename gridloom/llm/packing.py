"""Packs tokenized documents into training sequences by first-fit decreasing."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._base import bounded, slices
from gridloom.llm.fasttok import SLICE_BYTES, Encoder

SCHEMA = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Each item's bin, 0 to n - 1; sizes are at most ``capacity``.

    Items go by falling size (ties: given order) into the first bin with room. A tournament tree
    holds in each inner node the larger free room of its children, so the first bin with room is
    found, and its path renewed, in log n steps.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    room = [capacity] * (2 * leaves)
    bins = np.zeros(n, np.int64)
    for item in np.argsort(-np.asarray(sizes, np.int64), kind="stable").tolist():
        need, node = int(sizes[item]), 1
        while node < leaves:
            node *= 2
            if room[node] < need:
                node += 1
        bins[item] = node - leaves
        room[node] -= need
        node >>= 1
        while node:
            left, right = room[2 * node], room[2 * node + 1]
            best = left if left > right else right
            if room[node] == best:
                break
            room[node] = best
            node >>= 1
    return bins


def place(lengths: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Pieces of one group of documents: document, start, length, sequence and offset of each.

    A document longer than ``capacity`` gives full pieces, each a sequence of its own, and a rest;
    rests and shorter documents are packed by :func:`first_fit_decreasing`.
    """
    full, rest = lengths // capacity, lengths % capacity
    pieces = full + (rest > 0)
    doc = np.repeat(np.arange(len(lengths)), pieces)
    number = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    size = np.where(number < full[doc], capacity, rest[doc])
    loose = np.flatnonzero(number >= full[doc])
    sequence = np.zeros(len(doc), np.int64)
    whole = np.flatnonzero(number < full[doc])
    sequence[whole] = np.arange(len(whole))
    bins = first_fit_decreasing(size[loose], capacity)
    sequence[loose] = len(whole) + bins
    order = np.lexsort((np.arange(len(doc)), -size, sequence))
    inside = np.cumsum(size[order]) - size[order]
    opens = np.concatenate([[True], sequence[order][1:] != sequence[order][:-1]]) if len(order) else np.zeros(0, bool)
    offset = np.empty(len(doc), np.int64)
    offset[order] = inside - np.repeat(inside[opens], np.diff(np.append(np.flatnonzero(opens), len(order))))
    return {"doc": doc, "start": number * capacity, "length": size, "sequence": sequence, "offset": offset}


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", group_tokens: int = 4_000_000) -> DataFrame:
    """Tokenize whole texts and pack them; one row a piece, with the piece's ids.

    Rows are dealt out by a hash of id and text, so each partition is a random part of the table;
    within it, documents in hash order form groups of about ``group_tokens`` ids, and each group
    is packed on its own. A task holds one group, or one text and its ids. All copies of one row are in one task. ``ids`` are little-endian unsigned 32-bit
    integers. A sequence shorter than ``capacity`` is padded to it by whoever lays it out, unless
    its length is a power of two; padding isn't in the rows. A null text is empty: its one piece is the end
    id. A null id stays null, repeated rows are packed once each, other columns aren't read. An
    empty table gives no row. Sequence ids are unique: partition times 2**33 plus a number.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("k", "t"))
    rows = rows.repartition("h").sortWithinPartitions("h").select("k", "t")

    def run(batches):
        with Encoder.opened(tokenizer) as encoder:
            yield from packed(batches, encoder)

    def packed(batches, encoder):
        base = TaskContext.get().partitionId() << 33
        keys, flat, per, held = [], [], [], 0

        def close():
            nonlocal base, held
            ids, lengths = np.concatenate(flat), np.concatenate(per)
            got = place(lengths, capacity)
            ends = np.concatenate([[0], np.cumsum(got["length"])])
            column = pa.concat_arrays(keys).take(pa.array(got["doc"]))
            data = pa.py_buffer(np.ascontiguousarray(ids, "<u4"))
            long = lambda x: pa.array(x, pa.int64())
            binary = pa.BinaryArray.from_buffers(pa.binary(), len(column), [None, pa.py_buffer((4 * ends).astype(np.int32)), data])
            out = pa.RecordBatch.from_arrays([column, long(got["start"]), long(got["length"]), binary, long(lengths[got["doc"]]), long(base + got["sequence"]), long(got["offset"])], [x.split()[0] for x in SCHEMA.split(", ")])
            base += int(got["sequence"].max()) + 1
            for x in (keys, flat, per):
                x.clear()
            held = 0
            return out

        for batch in batches:
            for part in slices(batch, "t", SLICE_BYTES):
                ids, lengths = encoder.encode(part.column("t"), end_id)
                keys.append(part.column("k"))
                flat.append(ids)
                per.append(lengths)
                held += len(ids)
                if held >= group_tokens:
                    yield close()
        if flat:
            yield close()

    return rows.mapInArrow(run, SCHEMA)


def packed_digests(docs: DataFrame, tokenizer: str, capacity: int = 4096, end_id: int = 2) -> DataFrame:
    """One row a piece with the CRC of its ids in place of the ids."""
    return pack(docs, tokenizer, capacity, end_id).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
