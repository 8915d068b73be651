"""Token ids in binary files: fixed-size blocks, split into bit or byte planes, each compressed.

A shard file holds, in this order: the magic ``GLPLANE1``; for every block of ``block`` ids the
zstandard frames of its planes, lowest plane first; a frame with the documents' ids and lengths;
a frame with the chunk index (each block's offset and the lengths of its planes); a footer.
Any range of ids can be read by way of the index without touching other blocks.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._base import bounded, scratch, slices, strings, written
from gridloom.llm.fasttok import SLICE_BYTES, Encoder

MAGIC = b"GLPLANE1"
#: Bytes of ids that are read back at once.
BATCH_BYTES = 4 << 20
_FOOTER = struct.Struct("<QQQQQIB3x8s")  # documents at, index at, ids, documents, blocks, block size, planes, magic


def to_planes(ids: np.ndarray, planes: str) -> list[bytes]:
    """The 4 byte planes or 32 bit planes of unsigned 32-bit ids."""
    rows = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if planes == "byte":
        return [np.ascontiguousarray(rows[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(rows, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(parts: list[bytes], n: int) -> np.ndarray:
    """The ids whose planes these are; 4 parts count as byte planes, 32 as bit planes."""
    if len(parts) == 4:
        return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in parts], axis=1)).view("<u4").reshape(-1)
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in parts], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Writes one shard; it holds one block of ids and the documents' lengths."""

    def __init__(self, out, block: int = 1 << 16, planes: str = "byte", level: int = 3):
        if planes not in ("bit", "byte"):
            raise ValueError("planes is 'bit' or 'byte'")
        self.out, self.block, self.planes = out, block, planes
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.at, self.rest, self.index = len(MAGIC), np.zeros(0, np.uint32), []
        self.keys, self.known, self.lengths, self.total = [], [], [], 0
        out.write(MAGIC)

    def add(self, ids: np.ndarray, keys: np.ndarray, known: np.ndarray, lengths: np.ndarray) -> None:
        """Append documents: their ids one after another, their keys, which keys aren't null, lengths."""
        self.keys.append(keys.astype("<i8"))
        self.known.append(known.astype(np.uint8))
        self.lengths.append(lengths.astype("<u8"))
        self.total += len(ids)
        ids = np.concatenate([self.rest, ids]) if len(self.rest) else ids
        whole = len(ids) // self.block * self.block
        for k in range(0, whole, self.block):
            self._block(ids[k : k + self.block])
        self.rest = ids[whole:].copy()

    def _block(self, ids: np.ndarray) -> None:
        frames = [self.pack(p) for p in to_planes(ids, self.planes)]
        self.index.append((self.at, *map(len, frames)))
        for x in frames:
            self.out.write(x)
            self.at += len(x)

    def close(self) -> None:
        if len(self.rest):
            self._block(self.rest)
        join = lambda parts, kind: np.concatenate([np.zeros(0, kind), *parts]).astype(kind).tobytes()
        n = sum(map(len, self.keys))
        docs = self.pack(join(self.keys, "<i8") + join(self.lengths, "<u8") + join(self.known, np.uint8))
        index = self.pack(np.array(self.index, "<u8").tobytes())
        self.out.write(docs)
        self.out.write(index)
        self.out.write(_FOOTER.pack(self.at, self.at + len(docs), self.total, n, len(self.index), self.block, 4 if self.planes == "byte" else 32, MAGIC))


class Reader:
    """Random access to one shard."""

    def __init__(self, source, size: int):
        self.source = source
        self.unpack = zstandard.ZstdDecompressor().decompress
        docs_at, index_at, self.total, n, blocks, self.block, k, magic = _FOOTER.unpack(self._get(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a plane file")
        raw = self.unpack(self._get(docs_at, index_at - docs_at))
        self.keys, self.lengths, self.known = np.frombuffer(raw, "<i8", n), np.frombuffer(raw, "<u8", n, 8 * n).astype(np.int64), np.frombuffer(raw, np.uint8, n, 16 * n).astype(bool)
        self.index = np.frombuffer(self.unpack(self._get(index_at, size - _FOOTER.size - index_at)), "<u8").reshape(blocks, 1 + k)

    def _get(self, at: int, n: int) -> bytes:
        self.source.seek(int(at))
        return self.source.read(int(n))

    def read_block(self, k: int) -> np.ndarray:
        at, *lengths = (int(x) for x in self.index[k])
        raw, ends = self._get(at, sum(lengths)), np.cumsum([0, *lengths])
        n = min(self.block, self.total - k * self.block)
        return from_planes([self.unpack(raw[a:b]) for a, b in zip(ends, ends[1:], strict=False)], n)

    def read(self, start: int, count: int) -> np.ndarray:
        """Ids ``start`` to ``start + count`` of the shard, by the blocks that hold them."""
        first, last = start // self.block, (start + max(count, 1) - 1) // self.block
        got = [self.read_block(k) for k in range(first, min(last + 1, len(self.index)))]
        return np.concatenate([np.zeros(0, np.uint32), *got])[start - first * self.block :][:count]

    def documents(self) -> Iterator[np.ndarray]:
        """Each document's ids in order; one block and one document are held at a time."""
        have, k = np.zeros(0, np.uint32), 0
        for n in map(int, self.lengths):
            parts = [have]
            while sum(map(len, parts)) < n:
                parts.append(self.read_block(k))
                k += 1
            have = np.concatenate(parts) if len(parts) > 1 else have
            yield have[:n]
            have = have[n:]


def write_token_files(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0, block: int = 1 << 16, planes: str = "byte") -> DataFrame:
    """Encode every whole text and write shards under ``path`` in ascending id order.

    Returns one row a shard: shard, file, documents, ids. Shard k holds smaller ids than shard
    k + 1; rows that share an id follow each other by a hash of the text, null ids come first, and
    a null text is empty (just the end id). Each attempt of a task writes its own file, and only
    the files of finished attempts are listed. An empty table gives no shard or an empty one.
    Other columns aren't read, so their names don't matter. A task holds 4 MB of texts, or one text, and its ids; all
    copies of one row are in one task, since the order puts them next to each other.
    """
    rows = bounded(docs).select(F.col(id_col).cast("long").alias("k"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    rows = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h").select("k", "t")
    at = path.rstrip("/")

    def write(batches):
        task = TaskContext.get()
        name = f"{at}/ids-{task.partitionId():06d}-{task.taskAttemptId()}.planes"
        store, file = fs.FileSystem.from_uri(name)
        store.create_dir(file.rpartition("/")[0], recursive=True)
        n = 0
        with Encoder.opened(tokenizer) as encoder, store.open_output_stream(file, compression=None) as out:
            to = Writer(out, block, planes)
            for batch in batches:
                for part in slices(batch, "t", SLICE_BYTES):
                    ids, lengths = encoder.encode(part.column("t"), end_id)
                    keys = part.column("k")
                    known = keys.is_valid().to_numpy(zero_copy_only=False)
                    to.add(ids, keys.fill_null(0).to_numpy(), known, lengths)
                    n += len(lengths)
            to.close()
        yield pa.RecordBatch.from_pydict({"shard": pa.array([task.partitionId()], pa.int32()), "file": [name], "documents": pa.array([n], pa.int64()), "ids": pa.array([to.total], pa.int64())})

    return written(rows.mapInArrow(write, "shard int, file string, documents long, ids long"), "token-index")


def _batches(lengths: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents with at most ``most`` bytes of ids and 1000 documents each, or one document."""
    ends, a = 4 * np.cumsum(lengths), 0
    while a < len(ends):
        upto = int(np.searchsorted(ends, (ends[a - 1] if a else 0) + most, side="right"))
        b = min(max(upto, a + 1), a + 1000)
        yield a, b
        a = b


def read_token_files(index: DataFrame, with_ids: bool = True) -> DataFrame:
    """Read the shards back: id, start (ids of all documents before it), n_tokens, ids_crc32, ids.

    One task reads one shard, and puts out at most ``BATCH_BYTES`` of ids at once, or one document;
    the driver holds the list of shards only (one row a task that wrote).
    """
    spark = index.sparkSession
    shards = sorted((r.shard, r.file, r.ids) for r in index.filter("documents > 0").collect())
    starts = np.cumsum([0, *(x[2] for x in shards)])
    todo = [(x[1], int(s)) for x, s in zip(shards, starts, strict=False)]
    schema = "id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * with_ids

    def read(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                name, start = todo[k]
                store, file = fs.FileSystem.from_uri(name)
                with store.open_input_file(file) as source:
                    shard = Reader(source, store.get_file_info(file).size)
                    begin = start + np.cumsum(shard.lengths) - shard.lengths
                    ids = shard.documents()
                    for i, to in _batches(shard.lengths):
                        raw, check = [], []
                        for _ in range(i, to):
                            one = np.ascontiguousarray(next(ids), "<u4")
                            check.append(zlib.crc32(one))
                            if with_ids:
                                raw.append(one.tobytes())
                        out = [pa.array(shard.keys[i:to], pa.int64(), mask=~shard.known[i:to]), pa.array(begin[i:to], pa.int64()), pa.array(shard.lengths[i:to], pa.int64()), pa.array(check, pa.int64())]
                        yield pa.RecordBatch.from_arrays([*out, *[pa.array(raw, pa.binary())] * with_ids], ["id", "start", "n_tokens", "ids_crc32", *["ids"] * with_ids])

    n = len(todo)
    return (spark.range(0, n, 1, n) if n else spark.range(0)).mapInArrow(read, schema)


def token_file_digests(docs: DataFrame, tokenizer: str, end_id: int = 0) -> DataFrame:
    """Write all documents to files in the shared folder, read them back, and return the digests."""
    index = write_token_files(docs, scratch(docs.sparkSession, "token-files"), tokenizer, end_id=end_id)
    return read_token_files(index, with_ids=False).withColumnRenamed("id", "doc_id")
