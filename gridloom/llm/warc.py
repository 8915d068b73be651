"""WARC archives as seekable zstandard bundles: independent frames, a seek table, a record index."""

from __future__ import annotations

import hashlib
import struct

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm._base import bounded, scratch, slices, written

#: Numbers of the seekable format: the skippable frame that holds the seek table, and its footer.
TABLE_MAGIC, FOOTER_MAGIC = 0x184D2A5E, 0x8F92EAB1
INDEX = "page_id long, file string, frame int, frame_at long, frame_bytes long, record_at long, record_bytes long"
#: Bytes of records that one task reads back, about.
PART_BYTES = 64 << 20
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; a revisit has no block and names the record that it repeats."""
    target = "".join(c if " " < c < "\x7f" or c > "\xa0" else "".join(f"%{b:02X}" for b in c.encode()) for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    lines += [f"WARC-Target-URI: {target}"] * bool(target)
    lines += [f"WARC-Payload-Digest: sha256:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: text/html; charset=utf-8"]
    if revisit:
        lines += [f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>", f"WARC-Profile: {PROFILE}"]
    block = b"" if revisit else payload
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse(raw: bytes) -> tuple[dict[str, str], bytes]:
    """A record's headers (names in lower case) and its block."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    headers = {k.lower(): v.strip() for k, v in (x.split(":", 1) for x in lines)}
    n = int(headers["content-length"])
    if not version.startswith("WARC/") or rest[n:] != b"\r\n\r\n":
        raise ValueError("not a WARC record")
    return headers, rest[:n]


class BundleWriter:
    """Writes records into frames of about ``frame_bytes``; one frame is held in memory."""

    def __init__(self, out, frame_bytes: int = 1 << 20, level: int = 3):
        self.out, self.most = out, frame_bytes
        self.pack = zstandard.ZstdCompressor(level=level).compress
        self.held, self.size, self.at, self.frames = [], 0, 0, []

    def add(self, raw: bytes) -> tuple[int, int]:
        """The record's frame and its place in that frame."""
        if self.size and self.size + len(raw) > self.most:
            self.flush()
        place = len(self.frames), self.size
        self.held.append(raw)
        self.size += len(raw)
        return place

    def flush(self) -> None:
        if self.held:
            frame = self.pack(b"".join(self.held))
            self.out.write(frame)
            self.frames.append((len(frame), self.size, self.at))
            self.at += len(frame)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.flush()
        entries = b"".join(struct.pack("<II", c, d) for c, d, _ in self.frames)
        self.out.write(struct.pack("<II", TABLE_MAGIC, len(entries) + 9) + entries + struct.pack("<IBI", len(self.frames), 0, FOOTER_MAGIC))


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(offset, compressed, decompressed) of each frame, from the table at the end of a bundle."""
    source.seek(size - 9)
    n, flags, magic = struct.unpack("<IBI", source.read(9))
    if magic != FOOTER_MAGIC or flags:
        raise ValueError("no seek table")
    source.seek(size - 9 - 8 * n)
    out, at = [], 0
    for c, d in struct.iter_unpack("<II", source.read(8 * n)):
        out.append((at, c, d))
        at += c
    return out


def repeated_payloads(pages: DataFrame, id_col: str, html_col: str, least_bytes: int) -> DataFrame:
    """(digest, first): the smallest id of each payload of at least ``least_bytes`` that occurs more than once."""
    payload = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    seen = pages.select(F.col(id_col).cast("long").alias("id"), F.sha2(payload, 256).alias("digest"), F.octet_length(payload).alias("n")).filter(F.col("n") >= least_bytes)
    return written(seen.groupBy("digest").agg(F.min("id").alias("first"), F.count("*").alias("rows")).filter("rows > 1").drop("rows"), "payloads")


def write_bundles(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 100, frame_bytes: int = 1 << 20) -> DataFrame:
    """Write a record for every row under ``path``; returns the index of all records.

    Of rows with the same payload of at least ``least_bytes``, those with the smallest id are
    responses and the others revisits; if all their ids are null, all are responses. A null html is an empty payload, a null url gives no target,
    repeated rows give a record each, and an empty table gives no record. Each attempt of a task
    writes a file of its own; the index lists those of finished attempts. Only digests that occur
    more than once are joined to the pages, so payloads are shuffled only where that list is large; skew handling splits
    a payload that many rows have. Other columns aren't read. A task holds a frame and one payload at least.
    """
    again = repeated_payloads(pages, id_col, html_col, least_bytes)
    html = F.coalesce(F.col(html_col), F.lit(""))
    rows = bounded(pages).select(F.col(id_col).cast("long").alias("k"), F.col(url_col).alias("u"), html.alias("t"), F.sha2(html.cast("binary"), 256).alias("d"))
    rows = rows.join(again, F.col("d") == F.col("digest"), "left").select("k", "u", "t", "d", "first", (F.col("first").isNotNull() & ~F.col("k").eqNullSafe(F.col("first"))).alias("again"))
    at = path.rstrip("/")

    def write(batches):
        task = TaskContext.get()
        name = f"{at}/pages-{task.partitionId():06d}-{task.taskAttemptId()}.warc.zst"
        store, file = fs.FileSystem.from_uri(name)
        store.create_dir(file.rpartition("/")[0], recursive=True)
        placed = []
        with store.open_output_stream(file, compression=None) as out:
            to = BundleWriter(out, frame_bytes)
            for batch in batches:
                for part in slices(batch, "t"):
                    for r in part.to_pylist():
                        raw = record(r["k"], r["u"], r["t"].encode(), r["d"], r["first"], r["again"])
                        placed.append((r["k"], *to.add(raw), len(raw)))
                    done = len(to.frames)
                    ready = [x for x in placed if x[1] < done]
                    placed = [x for x in placed if x[1] >= done]
                    yield listed(name, ready, to.frames)
            to.close()
        yield listed(name, placed, to.frames)

    def listed(name, placed, frames):
        n = len(placed)
        long = lambda x: pa.array(x, pa.int64())
        return pa.RecordBatch.from_arrays([long([x[0] for x in placed]), pa.array([name] * n, pa.string()), pa.array([x[1] for x in placed], pa.int32()), long([frames[x[1]][2] for x in placed]), long([frames[x[1]][0] for x in placed]), long([x[2] for x in placed]), long([x[3] for x in placed])], [x.split()[0] for x in INDEX.split(", ")])

    return written(rows.mapInArrow(write, INDEX), "warc-index")


def read_records(index: DataFrame, payloads: bool = True) -> DataFrame:
    """Read the records that an index lists: by file and frame, each frame decompressed once a task.

    Columns page_id, payload_bytes, payload_digest, record_type, refers_to, and url and payload if
    asked for (null for revisits). A response's digest is computed from the bytes that were read.
    """
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", url string, payload binary" * payloads
    names = [x.split()[0] for x in schema.split(", ")]
    # Parts go by the bytes to read: the index itself is so small that it would be merged into a few.
    size = index.agg(F.sum("record_bytes")).first()[0] or 0
    parts = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // PART_BYTES))
    rows = index.repartition(parts, "file", "frame").sortWithinPartitions("file", "frame", "record_at")

    def run(batches):
        unpack, now, source, frame = zstandard.ZstdDecompressor().decompress, (None, None), None, b""
        number = lambda urn: int(x) if (x := urn[len("<urn:page:") : -1]) else None
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["file"] != now[0]:
                    if source:
                        source.close()
                    store, file = fs.FileSystem.from_uri(r["file"])
                    source = store.open_input_file(file)
                if (r["file"], r["frame"]) != now:
                    source.seek(r["frame_at"])
                    frame, now = unpack(source.read(r["frame_bytes"])), (r["file"], r["frame"])
                headers, block = parse(frame[r["record_at"] : r["record_at"] + r["record_bytes"]])
                kind, said = headers["warc-type"], headers["warc-payload-digest"].removeprefix("sha256:")
                if kind == "response" and hashlib.sha256(block).hexdigest() != said:
                    raise ValueError(f"payload of {headers['warc-record-id']} is damaged")
                refers = number(headers["warc-refers-to"]) if kind == "revisit" else None
                out.append((number(headers["warc-record-id"]), int(headers["x-payload-length"]), said, kind, refers, *[headers.get("warc-target-uri"), block if kind == "response" else None] * payloads))
            columns = list(zip(*out, strict=True)) or [[]] * len(names)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=False)], names)
        if source:
            source.close()

    return rows.mapInArrow(run, schema)


def archived_pages(pages: DataFrame) -> DataFrame:
    """Write all pages to bundles in the shared folder, read them back, and describe each record."""
    return read_records(write_bundles(pages, scratch(pages.sparkSession, "warc")), payloads=False)


#: DuckDB SQL for :func:`archived_pages` of ``pages``.
ARCHIVED_SQL = """
with p as (
  select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as digest from pages),
g as (
  select *, min(page_id) over (partition by digest) as first, case when n >= 100 then count(*) over (partition by digest) else 1 end as rows from p)
select page_id, cast(n as bigint) as payload_bytes, digest as payload_digest,
  case when rows > 1 and first is not null and page_id is distinct from first then 'revisit' else 'response' end as record_type,
  case when rows > 1 and first is not null and page_id is distinct from first then first end as refers_to
from g
"""
