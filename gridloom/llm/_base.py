"""What the operators of this subpackage share: scratch tables and bounded batches."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridloom.plans.storage import shared_dir

#: Rows of the largest table that is sent to every executor; a larger one is joined by a shuffle.
MOST_SENT = 1_000_000
#: Bytes of text that one numpy pass works on; arrays of a pass are a few times this.
SLICE_BYTES = 2 << 20

#: Bytes of rows that Spark hands to Python at once.
BATCH_BYTES = 8 << 20

_made: set[str] = set()
_here: ContextVar[list[str] | None] = ContextVar("_here", default=None)


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; it is deleted when the driver's Python ends."""
    path = f"{shared_dir(spark)}/gridloom/{name}-{uuid.uuid4().hex[:12]}"
    if not _made:
        atexit.register(_clean)
    _made.add(path)
    if (here := _here.get()) is not None:
        here.append(path)
    return path


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Delete the scratch tables written meanwhile at the end, but for those that are passed to the function given."""
    made: list[str] = []
    kept: set[str] = set()
    before = _here.set(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.add(df._scratch)
        return df

    try:
        yield keep
    finally:
        _here.reset(before)
        for path in made:
            if path not in kept:
                drop_path(spark, path)
        if (outer := _here.get()) is not None:
            outer.extend(x for x in made if x in kept)


def _clean() -> None:
    spark = SparkSession.getActiveSession()
    for path in list(_made) if spark else []:
        drop_path(spark, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch path through Hadoop's file system, so that any shared store works."""
    try:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
    except Exception:  # the session may be closing; a left-over scratch folder does no harm
        return
    _made.discard(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """The frame as a Parquet table in the shared folder: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def bounded(df: DataFrame) -> DataFrame:
    """The frame, after the session's limit on the bytes of an Arrow batch is lowered to ``BATCH_BYTES`` if it's above."""
    name, conf = "spark.sql.execution.arrow.maxBytesPerBatch", df.sparkSession.conf
    now = conf.get(name).lower()
    n = re.fullmatch(r"(-?\d+)([kmgt]?)b?", now)
    size = int(n[1]) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[n[2]] if n else -1
    if not 0 < size <= BATCH_BYTES:
        conf.set(name, f"{BATCH_BYTES}b")
    return df


def sent(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """A written table of a few narrow columns, marked for broadcast if it has at most ``most`` rows."""
    return F.broadcast(df) if df.count() <= most else df


def release() -> None:
    """Give memory that a task no longer uses back to the system, since Python workers outlive their tasks."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # only the GNU library has it
        ctypes.CDLL(None).malloc_trim(0)


def strings(column: pa.Array | pa.ChunkedArray) -> pa.StringArray:
    """A string column without nulls (null counts as empty), as one array with 32-bit offsets."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type != pa.string():
        column = column.cast(pa.string())
    return column.fill_null("") if column.null_count else column


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES):
    """Split a batch so that each part has at most ``most`` bytes of ``column``, or one row."""
    import numpy as np

    texts = strings(batch.column(column))
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    row = 0
    while row < len(texts):
        to = int(np.searchsorted(ends, int(ends[row]) + most, side="right")) - 1
        to = min(max(to, row + 1), len(texts))
        yield batch.slice(row, to - row)
        row = to
