"""A data source that gives a grid's points with one partition a rank: the split, physically."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import DoubleType, LongType, StructType

from gridloom.operators.grid import Axis, Section, grid_axes, split_bounds


class RankPartition(InputPartition):
    def __init__(self, rank: int, first: int, last: int):
        self.rank, self.first, self.last = rank, first, last


class GridReader(DataSourceReader):
    def __init__(self, axes: tuple[Axis, ...], np: int, step: int = 8192):
        self.axes, self.np, self.step = axes, np, step

    def partitions(self) -> Sequence[InputPartition]:
        n = Section(self.axes, 1, 0).grid_size
        return [RankPartition(p, *split_bounds(n, self.np, p)) for p in range(1, self.np + 1)]

    def read(self, partition: RankPartition) -> Iterator[pa.RecordBatch]:
        import numpy as np

        whole = Section(self.axes, 1, 0)
        for a in range(partition.first, partition.last + 1, self.step):
            idx = np.arange(a, min(a + self.step, partition.last + 1), dtype=np.int64)
            columns = [pa.array(np.full(len(idx), partition.rank, np.int64)), pa.array(idx)]
            for axis, stride in zip(self.axes, whole.strides, strict=True):
                k = (idx - 1) // stride % axis.length
                columns.append(pa.array(axis.start + axis.step * k, pa.float64() if axis.is_float else pa.int64()))
            yield pa.RecordBatch.from_arrays(columns, ["rank", "idx", *[f"i{k + 1}" for k in range(len(self.axes))]])


def _axes(options: dict[str, str]) -> tuple[Axis, ...]:
    """Axes as text: ``1:10, 4:6`` or ``1:0.5:3``, both ends included."""
    number = lambda x: float(x) if "." in x else int(x)
    return grid_axes([tuple(number(x) for x in axis.strip().split(":")) for axis in options["axes"].split(",")])


class GridSource(DataSource):
    """``spark.read.format("grid").option("axes", "1:10,4:6").option("np", 7).load()``."""

    @classmethod
    def name(cls) -> str:
        return "grid"

    def schema(self) -> StructType:
        out = StructType().add("rank", LongType()).add("idx", LongType())
        for k, a in enumerate(_axes(self.options)):
            out.add(f"i{k + 1}", DoubleType() if a.is_float else LongType())
        return out

    def reader(self, schema: StructType) -> DataSourceReader:
        np = int(self.options.get("np", "1"))
        if np < 1:
            raise ValueError("at least one rank is needed")
        return GridReader(_axes(self.options), np)


def read_grid(spark: SparkSession, axes: str, np: int) -> DataFrame:
    spark.dataSource.register(GridSource)
    return spark.read.format("grid").option("axes", axes).option("np", str(np)).load()
