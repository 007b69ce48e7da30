"""Arrow IPC files (Feather version 2) as a Spark data source: record batches are dealt to tasks, and only named columns read."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs, ipc
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

MAGIC = b"ARROW1"
#: About what one task reads of a file.
TASK_BYTES = 32 << 20


def opened(path: str) -> pa.NativeFile:
    system, inner = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    return system.open_input_file(inner)


def is_ipc(path: str) -> bool:
    """Whether path names one IPC file on a file system that Arrow can open by itself."""
    try:
        with opened(path) as file:
            return file.read(len(MAGIC)) == MAGIC
    except (OSError, pa.ArrowException, ValueError):
        return False


class Batches(InputPartition):
    """Record batches first to end of a file."""

    def __init__(self, first: int, end: int):
        super().__init__((first, end))
        self.first, self.end = first, end


class ArrowFileReader(DataSourceReader):
    def __init__(self, path: str, columns: list[str], task_bytes: int):
        self.path, self.columns, self.task_bytes = path, columns, task_bytes

    def partitions(self) -> list[Batches]:
        """From the index at the file's end: runs of batches of about ``task_bytes``, by the mean size of a batch."""
        with opened(self.path) as file:
            n, size = ipc.open_file(file).num_record_batches, file.size()
        run = max(1, self.task_bytes * n // max(size, 1))
        return [Batches(i, min(i + run, n)) for i in range(0, n, run)] or [Batches(0, 0)]

    def read(self, partition: Batches) -> Iterator[pa.RecordBatch]:
        kind = pa.schema([(c, pa.string()) for c in self.columns])
        with opened(self.path) as file:
            whole = ipc.open_file(file).schema
            missing = [c for c in self.columns if c not in whole.names]
            if missing:
                raise ValueError(f"{self.path} has no columns {missing}")
            wanted = sorted(whole.names.index(c) for c in self.columns)
            reader = ipc.open_file(file, options=ipc.IpcReadOptions(included_fields=wanted))
            for i in range(partition.first, partition.end):
                batch = reader.get_batch(i)
                yield from pa.Table.from_batches([batch]).select(self.columns).cast(kind).to_batches(1 << 14)


class ArrowFiles(DataSource):
    """``spark.read.format("arrow_file").option("columns", "a,b").load(path)``: the columns as text.  A column's name holds no comma."""

    @classmethod
    def name(cls) -> str:
        return "arrow_file"

    def _columns(self) -> list[str]:
        return self.options["columns"].split(",")

    def schema(self) -> StructType:
        return StructType([StructField(c, StringType()) for c in self._columns()])

    def reader(self, schema: StructType) -> ArrowFileReader:
        return ArrowFileReader(self.options["path"], self._columns(), int(self.options.get("task_bytes", TASK_BYTES)))
