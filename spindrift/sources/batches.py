"""A bridge to training frameworks: batches of rows in a seeded order, and a table for libraries of data sets."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, MapType, VariantType


def columns(rows: list[Row]) -> dict[str, list]:
    """Rows as one list for each column."""
    return {c: [r[c] for r in rows] for c in rows[0].__fields__}


def _sortable(kind: DataType) -> bool:
    inner = [f.dataType for f in kind.fields] if kind.typeName() == "struct" else [kind.elementType] if kind.typeName() == "array" else []
    return not isinstance(kind, (MapType, VariantType)) and all(map(_sortable, inner))


def shuffled(df: DataFrame, seed: int, epoch: int = 0, partitions: int | None = None) -> DataFrame:
    """df in an order that seed, epoch and the rows alone decide: by a hash of all sortable columns, then by the columns.

    Rows that differ in maps only keep no certain order among themselves."""
    keys = [F.col(f"`{f.name}`") for f in df.schema if _sortable(f.dataType)]
    order = [F.xxhash64(F.lit(seed), F.lit(epoch), *keys), *keys]
    return (df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)).sortWithinPartitions(*order)


def batches(df: DataFrame, size: int = 256, seed: int | None = None, epochs: int = 1, collate: Callable[[list[Row]], Any] = columns,
            drop_last: bool = False, partition_rows: int = 1 << 16) -> Iterator[Any]:
    """What collate makes of each ``size`` rows; the last batch of an epoch may be smaller, or is left out.

    With a seed each epoch has its own order, dealt to partitions of about ``partition_rows`` rows; without one rows come as they
    lie.  The driver holds one partition and the next, which is fetched meanwhile."""
    if size < 1:
        raise ValueError("size is 1 or more")
    parts = max(1, -(-df.count() // partition_rows)) if seed is not None else None
    for epoch in range(epochs):
        own: list[Row] = []
        for row in (df if seed is None else shuffled(df, seed, epoch, parts)).toLocalIterator(prefetchPartitions=True):
            own.append(row)
            if len(own) == size:
                yield collate(own)
                own = []
        if own and not drop_last:
            yield collate(own)


def to_hf_dataset(df: DataFrame, folder: str):
    """df written to folder as Parquet and opened there by the ``datasets`` library, which must be installed."""
    try:
        from datasets import load_dataset
    except ImportError as missing:
        raise ImportError("to_hf_dataset needs the library datasets") from missing
    df.write.parquet(folder)
    return load_dataset("parquet", data_files=f"{folder.removeprefix('file://')}/*.parquet", split="train")
