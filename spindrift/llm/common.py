"""Helpers shared by the operators: scratch tables, and byte-level tokens as NumPy arrays."""

from __future__ import annotations

import atexit
import gc
import tempfile
import uuid
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

_left: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``; in local mode a temporary folder if unset."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not hasattr(scratch_root, "own"):
        scratch_root.own = tempfile.mkdtemp(prefix="spindrift-")
    return f"file://{scratch_root.own}"


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


class Scratch:
    """Tables written to the shared folder, to cut lineage where a job has several rounds."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.base, self.n = spark, f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex}", 0
        _left.append((spark, self.base))

    def write(self, df: DataFrame) -> DataFrame:
        """Run df now, keep its rows as Parquet and return a DataFrame over those files."""
        self.n += 1
        path = f"{self.base}/{self.n}"
        with shuffles_freed(self.spark):
            df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._scratch_path = path
        return out

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no later round reads."""
        for t in tables:
            _delete(self.spark, t._scratch_path)


@atexit.register
def _clear() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended
            return


@contextmanager
def shuffles_freed(spark: SparkSession):
    """Spark removes the shuffle files of a query as soon as it has ended, so that rounds don't add up on disk."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, before)


def parallelism(spark: SparkSession) -> int:
    """The number of shuffle partitions that the session is set to."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


# ---- tokens -------------------------------------------------------------------------------------------------------

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_VALUE = np.where(_SPACE, np.uint64(0), _BYTE[_LOWER])
_POWER = np.cumprod(np.full(1 << 16, 0x9E3779B97F4A7C15 | 1, dtype=np.uint64), dtype=np.uint64)
#: The same for each run of 65,536 places, so that no two places of a word below 2^32 bytes share a power.
_STRIDE = np.cumprod(np.full(1 << 16, _POWER[-1], dtype=np.uint64), dtype=np.uint64)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values, so that every bit depends on all others."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h = h ^ (h >> np.uint64(27))
    h = h * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def power(place: np.ndarray) -> np.ndarray:
    """The multiplier of each place inside a word."""
    out = _POWER[place & 0xFFFF]
    if len(place) and place.max() > 0xFFFF:
        far = place > 0xFFFF
        out[far] *= _STRIDE[(place[far] >> 16) - 1]
    return out


def utf8(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings of a column in a row, and the n+1 offsets; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def word_hashes(column) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words ``[^\\x20\\x09-\\x0D]+`` of each text, A-Z lower-cased; and the n+1 offsets by text.

    A word's hash is a polynomial over random byte values modulo 2^64, finalised with its length.  Texts are taken about a
    megabyte at a time, as the work takes some forty bytes per byte of text.
    """
    data, at = utf8(column)
    cuts = [0]
    while cuts[-1] < len(at) - 1:
        cuts.append(max(cuts[-1] + 1, int(np.searchsorted(at, at[cuts[-1]] + (1 << 20), "right")) - 1))
    parts = [_word_hashes(data[at[a] : at[b]], at[a : b + 1] - at[a]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    sizes = np.concatenate([np.diff(x) for _, x in parts])
    return np.concatenate([h for h, _ in parts]), np.concatenate([[0], np.cumsum(sizes)])


def _word_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    inside = ~_SPACE[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = at[1:-1]
    cuts = cuts[cuts < len(data)]
    first[cuts] |= inside[cuts]
    starts = np.flatnonzero(first)
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(at), np.int64)
    last = inside
    last[:-1] &= ~inside[1:] | first[1:]
    size = (np.flatnonzero(last) + 1 - starts).astype(np.uint64)
    place = np.arange(len(data), dtype=np.int32)
    place[starts[0] :] -= np.repeat(starts.astype(np.int32), np.diff(starts, append=len(data)))
    value = _VALUE[data]
    value *= power(place)
    h = np.add.reduceat(value, starts)
    return mix(h + size * np.uint64(0xD6E8FEB86659FD93)), np.searchsorted(starts, at).astype(np.int64)


def by_bytes(batch: pa.RecordBatch, column: int, most: int, rows: int = 1 << 30):
    """Slices of a batch with the bytes of their texts: ``most`` bytes and ``rows`` rows at the most, or one row."""
    at = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    a = 0
    while a < batch.num_rows:
        b = min(a + rows, max(a + 1, int(np.searchsorted(at, at[a] + most, "right")) - 1))
        yield batch.slice(a, b - a), int(at[b] - at[a])
        a = b


# ---- what a worker keeps ------------------------------------------------------------------------------------------

_kept: dict[str, object] = {}


def kept(name: str, make):
    """What a Python worker keeps from one task to the next, made when first asked for.  Workers serve many operators: only
    what the last one needed stays, so that the stages of a pipeline don't add up in memory."""
    if name not in _kept:
        _kept.clear()
        gc.collect()
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """For operators that keep nothing: what others kept goes."""
    if _kept:
        _kept.clear()
        gc.collect()
