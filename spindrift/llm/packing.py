"""Packing documents into sequences (operator 13), by a configuration linear program over the histogram of lengths.

Documents become ids (each followed by an end id) and then pieces: only documents longer than a sequence are cut, into whole
sequences, and what is over comes first.  A task numbers its pieces within each length while it makes them, so numbering needs
no shuffle of pieces: only counts by task and length are added up.  The histogram of lengths, at most ``capacity`` numbers, goes
to the driver, which packs it (see ``configurations.py``); its plan, whose size doesn't depend on the number of pieces, goes back
to the tasks, where a piece finds its sequence and place by length and number.

Words are cut by the vocabulary's pattern, and the tokenizers library encodes each distinct word; a worker keeps a bounded
number of them.  A null text is empty and is its end id alone.  Special strings inside texts become their token, as is the
library's default.  Repeated rows and null keys are packed like all others, each by itself.  A very long text is encoded whole,
in its task, and cut into as many pieces as it needs.  Which of several pieces of one length goes where follows the order of
files.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import LATIN, byte_characters
from .bpe_codec import LATIN_WORDS, WORDS
from .common import Scratch, by_bytes, kept, release
from .configurations import Plan, plan

KEPT_WORDS = 400_000


class Words(dict):
    """word -> its ids as bytes of 32-bit numbers, from the library when first asked for."""

    def __init__(self, path: str):
        library = Tokenizer.from_file(path)
        self.model, self.characters = library.model, dict(enumerate(byte_characters()))
        self.special = {t.content: np.uint32(i).tobytes() for i, t in library.get_added_tokens_decoder().items()}
        found = "|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))
        self.cut = regex.compile(f"({found})") if found else None

    def __missing__(self, word: str) -> bytes:
        spelled = word.encode().decode("latin-1").translate(self.characters)
        ids = np.array([t.id for t in self.model.tokenize(spelled)], np.uint32).tobytes()
        if len(word) < 64 and len(self) < KEPT_WORDS:
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        out: list[bytes] = []
        for part in self.cut.split(text) if self.cut and self.cut.search(text) else [text]:
            if part in self.special:
                out.append(self.special[part])
            else:
                out += map(self.__getitem__, (LATIN_WORDS if LATIN.fullmatch(part) else WORDS).findall(part))
        return b"".join(out)


def pieces(df: DataFrame, key: str, text: str, vocabulary: str, capacity: int = 2048, end: int = 0, with_ids: bool = True) -> DataFrame:
    """(_key, piece, start, length, ids_crc32, ids, part, number) of every document; ids is null unless asked for.  ``number``
    counts the pieces of one length in one task, ``part``."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches):
        part, seen, last = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64).tolist(), np.uint32(end).tobytes()
        words = kept(f"packing {vocabulary}", lambda: Words(vocabulary))
        if len(words) >= KEPT_WORDS:
            words.clear()
        for batch in batches:
            for some, _ in by_bytes(batch, 1, 1 << 20, 512):
                row, out, blobs = [], [], []
                for i, t in enumerate(some.column(1).to_pylist()):
                    ids = words.encode(t or "") + last
                    n = len(ids) // 4
                    at, k = 0, 0
                    while at < n:
                        size = (n - 1) % capacity + 1 if at == 0 else capacity
                        blob = ids[4 * at : 4 * (at + size)]
                        row.append(i)
                        out.append((k, at, size, zlib.crc32(blob), part, seen[size]))
                        blobs.append(blob)
                        seen[size] += 1
                        at, k = at + size, k + 1
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int32(), *[pa.int64()] * 5), strict=True)]
                ids = pa.nulls(len(out), pa.list_(pa.int32()))
                if with_ids:
                    ends = np.cumsum([0, *map(len, blobs)]) // 4
                    ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(blobs), np.int32)))
                yield pa.RecordBatch.from_arrays([some.column(0).take(pa.array(row)), *columns[:4], ids, *columns[4:]], ["_key", "piece", "start", "length", "ids_crc32", "ids", "part", "number"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, piece int, start long, length long, ids_crc32 long, ids array<int>, part long, number long")


def placed(rows: DataFrame, found: Plan) -> DataFrame:
    """rows (length, number among all of that length, ...) with ``sequence_id`` and ``offset``."""
    shared = rows.sparkSession.sparkContext.broadcast(found)
    at, names = [rows.columns.index(c) for c in ("length", "number")], rows.columns
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        release()
        for batch in batches:
            where = shared.value.place(*(batch.column(i).to_numpy() for i in at)) if batch.num_rows else (np.zeros(0, np.int64),) * 2
            yield pa.RecordBatch.from_arrays([*batch.columns, *map(pa.array, where)], [*names, "sequence_id", "offset"])

    return rows.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(df: DataFrame, key: str, text: str, vocabulary: str, capacity: int = 2048, end: int = 0, with_ids: bool = True) -> DataFrame:
    """``(key, piece, start, length, ids_crc32, ids, sequence_id, offset)`` of every piece."""
    scratch = Scratch(df.sparkSession, "packing")
    made = scratch.write(pieces(df, key, text, vocabulary, capacity, end, with_ids))
    counts = scratch.write(made.groupBy("part", "length").count())
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("count")).collect():
        histogram[length] = n
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("part", "length", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("before"))
    numbered = made.join(counts, ["part", "length"]).withColumn("number", F.col("number") + F.col("before")).drop("part", "before")
    out = placed(numbered, plan(histogram)).withColumnRenamed("_key", key)
    return out.select(key, "piece", "start", "length", "ids_crc32", "ids", "sequence_id", "offset")


def sequences(packed: DataFrame, key: str) -> DataFrame:
    """(sequence_id, keys, lengths, ids) of packed pieces that have ids; a sequence has ``capacity`` ids at the most."""
    member = F.struct("offset", F.col(key).alias("key"), "length", "ids")
    whole = packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(member)).alias("m"))
    return whole.select("sequence_id", F.col("m.key").alias("keys"), F.col("m.length").alias("lengths"), F.flatten("m.ids").alias("ids"))
