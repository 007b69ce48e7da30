"""BPE encoding and decoding (operator 2).

Every text is cut into words by the byte-level pattern; every word is encoded by dynamic programming over its prefixes
(see ``bpe.py``).  Words repeat, so each Python worker keeps a bounded number of encoded words.

A null text is empty and has no ids; null ids decode to the empty text.  Special strings inside a text become their
special token, as is the library's default.  Rows with null keys and repeated rows are worked on like all others, each by
itself.  Long texts are whole: only their row's batch grows with them.  Extra columns are ignored by ``encode`` and
``round_trip`` and kept by ``decode``; an empty table gives an empty result.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import LATIN, LATIN_LETTERS, LATIN_NUMBERS, SPACE, BpeTables, tables
from .common import by_bytes, kept

#: Fixed pattern of byte-level vocabularies.
WORDS = regex.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
#: The same for texts below U+0250, where the classes are short lists.
LATIN_WORDS = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_LETTERS}]+| ?[{LATIN_NUMBERS}]+| ?[^{SPACE}{LATIN_LETTERS}{LATIN_NUMBERS}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
)
KEPT_WORDS = 200_000


class Encoded(dict):
    """word -> its ids as bytes of 32-bit numbers, computed when first asked for."""

    def __init__(self, bpe: BpeTables):
        self.bpe, self.spellings = bpe, pa.array(bpe.bytes_of, pa.large_binary())
        special = sorted(bpe.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, special)) + ")") if special else None

    def __missing__(self, word: str) -> bytes:
        ids = np.array(self.bpe.encode_word(word.encode()), np.int32).tobytes()
        if len(word) < 64 and len(self) < KEPT_WORDS:
            self[word] = ids
        return ids


def encoder(path: str) -> Encoded:
    """The worker's words; a new task starts afresh if no more can be kept."""
    words = kept(f"bpe {path}", lambda: Encoded(tables(path)))
    if len(words) >= KEPT_WORDS:
        words.clear()
    return words


def _encoded(text: str, words: Encoded) -> bytes:
    """The ids of a text, 32 bits each."""
    parts = words.special.split(text) if words.special and words.special.search(text) else [text]
    out: list[bytes] = []
    for part in parts:
        if part in words.bpe.special:
            out.append(np.int32(words.bpe.special[part]).tobytes())
        elif part:
            out += map(words.__getitem__, (LATIN_WORDS if LATIN.fullmatch(part) else WORDS).findall(part))
    return b"".join(out)


def encode_text(text: str, words: Encoded) -> list[int]:
    return np.frombuffer(_encoded(text, words), np.int32).tolist()


def _encode_all(texts: pa.Array, words: Encoded) -> pa.Array:
    parts = [_encoded(t or "", words) for t in texts.to_pylist()]
    ends = np.cumsum([0, *map(len, parts)]) // 4
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(parts), np.int32)))


def _decode_all(ids: pa.Array, words: Encoded) -> pa.Array:
    """The spellings of all ids in a row, cut where the lists end."""
    size = np.asarray(ids.value_lengths().fill_null(0))
    spelled = words.spellings.take(ids.flatten())
    _, at, data = spelled.buffers()
    at = np.frombuffer(at, np.int64)[: len(spelled) + 1]
    ends = at[np.concatenate([[0], np.cumsum(size)])]
    raw = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ends)), data or pa.py_buffer(b"")])
    try:
        return raw.cast(pa.large_string()).cast(pa.string())
    except pa.ArrowInvalid:  # ids may stand for bytes that are no UTF-8
        return pa.array([b.decode("utf-8", "replace") for b in raw.to_pylist()], pa.string())


def encode(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``(key, ids array<int>)`` of every text."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches):
        words = encoder(vocabulary)
        for batch in batches:
            for part, _ in by_bytes(batch, 1, 1 << 20, 512):
                yield pa.RecordBatch.from_arrays([part.column(0), _encode_all(part.column(1), words)], ["_key", "ids"])

    return rows.mapInArrow(run, f"_key {rows.schema['_key'].dataType.simpleString()}, ids array<int>").withColumnRenamed("_key", key)


def decode(df: DataFrame, ids: str, vocabulary: str, out: str = "decoded") -> DataFrame:
    """df with the text that the ids stand for; bytes that are no UTF-8 become U+FFFD."""
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name != out)
    at = df.drop(out).columns.index(ids)

    def run(batches):
        words = encoder(vocabulary)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                yield pa.RecordBatch.from_arrays([*part.columns, _decode_all(part.column(at), words)], [*batch.schema.names, out])

    return df.drop(out).mapInArrow(run, f"{kinds}, `{out}` string")


def round_trip(df: DataFrame, key: str, text: str, vocabulary: str) -> DataFrame:
    """``(key, ids array<int>, decoded)``: ``encode`` and ``decode`` in one pass, without a way through the JVM between."""
    rows = df.select(F.col(key).alias("_key"), F.col(text).alias("_text"))

    def run(batches):
        words = encoder(vocabulary)
        for batch in batches:
            for part, _ in by_bytes(batch, 1, 1 << 20, 512):
                ids = _encode_all(part.column(1), words)
                yield pa.RecordBatch.from_arrays([part.column(0), ids, _decode_all(ids, words)], ["_key", "ids", "decoded"])

    kind = rows.schema["_key"].dataType.simpleString()
    return rows.mapInArrow(run, f"_key {kind}, ids array<int>, decoded string").withColumnRenamed("_key", key)
