"""Texts as packed word hashes, and global counts of hashed n-grams as shuffles of packed arrays (operators 1 and 3).

``packed_texts`` hashes words once: each task packs its texts, some megabytes at a time, into blocks (the block's distinct
words, frequent ones first, and each token's place among them) and writes them; all later rounds read those.  A block asks
for the counts of its distinct n-grams; requests carry the block's own counts, so that one shuffle by n-gram (to buckets of their hashes) both
adds up and answers.  N-grams travel as sorted arrays, packed by their differences; a frequent n-gram is one entry per
block, however often it occurs.  Answers name no n-grams: they have a bit for each one asked for, and the block works out
again what it had asked.  Blocks are bounded by bytes, and the number of buckets follows the session's shuffle
partitions, so that the arrays that meet in one task stay of one size as the data grow.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import Scratch, by_bytes, word_hashes

#: Bits of a longer n-gram's name inside its bucket; with a bucket below 2^16 and one bit to spare they fill a word.
BITS = 47
SHORT, MOST_BUCKETS = np.uint64((1 << BITS) - 1), 1 << 16
BLOCK_BYTES = 8 << 20


def _press(values: np.ndarray) -> bytes:
    """Byte plane by byte plane, so that the high planes compress."""
    rows = values.view(np.uint8).reshape(-1, values.itemsize)
    planes = np.empty(rows.shape[::-1], np.uint8)
    for i in range(values.itemsize):  # many times as fast as the transposed array's bytes
        planes[i] = rows[:, i]
    return zstandard.ZstdCompressor(level=1).compress(planes)


def unpack(data: bytes, kind: type) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(np.dtype(kind).itemsize, -1)
    rows = np.empty(planes.shape[::-1], np.uint8)
    for i, plane in enumerate(planes):
        rows[:, i] = plane
    return rows.view(kind).ravel()


def pack(values: np.ndarray) -> bytes:
    return _press(np.ascontiguousarray(values))


def pack_keys(keys: np.ndarray) -> bytes:
    """Sorted keys by their differences."""
    return _press(np.diff(keys, prepend=np.uint64(0)))


def unpack_keys(data: bytes) -> np.ndarray:
    return np.cumsum(unpack(data, np.uint64), dtype=np.uint64)


# ---- texts --------------------------------------------------------------------------------------------------------


class Block:
    """One packed block: keys and extra values of its texts, their numbers of words, distinct words, and tokens."""

    def __init__(self, row: dict):
        self.number, self.keys = row["block"], row["_keys"]
        self.extra, self.sizes = unpack(row["extra"], np.int64), unpack(row["sizes"], np.uint32).astype(np.int64)
        self.vocabulary, self.tokens = unpack_keys(row["vocabulary"]), unpack(row["tokens"], np.uint32)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])

    def slices(self, most: int = 1 << 19):
        """Pairs (a, b): texts a to b - 1, below 2^16 and of about ``most`` words together, or one."""
        a = 0
        while a < len(self.sizes):
            b = min(a + (1 << 16) - 1, max(a + 1, int(np.searchsorted(self.starts, self.starts[a] + most, "right")) - 1))
            yield a, b
            a = b

    def words(self, a: int, b: int) -> np.ndarray:
        return self.vocabulary[self.tokens[self.starts[a] : self.starts[b]]]


def blocks_of(table: pa.Table | pa.RecordBatch):
    for i in range(table.num_rows):
        yield Block({name: table.column(name)[i].values if name == "_keys" else table.column(name)[i].as_py() for name in table.schema.names})


def packed_texts(rows: DataFrame, scratch: Scratch, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows (_key, _extra long, _text) as written blocks; a text is never split, a null one has no words."""
    kind = rows.schema["_key"].dataType.simpleString()

    def packed(parts: list[pa.RecordBatch], number: int) -> pa.RecordBatch:
        h, at = word_hashes(pa.chunked_array([p.column(2) for p in parts]))
        vocabulary, tokens = grouped(h)
        # Frequent words first, so that most tokens' high bytes are 0: by the bits of their number, in each such class by hash.
        order = np.argsort(-np.frexp(np.bincount(tokens, minlength=len(vocabulary)))[1].astype(np.int8), kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        vocabulary, tokens = vocabulary[order], rank[tokens]
        keys = pa.chunked_array([p.column(0) for p in parts]).combine_chunks()
        extra = np.concatenate([p.column(1).to_numpy(zero_copy_only=False) for p in parts]).astype(np.int64)
        cells = [pack(extra), pack(np.diff(at).astype(np.uint32)), pack_keys(vocabulary), pack(tokens)]
        listed = pa.ListArray.from_arrays(pa.array([0, len(keys)], pa.int32()), keys)
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), listed, *(pa.array([c], pa.binary()) for c in cells)], ["block", "_keys", "extra", "sizes", "vocabulary", "tokens"])

    def run(batches):
        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            for part, n in by_bytes(batch, 2, block_bytes):
                if held and size + n > block_bytes:
                    yield packed(held, number)
                    number, held, size = number + 1, [], 0
                held.append(part)
                size += n
        if held:
            yield packed(held, number)

    return scratch.write(rows.select("_key", "_extra", "_text").mapInArrow(run, f"block long, _keys array<{kind}>, extra binary, sizes binary, vocabulary binary, tokens binary"))


# ---- keys ---------------------------------------------------------------------------------------------------------


def bucket_of(keys: np.ndarray, buckets: int) -> np.ndarray:
    return ((keys >> np.uint64(40)) % np.uint64(buckets)).astype(np.int64)


def short(keys: np.ndarray, buckets: int) -> np.ndarray:
    """Keys of n-grams of two words or more: the bucket, then BITS bits."""
    return (keys >> np.uint64(40)) % np.uint64(buckets) << np.uint64(BITS) | (keys ^ (keys >> np.uint64(BITS))) & SHORT


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, sorted, and where each key stands among them.

    Leading bits and places are sorted as one word, several times as fast as argsort; where different keys agree in all leading
    bits they can come out of order, and then argsort does it."""
    if not len(keys):
        return keys, np.zeros(0, np.int32)
    bits = (len(keys) - 1).bit_length()
    drop = max(0, int(keys.max()).bit_length() + bits - 64)
    marked = keys >> np.uint64(drop) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64)
    marked.sort()
    order = (marked & np.uint64((1 << bits) - 1)).view(np.int64)
    keys, given = keys[order], keys
    if drop and (keys[1:] < keys[:-1]).any():
        order = np.argsort(given)
        keys = given[order]
    first = np.concatenate([[True], keys[1:] != keys[:-1]])
    where = np.empty(len(keys), np.int32)
    where[order] = np.cumsum(first, dtype=np.int32) - np.int32(1)
    return keys[first], where


def tally(keys: np.ndarray, learnt: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct short keys, sorted, and how many of their occurrences are learnt from."""
    marked = np.sort(keys << np.uint64(1) | learnt.astype(np.uint64))
    keys = marked >> np.uint64(1)
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    counts = np.add.reduceat(marked & np.uint64(1), first) if len(keys) else np.zeros(0)
    return keys[first], counts.astype(np.uint32)


class Lookup:
    """Values by sorted keys, found over a table of the keys' leading bits."""

    def __init__(self, keys: np.ndarray, *values: np.ndarray):
        self.keys, self.values = keys, values
        if len(keys):
            self.shift = np.uint64(max(0, int(keys[-1]).bit_length() - len(keys).bit_length() - 1))
            lead = (keys >> self.shift).astype(np.int64)
            self.starts = np.searchsorted(lead, np.arange(lead[-1] + 2)).astype(np.int32)
            self.longest = int(np.diff(self.starts).max())

    def find(self, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The queries that are there, and where."""
        if not len(self.keys) or not len(wanted):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lead = wanted >> self.shift
        open_ = np.flatnonzero(lead < np.uint64(len(self.starts) - 1))
        lead = lead[open_].astype(np.int64)
        at, end = self.starts[lead], self.starts[lead + 1]
        rows, places = [], []
        for _ in range(self.longest):
            live = at < end
            open_, at, end = open_[live], at[live], end[live]
            same = self.keys[at] == wanted[open_]
            rows.append(open_[same])
            places.append(at[same])
            open_, at, end = open_[~same], at[~same] + 1, end[~same]
        return np.concatenate(rows), np.concatenate(places)


ASK = "level int, bucket int, block long, keys binary, counts binary"
SAID = "level int, bucket int, block long, keys binary, counts binary, gains binary"
ANSWER = "level int, bucket int, block long, told binary, counts binary"
TOLD = f"{ANSWER}, n_distinct long, n_total long"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def table_of(kind: str, rows: list[tuple]) -> pa.Table:
    fields = [f.split() for f in kind.split(", ")]
    return pa.table([pa.array([r[i] for r in rows], _ARROW[t]) for i, (_, t) in enumerate(fields)], names=[n for n, _ in fields])


def dealt(n: int, block: int, buckets: int, keys: np.ndarray, *values: np.ndarray) -> list[tuple]:
    """Rows of packed keys and values, one for each bucket; keys are distinct, and sorted if longer than a word."""
    if n == 1:
        bucket = bucket_of(keys, buckets)
        order = np.argsort(bucket, kind="stable")
        keys, bucket, values = keys[order], bucket[order], [v[order] for v in values]
    else:
        bucket = (keys >> np.uint64(BITS)).astype(np.int64)
        keys = keys & SHORT
    cuts = np.searchsorted(bucket, np.arange(buckets + 1))
    return [(n, int(b), block, pack_keys(keys[cuts[b] : cuts[b + 1]]), *(pack(v[cuts[b] : cuts[b + 1]]) for v in values)) for b in np.flatnonzero(np.diff(cuts))]


def answer(level: int, bucket: int, block: int, told: np.ndarray, values: np.ndarray) -> tuple:
    """One row of ANSWER: a bit for each key asked for, and the values of those told, which are above 0."""
    return level, bucket, block, np.packbits(told).tobytes(), pack(values[told])


def answered(n: int, keys: np.ndarray, buckets: int, answers: pa.Table) -> np.ndarray:
    """The value told for each of the keys that a block had asked for, in that order, at level n; 0 for the others."""
    bucket = bucket_of(keys, buckets) if n == 1 else (keys >> np.uint64(BITS)).astype(np.int64)
    order = np.argsort(bucket, kind="stable") if n == 1 else slice(None)
    cuts, dense = np.searchsorted(bucket[order], np.arange(buckets + 1)), np.zeros(len(keys), np.uint32)
    for b, told, values in zip(*(answers[c].to_pylist() for c in ("bucket", "told", "counts")), strict=True):
        size = int(cuts[b + 1] - cuts[b])
        there = np.unpackbits(np.frombuffer(told, np.uint8), count=size).astype(bool)
        dense[cuts[b] : cuts[b + 1]][there] = unpack(values, np.uint32)
    if n > 1:
        return dense
    out = np.empty_like(dense)
    out[order] = dense
    return out


def level_of(answers: pa.Table, n: int) -> pa.Table:
    return answers.filter(pa.array(answers["level"].to_numpy() == n))


def tell(table: pa.Table) -> pa.Table:
    """Adds up one bucket's counts and answers each block with those that matter: words seen in training, longer n-grams
    seen twice or more.  The first row of words also has the bucket's number of words and of their occurrences."""
    level, bucket = table["level"][0].as_py(), table["bucket"][0].as_py()
    asked = [unpack_keys(b) for b in table["keys"].to_pylist()]
    keys, where = grouped(np.concatenate(asked))
    total = np.bincount(where, np.concatenate([unpack(b, np.uint32) for b in table["counts"].to_pylist()]), len(keys)).astype(np.uint32)
    told = total >= (1 if level == 1 else 2)
    stats = (int((total > 0).sum()), int(total.sum(dtype=np.uint64))) if level == 1 else (0, 0)
    rows, at = [], 0
    for block, own in zip(table["block"].to_pylist(), asked, strict=True):
        index = where[at : at + len(own)]
        at += len(own)
        if told[index].any() or stats != (0, 0):
            rows.append((*answer(level, bucket, block, told[index], total[index]), *stats))
            stats = (0, 0)
    return table_of(TOLD, rows)
