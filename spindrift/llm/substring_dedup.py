"""Substring dedup by hashing lines, sentences, paragraphs of short lines and word runs (operator 8).

A text's units are its lines; inside lines of several sentences, the sentences; runs of consecutive lines that are each
shorter than ``min_words``, as paragraphs; and runs of ``GRAM`` words wherever they lie.  Units are normalised (lower case,
runs of anything but letters and digits become one space) and those of ``min_words`` words or more are hashed to 128 bits.
Equal digests are grouped over all documents; the occurrence of the smallest (rank, key, start) stays, all others are cut
out.  A line or paragraph that is a repeat goes with its line break; a sentence or word run goes with the blanks after it.

Word runs are chosen by their content (winnowing): of each ``WINDOW`` consecutive ones that with the least hash is a unit.
Every passage of GRAM + WINDOW - 1 words that two texts share has such a unit in both, whatever stands around it, and as no
gap between units is longer than GRAM, at most WINDOW - 1 words at either end of a shared passage stay for this reason.
Inside one text, a word run that overlaps its own first occurrence is cut only behind it.

Each Python batch first settles its own repeats, so that of a unit that very many documents have the global grouping sees
one occurrence per batch.

Every row is kept, with its other columns.  ``removed`` holds the spans that were cut, as offsets in code points of the
original text (in place of a column that df has by that name); null texts stay null and have none.  Rows of the same key
and text count as one document, rows of one key with different texts as several, ordered by a hash of their texts.  Null
ranks and keys come last.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import re
import struct
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import by_bytes, mix, power, release

_JUNK = re.compile(r"[\W_]+")
_SENTENCE = re.compile(r"[^.!?]*[.!?]+\s*|[^.!?]+")
_K = np.array([0x9FB21C651E98DF25, 0xD1342543DE82EF95], np.uint64)

#: Words of a run, a power of two; and of how many consecutive runs one is a unit.
GRAM, WINDOW = 16, 16


@cache
def _letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it is a letter or digit, and a random value of its lower case, 0 for all others."""
    code = [chr(c) for c in range(0x110000)]
    inside = np.array([c.isalnum() for c in code])
    lower = np.array([ord("σ" if c in "Σς" else c.lower()[0]) if w else 0 for c, w in zip(code, inside, strict=True)], np.uint64)
    return inside, np.where(inside, mix(lower * _K[0]) | np.uint64(1), np.uint64(0))


def word_runs(text: str) -> list[tuple[int, int, int, int]]:
    """(start, end, two hashes) of the runs of GRAM words that winnowing chooses."""
    inside, value = _letters()
    code = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    there = np.zeros(len(code) + 2, bool)
    there[1:-1] = inside[code]
    edges = np.flatnonzero(there[1:] != there[:-1])
    starts, ends = edges[::2], edges[1::2]
    if len(starts) < GRAM + WINDOW - 1:
        return []
    code = code[starts[0] : ends[-1]]
    place = np.arange(len(code)) - np.repeat(starts - starts[0], np.append(starts[1:], ends[-1]) - starts)
    word = mix(np.add.reduceat(value[code] * power(place), starts - starts[0]) + (ends - starts).astype(np.uint64) * _K[0])
    lanes = []
    for times in _K[:, None]:
        h, n = word, 1
        while n < GRAM:
            h = h[:-n] * times + h[n:]
            n, times = 2 * n, times * times
        lanes.append(mix(h))
    at = np.lib.stride_tricks.sliding_window_view(lanes[0], WINDOW).argmin(axis=1)
    at += np.arange(len(at))
    at = at[np.append(True, at[1:] != at[:-1])]
    # Where a text repeats itself at once (filler), equal runs lie close together: one in GRAM / 2 words and the last do.
    least = lanes[0][at]
    again = np.append(False, (least[1:] == least[:-1]) & (at[1:] - at[:-1] <= GRAM // 2))
    if again.any():
        first = at[np.maximum.accumulate(np.where(again, 0, np.arange(len(at))))]
        step = (at - first) // (GRAM // 2)
        at = at[~again | np.append(False, step[1:] != step[:-1]) | ~np.append(again[1:], False)]
    out, seen = [], {}
    for p, *digest in zip(at.tolist(), *(h[at].view(np.int64).tolist() for h in lanes), strict=True):
        first = seen.setdefault(tuple(digest), p)
        end = int(ends[p + GRAM - 1])
        while end < len(text) and text[end] in " \t":
            end += 1
        out.append((int(starts[p if p == first else max(p, first + GRAM)]), end, *digest))
    return out


def units(text: str, min_words: int) -> list[tuple[int, int, int, int]]:
    """(start, end, two halves of the digest) of each unit; a line comes before its sentences, word runs come last."""
    out, at, short = [], 0, []

    def paragraph() -> None:
        whole = " ".join(norm for _, _, norm in short)
        if len(short) > 1 and whole.count(" ") + 1 >= min_words:
            out.append((short[0][0], short[-1][1], *struct.unpack("<qq", hashlib.md5(b"P" + whole.encode()).digest())))
        short.clear()

    for line in text.split("\n"):
        end, is_short = at + len(line), False
        if line:
            parts, norms, p = [], [], at
            for m in _SENTENCE.findall(line):
                norm = _JUNK.sub(" ", m.lower()).strip()
                if norm:
                    norms.append(norm)
                    parts.append((p, p + len(m), norm))
                p += len(m)
            whole = " ".join(norms)
            if whole.count(" ") + 1 >= min_words:
                out.append((at, min(end + 1, len(text)), *struct.unpack("<qq", hashlib.md5(b"L" + whole.encode()).digest())))
                if len(parts) > 1:
                    for a, b, norm in parts:
                        if norm.count(" ") + 1 >= min_words:
                            out.append((a, b, *struct.unpack("<qq", hashlib.md5(b"S" + norm.encode()).digest())))
                else:
                    out.append((at, end, *struct.unpack("<qq", hashlib.md5(b"S" + whole.encode()).digest())))
            elif whole:
                is_short = True
                short.append((at, min(end + 1, len(text)), whole))
        if not is_short:
            paragraph()
        at = end + 1
    paragraph()
    return out + word_runs(text)


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def cut_out(text: str, spans: list[tuple[int, int]]) -> str:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    return "".join((*kept, text[at:]))


def _repeats(order: list[tuple], digests: list[tuple]) -> list[bool]:
    """Which units come after another one of the same digest."""
    first: dict[tuple, tuple] = {}
    for o, d in zip(order, digests, strict=True):
        known = first.get(d)
        if known is None or o < known:
            first[d] = o
    return [first[d] != o for o, d in zip(order, digests, strict=True)]


def dedup(df: DataFrame, key: str, text: str, rank: str | None = None, min_words: int = 8) -> DataFrame:
    """df with repeated units cut out of ``text`` and the column ``removed array<struct<start, end>>``."""
    rank, df = rank or key, df.drop("removed") if "removed" not in (key, text, rank) else df
    rows = df.filter(F.col(text).isNotNull()).select(F.col(rank).alias("_rank"), F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_tid"), F.col(text).alias("_text"))
    kinds = {c: rows.schema[c].dataType.simpleString() for c in ("_rank", "_key")}
    names = ["_rank", "_key", "_tid", "start", "end", "d1", "d2", "again"]

    def cut(batches):
        release()
        for batch in batches:
            for part, _ in by_bytes(batch, 3, 1 << 21, 4096):
                owner, found = [], []
                for i, t in enumerate(part.column(3).to_pylist()):
                    own = units(t, min_words)
                    owner += [i] * len(own)
                    found += own
                places = [(r is None, r, k is None, k, t) for r, k, t in zip(*(part.column(i).to_pylist() for i in range(3)), strict=True)]
                again = _repeats([(*places[i], u[0], u[1]) for i, u in zip(owner, found, strict=True)], [u[2:] for u in found])
                # Repeats need no partner any more: they are dealt by their number.
                digests = [(n, i) if later else u[2:] for n, (i, u, later) in enumerate(zip(owner, found, again, strict=True))]
                take = pa.array(owner, pa.int64())
                columns = [pa.array([u[k] for u in found], pa.int32()) for k in (0, 1)] + [pa.array([d[k] for d in digests], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([*(part.column(i).take(take) for i in range(3)), *columns, pa.array(again, pa.bool_())], names)

    found = rows.mapInArrow(cut, f"_rank {kinds['_rank']}, _key {kinds['_key']}, _tid long, start int, end int, d1 long, d2 long, again boolean")
    # One shuffle of the units; rank() is 1 for the first occurrence and for rows that repeat its key and text.
    order = [F.col("_rank").asc_nulls_last(), F.col("_key").asc_nulls_last(), "_tid", "start", "end"]
    place = F.rank().over(Window.partitionBy("d1", "d2", "again").orderBy(*order))
    later = found.withColumn("_place", place).filter("again or _place > 1")
    spans = later.groupBy("_key", "_tid").agg(F.collect_set(F.struct("start", "end")).alias("_spans"))
    names_in = df.columns
    inner = [f"c{i}" for i in range(len(names_in))]
    place_of_text = names_in.index(text)
    plain = df.select(*[F.col(f"`{c}`").alias(i) for c, i in zip(names_in, inner, strict=True)])
    same = plain[inner[names_in.index(key)]].eqNullSafe(spans["_key"]) & (F.xxhash64(inner[place_of_text]) == spans["_tid"])
    joined = plain.join(spans, same, "left").drop("_key", "_tid")
    spans_kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def apply(batches):
        release()
        for batch in batches:
            for part, _ in by_bytes(batch, place_of_text, 1 << 21, 512):
                cut_spans = [merged([(s["start"], s["end"]) for s in x or ()]) for x in part.column(len(inner)).to_pylist()]
                texts = [t if t is None or not s else cut_out(t, s) for t, s in zip(part.column(place_of_text).to_pylist(), cut_spans, strict=True)]
                columns = list(part.columns[: len(inner)])
                columns[place_of_text] = pa.array(texts, pa.string())
                removed = pa.array([[{"start": a, "end": b} for a, b in s] for s in cut_spans], spans_kind)
                yield pa.RecordBatch.from_arrays([*columns, removed], [*inner, "removed"])

    schema = ", ".join(f"{i} {plain.schema[i].dataType.simpleString()}" for i in inner)
    out = joined.mapInArrow(apply, f"{schema}, removed array<struct<start: int, end: int>>")
    return out.toDF(*names_in, "removed")
