"""Benchmark decontamination by spaced seeds (operator 6), by DataFrame functions only.

A mask lists the token positions of a window that count; the others may differ.  The masked tokens of each window of the
training documents and of the benchmark items are hashed, and equal hashes are joined.  A hit aligns the two texts; along
the alignment the tokens are compared, and the document is contaminated if some ``window`` tokens in a row (or the whole
item, if shorter) agree in at least ``similarity`` of their positions.

Tokens are runs of letters and digits in lower case.  Items of ``SHORT`` tokens or fewer, for which no mask would do, are
cut into one piece more than they may have substitutions, so that one piece is always whole; pieces are masks without gaps.
Documents are hashed for those lengths of pieces only that the benchmark has.  Seeds, hits and items are broadcast only if
there are no more than ``broadcast_rows``; beyond that they are joined by shuffle.

Null texts are empty.  Documents with null keys are found like others.  Repeated rows give the same result once, documents
of one key with different texts the best of all.  Items with null keys count as one item each text.  Extra columns are
ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Fixed masks: four positions each, spans of seven and eight tokens.
MASKS = ((0, 1, 4, 6), (0, 2, 3, 7))
SHORT = 10


def pieces(length: int, similarity: float) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a short item: one more than its allowed substitutions."""
    parts = length - math.ceil(length * similarity) + 1
    cuts = [length * k // parts for k in range(parts + 1)]
    return list(zip(cuts[:-1], (b - a for a, b in zip(cuts[:-1], cuts[1:], strict=True)), strict=True))


def token_hashes(text: Column) -> Column:
    words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
    return F.transform(F.array_remove(words, ""), lambda w: F.xxhash64(w))


def seeds(h: Column, masks: list[tuple[int, ...]]) -> Column:
    """``array<long>``: for each mask the hash at every token's position (null where the mask overruns the text), one mask
    after another."""
    at = F.when(F.size(h) > 0, F.sequence(F.lit(0), F.size(h) - 1)).otherwise(F.array().cast("array<int>"))

    def masked(mask: tuple[int, ...]) -> Column:
        name = F.lit(",".join(map(str, mask)))
        return F.transform(at, lambda i: F.when(i + mask[-1] < F.size(h), F.xxhash64(name, *[F.get(h, i + o) for o in mask])))

    return F.flatten(F.array(*[masked(m) for m in masks]))


def _hashed(df: DataFrame, key: str, text: str) -> DataFrame:
    """(_key, _id, _h): tokens of each text, and a hash that tells it from other texts of its key."""
    return df.select(F.col(key).alias("_key"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("_id"), token_hashes(F.col(text)).alias("_h"))


def _windows(rows: DataFrame, masks: list[tuple[int, ...]]) -> DataFrame:
    """One row per seed: its text's key and id, the seed's position and hash.  Tokens don't travel with the seeds, or long
    texts would be copied once per token."""
    h = rows.select("_key", "_id", F.size("_h").alias("_n"), seeds(F.col("_h"), masks).alias("_seeds"))
    # An inner explode would have the optimiser test size(_seeds) > 0 beside the scan, with the hashing spelled out again.
    out = h.select("_key", "_id", "_n", F.posexplode_outer("_seeds").alias("_p", "seed"))
    return out.filter(F.col("seed").isNotNull()).select("_key", "_id", F.pmod("_p", "_n").alias("_at"), "seed")


def _item_seeds(items: DataFrame, masks: tuple[tuple[int, ...], ...], similarity: float) -> tuple[DataFrame, list[tuple[int, ...]]]:
    """Seeds of all items, and the masks that documents need for them."""
    lengths = sorted(r["n"] for r in items.select(F.size("_h").alias("n")).filter(f"n between 1 and {SHORT}").distinct().collect())  # at most SHORT rows
    out, used = _windows(items.filter(F.size("_h") > SHORT), list(masks)), list(masks)
    for n in lengths:
        for start, size in pieces(n, similarity):
            mask = tuple(range(size))
            own = items.filter(F.size("_h") == n).withColumn("_h", F.slice("_h", start + 1, size))
            out = out.unionByName(_windows(own, [mask]).filter("_at = 0").withColumn("_at", F.lit(start)))
            used += [mask] if mask not in used else []
    return out, used


def _best(a: Column, b: Column, diagonal: Column, window: int) -> tuple[Column, Column, Column]:
    """Along a diagonal (position in a less position in b): tokens compared, window length and most matches in a window."""
    start = F.greatest(F.lit(0), -diagonal)
    length = F.least(F.size(b), F.size(a) - diagonal) - start
    same = F.zip_with(F.slice(a, start + diagonal + 1, length), F.slice(b, start + 1, length), lambda x, y: (x == y).cast("int"))
    size = F.least(F.lit(window), F.size(b))
    sums = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), length - size + 1)), lambda i: F.aggregate(F.slice(same, i, size), F.lit(0), lambda s, x: s + x))
    return length, size, F.array_max(sums)


def contaminated(
    docs: DataFrame, items: DataFrame, key: str, text: str, item_key: str, item_text: str, window: int = 13, similarity: float = 0.8, masks: tuple[tuple[int, ...], ...] = MASKS, broadcast_rows: int = 200_000
) -> DataFrame:
    """``(key, item_key, doc_start, tokens_compared, window_matches)``: the best alignment of each contaminated document
    and item; doc_start is the token of the document where the item's alignment starts."""
    scratch = Scratch(docs.sparkSession, "decontaminate")
    small = lambda t: F.broadcast(t) if t.count() <= broadcast_rows else t
    d, b = _hashed(docs, key, text), _hashed(items, item_key, item_text).distinct()
    item_seeds, used = _item_seeds(b, masks, similarity)
    item_seeds = item_seeds.select(F.col("_key").alias("i"), F.col("_id").alias("i_id"), F.col("_at").alias("i_at"), "seed")
    pairs = _windows(d, used).join(small(item_seeds), "seed")
    pairs = scratch.write(pairs.select(F.col("_key").alias("d"), F.col("_id").alias("d_id"), "i", "i_id", (F.col("_at") - F.col("i_at")).alias("diagonal")).distinct())
    own = b.select(F.col("_key").alias("k"), F.col("_id").alias("i_id"), F.col("_h").alias("i_h"))
    hits = pairs.join(own, F.col("i").eqNullSafe(F.col("k")) & (pairs["i_id"] == own["i_id"])).select("d", "d_id", "i", "diagonal", "i_h")
    hits = (F.broadcast(hits) if pairs.count() <= broadcast_rows else hits).alias("hits")
    hits = d.join(hits, F.col("d").eqNullSafe(F.col("_key")) & (F.col("_id") == F.col("d_id"))).select("d", "i", "diagonal", F.col("_h").alias("d_h"), "i_h")
    diagonal = F.col("diagonal")
    length, size, best = _best(F.col("d_h"), F.col("i_h"), diagonal, window)
    hits = hits.select("d", "i", F.greatest(F.lit(0), diagonal).alias("doc_start"), length.alias("compared"), size.alias("_size"), best.alias("matches"))
    hits = hits.filter((F.col("compared") >= F.col("_size")) & (F.col("matches") >= F.ceil(F.col("_size") * F.lit(similarity))))
    top = F.max(F.struct("matches", "compared", (-F.col("doc_start")).alias("s"))).alias("top")
    out = hits.groupBy("d", "i").agg(top)
    return out.select(
        F.col("d").alias(key), F.col("i").alias(item_key), (-F.col("top.s")).cast("long").alias("doc_start"), F.col("top.compared").cast("long").alias("tokens_compared"), F.col("top.matches").cast("long").alias("window_matches")
    )
