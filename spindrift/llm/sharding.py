"""Sharding by a hierarchical weighted hash tree (operator 7).

The tree has the levels region, rack and shard.  A row descends it: at every node each child draws ln(u) / weight, where
u in (0, 1) is a hash of the row's key and the child's path, and the largest draw wins.  A child thus receives rows in
proportion to its weight, which is the sum of the weights below it, and a changed weight moves rows only into or out of
the subtree that changed.  ``grow`` hangs a new shard under a region of its own, so that no other weight changes and all
rows that move go to the new shard.

Rows with a null key share one key, the empty string.  Repeated rows get distinct slots.  Ties between draws go to the
lower child.  Extra columns are ignored.  An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

Tree = dict[str, dict[str, dict[int, float]]]


def even_tree(shards: int, per_rack: int = 2, racks_per_region: int = 2) -> Tree:
    """Shards 0 to shards-1 of weight 1, filled into racks and regions in order."""
    tree: Tree = {}
    for s in range(shards):
        rack = s // per_rack
        tree.setdefault(f"r{rack // racks_per_region}", {}).setdefault(f"k{rack}", {})[s] = 1.0
    return tree


def grow(tree: Tree, weight: float = 1.0) -> Tree:
    """The tree with one more shard, in a new rack of a new region."""
    new = 1 + max(s for racks in tree.values() for shards in racks.values() for s in shards)
    return tree | {f"grown{new}": {f"grown{new}": {new: weight}}}


def _draw(key: Column, path: str, weight: float) -> Column:
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(path)), 11).cast("double")
    return F.log((bits + 0.5) / F.lit(float(2**53))) / F.lit(float(weight))


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """The value of the child with the largest draw."""
    if len(children) == 1:
        return children[0][2]
    draws = [_draw(key, path, w) for path, w, _ in children]
    best = F.greatest(*draws)
    out = children[-1][2]
    for d, (_, _, value) in reversed(list(zip(draws[:-1], children[:-1], strict=True))):
        out = F.when(d == best, value).otherwise(out)
    return out


def place(key: Column, tree: Tree) -> Column:
    """The shard of a key: one draw for each child of each node on the way down."""
    total = lambda shards: sum(shards.values())
    regions = []
    for region, racks in tree.items():
        inner = []
        for rack, shards in racks.items():
            leaves = [(f"{region}/{rack}/{s}", w, F.lit(s)) for s, w in shards.items()]
            inner.append((f"{region}/{rack}", total(shards), _winner(key, leaves)))
        regions.append((region, sum(map(total, racks.values())), _winner(key, inner)))
    return _winner(key, regions)


def shard(df: DataFrame, key: str, text: str, tree: Tree, cells: int = 512) -> DataFrame:
    """Shard, slot and size of every row: ``(key, size, text_crc32, shard, grown_shard, slot)``.

    Slots count from 0 without gaps in each shard.  They are dealt in two steps, so that no task holds a shard: rows are
    numbered inside ``cells`` hash cells of each shard, and a table of shards x cells counts (bounded by the parameters,
    so it may be broadcast) gives the number of rows in the cells before.
    """
    as_text = F.coalesce(F.col(key).cast("string"), F.lit(""))
    rows = df.select(
        F.col(key).alias("_key"),
        F.coalesce(F.octet_length(F.col(text)), F.lit(0)).cast("long").alias("size") + F.lit(1),
        F.crc32(F.encode(F.coalesce(F.col(text), F.lit("")), "UTF-8")).alias("text_crc32"),
        place(as_text, tree).alias("shard"),
        place(as_text, grow(tree)).alias("grown_shard"),
        F.pmod(F.xxhash64(as_text, F.lit("cell")), F.lit(cells)).cast("int").alias("_cell"),
    ).toDF("_key", "size", "text_crc32", "shard", "grown_shard", "_cell")
    counts = rows.groupBy("shard", "_cell").count()
    before = Window.partitionBy("shard").orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("shard", "_cell", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    own = Window.partitionBy("shard", "_cell").orderBy("_key", "text_crc32", "size")
    out = rows.withColumn("_n", F.row_number().over(own)).join(F.broadcast(counts), ["shard", "_cell"])
    return out.select(
        F.col("_key").alias(key), "size", "text_crc32", "shard", "grown_shard", (F.col("_before") + F.col("_n") - 1).cast("long").alias("slot")
    )
