"""Splits and holdouts.  Seeded draws rank by md5 of seed and ids, so that any engine can repeat them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import prepare
from .rounds import Rounds


def draw(seed: int | str, *ids: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[i.cast("string") for i in ids]))


def three_way(keys: DataFrame, key: str, n_val: int, n_test: int, seed: int) -> DataFrame:
    """(key, split): the first n_val of the seeded order are val, the next n_test test, the rest train.

    The draws' first four digits cut the order into 65,536 cells; a count of each says where the two ends lie, and only keys of
    those cells are ranked, each cell apart.  So any share may be held out."""
    drawn, total = Rounds(keys.sparkSession).counted(keys.select(key, draw(seed, F.col(key)).alias("_d")).withColumn("_c", F.substring("_d", 1, 4)))
    if n_val + n_test >= total:
        raise ValueError(f"val and test take {n_val + n_test} of {total}")
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cells = drawn.groupBy("_c").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", before)  # 65,536 rows at the most
    split = lambda at: F.when(at < n_val, "val").when(at < n_val + n_test, "test").otherwise("train")
    cells = cells.select("_c", "_b", split(F.col("_b")).alias("split"), (split(F.col("_b")) != split(F.col("_b") + F.col("_n") - 1)).alias("_cut"))
    placed = drawn.join(F.broadcast(cells), "_c")
    rank = F.col("_b") + F.row_number().over(Window.partitionBy("_c").orderBy("_d", key)) - 1
    cut = placed.filter("_cut").withColumn("split", split(rank))
    return placed.filter("not _cut").select(key, "split").unionByName(cut.select(key, "split"))


def fold_holdout(df: DataFrame, items: DataFrame, seed: int, draws: int, min_items: int, share: float = 0.2) -> DataFrame:
    """(draw, user_id, item_id, is_target): of each user's distinct known items, in each draw the first ceil(share n) of a
    seeded order are targets.  Draws are independent."""
    own = df.join(items.select("item_id").distinct(), "item_id", "left_semi") if items is not df else df
    # One shuffle by user serves the distinct items, their number and all draws; only then is each row repeated for its draws.
    own = own.filter(F.col("item_id").isNotNull()).select("user_id", "item_id").repartition("user_id").distinct()
    own = own.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("user_id"))).filter(F.col("_n") >= min_items)
    order = lambda d: [draw(seed, F.lit(d), F.col("user_id"), F.col("item_id")), "item_id"]
    ranks = [F.row_number().over(Window.partitionBy("user_id").orderBy(*order(d))) <= F.ceil(F.col("_n") * F.lit(share)) for d in range(draws)]
    own = own.select("user_id", "item_id", F.array(*ranks).alias("_t")).select("user_id", "item_id", F.posexplode("_t").alias("draw", "is_target"))
    return own.select(F.col("draw").cast("long").alias("draw"), "user_id", "item_id", "is_target")


def _both(df: DataFrame, source: Column, target: Column, min_source: int, min_target: int) -> DataFrame:
    out = df.groupBy("user_id").agg(F.sort_array(F.collect_set(F.when(source, F.col("item_id")))).alias("source"), F.sort_array(F.collect_set(F.when(target, F.col("item_id")))).alias("target"))
    return out.filter((F.size("source") >= min_source) & (F.size("target") >= min_target))


def item_cold_holdout(df: DataFrame, parts: DataFrame, target: str = "test", min_source: int = 1, min_target: int = 1) -> DataFrame:
    """(user_id, source, target): each user's train items, and those of a cold part."""
    return _both(df.join(parts, "item_id"), F.col("split") == "train", F.col("split") == target, min_source, min_target)


def leave_last_out(df: DataFrame, min_source: int = 1, min_target: int = 1) -> DataFrame:
    """(user_id, source, target): the latest row's item is the target; of equal times the largest item id."""
    if df.filter(F.col("timestamp").isNotNull()).isEmpty():
        raise ValueError("timestamps are needed")
    user = Window.partitionBy("user_id")
    rows = df.filter(F.col("timestamp").isNotNull()).withColumn("_n", F.count(F.lit(1)).over(user)).filter(F.col("_n") >= min_source + min_target)
    rows = rows.withColumn("_last", F.row_number().over(user.orderBy(F.desc("timestamp"), F.desc("item_id"))) == 1)
    return _both(rows, ~F.col("_last"), F.col("_last"), min_source, 1)


def temporal_cutoff(df: DataFrame, test_frac: float) -> DataFrame:
    if not 0 < test_frac < 1:
        raise ValueError("test_frac must lie between 0 and 1")
    # Exact, and without all timestamps in one task: ranges of counted timestamps, and ranks inside the ones that matter.
    cells = prepare.ranges(df.filter(F.col("timestamp").isNotNull()).groupBy("timestamp").count(), "timestamp")
    sizes = cells.groupBy("_p").agg(F.sum("count").alias("size"))  # a row for each range
    before = F.coalesce(F.sum("size").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    at = (F.sum("size").over(Window.partitionBy()) - 1) * F.lit(1 - test_frac)
    sizes = sizes.select("_p", "size", before.alias("first"), at.alias("at")).filter("first <= ceil(at) and floor(at) < first + size")
    here = cells.join(F.broadcast(sizes), "_p")
    end = F.col("first") + F.sum("count").over(Window.partitionBy("_p").orderBy("timestamp"))
    here = here.withColumn("end", end).filter("end - count <= ceil(at) and floor(at) < end")
    low, high, at = F.min("timestamp"), F.max("timestamp"), F.first("at")
    return here.agg(F.when(low == high, low).otherwise((F.ceil(at) - at) * low + (at - F.floor(at)) * high).alias("cutoff"))


def temporal_holdout(df: DataFrame, test_frac: float, min_source: int = 1, min_target: int = 1) -> DataFrame:
    """(user_id, source, target): items up to the cutoff, and those after it."""
    rows = df.crossJoin(F.broadcast(temporal_cutoff(df, test_frac)))  # one row
    return _both(rows, F.col("timestamp") <= F.col("cutoff"), F.col("timestamp") > F.col("cutoff"), min_source, min_target)


def train_rows(df: DataFrame, holdout: DataFrame) -> DataFrame:
    """Rows on items that are nobody's target."""
    targets = holdout.select(F.explode("target").alias("item_id")).distinct()
    return df.join(targets, "item_id", "left_anti").select(df.columns)


def history_holdout(held_out: DataFrame, train: DataFrame, min_source: int = 1) -> DataFrame:
    """(row_id, user_id, source, target) from rows (row_id, user_id, item_id, history) that come with their own past.

    A row counts if its item is no train item; its source is what the white-space separated history has of train items, each
    once and sorted.  The history may be a list too.  A user may own several rows."""
    items = train.select("item_id").distinct()
    rows = held_out.join(items, "item_id", "left_anti")
    given = F.col("history") if held_out.schema["history"].dataType.typeName() == "array" else F.split("history", r"\s+")
    past = rows.select("row_id", F.explode(given).alias("item_id")).join(items, "item_id", "left_semi")
    source = past.groupBy("row_id").agg(F.sort_array(F.collect_set("item_id")).alias("source")).filter(F.size("source") >= min_source)
    return rows.join(source, "row_id").select("row_id", "user_id", "source", F.array("item_id").alias("target"))
