"""Interactions: canonical form, thresholds, support, iterative pruning, vocabularies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from .rounds import Rounds


def number(c: Column) -> Column:
    """A double, or null for anything that isn't a number; NaN is null."""
    x = c.try_cast("double")
    return F.when(~F.isnan(x), x)


def canonical(df: DataFrame, user: str, item: str, value: str, timestamp: str | None = None) -> DataFrame:
    """(user_id, item_id, value, timestamp); rows without user, item or number are dropped."""
    at = number(F.col(timestamp)) if timestamp else F.lit(None).cast("double")
    out = df.select(F.col(user).cast("string").alias("user_id"), F.col(item).cast("string").alias("item_id"), number(F.col(value)).alias("value"), at.alias("timestamp"))
    return out.na.drop(subset=["user_id", "item_id", "value"])


def threshold_binarize(df: DataFrame, at_least: float | None, constant: float | None) -> DataFrame:
    if at_least is not None:
        df = df.filter(F.col("value") >= at_least)
    return df if constant is None else df.withColumn("value", F.lit(float(constant)))


def with_support(df: DataFrame, key: str, at_least: int, distinct: str | None = None) -> DataFrame:
    """Rows whose key has enough rows, or enough distinct values of a column."""
    if at_least <= 1:
        return df
    n = F.count_distinct(distinct) if distinct else F.count(F.lit(1))
    return df.join(_spread(df.groupBy(key).agg(n.alias("_n")).filter(F.col("_n") >= at_least).select(key)), key, "left_semi").select(df.columns)


def _spread(keys: DataFrame) -> DataFrame:
    """Keys that meet rows where they are shuffled to: their number grows with the data, so they aren't sent through the driver."""
    return keys.hint("shuffle_hash")


def kcore(df: DataFrame, user_min: int, item_min: int, max_steps: int = 0, recount: int = 10_000_000) -> DataFrame:
    """Drops rare items, then rare users among what is left, until no row goes (or max_steps rounds).  Rows with a null id whose
    side has a least support go.

    Each round is a written table: the plan stays short, and lost executors cost one round.  Up to ``recount`` rows are counted
    anew in each round, as small jobs cost more than counting; more are peeled by differences, with the same result."""
    rounds = Rounds(df.sparkSession)
    kept, n = rounds.counted(df.na.drop(subset=[k for k, least in (("item_id", item_min), ("user_id", user_min)) if least > 1]))
    if n > recount and min(item_min, user_min) > 1:
        return peeled(kept, user_min, item_min, max_steps)
    step = 0
    while True:
        kept, after = rounds.counted(with_support(with_support(kept, "item_id", item_min), "user_id", user_min), kept)
        step, before, n = step + 1, n, after
        if n == before or (max_steps and step >= max_steps):
            return kept


def peeled(df: DataFrame, user_min: int, item_min: int, max_steps: int = 0, report: list | None = None) -> DataFrame:
    """``kcore`` of rows without null ids, for large tables and long tails of rounds.

    Degrees are counted once.  A half-round then looks only at keys that lost rows in the one before: what they lost is taken
    from their degrees, and the rows of those that fall below are read from their own buckets of a table kept by that key.
    ``report`` gets (key, rows read, rows that went) of each half-round."""
    least, bound = {"item_id": item_min, "user_id": user_min}, ["item_id", "user_id"]
    rounds = Rounds(df.sparkSession)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets, salts = max(32, parts), -(-parts // 32)

    def by(rows: DataFrame, key: str, other: str) -> DataFrame:
        """Rows in buckets of a key; a frequent key's rows are dealt to several tasks by the other key."""
        rows = rows.withColumn("_b", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
        return rounds.write(rows.repartition(parts, "_b", F.pmod(F.xxhash64(other), F.lit(salts))), by=("_b",))

    tables = {"item_id": by(df, "item_id", "user_id")}
    tables["user_id"] = by(tables["item_id"].select("item_id", "user_id"), "user_id", "item_id")
    degrees = {key: rounds.write(t.groupBy("_b", key).agg(F.count(F.lit(1)).alias("n"))) for key, t in tables.items()}
    gone: dict[str, list[DataFrame]] = {key: [] for key in bound}
    lost: dict[str, list[DataFrame]] = {key: [] for key in bound}
    half, (key, other) = 0, bound
    while not (max_steps and half >= 2 * max_steps):
        half += 1
        now = degrees[key]
        if lost[other]:
            fallen = rounds.union(lost[other])
            if half > 2:
                fallen = fallen.join(_spread(lost[other][-1].select(key).distinct()), key, "left_semi")
            now = now.join(_spread(fallen.groupBy(key).agg(F.count(F.lit(1)).alias("_lost"))), key, "inner" if half > 2 else "left")
            now = now.withColumn("n", F.col("n") - F.coalesce("_lost", F.lit(0)))
        out, n = rounds.counted(now.filter(F.col("n").between(1, least[key] - 1)).select("_b", key))
        if not n and half > 1:
            break
        if n:
            rows = tables[key].select("_b", *bound)
            if n <= 4 * buckets:
                rows = rows.filter(F.col("_b").isin([r[0] for r in out.select("_b").distinct().collect()]))
            read = Observation()
            rows = rows.observe(read, F.count(F.lit(1)).alias("n")).join(_spread(out.select(key)), key, "left_semi")
            if gone[other]:
                rows = rows.join(_spread(rounds.union(gone[other]).select(other)), other, "left_anti")
            rows, went = rounds.counted(rows.select(*bound))
            gone[key].append(out)
            lost[key].append(rows)
            if report is not None:
                report.append((key, read.get["n"], went))
        key, other = other, key
    kept = tables["item_id"]
    for key in bound:
        if gone[key]:
            kept = kept.join(_spread(rounds.union(gone[key]).select(key)), key, "left_anti")
    return kept.select(df.columns)


def restrict(df: DataFrame, items: DataFrame) -> DataFrame:
    return df.join(items.select("item_id").distinct(), "item_id", "left_semi").select(df.columns)


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return df.withColumn("_r", rank).filter("_r = 1").drop("_r")


def ranges(df: DataFrame, key: str, parts: int = 64) -> DataFrame:
    """df as a written table with the number ``_p`` of each row's range of keys."""
    return Rounds(df.sparkSession).write(df.repartitionByRange(parts, key).withColumn("_p", F.spark_partition_id()))


def vocabulary(df: DataFrame, key: str, index: str, parts: int = 64) -> DataFrame:
    """(index, key): distinct keys numbered in order of their text.  Ranges are written, numbered apart, then shifted by the
    sizes of the ranges before, so that no task holds all keys and every reader sees the same ranges."""
    keys = ranges(df.select(key).distinct(), key, parts)
    sizes = keys.groupBy("_p").count()
    before = sizes.select("_p", F.coalesce(F.sum("count").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))
    own = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    return keys.withColumn("_n", own).join(F.broadcast(before), "_p").select((F.col("_b") + F.col("_n") - 1).cast("long").alias(index), key)


def sparse_matrix(df: DataFrame, users: DataFrame, items: DataFrame) -> DataFrame:
    """(user_idx, item_idx, value): repeated cells are summed, unknown ids dropped."""
    return df.join(users, "user_id").join(items, "item_id").groupBy("user_idx", "item_idx").agg(F.sum("value").cast("float").alias("value"))
