"""Item tags: from a delimited column, from user tags, from weighted tags with two dimension tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import strip


def genre_tags(items: DataFrame, column: str, order: str) -> DataFrame:
    """(item_id, tag, tag_idx, weight): pieces between bars; tags are numbered as first met in the items' order."""
    parts = items.select("item_id", F.col(order).alias("_o"), F.posexplode(F.split(column, r"\|")).alias("_p", "tag"))
    parts = parts.withColumn("tag", strip(F.col("tag"))).filter(~F.col("tag").isin("", "(no genres listed)"))
    first = parts.groupBy("tag").agg(F.min(F.struct("_o", "_p")).alias("_f"))
    index = first.select("tag", (F.row_number().over(Window.orderBy("_f")) - 1).cast("long").alias("tag_idx"))  # as many rows as genres
    return parts.groupBy("item_id", "tag").agg(F.count(F.lit(1)).alias("weight")).join(index, "tag").select("item_id", "tag", "tag_idx", "weight")


def user_tags(tags: DataFrame, items: DataFrame, min_count: int) -> DataFrame:
    """(item_id, tag, weight): tags with enough rows anywhere, counted on known items."""
    if min_count < 1:
        raise ValueError("min_count must be 1 or more")
    rows = tags.select("item_id", F.lower(strip(F.col("tag"))).alias("tag")).filter(F.coalesce("tag", F.lit("")) != "")
    kept = rows.groupBy("tag").count().filter(F.col("count") >= min_count).select("tag")
    return rows.join(kept, "tag", "left_semi").join(items.select("item_id").distinct(), "item_id", "left_semi").groupBy("item_id", "tag").agg(F.count(F.lit(1)).alias("weight"))


def weighted_tags(rows: DataFrame, names: DataFrame, min_count: float) -> DataFrame:
    """(item_id, tag, weight): positive counts of tag ids that add up to enough, summed by name."""
    rows = rows.filter(F.col("count") > 0)
    kept = rows.groupBy("tag_id").agg(F.sum("count").alias("s")).filter(F.col("s") >= min_count).select("tag_id")
    named = names.select("tag_id", F.lower(strip(F.col("tag_name"))).alias("tag")).filter("tag <> ''")
    return rows.join(kept, "tag_id", "left_semi").join(named, "tag_id").groupBy("item_id", "tag").agg(F.sum("count").alias("weight"))
