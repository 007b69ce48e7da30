"""Dataset readers: canonical interactions and item metadata from files that the caller has.  Nothing is downloaded."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import feather
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from ..functions import text as T
from ..operators.prepare import canonical, keep_first, number
from ..operators.rounds import Rounds
from . import arrow_files


@dataclass(frozen=True)
class DatasetSpec:
    seed: int
    val_users: int
    test_users: int
    user_min_support: int
    item_min_support: int
    min_value: float = 4.0
    set_values_to: float = 1.0


#: The defaults of the known data sets.
SPECS = {"goodbooks": DatasetSpec(0, 1000, 2500, 5, 1), "ml1m": DatasetSpec(42, 500, 1000, 5, 1), "ml20m": DatasetSpec(42, 2500, 5000, 5, 1), "amazon2023": DatasetSpec(42, 2500, 5000, 20, 20)}


#: Short names of categories, and the metadata columns that are kept.
CATEGORIES = {"beauty": "All_Beauty", "clothing": "Clothing_Shoes_and_Jewelry", "electronics": "Electronics", "toys": "Toys_and_Games", "toys_and_games": "Toys_and_Games"}
AMAZON_COLUMNS = ("item_id", "title", "store", "main_category", "categories", "features", "description", "details", "price", "average_rating", "rating_number")


def exists(spark: SparkSession, pattern: str) -> bool:
    """Whether any file matches, on whatever file system the path names."""
    target = spark._jvm.org.apache.hadoop.fs.Path(pattern)
    found = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(target)
    return bool(found)


def read_feather(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Columns of a Feather file as text.

    Version 2 files are read by many tasks, record batches apart, where Arrow knows the file system.  Other files are read whole by
    one task (2 GB at most)."""
    names, schema = list(columns), pa.schema([(c, pa.string()) for c in columns])
    if arrow_files.is_ipc(path):
        spark.dataSource.register(arrow_files.ArrowFiles)
        return spark.read.format("arrow_file").option("columns", ",".join(names)).load(path)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                yield from feather.read_table(pa.BufferReader(content.as_buffer())).select(names).cast(schema).to_batches(1 << 14)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, ", ".join(f"`{c}` string" for c in names))


def _described(items: DataFrame, root: str, key: str) -> DataFrame:
    """With the descriptions of ``item_text_descriptions.feather``, if the folder has them; items without one have null."""
    path = f"{root}/item_text_descriptions.feather"
    if not exists(items.sparkSession, path):
        return items
    given = read_feather(items.sparkSession, path, [key, "llama31_description"]).toDF("item_id", "description")
    return items.drop("description").join(given, "item_id", "left")


def read_ml1m(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """ratings.dat and movies.dat, separated by two colons, Latin-1; descriptions if there are any."""
    read = spark.read.option("sep", "::").option("encoding", "ISO-8859-1")
    ratings = read.schema("user string, item string, value string, at string").csv(f"{root}/ratings.dat")
    movies = read.schema("item_id string, title string, genres string").csv(f"{root}/movies.dat")
    return canonical(ratings, "user", "item", "value", "at"), _described(movies, root, "movieId")


def read_ml20m(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    ratings = spark.read.option("header", True).csv(f"{root}/ratings.csv")
    movies = spark.read.option("header", True).option("escape", '"').csv(f"{root}/movies.csv")
    return canonical(ratings, "userId", "movieId", "rating", "timestamp"), _described(movies.withColumnRenamed("movieId", "item_id"), root, "movieId")


def read_goodbooks(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    read = spark.read.option("header", True).option("escape", '"')
    books = _described(read.csv(f"{root}/books.csv").withColumnRenamed("book_id", "item_id"), root, "book_id")
    kept = [c for c in ("item_id", "title", "authors", "average_rating", "description") if c in books.columns]
    return canonical(read.csv(f"{root}/ratings.csv"), "user_id", "book_id", "rating"), books.select(kept)


def read_ml20m_tags(spark: SparkSession, root: str) -> DataFrame:
    """(item_id, tag): one row for each time a user gave a tag."""
    rows = spark.read.option("header", True).option("escape", '"').csv(f"{root}/tags.csv")
    return rows.select(F.col("movieId").alias("item_id"), "tag").na.drop()


def read_goodbooks_tags(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Weighted tags (item_id: the site's own book id, tag_id, count), their names (tag_id, tag_name), and the books
    (item_id, own_id) whose own ids those are."""
    read = spark.read.option("header", True).option("escape", '"')
    rows = read.csv(f"{root}/book_tags.csv").select(F.col("goodreads_book_id").alias("item_id"), "tag_id", number(F.col("count")).alias("count")).na.drop()
    books = read.csv(f"{root}/books.csv").select(F.col("book_id").alias("item_id"), F.col("goodreads_book_id").alias("own_id"))
    return rows, read.csv(f"{root}/tags.csv").select("tag_id", "tag_name"), books


def category(name: str) -> str:
    """A category's full name from a short one; other names stay."""
    if not name.strip():
        raise ValueError("the category is empty")
    return CATEGORIES.get(name.strip().lower(), name.strip())


def amazon_sources(root: str, name: str, part: str | None = None) -> list[tuple[str, str]]:
    """(ratings, metadata) paths below root of one category, first choice first: the Parquet release, then the JSON lines one.
    With a part (train, valid, test) the ratings are those of the split that comes with histories."""
    if part not in (None, "train", "valid", "test"):
        raise ValueError("part is train, valid or test")
    c = category(name)
    folder, file = ("timestamp_w_his", f"{c}.{part}") if part else ("rating_only", c)
    return [
        (f"{root}/huggingface/benchmark/0core/{folder}/{file}.csv", f"{root}/huggingface/raw_meta_{c}/*.parquet"),
        (f"{root}/mcauley/{file}.csv.gz", f"{root}/mcauley/meta_{c}.jsonl.gz"),
    ]


def _first_readable(paths: Sequence[str], read):
    """What read gives for the first path that it can read."""
    failures = []
    for p in paths:
        try:
            return read(p)
        except (AnalysisException, ValueError) as failure:
            failures.append(f"{p}: {failure}")
    raise FileNotFoundError("no source can be read: " + "; ".join(failures))


def _amazon_ratings(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.option("header", True).csv(path)
    missing = {"user_id", "parent_asin", "rating", "timestamp"} - set(rows.columns)
    if missing:
        raise ValueError(f"ratings lack {sorted(missing)}")
    return rows


def _images(items: DataFrame) -> Column:
    """Image structs from JSON text, a list of structs with some of the sizes, or a struct of lists."""
    kind, sizes = items.schema["images"].dataType, ("hi_res", "large", "thumb")
    if isinstance(kind, StringType):
        return T.parse_images(F.col("images"))
    if isinstance(kind, ArrayType):
        has = kind.elementType.fieldNames()
        return F.transform("images", lambda i: F.struct(*[(i[n] if n in has else F.lit(None)).cast("string").alias(n) for n in sizes]))
    has = kind.fieldNames()
    return F.arrays_zip(*[(F.col(f"images.{n}") if n in has else F.array().cast("array<string>")).alias(n) for n in sizes])


def _amazon_items(spark: SparkSession, path: str, images: bool, also: Sequence[str]) -> DataFrame:
    items = spark.read.json(path) if ".json" in path else spark.read.parquet(path)
    if "parent_asin" not in items.columns:
        raise ValueError("metadata lack parent_asin")
    items = items.withColumn("_at", F.monotonically_increasing_id()).withColumnRenamed("parent_asin", "item_id")
    items = keep_first(items.filter(F.col("item_id").isNotNull()), "item_id", "_at")
    kept = [F.col(c) for c in dict.fromkeys((*AMAZON_COLUMNS, *also)) if c in items.columns]
    if images and "images" in items.columns:
        urls = F.coalesce(T.image_urls(_images(items)), F.array().cast("array<string>"))
        kept += [F.coalesce(F.get(urls, F.lit(0)), F.lit("")).alias("image_url"), F.array_join(urls, " ").alias("image_urls")]
    return items.select(kept)


def read_amazon(spark: SparkSession, ratings: str | Sequence[str], metadata: str | Sequence[str], images: bool = False, also: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Ratings as CSV, metadata as Parquet or JSON lines (both may be compressed), each a path or several to try in turn.

    Of several rows of an item the first counts, in the order in which Spark lists and reads the files.  Metadata have the known
    columns and those in ``also``; with images, ``image_url`` (the best) and ``image_urls`` (all, by spaces)."""
    ways = [[p] if isinstance(p, str) else list(p) for p in (ratings, metadata)]
    rows = _first_readable(ways[0], lambda p: _amazon_ratings(spark, p))
    items = _first_readable(ways[1], lambda p: _amazon_items(spark, p, images, also))
    return canonical(rows, "user_id", "parent_asin", "rating", "timestamp"), items


def read_amazon_category(spark: SparkSession, root: str, name: str, images: bool = False, also: Sequence[str] = ()) -> tuple[DataFrame, DataFrame]:
    """A category's files below ``root``, from the first release that is there."""
    return read_amazon(spark, *zip(*amazon_sources(root, name), strict=True), images, also)


def read_amazon_history(spark: SparkSession, train: str | Sequence[str], valid: str | Sequence[str], test: str | Sequence[str]) -> dict[str, DataFrame]:
    """The parts train, valid and test of the split that comes with histories: (row_id, user_id, item_id, value, timestamp,
    history).  Row ids are given once and written, so that every reader sees the same."""
    out = {}
    for part, paths in (("train", train), ("valid", valid), ("test", test)):
        rows = _first_readable([paths] if isinstance(paths, str) else list(paths), lambda p: _amazon_ratings(spark, p))
        history = F.col("history") if "history" in rows.columns else F.lit(None).cast("string")
        at, value = number(F.col("timestamp")).alias("timestamp"), number(F.col("rating")).alias("value")
        rows = rows.select(F.monotonically_increasing_id().alias("row_id"), "user_id", F.col("parent_asin").alias("item_id"), value, at, history.alias("history"))
        out[part] = Rounds(spark).write(rows.na.drop(subset=["user_id", "item_id", "value"]))
    return out


def read_amazon_category_history(spark: SparkSession, root: str, name: str) -> dict[str, DataFrame]:
    return read_amazon_history(spark, *[[ratings for ratings, _ in amazon_sources(root, name, p)] for p in ("train", "valid", "test")])
