"""Arrow files, batches for training, texts of nested values, splits by share: each against a plain version."""

import hashlib
import math

import pandas as pd
import pyarrow as pa
import pytest
from pyarrow import feather
from pyspark.sql import types as K

from spindrift.functions import text as T
from spindrift.operators import splits
from spindrift.sources import arrow_files, batches, datasets


def test_batches_of_a_file_go_to_many_tasks(spark, tmp_path):
    table = pa.table({"n": list(range(1000)), "text": [None if i % 7 == 0 else f"t{i}" for i in range(1000)], "rest": ["x" * 100] * 1000})
    feather.write_feather(table, f"{tmp_path}/a.feather", chunksize=100)
    expected = sorted((str(i), None if i % 7 == 0 else f"t{i}") for i in range(1000))
    df = datasets.read_feather(spark, f"file://{tmp_path}/a.feather", ["text", "n"])
    assert df.columns == ["text", "n"] and sorted((r.n, r.text) for r in df.collect()) == expected
    size = (tmp_path / "a.feather").stat().st_size
    for task_bytes, parts in ((1, 10), (size // 5 + 1, 5), (size, 1)):
        df = spark.read.format("arrow_file").option("columns", "n,text").option("task_bytes", task_bytes).load(f"file://{tmp_path}/a.feather")
        assert df.rdd.getNumPartitions() == parts and sorted(map(tuple, df.collect())) == expected
    with pytest.raises(Exception, match="no columns"):
        datasets.read_feather(spark, f"{tmp_path}/a.feather", ["other"]).collect()


def test_older_and_empty_files(spark, tmp_path):
    feather.write_feather(pa.table({"a": [1, 2]}), f"{tmp_path}/v1.feather", version=1)
    assert not arrow_files.is_ipc(f"{tmp_path}/v1.feather") and not arrow_files.is_ipc(f"{tmp_path}/none")
    assert sorted(r.a for r in datasets.read_feather(spark, f"file://{tmp_path}/v1.feather", ["a"]).collect()) == ["1", "2"]
    pd.DataFrame({"a": pd.Series([], dtype="int64")}).to_feather(tmp_path / "e.feather")
    assert datasets.read_feather(spark, f"file://{tmp_path}/e.feather", ["a"]).collect() == []


def test_batches_repeat_with_the_seed(spark):
    df = spark.range(1000).selectExpr("id", "array(id % 3) as l", "map('k', id) as m")
    def run(n, **how):
        return [b["id"] for b in batches.batches(df.repartition(n), 64, partition_rows=300, **how)]
    one = run(3, seed=1, epochs=2)
    assert [len(b) for b in one] == ([64] * 15 + [40]) * 2 and one == run(7, seed=1, epochs=2)
    first, second = sum(one[:16], []), sum(one[16:], [])
    assert sorted(first) == sorted(second) == list(range(1000)) and first != second and first != sorted(first)
    assert sum(run(3, seed=2), []) != first and len(run(3, seed=1, drop_last=True)) == 15
    assert list(batches.batches(df, 600, collate=len)) == [600, 400] and list(batches.batches(df.limit(0), 5, seed=1)) == []
    with pytest.raises(ValueError):
        next(batches.batches(df, 0))


def test_a_partition_is_of_bounded_size(spark):
    sizes = batches.shuffled(spark.range(10_000).toDF("x"), 5, 0, 10).groupBy("x").count()
    parts = batches.shuffled(spark.range(10_000).toDF("x"), 5, 0, 10).rdd.glom().map(len).collect()
    assert sizes.count() == 10_000 and len(parts) == 10 and max(parts) < 3000


def test_hf_needs_the_library(spark, tmp_path):
    try:
        import datasets as _  # noqa: F401
    except ImportError:
        with pytest.raises(ImportError, match="needs the library"):
            batches.to_hf_dataset(spark.range(3), f"{tmp_path}/h")


def plain(value):
    """A nested value as text, by recursion."""
    if value is None or isinstance(value, float) and math.isnan(value):
        return ""
    if isinstance(value, dict):
        return " ".join(f"{k}: {t}" for k, t in ((k, plain(v)) for k, v in value.items()) if t).strip()
    if isinstance(value, list):
        return " ".join(t for t in map(plain, value) if t).strip()
    return str(value).strip()


def test_nested_values_as_text(spark):
    kind = K._parse_datatype_string("struct<a: array<array<string>>, m: map<string, struct<x: double, y: boolean, z: array<map<string, int>>>>, n: int>")
    values = [
        {"a": [[" p ", None, ""], [], ["q r"]], "m": {"k": {"x": 1.5, "y": True, "z": [{"u": 1, "v": None}, {}]}, "l": {"x": math.nan, "y": None, "z": []}}, "n": 3},
        {"a": None, "m": {"": {"x": -2.0, "y": False, "z": None}}, "n": None},
        {"a": [[]], "m": {}, "n": 0},
        {"a": [None, ["\u00a0"]], "m": None, "n": None},
        None,
    ]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], K.StructType([K.StructField("i", K.IntegerType()), K.StructField("v", kind)]))
    found = {r.i: r.t for r in df.select("i", T.value_text(df.v, kind).alias("t")).collect()}
    assert found == {i: plain(v) for i, v in enumerate(values)} and found[0] == "a: p q r m: k: x: 1.5 y: True z: u: 1 n: 3"


@pytest.mark.parametrize("n_val, n_test", [(0, 0), (1, 0), (0, 1), (300, 500), (999, 0), (0, 999), (500, 499)])
def test_split_by_any_share(spark, n_val, n_test):
    order = sorted((str(i) for i in range(1000)), key=lambda i: (hashlib.md5(f"9:{i}".encode()).hexdigest(), i))
    expected = {i: "val" if r < n_val else "test" if r < n_val + n_test else "train" for r, i in enumerate(order)}
    keys = spark.range(1000).selectExpr("cast(id as string) as item_id")
    found = splits.three_way(keys, "item_id", n_val, n_test, 9).collect()
    assert len(found) == 1000 and {r.item_id: r.split for r in found} == expected
    with pytest.raises(ValueError):
        splits.three_way(keys, "item_id", 500, 500, 9)
