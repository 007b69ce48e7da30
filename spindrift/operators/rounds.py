"""Tables written between the rounds of a job."""

from __future__ import annotations

import atexit
import uuid
from tempfile import mkdtemp

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


_left: list[tuple[SparkSession, str]] = []


def _delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clear() -> None:
    for spark, path in _left:
        try:
            _delete(spark, path)
        except Exception:  # noqa: BLE001  the session may have ended
            return


class Rounds:
    """Tables of one run in the folder that the cluster shares; a round's table goes once a later one is written, what is left
    when the driver ends."""

    def __init__(self, spark):
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root:
            if not spark.sparkContext.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            root = "file://" + mkdtemp(prefix="spindrift-rounds-")
        self.spark, self.base, self.n = spark, f"{root.rstrip('/')}/rounds-{uuid.uuid4().hex}", 0
        _left.append((spark, self.base))

    def write(self, df: DataFrame, before: DataFrame | None = None, by: tuple[str, ...] = ()) -> DataFrame:
        self.n += 1
        path = f"{self.base}/{self.n}"
        df.write.partitionBy(*by).parquet(path)
        if before is not None:
            self.drop(before)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._path = path
        return out

    def union(self, tables: list[DataFrame]) -> DataFrame:
        """The rows of several written tables of one schema."""
        return self.spark.read.schema(tables[0].schema).parquet(*[t._path for t in tables])

    def drop(self, table: DataFrame) -> None:
        _delete(self.spark, table._path)

    def counted(self, df: DataFrame, before: DataFrame | None = None) -> tuple[DataFrame, int]:
        """The written table and its number of rows, counted on the way."""
        seen = Observation()
        out = self.write(df.observe(seen, F.count(F.lit(1)).alias("n")), before)
        return out, seen.get["n"]
