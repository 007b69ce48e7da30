"""A checkpoint: a folder of Parquet tables and numbered manifests, of which the last names those that count.

Every write goes to a new folder inside; a manifest with the next number is made at the end, and only if no other writer has
made that number.  Whatever fails before leaves the old checkpoint as it was, and readers see one version or the other.  A writer
that comes second takes over what the first one wrote, so that no stage is lost; it fails if its own stages were made from one
that the first has written anew.  File systems with an exclusive rename get a finished file under its number by renaming, all
others by creating it without overwriting, which object stores do as a whole when the file is closed.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import prepare

FORMAT, VERSION = "spindrift-checkpoint", 2
#: The one manifest of layout 1; it counts as number 0.
FIRST = "manifest.json"
RENAMING = ("file", "hdfs", "viewfs", "abfs", "abfss")
#: What has been made from a stage and goes when that stage is written anew.
DEPENDENTS = {"data": ("elsa", "compressed_elsa", "sae", "text", "text_sae", "clusters"), "elsa": ("sae",), "text": ("text_sae",)}
HOLDOUT = "user_id string, source array<string>, target array<string>"


class ConcurrentUpdate(RuntimeError):
    """Another writer has renewed a stage from which this one's were made."""


class Checkpoint:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._staged: dict[str, dict] = {}
        self._noted: list[tuple[str, str, str, dict]] = []
        self.seen: dict[str, dict] = {}

    def _file(self, name: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return target.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), target

    def newest(self) -> int:
        """The last manifest's number."""
        system, pattern = self._file("manifest*.json")
        names = [f.getPath().getName() for f in system.globStatus(pattern) or ()]
        numbers = [0 if n == FIRST else int(m[1]) for n in names if n == FIRST or (m := re.fullmatch(r"manifest-(\d+)\.json", n))]
        if not numbers:
            raise FileNotFoundError(f"no checkpoint at {self.path}")
        return max(numbers)

    def manifest(self, number: int | None = None) -> dict:
        number = self.newest() if number is None else number
        found = json.loads(self.spark.read.text(f"{self.path}/{_name(number)}", wholetext=True).first()[0])
        if found.get("format") != FORMAT:
            raise ValueError(f"{self.path} is no checkpoint of this library")
        return found

    def stages(self) -> list[str]:
        return sorted(self.manifest()["stages"])

    def details(self, stage: str) -> dict:
        return self._stage(stage)["details"]

    def _stage(self, stage: str) -> dict:
        stages = self.manifest()["stages"]
        if stage not in stages:
            raise KeyError(f"the checkpoint has no stage {stage}, but {sorted(stages)}")
        return stages[stage]

    def table(self, stage: str, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{self.version(stage, name)}")

    def version(self, stage: str, name: str) -> str:
        """The folder of a table: a new one each time that it is written, so it tells versions apart."""
        tables = self._stage(stage)["tables"]
        if name not in tables:
            raise KeyError(f"stage {stage} has no table {name}, but {sorted(tables)}")
        return tables[name]

    def tables(self, stage: str) -> dict[str, DataFrame]:
        return {n: self.spark.read.parquet(f"{self.path}/{p}") for n, p in sorted(self._stage(stage)["tables"].items())}

    def metrics(self, stage: str, of: str) -> dict | None:
        """What has been noted about a stage under the name ``of``."""
        return self._stage(stage).get("metrics", {}).get(of)

    def put(self, stage: str, tables: dict[str, DataFrame], details: dict | None = None) -> None:
        """Write a stage's tables; they count once the surrounding ``update`` ends well."""
        json.dumps(details or {})
        folder = f"{stage}-{uuid.uuid4().hex}"
        self._staged[stage] = {"tables": {n: f"{folder}/{n}" for n in tables}, "details": details or {}, "folder": folder}
        for n, df in tables.items():
            df.write.parquet(f"{self.path}/{folder}/{n}")

    def staged(self, stage: str, name: str) -> DataFrame:
        """A table as this update has written it."""
        return self.spark.read.parquet(f"{self.path}/{self._staged[stage]['tables'][name]}")

    def note(self, stage: str, of: str, metrics: dict) -> None:
        """Keep metrics of a stage under the name ``of``; they go with the stage, and count once ``update`` ends well."""
        json.dumps(metrics)
        self._noted.append((stage, self._stage(stage)["folder"], of, metrics))

    def _remove(self, folders: list[str]) -> None:
        for f in folders:
            system, target = self._file(f)
            system.delete(target, True)

    def _publish(self, number: int, content: dict) -> bool:
        """Make the manifest of that number; False if there is one."""
        system, target = self._file(_name(number))
        renames = system.getUri().getScheme() in RENAMING
        draft = self._file(f".draft-{uuid.uuid4().hex}")[1] if renames else target
        try:
            stream = system.create(draft, False)
            stream.write(bytearray(json.dumps(content, indent=2, sort_keys=True).encode()))
            stream.close()
            if renames:
                jvm = self.spark._jvm
                how = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
                jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self.spark.sparkContext._jsc.hadoopConfiguration()).rename(draft, target, how)
        except Py4JJavaError:
            if not system.exists(target):
                raise
            if renames:
                system.delete(draft, False)
            return False
        return True


def _name(number: int) -> str:
    return f"manifest-{number:08d}.json" if number else FIRST


def _state(at: Checkpoint) -> tuple[int, dict]:
    try:
        number = at.newest()
    except FileNotFoundError:
        return 0, {}
    return number, at.manifest(number)["stages"]


def _folder(stages: dict, name: str) -> str | None:
    return stages.get(name, {}).get("folder")


@contextmanager
def update(spark: SparkSession, path: str, since: Checkpoint | None = None) -> Iterator[Checkpoint]:
    """Stages ``put`` inside take effect together at the end; an exception drops them all.

    Two updates that are open at once both take effect; of a stage that both write, the one that ends last stays.  ``since`` is the
    checkpoint, as read, from which the stages were made, if that was before the update."""
    out = Checkpoint(spark, path)
    seen = since.seen if since else _state(out)[1]
    try:
        yield out
        while True:
            number, before = _state(out)
            made_from = {s for s, then in DEPENDENTS.items() if s not in out._staged and set(then) & set(out._staged)}
            renewed = sorted(s for s in made_from if _folder(seen, s) != _folder(before, s))
            if renewed:
                raise ConcurrentUpdate(f"{renewed} changed while {sorted(out._staged)} were made from the version before")
            stale = {d for s in out._staged for d in DEPENDENTS.get(s, ())} - set(out._staged)
            stages = {s: v for s, v in before.items() if s not in stale} | out._staged
            for stage, folder, of, metrics in out._noted:
                if _folder(stages, stage) == folder:
                    stages[stage] = stages[stage] | {"metrics": stages[stage].get("metrics", {}) | {of: metrics}}
            if stages == before and number:
                return
            if out._publish(number + 1, {"format": FORMAT, "version": VERSION, "stages": stages}):
                break
    except BaseException:
        out._remove([s["folder"] for s in out._staged.values()])
        raise
    out._remove([v["folder"] for s, v in before.items() if _folder(stages, s) != v["folder"]])


def read(spark: SparkSession, path: str) -> Checkpoint:
    out = Checkpoint(spark, path)
    out.seen = out.manifest()["stages"]
    return out


def cells(holdout: DataFrame, column: str, items: DataFrame) -> DataFrame:
    """(user_id, item_idx, value): a holdout's lists as the cells of a matrix; items without a number are left out."""
    flat = holdout.select("user_id", F.explode(column).alias("item_id")).distinct()
    return flat.join(items, "item_id").select("user_id", "item_idx", F.lit(1.0).cast("float").alias("value"))


def load_split(at: Checkpoint) -> dict[str, DataFrame | None]:
    """Stage ``data`` with a default for each table that may be absent.

    ``train_source`` and ``train_target`` are the train matrix, which is made from the train rows where there is none; item parts
    put each item into train; absent holdouts have no rows; the matrices of the holdouts come from their lists; metadata and tags
    are None."""
    found: dict[str, DataFrame | None] = dict(at.tables("data"))
    for name in ("train", "items"):
        if name not in found:
            raise KeyError(f"stage data has no table {name}")
    for name in ("metadata", "tags"):
        found.setdefault(name, None)
    if "users" not in found:
        found["users"] = prepare.vocabulary(found["train"], "user_id", "user_idx")
    if "matrix" not in found:
        found["matrix"] = prepare.sparse_matrix(found["train"], found["users"], found["items"])
    found.setdefault("train_source", found["matrix"])
    found.setdefault("train_target", found["train_source"])
    found.setdefault("item_parts", found["items"].select("item_id", F.lit("train").alias("split")))
    for part in ("val", "test"):
        held = found.setdefault(part, at.spark.createDataFrame([], HOLDOUT))
        for side in ("source", "target"):
            found.setdefault(f"{part}_{side}", cells(held, side, found["items"]))
    return found


def save_clusters(target: Checkpoint, clusters: DataFrame, details: dict | None = None) -> None:
    """Clusters as nested rows: cluster_id, parent ids, entity indices and whatever else; counts go to the manifest."""
    n = clusters.count()
    active = clusters.filter("size(entity_indices) > 0").count() if "entity_indices" in clusters.columns else n
    target.put("clusters", {"graph": clusters}, (details or {}) | {"n_nodes": n, "n_active": active})
