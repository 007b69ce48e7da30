"""Whole jobs: build a checkpoint from interactions, train on it, evaluate it."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import asdict, dataclass, field, fields

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import models, prepare, retrieval, splits, tags, text_vectors
from ..sources import datasets
from ..sources.datasets import SPECS
from ..sources.store import Checkpoint, read, update

SPLIT_MODES = ("user_split", "item_split", "leave_last_out", "temporal")
ANNOTATIONS = ("genres", "ml20m_tags", "goodbooks_tags", "none")


@dataclass(frozen=True)
class BuildOptions:
    """Settings of a build; those left None come from the data set's defaults."""

    dataset: str = "ml20m"
    split_mode: str = "user_split"
    seed: int | None = None
    val_users: int | None = None
    test_users: int | None = None
    user_min_support: int | None = None
    item_min_support: int | None = None
    min_value: float | None = None
    set_values_to: float | None = None
    eval_fold: int = 0
    val_items: int | None = None
    test_items: int | None = None
    item_val_frac: float = 0.05
    item_test_frac: float = 0.10
    temporal_test_frac: float = 0.10
    min_source_items: int = 1
    min_target_items: int = 1
    text_fields: Sequence[str] = field(default=("title", "features", "description", "categories"))
    min_text_words: int = 0
    labelled_text: bool = False
    annotation_source: str = "genres"
    annotation_min_count: int = 100

    def __post_init__(self):
        if self.dataset not in SPECS:
            raise ValueError(f"dataset is one of {sorted(SPECS)}")
        if self.split_mode not in SPLIT_MODES:
            raise ValueError(f"split_mode is one of {SPLIT_MODES}")
        if self.eval_fold not in (0, 1):
            raise ValueError("eval_fold is 0 (five draws) or 1 (one draw)")
        if self.annotation_source not in ANNOTATIONS:
            raise ValueError(f"annotation_source is one of {ANNOTATIONS}")
        if self.annotation_source == "goodbooks_tags" and self.dataset != "goodbooks":
            raise ValueError("goodbooks_tags belong to the data set goodbooks")
        if self.annotation_min_count < 1:
            raise ValueError("annotation_min_count is 1 or more")
        spec = SPECS[self.dataset]
        for f in ("seed", "val_users", "test_users", "user_min_support", "item_min_support", "min_value", "set_values_to"):
            if getattr(self, f) is None:
                object.__setattr__(self, f, getattr(spec, f))
        if isinstance(self.text_fields, str):
            object.__setattr__(self, "text_fields", tuple(x.strip() for x in self.text_fields.split(",") if x.strip()))


def _user_split(rows: DataFrame, o: BuildOptions) -> dict[str, DataFrame]:
    users = splits.three_way(rows.select("user_id").distinct(), "user_id", o.val_users, o.test_users, o.seed)
    dealt = rows.join(users, "user_id")
    train = dealt.filter("split = 'train'").drop("split")
    out = {"train": train}
    for part in ("val", "test"):
        own = splits.fold_holdout(dealt.filter(F.col("split") == part), train, o.seed, 1 if o.eval_fold else 5, o.user_min_support)
        # A row of the holdout is a user in one draw; its name says so.
        row = own.withColumn("user_id", F.concat_ws("#", "user_id", "draw"))
        pick = lambda c: F.sort_array(F.collect_list(F.when(c, F.col("item_id"))))
        out[part] = row.groupBy("user_id").agg(pick(~F.col("is_target")).alias("source"), pick(F.col("is_target")).alias("target"))
    return out


def _item_split(rows: DataFrame, o: BuildOptions) -> dict[str, DataFrame]:
    items = rows.select("item_id").distinct()
    n = items.count()
    n_val, n_test = (given if given is not None else -int(-n * frac // 1) for given, frac in ((o.val_items, o.item_val_frac), (o.test_items, o.item_test_frac)))
    parts = splits.three_way(items, "item_id", n_val, n_test, o.seed)
    train = rows.join(parts.filter("split = 'train'"), "item_id", "left_semi").select(rows.columns)
    return {"train": train, "item_parts": parts} | {p: splits.item_cold_holdout(rows, parts, p, o.min_source_items, o.min_target_items) for p in ("val", "test")}


def _last_out(rows: DataFrame, o: BuildOptions) -> dict[str, DataFrame]:
    held = splits.leave_last_out(rows, o.min_source_items, o.min_target_items)
    return {"train": splits.train_rows(rows, held), "val": held, "test": held}


def _temporal(rows: DataFrame, o: BuildOptions) -> dict[str, DataFrame]:
    held = splits.temporal_holdout(rows, o.temporal_test_frac, o.min_source_items, o.min_target_items)
    return {"train": splits.train_rows(rows, held), "val": held, "test": held}


def _given_history(rows: DataFrame, history: dict[str, DataFrame], o: BuildOptions) -> dict[str, DataFrame]:
    """A split that comes with the data: parts train, valid and test, whose rows hold their own past."""
    own = {p: prepare.threshold_binarize(prepare.restrict(part, rows), o.min_value, o.set_values_to) for p, part in history.items()}
    # A user may own several rows of a holdout, each with its own past.
    name = F.concat_ws("#", "user_id", "row_id").alias("user_id")
    held = {p: splits.history_holdout(own[q], own["train"], o.min_source_items).select(name, "source", "target") for p, q in (("val", "valid"), ("test", "test"))}
    return {"train": own["train"].select("user_id", "item_id", "value", "timestamp")} | held


def annotate(spark: SparkSession, o: BuildOptions, vocabulary: DataFrame, items: DataFrame | None, root: str | None) -> DataFrame | None:
    """(item_id, tag, tag_idx, weight) of the vocabulary's items by ``annotation_source``, or None where it has none.

    Genres come from the items' column and are numbered as first met; tags are read below root and numbered by name."""
    if o.annotation_source == "none" or (o.annotation_source == "genres" and (items is None or "genres" not in items.columns)):
        return None
    if o.annotation_source == "genres":
        found = tags.genre_tags(vocabulary.join(items.select("item_id", "genres"), "item_id"), "genres", "item_idx")
        return None if found.isEmpty() else found
    if root is None:
        raise ValueError(f"{o.annotation_source} need the folder of their files")
    if o.annotation_source == "ml20m_tags":
        found = tags.user_tags(datasets.read_ml20m_tags(spark, root), vocabulary, o.annotation_min_count)
    else:
        rows, names, books = datasets.read_goodbooks_tags(spark, root)
        own = tags.weighted_tags(rows, names, o.annotation_min_count).withColumnRenamed("item_id", "own_id")
        found = prepare.restrict(own.join(books, "own_id").groupBy("item_id", "tag").agg(F.sum("weight").alias("weight")), vocabulary)
    if found.isEmpty():
        return None
    return found.join(prepare.vocabulary(found, "tag", "tag_idx"), "tag").select("item_id", "tag", "tag_idx", "weight")


_ASSEMBLERS = dict(zip(SPLIT_MODES, (_user_split, _item_split, _last_out, _temporal), strict=True))


def prepare_interactions(rows: DataFrame, o: BuildOptions, items: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Restricted to items whose text is long enough, thresholded and pruned; and the items with their entity_text."""
    if items is not None:
        given = [f for f in o.text_fields if f in items.columns]
        if given:
            items = T.add_entity_text(items, given, o.min_text_words, labelled=o.labelled_text)
        items = prepare.keep_first(items, "item_id", *(["entity_text"] if given else ["item_id"]))
        rows = prepare.restrict(rows, items)
    rows = prepare.threshold_binarize(rows, o.min_value, o.set_values_to)
    return prepare.kcore(rows, o.user_min_support, o.item_min_support), items


def build(
    spark: SparkSession,
    path: str,
    interactions: DataFrame,
    o: BuildOptions,
    items: DataFrame | None = None,
    item_tags: DataFrame | None = None,
    history: dict[str, DataFrame] | None = None,
    annotation_root: str | None = None,
) -> Checkpoint:
    """Stage ``data``: interactions, vocabularies, train rows, holdouts, items and tags.

    A temporal split takes the parts of ``history`` where they are given.  Tags are ``item_tags``, or those of the options'
    annotation source."""
    rows, items = prepare_interactions(interactions, o, items)
    if rows.isEmpty():
        raise ValueError("no interactions are left")
    vocabulary = prepare.vocabulary(rows, "item_id", "item_idx")
    given = history if o.split_mode == "temporal" else None
    tables = _given_history(rows, given, o) if given else _ASSEMBLERS[o.split_mode](rows, o)
    # The users of a given split are those of its train rows, which needn't be among the pruned ones.
    tables |= {"interactions": rows, "items": vocabulary, "users": prepare.vocabulary(tables["train"] if given else rows, "user_id", "user_idx")}
    tables["matrix"] = prepare.sparse_matrix(tables["train"], tables["users"], vocabulary)
    if items is not None:
        tables["metadata"] = vocabulary.join(items, "item_id", "left")
    if item_tags is None:
        item_tags = annotate(spark, o, vocabulary, items, annotation_root)
    if item_tags is not None:
        tables["tags"] = item_tags.join(vocabulary, "item_id")
    details = asdict(o) | {"text_fields": list(o.text_fields), "given_split": bool(given), "annotated": item_tags is not None}
    with update(spark, path) as target:
        target.put("data", tables, details)
    return read(spark, path)


def _evaluate(holdout: DataFrame, vectors: DataFrame, ks: tuple[int, ...]) -> dict:
    return retrieval.metrics(retrieval.top_k(holdout, vectors, max(ks)), holdout, ks).first().asDict()


def train_elsa(spark: SparkSession, path: str, k_target: int | None = None, validate: bool = True, ks: tuple[int, ...] = (20, 50, 100), **settings) -> list[dict]:
    """Stage ``elsa``, or ``compressed_elsa`` with k_target: item vectors, and the history with validation metrics."""
    at = read(spark, path)
    val = at.table("data", "val")
    callback = (lambda epoch, vectors: _evaluate(val, vectors, ks)) if validate else None
    if k_target:
        how = models.Optimizer(**({"lr": 0.01} | {f.name: settings[f.name] for f in fields(models.Optimizer) if f.name in settings}))
        rest = {name: v for name, v in settings.items() if name not in asdict(how)}
        vectors, history = models.fit_compressed_elsa(at.table("data", "train"), k_target=k_target, how=how, callback=callback, **rest)
    else:
        vectors, history = models.fit_elsa(at.table("data", "train"), callback=callback, **settings)
    with update(spark, path, at) as target:
        tables = {"vectors": vectors} | ({"sparse": retrieval.sparsify(vectors, k_target)} if k_target else {})
        target.put("compressed_elsa" if k_target else "elsa", tables, {"history": history, "settings": settings, "k_target": k_target})
    return history


def train_text(spark: SparkSession, path: str, encode=text_vectors.hashed_tfidf, **settings) -> None:
    """Stage ``text``: vectors of the items' entity_text by ``encode(items, id column, text column, **settings)``."""
    at = read(spark, path)
    items = at.table("data", "metadata")
    if "entity_text" not in items.columns:
        raise ValueError("the items have no entity_text")
    if items.filter(F.trim("entity_text") != "").isEmpty():
        raise ValueError("all texts are empty")
    with update(spark, path, at) as target:
        target.put("text", {"vectors": encode(items, "item_id", "entity_text", **settings)}, {"settings": settings})
        made, asked = target.staged("text", "vectors").count(), items.count()
        if made != asked:
            raise ValueError(f"the encoder gave {made} vectors for {asked} items")


def train_sae(spark: SparkSession, path: str, stage: str = "elsa", k: int = 128, hidden: int = 4096, score: str = "abs", norm_p: float | None = None, validate: bool = True, ks: tuple[int, ...] = (20, 50, 100), **settings) -> list[dict]:
    """Stage ``sae`` from elsa, ``text_sae`` from text: fitted on train items, codes of all, which each epoch validates."""
    name = {"elsa": "sae", "text": "text_sae"}.get(stage)
    if name is None:
        raise ValueError("stage is elsa or text")
    at = read(spark, path)
    vectors = at.table(stage, "vectors")
    known = prepare.restrict(vectors, at.table("data", "train"))
    val, coded = at.table("data", "val"), lambda w: models.sae_codes(vectors, w, k, score, norm_p)
    callback = (lambda epoch, w: _evaluate(val, retrieval.unit(coded(w), "vector"), ks)) if validate else None
    w, history = models.fit_sae(known, hidden=hidden, k=k, score=score, norm_p=norm_p, callback=callback, **settings)
    codes = coded(w)
    parameters = spark.createDataFrame([(p, i, row.tolist()) for p, m in w.items() for i, row in enumerate(m)], "name string, row int, vec array<double>")
    dead = models.dead_features(codes, hidden).count()
    with update(spark, path, at) as target:
        target.put(name, {"vectors": codes, "sparse": retrieval.sparsify(codes, k), "model": parameters}, {"history": history, "settings": settings | {"k": k, "hidden": hidden, "score": score, "norm_p": norm_p}, "dead_features": dead})
    return history


def _decoder(at: Checkpoint, stage: str) -> np.ndarray | None:
    """An autoencoder's decoder, hidden x dim numbers as in training, or None where the stage has no model."""
    if "model" not in at.manifest()["stages"][stage]["tables"]:
        return None
    return np.array([r.vec for r in at.table(stage, "model").filter("name = 'dec'").orderBy("row").select("vec").collect()])


def _measure(at: Checkpoint, stage: str, form: str, ks: tuple[int, ...]) -> dict | None:
    """Metrics over the test holdout and sizes in MB, of a stage's vectors or of its codes under the decoder's kernel."""
    vectors = at.table(stage, "vectors").select("item_id", "vector")
    decoder = _decoder(at, stage) if form == "kernel" else None
    if form == "kernel" and decoder is None:
        return None
    scored = vectors if decoder is None else retrieval.decoded(vectors, decoder)
    out = _evaluate(at.table("data", "test"), retrieval.unit(scored, "vector"), ks)
    dense = retrieval.size_report(vectors, 1).filter("form = 'dense'").first()
    sizes = {"dense_mb": dense.mb if dense else 0.0}
    if "sparse" in at.manifest()["stages"][stage]["tables"]:
        sizes["sparse_mb"] = (at.table(stage, "sparse").agg(F.sum(F.size("cols"))).first()[0] or 0) * 8 / (1 << 20)
    if decoder is not None:
        sizes["kernel_mb"] = len(decoder) ** 2 * 4 / (1 << 20)
    return out | sizes


def _measured(spark: SparkSession, path: str, stage: str, form: str, ks: tuple[int, ...]) -> tuple[dict | None, bool]:
    """What is kept in the checkpoint for these vectors, this holdout and these k, else measured and kept; and whether it was."""
    at = read(spark, path)
    of = " ".join([form, at.version(stage, "vectors"), at.version("data", "test"), *map(str, ks)])
    kept = at.metrics(stage, of)
    if kept is not None:
        return kept, True
    found = _measure(at, stage, form, ks)
    if found is not None:
        with update(spark, path) as target:
            target.note(stage, of, found)
    return found, False


#: The stage with which another is compared.
BASES = {"compressed_elsa": "elsa", "sae": "elsa", "text_sae": "text"}


def evaluate(spark: SparkSession, path: str, stages: Sequence[str] | None = None, ks: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """A report over the test holdout: (stage, form, base, recall and ndcg at each k, n_users, n_eval_rows, the drops of each metric
    against the base in per cent, dense_mb, sparse_mb, kernel_mb, stored).

    The form is vectors, and kernel too for the codes of an autoencoder.  Metrics are kept in the checkpoint and serve again as long
    as neither the vectors nor the holdout have been written anew; ``stored`` says so.  A stage without its base has null drops."""
    at = read(spark, path)
    having = [s for s in at.stages() if "vectors" in at.manifest()["stages"][s]["tables"]]
    found = [s for s in (stages or having) if s in having]
    if not found:
        raise ValueError("no stage with vectors")
    names = [f"{m}_{k}" for m in ("recall", "ndcg") for k in ks]
    sizes = ("dense_mb", "sparse_mb", "kernel_mb")
    rows = []
    for s in found:
        base = BASES.get(s) if BASES.get(s) in having else None
        against = _measured(spark, path, base, "vectors", ks)[0] if base else None
        for form in ("vectors", "kernel") if s in ("sae", "text_sae") else ("vectors",):
            own, stored = _measured(spark, path, s, form, ks)
            if own is not None:
                drops = [None if against is None else 0.0 if against[n] == 0 else (against[n] - own[n]) / against[n] * 100 for n in names]
                rows.append((s, form, base, *[own[n] for n in names], own["n_users"], own["n_eval_rows"], *drops, *[own.get(n) for n in sizes], stored))
    kind = ["stage string", "form string", "base string", *[f"{n} double" for n in names], "n_users long", "n_eval_rows long"]
    kind += [f"drop_{n} double" for n in names] + [f"{n} double" for n in sizes] + ["stored boolean"]
    return spark.createDataFrame(rows, ", ".join(kind))
