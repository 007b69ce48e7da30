"""Checkpoints and whole jobs on a small folder."""

import random

import numpy as np
import pytest

from spindrift import __main__ as command_line
from spindrift.operators import text_vectors
from spindrift.plans import build as plans
from spindrift.sources import store


def numbers(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "x int")


def test_update_is_all_or_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    with pytest.raises(FileNotFoundError):
        store.read(spark, path)
    with store.update(spark, path) as c:
        c.put("data", {"a": numbers(spark, 1, 2)}, {"k": [1]})
        c.put("elsa", {"vectors": numbers(spark, 3)})
    at = store.read(spark, path)
    assert at.stages() == ["data", "elsa"] and at.details("data") == {"k": [1]} and at.table("data", "a").count() == 2
    with pytest.raises(RuntimeError), store.update(spark, path) as c:
        c.put("data", {"a": numbers(spark, 9)})
        raise RuntimeError
    assert sorted(r.x for r in store.read(spark, path).table("data", "a").collect()) == [1, 2]
    with store.update(spark, path) as c:
        c.put("text", {"vectors": numbers(spark, 4)})
    assert store.read(spark, path).stages() == ["data", "elsa", "text"]
    with store.update(spark, path) as c:
        c.put("data", {"a": numbers(spark)})
    at = store.read(spark, path)
    assert at.stages() == ["data"] and at.table("data", "a").count() == 0
    assert len([p for p in (tmp_path / "c").iterdir() if p.is_dir()]) == 1
    for missing in (lambda: at.table("elsa", "vectors"), lambda: at.table("data", "b")):
        with pytest.raises(KeyError):
            missing()


def folder(spark, path, n):
    with store.update(spark, path) as c:
        c.put("data", {"train": spark.createDataFrame([("u", "a", 1.0), ("u", "a", 1.0), ("v", "b", 1.0)], "user_id string, item_id string, value double"), "items": spark.createDataFrame([(0, "a"), (1, "b"), (2, "c")][:n], "item_idx long, item_id string")})


@pytest.mark.parametrize("renaming", [store.RENAMING, ()])
def test_two_open_updates(spark, tmp_path, monkeypatch, renaming):
    monkeypatch.setattr(store, "RENAMING", renaming)
    path = f"file://{tmp_path}/c"
    folder(spark, path, 3)
    with store.update(spark, path) as first:
        first.put("elsa", {"vectors": numbers(spark, 1)})
        with store.update(spark, path) as second:
            second.put("text", {"vectors": numbers(spark, 2)})
    at = store.read(spark, path)
    assert at.stages() == ["data", "elsa", "text"] and at.newest() == 3 and at.table("text", "vectors").first().x == 2
    with pytest.raises(store.ConcurrentUpdate), store.update(spark, path) as first:
        first.put("text", {"vectors": numbers(spark, 3)})
        folder(spark, path, 2)
    with pytest.raises(store.ConcurrentUpdate), store.update(spark, path, at) as late:
        late.put("elsa", {"vectors": numbers(spark, 4)})
    assert store.read(spark, path).stages() == ["data"] and len([p for p in (tmp_path / "c").iterdir() if p.is_dir()]) == 1


def test_a_number_is_given_once(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    folder(spark, path, 3)
    at = store.read(spark, path)
    assert not at._publish(1, {}) and at.manifest()["stages"].keys() == {"data"}
    assert not [p for p in (tmp_path / "c").iterdir() if "draft" in p.name]


def test_older_layout_and_defaults(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    folder(spark, path, 3)
    for p in (tmp_path / "c").glob(".manifest*.crc"):
        p.unlink()
    (tmp_path / "c" / "manifest-00000001.json").rename(tmp_path / "c" / store.FIRST)
    found = store.load_split(store.read(spark, path))
    assert sorted(map(tuple, found["matrix"].collect())) == [(0, 0, 2.0), (1, 1, 1.0)] == sorted(map(tuple, found["train_target"].collect()))
    assert {tuple(r) for r in found["item_parts"].collect()} == {(i, "train") for i in "abc"}
    assert found["metadata"] is None and found["tags"] is None and found["val"].count() == 0 == found["test_source"].count()
    with store.update(spark, path) as c:
        c.put("data", {"train": found["train"], "items": found["items"], "test": spark.createDataFrame([("w", ["a", "x"], ["c"])], store.HOLDOUT)})
    at = store.read(spark, path)
    found = store.load_split(at)
    assert at.newest() == 1 and [tuple(r) for r in found["test_source"].collect()] == [("w", 0, 1.0)] and [tuple(r) for r in found["test_target"].collect()] == [("w", 2, 1.0)]


def test_stored_metrics(spark, tmp_path, monkeypatch):
    path = f"file://{tmp_path}/c"
    vectors = lambda *v: spark.createDataFrame([(i, list(x)) for i, x in zip("abc", v, strict=True)], "item_id string, vector array<double>")
    test = spark.createDataFrame([("u", ["a"], ["b"])], store.HOLDOUT)
    model = spark.createDataFrame([("dec", 1, [0.0, 1.0]), ("dec", 0, [1.0, 0.0]), ("enc", 0, [9.0, 9.0])], "name string, row int, vec array<double>")
    with store.update(spark, path) as c:
        c.put("data", {"test": test})
        c.put("elsa", {"vectors": vectors((1.0, 0.0), (0.9, 0.1), (0.0, 1.0))})
        c.put("sae", {"vectors": vectors((1.0, 0.0), (0.0, 1.0), (1.0, 0.0)), "sparse": spark.createDataFrame([([0], [1.0])] * 3, "cols array<int>, vals array<double>"), "model": model})
    first = plans.evaluate(spark, path, ks=(1,)).collect()
    assert [(r.stage, r.form, r.base, r.recall_1, r.drop_recall_1, r.stored) for r in first] == [("elsa", "vectors", None, 1.0, None, False), ("sae", "vectors", "elsa", 0.0, 100.0, False), ("sae", "kernel", "elsa", 0.0, 100.0, False)]
    assert [(r.dense_mb, r.sparse_mb, r.kernel_mb) for r in first] == [(24 / 2**20, None, None), (24 / 2**20, 24 / 2**20, None), (24 / 2**20, 24 / 2**20, 16 / 2**20)]

    def never(*_):
        raise AssertionError("scored again")

    with monkeypatch.context() as m:
        m.setattr(plans, "_evaluate", never)
        again = plans.evaluate(spark, path, ks=(1,)).collect()
        assert [tuple(r)[:-1] for r in again] == [tuple(r)[:-1] for r in first] and all(r.stored for r in again)
        with pytest.raises(AssertionError):
            plans.evaluate(spark, path, ks=(2,))
    with store.update(spark, path) as c:
        c.put("data", {"test": spark.createDataFrame([("u", ["a"], ["c"])], store.HOLDOUT)})
        c.put("elsa", {"vectors": vectors((1.0, 0.0), (0.9, 0.1), (0.0, 1.0))})
    assert [(r.stage, r.recall_1, r.stored) for r in plans.evaluate(spark, path, ks=(1,)).collect()] == [("elsa", 0.0, False)]


def test_encoders_give_a_vector_for_each_item(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    with store.update(spark, path) as target:
        target.put("data", {"metadata": spark.createDataFrame([("a", "x"), ("b", "y")], "item_id string, entity_text string")})
    with pytest.raises(ValueError, match="1 vectors for 2 items"):
        plans.train_text(spark, path, lambda items, key, text: items.limit(1).selectExpr(key, "array(1D) as vector"))
    assert store.read(spark, path).stages() == ["data"]


def test_clusters(spark, tmp_path):
    rows = [("r", [], [0, 1]), ("s", ["r"], [])]
    with store.update(spark, f"file://{tmp_path}/c") as c:
        store.save_clusters(c, spark.createDataFrame(rows, "cluster_id string, parents array<string>, entity_indices array<long>"))
    at = store.read(spark, f"file://{tmp_path}/c")
    assert at.details("clusters") == {"n_nodes": 2, "n_active": 1}
    assert sorted(map(tuple, at.table("clusters", "graph").collect())) == rows


def test_options():
    o = plans.BuildOptions(dataset="goodbooks", text_fields="title, genres")
    assert (o.seed, o.val_users, o.test_users, o.text_fields) == (0, 1000, 2500, ("title", "genres"))
    for wrong in ({"dataset": "x"}, {"split_mode": "x"}, {"eval_fold": 2}):
        with pytest.raises(ValueError):
            plans.BuildOptions(**wrong)


@pytest.fixture(scope="module")
def ratings(spark):
    draw = random.Random(5)
    rows = [(f"u{u}", f"i{i}", float(draw.choice([3, 4, 5])), float(draw.randrange(1000))) for u in range(40) for i in draw.sample(range(25), 12)]
    return spark.createDataFrame(rows, "user_id string, item_id string, value double, timestamp double")


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(f"i{i}", f"Title {i}", "x y z" if i % 2 else None) for i in range(24)], "item_id string, title string, description string")


@pytest.mark.parametrize("mode", plans.SPLIT_MODES)
def test_build(spark, tmp_path, ratings, items, mode):
    o = plans.BuildOptions(split_mode=mode, val_users=5, test_users=8, user_min_support=3, val_items=3, test_items=4, min_target_items=1)
    at = plans.build(spark, f"file://{tmp_path}/{mode}", ratings, o, items)
    rows = at.table("data", "interactions").collect()
    assert rows and all(r.value == 1.0 and r.item_id != "i24" for r in rows)
    train = at.table("data", "train").collect()
    holdout = at.table("data", "test").collect()
    assert holdout and all(r.source and r.target for r in holdout)
    if mode == "user_split":
        names = {r.user_id.rpartition("#")[0] for r in holdout}
        assert len(names) <= 8 and len(holdout) == 5 * len(names) and not names & {r.user_id for r in train}
        assert all(not set(r.source) & set(r.target) and len(r.target) == -(-(len(r.source) + len(r.target)) // 5) for r in holdout)
    else:
        assert not {i for r in holdout for i in r.target} & {r.item_id for r in train}
    vocabulary = {r.item_id: r.item_idx for r in at.table("data", "items").collect()}
    assert [vocabulary[i] for i in sorted(vocabulary)] == list(range(len(vocabulary))) and set(vocabulary) == {r.item_id for r in rows}
    assert at.table("data", "matrix").count() == len({(r.user_id, r.item_id) for r in train})


def test_training_and_evaluation(spark, tmp_path, ratings, items):
    path = f"file://{tmp_path}/c"
    o = plans.BuildOptions(split_mode="leave_last_out", user_min_support=3)
    plans.build(spark, path, ratings, o, items)
    assert [h["epoch"] for h in plans.train_elsa(spark, path, dim=4, epochs=1, ks=(5,))] == [1]
    command_line.main(["train-text", path, "--dim", "16"], spark)
    command_line.main(["train-sae", path, "--stage", "text", "--hidden", "8", "--k", "2", "--epochs", "1"], spark)
    out = {r.stage: r for r in plans.evaluate(spark, path, ks=(5, 10)).collect()}
    assert set(out) == {"elsa", "text", "text_sae"}
    assert all(0 <= r.recall_5 <= r.recall_10 <= 1 for r in out.values())
    assert 0 <= store.read(spark, path).details("text_sae")["dead_features"] <= 8
    with pytest.raises(ValueError):
        plans.train_sae(spark, path, "other")


def test_empty_texts_are_refused(spark, tmp_path):
    path = f"file://{tmp_path}/c"
    with store.update(spark, path) as target:
        target.put("data", {"metadata": spark.createDataFrame([("a", " "), ("b", None)], "item_id string, entity_text string")}, {})
    with pytest.raises(ValueError, match="all texts are empty"):
        plans.train_text(spark, path)


def test_text_vectors(spark):
    df = spark.createDataFrame([("a", "one two"), ("b", None), ("c", "one")], "k string, t string")
    out = {r.item_id: np.array(r.vector) for r in text_vectors.hashed_tfidf(df, "k", "t", 32).collect()}
    assert np.linalg.norm(out["a"]) == pytest.approx(1) and not out["b"].any() and len(out) == 3
    own = {r.item_id: r.vector for r in text_vectors.encoded(df, "k", "t", lambda t: [[3.0, 4.0] if x else [0.0, 0.0] for x in t]).collect()}
    assert own == {"a": [0.6, 0.8], "b": [0.0, 0.0], "c": [0.6, 0.8]}
