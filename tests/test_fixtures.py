"""Small cases worked out by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from spindrift.functions import text as T
from spindrift.operators import prepare, retrieval, splits, tags

T_ROWS = [("u1", "a", 1), ("u1", "b", 2), ("u1", "c", 3), ("u2", "a", 2), ("u2", "d", 4), ("u3", "e", 5)]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame([(u, i, 1.0, float(t)) for u, i, t in T_ROWS], "user_id string, item_id string, value double, timestamp double")


def held(df):
    return {r.user_id: (r.source, r.target) for r in df.collect()}


def test_leave_last_out(rows):
    last = splits.leave_last_out(rows)
    assert held(last) == {"u1": (["a", "b"], ["c"]), "u2": (["a"], ["d"])}
    train = splits.train_rows(rows, last)
    assert sorted((r.user_id, r.item_id) for r in train.collect()) == [("u1", "a"), ("u1", "b"), ("u2", "a"), ("u3", "e")]


def test_temporal(rows):
    assert splits.temporal_cutoff(rows, 0.5).first().cutoff == 2.5
    later = splits.temporal_holdout(rows, 0.5)
    assert held(later) == {"u1": (["a", "b"], ["c"]), "u2": (["a"], ["d"])}
    assert {r.item_id for r in splits.train_rows(rows, later).collect()} == {"a", "b", "e"}


@pytest.mark.parametrize("share", [0.01, 0.1, 0.37, 0.5, 0.99])
def test_cutoff_equals_percentile(spark, share):
    df = spark.range(500).select(F.pmod(F.xxhash64("id"), F.lit(90)).cast("double").alias("timestamp")).unionByName(spark.sql("select cast(null as double) as timestamp"))
    expected = df.agg(F.percentile("timestamp", F.lit(1 - share)).alias("c")).first().c
    assert splits.temporal_cutoff(df, share).first().cutoff == pytest.approx(expected)
    assert [r.cutoff for r in splits.temporal_cutoff(df.limit(0), share).collect()] == [None]


def test_item_cold(spark, rows):
    parts = spark.createDataFrame([("a", "train"), ("b", "train"), ("c", "test"), ("d", "test")], "item_id string, split string")
    assert held(splits.item_cold_holdout(rows, parts)) == {"u1": (["a", "b"], ["c"]), "u2": (["a"], ["d"])}


def test_pruning_ends_at_nothing(spark):
    df = spark.createDataFrame([("u1", "a"), ("u1", "b"), ("u2", "a"), ("u2", "c"), ("u3", "b")], "user_id string, item_id string")
    assert prepare.kcore(df, 2, 2, 1).count() == 2 and prepare.kcore(df, 2, 2).count() == 0


def test_pruning_by_differences(spark):
    """A chain loses its two ends in each round, far from a core that stays."""
    chain = [(f"u{k}", f"i{k + d}") for k in range(6) for d in (0, 1)]
    core = [(f"w{a}", f"c{b}") for a in range(40) for b in range(3)] + [("w0", "c0")] * 2
    df = spark.createDataFrame([(u, i, n) for n, (u, i) in enumerate(chain + core)], "user_id string, item_id string, n int")
    rows = lambda x: sorted(tuple(r) for r in x.collect())
    for steps in (1, 0):
        assert rows(prepare.kcore(df, 2, 2, steps, recount=0)) == rows(prepare.kcore(df, 2, 2, steps))
    report = []
    assert rows(prepare.peeled(df, 2, 2, report=report)) == sorted((u, i, n) for n, (u, i) in enumerate(core, len(chain)))
    assert [went for _, _, went in report] == [2] * 6 and max(read for _, read, _ in report) < df.count()
    odd = df.unionByName(spark.createDataFrame([(None, "c0", -1), ("w0", None, -2), (None, None, -3)], df.schema))
    assert rows(prepare.kcore(odd, 2, 2, recount=0)) == rows(prepare.kcore(odd, 2, 2)) == rows(prepare.kcore(df, 2, 2))
    assert prepare.kcore(odd, 1, 1).count() == odd.count() and prepare.kcore(df.limit(0), 2, 2, recount=-1).count() == 0


def test_entity_text_of_any_depth(spark):
    kind = "title string, names array<string>, more map<string, array<string>>, score double"
    df = spark.createDataFrame([(" A ", ["x ", "", "y"], {"k": ["1", "2"], "e": []}, 1.5), (None, None, None, float("nan"))], kind)
    fields = ["title", "names", "absent", "more", "score"]
    assert [r.entity_text for r in T.add_entity_text(df, fields).collect()] == ["A\nx\ny\nk: 1\n2\n1.5", ""]


def test_top_k_and_metrics(spark):
    vectors = spark.createDataFrame([("0", [1.0, 0.0]), ("1", [0.0, 1.0]), ("2", [0.6, 0.8])], "item_id string, vector array<double>")
    holdout = spark.createDataFrame([("u", ["0"], ["1"]), ("v", ["0"], [])], "user_id string, source array<string>, target array<string>")
    for size in (1 << 27, 16):
        top = retrieval.top_k(holdout, vectors, 2, size)
        assert sorted((r.user_id, r["rank"], r.item_id) for r in top.collect()) == [("u", 1, "2"), ("u", 2, "1"), ("v", 1, "2"), ("v", 2, "1")]
    row = retrieval.metrics(top, holdout, (1, 2)).first()
    assert (row.recall_1, row.recall_2, row.n_users, row.n_eval_rows) == (0, 1, 1, 2) and row.ndcg_2 == pytest.approx(1 / np.log2(3))
    given = spark.createDataFrame([("u", 1, "3", 0.0), ("u", 2, "0", 0.0), ("u", 3, "2", 0.0)], "user_id string, rank long, item_id string, score double")
    truth = spark.createDataFrame([("u", ["9"], ["0", "5"])], "user_id string, source array<string>, target array<string>")
    row = retrieval.metrics(given, truth, (3,)).first()
    assert row.recall_3 == 0.5 and row.ndcg_3 == pytest.approx(0.386853, abs=1e-6)
    (row,) = retrieval.debug_rows(given, truth, 3).collect()
    assert (row.n_true, row.n_hits, row.first_hit_rank, row.hit_ranks) == (2, 1, 2, [2]) and row.ndcg == pytest.approx(0.386853, abs=1e-6)


def test_kernel_scores_equal_plain_formula(spark):
    rng = np.random.default_rng(5)
    z, w = rng.normal(size=(12, 6)) * (rng.random((12, 6)) < 0.5), rng.normal(size=(6, 4))
    codes = spark.createDataFrame([(f"{i:02d}", r.tolist()) for i, r in enumerate(z)], "item_id string, vector array<double>")
    holdout = spark.createDataFrame([("u", ["01", "05"], ["02"])], "user_id string, source array<string>, target array<string>")
    k = w @ w.T
    scaled = z / np.sqrt(np.maximum((z @ k * z).sum(1), 1e-12))[:, None]
    scores = np.maximum((scaled[1] + scaled[5]) @ k @ scaled.T, 0)
    for r in retrieval.kernel_top_k(holdout, codes, w, 10).collect():
        assert r.item_id not in ("01", "05") and r.score == pytest.approx(scores[int(r.item_id)], abs=1e-8)


def test_drops_and_sizes(spark):
    df = spark.createDataFrame([(0.5, 0.4), (0.0, 0.4)], "a double, b double")
    assert [round(r[0], 9) for r in df.select(retrieval.percent_drop(F.col("a"), F.col("b"))).collect()] == [20.0, 0.0]
    vectors = spark.createDataFrame([("a", [1.0, 2.0, 3.0])] * 4, "item_id string, vector array<double>")
    assert {r.form: r.n_bytes for r in retrieval.size_report(vectors, 2).collect()} == {"dense": 48, "sparse": 64}


def test_sparse_matrix_adds_cells(spark):
    df = spark.createDataFrame([("u1", "a", 1.0), ("u1", "a", 1.0)], "user_id string, item_id string, value double")
    users, items = prepare.vocabulary(df, "user_id", "user_idx"), prepare.vocabulary(df, "item_id", "item_idx")
    assert [tuple(r) for r in prepare.sparse_matrix(df, users, items).collect()] == [(0, 0, 2.0)]


def test_history_holdout(spark):
    train = spark.createDataFrame([("u1", "a"), ("u2", "b")], "user_id string, item_id string")
    rows = [(0, "u1", "c", "b  a x a"), (1, "u1", "d", None), (2, "u1", "a", "b"), (3, "u2", "c", " x "), (4, "u1", "d", "a")]
    out = splits.history_holdout(spark.createDataFrame(rows, "row_id int, user_id string, item_id string, history string"), train)
    assert sorted(map(tuple, out.collect())) == [(0, "u1", ["a", "b"], ["c"]), (4, "u1", ["a"], ["d"])]
    assert splits.history_holdout(spark.createDataFrame(rows, "row_id int, user_id string, item_id string, history string"), train, 2).count() == 1


def test_details(spark):
    given = ['{"Brand": "X", "Empty": " ", "N": 3}', "{}", "", None, "plain {", "[1, 2]"]
    out = spark.createDataFrame([(i, g) for i, g in enumerate(given)], "i int, d string").select("i", T.details_text(F.col("d")).alias("t")).orderBy("i").collect()
    assert [r.t for r in out] == ["Brand: X\nN: 3", "", "", "", "plain {", "[1, 2]"]


def test_top_k_in_blocks_equals_one_matrix(spark):
    """Items of very unequal length in eight blocks, users in several: the same ranks, and most users leave out most blocks."""
    rng = np.random.default_rng(3)
    e = rng.normal(size=(160, 4)) * 3.0 ** -np.arange(160)[:, None].clip(0, 40) ** 0.5
    items = [f"i{i:03}" for i in range(160)]
    users = [(f"u{u}", [items[j] for j in rng.choice(160, 3, replace=False)]) for u in range(40)] + [("nobody", ["unknown"])]
    holdout = spark.createDataFrame([(u, s, ["i000"]) for u, s in users], "user_id string, source array<string>, target array<string>")
    vectors = spark.createDataFrame([(i, v.tolist()) for i, v in zip(items, e, strict=True)] + [("none", None)], "item_id string, vector array<double>")
    found = {(r.user_id, r.rank): r.item_id for r in retrieval.top_k(holdout, vectors, 5, 20 * 4 * 8).collect()}
    expected = {}
    for u, source in users[:-1]:
        seen = [items.index(s) for s in source]
        score = np.round(np.maximum(e[seen].sum(0) @ e.T, 0), 9)
        score[seen] = -1
        expected |= {(u, n): items[j] for n, j in enumerate(np.argsort(-score, kind="stable")[:5], 1)}
    assert found == expected
    blocks = retrieval.item_blocks(vectors.filter("vector is not null"), 8).cache()
    longest = [r.m for r in blocks.groupBy("ib").agg(F.max("norm").alias("m")).orderBy("ib").collect()]
    assert len(longest) == 8 and longest == sorted(longest, reverse=True)
    profiles = retrieval.profiles(holdout, vectors.filter("vector is not null"))
    first = retrieval._meet(profiles.selectExpr("*", "0 ub", "0 ib"), blocks.filter("ib = 0").selectExpr("*", "0 ub"), 5)
    last = [r["last"] for r in retrieval.open_blocks(profiles, first, longest, 5).collect()]
    assert len(last) == 40 and sum(last) < 40 * 7 / 2 and min(last) == 0


def test_top_k_refuses_what_it_cannot_score(spark):
    holdout = spark.createDataFrame([("u", ["a"], ["b"])], "user_id string, source array<string>, target array<string>")
    for bad, what in (([("a", [1.0]), ("b", [1.0, 2.0])], "1 to 2 numbers"), ([("a", [1.0]), ("a", [2.0])], "twice"), ([("a", [None])], "nulls")):
        with pytest.raises(ValueError, match=what):
            retrieval.top_k(holdout, spark.createDataFrame(bad, "item_id string, vector array<double>"), 2)
    assert retrieval.top_k(holdout, spark.createDataFrame([("a", None)], "item_id string, vector array<double>"), 2).collect() == []


def test_top_k_with_ties_and_zeros_equals_one_matrix(spark):
    """Copies of items across blocks and Arrow batches, scores of zero, and users that have seen nearly everything."""
    rng = np.random.default_rng(4)
    e = np.concatenate([rng.integers(-1, 2, (150, 3)).astype(float)] * 2)
    items = [f"i{i:03}" for i in rng.permutation(300)]
    users = [(f"u{u:02}", sorted(rng.choice(items, n, replace=False).tolist())) for u, n in enumerate([1, 2, 3, 5, 297, 300] * 4)]
    holdout = spark.createDataFrame([(u, s, ["i000"]) for u, s in users], "user_id string, source array<string>, target array<string>")
    vectors = spark.createDataFrame(list(zip(items, e.tolist(), strict=True)), "item_id string, vector array<double>").repartition(5)
    expected, by_id = {}, np.argsort(items)
    for u, source in users:
        seen = [items.index(s) for s in source]
        score = np.round(np.maximum(e[seen].sum(0) @ e.T, 0), 9)
        score[seen] = -1
        best = [j for j in by_id[np.argsort(-score[by_id], kind="stable")][:7] if score[j] >= 0]
        expected |= {(u, n): (items[j], score[j]) for n, j in enumerate(best, 1)}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 16)
    try:
        for size in (1 << 25, 512):
            assert {(r.user_id, r["rank"]): (r.item_id, r.score) for r in retrieval.top_k(holdout, vectors, 7, size).collect()} == expected
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_top_k_deals_users_to_all_cores():
    """75,000 users of 16 numbers took one task, as their profiles have less than 32 MB."""
    assert retrieval.user_blocks(75_000, 16 * 8 + 20 * 24, 32 << 20, 12) == 24
    assert retrieval.user_blocks(10_000_000, 64 * 8 + 100 * 24, 32 << 20, 12) == 868 and retrieval.user_blocks(0, 8, 1, 12) == 1


def test_fold_holdout_shuffles_rows_once(spark):
    """All draws share one shuffle by user; each draw had its own copy of the rows shuffled."""
    df = spark.createDataFrame([(f"u{u}", f"i{i}") for u in range(9) for i in range(u)] * 2 + [("u1", None)], "user_id string, item_id string")
    out = splits.fold_holdout(df, df, 42, 3, 4, 0.3)
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    other = splits.fold_holdout(df, df.select("item_id"), 42, 3, 4, 0.3)
    assert sorted(map(tuple, out.collect())) == sorted(map(tuple, other.collect()))
    assert {(r.draw, r.user_id, r.n) for r in out.filter("is_target").groupBy("draw", "user_id").agg(F.count(F.lit(1)).alias("n")).collect()} == {(d, f"u{u}", -(-3 * u // 10)) for d in range(3) for u in range(4, 9)}


def test_kcore_sends_no_keys_through_the_driver(spark):
    """Keys with enough rows were broadcast, so that what reached the driver grew with the data."""
    df = spark.createDataFrame([(f"u{u}", f"i{i}") for u in range(6) for i in range(u)], "user_id string, item_id string")
    kept = prepare.with_support(prepare.with_support(df, "item_id", 2), "user_id", 2)
    assert kept.count() == 13 and "Broadcast" not in kept._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in prepare.peeled(df, 2, 2)._jdf.queryExecution().executedPlan().toString()
