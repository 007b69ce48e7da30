"""Readers on small files, annotations and a given split, through to the checkpoint."""

import gzip
import json

import pandas as pd
import pytest

from spindrift import __main__ as command_line
from spindrift.plans import build as plans
from spindrift.sources import datasets, store


def write(folder, **files):
    folder.mkdir(parents=True, exist_ok=True)
    for name, lines in files.items():
        (folder / name.replace("__", ".")).write_text("\n".join(lines) + "\n", encoding="latin-1")
    return str(folder)


@pytest.fixture(scope="module")
def ml1m(tmp_path_factory):
    root = tmp_path_factory.mktemp("ml1m")
    pd.DataFrame({"movieId": [2], "llama31_description": ["Words about it"]}).to_feather(root / "item_text_descriptions.feather")
    return write(root, ratings__dat=["1::2::5::30", "1::3::x::31", "2::2::4::"], movies__dat=["2::Café (1999)::Drama|Comedy", "3::B::(no genres listed)"])


@pytest.fixture(scope="module")
def goodbooks(tmp_path_factory):
    return write(
        tmp_path_factory.mktemp("goodbooks"),
        ratings__csv=["user_id,book_id,rating", "1,7,5", "1,8,4", "2,7,5"],
        books__csv=["book_id,goodreads_book_id,title,authors,average_rating", '7,70,"A ""B"", C",X,4.1', "8,80,D,Y,3"],
        book_tags__csv=["goodreads_book_id,tag_id,count", "70,1,60", "80,1,50", "70,2,30", "90,2,80", "70,3,-1", "80,4,5", "70,5,100"],
        tags__csv=["tag_id,tag_name", "1, Fantasy", "2,fantasy", "3,sad", "4,rare", "5, "],
    )


def test_ml1m(spark, ml1m):
    rows, items = datasets.read_ml1m(spark, ml1m)
    assert sorted(map(tuple, rows.collect()), key=str) == [("1", "2", 5.0, 30.0), ("2", "2", 4.0, None)]
    assert sorted(tuple(r.asDict()[c] for c in ("item_id", "title", "genres", "description")) for r in items.collect()) == [("2", "Café (1999)", "Drama|Comedy", "Words about it"), ("3", "B", "(no genres listed)", None)]


def test_ml20m_and_its_tags(spark, tmp_path):
    tags = ["userId,movieId,tag,timestamp"] + [f"{u},1, Noir ,0" for u in range(3)] + ["9,2,NOIR,0", "9,2,once,0", "9,3,noir,0", "9,1,,0"]
    root = write(tmp_path / "m", ratings__csv=["userId,movieId,rating,timestamp", "1,1,4.5,7", "2,2,4,8"], movies__csv=["movieId,title,genres", '1,"X, The (2000)",Drama', "2,Y,Drama"], tags__csv=tags)
    rows, items = datasets.read_ml20m(spark, root)
    assert rows.count() == 2 and {r.title for r in items.collect()} == {"X, The (2000)", "Y"}
    o = plans.BuildOptions(split_mode="item_split", val_items=0, test_items=1, user_min_support=1, annotation_source="ml20m_tags", annotation_min_count=5)
    at = plans.build(spark, f"file://{tmp_path}/c", rows, o, items, annotation_root=root)
    assert sorted((r.item_id, r.tag, r.tag_idx, r.weight) for r in at.table("data", "tags").collect()) == [("1", "noir", 0, 3), ("2", "noir", 0, 1)]


def test_goodbooks_tags_are_summed_by_name(spark, goodbooks):
    rows, items = datasets.read_goodbooks(spark, goodbooks)
    assert rows.count() == 3 and {r.title for r in items.collect()} == {'A "B", C', "D"}
    vocabulary = spark.createDataFrame([("7", 0), ("8", 1)], "item_id string, item_idx long")
    o = plans.BuildOptions(dataset="goodbooks", annotation_source="goodbooks_tags", annotation_min_count=100)
    found = plans.annotate(spark, o, vocabulary, items, goodbooks)
    assert sorted(map(tuple, found.collect())) == [("7", "fantasy", 0, 90.0), ("8", "fantasy", 0, 50.0)]
    assert plans.annotate(spark, plans.BuildOptions(dataset="goodbooks", annotation_source="goodbooks_tags", annotation_min_count=500), vocabulary, items, goodbooks) is None


def test_annotation_options(spark):
    for wrong in ({"annotation_source": "x"}, {"annotation_source": "goodbooks_tags"}, {"annotation_min_count": 0}):
        with pytest.raises(ValueError):
            plans.BuildOptions(**wrong)
    none = spark.createDataFrame([("1", 0)], "item_id string, item_idx long")
    assert plans.annotate(spark, plans.BuildOptions(), none, None, None) is None
    with pytest.raises(ValueError):
        plans.annotate(spark, plans.BuildOptions(annotation_source="ml20m_tags"), none, None, None)


ITEMS = [
    {"parent_asin": "A", "title": "Robot", "features": ["one two", " "], "categories": ["Toys", "STEM"], "details": '{"Brand": "X"}', "images": [{"hi_res": None, "large": "l1", "thumb": "t1"}, {"hi_res": "h2", "large": "l2", "thumb": "t1"}]},
    {"parent_asin": "B", "title": "Tiny", "features": [], "categories": ["Toys"], "details": "{}", "images": []},
    {"parent_asin": "A", "title": "Second row of A", "features": [], "categories": [], "details": "", "images": []},
    {"parent_asin": "C", "title": "Some puzzle with five words", "features": None, "categories": None, "details": None, "images": None},
]


@pytest.fixture(scope="module")
def amazon(tmp_path_factory):
    root = tmp_path_factory.mktemp("amazon")
    (root / "mcauley").mkdir()

    def put(name, lines):
        with gzip.open(root / "mcauley" / name, "wt") as f:
            f.write("\n".join(lines) + "\n")

    put("meta_Toys_and_Games.jsonl.gz", [json.dumps(i) for i in ITEMS])
    head = "user_id,parent_asin,rating,timestamp"
    put("Toys_and_Games.csv.gz", [head, "u,A,5.0,1", "u,C,4,2", "v,A,5,3", "v,gone,5,4", "w,C,bad,5", "v,C,5,6"])
    put("Toys_and_Games.train.csv.gz", [head + ",history", "u,A,5,1,", "x,A,5,2,"])
    put("Toys_and_Games.valid.csv.gz", [head + ",history", "u,C,5,3,A A gone", "u,C,5,4,A", "x,A,5,4,A", "y,C,2,4,A", "z,C,5,4,"])
    put("Toys_and_Games.test.csv.gz", [head + ",history", "v,C,5,6,gone A"])
    return str(root)


def test_categories():
    assert [datasets.category(c) for c in ("toys", " Electronics", "Books")] == ["Toys_and_Games", "Electronics", "Books"]
    with pytest.raises(ValueError):
        datasets.category(" ")
    with pytest.raises(ValueError):
        datasets.amazon_sources("r", "toys", "other")


def test_amazon_metadata(spark, amazon):
    rows, items = datasets.read_amazon_category(spark, amazon, "toys", images=True)
    assert rows.count() == 5  # not the one without a number
    out = {r.item_id: r for r in items.collect()}
    assert {i: r.title for i, r in out.items()} == {"A": "Robot", "B": "Tiny", "C": "Some puzzle with five words"}
    assert (out["A"].image_url, out["A"].image_urls) == ("l1", "l1 t1 h2 l2") and out["B"].image_url == out["C"].image_urls == ""
    with pytest.raises(FileNotFoundError):
        datasets.read_amazon_category(spark, amazon, "beauty")


def test_unreadable_release_gives_way(spark, amazon, tmp_path):
    poor = write(tmp_path / "poor", ratings__csv=["user_id,rating", "u,1"])
    good = datasets.amazon_sources(amazon, "toys")[1]
    rows, _ = datasets.read_amazon(spark, [f"{poor}/ratings.csv", good[0]], good[1])
    assert rows.count() == 5


@pytest.mark.parametrize("form", ["text", "lists"])
def test_image_forms(spark, tmp_path, form):
    given = {"text": ("string", '[{"large": "l"}]'), "lists": ("struct<large: array<string>, thumb: array<string>>", (["l"], [None]))}[form]
    spark.createDataFrame([("A", given[1])], f"parent_asin string, images {given[0]}").write.parquet(f"{tmp_path}/meta")
    (row,) = datasets._amazon_items(spark, f"{tmp_path}/meta", True, ()).collect()
    assert row.image_urls == "l"


def test_amazon_given_split(spark, amazon, tmp_path):
    path = f"file://{tmp_path}/c"
    command_line.main(["build", path, "--dataset", "amazon2023", "--data", amazon, "--category", "toys", "--split_mode", "temporal", "--user_min_support", "1", "--item_min_support", "1", "--min_text_words", "5", "--text_fields", "title,features,categories,details"], spark)
    at = store.read(spark, path)
    assert {r.item_id for r in at.table("data", "items").collect()} == {"A", "C"}
    (text,) = (r.entity_text for r in at.table("data", "metadata").collect() if r.item_id == "A")
    assert text == "Title: Robot\n\nFeatures: one two\n\nCategories: Toys > STEM\n\nDetails: Brand: X"
    assert {r.user_id for r in at.table("data", "users").collect()} == {"u", "x"} and at.table("data", "matrix").count() == 2
    held = {p: sorted((r.user_id.partition("#")[0], r.source, r.target) for r in at.table("data", p).collect()) for p in ("val", "test")}
    assert held == {"val": [("u", ["A"], ["C"])] * 2, "test": [("v", ["A"], ["C"])]}
    assert at.table("data", "val").select("user_id").distinct().count() == 2 and at.details("data")["given_split"]
    with pytest.raises(SystemExit):
        command_line.main(["build", path, "--dataset", "amazon2023", "--data", amazon], spark)
