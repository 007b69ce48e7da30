"""The corpus pipeline, stage by stage, against plain versions."""

import corpus_pipeline as P
import public_tokenizers
from tokenizers import Tokenizer

from .brute import jaccard_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    seen = []
    for name, stage in P.STAGES[:-1]:
        before = {r.doc_id: r for r in docs.collect()}
        docs = stage(spark, docs, SF).cache()
        after = {r.doc_id: r for r in docs.collect()}
        assert docs.columns == list(P.COLUMNS) and set(after) <= set(before), name
        seen.append((name, before, after))
    _, before, after = seen[1]
    groups = jaccard_components([(k, r.text) for k, r in before.items()], 5, 80)
    assert set(after) == {k for k, (_, g) in groups.items() if g == k}
    assert set(seen[2][1]) == set(seen[2][2])
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    out = {r.doc_id: r.ids for r in P.run(spark, SF).collect()}
    assert out == {k: library.encode(r.text or "", add_special_tokens=False).ids for k, r in seen[3][2].items()}


def test_stages_on_odd_rows(spark, texts):
    """Nulls, empty and repeated rows, ties and extra columns pass each stage; an empty table stays empty."""
    rows = [(r.doc_id, r.text, None, None, None, "x", 1.0) for r in texts.collect()]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, removed string, score double")
    kept = {}
    for name, stage in P.STAGES:
        out = stage(spark, docs, SF)
        assert name == "bpe_encoding" or out.columns == list(P.COLUMNS)
        kept[name] = sorted(r.doc_id or 0 for r in out.collect())
        assert stage(spark, docs.limit(0), SF).collect() == [], name
    ids = sorted(k or 0 for k, *_ in rows)
    assert kept["toxicity"] == kept["substring_dedup"] == kept["benchmark_decontamination"] == kept["bpe_encoding"] == ids
    assert kept["ngram_jaccard_join"] == [k for k in ids if k != 5]


def test_near_duplicates_go_by_text(spark):
    """A row that repeats nothing stays, though another row of its key goes."""
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    rows = [(1, one), (2, one), (2, two), (3, None), (3, "")]
    docs = spark.createDataFrame([(k, t, None, None, None) for k, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = P.drop_near_duplicates(spark, docs, SF).collect()
    assert sorted((r.doc_id, r.text or "") for r in out) == [(1, one), (2, two), (3, ""), (3, "")]
