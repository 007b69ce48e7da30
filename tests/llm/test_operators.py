"""Small cases for every operator: results by brute force, and odd rows."""

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import bpe_codec, chat, common, decontaminate, ngram_join, packed, sharding, substring_dedup, suffix_tree, tiff, token_counts, toxicity
from spindrift.llm import queries as Q

from ..oracle import compare
from .brute import jaccard_components, suffix_tree_scores

SF = "/root/testdata/sf0.001"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def documents(spark):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


# ---- 1 and 3 ------------------------------------------------------------------------------------------------------


def test_suffix_tree_equals_brute_force(spark):
    found = {r.doc_id: r for r in Q.op1_suffix_tree(spark, SF).collect()}
    expected = suffix_tree_scores(documents(spark))
    assert set(found) == set(expected)
    for k, (held, n, known, total, base, score) in expected.items():
        r = found[k]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert r.base_score == pytest.approx(base) and r.score == pytest.approx(score)


def test_suffix_tree_in_small_blocks(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    whole, small = ({r.doc_id: r.score for r in suffix_tree.score_texts(docs, "doc_id", "text", F.lit(True), depth=3, **kw).collect()} for kw in ({}, {"block_bytes": 5000}))
    assert small == pytest.approx(whole)


def test_suffix_tree_grows_until_no_context_is_kept(spark):
    """Three words tell which word follows, two don't (no context of two words is kept); more than three say nothing new."""
    rows = [(i, f"{a} b c {x}") for i, (a, x) in enumerate([("a", "d"), ("e", "f")] * 20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    score = lambda depth: {r.doc_id: r.score for r in suffix_tree.score_texts(docs, "doc_id", "text", F.lit(True), depth=depth).collect()}
    two, three, open_ = score(2), score(3), score(None)
    assert open_ == pytest.approx(three) and all(three[k] > two[k] + 0.25 for k in two)
    # The last word after three: (20 + b p) / (20 + b), where shorter contexts say p, about one half.
    assert three[0] - two[0] == pytest.approx(np.log10((20 + 0.5 * 0.5) / 20.5) - np.log10(0.5), abs=0.02)


def test_suffix_tree_odd_rows(spark, texts, no_texts):
    out = suffix_tree.score_texts(texts, "doc_id", "text", F.col("doc_id") != 7).collect()
    assert len(out) == 9 and all(r.score <= 0 for r in out)
    assert {r.n_tokens for r in out if r.doc_id in (2, 3, 6)} == {1}
    assert suffix_tree.score_texts(no_texts, "doc_id", "text", F.lit(True)).collect() == []


def test_suffix_tree_rounds_share_the_evidence(spark, monkeypatch):
    """No round says evidence on two levels while it asks for two more; the last says all that is left."""
    rounds, say = [], suffix_tree._say
    monkeypatch.setattr(suffix_tree, "_say", lambda steps, ask, *rest: rounds.append((list(steps), list(ask))) or say(steps, ask, *rest))
    docs = spark.createDataFrame([(i, "a b c d e f g") for i in range(3)], "doc_id long, text string")
    expected = {1: [([1], [])], 2: [([1], [3]), ([2], [])], 4: [([1], [3, 4]), ([2], [5]), ([3, 4], [])], 5: [([1], [3, 4]), ([2], [5, 6]), ([3, 4, 5], [])], 7: [([1], [3, 4]), ([2], [5, 6]), ([3, 4], [7, 8]), ([5, 6, 7], [])]}
    for depth, wanted in expected.items():
        rounds.clear()
        assert suffix_tree.score_texts(docs, "doc_id", "text", F.lit(True), depth=depth).count() == 3
        assert rounds == wanted


def test_packed_words_frequent_first(spark):
    """A block's frequent words have small numbers, so that tokens take little more than their entropy; the words are the same."""
    words = np.random.default_rng(1).zipf(1.3, 200_000) % 50_000
    text = " ".join(f"w{x}" for x in words)
    rows = spark.createDataFrame([(1, 0, text), (2, 0, ""), (3, 0, "W5 w7")], "_key long, _extra long, _text string").coalesce(1)
    (row,) = packed.packed_texts(rows, common.Scratch(spark, "test")).collect()
    block = packed.Block({**row.asDict(), **{k: bytes(row[k]) for k in ("extra", "sizes", "vocabulary", "tokens")}})
    assert block.sizes.tolist() == [200_000, 0, 2]
    hashes, _ = common.word_hashes(pa.array([text, "", "W5 w7"]))
    assert (block.words(0, 3) == hashes).all()
    _, times = np.unique(hashes, return_counts=True)
    entropy = -(times * np.log2(times / times.sum())).sum() / 8
    assert len(row.tokens) < 1.15 * entropy
    counts = np.bincount(block.tokens)
    assert (np.diff(np.frexp(counts)[1]) <= 0).all()


@pytest.mark.parametrize("keys", [[], [7], [3, 1, 3, 2**64 - 1, 0, 1], "random", "alike"])
def test_grouped_keys(keys):
    """As np.unique says, also for keys that agree in all leading bits."""
    rng = np.random.default_rng(0)
    made = {"random": lambda: rng.integers(0, 2**63, 5000, dtype=np.uint64)[rng.integers(0, 5000, 9000)], "alike": lambda: np.uint64(2**63) + rng.integers(0, 64, 3000, dtype=np.uint64)}
    keys = made[keys]() if isinstance(keys, str) else np.array(keys, np.uint64)
    distinct, where = packed.grouped(keys)
    expected, index = np.unique(keys, return_inverse=True)
    assert distinct.tolist() == expected.tolist() and where.tolist() == index.tolist()


@pytest.mark.parametrize(("n", "percent"), [(3, 90), (5, 80)])
def test_jaccard_equals_brute_force(spark, n, percent):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, "doc_id", "text", n, percent, block=2).collect()}
    assert found == jaccard_components(documents(spark), n, percent)


def test_jaccard_chains_and_groups(spark):
    words = [f"a{i}" for i in range(60)]
    rows = []
    for i in range(40):  # neighbours link, ends don't
        rows.append((100 + i, " ".join(words[i:] + [f"b{j}" for j in range(i)])))
    rows += [(200 + i, " ".join([*(f"c{j}" for j in range(80)), f"d{i}"])) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, "doc_id", "text", 3, 90, block=4).collect()}
    assert found == jaccard_components(rows, 3, 90)


def test_jaccard_links_of_near_copies_grow_with_the_group(spark, monkeypatch):
    """Near copies of one text, a quarter of which resemble each other enough: twice as many have no four times as many links, and large
    groups are found as by brute force."""
    rng, counts, plain = np.random.default_rng(1), [], ngram_join.components

    def counted(edges, scratch):
        counts[-1] += edges.count()
        return plain(edges, scratch)

    monkeypatch.setattr(ngram_join, "components", counted)
    for size in (100, 200):
        rows = []
        for i in range(size):
            words = [f"b{j}" for j in range(100)]
            for j in rng.permutation(100)[:10]:
                words[j] = f"x{i}y{j}"
            rows.append((i, " ".join(words)))
        counts.append(0)
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        found = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(docs, "doc_id", "text", 1, 69, block=4).collect()}
        assert found == jaccard_components(rows, 1, 69)
    assert counts[1] < 3 * counts[0]
    assert counts[1] < 10 * 200


def test_jaccard_odd_rows(spark, texts, no_texts):
    out = ngram_join.jaccard_components(texts, "doc_id", "text").collect()
    assert [(r.n_shingles, r.component_id) for r in out if r.doc_id is None] == [(3, None)]
    got = sorted((r.doc_id, r.n_shingles, r.component_id) for r in out if r.doc_id is not None)
    assert [x for x in got if x[0] in (1, 5)] == [(1, 8, 1), (5, 8, 1), (5, 8, 1)]
    assert [x for x in got if x[0] in (2, 3, 6)] == [(2, 0, 2), (3, 0, 3), (6, 0, 6)]
    assert ngram_join.jaccard_components(no_texts, "doc_id", "text").collect() == []


def test_jaccard_null_and_repeated_keys(spark):
    one, two = (" ".join(f"{c}{i}" for i in range(30)) for c in "xy")
    rows = [(None, one), (5, one), (6, one), (7, one), (7, two), (8, two), (None, "a lone text here"), (None, None)]
    docs = spark.createDataFrame([(*r, "z", 1) for r in rows], "doc_id long, text string, node string, n int")
    out = ngram_join.jaccard_components(docs, "doc_id", "text").collect()
    got = sorted(((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in out))
    assert got == [(0, 0, 0), (0, 2, 0), (0, 28, 5), (5, 28, 5), (6, 28, 5), (7, 28, 5), (7, 28, 7), (8, 28, 7)]


# ---- 2 and 10 -----------------------------------------------------------------------------------------------------


def test_bpe_equals_library(spark, texts, no_texts):
    library = Tokenizer.from_file(BYTES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").unionByName(texts.select("doc_id", "text"))
    out = bpe_codec.decode(bpe_codec.encode(docs, "doc_id", "text", BYTES), "ids", BYTES)
    both = bpe_codec.round_trip(docs, "doc_id", "text", BYTES)
    assert sorted((r.doc_id or -1, r.ids, r.decoded) for r in both.collect()) == sorted((r.doc_id or -1, r.ids, r.decoded) for r in out.collect())
    expected = sorted((r.doc_id or -1, library.encode(r.text or "", add_special_tokens=False).ids, r.text or "") for r in docs.collect())
    assert sorted((r.doc_id or -1, r.ids, r.decoded) for r in out.collect()) == expected
    assert bpe_codec.encode(no_texts, "doc_id", "text", BYTES).collect() == []


def test_bpe_decodes_any_ids(spark):
    library = Tokenizer.from_file(BYTES)
    whole = library.encode("日本 🙂 é", add_special_tokens=False).ids
    rows = [(0, whole[:1]), (1, whole[1:2]), (2, None), (3, []), (4, whole[:-1]), (5, whole)]
    df = spark.createDataFrame([(k, x, "clash") for k, x in rows], "k int, ids array<int>, decoded string")
    got = {r.k: r.decoded for r in bpe_codec.decode(df, "ids", BYTES).collect()}
    assert got == {k: library.decode(x or [], skip_special_tokens=False) for k, x in rows}


def test_bpe_query_digests(spark):
    library = Tokenizer.from_file(BYTES)
    text = dict(documents(spark))
    for r in Q.op2_bpe_codec(spark, SF).collect():
        ids = library.encode(text[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((text[r.doc_id] or "").encode()).hexdigest()


@pytest.mark.parametrize("chunk", [5, 1 << 15])
def test_token_counts_equal_library(spark, texts, no_texts, chunk):
    library = Tokenizer.from_file(WORDS)
    out = token_counts.token_counts(texts, "doc_id", "text", WORDS, 20, chunk).collect()
    expected = sorted((r.doc_id or -1, len((r.text or "").encode()), len(library.encode(r.text or "", add_special_tokens=False).ids)) for r in texts.collect())
    assert sorted((r.doc_id or -1, r.n_bytes, r.n_tokens) for r in out) == expected
    assert all(r.over_limit == (r.n_tokens > 20) for r in out)
    assert token_counts.token_counts(no_texts, "doc_id", "text", WORDS, 20).collect() == []


def test_state_maps_compose_to_the_library_counts():
    """Any grouping of the chunks, from any state before them, gives the same end state and count."""
    rng = np.random.default_rng(4)
    pool = np.array(["'", "'s", "'r", "e", "'re", "l", "v", "hello", "World", " ", "\n", "5", "½", "!", "。", "日本", "é", "ΑΣ", "<|endoftext|>", "<|", "🙂", "İ"])
    library, words = Tokenizer.from_file(WORDS), token_counts.Counts(token_counts.tables(WORDS))
    special = list(words.machine.bpe.special)
    for _ in range(400):
        t = "".join(rng.choice(pool, rng.integers(1, 40)))
        chunks = token_counts.cut(t, int(rng.integers(1, 8)), special)
        assert "".join(chunks) == t
        maps = [token_counts.state_map(c, words) for c in chunks]
        left = maps[0]
        for m in maps[1:]:
            left = token_counts.compose(left, m, words)
        right = maps[-1]
        for m in reversed(maps[:-1]):
            right = token_counts.compose(m, right, words)
        starts = [token_counts.run(token_counts.OUTSIDE, s, words)[1] for s in ("", "'", "'r", "abc", "?!")]
        for start in starts:
            ends = {m(start, words) for m in (left, right, token_counts.scan(maps, words))}
            assert len(ends) == 1
        n, end = left(token_counts.OUTSIDE, words)
        assert n + token_counts.finish(end, words) == len(library.encode(t, add_special_tokens=False).ids)


def test_large_vocabularies(tmp_path):
    """Ids beyond 131,072, as in vocabularies of 200,000 tokens; ids and symbols beyond the packed keys are refused."""
    import json

    with open(BYTES, encoding="utf-8") as f:
        spec = json.load(f)
    spec["model"]["vocab"] = {t: i * 17 + 3 for t, i in spec["model"]["vocab"].items()}
    spec["added_tokens"] = []
    path = tmp_path / "large.json"
    path.write_text(json.dumps(spec), encoding="utf-8")
    library, words = Tokenizer.from_file(str(path)), bpe_codec.Encoded(bpe_codec.tables(str(path)))
    rng, pool = np.random.default_rng(11), [r for _, r in zip(range(300), open(__file__, encoding="utf-8").read().split(" "), strict=False)]
    for _ in range(300):
        t = " ".join(rng.choice(pool, 12))
        assert bpe_codec.encode_text(t, words) == library.encode(t, add_special_tokens=False).ids
    spec["model"]["vocab"]["!"] = 1 << 24
    path.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError, match="highest"):
        bpe_codec.tables(str(path))


def test_both_vocabularies_on_random_text():
    rng = np.random.default_rng(3)
    pool = np.array(list("abcdehistnre  \n\t'.,!?-_AB01éñüßΣσς́İ中\x1c\x85🙂<|>#½١　"))
    a, b = Tokenizer.from_file(BYTES), Tokenizer.from_file(WORDS)
    words, counts = bpe_codec.Encoded(bpe_codec.tables(BYTES)), token_counts.Counts(token_counts.tables(WORDS))
    for _ in range(1500):
        t = "".join(rng.choice(pool, rng.integers(0, 50)))
        assert bpe_codec.encode_text(t, words) == a.encode(t, add_special_tokens=False).ids
        n = len(b.encode(t, add_special_tokens=False).ids)
        assert token_counts.count_tokens(t, counts) == n == token_counts.count_tokens(t, counts, 6)


# ---- 4 ------------------------------------------------------------------------------------------------------------


def test_chat_query(spark):
    turns = {}
    for r in spark.read.parquet(f"{SF}/conversations.parquet").collect():
        turns.setdefault(r.conv_id, []).append((r.turn, r.role, r.text or ""))
    said = "</s>[INST] ok [/INST]"
    turns[-7] = [(0, "user", said), (1, "assistant", said)]
    found = {r.conv_id: r for r in Q.op4_chat_format(spark, SF).collect()}
    assert set(found) == set(turns)
    for k, rows in turns.items():
        rows.sort()
        loss = "".join(t for _, role, t in rows if role == "assistant")
        r = found[k]
        assert r.n_turns == len(rows) and r.loss_chars == len(loss) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in rows).encode()).hexdigest()


def test_chat_layouts(spark):
    records = ['{"messages": [{"role": "user", "content": "a<[\\\\"}, {"role": "assistant", "content": null}]}', '{"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}', '{"prompt": "p", "response": "r"}', '{"instruction": "i", "input": "x", "output": "o"}', '{"instruction": "i", "input": "", "output": "o"}', '{"unknown": 1}', "not json", None, '{"question": "q", "answer": 5}']
    df = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(records)], "id int, record string, formatted string")
    out = chat.format_chats(df, "id", "record").withColumn("turns", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.masked_text(F.col("formatted"), F.col("loss_spans")))
    got = {r.id: ([tuple(t) for t in r.turns], r.loss) if r.turns is not None else None for r in out.collect()}
    assert got == {0: ([("user", "a<[\\"), ("assistant", "")], ""), 1: ([("user", "a"), ("assistant", "b")], "b"), 2: ([("user", "p"), ("assistant", "r")], "r"), 3: ([("user", "i\n\nx"), ("assistant", "o")], "o"), 4: ([("user", "i"), ("assistant", "o")], "o"), 5: None, 6: None, 7: None, 8: ([("user", "q"), ("assistant", "5")], "5")}
    assert chat.format_chats(df.limit(0), "id", "record").collect() == []


def test_chat_unreadable_records(spark):
    """A wrong escape or a raw line break inside a text: neither emptied nor fatal, whatever the layout."""
    bad = [r'"p\q"', '"a\nb"', '"tab\there"', '"\x01"']
    layouts = ['{"prompt": %s, "response": "r"}', '{"question": "q", "answer": %s}', '{"instruction": %s, "input": "", "output": "o"}', '{"messages": [{"role": "user", "content": %s}]}', '{"turns": [{"turn": 0, "role": "user", "text": %s}]}', '{"conversations": [{"from": "human", "value": %s}]}']
    rows = [(x % b, "unreadable") for x in layouts for b in bad] + [(x % '"fine"', None) for x in layouts]
    rows += [('{"prompt": null, "response": null}', "unknown"), ('{"other": 1}', "unknown layout"), ("no json", "unknown layout"), (None, "unknown layout")]
    df = spark.createDataFrame([(i, r, "clash") for i, (r, _) in enumerate(rows)], "id int, record string, error string")
    found = {r.id: r for r in chat.format_chats(df, "id", "record").collect()}
    for i, (_, error) in enumerate(rows):
        if error != "unknown":
            assert (found[i].error, found[i].formatted is None, found[i].loss_spans is None) == (error, error is not None, error is not None), rows[i]


def test_chat_ties_and_nulls(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, "user", "a"), (1, 1, None, None), (None, 0, "user", "x")], "c int, t int, role string, text string")
    out = chat.format_chats(chat.turn_rows_to_records(rows, "c", "t", "role", "text"), "c", "record")
    got = {r.c: [tuple(t) for t in r.turns] for r in out.select("c", chat.read_turns(F.col("formatted")).alias("turns")).collect()}
    assert got == {1: [("user", "a"), ("user", "a"), ("user", "b"), ("", "")], None: [("user", "x")]}


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    assert compare(spark, name, Q.QUERIES[name], Q.ORACLE_SQL[name], SF) > 0


def test_chat_keeps_very_long_texts(spark):
    rows = spark.sql(r"select 1L as c, 0L as t, 'assistant' as role, repeat('ab\"<\\\\', 5000000) as text")
    out = chat.format_chats(chat.turn_rows_to_records(rows, "c", "t", "role", "text"), "c", "record")
    back = out.select(chat.read_turns(F.col("formatted"))[0]["text"].alias("text"))
    assert rows.select(F.sha2("text", 256), F.length("text")).first() == back.select(F.sha2("text", 256), F.length("text")).first()


# ---- 5 ------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("compression", [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.PACKBITS])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tile", [None, (16, 32)])
@pytest.mark.parametrize("order", ["<", ">"])
def test_tiff_round_trip(compression, predictor, tile, order):
    rng = np.random.default_rng(1)
    pages = [rng.integers(0, top, (41, 50, k), dtype=np.uint8) for top, k in ((3, 1), (256, 3))]
    out = list(tiff.pages_of(tiff.write_tiff(pages, compression, predictor, 8, tile, order)))
    assert [(p[0], p[6]) for p in out] == [(i, p.tobytes()) for i, p in enumerate(pages)]


def test_tiff_operator(spark, texts, no_texts):
    stored = tiff.encode_text(texts, "doc_id", "text")
    got = sorted((r.doc_id or -1, r.page, r.pixels) for r in tiff.decode_pages(stored, "doc_id", "media").collect())
    pad = lambda b: b + b"\xff" * (-len(b) % 576 if b else 576)
    assert [(k, bytes(p)) for k, _, p in got] == sorted((r.doc_id or -1, pad((r.text or "").encode())) for r in texts.collect())
    two = tiff.write_tiff([np.zeros((2, 3, 1), np.uint8)] * 2)
    broken = spark.createDataFrame([(1, b"nonsense"), (2, None), (3, two), (4, two[:-20])], "k int, m binary")
    out = sorted((r.k, r.page, r.error is not None) for r in tiff.decode_pages(broken, "k", "m").collect())
    assert out[:3] == [(1, -1, True), (3, 0, False), (3, 1, False)] and any(k == 4 and bad for k, _, bad in out)
    assert tiff.encode_text(no_texts, "doc_id", "text").collect() == []


def test_tiff_bad_sizes():
    good = tiff.write_tiff([np.zeros((4, 8, 1), np.uint8)])
    for tag in (tiff.WIDTH, tiff.HEIGHT, tiff.SAMPLES, tiff.ROWS_PER_STRIP):
        for value in (0, 2**31 - 1):
            bad = bytearray(good)
            at = bad.index(tag.to_bytes(2, "little") + (4).to_bytes(2, "little"), 8)
            bad[at + 8 : at + 12] = value.to_bytes(4, "little")
            (page,) = tiff.pages_of(bytes(bad))
            assert page[0] == 0 and ((page[-1] is None) == (tag == tiff.ROWS_PER_STRIP and value > 0))


def test_tiff_query(spark):
    text = dict(documents(spark))
    for r in Q.op5_tiff_media(spark, SF).collect():
        raw = (text[r.doc_id] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        stored = tiff.write_tiff([np.frombuffer(payload, np.uint8).reshape(-1, 64, 1)])
        assert (r.media_bytes, r.media_sha256) == (len(stored), hashlib.sha256(stored).hexdigest())
        values = np.frombuffer(payload, np.uint8)
        assert f"mean={values.mean():.4f}" in r.feature and r.feature.startswith(f"64x{len(payload) // 64}x1;")


# ---- 6 and 8 ------------------------------------------------------------------------------------------------------

ITEM = "the quick brown fox jumps over a lazy dog while seven wise owls watch from old trees near rivers"


def test_decontamination_finds_substituted_passages(spark):
    words = ITEM.split()
    changed = words[:]
    changed[4], changed[9] = "xx", "yy"
    rows = [(1, f"Intro text. {ITEM.upper()}! And more"), (2, "well, " + " ".join(changed)), (3, "the quick brown fox jumps and then nothing else of it is here at all today"), (4, None), (5, ""), (1, f"Intro text. {ITEM.upper()}! And more"), (6, " ".join(reversed(words)))]
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, item_id string")
    items = spark.createDataFrame([(10, ITEM), (11, "too short"), (12, None), (10, ITEM)], "item_id long, text string")
    for limit in (10**5, 0):
        out = decontaminate.contaminated(docs, items, "doc_id", "text", "item_id", "text", broadcast_rows=limit).collect()
        assert sorted((r.doc_id, r.item_id, r.doc_start) for r in out) == [(1, 10, 2), (2, 10, 1)]
    assert decontaminate.contaminated(docs.limit(0), items, "doc_id", "text", "item_id", "text").collect() == []
    assert decontaminate.contaminated(docs, items.limit(0), "doc_id", "text", "item_id", "text").collect() == []


def test_decontamination_finds_short_items_and_null_keys(spark):
    lengths, items, docs, expected = range(1, 15), [], [], set()
    for n in lengths:
        words = [f"k{n}x{i}" for i in range(n)]
        items.append((n, " ".join(words)))
        most = n - int(np.ceil(0.8 * n))
        for bits in range(1 << n):
            if bin(bits).count("1") <= most + 1 and (n < 11 or bits % 7 == 0):
                docs.append((len(docs), "pre fix " + " ".join("zz" if bits >> i & 1 else w for i, w in enumerate(words)) + " end"))
                window = [bin(bits >> k & (1 << 13) - 1).count("1") for k in range(max(1, n - 12))]
                if min(window) <= (most if n < 13 else 2):
                    expected.add((docs[-1][0], n))
    docs += [(None, docs[0][1]), (None, "nothing of note")]
    d, i = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    out = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(d, i, "doc_id", "text", "item_id", "text").collect()}
    found = {x for x in out if x[0] is not None}
    assert out - found == {(None, 1)} and found <= expected and expected - found == set()


def test_decontamination_query_equals_brute_force(spark):
    tokens = lambda t: [w for w in regex.split(r"[^\p{L}\p{N}]+", (t or "").lower()) if w]
    items = {r.item_id: tokens(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    expected = set()
    for k, t in documents(spark):
        words, places = tokens(t), {}
        for at, w in enumerate(words):
            places.setdefault(w, []).append(at)
        for name, item in items.items():
            size = min(13, len(item))
            for diagonal in {at - i for i, w in enumerate(item) for at in places.get(w, ())}:
                same_word = [0 <= i + diagonal < len(words) and words[i + diagonal] == w for i, w in enumerate(item)]
                inside = [0 <= i + diagonal < len(words) for i in range(len(item))]
                if any(all(inside[a : a + size]) and sum(same_word[a : a + size]) >= np.ceil(0.8 * size) for a in range(len(item) - size + 1)):
                    expected.add((k, name))
    assert expected and {(r.doc_id, r.item_id) for r in Q.op6_spaced_seeds(spark, SF).collect()} == expected


def test_dedup_keeps_first_and_offsets(spark):
    line = "one two three four five six seven eight nine ten"
    passage = "First sentence with a good many words in it. Second sentence has quite a few more of them."
    rows = [(1, f"{line}\nown words"), (2, f"start\n{line.upper()}!\nend"), (3, f"head. {passage} tail"), (4, f"other host. {passage} more"), (5, None), (6, ""), (7, "short line\nshort line"), (8, f"{line}\n{line}")]
    docs = spark.createDataFrame([(k, t, "keep") for k, t in rows], "doc_id long, text string, start string")
    out = {r.doc_id: r for r in substring_dedup.dedup(docs, "doc_id", "text").collect()}
    assert out[1].text == rows[0][1] and out[2].text == "start\nend" and out[5].text is None and out[6].text == "" and out[7].text == rows[6][1] and out[8].text == ""
    assert out[3].text == rows[2][1] and "Second" not in out[4].text and out[4].text.startswith("other host.") and out[4].text.endswith("more")
    for k, t in rows:
        if t:
            kept, at = "", 0
            for s in out[k].removed:
                kept, at = kept + t[at : s.start], s.end
            assert kept + t[at:] == out[k].text and out[k].start == "keep"
    assert substring_dedup.dedup(docs.limit(0), "doc_id", "text").collect() == []


def test_dedup_equals_brute_force(spark):
    first, expected = {}, {}
    docs = sorted(documents(spark))
    for k, t in docs:
        for a, _, *digest in substring_dedup.units(t or "", 8):
            first[tuple(digest)] = min(first.get(tuple(digest), (k, a)), (k, a))
    for k, t in docs:
        spans = [(a, b) for a, b, *d in substring_dedup.units(t or "", 8) if first[tuple(d)] != (k, a)]
        expected[k] = None if t is None else substring_dedup.cut_out(t, substring_dedup.merged(spans))
    assert {r.doc_id: r.text for r in Q.op8_line_dedup(spark, SF).collect()} == expected


def test_dedup_leaves_no_shared_run_of_50_words(spark):
    rng = np.random.default_rng(8)
    fresh = lambda n: [f"{rng.choice(list('abcdefgh'))}{x}" for x in rng.integers(0, 10**9, n)]
    passages = [fresh(n) for n in (50, 55, 70, 120)]
    rows = []
    for k in range(40):  # long sentences, other openings, one word changed in places
        shared = list(passages[k % 4])
        if k % 3 == 0 and len(shared) >= 70:
            shared[-5] = "changed"
        rows.append((k, " ".join([*fresh(rng.integers(1, 60)), *shared, *fresh(rng.integers(1, 60))]) + "."))
    rows += [(100 + k, " ".join([*fresh(5), *["filler"] * (60 + 7 * k), *fresh(5)])) for k in range(4)]
    rows += [(110 + k, "\n".join([*(" ".join(passages[2][i : i + 5]) for i in range(0, 70, 5)), f"own{k}"])) for k in range(3)]
    rows.append((120, " ".join(passages[0][:16]) + " other"))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id: r.text for r in substring_dedup.dedup(docs, "doc_id", "text").collect()}
    runs = lambda t: {tuple(w[i : i + 50]) for w in [t.replace(".", "").lower().split()] for i in range(len(w) - 49)}
    seen = set()
    for k, _ in rows:
        assert not (own := runs(kept[k])) & seen, k
        seen |= own
    assert all(kept[k] == t for k, t in rows[:4]) and kept[120] == rows[-1][1]
    words = {w for _, t in rows for w in t.replace(".", "").split()}
    assert words == {w for t in kept.values() for w in t.replace(".", "").split()}  # a copy of everything stays


def test_dedup_odd_rows(spark, texts):
    line, other = "one two three four five six seven eight nine ten", "abc def ghi jkl mno pqr stu vwx yza bcd"
    rows = [(None, f"{line}\nnull key"), (1, f"first\n{line}"), (2, f"{line}\n{other}"), (2, f"{other}\nzzzz"), (3, f"own\n{other}"), (None, f"{line}\nnull key")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, removed string")
    out = substring_dedup.dedup(docs, "doc_id", "text")
    assert out.columns == ["doc_id", "text", "removed"]
    got = sorted((r.doc_id or 0, r.text) for r in out.collect())
    one_of = [(2, other), (2, "zzzz")], [(2, ""), (2, f"{other}\nzzzz")]
    assert got[:2] == [(0, "null key")] * 2 and (1, rows[1][1]) in got and (3, "own\n") in got
    assert [x for x in got if x[0] == 2] in one_of
    odd = substring_dedup.dedup(texts, "doc_id", "text")
    assert odd.count() == 9 and odd.columns == [*texts.columns, "removed"]


def test_dedup_paragraphs_of_short_lines(spark):
    block = "Home\nAbout our shop\nTerms of use\nContact and help"
    docs = spark.createDataFrame([(1, f"{block}\n\nfirst"), (2, f"other\n\n{block}\n\nsecond"), (3, "Home\n\nthird")], "doc_id long, text string")
    kept = {r.doc_id: r.text for r in substring_dedup.dedup(docs, "doc_id", "text").collect()}
    assert kept == {1: f"{block}\n\nfirst", 2: "other\n\n\nsecond", 3: "Home\n\nthird"}


# ---- 7 ------------------------------------------------------------------------------------------------------------


def test_shards(spark, texts, no_texts):
    many = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"))
    out = sharding.shard(many, "doc_id", "text", sharding.even_tree(8)).collect()
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r.slot)
        assert r.grown_shard in (r.shard, 8)
    assert set(by) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) < 1.3 * 500 and 0.06 < sum(r.grown_shard == 8 for r in out) / 4000 < 0.17
    heavy = sharding.even_tree(8) | {"r9": {"k9": {8: 8.0}}}
    moved = sharding.shard(many, "doc_id", "text", heavy).filter("shard = 8").count()
    assert 0.45 < moved / 4000 < 0.55
    odd = sharding.shard(texts, "doc_id", "text", sharding.even_tree(8)).collect()
    assert len(odd) == 9 and {r.size for r in odd if r.doc_id in (2, 3)} == {1}
    assert {r.text_crc32 for r in odd if r.doc_id == 7} == {zlib.crc32("Één naïve test <|endoftext|> 日本 🙂".encode())}
    assert len({(r.shard, r.slot) for r in odd}) == 9
    assert sharding.shard(no_texts, "doc_id", "text", sharding.even_tree(8)).collect() == []


# ---- 9 ------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_words_and_misspellings(spark, texts, no_texts):
    rng = np.random.default_rng(0)
    plain = [f"{a}{b}" for a in ("lor", "men", "tis", "ver", "sal") for b in ("ena", "ito", "ulo", "ade", "ish")]
    bad = ["grumblix", "grumblor", "snarfing", "snarfed"]
    make = lambda toxic: " ".join(rng.permutation([*rng.choice(plain, 60), *(rng.choice(bad, 3) if toxic else [])]))
    labels = np.arange(300) % 3 == 0
    model = toxicity.train([make(t) for t in labels], labels)
    words = toxicity.WordNumbers(model)
    scores = np.array([model.score(make(t), words) for t in labels])
    assert ((scores >= 0.5) == labels).mean() > 0.98
    assert model.score(" ".join([*plain, "grumblixx", "snarfling", *plain]), words) > 0.5 > model.score(" ".join(plain), words)
    out = toxicity.score(texts, "doc_id", "text", model).collect()
    assert len(out) == 9 and all(0 <= r.score <= 1 for r in out)
    assert toxicity.score(no_texts, "doc_id", "text", model).collect() == []
    beside = toxicity.with_score(texts, "text", model)
    assert beside.columns == [*(c for c in texts.columns if c != "score"), "score"]
    assert sorted((r["doc_id"] or 0, r["score"]) for r in beside.collect()) == sorted((r["doc_id"] or 0, r["score"]) for r in out)
    assert toxicity.train(["a b"], np.array([1])) is None


def test_toxicity_sees_all_of_a_long_word():
    long = "".join(chr(0x4E00 + i) for i in range(300))
    pieces = toxicity.word_list(f"short {long} end")
    assert pieces[0] == "short" and pieces[-1] == "end" and all(len(p) <= 40 for p in pieces)
    assert all(any(long[i : i + 5] in p for p in pieces) for i in range(296))
    for n in (40, 41, 44, 45, 76, 77):
        pieces = toxicity.word_list(long[:n])
        assert set("".join(pieces)) == set(long[:n]) and (n > 40 or pieces == [long[:n]])


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.01"
    scored = Q.op9_toxicity(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out")
    rows = [(r.toxic, r.predicted) for r in scored.collect()]
    clean = [p for t, p in rows if not t]
    assert sum(clean) / len(clean) < 0.1 and sum(p for t, p in rows if t) >= 1
