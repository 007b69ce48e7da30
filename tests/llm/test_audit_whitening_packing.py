"""Operators 11 to 13: brute force, exact values and odd rows."""

import zlib
from collections import Counter
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from spindrift.llm import divergence, packing, whitening
from spindrift.llm import queries as Q
from spindrift.llm.configurations import plan, solve
from spindrift.llm.eigen import eigen

SF = "/root/testdata/sf0.001"
BYTES = public_tokenizers.path("byte_bpe_50k.json")

# ---- 11 -----------------------------------------------------------------------------------------------------------

DOCS = "text string, lang string, source string, term string, salt int"


def audit_of(rows, least, top):
    """The audit of (text, lang, source), by loops."""
    import re

    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(lower)), lang or "", s or "") for t, lang, s in rows]
    out = set()
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        seen = Counter(w for t, _, _ in mine for w in set(t))
        kept = sorted(w for w, n in seen.items() if n >= least)
        shares = {}
        for s in (None, *{d[2] for d in mine}):
            c = Counter(w for t, _, x in mine if s in (None, x) for w in t)
            total = sum(c[w] for w in kept)
            shares[s] = c, {w: 1 + 10**9 * (c[w] + 1) // (total + len(kept)) for w in kept}
        f = lambda p, q: (p - q) ** 2 // q
        for s, (c, p) in shares.items():
            if s is None:
                continue
            pairs = [(sum(f(p[w], shares[o][1][w]) for w in kept), o) for o in shares if o not in (None, s)]
            q = shares[None][1]
            terms = [(f(p[w], q[w]), w) for w in kept if c[w] and p[w] > q[w]]
            for part, found in (("pair", pairs), ("term", terms)):
                found.sort(key=lambda x: (-x[0], x[1].encode()))
                out |= {(lang, s, part, item, v, r) for r, (v, item) in enumerate(found, 1) if part == "pair" or r <= top}
    return out


def test_divergence_equals_loops(spark):
    rng = np.random.default_rng(5)
    words = ["the", "The", "a", "Émile", "émile", "日本", "x-y", "it's", "q1w", "zz", "Straße"]
    rows = [(" ".join(rng.choice(words, rng.integers(0, 30))), rng.choice(["en", "de", "rare"], p=[0.7, 0.25, 0.05]), f"s{rng.integers(0, 5)}") for _ in range(80)]
    rows += [(None, None, None), ("", "only", "a"), (None, "only", "b"), ("x y", "only", "b"), ("the the", "en", None), ("the " * 70_000, "en", "s0"), *rows[:3]]
    df = spark.createDataFrame([(t, str(g) if g is not None else None, s, "clash", 1) for t, g, s in rows], DOCS)
    found = divergence.audit(df, "text", "lang", "source", least=3, top=4).collect()
    assert {tuple(r) for r in found} == audit_of(rows, 3, 4) and len(found) == len(audit_of(rows, 3, 4))
    assert {r.value for r in found if r.lang == "only"} == {0}


def test_divergence_of_nothing_and_large_counts(spark):
    assert divergence.audit(spark.createDataFrame([], DOCS), "text", "lang", "source").collect() == []
    shares = spark.range(1).select(divergence._share(F.lit(10**15), F.lit(4 * 10**15), F.lit(7)).alias("p"))
    assert shares.first().p == 1 + 10**9 * (10**15 + 1) // (4 * 10**15 + 7)


def test_terms_ranked_by_tasks_before_the_shuffle(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    plan_ = divergence.audit(df, "text", "lang", "source")._jdf.queryExecution().toString()
    assert "WindowGroupLimit" in plan_ and "CartesianProduct" not in plan_


# ---- 12 -----------------------------------------------------------------------------------------------------------


def test_eigen_of_hard_matrices():
    rng = np.random.default_rng(0)
    for n in (1, 2, 3, 8, 17, 40):
        a = rng.normal(size=(n, n))
        q = np.linalg.qr(a)[0]
        wilkinson = np.diag(np.abs(np.arange(n) - n // 2).astype(float)) + np.eye(n, k=1) + np.eye(n, k=-1)
        for m in (a @ a.T, np.eye(n), np.zeros((n, n)), np.outer(a[0], a[0]), q * np.repeat([1.0, 5.0, 5 + 1e-13], n)[:n] @ q.T, q * 10.0 ** -np.linspace(0, 12, n) @ q.T, wilkinson):
            m = (m + m.T) / 2
            values, vectors = eigen(m)
            size = max(np.abs(m).max(), 1e-300)
            assert np.abs(values - np.linalg.eigvalsh(m)).max() <= 1e-13 * size * n
            assert np.abs(vectors.T @ vectors - np.eye(n)).max() <= 1e-13
            assert np.abs(m @ vectors - vectors * values).max() <= 1e-13 * size * n


def test_double_double_is_exact():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=100) * 10.0 ** rng.integers(-8, 8, 100), rng.normal(size=100)
    p, e = whitening.two_product(a, b, whitening.halves(a), whitening.halves(b))
    assert all(Fraction(x) * Fraction(y) == Fraction(h) + Fraction(low) for x, y, h, low in zip(a, b, p, e, strict=True))
    high, low = whitening.dd_sum((a * 1e10, b * 1e-10))
    exact = sum(map(Fraction, (a * 1e10).tolist())) + sum(map(Fraction, (b * 1e-10).tolist()))
    assert abs(Fraction(float(high)) + Fraction(float(low)) - exact) <= abs(exact) * Fraction(1, 2**95)


def test_covariance_keeps_what_a_plain_one_loses(spark):
    """Entries of about 2^40 that vary by 1: the squares have 80 bits, the variance is of the last ones."""
    rows = [[2**40 + i % 3, 2**40 - i % 5] for i in range(600)]
    df = spark.createDataFrame([(r,) for r in rows], "x array<bigint>").repartition(7)
    n, sums = whitening.exact_sums(df)
    mean = tuple(map(np.array, zip(*(whitening.dd_number(Fraction(s, n)) for s in sums), strict=True)))
    exact = [[sum((r[i] - Fraction(sums[i], n)) * (r[j] - Fraction(sums[j], n)) for r in rows) / n for j in (0, 1)] for i in (0, 1)]
    assert whitening.covariance(df, "x", n, mean) == pytest.approx(np.array(exact, float), rel=1e-15, abs=1e-15)


def test_whitening_query(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    x = np.floor(1024 * np.array([r.embedding for r in table], float)).astype(np.int64) + 100_000
    n, s = len(x), x.sum(axis=0)
    d = x - s / n
    values, vectors = np.linalg.eigh(d.T @ d / n)
    deviation = {r.vec_id: int((((n * v - s).astype(object)) ** 2).sum()) for r, v in zip(table, x, strict=True)}
    white = {r.vec_id: v for r, v in zip(table, d @ vectors[:, ::-1] / np.sqrt(values[::-1]), strict=True)}
    found = Q.op12_whitening(spark, SF).collect()
    assert len(found) == 8 * n and {(r.n, r.component) for r in found} == {(n, c) for c in range(1, 9)}
    sign = {r.component: np.sign(r.whitened * white[r.vec_id][r.component - 1]) for r in found if r.vec_id == table[0].vec_id}
    for r in found:
        assert r.deviation == deviation[r.vec_id] and r.identity_error < 1e-10
        assert r.whitened == pytest.approx(sign[r.component] * white[r.vec_id][r.component - 1], abs=1e-9)
        assert r.explained == pytest.approx(values[-r.component] / values.sum(), rel=1e-10)


def test_whitening_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    kind = "vec_id long, embedding array<float>, white array<double>, n int"
    rows = [(1, [1.0, 2.0, 0.5]), (2, None), (3, [1.0, None, 2.0]), (4, [nan, 1.0, 2.0]), (5, [1.0, -inf, 2.0]), (None, [0.0, -2.0, 0.5]), (6, [3.0, 1.0, 0.5]), (6, [3.0, 1.0, 0.5])]
    out = whitening.whiten(spark.createDataFrame([(k, v, None, 1) for k, v in rows], kind), "vec_id", "embedding").collect()
    assert sorted(Counter(r.vec_id or 0 for r in out).items()) == [(0, 3), (1, 3), (6, 6)]  # at most as many components as entries
    assert {r.component for r in out if r.whitened is None} == {3} and all(r.explained == 0 or r.component < 3 for r in out)
    assert out[0].identity_error < 1e-12
    same = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0], None, 1)], kind), "vec_id", "embedding").collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in same] == [(1, 0, None, 0, 0), (2, 0, None, 0, 0)]
    for nothing in ([], [(1, None, None, 1)], [(1, [], None, 1)]):
        assert whitening.whiten(spark.createDataFrame(nothing, kind), "vec_id", "embedding").collect() == []
    with pytest.raises(Exception, match="unequal length"):
        whitening.whiten(spark.createDataFrame([(1, [1.0], None, 1), (2, [1.0, 2.0], None, 1)], kind), "vec_id", "embedding").collect()
    assert whitening.deviations(np.array([[2**40, -(2**40)]]), 1000, [3, 5]) == [(1000 * 2**40 - 3) ** 2 + (1000 * 2**40 + 5) ** 2]


# ---- 13 -----------------------------------------------------------------------------------------------------------


def check_packing(rows, expected, capacity):
    """rows hold what is expected of each document (key, ids), and sequences have no gaps; the number of sequences."""
    want = Counter()
    for key, ids in expected:
        n = len(ids)
        first = (n - 1) % capacity + 1
        cuts = [0, *range(first, n + 1, capacity)]
        for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
            want[key, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    of = {}
    for r in rows:
        of.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for members in of.values():
        members.sort()
        assert [o for o, _ in members] == [0, *np.cumsum([n for _, n in members]).tolist()][:-1] and sum(n for _, n in members) <= capacity
    return len(of)


def test_packing_query_equals_library(spark):
    library = Tokenizer.from_file(BYTES)
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    expected = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 0]) for r in docs]
    n = check_packing(Q.op13_configuration_packing(spark, SF).collect(), expected, 2048)
    assert n <= -(-sum(len(i) for _, i in expected) // 2048) + 1


def test_packing_odd_rows(spark, texts, no_texts):
    library = Tokenizer.from_file(BYTES)
    docs = texts.withColumnRenamed("n", "length").repartition(3)
    out = packing.pack(docs, "doc_id", "text", BYTES, capacity=64, end=7)
    expected = [(r.doc_id, [*library.encode(r.text or "", add_special_tokens=False).ids, 7]) for r in texts.collect()]
    rows = out.collect()
    check_packing(rows, expected, 64)
    whole = packing.sequences(out, "doc_id").collect()
    assert sum(len(r.ids) for r in whole) == sum(len(i) for _, i in expected)
    for r in whole:
        assert len(r.ids) == sum(r.lengths) <= 64 and len(r.keys) == len(r.lengths)
    assert packing.pack(no_texts, "doc_id", "text", BYTES).collect() == []


def test_packing_words_equal_library():
    rng = np.random.default_rng(8)
    pool = np.array(list("abcdehistnre  \n\t'.,!?-_AB01éñüßΣσς́İ中\x1c\x85🙂<|>#½١　") + ["<|endoftext|>", "'s", " the"])
    library, words = Tokenizer.from_file(BYTES), packing.Words(BYTES)
    for _ in range(1500):
        t = "".join(rng.choice(pool, rng.integers(0, 50)))
        assert np.frombuffer(words.encode(t), np.uint32).tolist() == library.encode(t, add_special_tokens=False).ids


def bins_of(lengths, capacity):
    """Best fit, longest first."""
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [r for r in room if r >= n]
        if fits:
            room.remove(min(fits))
        room.append((min(fits) if fits else capacity) - n)
    return len(room)


@pytest.mark.parametrize("kind", ["mixed", "uniform", "thirds", "large", "same"])
@pytest.mark.parametrize("n", [1, 60, 1500])
def test_plan(kind, n):
    rng, capacity = np.random.default_rng(n), 256
    lengths = {"mixed": rng.integers(1, 60, n) + rng.integers(0, 2, n) * 130, "uniform": rng.integers(1, 257, n), "thirds": rng.integers(75, 137, n), "large": rng.integers(120, 257, n), "same": np.full(n, 90)}[kind]
    counts = np.bincount(lengths, minlength=capacity + 1)
    found = plan(counts)
    assert found.bound <= found.sequences <= 1.025 * bins_of(lengths.tolist(), capacity) + 1
    assert found.sequences >= -(-int(lengths.sum()) // capacity)
    number = np.concatenate([np.arange(c) for c in counts])
    size = np.repeat(np.arange(capacity + 1), counts)
    sequence, offset = found.place(size, number)
    order = np.lexsort((offset, sequence))
    sequence, offset, size = sequence[order], offset[order], size[order]
    first = np.concatenate([[True], sequence[1:] != sequence[:-1]])
    assert (offset[first] == 0).all() and (offset[~first] == (offset + size)[:-1][~first[1:]]).all() and (offset + size <= capacity).all()
    assert len(np.unique(sequence)) == found.sequences


def test_program_meets_its_bound():
    """Lengths of which any mix fills sequences: the amounts come within 2 % of the bound, and cover all pieces."""
    counts = np.bincount(np.repeat([16, 32, 64, 96], [400, 300, 200, 100]), minlength=257)
    amounts, prices, bound = solve(counts)
    assert bound == pytest.approx(38400 / 256) and bound <= sum(amounts.values()) <= 1.02 * bound
    covered = Counter()
    for c, a in amounts.items():
        assert sum(size * times for size, times in c) <= 256 and sum(prices[size] * times for size, times in c) <= 1 + 1e-9
        for size, times in c:
            covered[size] += a * times
    assert all(covered[size] >= counts[size] * (1 - 1e-9) for size in (16, 32, 64, 96))


def test_plan_size_does_not_grow_with_pieces():
    rng = np.random.default_rng(2)
    counts = np.bincount(rng.integers(1, 257, 3000), minlength=257)
    small, large = plan(counts), plan(counts * 1_000_000)
    assert len(large.length) <= 4 * len(small.length) and large.sequences >= large.bound
    assert large.sequences <= 1_000_000 * small.sequences
