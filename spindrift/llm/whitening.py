"""Embedding whitening (operator 12): components of the covariance of all vectors, computed with compensated sums.

Entries become whole numbers, ``floor(scale * c) + shift``, and their sums are exact.  The covariance adds up centred outer
products in double-double: every product and every sum leaves its rounding error behind (error-free transformations), and a
task hands on two numbers for each entry, the high and the low part, which are merged by the same sums.  The matrix is brought
to tridiagonal form by reflections and solved by divide and conquer.  The vectors themselves never leave their tasks: what
reaches the driver is ``dim`` sums and ``dim`` x ``dim`` numbers, and ``MOST_DIM`` bounds those.

Rows whose vector is null or holds null or non-finite entries are dropped; vectors of unequal length are an error.  Repeated
rows count and come back each by itself; keys may be null.  An entry beyond 64 bits is an error.  No remaining vectors, or vectors of length 0, give no rows.  Components
beyond the rank of the data (an eigenvalue within rounding of 0) have nothing to scale: ``whitened`` is null and they stand
outside ``identity_error``.  Equal eigenvalues have some basis of their space, the same for all rows.  Texts aren't read; extra
columns are ignored.
"""

from __future__ import annotations

from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, parallelism, release
from .eigen import eigen

MOST_DIM = 2048
ROWS = 512
_SPLIT = 134217729.0  # 2^27 + 1
_MERGED = "row int, high array<double>, low array<double>"


# ---- double-double ------------------------------------------------------------------------------------------------


def two_sum(a, b):
    """The rounded sum and its error, exactly."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def halves(a):
    """Two numbers of at most 26 bits that add up to a."""
    t = _SPLIT * a
    high = t - (t - a)
    return high, a - high


def two_product(a, b, a_halves, b_halves):
    """The rounded product and its error, exactly."""
    p = a * b
    (ah, al), (bh, bl) = a_halves, b_halves
    return p, al * bl - (((p - ah * bh) - al * bh) - ah * bl)


def dd_add(a, b):
    """Sum of two double-doubles (high, low)."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = two_sum(s, e + t)
    return two_sum(s, e + f)


def dd_sum(a):
    """Sum of a double-double array over its first axis, by halves."""
    high, low = a
    while len(high) > 1:
        if len(high) % 2:
            high, low = (np.concatenate([x, np.zeros_like(x[:1])]) for x in (high, low))
        high, low = dd_add((high[::2], low[::2]), (high[1::2], low[1::2]))
    return high[0], low[0]


def dd_number(x: Fraction) -> tuple[float, float]:
    high = x.numerator / x.denominator
    return high, float(x - Fraction(high))


def centred(x: np.ndarray, mean: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """x minus a double-double mean, as double-double."""
    s, e = two_sum(x, -mean[0])
    return two_sum(s, e - mean[1])


def outer_sums(d: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Sum over rows of d d', upper triangle, as double-double."""
    high, low = d
    h = halves(high)
    dim = high.shape[1]
    out = np.zeros((dim, dim)), np.zeros((dim, dim))
    for i in range(dim):
        a, b = slice(i, i + 1), slice(i, dim)
        p, e = two_product(high[:, a], high[:, b], (h[0][:, a], h[1][:, a]), (h[0][:, b], h[1][:, b]))
        out[0][i, b], out[1][i, b] = dd_sum(two_sum(p, e + (high[:, a] * low[:, b] + low[:, a] * high[:, b])))
    return out


# ---- over Spark ---------------------------------------------------------------------------------------------------


def _matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0))


def _lists(matrix: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(matrix) + 1, dtype=np.int32) * matrix.shape[1]), pa.array(np.ascontiguousarray(matrix).ravel()))


def _merged(parts: DataFrame, salts: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Adds up double-double rows of equal number: first by row and salt, then by row, so that no task reads all tasks' parts."""

    def add(batches):
        total: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in batches:
            for r, high, low in zip(b.column(0).to_pylist(), _matrix(b.column(1)), _matrix(b.column(2)), strict=True):
                total[r] = dd_add(total[r], (high, low)) if r in total else (high, low)
        if total:
            rows = sorted(total)
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), *(_lists(np.array([total[r][k] for r in rows])) for k in (0, 1))], ["row", "high", "low"])

    some = parts.repartition(salts, "row", F.spark_partition_id() % salts).mapInArrow(add, _MERGED)
    return {r["row"]: (np.array(r["high"]), np.array(r["low"])) for r in some.repartition(salts, "row").mapInArrow(add, _MERGED).collect()}


def covariance(rows: DataFrame, column: str, n: int, mean: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The covariance (divisor n) of a column of equally long arrays, centred at a double-double mean."""
    dim = len(mean[0])

    def run(batches):
        release()
        total = np.zeros((dim, dim)), np.zeros((dim, dim))
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(0).slice(at, ROWS)).astype(np.float64)
                total = dd_add(total, outer_sums(centred(x, mean)))
        yield pa.RecordBatch.from_arrays([pa.array(range(dim), pa.int32()), _lists(total[0]), _lists(total[1])], ["row", "high", "low"])

    out = np.zeros((dim, dim))
    for i, (high, low) in _merged(rows.select(column).mapInArrow(run, _MERGED), parallelism(rows.sparkSession)).items():
        out[i] = high / n + low / n
    return np.triu(out) + np.triu(out, 1).T


def mean_of(rows: DataFrame, column: str, dim: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The mean of a column of arrays, as double-double."""

    def run(batches):
        total = np.zeros(dim), np.zeros(dim)
        for batch in batches:
            x = _matrix(batch.column(0)).astype(np.float64)
            if len(x):
                total = dd_add(total, dd_sum((x, np.zeros_like(x))))
        yield pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), _lists(total[0][None]), _lists(total[1][None])], ["row", "high", "low"])

    high, low = _merged(rows.select(column).mapInArrow(run, _MERGED), parallelism(rows.sparkSession))[0]
    exact = [dd_number((Fraction(a) + Fraction(b)) / n) for a, b in zip(high.tolist(), low.tolist(), strict=True)]
    return np.array([a for a, _ in exact]), np.array([b for _, b in exact])


def whole_numbers(df: DataFrame, key: str, vector: str, scale: int, shift: int) -> DataFrame:
    """(_key, x array<long>) of the vectors that count."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = df.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("x")).filter(F.col("x").isNotNull() & F.forall("x", finite))
    return rows.select("_key", F.transform("x", lambda c: F.floor(c * scale) + F.lit(shift).cast("long")).alias("x"))


def exact_sums(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows, and the sum of each entry of x: tasks add up 32-bit halves, which can't overflow."""

    def run(batches):
        sizes, n, total = set(), 0, []
        for batch in batches:
            lengths = np.unique(np.asarray(batch.column(0).value_lengths()))
            sizes.update(lengths.tolist())
            if len(sizes) > 1:
                raise ValueError(f"vectors of unequal length: {sorted(sizes)}")
            if len(lengths):
                x = _matrix(batch.column(0))
                sums = [(int(h) << 32) + int(low) for h, low in zip((x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0), strict=True)]
                total, n = [a + b for a, b in zip(total or [0] * len(sums), sums, strict=True)], n + len(x)
        if n:
            yield pa.RecordBatch.from_pydict({"entry": pa.array([-1 - len(total), *range(len(total))], pa.int32()), "n": pa.array([n] * (len(total) + 1)), "sum": pa.array([str(s) for s in [0, *total]])})

    sums = rows.select("x").mapInArrow(run, "entry int, n long, sum string").groupBy("entry").agg(F.sum("n").alias("n"), F.sum(F.col("sum").cast("decimal(38,0)")).alias("s"))
    found = {r["entry"]: (r["n"], int(r["s"])) for r in sums.orderBy("entry").limit(MOST_DIM + 2).collect()}
    lengths = sorted(-1 - e for e in found if e < 0)
    if len(lengths) > 1:
        raise ValueError(f"vectors of unequal length: {lengths}")
    dim = lengths[0] if lengths else 0
    if dim > MOST_DIM:
        raise ValueError(f"vectors of {dim} entries; {MOST_DIM} at the most")
    return found[-1 - dim][0] if lengths else 0, [found[i][1] for i in range(dim)]


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int]:
    """Exact sums over each row of (n x - S)^2: in 64 bits where they surely fit, else in whole numbers of any size."""
    most = n * max(abs(int(x.min())), abs(int(x.max()))) + max(map(abs, sums))
    off = n * (x if most < 1 << 63 else x.astype(object)) - np.array(sums, np.int64 if most < 1 << 63 else object)
    size = max(abs(int(off.min())), abs(int(off.max())))
    if len(sums) * size * size >= 1 << 63:
        off = off.astype(object)
    return (off * off).sum(axis=1).tolist()


def whiten(df: DataFrame, key: str, vector: str, components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """``(key, component, n, deviation, whitened, explained, identity_error)`` of every vector and component.

    ``deviation`` is the exact sum of (n x - S)^2, ``explained`` the component's share of the trace, ``identity_error`` the
    largest absolute entry of the whitened rows' covariance minus the identity, measured over them."""
    spark = df.sparkSession
    scratch = Scratch(spark, "whitening")
    rows = whole_numbers(df, key, vector, scale, shift)
    n, sums = exact_sums(rows)
    kind = rows.schema["_key"].dataType.simpleString()
    if not sums:
        return spark.createDataFrame([], f"_key {kind}, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double").withColumnRenamed("_key", key)
    mean = tuple(map(np.array, zip(*(dd_number(Fraction(s, n)) for s in sums), strict=True)))
    cov = covariance(rows, "x", n, mean)
    values, vectors = eigen(cov)
    top = min(components, len(values))
    values, vectors = values[::-1][:top], vectors[:, ::-1][:, :top]
    trace, rank = float(np.trace(cov)), int((values > len(cov) * np.finfo(float).eps * max(values[0], 0)).sum())
    to_white = vectors[:, :rank] / np.sqrt(values[:rank])

    def project(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                x = _matrix(batch.column(1).slice(at, ROWS))
                white = centred(x.astype(np.float64), mean)[0] @ to_white
                deviation = pa.array([str(v) for v in deviations(x, n, sums)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, ROWS), deviation, _lists(white)], ["_key", "deviation", "white"])

    white = scratch.write(rows.mapInArrow(project, f"_key {kind}, deviation string, white array<double>"))
    error = 0.0
    if rank:
        error = float(np.abs(covariance(white, "white", n, mean_of(white, "white", rank, n)) - np.eye(rank)).max())
    shares = F.array(*[F.lit(float(v / trace) if trace > 0 else 0.0) for v in values])
    each = white.select("_key", "deviation", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(top - 1)), lambda i: F.get("white", i))).alias("k", "whitened"))
    return each.select(
        F.col("_key").alias(key),
        (F.col("k") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        F.col("deviation").cast("decimal(38,0)").alias("deviation"),
        "whitened",
        F.get(shares, F.col("k")).alias("explained"),
        F.lit(error).alias("identity_error"),
    )
