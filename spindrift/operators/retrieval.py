"""Masked top-k retrieval from item vectors or sparse codes, calibrated recall and nDCG, and reports on them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .rounds import Rounds


def unit(df: DataFrame, vector: str) -> DataFrame:
    # The length is an element of a list, so that Spark works it out once for a vector and not for each of its numbers.
    scaled = F.transform(F.array(F.greatest(_size(vector), F.lit(1e-12))), lambda n: F.transform(vector, lambda x: x.cast("double") / n))
    return df.withColumn(vector, F.get(scaled, F.lit(0)))


def profiles(holdout: DataFrame, vectors: DataFrame) -> DataFrame:
    """(user_id, profile, source): the sum of the vectors of each user's source items.  Vectors are added up batch by batch
    where they meet, so that little more than a row for each user is shuffled."""

    def add(table: pa.Table | pa.RecordBatch, users: pa.Array) -> pa.RecordBatch:
        lists = table.column(1)
        dim = len(lists[0])
        flat = lists.combine_chunks().flatten() if isinstance(lists, pa.ChunkedArray) else lists.flatten()
        names = users.dictionary_encode()
        names = names.combine_chunks() if isinstance(names, pa.ChunkedArray) else names
        where, matrix = np.asarray(names.indices), np.asarray(flat, np.float64).reshape(-1, dim)
        order = np.argsort(where, kind="stable")
        total = np.add.reduceat(matrix[order], np.searchsorted(where[order], np.arange(len(names.dictionary))), axis=0)
        ends = pa.array(np.arange(len(total) + 1, dtype=np.int32) * dim)
        return pa.RecordBatch.from_arrays([names.dictionary, pa.ListArray.from_arrays(ends, pa.array(total.ravel()))], ["user_id", "profile"])

    def partial(batches):
        for batch in batches:
            if batch.num_rows:
                yield add(batch, batch.column(0))

    def whole(table: pa.Table) -> pa.Table:
        return pa.Table.from_batches([add(table, table.column(0))])

    kind = "user_id string, profile array<double>"
    source = holdout.select("user_id", F.explode("source").alias("item_id"))
    sums = source.join(vectors.select("item_id", "vector"), "item_id").select("user_id", "vector").mapInArrow(partial, kind)
    return sums.groupBy("user_id").applyInArrow(whole, kind).join(holdout.select("user_id", "source"), "user_id")


def user_blocks(n: int, row_bytes: int, block_bytes: int, cores: int) -> int:
    """Into how many blocks n users go: of about ``block_bytes``, and at least two for each core unless they would be very small."""
    return max(1, -(-n * row_bytes // block_bytes), min(2 * cores, n // 256))


def top_k(holdout: DataFrame, vectors: DataFrame, k: int, block_bytes: int = 32 << 20) -> DataFrame:
    """(user_id, rank, item_id, score): scores relu(x E E') of items outside the source, ties by item id.

    Users are dealt to blocks of about ``block_bytes``, at least two for each core.  A task holds one block with its users' k best so
    far, and all items pass it by falling length in Arrow batches, so that no vector passes the driver and its memory doesn't grow
    with the items.  A user is scored against a batch only if the length of its profile times the largest length there
    reaches the k-th score that it has already.

    Items without a vector are no candidates.  Vectors of unequal length, entries that are null and ids that occur twice are
    errors.  A user whose source has no vectors has no profile and no rows."""
    rounds, context = Rounds(holdout.sparkSession), holdout.sparkSession.sparkContext
    clean, dim = _checked(rounds.write(vectors.select("item_id", "vector").filter("vector is not null")))
    users, n = rounds.counted(profiles(holdout, clean))
    deal = user_blocks(n, dim * 8 + k * 24, block_bytes, context.defaultParallelism)
    users = users.withColumn("ub", F.pmod(F.xxhash64("user_id"), F.lit(deal)).cast("int"))
    items = clean.withColumn("norm", _size("vector")).withColumn("ub", F.explode(F.sequence(F.lit(0), F.lit(deal - 1))))
    return rounds.write(_meet(users, items, k, deal))


def _checked(vectors: DataFrame) -> tuple[DataFrame, int]:
    """Vectors, and their length; an error where they can't be scored."""
    bad = F.count_if(F.exists("vector", lambda x: x.isNull()))
    low, high, nulls = vectors.agg(F.min(F.size("vector")), F.max(F.size("vector")), bad).first()
    if low != high:
        raise ValueError(f"vectors of {low} to {high} numbers")
    if nulls:
        raise ValueError(f"{nulls} vectors hold nulls")
    if not vectors.groupBy("item_id").count().filter("count > 1").isEmpty():
        raise ValueError("item ids occur twice")
    return vectors, low or 1


def _size(vector: str) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x))


def item_blocks(vectors: DataFrame, n: int) -> DataFrame:
    """(item_id, vector, norm, ib): blocks of about equal size by falling length."""
    sized = vectors.withColumn("norm", _size("vector"))
    return sized.repartitionByRange(n, F.desc("norm"), "item_id").withColumn("ib", F.spark_partition_id())


def open_blocks(users: DataFrame, found: DataFrame, longest: list[float], k: int) -> DataFrame:
    """users with ``last``, the last block that can hold an item that belongs to the user's k best; 0 if none but the first."""
    kth = found.groupBy("user_id").agg(F.when(F.count(F.lit(1)) >= k, F.min("score")).alias("kth"))
    need = (F.coalesce("kth", F.lit(0.0)) - 2e-9) / F.greatest(_size("profile"), F.lit(1e-300))  # scores are rounded to 9 places
    longest = F.array(*[F.lit(float(x)) for x in longest])
    return users.join(kth, "user_id", "left").withColumn("last", F.size(F.filter(longest, lambda x: x >= need)) - 1).drop("kth")


class _Best:
    """The k best items so far of a block of users, by falling score and then by id."""

    def __init__(self, users: list[pa.RecordBatch], k: int):
        table = pa.Table.from_batches(users).combine_chunks()
        self.k, self.users, source = k, table["id"].combine_chunks(), table["source"].combine_chunks()
        self.profile = table["vector"].combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1)
        self.length = np.linalg.norm(self.profile, axis=1)
        self.seen, self.owner = source.flatten(), np.repeat(np.arange(table.num_rows), source.value_lengths().fill_null(0))
        self.score, self.items = np.full((table.num_rows, k), -1.0), np.full((table.num_rows, k), None, object)

    def meet(self, batch: pa.RecordBatch) -> None:
        batch = batch.sort_by("id")
        names = batch["id"]
        matrix = batch["vector"].flatten().to_numpy().reshape(len(names), -1)
        longest, labels = np.linalg.norm(matrix, axis=1).max(), names.to_numpy(zero_copy_only=False)
        place = pc.index_in(self.seen, value_set=names).fill_null(-1).to_numpy()
        owner, place = self.owner[place >= 0], place[place >= 0]
        for at in range(0, len(self.users), 512):
            floor = self.score[at : at + 512, -1]
            if not (self.length[at : at + 512] * longest >= floor - 2e-9).any():
                continue  # scores are rounded to 9 places
            scores = self.profile[at : at + 512] @ matrix.T
            low, high = np.searchsorted(owner, (at, at + 512))
            scores[owner[low:high] - at, place[low:high]] = -np.inf
            better = scores > floor[:, None] - 1e-9
            many = (floor <= 0) | (better.sum(1) > self.k)
            if many.any():
                better[many] = self._first(scores[many])
            row, column = np.nonzero(better)
            if len(row):
                self._merge(at, row, labels[column], np.round(np.maximum(scores[row, column], 0), 9))

    def _first(self, scores: np.ndarray) -> np.ndarray:
        """True at the k best of each row; of equal scores the first columns."""
        seen, scores = np.isneginf(scores), np.round(np.maximum(scores, 0), 9)
        scores[seen] = -1
        if scores.shape[1] <= self.k:
            return ~seen
        kth = np.partition(scores, -self.k, axis=1)[:, [-self.k]]
        above, equal = scores > kth, scores == kth
        return (above | (equal & (equal.cumsum(1) <= self.k - above.sum(1, keepdims=True)))) & ~seen

    def _merge(self, at: int, row: np.ndarray, items: np.ndarray, scores: np.ndarray) -> None:
        who, start, size = np.unique(row, return_index=True, return_counts=True)
        shape = len(who), self.k + size.max()
        all_scores, all_items = np.full(shape, -1.0), np.full(shape, None, object)
        all_scores[:, : self.k], all_items[:, : self.k] = self.score[at + who], self.items[at + who]
        to = np.repeat(np.arange(len(who)), size), self.k + np.arange(len(row)) - np.repeat(start, size)
        all_scores[to], all_items[to] = scores, items
        order = np.argsort(-all_scores, axis=1, kind="stable")
        all_scores, all_items = np.take_along_axis(all_scores, order, axis=1), np.take_along_axis(all_items, order, axis=1)
        ties = (all_scores[:, : self.k] == all_scores[:, 1 : self.k + 1]) & (all_scores[:, : self.k] >= 0)
        for r in np.flatnonzero(ties.any(1)):
            n = (all_scores[r] >= 0).sum()
            all_items[r, :n] = [i for _, i in sorted(zip(-all_scores[r, :n], all_items[r, :n], strict=True))]
        self.score[at + who], self.items[at + who] = all_scores[:, : self.k], all_items[:, : self.k]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(self.users), 4096):
            scores = self.score[at : at + 4096]
            row, rank = np.nonzero(scores >= 0)
            columns = self.users.take(pa.array(at + row)), pa.array(rank + 1), pa.array(self.items[at + row, rank], pa.string()), pa.array(scores[row, rank])
            yield pa.RecordBatch.from_arrays([*columns], ["user_id", "rank", "item_id", "score"])


def _meet(users: DataFrame, items: DataFrame, k: int, deal: int = 1) -> DataFrame:
    """(user_id, rank, item_id, score): each user's k best of the items of its block ``ub``, of ``deal`` blocks."""

    def best(batches):
        block, held, state = None, [], None
        for batch in batches:
            key = np.asarray(batch["ub"]) * 2 + np.asarray(batch["kind"])  # users go before the items of their block
            ends = [*(np.flatnonzero(np.diff(key)) + 1).tolist(), len(key)] if len(key) else []
            for low, high in zip([0, *ends], ends, strict=False):
                part, (ub, kind) = batch.slice(low, high - low), divmod(int(key[low]), 2)
                if ub != block:
                    if state:
                        yield from state.rows()
                    block, held, state = ub, [], None
                if kind == 0:
                    held.append(part)
                elif held or state:
                    if state is None:
                        state, held = _Best(held, k), []
                    state.meet(part)
        if state:
            yield from state.rows()

    users = users.select("ub", F.lit(0).alias("kind"), F.col("user_id").alias("id"), F.col("profile").alias("vector"), "source", F.lit(None).cast("double").alias("norm"))
    items = items.select("ub", F.lit(1).alias("kind"), F.col("item_id").alias("id"), F.col("vector").cast("array<double>").alias("vector"), F.lit(None).cast("array<string>").alias("source"), "norm")
    dealt = users.unionByName(items).repartitionById(deal, "ub").sortWithinPartitions("ub", "kind", F.desc("norm"))
    return dealt.mapInArrow(best, "user_id string, rank long, item_id string, score double")


def decoded(codes: DataFrame, decoder: np.ndarray) -> DataFrame:
    """(item_id, vector): codes times the decoder's rows.  Scores of codes z under the kernel K = W W' are the scores of the
    vectors z W, so that sparse codes are ranked in the decoded space by ``top_k(holdout, unit(decoded(codes, W)), k)``."""
    shared = codes.sparkSession.sparkContext.broadcast(np.asarray(decoder, np.float64))

    def run(batches):
        w = shared.value
        for batch in batches:
            if batch.num_rows:
                out = np.asarray(batch.column(1).flatten(), np.float64).reshape(batch.num_rows, -1) @ w
                ends = pa.array(np.arange(len(out) + 1, dtype=np.int32) * out.shape[1])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(ends, pa.array(out.ravel()))], ["item_id", "vector"])

    return codes.select("item_id", "vector").mapInArrow(run, "item_id string, vector array<double>")


def kernel_top_k(holdout: DataFrame, codes: DataFrame, decoder: np.ndarray, k: int) -> DataFrame:
    """``top_k`` of sparse codes by the decoder's kernel, each code scaled to length 1 under it."""
    return top_k(holdout, unit(decoded(codes, decoder), "vector"), k)


def _hits(predictions: DataFrame, holdout: DataFrame) -> DataFrame:
    return predictions.join(holdout.select("user_id", F.explode("target").alias("item_id")), ["user_id", "item_id"])


def _ideal(k: int, n: Column) -> Column:
    return F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), n)), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + F.lit(1)))


def metrics(predictions: DataFrame, holdout: DataFrame, ks: tuple[int, ...] = (20, 50, 100)) -> DataFrame:
    """One row: recall@k and ndcg@k averaged over users with targets, and the number of users.  One pass for all k."""
    hits = _hits(predictions, holdout).groupBy("user_id").agg(
        *[F.count(F.when(F.col("rank") <= k, 1)).alias(f"h{k}") for k in ks],
        *[F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"d{k}") for k in ks],
    )
    per_user = holdout.select("user_id", F.size("target").alias("n")).join(hits, "user_id", "left").na.fill(0)
    of_users = lambda x: F.coalesce(F.avg(F.when(F.col("n") > 0, x)), F.lit(0.0))
    means = [of_users(F.col(f"h{k}") / F.least(F.lit(k), F.col("n"))).alias(f"recall_{k}") for k in ks]
    means += [of_users(F.col(f"d{k}") / _ideal(k, F.greatest("n", F.lit(1)))).alias(f"ndcg_{k}") for k in ks]
    return per_user.agg(*means, F.count(F.when(F.col("n") > 0, 1)).alias("n_users"), F.count(F.lit(1)).alias("n_eval_rows"))


def debug_rows(predictions: DataFrame, holdout: DataFrame, k: int) -> DataFrame:
    """(user_id, n_true, n_hits, first_hit_rank, hit_ranks, dcg, idcg, ndcg) of each user with targets."""
    hits = _hits(predictions.filter(F.col("rank") <= k), holdout).groupBy("user_id").agg(F.sort_array(F.collect_list("rank")).alias("hit_ranks"))
    out = holdout.filter(F.size("target") > 0).select("user_id", F.size("target").cast("long").alias("n_true")).join(hits, "user_id", "left")
    out = out.withColumn("hit_ranks", F.coalesce("hit_ranks", F.array().cast("array<bigint>")))
    dcg = F.aggregate("hit_ranks", F.lit(0.0), lambda s, r: s + 1 / F.log2(r + F.lit(1)))
    out = out.withColumn("dcg", dcg).withColumn("idcg", _ideal(k, F.col("n_true")))
    return out.select("user_id", "n_true", F.size("hit_ranks").cast("long").alias("n_hits"), F.get("hit_ranks", F.lit(0)).alias("first_hit_rank"), "hit_ranks", "dcg", "idcg", (F.col("dcg") / F.col("idcg")).alias("ndcg"))


def percent_drop(base: Column, new: Column) -> Column:
    """How much is lost against base, in per cent; 0 where base is 0."""
    return F.when(base == 0, 0.0).otherwise((base - new) / base * 100)


def size_report(vectors: DataFrame, k: int) -> DataFrame:
    """(form, n_bytes, mb): what the vectors take as dense rows, and as k columns and values each, of four bytes."""
    n = vectors.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dim"))
    forms = F.explode(F.array(F.struct(F.lit("dense").alias("form"), (F.col("n") * F.col("dim") * 4).alias("n_bytes")), F.struct(F.lit("sparse").alias("form"), (F.col("n") * F.least(F.lit(k), F.col("dim")) * 8).alias("n_bytes"))))
    return n.select(forms.alias("f")).select("f.form", F.col("f.n_bytes").cast("long").alias("n_bytes"), (F.col("f.n_bytes") / F.lit(float(1 << 20))).alias("mb"))


def sparsify(vectors: DataFrame, k: int) -> DataFrame:
    """(item_id, cols, vals): the k largest entries by size of each vector, by column."""
    entries = F.transform("vector", lambda x, i: F.struct((-F.abs(x)).alias("a"), i.alias("i"), x.alias("x")))
    top = F.array_sort(F.transform(F.slice(F.array_sort(entries), 1, k), lambda e: F.struct(e["i"].alias("i"), e["x"].alias("x"))))
    return vectors.select("item_id", top.alias("t")).select("item_id", F.transform("t", lambda e: e["i"]).alias("cols"), F.transform("t", lambda e: e["x"]).alias("vals"))
