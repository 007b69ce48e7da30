"""Language-model scores by a probabilistic suffix tree (operator 1).

Symbols are words (``[^\\x20\\x09-\\x0D]+``, A-Z lower-cased) and an end after each text.  Nodes are contexts of one
word or more.  The root predicts by the smoothed counts of single tokens, P(w) = (c(w) + 1/2) / (N + (V + 1) / 2).  A node s below
predicts by

    P(w | s) = (c(s w) + (r(s) + b) P(w | parent of s)) / (c(s) + b)

where c(s w) counts as 0 when it is 1, and r(s) is the number of occurrences of s whose next token followed s only once:
what was seen once is left to the shorter context.  A context is kept if it was seen ``least`` times or more and its
predictions diverge from those of its suffix: over its occurrences in training, each left out of its own count, the
log-likelihood must gain more than ``gain`` against the better of its suffixes' predictions.  A token is scored by the
longest suffix of its past that is a node; a node's parent is the longest kept suffix of it.  Contexts grow by a word at a time
up to ``depth`` words or, if it is None, until no longer one can be kept: the gain of all extensions of a context is no more
than what its own and its suffixes' predictions leave, the sum of -log10 of the best of them.

How it runs (see ``packed.py``): words are hashed once, into blocks of texts.  A first round counts words and pairs.  A
second gathers what all occurrences say about contexts of one word, and counts those n-grams of three and four words whose
pairs were all seen often enough; a third does the same for contexts of two words and n-grams of five and six, and so on, the
last one for all contexts that are left.  The last pass scores.

Null texts are empty: one end.  Rows with a null key aren't learnt from, as ``train`` is null for them.  Repeated rows are
scored and learnt from as often as they come.  Extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, mix, parallelism, release
from .packed import ANSWER, ASK, BLOCK_BYTES, MOST_BUCKETS, SAID, TOLD, Block, answer, answered, blocks_of, dealt, grouped, level_of, packed_texts, short, table_of, tally, tell, unpack, unpack_keys

END = np.uint64(0xE7D0_0000_0000_0001)
SAID_BOUNDS = f"{SAID}, bounds binary"
#: Levels of decisions on contexts are their lengths and this.
KEPT = 1 << 16
_K2, _K3 = np.uint64(0x9FB21C651E98DF25), np.uint64(0xD1342543DE82EF95)


# ---- texts as n-grams ---------------------------------------------------------------------------------------------


class Walk:
    """A block's tokens, ends included, and what it asks and hears about the n-grams that end at each, level by level.

    ``counts`` has, by level, each token's c of the n-gram that ends there (0 where there is none or it wasn't told), and
    ``places`` where that n-gram stands among those told (or -1), which ``told`` has as keys and counts.
    """

    def __init__(self, block: Block, buckets: int, least: int):
        self.buckets, self.least = buckets, least
        size = block.sizes + 1
        ends = np.cumsum(size)
        self.vocabulary = np.append(block.vocabulary, END)
        self.tokens = np.full(int(ends[-1]) if len(ends) else 0, len(block.vocabulary), np.uint32)
        inner = np.ones(len(self.tokens), bool)
        inner[ends - 1] = False
        self.tokens[inner] = block.tokens
        self.doc = np.repeat(np.arange(len(size), dtype=np.int32), size)
        self.place = np.arange(len(self.tokens), dtype=np.int32) - np.repeat((ends - size).astype(np.int32), size)
        self.size, self.learnt = size, block.extra.astype(bool)[self.doc]
        self.words, self.whole, self.hashed, self.counts, self.places, self.told = None, None, 1, [], [], []

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Where the n-grams of level n end that are asked for, and their keys: all pairs, and those longer n-grams that can
        have been seen twice and whose context can be kept."""
        asked = self.place >= n - 1
        if n > 2:  # levels are asked for two at a time: what was known then is the level before the first of the two
            known = self.counts[n - 2 - (n % 2 == 0)]
            asked &= known >= 2
            often = known >= self.least
            for k in range(1, 2 + (n % 2 == 0)):
                asked[k:] &= often[:-k]
        at = np.flatnonzero(asked)
        if self.hashed < n:  # in place: what later levels read was hashed at every level before
            if n == 2:
                self.words = self.vocabulary[self.tokens]
                self.whole = self.words.copy()
                self.whole[1:] = mix(self.words[:-1] * _K2 + self.words[1:])
            else:
                self.whole[at] = mix(self.whole[at - 1] * _K3 + self.words[at])
            self.hashed = n
        return at, short(self.whole[at], self.buckets)

    def wanted(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """The distinct n-grams of level n to ask for, all words at level 1, and how often training texts of the block have each."""
        if n == 1:
            return self.vocabulary, np.bincount(self.tokens, self.learnt, len(self.vocabulary)).astype(np.uint32)
        at, keys = self.grams(n)
        return tally(keys, self.learnt[at])

    def hear(self, answers: pa.Table) -> None:
        """Takes the answers to what was asked for at the next level."""
        n = len(self.counts) + 1
        if n == 1:
            keys, where = self.vocabulary, self.tokens
        else:
            at, keys = self.grams(n)
            keys, where = grouped(keys)
        values = answered(n, keys, self.buckets, level_of(answers, n))
        there = values > 0
        place = np.where(there, np.cumsum(there, dtype=np.int32) - np.int32(1), np.int32(-1))[where]
        keys, values = keys[there], values[there]
        if n > 1:
            found = place >= 0
            rows, found = at[found], place[found]
            seen = (self.counts[-1][rows] > 1) & (self.counts[-1][rows - 1] > 1)
            if not seen.all():
                rows, found = rows[seen], found[seen]
            place, count = np.full(len(self.tokens), -1, np.int32), np.zeros(len(self.tokens), np.uint32)
            place[rows], count[rows] = found, values[found]
        else:
            count = np.where(place >= 0, values[place], 0).astype(np.uint32) if len(values) else np.zeros(len(place), np.uint32)
        self.told.append((keys, values))
        self.counts.append(count)
        self.places.append(place)

    def contexts(self, n: int) -> np.ndarray:
        """Which n-grams told may be contexts."""
        return self.told[n - 1][1] >= self.least


# ---- the rounds ---------------------------------------------------------------------------------------------------


def _ask(buckets: int):
    """A block's distinct words and pairs with its counts in training."""

    def run(batches):
        release()
        for batch in batches:
            for block in blocks_of(batch):
                walk = Walk(block, buckets, 0)
                rows = dealt(1, block.number, buckets, *walk.wanted(1))
                yield from table_of(ASK, rows + dealt(2, block.number, buckets, *walk.wanted(2))).to_batches()

    return run


def _evidence(walk: Walk, n: int, z: float, prior: float, bounds: bool) -> list[np.ndarray]:
    """What a block's training occurrences say about each n-gram told as a context: how many were followed by a token that
    follows only once, the gain so far, and with ``bounds`` what longer contexts can gain at most."""
    counts = walk.counts
    used = (walk.place >= n) & walk.learnt
    used[1:] &= counts[n - 1][:-1] >= walk.least
    at = np.flatnonzero(used)
    c, f = counts[n - 1][at - 1].astype(np.float64), counts[n][at].astype(np.float64)
    better = (counts[0][at] + 0.5) / z
    for k in range(1, n):
        better = np.maximum(better, counts[k][at] / (counts[k - 1][at - 1] + prior))
    twice = f >= 2
    said = [~twice, np.where(twice, np.log10(np.maximum(f - 1, 1) / better), 0) - np.log10(c - 1 + prior)]
    if bounds:
        said.append(np.where(twice, np.maximum(0, -np.log10(np.maximum(better, f / (c + prior)))), 0))
    context = walk.places[n - 1][at - 1]
    return [np.bincount(context, x, len(walk.told[n - 1][0])) for x in said]


def _say(steps: range, ask: range, heard: int, bounds: bool, buckets: int, z: float, least: int, prior: float):
    """Evidence on contexts of ``steps`` words, and requests for n-grams of ``ask`` tokens, when levels up to ``heard`` are
    answered."""
    kind = SAID_BOUNDS if bounds else SAID

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        if not docs.num_rows:
            return table_of(kind, [])
        block, rows = next(blocks_of(docs)), []
        walk = Walk(block, buckets, least)
        for _ in range(heard):
            walk.hear(answers)
        for n in steps:
            there = walk.contexts(n)
            once, *other = (x[there] for x in _evidence(walk, n, z, prior, bounds))
            rows += dealt(n, block.number, buckets, walk.told[n - 1][0][there], once.astype(np.uint32), *(x.astype(np.float32) for x in other))
        for n in ask:
            rows += [(*row, None, *[None] * bounds) for row in dealt(n, block.number, buckets, *walk.wanted(n))]
        return table_of(kind, rows)

    return run


def _answer(steps: range, least_gain: float, prior: float):
    """Decides on contexts of ``steps`` words, answers requests; decisions have levels above KEPT."""

    def run(table: pa.Table) -> pa.Table:
        release()
        if table["level"][0].as_py() in steps:
            return _keep(table, least_gain, prior)
        return tell(table).select(["level", "bucket", "block", "told", "counts"])

    return run


def _keep(table: pa.Table, least_gain: float, prior: float) -> pa.Table:
    """The contexts of a bucket that diverge enough, for each block that has them, with r(s) + 1.  Occurrences that rare
    tokens follow are predicted with a share of r(s) + b - 1, known only here; all else is in the blocks' sums.  A row of
    block -1 says that longer contexts can be kept."""
    level, bucket = table["level"][0].as_py() + KEPT, table["bucket"][0].as_py()
    said = [unpack_keys(b) for b in table["keys"].to_pylist()]
    keys, where = grouped(np.concatenate(said))
    once = np.bincount(where, np.concatenate([unpack(b, np.uint32) for b in table["counts"].to_pylist()]), len(keys))
    gain = np.bincount(where, np.concatenate([unpack(b, np.float32) for b in table["gains"].to_pylist()]), len(keys))
    gain += once * np.log10(np.maximum(once - 1 + prior, prior))
    kept, once = gain > least_gain, once.astype(np.uint32) + np.uint32(1)
    rows, at = [], 0
    if "bounds" in table.column_names:
        bound = np.bincount(where, np.concatenate([unpack(b, np.float32) for b in table["bounds"].to_pylist()]), len(keys))
        if (bound > least_gain).any():
            rows.append(answer(level, bucket, -1, kept[:0], once[:0]))
    for block, own in zip(table["block"].to_pylist(), said, strict=True):
        index = where[at : at + len(own)]
        at += len(own)
        if kept[index].any():
            rows.append(answer(level, bucket, block, kept[index], once[index]))
    return table_of(ANSWER, rows)


def _score(depth: int, buckets: int, z: float, least: int, prior: float, key_type: pa.DataType):
    """Scores of a block's texts.  Levels of the answers up to KEPT are counts, those above the kept contexts."""

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        names = ["_key", "_train", "n_tokens", "n_known", "base_score", "score"]
        kinds = [key_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64()]
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        block = next(blocks_of(docs))
        walk = Walk(block, buckets, least)
        for _ in range(depth + 1 if depth else 1):
            walk.hear(answers)
        c = walk.counts
        base = (c[0] + 0.5) / z
        p = base.copy()
        for n in range(1, depth + 1):
            there = np.flatnonzero(walk.contexts(n))
            rest = np.zeros(len(walk.told[n - 1][0]), np.int64)  # r(s) + 1 of kept contexts
            rest[there] = answered(n, walk.told[n - 1][0][there], buckets, level_of(answers, n + KEPT))
            at = np.flatnonzero((walk.places[n - 1][:-1] >= 0) & (walk.place[1:] >= n)) + 1
            rest = rest[walk.places[n - 1][at - 1]]
            at, rest = at[rest > 0], rest[rest > 0]
            p[at] = (c[n][at] + (rest - 1 + prior) * p[at]) / (c[n - 1][at - 1] + prior)
        known, plain, score = (np.bincount(walk.doc, x, len(walk.size)) for x in (c[0] > 0, np.log10(base), np.log10(p)))
        columns = [block.keys, *map(pa.array, (block.extra.astype(bool), walk.size, known.astype(np.int64), plain, score))]
        return pa.table([c.cast(k) for c, k in zip(columns, kinds, strict=True)], names=names)

    return run


def score_texts(df: DataFrame, key: str, text: str, train: Column, least: int = 2, gain: float = 1.0, prior: float = 0.5, block_bytes: int = BLOCK_BYTES, depth: int | None = 5) -> DataFrame:
    """``(key, train, n_tokens, n_known, train_tokens, base_score, score)`` of every row.

    ``block_bytes`` bounds the texts that a task works on at a time; it doesn't change the scores but for rounding.
    ``depth`` is the most words of a context.  With None there is no bound: a run of one repeated word then costs a round for every
    two of its words.
    """
    spark = df.sparkSession
    buckets = min(parallelism(spark), MOST_BUCKETS)
    scratch = Scratch(spark, "suffix-tree")
    rows = df.select(F.col(key).alias("_key"), F.coalesce(train, F.lit(False)).cast("int").cast("long").alias("_extra"), F.col(text).alias("_text"))
    kind = rows.schema["_key"].dataType
    docs = packed_texts(rows, scratch, block_bytes)
    told = scratch.write(docs.mapInArrow(_ask(buckets), ASK).groupBy("level", "bucket").applyInArrow(tell, TOLD))
    n, v = told.agg(F.coalesce(F.sum("n_total"), F.lit(0)), F.coalesce(F.sum("n_distinct"), F.lit(0))).first()
    z = n + 0.5 * (v + 1)
    answers, step, heard = told.drop("n_distinct", "n_total"), 0, 2
    more = depth != 0
    while more:
        ask = range(heard + 1, heard + 3 if depth is None else min(heard + 2, depth + 1) + 1)
        # With a bound, evidence on the longest contexts waits a round while more is asked for, so that no round shuffles much more than another.
        steps = range(step + 1, heard if depth is None else min(heard - (heard > 2 and len(ask) > 0), depth + 1))
        counted = answers.filter(F.col("level") < KEPT).groupBy("block")
        said = docs.groupBy("block").cogroup(counted).applyInArrow(_say(steps, ask, heard, depth is None, buckets, z, least, prior), SAID if depth else SAID_BOUNDS)
        new = scratch.write(said.groupBy("level", "bucket").applyInArrow(_answer(steps, gain, prior), ANSWER))
        answers = answers.unionByName(new.filter("block >= 0"))
        step, heard = steps[-1], ask[-1] if ask else heard
        more = step < depth if depth else not new.filter((F.col("block") < 0) & (F.col("level") == KEPT + step)).isEmpty()

    schema = f"_key {kind.simpleString()}, _train boolean, n_tokens long, n_known long, base_score double, score double"
    out = docs.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_score(step, buckets, z, least, prior, to_arrow_type(kind)), schema)
    return out.select(F.col("_key").alias(key), F.col("_train").alias("train"), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
