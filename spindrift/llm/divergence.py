"""Source divergence audit (operator 11): how each source's words differ from those of other sources and of its language.

Texts are exploded into terms and counted by (lang, source, term), batch by batch before the shuffle; the counts are written
and all the rest reads them.  A language keeps the terms that ``least`` of its documents have.  Its groups (sources) are joined
with what it keeps, so that terms which a group lacks count 0 there, and every group's share of a term is a whole number of
parts per ``SCALE``.  A join of the shares with themselves on language and term (one number for both) compares groups with
groups, each two once for both directions; divergences are summed and ranked by windows.

All arithmetic is on whole numbers, so results don't depend on the order of rows.  A key of the join of shares is one term of
one language and holds a row for each source; joins with the groups of a language are salted by term, so no task holds a
language or a large source, and the ranking of terms keeps ``top`` rows a task before its shuffle.

Null text, lang and source are empty strings.  A document is a row: repeated rows count again, and keys aren't read.  Texts
without terms add a group only.  A language that keeps nothing has pairs of value 0 and no terms.  A very long text is counted
whole, in one batch.  Equal values rank by their item's UTF-8 bytes.  Extra columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, by_bytes, parallelism, release

#: What separates terms, which are runs of ASCII letters and of characters beyond ASCII.
BETWEEN = r"[\x00-\x40\x5B-\x60\x7B-\x7F]+"
SCALE = 1_000_000_000
BATCH_BYTES = 16 << 20
_GROUP = ("lang", "source")


def _counted(batch: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, count, docs) of one batch's (lang, source, text)."""
    lists = pc.split_pattern_regex(pc.ascii_lower(batch.column(2)), BETWEEN)
    terms, doc = lists.flatten(), pc.list_parent_indices(lists)
    real = pc.not_equal(terms, "")
    terms, doc = terms.filter(real).dictionary_encode(), np.asarray(doc.filter(real), np.int64)
    names = pa.concat_arrays([terms.dictionary, pa.array([None], terms.dictionary.type)])
    lang, source = batch.column(0).dictionary_encode(), batch.column(1).dictionary_encode()
    group = np.asarray(lang.indices, np.int64) * len(source.dictionary) + np.asarray(source.indices, np.int64)
    cells, count = np.unique(doc * len(names) + np.asarray(terms.indices, np.int64), return_counts=True)
    bare = np.setdiff1d(np.arange(batch.num_rows), doc)
    of = np.concatenate([group[cells // len(names)] * len(names) + cells % len(names), group[bare] * len(names) + len(names) - 1])
    found, where = np.unique(of, return_inverse=True)
    total = np.bincount(where, np.concatenate([count, np.zeros(len(bare))]), len(found)).astype(np.int64)
    g = found // len(names)
    columns = [lang.dictionary.take(pa.array(g // len(source.dictionary))), source.dictionary.take(pa.array(g % len(source.dictionary))), names.take(pa.array(found % len(names)))]
    return pa.RecordBatch.from_arrays([*columns, pa.array(total), pa.array(np.bincount(where, minlength=len(found)).astype(np.int64))], ["lang", "source", "term", "count", "docs"])


def term_counts(df: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents of each term of a group; a null term for documents without."""

    def run(batches):
        release()
        for batch in batches:
            for part, _ in by_bytes(batch, 2, BATCH_BYTES):
                yield _counted(part)

    rows = df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang, source, text)])
    rows = rows.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return rows.groupBy(*_GROUP, "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def _salted(rows: DataFrame, groups: DataFrame, on: list[str], parts: int) -> DataFrame:
    """rows with what groups say, joined also on a salt by term, which each group has all values of."""
    salt = F.pmod(F.xxhash64("term"), F.lit(parts)).cast("int")
    salted = groups.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return rows.withColumn("salt", salt).join(salted, [*on, "salt"]).drop("salt")


def _share(count: Column, total: Column, kept: Column) -> Column:
    """Exact for counts of any size: decimals where the product doesn't fit 64 bits."""
    div = lambda a, b: F.call_function("div", a, b)
    wide = div(F.lit(SCALE).cast("decimal(10,0)") * (count + 1).cast("decimal(20,0)"), (total + kept).cast("decimal(20,0)"))
    return 1 + F.when(count < (1 << 62) // SCALE, div(F.lit(SCALE).cast("long") * (count + 1), total + kept)).otherwise(wide)


def _parts(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), q)


def _ranked(df: DataFrame, part: str) -> DataFrame:
    order = Window.partitionBy(*_GROUP).orderBy(F.desc("value"), "item")
    return df.select(*_GROUP, F.lit(part).alias("part"), "item", "value", F.row_number().over(order).alias("rank"))


def audit(df: DataFrame, text: str, lang: str, source: str, least: int = 3, top: int = 200) -> DataFrame:
    """(lang, source, part, item, value, rank): for each group its divergence from each other source of the language (part
    ``pair``), and the ``top`` terms that it has more of than its language (part ``term``)."""
    scratch, n = Scratch(df.sparkSession, "divergence"), parallelism(df.sparkSession)
    counts = scratch.write(term_counts(df, text, lang, source))
    both = Window.partitionBy("lang", "term")
    own = counts.filter("term is not null").withColumn("row", F.monotonically_increasing_id())
    own = own.select(*_GROUP, "term", "count", F.sum("count").over(both).alias("all"), F.sum("docs").over(both).alias("docs"), F.min("row").over(both).alias("number"), (F.col("row") == F.min("row").over(both)).alias("first"))
    own = scratch.write(own.filter(F.col("docs") >= least).drop("docs"))
    totals = own.groupBy(*_GROUP).agg(F.sum("count").alias("total"))
    sizes = own.groupBy("lang").agg(F.count(F.when(F.col("first"), 1)).alias("kept"), F.sum("count").alias("lang_total"))
    groups = counts.select(*_GROUP).distinct().join(sizes, "lang", "left").join(totals, list(_GROUP), "left").na.fill(0)
    groups = scratch.write(groups.withColumn("gid", F.monotonically_increasing_id()))

    # A term below 0 in each language: with it every group has a share even where its language keeps nothing; it is worth 0.
    none = groups.select("lang").distinct().select("lang", F.lit("").alias("term"), (-1 - F.monotonically_increasing_id()).alias("number"))
    kept = own.filter("first").select("lang", "term", "number").unionByName(none)
    dense = _salted(kept, groups.select("lang", "source", "gid", "total", "kept"), ["lang"], n)
    dense = dense.join(own.select("number", "source", "count"), ["number", "source"], "left")
    share = _share(F.coalesce("count", F.lit(0)), F.col("total"), F.col("kept"))
    shares = scratch.write(dense.select("number", "gid", F.when(F.col("number") >= 0, share).alias("p")))
    sums = shares.join(shares.select("number", F.col("gid").alias("other"), F.col("p").alias("q")), "number").filter("gid < other")
    sums = sums.groupBy("gid", "other").agg(*[F.coalesce(F.sum(_parts(F.col(a), F.col(b))), F.lit(0)).alias(n) for n, a, b in (("there", "p", "q"), ("back", "q", "p"))])
    ways = F.array(F.struct("gid", "other", F.col("there").alias("value")), F.struct(F.col("other").alias("gid"), F.col("gid").alias("other"), F.col("back").alias("value")))
    pairs = sums.select(F.explode(ways).alias("w")).select("w.*").join(groups.select("gid", "lang", "source"), "gid")
    pairs = pairs.join(groups.select(F.col("gid").alias("other"), F.col("source").alias("item")), "other")

    terms = _salted(own, groups, list(_GROUP), n).select(*_GROUP, F.col("term").alias("item"), _share(F.col("count"), F.col("total"), F.col("kept")).alias("p"), _share(F.col("all"), F.col("lang_total"), F.col("kept")).alias("q"))
    terms = terms.filter("p > q").withColumn("value", _parts(F.col("p"), F.col("q")))
    return _ranked(pairs, "pair").unionByName(_ranked(terms, "term").filter(F.col("rank") <= top))
