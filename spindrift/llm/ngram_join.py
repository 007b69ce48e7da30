"""N-gram Jaccard self-join by a token-group matrix (operator 3).

A document's set is its distinct n-word shingles, as 64-bit hashes.  Documents of equal sets form a class, of which only
the smallest key goes on.  Two sets of Jaccard similarity t or more share a token among the first
|x| - ceil(t |x|) + 1 of either in any common order of tokens (its prefix).  Tokens are ordered by rising document frequency,
which is counted over all documents (``packed.py``); prefix tokens that no other document has can't link and are left out.

1. Every class tries to join the smallest class that it shares a prefix token with, so that copies of one document hang
   together without being paired with each other.  Where more than ``block`` classes share a token, those outside the
   component of one drawn from them try to join it, with another draw for each token and round, as long as a quarter of those
   that try find a link: large groups of near copies that don't all resemble the smallest one hang together too.  Connected
   classes are similar: they make up the groups, split into blocks of ``block`` members.  Classes without a link yet gather in
   bins of similar ones, which are split likewise, so that many classes that share a token but don't link aren't all paired.
2. The matrix has a row per prefix token and block.  A class is a query for the blocks of *other* groups that it shares a
   prefix token with and that can still overlap enough from that token on: of a pair that links, all common tokens stand at
   or after the first one in either order, which bounds the overlap by what is left of either set.  Each block stores the
   union of its members' tokens; if the query's overlap with that union is below the least overlap that any member could
   need, the block stays closed.  Only opened blocks gather their members' sets, a megabyte to a row, and each of these rows
   is searched until a member links; in a bin's, until one of each part that is connected inside the row has been tried.
   A bin's classes ask for the blocks of their own bin too.
3. The links of both steps are connected to components, of those between two groups one.

No link between groups is lost: any such link shares a prefix token, and its block is opened unless the bound rules the link
out.  Classes are named by 128 bits of their sets; a row is told from others of its key by a hash of its text.  Texts with
fewer words than n are one shingle; texts without words (and null texts) have an empty set and link with nothing.  Repeated
rows of one key give as many rows; rows of one key with different texts are linked each by its own text.  A row with a null
key links like any other, but names a component only if all its rows have null keys; then the component is null.  Extra
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import Scratch, by_bytes, mix, parallelism, release, word_hashes
from .packed import ASK, MOST_BUCKETS, TOLD, Block, Lookup, answered, blocks_of, dealt, packed_texts, short, table_of, tally, tell

#: A class tries so many others in a round at the most.
TRIES = 8
MARKS = "_tid long, n int, node binary, prefix array<long>, places array<int>"


def shingles(words: np.ndarray, count: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each of fewer than 2^16 texts, sorted within the text; and the text that each belongs to."""
    doc = np.repeat(np.arange(len(count), dtype=np.uint16), count)
    if not len(words):
        return np.zeros(0, np.uint64), doc
    place = np.arange(len(words)) - np.repeat(np.cumsum(count) - count, count)
    left, h = np.repeat(count, count) - place, words.copy()
    for k in range(1, n):
        inside = np.flatnonzero(left > k)
        h[inside] = mix(h[inside] * np.uint64(0x9FB21C651E98DF25) + words[inside + k])
    keep = (left >= n) | (place == 0)
    h, doc = h[keep], doc[keep]
    order = np.argsort(h)
    order = order[np.argsort(doc[order], kind="stable")]
    h, doc = h[order], doc[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    return h[new], doc[new]


def _wanted(block: Block, n: int, buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """A block's distinct shingles with the number of its documents that have them."""
    own = np.concatenate([short(shingles(block.words(a, b), block.sizes[a:b], n)[0], buckets) for a, b in block.slices()])
    return tally(own, np.ones(len(own), bool))


def _ask(n: int, buckets: int):
    """Requests for the document frequencies of a block's shingles."""

    def run(batches):
        release()
        for batch in batches:
            for block in blocks_of(batch):
                yield from table_of(ASK, dealt(max(n, 2), block.number, buckets, *_wanted(block, n, buckets))).to_batches()

    return run


def _mark(n: int, percent: int, buckets: int, kind: pa.DataType):
    """Set size, digest and those prefix tokens that another document has too, with their places in the order."""
    names, kinds = ["_key", "_tid", "n", "node", "prefix", "places"], [kind, pa.int64(), pa.int32(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        release()
        if not docs.num_rows:
            return pa.table([pa.array([], k) for k in kinds], names=names)
        block = next(blocks_of(docs))
        keys, _ = _wanted(block, n, buckets)
        seen = answered(max(n, 2), keys, buckets, answers)
        told = Lookup(keys[seen > 0], seen[seen > 0])
        parts = [pa.table([block.keys.slice(a, b - a).cast(kind), pa.array(block.extra[a:b]), *part(block, a, b, told)], names=names) for a, b in block.slices()]
        return pa.concat_tables(parts)

    def part(block, a: int, b: int, told) -> list[pa.Array]:
        h, doc = shingles(block.words(a, b), block.sizes[a:b], n)
        size = np.bincount(doc, minlength=b - a).astype(np.int64)
        starts = np.cumsum(size) - size
        digest = np.zeros((b - a, 2), np.uint64)
        for k, salt in enumerate((0x243F6A8885A308D3, 0x13198A2E03707344)):
            if len(h):
                digest[size > 0, k] = np.add.reduceat(mix(h ^ np.uint64(salt)), starts[size > 0])
        digest[:, 0] = mix(digest[:, 0] + size.astype(np.uint64))
        seen = np.ones(len(h), np.uint64)
        rows, places = told.find(short(h, buckets))
        seen[rows] = told.values[0][places]
        order = np.argsort(doc.astype(np.uint64) << np.uint64(32) | seen, kind="stable")  # and by hash, as they were
        place = np.arange(len(h)) - starts[doc]  # order keeps documents together
        used = (place < (size - -(-percent * size // 100) + 1)[doc]) & (seen[order] > 1)
        chosen = order[used]
        ends = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[chosen], minlength=b - a))]), pa.int32())
        lists = [pa.ListArray.from_arrays(ends, pa.array(v)) for v in (h[chosen].view(np.int64), place[used].astype(np.int32))]
        return [pa.array(size.astype(np.int32)), pa.array([d.tobytes() for d in digest], pa.binary()), *lists]

    return run


def _marks(rows: DataFrame, scratch: Scratch, n: int, percent: int) -> DataFrame:
    """(_key, _tid, n, node, prefix, places) of every row, the prefixes by rising document frequency."""
    buckets = min(parallelism(rows.sparkSession), MOST_BUCKETS)
    docs = packed_texts(rows.select("_key", F.col("_tid").alias("_extra"), "_text"), scratch)
    told = scratch.write(docs.mapInArrow(_ask(n, buckets), ASK).groupBy("level", "bucket").applyInArrow(tell, TOLD).drop("n_distinct", "n_total"))
    kind = rows.schema["_key"].dataType
    made = docs.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(_mark(n, percent, buckets, to_arrow_type(kind)), f"_key {kind.simpleString()}, {MARKS}")
    out = scratch.write(made)
    scratch.drop(docs, told)
    return out


def _sets(rows: DataFrame, n: int) -> DataFrame:
    """(node, tokens): the set of each row (node, _text) as sorted 64-bit values."""

    def sets(batches):
        release()
        for batch in batches:
            for part, _ in by_bytes(batch, 1, 1 << 21, 1024):
                words, at = word_hashes(part.column(1))
                h, doc = shingles(words, np.diff(at), n)
                ends = np.searchsorted(doc, np.arange(part.num_rows + 1))
                blobs = [h[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(blobs, pa.binary())], ["node", "tokens"])

    return rows.mapInArrow(sets, "node binary, tokens binary")


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    common = np.intersect1d(a, b, assume_unique=True).size
    return 100 * common >= percent * (a.size + b.size - common)


def _verify(pairs: DataFrame, percent: int) -> DataFrame:
    """Of rows (a, b, a_tokens, b_tokens) those nodes whose sets link."""

    def check(batches):
        for batch in batches:
            ok = [_linked(np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return pairs.select("a", "b", "a_tokens", "b_tokens").mapInArrow(check, "a binary, b binary")


def _tries(busy: DataFrame, groups: DataFrame, turn: int, fits: Column) -> DataFrame:
    """Pairs (a, b) to be tried: classes with one drawn for each of their tokens, in another component; up to TRIES a class."""
    rows = busy.join(groups.withColumnRenamed("v", "node"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    drawn = F.struct(F.xxhash64("node", "token", F.lit(turn)).alias("h"), "node", "n", "reach", "label")
    leads = rows.groupBy("token").agg(F.min(drawn).alias("lead"), F.min("label").alias("x"), F.max("label").alias("y")).filter("x <> y")
    pairs = rows.join(leads, "token").filter((F.col("label") != F.col("lead.label")) & fits)
    order = F.struct(F.xxhash64("node", "lead.node", F.lit(turn)).alias("h"), F.col("lead.node").alias("b"))
    some = F.slice(F.array_sort(F.collect_set(order)), 1, TRIES)
    return pairs.groupBy("node").agg(some.alias("some")).select(F.col("node").alias("a"), F.explode("some.b").alias("b"))


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label) for every node of the edges (a, b): the smallest node that it is connected with.

    Every round takes the smallest label among a node's neighbours and then the label's own label, until nothing changes.
    """
    both = scratch.write(edges.select(F.col("a").alias("v"), F.col("b").alias("u")).unionByName(edges.select(F.col("b").alias("v"), F.col("a").alias("u"))).distinct())
    labels = scratch.write(both.groupBy("v").agg(F.min("u").alias("u")).select("v", F.least("v", "u").alias("label")))
    while True:
        seen = both.join(labels.select(F.col("v").alias("u"), "label"), "u").groupBy("v").agg(F.min("label").alias("near"))
        lower = scratch.write(labels.join(seen, "v").select("v", F.least("label", "near").alias("label"), F.col("label").alias("old")))
        jump = lower.select(F.col("v").alias("label"), F.col("label").alias("far"))
        following = scratch.write(lower.join(jump, "label").select("v", F.col("far").alias("label"), "old"))
        scratch.drop(labels, lower)
        done = following.filter("label <> old").isEmpty()
        labels = following.drop("old")
        labels._scratch_path = following._scratch_path
        if done:
            scratch.drop(both)
            return labels


def _merged(groups: DataFrame, links: DataFrame, scratch: Scratch) -> DataFrame:
    """(v, label) after more links (a, b): components of the components that they connect, in which a link is one of many no longer."""
    ends = [groups.select(F.col("v").alias(v), F.col("label").alias(name)) for v, name in (("a", "x"), ("b", "y"))]
    edges = links.join(ends[0], "a", "left").join(ends[1], "b", "left").select(F.coalesce("x", "a").alias("a"), F.coalesce("y", "b").alias("b"))
    joined = components(edges.filter("a <> b").distinct(), scratch)
    kept = groups.join(joined.select(F.col("v").alias("label"), F.col("label").alias("to")), "label", "left").select("v", F.coalesce("to", "label").alias("label"))
    return scratch.write(kept.unionByName(joined.join(groups, "v", "left_anti")))


def jaccard_components(df: DataFrame, key: str, text: str, n: int = 3, percent: int = 90, block: int = 64) -> DataFrame:
    """``(key, n_shingles, component_id, text_id)`` of every row; the component's id is its smallest key, ``text_id`` the xxhash64 of
    the row's text, by which rows of one key can be told apart."""
    spark = df.sparkSession
    rows = df.select(F.col(key).alias("_key"), F.xxhash64(F.col(text)).alias("_tid"), F.col(text).alias("_text"))
    scratch = Scratch(spark, "jaccard")
    marks = _marks(rows, scratch, n, percent)
    # A class has the smallest key of its rows, nulls last, and the text that goes with it.
    first = F.min(F.struct(F.col("_key").isNull().alias("no_key"), "_key", "_tid", "n", "prefix", "places")).alias("m")
    classes = scratch.write(marks.filter("n > 0").groupBy("node").agg(first).select("node", "m._key", "m._tid", "m.n", "m.prefix", "m.places"))

    # Tokens that two classes or more have in their prefixes, with the smallest of these classes.
    # reach: a set of up to reach / percent tokens can link with the class if this is their first common token.
    reach = 100 * F.col("n") - (100 + percent) * F.col("p.places")
    postings = classes.select("node", "n", F.explode(F.arrays_zip("prefix", "places")).alias("p")).select("node", "n", F.col("p.prefix").alias("token"), reach.alias("reach"))
    shared = postings.groupBy("token").agg(F.min(F.struct("node", "n", "reach")).alias("lead"), F.count(F.lit(1)).alias("c")).filter("c > 1")
    shared = scratch.write(postings.join(shared, "token"))
    fits = (F.col("reach") >= F.col("lead.n") * percent) & (F.col("lead.reach") >= F.col("n") * percent)
    pairs = scratch.write(shared.filter((F.col("node") != F.col("lead.node")) & fits).select(F.col("node").alias("a"), F.col("lead.node").alias("b")).distinct())

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = classes.join(nodes.distinct(), "node", "left_semi").select("node", F.col("_key").alias("k"), F.col("_tid").alias("t"))
        found = rows.join(wanted, F.col("_key").eqNullSafe(F.col("k")) & (F.col("_tid") == F.col("t"))).select("node", "_text")
        return scratch.write(_sets(found.dropDuplicates(["node"]), n))

    own = lambda sets, name, tokens: sets.select(F.col("node").alias(name), F.col("tokens").alias(tokens))
    busy = scratch.write(shared.filter(F.col("c") > block).select("token", "node", "n", "reach"))
    sets = sets_of(pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).unionByName(busy.select("node")))
    linked = lambda pairs: scratch.write(_verify(pairs.join(own(sets, "a", "a_tokens"), "a").join(own(sets, "b", "b_tokens"), "b"), percent))
    groups = components(linked(pairs), scratch)
    for turn in itertools.count():
        tried = scratch.write(_tries(busy, groups, turn, fits))
        found = linked(tried)
        asked, told = (t.agg(F.countDistinct("a")).first()[0] for t in (tried, found))
        scratch.drop(tried)
        if told:
            groups = _merged(groups, found, scratch)
        if 4 * told < max(asked, 1):
            break
    scratch.drop(sets, busy)

    # Queries and blocks of different groups that meet in a prefix token.  Of two groups the one with fewer members asks.
    # Classes without a link gather in bins, by the smallest class that they share a prefix token with.
    near = shared.groupBy("node", "n").agg(F.min("lead.node").alias("near"))
    members = near.join(groups.withColumnRenamed("v", "node"), "node", "left").select("node", "n", F.coalesce("label", F.concat("near", F.lit(bytes(1)))).alias("grp"))
    members = members.join(members.groupBy("grp").agg(F.count(F.lit(1)).alias("members")), "grp")
    lots = F.greatest(F.lit(1), F.ceil(F.col("members") / block)).cast("int")
    members = scratch.write(members.withColumn("lot", F.pmod(F.xxhash64("node"), lots).cast("int")))
    rated = shared.select("token", "node", "reach").join(members, "node")
    mixed = rated.groupBy("token").agg(F.min("grp").alias("x"), F.max("grp").alias("y")).filter((F.col("x") != F.col("y")) | _bin("x")).select("token")
    rated = scratch.write(rated.join(mixed, "token"))
    blocks = rated.groupBy("token", "grp", "lot", "members").agg(F.min("n").alias("low"), F.max("reach").alias("most"))
    blocks = blocks.select("token", F.col("grp").alias("g"), F.col("lot").alias("g_lot"), F.col("members").alias("g_members"), "low", "most")
    asks = (F.struct("members", "grp") < F.struct(F.col("g_members").alias("members"), F.col("g").alias("grp"))) | (_bin("g") & (F.col("grp") == F.col("g")) & (F.col("lot") <= F.col("g_lot")))
    asks &= (F.col("most") >= F.col("n") * percent) & (F.col("reach") >= F.col("low") * percent)
    queries = scratch.write(rated.join(blocks, "token").filter(asks).select("node", "grp", "g", "g_lot").distinct())

    wanted = queries.select(F.col("g").alias("grp"), F.col("g_lot").alias("lot")).distinct()
    inside = scratch.write(members.join(wanted, ["grp", "lot"]).select("grp", "lot", "node"))
    sets = sets_of(inside.select("node").unionByName(queries.select("node")))
    held = inside.join(sets, "node").withColumn("bucket", F.pmod(F.xxhash64("grp", "lot"), F.lit(4 * parallelism(spark))))
    unions = scratch.write(held.groupBy("bucket").applyInArrow(_unions, UNIONS))
    asks_of = lambda asked, blocks, *columns: asked.join(own(sets, "node", "a_tokens"), "node").join(blocks.select(F.col("grp").alias("g"), F.col("lot").alias("g_lot"), *columns), ["g", "g_lot"])
    asked = asks_of(queries, unions, "low", "tokens").select("node", F.col("grp").alias("own"), "g", "g_lot", "a_tokens", "low", "tokens")
    opened = scratch.write(asked.mapInArrow(_bound(percent), "node binary, own binary, g binary, g_lot int"))
    within = held.join(opened.select(F.col("g").alias("grp"), F.col("g_lot").alias("lot")).distinct(), ["grp", "lot"], "left_semi")
    pieces = scratch.write(within.groupBy("bucket").applyInArrow(_pieces(percent), PIECES))
    met = asks_of(opened, pieces, "members", "sets", "parts").select("node", "own", "g", "a_tokens", "members", "sets", "parts").mapInArrow(_compare(percent), "a binary, b binary, own binary, g binary")
    # A group is connected: one link with it is enough.
    ends = [F.when(_bin(g), F.col(v)).otherwise(F.col(g)) for g, v in (("own", "a"), ("g", "b"))]
    met = met.groupBy(ends[0].alias("x"), ends[1].alias("y")).agg(F.min(F.struct("a", "b")).alias("l")).select("l.a", "l.b")
    tied = pieces.select(F.explode(F.transform("members", lambda m, i: F.struct(m.alias("a"), F.element_at("members", F.element_at("parts", i + 1) + 1).alias("b")))).alias("l"), "grp")
    more = scratch.write(met.unionByName(tied.filter(_bin("grp") & (F.col("l.a") != F.col("l.b"))).select("l.a", "l.b")))
    scratch.drop(shared, pairs, sets, rated, queries, inside, unions, opened, pieces)

    final = groups if more.isEmpty() else _merged(groups, more, scratch)
    labelled = classes.join(final.withColumnRenamed("v", "node"), "node").select("node", "_key", "label")
    named = labelled.groupBy("label").agg(F.min("_key").alias("component"))
    labelled = labelled.join(named, "label").select("node", "component")
    own_class = classes.select("node", F.col("_key").alias("own"))
    out = marks.select("_key", "_tid", "node", "n").join(own_class, "node", "left").join(labelled, "node", "left")
    component = F.when(F.col("n") == 0, F.col("_key")).otherwise(F.coalesce("component", "own"))
    return out.select(F.col("_key").alias(key), F.col("n").cast("long").alias("n_shingles"), component.alias("component_id"), F.col("_tid").alias("text_id"))


UNIONS = "grp binary, lot int, low int, tokens binary"
PIECES = "grp binary, lot int, members array<binary>, sets array<binary>, parts array<int>"
PIECE_BYTES, NODE_BYTES = 1 << 20, 16


def _bin(grp: str) -> Column:
    """Whether a name is a bin's: one byte longer than a class's."""
    return F.length(grp) > NODE_BYTES


def _by_block(table: pa.Table):
    """The rows of each block of a table."""
    at: dict[tuple, list[int]] = {}
    for i, k in enumerate(zip(table["grp"].to_pylist(), table["lot"].to_pylist(), strict=True)):
        at.setdefault(k, []).append(i)
    return at.items()


def _unions(table: pa.Table) -> pa.Table:
    """(grp, lot, low, tokens): the union of a block's tokens and its least set size."""
    blobs, out = table["tokens"], []
    for (g, lot), rows in _by_block(table):
        own = [np.frombuffer(blobs[i].as_py(), np.uint64) for i in rows]
        out.append((g, lot, min(x.size for x in own), np.unique(np.concatenate(own)).tobytes()))
    kinds = (pa.binary(), pa.int32(), pa.int32(), pa.binary())
    return pa.table([pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)], names=["grp", "lot", "low", "tokens"])


def _pieces(percent: int):
    """(grp, lot, members, sets, parts): a block's members with their sets, in rows of about a megabyte.  Members of one part of a
    row, named by the place of its first member, are connected: all members of a group, those that link in a bin."""

    def run(table: pa.Table) -> pa.Table:
        keys, blobs, out = table["node"], table["tokens"], []
        for (g, lot), rows in _by_block(table):
            size = PIECE_BYTES
            for i in rows:
                blob = blobs[i].as_py()
                if size + len(blob) > PIECE_BYTES:
                    size = 0
                    out.append((g, lot, [], []))
                size += len(blob)
                out[-1][2].append(keys[i].as_py())
                out[-1][3].append(blob)
        parts = [_parts(r[3], percent) if len(r[0]) > NODE_BYTES else [0] * len(r[2]) for r in out]
        kinds = (pa.binary(), pa.int32(), pa.list_(pa.binary()), pa.list_(pa.binary()))
        columns = [pa.array([r[c] for r in out], t) for c, t in enumerate(kinds)]
        return pa.table([*columns, pa.array(parts, pa.list_(pa.int32()))], names=["grp", "lot", "members", "sets", "parts"])

    return run


def _parts(blobs: list[bytes], percent: int) -> list[int]:
    """For each set the place of the first one that it is connected with."""
    sets, part = [np.frombuffer(x, np.uint64) for x in blobs], list(range(len(blobs)))
    for i, x in enumerate(sets):
        for k in range(i):
            if part[k] != part[i] and 100 * min(x.size, sets[k].size) >= percent * max(x.size, sets[k].size) and _linked(x, sets[k], percent):
                low, high = sorted((part[k], part[i]))
                part = [low if p == high else p for p in part]
    return part


def _bound(percent: int):
    """Those queries (node, own, g, g_lot) whose overlap with the block's union doesn't rule the block out."""

    def run(batches):
        for batch in batches:
            keep = []
            for own, low, union in zip(batch.column("a_tokens"), batch.column("low").to_pylist(), batch.column("tokens"), strict=True):
                q = np.frombuffer(own.as_py(), np.uint64)
                common = np.intersect1d(q, np.frombuffer(union.as_py(), np.uint64), assume_unique=True).size
                keep.append((100 + percent) * common >= percent * (q.size + max(low, -(-percent * q.size // 100))))
            yield batch.select(["node", "own", "g", "g_lot"]).filter(pa.array(keep, pa.bool_()))

    return run


def _compare(percent: int):
    """Links (a, b) of queries with members of opened blocks, and the names of both sides' groups; one for each part of a piece."""

    def run(batches):
        for batch in batches:
            a, b, at = [], [], []
            for i in range(batch.num_rows):
                q = np.frombuffer(batch.column("a_tokens")[i].as_py(), np.uint64)
                node, members, sets, parts = (batch.column(c)[i] for c in ("node", "members", "sets", "parts"))
                node, members, parts = node.as_py(), members.as_py(), parts.as_py()
                done = {parts[members.index(node)]} if node in members else set()
                for k, part in enumerate(parts):
                    if part not in done and _linked(q, np.frombuffer(sets[k].as_py(), np.uint64), percent):
                        done.add(part)
                        a.append(node)
                        b.append(members[k])
                        at.append(i)
            groups = batch.select(["own", "g"]).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary()), *groups.columns], ["a", "b", "own", "g"])

    return run
