"""Queries over the test tables, and the SQL that says the same."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import models, prepare, retrieval, splits, tags
from .operators.rounds import Rounds
from .sources import store


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and the parts that they ordered; a tenth of the quantity, rounded up, is the value."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", F.ceil(F.col("l_quantity") / 10).alias("v"))
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("at"))
    return prepare.canonical(lines.join(orders, lines.l_orderkey == orders.o_orderkey), "o_custkey", "l_partkey", "v", "at")


def liked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepare.threshold_binarize(interactions(spark, sf_dir), 4, 1)


def parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").cast("string").alias("item_id"), F.col("p_name").alias("title"), F.concat_ws("|", "p_type", "p_brand").alias("genres"), F.array("p_type", "p_brand").alias("categories"), "p_partkey", "p_size")


def joined(df: DataFrame, *columns: str) -> DataFrame:
    """Lists as text, one space between members."""
    return df.select(*[c for c in df.columns if c not in columns], *[F.array_join(c, " ").alias(c) for c in columns])


QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

_ALL = "i AS (SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(l_partkey AS VARCHAR) AS item_id, CAST(ceil(l_quantity / 10) AS DOUBLE) AS value, CAST(epoch_us(o_orderdate) AS DOUBLE) AS timestamp FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"
_LIKED = _ALL + ", x AS (SELECT user_id, item_id, CAST(1 AS DOUBLE) AS value, timestamp FROM i WHERE value >= 4)"
_PARTS = "p AS (SELECT CAST(p_partkey AS VARCHAR) AS item_id, p_name AS title, concat_ws('|', p_type, p_brand) AS genres, p_type, p_brand, p_partkey, p_size FROM part)"
_COLD = "r AS (SELECT item_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', item_id)), item_id) AS r FROM (SELECT DISTINCT item_id FROM x)), s AS (SELECT item_id, CASE WHEN r <= 50 THEN 'val' WHEN r <= 150 THEN 'test' ELSE 'train' END AS split FROM r)"
_LLO = """n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY timestamp DESC, item_id DESC) AS r FROM x),
h AS (SELECT user_id, list_sort(list(DISTINCT item_id) FILTER (WHERE r > 1)) AS source, list(DISTINCT item_id) FILTER (WHERE r = 1) AS target FROM n WHERE n >= 2 GROUP BY user_id)"""
_TEMPORAL = """c AS (SELECT quantile_cont(timestamp, 0.9) AS cutoff FROM x),
h AS (SELECT user_id, list_sort(list(DISTINCT item_id) FILTER (WHERE timestamp <= cutoff)) AS source, list_sort(list(DISTINCT item_id) FILTER (WHERE timestamp > cutoff)) AS target FROM x, c GROUP BY user_id HAVING count(*) FILTER (WHERE timestamp <= cutoff) > 0 AND count(*) FILTER (WHERE timestamp > cutoff) > 0)"""


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


@query(f"WITH {_ALL} SELECT * FROM i")
def canonical_interactions(spark, sf_dir):
    return interactions(spark, sf_dir)


@query(f"WITH {_LIKED} SELECT * FROM x")
def threshold_binarize(spark, sf_dir):
    return liked(spark, sf_dir)


@query("SELECT event_id, try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) AS k FROM events WHERE try_cast(regexp_extract(props, '([0-9]+)', 1) AS DOUBLE) IS NOT NULL")
def null_coercion(spark, sf_dir):
    out = table(spark, sf_dir, "events").select("event_id", prepare.number(F.regexp_extract("props", "([0-9]+)", 1)).alias("k"))
    return out.na.drop(subset=["k"])


@query(f"WITH {_LIKED} SELECT * FROM x WHERE user_id IN (SELECT user_id FROM x GROUP BY 1 HAVING count(*) >= 15)")
def user_support_rows(spark, sf_dir):
    return prepare.with_support(liked(spark, sf_dir), "user_id", 15)


@query(f"WITH {_LIKED} SELECT * FROM x WHERE user_id IN (SELECT user_id FROM x GROUP BY 1 HAVING count(DISTINCT item_id) >= 15)")
def user_support_distinct(spark, sf_dir):
    return prepare.with_support(liked(spark, sf_dir), "user_id", 15, distinct="item_id")


def _kcore_sql(rounds: int = 12) -> str:
    steps = []
    for k in range(rounds):
        before = "x" if k == 0 else f"u{k - 1}"
        steps.append(f"t{k} AS MATERIALIZED (SELECT * FROM {before} WHERE item_id IN (SELECT item_id FROM {before} GROUP BY 1 HAVING count(*) >= 8))")
        steps.append(f"u{k} AS MATERIALIZED (SELECT * FROM t{k} WHERE user_id IN (SELECT user_id FROM t{k} GROUP BY 1 HAVING count(*) >= 10))")
    return f"WITH {_LIKED}, {', '.join(steps)} SELECT * FROM u{rounds - 1}"


@query(_kcore_sql())
def kcore_prune(spark, sf_dir):
    return prepare.kcore(liked(spark, sf_dir), 10, 8)


@query(_kcore_sql())
def kcore_by_differences(spark, sf_dir):
    return prepare.peeled(liked(spark, sf_dir), 10, 8)


@query(f"WITH {_LIKED} SELECT * FROM x WHERE item_id IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings)")
def restrict_to_metadata(spark, sf_dir):
    return prepare.restrict(liked(spark, sf_dir), table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("item_id")))


@query(f"WITH {_PARTS} SELECT item_id, title, lang, n_chars FROM p LEFT JOIN documents ON p_partkey = doc_id")
def metadata_left_join(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("p_partkey"), "lang", "n_chars")
    return parts(spark, sf_dir).join(docs, "p_partkey", "left").select("item_id", "title", "lang", "n_chars")


@query(f"WITH {_LIKED}, v AS (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_idx FROM (SELECT DISTINCT item_id FROM x)) SELECT item_idx, item_id, lang FROM v LEFT JOIN (SELECT CAST(doc_id AS VARCHAR) AS item_id, lang FROM documents) USING (item_id)")
def metadata_align(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("item_id"), "lang")
    return prepare.vocabulary(liked(spark, sf_dir), "item_id", "item_idx").join(docs, "item_id", "left").select("item_idx", "item_id", "lang")


@query("SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def dedup_keep_first(spark, sf_dir):
    return prepare.keep_first(table(spark, sf_dir, "events"), "event_type", "ts", "event_id").select("event_type", "event_id", "value")


@query(f"WITH {_LIKED} SELECT row_number() OVER (ORDER BY item_id) - 1 AS item_idx, item_id FROM (SELECT DISTINCT item_id FROM x)")
def item_vocab(spark, sf_dir):
    return prepare.vocabulary(liked(spark, sf_dir), "item_id", "item_idx")


@query(f"WITH {_LIKED} SELECT row_number() OVER (ORDER BY user_id) - 1 AS user_idx, user_id FROM (SELECT DISTINCT user_id FROM x)")
def user_vocab(spark, sf_dir):
    return prepare.vocabulary(liked(spark, sf_dir), "user_id", "user_idx")


@query(f"WITH {_LIKED}, u AS (SELECT row_number() OVER (ORDER BY user_id) - 1 AS user_idx, user_id FROM (SELECT DISTINCT user_id FROM x)), v AS (SELECT row_number() OVER (ORDER BY item_id) - 1 AS item_idx, item_id FROM (SELECT DISTINCT item_id FROM x)) SELECT user_idx, item_idx, CAST(sum(value) AS FLOAT) AS value FROM x JOIN u USING (user_id) JOIN v USING (item_id) GROUP BY 1, 2")
def sparse_matrix(spark, sf_dir):
    x = liked(spark, sf_dir)
    return prepare.sparse_matrix(x, prepare.vocabulary(x, "user_id", "user_idx"), prepare.vocabulary(x, "item_id", "item_idx"))


@query(f"WITH {_LIKED}, r AS (SELECT user_id, row_number() OVER (ORDER BY md5(concat_ws(':', '42', user_id)), user_id) AS r FROM (SELECT DISTINCT user_id FROM x)) SELECT user_id, CASE WHEN r <= 50 THEN 'val' WHEN r <= 150 THEN 'test' ELSE 'train' END AS split FROM r")
def user_split(spark, sf_dir):
    return splits.three_way(liked(spark, sf_dir).select("user_id").distinct(), "user_id", 50, 100, 42)


@query(f"WITH {_LIKED}, {_COLD} SELECT item_id, split FROM s")
def item_split(spark, sf_dir):
    return splits.three_way(liked(spark, sf_dir).select("item_id").distinct(), "item_id", 50, 100, 42)


@query(f"WITH {_LIKED}, d AS (SELECT DISTINCT user_id, item_id FROM x), n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n FROM d), e AS (SELECT *, unnest(range(5)) AS draw FROM n WHERE n >= 5) SELECT draw, user_id, item_id, row_number() OVER (PARTITION BY draw, user_id ORDER BY md5(concat_ws(':', '42', draw, user_id, item_id)), item_id) <= ceil(n * 0.2) AS is_target FROM e")
def eval_fold_holdout(spark, sf_dir):
    x = liked(spark, sf_dir)
    return splits.fold_holdout(x, x, 42, draws=5, min_items=5)


@query(f"WITH {_LIKED}, {_COLD}, h AS (SELECT user_id, list_sort(list(DISTINCT item_id) FILTER (WHERE split = 'train')) AS source, list_sort(list(DISTINCT item_id) FILTER (WHERE split = 'test')) AS target FROM x JOIN s USING (item_id) GROUP BY 1) SELECT user_id, array_to_string(source, ' ') AS source, array_to_string(target, ' ') AS target FROM h WHERE len(source) > 0 AND len(target) > 0")
def item_cold_holdout(spark, sf_dir):
    x = liked(spark, sf_dir)
    return joined(splits.item_cold_holdout(x, splits.three_way(x.select("item_id").distinct(), "item_id", 50, 100, 42)), "source", "target")


@query(f"WITH {_LIKED}, {_LLO} SELECT user_id, array_to_string(source, ' ') AS source, array_to_string(target, ' ') AS target FROM h WHERE len(source) > 0")
def leave_last_out(spark, sf_dir):
    return joined(splits.leave_last_out(liked(spark, sf_dir)), "source", "target")


@query(f"WITH {_LIKED} SELECT quantile_cont(timestamp, 0.9) AS cutoff FROM x")
def temporal_cutoff(spark, sf_dir):
    return splits.temporal_cutoff(liked(spark, sf_dir), 0.1)


@query(f"WITH {_LIKED}, {_TEMPORAL} SELECT user_id, array_to_string(source, ' ') AS source, array_to_string(target, ' ') AS target FROM h")
def temporal_holdout(spark, sf_dir):
    return joined(splits.temporal_holdout(liked(spark, sf_dir), 0.1), "source", "target")


@query(f"WITH {_LIKED}, {_LLO} SELECT * FROM x WHERE item_id NOT IN (SELECT unnest(target) FROM h WHERE len(source) > 0)")
def train_rows_leave_last_out(spark, sf_dir):
    x = liked(spark, sf_dir)
    return splits.train_rows(x, splits.leave_last_out(x))


@query(f"WITH {_LIKED}, {_TEMPORAL} SELECT * FROM x WHERE item_id NOT IN (SELECT unnest(target) FROM h)")
def train_rows_temporal(spark, sf_dir):
    x = liked(spark, sf_dir)
    return splits.train_rows(x, splits.temporal_holdout(x, 0.1))


@query(f"WITH {_PARTS}, g AS (SELECT item_id, p_partkey AS o, unnest(list_zip(string_split(genres, '|'), range(len(string_split(genres, '|'))))) AS z FROM p), t AS (SELECT item_id, o, trim(z[1]) AS tag, z[2] AS q FROM g), f AS (SELECT tag, row_number() OVER (ORDER BY min((o, q))) - 1 AS tag_idx FROM t GROUP BY tag) SELECT item_id, tag, tag_idx, count(*) AS weight FROM t JOIN f USING (tag) GROUP BY ALL")
def genre_tags(spark, sf_dir):
    return tags.genre_tags(parts(spark, sf_dir), "genres", "p_partkey")


@query("WITH t AS (SELECT CAST(l_partkey AS VARCHAR) AS item_id, lower(trim(o_orderpriority)) AS tag FROM lineitem JOIN orders ON l_orderkey = o_orderkey), k AS (SELECT tag FROM t GROUP BY 1 HAVING count(*) >= 100) SELECT item_id, tag, count(*) AS weight FROM t WHERE tag IN (FROM k) AND item_id IN (SELECT CAST(vec_id AS VARCHAR) FROM embeddings) GROUP BY 1, 2")
def user_tags(spark, sf_dir):
    lines, orders = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey).select(F.col("l_partkey").cast("string").alias("item_id"), F.col("o_orderpriority").alias("tag"))
    return tags.user_tags(rows, table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("item_id")), 100)


@query("SELECT CAST(l_partkey AS VARCHAR) AS item_id, lower(trim(n_name)) AS tag, sum(l_quantity) AS weight FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE s_nationkey IN (SELECT s_nationkey FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1 HAVING sum(l_quantity) >= 30000) GROUP BY 1, 2")
def weighted_tags(spark, sf_dir):
    lines, suppliers = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier")
    rows = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey).select(F.col("l_partkey").cast("string").alias("item_id"), F.col("s_nationkey").alias("tag_id"), F.col("l_quantity").alias("count"))
    return tags.weighted_tags(rows, table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("tag_id"), F.col("n_name").alias("tag_name")), 30000)


@query(f"WITH {_PARTS}, e AS (SELECT item_id, concat_ws('\n\n', CASE WHEN p_size > 25 THEN 'Title: ' || trim(title) END, 'Categories: ' || p_type || ' > ' || p_brand) AS entity_text FROM p) SELECT * FROM e WHERE len(regexp_extract_all(entity_text, '\\S+')) >= 5")
def entity_text_filter(spark, sf_dir):
    """Small parts go without a title, and what is left of them has too few words."""
    p = parts(spark, sf_dir).withColumn("title", F.when(F.col("p_size") > 25, F.col("title")))
    return T.add_entity_text(p, ["title", "missing", "categories"], 5, labelled=True).select("item_id", "entity_text")


@query(f"WITH {_PARTS} SELECT item_id, concat_ws('\n', nullif(trim(title), ''), nullif(trim(genres), '')) AS entity_text FROM p")
def entity_text_base(spark, sf_dir):
    return T.add_entity_text(parts(spark, sf_dir), ["title", "missing", "genres"]).select("item_id", "entity_text")


@query(f"WITH {_PARTS} SELECT item_id, concat_ws('\n\n', 'Title: ' || trim(title), 'Categories: ' || p_type || ' > ' || p_brand) AS entity_text FROM p")
def entity_text_labeled(spark, sf_dir):
    return T.add_entity_text(parts(spark, sf_dir), ["title", "missing", "categories"], labelled=True).select("item_id", "entity_text")


@query("SELECT p_partkey, CASE WHEN p_size > 25 THEN p_name || chr(10) || p_brand ELSE p_type || ' | ' || p_brand END AS encoder_text FROM part")
def sbert_texts(spark, sf_dir):
    large = lambda c: F.when(F.col("p_size") > 25, F.col(c)).otherwise(" ")
    p = table(spark, sf_dir, "part").select("p_partkey", large("p_name").alias("title"), large("p_brand").alias("authors"), "p_type", "p_brand")
    return p.select("p_partkey", T.encoder_texts(p, ["title", "authors"], fallback=["p_type", "missing", "p_brand"]).alias("encoder_text"))


@query("SELECT event_id, 'k: ' || json_extract_string(props, '$.k') AS details, event_type AS plain FROM events")
def json_details(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", T.details_text(F.col("props")).alias("details"), T.details_text(F.col("event_type")).alias("plain"))


@query("WITH u AS (SELECT page_id, '[{\"hi_res\": \"' || url || '\", \"large\": \"' || url || '\"}, {\"thumb\": \"t/' || url || '\"}]' AS js, url FROM pages) SELECT page_id, url AS image_url, url || ' t/' || url AS image_urls FROM u")
def image_urls(spark, sf_dir):
    js = F.concat(F.lit('[{"hi_res": "'), "url", F.lit('", "large": "'), "url", F.lit('"}, {"thumb": "t/'), "url", F.lit('"}]'))
    out = table(spark, sf_dir, "pages").select("page_id", T.image_urls(T.parse_images(js)).alias("u"))
    return out.select("page_id", F.coalesce(F.get("u", F.lit(0)), F.lit("")).alias("image_url"), F.array_join("u", " ").alias("image_urls"))


def _vectors(spark, sf_dir):
    return retrieval.unit(table(spark, sf_dir, "embeddings").select(F.col("vec_id").cast("string").alias("item_id"), F.col("embedding").alias("vector")), "vector")


@query(f"WITH {_LIKED}, {_LLO}, t AS (SELECT DISTINCT item_id FROM x WHERE item_id NOT IN (SELECT unnest(target) FROM h)), e AS (SELECT user_id, unnest(source) AS item_id FROM h) SELECT user_id AS row_id, user_id, array_to_string(list_sort(list(e.item_id)), ' ') AS source, any_value(target[1]) AS target FROM e JOIN t USING (item_id) JOIN h USING (user_id) GROUP BY user_id")
def history_holdout(spark, sf_dir):
    rows = liked(spark, sf_dir)
    last = splits.leave_last_out(rows)
    held_out = last.select(F.col("user_id").alias("row_id"), "user_id", F.get("target", F.lit(0)).alias("item_id"), F.array_join("source", "  ").alias("history"))
    return joined(splits.history_holdout(held_out, splits.train_rows(rows, last)), "source", "target")


@query(f"WITH {_ALL} SELECT * FROM i UNION ALL SELECT CAST(user_id AS VARCHAR), event_type, value, CAST(epoch_us(ts) AS DOUBLE) FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
def union_sources(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("at", F.unix_micros(F.col("ts").cast("timestamp")))
    return interactions(spark, sf_dir).unionByName(prepare.canonical(events, "user_id", "event_type", "value", "at"))


_UNIT = """e AS (SELECT CAST(vec_id AS VARCHAR) AS item_id, list_transform(embedding, lambda a: CAST(a AS DOUBLE)) AS v FROM embeddings),
ed AS (SELECT item_id, unnest(range(1, len(v) + 1)) AS d, unnest(v) / greatest(sqrt(list_sum(list_transform(v, lambda a: a * a))), 1e-12) AS x FROM e)"""
_HELD = _LIKED + ", " + _UNIT + ", y AS (SELECT * FROM x WHERE item_id IN (SELECT item_id FROM e)), " + _TEMPORAL.replace("FROM x", "FROM y")
_RANKED = """{name} AS (
    SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank, item_id, score FROM (
        SELECT u.user_id, i.item_id, round(greatest(sum(u.x * i.x), 0), 9) AS score
        FROM (SELECT user_id, d, sum(x) AS x FROM (SELECT user_id, unnest(source) AS item_id FROM h) JOIN {vectors} USING (item_id) GROUP BY user_id, d) u
        JOIN {vectors} i ON u.d = i.d GROUP BY u.user_id, i.item_id)
    WHERE (user_id, item_id) NOT IN (SELECT user_id, unnest(source) FROM h))"""
_TOP = _HELD + ", " + _RANKED.format(name="t", vectors="ed")
_GAIN = "list_sum(list_transform(range(1, least({k}, n) + 1), lambda i: 1 / log2(i + 1)))"
_USERS = """{name} AS (SELECT h.user_id, len(any_value(target)) AS n, {columns} FROM h LEFT JOIN {ranked} r ON r.user_id = h.user_id AND list_contains(target, r.item_id) GROUP BY h.user_id)"""
_COUNTED = ", ".join(f"count(rank) FILTER (rank <= {k}) AS h{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) AS d{k}" for k in (20, 50, 100))
_MEANS = ", ".join([f"round(avg(h{k} / least({k}, n)), 9) AS recall_{k}, round(avg(d{k} / {_GAIN.format(k=k)}), 9) AS ndcg_{k}" for k in (20, 50, 100)])
_KEPT = "k AS (SELECT item_id, d, x, row_number() OVER (PARTITION BY item_id ORDER BY abs(x) DESC, d) AS r FROM ed), kd AS (SELECT item_id, d, x FROM k WHERE r <= 8)"
#: The decoder of the kernel's query: 64 rows of 16 numbers.
_DECODER = "((7 * i + 3 * j) % 11 - 5) / 10.0"


def _held_out(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """A temporal holdout of items that have vectors, written once, and the vectors."""
    vectors = _vectors(spark, sf_dir)
    holdout = splits.temporal_holdout(prepare.restrict(liked(spark, sf_dir), vectors), 0.1)
    return Rounds(spark).write(holdout), vectors


def _rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of doubles depend on their order in the last digits."""
    return df.select(*[F.round(c, 9).alias(c) if c in columns else c for c in df.columns])


@query(f"WITH {_TOP} SELECT user_id, rank, item_id, score FROM t WHERE rank <= 20")
def retrieval_top_k(spark, sf_dir):
    holdout, vectors = _held_out(spark, sf_dir)
    return retrieval.top_k(holdout, vectors, 20)


@query(f"WITH {_TOP}, {_USERS.format(name='m', columns=_COUNTED, ranked='t')} SELECT {_MEANS}, count(*) AS n_users, count(*) AS n_eval_rows FROM m")
def retrieval_metrics(spark, sf_dir):
    return flagship(spark, sf_dir)


@query(f"WITH {_TOP}, {_USERS.format(name='m', columns='count(rank) AS n_hits, min(rank) AS first_hit_rank, list_sort(list(rank) FILTER (rank IS NOT NULL)) AS ranks', ranked='(SELECT * FROM t WHERE rank <= 100)')}, g AS (SELECT *, coalesce(list_sum(list_transform(ranks, lambda i: 1 / log2(i + 1))), 0) AS dcg, {_GAIN.format(k=100)} AS idcg FROM m) SELECT user_id, n AS n_true, n_hits, first_hit_rank, coalesce(array_to_string(ranks, ' '), '') AS hit_ranks, round(dcg, 9) AS dcg, round(idcg, 9) AS idcg, round(dcg / idcg, 9) AS ndcg FROM g")
def debug_rows(spark, sf_dir):
    holdout, vectors = _held_out(spark, sf_dir)
    return _rounded(joined(retrieval.debug_rows(retrieval.top_k(holdout, vectors, 100), holdout, 100), "hit_ranks"), "dcg", "idcg", "ndcg")


@query(f"WITH {_UNIT} SELECT item_id, d - 1 AS d, round(x, 9) AS x FROM ed")
def l2_normalize(spark, sf_dir):
    return _rounded(_vectors(spark, sf_dir).select("item_id", F.posexplode("vector").alias("d", "x")).withColumn("d", F.col("d").cast("long")), "x")


@query(f"WITH {_UNIT}, {_KEPT} SELECT item_id, d - 1 AS d, round(x, 9) AS x FROM kd")
def sparse_embeddings(spark, sf_dir):
    cells = retrieval.sparsify(_vectors(spark, sf_dir), 8).select("item_id", F.explode(F.arrays_zip("cols", "vals")).alias("c"))
    return _rounded(cells.select("item_id", F.col("c.cols").cast("long").alias("d"), F.col("c.vals").alias("x")), "x")


def _codes(spark, sf_dir) -> DataFrame:
    """Vectors with all but their eight largest entries set to 0."""
    codes = retrieval.sparsify(_vectors(spark, sf_dir), 8)
    at = lambda c, d: F.coalesce(F.get(c["vals"], (F.array_position(c["cols"], d) - 1).cast("int")), F.lit(0.0))
    dense = F.transform(F.array(F.struct("cols", "vals")), lambda c: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda d: at(c, d)))
    return codes.select("item_id", F.get(dense, F.lit(0)).alias("vector"))


@query(f"WITH {_HELD}, {_KEPT}, w AS (SELECT i, j, {_DECODER} AS w FROM range(64) a(i), range(16) b(j)), z AS (SELECT item_id, j AS d, sum(x * w) AS x FROM kd JOIN w ON w.i = kd.d - 1 GROUP BY item_id, j), zn AS (SELECT item_id, d, x / greatest(sqrt(sum(x * x) OVER (PARTITION BY item_id)), 1e-12) AS x FROM z), {_RANKED.format(name='t', vectors='zn')} SELECT user_id, rank, item_id, score FROM t WHERE rank <= 20")
def kernel_topk(spark, sf_dir):
    holdout, _ = _held_out(spark, sf_dir)
    decoder = np.fromfunction(lambda i, j: ((7 * i + 3 * j) % 11 - 5) / 10, (64, 16))
    return retrieval.kernel_top_k(holdout, _codes(spark, sf_dir), decoder, 20)


@query(f"WITH {_HELD}, {_KEPT}, {_RANKED.format(name='t', vectors='ed')}, {_RANKED.format(name='t8', vectors='kd')}, {_USERS.format(name='m', columns=_COUNTED, ranked='t')}, {_USERS.format(name='m8', columns=_COUNTED, ranked='t8')}, a AS (UNPIVOT (SELECT {_MEANS} FROM m) ON COLUMNS(*) INTO NAME metric VALUE base), b AS (UNPIVOT (SELECT {_MEANS} FROM m8) ON COLUMNS(*) INTO NAME metric VALUE sparse) SELECT metric, base, sparse, round(CASE WHEN base = 0 THEN 0 ELSE (base - sparse) / base * 100 END, 6) AS percent_drop FROM a JOIN b USING (metric)")
def percent_drop(spark, sf_dir):
    """What is lost of each metric if vectors keep eight entries."""
    holdout, vectors = _held_out(spark, sf_dir)
    found = [retrieval.metrics(retrieval.top_k(holdout, v, 100), holdout) for v in (vectors, _codes(spark, sf_dir))]
    names = [c for c in found[0].columns if not c.startswith("n_")]
    base, sparse = (m.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.round(c, 9).alias("x")) for c in names])).alias("s")).select("s.metric", F.col("s.x").alias(n)) for m, n in zip(found, ("base", "sparse"), strict=True))
    return base.join(sparse, "metric").withColumn("percent_drop", F.round(retrieval.percent_drop(F.col("base"), F.col("sparse")), 6))


@query("SELECT form, count(*) * f AS n_bytes, count(*) * f / 1048576.0 AS mb FROM embeddings, (VALUES ('dense', 256), ('sparse', 64)) v(form, f) GROUP BY form, f")
def size_report(spark, sf_dir):
    return retrieval.size_report(_vectors(spark, sf_dir), 8)


@query(f"WITH {_LIKED}, {_COLD}, s2 AS (SELECT item_id FROM s WHERE split = 'test') SELECT item_id FROM s2")
def cold_target_items(spark, sf_dir):
    return item_split(spark, sf_dir).filter("split = 'test'").select("item_id")


@query(ORACLE_SQL["sparse_matrix"])
def checkpoint_roundtrip(spark, sf_dir):
    """The train matrix of a checkpoint that was written without one, after another update has added a stage."""
    x, path = liked(spark, sf_dir), Rounds(spark).base
    with store.update(spark, path) as c:
        c.put("data", {"train": x, "items": prepare.vocabulary(x, "item_id", "item_idx")})
    with store.update(spark, path) as c:
        c.put("text", {"vectors": _vectors(spark, sf_dir)})
    return store.load_split(store.read(spark, path))["matrix"]


@query("SELECT event_id, 'tags: a ' || event_type || ' seen: ' || CASE WHEN value > 50 THEN 'True' ELSE 'False' END || ' more: k: ' || user_id || CASE WHEN value > 50 THEN ' deep: x: ' || event_type ELSE '' END AS text FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL AND value IS NOT NULL AND NOT isnan(value)")
def nested_text(spark, sf_dir):
    """Lists in a struct, and structs in a map beside it; what is empty leaves no key."""
    e = table(spark, sf_dir, "events").filter("user_id is not null and event_type is not null and value is not null and not isnan(value)")
    high = F.col("value") > 50
    deep = F.when(high, F.create_map(F.lit("x"), F.array("event_type", F.lit(" "))))
    e = e.withColumn("v", F.struct(F.array(F.array(F.lit(" a ")), F.array("event_type")).alias("tags"), high.alias("seen"), F.struct(F.col("user_id").alias("k"), deep.alias("deep")).alias("more")))
    return e.select("event_id", T.value_text(F.col("v"), e.schema["v"].dataType).alias("text"))


@query(f"WITH {_LIKED}, n AS (SELECT count(*) AS n FROM (SELECT DISTINCT item_id FROM x)), r AS (SELECT item_id, row_number() OVER (ORDER BY md5(concat_ws(':', '7', item_id)), item_id) AS r FROM (SELECT DISTINCT item_id FROM x)) SELECT item_id, CASE WHEN r <= n * 3 // 10 THEN 'val' WHEN r <= n * 3 // 10 + n * 4 // 10 THEN 'test' ELSE 'train' END AS split FROM r, n")
def item_split_shares(spark, sf_dir):
    items = Rounds(spark).write(liked(spark, sf_dir).select("item_id").distinct())
    n = items.count()
    return splits.three_way(items, "item_id", n * 3 // 10, n * 4 // 10, 7)


@query()
def elsa_vectors(spark, sf_dir):
    return models.fit_elsa(liked(spark, sf_dir), dim=16, epochs=1)[0]


@query()
def compressed_elsa(spark, sf_dir):
    how = models.Optimizer(lr=0.05)
    return models.fit_compressed_elsa(liked(spark, sf_dir), dim=16, k_target=4, stages=2, epochs=1, mask_every=2, window=1, threshold=0.1, how=how)[0]


@query()
def autoencoder_codes(spark, sf_dir):
    vectors = _vectors(spark, sf_dir)
    return models.sae_codes(vectors, models.fit_sae(vectors, hidden=128, k=8, epochs=1, batch=4096)[0], 8)


@query()
def dead_features(spark, sf_dir):
    return models.dead_features(autoencoder_codes(spark, sf_dir), 128)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Temporal holdout, top 100 by item vectors, recall and nDCG at 20, 50 and 100."""
    holdout, vectors = _held_out(spark, sf_dir)
    out = retrieval.metrics(retrieval.top_k(holdout, vectors, 100), holdout)
    return _rounded(out, *[c for c in out.columns if not c.startswith("n_")])
