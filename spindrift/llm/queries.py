"""The operators of this subpackage over the test tables: one query each, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec, chat, decontaminate, divergence, ngram_join, packing, sharding, substring_dedup, suffix_tree, tiff, token_counts, toxicity, whitening


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(remainder: int):
    """Whether a document is of the fifth of all rows that a model must not learn from."""
    return F.crc32(F.col("doc_id").cast("string")) % 5 == remainder


def op1_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_tree.score_texts(table(spark, sf_dir, "documents"), "doc_id", "text", ~held_out(1), depth=5)
    return out.select("doc_id", held_out(1).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    out = bpe_codec.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", path)
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded"), 256).alias("decoded_sha256"),
    )


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), "doc_id", "text", n=3, percent=90).drop("text_id")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    records = chat.turn_rows_to_records(rows.unionByName(fixed), "conv_id", "turn", "role", "text")
    return _chat_digests(records)


def chat_mixed_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for conversations that arrive in three layouts, by their ids."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id")
    turn = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    other = lambda r: F.when(r == "user", "human").when(r == "assistant", "gpt").otherwise(r)
    messages = F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content")))
    spoken = F.transform("turns", lambda t: F.struct(other(t["role"]).alias("from"), t["text"].alias("value")))
    layouts = [F.to_json(F.struct(x.alias(n))) for n, x in (("turns", F.col("turns")), ("messages", messages), ("conversations", spoken))]
    kind = F.pmod(F.col("conv_id"), F.lit(3))
    records = rows.select("conv_id", F.when(kind == 0, layouts[0]).when(kind == 1, layouts[1]).otherwise(layouts[2]).alias("record"))
    return _chat_digests(records)


def _chat_digests(records: DataFrame) -> DataFrame:
    out = chat.format_chats(records, "conv_id", "record")
    turns, loss = chat.read_turns(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss_spans"))
    out = out.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_tiff_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = tiff.encode_text(table(spark, sf_dir, "documents"), "doc_id", "text")
    stored = stored.select(F.struct("doc_id", "n_bytes", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256")).alias("k"), "media")
    page = tiff.decode_pages(stored, "k", "media")
    return page.select(
        "k.doc_id",
        "k.n_bytes",
        F.octet_length("pixels").cast("long").alias("payload_bytes"),
        F.sha2("pixels", 256).alias("payload_sha256"),
        F.crc32(F.expr("substring(pixels, octet_length(pixels) - 31, 32)")).alias("tail_crc32"),
        "k.media_bytes",
        "k.media_sha256",
        "feature",
    )


def op7_hash_tree_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shard(table(spark, sf_dir, "documents"), "doc_id", "text", sharding.even_tree(8))
    return out.withColumn("law", F.lit("key"))


def op6_spaced_seeds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id", "text", "item_id", "text")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text")
    return out.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), F.to_json("removed").alias("removed"))


def toxicity_model(docs: DataFrame, labels: DataFrame) -> toxicity.ToxicityModel | None:
    """Production parameters: at most 2500 documents of each class are learnt from."""
    texts, toxic = toxicity.training_rows(docs, labels, "doc_id", "text", "toxic", ~held_out(0), per_class=2500)
    return toxicity.train(texts, toxic)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scored = toxicity.score(docs, "doc_id", "text", toxicity_model(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", held_out(0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return token_counts.token_counts(table(spark, sf_dir, "documents"), "doc_id", "text", path, limit=2048)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"), "text", "lang", "source", least=3, top=200)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", components=8)
    return out.withColumn("deviation", F.col("deviation").cast("long"))


def op13_configuration_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", path, capacity=2048, with_ids=False).drop("ids")


QUERIES = {f.__name__: f for f in (op1_suffix_tree, op2_bpe_codec, op3_ngram_jaccard, op4_chat_format, op5_tiff_media, op6_spaced_seeds, op7_hash_tree_shards, op8_line_dedup, op9_toxicity, op10_token_counts, op11_source_divergence, op12_whitening, op13_configuration_packing, chat_mixed_layouts)}

_JACCARD = r"""
WITH RECURSIVE w AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
    FROM documents
), s AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN []::VARCHAR[] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 1), lambda i: ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2]) END) AS sh
    FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.sh = y.sh AND x.doc_id < y.doc_id GROUP BY x.doc_id, y.doc_id),
e AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reached AS (SELECT doc_id, doc_id AS r FROM w UNION SELECT reached.doc_id, both_ways.b FROM reached JOIN both_ways ON both_ways.a = reached.r)
SELECT doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(r) AS component_id FROM reached LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

_CHAT = r"""
WITH t AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    {more}
), f AS (
    SELECT *, 20 + length(role) + length(text) + length(regexp_replace(role || text, '[^<\[\\]', '', 'g')) AS chars FROM t
), g AS (
    SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
        coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '') AS loss, sum(chars) AS chars
    FROM f GROUP BY conv_id
)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256, chars::BIGINT AS formatted_chars FROM g
"""

_DIVERGENCE = r"""
WITH d AS (
    SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
        regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
    FROM documents
), e AS (SELECT id, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM e GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM e GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
s AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0)::HUGEINT AS n, k.n::HUGEINT AS ln FROM g JOIN k USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
t AS (SELECT lang, source, sum(n) AS total, count(*) AS v, sum(ln) AS ltotal FROM s GROUP BY lang, source),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 1) // (total + v) AS p, 1 + 1000000000 * (ln + 1) // (ltotal + v) AS lp FROM s JOIN t USING (lang, source)),
f AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
x AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(f.value, 0) AS value
    FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN f ON f.lang = a.lang AND f.source = a.source AND f.item = b.source
    UNION ALL SELECT lang, source, 'term', term, (p - lp) * (p - lp) // lp FROM p WHERE n > 0 AND p > lp
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM x) WHERE part = 'pair' OR rank <= 200
"""

#: The others rest on hashes, models, vocabularies or stored files that SQL has no words for; tests/llm has plain versions.
ORACLE_SQL: dict[str, str] = {
    "op3_ngram_jaccard": _JACCARD,
    "op4_chat_format": _CHAT.format(more="UNION ALL SELECT -7, * FROM (VALUES (0, 'user', '</s>[INST] ok [/INST]'), (1, 'assistant', '</s>[INST] ok [/INST]'))"),
    "chat_mixed_layouts": _CHAT.format(more=""),
    "op11_source_divergence": _DIVERGENCE,
}
