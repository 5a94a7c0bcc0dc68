"""The registered queries of the numbered operators, and SQL for those that SQL can express."""

from __future__ import annotations

import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cover_tree import embedding_links
from .exact_dedup import exact_duplicates
from .html_text import extract_text
from .langid import fit_language_model, predict_language
from .packing import pack
from .periodic import periodic_runs, words_of
from .prefix_trie import prefix_trie
from .quality import fit_quality, score_quality
from .runtime import session_of
from .sampling import crc_rest
from .sharding import interleaved
from .simhash import near_duplicates
from .tokens import byte_bpe_decode, byte_bpe_encode, token_counts, token_pieces
from .toxicity import fit_toxicity, score_toxicity

SEQUENCE_TOKENS = 4096
TOKEN_LIMIT = 1024


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session_of(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels.where(crc_rest("doc_id", 5) != 0))
    return score_quality(docs, model).select(
        F.col("id").alias("doc_id"),
        (crc_rest("id", 5) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.3).cast("int").alias("predicted"),
    )


def op2_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    pieces = token_pieces(docs, public_tokenizers.path("word_bpe_49k.json"), SEQUENCE_TOKENS)
    return pack(pieces.withColumnRenamed("id", "doc_id"), SEQUENCE_TOKENS)


def op3_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The page's address stands beside its text, so that no page is looked up again."""
    pages = _table(spark, sf_dir, "pages")
    found = extract_text(pages.select(F.struct("page_id", "url").alias("page"), "html"), "page", "html")
    return found.select("id.page_id", "id.url", "text", "n_chars")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = _table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels.where(crc_rest("doc_id", 3) != 1))
    return score_toxicity(docs, model).select(
        F.col("id").alias("doc_id"),
        (crc_rest("id", 3) == 1).alias("held_out"),
        "score",
        (F.col("score") >= 0.7).cast("int").alias("predicted"),
    )


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    encoded = byte_bpe_encode(_table(spark, sf_dir, "documents"), path, pattern)
    return byte_bpe_decode(encoded, path, pattern).select(
        F.col("id").alias("doc_id"),
        "n_tokens",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("data", 256).alias("decoded_sha256"),
    )


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = token_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > TOKEN_LIMIT).alias("over_limit")
    )


def op7_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_links(_table(spark, sf_dir, "embeddings"), cosine=0.95).select(
        F.col("id").alias("vec_id"),
        "n_links",
        F.col("component").alias("component_id"),
        (F.col("component") == F.col("id")).alias("kept"),
    )


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = fit_language_model(docs.where(crc_rest("doc_id", 3) != 1))
    return predict_language(docs, model).select(
        F.col("id").alias("doc_id"), (crc_rest("id", 3) == 1).alias("held_out"), "lang_pred", "score"
    )


def op9_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(_table(spark, sf_dir, "documents"), words=4, bits=4, width=1)
    return found.select(
        F.col("id").alias("doc_id"),
        F.lower(F.lpad(F.hex("fp0"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_duplicates(_table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256")
    )


OP10_SQL = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS clean
  FROM documents
), g AS (
  SELECT doc_id, sha256(clean) AS text_sha256,
         count(*) OVER (PARTITION BY clean) AS group_size,
         first_value(doc_id) OVER (PARTITION BY clean ORDER BY points DESC, doc_id) AS keep_id
  FROM n
)
SELECT doc_id, keep_id, group_size, keep_id = doc_id AS kept, text_sha256 FROM g
"""


def planted(doc_id: int, text: str) -> list[str]:
    """A text's words; in about a tenth of the documents the last ones repeat a few words of the text."""
    words = words_of(doc_id, text)
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic_runs(_table(spark, sf_dir, "documents"), words=planted)
    # The longest run; of several the first, then the one with the smallest period.
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat(F.concat_ws(",", *(r[x].cast("string") for x in ("start", "length", "period"))), F.lit("\n")))
    found = found.select("id", "runs", "collapsed", best.alias("best"), F.concat_ws("", line).alias("lines"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.size("runs").cast("long").alias("n_runs"),
        (-F.col("best.start")).alias("start"),
        F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"),
        F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(_table(spark, sf_dir, "conversations"))


SHARDS = 24


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of rows a shard are at most one apart, and so are those of each source's rows from its share."""
    text = F.coalesce(F.col("text"), F.lit(""))
    more = {"size": F.octet_length(text).cast("long") + 8, "text_crc32": F.crc32(text.cast("binary"))}
    found = interleaved(_table(spark, sf_dir, "documents"), SHARDS, "source", "doc_id", more=more)
    return found.select(
        F.col("id").alias("doc_id"), "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: crc32 of a list of byte values, bit by bit (3988292384: the reversed polynomial, a fixed value).
CRC32_SQL = """xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], {bytes}), lambda c, b:
    list_reduce(list_concat([xor(c, b)], range(8)), lambda d, i: xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END))))"""

OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST,
           md5(octet_length(encode(coalesce(role, ''))) || ':' || coalesce(role, '') || coalesce(text, ''))) AS pos
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, {CRC32_SQL.format(bytes="list_transform(string_split(conv_id::VARCHAR, ''), lambda s: ord(s)::BIGINT)")} % 9 AS h
  FROM (SELECT DISTINCT conv_id FROM turns)
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id - c.conv_id % 5 AND t.pos <= c.h
  UNION ALL
  SELECT c.conv_id, 1, t.pos, t.role, t.text FROM convs c JOIN turns t ON t.conv_id = c.conv_id AND t.pos > c.h
), numbered AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY part, pos) AS depth, role, text FROM rebuilt
), paths AS (
  SELECT conv_id, depth, octet_length(encode(text)) AS bytes,
         list({{'role': role, 'text': text}}) OVER (PARTITION BY conv_id ORDER BY depth) AS path
  FROM numbered
  UNION ALL
  SELECT conv_id, 0, 0, [] FROM convs
), members AS (
  SELECT *, depth = max(depth) OVER (PARTITION BY conv_id) AS ends FROM paths
), nodes AS (
  SELECT path, any_value(depth) AS depth, any_value(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CASE WHEN ends THEN conv_id::VARCHAR END, ',' ORDER BY conv_id), '')) AS ends_sha256
  FROM members GROUP BY path
), linked AS (
  SELECT c.*, p.conv_id AS parent_conv_id, p.path AS parent_path
  FROM nodes c LEFT JOIN nodes p ON c.depth > 0 AND p.depth = c.depth - 1 AND p.path = c.path[:c.depth - 1]
), children AS (
  SELECT parent_path AS path, count(*) AS n_children FROM linked WHERE depth > 0 GROUP BY parent_path
), flagged AS (
  SELECT l.*, coalesce(k.n_children, 0) AS n_children FROM linked l LEFT JOIN children k ON k.path = l.path
), above AS (
  SELECT path[:d] AS path, n_children = 0 AS leaf, (n_convs - 1) * bytes AS saved FROM flagged, unnest(range(depth + 1)) AS r(d)
), sums AS (
  SELECT path, count_if(leaf) AS n_leaves, sum(saved)::BIGINT AS saved_tokens FROM above GROUP BY path
)
SELECT conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves::BIGINT AS n_leaves, saved_tokens, ends_sha256
FROM flagged JOIN sums USING (path)
"""

_DRAWN_SQL = "('0x' || substr(md5('13:' || {}), 1, 15))::BIGINT"

OP13_SQL = f"""
WITH crc AS (
  SELECT list_transform(range(256), lambda x: list_reduce(list_concat([x], range(8)), lambda d, i:
    xor(d >> 1, CASE WHEN d & 1 = 1 THEN 3988292384 ELSE 0 END))) AS steps
), rows AS (
  SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 8 AS size,
         xor(4294967295, list_reduce(list_concat([4294967295::BIGINT],
           list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda s: ('0x' || s)::BIGINT)),
           lambda c, b: xor(c >> 8, steps[(xor(c, b) & 255) + 1]))) AS text_crc32,
         {_DRAWN_SQL.format("'phase:' || source")} AS phase, {_DRAWN_SQL.format("'row:' || doc_id")} AS draw
  FROM documents, crc
), parts AS (
  SELECT *, (row_number() OVER (PARTITION BY phase ORDER BY draw, doc_id) - 1 + phase / 1152921504606846976.0)
            / count(*) OVER (PARTITION BY phase) AS part
  FROM rows
), placed AS (
  SELECT *, row_number() OVER (ORDER BY part, phase, draw, doc_id) - 1 AS position, count(*) OVER () AS n FROM parts
), cut AS (
  SELECT *, (position * {SHARDS} // n)::INTEGER AS shard FROM placed
)
SELECT doc_id, size, text_crc32, 'rows' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY position) - 1 AS slot, NULL::INTEGER AS grown_shard
FROM cut
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_quality": op1_quality,
        "op2_pack": op2_pack,
        "op3_html_text": op3_html_text,
        "op4_toxicity": op4_toxicity,
        "op5_byte_bpe": op5_byte_bpe,
        "op6_token_counts": op6_token_counts,
        "op7_cover_tree": op7_cover_tree,
        "op8_language": op8_language,
        "op9_simhash": op9_simhash,
        "op10_exact_dedup": op10_exact_dedup,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_prefix_trie": op12_prefix_trie,
        "op13_sharding": op13_sharding,
    }


def oracle_sql() -> dict[str, str]:
    return {"op10_exact_dedup": OP10_SQL, "op12_prefix_trie": OP12_SQL, "op13_sharding": OP13_SQL}
