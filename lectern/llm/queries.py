"""The ``opN_<name>`` queries: each applies one operator to its whole table and derives the digest columns."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import bpe, chat, fingerprint, langid, media, packing, quality, sharding, simhash, urlfilter
from lectern.llm.common import fold_of, table, unsigned_crc32

WORD_TOKENIZER, BYTE_RANKS = "word_bpe_49k.json", "byte_bpe_50k.tiktoken"
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]
_PLANTED = "</s>[INST] ok [/INST]"


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 4096 tokens: one row per piece."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_TOKENIZER))


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Store every text as a WAV file of a wrong declared type, sniff and carve it, and read it back."""
    stored = media.store_as_samples(table(spark, sf_dir, "documents"), declared="image/png")
    found = media.carve(stored)
    tail = F.substring("samples", -64, 64)
    sizes = F.expr("bigint(octet_length(samples))")
    return found.where("offset = 0").select(
        F.col("key").alias("doc_id"), F.col("n_samples").alias("n_bytes"), F.col("feature"), sizes.alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"), F.crc32(tail).cast("long").alias("tail_crc32"),
        F.col("length").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "declared_type", "media_type",
    )


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judge the url of every page by the four rules."""
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urlfilter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and its edited text, and their likeness."""
    return fingerprint.edit_likeness(table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predict the language of every document with a model of the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(fold_of(F.col("doc_id"), 5) == 0, F.lit(False))
    model = langid.train(docs.where(fold_of(F.col("doc_id"), 5) != 0))
    found = docs.select("doc_id", held_out.alias("held_out"), langid.identify(F.col("text"), model).alias("found"))
    return found.select("doc_id", "held_out", "found.lang_pred", "found.score")


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Put all documents into eight shards along the Hilbert curve."""
    return sharding.hilbert_shards(table(spark, sf_dir, "documents"), 8)


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode every text, decode the ids, and digest both."""
    coded = bpe.encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)
    return coded.select("doc_id", F.expr("bigint(octet_length(ids) div 4)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format all conversations and a planted one in windows, read them back and digest what was read."""
    planted = spark.range(0, 2, 1, 1).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(_PLANTED).alias("text")
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    read = chat.read_back(chat.windows(turns))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    parts = read.select("conv_id", F.struct("first_turn", said.alias("said"), F.array_join("targets", "").alias("loss")).alias("part"), F.size("turns").alias("n"), "n_chars")
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("part")).alias("parts"), F.sum("n").cast("long").alias("n_turns"), F.sum("n_chars").alias("formatted_chars"))
    loss = F.array_join("parts.loss", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("parts.said", "").cast("binary"), 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score the quality of every document with a model of the labels that aren't held out."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels.where(fold_of(F.col("doc_id"), 4) != 2))
    held_out = F.coalesce(fold_of(F.col("doc_id"), 4) == 2, F.lit(False))
    scored = docs.select("doc_id", held_out.alias("held_out"), quality.assess(F.col("text"), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= quality.THRESHOLD).cast("int"))


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document."""
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


_ALL = (
    op1_packing, op2_media_columns, op3_url_filters, op4_fingerprints, op5_language_id,
    op6_sharding, op7_byte_bpe, op8_chat_formatting, op9_quality, op10_simhash_near_dedup,
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """All queries of this subpackage by name."""
    return {f.__name__: f for f in _ALL}


#: Host, path and verdict of every page, by the rules of ``URL_RULES``.
_OP3_SQL = r"""
WITH parsed AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substring(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT page_id, translate(regexp_extract(coalesce(rest, ''), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(rest, ''), '^[^/?#]*([^?#]*)', 1) AS path FROM parsed
), rules(rule_host, rule_path, rule_verdict) AS (
  VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')
), fits AS (
  SELECT p.*, rule_host || rule_path AS rule, rule_verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule_host || rule_path) DESC NULLS LAST, length(rule_host) DESC) AS k
  FROM parts p LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict FROM fits WHERE k = 1
"""


def _escaped(column: str) -> str:
    """DuckDB SQL for the length of an escaped text."""
    out = f"replace({column}, '~', '~0')"
    for k, control in enumerate(chat.CONTROLS, 1):
        out = f"replace({out}, '{control}', '~{k}')"
    return f"length({out})"


#: Digests from the turns themselves; the formatted length by summing up the windows' turns.
_OP8_SQL = f"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{_PLANTED}' UNION ALL SELECT -1, 1, 'assistant', '{_PLANTED}'
), r AS (
  SELECT *, row_number() OVER w - 1 AS n, (strlen(text) + {chat.TOKEN_CHARS - 1}) // {chat.TOKEN_CHARS} + {chat.TURN_TOKENS} AS tok,
         {_escaped("role")} + {_escaped("text")} + 11 AS chars, coalesce(turn // {chat.BLOCK_TURNS}, -1) AS block FROM t WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text)
), p AS (
  SELECT *, coalesce(sum(tok) OVER (PARTITION BY conv_id, block ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         first(role) OVER w = 'system' AS sys, first(tok) OVER w AS sys_tok, first(chars) OVER w AS sys_chars FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY n)
), q AS (
  SELECT *, greatest(2, {chat.WINDOW_TOKENS - chat.HISTORY_TOKENS} - CASE WHEN sys THEN sys_tok ELSE 0 END) AS room, max(tok) OVER (PARTITION BY conv_id, block) AS longest FROM p
), s AS (
  SELECT *, room // 2 AS half, room - least(room // 2, longest) AS step FROM q
), w AS (
  SELECT *, (before // step) * 2 + CASE WHEN tok > half THEN 1 ELSE 0 END AS win FROM s
), f AS (
  SELECT conv_id, block, win, min(n) AS first, CASE WHEN any_value(sys) AND min(n) > 0 THEN any_value(sys_chars) ELSE 0 END AS extra FROM w GROUP BY conv_id, block, win
), h AS (
  SELECT f.conv_id, w.chars, sum(w.tok) OVER (PARTITION BY f.conv_id, f.first ORDER BY w.n DESC) AS upto
  FROM f CROSS JOIN range(1, {chat.HISTORY_TURNS + 1}) AS ago(k) JOIN w ON w.conv_id = f.conv_id AND w.n = f.first - ago.k AND NOT (w.sys AND w.n = 0)
), c AS (
  SELECT conv_id, sum(chars) AS chars FROM (
    SELECT conv_id, chars FROM w UNION ALL SELECT conv_id, extra FROM f UNION ALL SELECT conv_id, chars FROM h WHERE upto <= {chat.HISTORY_TOKENS}
  ) GROUP BY conv_id
), d AS (
  SELECT conv_id, count(*) AS n_turns, string_agg(role || chr(10) || text || chr(10), '' ORDER BY n) AS said, coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY n), '') AS loss
  FROM r GROUP BY conv_id
)
SELECT d.conv_id, n_turns, sha256(said) AS turns_sha256, CAST(length(loss) AS BIGINT) AS loss_chars, sha256(loss) AS loss_sha256, CAST(c.chars AS BIGINT) AS formatted_chars
FROM d JOIN c ON c.conv_id = d.conv_id
"""


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the queries that SQL can express."""
    return {"op3_url_filters": _OP3_SQL, "op8_chat_formatting": _OP8_SQL}
