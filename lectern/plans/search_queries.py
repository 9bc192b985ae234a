"""Search queries: matches in lines, incremental and wrap-around."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import lines, search
from lectern.plans.registry import cursor_sql, cursors, documents, longs, query

Q = "the"
_LINES = "l AS (SELECT doc_id, lang, generate_subscripts(ls, 1) - 1 AS line_idx, unnest(ls) AS line FROM (SELECT doc_id, lang, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))"


@query(f"WITH {_LINES} SELECT lang, count(*) AS n_lines FROM l WHERE strpos(lower(line), '{Q}') > 0 GROUP BY lang")
def search_count_by_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines with the query, by language."""
    rows = documents(spark, sf_dir).select("lang", F.explode(tx.lines_of(F.col("text"))).alias("line"))
    return rows.where(F.contains(F.lower("line"), F.lit(Q))).groupBy("lang").agg(F.count("*").alias("n_lines"))


@query(
    f"""WITH {_LINES} SELECT doc_id, line_idx, strpos(lower(line), '{Q}') - 1 AS first_start, strpos(lower(line), '{Q}') + 2 AS first_end,
  length(line) - (strpos(reverse(lower(line)), reverse('{Q}')) - 1) - 3 AS last_start, length(line) - (strpos(reverse(lower(line)), reverse('{Q}')) - 1) AS last_end
FROM l WHERE strpos(lower(line), '{Q}') > 0"""
)
def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First and last match of every line that has one."""
    found = search.matching_lines(documents(spark, sf_dir), Q)
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in found.columns[1:]])


@query(f"WITH {_LINES} SELECT doc_id, line_idx, CAST(len(string_split(lower(line), '{Q}')) - 1 AS BIGINT) AS n_matches, CAST(length(string_split(lower(line), '{Q}')[1]) AS BIGINT) AS first_start FROM l WHERE strpos(lower(line), '{Q}') > 0")
def search_all_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All matches of every line, as an extension of one match a line."""
    found = lines.line_rows(documents(spark, sf_dir)).select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), tx.find_all(F.col("line"), Q).alias("m"))
    return found.where(F.size("m") > 0).select("doc_id", "line_idx", F.size("m").cast("long").alias("n_matches"), F.get("m", F.lit(0)).cast("long").alias("first_start"))


_M = f"""m AS (SELECT k.doc_id, k.n, k.line AS pos, k.col, t.i, t.txt, strpos(lower(t.txt), '{Q}') - 1 AS s,
  length(t.txt) - (strpos(reverse(lower(t.txt)), reverse('{Q}')) - 1) - 3 AS e
  FROM k, (SELECT doc_id AS did, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS txt FROM d) t WHERE t.did = k.doc_id AND strpos(lower(t.txt), '{Q}') > 0)"""


@query(
    f"""WITH {cursor_sql()}, {_M}, f AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN i > pos THEN 0 ELSE 1 END, i) AS r FROM m),
b AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY CASE WHEN i < pos THEN 0 ELSE 1 END, i DESC) AS r FROM m)
SELECT f.doc_id, f.i AS next_line, f.s AS next_start, f.s + 3 AS next_end, b.i AS prev_line, b.e AS prev_start, b.e + 3 AS prev_end FROM f JOIN b ON f.doc_id = b.doc_id WHERE f.r = 1 AND b.r = 1"""
)
def search_next_wrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next and the previous match from the cursor's line, around the document's ends."""
    k = cursors(documents(spark, sf_dir))
    found = k.select("doc_id", search.next_match(F.col("ls"), F.col("line"), Q).alias("f"), search.next_match(F.col("ls"), F.col("line"), Q, forward=False).alias("b"))
    return found.where("f is not null").select("doc_id", *longs(F.col("f"), "next_", "line", "start", "end"), *longs(F.col("b"), "prev_", "line", "start", "end"))


@query(
    f"""WITH {cursor_sql()}, {_M},
h AS (SELECT doc_id, line AS i, strpos(lower(substring(cur, col + 1)), '{Q}') - 1 + col AS s, strpos(lower(substring(cur, col + 1)), '{Q}') > 0 AS ok FROM k),
g AS (SELECT doc_id, line AS i, col - (strpos(reverse(lower(substring(cur, 1, col))), reverse('{Q}')) - 1) - 3 AS s, strpos(reverse(lower(substring(cur, 1, col))), reverse('{Q}')) > 0 AS ok FROM k),
f AS (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY o, i) AS r FROM (SELECT doc_id, i, s, CASE WHEN i > pos THEN 1 ELSE 2 END AS o FROM m UNION ALL SELECT doc_id, i, s, 0 FROM h WHERE ok)),
b AS (SELECT doc_id, i, s, row_number() OVER (PARTITION BY doc_id ORDER BY o, i DESC) AS r FROM (SELECT doc_id, i, s, CASE WHEN i < pos THEN 1 ELSE 2 END AS o FROM m UNION ALL SELECT doc_id, i, s, 0 FROM g WHERE ok))
SELECT f.doc_id, f.i AS fwd_line, f.s AS fwd_start, f.s + 3 AS fwd_end, b.i AS back_line, b.s AS back_start, b.s + 3 AS back_end FROM f JOIN b ON f.doc_id = b.doc_id WHERE f.r = 1 AND b.r = 1"""
)
def search_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What incremental search shows from the cursor, forward and backward."""
    k = cursors(documents(spark, sf_dir))
    args = F.col("ls"), F.col("line"), F.col("col"), Q
    found = k.select("doc_id", search.preview_match(*args).alias("f"), search.preview_match(*args, forward=False).alias("b"))
    return found.where("f is not null").select("doc_id", *longs(F.col("f"), "fwd_", "line", "start", "end"), *longs(F.col("b"), "back_", "line", "start", "end"))


@query(
    rf"""WITH {cursor_sql()} SELECT doc_id, nullif(regexp_extract(substring(cur, 1, col), '[\p{{L}}\p{{N}}_]*$') || regexp_extract(substring(cur, col + 1), '^[\p{{L}}\p{{N}}_]*'), '') AS word
FROM k WHERE regexp_matches(substring(cur, col + 1, 1), '[\p{{L}}\p{{N}}_]')"""
)
def word_under_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word under every cursor that stands on one."""
    return cursors(documents(spark, sf_dir)).select("doc_id", search.word_under(F.col("cur"), F.col("col")).alias("word")).where("word is not null")


@query(f"WITH {_LINES} SELECT doc_id, line_idx, strpos(lower(line), '{Q}') > 0 AS has_match, NOT regexp_matches(line, '\\S') AS is_blank, CAST(len(regexp_extract_all(line, '[\\p{{L}}\\p{{N}}_]')) AS BIGINT) AS word_chars FROM l")
def line_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether lines match or are blank, and their word characters."""
    rows, line = lines.line_rows(documents(spark, sf_dir)), F.col("line")
    kept = F.length(F.regexp_replace(line, r"[^\p{IsAlphabetic}\p{N}_]", ""))
    return rows.select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), F.contains(F.lower(line), F.lit(Q)).alias("has_match"), tx.is_blank(line).alias("is_blank"), kept.cast("long").alias("word_chars"))


@query(
    f"""WITH {_LINES} SELECT doc_id, line_idx, substring(line, 1, strpos(lower(line), '{Q}') - 1) AS before, substring(line, strpos(lower(line), '{Q}'), 3) AS "match",
  substring(line, strpos(lower(line), '{Q}') + 3) AS after FROM l WHERE strpos(lower(line), '{Q}') > 0"""
)
def match_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matching lines in three pieces around their first match."""
    rows = lines.line_rows(documents(spark, sf_dir)).withColumn("s", tx.find_first(F.col("line"), Q)).where("s is not null")
    pieces = rows.select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), search.segments(F.col("line"), F.col("s"), F.col("s") + len(Q)).alias("p"))
    return pieces.select("doc_id", "line_idx", "p.before", "p.match", "p.after")
