"""Queries on lines, layout and viewports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import layout, lines, viewport
from lectern.plans.registry import CHAPTERS, chapters, cursor_sql, cursors, documents, longs, query, table

W = layout.WIDTH

_JUSTIFY = f"""WITH p AS (
  SELECT doc_id, unnest(string_split(text, chr(10) || chr(10))) AS par, generate_subscripts(string_split(text, chr(10) || chr(10)), 1) AS pi FROM (SRC)
), w AS (
  SELECT doc_id, pi, list_filter(regexp_split_to_array(par, '\\s+'), lambda x: x <> '') AS ws FROM p
), s AS (
  SELECT doc_id, pi, coalesce(flatten(list_transform(ws, lambda x: list_transform(range(0, length(x), {W}), lambda i: substring(x, i + 1, {W})))), []) AS ws FROM w
), f AS (
  SELECT doc_id, pi, list_reduce(ws, lambda a, x: CASE
      WHEN len(a.cur) = 0 THEN {{'done': a.done, 'cur': [x], 'sz': strlen(x)}}
      WHEN a.sz + len(a.cur) + strlen(x) <= {W} THEN {{'done': a.done, 'cur': list_append(a.cur, x), 'sz': a.sz + strlen(x)}}
      ELSE {{'done': list_append(a.done, a.cur), 'cur': [x], 'sz': strlen(x)}} END,
    {{'done': CAST([] AS VARCHAR[][]), 'cur': CAST([] AS VARCHAR[]), 'sz': CAST(0 AS BIGINT)}}) AS r FROM s
), g AS (
  SELECT doc_id, pi, list_concat(list_transform(r.done, lambda ws: {{'ws': ws, 'full': true}}),
    CASE WHEN len(r.cur) > 0 THEN [{{'ws': r.cur, 'full': false}}] ELSE [] END, [{{'ws': CAST([] AS VARCHAR[]), 'full': false}}]) AS ls FROM f
), h AS (
  SELECT doc_id, pi, unnest(ls) AS l, generate_subscripts(ls, 1) AS li FROM g
), t AS (
  SELECT doc_id, pi, li, l.ws AS ws, len(l.ws) AS n, {W} - list_sum(list_transform(l.ws, lambda x: strlen(x))) AS room, l.full AS fl FROM h
)
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pi, li) - 1 AS line_idx,
  CASE WHEN NOT fl OR n = 1 OR room <= 0 THEN array_to_string(ws, ' ')
       ELSE array_to_string(list_transform(ws, lambda x, j: x || CASE WHEN j = n THEN '' ELSE repeat(' ', CAST(room // (n - 1) + CASE WHEN j <= room % (n - 1) THEN 1 ELSE 0 END AS BIGINT)) END), '') END AS line
FROM t"""


@query(_JUSTIFY.replace("SRC", "SELECT doc_id, text FROM documents WHERE text IS NOT NULL"))
def justify_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document justified at the default width."""
    return layout.justify(documents(spark, sf_dir)).select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), "line")


@query(_JUSTIFY.replace("SRC", CHAPTERS))
def justify_chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Books of several paragraphs justified."""
    return layout.justify(chapters(spark, sf_dir)).select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), "line")


@query(f"SELECT doc_id, md5(text) AS text_md5, CAST(strlen(text) AS BIGINT) AS n_bytes FROM ({CHAPTERS})")
def chapter_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chapters joined in reading order by blank lines."""
    return chapters(spark, sf_dir).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"), F.octet_length("text").cast("long").alias("n_bytes"))


@query(f"SELECT doc_id, generate_subscripts(p, 1) - 1 AS para_idx, unnest(p) AS para FROM (SELECT doc_id, string_split(text, chr(10) || chr(10)) AS p FROM ({CHAPTERS}))")
def paragraph_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paragraphs of every book, empty ones kept."""
    return chapters(spark, sf_dir).select("doc_id", F.posexplode(tx.paragraphs(F.col("text"))).alias("para_idx", "para")).withColumn("para_idx", F.col("para_idx").cast("long"))


@query(
    r"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\s+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, md5(array_to_string(ws, ' ')) AS words_md5,
  md5(array_to_string(flatten(list_transform(ws, lambda x: list_transform(range(0, length(x), 5), lambda i: substring(x, i + 1, 5)))), ' ')) AS chunks_md5 FROM w"""
)
def hard_split_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document, and the tokens cut after five characters."""
    cut = documents(spark, sf_dir).select("doc_id", tx.words(F.col("text")).alias("ws"))
    digest = lambda ws: F.md5(F.encode(F.array_join(ws, " "), "UTF-8"))
    return cut.select("doc_id", F.size("ws").cast("long").alias("n_words"), digest(F.col("ws")).alias("words_md5"), digest(tx.hard_split(F.col("ws"), 5)).alias("chunks_md5"))


_RELATION = r"""l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_idx, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
r AS (SELECT *, CAST(strlen(line) AS BIGINT) AS n_bytes, CAST(coalesce(sum(strlen(line) + 1) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS abs_byte FROM l)"""


@query(f"WITH {_RELATION} SELECT doc_id, line_idx, abs_byte, n_bytes, CAST(length(line) AS BIGINT) AS n_chars, NOT regexp_matches(line, '\\S') AS is_blank FROM r")
def line_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where every line starts, in bytes, and its sizes."""
    found = lines.line_relation(documents(spark, sf_dir))
    return found.select("doc_id", *[F.col(c).cast("long").alias(c) for c in ("line_idx", "abs_byte", "n_bytes", "n_chars")], "is_blank")


@query(
    f"""WITH {_RELATION}, t AS (SELECT doc_id, CAST(strlen(text) AS BIGINT) AS nb FROM documents WHERE text IS NOT NULL),
a AS (SELECT doc_id, (doc_id * 37) % (nb + 1) AS abs_byte FROM t)
SELECT a.doc_id, a.abs_byte, min(r.line_idx) AS line, a.abs_byte - min(r.abs_byte) AS byte_col FROM a JOIN r ON a.doc_id = r.doc_id AND a.abs_byte <= r.abs_byte + r.n_bytes GROUP BY a.doc_id, a.abs_byte"""
)
def offset_to_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line and byte column of one absolute offset in every document."""
    docs = documents(spark, sf_dir)
    asked = docs.select("doc_id", (F.col("doc_id") * 37 % (F.octet_length("text") + 1)).cast("long").alias("abs_byte"))
    found = lines.to_positions(asked, lines.line_index(docs))
    return found.select("doc_id", "abs_byte", F.col("line").cast("long").alias("line"), F.col("byte_col").cast("long").alias("byte_col"))


@query(
    f"""WITH {cursor_sql()} SELECT doc_id, line, col,
  CAST(coalesce(list_sum(list_transform(ls[:line], lambda x: strlen(x) + 1)), 0) + strlen(substring(cur, 1, col)) AS BIGINT) AS abs_byte FROM k"""
)
def position_to_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The absolute byte offset of every document's cursor."""
    k = cursors(documents(spark, sf_dir))
    return k.select("doc_id", F.col("line").cast("long").alias("line"), F.col("col").cast("long").alias("col"), lines.offset_of(F.col("ls"), F.col("line"), F.col("col")).alias("abs_byte"))


@query("SELECT doc_id, md5(text) AS text_md5 FROM documents WHERE text IS NOT NULL")
def rejoined_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts cut into lines and put together again."""
    return lines.join_lines(lines.line_rows(documents(spark, sf_dir))).select("doc_id", F.md5(F.encode("text", "UTF-8")).alias("text_md5"))


@query(
    r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_idx, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))
SELECT doc_id, line_idx, CAST(len(regexp_extract_all(line, '[\p{L}\p{N}_]+')) AS BIGINT) AS words, CAST(len(regexp_extract_all(line, '[^\p{L}\p{N}_\s]+')) AS BIGINT) AS marks,
  md5(array_to_string(regexp_extract_all(line, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+'), ' ')) AS runs_md5
FROM l WHERE regexp_matches(line, '\S')"""
)
def word_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of word and punctuation characters, counted and digested per line."""
    cut = lines.line_rows(documents(spark, sf_dir)).select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), lines.runs_of(F.col("line")).alias("parts"))
    runs = cut.select("doc_id", "line_idx", F.filter("parts", lambda x, k: k % 2 == 1).alias("runs")).where(F.size("runs") > 0)
    words = F.size(F.filter("runs", lambda x: x.rlike(f"^{tx.WORD}"))).cast("long")
    return runs.select("doc_id", "line_idx", words.alias("words"), (F.size("runs") - words).alias("marks"), F.md5(F.encode(F.array_join("runs", " "), "UTF-8")).alias("runs_md5"))


@query(
    r"""WITH l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_idx, unnest(ls) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
r AS (SELECT doc_id, line_idx, list_filter(regexp_extract_all(line, '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]+|\s+'), lambda x: true) AS ps FROM l),
w AS (SELECT doc_id, line_idx, generate_subscripts(ps, 1) AS j, unnest(ps) AS word, ps FROM r)
SELECT doc_id, line_idx, word, CAST(list_sum(list_transform(ps[:j], lambda x: length(x))) - length(word) AS BIGINT) AS start_char, regexp_matches(word, '^[\p{L}\p{N}_]') AS is_word FROM w WHERE regexp_matches(word, '^\S') AND length(word) > 9"""
)
def long_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the runs of ten characters and more are."""
    found = lines.word_rows(documents(spark, sf_dir)).where(F.length("word") > 9)
    return found.select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), "word", F.col("start_char").cast("long").alias("start_char"), (F.col("kind") == "word").alias("is_word"))


@query(
    """WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CAST(unnest(range(0, 9)) AS BIGINT) AS "row", coalesce(ls[unnest(range(0, 9)) + 3], '') AS line FROM l"""
)
def viewport_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a screen of ten rows shows from the third line on, blank past the end."""
    shown = viewport.viewport(lines.line_rows(documents(spark, sf_dir)), 2, 10)
    return shown.select("doc_id", F.col("row").cast("long").alias("row"), "line")


@query(
    f"""WITH {cursor_sql()}, o AS (SELECT *, line - 9 AS raw FROM k)
SELECT doc_id, CASE WHEN raw < 0 THEN 0 WHEN raw + 19 > n THEN greatest(n - 19, 0) ELSE raw END AS c_offset,
  greatest(line - CASE WHEN raw < 0 THEN 0 WHEN raw + 19 > n THEN greatest(n - 19, 0) ELSE raw END, 0) AS c_cursor_y,
  least(line * 2, n - 1) AS o_line, greatest(least(line * 2, n - 1) - 9, 0) AS o_offset, least(CASE WHEN least(line * 2, n - 1) < 9 THEN least(line * 2, n - 1) ELSE 9 END, 18) AS o_cursor_y FROM o"""
)
def centered_views(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Views that centre the cursor's line, bounded and with overscroll, on twenty rows."""
    k = cursors(documents(spark, sf_dir))
    c = viewport.centered(F.col("line"), F.col("n"), F.lit(20))
    o = viewport.overscrolled(F.col("line") * 2, F.col("n"), F.lit(19))
    return k.select("doc_id", *longs(c, "c_", "offset", "cursor_y"), *longs(o, "o_", "line", "offset", "cursor_y"))


@query(
    f"""WITH {cursor_sql()} SELECT doc_id, line AS top, least(line + 9, n - 1) AS middle, least(line + 18, n - 1) AS bottom,
  least(line + 16, n - 1) AS page_down, greatest(line - 16, 0) AS page_up, least(line + 9, n - 1) AS half_down, greatest(line - 9, 0) AS half_up FROM k"""
)
def screen_motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Screen positions and page motions on a screen of twenty rows that starts at the cursor's line."""
    k = cursors(documents(spark, sf_dir))
    line, n, h = F.col("line"), F.col("n"), F.lit(20)
    names = {"H": "top", "M": "middle", "L": "bottom"}
    pages = {"page_down": (True, False), "page_up": (False, False), "half_down": (True, True), "half_up": (False, True)}
    return k.select(
        "doc_id", *[viewport.screen_line(line, n, h, w).alias(a) for w, a in names.items()], *[viewport.page(line, n, F.lit(19), d, half).alias(a) for a, (d, half) in pages.items()]
    )


@query(
    r"""SELECT page_id, trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html,
  '(?is)<!--.*?-->', '', 'g'), '(?is)<script\b.*?</script\s*>', '', 'g'), '(?is)<style\b.*?</style\s*>', '', 'g'), '(?i)<body\b', '</head><body', 'g'), '(?is)<head\b.*?</head\s*>', '', 'g'), '(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/blockquote)\b[^>]*>', chr(10), 'g'),
  '<[^>]*>', '', 'g'), '&nbsp;', ' ', 'g'), '&lt;', '<', 'g'), '&gt;', '>', 'g'), '&amp;', '&', 'g'), ' ' || chr(10)) AS text FROM pages"""
)
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as plain text by the pattern chain."""
    from lectern.sources.html import strip_tags

    return table(spark, sf_dir, "pages").select("page_id", strip_tags(F.col("html")).alias("text"))


@query()
def html_to_text_parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as plain text by the tolerant parser."""
    from lectern.sources.html import html_text

    return table(spark, sf_dir, "pages").select("page_id", html_text(F.col("html")).alias("text"))
