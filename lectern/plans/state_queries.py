"""Queries on highlights, bookmarks, progress and the line tools."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.operators import lines, spans, state, tools, viewport
from lectern.plans.registry import documents, longs, query, table
from lectern.session import shared_folder
from lectern.sources import logs

#: Line items as highlights: document, start below a thousand, length by quantity.
_H = "h AS (SELECT DISTINCT l_orderkey AS doc, l_partkey % 1000 AS s, l_partkey % 1000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem)"
_R = "r AS (SELECT DISTINCT l_orderkey AS doc, l_suppkey * 13 % 1000 AS rs, l_suppkey * 13 % 1000 + 120 AS re FROM lineitem)"


def _highlights(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_partkey") % 1000
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end")).distinct()


def _ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_suppkey") * 13 % 1000
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), start.alias("r_start"), (start + 120).alias("r_end")).distinct()


@query('WITH a AS (SELECT l_orderkey AS doc, l_partkey % 1000 AS s, l_partkey % 1000 + CAST(l_quantity AS BIGINT) AS e FROM lineitem) SELECT doc, s AS "start", e AS "end", min(n) AS seen FROM (SELECT *, 1 AS n FROM a) GROUP BY ALL')
def highlight_add(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All highlights added one set after the other: exact duplicates once."""
    start = F.col("l_partkey") % 1000
    items = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("doc"), start.alias("start"), (start + F.col("l_quantity").cast("long")).alias("end"), F.lit(1).alias("seen"), "l_linenumber")
    return spans.add_highlights(items.where("l_linenumber <= 2").drop("l_linenumber"), items.where("l_linenumber > 2").drop("l_linenumber"))


@query(f'WITH {_H}, {_R} SELECT h.doc, rs AS r_start, re AS r_end, s AS "start", e AS "end" FROM h JOIN r ON h.doc = r.doc AND s < re AND e > rs')
def highlight_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of ranges and highlights that overlap."""
    return spans.overlapping(_highlights(spark, sf_dir), _ranges(spark, sf_dir), 64)


@query(f'WITH {_H}, {_R} SELECT doc, s AS "start", e AS "end", EXISTS (SELECT 1 FROM r WHERE r.doc = h.doc AND s < re AND e > rs) AS removed FROM h')
def highlight_remove(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights that ranges take away, and those that stay."""
    h, r = _highlights(spark, sf_dir), _ranges(spark, sf_dir)
    return spans.remove_overlapping(h, r, 64).withColumn("removed", F.lit(False)).unionByName(spans.removed_by(h, r, 64).withColumn("removed", F.lit(True)))


@query(f'WITH {_H} SELECT doc, s AS "start", e AS "end" FROM h WHERE s < 150 AND e > 100')
def highlight_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights in one range of any document."""
    return spans.in_range(_highlights(spark, sf_dir), 100, 150)


@query(
    f"""WITH {_H}, o AS (SELECT *, max(e) OVER (PARTITION BY doc ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS pe FROM h),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT doc, min(s) AS "start", max(e) AS "end" FROM i GROUP BY doc, g"""
)
def highlight_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Overlapping and touching highlights put together."""
    return spans.merged(_highlights(spark, sf_dir), "doc")


@query(
    f"""WITH {_H}, {_R}, u AS (SELECT doc, 0 AS rank, rs AS s, re AS e FROM r UNION ALL SELECT doc, 1, s, e FROM h),
o AS (SELECT *, greatest(s, coalesce(max(e) OVER (PARTITION BY doc ORDER BY s, rank, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), s)) AS b FROM u)
SELECT doc, CAST(rank AS BIGINT) AS rank, b AS seg_start, e AS seg_end FROM o WHERE b < e"""
)
def highlight_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Selections and highlights laid over each other without overlap."""
    chosen = _ranges(spark, sf_dir).select("doc", F.lit(0).cast("long").alias("rank"), F.col("r_start").alias("start"), F.col("r_end").alias("end"))
    return spans.layered(chosen.unionByName(_highlights(spark, sf_dir).withColumn("rank", F.lit(1).cast("long"))), "doc")


@query(
    """WITH e AS (SELECT user_id AS doc, list({'s': event_id % 1000, 'e': event_id % 1000 + 1 + CAST(floor(value) AS BIGINT) % 40} ORDER BY ts, event_id) AS es FROM events GROUP BY user_id),
r AS (SELECT doc, list_reduce(es, lambda a, x: CASE WHEN len(list_filter(a, lambda h: h.e <= x.s OR h.s >= x.e)) = len(a) THEN list_append(a, x) ELSE list_filter(a, lambda h: h.e <= x.s OR h.s >= x.e) END, CAST([] AS STRUCT(s BIGINT, e BIGINT)[])) AS hs FROM e)
SELECT doc, unnest(hs).s AS "start", unnest(hs).e AS "end" FROM r"""
)
def highlight_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights left after every user's toggles in order."""
    start = F.col("event_id") % 1000
    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc"), F.struct("ts", "event_id").alias("seq"), start.alias("start"), (start + 1 + F.floor("value") % 40).alias("end"))
    return spans.toggled(events)


_LH = """l AS (SELECT doc_id AS doc, line_idx, n_bytes, coalesce(sum(n_bytes + 1) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a
  FROM (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_idx, strlen(unnest(ls)) AS n_bytes FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))),
h AS (SELECT doc_id AS doc, unnest([doc_id % 97, doc_id % 31 + 40, 400]) AS s, unnest([doc_id % 97 + 60, doc_id % 31 + 90, 900]) AS e FROM documents WHERE text IS NOT NULL),
x AS (SELECT l.doc, line_idx, greatest(s - a, 0) AS s, least(e - a, n_bytes) AS e FROM l JOIN h ON h.doc = l.doc AND n_bytes > 0 AND s < a + n_bytes AND e > a)"""


def _marked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = documents(spark, sf_dir)
    i = F.col("doc_id")
    trio = F.array(*[F.struct(s.cast("long").alias("start"), e.cast("long").alias("end")) for s, e in ((i % 97, i % 97 + 60), (i % 31 + 40, i % 31 + 90), (F.lit(400), F.lit(900)))])
    rows = docs.select(i.alias("doc"), F.explode(trio).alias("h")).select("doc", "h.start", "h.end")
    return lines.line_index(docs).withColumnRenamed("doc_id", "doc"), rows


@query(
    f"""WITH {_LH}, o AS (SELECT *, max(e) OVER w AS pe FROM x WINDOW w AS (PARTITION BY doc, line_idx ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
i AS (SELECT *, sum(CASE WHEN pe IS NULL OR s > pe THEN 1 ELSE 0 END) OVER (PARTITION BY doc, line_idx ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT doc, line_idx, CAST(min(s) AS BIGINT) AS "start", CAST(max(e) AS BIGINT) AS "end" FROM i GROUP BY doc, line_idx, g"""
)
def highlight_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights clipped to lines and merged there."""
    found = spans.clipped(*_marked(spark, sf_dir))
    return found.select("doc", *[F.col(c).cast("long").alias(c) for c in ("line_idx", "start", "end")])


@query(f"WITH {_LH} SELECT DISTINCT doc, line_idx FROM x WHERE e > s")
def lines_with_highlight(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that some highlight touches."""
    return spans.lines_with_highlight(*_marked(spark, sf_dir)).select("doc", F.col("line_idx").cast("long").alias("line_idx"))


@query(
    """WITH l AS (SELECT doc_id AS doc, generate_subscripts(ls, 1) - 1 AS line_idx, length(unnest(ls)) AS nc, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL)),
s AS (SELECT *, doc % n AS l0, least(doc % n + 2, n - 1) AS l1, doc % 11 AS c0, doc % 11 + 9 AS c1 FROM l)
SELECT doc, line_idx, CAST(CASE WHEN line_idx = l0 THEN least(c0, nc) ELSE 0 END AS BIGINT) AS "start", CAST(CASE WHEN line_idx = l1 THEN least(c1, nc) ELSE nc END AS BIGINT) AS "end" FROM s WHERE line_idx BETWEEN l0 AND l1"""
)
def selection_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a selection of up to three lines covers on each."""
    docs = documents(spark, sf_dir)
    n, i = F.size(tx.lines_of(F.col("text"))), F.col("doc_id")
    first = (i % n).cast("int")
    chosen = docs.select(i.alias("doc"), first.alias("l0"), (i % 11).alias("c0"), F.least(first + 2, n - 1).alias("l1"), (i % 11 + 9).alias("c1"))
    rows = lines.line_rows(docs).select(F.col("doc_id").alias("doc"), "line_idx", F.length("line").alias("n_chars"))
    found = spans.selection_columns(rows, chosen)
    return found.select("doc", *[F.col(c).cast("long").alias(c) for c in ("line_idx", "start", "end")])


# --- bookmarks and progress: events as the log -----------------------------------------------------


def _marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return e.select(F.col("user_id").alias("doc"), F.substring("event_type", 1, 1).alias("mark"), F.floor("value").alias("line"), (F.col("event_id") % 80).alias("col"), "ts", F.col("event_id").alias("seq"))


_MK = "m AS (SELECT user_id AS doc, substring(event_type, 1, 1) AS mark, CAST(floor(value) AS BIGINT) AS line, event_id % 80 AS col, ts, event_id AS seq FROM events)"


@query(f"WITH {_MK} SELECT doc, mark, arg_max(line, {{'t': ts, 's': seq}}) AS line, arg_max(col, {{'t': ts, 's': seq}}) AS col FROM m WHERE regexp_matches(mark, '^[a-z]$') GROUP BY doc, mark")
def bookmark_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every mark as last set."""
    return state.latest_marks(_marks(spark, sf_dir)).select("doc", "mark", "line", "col")


@query(
    f"""WITH {_MK}, b AS (SELECT doc, mark, arg_max(line, {{'t': ts, 's': seq}}) AS line, arg_max(col, {{'t': ts, 's': seq}}) AS col FROM m WHERE seq % 3 = 0 GROUP BY doc, mark)
SELECT m.seq, m.doc, m.mark, coalesce(b.line, m.line) AS to_line, coalesce(b.col, m.col) AS to_col, b.line IS NOT NULL AS moved FROM m LEFT JOIN b ON b.doc = m.doc AND b.mark = m.mark WHERE m.seq % 3 <> 0"""
)
def bookmark_jump(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where jumps to marks lead."""
    e = _marks(spark, sf_dir)
    found = state.jump_to_mark(e.where("seq % 3 <> 0"), state.latest_marks(e.where("seq % 3 = 0")))
    return found.select("seq", "doc", "mark", "to_line", "to_col", "moved")


@query(f"WITH {_MK} SELECT seq, doc, lag(line) OVER w AS back_line, lag(col) OVER w AS back_col FROM m WINDOW w AS (PARTITION BY doc ORDER BY ts, seq)")
def jump_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The position before every jump."""
    return state.jump_back(_marks(spark, sf_dir), "doc", ["ts", "seq"]).select("seq", "doc", "back_line", "back_col")


def _progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    half = F.col("event_id") % 2 == 0
    return e.select(
        F.col("user_id").alias("doc"), "ts", F.col("event_id").alias("seq"), F.floor("value").alias("offset"), F.lit(600).cast("long").alias("total_lines"),
        F.when(half, F.greatest(F.floor("value") - 10, F.lit(0))).alias("viewport_offset"), F.when(half, F.least(F.floor("value"), F.lit(10))).alias("cursor_y"),
    )


_PG = """p AS (SELECT user_id AS doc, ts, event_id AS seq, CAST(floor(value) AS BIGINT) AS o, CASE WHEN event_id % 2 = 0 THEN greatest(CAST(floor(value) AS BIGINT) - 10, 0) END AS vo, CASE WHEN event_id % 2 = 0 THEN least(CAST(floor(value) AS BIGINT), 10) END AS cy FROM events)"""


@query(f"WITH {_PG} SELECT doc, max(struct_pack(t := ts, s := seq, o := o)).o AS \"offset\", max(struct_pack(t := ts, s := seq, o := o)).s AS seq FROM p GROUP BY doc")
def latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last progress of every document."""
    return state.latest_progress(_progress(spark, sf_dir)).select("doc", "offset", "seq")


@query(f"WITH {_PG} SELECT seq, round(CAST(o AS DOUBLE) / 600 * 100, 6) AS stored, CAST(least(round(CAST(least(o + 1, 600) AS DOUBLE) / 600 * 100), 100) AS BIGINT) AS shown FROM p")
def progress_percent(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored and shown percentages."""
    o, n = F.col("offset"), F.col("total_lines")
    return _progress(spark, sf_dir).select("seq", F.round(state.stored_percentage(o, n), 6).alias("stored"), state.shown_percentage(o, n).cast("long").alias("shown"))


@query(f"WITH {_PG}, l AS (SELECT *, row_number() OVER w AS k, lag(o // 50) OVER w AS po FROM p WINDOW w AS (PARTITION BY doc ORDER BY ts, seq)) SELECT seq, doc, o // 50 AS block FROM l WHERE k = 1 OR po <> o // 50")
def progress_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that moved to another block of fifty lines."""
    e = _progress(spark, sf_dir).withColumn("block", F.floor(F.col("offset") / 50))
    return state.changes(e, "doc", ["ts", "seq"], "block").select("seq", "doc", "block")


@query(
    f"""WITH {_PG} SELECT seq, CASE WHEN vo IS NOT NULL THEN vo WHEN o < 9 THEN 0 WHEN o >= 591 THEN 581 ELSE o - 9 END AS "offset",
  CASE WHEN vo IS NOT NULL THEN cy ELSE o - CASE WHEN o < 9 THEN 0 WHEN o >= 591 THEN 581 ELSE o - 9 END END AS cursor_y FROM p"""
)
def progress_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The view that every saved position opens with, on twenty rows."""
    p = _progress(spark, sf_dir)
    view = viewport.restored(F.struct("offset", "viewport_offset", "cursor_y"), F.col("total_lines"), F.lit(20))
    return p.select("seq", *longs(view, "", "offset", "cursor_y"))


@query("SELECT doc_id, substring(md5(text), 1, 16) AS doc_hash FROM documents WHERE text IS NOT NULL")
def document_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's key."""
    return documents(spark, sf_dir).select("doc_id", tx.text_hash(F.col("text")).alias("doc_hash"))


# --- tools ------------------------------------------------------------------------------------------

_L = "l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line_idx, unnest(ls) AS line, len(ls) AS n FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))"
_ALLOWED = ", ".join(f"'{x}'" for x in tools.ALLOWED)


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.line_rows(documents(spark, sf_dir)).withColumn("line_idx", F.col("line_idx").cast("long"))


@query(
    rf"""WITH c AS (SELECT doc_id, (['ls', 'cat', 'rm', 'grep -i', 'Get-Content', 'sudo'])[doc_id % 6 + 1] || ' ' || CASE WHEN doc_id % 5 < 3 THEN lang ELSE replace(text, chr(10), ' ') END || (['', ' | wc', ' $HOME', ' a;b'])[doc_id % 4 + 1] AS cmd FROM documents WHERE text IS NOT NULL),
p AS (SELECT *, list_filter(regexp_split_to_array(cmd, '\s+'), lambda x: x <> '') AS ps FROM c)
SELECT doc_id, ps[1] IN ({_ALLOWED}) AND len(ps) <= 50 AND len(list_filter(ps[2:], lambda x: regexp_matches(x, '[|&;`$()<>\\*?]') OR strlen(x) > 1000)) = 0 AS allowed FROM p"""
)
def command_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which command lines made from documents pass the guard."""
    i = F.col("doc_id")
    pick = lambda *xs: F.get(F.array(*map(F.lit, xs)), (i % len(xs)).cast("int"))
    cmd = F.concat(pick("ls", "cat", "rm", "grep -i", "Get-Content", "sudo"), F.lit(" "), F.when(i % 5 < 3, F.col("lang")).otherwise(F.replace("text", F.lit("\n"), F.lit(" "))), pick("", " | wc", " $HOME", " a;b"))
    return documents(spark, sf_dir).select("doc_id", tools.command_allowed(cmd).alias("allowed"))


@query(f"WITH {_L} SELECT doc_id, line_idx, regexp_matches(line, 'th.r') AS hit, regexp_matches(line, '(?i)THE\\s') AS hit_any_case FROM l WHERE regexp_matches(line, 'th.r') OR regexp_matches(line, '(?i)THE\\s')")
def tool_grep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that match patterns."""
    line = F.col("line")
    both = _lines(spark, sf_dir).select("doc_id", "line_idx", tools.matches(line, "th.r").alias("hit"), tools.matches(line, r"THE\s", ignore_case=True).alias("hit_any_case"))
    return both.where("hit or hit_any_case")


@query(f"WITH {_L} SELECT doc_id, line_idx, CASE WHEN line <> '' THEN count(CASE WHEN line <> '' THEN 1 END) OVER (PARTITION BY doc_id ORDER BY line_idx) END AS number FROM l")
def tool_nl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers of lines that aren't empty."""
    return tools.nl(documents(spark, sf_dir)).select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), "number")


@query(f"WITH {_L} SELECT doc_id, line_idx, line_idx < 3 AS in_head, line_idx >= n - 3 AS in_tail FROM l WHERE line_idx < 3 OR line_idx >= n - 3")
def tool_head_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first and the last three lines."""
    both = tools.numbered(documents(spark, sf_dir)).select("doc_id", F.col("line_idx").cast("long").alias("line_idx"), tools.in_head(3).alias("in_head"), tools.in_tail(3).alias("in_tail"))
    return both.where("in_head or in_tail")


@query(
    f"""WITH {_L}, w AS (SELECT *, regexp_extract(line, '^\\S*') AS word FROM l), p AS (SELECT *, lag(word) OVER (PARTITION BY doc_id ORDER BY line_idx) AS pw FROM w),
r AS (SELECT *, sum(CASE WHEN pw IS NULL OR pw <> word THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY line_idx ROWS UNBOUNDED PRECEDING) AS g FROM p)
SELECT doc_id, min(line_idx) AS line_idx, first(word) AS line, count(*) AS n FROM r GROUP BY doc_id, g"""
)
def tool_uniq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of lines with the same first word."""
    found = tools.uniq(documents(spark, sf_dir), lambda x: F.regexp_extract(x, r"^\S*", 0))
    return found.withColumn("line_idx", F.col("line_idx").cast("long"))


@query(f"WITH {_L} SELECT doc_id, line_idx, CASE WHEN strpos(line, ' ') = 0 THEN line ELSE coalesce(string_split(line, ' ')[2], '') END AS field, translate(line, 'aeiou', '12345') AS translated FROM l")
def tool_cut_tr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second fields, and vowels as digits."""
    line = F.col("line")
    return _lines(spark, sf_dir).select("doc_id", "line_idx", tools.field(line, 2).alias("field"), tools.tr(line, "aeiou", "12345").alias("translated"))


@query(f"WITH {_L} SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY line, line_idx) - 1 AS rank, line FROM l")
def tool_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's lines in byte order."""
    return tools.sorted_lines(documents(spark, sf_dir)).withColumn("rank", F.col("rank").cast("long"))


@query("SELECT doc_id, CAST(length(text) - length(replace(text, chr(10), '')) AS BIGINT) AS lines, CAST(len(list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '')) AS BIGINT) AS words, CAST(strlen(text) AS BIGINT) AS bytes FROM documents WHERE text IS NOT NULL")
def tool_wc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line feeds, words and bytes."""
    return tools.wc(documents(spark, sf_dir))


def _plain(column: str) -> Column:
    return F.regexp_replace(column, r"[^\x00-\x7F]", "?")


def _ascii(column: str) -> str:
    """SQL for a text with a question mark for every character beyond ASCII, as DuckDB's edit distance counts bytes."""
    return f"regexp_replace({column}, '[^\\x00-\\x7F]', '?', 'g')"


@query(
    f"""SELECT page_id, lower(regexp_extract(url, '\\.([^./\\\\]*)$', 1)) AS ext, NOT regexp_matches(url, '[|&;`$<>\\n\\r]') AS path_ok,
  CAST(levenshtein({_ascii('url')}, {_ascii('html')}) AS BIGINT) AS distance, regexp_matches(html, '\\S') AS has_content FROM pages"""
)
def source_guards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extensions, path guards, content guards and edit distances of pages."""
    from lectern.sources.files import extension, path_allowed

    return table(spark, sf_dir, "pages").select(
        "page_id", extension(F.col("url")).alias("ext"), path_allowed(F.col("url")).alias("path_ok"), F.levenshtein(_plain("url"), _plain("html")).cast("long").alias("distance"), (~tx.is_blank(F.col("html"))).alias("has_content")
    )


@query(f"WITH {_H} SELECT doc, s AS \"start\", e AS \"end\" FROM h WHERE doc NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F')")
def highlight_clear(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights left after those of all finished orders were cleared."""
    done = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("doc"))
    return spans.cleared(_highlights(spark, sf_dir), done)


_COMMANDS = "c AS (SELECT page_id, (['ls -l ', 'cat ', 'head -n5 ', 'tail ', 'pwd #', 'make ', 'grep -i a '])[page_id % 7 + 1] || replace(coalesce(url, ''), ' ', '') AS cmd FROM pages)"


@query(
    f"""WITH {_COMMANDS}, p AS (SELECT page_id, page_id % 7 AS k, cmd, list_filter(regexp_split_to_array(cmd, '\\s+'), lambda x: x <> '')[-1] AS arg FROM c)
SELECT page_id, CASE k WHEN 0 THEN 'Get-ChildItem' || CASE WHEN arg <> '-l' THEN ' -Path ' || arg ELSE '' END || ' | Format-Table Mode, LastWriteTime, Length, Name'
  WHEN 1 THEN 'Get-Content' || CASE WHEN arg <> 'cat' THEN ' ' || arg ELSE '' END WHEN 2 THEN 'Get-Content' || CASE WHEN arg <> '-n5' THEN ' ' || arg ELSE '' END || ' -First 5'
  WHEN 3 THEN 'Get-Content' || CASE WHEN arg <> 'tail' THEN ' ' || arg ELSE '' END || ' -Tail 10' WHEN 4 THEN 'Get-Location'
  WHEN 6 THEN CASE WHEN arg = 'a' THEN 'Select-String' ELSE 'Select-String -Pattern "a" -Path "' || arg || '" -CaseSensitive:$false' END ELSE cmd END AS translated FROM p"""
)
def command_translation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Commands on page addresses and their PowerShell counterparts."""
    name = F.get(F.array(*map(F.lit, ("ls -l ", "cat ", "head -n5 ", "tail ", "pwd #", "make ", "grep -i a "))), (F.col("page_id") % 7).cast("int"))
    command = F.concat(name, F.replace(F.coalesce("url", F.lit("")), F.lit(" "), F.lit("")))
    return table(spark, sf_dir, "pages").select("page_id", tools.translation(command).alias("translated"))


@query(
    f"""WITH b AS (SELECT item_id, {_ascii('text')} AS text FROM benchmark), p AS (SELECT item_id, text, lead(text) OVER (ORDER BY item_id) AS next FROM b)
SELECT item_id, CAST(levenshtein(text, next) AS BIGINT) AS distance, round(100 * (1 - levenshtein(text, next)::DOUBLE / greatest(length(text), length(next), 1)), 6) AS percent FROM p WHERE next IS NOT NULL"""
)
def text_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Edit distance of every benchmark text to the next one, whole, and the similarity in per cent."""
    # the benchmark is a fixed list of items, whatever the corpus
    after = table(spark, sf_dir, "benchmark").select("item_id", "text", F.lead("text").over(Window.orderBy("item_id")).alias("next")).where("next is not null")
    found = after.select("item_id", tx.similarity(_plain("text"), _plain("next")).alias("s"))
    return found.select("item_id", F.col("s.distance").cast("long").alias("distance"), F.round("s.percent", 6).alias("percent"))


# --- stored state, written and read back --------------------------------------------------------------


def _kept(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/state-{uuid.uuid4().hex}"


@query(f"WITH {_PG} SELECT CAST(doc AS VARCHAR) AS doc, epoch_us(ts) AS ts_us, o AS \"offset\", round(CAST(o AS DOUBLE) / 600 * 100, 6) AS percentage, vo AS viewport_offset, cy AS cursor_y FROM p")
def progress_log_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All progress events appended to the log and read back."""
    path = _kept(spark)
    logs.write_progress(_progress(spark, sf_dir), path)
    return logs.read_progress(spark, path).select("doc", F.unix_micros("ts").alias("ts_us"), "offset", F.round("percentage", 6).alias("percentage"), "viewport_offset", "cursor_y")


@query(f"WITH {_MK} SELECT CAST(doc AS VARCHAR) AS doc, mark, arg_max(line, {{'t': ts, 's': seq}}) AS line, arg_max(col, {{'t': ts, 's': seq}}) AS col FROM m WHERE regexp_matches(mark, '^[a-z]$') GROUP BY doc, mark")
def bookmark_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last marks of every document, stored a file each and read back."""
    path = _kept(spark)
    logs.write_bookmarks(state.latest_marks(_marks(spark, sf_dir)).select(F.col("doc").cast("string").alias("doc"), "mark", "line", "col"), path)
    return logs.read_bookmarks(spark, f"{path}/*").select(F.regexp_extract("file", "/doc=([^/]*)/", 1).alias("doc"), "mark", "line", "col")


@query("SELECT CAST(user_id AS VARCHAR) AS doc, event_id % 1000 AS \"start\", event_id % 1000 + 1 + CAST(floor(value) AS BIGINT) % 40 AS \"end\", event_id AS created_at FROM events")
def highlight_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights of every user, stored a file each and read back."""
    path, start = _kept(spark), F.col("event_id") % 1000
    rows = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("doc"), start.alias("start"), (start + 1 + F.floor("value") % 40).alias("end"), F.col("event_id").alias("created_at"))
    logs.write_highlights(rows, path)
    return logs.read_highlights(spark, f"{path}/*")
