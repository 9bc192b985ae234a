"""Queries on cursor motions and text objects: one cursor in every document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.operators import motion, textobj
from lectern.plans.registry import CHAPTERS, at, between, chapters, cursor_sql, cursors, documents, longs, query, table

W, P = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_\s]"
PAGES = "SELECT page_id AS doc_id, html AS text FROM pages WHERE html IS NOT NULL"


def _args():  # noqa: ANN202
    return F.col("ls"), F.col("line"), F.col("col")


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").where("html is not null").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"))


_NEXT = r"""nx AS (SELECT *, coalesce(list_position(list_transform(ls[line + 2:], lambda x: regexp_matches(x, '\S')), true), 0) AS p FROM k),
ns AS (SELECT *, CASE WHEN p > 0 THEN line + p ELSE line + 1 END AS ns_line, CASE WHEN p > 0 THEN length(regexp_extract(ls[line + p + 1], '^\s*')) ELSE 0 END AS ns_col FROM nx)"""


@query(
    rf"""WITH {cursor_sql()}, {_NEXT}, w AS (SELECT *, col + length(regexp_extract(substring(cur, col + 1), '^(?:{W}+|{P}+)?\s*')) AS s, col + length(regexp_extract(substring(cur, col + 1), '^\S*\s*')) AS b FROM ns)
SELECT doc_id, CASE WHEN s >= length(cur) AND line + 1 < n THEN ns_line ELSE line END AS small_line, CASE WHEN s >= length(cur) AND line + 1 < n THEN ns_col ELSE s END AS small_col,
  CASE WHEN b >= length(cur) AND line + 1 < n THEN ns_line ELSE line END AS big_line, CASE WHEN b >= length(cur) AND line + 1 < n THEN ns_col ELSE b END AS big_col FROM w"""
)
def word_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the next word, small and big."""
    k, a = cursors(documents(spark, sf_dir)), _args()
    return k.select("doc_id", motion.word_forward(*a).alias("s"), motion.word_forward(*a, big=True).alias("b")).select("doc_id", *at(F.col("s"), "small"), *at(F.col("b"), "big"))


@query(
    rf"""WITH {cursor_sql()}, w AS (SELECT *, regexp_extract(substring(cur, 1, col), '((?:{W}+|{P}+)\s*)$', 1) AS s, regexp_extract(substring(cur, 1, col), '(\S+\s*)$', 1) AS b, regexp_replace(ls[line], '\s+$', '') AS up FROM k),
v AS (SELECT *, length(up) - length(regexp_extract(up, '({W}+|{P}+)$', 1)) AS up_col FROM w)
SELECT doc_id, CASE WHEN col = 0 AND line > 0 THEN line - 1 ELSE line END AS small_line, CASE WHEN col = 0 AND line > 0 THEN up_col WHEN col = 0 THEN 0 WHEN s = '' THEN 0 ELSE col - length(s) END AS small_col,
  CASE WHEN col = 0 AND line > 0 THEN line - 1 ELSE line END AS big_line, CASE WHEN col = 0 AND line > 0 THEN up_col WHEN col = 0 THEN 0 WHEN b = '' THEN 0 ELSE col - length(b) END AS big_col FROM v"""
)
def word_back(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the word before, small and big."""
    k, a = cursors(documents(spark, sf_dir)), _args()
    return k.select("doc_id", motion.word_back(*a).alias("s"), motion.word_back(*a, big=True).alias("b")).select("doc_id", *at(F.col("s"), "small"), *at(F.col("b"), "big"))


@query(
    rf"""WITH {cursor_sql()}, {_NEXT}, w AS (SELECT *, col + length(regexp_extract(substring(cur, col + 1), '^\s*(?:{W}+|{P}+)?')) AS s, col + length(regexp_extract(substring(cur, col + 1), '^\s*\S*')) AS b, regexp_matches(substring(cur, col + 1), '\S') AS solid FROM ns)
SELECT doc_id, CASE WHEN length(cur) = 0 OR NOT solid THEN CASE WHEN line + 1 < n THEN ns_line ELSE line END ELSE line END AS small_line,
  CASE WHEN length(cur) = 0 THEN CASE WHEN line + 1 < n THEN ns_col ELSE col END WHEN NOT solid THEN CASE WHEN line + 1 < n THEN ns_col ELSE greatest(length(cur) - 1, 0) END ELSE s - 1 END AS small_col,
  CASE WHEN length(cur) = 0 AND line + 1 < n THEN ns_line ELSE line END AS big_line, CASE WHEN length(cur) = 0 THEN CASE WHEN line + 1 < n THEN ns_col ELSE col END ELSE b - 1 END AS big_col FROM w"""
)
def word_end(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the word's end, small and big."""
    k, a = cursors(documents(spark, sf_dir)), _args()
    return k.select("doc_id", motion.word_end(*a).alias("s"), motion.word_end(*a, big=True).alias("b")).select("doc_id", *at(F.col("s"), "small"), *at(F.col("b"), "big"))


@query(
    rf"""WITH {cursor_sql()}, {_NEXT}, u AS (SELECT *, regexp_replace(cur, '\s+$', '') AS up FROM ns)
SELECT doc_id, CASE WHEN line + 1 < n THEN ns_line ELSE n - 1 END AS next_line, CASE WHEN line + 1 < n THEN ns_col ELSE 0 END AS next_col, line AS end_line, length(up) - length(regexp_extract(up, '({W}+|{P}+)$', 1)) AS end_col FROM u"""
)
def line_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The next line's start and the last word of the cursor's line."""
    k = cursors(documents(spark, sf_dir))
    found = k.select("doc_id", motion.next_line_start(F.col("ls"), F.col("line") + 1).alias("s"), motion.previous_line_end(F.col("ls"), F.col("line")).alias("e"))
    return found.select("doc_id", *at(F.col("s"), "next"), *at(F.col("e"), "end"))


#: Sixty cursors in every document.
_MANY = 60
_MANY_SQL = f"""d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
c AS (SELECT doc_id, ls, CAST(len(ls) AS BIGINT) AS n, CAST(unnest(range(0, {_MANY})) AS BIGINT) AS c FROM d),
e AS (SELECT *, (doc_id + c * 7) % n AS line, ls[(doc_id + c * 7) % n + 1] AS cur FROM c),
k AS (SELECT *, CASE WHEN length(cur) = 0 THEN 0 ELSE (c * 13) % length(cur) END AS col FROM e)"""


def _many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, ls, cursors``: sixty cursors in each document's row."""
    cut = documents(spark, sf_dir).select("doc_id", F.split("text", "\n", -1).alias("ls"))

    def cursor(c: Column) -> Column:
        line = ((F.col("doc_id") + c * 7) % F.size("ls")).cast("int")
        size = F.length(F.get("ls", line))
        return F.struct(line.alias("line"), F.when(size == 0, 0).otherwise(c * 13 % F.greatest(size, F.lit(1))).cast("int").alias("col"))

    return cut.withColumn("cursors", F.transform(F.sequence(F.lit(0), F.lit(_MANY - 1)), cursor))


@query(
    rf"""WITH {_MANY_SQL}, {_NEXT}, w AS (SELECT *, col + length(regexp_extract(substring(cur, col + 1), '^(?:{W}+|{P}+)?\s*')) AS s FROM ns)
SELECT doc_id, c, line, col, CASE WHEN s >= length(cur) AND line + 1 < n THEN ns_line ELSE line END AS to_line, CASE WHEN s >= length(cur) AND line + 1 < n THEN ns_col ELSE s END AS to_col FROM w"""
)
def word_forward_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the next word from sixty cursors in every document."""
    k = _many(spark, sf_dir)
    moved = k.select("doc_id", "cursors", motion.each(F.col("cursors"), lambda line, col: motion.word_forward(F.col("ls"), line, col)).alias("to"))
    rows = moved.select("doc_id", F.posexplode(F.arrays_zip("cursors", "to")).alias("c", "x"))
    return rows.select("doc_id", F.col("c").cast("long").alias("c"), *longs(F.col("x.cursors"), "", "line", "col"), *longs(F.col("x.to"), "to_", "line", "col"))


_BLANKS = r"fl AS (SELECT *, list_transform(ls, lambda x: NOT regexp_matches(x, '\S')) AS b FROM k)"


@query(
    rf"""WITH {cursor_sql(CHAPTERS)}, {_BLANKS}, q AS (SELECT doc_id, n, line, generate_subscripts(b, 1) - 1 AS i, unnest(b) AS blank FROM fl),
f1 AS (SELECT doc_id, n, line, min(CASE WHEN blank AND i > line THEN i END) AS nb, max(CASE WHEN blank AND i < line THEN i END) AS pb FROM q GROUP BY ALL),
f2 AS (SELECT f1.*, (SELECT min(q.i) FROM q WHERE q.doc_id = f1.doc_id AND NOT blank AND q.i > nb) AS nt, (SELECT max(q.i) FROM q WHERE q.doc_id = f1.doc_id AND NOT blank AND q.i < pb) AS pt FROM f1)
SELECT doc_id, CAST(CASE WHEN nb IS NULL THEN n - 1 ELSE coalesce(nt, nb) END AS BIGINT) AS next_line, CAST(0 AS BIGINT) AS next_col, CAST(coalesce(pt + 1, 0) AS BIGINT) AS prev_line, CAST(0 AS BIGINT) AS prev_col FROM f2"""
)
def paragraph_motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over blank lines, forward and back, in books."""
    k = cursors(chapters(spark, sf_dir))
    found = k.select("doc_id", motion.paragraph_forward(F.col("ls"), F.col("line")).alias("f"), motion.paragraph_back(F.col("ls"), F.col("line")).alias("b"))
    return found.select("doc_id", *at(F.col("f"), "next"), *at(F.col("b"), "prev"))


#: All positions of sentence marks with what follows them; lines unnested into characters only where a mark is.
_MARKS = r"""li AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS i, unnest(ls) AS txt FROM d),
pc AS (SELECT doc_id, i, txt, generate_subscripts(ps, 1) AS j, ps FROM (SELECT *, regexp_split_to_array(txt, '[.!?]') AS ps FROM li)),
mk AS (SELECT doc_id, i, txt, CAST(list_sum(list_transform(ps[:j], lambda x: length(x))) + j - 1 AS BIGINT) AS c FROM pc WHERE j < len(ps)),
ends AS (SELECT doc_id, i, c, txt FROM mk WHERE c + 1 >= length(txt) OR regexp_matches(substring(txt, c + 2, 1), '\s'))"""


@query(
    rf"""WITH {cursor_sql()}, {_MARKS}, solid AS (SELECT doc_id, i, length(regexp_extract(txt, '^\s*')) AS c FROM li WHERE regexp_matches(txt, '\S')),
f AS (SELECT k.doc_id, min({{'i': e.i, 'c': e.c, 'gap': length(regexp_extract(substring(e.txt, e.c + 2), '^\s*')), 'rest': length(e.txt) - e.c - 1}}) AS m FROM k JOIN ends e ON e.doc_id = k.doc_id AND (e.i > k.line OR (e.i = k.line AND e.c >= k.col + 1)) GROUP BY k.doc_id),
g AS (SELECT f.doc_id, m, min({{'i': s.i, 'c': s.c}}) AS nx FROM f LEFT JOIN solid s ON s.doc_id = f.doc_id AND s.i > m.i GROUP BY f.doc_id, m),
b AS (SELECT k.doc_id, max({{'i': e.i, 'c': e.c}}) AS m FROM k JOIN ends e ON e.doc_id = k.doc_id AND e.c > 0 AND (e.i < k.line OR (e.i = k.line AND e.c <= k.col - 1)) GROUP BY k.doc_id)
SELECT k.doc_id, CAST(CASE WHEN g.doc_id IS NULL THEN n - 1 WHEN g.m.gap < g.m.rest THEN g.m.i WHEN nx.i IS NULL THEN g.m.i ELSE nx.i END AS BIGINT) AS next_line,
  CAST(CASE WHEN g.doc_id IS NULL THEN greatest(length(ls[-1]) - 1, 0) WHEN g.m.gap < g.m.rest THEN g.m.c + 1 + g.m.gap WHEN nx.i IS NULL THEN g.m.c ELSE nx.c END AS BIGINT) AS next_col,
  CAST(coalesce(b.m.i, 0) AS BIGINT) AS prev_line, CAST(coalesce(b.m.c + 1, 0) AS BIGINT) AS prev_col FROM k LEFT JOIN g ON g.doc_id = k.doc_id LEFT JOIN b ON b.doc_id = k.doc_id"""
)
def sentence_motions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over sentence marks, forward and back."""
    k, a = cursors(documents(spark, sf_dir)), _args()
    found = k.select("doc_id", motion.sentence_forward(*a).alias("f"), motion.sentence_back(*a).alias("b"))
    return found.select("doc_id", *at(F.col("f"), "next"), *at(F.col("b"), "prev"))


@query(
    f"""WITH {cursor_sql()}, s AS (SELECT *, strpos(substring(cur, col + 2), 'e') AS f, strpos(reverse(substring(cur, 1, col)), 'e') AS b FROM k)
SELECT doc_id, CASE WHEN f > 0 THEN col + f END AS f_col, CASE WHEN f > 0 THEN col + f - 1 END AS t_col, CASE WHEN b > 0 THEN col - b END AS back_f_col, CASE WHEN b > 0 THEN col - b + 1 END AS back_t_col FROM s"""
)
def find_char(spark: SparkSession, sf_dir: str) -> DataFrame:
    """To the next and previous letter e on the line, and one short of it."""
    k, a = cursors(documents(spark, sf_dir)), _args()
    names = {"f_col": (True, False), "t_col": (True, True), "back_f_col": (False, False), "back_t_col": (False, True)}
    return k.select("doc_id", *[motion.find_char(*a, "e", forward, till)["col"].cast("long").alias(n) for n, (forward, till) in names.items()])


@query(
    f"""WITH {cursor_sql()} SELECT doc_id, greatest(length(cur) - 1, 0) AS end_col, CASE WHEN regexp_matches(cur, '\\S') THEN length(regexp_extract(cur, '^\\s*')) ELSE 0 END AS indent_col,
  n - 1 AS last_line, least(41, n - 1) AS go_line, CASE WHEN regexp_matches(ls[least(41, n - 1) + 1], '\\S') THEN length(regexp_extract(ls[least(41, n - 1) + 1], '^\\s*')) ELSE 0 END AS go_col FROM k"""
)
def line_jumps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The line's end and indent, the last line, and line 42."""
    k = cursors(documents(spark, sf_dir))
    found = k.select("doc_id", motion.line_end(F.col("ls"), F.col("line")).alias("e"), motion.line_indent(F.col("ls"), F.col("line")).alias("i"), motion.goto_line(F.col("ls"), F.col("n") - 1).alias("g"), motion.goto_line(F.col("ls"), F.lit(41)).alias("go"))
    return found.select("doc_id", F.col("e.col").cast("long").alias("end_col"), F.col("i.col").cast("long").alias("indent_col"), F.col("g.line").cast("long").alias("last_line"), *at(F.col("go"), "go"))


@query(
    f"""WITH {cursor_sql()} SELECT doc_id, least(line + 1, n - 1) AS down_line, CASE WHEN line + 1 > n - 1 THEN col ELSE least(col, greatest(length(ls[line + 2]) - 1, 0)) END AS down_col,
  greatest(line - 1, 0) AS up_line, CASE WHEN line = 0 THEN col ELSE least(col, greatest(length(ls[line]) - 1, 0)) END AS up_col, greatest(col - 1, 0) AS left_col,
  CASE WHEN col < greatest(length(cur) - 1, 0) THEN col + 1 ELSE col END AS right_col FROM k"""
)
def arrow_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One step in each direction."""
    k, a = cursors(documents(spark, sf_dir)), _args()
    found = k.select("doc_id", motion.step(*a, down=1).alias("d"), motion.step(*a, down=-1).alias("u"), motion.step(*a, right=-1).alias("l"), motion.step(*a, right=1).alias("r"))
    return found.select("doc_id", *at(F.col("d"), "down"), *at(F.col("u"), "up"), F.col("l.col").cast("long").alias("left_col"), F.col("r.col").cast("long").alias("right_col"))


#: Brackets of pages with their depth per kind, and the pairs that share a level.
_BRACKETS = r"""pg AS (SELECT page_id AS doc_id, html, string_split(html, '') AS cs FROM pages WHERE html IS NOT NULL),
ch AS (SELECT doc_id, generate_subscripts(cs, 1) - 1 AS o, unnest(cs) AS c FROM pg),
br AS (SELECT doc_id, o, c, CASE WHEN c IN ('(', ')') THEN 'p' WHEN c IN ('{', '}') THEN 'b' ELSE 's' END AS kind, CASE WHEN c IN ('(', '{', '[') THEN 1 ELSE -1 END AS step FROM ch WHERE c IN ('(', ')', '{', '}', '[', ']')),
dp AS (SELECT *, sum(step) OVER (PARTITION BY doc_id, kind ORDER BY o) AS depth FROM br),
lv AS (SELECT *, CASE WHEN step = 1 THEN depth ELSE depth + 1 END AS level FROM dp),
pr AS (SELECT doc_id, kind, o, step, level, lead(o) OVER w AS no, lead(step) OVER w AS nstep FROM lv WINDOW w AS (PARTITION BY doc_id, kind, level ORDER BY o)),
pairs AS (SELECT doc_id, kind, o AS open_at, no AS close_at FROM pr WHERE step = 1 AND nstep = -1)"""


def _offset(position: Column) -> Column:
    """Where a position of ``ls`` lies in the text."""
    above = F.length(F.array_join(F.slice("ls", 1, position["line"]), "\n")) + F.when(position["line"] > 0, 1).otherwise(0)
    return (above + position["col"]).cast("long")


def _at_offset(pages: DataFrame, offset: Column) -> DataFrame:
    cut = pages.select("doc_id", "text", F.split("text", "\n", -1).alias("ls"), offset.cast("int").alias("o"))
    return cut.withColumn("p", motion.place(F.col("text"), F.col("o"), F.lit(0), F.lit(0)))


@query(
    f"""WITH {_BRACKETS}, x AS (SELECT doc_id, min(CASE WHEN step = 1 THEN o END) AS open_at, max(CASE WHEN step = -1 THEN o END) AS last_close FROM br GROUP BY doc_id)
SELECT x.doc_id, x.open_at, a.close_at, x.last_close, b.open_at AS its_open FROM x LEFT JOIN pairs a ON a.doc_id = x.doc_id AND a.open_at = x.open_at LEFT JOIN pairs b ON b.doc_id = x.doc_id AND b.close_at = x.last_close
WHERE x.open_at IS NOT NULL AND x.last_close IS NOT NULL"""
)
def match_bracket(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The partners of the first opening and the last closing bracket of every page."""
    pages = _pages(spark, sf_dir).where(F.col("text").rlike(r"[(\[{]") & F.col("text").rlike(r"[)\]}]"))
    match = lambda: motion.matching_bracket(F.col("ls"), F.col("p.line"), F.col("p.col"))
    first = _at_offset(pages, F.length(F.regexp_extract("text", r"^[^(\[{]*", 0))).withColumn("m", match())
    last = _at_offset(pages, F.length(F.regexp_extract("text", r"(?s)^.*[)\]}]", 0)) - 1).withColumn("m", match())
    there = first.select("doc_id", F.col("o").cast("long").alias("open_at"), _offset(F.col("m")).alias("close_at"))
    back = last.select("doc_id", F.col("o").cast("long").alias("last_close"), _offset(F.col("m")).alias("its_open"))
    return there.join(back, "doc_id")


@query(
    f"""WITH {_BRACKETS}, mid AS (SELECT doc_id, min(o) + 1 AS at_o FROM br WHERE c = '(' GROUP BY doc_id), q AS (SELECT m.doc_id, p.open_at, p.close_at FROM mid m JOIN pairs p ON p.doc_id = m.doc_id AND p.kind = 'p' AND p.open_at < m.at_o AND p.close_at > m.at_o)
SELECT doc_id, max(open_at) AS open_at, max_by(close_at, open_at) AS close_at FROM q WHERE NOT EXISTS (SELECT 1 FROM br JOIN mid ON mid.doc_id = br.doc_id WHERE br.doc_id = q.doc_id AND br.o = mid.at_o) GROUP BY doc_id"""
)
def select_delimited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The parentheses around the character after every page's first one, where that is no bracket."""
    placed = _at_offset(_pages(spark, sf_dir).where("instr(text, '(') > 0"), F.instr("text", "("))
    plain = placed.where(~F.substring("text", F.col("o") + 1, F.lit(1)).rlike(r"[(){}\[\]]"))
    found = plain.withColumn("s", textobj.delimited(F.col("ls"), F.col("p.line"), F.col("p.col"), "(", around=True)).where("s is not null")
    return found.select("doc_id", _offset(F.col("s.start")).alias("open_at"), (_offset(F.col("s.end")) - 1).alias("close_at"))


@query(
    rf"""WITH {cursor_sql()}, h AS (SELECT *, substring(cur, 1, col) AS hd, substring(cur, col + 1) AS tl FROM k WHERE length(cur) > 0),
w AS (SELECT doc_id, CASE WHEN regexp_matches(tl, '^{W}') THEN length(regexp_extract(hd, '{W}*$')) ELSE length(regexp_extract(hd, '{P}*$')) END AS sb, CASE WHEN regexp_matches(tl, '^{W}') THEN length(regexp_extract(tl, '^{W}+')) ELSE length(regexp_extract(tl, '^{P}+')) END AS sa,
  length(regexp_extract(hd, '\S*$')) AS bb, length(regexp_extract(tl, '^\S+')) AS ba, line, col FROM h WHERE regexp_matches(tl, '^\S'))
SELECT doc_id, line AS small_start_line, col - sb AS small_start_col, line AS small_end_line, col + sa AS small_end_col, line AS big_start_line, col - bb AS big_start_col, line AS big_end_line, col + ba AS big_end_col FROM w"""
)
def select_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The small and big word at every cursor that stands on one."""
    k, a = cursors(documents(spark, sf_dir)), _args()
    found = k.select("doc_id", textobj.inner_word(*a).alias("s"), textobj.inner_word(*a, big=True).alias("b")).where("s is not null")
    return found.select("doc_id", *between(F.col("s"), "small"), *between(F.col("b"), "big"))


@query(
    rf"""WITH {cursor_sql()}, h AS (SELECT *, CASE WHEN regexp_matches(substring(cur, col + 1, 1), '\s') THEN greatest(col - length(regexp_extract(substring(cur, 1, col), '\s*$')) - 1, 0) ELSE col END AS p FROM k WHERE length(cur) > 0),
g AS (SELECT *, substring(cur, 1, p) AS hd, substring(cur, p + 1) AS tl FROM h),
r AS (SELECT *, CASE WHEN regexp_matches(tl, '^{W}') THEN p - length(regexp_extract(hd, '{W}*$')) WHEN regexp_matches(tl, '^{P}') THEN p - length(regexp_extract(hd, '{P}*$')) ELSE p END AS st,
  CASE WHEN regexp_matches(tl, '^{W}') THEN p + length(regexp_extract(tl, '^{W}+')) WHEN regexp_matches(tl, '^{P}') THEN p + length(regexp_extract(tl, '^{P}+')) ELSE p END AS en FROM g),
t AS (SELECT *, en + length(regexp_extract(substring(cur, en + 1), '^\s*')) AS stop, length(regexp_extract(substring(cur, 1, st), '\s*$')) AS lead FROM r)
SELECT doc_id, CASE WHEN stop < length(cur) OR st = 0 THEN st - lead ELSE st END AS start_col, stop AS end_col FROM t"""
)
def select_around_word(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The word at every cursor with the blanks that go with it."""
    k = cursors(documents(spark, sf_dir)).where("length(cur) > 0")
    found = k.select("doc_id", textobj.around_word(*_args()).alias("s"))
    return found.select("doc_id", F.col("s.start.col").cast("long").alias("start_col"), F.col("s.end.col").cast("long").alias("end_col"))


@query(
    rf"""WITH {cursor_sql(CHAPTERS)}, {_BLANKS}, q AS (SELECT doc_id, n, line, generate_subscripts(b, 1) - 1 AS i, unnest(b) AS blank FROM fl),
a AS (SELECT doc_id, n, line, coalesce(max(CASE WHEN blank AND i < line THEN i END), -1) + 1 AS s, coalesce(min(CASE WHEN blank AND i > line THEN i END), n) - 1 AS e FROM q GROUP BY doc_id, n, line),
o AS (SELECT a.doc_id, a.s, a.e, coalesce(max(CASE WHEN NOT q.blank AND q.i < a.s THEN q.i END), -1) + 1 AS os, coalesce(min(CASE WHEN NOT q.blank AND q.i > a.e THEN q.i END), a.n) - 1 AS oe FROM a JOIN q ON q.doc_id = a.doc_id GROUP BY a.doc_id, a.n, a.s, a.e)
SELECT o.doc_id, s AS inner_start_line, CAST(0 AS BIGINT) AS inner_start_col, e AS inner_end_line, length(d.ls[e + 1]) AS inner_end_col, os AS outer_start_line, CAST(0 AS BIGINT) AS outer_start_col, oe AS outer_end_line, length(d.ls[oe + 1]) AS outer_end_col
FROM o JOIN d ON d.doc_id = o.doc_id"""
)
def select_paragraph(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraph at every cursor, without and with the blank lines around it, in books."""
    k = cursors(chapters(spark, sf_dir))
    found = k.select("doc_id", textobj.paragraph(F.col("ls"), F.col("line")).alias("i"), textobj.paragraph(F.col("ls"), F.col("line"), around=True).alias("o"))
    return found.select("doc_id", *between(F.col("i"), "inner"), *between(F.col("o"), "outer"))


@query(
    rf"""WITH {cursor_sql()}, {_MARKS},
s AS (SELECT k.doc_id, max({{'i': m.i, 'c': m.c, 'rest': length(m.txt) - m.c - 1, 'gap': length(regexp_extract(substring(m.txt, m.c + 2), '^\s*'))}}) AS m FROM k JOIN mk m ON m.doc_id = k.doc_id AND (m.i < k.line OR (m.i = k.line AND m.c <= k.col)) GROUP BY k.doc_id),
z AS (SELECT k.doc_id, min({{'i': m.i, 'c': m.c, 'gap': length(regexp_extract(substring(m.txt, m.c + 2), '^\s*'))}}) AS m FROM k JOIN mk m ON m.doc_id = k.doc_id AND (m.i > k.line OR (m.i = k.line AND m.c >= k.col)) GROUP BY k.doc_id)
SELECT k.doc_id, CASE WHEN s.doc_id IS NULL THEN 0 WHEN s.m.rest > 0 THEN s.m.i WHEN s.m.i + 1 < n THEN s.m.i + 1 ELSE line END AS start_line,
  CASE WHEN s.doc_id IS NULL THEN 0 WHEN s.m.rest > 0 THEN s.m.c + 1 + s.m.gap WHEN s.m.i + 1 < n THEN length(regexp_extract(ls[s.m.i + 2], '^\s*')) ELSE col + length(regexp_extract(substring(cur, col + 1), '^\s*')) END AS start_col,
  coalesce(z.m.i, n - 1) AS end_line, coalesce(z.m.c + 1, length(ls[-1])) AS end_col, coalesce(z.m.c + 1 + z.m.gap, length(ls[-1])) AS around_end_col
FROM k LEFT JOIN s ON s.doc_id = k.doc_id LEFT JOIN z ON z.doc_id = k.doc_id"""
)
def select_sentence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sentence at every cursor, and its end with the blanks after it."""
    k, a = cursors(documents(spark, sf_dir)), _args()
    found = k.select("doc_id", textobj.sentence(*a).alias("s"), textobj.sentence(*a, around=True).alias("o"))
    s, e = F.col("s.start"), F.col("s.end")
    return found.select("doc_id", *at(s, "start"), *at(e, "end"), F.col("o.end.col").cast("long").alias("around_end_col"))


@query(
    """WITH pg AS (SELECT page_id AS doc_id, string_split(html, chr(10)) AS ls FROM pages WHERE html IS NOT NULL),
l AS (SELECT doc_id, generate_subscripts(ls, 1) - 1 AS line, unnest(ls) AS txt FROM pg),
m AS (SELECT *, (length(txt) // 3) AS col, string_split(txt, '"') AS ps FROM l WHERE strpos(txt, '"') > 0),
q AS (SELECT doc_id, line, col, generate_subscripts(ps, 1) AS j, ps FROM m),
r AS (SELECT doc_id, line, col, j, len(ps) AS np, list_sum(list_transform(ps[:j], lambda x: length(x))) + j - 1 AS s, list_sum(list_transform(ps[:j + 1], lambda x: length(x))) + j AS e FROM q WHERE j % 2 = 1 AND j + 1 < len(ps))
SELECT doc_id, line, CAST(CASE WHEN e > s + 1 THEN s + 1 END AS BIGINT) AS inner_start, CAST(CASE WHEN e > s + 1 THEN e END AS BIGINT) AS inner_end, CAST(s AS BIGINT) AS outer_start, CAST(e + 1 AS BIGINT) AS outer_end FROM r WHERE col >= s AND col <= e"""
)
def select_quoted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The quotes around a third of every page line that has some."""
    rows = _pages(spark, sf_dir).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "txt")).where("instr(txt, '\"') > 0")
    k = rows.select("doc_id", "line", F.array("txt").alias("ls"), F.floor(F.length("txt") / 3).cast("int").alias("col"))
    found = k.select("doc_id", F.col("line").cast("long").alias("line"), textobj.quoted(F.col("ls"), F.lit(0), F.col("col")).alias("i"), textobj.quoted(F.col("ls"), F.lit(0), F.col("col"), around=True).alias("o")).where("o is not null")
    ends = {"inner_start": "i.start", "inner_end": "i.end", "outer_start": "o.start", "outer_end": "o.end"}
    return found.select("doc_id", "line", *[F.col(f"{c}.col").cast("long").alias(a) for a, c in ends.items()])


@query(
    f"""WITH {cursor_sql()}, x AS (SELECT *, least(line + 2, n - 1) AS l1, length(ls[least(line + 2, n - 1) + 1]) // 2 AS c1 FROM k)
SELECT doc_id, md5(CASE WHEN l1 > line THEN substring(cur, col + 1) || chr(10) || CASE WHEN l1 = line + 2 THEN ls[line + 2] || chr(10) ELSE '' END || substring(ls[l1 + 1], 1, c1)
    ELSE substring(cur, least(col, c1) + 1, greatest(col, c1) - least(col, c1)) END) AS chars_md5, md5(array_to_string(ls[line + 1:l1 + 1], chr(10))) AS lines_md5, n - 1 AS all_end_line, length(ls[-1]) AS all_end_col FROM x"""
)
def extract_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a selection of up to three lines, by characters and by lines, and the span of all."""
    k = cursors(documents(spark, sf_dir)).withColumn("l1", F.least(F.col("line") + 2, F.col("n") - 1))
    k = k.withColumn("c1", F.floor(F.length(F.get("ls", F.col("l1"))) / 2).cast("int"))
    start, end = motion.position(F.col("line"), F.col("col")), motion.position(F.col("l1"), F.col("c1"))
    digest = lambda x: F.md5(F.encode(x, "UTF-8"))
    every = textobj.select_all(F.col("ls"))["end"]
    return k.select("doc_id", digest(textobj.extract(F.col("ls"), start, end)).alias("chars_md5"), digest(textobj.extract(F.col("ls"), start, end, whole_lines=True)).alias("lines_md5"), *longs(every, "all_end_", "line", "col"))


@query(
    rf"""WITH {cursor_sql()}, h AS (SELECT doc_id, cur, regexp_extract(substring(cur, 1, col), '[\p{{L}}\p{{N}}]*$') AS b, CASE WHEN col < length(cur) THEN regexp_extract(substring(cur, col + 1), '^[\p{{L}}\p{{N}}]*') ELSE '' END AS a, col FROM k)
SELECT doc_id, cur AS line_text, CASE WHEN col < length(cur) THEN nullif(b || a, '') END AS word FROM h"""
)
def yanked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What yanking the line and the word takes."""
    return cursors(documents(spark, sf_dir)).select("doc_id", textobj.yank_line(F.col("ls"), F.col("line")).alias("line_text"), textobj.yank_word(*_args()).alias("word"))
