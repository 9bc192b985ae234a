"""Case-insensitive literal search inside lines, with wrap-around and incremental variants.

Cursor-relative operators are column functions over a document's line array: a document is one row, so
"next from here" is a walk inside the row, and a table of cursors costs one join by document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lectern.functions.text import WORD, find_first, find_last, run_at
from lectern.operators.lines import line_rows


def matching_lines(docs: DataFrame, query: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_idx, first_start, first_end, last_start, last_end`` of every line with a match.

    Documents without the query anywhere are filtered before they are cut into lines.
    """
    has = docs.where(F.contains(F.lower(F.col(text_col)), F.lit(query.lower()))) if query else docs.limit(0)
    line = F.col("line")
    rows = line_rows(has, id_col, text_col).select("doc_id", "line_idx", find_first(line, query).alias("first_start"), find_last(line, query).alias("last_start"))
    return rows.where("first_start is not null").select(
        "doc_id", "line_idx", "first_start", (F.col("first_start") + len(query)).alias("first_end"), "last_start", (F.col("last_start") + len(query)).alias("last_end")
    )


def _hit(index: Column, start: Column, size: int) -> Column:
    return F.struct(index.cast("int").alias("line"), start.cast("int").alias("start"), (start + size).cast("int").alias("end"))


def _scan(lines: Column, first: Column, count: Column, query: str, forward: bool, last_in_line: bool) -> Column:
    """The nearest matching line in ``lines[first : first + count]``, from the front or the back; null if none."""
    part = F.slice(lines, F.greatest(first, F.lit(0)) + 1, F.greatest(count, F.lit(0)))
    has = F.transform(part, lambda x: F.contains(F.lower(x), F.lit(query.lower())))
    at = F.array_position(has, True) if forward else F.size(has) + 1 - F.array_position(F.reverse(has), True)
    none = F.array_position(has, True) == 0
    index = (F.greatest(first, F.lit(0)) + at - 1).cast("int")
    line = F.get(lines, index)
    start = find_last(line, query) if last_in_line else find_first(line, query)
    return F.when(~none, _hit(index, start, len(query)))


def next_match(lines: Column, line: Column, query: str, forward: bool = True) -> Column:
    """The match after (or before) the one on ``line``: struct ``line, start, end``, null if there is none.

    At most one match per line and pass: the first going forward, the last going backward. Wraps around
    and comes back to the starting line at last.
    """
    if not query:
        return F.lit(None).cast("struct<line:int,start:int,end:int>")
    n = F.size(lines)
    if forward:
        return F.coalesce(_scan(lines, line + 1, n - line - 1, query, True, False), _scan(lines, F.lit(0), line + 1, query, True, False))
    return F.coalesce(_scan(lines, F.lit(0), line, query, False, True), _scan(lines, line, n - line, query, False, True))


def preview_match(lines: Column, line: Column, col: Column, query: str, forward: bool = True) -> Column:
    """The match shown while a query is typed at a position: struct ``line, start, end``, null if none.

    Forward: the cursor's line from its column on, later lines, then from the top through the cursor's line.
    Backward: the last match before the column, then earlier lines (first match each), then from the end
    down to the cursor's line.
    """
    if not query:
        return F.lit(None).cast("struct<line:int,start:int,end:int>")
    n, current = F.size(lines), F.get(lines, line)
    if forward:
        here = find_first(F.substring(current, col + 1, F.length(current)), query) + col
        rest = F.coalesce(_scan(lines, line + 1, n - line - 1, query, True, False), _scan(lines, F.lit(0), line + 1, query, True, False))
    else:
        here = find_last(F.substring(current, F.lit(1), col), query)
        rest = F.coalesce(_scan(lines, F.lit(0), line, query, False, False), _scan(lines, line, n - line, query, False, False))
    return F.when(here.isNotNull(), _hit(line, here, len(query))).otherwise(rest)


def word_under(line: Column, col: Column) -> Column:
    """The word that a column lies in; null where the character isn't a word character."""
    start, end = run_at(line, col, WORD)
    return F.when(end > start, F.substring(line, start + 1, end - start))


def segments(line: Column, start: Column, end: Column) -> Column:
    """A line in three pieces around a match: ``before, match, after``."""
    return F.struct(
        F.substring(line, F.lit(1), start).alias("before"), F.substring(line, start + 1, end - start).alias("match"), F.substring(line, end + 1, F.length(line)).alias("after")
    )
