"""Viewports: which lines a screen of some height shows, and where motions by screenfuls go."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def viewport(lines: DataFrame, offset: int, height: int) -> DataFrame:
    """The ``height - 1`` rows of every document from line ``offset`` on, blank past the end: ``doc_id, row, line``."""
    count = max(height - 1, 0)
    seen = F.when((F.col("line_idx") >= offset) & (F.col("line_idx") < offset + count), F.struct("line_idx", "line"))
    shown = lines.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(seen)).alias("shown"))
    rows = F.explode(F.array(*map(F.lit, range(count))).cast("array<int>"))
    return shown.select("doc_id", rows.alias("row"), "shown").select("doc_id", "row", F.coalesce(F.try_element_at("shown", F.col("row") + offset), F.lit("")).alias("line"))


def viewport_rows(lines: Column, offset: Column, height: Column) -> Column:
    """The same for a document's line array: the shown lines, without blanks past the end."""
    return F.slice(lines, offset + 1, F.greatest(height - 1, F.lit(0)))


def centered(line: Column, total: Column, height: Column) -> Column:
    """Offset and cursor row that centre a match, kept inside the document: struct ``offset, cursor_y``."""
    content = F.greatest(height - 1, F.lit(0))
    raw = line - F.floor(content / 2)
    offset = F.when(raw < 0, F.lit(0)).when(raw + content > total, F.greatest(total - content, F.lit(0))).otherwise(raw)
    return F.struct(offset.cast("long").alias("offset"), F.greatest(line - offset, F.lit(0)).cast("long").alias("cursor_y"))


def overscrolled(line: Column, total: Column, rows: Column) -> Column:
    """Offset and cursor row after going to a line: it is centred even past the document's end."""
    target = F.greatest(F.least(line, total - 1), F.lit(0))
    middle = F.floor(rows / 2)
    y = F.when(target < middle, target).otherwise(middle)
    return F.struct(
        target.cast("long").alias("line"), F.greatest(target - middle, F.lit(0)).cast("long").alias("offset"), F.least(y, F.greatest(rows - 1, F.lit(0))).cast("long").alias("cursor_y")
    )


def screen_line(offset: Column, total: Column, height: Column, which: str) -> Column:
    """The line at the top (``H``), middle (``M``) or bottom (``L``) of the screen."""
    rows = F.greatest(height - 1, F.lit(0))
    last = F.greatest(total - 1, F.lit(0))
    at = {"H": offset, "M": F.least(offset + F.floor(rows / 2), last), "L": F.least(offset + F.greatest(rows - 1, F.lit(0)), last)}
    return at[which].cast("long")


def page(line: Column, total: Column, rows: Column, down: bool = True, half: bool = False) -> Column:
    """The line a page (all rows but three) or half page away, clamped to the document."""
    size = F.greatest(F.floor(rows / 2), F.lit(1)) if half else F.greatest(rows - 3, F.lit(0))
    to = F.least(line + size, F.greatest(total - 1, F.lit(0))) if down else F.greatest(line - size, F.lit(0))
    return to.cast("long")


def restored(progress: Column, total: Column, height: Column) -> Column:
    """Offset and cursor row for a saved position: exact if it has both, else centred with top and bottom rules.

    ``progress`` is a struct with ``offset, viewport_offset, cursor_y``.
    """
    line, content = progress["offset"], F.greatest(height - 1, F.lit(0))
    middle = F.floor(content / 2)
    bottom = F.when(total > content, total - content).otherwise(F.lit(0))
    offset = F.when(line < middle, F.lit(0)).when(line >= F.greatest(total - middle, F.lit(0)), bottom).otherwise(F.greatest(line - middle, F.lit(0)))
    exact = progress["viewport_offset"].isNotNull() & progress["cursor_y"].isNotNull()
    return F.struct(
        F.when(exact, progress["viewport_offset"]).otherwise(offset).cast("long").alias("offset"), F.when(exact, progress["cursor_y"]).otherwise(line - offset).cast("long").alias("cursor_y")
    )
