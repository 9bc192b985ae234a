"""Keyed state: bookmarks and reading progress from event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(events: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row per key by ``order``; aggregated on both sides of one shuffle."""
    rest = [c for c in events.columns if c not in keys]
    return events.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("v")).select(*keys, *[F.col(f"v.{c}").alias(c) for c in rest])


def latest_marks(events: DataFrame) -> DataFrame:
    """Marks ``a`` to ``z`` as last set: events ``doc, mark, line, col, ts, seq``; other names are ignored."""
    return latest(events.where(F.col("mark").rlike("^[a-z]$")), ["doc", "mark"], ["ts", "seq"])


def jump_to_mark(jumps: DataFrame, marks: DataFrame) -> DataFrame:
    """Where jumps ``doc, mark, line, col`` lead: ``to_line, to_col``, unchanged where the mark isn't set."""
    target = marks.select("doc", "mark", F.col("line").alias("m_line"), F.col("col").alias("m_col"))
    joined = jumps.join(target, ["doc", "mark"], "left")
    return joined.select(*jumps.columns, F.coalesce("m_line", "line").alias("to_line"), F.coalesce("m_col", "col").alias("to_col"), F.col("m_line").isNotNull().alias("moved"))


def jump_back(jumps: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Each jump's previous position: ``back_line, back_col``, null for the first of a key."""
    w = Window.partitionBy(key).orderBy(*order)
    return jumps.withColumns({"back_line": F.lag("line").over(w), "back_col": F.lag("col").over(w)})


def latest_progress(events: DataFrame) -> DataFrame:
    """Last progress per document by time and sequence."""
    return latest(events, ["doc"], ["ts", "seq"])


def stored_percentage(offset: Column, total: Column) -> Column:
    """``offset / total * 100``; null for an empty document."""
    return F.try_divide(offset.cast("double"), total.cast("double")) * 100


def shown_percentage(position: Column, total: Column) -> Column:
    """The whole percentage shown at a 0-based line, at most 100; 100 for an empty document."""
    return F.when(total <= 0, F.lit(100.0)).otherwise(F.least(F.round(F.least(position + 1, total) / F.greatest(total, F.lit(1)) * 100), F.lit(100.0)))


def changes(events: DataFrame, key: str, order: list[str], *watched: str) -> DataFrame:
    """Events that differ from their key's previous one in a watched column; first ones are kept."""
    w = Window.partitionBy(key).orderBy(*order)
    before = F.lag(F.struct(*watched)).over(w)
    return events.withColumn("_before", before).where(~F.col("_before").eqNullSafe(F.struct(*watched))).drop("_before")
