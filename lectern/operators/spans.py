"""Highlights: sets of half-open intervals per document, in absolute byte offsets.

Interval relations have ``doc, start, end`` (and what else the caller keeps). Overlap joins are equi-joins
by document and bin with the range as a residual, so one document with many intervals is spread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BIN = 1024


def add_highlights(existing: DataFrame, new: DataFrame) -> DataFrame:
    """``existing`` with those of ``new`` whose exact ``doc, start, end`` isn't there yet, once each."""
    both = existing.withColumn("_old", F.lit(0)).unionByName(new.withColumn("_old", F.lit(1)))
    rest = [F.struct("_old", *[c for c in existing.columns if c not in ("doc", "start", "end")]).alias("v")]
    least = both.select("doc", "start", "end", *rest).groupBy("doc", "start", "end").agg(F.min("v").alias("v"))
    return least.select(*[c if c in ("doc", "start", "end") else F.col(f"v.{c}").alias(c) for c in existing.columns])


def _binned(df: DataFrame, start: str, end: str, size: int) -> DataFrame:
    last = F.greatest(F.col(end) - 1, F.col(start))
    return df.withColumn("_bin", F.explode(F.sequence(F.floor(F.col(start) / size), F.floor(last / size))))


def overlapping(highlights: DataFrame, ranges: DataFrame, bin_size: int = BIN) -> DataFrame:
    """Pairs of a range and a highlight that overlap: ``doc, r_start, r_end, start, end``, each pair once.

    ``ranges`` has ``doc, r_start, r_end``. Touching is not overlapping. A pair is kept in the bin where
    the later of its starts lies.
    """
    left = _binned(highlights.select("doc", "start", "end"), "start", "end", bin_size)
    right = _binned(ranges.select("doc", "r_start", "r_end"), "r_start", "r_end", bin_size)
    joined = left.join(right, ["doc", "_bin"]).where("start < r_end and end > r_start")
    return joined.where(F.col("_bin") == F.floor(F.greatest("start", "r_start") / bin_size)).select("doc", "r_start", "r_end", "start", "end")


def _touched(highlights: DataFrame, ranges: DataFrame, how: str, bin_size: int) -> DataFrame:
    hit = overlapping(highlights, ranges, bin_size).select("doc", "start", "end").distinct()
    return highlights.join(hit, ["doc", "start", "end"], how)


def remove_overlapping(highlights: DataFrame, ranges: DataFrame, bin_size: int = BIN) -> DataFrame:
    """The highlights that no range of their document overlaps."""
    return _touched(highlights, ranges, "left_anti", bin_size)


def removed_by(highlights: DataFrame, ranges: DataFrame, bin_size: int = BIN) -> DataFrame:
    """The highlights that :func:`remove_overlapping` takes away."""
    return _touched(highlights, ranges, "left_semi", bin_size)


def cleared(highlights: DataFrame, docs: DataFrame) -> DataFrame:
    """The highlights of all documents but those that ``docs`` (``doc``) names."""
    return highlights.join(docs.select("doc"), "doc", "left_anti")


def in_range(highlights: DataFrame, start: int, end: int) -> DataFrame:
    """The highlights that overlap one range, in any document."""
    return highlights.where((F.col("start") < end) & (F.col("end") > start))


def toggled(events: DataFrame) -> DataFrame:
    """Highlights left after toggles ``doc, seq, start, end``, applied per document in ``seq`` order.

    A toggle that overlaps anything removes all it overlaps and adds nothing; else it adds itself. The
    fold is inherently sequential per document; an interval list is all the state it carries.
    """
    ordered = F.array_sort(F.collect_list(F.struct("seq", "start", "end")))
    state = F.array().cast("array<struct<start:bigint,end:bigint>>")

    def fold(have: Column, e: Column) -> Column:
        apart = F.filter(have, lambda h: (h["end"] <= e["start"]) | (h["start"] >= e["end"]))
        one = F.array(F.struct(e["start"].cast("long").alias("start"), e["end"].cast("long").alias("end")))
        return F.when(F.size(apart) == F.size(have), F.concat(have, one)).otherwise(apart)

    left = events.groupBy("doc").agg(ordered.alias("e")).select("doc", F.explode(F.aggregate("e", state, fold)).alias("h"))
    return left.select("doc", "h.start", "h.end")


def merged(intervals: DataFrame, *keys: str) -> DataFrame:
    """Overlapping or touching intervals of a key put together, by islands over the running maximum end."""
    order = Window.partitionBy(*keys).orderBy("start", "end")
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    fresh = (reach.isNull() | (F.col("start") > reach)).cast("int")
    island = F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0))
    marked = intervals.withColumn("_new", fresh).withColumn("_island", island)
    return marked.groupBy(*keys, "_island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("_island")


def clipped(lines: DataFrame, highlights: DataFrame) -> DataFrame:
    """Highlights cut to the lines they touch, merged per line: ``doc, line_idx, start, end`` in line bytes.

    ``lines`` has ``doc, line_idx, abs_byte, n_bytes``.
    """
    spans = lines.where("n_bytes > 0").select("doc", F.col("abs_byte").alias("r_start"), (F.col("abs_byte") + F.col("n_bytes")).alias("r_end"), "line_idx")
    left = _binned(highlights.select("doc", "start", "end"), "start", "end", BIN)
    right = _binned(spans, "r_start", "r_end", BIN)
    joined = left.join(right, ["doc", "_bin"]).where("start < r_end and end > r_start").where(F.col("_bin") == F.floor(F.greatest("start", "r_start") / BIN))
    cut = joined.select("doc", "line_idx", (F.greatest("start", "r_start") - F.col("r_start")).alias("start"), (F.least("end", "r_end") - F.col("r_start")).alias("end"))
    return merged(cut, "doc", "line_idx")


def lines_with_highlight(lines: DataFrame, highlights: DataFrame) -> DataFrame:
    """``doc, line_idx`` of the lines that some highlight touches."""
    return clipped(lines, highlights).select("doc", "line_idx").distinct()


def layered(intervals: DataFrame, *keys: str) -> DataFrame:
    """Disjoint pieces of intervals laid over each other: earlier starts win, then lower ``rank``.

    Each piece begins where all before it end; what is covered already disappears.
    """
    order = Window.partitionBy(*keys).orderBy("start", "rank", "end").rowsBetween(Window.unboundedPreceding, -1)
    begin = F.greatest("start", F.coalesce(F.max("end").over(order), F.col("start")))
    return intervals.withColumn("seg_start", begin).where("seg_start < end").select(*keys, "rank", "seg_start", F.col("end").alias("seg_end"))


def selection_columns(lines: DataFrame, selections: DataFrame) -> DataFrame:
    """What a selection covers on each of its lines: ``doc, line_idx, start, end`` in code points.

    ``lines`` has ``doc, line_idx, n_chars``; ``selections`` has ``doc, l0, c0, l1, c1`` with the end
    exclusive and not before the start.
    """
    rows = selections.withColumn("line_idx", F.explode(F.sequence("l0", "l1"))).join(lines.select("doc", "line_idx", "n_chars"), ["doc", "line_idx"])
    start = F.when(F.col("line_idx") == F.col("l0"), F.least("c0", "n_chars")).otherwise(F.lit(0))
    end = F.when(F.col("line_idx") == F.col("l1"), F.least("c1", "n_chars")).otherwise(F.col("n_chars"))
    return rows.select("doc", "line_idx", start.alias("start"), end.alias("end"))
