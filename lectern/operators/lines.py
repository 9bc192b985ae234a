"""The line relation and conversions between positions and absolute byte offsets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.text import MARK, WORD, is_blank, lines_of, running_before


def line_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: ``doc_id, line_idx, line``. A narrow transformation; null texts have no lines."""
    return docs.select(F.col(id_col).alias("doc_id"), F.posexplode(lines_of(F.col(text_col))).alias("line_idx", "line"))


def line_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One slim row per line: ``doc_id, line_idx, abs_byte, n_bytes``, the byte it starts at and its size. Nothing is shuffled."""
    cut = docs.select(F.col(id_col).alias("doc_id"), F.transform(lines_of(F.col(text_col)), lambda x: F.octet_length(x)).alias("sizes"))
    placed = cut.select("doc_id", F.posexplode(F.arrays_zip("sizes", running_before(F.transform("sizes", lambda n: n.cast("long") + 1)).alias("starts"))).alias("line_idx", "at"))
    return placed.select("doc_id", "line_idx", F.col("at.starts").alias("abs_byte"), F.col("at.sizes").alias("n_bytes"))


def line_relation(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line: ``doc_id, line_idx, line, abs_byte, n_bytes, n_chars, is_blank``.

    ``abs_byte`` is the byte offset at which the line starts. The lengths before each line are summed up
    in the document's row before it is taken apart, so nothing is shuffled.
    """
    cut = docs.select(F.col(id_col).alias("doc_id"), lines_of(F.col(text_col)).alias("lines"))
    starts = running_before(F.transform("lines", lambda x: F.octet_length(x).cast("long") + 1))
    placed = cut.select("doc_id", F.posexplode(F.arrays_zip("lines", starts.alias("starts"))).alias("line_idx", "at"))
    line = F.col("at.lines")
    return placed.select("doc_id", "line_idx", line.alias("line"), F.col("at.starts").alias("abs_byte"), F.octet_length(line).alias("n_bytes"), F.length(line).alias("n_chars"), is_blank(line).alias("is_blank"))


def offset_of(lines: Column, line: Column, col: Column) -> Column:
    """The absolute byte offset of a position of a document's line array."""
    above = F.aggregate(F.slice(lines, 1, F.greatest(line, F.lit(0))), F.lit(0).cast("long"), lambda a, x: a + F.octet_length(x) + 1)
    return above + F.octet_length(F.substring(F.get(lines, line), F.lit(1), col))


def join_lines(lines: DataFrame) -> DataFrame:
    """Texts put together again from ``doc_id, line_idx, line``."""
    ordered = F.array_sort(F.collect_list(F.struct("line_idx", "line")))
    return lines.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda x: x["line"]), "\n").alias("text"))


def runs_of(line: Column) -> Column:
    """A line cut into what is between runs and the runs of word or punctuation characters, by turns."""
    return F.split(F.regexp_replace(line, f"({WORD}+|{MARK}+)", "\u0000$1\u0000"), "\u0000", -1)


def word_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per run of word or punctuation characters: ``doc_id, line_idx, word_idx, word, start_char, end_char, kind``.

    Starts are summed up in the line's row, so nothing is shuffled.
    """
    lines = line_rows(docs, id_col, text_col).select("doc_id", "line_idx", runs_of(F.col("line")).alias("runs"))
    starts = running_before(F.transform("runs", lambda x: F.length(x).cast("long")))
    found = lines.select("doc_id", "line_idx", F.posexplode(F.arrays_zip("runs", starts.alias("starts"))).alias("k", "at")).where("k % 2 = 1")
    word, start = F.col("at.runs"), F.col("at.starts").cast("int")
    kind = F.when(word.rlike(f"^{WORD}"), "word").otherwise("punct")
    return found.select("doc_id", "line_idx", F.expr("(k - 1) div 2").cast("int").alias("word_idx"), word.alias("word"), start.alias("start_char"), (start + F.length(word)).alias("end_char"), kind.alias("kind"))


def to_offsets(positions: DataFrame, relation: DataFrame) -> DataFrame:
    """Add ``abs_byte`` to rows of ``doc_id, line, col``; ``col`` counts code points. Lines that don't exist give no row."""
    starts = relation.select("doc_id", F.col("line_idx").alias("line"), F.col("abs_byte").alias("line_byte"), F.col("line").alias("line_text"))
    joined = positions.join(starts, ["doc_id", "line"])
    within = F.octet_length(F.expr("left(line_text, int(col))"))
    return joined.select(*positions.columns, (F.col("line_byte") + within).alias("abs_byte"))


def to_positions(offsets: DataFrame, relation: DataFrame) -> DataFrame:
    """Add ``line`` and ``byte_col`` to rows of ``doc_id, abs_byte``: the first line that ends at or after the offset.

    Line starts and offsets are merged by an ordered window per document, so each side is read once
    and nothing is multiplied out. Offsets past the document's end give no row.
    """
    ends = relation.select("doc_id", (F.col("abs_byte") + F.col("n_bytes")).alias("at"), F.lit(1).alias("kind"), F.struct(F.col("line_idx").alias("line"), F.col("abs_byte").alias("start")).alias("hit"))
    asked = offsets.withColumn("asked", F.struct(*offsets.columns)).select("doc_id", F.col("abs_byte").alias("at"), F.lit(0).alias("kind"), "asked")
    both = ends.unionByName(asked, allowMissingColumns=True)
    ahead = Window.partitionBy("doc_id").orderBy("at", "kind").rowsBetween(0, Window.unboundedFollowing)
    found = both.withColumn("next", F.first("hit", ignorenulls=True).over(ahead)).where("kind = 0 and next is not null")
    return found.select("asked.*", F.col("next.line").alias("line"), (F.col("at") - F.col("next.start")).alias("byte_col"))
