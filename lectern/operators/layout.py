"""Paragraph layout: greedy line filling and full justification at a column width."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 80
_SPACE = None


def _chunks(paragraph: str, width: int) -> Iterator[tuple[str, int]]:
    """Words and their byte lengths, longer ones cut after ``width`` code points."""
    import regex

    global _SPACE
    if _SPACE is None:
        _SPACE = regex.compile(r"[^\p{White_Space}]+")
    plain = paragraph.isascii()
    for word in _SPACE.findall(paragraph):
        for part in [word] if len(word) <= width else [word[i : i + width] for i in range(0, len(word), width)]:
            yield part, len(part) if plain else len(part.encode("utf-8", "replace"))


def _spaced(line: list[str], taken: int, width: int) -> str:
    """One full line: the gaps share what the words leave, earlier gaps get the odd blanks."""
    gaps = len(line) - 1
    if gaps < 1 or taken >= width:
        return " ".join(line)
    least, more = divmod(width - taken, gaps)
    wide, narrow = " " * (least + 1), " " * least
    return wide.join(line[: more + 1]) + (narrow + narrow.join(line[more + 1 :]) if more < gaps else "")


def justified(text: str, width: int = WIDTH) -> list[str]:
    """The lines of a text laid out at ``width``.

    Paragraphs end at two line feeds; each is followed by an empty line. Widths count UTF-8 bytes, words
    are cut by code points. The last line of a paragraph isn't stretched.
    """
    out = []
    for paragraph in text.split("\n\n"):
        line: list[str] = []
        taken = 0
        for word, size in _chunks(paragraph, width):
            if line and taken + len(line) + size > width:
                out.append(_spaced(line, taken, width))
                line, taken = [], 0
            line.append(word)
            taken += size
        if line:
            out.append(" ".join(line))
        out.append("")
    return out


def justify(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_idx, line``: every text justified at ``width``.

    Filling is a sequential fold, so it runs as an Arrow function per document; documents are
    independent and nothing is shuffled. Null texts have no lines. Raises ValueError for a width below 1.
    """
    if width < 1:
        raise ValueError("width must be at least 1")
    kind = docs.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [None if x is None else justified(x, width) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.list_(pa.string()))], names=["doc_id", "ls"])

    laid = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        run, T.StructType([T.StructField("doc_id", kind), T.StructField("ls", T.ArrayType(T.StringType()))])
    )
    return laid.select("doc_id", F.posexplode("ls").alias("line_idx", "line"))
