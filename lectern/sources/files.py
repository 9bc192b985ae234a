"""Reading documents from files: paths, formats and guards."""

from __future__ import annotations

import os
import re
import shutil
import sys
from collections.abc import Callable, Iterator
from typing import IO

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.sources.books import BookError, book_text
from lectern.sources.html import to_text
from lectern.sources.pdf import pdf_text

#: Characters no path may hold.
FORBIDDEN = "\0|&;`$<>\n\r"
Extractor = Callable[[bytes], str]


class PathError(ValueError):
    """Why a path was refused: ``kind`` is FileNotFound, InvalidPath, NotAFile or IoError."""

    def __init__(self, kind: str, path: str) -> None:
        super().__init__(f"{kind}: {path!r}")
        self.kind = kind


def normalized_path(path: str) -> str:
    """The canonical form of a path to a regular file."""
    if any(c in path for c in FORBIDDEN):
        raise PathError("InvalidPath", path)
    try:
        real = os.path.realpath(path, strict=True)
    except FileNotFoundError:
        raise PathError("FileNotFound", path) from None
    except OSError:
        raise PathError("IoError", path) from None
    if not os.path.isfile(real):
        raise PathError("NotAFile", path)
    return real


def path_allowed(path: Column) -> Column:
    """Whether a path column has no forbidden character."""
    return F.coalesce(~path.rlike("[" + re.escape(FORBIDDEN) + "]"), F.lit(False))


def extension(path: Column) -> Column:
    """The lower-cased extension without its dot, empty if there is none."""
    return F.lower(F.regexp_extract(path, r"\.([^./\\]*)$", 1))


def which(program: str) -> str | None:
    """Where an executable is on the search path."""
    return shutil.which(program)


def _plain(content: bytes) -> str:
    return content.decode("utf-8")


def _page(content: bytes) -> str:
    return to_text(content.decode("utf-8", "replace")) or ""


#: Extractors by extension; those of office and scanned documents are added by the caller, as none is built in.
EXTRACTORS: dict[str, Extractor] = {"epub": book_text, "pdf": pdf_text, "html": _page, "htm": _page, "xhtml": _page}
FALLBACK: tuple[Extractor, ...] = (pdf_text, book_text, _plain)


def extract(path: str, content: bytes, extractors: dict[str, Extractor] | None = None) -> tuple[str | None, str | None]:
    """Text and error of one file: its extension's extractor, else the first of the others that succeeds."""
    table = EXTRACTORS | (extractors or {})
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    tries = [table[ext]] if ext in table else [*(v for k, v in table.items() if k not in EXTRACTORS), *FALLBACK]
    error = None
    for read in tries:
        try:
            return read(content), None
        except (BookError, UnicodeDecodeError, ValueError) as e:
            error = f"{type(e).__name__}: {e}"
    return None, error


def read_documents(spark: SparkSession, path: str, extractors: dict[str, Extractor] | None = None, fail: bool = False) -> DataFrame:
    """``path, ext, text, error`` of all files under a path.

    With ``fail`` a file without text or with only one blank line raises when it is read; otherwise its
    ``error`` says why.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [extract(p, bytes(c), extractors) for p, c in zip(batch["path"], batch["content"], strict=True)]
            yield pd.DataFrame({"path": batch["path"], "text": [t for t, _ in found], "error": [e for _, e in found]})

    read = files.mapInPandas(run, "path string, text string, error string").withColumn("ext", extension(F.col("path")))
    empty = F.when(F.col("error").isNull() & ~F.col("text").rlike(r"\P{IsWhite_Space}"), F.lit("no content"))
    out = read.select("path", "ext", "text", F.coalesce("error", empty).alias("error"))
    return out.withColumn("text", F.when(F.col("error").isNull(), F.col("text")).otherwise(F.raise_error(F.col("error")))) if fail else out


def non_empty(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Documents that have anything but white space."""
    return docs.where(F.col(text_col).rlike(r"\P{IsWhite_Space}"))


def read_text(spark: SparkSession, path: str) -> DataFrame:
    """Whole text files: ``path, text``."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def piped_text(spark: SparkSession, stream: IO[bytes] | None = None, path: str | None = None) -> DataFrame:
    """``path, text`` of what is piped in (``-``), which wins over a file; nothing piped in and no path gives no row.

    ``stream`` is standard input unless given; a terminal counts as nothing. One text is a driver's own
    input and is read there.
    """
    stream = sys.stdin.buffer if stream is None else stream
    content = b"" if stream.isatty() else stream.read()
    if content:
        return spark.createDataFrame([("-", content.decode("utf-8", "replace"))], "path string, text string")
    return read_text(spark, path) if path else spark.createDataFrame([], "path string, text string")


def piped_lines(spark: SparkSession, stream: IO[bytes] | None = None, path: str | None = None) -> DataFrame:
    """The lines of :func:`piped_text`: ``path, line_idx, line``, without the empty one after a last line feed."""
    text = F.regexp_replace("text", r"\r?\n\z", "")
    return piped_text(spark, stream, path).select("path", F.posexplode(F.split(text, r"\r?\n", -1)).alias("line_idx", "line"))


def list_files(spark: SparkSession, path: str, name: str = "*") -> DataFrame:
    """``path, name, ext, length, modified`` of all files under a path whose names fit a pattern. No content is read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", name).load(path)
    base = F.regexp_extract("path", r"([^/]*)$", 1)
    return files.select("path", base.alias("name"), extension(F.col("path")).alias("ext"), "length", F.col("modificationTime").alias("modified"))
