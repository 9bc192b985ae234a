"""EPUB books and other chaptered documents."""

from __future__ import annotations

import io
import posixpath
import struct
import zipfile
import zlib
from collections.abc import Iterator
from urllib.parse import unquote
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.sources.html import to_text

CHAPTER_WIDTH = 110


class BookError(ValueError):
    """A book that can't be read or has no readable content."""


def _named(tree: ElementTree.Element, name: str) -> Iterator[ElementTree.Element]:
    return (x for x in tree.iter() if x.tag.rpartition("}")[2] == name)


def spine(content: bytes) -> list[tuple[int, str, str]]:
    """``(spine_idx, href, xhtml)`` of a book in reading order; resources that are missing are skipped.

    Raises BookError for anything that isn't a book, and for one with a damaged or encrypted member.
    """
    try:
        return _spine(content)
    except (zipfile.BadZipFile, zlib.error, EOFError, LookupError, RuntimeError, NotImplementedError, ElementTree.ParseError, UnicodeError, struct.error) as e:
        raise BookError(f"not a readable book: {type(e).__name__}: {e}") from e


def _spine(content: bytes) -> list[tuple[int, str, str]]:
    book = zipfile.ZipFile(io.BytesIO(content))
    root = ElementTree.fromstring(book.read("META-INF/container.xml"))
    package = [x.attrib["full-path"] for x in _named(root, "rootfile")][0]
    opf = ElementTree.fromstring(book.read(package))
    files = {x.attrib.get("id"): x.attrib.get("href", "") for x in _named(opf, "item")}
    out = []
    for k, ref in enumerate(_named(opf, "itemref")):
        href = files.get(ref.attrib.get("idref"))
        place = posixpath.normpath(posixpath.join(posixpath.dirname(package), unquote(href.partition("#")[0]))) if href else ""
        if place in book.namelist():
            out.append((k, place, book.read(place).decode("utf-8", "replace")))
    return out


def book_text(content: bytes, width: int = CHAPTER_WIDTH) -> str:
    """A book's chapters as text, trimmed, empty ones dropped, joined by blank lines."""
    parts = [t for _, _, x in spine(content) if (t := (to_text(x, width) or "").strip())]
    if not parts:
        raise BookError("No readable content")
    return "\n\n".join(parts)


def chapter_rows(files: DataFrame) -> DataFrame:
    """``path, spine_idx, href, text`` of all books in a ``binaryFile`` relation; unreadable books give no row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    rows += [(path, k, href, (to_text(x, CHAPTER_WIDTH) or "").strip()) for k, href, x in spine(bytes(content))]
                except BookError:
                    continue
            yield pd.DataFrame(rows, columns=["path", "spine_idx", "href", "text"])

    return files.select("path", "content").mapInPandas(run, "path string, spine_idx int, href string, text string")


def joined_chapters(chapters: DataFrame, key: str = "doc_id") -> DataFrame:
    """Chapters ``key, spine_idx, text`` as one text per document, in order, joined by blank lines."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("spine_idx", "text"))), lambda x: x["text"])
    return chapters.groupBy(key).agg(F.array_join(ordered, "\n\n").alias("text"))
