"""Streaming queries over the event table as a file stream, and books made and read back."""

from __future__ import annotations

import io
import uuid
import zipfile
from collections.abc import Iterator
from html import escape

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import text as tx
from lectern.plans import state_queries  # noqa: F401  (its SQL is used below)
from lectern.plans.registry import CHAPTERS, ORACLES, query, table
from lectern.sources import books
from lectern.session import shared_folder
from lectern.streaming import state as stream


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event table as a stream of files."""
    kind = table(spark, sf_dir, "events").schema
    # as a pattern the path may be one file or a folder
    return spark.readStream.schema(kind).parquet(f"{sf_dir}/events.parque[t]")


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


@query(ORACLES["latest_progress"])
def stream_latest_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last progress of every document, kept by a stream."""
    e = _events(spark, sf_dir).select(F.col("user_id").alias("doc"), "ts", F.col("event_id").alias("seq"), F.floor("value").alias("offset"))
    return stream.drained(stream.latest_progress(e), _folder(spark), "complete").select("doc", "offset", "seq")


@query(ORACLES["progress_changes"])
def stream_progress_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that moved to another block of fifty lines, told apart by a stream."""
    block = F.floor(F.floor("value") / 50)
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("doc"), "ts", F.col("event_id").alias("seq"), block.alias("offset"), F.lit(0).cast("long").alias("viewport_offset"))
    moved = stream.drained(stream.changes(e), _folder(spark), "update", ("doc", "seq")).where("changed")
    return moved.select("seq", F.col("doc").cast("long").alias("doc"), F.col("offset").alias("block"))


@query(ORACLES["highlight_toggle"])
def stream_highlight_toggle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Highlights left after every user's toggles, kept by a stream."""
    start = F.col("event_id") % 1000
    e = _events(spark, sf_dir).select(F.col("user_id").cast("string").alias("doc"), "ts", F.col("event_id").alias("seq"), start.alias("start"), (start + 1 + F.floor("value") % 40).alias("end"))
    kept = stream.drained(stream.toggled(e), _folder(spark), "update", ("doc",))
    return kept.select(F.col("doc").cast("long").alias("doc"), F.explode(F.arrays_zip("starts", "ends")).alias("h")).select("doc", F.col("h.starts").alias("start"), F.col("h.ends").alias("end"))


def _book(chapters: list[str]) -> bytes:
    """A minimal EPUB of some chapters."""
    items = "".join(f'<item id="c{k}" href="c{k}.xhtml" media-type="application/xhtml+xml"/>' for k in range(len(chapters)))
    refs = "".join(f'<itemref idref="c{k}"/>' for k in range(len(chapters)))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("META-INF/container.xml", '<container><rootfiles><rootfile full-path="book.opf"/></rootfiles></container>')
        z.writestr("book.opf", f"<package><manifest>{items}</manifest><spine>{refs}</spine></package>")
        for k, text in enumerate(chapters):
            z.writestr(f"c{k}.xhtml", f"<html><body><p>{escape(text)}</p></body></html>")
    return out.getvalue()


@query(
    f"""SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, md5(array_to_string(ws, ' ')) AS words_md5
FROM (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\s+'), lambda x: x <> '') AS ws FROM ({CHAPTERS}))"""
)
def epub_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations made into EPUB books, one chapter a turn, and their words read back in spine order."""
    parts = table(spark, sf_dir, "conversations").select("conv_id", F.struct("turn", F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    whole = parts.groupBy(F.col("conv_id").cast("string").alias("path")).agg(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]).alias("texts"))

    def bind(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "content": [_book(list(x)) for x in batch["texts"]]})

    chapters = books.chapter_rows(whole.mapInPandas(bind, "path string, content binary"))
    text = books.joined_chapters(chapters.select(F.col("path").cast("long").alias("doc_id"), "spine_idx", "text"))
    cut = text.select("doc_id", tx.words(F.col("text")).alias("ws"))
    return cut.select("doc_id", F.size("ws").cast("long").alias("n_words"), F.md5(F.encode(F.array_join("ws", " "), "UTF-8")).alias("words_md5"))


