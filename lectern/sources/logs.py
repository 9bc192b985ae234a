"""Stored state: the progress log, bookmarks, highlights and settings, read and written."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from pathlib import Path

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern import schema


#: Times keep their microseconds.
_TIME = "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"


def read_progress(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """Progress events: ``ts, doc, offset, total_lines, percentage, viewport_offset, cursor_y, seq``.

    ``seq`` is the line number in its file, the tie-break of equal times. ``strict`` fails on a bad line;
    otherwise bad lines are left out. The document hash is text, so no unsigned value is lost.
    """
    lines = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), F.posexplode(F.split("value", "\n", -1)).alias("seq", "value")).where("trim(value) <> ''")
    event = F.from_json("value", schema.PROGRESS_LOG, {"mode": "FAILFAST" if strict else "PERMISSIVE"})["UpdateProgress"]
    parsed = lines.select("seq", event.alias("e")).where("e is not null and e.document_hash is not null")
    return parsed.select(
        F.col("e.timestamp").alias("ts"), F.col("e.document_hash").cast("string").alias("doc"), "e.offset", "e.total_lines", "e.percentage", "e.viewport_offset", "e.cursor_y", F.col("seq").cast("long").alias("seq")
    )


def write_progress(events: DataFrame, path: str) -> None:
    """Append ``ts, doc, offset, total_lines[, viewport_offset, cursor_y]`` as JSON lines, with the percentage."""
    have = lambda c: F.col(c).cast("long") if c in events.columns else F.lit(None).cast("long")
    percentage = F.try_divide(F.col("offset").cast("double"), F.col("total_lines").cast("double")) * 100
    body = F.struct(
        F.col("ts").cast("timestamp").alias("timestamp"), F.col("doc").cast("decimal(20,0)").alias("document_hash"), "offset", "total_lines", percentage.alias("percentage"),
        have("viewport_offset").alias("viewport_offset"), have("cursor_y").alias("cursor_y"),
    )
    events.select(body.alias("UpdateProgress")).write.mode("append").option("ignoreNullFields", "false").option("timestampFormat", _TIME).json(path)


def _read_json(spark: SparkSession, path: str, kind: str) -> DataFrame:
    try:
        return spark.read.schema(kind).json(path, multiLine=True)
    except AnalysisException:
        return spark.createDataFrame([], kind)


def read_bookmarks(spark: SparkSession, path: str) -> DataFrame:
    """``file, mark, line, col`` of bookmark files, maps from a letter to a position; none if there is no file."""
    marks = _read_json(spark, path, schema.BOOKMARK_FILE).select(F.input_file_name().alias("file"), F.explode("marks").alias("mark", "at"))
    return marks.select("file", "mark", F.get("at", F.lit(0)).alias("line"), F.get("at", F.lit(1)).alias("col"))


def write_bookmarks(marks: DataFrame, path: str) -> None:
    """Overwrite one file per document from ``doc, mark, line, col``."""
    packed = marks.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("mark", F.array("line", "col")))).alias("marks"))
    packed.write.mode("overwrite").partitionBy("doc").json(path)


def read_highlights(spark: SparkSession, path: str) -> DataFrame:
    """``doc, start, end, created_at`` of highlight files, by start; none if there is no file."""
    found = _read_json(spark, path, schema.HIGHLIGHT_FILE).select(F.col("document_hash").alias("doc"), F.explode("highlights").alias("h"))
    return found.select("doc", "h.start", "h.end", "h.created_at").orderBy("doc", "start")


def write_highlights(highlights: DataFrame, path: str) -> None:
    """Overwrite one file per document from ``doc, start, end, created_at``."""
    packed = highlights.groupBy(F.col("doc").alias("document_hash")).agg(F.array_sort(F.collect_list(F.struct("start", "end", "created_at"))).alias("highlights"))
    packed.withColumn("version", F.lit(1)).withColumn("doc", F.col("document_hash")).write.mode("overwrite").partitionBy("doc").json(path)


def write_text(docs: DataFrame, path: str, text_col: str = "text") -> None:
    """Texts as text files, one line each row's line feeds make."""
    docs.select(F.col(text_col).alias("value")).write.mode("overwrite").text(path)


@dataclass(frozen=True)
class Settings:
    """Optional switches; null ones fall back to what is stored, then to the default."""

    enable_tutorial: bool | None = None
    enable_line_highlighter: bool | None = None
    show_cursor: bool | None = None
    show_progress: bool | None = None
    tutorial_shown: bool | None = None


DEFAULTS = Settings(True, True, True, True, False)


def read_settings(path: str) -> Settings:
    """Settings from ``KEY=value`` lines; only ``true``, ``True`` and ``TRUE`` are true, missing keys null."""
    file = Path(path)
    if not file.exists():
        file.write_text(_written(DEFAULTS))
    pairs = dict(x.split("=", 1) for x in file.read_text().splitlines() if "=" in x and not x.lstrip().startswith("#"))
    values = {k.strip().lower(): v.strip() in ("true", "True", "TRUE") for k, v in pairs.items()}
    return Settings(**{f.name: values.get(f.name) for f in fields(Settings)})


def _written(settings: Settings) -> str:
    return "".join(f"{f.name.upper()}={str(getattr(settings, f.name)).lower()}\n" for f in fields(Settings))


def write_settings(path: str, settings: Settings) -> None:
    """Store settings: the given value, else the stored one, else the default."""
    stored = read_settings(path)
    pick = lambda n: next(v for v in (getattr(settings, n), getattr(stored, n), getattr(DEFAULTS, n)) if v is not None)
    Path(path).write_text(_written(replace(settings, **{f.name: pick(f.name) for f in fields(Settings)})))
