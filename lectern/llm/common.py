"""Helpers shared by the training-data operators: table access, lineage cuts, bounded fan-out."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import shared_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Read one of the input tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut(df: DataFrame) -> DataFrame:
    """Materialise a slim table in the shared folder and cut its lineage; never used for whole texts."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def require(df: DataFrame, *columns: str) -> None:
    """Fail early, with the missing names, if ``df`` lacks a column."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")


def small_batches(spark: SparkSession) -> None:
    """Lower the session's Arrow batch size to 4 MiB where it is larger, which bounds a worker's memory.

    Texts are held as Arrow, as Python strings and as intermediate arrays at once, by every core.
    """
    name, most = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
    size = spark.conf.get(name, "64m").lower().rstrip("b")
    scale = {"k": 1 << 10, "m": 1 << 20, "g": 1 << 30}.get(size[-1:], 1)
    if float(size.rstrip("kmg") or 0) * scale > most:
        spark.conf.set(name, str(most))


def release() -> None:
    """Give memory that a batch's arrays left behind back to the system.

    Workers stay for many tasks and share their executor's memory; without this the allocators keep
    each one's high-water mark.
    """
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def where_text(docs: DataFrame, keep: Callable[[list[str | None]], list[bool]], text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all their columns, whose texts ``keep`` says to keep, batch by batch.

    Runs as the same kind of Python function as the other operators, so that they share workers.
    """
    require(docs, text_col)
    small_batches(docs.sparkSession)
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(keep(batch.column(place).to_pylist()), pa.bool_()))
            release()

    return docs.mapInArrow(run, docs.schema)


def keyed_groups(batches: Iterator[pa.RecordBatch], limit: int) -> Iterator[tuple[list[np.ndarray], bool]]:
    """Columns of rows sorted by the first one: either whole groups of equal keys, or a piece of one large group.

    A group is held until it has ended or has more than ``limit`` rows; then it comes in pieces, each
    flagged, so memory is bounded by ``limit`` and a batch whatever a key's number of rows.
    """
    held, hot = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        now = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        now = [np.concatenate(x) for x in zip(held, now, strict=True)] if held is not None else now
        held = None
        if hot is not None:
            end = int(np.searchsorted(now[0], hot, "right"))
            if end:
                yield [c[:end] for c in now], True
                now = [c[end:] for c in now]
            if not len(now[0]):
                continue
            hot = None
        last = int(np.searchsorted(now[0], now[0][-1], "left"))
        if last:
            yield [c[:last] for c in now], False
        held = [c[last:] for c in now]
        if len(held[0]) > limit:
            hot = held[0][0]
            yield held, True
            held = None
    if held is not None:
        yield held, False


def utf8(text: Column) -> Column:
    """The UTF-8 bytes of a text; null counts as empty."""
    return F.encode(F.coalesce(text, F.lit("")), "UTF-8")


def unsigned_crc32(text: Column) -> Column:
    """CRC-32 of the UTF-8 bytes as an unsigned long."""
    return F.crc32(utf8(text)).cast("long")


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the id written as text, modulo ``folds``; null for a null id."""
    return F.pmod(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")), F.lit(folds)).cast("int")


def lookup(values: list[int], index: Column) -> Column:
    """``values[index]`` for a short fixed list, as a literal array access."""
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]).cast(T.ArrayType(T.LongType())), (index + 1).cast("int"))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows over the executors' cores if the scan gives fewer partitions than there are cores."""
    small_batches(df.sparkSession)
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores // 2 else df
