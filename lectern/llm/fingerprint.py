"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch keeps the k smallest distinct 64-bit hashes of a text's five-word shingles. Sketches of parts
merge into the sketch of the whole by keeping the k smallest of both, and two sketches estimate the
resemblance and containment of their texts and the number of distinct shingles of either.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import lookup, release, require, small_batches

SKETCH_SIZE, SHINGLE_WORDS = 128, 5
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_STEP, _BLOCK = np.uint64(0x9E3779B97F4A7C15), 1 << 20
_LEAST = -(1 << 63)


class _WordHashes(dict):
    """XXH64 of words; emptied when it grows past 200,000 words, and at the end of a task."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 200_000:
            self.clear()
        self[word] = value = xxhash.xxh64_intdigest(word)
        return value


_HASHES = _WordHashes()


def forget() -> None:
    """Empty the store of words' hashes, as workers go on to other work."""
    _HASHES.clear()
    release()


def mixed(x: np.ndarray) -> np.ndarray:
    """Hashes with all bits depending on all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def sketch(text: str | None, size: int = SKETCH_SIZE, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """The ``size`` smallest distinct shingle hashes, ascending.

    Words are runs without ASCII white space, A-Z lower-cased. A text of fewer words than a shingle is
    one shingle; a null text or one without words has an empty sketch.
    """
    least = np.empty(0, np.uint64)
    for part in _hashed(text, shingle):
        least = np.unique(np.concatenate([least, part]))[:size]
    return least


def _hashed(text: str | None, shingle: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, about a million at a time."""
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    width = min(shingle, len(words))
    for at in range(0, len(words) - width + 1 if words else 0, _BLOCK):
        part = words[at : at + _BLOCK + width - 1]
        codes = np.fromiter(map(_HASHES.__getitem__, part), np.uint64, len(part))
        n = len(part) - width + 1
        value = np.full(n, width, np.uint64)
        for k in range(width):
            value = value * _STEP + codes[k : k + n]
        yield mixed(value)


def shingle_hashes(text: str | None, shingle: int = SHINGLE_WORDS) -> np.ndarray:
    """All distinct shingle hashes of a text, ascending; what :func:`sketch` keeps the least of."""
    return np.unique(np.concatenate([np.empty(0, np.uint64), *_hashed(text, shingle)]))


def merge(a: np.ndarray, b: np.ndarray, size: int = SKETCH_SIZE) -> np.ndarray:
    """The sketch of the union of two shingle sets, from their sketches."""
    return np.union1d(a, b)[:size]


def resemblance(a: np.ndarray, b: np.ndarray, size: int = SKETCH_SIZE) -> float:
    """Estimated Jaccard similarity; exact while both sets fit their sketches. Two empty sets are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.sort(np.concatenate([a, b]))
    twice = both[1:] == both[:-1]
    keep = np.r_[True, ~twice]
    union = both[keep][:size]
    return float(np.count_nonzero(both[1:][twice] <= union[-1]) / len(union))


def distinct_shingles(a: np.ndarray, size: int = SKETCH_SIZE) -> float:
    """Estimated number of distinct shingles; exact while they fit the sketch."""
    return float(len(a)) if len(a) < size else (size - 1) / ((float(a[-1]) + 1) / 2**64)


def containment(a: np.ndarray, b: np.ndarray, size: int = SKETCH_SIZE) -> float:
    """Estimated share of ``a``'s shingles that ``b`` has too."""
    if not len(a):
        return 1.0
    alike, n, m = resemblance(a, b, size), distinct_shingles(a, size), distinct_shingles(b, size)
    return min(1.0, alike * (n + m) / (1 + alike) / n)


def to_text(a: np.ndarray) -> str:
    """A sketch as a string: base64 of its big-endian hashes."""
    return base64.b64encode(a.astype(">u8").tobytes()).decode("ascii")


def from_text(text: str) -> np.ndarray:
    """Inverse of :func:`to_text`."""
    return np.frombuffer(base64.b64decode(text), ">u8").astype(np.uint64)


@F.pandas_udf(T.StringType())
def _fingerprints(texts: pd.Series) -> pd.Series:
    return pd.Series([to_text(sketch(x if isinstance(x, str) else None)) for x in texts], dtype=object)


def fingerprint(text: Column) -> Column:
    """The fingerprint string of a text column."""
    return _fingerprints(text)


@F.pandas_udf(T.StructType([T.StructField(n, T.DoubleType()) for n in ("resemblance", "containment", "distinct")]))
def _likeness(a: pd.Series, b: pd.Series) -> pd.DataFrame:
    pairs = [(from_text(x), from_text(y)) for x, y in zip(a, b, strict=True)]
    return pd.DataFrame([(resemblance(x, y), containment(x, y), distinct_shingles(x)) for x, y in pairs], columns=["resemblance", "containment", "distinct"])


def likeness(a: Column, b: Column) -> Column:
    """Resemblance, containment of ``a`` in ``b`` and distinct shingles of ``a`` for two fingerprint columns."""
    return _likeness(a, b)


def edited_text(text: str, following: str) -> str:
    """``text`` with its last third replaced by as many first characters of ``following``."""
    part = len(text) // 3
    return text[: len(text) - part] + following[:part]


EDITED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_chars", T.LongType(), False)]
    + [T.StructField(n, T.StringType(), False) for n in ("edited_sha256", "fingerprint", "edited_fingerprint")]
    + [T.StructField(n, T.DoubleType(), False) for n in ("near_edited", "near_next", "kept_in_edited", "n_shingles")]
)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows by bucket and descending id in; each is finished when the next one comes. Ghosts only follow."""
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4]
    rows, held, bucket = [], None, None

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=EDITED.names)

    for batch in batches:
        for place, ghost, doc, text in zip(*(c.to_pylist() for c in batch.columns[-4:]), strict=True):
            if place != bucket:
                held, bucket = None, place
            if ghost and held is None:
                continue
            own = sketch(text)
            if held is not None:
                last_doc, last_text, last = held
                edited = edited_text(last_text, text)
                changed = sketch(edited)
                digest = hashlib.sha256(edited.encode("utf-8", "replace")).hexdigest()
                near = resemblance(last, changed), resemblance(last, own), containment(last, changed), distinct_shingles(last)
                rows.append((last_doc, len(last_text), digest, to_text(last), to_text(changed), *near))
                if len(rows) >= 2000:
                    yield flush()
                    rows = []
            held = None if ghost else (doc, text, own)
        release()
    if rows:
        yield flush()
    forget()


def _ranges(order: Column, low: int, high: int, cuts: list[int], fine: int) -> Column:
    """The number of an id's range: between which cuts it lies, and which of ``fine`` equal parts in between."""
    lows, highs = [low, *cuts], [*cuts, high + 1]
    longs = lambda xs: F.array(*map(F.lit, xs)).cast("array<long>")
    index = F.size(F.filter(longs(cuts), lambda c: c <= order))
    start, end = (F.get(longs(xs), index).cast("double") for xs in (lows, highs))
    part = F.floor((order.cast("double") - start) / F.greatest(end - start, F.lit(1.0)) * fine)
    return (index * fine + F.least(part, F.lit(fine - 1))).cast("int")


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_ranges: int = 65_536) -> DataFrame:
    """Fingerprint every text and the text edited with its successor in descending id order.

    ``near_edited`` and ``near_next`` estimate the resemblance to the edited and to the next text,
    ``kept_in_edited`` the share of the text's shingles that the edited one still has, and ``n_shingles``
    the number of distinct shingles.

    The successor of the least id is the greatest. Ids are cut into at most ``max_ranges`` ranges, one
    shuffle brings each range's texts together in order, and the first document of the next range comes
    along as a ghost; only one id per range reaches the driver and is broadcast. Null texts count as
    empty, a null id sorts below all others, repeated ids follow each other by text. An empty table gives
    no rows; other columns are not looked at.
    """
    require(docs, id_col, text_col)
    spark = docs.sparkSession
    small_batches(spark)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(_LEAST))
    count = min(max_ranges, 3 * max(slim.rdd.getNumPartitions(), spark.sparkContext.defaultParallelism))
    coarse = min(count, 256)
    shares = [k / coarse for k in range(1, coarse)]
    ids = slim.agg(F.min(order).alias("low"), F.max(order).alias("high"), F.percentile_approx(order, shares or [0.5], 10_000).alias("cuts")).first()
    if ids["low"] is None:
        return spark.createDataFrame([], EDITED)
    cuts = sorted({c for c in ids["cuts"] if c > ids["low"]})
    bucket = _ranges(order, ids["low"], ids["high"], cuts, -(-count // coarse))
    tops = sorted((r["bucket"], r["top"]) for r in slim.groupBy(bucket.alias("bucket")).agg(F.max(order).alias("top")).collect())
    ghosts = spark.createDataFrame([(top, tops[(k + 1) % len(tops)][0]) for k, (_, top) in enumerate(tops)], "top long, target int")
    # at most max_ranges rows of two numbers
    placed = slim.withColumn("order", order).join(F.broadcast(ghosts), F.col("order") == F.col("top"), "left")
    place = lambda at, ghost: F.struct(at.alias("bucket"), F.lit(ghost).alias("ghost"))
    own = place(bucket, False)
    places = F.when(F.col("target").isNull(), F.array(own)).otherwise(F.array(own, place(F.col("target"), True)))
    dealt = placed.select(F.explode(places).alias("at"), "doc_id", "text").select("at.bucket", "at.ghost", "doc_id", "text")
    # hashing the ranges themselves would leave some tasks without one and give others three
    even = lookup(_one_per_partition(spark, count), F.pmod(F.col("bucket"), F.lit(count)))
    sorted_ = dealt.withColumn("deal", even).select("deal", "bucket", "ghost", "doc_id", "text").repartition(count, "deal")
    return sorted_.sortWithinPartitions("bucket", "ghost", F.desc_nulls_last("doc_id"), "text").mapInArrow(_chain, EDITED)


def _one_per_partition(spark: SparkSession, count: int) -> list[int]:
    """For each of ``count`` partitions a number that Spark's hash partitioning deals to it."""
    some = spark.range(0, 16 * count + 64, 1, 1).select("id", F.pmod(F.hash("id"), F.lit(count)).alias("p"))
    found = {r["p"]: r["id"] for r in some.groupBy("p").agg(F.min("id").alias("id")).collect()}
    return [found.get(p, p) for p in range(count)]


def _merged_runs(size: int, sorted_rows: bool):  # noqa: ANN202
    """Merge the sketches of rows with equal keys: of sorted rows one after the other, of others some thousand keys at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        schema = None

        def out() -> pa.RecordBatch:
            columns = [*zip(*held, strict=True), [to_text(x) for x in held.values()]]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], names=schema.names)

        for batch in batches:
            schema = batch.schema
            for *key, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                key = tuple(key)
                if key not in held and len(held) >= (1 if sorted_rows else 4096):
                    yield out()
                    held.clear()
                held[key] = merge(held[key], from_text(text), size) if key in held else from_text(text)
        if held:
            yield out()

    return run


def merge_sketches(sketches: DataFrame, *keys: str, col: str = "fingerprint", size: int = SKETCH_SIZE) -> DataFrame:
    """``keys`` and the fingerprint of the union of all parts' shingles, one row per key.

    Parts are merged where they lie first, so a key that most rows share is shuffled as one row per task
    and some thousand keys; then one running sketch per key is all that a task holds. Null keys are a key,
    null fingerprints and empty tables give no rows, repeated rows change nothing.
    """
    require(sketches, *keys, col)
    slim = sketches.where(F.col(col).isNotNull()).select(*keys, col)
    parts = slim.mapInArrow(_merged_runs(size, False), slim.schema)
    dealt = parts.repartition(*keys) if keys else parts.coalesce(1)
    return (dealt.sortWithinPartitions(*keys) if keys else dealt).mapInArrow(_merged_runs(size, True), slim.schema)
