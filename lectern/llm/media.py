"""Media columns: signature sniffing, type correction and carving.

An Aho-Corasick automaton finds every known magic in one pass over the bytes. A hit counts only if the
format's validator can walk the structure from there and tell the length, so magic bytes inside texts
or inside other media's data are not taken for files. Valid hits that lie inside an earlier one are
its content; the rest correct a declared type (a hit at offset 0) or are embedded media to carve out.
"""

from __future__ import annotations

import re
import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import require, spread, utf8

SAMPLE_RATE, BLOCK = 8000, 64
UNKNOWN = "application/octet-stream"


class Bytes:
    """A value with what its validators have found out, so that many hits cost no more than one.

    End marks are searched for once per value, and a walk over chunks that reaches a place where another
    walk has been goes on as that one did.
    """

    def __init__(self, data: bytes) -> None:
        self.data = data
        self._marks: dict[bytes, list[int]] = {}
        self.walked: dict[tuple[str, int], int | None] = {}

    def marks(self, mark: bytes) -> list[int]:
        """All places of an end mark, ascending."""
        if mark not in self._marks:
            self._marks[mark] = [m.start() for m in re.finditer(re.escape(mark), self.data)]
        return self._marks[mark]

    def find(self, mark: bytes, at: int) -> int:
        """The first place of an end mark from ``at`` on, or -1."""
        places = self.marks(mark)
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def walk(self, name: str, place: int, step: Callable[[int], tuple[bool, int | None]]) -> int | None:
        """Where a walk from ``place`` ends: ``step`` gives whether it is over, and the end or the next place."""
        seen = []
        while (name, place) not in self.walked:
            seen.append((name, place))
            over, place_ = step(place)
            if over:
                self.walked[seen[-1]] = place_
                break
            place = place_
        end = self.walked[name, place]
        self.walked.update(dict.fromkeys(seen, end))
        return end


def _wav(value: Bytes, at: int) -> int | None:
    data = value.data
    if len(data) < at + 12 or data[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
    if end > len(data):
        return None
    seen, place = set(), at + 12
    while place + 8 <= end:
        name, size = struct.unpack_from("<4sI", data, place)
        if place + 8 + size > end:
            return None
        seen.add(name)
        place += 8 + size + (size & 1)
        if {b"fmt ", b"data"} <= seen:
            break

    def step(place: int) -> tuple[bool, int | None]:
        if place + 8 > end:
            return True, end
        size = struct.unpack_from("<I", data, place + 4)[0]
        return (True, None) if place + 8 + size > end else (False, place + 8 + size + (size & 1))

    return end - at if {b"fmt ", b"data"} <= seen and value.walk(f"wav {end}", place, step) else None


def _png(value: Bytes, at: int) -> int | None:
    data = value.data

    def step(place: int) -> tuple[bool, int | None]:
        if place + 12 > len(data):
            return True, None
        size, name = struct.unpack_from(">I4s", data, place)
        end = place + 12 + size
        if end > len(data) or zlib.crc32(memoryview(data)[place + 4 : end - 4]) != struct.unpack_from(">I", data, end - 4)[0]:
            return True, None
        return (True, end) if name == b"IEND" else (False, end)

    if data[at + 12 : at + 16] != b"IHDR" or data[at + 8 : at + 12] != b"\0\0\0\r":
        return None
    end = value.walk("png", at + 8, step)
    return None if end is None else end - at


def _gif(value: Bytes, at: int) -> int | None:
    data = value.data

    def table(flags: int) -> int:
        return 3 * 2 ** ((flags & 7) + 1) if flags & 128 else 0

    def blocks(place: int) -> tuple[bool, int | None]:
        if place >= len(data):
            return True, place + 1
        return (False, place + data[place] + 1) if data[place] else (True, place + 1)

    def step(place: int) -> tuple[bool, int | None]:
        if place >= len(data):
            return True, None
        kind = data[place]
        if kind == 0x3B:
            return True, place + 1
        if kind == 0x2C and place + 10 <= len(data):
            place += 11 + table(data[place + 9])
        elif kind == 0x21:
            place += 2
        else:
            return True, None
        return False, value.walk("gif data", place, blocks)

    def image(place: int) -> tuple[bool, int | None]:
        if data[place : place + 1] == b"\x21":
            return False, value.walk("gif data", place + 2, blocks)
        return True, place if data[place : place + 1] == b"\x2c" else None

    if len(data) < at + 13:
        return None
    start = at + 13 + table(data[at + 10])
    # the walk is over at the first trailer, before which there must be an image
    end = value.walk("gif", start, step)
    return end - at if end and value.walk("gif image", start, image) else None


def _jpeg(value: Bytes, at: int) -> int | None:
    data = value.data

    def step(place: int) -> tuple[bool, int | None]:
        if place + 4 > len(data) or data[place] != 0xFF:
            return True, None
        marker, size = data[place + 1], struct.unpack_from(">H", data, place + 2)[0]
        if marker < 0xC0 or size < 2:
            return True, None
        if marker == 0xDA:
            end = value.find(b"\xff\xd9", place + 2 + size)
            return True, None if end < 0 else end + 2
        return False, place + 2 + size

    end = value.walk("jpeg", at + 2, step)
    return None if end is None else end - at


def _bmp(value: Bytes, at: int) -> int | None:
    data = value.data
    if len(data) < at + 26:
        return None
    size, _, start, header = struct.unpack_from("<IIII", data, at + 2)
    return size if header in (12, 40, 52, 56, 108, 124) and 14 + header <= start <= size <= len(data) - at else None


_PDF_END = re.compile(rb"startxref\s+(\d{1,19})\s+%%EOF")


def _pdf(value: Bytes, at: int) -> int | None:
    data = value.data
    if data[at + 5 : at + 6] not in (b"1", b"2") or data[at + 6 : at + 7] != b".":
        return None
    end = value.find(b"%%EOF", at)
    if end < 0 or not at < value.find(b"startxref", at) < end:
        return None
    end += 5
    # linearised and updated files go on: later sections name a table inside the file, up to the next file
    following = min(x for x in (value.find(b"%PDF-1.", end), value.find(b"%PDF-2.", end), len(data)) if x >= 0)
    for start in value.marks(b"startxref")[bisect_left(value.marks(b"startxref"), end) :]:
        if start >= following:
            break
        section = _PDF_END.match(data, start, following)
        if section and int(section[1]) < start - at:
            end = section.end()
    return end - at


def _gzip(value: Bytes, at: int) -> int | None:
    data, reader = value.data, zlib.decompressobj(31)
    place = at
    try:
        while place < len(data) and not reader.eof:
            reader.decompress(data[place : place + 65_536], 1 << 20)
            while reader.unconsumed_tail and not reader.eof:
                reader.decompress(reader.unconsumed_tail, 1 << 20)
            place += 65_536
    except zlib.error:
        return None
    return min(place, len(data)) - len(reader.unused_data) - at if reader.eof else None


def _zip(value: Bytes, at: int) -> int | None:
    data, end = value.data, value.find(b"PK\x05\x06", at)
    if end < 0 or end + 22 > len(data):
        return None
    size, start, note = struct.unpack_from("<IIH", data, end + 12)
    good = at + start + size == end and (not size or data[at + start : at + start + 4] == b"PK\x01\x02")
    return end + 22 + note - at if good and end + 22 + note <= len(data) else None


class Format(NamedTuple):
    """A media type, the magic bytes it starts with, and its validator."""

    media_type: str
    magic: bytes
    length: Callable[[Bytes, int], int | None]


#: The formats' public magic bytes.
FORMATS = (
    Format("audio/wav", b"RIFF", _wav),
    Format("image/png", b"\x89PNG\r\n\x1a\n", _png),
    Format("image/gif", b"GIF87a", _gif),
    Format("image/gif", b"GIF89a", _gif),
    Format("image/jpeg", b"\xff\xd8\xff", _jpeg),
    Format("image/bmp", b"BM", _bmp),
    Format("application/pdf", b"%PDF-", _pdf),
    Format("application/gzip", b"\x1f\x8b\x08", _gzip),
    Format("application/zip", b"PK\x03\x04", _zip),
)


class Found(NamedTuple):
    """A validated medium inside some bytes."""

    media_type: str
    offset: int
    length: int


def _automaton() -> object:
    import ahocorasick

    machine = ahocorasick.Automaton()
    for k, form in enumerate(FORMATS):
        machine.add_word(form.magic.decode("latin-1"), k)
    machine.make_automaton()
    return machine


_MACHINE: list[object] = []


def sniff(data: bytes) -> list[Found]:
    """The outermost valid media in ``data``, by offset."""
    if not _MACHINE:
        _MACHINE.append(_automaton())
    hits = sorted((last - len(FORMATS[k].magic) + 1, k) for last, k in _MACHINE[0].iter(data.decode("latin-1")))
    found, reached, value = [], 0, Bytes(data)
    for at, k in hits:
        if at >= reached and (size := FORMATS[k].length(value, at)):
            found.append(Found(FORMATS[k].media_type, at, size))
            reached = at + size
    return found


def wav_file(samples: bytes, meant: int | None = None, rate: int = SAMPLE_RATE) -> bytes:
    """A mono WAV file of unsigned 8-bit samples; ``meant`` of them, as its fact chunk tells, aren't padding."""
    pad = b"\0" * (len(samples) & 1)
    form = struct.pack("<4sIHHIIHH", b"fmt ", 16, 1, 1, rate, rate, 1, 8)
    fact = struct.pack("<4sII", b"fact", 4, len(samples) if meant is None else meant)
    body = b"WAVE" + form + fact + struct.pack("<4sI", b"data", len(samples)) + samples + pad
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def wav_samples(data: bytes) -> tuple[bytes, int]:
    """The sample bytes of a valid WAV file and how many are meant."""
    place, meant = 12, None
    while place + 8 <= len(data):
        name, size = struct.unpack_from("<4sI", data, place)
        if name == b"fact" and size >= 4:
            meant = struct.unpack_from("<I", data, place + 8)[0]
        if name == b"data":
            return data[place + 8 : place + 8 + size], size if meant is None else meant
        place += 8 + size + (size & 1)
    return b"", 0


def features(samples: bytes) -> str:
    """Mean, spread, zero crossings and byte entropy of 8-bit samples, as fixed-point text."""
    x = np.frombuffer(samples, np.uint8)
    share = np.bincount(x, minlength=256) / max(1, len(x))
    mean = float(share @ np.arange(256))
    spread_ = float(np.sqrt(max(0.0, share @ np.arange(256) ** 2 - mean**2)))
    share = share[share > 0]
    crossings = int(np.count_nonzero((x[1:] >= 128) != (x[:-1] >= 128)))
    return f"n={len(x)};mean={mean:.4f};sd={spread_:.4f};crossings={crossings};entropy={float(-(share * np.log2(share)).sum()):.4f}"


def _in_runs(columns: list[list], weigh: Callable[[int], int], limit: int = 8_000_000) -> Iterator[list[list]]:
    at = size = 0
    for i in range(len(columns[0])):
        size += weigh(i)
        if size >= limit or i + 1 == len(columns[0]):
            yield [c[at : i + 1] for c in columns]
            at, size = i + 1, 0


def store_as_samples(df: DataFrame, key_col: str = "doc_id", text_col: str = "text", declared: str = UNKNOWN) -> DataFrame:
    """Texts as 8-bit WAV files: ``key, declared_type, media``.

    The samples are the UTF-8 bytes and zeros up to a positive multiple of 64; a null text counts as
    empty, a very long one is one file (of less than 4 GB, as the format's lengths have 32 bits).
    ``declared_type`` is what the caller claims, right or wrong. Repeated rows and null keys are stored like
    others, an empty table gives no rows, and other columns are not looked at.
    """
    require(df, key_col, text_col)
    slim = spread(df.select(F.col(key_col).cast("long").alias("key"), utf8(F.col(text_col)).alias("body")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, bodies = batch.column(0).to_pylist(), batch.column(1)
            for k, lows in _in_runs([keys, list(range(len(keys)))], lambda i: len(bodies[i].as_py())):
                raw = [bodies[i].as_py() for i in lows]
                files = [wav_file(x.ljust(max(BLOCK, -(-len(x) // BLOCK) * BLOCK), b"\0"), len(x)) for x in raw]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(k, pa.int64()), pa.array([declared] * len(k), pa.string()), pa.array(files, pa.binary())], names=["key", "declared_type", "media"]
                )

    return slim.mapInArrow(run, "key long, declared_type string, media binary")


CARVED = T.StructType(
    [T.StructField("key", T.LongType()), T.StructField("ordinal", T.IntegerType())]
    + [T.StructField(n, T.StringType()) for n in ("declared_type", "media_type")]
    + [T.StructField(n, T.LongType()) for n in ("offset", "length")]
    + [T.StructField("media", T.BinaryType()), T.StructField("samples", T.BinaryType()), T.StructField("n_samples", T.LongType()), T.StructField("feature", T.StringType())]
)


def carve(df: DataFrame, key_col: str = "key", media_col: str = "media", declared_col: str = "declared_type") -> DataFrame:
    """One row per valid medium in each value: where it lies, its bytes, and 8-bit samples and features if it is audio.

    A value without any valid medium (null and empty ones too) gives one row with ``ordinal`` -1, the
    declared type unless that is a known format (then octet-stream), and null bytes. Repeated rows are
    treated alike; other columns are not looked at.
    """
    require(df, key_col, media_col, declared_col)
    slim = df.select(F.col(key_col).cast("long").alias("key"), F.col(declared_col).alias("declared"), F.col(media_col).alias("media"))
    known = {f.media_type for f in FORMATS}

    def rows(key: int | None, declared: str | None, data: bytes) -> Iterator[tuple]:
        found = sniff(data)
        if not found:
            yield key, -1, declared, UNKNOWN if declared in known else declared, None, None, None, None, None, None
        for n, hit in enumerate(found):
            body = data[hit.offset : hit.offset + hit.length]
            samples, meant = wav_samples(body) if hit.media_type == "audio/wav" else (None, None)
            yield key, n, declared, hit.media_type, hit.offset, hit.length, body, samples, meant, None if samples is None else features(samples)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.string()]
        for batch in batches:
            held, size = [], 0
            for i in range(batch.num_rows):
                data = batch.column(2)[i].as_py() or b""
                held += rows(batch.column(0)[i].as_py(), batch.column(1)[i].as_py(), data)
                size += len(data)
                if size > 8_000_000 or i + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held, strict=True), kinds, strict=True)], names=CARVED.names)
                    held, size = [], 0

    return slim.mapInArrow(run, CARVED)


def corrected_types(df: DataFrame, key_col: str = "key", media_col: str = "media", declared_col: str = "declared_type") -> DataFrame:
    """``key, declared_type, media_type, corrected``: the type that the bytes at offset 0 show, else the declared one.

    Null and empty values, and those of an unknown form, keep the declared type, unless that is a known format
    the bytes don't have. Repeated rows come back repeated, an empty table gives no rows, and other columns
    are not looked at.
    """
    found = carve(df, key_col, media_col, declared_col).where("ordinal <= 0")
    actual = F.when(F.coalesce(F.col("offset"), F.lit(0)) == 0, F.col("media_type")).otherwise(F.lit(UNKNOWN))
    return found.select("key", "declared_type", actual.alias("media_type")).withColumn("corrected", ~F.col("media_type").eqNullSafe(F.col("declared_type")))
