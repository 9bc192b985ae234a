"""Language identification with string kernels.

Two texts are compared by the blended-spectrum presence kernel: the number of n-grams of one to four
letters that both contain, over the geometric mean of what each contains. n-grams are hashed to
``BUCKETS`` places. A long text would set them all, whatever its language, so texts are compared in segments
of at most ``SEGMENT`` characters, each a bitmap, and a text's margins are its segments' mean. Nyström landmarks turn the kernel
into a feature map, and one-versus-rest kernel ridge regression fits a weight vector per language.
Scoring multiplies a batch of bitmaps with the landmarks' bitmaps and then with the weights.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import release, require, where_text

BUCKETS, ORDERS = 1 << 14, (1, 2, 3, 4)
UNKNOWN = "und"
_BLOCK = 1 << 18
#: Most characters of a segment, whose n-grams, four a character, can set half the places at most.
SEGMENT = 2048
#: Segments of a training text, evenly spread over it.
TRAINING_SEGMENTS = 4
#: Bounds of the fit, shared by all languages: texts, at least eight a language, and landmarks.
SAMPLE_TEXTS, LANDMARKS, _HELD = 20_000, 2048, 512


def _letters() -> np.ndarray:
    """Lower-case letters map to themselves, capitals to theirs, all else to a blank."""
    table = np.full(0x10000, 32, np.uint32)
    for c in range(0x10000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


_TABLE: list[np.ndarray] = []
_FACTORS = [np.uint32(x) for x in (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)]


def mark(text: str | None, flags: np.ndarray) -> bool:
    """Set the flags of a text's n-grams; False if the text has no letter."""
    if not _TABLE:
        _TABLE.append(_letters())
    table, found = _TABLE[0], False
    text = text or ""
    for at in range(0, len(text), _BLOCK):
        points = np.frombuffer(text[max(0, at - 3) : at + _BLOCK].encode("utf-32-le", "replace"), np.uint32)
        high = points > 0xFFFF
        codes = table[np.where(high, 0, points)]
        if high.any():
            codes[high] = [ord(x.lower()) if (x := chr(p)).isalpha() else 32 for p in points[high].tolist()]
        solid = np.ones(len(codes), bool)
        solid[1:] = (codes[1:] != 32) | (codes[:-1] != 32)
        codes = codes[solid]
        if not (codes != 32).any():
            continue
        found = True
        codes = np.concatenate([[np.uint32(32)], codes, [np.uint32(32)]])
        for n in ORDERS:
            value = np.full(max(0, len(codes) - n + 1), n, np.uint32)
            for k in range(n):
                value = (value ^ codes[k : k + len(value)]) * _FACTORS[k]
                value ^= value >> np.uint32(15)
            flags[value & np.uint32(BUCKETS - 1)] = 1
    return found


def segments(text: str | None) -> list[str]:
    """A text cut into equal parts of at most ``SEGMENT`` characters; n-grams over a border are in the later one."""
    text = text or ""
    parts = max(1, -(-len(text) // SEGMENT))
    ends = [len(text) * k // parts for k in range(parts + 1)]
    return [text[max(0, a - 3) : b] for a, b in zip(ends, ends[1:], strict=False)]


class Model(NamedTuple):
    """Landmark bitmaps (packed), the weights behind them and the languages in order."""

    landmarks: np.ndarray
    sizes: np.ndarray
    weights: np.ndarray
    languages: list[str]


def _dense(landmarks: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(np.unpackbits(landmarks, axis=1).T.astype(np.float32))


def _held(landmarks: np.ndarray) -> np.ndarray:
    """Unpacked landmarks for repeated use, or packed ones if they are many."""
    return _dense(landmarks) if len(landmarks) <= _HELD else landmarks


def _kernel(x: np.ndarray, sizes: np.ndarray, landmarks: np.ndarray, landmark_sizes: np.ndarray) -> np.ndarray:
    if landmarks.dtype == np.uint8:
        common = np.concatenate([x @ _dense(landmarks[at : at + _HELD]) for at in range(0, len(landmarks), _HELD)], axis=1)
    else:
        common = x @ landmarks
    return common / np.sqrt(np.maximum(sizes, 1))[:, None] / np.sqrt(np.maximum(landmark_sizes, 1))[None, :]


def fit(bitmaps: np.ndarray, languages: list[str], landmarks_per_language: int = 16, ridge: float = 1e-3, chunk: int = 1024) -> Model:
    """Fit from packed bitmaps (one row per training text) and their languages.

    Every language gets weights. Where there are too many for ``LANDMARKS`` landmarks, each has fewer or,
    beyond one each, every so many languages have one.
    """
    names = sorted(set(languages))
    number = {n: k for k, n in enumerate(names)}
    owner = np.array([number[x] for x in languages])
    order = np.argsort(owner, kind="stable")
    place = np.arange(len(order)) - np.searchsorted(owner[order], np.arange(len(names)))[owner[order]]
    chosen = order[place < max(1, min(landmarks_per_language, LANDMARKS // len(names)))]
    if len(chosen) > LANDMARKS:
        chosen = chosen[np.linspace(0, len(chosen) - 1, LANDMARKS).astype(int)]
    landmarks, packed = _held(bitmaps[chosen]), bitmaps[chosen]
    landmark_sizes = np.bitwise_count(packed).sum(axis=1).astype(np.float32)

    def against(rows: np.ndarray) -> np.ndarray:
        x = np.unpackbits(bitmaps[rows], axis=1).astype(np.float32)
        return _kernel(x, x.sum(axis=1), landmarks, landmark_sizes).astype(float)

    among = np.concatenate([against(chosen[at : at + chunk]) for at in range(0, len(chosen), chunk)])
    values, vectors = np.linalg.eigh((among + among.T) / 2)
    good = values > 1e-6 * values.max()
    whiten = vectors[:, good] / np.sqrt(values[good])
    balance = (1 / np.bincount(owner))[owner]
    balance *= len(owner) / balance.sum()
    width = whiten.shape[1] + 1
    gram, aims = ridge * len(owner) / 100 * np.eye(width), np.zeros((width, len(names)))
    for at in range(0, len(owner), chunk):
        rows = np.arange(at, min(at + chunk, len(owner)))
        phi = np.c_[against(rows) @ whiten, np.ones(len(rows))]
        weighted = phi * balance[rows, None]
        gram += phi.T @ weighted
        np.add.at(aims.T, owner[rows], weighted)
    solved = np.linalg.solve(gram, aims)
    weights = np.r_[whiten @ solved[:-1], solved[-1:]]
    return Model(packed, landmark_sizes, weights.astype(np.float32), names)


def predict(model: Model, texts: list[str | None], batch: int = 256) -> tuple[list[str], np.ndarray]:
    """Languages and scores (0 to 1) of some texts; ``und`` with score 0 where there is no letter.

    All segments of a text count, each by the n-grams it holds.
    """
    landmarks = _held(model.landmarks)
    margins, weight = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts))
    space, owners = np.zeros((batch, BUCKETS), np.float32), []

    def score() -> None:
        x = space[: len(owners)]
        sizes = x.sum(axis=1)
        found = _kernel(x, sizes, landmarks, model.sizes) @ model.weights[:-1] + model.weights[-1]
        np.add.at(margins, owners, found * sizes[:, None])
        np.add.at(weight, owners, sizes)
        x.fill(0)
        owners.clear()

    for i, text in enumerate(texts):
        for part in segments(text):
            if mark(part, space[len(owners)]):
                owners.append(i)
            if len(owners) == batch:
                score()
    score()
    margins /= np.maximum(weight, 1)[:, None]
    best = margins.argmax(axis=1)
    scores = np.where(weight > 0, np.clip(margins[np.arange(len(texts)), best], 0, 1), 0)
    return [model.languages[b] if w else UNKNOWN for b, w in zip(best.tolist(), weight.tolist(), strict=True)], scores


def _bitmaps(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names, maps = [], []
        for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parts = segments(text)
            few = min(len(parts), most)
            for k in range(few):
                flags = np.zeros(BUCKETS, np.uint8)
                if mark(parts[(2 * k + 1) * len(parts) // (2 * few)], flags):
                    names.append(name)
                    maps.append(np.packbits(flags).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(maps, pa.binary())], names=["lang", "bits"])


def train(labelled: DataFrame, sample_per_language: int = 400, text_col: str = "text", lang_col: str = "lang") -> Model:
    """Fit on a bounded sample of labelled rows of every language.

    About ``sample_per_language`` distinct texts of each language are taken by hash, evenly over them, so
    copies of a text neither crowd out others nor reach the driver; or fewer, about ``SAMPLE_TEXTS`` over the number of languages but 8 at least, where languages
    are many; a language always has one. Of each text at most ``TRAINING_SEGMENTS`` segments are taken
    evenly over the text; only fixed-size bitmaps reach the driver. Rows without a language or without
    letters are not used. Raises ValueError if nothing is left.
    """
    rows = labelled.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where(F.col("text").rlike(r"\p{L}"))
    rows = rows.withColumn("hash", F.xxhash64("text"))
    span = 1 << 30
    place = F.pmod(F.col("hash"), F.lit(span))
    found = rows.select("lang", "hash").distinct().groupBy("lang").agg(F.count("*").alias("n"), F.min(place).alias("least")).collect()
    if not found:
        raise ValueError("no labelled texts to learn a language from")
    each = min(sample_per_language, max(8, SAMPLE_TEXTS // len(found)))
    most = max(1, min(TRAINING_SEGMENTS, SAMPLE_TEXTS * TRAINING_SEGMENTS // (each * len(found))))
    limits = labelled.sparkSession.createDataFrame([(r["lang"], int(max(r["least"], min(span, span * each / r["n"]))) + 1) for r in found], "lang string, below long")
    sample = rows.join(F.broadcast(limits), "lang").where(place < F.col("below")).dropDuplicates(["lang", "hash"]).select("lang", "text").mapInArrow(lambda batches: _bitmaps(batches, most), "lang string, bits binary")
    seen = sorted({(r["lang"], bytes(r["bits"])) for r in sample.collect()})
    if not seen:
        raise ValueError("no labelled texts to learn a language from")
    order = np.random.default_rng(5).permutation(len(seen))
    bits = np.frombuffer(b"".join(seen[i][1] for i in order), np.uint8).reshape(len(seen), -1)
    return fit(bits, [seen[i][0] for i in order])


def identify(text: Column, model: Model) -> Column:
    """A struct ``lang_pred, score`` for a text column; the model's size is fixed by its landmarks."""

    @F.pandas_udf(T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))
    def run(texts: pd.Series) -> pd.DataFrame:
        langs, scores = predict(model, [x if isinstance(x, str) else None for x in texts])
        release()
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return run(text)


def accepted(docs: DataFrame, model: Model, least_score: float, text_col: str = "text") -> DataFrame:
    """The rows whose texts are in one of the model's languages with at least ``least_score``, with all their columns.

    Null texts and texts without letters are in none. Repeated rows are kept or dropped alike, an empty table
    gives no rows, and columns of any other name are carried along.
    """

    def keep(texts: list[str | None]) -> list[bool]:
        langs, scores = predict(model, texts)
        return [lang != UNKNOWN and score >= least_score for lang, score in zip(langs, scores.tolist(), strict=True)]

    return where_text(docs, keep, text_col)


def identify_languages(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, lang_pred, score`` for every row.

    Null texts and texts without letters are ``und`` with score 0. Repeated rows come back repeated, an
    empty table gives no rows, and other columns are not looked at.
    """
    require(docs, id_col, text_col)
    return docs.select(F.col(id_col), identify(F.col(text_col), model).alias("found")).select(id_col, "found.lang_pred", "found.score")
