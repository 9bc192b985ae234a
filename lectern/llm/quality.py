"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. A line's evidence is a sum of weights picked by bins of its own measures
(share of letters, capitals, digits and symbols, word lengths, repetition, ...) and by the same bins of
the lines before and after it; a transition weight couples neighbouring labels. Forward-backward gives
each line's marginal, and the length-weighted mean of the marginals is the document's raw quality, which a
logistic curve fitted on the training documents turns into a score. Line labels are not observed:
training gives every line of a document the document's label.
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

from lectern.llm.common import release, require, small_batches, where_text

THRESHOLD = 0.7
_LOWER, _UPPER, _DIGIT, _BLANK, _POINT, _SYMBOL = range(6)
#: Bin edges by measure: shares of letters, capitals among letters, digits, points, symbols, blanks; mean word
#: length; distinct words among words; repeats of the word before; words; repeated symbols; code points.
EDGES = (
    (0.3, 0.5, 0.6, 0.7, 0.75, 0.8, 0.85),
    (0.01, 0.05, 0.1, 0.2, 0.5, 0.9),
    (0.001, 0.02, 0.05, 0.1, 0.3),
    (0.001, 0.01, 0.02, 0.04, 0.08, 0.2),
    (0.001, 0.01, 0.03, 0.06, 0.1, 0.2),
    (0.02, 0.1, 0.14, 0.18, 0.25, 0.5),
    (2, 3, 4, 5, 6, 7, 9, 12),
    (0.1, 0.25, 0.4, 0.6, 0.8, 0.95),
    (0.001, 0.05, 0.2, 0.5),
    (1.5, 3.5, 8.5, 15.5, 30.5, 100.5),
    (0.001, 0.02, 0.06, 0.12),
    (1.5, 20.5, 60.5, 150.5, 400.5, 2000.5),
)
BINS = 10
_BLOCK = 200_000


def _classes() -> np.ndarray:
    table = np.full(0x10000, _SYMBOL, np.uint8)
    for c in range(0x10000):
        x = chr(c)
        if x.isalpha():
            table[c] = _UPPER if x.isupper() else _LOWER
        elif x.isdigit():
            table[c] = _DIGIT
        elif x.isspace():
            table[c] = _BLANK
    table[[ord(x) for x in ".,;:!?'\"()-"]] = _POINT
    return table


_TABLE: list[np.ndarray] = []


def line_bins(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Bin numbers (lines × measures) and lengths of a text's lines; an empty text is one empty line.

    Lines end at line feeds. A very long line is counted block by block, so that it needs no more memory
    than others do, and is one line.
    """
    if not _TABLE:
        _TABLE.append(_classes())
    lines, out, at = (text or "").split("\n"), [], 0
    while at < len(lines):
        if len(lines[at]) > _BLOCK:
            out.append(_count_long(lines[at]))
            at += 1
            continue
        end, size = at, 0
        while end < len(lines) and size < _BLOCK and len(lines[end]) <= _BLOCK:
            size += len(lines[end]) + 1
            end += 1
        out.append(_count(lines[at:end]))
        at = end
    counts = np.concatenate(out)
    return _binned(counts), counts[:, _LENGTH].astype(np.int64)


#: Columns of a line's counts, after the six kinds of characters.
_DOUBLED, _WORDS, _DISTINCT, _REPEATS, _LENGTH = range(6, 11)


def _kinds(text: str) -> tuple[np.ndarray, np.ndarray]:
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    return points, _TABLE[0][np.minimum(points, 0xFFFF)]


def _count(lines: list[str]) -> np.ndarray:
    """What the measures are made of, one row per line."""
    points, kind = _kinds("\n".join(lines))
    n = np.array([len(x) for x in lines], np.int64)
    owner = np.repeat(np.arange(len(lines)), np.r_[n[:-1] + 1, n[-1:]])
    counts = np.zeros((len(lines), _LENGTH + 1))
    counts[:, :6] = np.bincount(owner * 6 + kind, minlength=6 * len(lines)).reshape(-1, 6)
    counts[:-1, _BLANK] -= 1
    if len(points) > 1:
        same = (points[1:] == points[:-1]) & (kind[1:] >= _POINT)
        counts[:, _DOUBLED] = np.bincount(owner[1:][same], minlength=len(lines))
    words = [x.split() for x in lines]
    counts[:, _WORDS] = [len(w) for w in words]
    counts[:, _DISTINCT] = [len(set(w)) for w in words]
    counts[:, _REPEATS] = [sum(map(str.__eq__, w, w[1:])) for w in words]
    counts[:, _LENGTH] = n
    return counts


def _count_long(line: str) -> np.ndarray:
    """The same of one line, by blocks; words and doubled characters over a border count once."""
    counts, seen, last, open_word = np.zeros((1, _LENGTH + 1)), set(), None, ""
    for at in range(0, len(line), _BLOCK):
        block = line[at : at + _BLOCK]
        points, kind = _kinds(line[max(0, at - 1) : at + _BLOCK])
        counts[0, _DOUBLED] += np.count_nonzero((points[1:] == points[:-1]) & (kind[1:] >= _POINT))
        counts[0, :6] += np.bincount(kind[1 if at else 0 :], minlength=6)
        words = (open_word + block).split()
        # the last word may go on in the next block
        open_word = words.pop() if words and not block[-1].isspace() else ""
        if at + _BLOCK >= len(line) and open_word:
            words.append(open_word)
        seen.update(words)
        counts[0, _WORDS] += len(words)
        counts[0, _REPEATS] += sum(map(str.__eq__, words, words[1:])) + bool(words and words[0] == last)
        last = words[-1] if words else last
    counts[0, _DISTINCT], counts[0, _LENGTH] = len(seen), len(line)
    return counts


def _binned(counts: np.ndarray) -> np.ndarray:
    n, words = counts[:, _LENGTH], counts[:, _WORDS]
    size, some = np.maximum(n, 1), np.maximum(words, 1)
    letters = counts[:, _LOWER] + counts[:, _UPPER]
    measures = (
        letters / size, counts[:, _UPPER] / np.maximum(letters, 1), counts[:, _DIGIT] / size, counts[:, _POINT] / size, counts[:, _SYMBOL] / size,
        counts[:, _BLANK] / size, (n - counts[:, _BLANK]) / some, counts[:, _DISTINCT] / some, counts[:, _REPEATS] / some, words, counts[:, _DOUBLED] / size, n,
    )
    return np.stack([np.searchsorted(e, m, "right") for e, m in zip(EDGES, measures, strict=True)], axis=1).astype(np.uint8)


class Model(NamedTuple):
    """Weights by (own, previous, next) × measure × bin, bias, transition weight, and the logistic curve."""

    weights: np.ndarray
    bias: float
    couple: float
    slope: float
    shift: float


_OFFSETS = np.arange(len(EDGES)) * BINS


def _places(bins: np.ndarray) -> np.ndarray:
    """Weight numbers that each line picks: its own, the line before's, the line after's."""
    own = bins.astype(np.int64) + _OFFSETS
    edge = np.full((1, own.shape[1]), BINS - 1) + _OFFSETS
    width = BINS * len(EDGES)
    return np.concatenate([own, width + np.r_[edge, own[:-1]], 2 * width + np.r_[own[1:], edge]], axis=1)


def marginals(evidence: np.ndarray, couple: float) -> np.ndarray:
    """P(good) of every line of a chain, by forward-backward in odds form."""
    grow, shrink = float(np.exp(couple)), float(np.exp(-couple))
    odds = np.exp(np.clip(evidence, -30, 30)).tolist()
    n, forward, message = len(odds), [0.0] * len(odds), 1.0
    for t in range(n):
        forward[t] = here = message * odds[t]
        message = (here * grow + shrink) / (here * shrink + grow)
    out, message = [0.0] * n, 1.0
    for t in range(n - 1, -1, -1):
        both = forward[t] * message
        out[t] = both / (1 + both)
        here = message * odds[t]
        message = (here * grow + shrink) / (here * shrink + grow)
    return np.array(out)


def raw_quality(model: Model, text: str | None) -> float:
    """The length-weighted mean of the lines' P(good)."""
    bins, n = line_bins(text)
    good = marginals(model.weights[_places(bins)].sum(axis=1) + model.bias, model.couple)
    weight = np.maximum(n, 1)
    return float((good * weight).sum() / weight.sum())


def score(model: Model, text: str | None) -> float:
    """Quality between 0 and 1."""
    return _curve(raw_quality(model, text), model.slope, model.shift)


def _logit(p: np.ndarray | float) -> np.ndarray | float:
    p = np.clip(p, 1e-4, 1 - 1e-4)
    return np.log(p / (1 - p))


def _curve(raw: float, slope: float, shift: float) -> float:
    return float(1 / (1 + np.exp(-(slope * _logit(raw) + shift))))


def fit(documents: list[np.ndarray], lengths: list[np.ndarray], labels: np.ndarray, rounds: int = 120, rate: float = 0.08, decay: float = 0.002) -> Model:
    """Fit on the line bins, line lengths and labels (0 or 1) of documents, by Adam on the CRF's likelihood.

    The mean over documents of each chain's mean log-likelihood per line is maximised, classes weighted
    alike; ``decay`` pulls weights and coupling to zero.
    """
    count = np.bincount(labels, minlength=2)
    balance = np.where(labels == 1, 0.5 / max(1, count[1]), 0.5 / max(1, count[0]))
    order = np.argsort([len(d) for d in documents], kind="stable")
    batches = []
    for part in _padded(order, documents):
        width = max(len(documents[i]) for i in part)
        places = np.zeros((len(part), width, 3 * len(EDGES)), np.int32)
        mask = np.zeros((len(part), width))
        for r, i in enumerate(part):
            places[r, : len(documents[i])] = _places(documents[i])
            mask[r, : len(documents[i])] = 1
        batches.append((places, mask, labels[part], balance[part] / mask.sum(axis=1)))
    theta = np.zeros(3 * BINS * len(EDGES) + 2)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, rounds + 1):
        slope = -decay * np.r_[theta[:-2], 0, 20 * theta[-1]]
        for places, mask, label, weight in batches:
            node, edge = _expected(theta[:-2][places].sum(axis=2) + theta[-2], theta[-1], mask)
            miss = (label[:, None] - node) * mask * weight[:, None]
            slope[:-2] += np.bincount(places.ravel(), np.repeat(miss.ravel(), places.shape[2]), minlength=len(theta) - 2)
            slope[-2] += miss.sum()
            slope[-1] += ((1 - edge) * mask[:, 1:] * weight[:, None]).sum()
        first, second = 0.9 * first + 0.1 * slope, 0.99 * second + 0.01 * slope**2
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    model = Model(theta[:-2].copy(), float(theta[-2]), float(theta[-1]), 1.0, 0.0)
    raw = []
    for bins, n in zip(documents, lengths, strict=True):
        good = marginals(model.weights[_places(bins)].sum(axis=1) + model.bias, model.couple)
        raw.append((good * np.maximum(n, 1)).sum() / np.maximum(n, 1).sum())
    return model._replace(**_calibrate(_logit(np.array(raw)), labels))


def _padded(order: np.ndarray, documents: list[np.ndarray], cells: int = 20_000) -> Iterator[np.ndarray]:
    """Runs of documents, shortest first, whose padded chains hold at most ``cells`` lines."""
    at = 0
    while at < len(order):
        end = at + 1
        while end < len(order) and (end + 1 - at) * len(documents[order[end]]) <= cells:
            end += 1
        yield order[at:end]
        at = end


def _calibrate(x: np.ndarray, labels: np.ndarray) -> dict[str, float]:
    """Newton steps for a lightly penalised logistic curve; its slope is kept positive."""
    design, beta = np.c_[x, np.ones(len(x))], np.array([1.0, 0.0])
    pull = np.diag([0.1, 0.01])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        gain = design.T @ (labels - p) - pull @ (beta - [1.0, 0.0])
        beta = beta + np.clip(np.linalg.solve((design * (p * (1 - p) + 1e-9)[:, None]).T @ design + pull, gain), -1, 1)
    return {"slope": float(max(beta[0], 0.05)), "shift": float(beta[1])}


def _expected(evidence: np.ndarray, couple: float, mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of padded chains and the expected product of neighbouring labels (as -1 and 1)."""
    odds = np.where(mask > 0, np.exp(np.clip(evidence, -30, 30)), 1.0)
    grow, shrink = np.exp(couple), np.exp(-couple)
    n, width = odds.shape
    forward, backward = np.empty((width, n)), np.ones((width, n))
    message = np.ones(n)
    for t in range(width):
        forward[t] = message * odds[:, t]
        message = (forward[t] * grow + shrink) / (forward[t] * shrink + grow)
    for t in range(width - 1, 0, -1):
        here = np.where(mask[:, t] > 0, backward[t] * odds[:, t], 1.0)
        backward[t - 1] = np.where(mask[:, t] > 0, (here * grow + shrink) / (here * shrink + grow), 1.0)
    both = forward * backward
    a, b = forward[:-1], backward[1:] * odds.T[1:]
    same, other = (a * b + 1) * grow, (a + b) * shrink
    return (both / (1 + both)).T, ((same - other) / (same + other)).T


def _sample_bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        labels = batch.column(0).to_pylist()
        found = [line_bins(x) for x in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels, pa.int32()), pa.array([b.tobytes() for b, _ in found], pa.binary()), pa.array([n.tobytes() for _, n in found], pa.binary())],
            names=["label", "bins", "lengths"],
        )


def train(docs: DataFrame, labels: DataFrame, sample: int = 4000, max_chars: int = 200_000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Model:
    """Fit on a bounded sample of labelled documents.

    About ``sample`` labelled ids are taken by hash, evenly over the labels; of their texts those longer
    than ``max_chars`` are left out of the fit, and only line bins reach the driver. Null labels and ids
    are not used; an id with several labels counts as its least. Raises ValueError if nothing is left.
    """
    small_batches(docs.sparkSession)
    known = labels.where(F.col(label_col).isin(0, 1) & F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    n = known.count()
    if not n:
        raise ValueError("no labelled documents to learn quality from")
    span = 1 << 30
    taken = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(span)) < min(span, int(span * sample / n) + 1)).groupBy("doc_id").agg(F.min("label").alias("label"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    # the sample's size is a parameter, so the ids' side is bounded
    joined = texts.join(F.broadcast(taken), "doc_id").where(F.length(F.coalesce("text", F.lit(""))) <= max_chars).select("label", "text")
    rows = sorted((r["label"], bytes(r["bins"]), bytes(r["lengths"])) for r in joined.mapInArrow(_sample_bins, "label int, bins binary, lengths binary").toLocalIterator())
    if not rows:
        raise ValueError("no labelled documents to learn quality from")
    bins = [np.frombuffer(b, np.uint8).reshape(-1, len(EDGES)) for _, b, _ in rows]
    return fit(bins, [np.frombuffer(n, np.int64) for _, _, n in rows], np.array([x for x, _, _ in rows]))


def assess(text: Column, model: Model) -> Column:
    """The score of a text column."""

    @F.pandas_udf(T.DoubleType())
    def run(texts: pd.Series) -> pd.Series:
        found = [score(model, x if isinstance(x, str) else None) for x in texts]
        release()
        return pd.Series(found, dtype=float)

    return run(text)


def accepted(docs: DataFrame, model: Model, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows whose texts score at least ``threshold``, with all their columns.

    Null and empty texts are scored as one empty line. Repeated rows are kept or dropped alike, an empty table
    gives no rows, and columns of any other name are carried along.
    """
    return where_text(docs, lambda texts: [score(model, x) >= threshold for x in texts], text_col)


def score_documents(docs: DataFrame, model: Model, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, score, predicted`` for every row; ``predicted`` is 1 from ``threshold`` on.

    Null and empty texts are one empty line and get a score too. Repeated rows come back repeated, an
    empty table gives no rows, and other columns are not looked at.
    """
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    scored = docs.select(F.col(id_col), assess(F.col(text_col), model).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
