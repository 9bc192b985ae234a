"""Packing documents into fixed-length training sequences by cutting-stock column generation.

Documents are tokenised where they lie and cut only where they exceed the sequence length, so the
shuffled rows are slim pieces, never texts or ids. A histogram of piece lengths (at most one row per
size class, of which there are 320) reaches the driver. There a linear program over cutting patterns is solved by column
generation: the restricted master gives a price per length class, a knapsack dynamic program finds the
pattern of highest price, and the loop ends when no pattern is worth more than one sequence. Pattern
counts are rounded down, what remains is packed greedily, and pieces ranked within their class are
dealt to the slots of the patterns.
"""

from __future__ import annotations

import math
import os
import unicodedata
import zlib
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import cut, lookup, release, require, spread
from lectern.llm.store import ChunkStore, expand, gathered, no_collector, per_text, runs

SEQUENCE_TOKENS, CLASS_TOKENS, END_ID = 4096, 16, 2
#: Pieces that one task ranks together, about.
RANK_ROWS = 20_000
PIECES = T.StructType(
    [T.StructField("doc_id", T.LongType())]
    + [T.StructField(n, T.LongType(), False) for n in ("start", "length", "ids_crc32", "doc_tokens")]
)


class WordEncoder:
    """Encodes texts with a word-level tokenizer by their white-space separated chunks.

    The tokenizer drops white space and never joins across it, so a text's ids are its chunks' ids in
    order. Only a batch's distinct chunks are looked at; a chunk is a root, or a root and one point after
    a letter, which is always a token of its own, and only unseen roots are tokenised.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        # roots of letters only need neither normalizer nor pattern: the model alone takes them
        self.model = Tokenizer(self.tokenizer.model)
        self.model.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.is_end = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.is_end[[i for x, i in self.tokenizer.get_vocab().items() if x.endswith("</w>")]] = True
        self.store = ChunkStore(self._encode_all)
        self.point_ids = np.array([self.tokenizer.encode(x, add_special_tokens=False).ids[0] for x in _POINTS], np.uint32)

    def _encode_all(self, roots: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and their numbers; some thousands at a time, as the tokenizer's results are large."""
        found = [self._encode(roots[at : at + 5000]) for at in range(0, len(roots), 5000)]
        return np.concatenate([ids for ids, _ in found]), np.concatenate([counts for _, counts in found])

    def _encode(self, roots: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = np.fromiter((x.isalpha() for x in roots), bool, len(roots))
        text = " ".join([x for x in roots if x.isalpha()])
        if not unicodedata.is_normalized("NFC", text) or "\u03a3" in text or "\u0130" in text:
            plain[:] = False
        flat, counts = [], np.zeros(len(roots), np.int64)
        if plain.any():
            ids = np.array(self.model.encode_batch_fast([_byte_level(text.lower())], add_special_tokens=False)[0].ids, np.uint32)
            counts[plain] = np.diff(np.flatnonzero(self.is_end[ids]), prepend=-1)
            flat.append(ids)
        if not plain.all():
            found = [x.ids for x in self.tokenizer.encode_batch_fast([x for x, p in zip(roots, plain.tolist(), strict=True) if not p], add_special_tokens=False)]
            counts[~plain] = np.fromiter(map(len, found), np.int64, len(found))
            flat.append(np.fromiter(chain.from_iterable(found), np.uint32))
        order = np.empty(len(roots), np.int64)
        order[np.r_[np.flatnonzero(plain), np.flatnonzero(~plain)]] = np.arange(len(roots))
        return expand(np.concatenate(flat), np.r_[counts[plain], counts[~plain]], order)

    def _chunk_ids(self, chunks: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids end to end, and their numbers, of distinct chunks."""
        low = pc.if_else(pc.string_is_ascii(chunks), pc.ascii_lower(chunks), chunks)
        parts = pc.extract_regex(low, rf"^(?P<root>(?s:.*)[a-zß-öø-ÿ])(?P<point>[{_POINTS}])$")
        roots = pc.coalesce(pc.struct_field(parts, "root"), low).dictionary_encode()
        flat, counts = expand(*self.store.ids(roots.dictionary.to_pylist()), roots.indices.to_numpy(zero_copy_only=False))
        point = pc.fill_null(pc.index_in(pc.struct_field(parts, "point"), pa.array(list(_POINTS))), -1).to_numpy(zero_copy_only=False)
        both = counts + (point >= 0)
        out = np.empty(int(both.sum()), np.uint32)
        last = np.zeros(len(out), bool)
        last[np.cumsum(both)[point >= 0] - 1] = True
        out[last], out[~last] = self.point_ids[point[point >= 0]], flat
        return out, both

    def encode_all(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null counts as empty."""
        for part in runs(texts):
            split = pc.ascii_split_whitespace(part)
            chunks = split.flatten().dictionary_encode()
            yield from per_text(split, chunks.indices, *self._chunk_ids(chunks.dictionary))


def _byte_level(text: str) -> str:
    """UTF-8 bytes as the letters that byte-level vocabularies write them with; blanks stay."""
    return text if text.isascii() else text.encode("utf-8").decode("latin-1").translate(_SHIFTED)


_POINTS = ".,;:!?"
#: Bytes above ASCII that byte-level vocabularies don't write as the Latin-1 letter of the same number.
_SHIFTED = {b: 0x100 + 34 + k for k, b in enumerate(range(0x80, 0xA1))} | {0xAD: 0x143}
_ENCODERS: dict[str, WordEncoder] = {}


def loaded(path: str) -> WordEncoder:
    """The encoder of a tokenizer file, read once per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _cut_documents(path: str, capacity: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = loaded(path)
        for batch in gathered(batches):
            rows = []
            with no_collector():
                coded = list(encoder.encode_all(batch.column(1)))
            for doc, ids in zip(batch.column(0).to_pylist(), coded, strict=True):
                ids = np.append(ids, np.uint32(END_ID)).astype("<u4", copy=False)
                for start in range(0, len(ids), capacity):
                    piece = ids[start : start + capacity]
                    rows.append((doc, start, len(piece), zlib.crc32(piece.tobytes()), len(ids)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=PIECES.names)
            del batch, coded, rows
            release()

    return run


class Pattern(NamedTuple):
    """``counts`` pieces of each class, used by ``times`` sequences."""

    counts: dict[int, int]
    times: int


def _best_pattern(prices: np.ndarray, weights: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The knapsack of highest price, by dynamic programming over the capacity."""
    best, taken = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    fitting = np.searchsorted(weights, np.arange(capacity + 1), "right").tolist()
    for room in range(int(weights[0]), capacity + 1):
        fits = fitting[room]
        worth = best[room - weights[:fits]] + prices[:fits]
        i = int(worth.argmax())
        if worth[i] > best[room - 1]:
            best[room], taken[room] = worth[i], i
        else:
            best[room] = best[room - 1]
    counts, room = np.zeros(len(weights)), capacity
    while room > 0:
        i = int(taken[room])
        counts[i] += i >= 0
        room -= int(weights[i]) if i >= 0 else 1
    return float(best[capacity]), counts


def solve_patterns(demand: dict[int, int], capacity: int, max_columns: int = 4000, gap: float = 1e-3) -> list[Pattern]:
    """Patterns over lengths ``1..capacity`` that cut exactly ``demand`` pieces of each.

    Column generation with a dense basis inverse: one row per length, so at most ``capacity`` rows. It ends
    where at most half a sequence or a share of ``gap`` is left to gain, or after ``max_columns`` columns,
    which bounds the time and the padding saved, not what is packed.
    """
    classes = sorted(k for k, n in demand.items() if n > 0)
    if not classes:
        return []
    weights, need = np.array(classes), np.array([demand[k] for k in classes], float)
    m = len(classes)
    basis, costs = np.diag((capacity // weights).astype(float)), np.ones(m)
    inverse = np.diag(1 / np.diag(basis))
    amount, filled = inverse @ need, float(weights @ need) / capacity
    for step in range(1, max_columns + 1):
        prices = costs @ inverse
        if prices.min() < -1e-9:
            # a pattern may hold more pieces of a length than there are: what is too much costs nothing
            column, cost = -np.eye(m)[int(prices.argmin())], 0.0
        else:
            worth, column = _best_pattern(np.maximum(prices, 0), weights, capacity)
            cost, total = 1.0, costs @ amount
            # no solution is below total / worth or what the pieces fill
            if worth <= 1 + 1e-7 or total - max(total / worth, filled) < max(0.5, gap * total):
                break
        change = inverse @ column
        rows = np.flatnonzero(change > 1e-9)
        if not len(rows):
            break
        out = rows[int(np.argmin(amount[rows] / change[rows]))]
        basis[:, out], costs[out] = column, cost
        inverse[out] /= change[out]
        change[out] = 0
        inverse -= np.outer(change, inverse[out])
        if step % 64 == 0:
            # a Newton step takes rounding errors away (numpy's own inversion can lock up after a fork)
            inverse = 2 * inverse - inverse @ (basis @ inverse)
        amount = np.maximum(inverse @ need, 0)
    patterns, left = [], need.astype(np.int64)
    for i in np.argsort(-amount * costs, kind="stable"):
        times = int(amount[i] * costs[i] + 1e-6)
        while times and (column := np.minimum(np.rint(basis[:, i]).astype(np.int64), left)).any():
            used = np.flatnonzero(column)
            same = min(times, int((left[used] // column[used]).min()))
            patterns.append(Pattern({classes[k]: int(column[k]) for k in used}, same))
            left -= column * same
            times -= same
    while left.any():
        room, counts = capacity, {}
        for k in range(m - 1, -1, -1):
            if n := min(int(left[k]), room // classes[k]):
                counts[k], room = n, room - n * classes[k]
        times = int(min(left[k] // n for k, n in counts.items()))
        patterns.append(Pattern({classes[k]: n for k, n in counts.items()}, times))
        for k, n in counts.items():
            left[k] -= n * times
    return patterns


def _slots(patterns: list[Pattern]) -> list[tuple[int, int, int, int, int]]:
    """Class, first rank, rank after the last, number of sequences and first sequence of every slot."""
    slots, reached, sequence = [], {}, 0
    for pattern in patterns:
        for k, n in sorted(pattern.counts.items()):
            low = reached.get(k, 0)
            reached[k] = high = low + n * pattern.times
            slots.append((k, low, high, pattern.times, sequence))
        sequence += pattern.times
    return slots


def class_size(length: Column, capacity: int) -> Column:
    """The size that a piece is planned with: its length up to 32 tokens, above that rounded up by 3 % at most."""
    size = lambda width: F.floor((length + (width - 1)) / width) * width
    out = size(CLASS_TOKENS)
    for width in (8, 4, 2, 1):
        out = F.when(length <= 32 * width, size(width)).otherwise(out)
    return F.least(out, F.lit(capacity)).cast("int")


def joined_classes(demand: dict[int, int], share: float = 0.002) -> dict[int, int]:
    """The size to plan each size with: sizes of the same 16 tokens as one where that pads little.

    Steps of 16 are joined, those that pad least first, while all padding together stays within ``share`` of
    the tokens. The program then has fewer rows, and where all steps are joined, a 16th of the capacity.
    """
    top = lambda k: -(-k // CLASS_TOKENS) * CLASS_TOKENS
    lost: dict[int, int] = {}
    for k, n in demand.items():
        lost[top(k)] = lost.get(top(k), 0) + (top(k) - k) * n
    room, joined = share * sum(k * n for k, n in demand.items()), set()
    for step, padding in sorted(lost.items(), key=lambda x: x[::-1]):
        if padding <= room:
            room -= padding
            joined.add(step)
    return {k: top(k) if top(k) in joined else k for k in demand}


def pack_pieces(pieces: DataFrame, capacity: int = SEQUENCE_TOKENS, rank_rows: int = RANK_ROWS) -> DataFrame:
    """Add ``sequence_id``, ``offset``, ``sequence_tokens`` and ``padded_tokens`` to rows with ``doc_id, start, length``.

    ``pieces`` is read several times and should be materialised. Lengths are 1 to ``capacity``. A
    sequence is padded to ``capacity`` except where its tokens are a power of two. Equal rows, rows of one
    id and rows without an id are dealt to different slots like any others; an empty table gives no rows.
    """
    spark: SparkSession = pieces.sparkSession
    # rows of a class are dealt to buckets by number, so neither ids nor repeated rows pile up in one
    classed = pieces.withColumn("class", class_size(F.col("length"), capacity)).withColumn("row", F.monotonically_increasing_id())
    fine = {r["class"]: r["count"] for r in classed.groupBy("class").count().collect()}
    joined, demand = {k: min(v, capacity) for k, v in joined_classes(fine).items()}, {}
    for k, n in fine.items():
        demand[joined[k]] = demand.get(joined[k], 0) + n
    classed = classed.withColumn("class", lookup([joined.get(k, k) for k in range(capacity + 1)], F.col("class")).cast("int"))
    unit = math.gcd(capacity, *demand)
    patterns = [Pattern({k * unit: n for k, n in p.counts.items()}, p.times) for p in solve_patterns({k // unit: n for k, n in demand.items()}, capacity // unit)]
    slots = spark.createDataFrame(_slots(patterns), "class int, low long, high long, times long, first long")
    spans = [max(1, -(-demand.get(k, 0) // rank_rows)) for k in range(capacity + 1)]
    bucketed = classed.withColumn("bucket", F.pmod(F.xxhash64("row"), lookup(spans, F.col("class"))))
    before = Window.partitionBy("class").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = bucketed.groupBy("class", "bucket").count().select("class", "bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("class", "bucket").orderBy(F.desc("length"), "doc_id", "start", "row")
    ranked = bucketed.withColumn("rank", F.row_number().over(within) - 1).join(bases, ["class", "bucket"]).withColumn("rank", F.col("rank") + F.col("base"))
    # the slots are bounded by classes times pieces in a pattern, whatever the number of documents
    dealt = ranked.join(F.broadcast(slots.withColumnRenamed("class", "slot_class")), F.expr("class = slot_class and rank >= low and rank < high"))
    dealt = dealt.withColumn("sequence_id", F.expr("first + (rank - low) % times"))
    order = Window.partitionBy("sequence_id").orderBy(F.desc("class"), "rank")
    filled = F.sum("length").over(Window.partitionBy("sequence_id"))
    offset = F.coalesce(F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return dealt.select(
        *pieces.columns, "sequence_id", offset.alias("offset"), filled.alias("sequence_tokens"),
        F.when(F.expr("bit_count(sum(length) over (partition by sequence_id)) = 1"), filled).otherwise(F.lit(capacity).cast("long")).alias("padded_tokens"),
    )


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of at most ``capacity`` tokens: ``doc_id, start, length, ids_crc32, doc_tokens``."""
    require(docs, id_col, text_col)
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return spread(slim).mapInArrow(_cut_documents(tokenizer, capacity), PIECES)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = SEQUENCE_TOKENS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pack all documents: one row per piece with its place in a sequence.

    ``tokenizer`` is the path of a word-level tokenizer file, the same on every executor. A document is
    its ids and an end id; null and empty texts are the end id alone. Very long documents are cut into
    full sequences and a rest. Repeated rows are packed once each. Other columns are not looked at.
    """
    return pack_pieces(cut(tokenize_pieces(docs, tokenizer, capacity, id_col, text_col)), capacity)
