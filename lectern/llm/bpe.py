"""Byte-level BPE with a hierarchical-bitmap rank queue.

The pre-tokens to encode are linked lists of byte spans, laid end to end. Every merge rank has a bucket
of list positions, and a hierarchy of bitmaps marks the ranks whose buckets hold anything: finding the
next rank is one find-first-set per level. A merge changes the pairs of its neighbours; their old queue
entries are not searched for but skipped as stale when they come up. n bytes so cost O(n log n) list
steps, whether they are one pre-token of millions of bytes or many short ones.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import release, require, spread
from lectern.llm.store import ChunkStore, gathered, no_collector, runs


#: Bytes from which the linked lists are arrays.
_MANY = 1 << 20


class RankQueue:
    """Buckets of positions by small integer rank, under bitmaps that find the lowest rank in use."""

    def __init__(self, ranks: int) -> None:
        self.levels: list[list[int]] = []
        while not self.levels or len(self.levels[-1]) > 1:
            ranks = (ranks + 63) // 64
            self.levels.append([0] * max(1, ranks))
        self.buckets: dict[int, list[int] | array] = {}

    def push(self, rank: int, positions: list[int] | array) -> None:
        bucket = self.buckets.get(rank)
        if bucket is not None:
            bucket.extend(positions)
            return
        self.buckets[rank] = positions
        for level in self.levels:
            word = rank >> 6
            was = level[word]
            level[word] = was | 1 << (rank & 63)
            if was:
                break
            rank = word

    def pop(self) -> tuple[int, list[int]] | None:
        """The lowest rank and its bucket, leftmost position first; None when nothing is left."""
        rank = 0
        for level in reversed(self.levels):
            bits = level[rank]
            if not bits:
                return None
            rank = rank << 6 | ((bits & -bits).bit_length() - 1)
        at = rank
        for level in self.levels:
            level[at >> 6] &= ~(1 << (at & 63))
            if level[at >> 6]:
                break
            at >>= 6
        return rank, sorted(self.buckets.pop(rank))


class ByteBPE:
    """Encoder and decoder for a table of byte strings by rank, as in a ``.tiktoken`` file."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        import regex

        import public_tokenizers

        self.ranks, self.pattern = ranks, regex.compile(pattern)
        #: Only this pattern is known to keep to the chunks of :meth:`encode_all`.
        self.chunked = pattern == public_tokenizers.PATTERN
        self.bytes_of = {v: k for k, v in ranks.items()}
        self.queue = RankQueue(max(ranks.values(), default=0) + 1)
        self.pairs = np.full(1 << 16, -1, np.int64)
        for token, rank in ranks.items():
            if len(token) == 2:
                self.pairs[token[0] << 8 | token[1]] = rank
        self.known: dict[str, list[int]] = {}
        self.before: dict[str, list[int]] = {}
        self.store = ChunkStore(self._chunks, keep=400_000, keep_ids=6_000_000)

    @classmethod
    def load(cls, path: str, pattern: str) -> ByteBPE:
        with open(path, "rb") as lines:
            return cls({base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}, pattern)

    def merge_all(self, pieces: list[bytes]) -> list[list[int]]:
        """The ids of each pre-token; all go through one queue, in which they don't meet."""
        ranks = self.ranks
        text = b"".join(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        n = len(text)
        limit = np.repeat(ends, sizes)
        codes = np.frombuffer(text, np.uint8).astype(np.int64)
        first = np.full(n, -1, np.int64)
        if n > 1:
            first[:-1] = np.where(np.arange(1, n) < limit[:-1], self.pairs[codes[:-1] << 8 | codes[1:]], -1)
        order = np.argsort(first, kind="stable")
        order = order[np.searchsorted(first[order], 0) :]
        # lists are faster, arrays a fifth as large
        kept = np.ndarray.tolist if n < _MANY else lambda x: array("q", x.tobytes())
        queue = self.queue
        cuts = np.flatnonzero(np.diff(first[order], prepend=-1))
        for rank, part in zip(first[order[cuts]].tolist(), np.split(order, cuts[1:]) if len(cuts) else [], strict=True):
            queue.push(rank, kept(part))
        pair, limit, after, before = kept(first), kept(limit), kept(np.arange(1, n + 1)), kept(np.arange(-1, n - 1))
        while (top := queue.pop()) is not None:
            rank, bucket = top
            for k, i in enumerate(bucket):
                if pair[i] != rank:
                    continue
                gone = after[i]
                end = after[i] = after[gone]
                stop, pair[gone], least = limit[i], -1, rank
                if end < stop:
                    before[end] = i
                    pair[i] = found = ranks.get(text[i : after[end]], -1)
                    if found >= 0:
                        queue.push(found, [i])
                        least = found
                else:
                    pair[i] = -1
                left = before[i]
                if left >= 0 and limit[left] == stop:
                    pair[left] = found = ranks.get(text[left:end], -1)
                    if found >= 0:
                        queue.push(found, [left])
                        least = min(least, found)
                if least < rank:
                    # a lower rank came up: what is left of this bucket waits for it
                    if k + 1 < len(bucket):
                        queue.push(rank, bucket[k + 1 :])
                    break
        out, i = [], 0
        for end in ends.tolist():
            ids = []
            while i < end:
                ids.append(ranks[text[i : after[i]]])
                i = after[i]
            out.append(ids)
        return out

    def _learn(self, pieces: list[str]) -> None:
        """Encode new pre-tokens, those that are tokens themselves at once."""
        raw = [(x, x.encode("utf-8", "replace")) for x in pieces]
        self.known.update((x, [self.ranks[b]]) for x, b in raw if b in self.ranks)
        rest = [(x, b) for x, b in raw if b not in self.ranks]
        self.known.update(zip((x for x, _ in rest), self.merge_all([b for _, b in rest]), strict=True))

    def _chunks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.known) > 400_000:
            self.known, self.before = {}, self.known
        known, before, find = self.known, self.before, self.pattern.findall
        split = [find(c) for c in chunks]
        fresh = {p for pieces in split for p in pieces if p not in known}
        known.update((p, before[p]) for p in fresh if p in before)
        self._learn([p for p in fresh if p not in before])
        ids = [[x for p in pieces for x in known[p]] for pieces in split]
        for p in fresh:
            if len(p) > 64:
                del known[p]
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        return np.fromiter(chain.from_iterable(ids), np.uint32, int(counts.sum())), counts

    def encode_all(self, texts: pa.StringArray) -> Iterator[np.ndarray]:
        """The ids of each text, in order; null counts as empty.

        A text is cut into chunks that no pre-token crosses, beside single spaces and line ends; one with
        adjacent white space or a NUL is cut into its pre-tokens, and so are all with another pattern.
        """
        for part in runs(texts):
            odd = pc.match_substring_regex(part, _ODD if self.chunked else "")
            whole = part.filter(odd)
            plain = pc.replace_substring(pc.replace_substring(part.filter(pc.invert(odd)), " ", "\0 "), "\n", "\0\n\0")
            even = iter(self.store.texts(pc.split_pattern(plain, "\0")))
            rest = iter(self.store.texts(pa.array([self.pattern.findall(x) for x in whole.to_pylist()], pa.list_(pa.string()))))
            yield from (next(rest) if x else next(even) for x in odd.to_pylist())

    def encode(self, text: str) -> list[int]:
        return next(self.encode_all(pa.array([text]))).tolist()

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes that some ids stand for."""
        return b"".join(map(self.bytes_of.__getitem__, ids.tolist()))


#: Two characters of white space (ASCII's separators counted in), or a NUL.
_BLANK = r"[\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ODD = rf"{_BLANK}{_BLANK}|\x00"
_LOADED: dict[tuple[str, str], ByteBPE] = {}


def loaded(path: str, pattern: str) -> ByteBPE:
    """The encoder of a rank file, read once per worker process."""
    if (path, pattern) not in _LOADED:
        _LOADED[path, pattern] = ByteBPE.load(path, pattern)
    return _LOADED[path, pattern]


IDS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("ids", T.BinaryType(), False), T.StructField("decoded", T.BinaryType(), False)])


def _slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    require(docs, id_col, text_col)
    return spread(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))


def encode_documents(docs: DataFrame, ranks: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, ids`` (little-endian unsigned 32-bit) and ``decoded`` (UTF-8 bytes the ids stand for).

    ``ranks`` is a rank file's path, the same on every executor; ``pattern`` splits pre-tokens. Null and
    empty texts have no ids. Repeated rows come back repeated; other columns are not looked at.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = loaded(ranks, pattern)
        for batch in gathered(batches):
            docs = iter(batch.column(0).to_pylist())
            for part in runs(batch.column(1)):
                with no_collector():
                    ids = list(coder.encode_all(part))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([next(docs) for _ in ids], pa.int64()), pa.array([x.astype("<u4", copy=False).tobytes() for x in ids], pa.binary()), pa.array([coder.decode(x) for x in ids], pa.binary())],
                    names=["doc_id", "ids", "decoded"],
                )
                del part, ids
            del batch
            release()

    return _slim(docs, id_col, text_col).mapInArrow(run, IDS)
