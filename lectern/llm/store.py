"""A bounded store of encoded text chunks, shared by the tokenizer-backed operators."""

from __future__ import annotations

import gc
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


class _Generation:
    """Codes and the ids behind them in one growing array."""

    def __init__(self) -> None:
        self.codes: dict[str, int] = {}
        self.flat, self.used = np.empty(1 << 18, np.uint32), 0
        self.starts, self.counts = np.empty(1 << 16, np.int64), np.empty(1 << 16, np.int64)
        self.filled = 0

    def append(self, ids: np.ndarray, counts: np.ndarray) -> None:
        n, used = self.filled + len(counts), self.used + len(ids)
        while n > len(self.starts):
            self.starts, self.counts = (np.concatenate([x, np.empty_like(x)]) for x in (self.starts, self.counts))
        while used > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        self.flat[self.used : used] = ids
        self.counts[self.filled : n] = counts
        self.starts[self.filled : n] = self.used + np.cumsum(counts) - counts
        self.filled, self.used = n, used

    def gather(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some codes in order, and how many each has."""
        counts = self.counts[codes]
        ends = np.cumsum(counts)
        total = int(ends[-1]) if len(ends) else 0
        return self.flat[np.repeat(self.starts[codes] - (ends - counts), counts) + np.arange(total)], counts


def expand(flat: np.ndarray, counts: np.ndarray, wanted: np.ndarray, starts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The ids of some entries in order, and how many each has, from all entries' ids end to end."""
    starts = np.cumsum(counts) - counts if starts is None else starts
    sizes = counts[wanted]
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    place = np.repeat(starts[wanted] - (ends - sizes), sizes)
    place += np.arange(total)
    return flat[place], sizes


class ChunkStore:
    """Keeps the token ids of distinct chunks.

    ``encode`` gives unseen chunks' ids end to end and how many each has. Two generations are kept: when
    the younger one passes ``keep`` chunks or ``keep_ids`` ids, the older is dropped. That bounds memory,
    keeps what is in use, and changes no result.
    """

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], keep: int = 250_000, keep_ids: int = 4_000_000) -> None:
        self.encode, self.keep, self.keep_ids = encode, keep, keep_ids
        self.young, self.old = _Generation(), _Generation()

    def ids(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks end to end, and how many each has.

        Unseen chunks get the next codes of the young generation, then those only the old one knows.
        """
        if len(self.young.codes) > self.keep or self.young.used > self.keep_ids:
            self.young, self.old = _Generation(), self.young
        young, old = self.young.codes, self.old.codes
        new = [c for c in chunks if c not in young]
        fresh, again = [c for c in new if c not in old], [c for c in new if c in old]
        young.update(zip(chain(fresh, again), range(len(young), len(young) + len(new)), strict=True))
        if fresh:
            self.young.append(*self.encode(fresh))
        if again:
            self.young.append(*self.old.gather(np.fromiter(map(old.__getitem__, again), np.int64, len(again))))
        return self.young.gather(np.fromiter(map(young.__getitem__, chunks), np.int64, len(chunks)))

    def texts(self, texts: pa.ListArray) -> Iterator[np.ndarray]:
        """The ids of each text, a list of chunks, as its chunks' ids in order."""
        chunks = texts.flatten().dictionary_encode()
        yield from per_text(texts, chunks.indices, *self.ids(chunks.dictionary.to_pylist()))


def per_text(texts: pa.ListArray, indices: pa.Array, flat: np.ndarray, counts: np.ndarray, block: int = 150_000) -> Iterator[np.ndarray]:
    """Each text's ids, from its chunks' numbers and all distinct chunks' ids end to end.

    About ``block`` chunks are expanded at a time, which bounds the arrays in between.
    """
    ends = np.cumsum(pc.list_value_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    numbers, starts = indices.to_numpy(zero_copy_only=False), np.cumsum(counts) - counts
    row = at = 0
    while row < len(texts):
        last = max(row + 1, int(np.searchsorted(ends, at + block, "right")))
        ids, sizes = expand(flat, counts, numbers[at : ends[last - 1]], starts)
        yield from np.split(ids, np.r_[0, np.cumsum(sizes)][ends[row:last] - at][:-1])
        row, at = last, int(ends[last - 1])


@contextmanager
def no_collector() -> Iterator[None]:
    """Keep the cycle collector from walking the stores again and again; encoding makes no cycles."""
    was = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if was:
            gc.enable()


def runs(texts: pa.StringArray, size: int = 8_000_000) -> Iterator[pa.StringArray]:
    """Slices of a text column of about ``size`` bytes each, without nulls."""
    texts = pc.fill_null(texts, "")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + size, "right")))
        yield texts.slice(at, end - at)
        at = end


def gathered(batches: Iterator[pa.RecordBatch], size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """Batches put together until they hold about ``size`` bytes: distinct chunks are then fewer."""
    held, held_bytes = [], 0
    for batch in batches:
        held.append(batch)
        held_bytes += batch.nbytes
        if held_bytes >= size:
            yield pa.concat_batches(held)
            held, held_bytes = [], 0
    if held:
        yield pa.concat_batches(held)
