"""SimHash near-duplicate components found through Golay-code keys.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ
in at most two bits have, by pigeonhole, one segment without errors that is followed (cyclically) by
a segment with at most one error. The (23,12) Golay code is perfect with radius three, so a segment
decodes to one codeword; the words one flip away decode to at most six. A fingerprint is *indexed*
under (exact segment, codeword of the next segment) and *probes* under every codeword its next
segment reaches with one flip, so linked fingerprints always meet under some key. Candidates that
meet are verified by counting the differing bits.

Rows under one key are distinct fingerprints, so exact copies never pile up. A group is compared directly
and gives a spanning forest of links; the members of a group that is too large for one task meet again
under the values one bit away from them, in groups of at most 65.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import cut, keyed_groups, release, require, small_batches
from lectern.llm.components import Forest, connected_components

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 2
SEGMENTS = ((0, 22), (22, 21), (43, 21))
_GENERATOR = 0b101011100011  # x^11 + x^9 + x^7 + x^6 + x^5 + x + 1
#: Rows of a key that one task compares directly.
GROUP_ROWS = 4096


def _remainders(words: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit words modulo the generator polynomial."""
    rest = words.astype(np.int64).copy()
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (_GENERATOR << (bit - 11)), rest)
    return rest


def _error_table() -> np.ndarray:
    errors = [0] + [sum(1 << b for b in c) for n in (1, 2, 3) for c in combinations(range(23), n)]
    errors = np.array(errors, np.int64)
    table = np.empty(2048, np.int64)
    table[_remainders(errors)] = errors
    return table


_ERRORS = _error_table()
_LOW, _HIGH = _remainders(np.arange(4096)), _remainders(np.arange(2048) << 12)


def golay_codeword(words: np.ndarray) -> np.ndarray:
    """The codeword nearest to each 23-bit word; its highest 12 bits are its message."""
    words = words.astype(np.int64)
    return words ^ _ERRORS[_LOW[words & 4095] ^ _HIGH[words >> 12]]


def golay_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit message of the codeword nearest to each 23-bit word."""
    return golay_codeword(words) >> 11


def fingerprint(text: str | None) -> int:
    """The unsigned 64-bit SimHash of a text: a bit is 1 if set in over half the shingle hashes."""
    words = (text or "").encode("utf-8", "replace").translate(_FOLD).split()
    if not words:
        return 0
    if len(words) < SHINGLE_WORDS:
        return xxhash.xxh64_intdigest(b" ".join(words), SEED)
    counts, total = np.zeros(64, np.int64), len(words) - SHINGLE_WORDS + 1
    for at in range(0, total, 65_536):
        part = words[at : at + 65_536 + SHINGLE_WORDS - 1]
        digest = xxhash.xxh64_digest
        raw = b"".join([digest(b"%b %b %b" % x, SEED) for x in zip(part, part[1:], part[2:])])
        counts += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > total).tobytes(), "big")


_FOLD = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, fp`` of every row, the fingerprint as a signed long."""
    small_batches(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])
            release()

    return slim.mapInArrow(run, T.StructType([slim.schema["doc_id"], T.StructField("fp", T.LongType())]))


def _keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Key, fingerprint and whether the row is the index row, for unsigned fingerprints."""
    keys, owners, own = [], [], []
    for k, (at, width) in enumerate(SEGMENTS):
        next_at, next_width = SEGMENTS[(k + 1) % 3]
        exact = (prints >> np.uint64(at) & np.uint64((1 << width) - 1)).astype(np.int64)
        fuzzy = (prints >> np.uint64(next_at) & np.uint64((1 << next_width) - 1)).astype(np.int64)
        flips = np.array([0] + [1 << b for b in range(next_width)], np.int64)
        index = golay_index(fuzzy[:, None] ^ flips[None, :])
        first = index[:, :1]
        ordered = np.sort(index, axis=1)
        fresh = np.ones(ordered.shape, bool)
        fresh[:, 1:] = ordered[:, 1:] != ordered[:, :-1]
        row, column = np.nonzero(fresh)
        keys.append(np.int64(k) << 40 | exact[row] << 12 | ordered[row, column])
        owners.append(prints[row])
        own.append((ordered == first)[row, column])
    return np.concatenate(keys), np.concatenate(owners), np.concatenate(own)


def _probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(prints), 2048):
            key, owner, own = _keys(prints[at : at + 2048])
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(owner.view(np.int64)), pa.array(own)], names=["key", "fp", "own"])


def links(indexed: np.ndarray, probing: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of the pairs within two bits between the index rows and all rows of a key."""
    forest, found = Forest(), []
    for at in range(0, len(indexed), 512):
        i, j = np.nonzero(np.bitwise_count(indexed[at : at + 512, None] ^ probing[None, :]) <= MAX_BITS)
        found += [(a, b) for a, b in zip(indexed[at + i].tolist(), probing[j].tolist(), strict=True) if a != b and forest.union(a, b)]
    return found


def _pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    ends = np.array(pairs, np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(ends[:, 0]), pa.array(ends[:, 1])], names=["a", "b"])


def _meet(limit: int):  # noqa: ANN202
    """Rows sorted by key in; verified links of groups up to ``limit`` out, and the members of others without a partner."""

    def alone(fp: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(fp), pa.nulls(len(fp), pa.int64())], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for (key, fp, own), piece in keyed_groups(batches, limit):
            if piece:
                yield alone(fp)
                continue
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            ends = np.r_[starts[1:], len(key)]
            has, out = np.add.reduceat(own.astype(np.int64), starts), []
            for i in np.flatnonzero((ends - starts > 1) & (has > 0)):
                group, mine = fp[starts[i] : ends[i]], own[starts[i] : ends[i]].astype(bool)
                if len(group) > limit:
                    yield alone(group)
                else:
                    out += links(group[mine].view(np.uint64), group.view(np.uint64))
            if out:
                yield _pairs(out)

    return run


def _flipped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every fingerprint under itself and all 64 values one bit away."""
    flips = np.r_[np.uint64(0), np.uint64(1) << np.arange(64, dtype=np.uint64)]
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for at in range(0, len(prints), 2048):
            near = prints[at : at + 2048, None] ^ flips[None, :]
            owner = np.broadcast_to(prints[at : at + 2048, None], near.shape)
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().view(np.int64)), pa.array(owner.ravel().view(np.int64))], names=["key", "fp"])


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by key in: at most 65 distinct fingerprints under a key, each two bits or less from all others."""
    for (key, fp), _ in keyed_groups(batches, 1 << 16):
        same = np.flatnonzero(key[1:] == key[:-1])
        yield pa.RecordBatch.from_arrays([pa.array(fp[same]), pa.array(fp[same + 1])], names=["a", "b"])


def link_fingerprints(prints: DataFrame, group_rows: int = GROUP_ROWS) -> DataFrame:
    """Links ``(a, b)`` that connect all distinct ``fp`` values within two bits of each other.

    The members of a key with more than ``group_rows`` rows are not compared in one task. They meet
    again under the values one bit away from them: two fingerprints within two bits have such a value in
    common, and no value is one bit away from more than 64, so every group is small and none is lost.
    """
    keyed = prints.select("fp").mapInArrow(_probe, "key long, fp long, own boolean")
    met = cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_meet(group_rows), "a long, b long"))
    crowded = met.where("b is null").select("a").distinct().mapInArrow(_flipped, "key long, fp long")
    rest = crowded.repartition("key").sortWithinPartitions("key").mapInArrow(_chained, "a long, b long")
    return met.where("b is not null").unionByName(rest)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, ``fingerprint`` (16 hex digits) and ``component_id``.

    ``component_id`` is the smallest id among the documents reachable over links of at most two
    differing bits. Null and empty texts have fingerprint zero and are linked like any other.
    Repeated rows come back repeated; an id that occurs on several texts joins nothing by itself. A
    null id never names a component unless all its members have null ids. An empty table gives no
    rows. Other columns are not looked at.
    """
    require(docs, id_col, text_col)
    hashed = cut(fingerprints(docs, id_col, text_col))
    classes = cut(hashed.groupBy("fp").agg(F.min("doc_id").alias("least")))
    # materialised first, so that no task runs two Python functions at once
    groups = connected_components(cut(link_fingerprints(classes))).withColumnRenamed("node", "fp")
    labelled = classes.join(groups, "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    names = labelled.groupBy("component").agg(F.min("least").alias("component_id"))
    named = labelled.join(names, "component").select("fp", "component_id")
    return hashed.join(named, "fp").select(F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
