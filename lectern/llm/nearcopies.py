"""Near copies at a shingle similarity: wide SimHash, Golay-code keys, exact verification.

A text's fingerprint sums the bits of its distinct shingles' hashes, as SimHash does, but keeps 16 segments
of 23 bits with the margins by which each bit was decided. At a similarity of 0.8 some 15 % of all bits
differ, mostly those of small margin, so a segment is decoded to the Golay codewords that cost the least
margin: its bits and all patterns of its four weakest bits are decoded, and the three nearest codewords
found are its codes. Two neighbouring segments' codes make a key, nine a pair of segments. Errors are spread
over segments, so by the pigeonhole principle some pair of segments has few of them, and near copies
meet there; how often they do is a matter of measurement (see ``RECALL``), as with every SimHash.

Rows that meet are compared by 128 further bits with a wide margin, which gives loose components. Texts of a
loose component come together once and are compared by their whole shingle sets, so a link is a link at
exactly the similarity asked for.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import simhash
from lectern.llm.common import cut, keyed_groups, release, require, small_batches
from lectern.llm.components import Forest, connected_components
from lectern.llm.fingerprint import forget, mixed, shingle_hashes

SIMILARITY, SHINGLE_WORDS = 0.8, 5
SEGMENTS, SEGMENT_BITS, WEAK_BITS, CODES = 16, 23, 4, 3
#: Share of pairs at 0.80 to 0.82 that meet under a key: of 350 such pairs 349, of 1944 at 0.8 to 0.9 1939 (simulated edits).
RECALL = 0.994
WORDS = 8
CHECK_AT, CHECK_BITS, CHECK_MOST = SEGMENTS * SEGMENT_BITS, 128, 34
#: Rows of a key that are compared in memory; all rows of a larger group are loosely linked.
GROUP_ROWS = 4096
#: Shingles that are compared in memory; a larger component is compared block by block.
BLOCK_SHINGLES = 1_500_000
_SEEDS = (np.arange(1, WORDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[None, :]
_PATTERNS = np.array([[b >> i & 1 for i in range(WEAK_BITS)] for b in range(1 << WEAK_BITS)])
_KEYS = T.StructType([T.StructField(n, T.LongType()) for n in ("key", "label", "check_a", "check_b")])


def margins(hashes: np.ndarray) -> np.ndarray:
    """By how much each bit of the hashes' SimHash is set (above zero) or not."""
    total = np.zeros(64 * WORDS, np.int64)
    for at in range(0, len(hashes), 4096):
        bits = np.unpackbits(mixed(hashes[at : at + 4096, None] ^ _SEEDS).view(np.uint8), axis=1)
        total += bits.sum(axis=0, dtype=np.int32)
    return 2 * total - len(hashes)


def codes(margin: np.ndarray) -> np.ndarray:
    """The messages of the nearest codewords of every segment: texts × segments × ``CODES``."""
    parts = margin[:, :CHECK_AT].reshape(len(margin), SEGMENTS, SEGMENT_BITS)
    powers = 1 << np.arange(SEGMENT_BITS)
    hard, size = ((parts > 0) * powers).sum(axis=-1), np.abs(parts)
    weak = 1 << np.argpartition(size, WEAK_BITS, axis=-1)[..., :WEAK_BITS]
    words = simhash.golay_codeword(hard[..., None] ^ weak @ _PATTERNS.T)
    cost = ((words ^ hard[..., None])[..., None] >> np.arange(SEGMENT_BITS) & 1).astype(np.float32) @ size[..., None].astype(np.float32)
    cost, found = cost[..., 0], []
    for _ in range(CODES):
        best = np.take_along_axis(words, cost.argmin(axis=-1)[..., None], -1)
        found.append(best[..., 0] >> 11)
        cost = np.where(words == best, np.inf, cost)
    return np.stack(found, axis=-1)


def _fingerprinted(shingle: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, sizes, marks = [], [], []
            texts = batch.column(3).to_pylist()
            for at in range(0, len(texts), 128):
                margin = np.empty((len(texts[at : at + 128]), 64 * WORDS), np.int64)
                for k, text in enumerate(texts[at : at + 128]):
                    hashes = shingle_hashes(text, shingle)
                    digests.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                    sizes.append(len(hashes))
                    margin[k] = margins(hashes)
                check = np.packbits(margin[:, CHECK_AT : CHECK_AT + CHECK_BITS] > 0, axis=1)
                found = np.concatenate([check, codes(margin).astype("<u2").reshape(len(margin), -1).view(np.uint8)], axis=1)
                marks += [x.tobytes() for x in found]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(sizes, pa.int64()), pa.array(marks, pa.binary())],
                names=["doc_id", "key_a", "key_b", "set_a", "set_b", "n", "mark"],
            )
            del batch, texts, digests, marks
            release()
        forget()

    return run


def _keyed(pairs: range):  # noqa: ANN202
    """Every key that some pairs of segments give a class, with its label and the bits to compare."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                part = batch.slice(at, 2048)
                marks = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint8).reshape(part.num_rows, -1)
                check = np.ascontiguousarray(marks[:, : CHECK_BITS // 8]).view(np.int64)
                found = np.ascontiguousarray(marks[:, CHECK_BITS // 8 :]).view("<u2").reshape(part.num_rows, SEGMENTS // 2, 2, CODES)
                found = found[:, pairs.start : pairs.stop].astype(np.int64)
                keys = found[:, :, 0, :, None] << 12 | found[:, :, 1, None, :] | (np.array(pairs) << 24)[None, :, None, None]
                keys = keys.reshape(part.num_rows, -1)
                columns = (keys.ravel(), *(np.repeat(x, keys.shape[1]) for x in (part.column(0).to_numpy(), check[:, 0], check[:, 1])))
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in columns], names=_KEYS.names)

    return run


def _pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _loosely(limit: int):  # noqa: ANN202
    """Rows sorted by key in; links between labels of a key that may be similar out, and among all of a large group."""

    def near(i: np.ndarray, j: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.bitwise_count(x[i] ^ x[j]) + np.bitwise_count(y[i] ^ y[j]) <= CHECK_MOST

    def starred(label: np.ndarray, hub: int) -> pa.RecordBatch:
        label = np.unique(label)
        label = label[label != hub]
        return _pairs(label, np.full(len(label), hub))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub = None
        for (key, label, a, b), piece in keyed_groups(batches, limit):
            if piece:
                hub = hub if hub and hub[0] == key[0] else (key[0], label[0])
                yield starred(label, hub[1])
                continue
            # counted as unsigned numbers: of a negative one the absolute value's bits count
            a, b = a.view(np.uint64), b.view(np.uint64)
            starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            sizes = np.diff(np.r_[starts, len(key)])
            # small groups all at once: every row with the next one, the one after, ...
            small = np.repeat(sizes <= 8, sizes)
            for step in range(1, 8):
                i = np.arange(len(key) - step)
                i = i[(key[i] == key[i + step]) & small[i]]
                if not len(i):
                    break
                i = i[(label[i] != label[i + step]) & near(i, i + step, a, b)]
                yield _pairs(label[i], label[i + step])
            for start, size in zip(starts[sizes > 8].tolist(), sizes[sizes > 8].tolist(), strict=True):
                own = slice(start, start + size)
                names, x, y = label[own], a[own], b[own]
                if size > limit:
                    yield starred(names, names[0])
                    continue
                if (names == names[0]).all():
                    continue
                forest, found = Forest(), []
                for at in range(0, size, 128):
                    far = np.bitwise_count(x[at : at + 128, None] ^ x[None, :]) + np.bitwise_count(y[at : at + 128, None] ^ y[None, :])
                    i, j = np.nonzero((far <= CHECK_MOST) & (names[at : at + 128, None] < names[None, :]))
                    found += [pair for pair in zip(names[i + at].tolist(), names[j].tolist(), strict=True) if forest.union(*pair)]
                if found:
                    yield _pairs(*np.array(found).T)
        release()

    return run


def exact_links(sets: list[np.ndarray], similarity: float) -> list[tuple[int, int]]:
    """A spanning forest of the pairs whose Jaccard similarity reaches ``similarity``, as positions in ``sets``.

    Every member outside the first one's group is compared with all others over an inverted index, so no
    link is lost; inside that group no comparison is needed. Members with the commonest shingles come first,
    as the middle of a group of copies has them. Sets are not empty.
    """
    if not sets:
        return []
    sizes, forest, found = np.array([len(s) for s in sets]), Forest(), []
    place = np.unique(np.concatenate(sets), return_inverse=True)[1].astype(np.int32)
    owner = np.repeat(np.arange(len(sets), dtype=np.int32), sizes)[np.argsort(place, kind="stable")]
    common, ends = np.bincount(place), np.cumsum(sizes)
    bounds = np.r_[0, np.cumsum(common)]
    order = np.argsort(-np.add.reduceat(common[place], ends - sizes) / sizes, kind="stable").tolist()
    label, members = np.arange(len(sets)), {i: [i] for i in range(len(sets))}
    for i in order:
        if i != order[0] and label[i] == label[order[0]]:
            continue
        own = place[ends[i] - sizes[i] : ends[i]].tolist()
        shared = np.bincount(np.concatenate([owner[bounds[v] : bounds[v + 1]] for v in own]), minlength=len(sets))
        alike = shared >= similarity * (sizes + sizes[i] - shared) - 1e-9
        for j in np.flatnonzero(alike & (label != label[i])).tolist():
            if forest.union(i, j):
                found.append((i, j))
                gone, keep = sorted((label[i], label[j]), key=lambda x: len(members[x]))
                label[members[gone]] = keep
                members[keep] += members.pop(gone)
        if len(members) == 1:
            break
    return found


def _exactly(similarity: float):  # noqa: ANN202
    """Rows sorted by tile in; links of each tile out. A tile holds one block of a component, or two."""

    def links(rows: dict[int, np.ndarray]) -> pa.RecordBatch:
        found = np.array(exact_links(list(rows.values()), similarity), np.int64).reshape(-1, 2)
        nodes = np.array(list(rows), np.int64)
        return _pairs(nodes[found[:, 0]], nodes[found[:, 1]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tile, rows = None, {}
        for batch in batches:
            for *at, node, raw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if at != tile:
                    if len(rows) > 1:
                        yield links(rows)
                    tile, rows = at, {}
                rows[node] = np.frombuffer(raw, np.uint64)
        if len(rows) > 1:
            yield links(rows)
        rows.clear()
        release()

    return run


def _shingled(shingle: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(x, shingle).tobytes() for x in batch.column(4).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(sets, pa.binary())], names=["component", "i", "j", "node", "hashes"])
            release()
        forget()

    return run


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """``node, n, mark, least`` of every distinct shingle set, ``least`` being its least row."""
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), *row_key(id_col, text_col), F.col(text_col).alias("text"))
    hashed = slim.mapInArrow(_fingerprinted(shingle), "doc_id long, key_a long, key_b long, set_a long, set_b long, n long, mark binary")
    row = F.struct(F.col("doc_id").isNull().alias("lost"), "doc_id", "key_a", "key_b")
    grouped = hashed.groupBy("set_a", "set_b").agg(F.min(row).alias("least"), F.first("n").alias("n"), F.first("mark").alias("mark"))
    return cut(grouped.select(F.monotonically_increasing_id().alias("node"), "n", "mark", "least"))


def row_key(id_col: str = "doc_id", text_col: str = "text") -> tuple[Column, Column]:
    """``key_a, key_b``: 128 bits of hash that tell rows apart by id and text, also where the id is null."""
    parts = (F.col(id_col).isNull(), F.col(id_col), F.col(text_col).isNull(), F.col(text_col))
    return F.xxhash64(F.lit(0), *parts).alias("key_a"), F.xxhash64(F.lit(1), *parts).alias("key_b")


def _links(docs: DataFrame, classes: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int, group_rows: int, block_shingles: int) -> DataFrame:
    def met(labelled: DataFrame, pairs: range) -> DataFrame:
        keyed = labelled.select("label", "mark").mapInArrow(_keyed(pairs), _KEYS)
        return cut(keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_loosely(group_rows), "a long, b long"))

    # the first pair of segments joins most of a large group, so that the others need not link it again and again
    marked = classes.where("n > 0")
    first = met(marked.withColumn("label", F.col("node")), range(1))
    labelled = marked.join(connected_components(first), "node", "left").withColumn("label", F.coalesce("component", "node"))
    loose = connected_components(first.unionByName(met(labelled, range(1, SEGMENTS // 2))))
    members = loose.join(classes.select("node", "n", "least.key_a", "least.key_b"), "node")
    sizes = loose.join(classes.select("node", "n"), "node").groupBy("component").agg(F.ceil(F.sum("n") / block_shingles).cast("int").alias("blocks"))
    placed = members.join(sizes, "component").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    texts = docs.select(*row_key(id_col, text_col), F.col(text_col).alias("text")).dropDuplicates(["key_a", "key_b"])
    tiles = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda k: F.struct(F.least(k, "block").alias("i"), F.greatest(k, "block").alias("j")))
    dealt = texts.join(placed, ["key_a", "key_b"]).select("component", F.explode(tiles).alias("tile"), "node", "text")
    sets = dealt.select("component", "tile.i", "tile.j", "node", "text").mapInArrow(_shingled(shingle), "component long, i int, j int, node long, hashes binary")
    return sets.repartition("component", "i", "j").sortWithinPartitions("component", "i", "j").mapInArrow(_exactly(similarity), "a long, b long")


def _labelled(
    docs: DataFrame, id_col: str, text_col: str, similarity: float, shingle: int, group_rows: int, block_shingles: int
) -> DataFrame:
    """``node, least, component`` of every distinct shingle set."""
    require(docs, id_col, text_col)
    small_batches(docs.sparkSession)
    classes = _classes(docs, id_col, text_col, shingle)
    groups = connected_components(cut(_links(docs, classes, id_col, text_col, similarity, shingle, group_rows, block_shingles)))
    return classes.select("node", "least").join(groups, "node", "left").withColumn("component", F.coalesce("component", "node"))


def representatives(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY, shingle: int = SHINGLE_WORDS,
    group_rows: int = GROUP_ROWS, block_shingles: int = BLOCK_SHINGLES,
) -> DataFrame:
    """The :func:`row_key` of one row of each group of near copies: the least id's, null ids last, then the least key's.

    Texts are linked if their sets of ``shingle``-word shingles have a Jaccard similarity of at least
    ``similarity`` (the keys are laid out for 0.8 and more), and groups are what links connect. Words are
    runs without ASCII white space, A-Z lower-cased; a text of fewer words is one shingle, and texts without
    words, null ones too, are alike. Rows are told apart by id and text, so neither null ids nor an id on
    several texts make two groups one; repeated rows have one key. An empty table gives no rows; other
    columns are not looked at.
    """
    labelled = _labelled(docs, id_col, text_col, similarity, shingle, group_rows, block_shingles)
    return labelled.groupBy("component").agg(F.min("least").alias("least")).select("least.key_a", "least.key_b")
