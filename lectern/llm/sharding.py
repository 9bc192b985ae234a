"""Sharding along a Hilbert curve, with DataFrame functions only.

Language, source and size are quantised to sixteen equally filled steps each, by exact quantiles of all
rows; a Hilbert index over the three steps orders the documents so that a run of the order covers a compact
box in all dimensions, which file statistics can prune. The order is cut into runs whose row counts differ by at most one.

The rank of a row in the whole order never needs one task to see all rows: Hilbert cells are split into
chunks by hash in proportion to their rows, chunk counts are summed up, and rows are numbered within
chunks.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import cut, lookup, require, unsigned_crc32

BITS, DIMENSIONS = 4, 3
LAW = "rows"
#: Rows that one task numbers together, about.
CHUNK_ROWS = 100_000


def hilbert_index(point: tuple[int, ...], bits: int) -> int:
    """The position of a grid point on the Hilbert curve (transpose form: Gray code, then undo rotations)."""
    x, n = list(point), len(point)
    mask = 1 << (bits - 1)
    step = mask
    while step > 1:
        low = step - 1
        for i in range(n):
            if x[i] & step:
                x[0] ^= low
            else:
                swap = (x[0] ^ x[i]) & low
                x[0] ^= swap
                x[i] ^= swap
        step >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    flip, step = 0, mask
    while step > 1:
        if x[n - 1] & step:
            flip ^= step - 1
        step >>= 1
    x = [v ^ flip for v in x]
    return sum(((x[i] >> b) & 1) << (b * n + n - 1 - i) for b in range(bits) for i in range(n))


def curve_table(bits: int = BITS) -> list[int]:
    """Hilbert indexes of all cells of the three-dimensional grid, first dimension slowest."""
    side = range(1 << bits)
    return [hilbert_index((a, b, c), bits) for a in side for b in side for c in side]


def _cuts(rows: DataFrame, column: str, total: int) -> list:
    """Values that a column, in value order and nulls first, reaches at every sixteenth of its ``total`` rows.

    All values are counted whole, and all counts are summed up in order: tasks hold ranges of the values, and
    the driver gets a sum for each range and the values that reach a share, fifteen at most. Where the ranges
    end changes no result.
    """
    order, shares, total = F.col("value").asc_nulls_first(), 1 << BITS, max(total, 1)
    counts = rows.groupBy(F.col(column).alias("value")).agg(F.count("*").alias("n"))
    # ranges are kept, so that they are the same in both passes
    dealt = cut(counts.repartitionByRange(order).withColumn("part", F.spark_partition_id()))
    sums = {r["part"]: r["n"] for r in dealt.groupBy("part").agg(F.sum("n").alias("n")).collect()}
    before = [0, *accumulate(sums.get(k, 0) for k in range(max(sums, default=0)))]
    reaching = [k for k, n in sums.items() if (before[k] + n) * shares // total > before[k] * shares // total]
    upto = lookup(before, F.col("part")) + F.sum("n").over(Window.partitionBy("part").orderBy(order))
    reached = f"least(upto * {shares} div {total}, {shares - 1}) > (upto - n) * {shares} div {total}"
    return [r["value"] for r in dealt.where(F.col("part").isin(reaching)).withColumn("upto", upto).where(reached).collect() if r["value"] is not None]


def _steps(x: Column, cuts: list) -> Column:
    """Number of cuts at or below a value; none for null."""
    total = F.lit(0)
    for c in sorted(set(cuts)):
        total = total + F.coalesce((x >= F.lit(c)).cast("int"), F.lit(0))
    return total


def hilbert_shards(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source", chunk_rows: int = CHUNK_ROWS
) -> DataFrame:
    """``doc_id, size, text_crc32, hilbert, law, shard, slot, grown_shard`` for every row.

    ``size`` is the text's UTF-8 bytes plus one, a null text having none. Shards hold equal counts of
    rows, at most one apart, along the Hilbert order; ``slot`` counts from 0 within a shard. Rows of one
    Hilbert cell are ordered by hash of id, text and place in the table, so no group of equal rows is
    numbered by one task. Null ids, languages and sources sort first; repeated rows take slots of their own. An empty
    table gives no rows; other columns are not looked at.
    """
    require(docs, id_col, text_col, lang_col, source_col)
    slim = cut(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"), _size(text_col).alias("size"), unsigned_crc32(F.col(text_col)).alias("text_crc32"),
            F.col(lang_col).alias("d0"), F.col(source_col).alias("d1"), F.xxhash64(F.col(id_col), F.col(text_col), F.monotonically_increasing_id()).alias("h"),
        )
    )
    total = slim.count()
    cuts = {c: _cuts(slim, c, total) for c in ("d0", "d1", "size")}
    cell = F.lit(0)
    for c in ("d0", "d1", "size"):
        cell = cell * (1 << BITS) + _steps(F.col(c), cuts[c])
    placed = slim.withColumn("hilbert", lookup(curve_table(), cell)).drop("d0", "d1")
    counts = {r["hilbert"]: r["count"] for r in placed.groupBy("hilbert").count().collect()}
    chunks = [max(1, -(-counts.get(k, 0) // chunk_rows)) for k in range(1 << BITS * DIMENSIONS)]
    # a chunk is a range of the hash, so chunks follow each other in hash order within a cell
    share = F.shiftrightunsigned(F.col("h").bitwiseXOR(F.lit(-(1 << 63))), 32)
    chunked = placed.withColumn("chunk", F.shiftrightunsigned(share * lookup(chunks, F.col("hilbert")), 32))
    # one row per hundred thousand documents and at most 4096 more are summed up in order
    before = Window.orderBy("hilbert", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    bases = chunked.groupBy("hilbert", "chunk").count().select("hilbert", "chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("hilbert", "chunk").orderBy("h", "doc_id", "size")
    ranked = chunked.withColumn("place", F.row_number().over(within) - 1).join(bases, ["hilbert", "chunk"]).withColumn("rank", F.col("place") + F.col("base"))
    shard = F.expr(f"cast(rank * {shards} div {max(total, 1)} as int)")
    first = F.expr(f"(shard * {max(total, 1)}L + {shards - 1}) div {shards}")
    return ranked.withColumn("shard", shard).select(
        F.col("doc_id").alias(id_col), "size", "text_crc32", "hilbert", F.lit(LAW).alias("law"), "shard", (F.col("rank") - first).alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )


def write_shards(docs: DataFrame, shards: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", files: int = 16) -> None:
    """Write each shard's documents to a folder of its own, in curve order.

    ``shards`` is what :func:`hilbert_shards` gave for ``docs``. A shard is cut into ``files`` runs of its
    order, a file each, so the statistics of a file cover a small box of languages, sources and sizes and
    readers skip the others. Rows find their places by id (null ones too), size and checksum, repeated ones
    by their number, so every row is written once. Columns named ``shard`` or ``run`` are replaced by the
    folders' own, others are carried along; an empty table writes none.
    """
    require(docs, id_col, text_col)
    key = [F.col(id_col).cast("long").alias("id_"), _size(text_col).alias("size_"), unsigned_crc32(F.col(text_col)).alias("crc_")]
    nth = F.row_number().over(Window.partitionBy("id_", "size_", "crc_").orderBy("id_")).alias("nth_")
    rows = docs.drop("shard", "run").select("*", *key).select("*", nth)
    top = shards.groupBy("shard").agg((F.max("slot") + 1).alias("rows"))
    at = shards.select(F.col(id_col).alias("id_"), F.col("size").alias("size_"), F.col("text_crc32").alias("crc_"), "shard", "slot").select("*", nth)
    # one row per shard
    at = at.join(F.broadcast(top), "shard").withColumn("run", F.expr(f"cast(slot * {files} div rows as int)")).drop("rows").alias("at")
    same = F.lit(True)
    for c in ("id_", "size_", "crc_", "nth_"):
        same = same & F.col(f"at.{c}").eqNullSafe(F.col(f"rows.{c}"))
    placed = rows.alias("rows").join(at, same).select(*[F.col(f"rows.`{c}`") for c in docs.columns if c not in ("shard", "run")], "at.shard", "at.run", F.col("at.slot").alias("slot_"))
    placed.repartition("shard", "run").sortWithinPartitions("shard", "run", "slot_").drop("slot_").write.partitionBy("shard", "run").parquet(path)


def _size(text_col: str) -> Column:
    return F.octet_length(F.coalesce(F.col(text_col), F.lit(""))).cast("long") + 1
