"""URL filters as a sort-merge range join.

A host's labels in reverse order, each closed by a dot, make a canonical key: a rule for a host covers
exactly the keys that start with the rule's key, which is one interval of the key order. Pages and
rules are cut into key ranges; a rule goes to every range its interval touches. Inside a range one
sorted sweep keeps the stack of rules whose intervals are open, which are nested, and a page is judged by
the stack's rules whose path its own starts with.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm.common import lookup, require, small_batches

DEFAULT_VERDICT = "allow"
#: Pages that one task sweeps, about; a range with more is salted.
SWEEP_ROWS = 200_000


def _lower(x: Column) -> Column:
    return F.translate(x, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def url_host(url: Column) -> Column:
    """What lies between the first ``://`` and the next ``/``, ``?`` or ``#``, A-Z lower-cased; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(_lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to ``?`` or ``#``; else empty."""
    rest = F.when(F.instr(url, "://") > 0, F.substring(url, F.instr(url, "://") + 3, F.length(url)))
    return F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """The canonical key: labels from the last to the first, a dot after each."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit("."))


def _number(key: Column) -> Column:
    """The key's first seven bytes as a number; its order never contradicts the keys' order."""
    return F.conv(F.rpad(F.substring(F.hex(F.encode(key, "UTF-8")), 1, 14), 14, "0"), 16, 10).cast("long")


class _Sweep:
    """The stack of open rules; hosts nest, so each frame's interval holds the next one's."""

    def __init__(self) -> None:
        self.frames: list[tuple[str, str, dict[str, tuple[str, str]], set[int]]] = []

    def close(self, key: str) -> None:
        while self.frames and self.frames[-1][1] <= key:
            self.frames.pop()

    def open(self, key: str, path: str, rule: str, verdict: str) -> None:
        if not self.frames or self.frames[-1][0] != key:
            self.frames.append((key, key[:-1] + "/", {}, set()))
        _, _, paths, lengths = self.frames[-1]
        if path not in paths or verdict > paths[path][1]:
            paths[path] = (rule, verdict)
        lengths.add(len(path))

    def judge(self, path: str) -> tuple[str, str] | None:
        """The longest fitting rule; of equally long ones the one with the longer host."""
        best, longest = None, -1
        for key, _, paths, lengths in reversed(self.frames):
            for n in lengths:
                if n <= len(path) and len(key) + n > longest and (found := paths.get(path[:n])):
                    best, longest = found, len(key) + n
        return best


OUT = T.StructType([T.StructField("page_id", T.LongType())] + [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")])


def _sweep(default: str):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, place = _Sweep(), None
        for batch in batches:
            out: list[list] = [[] for _ in OUT.names]
            for bucket, salt, key, page, number, host, path, rule, verdict in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket, salt) != place:
                    sweep, place = _Sweep(), (bucket, salt)
                sweep.close(key)
                if not page:
                    sweep.open(key, path, rule, verdict)
                    continue
                found = sweep.judge(path) or (None, default)
                for column, value in zip(out, (number, host, path, *found), strict=True):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64() if k == 0 else pa.string()) for k, x in enumerate(out)], names=OUT.names)

    return run


def judge_urls(pages: DataFrame, rules: DataFrame, default: str = DEFAULT_VERDICT, id_col: str = "page_id", url_col: str = "url", sweep_rows: int = SWEEP_ROWS) -> DataFrame:
    """``page_id, host, path, rule, verdict`` for every page.

    ``rules`` has string columns ``host, path, verdict``. A rule fits its host and the host's subdomains
    where the page's path starts with the rule's; the longest wins, host and path counted together, of
    equally long ones that with the longer host, of rules stated twice that whose verdict sorts last.
    ``rule`` is ``host`` and ``path`` joined, null where none fits; the verdict is then ``default``. A null
    url or one without ``://`` has an empty host and path. Repeated pages come back repeated; without
    pages there are no rows, without rules all get the default. Other columns are not looked at.
    """
    require(pages, id_col, url_col)
    require(rules, "host", "path", "verdict")
    spark = pages.sparkSession
    small_batches(spark)
    url = F.col(url_col)
    parsed = pages.select(F.col(id_col).cast("long").alias("page_id"), url_host(url).alias("host"), url_path(url).alias("path"))
    keyed = parsed.withColumn("key", host_key(F.col("host"))).withColumn("number", _number(F.col("key")))
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    shares = [k / parts for k in range(1, parts)]
    cuts = sorted(set(keyed.select(F.percentile_approx("number", shares, 10_000).alias("cuts")).first()["cuts"] or []))
    bucket = lambda n: F.size(F.filter(F.array(*map(F.lit, cuts)).cast("array<long>"), lambda c: c <= n)) if cuts else F.lit(0)
    placed = keyed.withColumn("bucket", bucket(F.col("number")))
    counts = {r["bucket"]: r["count"] for r in placed.groupBy("bucket").count().collect()}
    salts = [max(1, -(-counts.get(b, 0) // sweep_rows)) for b in range(len(cuts) + 1)]
    page_rows = placed.select(
        "bucket", F.pmod(F.xxhash64("page_id", "host", "path"), lookup(salts, F.col("bucket"))).alias("salt"), "key", F.lit(True).alias("page"),
        "page_id", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(None).cast("string").alias("verdict"),
    )
    clean = rules.where("host is not null and path is not null and verdict is not null").select(_lower(F.col("host")).alias("host"), "path", "verdict").distinct()
    low = clean.withColumn("key", host_key(F.col("host"))).withColumn("rule", F.concat("host", "path"))
    after = F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/"))
    ranged = low.withColumn("bucket", F.explode(F.sequence(bucket(_number(F.col("key"))), bucket(_number(after)))))
    rule_rows = ranged.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), lookup(salts, F.col("bucket")) - 1))).select(
        "bucket", "salt", "key", F.lit(False).alias("page"), F.lit(None).cast("long").alias("page_id"), "host", "path", "rule", "verdict"
    )
    both = page_rows.unionByName(rule_rows).repartition("bucket", "salt").sortWithinPartitions("bucket", "salt", "key", "page")
    return both.mapInArrow(_sweep(default), OUT)
