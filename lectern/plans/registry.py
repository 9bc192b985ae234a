"""A registry of named queries, each with the DuckDB SQL it must agree with, if SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.text import lines_of

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its name."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(F.col("text").isNotNull())


def cursors(docs: DataFrame) -> DataFrame:
    """``doc_id, ls, n, line, cur, col``: every text's lines and one cursor in it.

    The cursor stands on line ``doc_id % n`` at column ``doc_id * 7 % length``.
    """
    cut = docs.select("doc_id", lines_of(F.col("text")).alias("ls"))
    at = cut.withColumn("n", F.size("ls")).withColumn("line", (F.col("doc_id") % F.col("n")).cast("int")).withColumn("cur", F.get("ls", F.col("line")))
    size = F.length("cur")
    return at.withColumn("col", F.when(size == 0, 0).otherwise(F.col("doc_id") * 7 % F.greatest(size, F.lit(1))).cast("int"))


#: The same in DuckDB: ``k`` has ``doc_id, ls, n, line, cur, col``; ``src`` is the table of texts.
def cursor_sql(src: str = "SELECT doc_id, text FROM documents WHERE text IS NOT NULL") -> str:
    return f"""src AS ({src}),
d AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM src),
c AS (SELECT doc_id, ls, CAST(len(ls) AS BIGINT) AS n, CAST(doc_id % len(ls) AS BIGINT) AS line FROM d),
e AS (SELECT *, ls[line + 1] AS cur FROM c),
k AS (SELECT *, CAST(CASE WHEN length(cur) = 0 THEN 0 ELSE (doc_id * 7) % length(cur) END AS BIGINT) AS col FROM e)"""


def longs(struct: Column, prefix: str = "", *fields: str) -> list[Column]:
    """Fields of a struct as long columns named with a prefix."""
    return [struct[f].cast("long").alias(f"{prefix}{f}") for f in fields]


def at(position: Column, prefix: str) -> list[Column]:
    return longs(position, f"{prefix}_", "line", "col")


def between(span: Column, prefix: str) -> list[Column]:
    return [span[e][f].cast("long").alias(f"{prefix}_{e}_{f}") for e in ("start", "end") for f in ("line", "col")]


CHAPTERS = """SELECT conv_id AS doc_id, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id"""


def chapters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as books: turns are chapters, joined by blank lines."""
    from lectern.sources.books import joined_chapters

    parts = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("spine_idx"), F.coalesce("text", F.lit("")).alias("text"))
    return joined_chapters(parts)
