"""Column functions on single lines and texts. Columns are 0-based code points; spans are half-open."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode word characters, white space and all else, as Java regular expressions.
WORD = r"[\p{IsAlphabetic}\p{N}_]"
SPACE = r"(?U:\s)"
MARK = r"[^\p{IsAlphabetic}\p{N}_\p{IsWhite_Space}]"
SOLID = r"\P{IsWhite_Space}"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often ``body`` uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lines_of(text: Column) -> Column:
    """The lines of a text as an array, empty ones included; null for a null text."""
    return F.split(text, "\n", -1)


def running_before(sizes: Column, block: int = 128) -> Column:
    """For each number of an array the sum of those before it, as longs.

    Sums are made within blocks and then over blocks, as an array that grows is copied at every step.
    """
    none = F.struct(F.lit(0).cast("long").alias("sum"), F.array().cast("array<bigint>").alias("out"))
    step = lambda a, n: F.struct((a["sum"] + n).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out"))
    running = lambda xs: F.aggregate(xs, none, step, lambda a: a["out"])
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, n: a + n)
    count = F.ceil(F.size(sizes) / block).cast("int")
    blocks = F.transform(F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>")), lambda b: F.slice(sizes, b * block + 1, F.lit(block)))

    def over(parts: Column) -> Column:
        bases = running(F.transform(parts, total))
        return let(bases, lambda base: F.flatten(F.transform(parts, lambda xs, b: F.transform(running(xs), lambda n: n + F.get(base, b)))))

    return let(blocks, over)


def is_blank(line: Column) -> Column:
    """Nothing but Unicode white space."""
    return ~line.rlike(SOLID)


def paragraphs(text: Column) -> Column:
    """Pieces between blank-line marks (two line feeds), empty pieces kept."""
    return F.split(text, "\n\n", -1)


def words(text: Column) -> Column:
    """Tokens between runs of Unicode white space, none empty."""
    return F.filter(F.split(text, r"\p{IsWhite_Space}+", -1), lambda w: w != "")


def hard_split(tokens: Column, width: int) -> Column:
    """Tokens longer than ``width`` code points cut into chunks of ``width``."""
    if width < 1:
        raise ValueError("width must be at least 1")
    chunks = lambda w: F.transform(F.sequence(F.lit(0), F.floor((F.length(w) - 1) / width).cast("int")), lambda i: F.substring(w, i * width + 1, F.lit(width)))
    return F.flatten(F.transform(tokens, chunks))


def _original(line: Column, lowered: Column) -> Column:
    """The column of a line that a column of the lower-cased line comes from.

    They differ only behind the few letters whose lower case is longer; then prefixes are measured.
    """
    behind = F.size(F.filter(F.sequence(F.lit(1), F.length(line)), lambda c: F.length(F.lower(F.substring(line, F.lit(1), c))) <= lowered))
    return F.when(F.length(F.lower(line)) == F.length(line), lowered).otherwise(behind)


def find_first(line: Column, query: str) -> Column:
    """Column of the first case-insensitive occurrence; null if none or for an empty query."""
    at = F.instr(F.lower(line), query.lower())
    return F.when((at > 0) & F.lit(query != ""), _original(line, at - 1))


def find_last(line: Column, query: str) -> Column:
    """Column of the last case-insensitive occurrence; null if none or for an empty query."""
    at = F.instr(F.reverse(F.lower(line)), query.lower()[::-1])
    return F.when((at > 0) & F.lit(query != ""), _original(line, F.length(F.lower(line)) - (at - 1) - len(query.lower())))


def find_all(line: Column, query: str) -> Column:
    """Columns of all non-overlapping case-insensitive occurrences, left to right."""
    pieces = F.split(F.lower(line), "(?:" + _quoted(query.lower()) + ")", -1)
    size = len(query.lower())
    ends = F.aggregate(
        F.slice(pieces, 1, F.size(pieces) - 1), F.array().cast("array<int>"),
        lambda a, p: F.concat(a, F.array(F.coalesce(F.try_element_at(a, F.lit(-1)) + size, F.lit(0)) + F.length(p))),
    )
    return F.when(F.lit(query == ""), F.array().cast("array<int>")).otherwise(F.transform(ends, lambda at: _original(line, at)))


def _quoted(query: str) -> str:
    return "".join(f"\\x{{{ord(c):x}}}" for c in query)


def first_solid(line: Column) -> Column:
    """Column of the first character that isn't white space; the length if there is none."""
    return F.length(F.regexp_extract(line, r"^\p{IsWhite_Space}*", 0))


def run_at(line: Column, col: Column, cls: str) -> tuple[Column, Column]:
    """Start and end of the run of ``cls`` characters around a column (empty where the character isn't one)."""
    before = F.length(F.regexp_extract(F.substring(line, F.lit(1), col), f"{cls}+$", 0))
    after = F.length(F.regexp_extract(F.substring(line, col + 1, F.length(line)), f"^{cls}+", 0))
    return F.when(after > 0, col - before).otherwise(col), col + after


def text_hash(text: Column) -> Column:
    """A document's key: the first 16 hex digits of its MD5, as text."""
    return F.substring(F.md5(F.encode(text, "UTF-8")), 1, 16)


def similarity(a: Column, b: Column) -> Column:
    """A struct of the edit ``distance`` of two whole texts and their likeness in ``percent`` of the longer one."""
    distance = F.levenshtein(a, b)
    return let(distance, lambda d: F.struct(d.alias("distance"), ((1 - d / F.greatest(F.length(a), F.length(b), F.lit(1))) * 100).alias("percent")))
