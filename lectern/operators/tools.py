"""Line tools and the command guard. Nothing is ever executed: these are relational counterparts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions.text import lines_of, running_before

#: The programs a command may name.
ALLOWED = (
    "ls", "pwd", "find", "locate", "which", "whereis", "cat", "less", "more", "head", "tail", "file", "stat", "wc", "nl",
    "grep", "awk", "sed", "sort", "uniq", "cut", "tr", "fmt", "fold", "date", "uptime", "whoami", "id", "uname", "hostname",
    "df", "free", "ps", "top", "env", "printenv", "history", "tar", "zip", "unzip", "gzip", "gunzip", "zcat", "ping", "dig",
    "nslookup", "curl", "wget", "echo", "printf", "basename", "dirname", "realpath", "readlink", "Get-ChildItem", "Get-Content",
    "Get-Location", "Select-String", "Get-Date", "Get-Process", "Get-Host", "Format-Table", "Select-Object", "Measure-Object",
    "Where-Object", "Sort-Object", "powershell.exe", "powershell",
)
#: Characters no argument may hold.
DANGEROUS = r"[|&;`$()<>\\*?]"
MAX_ARGUMENTS, MAX_ARGUMENT_BYTES = 50, 1000


def command_allowed(command: Column) -> Column:
    """Whether a command line passes the guard: a listed program, harmless arguments, few and short ones."""
    parts = F.filter(F.split(command, r"\p{IsWhite_Space}+", -1), lambda p: p != "")
    rest = F.slice(parts, 2, F.greatest(F.size(parts), F.lit(1)))
    listed = F.coalesce(F.get(parts, F.lit(0)).isin(*ALLOWED), F.lit(False))
    bad = F.exists(rest, lambda p: p.rlike(DANGEROUS) | (F.octet_length(p) > MAX_ARGUMENT_BYTES))
    return F.coalesce(listed & ~bad & (F.size(parts) <= MAX_ARGUMENTS), F.lit(False))


def matches(line: Column, pattern: str, ignore_case: bool = False) -> Column:
    """Whether a line matches a regular expression."""
    return line.rlike(("(?i)" if ignore_case else "") + pattern)


def grep(lines: DataFrame, pattern: str, ignore_case: bool = False, invert: bool = False) -> DataFrame:
    """Lines that match a regular expression, or don't."""
    hit = matches(F.col("line"), pattern, ignore_case)
    return lines.where(~hit if invert else hit)


def _cut(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("doc_id"), lines_of(F.col(text_col)).alias("lines"))


def nl(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Lines with 1-based numbers, empty ones unnumbered: ``doc_id, line_idx, line, number``. Nothing is shuffled."""
    numbers = running_before(F.transform("lines", lambda x: (x != "").cast("long")))
    placed = _cut(docs, id_col, text_col).select("doc_id", F.posexplode(F.arrays_zip("lines", numbers.alias("before"))).alias("line_idx", "at"))
    line = F.col("at.lines")
    return placed.select("doc_id", "line_idx", line.alias("line"), F.when(line != "", F.col("at.before") + 1).alias("number"))


def numbered(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, line_idx, line, n_lines``: lines that know how many their document has."""
    return _cut(docs, id_col, text_col).select("doc_id", F.size("lines").alias("n_lines"), F.posexplode("lines").alias("line_idx", "line")).select("doc_id", "line_idx", "line", "n_lines")


def in_head(n: int = 10) -> Column:
    """Whether a row of :func:`numbered` is one of its document's first ``n`` lines."""
    return F.col("line_idx") < n


def in_tail(n: int = 10) -> Column:
    """Whether a row of :func:`numbered` is one of its document's last ``n`` lines."""
    return F.col("line_idx") >= F.col("n_lines") - n


def uniq(docs: DataFrame, key: Callable[[Column], Column] = lambda x: x, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of adjacent lines with the same key: ``doc_id, line_idx`` of the first, ``line`` (the key) and ``n``. Nothing is shuffled."""
    keyed = _cut(docs, id_col, text_col).select("doc_id", F.transform("lines", key).alias("keys"))
    fresh = F.filter(F.sequence(F.lit(0), F.size("keys") - 1), lambda i: (i == 0) | (F.get("keys", i) != F.get("keys", i - 1)))
    runs = keyed.select("doc_id", "keys", fresh.alias("starts"))
    ends = F.concat(F.slice("starts", 2, F.size("starts")), F.array(F.size("keys")))
    found = F.zip_with("starts", ends, lambda a, b: F.struct(a.alias("line_idx"), F.get("keys", a).alias("line"), (b - a).cast("long").alias("n")))
    return runs.select("doc_id", F.inline(found))


def field(line: Column, number: int, delimiter: str = " ") -> Column:
    """The 1-based field of a line; the whole line if it has no delimiter, empty if too few fields."""
    parts = F.split(line, "\\Q" + delimiter + "\\E", -1)
    return F.when(F.size(parts) == 1, line).otherwise(F.coalesce(F.get(parts, F.lit(number - 1)), F.lit("")))


def tr(line: Column, source: str, target: str) -> Column:
    """Characters replaced one by one."""
    return F.translate(line, source, target)


def sorted_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document's lines in byte order: ``doc_id, rank, line``. Sorted in the document's row, so nothing is shuffled."""
    return _cut(docs, id_col, text_col).select("doc_id", F.posexplode(F.array_sort("lines")).alias("rank", "line"))


def wc(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Line feeds, words and bytes of every text."""
    text = F.col(text_col)
    count = F.size(F.filter(F.split(text, r"\p{IsWhite_Space}+", -1), lambda w: w != ""))
    feeds = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))
    return docs.where(text.isNotNull()).select(F.col(id_col).alias("doc_id"), feeds.cast("long").alias("lines"), count.cast("long").alias("words"), F.octet_length(text).cast("long").alias("bytes"))


#: The PowerShell pieces that flags stand for, by command.
_PIECES = {
    "ls": {"": " | Select-Object -ExpandProperty Name", "l": " | Format-Table Mode, LastWriteTime, Length, Name", "a": " -Force"},
    "cat": {"n": " | Select-Object @{Name='LineNumber';Expression={$_.ReadCount}}, @{Name='Line';Expression={$_}}"},
    "grep": {"i": " -CaseSensitive:$false", "v": " -NotMatch", "n": " | Format-Table LineNumber, Line"},
    "head": {"": " -First "},
    "tail": {"": " -Tail "},
}


def translated(command: str) -> str:
    """The PowerShell counterpart of a simple Unix command; others are left alone.

    For ``head`` and ``tail`` a number right after ``-n`` is the count, not a file.
    """
    name, *rest = command.split() or [""]
    pieces = _PIECES.get(name, {})
    flags, words = "".join(x[1:] for x in rest if x[0] == "-"), [x for x in rest if x[0] != "-"]
    if name == "pwd":
        return "Get-Location"
    if name == "ls":
        path = f" -Path {', '.join(words)}" if words else ""
        return "Get-ChildItem" + path + (pieces["a"] if "a" in flags else "") + pieces["l" if "l" in flags else ""]
    if name == "cat":
        return " ".join(["Get-Content", *words]) + (pieces["n"] if "n" in flags else "")
    if name == "grep":
        if len(words) < 2:
            return "Select-String"
        return f'Select-String -Pattern "{words[0]}" -Path "{words[1]}"' + "".join(pieces[f] for f in "ivn" if f in flags)
    if name in ("head", "tail"):
        count = flags[1:] if flags[1:].isdigit() else "10"
        if flags == "n" and words and words[0].isdigit():
            count, words = words[0], words[1:]
        return " ".join(["Get-Content", *words[:1]]) + pieces[""] + count
    return command


@F.pandas_udf(T.StringType())
def _translated(commands: pd.Series) -> pd.Series:
    return commands.map(translated, na_action="ignore")


def translation(command: Column) -> Column:
    """:func:`translated` of a column of commands; null for null."""
    return _translated(command)
