"""Cursor motions as column functions from a document's line array and a position to a position.

All take ``lines`` (array of strings), ``line`` and ``col`` (0-based, code points) and return a struct
``line, col``. A motion works inside one document's row; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import MARK, SOLID, WORD, first_solid, let

_RUN = f"(?:{WORD}+|{MARK}+)"
_BLANKS = r"\p{IsWhite_Space}*"


def position(line: Column, col: Column) -> Column:
    return F.struct(line.cast("int").alias("line"), col.cast("int").alias("col"))


def each(cursors: Column, motion: Callable[[Column, Column], Column]) -> Column:
    """A motion of every cursor of an array of ``line, col`` structs: the array of where they end.

    A document with many cursors keeps them in its row, so its lines are there once and not once a cursor.
    """
    return F.transform(cursors, lambda at: motion(at["line"], at["col"]))


def _from(text: Column, col: Column) -> Column:
    return F.substring(text, col + 1, F.length(text))


def _before(text: Column, col: Column) -> Column:
    return F.substring(text, F.lit(1), col)


def next_line_start(lines: Column, line: Column) -> Column:
    """The first character that isn't white space at or below ``line``; the line's start if there is none."""
    rest = F.transform(F.slice(lines, line + 1, F.greatest(F.size(lines) - line, F.lit(0))), lambda x: x.rlike(SOLID))
    at = F.array_position(rest, True)
    target = (line + at - 1).cast("int")
    none = position(F.least(line, F.size(lines) - 1), F.lit(0))
    return F.when(at > 0, position(target, first_solid(F.get(lines, target)))).otherwise(none)


def previous_line_end(lines: Column, line: Column) -> Column:
    """The start of the last word or punctuation run of ``line``."""
    text = F.get(lines, line)
    trimmed = F.regexp_replace(text, r"\p{IsWhite_Space}+$", "")
    return position(line, F.length(trimmed) - F.length(F.regexp_extract(trimmed, f"{_RUN}$", 0)))


def word_forward(lines: Column, line: Column, col: Column, big: bool = False) -> Column:
    """To the next word's start, over line ends; on the last line it may stop at the line's length."""
    text = F.get(lines, line)
    run = f"(?:{SOLID}+)" if big else _RUN
    to = F.when(col >= F.length(text), col).otherwise(col + F.length(F.regexp_extract(_from(text, col), f"^{run}?{_BLANKS}", 0)))
    over = (to >= F.length(text)) & (line + 1 < F.size(lines))
    return F.when(over, next_line_start(lines, line + 1)).otherwise(position(line, to))


def word_back(lines: Column, line: Column, col: Column, big: bool = False) -> Column:
    """To the start of the word before; from column 0 to the last word of the line above."""
    text = F.get(lines, line)
    run = f"(?:{SOLID}+)" if big else _RUN
    tail = F.length(F.regexp_extract(_before(text, col), f"{run}{_BLANKS}$", 0))
    within = position(line, F.when(tail > 0, col - tail).otherwise(F.lit(0)))
    above = F.when(line > 0, previous_line_end(lines, line - 1)).otherwise(position(line, col))
    return F.when(col == 0, above).otherwise(within)


def word_end(lines: Column, line: Column, col: Column, big: bool = False) -> Column:
    """To the end of the word at or after the column; at a word's end it stays.

    Trailing white space: the big variant stops at the line's last column, the small one goes on to the
    next line.
    """
    text = F.get(lines, line)
    size = F.length(text)
    run = f"{SOLID}*" if big else f"{_RUN}?"
    reach = col + F.length(F.regexp_extract(_from(text, col), f"^{_BLANKS}{run}", 0))
    last = F.lit(line + 1 >= F.size(lines))
    below = F.when(last, position(line, F.greatest(size - 1, F.lit(0)))).otherwise(next_line_start(lines, line + 1))
    solid = F.lit(True) if big else _from(text, col).rlike(SOLID)
    stop = F.when(solid, position(line, F.greatest(reach - 1, F.lit(0)))).otherwise(below)
    past = F.when(last, position(line, col)).otherwise(next_line_start(lines, line + 1))
    return F.when(col >= size, past).otherwise(stop)


def _blank_flags(part: Column) -> Column:
    return F.transform(part, lambda x: ~x.rlike(SOLID))


def paragraph_forward(lines: Column, line: Column) -> Column:
    """To the first line with text after the next blank line; that blank line if none follows; else the last line."""
    n = F.size(lines)
    flags = _blank_flags(lines)
    blank = F.array_position(F.slice(flags, line + 2, F.greatest(n - line - 1, F.lit(0))), True)
    at = (line + blank).cast("int")
    text = F.array_position(F.slice(flags, at + 2, F.greatest(n - at - 1, F.lit(0))), False)
    found = F.when(text > 0, at + text).otherwise(at)
    return position(F.when(blank > 0, found).otherwise(F.greatest(n - 1, F.lit(0))), F.lit(0))


def paragraph_back(lines: Column, line: Column) -> Column:
    """To the first blank line of the nearest gap above; the top if there is no gap or no text above it."""
    flags = F.reverse(_blank_flags(F.slice(lines, 1, F.greatest(line, F.lit(0)))))
    blank = F.array_position(flags, True)
    text = F.array_position(F.slice(flags, (blank + 1).cast("int"), F.greatest(F.size(flags), F.lit(1))), False)
    found = (blank > 0) & (text > 0)
    return position(F.when(found, line - blank - text + 1).otherwise(F.lit(0)), F.lit(0))


def _tail(lines: Column, line: Column, col: Column) -> Column:
    """The text from a position to the document's end."""
    below = F.slice(lines, line + 2, F.greatest(F.size(lines) - line - 1, F.lit(0)))
    return F.array_join(F.concat(F.array(_from(F.get(lines, line), col)), below), "\n")


def place(text: Column, offset: Column, first_line: Column, first_col: Column) -> Column:
    """Line and column of an offset into text that begins at (``first_line``, ``first_col``)."""

    def of(head: Column) -> Column:
        down = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit("")))
        inline = F.length(F.substring_index(head, "\n", -1))
        return position(first_line + down, F.when(down > 0, inline).otherwise(first_col + inline))

    return let(F.substring(text, F.lit(1), offset), of)


def sentence_forward(lines: Column, line: Column, col: Column) -> Column:
    """Past the next ``.``, ``!`` or ``?`` that ends a sentence, to what follows it; the mark if nothing does.

    A mark ends a sentence before white space or the line's end. Without one: the document's last column.
    """
    start = col + 1
    last = F.size(lines) - 1
    end = position(last, F.greatest(F.length(F.get(lines, last)) - 1, F.lit(0)))

    def after(rest: Column, mark: Column) -> Column:
        blank = F.length(F.regexp_extract(_from(rest, mark), rf"^{_BLANKS}", 0))
        offset = F.when(mark + blank < F.length(rest), mark + blank).otherwise(mark - 1)
        return F.when(mark > 0, place(rest, offset, line, start)).otherwise(end)

    upto = lambda rest: F.length(F.regexp_extract(rest, r"(?s)^(.*?[.!?])(?=\p{IsWhite_Space}|\z)", 1))
    return let(_tail(lines, line, start), lambda rest: let(upto(rest), lambda mark: after(rest, mark)))


def sentence_back(lines: Column, line: Column, col: Column) -> Column:
    """To just after the nearest sentence mark before the column; never a mark in column 0; else the top."""
    text = F.get(lines, line)
    # the mark may be at most at col - 1, but what follows it is looked at in the whole line
    mark = r"(?s)^(.*[^\n][.!?])(?=\p{IsWhite_Space}|\z)"
    ahead = F.substring(text, col + 1, F.lit(1))
    here = F.regexp_extract(F.concat(_before(text, col), F.when(ahead == "", F.lit("\n")).otherwise(ahead)), r"(?s)^(.*.[.!?])(?=\p{IsWhite_Space})", 1)
    above = F.array_join(F.slice(lines, 1, F.greatest(line, F.lit(0))), "\n")

    def up(there: Column) -> Column:
        return F.when(F.length(there) > 0, place(there, F.length(there), F.lit(0), F.lit(0))).otherwise(position(F.lit(0), F.lit(0)))

    return let(here, lambda h: F.when(F.length(h) > 0, position(line, F.length(h))).otherwise(let(F.regexp_extract(above, mark, 1), up)))


def find_char(lines: Column, line: Column, col: Column, char: str, forward: bool = True, till: bool = False) -> Column:
    """To the next (previous) ``char`` on the line, or one short of it; null if there is none."""
    text = F.get(lines, line)
    if forward:
        at = F.instr(F.substring(text, col + 2, F.length(text)), char)
        return F.when(at > 0, position(line, col + at - (1 if till else 0)))
    back = F.instr(F.reverse(_before(text, col)), char)
    return F.when(back > 0, position(line, col - back + (1 if till else 0)))


PAIRS = (("(", ")"), ("{", "}"), ("[", "]"))


def _balance(part: Column, opening: str, closing: str, needed: int) -> Column:
    """Number of characters up to the first ``closing`` that isn't opened inside ``part``; 0 if none.

    Bracket characters are looked at one by one; everything else is removed first.
    """
    cut = F.split(part, f"(?<=[\\{opening}\\{closing}])", -1)
    first = F.struct(F.lit(needed).alias("depth"), F.lit(0).alias("at"), F.lit(False).alias("done"))

    def step(a: Column, piece: Column) -> Column:
        last = F.substring(piece, F.length(piece), F.lit(1))
        depth = a["depth"] + F.when(last == opening, 1).when(last == closing, -1).otherwise(0)
        return F.when(a["done"], a).otherwise(F.struct(depth.alias("depth"), (a["at"] + F.length(piece)).alias("at"), (depth == 0).alias("done")))

    return F.aggregate(cut, first, step, lambda a: F.when(a["done"], a["at"]).otherwise(0))


def closing_after(lines: Column, line: Column, col: Column, opening: str, closing: str) -> Column:
    """The first unopened ``closing`` at or after a position, over lines; null if none."""
    found = lambda rest, n: F.when(n > 0, place(rest, n - 1, line, col))
    return let(_tail(lines, line, col), lambda rest: let(_balance(rest, opening, closing, 1), lambda n: found(rest, n)))


def opening_before(lines: Column, line: Column, col: Column, opening: str, closing: str) -> Column:
    """The last unclosed ``opening`` before column ``col`` (exclusive), over lines; null if none."""
    text = F.array_join(F.concat(F.slice(lines, 1, F.greatest(line, F.lit(0))), F.array(_before(F.get(lines, line), col))), "\n")
    found = lambda head, n: F.when(n > 0, place(head, F.length(head) - n, F.lit(0), F.lit(0)))
    return let(text, lambda head: let(_balance(F.reverse(head), closing, opening, 1), lambda n: found(head, n)))


def matching_bracket(lines: Column, line: Column, col: Column) -> Column:
    """The bracket that pairs with the one under the cursor, over lines; null if there is none."""
    under = F.substring(F.get(lines, line), col + 1, F.lit(1))
    out = F.lit(None).cast("struct<line:int,col:int>")
    for opening, closing in PAIRS:
        out = F.when(under == opening, closing_after(lines, line, col + 1, opening, closing)).when(under == closing, opening_before(lines, line, col, opening, closing)).otherwise(out)
    return out


def line_end(lines: Column, line: Column) -> Column:
    """The last column of the line, 0 if it is empty."""
    return position(line, F.greatest(F.length(F.get(lines, line)) - 1, F.lit(0)))


def line_indent(lines: Column, line: Column) -> Column:
    """The first column that isn't white space, 0 if all is."""
    text = F.get(lines, line)
    return position(line, F.when(text.rlike(SOLID), first_solid(text)).otherwise(F.lit(0)))


def goto_line(lines: Column, target: Column) -> Column:
    """Line ``target`` (0-based, clamped to the last), at its first column that isn't white space."""
    return line_indent(lines, F.greatest(F.least(target, F.size(lines) - 1), F.lit(0)))


def step(lines: Column, line: Column, col: Column, down: int = 0, right: int = 0) -> Column:
    """One step by arrow key: vertical moves clamp the column, horizontal ones stop at the line's ends."""
    to = F.greatest(F.least(line + down, F.size(lines) - 1), F.lit(0))
    last = F.greatest(F.length(F.get(lines, to)) - 1, F.lit(0))
    if down:
        return position(to, F.when(to == line, col).otherwise(F.least(col, last)))
    moved = F.greatest(col - 1, F.lit(0)) if right < 0 else F.when(col < last, col + 1).otherwise(col)
    return position(line, moved if right else col)
