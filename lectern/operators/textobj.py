"""Text objects: spans around a position, as column functions on a document's line array.

Spans are structs ``start, end`` of ``line, col`` structs, the end exclusive; null means "no change".
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.text import MARK, SOLID, WORD, let, run_at
from lectern.operators.motion import PAIRS, closing_after, opening_before, place, position


def span(start: Column, end: Column) -> Column:
    return F.struct(start.alias("start"), end.alias("end"))


def _on_line(line: Column, start: Column, end: Column) -> Column:
    return span(position(line, start), position(line, end))


def inner_word(lines: Column, line: Column, col: Column, big: bool = False) -> Column:
    """The run of word, punctuation (``big``: any solid) characters at a column; null on white space."""
    text = F.get(lines, line)
    at = F.least(col, F.length(text) - 1)
    out = F.lit(None)
    for cls in (SOLID,) if big else (MARK, WORD):
        start, end = run_at(text, at, cls)
        out = F.when(end > start, _on_line(line, start, end)) if cls in (SOLID, MARK) else F.when(end > start, _on_line(line, start, end)).otherwise(out)
    return F.when(F.length(text) > 0, out)


def around_word(lines: Column, line: Column, col: Column, big: bool = False) -> Column:
    """The run, blanks after it, and blanks before it too unless the run ends its line; null on an empty line.

    From white space it takes the run before; leading blanks come along in the common case, as quirky as
    it is.
    """
    text = F.get(lines, line)
    head = F.substring(text, F.lit(1), col)
    on_blank = F.substring(text, col + 1, F.lit(1)).rlike(r"^\p{IsWhite_Space}$")
    back = F.length(F.regexp_extract(head, r"\p{IsWhite_Space}*$", 0))
    at = F.when(on_blank, F.greatest(col - back - 1, F.lit(0))).otherwise(col)
    start, end = at, at
    for cls in (SOLID,) if big else (WORD, MARK):
        s, e = run_at(text, at, cls)
        start, end = F.when(e > s, s).otherwise(start), F.when(e > s, e).otherwise(end)
    after = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^\p{IsWhite_Space}*", 0))
    stop = end + after
    before = F.length(F.regexp_extract(F.substring(text, F.lit(1), start), r"\p{IsWhite_Space}*$", 0))
    lead = (stop < F.length(text)) | (start == 0)
    return F.when(F.length(text) > 0, _on_line(line, F.when(lead, start - before).otherwise(start), stop))


def _paragraph_lines(lines: Column, line: Column, around: bool) -> tuple[Column, Column]:
    flags = F.transform(lines, lambda x: ~x.rlike(SOLID))
    above = F.reverse(F.slice(flags, 1, F.greatest(line, F.lit(0))))
    below = F.slice(flags, line + 2, F.greatest(F.size(lines) - line - 1, F.lit(0)))

    def reach(part: Column) -> Column:
        solid = F.array_position(part, True)
        text = F.when(solid > 0, solid - 1).otherwise(F.size(part))
        if not around:
            return text
        rest = F.slice(part, (text + 1).cast("int"), F.greatest(F.size(part), F.lit(1)))
        again = F.array_position(rest, False)
        return text + F.when(again > 0, again - 1).otherwise(F.size(rest))

    return line - reach(above), line + reach(below)


def paragraph(lines: Column, line: Column, around: bool = False) -> Column:
    """The lines up and down to the next blank ones; ``around`` takes the blank lines on both sides too."""
    first, last = _paragraph_lines(lines, line, around)
    last = last.cast("int")
    return span(position(first, F.lit(0)), position(last, F.length(F.get(lines, last))))


def sentence(lines: Column, line: Column, col: Column, around: bool = False) -> Column:
    """From after the previous ``.``, ``!`` or ``?`` to the next one inclusive, over lines.

    Any mark counts, whatever follows it. Open ends reach to the document's start or end. ``around``
    takes the blanks after the mark on its line.
    """
    text = F.array_join(lines, "\n")
    line_at = F.length(F.array_join(F.slice(lines, 1, F.greatest(line, F.lit(0))), "\n")) + F.when(line > 0, 1).otherwise(0)
    at = line_at + col
    head = F.substring(text, F.lit(1), F.least(at + 1, line_at + F.length(F.get(lines, line))))
    before = F.length(F.regexp_extract(head, r"(?s)^(.*[.!?])", 1))
    rest = F.substring(text, before + 1, F.length(text))
    skip = F.when(rest.startswith("\n"), F.length(F.regexp_extract(rest, r"^\n[\p{IsWhite_Space}&&[^\n]]*", 0))).otherwise(F.length(F.regexp_extract(rest, r"^[\p{IsWhite_Space}&&[^\n]]*", 0)))
    start = F.when(before == 0, position(F.lit(0), F.lit(0))).when(rest == "", position(line, col)).otherwise(place(text, before + skip, F.lit(0), F.lit(0)))
    tail = F.substring(text, at + 1, F.length(text))
    upto = F.length(F.regexp_extract(tail, r"(?s)^[^.!?]*[.!?]", 0))
    end = F.when(upto > 0, at + upto).otherwise(F.length(text))
    blanks = F.length(F.regexp_extract(F.substring(text, end + 1, F.length(text)), r"^[\p{IsWhite_Space}&&[^\n]]*", 0)) if around else F.lit(0)
    return span(start, place(text, end + blanks, F.lit(0), F.lit(0)))


def delimited(lines: Column, line: Column, col: Column, opening: str, around: bool = False) -> Column:
    """Inside (``around``: with) the enclosing pair, over lines; null if a side is missing or the pair is empty.

    Both sides are looked for from the cursor's cell inclusive, each by its own depth.
    """
    closing = dict(PAIRS)[opening]

    def of(pair: Column) -> Column:
        left, right = pair["left"], pair["right"]
        found = left.isNotNull() & right.isNotNull()
        if around:
            return F.when(found, span(left, position(right["line"], right["col"] + 1)))
        empty = (left["line"] == right["line"]) & (right["col"] <= left["col"] + 1)
        return F.when(found & ~empty, span(position(left["line"], left["col"] + 1), right))

    sides = F.struct(opening_before(lines, line, col + 1, opening, closing).alias("left"), closing_after(lines, line, col, opening, closing).alias("right"))
    return let(sides, of)


def quoted(lines: Column, line: Column, col: Column, quote: str = '"', around: bool = False) -> Column:
    """Inside (``around``: with) the pair of quotes on the line that holds the column; null for none or an empty pair.

    Quotes pair up from the line's start: first with second, third with fourth.
    """
    text = F.get(lines, line)
    before = F.length(F.substring(text, F.lit(1), col)) - F.length(F.replace(F.substring(text, F.lit(1), col), F.lit(quote), F.lit("")))
    on_quote = F.substring(text, col + 1, F.lit(1)) == quote
    # a column on a closing quote still belongs to its pair
    pair = F.floor((before - F.when(on_quote & (before % 2 == 1), 1).otherwise(0)) / 2) * 2
    inside = (before % 2 == 1) | on_quote
    pieces = F.split(text, "\\Q" + quote + "\\E", -1)
    start = F.length(F.array_join(F.slice(pieces, 1, (pair + 1).cast("int")), quote))
    end = F.length(F.array_join(F.slice(pieces, 1, (pair + 2).cast("int")), quote))
    closed = F.size(pieces) >= pair + 3
    if around:
        return F.when(inside & closed, _on_line(line, start, end + 1))
    return F.when(inside & closed & (end > start + 1), _on_line(line, start + 1, end))


def extract(lines: Column, start: Column, end: Column, whole_lines: bool = False) -> Column:
    """The text between two positions, end exclusive; ``whole_lines`` takes their lines whole. Either order."""
    swap = (start["line"] > end["line"]) | ((start["line"] == end["line"]) & (start["col"] > end["col"]))
    first, last = F.when(swap, end).otherwise(start), F.when(swap, start).otherwise(end)
    part = F.slice(lines, first["line"] + 1, last["line"] - first["line"] + 1)
    if whole_lines:
        return F.array_join(part, "\n")
    count = last["line"] - first["line"]
    cut = F.transform(
        part,
        lambda x, i: F.substring(
            x, F.when(i == 0, first["col"] + 1).otherwise(1), F.greatest(F.when(i == count, last["col"]).otherwise(F.length(x)) - F.when(i == 0, first["col"]).otherwise(0), F.lit(0))
        ),
    )
    return F.array_join(cut, "\n")


def select_all(lines: Column) -> Column:
    """The whole document as a line-wise span."""
    last = F.size(lines) - 1
    return span(position(F.lit(0), F.lit(0)), position(last, F.length(F.get(lines, last))))


def yank_line(lines: Column, line: Column) -> Column:
    """A line's text; null past the end."""
    return F.get(lines, line)


def yank_word(lines: Column, line: Column, col: Column) -> Column:
    """The run of letters and digits at a column, underscores excluded; null where there is none."""
    text = F.get(lines, line)
    start, end = run_at(text, col, r"[\p{IsAlphabetic}\p{N}]")
    back = F.length(F.regexp_extract(F.substring(text, F.lit(1), col), r"[\p{IsAlphabetic}\p{N}]+$", 0))
    low = col - back
    return F.when((col < F.length(text)) & (end > low), F.substring(text, low + 1, end - low))
