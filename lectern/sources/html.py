"""HTML to text: a pattern chain that stays in the JVM, and a tolerant parser for ill-formed pages."""

from __future__ import annotations

from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Tags that end a line, tags whose content is no text.
BLOCKS = ("br", "p", "div", "li", "h1", "h2", "h3", "h4", "h5", "h6", "tr", "blockquote", "section", "aside", "article", "ul", "ol", "table", "header", "footer", "pre", "hr")
HIDDEN = ("script", "style", "template", "noscript", "title")
#: Tags that a page's head may hold; any other one ends it, closed or not.
IN_HEAD = ("html", "head", "title", "meta", "link", "base", "script", "style", "template", "noscript")


def strip_tags(html: Column) -> Column:
    """Comments, scripts, styles and tags removed, block ends as line feeds, the basic entities decoded."""
    steps = (
        (r"(?is)<!--.*?-->", ""), (r"(?is)<script\b.*?</script\s*>", ""), (r"(?is)<style\b.*?</style\s*>", ""),
        # a head that is never closed ends where the body begins
        (r"(?i)<body\b", "</head><body"), (r"(?is)<head\b.*?</head\s*>", ""),
        (r"(?i)<(br|/p|/div|/li|/h[1-6]|/tr|/blockquote)\b[^>]*>", "\n"), (r"<[^>]*>", ""), ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&"),
    )
    for pattern, to in steps:
        html = F.regexp_replace(html, pattern, to)
    return F.regexp_replace(html, r"^[ \n]+|[ \n]+$", "")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts: list[str] = []
        self.hidden = 0
        self.head = False

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self.head = tag == "head" or (self.head and tag in IN_HEAD)
        if tag in HIDDEN:
            self.hidden += 1
        elif tag == "li":
            self.parts.append("\n* ")
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_endtag(self, tag: str) -> None:
        self.head = self.head and tag != "head"
        if tag in HIDDEN:
            self.hidden = max(0, self.hidden - 1)
        elif tag in BLOCKS:
            self.parts.append("\n")

    def handle_data(self, data: str) -> None:
        if not self.hidden and not self.head:
            self.parts.append(" ".join(data.split()) and (" " * data[:1].isspace() + " ".join(data.split()) + " " * data[-1:].isspace()) or " ")


def to_text(html: str | None, width: int | None = None) -> str | None:
    """The text of a page, one line per block, wrapped at ``width`` if given; unclosed tags do no harm."""
    if html is None:
        return None
    parser = _Text()
    parser.feed(html)
    parser.close()
    lines = (" ".join(x.split()) for x in "".join(parser.parts).split("\n"))
    return "\n".join(part for x in lines if x for part in _wrapped(x, width))


def _wrapped(line: str, width: int | None) -> Iterator[str]:
    if width is None or len(line) <= width:
        yield line
        return
    now = ""
    for word in line.split():
        if now and len(now) + 1 + len(word) > width:
            yield now
            now = word
        else:
            now = f"{now} {word}" if now else word
    yield now


@F.pandas_udf(T.StringType())
def _parse(pages: pd.Series) -> pd.Series:
    return pd.Series([to_text(x if isinstance(x, str) else None) for x in pages], dtype=object)


def html_text(html: Column) -> Column:
    """Text by the parser, as an Arrow-batched function."""
    return _parse(html)
