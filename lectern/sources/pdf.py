"""Text of PDF files, page by page: objects, deflated streams, text operators and character maps.

Enough for files that programs write: cross-reference tables are not needed, as objects are found by
their headers, object streams are unpacked, and codes become characters by a font's ToUnicode map or its
base encoding. Scanned pages have no text; encrypted files are refused.
"""

from __future__ import annotations

import re
import zlib

_OBJECT = re.compile(rb"(?<![0-9])(\d{1,10})\s+(\d{1,5})\s+obj\b")
_REF = re.compile(rb"(\d+)\s+\d+\s+R\b")
#: Tokens of a content stream: strings, hex strings, names, numbers, array marks, operators.
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|/[^\s<>\[\]()/%]*|[-+]?\d*\.?\d+|[\[\]]|[A-Za-z'\"*]+[0-9]?|%[^\r\n]*", re.S)
#: Escapes of literal strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class PdfError(ValueError):
    """A file that is no readable PDF."""


def _literal(raw: bytes) -> bytes:
    def put(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", put, raw[1:-1], flags=re.S)


def _hex(raw: bytes) -> bytes:
    digits = re.sub(rb"\s", b"", raw[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode("ascii"))


class _File:
    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise PdfError("not a PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise PdfError("encrypted")
        self.objects: dict[int, bytes] = {}
        found = list(_OBJECT.finditer(data))
        ends = [m.start() for m in found[1:]] + [len(data)]
        for m, end in zip(found, ends, strict=False):
            self.objects[int(m[1])] = data[m.end() : end]
        for body in list(self.objects.values()):
            if b"/ObjStm" in body[:400]:
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        first, content = re.search(rb"/First\s+(\d+)", body), self.stream(body)
        if not first or content is None:
            return
        at = int(first[1])
        heads = [int(x) for x in re.findall(rb"\d+", content[:at])]
        places = heads[1::2] + [len(content) - at]
        for number, low, high in zip(heads[::2], places, places[1:], strict=False):
            self.objects.setdefault(number, content[at + low : at + high])

    def stream(self, body: bytes) -> bytes | None:
        """The decoded stream of an object; None if it has none or an unknown filter."""
        start = re.search(rb"stream\r?\n", body)
        if not start:
            return None
        head, raw = body[: start.start()], body[start.end() :]
        raw = raw[: raw.rfind(b"endstream")] if b"endstream" in raw else raw
        filters = re.findall(rb"/(FlateDecode|ASCIIHexDecode|ASCII85Decode|LZWDecode|DCTDecode|JPXDecode|CCITTFaxDecode|JBIG2Decode|RunLengthDecode)", head)
        for name in filters:
            if name != b"FlateDecode":
                return None
            try:
                raw = zlib.decompressobj().decompress(raw)
            except zlib.error:
                return None
        return raw

    def value(self, body: bytes, name: bytes) -> bytes | None:
        """A dictionary's entry, references followed."""
        m = re.search(rb"/" + name + rb"(?![A-Za-z0-9])\s*", body)
        if not m:
            return None
        rest = body[m.end() :]
        ref = _REF.match(rest)
        return self.objects.get(int(ref[1]), b"") if ref else rest

    def pages(self) -> list[bytes]:
        """Page objects in reading order."""
        root = next((b for b in self.objects.values() if re.search(rb"/Type\s*/Catalog\b", b)), None)
        out, seen = [], set()

        def visit(body: bytes | None, inherited: bytes) -> None:
            if body is None or id(body) in seen:
                return
            seen.add(id(body))
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            resources = body if b"/Resources" in body else inherited
            if kids:
                for ref in _REF.findall(kids[1]):
                    visit(self.objects.get(int(ref)), resources)
            elif re.search(rb"/Type\s*/Page\b", body):
                out.append(body if b"/Resources" in body else body + inherited)

        visit(self.value(root, b"Pages") if root else None, b"")
        return out or [b for _, b in sorted(self.objects.items()) if re.search(rb"/Type\s*/Page\b", b)]

    def content(self, page: bytes) -> bytes:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        bodies = [self.objects.get(int(n), b"") for n in _REF.findall(m[1])] if m else []
        if len(bodies) == 1 and not re.search(rb"stream\r?\n", bodies[0]):
            bodies = [self.objects.get(int(n), b"") for n in _REF.findall(bodies[0])]
        return b"\n".join(self.stream(b) or b"" for b in bodies)

    def fonts(self, page: bytes) -> dict[bytes, tuple[int, dict[int, str]]]:
        """By a font's name its code length in bytes and its map to characters."""
        resources = self.value(page, b"Resources") or b""
        fonts = self.value(resources, b"Font") or b""
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", fonts[: (fonts + b">>").index(b">>")]):
            font = self.objects.get(int(number), b"")
            chart = self.value(font, b"ToUnicode")
            content = self.stream(chart) if chart else None
            out[name] = (2 if b"/Type0" in font else 1, _character_map(content) if content else {})
        return out


def _character_map(content: bytes) -> dict[int, str]:
    text = lambda x: bytes.fromhex(x.decode("ascii")).decode("utf-16-be", "replace")
    out: dict[int, str] = {}
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", content, re.S):
        out |= {int(a, 16): text(b) for a, b in re.findall(rb"<([0-9A-Fa-f]+)>\s*<((?:[0-9A-Fa-f]{4})+)>", block)}
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", content, re.S):
        for low, high, to, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<((?:[0-9A-Fa-f]{4})+)>|\[([^\]]*)\])", block):
            codes = range(int(low, 16), min(int(high, 16), int(low, 16) + 0xFFFF) + 1)
            if many:
                out |= dict(zip(codes, map(text, re.findall(rb"<((?:[0-9A-Fa-f]{4})+)>", many)), strict=False))
            else:
                first = text(to)
                out |= {c: first[:-1] + chr(ord(first[-1]) + k) for k, c in enumerate(codes) if ord(first[-1]) + k < 0x110000}
    return out


def _shown(raw: bytes, font: tuple[int, dict[int, str]]) -> str:
    width, chart = font
    if width == 1 and not chart:
        return raw.decode("cp1252", "replace")
    codes = [int.from_bytes(raw[i : i + width], "big") for i in range(0, len(raw) - width + 1, width)]
    return "".join(chart.get(c, chr(c) if width == 1 else "") for c in codes)


def _page_text(content: bytes, fonts: dict[bytes, tuple[int, dict[int, str]]]) -> str:
    out: list[str] = []
    held: list[bytes] = []
    font, height, array = (1, {}), None, None

    def line() -> None:
        if out and not out[-1].endswith("\n"):
            out.append("\n")

    for token in _TOKEN.findall(content):
        first = token[:1]
        if first == b"[":
            array = []
        elif first == b"]":
            held, array = [*held, b"]"], array
        elif first in b"(<":
            piece = _shown(_literal(token) if first == b"(" else _hex(token), font)
            if array is None:
                held.append(b"(" + piece.encode("utf-8", "replace"))
            else:
                array.append(piece)
        elif first in b"/+-." or first.isdigit():
            if array is None:
                held.append(token)
            elif first != b"/" and float(token) < -180:
                array.append(" ")
        else:
            numbers = [float(x) for x in held if x[:1] in b"+-.0123456789"]
            if token == b"Tf" and held:
                font = fonts.get(next((x[1:] for x in held if x[:1] == b"/"), b""), (1, {}))
            elif token in (b"Td", b"TD") and len(numbers) >= 2:
                if numbers[-1]:
                    line()
                elif numbers[-2] and out and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
            elif token == b"Tm" and len(numbers) >= 6:
                if height is not None and numbers[-1] != height:
                    line()
                height = numbers[-1]
            elif token in (b"T*", b"ET"):
                line()
            elif token == b"TJ" and array is not None:
                out.append("".join(array))
            elif token in (b"Tj", b"'", b'"'):
                if token != b"Tj":
                    line()
                out += [x[1:].decode("utf-8") for x in held if x[:1] == b"("][-1:]
            held, array = [], None
    return "".join(out).strip("\n")


def pdf_text(content: bytes) -> str:
    """The text of a PDF file, pages divided by blank lines. Raises PdfError for files without any."""
    try:
        file = _File(content)
        pages = [_page_text(file.content(p), file.fonts(p)) for p in file.pages()]
    except (LookupError, UnicodeError, RecursionError, OverflowError) as e:
        raise PdfError(f"damaged: {type(e).__name__}: {e}") from e
    text = "\n\n".join(p for p in pages if p.strip())
    if not text:
        raise PdfError("no text in this file")
    return text
