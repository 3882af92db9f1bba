"""Text of PDF files, without a library: pages in order, shown strings through their fonts' Unicode maps.

Objects are read from the file's body and from object streams; streams may be plain or deflated. Text of encrypted
files, of other filters and of fonts without a map or a Latin encoding isn't found: such a file is a failed row.
"""

from __future__ import annotations

import re
import zlib

from .documents import FAILED, OK

_OBJECT = re.compile(rb"(?:^|[\r\n\s])(\d+)\s+(\d+)\s+obj\b")
_STREAM = re.compile(rb"stream\r?\n")
_REF = re.compile(rb"(\d+)\s+\d+\s+R")
_TOKEN = re.compile(rb"\((?:\\.|[^\\()]|\((?:\\.|[^\\()])*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]*|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _string(token: bytes) -> bytes:
    """The bytes of a literal or hexadecimal string."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())

    def plain(m: re.Match) -> bytes:
        x = m[1]
        return bytes([int(x, 8) & 255]) if x[:1].isdigit() else b"" if x in (b"\n", b"\r", b"\r\n") else _ESCAPES.get(x, x)

    return re.sub(rb"\\([0-7]{1,3}|\r\n|.)", plain, token[1:-1], flags=re.S)


class Pdf:
    """The objects of a file by number, as bytes of their dictionaries and streams."""

    def __init__(self, data: bytes):
        if b"%PDF-" not in data[:1024]:
            raise ValueError("no PDF file")
        if re.search(rb"/Encrypt\s+\d+\s+\d+\s+R", data):
            raise ValueError("the file is encrypted")
        self.bodies: dict[int, bytes] = {}
        spots = list(_OBJECT.finditer(data))
        for m, after in zip(spots, [*spots[1:], None]):
            body = data[m.end() : after.start() if after else len(data)]
            self.bodies[int(m[1])] = body[: end] if (end := body.rfind(b"endobj")) >= 0 else body
        for body in list(self.bodies.values()):
            if re.search(rb"/Type\s*/ObjStm", body[:400]):
                self._unpack(body)

    def _unpack(self, body: bytes) -> None:
        content, head = self.stream(body), body[: body.find(b"stream")]
        first = int(re.search(rb"/First\s+(\d+)", head)[1])
        numbers = list(map(int, content[:first].split()))
        pairs = list(zip(numbers[::2], numbers[1::2]))
        for (number, start), end in zip(pairs, [s for _, s in pairs[1:]] + [len(content) - first]):
            self.bodies.setdefault(number, content[first + start : first + end])

    def stream(self, body: bytes) -> bytes:
        m = _STREAM.search(body)
        if not m:
            return b""
        head, raw = body[: m.start()], body[m.end() : body.rfind(b"endstream")]
        if b"/FlateDecode" in head:
            return zlib.decompressobj().decompress(raw)
        if b"/Filter" in head:
            raise ValueError("a stream has another filter than FlateDecode")
        return raw

    def _under(self, body: bytes, key: bytes) -> bytes:
        """A dictionary's value: the object it refers to, or what stands there."""
        m = re.search(rb"/" + key + rb"(?![A-Za-z])\s*(?:(\d+)\s+\d+\s+R|(\[[^\]]*\]|<<.*))", body, re.S)
        return b"" if not m else self.bodies.get(int(m[1]), b"") if m[1] else m[2]

    def pages(self) -> list[bytes]:
        """Page dictionaries in the order of the page tree; in the order of numbers where there is no tree."""
        catalog = next((b for b in self.bodies.values() if re.search(rb"/Type\s*/Catalog", b)), b"")
        out: list[bytes] = []
        todo, seen = [(self._under(catalog, b"Pages"), b"")], set()
        while todo:
            body, above = todo.pop()
            if not body or id(body) in seen:
                continue
            seen.add(id(body))
            resources = body if b"/Resources" in body else above
            if re.search(rb"/Kids", body):
                kids = [self.bodies.get(int(n), b"") for n in _REF.findall(self._under(body, b"Kids"))]
                todo += [(kid, resources) for kid in reversed(kids)]
            elif re.search(rb"/Type\s*/Page(?!s)", body):
                out.append(body + resources)
        return out or [b for _, b in sorted(self.bodies.items()) if re.search(rb"/Type\s*/Page(?!s)", b)]

    def fonts(self, page: bytes) -> dict[bytes, dict[int, str] | None]:
        """The page's fonts by name: a map from codes to texts, or None for Latin ones."""
        named = self._under(self._under(page, b"Resources") or page, b"Font")
        out = {}
        for name, number in re.findall(rb"/([^\s/<>\[\]()]+)\s+(\d+)\s+\d+\s+R", named.split(b">>")[0]):
            given = self._under(self.bodies.get(int(number), b""), b"ToUnicode")
            out[b"/" + name] = _unicode_map(self.stream(given)) if given else None
        return out

    def text(self, page: bytes) -> str:
        m = re.search(rb"/Contents\s*(\[[^\]]*\]|\d+\s+\d+\s+R)", page)
        content = b"\n".join(self.stream(self.bodies.get(int(n), b"")) for n in _REF.findall(m[1])) if m else b""
        fonts, font = self.fonts(page), None
        out, waiting = [], []
        for token in _TOKEN.findall(content):
            if token[:1] in b"(<[/" or token == b"]" or token[:1] in b"+-.0123456789":
                waiting.append(token)
                continue
            if token == b"Tf" and len(waiting) >= 2:
                font = fonts.get(waiting[-2])
            elif token in (b"Tj", b"'", b'"', b"TJ"):
                out += ["\n"] * (token in (b"'", b'"'))
                for x in waiting:
                    if x[:1] in b"(<":
                        out.append(_shown(_string(x), font))
                    elif token == b"TJ" and x[:1] == b"-" and float(x) < -200:
                        out.append(" ")
            elif token in (b"Td", b"TD", b"T*", b"Tm", b"ET"):
                out.append("\n")
            waiting = []
        return "".join(out)


def _unicode_map(cmap: bytes) -> dict[int, str]:
    """Codes and their texts from a ToUnicode map's bfchar and bfrange lines; the codes' width is kept under -1."""
    text = lambda h: bytes.fromhex(h.decode()).decode("utf-16-be", "replace")
    out: dict = {}
    width = re.search(rb"begincodespacerange\s*<([0-9A-Fa-f]+)>", cmap)
    out[-1] = len(width[1]) // 2 if width else 1
    for block in re.findall(rb"beginbfchar(.*?)endbfchar", cmap, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", block):
            out[int(code, 16)] = text(to)
    for block in re.findall(rb"beginbfrange(.*?)endbfrange", cmap, re.S):
        for low, high, to, several in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[([^\]]*)\])", block):
            codes = range(int(low, 16), min(int(high, 16), int(low, 16) + 65_535) + 1)
            if to:
                out.update({c: text(to)[:-1] + chr(ord(text(to)[-1]) + k) for k, c in enumerate(codes)})
            else:
                out.update({c: text(x) for c, x in zip(codes, re.findall(rb"<([0-9A-Fa-f]+)>", several))})
    return out


def _shown(raw: bytes, font: dict | None) -> str:
    if font is None:
        return raw.decode("cp1252", "replace")
    width = font[-1]
    return "".join(font.get(int.from_bytes(raw[k : k + width], "big"), "") for k in range(0, len(raw), width))


def pdf(data: bytes) -> tuple[str, str, str | None]:
    """(status, text, error) of a PDF file, for documents.extract(): all pages' text, white space as single spaces."""
    try:
        file = Pdf(data)
        text = " ".join("\n".join(file.text(p) for p in file.pages()).split())
    except (ValueError, TypeError, IndexError, zlib.error) as e:
        return FAILED, f"[ERROR] {e}", str(e)
    return (OK, text, None) if text else (FAILED, "[ERROR] no text", "no text")
