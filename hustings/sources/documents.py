"""Binary documents: HWP 5 compound files, and others by a pluggable extractor, with failures kept as rows."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.functions import text as tx
from hustings.plans.session import ship

# Fixed values of the formats: compound file signature and special sectors, record tag of text, control characters.
SIGNATURE = bytes.fromhex("D0CF11E0A1B11AE1")
FREE, END = 0xFFFFFFFF, 0xFFFFFFFE
PARA_TEXT = 67
CHARACTERS = {10: "\n", 13: "\n", 24: "-", 30: " ", 31: " "}
WIDE_CONTROLS = frozenset((*range(1, 10), 11, 12, *range(14, 24)))
OK, PARTIAL, FAILED = "성공", "부분성공", "실패"


class Compound:
    """A compound file: its streams by path."""

    def __init__(self, data: bytes):
        if data[:8] != SIGNATURE:
            raise ValueError("not a compound file")
        self.data = data
        shift, small_shift = struct.unpack_from("<HH", data, 30)
        self.sector, self.small = 1 << shift, 1 << small_shift
        n_fat, first_dir, _, self.cutoff, first_mini, _, first_difat, _ = struct.unpack_from("<I I I I I I I I", data, 44)
        difat = list(struct.unpack_from("<109I", data, 76))
        seen = set()
        while first_difat < END and first_difat not in seen:
            seen.add(first_difat)
            more = struct.unpack_from(f"<{self.sector // 4}I", data, (first_difat + 1) * self.sector)
            difat += more[:-1]
            first_difat = more[-1]
        self.fat: list[int] = []
        for s in [s for s in difat if s < END][:n_fat]:
            self.fat += struct.unpack_from(f"<{self.sector // 4}I", data, (s + 1) * self.sector)
        mini = self._chain(first_mini)
        self.mini_fat = list(struct.unpack(f"<{len(mini) // 4}I", mini))
        raw = self._chain(first_dir)
        self.entries = [self._entry(raw[i : i + 128]) for i in range(0, len(raw) - 127, 128)]
        self.pool = self._chain(self.entries[0][5]) if self.entries else b""

    @staticmethod
    def _entry(e: bytes) -> tuple:
        size = struct.unpack_from("<H", e, 64)[0]
        left, right, child = struct.unpack_from("<III", e, 68)
        start, length = struct.unpack_from("<IQ", e, 116)
        return e[: max(0, size - 2)].decode("utf-16-le", "replace"), e[66], left, right, child, start, length

    def _chain(self, at: int) -> bytes:
        out, seen = [], set()
        while at < END and at not in seen and at < max(len(self.fat), 1):
            seen.add(at)
            out.append(self.data[(at + 1) * self.sector : (at + 2) * self.sector])
            at = self.fat[at]
        return b"".join(out)

    def streams(self) -> dict[str, bytes]:
        out: dict[str, bytes] = {}
        todo = [(self.entries[0][4], "")] if self.entries else []
        seen = set()
        while todo:
            k, path = todo.pop()
            if k >= len(self.entries) or k in seen:
                continue
            seen.add(k)
            name, kind, left, right, child, start, length = self.entries[k]
            todo += [(left, path), (right, path)]
            if kind == 1:
                todo.append((child, f"{path}{name}/"))
            elif kind == 2:
                out[path + name] = self._read(start, length)
        return out

    def _read(self, start: int, length: int) -> bytes:
        if length >= self.cutoff:
            return self._chain(start)[:length]
        out, at, seen = [], start, set()
        while at < END and at not in seen and at < len(self.mini_fat):
            seen.add(at)
            out.append(self.pool[at * self.small : (at + 1) * self.small])
            at = self.mini_fat[at]
        return b"".join(out)[:length]


def paragraph_text(data: bytes) -> str:
    """The text of a paragraph record: UTF-16 units, controls of one or eight units."""
    units = struct.unpack(f"<{len(data) // 2}H", data[: len(data) // 2 * 2])
    out, k = [], 0
    while k < len(units):
        u = units[k]
        if u >= 32:
            out.append(struct.pack("<H", u))
        elif u in CHARACTERS:
            out.append(CHARACTERS[u].encode("utf-16-le"))
        if u in WIDE_CONTROLS:
            if u == 9:
                out.append("\t".encode("utf-16-le"))
            k += 8
        else:
            k += 1
    return b"".join(out).decode("utf-16-le", "replace")


def section_text(data: bytes) -> tuple[str, str | None]:
    """(text, error) of a section's records; what came before damage is kept."""
    at, out = 0, []
    while at < len(data):
        if at + 4 > len(data):
            return "\n".join(out), "truncated header"
        (head,) = struct.unpack_from("<I", data, at)
        at += 4
        size = head >> 20
        if size == 0xFFF:
            if at + 4 > len(data):
                return "\n".join(out), "truncated size"
            (size,) = struct.unpack_from("<I", data, at)
            at += 4
        body = data[at : at + size]
        if head & 0x3FF == PARA_TEXT:
            out.append(paragraph_text(body))
        if len(body) < size:
            return "\n".join(out), "truncated record"
        at += size
    return "\n".join(out), None


def inflate(data: bytes) -> bytes:
    """A raw deflate stream, or a zlib one."""
    try:
        return zlib.decompress(data, -15)
    except zlib.error:
        return zlib.decompress(data)


def hwp(data: bytes) -> tuple[str, str, str | None]:
    """(status, text, error) of an HWP 5 document."""
    try:
        streams = Compound(data).streams()
        packed = bool(streams["FileHeader"][36] & 1)
        names = sorted((n for n in streams if n.startswith("BodyText/Section")), key=lambda n: int(n.removeprefix("BodyText/Section")))
    except (ValueError, KeyError, IndexError, struct.error) as e:
        return FAILED, "", f"{type(e).__name__}: {e}"
    parts, errors = [], []
    for name in names:
        try:
            text, error = section_text(inflate(streams[name]) if packed else streams[name])
        except (zlib.error, struct.error) as e:
            text, error = "", str(e)
        parts.append(text)
        if error:
            errors.append(f"{name}: {error}")
    text = "\n".join(p for p in parts if p)
    if not text:
        return FAILED, "", "; ".join(errors) or "no text"
    return (PARTIAL if errors else OK), text, "; ".join(errors) or None


def extract(files: DataFrame, extractor: Callable[[bytes], tuple[str, str, str | None]] = hwp) -> DataFrame:
    """(FileName, Title, Date, Status, Content, Error) of binaryFile rows, batch or stream. A file that fails is a row
    too; extractors of other formats, such as PDF, are passed in."""
    ship(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for data in b.column("content").to_pylist():
                try:
                    got.append(extractor(data or b""))
                except Exception as e:  # a damaged document must not stop the others
                    got.append((FAILED, "", f"{type(e).__name__}: {e}"))
            cols = [pa.array([g[k] for g in got], pa.string()) for k in range(3)]
            yield pa.RecordBatch.from_arrays([b.column("path"), *cols], names=["path", "Status", "raw", "Error"])

    out = files.select("path", "content").mapInArrow(run, "path string, Status string, raw string, Error string")
    name = F.element_at(F.split("path", "/"), -1)
    title, date = tx.file_title_date(name)
    return out.select(name.alias("FileName"), title.alias("Title"), date.alias("Date"), "Status", tx.paragraph(F.col("raw")).alias("Content"), "Error")
