"""Packing: tokenizers ids cut into pieces and placed online by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .chunkmemo import ChunkMemo

#: Sequences of one task are numbered from its partition number times this.
TASK_SPAN = 1 << 36


#: Byte classes: letters, digits, marks, the apostrophe, white space, control bytes. A lead byte of U+00C0 to U+017F counts as a letter.
_LETTER, _DIGIT, _MARK, _APOSTROPHE, _SPACE, _OTHER = range(6)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[33:127] = _MARK
_CLASS[48:58] = _DIGIT
_CLASS[[*range(65, 91), *range(97, 123), *range(0x80, 0xC0), 0xC3, 0xC4, 0xC5]] = _LETTER
_CLASS[39], _CLASS[32], _CLASS[10] = _APOSTROPHE, _SPACE, _SPACE
_kept: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a file, kept with its memo from task to task."""
    if path not in _kept:
        _kept[path] = Encoder(path)
    return _kept[path]


def breaks(raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(plain, starts): which texts are plain, and where chunks start in them, by arrays over all bytes.

    A byte-level tokenizer's own splitting always breaks between letters, digits, marks and line ends, and before a
    space, if each white space is a single space or line end between other characters. So a chunk encodes alone as
    it does inside its text. Apostrophes stay with their neighbours. Texts that aren't plain have no chunks.
    """
    n = len(raw)
    kind = _CLASS[raw]
    first = np.zeros(n + 1, bool)
    first[offs] = True
    space = kind == _SPACE
    odd = kind == _OTHER
    # Two white spaces together, white space at an end of a text, the signs between U+00C0 and U+00FF.
    odd[1:] |= space[1:] & (space[:-1] | first[1:n]) | (raw[:-1] == 0xC3) & ((raw[1:] == 0x97) | (raw[1:] == 0xB7))
    odd[0] |= space[0]
    odd |= space & first[1:]
    before = np.concatenate([[0], np.cumsum(odd)])
    size = np.diff(offs)
    plain = (before[offs[1:]] == before[offs[:-1]]) & (size > 0)
    start = first[:n].copy()
    line = raw == 10
    start |= space
    start[1:] |= line[:-1]
    start[1:] |= (kind[1:] != kind[:-1]) & ~space[1:] & ~space[:-1] & (kind[1:] != _APOSTROPHE) & (kind[:-1] != _APOSTROPHE)
    start &= np.repeat(plain, size)
    return plain, np.flatnonzero(start)


class Encoder(ChunkMemo):
    """Texts to ids by a byte-level tokenizer file."""

    def __init__(self, path: str, most_chunks: int = 500_000):
        from tokenizers import Tokenizer

        super().__init__(most_chunks)
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        words = self.tokenizer.get_vocab(with_added_tokens=True)
        #: Bytes that each id stands for: a byte-level vocabulary writes one character for a byte.
        self.bytes = np.zeros(max(words.values()) + 1, np.int64)
        for word, i in words.items():
            self.bytes[i] = len(word)

    def split(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return breaks(raw, offs)

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Encoded so many at a time, as an encoding holds far more than its ids."""
        parts = (texts[k : k + 512] for k in range(0, len(texts), 512))
        return [np.array(e.ids, np.uint32) for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def chunks(self, found: list[bytes], block: int = 1024) -> list[np.ndarray]:
        """Space-led chunks are encoded end to end and told apart by their ids' bytes, the others one by one."""
        led = [k for k, c in enumerate(found) if c[0] == 32]
        rest = [k for k, c in enumerate(found) if c[0] != 32]
        parts = [led[i : i + block] for i in range(0, len(led), block)]
        out: list = [None] * len(found)
        joined = (self.whole([b"".join([found[k] for k in p]).decode()])[0] for p in parts)
        for part, ids in zip(parts, joined):
            ends = (np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(found[k]) for k in part])) + 1).tolist()
            for k, start, end in zip(part, [0, *ends], ends):
                out[k] = ids[start:end]
        for k, x in zip(rest, self.whole([found[k].decode() for k in rest])):
            out[k] = x
        return out


class SumOfSquares:
    """Online packing into windows of `size`: a piece goes to the fill level that makes the sum over levels of
    squared counts of partially filled windows least (a new window counts as level 0; ties take the fullest).

    Levels are an array of stacks of open windows; `count` is the level array. With most_open windows open none is
    opened: the document is cut to fill the level whose leaving lowers the sum most, and its rest is placed anew. So
    memory is bounded by most_open windows whatever the input.
    """

    def __init__(self, size: int, most_open: int):
        self.size, self.most = size, most_open
        self.count = np.zeros(size + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(size)]
        self.made = self.now_open = 0

    def new(self) -> int:
        self.made += 1
        return self.made - 1

    def _level(self, length: int) -> int:
        """The level that the rule takes for 1 to size - 1 ids; 0 for a new window."""
        size, count = self.size, self.count
        # Moving a window from level h to level h + length changes the sum by 2 (N[h + length] - N[h] + 1); a full one leaves.
        change = count[length:size] - count[: size - length] + 1
        change[0] = count[length]
        change = change * 2
        change[0] += 1
        change[1:][count[1 : size - length] == 0] = np.iinfo(np.int64).max
        best, full = size - length - 1 - int(np.argmin(change[::-1])), size - length
        if count[full] and 1 - 2 * int(count[full]) <= int(change[best]):
            return full
        if best or self.now_open < self.most:
            return best
        # No window may be opened: one whose room is too small is filled, or if there is none, the best of the others.
        small = count[full + 1 : size]
        if small.any():
            return size - 1 - int(np.argmax(small[::-1]))
        change[0] = np.iinfo(np.int64).max
        return full if count[full] else size - length - 1 - int(np.argmin(change[::-1]))

    def place(self, length: int) -> tuple[int, int, int]:
        """(window, offset, ids taken) for a document's next 1 to size ids; the rest is to be placed again."""
        size = self.size
        if length == size:
            return self.new(), 0, size
        best = self._level(length)
        taken = min(length, size - best)
        window = self.open[best].pop() if best else self.new()
        if best:
            self.count[best] -= 1
            self.now_open -= 1
        if best + taken < size:
            self.open[best + taken].append(window)
            self.count[best + taken] += 1
            self.now_open += 1
        return window, best, taken


def _powers(n: int) -> list[int]:
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def pack(docs: DataFrame, tokenizer: str, size: int = 2048, end_id: int = 1, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = 1 << 19, most_open: int = 16) -> DataFrame:
    """One row per piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Each task packs what it reads, in order, as it comes: whole windows are cut from long documents, the rest of
    a document is placed by the sum-of-squares rule, cut only where most_open windows are open. At its end a task
    lays the pieces of its last windows, most_open at most, end to end, the last of them as powers of two: nothing is
    padded. No row leaves its task, so there is no shuffle and no key to be hot. A null or empty text has the end id
    alone. Repeated rows are packed each; null ids are kept. Other columns aren't read. A task that is run again
    makes the same rows, as it reads the same rows in the same order.
    """
    common.session(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = base.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, packer = encoder(tokenizer), SumOfSquares(size, most_open)
        task = TaskContext.get().partitionId() * TASK_SPAN
        end = np.array([end_id], "<u4").tobytes()
        late: dict[int, list] = {}
        types = [pa.int64()] * 6
        kinds: list[pa.DataType] = []

        def rows(out: list) -> pa.RecordBatch:
            ids = pa.array([r[0] for r in out], kinds[0])
            nums = [pa.array([r[k] for r in out], t) for k, t in enumerate(types, 1)]
            return pa.RecordBatch.from_arrays([ids, *nums], names=["i", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def piece(i, ids: bytes, start: int, total: int, window: int, offset: int) -> tuple:
            return i, start, len(ids) // 4, zlib.crc32(ids), total, task + window, offset

        for whole in batches:
            kinds = kinds or [whole.column(0).type]
            for b in common.pieces(whole, "t", batch_bytes):
                out = []
                for i, found in zip(b.column("i").to_pylist(), encode(*common.text_buffers(b.column("t")))):
                    ids = found.astype("<u4", copy=False).tobytes() + end
                    total, start = len(ids) // 4, 0
                    while start < total:
                        window, offset, taken = packer.place(min(size, total - start))
                        held = late.setdefault(window, [])
                        held.append((i, ids[4 * start : 4 * (start + taken)], start, total, offset))
                        start += taken
                        if offset + taken == size:
                            out += [piece(a, p, s, t, window, o) for a, p, s, t, o in late.pop(window)]
                yield rows(out)
        # The windows still open: those filled to a power of two stay; the others' pieces are laid end to end.
        out, loose = [], []
        for window, held in late.items():
            fill = held[-1][4] + len(held[-1][1]) // 4
            if fill & (fill - 1) == 0:
                out += [piece(a, p, s, t, window, o) for a, p, s, t, o in held]
            else:
                loose += held
        left = sum(len(h[1]) // 4 for h in loose)
        rooms = [size] * (left // size) + _powers(left % size)
        at, room, window = 0, 0, 0
        rooms.reverse()
        for i, part, start, total, _ in loose:
            while part:
                if room == at:
                    room, at, window = rooms.pop(), 0, packer.new()
                take = part[: 4 * (room - at)]
                out.append(piece(i, take, start, total, window, at))
                at += len(take) // 4
                start += len(take) // 4
                part = part[len(take) :]
        if out:
            yield rows(out)

    schema = f"i {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    return base.mapInArrow(run, schema).withColumnRenamed("i", id_col)
