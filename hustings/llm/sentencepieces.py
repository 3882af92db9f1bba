"""SentencePiece encoding and decoding on the tokenizers library.

The model's protobuf is parsed here; normaliser, word mark, scores and byte fallback are rebuilt as a Tokenizer:
a Unigram model from the scores of a unigram file, a BPE model with merges in order of score from a BPE file. Parity
with the sentencepiece library is verified on probe texts when a model is loaded, and with verify_all on every text.
"""

from __future__ import annotations

import hashlib
import json
import os
import struct
import zlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .chunkmemo import ChunkMemo

MARK = "▁"
#: Fixed values of the format: model types, piece types, normalisers of byte-exact texts.
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Texts on which a rebuilt model must agree with the library.
PROBES = ("", " ", "a", "Hello world", " two  spaces ", "tab\tand\nline", "naïve Ünïcode ﬁ ①", "日本語 текст", "emoji 🙂 and \x00 nul", "12,345.67 (x)", "▁ mark", "<s> </s> <unk> <0x41>")


@dataclass
class Spec:
    """What a model file says."""

    pieces: list[tuple[str, float, int]] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    unk_id: int = 0
    charsmap: bytes = b""
    add_prefix: bool = True
    shrink_spaces: bool = True
    escape_spaces: bool = True


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protobuf message's fields."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(data):
        key = varint()
        wire = key & 7
        if wire == 0:
            yield key >> 3, varint()
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            yield key >> 3, data[at : at + n]
            at += n
        elif wire == 2:
            n = varint()
            yield key >> 3, data[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {wire}")


def parse(data: bytes) -> Spec:
    """The pieces, trainer settings and normaliser settings of a model file."""
    spec = Spec()
    for number, value in _fields(data):
        if number == 1:
            text, score, kind = "", 0.0, NORMAL
            for k, v in _fields(value):
                if k == 1:
                    text = v.decode()
                elif k == 2:
                    (score,) = struct.unpack("<f", v)
                elif k == 3:
                    kind = v
            spec.pieces.append((text, score, kind))
        elif number == 2:
            for k, v in _fields(value):
                if k == 3:
                    spec.kind = v
                elif k == 35:
                    spec.byte_fallback = bool(v)
                elif k == 40:
                    spec.unk_id = v
        elif number == 3:
            for k, v in _fields(value):
                if k == 2:
                    spec.charsmap = v
                elif k == 3:
                    spec.add_prefix = bool(v)
                elif k == 4:
                    spec.shrink_spaces = bool(v)
                elif k == 5:
                    spec.escape_spaces = bool(v)
    return spec


def merges_of(pieces: Sequence[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The pairs that make each piece out of two, in order of the pieces' scores."""
    score = {p: s for p, s, t in pieces if t in (NORMAL, USER)}
    order = {p: k for k, (p, _, _) in enumerate(pieces)}
    made = []
    for piece, s in score.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in score and right in score:
                made.append((-s, order[left], order[right], left, right))
    return [m[3:] for m in sorted(made)]


def build(spec: Spec):
    """A Tokenizer that encodes and decodes as the model file says."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

    vocab = [(p, s) for p, s, _ in spec.pieces]
    if spec.kind == UNIGRAM:
        tokenizer = Tokenizer(models.Unigram(vocab, spec.unk_id, spec.byte_fallback))
    elif spec.kind == BPE:
        tokenizer = Tokenizer(models.BPE({p: k for k, (p, _) in enumerate(vocab)}, merges_of(spec.pieces), unk_token=vocab[spec.unk_id][0], fuse_unk=True, byte_fallback=spec.byte_fallback))
    else:
        raise ValueError(f"model type {spec.kind} has no counterpart")
    steps = [normalizers.Precompiled(spec.charsmap)] if spec.charsmap else []
    if spec.shrink_spaces:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if spec.add_prefix:
        steps.append(normalizers.Prepend(MARK if spec.escape_spaces else " "))
    if spec.escape_spaces:
        steps.append(normalizers.Replace(" ", MARK))
    tokenizer.normalizer = normalizers.Sequence(steps)
    # No piece has a mark after another character, so no merge crosses the start of a run of marks.
    if spec.escape_spaces and not any(MARK in p.lstrip(MARK) for p, _, t in spec.pieces if t in (NORMAL, USER)):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(f"{MARK}+[^{MARK}]*"), "isolated")
    tail = [decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()]
    tokenizer.decoder = decoders.Sequence(tail + ([decoders.Strip(" ", 1, 0)] if spec.add_prefix else []))
    return tokenizer


class Codec(ChunkMemo):
    """Encodes and decodes batches of texts in `threads` threads.

    Where no piece joins a mark to a character before it, a word with the space before it encodes alone, so words'
    ids are kept; else, and for texts that begin with a space or hold the mark itself, texts are encoded whole.
    """

    def __init__(self, path: str, threads: int = 2, most_chunks: int = 500_000):
        os.environ["RAYON_NUM_THREADS"] = str(threads)
        os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
        super().__init__(most_chunks)
        self.library = None
        with open(path, "rb") as f:
            self.spec = parse(f.read())
        self.tokenizer = build(self.spec)
        spec = self.spec
        self.by_words = self.tokenizer.pre_tokenizer is not None and spec.add_prefix and not spec.shrink_spaces and not spec.charsmap
        self.marked = np.array([p.startswith(MARK) for p, _, _ in spec.pieces])
        self.verify(path)

    def split(self, raw: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A chunk starts with its text and with the first of each run of spaces."""
        size = np.diff(offs)
        first = np.zeros(len(raw) + 1, bool)
        first[offs] = True
        first = first[:-1]
        space = raw == 32
        odd = space & first
        odd[2:] |= (raw[:-2] == 0xE2) & (raw[1:-1] == 0x96) & (raw[2:] == 0x81)
        before = np.concatenate([[0], np.cumsum(odd)])
        plain = (before[offs[1:]] == before[offs[:-1]]) & (size > 0) & self.by_words
        start = first | space
        start[1:] &= ~(space[1:] & space[:-1])
        return plain, np.flatnonzero(start & np.repeat(plain, size))

    def whole(self, texts: list[str]) -> list[np.ndarray]:
        """Encoded so many at a time, as an encoding holds far more than its ids."""
        parts = (texts[k : k + 512] for k in range(0, len(texts), 512))
        return [np.array(e.ids, np.uint32) for part in parts for e in self.tokenizer.encode_batch_fast(part, add_special_tokens=False)]

    def chunks(self, found: list[bytes], block: int = 1024) -> list[np.ndarray]:
        """Words of one space are encoded together and told apart by their first ids' marks, the others one by one."""
        words = [c[1:] if c[0] == 32 else c for c in found]
        simple = [k for k, w in enumerate(words) if w and b" " not in w]
        rest = [k for k, w in enumerate(words) if not w or b" " in w]
        parts = [simple[i : i + block] for i in range(0, len(simple), block)]
        out: list = [None] * len(found)
        for part, ids in zip(parts, self.whole([b" ".join([words[k] for k in p]).decode() for p in parts])):
            starts = [0, *np.flatnonzero(self.marked[ids])[1:].tolist()]
            for k, start, end in zip(part, starts, [*starts[1:], len(ids)]):
                out[k] = ids[start:end]
        # A chunk of spaces alone keeps them all: the mark before a text stands for the first.
        for k, x in zip(rest, self.whole([words[k].decode() for k in rest])):
            out[k] = x if words[k] else np.array([self._mark_id()], np.uint32)
        return out

    def _mark_id(self) -> int:
        return self.tokenizer.token_to_id(MARK)

    def verify(self, path: str, texts: Sequence[str] = PROBES) -> None:
        """ValueError where ids or decoded texts differ from the sentencepiece library's."""
        own = self.encode(texts)
        self.compare(path, texts, own, self.decode(own))

    def compare(self, path: str, texts: Sequence[str], own: Sequence[Sequence[int]], decoded: Sequence[str]) -> None:
        """ValueError where ids or decoded texts of texts differ from the sentencepiece library's."""
        import sentencepiece

        if self.library is None:
            self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        for text, ids, back in zip(texts, own, decoded):
            if list(ids) != (want := self.library.encode(text)):
                raise ValueError(f"ids differ from the library's on {text!r}: {ids} {want}")
            if back != (want := self.library.decode(list(ids))):
                raise ValueError(f"decoded text differs from the library's on {text!r}: {back!r} {want!r}")

    def encode(self, texts: Sequence[str]) -> list[list[int]]:
        return [x.tolist() for x in self(*common.text_buffers(pa.array(list(texts), pa.string())))]

    def decode(self, ids: Sequence[Sequence[int]]) -> list[str]:
        return self.tokenizer.decode_batch([list(x) for x in ids], skip_special_tokens=False)


_kept: dict[tuple, Codec] = {}


def codec(path: str, threads: int) -> Codec:
    """This worker's codec of a file, verified once."""
    if (path, threads) not in _kept:
        _kept[path, threads] = Codec(path, threads)
    return _kept[path, threads]


def encode(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", threads: int = 2, batch_bytes: int = 1 << 20, verify_all: bool = False) -> DataFrame:
    """(id, n_tokens, ids, ids_crc32, decoded_sha256, round_trip) for every row, from the whole text.

    With verify_all each text is encoded and decoded by the sentencepiece library too, and a difference is an error.

    round_trip tells whether decoding the ids gives the text back. A null or empty text has no ids and decodes to
    the empty text. Repeated rows and null ids are encoded like any; other columns aren't read. No shuffle.
    """
    common.session(docs.sparkSession)
    base = docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = base.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, threads)
        for whole in batches:
            for b in common.pieces(whole, "t", batch_bytes):
                texts = common.texts(b.column("t"))
                found = c(*common.text_buffers(b.column("t")))
                raw = [x.astype("<u4", copy=False).tobytes() for x in found]
                ids = [x.tolist() for x in found]
                back = c.decode(ids)
                if verify_all:
                    c.compare(model, texts, ids, back)
                cols = [b.column("i"), pa.array([len(x) for x in ids], pa.int64()), pa.array(found, pa.list_(pa.int32())), pa.array([zlib.crc32(x) for x in raw], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back]), pa.array([x == y for x, y in zip(texts, back)])]
                yield pa.RecordBatch.from_arrays(cols, names=["i", "n_tokens", "ids", "ids_crc32", "decoded_sha256", "round_trip"])

    return base.mapInArrow(run, f"i {kind}, n_tokens long, ids array<int>, ids_crc32 long, decoded_sha256 string, round_trip boolean").withColumnRenamed("i", id_col)


def decode(table: DataFrame, model: str, id_col: str = "doc_id", ids_col: str = "ids", threads: int = 2) -> DataFrame:
    """(id, text): the texts of id lists; a null list gives an empty text."""
    common.session(table.sparkSession)
    base = table.select(F.col(id_col).alias("i"), F.col(ids_col).cast("array<int>").alias("x"))
    kind = base.schema["i"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model, threads)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("i"), pa.array(c.decode([x or [] for x in b.column("x").to_pylist()]), pa.string())], names=["i", "text"])

    return base.mapInArrow(run, f"i {kind}, text string").withColumnRenamed("i", id_col)
