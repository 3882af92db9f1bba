"""Media columns: payloads in archives of lossless 8-bit images, read by a custom Spark data source.

An archive is a tar file whose members are PNG images of 8-bit grey samples, 64 to a row, beside an index of
member offsets. The source plans byte ranges over the archives of a folder; a task reads the members that begin
in its range, in batches through Arrow, and tries each member again by its offset when reading or decoding it
fails. Files go through pyarrow's file systems, so the folder may be in any store that Spark's executors share.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from . import common

WIDTH = 64
#: The PNG signature and the header fields for 8-bit grey, no interlace.
_SIGNATURE, _GREY8 = b"\x89PNG\r\n\x1a\n", bytes([8, 0, 0, 0, 0])


def padded(data: bytes) -> bytes:
    """data with bytes 0 up to a positive multiple of WIDTH."""
    return data + bytes(max(WIDTH - len(data), -len(data) % WIDTH))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, level: int = 1) -> bytes:
    """An image of the payload's bytes as samples; its length must be a positive multiple of WIDTH."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">II", WIDTH, len(rows)) + _GREY8
    return _SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines.tobytes(), level)) + _chunk(b"IEND", b"")


def decode_png(data: bytes) -> bytes:
    """The samples of an image that encode_png made; ValueError where it is damaged."""
    if data[:8] != _SIGNATURE:
        raise ValueError("not an image")
    at, parts, shape = 8, [], (0, 0)
    while at < len(data):
        (n,) = struct.unpack_from(">I", data, at)
        kind, body = data[at + 4 : at + 8], data[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", data, at + 8 + n)[0]:
            raise ValueError("damaged chunk")
        if kind == b"IHDR":
            shape = struct.unpack_from(">II", body)
        elif kind == b"IDAT":
            parts.append(body)
        at += 12 + n
    lines = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(shape[1], shape[0] + 1)
    if lines[:, 0].any():
        raise ValueError("unknown filter")
    return lines[:, 1:].tobytes()


@dataclass
class Range(InputPartition):
    """The members of one archive that begin in [start, end)."""

    path: str
    start: int
    end: int

    def __post_init__(self):
        super().__init__((self.path, self.start, self.end))


@dataclass
class Written(WriterCommitMessage):
    path: str
    members: int


class ArchiveWriter(DataSourceArrowWriter):
    def __init__(self, options, most_bytes: int):
        self.root, self.most, self.level = options["path"], most_bytes, int(options.get("level", 1))

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        """One archive and its index for each task attempt; only committed ones get their final name."""
        system, root = pafs.FileSystem.from_uri(self.root)
        system.create_dir(root, recursive=True)
        info = TaskContext.get()
        stem = f"{root}/_{info.partitionId():06d}-{info.taskAttemptId()}"
        index, at = [], 0
        with system.open_output_stream(f"{stem}.tar") as out:
            for batch in iterator:
                for name, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    image = encode_png(padded(data or b""), self.level)
                    entry = tarfile.TarInfo(f"{'null' if name is None else name}.{len(data or b'')}.png")
                    entry.size = len(image)
                    head = entry.tobuf(tarfile.PAX_FORMAT)
                    out.write(head)
                    out.write(image)
                    out.write(bytes(-len(image) % 512))
                    index.append((at, len(head), len(image)))
                    at += len(head) + len(image) + -len(image) % 512
            out.write(bytes(1024))
        with system.open_output_stream(f"{stem}.idx") as out:
            out.write(np.array(index, "<i8").tobytes())
        return Written(stem, len(index))

    def commit(self, messages) -> None:
        for m in messages:
            if m is not None:
                system, _ = pafs.FileSystem.from_uri(self.root)
                folder, _, name = m.path.rpartition("/")
                for kind in ("idx", "tar"):
                    system.move(f"{m.path}.{kind}", f"{folder}/part{name}.{kind}")

    def abort(self, messages) -> None:
        for m in messages:
            if m is not None:
                system, _ = pafs.FileSystem.from_uri(self.root)
                for kind in ("idx", "tar"):
                    if system.get_file_info(f"{m.path}.{kind}").type != pafs.FileType.NotFound:
                        system.delete_file(f"{m.path}.{kind}")


class ArchiveReader(DataSourceReader):
    def __init__(self, options):
        self.root = options["path"]
        self.range_bytes, self.retries = int(options.get("rangeBytes", 16 << 20)), int(options.get("retries", 3))
        self.batch_bytes = int(options.get("batchBytes", 8 << 20))

    def partitions(self) -> list[Range]:
        """Byte ranges from the archives' sizes alone: no archive is opened to plan."""
        system, root = pafs.FileSystem.from_uri(self.root)
        found = system.get_file_info(pafs.FileSelector(root, allow_not_found=True))
        files = sorted((f.path, f.size) for f in found if f.base_name.startswith("part") and f.extension == "tar")
        return [Range(p, s, s + self.range_bytes) for p, size in files for s in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def _member(self, system, path: str, at: int, head: int, size: int, name_of) -> tuple:
        """(name, image, payload, error) of the member at an offset; opened anew for each of the tries."""
        error = ""
        for _ in range(1 + self.retries):
            try:
                with system.open_input_file(path) as f:
                    return (*self._decode(f.read_at(head + size, at), head), None)
            except (OSError, ValueError, struct.error, zlib.error, tarfile.TarError) as e:
                error = f"{path}@{at}: {e}"
        return None, None, None, error

    @staticmethod
    def _decode(raw: bytes, head: int) -> tuple[str, bytes, bytes]:
        entry = tarfile.TarFile(fileobj=io.BytesIO(raw[:head] + bytes(1024)), mode="r").next() if head > 512 else tarfile.TarInfo.frombuf(raw[:512], "utf-8", "strict")
        image = raw[head:]
        return entry.name, image, decode_png(image)

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.path:
            return
        system, _ = pafs.FileSystem.from_uri(self.root)
        with system.open_input_file(partition.path.removesuffix(".tar") + ".idx") as f:
            index = np.frombuffer(f.read(), "<i8").reshape(-1, 3)
        index = index[(index[:, 0] >= partition.start) & (index[:, 0] < partition.end)]
        rows, held = [], 0
        with system.open_input_file(partition.path) as f:
            for at, head, size in index.tolist():
                try:
                    got = (*self._decode(f.read_at(head + size, at), head), None)
                except (OSError, ValueError, struct.error, zlib.error, tarfile.TarError):
                    got = self._member(system, partition.path, at, head, size, None)
                rows.append((at, *got))
                held += size + len(got[2] or b"")
                if held >= self.batch_bytes:
                    yield self._batch(partition.path, rows)
                    rows, held = [], 0
        if rows:
            yield self._batch(partition.path, rows)

    @staticmethod
    def _batch(path: str, rows: list[tuple]) -> pa.RecordBatch:
        at, name, image, payload, error = (list(x) for x in zip(*rows))
        return pa.RecordBatch.from_arrays([pa.array([path.rpartition("/")[2]] * len(rows)), pa.array(at, pa.int64()), pa.array(name, pa.string()), pa.array(image, pa.binary()), pa.array(payload, pa.binary()), pa.array(error, pa.string())], names=["archive", "at", "name", "image", "payload", "error"])


class MediaArchive(DataSource):
    """format("media_archive"): writes (name, data) rows and reads (archive, at, name, image, payload, error) rows."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "archive string, at long, name string, image binary, payload binary, error string"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options, 0)


def columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", level: int = 1, range_bytes: int = 16 << 20) -> DataFrame:
    """Media columns of every text, from the stored bytes: id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, error.

    Texts are stored first, eagerly, in archives under the shared folder; the frame reads them back. A null text
    counts as empty and has one row of 64 zero bytes. Repeated rows are stored each; a null id stays null.
    A member that stays damaged after the retries has nulls and its error. Other columns aren't read.
    feature: the mean and the variance of the samples and a 16-bin histogram, as rounded integers.
    """
    spark = common.session(docs.sparkSession)
    spark.dataSource.register(MediaArchive)
    root = common.fresh_path(spark, "media")
    kind = docs.schema[id_col].dataType.simpleString()
    docs.select(F.col(id_col).cast("string").alias("name"), F.col(text_col).cast("binary").alias("data")).write.format("media_archive").option("path", root).option("level", level).mode("append").save()
    read = spark.read.format("media_archive").option("path", root).option("rangeBytes", range_bytes).load()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for name, image, payload, error in zip(*(b.column(c).to_pylist() for c in ("name", "image", "payload", "error"))):
                if error is not None:
                    out.append((None,) * 8 + (error,))
                    continue
                key, n, _ = name.rsplit(".", 2)
                samples = np.frombuffer(payload, np.uint8)
                counts = np.bincount(samples, minlength=256)
                mean = float(counts @ np.arange(256)) / len(samples)
                spread = float(counts @ (np.arange(256) - mean) ** 2) / len(samples)
                feature = f"{mean:.3f};{spread:.3f};" + ",".join(map(str, (counts.reshape(16, 16).sum(1) * 1000 // len(samples)).tolist()))
                out.append((None if key == "null" else key, int(n), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(image), hashlib.sha256(image).hexdigest(), feature, None))
            names = ["i", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "error"]
            kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names=names)

    out = read.select("name", "image", "payload", "error").mapInArrow(run, "i string, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string")
    return out.withColumn("i", F.col("i").cast(kind)).withColumnRenamed("i", id_col)
