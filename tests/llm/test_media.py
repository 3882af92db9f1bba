import hashlib
import os
import struct
import zlib

import pytest
from pyspark.sql import functions as F

from hustings.llm import common, media


def payload(text):
    raw = (text or "").encode()
    return raw + bytes(max(64 - len(raw), -len(raw) % 64))


def test_png_round_trip():
    for text in ("", "a", "b" * 64, "c" * 65, "é" * 1000):
        image = media.encode_png(payload(text))
        assert media.decode_png(image) == payload(text)
        with pytest.raises((ValueError, struct.error)):
            media.decode_png(image[:-9] + b"x" + image[-8:])


def test_columns(edge_docs):
    want = sorted(str((r.doc_id, len((r.text or "").encode()), len(payload(r.text)), hashlib.sha256(payload(r.text)).hexdigest(), zlib.crc32(payload(r.text)[-64:]))) for r in edge_docs.collect())
    rows = media.columns(edge_docs, range_bytes=4096).collect()
    assert sorted(str((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32)) for r in rows) == want
    assert all(r.error is None for r in rows)
    same = [r for r in rows if r.doc_id in (6, 7)]
    assert len({(r.media_sha256, r.media_bytes, r.feature) for r in same}) == 1


def test_empty(no_docs):
    assert media.columns(no_docs).collect() == []


def test_a_damaged_member_is_an_error_and_the_others_are_read(spark):
    common.session(spark)
    spark.dataSource.register(media.MediaArchive)
    root = common.fresh_path(spark, "damaged")
    rows = spark.createDataFrame([(str(k), f"text {k}".encode()) for k in range(20)], "name string, data binary").coalesce(1)
    rows.write.format("media_archive").option("path", root).mode("append").save()
    folder = root.removeprefix("file://")
    tar = next(f"{folder}/{f}" for f in os.listdir(folder) if f.endswith(".tar"))
    with open(tar, "r+b") as f:
        data = f.read()
        f.seek(data.index(b"IDAT", len(data) // 2) + 6)
        f.write(b"\xff\xff\xff")
    got = spark.read.format("media_archive").option("path", root).option("rangeBytes", 3000).option("retries", 1).load()
    assert got.rdd.getNumPartitions() > 1
    assert got.filter("error IS NULL").count() == 19 and got.filter("error IS NOT NULL AND payload IS NULL").count() == 1
    assert got.select(F.countDistinct("at")).first()[0] == 20


def test_a_member_that_fails_at_first_is_read_by_its_offset(spark, monkeypatch):
    common.session(spark)
    spark.dataSource.register(media.MediaArchive)
    root = common.fresh_path(spark, "flaky")
    spark.createDataFrame([(str(k), f"text {k}".encode()) for k in range(12)], "name string, data binary").coalesce(1).write.format("media_archive").option("path", root).mode("append").save()
    reader, decode, tries = media.ArchiveReader({"path": root, "rangeBytes": "1500", "retries": "2"}), media.ArchiveReader._decode, {}

    def flaky(raw, head):
        tries[raw] = tries.get(raw, 0) + 1
        if tries[raw] <= len(tries) % 4:  # some members fail up to three times, which is one more than the retries
            raise ValueError("not yet")
        return decode(raw, head)

    monkeypatch.setattr(media.ArchiveReader, "_decode", staticmethod(flaky))
    rows = [r for part in reader.partitions() for b in reader.read(part) for r in b.to_pylist()]
    assert len(rows) == 12 and all(r["error"] is None and r["payload"] == payload(f"text {r['name'].split('.')[0]}") for r in rows)
    assert sum(n > 1 for n in tries.values()) >= 6
