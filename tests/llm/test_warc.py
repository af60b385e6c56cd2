import hashlib
import io
import struct
import zipfile

import pytest

from folioscope.llm import warc, zip_range


def test_round_trip(spark):
    big = "<p>é</p>" * 40
    rows = [(5, "u5", big), (3, "u3", big), (9, None, big), (1, "a\r\nb", "small"), (2, "u", "small"), (4, "u", None), (6, "u", ""), (None, "n", "x" * 300), (7, "u", "x" * 300), (7, "u", "x" * 300), (8, "u", "w" * 3_000_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, refers_to string").repartition(3)
    got = warc.read_archives(warc.archived(df, archive_bytes=500)).collect()
    digest = {r[0]: hashlib.sha256((r[2] or "").encode()).hexdigest() for r in rows}
    want = [(r[0], len((r[2] or "").encode()), digest[r[0]], "response", None) for r in rows if r[0] in (3, 1, 2, 4, 6, 8)]
    want += [(k, 360, digest[3], "revisit", 3) for k in (5, 9)] + [(7, 300, digest[7], "response", None), (7, 300, digest[7], "revisit", 7), (None, 300, digest[7], "revisit", 7)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_string_ids_and_a_task_for_each_archive(spark):
    from pyspark.sql import types as T

    df = spark.createDataFrame([(f"p{k}", "u", "x" * 200) for k in range(9)], "page_id string, url string, html string").repartition(3)
    archives = warc.archived(df, archive_bytes=100)
    found = warc.read_archives(archives, T.StringType())
    assert found.rdd.getNumPartitions() == archives.count() == 9
    got = found.collect()
    assert sorted(r.page_id for r in got) == [f"p{k}" for k in range(9)]
    assert [r.page_id for r in got if r.record_type == "response"] == ["p0"] and all(r.refers_to == "p0" for r in got if r.record_type == "revisit")


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id long, url string, html string")
    assert warc.read_archives(warc.archived(df)).count() == 0


def test_foreign_zip64_and_comments(tmp_path):
    path = str(tmp_path / "a.zip")
    with zipfile.ZipFile(path, "w") as z:
        for k in range(70_000):  # more entries than 16 bits hold
            z.writestr(zipfile.ZipInfo(f"n{k}"), b"")
        with z.open("é/data", "w", force_zip64=True) as f:
            f.write(b"0123456789")
        z.comment = b"PK\x05\x06 not the end"
    with zip_range.Ranges(path) as file:
        found = {m.name: m for m in zip_range.members(file)}
        assert len(found) == 70_001
        assert file.read(zip_range.data_at(file, found["é/data"]) + 3, 4) == b"3456"


def test_zip64_fields_of_an_entry():
    extra = struct.pack("<2H3Q", 1, 24, 5_000_000_000, 5_000_000_001, 6_000_000_000)
    full = 0xFFFFFFFF
    assert zip_range._wide(extra, full, full, full) == (5_000_000_000, 5_000_000_001, 6_000_000_000)
    assert zip_range._wide(struct.pack("<2HL2HQ", 9, 4, 0, 1, 8, 7), 1, 1, full) == (1, 1, 7)


def test_bad_archives(tmp_path):
    path = tmp_path / "b.zip"
    for raw in (b"", b"not a zip" * 10):
        path.write_bytes(raw)
        with zip_range.Ranges(str(path)) as file, pytest.raises(zip_range.ZipError):
            list(zip_range.members(file))
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("x", b"a" * 1000)
    path.write_bytes(packed.getvalue())
    with zip_range.Ranges(str(path)) as file, pytest.raises(zip_range.ZipError):
        zip_range.data_at(file, next(iter(zip_range.members(file))))
