"""WARC files: written once whatever runs twice, read by gzip and by Spark."""

import gzip
import os

from kindred.llm import archive_files, archives, registry


def test_files_hold_the_archives(spark, tmp_path):
    folder = str(tmp_path / "warc")
    rows = [(1, "http://a/1", "<p>one</p>"), (2, "http://a/2", "<p>one</p>"), (3, None, None), (None, "http://a/4", "x" * 100_000)]
    made = archives.convert_archives(archives.legacy_archives(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)))
    told = archive_files.save_archives(made, folder).collect()
    again = archive_files.save_archives(made.unionByName(made), f"file:{folder}").collect()  # a second run changes nothing
    names = sorted(os.listdir(folder))
    assert names == sorted(os.path.basename(r.path) for r in told) == sorted({os.path.basename(r.path) for r in again})
    assert all(os.path.getsize(f"{folder}/{n}") == next(r.bytes for r in told if r.path.endswith(n)) for n in names)
    text = b"".join(gzip.open(f"{folder}/{n}").read() for n in names)
    assert text.count(b"WARC/1.1\r\n") >= 4 and b"x" * 100_000 in text
    key = lambda r: str(tuple(r))
    back = archives.read_archives(archive_files.open_archives(spark, folder))
    assert sorted(back.collect(), key=key) == sorted(archives.read_archives(made).collect(), key=key)


def test_null_and_empty_archives(spark, tmp_path):
    found = archive_files.save_archives(spark.createDataFrame([(None,), (b"",)], "archive binary"), str(tmp_path / "none"))
    assert found.count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    key = lambda r: str(tuple(r))
    assert sorted(registry.warc_files(spark, sf).collect(), key=key) == sorted(registry.op6_arc_to_warc(spark, sf).collect(), key=key)
