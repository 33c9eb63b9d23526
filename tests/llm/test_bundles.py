import hashlib

import pytest
import zstandard

from foldloom.llm import bundles


@pytest.fixture
def pages(spark):
    big = "<p>" + "long enough to be referred to " * 10 + "é</p>"
    rows = [
        (5, "http://a/x", big), (3, None, big), (9, "http://a/ y\n", big), (7, "http://b", None), (8, "http://b", ""),
        (1, "u", "short"), (2, "u", "short"), (3, None, big), (None, "n", big), (11, "w", "x" * 5000),
    ]
    return spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, digest int")


def test_round_trip(pages):
    table = bundles.bundles(pages, frame_bytes=2000, bundle_bytes=4000).cache()
    found = bundles.read(table).collect()
    texts = {r["page_id"]: r["html"] or "" for r in pages.collect()}
    assert len(found) == pages.count()
    for row in found:
        page = int(row["page_id"]) if row["page_id"] else None
        raw = texts[page].encode()
        assert (row["payload_bytes"], row["payload_digest"]) == (len(raw), hashlib.sha256(raw).hexdigest())
        again = page in (5, 9, None)
        assert row["record_type"] == ("revisit" if again else "response")
        assert row["refers_to"] == ("3" if again else None)
        assert row["payload"] is None if again else bytes(row["payload"]) == raw
    urls = {r["page_id"]: r["url"] for r in found}
    assert urls["9"] == "http://a/%20y%0A" and urls["3"] is None


def test_bundles_are_plain_zstandard_and_seekable(pages):
    table = bundles.bundles(pages, frame_bytes=2000, bundle_bytes=1 << 20).coalesce(1).collect()
    for row in table:
        content = bytes(row["content"])
        plain = zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True).read()
        seek = bundles.seek_table(content)
        assert plain == b"".join(bundles.frame_of(content, s) for s in seek)
        assert plain.count(b"WARC/1.1\r\n") == len(row["entries"])
        for entry in row["entries"]:
            frame = bundles.frame_of(content, seek[entry["frame"]])
            head, end = bundles.parsed(frame, entry["offset"])
            assert head["record_id"] == entry["record_id"] and end == entry["offset"] + entry["length"]
    broken = bytearray(content)
    broken[20] ^= 255
    with pytest.raises((ValueError, zstandard.ZstdError)):
        bundles.frame_of(bytes(broken), bundles.seek_table(bytes(broken))[0])
    with pytest.raises(ValueError, match="seek table"):
        bundles.seek_table(content + b"x")


def test_fetch_decodes_the_wanted_records(spark, pages):
    table = bundles.bundles(pages, frame_bytes=2000).cache()
    wanted = spark.createDataFrame([(bundles.record_id(i),) for i in (11, 7, 4)], "record_id string")
    found = {r["page_id"]: bytes(r["payload"]) for r in bundles.fetch(table, wanted).collect()}
    assert found == {"11": b"x" * 5000, "7": b""}


def test_written_bundles(spark, pages, tmp_path):
    bundles.write(pages, f"{tmp_path}/out")
    assert bundles.read(spark.read.parquet(f"{tmp_path}/out"), payloads=False).count() == 10
    empty = bundles.bundles(pages.limit(0))
    assert empty.count() == 0 and bundles.read(empty).count() == 0
