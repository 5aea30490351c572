import hashlib
import re

import pytest
import zstandard
from pyarrow import fs
from pyspark.sql import functions as F

from lumenvec.llm import warc

ROWS = [
    (1, "http://a/x", "<p>one</p>"), (2, "http://a/y", "<p>one</p>"), (5, None, "<p>one</p>"), (3, "http://b/ü \r\nX: y", "two"), (4, "http://b", None), (9, "http://c", ""), (7, "http://d", "é" * 300000), (8, "http://d%20", "two\r\n\r\nWARC/1.1\r\n\r\n"),
    (8, "http://d%20", "two\r\n\r\nWARC/1.1\r\n\r\n"), (None, "http://e", "nobody"), (None, "http://f", "<p>one</p>"),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame([(i, u, h, "x", b"p") for i, u, h in ROWS], "page_id long, url string, html string, record_type string, payload binary")


@pytest.fixture(scope="module")
def manifest(pages):
    return warc.write(pages, frame_bytes=2000, bundle_bytes=100_000)


def test_round_trip(pages, manifest):
    got = warc.read(manifest).collect()
    assert len(got) == len(ROWS) == manifest.count()
    firsts = {}
    for i, _, h in ROWS:
        if i is not None:
            firsts[h or ""] = min(i, firsts.get(h or "", i))
    want = []
    for i, u, h in ROWS:
        data, first = (h or "").encode(), firsts.get(h or "")
        again = first is not None and i != first
        want.append((i, u, "revisit" if again else "response", first if again else None, len(data), warc.base32_sha1(data), None if again else data))
    key = lambda x: str(x[:6])
    assert sorted([(r["page_id"], r["url"], r["record_type"], r["refers_to"], r["payload_bytes"], r["payload_digest"], None if r["payload"] is None else bytes(r["payload"])) for r in got], key=key) == sorted(want, key=key)


def test_bundles_are_seekable_and_plain_zstandard(manifest):
    rows = manifest.collect()
    assert len({r["bundle"] for r in rows}) >= 2
    for path in {r["bundle"] for r in rows}:
        store, name = fs.FileSystem.from_uri(path)
        reader = warc.Reader(store, name)
        data = store.open_input_file(name).read()
        whole = b"".join(iter(lambda r=zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True): r.read(1 << 16), b""))
        assert whole == b"".join(reader.frame(k) for k in range(len(reader.frames)))
        assert whole.startswith(b"WARC/1.1\r\nWARC-Type: warcinfo")
        own = [r for r in rows if r["bundle"] == path]
        for r in own:
            assert warc.parse(reader.frame(r["frame"]), r["offset"])[0][1] == r["record_id"]
        for r in own:
            assert reader.record(r["record_id"])[:2] == (r["page_id"], r["record_id"])
    assert len({r["record_id"] for r in rows}) == len(ROWS)  # though two ids are null and two equal


def test_revisits_name_the_record_of_their_response(manifest):
    by_id = {r["record_id"]: r for r in manifest.collect()}
    for r in by_id.values():
        store, name = fs.FileSystem.from_uri(r["bundle"])
        data = warc.Reader(store, name).frame(r["frame"])[r["offset"] :][: r["length"]]
        if b"WARC-Type: revisit" in data:
            other = re.search(rb"WARC-Refers-To: (\S+)", data)[1].decode()
            assert str(by_id[other]["page_id"]).encode() == re.search(rb"X-Refers-To-Page: (\d+)", data)[1]


def test_hot_payloads_are_dropped_before_the_shuffle(spark):
    df = spark.range(4000, numPartitions=4).selectExpr("(id * 7919) % 4000 as page_id", "'u' as url", "if(id % 3 = 0, repeat('hot', 1000), concat('p', id)) as html")
    rows = df.select("page_id", F.monotonically_increasing_id().alias("row"), "url", F.encode("html", "utf-8").alias("payload"))
    sifted = rows.mapInArrow(warc._sift(0), warc.spark_struct(warc._SIFTED))
    assert sifted.where("size = 3000 and payload is not null").count() <= 4 * 20
    got = warc.read(warc.write(df))
    assert got.where("record_type = 'response'").count() == 4000 - 1334 + 1 and got.count() == 4000


def test_reading_is_dealt_by_bytes(manifest):
    assert warc.read(manifest, task_bytes=100_000).rdd.getNumPartitions() >= 6


def test_fetch(spark, manifest):
    ids = manifest.where("page_id in (2, 7, 8)").select("record_id")
    got = warc.fetch(manifest, ids.unionByName(spark.createDataFrame([("<urn:uuid:none>",)], "record_id string"))).collect()
    assert sorted(r["page_id"] for r in got) == [2, 7, 8, 8]
    got = {r["page_id"]: r for r in got}
    assert got[2]["refers_to"] == 1 and bytes(got[7]["payload"]) == ("é" * 300000).encode()


def test_smaller_payloads_may_all_be_responses(pages):
    got = warc.read(warc.write(pages, min_revisit_bytes=11)).collect()
    assert {r["record_type"] for r in got if r["payload_bytes"] < 11} == {"response"}


def test_empty(spark, pages):
    m = warc.write(pages.limit(0))
    assert m.collect() == [] and warc.read(m).collect() == []


def test_damage_is_noticed(manifest):
    data = warc.record("<urn:uuid:x>", 1, "u", b"abc", "D", 3)
    with pytest.raises(ValueError):
        warc.parse(data[:-2])
    assert warc.parse(data)[0][6] == warc.base32_sha1(b"abc") and len(hashlib.sha1(b"abc").digest()) == 20
