"""WARC bundles: exact round trips, the seek table, and the record kinds against plain Python."""

import base64
import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from orderlens.llm import warc
from orderlens.llm.queries import op11_warc_bundles

KIND = "page_id long, url string, html string"
ROWS = [
    (3, "http://a/é x\r\nEvil: 1", "<p>same</p>"), (1, "http://b", "<p>same</p>"), (2, None, "<p>same</p>"), (4, "http://c", None),
    (5, "http://d", ""), (6, "http://e", "grüße\r\n\r\nWARC/1.1\r\n"), (7, "http://f", "x" * 300_000), (8, "http://g", "only one"),
    (9, "http://h", "twice"), (9, "http://h", "twice"), (9, "http://h", "twice"), (9, "http://h", "another"), (9, "http://i", "twice"),
    (None, "http://j", "nameless"), (None, "http://j", "nameless"), (None, "http://k", "<p>same</p>"), (10, "http://l", "nameless"),
]


def digest(html):
    return base64.b32encode(hashlib.sha1((html or "").encode()).digest()).decode()


def expected(rows):
    """Per payload one response, at the smallest page id (null last)."""
    first = {}
    for page, _, html in rows:
        key = (page is None, page or 0)
        first[html or ""] = min(first.get(html or "", (2, 0)), key)
    out, told = [], set()
    for page, _, html in rows:
        payload, key = html or "", (page is None, page or 0)
        response = first[payload] == key and payload not in told
        if response:
            told.add(payload)
        target = None if response or first[payload][0] else first[payload][1]
        out.append((page, len(payload.encode()), digest(html), "response" if response else "revisit", target))
    return sorted(out, key=repr)


def columns(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


@pytest.fixture(scope="module")
def pages(spark):
    df = spark.createDataFrame(ROWS, KIND)
    return df.withColumns({c: F.lit("x") for c in ("payload", "size", "sha1", "r1", "n", "record_id", "first", "target", "bundle")})


def test_kinds_and_round_trip(spark, pages, tmp_path):
    index, folder = warc.archive(pages.repartition(5), f"file://{tmp_path}/out")
    read = warc.read_records(index, folder, with_payload=True)
    assert columns(read) == expected(ROWS)
    records = read.collect()
    assert len({r["record_id"] for r in records}) == len(ROWS)
    for r in records:
        if r["record_type"] == "response":
            assert digest(bytes(r["payload"]).decode()) == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
        else:
            assert r["payload"] is None
    assert "Evil" not in {k for r in records for k in r["url"].split(":")}
    assert {r["record_id"] for r in records if r["refers_to"] == 1} <= {r["record_id"] for r in records if r["payload_digest"] == digest("<p>same</p>")}


def test_lookup_reads_the_named_records_alone(spark, pages, tmp_path):
    index, folder = warc.archive(pages, str(tmp_path / "out"))
    some = index.where("page_id in (6, 7)")
    got = {r["page_id"]: bytes(r["payload"]).decode() for r in warc.read_records(some, folder, with_payload=True).collect()}
    assert got == {6: ROWS[5][2], 7: ROWS[6][2]}


def test_bundle_is_plain_zstd_with_a_seek_table(spark, tmp_path):
    rnd = random.Random(1)
    rows = [(k, f"http://x/{k}", "".join(rnd.choices("abc <>", k=rnd.choice((0, 30, 3000, 40_000))))) for k in range(60)]
    records = warc.plan_records(spark.createDataFrame(rows, KIND).coalesce(1))
    folder = str(tmp_path / "out")
    index = warc.write_bundles(records, folder, frame_bytes=10_000, bundle_bytes=100_000).collect()
    files = sorted((tmp_path / "out").iterdir())
    assert len(files) > 1
    from pyarrow import fs
    for path in files:
        whole = b""
        with zstandard.ZstdDecompressor().stream_reader(path.open("rb"), read_across_frames=True) as plain:
            whole = plain.read()
        reader = warc.BundleReader(fs.LocalFileSystem().open_input_file(str(path)))
        assert reader.plain[-1] == len(whole) and reader.read(5, 25_000) == whole[5:25_005] and reader.read(len(whole) - 3, 9) == whole[-3:]
        assert len(reader.plain) > 2 and all(len(reader.frame(k)) for k in range(len(reader.plain) - 1))
        for r in index:
            if r["bundle"] == path.name:
                begin = reader.plain[r["frame"]] + r["offset"]
                fields, payload = warc.parse_record(whole[begin:begin + r["length"]])
                assert fields["WARC-Record-ID"] == f"<{r['record_id']}>" and (r["record_type"] == "revisit" or payload.decode() == rows[r["page_id"]][2])


def test_damaged_bundle_is_an_error(spark, tmp_path):
    index, folder = warc.archive(spark.createDataFrame(ROWS, KIND).coalesce(1), str(tmp_path / "out"))
    path = next((tmp_path / "out").iterdir())
    data = path.read_bytes()
    path.write_bytes(data[:-1] + b"\0")
    with pytest.raises(Exception, match="no seek table"):
        warc.read_records(index, folder).collect()


def test_small_payloads_are_all_responses(spark):
    index, folder = warc.archive(spark.createDataFrame(ROWS, KIND), min_bytes=8)
    got = warc.read_records(index, folder).collect()
    kinds = {(r["page_id"], r["record_type"], r["payload_digest"]) for r in got}
    assert {k for _, k, d in kinds if d in (digest(None), digest("twice"))} == {"response"} and len(got) == len(ROWS)
    assert sum(r["record_type"] == "revisit" for r in got) == 3 + 2


def test_repeated_rows_and_empty_table(spark):
    rows = [(5, "u", "hot")] * 25_000 + [(6, "v", "hot")] * 3
    index, folder = warc.archive(spark.createDataFrame(rows, KIND))
    got = warc.read_records(index, folder)
    counts = {(r["page_id"], r["record_type"], r["refers_to"]): r["count"] for r in got.groupBy("page_id", "record_type", "refers_to").count().collect()}
    assert counts == {(5, "response", None): 1, (5, "revisit", 5): 24_999, (6, "revisit", 5): 3}
    assert got.select("record_id").distinct().count() == len(rows)
    index, folder = warc.archive(spark.createDataFrame([], KIND))
    assert warc.read_records(index, folder).count() == 0


def test_query_on_the_table(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "url", "html").collect()]
    assert columns(op11_warc_bundles(spark, "/root/testdata/sf0.01")) == expected(rows)
