import base64
import hashlib

from palimpsest.llm import warc as W
from palimpsest.llm.common import scratch


def test_round_trip_revisits_and_lookup(spark):
    rows = [(1, "http://a", "same"), (7, "http://b\r\nX: y", "same"), (3, None, "other é"), (4, "u", None), (5, "u", ""), (9, "u", "x" * 5000), (None, "n", "none"), (7, "again", "same")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    index = W.write_bundles(df, scratch(spark, "w"), frame_bytes=600)
    got = W.read_bundles(index, with_payload=True).collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.record_id, []).append(r)
    assert (by[1][0].record_type, by[1][0].refers_to, by[1][0].payload_bytes) == ("revisit", 7, 4)
    assert {r.record_type for r in by[7]} == {"response"} and by[4][0].refers_to == 5 and by[5][0].record_type == "response"
    for i, _, text in rows:
        digest = base64.b32encode(hashlib.sha1((text or "").encode()).digest()).decode()
        assert all(r.payload_digest == digest for r in by[i] if i != 7 or text == "same")
    assert by[9][0].payload == b"x" * 5000 and by[None][0].payload == b"none" and by[3][0].payload.decode() == "other é"
    for row in index.collect():
        headers, block = W.lookup(row.bundle, row.frame_start, row.offset)
        assert W._bare_id(headers["WARC-Record-ID"]) == row.record_id and len(block) <= row.length
    assert index.select("bundle", "frame").distinct().count() > 1


def test_small_payloads_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab")], "page_id long, url string, html string")
    out = W.read_bundles(W.write_bundles(df, scratch(spark, "w"), min_revisit_bytes=3)).collect()
    assert {r.record_type for r in out} == {"response"}
    assert W.read_bundles(W.write_bundles(df.limit(0), scratch(spark, "w"))).count() == 0


def test_read_back_is_dealt_out_by_frames(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", str(i) * 300) for i in range(60)], "page_id long, url string, html string").coalesce(1)
    index = W.write_bundles(pages, f"file://{tmp_path}/w", frame_bytes=2000)
    assert index.select("bundle").distinct().count() == 1
    out = W.read_bundles(index, with_payload=True)
    assert out.rdd.getNumPartitions() > 1 and {(r.record_id, bytes(r.payload).decode()) for r in out.collect()} == {(i, str(i) * 300) for i in range(60)}
