import base64
import glob
import hashlib
import io

import zstandard

from tests.llm.helpers import SF, agrees, odd_columns
from votecount.llm import warc


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string")


def test_agrees_with_sql(spark):
    agrees(warc.archive_and_read(spark.read.parquet(f"{SF}/pages.parquet")), warc.SQL)


def test_round_trip_and_format(spark, tmp_path):
    html = lambda i: f"<html><head><title>Page {i}</title></head><body>{'<p>text</p>' * (i % 7)}</body></html>"
    rows = [(i, f"http://x.org/{i}\r\n", html(i % 150)) for i in range(300)]
    rows += [(900, None, None), (901, "", ""), (902, "u", warc.SEPARATOR.decode("latin-1") * 5), (903, "u", "é漢😀\r\n\r\n" * 9)]
    df = pages(spark, rows).repartition(3)
    path = warc.write(df, str(tmp_path / "w"))
    got = {r.page_id: r for r in warc.read(spark, path).collect()}
    first = {}
    for i, url, text in rows:
        payload = (text or "").encode()
        r = got[i]
        smallest = first.setdefault(payload, i)
        assert r.payload_bytes == len(payload)
        assert r.payload_digest == base64.b32encode(hashlib.sha1(payload).digest()).decode()
        assert (r.record_type, r.refers_to) == (("response", None) if i == smallest else ("revisit", smallest))
        assert (bytes(r.payload) if r.payload is not None else None) == (payload if i == smallest else None)
    assert got[3].url == "http://x.org/3%0D%0A" and got[900].url is None
    # Any decoder that passes over skippable frames can read the files, given the embedded dictionary.
    total = 0
    for name in glob.glob(f"{path}/part-*"):
        data = open(name, "rb").read()
        assert data[:4] == warc.DICTIONARY_MAGIC
        size = int.from_bytes(data[4:8], "little")
        held = data[8 : 8 + size]
        if held[:4] == b"\x28\xb5\x2f\xfd":
            held = zstandard.ZstdDecompressor().decompress(held)
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(held))
        stream = d.stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True)
        total += stream.read().count(b"WARC/1.1\r\n")
    assert total == len(rows)


def test_ties_nulls_and_empty_tables(spark):
    df = pages(spark, [(7, "a", "same"), (7, "a", "same"), (9, "b", "same"), (None, "c", "same"), (None, "d", "other")])
    got = warc.archive_and_read(odd_columns(df, "_sha", "_first", "payload"))
    found = sorted((r.page_id or 0, r.record_type, r.refers_to) for r in got.collect())
    assert found == [(0, "response", None), (0, "revisit", 7), (7, "response", None), (7, "response", None), (9, "revisit", 7)]
    assert warc.archive_and_read(df.where("page_id = 99")).count() == 0


def test_a_damaged_payload_is_noticed():
    data = warc.record(1, "u", b"payload")
    assert warc.parse(data)["payload"] == b"payload"
    try:
        warc.parse(data.replace(b"payload\r\n\r\n", b"pAyload\r\n\r\n"))
    except ValueError as e:
        assert "digest" in str(e)
    else:
        raise AssertionError("accepted")
