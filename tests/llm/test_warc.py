import base64
import hashlib
import tempfile

from parlance.llm import warc

PAGES = "page_id long, url string, html string"
ROWS = [(5, "http://a/", "<p>é</p>"), (2, "http://b/\r\nX: y%", "<p>é</p>"), (7, None, None), (9, "u", ""),
        (1, "c", "one\r\n\r\ntwo"), (1, "c", "one\r\n\r\ntwo"), (8, "d", "x" * 300_000), (None, "e", "<p>é</p>")]


def _expected(rows, least=0):
    out = []
    for page, _, html in rows:
        data = (html or "").encode()
        same = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        first = min(same) if same else None
        holds = len(data) < least or page == first
        out.append((page, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                    "response" if holds else "revisit", None if holds else first))
    return sorted(out, key=str)


def test_read_back_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, PAGES)
    for least in (0, 5):
        got = sorted((tuple(r) for r in warc.archived(df, least).collect()), key=str)
        assert got == _expected(ROWS, least)


def test_records_are_whole_and_payloads_stored_once(spark):
    path = tempfile.mkdtemp(prefix="warc-") + "/a"
    warc.write_archive(spark.createDataFrame(ROWS, PAGES), path)
    assert spark.read.parquet(f"{path}/payloads").count() == len({h or "" for _, _, h in ROWS})
    records = warc.read_records(spark, path)
    for r in records.collect():
        head, _, rest = bytes(r["record"]).partition(b"\r\n\r\n")
        fields = dict(x.split(b": ", 1) for x in head.split(b"\r\n")[1:])
        assert rest[int(fields[b"Content-Length"]):] == b"\r\n\r\n"
    parsed = {r["url"]: r["payload"] for r in warc.parse_records(records).collect() if r["record_type"] == "response"}
    assert bytes(parsed["c"]) == b"one\r\n\r\ntwo" and "http://b/\r\nX: y%" in parsed


def test_addresses_come_back_as_they_went_in(spark):
    urls = ["http://h/a%20b", "http://h/%0A%25", "\r\n\t\x00\x7f", "\\", "\\x0A\\\\x0D", "é\x1f\\n", "", None]
    path = tempfile.mkdtemp(prefix="warc-") + "/a"
    warc.write_archive(spark.createDataFrame([(i, u, f"p{i}") for i, u in enumerate(urls)], PAGES), path, date="2024-02-03T04:05:06Z")
    records = warc.read_records(spark, path)
    assert {r["page_id"]: r["url"] for r in warc.parse_records(records).collect()} == dict(enumerate(urls))
    heads = [bytes(r["record"]).partition(b"\r\n\r\n")[0] for r in records.collect()]
    assert all(b"WARC-Date: 2024-02-03T04:05:06Z" in h for h in heads)
    assert any(b"WARC-Target-URI: http://h/a%20b" in h for h in heads)


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], PAGES)).collect() == []
