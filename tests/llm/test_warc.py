import hashlib

from pyspark.sql import functions as F

from rankloom.llm.warc import archived, parse, read_archive, write_archive

SCHEMA = "page_id long, url string, html string, digest string, header string"


def test_records_against_plain_rule(spark):
    big, text = "ä" * 600, "<p>\r\n\r\nWARC-Type: revisit\r\n" + "x" * 1000
    rows = [(1, "http://a/1", big), (2, "http://a/%\n2", big), (9, None, big), (3, "u", "short"), (4, "u", "short"), (5, "u", None), (6, "u", ""), (7, "u", text), (8, "u", text), (None, "n", text), (None, None, None)]
    rows += [(100 + i, "hot", "h" * 1000) for i in range(300)] + [(12, "r", "r" * 2000)] * 2
    df = spark.createDataFrame([(*r, "d", "h") for r in rows], SCHEMA)
    got = sorted((tuple(r) for r in archived(df).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url").collect()), key=repr)
    want = []
    for page, url, html in rows:
        raw = (html or "").encode()
        best = max((p for p, _, h in rows if h == html and p is not None), default=None)
        again = len(raw) >= 1000 and page != best
        shown = url.replace("%", "%25").replace("\n", "%0A") if url else url
        want.append((page, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if again else "response", best if again else None, shown))
    assert got == sorted(want, key=repr)


def test_payloads_are_stored_once_and_records_are_whole(spark, tmp_path):
    df = spark.createDataFrame([(i, "u", "z" * 1500, "", "") for i in range(50)] + [(99, "u", "other", "", "")], SCHEMA)
    write_archive(df, str(tmp_path / "a"))
    assert spark.read.parquet(str(tmp_path / "a/payloads")).count() == 2
    records = read_archive(spark, str(tmp_path / "a"))
    raw = [bytes(r.record) for r in records.collect()]
    assert sum(b"WARC-Type: response" in r for r in raw) == 2 and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in raw)
    for r in raw:
        head, _, rest = r.partition(b"\r\n\r\n")
        size = int(head.split(b"Content-Length: ")[1].split(b"\r\n")[0])
        assert len(rest) == size + 4
    assert parse(records).where(F.col("record_type") == "revisit").count() == 49


def test_empty_table(spark):
    assert archived(spark.createDataFrame([], SCHEMA)).count() == 0
