"""Content-addressed WARC archive.

An archive is two tables on the shared folder. `payloads` holds the bytes of each different payload once, under its
SHA-256; `headers` holds the exact header bytes of every record with the digest of its payload. Records are rebuilt by
joining the two, and read back by parsing the rebuilt bytes: every payload is digested again, by two functions, and must
agree with the digest it is stored under and with the SHA-1 in the header of each record that refers to it.

Of records whose payload is equal and has at least ``least`` bytes, the one with the largest page_id is the response and
the others are revisits that refer to it; shorter payloads always make a response.

Equal payloads are combined in the map tasks, so a payload that a third of all pages share costs one row per task; the
join that sends its decision back to the pages is narrow and is split when a key is hot.

Defined cases: a null html is an empty payload; a null page_id sorts below all others and is written as a record without
a number; rows that repeat a page_id with the same payload are responses alike when it is the largest; a null url leaves
its header field out, and control characters, `%` included, are percent-encoded in it; empty tables give empty archives.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_END = "\r\n"


def _urn(page: Column) -> Column:
    """A record id that depends on the page alone."""
    h = F.md5(F.concat(F.lit("page|"), F.coalesce(page.cast("string"), F.lit(""))))
    parts = [F.substring(h, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing if the value is null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(_END)), F.lit(""))


def _one_line(url: Column) -> Column:
    for bad, good in (("%", "%25"), ("\r", "%0D"), ("\n", "%0A"), ("\t", "%09")):
        url = F.replace(url, F.lit(bad), F.lit(good))
    return url


def _http(size: Column) -> Column:
    return F.concat(F.lit(f"HTTP/1.1 200 OK{_END}Content-Type: text/html; charset=utf-8{_END}Content-Length: "), size.cast("string"), F.lit(_END * 2))


def write_archive(pages: DataFrame, path: str, page_id: str = "page_id", url: str = "url", html: str = "html", least: int = LEAST) -> None:
    """Write the records of ``pages`` to ``path``/payloads and ``path``/headers."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    facts = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.octet_length(payload).cast("long").alias("size"),
        F.unhex(F.sha2(payload, 256)).alias("digest"), F.sha1(payload).alias("sha1"),
    )
    store = pages.select(payload.alias("payload")).withColumn("digest", F.unhex(F.sha2("payload", 256)))
    store.groupBy("digest").agg(F.min("payload").alias("payload")).write.parquet(f"{path}/payloads")
    chosen = facts.where(F.col("size") >= least).groupBy("digest").agg(F.max("page_id").alias("response_id"))
    rows = facts.join(chosen.withColumnRenamed("digest", "key"), F.col("digest") == F.col("key"), "left")
    first = F.col("key").isNull() | F.col("page_id").eqNullSafe(F.col("response_id"))
    http = _http(F.col("size"))
    block = F.when(first, F.octet_length(http) + F.col("size")).otherwise(F.octet_length(http))
    header = F.concat(
        F.lit(f"WARC/1.1{_END}"),
        _field("WARC-Type", F.when(first, "response").otherwise("revisit")),
        _field("WARC-Record-ID", _urn(F.col("page_id"))),
        _field("WARC-Date", F.lit(DATE)),
        _field("WARC-Target-URI", _one_line(F.col("url"))),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        _field("WARC-Profile", F.when(~first, F.lit(PROFILE))),
        _field("WARC-Refers-To", F.when(~first, _urn(F.col("response_id")))),
        _field("Page-Number", F.col("page_id")),
        _field("Refers-To-Page-Number", F.when(~first, F.col("response_id"))),
        _field("Content-Type", F.lit("application/http; msgtype=response")),
        _field("Content-Length", block),
        F.lit(_END),
    )
    rows.select("digest", F.encode(F.concat(header, http), "UTF-8").alias("header")).write.parquet(f"{path}/headers")


def _archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Headers of responses, headers of revisits, and payloads that agree with their digest."""
    headers = spark.read.schema("digest binary, header binary").parquet(f"{path}/headers")
    payloads = spark.read.schema("digest binary, payload binary").parquet(f"{path}/payloads")
    damaged = F.raise_error(F.lit("payload does not agree with its digest")).cast("binary")
    payloads = payloads.withColumn("payload", F.when(F.unhex(F.sha2("payload", 256)) == F.col("digest"), F.col("payload")).otherwise(damaged))
    revisit = F.decode("header", "UTF-8").contains("\r\nWARC-Type: revisit\r\n")
    return headers.where(~revisit), headers.where(revisit), payloads


def _lost(column: str, kind: str) -> Column:
    return F.when(F.col(column).isNotNull(), F.col(column)).otherwise(F.raise_error(F.lit("payload is lost")).cast(kind))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record rebuilt, with its payload's size and SHA-1: (record, head_size, payload_bytes, payload_digest).

    A payload travels to the responses that hold it; revisits, whose record ends after the HTTP header, get the size
    and digest of the stored payload alone.
    """
    responses, revisits, payloads = _archive(spark, path)
    end, head = F.lit(_END * 2).cast("binary"), F.octet_length("header").alias("head_size")
    whole = responses.join(payloads, "digest", "left").withColumn("payload", _lost("payload", "binary"))
    whole = whole.select(F.concat("header", "payload", end).alias("record"), head, F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    facts = payloads.select("digest", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    short = revisits.join(facts, "digest", "left")
    short = short.select(F.concat("header", end).alias("record"), head, _lost("payload_bytes", "long").alias("payload_bytes"), "payload_digest")
    return whole.unionByName(short)


def parse(records: DataFrame) -> DataFrame:
    """Fields of the rebuilt records; a record whose bytes do not agree with its header is an error."""
    head = F.substring_index(F.decode(F.substring("record", F.lit(1), F.col("head_size")), "UTF-8"), _END * 2, 1)
    rows = records.select(head.alias("head"), F.octet_length("record").alias("record_size"), "payload_bytes", "payload_digest")

    def value(name: str) -> Column:
        found = F.regexp_extract("head", rf"(?m)^{name}: (.*?)\r?$", 1)
        return F.when(F.regexp_like("head", F.lit(rf"(?m)^{name}: ")), found)

    # A block lies between the blank line after the header and the two line ends after the record.
    body = F.col("record_size") - F.octet_length("head") - 8
    bad = (value("WARC-Payload-Digest") != F.concat(F.lit("sha1:"), F.col("payload_digest"))) | (value("Content-Length").cast("long") != body)
    return rows.select(
        value("Page-Number").cast("long").alias("page_id"),
        "payload_bytes",
        F.when(bad, F.raise_error(F.lit("record does not agree with its header")).cast("string")).otherwise(F.col("payload_digest")).alias("payload_digest"),
        value("WARC-Type").alias("record_type"),
        value("Refers-To-Page-Number").cast("long").alias("refers_to"),
        value("WARC-Target-URI").alias("url"),
    )


def archived(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """Write the archive of ``pages`` to the shared folder and read it back."""
    path = scratch_path(pages.sparkSession, "archive")
    write_archive(pages, path, least=least)
    return parse(read_archive(pages.sparkSession, path))
