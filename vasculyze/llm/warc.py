"""A content-addressed web archive: payload bytes once per content, exact record headers apart, records rebuilt by joins.

The address is SHA-256; SHA-1, which the format's headers carry, is never used to decide equality, so two payloads with one
SHA-1 stay two. Reading verifies every stored payload against its address, and takes what it says of a record from the bytes
of its header: identity, type, digest, length, and the record that a revisit refers to.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, written

CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"


def base32_of_sha1(data) -> F.Column:
    """The bare upper-case base32 SHA-1: each five hexadecimal digits are four of base 32."""
    h = F.sha1(data)
    fives = [F.lpad(F.conv(F.substring(h, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*fives), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _urn(page) -> F.Column:
    """A record's name: a version 8 UUID whose first 64 free bits are the page_id, and whose last is 1 where that is null."""
    h = F.lower(F.lpad(F.hex(F.coalesce(page.cast("long"), F.lit(0))), 16, "0"))
    part = lambda a, n: F.substring(h, a, n)
    return F.concat(F.lit("<urn:uuid:"), part(1, 8), F.lit("-"), part(9, 4), F.lit("-8"), part(13, 3), F.lit("-8"), part(16, 1), F.lit("00-00000000000"), F.when(page.isNull(), "1").otherwise("0"), F.lit(">"))


def _page_of(head, name: str) -> F.Column:
    """The page_id in the record name that a header's line has; null where there is no such line."""
    found = lambda i: F.regexp_extract(head, rf"\r\n{name}: <urn:uuid:([0-9a-f]{{8}})-([0-9a-f]{{4}})-8([0-9a-f]{{3}})-8([0-9a-f])00-00000000000([01])>\r\n", i)
    return F.when(found(5) == "0", F.conv(F.concat(*map(found, range(1, 5))), 16, -10).cast("long"))


def write_archive(pages: DataFrame, *, least: int = 0, date: str = "2020-01-01T00:00:00Z") -> tuple[DataFrame, DataFrame]:
    """Writes (headers, payloads) as two tables in the shared folder.

    Of records with equal payloads of at least `least` bytes, the one with the largest page_id is the response and the
    others revisit it; smaller ones are all responses. Rows alike in page_id and payload are one record said again and
    have the same type. Null html is an empty payload, a null page_id comes before all others, a null url is empty.
    Payload bytes travel once, by content and page, so that copies of one content spread; only responses' stay.
    """
    p = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload"))
    seen = p.select("page_id", "url", F.sha2("payload", 256).alias("address"), F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_sha1(F.col("payload")).alias("payload_digest"))
    seen = written(seen, "seen")
    # Written, so that the join below meets two plain exchanges, of which Spark can split a hot content's.
    first = written(seen.groupBy("address").agg(F.max("page_id").alias("response_id")), "contents")
    h = seen.join(first, "address")
    revisit = (F.col("payload_bytes") >= least) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    h = h.withColumn("record_type", F.when(revisit, "revisit").otherwise("response")).withColumn("refers_to", F.when(revisit, F.col("response_id")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    length = F.when(revisit, F.lit(0)).otherwise(F.col("payload_bytes") + len(HTTP)).cast("string")
    head = F.concat(
        F.lit("WARC/1.1" + CRLF), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", _urn(F.col("page_id"))), line("WARC-Date", F.lit(date)), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", "")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")), line("WARC-Refers-To", _urn(F.col("refers_to"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", length), F.lit(CRLF), F.when(revisit, F.lit("")).otherwise(F.lit(HTTP)),
    )
    headers = h.select("page_id", "record_type", "address", head.cast("binary").alias("header"))
    headers = written(headers, "warc-headers")
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    keep = first.select("address", F.coalesce(F.col("response_id").cast("string"), F.lit("null")).alias("page"))
    body = p.select(F.sha2("payload", 256).alias("address"), page.alias("page"), "payload").join(keep, ["address", "page"], "left_semi")
    payloads = written(body.dropDuplicates(["address", "page"]).select("address", "payload"), "warc-payloads")
    drop(seen, first)
    return headers, payloads


def read_archive(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """A row per record with what its header's bytes say, checked: the payload at its address has this SHA-256, and the
    digest that the header states; the header's length is that of its block, which a revisit has none of."""
    body = payloads.select("address", F.octet_length("payload").cast("long").alias("payload_bytes"), base32_of_sha1(F.col("payload")).alias("stored_digest"), (F.sha2("payload", 256) == F.col("address")).alias("sound"))
    head = F.col("header").cast("string")
    said = lambda name, value: F.regexp_extract(head, rf"\r\n{name}: {value}\r\n", 1)
    r = headers.select(
        F.regexp_extract(head, r"^WARC/1\.1\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"), _page_of(head, "WARC-Record-ID").alias("page_id"), _page_of(head, "WARC-Refers-To").alias("refers_to"),
        said("WARC-Payload-Digest", "sha1:([A-Z2-7]{32})").alias("payload_digest"), said("Content-Length", r"(\d+)").cast("long").alias("length"),
        (F.octet_length("header") - F.octet_length(F.substring_index(head, CRLF + CRLF, 1)) - 4).cast("long").alias("http"), "address",
    ).join(body, "address", "left")
    revisit = F.col("record_type") == "revisit"
    block = F.when(revisit, F.lit(0)).otherwise(F.col("http") + F.col("payload_bytes"))
    sound = F.coalesce(F.col("sound") & (F.col("payload_digest") == F.col("stored_digest")) & (F.col("length") == block) & (revisit | (F.col("record_type") == "response")), F.lit(False))
    good = F.assert_true(sound, F.concat(F.lit("damaged record of page "), F.coalesce(F.col("page_id").cast("string"), F.lit("null"))))
    return r.withColumn("_ok", F.coalesce(good.cast("string"), F.lit(""))).select("page_id", "payload_bytes", F.concat("payload_digest", "_ok").alias("payload_digest"), "record_type", "refers_to")


def records(headers: DataFrame, payloads: DataFrame) -> DataFrame:
    """(page_id, record): the full bytes of every record, header and (for responses) payload, ended as the format asks."""
    end = F.lit(CRLF + CRLF).cast("binary")
    r = headers.join(payloads, "address", "left")
    return r.select("page_id", F.when(F.col("record_type") == "revisit", F.concat("header", end)).otherwise(F.concat("header", "payload", end)).alias("record"))


def op7(spark, sf_dir: str) -> DataFrame:
    return read_archive(*write_archive(spark.read.parquet(f"{sf_dir}/pages.parquet")))


_FIVES = " || ".join(
    "substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(sha1(p), {a}, 5))::BIGINT >> {s}) & 31)::INT, 1)".format(a=5 * i + 1, s=s) for i in range(8) for s in (15, 10, 5, 0)
)
OP7_SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS p FROM pages),
     q AS (SELECT page_id, strlen(p)::BIGINT AS payload_bytes, {_FIVES} AS payload_digest, max(page_id) OVER (PARTITION BY p) AS r FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = r THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> r THEN r END AS refers_to
FROM q
"""
