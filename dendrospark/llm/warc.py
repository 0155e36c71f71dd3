"""A content-addressed WARC archive: payload bytes once by strong digest, exact headers apart.

``archive`` turns rows into WARC/1.1 records and writes two tables: ``blobs`` (digest, payload), one row per
distinct payload under its SHA-256, and ``headers`` (page_id, digest, the record's exact header bytes, and
whether a block follows).  ``records`` joins them back into the bytes of the original
records; ``parse`` reads a record's fields from those bytes.

Of records with equal payloads of at least ``revisit_bytes`` bytes the one with the largest page_id is a
response and the others are revisits, which have no block of their own and refer to it.  Verification: when read
back, a payload counts only if its SHA-256 is its address, and a header must find its payload; otherwise the read fails.

Hot payloads: the response of a payload comes from a grouped maximum, which Spark pre-aggregates. A payload is kept from the rows
of its least page, so copies of it are dropped where they are and bytes never gather by digest.  What rows hold decides that, not their place, so it
doesn't matter if a shuffled input is read twice.  Revisits meet only the size and digests of their payload, not its bytes; joins by digest
split hot digests into parts.

Edge cases: null html is an empty payload, null url an empty target.  Control characters in a url are percent-encoded in the header.
A null page_id never is the response of a payload that a numbered record has; records without one all are responses
if no record of the payload has a page_id.  Repeated page_ids with equal payload are one record written
repeatedly: all of the largest page_id are responses.  Extra columns are ignored.  No rows: an empty archive.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .skew import hot, spread
from .store import cut, drop

REVISIT_BYTES = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise(F.lit(""))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")), F.lit(">"))


def archive(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES, date: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(headers, blobs), both written to the shared folder. date: the records' WARC-Date, by default now."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")
    rows = pages.select(F.col("page_id").cast("long"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256)).withColumn("at", F.coalesce("page_id", F.lit(-(1 << 63))))
    marks = cut(rows.select("page_id", "at", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("bytes")), "warc-marks")
    first = cut(marks.groupBy("digest").agg(F.max("page_id").alias("response"), F.min("at").alias("at"), F.count(F.lit(1)).alias("n")), "warc-first")
    many = cut(hot(first, ["digest"]), "warc-hot")
    # rows of the least page of each payload; repeats of such a row meet where the join has dealt them
    holders = rows.select("digest", "at", "payload").join(first.select("digest", "at").hint("merge"), ["digest", "at"], "left_semi")
    blobs = cut(holders.groupBy("digest", "at").agg(F.first("payload").alias("payload")).select("digest", "payload"), "warc-blobs")
    known = spread(marks.drop("at"), first.select("digest", "response"), ["digest"], many)
    again = (F.col("bytes") >= revisit_bytes) & F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    kind = F.when(again, "revisit").otherwise("response")
    clean = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    text = F.concat(
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", kind),
        _line("WARC-Record-ID", _urn(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", clean),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "sha1")),
        _line("WARC-Block-Digest", F.when(~again, F.concat(F.lit("sha256:"), "digest"))),
        _line("WARC-Profile", F.when(again, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(again, _urn(F.col("response")))),
        _line("Content-Type", F.lit("text/html; charset=utf-8")),
        _line("Content-Length", F.when(again, F.lit(0)).otherwise(F.col("bytes")).cast("string")),
        F.lit("\r\n"),
    )
    headers = cut(known.select("page_id", "digest", (~again).alias("has_block"), text.cast("binary").alias("header")), "warc-headers")
    drop(marks, first, many)
    return headers, blobs


def records(headers: DataFrame, blobs: DataFrame) -> DataFrame:
    """page_id, record (the exact bytes of the WARC record), bytes and sha1 of its payload (of a revisit too, through its digest)."""
    wrong = F.raise_error(F.lit("a payload doesn't match its digest"))
    checked = blobs.select("digest", F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(wrong).alias("payload"))
    facts = checked.select("digest", F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"))
    many = cut(hot(headers.groupBy("digest").agg(F.count(F.lit(1)).alias("n")), ["digest"]), "warc-hot")
    full = spread(headers.where("has_block"), checked, ["digest"], many, "left")
    found = F.when(F.col("payload").isNull(), F.raise_error(F.lit("a record has no payload"))).otherwise(F.col("payload"))
    full = full.withColumn("payload", found).select("page_id", F.concat("header", "payload", F.lit(b"\r\n\r\n")).alias("record"), F.octet_length("payload").cast("long").alias("bytes"), F.sha1("payload").alias("sha1"))
    bare = spread(headers.where("not has_block"), facts, ["digest"], many, "left")
    known = F.when(F.col("sha1").isNull(), F.raise_error(F.lit("a record has no payload"))).otherwise(F.col("sha1"))
    return full.union(bare.select("page_id", F.concat("header", F.lit(b"\r\n\r\n")).alias("record"), "bytes", known.alias("sha1")))


def parse(found: DataFrame) -> DataFrame:
    """What the records' bytes say: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    head = F.substring_index(F.col("record").cast("string"), "\r\n\r\n", 1)
    get = lambda name: F.nullif(F.regexp_extract("head", rf"(?:^|\r\n){name}: ([^\r\n]*)", 1), F.lit(""))
    length = get("Content-Length").cast("long")
    block = F.substring(F.col("record"), F.octet_length("head") + 5, length.cast("int"))
    told = found.withColumn("head", head).withColumn("block", block).withColumn("record_type", get("WARC-Type"))
    own = F.col("record_type") == "response"
    number = lambda name: F.try_to_number(F.nullif(F.regexp_extract(get(name), r"<urn:page:(-?\d+)>", 1), F.lit("")), F.lit("S9999999999999999999")).cast("long")
    return told.select(
        number("WARC-Record-ID").alias("page_id"),
        F.when(own, F.octet_length("block")).otherwise(F.col("bytes")).cast("long").alias("payload_bytes"),
        F.when(own, F.sha1("block")).otherwise(F.col("sha1")).alias("payload_digest"),
        "record_type",
        number("WARC-Refers-To").alias("refers_to"),
    )


def round_trip(pages: DataFrame) -> DataFrame:
    return parse(records(*archive(pages)))
