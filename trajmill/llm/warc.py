"""WARC archives: written, read back, and deduplicated by resolving revisits.

Archives are gzip files of WARC 1.1 records. Spark's text writer puts them into any file
system: a record is one string, and the line separator CR LF is the second half of the
blank line that ends it. They are read as CR LF lines, which a small parser puts together
by Content-Length, record by record; a file is never held whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajmill.llm.shared import store

CRLF = "\r\n"
HTTP = CRLF.join(["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "", ""])
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2020-01-01T00:00:00Z"

RECORD = (
    "file long, seq long, type string, record_id string, page string, uri string, "
    "digest string, refers_to string, payload_bytes long, payload_digest string"
)


def _uuid(*parts: Column) -> Column:
    text = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]))
    pieces = [F.substring(text, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """A header line; a null value leaves the line out, control characters are escaped."""
    clean = F.regexp_replace(value.cast("string"), r"[\x00-\x20\x7F]", "%20")
    return F.concat(F.lit(f"{name}: "), clean, F.lit(CRLF))


def _record(headers: list[tuple[str, Column]], payload: Column) -> Column:
    block = F.concat(F.lit(HTTP), payload)
    named = [F.coalesce(_line(k, v), F.lit("")) for k, v in headers]
    length = _line("Content-Length", F.octet_length(block))
    return F.concat(F.lit("WARC/1.1" + CRLF), *named, length, F.lit(CRLF), block, F.lit(CRLF))


def _write(records: DataFrame, path: str, per_file: int) -> None:
    records.write.option("lineSep", CRLF).option("compression", "gzip").option(
        "zlib.compress.level", "BEST_SPEED"
    ).option("maxRecordsPerFile", per_file).text(path)


def write_responses(
    pages: DataFrame,
    path: str,
    page_id: str = "page_id",
    url: str = "url",
    html: str = "html",
    per_file: int = 20_000,
) -> None:
    """One response record per row; a null html is an empty payload, a null url a made-up
    one. ``per_file`` bounds the records of a file. Other columns are not read."""
    body = F.coalesce(F.col(html).cast("string"), F.lit(""))
    page = F.col(page_id).cast("string")
    headers = [
        ("WARC-Type", F.lit("response")),
        ("WARC-Record-ID", _uuid(page, F.xxhash64(body))),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.coalesce(F.col(url), F.concat(F.lit("urn:page:"), page), F.lit("urn:page"))),
        ("X-Page-ID", page),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.sha1(body))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
    ]
    _write(pages.select(_record(headers, body).alias("value")), path, per_file)


def _parse(batches: Iterator[pd.DataFrame], keep: bool) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in RECORD.split(", ")] + ["payload"] * keep
    file, seq, headers, block, room = None, 0, None, None, 0
    for batch in batches:
        out = []
        for name, line in zip(batch["file"], batch["value"]):
            if name != file:
                file, seq, headers, block = name, 0, None, None
            if block is not None:
                block.append(line)
                room -= len(line) + 2
                if room > -2:
                    continue
                if room < -2:
                    raise ValueError(f"record {seq} is longer than its Content-Length")
                payload = b"\r\n".join(block).partition(b"\r\n\r\n")[2]
                row = [
                    file,
                    seq,
                    headers.get("warc-type"),
                    headers.get("warc-record-id"),
                    headers.get("x-page-id"),
                    headers.get("warc-target-uri"),
                    headers.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                    headers.get("warc-refers-to"),
                    len(payload),
                    hashlib.sha1(payload).hexdigest(),
                ]
                out.append(row + [payload] * keep)
                seq, headers, block = seq + 1, None, None
            elif headers is None:
                if line.startswith(b"WARC/"):
                    headers = {}
            elif line:
                key, _, value = line.decode("utf-8").partition(":")
                headers[key.lower()] = value.strip()
            else:
                block, room = [], int(headers["content-length"])
        yield pd.DataFrame(out, columns=columns)


def read_records(spark: SparkSession, path: str, payload: bool = False) -> DataFrame:
    """The records of the archives under ``path``: their headers, the length and SHA-1 of the
    payload they hold, and the payload itself where asked for. (file, seq) is a record's place."""
    lines = spark.read.option("lineSep", CRLF).text(path)
    schema = RECORD + ", payload binary" * payload
    return lines.select(
        F.xxhash64("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("value")
    ).mapInPandas(lambda batches: _parse(batches, payload), schema)


def deduplicate(
    spark: SparkSession, source: str, target: str, min_bytes: int = 1000, per_file: int = 20_000
) -> None:
    """Rewrite archives so that equal payloads of ``min_bytes`` or more are stored once.

    Of the responses with one payload that with the largest numeric page id stays (a missing
    id is the smallest; among equal ids the last in its archive); the others become
    revisits of it. Revisits of the source are joined to the response that now holds
    their payload; where there is none, they keep their old reference. All headers are
    written anew.
    """
    heads = store(read_records(spark, source), "warc-heads")
    new_id = _uuid(F.col("page"), F.col("payload_digest"), F.col("file"), F.col("seq"))
    place = F.struct(F.col("page").cast("bigint").alias("page_no"), "file", "seq")
    long = heads.where(F.col("type") == "response").where(F.col("payload_bytes") >= min_bytes)
    originals = store(
        long.groupBy("payload_digest", "payload_bytes").agg(
            F.max_by(
                F.struct(new_id.alias("record_id"), "uri", "file", "seq"), place
            ).alias("first"),
            F.count(F.lit(1)).alias("n"),
        ),
        "warc-originals",
    )
    of = originals.select(
        F.col("payload_digest").alias("digest"),
        F.col("first.record_id").alias("of_id"),
        F.col("first.uri").alias("of_uri"),
        F.col("first.file").alias("of_file"),
        F.col("first.seq").alias("of_seq"),
        "n",
    )
    # Of the payloads that occur once only earlier revisits need the original.
    copies = long.drop("digest").withColumnRenamed("payload_digest", "digest")
    copies = copies.join(of.where("n > 1"), "digest").where(
        (F.col("file") != F.col("of_file")) | (F.col("seq") != F.col("of_seq"))
    )
    earlier = heads.where(F.col("type") == "revisit").join(of, "digest")
    columns = ["file", "seq", "digest", "of_id", "of_uri"]
    revisits = store(copies.select(columns).unionByName(earlier.select(columns)), "warc-revisits")

    records = read_records(spark, source, payload=True).join(
        revisits.withColumnRenamed("digest", "of_digest"), ["file", "seq"], "left"
    )
    again = F.col("of_id").isNotNull() | (F.col("type") == "revisit")
    digest = F.coalesce(
        "of_digest", F.when(F.col("type") == "revisit", F.col("digest")), "payload_digest"
    )
    headers = [
        ("WARC-Type", F.when(again, "revisit").otherwise(F.col("type"))),
        ("WARC-Record-ID", new_id),
        ("WARC-Date", F.lit(DATE)),
        ("WARC-Target-URI", F.col("uri")),
        ("X-Page-ID", F.col("page")),
        ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)),
        ("WARC-Refers-To", F.when(again, F.coalesce("of_id", "refers_to"))),
        ("WARC-Refers-To-Target-URI", F.when(again, F.col("of_uri"))),
        ("WARC-Profile", F.when(again, F.lit(PROFILE))),
        ("Content-Type", F.lit("application/http;msgtype=response")),
    ]
    # Payload bytes pass as they are: the cast does not look at them.
    body = F.when(again, F.lit("")).otherwise(F.col("payload").cast("string"))
    _write(records.select(_record(headers, body).alias("value")), target, per_file)


def resolve(spark: SparkSession, path: str) -> DataFrame:
    """(page, type, payload_bytes, payload_digest, refers_to) of all records under ``path``.

    Length and digest are those of the full payload: a revisit gets them, and the page
    it refers to, from its response; where the archive has no such response it has a null
    length, the digest of its header and no page.
    """
    heads = store(read_records(spark, path), "warc-heads")
    own = heads.where("type <> 'revisit'").select(
        "page", "type", "payload_bytes", "payload_digest", F.lit(None).cast("string").alias("refers_to")
    )
    full = heads.where("type <> 'revisit'").select(
        F.col("record_id").alias("refers_to"),
        F.col("page").alias("of_page"),
        F.col("payload_digest").alias("digest"),
        F.col("payload_bytes").alias("of_bytes"),
    )
    revisits = heads.where("type = 'revisit'").join(full, ["refers_to", "digest"], "left")
    return own.unionByName(
        revisits.select(
            "page",
            "type",
            F.col("of_bytes").alias("payload_bytes"),
            F.col("digest").alias("payload_digest"),
            F.col("of_page").alias("refers_to"),
        )
    )
