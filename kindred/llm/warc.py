"""WARC: write captures as request, response or revisit, and metadata records; read and assemble them again.

A capture's three records are joined through WARC-Concurrent-To, which names the response or revisit
record. Payloads met before are written as revisits (identical-payload-digest profile), which state the digest and the
response's URI and date; reading joins them to the response record with that digest.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import arrow
from kindred.session import store, work_path

END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILE_RECORDS = 1_500
_UNSAFE = re.compile(r"[\x00-\x20\x7f<>\"]")


def base32(sha1_hex: str) -> str:
    return base64.b32encode(bytes.fromhex(sha1_hex)).decode()


def _uri(url: str | None) -> str | None:
    return None if url is None else _UNSAFE.sub(lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url)


def _record(kind: str, name: str, date: str, headers: dict, block: str) -> str:
    """One record without its closing line breaks, which the writer puts after every row."""
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:uuid:{name}>", f"WARC-Date: {date}"]
    lines += [f"{k}: {v}" for k, v in headers.items() if v is not None]
    return "\r\n".join([*lines, f"Content-Length: {len(block.encode())}", "", block])


def _records(date: str):
    def run(batches):
        for batch in batches:
            for part in arrow.pieces(batch, "html"):
                out = []
                for row in part.to_pylist():
                    name, digest = str(uuid.uuid5(uuid.NAMESPACE_URL, f"capture:{row['unit']}:{row['page_id']}")), f"sha1:{base32(row['sha1'])}"
                    uri = _uri(row["url"])
                    tied = {"WARC-Target-URI": uri, "WARC-Concurrent-To": f"<urn:uuid:{name}>"}
                    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {row['bytes']}{END}"
                    out.append(_record("request", uuid.uuid5(uuid.UUID(name), "request"), date,
                                       tied | {"Content-Type": "application/http; msgtype=request"}, f"GET {uri or '/'} HTTP/1.1{END}"))
                    headers = {"WARC-Target-URI": uri, "WARC-Payload-Digest": digest, "Content-Type": "application/http; msgtype=response"}
                    if not row["revisits"]:
                        out.append(_record("response", name, date, headers, head + row["html"]))
                    else:
                        headers |= {"WARC-Profile": PROFILE, "WARC-Refers-To-Target-URI": _uri(row["first_url"]), "WARC-Refers-To-Date": date}
                        out.append(_record("revisit", name, date, headers, head))
                    fields = {"pageId": row["page_id"]}
                    out.append(_record("metadata", uuid.uuid5(uuid.UUID(name), "metadata"), date, tied | {"Content-Type": "application/warc-fields"},
                                       "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])
    return run


def write_archive(pages: DataFrame, path: str, least: int = 0, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write every row of `pages` (page_id, url, html) as a capture into gzip files below `path`.

    The payload is the html in UTF-8 (null: empty). Of equal payloads of at least `least` bytes the one with the
    smallest page_id is the response and the others revisits of it; shorter ones are responses. Rows
    that repeat the smallest page_id are responses too; a row without page_id revisits the smallest if there is
    one. Other columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("bigint"), F.col("url").cast("string"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    pages = pages.withColumns({"sha1": F.sha1(F.col("html").cast("binary")), "bytes": F.octet_length("html").cast("bigint")})
    first = (pages.where(F.col("bytes") >= least).groupBy("sha1", "bytes")
             .agg(F.min("page_id").alias("first"), F.min_by("url", "page_id").alias("first_url"), F.count("*").alias("n")).where("n > 1"))
    told = (pages.join(first, ["sha1", "bytes"], "left")
            .withColumn("revisits", F.col("n").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first")))
            .withColumn("unit", F.monotonically_increasing_id())
            .select("unit", "page_id", "url", "html", "sha1", "bytes", "revisits", "first_url"))
    (told.mapInArrow(_records(date), "value string").write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", FILE_RECORDS).text(path))


def parse(archive):
    """Records of an uncompressed archive (a binary stream), by their lengths: (headers with lower-case names, block).

    One record is in memory at a time.
    """
    while line := archive.readline():
        if not line.strip():
            continue
        headers = {}
        while (line := archive.readline()).strip():
            name, _, value = line.decode("utf-8", "replace").partition(":")
            headers[name.strip().lower()] = value.strip()
        yield headers, archive.read(int(headers["content-length"]))


def _read(with_payload: bool):
    fields = pa.schema([("capture", pa.string()), ("kind", pa.string()), ("id", pa.string()), ("uri", pa.string()), ("date", pa.string()),
                        ("digest", pa.string()), ("size", pa.int64()), ("fields", pa.map_(pa.string(), pa.string()))]
                       + [("payload", pa.binary())] * with_payload)

    def row(headers, block):
        kind, name = headers["warc-type"], headers["warc-record-id"]
        payload, known = None, {}
        if kind == "response":
            payload = block.partition(END.encode())[2]
        elif kind == "metadata":
            known = {k: v.strip() for k, _, v in (line.partition(":") for line in block.decode().split("\r\n")) if k}
        digest = headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
        out = {"capture": headers.get("warc-concurrent-to", name), "kind": kind, "id": name, "uri": headers.get("warc-target-uri"),
               "date": headers.get("warc-date"), "digest": base32(hashlib.sha1(payload).hexdigest()) if payload is not None else digest,
               "size": len(payload) if payload is not None else None, "fields": list(known.items())}
        return out | {"payload": payload} if with_payload else out

    def run(batches):
        for batch in batches:
            for content in batch.column("content"):
                stream, held, size = io.BytesIO(content.as_buffer()), [], 0
                packed = stream.getbuffer()[:2] == b"\x1f\x8b"
                for headers, block in parse(gzip.open(stream) if packed else stream):
                    held.append(row(headers, block))
                    size += len(block)
                    if len(held) >= 5000 or size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(held, schema=fields)
                        held, size = [], 0
                if held:
                    yield pa.RecordBatch.from_pylist(held, schema=fields)
    return run


def read_records(spark: SparkSession, path: str, with_payload: bool = True) -> DataFrame:
    """capture, kind, id, uri, date, digest, size, fields (and payload) of all records below `path`.

    The digest and size of a response are taken from its payload; a revisit states its digest.
    """
    schema = ("capture string, kind string, id string, uri string, date string, digest string, size long, fields map<string,string>"
              + ", payload binary" * with_payload)
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_read(with_payload), schema)


def captures(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture, request, response (response or revisit record) and metadata, null where absent."""
    whole = F.struct(*[c for c in records.columns if c != "capture"])

    def one(*kinds):
        return F.first(F.when(F.col("kind").isin(*kinds), whole), ignorenulls=True)
    return records.groupBy("capture").agg(one("request").alias("request"), one("response", "revisit").alias("response"), one("metadata").alias("metadata"))


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every row of `pages`, read back from its written archive.

    A revisit's length and refers_to come from the response record with its digest. Very long payloads are one record each.
    An empty table gives no rows.
    """
    spark, path = pages.sparkSession, work_path(pages.sparkSession, "warc")
    write_archive(pages, path, least)
    read = captures(read_records(spark, path, with_payload=False)).select(
        F.col("metadata.fields")["pageId"].cast("bigint").alias("page_id"), F.col("response.size").alias("size"),
        F.col("response.digest").alias("payload_digest"), F.col("response.kind").alias("record_type"))
    read = store(read, "captures")
    revisits = F.col("record_type") == "revisit"
    responses = (read.where(~revisits).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.max("size").alias("first_size"))
                 .join(read.where(revisits).select("payload_digest").distinct(), "payload_digest", "left_semi"))
    found = read.where(revisits).join(responses, "payload_digest", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return (read.where(~revisits).withColumn("payload_bytes", F.col("size")).withColumn("refers_to", F.lit(None).cast("bigint")).select(*columns)
            .unionAll(found.withColumn("payload_bytes", F.col("first_size")).withColumn("refers_to", F.col("first")).select(*columns)))
