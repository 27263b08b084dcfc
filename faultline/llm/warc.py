"""WARC archives: write captures, read records, assemble one nested row per capture.

A capture is a request, a response (or a revisit of an equal payload) and a
metadata record, tied by WARC-Concurrent-To.  Archives are written by Spark's
text writer, whose line separator is the blank lines that end a record, so any
store that Spark writes to will do.
"""

from __future__ import annotations

import io
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.session import scratch_path, write_once

REVISIT_FROM = 100  # bytes of payload
FILE_RECORDS = 1_500  # an archive is read as a whole, so it has few records
DATE = "2026-01-01T00:00:00Z"
_END = "\r\n\r\n"
RECORD = (
    "record_id string, type string, concurrent_to string, refers_to string, target_uri string, date string, "
    "content_type string, headers map<string,string>, http_headers map<string,string>, payload binary"
)


def _uri(kind: str, serial: Column, digest: Column) -> Column:
    """A record id by row and payload."""
    hexes = F.md5(F.concat_ws("/", F.lit(kind), serial.cast("string"), digest))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(hexes, r"^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def _record(fields: dict[str, Column | str | None], block: Column) -> Column:
    """One record without the blank lines behind it; null fields are left out."""
    lines = [
        F.concat(F.lit(f"{name}: "), value) if isinstance(value, Column) else F.lit(f"{name}: {value}")
        for name, value in fields.items()
        if value is not None
    ]
    return F.concat(F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines, F.concat(F.lit("Content-Length: "), F.octet_length(block))), F.lit(_END), block)


def captures(pages: DataFrame) -> DataFrame:
    """``page_id, url, html, digest, serial, first``: every row, numbered, and who has its payload first.

    ``first`` is the smallest page_id of the rows with an equal payload and the
    number of such a row; null for payloads that no other row has or that have
    fewer than ``REVISIT_FROM`` bytes.
    """
    own = write_once(
        pages.select(
            "page_id",
            F.col("url").cast("string").alias("url"),
            F.coalesce("html", F.lit("")).alias("html"),
            F.monotonically_increasing_id().alias("serial"),
        ).withColumn("digest", F.sha2("html", 256)),
        "pages",
        compression="zstd",  # markup takes half the room
    )
    firsts = write_once(
        own.where((F.octet_length("html") >= REVISIT_FROM) & F.col("page_id").isNotNull())
        .groupBy("digest")
        .agg(F.min(F.struct("page_id", "serial")).alias("first")),
        "payloads",
    )
    return own.join(firsts, "digest", "left")


def write_warc(pages: DataFrame, path: str) -> None:
    """Three records per row of ``pages``: ``page_id, url, html``.

    Null html is an empty payload, a null url gives no target.  White space in
    a url is written percent-encoded.  A page_id that is null is never a first
    page.  Every row is a capture of its own, repeated ones too; of rows with
    equal payloads all those with the smallest page_id are responses.
    """
    url = F.col("url")
    for char in (" ", "\r", "\n", "\t"):
        url = F.replace(url, F.lit(char), F.lit(f"%{ord(char):02X}"))
    page, digest, serial = F.col("page_id"), F.col("digest"), F.col("serial")
    revisit = F.coalesce(page != F.col("first.page_id"), F.col("first").isNotNull())
    own_id = _uri("response", serial, digest)
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html"), F.lit(_END))
    target = F.when(url.isNotNull(), F.concat(F.lit("WARC-Target-URI: "), url))
    common = lambda kind: {"WARC-Type": kind, "WARC-Date": DATE}

    def record(kind: Column | str, own: Column, content: str, block: Column, **more: Column) -> Column:
        fields = common(kind) | {"WARC-Record-ID": own, "Content-Type": content} | {k.replace("_", "-"): v for k, v in more.items()}
        return _record(fields, block)

    first_id = _uri("response", F.col("first.serial"), digest)
    extra = F.concat_ws(
        "\r\n",
        F.concat(F.lit("sha256:"), digest),
        target,
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), first_id)),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
    )
    main = record(
        F.when(revisit, "revisit").otherwise("response"), own_id, "application/http; msgtype=response",
        F.when(revisit, http).otherwise(F.concat(http, F.col("html"))), WARC_Payload_Digest=extra,
    )
    asked = F.concat(F.lit("GET "), F.coalesce(url, F.lit("/")), F.lit(" HTTP/1.1" + _END))
    request = record("request", _uri("request", serial, digest), "application/http; msgtype=request", asked, WARC_Concurrent_To=own_id)
    facts = F.concat(F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit("\r\n"))
    metadata = record("metadata", _uri("metadata", serial, digest), "application/warc-fields", facts, WARC_Concurrent_To=own_id)
    records = captures(pages).select(F.explode(F.array(request, main, metadata)).alias("value"))
    records.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _unpacked(data: bytes) -> bytes:
    """The bytes of all gzip members, as far as they can be read."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(wbits=31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def parse_records(data: bytes) -> Iterator[dict]:
    """Records of one archive, gzip or plain.

    A record that is cut off, or whose length cannot be read, ends the file and
    is not given; so does damage of the compression.
    """
    stream = io.BytesIO(_unpacked(data) if data[:2] == b"\x1f\x8b" else data)
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue  # blank lines between records
        headers: dict[str, str] = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.partition(b":")
            headers[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        length = headers.get("content-length", "0")
        block = stream.read(int(length)) if length.isascii() and length.isdigit() else None
        if block is None or len(block) < int(length):
            return
        http: dict[str, str] = {}
        payload = block
        if headers.get("content-type", "").startswith("application/http"):
            head, _, payload = block.partition(b"\r\n\r\n")
            for line in head.split(b"\r\n")[1:]:
                name, _, value = line.partition(b":")
                http[name.decode("utf-8", "replace").strip().lower()] = value.decode("utf-8", "replace").strip()
        yield {
            "record_id": headers.get("warc-record-id"), "type": headers.get("warc-type"),
            "concurrent_to": headers.get("warc-concurrent-to"), "refers_to": headers.get("warc-refers-to"),
            "target_uri": headers.get("warc-target-uri"), "date": headers.get("warc-date"),
            "content_type": headers.get("content-type"), "headers": list(headers.items()), "http_headers": list(http.items()), "payload": payload,
        }


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of the archives below ``path`` (columns as in ``RECORD``)."""
    text, pairs = pa.string(), pa.map_(pa.string(), pa.string())
    names = ["record_id", "type", "concurrent_to", "refers_to", "target_uri", "date", "content_type"]
    schema = pa.schema([(n, text) for n in names] + [("headers", pairs), ("http_headers", pairs), ("payload", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                some: list[dict] = []
                size = 0
                for record in parse_records(data.as_py()):
                    some.append(record)
                    size += len(record["payload"])
                    if size > 4_000_000:
                        yield pa.RecordBatch.from_pylist(some, schema)
                        some, size = [], 0
                if some:
                    yield pa.RecordBatch.from_pylist(some, schema)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("content").mapInArrow(run, RECORD)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: ``capture_id, request, response, metadata``, each a struct or null.

    ``response`` is the response or revisit record; requests and metadata join
    it by the record they are concurrent to.  Records that repeat an id are one
    record; of several requests or metadata records of a capture the smallest
    id is taken.  A part whose response is missing still gives a row.
    The parts of a capture meet in one combining aggregate, so no join input is sorted twice.
    """
    main = F.col("type").isin("response", "revisit")
    part = F.struct(*[F.col(f"`{c}`") for c in records.columns])

    def pick(kind: Column) -> Column:
        return F.min_by(part, F.when(kind, F.col("record_id")))

    return (
        records.where(main | F.col("type").isin("request", "metadata"))
        .withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.coalesce("concurrent_to", "record_id")))
        .groupBy("capture_id")
        .agg(
            pick(F.col("type") == "request").alias("request"),
            pick(main).alias("response"),
            pick(F.col("type") == "metadata").alias("metadata"),
        )
    )


def archive_pages(pages: DataFrame) -> DataFrame:
    """Writes and reads archives: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Size and digest are those of the payload bytes read for responses, of the
    record's own headers for revisits, which carry no payload.
    """
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_warc(pages, path)
    records = read_warc(spark, path)
    revisit = F.col("type") == "revisit"
    facts = records.select(
        "record_id",
        "type",
        "concurrent_to",
        "refers_to",
        F.when(revisit, F.col("http_headers")["content-length"].cast("bigint")).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(F.col("headers")["warc-payload-digest"], "^sha256:", "")).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        F.when(F.col("type") == "metadata", F.regexp_extract(F.col("payload").cast("string"), r"page-id: (-?\d+)", 1).try_cast("bigint")).alias("page_id"),
    )
    whole = write_once(
        assemble(facts).select(
            "capture_id",
            F.col("metadata.page_id").alias("page_id"),
            "response.payload_bytes",
            "response.payload_digest",
            F.col("response.type").alias("record_type"),
            F.col("response.refers_to").alias("_refers"),
        ),
        "captures",
    )
    shown = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    firsts = whole.select(F.col("capture_id").alias("_refers"), F.col("page_id").alias("refers_to"))
    again = whole.where("_refers IS NOT NULL").join(firsts, "_refers", "left").select(shown)
    rest = whole.where("_refers IS NULL").withColumn("refers_to", F.lit(None).cast(dict(firsts.dtypes)["refers_to"]))
    return rest.select(shown).unionByName(again)


ORACLE = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p WHERE strlen(html) >= {REVISIT_FROM} GROUP BY html)
SELECT page_id, strlen(p.html) AS payload_bytes, sha256(p.html) AS payload_digest,
       CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.html = f.html
"""
