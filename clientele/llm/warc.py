"""WARC archives of pages: written with segments and chunked framing, read back by reassembly.

Writing. Every page is one record: a ``response`` whose block is an HTTP message with
``Transfer-Encoding: chunked``, or a ``revisit`` if its payload equals that of another page. A
block longer than ``SEGMENT_BYTES`` is cut: the first part is the response (segment 1), the others
are ``continuation`` records with the origin's id, their number and, in the last, the total length.
The records go out through Spark's text writer, whose line separator is the blank line that ends a
record. So files are committed as a whole, any store Spark can write will do, and a lost executor
costs one task. ``maxRecordsPerFile`` and the segment length bound each file, whatever a page's length.

Reading. Each (bounded) file is parsed by its Content-Length fields alone, so payloads may hold
anything. Continuations meet their origin by id, are ordered by number and verified: numbers without gaps,
the stated total length, framing that ends where it should, and the payload digest.
"""

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clientele.llm.frames import kept
from clientele.session import scratch_path

SEGMENT_BYTES = 64 * 1024
CHUNK_BYTES = 8 * 1024
RECORDS_PER_FILE = 256
BATCH_BYTES = 256 * 1024
END = b"\r\n\r\n"
VERSION = b"WARC/1.1\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def chunked(payload: bytes, size: int = CHUNK_BYTES) -> bytes:
    """The payload in chunked transfer framing."""
    parts = [b"%x\r\n%b\r\n" % (len(payload[k : k + size]), payload[k : k + size]) for k in range(0, len(payload), size)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(body: bytes) -> bytes:
    """The payload of a chunked body; an error if the framing is broken or does not end with it."""
    parts, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        at = line + 2
        if size == 0:
            break
        parts.append(body[at : at + size])
        if len(parts[-1]) != size or body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("broken chunk")
        at += size + 2
    # Trailer fields may follow, an empty line ends the body.
    if body[at : at + 2] != b"\r\n" and body[-4:] != END:
        raise ValueError("chunked body without an end")
    return b"".join(parts)


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _head(fields: list[tuple[str, object]], length: int) -> bytes:
    lines = [f"{name}: {value}\r\n" for name, value in fields if value is not None]
    return VERSION + "".join(lines).encode("utf-8", "surrogatepass") + b"Content-Length: %d" % length + END


def _one_line(text: str | None) -> str | None:
    """A header value has no line ends; they are percent-encoded, as a URL has to have them."""
    return None if text is None else re.sub(r"[\r\n]", lambda m: "%%%02X" % ord(m[0]), text)


def page_records(page_id, url, html: str | None, refers_to, is_revisit: bool) -> Iterator[bytes]:
    """The records of one page, each without the blank line that ends it."""
    payload = (html or "").encode("utf-8", "surrogatepass")
    sha1 = digest(payload)
    name = "" if page_id is None else str(page_id)
    fields = [
        ("WARC-Type", "revisit" if is_revisit else "response"),
        ("WARC-Record-ID", f"<urn:page:{name}:{sha1}>"),
        ("WARC-Date", "2024-01-01T00:00:00Z"),
        ("WARC-Target-URI", _one_line(url)),
        ("WARC-Payload-Digest", f"sha1:{sha1}"),
        ("WARC-Payload-Length", len(payload)),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if is_revisit:
        target = "" if refers_to is None else str(refers_to)
        fields += [("WARC-Profile", IDENTICAL), ("WARC-Refers-To", f"<urn:page:{target}:{sha1}>")]
        yield _head(fields, len(HTTP_HEAD)) + HTTP_HEAD
        return
    block = HTTP_HEAD + chunked(payload)
    parts = _cut(block)
    if len(parts) == 1:
        yield _head(fields, len(block)) + block
        return
    yield _head(fields + [("WARC-Segment-Number", 1)], len(parts[0])) + parts[0]
    for number, part in enumerate(parts[1:], 2):
        total = len(block) if number == len(parts) else None
        yield _head(
            [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"<urn:page:{name}:{sha1}:{number}>"),
                ("WARC-Date", "2024-01-01T00:00:00Z"),
                ("WARC-Segment-Origin-ID", f"<urn:page:{name}:{sha1}>"),
                ("WARC-Segment-Number", number),
                ("WARC-Segment-Total-Length", total),
            ],
            len(part),
        ) + part


def _cut(block: bytes) -> list[bytes]:
    return [block[k : k + SEGMENT_BYTES] for k in range(0, len(block), SEGMENT_BYTES)]


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one record per row of ``pages`` (page_id, url, html) below ``path``.

    Of rows with equal payloads the one with the largest page_id is the response, the others revisit it. Rows that
    share this page_id, too, are all responses; a null page_id is smaller than any other, a null html is empty.
    """
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select("page_id", "url", "html", F.sha2(payload, 256).alias("key"))
    # One row per payload, combined before the shuffle.
    firsts = keyed.groupBy("key").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
    repeated = kept(firsts.filter("n > 1").select("key", "refers_to"), "payloads")
    joined = keyed.join(repeated.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key"), "left")
    revisit = F.col("_key").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("refers_to"))
    rows = joined.select("page_id", "url", "html", "refers_to", revisit.alias("revisit"))

    def records(batches):
        held, size = [], 0
        for batch in batches:
            for row in zip(*(batch.column(k).to_pylist() for k in range(5))):
                for record in page_records(*row):
                    held.append(record)
                    size += len(record)
                    if size >= BATCH_BYTES:
                        yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.binary())})
                        held, size = [], 0
        if held:
            yield pa.RecordBatch.from_pydict({"value": pa.array(held, pa.binary())})

    # The records are UTF-8 or cut pieces of it; the text writer passes their bytes on as they are.
    written = rows.mapInArrow(records, "value binary").select(F.col("value").cast("string"))
    (
        written.write.option("lineSep", END.decode()).option("compression", "gzip")
        .option("maxRecordsPerFile", RECORDS_PER_FILE).text(path)
    )


RECORD_TYPE = (
    "record_id string, record_type string, uri string, refers string, origin string, number int, total long,"
    " payload_digest string, payload_bytes long, block binary"
)


def parse_archive(data: bytes) -> Iterator[tuple]:
    """All records of one archive, found by their stated lengths."""
    at, end = 0, len(data)
    while at < end:
        if not data.startswith(VERSION, at):
            raise ValueError(f"no record at byte {at}")
        stop = data.index(END, at)
        lines = data[at + len(VERSION) : stop].decode("utf-8", "surrogatepass").split("\r\n")
        fields = {name.lower(): value for name, _, value in (line.partition(": ") for line in lines)}
        start, length = stop + len(END), int(fields["content-length"])
        block = data[start : start + length]
        if len(block) != length or data[start + length : start + length + len(END)] != END:
            raise ValueError(f"record at byte {at} is cut off")
        at = start + length + len(END)
        yield (
            fields["warc-record-id"], fields["warc-type"], fields.get("warc-target-uri"), fields.get("warc-refers-to"),
            fields.get("warc-segment-origin-id"), int(fields.get("warc-segment-number", 0)) or None,
            int(fields.get("warc-segment-total-length", 0)) or None,
            (fields.get("warc-payload-digest") or "").removeprefix("sha1:") or None,
            int(fields["warc-payload-length"]) if "warc-payload-length" in fields else None, block,
        )


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Every record of the archives below ``path``, segments as they are."""
    names = [part.split(" ")[0] for part in RECORD_TYPE.split(", ")]

    def parsed(frames):
        for frame in frames:
            for content in frame["content"]:
                data = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
                rows = []
                for record in parse_archive(data):
                    rows.append(record)
                    if len(rows) == 64:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
                if rows:
                    yield pd.DataFrame(rows, columns=names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInPandas(parsed, RECORD_TYPE)


PAGE_TYPE = (
    "page_id long, uri string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
)


PAGE_ARROW = pa.schema([
    ("page_id", pa.int64()), ("uri", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
    ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
])


def _page_id(record_id: str | None) -> int | None:
    number = (record_id or "").removeprefix("<urn:page:").split(":")[0]
    return int(number) if number else None


def page_of(record_id, record_type, uri, refers, payload_digest, payload_bytes, parts) -> tuple:
    """The page of one record, its parts put in order, verified and decoded."""
    if record_type == "revisit":
        return _page_id(record_id), uri, record_type, _page_id(refers), None, payload_bytes, payload_digest
    parts = sorted(parts, key=lambda part: part["number"])
    block = b"".join(part["block"] for part in parts)
    if [part["number"] for part in parts] != list(range(1, len(parts) + 1)):
        raise ValueError(f"{record_id}: segments are missing")
    if len({part["copies"] for part in parts}) != 1 or len(parts) > 1 and parts[-1]["total"] != len(block):
        raise ValueError(f"{record_id}: the segments do not have the stated total length")
    head, _, body = block.partition(END)
    payload = unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body
    if payload_digest is not None and digest(payload) != payload_digest:
        raise ValueError(f"{record_id}: the payload does not have the stated digest")
    return _page_id(record_id), uri, record_type, None, payload, len(payload), digest(payload)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per written page: page_id, uri, record_type, refers_to, payload (null for a revisit), payload_bytes, payload_digest.

    Only segmented records are shuffled. A repeated row of the pages has the same id and the same segments as its
    twin; they are combined by number before they meet, all numbers must come equally often, and the page comes
    back that often. So no group is longer than one page.
    """
    records = read_records(spark, path)
    one = F.array(F.struct(F.lit(1).alias("number"), "block", "total", F.lit(1).cast("bigint").alias("copies")))
    head = ["record_id", "record_type", "uri", "refers", "payload_digest", "payload_bytes"]
    single = records.filter("number IS NULL").select(*head, one.alias("parts"))
    about = F.struct(*head)
    segmented = (
        records.filter("number IS NOT NULL")
        .groupBy(F.coalesce("origin", "record_id").alias("whole"), "number")
        .agg(
            F.first("block").alias("block"), F.max("total").alias("total"), F.count(F.lit(1)).alias("copies"),
            F.max(F.when(F.col("number") == 1, about)).alias("about"),
        )
        .groupBy("whole")
        .agg(F.max("about").alias("about"), F.collect_list(F.struct("number", "block", "total", "copies")).alias("parts"))
        .select("about.*", "parts")
    )

    def decoded(batches):
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            rows = []
            for row in zip(*columns):
                rows += [page_of(*row)] * row[6][0]["copies"]
            yield pa.RecordBatch.from_pylist([dict(zip(PAGE_ARROW.names, r)) for r in rows], PAGE_ARROW)

    return single.unionByName(segmented).mapInArrow(decoded, PAGE_TYPE)


def archive_round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` to archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    write_archives(pages, path)
    return read_archives(spark, path)
