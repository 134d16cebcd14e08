"""WARC archives of pages: writing with revisits and segments, reading with reassembly.

Writing: equal payloads of at least ``SHARED`` bytes are stored once, by the row with the smallest id; others
become revisit records that refer to it. A block is an HTTP response in chunked transfer coding; blocks over ``SEGMENT``
bytes continue in further records. Files come from Spark's text writer, whose line separator is the end of a
WARC record, so they lie wherever Spark can write.

Reading: files come through Spark's binary reader and are parsed record by record. Records with
a segment number are grouped by the id of their origin, put in order of their numbers and joined; the numbers
must be whole and the length that of WARC-Segment-Total-Length. Then the chunked framing is decoded.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize

SHARED = 100
SEGMENT = 16_384
CHUNK = 4096
PER_FILE = 2000  # records, each of SEGMENT bytes at most besides its header
END = b"\r\n\r\n"
HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "2024-01-01T00:00:00Z"  # a fixed value: the tables have no fetch times


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = (payload[at : at + size] for at in range(0, len(payload), size))
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """Payload of a chunked body; chunk extensions and trailers are skipped. ValueError where the framing breaks."""
    out, at = [], 0
    while True:
        line = body.find(b"\r\n", at)
        if line < 0:
            raise ValueError("chunk size is missing")
        text = body[at:line].split(b";")[0].strip()
        if not text or text.strip(b"0123456789abcdefABCDEF"):
            raise ValueError("chunk size is no hexadecimal number")
        n, at = int(text, 16), line + 2
        if not n:
            if body.endswith(END) or body[at:] == b"\r\n":
                return b"".join(out)
            raise ValueError("end of the last chunk is missing")
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("chunk is shorter or longer than its size")
        out.append(body[at : at + n])
        at += n + 2


def payload_of(block: bytes) -> bytes:
    """Payload of an HTTP response block."""
    head, _, body = block.partition(END)
    fields = dict(x.split(":", 1) for x in head.decode("latin-1").lower().split("\r\n")[1:] if ":" in x)
    return dechunked(body) if fields.get("transfer-encoding", "").strip() == "chunked" else body


def record(fields: dict, block: bytes) -> bytes:
    """A WARC record without the blank lines after it."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items() if v is not None)
    return f"WARC/1.1\r\n{lines}Content-Length: {len(block)}\r\n\r\n".encode() + block


def _name(row: int) -> str:
    return f"<urn:row:{row}>"


def _records(segment: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row, page, url, payload, digest, first in pdf[["row", "page_id", "url", "payload", "digest", "first"]].itertuples(index=False):
                uri = None if url is None else url.replace("\r", "%0D").replace("\n", "%0A")
                base = {
                    "WARC-Record-ID": _name(row), "WARC-Date": DATE, "WARC-Target-URI": uri,
                    "Content-Type": "application/http; msgtype=response", "X-Page-ID": None if pd.isna(page) else int(page), "WARC-Payload-Digest": f"sha256:{digest}",
                }
                if not pd.isna(first):
                    out.append(record({"WARC-Type": "revisit", **base, "WARC-Profile": PROFILE, "WARC-Refers-To": _name(int(first))}, HEAD))
                    continue
                block = HEAD + chunked(payload)
                parts = [block[at : at + segment] for at in range(0, len(block), segment)]
                if len(parts) == 1:
                    out.append(record({"WARC-Type": "response", **base}, block))
                    continue
                out.append(record({"WARC-Type": "response", **base, "WARC-Segment-Number": 1}, parts[0]))
                for n, part in enumerate(parts[1:], 2):
                    last = len(block) if n == len(parts) else None
                    fields = {"WARC-Type": "continuation", "WARC-Record-ID": f"<urn:row:{row}:{n}>", "WARC-Date": DATE, "WARC-Target-URI": uri}
                    fields |= {"WARC-Segment-Origin-ID": _name(row), "WARC-Segment-Number": n, "WARC-Segment-Total-Length": last}
                    out.append(record(fields, part))
                if len(out) > 500:
                    yield pd.DataFrame({"record": out})
                    out = []
            yield pd.DataFrame({"record": out})

    return run


def write(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT) -> None:
    """Write a record for each row of ``pages``, a revisit where a row with a smaller id has the same payload.

    Null payloads are empty, null URLs are left out. A null id comes after all others. Rows with equal
    ids and payloads are told apart by their place in the table as written; other columns are not read.
    """
    payload = F.encode(F.coalesce(F.col(html), F.lit("")), "UTF-8")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"))
    rows = materialize(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("digest", F.sha2("payload", 256)), "pages")
    order = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row")
    shared = rows.filter(F.length("payload") >= SHARED)
    first = materialize(shared.groupBy("digest").agg(F.min(order).alias("o"), F.count("*").alias("n")).filter("n > 1").select("digest", F.col("o.row").alias("first")), "first")
    # Only ids and digests of the large payloads meet their group here.
    later = materialize(shared.select("row", "digest").join(first, "digest").filter("row <> first").select("row", "first"), "later")
    records = rows.join(later, "row", "left").mapInPandas(_records(segment), "record binary")
    records.select(F.col("record").cast("string")).write.option("lineSep", END.decode()).option("maxRecordsPerFile", PER_FILE).option("compression", "gzip").text(path)


def parse(stream: io.BufferedIOBase) -> Iterator[tuple[dict, bytes]]:
    """(header fields in lower case, block) of each record. ValueError where a record is damaged."""
    while True:
        line = stream.readline()
        while line == b"\r\n":
            line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("record does not begin with its version")
        fields = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"]) if fields.get("content-length", "").isdigit() else -1
        block = stream.read(max(n, 0))
        if n < 0 or len(block) < n:
            raise ValueError("block is shorter than its length")
        yield fields, block


SEGMENTS = (
    "record_id string, type string, origin string, number int, total long, page_id long, url string,"
    " digest string, refers_to string, block binary, problem string"
)


def _parsed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    names = [x.split()[0] for x in SEGMENTS.split(", ")]
    for pdf in batches:
        for content in pdf["content"]:
            raw = io.BytesIO(content)
            stream = io.BufferedReader(gzip.GzipFile(fileobj=raw)) if content[:2] == b"\x1f\x8b" else raw
            out, held = [], 0
            try:
                for f, block in parse(stream):
                    number = lambda k: int(f[k]) if f.get(k, "").lstrip("-").isdigit() else None  # noqa: B023, E731
                    segment = number("warc-segment-number")
                    own = f.get("warc-record-id")
                    out.append(
                        (own, f.get("warc-type"), f.get("warc-segment-origin-id", own) if segment else None, segment, number("warc-segment-total-length"),
                         number("x-page-id"), f.get("warc-target-uri"), f.get("warc-payload-digest"), f.get("warc-refers-to"), block, None)
                    )
                    held += len(block)
                    if held > 1 << 23:
                        yield pd.DataFrame(out, columns=names)
                        out, held = [], 0
            except (ValueError, EOFError, OSError) as exc:
                out.append((*[None] * 10, str(exc)))
            yield pd.DataFrame(out, columns=names)


def _decoded(blocks: pd.Series) -> pd.DataFrame:
    out = []
    for block in blocks:
        try:
            out.append((None if block is None else payload_of(block), None))
        except ValueError as exc:
            out.append((None, str(exc)))
    return pd.DataFrame(out, columns=["payload", "problem"])


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per whole record: record_id, type, page_id, url, digest, refers_to, payload, problem.

    ``payload`` is decoded and null where ``problem`` says what is wrong: a damaged record (the rest of that file
    is not read), a missing or repeated segment, a total length that differs, broken chunk framing, or a continuation
    without its origin. Revisits have no payload of their own.
    """
    segments = spark.read.format("binaryFile").load(path).select("content").mapInPandas(_parsed, SEGMENTS)
    facts = ["type", "page_id", "url", "digest", "refers_to"]
    whole = segments.filter("number is null").select("record_id", *facts, F.when(F.col("type") != "revisit", F.col("block")).alias("block"), "problem")
    # One record's segments meet; the largest record bounds the group.
    parts = (
        segments.filter("number is not null")
        .groupBy("origin")
        .agg(
            F.array_sort(F.collect_list(F.struct("number", "block"))).alias("parts"),
            F.max("total").alias("total"),
            *(F.max(F.when(F.col("number") == 1, F.col(c))).alias(c) for c in facts),
        )
    )
    numbers = F.transform("parts", lambda x: x["number"])
    joined = parts.withColumn("block", F.unhex(F.array_join(F.transform("parts", lambda x: F.hex(x["block"])), "")))
    joined = joined.withColumn(
        "problem",
        F.when(numbers != F.sequence(F.lit(1), F.size("parts")), "segments are missing or repeated")
        .when(F.col("total").isNull(), "last segment is missing")
        .when(F.length("block") != F.col("total"), "total length differs"),
    )
    joined = joined.select(F.col("origin").alias("record_id"), *facts, F.when(F.col("problem").isNull(), F.col("block")).alias("block"), "problem")
    out = whole.unionByName(joined).withColumn("d", F.pandas_udf(_decoded, "payload binary, problem string")("block"))
    return out.select("record_id", *facts, F.col("d.payload").alias("payload"), F.coalesce("problem", "d.problem").alias("problem"))


def resolved(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to): revisits take size and digest from what they refer to."""
    facts = records.select("record_id", "type", "page_id", F.col("refers_to").alias("target"), F.length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_digest"))
    facts = materialize(facts, "facts")
    own = facts.filter("type = 'response'")
    stored = own.select(F.col("record_id").alias("target"), F.col("page_id").alias("refers_to"), "payload_bytes", "payload_digest")
    revisits = facts.filter("type = 'revisit'").select("page_id", "type", "target").join(stored, "target", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), "refers_to"]
    return own.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(revisits.select(*columns))
