"""WARC archives: writing with segmentation and deduplication, and reassembly on reading.

The writer makes one record a row: a response with a chunked HTTP message, or a revisit that
refers to the response with the same payload. A record block over ``segment_bytes`` is split into
a first segment and continuation records, which may stand in any file. The reader parses the files
in parallel, groups continuation records by origin identifier, orders them by segment number,
verifies the total length, and decodes the chunked framing.

A record's payload is the largest unit that one task holds; files have a bounded number of
records, and of bytes. Records with equal payloads are never gathered: the largest id of a payload is a partial
aggregate, and its join with the rows can be split by adaptive execution.

Awkward input: a null payload is empty. Payloads under ``revisit_bytes`` never become revisits. A
null id is written as such; rows that share a payload and the largest id are all responses. Rows
equal in all columns give equal record identifiers: equal segments then count once, and the
record is returned once for each copy. An incomplete or damaged record (missing segment, wrong
total length, bad chunk framing, digest that differs or cannot be read, length or segment number that
is none, file that ends within it) is returned with ``complete`` false and no payload; reading goes on
at the next record. A SHA-1 digest may be in base 32 or hexadecimal; a digest of another kind is not
verified. An empty table gives an empty archive. Further columns are not read, whatever their names.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortrail.llm.shared import Store, text_batches, tidy


@dataclass(frozen=True)
class WarcParams:
    segment_bytes: int = 1 << 20
    chunk_bytes: int = 4096
    revisit_bytes: int = 1000
    records_per_file: int = 2000
    #: A file is read as one row, which may not have more than two gigabytes.
    file_bytes: int = 64 << 20
    date: str = "1970-01-01T00:00:00Z"

    @property
    def most_records(self) -> int:
        """Of a file: records have a segment and a few hundred bytes of headers."""
        return max(1, min(self.records_per_file, self.file_bytes // (self.segment_bytes + 4096)))


# Names of the formats.
_VERSION = b"WARC/1.1\r\n"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = (
    b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
)


def chunked(payload: bytes, size: int) -> bytes:
    parts = []
    for at in range(0, len(payload), size):
        piece = payload[at : at + size]
        parts += [b"%x\r\n" % len(piece), piece, b"\r\n"]
    return b"".join([*parts, b"0\r\n\r\n"])


def dechunked(body: bytes) -> bytes | None:
    """The payload of a chunked body, or None if its framing is broken."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            return None
        try:
            size = int(body[at:end].split(b";")[0], 16)
        except ValueError:
            return None
        at = end + 2
        if size == 0:
            return b"".join(parts)
        if size < 0 or body[at + size : at + size + 2] != b"\r\n":
            return None
        parts.append(body[at : at + size])
        at += size + 2


def _record(fields: list[tuple[str, object]], block: bytes) -> bytes:
    head = "".join(f"{name}: {value}\r\n" for name, value in fields if value is not None)
    return _VERSION + head.encode() + b"Content-Length: %d\r\n\r\n" % len(block) + block


def _digest_field(hexadecimal: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hexadecimal)).decode()


def _record_id(page_id: object, print_: int) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}:{print_ & ((1 << 64) - 1):016x}>"


def page_id_of(record_id):
    """The page id within a record identifier, as a column."""
    return F.expr(f"try_cast(regexp_extract({record_id}, '^<urn:page:(-?[0-9]+):', 1) as bigint)")


def _uri(url: str | None) -> str | None:
    """A header value must stay on one line."""
    return None if url is None else " ".join(url.split()) or None


def records_of(row: dict, params: WarcParams) -> list[bytes]:
    """The records of one page: a revisit, or a response and its continuations."""
    own = _record_id(row["page_id"], row["print"])
    common = [
        ("WARC-Record-ID", own),
        ("WARC-Date", params.date),
        ("WARC-Target-URI", _uri(row["url"])),
        ("WARC-Payload-Digest", _digest_field(row["digest"])),
    ]
    http = ("Content-Type", "application/http; msgtype=response")
    if row["first_page"] is not None and row["first_page"] != row["page_id"]:
        refers = _record_id(row["first_page"], row["first_print"])
        extra = [("WARC-Profile", _PROFILE), ("WARC-Refers-To", refers), http]
        return [_record([("WARC-Type", "revisit"), *common, *extra], _HTTP)]
    block = _HTTP + chunked(row["payload"], params.chunk_bytes)
    if len(block) <= params.segment_bytes:
        return [_record([("WARC-Type", "response"), *common, http], block)]
    out = []
    for at in range(0, len(block), params.segment_bytes):
        piece, number = block[at : at + params.segment_bytes], at // params.segment_bytes + 1
        if number == 1:
            fields = [("WARC-Type", "response"), *common, http]
        else:
            fields = [
                ("WARC-Type", "continuation"),
                ("WARC-Record-ID", f"{own[:-1]}:{number}>"),
                ("WARC-Date", params.date),
                ("WARC-Target-URI", _uri(row["url"])),
                ("WARC-Segment-Origin-ID", own),
            ]
        fields.append(("WARC-Segment-Number", number))
        if at + params.segment_bytes >= len(block):
            fields.append(("WARC-Segment-Total-Length", len(block)))
        out.append(_record(fields, piece))
    return out


def write_warc(pages: DataFrame, path: str, store: Store, params: WarcParams) -> None:
    """Write (page_id, url, html) as WARC files under ``path``."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload")
    ).withColumns(
        {"digest": F.sha1("payload"), "print": F.xxhash64("page_id", "url", "payload")}
    )
    repeated = store.keep(
        rows.where(F.octet_length("payload") >= params.revisit_bytes)
        .groupBy("digest")
        .agg(F.max(F.struct("page_id", "print")).alias("first"), F.count("*").alias("n"))
        .where("n > 1")
        .select(
            "digest",
            F.col("first.page_id").alias("first_page"),
            F.col("first.print").alias("first_print"),
        )
    )
    text_batches(pages.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for k in range(batch.num_rows):
                [row] = batch.slice(k, 1).to_pylist()
                records = records_of(row, params)
                held += records
                size += sum(map(len, records))
                if size > 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])
                    held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.binary())], names=["record"])

    # The text writer puts its separator after each row: here the two line ends that close a
    # record. Casting bytes to text leaves them as they are.
    (
        rows.join(repeated, "digest", "left")
        .mapInArrow(tidy(scan), "record binary")
        .select(F.col("record").cast("string").alias("value"))
        .write.mode("overwrite")
        .option("lineSep", "\r\n\r\n")
        .option("maxRecordsPerFile", params.most_records)
        .text(path)
    )


def _unzipped(data: bytes) -> bytes:
    """All gzip members of a file, as far as they can be read."""
    out = []
    while data[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(data))
        except zlib.error:
            break
        data = member.unused_data
    return b"".join(out)


def _number(text: str | None, most: int) -> int | None:
    """A decimal number up to ``most``, or None."""
    if not text or not re.fullmatch("[0-9]{1,19}", text):
        return None
    return int(text) if int(text) <= most else None


def parse_records(data: bytes) -> Iterator[tuple[dict[str, str], bytes | None]]:
    """Headers (lower-case names) and block of each record of a file, gzipped or not; the block is
    None if its length is no number or the file ends within it."""
    if data[:2] == b"\x1f\x8b":
        data = _unzipped(data)
    at = 0
    while (begin := data.find(b"WARC/", at)) >= 0:
        head_end = data.find(b"\r\n\r\n", begin)
        if head_end < 0:
            return
        lines = data[begin:head_end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        at = head_end + 4
        length = _number(headers.get("content-length", "0"), len(data) - at)
        yield headers, None if length is None else data[at : at + length]
        # Without a length the next record is where the next version stands.
        at += length or 0


def _sha1(header: str) -> str | None:
    """The hexadecimal form of a SHA-1 digest, None for one of another kind; what cannot be read
    stays as it is, and is equal to no payload's digest."""
    kind, _, value = header.rpartition(":")
    if not value or kind.lower() not in ("", "sha1", "sha-1"):
        return None
    if re.fullmatch("[0-9A-Fa-f]{40}", value):
        return value.lower()
    if re.fullmatch("[A-Za-z2-7]{32}", value):
        return base64.b32decode(value.upper()).hex()
    return value


PARTS = (
    "record_id string, record_type string, target_uri string, refers_to string, digest string, "
    "origin string, segment int, total bigint, block binary"
)


def _parts(files: DataFrame) -> DataFrame:
    """One row a record or segment; revisits and whole responses have no origin."""

    def row_of(headers: dict[str, str], block: bytes | None) -> tuple:
        kind, segment = headers.get("warc-type"), headers.get("warc-segment-number")
        own = headers.get("warc-record-id")
        origin = headers.get("warc-segment-origin-id", own) if segment else None
        number = _number(segment, (1 << 31) - 1)
        total = _number(headers.get("warc-segment-total-length"), (1 << 63) - 1)
        # A segment without a number or block stays with its record, which then is incomplete.
        if origin and (number is None or block is None):
            number = -1
        return (
            own, kind, headers.get("warc-target-uri"), headers.get("warc-refers-to"),
            _sha1(headers.get("warc-payload-digest", "")), origin, number, total, block,
        )

    types = [pa.string()] * 6 + [pa.int32(), pa.int64(), pa.binary()]
    names = [x.split()[0] for x in PARTS.split(", ")]

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        columns = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names
        )

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                rows, size = [], 0
                for headers, block in parse_records(batch["content"][k].as_py()):
                    if headers.get("warc-type") in ("response", "revisit", "continuation"):
                        rows.append(row_of(headers, block))
                        size += len(block or b"")
                    if size > 4 << 20:
                        yield batch_of(rows)
                        rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    return files.select("content").mapInArrow(tidy(scan), PARTS)


def reassemble(numbers: list[int], totals: list, blocks: list[bytes]) -> bytes | None:
    """The block of a record from its segments in any order; None if any is missing or differs
    from its copies, or if the total length is absent or wrong."""
    by_number: dict[int, bytes] = {}
    for number, block in zip(numbers, blocks, strict=True):
        if by_number.setdefault(number, block) != block:
            return None
    declared = {int(t) for t in totals if t is not None and t == t}
    whole = b"".join(by_number[k] for k in sorted(by_number))
    if sorted(by_number) != list(range(1, len(by_number) + 1)) or declared != {len(whole)}:
        return None
    return whole


def payload_of(block: bytes | None, digest: str | None) -> bytes | None:
    """The decoded payload of an HTTP block, if framing and digest are right."""
    if block is None:
        return None
    head, _, body = block.partition(b"\r\n\r\n")
    if b"transfer-encoding: chunked" in head.lower():
        body = dechunked(body)
    if body is None or (digest and hashlib.sha1(body).hexdigest() != digest):
        return None
    return body


DECODED = (
    "record_id string, record_type string, target_uri string, refers_to string, digest string, "
    "payload binary, complete boolean"
)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The response and revisit records under ``path``: DECODED columns; revisits have no payload."""
    parts = _parts(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))
    names = [x.split()[0] for x in DECODED.split(", ")]

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for block, digest, kind in zip(
                batch["block"], batch["digest"].to_pylist(), batch["record_type"].to_pylist(),
                strict=True,
            ):
                out.append(None if kind == "revisit" else payload_of(block.as_py(), digest))
            complete = [
                kind == "revisit" or x is not None
                for x, kind in zip(out, batch["record_type"].to_pylist(), strict=True)
            ]
            yield pa.RecordBatch.from_arrays(
                [batch[n] for n in names[:5]] + [pa.array(out, pa.binary()), pa.array(complete)],
                names=names,
            )

    def join_segments(group: pd.DataFrame) -> pd.DataFrame:
        first = group[group["segment"] == 1]
        if first.empty:
            first = group.head(1).assign(digest=None, record_type="response")
        block = reassemble(
            group["segment"].tolist(), group["total"].tolist(), group["block"].tolist()
        )
        digest = first["digest"].iloc[0]
        payload = payload_of(block, digest if isinstance(digest, str) else None)
        return first.assign(record_id=first["origin"], payload=payload, complete=payload is not None)[
            names
        ]

    whole = parts.where("origin is null").mapInArrow(tidy(decode), DECODED)
    segmented = parts.where("origin is not null").groupBy("origin")
    return whole.unionByName(segmented.applyInPandas(join_segments, DECODED))


def archive_round_trip(
    pages: DataFrame, params: WarcParams | None = None, store: Store | None = None
) -> DataFrame:
    """Pages written as WARC and read back: page_id, payload_bytes, payload_digest, record_type,
    refers_to and complete. A revisit takes its payload's length from the record it refers to."""
    params = params or WarcParams()
    spark = pages.sparkSession
    store = store or Store(spark, "warc")
    path = f"{store.folder}/warc"
    write_warc(pages, path, store, params)
    read = store.keep(
        read_warc(spark, path).select(
            page_id_of("record_id").alias("page_id"),
            F.octet_length("payload").cast("bigint").alias("payload_bytes"),
            F.coalesce("digest", F.sha1("payload")).alias("payload_digest"),
            "record_type",
            F.expr("try_cast(regexp_extract(refers_to, '<urn:page:(-?[0-9]+):', 1) as bigint)").alias(
                "refers_to"
            ),
            "complete",
        )
    )
    responses = read.where("record_type = 'response' and page_id is not null").select(
        F.col("page_id").alias("refers_to"),
        "payload_digest",
        F.col("payload_bytes").alias("first_bytes"),
        F.col("complete").alias("first_complete"),
    )
    responses = responses.groupBy("refers_to", "payload_digest").agg(
        F.max("first_bytes").alias("first_bytes"), F.max("first_complete").alias("first_complete")
    )
    revisits = (
        read.where("record_type = 'revisit'")
        .join(store.keep(responses), ["refers_to", "payload_digest"], "left")
        .select(
            "page_id", F.col("first_bytes").alias("payload_bytes"), "payload_digest",
            "record_type", "refers_to", F.coalesce("first_complete", F.lit(False)).alias("complete"),
        )
    )
    return read.where("record_type = 'response'").unionByName(revisits)
