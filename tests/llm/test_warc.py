from __future__ import annotations

import base64
import gzip
import hashlib
import random

import pytest
from cohortrail.llm.shared import Store
from cohortrail.llm.warc import (
    WarcParams,
    archive_round_trip,
    chunked,
    dechunked,
    parse_records,
    read_warc,
    reassemble,
    write_warc,
)

SMALL = WarcParams(segment_bytes=700, chunk_bytes=100, records_per_file=7)


def expected(rows) -> list:
    largest: dict = {}
    for page_id, _, html in rows:
        if page_id is not None:
            largest[html or ""] = max(page_id, largest.get(html or "", page_id))
    out = []
    for page_id, _, html in rows:
        data = (html or "").encode()
        first = largest.get(html or "")
        again = len(data) >= 1000 and first is not None and first != page_id
        out.append((page_id, len(data), hashlib.sha1(data).hexdigest(),
                    "revisit" if again else "response", first if again else None, True))
    return sorted(out, key=str)


def test_round_trip(spark):
    rng = random.Random(5)
    pool = ["é\r\n\r\nWARC/1.1\r\n" * 120, "x" * 999, "y" * 1000, "", "0\r\n\r\n" * 400]
    rows = [(k, f"http://h/{k}", rng.choice(pool) + rng.choice(["", str(k)])) for k in range(120)]
    rows += [(500, None, None), (501, "a\nb", ""), (7, "http://other", "z" * 5000)]
    rows += [(600, "u", "same" * 2000)] * 2 + [(None, "u", "q" * 3000)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    got = [tuple(r) for r in archive_round_trip(df.repartition(5), SMALL).collect()]
    want = expected(rows)
    assert sorted(set(got), key=str) == sorted(set(want), key=str)
    assert len(got) == len(want)


def test_payloads_survive_and_damage_shows(spark, tmp_path):
    rows = [(k, "u", ("é%d " % k) * 900) for k in range(5)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    path = str(tmp_path / "warc")
    write_warc(df.coalesce(1), path, Store(spark, "warc"), SMALL)
    read = {r.record_id.split(":")[2]: r for r in read_warc(spark, path).collect()}
    assert {k: r.payload.decode() for k, r in read.items()} == {str(k): t for k, _, t in rows}
    # Lose one whole segment, as if a file were missing; write the rest gzipped.
    [files] = [sorted((tmp_path / "warc").glob("part-*"))]
    records = [r for f in files for r in f.read_bytes().split(b"\r\n\r\nWARC/1.1\r\n")]
    assert len(records) > 10
    lost = next(k for k, r in enumerate(records) if b"Segment-Number: 3" in r and b"page:2:" in r)
    damaged = tmp_path / "damaged"
    damaged.mkdir()
    body = b"\r\n\r\nWARC/1.1\r\n".join(r for k, r in enumerate(records) if k != lost)
    (damaged / "a.warc.gz").write_bytes(gzip.compress(body))
    read = {r.record_id.split(":")[2]: r for r in read_warc(spark, str(damaged)).collect()}
    assert {k for k, r in read.items() if not r.complete} == {"2"} and len(read) == 5


def test_revisits_name_a_record_of_the_archive(spark, tmp_path):
    rows = [(k, f"http://h/{k}", "same" * 1000) for k in range(6)] + [(6, None, "other")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    write_warc(df, str(tmp_path / "warc"), Store(spark, "warc"), SMALL)
    read = read_warc(spark, str(tmp_path / "warc")).collect()
    whole = {r.record_id for r in read if r.record_type == "response"}
    referred = [r.refers_to for r in read if r.record_type == "revisit"]
    assert len(referred) == 5 and set(referred) <= whole and len(set(referred)) == 1


@pytest.mark.parametrize("payload", [b"", b"a", b"\r\n0\r\n\r\n" * 9, bytes(range(256)) * 5])
@pytest.mark.parametrize("size", [1, 7, 4096])
def test_chunked_framing(payload, size):
    assert dechunked(chunked(payload, size)) == payload


def test_broken_framing_and_segments():
    good = chunked(b"hello world", 4)
    assert all(dechunked(good[:n]) is None for n in range(len(good) - 4))
    assert dechunked(b"zz\r\n") is None
    assert reassemble([2, 1], [4, None], [b"cd", b"ab"]) == b"abcd"
    assert reassemble([2, 1, 1], [4, None, None], [b"cd", b"ab", b"ab"]) == b"abcd"
    assert reassemble([2, 1, 1], [4, None, None], [b"cd", b"ab", b"xx"]) is None
    assert reassemble([1, 3], [4, None], [b"ab", b"cd"]) is None
    assert reassemble([1, 2], [5, None], [b"ab", b"cd"]) is None
    assert reassemble([1], [None], [b"ab"]) is None
    assert list(parse_records(b"not an archive")) == []


def record(headers: dict, block: bytes) -> bytes:
    lines = [f"{k}: {v}" for k, v in {"Content-Length": len(block), **headers}.items()]
    return ("WARC/1.1\r\n" + "\r\n".join(lines)).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def test_bad_headers_make_incomplete_records_and_no_error(spark, tmp_path):
    body = b"HTTP/1.1 200 OK\r\n\r\npayload"
    sha1 = hashlib.sha1(b"payload")
    b32 = base64.b32encode(sha1.digest()).decode()

    def named(name, block=body, **headers):
        given = {k.replace("_", "-"): v for k, v in headers.items()}
        return record({"WARC-Type": "response", "WARC-Record-ID": name, **given}, block)

    good = {"b32": f"sha1:{b32}", "hex": f"sha1:{sha1.hexdigest().upper()}", "bare": b32.lower(),
            "foreign": "md5:ffff", "other": "sha256:xyz"}
    records = [named(k, WARC_Payload_Digest=v) for k, v in good.items()]
    records += [
        named("no-length", Content_Length="x1"), named("negative", Content_Length="-5"),
        named("huge", Content_Length="9" * 30), named("wrong-digest", WARC_Payload_Digest="sha1:!!"),
        named("no-number", WARC_Segment_Number="one"), named("big-number", WARC_Segment_Number="9" * 12),
        named("bad-total", WARC_Segment_Number="1", WARC_Segment_Total_Length="many"),
        named("whole", WARC_Segment_Number="1", WARC_Segment_Total_Length=str(len(body))),
        named("after"),
    ]
    records.append(named("cut-off", Content_Length="500"))
    (tmp_path / "a.warc").write_bytes(b"".join(records))
    data = gzip.compress(named("first")) + gzip.compress(named("second", b"HTTP/1.1 200 OK\r\n\r\n" + bytes(999)))
    (tmp_path / "b.warc.gz").write_bytes(data[:-30])
    (tmp_path / "c.warc.gz").write_bytes(b"\x1f\x8bnot gzip")
    (tmp_path / "d.warc").write_bytes(b"WARC/1.1\r\nContent-Length: 5")
    (tmp_path / "e.warc").write_bytes(b"")
    got = read_warc(spark, str(tmp_path)).collect()
    complete = {r.record_id: r.complete for r in got}
    assert len(got) == len(complete)
    whole = {*good, "whole", "after", "first"}
    assert {k for k, done in complete.items() if done} == whole
    assert {"no-length", "negative", "huge", "wrong-digest", "no-number", "big-number", "bad-total",
            "cut-off"} <= set(complete)
    assert all(bytes(r.payload) == b"payload" for r in got if r.complete)
    assert all(r.payload is None for r in got if not r.complete)
    assert {r.record_id: r.digest for r in got}["hex"] == sha1.hexdigest()


def test_files_are_bounded_in_bytes(spark, tmp_path):
    params = WarcParams(segment_bytes=1 << 20, file_bytes=3 << 20)
    assert params.most_records == 2 and WarcParams(segment_bytes=1 << 30).most_records == 1
    rows = [(k, None, f"{k}" * 900_000) for k in range(8)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    write_warc(df, str(tmp_path / "warc"), Store(spark, "warc"), params)
    sizes = [f.stat().st_size for f in (tmp_path / "warc").glob("part-*")]
    assert len(sizes) >= 4 and max(sizes) <= 3 << 20
    assert all(r.complete for r in read_warc(spark, str(tmp_path / "warc")).collect())


def test_empty_table(spark):
    df = spark.createDataFrame([], "page_id bigint, url string, html string, digest int")
    assert archive_round_trip(df).collect() == []
