"""WARC: writing of segmented archives, and reading with segment reassembly.

A row becomes an HTTP response with its payload in chunked transfer framing. A response record whose block is
longer than ``SEGMENT`` bytes is split: the first segment stays a response, the rest are continuation records that carry
WARC-Segment-Origin-ID and WARC-Segment-Number, the last with WARC-Segment-Total-Length. Of rows with equal payloads of
``LEAST`` bytes and more, that with the smallest key is the response, the others are revisit records without a payload; a
revisit holds its payload's digest and refers to the response's key.

Records are written by Spark's own text writer (any store, gzip), bounded in number for each file. The
reader takes the files as bytes, walks from record to record by Content-Length, groups segments by their origin, orders them by number,
verifies the total length and the payload digest, and decodes the framing. Revisits take the payload's size from the response
that they refer to.

Null payloads are empty; payloads under ``LEAST`` bytes are all responses. Rows that share key and payload, and hold the smallest
key, are all responses. Of equal payloads without any key, all are responses; a row without a key revisits a keyed one. Very long payloads are
segments of ``SEGMENT`` bytes; one payload at a time is put together. The key must be an integer or cast to one; other columns aren't read, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webloom.llm.common import fresh_dir, lean, materialise

LEAST = 100
SEGMENT = 1 << 16
PIECE = 1 << 13
#: Rows of records for each file: with SEGMENT a bound of a file's bytes.
FILE_RECORDS = 1000
#: Digests with copies up to which they are broadcast (under 100 bytes each).
BROADCAST = 100_000
_END = "\r\n\r\n"
_FIXED_DATE = "2024-01-01T00:00:00Z"


def chunked(payload: bytes, piece: int = PIECE) -> bytes:
    parts = [b"%x\r\n%s\r\n" % (len(payload[i : i + piece]), payload[i : i + piece]) for i in range(0, len(payload), piece)]
    return b"".join(parts) + b"0\r\n\r\n"


def unchunked(data: bytes) -> bytes:
    """The payload of chunked transfer framing; extensions and trailers are passed over."""
    out, at = [], 0
    while True:
        end = data.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunked framing ends early")
        n = int(data[at:end].split(b";")[0].strip(), 16)
        if n == 0:
            return b"".join(out)
        if end + 2 + n + 2 > len(data) or data[end + 2 + n : end + 4 + n] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(data[end + 2 : end + 2 + n])
        at = end + 4 + n


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the two line ends that close it."""
    head = [("WARC-Type", kind), ("WARC-Date", _FIXED_DATE), *fields, ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode("utf-8", "replace") + b"\r\n" + block


def records(key: int | None, url: str | None, payload: bytes, digest: str, origin: int | None, segment: int = SEGMENT) -> Iterator[bytes]:
    """The records of one row; origin: the key that a revisit refers to, else None."""
    own = f"<urn:uuid:{uuid.uuid4()}>"
    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    fields = [("WARC-Record-ID", own), ("WARC-Target-URI", safe), ("WARC-Page", "" if key is None else str(key)), ("WARC-Payload-Digest", f"sha256:{digest}"), ("Content-Type", "application/http;msgtype=response")]
    if origin is not None:
        more = [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To-Page", str(origin))]
        yield record("revisit", fields + more, b"HTTP/1.1 200 OK\r\nContent-Type: text/html\r\n\r\n")
        return
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    if len(block) <= segment:
        yield record("response", fields, block)
        return
    cuts = range(0, len(block), segment)
    for number, at in enumerate(cuts, 1):
        part = block[at : at + segment]
        if number == 1:
            yield record("response", [*fields, ("WARC-Segment-Number", "1")], part)
        else:
            last = [("WARC-Segment-Total-Length", str(len(block)))] if number == len(cuts) else []
            yield record("continuation", [("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Segment-Origin-ID", own), ("WARC-Segment-Number", str(number)), *last], part)


def write(pages: DataFrame, path: str, key: str = "page_id", url: str = "url", payload: str = "html", segment: int = SEGMENT) -> None:
    body = F.coalesce(F.col(payload).cast("binary"), F.lit(b""))
    rows = lean(pages).select(F.col(key).cast("long").alias("key"), F.col(url).cast("string").alias("url"), body.alias("payload"), F.sha2(body, 256).alias("digest"))
    long = F.length("payload") >= LEAST
    # digests and keys alone are shuffled for this
    origin = rows.where(long).groupBy("digest").agg(F.min("key").alias("origin"), F.count("*").alias("n")).where("n > 1 and origin is not null").select("digest", "origin")
    origin = materialise(origin)
    # while few payloads have copies, the payloads stay where they are read; else they are shuffled by digest
    joined = rows.join(F.broadcast(origin) if origin.count() <= BROADCAST else origin, "digest", "left")
    refers = F.when(long & ~F.col("key").eqNullSafe(F.col("origin")), F.col("origin"))

    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in parts:
            for at in range(0, b.num_rows, 64):
                p = b.slice(at, 64).to_pylist()
                yield pa.RecordBatch.from_pydict({"value": pa.array([x for r in p for x in records(r["key"], r["url"], r["payload"], r["digest"], r["refers"], segment)], pa.binary())})

    sent = joined.select("key", "url", F.when(refers.isNull(), F.col("payload")).otherwise(F.lit(b"")).alias("payload"), "digest", refers.alias("refers"))
    lines = sent.mapInArrow(run, "value binary").select(F.col("value").cast("string").alias("value"))
    lines.write.option("lineSep", _END).option("compression", "gzip").option("maxRecordsPerFile", FILE_RECORDS).text(path)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields in lower case, block) of each record of an archive, which may be gzip with one or more members."""
    if data[:2] == b"\x1f\x8b":
        out = []
        while data:
            z = zlib.decompressobj(31)
            out.append(z.decompress(data) + z.flush())
            data = z.unused_data
        data = b"".join(out)
    at = 0
    while at < len(data):
        if data[at : at + 2] == b"\r\n":
            at += 2
            continue
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or data[at : at + 5] != b"WARC/":
            raise ValueError(f"no record at byte {at}")
        lines = data[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        n = int(fields["content-length"])
        if end + 4 + n > len(data):
            raise ValueError("a record is cut short")
        yield fields, data[end + 4 : end + 4 + n]
        at = end + 4 + n


def http_payload(block: bytes) -> bytes:
    head, _, body = block.partition(b"\r\n\r\n")
    return unchunked(body) if b"transfer-encoding: chunked" in head.lower() else body


_SEGMENT = "origin string, number int, total long, kind string, key long, url string, digest string, refers long, payload_bytes long, part binary"


def _read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each segment; the payload of a record in one piece is digested here and not passed on."""
    whole = lambda x: int(x) if x else None
    for b in parts:
        for content in b.column(0):
            rows = []
            for f, block in parse(content.as_py()):
                kind = f.get("warc-type")
                if kind not in ("response", "revisit", "continuation"):
                    continue
                row = {"origin": f.get("warc-segment-origin-id", f["warc-record-id"]), "number": int(f.get("warc-segment-number", 1)), "total": whole(f.get("warc-segment-total-length")), "kind": kind, "key": whole(f.get("warc-page")), "url": f.get("warc-target-uri"), "digest": f.get("warc-payload-digest", "").removeprefix("sha256:") or None, "refers": whole(f.get("warc-refers-to-page")), "payload_bytes": None, "part": None}
                if kind == "response" and "warc-segment-number" not in f:
                    payload = http_payload(block)
                    if hashlib.sha256(payload).hexdigest() != row["digest"]:
                        raise ValueError(f"the digest of {row['origin']} doesn't fit its payload")
                    row["payload_bytes"] = len(payload)
                elif kind != "revisit":
                    row["part"] = block
                rows.append(row)
            kinds = {"number": pa.int32(), "total": pa.int64(), "key": pa.int64(), "refers": pa.int64(), "payload_bytes": pa.int64(), "part": pa.binary()}
            yield pa.RecordBatch.from_pydict({c: pa.array([r[c] for r in rows], kinds.get(c, pa.string())) for c in ("origin", "number", "total", "kind", "key", "url", "digest", "refers", "payload_bytes", "part")})


def _join_segments(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in parts:
        for r in b.to_pylist():
            seg = sorted(r["parts"], key=lambda x: x["number"])
            block = b"".join(x["part"] for x in seg)
            if [x["number"] for x in seg] != list(range(1, len(seg) + 1)) or r["total"] != len(block):
                raise ValueError(f"segments of {r['origin']} are missing or don't have the total length")
            payload = http_payload(block)
            if hashlib.sha256(payload).hexdigest() != r["digest"]:
                raise ValueError(f"the digest of {r['origin']} doesn't fit its payload")
            yield pa.RecordBatch.from_pydict({"key": pa.array([r["key"]], pa.int64()), "url": pa.array([r["url"]]), "digest": pa.array([r["digest"]]), "payload_bytes": pa.array([len(payload)], pa.int64()), "payload": pa.array([payload], pa.binary())})


def read(spark: SparkSession, path: str) -> DataFrame:
    """key, url, payload_bytes, payload_digest, record_type, refers_to of each record, segments put together."""
    found = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, _SEGMENT)
    found = materialise(found)
    cut = found.where("part is not null").groupBy("origin").agg(F.max("total").alias("total"), F.max("key").alias("key"), F.max("url").alias("url"), F.max("digest").alias("digest"), F.collect_list(F.struct("number", "part")).alias("parts"))
    joined = cut.mapInArrow(_join_segments, "key long, url string, digest string, payload_bytes long, payload binary")
    one = found.where("kind = 'response' and part is null").select("key", "url", "payload_bytes", "digest")
    response = one.unionByName(joined.select("key", "url", "payload_bytes", "digest"))
    revisit = found.where("kind = 'revisit'").select("key", "url", "digest", "refers")
    # only responses that something refers to are joined
    wanted = revisit.select("refers", "digest").distinct()
    size = response.join(wanted.withColumnRenamed("digest", "digest_"), (F.col("key") == F.col("refers")) & (F.col("digest") == F.col("digest_"))).groupBy("refers", F.col("digest").alias("same")).agg(F.max("payload_bytes").alias("payload_bytes"))
    size = size.withColumnRenamed("refers", "to")
    back = revisit.join(size, (F.col("refers") == F.col("to")) & (F.col("digest") == F.col("same")), "left")
    out = ["key", "url", "payload_bytes", F.col("digest").alias("payload_digest")]
    return response.select(*out, F.lit("response").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(
        back.select(*out, F.lit("revisit").alias("record_type"), F.col("refers").alias("refers_to"))
    )


def round_trip(pages: DataFrame, key: str = "page_id", segment: int = SEGMENT) -> DataFrame:
    """Writes the rows' archives into the shared folder and reads them back."""
    spark = pages.sparkSession
    path = fresh_dir(spark, "warc")
    write(pages, path, key, segment=segment)
    return read(spark, path).withColumnRenamed("key", key)
