"""WARC archives: a writer of one gzip member per record and a sequential reader."""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import RID, kept_numbers, new_path, partitions, stored

DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PIECE = 1 << 20  # bytes that the reader asks for or unpacks at once
HEAD = 1 << 24  # bytes that a record's header may have


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def member(name: str, url: str | None, payload: bytes, payload_digest: str, refers_to: str | None) -> bytes:
    """One record as a gzip member; refers_to makes it a revisit, which has the HTTP head but no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http + (payload if refers_to is None else b"")
    lines = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <{name}>", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + "".join(c if c.isprintable() and c != " " else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{refers_to}>"]
    lines += [f"WARC-Payload-Digest: sha1:{payload_digest}", f"WARC-Block-Digest: sha1:{digest(block)}", "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


def records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header, block) of each record of a stream, read from front to back, a piece at a time."""
    waiting = b""
    while waiting or (waiting := stream.read(PIECE)):
        unpack, text, head, end = zlib.decompressobj(31), bytearray(), None, None
        while not unpack.eof:
            if not waiting and not (waiting := stream.read(PIECE)):
                raise ValueError("archive ends within a record")
            text += unpack.decompress(waiting, PIECE)
            waiting = unpack.unconsumed_tail or unpack.unused_data
            if head is None and (at := text.find(b"\r\n\r\n")) >= 0:
                first, *rest = bytes(text[:at]).decode().split("\r\n")
                if not first.startswith("WARC/"):
                    raise ValueError(f"not a record: {first[:40]!r}")
                head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in rest)}
                begin = at + 4
                end = begin + int(head["content-length"])
            elif head is None and len(text) > HEAD:
                raise ValueError("a record's header has no end")
            if end is not None and len(text) > end + 4:
                raise ValueError("record is longer than its content length")
        if end is None or bytes(text[end:]) != b"\r\n\r\n":
            raise ValueError("record doesn't end where its content length says")
        yield head, bytes(text[begin:end])


def parsed(head: dict[str, str], block: bytes) -> tuple[str, str | None, int, str, str, str | None, bytes]:
    """Record id, URI, payload's length, payload's digest, type, refers-to id and payload; checks both digests."""
    if head["warc-block-digest"] != f"sha1:{digest(block)}":
        raise ValueError(f"block digest differs in {head['warc-record-id']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    claimed = head["warc-payload-digest"].removeprefix("sha1:")
    size = int(next(x.split(b":")[1] for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:")))
    if head["warc-type"] == "response" and (digest(payload) != claimed or size != len(payload)):
        raise ValueError(f"payload digest differs in {head['warc-record-id']}")
    bare = lambda k: head[k].strip("<>") if k in head else None
    return bare("warc-record-id"), head.get("warc-target-uri"), size, claimed, head["warc-type"], bare("warc-refers-to"), payload


def write(pages: DataFrame, least: int = 0, most_bytes: int = 64 << 20, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record per row to archives in the shared folder and returns their list (path, records, bytes).

    Of records with equal payloads of at least `least` bytes the one with the smallest id (null last, then the first read)
    is a response and the others revisit it; smaller ones are responses. Only ids and digests are grouped. A task that runs
    again writes new files; the list has those of the run that counted. Null html is an empty payload; null URLs are left out.
    """
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    html = F.coalesce(F.col(html_col), F.lit("")).cast("binary")
    pages = kept_numbers(pages)
    keyed = stored(pages.select(RID, F.col(id_col).alias("id"), F.sha1(html).alias("digest"), F.octet_length(html).alias("n")), "payloads")
    large = keyed.filter(F.col("n") >= least)
    first = large.groupBy("digest").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", RID)).alias("first"))
    name = lambda number, row: F.concat(F.lit("urn:page:"), F.coalesce(number.cast("string"), F.lit("null")), F.lit(":"), row.cast("string"))
    again = large.join(first, "digest").filter(F.col(RID) != F.col(f"first.{RID}")).select(RID, name(F.col("first.id"), F.col(f"first.{RID}")).alias("refers_to"))
    rows = pages.select(RID, name(F.col(id_col), F.col(RID)).alias("name"), F.col(url_col).cast("string").alias("url"), html.alias("html"))
    rows = rows.join(again, RID, "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, sizes = None, "", [0, 0]
        fs, at = pyarrow.fs.FileSystem.from_uri(folder)
        fs.create_dir(at, recursive=True)
        done = lambda: pa.RecordBatch.from_arrays([pa.array([path]), pa.array([sizes[0]], pa.int64()), pa.array([sizes[1]], pa.int64())], names=["path", "records", "bytes"])
        for batch in batches:
            for row in range(batch.num_rows):
                name, url, html, refers_to = (batch.column(c)[row].as_py() for c in ("name", "url", "html", "refers_to"))
                if out is None:
                    path, sizes = f"{folder}/{uuid.uuid4().hex}.warc.gz", [0, 0]
                    out = fs.open_output_stream(f"{at}/{path.rsplit('/', 1)[1]}", compression=None)
                data = member(name, url, html, digest(html), refers_to)
                out.write(data)
                sizes = [sizes[0] + 1, sizes[1] + len(data)]
                if sizes[1] >= most_bytes:
                    out.close()
                    yield done()
                    out = None
        if out is not None:
            out.close()
            yield done()

    return stored(rows.mapInArrow(run, "path string, records long, bytes long"), "archives")


def read(archives: DataFrame, payload: bool = False) -> DataFrame:
    """record_id, url, payload_bytes, payload_digest, record_type, refers_to (and payload, if asked for) of every record.

    Each archive is read once, sequentially, by one task, which holds a record at a time and checks framing and digests;
    a damaged archive raises ValueError.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["record_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"][: 7 if payload else 6]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in zip(range(len(names)), kinds)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                fs, at = pyarrow.fs.FileSystem.from_uri(path)
                rows, size = [], 0
                with fs.open_input_stream(at, compression=None) as stream:
                    for head, block in records(stream):
                        rows.append(parsed(head, block)[: len(names)])
                        size += 200 + len(block) * payload
                        if size > 4 << 20:
                            yield batch_of(rows)
                            rows, size = [], 0
                if rows:
                    yield batch_of(rows)

    kinds = "record_id string, url string, payload_bytes long, payload_digest string, record_type string, refers_to string" + ", payload binary" * payload
    return archives.repartition(partitions(archives.sparkSession), "path").select("path").mapInArrow(run, kinds)


def round_trip(pages: DataFrame, least: int = 0, **columns) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type and refers_to as read back from the archives that write() makes."""
    name = columns.get("id_col", "page_id")
    kind = pages.schema[name].dataType
    number = lambda c: F.nullif(F.regexp_extract(c, "(?s)^urn:page:(.*):[0-9]+$", 1), F.lit("null")).cast(kind)
    return read(write(pages, least, **columns)).select(number("record_id").alias(name), "payload_bytes", "payload_digest", "record_type", F.when(F.col("refers_to").isNotNull(), number("refers_to")).alias("refers_to"))
