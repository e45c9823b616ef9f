"""WARC archives: a writer with revisit records and a splittable gzip reader.

Writer: one gzip member a record, one archive a task, written to the shared folder under a temporary
name and moved into place, so a repeated task replaces its own file only.

Reader: an archive is cut into byte ranges without reading it. A task scans its range for the gzip
magic, accepts a candidate whose first decoded bytes are a WARC header, and owns the records that
start inside its range, reading past its end to finish the last one. After a record the next member
starts where the last one ended, so the scan never walks through compressed data again.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_fs, materialize

MAGIC = b"\x1f\x8b\x08"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD_SCHEMA = ("record_id string, record_type string, target_uri string, refers_to string, payload_digest string, "
                 "payload_bytes long, payload binary, path string, offset long")
ARROW_SCHEMA = pa.schema([("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
                          ("refers_to", pa.string()), ("payload_digest", pa.string()), ("payload_bytes", pa.int64()),
                          ("payload", pa.binary()), ("path", pa.string()), ("offset", pa.int64())])
CHUNK = 1 << 18


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_urn(page_id) -> str:
    return f"<urn:page:{'' if page_id is None else page_id}>"


def encode_record(page_id, url: str | None, payload: bytes, sha1_hex: str, refers_to: str | None, date: str) -> bytes:
    """One gzip member holding a response record, or a revisit record if ``refers_to`` is given."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to else http + payload
    head = [f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: {record_urn(page_id)}",
            f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(sha1_hex)).decode()}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=':/?#[]@!$&()*+,;=%~')}")
    if refers_to:
        head += [f"WARC-Refers-To: {refers_to}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(["WARC/1.0", *head, "", ""]).encode() + block + b"\r\n\r\n") + z.flush()


def decode_record(data: bytes) -> dict:
    """Fields of a decoded member; the payload is what follows the HTTP header."""
    head, sep, rest = data.partition(b"\r\n\r\n")
    if not sep:
        raise ValueError("WARC record without end of header")
    fields = {}
    for line in head.decode("utf-8").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        fields[k.strip().lower()] = v.strip()
    block = rest[:int(fields["content-length"])]
    if len(block) != int(fields["content-length"]):
        raise ValueError("WARC record shorter than its Content-Length")
    http, sep, payload = block.partition(b"\r\n\r\n") if "application/http" in fields.get("content-type", "") else (b"", b"", block)
    size, revisit = len(payload), fields.get("warc-type") == "revisit"
    if revisit:  # the payload is in another record; its length is that of the HTTP header
        size = next((int(x.split(b":")[1]) for x in http.lower().split(b"\r\n") if x.startswith(b"content-length:")), None)
    return {"record_id": fields.get("warc-record-id"), "record_type": fields.get("warc-type"),
            "target_uri": fields.get("warc-target-uri"), "refers_to": fields.get("warc-refers-to"),
            "payload_digest": fields.get("warc-payload-digest", "").removeprefix("sha1:") or None if revisit else base32_sha1(payload),
            "payload_bytes": size, "payload": None if revisit else payload}


def _member(f, offset: int) -> tuple[bytes, int] | None:
    """(decoded member, offset behind it) if a WARC record starts at ``offset``, else None."""
    z, out, f_pos = zlib.decompressobj(31), [], offset
    f.seek(offset)
    checked, step = False, 1 << 12
    while not z.eof:
        raw = f.read(step)
        if not raw:
            if checked:
                raise ValueError(f"truncated WARC record at byte {offset}")
            return None
        f_pos += len(raw)
        try:
            out.append(z.decompress(raw))
        except zlib.error:
            if checked:
                raise
            return None
        if not checked and (z.eof or sum(map(len, out)) >= 7):
            if not b"".join(out).startswith(b"WARC/1."):
                return None
            checked, step = True, CHUNK
    return b"".join(out), f_pos - len(z.unused_data)


def scan_range(f, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(offset, decoded record) of every record that starts in [start, end)."""
    pos = start
    while pos < end:
        f.seek(pos)
        window = f.read(min(CHUNK, end - pos) + len(MAGIC) - 1)
        at = window.find(MAGIC)
        if at < 0:
            pos += max(1, len(window) - len(MAGIC) + 1)
            continue
        pos += at
        if pos >= end:
            return
        found = _member(f, pos)
        if found is None:
            pos += 1
            continue
        yield pos, found[0]
        pos = found[1]


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
                  min_bytes: int = 0) -> DataFrame:
    """(id, url, payload, sha1, refers_to): ``refers_to`` is the record that holds an equal payload already."""
    p = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"),
                     F.coalesce(F.col(f"`{payload_col}`").cast("binary"), F.lit(b"")).alias("payload"))
    p = p.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # copies are counted before they are shuffled; the joined side has one row a payload
    first = p.groupBy("sha1", "size", "id").agg(F.count("*").alias("rows")).groupBy("sha1", "size").agg(
        F.min_by(F.struct("id", "rows"), F.struct(F.col("id").isNull(), "id")).alias("first"))
    first = materialize(first, "first")  # a plain table on both sides lets AQE split the join at a hot payload
    j = p.join(first, ["sha1", "size"])
    own = F.col("id").eqNullSafe(F.col("first.id"))
    urn = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("first.id").cast("string"), F.lit("")), F.lit(">"))
    out = j.select("id", "url", "payload", "sha1", F.when(own | (F.col("size") < min_bytes), F.lit(None)).otherwise(urn)
                   .alias("refers_to"), (own & (F.col("first.rows") > 1) & (F.col("size") >= min_bytes)).alias("tied"), urn.alias("urn"))
    if first.where("first.rows > 1").limit(1).count():  # repeated rows: one of them is the response
        from pyspark.sql import Window
        nth = F.row_number().over(Window.partitionBy("sha1", "id").orderBy("url"))
        tied = out.where("tied").withColumn("refers_to", F.when(nth > 1, F.col("urn")))
        out = out.where("NOT tied").unionByName(tied)
    return out.drop("tied", "urn")


def write_warc(pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               min_bytes: int = 0, date: str = "1970-01-01T00:00:00Z") -> DataFrame:
    """Write a record per row as ``part-*.warc.gz`` in ``folder``, a URI that all executors reach; returns
    the written manifest (path, records, bytes).

    Payload: UTF-8 bytes of a string column or the bytes of a binary one, null: empty. Of records with
    equal payloads of at least ``min_bytes`` bytes the one with the smallest id is a response and the
    others are revisits of it; smaller payloads are all responses. Of rows that repeat that smallest id
    one is the response; a null id counts as the largest; a null url leaves the target out; other
    columns are not read; an empty table writes no archive.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = arrow_fs(folder)
        name = f"part-{TaskContext.get().partitionId():06d}.warc.gz"
        draft, out, n = f"{root}/_draft/{name}-{uuid.uuid4().hex}", None, 0
        for b in batches:
            for i, url, payload, sha1, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    store.create_dir(f"{root}/_draft", recursive=True)
                    out = store.open_output_stream(draft)
                out.write(encode_record(i, url, payload, sha1, refers, date))
                n += 1
        if out is not None:
            size = out.tell()
            out.close()
            store.move(draft, f"{root}/{name}")
            yield pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "records": [n], "bytes": [size]})

    marked = mark_revisits(pages, id_col, url_col, payload_col, min_bytes)
    return materialize(marked.mapInArrow(write, "path string, records long, bytes long"), "warc-manifest")


def read_warc(spark: SparkSession, archives: DataFrame, split_bytes: int = 8 << 20, with_payload: bool = True) -> DataFrame:
    """Records of ``archives`` (path string, bytes long), in ranges of ``split_bytes``.

    Columns as in ``RECORD_SCHEMA``; ``payload_digest`` is computed from a response's payload and taken
    from the header of a revisit; the payload is null for revisits, or for all if not ``with_payload``.
    Bytes between records that decode to no WARC header are skipped; a record cut short raises.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, end in zip(*(c.to_pylist() for c in b.columns)):
                store, name = arrow_fs(path)
                rows, held = [], 0
                with store.open_input_file(name) as f:
                    for offset, data in scan_range(f, start, end):
                        row = decode_record(data) | {"path": path, "offset": offset}
                        if not with_payload:
                            row["payload"] = None
                        rows.append(row)
                        held += len(data) if with_payload else 256
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=ARROW_SCHEMA)

    splits = archives.where("bytes > 0").select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("bytes") - 1, F.lit(split_bytes).cast("long")))
                                                .alias("start"), "bytes")
    splits = splits.select("path", "start", F.least(F.col("start") + split_bytes, "bytes").alias("end"))
    n = splits.count()
    return splits.repartition(max(1, min(n, 100_000)), "path", "start").mapInArrow(scan, RECORD_SCHEMA)


def list_archives(spark: SparkSession, folder: str) -> DataFrame:
    """(path, bytes) of the archives of a folder, without reading them."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder) \
        .select("path", F.col("length").alias("bytes"))
