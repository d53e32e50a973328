"""WARC archives: one gzip member a record, revisits for equal payloads, and a sequential reader.

Archives lie in a folder that all executors reach by pyarrow.fs (a local or
mounted path, or hdfs, s3 and gs addresses where pyarrow has the client).
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomrow.llm._shared import parallelism, text_or_empty

#: An archive is closed after the record that fills it so far, in compressed bytes.
ROLL_BYTES = 128 << 20
_READ = 1 << 18
_URI = "urn:x-page:"
_END = b"\r\n\r\n"

ARCHIVES = T.StructType([T.StructField("path", T.StringType()), T.StructField("records", T.LongType()), T.StructField("bytes", T.LongType())])
RECORDS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("position", T.LongType()),
        T.StructField("page_id", T.LongType()),
        T.StructField("record_type", T.StringType()),
        T.StructField("target_uri", T.StringType()),
        T.StructField("refers_to", T.LongType()),
        T.StructField("payload_bytes", T.LongType()),
        T.StructField("payload_digest", T.StringType()),
        T.StructField("payload", T.BinaryType()),
    ]
)


def _sha1(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """One record, uncompressed: the payload as an HTTP response, or for a revisit that response's head alone."""
    name = lambda i: f"<{_URI}{'' if i is None else i}>"
    target = re.sub(r"[^!-~]", lambda m: "".join(f"%{b:02X}" for b in m[0].encode()), url) if url else name(page_id)[1:-1]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {date}", f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: {_sha1(payload)}", f"WARC-Block-Digest: {_sha1(block)}"]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + _END + block + _END


def gzip_member(data: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def members(stream: BinaryIO) -> Iterator[bytes]:
    """The gzip members of a stream, each inflated as its bytes come."""
    raw = stream.read(_READ)
    while raw:
        inflate, parts = zlib.decompressobj(31), []
        while not inflate.eof:
            if not raw and not (raw := stream.read(_READ)):
                raise ValueError("the archive ends within a member")
            parts.append(inflate.decompress(raw))
            raw = inflate.unused_data
        yield b"".join(parts)
        raw = raw or stream.read(_READ)


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields (lower case) and block of a record, framed by its content length; digests are verified."""
    at = data.index(_END)
    version, *lines = data[:at].decode().split("\r\n")
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = int(fields["content-length"])
    block, rest = data[at + 4 : at + 4 + size], data[at + 4 + size :]
    if not version.startswith("WARC/1.") or len(block) != size or rest != _END:
        raise ValueError("a record isn't framed as its length says")
    if _sha1(block) != fields["warc-block-digest"]:
        raise ValueError(f"block digest of {fields['warc-record-id']} differs")
    return fields, block


def read_archive(stream: BinaryIO) -> Iterator[dict]:
    """The records of an archive, in order."""
    number = lambda x: int(x[len(_URI) + 1 : -1]) if x and len(x) > len(_URI) + 2 else None
    for data in members(stream):
        fields, block = parse(data)
        head, _, payload = block.partition(_END)
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", head)[1])
        revisit = fields["warc-type"] == "revisit"
        if not revisit and (len(payload) != size or _sha1(payload) != fields["warc-payload-digest"]):
            raise ValueError(f"payload of {fields['warc-record-id']} differs from its digest")
        yield {
            "page_id": number(fields["warc-record-id"]),
            "record_type": fields["warc-type"],
            "target_uri": fields["warc-target-uri"],
            "refers_to": number(fields.get("warc-refers-to")) if revisit else None,
            "payload_bytes": size,
            "payload_digest": base64.b32decode(fields["warc-payload-digest"][5:]).hex(),
            "payload": None if revisit else payload,
        }


def write_archives(pages: DataFrame, folder: str, *, least: int = 1000, date: str = "1970-01-01T00:00:00Z", roll: int = ROLL_BYTES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Writes a record for each row when it runs; rows path, records, bytes, one for each archive.

    Of rows whose payloads (html in UTF-8, null: empty) are equal and have
    `least` bytes or more, those with the largest id are responses, the others
    revisits of it; a null id is smaller than any, and if all are null all are
    responses. Repeated rows are written each. Null and odd urls are written as
    a page's own name and percent-encoded. Other columns are ignored, whatever
    their names. No rows write nothing. A payload of any length is one record,
    which is made and read whole, so a task's memory bounds it.

    Each attempt of a task writes names of its own, and only archives of
    attempts that succeed are in the result: run again after a loss, none is
    read twice.
    """
    payload = text_or_empty(html_col).cast("binary")
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "size": F.octet_length("payload")})
    # keepers meet their digests without payloads; payloads then go by id and digest, so that a common one is spread
    large = rows.filter(F.col("size") >= least)
    again = large.groupBy("digest", "size").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1 and keeper is not null").drop("n")
    revisits = large.select("page_id", "digest", "size").join(again, ["digest", "size"]).filter(~F.col("page_id").eqNullSafe(F.col("keeper"))).select(F.col("page_id").alias("id"), F.col("digest").alias("of"), F.col("size").alias("bytes"), "keeper").distinct()
    same = F.col("page_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")) & (F.col("size") == F.col("bytes"))
    written = lambda df, keeper: df.select("page_id", "url", "payload", keeper.alias("refers_to"), keeper.isNotNull().alias("revisit"))
    placed = written(large.join(revisits, same, "left"), F.col("keeper")).unionByName(written(rows.filter(F.col("size") < least), F.lit(None).cast("long")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, top = fs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        out, path, n, size = None, "", 0, 0

        def done() -> pa.RecordBatch:
            out.close()
            return pa.RecordBatch.from_arrays([pa.array([f"{folder.rstrip('/')}/{path}"]), pa.array([n], pa.int64()), pa.array([size], pa.int64())], names=ARCHIVES.names)

        for batch in batches:
            for page_id, url, data, refers_to, again_ in zip(*batch.columns, strict=True):
                if out is None:
                    path, n, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = store.open_output_stream(f"{top.rstrip('/')}/{path}", compression=None)
                raw = gzip_member(record(page_id.as_py(), url.as_py(), data.as_py(), refers_to.as_py(), again_.as_py(), date))
                out.write(raw)
                n, size = n + 1, size + len(raw)
                if size >= roll:
                    yield done()
                    out = None
        if out is not None:
            yield done()

    return placed.mapInArrow(run, ARCHIVES)


def read_archives(archives: DataFrame, *, with_payload: bool = True) -> DataFrame:
    """Rows of RECORDS for the archives in column path; each is read by one task, record by record.

    position counts an archive's records from 0. payload is null for revisits
    and without with_payload. An archive that is cut off, ill framed or differs
    from its digests raises ValueError. Null paths are passed over.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        schema = pa.schema([("path", pa.string()), ("position", pa.int64()), ("page_id", pa.int64()), ("record_type", pa.string()), ("target_uri", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])
        for batch in batches:
            for path in batch.column(0).to_pylist():
                store, name = fs.FileSystem.from_uri(path)
                with store.open_input_stream(name, compression=None) as stream:
                    held, size = [], 0
                    for i, r in enumerate(read_archive(stream)):
                        size += r["payload_bytes"]
                        held.append(r | {"path": path, "position": i} | ({} if with_payload else {"payload": None}))
                        if size > 16 << 20 or len(held) >= 4096:
                            yield pa.RecordBatch.from_pylist(held, schema)
                            held, size = [], 0
                    if held:
                        yield pa.RecordBatch.from_pylist(held, schema)

    paths = archives.select("path").filter("path is not null")
    return paths.repartition(parallelism(paths.sparkSession), "path").mapInArrow(run, RECORDS)
