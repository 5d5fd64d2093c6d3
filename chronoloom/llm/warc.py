"""WARC archives without repeated payloads.

Revisit resolution: headers (record id, payload digest, payload size), not payloads, are shuffled by
digest; of the records with equal payloads of at least LEAST bytes the one with the largest id stays a
response, and the others become revisit records that refer to it.  Archives are then written with
fresh headers, each record a gzip member of its own, and read back record by record.

Executors write files under the shared folder, each attempt of a task under names of its own, and
return those names; only files that the written manifest lists are read, so what a lost or repeated
attempt leaves behind is ignored.

Defined results: a null payload is empty, a null url leaves its header out; line breaks in a url are
taken out of its header; payloads below LEAST bytes are all responses; records that repeat the largest
id of their payload are all responses; records with a null id are revisits if another record with that
payload has an id, else responses; other columns are ignored; no rows give no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Tables, salted_join, shared_path

#: Payloads of fewer bytes are never revisits.
LEAST = 1000
#: Digests of repeated payloads that are broadcast at most; beyond, they are joined by a salted shuffle.
BROADCAST_ROWS = 100_000
#: Bytes after which a task begins another archive.
ROLL = 256 << 20
# Fixed value: the profile that the WARC standard names for revisits of an identical payload.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def resolve(headers: DataFrame, least: int = LEAST) -> DataFrame:
    """(digest, refers_to, refers_url): the response of every digest that more than one of (id, url, digest, bytes) has."""
    large = headers.where(F.col("bytes") >= least)
    seen = large.groupBy("digest").agg(F.max("id").alias("refers_to"), F.max_by("url", "id").alias("refers_url"), F.count("*").alias("copies"))
    return seen.where("copies > 1 and refers_to is not null").drop("copies")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, refers_url: str | None, revisit: bool, date: str) -> bytes:
    plain = lambda s: re.sub(r"[\r\n]+", "", s)
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {plain(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}")
    if revisit:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <urn:page:{refers_to}>"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {plain(refers_url)}")
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(4, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


def _open(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if re.match(r"[a-z][a-z0-9+.-]*:", uri) else f"file://{uri}")


def write_archives(records: DataFrame, folder: str, date: str) -> DataFrame:
    """Writes (id, url, payload, digest, refers_to, refers_url) as archives; a row (file, records) for each file of this attempt."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = _open(folder)
        system.create_dir(root, recursive=True)
        out, name, count, size = None, "", 0, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, payload, digest, refers_to, refers_url in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if out is None:
                    name, count, size = f"{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = system.open_output_stream(f"{root}/{name}", compression=None)
                revisit = refers_to is not None and page_id != refers_to
                packed = _member(_record(page_id, url, payload, digest, refers_to, refers_url, revisit, date))
                out.write(packed)
                count, size = count + 1, size + len(packed)
                if size >= ROLL:
                    out.close()
                    out = None
                    done.append((name, count))
        if out is not None:
            out.close()
            done.append((name, count))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done]), pa.array([d[1] for d in done], pa.int64())], names=["file", "records"])

    return records.select("id", "url", "payload", "digest", "refers_to", "refers_url").mapInArrow(run, "file string, records long")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an unpacked archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            raise ValueError("a record does not begin with its version")
        head = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            head[name.lower()] = value.strip()
        block = stream.read(int(head["content-length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record does not end where its length says")
        yield head, block


def read_archives(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """page_id, url, record_type, payload_bytes, payload_digest, refers_to (and payload, null for revisits) of every record in the files named in column file.

    The digest of each response's payload is computed again and must be that of its header.
    """
    columns = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
    names = [c.split()[0] for c in columns.split(", ")] + ["payload"] * payloads

    def number(uri: str | None) -> int | None:
        digits = re.fullmatch(r"<urn:page:(-?\d+)>", uri or "")
        return int(digits[1]) if digits else None

    def row(head: dict[str, str], block: bytes) -> tuple:
        http, _, payload = block.partition(b"\r\n\r\n")
        size = int(re.search(rb"(?im)^content-length:\s*(\d+)", http)[1])
        digest = base64.b32decode(head["warc-payload-digest"].removeprefix("sha1:")).hex()
        if head["warc-type"] == "response" and (len(payload) != size or hashlib.sha1(payload).hexdigest() != digest):
            raise ValueError(f"{head['warc-record-id']}: the payload is not what its headers say")
        own = (number(head["warc-record-id"]), head.get("warc-target-uri"), head["warc-type"], size, digest, number(head.get("warc-refers-to")))
        return own + ((payload if head["warc-type"] == "response" else None,) if payloads else ())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        system, root = _open(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                with system.open_input_stream(f"{root}/{name}", compression=None) as raw, gzip.open(raw) as stream:
                    some, held = [], 0
                    for head, block in _records(stream):
                        some.append(row(head, block))
                        held += len(block) if payloads else 256
                        if held >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=False)], names=names)
                            some, held = [], 0
                    if some:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), kinds, strict=False)], names=names)

    return files.select("file").mapInArrow(run, columns + ", payload binary" * payloads)


def deduplicated(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least: int = LEAST, date: str = "2024-01-01T00:00:00Z") -> tuple[DataFrame, str]:
    """Writes pages as archives; the manifest (file, records) and the folder of the files."""
    spark = pages.sparkSession
    tables = Tables(spark)
    payload = F.encode(F.coalesce(F.col(html_col).cast("string"), F.lit("")), "utf-8")
    records = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    records = records.withColumn("digest", F.sha1("payload")).withColumn("bytes", F.octet_length("payload"))
    originals = tables.keep(resolve(records.select("id", "url", "digest", "bytes"), least), "originals")
    if originals.count() <= BROADCAST_ROWS:
        joined = records.join(F.broadcast(originals), "digest", "left")
    else:
        joined = salted_join(records, originals, ["digest"], "id")
    folder = shared_path(spark, "archives")
    small = F.col("bytes") < least
    joined = joined.withColumn("refers_to", F.when(~small, F.col("refers_to")))
    return tables.keep(write_archives(joined, folder, date), "manifest"), folder
