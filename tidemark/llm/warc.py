"""Deterministic sharded WARC writer and reader.

Records are range-sorted by page_id; each task rolls its files by compressed size, writes them under temporary
names and renames them when they are whole. The files' own manifest is a Parquet table that is written last: only
what it lists counts, so files of lost or repeated tasks are never read. A rerun gives the same files byte for
byte, since dates, record ids and gzip headers hold nothing of the run.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm.common import scratch, shared_dir, spread_join, written

MANIFEST = "file string, n_records long, n_bytes long, first_page_id long, last_page_id long, sha256 string"
READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary, file string, record_offset long, block_ok boolean"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC/1.1 record, headers and digests made anew; a revisit holds the HTTP headers only."""
    digest, head = sha1_base32(payload), HTTP % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [("WARC-Type", "revisit" if refers_to is not None else "response"), ("WARC-Record-ID", f"<{uuid.uuid5(uuid.NAMESPACE_OID, f'{page_id} {digest} {url}').urn}>"), ("WARC-Date", date)]
    if url is not None:
        fields.append(("WARC-Target-URI", "".join(url.splitlines())))
    if refers_to is not None:
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("X-Refers-To-Page-Id", str(refers_to))]
    if page_id is not None:
        fields.append(("X-Page-Id", str(page_id)))
    fields += [("Content-Type", "application/http; msgtype=response"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("X-Payload-Length", str(len(payload))), ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", str(len(block)))]
    return ("WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n").encode() + block + b"\r\n\r\n"


def _gzip(data: bytes, level: int) -> bytes:
    z = zlib.compressobj(level, zlib.DEFLATED, 31)  # no name, no time
    return z.compress(data) + z.flush()


def _writer(folder: str, roll_bytes: int, level: int, date: str):
    def write(batches):
        store, top = fs.FileSystem.from_uri(folder)
        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        store.create_dir(f"{top}/tmp", recursive=True)
        store.create_dir(f"{top}/data", recursive=True)
        out, done, n = None, [], 0

        def close():
            nonlocal out
            if out:
                out["stream"].close()
                store.move(out["tmp"], f"{top}/data/{out['name']}")
                done.append((out["name"], out["n"], out["bytes"], out["first"], out["last"], out["sha"].hexdigest()))
                out = None

        refers: list[int] = []  # of the page at hand: its revisit marks stand before its rows
        at = None
        for b in batches:
            for page_id, kind, url, html, refer in zip(*(b.column(i).to_pylist() for i in range(5))):
                if page_id != at:
                    refers, at = [], page_id
                if kind == 0:
                    refers.append((refer, url))
                    continue
                payload = html or b""
                digest = sha1_base32(payload)
                target = next((r for r, d in refers if d == digest), None)
                data = _gzip(record(page_id, url, payload, target, date), level)
                if out and out["bytes"] + len(data) > roll_bytes:
                    close()
                if not out:
                    name = f"part-{part:06d}-{n:06d}.warc.gz"
                    tmp = f"{top}/tmp/{name}.{attempt}"
                    out, n = {"name": name, "tmp": tmp, "stream": store.open_output_stream(tmp, compression=None), "n": 0, "bytes": 0, "first": page_id, "sha": hashlib.sha256()}, n + 1
                out["stream"].write(data)
                out["sha"].update(data)
                out |= {"n": out["n"] + 1, "bytes": out["bytes"] + len(data), "last": page_id}
        close()
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done) if done else [[]] * 6, (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["file", "n_records", "n_bytes", "first_page_id", "last_page_id", "sha256"])

    return write


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, refers_to, digest hex) of each page whose payload a larger page_id holds too. A narrow aggregate with map-side
    combine finds each digest's keeper and how many pages have it; a payload of very many pages (empty ones, error pages) is
    joined where its pages are."""
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("b")).where("page_id is not null").select("page_id", F.sha1("b").alias("digest"))
    p = written(p, "warc-digests")
    keep = p.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.min("page_id").alias("least"), F.count("*").alias("weight")).where("least < refers_to").drop("least")
    return spread_join(p, written(keep, "warc-keepers"), "digest", p.count()).where("page_id < refers_to").select("page_id", "refers_to", "digest")


def _base32(hex_digest):
    """Lower-case hex SHA-1 to base32: 160 bits are 32 digits of 5 bits, as two halves of 80 bits in steps of 20."""
    alphabet = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    groups = [F.conv(F.substring(hex_digest, 5 * i + 1, 5), 16, 10).cast("long") for i in range(8)]
    return F.concat(*[F.substring(alphabet, (F.shiftright(g, 15 - 5 * k).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1)) for g in groups for k in range(4)])


def write_warc(pages: DataFrame, folder: str | None = None, roll_bytes: int = 32 << 20, level: int = 4, partitions: int | None = None, date: str = "1970-01-01T00:00:00Z") -> str:
    """Writes ``pages`` (page_id, url, html) as WARC files and returns the folder.

    Null html is an empty payload; null url leaves out the target; null page_id rows are written first, as
    responses; rows that repeat a page_id are written each, and those with the keeper's id are responses. An empty
    table gives an empty manifest. Other columns are ignored.
    """
    spark = pages.sparkSession
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    with scratch(spark):
        r = revisits(pages).select("page_id", F.lit(0).alias("kind"), _base32(F.col("digest")).alias("url"), F.lit(None).cast("binary").alias("html"), "refers_to")
        p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.lit(1).alias("kind"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").cast("binary").alias("html"), F.lit(None).cast("long").alias("refers_to"))
        n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
        # only page_id deals the rows, so a page and its marks share a task; url and payload order repeated ids
        sorted_rows = p.union(r).repartitionByRange(n, "page_id").sortWithinPartitions("page_id", "kind", "url", "html")
        sorted_rows.mapInArrow(_writer(folder, roll_bytes, level, date), MANIFEST).write.parquet(f"{folder}/manifest")
    return folder


def read_records(stream) -> list:
    """Yields (offset, fields, block) of a gzip-per-record WARC stream, one record in memory at a time."""
    offset, rest = 0, b""
    while True:
        z, parts, used = zlib.decompressobj(31), [], 0
        while not z.eof:
            chunk = rest or stream.read(1 << 20)
            rest = b""
            if not chunk:
                if parts or used:
                    raise ValueError(f"cut record at {offset}")
                return
            parts.append(z.decompress(chunk))
            used += len(chunk) - len(z.unused_data)
        rest = z.unused_data
        head, _, body = b"".join(parts).partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
        yield offset, fields, body[: int(fields["Content-Length"])]
        offset += used


def _reader(folder: str, with_payload: bool):
    def read(batches):
        store, top = fs.FileSystem.from_uri(folder)
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.bool_())
        names = [x.split()[0] for x in READ.split(", ")]
        for b in batches:
            for name in b.column(0).to_pylist():
                rows, held = [], 0
                with store.open_input_stream(f"{top}/data/{name}", compression=None) as stream:
                    for offset, f, block in read_records(stream):
                        payload = block.partition(b"\r\n\r\n")[2] if f["WARC-Type"] == "response" else None
                        number = lambda k: int(f[k]) if k in f else None  # noqa: B023, E731
                        ok = f["WARC-Block-Digest"] == f"sha1:{sha1_base32(block)}" and (payload is None or f["WARC-Payload-Digest"] == f"sha1:{sha1_base32(payload)}")
                        digest = sha1_base32(payload) if payload is not None else f["WARC-Payload-Digest"][5:]
                        rows.append((number("X-Page-Id"), f.get("WARC-Target-URI"), f["WARC-Type"], len(payload) if payload is not None else number("X-Payload-Length"), digest, number("X-Refers-To-Page-Id"), payload if with_payload else None, name, offset, ok))
                        held += len(block) * with_payload + 200
                        if held > 8 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return read


def read_warc(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """The records of every file that the manifest lists; block_ok tells whether the digests hold."""
    files = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest").select("file")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(n, "file").mapInArrow(_reader(folder, with_payload), READ)
