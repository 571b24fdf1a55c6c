"""WARC archives: writing, the normaliser of monolithic gzip files, and reading back.

An archive that is one gzip stream cannot be entered in the middle. The
normaliser inflates such a stream once, in blocks of bounded size, cuts it into
records, and rewrites each as a gzip member of its own; a sidecar index (one JSON
object a line) holds the offset and length of every page's member. Archives are
streamed from and to the shared folder, so a task holds a block and a record,
never an archive. They are rolled at a bounded size, written under a name of the
attempt and then renamed, so a task that is run again leaves whole files; only
those of attempts that were committed are read.
"""

from __future__ import annotations

import base64
import hashlib
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import keep, new_path, small, tidy

#: Bytes of records after which a new archive begins.
ROLL = 16 << 20
BLOCK = 1 << 20
#: Rows of a batch of records that are read.
ROWS = 1_000
#: Archives that one task reads, about.
ARCHIVES = 16
BROADCAST_ROWS = 500_000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _id(page_id: int | None, payload_digest: str | None) -> str:
    """The record id of a page's response, which revisits name too; without an id one of its own."""
    own = uuid.uuid4() if page_id is None else uuid.uuid5(uuid.NAMESPACE_URL, f"page:{page_id}:{payload_digest}")
    return f"<urn:uuid:{own}>"


def _uri(url: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)


def _record(head: list[str], block: bytes) -> bytes:
    head = ["WARC/1.1", *head, f"WARC-Block-Digest: sha1:{digest(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def information(name: str, date: str) -> bytes:
    """The record that opens an archive."""
    head = ["WARC-Type: warcinfo", f"WARC-Record-ID: <urn:uuid:{uuid.uuid4()}>", f"WARC-Date: {date}", f"WARC-Filename: {name}", "Content-Type: application/warc-fields"]
    return _record(head, b"software: quillframe\r\nformat: WARC File Format 1.1\r\n")


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str = "1970-01-01T00:00:00Z", refers_url: str | None = None) -> bytes:
    """One WARC record; a revisit has the HTTP header only, and names the response by id, address and date."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    own, again = digest(payload), refers_to is not None
    head = [f"WARC-Type: {'revisit' if again else 'response'}", f"WARC-Record-ID: {_id(None if again else page_id, own)}", f"WARC-Date: {date}"]
    if page_id is not None:
        head.append(f"Page-ID: {page_id}")
    if url is not None:
        head.append(f"WARC-Target-URI: {_uri(url)}")
    head.append(f"WARC-Payload-Digest: sha1:{own}")
    if again:
        head += [f"WARC-Profile: {_PROFILE}", f"Refers-To-Page-ID: {refers_to}", f"WARC-Refers-To: {_id(refers_to, own)}", f"WARC-Refers-To-Date: {date}"]
        if refers_url is not None:
            head.append(f"WARC-Refers-To-Target-URI: {_uri(refers_url)}")
    return _record([*head, "Content-Type: application/http; msgtype=response"], http if again else http + payload)


def headers(raw: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in raw.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, _, v in pairs if k}


def split_records(chunks: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records from the inflated stream, holding one at a time."""
    held = bytearray()
    need = None
    for chunk in chunks:
        held += chunk
        while True:
            if need is None:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                need = end + 4 + int(headers(bytes(held[:end]))["content-length"]) + 4
            if len(held) < need:
                break
            yield bytes(held[:need])
            del held[:need]
            need = None
    if held:
        raise ValueError(f"the archive ends within a record, {len(held)} bytes after its start")


def inflate(source: Iterator[bytes] | bytes, block: int = BLOCK) -> Iterator[bytes]:
    """The bytes of a gzip file of one or many members, at most ``block`` at a time, whatever they pack to.

    A file that ends within a member, its trailer included, is an error.
    """
    stream, within = zlib.decompressobj(31), False
    for rest in [source] if isinstance(source, bytes) else source:
        full = False
        while rest or full:
            out = stream.decompress(rest, block)
            within = not stream.eof
            full = within and len(out) == block
            rest = stream.unconsumed_tail if within else stream.unused_data
            if not within:
                stream = zlib.decompressobj(31)
            if out:
                yield out
    if within:
        raise ValueError("the archive ends within a gzip member")


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The store and the place in it of a path as Spark writes it."""
    return fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def _blocks(path: str) -> Iterator[bytes]:
    store, place = opened(path)
    with store.open_input_stream(place, compression=None) as f:
        while block := f.read(BLOCK):
            yield block


def records_of(path: str) -> Iterator[bytes]:
    """The records of an archive, streamed from its store."""
    return split_records(inflate(_blocks(path)))


def _member(raw: bytes) -> bytes:
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(raw) + packer.flush()


class _File:
    """A file written under another name in the same folder, then given its own."""

    def __init__(self, path: str):
        self.store, self.place = opened(path)
        self.store.create_dir(self.place.rpartition("/")[0], recursive=True)
        self.trial = f"{self.place}.{uuid.uuid4().hex}.part"
        self.out = self.store.open_output_stream(self.trial, compression=None)
        self.write = self.out.write

    def close(self) -> None:
        self.out.close()
        self.store.move(self.trial, self.place)


def with_kinds(pages: DataFrame, least: int = 0) -> DataFrame:
    """(page_id, url, html, refers_to, refers_url). Of pages with equal payloads of at least ``least`` bytes the largest page_id is kept; the others refer to it.

    Payloads are equal if their SHA-256 and sizes are. A null html is empty. Rows that repeat the largest id stay
    whole, rows with a null id refer to it; where all ids are null, nothing refers. Further columns are not read.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"))
    rows = rows.withColumn("sha", F.when(F.octet_length("html") >= least, F.sha2(F.col("html").cast("binary"), 256)))
    tops = rows.where("sha is not null").groupBy("sha").agg(F.max("page_id").alias("top"), F.max(F.struct("page_id", "url"))["url"].alias("top_url"), F.count("*").alias("n"))
    both = rows.join(small(keep(tops.where("n > 1").select("sha", "top", "top_url"), "payloads"), BROADCAST_ROWS), "sha", "left")
    again = F.col("page_id").isNull() | (F.col("page_id") < F.col("top"))
    return both.select("page_id", "url", "html", F.when(again, F.col("top")).alias("refers_to"), F.when(again, F.col("top_url")).alias("refers_url"))


def write_archives(pages: DataFrame, folder: str, roll: int = ROLL, date: str | None = None) -> DataFrame:
    """Writes the rows of ``with_kinds`` as archives of one gzip stream each; returns (path, records), the records of pages. ``date`` is that of all records, by default now."""
    date = date or datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def run(batches):
        out, done = None, []
        for batch in batches:
            for row in zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "html", "refers_to", "refers_url"))):
                page_id, url, html, to, to_url = row
                if out is None:
                    path, size, count = f"{folder}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out, packer = _File(path), zlib.compressobj(1, zlib.DEFLATED, 31)
                    out.write(packer.compress(information(path.rpartition("/")[2], date)))
                raw = record(page_id, url, html.encode(), to, date, to_url)
                out.write(packer.compress(raw))
                size, count = size + len(raw), count + 1
                if size >= roll:
                    out.write(packer.flush())
                    out.close()
                    done.append((path, count))
                    out = None
        if out is not None:
            out.write(packer.flush())
            out.close()
            done.append((path, count))
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in done], pa.string()), pa.array([n for _, n in done], pa.int64())], names=["path", "records"])

    return keep(pages.mapInArrow(tidy(run), "path string, records long"), "archives")


def _dealt(files: DataFrame) -> DataFrame:
    """The paths of archives, a few a task."""
    paths = files.select("path")
    tasks = max(min(n := paths.count(), 2 * paths.sparkSession.sparkContext.defaultParallelism), -(-n // ARCHIVES), 1)
    return paths.repartition(tasks, "path")


def normalise(files: DataFrame, folder: str) -> DataFrame:
    """Rewrites the archives of a column ``path`` record by record into ``folder``; returns (path, index, records).

    The sidecar ``<path>.idx`` has a JSON object for every page's record: offset, length, type, page_id, digest.
    Records that open an archive are rewritten too, and not indexed. Each attempt gives its files another name.
    """

    def rewritten(source: str) -> tuple[str, str, int]:
        name = source.rpartition("/")[2].removesuffix(".warc.gz")
        path, at, count = f"{folder}/{name}-{uuid.uuid4().hex[:8]}.warc.gz", 0, 0
        out, index = _File(path), _File(f"{path}.idx")
        for raw in records_of(source):
            h, packed = headers(raw[: raw.find(b"\r\n\r\n")]), _member(raw)
            if h["warc-type"] != "warcinfo":
                entry = {"offset": at, "length": len(packed), "type": h["warc-type"], "page_id": int(h["page-id"]) if "page-id" in h else None, "digest": h.get("warc-payload-digest", "").removeprefix("sha1:")}
                index.write(f"{json.dumps(entry)}\n".encode())
                count += 1
            out.write(packed)
            at += len(packed)
        index.close()
        out.close()
        return path, f"{path}.idx", count

    def run(batches):
        for batch in batches:
            for source in batch.column("path").to_pylist():
                path, index, count = rewritten(source)
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([index]), pa.array([count], pa.int64())], names=["path", "index", "records"])

    return keep(_dealt(files).mapInArrow(tidy(run), "path string, index string, records long"), "normalised")


def parse(raw: bytes) -> dict:
    """What a record says of its page, with the payload's own size and digest where it has one."""
    end = raw.find(b"\r\n\r\n")
    h = headers(raw[:end])
    block = raw[end + 4 : end + 4 + int(h["content-length"])]
    inner = block.find(b"\r\n\r\n")
    body = block[inner + 4 :] if inner >= 0 else b""
    whole = h["warc-type"] == "response"
    size = headers(block[:inner]).get("content-length") if inner >= 0 else None
    return {
        "page_id": int(h["page-id"]) if "page-id" in h else None,
        "payload_bytes": len(body) if whole else int(size) if size else None,
        "payload_digest": digest(body) if whole else h.get("warc-payload-digest", "").removeprefix("sha1:"),
        "record_type": h["warc-type"],
        "refers_to": int(h["refers-to-page-id"]) if "refers-to-page-id" in h else None,
        "url": h.get("warc-target-uri"),
        "payload": body if whole else None,
    }


_READ = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def read_archives(files: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every response and revisit in the archives of a column ``path``."""
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64())

    def run(batches):
        rows = []
        names = [part.split()[0] for part in _READ.split(", ")]
        packed = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in zip(names, kinds)], names=names)
        for batch in batches:
            for path in batch.column("path").to_pylist():
                for raw in records_of(path):
                    if (got := parse(raw))["record_type"] in ("response", "revisit"):
                        rows.append({k: got[k] for k in names})
                    if len(rows) == ROWS:
                        yield packed()
                        rows = []
        yield packed()

    return _dealt(files).mapInArrow(tidy(run), _READ)


def fetch(path: str, offset: int, length: int) -> dict:
    """One record by the sidecar's offset and length."""
    store, place = opened(path)
    with store.open_input_file(place) as f:
        f.seek(offset)
        return parse(zlib.decompress(f.read(length), 31))


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """The archives of a folder, whoever wrote them: (path, content, ...). Only their paths are read where no content is asked for."""
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(folder)


def round_trip(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes monolithic archives, normalises them, and reads the records back, one row a page: (page_id, payload_bytes, payload_digest, record_type, refers_to).

    Only archives in the tables of committed tasks are read, so a task that is run again counts once. An
    empty table has no archives and gives no rows. Rows that repeat are pages of their own; null ids,
    addresses and htmls as in ``with_kinds``; further columns, of any name, are not read.
    """
    spark = pages.sparkSession
    raw, own = new_path(spark, "warc-raw"), new_path(spark, "warc")
    return read_archives(normalise(write_archives(with_kinds(pages, least), raw), own))
