"""WARC archives with revisit records, and a two-level capture index: compressed sorted blocks under a sparse directory."""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import arrow, parts, read, scratch, table

#: Bytes after which a task begins another archive; lines of an index block; compression of both.
ARCHIVE_BYTES, BLOCK_LINES, LEVEL = 256 << 20, 500, 3
DATE = "1970-01-01T00:00:00Z"
NULL_ID = -(1 << 63)
URL = re.compile(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/@?#]*@)?([^/?#]*)([^#]*)")


def surt(url: str | None) -> str:
    """Reversed-host key: ``com,example,www)/path?query``; lower-case host, without scheme, user, default port, fragment."""
    if not url:
        return ""
    m = URL.match(url.strip())
    if not m:
        return quote(url, safe="!$&'()*+,;=:@/?%[]~")
    host = re.sub(r":(80|443)?$", "", m[1].lower())
    name, _, port = host.partition(":")
    return ",".join(reversed(name.split("."))) + (f":{port}" if port else "") + ")" + quote(m[2] or "/", safe="!$&'()*+,;=:@/?%[]~")


def storage(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a folder and its path there: any that pyarrow opens (local, hdfs, s3, gs)."""
    if re.match(r"[a-z0-9+]+:/(?!/)", root):
        root = re.sub(r":/+", ":///", root, count=1)
    return pafs.FileSystem.from_uri(root) if "://" in root else (pafs.LocalFileSystem(), root)


def base32(sha1: bytes) -> str:
    return base64.b32encode(sha1).decode()


def gz(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
    return c.compress(data) + c.flush()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers: int | None, is_revisit: bool, copy: int) -> bytes:
    """One WARC/1.1 record. A revisit keeps the HTTP header (with the full length) and leaves out the payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if is_revisit else http + payload
    uid = hashlib.md5(f"{page_id}/{digest}/{copy}".encode()).hexdigest()
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if is_revisit else 'response'}",
        f"WARC-Record-ID: <urn:uuid:{uid[:8]}-{uid[8:12]}-{uid[12:16]}-{uid[16:20]}-{uid[20:]}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe='!$&()*+,;=:@/?#%[]~' + chr(39))}")
    if page_id is not None:
        head.append(f"X-Page-Id: {page_id}")
    if is_revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers is not None:
            head.append(f"X-Refers-To-Page: {refers}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers of a record, ``type``, ``page_id``, ``refers_to``, ``payload`` (None for a revisit), ``bytes``, ``digest``.

    The block's own length delimits it; a response's digest is checked against its payload.
    """
    end = data.index(b"\r\n\r\n")
    lines = data[:end].decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("not a WARC record")
    head = {k.lower(): v for k, v in (x.split(": ", 1) for x in lines[1:])}
    block = data[end + 4 : end + 4 + int(head["content-length"])]
    at = block.index(b"\r\n\r\n")
    size = int(re.search(rb"(?im)^Content-Length: (\d+)\r?$", block[:at])[1])
    digest = head["warc-payload-digest"].split(":", 1)[1]
    payload = block[at + 4 :] if head["warc-type"] == "response" else None
    if payload is not None and (len(payload) != size or base32(hashlib.sha1(payload).digest()) != digest):
        raise ValueError(f"payload of page {head.get('x-page-id')} does not match its digest")
    num = lambda k: int(head[k]) if k in head else None
    return {"type": head["warc-type"], "page_id": num("x-page-id"), "refers_to": num("x-refers-to-page"), "payload": payload, "bytes": size, "digest": digest, "url": head.get("warc-target-uri")}


CAPTURES = "surt string, page_id long, file string, offset long, length long"


class _Out:
    """A file that a task writes under a name no other attempt has."""

    def __init__(self, root: str, folder: str, ending: str):
        self.fs, self.base = storage(root)
        c = TaskContext.get()
        self.stem, self.ending, self.k, self.f = f"{folder}/part-{c.partitionId():05d}-{c.taskAttemptId()}", ending, 0, None

    def write(self, data: bytes, most: int) -> tuple[str, int]:
        """The file's name, relative to the root, and the offset."""
        if self.f is None or self.f.tell() > most:
            self.close()
            self.name = f"{self.stem}-{self.k}{self.ending}"
            self.k += 1
            self.fs.create_dir(f"{self.base}/{self.name.rpartition('/')[0]}", recursive=True)
            self.f = self.fs.open_output_stream(f"{self.base}/{self.name}", compression=None, buffer_size=1 << 20)
        at = self.f.tell()
        self.f.write(data)
        return self.name, at

    def close(self) -> None:
        if self.f is not None:
            self.f.close()
            self.f = None


def write_archives(pages: DataFrame, root: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0) -> DataFrame:
    """Writes a record for each row under ``root``; returns the captures (key, id, file, offset, length), materialised.

    Among payloads of ``least_bytes`` or more, equal ones (by SHA-1) are stored once, with the smallest id (a null id is
    never smallest; if all are null, with the first of them); the others are revisits. Roles are settled on (id, digest)
    pairs alone; payloads then move once, dealt by id and digest, so no popular payload gathers in a task. Null html is
    an empty payload. Rows repeated with id and payload are a response and revisits of it.
    """
    src = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), F.coalesce(F.col(html_col), F.lit("")).alias("html"))
    src = src.withColumn("sha1", F.unhex(F.sha1("html"))).withColumn("k", F.coalesce("page_id", F.lit(NULL_ID)))
    seen = src.where(F.octet_length("html") >= least_bytes).groupBy("k", "sha1").agg(F.count("*").alias("n"))
    last = F.when(F.col("k") == NULL_ID, F.lit((1 << 63) - 1)).otherwise(F.col("k"))
    first = seen.groupBy("sha1").agg(F.min(last).alias("first"), F.sum("n").alias("all")).where("all > 1").select("sha1", "first")
    # only payloads that occur again have a role to look up; this join's sides are narrow, and skewed keys are split
    roles = seen.join(first, "sha1").select("k", "sha1", "first")
    ready = src.join(roles.hint("shuffle_hash"), ["k", "sha1"], "left").select("page_id", "url", F.col("html").cast("binary").alias("html"), "sha1", "first")
    top = (1 << 63) - 1

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, copies = _Out(root, "archive", ".warc.gz"), {}
        for b in batches:
            rows = []
            for page_id, url, html, sha1, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                copy = 0
                if first is not None:  # its copies with the same id are all in this task
                    copy = copies[page_id, sha1] = copies.get((page_id, sha1), -1) + 1
                own = first is None or (first == page_id or first == top) and not copy
                data = gz(record(page_id, url, html, base32(sha1), None if own or first == top else first, not own, copy))
                name, at = out.write(data, ARCHIVE_BYTES)
                rows.append((surt(url), page_id, name, at, len(data)))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["surt", "page_id", "file", "offset", "length"])
        out.close()

    return table(arrow(ready, CAPTURES, each), "captures")


DIRECTORY = "surt string, id long, last string, file string, offset long, length long"


def write_index(captures: DataFrame, root: str) -> DataFrame:
    """Sorts captures by (key, id) into compressed blocks of BLOCK_LINES lines under ``root``; returns the directory.

    The directory has one row a block: its first key, its last one's host part, and where it is; its files are sorted, so
    that a reader of a range of keys skips the others by their footers. Range partitions by key and id bound every task.
    Null urls have the empty key, null ids come first; equal captures stay. An empty table gives an empty directory.
    """
    c = captures.select("surt", F.coalesce("page_id", F.lit(NULL_ID)).alias("id"), "file", "offset", "length")
    ready = c.repartitionByRange(parts(captures.sparkSession), "surt", "id", "file", "offset").sortWithinPartitions("surt", "id", "file", "offset")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, lines, found = _Out(root, "index", ".idx.gz"), [], []

        def flush() -> None:
            data = gz("\n".join("\t".join(map(str, x)) for x in lines).encode())
            name, at = out.write(data, ARCHIVE_BYTES)
            found.append((lines[0][0], lines[0][1], lines[-1][0], name, at, len(data)))
            lines.clear()

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                lines.append(row)
                if len(lines) >= BLOCK_LINES:
                    flush()
        if lines:
            flush()
        out.close()
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*found, strict=True), (pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()), strict=True)], ["surt", "id", "last", "file", "offset", "length"])

    at = f"{root}/directory"
    arrow(ready, DIRECTORY, each).sortWithinPartitions("surt", "id").write.parquet(at)
    return captures.sparkSession.read.schema(DIRECTORY).parquet(at)


class Index:
    """Reads captures of keys: binary search in the directory, then in a block, then a range read of the record."""

    def __init__(self, root: str, low: tuple[str, int], high: tuple[str, int]):
        import pyarrow.compute as pc
        import pyarrow.dataset as ds

        self.fs, self.base = storage(root)
        # only the blocks that may hold these keys: files and row groups of others are skipped by their statistics
        rows = ds.dataset(f"{self.base}/directory", filesystem=self.fs, format="parquet", exclude_invalid_files=False)
        own = rows.to_table(filter=(pc.field("surt") <= high[0]) & (pc.field("last") >= low[0]))
        self.first = sorted(zip(*(own.column(c).to_pylist() for c in ("surt", "id", "file", "offset", "length")), strict=True))
        self.keys = [x[:2] for x in self.first]
        self.files: dict = {}
        self.block: tuple[int, list, list] = (-1, [], [])

    def range(self, name: str, at: int, n: int) -> bytes:
        if name not in self.files:
            if len(self.files) >= 64:
                self.files.pop(next(iter(self.files))).close()
            self.files[name] = self.fs.open_input_file(f"{self.base}/{name}")
        return self.files[name].read_at(n, at)

    def captures(self, key: tuple[str, int]) -> Iterator[tuple[str, int, int]]:
        """(file, offset, length) of every capture with this key; equal keys may run over several blocks."""
        i = max(0, bisect.bisect_left(self.keys, key) - 1)
        while i < len(self.keys) and self.keys[i] <= key:
            if self.block[0] != i:
                _, _, name, at, n = self.first[i]
                rows = [x.split("\t") for x in zlib.decompress(self.range(name, at, n), 31).decode().split("\n")]
                self.block = (i, [(r[0], int(r[1])) for r in rows], rows)
            _, keys, rows = self.block
            for r in rows[bisect.bisect_left(keys, key) : bisect.bisect_right(keys, key)]:
                yield r[2], int(r[3]), int(r[4])
            i += 1

    def close(self) -> None:
        for f in self.files.values():
            f.close()


def look_up(keys: DataFrame, root: str, with_payload: bool = False) -> DataFrame:
    """The records of all captures of ``keys(surt, id)``, read back from the archives through the index.

    Each distinct key is looked up once; a null id finds the captures without an id, a null key finds none; keys that the
    index lacks give no row, and an empty table none.

    Keys are dealt by ranges, so a task searches one part of the directory, and neighbouring keys share a block.
    """
    ready = keys.where("surt is not null").select("surt", F.coalesce("id", F.lit(NULL_ID)).alias("id")).distinct()
    ready = ready.repartitionByRange(parts(keys.sparkSession), "surt", "id").sortWithinPartitions("surt", "id")
    names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        todo = [k for b in batches for k in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        if not todo:
            return
        index, rows, held = Index(root, todo[0], todo[-1]), [], 0
        cols = lambda: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds + [pa.binary()] * with_payload, strict=True)], names + ["payload"] * with_payload)
        for key in todo:
            for name, at, n in index.captures(key):
                r = parse_record(zlib.decompress(index.range(name, at, n), 31))
                rows.append((r["page_id"], r["url"], r["bytes"], r["digest"], r["type"], r["refers_to"], *[r["payload"]] * with_payload))
                held += len(r["payload"] or b"") * with_payload + 100
            if held > 8 << 20:
                yield cols()
                rows, held = [], 0
        if rows:
            yield cols()
        index.close()

    return arrow(ready, "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * with_payload, each)


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``page_id, payload_bytes, payload_digest, record_type, refers_to`` of every row of ``pages``, as read back from the
    archives through the index; nulls, repeats and empty tables as in ``write_archives`` and ``look_up``."""
    root = scratch(spark, "warc")
    captures = write_archives(read(spark, sf_dir, "pages"), root)
    write_index(captures, root)
    return look_up(captures.select("surt", F.col("page_id").alias("id")), root).drop("url")
