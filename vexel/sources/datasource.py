"""Named collections as a Spark data source: ``spark.read.format("vexel")`` and ``df.write.format("vexel")``.

Options: ``root`` and ``name`` of the collection; for writing into a new one also ``dims``.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from vexel.errors import DimensionMismatchError, SnapshotError
from vexel.operators import log as ops
from vexel.sources.folders import ship
from vexel.sources.snapshot import DATA, MANIFEST, ROWS, Collection, Manifest
from vexel.sources.tail import NAME, TAIL, adopt, counted

FORMAT = "vexel"
_LOG = pa.schema([("seq", pa.int64()), ("op", pa.string()), ("id", pa.string()), ("vector", pa.list_(pa.float32())), ("text", pa.string())])


class MountedFiles:
    """Small files in a folder that this process can open: data sources run in Python processes without a JVM. The
    methods are those of ``snapshot.Files``."""

    def _at(self, path: str) -> str:
        return path.removeprefix("file://").removeprefix("file:")

    def exists(self, path: str) -> bool:
        return os.path.exists(self._at(path))

    def read(self, path: str) -> bytes:
        with open(self._at(path), "rb") as f:
            return f.read()

    def write(self, path: str, data: bytes, overwrite: bool = True) -> None:
        at = self._at(path)
        os.makedirs(os.path.dirname(at), exist_ok=True)
        side = at if not overwrite else f"{at}.{uuid.uuid4().hex}"
        with open(side, "wb" if overwrite else "xb") as f:
            f.write(data)
        if overwrite:
            os.replace(side, at)

    def delete(self, path: str) -> None:
        at = self._at(path)
        if os.path.isdir(at):
            for n in os.listdir(at):
                self.delete(f"{at}/{n}")
            os.rmdir(at)
        elif os.path.exists(at):
            os.remove(at)

    def move(self, path: str, to: str) -> bool:
        try:
            os.makedirs(os.path.dirname(self._at(to)), exist_ok=True)
            os.rename(self._at(path), self._at(to))
        except OSError:
            return False
        return True

    def names(self, path: str) -> list[str]:
        at = self._at(path)
        # checksum files beside those that Spark's own file system writes
        return sorted(n for n in os.listdir(at) if not n.endswith(".crc")) if os.path.isdir(at) else []


@dataclass
class Part(InputPartition):
    path: str
    group: int


class CollectionReader(DataSourceReader):
    """The published snapshot: a partition for each row group, planned from the files' footers; only the columns of the
    schema asked for are read."""

    def __init__(self, collection: Collection, columns: list[str]):
        self.at, self.columns = None, columns
        version = collection.current()
        if version:
            self.at = MountedFiles()._at(f"{collection.path}/{version}/{DATA}")

    def partitions(self) -> list[Part]:
        if self.at is None:
            return []
        files = [f"{self.at}/{n}" for n in sorted(os.listdir(self.at)) if n.endswith(".parquet")]
        return [Part(f, g) for f in files for g in range(pq.ParquetFile(f).num_row_groups)]

    def read(self, partition: Part | None) -> Iterator[pa.RecordBatch]:
        if partition is None or not isinstance(partition, Part):
            return
        for b in pq.ParquetFile(partition.path).iter_batches(row_groups=[partition.group], columns=self.columns, batch_size=4096):
            yield b.select(self.columns)


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    rows: int
    first: int
    last: int


class CollectionWriter(DataSourceArrowWriter):
    """Appends rows ``id, seq, vector`` (and ``text``) as inserts to the collection's tail. ``seq`` is unique and not below
    the position committed so far.

    Tasks write files in a folder of this write; the commit takes the collection over as its only writer, checks the
    numbers, and renames the folder into the tail, so that readers see all of it or nothing. A failed or aborted write
    removes its folder. A batch of a stream that was committed before is not taken again.
    """

    def __init__(self, root: str, name: str, columns: list[str], dims: int | None):
        self.root, self.name, self.columns, self.given = root, name, columns, dims
        c = self._collection()
        version = c.current()
        m = Manifest.decode(c.files.read(f"{c.path}/{version}/{MANIFEST}")) if version else None
        if m is None and dims is None:
            raise SnapshotError(f"{c.path} has no snapshot yet: the option dims must say the length of its vectors")
        self.dims, self.start = (m.dims, m.next_seq) if m else (dims, 0)
        self.side = f"{c.path}/writing-{uuid.uuid4().hex}"

    def _collection(self) -> Collection:
        return Collection(None, self.root, self.name, files=MountedFiles())

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        out, path, n, first, last = None, None, 0, 0, 0
        for b in iterator:
            if not b.num_rows:
                continue
            got = {c: b.column(b.schema.get_field_index(c)) for c in self.columns}
            vectors = got["vector"].cast(pa.list_(pa.float32()))
            for v in vectors:
                if not v.is_valid or len(v) != self.dims or v.values.null_count:
                    raise DimensionMismatchError(self.dims, len(v) if v.is_valid else -1)
            seq = got["seq"].cast(pa.int64())
            low, high = min(seq.to_pylist()), max(seq.to_pylist())
            first, last = (low, high) if not n else (min(first, low), max(last, high))
            n += b.num_rows
            text = got["text"].cast(pa.string()) if "text" in got else pa.nulls(b.num_rows, pa.string())
            batch = pa.RecordBatch.from_arrays([seq, pa.array([ops.INSERT] * b.num_rows), got["id"].cast(pa.string()), vectors, text], schema=_LOG)
            if out is None:
                at = MountedFiles()._at(self.side)
                os.makedirs(at, exist_ok=True)
                path = f"{at}/part-{uuid.uuid4().hex}.parquet"
                out = pq.ParquetWriter(path, _LOG)
            out.write_batch(batch)
        if out is not None:
            out.close()
        return Written(path, n, first, last)

    def commit(self, messages: list[Written | None]) -> None:
        own = [m for m in messages if m is not None and m.rows]
        if not own:
            return
        kept = {os.path.basename(m.path) for m in own}
        c = self._collection()
        at = os.path.dirname(own[0].path)  # a stream commits from another process than the one that sent out its tasks
        for n in os.listdir(at):  # of attempts that were not committed
            if n not in kept:
                os.remove(f"{at}/{n}")
        first, end = min(m.first for m in own), max(m.last for m in own) + 1
        lease = c.acquire()
        try:
            adopt(c, lease.epoch, TAIL)
            names = [n for n in counted(c, TAIL) if NAME.fullmatch(n)]
            if any(n.split("-")[1:] == [f"{first:019d}", f"{end:019d}.parquet"] for n in names):
                self._drop(messages)
                return
            position = max([self.start, *(int(n.split("-")[2].split(".")[0]) for n in names)])
            if first < position:
                raise SnapshotError(f"seq {first} lies below the committed position {position}")
            if not c.files.move(at, f"{c.path}/{TAIL}/{lease.epoch:010d}-{first:019d}-{end:019d}.parquet"):
                raise SnapshotError(f"{at} cannot be moved into the tail")
            c.confirm(lease.epoch)
        except Exception:
            self._drop(messages)
            raise
        finally:
            lease.release()

    def abort(self, messages: list[Written | None]) -> None:
        self._drop(messages)

    def _drop(self, messages: list[Written | None]) -> None:
        for at in {self.side, *(os.path.dirname(m.path) for m in messages if m is not None and m.path)}:
            MountedFiles().delete(at)


class CollectionStreamWriter(CollectionWriter, DataSourceStreamArrowWriter):
    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        CollectionWriter.commit(self, messages)

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self._drop(messages)


class CollectionSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ROWS

    def _place(self) -> tuple[str, str]:
        if "root" not in self.options or "name" not in self.options:
            raise ValueError("the options root and name say which collection is meant")
        return self.options["root"], self.options["name"]

    def reader(self, schema: StructType) -> CollectionReader:
        return CollectionReader(Collection(None, *self._place(), files=MountedFiles()), schema.names)

    def _writer(self, kind: type, schema: StructType):
        missing = {"id", "seq", "vector"} - set(schema.names)
        if missing:
            raise ValueError(f"columns are missing: {', '.join(sorted(missing))}")
        dims = self.options.get("dims")
        return kind(*self._place(), [c for c in ("id", "seq", "vector", "text") if c in schema.names], None if dims is None else int(dims))

    def writer(self, schema: StructType, overwrite: bool) -> CollectionWriter:
        if overwrite:
            raise ValueError("a collection is appended to; clear it through its store")
        return self._writer(CollectionWriter, schema)

    def streamWriter(self, schema: StructType, overwrite: bool) -> CollectionStreamWriter:  # noqa: N802
        return self._writer(CollectionStreamWriter, schema)


def register(spark: SparkSession) -> None:
    """Once a session, before the format is used."""
    ship(spark)
    spark.dataSource.register(CollectionSource)

