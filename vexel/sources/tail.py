"""What a collection's writer has committed since the last snapshot, for its other readers and for its own recovery."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame

from vexel.operators import log as ops
from vexel.sources.snapshot import Collection

TAIL = "tail"
#: Epoch, then a batch or a range of ``seq``; files that are still being written have other names.
NAME = re.compile(r"\d{10}(-\d+){1,2}(\.(json|parquet))?")


def adopt(collection: Collection, epoch: int, folder: str) -> None:
    """At a take-over: what counts in ``folder`` by now counts on; what earlier epochs' writers add later does not."""
    collection.files.write(f"{collection.path}/epochs/{epoch:010d}.{folder}", json.dumps(counted(collection, folder, epoch - 1)).encode())


def counted(collection: Collection, folder: str, epoch: int | None = None) -> list[str]:
    """The names in ``folder`` that count, in order: the latest epoch's own, and those that it adopted (until it has said
    so, what counted in the epoch before)."""
    epoch = collection.epoch() if epoch is None else epoch
    if epoch <= 0:
        return []
    names = [n for n in collection.files.names(f"{collection.path}/{folder}") if NAME.fullmatch(n)]
    at = f"{collection.path}/epochs/{epoch:010d}.{folder}"
    before = json.loads(collection.files.read(at)) if collection.files.exists(at) else counted(collection, folder, epoch - 1)
    return [n for n in names if int(n[:10]) == epoch or n in before]


class Tail:
    """Files of log rows named by epoch and range of ``seq``: small ones are lines of JSON that the driver writes, large
    ones Parquet that tasks write. A file appears as a whole, by a rename, and the position after its last row is
    committed once the writer's epoch is confirmed."""

    def __init__(self, collection: Collection):
        self.collection, self.files, self.spark = collection, collection.files, collection.spark

    def _name(self, epoch: int, first: int, end: int, kind: str) -> str:
        return f"{self.collection.path}/{TAIL}/{epoch:010d}-{first:019d}-{end:019d}.{kind}"

    def append(self, epoch: int, rows: list[tuple]) -> int:
        """Commits log rows (tuples as in ``log.LOG``, in order); returns the position after them."""
        lines = "\n".join(json.dumps(dict(zip(("seq", "op", "id", "vector", "text"), r, strict=True))) for r in rows)
        self.collection.confirm(epoch)
        self.files.write(self._name(epoch, rows[0][0], rows[-1][0] + 1, "json"), lines.encode())
        self.collection.confirm(epoch)
        return rows[-1][0] + 1

    def append_frame(self, epoch: int, rows: DataFrame, first: int, end: int) -> DataFrame:
        """Commits a DataFrame of log rows and returns it as it reads."""
        at = self._name(epoch, first, end, "parquet")
        self.collection.confirm(epoch)
        rows.write.mode("overwrite").parquet(f"{at}.part")
        self.files.move(f"{at}.part", at)
        self.collection.confirm(epoch)
        return self.spark.read.schema(ops.LOG).parquet(at)

    def _found(self, since: int) -> list[tuple[int, str]]:
        """(end, path) of what counts and ends after ``since``."""
        out = []
        for n in counted(self.collection, TAIL):
            if n.endswith((".json", ".parquet")):
                end = int(n.split("-")[2].split(".")[0])
                if end > since:
                    out.append((end, f"{self.collection.path}/{TAIL}/{n}"))
        return sorted(out)

    def read(self, since: int) -> tuple[DataFrame | None, int]:
        """Committed log rows from ``since`` on, and the position after them."""
        found = self._found(since)
        out = None
        for kind in ("json", "parquet"):
            own = [p for _, p in found if p.endswith(kind)]
            if own:
                got = self.spark.read.schema(ops.LOG).format(kind).load(own)
                out = got if out is None else out.unionByName(got)
        return (None if out is None else out.where(f"seq >= {since}")), max([since, *(e for e, _ in found)])

    def trim(self, upto: int) -> None:
        """Removes files that a snapshot up to ``upto`` holds."""
        at = f"{self.collection.path}/{TAIL}"
        for n in self.files.names(at):
            if n.endswith((".json", ".parquet")) and int(n.split("-")[2].split(".")[0]) <= upto:
                self.files.delete(f"{at}/{n}")
