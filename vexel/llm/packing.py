"""Packing along a space-filling curve: hashed document vectors, few dimensions, Hilbert order, sequences cut from it."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import arrow, read, running_total, table
from vexel.llm.tokencount import tokenizer_path

LENGTH = 2048
END = 1
#: Hashed features of a document, dimensions after projection, bits of the curve in each.
FEATURES, DIMS, BITS = 512, 4, 12
#: A process remembers the ids of so many parts of words met lately, and as many met before those.
REMEMBERED = 250_000


def _of(kinds: str) -> str:
    """Regular expression class of the characters up to U+024F whose general category begins with one of ``kinds``."""
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] in kinds)


#: The vocabulary's own splitting rule, for lower-cased texts of characters up to U+024F without the controls 1C to 1F.
PART = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_of('L')}]+|[{_of('N')}]|[^\\t\\n\\x0b\\x0c\\r \x85\xa0{_of('LN')}]+")
BEYOND = re.compile("[\x1c-\x1f]|[^\x00-ɏ]")


class Encoder:
    """Ids of whole texts by a ``tokenizers`` file with the normaliser NFC, white space, lower case.

    Texts of characters up to U+024F (no combining mark is among them, so that composing changes nothing) are lower-cased
    and split by the vocabulary's rule, and each distinct part is encoded once; parts never join. Other texts, and those
    with a special token's first two characters, are encoded whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tk = Tokenizer.from_file(path)
        self.tk.no_truncation()
        self.tk.no_padding()
        self.size = self.tk.get_vocab_size()
        self.kind = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        self.known: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}
        names = (self.tk.id_to_token(i) or "" for i in range(self.size))
        self.last = np.array([x.endswith("</w>") for x in names])  # ids that end a part

    def whole(self, text: str) -> np.ndarray:
        return np.array(self.tk.encode(text, add_special_tokens=False).ids, self.kind)

    def learn(self, parts: set[str]) -> None:
        """Remembers the ids, as bytes, of parts. Many are encoded as one text and told apart by their last ids; should
        that not give as many as there are parts, each is encoded alone."""
        new = []
        for p in parts:
            got = self.before.get(p)
            if got is None:
                new.append(p)
            else:
                self.known[p] = got
        for a in range(0, len(new), 4000):
            own = new[a : a + 4000]
            ids = self.whole(" ".join(own))
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) == len(own) and ends[-1] == len(ids):
                blob, w = ids.tobytes(), self.kind.itemsize
                at = [0, *(ends * w).tolist()]
                self.known.update(zip(own, map(blob.__getitem__, map(slice, at, at[1:])), strict=False))
            else:
                self.known.update((p, self.whole(p).tobytes()) for p in own)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """UTF-8 texts; a list of arrays of ids, without any end."""
        if len(self.known) > REMEMBERED:
            self.before, self.known = self.known, {}
        cut, new = [], set()
        for t in texts:
            text = t.decode()
            low = text.lower()
            # some capitals up to U+024F have small letters beyond it
            if "<|" in text or BEYOND.search(text) or not low.isascii() and BEYOND.search(low):
                cut.append(text)
                continue
            parts = PART.findall(low)
            new |= set(parts).difference(self.known)
            cut.append(parts)
        self.learn(new)
        get = self.known.__getitem__
        return [self.whole(x) if isinstance(x, str) else np.frombuffer(b"".join(map(get, x)), self.kind) for x in cut]


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def projection(seed: int = 5) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((FEATURES, DIMS)) / np.sqrt(DIMS)


def place(ids: np.ndarray, axes: np.ndarray) -> np.ndarray:
    """Grid coordinates of a document: damped counts of hashed ids, unit length, projected, each squashed into BITS bits."""
    h = (ids.astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(32 - FEATURES.bit_length() + 1)
    v = np.log1p(np.bincount(h, minlength=FEATURES).astype(float))
    norm = np.sqrt((v * v).sum())
    y = (v / norm) @ axes if norm else np.zeros(DIMS)
    return np.clip((np.tanh(y) + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert(x: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert index of each row of grid coordinates ``x`` (n x d; d * bits under 64)."""
    x = x.T.copy()
    d = len(x)
    q = 1 << (bits - 1)
    while q > 1:  # undo excess work, highest bit first
        p = q - 1
        for i in range(d):
            on = (x[i] & q) != 0
            t = (x[0] ^ x[i]) & p
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            x[i] = np.where(on, x[i], x[i] ^ t)
        q >>= 1
    for i in range(1, d):  # Gray code
        x[i] ^= x[i - 1]
    t = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        t = np.where((x[d - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(d):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


def encoded(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``row, id, key, n_tokens, ids``: by document its Hilbert key and its packed ids with the end; a written table."""
    axes = projection()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(vocabulary)
        for b in batches:
            if not b.num_rows:
                continue
            got = own.encode([t or b"" for t in b.column(1).to_pylist()])
            key = hilbert(np.stack([place(i, axes) for i in got]))
            ids = [np.append(i, np.array(END, own.kind)).tobytes() for i in got]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(key), pa.array([len(i) + 1 for i in got], pa.int64()), pa.array(ids, pa.binary())], ["id", "key", "n_tokens", "ids"])

    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    got = arrow(src, "id long, key long, n_tokens long, ids binary", each).withColumn("row", F.monotonically_increasing_id())
    return table(got, "packing-ids")


def pack(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: ``id, start, length, ids_crc32, doc_tokens, sequence_id, offset`` (and ``ids``).

    Documents are laid end to end in the order of their Hilbert keys (equal keys by id, nulls first), and every
    ``length`` ids make a sequence; so neighbours on the curve share sequences, a long document is cut at sequence ends
    only, and just the last sequence of the corpus needs padding. Places come from partition totals of a range
    partitioning: no task sees all rows. Null or empty texts are the end id alone. Repeated rows are packed each. An
    empty table has no pieces. Ids are encoded once and written; the second pass joins places to them by row.
    """
    rows = encoded(docs, vocabulary, id_col, text_col)
    order = [F.col("key"), F.col("id"), F.col("row")]
    places = running_total(rows.select("key", "id", "row", "n_tokens"), order, "n_tokens", "at", "packing-order").select("row", "at")
    kind = encoder(vocabulary).kind.str
    more = ", ids array<long>" if with_ids else ""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: list[tuple] = []
            for i, at, blob in zip(*(c.to_pylist() for c in b.columns), strict=True):
                ids = np.frombuffer(blob, kind).astype("<u4")
                a = 0
                while a < len(ids):
                    n = min(len(ids) - a, length - (at + a) % length)
                    out.append((i, a, n, zlib.crc32(ids[a : a + n].tobytes()), len(ids), (at + a) // length, (at + a) % length, ids[a : a + n].tolist() if with_ids else None))
                    a += n
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
            cols = list(zip(*out, strict=True)) or [()] * 8
            kinds = [pa.int64()] * 7 + [pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k, _ in zip(cols, kinds, names, strict=False)], names)

    placed = rows.select("row", "id", "ids").join(places.hint("shuffle_hash"), "row").select("id", "at", "ids")
    return arrow(placed, f"id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long{more}", each)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every row of ``documents``, as ``pack`` has them for nulls, empty texts, ties and empty tables."""
    got = pack(read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return got.withColumnRenamed("id", "doc_id")
