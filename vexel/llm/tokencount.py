"""Token counts through a digest cache: distinct contents not yet counted are encoded once and appended."""

from __future__ import annotations

import hashlib
import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm.common import arrow, prepare, read, scratch, table

#: A process remembers the counts of so many word segments, at most; then it starts anew.
REMEMBERED = 400_000
LIMIT = 4096
#: White space (as the library writes it) and what follows, up to the next white space.
SEGMENT = re.compile(" *[^ ]+| +$")
SPACE = "▁"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Counter:
    """Counts tokens of texts with a ``.model`` (sentencepiece) or ``.json`` (tokenizers) vocabulary file.

    sentencepiece: where no piece has white space after another character, and the normaliser keeps texts as they are,
    merges never cross from a word into the white space behind it. Such a text's count is the sum over its segments, and
    each distinct segment is encoded once a process. With any other vocabulary, whole texts are encoded.
    """

    def __init__(self, path: str):
        self.seen: dict[str, int] = {}
        self.sp = self.tk = None
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            self.tk, self.apart = Tokenizer.from_file(path), False
            self.tk.no_truncation()
            self.tk.no_padding()
        else:
            import sentencepiece

            self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
            pieces = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
            self.apart = not any(SPACE in p.lstrip(SPACE) for p in pieces) and self._plain()

    def _plain(self) -> bool:
        """Spaces are kept, one is put before the text, and characters are not rewritten (tried on a few)."""
        tried = ("a b", "a  b ", " a", "ﬁ ① é é Ａ", "a\n b\tc")
        return all(sum(self._segments(SEGMENT.findall(" " + t))) == len(self.sp.encode(t)) for t in tried) and self.sp.normalize(tried[3]) == (SPACE + tried[3].replace(" ", SPACE))

    def _segments(self, segs: list[str]) -> list[int]:
        """Counts of segments; the space that the library puts before a text stands for a segment's first."""
        alone = len(self.sp.encode("a ")) - len(self.sp.encode("a"))
        return [len(x) if s != " " else alone for s, x in zip(segs, self.sp.encode([s[1:] for s in segs], num_threads=1), strict=True)]

    def count(self, texts: list[str]) -> list[int]:
        if self.tk:
            return [len(e.ids) for e in self.tk.encode_batch(texts, add_special_tokens=False)]
        if not self.apart:
            return [len(x) for x in self.sp.encode(texts, num_threads=1)]
        cut = [SEGMENT.findall(" " + t.replace(SPACE, " ")) if t else () for t in texts]
        if len(self.seen) > REMEMBERED:
            self.seen.clear()
        seen = self.seen
        new = list({s for segs in cut for s in segs if s not in seen})
        if new:
            seen.update(zip(new, self._segments(new), strict=True))
        return [sum(map(seen.__getitem__, segs)) for segs in cut]


_counters: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _counters:
        _counters[path] = Counter(path)
    return _counters[path]


def version(path: str) -> str:
    """Digest of the vocabulary file and of how it is used."""
    with open(path, "rb") as f:
        return hashlib.sha256(hashlib.sha256(f.read()).digest() + json.dumps({"special": False, "truncate": False}).encode()).hexdigest()


CACHE = "version string, digest binary, n_tokens long"


class DigestCache:
    """A Parquet table (version, digest, n_tokens) at ``path``, partitioned by tokenizer version; only ever appended to."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def read(self, of: str) -> DataFrame:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.path)
        if not p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
            return self.spark.createDataFrame([], CACHE)
        return self.spark.read.schema(CACHE).parquet(self.path).where(F.col("version") == of)

    def append(self, counts: DataFrame, of: str) -> None:
        counts.select(F.lit(of).alias("version"), "digest", "n_tokens").write.mode("append").partitionBy("version").parquet(self.path)


def count_tokens(docs: DataFrame, cache: DigestCache, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id, n_bytes, n_tokens, over_limit`` for each row of ``docs``.

    Content is the text as it is (null as empty); its SHA-256 is the cache's key beside the tokenizer's version. Distinct
    digests that the cache lacks are represented by one row each, so only these rows' texts move (once, dealt evenly by
    id and digest, however many copies a text has) and are encoded; their counts are appended. Empty texts count 0.
    Repeated rows and repeated ids stay separate rows; an empty table appends nothing. Other columns are not read.
    """
    prepare(docs.sparkSession)
    of = version(vocabulary)
    text = F.coalesce(F.col(text_col), F.lit(""))
    src = docs.select(F.col(id_col).cast("long").alias("id"), text.alias("text"))
    src = src.withColumn("digest", F.unhex(F.sha2("text", 256)))
    rows = table(src.select("id", "digest", F.octet_length("text").cast("long").alias("n_bytes")), "token-digests")
    key = F.coalesce(F.col("id"), F.lit(-(1 << 63)))
    known = cache.read(of)
    missing = rows.groupBy("digest").agg(F.min(key).alias("k")).join(known, "digest", "left_anti")
    found = src.withColumn("k", key).join(missing.hint("shuffle_hash"), ["k", "digest"], "left_semi").select("digest", "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = counter(vocabulary)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(own.count(b.column(1).to_pylist()), pa.int64())], ["digest", "n_tokens"])

    cache.append(arrow(found, "digest binary, n_tokens long", each).dropDuplicates(["digest"]), of)
    counts = cache.read(of).groupBy("digest").agg(F.first("n_tokens").alias("n_tokens"))
    return rows.join(counts, "digest").select("id", "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


def op5_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``documents``; nulls, repeats and empty tables as in
    ``count_tokens``. The cache is new each time."""
    cache = DigestCache(spark, scratch(spark, "token-cache"))
    got = count_tokens(read(spark, sf_dir, "documents"), cache, tokenizer_path("piece_bpe_32k.model"))
    return got.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", "over_limit")
