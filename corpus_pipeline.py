"""A corpus from raw documents to packed sequences, by five of the operators in ``vexel.llm``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.llm import common, mixing, packing, quality, secrets, simhash, tokencount

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _begin(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The documents' columns. Scratch tables of an earlier stage are dropped, unless ``docs`` itself still reads them."""
    own = docs.inputFiles()
    for at in _stage_tables:
        if at in common.made(spark) and not any(at.split(":", 1)[-1].lstrip("/") in f for f in own):
            common.discard(spark, at)
    _stage_tables.clear()
    common.release(spark)
    return docs.select(*COLUMNS)


_stage_tables: list[str] = []


def _end(spark: SparkSession, before: list[str], out: DataFrame) -> DataFrame:
    _stage_tables.extend(at for at in common.made(spark) if at not in before)
    return out


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the base rules or the robust outlier test reject.

    Null, empty and wordless texts fail the base rules. Null languages and sources are groups of their own. Repeated rows
    are judged alike and stay or go together; an empty table stays empty. Other columns of ``docs`` go, here and in every
    stage, but the pipeline's documents have none.
    """
    docs, before = _begin(spark, docs), common.made(spark)
    return _end(spark, before, quality.judged(docs, with_text=True).where("kept").select(*COLUMNS))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group: five-word shingles, a similarity of 0.8 or more.

    Fingerprints at four or fewer differing bits give links that are checked on the whole sets; an exact join of the sets
    adds those of texts whose fingerprints are farther apart, so that all such pairs link. Texts of
    fewer than five words are one shingle, and those without a word link with each other; null texts do so too. Of equal
    ids, and of null ids (which come last), the first row stays; an empty table stays empty.
    """
    docs, before = _begin(spark, docs), common.made(spark)
    return _end(spark, before, simhash.keep_one(docs, width=5, least=0.8))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets by a mark; no document goes.

    Null texts stay null, with a null length, and empty ones empty. Rows are changed each by itself, so repeated ids and
    nulls in other columns don't matter; an empty table stays empty.
    """
    docs, before = _begin(spark, docs), common.made(spark)
    out = secrets.redacted(docs, secrets.train(docs)).withColumn("n_chars", F.length("text").cast("long"))
    return _end(spark, before, out.select(*COLUMNS))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or leaves out documents so that sources come near their target words.

    A null source is one source, the last. Texts that are null or without a word weigh nothing and go. Repeated rows are
    taken each by itself; an empty table stays empty.
    """
    docs, before = _begin(spark, docs), common.made(spark)
    return _end(spark, before, mixing.mixed(docs).select(*COLUMNS))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2048 tokens, neighbours on a Hilbert curve together.

    A null or empty text is its end token alone. Copies made by mixing, and repeated ids, are documents of their own; texts
    longer than a sequence go on in the next ones; an empty table gives an empty result.
    """
    docs, before = _begin(spark, docs), common.made(spark)
    out = packing.pack(docs, tokencount.tokenizer_path("word_bpe_49k.json")).withColumnRenamed("id", "doc_id")
    return _end(spark, before, out)


STAGES = [
    ("quality", quality_rules),
    ("near_duplicates", near_duplicates),
    ("secrets", secret_scan),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]

#: No SQL expresses the outlier estimates, fingerprints or tokens; tests/llm compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies STAGES to ``documents``; each result is written as Parquet in the shared folder and read again."""
    docs = common.read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
