"""Secret scans: three fixed patterns, and character Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vexel.llm.common import arrow, read

# Fixed by the operator's contract. ASCII: only A-Z fold, not letters such as U+017F.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")  # greedy runs: the same spans as the runs [0-9a-f]+ of 32 or more
HINT = re.compile(r"(?i:passw|secret|token|api_?key)", re.ASCII)
KINDS = ("assign", "access", "hex", "markov")
#: A candidate for the Markov test: a run of so many identifier characters; the likelihoods alone decide.
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{8,}")
#: Words of the corpus that are labelled ordinary: letters as words have them, or digits, joined by signs. Others, which
#: mix them, have no label.
ORDINARY = re.compile(r"(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+|[0-9]+)(?:[+/_=-]+(?:[A-Z]?[a-z]+(?:[A-Z][a-z]+)*|[A-Z]+|[0-9]+))*[+/_=-]*")
#: Nats by which a string must be likelier as a random one.
MARGIN = 10.0
#: A process remembers the verdicts on so many distinct candidates.
REMEMBERED = 300_000
#: Letters by case, digits, the rest; 65 symbols and one for the ends.
SYMBOLS = {c: i + 1 for i, c in enumerate("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-")}
S = len(SYMBOLS) + 1
#: Labelled rows read to fit the two models, at most.
TRAIN_ROWS = 2000


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the three patterns; matches failing their length are dropped after matching."""
    out = []
    if HINT.search(text):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


_CODE = np.zeros(256, np.int64)
for _c, _i in SYMBOLS.items():
    _CODE[ord(_c)] = _i


def _pairs(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the pairs of adjacent characters, the ends too, of all strings, and where each string's begin."""
    x = _CODE[np.frombuffer(("\0" + "\0".join(strings) + "\0").encode("latin-1", "replace"), np.uint8)]
    n = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    return x[:-1] * S + x[1:], np.cumsum(n) - n


def pair_counts(strings: list[str]) -> np.ndarray:
    return np.bincount(_pairs(strings)[0], minlength=S * S) if strings else np.zeros(S * S, np.int64)


def _fit(n: np.ndarray, prior: float = 0.2) -> np.ndarray:
    n = n.reshape(S, S) + prior
    return np.log(n / n.sum(axis=1, keepdims=True)).ravel()


class Model:
    """Log-likelihood ratio, in nats, of a string under the random model against the ordinary one.

    Made from the counts of adjacent characters in both kinds of labelled strings.
    """

    def __init__(self, random_pairs: np.ndarray, ordinary_pairs: np.ndarray, margin: float = MARGIN):
        self.ratio = _fit(random_pairs) - _fit(ordinary_pairs)
        self.margin = margin
        self.known: dict[str, bool] = {}

    def scores(self, strings: list[str]) -> np.ndarray:
        if not strings:
            return np.zeros(0)
        pairs, at = _pairs(strings)
        return np.add.reduceat(self.ratio[pairs], at)

    def learn(self, strings: set[str]) -> None:
        """Remembers the verdicts on these."""
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = [s for s in strings if s not in self.known]
        self.known.update(zip(new, (self.scores(new) > self.margin).tolist(), strict=True))

    def spans(self, text: str) -> list[tuple[int, int, int]]:
        """Candidates above the margin."""
        found = [(m.start(), m.end(), m.group()) for m in CANDIDATE.finditer(text)]
        self.learn({s for _, _, s in found})
        return [(a, 3, b) for a, b, s in found if self.known[s]]


def random_strings(n: int = 4000, seed: int = 7) -> list[str]:
    """Labelled random strings: the alphabets that keys come in, lengths 8 to 64, from a fixed generator."""
    r = random.Random(seed)
    low, up, dig = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = [low + up + dig, low + up + dig + "+/", low + up + dig + "_-", low + dig, up + dig, "0123456789abcdef", low, up]
    return ["".join(r.choices(kinds[i % len(kinds)], k=r.randint(8, 64))) for i in range(n)]


# Stems of ordinary identifiers, in alphabetical order.
STEMS = (
    "account action address agent alert amount archive argument array author average backup balance broker buffer build button cache callback channel "
    "client cluster code color column comment commit content context create cursor customer database debug default depth device digest display document "
    "domain driver email empty encode engine entry error event example execute feature fetch field filter first float folder format forward frame function "
    "global graph group handler header height history image import index input instance iterator job journal kernel keyboard label language length library "
    "limit listener lookup machine manager margin memory message method metric minimum module monitor month mouse network node normal notify number object "
    "offset option order other output owner package parent parse path pattern payload pixel pointer policy prefix process profile project property public "
    "query queue quick random range record region remote render report request response result return rotate schema screen script search sequence server "
    "service shadow signal size something source stack status stream string struct subject switch symbol system table target task template thing thread "
    "title token tree trigger unique update user utility value vector version view virtual volume warning widget width window with worker wrapper year "
    "yield zone"
).split()


def identifiers(n: int = 6000, seed: int = 11) -> list[str]:
    """Labelled ordinary identifiers that need no corpus: one to four stems joined as programs join them, some numbered,
    and dated names. The same on every machine."""
    r = random.Random(seed)
    out = list(STEMS)
    while len(out) < n:
        own = r.choices(STEMS, k=r.randint(1, 4))
        kind = r.randrange(6)
        if kind == 0:
            name = "".join([own[0], *(w.capitalize() for w in own[1:])])
        elif kind == 1:
            name = "".join(w.capitalize() for w in own)
        else:
            name = ("_", "_", "-", "/")[kind - 2].join(own)
        out.append(f"{name}{r.choice(('', '_', '-'))}{r.randint(0, 120)}" if r.random() < 0.15 else name)
    out += [w.upper() for w in out[::7]]
    return out + [f"{y}-{m:02d}-{d:02d}-{w}" for y in range(1995, 2030, 3) for m in (1, 6, 12) for d in (3, 17, 28) for w in ("report", "build-12", "v2")]


def train(docs: DataFrame, text_col: str = "text", rows: int = TRAIN_ROWS, margin: float = MARGIN) -> Model:
    """Fit on the whole texts of at most about ``rows`` documents (those with the least hashes of their texts, one of each
    text; the documented bound) and on the built-in samples (``random_strings``, ``identifiers``), which are fixed.

    The secret parts of base matches there are labelled random; other words are labelled ordinary (see ORDINARY), single,
    joined in threes as identifiers are, and some of them in capitals. Tasks count pairs of adjacent characters; two 66 x 66 matrices a task reach the driver.
    Null and empty texts add nothing; without any document the built-in samples stand alone.
    """
    d = docs.select(F.col(text_col).alias("t")).where("t is not null").withColumn("h", F.xxhash64("t"))
    # about twice the rows asked for pass the hash, so that tasks send little; the least of them are the bound
    share = min(1.0, 2.0 * rows / max(1, d.count()))
    few = d.where(F.shiftrightunsigned("h", 11) < int(share * (1 << 53)))
    least = [r.h for r in few.select("h").distinct().orderBy("h").limit(rows).collect()]
    chosen = few.where(F.col("h") <= F.lit(least[-1])) if least else few.limit(0)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((2, S * S), np.int64)
        for b in batches:
            for t in b.column(0):
                rand, plain = labelled(t.as_py())
                n[0] += pair_counts(rand)
                n[1] += pair_counts(plain)
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(n.tolist(), pa.list_(pa.int64()))], ["kind", "n"])

    total = np.stack([pair_counts(random_strings()), pair_counts(identifiers())])
    for r in arrow(chosen.dropDuplicates(["h"]).select("t"), "kind int, n array<long>", each).toLocalIterator():
        total[r.kind] += np.array(r.n)
    return Model(total[0], total[1], margin)


def labelled(text: str) -> tuple[list[str], list[str]]:
    """Random and ordinary strings of a text, as the base patterns label them."""
    rand, rest, at = [], [], 0
    for a, k, b in base_spans(text):
        own = text[a:b]
        rand.append(ASSIGN.match(own)[2] if k == 0 else own)
        rest.append(text[at:a])
        at = max(at, b)
    rest.append(text[at:])
    words = [w for w in re.findall(r"[A-Za-z0-9+/_=-]{3,}", " ".join(rest)) if ORDINARY.fullmatch(w)]
    joined = ["_".join(words[i : i + 3]) for i in range(0, len(words), 3)]
    return rand, words + joined + [w.upper() for w in words[::4]]  # constants are written in capitals


def merge(base: list[tuple[int, int, int]], more: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """All base spans, and those of ``more`` that no base span overlaps."""
    out, ends = list(base), [(a, b) for a, _, b in base]
    i = 0
    reach = -1
    for a, k, b in more:
        while i < len(ends) and ends[i][0] < b:
            reach = max(reach, ends[i][1])
            i += 1
        if reach <= a:
            out.append((a, k, b))
    return sorted(out)


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scan(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs``' columns with ``spans`` array<struct<kind, start, end>> (code points, end exclusive) as a new last column.

    Null or empty texts have no spans; rows are independent, so repeats, order and other columns are untouched. A column
    named ``spans`` in the input is replaced.
    """
    keep = docs.drop("spans")
    at = keep.columns.index(text_col)
    out = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t in b.column(at):
                text = t.as_py() or ""
                base = base_spans(text)
                got.append([{"kind": KINDS[k], "start": a, "end": e} for a, k, e in merge(base, model.spans(text))])
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, out)], [*b.schema.names, "spans"])

    item = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return arrow(keep, T.StructType([*keep.schema.fields, T.StructField("spans", T.ArrayType(item))]), each)


def redact(text: str | None, spans: list, mark: str = "[secret]") -> str | None:
    """``text`` with each span replaced, overlapping ones together."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for s in sorted(spans, key=lambda s: (s["start"], s["end"])):
        if s["start"] >= at:
            out += [text[at : s["start"]], mark]
        at = max(at, s["end"])
    return "".join([*out, text[at:]])


def redacted(docs: DataFrame, model: Model, text_col: str = "text", mark: str = "[secret]") -> DataFrame:
    """``docs`` with the secrets in ``text_col`` replaced by ``mark``; all columns and rows stay, whatever their names.

    Null and empty texts stay as they are; rows are independent, so repeats are treated alike; an empty table stays empty.
    """
    at = docs.columns.index(text_col)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = []
            for t in b.column(at):
                text = t.as_py()
                spans = merge(base_spans(text), model.spans(text)) if text else []
                got.append(redact(text, [{"start": a, "end": e} for a, _, e in spans], mark))
            cols = list(b.columns)
            cols[at] = pa.array(got, pa.string())
            yield pa.RecordBatch.from_arrays(cols, b.schema.names)

    return arrow(docs, docs.schema, each)


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, n_assign, n_access, n_hex, base_sha256, spans`` (and n_markov) for every row of ``documents``; null and
    empty texts have no spans, and the digest of the empty string."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs)
    found = scan(docs, model).drop("text")
    of = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    text = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"] != "markov")
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(text(base), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), of("markov").alias("n_markov"))
