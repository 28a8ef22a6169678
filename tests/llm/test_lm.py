"""The suffix tree against a brute-force one."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from vexel.llm import lm

SCHEMA = "doc_id long, text string, h string, w string, row string, n string"
LEAST, TWICE, ENTRY, GAIN, DEPTH = 4, 2, 1.0, 3.0, 4


def texts():
    r, out = np.random.default_rng(1), []
    common = ["the", "of", "le", "la", "zébu", "um", "to", "in"]
    phrase = "in the beginning of the very long phrase that comes again".split()
    for i in range(120):
        w = [str(x) for x in r.choice(common, r.integers(5, 40))] + [f"rare{r.integers(60)}"]
        if i % 3 == 0:
            at = int(r.integers(len(w)))
            w[at:at] = phrase
        out.append((i, " ".join(w).replace("the", "THE") if i % 5 else " ".join(w)))
    return [*out, (200, None), (201, ""), (202, " \n"), (None, "no id in the beginning of the"), (3, out[3][1]), (3, out[3][1])]


def brute(rows):
    docs = [(i, (t or "").encode().lower().split() + [None], i is not None and zlib.crc32(str(i).encode()) % 5 == 1) for i, t in rows]
    c = Counter(w for _, ws, held in docs if not held for w in ws)
    n, v = sum(c.values()), len(c)
    share = lambda w: (c[w] + 0.5) / (n + 0.5 * (v + 1))
    follow = [defaultdict(Counter) for _ in range(DEPTH + 1)]
    for _, ws, held in docs:
        full = ["<s>", *ws]
        for i in range(len(ws)) if not held else ():
            for k in range(1, min(DEPTH, i + 1) + 1):
                follow[k][tuple(full[i + 1 - k : i + 1])][ws[i]] += 1
    tree = {}

    def p(h, w):
        if not h:
            return share(w)
        low = p(h[1:], w)
        if h not in tree:
            return low
        kept, rest, total = tree[h]
        return (kept.get(w, 0) + rest * low) / total

    for k in range(1, DEPTH + 1):
        for h, own in follow[k].items():
            t = sum(own.values())
            if t < LEAST:
                continue
            kinds, low = len(own), {w: p(h[1:], w) for w in own}
            gain = lambda w, rest: own[w] * math.log((own[w] - 1 + rest * low[w]) / ((t - 1 + kinds) * low[w]))
            kept = {w: m for w, m in own.items() if m >= TWICE and gain(w, kinds) >= ENTRY}
            lost = t - sum(kept.values())
            rest = kinds + lost
            if kept and sum(gain(w, rest) for w in kept) + lost * math.log(rest / (t + kinds)) >= GAIN:
                tree[h] = kept, rest, t + kinds
    out = []
    for i, ws, held in docs:
        full, s = ["<s>", *ws], 0.0
        for j, w in enumerate(ws):
            s += math.log10(p(tuple(full[max(0, j + 1 - DEPTH) : j + 1]), w))
        out.append((i is None, i, held, len(ws), sum(c[w] > 0 for w in ws), n, sum(math.log10(share(w)) for w in ws), s))
    return tree, sorted(out, key=str)


@pytest.mark.parametrize(("few", "hot"), [(4_000_000, 4_000_000), (4_000_000, 30), (12, 30)])
def test_equals_brute_force(spark, monkeypatch, few, hot):
    for name, value in (("LEAST", LEAST), ("TWICE", TWICE), ("SUCCESSOR_GAIN", ENTRY), ("GAIN", GAIN), ("DEPTH", DEPTH), ("HOT_CONTEXTS", few), ("HOT_ENTRIES", hot), ("HOT_WORDS", hot)):
        monkeypatch.setattr(lm, name, value)
    rows = texts()
    tree, want = brute(rows)
    assert max(map(len, tree)) == DEPTH and len(tree) > 20
    got = lm.score(spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], SCHEMA).repartition(3)).collect()
    got = sorted(((r.id is None, r.id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) for r in got), key=str)
    assert len(got) == len(want)
    for a, b in zip(got, want, strict=True):
        assert a[:6] == b[:6] and a[6] == pytest.approx(b[6]) and a[7] == pytest.approx(b[7], rel=1e-5)


def test_keys_equal_columns(spark):
    h, w = np.array([0, 1, (1 << 64) - 5], np.uint64), np.array([7, (1 << 63) + 3, 0], np.uint64)
    df = spark.createDataFrame(list(zip(h.view(np.int64).tolist(), w.view(np.int64).tolist(), strict=True)), "h long, w long")
    assert [r[0] for r in df.select(F.xxhash64("h", "w")).collect()] == lm.key(h, w).view(np.int64).tolist()
    assert spark.range(1).select(F.xxhash64(F.lit("zébu"))).first()[0] == lm.signed(np.uint64(lm.word_key("zébu".encode())))


def test_empty_and_untrained(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    held = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 5 == 1)
    r = lm.score(spark.createDataFrame([(held, "a b", "", "", "", "")], SCHEMA)).first()
    assert (r.n_tokens, r.n_known, r.train_tokens, r.base_score, r.score) == (3, 0, 0, 0.0, 0.0)


def test_pairs_travel_packed(spark):
    """Successors of frequent words, most of them different, are sent in a few bytes each, not in rows of their own."""
    r = np.random.default_rng(2)
    rows = [(i, " ".join(f"w{x}" for x in r.integers(400, size=1500)), "", "", "", "") for i in range(100)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4).localCheckpoint()
    sent = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    before = sent()
    got = lm.score(df).agg(F.sum("n_tokens"), F.min("train_tokens")).first()
    held = sum(zlib.crc32(str(i).encode()) % 5 == 1 for i in range(100))
    assert tuple(got) == (100 * 1501, (100 - held) * 1501)
    assert sent() - before < 8 * 150_000
