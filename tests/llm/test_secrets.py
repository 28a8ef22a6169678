"""The Markov models recomputed plainly: labelled strings, counts, ratios, spans; and spans that they add to a table."""

import math
import re

import numpy as np

from vexel.llm import secrets

SCHEMA = "doc_id long, text string, lang string, source string"
LETTERS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_=-"


def prose(n, seed):
    r = np.random.default_rng(seed)
    return " ".join("".join(r.choice(list("aeiounrstlmd"), r.integers(3, 9))) for _ in range(n))


def rows():
    r = np.random.default_rng(5)
    out = []
    for i in range(60):
        words = prose(80, i).split()
        if i % 4 == 0:
            words.insert(40, "".join(r.choice(list(LETTERS[:62]), 20)))
        if i % 5 == 0:
            words.insert(10, "reader_of_" + words[3] + "-" + words[4])
        if i % 6 == 0:
            words.insert(20, 'api_key = "' + "".join(r.choice(list(LETTERS[:62]), 24)) + '"')
        out.append((i, " ".join(words), "en", "s"))
    return [*out, (90, None, "en", "s"), (91, "", "en", "s")]


def plain_model(texts):
    """Counts of adjacent characters by dictionaries, ends included, over both labelled samples."""
    counts = [{}, {}]
    for kind, strings in ((0, secrets.random_strings()), (1, secrets.identifiers())):
        for x in strings:
            for a, b in zip("\0" + x, x + "\0", strict=True):
                counts[kind][a, b] = counts[kind].get((a, b), 0) + 1
    for t in texts:
        for kind, strings in enumerate(secrets.labelled(t)):
            for x in strings:
                for a, b in zip("\0" + x, x + "\0", strict=True):
                    own = [c if c in LETTERS else "\0" for c in (a, b)]
                    counts[kind][tuple(own)] = counts[kind].get(tuple(own), 0) + 1
    known = "\0" + LETTERS

    def logp(kind, a, b):
        total = sum(counts[kind].get((a, x), 0) + 0.2 for x in known)
        return math.log((counts[kind].get((a, b), 0) + 0.2) / total)

    cache = {(a, b): logp(0, a, b) - logp(1, a, b) for a in known for b in known}
    return lambda x: sum(cache[a, b] for a, b in zip("\0" + x, x + "\0", strict=True))


def test_spans_equal_a_plain_recomputation(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    model = secrets.train(docs)
    ratio = plain_model([t for _, t, _, _ in rows() if t])
    some = [*secrets.random_strings(50), *secrets.identifiers()[:300:7], "reader_of_moon", "x" * 40]
    assert np.allclose(model.scores(some), [ratio(x) for x in some])
    got = {r.doc_id: [(s.start, s.kind, s.end) for s in r.spans] for r in secrets.scan(docs, model).collect()}
    added = 0
    for i, t, _, _ in rows():
        base = [(a, secrets.KINDS[k], b) for a, k, b in secrets.base_spans(t or "")]
        more = [(m.start(), "markov", m.end()) for m in re.finditer(r"[A-Za-z0-9+/_=-]{8,}", t or "") if ratio(m.group()) > secrets.MARGIN]
        more = [m for m in more if not any(a < m[2] and m[0] < b for a, _, b in base)]
        assert got[i] == sorted(base + more), i
        added += len(more)
    assert added == 15  # one in four texts has a bare random string


def test_labels_are_the_same_everywhere():
    a, b = secrets.identifiers(), secrets.random_strings()
    assert a == secrets.identifiers() and len(a) > 6000 and len(b) == 4000 and len(secrets.STEMS) < 200
    assert not any(w for w in a if not set(w) <= set(LETTERS))
