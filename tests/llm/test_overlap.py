"""Near-duplicates by the similarity of shingle sets, against all pairs."""

import numpy as np
import pytest

from vexel.llm import common, overlap, simhash

rng = np.random.default_rng(11)
VOCAB = ["".join(rng.choice(list("abcdefgh"), 6)) for _ in range(3000)]
SCHEMA = "doc_id long, text string"


def grams(text, width=5):
    w = (text or "").split()
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))}


def jaccard(a, b):
    return len(a & b) / len(a | b)


def kept(rows, least=0.8):
    """The least ids of the groups of all pairs at ``least`` or more."""
    sets = [grams(t) for _, t in rows]
    low = [i for i, _ in rows]
    near = [[j for j in range(len(rows)) if jaccard(sets[i], sets[j]) >= least] for i in range(len(rows))]
    while (new := [min(low[j] for j in js) for js in near]) != low:
        low = new
    return sorted(set(low))


def far(a, b):
    return (simhash.fingerprint(a, 5) ^ simhash.fingerprint(b, 5)).bit_count()


def changed(words, r, n):
    words = list(words)
    for i in r.choice(len(words), n, replace=False):
        words[i] = str(r.choice(VOCAB))
    return words


def texts():
    r, out = np.random.default_rng(3), []
    for _ in range(60):
        base = list(r.choice(VOCAB, int(r.integers(50, 160))))
        out += [base] + [changed(base, r, int(n)) for n in r.integers(0, 5, int(r.integers(0, 6)))]
    dense = list(r.choice(VOCAB, 150))
    out += [changed(dense, r, int(n)) for n in r.integers(1, 8, 60)]
    licence = list(r.choice(VOCAB, 40))
    out += [list(r.choice(VOCAB, 60)) + licence for _ in range(40)]
    return [(int(i), " ".join(w)) for i, w in zip(r.permutation(len(out)), out, strict=True)]


@pytest.mark.parametrize("last", [0, 200_000])
def test_all_similar_pairs_are_found(spark, monkeypatch, last):
    """Whatever the order of the shingles; some links are more than 8 bits apart."""
    monkeypatch.setattr(overlap, "LAST", last)
    monkeypatch.setattr(overlap, "BLOCK", 16)
    rows = texts()
    sets = [grams(t) for _, t in rows]
    assert any(jaccard(sets[i], sets[j]) >= 0.8 and far(rows[i][1], rows[j][1]) > 8 for i in range(len(rows)) for j in range(i))
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA).repartition(3), width=5, least=0.8)
    assert sorted(r.doc_id for r in got.collect()) == kept(rows)


def test_empty_and_short(spark):
    rows = [(3, None), (2, ""), (5, "a b c"), (4, "A  b c"), (6, "a b"), (7, "a b c d e f"), (8, "a b c d e")]
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA), width=5, least=0.8)
    assert sorted(r.doc_id for r in got.collect()) == [2, 4, 6, 7, 8]


def test_links_missing_from_a_forest(spark):
    """A ~ B holds a group together though the least, C, is similar to A only; C and A meet in the same buckets as B."""
    r = np.random.default_rng(5)
    base = list(r.choice(VOCAB, 200))
    c, b = changed(base[:100], r, 2) + base[100:], base[:100] + changed(base[100:], r, 3)
    rows = [(1, " ".join(c)), (2, " ".join(b)), (3, " ".join(base))]
    s = [grams(t) for _, t in rows]
    assert jaccard(s[0], s[2]) >= 0.8 and jaccard(s[1], s[2]) >= 0.8 > jaccard(s[0], s[1])
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA).coalesce(1), width=5, least=0.8)
    assert [x.doc_id for x in got.collect()] == [1]


def test_equal_fingerprints_of_different_texts(spark):
    """Repeated words decide the fingerprint; the texts share few of their shingles, and both stay."""
    r = np.random.default_rng(6)
    again = " ".join(["over and over once more"] * 300)
    rows = [(i, again + " " + " ".join(r.choice(VOCAB, 40))) for i in (1, 2)]
    assert far(rows[0][1], rows[1][1]) == 0 and jaccard(grams(rows[0][1]), grams(rows[1][1])) < 0.8
    got = simhash.keep_one(spark.createDataFrame(rows, SCHEMA), width=5, least=0.8)
    assert sorted(x.doc_id for x in got.collect()) == [1, 2]


@pytest.mark.parametrize("how", ["left_semi", "left_anti"])
def test_ids_met_by_broadcast_or_shuffle(spark, monkeypatch, how):
    """Both ways give the same rows, with no ids too."""
    rows = spark.createDataFrame([(i % 7, f"t{i}") for i in range(20)], "k long, t string")
    for ids in ([1, 3, 9], []):
        given = spark.createDataFrame([(i,) for i in ids], "k long")
        want = sorted((i % 7, f"t{i}") for i in range(20) if (i % 7 in ids) == (how == "left_semi"))
        for sent in (2_000_000, -1):
            monkeypatch.setattr(common, "SENT", sent)
            assert sorted(map(tuple, common.picked(rows, given, "k", how).collect())) == want


def test_groups_stay_whole_across_batches():
    """Groups that begin, end or go on at the bounds of batches, and empty batches."""
    keys = [1, 1, 2, 2, 2, 2, 2, 3, 4, 4]
    t = overlap.pa.table({"h": keys, "lo": [0] * 10, "hi": [0] * 10})
    for size in (1, 2, 3, 10):
        empty = t.slice(0, 0).combine_chunks().to_batches() or [t.to_batches()[0].slice(0, 0)]
        got = []
        for part, at in overlap._whole(iter([*empty, *t.to_batches(max_chunksize=size), *empty])):
            got += [part.column("h").to_pylist()[a:b] for a, b in zip(at, at[1:], strict=False)]
        assert got == [[1, 1], [2] * 5, [3], [4, 4]]
    assert list(overlap._whole(iter([]))) == []


def test_fingerprints_link_first(spark, monkeypatch):
    """Without the join that completes them, groups are those of checked fingerprint links; with it, all similar texts."""
    r = np.random.default_rng(9)
    base = list(r.choice(VOCAB, 400))
    others = {far(" ".join(base), t): t for t in (" ".join(changed(base, r, n)) for n in (1, 1, 2, 2, 4, 6, 7, 8, 8, 8))}
    near, apart = others[min(others)], others[max(others)]
    assert min(others) <= 4 < max(others) and jaccard(grams(" ".join(base)), grams(apart)) >= 0.8
    again = " ".join(["over and over once more"] * 300)
    rows = [(1, " ".join(base)), (2, near), (3, apart), (4, again + " " + " ".join(r.choice(VOCAB, 40))), (5, again + " " + " ".join(r.choice(VOCAB, 40)))]
    docs = spark.createDataFrame(rows, SCHEMA)
    assert sorted(x.doc_id for x in simhash.keep_one(docs, width=5, least=0.8).collect()) == [1, 4, 5]
    monkeypatch.setattr(overlap, "_stars", lambda met, least: met.select("x.node", "lead.node").limit(0))
    monkeypatch.setattr(overlap, "_grouped", lambda members, tree, w: members.limit(0))
    assert sorted(x.doc_id for x in simhash.keep_one(docs, width=5, least=0.8).collect()) == [1, 3, 4, 5]


def test_marks_are_the_fingerprints():
    for text in (None, "", " \n", "a b", "a b c d e", " ".join(VOCAB), " ".join(VOCAB[:7] * 3)):
        assert simhash.majority(overlap.hashes(text, 5)) == simhash.fingerprint(text, 5)


def test_wide_parities():
    """Never more differ than shingles do, whatever the widths; sets are told apart that few bits don't tell."""
    r = np.random.default_rng(10)
    for n, more in ((600, 10), (1000, 200), (1030, 300), (5000, 1200)):
        a = np.unique(r.integers(-(1 << 62), 1 << 62, n))
        b = np.unique(np.concatenate((a[more:], r.integers(-(1 << 62), 1 << 62, more))))
        got = overlap.differing(overlap.wide(a), overlap.wide(b))
        assert 1.2 * more < got <= len(np.setxor1d(a, b))
        assert got == overlap.differing(overlap.wide(b), overlap.wide(a))
    assert overlap.wide(np.arange(overlap.LONG)) is None
    a, b = np.arange(600), np.arange(1030)  # 2048 and 4096 bits
    assert overlap.differing(overlap.wide(a), overlap.wide(b)) == 430


def test_sets_of_long_different_texts_stay(spark, monkeypatch):
    """They share enough shingles to meet, too few to be similar, and too many for the narrow parities to tell."""
    r = np.random.default_rng(12)
    base = list(r.choice(VOCAB, 4000))
    rows = [(i, " ".join(base[:3000] + list(r.choice(VOCAB, 1000)))) for i in range(4)]
    assert 0.5 < jaccard(grams(rows[0][1]), grams(rows[1][1])) < 0.7
    read, table = [], overlap.table

    def spy(df, label):
        got = table(df, label)
        read.extend([got.count()] * (label == "overlap-sets"))
        return got

    monkeypatch.setattr(overlap, "table", spy)
    got = simhash.keep_one(spark.createDataFrame([*rows, (9, rows[0][1] + " one more")], SCHEMA), width=5, least=0.8)
    assert sorted(x.doc_id for x in got.collect()) == [0, 1, 2, 3]
    assert sum(read) == 2
