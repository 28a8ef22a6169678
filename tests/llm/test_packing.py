import zlib

import numpy as np

from vexel.llm import packing
from vexel.llm.tokencount import tokenizer_path

PATH = tokenizer_path("word_bpe_49k.json")
TEXTS = ["", " ", None, "a\x1cb", "Ǆ ǅ İstanbul ßẞ", "²x½ 3½ ªº", "T̈ é K Å", "<|endoftext|> <|ENDOFTEXT|> a<|startoftext|>b", "it's we'll I'M 'd'x !'s", "中文 テスト 한글 12３", "\x85\xa0x　y", "ſecret ﬁ", "a_b __ --- ...!?'t", "\x00\x07", "word " * 5000, "same text here", "same text here"]


def library(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


def test_encoder_equals_library():
    e = packing.encoder(PATH)
    for _ in range(2):
        assert [x.tolist() for x in e.encode([(t or "").encode() for t in TEXTS])] == [library(t) for t in TEXTS]


def test_every_letter_of_the_fast_path():
    e = packing.encoder(PATH)
    chars = [chr(i) for i in range(1, 0x250)]
    texts = chars + [f"{c}ala fish" for c in chars] + [f"ma{c}o m{c}{c}x, {c}5" for c in chars]
    assert [x.tolist() for x in e.encode([t.encode() for t in texts])] == library_of(texts)


def library_of(texts):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(PATH)
    return [own.encode(t, add_special_tokens=False).ids for t in texts]


def test_hilbert_is_a_curve():
    grid = np.array([[a, b, c] for a in range(8) for b in range(8) for c in range(8)])
    key = packing.hilbert(grid, bits=3)
    assert sorted(key.tolist()) == list(range(512))
    path = grid[np.argsort(key)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_pieces_round_trip(spark):
    rows = [(i, t, "x") for i, t in enumerate(TEXTS)] + [(None, "no id", "x"), (3, "twice the id", "x"), (3, "twice the id", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, sequence_id string")
    got = packing.pack(df, PATH, length=64, with_ids=True).collect()
    by_place = {}
    for r in got:
        by_place.setdefault(r.sequence_id, []).append(r)
    full = 0
    for n, own in by_place.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length == len(r.ids) and zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32
            at += r.length
        assert at <= 64
        full += at == 64
    assert full >= len(by_place) - 1
    joined = sorted((r.sequence_id * 64 + r.offset, r) for r in got)
    docs, now = [], None
    for _, r in joined:
        if r.start == 0:
            now = [r.id, []]
            docs.append(now)
        assert r.start == len(now[1])
        now[1] += r.ids
        assert r.doc_tokens >= len(now[1])
    assert sorted(((-1 if i is None else i), tuple(x)) for i, x in docs) == sorted(((-1 if i is None else i), tuple([*library(t), 1])) for i, t, _ in rows)


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string"), PATH).count() == 0
