import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from sentencepiece import sentencepiece_model_pb2

from strongroom.llm import sentencepiece_scan as S

TEXTS = ["", " ", "a", "Hello  world", " a  b ", "café 😀\n\tx", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa" * 3, "東京都に住んでいます。これは長い文です" * 4, "x" * 70 + " y", "the cat\nsat on  the   mat\n\n    indented = 1", "1234567890" * 12, "naïve Ünïcödé ßtraße", "\u0000\u0001", "don't stop-believing... (really!)", "ReadWriteLock<HashMap<String,Vec<u8>>>"]


def model(kind):
    proto = sentencepiece_model_pb2.ModelProto.FromString(open(S.MODEL, "rb").read())
    if kind == "unigram":
        r = random.Random(1)
        proto.trainer_spec.model_type = 1
        for p in proto.pieces:
            if p.type == 1:
                p.score = -2.0 - r.random() * 8 - 0.2 * len(p.piece)
    return proto


@pytest.fixture(scope="module", params=["bpe", "unigram"])
def both(request):
    proto = model(request.param)
    return S.Pieces.parse(proto), sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())


def samples():
    r = random.Random(4)
    letters = "abcdefghijklmnoprstuvwyz    éñß.,-\n東"
    return TEXTS + ["".join(r.choices(letters, k=r.randint(1, 120))) for _ in range(150)]


def in_chunks(p, text, size):
    parts = list(S.chunks(p.normal(text), size, p.longest))
    if not parts:
        return []
    path = S.edges([p.matrix(*x) for x in parts])
    return [i for x, (row, column) in zip(parts, path, strict=True) for i in p.backtrace(*x, row, column)]


def test_ids_are_the_librarys(both):
    p, library = both
    for text in samples():
        assert p.encode(p.normal(text)) == library.encode(text), text
        assert p.decode(library.encode(text)) == text


@pytest.mark.parametrize("size", [20, 37, 64])
def test_chunks_give_the_same(both, size):
    p, library = both
    for text in samples():
        got, want = in_chunks(p, text, size), library.encode(text)
        if p.bpe:
            assert got == want, text
        else:  # paths of equal score may differ
            assert p.decode(got) == text and sum(p.scores[i] for i in got) == pytest.approx(sum(p.scores[i] for i in want), rel=1e-5)


def test_combine_is_associative():
    r = np.random.default_rng(0)
    a, b, c = r.normal(size=(2, 3)), r.normal(size=(3, 4)), r.normal(size=(4, 2))
    assert np.allclose(S.combine(S.combine(a, b), c), S.combine(a, S.combine(b, c)))


def test_on_spark(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3]), (None, TEXTS[7]), (50, None), (51, " ".join(TEXTS) * 5)]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, ids string")
    got = S.encoded_and_back(docs, chunk=48).collect()
    key = lambda x: (x[0] is None, str(x))
    want = [(i, len(ids := library.encode(t or "")), ids, hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows]
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert S.encoded_and_back(docs.limit(0)).count() == 0
