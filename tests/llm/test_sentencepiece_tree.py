import random

import numpy as np
import pyarrow as pa
import pytest
import sentencepiece

from strongroom.llm import sentencepiece_scan as S
from tests.llm.test_sentencepiece_scan import TEXTS, samples


@pytest.mark.parametrize("fan", [2, 3, 64])
@pytest.mark.parametrize("n", [1, 2, 5, 9, 30])
def test_tree_finds_the_best_path(fan, n):
    r = np.random.default_rng(n)
    sizes = [1, *r.integers(1, 5, n)]
    matrices = [np.where(r.random((a, b)) < 0.3, -np.inf, r.normal(size=(a, b))) for a, b in zip(sizes, sizes[1:])]
    matrices = [np.where(np.isinf(m).all(), 0.0, m) for m in matrices]
    path = S.edges(matrices, fan)
    assert path[0][0] == 0 and all(a[1] == b[0] for a, b in zip(path, path[1:]))
    best = S.product(matrices).max()
    assert sum(m[p] for m, p in zip(matrices, path, strict=True)) == pytest.approx(best) or np.isinf(best)


def test_numbers_is_a_map():
    r, want, got = np.random.default_rng(1), {}, S.Numbers(4)
    for _ in range(20):
        keys = np.setdiff1d(r.integers(0, 5000, 200), np.array(list(want), np.int64))
        values = r.integers(0, 100, len(keys)).astype(np.int32)
        got.put(keys, values)
        want |= dict(zip(keys.tolist(), values.tolist()))
    asked = np.arange(6000)
    assert got.get(asked).tolist() == [want.get(k, -1) for k in range(6000)]


def test_batches_forget_and_relearn(monkeypatch):
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    monkeypatch.setattr(S, "_CACHE", 50)
    monkeypatch.setattr(S, "_PAIRS", 60)
    monkeypatch.setattr(S, "_TOGETHER", 7)
    p = S.Pieces.load(S.MODEL)
    r = random.Random(9)
    texts = [*samples(), "▁a ▁ b", "x" * 300 + " " + "yz" * 200, "東京" * 90, "🙂 q🙂q 🙂", "a\n\n \n b"]
    for _ in range(4):
        r.shuffle(texts)
        for part in (texts[:90], texts[90:]):
            counts, ids = p.encode_texts(pa.array(part))
            assert [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])] == library.encode(part)
            assert p.decode_texts(counts, ids) == [t.replace("▁", " ") for t in part]


def test_giant_text_on_spark(spark):
    """Ten million code points: three levels of products with a fan of 16."""
    r = random.Random(3)
    words = ["".join(r.choices("abcdeilmnorstué", k=r.randint(1, 9))) for _ in range(5000)]
    text = " ".join(r.choices(words, k=1_900_000))[:10_000_000]
    assert len(text) == 10_000_000
    docs = spark.createDataFrame([(1, text), (2, "short"), (3, text[:40_000])], "doc_id long, text string")
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    rows = docs.selectExpr("doc_id", "sha2(text, 256) as sha", "text")
    got = {r.sha: r.ids for r in S.encode_long(rows.select("sha", "text"), fan=16).collect()}
    for row in rows.collect():
        assert got[row.sha] == library.encode(row.text)


def test_texts_at_the_edge_of_a_chunk(spark):
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    texts = [(" ".join(TEXTS) * 9)[:n] for n in (31, 32, 33, 63, 64, 65, 96, 97)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.ids for r in S.encode(docs, chunk=32).collect()}
    assert got == {i: library.encode(t) for i, t in enumerate(texts)}
