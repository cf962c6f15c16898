import random
import zlib

import numpy as np
import pytest

from strongroom.llm import langid as L

PARTS = {"aa": ["ba", "ko", "tion", "the"], "bb": ["schu", "ung", "ker", "ein"], "cc": ["да", "про", "ка", "ние"], "dd": ["ci", "ez", "ado", "lla"]}


def prose(r, lang, n):
    return " ".join("".join(r.choices(PARTS[lang], k=r.randint(1, 4))) for _ in range(n))


def rows(seed, n=200):
    r = random.Random(seed)
    return [(i, prose(r, lang := r.choice(list(PARTS)), r.randint(2, 40)), lang) for i in range(n)]


@pytest.fixture(scope="module")
def model(spark):
    return L.fit(spark.createDataFrame([*rows(1), (900, None, "aa"), (901, "ba ba", None), (902, "12", "zz")], "doc_id long, text string, lang string"))


def test_learnt_and_held_out(spark, model):
    assert model.languages == ("aa", "bb", "cc", "dd")
    test = rows(2)
    docs = spark.createDataFrame([(*x, "s") for x in test], "doc_id long, text string, lang string, score string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in L.identify(docs, model).collect()}
    assert np.mean([got[i][0] == lang for i, _, lang in test]) > 0.98
    assert all(0 <= s <= 1 for _, s in got.values())


def test_spans_of_mixed_text(model):
    r = random.Random(3)
    a, b, c = prose(r, "aa", 30), prose(r, "cc", 20), prose(r, "bb", 30)
    assert [(s[2], s[1] - s[0]) for s in model.spans(f"{a} {b}. {c}")] == [("aa", len(a)), ("cc", len(b)), ("bb", len(c))]
    assert model.language(f"{a} {b}. {c}")[1] < 0.7


def plain_viterbi(s, penalty):
    import itertools

    best = max(itertools.product(range(s.shape[1]), repeat=len(s)), key=lambda p: sum(s[t, k] for t, k in enumerate(p)) - penalty * sum(x != y for x, y in zip(p, p[1:])))
    return sum(s[t, k] for t, k in enumerate(best)) - penalty * sum(x != y for x, y in zip(best, best[1:]))


@pytest.mark.parametrize("seed", range(30))
def test_path_is_the_best_of_all(seed):
    r = np.random.default_rng(seed)
    k = int(r.integers(1, 4))
    m = L.Model(tuple("abc"[:k]), np.zeros((1, k)), np.ones((1, k), bool))
    s = r.normal(size=(int(r.integers(1, 8)), k)) * r.choice([0.5, 2, 5])
    path = m.path(s, 2.0)
    value = sum(s[t, p] for t, p in enumerate(path)) - 2.0 * sum(x != y for x, y in zip(path, path[1:]))
    assert value == pytest.approx(plain_viterbi(s, 2.0))


def test_edges(spark, model):
    docs = spark.createDataFrame([(1, None), (2, ""), (3, "12 +-*"), (3, "12 +-*"), (None, "the tion"), (5, "İİ ﬁ 𐐀 한국"), (6, "ba " * 50000)], "doc_id long, text string")
    got = [(r.doc_id, r.lang_pred) for r in L.identify(docs, model).collect()]
    assert got[:5] == [(1, "und"), (2, "und"), (3, "und"), (3, "und"), (None, "aa")] and got[5][1] in model.languages and got[6][1] == "aa"
    assert L.identify(docs.limit(0), model).count() == 0
    nothing = L.fit(docs.selectExpr("doc_id", "text", "cast(null as string) as lang"))
    assert {r.lang_pred for r in L.identify(docs, nothing).collect()} == {"und"}


def test_script_narrows(model):
    assert model.language("про")[0] == "cc"
    w = L.words("про ba")
    s = model.scores(w)
    assert s[0, 2] > s[0, [0, 1, 3]].max() + 900 and s[1, 2] < s[1, 0] - 900


def test_query_folds(spark):
    from strongroom.llm.toxicity import crc_of

    got = [r[0] for r in spark.range(50).select(crc_of("id", 5)).collect()]
    assert got == [zlib.crc32(str(i).encode()) % 5 for i in range(50)]
