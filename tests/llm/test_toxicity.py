import random

import numpy as np
import pytest

from strongroom.llm import toxicity as X

BAD = ["grumblesnark", "vilewort", "crudbucket"]


def rows(n, seed):
    r, out = random.Random(seed), []
    syllables = ["ba", "ko", "li", "me", "nu", "ra", "so", "ti"]
    for i in range(n):
        words = ["".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(r.randint(3, 80))]
        toxic = int(r.random() < 0.3)
        for _ in range(toxic * r.randint(1, 3)):
            words.insert(r.randrange(len(words)), r.choice(BAD) + r.choice(["", "s", "ing"]))
        out.append((i, " ".join(words), toxic))
    return out


def frames(spark, table):
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in table], "doc_id long, text string, score string")
    return docs, spark.createDataFrame([(i, y, 0) for i, _, y in table], "doc_id long, toxic int, quality int")


def test_held_out_accuracy_and_reject(spark):
    docs, labels = frames(spark, rows(600, 1))
    model = X.fit(docs, labels, fit_rows=150)
    new, truth = frames(spark, rows(400, 2))
    got = {r.doc_id: r.predicted for r in X.score(new, model).collect()}
    want = {r.doc_id: r.toxic for r in truth.collect()}
    assert np.mean([got[i] == y for i, y in want.items()]) > 0.97
    kept = X.reject(new, labels.limit(0))
    assert kept.columns == new.columns and kept.count() == 400
    again = X.fit(docs.repartition(7), labels.repartition(3), fit_rows=150)
    assert np.allclose(model.weights, again.weights) and model.bias == pytest.approx(again.bias)


def test_buckets_are_those_of_the_whole_text_in_pieces(monkeypatch):
    text = " ".join(t for _, t, _ in rows(5, 3))
    whole = np.concatenate(list(X.gram_buckets(text)))
    monkeypatch.setattr(X, "_STEP", 37)
    assert sorted(np.unique(np.concatenate(list(X.gram_buckets(text))))) == sorted(np.unique(whole))


def test_only_labels_of_the_other_folds_are_learnt(spark):
    docs, labels = frames(spark, rows(300, 4))
    held = X.held_out_labels(labels, 3, 1)
    import zlib

    assert {r.doc_id for r in held.collect()} == {i for i in range(300) if zlib.crc32(str(i).encode()) % 3 != 1}


@pytest.mark.parametrize("toxic", [None, 0, 1, 7])
def test_one_class_null_and_empty(spark, toxic):
    docs = spark.createDataFrame([(1, None), (2, ""), (2, ""), (None, "abc"), (3, "x" * 5000)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, toxic), (None, 1), (2, toxic)], "doc_id long, toxic int")
    model = X.fit(docs, labels)
    got = X.score(docs, model).collect()
    assert len(got) == 5 and len({r.score for r in got}) == 1 and 0 <= got[0].score <= 1
    assert X.score(docs.limit(0), model).count() == 0
