"""Counts, ratios, chi-squared, fit and scores against plain Python over the n-grams of a small table."""

import functools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from strongroom.llm import toxicity as X
from tests.llm.test_toxicity import frames, rows


@functools.lru_cache(maxsize=1000)
def grams(text):
    """The distinct buckets, one n-gram at a time."""
    points = [ord(c) for c in f" {' '.join(text.lower().split())} "]
    found = set()
    for n in (3, 4, 5):
        for i in range(len(points) - n + 1):
            h = points[i]
            for c in points[i + 1 : i + n]:
                h = (h * 0x100000001B3 + c) % 2**64
            found.add(h * 0x9E3779B97F4A7C15 % 2**64 >> 64 - X.BITS)
    return found


@pytest.fixture(scope="module")
def fitted(spark):
    table = rows(200, 21)
    docs, labels = frames(spark, table)
    return table, X.fit(docs, labels, grid=[(4.0, 1e-2)])


def test_fit_is_the_plain_one(fitted):
    table, model = fitted
    toxic, clean = Counter(), Counter()
    for _, text, y in table:
        (toxic if y else clean).update(grams(text))
    n1 = sum(y for *_, y in table)
    n0, names = len(table) - n1, sorted(toxic | clean)
    total1, total0 = sum(toxic[g] + 1 for g in names), sum(clean[g] + 1 for g in names)

    def chi(g):
        a, b, held = toxic[g], clean[g], toxic[g] + clean[g]
        return 0 if held < 2 else (a * (n0 - b) - b * (n1 - a)) ** 2 * len(table) / (n1 * n0 * held * (len(table) - held) + 1e-9)

    kept = [g for g in names if chi(g) >= 4]
    assert sorted(np.flatnonzero(model.slot < len(model.weights) - 1)) == kept
    # At the optimum the penalised gradient is nothing: sum of share * (p - y) * ratio over holders, plus penalty * weight / ratio.
    chosen = set(kept)
    p = {i: 1 / (1 + math.exp(-model.bias - sum(model.weights[model.slot[g]] for g in grams(text) if g in chosen))) for i, text, _ in table}
    assert sum(p[i] - y for i, _, y in table) / len(table) == pytest.approx(0, abs=2e-3)
    for g in kept:
        ratio = math.log((toxic[g] + 1) / total1) - math.log((clean[g] + 1) / total0)
        slope = sum(p[i] - y for i, text, y in table if g in grams(text)) / len(table) * ratio + 1e-2 * model.weights[model.slot[g]] / ratio
        assert slope == pytest.approx(0, abs=5e-3)


def test_scores_are_the_plain_ones(spark, fitted):
    table, model = fitted
    texts = [*[t for _, t, _ in table[:40]], "", "a", "xy grumblesnark", "vilewort " * 30_000]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "doc_id long, text string")
    got = {r.doc_id: (r.score, r.predicted) for r in X.score(docs, model).collect()}
    for i, text in enumerate([*texts, ""]):
        want = 1 / (1 + math.exp(-model.bias - sum(model.weights[model.slot[g]] for g in grams(text))))
        assert got[i][0] == pytest.approx(want, abs=1e-9) and got[i][1] == int(got[i][0] >= 0.7)


def test_query_learns_nothing_of_the_held_out(spark, tmp_path):
    """The query's scores don't change with the labels of the held-out documents."""
    from strongroom.llm.queries import op10_toxicity

    table = rows(150, 8)
    out = []
    for flip in (0, 1):
        folder = tmp_path / str(flip)
        docs, _ = frames(spark, table)
        held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
        labels = spark.createDataFrame([(i, (1 - y) if flip and held(i) else y, 0) for i, _, y in table], "doc_id long, toxic int, quality int")
        docs.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        out.append(sorted((r.doc_id, r.held_out, round(r.score, 9)) for r in op10_toxicity(spark, str(folder)).collect()))
        assert all(h == held(i) for i, h, _ in out[-1])
    assert out[0] == out[1]


def test_choice_is_of_the_examples_only():
    r = np.random.default_rng(1)
    label = (r.random(200) < 0.4).astype(float)
    held = [np.flatnonzero(r.random(60) < np.where(np.arange(60) < 3, 0.1 + 0.8 * y, 0.3)) for y in label]
    examples = X.Examples(np.repeat(np.arange(200), [len(h) for h in held]), np.concatenate(held), label, np.full(200, 1 / 200), 60)
    ratio = X.log_ratio(*examples.held())
    chi, penalty = X.choose(examples)
    assert (chi, penalty) in X.GRID
    weights, _ = X.learn(examples, ratio, chi, penalty)
    assert (weights[:3] > 0).all() and np.abs(weights[:3]).min() > np.abs(weights[3:]).max()
