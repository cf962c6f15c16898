import numpy as np
import pytest

from strongroom.llm import simhash as S
from strongroom.llm.components import connected_components


def near_values(seed, n=40, most=8):
    r = np.random.default_rng(seed)
    found = set()
    for b in r.integers(-(2**63), 2**63, n):
        found.add(int(b))
        for _ in range(5):
            flips = sum(1 << int(k) for k in r.choice(63, r.integers(1, most), replace=False))
            found.add(int(b) ^ flips)
    return sorted(found)


def groups(fps, radius):
    values = np.array(fps, np.int64).view(np.uint64)
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= radius
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], len(fps)).min(axis=1)
        if (new == label).all():
            return [fps[i] for i in label]
        label = new


def found(spark, fps, radius, **options):
    edges = S.links(spark.createDataFrame([(x,) for x in fps], "fp long"), radius, **options)
    roots = {x.node: x.root for x in connected_components(edges).collect()}
    return [roots.get(x, x) for x in fps]


@pytest.mark.parametrize("radius", [1, 2, 3, 4, 5, 6])
def test_links_of_any_radius(spark, radius):
    fps = near_values(radius)
    assert found(spark, fps, radius) == groups(fps, radius)


def test_links_by_an_unequal_plan(spark, monkeypatch):
    low, mid, high = (1 << 21) - 1, (1 << 42) - (1 << 21), (1 << 64) - (1 << 42)
    fps = near_values(9)
    for plan in ([(low, 0), (mid, 0), (high, 1)], [(low, 2), (mid | high, 0)], [(low | mid | high, 3)]):
        monkeypatch.setattr(S, "plan_search", lambda *_, plan=plan: plan)
        assert found(spark, fps, 3, block=16) == groups(fps, 3)


def test_thresholds_are_unequal_where_that_is_cheaper():
    r = np.random.default_rng(0)
    plan = S.plan_search(r.integers(-(2**63), 2**63, 20_000), 10**7)
    assert sorted(t for _, t in plan) == [0, 0, 1]
    # Bits that hardly vary: their parts are not probed, the others further around.
    still = r.integers(0, 2**24, 20_000) << 3
    plan = S.plan_search(still, 10**6)
    assert sum(t + 1 for _, t in plan) == S.RADIUS + 1
    assert all(mask & (2**24 - 1) << 3 for mask, _ in plan)


def test_estimate_is_like_the_count():
    r = np.random.default_rng(4)
    values = np.unique(r.integers(0, 2**10, 2_000).astype(np.uint64) << np.uint64(7) | r.integers(0, 2**6, 2_000).astype(np.uint64) << np.uint64(30))
    for mask in (0b1111111 << 7, 0b111111 << 30, 0b111 << 7 | 0b11 << 30):
        apart = np.bitwise_count((values[:, None] ^ values[None, :]) & np.uint64(mask))[np.triu_indices(len(values), 1)]
        for t, guess in enumerate(S.expected(values[::2], mask, 3, len(values))):
            assert guess == pytest.approx((apart <= t).sum(), rel=0.15)


def test_one_document_and_long_texts(spark):
    one = spark.createDataFrame([(7, "a b c")], "doc_id long, text string")
    assert [(r.doc_id, r.component_id) for r in S.near_duplicates(one).collect()] == [(7, 7)]
    assert S.keep_one(one).count() == 1
    long = "word other third " * 400_000
    docs = spark.createDataFrame([(1, long), (2, long), (3, long + "end")], "doc_id long, text string")
    assert {r.component_id for r in S.near_duplicates(docs).collect()} == {1}
