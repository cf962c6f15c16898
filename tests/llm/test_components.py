import random

import pytest

from strongroom.llm.components import connected_components


def plain(edges):
    least = {}
    for a, b in edges:
        least.setdefault(a, a), least.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(least[a], least[b])
            changed |= least[a] != m or least[b] != m
            least[a] = least[b] = m
    return {k: v for k, v in least.items() if k != v}


CHAIN = [(i * 7 % 101, (i + 1) * 7 % 101) for i in range(100)]
STAR = [(500, 1000 + i) for i in range(200)]


@pytest.mark.parametrize("edges", [CHAIN, STAR, CHAIN + STAR + [(5, 5), (-3, 500), (-3, 500)], [(random.Random(1).randrange(10**6), random.Random(i).randrange(90)) for i in range(60)], [(random.Random(i).randrange(120), random.Random(i + 999).randrange(120)) for i in range(90)]])
def test_against_plain_propagation(spark, edges):
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == plain([e for e in edges if e[0] != e[1]])


def test_none_and_nulls(spark):
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert connected_components(spark.createDataFrame([(None, 1), (2, None), (3, 4)], "a long, b long")).collect() == [(4, 3)]
