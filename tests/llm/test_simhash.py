import random

import numpy as np
import pytest
import xxhash

from strongroom.llm import simhash as S


def slow_simhash(text):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(ids, fps):
    parent = list(range(len(ids)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(ids)):
        for j in range(i):
            if bin((fps[i] ^ fps[j]) & (1 << 64) - 1).count("1") <= 3:
                parent[root(i)] = root(j)
    least = {}
    for i, x in enumerate(ids):
        least[root(i)] = min(x, least.get(root(i), x))
    return [least[root(i)] for i in range(len(ids))]


@pytest.mark.parametrize("text", [None, "", "one", "One TWO", "a b c", "É a B c d", "x\ty\nz w " * 50])
def test_fingerprint_is_the_plain_one(text):
    assert S.simhash(text) & (1 << 64) - 1 == slow_simhash(text)


def test_jvm_hash_is_the_same(spark):
    got = spark.sql("select xxhash64('a b c') h").first().h
    assert S._hash(b"a b c") == got & (1 << 64) - 1


def near_texts(seed, n):
    r, out = random.Random(seed), []
    vocab = ["".join(r.choices("abcdefgh", k=5)) for _ in range(400)]
    while len(out) < n:
        base = r.choices(vocab, k=300)
        for _ in range(r.choice([1, 1, 2, 12])):
            out.append(" ".join(base))
            base = [*base]
            base[r.randrange(300)] = r.choice(vocab)
    return out[:n]


@pytest.mark.parametrize("block", [2048, 4])
def test_components_match_brute_force(spark, block):
    texts = [*near_texts(1, 300), None, "", "  ", "ab", "ab"]
    rows = [(i * 3 + 1, t, i) for i, t in enumerate(texts)]
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, component_id int"), block=block).collect()}
    fps = [slow_simhash(t) for t in texts]
    want = brute_components([r[0] for r in rows], fps)
    assert [got[r[0]] for r in rows] == list(zip(fps, want, strict=True))
    assert len(set(want)) < len(rows) - 20


def test_all_links_are_found_among_random_values(spark):
    r = np.random.default_rng(5)
    base = r.integers(0, 2**63, 60)
    fps = {int(b) for b in base}
    for b in base:
        for _ in range(6):
            fps.add(int(b) ^ sum(1 << int(k) for k in r.choice(62, r.integers(1, 6), replace=False)))
    fps = sorted(fps)
    edges = S.links(spark.createDataFrame([(x,) for x in fps], "fp long"))
    from strongroom.llm.components import connected_components

    roots = {x.node: x.root for x in connected_components(edges).collect()}
    assert [roots.get(x, x) for x in fps] == brute_components(fps, fps)


@pytest.mark.parametrize("seed", range(3))
def test_plan_keeps_the_pigeonhole(seed):
    r = np.random.default_rng(seed)
    for total in (10, 10**6, 10**11):
        plan = S.plan_search(r.integers(-(2**63), 2**63, 500), total)
        assert sum(t + 1 for _, t in plan) == S.RADIUS + 1
        union = 0
        for mask, _ in plan:
            assert union & mask == 0
            union |= mask


@pytest.mark.parametrize("most", [0, 10**6])
def test_empty_null_and_repeated(spark, monkeypatch, most):
    monkeypatch.setattr(S, "BROADCAST_IDS", most)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.near_duplicates(empty).count() == 0
    rows = [(1, "a b c d", "x"), (1, "a b c d", "x"), (2, "a b c d", "y"), (None, "q r s t u v", "z"), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, __dropped string")
    assert S.near_duplicates(docs).count() == 5
    kept = S.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 5]
