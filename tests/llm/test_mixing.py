import random
from collections import Counter, defaultdict

import duckdb
import pytest

from strongroom.llm import mixing as M


def fill(weights, caps, total):
    """Water-filling by bisection of the level."""
    lo, hi = 0.0, max((c / w for w, c in zip(weights, caps, strict=True)), default=0.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(c, w * mid) for w, c in zip(weights, caps, strict=True)) < total else (lo, mid)
    return [min(c, w * hi) for w, c in zip(weights, caps, strict=True)]


def table(seed, n=400, hot=True):
    r = random.Random(seed)
    sources = ["b", "a", "é", None, "Z", "", "😀", "�"]
    rows = []
    for i in range(n):
        source = "b" if hot and i % 3 == 0 else r.choice(sources)
        rows.append((i, " ".join("w" * r.randint(1, 3) for _ in range(r.choice([0, 1, 5, 40, 300]))), source))
    return [*rows, (7, rows[7][1], rows[7][2]), (7, rows[7][1], rows[7][2]), (None, "a b c", "a"), (9999, None, "nul")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, source string, target string").repartition(5)


@pytest.mark.parametrize("seed", range(2))
def test_targets_and_taken(spark, seed):
    rows = table(seed)
    got = M.mix(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = defaultdict(int)
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted(sizes, key=lambda s: (s is None, s))
    weights = [(5, 2, 1)[i % 3] for i in range(len(order))]
    want = dict(zip(order, fill(weights, [2 * sizes[s] for s in order], 1.5 * sum(sizes.values())), strict=True))
    source_of = {}
    for i, t, s in rows:
        source_of[(i, len((t or "").split()))] = s
    taken = Counter()
    for r in got:
        s = source_of[(r.doc_id, r["size"])]
        assert r.source_size == sizes[s] and r.target == pytest.approx(want[s], abs=0.01)
        assert 0 <= r.taken <= 2 * r["size"]
        taken[s] += r.taken
    for s in order:
        assert want[s] - 3.01 <= taken[s] <= want[s] + 0.01
    again = M.mix(frame(spark, rows).repartition(2)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


@pytest.mark.parametrize("seed", range(2, 4))
def test_against_sql(spark, monkeypatch, seed):
    if seed == 3:  # the way of very many sources
        monkeypatch.setattr(M, "BROADCAST_SOURCES", 2)
    documents = frame(spark, table(seed)).select("doc_id", "text", "source").toPandas()  # noqa: F841
    documents["doc_id"] = documents["doc_id"].astype("Int64")
    documents["text"] = documents["text"].astype(object).where(documents["text"].notna(), None)
    want = Counter(tuple(r) for r in duckdb.sql(M.ORACLE).fetchall())
    got = Counter(tuple(r) for r in M.mix(frame(spark, table(seed))).collect())
    assert got == want


def test_repeat_makes_what_mix_counts(spark):
    rows = table(5, 200)
    docs = frame(spark, rows).selectExpr("*", "char_length(text) as n_chars")
    counted = Counter()
    for r in M.mix(docs).collect():
        counted[r.doc_id] += r.taken
    out = M.repeat(docs)
    assert out.columns == docs.columns
    made = Counter()
    for r in out.collect():
        made[r.doc_id] += len((r.text or "").split())
        assert r.n_chars == (None if r.text is None else len(r.text))
    assert +made == +counted


def test_empty_and_all_null(spark):
    docs = frame(spark, table(1, 10))
    assert M.mix(docs.limit(0)).count() == 0 and M.repeat(docs.limit(0)).count() == 0
    only = spark.createDataFrame([(None, None, None), (1, "", None)], "doc_id long, text string, source string")
    assert [tuple(r) for r in M.mix(only).orderBy("doc_id").collect()] == [(None, 0, 0, 0.0, 0), (1, 0, 0, 0.0, 0)]


def test_clashing_names_and_long_texts(spark):
    rows = [(1, "w " * 300_000, "a", 1, "b", 2), (2, "x y", "a", 3, None, 4), (2, "x y", "a", 3, None, 4), (3, "", None, None, "c", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, __mix_cut int, __MIX_part string, __size int")
    out = M.repeat(docs)
    assert out.columns == docs.columns
    made, counted = Counter(), Counter()
    for r in out.collect():
        made[r.doc_id] += len((r.text or "").split())
    for r in M.mix(docs).collect():
        counted[r.doc_id] += r.taken
    assert +made == +counted and made[1] > 300_000
