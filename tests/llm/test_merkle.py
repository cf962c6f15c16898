import hashlib
import re

import pytest
from pyspark.sql import functions as F

from strongroom.llm import merkle as M


def h(s):
    return hashlib.sha256(s.encode()).hexdigest()


def plain(text):
    text = text or ""
    sections, leaves, nodes, written = re.split(r"\n[ \t]*\n\s*", text), set(), [], ""
    for s in sections:
        hs, w = [], ""
        for p in s.split("\n"):
            own = [h(x) for x in re.findall(r"[^.!?]{1,120}[.!?]*|[.!?]+", p)]
            leaves |= {x[:12] for x in own}
            hs.append(h("".join(own)))
            w += f"{hs[-1][:12]}({' '.join(x[:12] for x in own)})"
        nodes.append(h("".join(hs)))
        written += f"{nodes[-1][:12]}({w})"
    return f"{h(''.join(nodes))}:{written}", leaves


def near(a, b):
    (fa, la), (fb, lb) = plain(a), plain(b)
    return 1.0 if fa[:64] == fb[:64] or not la | lb else 2 * len(la & lb) / (len(la) + len(lb))


TEXTS = ["", None, "One. Two! Three?\nFour", "One. Two! Three?\nFour", "é" * 500 + "\n\nß" * 3, "a\n \n\nb\n\n", "...\n", "x" * 9000, "w. " * 3000, "One. Two. Five.\n\nSix. Seven."]


@pytest.mark.parametrize("ranges", [2, 5, 256])
def test_against_brute_force(spark, ranges):
    rows = [(i * 7 - 3, t) for i, t in enumerate(TEXTS)] + [(None, "no id."), (4, "again. b"), (4, "again. b"), (4, "again. a")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, fingerprint string").repartition(4)
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, (r[1] or "").encode()))
    want = []
    for i, (doc, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        k = len(text) // 4
        edit = text[: len(text) - k] + after[:k]
        want.append((doc, len(text), h(edit), plain(text)[0], plain(edit)[0], near(text, edit), near(text, after)))
    got = [tuple(r) for r in M.edited(docs, ranges).collect()]
    assert sorted(got, key=str) == sorted(want, key=str)


def test_likeness_and_changed_sections_from_fingerprints(spark):
    pairs = [(a, b) for a in TEXTS for b in TEXTS]
    df = spark.createDataFrame([(plain(a)[0], plain(b)[0]) for a, b in pairs], "a string, b string")
    assert [r[0] for r in df.select(M.likeness(F.col("a"), F.col("b"))).collect()] == [near(a, b) for a, b in pairs]
    a, b = plain("One. Two.\n\nThree.\nFour.\n\nFive.")[0], plain("One. Two.\n\nThree.\nFour!\n\nFive.")[0]
    df = spark.createDataFrame([(a, b), (a, a)], "a string, b string")
    assert [r[0] for r in df.select(M.changed_sections(F.col("a"), F.col("b"))).collect()] == [[1], []]


def test_one_row_and_none(spark):
    one = spark.createDataFrame([(1, "ab. cdef")], "doc_id long, text string")
    assert [(r.near_next, r.edited_sha256) for r in M.edited(one).collect()] == [(1.0, h("ab. cdab"))]
    assert M.edited(one.limit(0)).count() == 0 and M.fingerprints(one).first().fingerprint == plain("ab. cdef")[0]


def plain_whole(text):
    parts = re.split(r"(\n[ \t]*\n\s*)", text)
    nodes, written = [], ""
    for separator, s in zip([None, *parts[1::2]], parts[::2], strict=True):
        trees = [re.findall(r"[^.!?]{1,120}[.!?]*|[.!?]+", p) for p in s.split("\n")]
        trees = trees if separator is None else [[separator], *trees]
        hs = [h("".join(map(h, t))) for t in trees]
        nodes.append(h("".join(hs)))
        written += f"{nodes[-1][:12]}({''.join(f'{x[:12]}({chr(32).join(h(y)[:12] for y in t)})' for x, t in zip(hs, trees, strict=True))})"
    return f"{h(''.join(nodes))}:{written}"


def test_whole_tree_holds_blank_lines_and_indents(spark):
    texts = ["a\n\nb", "a\n\n\n\nb", "a\n\n b", "a\n \nb", "a\n\nb\n\n", "\n\na\n\nb", "a\nb", "a\n\n\tb", *(t for t in TEXTS if t and "..." not in t and not t.startswith("One. Two! Three"))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.fingerprint for r in M.fingerprints(docs, whole=True).collect()}
    assert [got[i] for i in range(len(texts))] == [plain_whole(t) for t in texts]
    assert len({f[:64] for f in got.values()}) == len(texts)
    # Without blank lines nothing changes; the one row's edit has them.
    rows = M.edited(docs.where("doc_id = 6"), whole=True).collect()
    assert rows == M.edited(docs.where("doc_id = 6")).collect() and rows[0].fingerprint == got[6]
    both = M.edited(docs.where("doc_id < 2"), whole=True).collect()
    assert {r.doc_id: r.fingerprint for r in both} == {0: got[0], 1: got[1]} and all(r.near_next < 1 for r in both)


def test_one_document_and_very_long_texts(spark):
    one = M.edited(spark.createDataFrame([(1, "a b. c d", "z")], "doc_id long, text string, h string")).collect()
    assert [(r.doc_id, r.near_next) for r in one] == [(1, 1.0)] and len(one) == 1
    long = "One more sentence of many. " * 40_000
    rows = M.edited(spark.createDataFrame([(1, long), (2, long), (2, long)], "doc_id long, text string")).collect()
    assert [r.n_chars for r in rows] == [len(long)] * 3 and len({r.fingerprint for r in rows}) == 1


def test_whole_against_sql(spark):
    import duckdb
    import pandas as pd

    texts = [*TEXTS, "a\n\nb. c", "a\n\n\n b. c", "x.\n \n\n\ty\nz\n\nlast", "\n\n", "no blank\nlines! here"]
    documents = pd.DataFrame({"doc_id": range(len(texts)), "text": texts})  # noqa: F841
    want = sorted(duckdb.sql(M.ORACLE).fetchall(), key=str)
    got = sorted((tuple(r) for r in M.edited(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), whole=True).collect()), key=str)
    assert got == want


def test_changed_sections_locate_an_edit(spark):
    text = "First. One.\n\nSecond part.\n\nThird. " + "More words here. " * 3 + "\n\nLast section of the text, which is long enough to take all of the edit."
    docs = spark.createDataFrame([(1, text), (2, "Other. Words.")], "doc_id long, text string")
    row = M.edited(docs, whole=True).select("doc_id", M.changed_sections(F.col("fingerprint"), F.col("edited_fingerprint")).alias("c")).where("doc_id = 1").first()
    assert row.c == [3]
