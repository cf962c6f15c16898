import random
import re
from collections import Counter

import duckdb
import pandas as pd
import pytest

from strongroom.llm import licenses as L


def bag(words):
    return Counter(words if len(words) == 1 else zip(words, words[1:]))


def plain(rows, templates, threshold=0.8):
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        for k, unit in enumerate([text or "", *lines] if len(lines) > 1 else ["", *lines]):
            own = re.findall("[a-z0-9]+", "".join(c.lower() if c.isascii() else c for c in unit))
            for license, template in set(templates):
                other = re.findall("[a-z0-9]+", (template or "").lower())
                if own and other:
                    a, b = bag(own), bag(other)
                    dice = 2.0 * (a & b).total() / (a.total() + b.total())
                    if dice >= threshold:
                        out.append((doc, k, license, template, dice))
    return sorted(out, key=str)


def texts():
    r = random.Random(2)
    filler = "the of a software license under rights version permission to use any".split()
    rows = []
    for i in range(120):
        lines = [" ".join(r.choices(filler, k=r.randint(0, 12))) for _ in range(r.randint(0, 3))]
        words = r.choice(L.TEMPLATES)[1].split()
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(["", "x", "the the"])
        lines.insert(r.randint(0, len(lines)), " ".join(words))
        rows.append((i, "\n".join(lines)))
    whole = L.TEMPLATES[5][1].split()
    return [*rows, (200, "\n".join(" ".join(whole[k : k + 9]) for k in range(0, len(whole), 9))), (201, None), (202, ""), (203, "\n\n"), (3, rows[3][1]), (None, "All rights reserved."), (204, "word " * 20000), (205, "a a a a a"), (206, "é")]


def test_against_brute_force(spark):
    rows = texts()
    docs = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, line string")
    got = sorted((tuple(r) for r in L.scan(docs).collect()), key=str)
    assert got == plain(rows, L.TEMPLATES) and any(r[:2] == (200, 0) for r in got)


@pytest.mark.parametrize("threshold", [0.5, 1.0])
def test_other_templates(spark, threshold):
    templates = [("A", "a a a a"), ("B", "one"), ("B", "one"), (None, "x y z"), ("C", None), ("D", "...")]
    rows = [(1, "a a a\none\nx y"), (2, "a a a a a"), (3, "x y z"), (4, "two")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame(templates, "license string, template string")
    assert sorted((tuple(r) for r in L.scan(docs, table, threshold).collect()), key=str) == plain(rows, templates, threshold)
    assert L.scan(docs, table.limit(0)).count() == 0 and L.scan(docs.limit(0)).count() == 0


def test_against_sql(spark):
    rows = texts()
    documents = pd.DataFrame([r for r in rows if r[0] is not None], columns=["doc_id", "text"])  # noqa: F841
    want = sorted(duckdb.sql(L.ORACLE).fetchall(), key=str)
    docs = spark.createDataFrame([r for r in rows if r[0] is not None], "doc_id long, text string")
    assert sorted((tuple(r) for r in L.scan(docs).collect()), key=str) == want


def test_wrapped_notices_inside_a_text(spark):
    """Each long template in lines of 9 words with comment marks, amid other lines; twice in one text; repeated rows."""
    prose = [f"line {k} tells of other matters, with words like {k * 7} and {k * 11} in it" for k in range(40)]
    long = [(a, b) for a, b in L.TEMPLATES if len(b.split()) > 20]

    def wrapped(template):
        w = template.split()
        return [" * " + " ".join(w[k : k + 9]) for k in range(0, len(w), 9)]

    rows = [(i, "\n".join([*prose[:20], " *", *wrapped(b), "", *prose[20:]])) for i, (a, b) in enumerate(long)]
    mit, isc = long[2][1], next(b for a, b in long if a == "ISC")
    cut = wrapped(mit)
    cut[3:3] = [" *", " * page two"]
    rows += [(50, "\n".join([*prose, *wrapped(isc), *wrapped(isc)])), (51, "\n".join([*prose, *cut, *prose])), (0, rows[0][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(L.scan(docs).collect(), key=str)
    want = [(i, 22, a, b) for i, (a, b) in enumerate(long)] + [(0, 22, *long[0]), (50, 41, "ISC", isc), (50, 41 + len(wrapped(isc)), "ISC", isc), (51, 41, *long[2])]
    kinds = {b for a, b in long}
    assert len(long) >= 6
    assert sorted(tuple(r)[:4] for r in got if r.template in kinds) == sorted(want)
    assert all(r.dice == 1.0 for r in got if r.template in kinds and r.doc_id != 51)


def test_more_words_than_prune(spark, monkeypatch):
    docs = spark.createDataFrame(texts(), "doc_id long, text string")
    want = sorted((tuple(r) for r in L.scan(docs).collect()), key=str)
    monkeypatch.setattr(L, "MOST_WORDS", 10)
    assert sorted((tuple(r) for r in L.scan(docs).collect()), key=str) == want
    many = spark.range(3000).selectExpr("concat('L', id) as license", "concat('license number ', id, ' of word', id, ' and more') as template")
    few = docs.sparkSession.createDataFrame([(1, "License number 77 of word77 and more"), (2, "x\nlicense number 2999\nof word2999 and more\ny")], "doc_id long, text string")
    assert sorted((r.doc_id, r.license, r.dice) for r in L.scan(few, many, 0.95).collect()) == [(1, "L77", 1.0), (2, "L2999", 1.0)]
