import hashlib
import itertools
import random
import re

import numpy as np
import pytest

from strongroom.llm import pii as P


def plain_base(text):
    """Each pattern as stated, leftmost, non-overlapping."""
    out = []
    for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text):
        out.append((m.start(), 0, m.end()))
    for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text):
        if all(int(x) <= 255 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub("[^0-9]", "", m[0])
        total = sum(int(c) if i % 2 == 0 else sum(map(int, str(2 * int(c)))) for i, c in enumerate(reversed(d)))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text):
        if 10 <= len(re.sub("[^0-9]", "", m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return [(P.KINDS[k], s, e) for s, k, e in sorted(out)]


@pytest.fixture(scope="module")
def crf(spark):
    return P.train(P.labelled_table(spark))


@pytest.mark.parametrize("seed", range(40))
def test_base_spans_are_the_plain_ones(seed):
    r = random.Random(seed)
    bits = ["a", "@", "b.c", ".", "12", "255", "256", "0", " ", "-", "+", "(", ")", "4111111111111111", "é", "x@y.z", "@@", "1.2.3.4", "+1 (234) 555-0199", "\n", "007"]
    for _ in range(200):
        text = "".join(r.choices(bits, k=r.randint(0, 14)))
        assert P.base_spans(text) == plain_base(text), text


def test_held_out_tags(crf):
    right = total = 0
    for text, tags in P.labelled_rows(200, 99):
        path = crf.decode([crf.emissions(P._WORD.findall(text))])[0]
        right += sum(P.TAGS[a] == b for a, b in zip(path, tags, strict=True))
        total += len(tags)
    assert right / total > 0.97


def test_viterbi_against_all_paths(crf):
    r = np.random.default_rng(3)
    stretches = [r.normal(size=(n, len(P.TAGS))) * 3 for n in (1, 2, 3, 4, 1, 3)]
    for e, path in zip(stretches, crf.decode(stretches), strict=True):
        score = lambda p, e=e: sum(e[t, k] for t, k in enumerate(p)) + sum(crf.move[a, b] for a, b in zip((0, *p), (*p, 0), strict=True))
        best = max(itertools.product(range(len(P.TAGS)), repeat=len(e)), key=score)
        assert score(tuple(path)) == pytest.approx(score(best))


def test_decoding_stretches_is_decoding_the_whole_text(crf):
    for text, _ in P.labelled_rows(80, 5):
        words = [m.span() for m in P._WORD.finditer(text)]
        path = crf.decode([crf.emissions([text[s:e] for s, e in words])])[0]
        tagged = {words[i] for i, k in enumerate(path) if k}
        inside = set()
        for kind, s, e in P.added_spans([text], [[]], crf)[0]:
            assert kind in P.KINDS
            inside |= {w for w in words if w[0] < e and s < w[1]}
        assert inside == tagged


def test_added_and_clean(crf):
    found = P.find_spans(["call (743) 555-3824 now", "mail a.b@mail5.example.com###", "", "plain words only", "id 4785380592391138 of 2021-05-04", "9" * 5000, "@" * 3000], crf)
    assert [(k, a) for k, _, _, a in found[0]] == [("phone", True)]
    assert [(k, a) for k, _, _, a in found[1]] == [("email", False)]
    assert found[2] == found[3] == found[4] == []


def test_query_columns_and_masking(spark, crf):
    text = "é x.1@mail1.example.com, +1 (234) 555-0199 1.2.3.4"
    rows = [(1, text, 9, "s"), (1, text, 9, "s"), (2, None, None, None), (None, "", 0, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_chars long, __masked string")
    got = P.find(docs, crf).collect()
    assert len(got) == 4 and got[0] == got[1] and got[2].spans == []
    assert [(s.kind, s.start, s.end) for s in got[0].spans if not s.added] == plain_base(text)
    digest = P.find(docs, crf).select(P.digest(__import__("pyspark").sql.functions.col("spans")).alias("d")).first().d
    assert digest.startswith("email:2:23,") and hashlib.sha256(b"").hexdigest().startswith("e3b0")
    masked = P.mask(docs, crf)
    assert masked.columns == docs.columns and [f.dataType for f in masked.schema] == [f.dataType for f in docs.schema]
    out = masked.collect()
    assert "@" not in out[0].text and "[EMAIL]" in out[0].text and out[0].n_chars == len(out[0].text)
    assert out[2].text is None and out[3].text == ""
    assert P.mask(docs.limit(0), crf).count() == 0


def test_untrained_finds_only_the_base(spark):
    crf = P.train(spark.createDataFrame([], "text string, tags array<string>"))
    assert P.find_spans(["call (743) 555-3824 or a@b.c"], crf) == [[("email", 23, 28, False)]]
