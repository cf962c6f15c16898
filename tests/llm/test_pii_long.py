"""Words without end, stretches without end, and the CRF's figures on texts by other rules than it is trained on."""

import random

import numpy as np
import pytest

from strongroom.llm import pii as P


@pytest.fixture(scope="module")
def crf(spark):
    return P.train(P.labelled_table(spark))


def test_numbers_far_inside_a_long_word(crf):
    for before, after in (("東京都に住んでいます" * 30, "です" * 40), ('{"a":"b",' * 40 + '"tel":"', '"}' * 30), ("x=y&" * 60, "&z=1")):
        text = f"{before}(743)555-3824{after}"
        found = P.find_spans([text], crf)[0]
        assert ("phone", len(before), len(before) + 13, True) in found
        assert all(s >= len(before) and e <= len(before) + 13 for _, s, e, _ in found), "a span covers more than the number"


def test_short_words_are_read_as_before(crf):
    text = "call (743) 555-3824 or 743.555.3824, not " + "y" * 64 + " at 9f3c2ab7"
    assert [text[s:e] for _, s, e, _ in P.find_spans([text], crf)[0]] == ["(743) 555-3824", "743.555.3824"]


def test_stretches_are_split_at_plain_words_and_parts():
    text = "a 1 2 b 3\n4 " + "é" * 40 + "5" + "é" * 40 + " 6 end"
    runs = [[text[s:e] for s, e in run] for run in P._stretches(text)]
    assert runs == [["1", "2"], ["3", "4"], ["5"], ["6"]]
    assert P._stretches("") == P._stretches("no hits") == []


def test_a_stretch_of_a_million_words(crf):
    text = "10:45 9f3c2ab7 " * 500_000 + "(743) 555-3824"
    found = P.find_spans([text], crf)[0]
    assert found == [("phone", len(text) - 14, len(text), True)]
    assert P.find_spans(["12 345 " * 1000], crf) == [[]], "a table of numbers is no phone"


def test_batches_don_t_change_paths(crf, monkeypatch):
    r = np.random.default_rng(2)
    stretches = [r.normal(size=(n, len(P.TAGS))) for n in r.integers(1, 60, 300)]
    whole = crf.decode(stretches)
    monkeypatch.setattr(P, "DECODED", 64)
    assert all((a == b).all() for a, b in zip(whole, crf.decode(stretches), strict=True))


def test_overlaps_as_one_by_one(crf):
    r = random.Random(4)
    for _ in range(300):
        text = " ".join(r.choice(["a", "(743)", "555-3824", "a@b.c", "1.2.3.4", "+12 345 678 9012", "4111111111111111", "12", "743-555-3824"]) for _ in range(12))
        base = P.base_spans(text)
        free = P.added_spans([text], [[]], crf)[0]
        want = [x for x in free if not any(s < x[2] and x[1] < e for _, s, e in base)]
        assert P.added_spans([text], [base], crf)[0] == want


def test_held_out_precision_and_recall(crf):
    """Spans of 1,000 labelled texts with another seed."""
    right = found = wanted = 0
    for text, tags in P.labelled_rows(1000, 12345):
        words = [m.span() for m in P._WORD.finditer(text)]
        want, i = set(), 0
        while i < len(tags):
            j = i + 1
            while j < len(tags) and tags[j][0] == "I":
                j += 1
            if tags[i] != "O":
                want.add((tags[i][2:], words[i][0], words[j - 1][1]))
            i = j
        got = {(k, next(a for a, b in words if a <= s < b), next(b for a, b in words if a < e <= b)) for k, s, e in P.added_spans([text], [[]], crf)[0]}
        right, found, wanted = right + len(want & got), found + len(got), wanted + len(want)
    print(f"precision {right / found:.4f} recall {right / wanted:.4f} of {wanted}")
    assert right / found > 0.98 and right / wanted > 0.98
