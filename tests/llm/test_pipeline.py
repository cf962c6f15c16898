import hashlib
import random
from collections import Counter

import pytest
import sentencepiece

import corpus_pipeline
from strongroom.llm import pii
from strongroom.llm import sentencepiece_scan as S
from tests.llm.test_simhash import brute_components, slow_simhash


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    r, folder = random.Random(11), str(tmp_path_factory.mktemp("sf"))
    vocab = ["".join(r.choices("abdeiklmnorstu", k=r.randint(2, 7))) for _ in range(300)]
    rows, labels = [], []
    for i in range(240):
        words = r.choices(vocab, k=r.randint(30, 160))
        toxic = int(r.random() < 0.25)
        for _ in range(4 * toxic):
            words.insert(r.randrange(len(words)), "grumblesnark")
        if r.random() < 0.2:
            words.insert(5, f"x{i}@mail1.example.com")
        text = " ".join(words)
        rows.append((i, text, "en", f"s{i % 4}", len(text), "extra"))
        labels.append((i, 1, toxic))
    for i in range(240, 300):  # copies of clean documents, some with one word more
        j = r.choice([k for k in range(240) if not labels[k][2]])
        text = rows[j][1] + r.choice(["", "", " more"])
        rows.append((i, text, "en", "s0", len(text), "extra"))
    rows += [(300, None, None, None, None, None), (301, "", "en", "s1", 0, ""), (5, rows[5][1], "en", rows[5][3], rows[5][4], "extra")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder, rows, {i: y for i, _, y in labels}


def test_stages_and_brute_force(spark, tables):
    folder, rows, toxic = tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    steps = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, steps[-1], folder).cache()
        steps.append(out)
        if name != "sentencepiece":
            assert out.columns == docs.columns and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema]
    clean, single, masked, mixed, encoded = ([tuple(r) for r in s.collect()] for s in steps[1:])

    assert Counter(clean) == Counter(r for r in rows if not toxic.get(r[0]))
    component = brute_components([r[0] for r in clean], [slow_simhash(r[1]) for r in clean])
    assert Counter(r[0] for r in single) == Counter({r[0] for r, c in zip(clean, component, strict=True) if c == r[0]})
    assert len(masked) == len(single) and not any("@" in (r[1] or "") for r in masked)
    crf = pii.train(pii.labelled_table(spark))
    want = {r[0]: None if r[1] is None else pii.masked(r[1], pii.find_spans([r[1]], crf)[0]) for r in single}
    assert {r[0]: r[1] for r in masked} == want and all(r[4] == (None if r[1] is None else len(r[1])) for r in masked)
    sizes = Counter()
    for r in masked:
        sizes[r[3]] += len((r[1] or "").split())
    taken = Counter()
    for r in mixed:
        taken[r[3]] += len((r[1] or "").split())
    assert sum(taken.values()) == pytest.approx(1.5 * sum(sizes.values()), abs=4)
    assert all(taken[s] <= 2 * n for s, n in sizes.items())
    library = sentencepiece.SentencePieceProcessor(model_file=S.MODEL)
    expect = Counter((r[0], tuple(library.encode(r[1] or "")), hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in mixed)
    assert Counter((r[0], tuple(r[2]), r[3]) for r in encoded) == expect


def test_run_agrees_with_itself(spark, tables):
    folder, rows, _ = tables
    a, b = (Counter((r.doc_id, tuple(r.ids)) for r in corpus_pipeline.run(spark, folder).collect()) for _ in range(2))
    assert a == b and sum(a.values()) > 100


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
