"""Language of texts and of their spans.

Words are read as character trigrams, with their edges.  Training counts hashed trigrams of each language over
all training rows, and which scripts its letters have.  For a word the ranges of its letters give a script, and
only languages that use that script (for one letter in a thousand at least) are candidates; each candidate's score is
the word's log likelihood, smoothed.  Viterbi with a penalty for each switch labels the words, and neighbouring
words of a language are a span.  A text's language is that of most letters; its score is their share.

Most texts need no Viterbi: if no run of words gains more by other languages than the penalty over
the best single language, that language is the best path, and a running sum shows it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.llm._common import code_points, whole_text

#: Hash buckets of trigrams; a language's model is this many counts.
BITS = 15
PENALTY = 12.0
UNKNOWN = "und"
#: Least share of a language's letters in a script that makes it a candidate there.
SCRIPT_SHARE = 0.001

#: First and last code points of blocks, by script.
SCRIPTS = {
    "latin": [(0x41, 0x5A), (0x61, 0x7A), (0xAA, 0xAA), (0xBA, 0xBA), (0xC0, 0x24F), (0x1E00, 0x1EFF)],
    "greek": [(0x370, 0x3FF), (0x1F00, 0x1FFF)],
    "cyrillic": [(0x400, 0x52F)],
    "armenian": [(0x530, 0x58F)],
    "hebrew": [(0x590, 0x5FF)],
    "arabic": [(0x600, 0x6FF), (0x750, 0x77F)],
    "devanagari": [(0x900, 0x97F)],
    "bengali": [(0x980, 0x9FF)],
    "tamil": [(0xB80, 0xBFF)],
    "thai": [(0xE00, 0xE7F)],
    "georgian": [(0x10A0, 0x10FF)],
    "hangul": [(0x1100, 0x11FF), (0xAC00, 0xD7AF)],
    "kana": [(0x3040, 0x30FF)],
    "han": [(0x3400, 0x4DBF), (0x4E00, 0x9FFF)],
}
_NAMES = (*SCRIPTS, "other")
_OTHER = len(SCRIPTS)


def _script_table() -> np.ndarray:
    """Script of each code point below 0x10000, -1 for what is no letter."""
    table = np.full(0x10000, -1, np.int8)
    letters = np.array([c < 0xD800 or c > 0xDFFF for c in range(0x10000)])
    for c in np.flatnonzero(letters):
        if chr(c).isalpha():
            table[c] = _OTHER
    for k, ranges in enumerate(SCRIPTS.values()):
        for a, b in ranges:
            part = table[a : b + 1]
            part[part >= 0] = k
    return table


_TABLE = _script_table()


@dataclass(frozen=True)
class Words:
    """The words of a text: where each starts and ends (code points), its letters, its script, its trigrams."""

    start: np.ndarray
    end: np.ndarray
    letters: np.ndarray
    script: np.ndarray
    grams: np.ndarray
    first: np.ndarray  # of each word's trigrams


def words(text: str) -> Words | None:
    """The maximal runs of letters; None if there are none."""
    points = code_points(text)
    low = code_points(text.lower())
    if len(low) != len(points):  # a letter grew in lower case
        low = code_points("".join(x if len(x := c.lower()) == 1 else c for c in text))
    script = np.where(points < 0x10000, _TABLE[np.minimum(points, 0xFFFF)], _OTHER).astype(np.int8)
    high = points >= 0x10000
    if high.any():
        script[high] = [_OTHER if chr(c).isalpha() else -1 for c in points[high]]
    letter = script >= 0
    if not letter.any():
        return None
    edge = np.diff(np.concatenate(([0], letter.view(np.int8), [0])))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    padded = np.concatenate(([0], np.where(letter, low, 0), [0])).astype(np.uint64)
    h = (padded[:-2] * np.uint64(0x100000001B3) + padded[1:-1]) * np.uint64(0x100000001B3) + padded[2:]
    grams = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)).astype(np.int32)[letter]  # one about each letter
    length = end - start
    return Words(start, end, length, script[start], grams, np.concatenate(([0], np.cumsum(length)[:-1])))


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    logs: np.ndarray  # (buckets, languages)
    uses: np.ndarray  # (scripts, languages): is a candidate

    def scores(self, w: Words) -> np.ndarray:
        """Log likelihood of each word in each language; a language that isn't a candidate is far behind."""
        s = np.add.reduceat(self.logs[w.grams], w.first, axis=0)
        return s + np.where(self.uses[w.script], 0.0, -1e3).astype(np.float32)

    def path(self, s: np.ndarray, penalty: float = PENALTY) -> np.ndarray:
        """The language of each word on the best path."""
        best = int(s.sum(axis=0, dtype=np.float64).argmax())
        gain = (s.max(axis=1) - s[:, best]).astype(np.float64)
        if gain.any():
            upto = np.concatenate(([0.0], np.cumsum(gain)))
            if upto[-1] > penalty:  # gains are never negative, so all of them together are the most that any runs gain
                rest = np.where(s.argmax(axis=1) != best, gain, -(s[:, best] - np.partition(s, -2, axis=1)[:, -2]).astype(np.float64)) if s.shape[1] > 1 else -gain
                total = np.concatenate(([0.0], np.cumsum(rest)))
                if (total - np.minimum.accumulate(total)).max() > penalty:
                    return viterbi(s, penalty)
        return np.full(len(s), best, np.int32)

    def label(self, text: str, penalty: float = PENALTY) -> tuple[Words, np.ndarray] | None:
        w = words(text)
        return None if w is None or not self.languages else (w, self.path(self.scores(w), penalty))

    def language(self, text: str, penalty: float = PENALTY) -> tuple[str, float]:
        found = self.label(text, penalty)
        if found is None:
            return UNKNOWN, 0.0
        w, path = found
        letters = np.bincount(path, weights=w.letters, minlength=len(self.languages))
        best = int(letters.argmax())
        return self.languages[best], float(letters[best] / letters.sum())

    def spans(self, text: str, penalty: float = PENALTY) -> list[tuple[int, int, str]]:
        """(start, end, language) of runs of words, in code points."""
        found = self.label(text, penalty)
        if found is None:
            return []
        w, path = found
        at = np.flatnonzero(np.diff(np.concatenate(([-1], path))))
        last = np.concatenate((at[1:], [len(path)])) - 1
        return [(int(w.start[a]), int(w.end[b]), self.languages[path[a]]) for a, b in zip(at, last, strict=True)]


def viterbi(scores: np.ndarray, penalty: float) -> np.ndarray:
    """Best path where each change of language costs the penalty; a tie stays."""
    n, k = scores.shape
    rows = scores.tolist()
    best, came = rows[0], []
    for row in rows[1:]:
        top = max(range(k), key=best.__getitem__)
        cut = best[top] - penalty
        came.append([j if best[j] >= cut else top for j in range(k)])
        best = [max(b, cut) + r for b, r in zip(best, row, strict=True)]
    at = max(range(k), key=best.__getitem__)
    path = np.empty(n, np.int32)
    for t in range(n - 1, 0, -1):
        path[t] = at
        at = came[t - 1][at]
    path[0] = at
    return path


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Trigrams (by bucket) and letters of each script (-1 - script) of each language over a task's rows."""
    grams: dict[str, np.ndarray] = {}
    scripts: dict[str, np.ndarray] = {}
    for batch in batches:
        for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
            if (w := words(text)) is not None:
                if lang not in grams:
                    grams[lang], scripts[lang] = np.zeros(1 << BITS, np.int64), np.zeros(len(_NAMES), np.int64)
                grams[lang] += np.bincount(w.grams, minlength=1 << BITS)
                scripts[lang] += np.bincount(w.script, weights=w.letters, minlength=len(_NAMES)).astype(np.int64)
    for lang in sorted(grams):
        at, used = np.flatnonzero(grams[lang]), np.flatnonzero(scripts[lang])
        keys, counts = np.concatenate((at, -1 - used)), np.concatenate((grams[lang][at], scripts[lang][used]))
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys), pa.array(counts)], ["lang", "bucket", "n"])


def fit(rows: DataFrame) -> Model:
    """Learn from all of rows(text, lang).

    Rows with a null lang, a null text or no letter don't count.  A task keeps 2**15 counts for each language it meets, and what reaches
    the driver is at most that many for each language.
    """
    known = rows.where("text is not null and lang is not null").select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    table = known.mapInArrow(_count, "lang string, bucket bigint, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(table["lang"].unique()))
    counts, letters = np.zeros((1 << BITS, len(languages))), np.zeros((len(_NAMES), len(languages)))
    column = table["lang"].map({x: i for i, x in enumerate(languages)}).to_numpy(int) if languages else np.zeros(0, int)
    bucket, n = table["bucket"].to_numpy(int), table["n"].to_numpy(float)
    of_gram = bucket >= 0
    counts[bucket[of_gram], column[of_gram]] = n[of_gram]
    letters[-1 - bucket[~of_gram], column[~of_gram]] = n[~of_gram]
    logs = np.log(counts + 0.5) - np.log(counts.sum(axis=0, keepdims=True) + 0.5 * (1 << BITS))
    uses = letters >= SCRIPT_SHARE * letters.sum(axis=0, keepdims=True)
    uses &= letters > 0
    uses[~uses.any(axis=1)] = True  # a script that no language uses rules none out
    return Model(languages, logs.astype(np.float32), uses)


_RESULT = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("lang", T.StringType())]))


def language_column(model: Model, penalty: float = PENALTY):
    @F.pandas_udf(_RESULT)
    def language(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([model.language(t, penalty) for t in texts], columns=["lang_pred", "score"])

    return language


def spans_column(model: Model, penalty: float = PENALTY):
    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        return pd.Series([[dict(zip(("start", "end", "lang"), s, strict=True)) for s in model.spans(t, penalty)] for t in texts], index=texts.index, dtype=object)

    return spans


def identify(docs: DataFrame, model: Model, penalty: float = PENALTY) -> DataFrame:
    """``doc_id, lang_pred, score`` of each row of docs(doc_id, text).

    A null text or one without letters is ``und`` with score 0, as is any text where nothing was learnt.  Repeated rows agree;
    of languages with as many letters the first by name is taken.  Texts of any length are read whole, an empty table gives an empty
    result, and columns other than doc_id and text are ignored, whatever their names.
    """
    found = docs.select("doc_id", language_column(model, penalty)(whole_text("text")).alias("r"))
    return found.select("doc_id", "r.lang_pred", "r.score")
