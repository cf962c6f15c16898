"""Personal data: fixed patterns, and a linear-chain CRF over word shapes that adds to them.

The patterns (e-mail, IP, payment card, phone) give the base spans.  The CRF reads words between ASCII
white space as shape features, and is trained on a small labelled table by maximum likelihood.  A word of over 64 characters (text
without spaces, minified code) is read as its parts: runs of ASCII letters, digits and ``. _ % + - @ / ( )``, runs of other ASCII marks, and runs of the rest.  A word without a
digit or @ is plain, and the model allows it no tag but O; so plain words part the text into stretches
of other words, whose best paths don't depend on each other, and Viterbi decodes the stretches in numpy batches.  Spans that the CRF finds beside the base spans are added;
base spans never change.  Offsets are code points, the end exclusive.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.llm._common import fresh_name, whole_text
from strongroom.llm._minimise import minimise

KINDS = ("email", "ip", "card", "phone")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("added", T.BooleanType())]))

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_DOTTED = re.compile(r"[0-9]\.[0-9]")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_HIT = re.compile(r"[0-9@]")
_SPACE = " \t\n\v\f\r"
_WORD = re.compile(r"[^ \t\n\v\f\r]+")
#: Characters of a word that is read as one, at most; and the parts of a longer one.
WHOLE = 64
_PART = re.compile(r"[A-Za-z0-9._%+@/()-]+|[^\x00-\x7f]+|[^A-Za-z0-9._%+@/()\x80-\U0010ffff-]+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """The patterns' spans by start, then kind.

    Each pattern is read once from left to right: an e-mail is found from its @, whose local part is the run of
    its characters before it, back to the last match at most.
    """
    found, last = [], 0
    for m in _DOMAIN.finditer(text) if "@" in text else ():
        start = m.start()
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < m.start():
            found.append((start, 0, m.end()))
            last = m.end()
    found += [(m.start(), 1, m.end()) for m in (_IP.finditer(text) if _DOTTED.search(text) else ()) if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split("."))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            found.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text) if "+" in text else ():
        if 10 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
            found.append((m.start(), 3, m.end()))
    return [(KINDS[k], s, e) for s, k, e in sorted(found)]


# --- word shapes

_RUNS = re.compile(r"[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]")
_EDGE = "\"'`.,;:!?<>[]{}|*#$%&=~"


def core(word: str) -> tuple[int, int]:
    """Where the word is without punctuation at its edges; round brackets stay if they enclose a part only."""
    start, end = 0, len(word)
    while start < end and word[start] in _EDGE:
        start += 1
    while end > start and word[end - 1] in _EDGE:
        end -= 1
    return start, end


def shape(word: str) -> str:
    """Runs of a kind as one letter; digits with their number up to 5, then 6+."""
    s, e = core(word)
    out = []
    for run in _RUNS.findall(word[s:e]):
        c = run[0]
        if "0" <= c <= "9":
            out.append(f"d{min(len(run), 6)}")
        elif "A" <= c <= "Z" or "a" <= c <= "z" or c > "\x7f":
            if not out or out[-1] != "x":
                out.append("x")
        else:
            out.append(c)
    return "".join(out)


def features(word: str) -> tuple[str, ...]:
    """A word's own features; plain words (no digit, no @) share one."""
    if not _HIT.search(word):
        return ("plain",)
    s, e = core(word)
    body = word[s:e]
    digits = re.sub("[^0-9]", "", body)
    marks = "".join(sorted({c for c in body if not c.isalnum()}))
    found = ["rich", f"shape={shape(word)}", f"marks={marks}", f"digits={min(len(digits), 20)}", f"letters={any(c.isalpha() for c in body)}"]
    if 14 <= len(digits) <= 19:
        found.append(f"luhn={luhn(digits)}")
    parts = body.split(".")
    if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) < 6 for p in parts):
        found.append(f"octets={all(int(p) < 256 for p in parts)}")
    return tuple(found)


# --- the labelled table

_FILLERS = "the of and de la die von que with order item page room on at by entry code is was 12 7 2024 3.5 v2.1 100% 1,250 10:45 2021-05-04 9f3c2ab7 x86 B2B #42 0x7f 5/6 1st".split()


def _luhn_number(r: random.Random, n: int, valid: bool) -> str:
    head = str(r.randint(3, 6)) + "".join(r.choices("0123456789", k=n - 2))
    good = next(d for d in "0123456789" if luhn(head + d))
    return head + (good if valid else r.choice([d for d in "0123456789" if d != good]))


def _example(r: random.Random, kind: str) -> list[str]:
    """The words of a span of this kind; kind O gives words that look alike but are none."""
    n = lambda k: "".join(r.choices("0123456789", k=k))
    name = lambda: "".join(r.choices("abcdeilmnorstu", k=r.randint(2, 9)))
    if kind == "email":
        user, host = r.choice([name(), f"{name()}.{n(2)}", f"{name()}{n(2)}"]), f"{r.choice([name(), f'{name()}{n(1)}'])}.{r.choice(['com', 'org', 'example.com'])}"
        return r.choice([[f"{user}@{host}"], [f"{user}@{host}"], [f"{user}@localhost"]])
    if kind == "ip":
        a = ".".join(str(r.randint(0, 255)) for _ in range(4))
        return [r.choice([a, a, f"{a}:{n(4)}", f"{a}/{r.randint(8, 30)}"])]
    if kind == "card":
        d = _luhn_number(r, r.choice([14, 15, 16, 16, 16, 19]), True)
        four = [d[i : i + 4] for i in range(0, len(d), 4)]
        return r.choice([[d], ["-".join(four)], [".".join(four)], ["/".join(four)], four if len(d) == 16 else [d]])
    if kind == "phone":
        a, b, c = n(3), n(3), n(4)
        return r.choice([[f"({a})", f"{b}-{c}"], [f"{a}-{b}-{c}"], [f"{a}.{b}.{c}"], [f"({a}){b}-{c}"], ["+1", f"({a})", f"{b}-{c}"], [f"+{n(2)}", a, b, c]])
    hexed = lambda k: "".join(r.choices("0123456789abcdef", k=k))
    return [r.choice([_luhn_number(r, 16, False), n(r.randint(1, 12)), hexed(r.choice([8, 32, 40])), f"{n(2)}.{n(2)}", f"{n(1)}.{n(1)}.{n(1)}", f"{r.randint(256, 999)}.{n(3)}.{n(2)}.{n(3)}", f"{n(4)}-{n(2)}-{n(2)}", f"{n(2)}:{n(2)}", f"v{n(1)}.{n(2)}", f"{n(1)},{n(3)}", f"#{n(3)}", f"{name()}{n(2)}", f"@{name()}", f'"{hexed(40)}"', f"{n(2)}%", f"${n(3)}.{n(2)}"])]


def labelled_rows(n: int = 400, seed: int = 7) -> list[tuple[str, list[str]]]:
    """(text, tags of its words): words made by rule, some of them personal data, some alike.  Tags: O, B-kind, I-kind."""
    r, rows = random.Random(seed), []
    for _ in range(n):
        words: list[str] = []
        tags: list[str] = []
        for _ in range(r.randint(1, 3)):
            for _ in range(r.randint(1, 4)):
                words.append(r.choice(_FILLERS[:12]) if r.random() < 0.75 else r.choice(_FILLERS))
                tags.append("O")
            kind = r.choice([*KINDS, "O", "O", "O"])
            span = _example(r, kind)
            if r.random() < 0.4:
                span[-1] += r.choice([".", ",", "###", "***", "%%%", "&&&", "$$$", '"'])
            words += span
            tags += ["O"] * len(span) if kind == "O" else [f"B-{kind}", *[f"I-{kind}"] * (len(span) - 1)]
        words.append(r.choice(_FILLERS[:12]))
        tags.append("O")
        rows.append((" ".join(words), tags))
    return rows


def labelled_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(labelled_rows(), "text string, tags array<string>")


# --- the CRF

#: Words that are decoded together, at most; a longer stretch is decoded by itself, in 13 bytes a word.
DECODED = 1 << 17
#: Digits that an added span of a kind may have: a run of numbers in a table is none.
DIGITS = {"phone": range(7, 16), "card": range(12, 20)}
TAGS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
_WHERE = ("<", "", ">")  # of the word before, the word, the word after


@dataclass(frozen=True)
class Crf:
    index: dict[str, int]
    emit: np.ndarray
    move: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        own = [("plain",), *map(features, words), ("plain",)]
        return np.array([self._emit(*own[i : i + 3]) for i in range(len(words))])

    def _emit(self, *around: tuple) -> np.ndarray:
        ids = [self.index[f] for where, fs in zip(_WHERE, around, strict=True) for x in fs if (f := where + x) in self.index]
        e = self.emit[ids].sum(axis=0)
        if around[1] == ("plain",):
            e[1:] = -1e4
        return e

    def decode(self, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """The best tags of each stretch of emissions between words outside."""
        table = np.concatenate([np.zeros((0, len(TAGS))), *stretches])
        ends = np.cumsum([len(x) for x in stretches]).tolist()
        return self.paths(table, [np.arange(e - len(x), e) for e, x in zip(ends, stretches, strict=True)])

    def paths(self, table: np.ndarray, stretches: list[np.ndarray]) -> list[np.ndarray]:
        """The same of stretches that are given as rows of a table of emissions, in batches of like length and at most DECODED words (or one stretch)."""
        out: list[np.ndarray] = [np.zeros(0, int)] * len(stretches)
        order = sorted(range(len(stretches)), key=lambda i: len(stretches[i]))
        at = 0
        while at < len(order):
            take, first = [order[at]], len(stretches[order[at]])
            for i in order[at + 1 : at + 512]:
                if len(stretches[i]) > 2 * first + 8 or (len(take) + 1) * len(stretches[i]) > DECODED:
                    break
                take.append(i)
            at += len(take)
            lengths = np.array([len(stretches[i]) for i in take])
            own = np.zeros((len(take), lengths.max()), np.int32)
            for k, i in enumerate(take):
                own[k, : lengths[k]] = stretches[i]
            best = table[own[:, 0]] + self.move[0]
            back = np.zeros((*own.shape, len(TAGS)), np.int8)
            final = best.copy()
            for t in range(1, own.shape[1]):
                through = best[:, :, None] + self.move
                back[:, t] = through.argmax(axis=1)
                best = through.max(axis=1) + table[own[:, t]]
                final[lengths > t] = best[lengths > t]
            final = final + self.move[:, 0]
            tag = final.argmax(axis=1)
            path = np.zeros(own.shape, np.int8)
            for t in range(own.shape[1] - 1, -1, -1):
                on = lengths > t
                path[on, t] = tag[on]
                tag = np.where(on, back[np.arange(len(take)), t, tag], tag)
            for k, i in enumerate(take):
                out[i] = path[k, : lengths[k]]
        return out


def train(labelled: DataFrame, rows: int = 5_000, penalty: float = 0.05) -> Crf:
    """Fit the CRF to ``labelled(text, tags)``: at most ``rows`` rows, by text; null texts and rows with another number of tags don't count."""
    table = [(r["text"], r["tags"]) for r in labelled.where("text is not null and tags is not null").orderBy("text").limit(rows).collect()]
    table = [(w, t) for text, t in table if len(w := _WORD.findall(text)) == len(t) and w and set(t) <= set(TAGS)]
    names = sorted({where + x for w, _ in table for word in w for x in features(word) for where in _WHERE} | {where + "plain" for where in _WHERE})
    index = {f: i for i, f in enumerate(names)}
    n, longest, tags = len(table), max((len(w) for w, _ in table), default=1), len(TAGS)
    keys: dict[tuple, int] = {}
    at, gold, lengths = np.zeros((n, longest), int), np.zeros((n, longest), int), np.array([len(w) for w, _ in table], int)
    for k, (words, own_tags) in enumerate(table):
        own = [("plain",), *map(features, words), ("plain",)]
        for t in range(len(words)):
            at[k, t] = keys.setdefault((own[t], own[t + 1], own[t + 2]), len(keys))
            gold[k, t] = TAGS.index(own_tags[t])
    has = np.zeros((len(keys), len(names)))
    for key, row in keys.items():
        for where, fs in zip(_WHERE, key, strict=True):
            has[row, [index[where + x] for x in fs]] = 1
    only_o = np.where(np.array([[k[1] == ("plain",)] for k in keys]) & (np.arange(tags) > 0), -1e4, 0.0) if keys else np.zeros((0, tags))
    if not n:
        return Crf(index, np.concatenate((np.eye(1, tags), np.zeros((len(names), tags))))[: len(names)], np.zeros((tags, tags)))
    on = np.arange(longest) < lengths[:, None]
    allowed = np.array([[0.0 if not b.startswith("I-") or a[2:] == b[2:] else -1e4 for b in TAGS] for a in TAGS])
    rows_at = np.arange(n)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        emit, move = x[: -tags * tags].reshape(-1, tags), x[-tags * tags :].reshape(tags, tags) + allowed
        e = (has @ emit + only_o)[at]
        ahead = np.zeros((n, longest, tags))
        ahead[:, 0] = e[:, 0] + move[0]
        sums = lambda a, axis: np.log(np.exp(a - a.max(axis=axis, keepdims=True)).sum(axis=axis)) + a.max(axis=axis)
        for t in range(1, longest):
            ahead[:, t] = np.where(on[:, t, None], sums(ahead[:, t - 1, :, None] + move, 1) + e[:, t], ahead[:, t - 1])
        total = sums(ahead[:, -1] + move[:, 0], 1)
        behind = np.zeros((n, longest, tags))
        behind[:, -1] = move[:, 0]
        for t in range(longest - 2, -1, -1):
            step = sums(move + (e[:, t + 1] + behind[:, t + 1])[:, None, :], 2)
            behind[:, t] = np.where(on[:, t + 1, None], step, move[:, 0])
        p = np.exp(ahead + behind - total[:, None, None]) * on[:, :, None]
        gold_score = (e[rows_at[:, None], np.arange(longest), gold] * on).sum()
        off = p.copy()
        off[rows_at[:, None], np.arange(longest), gold] -= on
        by_key = np.stack([np.bincount(at.ravel(), weights=off[:, :, t].ravel(), minlength=len(keys)) for t in range(tags)], axis=1)
        grad = has.T @ by_key
        grad_move = np.zeros((tags, tags))
        previous = np.concatenate((np.zeros((n, 1), int), gold[:, :-1]), axis=1)
        first = np.exp(e[:, 0] + move[0] + behind[:, 0] - total[:, None])
        grad_move[0] += first.sum(axis=0)
        for t in range(1, longest):
            both = np.exp(ahead[:, t - 1, :, None] + move + (e[:, t] + behind[:, t])[:, None, :] - total[:, None, None])
            grad_move += both[on[:, t]].sum(axis=0)
        last = np.exp(ahead[:, -1] + move[:, 0] - total[:, None])
        grad_move[:, 0] += last.sum(axis=0)
        np.add.at(grad_move, (previous[on], gold[on]), -1)
        ends = gold[rows_at, lengths - 1]
        np.add.at(grad_move[:, 0], ends, -1)
        gold_score += move[previous[on], gold[on]].sum() + move[ends, 0].sum()
        value = total.sum() - gold_score + penalty / 2 * x @ x
        return value, np.concatenate((grad.ravel(), grad_move.ravel())) + penalty * x

    x = minimise(loss, np.zeros(len(names) * tags + tags * tags), steps=60, tolerance=1e-5)
    crf = Crf(index, x[: -tags * tags].reshape(-1, tags), x[-tags * tags :].reshape(tags, tags) + allowed)
    return crf


# --- spans of texts


def _stretches(text: str) -> list[list[tuple[int, int]]]:
    """Runs of neighbouring words, or parts of long words, that have a digit or @."""
    runs: list[list[tuple[int, int]]] = []
    done = 0
    hit = _HIT.search(text)
    while hit:
        start = max(max(text.rfind(c, done, hit.start()) for c in _SPACE) + 1, done)
        end = _WORD.match(text, hit.start()).end()
        apart = not runs or bool(text[done:start].strip(_SPACE))
        for s, e in [(start, end)] if end - start <= WHOLE else (m.span() for m in _PART.finditer(text, start, end)):
            if end - start > WHOLE and not _HIT.search(text, s, e):
                apart = True  # a plain part
                continue
            if apart:
                runs.append([])
            runs[-1].append((s, e))
            apart = False
        if apart and runs:
            runs.append([])
        done = end
        hit = _HIT.search(text, end)
    return [r for r in runs if r]


def added_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], crf: Crf) -> list[list[tuple[str, int, int]]]:
    """What the CRF finds in each text, without what overlaps a base span."""
    places: list[tuple[int, list[tuple[int, int]]]] = []
    known: dict[tuple, int] = {}
    emissions, stretches = [], []
    for k, text in enumerate(texts):
        for run in _stretches(text):
            own, rows = [("plain",), *(features(text[s:e]) for s, e in run), ("plain",)], []
            for i in range(1, len(own) - 1):
                key = (own[i - 1], own[i], own[i + 1])
                if key not in known:
                    known[key] = len(emissions)
                    emissions.append(crf._emit(*key))
                rows.append(known[key])
            places.append((k, run))
            stretches.append(np.array(rows, np.int32))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    # Of base spans by start, how far those up to here reach.
    starts = [[s for _, s, _ in base] for base in bases]
    reach = [list(accumulate((e for _, _, e in base), max)) for base in bases]
    for (k, run), path in zip(places, crf.paths(np.array(emissions), stretches) if places else [], strict=True):
        text, i = texts[k], 0
        while i < len(run):
            tag = TAGS[path[i]]
            if tag[0] != "B":
                i += 1
                continue
            j = i + 1
            while j < len(run) and TAGS[path[j]] == f"I-{tag[2:]}":
                j += 1
            start = run[i][0] + core(text[slice(*run[i])])[0]
            end = run[j - 1][0] + core(text[slice(*run[j - 1])])[1]
            before = bisect_left(starts[k], end)
            plausible = sum("0" <= c <= "9" for c in text[start:end]) in DIGITS.get(tag[2:], range(end - start + 1))
            if start < end and plausible and not (before and reach[k][before - 1] > start):
                out[k].append((tag[2:], start, end))
            i = j
    return out


def find_spans(texts: list[str], crf: Crf) -> list[list[tuple[str, int, int, bool]]]:
    bases = [base_spans(t) if _HIT.search(t) else [] for t in texts]
    added = added_spans(texts, bases, crf)
    order = {k: i for i, k in enumerate(KINDS)}
    return [sorted([(*x, False) for x in b] + [(*x, True) for x in a], key=lambda x: (x[1], order[x[0]], x[2])) for b, a in zip(bases, added, strict=True)]


def masked(text: str, spans: list[tuple[str, int, int, bool]]) -> str:
    """The text with each run of overlapping spans as the first one's kind in brackets."""
    out, last = [], 0
    for kind, start, end, _ in spans:
        if start >= last:
            out.append(text[last:start])
            out.append(f"[{kind.upper()}]")
        last = max(last, end)
    return "".join([*out, text[last:]])


_BATCH = 256


def spans_column(crf: Crf):
    @F.pandas_udf(SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        out: list[list[dict]] = []
        for k in range(0, len(texts), _BATCH):
            out += [[dict(zip(("kind", "start", "end", "added"), x, strict=True)) for x in found] for found in find_spans(texts.iloc[k : k + _BATCH].tolist(), crf)]
        return pd.Series(out, index=texts.index, dtype=object)

    return spans


def masked_column(crf: Crf):
    @F.pandas_udf(T.StringType())
    def mask(texts: pd.Series) -> pd.Series:
        out: list[str] = []
        for k in range(0, len(texts), _BATCH):
            part = texts.iloc[k : k + _BATCH].tolist()
            out += [masked(t, s) for t, s in zip(part, find_spans(part, crf), strict=True)]
        return pd.Series(out, index=texts.index, dtype=object)

    return mask


def find(docs: DataFrame, crf: Crf) -> DataFrame:
    """``doc_id, spans`` of each row; a null or empty text has none, repeated rows have the same.

    Texts and words of any length are read whole.  Of two best paths the one with the earlier tag of TAGS counts; spans with equal starts
    are in the order of KINDS.  An empty table gives an empty result; columns other than doc_id and text are ignored.
    """
    return docs.select("doc_id", spans_column(crf)(whole_text(F.col("text"))).alias("spans"))


def digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def mask(docs: DataFrame, crf: Crf) -> DataFrame:
    """docs with all spans masked in text, and n_chars (where docs has it) of the new text; a null text stays null."""
    name = fresh_name(docs, "masked")
    out = docs.withColumn(name, F.when(F.col("text").isNotNull(), masked_column(crf)(whole_text(F.col("text")))))
    lengths = {f.name: F.char_length(name).cast(f.dataType).alias(f.name) for f in docs.schema if f.name == "n_chars"}
    return out.select(*(F.col(name).alias("text") if c == "text" else lengths.get(c, F.col(c)) for c in docs.columns))
