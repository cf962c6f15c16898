import random
import re

import pytest

from strongroom.llm import quotes as Q


def normal(text):
    return " ".join(re.findall(r"[^\W_]+", text.lower()))


def plain(messages):
    """Messages by conversation in order, each passage looked up backwards."""
    def key(m):
        return (m[1] is not None, m[1] or 0, m[2] is not None, m[2] or "", m[3] or "")

    out = []
    for conv in {m[0] for m in messages}:
        rows = sorted((m for m in messages if m[0] == conv), key=key)
        done, copies = [], {}
        for position, (_, turn, role, text) in enumerate(rows):
            copy = copies[turn] = copies.get(turn, -1) + 1
            runs = []
            for line in re.split(r"\r?\n", text or ""):
                prefix = re.match(r"[ \t]*(?:>[ \t]*)+", line)
                lv = prefix[0].count(">") if prefix else 0
                body = line[len(prefix[0]) :] if prefix else line
                if runs and runs[-1][0] == lv:
                    runs[-1][1].append(body)
                else:
                    runs.append((lv, [body]))
            body = "\n".join("\n".join(b).strip(" ") for lv, b in runs if not lv).strip()
            quotes = [(lv, b) for lv, b in runs if lv and normal("\n".join(b))]
            links = []
            for k, (lv, b) in enumerate(quotes):
                for want in [normal("\n".join(b)), *filter(None, map(normal, b))]:
                    hit = next((d for d in reversed(done) if (d[0], d[1]) != (turn, copy) and d[2] == want), None) or next((d for d in reversed(done) if want in d[3]), None)
                    if hit:
                        links.append((lv, k, hit))
                        break
            parent = min(links)[2][:2] if links else done[-1][:2] if done else (None, None)
            out.append((conv, turn, copy, role, body, len(quotes), len(links), *parent, position))
            parts = {normal(x) for x in [*body.split("\n"), *re.split(r"\n[ \t]*\n\s*", body)]} - {""}
            done.append((turn, copy, normal(body), parts))
    return sorted(in_reply_order(out), key=str)


def in_reply_order(out):
    """The rows with their place when each message is followed by its replies by turn, each with all that answers it."""
    below, first = {}, []
    for row in sorted(out, key=lambda r: r[-1]):
        of = (row[0], row[7], row[8])
        if row[-1]:
            below.setdefault(of, []).append(row)
        else:
            first.append(row)
    done = []
    for root in first:
        stack, place = [root], 0
        while stack:
            row = stack.pop()
            done.append((*row, place))
            place += 1
            stack += reversed(below.get(row[:3], []))
    return done


def threads(seed, n):
    r = random.Random(seed)
    out = []
    for conv in range(n):
        said = []
        for turn in range(r.randint(1, 12)):
            lines = []
            for _ in range(r.choice([0, 0, 1, 2])):
                if said:
                    old = r.choice(said).split("\n")
                    part = r.choice([old, [r.choice(old)], old[:2]])
                    lines += [r.choice(["> ", ">", " > ", ">> ", "> > "]) + (x.upper() if r.random() < 0.3 else x) for x in part]
                    if r.random() < 0.5:
                        lines.append("> never said " + str(r.random()))
                    lines.append(r.choice(["", "ok", "ok"]))
            lines += [" ".join(r.choices("alpha beta gamma delta é über 東".split(), k=r.randint(1, 6))) for _ in range(r.randint(0, 3))]
            text = "\n".join(lines)
            said.append(text)
            out.append((conv, turn, r.choice(["user", "assistant"]), text))
    return out


@pytest.mark.parametrize("width", [1024, 3])
def test_against_brute_force(spark, monkeypatch, width):
    monkeypatch.setattr(Q, "RANGE", width)
    rows = [*threads(1, 40), (7, None, "user", "ok"), (7, 0, None, None), (7, 0, "user", "> ok"), (7, 0, "user", "> ok"), (99, 5, "user", ""), (None, 1, "a", "x"), (None, 2, "b", ">x\r\nyes")]
    messages = spark.createDataFrame([(*m, "z") for m in rows], "conv_id long, turn long, role string, text string, body string").repartition(5)
    got = sorted((tuple(r) for r in Q.conversations(messages).collect()), key=str)
    want = plain(rows)
    assert got == want
    assert sum(r[6] for r in want) > 40


def test_against_sql(spark):
    import duckdb
    import pandas as pd

    rows = threads(3, 60)
    conversations = pd.DataFrame(rows, columns=["conv_id", "turn", "role", "text"])  # noqa: F841
    want = sorted(duckdb.sql(Q.ORACLE).fetchall(), key=str)
    got = sorted((tuple(r) for r in Q.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    assert got == want


def test_empty(spark):
    assert Q.conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def quoting(parents):
    """Messages that each quote all of another one, or nothing."""
    return [(1, i, "user", ("" if p is None else f"> say {p}\n") + f"say {i}") for i, p in enumerate(parents)]


@pytest.mark.parametrize("width,kind", [(4, "star"), (1024, "two chains"), (4, "comb"), (4, "random"), (1024, "back")])
def test_reply_order_of_deep_and_wide_trees(spark, monkeypatch, width, kind):
    monkeypatch.setattr(Q, "RANGE", width)
    r, n = random.Random(7), 60
    parents = {
        "star": [None] + [0] * n, "two chains": [None, 0] + list(range(n)), "comb": [None] + [x for i in range(n // 2) for x in (2 * i, 2 * i)][: n],
        "random": [None] + [r.choice([None, r.randrange(i)]) for i in range(1, n)], "back": [None] * (n // 2) + list(range(n // 2 - 1, -1, -1)),
    }[kind]
    rows = quoting(parents)
    got = sorted((tuple(x) for x in Q.conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()), key=str)
    assert got == plain(rows)
    order = sorted(got, key=lambda x: x[-1])
    assert [x[-1] for x in order] == list(range(len(rows)))


def test_very_long_messages_and_clashes(spark):
    long = "\n".join(f"line {i} of many" for i in range(20_000))
    rows = [(1, 0, "user", long), (1, 1, "assistant", "> line 777 of many\nyes"), (1, 2, "user", "\n".join("> " + x for x in long.split("\n")) + "\nall"), (1, 3, "assistant", "> yes\nok")]
    docs = spark.createDataFrame([(*r, 1, "c", 2, 3) for r in rows], "conv_id long, turn long, role string, text string, copy int, c string, position int, parent int")
    got = sorted(Q.conversations(docs).collect(), key=lambda r: r.turn)
    assert [(r.parent_turn, r.n_linked, r.reply_position) for r in got] == [(None, 0, 0), (0, 1, 1), (0, 1, 3), (1, 1, 2)]
    assert got[0].body == long
