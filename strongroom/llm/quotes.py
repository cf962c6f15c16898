"""Chat formatting by quotation linking, with DataFrame functions only.

A line's quote level is the number of ``>`` that it begins with (spaces between them allowed).  Neighbouring lines of one level
above zero are a passage.  A passage is normalised (lower-case runs of letters and digits, a space apart) and hashed; a message's own
lines, its paragraphs and the whole are hashed alike, without quotes.  A passage links to the latest earlier message of its
conversation that is all of it, else to the latest that has it as a paragraph or line; where there is none its single lines
are looked up.  The first linked message, or the one before if nothing is linked, is what a message replies to.  Conversations
come out in turn order and in reply order (each message, then its replies by turn, each with what follows it), messages without their quotes.

"Latest before" is found in two steps, inside ranges of 1,024 turns and over the ranges, so that a long
conversation or a passage that recurs in it is never gathered in one task.  For the reply order, messages that follow the one before are one
segment, so only the segments that links begin form a tree; places in it come from its tour by doubling pointers, in as many rounds as the
logarithm of the longest tour.  Texts are parsed where they are read, and bodies go through one shuffle at the end; else only hashes and places move.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strongroom.llm._common import checkpoint, ranked

#: Turns of a conversation that are ordered together.
RANGE = 1024
#: Rows of keys that are broadcast at most (some 50 bytes each); more are joined by a shuffle.
BROADCAST_KEYS = 100_000
_PREFIX = r"^[ \t]*(?:>[ \t]*)+"


def level(line: Column) -> Column:
    return F.length(F.regexp_replace(F.regexp_extract(line, _PREFIX, 0), "[^>]", ""))


def normal(text: Column) -> Column:
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)), " ")


def _lines(text: Column) -> Column:
    return F.transform(F.split(F.coalesce(text, F.lit("")), r"\r?\n"), lambda s: F.struct(level(s).alias("level"), F.regexp_replace(s, _PREFIX, "").alias("body")))


def _runs(lines: Column) -> Column:
    """Neighbouring lines of one level as one: array<struct<level, body>>."""
    start = F.filter(F.transform(lines, lambda x, i: F.when((i == 0) | (F.get(lines, i - 1)["level"] != x["level"]), i)), lambda i: i.isNotNull())
    return F.transform(
        start,
        lambda i, k: F.struct(
            F.get(lines, i)["level"].alias("level"),
            F.array_join(F.transform(F.slice(lines, i + 1, F.coalesce(F.get(start, k + 1), F.size(lines)) - i), lambda x: x["body"]), "\n").alias("body"),
        ),
    )


def _with_copy(rows: DataFrame) -> DataFrame:
    """Adds ``copy``: only rows that repeat a conversation's turn are gathered by it."""
    twice = checkpoint(rows.groupBy("conv_id", "turn").count().where("count > 1").select("conv_id", "turn"))
    n = twice.count()
    alone = F.lit(0).cast("long").alias("copy")
    if not n:
        return rows.select("*", alone)
    twice = F.broadcast(twice) if n <= BROADCAST_KEYS else twice
    again = Window.partitionBy("conv_id", "turn").orderBy(F.col("role").asc_nulls_first(), "text")
    several = _null_safe(rows, twice, ["conv_id", "turn"], "left_semi").withColumn("copy", (F.row_number().over(again) - 1).cast("long"))
    return _null_safe(rows, twice, ["conv_id", "turn"], "left_anti").select("*", alone).unionByName(several)


def _hash(text: Column) -> Column:
    """The first 16 bytes of the SHA-256."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def parse(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, body, passages, own``: the text without quotes, the quoted passages in order, and the hashed units.

    A null text counts as empty.  Rows that repeat a conversation's turn are told apart by ``copy``, from 0 by role and text (nulls first).
    """
    rows = _with_copy(messages.select("conv_id", "turn", "role", F.coalesce(F.col("text"), F.lit("")).alias("text")))
    rows = rows.withColumn("lines", _lines(F.col("text"))).withColumn("runs", _runs(F.col("lines"))).drop("lines", "text")
    own = F.filter("runs", lambda r: r["level"] == 0)
    body = F.trim(F.array_join(F.transform(own, lambda r: F.trim(r["body"])), "\n"))
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    def quoted(run: Column) -> Column:
        lines = F.transform(F.filter(F.transform(F.split(run["body"], "\n"), normal), lambda x: x != ""), _hash)
        return F.struct(run["level"].alias("level"), normal(run["body"]).alias("passage"), lines.alias("lines"))

    found = F.filter(F.transform(F.filter("runs", lambda r: r["level"] > 0), quoted), lambda q: q["passage"] != "")
    hashes = F.transform(found, lambda q: F.struct(q["level"].alias("level"), F.array_distinct(F.concat(F.array(_hash(q["passage"])), q["lines"])).alias("hashes")))
    return rows.select("conv_id", "turn", "copy", "role", body.alias("body"), hashes.alias("passages"))


def units(parsed: DataFrame) -> DataFrame:
    """``conv_id, turn, copy, hash, whole``: every line, every paragraph and the whole of each message."""
    lines = F.split("body", "\n")
    paragraphs = F.split("body", r"\n[ \t]*\n\s*")
    found = F.concat(
        F.array(F.struct(normal(F.col("body")).alias("unit"), F.lit(1).alias("whole"))),
        F.transform(F.concat(lines, paragraphs), lambda s: F.struct(normal(s).alias("unit"), F.lit(0).alias("whole"))),
    )
    rows = parsed.select("conv_id", "turn", "copy", F.explode(F.array_distinct(F.filter(found, lambda u: u["unit"] != ""))).alias("u"))
    return rows.select("conv_id", "turn", "copy", _hash(F.col("u.unit")).alias("hash"), "u.whole")


def _range(turn: str = "turn") -> Column:
    return F.coalesce(F.floor(F.col(turn) / RANGE).cast("long"), F.lit(-(2**63)))


def _latest_before(rows: DataFrame, keys: list[str], flags: dict[str, Column]) -> DataFrame:
    """Adds for each flag the latest place (turn, copy) before a row's own where it holds, among the rows with equal keys."""
    place = F.struct("turn", "copy")
    rows = rows.withColumn("range", _range())
    by_place = rows.groupBy(*keys, "range", "turn", "copy").agg(*(F.max(F.when(flag, place)).alias(name) for name, flag in flags.items()))
    within = Window.partitionBy(*keys, "range").orderBy("turn", "copy").rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    near = by_place.select(*keys, "range", "turn", "copy", *(F.max(name).over(within).alias(f"near_{name}") for name in flags))
    by_range = by_place.groupBy(*keys, "range").agg(*(F.max(name).alias(name) for name in flags))
    far = by_range.select(*keys, "range", *(F.max(name).over(over).alias(f"far_{name}") for name in flags))
    found = _null_safe(near, far, [*keys, "range"], "inner")
    return found.select(*keys, "turn", "copy", *(F.coalesce(f"near_{name}", f"far_{name}").alias(name) for name in flags))


def _null_safe(a: DataFrame, b: DataFrame, on: list[str], how: str) -> DataFrame:
    """Joins with null equal to null; the columns of a, then the others of b."""
    named = b.select(*(F.col(c).alias(f"__b_{c}" if c in on else c) for c in b.columns))
    condition = None
    for c in on:
        one = F.col(c).eqNullSafe(F.col(f"__b_{c}"))
        condition = one if condition is None else condition & one
    return a.join(named, condition, how).drop(*(f"__b_{c}" for c in on)) if how not in ("left_semi", "left_anti") else a.join(named, condition, how)


def links(parsed: DataFrame, keys: DataFrame | None = None) -> DataFrame:
    """``conv_id, turn, copy, passage, level, of_turn, of_copy``: the message that each linked passage (from 0) is from.

    ``keys`` are the columns conv_id, turn, copy and passages of parsed, if they are at hand.
    """
    passages = (parsed if keys is None else keys).select("conv_id", "turn", "copy", F.posexplode("passages").alias("passage", "q")).select("conv_id", "turn", "copy", "passage", "q.level", F.posexplode("q.hashes").alias("choice", "hash"))
    asked = checkpoint(passages.select("conv_id", "hash").distinct())
    asked = F.broadcast(asked) if asked.count() <= BROADCAST_KEYS else asked
    offered = _null_safe(units(parsed), asked, ["conv_id", "hash"], "left_semi").select("conv_id", "hash", "turn", "copy", "whole")
    both = passages.select("conv_id", "hash", "turn", "copy", F.lit(-1).alias("whole")).unionByName(offered)
    latest = _latest_before(both, ["conv_id", "hash"], {"whole_at": F.col("whole") == 1, "part_at": F.col("whole") == 0})
    found = _null_safe(passages, latest, ["conv_id", "hash", "turn", "copy"], "inner").withColumn("of", F.coalesce("whole_at", "part_at")).where("of is not null")
    best = found.groupBy("conv_id", "turn", "copy", "passage", "level").agg(F.min_by("of", "choice").alias("of"))
    return best.select("conv_id", "turn", "copy", "passage", "level", F.col("of.turn").alias("of_turn"), F.col("of.copy").alias("of_copy"))


def _placed(keys: DataFrame) -> DataFrame:
    """``conv_id, turn, copy, position, previous``: a message's place from 0 by turn, then copy, and the message before."""
    rows = keys.select("conv_id", "turn", "copy", _range().alias("range"))
    along = Window.partitionBy("conv_id", "range").orderBy("turn", "copy")
    ranges = rows.groupBy("conv_id", "range").agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("turn", "copy")).alias("end"))
    over = Window.partitionBy("conv_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select("conv_id", "range", F.coalesce(F.sum("n").over(over), F.lit(0)).alias("n_before"), F.max("end").over(over).alias("end_before"))
    placed = rows.withColumn("within", F.row_number().over(along) - 1).withColumn("previous", F.lag(F.struct("turn", "copy")).over(along))
    return _null_safe(placed, before, ["conv_id", "range"], "inner").select("conv_id", "turn", "copy", (F.col("n_before") + F.col("within")).cast("long").alias("position"), F.coalesce("previous", "end_before").alias("previous"))


def _segment_of(starts: DataFrame, at: DataFrame) -> DataFrame:
    """``c, position, start``: the last of starts(c, start) up to each place of at(c, position)."""
    rows = starts.select("c", F.col("start").alias("turn"), F.lit(0).alias("copy")).unionByName(at.select("c", F.col("position").alias("turn"), F.lit(1).alias("copy")))
    found = _latest_before(rows, ["c"], {"of": F.col("copy") == 0}).where("copy = 1")
    return found.select("c", F.col("turn").alias("position"), F.col("of.turn").alias("start"))


def reply_order(placed: DataFrame, branches: DataFrame) -> DataFrame:
    """``c, position, reply_position`` of all messages in conversations with branches.

    ``placed(c, position)`` has all messages in turn order; ``branches(c, position, parent)`` those that answer another message than the
    one before.  A branch begins a segment of neighbouring messages, each the first reply of the one before; so a segment
    stands together, and after it what branches off it, the last message's first.
    """
    sizes = placed.groupBy("c").agg(F.count(F.lit(1)).alias("n")).join(branches.select("c").distinct(), "c")
    roots = sizes.select("c", F.lit(0).cast("long").alias("start"), F.lit(None).cast("long").alias("parent"))
    starts = checkpoint(branches.select("c", F.col("position").alias("start"), "parent").unionByName(roots))
    owner = _segment_of(starts, starts.where("parent is not null").select("c", F.col("parent").alias("position")).distinct())
    tree = starts.join(owner.select("c", F.col("position").alias("parent"), F.col("start").alias("owner")), ["c", "parent"], "left")

    children = ranked(tree.where("owner is not null"), "c", "owner", F.col("parent").desc(), "start")
    before = children.select("c", "owner", (F.col("rank") + 1).alias("rank"), F.col("start").alias("elder"))
    children = checkpoint(children.join(before, ["c", "owner", "rank"], "left").select("c", "owner", "start", "elder"))
    first = children.where("elder is null").select("c", F.col("owner").alias("start"), F.col("start").alias("child"))
    younger = children.where("elder is not null").select("c", F.col("elder").alias("start"), F.col("start").alias("sibling"))
    order = ranked(starts.select("c", "start"), "c", "start")
    ends = order.join(order.select("c", (F.col("rank") - 1).alias("rank"), F.col("start").alias("end")), ["c", "rank"], "left").join(sizes, "c")
    ends = ends.select("c", "start", (F.coalesce("end", "n") - F.col("start")).alias("length"))

    # The tour of a tree enters and leaves each segment; what lies ahead of a place is summed over pointers that double.
    stops = tree.select("c", "start", "owner").join(first, ["c", "start"], "left").join(younger, ["c", "start"], "left").join(ends, ["c", "start"])
    into, out_of = F.col("start") * 2, F.col("start") * 2 + 1
    enter = F.struct(into.alias("stop"), F.coalesce(F.col("child") * 2, out_of).alias("next"), F.col("length").alias("ahead"))
    leave = F.struct(out_of.alias("stop"), F.coalesce(F.col("sibling") * 2, F.col("owner") * 2 + 1).alias("next"), F.lit(0).cast("long").alias("ahead"))
    tour = checkpoint(stops.select("c", F.explode(F.array(enter, leave)).alias("s")).select("c", "s.*"))
    while not tour.where("next is not null").isEmpty():
        onward = tour.select("c", F.col("stop").alias("next"), F.col("next").alias("next_but_one"), F.col("ahead").alias("more"))
        tour = checkpoint(tour.join(onward, ["c", "next"], "left").select("c", "stop", F.col("next_but_one").alias("next"), (F.col("ahead") + F.coalesce("more", F.lit(0))).alias("ahead")))

    at = tour.where("stop % 2 = 0").join(sizes, "c").select("c", F.expr("stop div 2").alias("start"), (F.col("n") - F.col("ahead")).alias("first_place"))
    inside = _segment_of(starts, placed.join(sizes.select("c"), "c", "left_semi"))
    return inside.join(at, ["c", "start"]).select("c", "position", (F.col("first_place") + F.col("position") - F.col("start")).alias("reply_position"))


def conversations(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, copy, role, body, n_quotes, n_linked, parent_turn, parent_copy, position, reply_position`` of each message.

    The parent is the message of the first linked passage of the lowest level, else the message before; a conversation's first message has none.
    position counts from 0 by turn, then copy; reply_position from 0 in reply order, where a message stands after what it answers and before
    later replies to that.  Null turns come first, and a null conversation is one.  Null texts count as empty, texts of any length are read
    whole, repeated rows are told apart by copy; other columns are ignored, whatever their names; an empty table gives an empty result.
    """
    parsed = parse(messages)
    keys = checkpoint(parsed.select("conv_id", "turn", "copy", "passages"))
    placed = _placed(keys)
    rows = keys.select("conv_id", "turn", "copy", F.size("passages").cast("long").alias("n_quotes"))
    key = ["conv_id", "turn", "copy"]
    if keys.where(F.size("passages") > 0).isEmpty():  # nothing to link
        known = _null_safe(rows, placed, key, "inner").select(*key, "n_quotes", F.lit(0).cast("long").alias("n_linked"), F.col("previous").alias("parent"), "position", F.col("position").alias("reply_position"))
        return _with_bodies(parsed, known)
    placed = checkpoint(placed)
    chosen = links(parsed, keys).groupBy(*key).agg(F.count(F.lit(1)).alias("n_linked"), F.min_by(F.struct(F.col("of_turn").alias("turn"), F.col("of_copy").alias("copy")), F.struct("level", "passage")).alias("of"))
    known = _null_safe(_null_safe(rows, placed, key, "inner"), chosen, key, "left").select(*key, F.to_json(F.struct("conv_id")).alias("c"), "n_quotes", F.coalesce("n_linked", F.lit(0)).cast("long").alias("n_linked"), F.coalesce("of", "previous").alias("parent"), "of", "position")
    known = checkpoint(known)
    linked = known.where("of is not null").select("conv_id", "c", F.col("of.turn").alias("turn"), F.col("of.copy").alias("copy"), F.col("position").alias("own"))
    branches = _null_safe(linked, known.select(*key, "position"), key, "inner").select("c", F.col("own").alias("position"), F.col("position").alias("parent")).where("parent < position - 1")
    order = reply_order(known.select("c", "position"), checkpoint(branches))
    known = known.join(order, ["c", "position"], "left").withColumn("reply_position", F.coalesce("reply_position", "position"))
    return _with_bodies(parsed, known)


def _with_bodies(parsed: DataFrame, known: DataFrame) -> DataFrame:
    key = ["conv_id", "turn", "copy"]
    joined = _null_safe(parsed.select(*key, "role", "body"), known, key, "inner")
    return joined.select(*key, "role", "body", "n_quotes", "n_linked", F.col("parent.turn").alias("parent_turn"), F.col("parent.copy").alias("parent_copy"), "position", "reply_position")


ORACLE = r"""
with recursive m as (
  select conv_id, turn, role, coalesce(text, '') as text,
    row_number() over (partition by conv_id, turn order by role nulls first, coalesce(text, '')) - 1 as copy from conversations),
l as (
  select conv_id, turn, copy, role, unnest(regexp_split_to_array(text, '\r?\n')) as line, generate_subscripts(regexp_split_to_array(text, '\r?\n'), 1) as i from m),
v as (
  select *, length(regexp_replace(regexp_extract(line, '^[ \t]*(?:>[ \t]*)+'), '[^>]', '', 'g')) as level, regexp_replace(line, '^[ \t]*(?:>[ \t]*)+', '') as body from l),
g as (
  select *, i - row_number() over (partition by conv_id, turn, copy, level order by i) as run from v),
r as (
  select conv_id, turn, copy, any_value(role) as role, level, min(i) as i, string_agg(body, chr(10) order by i) as body, list(body order by i) as lines
  from g group by conv_id, turn, copy, level, run),
b as (
  select conv_id, turn, copy, any_value(role) as role,
    regexp_replace(coalesce(string_agg(trim(body, ' '), chr(10) order by i) filter (where level = 0), ''), '^\s+|\s+$', '', 'g') as body
  from r group by conv_id, turn, copy),
q as (
  select conv_id, turn, copy, level, row_number() over (partition by conv_id, turn, copy order by i) - 1 as passage,
    list_filter(list_prepend(body, lines), lambda x: regexp_matches(x, '[\p{L}\p{N}]')) as texts
  from r where level > 0 and regexp_matches(body, '[\p{L}\p{N}]')),
a as (
  select conv_id, turn, copy, level, passage, unnest(texts) as t, generate_subscripts(texts, 1) as choice from q),
w as (
  select conv_id, turn, copy, level, passage, choice, array_to_string(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), ' ') as unit from a),
p as (
  select conv_id, turn, copy, row_number() over (partition by conv_id order by turn nulls first, copy) - 1 as position from b),
u as (
  select distinct conv_id, turn, copy, array_to_string(regexp_extract_all(lower(t), '[\p{L}\p{N}]+'), ' ') as unit, whole
  from (select conv_id, turn, copy, body as t, 1 as whole from b
    union all select conv_id, turn, copy, unnest(string_split(body, chr(10))), 0 from b
    union all select conv_id, turn, copy, unnest(regexp_split_to_array(body, '\n[ \t]*\n\s*')), 0 from b)),
f as (
  select w.conv_id, w.turn, w.copy, w.passage, w.level, w.choice, max_by(o.position, (u.whole, o.position)) as of
  from w join p as me on me.conv_id = w.conv_id and me.turn is not distinct from w.turn and me.copy = w.copy
  join u on u.conv_id = w.conv_id and u.unit = w.unit
  join p as o on o.conv_id = u.conv_id and o.turn is not distinct from u.turn and o.copy = u.copy
  where o.position < me.position group by all),
c as (
  select conv_id, turn, copy, passage, level, min_by(of, choice) as of from f group by all),
k as (
  select conv_id, turn, copy, count(*) as n_linked, min_by(of, (level, passage)) as of from c group by all),
h as (
  select p.conv_id, p.turn, p.copy, p.position, coalesce(k.of, p.position - 1) as parent
  from p left join k on k.conv_id is not distinct from p.conv_id and k.turn is not distinct from p.turn and k.copy = p.copy),
y(conv_id, position, path) as (
  select conv_id, position, [position] from h where position = 0
  union all select h.conv_id, h.position, list_append(y.path, h.position) from h join y on h.conv_id is not distinct from y.conv_id and h.parent = y.position and h.position > 0),
x as (
  select conv_id, position, row_number() over (partition by conv_id order by path) - 1 as reply_position from y)
select b.conv_id, b.turn, b.copy, b.role, b.body,
  (select count(*) from q where q.conv_id = b.conv_id and q.turn is not distinct from b.turn and q.copy = b.copy) as n_quotes,
  coalesce(k.n_linked, 0) as n_linked, o.turn as parent_turn, o.copy as parent_copy, p.position, x.reply_position
from b join p on p.conv_id = b.conv_id and p.turn is not distinct from b.turn and p.copy = b.copy
left join k on k.conv_id = b.conv_id and k.turn is not distinct from b.turn and k.copy = b.copy
left join p as o on o.conv_id = b.conv_id and o.position = coalesce(k.of, p.position - 1)
join x on x.conv_id is not distinct from p.conv_id and x.position = p.position
"""
