"""Mixing sources to target weights: capped water-filling, then seeded repetitions.

Everything is DataFrame operations.  A document's place in its source's order is a seeded hash of its id.
Each source takes its documents some whole times, and once more those before a cut in that order, so a
document's share needs only a row per source: no text is shuffled.  The cut is found from sums over
4,096 hash buckets of each source, then among the documents of one bucket, so a hot source is never gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strongroom.llm._common import checkpoint, fresh_name, ranked, whole_text

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
#: Words of the mix for each word there is, and the most times that a source is used.
SHARE, EPOCHS = 1.5, 2
SEED = 17
#: Up to so many sources their rows are broadcast; beyond, documents and sources are joined in SALTS parts of each source.
BROADCAST_SOURCES, SALTS = 10_000, 64
#: Hex digits of the hash that make a bucket.
_BUCKET = 3


def words(text: str | Column = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def _hash(doc_id: Column, seed: int) -> Column:
    return F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)


def _place(doc_id: Column, size: Column, seed: int) -> Column:
    """The order within a source; rows with equal id and size share a place."""
    return F.concat(_hash(doc_id, seed), F.lpad(size.cast("string"), 12, "0"))


def targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """``source, source_size, target`` from ``sizes(source, size)``.

    Weights go to the sources by code point (null last), repeating.  Sources at their cap are clamped, and the
    rest of the budget is shared anew by weight, until no source is above its cap.
    """
    per_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    table = ranked(per_source, F.col("source").isNull(), "source").select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(epochs)).alias("cap"))
    table = checkpoint(table.withColumn("ratio", F.col("cap") / F.col("weight")))
    level, clamped = 0.0, -1
    while True:
        full = F.col("ratio") < level
        row = table.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("cap")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(full, 0.0).otherwise(F.col("weight"))).alias("free"),
            F.count(F.when(full, 1)).alias("clamped"),
        ).first()
        if not row["free"] or row["clamped"] == clamped:
            break
        clamped, level = row["clamped"], (share * row["all"] - row["capped"]) / row["free"]
    return table.select("source", "source_size", F.round(F.least(F.col("cap"), F.col("weight") * level), 3).alias("target"))


def plan(sizes: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """A row per source: its size and target, the ``whole`` times it is used, and the ``cut`` before which a place counts once more.

    A document at the cut gives ``part`` words more (shared by rows with the same id and size).
    """
    quota = targets(sizes, **options)
    f = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    quota = checkpoint(quota.withColumn("whole", f.cast("long")).withColumn("more", F.floor("target").cast("long") - F.col("whole") * F.col("source_size")))
    bucket = F.substring("place", 1, _BUCKET)
    by_source = lambda a, b: a["source"].eqNullSafe(b["source"])
    sums = sizes.groupBy("source", bucket.alias("bucket")).agg(F.sum("size").alias("size"))
    running = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    cum = sums.withColumn("upto", F.sum("size").over(running)).select(F.col("source").alias("s"), "bucket", "upto", (F.col("upto") - F.col("size")).alias("before"))
    edge = cum.join(quota, F.col("s").eqNullSafe(F.col("source"))).where("before <= more and more < upto")
    edge = edge.select(F.col("s").alias("edge_source"), F.col("bucket").alias("edge_bucket"), (F.col("more") - F.col("before")).alias("rest"))
    inside = sizes.join(edge, F.col("source").eqNullSafe(F.col("edge_source")) & (bucket == F.col("edge_bucket")))
    places = inside.groupBy("source", "place").agg(F.sum("size").alias("size"), F.count(F.lit(1)).alias("rows"), F.max("rest").alias("rest"))
    along = Window.partitionBy("source").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    cuts = places.withColumn("upto", F.sum("size").over(along)).where("upto - size <= rest and rest < upto")
    cuts = cuts.select(F.col("source").alias("cut_source"), F.col("place").alias("cut"), F.expr("(rest - (upto - size)) div rows").alias("part"))
    return quota.join(cuts, F.col("source").eqNullSafe(F.col("cut_source")), "left").select("source", "source_size", "target", "whole", "more", "cut", "part")


def _extra(size: Column, place: Column, prefix: str) -> Column:
    """Words beyond the whole repetitions; none if there is no cut."""
    cut = F.col(f"{prefix}cut")
    return F.when(cut.isNull(), F.lit(0)).when(place < cut, size).when(place == cut, F.col(f"{prefix}part")).otherwise(0).cast("long")


def sized(docs: DataFrame, seed: int = SEED) -> DataFrame:
    narrow = docs.select("doc_id", "source", words("text").alias("size"))
    return checkpoint(narrow.withColumn("place", _place(F.col("doc_id"), F.col("size"), seed)))


def _with_quota(rows: DataFrame, quotas: DataFrame) -> tuple[DataFrame, str]:
    """rows(source, ...) with their source's quota, in columns that begin with the prefix that comes with it; no column of rows begins so.

    How many sources there are is checked: a broadcast leaves the rows where they are; else a hot source is salted.
    """
    prefix = "__mix_"
    while any(c.lower().startswith(prefix) for c in rows.columns):
        prefix = f"_{prefix}"
    quotas = checkpoint(quotas.select(*(F.col(c).alias(f"{prefix}{c}") for c in quotas.columns)))
    same = rows["source"].eqNullSafe(F.col(f"{prefix}source"))
    if quotas.count() <= BROADCAST_SOURCES:
        return rows.join(F.broadcast(quotas), same), prefix
    salted = quotas.withColumn(f"{prefix}salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    return rows.join(salted, same & (F.pmod(F.xxhash64(rows["doc_id"]), F.lit(SALTS).cast("long")) == F.col(f"{prefix}salt"))), prefix


def mix(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` for each row of docs(doc_id, text, source).

    taken is at most ``epochs`` times size; over a source it adds up to its target, without its fraction.  A null text has size 0;
    a null source is a source; repeated rows share what is taken evenly; an empty table gives an empty result.
    """
    sizes = sized(docs, seed)
    joined, prefix = _with_quota(sizes, plan(sizes, seed, **options))
    taken = F.col(f"{prefix}whole") * F.col("size") + _extra(F.col("size"), F.col("place"), prefix)
    return joined.select("doc_id", "size", F.col(f"{prefix}source_size").alias("source_size"), F.col(f"{prefix}target").alias("target"), taken.alias("taken"))


def repeat(docs: DataFrame, seed: int = SEED, **options) -> DataFrame:
    """The mix itself, with the columns of docs: a row for each repetition.

    The last repetition of the document at a source's cut has its first words only, a space apart, and n_chars (where docs has it) of that text.
    A null or empty text has no words and is used as often as its source is as a whole; a null source is a source; repeated rows are each
    repeated; texts of any length stay whole otherwise; other columns stay, whatever their names; an empty table gives an empty one.
    """
    name = {n: fresh_name(docs, n) for n in ("size", "extra", "copy")}
    out, prefix = _with_quota(docs, plan(sized(docs, seed), seed, **options))
    out = out.withColumn(name["size"], words(docs["text"]))
    size = F.col(name["size"])
    out = out.withColumn(name["extra"], _extra(size, _place(docs["doc_id"], size, seed), prefix))
    whole, extra = F.col(f"{prefix}whole"), F.col(name["extra"])
    times = whole + (extra > 0).cast("long")
    out = out.withColumn(name["copy"], F.explode(F.when(times > 0, F.sequence(F.lit(1).cast("long"), times)).otherwise(F.array().cast("array<bigint>"))))
    part = (F.col(name["copy"]) > whole) & (extra < size)
    head = F.array_join(F.slice(F.regexp_extract_all(F.col("text"), F.lit(WORD), F.lit(0)), F.lit(1), extra.cast("int")), " ")
    text = F.when(part, head).otherwise(F.col("text"))
    changed = {"text": text.alias("text")} | {f.name: F.when(part, F.char_length(head)).otherwise(F.col(f.name)).cast(f.dataType).alias(f.name) for f in docs.schema if f.name == "n_chars"}
    return out.select(*(changed.get(c, F.col(c)) for c in docs.columns))


ORACLE = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    sha256('17:' || coalesce(cast(doc_id as varchar), '')) as h
  from documents),
p as (select *, h || lpad(cast(size as varchar), 12, '0') as place from d),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
r as (select *, cast([5.0, 2.0, 1.0][1 + (row_number() over (order by source nulls last) - 1) % 3] as double) as weight from s),
c as (select *, cast(2 * source_size as double) as cap, cast(2 * source_size as double) / weight as ratio from r),
w as (
  select *, (1.5 * (select cast(sum(source_size) as double) from s) - (sum(cap) over (order by ratio, source nulls last rows unbounded preceding) - cap))
    / (sum(weight) over () - (sum(weight) over (order by ratio, source nulls last rows unbounded preceding) - weight)) as level
  from c),
l as (select min_by(level, ratio) as level from w where ratio >= level),
q as (
  select c.source, source_size, round(least(cap, weight * l.level), 3) as target from c, l),
f as (
  select *, case when source_size > 0 then cast(floor(target / source_size) as bigint) else 0 end as whole from q),
g as (
  select source, place, cast(sum(size) as bigint) as size, count(*) as n from p group by source, place),
k as (
  select g.*, f.whole, f.source_size, f.target, cast(floor(f.target) as bigint) - f.whole * f.source_size as more,
    cast(sum(g.size) over (partition by g.source order by place rows unbounded preceding) as bigint) as upto
  from g join f on g.source is not distinct from f.source)
select p.doc_id, p.size, k.source_size, k.target,
  cast(k.whole * p.size + case when k.upto <= k.more then p.size when k.upto - k.size <= k.more then (k.more - (k.upto - k.size)) // k.n else 0 end as bigint) as taken
from p join k on p.source is not distinct from k.source and p.place = k.place
"""
