"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprint: text in lower case (A-Z only), words between ASCII white space, shingles of three
words; a bit is set if it is set in over half of the shingles' XXH64 values (seed 42).

Search: the 64 bits are dealt into parts of correlated bits.  If part i gets the threshold t_i and the
thresholds add up to ``radius - parts + 1``, two fingerprints within the radius differ by at most
t_i in some part i, so probing every part with the ball of radius t_i misses no link.  The number of
parts and their thresholds come from dynamic programming on the candidate counts that a bounded
sample of fingerprints predicts; any choice gives the same links, only the cost differs.

Equal fingerprints are merged before the search, and inside a bucket only a spanning forest of
the verified links leaves the task, so a group of copies never becomes all its pairs.  A bucket of over
``block`` entries is cut into blocks, and pairs of blocks are verified by different tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from math import comb

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strongroom.llm._common import checkpoint, fresh_name, whole_text
from strongroom.llm.components import connected_components

RADIUS = 3
SHINGLE_WORDS = 3
SEED = 42
#: Fingerprints that the plan of the search is estimated on.
SAMPLE = 20_000
#: Ids of dropped documents that are broadcast at most (8 bytes each); more are joined by a shuffle.
BROADCAST_IDS = 500_000
#: Of these so many are compared in pairs, about.
PAIRED = 3_000
#: What a probe costs, in candidates.
_PROBE = 4.0
#: Entries of a bucket that one task verifies at once.
BLOCK = 2_048

_hash = partial(xxhash.xxh64_intdigest, seed=SEED)


def simhash(text: str | None) -> int:
    """The signed 64-bit fingerprint; 0 for null or a text without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    n = len(words)
    if not n:
        return 0
    if n <= SHINGLE_WORDS:
        hashes = [_hash(b" ".join(words))]
    else:
        line = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, n) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        hashes = [_hash(line[s:e]) for s, e in zip(starts[: 1 - SHINGLE_WORDS].tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=True)]
    votes, block = np.zeros(64, np.int64), 8192
    for k in range(0, len(hashes), block):
        part = np.array(hashes[k : k + block], np.uint64)
        votes += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view(np.int64)[0])


@F.pandas_udf(T.LongType())
def simhash_column(texts: pd.Series) -> pd.Series:
    return pd.Series([simhash(t) for t in texts], dtype="int64")


def _balls(mask: int, threshold: int) -> list[int]:
    """Bit patterns inside mask of at most threshold set bits."""
    bits = [1 << b for b in range(64) if mask >> b & 1]
    found = [0]
    for _ in range(threshold):
        found = sorted({f | b for f in found for b in bits} | set(found))
    return found


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _parts(bits: np.ndarray, m: int) -> list[int]:
    """m masks of near-equal width; a part grows by the bit that correlates most with its bits."""
    varied = bits.std(axis=0) > 0
    corr = np.zeros((64, 64))
    if varied.sum() > 1:
        corr[np.ix_(varied, varied)] = np.abs(np.corrcoef(bits[:, varied], rowvar=False))
    free, masks = set(range(64)), []
    for k in range(m):
        width = len(free) // (m - k)
        order = sorted(free)
        seed = max(order, key=lambda b: (corr[b, order].sum(), -b))
        part = [seed]
        while len(part) < width:
            rest = [b for b in order if b not in part]
            part.append(max(rest, key=lambda b: (corr[b, part].sum(), -b)))
        free -= set(part)
        masks.append(sum(1 << b for b in part))
    return masks


def expected(values: np.ndarray, mask: int, most: int, total: int) -> list[float]:
    """Pairs that meet in a part with a threshold of 0, 1 ... most, among total fingerprints, from all pairs of the values."""
    width, own = bin(mask).count("1"), values & np.uint64(mask)
    apart = np.zeros(65)
    for k in range(0, len(own), 256):
        apart += np.bincount(np.bitwise_count(own[k : k + 256, None] ^ own[None, k + 1 :])[np.arange(k, min(k + 256, len(own)))[:, None] < np.arange(k + 1, len(own))[None, :]], minlength=65)
    pairs = total * (total - 1) / 2
    seen = np.cumsum(apart) * pairs / max(1, len(own) * (len(own) - 1) / 2)
    chance = [pairs * sum(comb(width, j) for j in range(t + 1)) / 2.0**width for t in range(most + 1)]  # a small sample sees no chance meetings
    return [max(float(seen[t]), chance[t]) for t in range(most + 1)]


def plan_search(sample: np.ndarray, total: int, radius: int = RADIUS) -> list[tuple[int, int]]:
    """(mask, threshold) of each part that is probed, the cheapest found over the numbers of parts.

    Thresholds run from -1 (the part is not probed) to the radius, each at the cost of its probes and expected candidates.
    """
    values = np.unique(sample.astype(np.int64).view(np.uint64))
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(values) else np.zeros((1, 64))
    some = values[:: len(values) // PAIRED + 1]
    best: tuple[float, list[tuple[int, int]]] | None = None
    for m in range(1, radius + 3):
        masks, aim = _parts(bits, m), radius - m + 1
        # cost[s]: the cheapest thresholds of the parts so far that add up to s
        cost: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for mask in masks:
            met = expected(some, mask, radius, total)
            own = {-1: 0.0} | {t: _PROBE * total * sum(comb(bin(mask).count("1"), k) for k in range(t + 1)) + met[t] for t in range(radius + 1)}
            step: dict[int, tuple[float, list[int]]] = {}
            for s, (c, chosen) in cost.items():
                for t, more in own.items():
                    if s + t not in step or c + more < step[s + t][0]:
                        step[s + t] = (c + more, [*chosen, t])
            cost = step
        if best is None or cost[aim][0] < best[0]:
            best = (cost[aim][0], [(mask, t) for mask, t in zip(masks, cost[aim][1], strict=True) if t >= 0])
    assert best is not None
    return best[1]


def _entries(plan: list[tuple[int, int]], fp: Column) -> Column:
    """A fingerprint's own bucket in each part, and the buckets around it that it probes."""

    def of_part(k: int, mask: int, threshold: int) -> Column:
        key = fp.bitwiseAND(F.lit(_signed(mask)))
        flips = F.split(F.lit(",".join(str(_signed(x)) for x in _balls(mask, threshold))), ",").cast("array<bigint>")
        return F.transform(flips, lambda x: F.struct(F.lit(k).alias("part"), key.bitwiseXOR(x).alias("key"), (x == 0).alias("indexed")))

    return F.explode(F.concat(*(of_part(k, mask, threshold) for k, (mask, threshold) in enumerate(plan))))


def _forest(fps: np.ndarray, indexed: np.ndarray, sides: np.ndarray | None, radius: int) -> list[tuple[int, int]]:
    """Edges that join exactly what the links of a bucket join."""
    values = fps.view(np.uint64)
    label = np.arange(len(fps))
    near = np.empty((len(fps), len(fps)), bool)
    for k in range(0, len(fps), 512):
        near[k : k + 512] = np.bitwise_count(values[k : k + 512, None] ^ values[None, :]) <= radius
        near[k : k + 512] &= indexed[k : k + 512, None] | indexed[None, :]
        if sides is not None:
            near[k : k + 512] &= sides[k : k + 512, None] != sides[None, :]
    np.fill_diagonal(near, True)
    while True:
        new = label.copy()
        for k in range(0, len(fps), 512):
            new[k : k + 512] = np.where(near[k : k + 512], label[None, :], len(fps)).min(axis=1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    return [(int(fps[i]), int(fps[r])) for i, r in enumerate(label) if i != r and fps[i] != fps[r]]


def _verify(radius: int):
    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by bucket; the last bucket of a batch waits for the next batch."""
        kept: pa.Table | None = None

        def done(table: pa.Table) -> pa.RecordBatch:
            part, key, cell = (table.column(c).to_numpy() for c in ("part", "key", "cell"))
            fps, indexed, side = table.column("fp").to_numpy(), table.column("indexed").to_numpy(), table.column("side").to_numpy()
            new = np.concatenate(([True], (part[1:] != part[:-1]) | (key[1:] != key[:-1]) | (cell[1:] != cell[:-1])))
            starts = np.flatnonzero(new)
            sizes = np.diff(np.append(starts, len(fps)))
            a, b = [], []
            pairs = starts[sizes == 2]  # most buckets
            ok = (np.bitwise_count(fps[pairs].view(np.uint64) ^ fps[pairs + 1].view(np.uint64)) <= radius) & (indexed[pairs] | indexed[pairs + 1]) & (fps[pairs] != fps[pairs + 1])
            ok &= (cell[pairs] < 0) | (side[pairs] != side[pairs + 1]) | (cell[pairs] % 2 == 0)
            a.append(fps[pairs[ok]])
            b.append(fps[pairs[ok] + 1])
            for s, n in zip(starts[sizes > 2].tolist(), sizes[sizes > 2].tolist(), strict=True):
                cut = slice(s, s + n)
                across = cell[s] >= 0 and cell[s] % 2 == 1
                if found := _forest(fps[cut], indexed[cut], side[cut] if across else None, radius):
                    x, y = zip(*found, strict=True)
                    a.append(np.array(x, np.int64))
                    b.append(np.array(y, np.int64))
            return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = table if kept is None else pa.concat_tables([kept, table]).combine_chunks()
            if not table.num_rows:
                continue
            part, key, cell = (table.column(c).to_numpy() for c in ("part", "key", "cell"))
            same = (part == part[-1]) & (key == key[-1]) & (cell == cell[-1])
            last = len(same) - int(np.argmin(same[::-1])) if not same.all() else 0
            kept = table.slice(last)
            if last:
                yield done(table.slice(0, last).combine_chunks())
        if kept is not None and kept.num_rows:
            yield done(kept.combine_chunks())

    return tasks


def links(fps: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """Edges ``a, b`` that connect the distinct non-null values of ``fps(fp)`` just as all their links would."""
    distinct = checkpoint(fps.select("fp").where("fp is not null").distinct())
    chosen = distinct.orderBy(F.xxhash64("fp"), "fp").limit(sample).toPandas()["fp"].to_numpy(np.int64)
    plan = plan_search(chosen, distinct.count(), radius)
    entries = distinct.select("fp", _entries(plan, F.col("fp")).alias("e")).select("fp", "e.*")
    hot = entries.groupBy("part", "key").count().where(F.col("count") > block).select("part", "key", F.ceil(F.col("count") / block).alias("blocks"))
    # A bucket of one block is cell -1.  Otherwise an even cell holds one block, an odd one two, told apart by side.
    mine, n = F.pmod(F.xxhash64("fp"), F.col("blocks")), F.col("blocks")
    cells = F.transform(
        F.sequence(F.lit(0).cast("long"), n - 1),
        lambda o: F.struct(
            (2 * (F.least(mine, o) * n + F.greatest(mine, o)) + F.when(o == mine, 0).otherwise(1)).cast("long").alias("cell"),
            F.when(mine < o, 0).otherwise(1).alias("side"),
        ),
    )
    one = F.array(F.struct(F.lit(-1).cast("long").alias("cell"), F.lit(0).alias("side")))
    dealt = entries.join(hot, ["part", "key"], "left").select("part", "key", "fp", "indexed", F.explode(F.when(n.isNull(), one).otherwise(cells)).alias("c")).select("part", "key", "c.*", "fp", "indexed")
    ordered = dealt.repartition("part", "key", "cell").sortWithinPartitions("part", "key", "cell", "fp")
    return ordered.mapInArrow(_verify(radius), "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS, sample: int = SAMPLE, block: int = BLOCK) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row of docs(doc_id, text).

    component_id is the least doc_id that links of at most ``radius`` differing bits reach.
    Null or empty texts have fingerprint zero, and link like any other.  Repeated rows stay, with the same
    result.  A row with a null doc_id takes part; its component is null only if no doc_id is known in it.
    Other columns are ignored.  An empty table gives an empty result.
    """
    marked = checkpoint(docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash_column(whole_text(F.col("text"))).alias("fp")))
    reps = marked.groupBy("fp").agg(F.min("doc_id").alias("rep"))
    roots = connected_components(links(marked, radius, sample, block))
    joined = reps.join(roots.select(F.col("node").alias("fp"), "root"), "fp", "left").select("fp", "rep", F.coalesce("root", "fp").alias("root"))
    joined = checkpoint(joined)
    least = joined.groupBy("root").agg(F.min("rep").alias("component_id"))
    known = joined.join(least, "root").select("fp", "component_id")
    return marked.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def _small(ids: DataFrame) -> DataFrame:
    """Checkpointed ids, to be broadcast if a count finds few enough; else joins shuffle the documents by id."""
    ids = checkpoint(ids)
    return F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """One document of each component stays, the one with the least doc_id; the columns of docs.

    Of rows that repeat a doc_id one stays, with the least text.  Rows without a doc_id stay.
    """
    name = fresh_name(docs, "dropped")
    found = checkpoint(near_duplicates(docs, **options))
    per_id = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("least"), F.count(F.lit(1)).alias("rows"))
    drop = _small(per_id.where("least < doc_id").select(F.col("doc_id").alias(name)))
    again = _small(per_id.where("least = doc_id and rows > 1").select(F.col("doc_id").alias(name)))
    key = F.col("doc_id").cast("long")
    once = docs.join(drop, key == F.col(name), "left_anti").join(again, key == F.col(name), "left_anti")
    first = Window.partitionBy("doc_id").orderBy("text")
    several = docs.join(again, key == F.col(name), "left_semi").withColumn(name, F.row_number().over(first)).where(F.col(name) == 1).drop(name)
    return once.unionByName(several)
