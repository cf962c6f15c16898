"""License scans: texts against license templates by Dice coefficient over word bigrams, with DataFrame functions only.

A text is compared as a whole, line by line, and by runs of neighbouring lines, for notices that are wrapped.  Normalised words are lower-case runs of the letters a-z and digits; a unit
is the bag of its neighbouring pairs of words (a lone word stands for itself).  For Dice of at least t, bags of m and n pairs
need n between m t / (2 - t) and m (2 - t) / t, so a template is only compared with units whose size lies inside its bounds: an equal
join on size.  Also the shared pairs are t / (2 - t) of the unit's own at least, so a unit with fewer words from any template is
dropped where it stands, before lines become rows; on ordinary text that leaves next to nothing.  Both prunings are exact.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strongroom.llm._common import whole_text

THRESHOLD = 0.8
WORD = "[a-z0-9]+"
#: Words of all templates that prune units where they stand, at most; with more the bounds on size prune alone, with the same result.
MOST_WORDS = 20_000

# License names and notices as their authors publish them.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.'),
    ("Apache-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Proprietary", "All rights reserved."),
]


def template_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TEMPLATES, "license string, template string")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def pairs(w: Column) -> Column:
    """The bag of neighbouring pairs, each with the number of times that it came before."""
    n = F.size(w)
    two = F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    bag = F.when(n == 1, w).otherwise(two)
    return F.transform(bag, lambda g, i: F.concat_ws("#", g, F.size(F.filter(F.slice(bag, 1, i), lambda x: x == g)).cast("string")))


def _prepared(templates: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame, list[str] | None, int, int]:
    """The templates' bags; the sizes that each is compared with; all their words, if they aren't too many; the least and the greatest size."""
    table = templates.where("template is not null").select("license", "template", words(F.col("template")).alias("w")).where(F.size("w") > 0).distinct()
    rows = table.select(F.explode("w").alias("w")).distinct().limit(MOST_WORDS + 1).collect()
    bags = table.select("license", "template", F.sha2(F.to_json(F.struct("license", "template")), 256).alias("id"), pairs(F.col("w")).alias("bag"))
    n, t = F.size("bag"), F.lit(threshold)
    low, high = F.greatest(F.lit(1), F.ceil(n * t / (2 - t) - 1e-9)), F.floor(n * (2 - t) / t + 1e-9)
    sizes = bags.select("id", F.explode(F.sequence(low.cast("int"), high.cast("int"))).alias("size"))
    row = sizes.agg(F.min("size"), F.max("size")).first()
    return bags, sizes, sorted(r["w"] for r in rows) if len(rows) <= MOST_WORDS else None, row[0] or 0, row[1] or 0


def _known(w: Column, known: list[str] | None) -> Column:
    """How many of the words are a template's; all of them where that isn't asked."""
    return F.size(w if known is None else F.filter(w, lambda x: x.isin(known)))


def _runs(lines: Column, least: int, most: int, known: list[str] | None, share: float) -> Column:
    """Runs of two or more of the lines (line, w; none without words) that the prunings leave, as first, last, w."""
    # Of a line beyond the greatest size, which is in no run, the words are not looked at.
    counts = F.transform(lines, lambda s: F.struct(F.size(s["w"]).alias("n"), F.when(F.size(s["w"]) <= most + 1, _known(s["w"], known)).otherwise(0).alias("k")))

    def longer(run: Column, c: Column) -> Column:
        n, k, count = run["n"] + c["n"], run["k"] + c["k"], run["count"] + 1
        fits = (n - 1).between(least, most) & (k >= (n - 1) * share - 1e-9)
        ends = F.when(fits, F.concat(run["ends"], F.array(count))).otherwise(run["ends"])
        return F.when(run["n"] > most + 1, run).otherwise(F.struct(n.alias("n"), k.alias("k"), count.alias("count"), ends.alias("ends")))

    def from_line(c: Column, i: Column) -> Column:
        # Each line has a word, so most lines beyond the first suffice.
        start = F.struct(c["n"].alias("n"), c["k"].alias("k"), F.lit(1).alias("count"), F.array().cast("array<int>").alias("ends"))
        lengths = F.aggregate(F.slice(counts, i + 2, F.lit(most)), start, longer, lambda run: run["ends"])
        run = lambda n: F.slice(lines, i + 1, n)
        return F.transform(
            F.when(c["n"] <= most, lengths).otherwise(F.array().cast("array<int>")),
            lambda n: F.struct(F.get(lines, i)["line"].alias("first"), F.get(lines, i + n - 1)["line"].alias("last"), F.flatten(F.transform(run(n), lambda s: s["w"])).alias("w")),
        )

    return F.flatten(F.transform(counts, from_line))


def _chosen(found: Column) -> Column:
    """Of one text's units that are like one template: lines and the whole text all, runs only where no unit before overlaps."""
    free = lambda kept, u: ~F.exists(kept, lambda x: (x["first"] <= u["last"]) & (u["first"] <= x["last"]))
    none = F.filter(found, lambda u: F.lit(False))
    return F.aggregate(F.array_sort(found), none, lambda kept, u: F.when(~u["run"] | free(kept, u), F.concat(kept, F.array(u))).otherwise(kept))


def scan(docs: DataFrame, templates: DataFrame | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id, line, license, template, dice`` for each line, run of lines, or whole text (line 0), that is like a template.

    Lines count from 1; a text of one line is compared once, as line 1.  A run goes by its first line.  Of runs that overlap
    only the likest to a template counts (then the shortest, then the first), and none that overlaps a line, or lies in a whole text,
    that is like the template by itself.  Null and empty texts and lines without
    words match nothing; repeated rows match repeatedly; without templates nothing matches.
    """
    templates = template_table(docs.sparkSession) if templates is None else templates
    bags, sizes, known, least, most = _prepared(templates, threshold)
    share = threshold / (2 - threshold)
    text = whole_text("text")
    rows = docs.select("doc_id", text.alias("text"), F.transform(F.split(text, "\n"), words).alias("by_line"))
    units = F.concat(F.array(F.when(F.size("by_line") > 1, F.flatten("by_line")).otherwise(F.array().cast("array<string>"))), F.col("by_line"))

    def alike(w: Column) -> Column:
        size = F.greatest(F.size(w) - 1, F.lit(1))
        # Shared pairs begin with as many shared words.
        return size.between(least, most) & (_known(w, known) >= size * share - 1e-9)

    def unit(first: Column, last: Column, run: bool, w: Column) -> Column:
        return F.struct(first.cast("int").alias("first"), last.cast("int").alias("last"), F.lit(run).alias("run"), w.alias("w"))

    numbered = F.transform(units, lambda w, i: F.when((F.size(w) > 0) & alike(w), unit(i, F.when(i == 0, F.lit(2**31 - 1)).otherwise(i), False, w)))
    rows = rows.withColumn("lines", F.filter(F.transform("by_line", lambda w, i: F.struct((i + 1).alias("line"), w.alias("w"))), lambda s: F.size(s["w"]) > 0))
    runs = F.transform(_runs(F.col("lines"), least, most, known, share), lambda u: unit(u["first"], u["last"], True, u["w"]))
    kept = rows.select("doc_id", "text", F.explode(F.concat(F.filter(numbered, lambda u: u.isNotNull()), runs)).alias("u"))
    kept = kept.select("doc_id", F.sha2("text", 256).alias("text_id"), "u.first", "u.last", "u.run", pairs(F.col("u.w")).alias("own"))
    joined = kept.withColumn("size", F.size("own")).join(sizes, "size").join(bags, "id")
    dice = F.lit(2.0) * F.size(F.array_intersect("own", "bag")) / (F.col("size") + F.size("bag"))
    alike_units = joined.select("doc_id", "text_id", "license", "template", "run", "first", "last", dice.alias("dice")).where(F.col("dice") >= threshold)
    # Repeated rows find the same units; they are counted, and dealt out again.
    of_text = ["doc_id", "text_id", "license", "template"]
    counted = alike_units.groupBy(*of_text, "run", "first", "last", "dice").agg(F.count(F.lit(1)).cast("int").alias("rows"))
    found = counted.groupBy(*of_text).agg(F.collect_list(F.struct("run", (-F.col("dice")).alias("unlike"), (F.col("last") - F.col("first")).alias("more"), "first", "last", "dice", "rows")).alias("found"))
    each = found.select("doc_id", "license", "template", F.explode(_chosen(F.col("found"))).alias("u"))
    each = each.select("doc_id", F.col("u.first").alias("line"), "license", "template", F.col("u.dice").alias("dice"), F.explode(F.array_repeat(F.lit(0), F.col("u.rows"))))
    return each.select("doc_id", "line", "license", "template", "dice")


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _bag(w: str) -> str:
    two = f"case when len({w}) = 1 then {w} else list_transform({w}[:-2], lambda x, i: x || ' ' || {w}[i + 1]) end"
    return f"list_transform({two}, lambda g, i: g || '#' || len(list_filter(({two})[1:i - 1], lambda x: x = g)))"


ORACLE = f"""
with t as (
  select license, template, regexp_extract_all(lower(template), '{WORD}') as w
  from (values {', '.join(f'({_quoted(a)}, {_quoted(b)})' for a, b in TEMPLATES)}) v(license, template)),
b as (select license, template, {_bag("w")} as bag from t),
l as (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines, text from documents),
u as (
  select doc_id, unnest(lines) as unit, generate_subscripts(lines, 1) as line from l
  union all select doc_id, text, 0 from l where len(lines) > 1),
w as (select doc_id, cast(line as integer) as line, regexp_extract_all(lower(unit), '{WORD}') as w from u),
o as (select doc_id, line, {_bag("w")} as own from w where len(w) between 1 and 300)
select doc_id, line, license, template, 2.0::double * len(list_intersect(own, bag)) / (len(own) + len(bag)) as dice
from o, b
where 3 * len(own) >= 2 * len(bag) and 3 * len(bag) >= 2 * len(own) and 2.0::double * len(list_intersect(own, bag)) / (len(own) + len(bag)) >= 0.8
"""
