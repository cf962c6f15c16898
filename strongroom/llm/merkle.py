"""Document fingerprints: a Merkle tree over leaves, paragraphs and sections, with DataFrame functions only.

Sections are parted by blank lines, paragraphs by line ends.  A paragraph's leaves are runs of up to 120
code points that end after ``. ! ?`` or where the run is full; they lose nothing of the paragraph.  A leaf is hashed
by SHA-256, a paragraph by the hashes of its leaves, a section by those of its paragraphs, the root by those of the
sections.  The fingerprint is written ``root:section(paragraph(leaf leaf)paragraph(leaf))section(...)``, the root in full, other
nodes by their first 12 hex digits; so roots test equality and branches that differ locate edits.

With ``whole``, as in the queries, each separator of sections (blank lines, and the indent after them) is a paragraph of one leaf, the first of the
section that it leads to, and the tree loses nothing of the text.  Without it texts that differ in separators only have equal roots.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strongroom.llm._common import fresh_name, whole_text
from strongroom.operators.running import points_column, range_number, sort_key, split_points

LEAF = r"[^.!?]{1,120}[.!?]*|[.!?]+"
SECTION = r"\n[ \t]*\n\s*"
#: Hex digits that stand for a node below the root.
SHORT = 12
#: Documents of a range, about: texts of some kilobytes make some tens of megabytes.
ROWS = 10_000


def tree(text: Column, whole: bool = False) -> Column:
    """Leaf hashes by section and paragraph: array<array<array<string>>>."""
    paragraphs = lambda s: F.transform(F.split(s, "\n"), lambda p: F.transform(F.regexp_extract_all(p, F.lit(LEAF), F.lit(0)), lambda x: F.sha2(x, 256)))
    found = F.transform(F.split(text, SECTION), paragraphs)
    if not whole:
        return found
    before = F.transform(F.regexp_extract_all(text, F.lit(SECTION), F.lit(0)), lambda s: F.array(F.array(F.sha2(s, 256))))
    none = F.array().cast("array<array<string>>")
    return F.zip_with(F.concat(F.array(none), before), found, lambda separator, section: F.concat(separator, section))


def with_fingerprint(df: DataFrame, text: str, root: str, leaves: str, fingerprint: str, whole: bool = False) -> DataFrame:
    """Adds the root, the distinct short leaf hashes and the fingerprint of a column without nulls."""
    t, n = fresh_name(df, "tree"), fresh_name(df, "nodes")
    short = lambda h: F.substring(h, 1, SHORT)
    hashed = lambda a: F.sha2(F.array_join(a, ""), 256)
    df = df.withColumn(t, tree(F.col(text), whole))
    # A section as its paragraphs' hashes, its own hash and its writing.
    paragraph = lambda p: F.struct(hashed(p).alias("h"), F.concat(F.lit("("), F.array_join(F.transform(p, short), " "), F.lit(")")).alias("w"))
    df = df.withColumn(n, F.transform(t, lambda s: F.transform(s, paragraph)))
    section = lambda s: F.struct(hashed(F.transform(s, lambda p: p["h"])).alias("h"), F.array_join(F.transform(s, lambda p: F.concat(short(p["h"]), p["w"])), "").alias("w"))
    df = df.withColumn(n, F.transform(n, section))
    df = df.withColumn(root, hashed(F.transform(n, lambda s: s["h"])))
    written = F.concat(F.col(root), F.lit(":"), F.array_join(F.transform(n, lambda s: F.concat(short(s["h"]), F.lit("("), s["w"], F.lit(")"))), ""))
    df = df.withColumn(leaves, F.array_distinct(F.transform(F.flatten(F.flatten(t)), lambda h: F.conv(short(h), 16, 10).cast("long"))))
    return df.withColumn(fingerprint, written).drop(t, n)


def leaf_set(fingerprint: Column) -> Column:
    """The distinct short leaf hashes that a fingerprint holds."""
    runs = F.regexp_extract_all(fingerprint, F.lit(r"\(([0-9a-f ]*)\)"), F.lit(1))
    return F.array_distinct(F.filter(F.flatten(F.transform(runs, lambda r: F.split(r, " "))), lambda h: h != ""))


def likeness(a: Column, b: Column) -> Column:
    """Dice coefficient of two fingerprints' sets of leaf hashes; equal roots give 1."""
    same = F.substring_index(a, ":", 1) == F.substring_index(b, ":", 1)
    return F.when(same, F.lit(1.0)).otherwise(_dice(leaf_set(a), leaf_set(b)))


def _dice(a: Column, b: Column) -> Column:
    total = F.size(a) + F.size(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * F.size(F.array_intersect(a, b)) / total)


def changed_sections(a: Column, b: Column) -> Column:
    """The numbers (from 0) of the sections of fingerprint a that b doesn't have."""
    nodes = lambda f: F.regexp_extract_all(F.concat(F.lit(")"), F.substring_index(f, ":", -1)), F.lit(r"\)([0-9a-f]{12})\((?=[0-9a-f]{12}\()"), F.lit(1))
    own = nodes(a)
    return F.filter(F.transform(own, lambda h, i: F.when(~F.array_contains(nodes(b), h), i)), lambda i: i.isNotNull())


def fingerprints(docs: DataFrame, whole: bool = False) -> DataFrame:
    """``doc_id, fingerprint`` of each row; a null text counts as empty, equal texts have equal fingerprints."""
    rows = docs.select("doc_id", whole_text("text").alias("text"))
    return with_fingerprint(rows, "text", "root", "leaves", "fingerprint", whole).select("doc_id", "fingerprint")


def edited(docs: DataFrame, ranges: int | None = None, whole: bool = False) -> DataFrame:
    """Fingerprints of each text, of its edit, and how like they and the next document's are.

    The edit replaces the last quarter (floor) of the text's code points by the first as many of the next document's, which is the
    next row by doc_id (null first), then text; the first one follows the last.  ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next``.  A null text counts as empty.  Only a range's first row is
    sent to two ranges, so each row finds the next one inside a window over its range.  Rows that repeat a doc_id are ordered by text, and
    repeated rows have equal fingerprints; one document follows itself; texts of any length are read whole; an empty table gives an empty
    result; other columns are ignored, whatever their names.
    """
    rows = docs.select("doc_id", sort_key("doc_id").alias("id"), whole_text("text").alias("text"))
    starts = split_points(docs.select("doc_id"), sort_key("doc_id"), ranges, ROWS)
    own = F.greatest(range_number(starts, F.col("id")), F.lit(1))
    before = F.when(own == 1, F.lit(len(starts))).otherwise(own - 1)
    home = F.struct(own.alias("home"), F.lit(0).alias("late"))
    # A range's first rows are also the last of the range before, marked late.
    first = F.element_at(points_column(starts), own) == F.col("id")
    homes = F.when(first, F.array(home, F.struct(before.alias("home"), F.lit(1).alias("late")))).otherwise(F.array(home))
    # Only texts are shuffled: hashing again is cheaper than moving hashes, which don't compress.
    dealt = rows.withColumn("h", F.explode(homes)).select("h.*", "doc_id", "id", "text")
    along = Window.partitionBy("home").orderBy("late", "id", "text")
    out = dealt.withColumn("next", F.lead("text").over(along)).where("late = 0")
    n = F.char_length("text")
    k = F.floor(n / 4).cast("int")
    edit = F.concat(F.substring(F.col("text"), F.lit(1), n - k), F.substring(F.col("next"), F.lit(1), k))
    out = out.select("doc_id", n.cast("long").alias("n_chars"), "text", "next", edit.alias("edit"))
    for column in ("text", "edit", "next"):
        out = with_fingerprint(out, column, f"{column}_root", f"{column}_leaves", f"{column}_fingerprint", whole)
    near = lambda other: F.when(F.col("text_root") == F.col(f"{other}_root"), F.lit(1.0)).otherwise(_dice(F.col("text_leaves"), F.col(f"{other}_leaves")))
    return out.select("doc_id", "n_chars", F.sha2("edit", 256).alias("edited_sha256"), F.col("text_fingerprint").alias("fingerprint"), F.col("edit_fingerprint").alias("edited_fingerprint"), near("edit").alias("near_edited"), near("next").alias("near_next"))


ORACLE = r"""
with d as (
  select doc_id, coalesce(text, '') as text, row_number() over (order by doc_id nulls first, text nulls first) as r, count(*) over () as n from documents),
e as (
  select a.doc_id, a.text, b.text as following, a.r,
    substr(a.text, 1, length(a.text) - length(a.text) // 4) || substr(b.text, 1, length(a.text) // 4) as edit
  from d a join d b on b.r = a.r % a.n + 1),
t as (
  select *, [list_transform(regexp_split_to_array(x, '\n[ \t]*\n\s*'), lambda s, i: list_concat(
    case when i > 1 then [[sha256(regexp_extract_all(x, '\n[ \t]*\n\s*')[i - 1])]] else [] end, list_transform(string_split(s, chr(10)),
    lambda p: list_transform(regexp_extract_all(p, '[^.!?]{1,120}[.!?]*|[.!?]+'), lambda l: sha256(l))))) for x in [text, edit, following]] as trees
  from e),
m as (
  select *, [list_transform(x, lambda s: list_transform(s, lambda p: {'h': sha256(array_to_string(p, '')), 'w': '(' || array_to_string(list_transform(p, lambda l: l[1:12]), ' ') || ')'})) for x in trees] as paragraphs
  from t),
s as (
  select *, [list_transform(x, lambda s: {'h': sha256(array_to_string(list_transform(s, lambda p: p.h), '')),
    'w': array_to_string(list_transform(s, lambda p: p.h[1:12] || p.w), '')}) for x in paragraphs] as sections
  from m),
f as (
  select *, [sha256(array_to_string(list_transform(x, lambda s: s.h), '')) for x in sections] as roots,
    [list_distinct(list_transform(flatten(flatten(x)), lambda l: l[1:12])) for x in trees] as leaves
  from s)
select doc_id, length(text) as n_chars, sha256(edit) as edited_sha256,
  roots[1] || ':' || array_to_string(list_transform(sections[1], lambda s: s.h[1:12] || '(' || s.w || ')'), '') as fingerprint,
  roots[2] || ':' || array_to_string(list_transform(sections[2], lambda s: s.h[1:12] || '(' || s.w || ')'), '') as edited_fingerprint,
  case when roots[1] = roots[2] or len(leaves[1]) + len(leaves[2]) = 0 then 1.0::double
    else 2.0::double * len(list_intersect(leaves[1], leaves[2])) / (len(leaves[1]) + len(leaves[2])) end as near_edited,
  case when roots[1] = roots[3] or len(leaves[1]) + len(leaves[3]) = 0 then 1.0::double
    else 2.0::double * len(list_intersect(leaves[1], leaves[3])) / (len(leaves[1]) + len(leaves[3])) end as near_next
from f
"""
