"""How five text filters interact: what each of the 120 orders of applying them keeps, removes and loses.

Every document gets a mask of five bits, one for each filter that it fails, by native expressions. Rows are counted in
the 32 cells of each part (a source); an order's steps follow from the cells alone, so nothing is applied 120 times.
"""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

WORD, GAP = r"[^\x20\x09-\x0D]+", r"[\x20\x09-\x0D]+"
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: The filters in the order of their bits; the last one, for copies, is decided over the whole table.
FILTERS = "ABCDE"
COPY = FILTERS.index("E")
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 50, 65, 5
#: What a cell counts: all rows, those of good quality, toxic ones.
COUNTS = ("n", "good", "toxic")


def failures(text: Column) -> Column:
    """The four lowest bits of a text's mask: A too short, B repetitive, C too many capitals, D with symbols of code."""
    words = F.regexp_count(text, F.lit(WORD))
    distinct = F.size(F.array_remove(F.array_distinct(F.split(text, GAP)), ""))
    capitals = F.length(text) - F.length(F.translate(text, CAPITALS, ""))
    failed = (words < LEAST_WORDS, distinct * 100 < words * LEAST_DISTINCT, capitals * 100 > F.length(text) * MOST_CAPITALS, text.rlike(r"[#$%&*|]"))
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(failed)), F.lit(0))


def cells(docs: DataFrame, labels: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """``part, mask, n, good, toxic``: rows of each part by what they fail, and how many of them have which label.

    Null texts are empty, null sources the part ``''``. A text is a copy if a row with a smaller doc_id anywhere in the
    table has the same one; rows of the same doc_id are no copies of each other, and a row without doc_id is neither a
    copy nor makes one. Texts are compared by 128 bits of md5. Labels may repeat (the largest counts) or be null or
    missing (neither good nor toxic). Other columns aren't read; an empty table has no parts.
    """
    whole = F.coalesce(F.col(text).cast("string"), F.lit(""))
    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.col(source).cast("string"), F.lit("")).alias("part"), whole.alias("text"))
    rows = checkpointed(slim.select("doc_id", "part", F.unhex(F.md5("text")).alias("key"), failures(F.col("text")).alias("mask")))
    # a join on the text alone would bring a group of copies into one task; its first id tells the same
    first = rows.groupBy("key").agg(F.min("doc_id").alias("first")).select(F.col("key").alias("same"), "first")
    told = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("told")).agg(F.max("quality").alias("quality"), F.max("toxic").alias("toxic"))
    judged = rows.join(first, (F.col("doc_id") == F.col("first")) & (F.col("key") == F.col("same")), "left").join(told, F.col("doc_id") == F.col("told"), "left")
    copy = F.col("doc_id").isNotNull() & F.col("first").isNull()
    mask = F.col("mask") + F.when(copy, 1 << COPY).otherwise(0)
    one = lambda label: F.count(F.when(F.col(label) == 1, 1))
    return judged.groupBy("part", mask.alias("mask")).agg(F.count("*").alias("n"), one("quality").alias("good"), one("toxic").alias("toxic"))


def orders(names: str = FILTERS) -> Column:
    """An array of one struct for each order and step: ``filter_order, step, bit, before`` (the mask of earlier filters)."""
    steps = []
    for order in permutations(range(len(names))):
        before = 0
        for step, i in enumerate(order):
            steps.append((("".join(names[j] for j in order)), step + 1, i, before))
            before |= 1 << i
    rows = ", ".join(f"named_struct('filter_order', '{o}', 'step', {s}, 'bit', {1 << i}, 'before', {b})" for o, s, i, b in steps)
    return F.expr(f"array({rows})")


def interactions(counted: DataFrame, names: str = FILTERS) -> DataFrame:
    """``part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley``.

    A row for each part, order and step. ``shapley`` is what the step's filter removes, summed over all orders: a row
    that fails f filters is removed by each of them in the same share of the orders.
    """
    size = 1 << len(names)
    held = F.map_from_entries(F.collect_list(F.struct("mask", F.struct(*COUNTS))))  # a row for each mask at most
    parts = counted.groupBy("part").agg(held.alias("held"))
    nothing = F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS])
    every = F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda m: F.struct(m.alias("mask"), F.coalesce(F.try_element_at(F.col("held"), m), nothing).alias("c")))
    steps = parts.select("part", every.alias("cells")).select("part", "cells", F.explode(orders(names)).alias("o")).select("part", "cells", "o.*")
    bit, before = F.col("bit"), F.col("before")

    def total(which, value) -> Column:
        return F.aggregate("cells", F.lit(0).cast("long"), lambda t, c: t + F.when(which(c["mask"]), value(c)).otherwise(0))

    rows = lambda c: c["c"]["n"]
    fails, seen = lambda m: m.bitwiseAND(bit) != 0, lambda m: m.bitwiseAND(before) != 0
    here = lambda m: fails(m) & ~seen(m)
    share = lambda c: c["c"]["n"] * (F.lit(factorial(len(names))) / F.greatest(F.bit_count(c["mask"]), F.lit(1))).cast("long")
    return steps.select(
        "part", "filter_order", "step",
        total(lambda m: ~fails(m) & ~seen(m), rows).alias("kept"),
        total(here, rows).alias("removed"),
        total(lambda m: fails(m) & seen(m), rows).alias("redundant"),
        total(lambda m: m == bit, rows).alias("unique_fails"),
        total(here, lambda c: c["c"]["good"]).alias("good_lost"),
        total(here, lambda c: c["c"]["toxic"]).alias("toxic_lost"),
        total(fails, share).alias("shapley"),
    )


def op11_filter_audit(spark, sf_dir: str) -> DataFrame:
    """The contract's five filters over all documents, by source."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{name}.parquet") for name in ("documents", "labels"))
    return interactions(cells(docs, labels))


#: The same in DuckDB: each order's first failing filter is looked up row by row of (part, mask).
ORACLE = """
with d as (select doc_id, coalesce(source, '') as part, coalesce(text, '') as text from documents),
f as (select text, min(doc_id) as first from d group by text),
w as (select d.*, first, regexp_extract_all(d.text, '[^\\x20\\x09-\\x0D]+') as words from d join f on d.text = f.text),
l as (select doc_id, max(quality) as quality, max(toxic) as toxic from labels group by doc_id),
m as (
  select part, coalesce(quality = 1, false) as good, coalesce(toxic = 1, false) as toxic,
    [len(words) < 50, 100 * len(list_distinct(words)) < 65 * len(words), 100 * len(regexp_extract_all(text, '[A-Z]')) > 5 * length(text),
     regexp_matches(text, '[#$%&*|]'), coalesce(first < w.doc_id, false)] as bad
  from w left join l on w.doc_id = l.doc_id
), c as (select part, bad, count(*) as n, count(*) filter (where good) as good, count(*) filter (where toxic) as toxic from m group by part, bad),
x as (select unnest(['A', 'B', 'C', 'D', 'E']) as x),
o as (select a.x || b.x || c.x || d.x || e.x as filter_order from x a, x b, x c, x d, x e where len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s as (select filter_order, cast(step as int) as step from o, (select unnest(range(1, 6)) as step)),
j as (
  select part, filter_order, step, n, good, toxic, bad[instr('ABCDE', substr(filter_order, step, 1))] as fails,
    len(list_filter(range(1, step), lambda i: bad[instr('ABCDE', substr(filter_order, i, 1))])) > 0 as gone, len(list_filter(bad, lambda b: b)) as n_bad
  from c, s
), r as (
  select part, filter_order, step, substr(filter_order, step, 1) as f,
    cast(coalesce(sum(n) filter (where not fails and not gone), 0) as bigint) as kept, cast(coalesce(sum(n) filter (where fails and not gone), 0) as bigint) as removed,
    cast(coalesce(sum(n) filter (where fails and gone), 0) as bigint) as redundant, cast(coalesce(sum(n) filter (where fails and n_bad = 1), 0) as bigint) as unique_fails,
    cast(coalesce(sum(good) filter (where fails and not gone), 0) as bigint) as good_lost, cast(coalesce(sum(toxic) filter (where fails and not gone), 0) as bigint) as toxic_lost
  from j group by part, filter_order, step
)
select part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, cast(sum(removed) over (partition by part, f) as bigint) as shapley from r
"""
