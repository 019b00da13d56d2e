"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Each source's documents are shuffled by a hash and queue up once for every copy that the mix may take. A copy's virtual
finish time is its source's cumulative size divided by the source's share, so that at equal times all sources have
served their shares. The copies are range-sorted by finish time over all sources and the queue is cut at the budget.

Cumulative sums are made in two levels: sizes are summed by slice (of the shuffle hash within a source, or of virtual
time), the slices' sums are accumulated in a small table, and only within a slice rows are put in order. No task holds
more than a slice, however large a source is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed

WORD = r"[^\x20\x09-\x0D]+"
#: Rows that a slice is meant to hold.
SLICE_ROWS = 5_000
#: Cells that virtual time is cut into, and each of these again.
CELLS = 4096


def word_count(text: str = "text") -> Column:
    """Number of words of a text, 0 if it is null: starts of runs of word characters, without a list of words."""
    return F.coalesce(F.expr(f"cast(regexp_count({text}, r'{WORD}') as bigint)"), F.lit(0))


def source_shares(sizes: DataFrame, weights: tuple[float, ...], budget_ratio: float, most: float) -> DataFrame:
    """``source, source_size, target`` from ``source, source_size``.

    Sources take the weights in turn by code point, null last. The budget is ``budget_ratio`` times all sizes. A target
    is its weight times a common level, but at most ``most`` times the source's size; the level is the one at which
    the targets add up to the budget: sources are put in the order in which they reach their limits, and the level is
    the least of what each number of limited sources would leave for the others. Sources without words get 0.
    """
    everything = Window.partitionBy()
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighed = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int")))
    ranked = weighed.withColumn("limit", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy((F.col("limit") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    below = order.rowsBetween(Window.unboundedPreceding, -1)
    budget = F.sum("source_size").over(everything) * F.lit(float(budget_ratio))
    level = (budget - F.coalesce(F.sum("limit").over(below), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))
    placed = ranked.withColumn("level", level).withColumn("free", F.col("limit") > F.col("level") * F.col("weight"))
    # the first source that doesn't reach its limit gives the level; before it, all are at their limits
    first = F.min(F.when(F.col("free"), F.struct((F.col("limit") / F.col("weight")).alias("r"), F.col("source").isNull().alias("n"), "source", "level"))).over(everything)
    common = F.least("limit", F.col("weight") * first["level"])
    return placed.select("source", "source_size", F.when(first.isNull(), F.col("limit")).otherwise(common).alias("target"))


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), budget_ratio: float = 1.5, most: int = 2, seed: int = 7, text: str = "text", source: str = "source", doc_id: str = "doc_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, size, source, source_size, target, taken``: a row for each row of ``docs``; taken counts words.

    A document is taken whole or not, once for each of at most ``most`` copies; the copies of a source follow each
    other, so no document is taken twice before every document of its source was taken once. Null text counts as
    empty (size 0, taken 0); null is a source of its own, the last; rows may repeat or lack a doc_id, and tied rows of
    equal size share their hash's place in either order. An empty table gives an empty result. Every other column is
    left alone and not returned, but for those of ``carry``, such as a number that tells rows apart; they come last and
    decide between tied rows. Reruns agree.
    """
    sized = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(source).cast("string").alias("source"), word_count(text).alias("size"), *carry)
    mark = F.md5(F.concat_ws("|", F.lit(str(seed)), F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.col("size").cast("string")))
    sized = checkpointed(sized.withColumn("shuffled", F.conv(F.substring(mark, 1, 15), 16, 10).cast("long")))
    total = sized.count()
    slices = max(1, -(-total // SLICE_ROWS))
    cut = F.col("shuffled").bitwiseAND(F.lit((1 << 31) - 1)) % F.lit(slices)
    sized = sized.withColumn("slice", cut)
    by_slice = sized.groupBy("source", "slice").agg(F.sum("size").alias("slice_size"))
    shares = source_shares(by_slice.groupBy("source").agg(F.sum("slice_size").alias("source_size")), weights, budget_ratio, most)
    # size that stands before each slice; a slice's rows are few, a source's slices are a small table's
    before = F.sum("slice_size").over(Window.partitionBy("source").orderBy("slice")) - F.col("slice_size")
    offsets = by_slice.withColumn("before", before).alias("o").join(shares.alias("s"), F.col("o.source").eqNullSafe(F.col("s.source"))).select("o.source", "slice", "before", "source_size", "target")
    within = F.sum("size").over(Window.partitionBy("source", "slice").orderBy("shuffled", "doc_id", "size", *carry).rowsBetween(Window.unboundedPreceding, 0))
    queued = sized.withColumn("within", within).alias("d").join(offsets.alias("o"), F.col("d.source").eqNullSafe(F.col("o.source")) & (F.col("d.slice") == F.col("o.slice")))
    served = queued.select("d.doc_id", "d.source", "size", "shuffled", "source_size", "target", (F.col("before") + F.col("within")).alias("served"), *carry)
    # virtual finish time of each copy: words served by then over the share
    finish = [F.when(F.col("target") > 0, (F.col("served") + F.col("source_size") * F.lit(c)) / F.col("target")).alias(f"f{c}") for c in range(most)]
    served = checkpointed(served.select("*", *finish))
    words = served.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    return _truncate(served, most, words * min(float(budget_ratio), float(most)), carry)


def _truncate(served: DataFrame, most: int, budget: float, carry: tuple[str, ...] = ()) -> DataFrame:
    """Cut the queue of all copies, in order of finish time, where their words would pass the budget.

    Words are summed by cell of virtual time, then by cell of the one in which the sum passes the budget; only the
    copies in that finest cell are put in order. The driver holds one row of each step.
    """
    coarse = lambda f: F.floor(F.least(f, F.lit(64.0)) * CELLS)
    fine = lambda f: F.floor((F.least(f, F.lit(64.0)) * CELLS - coarse(f)) * CELLS)
    copies = F.posexplode(F.array(*[F.col(f"f{c}") for c in range(most)])).alias("copy", "finish")
    spread = served.where("size > 0").select("doc_id", "source", "size", "shuffled", copies)
    spread = spread.withColumn("coarse", coarse(F.col("finish"))).withColumn("fine", fine(F.col("finish")))

    def passing(rows: DataFrame, cell: str, base: int) -> tuple[int, int] | None:
        upto = F.sum("words").over(Window.orderBy(cell)) + F.lit(base)
        sums = rows.groupBy(cell).agg(F.sum("size").alias("words")).withColumn("upto", upto)
        found = sums.where(F.col("upto") > F.lit(budget)).orderBy(cell).select(cell, (F.col("upto") - F.col("words")).alias("base")).first()
        return found and (found[0], found[1])

    taken = F.lit(0).cast("long")
    edge = passing(spread, "coarse", 0)
    if edge is None:  # the budget takes every copy
        for _ in range(most):
            taken = taken + F.col("size")
    else:
        e1, base = edge
        at_edge = spread.where(F.col("coarse") == e1)
        e2, base = passing(at_edge, "fine", base)
        at_edge = at_edge.where(F.col("fine") == e2)
        order = ["finish", "source", "doc_id", "copy", "shuffled"]
        run = F.sum("size").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)) + F.lit(base)
        last = at_edge.withColumn("run", run).where(F.col("run") <= F.lit(budget)).agg(F.max(F.struct(*order))).first()[0]
        for c in range(most):
            f = F.col(f"f{c}")
            inside = F.lit(False)
            if last is not None:
                here = F.struct(f.alias("finish"), "source", "doc_id", F.lit(c).alias("copy"), "shuffled")
                inside = here <= F.struct(F.lit(last[0]).alias("finish"), F.lit(last[1]).cast("string").alias("source"), F.lit(last[2]).cast("long").alias("doc_id"), F.lit(last[3]).alias("copy"), F.lit(last[4]).alias("shuffled"))
            inside = (coarse(f) < e1) | ((coarse(f) == e1) & ((fine(f) < e2) | ((fine(f) == e2) & inside)))
            taken = taken + F.when((F.col("size") > 0) & inside, F.col("size")).otherwise(F.lit(0))
    return served.select("doc_id", "size", "source", "source_size", F.coalesce("target", F.lit(0.0)).alias("target"), taken.alias("taken"), *carry)


def op4_weighted_fair_queue_mix(spark, sf_dir: str) -> DataFrame:
    """Contract digest of mix over all documents, with the contract's weights."""
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


#: The contract's query in DuckDB: one window over each source's shuffled documents, one over all copies.
ORACLE = f"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size from documents
), h as (
  select *, cast('0x' || substr(md5(concat_ws('|', '7', coalesce(cast(doc_id as varchar), '-'), cast(size as varchar))), 1, 15) as bigint) as shuffled from d
), s as (
  select *, (shuffled & 2147483647) % greatest(1, cast(ceil((select count(*) from d) / {SLICE_ROWS}.0) as bigint)) as slice from h
), src as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (
  select source, source_size, cast(source_size as double) * 2.0 as lim,
         [3.0::double, 1.0::double, 2.0::double][1 + (row_number() over (order by source nulls last) - 1) % 3] as weight from src
), l as (
  select *, ((select cast(sum(source_size) as double) * 1.5 from src) - coalesce(sum(lim) over b, 0.0)) / ((select sum(weight) from w) - coalesce(sum(weight) over b, 0.0)) as level
  from w window b as (order by lim / weight, source nulls last rows between unbounded preceding and 1 preceding)
), c as (select min(struct_pack(r := lim / weight, n := source is null, source := source, level := level)).level as common from l where lim > level * weight),
t as (select source, source_size, case when common is null then lim else least(lim, weight * common) end as target from l, c),
q as (
  select s.doc_id, s.source, s.size, s.shuffled, t.source_size, t.target,
         sum(size) over (partition by s.source order by slice, shuffled, doc_id, size rows unbounded preceding) as served
  from s join t on s.source is not distinct from t.source
), copies as (
  select doc_id, source, size, shuffled, copy, (cast(served as double) + cast(source_size as double) * copy) / target as finish
  from q, (select unnest([0, 1]) as copy) where size > 0
), cut as (
  select doc_id, source, shuffled, size,
         sum(size) over (order by finish, source nulls first, doc_id nulls first, copy, shuffled rows unbounded preceding) <= (select sum(source_size) * 1.5 from src) as inside from copies
), taken as (select doc_id, source, shuffled, sum(size) filter (where inside) as taken from cut group by doc_id, source, shuffled)
select q.doc_id, q.size, q.source_size, q.target, cast(coalesce(taken, 0) as bigint) as taken
from q left join taken k on q.doc_id is not distinct from k.doc_id and q.source is not distinct from k.source and q.shuffled = k.shuffled
"""
