"""Sharding by extendible hashing.

Rows are hashed by their key; a shard is a prefix of the hash's bits. A bucket that exceeds the byte limit splits on
the next bit and one that doesn't stays, until every shard fits. Sizes are summed for the prefixes of a few bits at a
time, so a handful of passes over (hash, bytes) settles the directory. Rows of one hash value that exceed the limit
together (a hot key) go on splitting on the bits of a second hash, of their own.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed

#: Bytes of text that a shard may hold.
LIMIT_BYTES = 1 << 20
#: Bits of a hash, and bits settled in one pass.
BITS, PASS_BITS = 60, 12
#: Directory entries that may be broadcast: at some 40 bytes each, 4 MB.
BROADCAST_ENTRIES = 100_000
NULL_KEY = "\x00null"


def key_hash(*columns: Column) -> Column:
    """The first 60 bits of the md5 of the columns as text, as a number."""
    return F.conv(F.substring(F.md5(F.concat_ws("\x1f", *columns)), 1, 15), 16, 10).cast("long")


def prefix(h: Column, depth: Column) -> Column:
    """The first ``depth`` of the hash's bits as a number."""
    return F.call_function("shiftright", h, F.lit(BITS) - depth)


def directory(rows: DataFrame, limit: int, done: int) -> DataFrame:
    """One pass over rows of buckets that are open at depth ``done``.

    Returns ``grp, entry, depth, bytes, n``: for each prefix ``entry`` of ``done + PASS_BITS`` bits, the depth of the
    shallowest bucket around it that fits, and that bucket's size; depth is null if none does.
    """
    deep = done + PASS_BITS
    cells = rows.groupBy("grp", prefix(F.col("h"), F.lit(deep)).alias("entry")).agg(F.sum("n_bytes").alias("bytes"), F.count("*").alias("n"))
    way = cells.withColumn("depth", F.explode(F.sequence(F.lit(done), F.lit(deep)))).withColumn("at", F.call_function("shiftright", F.col("entry"), F.lit(deep) - F.col("depth")))
    sums = way.groupBy("grp", "depth", "at").agg(F.sum("bytes").alias("bytes"), F.sum("n").alias("n"))
    fits = (F.col("s.bytes") <= limit) | (F.col("s.n") == 1)
    found = way.alias("w").join(sums.alias("s"), ["grp", "depth", "at"])
    return found.groupBy("grp", "entry").agg(F.min(F.when(fits, F.struct("depth", "s.bytes", "s.n"))).alias("x")).select("grp", "entry", "x.*")


def settle(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Split the buckets of each ``grp`` of ``row_id, grp, h, n_bytes``; returns settled rows and those of one hash.

    Settled rows have ``depth, bytes, n`` of their shard.
    """
    settled, done = None, 0
    while True:
        entries = checkpointed(directory(rows, limit, done))
        if entries.count() <= BROADCAST_ENTRIES:
            entries = F.broadcast(entries)
        placed = rows.withColumn("entry", prefix(F.col("h"), F.lit(done + PASS_BITS))).join(entries, ["grp", "entry"])
        fit = placed.where("depth is not null").select("row_id", "grp", "h", "n_bytes", "depth", "bytes", "n")
        settled = fit if settled is None else settled.union(fit)
        rows = placed.where("depth is null").select("row_id", "grp", "h", "n_bytes")
        done += PASS_BITS
        if done >= BITS:
            return settled, rows
        rows = checkpointed(rows)
        if rows.isEmpty():
            return settled, rows


def bits(h: Column, depth: Column) -> Column:
    return F.when(depth == 0, "").otherwise(F.lpad(F.bin(prefix(h, depth)), depth, F.lit("0")))


def assign(docs: DataFrame, key: tuple[str, ...] = ("doc_id",), limit: int = LIMIT_BYTES, text: str = "text", row_id: str | None = None) -> DataFrame:
    """``row_id, <key>, n_bytes, shard, depth, shard_bytes, shard_rows``: one row for each row of ``docs``.

    ``shard`` is the bits of the shard's prefix, with ``+`` and bits of the rows' own hash behind them if all 60 of the
    key's were not enough; ``depth`` is the number of bits. Every shard is within the limit, but for single rows that
    exceed it. Null keys hash as one key, null texts have 0 bytes; rows may repeat (each is numbered); other columns
    are not read. A key column that has the name of a column of the result comes back as ``key_<name>``. An empty table
    gives an empty result.
    """
    if limit < 1:
        raise ValueError("limit must be positive")
    names = [F.coalesce(F.col(f"`{k}`").cast("string"), F.lit(NULL_KEY)) for k in key]
    n_bytes = F.coalesce(F.octet_length(F.col(f"`{text}`").cast("string")), F.lit(0)).cast("long")
    number = F.col(f"`{row_id}`") if row_id else F.monotonically_increasing_id()
    keys = [F.col(f"`{k}`").alias(f"key {i}") for i, k in enumerate(key)]
    rows = checkpointed(docs.select(number.alias("row_id"), *keys, n_bytes.alias("n_bytes"), key_hash(*names).alias("h")))
    slim = rows.select("row_id", F.lit(0).cast("long").alias("grp"), "h", "n_bytes")
    settled, hot = settle(slim, limit)
    shards = settled.select("row_id", bits(F.col("h"), F.col("depth")).alias("shard"), "depth", "bytes", "n")
    hot = checkpointed(hot)
    if not hot.isEmpty():  # rows of one key: split by hashes of their own numbers
        own = hot.select("row_id", F.col("h").alias("grp"), key_hash(F.lit("row"), F.col("row_id").cast("string")).alias("h"), "n_bytes")
        split, rest = settle(own, limit)
        name = F.concat(bits(F.col("grp"), F.lit(BITS)), F.lit("+"), bits(F.col("h"), F.col("depth")))
        shards = shards.union(split.select("row_id", name, F.col("depth") + BITS, "bytes", "n"))
        if not rest.isEmpty():
            raise ValueError("120 bits did not separate rows of different numbers")
    taken = ("row_id", "n_bytes", "shard", "depth", "shard_bytes", "shard_rows")
    given = [F.col(f"key {i}").alias(f"key_{k}" if k in taken else k) for i, k in enumerate(key)]
    return rows.join(shards, "row_id").select("row_id", *given, "n_bytes", "shard", F.col("depth").cast("int").alias("depth"), F.col("bytes").alias("shard_bytes"), F.col("n").alias("shard_rows"))


def write_shards(docs: DataFrame, path: str, key: tuple[str, ...] = ("doc_id",), limit: int = LIMIT_BYTES, text: str = "text") -> None:
    """Write ``docs`` as parquet with a folder for each shard: ``shard=b<bits>``, the root shard's being ``shard=b``.

    The letter keeps readers from taking the bits for a number. A column of ``docs`` that is called shard is written
    as ``own_shard``.
    """
    if "shard" in docs.columns:
        docs = docs.withColumnRenamed("shard", "own_shard")
        key, text = tuple("own_shard" if k == "shard" else k for k in key), "own_shard" if text == "shard" else text
    row = f"row {uuid.uuid4().hex}"
    numbered = checkpointed(docs.withColumn(row, F.monotonically_increasing_id()))
    named = assign(numbered, key, limit, text, row).select(F.col("row_id").alias(row), F.concat(F.lit("b"), "shard").alias("shard"))
    numbered.join(named, row).drop(row).repartition("shard").write.partitionBy("shard").parquet(path)


def op1_extendible_hash_shards(spark, sf_dir: str) -> DataFrame:
    """Shard of every document by doc_id."""
    return assign(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row_id")


ORACLE = f"""
with r as (
  select doc_id, coalesce(strlen(text), 0) as n_bytes,
         ('0x' || substr(md5(coalesce(cast(doc_id as varchar), chr(0) || 'null')), 1, 15))::bigint as h
  from documents
), w as (select *, h >> (60 - d) as p from r, (select unnest(range(0, 41)) as d)),
s as (select d, p, sum(n_bytes) as b, count(*) as n from w group by d, p),
x as (
  select w.doc_id, w.n_bytes, w.h, min(struct_pack(d := s.d, b := s.b, n := s.n)) as x
  from w join s on w.d = s.d and w.p = s.p where s.b <= {LIMIT_BYTES} or s.n = 1
  group by w.doc_id, w.n_bytes, w.h
)
select doc_id, cast(n_bytes as bigint) as n_bytes,
       case when x.d = 0 then '' else lpad(bin(h >> (60 - x.d)), x.d::int, '0') end as shard,
       cast(x.d as int) as depth, cast(x.b as bigint) as shard_bytes, cast(x.n as bigint) as shard_rows
from x
"""
