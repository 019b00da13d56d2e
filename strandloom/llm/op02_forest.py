"""Nearest neighbours by largest inner product from a hash-prefix forest.

Every tree hashes a vector to a long string of sign bits of a random rotation and keeps the strings sorted, dealt to
cells by their first bits. A query descends to its longest matching prefix in each tree; then all trees ascend together,
a bit at a time, until enough entries share the prefixes. These are the query's candidates: it is sent to the cells that
its prefix touches, one of a tree as a rule, and only what shares the prefix there is scored, exactly. The nearest of
all cells are merged per query.

How many entries are enough is fitted once: a bounded sample of queries is compared with every row, block by block, and
the fit takes the smallest number by which the ascent meets enough of their true neighbours.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, parts

TREES, BITS = 32, 64
#: Rows and queries that a task is meant to hold of a cell; larger cells are dealt to several.
CELL_ROWS, CELL_QUERIES = 8_192, 4_096
#: Queries that the number of entries is fitted on, and the recall that it has to reach there.
SAMPLE_QUERIES, SAMPLE_RECALL = 128, 0.95
#: Cells whose table of sizes is broadcast, at some 50 bytes each; longer tables are joined by shuffles.
BROADCAST_CELLS = 200_000
#: Rows of a block whose products with some queries are made at once.
BLOCK_ROWS = 4_096


def rotations(dim: int, trees: int = TREES, bits: int = BITS, seed: int = 11) -> np.ndarray:
    """[trees, dim, bits] directions, orthogonal as far as the dimension allows."""
    rng = np.random.RandomState(seed)
    out = []
    for _ in range(trees):
        blocks = [np.linalg.qr(rng.randn(dim, dim))[0] for _ in range(-(-bits // dim))]
        out.append(np.concatenate(blocks, axis=1)[:, :bits])
    return np.stack(out)


def strings(x: np.ndarray, directions: np.ndarray) -> np.ndarray:
    """[trees, rows] hash strings, the first bit highest."""
    weight = np.uint64(1) << np.arange(directions.shape[2] - 1, -1, -1, dtype=np.uint64)
    return np.stack([((x @ d > 0) * weight).sum(axis=1, dtype=np.uint64) << np.uint64(64 - len(weight)) for d in directions])


def lifted(x: np.ndarray, most: float) -> np.ndarray:
    """Rows with one more component, so that all have length ``most`` and inner products order like angles."""
    return np.concatenate([x, np.sqrt(np.maximum(0, most * most - (x * x).sum(axis=1)))[:, None]], axis=1)


def query_strings(q: np.ndarray, directions: np.ndarray) -> np.ndarray:
    return strings(np.concatenate([q, np.zeros((len(q), 1))], axis=1), directions)


def common_bits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the longest common prefix of 64-bit strings."""
    x = a ^ b
    out = np.full(x.shape, 64, np.int64)
    some = x != 0
    high = (x[some] >> np.uint64(32)).astype(np.uint32)
    top = high != 0
    # the exponent of a number of 32 bits is exact as a float
    out[some] = np.where(top, 32, 64) - np.frexp(np.where(top, high, x[some].astype(np.uint32)).astype(np.float64))[1]
    return out


def flat(column: pa.Array, kind: type, rows: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return np.asarray(column.flatten(), dtype=kind).reshape(rows, -1) if rows else np.zeros((0, 1), kind)


def fit_entries(rows: DataFrame, queries: np.ndarray, query_ids: np.ndarray, k: int, most: float, directions: np.ndarray, kind: type) -> int:
    """The least number of entries, a power of two, whose recall on the sampled queries is enough.

    Every row is compared with the sample; what comes back is, for each of these queries, a count for each prefix
    length, and its k nearest with the longest prefix that any tree shares.
    """
    trees, n_q = len(directions), len(queries)
    shared = rows.sparkSession.sparkContext.broadcast((queries, query_ids, directions))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, directions = shared.value
        q_keys = query_strings(q, directions)
        met = np.zeros((n_q, 65), np.int64)
        best: list[tuple] = [(np.zeros(0), np.zeros(0, np.int64))] * n_q
        for batch in batches:
            for lo in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(lo, BLOCK_ROWS)
                x = flat(part.column(1), kind, part.num_rows).astype(np.float64)
                own = part.column(0).to_numpy()
                keys = strings(lifted(x, most), directions)
                near = q @ x.T
                for i in range(n_q):
                    bits = np.stack([common_bits(keys[t], q_keys[t, i]) for t in range(trees)])
                    met[i] += np.bincount(bits.ravel(), minlength=65)
                    score = np.where(own == ids[i], -np.inf, near[i])
                    top = np.argpartition(-score, min(k, len(score)) - 1)[:k]
                    s, b = np.r_[best[i][0], score[top]], np.r_[best[i][1], bits.max(axis=0)[top]]
                    order = np.argsort(-s, kind="stable")[:k]
                    best[i] = s[order], b[order]
        q_no, depth = np.nonzero(met)
        near_q = np.repeat(np.arange(n_q), [len(b[0]) for b in best])
        score, bits = (np.concatenate([b[j] for b in best]) for j in (0, 1))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.r_[q_no, near_q].astype(np.int32)), pa.array(np.r_[depth, bits].astype(np.int32)), pa.array(np.r_[met[q_no, depth], np.zeros(len(near_q), np.int64)]), pa.array(np.r_[np.full(len(q_no), np.nan), score])],
            ["q", "bits", "n", "score"],
        )

    found = checkpointed(rows.select("vec_id", "vec").mapInArrow(run, "q int, bits int, n long, score double"))
    met = np.zeros((n_q, 66), np.int64)
    for r in found.where("isnan(score)").groupBy("q", "bits").agg(F.sum("n").alias("n")).collect():  # 65 a sampled query
        met[r.q, r.bits] = r.n
    met = met[:, ::-1].cumsum(axis=1)[:, ::-1]  # entries that share at least so many bits
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), F.desc("bits")))
    truth = found.where("not isnan(score) and score > double('-infinity')").withColumn("rank", rank).where(F.col("rank") <= k).select("q", "bits").collect()  # k a sampled query
    if not truth:
        return 1
    q_no, bits = (np.array([r[i] for r in truth]) for i in (0, 1))
    for power in range(int(met[:, 0].max()).bit_length()):
        depth = (met >= 1 << power).sum(axis=1) - 1  # the longest prefix that as many entries share
        if (bits >= depth[q_no]).mean() >= SAMPLE_RECALL:
            return 1 << power
    return int(met[:, 0].max())


def prefix_range(keys: np.ndarray, key: np.uint64, depth: int) -> tuple[int, int]:
    """Where the sorted ``keys`` share the first ``depth`` bits of ``key``."""
    if depth == 0:
        return 0, len(keys)
    rest = np.uint64((1 << (64 - depth)) - 1)
    return int(np.searchsorted(keys, key & ~rest, side="left")), int(np.searchsorted(keys, key | rest, side="right"))


def nearest_in_cell(keys: np.ndarray, ids: np.ndarray, x: np.ndarray, q_keys: np.ndarray, q_ids: np.ndarray, q: np.ndarray, depths: np.ndarray, k: int):
    """Yields (query_id, vec_ids, scores): the k nearest, ties to the smaller id, of the rows that share each query's prefix."""
    order = np.argsort(keys, kind="stable")
    keys, ids, x = keys[order], ids[order], x[order].astype(np.float64)
    q = q.astype(np.float64)
    spans = np.array([prefix_range(keys, key, int(d)) for key, d in zip(q_keys, depths, strict=True)]).reshape(-1, 2)
    by_span = np.lexsort((spans[:, 1], spans[:, 0]))
    cut = np.flatnonzero(np.r_[True, (np.diff(spans[by_span], axis=0) != 0).any(axis=1)]) if len(by_span) else np.zeros(0, np.int64)
    for s, e in zip(cut, np.r_[cut[1:], len(by_span)], strict=True):
        lo, hi = spans[by_span[s]]
        if lo == hi:
            continue
        for at in range(s, e, 256):
            some = by_span[at : min(e, at + 256)]
            near = q[some] @ x[lo:hi].T  # queries of one prefix with what shares it, and nothing else
            want = min(k + 1, hi - lo)  # one more: the query itself may be among them
            edge = -np.partition(-near, want - 1, axis=1)[:, want - 1]
            for row, i in enumerate(some):
                best = lo + np.flatnonzero(near[row] >= edge[row] - 1e-9 * (abs(edge[row]) + 1))
                exact = (x[best] * q[i]).sum(axis=1)
                good = ids[best] != q_ids[i]
                found, score = ids[best][good], exact[good]
                rank = np.lexsort((found, -score))[:k]
                yield q_ids[i], found[rank], score[rank]


def valid(vectors: DataFrame, vec_id: str, vec: str) -> DataFrame:
    """``vec_id, vec, norm`` of the vectors that take part: not null, not zero, finite, and of the commonest length."""
    slim = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(vec).alias("vec")).where("vec_id is not null and vec is not null and size(vec) > 0")
    sized = slim.groupBy(F.size("vec").alias("n")).agg(F.count("*").alias("c")).orderBy(F.desc("c"), "n").first()
    if sized is None:
        return slim.where("false").withColumn("norm", F.lit(0.0))
    good = F.forall("vec", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double")))
    return slim.where((F.size("vec") == sized.n) & good).withColumn("norm", norm).where("norm > 0")


def nearest(vectors: DataFrame, is_query, k: int = 20, vec_id: str = "vec_id", vec: str = "embedding", entries: int | None = None) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row that ``is_query`` picks (a condition on vec_id), its k nearest.

    Nearness is the inner product in double precision, larger first, ties to the smaller vec_id; a query's own id is
    no candidate. Vectors that are null, empty, zero, of another length than most, or that hold nulls or non-finite
    numbers take no part, nor do rows without an id. Repeats of a row (id and vector) count once. All candidates are
    returned if there are fewer than k; without queries, or in an empty table, nothing is. ``entries`` is how many
    entries of the trees a query has to meet; None fits it.
    """
    rows = checkpointed(valid(vectors, vec_id, vec).dropDuplicates(["vec_id", "vec"]))
    total, most = rows.agg(F.count("*"), F.max("norm")).first()
    spark, sc = rows.sparkSession, rows.sparkSession.sparkContext
    if not total:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    kind = np.float64 if "double" in dict(rows.dtypes)["vec"] else np.float32
    queries = rows.where(is_query(F.col("vec_id"))).orderBy("vec_id", "vec").dropDuplicates(["vec_id"]).select("vec_id", "vec")
    sample = queries.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_QUERIES).select("vec_id", "vec").toArrow()
    if not sample.num_rows:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    # of equal vectors no more than k + 1 rows, those of the smallest ids, can be among the nearest of anything
    place = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))
    held = checkpointed(rows.withColumn("place", place).where(F.col("place") <= k + 1).select("vec_id", "vec"))
    x = flat(sample.column(1), kind, sample.num_rows).astype(np.float64)
    directions = rotations(x.shape[1] + 1)
    enough = entries or fit_entries(held, x, sample.column(0).to_numpy(), k, most, directions, kind)
    kept = held.count()
    bits = max(0, (parts(kept, CELL_ROWS) - 1).bit_length())  # of a cell's prefix
    deepest = min(BITS, kept.bit_length() + 3)
    shared = sc.broadcast(directions)

    def dealt(of_rows: bool, with_vectors: bool):
        """An entry for each tree: ``tree, cell, key, vec_id`` and the vector's bytes."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for lo in range(0, whole.num_rows, 512):
                    batch = whole.slice(lo, 512)
                    n = batch.num_rows
                    v = flat(batch.column(1), kind, n)
                    keys = strings(lifted(v.astype(np.float64), most), shared.value) if of_rows else query_strings(v.astype(np.float64), shared.value)
                    cell = keys >> np.uint64(64 - bits) if bits else np.zeros_like(keys)
                    ids = batch.column(0).to_numpy()
                    columns = [np.repeat(np.arange(TREES, dtype=np.int32), n), cell.ravel().astype(np.int64), keys.ravel().view(np.int64), np.tile(ids, TREES)]
                    raw = [pa.array([r.tobytes() for r in v] * TREES, pa.binary())] if with_vectors else []
                    yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *raw], ["tree", "cell", "key", "vec_id", *(["x"] if with_vectors else [])])

        return run

    slim = "tree int, cell long, key long, vec_id long"
    row_keys = held.mapInArrow(dealt(True, False), slim)
    query_keys = checkpointed(queries.mapInArrow(dealt(False, False), slim))
    # cells and what of a cell's prefix lies in it; a large cell's rows and queries are dealt to several tasks
    cells = checkpointed(row_keys.groupBy("tree", "cell").agg(F.count("*").alias("n")).withColumn("row_parts", F.ceil(F.col("n") / CELL_ROWS).cast("int")))

    def met_in_cell(held: pa.Table, asked: pa.Table) -> pa.Table:
        if not held.num_rows or not asked.num_rows:
            return pa.table({"vec_id": pa.array([], pa.int64()), "depth": pa.array([], pa.int32()), "n": pa.array([], pa.int64())})
        keys = np.sort(held.column("key").to_numpy().view(np.uint64))
        mine, ids = asked.column("key").to_numpy().view(np.uint64), asked.column("vec_id").to_numpy()
        out = []
        for depth in range(max(bits, 1), deepest + 1):
            rest = np.uint64((1 << (64 - depth)) - 1)
            n = np.searchsorted(keys, mine | rest, side="right") - np.searchsorted(keys, mine & ~rest, side="left")
            at = np.flatnonzero(n)
            out.append((ids[at], np.full(len(at), depth, np.int32), n[at]))
        return pa.table({n: np.concatenate(c) for n, c in zip(("vec_id", "depth", "n"), zip(*out, strict=True), strict=True)})

    def meeting(entries: DataFrame, asked: DataFrame):
        """Cells of rows with the queries that visit them: rows in parts and queries in lots of bounded size, which all meet."""
        own, others = ([c for c in t.columns if c not in ("tree", "cell")] for t in (entries, asked))
        lots = asked.groupBy("tree", "cell").agg(F.ceil(F.count("*") / CELL_QUERIES).cast("int").alias("lots"))
        sizes = checkpointed(lots.join(cells.select("tree", "cell", "row_parts"), ["tree", "cell"]))
        if sizes.count() <= BROADCAST_CELLS:  # entries then travel once, to the tasks that score them
            sizes = F.broadcast(sizes)
        asked = asked.join(sizes, ["tree", "cell"]).withColumn("lot", F.pmod(F.xxhash64(F.lit(1), "vec_id"), F.col("lots")).cast("int"))
        asked = asked.select("tree", "cell", "lot", F.explode(F.sequence(F.lit(0), F.col("row_parts") - 1)).alias("part"), *others)
        entries = entries.join(sizes, ["tree", "cell"]).withColumn("part", F.pmod(F.xxhash64("vec_id"), F.col("row_parts")).cast("int"))
        entries = entries.select("tree", "cell", "part", F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"), *own)
        by = ["tree", "cell", "part", "lot"]
        return entries.groupBy(*by).cogroup(asked.groupBy(*by))

    fine = meeting(row_keys, query_keys).applyInArrow(met_in_cell, "vec_id long, depth int, n long")
    depths = F.explode(F.sequence(F.lit(1), F.lit(max(1, bits - 1)))).alias("depth")
    # prefixes shorter than a cell's: sums of the cells' counts
    wide = cells.select("tree", "cell", "n", depths).where(F.col("depth") < bits)
    above = lambda: F.call_function("shiftright", F.col("cell"), F.lit(bits) - F.col("depth")).alias("prefix")
    wide = wide.select("tree", "depth", above(), "n").groupBy("tree", "depth", "prefix").agg(F.sum("n").alias("n"))
    coarse = query_keys.select("vec_id", "tree", "cell", depths).where(F.col("depth") < bits).select("vec_id", "tree", "depth", above()).join(wide, ["tree", "depth", "prefix"]).select("vec_id", "depth", "n")
    met = fine.union(coarse).groupBy("vec_id", "depth").agg(F.sum("n").alias("met"), F.max("n").alias("most"))
    longest = met.where((F.col("met") >= enough) & (F.col("most") > k)).groupBy("vec_id").agg(F.max("depth").alias("depth"))
    # a query that not even the first bit gives enough visits one tree whole
    asked = queries.mapInArrow(dealt(False, True), slim + ", x binary").join(longest, "vec_id", "left").withColumn("depth", F.coalesce("depth", F.lit(0))).where("depth > 0 or tree = 0")
    free = F.greatest(F.lit(0), F.lit(bits) - F.col("depth"))
    first = F.call_function("shiftleft", F.call_function("shiftright", F.col("cell"), free), free)
    asked = checkpointed(asked.withColumn("cell", F.explode(F.sequence(first, first + F.call_function("shiftleft", F.lit(1).cast("long"), free) - 1))))

    def visit(held: pa.Table, asked: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if held.num_rows and asked.num_rows:
            matrix = lambda t: np.frombuffer(b"".join(t.column("x").to_pylist()), kind).reshape(t.num_rows, -1)
            number = lambda t, n: t.column(n).to_numpy()
            for query, ids, score in nearest_in_cell(number(held, "key").view(np.uint64), number(held, "vec_id"), matrix(held), number(asked, "key").view(np.uint64), number(asked, "vec_id"), matrix(asked), number(asked, "depth"), k):
                out[0].append(np.full(len(ids), query))
                out[1].append(ids)
                out[2].append(score)
        return pa.table({n: np.concatenate(c) if c else np.zeros(0, t) for n, c, t in zip(("query_id", "vec_id", "score"), out, (np.int64, np.int64, np.float64), strict=True)})

    found = meeting(held.mapInArrow(dealt(True, True), slim + ", x binary"), asked).applyInArrow(visit, "query_id long, vec_id long, score double")
    found = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op2_hash_prefix_forest(spark, sf_dir: str) -> DataFrame:
    """Contract digest: the 20 nearest of every row whose vec_id is divisible by 20."""
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), lambda i: i % 20 == 0)
