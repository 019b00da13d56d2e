"""SimHash near-duplicate groups through Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits. Two fingerprints that differ in three bits or
fewer have at least two segments with at most one differing bit each (the error splits 3+0+0, 2+1+0 and 1+1+1 all
leave such a pair). Each segment, padded to 23 bits, is decoded with the perfect binary Golay code [23, 12, 7]: the
index of its nearest codeword is its home, and the indices of all codewords within distance four are its keys (one for
words within two bits of a codeword, six otherwise). A word within one bit of another has that one's home among its
keys, so every pair to be linked meets in a bucket (pair of segments, key, key) in which one of the two is at home.
Buckets then verify by Hamming distance and return a spanning forest of their links, never all pairs.

Rows travel as packed arrays: one row a bucket range and batch, not one a key.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, numbered, parts, texts_of
from .graph import components

#: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1, a generator of the binary Golay code.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))
#: Differing bits that the three segments are made for.
RADIUS = 3
#: Packed entries that one bucket range is meant to hold (some 7 bytes each), and fingerprints that a packing task is.
RANGE_ENTRIES, TASK_FINGERPRINTS = 500_000, 16_384
KEYS_EACH = 90


@lru_cache(maxsize=1)
def golay() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Parity of each 12-bit message; for each syndrome, the error patterns of weight four at most and how many."""
    parity = np.zeros(4096, np.uint32)
    for m in range(4096):
        r = m << 11
        for bit in range(22, 10, -1):
            if r >> bit & 1:
                r ^= GENERATOR << (bit - 11)
        parity[m] = r
    errors, many = np.zeros((2048, 6), np.uint32), np.zeros(2048, np.int64)
    for weight in range(5):
        for bits in combinations(range(23), weight):
            e = sum(1 << b for b in bits)
            s = int(parity[e >> 11]) ^ (e & 2047)
            errors[s, many[s]] = e
            many[s] += 1
    return parity, errors, many


def golay_keys(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Up to six codeword indices of each 23-bit word, the home first, and how many there are."""
    parity, errors, many = golay()
    s = parity[words >> 11] ^ (words & 2047)
    return (words[:, None] ^ errors[s]) >> 11, many[s]


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the 64-bit hashes; no hashes give 0."""
    n = len(hashes)
    if not n:
        return 0
    bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
    whole = n // 255 * 255
    counts = bits[whole:].sum(axis=0, dtype=np.int64)
    if whole:
        counts += np.add.reduce(bits[:whole].reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def shingles(text: bytes, words: int) -> list[bytes]:
    """Lower-cased (A-Z) runs of ``words`` words, repeats included; the whole sequence if it is shorter."""
    w = text.lower().split()  # of bytes: splits at \x20 and \x09-\x0D, lowers A-Z
    if len(w) >= words:
        return list(map(b" ".join, zip(*[w[i:] for i in range(words)], strict=False)))
    return [b" ".join(w)] if w else []


def shingle_hashes(text: bytes, words: int, seed: int) -> np.ndarray:
    s = shingles(text, words)
    h = xxhash.xxh64_intdigest
    return np.fromiter([h(x, seed) for x in s], np.uint64, len(s))


def fingerprints(docs: DataFrame, words: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) of every row; a null or empty text has fingerprint 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(shingle_hashes(t, words, seed)) for t in texts_of(batch.column(1))], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def bucket_entries(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket, position of its fingerprint and whether that is at home there, of every key of every fingerprint."""
    segs = [golay_keys(((fps >> np.uint64(at)) & np.uint64((1 << n) - 1)).astype(np.uint32)) for at, n in SEGMENTS]
    out = []
    for p, (i, j) in enumerate(combinations(range(3), 2)):
        (a, na), (b, nb) = segs[i], segs[j]
        for x in range(6):
            for y in range(6):
                at = np.flatnonzero((x < na) & (y < nb))
                out.append((np.uint32(p << 24) | (a[at, x] << 12) | b[at, y], at, np.full(len(at), x == 0 and y == 0)))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def spanning(fps: np.ndarray, radius: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """A spanning forest of the graph that links fingerprints at ``radius`` bits or fewer.

    Breadth first over what is unvisited: a dense group is used up by its first few members, so time and edges stay
    near the number of fingerprints where all pairs would be its square.
    """
    rest, a, b = fps, [], []
    while len(rest) > 1:
        todo, rest = [rest[:1]], rest[1:]
        while todo and len(rest):
            block = todo.pop()
            for p in block:
                near = np.bitwise_count(rest ^ p) <= radius
                if near.any():
                    hits = rest[near]
                    a.append(np.full(len(hits), p))
                    b.append(hits)
                    todo.append(hits)
                    rest = rest[~near]
                    if not len(rest):
                        break
    return a, b


def bucket_links(keys: np.ndarray, fps: np.ndarray, home: np.ndarray, radius: int, small: int = 24) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect, within each bucket, what lies within ``radius`` bits; ends as unsigned 64-bit values."""
    order = np.argsort(keys, kind="stable")
    keys, fps, home = keys[order], fps[order], home[order]
    start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    size = np.diff(np.r_[start, len(keys)])
    good = (size > 1) & (np.add.reduceat(home.astype(np.int64), start) > 0) if len(start) else np.zeros(0, bool)
    a, b = [], []
    for s, n in zip(start[good & (size > small)], size[good & (size > small)], strict=True):
        x, y = spanning(np.unique(fps[s : s + n]), radius)
        a += x
        b += y
    tiny = np.repeat(good & (size <= small), size)
    keys, fps, home = keys[tiny], fps[tiny], home[tiny]
    for d in range(1, small):
        if len(keys) <= d:
            break
        at = np.flatnonzero((keys[d:] == keys[:-d]) & (home[d:] | home[:-d]))
        if not len(at):
            break
        at = at[(np.bitwise_count(fps[at] ^ fps[at + d]) <= radius) & (fps[at] != fps[at + d])]
        a.append(fps[at])
        b.append(fps[at + d])
    if not a:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    pairs = np.unique(np.stack([np.minimum(x := np.concatenate(a), y := np.concatenate(b)), np.maximum(x, y)], axis=1), axis=0)
    return pairs[:, 0], pairs[:, 1]


PACKED = "bucket int, keys binary, fps binary, many binary, home binary"


def fingerprint_links(fps: DataFrame, n_rows: int, radius: int = RADIUS) -> DataFrame:
    """``a, b``: links that connect distinct fingerprints (column ``fp``) that differ in ``radius`` (at most 3) bits."""
    if not 0 <= radius <= RADIUS:
        raise ValueError(f"radius must be 0 to {RADIUS}: the segments guarantee no more")
    ranges = parts(n_rows * KEYS_EACH, RANGE_ENTRIES, 32)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 8192):
                fp = whole.column(0).to_numpy()[lo : lo + 8192].view(np.uint64)
                keys, at, home = bucket_entries(fp)
                bucket = ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) % np.uint64(ranges)
                order = np.lexsort((at, bucket))
                bucket, keys, at, home = bucket[order], keys[order], at[order], home[order]
                cut = np.r_[np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]), len(bucket)]
                rows = []
                for s, e in zip(cut[:-1].tolist(), cut[1:].tolist(), strict=True):
                    own = at[s:e]  # a fingerprint is sent once with all its keys in the range
                    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
                    many = np.diff(np.r_[first, e - s]).astype(np.uint8)
                    rows.append((int(bucket[s]), keys[s:e].tobytes(), fp[own[first]].tobytes(), many.tobytes(), np.packbits(home[s:e]).tobytes()))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int32(), *[pa.binary()] * 4), strict=True)], ["bucket", "keys", "fps", "many", "home"])

    def link(group: pa.Table) -> pa.Table:
        keys, fp, many = (np.frombuffer(b"".join(group.column(n).to_pylist()), t) for n, t in (("keys", np.uint32), ("fps", np.uint64), ("many", np.uint8)))
        fp = np.repeat(fp, many)
        sizes = [len(k) // 4 for k in group.column("keys").to_pylist()]
        home = np.concatenate([np.unpackbits(np.frombuffer(h, np.uint8), count=n) for h, n in zip(group.column("home").to_pylist(), sizes, strict=True)]).astype(bool)
        a, b = bucket_links(keys, fp, home, radius)
        return pa.table({"a": a.view(np.int64), "b": b.view(np.int64)})

    # a fingerprint is 8 bytes but fans out to some 90 entries: tasks are made by number, not by bytes
    dealt = fps.select("fp").repartition(parts(n_rows, TASK_FINGERPRINTS), "fp")
    return dealt.mapInArrow(pack, PACKED).groupBy("bucket").applyInArrow(link, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, seed: int = 42, radius: int = RADIUS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id, n_links``: one row for each row of ``docs``.

    Fingerprints that differ in ``radius`` bits or fewer are linked; component_id is the smallest doc_id that can be
    reached, its own included; n_links counts the distinct other fingerprints that the spanning links of its own reach
    directly. Empty and null texts have fingerprint 0 and link like any other. Rows may repeat a doc_id or have none:
    groups hold fingerprints, and a null doc_id is never the smallest unless there is no other. An empty table gives
    an empty result. Other columns of ``docs`` are not read.
    """
    own = checkpointed(fingerprints(docs, words, seed, doc_id, text))
    classes = checkpointed(own.groupBy("fp").agg(F.min("doc_id").alias("first")))
    links = checkpointed(fingerprint_links(classes, classes.count(), radius))
    comp = components(links)
    named = comp.join(classes, comp.node == classes.fp).select("fp", "label", "first")
    least = named.groupBy("label").agg(F.min("first").alias("least"))
    degree = links.select(F.explode(F.array("a", "b")).alias("fp")).groupBy("fp").agg(F.count("*").alias("n_links"))
    reach = named.join(least, "label").join(degree, "fp").select("fp", "least", "n_links")
    known = classes.join(reach, "fp", "left").select("fp", F.coalesce("least", "first").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return own.join(known, "fp").select("doc_id", "fp", "component_id", "n_links")


#: Shape of near copies outside the contract: words of a shingle and least similarity.
WORDS, SIMILARITY = 5, 0.8
#: Most shingles that are known to be frequent; which ones are only decides how many pairs are proposed.
FREQUENT = 65_536
#: Bits of the filter of rows whose texts are wanted, and nodes that a task remembers to send their keys once.
FILTER_BITS, REMEMBERED = 1 << 24, 1_000_000
SHAPES = "row long, doc_id long, node long, fp long, n int, keys array<long>, b0 long, b1 long, b2 long, b3 long, odd binary"
#: Nodes that share a prefix shingle above which it counts as frequent, so that prefixes are chosen anew without it.
CROWDED = 1_000
#: Parity bits that a set has for each of its members, at least.
ODD_BITS = 4
#: Bytes of parity bits that a member of a list has with it; longer ones are folded to them.
LISTED_BYTES = 256


def shingle_set(text: bytes) -> np.ndarray:
    """The sorted distinct 64-bit hashes of the shingles of five words."""
    return np.unique(shingle_hashes(text, WORDS, 9))


def counted_shingles(docs: DataFrame) -> DataFrame:
    """``h, n``: shingles that occur more than twice in some batch, with those occurrences added up."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_set(t) for t in texts_of(batch.column(0))]
            found, many = np.unique(np.concatenate(sets), return_counts=True) if sets else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(found[many > 2].view(np.int64)), pa.array(many[many > 2])], ["h", "n"])

    return docs.select("text").mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def frequent_shingles(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Sorted hashes of frequent shingles (of ``h, n``) and the rank of each, the most frequent last; at most ``FREQUENT``.

    They are taken by levels of frequency (four to a doubling), the highest first, as long as whole levels fit.
    """
    counts = counts.withColumn("level", F.floor(F.log2("n") * 4).cast("int"))
    total, least = 0, None
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("many")).collect(), reverse=True):
        total += r.many
        if total > FREQUENT:
            break
        least = r.level
    if least is None:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    top = counts.where(F.col("level") >= least).select("n", "h").toArrow()
    n, h = top["n"].to_numpy(), top["h"].to_numpy()
    h = h[np.lexsort((h, n))].view(np.uint64)
    order = np.argsort(h)
    return h[order], (order + 1).astype(np.int64)


def prefix(hashes: np.ndarray, frequent: np.ndarray, rank: np.ndarray, similarity: float) -> np.ndarray:
    """The first hashes in an order common to all sets (rare ones first) that a set must share one of with a similar one.

    A set at ``similarity`` or more shares at least that part of these n hashes, so it can't miss all of the first
    n - ceil(similarity * n) + 1, and the first one that both hold is among the first ones of both.
    """
    n = len(hashes)
    most = n - int(np.ceil(similarity * n - 1e-9)) + 1 if n else 0
    place = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, hashes), len(frequent) - 1)
        place = np.where(frequent[at] == hashes, rank[at], 0)
    return hashes[np.argsort(place, kind="stable")[:most]]


def node_of(text: bytes) -> int:
    """A hash of the word sequence, equal for copies."""
    return xxhash.xxh64_intdigest(b" ".join(text.lower().split()), 5)


def parity(hashes: np.ndarray) -> np.ndarray:
    """256 bits as four words: whether the hashes that fall on each are odd in number.

    Two sets' bits differ in no more places than the sets differ in members.
    """
    return np.packbits(np.bincount((hashes >> np.uint64(56)).astype(np.int64), minlength=256) & 1).astype(np.uint8).view(np.int64)


def odd_bits(hashes: np.ndarray) -> bytes:
    """Parity bits as of ``parity``, a power of two of them that is ODD_BITS for each member or more; by the hashes' lowest bits."""
    size = max(64, 1 << (ODD_BITS * len(hashes) - 1).bit_length()) if len(hashes) else 64
    return np.packbits(np.bincount((hashes & np.uint64(size - 1)).astype(np.int64), minlength=size).astype(np.uint8) & 1, bitorder="little").tobytes()


def differ(a: bytes, b: bytes) -> int:
    """In how many parity bits two sets differ, never more than in members: the longer ones are folded to the shorter's length."""
    x, y = (np.frombuffer(v, np.uint64) for v in (a, b))
    while len(x) != len(y):
        if len(x) < len(y):
            x, y = y, x
        half = len(x) // 2
        x = x[:half] ^ x[half:]
    return int(np.bitwise_count(x ^ y).sum())


def shapes(docs: DataFrame, similarity: float, shingles: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """``SHAPES`` of every row: its node, the SimHash and number of its shingles, the prefix and the long parity bits (none if its task
    gave the node's before) and the short ones. ``shingles`` are the frequent ones, which stand last in the order of prefixes."""
    frequent = docs.sparkSession.sparkContext.broadcast(shingles)  # at most FREQUENT

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            nodes, prints, many, keys, bits, odd = [], [], [], [], [], []
            for t in texts_of(batch.column(2)):
                nodes.append(node_of(t))
                hashes = shingle_set(t)
                prints.append(fingerprint(hashes))
                many.append(len(hashes))
                told = nodes[-1] in seen
                keys.append(prefix(hashes[:0] if told else hashes, *frequent.value, similarity).view(np.int64))
                odd.append(None if told else odd_bits(hashes))
                if len(seen) < REMEMBERED:
                    seen.add(nodes[-1])
                bits.append(parity(hashes))
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            keys = pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, np.int64), *keys])))
            bits = np.array(bits, np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *(pa.array(np.array(x, np.uint64).view(np.int64)) for x in (nodes, prints)), pa.array(many, pa.int32()), keys, *(pa.array(bits[:, i].copy()) for i in range(4)), pa.array(odd, pa.binary())],
                ["row", "doc_id", "node", "fp", "n", "keys", "b0", "b1", "b2", "b3", "odd"],
            )

    return docs.select("row", "doc_id", "text").mapInArrow(run, SHAPES)


def possible(n: np.ndarray, bits: np.ndarray, i: int, j: np.ndarray, similarity: float) -> np.ndarray:
    """Whether sets i and each j can be at ``similarity``, by their sizes and parity bits; never false for a pair that is."""
    most = (n[i] + n[j]) * ((1 - similarity) / (1 + similarity)) + 1e-6  # members that they may differ in
    return (np.abs(n[i] - n[j]) <= most) & (np.bitwise_count(bits[j] ^ bits[i]).sum(axis=1) <= most)


def folded(odd: bytes) -> bytes:
    """Parity bits as of ``odd_bits``, folded to ``LISTED_BYTES``."""
    x = np.frombuffer(odd, np.uint64)
    while x.nbytes > LISTED_BYTES:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x.tobytes()


def listed_nodes(nodes: DataFrame) -> DataFrame:
    """``node, n, b0, b1, b2, b3, odd`` of ``nodes``, the long parity bits folded to ``LISTED_BYTES``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            odd = pa.array([folded(x) for x in batch.column(6).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[:6], odd], batch.schema.names)

    return nodes.select("node", "n", "b0", "b1", "b2", "b3", "odd").mapInArrow(run, "node long, n int, b0 long, b1 long, b2 long, b3 long, odd binary")


def alike(odd: np.ndarray, words: int, i: int, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Whether the first ``words`` parity words of set i differ from those of each j, folded to as many, in ``most`` bits or fewer."""
    other = np.bitwise_xor.reduce(odd[j].reshape(len(j), odd.shape[1] // words, words), axis=1)
    return np.bitwise_count(other ^ odd[i, :words]).sum(axis=1) <= most


def proposals(lists: DataFrame, similarity: float, every: bool) -> DataFrame:
    """``x, y``: pairs of each list's members of different labels that sizes and parity bits leave possible: all, or a forest.

    The pairs that are ruled out never leave the list. A forest has at most one pair less than the list has labels: of
    those to a label only the first, and what it would connect counts as connected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(0)
            ends, flat = lists.offsets.to_numpy(), lists.values
            node, label, n = (flat.field(f).to_numpy() for f in ("node", "label", "n"))
            bits = np.stack([flat.field(f"b{i}").to_numpy() for i in range(4)], axis=1).view(np.uint64)
            for s, e in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
                order = s + np.lexsort((node[s:e], n[s:e]))
                of, own, size, short, at = node[order], label[order], n[order], bits[order], np.arange(e - s)
                data = flat.field("odd").take(pa.array(order)).to_pylist()
                odd = np.frombuffer(b"".join(x.ljust(LISTED_BYTES, b"\0") for x in data), np.uint64).reshape(e - s, -1)
                x, y = [], []
                for i in range(e - s - 1):
                    later = at[i + 1 :]
                    later = later[own[later] != own[i]]
                    later = later[possible(size, short, i, later, similarity)]
                    if len(later):  # sets are in order of size, so that none of the later ones has fewer bits
                        most = (size[i] + size[later]) * ((1 - similarity) / (1 + similarity)) + 1e-6
                        later = later[alike(odd, len(data[i]) // 8, i, later, most)]
                    if len(later) and not every:
                        labels, first = np.unique(own[later], return_index=True)
                        later = later[first]
                        own[np.isin(own, labels)] = own[i]
                    x.append(np.full(len(later), of[i]))
                    y.append(of[later])
                    if sum(map(len, x)) > 100_000 or i == e - s - 2:
                        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)), pa.array(np.concatenate(y))], ["x", "y"])
                        x, y = [], []

    return lists.mapInArrow(run, "x long, y long").select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def fingerprint_pairs(nodes: DataFrame, similarity: float) -> DataFrame:
    """``x, y``: pairs of ``nodes`` whose fingerprints the Golay keys link, where sizes and parity bits leave it possible.

    Of the nodes of one fingerprint the smallest stands for it; it is paired with the others.
    """
    classes = checkpointed(nodes.groupBy("fp").agg(F.min("node").alias("first")))
    links = fingerprint_links(classes, classes.count())
    of = lambda c, n: classes.select(F.col("fp").alias(c), F.col("first").alias(n))
    across = links.join(of("a", "x"), "a").join(of("b", "y"), "b").select("x", "y")
    within = nodes.join(classes, "fp").where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    pairs = across.union(within).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()
    side = lambda p: nodes.select(F.col("node").alias(p), *[F.col(c).alias(p + c) for c in ("n", "b0", "b1", "b2", "b3")])
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    most = (F.col("xn") + F.col("yn")) * F.lit((1 - similarity) / (1 + similarity)) + F.lit(1e-6)
    differ = sum((F.bit_count(F.col(f"x{b}").bitwiseXOR(F.col(f"y{b}"))) for b in ("b1", "b2", "b3")), F.bit_count(F.col("xb0").bitwiseXOR(F.col("yb0"))))
    return both.where((F.abs(F.col("xn") - F.col("yn")) <= most) & (differ <= most)).select("x", "y")


def filter_of(rows: DataFrame) -> np.ndarray:
    """``FILTER_BITS`` bits, among them those that the ``row``s hash to."""
    at = F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS))
    words = rows.select(at.alias("at")).selectExpr("cast(at div 32 as int) as word", "shiftleft(1L, cast(at % 32 as int)) as bit")
    bits = np.zeros(FILTER_BITS // 32, np.int64)
    found = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most FILTER_BITS / 32 rows of 12 bytes
    bits[found["word"].to_numpy()] = found["bits"].to_numpy()
    return bits


def likely(pairs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` that the long parity bits leave possible: all at ``similarity`` or more, and few below it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            most = (batch.column(2).to_numpy() + batch.column(3).to_numpy()) * ((1 - similarity) / (1 + similarity)) + 1e-6
            good = [differ(a.as_py(), b.as_py()) <= m for a, b, m in zip(batch.column(4), batch.column(5), most.tolist(), strict=True)]
            yield batch.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    side = lambda p: nodes.select(F.col("node").alias(p), F.col("n").cast("long").alias(f"n{p}"), F.col("odd").alias(f"o{p}"))
    return pairs.join(side("x"), "x").join(side("y"), "y").select("x", "y", "nx", "ny", "ox", "oy").mapInArrow(run, "x long, y long")


def verified(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, similarity: float) -> DataFrame:
    """Those of ``pairs`` whose whole shingle sets are at ``similarity`` or more.

    Pairs that the parity bits rule out go first. Texts that are in no pair are left out before any is shuffled; the few
    that the filter lets pass meet no pair.
    """
    pairs = checkpointed(likely(pairs, nodes, similarity))
    asked = pairs.select(F.explode(F.array("x", "y")).alias("node")).distinct()
    wanted = docs.sparkSession.sparkContext.broadcast(filter_of(nodes.join(asked, "node", "left_semi").select("row")))

    def named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.column(0).to_numpy()
            batch = batch.filter(pa.array(wanted.value[at // 32] >> (at % 32) & 1 == 1))
            yield pa.RecordBatch.from_arrays([pa.array(np.array([node_of(t) for t in texts_of(batch.column(1))], np.uint64).view(np.int64)), batch.column(1)], ["node", "text"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good, last, y = [], None, None
            for a, b in zip(batch.column(2), batch.column(3), strict=True):
                x = shingle_set(a.as_py().encode())
                if last != (last := b.as_py()):
                    y = shingle_set(last.encode())
                both = len(np.intersect1d(x, y, assume_unique=True))
                good.append(both >= similarity * (len(x) + len(y) - both))
            yield batch.select(["x", "y"]).filter(pa.array(good, pa.bool_()))

    held = docs.where("text is not null").select(F.pmod(F.xxhash64("row"), F.lit(FILTER_BITS)).alias("at"), "text").mapInArrow(named, "node long, text string")
    x = held.select(F.col("node").alias("x"), F.col("text").alias("tx"))
    y = held.select(F.col("node").alias("y"), F.col("text").alias("ty"))
    return checkpointed(pairs.join(x, "x").join(y, "y").select("x", "y", "tx", "ty").mapInArrow(verify, "x long, y long"))


def similar_rows(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``row, doc_id, label``: groups of the rows of ``docs`` (``row, doc_id, text``; row tells rows apart).

    Rows are linked if their sets of shingles of five words have a Jaccard similarity of ``similarity`` or more; label
    is the same in all that chains of links connect. Copies (equal words, A-Z lower-cased) are one node from the start.
    First the pairs that the Golay keys of the SimHashes propose are verified, on whole sets. Not every pair at 0.8 is
    within their three bits, but similar sets share a shingle of their prefixes, so the lists of nodes by such a
    shingle hold every link: of each list that the links so far leave apart, a forest is verified, then all pairs
    that are still apart. Only pairs that sizes or parity bits rule out are spared. Frequent shingles stand last in the order
    of prefixes, so that lists are short: those that a batch shows to be, and those that many rows' prefixes turn out to hold.
    """
    counts = checkpointed(counted_shingles(docs))
    rows = checkpointed(shapes(docs, similarity, frequent_shingles(counts)))
    # what no batch shows to be frequent is, if many rows' prefixes hold it; these counts are of all rows
    held = rows.select(F.explode("keys").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") > CROWDED)
    crowded = checkpointed(held.join(counts.select("h"), "h", "left_anti"))
    if not crowded.isEmpty():
        rows = checkpointed(shapes(docs, similarity, frequent_shingles(checkpointed(counts.union(crowded)))))
    columns = ["n", "b0", "b1", "b2", "b3"]
    entries = rows.select(F.explode("keys").alias("key"), "node").repartition("key")
    lists = entries.groupBy("key").agg(F.sort_array(F.collect_set("node")).alias("members")).where(F.size("members") > 1)
    lists = checkpointed(lists.groupBy("members").agg(F.min("key").alias("list")))
    members = lists.select("list", F.explode("members").alias("node"))
    nodes = rows.groupBy("node").agg(F.min("row").alias("row"), *[F.min(c).alias(c) for c in ("fp", *columns, "odd")])
    slim = checkpointed(nodes.join(members.select("node").distinct(), "node", "left_semi"))
    members = checkpointed(members.join(listed_nodes(slim), "node").select("list", "node", *columns, "odd"))
    tried = checkpointed(fingerprint_pairs(slim, similarity))
    links = verified(tried, docs, slim, similarity)

    def listed(labelled: DataFrame) -> DataFrame:
        apart = F.min("label") < F.max("label")
        whole = labelled.groupBy("list").agg(F.collect_list(F.struct("node", "label", *columns, "odd")).alias("members"), apart.alias("apart"))
        return whole.where("apart").select("members")

    for every in (False, True):
        comp = checkpointed(components(links, "x", "y"))
        labelled = members.join(comp, "node", "left").withColumn("label", F.coalesce("label", "node"))
        pairs = checkpointed(proposals(listed(labelled), similarity, every).join(tried, ["x", "y"], "left_anti"))
        links = checkpointed(links.union(verified(pairs, docs, slim, similarity)))
        tried = tried.union(pairs)
    comp = components(links, "x", "y")
    return rows.join(comp, "node", "left").select("row", "doc_id", F.coalesce("label", "node").alias("label"))


def similar_documents(docs: DataFrame, similarity: float = SIMILARITY, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, component_id``: the groups of similar_rows, by the smallest doc_id of each.

    Null and empty texts are copies of each other. Rows may repeat or lack a doc_id (a null is never the smallest
    unless alone); an empty table gives none.
    """
    rows = checkpointed(similar_rows(numbered(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))), similarity))
    least = rows.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    return rows.join(least, "label").select("doc_id", "component_id")


def op8_simhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract digest of near_duplicates over all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return near_duplicates(docs).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id", "n_links")
