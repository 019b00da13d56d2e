"""Removal of repeated word spans through a compacted de Bruijn graph of the corpus.

A window of 13 words is an edge of the graph from its first 12 words to its last 12. Only edges that occur in more than
one document matter. Their non-branching paths are compacted: two edges that follow each other in a document belong to
one segment if the first is followed by nothing else wherever it occurs and the second is preceded by nothing else. So
every occurrence of an edge runs through its whole segment, and a segment needs one row a document where its windows
would need one each. The first document of a segment decides for all; segments are told apart by 128 bits of two hashes,
one of the first window and one of all words, and a segment comes back with its source coordinates, the document and the
word at which it first occurs (``repeated_spans`` returns them, so that spans can be held against their source).

Documents are dealt to chunks by a hash, so that a lost task finds the same chunks again; all steps share them, and each
step joins the chunks with what the step before found for them. Chunks and hash ranges exchange packed arrays of
distinct values, a few bytes a window, and get bits back in the same order. Chunks and ranges grow with the root of the
corpus up to a bound, so that what a chunk sends to a range stays an array. No task holds more than a chunk or a hash
range; a passage adds one entry a chunk to its range, however often it occurs. The texts move once, as Spark reuses
their exchange.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix64, parts, texts_of

WINDOW = 13
#: Bytes of a word taken for granted.
WORD_BYTES = 6
#: Windows that a chunk and a hash range are meant to hold: at least, and at most on a large corpus.
CHUNK_WINDOWS, MOST_CHUNK_WINDOWS = 40_000, 4_000_000
RANGE_WINDOWS, MOST_RANGE_WINDOWS = 1_000_000, 4_000_000
#: Windows that a chunk sends to a range at once, about: as long as it does, messages grow no faster than the corpus.
PACKED_WINDOWS = 1_024
NO_ID = np.int64(2**63 - 1)
START, CONFLICT = 0, 1
#: What tells a neighbour apart among those of one edge: the other bits of its hash are not sent.
SHORT_BYTES, SHORT = 6, np.uint64((1 << 48) - 1)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
REPEATED, BREAKS, FIRSTS = 0, 1, 2
PACKED = "part int, chunk long, keys binary, extra binary"
ANSWER = "chunk long, kind int, part int, found binary"


class Chunk:
    """The windows of a chunk's documents: hashes, their documents and words."""

    def __init__(self, texts: list[bytes], size: int):
        self.texts = texts
        data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        word = ~_SPACE[data]
        turn = np.flatnonzero(word[1:] != word[:-1]) + 1
        if len(word) and word[0]:
            turn = np.r_[0, turn]
        first, last = turn[::2], turn[1::2]  # the text ends with a space
        length = last - first
        doc_start = np.cumsum([0, *(len(t) + 1 for t in texts)])
        self.doc = np.searchsorted(doc_start, first, side="right") - 1
        n = len(first)
        if n:
            inside = np.arange(int(length.sum())) - np.repeat(np.cumsum(length) - length, length)
            weight = mix64(np.arange(1, int(length.max()) + 1, dtype=np.uint64)) | np.uint64(1)
            terms = (data[word].astype(np.uint64) + np.uint64(1)) * weight[inside]
            self.words = mix64(np.add.reduceat(terms, np.cumsum(length) - length) ^ length.astype(np.uint64))
        else:
            self.words = np.zeros(0, np.uint64)
        self.per_doc = np.bincount(self.doc, minlength=len(texts))
        self.at = np.flatnonzero(self.doc[: n - size + 1] == self.doc[size - 1 :]) if n >= size else np.zeros(0, np.int64)
        factors = mix64(np.arange(101, 101 + size, dtype=np.uint64)) | np.uint64(1)
        edge = np.zeros(max(0, n - size + 1), np.uint64)
        for j in range(size if n >= size else 0):
            edge += self.words[j : n - size + 1 + j] * factors[j]
        self.edge = np.maximum(mix64(edge[self.at]), 2)  # 0 and 1 have a meaning of their own
        self.size = size

    def word_of(self, at: np.ndarray) -> np.ndarray:
        """The place of words (numbered over the chunk) in their documents, from 0."""
        return at - (np.cumsum(self.per_doc) - self.per_doc)[self.doc[at]]

    def keys(self, ranges: int) -> np.ndarray:
        """Hash range and 32 more bits of each window, as one number."""
        return (self.edge >> np.uint64(32)) % np.uint64(ranges) << np.uint64(32) | self.edge & np.uint64(0xFFFFFFFF)

    def repeated(self, ranges: int, answers: pa.Table) -> None:
        """Keep the windows that are repeated, and link each to those before and after it in its document."""
        keys = self.keys(ranges)
        distinct = np.unique(keys)
        flags = unpack_bits(distinct, ranges, answers, REPEATED, 1)[:, 0]
        marked = distinct[flags]
        place = np.searchsorted(marked, keys)
        kept = np.flatnonzero(marked[np.minimum(place, len(marked) - 1)] == keys) if len(marked) else np.zeros(0, np.int64)
        self.at, self.edge = self.at[kept], self.edge[kept]
        self.joins = (self.at[1:] == self.at[:-1] + 1) & (self.doc[self.at[1:]] == self.doc[self.at[:-1]]) if len(kept) else np.zeros(0, bool)

    def neighbours(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct edges, and 48 bits of what precedes and follows each; CONFLICT if that differs."""
        before, after = np.zeros(len(self.edge), np.uint64), np.zeros(len(self.edge), np.uint64)
        short = (self.edge & SHORT) | np.uint64(2)
        before[1:][self.joins] = short[:-1][self.joins]
        after[:-1][self.joins] = short[1:][self.joins]
        return agreed(self.edge, before, after)

    def segments(self, ranges: int, answers: pa.Table) -> None:
        """First window, number of windows, and both hashes of each segment."""
        distinct = np.unique(self.edge)
        cut = unpack_bits(distinct, ranges, answers, BREAKS, 2, self.edge_ranges(distinct, ranges))[np.searchsorted(distinct, self.edge)] if len(distinct) else np.zeros((0, 2), bool)
        n = len(self.edge)
        begins = np.ones(n, bool)
        if n:
            begins[1:] = ~(self.joins & ~cut[1:, 0] & ~cut[:-1, 1])
        self.seg = np.flatnonzero(begins)
        self.seg_windows = np.diff(np.r_[self.seg, n])
        self.key = self.edge[self.seg]
        words = self.seg_windows + self.size - 1
        total = int(words.sum())
        inside = np.arange(total) - np.repeat(np.cumsum(words) - words, words)
        if n:
            weight = mix64(np.arange(7001, 7001 + int(words.max()), dtype=np.uint64)) | np.uint64(1)
            content = np.add.reduceat(self.words[np.repeat(self.at[self.seg], words) + inside] * weight[inside], np.cumsum(words) - words)
            self.content = mix64(content ^ words.astype(np.uint64))
        else:
            self.content = np.zeros(0, np.uint64)

    @staticmethod
    def edge_ranges(edge: np.ndarray, ranges: int) -> np.ndarray:
        return (mix64(edge) >> np.uint64(20)) % np.uint64(ranges)


def agreed(edge: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(edge, kind="stable")
    edge, before, after = edge[order], before[order], after[order]
    if not len(edge):
        return edge, before, after
    start = np.flatnonzero(np.r_[True, edge[1:] != edge[:-1]])
    one = lambda x: np.where(np.minimum.reduceat(x, start) == np.maximum.reduceat(x, start), x[start], np.uint64(CONFLICT))
    return edge[start], one(before), one(after)


def shorts(x: np.ndarray) -> bytes:
    """The low six bytes of each value."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :SHORT_BYTES]).tobytes()


def from_shorts(b: bytes) -> np.ndarray:
    raw = np.frombuffer(b, np.uint8).reshape(-1, SHORT_BYTES)
    wide = np.zeros((len(raw), 8), np.uint8)
    wide[:, :SHORT_BYTES] = raw
    return wide.view("<u8").ravel()


def by_range(part: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """An order that puts equal ranges together (and keeps the order within), and (range, from, to)."""
    order = np.argsort(part, kind="stable")
    p = part[order]
    cut = np.flatnonzero(np.r_[True, p[1:] != p[:-1]]) if len(p) else np.zeros(0, np.int64)
    return order, [(int(p[s]), int(s), int(e)) for s, e in zip(cut, np.r_[cut[1:], len(p)], strict=True)]


def unpack_bits(distinct: np.ndarray, ranges: int, answers: pa.Table, kind: int, each: int, part: np.ndarray | None = None) -> np.ndarray:
    """[distinct values, each] flags; what no answer came for has none."""
    out = np.zeros((len(distinct), each), bool)
    if part is None:
        part = distinct >> np.uint64(32)
    order, pieces = by_range(part)
    where = {p: (s, e) for p, s, e in pieces}
    for k, p, bits in zip(*(answers.column(c).to_pylist() for c in ("kind", "part", "found")), strict=True):
        if k == kind:
            s, e = where[p]
            flags = np.unpackbits(np.frombuffer(bits, np.uint8), count=(e - s) * each).reshape(-1, each)
            out[order[s:e]] = flags
    return out


def packed(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], names=["part", "chunk", "keys", "extra"])


def answered(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], names=["chunk", "kind", "part", "found"])


def blobs(group: pa.Table, kind: type) -> tuple[list[int], list[np.ndarray], list[bytes]]:
    keys = [np.frombuffer(k, kind) for k in group.column("keys").to_pylist()]
    return group.column("chunk").to_pylist(), keys, group.column("extra").to_pylist()


def repeated_edges(group: pa.Table) -> pa.Table:
    """Which windows of a hash range occur in several chunks, or in several documents of one."""
    part = group.column("part")[0].as_py()
    chunks, keys, extra = blobs(group, np.uint32)
    values, count = np.unique(np.concatenate(keys), return_counts=True)
    several = values[count > 1]
    inner = [k[np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool)] for k, x in zip(keys, extra, strict=True)]
    several = np.union1d(several, np.concatenate(inner))
    rows = []
    for chunk, k in zip(chunks, keys, strict=True):
        place = np.searchsorted(several, k)
        hit = several[np.minimum(place, len(several) - 1)] == k if len(several) else np.zeros(len(k), bool)
        if hit.any():
            rows.append((chunk, REPEATED, part, np.packbits(hit).tobytes()))
    return answered(rows)


def broken_edges(group: pa.Table) -> pa.Table:
    """Before and after which edges of a hash range the graph branches, or a run of repeated edges begins or ends."""
    part = group.column("part")[0].as_py()
    chunks, keys, extra = blobs(group, np.uint64)
    sides = [from_shorts(x).reshape(2, -1) for x in extra]
    edge, before, after = agreed(np.concatenate(keys), np.concatenate([s[0] for s in sides]), np.concatenate([s[1] for s in sides]))
    cut = np.stack([before == CONFLICT, after == CONFLICT], axis=1)
    rows = []
    for chunk, k in zip(chunks, keys, strict=True):
        mine = cut[np.searchsorted(edge, k)]
        if mine.any():
            rows.append((chunk, BREAKS, part, np.packbits(mine.ravel()).tobytes()))
    return answered(rows)


def first_documents(group: pa.Table) -> pa.Table:
    """The smallest document of each segment of a hash range, and the first word there; segments are equal if both hashes are."""
    part = group.column("part")[0].as_py()
    chunks, keys, extra = blobs(group, np.uint64)
    key = np.concatenate(keys)
    rest = [np.frombuffer(x, np.uint64).reshape(3, -1) for x in extra]
    content, doc, word = np.concatenate([r[0] for r in rest]), np.concatenate([r[1] for r in rest]).view(np.int64), np.concatenate([r[2] for r in rest]).view(np.int64)
    order = np.lexsort((word, doc, content, key))
    new = np.ones(len(order), bool)
    new[1:] = (key[order][1:] != key[order][:-1]) | (content[order][1:] != content[order][:-1])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    least = np.empty((2, len(order)), np.int64)
    least[0, order], least[1, order] = doc[first], word[first]
    rows, at = [], 0
    for chunk, k in zip(chunks, keys, strict=True):
        rows.append((chunk, FIRSTS, part, least[:, at : at + len(k)].tobytes()))
        at += len(k)
    return answered(rows)


def distinct_segments(c: Chunk, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (key, content) of a chunk's segments, their smallest ids here and the word there, and the distinct one of each segment."""
    doc, word = ids[c.doc[c.at[c.seg]]], c.word_of(c.at[c.seg])
    order = np.lexsort((word, doc, c.content, c.key))
    new = np.ones(len(order), bool)
    new[1:] = (c.key[order][1:] != c.key[order][:-1]) | (c.content[order][1:] != c.content[order][:-1])
    first = order[new]
    of = np.empty(len(order), np.int64)
    of[order] = np.cumsum(new) - 1
    return c.key[first], c.content[first], doc[first], word[first], of


def dealt(total_bytes: int) -> tuple[int, int]:
    """How many chunks and hash ranges a corpus of so many bytes is dealt to."""
    windows = total_bytes // WORD_BYTES
    root = int(windows**0.5) * int(PACKED_WINDOWS**0.5)
    chunk = min(MOST_CHUNK_WINDOWS, max(CHUNK_WINDOWS, root // 4))
    held = min(MOST_RANGE_WINDOWS, max(RANGE_WINDOWS, root * 4))
    return parts(windows, chunk), parts(windows, held, 32)


def remove_repeats(docs: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text", keep_text: bool = False) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``, the kept words, if asked for): a row for each of docs.

    A word is removed if a window of ``size`` words of its document covers it whose word sequence also starts in a
    document with a smaller doc_id; windows are judged on the input. Words are what \\x20 and \\x09-\\x0D separate,
    unchanged. Null and empty texts have no words, and texts of fewer words no window. Rows that share a doc_id don't
    remove each other's words; a null doc_id is larger than all others. Other columns are not read; an empty table
    gives an empty result.
    """
    return _repeats(docs, size, doc_id, text, "text" if keep_text else "digest")


def repeated_spans(docs: DataFrame, size: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, word, n_words, source_id, source_word``: the segments that remove_repeats removes, with their source.

    ``n_words`` words from ``word`` (from 0) on are those from ``source_word`` on of the document ``source_id``, the
    smallest that has the segment. Segments overlap by ``size - 1`` words.
    """
    return _repeats(docs, size, doc_id, text, "spans")


def _repeats(docs: DataFrame, size: int, doc_id: str, text: str, wanted: str) -> DataFrame:
    if size < 2:
        raise ValueError("a window needs two words at least")
    slim = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").cast("string").alias("text"))
    n_chunks, ranges = dealt(slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0)
    # rows that are equal are told apart by the task that read them, which a rerun does not change
    number = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(n_chunks)).alias("chunk")
    grouped = slim.select(number, "doc_id", "text").groupBy("chunk")

    def loaded(t: pa.Table) -> tuple[Chunk, np.ndarray, int]:
        ids = np.array([NO_ID if i is None else i for i in t.column("doc_id").to_pylist()], np.int64)
        return Chunk(texts_of(t.column("text")), size), ids, t.column("chunk")[0].as_py()

    def emit_windows(t: pa.Table) -> pa.Table:
        c, ids, chunk = loaded(t)
        _, rank = np.unique(ids, return_inverse=True)
        owner = rank.ravel()[c.doc[c.at]].astype(np.uint64) if len(c.at) else np.zeros(0, np.uint64)
        keys = c.keys(ranges)
        order = np.lexsort((owner, keys))
        keys, owner = keys[order], owner[order]
        start = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
        several = np.maximum.reduceat(owner, start) != owner[start] if len(start) else np.zeros(0, bool)
        distinct = keys[start]
        _, pieces = by_range(distinct >> np.uint64(32))
        low = (distinct & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        return packed([(p, chunk, low[s:e].tobytes(), np.packbits(several[s:e]).tobytes()) for p, s, e in pieces])

    def emit_neighbours(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return packed([])
        c, _, chunk = loaded(t)
        c.repeated(ranges, answers)
        edge, before, after = c.neighbours()
        order, pieces = by_range(c.edge_ranges(edge, ranges))
        edge, before, after = edge[order], before[order], after[order]
        return packed([(p, chunk, edge[s:e].tobytes(), shorts(before[s:e]) + shorts(after[s:e])) for p, s, e in pieces])

    def emit_segments(t: pa.Table, answers: pa.Table) -> pa.Table:
        if not t.num_rows or not answers.num_rows:
            return packed([])
        c, ids, chunk = loaded(t)
        c.repeated(ranges, answers)
        c.segments(ranges, answers)
        key, content, doc, word, _ = distinct_segments(c, ids)
        order, pieces = by_range(c.edge_ranges(key, ranges))
        key, rest = key[order], np.stack([content, doc.view(np.uint64), word.view(np.uint64)])[:, order]
        return packed([(p, chunk, key[s:e].tobytes(), rest[:, s:e].tobytes()) for p, s, e in pieces])

    def finish(t: pa.Table, answers: pa.Table) -> pa.Table:
        c, ids, _ = loaded(t)
        gone = np.zeros(len(c.words) + 1, np.int64)
        spans: list[np.ndarray] = [np.zeros(0, np.int64)] * 5
        if answers.num_rows:
            c.repeated(ranges, answers)
            c.segments(ranges, answers)
            key, _, _, _, of = distinct_segments(c, ids)
            order, pieces = by_range(c.edge_ranges(key, ranges))
            where, least, word = {p: (s, e) for p, s, e in pieces}, np.full(len(key), NO_ID), np.zeros(len(key), np.int64)
            for k, p, found in zip(*(answers.column(n).to_pylist() for n in ("kind", "part", "found")), strict=True):
                if k == FIRSTS:
                    s, e = where[p]
                    least[order[s:e]], word[order[s:e]] = np.frombuffer(found, np.int64).reshape(2, -1)
            begin = c.at[c.seg]
            hit = least[of] < ids[c.doc[begin]]
            n_words = c.seg_windows + size - 1
            np.add.at(gone, begin[hit], 1)
            np.add.at(gone, (begin + n_words)[hit], -1)
            spans = [x[hit] for x in (ids[c.doc[begin]], c.word_of(begin), n_words, least[of], word[of])]
        if wanted == "spans":
            own = pa.array(spans[0], mask=spans[0] == NO_ID)
            return pa.table([own, *map(pa.array, spans[1:])], names=names)
        gone = np.cumsum(gone)[:-1] > 0
        out: list[tuple] = []
        at = 0
        for i, text_ in enumerate(c.texts):
            n = int(c.per_doc[i])
            mine = gone[at : at + n]
            at += n
            words = text_.split()
            if mine.any():
                words = [w for w, g in zip(words, mine.tolist(), strict=True) if not g]
            kept = b" ".join(words)
            row = (n, int(mine.sum()), hashlib.sha256(kept).hexdigest())
            out.append((*row, kept.decode()) if wanted == "text" else row)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.table([t.column("doc_id"), *(pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=False))], names=names)

    schema = {
        "spans": "doc_id long, word long, n_words long, source_id long, source_word long",
        "digest": "doc_id long, n_words long, n_removed long, kept_sha256 string",
        "text": "doc_id long, n_words long, n_removed long, kept_sha256 string, kept string",
    }[wanted]
    names = [c.split()[0] for c in schema.split(", ")]
    repeated = grouped.applyInArrow(emit_windows, PACKED).groupBy("part").applyInArrow(repeated_edges, ANSWER)
    breaks = grouped.cogroup(repeated.groupBy("chunk")).applyInArrow(emit_neighbours, PACKED).groupBy("part").applyInArrow(broken_edges, ANSWER)
    known = repeated.union(breaks)
    firsts = grouped.cogroup(known.groupBy("chunk")).applyInArrow(emit_segments, PACKED).groupBy("part").applyInArrow(first_documents, ANSWER)
    return grouped.cogroup(known.union(firsts).groupBy("chunk")).applyInArrow(finish, schema)


def op9_debruijn_span_dedup(spark, sf_dir: str) -> DataFrame:
    """Contract digest of remove_repeats over all documents."""
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: The contract's query in DuckDB, with every window written out.
ORACLE = """
with w as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as ws from documents),
win as (select doc_id, i, array_to_string(ws[i : i + 12], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from w where len(ws) >= 13)),
first as (select k, min(doc_id) as least from win group by k),
hit as (select win.doc_id, win.i from win join first using (k) where least < win.doc_id),
gone as (select distinct doc_id, i + j as p from (select doc_id, i, unnest(range(0, 13)) as j from hit)),
tok as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as p from w),
kept as (select t.doc_id, string_agg(t.word, ' ' order by t.p) filter (where g.p is null) as kept, count(g.p) as n_removed
         from tok t left join gone g on t.doc_id = g.doc_id and t.p = g.p group by t.doc_id)
select w.doc_id, cast(len(ws) as bigint) as n_words, cast(coalesce(n_removed, 0) as bigint) as n_removed, sha256(coalesce(kept, '')) as kept_sha256
from w left join kept on w.doc_id = kept.doc_id
"""
