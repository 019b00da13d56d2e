"""Fill-in-the-middle transformation of texts, a whole batch at a time on the UTF-8 bytes of its Arrow buffer.

A table gives each byte its class; a token begins where a letter does not follow a letter of the same document, or at
any other character's first byte. Cumulative sums of the beginnings, less their value where a document begins, number
the tokens; the cuts of all rows are found by one searchsorted. Only the joining of a row's pieces is done row by row.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Classes of bytes: a letter, the first byte of any other character, a byte that continues one.
LETTER, OTHER, CONTINUES = 0, 1, 2
CLASSES = np.full(256, OTHER, np.uint8)
CLASSES[0x80:0xC0] = CONTINUES
CLASSES[ord("A") : ord("Z") + 1] = CLASSES[ord("a") : ord("z") + 1] = LETTER
#: Texts stay plain from this hundredth on; of the others, those below the second are in the order suffix, prefix, middle.
PLAIN_FROM, SPM_BELOW = 90, 20
SEED = "1"
#: Bytes that are transformed at once; a longer text is a batch of its own.
BATCH_BYTES = 8 << 20
PLAIN, PSM, SPM = "plain", "psm", "spm"


def draws(ids: list[int | None], seed: str = SEED) -> np.ndarray:
    """Four numbers below 2 to the 32 for each id (null as nothing behind the colon): the start of a sha256."""
    joined = b"".join(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).digest()[:16] for i in ids)
    return np.frombuffer(joined, ">u4").reshape(-1, 4).astype(np.int64)


def holds_marker(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Whether each document's bytes hold one of the three markers."""
    found = np.zeros(len(begins), bool)
    if len(data) > 2:
        letter = data[1:-1]
        at = np.flatnonzero((data[:-2] == ord("<")) & (data[2:] == ord(">")) & ((letter == ord("P")) | (letter == ord("S")) | (letter == ord("M"))))
        row = np.searchsorted(begins, at, "right") - 1  # the last document that begins there, which is not an empty one
        found[row[at + 3 <= ends[row]]] = True
    return found


def cuts(data: np.ndarray, begins: np.ndarray, ends: np.ndarray, drawn: np.ndarray) -> tuple[np.ndarray, ...]:
    """For each document the number of its tokens, the bytes where its prefix and its middle end, and the code points of both."""
    kind = CLASSES[data]
    edge = np.ones(len(data) + 1, bool)  # where a letter begins a token
    edge[1:-1] = kind[:-1] != LETTER
    edge[begins] = True
    starts = (kind == OTHER) | ((kind == LETTER) & edge[:-1])
    number = np.zeros(len(data) + 1, np.int64 if len(data) >= 1 << 31 else np.int32)  # tokens that begin before a byte
    np.cumsum(starts, out=number[1:])
    n = (number[ends] - number[begins]).astype(np.int64)
    one, two = drawn[:, 0] % (n + 1), drawn[:, 1] % (n + 1)
    wanted = np.concatenate([np.minimum(one, two), np.maximum(one, two)])
    base, last = np.tile(number[begins], 2), np.tile(ends, 2)
    # a cut after w tokens is where token w + 1 begins, or at the document's end
    cut = np.where(wanted == np.tile(n, 2), last, np.searchsorted(number, (base + wanted + 1).astype(number.dtype), "left") - 1)
    first, second = cut[: len(begins)], cut[len(begins) :]
    points = np.zeros_like(number)
    np.cumsum(kind != CONTINUES, out=points[1:])
    return n, first, second, points[first] - points[begins], points[second] - points[first]


def transformed(texts: pa.Array, ids: list[int | None], seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> pa.RecordBatch:
    """``n, form, prefix_chars, middle_chars, output`` of a string array, null as empty."""
    texts = texts.fill_null("").cast(pa.large_binary())
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    held = texts.buffers()[2]
    raw = memoryview(held)[offsets[0] : offsets[-1]] if held is not None else memoryview(b"")
    data, begins, ends = np.frombuffer(raw, np.uint8), offsets[:-1] - offsets[0], offsets[1:] - offsets[0]
    drawn = draws(ids, seed)
    n, first, second, prefix_chars, middle_chars = cuts(data, begins, ends, drawn)
    plain = (begins == ends) | (drawn[:, 2] % 100 >= plain_from) | holds_marker(data, begins, ends)
    spm = drawn[:, 3] % 100 < spm_below
    p, s, m = (x.encode() for x in (PREFIX, SUFFIX, MIDDLE))
    pieces = zip(plain.tolist(), spm.tolist(), begins.tolist(), first.tolist(), second.tolist(), ends.tolist(), strict=True)
    whole = [bytes(raw[a:d]) if as_is else b"".join((s, raw[c:d], p, raw[a:b], m, raw[b:c]) if turned else (p, raw[a:b], s, raw[c:d], m, raw[b:c])) for as_is, turned, a, b, c, d in pieces]
    form = np.where(plain, PLAIN, np.where(spm, SPM, PSM))
    return pa.RecordBatch.from_arrays(
        [pa.array(n), pa.array(form.tolist(), pa.string()), pa.array(prefix_chars.astype(np.int64), mask=plain), pa.array(middle_chars.astype(np.int64), mask=plain), pa.array(whole, pa.binary()).cast(pa.string())],
        ["n", "form", "prefix_chars", "middle_chars", "output"],
    )


def fill_in_middle(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", seed: str = SEED, plain_from: int = PLAIN_FROM, spm_below: int = SPM_BELOW) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output``: a row for each row of ``docs``.

    The cuts follow from the doc_id, so rows that repeat an id and a text come out alike. Null texts count as empty and
    stay plain, as do texts that hold a marker; a null doc_id is drawn for like any other. Texts are taken whole, however
    long. Other columns are neither read nor returned; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = batch.column(1).cast(pa.large_binary()).fill_null(b"")
            lengths = np.diff(np.frombuffer(sizes.buffers()[1], np.int64, len(sizes) + 1, 8 * sizes.offset))
            for lo, hi in by_size([range(x) for x in lengths.tolist()], BATCH_BYTES):
                some = batch.slice(lo, hi - lo)
                made = transformed(some.column(1), some.column(0).to_pylist(), seed, plain_from, spm_below)
                yield pa.RecordBatch.from_arrays([some.column(0), *made.columns], ["doc_id", *made.schema.names])

    slim = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    return slim.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: each marker stands in it once, so it can be cut there."""
    before, behind = lambda x, mark: F.substring_index(x, mark, 1), lambda x, mark: F.substring_index(x, mark, -1)
    inner = lambda x, mark: x.substr(F.lit(len(mark) + 1), F.length(x))
    psm = F.concat(inner(before(output, SUFFIX), PREFIX), behind(output, MIDDLE), before(behind(output, SUFFIX), MIDDLE))
    spm = F.concat(before(behind(output, PREFIX), MIDDLE), behind(output, MIDDLE), inner(before(output, PREFIX), SUFFIX))
    return F.when(form == PSM, psm).when(form == SPM, spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    """Contract digest of fill_in_middle over all documents."""
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    digest = lambda x: F.sha2(x.cast("binary"), 256)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


ORACLE = """
with d as (select doc_id, coalesce(text, '') as text, sha256('1:' || coalesce(cast(doc_id as varchar), '')) as h from documents),
t as (
  select *, regexp_extract_all(text, '[A-Za-z]+|[^A-Za-z]') as units, cast('0x' || substr(h, 1, 8) as bigint) as h1, cast('0x' || substr(h, 9, 8) as bigint) as h2,
    cast('0x' || substr(h, 17, 8) as bigint) as h3, cast('0x' || substr(h, 25, 8) as bigint) as h4 from d
), c as (
  select doc_id, text, units, cast(len(units) as bigint) as n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) as a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) as b,
    case when text = '' or regexp_matches(text, '<[PSM]>') or h3 % 100 >= 90 then 'plain' when h4 % 100 < 20 then 'spm' else 'psm' end as form from t
), p as (
  select doc_id, text, n, form, array_to_string(units[1:a], '') as prefix, array_to_string(units[a + 1:b], '') as middle, array_to_string(units[b + 1:], '') as suffix from c
)
select doc_id, n, form, case when form <> 'plain' then cast(length(prefix) as bigint) end as prefix_chars, case when form <> 'plain' then cast(length(middle) as bigint) end as middle_chars,
  sha256(case form when 'plain' then text when 'psm' then '<P>' || prefix || '<S>' || suffix || '<M>' || middle else '<S>' || suffix || '<P>' || prefix || '<M>' || middle end) as output_sha256,
  sha256(text) as restored_sha256
from p
"""
