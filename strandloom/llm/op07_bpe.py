"""Exact BPE encoding and decoding with a minimal acyclic transducer as lexicon.

Frequent words of the corpus are compiled into a minimal acyclic automaton whose transitions carry counts, so that the
path of a word adds up to its rank, and ranks index the word's token ids (the outputs). The automaton is a flat array,
sent to the workers once and memory-mapped there from an unlinked file. Words outside it are merged exactly by rank of
their pairs, in n log n steps. The vocabulary file is public and its path is a parameter.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import mmap
import re
import tempfile
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, checkpointed, strings_of

WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: The same for lower-case ASCII, in less time.
ASCII_WORDS = re.compile(r"'(?:s|t|re|ve|m|ll|d)|[a-z]+|[0-9]|[^ \t\n\r\f\va-z0-9]+")
#: Outside of these ranges, letters, numbers and case depend on the Unicode version; there, the library's own
#: normaliser and splitter are asked.
UNSURE = regex.compile(r"[^\x00-\u0557\u0590-\u082f\u0900-\u0bff\u0e00-\u0e7f\u1e00-\u2064\u20a0-\u20bf\u2190-\u23ff\u2500-\u27bf\u3000-\u9fef\uac00-\ud7a3\uff00-\uffef\U0001f300-\U0001f64f]")
LEXICON_WORDS = 65_536
#: Bytes up to which words are merged side by side, this many at once; longer ones go through a heap.
FEW, TOGETHER = 48, 4096
#: Words a worker remembers beside the lexicon before it forgets them all, and counts before it hands them on.
MEMO_WORDS, COUNTED_WORDS = 20_000, 150_000
#: Characters whose words a worker holds at once, a longer text being held alone, and rows it takes from a batch at once.
CHARS_AT_ONCE, ROWS_AT_ONCE = 400_000, 256


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Lexicon:
    """Words to token ids: a minimal acyclic automaton in one flat array, ranked by counts on its states.

    Layout: int32 [states + 1] first edge of each state; int32 [edges] label, target and words skipped; bytes [states]
    final flags; int32 [words + 1] output offsets; int32 ids.
    """

    @staticmethod
    def compile(words: dict[bytes, list[int]]) -> bytes:
        """Build from sorted words, merging equal suffixes as soon as a branch is finished."""
        edges: list[dict[int, int]] = [{}]
        final = [False]
        register: dict[tuple, int] = {}
        path: list[tuple[int, int, int]] = []
        before = b""

        def fold(down: int) -> None:
            while len(path) > down:
                parent, label, child = path.pop()
                sign = (final[child], tuple(edges[child].items()))
                if (known := register.get(sign)) is not None:
                    edges[parent][label] = known
                else:
                    register[sign] = child

        order = sorted(words)
        for word in order:
            same = next((i for i, (x, y) in enumerate(zip(word, before, strict=False)) if x != y), min(len(word), len(before)))
            fold(same)
            at = path[-1][2] if path else 0
            for label in word[same:]:
                edges.append({})
                final.append(False)
                edges[at][label] = len(edges) - 1
                path.append((at, label, len(edges) - 1))
                at = len(edges) - 1
            final[at] = True
            before = word
        fold(0)
        number, todo = {0: 0}, [0]  # states that are still reached
        for s in todo:
            for t in edges[s].values():
                if t not in number:
                    number[t] = len(number)
                    todo.append(t)
        below: dict[int, int] = {}
        stack = [0]
        while stack:
            s = stack[-1]
            if missing := [t for t in edges[s].values() if t not in below]:
                stack += missing
            else:
                below[s] = final[s] + sum(below[t] for t in edges[s].values())
                stack.pop()
        first, label, target, skip = [0], [], [], []
        for s in todo:
            seen = int(final[s])
            for b, t in sorted(edges[s].items()):
                label.append(b)
                target.append(number[t])
                skip.append(seen)
                seen += below[t]
            first.append(len(label))
        offsets = np.cumsum([0, *(len(words[w]) for w in order)], dtype=np.int32)
        ids = np.array([i for w in order for i in words[w]], np.int32)
        head = np.array([len(todo), len(label), len(order), len(ids)], np.int32)
        return b"".join(np.asarray(x, np.int32).tobytes() for x in (head, first, label, target, skip, [final[s] for s in todo], offsets, ids))

    def __init__(self, packed: bytes):
        with tempfile.TemporaryFile() as f:  # unlinked: the pages go when the worker goes
            f.write(packed)
            f.flush()
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        states, edges, words, ids = np.frombuffer(self.map, np.int32, 4)
        at = 16

        def take(n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(self.map, np.int32, n, at)
            at += 4 * n
            return x

        self.first, label, self.target, self.skip, self.final, self.offsets, self.ids = (take(int(n)) for n in (states + 1, edges, edges, edges, states, words + 1, ids))
        self.keys = np.repeat(np.arange(states, dtype=np.int64), np.diff(self.first)) << 8 | label  # sorted, as labels are

    def ranks(self, words: list[bytes]) -> np.ndarray:
        """The rank of each word, -1 if it is not in the lexicon; all words step through the automaton together."""
        state, rank = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        size = np.fromiter(map(len, words), np.int64, len(words))
        start = np.cumsum(size) - size
        data = np.frombuffer(b"".join(words), np.uint8)
        live = np.arange(len(words))
        for step in range(int(size.max(initial=0))):
            live = live[size[live] > step]
            if not len(live):
                break
            key = state[live] << 8 | data[start[live] + step]
            edge = np.searchsorted(self.keys, key)
            ok = self.keys[np.minimum(edge, len(self.keys) - 1)] == key if len(self.keys) else np.zeros(len(key), bool)
            rank[live[~ok]] = -1
            size[live[~ok]] = -1
            live, edge = live[ok], edge[ok]
            rank[live] += self.skip[edge]
            state[live] = self.target[edge]
        rank[(rank >= 0) & (self.final[state] == 0)] = -1
        return rank

    def outputs(self, rank: int) -> list[int]:
        return self.ids[self.offsets[rank] : self.offsets[rank + 1]].tolist()


class Bpe:
    """A byte-level BPE with word ends, from the content of a tokenizers file."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model = spec.pop("model")
        suffix = model["end_of_word_suffix"] or ""
        vocab = model["vocab"]
        merges = [x if isinstance(x, list) else x.split(" ") for x in model["merges"]]
        #: The pairs of ids that merge, both in one number and sorted, the last rank of each, and the id that each rank gives.
        pairs = np.fromiter((vocab[a] << 32 | vocab[b] for a, b in merges), np.int64, len(merges))
        self.pairs, at = np.unique(pairs[::-1], return_index=True)
        self.pair_ranks = (len(pairs) - 1 - at).astype(np.int32)
        self.merged = np.fromiter((vocab[a + b] for a, b in merges), np.int32, len(merges))
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.names = {i: t for t, i in vocab.items()} | {i: t for t, i in self.added.items()}
        self.split = regex.compile("(" + "|".join(map(regex.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        letters = byte_letters()
        #: The id of each byte within a word and at its end, and the ranks of bytes side by side.
        self.first = np.array([vocab[letters[b]] for b in range(256)], np.int32)
        self.last = np.array([vocab[letters[b] + suffix] for b in range(256)], np.int32)
        self.letter_ranks = self.rank_of(self.first[:, None], self.first)
        self.last_ranks = self.rank_of(self.first[:, None], self.last)
        self.bytes = {c: b for b, c in letters.items()}
        #: The file without its vocabulary, for the library's normaliser and splitter.
        self.spec = json.dumps(spec | {"model": {"type": "BPE", "vocab": {}, "merges": []}, "added_tokens": [], "post_processor": None})

    @cached_property
    def library(self):
        from tokenizers import Tokenizer

        return Tokenizer.from_str(self.spec)

    @cached_property
    def rank(self) -> dict[int, int]:
        """The rank of each pair, for words that are merged by themselves."""
        return dict(zip(self.pairs.tolist(), self.pair_ranks.tolist(), strict=True))

    def words(self, text: str) -> list[str]:
        """The words of a text in order; an added token stands as itself with a NUL before it."""
        if self.split and "<|" in text:
            out: list[str] = []
            for i, part in enumerate(self.split.split(text)):
                out += ["\0" + part] if i % 2 else self.plain_words(part)
            return out
        return self.plain_words(text)

    def plain_words(self, text: str) -> list[str]:
        if text.isascii():
            return ASCII_WORDS.findall(text.lower())
        if UNSURE.search(text):
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(self.bytes[c] for c in piece).decode("utf-8") for piece, _ in pieces]
        return WORDS.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())  # each sigma by itself

    def merge(self, words: list[str]) -> list[list[int]]:
        """The exact ids of each word: the pair of the lowest rank merges first, of equal ones the leftmost.

        Words of about one length are merged together, long ones by themselves.
        """
        data = [w.encode() for w in words]
        out: list[list[int]] = [[self.added[w[1:]]] if w[:1] == "\0" and w[1:] in self.added else [] for w in words]
        order = sorted((i for i in range(len(data)) if not out[i]), key=lambda i: len(data[i]))
        few = next((n for n, i in enumerate(order) if len(data[i]) > FEW), len(order))
        for lo in range(0, few, TOGETHER):
            some = order[lo : min(lo + TOGETHER, few)]
            for i, ids in zip(some, self.merge_together([data[i] for i in some]), strict=True):
                out[i] = ids
        for i in order[few:]:
            out[i] = self.merge_long(data[i])
        return out

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The rank of each pair of ids, the number of ranks if it never merges."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.pair_ranks[at], len(self.merged)).astype(np.int32)

    def merge_together(self, words: list[bytes]) -> list[list[int]]:
        """Merge short words side by side: in each step, every word's pair of the least rank, of equal ones the leftmost."""
        never, n = len(self.merged), len(words)
        size = np.fromiter(map(len, words), np.int64, n)
        wide = int(size.max(initial=0)) + 2  # a column on each side that never merges
        inside = np.arange(wide - 2) < size[:, None]
        ids = np.full((n, wide), -1, np.int32)
        data = np.zeros((n, wide - 2), np.int64)
        data[inside] = np.frombuffer(b"".join(words), np.uint8)
        ids[:, 1:-1][inside] = self.first[data[inside]]
        ids[np.arange(n), size] = self.last[data[np.arange(n), size - 1]]
        ranks = np.full((n, wide), never, np.int32)
        ranks[:, 1:-2] = np.where(inside[:, 1:], self.letter_ranks[data[:, :-1], data[:, 1:]], never)
        two = np.flatnonzero(size > 1)
        ranks[two, size[two] - 1] = self.last_ranks[data[two, size[two] - 2], data[two, size[two] - 1]]
        before, after = np.tile(np.arange(-1, wide - 1), n), np.tile(np.arange(1, wide + 1), n)
        kept = np.zeros((n, wide), bool)
        kept[:, 1:-1] = inside
        flat_ids, flat_ranks, flat_kept = ids.reshape(-1), ranks.reshape(-1), kept.reshape(-1)
        live = np.arange(n)
        while len(live):
            some = ranks[live]
            at = some.argmin(1)
            low = some[np.arange(len(live)), at]
            ok = low < never
            live, at, low = live[ok], at[ok], low[ok]
            row = live * wide
            i, j = row + at, row + after[row + at]
            k = row + after[j]
            flat_ids[i] = self.merged[low]
            flat_kept[j], flat_ranks[j] = False, never
            after[i], before[k] = after[j], at
            flat_ranks[i] = self.rank_of(flat_ids[i], flat_ids[k])
            h = row + before[i]
            flat_ranks[h] = self.rank_of(flat_ids[h], flat_ids[i])
        flat, ends = flat_ids[flat_kept].tolist(), np.cumsum(kept.sum(1)).tolist()
        return [flat[lo:hi] for lo, hi in zip([0, *ends], ends, strict=False)]

    def merge_long(self, word: bytes) -> list[int]:
        """Merge one word through a heap over a linked list, in n log n steps."""
        ids = [*self.first[list(word[:-1])].tolist(), int(self.last[word[-1]])]
        get, n = self.rank.get, len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        gone = [False] * n
        todo = [(r, i) for i, (a, b) in enumerate(zip(ids, ids[1:], strict=False)) if (r := get(a << 32 | b)) is not None]
        heapq.heapify(todo)
        while todo:
            r, i = heapq.heappop(todo)
            j = after[i]
            if gone[i] or j >= n or get(ids[i] << 32 | ids[j]) != r:
                continue  # one of the two has been merged since
            ids[i] = int(self.merged[r])
            gone[j] = True
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := get(ids[x] << 32 | ids[y])) is not None:
                    heapq.heappush(todo, (r, x))
        return [t for t, lost in zip(ids, gone, strict=True) if not lost]


@lru_cache(maxsize=2)
def bpe_of(spec: str) -> Bpe:
    """The BPE of a tokenizers file's content, made once in each worker."""
    return Bpe(spec)


def content(path: str) -> str:
    """What the vocabulary file holds; the driver reads it and sends it along, so only the driver needs the file."""
    with open(path, encoding="utf-8") as f:
        return f.read()


class Encoder:
    """Words to (number of ids, ids as text, decoded text): lexicon first, then exact merges, remembered for a while."""

    def __init__(self, bpe: Bpe, lexicon: Lexicon):
        self.bpe, self.lexicon = bpe, lexicon
        self.memo: dict[str, tuple[int, str, str]] = {}
        self.rare: list[str] = []  # those beside the lexicon, which are forgotten

    def learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.memo]
        if len(self.rare) + len(new) > MEMO_WORDS:
            for w in self.rare:
                del self.memo[w]
            self.rare = []
            new = [w for w in words if w not in self.memo]
        if not new:
            return
        names, rest = self.bpe.names.__getitem__, []
        for w, rank in zip(new, self.lexicon.ranks([w.encode() for w in new]).tolist(), strict=True):
            if rank >= 0:
                ids = self.lexicon.outputs(rank)
                self.memo[w] = (len(ids), " ".join(map(str, ids)), " ".join(map(names, ids)))
            else:
                rest.append(w)
        for w, ids in zip(rest, self.bpe.merge(rest), strict=True):
            self.memo[w] = (len(ids), " ".join(map(str, ids)), " ".join(map(names, ids)))
        self.rare += rest

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """For each text: number of ids, the ids joined by spaces, and their tokens joined by spaces (the decoding)."""
        split = [self.bpe.words(t) for t in texts]
        self.learn(set().union(*split) if split else set())
        for words in split:
            sizes, ids, tokens = zip(*map(self.memo.__getitem__, words), strict=True) if words else ((), (), ())
            yield sum(sizes), " ".join(ids), " ".join(tokens)


def word_counts(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``word, n`` over all words of all texts; counted in each batch before anything is shuffled."""
    spec = docs.sparkSession.sparkContext.broadcast(content(path))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, seen = bpe_of(spec.value), Counter()

        def flush() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], ["word", "n"])
            seen.clear()
            return out

        for batch in batches:
            for lo in range(0, batch.num_rows, ROWS_AT_ONCE):
                for t in strings_of(batch.column(0).slice(lo, ROWS_AT_ONCE)):
                    seen.update(bpe.words(t))
                    if len(seen) > COUNTED_WORDS:
                        yield flush()
        if seen:
            yield flush()

    return docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def lexicon_of(docs: DataFrame, path: str, size: int = LEXICON_WORDS, text: str = "text") -> bytes:
    """The packed lexicon of the most frequent words of all texts, at most ``size``.

    Words are taken by levels of frequency (four to a doubling), the highest first, as long as whole levels fit; if that
    leaves over half of ``size`` free, words of small hash of the next level fill nine tenths of it. So the driver gets
    a short histogram and then no more words than it keeps.
    """
    level, cells = F.floor(F.log2("n") * 4).cast("int"), 1 << 30
    counts = checkpointed(word_counts(docs, path, text).withColumn("level", level))
    total, chosen = 0, F.lit(False)
    for r in sorted(counts.groupBy("level").agg(F.count("*").alias("words")).collect(), reverse=True):
        if total + r.words > size:
            share = int(cells * 0.9 * (size - total) / r.words) if 2 * total < size else 0
            chosen = chosen | ((F.col("level") == r.level) & (F.pmod(F.xxhash64("word"), F.lit(cells)) < share))
            break
        total += r.words
        chosen = chosen | (F.col("level") == r.level)
    bpe = bpe_of(content(path))
    words = [r.word for r in counts.where(chosen).select("word").limit(size).collect()]
    return Lexicon.compile(dict(zip((w.encode() for w in words), bpe.merge(words), strict=True)))


def encode(docs: DataFrame, path: str, fields: Callable[[tuple[int, str, str]], tuple], schema: str, size: int = LEXICON_WORDS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: its id and what ``fields`` makes of (n_tokens, ids, decoded text).

    ``schema`` describes what fields returns. A null or empty text has no tokens; rows may repeat or lack an id; an
    empty table gives an empty result; other columns are not read. The result's columns are ``doc_id`` (by the name given)
    and those of schema; an id column of one of their names is refused.
    """
    if doc_id in [x.split()[0] for x in schema.split(",")]:
        raise ValueError(f"the id column can't be called {doc_id!r}, as a column of the result is")
    sc = docs.sparkSession.sparkContext
    lexicon = sc.broadcast(lexicon_of(docs, path, size, text))  # at most `size` words
    spec = sc.broadcast(content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(bpe_of(spec.value), Lexicon(lexicon.value))
        for whole in batches:
            for at in range(0, whole.num_rows, ROWS_AT_ONCE):
                some = whole.slice(at, ROWS_AT_ONCE)
                texts = strings_of(some.column(1))
                for lo, hi in by_size(texts, CHARS_AT_ONCE):
                    rows = [fields(x) for x in encoder.encode(texts[lo:hi])]
                    yield pa.RecordBatch.from_arrays([some.column(0).slice(lo, hi - lo), *(pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True))], names)

    names = [doc_id, *(x.split()[0] for x in schema.split(","))]
    kinds = [{"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32())}[x.split()[1]] for x in schema.split(",")]
    return docs.select(F.col(doc_id).cast("long").alias(doc_id), F.col(text).cast("string").alias(text)).mapInArrow(run, f"{doc_id} long, {schema}")


def digest(x: tuple[int, str, str]) -> tuple[int, str, str]:
    return x[0], hashlib.sha256(x[1].encode()).hexdigest(), hashlib.sha256(x[2].encode()).hexdigest()


def ids_and_digest(x: tuple[int, str, str]) -> tuple[int, list[int], str, str]:
    return x[0], [int(i) for i in x[1].split()], *digest(x)[1:]


def as_ids(x: tuple[int, str, str]) -> tuple[int, list[int]]:
    return x[0], [int(i) for i in x[1].split()]


def encoded(docs: DataFrame, path: str, **options) -> DataFrame:
    """``doc_id, n_tokens, ids array<int>``: the real output of the operator."""
    return encode(docs, path, as_ids, "n_tokens long, ids array<int>", **options)


def decoded(tokens: DataFrame, path: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """``doc_id, text``: the tokens of each row of ids joined by spaces, as the library decodes without a decoder.

    Null or empty ids give an empty text; an id outside the vocabulary is left out, as the library does.
    """

    spec = tokens.sparkSession.sparkContext.broadcast(content(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = bpe_of(spec.value).names
        for batch in batches:
            text = [" ".join(names[i] for i in row or () if i in names) for row in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(text, pa.string())], ["doc_id", "text"])

    return tokens.select(F.col(doc_id).alias("doc_id"), F.col(ids).alias("ids")).mapInArrow(run, "doc_id long, text string")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op7_bpe_encode(spark, sf_dir: str) -> DataFrame:
    """Contract digest of the encoding of all documents and of its decoding."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode(docs, default_path(), digest, "n_tokens long, ids_sha256 string, decoded_sha256 string")
