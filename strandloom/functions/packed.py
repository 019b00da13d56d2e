"""K-mers of any length as numbers: two bits a base, 31 bases to a word, as Catalyst expressions only.

A packed k-mer is a bigint for k up to 31, and a struct of bigints ``w0, w1, ...`` for more: each word but the last holds
31 bases, the last one the rest, and all are right-aligned. Words are never negative, so keys are ordered like strings.
Nothing here goes through strings but ``pack`` and ``unpack``.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

BASES = "ACGT"
#: Bases in a word, and in a step of a table.
WORD, STEP = 31, 4


def sizes(k: int) -> list[int]:
    """How many bases each word of a k-mer holds."""
    return [min(WORD, k - at) for at in range(0, k, WORD)]


def words(key: Column, k: int) -> list[Column]:
    return [key] if k <= WORD else [key[f"w{j}"] for j in range(len(sizes(k)))]


def key_of(parts: list[Column]) -> Column:
    return parts[0] if len(parts) == 1 else F.struct(*[w.alias(f"w{j}") for j, w in enumerate(parts)])


def key_type(k: int) -> str:
    return "bigint" if k <= WORD else f"struct<{','.join(f'w{j}:bigint' for j in range(len(sizes(k))))}>"


def is_packed(df: DataFrame, column: str = "kmer") -> bool:
    return not isinstance(df.schema[column].dataType, StringType)


def _left(x: Column, n: int | Column) -> Column:
    return F.call_function("shiftleft", x, F.lit(n) if isinstance(n, int) else n)


def _right(x: Column, n: int | Column) -> Column:
    return F.call_function("shiftrightunsigned", x, F.lit(n) if isinstance(n, int) else n)


def _low(x: Column, n: int) -> Column:
    """The last n bases."""
    return x.bitwiseAND(F.lit((1 << 2 * n) - 1).cast("bigint"))


def digits(seq: Column) -> Column:
    return F.translate(seq, BASES, "0123")


def number(some: Column) -> Column:
    """Up to 31 digits in base 4 as a number."""
    return F.conv(some, 4, 10).cast("bigint")


def pack(kmer: Column, k: int) -> Column:
    """A string's key (S-02)."""
    d, at, parts = digits(kmer), 1, []
    for n in sizes(k):
        parts.append(number(F.substring(d, at, n)))
        at += n
    return key_of(parts)


def _table(values: list[str]) -> Column:
    return F.expr(f"array({', '.join(values)})")


def unpack(key: Column, k: int) -> Column:
    """A key's string (S-02), four bases at a time from a table of all 256."""
    table = _table([f"'{''.join(p)}'" for p in product(BASES, repeat=STEP)])
    pieces = []
    for w, n in zip(words(key, k), sizes(k), strict=True):
        for at in range(0, n, STEP):
            left = n - at - STEP  # bases behind these four
            some = _right(w, 2 * left) if left >= 0 else _left(w, -2 * left)
            piece = F.get(table, some.bitwiseAND(F.lit(255).cast("bigint")).cast("int"))
            pieces.append(piece if left >= 0 else F.substring(piece, 1, STEP + left))
    return F.concat(*pieces)


def window(key: Column, k: int, at: int, n: int) -> Column:
    """The n (up to 31) bases of a k-mer from place ``at``, counted from 0, as a number (S-05)."""
    parts, sized = words(key, k), sizes(k)
    j, s = divmod(at, WORD)
    if s + n <= sized[j]:
        return _low(_right(parts[j], 2 * (sized[j] - s - n)), n)
    head = sized[j] - s
    tail = n - head
    return _left(_low(parts[j], head), 2 * tail).bitwiseOR(_right(parts[j + 1], 2 * (sized[j + 1] - tail)))


def _turned(values: list[int]) -> int:
    x = 0
    for v in reversed(values):
        x = x << 2 | 3 - v
    return x


def reverse_complement(key: Column, k: int) -> Column:
    """S-01 on bits: a table turns four bases and complements them, and the pieces change places."""
    table = _table([f"{_turned(list(p))}L" for p in product(range(4), repeat=STEP)])
    parts, end = [], k
    for n in sizes(k):
        x = window(key, k, end - n, n)
        end -= n
        turned = F.lit(0).cast("bigint")
        for at in range(0, n, STEP):  # bases at + 1 to at + STEP from the right come to stand at the left
            piece = F.get(table, _right(x, 2 * at).bitwiseAND(F.lit(255).cast("bigint")).cast("int"))
            left = n - at - STEP
            turned = turned.bitwiseOR(_left(piece, 2 * left) if left >= 0 else _right(piece, -2 * left))
        parts.append(turned)
    return key_of(parts)


def shift_append(key: Column, code: Column, k: int) -> Column:
    """The next k-mer: first base dropped, one appended (S-04). ``code`` is 0 to 3."""
    parts, sized, out = words(key, k), sizes(k), []
    for j, n in enumerate(sized):
        follows = code.cast("bigint") if j == len(sized) - 1 else _right(parts[j + 1], 2 * (sized[j + 1] - 1))
        out.append(_left(_low(parts[j], n - 1), 2).bitwiseOR(follows))
    return key_of(out)


def prepend(key: Column, code: Column, k: int) -> Column:
    """The k-mer before: last base dropped, one put in front."""
    parts, sized, out = words(key, k), sizes(k), []
    for j, n in enumerate(sized):
        before = code.cast("bigint") if j == 0 else _low(parts[j - 1], 1)
        out.append(_left(before, 2 * (n - 1)).bitwiseOR(_right(parts[j], 2)))
    return key_of(out)


def first_code(key: Column, k: int) -> Column:
    return _right(words(key, k)[0], 2 * (sizes(k)[0] - 1)).cast("int")


def not_above(a: Column, b: Column, k: int) -> Column:
    """Whether one key is not above another (S-09)."""
    pairs = list(zip(words(a, k), words(b, k), strict=True))
    result = pairs[-1][0] <= pairs[-1][1]
    for x, y in reversed(pairs[:-1]):
        result = (x < y) | ((x == y) & result)
    return result


def minimizer(key: Column, turned: Column, k: int, p: int) -> Column:
    """The smallest p-mer (p up to 31) of both strands as a number (S-07)."""
    if not 0 < p <= min(k, WORD):
        raise ValueError(f"p must be between 1 and {min(k, WORD)}, not {p}")
    places = [window(x, k, i, p) for x in (key, turned) for i in range(k - p + 1)]
    return F.least(*places) if len(places) > 1 else places[0]


def partition_id(pmer: Column, p: int, n: int) -> Column:
    """Partition of a p-mer's number: its bases from last to first as digits, in base 3, modulo n (S-06)."""
    table = _table([f"{sum(d * 3**i for i, d in enumerate(t))}L" for t in product(range(4), repeat=STEP)])
    total = F.lit(0).cast("bigint")
    for at in range(0, p, STEP):
        left = p - at - STEP
        some = _right(pmer, 2 * left) if left >= 0 else _left(pmer, -2 * left)
        total = total + F.get(table, some.bitwiseAND(F.lit(255).cast("bigint")).cast("int")) * F.lit(3**at).cast("bigint")
    return total % n


def base(code: Column) -> Column:
    return F.substring(F.lit(BASES), code.cast("int") + 1, F.lit(1))


def code_of(base_column: Column) -> Column:
    return F.instr(F.lit(BASES), base_column) - 1


def read_words(d: Column, length: Column) -> Column:
    """Words of a read's digits, 31 bases each, the last ones filled up with A: what windows are cut from."""
    return F.transform(F.sequence(F.lit(1), length + WORD, F.lit(WORD)), lambda i: number(F.rpad(d.substr(i, F.lit(WORD)), WORD, "0")))


def read_window(held: Column, at: Column, n: int) -> list[Column]:
    """The words of the n bases of a read's words from place ``at``, counted from 0 (S-03)."""
    a, s = F.floor(at / WORD).cast("int"), (at % WORD).cast("int")
    out = []
    for j, size in enumerate(sizes(n)):
        x = _low(_left(F.get(held, a + j), 2 * s), WORD).bitwiseOR(_right(F.get(held, a + j + 1), F.lit(2 * WORD) - 2 * s))
        out.append(_right(x, 2 * (WORD - size)) if size < WORD else x)
    return out


def packed(df: DataFrame, k: int, *columns: str) -> DataFrame:
    """``df`` with string k-mers in these columns (``kmer`` if none is named) as keys."""
    return df.withColumns({c: pack(F.col(c), k) for c in columns or ("kmer",) if not is_packed(df, c)})


def unpacked(df: DataFrame, k: int, *columns: str) -> DataFrame:
    """The reverse."""
    return df.withColumns({c: unpack(F.col(c), k) for c in columns or ("kmer",) if is_packed(df, c)})
