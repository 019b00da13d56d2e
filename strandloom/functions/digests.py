"""Digests of rows that are numpy arrays: the same count and checksum as of md5 over ``concat_ws('|', ...)``, for many rows at once.

A field is an array of whole numbers, which are written in decimal, keys of bases, or a text that all rows have.
"""

from __future__ import annotations

import math
from itertools import product

import numpy as np

from .packed import BASES, sizes

#: Rows that are hashed at once: their blocks stay in the cache.
ROWS = 16384
#: Words of messages whose numbers have several lengths that are written at once, each length by itself.
LAID_OUT = 1 << 24
#: The characters of so many bases, by number of four.
_FOUR = {n: np.frombuffer("".join("".join(x)[:n].ljust(4, "\0") for x in product(BASES, repeat=4)).encode(), np.uint32).copy() for n in (1, 2, 3, 4)}
_SINES = [int(abs(math.sin(i + 1)) * 2**32) & 0xFFFFFFFF for i in range(64)]
_TURNS = [(7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21)]
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
_TENS = 10 ** np.arange(1, 19, dtype=np.int64)
_U = np.uint32
#: Round, word, sine and turn of each step.
_STEPS = [(i // 16, (i, 5 * i + 1, 3 * i + 5, 7 * i)[i // 16] % 16, np.array(_SINES[i], _U), np.array(_TURNS[i // 16][i % 4], _U), np.array(32 - _TURNS[i // 16][i % 4], _U)) for i in range(64)]


def _block(state: list[np.ndarray], w: list[np.ndarray]) -> None:
    """One block of md5 (``w``: sixteen arrays of words), added to the state."""
    a, b, c, d = (x.copy() for x in state)
    f, t = np.empty_like(a), np.empty_like(a)
    xor, both, either, plus, left, right = np.bitwise_xor, np.bitwise_and, np.bitwise_or, np.add, np.left_shift, np.right_shift
    for at, g, sine, s, rest in _STEPS:
        if at == 0:
            xor(c, d, f)
            both(f, b, f)
            xor(f, d, f)
        elif at == 1:
            xor(b, c, f)
            both(f, d, f)
            xor(f, c, f)
        elif at == 2:
            xor(b, c, f)
            xor(f, d, f)
        else:
            np.invert(d, f)
            either(f, b, f)
            xor(f, c, f)
        plus(f, a, f)
        plus(f, w[g], f)
        plus(f, sine, f)
        right(f, rest, t)
        left(f, s, f)
        either(f, t, f)
        plus(f, b, f)
        a, b, c, d, f = d, f, b, c, a
    for x, y in zip(state, (a, b, c, d), strict=True):
        plus(x, y, x)


def _first_words(words: np.ndarray, blocks: np.ndarray | int) -> np.ndarray:
    """The first 32 bits of md5 as its hex digits say them; ``words`` has a column for each padded message."""
    if not isinstance(blocks, int) and (blocks == blocks[0]).all():
        blocks = int(blocks[0])
    state = [np.full(words.shape[1], x, _U) for x in _START]
    first = state[0]
    for j in range(blocks if isinstance(blocks, int) else int(blocks.max())):
        _block(state, list(words[16 * j : 16 * j + 16]))
        if not isinstance(blocks, int):
            first = np.where(blocks == j + 1, state[0], first)
    return (state[0] if isinstance(blocks, int) else first).byteswap().astype(np.int64)


def digits_of(x: np.ndarray) -> np.ndarray:
    """How many characters numbers (not negative) have in decimal."""
    return np.searchsorted(_TENS, x, "right") + 1 if x.dtype.itemsize > 1 else (1 + (x > 9) + (x > 99)).astype(np.int64)


class Bases:
    """A field of bases: keys of k bases (functions/packed.py)."""

    def __init__(self, words: list[np.ndarray], k: int):
        self.words, self.k = words, k

    def __len__(self) -> int:
        return len(self.words[0])

    def __getitem__(self, rows) -> Bases:
        return Bases([w[rows] for w in self.words], self.k)


class Listed:
    """Several fields of bases as one, joined by commas."""

    def __init__(self, parts: list[Bases]):
        self.parts, self.k = parts, sum(x.k for x in parts) + len(parts) - 1

    def __len__(self) -> int:
        return len(self.parts[0])

    def __getitem__(self, rows) -> Listed:
        return Listed([x[rows] for x in self.parts])


#: Numbers, bases, or characters that all rows have.
Field = np.ndarray | Bases | Listed | str


class _Message:
    """Words of messages, written field by field; what all rows have is written last."""

    def __init__(self, words: np.ndarray):
        self.words, self.at, self.same = words, 0, {}

    def put(self, x: np.ndarray, n: int) -> None:
        """n (up to 4) characters, the first one lowest."""
        j, s = divmod(self.at, 4)
        if s:
            self.words[j] |= x << _U(8 * s)
            if s + n > 4:
                self.words[j + 1] |= x >> _U(32 - 8 * s)
        else:
            self.words[j] |= x
        self.at += n

    def text(self, x: str) -> None:
        for c in x.encode():
            self.same[self.at // 4] = self.same.get(self.at // 4, 0) | c << 8 * (self.at % 4)
            self.at += 1

    def bases(self, x: Bases) -> None:
        for w, n in zip(x.words, sizes(x.k), strict=True):
            for i in range(0, n, 4):
                left = n - i - 4
                four = (w >> 2 * left if left >= 0 else w << -2 * left) & 255
                self.put(_FOUR[min(4, n - i)][four], min(4, n - i))

    def number(self, x: np.ndarray, n: int) -> None:
        if n == 1:
            self.put(x.astype(_U) + _U(48), 1)
            return
        places = []
        for _ in range(n - 1):
            y = x // 10
            places.append((x - y * 10).astype(_U) + _U(48))
            x = y
        places.append(x.astype(_U) + _U(48))
        for digit in reversed(places):
            self.put(digit, 1)

    def end(self) -> int:
        """The padding; how many blocks there are."""
        length = self.at
        self.same[length // 4] = self.same.get(length // 4, 0) | 128 << 8 * (length % 4)
        blocks = (length + 72) // 64
        self.same[16 * blocks - 2] = 8 * length
        for j, x in self.same.items():
            self.words[j] |= _U(x)
        return blocks


def _written(fields: list[Field], lengths: list[int], words: np.ndarray) -> int:
    """Messages of one layout: how many digits each number has."""
    message = _Message(words)
    for i, (x, n) in enumerate(zip(fields, lengths, strict=True)):
        if i:
            message.text("|")
        if isinstance(x, str):
            message.text(x)
        elif isinstance(x, Listed):
            for j, part in enumerate(x.parts):
                message.text("," if j else "")
                message.bases(part)
        elif isinstance(x, Bases):
            message.bases(x)
        else:
            message.number(x, n)
    return message.end()


def _length(fields: list[Field], lengths: list[int]) -> int:
    return len(fields) - 1 + sum(len(x) if isinstance(x, str) else n if isinstance(x, np.ndarray) else x.k for x, n in zip(fields, lengths, strict=True))


def _some(fields: list[Field], rows) -> list[Field]:
    return [x if isinstance(x, str) else x[rows] for x in fields]


def checksums(fields: list[Field]) -> np.ndarray:
    """First words of the md5 of every row's fields, joined by ``|``."""
    n = next(len(x) for x in fields if not isinstance(x, str))
    out = np.empty(n, np.int64)
    numbers = [i for i, x in enumerate(fields) if isinstance(x, np.ndarray)]
    longer = [i for i in numbers if n and int(fields[i].max()) > 9]
    several = np.zeros(n, bool)
    for i in longer:
        several |= fields[i] > 9
    plain, single = np.flatnonzero(~several) if longer else None, [1] * len(fields)
    for lo in range(0, n if plain is None else len(plain), ROWS):
        rows = slice(lo, min(n, lo + ROWS)) if plain is None else plain[lo : lo + ROWS]
        some = _some(fields, rows)
        words = np.zeros(((_length(fields, single) + 72) // 64 * 16, next(len(x) for x in some if not isinstance(x, str))), _U)
        out[rows] = _first_words(words, _written(some, single, words))
    # rows with longer numbers: written layout by layout, hashed together
    rest = np.flatnonzero(several)
    at_once = LAID_OUT // ((_length(fields, [20] * len(fields)) + 72) // 64 * 16)
    for lo in range(0, len(rest), at_once):
        rows = rest[lo : lo + at_once]
        code = np.zeros(len(rows), np.int64)
        for i in longer:
            code = code * 20 + digits_of(fields[i][rows])
        order = np.argsort(code, kind="stable")
        rows, code = rows[order], code[order]
        at = np.concatenate([[0], np.flatnonzero(np.diff(code)) + 1, [len(code)]])
        layouts = [[len(str(int(x[rows[i]]))) if isinstance(x, np.ndarray) else 0 for x in fields] for i in at[:-1]]
        words = np.zeros((max((_length(fields, x) + 72) // 64 for x in layouts) * 16, len(rows)), _U)
        blocks = np.empty(len(rows), np.int64)
        for a, b, layout in zip(at[:-1], at[1:], layouts, strict=True):
            blocks[a:b] = _written(_some(fields, rows[a:b]), layout, words[:, a:b])
        for a in range(0, len(rows), ROWS):
            out[rows[a : a + ROWS]] = _first_words(words[:, a : a + ROWS], blocks[a : a + ROWS])
    return out


def summed(by: np.ndarray, sums: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Count and sum of numbers below 2 to the 32, by small numbers (below ``most``): those that occur, counts, sums."""
    n = np.bincount(by, minlength=most)
    total = np.zeros(most, np.int64)
    for lo in range(0, len(by), 1 << 20):  # so many that a float holds the sum
        total += np.bincount(by[lo : lo + (1 << 20)], sums[lo : lo + (1 << 20)], most).astype(np.int64)
    there = np.flatnonzero(n)
    return there, n[there], total[there]
