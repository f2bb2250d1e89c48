"""Vectorised words and word hashes over many texts at once.

Texts are UTF-8 bytes. A table of 256 booleans says which bytes separate words, so word classes that treat all bytes
of non-ASCII characters alike are exact. A word's hash is a polynomial over 64-bit values of its bytes, mixed; a second
seed gives an independent second hash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U = np.uint64
PIECE = 1 << 20
_MUL, _ADD = U(0x9E3779B97F4A7C15), U(0xD1B54A32D192ED03)

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


class _Powers:
    """Powers of an odd number modulo 2**64 and their inverses, grown as needed."""

    def __init__(self, seed: int):
        rng = np.random.Generator(np.random.PCG64(0x5EED + seed))
        self.byte = rng.integers(1, 2**63, 256, dtype=np.uint64) * U(2) + U(1)
        self.base = int(rng.integers(1, 2**62)) * 4 + 3
        self.up = self.down = np.ones(1, U)

    def grown(self, n: int) -> None:
        if len(self.up) < n:
            n = max(n, PIECE + 4096)
            inv = pow(self.base, -1, 2**64)
            self.up, self.down = (_powers(b, n) for b in (self.base, inv))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.ones(1, U)
    while len(out) < n:
        out = np.concatenate([out, out * U(pow(base, len(out), 2**64))])
    return out[:n]


_POWERS: dict[int, _Powers] = {}


def bounds(buf: np.ndarray, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words in ``buf``."""
    word = np.zeros(len(buf) + 2, np.int8)
    word[1:-1] = ~sep[buf]
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _hash(buf: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int) -> np.ndarray:
    p = _POWERS.setdefault(seed, _Powers(seed))
    p.grown(min(len(buf), 2 * PIECE) + 1)
    if len(buf) > 2 * PIECE:
        raw = np.array([_long(p, buf[a:b]) for a, b in zip(start.tolist(), end.tolist(), strict=True)], U)
    else:
        run = np.zeros(len(buf) + 1, U)
        np.cumsum(p.byte[buf] * p.up[: len(buf)], out=run[1:])
        raw = (run[end] - run[start]) * p.down[start]
    return mixed(raw + (end - start).astype(U) * _ADD)


def _long(p: _Powers, word: np.ndarray) -> int:
    """A long word's polynomial, part by part."""
    total = 0
    for a in range(0, len(word), PIECE):
        part = word[a : a + PIECE]
        total += int((p.byte[part] * p.up[: len(part)]).sum(dtype=U)) * pow(p.base, a, 2**64)
    return total % 2**64


def chunks(texts: list[bytes], limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Consecutive ranges of texts of about ``limit`` bytes; a longer text is a range of its own."""
    a = size = 0
    for b, t in enumerate(texts):
        if b > a and size + len(t) > limit:
            yield a, b
            a, size = b, 0
        size += len(t) + 1
    if a < len(texts):
        yield a, len(texts)


def _pieces(text: bytes, sep: np.ndarray) -> Iterator[bytes]:
    """A long text cut at separators into pieces of at most ``PIECE`` bytes; a longer word is a piece of its own."""
    cuts, at = np.flatnonzero(sep[np.frombuffer(text, np.uint8)]), 0
    while at < len(text):
        end = at + PIECE
        if end < len(text):
            k = int(np.searchsorted(cuts, end, "right"))
            if k and cuts[k - 1] > at:
                end = int(cuts[k - 1])
            else:
                end = int(cuts[k]) if k < len(cuts) else len(text)
        yield text[at:end]
        at = end


def _words(texts: list[bytes], sep: np.ndarray, seeds: tuple[int, ...]) -> tuple[np.ndarray, list[np.ndarray]]:
    one = int(np.flatnonzero(sep)[0])
    buf = np.frombuffer(bytes([one]).join(texts), np.uint8)
    start, end = bounds(buf, sep)
    at = np.cumsum([0] + [len(t) + 1 for t in texts])
    count = np.diff(np.searchsorted(start, at))
    return count, [_hash(buf, start, end, s) for s in seeds]


def words(texts: list[bytes], sep: np.ndarray = SPACE, seeds: tuple[int, ...] = (0,)) -> tuple[np.ndarray, list[np.ndarray]]:
    """For all words of ``texts`` in order: how many each text has, and the hashes by seed.

    A single text may be of any length: it is hashed piece by piece, and so is a word longer than a piece.
    """
    if len(texts) == 1 and len(texts[0]) > PIECE:
        found = [_words([p], sep, seeds) for p in _pieces(texts[0], sep)]
        return np.array([sum(int(n[0]) for n, _ in found)]), [np.concatenate([h[k] for _, h in found]) for k in range(len(seeds))]
    return _words(texts, sep, seeds)


def grams(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all runs of ``k`` consecutive words (also of those that cross texts)."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    h = hashes[:n].copy()
    for j in range(1, k):
        h *= _MUL
        h += hashes[j : j + n]
    return mixed(h)


def shingle_sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """Sorted distinct hashes of each text's ``k``-word shingles; a shorter text is one shingle, one without words none."""
    out = []
    for a, b in chunks(texts):
        count, (h,) = words(texts[a:b])
        g, at = grams(h, k), 0
        for n in count.tolist():
            if n >= k:
                out.append(np.unique(g[at : at + n - k + 1]))
            elif n:
                out.append(mixed(np.array([int(_fold(h[at : at + n])) ^ n], U)))
            else:
                out.append(np.zeros(0, U))
            at += n
    return out


def _fold(h: np.ndarray) -> np.uint64:
    x = h[0]
    with np.errstate(over="ignore"):
        for y in h[1:]:
            x = x * _MUL + y
    return x
