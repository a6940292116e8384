"""Whole-batch word hashing with numpy: no Python object per word.

A word's hash is a polynomial over its bytes modulo 2**64 (differences of one
running sum per block), then mixed. Two different words share a hash with a
probability near 2**-64; operators that key on hashes say so.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np

U = np.uint64
#: Bytes hashed at once; also the longest word that the running sum covers.
BLOCK = 1 << 20
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Bytes that end a word: white space \x20\x09-\x0D.
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
#: Bytes that end a word of letters, digits or bytes from 0x80 on.
NOT_ALNUM = np.array([not (chr(c).isascii() and chr(c).isalnum()) and c < 128 for c in range(256)])
_BASE = 0x9E3779B97F4A7C15
_tables: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words whose output bits all depend on all input bits."""
    x = (x ^ (x >> U(31))) * U(0x7FB5D329728EA185)
    x = (x ^ (x >> U(27))) * U(0x81DADEF4BC2DD44D)
    return x ^ (x >> U(33))


def _powers() -> list[np.ndarray]:
    if not _tables:
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            steps = np.full(BLOCK + 2, base, U)
            steps[0] = 1
            _tables.append(np.cumprod(steps))
    return _tables


def _hash_block(data: bytes, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, start, end) of the words in lower-cased data of at most BLOCK + 1 bytes."""
    a = np.frombuffer(data, np.uint8)
    inside = np.empty(len(a) + 2, np.int8)
    inside[0] = inside[-1] = 0
    np.logical_not(ends[a], out=inside[1:-1].view(bool))
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    power, inverse = _powers()
    total = np.zeros(len(a) + 1, U)
    np.cumsum((a.astype(U) + U(1)) * power[: len(a)], out=total[1:])
    return mix((total[end] - total[start]) * inverse[start] + (end - start).astype(U)), start, end


def _pieces(data: bytes, ends: np.ndarray) -> Iterator[bytes]:
    """data cut between words into pieces of at most BLOCK bytes; longer words come alone."""
    at, n = 0, len(data)
    while n - at > BLOCK:
        window = np.frombuffer(data, np.uint8, BLOCK, at)
        gaps = np.flatnonzero(ends[window])
        if len(gaps):
            to = at + int(gaps[-1]) + 1
        else:
            to = at + BLOCK
            while to < n and not ends[data[to]]:
                to += 1
        yield data[at:to]
        at = to
    yield data[at:]


def word_hashes(data: bytes, ends: np.ndarray = SPACE) -> np.ndarray:
    """Hashes of one text's words, in order, A-Z as a-z, in memory of a block and the hashes."""
    data = data.translate(LOWER)
    if len(data) <= BLOCK:
        return _hash_block(data, ends)[0]
    out = []
    for piece in _pieces(data, ends):
        if len(piece) > BLOCK:
            out.append(np.frombuffer(hashlib.blake2b(piece, digest_size=8).digest(), U))
        else:
            out.append(_hash_block(piece, ends)[0])
    return np.concatenate(out)


def blocks(texts: list, limit: int = BLOCK) -> Iterator[tuple[int, list[bytes]]]:
    """Runs of texts (bytes, str or None) as UTF-8 of at most `limit` bytes together, or one longer text; with the first's place."""
    run: list[bytes] = []
    at = size = 0
    for i, t in enumerate(texts):
        b = t.encode("utf-8", "surrogatepass") if isinstance(t, str) else t or b""
        if run and size + len(b) + 1 > limit:
            yield at, run
            run, size, at = [], 0, i
        run.append(b)
        size += len(b) + 1
    if run:
        yield at, run


def words(run: list[bytes], ends: np.ndarray = SPACE, gap: bytes = b" ") -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words of these texts, place of each text's first word and the end). `gap` is one of `ends`."""
    if len(run) == 1:
        h = word_hashes(run[0], ends)
        return h, np.array([0, len(h)])
    sizes = np.fromiter((len(b) + 1 for b in run), np.int64, len(run))
    h, start, _ = _hash_block(gap.join(run).translate(LOWER), ends)
    first = np.concatenate([[0], np.cumsum(sizes)])
    return h, np.searchsorted(start, first)


_STEP = [U(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


def shingle_sets(run: list[bytes], k: int = 5) -> list[np.ndarray]:
    """Each text's distinct shingles of k words, sorted; fewer words: all as one shingle; no words: none."""
    h, first = words(run)
    n = np.diff(first)
    out = []
    full = None
    if len(h) >= k:
        full = sum((h[i : len(h) - k + 1 + i] * _STEP[i % 5] + U(i) for i in range(k)), np.zeros(len(h) - k + 1, U))
        full = mix(full)
    for i in range(len(run)):
        if n[i] >= k:
            s = np.sort(full[first[i] : first[i + 1] - k + 1])
            out.append(s[np.concatenate([[True], s[1:] != s[:-1]])])
        elif n[i]:
            w = h[first[i] : first[i + 1]]
            out.append(mix(sum((w[j : j + 1] * _STEP[j % 5] + U(j) for j in range(len(w))), np.zeros(1, U)) + U(int(n[i]) << 32)))
        else:
            out.append(h[:0])
    return out


def words_with_shapes(run: list[bytes], shapes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """words(run), and each word's shape below `shapes`: a hash of its last two bytes, its length up to 12 and whether it has bytes from 0x80 on."""
    if len(run) == 1 and len(run[0]) > BLOCK:
        found = [_shaped(p, shapes) for p in _pieces(run[0].translate(LOWER), SPACE)]
        h = np.concatenate([f[0] for f in found])
        return h, np.array([0, len(h)]), np.concatenate([f[1] for f in found])
    h, shape, start = _shaped(b" ".join(run).translate(LOWER), shapes)
    first = np.concatenate([[0], np.cumsum(np.fromiter((len(b) + 1 for b in run), np.int64, len(run)))])
    return h, np.searchsorted(start, first), shape


def _shaped(data: bytes, shapes: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if len(data) > BLOCK + 1:  # one word
        return np.frombuffer(hashlib.blake2b(data, digest_size=8).digest(), U), np.zeros(1, np.int64), np.zeros(1, np.int64)
    h, start, end = _hash_block(data, SPACE)
    if not len(h):
        return h, np.zeros(0, np.int64), start
    a = np.frombuffer(data, np.uint8)
    wide = np.concatenate([[0], np.cumsum(a >= 128)])
    last, size = a[end - 1].astype(np.int64), end - start
    before = np.where(size > 1, a[np.maximum(end - 2, 0)], 0).astype(np.int64)
    key = last | before << 8 | np.minimum(size, 12) << 16 | (wide[end] > wide[start]).astype(np.int64) << 24
    return h, (mix(key.astype(U)) % U(shapes)).astype(np.int64), start
