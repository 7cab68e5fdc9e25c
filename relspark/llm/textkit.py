"""Vectorised text primitives shared by the Arrow-batched operators.

A batch of texts is laid out as one uint8 array; words, shingles and rolling
fingerprints are computed for the whole batch with numpy, never per character
in Python.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Base of the polynomial word hash; odd, so that it can be inverted mod 2**64.
BASE = 0x9E3779B97F4A7C15
BASE_INV = pow(BASE, -1, 1 << 64)
BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_POWERS: dict[int, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: a bijection that spreads all bits."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) mod 2**64; kept and grown per process."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = 1 << max(10, int(n - 1).bit_length())
        out = np.ones(size, np.uint64)
        filled, step = 1, base
        while filled < size:
            out[filled : 2 * filled] = out[:filled] * U64(step)
            filled, step = 2 * filled, step * step % (1 << 64)
        have = _POWERS[base] = out
    return have[:n]


def join_texts(texts, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Texts (None: empty) as one byte array with a line feed after each, and
    the offsets of the texts (len + 1; text i ends one before offset i + 1)."""
    raw = [b"" if t is None else t if isinstance(t, bytes) else t.encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=offsets[1:])
    joined = b"\n".join(raw) + b"\n" if raw else b""
    return np.frombuffer(joined.lower() if lower else joined, np.uint8), offsets  # bytes.lower: A-Z alone


def word_spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: maximal runs of bytes that aren't white
    space. Every text ends in a line feed, so no word crosses texts."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = ~_SPACE[data]
    edge = np.diff(inside)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


#: Words up to this many bytes are hashed by eights; longer ones by a polynomial.
SHORT = 64


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes, which are read eight at a time."""
    sizes = ends - starts
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    eights = np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))  # from every byte on
    masks = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)
    out = mix64((eights[starts] & masks[np.minimum(sizes, 8)]) + sizes.astype(U64) * U64(BASE))
    more = np.flatnonzero(sizes > 8)
    for at in range(8, SHORT, 8):
        if not len(more):
            return out
        out[more] = mix64(out[more] * U64(BASE) + (eights[starts[more] + at] & masks[np.minimum(sizes[more] - at, 8)]))
        more = more[sizes[more] > at + 8]
    if len(more):
        offsets = np.concatenate([[0], np.cumsum(sizes[more])])
        joined = data[np.arange(offsets[-1]) + np.repeat(starts[more] - offsets[:-1], sizes[more])]
        total = np.zeros(len(joined) + 1, U64)
        np.cumsum(BYTE_VALUES[joined] * powers(BASE, len(joined)), out=total[1:])
        out[more] = mix64((total[offsets[1:]] - total[offsets[:-1]]) * powers(BASE_INV, len(joined) + 1)[offsets[:-1]] + sizes[more].astype(U64))
    return out


def words_per_text(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Index of the first word of each text, and the number of words at the end."""
    return np.searchsorted(starts, offsets)
