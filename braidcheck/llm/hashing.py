"""Vectorised hashing of words and byte windows in numpy."""

from __future__ import annotations

import numpy as np

_STEP = np.uint64(0x9E3779B97F4A7C15)
_A, _B = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: An odd multiplier and its inverse modulo 2**64.
BASE = np.uint64(0xD1342543DE82EF95)
INVERSE = np.uint64(pow(int(BASE), -1, 2**64))
#: Bytes that are hashed at once; longer texts go in slices that end between words.
SLICE = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers."""
    x = x + _STEP
    x ^= x >> np.uint64(30)
    x *= _A
    x ^= x >> np.uint64(27)
    x *= _B
    x ^= x >> np.uint64(31)
    return x


#: One random number for each byte value.
BYTE = mix(np.arange(256, dtype=np.uint64) * np.uint64(0x5851F42D4C957F2D))
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 9, 10, 11, 12, 13]] = True
_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and INVERSE**i for i < n, kept by each worker."""
    if len(_powers.get("up", ())) < n:
        size = max(n, SLICE + 2)
        for name, by in (("up", BASE), ("down", INVERSE)):
            x = np.full(size, by, dtype=np.uint64)
            x[0] = 1
            _powers[name] = np.multiply.accumulate(x)
    return _powers["up"][:n], _powers["down"][:n]


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums s with s[e] - s[b], times INVERSE**b, a hash of data[b:e]; data are bytes, or 64-bit hashes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum((BYTE[data] if data.dtype == np.uint8 else data) * up[:-1], out=out[1:])
    return out


def word_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash of each stretch without ASCII white space, A-Z lower-cased, in order."""
    out, at = [], 0
    while at < len(text):
        end = min(len(text), at + SLICE)
        data = np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)
        blank = _BLANK[data]
        if end < len(text):
            cut = np.flatnonzero(blank[-4096:])
            if len(cut):
                end = end - min(4096, len(data)) + int(cut[-1])
            else:
                while end < len(text) and not _BLANK[text[end]]:
                    end += 1
            data = np.frombuffer(text, dtype=np.uint8, count=end - at, offset=at)
            blank = _BLANK[data]
        out.append(_words(data, blank))
        at = max(end, at + 1)
    return np.concatenate(out) if out else np.zeros(0, dtype=np.uint64)


def _words(data: np.ndarray, blank: np.ndarray) -> np.ndarray:
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).view(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    lower = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    return hashes_of_words(lower, starts, ends)


def hashes_of_words(lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashes of the words of lower-cased bytes; no more than about SLICE bytes at once."""
    sums = prefix_sums(lower)
    _, down = powers(len(lower) + 1)
    return mix((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * _STEP)


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of each run of `size` words; of the whole sequence if it is shorter; none without words."""
    n = len(words)
    if not n:
        return words
    size = min(size, n)
    out = np.zeros(n - size + 1, dtype=np.uint64)
    for k in range(size):
        out = (out + words[k : n - size + 1 + k]) * BASE
    return mix(out + np.uint64(size))


def text_bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")
