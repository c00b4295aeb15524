"""BLAKE3 (256 bits, no key) of upper-cased sequences, after the published specification.

Spark has no such function. Chunks of 1024 bytes are independent, so numpy compresses all chunks of
all rows of a batch at once, and then the parents of each level of all trees at once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Fixed values of the specification: initial state, message permutation, flags.
IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], dtype=np.uint32)
PERMUTATION = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
CHUNK_START, CHUNK_END, PARENT, ROOT = 1, 2, 4, 8
CHUNK, BLOCK = 1024, 64
#: Chunks compressed together.
SLAB = 4096

_COLUMNS = [(0, 4, 8, 12), (1, 5, 9, 13), (2, 6, 10, 14), (3, 7, 11, 15)]
_DIAGONALS = [(0, 5, 10, 15), (1, 6, 11, 12), (2, 7, 8, 13), (3, 4, 9, 14)]


def _rotate(x: np.ndarray, by: int) -> np.ndarray:
    return (x >> np.uint32(by)) | (x << np.uint32(32 - by))


def compress(chaining: np.ndarray, words: np.ndarray, counter: np.ndarray, length: np.ndarray, flags: np.ndarray) -> np.ndarray:
    """(8, n) new chaining values of n blocks: chaining (8, n), words (16, n)."""
    n = words.shape[1]
    v = np.empty((16, n), dtype=np.uint32)
    v[:8] = chaining
    v[8:12] = IV[:4, None]
    v[12] = (counter & np.uint64(0xFFFFFFFF)).astype(np.uint32)
    v[13] = (counter >> np.uint64(32)).astype(np.uint32)
    v[14], v[15] = length, flags
    m = words
    for turn in range(7):
        for k, (a, b, c, d) in enumerate(_COLUMNS + _DIAGONALS):
            v[a] += v[b] + m[2 * k]
            v[d] = _rotate(v[d] ^ v[a], 16)
            v[c] += v[d]
            v[b] = _rotate(v[b] ^ v[c], 12)
            v[a] += v[b] + m[2 * k + 1]
            v[d] = _rotate(v[d] ^ v[a], 8)
            v[c] += v[d]
            v[b] = _rotate(v[b] ^ v[c], 7)
        if turn < 6:
            m = m[PERMUTATION]
    return v[:8] ^ v[8:]


def _chunks(parts: list[bytes], counter: np.ndarray, alone: np.ndarray) -> np.ndarray:
    """(8, n) chaining values of chunks of at most 1024 bytes; alone marks chunks that are a whole input."""
    sizes = np.array([len(p) for p in parts])
    raw = np.zeros((len(parts), CHUNK), dtype=np.uint8)
    for row, p in zip(raw, parts):
        row[: len(p)] = np.frombuffer(p, dtype=np.uint8)
    words = raw.view("<u4").reshape(len(parts), CHUNK // BLOCK, 16)
    blocks = np.maximum(1, -(-sizes // BLOCK))
    state = np.repeat(IV[:, None], len(parts), axis=1)
    for b in range(int(blocks.max())):
        on = np.flatnonzero(blocks > b)
        last = blocks[on] == b + 1
        flags = np.where(last, CHUNK_END, 0) | (CHUNK_START if b == 0 else 0) | np.where(last & alone[on], ROOT, 0)
        length = np.minimum(BLOCK, sizes[on] - b * BLOCK)
        state[:, on] = compress(state[:, on], np.ascontiguousarray(words[on, b].T), counter[on], length.astype(np.uint32), flags.astype(np.uint32))
    return state


def blake3_many(texts: list[bytes]) -> list[str]:
    """Hexadecimal digests."""
    owner, counter, parts = [], [], []
    for i, text in enumerate(texts):
        for k in range(max(1, -(-len(text) // CHUNK))):
            owner.append(i)
            counter.append(k)
            parts.append(text[k * CHUNK : (k + 1) * CHUNK])
    if not parts:
        return []
    owner_ = np.array(owner)
    count = np.bincount(owner_, minlength=len(texts))
    alone = count[owner_] == 1
    where = np.array(counter, dtype=np.uint64)
    nodes = np.concatenate([_chunks(parts[i : i + SLAB], where[i : i + SLAB], alone[i : i + SLAB]) for i in range(0, len(parts), SLAB)], axis=1)
    while True:
        # Neighbours of one input become a parent; an odd last node goes up as it is.
        starts = np.flatnonzero(np.diff(owner_, prepend=-1))
        sizes = np.diff(np.append(starts, len(owner_)))
        if (sizes == 1).all():
            break
        place = np.arange(len(owner_)) - np.repeat(starts, sizes)
        size = np.repeat(sizes, sizes)
        left = np.flatnonzero((place % 2 == 0) & (place + 1 < size))
        stays = (place % 2 == 0) & (place + 1 == size)
        flags = np.where(size[left] == 2, PARENT | ROOT, PARENT).astype(np.uint32)
        words = np.concatenate((nodes[:, left], nodes[:, left + 1]))
        made = compress(np.repeat(IV[:, None], len(left), axis=1), words, np.zeros(len(left), dtype=np.uint64), np.full(len(left), BLOCK, dtype=np.uint32), flags)
        nodes[:, left] = made
        keep = stays.copy()
        keep[left] = True
        nodes, owner_ = nodes[:, keep], owner_[keep]
    return [bytes(x).hex() for x in np.ascontiguousarray(nodes.T).astype("<u4").view(np.uint8)]


@F.pandas_udf(StringType())
def _blake3(sequences: pd.Series) -> pd.Series:
    given = sequences.notna().to_numpy()
    out = np.full(len(sequences), None, dtype=object)
    out[given] = blake3_many([s.upper().encode() for s in sequences[given]])
    return pd.Series(out)


def blake3(sequence: Column) -> Column:
    """Digest of an upper-cased sequence; null for null."""
    return _blake3(sequence)
