"""Word hashes and shingles of whole columns of texts, for Arrow functions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

#: Odd multipliers of 64-bit hashes.
STEP, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
#: Bytes of text whose words are looked up together.
TOGETHER = 8 << 20


def by_bytes(texts: pa.Array, most: int = TOGETHER) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about ``most`` bytes of text each, one row at least."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    group = (np.cumsum(sizes) - sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), len(sizes)]
    yield from ((a, b) for a, b in zip(edges[:-1], edges[1:]) if b > a)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * MIX
    x = (x ^ (x >> np.uint64(32))) * MIX
    return x ^ (x >> np.uint64(32))


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of all texts (dictionary coded), and the place in them where each text begins,
    with the end. A word is a run of anything but space, tab, line feed, vertical tab, form
    feed and carriage return."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    flat = lists.flatten()
    offsets = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    before = np.append(0, np.cumsum(real))
    return flat.filter(pa.array(real)).dictionary_encode(), before[offsets]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hash of every word of all texts, and where each text begins, with the end."""
    coded, starts = words_of(texts)
    distinct = coded.dictionary.cast(pa.binary()).to_pylist()
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))
    return hashes[coded.indices.to_numpy()], starts


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each ``width`` consecutive words, by their first word's place."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * STEP + hashes[k : k + n]
    return mixed(out)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Each text's distinct shingles as sorted hashes: the whole text if it has fewer words."""
    for low, high in by_bytes(texts):
        hashes, starts = word_hashes(pc.ascii_lower(texts.slice(low, high - low)))
        every = window_hashes(hashes, width)
        for a, b in zip(starts[:-1], starts[1:]):
            if b - a >= width:
                yield np.unique(every[a : b - width + 1])
            elif b > a:
                yield window_hashes(hashes[a:b], int(b - a)) + np.uint64(b - a)
            else:
                yield np.zeros(0, np.uint64)
