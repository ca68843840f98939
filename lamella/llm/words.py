"""Words of texts as hashes, a batch at a time. A word is a run of bytes other than ASCII white space."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

ODD = np.uint64(0x9E3779B97F4A7C15)


def plain_texts(column: pa.Array) -> pa.Array:
    """A string column as large strings without nulls, in buffers of its own: some Arrow kernels misread slices."""
    texts = pc.fill_null(column.cast(pa.large_string()), "")
    if texts.offset or (len(texts) and np.frombuffer(texts.buffers()[1], np.int64, 1)[0]):
        texts = texts.take(pa.array(np.arange(len(texts))))
    return texts


def split_words(texts: pa.Array, lower: bool = False) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts, in order, and where each text's begin, with the end of the last. lower: A-Z only. Null is empty."""
    texts = plain_texts(texts)
    if lower:
        texts = pc.ascii_lower(texts)
    lists = pc.ascii_split_whitespace(texts)
    bounds = np.asarray(lists.offsets, np.int64)
    words = lists.flatten()
    full = pc.greater(pc.binary_length(words), 0).to_numpy(zero_copy_only=False)
    kept = np.r_[0, np.cumsum(full)]
    return words.filter(pa.array(full)), kept[bounds - bounds[0]]


def hash_strings(words: pa.Array) -> np.ndarray:
    """64-bit hashes of strings; each distinct one is hashed once."""
    coded = words.dictionary_encode()
    if not len(coded):
        return np.zeros(0, np.uint64)
    distinct = coded.dictionary.to_numpy(zero_copy_only=False)
    return pd.util.hash_array(distinct, categorize=False)[coded.indices.to_numpy(zero_copy_only=False)]


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def windows(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every `size` neighbouring values."""
    n = max(0, len(h) - size + 1)
    with np.errstate(over="ignore"):
        s = mix(h[:n] + np.uint64(size))
        for k in range(1, size):
            s = mix(s * ODD + h[k : k + n])
    return s


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles, A-Z in lower case. Fewer words than a shingle are one."""
    words, bounds = split_words(texts, lower=True)
    h = hash_strings(words)
    all_, at, sets = windows(h, size), bounds.tolist(), []
    for a, b in zip(at, at[1:], strict=False):
        n = b - a
        s = np.sort(all_[a : b - size + 1]) if n >= size else windows(h[a:b], n) if n else h[:0]
        sets.append(s[np.r_[True, s[1:] != s[:-1]]] if len(s) > 1 else s)
    return sets
