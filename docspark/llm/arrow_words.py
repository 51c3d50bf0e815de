"""Hashes of the words of Arrow batches of texts, for operators that work on arrays of numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash


def word_hashes(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """The 64-bit hashes of all words, text after text, and each text's number of words.

    Words are the runs of bytes other than ASCII white space, which is how ``bytes.split`` takes them; ``lower`` maps A-Z
    to a-z. Null counts as the empty text. Each distinct word of the batch is hashed once.
    """
    found: list[bytes] = []
    counts = np.zeros(len(texts), dtype=np.int64)
    for k, text in enumerate(texts.cast(pa.large_binary()).to_pylist()):
        if text:
            own = (text.lower() if lower else text).split()
            counts[k] = len(own)
            found += own
    coded = pa.array(found, pa.binary()).dictionary_encode()
    table = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()), dtype=np.uint64, count=len(coded.dictionary))
    at = coded.indices.to_numpy(zero_copy_only=False)
    return (table[at] if len(table) else np.zeros(0, dtype=np.uint64)), counts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of SplitMix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
