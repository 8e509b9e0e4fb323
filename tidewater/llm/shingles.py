"""Word shingles of whole texts as 64-bit hashes, and MinHash signatures over them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from tidewater.llm.common import lower_ascii, mix64, span_hashes, text_chunks, word_spans

_WEIGHTS = np.array([0x9FB21C651E98DF25, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F, 0xEB44ACCAB455D165], np.uint64)


def shingle_sets(column: pa.Array, width: int = 5):
    """Yield for every text the sorted distinct hashes of its word shingles.

    A text with fewer words than width has its whole word sequence as one shingle; no words, no shingles.
    """
    for _, data, offsets in text_chunks(column):
        low = lower_ascii(data)
        starts, ends, owner = word_spans(low, offsets)
        words = span_hashes(low, starts, ends)
        bounds = np.searchsorted(owner, np.arange(len(offsets)))
        with np.errstate(over="ignore"):
            n = max(0, len(words) - width + 1)
            full = np.zeros(n, np.uint64)
            for j in range(width):
                full += words[j : j + n] * _WEIGHTS[j % len(_WEIGHTS)]
            full = mix64(full)
            for i in range(len(offsets) - 1):
                a, b = bounds[i], bounds[i + 1]
                if b - a >= width:
                    yield np.unique(full[a : b - width + 1])
                elif b > a:
                    short = np.uint64(b - a) * np.uint64(0x2545F4914F6CDD1D)
                    yield mix64(np.array([short + (words[a:b] * _WEIGHTS[: b - a]).sum()], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def coordinates(n: int, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n linear hash functions modulo 2**32."""
    rng = np.random.default_rng(seed)
    return rng.integers(0, 1 << 31, n, dtype=np.uint32) * np.uint32(2) + np.uint32(1), rng.integers(0, 1 << 32, n, dtype=np.uint32)


def signature(hashes: np.ndarray, a: np.ndarray, b: np.ndarray, block: int = 2048) -> np.ndarray:
    """MinHash values, one per coordinate; works through the set in blocks, so memory is bounded."""
    low = (hashes >> np.uint64(32)).astype(np.uint32) ^ hashes.astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    with np.errstate(over="ignore"):
        for i in range(0, len(low), block):
            np.minimum(out, (a[:, None] * low[None, i : i + block] + b[:, None]).min(axis=1), out=out)
    return out
