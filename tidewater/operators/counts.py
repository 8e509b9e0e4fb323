"""Counts of words, sentences and syllables of whole texts, taken byte by byte over Arrow batches.

Patterns state the same counts in tidewater.functions.scores, at many times the cost for long texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewater.functions.scores import COMMON_WORDS
from tidewater.operators.work import map_batches


def _among(chars: bytes) -> np.ndarray:
    held = np.zeros(256, bool)
    held[list(chars)] = True
    return held


BLANK, MARK, VOWEL, LETTER = _among(b" \t\n\x0b\x0c\r"), _among(b".!?"), _among(b"aeiouy"), _among(bytes(range(97, 123)))
_STARTS_EMPTY = re.compile(rb"[ \t\n\x0b\x0c\r]*[aeiouy]*e(?![a-z])")
_COMMON = frozenset(w.encode() for w in COMMON_WORDS)


class _Texts:
    """The lower-case texts of a batch as one array of bytes, a line feed behind each."""

    def __init__(self, texts: list[bytes]):
        self.texts = texts
        self.bytes = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        self.ends = np.cumsum([len(t) + 1 for t in texts])  # behind each line feed

    def per(self, marked: np.ndarray, ends: np.ndarray | None = None) -> np.ndarray:
        """How many marks stand in each text."""
        before = np.concatenate(([0], np.cumsum(marked)))[self.ends if ends is None else ends]
        return np.diff(before, prepend=0)


def _starts(held: np.ndarray) -> np.ndarray:
    """The first of each run."""
    out = held.copy()
    out[1:] &= ~held[:-1]
    return out


def _words(t: _Texts) -> np.ndarray:
    return t.per(_starts(~BLANK[t.bytes]))


def _sentences(t: _Texts) -> np.ndarray:
    """Pieces between full stops, exclamation and question marks that hold more than white space."""
    cut = MARK[t.bytes]
    cut[t.ends - 1] = True
    at = np.flatnonzero(cut | ~BLANK[t.bytes])
    first = np.zeros(len(t.bytes), bool)
    first[at[_starts(~cut[at])]] = True
    return t.per(first)


def _syllables(t: _Texts) -> np.ndarray:
    word, vowel = ~BLANK[t.bytes], VOWEL[t.bytes]
    start = _starts(word)
    number = np.cumsum(start) - 1
    groups = np.bincount(number[_starts(vowel)], minlength=start.sum())
    last = np.flatnonzero(word[:-1] & ~word[1:])  # one for each word, since a line feed ends the last
    groups = np.maximum(1, groups - ((t.bytes[last] == ord("e")) & (groups > 1)))
    upto = np.concatenate(([0], np.cumsum(groups)))
    return np.diff(upto[np.concatenate(([0], np.cumsum(start)))[t.ends]], prepend=0)


def _plain_syllables(t: _Texts) -> np.ndarray:
    """By the rule of scores.plain_syllables, over letters a-z and white space alone."""
    kept = LETTER[t.bytes] | BLANK[t.bytes]
    ends = np.concatenate(([0], np.cumsum(kept)))[t.ends]
    plain = t.bytes[kept]
    letter, vowel = LETTER[plain], VOWEL[plain]
    total = _starts(letter).astype(np.int64)
    total[1:] += letter[:-1] & ~vowel[:-1] & vowel[1:]
    total[:-1] -= (plain[:-1] == ord("e")) & ~letter[1:]
    whole, first = plain.tobytes(), np.concatenate(([0], ends[:-1]))
    return t.per(total, ends) + np.array([_STARTS_EMPTY.match(whole, a, b) is not None for a, b in zip(first.tolist(), ends.tolist())], np.int64)


def _long(text: bytes, least: int) -> list[bytes]:
    """Words of more than least characters."""
    if text.isascii():
        return [w for w in text.split() if len(w) > least]
    return [w for w in text.split() if len(w) > least and len(w.decode()) > least]


def _top(t: _Texts) -> list[int]:
    """How often the commonest word of more than three characters stands in each text."""
    return [max(Counter(_long(x, 3)).values(), default=0) for x in t.texts]


def _telling(t: _Texts) -> list[int]:
    """Words of more than two characters that aren't common ones."""
    return [sum(w not in _COMMON for w in _long(x, 2)) for x in t.texts]


def _distinct_telling(t: _Texts) -> list[int]:
    return [len(set(_long(x, 2)) - _COMMON) for x in t.texts]


def _distinct_long(t: _Texts) -> list[int]:
    return [len(set(_long(x, 3))) for x in t.texts]


COUNTS: dict[str, Callable] = {
    "words": _words, "sentences": _sentences, "syllables": _syllables, "plain_syllables": _plain_syllables, "top": _top, "telling": _telling,
    "distinct_telling": _distinct_telling, "distinct_long": _distinct_long,
}


def counted(df: DataFrame, text: str, *names: str) -> DataFrame:
    """df with a long column for each of names, which are keys of COUNTS; a null text counts as an empty one.

    Only Spark lower-cases, so that letters outside ASCII agree with its own expressions.
    """
    unknown = set(names) - COUNTS.keys()
    if unknown:
        raise ValueError(f"no such counts: {sorted(unknown)}")
    own = df.schema
    for name in names:
        own = own.add(name, "long")
    kernels = {name: COUNTS[name] for name in names}

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = batch.column(batch.num_columns - 1)
            found = _Texts(low.cast(pa.large_binary()).to_pylist()) if batch.num_rows else None
            added = [pa.array(kernel(found) if found else [], pa.int64()) for kernel in kernels.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *added], names=[*batch.schema.names[:-1], *kernels])

    return map_batches(df.withColumn("_low", F.lower(F.coalesce(text, F.lit("")))), task, own)
