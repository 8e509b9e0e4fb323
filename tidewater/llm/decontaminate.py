"""Benchmark decontamination by the q-gram lemma.

Benchmark items are cut into overlapping windows of WINDOW characters, short items whole, and besides into parts of PART
characters. The parts start PART_STRIDE apart, so every passage of PASSAGE characters of an item holds a whole one,
wherever it starts; a part is a window like the others in all that follows. If a window occurs in
a text with at most k edits, the two share at least w - q + 1 - k * q character q-grams, and all of them lie on diagonals
(text position less window position) within a span of k. So shared q-grams are counted in overlapping diagonal bands,
bands that reach the bound are kept, and each is verified by a banded alignment of the window with that part of the text.
Windows of a length for which the bound of Q is below one are sought by grams of SHORT_Q characters.

Texts are compared with letters lower-cased and runs of white space as one space. Items are indexed in blocks of about
BLOCK_CHARS characters, and each block meets all documents, so the memory of a task doesn't grow with the benchmark.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pyspark.sql.pandas.types import to_arrow_type

from tidewater.llm.common import map_batches, mix64, read_table, text_chunks

Q, SHORT_Q = 10, 6
WINDOW, STRIDE = 160, 80
PART, PART_STRIDE = 80, 20
PASSAGE = PART + PART_STRIDE - 1  # the shortest part of a long item that is found wherever it starts
EDITS = 0.08  # of a window's characters
BLOCK_CHARS = 2_000_000
SLICE = 1 << 20  # places of shared grams that are looked at together
_BUILT: dict[str, Index] = {}  # the index that this worker built last
_M = np.uint64(0x9E3779B97F4A7C15)


def normalise(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points, lower-cased and with single spaces, of a chunk; text offsets; and the original position of each."""
    chars = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(chars) == len(data):
        at = offsets
    else:
        lead = np.zeros(len(data) + 1, np.int64)
        np.cumsum((data & 0xC0) != 0x80, out=lead[1:])
        at = lead[offsets]
    upper = ((chars >= 65) & (chars <= 90)) | ((chars >= 0xC0) & (chars <= 0xDE) & (chars != 0xD7))
    space = (chars == 32) | ((chars >= 9) & (chars <= 13)) | (chars == 0xA0)
    chars = np.where(upper, chars + np.uint32(32), np.where(space, np.uint32(32), chars))
    keep = np.ones(len(chars), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    keep[at[:-1][at[:-1] < len(chars)]] = True
    where = np.flatnonzero(keep)
    return chars[where], np.searchsorted(where, at), where - np.repeat(at[:-1], np.diff(np.searchsorted(where, at)))


def gram_hashes(chars: np.ndarray, q: int = Q) -> np.ndarray:
    """Hash of the q (Q or SHORT_Q) characters from every position, by doubling: 2, 4, perhaps 8, and then the last two."""
    x = chars.astype(np.uint64)
    with np.errstate(over="ignore"):
        two = x[:-1] * _M + x[1:]
        four = two[:-2] * (_M * _M) + two[2:]
        if q == SHORT_Q:
            return mix64(four[:-2] * _M + two[4:])
        eight = four[:-4] * (_M * _M * _M) + four[4:]
        full = eight[:-2] * _M + two[8:]
    return mix64(full)


class Grams:
    """The places of the q-grams of some windows; numbers are those of the windows."""

    def __init__(self, q: int, windows: list[np.ndarray], numbers: np.ndarray):
        found = [gram_hashes(windows[n], q) for n in numbers]
        size = np.array([len(f) for f in found], np.int64)
        grams = np.concatenate(found) if found else np.zeros(0, np.uint64)
        order = np.argsort(grams, kind="stable")
        offset = np.arange(len(grams)) - np.repeat(np.cumsum(size) - size, size)
        self.q, self.window, self.offset = q, np.repeat(numbers, size)[order].astype(np.int32), offset[order].astype(np.int32)
        self.grams, slot, many = np.unique(grams[order], return_inverse=True, return_counts=True)
        self.first = np.concatenate([[0], np.cumsum(many)])
        self.windows = int(numbers.max()) + 1 if len(numbers) else 0
        self.places = slot * self.windows + self.window  # rises, for the windows of a gram stand in order
        self.bits = min(27, max(18, int(np.log2(len(self.grams) + 1)) + 6))
        self.seen = np.zeros(1 << self.bits, bool)
        self.seen[self.grams >> np.uint64(64 - self.bits)] = True

    def shared(self, chars: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Row, window and diagonal of every gram that a chunk shares with a window, in slices of about SLICE places.

        The slices overlap by more than a window, so what belongs to one occurrence of a window stands in one slice.
        """
        if len(chars) < self.q or not len(self.grams):
            return
        hashes = gram_hashes(chars, self.q)
        hit = np.flatnonzero(self.seen[hashes >> np.uint64(64 - self.bits)])
        slot = np.searchsorted(self.grams, hashes[hit])
        slot[slot == len(self.grams)] = 0
        real = self.grams[slot] == hashes[hit]
        hit, slot = hit[real], slot[real]
        row = np.searchsorted(at, hit, "right") - 1
        inside = hit + self.q <= at[row + 1]
        hit, slot, row = hit[inside], slot[inside], row[inside]
        yield from self._slices(hit, slot, row, 0, self.windows)

    def _slices(self, hit, slot, row, low, high) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """The places of some hits in the windows low to high, split by position and then by window while they are many."""
        if not len(hit):
            return
        first = np.searchsorted(self.places, slot * self.windows + low)
        many = np.searchsorted(self.places, slot * self.windows + high) - first
        total, reach = int(many.sum()), 2 * WINDOW
        if total > SLICE and hit[-1] - hit[0] > 4 * reach:
            middle = (hit[0] + hit[-1]) // 2
            for part in (hit < middle + reach, hit >= middle):
                yield from self._slices(hit[part], slot[part], row[part], low, high)
        elif total > SLICE and high - low > 1:
            middle = (low + high) // 2
            yield from self._slices(hit, slot, row, low, middle)
            yield from self._slices(hit, slot, row, middle, high)
        elif total:
            place = np.repeat(first, many) + np.arange(total) - np.repeat(np.cumsum(many) - many, many)
            yield np.repeat(row, many), self.window[place].astype(np.int64), np.repeat(hit, many) - self.offset[place]


class Index:
    """Windows of a block of items, the edits and shared grams of each, and their q-grams by length."""

    def __init__(self, items: list[tuple[object, str]]):
        self.items, self.windows, self.owner = [i for i, _ in items], [], []
        for n, (_, text) in enumerate(items):
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            chars = normalise(raw, np.array([0, len(raw)]))[0]
            while len(chars) and chars[-1] == 32:
                chars = chars[:-1]
            while len(chars) and chars[0] == 32:
                chars = chars[1:]
            for size, stride in ((WINDOW, STRIDE), (PART, PART_STRIDE)) if len(chars) > PART else ((WINDOW, STRIDE),):
                starts = [0] if len(chars) <= size else [*range(0, len(chars) - size, stride), len(chars) - size]
                for s in starts:
                    window = chars[s : s + size]
                    if len(window) >= Q:
                        self.windows.append(window)
                        self.owner.append(n)
        self.length = np.array([len(w) for w in self.windows], np.int64)
        self.edits = np.floor(self.length * EDITS).astype(np.int64)
        q = np.where(self.length - Q + 1 - self.edits * Q >= 1, Q, SHORT_Q)
        self.need = self.length - q + 1 - self.edits * q
        self.grams = [Grams(n, self.windows, np.flatnonzero(q == n)) for n in (Q, SHORT_Q)]

    def matches(self, column: pa.Array) -> Iterator[tuple[int, int, int, int, int, int]]:
        """(row, number of the item, start, end, edits, windows) of the items that occur in the texts of a column."""
        for first, data, offsets in text_chunks(column):
            chars, at, original = normalise(data, offsets)
            best: dict[tuple[int, int], list] = {}
            for grams in self.grams:
                for row, window, diagonal in grams.shared(chars, at):
                    self._verify(chars, at, original, best, *self._bands(row, window, diagonal + WINDOW))
            for (r, item), (start, end, edits, seen) in best.items():
                yield first + r, item, start, end, edits, len(seen)

    def _bands(self, row: np.ndarray, window: np.ndarray, diagonal: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, window and first diagonal of the bands that hold enough shared q-grams; bands overlap by half."""
        half = self.edits[window] + 1
        out = []
        for shift in (0, 1):  # band n covers the diagonals (2n - shift) * half up to (2n - shift + 2) * half
            band = (diagonal + shift * half) // (2 * half)
            wide = int(band.max()) + 1
            key, count = np.unique((row * len(self.length) + window) * wide + band, return_counts=True)
            pair, b = np.divmod(key, wide)
            r, w = np.divmod(pair, len(self.length))
            keep = count >= self.need[w]
            out.append((r[keep], w[keep], (2 * b[keep] - shift) * (self.edits[w[keep]] + 1) - WINDOW))
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def _verify(self, chars, at, original, best, row, window, diagonal) -> None:
        """Aligns windows with their bands and notes in best, by (row, item), what span and how few edits were found."""
        for length in np.unique(self.length[window]) if len(window) else ():
            chosen = np.flatnonzero(self.length[window] == length)
            for part in np.array_split(chosen, max(1, len(chosen) // 512)):
                k = int(self.edits[window[part[0]]])
                width = 4 * (k + 1)  # the band, and k + 1 diagonals on either side for its first and last edits
                low = diagonal[part] - (k + 1)
                place = low[:, None] + np.arange(length + width)
                fits = (place >= at[row[part]][:, None]) & (place < at[row[part] + 1][:, None])
                region = np.where(fits, chars[np.clip(place, 0, len(chars) - 1)], np.uint32(0))
                cost, end = banded_distance(np.stack([self.windows[w] for w in window[part]]), region, width)
                for n in np.flatnonzero(cost <= k):
                    stop = min(int(low[n] + end[n] + length), int(at[row[part[n]] + 1]))
                    start = max(stop - int(length), int(at[row[part[n]]]))
                    found = best.setdefault((int(row[part[n]]), self.owner[window[part[n]]]), [1 << 62, 0, k, set()])
                    found[0], found[1] = min(found[0], int(original[start])), max(found[1], int(original[stop - 1]) + 1)
                    found[2] = min(found[2], int(cost[n]))
                    found[3].add(int(window[part[n]]))


def banded_distance(windows: np.ndarray, regions: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each window and any stretch of its region, within width diagonals; and the last diagonal."""
    along = np.arange(width, dtype=np.int32)
    cost = np.zeros((len(windows), width), np.int32)
    for i in range(windows.shape[1]):
        step = cost + (windows[:, i : i + 1] != regions[:, i : i + width])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - along, axis=1) + along
    end = cost.argmin(axis=1)
    return cost[np.arange(len(cost)), end], end


def item_blocks(benchmark: DataFrame) -> Iterator[list[tuple[object, str]]]:
    """The items in blocks of about BLOCK_CHARS characters, each small enough for the driver and a broadcast."""
    items = benchmark.where("text is not null").select("item_id", "text").distinct()
    chars = items.agg(F.sum(F.length("text").cast("long"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for n in range(blocks):
        block = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == n)
        yield [(r.item_id, r.text) for r in block.orderBy("item_id", "text").toLocalIterator()]


def _over_block(docs: DataFrame, block: list[tuple[object, str]], task: Callable, schema) -> DataFrame:
    """docs through task(index, batches); a worker builds the index of a block once for all its tasks in a row."""
    held, name = docs.sparkSession.sparkContext.broadcast(block), uuid.uuid4().hex

    def with_index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Index(held.value)
        yield from task(_BUILT[name], batches)

    return map_batches(docs, with_index, schema)


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """(doc_id, item_id, start, end, edits, windows): items of benchmark(item_id, text) that occur in docs(doc_id, text, ...).

    start and end span the found windows of the item in code points of the text, edits is the least number of edits of a
    window, windows how many were found. Defined cases: null texts hold nothing and null items are not sought, nor are
    items of fewer than Q characters; repeated rows give repeated results; repeated items count once; an empty table on
    either side gives no rows; other columns are ignored.
    """
    ids = dict(docs.dtypes)["doc_id"], dict(benchmark.dtypes)["item_id"]
    schema = f"doc_id {ids[0]}, item_id {ids[1]}, start long, end long, edits int, windows int"

    kind = to_arrow_type(benchmark.schema["item_id"].dataType)

    def task(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = pa.array(index.items, kind)
        for batch in batches:
            found = np.array(list(index.matches(batch.column("text"))), np.int64).reshape(-1, 6).T
            ids = batch.column("doc_id").take(pa.array(found[0])), items.take(pa.array(found[1]))
            cols = pa.array(found[2]), pa.array(found[3]), pa.array(found[4].astype(np.int32)), pa.array(found[5].astype(np.int32))
            yield pa.RecordBatch.from_arrays([*ids, *cols], ["doc_id", "item_id", "start", "end", "edits", "windows"])

    found = docs.sparkSession.createDataFrame([], schema)
    for block in item_blocks(benchmark):
        found = found.union(_over_block(docs.select("doc_id", "text"), block, task, schema))
    return found


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that hold no item of the benchmark; same cases as find_leaks."""

    def task(index: Index, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            clean = np.ones(batch.num_rows, bool)
            for found in index.matches(batch.column("text")):
                clean[found[0]] = False
            yield batch.filter(pa.array(clean))

    for block in item_blocks(benchmark):
        docs = _over_block(docs, block, task, docs.schema)
    return docs


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
