"""Conversation prefix trie: a Cartesian tree over the longest common prefixes of sorted conversations.

1. Turns get rolling hashes (two polynomials of 64 bits over their digests) of all turns up to them, over ranges of
   conversation and turn. A hash of some first turns stands for that sequence from here on.
2. A conversation's sort key holds the hashes at those depths alone where some conversation leaves it: with N turns in
   all, fewer than the root of 2 N. Sorted by key, conversations lie in blocks of neighbours, each with the length of
   its common prefix (LCP) with the one before.
3. A node with several members and more than one way on is a run of neighbours whose LCPs reach its depth, between the
   nearest smaller LCPs on its left and right. Each block finds those that lie within it by one pass with a stack; the
   least LCP of each block tells in which block the others end, and the blocks' falling and rising minima tell where.
   Equal LCPs with the same ends are one node.
4. Counts, smallest members and words are sums and minima over the run. The depths between a node and its parent, which
   have the same members, are filled in at the end.

Rows of conversations are small, a block has about BLOCK_ROWS of them, and the driver gets a few numbers a block. So
neither a conversation with very many turns nor very many equal conversations meet in one task; only the SHA-256 of a
node's ends, a chain by its nature, is taken in one, over a stream of texts that the blocks have joined before.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, materialize, read_table, size_of_words

BLOCK_ROWS = 32_768
HEAD = 3  # the longest head that a conversation can take over
FAMILY = 20
CHUNK = 4096  # depths that are filled in at a time
BASES = np.array([0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93], np.uint64)
INVERSES = np.array([pow(int(b), -1, 1 << 64) for b in BASES], np.uint64)
NOBODY = 1 << 63  # above all ids
EMPTY = hashlib.sha256(b"").hexdigest()


def power(base: np.uint64, exponents: np.ndarray) -> np.ndarray:
    """base ** exponents modulo 2 ** 64; exponents are not negative."""
    out, e = np.ones(len(exponents), np.uint64), exponents.astype(np.uint64)
    with np.errstate(over="ignore"):
        while e.any():
            out = np.where(e & np.uint64(1), out * base, out)
            base, e = base * base, e >> np.uint64(1)
    return out


def _partition() -> int:
    return TaskContext.get().partitionId()


def _unsigned(batch: pa.RecordBatch, *names: str) -> list[np.ndarray]:
    return [batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64) for n in names]


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.view(np.int64))


# ---------------------------------------------------------------- 1. rolling hashes

TURNS = "part int, conv_id long, pos long, h1 long, h2 long, t1 long, t2 long, words long, total long, edge int"


def _number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions, hashes and words so far of sorted turns within a partition; edge marks its first (1) and last row (2)."""
    part, conv, count, sums, total, held = _partition(), None, 0, [np.uint64(0)] * 2, 0, None
    for batch in batches:
        if not batch.num_rows:
            continue
        ids, words = batch.column("conv_id").to_numpy(), batch.column("words").to_numpy()
        n = len(ids)
        digests = np.frombuffer(b"".join(batch.column("digest").to_pylist()), np.uint64).reshape(n, 2)
        new = np.ones(n, bool)
        new[1:] = ids[1:] != ids[:-1]
        if conv is not None and ids[0] == conv:
            new[0] = False
        else:
            count, sums, total = 0, [np.uint64(0)] * 2, 0
        start = np.maximum.accumulate(np.where(new, np.arange(n), -1))
        pos = np.where(start < 0, np.arange(n) + count, np.arange(n) - start) + 1
        cols = []
        with np.errstate(over="ignore"):
            for k in (0, 1):
                term = digests[:, k] * power(BASES[k], pos)
                run = np.cumsum(term)
                run = np.where(start < 0, run + sums[k], run - np.where(start > 0, run[start - 1], np.uint64(0)))
                cols.append((run, term))
                sums[k] = run[-1]
        run = np.cumsum(words)
        so_far = np.where(start < 0, run + total, run - np.where(start > 0, run[start - 1], 0))
        conv, count, total = ids[-1], int(pos[-1]), int(so_far[-1])
        if held is not None:
            yield pa.RecordBatch.from_arrays(held, [c.split()[0] for c in TURNS.split(", ")])
        edge = np.zeros(n, np.int32)
        edge[0] = held is None
        (h1, t1), (h2, t2) = cols
        held = [pa.array(np.full(n, part, np.int32)), pa.array(ids), pa.array(pos), *map(_signed, (h1, h2, t1, t2)), pa.array(words), pa.array(so_far), edge]
        held[-1] = pa.array(edge)
    if held is not None:
        edge = held[-1].to_numpy().copy()
        edge[-1] += 2
        yield pa.RecordBatch.from_arrays([*held[:-1], pa.array(edge)], [c.split()[0] for c in TURNS.split(", ")])


def numbered(turns: DataFrame) -> DataFrame:
    """(conv_id, pos, h1, h2, t1, t2, words, total): turns in order with their place, hashes, own terms and words up to them.

    Turns are ordered by turn, nulls first, and rows that agree in it by the MD5 of role and text.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.unhex(F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text)))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("digest"), size_of_words(text).alias("words"))
    n = max(8, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("digest")]
    placed = materialize(map_batches(rows.repartitionByRange(n, *by).sortWithinPartitions(*by).drop("turn"), _number, TURNS), "turns")
    # two rows a partition: what the partitions before hold of its first conversation
    edges = sorted(placed.where("edge > 0").collect(), key=lambda r: (r.part, r.edge == 2))
    first, last = {r.part: r for r in edges if r.edge & 1}, {r.part: r for r in edges if r.edge & 2}
    before: dict[int, tuple] = {}
    conv, count, sums, total = None, 0, [0, 0], 0
    for part, end in sorted(last.items()):
        own = [end.h1, end.h2]
        if first[part].conv_id == conv:
            before[part] = (conv, count, sums[0], sums[1], total)
        if first[part].conv_id == conv == end.conv_id:
            sums = [(sums[k] + pow(int(BASES[k]), count, 1 << 64) * own[k]) % (1 << 64) for k in (0, 1)]
            count, total = count + end.pos, total + end.total
        else:
            conv, count, sums, total = end.conv_id, end.pos, [x % (1 << 64) for x in own], end.total

    def carry(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts, ids = batch.column("part").to_numpy(), batch.column("conv_id").to_numpy()
            pos, total = batch.column("pos").to_numpy().copy(), batch.column("total").to_numpy().copy()
            h1, h2, t1, t2 = (x.copy() for x in _unsigned(batch, "h1", "h2", "t1", "t2"))
            for part in np.unique(parts):
                if part in before:
                    conv, count, *sums, words = before[part]
                    at = (parts == part) & (ids == conv)
                    pos[at] += count
                    total[at] += words
                    with np.errstate(over="ignore"):
                        for k, (h, t) in enumerate(((h1, t1), (h2, t2))):
                            up = np.uint64(pow(int(BASES[k]), count, 1 << 64))
                            h[at], t[at] = h[at] * up + np.uint64(sums[k]), t[at] * up
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(pos), *map(_signed, (h1, h2, t1, t2)), batch.column("words"), pa.array(total)], ["conv_id", "pos", "h1", "h2", "t1", "t2", "words", "total"])

    return map_batches(placed, carry, "conv_id long, pos long, h1 long, h2 long, t1 long, t2 long, words long, total long")


# ---------------------------------------------------------------- what is rebuilt

HEADS = ("pos", "h1", "h2", "t1", "t2", "words", "total")


def _at(heads: Column, n: Column, name: str) -> Column:
    """A field of the n-th of some first turns; 0 for none."""
    return F.coalesce(F.get(heads, (n - 1).cast("int"))[name], F.lit(0).cast("long"))


def _moved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of turns that follow another head than their own."""
    for batch in batches:
        pos, drop, take = (batch.column(n).to_numpy() for n in ("pos", "dropped", "taken"))
        down = drop - take
        out = []
        with np.errstate(over="ignore"):
            for k in (0, 1):
                h, t, own, base = _unsigned(batch, f"h{k + 1}", f"t{k + 1}", f"own{k + 1}", f"base{k + 1}")
                factor = np.where(down >= 0, power(INVERSES[k], np.maximum(down, 0)), power(BASES[k], np.maximum(-down, 0)))
                now = base + factor * (h - own)
                out.append((now, now - factor * t))
        (h1, p1), (h2, p2) = out
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(pos - down), *map(_signed, (h1, h2, p1, p2)), batch.column("before")], ["conv_id", "pos", "h1", "h2", "p1", "p2", "before"])


def rebuilt(turns: DataFrame, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id, length, words) and their turns (conv_id, pos, h1, h2, p1, p2, before), with heads taken over.

    Conversation c has the first h turns of conversation c - c % family in place of its own first h, h = crc32(c) % 4.
    h1, h2 and p1, p2 are the hashes of all turns up to and before the turn, before the words before it.
    """
    known = materialize(numbered(turns), "numbered")
    own = known.groupBy("conv_id").agg(F.max("pos").alias("n"), F.max("total").alias("words"), F.array_sort(F.collect_list(F.when(F.col("pos") <= HEAD, F.struct(*HEADS)))).alias("heads"))
    own = materialize(own, "own").withColumn("h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(HEAD + 1)).cast("long"))
    base = own.select(F.col("conv_id").alias("b"), F.col("heads").alias("base"))
    met = own.join(base, F.col("conv_id") - F.col("conv_id") % family == F.col("b"), "left")
    none = F.expr("filter(heads, x -> false)")
    met = met.withColumn("base", F.coalesce("base", none)).withColumn("m", F.least(F.size("base").cast("long"), F.col("h")))
    left = F.greatest(F.col("n") - F.col("h"), F.lit(0))
    cut = F.least("h", "n")
    info = met.select(
        "conv_id", "h", "m", F.slice("base", F.lit(1), F.col("m").cast("int")).alias("taken_turns"), (F.col("m") + left).alias("length"),
        (_at(F.col("base"), F.col("m"), "total") + F.col("words") - _at(F.col("heads"), cut, "total")).alias("all_words"),
        *(_at(F.col("base"), F.col("m"), f"h{k}").alias(f"base{k}") for k in (1, 2)), *(_at(F.col("heads"), cut, f"h{k}").alias(f"own{k}") for k in (1, 2)),
        (_at(F.col("base"), F.col("m"), "total") - _at(F.col("heads"), cut, "total")).alias("shift"),
    )
    info = materialize(info, "rebuilt")
    tail = known.join(info.drop("taken_turns", "length", "all_words"), "conv_id").where("pos > h")
    tail = tail.select("conv_id", "pos", "h1", "h2", "t1", "t2", F.col("h").alias("dropped"), F.col("m").alias("taken"), "own1", "own2", "base1", "base2", (F.col("total") - F.col("words") + F.col("shift")).alias("before"))
    tail = map_batches(tail, _moved, "conv_id long, pos long, h1 long, h2 long, p1 long, p2 long, before long")
    minus = lambda k: F.col(f"h{k}").cast("decimal(20,0)") - F.col(f"t{k}").cast("decimal(20,0)")
    turn = F.lit(Decimal(1 << 64))
    wrapped = lambda x: F.when(x >= Decimal(1 << 63), x - turn).when(x < Decimal(-(1 << 63)), x + turn).otherwise(x).cast("long")
    head = info.select("conv_id", F.explode("taken_turns").alias("t")).select("conv_id", "t.*")
    head = head.select("conv_id", "pos", "h1", "h2", wrapped(minus(1)).alias("p1"), wrapped(minus(2)).alias("p2"), (F.col("total") - F.col("words")).alias("before"))
    return info.select("conv_id", "length", F.col("all_words").alias("words")), materialize(tail.unionByName(head), "rebuilt_turns")


# ---------------------------------------------------------------- 2. sorted conversations and their common prefixes


def branches(convs: DataFrame, rows: DataFrame, number: int) -> DataFrame:
    """Adds key to convs: (pos, h1, h2, before) of its turns at which some of the conversations before it are left."""
    nodes = rows.groupBy("pos", "h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min("p1").alias("p1"), F.min("p2").alias("p2"))
    nodes = materialize(nodes, "nodes")
    up = nodes.select((F.col("pos") + 1).alias("pos"), F.col("h1").alias("p1"), F.col("h2").alias("p2"), F.col("n").alias("above"))
    split = nodes.join(up, ["pos", "p1", "p2"], "left").where(F.col("n") < F.coalesce("above", F.lit(number))).select("pos", "h1", "h2")
    at = rows.select("conv_id", "pos", "h1", "h2", "before").join(materialize(split, "splits"), ["pos", "h1", "h2"])
    keys = at.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "h1", "h2", "before"))).alias("key"))
    none = F.array().cast("array<struct<pos:bigint,h1:bigint,h2:bigint,before:bigint>>")
    return convs.join(keys, "conv_id", "left").withColumn("key", F.coalesce("key", none))


def common(a: tuple, b: tuple) -> tuple[int, int]:
    """Turns and words that two neighbours (key as arrays of pos, h1, h2, before; length; words) begin with."""
    (pos_a, *hash_a, _), length, words = a
    (pos_b, *hash_b, before_b), _, _ = b
    n = min(len(pos_a), len(pos_b))
    differ = np.flatnonzero((hash_a[0][:n] != hash_b[0][:n]) | (hash_a[1][:n] != hash_b[1][:n]))
    j = int(differ[0]) if len(differ) else n
    if j < len(pos_b):
        return int(pos_b[j]) - 1, int(before_b[j])
    return int(length), int(words)


SORTED = "block int, idx long, conv_id long, length long, lcp long, shared long, closes int, edge int, words long, key array<struct<pos:bigint,h1:bigint,h2:bigint,before:bigint>>"


def _parts(batch: pa.RecordBatch) -> Iterator[tuple]:
    keys = batch.column("key")
    fields = [keys.values.field(k).to_numpy() for k in range(4)]
    at = keys.offsets.to_numpy()
    for i, (length, words) in enumerate(zip(batch.column("length").to_pylist(), batch.column("words").to_pylist(), strict=True)):
        yield [f[at[i] : at[i + 1]] for f in fields], length, words


def _neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """lcp and shared with the row before, and whether that row has no longer one after it; the edge rows keep their keys."""
    block, idx, last, held = _partition(), 0, None, None
    names = [c.split()[0] for c in SORTED.split(", ")]

    def out(batch: pa.RecordBatch, cols: list, edge: np.ndarray) -> pa.RecordBatch:
        key = pa.array([k if e else None for k, e in zip(batch.column("key").to_pylist() if edge.any() else [None] * len(edge), edge, strict=True)], batch.schema.field("key").type)
        return pa.RecordBatch.from_arrays([*cols, pa.array(edge), batch.column("words"), key], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        lcp, shared, closes = [], [], []
        for row in _parts(batch):
            n, words = common(last, row) if last is not None else (None, None)
            lcp.append(n)
            shared.append(words)
            closes.append(None if last is None else int(n < last[1]))
            last = row
        if held is not None:
            yield out(*held)
        n = batch.num_rows
        edge = np.zeros(n, np.int32)
        edge[0] = idx == 0
        cols = [pa.array(np.full(n, block, np.int32)), pa.array(np.arange(idx, idx + n)), batch.column("conv_id"), batch.column("length"), pa.array(lcp, pa.int64()), pa.array(shared, pa.int64()), pa.array(closes, pa.int32())]
        held, idx = (batch, cols, edge), idx + n
    if held is not None:
        held[2][-1] += 2
        yield out(*held)


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [pa.RecordBatch.from_arrays([batch.column(f"{side}_{c}") for c in ("key", "length", "words")], ["key", "length", "words"]) for side in ("a", "b")]
        found = [(*common(a, b), a[1]) for a, b in zip(*map(_parts, rows), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column("block"), *(pa.array(c, pa.int64()) for c in zip(*found, strict=True))] if found else [batch.column("block"), *[pa.array([], pa.int64())] * 3], ["block", "lcp", "shared", "before"])


class Blocks:
    """A few numbers of each block that has rows, as arrays by place: its offset, least LCP, smallest member, first LCP and sums."""

    def __init__(self, rows: DataFrame) -> None:
        per = rows.groupBy("block").agg(F.count(F.lit(1)).alias("n"), F.min("lcp").alias("least"), F.min("conv_id").alias("smallest"), F.coalesce(F.sum("shared"), F.lit(0)).alias("shared"), F.coalesce(F.sum("closes"), F.lit(0)).alias("closes"))
        found = sorted(per.collect())
        self.ids = [r.block for r in found]
        follow = rows.sparkSession.createDataFrame([(a, b) for a, b in zip(self.ids, self.ids[1:], strict=False)], "a int, b int")
        side = lambda edge, name: rows.where(F.col("edge").bitwiseAND(edge) > 0).select(F.col("block").alias(name), *(F.col(c).alias(f"{name}_{c}") for c in ("key", "length", "words")))
        pairs = follow.join(side(2, "a"), "a").join(side(1, "b"), "b").select(F.col("b").alias("block"), *(f"{s}_{c}" for s in "ab" for c in ("key", "length", "words")))
        border = {r.block: r for r in map_batches(pairs, _borders, "block int, lcp long, shared long, before long").collect()}
        big = 1 << 62
        self.n = np.array([r.n for r in found], np.int64)
        self.first = np.array([border[b].lcp if b in border else -1 for b in self.ids], np.int64)
        self.first_shared = np.array([border[b].shared if b in border else 0 for b in self.ids], np.int64)
        self.first_closes = np.array([int(border[b].lcp < border[b].before) if b in border else 0 for b in self.ids], np.int64)
        self.least = np.minimum(np.array([big if r.least is None else r.least for r in found], np.int64), self.first)
        self.smallest = np.array([r.smallest for r in found], np.int64)
        self.offset = np.concatenate([[0], np.cumsum(self.n)])
        self.shared = np.concatenate([[0], np.cumsum(np.array([r.shared for r in found], np.int64) + self.first_shared)])
        self.closes = np.concatenate([[0], np.cumsum(np.array([r.closes for r in found], np.int64) + self.first_closes)])
        self.place = {b: k for k, b in enumerate(self.ids)}

    def __len__(self) -> int:
        return len(self.ids)

    def left_of(self, k: int, v: int) -> int:
        """The nearest block before k with an LCP below v."""
        step, end = 64, k
        while end > 0:
            low = max(0, end - step)
            hit = np.flatnonzero(self.least[low:end] < v)
            if len(hit):
                return low + int(hit[-1])
            end, step = low, step * 2
        return -1

    def right_of(self, k: int, v: int) -> int:
        """The nearest block after k with an LCP below v; -1 for none."""
        step, at = 64, k + 1
        while at < len(self):
            hit = np.flatnonzero(self.least[at : at + step] < v)
            if len(hit):
                return at + int(hit[0])
            at, step = at + step, step * 2
        return -1


# ---------------------------------------------------------------- 3. nearest smaller LCPs

NODE, FRAGMENT, FALLING, RISING = range(4)
#: kind; block (its place); v: LCP or depth; l and r: first place of the run and the one after it; smallest member; how
#: many LCPs are v; how many members end there; words shared and sequences closed in the run; u and ul: the parent's v
#: and l (null if the block doesn't know it); blocks where the run begins and ends; hash or text of the ends.
PIECES = "kind int, block int, v long, l long, r long, smallest long, k long, e long, shared long, closes long, u long, ul long, left int, right int, ends string"


def _joined(ids: np.ndarray) -> str:
    return ",".join(map(str, ids.tolist()))


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def runs_of(table: pa.Table, blocks: Blocks) -> pa.Table:
    """The runs that lie within a block, pieces of those that don't, and its falling and rising minima."""
    table = table.sort_by("idx")
    b = blocks.place[table.column("block")[0].as_py()]
    conv, length = table.column("conv_id").to_numpy(), table.column("length").to_numpy()
    n, at = len(conv), int(blocks.offset[b])
    s = np.array([blocks.first[b], *table.column("lcp").to_pylist()[1:], blocks.first[b + 1] if b + 1 < len(blocks) else -1], np.int64)
    shared = np.cumsum([blocks.first_shared[b], *table.column("shared").to_pylist()[1:]])
    closes = np.cumsum([blocks.first_closes[b], *table.column("closes").to_pylist()[1:]])
    rows: list[tuple] = []
    heights, ids, lengths = s.tolist(), conv.tolist(), length.tolist()
    left = [-1] * n  # where the run of each LCP begins; -1: before this block
    stack: list[list] = []  # v, l, smallest, k, ends

    def text(found: list[int]) -> str | None:
        return _joined(conv[found]) if found else None

    def fragment(v: int, k: int, ends: list[int], is_left: bool, is_right: bool) -> None:
        if v >= 0:
            rows.append((FRAGMENT, b, v, None, None, None, k, len(ends), None, None, None, None, blocks.left_of(b, v) if is_left else b, blocks.right_of(b, v) if is_right else b, text(ends)))

    for i in range(n):
        v = heights[i]
        low, begin = (ids[i - 1], i - 1) if i else (NOBODY, -1)
        while stack and stack[-1][0] > v:
            w, l, smallest, k, ends = stack.pop()
            low, begin = min(smallest, low), l
            if l < 0:
                fragment(w, k, ends, True, False)
            else:
                up = at + l if v > heights[l] else at + left[l] if left[l] >= 0 else None
                rows.append((NODE, b, w, at + l, at + i, low, k, len(ends), int(shared[i - 1] - shared[l]), int(closes[i - 1] - closes[l]), max(v, heights[l]), up, None, None, _sha(text(ends)) if ends else EMPTY))
        if stack and stack[-1][0] == v:
            top = stack[-1]
            top[2:4] = min(top[2], low), top[3] + 1
        else:
            stack.append([v, begin, low, 1, [i - 1] if begin == i - 1 and begin >= 0 and lengths[i - 1] == v else []])
        left[i] = stack[-1][1]
        if lengths[i] == v:
            stack[-1][4].append(i)
    for w, l, _, k, ends in stack:
        fragment(w, k, ends, l < 0, True)
    if s[n] > s[n - 1] and lengths[n - 1] == s[n]:
        fragment(heights[n], 0, [n - 1], False, True)

    # single conversations below their last fork
    u = np.maximum(s[:-1], s[1:])
    begins = np.array(left)
    for i in np.flatnonzero(length > u).tolist():
        up = at + i if heights[i + 1] > heights[i] else at + left[i] if left[i] >= 0 else None
        rows.append((NODE, b, lengths[i], at + i, at + i + 1, ids[i], 0, 1, 0, 0, int(u[i]), up, None, None, _sha(str(ids[i]))))

    # positions below all before them, and below all after them
    before = np.concatenate([[1 << 62], np.minimum.accumulate(s[:n])[:-1]])
    after = np.concatenate([np.minimum.accumulate(s[:n][::-1])[::-1][1:], [1 << 62]])
    least_before, least_after = np.minimum.accumulate(conv), np.minimum.accumulate(conv[::-1])[::-1]
    for i in np.flatnonzero(s[:n] < before).tolist():
        some = i > 0
        rows.append((FALLING, b, heights[i], at + i, None, int(least_before[i - 1]) if some else None, None, None, int(blocks.shared[b] + (shared[i - 1] if some else 0)), int(blocks.closes[b] + (closes[i - 1] if some else 0)), None, None, None, None, None))
    for i in np.flatnonzero(s[:n] < after).tolist():
        up = at + int(begins[i]) if begins[i] >= 0 else None
        rows.append((RISING, b, heights[i], at + i, None, int(least_after[i]), None, None, int(blocks.shared[b] + shared[i]), int(blocks.closes[b] + closes[i]), None, up, None, None, None))
    fields = [c.split() for c in PIECES.split(", ")]
    types = {"int": pa.int32(), "long": pa.int64(), "string": pa.string()}
    return pa.table([pa.array(c, types[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], [name for name, _ in fields])


BEGUN = "v long, l long, k long, e long, block int, left int, right int, ends string, smallest long, shared long, closes long, sl long, lul long"


def _begin(asked: pa.Table, rising: pa.Table) -> pa.Table:
    """Where runs that begin in a block begin: the last of its places whose LCP is below v."""
    names = [c.split()[0] for c in BEGUN.split(", ")]
    if not asked.num_rows:
        return pa.table({n: pa.array([], pa.string() if n == "ends" else pa.int32() if n in ("block", "left", "right") else pa.int64()) for n in names})
    rising = rising.sort_by("l")
    at = pa.array(np.searchsorted(rising.column("v").to_numpy(), asked.column("v").to_numpy(), "left") - 1)
    mine = {n: rising.column(o).take(at) for n, o in (("l", "l"), ("smallest", "smallest"), ("shared", "shared"), ("closes", "closes"), ("sl", "v"), ("lul", "ul"))}
    return pa.table({n: mine[n] if n in mine else asked.column(n) for n in names})


WHOLE = "v long, l long, r long, smallest long, k long, e long, shared long, closes long, u long, ul long, block int"


def _finish(asked: pa.Table, falling: pa.Table, blocks: Blocks) -> pa.Table:
    """Where runs that end in a block end, the first of its places whose LCP is below v, and what they hold."""
    rows = []
    falling = falling.sort_by([("l", "descending")])  # values rise
    values = falling.column("v").to_numpy() if falling.num_rows else np.zeros(0, np.int64)
    found = falling.to_pylist()
    for a in asked.to_pylist():
        if a["right"] < 0:
            end, r, sr, shared, closes, low = len(blocks), int(blocks.offset[-1]), -1, int(blocks.shared[-1]), int(blocks.closes[-1]), None
        else:
            f = found[int(np.searchsorted(values, a["v"], "left")) - 1]
            end, r, sr, shared, closes, low = a["right"], f["l"], f["v"], f["shared"], f["closes"], f["smallest"]
        smallest = min([a["smallest"], *([low] if low is not None else []), *([int(blocks.smallest[a["left"] + 1 : end].min())] if a["left"] + 1 < end else [])])
        up = a["l"] if sr > a["sl"] else a["lul"]
        rows.append((a["v"], a["l"], r, smallest, a["k"], a["e"], shared - a["shared"], closes - a["closes"], max(sr, a["sl"]), up, a["left"]))
    names = [c.split()[0] for c in WHOLE.split(", ")]
    cols = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table([pa.array(c, pa.int32() if n == "block" else pa.int64()) for c, n in zip(cols, names, strict=True)], names)


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the texts of each (v, l), in the order in which they come, comma-joined."""
    node, state = None, None

    def out() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([node[0]]), pa.array([node[1]]), pa.array([state.hexdigest()])], ["v", "l", "hash"])

    for batch in batches:
        for v, l, text in zip(*(batch.column(c).to_pylist() for c in ("v", "l", "ends")), strict=True):
            if (v, l) != node:
                if node is not None:
                    yield out()
                node, state = (v, l), hashlib.sha256()
            else:
                state.update(b",")
            state.update(text.encode())
    if node is not None:
        yield out()


# ---------------------------------------------------------------- 4. the trie


def runs(convs: DataFrame, rows: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(v, l, n, smallest, children, leaves, shared, u, above, ends): the runs of sorted conversations that are nodes of depth v.

    u is the depth of the fork above (-1 for none), above its smallest member; shared sums the words that neighbours in
    the run begin with.
    """
    spark = convs.sparkSession
    number = convs.count()
    keyed = branches(convs, rows, number)
    n = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-number // block_rows))
    by = ["key", "conv_id"]
    laid = materialize(map_batches(keyed.select("conv_id", "length", "words", "key").repartitionByRange(n, *by).sortWithinPartitions(*by), _neighbours, SORTED), "sorted")
    blocks = Blocks(laid)
    pieces = materialize(laid.select("block", "idx", "conv_id", "length", "lcp", "shared", "closes").groupBy("block").applyInArrow(lambda t: runs_of(t, blocks), PIECES), "pieces")
    of = lambda kind: pieces.where(F.col("kind") == kind)
    asked = of(FRAGMENT).select("v", "k", "e", "block", "left", "right", "ends")
    begun = asked.groupBy("left").cogroup(of(RISING).groupBy("block")).applyInArrow(_begin, BEGUN)
    begun = materialize(begun, "begun")
    same = begun.groupBy("v", "l").agg(F.sum("k").alias("k"), F.sum("e").alias("e"), F.max("left").alias("left"), F.max("right").alias("right"), *(F.max(c).alias(c) for c in ("smallest", "shared", "closes", "sl", "lul")))
    whole = same.groupBy("right").cogroup(of(FALLING).groupBy("block")).applyInArrow(lambda a, f: _finish(a, f, blocks), WHOLE)
    texts = begun.where("e > 0").select("v", "l", "block", "ends")
    hashed = map_batches(texts.repartition("v", "l").sortWithinPartitions("v", "l", "block"), _chain, "v long, l long, hash string")
    crossing = whole.join(hashed, ["v", "l"], "left").withColumn("ends", F.coalesce("hash", F.lit(EMPTY))).drop("hash")
    found = of(NODE).select(*crossing.columns).unionByName(crossing)
    # a fork that begins before the block of its child's place is known by that block's piece of it
    known = begun.where("left < block").select("block", F.col("v").alias("u"), F.col("l").alias("piece_l"))
    found = found.join(known, ["block", "u"], "left").withColumn("ul", F.coalesce("ul", "piece_l")).drop("piece_l", "block")
    found = materialize(found, "runs")
    forks = found.where("r - l > 1").select(F.col("v").alias("u"), F.col("l").alias("ul"), F.col("smallest").alias("above"))
    out = found.join(forks, ["u", "ul"], "left")
    return out.select("v", "l", (F.col("r") - F.col("l")).alias("n"), "smallest", (F.col("k") + 1 - F.col("e")).alias("children"), (F.col("closes") + 1).alias("leaves"), "shared", "u", "above", "ends")


def prefix_trie(turns: DataFrame, family: int = FAMILY, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256): the trie of rebuilt conversations.

    See rebuilt() for what is rebuilt of turns(conv_id, turn, role, text, ...). Defined cases: a null role or text is an
    empty one; rows without a conv_id belong to no conversation; turns that agree in conversation and turn are ordered by
    the MD5 of role and text, and repeated ones are all turns; conversations left without turns end in the root; no
    conversations give no rows; other columns are ignored.
    """
    convs, rows = rebuilt(turns, family)
    found = materialize(runs(convs, rows, block_rows), "forks")
    # every depth from the one below the fork above to the run's own, in chunks, so that a long way is dealt out
    chunks = found.withColumn("from", F.explode(F.sequence(F.col("u") + 1, F.col("v"), F.lit(CHUNK))))
    chunks = chunks.repartition("v", "l", "from")
    depth = F.explode(F.sequence(F.col("from"), F.least(F.col("from") + CHUNK - 1, F.col("v"))))
    nodes = chunks.withColumn("depth", depth)
    before = rows.select(F.col("conv_id").alias("smallest"), F.col("pos").alias("depth"), "before")
    several = nodes.where("n > 1").join(before, ["smallest", "depth"], "left")
    single = nodes.where("n = 1").withColumn("before", F.lit(0).cast("long"))
    last = F.col("depth") == F.col("v")
    saved = F.col("shared") - (F.col("n") - 1) * F.coalesce("before", F.lit(0))
    return several.unionByName(single.select(*several.columns)).select(
        F.col("smallest").alias("conv_id"), "depth",
        F.when(F.col("depth") == 0, F.lit(None)).when(F.col("depth") == F.col("u") + 1, F.col("above")).otherwise(F.col("smallest")).cast("long").alias("parent_conv_id"),
        F.col("n").alias("n_convs"), F.when(last, F.col("children")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").cast("long").alias("n_leaves"),
        F.when(F.col("n") > 1, saved).otherwise(0).cast("long").alias("saved_tokens"), F.when(last, F.col("ends")).otherwise(EMPTY).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(read_table(spark, sf_dir, "conversations"))


OP13_SQL = r"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS r, coalesce(text, '') AS x, turn FROM conversations WHERE conv_id IS NOT NULL),
o AS (SELECT conv_id, list({'r': r, 'x': x} ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || x)) AS w FROM t GROUP BY conv_id),
h AS (SELECT *, xor(list_reduce(list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda a, b: CASE WHEN b < 0 THEN xor(a >> 1, 3988292384 * (a & 1)) ELSE xor(a, b) END), 4294967295) % 4 AS h FROM o),
c AS (SELECT a.conv_id, list_concat(coalesce(b.w[1:a.h], []), a.w[a.h + 1:]) AS w FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id - a.conv_id % 20),
m AS (SELECT conv_id, d, w[1:d] AS p, len(w) AS n FROM (SELECT *, unnest(range(0, len(w) + 1)) AS d FROM c)),
node AS (SELECT p, d, min(conv_id) AS conv_id, count(*) AS n_convs, coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE n = d), '') AS ends FROM m GROUP BY p, d),
kids AS (SELECT p[1:d - 1] AS p, d - 1 AS d, count(*) AS k FROM node WHERE d > 0 GROUP BY 1, 2),
each AS (SELECT node.*, coalesce(k, 0) AS k, CASE WHEN node.d = 0 THEN 0 ELSE (n_convs - 1) * len(regexp_extract_all(node.p[node.d].x, '[^\x20\x09-\x0D]+')) END AS saved FROM node LEFT JOIN kids USING (p, d)),
below AS (SELECT p[1:a] AS p, a AS d, count(*) FILTER (WHERE k = 0) AS leaves, sum(saved) AS saved FROM (SELECT *, unnest(range(0, d + 1)) AS a FROM each) GROUP BY 1, 2)
SELECT each.conv_id, each.d AS depth, u.conv_id AS parent_conv_id, each.n_convs, each.k AS n_children, leaves AS n_leaves, below.saved::BIGINT AS saved_tokens, sha256(each.ends) AS ends_sha256
FROM each JOIN below USING (p, d) LEFT JOIN node u ON u.d = each.d - 1 AND u.p = each.p[1:each.d - 1]
"""
