"""The prefix trie against one built in dictionaries, on blocks of a few rows."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from tidewater.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain(rows):
    """The rows of the trie of (conv_id, turn, role, text) rows."""
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, hashlib.md5(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).digest(), role or "", text or ""))
    turns = {c: [t[3:] for t in sorted(ts)] for c, ts in turns.items()}
    whole = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 4
        whole[c] = turns.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[h:]
    members = {}
    for c, seq in whole.items():
        for d in range(len(seq) + 1):
            members.setdefault(tuple(seq[:d]), []).append(c)
    kids = {}
    for p in members:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    out, leaves, saved = [], {}, {}
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in kids.get(p, ())) or 1
        words = len([w for w in p[-1][1].replace("\t", " ").replace("\n", " ").split(" ") if w]) if p else 0
        saved[p] = (len(members[p]) - 1) * words + sum(saved[q] for q in kids.get(p, ()))
        ends = ",".join(str(c) for c in sorted(c for c in members[p] if len(whole[c]) == len(p)))
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(kids.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(map(repr, out))


def found(df, **how):
    return sorted(repr(tuple(r)) for r in prefix_trie.prefix_trie(df, **how).select(*COLUMNS).collect())


def conversations(seed, number, longest, words):
    rng = random.Random(seed)
    ids = rng.sample(range(-30, number * 3), number)
    rows = []
    for c in ids:
        n = rng.randint(1, longest)
        text = rng.choice(["a b", "a b", "x"])
        rows += [(c, t, rng.choice(["user", "user", "bot"]) if t > 2 else "user", text if t < 3 else " ".join(rng.choices(words, k=rng.randint(0, 2)))) for t in range(n)]
    return rows


@pytest.mark.parametrize(("seed", "number", "longest", "words", "block"), [(1, 60, 6, ["p"], 3), (3, 40, 12, ["p"], 1), (4, 150, 5, ["p", "q", "r"], 1000)])
def test_against_dictionaries(spark, seed, number, longest, words, block):
    rows = conversations(seed, number, longest, words)
    assert found(spark.createDataFrame(rows, SCHEMA), block_rows=block) == plain(rows)


def test_hot_conversations(spark):
    """A conversation of very many turns, very many equal ones, and ones that only begin like them."""
    long = [(0, t, "u", f"t{t}") for t in range(3000)]
    like = [(c, t, "u", f"t{t}") for c in (20, 40, 61) for t in range(1000 * (c // 20))]
    same = [(c, t, "u", "same") for c in range(1000, 1400) for t in range(3)]
    rows = long + like + same
    assert found(spark.createDataFrame(rows, SCHEMA), block_rows=16) == plain(rows)


def test_odd_rows(spark):
    rows = [
        (1, None, None, "a"), (1, 0, "u", None), (1, 0, "u", "b"), (1, 0, "u", "b"), (None, 1, "u", "c"), (2, 5, "", ""), (2, None, "u", ""), (-5, 1, "u", "ñandú 🦆"),
        (3, 1, "u", "x " * 50_000), (7, 1, "u", "only"), (25, 2, "u", "a"), (20, 1, "b", "c"), (9_000_000_000_000_000_000, 1, "u", "far"),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert found(df) == plain(rows)
    clashing = df.select("*", *(F.lit(1).alias(c) for c in ("pos", "h1", "key", "block", "length", "words", "total", "digest", "n", "v", "l", "part")))
    assert found(clashing) == plain(rows)
    assert found(df.limit(0)) == [] and found(df.where("conv_id is null")) == []
    assert found(df.where("conv_id = 7")) == plain([r for r in rows if r[0] == 7])
