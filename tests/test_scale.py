"""Joins whose work and results have to grow with the rows, not with the squares of groups, against plain Python."""

import datetime
import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewater.functions import models
from tidewater.operators import dedup, entities, events, graph, joins, sets, similarity, vectors
from tidewater.plans import flows


def test_copies_are_paired_with_one_of_them(spark):
    rows = [(i, list("abcd")) for i in range(3000)] + [(3000, list("abcde")), (3001, list("abcde")), (3002, ["x"]), (3003, [])]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    wanted = {(0, i): 1.0 for i in range(1, 3000)} | {(3000, 3001): 1.0}
    got = {(r.a, r.b): r.similarity for r in dedup.dice_classes(df, 0.85).collect()}
    assert got == wanted | {(0, 3000): 8 / 9}
    got = {(r.a, r.b): r.similarity for r in dedup.jaccard_classes(df, 0.8).collect()}
    assert got == wanted | {(0, 3000): 0.8}


@pytest.mark.parametrize(("groups", "seed"), [(1000, 1), (25, 2), (7, 3)])
def test_links_by_row_are_those_of_all_pairs(spark, groups, seed):
    rng = np.random.default_rng(seed)
    rows = [(f"k{i}", rng.normal(size=4).tolist(), [["a", "b", "c", None][k] for k in rng.integers(0, 4, 2)] if i % 9 else None, int(rng.integers(0, 400_000)) if i % 8 else None) for i in range(90)]
    rows += [("x", rows[3][1], [], 5), ("y", rows[3][1], ["a"], 5), ("z", None, ["a"], 5), ("zero", [0.0] * 4, ["a"], 5), ("short", rows[5][1][:2], ["a"], 5)]
    df = spark.createDataFrame(rows, "id string, v array<double>, entities array<string>, at long")
    pairs = vectors.hybrid_pairs(df, 0.8).collect()
    wanted = {}
    for r in pairs:
        for x in (r.a, r.b):
            wanted.setdefault(x, []).append(r.similarity)
    per, edges = vectors.hybrid_degrees(df, 0.8, groups)
    got = per.collect()
    assert len(wanted) > 30 and {r.id: r.links for r in got} == {x: len(s) for x, s in wanted.items()}
    assert all(abs(r.most - max(wanted[r.id])) < 1e-9 for r in got) and abs(sum(r.total for r in got) - sum(r.similarity for r in pairs)) < 1e-6
    joined = lambda e: {(r.node, r.component) for r in graph.components(e).collect()}
    assert joined(edges) == joined(spark.createDataFrame(pairs).select("a", "b")) and edges.count() < len(pairs)
    assert vectors.hybrid_degrees(df.limit(0), 0.8)[0].count() == 0


def test_copies_of_a_vector_give_rows_not_pairs(spark):
    df = spark.createDataFrame([(i, [1.0, 0.0], ["a"], 0) for i in range(1500)], "id long, v array<double>, entities array<string>, at long")
    per, edges = vectors.hybrid_degrees(df, 0.8)
    assert {(r.links, r.most) for r in per.collect()} == {(1499, 1.0)} and edges.count() <= 3000


@pytest.mark.parametrize(("group_rows", "seed"), [(1000, 4), (9, 5), (3, 6)])
def test_degrees_and_links_are_those_of_all_pairs(spark, group_rows, seed):
    rng = np.random.default_rng(seed)
    bases = [rng.choice(40, 12, replace=False).tolist() for _ in range(6)]
    rows = []
    for i in range(120):
        words = list(bases[i % 6])
        for _ in range(int(rng.integers(0, 4))):
            words[int(rng.integers(0, 12))] = int(rng.integers(0, 60))
        rows.append((i, [str(w) for w in words]))
    rows += [(120, rows[0][1]), (121, rows[0][1]), (122, []), (123, None)]
    df = spark.createDataFrame(rows, "id long, tokens array<string>")
    sets = {i: set(w) for i, w in rows if w}
    for t in (0.5, 0.8):
        pairs = {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t}
        wanted = {i: (min(j for j in sets if sets[j] == s), sum(i in p for p in pairs)) for i, s in sets.items()}
        assert {r.id: (r.class_id, r.links) for r in dedup.jaccard_degrees(df, t, group_rows).collect()} == wanted
        joined = lambda e: {(r.node, r.component) for r in graph.components(e).collect()}
        links = dedup.jaccard_links(df, t)
        assert joined(links) == joined(spark.createDataFrame(sorted(pairs), "a long, b long")) and links.count() < len(pairs)


@pytest.mark.parametrize(("hot", "tile", "days", "seed"), [(5, 16, 7, 1), (1000, 16, 7, 2), (0, 7, 3, 3), (2, 8192, 0, 4)])
def test_shared_entities_are_those_of_all_pairs(spark, hot, tile, days, seed):
    rng = np.random.default_rng(seed)
    start = datetime.date(2024, 1, 1)
    rows = [(int(i), start + datetime.timedelta(int(i * 7 % 40)), [f"s{rng.integers(3)}", f"p{rng.integers(4)}", f"c{rng.integers(60)}", None]) for i in rng.integers(0, 90, 150)]
    rows += [(3, start + datetime.timedelta(25), ["s1", "p1"]), (3, start + datetime.timedelta(27), ["s1"]), (200, None, ["s1"]), (201, start, []), (202, start, None)]
    met = {}
    for i, day, held in rows:
        for j, other_day, other in rows:
            if day and other_day and held and other and (other_day, j) < (day, i) and (day - other_day).days <= days:
                n = len((set(held) & set(other)) - {None})
                if n:
                    was = met.get((i, j), (0, other_day))
                    met[i, j] = (was[0] + n, min(was[1], other_day))
    wanted = {}
    for (i, j), (n, day) in met.items():
        if n >= 2:
            wanted[i] = min(wanted.get(i, (0,)), (-n, day, j))
    df = spark.createDataFrame(rows, "id int, at date, entities array<string>")
    got = {r.id: r.canonical for r in events.same_entities(df, 2, days, hot, tile).collect()}
    assert len(wanted) > 10 and got == {i: w[2] for i, w in wanted.items()}


@pytest.mark.parametrize(("group_rows", "seed"), [(1000, 1), (20, 2), (7, 3)])
def test_cosine_degrees_and_groups_are_those_of_all_pairs(spark, group_rows, seed):
    rng = np.random.default_rng(seed)
    heads = rng.choice(30, (5, 6))
    rows = [(i, [f"w{k}" for k in heads[i % 5]] * 2 + [f"w{k}" for k in rng.integers(0, 40, 3)]) for i in range(100)] + [(100, ["w1", "w2"]), (101, ["w1", "w2"]), (102, [])]
    rows += [(103 + i, rows[7][1]) for i in range(30)]
    found = similarity.tfidf(spark.createDataFrame(rows, "id long, tokens array<string>"))
    vectors_of = {r.id: {x.term: x.w for x in r.v} for r in found.collect()}
    dot = lambda a, b: sum(w * vectors_of[b].get(t, 0.0) for t, w in vectors_of[a].items())
    pairs = {(a, b) for a in vectors_of for b in vectors_of if a < b and dot(a, b) >= 0.7}
    got = {r.id: (r.class_id, r.links) for r in similarity.cosine_degrees(found, 0.7, group_rows).collect()}
    assert len(pairs) > 100 and {i: n for i, (_, n) in got.items()} == {i: sum(i in p for p in pairs) for i in vectors_of}
    assert {i for i, (c, _) in got.items() if c == 7} == {7, *range(103, 133)}
    joined = {(r.node, r.component) for r in graph.components(spark.createDataFrame(sorted(pairs), "a long, b long")).collect()}
    assert {(r.id, r.component) for r in similarity.cosine_groups(found, 0.7, group_rows).collect()} == joined


def test_co_occurring_pairs_are_counted_in_bounded_parts(spark, monkeypatch):
    monkeypatch.setattr(joins, "PART_PAIRS", 50)
    rows = [(c, (c * 7 + k * k) % 23) for c in range(60) for k in range(6)] + [(1, None), (None, 2), (3, 4), (3, 4)]
    held = {}
    for c, m in rows:
        if c is not None and m is not None:
            held.setdefault(c, set()).add(m)
    wanted = Counter((a, b) for ms in held.values() for a in ms for b in ms if a < b)
    found = joins.co_occurrence(spark.createDataFrame(rows, "c int, m int"), "c", "m", 2)
    parts = math.ceil(sum(len(ms) * (len(ms) - 1) // 2 for ms in held.values()) / 50)
    assert f", {parts})" in found._jdf.queryExecution().toString() and parts > 10
    assert {(r.a, r.b): r.contexts for r in found.collect()} == {p: n for p, n in wanted.items() if n >= 2}


def test_equal_entities_are_merged_into_the_first_alone(spark):
    rows = [(i, "Jo Day", "person", None) for i in range(500)] + [(500, "Gov. Jo Day", "person", None), (501, "Gov. Jo Day", "person", None), (502, "Jo Day", None, None), (503, None, "person", ["x"])]
    got = {(r.a, r.b): (r.confidence, r.reason) for r in entities.merge_candidates(spark.createDataFrame(rows, "id int, name string, type string, aliases array<string>")).collect()}
    assert got == {(0, i): (0.95, "alias") for i in range(1, 500)} | {(0, 500): (0.9, "bare name"), (500, 501): (0.95, "alias")}


def test_a_model_is_called_on_slices_of_a_batch(spark):
    size = models.text_model(lambda batch: batch.map(lambda _: len(batch)), "int")
    found = [r[0] for r in spark.range(3000).coalesce(1).select(size(F.col("id").cast("string"))).collect()]
    assert len(found) == 3000 and max(found) <= 256
    one = spark.createDataFrame([(1, "A b " * 300), (2, None)], "id int, text string").select("id", models.hash_embedding(16, 3)(F.col("text")).alias("v"))
    same = spark.createDataFrame([(1, "a b a"), (2, "")], "id int, text string").select("id", models.hash_embedding(16, 3)(F.col("text")).alias("v"))
    assert sorted(one.collect()) == sorted(same.collect())


def test_edges_of_components_are_contracted(spark, monkeypatch):
    tables = []

    def kept(df, name):
        out = written(df, name)
        tables.append((name, out.count()))
        return out

    written = graph.written
    monkeypatch.setattr(graph, "written", kept)
    pairs = [(i, i + 1) for i in range(300)] + [(1000 + i % 40, 2000 + i * 7 % 90) for i in range(900)] + [(5000, 5000), (None, 9999)]
    found = {r.node: r.component for r in graph.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert all(found[i] == 0 for i in range(301)) and found[5000] == 5000 and 9999 not in found
    left = [n for name, n in tables if name == "edges"]
    assert left[-1] == 0 and len(left) <= 3 and sum(left) < len(pairs) / 4 and len(tables) < 25


def test_suppliers_and_customers_are_merge_candidates(spark, sf_dir):
    names = {}
    for table, key, label in (("supplier", "s_suppkey", "s"), ("customer", "c_custkey", "c")):
        names |= {f"{label}{r[0]}": r[1].lower() for r in spark.read.parquet(f"{sf_dir}/{table}.parquet").select(key, f"{label}_name").collect()}
    held = {i: {n[k : k + 2] for k in range(len(n) - 1)} for i, n in names.items()}
    dice = lambda a, b: 2 * len(held[a] & held[b]) / (len(held[a]) + len(held[b]))
    wanted = {(a, b): dice(a, b) * 0.8 for a in names for b in names if a < b and dice(a, b) > 0.9}
    got = {(r.a, r.b): r.confidence for r in flows.merge_candidates(spark, sf_dir).collect()}
    assert {a[0] for p in got for a in p} == {"s", "c"} and got.keys() == wanted.keys()
    assert all(abs(s - wanted[p]) < 1e-9 for p, s in got.items())


def test_sets_are_compact_and_compared_by_parities_first(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [f"w{k}" for k in rng.zipf(1.3, 30) % 500], ["x"] if i % 5 else []) for i in range(40)] + [(40, ["w1", "w2"], []), (41, ["w2", "w1", "w1"], []), (42, ["w1", "w2"], ["x"]), (43, [], []), (44, None, [])]
    members, found = sets.token_sets(spark.createDataFrame(rows, "id long, tokens array<string>, more array<string>"), "more", frequent=5)
    held = {i: set(w) for i, w, _ in rows if w}
    per = {r.rep: r for r in found.collect()}
    assert {r.id: r.rep for r in members.collect()} == {i: i for i in held} | {41: 40} and dict(found.dtypes)["known"] == "array<smallint>"
    assert all(r.size == len(r.known) + len(r.other) == len(held[i]) for i, r in per.items())
    df = Counter(w for r in per.values() for w in held[r.rep])
    assert len({k for r in per.values() for k in r.known}) == 5 and all(list(r.known) == sorted(r.known) for r in per.values())
    assert sum(len(r.known) for r in per.values()) >= sum(n for _, n in df.most_common(4))
    pairs = found.select(F.col("rep").alias("a")).join(found.select(F.col("rep").alias("b")))
    bits = sets.with_sets(pairs, found, "a", "b")
    for x in ("a", "b"):
        bits = bits.join(found.select(F.col("rep").alias(x), *(F.col(c).alias(f"{c}_{x}") for c in sets.BITS)), x)
    got = bits.select("a", "b", sets.common("a", "b").alias("c"), sets.apart("a", "b").alias("d")).collect()
    assert len(got) == len(per) ** 2 and all(r.c == len(held[r.a] & held[r.b]) and r.d <= len(held[r.a] ^ held[r.b]) for r in got)
    assert sum(r.d > 0 for r in got) > len(got) / 2
