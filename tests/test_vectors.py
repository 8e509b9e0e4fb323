"""Vector joins against all pairs in numpy, on cells and tiles of a few rows."""

import math

import numpy as np
import pytest

from tidewater.operators import vectors


def unit(v):
    n = math.sqrt(sum(x * x for x in v))
    return [x / n for x in v] if n else list(v)


@pytest.mark.parametrize(("least", "tile"), [(0.9, 7), (0.5, 5), (-0.2, 40), (0.99, 1000)])
def test_links_against_all_pairs(spark, least, tile):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 5))
    rows = [(int(i), (centres[i % 6] + rng.normal(size=5) * rng.choice([0.05, 0.6])).tolist()) for i in range(90)]
    rows += [(90, rows[3][1]), (91, rows[3][1]), (92, None), (93, [0.0] * 5), (94, []), (95, rows[5][1][:3])]
    members, pairs = vectors.cosine_links(spark.createDataFrame(rows, "id long, v array<double>"), least, tile)
    rep = {r.id: r.rep for r in members.collect()}
    assert rep[90] == rep[91] == 3 and 92 not in rep
    got = {(r.a, r.b): r.cosine for r in pairs.collect()}
    known = {i: unit([*v, *[0.0] * (5 - len(v))]) for i, v in rows if v is not None and rep[i] == i}
    wanted = {(a, b): float(np.dot(known[a], known[b])) for a in known for b in known if a < b}
    assert len(pairs.collect()) == len(got)
    assert {p for p, s in wanted.items() if s >= least} == set(got) and all(abs(wanted[p] - s) < 1e-9 for p, s in got.items())


def test_hybrid_pairs(spark):
    rows = [(1, [1.0, 0.0], ["a"], 0), (2, [1.0, 0.0], ["a", "b"], 1800), (3, [0.9, 0.1], None, 10_000_000), (4, None, ["a"], 0), (5, [-1.0, 0.0], ["a"], 0), (6, [0.0, 1.0], [], None)]
    df = spark.createDataFrame(rows, "id long, v array<double>, entities array<string>, at long")
    got = {(r.a, r.b): round(r.similarity, 6) for r in vectors.hybrid_pairs(df, 0.8).collect()}
    near = round(0.85 * (0.9 / math.sqrt(0.82) + 1) / 2, 6)
    assert got == {(1, 2): 0.95, (1, 3): near, (2, 3): near}
    with pytest.raises(ValueError):
        vectors.hybrid_pairs(df, 0.5)
    assert vectors.hybrid_pairs(df.limit(0), 0.8).count() == 0


@pytest.mark.parametrize("tile", [3, 1000])
def test_nearest_against_all(spark, tile):
    rng = np.random.default_rng(9)
    rows = [(i, rng.integers(-2, 3, size=3).astype(float).tolist(), "ab"[i % 2] if i % 9 else None) for i in range(40)] + [(40, None, "a"), (41, [0.0] * 3, "a"), (42, [1.0], "b")]
    df = spark.createDataFrame(rows, "id long, v array<double>, label string")
    for same in ([], ["label"]):
        wanted = {}
        for i, v, g in rows:
            if i % 4 == 0 and v is not None and (not same or g is not None):
                near = [(-round(float(np.dot(unit([*v, 0.0, 0.0][:3]), unit([*w, 0.0, 0.0][:3]))), 12), j) for j, w, h in rows if j != i and w is not None and (not same or g == h)]
                wanted[i] = [j for _, j in sorted(near)[:5]]
        got = {}
        for r in sorted(vectors.nearest(df.where("id % 4 = 0"), df, 5, same, tile).collect(), key=lambda r: (r.query_id, r["rank"])):
            got.setdefault(r.query_id, []).append((r.vec_id, r.similarity))
        assert set(got) == set(wanted)
        for q, found in got.items():  # rounding may order equal ones anew
            score = {j: float(np.dot(unit([*rows[q][1], 0.0, 0.0][:3]), unit([*rows[j][1], 0.0, 0.0][:3]))) for j, _ in found}
            assert all(abs(score[j] - s) < 1e-9 for j, s in found)
            assert np.allclose([s for _, s in found], [float(np.dot(unit([*rows[q][1], 0.0, 0.0][:3]), unit([*rows[j][1], 0.0, 0.0][:3]))) for j in wanted[q]])
    assert vectors.nearest(df.limit(0), df, 3).count() == 0
