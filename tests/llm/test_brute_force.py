"""Operators that no SQL states, against plain brute force on small fixtures, and classifiers on rows held out."""

import math
import random
import re
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidewater.llm import boosting, classify, decontaminate, mixing, near_dedup, pii, secrets
from tidewater.llm import queries as llm
from tidewater.llm.common import split_by_keys
from tidewater.llm.components import connected_components
from tidewater.llm.features import COMMON, lexicon, toxicity_features


def edit_distance_in(needle, hay):
    """Least edits between needle and any stretch of hay."""
    before = [0] * (len(hay) + 1)
    for i, a in enumerate(needle, 1):
        now = [i]
        for j, b in enumerate(hay, 1):
            now.append(min(before[j] + 1, now[-1] + 1, before[j - 1] + (a != b)))
        before = now
    return min(before)


def test_decontamination_finds_edited_passages_only():
    rng = random.Random(2)
    word = lambda: "".join(rng.choices("etaoinshr", k=rng.randint(2, 8)))
    items = [(i, " ".join(word() for _ in range(rng.randint(12, 60)))) for i in range(12)]

    def edited(text, n):
        chars = list(text)
        for _ in range(n):
            k = rng.randrange(len(chars))
            chars[k : k + 1] = rng.choice([[], [rng.choice("xyz")], [chars[k], rng.choice("xyz")]])
        return "".join(chars)

    texts = []
    for i, item in items:
        for share in (0, 0.02, 0.05, 0.3):
            filler = " ".join(word() for _ in range(80))
            texts.append(f"{filler} {edited(item, int(len(item) * share))} {filler}".upper() if i % 2 else f"{filler}\n{edited(item, int(len(item) * share))}\n\t{filler}")
    texts += [" ".join(word() for _ in range(300)) for _ in range(10)]
    index = decontaminate.Index(items)
    got = {(row, index.items[item]) for row, item, *_ in index.matches(pa.array(texts))}
    plain = lambda t: re.sub(r"\s+", " ", t.lower())
    wanted = set()
    for row, text in enumerate(texts):
        for item in {items[row // 4][0]} if row < 48 else {0, 1}:
            hit = any(edit_distance_in("".join(map(chr, w)), plain(text)) <= k for w, o, k in zip(index.windows, index.owner, index.edits, strict=True) if index.items[o] == item)
            if hit:
                wanted.add((row, item))
    assert got == wanted and len(wanted) >= 30


def test_decontamination_finds_every_passage_and_edited_short_items():
    rng = random.Random(12)
    words = lambda n: " ".join("".join(rng.choices("etaoinshr", k=rng.randint(2, 8))) for _ in range(n))

    def edited(text, n):
        chars = list(text)
        for _ in range(n):
            k = rng.randrange(len(chars))
            chars[k : k + 1] = rng.choice([[], ["x"], [chars[k], "x"]])
        return "".join(chars)

    whole = words(60)[:233]
    short = {n: words(40)[:n].replace(" ", "e") for n in range(decontaminate.Q, 161)}
    items = [(0, whole), *short.items()]
    index = decontaminate.Index(items)
    size, most = 99, 6
    passages = [whole[s : s + n] for n in (size, 168) for s in range(len(whole) - n + 1)]
    texts = [(0, p) for p in passages] + [(0, edited(p, most)) for p in passages] + [(n, edited(s, int(n * decontaminate.EDITS))) for n, s in short.items() for _ in range(20)]
    got = {(row, index.items[item]) for row, item, *_ in index.matches(pa.array([f"{words(9)} {text} {words(9)}" for _, text in texts]))}
    assert not [(n, text) for row, (n, text) in enumerate(texts) if (row, n) not in got]
    assert not list(index.matches(pa.array([words(60) for _ in range(300)])))


def test_decontamination_of_equal_letters_takes_little_memory():
    index = decontaminate.Index([(5, "a" * 80), (99, "b" * 30)])
    tracemalloc.start()
    got = sorted(index.matches(pa.array(["a" * 200_000, "b" * 29, None])))
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()
    assert [(r, i, s, e, k) for r, i, s, e, k, _ in got] == [(0, 0, 0, 200_000, 0), (1, 1, 0, 29, 1)]


@pytest.mark.parametrize("kind", ["int", "string", "smallint", "bigint"])
def test_decontamination_keeps_the_kind_of_item_ids(spark, kind):
    item = "the quick brown fox jumps over the lazy dog near the river bank"
    bench = spark.createDataFrame([(7, item)], "item_id int, text string").withColumn("item_id", F.col("item_id").cast(kind))
    out = decontaminate.find_leaks(spark.createDataFrame([(1, f"so {item} it is")], "doc_id long, text string"), bench)
    assert dict(out.dtypes)["item_id"] == kind and str(out.first().item_id) == "7"


def test_banded_distance_against_whole_table():
    rng = random.Random(4)
    for _ in range(60):
        window = [rng.randrange(26) for _ in range(24)]
        copy = list(window)
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(copy))
            copy[k : k + 1] = rng.choice([[], [99], [copy[k], 99]])
        region = [rng.randrange(26) for _ in range(20)] + copy
        region += [rng.randrange(26) for _ in range(24 + 40 - len(region))]
        cost, _ = decontaminate.banded_distance(np.array([window]), np.array([region]), 40)
        assert cost[0] == edit_distance_in(window, region)


@pytest.mark.parametrize("order", ["shuffled", "falling"])
def test_components_of_long_paths(spark, order):
    nodes = list(range(1000))
    random.Random(6).shuffle(nodes)
    nodes = nodes if order == "shuffled" else [0, *range(999, 0, -1)]
    links = spark.createDataFrame([*zip(nodes, nodes[1:], strict=False), (2000, 2001), (3000, 3000), (None, 5)], "a long, b long")
    assert {r.node: r.label for r in connected_components(links).collect()} == {n: 0 for n in nodes} | {2000: 2000, 2001: 2000, 3000: 3000}


def brute_base(text):
    out = [(1, m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(2, m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()]
        if 13 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x if x < 5 else 2 * x - 9) for i, x in enumerate(reversed(d))) % 10 == 0:
            out.append((3, m.start(), m.end()))
    out += [(4, m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def test_personal_data_spans_against_plain_patterns():
    rng = random.Random(7)
    pieces = ["a@b.c", "_x", "@", ".", "1.2.3.4", "300.1.1.1", "4539578763621486", "4539 5787-6362 1486", "+1 (555) 010-9999", "+", "12", " ", "-", "..", "ä", "é@x.y", "%", "c", "0000000000000", "007.1.2.3", "\n"]
    for _ in range(3000):
        text = "".join(rng.choices(pieces, k=rng.randint(1, 12)))
        assert pii.base_spans(text) == brute_base(text), text
    assert pii.base_spans("9" * 200_000) == [] and pii.base_spans("0" * 5000 + ".1.1.1") == [(2, 0, 5006)] and pii.base_spans("1" * 5000 + ".1.1.1") == [] and pii.base_spans("a" * 200_000 + "@") == []


def test_contexts_give_unseen_identifiers(spark):
    rng = random.Random(1)
    texts = [f"please write to u{rng.randrange(10**6)}@mail.org today" for _ in range(20)] + ["please write to badge-77812 today"] + [f"version {rng.randrange(10**6)} is out" for _ in range(20)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [(texts[r.doc_id][s.start : s.end]) for s in r.added] for r in pii.find_personal_data(docs).collect()}
    assert found[20] == ["badge-77812"] and all(not v for k, v in found.items() if k != 20)


def test_contexts_find_planted_identifiers(spark):
    """Recall and precision over planted identifiers of no fixed pattern, with contexts before, after and around them."""
    rng = random.Random(8)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in "aeiou" for c in "lmnrs"]
    filler = lambda n: " ".join(rng.choices(words, k=n))
    contexts = [("passport number {} issued", 0), ("write to {} soon", 0), ("{} is my line", 0), ("call at {} tonight please", 0)]
    texts, planted, clean = [], {}, set()
    for i in range(400):
        context = contexts[i % 4][0]
        secret = f"u{rng.randrange(10**6)}@mail.org" if i % 3 else f"ID-{rng.randrange(10**7)}x"
        texts.append(f"{filler(12)} {context.format(secret)} {filler(12)}")
        if not i % 3:
            planted[i] = secret
    for i in range(400, 800):
        texts.append(f"{filler(10)} version {rng.randrange(100)} of {filler(10)} {rng.randrange(10**5)} {filler(4)}")
        clean.add(i)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.added] for r in pii.find_personal_data(docs).collect()}
    base = sum(secret in [texts[i][s:e] for _, s, e in pii.base_spans(texts[i])] for i, secret in planted.items())
    caught, wrong = sum(secret in found[i] for i, secret in planted.items()), sum(len(found[i]) for i in clean)
    assert base == 0 and caught >= 0.9 * len(planted) and wrong <= 0.02 * len(clean), (caught, len(planted), wrong)


def test_patterns_are_whole_words():
    long = "z" * 5000
    text = f"one {long} my Badge: 77 (of) {long}"
    at = text.index("77")
    assert pii.patterns_around(text, at, at + 2) == ["badge _", "badge _ 0", "my badge _", "_ of", "badge _ _ of"]
    assert pii._near(text, 4 + 5000, -1, 2) == ["one", long] and pii._near(text, text.index("(of)"), 1, 2) == ["(of)", long]
    assert pii.shape("Ab-12.é9") == "a-0.a0"


def test_near_duplicates_against_all_pairs(spark):
    rng = random.Random(9)
    vocabulary = [f"v{i}" for i in range(3000)]
    docs, n = [], 0
    for size in (1, 3, 4, 9, 30, 120):
        for _ in range(6):
            base = rng.choices(vocabulary, k=size)
            for rate in (0, 0, 0.01, 0.02, 0.04, 0.08):
                docs.append((n, " ".join(rng.choice(vocabulary) if rng.random() < rate else w for w in base)))
                n += 1
    passage = rng.choices(vocabulary, k=70)
    docs += [(n + i, " ".join(passage + rng.choices(vocabulary, k=40))) for i in range(60)]
    sets = {}
    for i, text in docs:
        w = text.split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(sets[a] & sets[b])
            if 100 * common >= 75 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def test_sets_below_the_threshold_are_not_paired(spark):
    base = [f"w{i}" for i in range(150)]
    texts = []
    for i in range(40):
        edited = list(base)
        for k in (3 + i, 53 + i, 103 + i):
            edited[k] = f"own{i}x{k}"
        texts.append(" ".join(edited))
    # two that differ in one word only
    texts += [" ".join([*base[:140], f"end{i}", *base[141:]] + ["more"]) for i in range(2)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    sets = docs.select(F.col("doc_id").alias("node"), "doc_id", F.xxhash64("text").alias("text_key"))
    posted = near_dedup._shingle_prefixes(sets.select("node"), near_dedup._full_sets(sets, docs))
    got = {(r.a, r.b) for r in near_dedup._across(posted.withColumn("label", F.col("node"))).collect()}
    shingles = [{tuple(t.split()[i : i + 5]) for i in range(len(t.split()) - 4)} for t in texts]
    near = {(a, b) for a in range(42) for b in range(a + 1, 42) if 100 * len(shingles[a] & shingles[b]) >= 75 * len(shingles[a] | shingles[b])}
    assert (40, 41) in near and near <= got and len(got) <= len(near) + 40


def test_rows_that_no_key_fits_are_told_apart(spark):
    rows = spark.range(5000).select(F.col("id").cast("int").alias("n"), F.when(F.col("id") % 7 > 0, F.concat(F.lit("t"), "id")).alias("t"))
    keys = rows.where("n % 10 = 0").select(F.col("n").alias("a"), F.xxhash64("t").alias("b"))
    some, others = split_by_keys(rows, keys, a=F.col("n"), b=F.xxhash64("t"))
    held, rest = [r.n for r in some.collect()], [r.n for r in others.collect()]
    assert sorted(held + rest) == list(range(5000)) and set(range(0, 5000, 10)) <= set(held) and len(held) < 520
    some, others = split_by_keys(rows, keys.limit(0), a=F.col("n"), b=F.xxhash64("t"))
    assert some.isEmpty() and others.count() == 5000


def test_mixing_targets_and_sizes(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)), None if i % 50 == 0 else f"s{i % 7}") for i in range(3000)] + [(9000, "w " * 10, "tiny")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(7)
    out = mixing.mix(docs).collect()
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(repr, out)) == sorted(map(repr, again))
    size, taken, target = {}, {}, {}
    for r in out:
        size[r.source] = size.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
        target[r.source] = r.target
    names = sorted((s for s in size if s is not None)) + [None]
    weight = {s: 1 + k % 3 for k, s in enumerate(names)}
    total, share, full = sum(size.values()), 0, set()
    while True:
        share = (total - sum(3 * size[s] for s in full)) / sum(weight[s] for s in names if s not in full)
        new = {s for s in names if s not in full and weight[s] * share > 3 * size[s]}
        if not new:
            break
        full |= new
    for s in names:
        assert target[s] == pytest.approx(3 * size[s] if s in full else weight[s] * share)
        assert abs(taken[s] - target[s]) <= 31
    chosen = mixing.mix(docs, importance=F.when(F.col("doc_id") % 2 == 0, 4).otherwise(1)).where("size > 0").collect()
    mean = lambda odd: np.mean([r.copies for r in chosen if r.doc_id % 2 == odd and r.source == "s0"])
    assert mean(0) > 1.5 * mean(1)
    for s in names:
        assert abs(sum(r.taken for r in chosen if r.source == s) - target[s]) <= 61
    assert max(r.copies for r in chosen) <= 3


def test_mixing_of_rows_without_or_with_one_id(spark):
    """Very many rows that no doc_id tells apart still meet the targets, equal texts or not."""
    rows = [(None, f"w{i} x y z", "a") for i in range(400)] + [(None, "all the same here", "a")] * 600 + [(7, f"v{i} q", "b") for i in range(500)] + [(i, "one two three", "c") for i in range(300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(6)
    out = mixing.mix(docs, importance=mixing.longer_first()).collect()
    assert len(out) == len(rows) and sorted(map(repr, out)) == sorted(map(repr, mixing.mix(docs.repartition(3), importance=mixing.longer_first()).collect()))
    for source in "abc":
        of = [r for r in out if r.source == source]
        assert abs(sum(r.taken for r in of) - of[0].target) <= 8


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(1500, 6))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.3)).astype(int)
    trees = boosting.fit(x[:1000], y[:1000])
    assert ((trees.probability(x[1000:]) > 0.5) == y[1000:]).mean() > 0.95
    for row in x[:20]:  # arrays against a walk
        total = trees.base
        for f, c, leaf in zip(trees.feature, trees.cut, trees.leaf, strict=True):
            k = 0
            while k < len(f):
                k = 2 * k + 1 + (row[f[k]] > c[k])
            total += leaf[k - len(f)]
        assert math.isclose(total, trees.margin(row[None])[0], rel_tol=1e-9)
    knots = boosting.isotonic(np.array([1.0, 2, 3, 4]), np.array([0, 1, 0, 1]))
    assert list(knots[1]) == [0.0, 0.5, 1.0]


@pytest.mark.parametrize(("name", "label", "least"), [("op5_quality_classifier", "quality", 0.9), ("op7_toxicity", "toxic", 0.6)])
def test_held_out_accuracy(spark, sf_dir, name, label, least):
    out = llm.QUERIES[name](spark, sf_dir).join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r[label] for r in out) / len(out) >= least and len(out) > 10


def test_toxicity_learns_words_of_any_language(spark):
    rng = random.Random(0)
    clean, bad = [f"mot{i}" for i in range(300)], ["zargul", "zargulen", "zarguly", "zargule"]
    rows, labels = [], []
    for i in range(400):
        words = rng.choices(clean, k=60)
        toxic = i % 5 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    docs, known = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    out = classify.score_toxicity(docs, known).withColumn("h", classify.held_out(F.col("doc_id"))).where("h").collect()
    assert all((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in out)
    disguised = pa.array(["you are such an 1d10t today", "what an i.d.i.o.t he is", "a perfectly fine day out", "STUUUUPID!", "", None, "id!ot and $tupid, sir!", "great!", "idea"])
    x = np.concatenate(list(toxicity_features(disguised, lexicon([np.zeros(0, np.uint64)]), 1)))
    assert list(x[:, len(COMMON)]) == [1, 1, 0, 1, 0, 0, 2, 0, 0]


def test_pipeline_against_its_parts(spark, sf_dir):
    """The whole run against the decisions of the operators, taken one after another in plain Python."""
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    frame = lambda kept: spark.createDataFrame([docs[i] for i in sorted(kept)], spark.read.parquet(f"{sf_dir}/documents.parquet").schema)
    kept = {r.doc_id for r in classify.score_toxicity(frame(docs), spark.read.parquet(f"{sf_dir}/labels.parquet")).collect() if r.score < 0.3}
    kept = {r.doc_id for r in near_dedup.near_duplicates(frame(kept)).collect() if r.kept}
    kept -= {r.doc_id for r in decontaminate.find_leaks(frame(kept), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    out = {r.doc_id: r for r in corpus_pipeline.run(spark, sf_dir).collect()}
    clean = secrets.redact_secrets(frame(kept))  # random numbers of the mix follow the texts as they are then
    wanted = {r.doc_id: r.copies for r in mixing.mix(clean, importance=mixing.longer_first()).collect() if r.copies}
    assert set(out) == set(wanted)
    taken, target = {}, {r.source: r.target for r in out.values()}
    for r in out.values():
        taken[r.source] = taken.get(r.source, 0) + r.taken
    assert all(abs(taken[s] - target[s]) <= max(r["size"] for r in out.values()) for s in target)
