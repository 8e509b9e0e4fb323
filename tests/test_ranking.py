"""Stems of published examples, and ranked retrieval against scores of all documents in plain Python."""

import math
import random
import re
import uuid
from collections import Counter

import pytest

from tidewater.functions.stem import porter, vocabulary
from tidewater.operators import ranking

# fixed values: examples of the published steps
EXAMPLES = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat",
    "troubled": "troubl", "sized": "size", "hopping": "hop", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky",
    "relational": "relat", "conditional": "condit", "rational": "ration", "digitizer": "digit", "radically": "radic", "vietnamization": "vietnam", "operator": "oper", "decisiveness": "decis",
    "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electrical": "electr", "hopeful": "hope", "goodness": "good", "revival": "reviv", "allowance": "allow", "adjustable": "adjust",
    "replacement": "replac", "adoption": "adopt", "homologous": "homolog", "bowdlerize": "bowdler", "probate": "probat", "rate": "rate", "cease": "ceas", "controll": "control", "roll": "roll", "is": "is",
}


def test_published_stems(spark):
    assert {w: porter(w) for w in EXAMPLES} == EXAMPLES
    words = spark.createDataFrame([(w,) for w in ["hopping", "hopping", "née", "x1", None]], "word string")
    assert {r.word: r.stem for r in vocabulary(words).collect()} == {"hopping": "hop", "née": "née", "x1": "x1"}


def plain(docs, queries, k, stem):
    cut = lambda t: [stem(w) if w.isalpha() else w for w in re.findall("[a-z0-9]{2,}", (t or "").lower())]
    words = {i: cut(t) for i, t in docs}
    mean = sum(map(len, words.values())) / len(words)
    df = Counter(w for ws in words.values() for w in set(ws))
    out = []
    for q, text in queries:
        scores = {}
        for i, ws in words.items():
            tf = Counter(ws)
            s = sum(math.log(1 + (len(words) - df[w] + 0.5) / (df[w] + 0.5)) * tf[w] * 2.2 / (tf[w] + 1.2 * (0.25 + 0.75 * len(ws) / mean)) for w in set(cut(text)) if w in tf)
            if s:
                scores[i] = s
        best = sorted(scores, key=lambda i: (-round(scores[i], 8), i))[:k]
        out += [(q, n + 1, i, round(scores[i], 6)) for n, i in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("stemmed", [True, False])
def test_search_against_all_documents(spark, tmp_path, stemmed):
    rng = random.Random(8)
    words = "motor motors motoring sky skies hop hopping hoped rate rates x1 y2 control controlled nothing".split()
    docs = [(i, " ".join(rng.choices(words, k=rng.randint(1, 30)))) for i in range(300)] + [(300, None), (301, ""), (302, "only here")]
    queries = [(1, "motoring skies"), (2, "hoping rates x1"), (3, "absent"), (4, None), (5, "only sky sky Sky"), (6, "nothing")]
    index = ranking.build(spark.createDataFrame(docs, "id long, text string"), f"file://{tmp_path}/{uuid.uuid4().hex}", stemmed, buckets=4, block_rows=20)
    got = ranking.search(index, spark.createDataFrame(queries, "query_id long, text string"), 7)
    assert sorted((r.query_id, r.rank, r.id, round(r.score, 6)) for r in got.collect()) == plain(docs, queries, 7, porter if stemmed else str)


def test_empty_index(spark, tmp_path):
    none = spark.createDataFrame([], "id long, text string")
    index = ranking.build(none, f"file://{tmp_path}/none", block_rows=5)
    assert ranking.search(index, spark.createDataFrame([(1, "a word")], "query_id long, text string"), 3).count() == 0


def test_an_index_is_built_without_work_tables(spark, tmp_path, monkeypatch):
    def refused(df, name):
        raise AssertionError(f"{name} is written beside the index")

    monkeypatch.setattr(ranking, "written", refused)
    docs = [(1, "sky sky motor"), (1, "sky sky hop"), (2, None), (3, "hop")]  # rows of one id and length are one document
    index = ranking.build(spark.createDataFrame(docs, "id int, text string"), f"file://{tmp_path}/one", buckets=2, block_rows=2)
    found = {(r.term, r.id, r.n, r.tf) for r in index.read(spark, "postings").collect()}
    assert found == {("sky", 1, 3, 4), ("motor", 1, 3, 1), ("hop", 1, 3, 1), ("hop", 3, 1, 1)} and (index.docs, index.mean) == (4, 1.75)
