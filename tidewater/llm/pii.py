"""Personal data by fixed patterns, and by bootstrapped contexts.

Seeds are the spans of four patterns: email, ip, card and phone. Every seed and every other token with a digit or an @ is
an instance of the lexical patterns around it: the word before, the two words before, the word after, the words on both
sides, and the word before together with the shape of the token (digits as 0, letters as a, runs as one). Spark scores the
graph of patterns and instances in rounds: a pattern is worth the mean of its distinct instances, an instance the most
that a trusted pattern gives it, and seeds are always worth one. Tokens that patterns of high confidence point at are
added as spans of kind found.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.common import map_batches, materialize, read_table

KINDS = ("email", "ip", "card", "phone", "found")
ROUNDS = 3
SUPPORT, TRUST, CONFIDENCE = 4, 0.6, 0.8  # distinct instances of a pattern, its worth to give worth to others, and at the end to add spans
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its start fails from its middle too, so the run is taken whole
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"(?<!\S)[^\s]*[0-9@][^\s]*")
_EDGE = "\"'()[]{}<>,;:.!?*#%&$|"
_SPANS = "array<struct<kind:int,start:int,end:int>>"
_CANDS = "array<struct<start:int,end:int,instance:string,seed:boolean,patterns:array<string>>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the leftmost non-overlapping matches of each kind, by kind and start; failing ones dropped."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at)):
            out.append((1, start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    out += [(2, m.start(), m.end()) for m in _IP.finditer(text) if all(len(p) < 4 and int(p or 0) <= 255 for p in (x.lstrip("0") for x in m[0].split(".")))]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13 and 13 <= len(d := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(d):
            out.append((3, m.start(), m.end()))
    if "+" in text:
        out += [(4, m.start(), m.end()) for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def _near(text: str, at: int, step: int, n: int) -> list[str]:
    """The n whole words before (step -1) or after (step 1) a place, in the order of the text."""
    width = 64
    while True:
        part = text[max(0, at - width) : at] if step < 0 else text[at : at + width]
        words = part.split()
        cut = len(part) == width and (not part[0].isspace() if step < 0 else not part[-1].isspace())  # its outermost word may go on
        whole = words[cut:] if step < 0 else words[: len(words) - cut]
        if len(whole) >= n or len(part) < width:
            return whole[-n:] if step < 0 else whole[:n]
        width *= 2


def shape(token: str) -> str:
    """Letters as a and digits as 0, each run as one; other marks as they are."""
    return re.sub(r"a+", "a", re.sub(r"[^\W\d_]", "a", re.sub(r"\d+", "0", token)))


def patterns_around(text: str, start: int, end: int) -> list[str]:
    """The patterns of a token, over words that are lower-cased and without marks at their edges; words with digits give none."""
    plain = lambda words: [w for w in (x.strip(_EDGE).lower() for x in words) if w]
    before, after = plain(_near(text, start, -1, 2)), plain(_near(text, end, 1, 1))
    left = before[-1] if before and not any(c.isdigit() for c in before[-1]) else None
    right = after[0] if after and not any(c.isdigit() for c in after[0]) else None
    found = []
    if left:
        found += [f"{left} _", f"{left} _ {shape(text[start:end])}"]
        found += [" ".join(before) + " _"] if len(before) > 1 else []
    if right:
        found.append(f"_ {right}")
    return [*found, f"{left} _ _ {right}"] if left and right else found


def candidates(text: str, base: list[tuple[int, int, int]]) -> list[dict]:
    """Seeds and other tokens with a digit or an @, with their instance and patterns; tokens never overlap a seed."""
    out, spans = [], sorted((s, e) for _, s, e in base)
    for s, e in spans:
        out.append((s, e, True))
    k = 0
    for m in _TOKEN.finditer(text) if base or any(c in text for c in "0123456789@") else ():
        token = m[0]
        s = m.start() + len(token) - len(token.lstrip(_EDGE))
        e = m.end() - len(token) + len(token.rstrip(_EDGE))
        while k < len(spans) and spans[k][1] <= s:
            k += 1
        if e > s and not (k < len(spans) and spans[k][0] < e):
            out.append((s, e, False))
    found = []
    for s, e, seed in out:
        if near := patterns_around(text, s, e):
            found.append({"start": s, "end": e, "instance": hashlib.md5(text[s:e].encode()).hexdigest(), "seed": seed, "patterns": near})
    return found


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("kind", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))
    cand = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("instance", pa.string()), ("seed", pa.bool_()), ("patterns", pa.list_(pa.string()))]))
    for batch in batches:
        keys, spans, cands = [], [], []
        for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base = base_spans(text or "")
            found = candidates(text or "", base)
            spans.append([{"kind": k, "start": s, "end": e} for k, s, e in base])
            cands.append(found)
            keys.append(hashlib.sha256(f"{doc_id}:{text}".encode()).hexdigest() if found else None)
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(keys, pa.string()), pa.array(spans, kind), pa.array(cands, cand)], ["doc_id", "key", "base", "cands"])


def score_patterns(edges: DataFrame) -> DataFrame:
    """(pattern, worth, instances) of edges(pattern, instance, seed) after ROUNDS rounds.

    Each round is two aggregates. The tables that are joined are written first, so that both sides are shuffled and a
    pattern or an instance with very many edges is split.
    """
    edges = materialize(edges.groupBy("pattern", "instance").agg(F.max("seed").alias("seed")), "edges")
    weighed = edges.withColumn("worth", F.col("seed").cast("double"))
    for n in range(ROUNDS):
        patterns = materialize(weighed.groupBy("pattern").agg(F.avg("worth").alias("worth"), F.count(F.lit(1)).alias("instances")), "patterns")
        if n == ROUNDS - 1:
            return patterns
        trusted = patterns.where((F.col("worth") >= TRUST) & (F.col("instances") >= SUPPORT)).select("pattern", "worth")
        best = materialize(edges.join(trusted, "pattern").groupBy("instance").agg(F.max("worth").alias("best")), "instances")
        weighed = edges.join(best, "instance", "left").select("pattern", "instance", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("best", F.lit(0.0))).alias("worth"))
    raise AssertionError("there is at least one round")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added) for every row of docs(doc_id, text, ...): spans (kind, start, end) in code points.

    kind numbers KINDS from 1; base holds the first four by kind and start, added those of kind found. Defined cases: a
    null text is an empty one; repeated rows get equal results and count once as instances; no rows give no rows; other
    columns are ignored.
    """
    ident = dict(docs.dtypes)["doc_id"]
    found = materialize(map_batches(docs.select("doc_id", "text"), _scan, f"doc_id {ident}, key string, base {_SPANS}, cands {_CANDS}"), "spans")
    some = found.where("key is not null")
    cands = materialize(some.select("key", F.explode("cands").alias("c")).select("key", "c.*").distinct(), "cands")
    each = cands.select("key", "start", "end", "instance", "seed", F.explode("patterns").alias("pattern"))
    patterns = score_patterns(each.select("pattern", "instance", "seed"))
    sure = materialize(patterns.where((F.col("worth") >= CONFIDENCE) & (F.col("instances") >= SUPPORT)).select("pattern"), "trusted")
    new = each.where("not seed").join(sure, "pattern").select("key", "start", "end").distinct()
    added = new.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(F.lit(len(KINDS)).alias("kind"), "start", "end"))).alias("added"))
    none = F.expr("filter(base, s -> false)")
    out = some.join(added, "key", "left").select("doc_id", "base", F.coalesce("added", none).alias("added"))
    return out.union(found.where("key is null").select("doc_id", "base", none.alias("added")))


def listed(spans: Column) -> Column:
    """kind:start:end by kind and then start, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"]), s["start"], s["end"])), ",")


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(read_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = {k + 1}))").cast("long").alias(f"n_{KINDS[k]}") for k in range(4)]
    added, every = F.size("added").cast("long").alias("n_found"), (F.size("base") + F.size("added")).cast("long").alias("n_spans")
    base = F.size("base").cast("long").alias("n_base")
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"), base, added, every)
