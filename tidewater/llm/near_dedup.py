"""MinHash near-deduplication by an inverted join on signature coordinates.

Every distinct shingle set gets a signature of COORDS MinHash values. A pair whose sets have a Jaccard similarity of
0.75 agrees in 96 of 128 coordinates on average, with a deviation of 4.9, so a pair that agrees in fewer than MIN_HITS
= 76 is lost with a probability of about 3e-5 at the threshold itself and practically never above it.

1. Screen: sets are posted under their first SCREEN coordinates; a set that meets others in fewer than SCREEN_HITS of
   them can't reach the threshold (probability below 1e-6) and posts nothing more.
2. Prefix: the rest are posted under all coordinates, values that nobody shares are dropped, and each set keeps only
   its COORDS - MIN_HITS + 1 rarest postings: two sets with MIN_HITS agreements must meet in those.
3. Skip merging: long posting lists are never expanded into all their pairs. Members are first compared with a centre
   of each list; lists whose members then lie in one component are skipped. Sets that still meet across components are
   posted under their shingles with the exact prefix bound, compared with several centres of each list, and only what is
   then left across components is paired, where the sizes of two sets and the place of the shingle in them allow it.
4. Every candidate's agreements are counted over whole signatures, and what reaches MIN_HITS is confirmed on the full
   shingle sets.

Exact copies (equal shingle sets) are collapsed first, so groups of copies cost one row. Each such class is one node,
numbered when the classes are written. Texts are dealt out once, to make the shingle sets of the classes that pass the
screen. Counts of posting lists and their centres are written before they are joined, so that both sides of each join
are plain shuffles and a list that very many sets hold is split.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import map_batches, materialize, mix64, read_table, split_by_keys
from tidewater.llm.components import connected_components, extended
from tidewater.llm.shingles import coordinates, shingle_sets, signature

COORDS, MIN_HITS, SCREEN, SCREEN_HITS, WIDTH, PERCENT = 128, 76, 32, 12, 5, 75
CENTRES = (1, 16)  # of a posting list, in the turns of step 3
SKETCH = 1024  # bits of parity by which sets are told apart before they are paired


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    a, b = coordinates(COORDS)
    for batch in batches:
        size, h1, h2, sigs = [], [], [], []
        for found in shingle_sets(batch.column("text"), WIDTH):
            size.append(len(found))
            with np.errstate(over="ignore"):
                h1.append(int(found.sum().astype(np.int64)) if len(found) else None)
                h2.append(int(mix64(found ^ np.uint64(0x5851F42D4C957F2D)).sum().astype(np.int64)) if len(found) else None)
            sigs.append(signature(found, a, b).view(np.int32) if len(found) else None)
        arrays = [batch.column("doc_id"), batch.column("text_key"), pa.array(size, pa.int64()), pa.array(h1, pa.int64()), pa.array(h2, pa.int64()), pa.array(sigs, pa.list_(pa.int32()))]
        yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "text_key", "n_shingles", "h1", "h2", "sig"])


def _sketch(found: np.ndarray) -> np.ndarray:
    odd = np.bincount((found % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH) % 2
    return np.packbits(odd.astype(bool)).view(np.int64)


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, shingles, sketch): the whole set of every text, and its sketch."""
    for batch in batches:
        sets = list(shingle_sets(batch.column("text"), WIDTH))
        ends = np.cumsum([0, *(len(x) for x in sets)])
        flat = np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)
        sketches = pa.array([_sketch(x) for x in sets], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column("node"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat)), sketches], ["node", "shingles", "sketch"])


def _postings(sets: DataFrame, n: int) -> DataFrame:
    """(node, key): one row for each of the first n coordinates, keyed by coordinate and value."""
    at = F.posexplode(F.slice("sig", 1, n))
    return sets.select("node", at).select("node", (F.shiftleft(F.col("pos").cast("long"), 32) + F.col("col").cast("long")).alias("key"))


def _shared(postings: DataFrame) -> DataFrame:
    return materialize(postings.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "shared")


def _screened(sets: DataFrame) -> DataFrame:
    """The sets that can have a partner, by what they share in the first SCREEN coordinates."""
    few = _postings(sets, SCREEN)
    passed = few.join(_shared(few), "key", "left_semi").groupBy("node").count().where(F.col("count") >= SCREEN_HITS)
    return materialize(sets.join(materialize(passed.select("node"), "passed"), "node", "left_semi"), "screened")


def _full_sets(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, shingles, sketch) of the sets, from the text of one row of each: these texts are dealt out this once."""
    chosen = sets.select("node", F.col("doc_id").alias("d"), F.col("text_key").alias("k"))
    docs, _ = split_by_keys(docs, chosen, d=F.col("doc_id"), k=F.xxhash64("text"))
    met = docs.withColumn("text_key", F.xxhash64("text")).join(chosen, (F.col("doc_id") == F.col("d")) & (F.col("text_key") == F.col("k")))
    texts = met.groupBy("d", "k").agg(F.first("node").alias("node"), F.first("text").alias("text")).select("node", "text")
    return materialize(map_batches(texts, _shingles, "node long, shingles array<long>, sketch array<long>"), "shingle_sets")


def _prefixes(sets: DataFrame) -> DataFrame:
    """(node, key): the rarest COORDS - MIN_HITS + 1 postings of every set that can have a partner."""
    every = _postings(sets, COORDS)
    shared = every.join(_shared(every), "key")
    order = Window.partitionBy("node").orderBy("n", "key")
    ranked = shared.select("node", "key", F.row_number().over(order).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("node")).alias("m"))
    # values that nobody shares come first in the order and take up part of the prefix
    return ranked.where((F.col("m") >= MIN_HITS) & (F.col("r") <= F.col("m") - MIN_HITS + 1)).select("node", "key")


def _verified(pairs: DataFrame, sets: DataFrame, full: DataFrame) -> DataFrame:
    """The pairs (a, b) that agree in MIN_HITS coordinates and then on their full shingle sets."""

    def beside(pairs: DataFrame, table: DataFrame, value: str) -> DataFrame:
        for end in ("a", "b"):
            pairs = pairs.join(table.select(F.col("node").alias(end), F.col(value).alias(f"{value}_{end}")), end)
        return pairs

    agree = F.aggregate(F.zip_with("sig_a", "sig_b", lambda x, y: F.when(x == y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)
    near = materialize(beside(pairs, sets, "sig").where(agree >= MIN_HITS).select("a", "b"), "near")
    common = F.size(F.array_intersect("shingles_a", "shingles_b"))
    union = F.size("shingles_a") + F.size("shingles_b") - common
    return materialize(beside(near, full, "shingles").where(100 * common >= PERCENT * union).select("a", "b"), "links")


def _overlap(sizes: Column) -> Column:
    """The least intersection of two sets, whose sizes together are given, that reaches PERCENT of their union."""
    return F.ceil(PERCENT * sizes / (100 + PERCENT))


def _shingle_prefixes(nodes: DataFrame, full: DataFrame) -> DataFrame:
    """(node, key, size, rest, small, sketch): the shingles that a partner among nodes must share one of, rarest first.

    This is the exact prefix filter. rest counts the shared shingles from this one on. small marks the shorter prefix
    that is enough where the partner is at least as large, since the two must then share more of this set.
    """
    sets = materialize(full.join(materialize(nodes, "nodes"), "node", "left_semi"), "open_sets")
    rows = sets.select("node", F.size("shingles").cast("long").alias("size"), F.explode("shingles").alias("key"))
    shared = rows.join(_shared(rows.select("key")), "key")
    order = Window.partitionBy("node").orderBy("n", "key")
    ranked = shared.select("node", "size", "key", F.row_number().over(order).alias("r"), F.count(F.lit(1)).over(Window.partitionBy("node")).alias("m"))
    ranked = ranked.withColumn("rest", F.col("m") - F.col("r") + 1)
    ranked = ranked.where(F.col("rest") >= F.ceil(PERCENT * F.col("size") / 100))
    ranked = ranked.select("node", "key", "size", "rest", (F.col("rest") >= _overlap(2 * F.col("size"))).alias("small"))
    return ranked.join(sets.select("node", "sketch"), "node")


def _fits(one: str, two: str) -> Column:
    """Whether two postings of a list, with columns named by these endings, can belong to sets that are near."""
    c = lambda name, end: F.col(f"{name}{end}")
    both = c("size", one) + c("size", two)
    differ = sum((F.bit_count(c("sketch", one)[i].bitwiseXOR(c("sketch", two)[i])) for i in range(SKETCH // 64)), F.lit(0))
    return (
        (c("label", one) != c("label", two))
        & (100 * F.least(c("size", one), c("size", two)) >= PERCENT * F.greatest(c("size", one), c("size", two)))
        & (F.least(c("rest", one), c("rest", two)) >= _overlap(both))
        & (differ <= both - 2 * _overlap(both))
    )


def _across(left: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share a posting and whose sizes and places in it allow the overlap."""
    cols = ("node", "label", "size", "rest", "sketch")
    one = left.where("small").select("key", *(F.col(x).alias(f"{x}_1") for x in cols))
    two = left.select("key", *(F.col(x).alias(f"{x}_2") for x in cols))
    fits = _fits("_1", "_2") & (F.struct("size_1", "node_1") < F.struct("size_2", "node_2"))
    return one.join(two, "key").where(fits).select(F.least("node_1", "node_2").alias("a"), F.greatest("node_1", "node_2").alias("b")).distinct()


def _crossing(posted: DataFrame, labels: DataFrame) -> DataFrame:
    """(node, key, label): postings of lists that hold more than one component."""
    marked = materialize(posted.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node")), "marked")
    mixed = marked.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high")
    return materialize(marked.join(materialize(mixed.select("key"), "open_lists"), "key", "left_semi"), "open")


def _to_centres(lists: DataFrame, turn: int) -> DataFrame:
    """Pairs (a, b) of each posting and the CENTRES[turn] centres of its list that lie in other components."""
    n = CENTRES[turn]
    cols = [x for x in ("node", "label", "size", "rest", "sketch") if x in lists.columns]
    part = F.pmod(F.xxhash64(F.lit(-turn - 1), F.col("node")), F.lit(n))
    centres = lists.groupBy("key", part.alias("part")).agg(F.min(F.struct(F.xxhash64(F.col("node"), F.lit(turn)), *cols)).alias("centre"))
    centres = materialize(centres.select("key", *(F.col(f"centre.{x}").alias(f"{x}_c") for x in cols)), "centres")
    joined = lists.join(centres, "key")
    joined = joined.where(_fits("", "_c") if "size" in cols else F.col("label") != F.col("label_c"))
    return joined.select(F.least("node", "node_c").alias("a"), F.greatest("node", "node_c").alias("b")).distinct()


def _components(sets: DataFrame, docs: DataFrame) -> DataFrame:
    """(node, label): the components of all pairs over the threshold, of the nodes that have a link."""
    sets = _screened(sets)
    full = _full_sets(sets, docs)
    posted = materialize(_prefixes(sets), "prefixes")
    # by signatures
    done = materialize(_to_centres(posted.withColumn("label", F.col("node")), 0), "pairs")
    labels = connected_components(_verified(done, sets, full))
    # what they leave open is posted anew under its shingles
    open_nodes = _crossing(posted, labels).select("node").distinct()
    posted = materialize(_shingle_prefixes(open_nodes, full), "shingle_prefixes")
    for turn in range(1, len(CENTRES)):
        pairs = materialize(_to_centres(_crossing(posted, labels), turn).join(done, ["a", "b"], "left_anti"), "pairs")
        done = done.union(pairs)
        labels = extended(labels, _verified(pairs, sets, full))
    rest = materialize(_across(_crossing(posted, labels)).join(done, ["a", "b"], "left_anti"), "pairs")
    return extended(labels, _verified(rest, sets, full))


def _judged(docs: DataFrame, by_id: bool) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, text_key, n_shingles, node), null node where nothing can link; classes; and labels of linked nodes.

    The classes (node, doc_id, text_key, copies) carry the smallest (doc_id, text_key) of their rows. by_id links the
    classes that rows of one doc_id lie in.
    """
    kind = dict(docs.dtypes)["doc_id"]
    base = docs.select("doc_id", F.xxhash64("text").alias("text_key"), "text")
    base = materialize(map_batches(base, _signatures, f"doc_id {kind}, text_key long, n_shingles long, h1 long, h2 long, sig array<int>"), "signatures")
    usable = base.where("n_shingles > 0 and doc_id is not null")
    classes = usable.groupBy("h1", "h2").agg(F.min(F.struct("doc_id", "text_key")).alias("row"), F.count(F.lit(1)).alias("copies"), F.first("sig").alias("sig"))
    classes = materialize(classes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "row.*", "copies", "sig"), "classes")
    rows = usable.select("doc_id", "text_key", "n_shingles", "h1", "h2").join(classes.select("h1", "h2", "node"), ["h1", "h2"]).drop("h1", "h2")
    rows = materialize(rows, "rows")
    labels = _components(classes.select("node", "doc_id", "text_key", "sig"), docs.select("doc_id", "text"))
    if by_id:
        several = rows.groupBy("doc_id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a < z")
        labels = extended(labels, rows.join(materialize(several, "several"), "doc_id").select("a", F.col("node").alias("b")).where("a < b"))
    rest = base.where("not (n_shingles > 0 and doc_id is not null)").select("doc_id", "text_key", "n_shingles", F.lit(None).cast("long").alias("node"))
    return rows.select("doc_id", "text_key", "n_shingles", "node").union(rest), classes.drop("h1", "h2", "sig"), labels


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, n_shingles, component_id, kept, copies.

    component_id is the smallest doc_id reachable over links, kept marks the document that carries it, and copies
    counts the rows with the same shingle set. Defined cases: a null or blank text has no shingles and is linked with
    nothing; a row with a null doc_id is linked with nothing and kept; rows that repeat a doc_id are one document, so
    what any of their texts is linked with belongs to one component; other columns are ignored; no rows give no rows.
    """
    rows, classes, labels = _judged(docs, by_id=True)
    named = materialize(classes.join(labels, "node", "left").select("node", "doc_id", "copies", F.coalesce("label", "node").alias("label")), "named")
    least = materialize(named.groupBy("label").agg(F.min("doc_id").alias("component")), "components")
    found = materialize(named.join(least, "label").select("node", "component", "copies"), "found")
    linked = rows.where("node is not null").join(found, "node").select("doc_id", "n_shingles", F.col("component").alias("component_id"), "copies")
    alone = rows.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(1).cast("long").alias("copies"))
    return linked.union(alone).select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), "copies")


def without_near_duplicates(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which one stays for each component: the smallest by doc_id and text hash.

    Rows without a doc_id or without words all stay. Rows that repeat a doc_id are judged by their own texts here, so a
    text that is near no other stays beside its namesake; of rows that agree in doc_id and text, one stays.
    """
    rows, classes, labels = _judged(docs, by_id=False)
    named = materialize(classes.join(labels, "node", "left").select("node", "doc_id", "text_key", F.coalesce("label", "node").alias("label")), "named")
    least = materialize(named.groupBy("label").agg(F.min(F.struct("doc_id", "text_key")).alias("row")), "components")
    best = materialize(named.join(least, "label").select("node", F.col("row.doc_id").alias("best_id"), F.col("row.text_key").alias("best_key")), "best")
    judged = rows.where("node is not null").join(best, "node")
    stays = (F.col("doc_id") == F.col("best_id")) & (F.col("text_key") == F.col("best_key"))
    counted = materialize(judged.groupBy("doc_id", "text_key").agg(F.first(stays).alias("stays"), F.count(F.lit(1)).alias("times")).where("not stays or times > 1"), "counted")
    gone = counted.where("not stays").select(F.col("doc_id").alias("_near_dedup_id"), F.col("text_key").alias("_near_dedup_key"))
    again = counted.where("stays").select(F.col("doc_id").alias("_near_dedup_id"), F.col("text_key").alias("_near_dedup_key"))
    at = (F.col("doc_id") == F.col("_near_dedup_id")) & (F.xxhash64("text") == F.col("_near_dedup_key"))
    some, others = split_by_keys(docs, gone, _near_dedup_id=F.col("doc_id"), _near_dedup_key=F.xxhash64("text"))
    left = others.union(some.join(gone, at, "left_anti"))
    if again.isEmpty():
        return left
    return left.join(again, at, "left_anti").union(left.join(again, at, "left_semi").dropDuplicates(["doc_id", "text"]))


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s FROM words),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
freq AS (SELECT s, count(*) AS f FROM sh GROUP BY 1 HAVING count(*) > 1),
pairs AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM sh x JOIN freq USING (s) JOIN sh y USING (s)
  WHERE x.doc_id < y.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * common >= 75 * (na.n + nb.n - common)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM both_ways UNION SELECT r.a, e.b FROM reach r JOIN both_ways e ON r.b = e.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id,
  d.doc_id = least(d.doc_id, coalesce(low.b, d.doc_id)) AS kept,
  CASE WHEN n.n IS NULL THEN 1 ELSE count(*) OVER (PARTITION BY k) END AS copies
FROM (SELECT doc_id, (SELECT md5(string_agg(s, chr(10) ORDER BY s)) FROM sh WHERE sh.doc_id = documents.doc_id) AS k FROM documents) d
LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""
