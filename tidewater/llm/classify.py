"""Quality and toxicity of documents by gradient-boosted trees over dense features.

A bounded sample of labelled rows is featurised by Spark and trains the trees on the driver. All rows are then
featurised and scored in one pass over whole texts, by numpy traversal of the flattened trees.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewater.llm.boosting import fit, isotonic, out_of_fold
from tidewater.llm.common import map_batches, materialize, read_table
from tidewater.llm.features import BLOCK, COMMON, lexicon, quality_features, stem_counts, toxicity_features

MAX_LABELLED = 20_000  # labelled rows that the trees are fitted on, those with the smallest hashes of doc_id
FOLDS = 3
EVIDENCE, PURITY, LEXICON = 10.0, 0.7, 5000  # of words that toxic texts give
GOOD, TOXIC = 0.7, 0.3


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text leaves 2 modulo 4; false for null."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


Make = Callable[[pa.Array], Iterator[np.ndarray]]


def features_of(make: Make, column: pa.Array) -> np.ndarray:
    return np.concatenate(list(make(column)))


def known_labels(labels: DataFrame, label: str) -> DataFrame:
    """(doc_id, y, fold): at most MAX_LABELLED labelled rows that are not held out, one for each doc_id.

    Labels that repeat a doc_id are averaged and rounded; null labels are left out.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y"))
    order = F.xxhash64(F.col("doc_id").cast("string"))
    return materialize(known.withColumn("o", order).orderBy("o", "doc_id").limit(MAX_LABELLED).select("doc_id", "o", "y", F.pmod("o", F.lit(FOLDS)).cast("int").alias("fold")), "known")


def training_rows(docs: DataFrame, known: DataFrame, make: Make) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """x, y and fold of the known rows; at most MAX_LABELLED narrow rows come to the driver."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = features_of(make, batch.column("text"))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("o", "y", "fold")), lists], ["o", "y", "fold", "x"])

    read = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("o", "y", "fold", "text")
    rows = map_batches(read, task, "o long, y int, fold int, x array<double>").groupBy("o").agg(F.max("y").alias("y"), F.max("fold").alias("fold"), F.min("x").alias("x")).toArrow()
    if not rows.num_rows:
        return np.zeros((0, 1)), np.zeros(0), np.zeros(0, np.int64)
    order = np.argsort(rows["o"].to_numpy(), kind="stable")
    x = rows["x"].combine_chunks().flatten().to_numpy().reshape(rows.num_rows, -1)
    return x[order], rows["y"].to_numpy()[order], rows["fold"].to_numpy()[order]


def induced_insults(docs: DataFrame, known: DataFrame) -> list[np.ndarray]:
    """Hashes of words and word beginnings that toxic texts have and others have not: of all folds, and without each one.

    Only known rows, a bounded sample, are read for it. A stem counts when the likelihood ratio of its share of toxic
    texts against that of all texts is at least EVIDENCE and the share at least PURITY; the LEXICON strongest are kept.
    """
    groups = 2 * FOLDS

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = batch.column("y").to_numpy() * FOLDS + batch.column("fold").to_numpy()
            hashes, counts = stem_counts(batch.column("text"), group.astype(np.int64), groups)
            yield pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), *(pa.array(c.astype(np.int64)) for c in counts.T)], ["h", *(f"c{g}" for g in range(groups))])

    sizes = np.zeros((2, FOLDS))
    for r in known.groupBy("y", "fold").count().collect():
        sizes[r.y, r.fold] = r["count"]
    read = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "y", "fold")
    counts = map_batches(read, task, "h long, " + ", ".join(f"c{g} long" for g in range(groups)))
    counts = materialize(counts.groupBy("h").agg(*(F.sum(f"c{g}").alias(f"c{g}") for g in range(groups))), "stems")
    found = []
    for out in (None, *range(FOLDS)):
        used = [f for f in range(FOLDS) if f != out]
        total = sizes[:, used].sum(axis=1)
        if not total.all():
            found.append(np.zeros(0, np.uint64))
            continue
        base = total[1] / total.sum()
        bad, good = (sum((F.col(f"c{y * FOLDS + f}") for f in used), F.lit(0)) for y in (1, 0))
        share = bad / (bad + good)
        rest = F.when(good > 0, good * F.log((1 - share) / (1 - float(base)))).otherwise(0.0)
        evidence = F.when((bad > 0) & (share > float(base)), bad * F.log(share / float(base)) + rest)
        rows = counts.where((evidence >= EVIDENCE) & (share >= PURITY)).orderBy(evidence.desc(), "h").limit(LEXICON).select("h").collect()
        found.append(np.array([r.h for r in rows], np.int64).view(np.uint64))
    return found


def scored(docs: DataFrame, make: Make, score: Callable[[np.ndarray], np.ndarray], columns: list[str], below: float | None = None) -> DataFrame:
    """The named columns of docs and score; with below, only rows that score less, and no score."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns) + (", `score` double" if below is None else "")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = np.clip(score(features_of(make, batch.column("text"))), 0, 1)
                if below is None:
                    yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in columns), pa.array(found)], [*columns, "score"])
                else:
                    yield batch.select(columns).filter(pa.array(found < below))

    return map_batches(docs.select(*columns, *([] if "text" in columns else ["text"])), task, fields)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for every row of docs(doc_id, text, ...): how likely labels.quality is 1.

    Defined cases: a null text is an empty one and gets a score too; repeated rows get equal scores; without labels
    that can be learned from, every score is one half; no rows give no rows; other columns are ignored.
    """
    x, y, _ = training_rows(docs, known_labels(labels, "quality"), quality_features)
    return scored(docs, quality_features, fit(x, y).probability, ["doc_id"])


def toxicity_model(docs: DataFrame, labels: DataFrame) -> tuple[Make, Callable[[np.ndarray], np.ndarray]]:
    """Features and calibrated score, learned from the labelled rows among docs.

    Insults are those of a fixed list and those that the labelled texts themselves give, in whatever language.
    """
    known = known_labels(labels, "toxic")
    found = induced_insults(docs, known)
    folded, whole = lexicon(found), lexicon(found[:1])
    x, y, fold = training_rows(docs, known, lambda column: toxicity_features(column, folded, FOLDS + 1))
    make = lambda column: toxicity_features(column, whole, 1)
    if not len(y) or y.min() == y.max():
        return make, lambda rows: np.full(len(rows), y.mean() if len(y) else 0.5)
    # a known row is seen through the insults that the other folds gave, as a new row would be
    block = len(COMMON) + (fold[:, None] + 1) * len(BLOCK) + np.arange(len(BLOCK))
    x = np.concatenate([x[:, : len(COMMON)], np.take_along_axis(x, block, axis=1)], axis=1)
    trees, knots = fit(x, y), isotonic(out_of_fold(x, y, fold), y)
    return make, lambda rows: np.interp(trees.probability(rows), *knots)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, score) for every row of docs: how likely labels.toxic is 1, by trees and an isotonic fit out of fold.

    The cases are those of score_quality, but that labels of one kind only give their share as every score.
    """
    return scored(docs, *toxicity_model(docs, labels), ["doc_id"])


def without_toxic(docs: DataFrame, labels: DataFrame, most: float = TOXIC) -> DataFrame:
    """The rows of docs, with all their columns, whose toxicity is below most.

    Without labels that can be learned from there is no score, and all rows stay.
    """
    if known_labels(labels, "toxic").select("y").distinct().count() < 2:
        return docs
    return scored(docs, *toxicity_model(docs, labels), docs.columns, most)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))
