"""Mixing sources to target weights: water-filled targets, whole copies, and a Pareto order sample for the rest.

The copies expected of a document are in proportion to its importance, at most MOST, and such that those of a source
make up its target. The integer part is allocated as whole copies. For the fractions p the documents are ranked by random
odds over inclusion odds, (u / (1 - u)) / (p / (1 - p)), and taken in that order until the words that are still missing
are reached; the size that is fixed is the number of words, and the document at the cut is taken when that comes nearer.
The random number u is a hash of doc_id, text and, for rows that agree in both and in source, their number, so reruns agree.

The ranks are never sorted as a whole: words are summed over BUCKETS ranges of the ranking within each source, the range
in which the cut lies is found on those sums, and only that range's documents, about 1 / BUCKETS of a source, are put in
order. So a source with a third of all rows is spread over all tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import materialize, read_table, size_of_words

BUCKETS = 4096
WEIGHTS = (1, 2, 3)
MOST = 3
IMPORTANCES = 100  # importance is a whole number from 1 to this
LONG_WORDS, LONGEST = 100, 10  # the query's importance: one more for each 100 words, up to ten


def source_sizes(sized: DataFrame) -> DataFrame:
    """(source, source_size, weight): sources numbered by code point, null last, weigh 1, 2, 3 and again.

    The numbering is a range-partitioned sort with an offset for each partition, so that any number of sources will do.
    """
    sums = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    order = [F.col("source").isNull(), F.col("source")]
    ranged = materialize(sums.withColumn("last", order[0]).repartitionByRange(8, "last", "source").withColumn("part", F.spark_partition_id()), "source_ranges")
    # one row for each of the few partitions
    offsets = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n")).select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    within = F.row_number().over(Window.partitionBy("part").orderBy("last", "source"))
    numbered = ranged.withColumn("k", within).join(F.broadcast(offsets), "part").withColumn("k", F.col("k") + F.col("before") - 1)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), (F.pmod("k", F.lit(len(WEIGHTS))) + 1).cast("int"))
    return numbered.select("source", "source_size", weight.cast("long").alias("weight"))


def source_targets(sources: DataFrame) -> DataFrame:
    """Adds target: all sizes shared by weight, at most MOST times the source's size, the excess reshared by weight.

    Each round is one aggregate over the sources, and caps at least one more of them; the driver keeps four numbers.
    """
    sources = materialize(sources, "weights")
    share, cap = None, F.col("source_size") * MOST
    while True:
        full = F.lit(False) if share is None else F.col("weight") * F.lit(share) >= cap
        row = sources.agg(
            F.sum("source_size").alias("total"),
            F.sum(F.when(full, cap)).alias("capped"),
            F.sum(F.when(~full, F.col("weight"))).alias("weights"),
        ).first()
        if not row.total or not row.weights:
            break
        now = (row.total - (row.capped or 0)) / row.weights
        if share is not None and now <= share:
            break
        share = now
    target = F.least(F.col("weight") * F.lit(float(share or 0)), cap.cast("double"))
    return sources.withColumn("target", target)


def numbered(sized: DataFrame) -> DataFrame:
    """Adds occurrence, from 0, to rows that agree in same, and drops part, the input partition that they are counted in.

    Rows are numbered within their part, after those of the parts before: one row for each part and repeated key is all
    that meets, so very many equal rows stay dealt out.
    """
    counts = materialize(sized.groupBy("same", "part").agg(F.count(F.lit(1)).alias("n")), "counts")
    by = Window.partitionBy("same")
    before = F.coalesce(F.sum("n").over(by.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    repeated = counts.withColumns({"before": before, "times": F.sum("n").over(by)}).where("times > 1")
    repeated = materialize(repeated.select("same", "part", "before"), "repeated")
    local = F.row_number().over(Window.partitionBy("part", "same").orderBy(F.lit(0))) - 1
    again = sized.join(repeated, ["same", "part"]).withColumn("occurrence", local + F.col("before")).drop("before", "part")
    once = sized.join(repeated, ["same", "part"], "left_anti").withColumn("occurrence", F.lit(0).cast("long")).drop("part")
    return once.unionByName(again)


def within_sources(sized: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, worth, source_size, target, expected): the copies expected of a document by source and importance.

    expected = min(MOST, level * worth) with the one level for each source that meets its target. There are at most
    IMPORTANCES rows a source; the heaviest are full first.
    """
    per = materialize(sized.groupBy("source", "worth").agg(F.sum("size").alias("words")), "worths")
    met = per.join(sources.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    down = Window.partitionBy("source").orderBy(F.col("worth").desc()).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy("source")
    full = F.sum("words").over(down) - F.col("words")  # what is full if this importance is the first that is not
    rest = F.sum(F.col("words") * F.col("worth")).over(whole) - F.sum(F.col("words") * F.col("worth")).over(down) + F.col("words") * F.col("worth")
    level = F.when(rest > 0, (F.col("target") - MOST * full) / rest)
    # the first importance that its level doesn't fill decides; where all are full there is none
    fits = met.withColumn("level", level).withColumn("level", F.when(F.col("level") * F.col("worth") <= MOST, F.col("level")))
    fits = fits.withColumn("level", F.max("level").over(whole))
    expected = F.when(F.col("source_size") > 0, F.least(F.coalesce(F.col("level") * F.col("worth"), F.lit(float(MOST))), F.lit(float(MOST)))).otherwise(0.0)
    return fits.select("source", "worth", "source_size", "target", expected.alias("expected"))


def longer_first() -> Column:
    """The query's importance: texts of more words are likelier, up to LONGEST times."""
    return 1 + F.least(F.floor(F.col("size") / LONG_WORDS), F.lit(LONGEST - 1))


def mix(docs: DataFrame, seed: str = "", importance: Column | None = None) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies, taken) for every row of docs(doc_id, text, source, ...).

    copies is the number of times that the mix repeats the document, at most MOST, and taken is copies times size.
    importance is an expression over doc_id, source and size; its value, rounded and held between 1 and IMPORTANCES,
    scales the copies expected of a document against others of its source; null is 1, as is everything without it.
    Defined cases: a null or blank text has size 0 and no copies; a null source is a source of its own, ordered last;
    rows that repeat or lack a doc_id are rows of their own, and which of several equal rows are taken is left open; no
    rows give no rows; other columns are ignored.
    """
    text = F.md5(F.coalesce("text", F.lit("")))
    named = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("")), text)
    same = F.xxhash64(named, F.col("source").isNull(), "source")
    sized = docs.select("doc_id", "source", size_of_words(F.col("text")).alias("size"), named.alias("name"), same.alias("same"), F.spark_partition_id().alias("part"))
    worth = F.lit(1) if importance is None else F.coalesce(F.round(importance), F.lit(1))
    worth = F.least(F.greatest(worth, F.lit(1)), F.lit(IMPORTANCES)).cast("long")
    sized = materialize(sized.withColumn("worth", worth), "sized")
    sources = materialize(source_targets(source_sizes(sized)), "targets").drop("weight")
    u = (F.conv(F.substring(F.md5(F.concat_ws(":", "name", "occurrence", F.lit(seed))), 1, 12), 16, 10).cast("long") + 0.5) / F.lit(float(1 << 48))
    rated = materialize(within_sources(sized, sources), "rated").withColumnsRenamed({"source": "s", "worth": "w"})
    met = numbered(sized).withColumn("u", u).join(rated, F.col("source").eqNullSafe(F.col("s")) & (F.col("worth") == F.col("w"))).drop("s", "w")
    expected = F.col("expected")
    whole = F.floor(expected)
    p = expected - whole
    # odds / (1 + odds) keeps the order of the odds and lies between 0 and 1
    odds = (F.col("u") / (1 - F.col("u"))) * (1 - p) / p
    met = met.withColumns({"whole": whole.cast("long"), "rank": F.when(p > 0, odds / (1 + odds)), "bucket": F.when(p > 0, F.least(F.floor(odds / (1 + odds) * BUCKETS), F.lit(BUCKETS - 1)).cast("int"))})
    met = materialize(met.select("doc_id", "source", "size", "source_size", "target", "whole", "rank", "bucket"), "ranked")
    sums = met.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.col("whole")).alias("sure"), F.first("target").alias("target"))
    by_source = Window.partitionBy("source")  # at most BUCKETS + 1 rows
    before = F.coalesce(F.sum(F.when(F.col("bucket").isNotNull(), F.col("words"))).over(by_source.orderBy(F.col("bucket").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.withColumns({"before": before, "missing": F.col("target") - F.sum("sure").over(by_source)})
    cuts = sums.where("bucket is not null and before < missing and before + words >= missing").select(F.col("source").alias("s"), F.col("bucket").alias("cut"), "before", "missing")
    lows = sums.groupBy(F.col("source").alias("s")).agg(F.first("missing").alias("rest"), F.sum(F.when(F.col("bucket").isNotNull(), F.col("words"))).alias("all"))
    cuts = materialize(lows.join(cuts.withColumnRenamed("s", "s2"), F.col("s").eqNullSafe(F.col("s2")), "left").select("s", "cut", "before", "missing", (F.col("rest") > F.coalesce("all", F.lit(0))).alias("every")), "cuts")
    met = met.join(cuts, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    out = ["doc_id", "source", "size", "source_size", "target"]
    at_cut = F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    more = F.when(F.col("bucket").isNull(), 0).when(F.col("every"), 1).otherwise(F.coalesce((F.col("bucket") < F.col("cut")).cast("int"), F.lit(0)))
    decided = met.where(~at_cut).select(*out, (F.col("whole") + more).alias("copies"))
    order = Window.partitionBy("source").orderBy("rank").rangeBetween(Window.unboundedPreceding, 0)
    ties = Window.partitionBy("source", "rank")
    so_far, group = F.sum("size").over(order), F.sum("size").over(ties)
    near = met.where(at_cut).withColumns({"so_far": so_far, "group": group})
    take = (F.col("before") + F.col("so_far") - F.col("group") / 2 <= F.col("missing")).cast("int")
    near = near.select(*out, (F.col("whole") + take).alias("copies"))
    both = decided.union(near)
    copies = F.when(F.col("size") > 0, F.col("copies")).otherwise(0)
    return both.select(*out, copies.cast("long").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def op8_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read_table(spark, sf_dir, "documents"), importance=longer_first()).select("doc_id", "size", "source_size", "target", "taken")


OP8_SQL = r"""
WITH named AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, coalesce(doc_id::VARCHAR, '') || ':' || md5(coalesce(text, '')) AS name FROM documents),
sized AS (
  SELECT doc_id, source, size, 1 + least(size // 100, 9) AS worth,
    (('0x' || substr(md5(name || ':' || (row_number() OVER (PARTITION BY name, source) - 1) || ':'), 1, 12))::BIGINT + 0.5::DOUBLE) / 281474976710656.0::DOUBLE AS u FROM named),
sources AS (SELECT source, sum(size)::BIGINT AS source_size, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS weight FROM sized GROUP BY source),
total AS (SELECT sum(source_size)::BIGINT AS t, sum(weight)::BIGINT AS w FROM sources),
ordered AS (SELECT *, row_number() OVER o AS k, sum(3 * source_size) OVER o AS capped, sum(weight) OVER o AS used, lead(3 * source_size::DOUBLE / weight) OVER (ORDER BY source_size::DOUBLE / weight, source NULLS LAST) AS next
  FROM sources WINDOW o AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
shares AS (SELECT 0 AS k, t::DOUBLE / w AS share, (SELECT min(3 * source_size::DOUBLE / weight) FROM sources) AS next FROM total
  UNION ALL SELECT k, (t - capped)::DOUBLE / (w - used), next FROM ordered, total WHERE w > used),
level AS (SELECT share FROM shares WHERE share <= next ORDER BY k LIMIT 1),
targets AS (SELECT source, source_size, least(weight * share, (3 * source_size)::DOUBLE) AS target FROM sources, level),
worths AS (SELECT s.source, worth, source_size, target, sum(size)::BIGINT AS words FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source GROUP BY ALL),
levels AS (SELECT *, (target - 3 * (sum(words) OVER d - words)::BIGINT) / nullif((sum(words * worth) OVER u)::BIGINT, 0) AS level FROM worths
  WINDOW d AS (PARTITION BY source ORDER BY worth DESC ROWS UNBOUNDED PRECEDING), u AS (PARTITION BY source ORDER BY worth ROWS UNBOUNDED PRECEDING)),
rated AS (SELECT *, least(coalesce(max(CASE WHEN level * worth <= 3 THEN level END) OVER (PARTITION BY source) * worth, 3), 3)::DOUBLE AS expected FROM levels),
met AS (SELECT d.*, source_size, target, floor(expected) AS whole, expected - floor(expected) AS p FROM sized d JOIN rated r ON d.source IS NOT DISTINCT FROM r.source AND d.worth = r.worth),
ranked AS (SELECT *, target - sum(whole * size) OVER (PARTITION BY source) AS missing,
  sum(CASE WHEN p > 0 THEN size END) OVER (PARTITION BY source ORDER BY CASE WHEN p > 0 THEN u / (1 - u) * (1 - p) / p END NULLS LAST, doc_id) AS so_far FROM met)
SELECT doc_id, size, source_size, target, (CASE WHEN size > 0 THEN size * (whole + CASE WHEN p > 0 AND so_far - size / 2 <= missing THEN 1 ELSE 0 END) ELSE 0 END)::BIGINT AS taken FROM ranked
"""
