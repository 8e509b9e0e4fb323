"""Chat formatting: logged snapshots of a conversation are collapsed to the longest one and rendered.

A system that logs the whole conversation at every turn leaves many conversations that are prefixes of longer ones.
Every turn gets a rolling hash of all turns up to it: the sum of position-salted hashes, which is a running sum and can
be taken in pieces. The rows are range-partitioned by conversation and turn, summed within each partition, and carried
on by the totals of the partitions before, so one conversation with a third of all rows is spread over all tasks. All of
this works on digests of the texts; only the texts of kept conversations are then put beside their positions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import materialize, read_table

PART_TURNS = 64  # turns in one rendered part
ORDER = ("conv_id", "turn", "role", "digest")
START, END = "<|im_start|>", "<|im_end|>"


def _salted(seed: int) -> Column:
    """Hash of a turn at its position; summed as a decimal, so that no sum overflows."""
    return F.xxhash64(F.lit(seed), F.col("pos"), F.col("role").isNull(), F.col("role"), F.col("digest").isNull(), F.col("digest")).cast("decimal(20,0)")


def digested(turns: DataFrame) -> DataFrame:
    """turns with digest, the MD5 of the text; null for a null text."""
    return turns.select("conv_id", "turn", "role", "text").withColumn("digest", F.unhex(F.md5("text")))


def rolling_hashes(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, pos, h1, h2): position from 1 and hashes of all turns up to this one.

    Turns are ordered by turn, then role, then digest, nulls first; rows that repeat in all four columns count once.
    """
    rows = digested(turns).select(*ORDER).distinct()
    n = max(8, int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    by = [F.col(c).asc_nulls_first() for c in ORDER]
    ranged = materialize(rows.repartitionByRange(n, *by).withColumn("part", F.spark_partition_id()), "turns")
    here = Window.partitionBy("part", "conv_id")
    carry = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)

    def before(sums: DataFrame, cols: list[str]) -> DataFrame:
        """What the partitions before hold of a conversation; at most one row for each partition."""
        return sums.select("part", F.col("conv_id").alias("c"), *(F.coalesce(F.sum(x).over(carry), F.lit(0)).alias(f"{x}_before") for x in cols))

    counts = before(ranged.groupBy("part", "conv_id").agg(F.count(F.lit(1)).alias("pos")), ["pos"])
    met = lambda df, sums: df.join(sums.withColumnRenamed("part", "p"), (F.col("part") == F.col("p")) & F.col("conv_id").eqNullSafe(F.col("c"))).drop("p", "c")
    local = F.row_number().over(here.orderBy(*by[1:])).cast("long")
    placed = met(ranged.withColumn("pos", local), counts).withColumn("pos", F.col("pos") + F.col("pos_before")).drop("pos_before")
    placed = materialize(placed.withColumns({"a": _salted(1), "b": _salted(2)}), "placed")
    sums = before(placed.groupBy("part", "conv_id").agg(F.sum("a").alias("a"), F.sum("b").alias("b")), ["a", "b"])
    run = here.orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    summed = met(placed.withColumns({"h1": F.sum("a").over(run), "h2": F.sum("b").over(run)}), sums)
    return summed.select(*ORDER, "pos", (F.col("h1") + F.col("a_before")).cast("string").alias("h1"), (F.col("h2") + F.col("b_before")).cast("string").alias("h2"))


def maximal_conversations(hashed: DataFrame) -> DataFrame:
    """(conv_id, n_turns, copies): conversations that are no prefix of a longer one; of equal ones the smallest id."""
    last = hashed.groupBy("conv_id").agg(F.max(F.struct("pos", "h1", "h2")).alias("m")).select("conv_id", "m.*")
    last = materialize(last, "last")
    # a prefix counts only where its conversation goes on; equal prefixes meet in one row before any join
    longer = hashed.select("conv_id", "pos", "h1", "h2").join(last.select(F.col("conv_id").alias("c"), F.col("pos").alias("n")), F.col("conv_id").eqNullSafe(F.col("c"))).where("pos < n")
    prefixes = longer.groupBy("pos", "h1", "h2").agg(F.count(F.lit(1)).alias("times"))
    one = last.groupBy("pos", "h1", "h2").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("copies"))
    return one.join(prefixes, ["pos", "h1", "h2"], "left_anti").select("conv_id", F.col("pos").alias("n_turns"), "copies")


def format_chats(turns: DataFrame) -> DataFrame:
    """(conv_id, part, n_turns, copies, text): maximal conversations of turns(conv_id, turn, role, text, ...), rendered.

    A conversation is rendered in parts of PART_TURNS turns, which joined by a line feed are its whole text, so that no
    row grows with the conversation. Defined cases: a null role is rendered as user and a null text as nothing, but they
    differ from user and empty when conversations are compared; rows with a null conv_id form one conversation; rows
    that repeat in all four columns count once; no turns give no rows; other columns are ignored.
    """
    hashed = materialize(rolling_hashes(turns), "hashed")
    kept = materialize(maximal_conversations(hashed), "maximal").select(F.col("conv_id").alias("c"), "n_turns", "copies")
    at = hashed.select(*ORDER, "pos").join(kept, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    at = materialize(at, "places").withColumnsRenamed({c: f"at_{c}" for c in ORDER})
    same = [F.col(c).eqNullSafe(F.col(f"at_{c}")) for c in ORDER]
    rows = digested(turns).join(at, reduce(Column.__and__, same))
    line = F.concat(F.lit(START), F.coalesce("role", F.lit("user")), F.lit("\n"), F.coalesce("text", F.lit("")), F.lit(END))
    rows = rows.select("conv_id", ((F.col("pos") - 1) / PART_TURNS).cast("long").alias("part"), "n_turns", "copies", F.struct("pos", line.alias("line")).alias("s"))
    parts = rows.groupBy("conv_id", "part", "n_turns", "copies").agg(F.array_sort(F.collect_set("s")).alias("s"))
    return parts.select("conv_id", "part", "n_turns", "copies", F.array_join("s.line", "\n").alias("text"))


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(read_table(spark, sf_dir, "conversations"))


OP3_SQL = r"""
WITH t AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, md5(text) NULLS FIRST) AS pos FROM t),
c AS (SELECT conv_id, list({'r': role, 't': text} ORDER BY pos) AS w, count(*) AS n FROM p GROUP BY conv_id),
one AS (SELECT w, n, min(conv_id) AS conv_id, count(*) AS copies FROM c GROUP BY w, n),
kept AS (SELECT * FROM one WHERE NOT EXISTS (SELECT 1 FROM one o WHERE o.n > one.n AND o.w[1] = one.w[1] AND o.w[1:one.n] = one.w))
SELECT k.conv_id, (p.pos - 1) // 64 AS part, k.n AS n_turns, copies,
  string_agg('<|im_start|>' || coalesce(role, 'user') || chr(10) || coalesce(text, '') || '<|im_end|>', chr(10) ORDER BY pos) AS text
FROM kept k JOIN p ON p.conv_id IS NOT DISTINCT FROM k.conv_id GROUP BY 1, 2, 3, 4
"""
