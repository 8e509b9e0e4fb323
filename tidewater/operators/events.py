"""Deduplication of events in tiers, merging into canonical ones, alerts, and timelines."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.operators.joins import band_join
from tidewater.operators.work import written


def same_fingerprint(events: DataFrame) -> DataFrame:
    """(id, canonical): the first event with the same fingerprint, for all later ones; null fingerprints match nothing."""
    over = Window.partitionBy("fingerprint").orderBy("at", "id")
    first = F.first("id").over(over)
    return events.where("fingerprint is not null").select("id", first.alias("canonical")).where("id <> canonical")


def _profiles(column: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Row, entity and count of each entry of a column of profiles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten()
    return np.repeat(np.arange(len(column)), np.diff(column.offsets.to_numpy())), flat.field("entity"), flat.field("c").to_numpy().astype(np.float64)


def _dense(rows: np.ndarray, codes: np.ndarray, counts: np.ndarray, lines: tuple[int, int], cells: tuple[int, int]) -> np.ndarray:
    """Counts of some rows and some entities as a matrix; the entries stand by row."""
    at = slice(*np.searchsorted(rows, lines))
    held = (codes[at] >= cells[0]) & (codes[at] < cells[1])
    out = np.zeros((lines[1] - lines[0], cells[1] - cells[0]))
    out[rows[at][held] - lines[0], codes[at][held] - cells[0]] = counts[at][held]
    return out


def _best_tile(days: int, block: int = 256, cells: int = 1024):
    """For each query its best candidate: the largest product of counts, then the earliest, then the smallest id.

    With days these are the candidates of so many days before the query's day; without, those of its own day that stand before it.
    """

    def tile(asked: pa.Table, held: pa.Table) -> pa.Table:
        names = pa.schema([asked.schema.field("key"), pa.field("n", pa.float64()), held.schema.field("at").with_name("other_at"), held.schema.field("id").with_name("other")])
        if not asked.num_rows or not held.num_rows:
            return names.empty_table()
        asked = asked.sort_by([("day", "ascending"), ("at", "ascending"), ("id", "ascending")])
        held = held.sort_by([("day", "ascending"), ("at", "ascending"), ("id", "ascending")])
        (qr, qe, qc), (hr, he, hc) = _profiles(asked.column("profile")), _profiles(held.column("profile"))
        codes = pa.concat_arrays([qe, he]).dictionary_encode()
        width, codes = len(codes.dictionary), codes.indices.to_numpy()
        qk, hk = codes[: len(qr)], codes[len(qr) :]
        qd, hd = asked.column("day").to_numpy(), held.column("day").to_numpy()
        # places of both sides in the order of (at, id)
        rank = lambda name: pc.rank(pa.chunked_array([t.column(name).combine_chunks() for t in (asked, held)]).combine_chunks(), "ascending", tiebreaker="dense").to_numpy().astype(np.int64)
        ids = rank("id")
        place = rank("at") * (int(ids.max()) + 1) + ids
        qp, hp = place[: len(qd)], place[len(qd) :]
        most, which = np.zeros(len(qd)), np.zeros(len(qd), np.int64)
        for day in np.unique(qd):
            low, high = np.searchsorted(qd, (day, day + 1))
            first, last = np.searchsorted(hd, (day - days, day) if days else (day, day + 1))
            if first == last:
                continue
            for start in range(low, high, block):
                end = min(start + block, high)
                score = np.zeros((end - start, last - first))
                for cell in range(0, width, cells):
                    span = cell, min(cell + cells, width)
                    score += _dense(qr, qk, qc, (start, end), span) @ _dense(hr, hk, hc, (first, last), span).T
                if not days:
                    score[np.arange(last - first)[None, :] >= np.searchsorted(hp[first:last], qp[start:end])[:, None]] = 0
                at = score.argmax(axis=1)  # the first of equal ones
                most[start:end], which[start:end] = score[np.arange(end - start), at], at + first
        found = np.flatnonzero(most > 0)
        other = held.take(pa.array(which[found]))
        return pa.Table.from_arrays([asked.column("key").take(pa.array(found)), pa.chunked_array([most[found]]), other.column("at"), other.column("id")], schema=names)

    return tile


def _best_of(asked: DataFrame, held: DataFrame, back: int, days: int, tile_rows: int) -> DataFrame:
    """(key, n, other_at, other): the best candidate of queries(key, day, at, id, profile) among held(day, at, id, profile), tile by tile.

    Both sides are cut into bins as wide as days and dealt into parts of about tile_rows, and each pair of parts of one bin,
    or of the one before, is one product of matrices.
    """
    width = max(1, days or back)
    sides = [d.withColumn("bin", F.floor(F.col("day") / width).cast("int")) for d in (asked, held)]
    parts = [-(-(d.groupBy("bin").count().agg(F.max("count")).first()[0] or 1) // tile_rows) for d in sides]
    q, h = (d.withColumn("part", F.pmod(F.xxhash64("day", "id"), F.lit(n)).cast("int")) for d, n in zip(sides, parts))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    bins = F.array(F.col("bin"), F.col("bin") + 1) if days else F.array("bin")
    q = q.withColumn("i", F.col("part")).withColumn("j", every(parts[1])).withColumn("from", F.explode(F.array(F.col("bin"), F.col("bin") - 1) if days else F.array("bin")))
    h = h.withColumn("j", F.col("part")).withColumn("i", every(parts[0])).withColumn("from", F.col("bin")).withColumn("bin", F.explode(bins))
    keys, kind = ["bin", "from", "i", "j"], {f.name: f.dataType.simpleString() for f in asked.schema}
    schema = f"key {kind['key']}, n double, other_at {kind['at']}, other {kind['id']}"
    return q.groupBy(*keys).cogroup(h.groupBy(*keys)).applyInArrow(_best_tile(days), schema)


def _met(left: DataFrame, right: DataFrame, days: int) -> DataFrame:
    """(id, n, other_at, other) of marks(id, at, entity, c) of two sides, by all pairs that share an entity."""
    other = right.select(F.col("id").alias("other"), F.col("at").alias("other_at"), "entity", F.col("c").alias("other_c"))
    met = band_join(left, other, "at", "other_at", days, ["entity"]).where(F.struct("other_at", "other") < F.struct("at", "id"))
    return met.groupBy("id", "other").agg(F.sum(F.col("c") * F.col("other_c")).cast("double").alias("n"), F.min("other_at").alias("other_at")).select("id", "n", "other_at", "other")


def same_entities(events: DataFrame, least: int = 2, days: int = 7, hot_rows: int = 1000, tile_rows: int = 8192) -> DataFrame:
    """(id, canonical): the earlier event within so many days that shares the most entities, at least so many.

    Entities of repeated rows of an event count as often as they are repeated. Events that share an entity of at most
    hot_rows events meet through it. For entities of more events, those of one day with the same ones are one class, and
    each class is compared with the others in tiles of products of counts, which keep the best one only; no pairs through
    such entities are written. Of a pair that shares both kinds, the meeting has the full count, and that is the larger one.
    """
    rows = events.where("at is not null").select("id", "at", F.explode(F.array_distinct("entities")).alias("entity")).where("entity is not null")
    marks = written(rows.groupBy("id", "at", "entity").agg(F.count(F.lit(1)).alias("c")), "marks")
    hot = written(marks.groupBy("entity").count().where(F.col("count") > hot_rows).select("entity", F.lit(True).alias("hot")), "hot")
    entry = F.struct("entity", "c")
    each = marks.join(hot, "entity", "left").groupBy("id").agg(
        F.min("at").alias("at"), F.max("at").alias("until"), F.collect_list(entry).alias("marks"),
        F.sort_array(F.collect_list(F.when(F.col("hot"), entry))).alias("profile"), F.collect_list(F.when(F.col("hot").isNull(), F.col("entity"))).alias("rare"),
    )
    each = written(each.withColumn("plain", F.col("id").isNotNull() & (F.col("at") == F.col("until"))), "events")
    plain = each.where("plain").withColumn("day", F.unix_date(F.to_date("at")))
    # through rare entities
    one = plain.select("id", "at", "marks", F.explode("rare").alias("entity"))
    two = one.select(F.col("id").alias("other"), F.col("at").alias("other_at"), F.col("marks").alias("other_marks"), "entity")
    met = band_join(one, two, "at", "other_at", days, ["entity"]).where(F.struct("other_at", "other") < F.struct("at", "id")).dropDuplicates(["id", "other"])
    times = F.map_from_entries("other_marks")
    shared = F.aggregate("marks", F.lit(0).cast("long"), lambda s, m: s + m["c"] * F.coalesce(F.try_element_at(times, m["entity"]), F.lit(0)))
    hits = met.select("id", shared.cast("double").alias("n"), "other_at", "other")
    # through the others: a class stands under its first event
    first = F.min(F.struct("at", "id")).over(Window.partitionBy("day", "profile"))
    dealt = written(plain.where(F.size("profile") > 0).select("id", "at", "day", "profile").withColumn("key", first["id"]), "classes")
    kinds = dealt.where("id = key")
    before = _best_of(kinds, kinds, days, days, tile_rows) if days else kinds.select("key", F.lit(0.0).alias("n"), F.col("at").alias("other_at"), F.col("id").alias("other")).limit(0)
    before = before.groupBy("key").agg(F.min(F.struct((-F.col("n")).alias("n"), "other_at", "other")).alias("b"))
    before = dealt.select("id", "key").join(written(before, "before"), "key").select("id", (-F.col("b.n")).alias("n"), "b.other_at", "b.other")
    within = _best_of(dealt.withColumn("key", F.col("id")), kinds, max(1, days), 0, tile_rows).withColumnRenamed("key", "id")
    hits = hits.unionByName(before).unionByName(within)
    # events of several times
    spread = each.where("not plain").select("id")
    if not spread.isEmpty():
        known = F.col("x.id").eqNullSafe(F.col("y.id"))
        some, others = (marks.alias("x").join(spread.alias("y"), known, how) for how in ("left_semi", "left_anti"))
        hits = hits.unionByName(_met(some, marks, days)).unionByName(_met(others, some, days))
    best = hits.where(F.col("n") >= least).groupBy("id").agg(F.min(F.struct((-F.col("n")).alias("n"), "other_at", "other")).alias("b"))
    return best.select("id", F.col("b.other").alias("canonical"))


def deduplicate(events: DataFrame, semantic: DataFrame | None = None, least: int = 2, days: int = 7) -> DataFrame:
    """(id, canonical, tier): the first hit of fingerprint, accepted vector match (id, canonical), and shared entities."""
    tiers = [("fingerprint", same_fingerprint(events))] + ([("vector", semantic)] if semantic is not None else []) + [("entities", same_entities(events, least, days))]
    out = None
    for n, (name, hits) in enumerate(tiers):
        part = hits.select("id", F.struct(F.lit(n).alias("n"), "canonical", F.lit(name).alias("tier")).alias("hit"))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("id").agg(F.min("hit").alias("hit")).select("id", "hit.canonical", "hit.tier")


def merge(events: DataFrame, duplicates: DataFrame) -> DataFrame:
    """Canonical events with the number of sources and the actors of all that were merged into them, each name once."""
    rows = events.join(duplicates.select("id", "canonical"), "id", "left").withColumn("canonical", F.coalesce("canonical", "id"))
    actors = rows.select("canonical", "id", F.explode_outer("entities").alias("actor"))
    names = actors.where("actor is not null").groupBy("canonical", F.lower("actor").alias("k")).agg(F.min("actor").alias("actor")).groupBy("canonical").agg(F.sort_array(F.collect_list("actor")).alias("actors"))
    return rows.groupBy("canonical").agg(F.count_distinct("id").alias("source_count")).join(names, "canonical", "left")


def not_alerted(found: DataFrame, alerts: DataFrame, key: str, at: str, alerted_at: str, hours: int = 24) -> DataFrame:
    """Rows of found without an alert of their key in the hours before them."""
    a = alerts.select(F.col(key).alias("_k"), F.col(alerted_at).alias("_at"))
    since = F.col(at) - F.make_dt_interval(F.lit(0), F.lit(hours))
    return found.join(a, (F.col(key) == F.col("_k")) & (F.col("_at") >= since) & (F.col("_at") <= F.col(at)), "left_anti")


def title_key(title: Column) -> Column:
    """A title without its live marks, for keeping the first of equal ones."""
    return F.trim(F.regexp_replace(F.lower(F.trim(title)), r"^(breaking|update|live|watch):\s*", ""))
