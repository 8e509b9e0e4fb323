"""Secret scans: spans of candidate secrets, and the ownership of their values across the corpus.

Base spans come from three patterns. The values of assignments are then sought wherever they stand bare, without a name
before them. All of these places are hashed and counted by distinct owners (source) and repositories (document). A value
that COPIED_OWNERS or more owners hold, or SOME_OWNERS of them in COPIED_REPOSITORIES or more repositories, is a copied
example or a plain word; any other is live unless it is a placeholder by its characters. The bare places of live values
are added as spans of kind bare. Scans and redaction judge alike.

All of it is SQL expressions: the starts of matches are running sums over the lengths of what lies between them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidewater.llm.common import materialize, read_table, split_by_keys

NAME = r"(?i:password|passwd|secret|token|api_?key)"
ASSIGN = NAME + r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
# a run that is long enough holds no second match, so the length can stand in these two patterns
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
BARE = r"[A-Za-z0-9+/_.=-]{12,}+"
PLAIN = r"(?i)example|change_?me|placeholder"
ASSIGN_VALUE = 12
COPIED_OWNERS = 3
SOME_OWNERS, COPIED_REPOSITORIES = 2, 20
KINDS = ("assign", "access", "hex", "bare")
KEY, SPANS = "_secrets_row_key", "_secrets_live_spans"  # stand beside the columns of a table for a moment


def prefix_sums(values: Column) -> Column:
    """Running sums of an array, in blocks of about the root of its size, so that n numbers cost n ** 1.5 steps."""
    zero = F.lit(0)
    add = lambda s, x: s + x
    width = F.greatest(F.ceil(F.sqrt(F.size(values))).cast("int"), F.lit(1))
    blocks = F.transform(F.sequence(zero, F.greatest(F.ceil(F.size(values) / width).cast("int") - 1, zero)), lambda j: F.slice(values, j * width + 1, width))
    sums = F.transform(blocks, lambda b: F.aggregate(b, zero, add))
    offsets = F.transform(sums, lambda _, j: F.aggregate(F.slice(sums, 1, j), zero, add))
    inner = F.zip_with(blocks, offsets, lambda b, o: F.transform(b, lambda _, i: o + F.aggregate(F.slice(b, 1, i + 1), zero, add)))
    return F.flatten(inner)


def with_matches(df: DataFrame, name: str, pattern: str, group: int = 0) -> DataFrame:
    """Adds the array name of (start, end, value) for the leftmost non-overlapping matches, in code points."""
    hit, pieces, found, values, starts = (f"_{name}_{x}" for x in ("hit", "pieces", "found", "values", "starts"))
    df = df.withColumn(hit, F.col("_text").rlike(pattern))
    none = F.array().cast("array<string>")
    df = df.withColumn(pieces, F.when(F.col(hit), F.split("_text", pattern, -1)).otherwise(none))
    df = df.withColumn(found, F.when(F.col(hit), F.regexp_extract_all("_text", F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn(values, F.when(F.col(hit), F.regexp_extract_all("_text", F.lit(pattern), F.lit(group))).otherwise(none) if group else F.col(found))
    n = F.size(found)
    gaps = F.transform(F.slice(pieces, 1, n), F.length)
    shifted = F.concat(F.array(F.lit(0)), F.transform(F.slice(found, 1, F.greatest(n - 1, F.lit(0))), F.length))
    lengths = F.when(n > 0, F.zip_with(gaps, shifted, lambda a, b: a + b)).otherwise(F.array().cast("array<int>"))
    df = df.withColumn(starts, F.when(F.col(hit), prefix_sums(lengths)).otherwise(F.array().cast("array<int>")))
    ends = F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), (s + F.length(m)).alias("end")))
    df = df.withColumn(name, F.zip_with(ends, values, lambda e, v: F.struct(e["start"].alias("start"), e["end"].alias("end"), v.alias("value"))))
    return df.drop(hit, pieces, found, values, starts)


def listed(spans: Column) -> Column:
    """kind:start:end of spans(start, kind_no, end, ...), by start and then kind, comma-joined."""
    kinds = F.array(*map(F.lit, KINDS))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end"))))
    return F.array_join(F.transform(order, lambda s: F.concat_ws(":", F.element_at(kinds, s["kind"]), s["start"], s["end"])), ",")


def row_key(text: Column) -> Column:
    """Names a row by its doc_id and text; rows that agree in both have equal spans."""
    return F.sha2(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.coalesce(text, F.lit(""))), 256)


def not_plain(value: Column) -> Column:
    """All but plain placeholders: values of fewer than four different characters, or that name themselves an example."""
    return (F.size(F.array_distinct(F.split(value, ""))) >= 4) & ~value.rlike(PLAIN)


def _spans(kind: str) -> Column:
    """The matches of with_matches as spans; random says whether the value's characters allow it to be live."""

    def span(s: Column) -> Column:
        value = s["value"]
        return F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind) + 1).alias("kind"), s["end"].alias("end"), F.sha2(value, 256).alias("hash"), not_plain(value).alias("random"), F.length(value).alias("size"))

    return F.transform(kind, span)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").alias("owner"), F.coalesce("text", F.lit("")).alias("_text"))


def find_candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, owner, key, base, named, words) of every row; key is null where there is nothing.

    base holds candidate spans (start, kind, end, hash, random, size of the value), named and words the hashes of the
    values of assignments and of all runs of characters that could be such values.
    """
    df = _texts(docs)
    for name, pattern, group in (("assign", ASSIGN, 1), ("access", ACCESS, 0), ("hex", HEX, 0)):
        df = with_matches(df, name, pattern, group)
    df = df.withColumn("assign", F.filter("assign", lambda s: F.length(s["value"]) >= ASSIGN_VALUE))
    df = df.withColumn("base", F.concat(*map(_spans, KINDS[:3])))
    words = F.transform(F.array_distinct(F.regexp_extract_all("_text", F.lit(BARE), F.lit(0))), lambda w: F.xxhash64(w))
    df = df.withColumns({"named": F.array_distinct(F.transform("assign", lambda s: F.xxhash64(s["value"]))), "words": words})
    key = F.when((F.size("base") > 0) | (F.size("words") > 0), row_key(F.col("_text")))
    return df.select("doc_id", "owner", key.alias("key"), "base", "named", "words")


def bare_places(docs: DataFrame, found: DataFrame, values: DataFrame) -> DataFrame:
    """(owner, key, start, ...) of the places where a value of an assignment stands, whether or not a name stands before it.

    Rows are found by the hashes of their words; spans are only taken in texts that hold such a value.
    """
    named = materialize(found.select(F.explode("named").alias("word")).distinct(), "named")
    keys = found.select("key", F.explode("words").alias("word")).join(named, "word", "left_semi").select("key").distinct()
    rows = _texts(docs).withColumn("key", row_key(F.col("_text"))).join(materialize(keys, "keys"), "key", "left_semi")
    spans = with_matches(rows, "bare", BARE).select("owner", "key", F.explode(_spans("bare")).alias("s")).select("owner", "key", "s.*")
    assigned = materialize(values.where("kind = 1").select("hash").distinct(), "assigned")
    return spans.join(assigned, "hash", "left_semi").select("owner", "key", "start", "kind", "end", "hash", "random", "size").distinct()


def ownership(candidates: DataFrame) -> DataFrame:
    """(hash, owners, repositories, verdict) of candidates(hash, owner, key, random); null owners count as one owner."""
    each = candidates.groupBy("hash", "owner", "key").agg(F.max("random").alias("random"))
    each = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.max("random").alias("random"))
    each = each.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.max("random").alias("random"))
    copied = (F.col("owners") >= COPIED_OWNERS) | (F.col("owners") >= SOME_OWNERS) & (F.col("repositories") >= COPIED_REPOSITORIES)
    verdict = F.when(copied, "copied").when(F.col("random"), "live").otherwise("placeholder")
    return each.select("hash", "owners", "repositories", verdict.alias("verdict"))


def apart(bare: DataFrame, base: DataFrame) -> DataFrame:
    """The rows of bare(key, start, end, ...) that overlap no span of base(key, start, end, ...) of the same key.

    The spans of a key are put in order once: before the end of a bare span, no base span may have started that ends
    after its start.
    """
    of = base.join(materialize(bare.select("key").distinct(), "keys"), "key", "left_semi")
    none = F.lit(None).cast("int")
    ends = of.select("key", F.col("start").alias("at"), F.lit(1).alias("late"), F.col("end").alias("reach"), none.alias("bare_start"), none.alias("bare_end"))
    asks = bare.select("key", F.col("end").alias("at"), F.lit(0).alias("late"), none.alias("reach"), F.col("start").alias("bare_start"), F.col("end").alias("bare_end"))
    before = Window.partitionBy("key").orderBy("at", "late").rowsBetween(Window.unboundedPreceding, 0)
    met = ends.union(asks).withColumn("reach", F.max("reach").over(before)).where("bare_end is not null and (reach is null or reach <= bare_start)")
    fine = materialize(met.select("key", F.col("bare_start").alias("start"), F.col("bare_end").alias("end")).distinct(), "apart")
    return bare.join(fine, ["key", "start", "end"], "left_semi")


def judged(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The candidates of all rows, and (key, verdict, owners, repositories, s, bare): the judged spans of every key, bare ones of live values too."""
    found = materialize(find_candidates(docs), "candidates")
    values = found.where("key is not null").select("owner", "key", F.explode("base").alias("s")).select("owner", "key", "s.*")
    values = materialize(values.distinct(), "values")
    sought = materialize(bare_places(docs, found, values), "sought")
    placed = values.unionByName(materialize(apart(sought, values), "bare"))
    # written before it is joined: both sides are then shuffled, and a value that many documents hold is split
    held = placed.join(materialize(ownership(placed), "verdicts"), "hash")
    at = F.struct("start", "kind", "end", "hash", "random", "size")
    return found, held.select("key", "verdict", "owners", "repositories", at.alias("s"), (F.col("kind") == len(KINDS)).alias("bare")).distinct()


def scan_secrets(docs: DataFrame) -> DataFrame:
    """(doc_id, base, added, n_live, n_copied, owners, repositories) for every row of docs(doc_id, text, source, ...).

    base holds spans (start, kind, end, hash, random, size) of kinds assign, access and hex, added the places where live
    values stand bare; n_live and n_copied count the base spans whose values are live or copied; owners and repositories are
    those of the base value that most repositories hold, 0 without one. Defined cases: a null
    text is an empty one; a null source is an owner of its own; repeated rows get equal results and count as one
    repository; equal spans of two kinds are both kept; no rows give no rows; other columns are ignored.
    """
    found, spans = judged(docs)
    bare = F.col("bare")
    per = spans.groupBy("key").agg(
        F.array_sort(F.collect_list(F.when(bare & (F.col("verdict") == "live"), F.col("s")))).alias("added"),
        F.count_if(~bare & (F.col("verdict") == "live")).alias("n_live"),
        F.count_if(~bare & (F.col("verdict") == "copied")).alias("n_copied"),
        F.max(F.when(~bare, F.struct("repositories", "owners"))).alias("most"),
    )
    per = per.select("key", "added", "n_live", "n_copied", "most.owners", "most.repositories")
    columns = ("n_live", "n_copied", "owners", "repositories")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in columns]
    nothing = F.expr("filter(base, s -> false)")
    some = found.where("key is not null").join(per, "key", "left").select("doc_id", "base", F.coalesce("added", nothing).alias("added"), *counts)
    none = found.where("key is null").select("doc_id", "base", F.col("base").alias("added"), *(F.lit(0).cast("long").alias(c) for c in columns))
    return some.union(none)


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """All rows and columns of docs; in text, every live value is replaced by the mark, and n_chars follows if it is there.

    Copied examples, placeholders and words that many owners use stay as they are, also after "secret:". The cases are
    those of scan_secrets.
    """
    _, spans = judged(docs)
    live = spans.where("verdict = 'live'").select("key", (F.col("s.end") - F.col("s.size")).alias("a"), F.col("s.end").alias("b")).distinct()
    # spans that overlap become one; then each starts where a new stretch of the text ends
    order = Window.partitionBy("key").orderBy("a", "b")
    far = F.max("b").over(order.rowsBetween(Window.unboundedPreceding, -1))
    live = live.withColumn("new", (far.isNull() | (F.col("a") >= far)).cast("int")).withColumn("n", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    live = live.groupBy("key", "n").agg(F.min("a").alias("a"), F.max("b").alias("b"))
    live = live.withColumn("last", F.lag("b", 1, 0).over(Window.partitionBy("key").orderBy("n")))
    live = live.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("a", "b", "last"))).alias(SPANS))
    live = materialize(live.withColumnRenamed("key", KEY), "live")
    # texts without a live value aren't shuffled
    some, others = split_by_keys(docs.withColumn(KEY, row_key(F.col("text"))), live, **{KEY: F.col(KEY)})
    met = some.join(live, KEY, "left").unionByName(others, allowMissingColumns=True).drop(KEY)
    text = F.col("text")

    def marked(chars: Column) -> Column:
        piece = lambda start, n: F.array_join(F.slice(chars, start + 1, n), "")
        head = F.transform(SPANS, lambda s: F.concat(piece(s["last"], s["a"] - s["last"]), F.lit(mark)))
        end = F.element_at(SPANS, -1)["b"]
        return F.concat(F.array_join(head, ""), piece(end, F.size(chars) - end))

    # the text is taken apart once, by its code points
    whole = F.element_at(F.transform(F.array(F.split(text, "")), marked), 1)
    out = met.withColumn("text", F.when(F.col(SPANS).isNotNull(), whole).otherwise(text))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(SPANS).isNotNull(), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op6_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(read_table(spark, sf_dir, "documents"))
    counts = [F.expr(f"size(filter(base, s -> s.kind = {k + 1}))").cast("long").alias(f"n_{KINDS[k]}") for k in range(3)]
    return found.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"), listed(F.concat("base", "added")).alias("spans"), "n_live", "n_copied", "owners", "repositories")


_SQL_SPANS = """
{name} AS (SELECT rn, {kind} AS kind, unnest(list_transform(range(1, len(m) + 1), lambda i: {{'s': list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0),
  'm': m[i], 'v': v[i]}})) AS x FROM (SELECT rn, string_split_regex(text, {pattern}) AS p, regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {group}) AS v FROM d))"""
_SQL_NAME = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_SQL_PARTS = (
    ("a", 1, r"""'@NAME["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)'""".replace("@NAME", _SQL_NAME), 2),
    ("k", 2, "'AKIA[A-Z0-9]+'", 0),
    ("h", 3, "'[0-9a-f]{{16,}}'".replace("{{", "{").replace("}}", "}"), 0),
    ("b", 4, "'[A-Za-z0-9+/_.=-]{{12,}}'".replace("{{", "{").replace("}}", "}"), 0),
)
OP6_SQL = f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, row_number() OVER () AS rn FROM documents),
{",".join(_SQL_SPANS.format(name=n, kind=k, pattern=p, group=g) for n, k, p, g in _SQL_PARTS)},
allm AS (SELECT rn, kind, x.s AS s, x.s + length(x.m) AS e, x.v AS v, x.m AS m FROM (SELECT * FROM a UNION ALL SELECT * FROM k UNION ALL SELECT * FROM h UNION ALL SELECT * FROM b)),
base AS (SELECT rn, kind, s::BIGINT AS s, e::BIGINT AS e, v FROM allm WHERE kind = 1 AND length(v) >= 12 OR kind = 2 AND length(m) >= 18 OR kind = 3),
bare AS (SELECT rn, 4 AS kind, s::BIGINT AS s, e::BIGINT AS e, v FROM allm WHERE kind = 4 AND v IN (SELECT v FROM base WHERE kind = 1)
  AND NOT EXISTS (SELECT 1 FROM base WHERE base.rn = allm.rn AND base.s < allm.e AND allm.s < base.e)),
own AS (SELECT v, count(DISTINCT coalesce(source, chr(0))) AS owners, count(DISTINCT coalesce(source, chr(0)) || chr(1) || coalesce(doc_id::VARCHAR, '') || ':' || text) AS repositories
  FROM (SELECT rn, v FROM base UNION ALL SELECT rn, v FROM bare) JOIN d USING (rn) GROUP BY v),
verdict AS (SELECT v, owners, repositories, CASE WHEN owners >= 3 OR owners >= 2 AND repositories >= 20 THEN 'copied'
  WHEN len(list_distinct(string_split(v, ''))) >= 4 AND NOT regexp_matches(lower(v), 'example|change_?me|placeholder') THEN 'live' ELSE 'placeholder' END AS verdict FROM own),
names(kind, name) AS (VALUES (1, 'assign'), (2, 'access'), (3, 'hex'), (4, 'bare')),
b1 AS (SELECT rn, count(*) FILTER (WHERE kind = 1) AS n_assign, count(*) FILTER (WHERE kind = 2) AS n_access, count(*) FILTER (WHERE kind = 3) AS n_hex,
  max({{'r': repositories, 'o': owners}}) AS most, count(*) FILTER (WHERE verdict = 'live') AS n_live, count(*) FILTER (WHERE verdict = 'copied') AS n_copied,
  string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS base FROM base JOIN names USING (kind) JOIN verdict USING (v) GROUP BY rn),
s1 AS (SELECT rn, string_agg(name || ':' || s || ':' || e, ',' ORDER BY s, kind) AS spans FROM (SELECT rn, kind, s, e FROM base UNION ALL SELECT rn, kind, s, e FROM bare JOIN verdict USING (v) WHERE verdict = 'live') JOIN names USING (kind) GROUP BY rn)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied, coalesce(most.o, 0) AS owners, coalesce(most.r, 0) AS repositories FROM d LEFT JOIN b1 USING (rn) LEFT JOIN s1 USING (rn)
"""
