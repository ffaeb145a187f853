"""Mixing sources to target weights.

Sources in code-point order (null last) weigh 5, 2, 1, repeating, and share all words
of the collection; a target stops at ``CAP`` times its source's words and the excess
goes to the others by weight until none is above. A source's repetition rate is
target / words: each document is emitted floor(rate) times, plus one Bernoulli copy
with probability equal to the fraction, drawn from a hash of its id. SEEDS hash seeds
are tried for each source and the one whose total comes nearest its target is used,
so that even a source of a few documents lands near it; a document's copy still has
that probability under each seed, and reruns agree.

Edge cases: null text has size 0; documents of size 0 are copied like the others of
their source but take no words; a source without words has target 0; null ids share one draw; repeated
rows are drawn alike. An empty table gives an empty one. Other columns pass unchanged.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerfwork.llm.common import WORD, cut, join_hot

WEIGHTS, CAP, SEEDS = (5, 2, 1), 3, 16
#: Sources up to this number are broadcast.
SMALL = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def sizes(docs: DataFrame) -> DataFrame:
    """(doc_id, source, size)."""
    return docs.select("doc_id", "source", size_of(F.col("text")).alias("size"))


def ranked(per: DataFrame) -> DataFrame:
    """``per`` (source, ...) with ord, from 1 on by code point, null last: sources are
    range-partitioned and sorted, and a partition's numbers begin after all before it."""
    parts = cut(per.withColumn("blank", F.col("source").isNull()).repartitionByRange("blank", "source").sortWithinPartitions("blank", "source").withColumn("part", F.spark_partition_id()))
    sizes_ = sorted((r["part"], r["count"]) for r in parts.groupBy("part").count().collect())  # a row a partition
    begin, done = [], 0
    for part, n in sizes_:
        begin.append((part, done))
        done += n
    before = parts.sparkSession.createDataFrame(begin, "part int, before long")
    own = F.row_number().over(W.partitionBy("part").orderBy("blank", "source"))
    return parts.join(F.broadcast(before), "part").withColumn("ord", F.col("before") + own).drop("part", "blank", "before")


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target): water-filling. The level that the sources not
    capped share goes up as others turn out to be capped, until no more do; each round
    is one sum over all sources."""
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_docs"))
    weighed = cut(ranked(per).withColumn("w", F.get(F.array(*map(F.lit, weights)), (F.col("ord") - 1) % len(weights)).cast("long")))
    most, size, w = cap * F.col("source_size"), F.col("source_size"), F.col("w")
    left, shares, done = weighed.agg(F.sum(size).alias("s"), F.sum(w).alias("w"), F.count("*").alias("n")).select(F.coalesce("s", F.lit(0)), F.coalesce("w", F.lit(0)), F.lit(-1)).first()
    total = left
    while shares:
        # A source is capped if most < w * left / shares; compared in whole numbers.
        capped = most.cast("decimal(38,0)") * shares < w.cast("decimal(38,0)") * left
        held, free, n = weighed.agg(F.coalesce(F.sum(F.when(capped, most)), F.lit(0)), F.coalesce(F.sum(F.when(~capped, w)), F.lit(0)), F.count(F.when(capped, 1))).first()
        if n == done:
            break
        left, shares, done = total - held, free, n
    level = left / shares if shares else 0.0
    return weighed.select("source", "source_size", "n_docs", F.least(most.cast("double"), F.lit(level) * w).alias("target"))


def draws(doc_id: Column) -> Column:
    """SEEDS numbers in [0, 2**32) from hashes of the id."""
    text = F.concat_ws("", *[F.sha2(F.concat(F.lit(f"mix{i}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256) for i in range(SEEDS // 8)])
    return F.transform(F.sequence(F.lit(0), F.lit(SEEDS - 1)), lambda i: F.conv(F.substr(text, i * 8 + 1, F.lit(8)), 16, 10).cast("long"))


def plan(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """(doc_id, source, size, source_size, target, copies) for every document."""
    sized = cut(sizes(docs))
    return copied(sized, rates(sized, weights, cap)).select("doc_id", "source", "size", "source_size", "target", "copies")


@dataclass(frozen=True)
class Rates:
    """of (the source), source_size, target, whole, bar, seed; numbers of sources and
    of documents."""

    table: DataFrame
    sources: int
    rows: int

    def joined(self, left: DataFrame, right: DataFrame) -> DataFrame:
        """By source: all of them are broadcast if few, else those of many rows."""
        if self.sources <= SMALL:
            return left.join(F.broadcast(right), F.col("source").eqNullSafe(F.col("of"))).drop("of")
        return join_hot(left, right, "source", "of", self.rows).drop("of")


def hit(i: Column) -> Column:
    return (F.get("u", i).cast("double") < F.col("bar")).cast("long")


def rates(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> Rates:
    """The plan of every source of ``sized`` (doc_id, source, size)."""
    by_source = cut(targets(sized, weights, cap))
    sources, rows = by_source.agg(F.count("*"), F.coalesce(F.sum("n_docs"), F.lit(0))).first()
    rate = by_source.select(F.col("source").alias("of"), "source_size", "target").withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    rate = rate.withColumn("whole", F.floor("rate")).withColumn("bar", (F.col("rate") - F.col("whole")) * 2.0**32).drop("rate")
    rated = Rates(rate, sources, rows)
    drawn = rated.joined(sized.select("doc_id", "source", "size"), rate).withColumn("u", draws(F.col("doc_id")))
    tried = drawn.groupBy("source").agg(F.array(*[F.sum(F.col("size") * (F.col("whole") + hit(F.lit(i)))) for i in range(SEEDS)]).alias("sums"), F.first("target").alias("t"))
    misses = tried.withColumn("miss", F.transform("sums", lambda x: F.abs(x - F.col("t"))))
    best = misses.select("source", (F.array_position("miss", F.array_min("miss")) - 1).cast("int").alias("seed"))
    return replace(rated, table=cut(rate.join(best, F.col("of").eqNullSafe(F.col("source"))).drop("source")))


def copied(rows: DataFrame, rated: Rates) -> DataFrame:
    """``rows`` (doc_id, source, ...) with source_size, target and copies."""
    drawn = rated.joined(rows, rated.table).withColumn("u", draws(F.col("doc_id")))
    return drawn.withColumn("copies", F.col("whole") + hit(F.col("seed")))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, cap: int = CAP) -> DataFrame:
    """``docs`` with each row emitted as many times as planned for it, whatever the
    names of its other columns."""
    rated = rates(cut(sizes(docs)), weights, cap)
    rows = docs.select("doc_id", "source", F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    times = copied(rows, rated).where(F.col("copies") > 0).select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy"))
    return times.select(*[F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = plan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def _sql_draws() -> str:
    return ", ".join(f"CAST('0x' || substr(h, {8 * i + 1}, 8) AS BIGINT)" for i in range(SEEDS))


SQL = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source ASC NULLS LAST) AS ord FROM per),
weighed AS (SELECT *, CASE (ord - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM ranked),
levels AS (
  SELECT *, sum(source_size) OVER () - 3 * coalesce(sum(source_size) OVER (ORDER BY source_size / w, ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
         sum(w) OVER (ORDER BY source_size / w, ord ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left,
         row_number() OVER (ORDER BY source_size / w, ord) AS place FROM weighed),
lvl AS (SELECT min_by(CAST(lft AS DOUBLE) / w_left, place) AS level FROM levels WHERE 3 * source_size * w_left >= lft * w),
rates AS (
  SELECT source, source_size, least(CAST(3 * source_size AS DOUBLE), level * w) AS target FROM levels CROSS JOIN lvl),
rated AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM rates),
docs AS (
  SELECT s.doc_id, s.source, s.size, r.source_size, r.target, CAST(floor(rate) AS BIGINT) AS whole,
         (rate - floor(rate)) * CAST(4294967296 AS DOUBLE) AS bar,
         sha256('mix0:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) || sha256('mix1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS h
  FROM sized s JOIN rated r ON s.source IS NOT DISTINCT FROM r.source),
drawn AS (SELECT *, [{_sql_draws()}] AS u FROM docs),
each AS (SELECT source, target, seed, CAST(sum(size * (whole + CASE WHEN u[seed] < bar THEN 1 ELSE 0 END)) AS BIGINT) AS total
         FROM drawn CROSS JOIN range(1, {SEEDS + 1}) t(seed) GROUP BY source, target, seed),
best AS (SELECT source, min_by(seed, abs(total - target) * 1000 + seed * 0.0000001) AS seed FROM each GROUP BY source)
SELECT d.doc_id, d.size, d.source_size, d.target,
       CAST(d.size * (d.whole + CASE WHEN d.u[b.seed] < d.bar THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM drawn d JOIN best b ON d.source IS NOT DISTINCT FROM b.source"""
