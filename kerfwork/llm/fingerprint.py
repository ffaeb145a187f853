"""Document fingerprints: bottom-k sketches of word-shingle hashes.

A sketch is the sorted array of the k smallest distinct 64-bit hashes of a text's
five-word shingles (A-Z lower-cased). Fewer words make one shingle of them all; no
words make the empty sketch. Sketches of parts merge into the sketch of the whole.
From two sketches come estimates of resemblance (shared part of the bottom k of the
union), containment and distinct shingle count; all are exact while neither text has
more than k shingles.

Everything is a DataFrame expression, so texts stay in JVM memory and rows are
independent. Edge cases: null text counts as empty; two empty sketches have likeness
1, one empty sketch 0; repeated shingles count once; equal texts have equal sketches.
In the order of documents null ids come first, and rows of one id go by their text.
Columns other than those named are ignored.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerfwork.llm.common import LOWER, UPPER, broadcast_if_small, cut

K, WORDS = 128, 5
#: Code points of text in one bucket of documents in id order.
BUCKET_CHARS = 2_000_000
#: Most cuts at quantiles of the ids, in groups of so many.
CUTS, GROUP = 1 << 14, 128


def words(text: Column) -> Column:
    parts = F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), r"[\x20\x09-\x0D]+")
    return F.filter(parts, lambda w: w != "")


def sketch_of_words(hashes: Column, k: int = K, size: int = WORDS) -> Column:
    """The sketch from a column with the array of word hashes."""
    n = F.size(hashes)
    several = F.transform(F.sequence(F.lit(0), n - size), lambda i: F.xxhash64(*[F.get(hashes, i + j) for j in range(size)]))
    whole = F.array(F.xxhash64(hashes))
    none = F.array().cast("array<bigint>")
    return F.slice(F.sort_array(F.array_distinct(F.when(n >= size, several).when(n > 0, whole).otherwise(none))), 1, k)


def with_sketch(df: DataFrame, text: str, name: str, k: int = K, size: int = WORDS) -> DataFrame:
    """``df`` with the sketch of column ``text``. The word hashes are a column of
    their own, so that they are computed once a row."""
    hashed = df.withColumn("__words", F.transform(words(F.col(text)), lambda w: F.xxhash64(w)))
    return hashed.withColumn(name, sketch_of_words(F.col("__words"), k, size)).drop("__words")


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    union = F.slice(F.sort_array(F.array_union(a, b)), 1, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def distinct_shingles(sketch: Column, k: int = K) -> Column:
    top = (F.element_at(sketch, k).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(sketch) < k, F.size(sketch).cast("double")).otherwise((k - 1) / F.greatest(top, F.lit(2.0**-64)))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """The estimated part of a's shingles that b has too."""
    na, nb, j = distinct_shingles(a, k), distinct_shingles(b, k), resemblance(a, b, k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), j / (1 + j) * (na + nb) / na))


def merge_sketches(df: DataFrame, key: str, sketch: str, k: int = K) -> DataFrame:
    """(key, sketch): the sketches of each key merged. Hashes are made distinct and
    cut to the k smallest on the map side first, so no key gathers in one task."""
    hashes = df.select(key, F.explode(sketch).alias("__h")).groupBy(key, "__h").agg(F.lit(1).alias("__one"))
    low = hashes.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy("__h"))).where(F.col("__r") <= k)
    merged = low.groupBy(key).agg(F.sort_array(F.collect_list("__h")).alias(sketch))
    keys = df.select(F.col(key).alias("__key")).distinct()
    joined = keys.join(merged, F.col("__key").eqNullSafe(F.col(key)), "left")
    return joined.select(F.col("__key").alias(key), F.coalesce(sketch, F.array().cast("array<bigint>")).alias(sketch))


def to_text(sketch: Column) -> Column:
    return F.array_join(F.transform(sketch, lambda h: F.lower(F.lpad(F.hex(h), 16, "0"))), "")


def _constant(values: list) -> Column:
    """An array (of arrays) of longs that is folded to one literal."""
    return F.from_json(F.lit(json.dumps(values)), "array<array<bigint>>" if values and isinstance(values[0], list) else "array<bigint>")


def bucketed(docs: DataFrame, chars: int = BUCKET_CHARS) -> tuple[DataFrame, int]:
    """``docs`` with __bucket, which ascends with doc_id, and about how many there are.
    Quantiles of the ids cut the table, CUTS of them at most; where more buckets are
    wanted, equal id ranges cut each part. Null ids are bucket 0."""
    facts = docs.agg(F.count("doc_id").alias("n"), F.sum(F.char_length("text")).alias("chars"), F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).first()
    buckets = max(1, min(facts["n"], -(-(facts["chars"] or 0) // chars)))
    parts = min(buckets, CUTS)
    inner = -(-buckets // parts)
    if facts["lo"] is None or buckets == 1:
        return docs.withColumn("__bucket", F.when(F.col("doc_id").isNull(), 0).otherwise(1).cast("long")), 1
    points = [i / parts for i in range(1, parts)]
    cuts = docs.agg(F.percentile_approx("doc_id", points, 10 * parts).alias("q")).first()["q"]
    lows = sorted({facts["lo"], *cuts})
    groups = [lows[i : i + GROUP] for i in range(0, len(lows), GROUP)]
    doc_id = F.col("doc_id")
    below = lambda xs: F.size(F.filter(xs, lambda c: c <= doc_id)) - 1
    dealt = docs.withColumn("__group", below(_constant([g[0] for g in groups])))
    dealt = dealt.withColumn("__part", F.col("__group") * GROUP + below(F.get(_constant(groups), F.col("__group"))))
    sub = F.lit(0)
    if inner > 1:
        at = lambda xs, i: F.get(F.get(_constant([xs[k : k + GROUP] for k in range(0, len(xs), GROUP)]), F.floor(i / GROUP).cast("int")), i % GROUP)
        widths = [-(-(b - a) // inner) or 1 for a, b in zip(lows, [*lows[1:], facts["hi"] + 1], strict=True)]
        sub = F.floor((doc_id - at(lows, F.col("__part"))) / at(widths, F.col("__part")))
    bucket = 1 + F.col("__part").cast("long") * inner + sub
    return dealt.withColumn("__bucket", F.when(doc_id.isNull(), F.lit(0).cast("long")).otherwise(bucket)).drop("__group", "__part"), buckets


def after_each(heads: DataFrame, at: str, low: str, span: int = 4096) -> DataFrame:
    """``heads`` (at, low) with __after, the ``low`` of the row with the next higher
    ``at``; after the last comes the first. Rows are dealt in spans of ``at``, so only
    the first row of each span goes through one task."""
    dealt = heads.withColumn("__span", F.floor(F.col(at) / span))
    inside = F.lead(low).over(W.partitionBy("__span").orderBy(at))
    spans = dealt.groupBy("__span").agg(F.min_by(low, at).alias("__first"))
    order = W.orderBy("__span")
    ring = spans.select(F.col("__span").alias("__of"), F.coalesce(F.lead("__first").over(order), F.first("__first").over(order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))).alias("__then"))
    led = dealt.withColumn("__inside", inside).join(ring, F.col("__span") == F.col("__of"))
    return led.withColumn("__after", F.coalesce("__inside", "__then")).drop("__span", "__of", "__inside", "__then")


def with_next(docs: DataFrame, sketch_k: int = K) -> DataFrame:
    """``docs`` (doc_id, text) with their sketch and __next, a struct of text and
    sketch of the document with the next higher doc_id; after the last comes the
    first. Each bucket gets a copy of the next one's first document behind its own, so a
    window inside the bucket sees all it needs. Buckets are dealt by ranges of them, which
    evens out what the tasks get."""
    docs = docs.select("doc_id", "text")
    dealt, buckets = bucketed(docs)
    heads = dealt.groupBy("__bucket").agg(F.min(F.struct("doc_id")).alias("__low"))
    wanted = cut(after_each(heads, "__bucket", "__low").select("__bucket", F.col("__after.doc_id").alias("__id")))
    texts = docs.join(broadcast_if_small(wanted.select("__id").distinct(), buckets, 200_000), F.col("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    firsts = texts.groupBy("doc_id").agg(F.min(F.struct("text")).alias("t")).select("doc_id", "t.text")
    copies = cut(wanted.join(firsts, F.col("__id").eqNullSafe(F.col("doc_id"))).select("doc_id", "text", "__bucket", F.lit(True).alias("__copy")))
    whole = dealt.withColumn("__copy", F.lit(False)).unionByName(copies).repartitionByRange("__bucket")
    order = W.partitionBy("__bucket").orderBy("__copy", "doc_id", "text")
    ahead = with_sketch(whole, "text", "sketch", sketch_k).withColumn("__next", F.lead(F.struct("text", "sketch")).over(order))
    return ahead.where(~F.col("__copy")).drop("__bucket", "__copy")


def op4_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substr("text", F.lit(1), n - half), F.substr("__next.text", F.lit(1), half))
    pairs = with_next(docs).select("doc_id", n.cast("long").alias("n_chars"), edited.alias("edited"), "sketch", F.col("__next.sketch").alias("next_sketch"))
    both = with_sketch(pairs, "edited", "edited_sketch")
    sketch, edited_sketch = F.col("sketch"), F.col("edited_sketch")
    return both.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        to_text(F.col("sketch")).alias("fingerprint"),
        to_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(sketch, F.col("next_sketch")).alias("near_next"),
        distinct_shingles(sketch).alias("shingles"),
        containment(edited_sketch, sketch).alias("edited_in_text"),
    )
