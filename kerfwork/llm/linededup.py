"""Line dedup: repeated lines are found by hash and dropped through per-document bitmaps.

The hashes of all keyed lines are range-partitioned and sorted by hash, document and
position; a window streams over each hash's run and marks what goes. Texts take no
part in that shuffle: the result is one compressed bitmap a document, its keep bits
as run lengths ("3,1,12": keep 3, drop 1, keep 12; a leading 0 if the first goes).

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends, A-Z
lower-cased; it is held as two 64-bit hashes. A key in at least ``min_docs``
documents is repeated. ``keep_first=False`` drops all its lines, ``True`` all but
the first by (document, position).

A few keys may hold most rows. Keys with more than ``HOT_ROWS`` lines and over
1/``HOT_SHARE`` of all lines number at most ``HOT_SHARE``, so they are broadcast with
their decision, and their rows are salted by document; every other key's run fits one
task. They are found by counts of hash bins, of which there are more in a second pass
if even the average one of the first is that full.

Edge cases: null or empty text is one empty line, whose key is empty and never
repeated as ``min_chars`` is 1 or more. Rows of one id count as one document, also
those without id, but each row loses its own lines only: bitmaps are kept by id and
hash of the text. Other columns are kept as they are, whatever their names, except
n_chars, which follows the text. All steps are DataFrame functions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kerfwork.llm.common import LOWER, UPPER

HOT_SHARE, HOT_ROWS, SALTS, BINS, MOST_BINS = 100_000, 2000, 64, 1 << 14, 1 << 20
BLANK = " \t\n\x0b\x0c\r"


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def own_hash() -> Column:
    """With the id, what tells rows of different texts apart."""
    return F.xxhash64("text")


def keyed_lines(docs: DataFrame, min_chars: int = 1) -> DataFrame:
    """(doc_id, own, pos, h1, h2) of lines whose key has ``min_chars`` code points."""
    keys = F.transform(lines(F.col("text")), lambda x: F.translate(F.trim(x, F.lit(BLANK)), UPPER, LOWER))
    each = docs.select("doc_id", own_hash().alias("own"), F.posexplode(keys).alias("pos", "key")).where(F.char_length("key") >= min_chars)
    return each.select("doc_id", "own", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def full_bins(at: DataFrame) -> tuple[DataFrame, list[int], int]:
    """(``at`` with its bin, bins that may hold a hot key, lines above which a key is
    hot): map-side combined counts of at most MOST_BINS rows."""
    bins = BINS
    while True:
        binned = at.withColumn("bin", F.pmod("h1", F.lit(bins)))
        counts = {r["bin"]: r["count"] for r in binned.groupBy("bin").count().collect()}
        total = sum(counts.values())
        limit = max(HOT_ROWS, total // HOT_SHARE)
        if bins >= MOST_BINS or 2 * total <= limit * bins:
            return binned, [b for b, n in counts.items() if n > limit], limit
        bins = MOST_BINS


def repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, own, pos) of the lines to drop."""
    at, full, limit = full_bins(keyed_lines(docs, min_chars))
    hot_facts = (
        at.where(F.col("bin").isin(full) if full else F.lit(False))
        .groupBy("h1", "h2", "doc_id")
        .agg(F.count("*").alias("n"), F.min(F.struct("own", "pos")).alias("at"))
        .groupBy("h1", "h2")
        .agg(F.sum("n").alias("n"), F.count("*").alias("hot_docs"), F.min(F.struct("doc_id", "at")).alias("hot_first"))
        .where(F.col("n") > limit)
        .drop("n")
    )
    rows = at.drop("bin").join(F.broadcast(hot_facts), ["h1", "h2"], "left")
    salt = F.when(F.col("hot_docs").isNull(), F.lit(0)).otherwise(1 + F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    runs = rows.withColumn("salt", salt).repartitionByRange("h1", "h2", "salt").sortWithinPartitions("h1", "h2", "salt", "doc_id", "own", "pos")
    run = W.partitionBy("h1", "h2", "salt").orderBy("doc_id", "own", "pos")
    new_doc = F.when(F.row_number().over(run) == 1, 1).when(F.lag("doc_id").over(run).eqNullSafe(F.col("doc_id")), 0).otherwise(1)
    seen = runs.withColumn("new_doc", new_doc).withColumn("first", F.row_number().over(run) == 1)
    whole = W.partitionBy("h1", "h2", "salt")
    docs_with = F.coalesce("hot_docs", F.sum("new_doc").over(whole))
    here = F.struct("doc_id", F.struct("own", "pos").alias("at"))
    is_first = F.when(F.col("hot_docs").isNull(), F.col("first")).otherwise(here.eqNullSafe(F.col("hot_first")))
    gone = seen.withColumn("docs_with", docs_with).where(F.col("docs_with") >= min_docs)
    return gone.where(~is_first).select("doc_id", "own", "pos") if keep_first else gone.select("doc_id", "own", "pos")


def run_lengths(dropped: Column, n_lines: Column) -> Column:
    """The compressed bitmap from the sorted positions dropped of ``n_lines``."""
    step = F.aggregate(
        dropped,
        F.struct(F.lit("").alias("done"), F.lit(0).alias("next"), F.lit(0).alias("run")),
        lambda a, p: F.when((a["run"] > 0) & (p == a["next"]), F.struct(a["done"].alias("done"), (p + 1).alias("next"), (a["run"] + 1).alias("run"))).otherwise(
            F.struct(
                F.concat(a["done"], F.when(a["run"] > 0, F.concat(a["run"].cast("string"), F.lit(","))).otherwise(F.lit("")), (p - a["next"]).cast("string"), F.lit(",")).alias("done"),
                (p + 1).alias("next"),
                F.lit(1).alias("run"),
            )
        ),
    )
    return F.concat(step["done"], step["run"].cast("string"), F.when(step["next"] < n_lines, F.concat(F.lit(","), (n_lines - step["next"]).cast("string"))).otherwise(F.lit("")))


def kept_positions(bitmap: Column) -> Column:
    """Positions whose keep bit is set in a compressed bitmap, ascending."""
    runs = F.transform(F.split(bitmap, ","), lambda x: x.cast("int"))
    begun = F.aggregate(
        runs,
        F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<b:int,n:int>>").alias("runs")),
        lambda a, n: F.struct((a["at"] + n).alias("at"), F.concat(a["runs"], F.array(F.struct(a["at"].alias("b"), n.alias("n")))).alias("runs")),
    )["runs"]
    keep = F.filter(begun, lambda r, i: (i % 2 == 0) & (r["n"] > 0))
    return F.flatten(F.transform(keep, lambda r: F.sequence(r["b"], r["b"] + r["n"] - 1)))


def bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """(doc_id, own, n_dropped, bitmap) of the texts that lose a line; all others
    keep every bit. The last run of kept lines is left open ("...,*" is implied)."""
    gone = repeated_lines(docs, min_docs, min_chars, keep_first)
    sets = gone.groupBy("doc_id", "own").agg(F.sort_array(F.collect_set("pos")).alias("dropped"))
    return sets.select("doc_id", "own", F.size("dropped").cast("long").alias("n_dropped"), run_lengths(F.col("dropped"), F.lit(0)).alias("bitmap"))


def apply_bitmaps(docs: DataFrame, maps: DataFrame) -> DataFrame:
    """(row, lines, kept, dropped): the columns of ``docs`` as a struct, the lines of
    the text and those kept (arrays), and the number dropped."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), lines(F.col("text")).alias("lines"), F.col("doc_id").alias("id"), own_hash().alias("own"))
    named = maps.select(F.col("doc_id").alias("map_id"), F.col("own").alias("map_own"), "n_dropped", F.col("bitmap").alias("map"))
    joined = rows.join(named, F.col("id").eqNullSafe(F.col("map_id")) & (F.col("own") == F.col("map_own")), "left")
    kept = F.transform(kept_positions(F.concat("map", F.lit(",0"))), lambda i: F.get("lines", i))
    last = F.aggregate(F.transform(F.split("map", ","), lambda x: x.cast("int")), F.lit(0), lambda a, x: a + x)
    tail = F.slice("lines", last + 1, F.greatest(F.size("lines") - last, F.lit(0)))
    return joined.select("row", "lines", F.when(F.col("map").isNull(), F.col("lines")).otherwise(F.concat(kept, tail)).alias("kept"), F.coalesce("n_dropped", F.lit(0).cast("long")).alias("dropped"))


def drop_repeated_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = True) -> DataFrame:
    """The same columns as ``docs``, texts without their repeated lines; n_chars, if
    there, follows. A null text stays null. With ``keep_first`` the first occurrence by
    (doc_id, hash of the text, position) stays; rows of one id and text are alike."""
    out = apply_bitmaps(docs, bitmaps(docs.select("doc_id", "text"), min_docs, min_chars, keep_first))
    text = F.when(F.col("row.text").isNotNull(), F.array_join("kept", "\n"))
    new = {"text": text, "n_chars": F.when(F.col("dropped") > 0, F.char_length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col("row.n_chars")) if "n_chars" in docs.columns else None}
    return out.select(*[(new[c] if c in new else F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op3_linededup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = apply_bitmaps(docs, bitmaps(docs, 10, 1, keep_first=False))
    digest = F.sha2(F.array_join("kept", "\n").cast("binary"), 256)
    return out.select("row.doc_id", F.size("lines").cast("long").alias("n_lines"), F.col("dropped").alias("n_dropped"), digest.alias("kept_sha256"))


SQL = r"""
WITH cut AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents),
keyed AS (
  SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM cut),
rep AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT a.doc_id, a.pos, a.line, r.k IS NOT NULL AS gone FROM keyed a LEFT JOIN rep r ON a.k = r.k)
SELECT doc_id, count(*) AS n_lines, CAST(sum(CASE WHEN gone THEN 1 ELSE 0 END) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""
