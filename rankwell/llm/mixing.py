"""Mixing sources to target weights by hash-random order and exact budgets (DataFrame functions only).

Every document gets a hash-random key.  Within a source the keys are cut into
ranges (buckets) of about ``rows_per_bucket`` rows: as the keys are uniform, the
bucket is a linear function of the key, so no sampling is needed and a source
with a third of all rows is spread over many tasks.  A prefix sum of the sizes
runs inside each bucket, the totals of the buckets give the offsets, and each
source is cut at its exact budget: ``budget // source_size`` whole epochs, then
the documents at the head of the hash order, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rankwell.llm.common import WORD, documents, prepare, staged

#: No source is taken more often than this.
MAX_EPOCHS = 3


def word_count(text: Column) -> Column:
    """Number of words of the text, null counts as empty."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def hash_key(doc_id: Column, seed: str) -> Column:
    """60 uniform bits from MD5 of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def source_targets(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """(source, source_size, n_rows, target): targets by water-filling.

    Sources in code-point order (null last) weigh 1, 2, 3 in turn.  With level x
    a source gets min(3 * size, x * weight); x is found where the targets add up
    to all words: sources sorted by 3 * size / weight fill up one after the other.
    The table has one row per source.
    """
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_rows"))
    order = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(order) - 1) % len(weights)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
    per = per.withColumn("cap", F.col("source_size").cast("double") * MAX_EPOCHS)
    fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    per = per.withColumn("total", F.sum("source_size").over(every).cast("double"))
    per = per.withColumn("full", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
    per = per.withColumn("w_full", F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    per = per.withColumn("w_all", F.sum("weight").over(every))
    # The level if exactly the sources before this one are full; the first whose cap is not reached sets it.
    per = per.withColumn("level", (F.col("total") - F.col("full")) / (F.col("w_all") - F.col("w_full")))
    per = per.withColumn("turn", F.row_number().over(fill))
    level = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.struct("turn", "level"))).over(every)["level"]
    per = per.withColumn("target", F.least("cap", level * F.col("weight")))
    return per.select("source", "source_size", "n_rows", F.coalesce("target", "cap").alias("target"))


def mix(sized: DataFrame, weights: tuple[int, ...] = (1, 2, 3), seed: str = "mix", rows_per_bucket: int = 4096) -> DataFrame:
    """Words taken of each row of (doc_id, source, size).

    Returns (doc_id, source, size, source_size, target, taken).  ``taken`` may be
    over ``size`` (epochs) and in one document per source it ends inside the text,
    so that the words of a source are exactly its rounded target.  Rows that tie
    on the key (same id) are ordered by size; equal rows each count.  An empty
    input gives an empty result, a null source is a source of its own.
    """
    targets = source_targets(sized, weights).withColumn("budget", F.floor(F.col("target") + 0.5).cast("long"))
    targets = targets.withColumn("buckets", F.ceil(F.col("n_rows") / rows_per_bucket).cast("long"))
    targets = targets.withColumnRenamed("source", "t_source")
    keyed = sized.select("doc_id", "source", "size", hash_key(F.col("doc_id"), seed).alias("key"))
    rows = keyed.join(targets, F.col("source").eqNullSafe(F.col("t_source")), "left").drop("t_source")
    # key is uniform below 2**60: its top 30 bits times the number of buckets, over 2**30.
    rows = rows.withColumn("bucket", F.shiftright(F.shiftright("key", 30) * F.col("buckets"), 30))
    run = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inside", F.coalesce(F.sum("size").over(run), F.lit(0)))
    totals = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(F.col("source").alias("o_source"), F.col("bucket").alias("o_bucket"), F.coalesce(F.sum("words").over(earlier), F.lit(0)).alias("offset"))
    rows = rows.join(offsets, F.col("source").eqNullSafe(F.col("o_source")) & (F.col("bucket") == F.col("o_bucket")), "left")
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("budget") / F.col("source_size"))).otherwise(0).cast("long")
    rest = F.col("budget") - epochs * F.col("source_size")
    partial = F.greatest(F.lit(0), F.least(F.col("size"), rest - F.col("offset") - F.col("inside")))
    taken = (epochs * F.col("size") + partial).cast("long").alias("taken")
    return rows.select("doc_id", "source", "size", F.col("source_size").cast("long"), F.col("target").cast("double"), taken)


def sized_documents(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def take_documents(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document once per whole copy taken, and cut after its last taken word in a partial copy.

    Documents of which no word is taken (empty ones too) are left out.  The key of
    the join is the id with the size, so rows that repeat an id stay apart unless
    they are equal in both, and then their copies are shared out evenly in total.
    """
    columns = docs.columns
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("of"), word_count(F.col("text")).alias("words"))
    taken = mix(staged(row.select(F.col("id").alias("doc_id"), F.col("of").alias("source"), F.col("words").alias("size")), "mixing"), **options)
    # Rows equal in (id, source, size) are interchangeable: number them on both sides.
    same = Window.partitionBy("doc_id", "source", "size").orderBy("taken")
    plan = taken.select(F.col("doc_id").alias("p_id"), F.col("source").alias("p_of"), F.col("size").alias("p_words"), "taken", F.row_number().over(same).alias("p_no"))
    each = Window.partitionBy("id", "of", "words").orderBy(F.xxhash64("row.text"))
    key = F.col("id").eqNullSafe(F.col("p_id")) & F.col("of").eqNullSafe(F.col("p_of")) & (F.col("words") == F.col("p_words")) & (F.col("no") == F.col("p_no"))
    rows = row.withColumn("no", F.row_number().over(each)).join(plan, key).where("taken > 0")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("taken") - 1) / F.col("words")))))
    left = F.least(F.col("words"), F.col("taken") - F.col("copy") * F.col("words")).cast("int")
    pieces = F.regexp_extract_all("row.text", F.lit(r"[\x20\x09-\x0D]*" + WORD), F.lit(0))
    rows = rows.withColumn("whole", left == F.col("words")).withColumn("cut", F.when(~F.col("whole"), F.array_join(F.slice(pieces, F.lit(1), left), "")))
    changed = {"text": F.coalesce("cut", "row.text").alias("text")}
    if "n_chars" in columns:
        changed["n_chars"] = F.when(F.col("whole"), F.col("row.n_chars")).otherwise(F.length("cut").cast("long")).alias("n_chars")
    return rows.select(*[changed.get(c, F.col(f"row.`{c}`").alias(c)) for c in columns])


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mix all documents: doc_id, size, source_size, target, taken."""
    prepare(spark)
    sized = staged(sized_documents(documents(spark, sf_dir)), "mixing")  # texts are read and counted once
    return mix(sized).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3.0 * sum(size)::DOUBLE AS cap,
         [1.0, 2.0, 3.0][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS weight
  FROM sized GROUP BY source
), filled AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE AS total, sum(weight) OVER () AS w_all,
         coalesce(sum(cap) OVER w, 0) AS "full", coalesce(sum(weight) OVER w, 0) AS w_full
  FROM per WINDOW w AS (ORDER BY cap / weight, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), levels AS (
  SELECT *, (total - "full") / (w_all - w_full) AS level, row_number() OVER (ORDER BY cap / weight, source ASC NULLS LAST) AS turn FROM filled
), targets AS (
  SELECT source, source_size, coalesce(least(cap, (arg_min(level, turn) FILTER (WHERE level * weight <= cap) OVER ()) * weight), cap)::DOUBLE AS target FROM levels
), ordered AS (
  SELECT s.*, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
         coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY substr(md5('mix:' || coalesce(s.doc_id::VARCHAR, '')), 1, 15), s.doc_id, s.size
                                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0
            ELSE (budget // source_size) * size + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM ordered
"""
