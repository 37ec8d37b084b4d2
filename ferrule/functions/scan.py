"""Running sums and orders over whole tables, in two levels, so that no task sees more than a block of rows and a row a block."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

BLOCK = 4096


def prefix_sum(df: DataFrame, index: str, value: str, out: str, block: int = BLOCK) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over all rows of a smaller ``index`` (distinct non-negative integers, about dense)."""
    b = df.withColumn("_block", F.floor(F.col(index) / block))
    before = b.groupBy("_block").agg(F.sum(value).alias("_v"))
    before = before.select("_block", F.coalesce(F.sum("_v").over(W.orderBy("_block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum(value).over(W.partitionBy("_block").orderBy(index).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return b.withColumn("_in", inside).join(before, "_block").withColumn(out, F.col("_in") + F.col("_base")).drop("_block", "_in", "_base")


def numbered_lines(spark, path: str) -> DataFrame:
    """file, at (start of the split), line, value of a text file, or of a folder's files in order of name, read split by split.

    A split's lines have consecutive ids, so a line's number is the lines in earlier splits and its place in its own.
    """
    raw = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("at"), F.monotonically_increasing_id().alias("id"))
    splits = raw.groupBy("file", "at").agg(F.min("id").alias("_first"), F.count(F.lit(1)).alias("_n"))  # one row a split
    splits = splits.withColumn("_before", F.coalesce(F.sum("_n").over(W.orderBy("file", "at").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    return raw.join(F.broadcast(splits), ["file", "at"]).select("file", "at", (F.col("_before") + F.col("id") - F.col("_first")).alias("line"), "value")


def numbered_words(lines: DataFrame) -> DataFrame:
    """place, word of all words of ``numbered_lines``."""
    x = lines.withColumn("_w", F.filter(F.split("value", r"\s+"), lambda w: w != "")).where(F.size("_w") > 0).withColumn("_n", F.size("_w"))
    base = x.groupBy("file", "at").agg(F.min("line").alias("_l"), F.sum("_n").alias("_s"))  # one row a split
    base = base.select("file", "at", F.coalesce(F.sum("_s").over(W.orderBy("_l").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    inside = F.coalesce(F.sum("_n").over(W.partitionBy("file", "at").orderBy("line").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    x = x.withColumn("_in", inside).join(F.broadcast(base), ["file", "at"])
    return x.select((F.col("_base") + F.col("_in")).alias("_p"), F.posexplode("_w").alias("_k", "word")).select((F.col("_p") + F.col("_k")).alias("place"), "word")
