"""Matrices and right-hand sides made from the star-schema tables, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def part_grid(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Parts on a square grid, weighted by size, diagonally dominant."""
    part = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("k"), F.col("p_size").alias("s"))
    n = part.count()
    m = next(x for x in range(1, n + 2) if x * x >= n)
    sides = part.select(F.col("k").alias("j"), F.col("s").alias("sj"), F.explode(F.when(F.col("k") % m == m - 1, F.array(F.col("k") + m)).otherwise(F.array(F.col("k") + 1, F.col("k") + m))).alias("i"))
    off = sides.join(part.select(F.col("k").alias("i"), F.col("s").alias("si")), "i").select("i", "j", (-(1 + (F.col("si") + F.col("sj")) / 100.0)).alias("v"))
    ends = off.select("i", "v").unionByName(off.select(F.col("j").alias("i"), "v"))
    diagonal = part.select(F.col("k").alias("i")).join(ends.groupBy("i").agg(F.sum(F.abs("v")).alias("a")), "i", "left").select("i", F.col("i").alias("j"), (1 + F.coalesce("a", F.lit(0.0))).alias("v"))
    return off.unionByName(diagonal), n


def order_stars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """Customers and orders, an edge an order: a forest of stars."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey")
    low, count = o.agg(F.min("o_orderkey"), F.max("o_orderkey") - F.min("o_orderkey") + 1).first()
    top = o.agg(F.max("o_custkey")).first()[0] + 1
    edges = o.select((F.col("o_custkey") + count).alias("i"), (F.col("o_orderkey") - low).alias("j"), F.lit(-1.0).alias("v"))
    ends = edges.select("i").unionByName(edges.select(F.col("j").alias("i"))).groupBy("i").count()
    n = int(count + top)
    diagonal = spark.range(n).withColumnRenamed("id", "i").join(ends, "i", "left").select("i", F.col("i").alias("j"), (1.0 + F.coalesce("count", F.lit(0))).alias("v"))
    return edges.unionByName(diagonal), n


def part_path(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """A path through all parts in order of size: neighbours are far apart in number."""
    p = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size", F.floor(F.col("p_partkey") / 65536).alias("block"))
    # numbered in two levels by values alone, so that every evaluation gives the same places
    first = p.groupBy("p_size", "block").agg(F.count(F.lit(1)).alias("c"))  # a row a size and 65536 keys
    first = first.select("p_size", "block", F.coalesce(F.sum("c").over(W.orderBy("p_size", "block").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    inside = F.row_number().over(W.partitionBy("p_size", "block").orderBy("p_partkey")) - 1
    place = p.withColumn("inside", inside).join(first, ["p_size", "block"]).select("p_partkey", (F.col("before") + F.col("inside")).alias("place"))
    edges = place.select(F.col("p_partkey").alias("a"), F.col("place")).join(place.select(F.col("p_partkey").alias("b"), (F.col("place") - 1).alias("place")), "place")
    off = edges.select(F.greatest("a", "b").alias("i"), F.least("a", "b").alias("j"), F.lit(-1.0).alias("v"))
    return off.unionByName(p.select(F.col("p_partkey").alias("i"), F.col("p_partkey").alias("j"), F.lit(3.0).alias("v"))), p.count()


def central_stars(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, int]:
    """The stars of ``order_stars`` with their centres numbered first: as numbered, each star fills in wholly; leaves first, nothing does."""
    coo, n = order_stars(spark, sf_dir)
    return coo.select((n - 1 - F.col("j")).alias("i"), (n - 1 - F.col("i")).alias("j"), "v"), n


def dirichlet_grid(spark: SparkSession, m: int, shift: float) -> tuple[DataFrame, int]:
    n = m * m
    k = spark.range(n).withColumnRenamed("id", "j")
    off = k.select("j", F.explode(F.when(F.col("j") % m == m - 1, F.array(F.col("j") + m)).otherwise(F.array(F.col("j") + 1, F.col("j") + m))).alias("i")).where(F.col("i") < n).select("i", "j", F.lit(-1.0).alias("v"))
    return off.unionByName(k.select(F.col("j").alias("i"), "j", F.lit(4.0 - shift).alias("v"))), n


def exact_solution(spark: SparkSession, n: int, nrhs: int) -> DataFrame:
    """+1 and -1 in turn."""
    x = spark.range(n).select(F.col("id").alias("i"), F.explode(F.sequence(F.lit(0), F.lit(nrhs - 1))).alias("k"))
    return x.select("i", "k", F.when((F.col("i") * nrhs + F.col("k")) % 2 == 0, 1.0).otherwise(-1.0).alias("v"))


GRID_SQL = """
p AS (SELECT p_partkey AS k, p_size AS s, (SELECT CAST(ceil(sqrt(count(*))) AS BIGINT) FROM part) AS m, (SELECT count(*) FROM part) AS n FROM part),
off AS (SELECT b.k AS i, a.k AS j, -(1 + (a.s + b.s) / 100.0::DOUBLE) AS v FROM p a JOIN p b ON (b.k = a.k + 1 AND a.k % a.m <> a.m - 1) OR b.k = a.k + a.m),
coo AS (SELECT i, j, v FROM off UNION ALL SELECT p.k, p.k, 1 + coalesce((SELECT sum(abs(v)) FROM off WHERE i = p.k OR j = p.k), 0) FROM p),
sym AS (SELECT i, j, v FROM coo UNION ALL SELECT j, i, v FROM coo WHERE i <> j)
"""
