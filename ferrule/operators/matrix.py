"""Sparse symmetric matrices as coo(i, j, v) with i >= j, from 0. All of it stays in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def expand(coo: DataFrame) -> DataFrame:
    """Both triangles."""
    rest = [c for c in coo.columns if c not in ("i", "j")]
    return coo.unionByName(coo.where("i <> j").select(F.col("j").alias("i"), F.col("i").alias("j"), *rest))


def lower(coo: DataFrame) -> DataFrame:
    return coo.where("i >= j")


def permute(coo: DataFrame, perm: DataFrame) -> DataFrame:
    """P A P': each entry moves to its new row and column, and back below the diagonal."""
    rows, cols = (perm.select(F.col("old").alias(x), F.col("new").alias(f"_{x}")) for x in "ij")
    rest = [c for c in coo.columns if c not in ("i", "j")]
    return coo.join(rows, "i").join(cols, "j").select(F.greatest("_i", "_j").alias("i"), F.least("_i", "_j").alias("j"), *rest)


def permute_rows(x: DataFrame, perm: DataFrame) -> DataFrame:
    return x.join(perm, x["i"] == perm["old"]).select(F.col("new").alias("i"), *[c for c in x.columns if c != "i"])


def multiply(coo: DataFrame, x: DataFrame) -> DataFrame:
    """A x for x(i, k, v), from the lower triangle."""
    right = x.select(F.col("i").alias("j"), "k", F.col("v").alias("x"))
    return expand(coo).join(right, "j").groupBy("i", "k").agg(F.sum(F.col("v") * F.col("x")).alias("v"))


def axpy(a: float, x: DataFrame, y: DataFrame) -> DataFrame:
    both = x.select("i", "k", (F.col("v") * a).alias("v")).unionByName(y.select("i", "k", "v"))
    return both.groupBy("i", "k").agg(F.sum("v").alias("v"))


def norm(x: DataFrame) -> DataFrame:
    """One row (norm)."""
    return x.agg(F.sqrt(F.coalesce(F.sum(F.col("v") * F.col("v")), F.lit(0.0))).alias("norm"))


def frobenius(coo: DataFrame) -> DataFrame:
    """One row (norm) of the whole matrix."""
    twice = F.when(F.col("i") == F.col("j"), 1.0).otherwise(2.0)
    return coo.agg(F.sqrt(F.coalesce(F.sum(twice * F.col("v") * F.col("v")), F.lit(0.0))).alias("norm"))


def residual(coo: DataFrame, x: DataFrame, b: DataFrame) -> DataFrame:
    """One row (residual): ||A x - b|| / ||b||, or ||A x|| if b is zero; one aggregation over both sides' sums."""
    both = multiply(coo, x).select("i", "k", "v", F.lit(0.0).alias("b")).unionByName(b.select("i", "k", F.lit(0.0).alias("v"), F.col("v").alias("b")))
    each = both.groupBy("i", "k").agg(F.sum("v").alias("v"), F.sum("b").alias("b"))
    off, size = F.sum((F.col("v") - F.col("b")) * (F.col("v") - F.col("b"))), F.sum(F.col("b") * F.col("b"))
    return each.agg(F.coalesce(F.sqrt(off) / F.when(size > 0, F.sqrt(size)).otherwise(1.0), F.lit(0.0)).alias("residual"))


def is_permuted(coo: DataFrame, perm: DataFrame, permuted: DataFrame) -> DataFrame:
    """One row (is_permuted): whether ``permuted`` has the entries of ``coo`` as ``perm`` places them."""
    rest = [c for c in ("i", "j", "v") if c in coo.columns]
    sign = lambda df, s: df.select(*rest, F.lit(s).alias("_s"))
    left = sign(permute(coo, perm), 1).unionByName(sign(permuted, -1)).groupBy(*rest).agg(F.sum("_s").alias("_s"))
    return left.agg((F.coalesce(F.sum(F.abs("_s")), F.lit(0)) == 0).alias("is_permuted"))


def degree(coo: DataFrame) -> DataFrame:
    return expand(coo.select("i", "j")).groupBy(F.col("j").alias("node")).agg(F.sum((F.col("i") != F.col("j")).cast("long")).alias("degree"))


def structure(coo: DataFrame) -> DataFrame:
    """Row lists by column."""
    return coo.groupBy("j").agg(F.sort_array(F.collect_list("i")).alias("rows"))


def counts(coo: DataFrame) -> DataFrame:
    return coo.agg(F.countDistinct("j").alias("columns"), F.count(F.lit(1)).alias("entries"))


def set_base(coo: DataFrame, shift: int) -> DataFrame:
    return coo.withColumns({"i": F.col("i") + shift, "j": F.col("j") + shift})


def without_diagonal(coo: DataFrame) -> DataFrame:
    return coo.where("i <> j")


def with_diagonal(coo: DataFrame, n: int) -> DataFrame:
    """Every diagonal entry is there, as zero where it was missing."""
    full = coo.sparkSession.range(n).select(F.col("id").alias("i"), F.col("id").alias("j"), F.lit(0.0).alias("v"))
    return coo.unionByName(full).groupBy("i", "j").agg(F.sum("v").alias("v"))


def sort_entries(coo: DataFrame) -> DataFrame:
    return coo.sortWithinPartitions("j", "i")


def redistribute(coo: DataFrame, parts: int) -> DataFrame:
    """Consecutive columns together."""
    return coo.repartitionByRange(parts, "j")


def redistribute_supernodes(coo: DataFrame, columns: DataFrame, parts: int) -> DataFrame:
    """All columns of a supernode together; ``columns``: j, sid."""
    return coo.join(columns.select("j", "sid"), "j").repartition(parts, "sid")


def copy_pattern(coo: DataFrame, value: float = 0.0) -> DataFrame:
    return coo.select("i", "j", F.lit(value).alias("v"))


def validate(coo: DataFrame, n: int) -> None:
    """Raises for entries out of range or above the diagonal, repeated entries, and values that aren't finite; so for a matrix of both triangles too."""
    bad = coo.agg(
        F.count_if((F.col("i") < F.col("j")) | (F.col("j") < 0) | (F.col("i") >= n)).alias("outside"),
        F.count_if(F.col("v").isNull() | F.isnan("v") | (F.abs("v") == float("inf"))).alias("not finite"),
    ).first()
    twice = coo.groupBy("i", "j").count().where("count > 1").limit(1).count()
    for name, found in {**bad.asDict(), "repeated": twice}.items():
        if found:
            raise ValueError(f"entries {name}: {found}")
