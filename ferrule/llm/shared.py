"""Tables, the shared folder and prefix sums that the operators have in common."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ferrule.functions.scan import prefix_sum

__all__ = ["materialise", "packed", "prefix_sum", "shared_dir", "table", "unpacked"]
_OWN_DIR: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder below ``spark.checkpoint.dir``, which all executors see.

    Only where that is unset and Spark runs in one JVM, a folder of this process is used.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        root = _OWN_DIR.get(app) or _OWN_DIR.setdefault(app, "file://" + tempfile.mkdtemp(prefix="ferrule-"))
    return f"{root.rstrip('/')}/ferrule-{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` into the shared folder and read it back: lineage ends there, and a lost executor costs nothing."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def packed(docs: DataFrame, *own: Column) -> DataFrame:
    """``row``, a struct of all columns of ``docs``, beside ``own``: whatever the names in ``docs``, none clashes with one of an operator's."""
    return docs.select(F.struct(*(docs[f"`{c}`"] for c in docs.columns)).alias("row"), *own)


def unpacked(df: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The columns that ``packed`` put into ``row``, but for those of ``changed``."""
    return df.select(*(changed[c].alias(c) if c in changed else F.col("row")[c].alias(c) for c in columns))
