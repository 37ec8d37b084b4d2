"""Results that later steps start from, in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in ``spark.checkpoint.dir``; in one JVM without that setting, in a folder of this process."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local") or "cluster" in spark.sparkContext.master:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        root = _OWN.get("dir") or _OWN.setdefault("dir", "file://" + tempfile.mkdtemp(prefix="ferrule-"))
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


#: Parquet's limit of rows that are decoded together: Spark reads up to 4096 rows at once, whatever they hold, but no more than were written as a row group.
_TOGETHER = "parquet.block.row.count.limit"
#: Numbers of factors hardly repeat: a dictionary of them would be filled and thrown away for each row group.
_PLAIN = {"parquet.enable.dictionary": "false"}


def checkpointed(df: DataFrame, together: int = 4096) -> DataFrame:
    """Written and read back: lineage ends there, and a lost executor costs nothing. ``together``: rows that a reader may hold at a time."""
    path = shared_path(df.sparkSession, "factor")
    df.write.options(**_PLAIN).option(_TOGETHER, together).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def opened(uri: str):
    """The store of ``uri`` and the path in it, for a task that writes a file of its own."""
    from pyarrow import fs

    scheme, rest = uri.split(":", 1) if ":" in uri else ("file", uri)
    scheme = {"s3a": "s3", "s3n": "s3"}.get(scheme, scheme)  # as pyarrow calls what Hadoop calls so
    return fs.FileSystem.from_uri(f"{scheme}:{rest if rest.startswith('//') else '//' + rest}")


#: Rows that a single task gives back at a time.
BATCH = 65_536


def in_one_task(df: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on all rows in one task of an executor, as iterators of Arrow batches both ways, so that only what ``run`` keeps is held."""
    return df.repartition(1).mapInArrow(run, schema)


def gathered(batches, *names: str, dtype=np.int32) -> list[np.ndarray]:
    """Whole integer columns of ``batches``, in ``dtype``."""
    parts: list[list[np.ndarray]] = [[] for _ in names]
    for b in batches:
        for name, part in zip(names, parts, strict=True):
            part.append(b.column(name).to_numpy(zero_copy_only=False).astype(dtype))
    out = []
    for part in parts:
        out.append(np.concatenate([*part, np.zeros(0, dtype)]))
        part.clear()
    return out


def given_back(columns: dict[str, np.ndarray], nulls: dict[str, int] | None = None):
    """Batches of long columns of one length; ``nulls``: the value of a column that stands for null."""
    for a in range(0, len(next(iter(columns.values()))), BATCH):
        part = {k: v[a : a + BATCH].astype(np.int64) for k, v in columns.items()}
        yield pa.record_batch({k: pa.array(v, mask=v == nulls[k] if nulls and k in nulls else None) for k, v in part.items()})


class Steps:
    """A table written level by level and read by level: a level's rows are found by their folder, whatever else is there; ``done`` (0 or 1) tells rows that are
    final from what is to be added up to them."""

    def __init__(self, spark: SparkSession, schema: str, name: str, together: int = 4096):
        self.spark, self.schema, self.path, self.together = spark, schema, shared_path(spark, name), together

    def add(self, df: DataFrame) -> None:
        df.write.mode("append").options(**_PLAIN).option(_TOGETHER, self.together).partitionBy("lvl", "done").parquet(self.path)

    def every(self, done: int = 1) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path).where(f"done = {done}")

    def at(self, level: int, done: int = 1) -> DataFrame:
        return self.every(done).where(f"lvl = {level}")
