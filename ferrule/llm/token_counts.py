"""Exact histogram of encoded lengths; suffix sums answer every context limit.

Documents are counted by length inside each batch before anything is shuffled, so what moves is one row per
length and task. For each length that occurs, the table says how many documents are that long, at most and at
least that long, how many ids they have, and how many ids remain if every document is truncated there. A limit
between two lengths is answered by ``at_limits``, a quantile by ``quantiles``, both by one row of the table.

Null text: length ``end`` (0 by default). Empty table: no rows. Repeated rows count each. Other columns are ignored. Texts of any length are encoded whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrule.llm import tokens
from ferrule.llm.shared import materialise, prefix_sum


def histogram(docs: DataFrame, vocab: str = tokens.VOCAB, end_id: int | None = None) -> DataFrame:
    """n_tokens, n_docs."""

    def count(batches):
        enc = tokens.encoder(vocab)
        for batch in batches:
            for _, offsets, _ in enc.texts(batch.column("text"), end_id):
                length, n = np.unique(np.diff(offsets), return_counts=True)
                yield pa.RecordBatch.from_pydict({"n_tokens": length.astype(np.int64), "n_docs": n.astype(np.int64)})

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "n_tokens long, n_docs long")
    return rows.groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def totals(hist: DataFrame) -> DataFrame:
    """For each n_tokens L of ``hist``: n_docs, docs_le, docs_ge, tokens_ge, tokens_truncated (sum of min(length, L)),
    tokens_lost, and quantile: the share of documents of at most L."""
    h = materialise(hist)
    n, total = h.agg(F.coalesce(F.sum("n_docs"), F.lit(0)), F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")), F.lit(0))).first()
    below = prefix_sum(h.withColumn("_t", F.col("n_docs") * F.col("n_tokens")), "n_tokens", "n_docs", "_docs_lt", 256)
    below = prefix_sum(below, "n_tokens", "_t", "_tokens_lt", 256)
    docs_ge = F.lit(n) - F.col("_docs_lt")
    kept = F.col("_tokens_lt") + docs_ge * F.col("n_tokens")
    return below.select(
        "n_tokens", "n_docs", (F.col("_docs_lt") + F.col("n_docs")).alias("docs_le"), docs_ge.alias("docs_ge"), (F.lit(total) - F.col("_tokens_lt")).alias("tokens_ge"),
        kept.alias("tokens_truncated"), (F.lit(total) - kept).alias("tokens_lost"), ((F.col("_docs_lt") + F.col("n_docs")) / F.lit(max(n, 1))).alias("quantile"),
    )


def at_limits(table: DataFrame, limits: list[int]) -> DataFrame:
    """limit, docs_over, tokens_truncated, tokens_lost for each of ``limits``, from the suffix sums that ``totals`` gave.

    The shortest length over a limit has, as its suffix sums, all documents and all ids over it: one row answers a limit, and all of
    these rows are found in one pass that keeps a row a limit.
    """
    limits = sorted({int(x) for x in limits})
    if not limits:
        return table.sparkSession.createDataFrame([], "limit long, docs_over long, tokens_truncated long, tokens_lost long")
    over = [F.min(F.when(F.col("n_tokens") > x, F.struct("n_tokens", "docs_ge", "tokens_ge"))).alias(f"_{k}") for k, x in enumerate(limits)]
    found = table.agg(F.max("docs_ge").alias("_n"), F.max("tokens_ge").alias("_t"), *over)
    each = F.explode(F.array(*(F.struct(F.lit(x).cast("long").alias("limit"), F.coalesce(F.col(f"_{k}.docs_ge"), F.lit(0)).alias("docs_over"), F.coalesce(F.col(f"_{k}.tokens_ge"), F.lit(0)).alias("ids_over")) for k, x in enumerate(limits))))
    rows = found.select(F.coalesce("_t", F.lit(0)).alias("_t"), each.alias("x")).select("_t", "x.*")
    lost = F.col("ids_over") - F.col("docs_over") * F.col("limit")
    return rows.select("limit", F.col("docs_over").cast("long").alias("docs_over"), (F.col("_t") - lost).cast("long").alias("tokens_truncated"), lost.cast("long").alias("tokens_lost"))


def quantiles(table: DataFrame, shares: list[float]) -> dict[float, int]:
    """The smallest length that at least each share of documents doesn't exceed."""
    row = table.agg(*(F.min(F.when(F.col("quantile") >= q, F.col("n_tokens"))).alias(f"q{k}") for k, q in enumerate(shares))).first()
    return dict(zip(shares, row, strict=True))
