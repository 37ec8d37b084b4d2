"""Deletion of later copies of repeated line runs, in DataFrame functions only.

The corpus is a set of sequences of lines, a line being its text without blanks at its ends; blank lines are passed over. Its suffixes
are sorted by distributed prefix doubling: rank j is a suffix's place in the order of all suffixes by their first 2^j lines. Rank 0 sorts line IDs; rank j
sorts the pairs of a suffix's own rank j-1 and that of the suffix 2^(j-1) lines on. Distinct pairs are sorted by a range partitioning, so no task
sorts more than its share, and a place is the task's number and the row's in it: in order and never equal, if not dense. Suffixes with a rank that is theirs
alone are discarded, as nothing longer of theirs is repeated; those left under one rank j are an interval of the suffix array with a longest common prefix of at least 2^j lines.

A run counts if it has ``min_words`` words or more. Each suffix asks for its interval at the depth where it has enough words, m lines: those with its
rank at m's largest power of two, 2^j, and with its rank j at the last 2^j of these m lines. Two suffixes share both if and only if their longest common prefix has m
lines or more, so this is the interval itself, found without laying out the prefix lengths between neighbours; as a line has a word at least, no interval deeper than
``min_words`` lines is asked for and doubling ends there, however long the copies are. So that runs that end with a document are found too, the
shortest window that ends at each line asks in the same way. Of an interval the first member in (doc_id, place) order stays; the others are later
copies. Later windows that touch merge into a document's maximal repeated runs, and these go.

Null text: kept as it is, no lines. Null doc_id: sorts before all. Rows with the same doc_id and text are one document: all get its verdict, and
they are no copies of each other. Empty table: no rows. Very long texts are processed whole. Extra columns are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ferrule.llm.shared import materialise, packed, unpacked

MIN_WORDS = 50
_KEY = ["d", "th"]


def _keys() -> list[Column]:
    return [F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))).alias("d"), F.xxhash64("text").alias("th")]


def lines(docs: DataFrame) -> DataFrame:
    """d, th (document), q (place among lines that aren't blank), at (place among all), a, b (name of the line), w (words)."""
    each = F.filter(F.transform(F.split("text", "\n", -1), lambda x, i: F.struct(i.alias("at"), F.trim(x, F.lit(" \t\r")).alias("s"))), lambda x: x["s"] != "")
    flat = docs.where("text is not null").select(*_keys(), F.posexplode(each).alias("q", "x"))
    words = F.greatest(F.regexp_count("x.s", F.lit(r"\S+")), F.lit(1))
    return flat.select("d", "th", "q", "x.at", F.xxhash64(F.lit(1), "x.s").alias("a"), F.xxhash64(F.lit(2), "x.s").alias("b"), words.cast("long").alias("w"))


def _ranked(suffixes: DataFrame, key: list[str]) -> DataFrame:
    """d, th, q, r of the suffixes whose ``key`` isn't theirs alone; ``r`` is in the order of ``key``, and equal where it is.

    The sorted keys are written first: joined as an aggregate they would keep its partitioning, and Spark can't split a hot key's rows then.
    """
    more = suffixes.groupBy(*key).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*key)
    order = materialise(more.repartitionByRange(*key).sortWithinPartitions(*key).withColumn("r", F.monotonically_increasing_id()))
    return suffixes.join(order, key).drop(*key)


def ranks(suffixes: DataFrame, most: int) -> list[DataFrame]:
    """d, th, q, r: ranks of the suffixes by their first 1, 2, 4, ... lines, for those that share these, up to ``most`` lines.

    ``suffixes``: d, th, q, r (rank of the line).
    """
    out = [suffixes.select("d", "th", "q", "r")]
    while 2 ** len(out) <= most:
        step = 2 ** (len(out) - 1)
        pairs = out[-1].withColumnRenamed("r", "r1").join(out[-1].select("d", "th", (F.col("q") - step).alias("q"), F.col("r").alias("r2")), ["d", "th", "q"])
        longer = materialise(_ranked(pairs, ["r1", "r2"]).select("d", "th", "q", "r"))
        if not longer.take(1):
            break
        out.append(longer)
    return out


def _windows(active: DataFrame, min_words: int) -> DataFrame:
    """d, th, s (first line), m (lines), at_from, at_to: the shortest windows of shared lines with enough words."""
    doc = W.partitionBy(*_KEY)
    c = active.withColumn("e", F.sum("w").over(doc.orderBy("q").rowsBetween(W.unboundedPreceding, 0))).withColumn("c", F.col("e") - F.col("w"))
    on, back = doc.orderBy("c").rangeBetween(0, min_words - 1), doc.orderBy("e").rangeBetween(-(min_words - 1), 0)
    one = F.lit(1)
    forward = c.select(*_KEY, F.col("q").alias("s"), F.count(one).over(on).alias("m"), F.max("q").over(on).alias("z"), (F.max("e").over(on) - F.col("c")).alias("n"), F.col("at").alias("at_from"), F.max("at").over(on).alias("at_to"))
    backward = c.select(*_KEY, F.min("q").over(back).alias("s"), F.count(one).over(back).alias("m"), F.col("q").alias("z"), (F.col("e") - F.min("c").over(back)).alias("n"), F.min("at").over(back).alias("at_from"), F.col("at").alias("at_to"))
    return forward.unionByName(backward).where((F.col("n") >= min_words) & (F.col("z") - F.col("s") + 1 == F.col("m"))).drop("n", "z").distinct()


def lcp_intervals(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, th, s (first line), m (lines), at_from, at_to, first (d, th, s): every window of ``_windows`` that occurs more than once, with the
    first member of its interval of the suffix array at depth m."""
    each = materialise(lines(docs))
    # rows that agree in doc_id and text are one document
    active = materialise(_ranked(each, ["a", "b"]).dropDuplicates(["d", "th", "q"]))
    level = ranks(active, min_words)
    windows = _windows(active, min_words).withColumn("j", F.floor(F.log2("m")).cast("int"))
    rank = level[0].withColumn("j", F.lit(0))
    for k, x in enumerate(level[1:], 1):
        rank = rank.unionByName(x.withColumn("j", F.lit(k)))
    last = F.col("s") + F.col("m") - F.pow(F.lit(2), F.col("j")).cast("long")
    left = rank.select("d", "th", "j", F.col("q").cast("long").alias("s"), F.col("r").alias("r1"))
    right = rank.select("d", "th", "j", F.col("q").cast("long").alias("_l"), F.col("r").alias("r2"))
    asked = materialise(windows.withColumn("s", F.col("s").cast("long")).join(left, ["d", "th", "j", "s"]).withColumn("_l", last).join(right, ["d", "th", "j", "_l"]).drop("j", "_l"))
    name = ["m", "r1", "r2"]
    first = materialise(asked.groupBy(*name).agg(F.min(F.struct("d", "th", "s")).alias("first"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n"))
    return asked.join(first, name).drop("r1", "r2")


def repeated_runs(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """d, th, runs: array of (a, b), first and last line (places among all lines) of each maximal later copy."""
    later = lcp_intervals(docs, min_words).where(F.struct("d", "th", "s") > F.col("first"))
    order = W.partitionBy(*_KEY).orderBy("s", "m")
    reach = F.max(F.col("s") + F.col("m")).over(order.rowsBetween(W.unboundedPreceding, -1))
    starts = later.withColumn("_new", (reach.isNull() | (F.col("s") > reach)).cast("int"))
    run = starts.withColumn("_run", F.sum("_new").over(order.rowsBetween(W.unboundedPreceding, 0)))
    runs = run.groupBy(*_KEY, "_run").agg(F.min("at_from").alias("a"), F.max("at_to").alias("b"))
    return runs.groupBy(*_KEY).agg(F.sort_array(F.collect_list(F.struct("a", "b"))).alias("runs"))


def delete_copies(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """row (a struct of the columns of ``docs``), text (rewritten), runs: the (first, last) lines deleted, null if none."""
    runs = materialise(repeated_runs(docs, min_words))
    d, th = _keys()
    joined = packed(docs, d, th).join(runs.hint("shuffle_hash"), _KEY, "left")
    gone = lambda i: F.exists("runs", lambda r: (i >= r["a"]) & (i <= r["b"]))
    own = F.col("row.text")
    return joined.select("row", F.when(F.col("runs").isNull(), own).otherwise(F.array_join(F.filter(F.split(own, "\n", -1), lambda x, i: ~gone(i)), "\n")).alias("text"), "runs")


def report(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, n_deleted (lines), runs (as from-to,...), text."""
    r = delete_copies(docs.select("doc_id", "text"), min_words)
    n = F.aggregate("runs", F.lit(0).cast("long"), lambda s, x: s + x["b"] - x["a"] + 1)
    return r.select("row.doc_id", F.coalesce(n, F.lit(0).cast("long")).alias("n_deleted"), F.coalesce(F.array_join(F.transform("runs", lambda x: F.concat_ws("-", x["a"], x["b"])), ","), F.lit("")).alias("runs"), "text")


def clean(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """The columns of ``docs``, later copies deleted; a document of which nothing but blanks remains goes."""
    r = delete_copies(docs, min_words)
    return unpacked(r.where(F.col("runs").isNull() | F.col("text").rlike(r"\S")), docs.columns, text=F.col("text"))
