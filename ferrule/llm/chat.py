"""Chat formatting after collapse of cumulative snapshots, in DataFrame functions only.

Loggers often store a conversation anew after each turn. The hash of a conversation's first n turns rolls along its
turns (an exclusive-or of hashes of place, role and text, twice 64 bits). A conversation whose whole hash is some
other's hash at the same n, with more turns after it, is a snapshot and an anti-join drops it; of conversations that are equal turn by
turn the smallest conv_id stays. What remains is rendered, in parts of ``PART_TURNS`` turns, so no row grows without bound.

Turns are ordered by turn (null first), ties by role, then text. Null role and text: empty. Null conv_id: one
conversation. Repeated rows are turns of their own. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

PART_TURNS = 1024
OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, i (from 0), role, text, h1, h2 (hashes of turns 0..i), last."""
    order = W.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "text")
    t = turns.select("conv_id", "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = t.withColumn("i", F.row_number().over(order) - 1).withColumn("last", F.lead(F.lit(False), 1, True).over(order))
    upto = W.partitionBy("conv_id").orderBy("i").rowsBetween(W.unboundedPreceding, 0)
    for k in (1, 2):
        t = t.withColumn(f"h{k}", F.bit_xor(F.xxhash64(F.lit(k), "i", "role", "text")).over(upto))
    return t.select("conv_id", "i", "role", "text", "h1", "h2", "last")


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns of the conversations that prefix no longer one."""
    p = prefixes(turns).select("conv_id", "i", "h1", "h2", "last")
    inner = p.where(~F.col("last")).select("i", "h1", "h2").distinct()
    # one row for all conversations that are equal, before they meet the prefixes: no hash has more than a row on either side
    whole = p.where("last").groupBy("i", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    return whole.join(inner, ["i", "h1", "h2"], "left_anti").select("conv_id", (F.col("i") + 1).cast("long").alias("n_turns"))


def render(turns: DataFrame) -> DataFrame:
    """conv_id, part, n_turns (of the conversation), text. Markers inside a text are broken up."""
    kept = maximal(turns).select(F.col("conv_id").alias("_c"), "n_turns")
    p = prefixes(turns).select("conv_id", "i", "role", "text").join(kept, F.col("conv_id").eqNullSafe(F.col("_c")))
    clean = lambda c: F.replace(F.replace(c, F.lit(OPEN), F.lit("<| im_start|>")), F.lit(CLOSE), F.lit("<| im_end|>"))
    one = F.concat(F.lit(OPEN), clean(F.col("role")), F.lit("\n"), clean(F.col("text")), F.lit(CLOSE + "\n"))
    parts = p.select("conv_id", "n_turns", F.floor(F.col("i") / PART_TURNS).cast("long").alias("part"), F.struct("i", one.alias("t")).alias("x"))
    return parts.groupBy("conv_id", "n_turns", "part").agg(F.sort_array(F.collect_list("x")).alias("x")).select("conv_id", "part", "n_turns", F.array_join(F.transform("x", lambda y: y["t"]), "").alias("text"))


ORACLE_SQL = f"""
WITH t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce("text", '') AS txt, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce("text", '')) - 1 AS i FROM conversations),
c AS (SELECT conv_id, count(*) AS n, string_agg(chr(1) || role || chr(2) || txt || chr(3), '' ORDER BY i) AS s FROM t GROUP BY conv_id),
m AS (SELECT a.conv_id, a.n FROM c a WHERE NOT EXISTS (SELECT 1 FROM c b WHERE b.n > a.n AND starts_with(b.s, a.s)) AND NOT EXISTS (SELECT 1 FROM c b WHERE b.s = a.s AND b.conv_id < a.conv_id))
SELECT t.conv_id, CAST(floor(t.i / {PART_TURNS}) AS BIGINT) AS part, CAST(m.n AS BIGINT) AS n_turns,
  string_agg('{OPEN}' || replace(replace(t.role, '{OPEN}', '<| im_start|>'), '{CLOSE}', '<| im_end|>') || chr(10) || replace(replace(t.txt, '{OPEN}', '<| im_start|>'), '{CLOSE}', '<| im_end|>') || '{CLOSE}' || chr(10), '' ORDER BY t.i) AS "text"
FROM t JOIN m USING (conv_id) GROUP BY t.conv_id, CAST(floor(t.i / {PART_TURNS}) AS BIGINT), m.n
"""
