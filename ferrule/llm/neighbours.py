"""Approximate nearest neighbours by an inverted multi-index.

Vectors are scaled to length one and cut in halves; each half has its own centroids (k-means on at most ``SAMPLE`` vectors, those of the
smallest hash). Their number grows with the square root of the table's, so that cells, which are pairs of centroids, hold about as many vectors
at any size: finer cells need a smaller part of the table for the same recall. A query walks the cells in order of the sum of its halves'
distances, with a heap (the multi-sequence walk), until they hold ``SHARE`` of all vectors; these are reranked by their exact cosine in
double precision. ``SHARE`` is a share and not a number, so recall doesn't fall as the table grows; ``search`` takes a smaller one where vectors lie in clusters.

Equal vectors are one entry with its ``k``+1 smallest ids, which is all that a top-k can use. Cells are put together into groups of
about ``GROUP_ROWS`` entries, larger cells are split, and queries go by blocks: a task sees one group against one block, and keeps the
best k+1 of each query. Cosines are taken of vectors scaled by a power of two, which rounds nothing and can't overflow.

Null and zero vectors, vectors with null or non-finite components, null ids, and vectors of another length than most take no part. Ties go to the smaller
vec_id. A vec_id's own rows are no candidates for it; rows repeated whole are one. Empty table: no rows. Extra columns are ignored.
"""

from __future__ import annotations

import heapq

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ferrule.llm.shared import materialise

K, EVERY = 5, 50
SAMPLE, ROUNDS, SHARE = 20_000, 10, 0.6
#: Centroids of a half: a quarter of the square root of the number of vectors, within these bounds: finer cells make walks longer than they save reranking.
CENTROIDS = (32, 512)
GROUP_ROWS, QUERY_BLOCK = 2048, 8192


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v (array of double) of the rows that take part."""
    v = F.col("embedding").cast("array<double>")
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + F.lit(0.0)).alias("v"))
    size = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size("v") == (size["n"] if size else 0))


def _units(m: np.ndarray) -> np.ndarray:
    m = _scaled(m)
    return m / np.sqrt((m * m).sum(axis=1, keepdims=True))


def _scaled(m: np.ndarray) -> np.ndarray:
    """Each row times a power of two, so that its largest component is in [0.5, 1)."""
    return np.ldexp(m, -np.frexp(np.abs(m).max(axis=1, keepdims=True))[1])


def _kmeans(x: np.ndarray, k: int, rounds: int) -> np.ndarray:
    c = x[np.random.RandomState(7).permutation(len(x))[:k]].copy()
    for _ in range(rounds):
        near = _nearest(x, c)
        for j in np.unique(near):
            c[j] = x[near == j].mean(axis=0)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c * c).sum(1) - 2 * x @ c.T).argmin(axis=1)


def _distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.maximum((x * x).sum(1)[:, None] + (c * c).sum(1) - 2 * x @ c.T, 0)


def walk(d1: np.ndarray, d2: np.ndarray, counts: np.ndarray, wanted: float) -> list[int]:
    """Cells in order of d1[a] + d2[b] until ``wanted`` vectors are in them; empty ones are passed over."""
    o1, o2 = d1.argsort(kind="stable"), d2.argsort(kind="stable")
    heap, seen, cells, held = [(d1[o1[0]] + d2[o2[0]], 0, 0)], {(0, 0)}, [], 0
    while heap and held < wanted:
        _, a, b = heapq.heappop(heap)
        cell = int(o1[a]) * len(d2) + int(o2[b])
        if counts[cell]:
            cells.append(cell)
            held += int(counts[cell])
        for x, y in ((a + 1, b), (a, b + 1)):
            if x < len(d1) and y < len(d2) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (d1[o1[x]] + d2[o2[y]], x, y))
    return cells


def search(vectors: DataFrame, queries: DataFrame, k: int = K, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score of the ``k`` nearest of ``vectors`` for each (vec_id, v) of ``queries``; both as ``usable`` gives them."""
    spark = vectors.sparkSession
    order = W.partitionBy("v").orderBy("vec_id")
    least = vectors.dropDuplicates(["vec_id", "v"]).withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k + 1)
    entries = materialise(least.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).withColumn("entry", F.col("ids")[0]))
    sample = entries.orderBy(F.xxhash64("v"), "entry").limit(SAMPLE).select("v").toPandas()["v"]
    empty = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if not len(sample):
        return empty
    x = _units(np.stack(sample))
    half = x.shape[1] // 2
    centroids = min(len(x), max(CENTROIDS[0], min(CENTROIDS[1], round(entries.count() ** 0.5 / 4))))
    centres = [_kmeans(x[:, s], centroids, ROUNDS) for s in (slice(0, half), slice(half, None))]
    shared = spark.sparkContext.broadcast(centres)

    def cells(frames):
        c1, c2 = shared.value
        for f in frames:
            u = _units(np.stack(f["v"]))
            yield f.assign(cell=(_nearest(u[:, : c1.shape[1]], c1) * len(c2) + _nearest(u[:, c1.shape[1] :], c2)).astype(np.int32))

    placed = materialise(entries.mapInPandas(cells, "v array<double>, ids array<long>, entry long, cell int"))
    # at most the square of CENTROIDS' bound in rows
    counts = np.zeros(len(centres[0]) * len(centres[1]), np.int64)
    for r in placed.groupBy("cell").count().collect():
        counts[r["cell"]] = r["count"]
    first, parts, group, held = np.zeros(len(counts), np.int32), np.ones(len(counts), np.int32), 0, 0
    for cell, n in enumerate(counts.tolist()):
        if held and held + n > GROUP_ROWS:
            group, held = group + 1, 0
        first[cell], parts[cell] = group, max(1, -(-n // GROUP_ROWS))
        held += n
        if parts[cell] > 1:
            group, held = group + parts[cell], 0
    wanted = share * counts.sum()
    blocks = max(1, queries.count() // QUERY_BLOCK)
    plan = spark.sparkContext.broadcast((counts, first, parts))

    def walks(frames):
        (c1, c2), (counts, first, parts) = shared.value, plan.value
        for f in frames:
            u = _units(np.stack(f["v"]))
            d1, d2 = _distances(u[:, : c1.shape[1]], c1), _distances(u[:, c1.shape[1] :], c2)
            rows = []
            for n, (q, v) in enumerate(zip(f["entry"], f["v"], strict=True)):
                by: dict[int, list[int]] = {}
                for cell in walk(d1[n], d2[n], counts, wanted):
                    for g in range(first[cell], first[cell] + parts[cell]):
                        by.setdefault(g, []).append(cell)
                rows += [(g, int(q), v, c) for g, c in by.items()]
            yield pd.DataFrame(rows, columns=["grp", "query", "q", "visited"])

    asked = queries.groupBy("v").agg(F.min("vec_id").alias("entry"))  # equal queries are one
    spread = max(spark.sparkContext.defaultParallelism, blocks * QUERY_BLOCK // 256)
    visits = asked.repartition(spread, "entry").mapInPandas(walks, "grp int, query long, q array<double>, visited array<int>").withColumn("block", F.pmod(F.xxhash64("query"), F.lit(blocks)))
    groups = spark.createDataFrame([(c, int(first[c]), int(parts[c])) for c in range(len(counts))], "cell int, f int, p int")
    index = placed.join(F.broadcast(groups), "cell").select("cell", "entry", "ids", "v", (F.col("f") + F.pmod(F.xxhash64("entry"), F.col("p"))).cast("int").alias("grp"))
    index = index.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))

    def nearest(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({"query": [], "vec_id": [], "score": []})
        m, cell = _scaled(np.stack(right["v"])), right["cell"].to_numpy()
        norms = np.sqrt((m * m).sum(1))
        out, seen = [], np.zeros(len(plan.value[0]), bool)
        for a in range(0, len(left), 512):
            part = left.iloc[a : a + 512]
            q = _scaled(np.stack(part["q"]))
            s = (q @ m.T) / np.sqrt((q * q).sum(1))[:, None] / norms
            for n, cells in enumerate(part["visited"]):
                seen[:] = False
                seen[cells] = True
                s[n, ~seen[cell]] = -np.inf
            top = min(k + 1, s.shape[1])
            floor = np.partition(s, s.shape[1] - top, axis=1)[:, s.shape[1] - top]
            qi, mi = np.nonzero((s >= floor[:, None] - 1e-12) & np.isfinite(s))
            exact = (q[qi] * m[mi]).sum(1) / (np.sqrt((q[qi] * q[qi]).sum(1)) * np.sqrt((m[mi] * m[mi]).sum(1)))
            out.append(pd.DataFrame({"query": part["query"].to_numpy()[qi], "ids": right["ids"].to_numpy()[mi], "score": exact}))
        found = pd.concat(out).explode("ids").rename(columns={"ids": "vec_id"})
        return found.astype({"query": "int64", "vec_id": "int64", "score": "float64"})[["query", "vec_id", "score"]]

    pairs = visits.groupBy("grp", "block").cogroup(index.groupBy("grp", "block")).applyInPandas(nearest, "query long, vec_id long, score double")
    best = W.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    top = pairs.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k + 1)
    by_row = queries.join(asked.select(F.col("v").alias("_v"), F.col("entry").alias("query")), F.col("v") == F.col("_v")).select(F.col("vec_id").alias("query_id"), "query").distinct()
    found = by_row.join(top, "query").where(F.col("vec_id") != F.col("query_id"))
    rank = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(rank).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def search_table(embeddings: DataFrame, k: int = K, every: int = EVERY, share: float = SHARE) -> DataFrame:
    vectors = materialise(usable(embeddings))
    return search(vectors, vectors.where(F.col("vec_id") % every == 0), k, share)
