"""Best-fit packing after Martello-Toth dominance reduction.

A packing depends on lengths alone, and there are at most ``capacity`` of them. So the exact histogram of
piece lengths (at most 2048 rows) comes to the driver, which packs *counts* of lengths: first the dominance
rules fix sets of pieces that some optimal packing holds, then best-fit decreasing places the remainder.
The plan has a few thousand entries however many documents there are. Pieces then find their places by their
rank among the pieces of their length, from two-level counts; no group of pieces ever meets in one task.

Null text: empty, one piece of the end id alone. Empty table: no rows. Repeated rows: each is packed. A
document over ``capacity`` is cut into full pieces and a remainder. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ferrule.llm import tokens
from ferrule.llm.shared import materialise

CAPACITY, END_ID = 2048, 0
#: Pieces of one length that share a bucket of ranks, about.
BUCKET_ROWS = 100_000

Pattern = tuple[int, list[tuple[int, int]]]


def _shrink(count: np.ndarray, capacity: int) -> list[Pattern]:
    """Takes from ``count`` the pieces of sets that dominate every other set holding their largest piece."""
    fixed: list[Pattern] = []

    def fix(times: int, *sizes: int) -> None:
        per = {x: sizes.count(x) for x in dict.fromkeys(sizes)}
        for x, q in per.items():
            count[x] -= times * q
        fixed.append((times, list(per.items())))

    def most(*sizes: int) -> int:
        return min(int(count[x]) // sizes.count(x) for x in sizes)

    changed = True
    while changed:
        changed = False
        for j in range(capacity, 0, -1):
            while count[j]:
                room = capacity - j
                count[j] -= 1
                there = np.flatnonzero(count)
                small = [int(x) for x in np.repeat(there[:3], np.minimum(count[there[:3]], 3))[:3]]
                fits = there[: np.searchsorted(there, room, side="right")]
                best = int(fits[-1]) if len(fits) else 0
                pair = _best_pair(count, fits, room)
                beyond = there[np.searchsorted(there, pair[1], side="right") :] if pair else []
                count[j] += 1
                if not best:
                    fix(int(count[j]), j)
                elif best == room or len(small) < 2 or sum(small[:2]) > room:
                    fix(most(j, best), j, best)
                elif len(small) < 3 or sum(small[:3]) > room:  # at most two more fit
                    if best >= sum(pair):
                        fix(most(j, best), j, best)
                    elif pair[0] == best and _no_pair(count, beyond, room, j):
                        fix(most(j, *pair), j, *pair)
                    else:
                        break
                else:
                    break
                changed = True
    return fixed


def _best_pair(count: np.ndarray, fits: np.ndarray, room: int) -> tuple[int, int] | None:
    """The two pieces of the largest sum within ``room``, larger first; of equal sums the one with the largest piece."""
    if not len(fits):
        return None
    low = np.minimum(np.searchsorted(fits, room - fits, side="right"), np.arange(len(fits)) + (count[fits] > 1)) - 1
    total = np.where(low >= 0, fits + fits[np.maximum(low, 0)], -1)
    at = len(fits) - 1 - int(total[::-1].argmax())
    return (int(fits[at]), int(fits[low[at]])) if total[at] > 0 else None


def _no_pair(count: np.ndarray, beyond, room: int, j: int) -> bool:
    """Whether the two smallest pieces over the pair's second are too much together."""
    if not len(beyond):
        return True
    least = int(beyond[0])
    again = count[least] - (least == j) > 1
    return not again and (len(beyond) < 2 or least + int(beyond[1]) > room) or again and 2 * least > room


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Bins as (number, [(length, copies), ...]) that together hold the histogram's pieces exactly."""
    count = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        count[length] += n
    done = _shrink(count, capacity)
    open_bins: dict[int, list[Pattern]] = defaultdict(list)
    open_bins[capacity] = []
    for length in range(capacity, 0, -1):
        n = int(count[length])
        while n:
            room = next((r for r in range(length, capacity) if open_bins.get(r)), 0)
            bins, slots = open_bins[room].pop() if room else (n, [])
            room = room or capacity
            each = min(room // length, n)
            used = min(bins, n // each)
            if bins > used and slots:
                open_bins[room].append((bins - used, slots))
            (open_bins[room - each * length] if room > each * length else done).append((used, [*slots, (length, each)]))
            n -= used * each
    return done + [x for r, group in open_bins.items() for x in group]


def _places(patterns: list[Pattern], capacity: int) -> dict[str, np.ndarray]:
    """Slots by length, then by the first rank they take: first rank (over all lengths), copies a bin, first bin, offset."""
    rows, bin0 = [], 0
    for bins, slots in patterns:
        at = 0
        for length, each in slots:
            rows.append((length, bins * each, each, bin0, at))
            at += length * each
        bin0 += bins
    rows.sort(key=lambda r: r[0])
    a = np.array(rows, np.int64).reshape(-1, 5)
    ends = np.cumsum(a[:, 1])
    first = np.zeros(capacity + 2, np.int64)
    np.add.at(first, a[:, 0] + 1, a[:, 1])
    return {"length": a[:, 0], "from": ends - a[:, 1], "each": a[:, 2], "bin": a[:, 3], "offset": a[:, 4], "first": np.cumsum(first)}


def cut(docs: DataFrame, vocab: str = tokens.VOCAB, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece of every document."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("piece", T.IntegerType()), *(T.StructField(x, T.LongType()) for x in ("start", "length", "ids_crc32"))])

    def pieces(batches):
        enc = tokens.encoder(vocab)
        for batch in batches:
            at = 0
            for n, offsets, ids in enc.texts(batch.column("text"), end_id):
                sizes = np.diff(offsets)
                cuts = -(-sizes // capacity)
                doc = np.repeat(np.arange(n), cuts)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(cuts) - cuts, cuts)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                begin = offsets[doc] + start
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(begin.tolist(), (begin + length).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, n).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())], names=schema.names)
                at += n

    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(pieces, schema)


def pack(docs: DataFrame, vocab: str = tokens.VOCAB, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """Each piece of ``docs`` with its sequence_id and offset there."""
    pieces = materialise(cut(docs, vocab, end_id, capacity)).withColumn("_row", F.monotonically_increasing_id())
    histogram = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}
    buckets = max(64, sum(histogram.values()) // BUCKET_ROWS)
    places = _places(plan(histogram, capacity), capacity)
    keyed = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    before = keyed.groupBy("length", "_bucket").count()
    before = before.withColumn("_before", F.sum("count").over(W.partitionBy("length").orderBy("_bucket")) - F.col("count"))
    ranked = keyed.withColumn("_rank", F.row_number().over(W.partitionBy("length", "_bucket").orderBy("_row")))
    ranked = ranked.join(before.select(F.col("length").alias("_l"), F.col("_bucket").alias("_b"), "_before"), (F.col("length") == F.col("_l")) & (F.col("_bucket") == F.col("_b")))
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("_before") + F.col("_rank") - 1).alias("_rank"))
    schema = T.StructType([*ranked.schema.fields[:-1], T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def place(batches):
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("_rank").to_numpy() + places["first"][length]
            slot = np.searchsorted(places["from"], rank, side="right") - 1
            inside = rank - places["from"][slot]
            each = places["each"][slot]
            columns = [*batch.columns[:-1], pa.array(places["bin"][slot] + inside // each), pa.array(places["offset"][slot] + inside % each * length)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return ranked.mapInArrow(place, schema)
