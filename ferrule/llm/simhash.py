"""SimHash near-duplicates by covering locality-sensitive hashing.

Fingerprints: each bit is the majority of that bit in the XXH64 of a text's word shingles. Candidates: give each of
64 bits a non-zero vector of r+1 binary digits; mask v keeps the bits whose vector has an odd product with v.
Two fingerprints that differ in at most r bits have differing vectors that don't span the space, so some
v is orthogonal to them all and mask v keeps none of the differing bits: the pair collides in that table
for certain. There are 2^(r+1)-1 tables (15 for r = 3), each of some 34 bits.

Equal fingerprints are one node, so groups of exact copies cost nothing. A table's bucket of over ``SPLIT`` nodes
is covered anew by 15 masks of another assignment, which keeps the guarantee. A bucket's nodes agree in all bits
that one of its rounds' masks keeps; after ``DEPTH`` = 3 rounds at most 14 bits are left in which they may differ (over all choices of three
masks), so no bucket whatever has more than 2^14 nodes, and only one so dense would. A bucket gives a spanning forest of its links, not its pairs. Components grow by
large and small stars, each round written to the shared folder.

Null and empty text: fingerprint zero, linked like any other. Null doc_id: fingerprinted; it never names a component
unless all of its documents have none. Components of unrelated texts stay apart where their doc_ids are null or repeated, though
their name, the smallest doc_id, is then the same. Repeated rows are returned each. Empty table: no rows. Extra columns are ignored,
and kept by ``keep_one``, whatever their names. Very long texts are hashed whole, 2^18 shingles at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm.shared import materialise, packed, unpacked

WORDS, SEED, RADIUS, BITS = 3, 42, 3, 64
SPLIT, DEPTH = 64, 3


def _fingerprints(texts: pa.Array, words: int, seed: int) -> np.ndarray:
    from xxhash import xxh64_intdigest

    texts = pc.ascii_lower(texts.fill_null(""))
    out = np.zeros(len(texts), np.uint64)
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(texts))
    joined = pc.binary_join(lists, " ")
    for k, text in enumerate(joined):
        raw = text.as_buffer().to_pybytes() if text.is_valid else b""
        if not raw:
            continue
        gaps = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32)
        if len(gaps) + 1 < words:
            out[k] = xxh64_intdigest(raw, seed)
            continue
        starts = [0, *(gaps[: len(gaps) + 1 - words] + 1).tolist()]
        ends = [*gaps[words - 1 :].tolist(), len(raw)]
        ones = np.zeros(BITS, np.int64)
        for a in range(0, len(starts), 1 << 18):
            h = np.fromiter((xxh64_intdigest(raw[x:y], seed) for x, y in zip(starts[a : a + (1 << 18)], ends[a : a + (1 << 18)], strict=True)), np.uint64)
            ones += np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[k] = np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0]
    return out


def _key() -> tuple[Column, Column]:
    """128 bits that name a row's doc_id and text."""
    parts = (F.col("doc_id").isNull(), F.col("doc_id"), F.col("text").isNull(), F.col("text"))
    return F.xxhash64(*parts).alias("_k1"), F.xxhash64(F.lit(1), *parts).alias("_k2")


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long), _k1, _k2 (the row's key)."""
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), *(T.StructField(x, T.LongType()) for x in ("fp", "_k1", "_k2"))])

    def run(batches):
        for batch in batches:
            fp = pa.array(_fingerprints(batch.column("text"), words, seed).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), fp, batch.column("_k1"), batch.column("_k2")], names=schema.names)

    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *_key()).mapInArrow(run, schema)


def masks(radius: int = RADIUS, round_: int = 0, bits: int = BITS) -> list[int]:
    """The masks of one round as signed longs; vectors are dealt out evenly in an order of the round's own."""
    n = 2 ** (radius + 1) - 1
    vectors = np.random.RandomState(1000 + round_).permutation(np.resize(np.arange(1, n + 1), bits))
    return [int(np.array([sum(1 << b for b in range(bits) if bin(int(vectors[b]) & v).count("1") % 2)], np.uint64).view(np.int64)[0]) for v in range(1, n + 1)]


def _forest(fps: np.ndarray, nodes: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """A spanning forest of the links among these fingerprints, block by block."""
    root = list(range(len(fps)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    edges = []
    for k in range(len(fps) - 1):
        for j in (np.flatnonzero(np.bitwise_count(fps[k + 1 :] ^ fps[k]) <= radius) + k + 1).tolist():
            a, b = find(k), find(j)
            if a != b:
                root[b] = a
                edges.append((int(nodes[k]), int(nodes[j])))
    return edges


def _buckets(members: DataFrame, round_: int, radius: int) -> DataFrame:
    """``members`` (key, fp, node) under this round's tables: key lengthened by table and masked bits."""
    tables = F.array(*(F.struct(F.lit(v).cast("byte").alias("v"), F.col("fp").bitwiseAND(F.lit(m)).alias("m")) for v, m in enumerate(masks(radius, round_))))
    keyed = members.select("key", "fp", "node", F.explode(tables).alias("_t"))
    return keyed.select(F.xxhash64("key", "_t.v", "_t.m").alias("key"), F.hash("key", "_t.m", "_t.v").alias("key2"), "fp", "node").select(F.struct("key", "key2").alias("key"), "fp", "node")


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """src, dst: edges that join exactly the (fp, node) rows that links of at most ``radius`` bits join. fp and node are unique."""
    members, found = nodes.select(F.struct(F.lit(0).cast("long").alias("key"), F.lit(0).alias("key2")).alias("key"), "fp", "node"), []
    for round_ in range(DEPTH):
        keyed = materialise(_buckets(members, round_, radius)) if round_ else _buckets(members, round_, radius)
        sizes = materialise(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("fp", "node")).alias("a"), F.max(F.struct("fp", "node")).alias("b")).where("n > 1"))
        near = F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius
        found.append(sizes.where((F.col("n") == 2) & near).select(F.col("a.node").alias("src"), F.col("b.node").alias("dst")))
        last = round_ == DEPTH - 1
        some = sizes.where("n > 2" if last else f"n > 2 and n <= {SPLIT}").select("key")
        groups = keyed.join(some, "key").groupBy("key").agg(F.collect_list(F.struct("fp", "node")).alias("m"))
        found.append(groups.select("m").mapInArrow(_linked(radius), "src long, dst long"))
        if last:
            break
        large = sizes.where(f"n > {SPLIT}").select("key")
        members = materialise(keyed.join(large, "key"))
        if not members.take(1):
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionAll(x)
    return materialise(out.distinct())


def _linked(radius: int):
    def run(batches):
        for batch in batches:
            lists = batch.column("m")
            flat = lists.flatten()
            fp, node = flat.field("fp").to_numpy().view(np.uint64), flat.field("node").to_numpy()
            at = lists.offsets.to_numpy() - lists.offsets[0].as_py()
            edges = [e for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True) for e in _forest(fp[a:b], node[a:b], radius)]
            yield pa.RecordBatch.from_arrays([pa.array([e[0] for e in edges], pa.int64()), pa.array([e[1] for e in edges], pa.int64())], names=["src", "dst"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, comp: for each node with an edge, the smallest node that it is connected to."""
    e = materialise(edges.where("src <> dst").select(F.greatest("src", "dst").alias("u"), F.least("src", "dst").alias("v")).distinct())
    state = None
    while True:
        # large star: every larger neighbour of u goes to u's smallest
        both = e.unionAll(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        e = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        least = e.groupBy("u").agg(F.min("v").alias("m"))
        e = e.join(least, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x")).select("x.u", "x.v").where("u <> v").distinct()
        e = materialise(e)
        now = e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            return e.select(F.col("u").alias("node"), F.col("v").alias("comp"))
        state = now


def _components(fps: DataFrame, radius: int) -> tuple[DataFrame, DataFrame]:
    """fp, comp of every fingerprint, and comp, first: the row of the component's smallest doc_id, by its key."""
    # a fingerprint is its own node: doc_ids may be null or repeated, so they name components only at the end
    least = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "_k1", "_k2")
    nodes = materialise(fps.groupBy("fp").agg(F.min(least).alias("first")))
    comp = components(links(nodes.select("fp", F.col("fp").alias("node")), radius))
    of = materialise(nodes.join(comp, nodes["fp"] == comp["node"], "left").select("fp", F.coalesce("comp", "fp").alias("comp"), "first"))
    return of.select("fp", "comp"), of.groupBy("comp").agg(F.min("first").alias("first"))


def group(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """doc_id, fp, component_id of every row: component_id is the smallest doc_id reachable over links."""
    fps = materialise(fingerprints(docs, words, seed))
    of, first = _components(fps, radius)
    return fps.join(of.join(first, "comp"), "fp").select("doc_id", "fp", F.col("first.doc_id").alias("component_id"))


def keep_one(docs: DataFrame, words: int = WORDS, seed: int = SEED, radius: int = RADIUS) -> DataFrame:
    """One row of each component, that of the smallest doc_id; of rows that tie, one."""
    _, first = _components(materialise(fingerprints(docs, words, seed)), radius)
    kept = packed(docs, *_key()).join(first.select("first._k1", "first._k2"), ["_k1", "_k2"], "left_semi")
    return unpacked(kept.dropDuplicates(["_k1", "_k2"]), docs.columns)
