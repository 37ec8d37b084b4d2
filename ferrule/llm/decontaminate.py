"""Benchmark decontamination: BM25 over an inverted index of test items, with block-max pruning, then overlap.

Index: a posting (term, item) weighs its BM25 impact divided by the item's impact on itself, so a passage that holds a
whole item scores 1 whatever the item's length, and one threshold serves all items. Postings of a term are in order of
item and cut into blocks, each with its largest weight.

Every document is cut into overlapping passages, twice the longest item long and one longest item apart, so an item
copied whole lies whole in some passage. A passage is a query of block-max WAND: it has a cursor in the postings of each of its terms, in order of item.
The pivot is the first item at which the largest weights of the terms so far add up to the threshold; no item before it can reach it. If the
block-max weights at the pivot don't add up to the threshold either, cursors skip to the end of the pivot's block (or to the next cursor's item, if
that comes first); else, if all of them stand at the pivot, it is scored exactly, and if not, those behind move up to it. The passages of a batch take these
steps together, each with cursors and a pivot of its own, so a step is a few array operations. Every item at or over the threshold is
retrieved, and it counts if of the 5-word shingles of its question and of its answer each at least ``overlap`` are in the passage.

The index goes to executors in blocks of at most ``INDEX_BYTES`` of item text, one pass over the documents each; document
frequencies and lengths are those of all items. An item without a separate answer is split: its last sentence, or, if there is one
alone, its last third, is the answer.

Null or empty text (document or item): no hits. Null ids are returned as such, ids of any type as they are. Repeated items and rows: each is
reported. Empty tables: no hits. Extra columns are kept by ``clean`` and ignored otherwise, whatever their names. Texts are processed whole, at any length.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

K1, B, THRESHOLD, OVERLAP, WORDS = 1.2, 0.75, 0.6, 0.8, 5
BLOCK_ITEMS, INDEX_BYTES = 16, 16_000_000
#: Text that is cut into passages at once; a single longer text is taken alone.
CHUNK_BYTES = 3_000_000
#: What rounding may take from a sum of weights.
_SLACK = 1e-9
_EDGES = r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$"


def words(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Bounds of texts, distinct words, and codes: lower case, without marks at either end; code -1: nothing left."""
    lists = pc.ascii_split_whitespace(texts)
    coded = lists.flatten().dictionary_encode()
    clean = pc.utf8_lower(pc.replace_substring_regex(coded.dictionary, _EDGES, "")).dictionary_encode()
    codes = clean.indices.to_numpy()[coded.indices.to_numpy()]
    empty = pc.index(clean.dictionary, pa.scalar("", clean.dictionary.type)).as_py()
    bounds = lists.offsets.to_numpy() - lists.offsets[0].as_py()
    kept = codes != empty
    return np.concatenate([[0], np.cumsum(kept)])[bounds], clean.dictionary, codes[kept]


def split_item(text: str) -> tuple[str, str]:
    """Question and answer."""
    parts = [x for x in re.split(r"(?<=[.?!])\s+|\n+", text.strip()) if x.strip()]
    if len(parts) > 1:
        return " ".join(parts[:-1]), parts[-1]
    w = text.split()
    cut = max(1, len(w) - max(1, len(w) // 3)) if len(w) > 1 else len(w)
    return " ".join(w[:cut]), " ".join(w[cut:])


class Index:
    """Block-max inverted index of items (item_id, question, answer)."""

    def __init__(self, items: list[tuple], idf: dict[str, float], mean_length: float):
        self.ids = [x[0] for x in items]
        halves = pa.array([h for x in items for h in x[1:]], pa.string())
        bounds, vocabulary, codes = words(halves)
        self.vocabulary = vocabulary
        self.parts = [[codes[bounds[2 * k + h] : bounds[2 * k + h + 1]] for h in (0, 1)] for k in range(len(items))]
        weight = np.array([idf.get(t, 0.0) for t in vocabulary.to_pylist()])
        term, item, impact = [], [], []
        for k, (q, a) in enumerate(self.parts):
            t, tf = np.unique(np.concatenate([q, a]), return_counts=True)
            x = weight[t] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tf.sum() / mean_length))
            term.append(t), item.append(np.full(len(t), k)), impact.append(x / x.sum() if len(t) else x)
        term, item, impact = (np.concatenate([*x, np.zeros(0)]) for x in (term, item, impact))
        order = np.lexsort((item, term))
        self.term, self.item, self.impact = term[order].astype(np.int64), item[order].astype(np.int64), impact[order]
        n = len(vocabulary)
        self.blocks = max(1, -(-len(items) // BLOCK_ITEMS))
        self.top = np.zeros(n)
        np.maximum.at(self.top, self.term, self.impact)
        # postings by (term, item), and the largest weight of each of a term's blocks
        self.key = self.term * len(items) + self.item
        self.term_ptr = np.searchsorted(self.term, np.arange(n + 1))
        block = self.term * self.blocks + self.item // BLOCK_ITEMS
        self.block_key, start, self.in_block = np.unique(block, return_index=True, return_inverse=True)
        self.block_max = np.maximum.reduceat(self.impact, start) if len(start) else np.zeros(0)
        self.longest = max([1, *(len(q) + len(a) for q, a in self.parts)])
        self.shingles = [[_shingles(x) for x in p] for p in self.parts]

    def _block_weight(self, term: np.ndarray, cursor: np.ndarray, item: np.ndarray) -> np.ndarray:
        """The largest weight of each term in the block that would hold each item; 0 if it has no posting there."""
        want = term * self.blocks + item // BLOCK_ITEMS
        at = self.in_block[cursor]
        far = np.flatnonzero(self.block_key[at] < want)
        at[far] = np.minimum(np.searchsorted(self.block_key, want[far]), len(self.block_key) - 1)
        return np.where(self.block_key[at] == want, self.block_max[at], 0.0)

    def _advance(self, term: np.ndarray, cursor: np.ndarray, item: np.ndarray) -> np.ndarray:
        """Where each cursor stands after moving on to the first posting of its term at ``item`` or later."""
        want = term * len(self.ids) + item
        at = cursor + (self.key[cursor] < want)
        far = np.flatnonzero(self.key[np.minimum(at, len(self.key) - 1)] < want)
        at[far] = np.searchsorted(self.key, want[far])
        return at

    def retrieve(self, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """passage, item, score of all at or over ``threshold``, from distinct (passage, term) pairs in order of passage."""
        low, items, out = threshold - _SLACK, len(self.ids), []
        keep = (np.bincount(passage, self.top[term])[passage] >= low) & (self.top[term] > 0) if len(passage) else np.zeros(0, bool)
        passage, term = passage[keep], term[keep]
        cursor, end = self.term_ptr[term], self.term_ptr[term + 1]
        item = self.item[cursor]
        while len(passage):
            order = np.argsort(passage * (items + 1) + item, kind="stable")
            passage, term, cursor, end, item = passage[order], term[order], cursor[order], end[order], item[order]
            first = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
            size = np.diff(np.append(first, len(passage)))
            of = np.repeat(np.arange(len(first)), size)
            weight = np.cumsum(self.top[term])
            upto = weight - np.repeat(weight[first] - self.top[term[first]], size)
            pivot = np.minimum.reduceat(np.where(upto >= low, np.arange(len(passage)), len(passage)), first)
            going = pivot < len(passage)
            at = item[np.minimum(pivot, len(passage) - 1)]
            before = going[of] & (item <= at[of])  # cursors up to the pivot
            bound = np.bincount(of[before], self._block_weight(term[before], cursor[before], at[of[before]]), len(first))
            fits = going & (bound >= low)
            ready = fits & (item[first] == at)
            scored = before & ready[of]
            score = np.bincount(of[scored], self.impact[cursor[scored]], len(first))
            hit = ready & (score >= low)
            out.append((passage[first][hit], at[hit], score[hit]))
            after = np.minimum.reduceat(np.where(item > at[of], item, items), first)
            target = np.where(ready, at + 1, np.where(fits, at, np.minimum(after, (at // BLOCK_ITEMS + 1) * BLOCK_ITEMS)))
            moved = np.flatnonzero(before)
            cursor[moved] = np.minimum(end[moved], self._advance(term[moved], cursor[moved], np.minimum(target[of[moved]], items)))
            left = going[of] & (cursor < end)
            passage, term, cursor, end = passage[left], term[left], cursor[left], end[left]
            item = self.item[cursor]
        return tuple(np.concatenate([x[k] for x in out] or [np.zeros(0, np.int64)]) for k in range(3))

    def hits(self, texts: pa.Array, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> list[tuple[int, int, float, float, float]]:
        """text, item, score, question overlap, answer overlap; the best passage of each text and item."""
        if not self.ids:
            return []
        bounds, own, codes = words(texts)
        place = pc.fill_null(pc.index_in(own, self.vocabulary), -1).to_numpy(zero_copy_only=False)
        codes = place[codes].astype(np.int64) if len(codes) else np.zeros(0, np.int64)
        step = self.longest
        count = np.maximum(1, -(-np.diff(bounds) // step) - 1)
        text = np.repeat(np.arange(len(count)), count)
        begin = bounds[text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(count) - count, count))
        end = np.minimum(begin + 2 * step, bounds[text + 1])
        known = np.flatnonzero(codes >= 0)
        first, last = np.searchsorted(known, begin), np.searchsorted(known, end)
        # the sum of a passage's largest weights, repeats counted each, is a bound too, and two look-ups in prefix sums
        sums = np.concatenate([[0], np.cumsum(self.top[codes[known]])])
        some = np.flatnonzero(sums[last] - sums[first] >= threshold - 1e-6)
        n = last[some] - first[some]
        of = np.repeat(np.arange(len(some)), n)
        at = known[np.repeat(first[some] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
        pairs = np.unique(of * len(self.vocabulary) + codes[at])
        passage, item, score = self.retrieve(pairs // len(self.vocabulary), pairs % len(self.vocabulary), threshold)
        best: dict[tuple[int, int], tuple] = {}
        for p, k, s in zip(some[passage].tolist(), item.tolist(), score.tolist(), strict=True):
            q, a = (_overlap(x, codes[begin[p] : end[p]]) for x in self.shingles[k])
            if min(q, a) >= overlap - 1e-9:
                key = (int(text[p]), k)
                best[key] = max(best.get(key, ()), (s, q, a))
        return [(*key, *found) for key, found in sorted(best.items())]


def _shingles(codes: np.ndarray) -> tuple[int, set]:
    n = min(WORDS, len(codes))
    c = codes.tolist()
    return n, {tuple(c[k : k + n]) for k in range(len(c) - n + 1)} if n else set()


def _overlap(part: tuple[int, set], passage: np.ndarray) -> float:
    n, own = part
    if not own:
        return 1.0
    c = passage.tolist()
    return len(own & {tuple(c[k : k + n]) for k in range(len(c) - n + 1)}) / len(own)


def build(items: DataFrame):
    """Yields an ``Index`` for each block of the items (item_id, text)."""
    text = items.where(F.length(F.trim("text")) > 0).select("item_id", "text")
    size, n = text.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count(F.lit(1))).first()
    if not n:
        return

    def terms(batches):
        for batch in batches:
            bounds, own, codes = words(batch.column("text"))
            for k in range(len(batch)):
                c = codes[bounds[k] : bounds[k + 1]]
                yield pa.RecordBatch.from_pydict({"term": own.take(pa.array(np.unique(c))).cast(pa.string()), "length": [len(c)] + [0] * (len(np.unique(c)) - 1) if len(c) else []})

    each = text.mapInArrow(terms, "term string, length long")
    mean = max(1.0, (each.agg(F.sum("length")).first()[0] or 0) / n)
    df = each.groupBy("term").count()
    blocks = -(-size // INDEX_BYTES)
    cut = text.withColumn("_block", F.pmod(F.xxhash64("text", "item_id"), F.lit(blocks)))
    for k in range(blocks):
        own = cut.where(F.col("_block") == k).drop("_block")
        rows = [(r["item_id"], *split_item(r["text"])) for r in own.orderBy("item_id", "text").collect()]
        counts = df.join(own.mapInArrow(terms, "term string, length long").select("term").distinct(), "term", "left_semi").collect()
        yield Index(rows, {r["term"]: float(np.log(1 + (n - r["count"] + 0.5) / (r["count"] + 0.5))) for r in counts}, mean)


def _chunks(texts: pa.Array):
    texts = texts.fill_null("")
    size = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        upto = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + CHUNK_BYTES, side="right")))
        yield at, texts.slice(at, upto - at)
        at = upto


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """doc_id, item_id, score, question_overlap, answer_overlap of every contamination."""
    spark = docs.sparkSession
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("item_id", items.schema["item_id"].dataType), *(T.StructField(x, T.DoubleType()) for x in ("score", "question_overlap", "answer_overlap"))])
    out, kind = spark.createDataFrame([], schema), to_arrow_type(items.schema["item_id"].dataType)
    for index in build(items):
        shared = spark.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            own = shared.value
            for batch in batches:
                for at, texts in _chunks(batch.column("text")):
                    hits = own.hits(texts, threshold, overlap)
                    doc = batch.column("doc_id").take(pa.array([at + h[0] for h in hits], pa.int64()))
                    yield pa.RecordBatch.from_arrays([doc, pa.array([own.ids[h[1]] for h in hits], kind), *(pa.array([h[k] for h in hits], pa.float64()) for k in (2, 3, 4))], names=schema.names)

        out = out.unionAll(docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, schema))
    return out


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP) -> DataFrame:
    """The rows of ``docs``, all columns kept, that hold no item."""
    at_text, out = docs.columns.index("text"), docs
    for index in build(items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches, shared=shared):
            own = shared.value
            for batch in batches:
                bad = {at + h[0] for at, texts in _chunks(batch.column(at_text)) for h in own.hits(texts, threshold, overlap)}
                yield batch.filter(pa.array([k not in bad for k in range(len(batch))], pa.bool_()))

        out = out.mapInArrow(run, docs.schema)
    return out
