"""Language identification by prediction by partial matching over bytes.

One variable-order context tree a language holds the byte counts after each context of up to three bytes that
training met at least ``MIN_CONTEXT`` times. A byte costs -log2 of its probability in the longest context that is in
the tree; where that context never saw the byte, an escape (method C: as likely as the context's number of
distinct bytes) hands it to the next shorter context, down to a uniform choice among 256. Statistics are frozen after
training, so a text's cost is a sum of table entries (in double precision) and the whole text is scored with array look-ups.
Training takes whole texts of up to ``TRAIN_DOCS`` documents of each language, those of the smallest hashed
doc_id (one text of each, should a doc_id repeat), and leaves out every document whose crc32(doc_id as text) mod 5 is 0. The table of costs goes to every executor; if it would pass
``TABLE_BYTES`` (many languages), contexts must have been met more often to be in the tree, until it doesn't.

A letter is a character of Unicode's category L. Null text and text without a letter: ``und``, score 0. No labelled document at all: ``und``
throughout. Null lang takes no part in training. Null doc_id: scored, not held out, not learned from. Repeated rows are scored each; equal
costs go to the language that sorts first. Empty table: no rows. Extra columns are ignored, and kept by ``accept``. Very long texts are scored whole, in blocks.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ferrule.llm.shared import materialise

ORDER, MIN_CONTEXT = 3, 8
#: Documents of a language that are learned from, and bytes of them together.
TRAIN_DOCS, TRAIN_BYTES = 400, 2_000_000
UNKNOWN = "und"
#: Of the table of costs, eight for each context, symbol and language.
TABLE_BYTES = 256_000_000
#: Bits of a byte from which on a text is in no learned language: a plain byte's eight, and as much again as half of it for escapes. Short texts that are keys by
#: half cost 9 in their own language, those in scripts that training never met 16 and more.
FOREIGN_BITS = 12.0
#: Leading bits of hashed doc_ids by which ranges are counted, one after another: 256 ranges at a time of a language with many documents.
HASH_BITS = (8, 16, 24)


def _has_letter(text: str = "text"):
    return F.coalesce(F.col(text).cast("string").rlike(r"\p{L}"), F.lit(False))


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """``state[context index]`` is a row of ``cost``; a context index is three symbols in base ``symbols``."""

    langs: list[str]
    symbol: np.ndarray  # of each byte; 0: none of the bytes met in training
    symbols: int
    state: np.ndarray
    cost: np.ndarray  # [state, symbol, language], bits

    def bits(self, data: np.ndarray, bounds: np.ndarray, block: int = 4_000_000) -> np.ndarray:
        """Code length of each text in each language. ``data``: bytes of texts that end at ``bounds[1:]``, each after three zero bytes."""
        n, total = self.symbols, np.zeros((len(bounds) - 1, len(self.langs)))
        for k in range(len(bounds) - 1):
            for a in range(int(bounds[k]), int(bounds[k + 1]) - ORDER, block):
                s = self.symbol[data[a : min(a + block, int(bounds[k + 1]) - ORDER) + ORDER]]
                context = (s[:-3] * n + s[1:-2]) * n + s[2:-1]
                total[k] += self.cost[self.state[context], s[3:]].sum(axis=0, dtype=np.float64)
        return total


def train(texts: dict[str, list[bytes]], table_bytes: int = TABLE_BYTES) -> Model:
    langs = sorted(texts)
    joined = {x: np.frombuffer(b"".join(b"\0\0\0" + t for t in texts[x]), np.uint8) for x in langs}
    met = np.unique(np.concatenate([np.zeros(1, np.uint8), *joined.values()]))
    symbol = np.zeros(256, np.int32)
    symbol[met] = np.arange(1, len(met) + 1)
    n = len(met) + 1
    # a symbol of no byte stands for those that training never met
    orders = []
    for x in langs:
        s = symbol[joined[x]].astype(np.int64)
        seen = [np.bincount(s, minlength=n).astype(np.float64).reshape(1, n)]
        for k in range(1, ORDER + 1):
            key = np.zeros(len(s) - k, np.int64)
            for d in range(k + 1):
                key = key * n + s[d : len(s) - k + d]
            seen.append(np.unique(key, return_counts=True))
        orders.append(seen)
    # contexts in any language's tree, by order; the state of a longer one that isn't there is that of its end
    met_in = [[np.unique(seen[k][0] // n, return_inverse=True) for k in range(1, ORDER + 1)] for seen in orders]
    often = [[np.bincount(at, weights=seen[k][1], minlength=len(own)) for k, (own, at) in enumerate(of, 1)] for seen, of in zip(orders, met_in, strict=True)]
    least = MIN_CONTEXT
    while True:
        contexts = [np.zeros(1, np.int64)]
        for k in range(ORDER):
            contexts.append(np.unique(np.concatenate([of[k][0][times[k] >= least] for of, times in zip(met_in, often, strict=True)])))
        if sum(map(len, contexts)) * n * len(langs) * 8 <= table_bytes or least > TRAIN_BYTES:
            break
        least *= 2
    first = np.cumsum([0, *map(len, contexts)])
    cost = np.zeros((first[-1], n, len(langs)))
    suffix = np.zeros(1, np.int64)  # of each context of the order before, for every way to lengthen it
    for k in range(ORDER + 1):
        for j, seen in enumerate(orders):
            if k == 0:
                counts, shorter = seen[0], np.full((1, n), 1 / 256)
            else:
                keys, times = seen[k]
                at = np.searchsorted(contexts[k], keys // n)
                at_ok = np.minimum(at, len(contexts[k]) - 1)
                ok = contexts[k][at_ok] == keys // n if len(contexts[k]) else np.zeros(len(keys), bool)
                counts = np.zeros((len(contexts[k]), n))
                counts[at_ok[ok], keys[ok] % n] = times[ok]
                shorter = 2.0 ** -cost[suffix[contexts[k] % n ** (k - 1)], :, j]
            total, kinds = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
            p = np.where(counts > 0, counts / np.maximum(total + kinds, 1), np.where(total > 0, kinds / np.maximum(total + kinds, 1), 1.0) * shorter)
            cost[first[k] : first[k + 1], :, j] = -np.log2(p)
        longer = np.tile(suffix, n) if k else np.zeros(1, np.int64)
        longer[contexts[k]] = first[k] + np.arange(len(contexts[k]))
        suffix = longer
    return Model(langs, symbol, n, suffix.astype(np.int32), cost)


def learn(docs: DataFrame) -> Model | None:
    """The frozen model; None without a labelled document."""
    h = F.xxhash64("doc_id")
    few = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang")
    # finer and finer ranges of hashes are counted, and those passed over that begin after TRAIN_DOCS of a language: neither
    # a language's ranges nor, in the end, its documents are many where they meet
    for bits in HASH_BITS:
        ranged = few.withColumn("_h", F.shiftright(h, 64 - bits))
        before = F.sum("_n").over(W.partitionBy("lang").orderBy("_h").rowsBetween(W.unboundedPreceding, -1))
        counted = ranged.distinct().groupBy("lang", "_h").agg(F.count(F.lit(1)).alias("_n")).withColumn("_b", F.coalesce(before, F.lit(0)))
        first = materialise(counted.where(F.col("_b") < TRAIN_DOCS).select("lang", "_h"))
        few = ranged.join(F.broadcast(first), ["lang", "_h"], "left_semi").select("doc_id", "lang")
    chosen = few.distinct().withColumn("_r", F.row_number().over(W.partitionBy("lang").orderBy(h, "doc_id"))).where(F.col("_r") <= TRAIN_DOCS).drop("_r")
    own = docs.select("doc_id", "lang", F.struct(F.xxhash64("text"), F.col("text").cast("string").alias("text")).alias("x")).where(F.octet_length("x.text") <= TRAIN_BYTES)
    rows = own.join(F.broadcast(chosen), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("x").alias("x")).select("doc_id", "lang", "x.text")
    size = F.sum(F.octet_length("text")).over(W.partitionBy("lang").orderBy(h, "doc_id").rowsBetween(W.unboundedPreceding, 0))
    texts: dict[str, list[bytes]] = {}
    for r in rows.withColumn("_s", size).where(F.col("_s") <= TRAIN_BYTES).select("lang", "text").toLocalIterator():
        texts.setdefault(r["lang"], []).append(r["text"].encode())
    return train(texts) if texts else None


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with held_out, lang_pred, score and bits_per_byte (of the best language)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    schema = T.StructType([T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("bits_per_byte", T.DoubleType())])

    def score(batches):
        model = shared.value
        for batch in batches:
            texts = batch.column("text").fill_null("").cast(pa.large_string())
            known = batch.column("letter").to_numpy(zero_copy_only=False) & (model is not None)
            lang, sure, rate = np.full(len(batch), UNKNOWN, object), np.zeros(len(batch)), np.zeros(len(batch))
            for k in np.flatnonzero(known).tolist():
                data = np.frombuffer(b"\0\0\0" + texts[k].as_py().encode(), np.uint8)
                bits = model.bits(data, np.array([0, len(data)]))[0]
                best = int(bits.argmin())
                lang[k], sure[k], rate[k] = model.langs[best], 1 / np.exp2(np.maximum(bits[best] - bits, -1000)).sum(), bits[best] / (len(data) - ORDER)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(lang, pa.string()), pa.array(sure), pa.array(rate)], names=schema.names)

    return docs.select("doc_id", held_out().alias("held_out"), _has_letter().alias("letter"), F.col("text").cast("string").alias("text")).mapInArrow(score, schema)


def identify(docs: DataFrame) -> DataFrame:
    return predict(docs, learn(docs))


def accept(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, all columns kept, whose text is in some learned language.

    Rejected are null texts and texts without a letter, texts whose best label is ``und`` itself, and texts that no language explains: their
    best code length is ``FOREIGN_BITS`` a byte or more, well over what the bytes take as they are. The
    verdict needs the text alone, so no join: rows are scored in place and rejected ones dropped. Without a model there is nothing to
    score with, and a letter is enough.
    """
    lettered = docs.where(_has_letter())
    model = learn(docs)
    if model is None:
        return lettered
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def keep(batches):
        model = shared.value
        for batch in batches:
            ok = [False] * len(batch)
            for k, text in enumerate(batch.column(at)):
                data = np.frombuffer(b"\0\0\0" + text.as_py().encode(), np.uint8)
                bits = model.bits(data, np.array([0, len(data)]))[0]
                best = int(bits.argmin())
                ok[k] = model.langs[best] != UNKNOWN and bits[best] < FOREIGN_BITS * (len(data) - ORDER)
            yield batch.filter(pa.array(ok, pa.bool_()))

    return lettered.mapInArrow(keep, docs.schema)
