"""Token ids in binary shards: one zstandard frame a document, one dictionary for all.

A shard is: magic, SHA-256 of the dictionary, the frames one after another, an index (doc_id with validity,
number of ids, offset of each frame), and a footer that says where the index starts. A short document is read
by its index entry alone: one seek, one frame. Frames hold little-endian unsigned 32-bit ids. Shards are named
by their place in ascending doc_id order. The dictionary is trained on whole documents: those of the smallest
hashed doc_id, ``TRAIN_DOCS`` of them at most, up to ``TRAIN_BYTES`` together; it changes sizes, never ids. Where these are too few or too
short to train on, there is no dictionary: shards name the hash of nothing, frames are compressed alone, and no dictionary file is written.

Null text: empty (the end id alone). Null doc_id: first in order, null when read back. Repeated rows and tied
doc_ids: all are written, ordered by their ids' checksum. Empty table: no shard, no rows. Extra columns are ignored. Texts of any length are
one frame each; a frame over ``SHARD_BYTES`` is a shard of its own.
"""

from __future__ import annotations

import hashlib
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrule.llm import tokens
from ferrule.llm.shared import materialise, prefix_sum, shared_dir

END_ID, MAGIC = 1, b"FERRTOK1"
TRAIN_DOCS, TRAIN_BYTES, DICT_BYTES = 512, 8_000_000, 65_536
#: Documents of a range of doc_ids, about, and bytes after which its next shard begins.
RANGE_DOCS, SHARD_BYTES = 8192, 8_000_000
_FOOTER = "<QQ8s"
_FOOTER_BYTES = struct.calcsize(_FOOTER)


def train_dictionary(docs: DataFrame, vocab: str = tokens.VOCAB, end_id: int = END_ID) -> bytes:
    """The dictionary's bytes; empty if there is too little to train on."""
    import zstandard

    chosen = docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS)
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("_th"))
    sizes = hashed.select("doc_id", "_th", F.octet_length("text").alias("_n")).join(F.broadcast(chosen), "doc_id").where(F.col("_n") < TRAIN_BYTES).distinct()
    keys, total = [], 0
    for r in sizes.orderBy(F.xxhash64("doc_id"), "doc_id", "_th").limit(TRAIN_DOCS).collect():  # sizes alone, before any text moves
        total += r["_n"]
        if total > TRAIN_BYTES:
            break
        keys.append((r["doc_id"], r["_th"]))
    texts: list[str] = []
    if keys:
        wanted = docs.sparkSession.createDataFrame(keys, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _th long")
        own = hashed.join(F.broadcast(wanted), ["doc_id", "_th"]).groupBy("doc_id", "_th").agg(F.min("text").alias("text"))
        found = {(r["doc_id"], r["_th"]): r["text"] for r in own.collect()}
        texts = [found[k] for k in keys]
    samples = []
    for n, offsets, ids in tokens.encoder(vocab).texts(pa.array(texts, pa.string()), end_id):
        samples += [ids[offsets[k] : offsets[k + 1]].astype("<u4").tobytes() for k in range(n)]
    try:
        return zstandard.train_dictionary(DICT_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b""


def _compressor(dictionary: bytes):
    import zstandard

    if not dictionary:
        return zstandard.ZstdCompressor(level=3)
    d = zstandard.ZstdCompressionDict(dictionary)
    d.precompute_compress(level=3)
    return zstandard.ZstdCompressor(level=3, dict_data=d)


def _decompressor(dictionary: bytes):
    import zstandard

    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()


#: The hash that a shard without a dictionary names.
NO_DICTIONARY = hashlib.sha256(b"").hexdigest()
#: Schemes that Hadoop and pyarrow call differently.
_SCHEMES = {"s3a": "s3", "s3n": "s3"}


def _qualified(spark: SparkSession, path: str) -> str:
    """``path`` with the scheme that Spark takes for it, so that executors open the same store that Spark reads."""
    own = spark._jvm.org.apache.hadoop.fs.Path(path)
    scheme, rest = own.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(own).toString().split(":", 1)
    return f"{_SCHEMES.get(scheme, scheme)}:{rest if rest.startswith('//') else '//' + rest}"


def _filesystem(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if ":" in uri else (fs.LocalFileSystem(), uri)


def _bounds(docs: DataFrame, ranges: int) -> np.ndarray:
    """First doc_ids of at most ``ranges`` ranges that hold about as many rows each; one number a range comes to the driver."""
    if ranges < 2:
        return np.zeros(0, np.int64)
    dealt = docs.select("doc_id").where("doc_id is not null").repartitionByRange(ranges, "doc_id")
    first = dealt.groupBy(F.spark_partition_id().alias("_p")).agg(F.min("doc_id").alias("_first")).collect()
    return np.unique(np.array([r["_first"] for r in first], np.int64))[1:]


def write(docs: DataFrame, path: str, vocab: str = tokens.VOCAB, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` below ``path``; returns the manifest: range, part, name, n_docs, n_tokens."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    path = _qualified(spark, path)
    dictionary = train_dictionary(docs, vocab, end_id)
    digest = hashlib.sha256(dictionary).digest()
    store, root = _filesystem(path)
    store.create_dir(root, recursive=True)
    if dictionary:
        with store.open_output_stream(f"{root}/{digest.hex()}.zdict") as f:
            f.write(dictionary)
    bounds = _bounds(docs, docs.count() // RANGE_DOCS)
    shared = spark.sparkContext.broadcast(dictionary)
    schema = T.StructType([T.StructField("range", T.IntegerType()), T.StructField("doc_id", kind), T.StructField("n_tokens", T.LongType()), T.StructField("crc", T.LongType()), T.StructField("frame", T.BinaryType())])

    def encode(batches):
        enc, zstd = tokens.encoder(vocab), _compressor(shared.value)
        for batch in batches:
            at = 0
            for n, offsets, ids in enc.texts(batch.column("text"), end_id):
                doc = batch.column("doc_id").slice(at, n)
                place = np.where(doc.is_null(), 0, np.searchsorted(bounds, doc.fill_null(0).to_numpy(), side="right"))
                raw = memoryview(ids.astype("<u4", copy=False)).cast("B")
                parts = [raw[4 * a : 4 * b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(place, pa.int32()), doc, pa.array(np.diff(offsets)), pa.array(map(zlib.crc32, parts), pa.int64()), pa.array(map(zstd.compress, parts), pa.binary())], names=schema.names)
                at += n

    def shards(batches):
        store, root = _filesystem(path)
        place = TaskContext.get().partitionId()
        part, held, frames, size = 0, [], [], 0

        def close():
            name = f"{place:08d}-{part:06d}.shard"
            ids = pa.concat_arrays([x.column("doc_id") for x in held])
            counts = np.concatenate([x.column("n_tokens").to_numpy() for x in held])
            lengths = np.fromiter(map(len, frames), np.uint64, len(frames))
            offsets = np.concatenate([[0], np.cumsum(lengths)]).astype("<u8") + len(MAGIC) + 32
            own = f"{root}/.{name}.{os.getpid()}.{TaskContext.get().taskAttemptId()}"
            with store.open_output_stream(own) as f:
                f.write(MAGIC + digest)
                f.write(b"".join(frames))
                f.write(np.asarray(ids.is_valid()).astype("u1").tobytes() + ids.fill_null(0).cast(pa.int64()).to_numpy().astype("<i8").tobytes() + counts.astype("<u8").tobytes() + offsets.tobytes())
                f.write(struct.pack(_FOOTER, len(frames), int(offsets[-1]), MAGIC))
            if store.get_file_info(f"{root}/{name}").type.name == "NotFound":
                store.move(own, f"{root}/{name}")  # as a whole
            else:  # the same bytes, from another attempt
                store.delete_file(own)
            return pa.RecordBatch.from_pydict({"place": pa.array([place], pa.int32()), "part": pa.array([part], pa.int32()), "name": [name], "n_docs": [len(frames)], "n_tokens": [int(counts.sum())]})

        for batch in batches:
            at = 0
            sizes = np.fromiter(map(len, raw := batch.column("frame").to_pylist()), np.int64)
            while at < len(raw):
                upto = max(at + 1, at + int(np.searchsorted(size + np.cumsum(sizes[at:]), SHARD_BYTES, side="right"))) if not frames or size < SHARD_BYTES else at
                held.append(batch.select(["doc_id", "n_tokens"]).slice(at, upto - at))
                frames += raw[at:upto]
                size += int(sizes[at:upto].sum())
                at = upto
                if size >= SHARD_BYTES or at < len(raw):
                    yield close()
                    part, held, frames, size = part + 1, [], [], 0
        if frames:
            yield close()

    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(encode, schema)
    dealt = rows.repartitionById(len(bounds) + 1, "range").sortWithinPartitions("doc_id", "crc", "n_tokens").select("doc_id", "n_tokens", "frame")
    return materialise(dealt.mapInArrow(shards, "place int, part int, name string, n_docs long, n_tokens long"))


def read(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document in the shards; any file system that Spark reads will do."""
    dictionaries = {r["path"].rsplit("/", 1)[-1].split(".")[0]: bytes(r["content"]) for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.zdict").load(path).collect()}
    shared = spark.sparkContext.broadcast(dictionaries | {NO_DICTIONARY: b""})
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.shard").load(path).select(F.element_at(F.split("path", "/"), -1).alias("name"), "content")

    def decode(batches):
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content"), strict=True):
                whole = memoryview(content.as_buffer())
                doc, counts, frames, digest = _index(whole)
                zstd = _decompressor(shared.value[digest])
                crc = [zlib.crc32(zstd.decompress(whole[a:b])) for a, b in zip(frames[:-1].tolist(), frames[1:].tolist(), strict=True)]
                start = np.cumsum(counts) - counts
                yield pa.RecordBatch.from_pydict({"name": [name] * len(doc), "doc_id": doc, "local": start, "n_tokens": counts, "ids_crc32": pa.array(crc, pa.int64())})

    rows = files.mapInArrow(decode, "name string, doc_id long, local long, n_tokens long, ids_crc32 long")
    # shards in order of place and part: places and parts are small dense numbers
    width = manifest.agg(F.coalesce(F.max("part"), F.lit(0)) + 1).first()[0]
    bases = prefix_sum(manifest.select("name", (F.col("place").cast("long") * width + F.col("part")).alias("at"), F.col("n_tokens").alias("v")), "at", "v", "base")
    return rows.join(bases.select("name", "base"), "name").select("doc_id", (F.col("base") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")


def _index(whole: memoryview) -> tuple[pa.Array, np.ndarray, np.ndarray, str]:
    """doc_ids, numbers of ids, the frames' bounds and the dictionary's digest of a shard."""
    n, at, magic = struct.unpack(_FOOTER, whole[-_FOOTER_BYTES :])
    if magic != MAGIC or bytes(whole[: len(MAGIC)]) != MAGIC:
        raise ValueError("not a shard of token ids")
    valid = np.frombuffer(whole, "u1", n, at).astype(bool)
    doc, counts = np.frombuffer(whole, "<i8", n, at + n), np.frombuffer(whole, "<u8", n, at + 9 * n)
    return pa.array(doc, mask=~valid), counts.astype(np.int64), np.frombuffer(whole, "<u8", n + 1, at + 17 * n).astype(np.int64), bytes(whole[len(MAGIC) : len(MAGIC) + 32]).hex()


def lookup(path: str, name: str, doc_id: int) -> list[np.ndarray]:
    """Ids of one document of a shard, reading its index and its frame only."""
    store, root = _filesystem(path)
    with store.open_input_file(f"{root}/{name}") as f:
        size = f.size()
        n, at, _ = struct.unpack(_FOOTER, f.read_at(_FOOTER_BYTES, size - _FOOTER_BYTES))
        head = f.read_at(len(MAGIC) + 32, 0)
        tail = f.read_at(size - at, at)
        valid, doc = np.frombuffer(tail, "u1", n).astype(bool), np.frombuffer(tail, "<i8", n, n)
        frames = np.frombuffer(tail, "<u8", n + 1, 17 * n).astype(np.int64)
        dictionary = b""
        if (digest := head[len(MAGIC) :].hex()) != NO_DICTIONARY:
            with store.open_input_stream(f"{root}/{digest}.zdict") as g:
                dictionary = g.read()
        zstd = _decompressor(dictionary)
        return [np.frombuffer(zstd.decompress(f.read_at(int(frames[k + 1] - frames[k]), int(frames[k]))), "<u4") for k in np.flatnonzero(valid & (doc == doc_id))]


def round_trip(docs: DataFrame, vocab: str = tokens.VOCAB, end_id: int = END_ID) -> DataFrame:
    """Writes ``docs`` to a folder of its own below the shared one, and reads the files back."""
    path = shared_dir(docs.sparkSession)
    return read(docs.sparkSession, path, write(docs, path, vocab, end_id))
