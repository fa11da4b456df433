"""Token ids in binary blocks, each document compressed alone with a shared dictionary.

A store is two tables below one folder. `dictionary` has one row: the sha256 of a zstandard
dictionary trained on serialised id arrays, and its bytes. `blocks` has a row for each block, in
ascending doc_id order by (shard, block): the documents' frames one after another, where each
begins, and the hash of the dictionary they need. A short document is read by its offset alone."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import hashed_sample, slices, stored, text_bytes, texts_of, tokenizer_path
from tidemark.llm.encoding import encoder
from tidemark.session import workspace

MODEL = "word_bpe_49k.json"
END = 1
#: The dictionary is trained on so many documents, chosen by a hash, of so many text bytes at most.
#: It bounds the size of the files only: any dictionary gives the same ids.
SAMPLE, SAMPLE_TEXT, DICTIONARY_BYTES = 1024, 16 << 10, 64 << 10
#: Bytes of frames in a block, text bytes for each shard.
BLOCK_BYTES, SHARD_BYTES = 8 << 20, 64 << 20

BLOCKS = (
    "shard int, block int, first_id long, last_id long, dictionary string, width int, doc_ids array<long>, "
    "offsets array<long>, n_tokens array<long>, frames binary"
)
BLOCK_SCHEMA = pa.schema([
    ("shard", pa.int32()), ("block", pa.int32()), ("first_id", pa.int64()), ("last_id", pa.int64()), ("dictionary", pa.string()), ("width", pa.int32()),
    ("doc_ids", pa.list_(pa.int64())), ("offsets", pa.list_(pa.int64())), ("n_tokens", pa.list_(pa.int64())), ("frames", pa.binary()),
])


def train_dictionary(docs: DataFrame, path: str) -> bytes:
    """A dictionary from the ids of a bounded sample; empty where the sample has nothing to train on."""
    short = docs.filter(F.octet_length("text").between(1, SAMPLE_TEXT)).select("doc_id", F.col("text").cast("string").cast("binary").alias("text"))
    samples = encoder(path, "words")([bytes(r.text) for r in hashed_sample(short, SAMPLE, "doc_id", "text")])
    samples = [s for s in samples if len(s) >= 8]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:  # too few samples
        return b"".join(samples)[-DICTIONARY_BYTES:]


def _dictionary(data: bytes):
    if not data:
        return None
    trained = data[:4] == b"\x37\xa4\x30\xec"
    return zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_FULLDICT if trained else zstandard.DICT_TYPE_RAWCONTENT)


def _framer(path: str, dictionary: bytes, end: int):
    def frame(batches):
        encode = encoder(path, "words")
        last = np.array([end], encode.dtype).tobytes()
        pack = zstandard.ZstdCompressor(3, dict_data=_dictionary(dictionary), write_dict_id=False).compress
        for ids, texts in slices(batches):
            arrays = [x + last for x in encode(texts)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(x) // encode.dtype.itemsize for x in arrays], pa.int64()), pa.array([zlib.crc32(x) for x in arrays], pa.int64()), pa.array([pack(x) for x in arrays], pa.binary())],
                ["doc_id", "n_tokens", "crc", "frame"])

    return frame


def _blocker(name: str, width: int):
    def blocks(batches):
        from pyspark import TaskContext

        shard, number = TaskContext.get().partitionId(), 0
        ids, counts, offsets, frames, size = [], [], [0], [], 0

        def made():
            return pa.RecordBatch.from_pylist([{
                "shard": shard, "block": number, "first_id": next((i for i in ids if i is not None), None), "last_id": ids[-1], "dictionary": name, "width": width,
                "doc_ids": ids, "offsets": offsets, "n_tokens": counts, "frames": b"".join(frames)}], schema=BLOCK_SCHEMA)

        for batch in batches:
            for row in batch.to_pylist():
                if ids and size + len(row["frame"]) > BLOCK_BYTES:
                    yield made()
                    number += 1
                    ids, counts, offsets, frames, size = [], [], [0], [], 0
                ids.append(row["doc_id"])
                counts.append(row["n_tokens"])
                frames.append(row["frame"])
                size += len(row["frame"])
                offsets.append(size)
        if ids:
            yield made()

    return blocks


def write_store(docs: DataFrame, model_path: str | None = None, end: int = END, folder: str | None = None) -> str:
    """Writes the ids of each text of docs(doc_id, text) and one end id in ascending doc_id order,
    null doc_ids first; returns the folder.

    A null or empty text has the end id alone. Rows of one doc_id, and repeated rows, are all kept,
    next to each other in order of their ids' checksum. Other columns are ignored. Each text is
    encoded once; only frames are dealt to shards by ranges of doc_id."""
    spark, path = docs.sparkSession, model_path or tokenizer_path(MODEL)
    folder = folder or workspace(spark, "token-store")
    dictionary = train_dictionary(docs, path)
    name = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(name, bytearray(dictionary))], "hash string, data binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    _, size = text_bytes(docs)
    framed = stored(texts_of(docs).mapInArrow(_framer(path, dictionary, end), "doc_id long, n_tokens long, crc long, frame binary"), "token-frames")
    ranged = framed.repartitionByRange(max(1, -(-size // SHARD_BYTES)), "doc_id", "crc", "n_tokens").sortWithinPartitions("doc_id", "crc", "n_tokens")
    width = encoder(path, "words").dtype.itemsize
    ranged.select("doc_id", "n_tokens", "frame").mapInArrow(_blocker(name, width), BLOCKS).write.option("compression", "uncompressed").parquet(f"{folder}/blocks")
    return folder


def _opened(row: dict, dictionary: bytes, places=None):
    """doc_id and ids of a block's documents, or of those at `places`."""
    if hashlib.sha256(dictionary).hexdigest() != row["dictionary"]:
        raise ValueError("the block was written with another dictionary")
    unpack = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary)).decompress
    frames, offsets, kind = memoryview(row["frames"]), row["offsets"], np.dtype(f"<u{row['width']}")
    for i in range(len(row["doc_ids"])) if places is None else places:
        yield row["doc_ids"][i], np.frombuffer(unpack(frames[offsets[i]:offsets[i + 1]]), kind).astype("<u4")


def dictionary_of(spark: SparkSession, folder: str) -> bytes:
    return bytes(spark.read.parquet(f"{folder}/dictionary").head().data)


def fetch(spark: SparkSession, folder: str, doc_ids: list[int]) -> DataFrame:
    """doc_id and ids of the documents asked for: only blocks whose range holds one are read, and of
    those only the documents' own frames are decompressed."""
    dictionary, wanted = dictionary_of(spark, folder), set(doc_ids)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                places = [i for i, doc in enumerate(row["doc_ids"]) if doc in wanted]
                for doc, ids in _opened(row, dictionary, places):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([ids.tolist()], pa.list_(pa.int64()))], ["doc_id", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks")
    inside = F.lit(False)
    for d in sorted(wanted):
        inside = inside | (F.col("first_id") <= d) & (F.col("last_id") >= d)
    return blocks.filter(inside).mapInArrow(read, "doc_id long, ids array<long>")


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """From the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32."""
    dictionary = dictionary_of(spark, folder)

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                opened = [(doc, len(ids), zlib.crc32(ids.tobytes())) for doc, ids in _opened(row, dictionary)]
                ids, sizes, crcs = zip(*opened)
                if list(sizes) != row["n_tokens"]:
                    raise ValueError("a frame does not hold as many ids as its index says")
                starts = np.concatenate([[0], np.cumsum(sizes[:-1], dtype=np.int64)]).astype(np.int64)
                yield pa.RecordBatch.from_arrays([
                    pa.array([row["shard"]] * len(ids), pa.int32()), pa.array([row["block"]] * len(ids), pa.int32()),
                    pa.array(ids, pa.int64()), pa.array(starts), pa.array(sizes, pa.int64()), pa.array(crcs, pa.int64())],
                    ["shard", "block", "doc_id", "inside", "n_tokens", "ids_crc32"])

    blocks = spark.read.schema(BLOCKS).parquet(f"{folder}/blocks")
    rows = blocks.mapInArrow(read, "shard int, block int, doc_id long, inside long, n_tokens long, ids_crc32 long")
    sizes = blocks.select("shard", "block", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, n: a + n).alias("n"))
    before = Window.rowsBetween(Window.unboundedPreceding, -1)
    shards = sizes.groupBy("shard").agg(F.sum("n").alias("n")).select("shard", F.coalesce(F.sum("n").over(before.orderBy("shard")), F.lit(0)).alias("shard_start"))
    starts = sizes.select("shard", "block", F.coalesce(F.sum("n").over(before.partitionBy("shard").orderBy("block")), F.lit(0)).alias("block_start")).join(shards, "shard")
    return rows.join(starts, ["shard", "block"]).select("doc_id", (F.col("shard_start") + F.col("block_start") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32")
