"""What several of the operators share: written intermediate tables, blocks of documents,
questions that blocks put to hash buckets, and numbering without one task for all rows."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.session import workspace

#: Text bytes that a Python worker holds as words at a time.
SLICE_BYTES = 4 << 20


def stored(df: DataFrame, purpose: str) -> DataFrame:
    """df as a table in the shared folder: computed once, and safe when executors go."""
    path = workspace(df.sparkSession, purpose)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def texts_of(docs: DataFrame, *more: str) -> DataFrame:
    """doc_id, text as bytes (null: none) and the columns named; others, whatever their name, are left."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text"), *more)


def text_bytes(docs: DataFrame) -> tuple[int, int]:
    """Rows, and bytes of their texts."""
    row = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).head()
    return row[0], row[1] or 0


def hashed_sample(df: DataFrame, rows: int, *columns: str) -> list:
    """So many rows with the smallest hashes of the columns (more only where hashes are equal), on the
    driver: first the hashes alone are compared, then only the chosen rows travel."""
    keyed = df.withColumn("_h", F.xxhash64(*columns))
    last = keyed.select("_h").orderBy("_h").limit(rows).agg(F.max("_h")).head()[0]
    return [] if last is None else keyed.filter(F.col("_h") <= last).drop("_h").dropDuplicates().limit(rows).collect()


def slices(batches: Iterable[pa.RecordBatch], limit: int = SLICE_BYTES) -> Iterator[tuple[list, list[bytes]]]:
    """The doc_ids and texts of the batches in runs of about `limit` bytes; a longer text is a run of its own."""
    ids: list = []
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        column = batch.column("text")
        for i, doc in enumerate(batch.column("doc_id").to_pylist()):
            text = column[i].as_py() or b""
            if texts and size + len(text) > limit:
                yield ids, texts
                ids, texts, size = [], [], 0
            ids.append(doc)
            texts.append(text)
            size += len(text) + 64
    if texts:
        yield ids, texts


def squeezed(values: np.ndarray) -> bytes:
    """Ascending unsigned 64-bit numbers as differences, their first bytes together, their second bytes together, ..."""
    steps = np.diff(values, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(6).compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def unsqueezed(data: bytes) -> np.ndarray:
    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    return np.cumsum(np.ascontiguousarray(flat.reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def block_number() -> Iterator[int]:
    """Numbers for the blocks of this task; they hold once the blocks are written."""
    from pyspark import TaskContext

    start = TaskContext.get().partitionId() << 32
    while True:
        yield start
        start += 1


def asked(blocks: DataFrame, answer: Callable[[pa.Table], pa.Table], span: int = 0) -> DataFrame:
    """Sends each block's asks (array of bucket, data) to their buckets, where `answer` sees the asks
    of a bucket together, and joins the answers, in order of the bucket, to the block again. A key of
    many documents travels once a block. span: the blocks of so many tasks of the writer meet at most."""
    asks = blocks.select("block", F.explode("asks").alias("a")).select("block", "a.bucket", "a.data")
    keys = ["bucket", F.floor(F.shiftright("block", 32) / F.lit(span)).alias("_span")] if span else ["bucket"]
    answers = asks.groupBy(*keys).applyInArrow(answer, "block long, bucket int, data binary")
    back = answers.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("bucket", "data"))).alias("answers"))
    return blocks.drop("asks").join(back, "block", "left")


def numbered(df: DataFrame, keys: list[str], order: list[str], spread: str, into: str) -> DataFrame:
    """A gapless number from 0 within each `keys`. `spread` is an integer column that deals the rows
    of a key to parts: parts are numbered apart, and shifted by the rows of the parts before them.
    Equal rows get neighbouring numbers, either way round the same table."""
    before = Window.partitionBy(*keys).orderBy(spread).rowsBetween(Window.unboundedPreceding, -1)
    firsts = (
        df.groupBy(*keys, spread).agg(F.count(F.lit(1)).alias("_n"))
        .select(*keys, spread, F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    )
    inside = Window.partitionBy(*keys, spread).orderBy(*order)
    placed = df.withColumn("_at", F.row_number().over(inside).cast("long") - 1)
    return placed.join(firsts, [*keys, spread]).withColumn(into, F.col("_first") + F.col("_at")).drop("_first", "_at")
