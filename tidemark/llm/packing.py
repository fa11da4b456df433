"""Documents packed into training sequences by first-fit decreasing.

Documents are dealt to groups at random (by a hash), and each group is packed alone: its pieces, the
longest first, go into the first sequence with room. A tournament tree over the sequences' free
room finds that sequence in as many steps as the tree has levels."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import slices, text_bytes, texts_of, tokenizer_path
from tidemark.llm.encoding import encoder

MODEL = "byte_bpe_50k.json"
LENGTH, END = 2048, 1
#: Text bytes of a group; padding hardly falls with larger ones.
GROUP_BYTES = 16 << 20

PLACES = "doc_id long, start long, length long, doc_tokens long, ids_crc32 long"
IDS = ", width int, ids binary"


class FreeRoom:
    """A tournament tree of capacities: each inner node has the larger of its two children's."""

    def __init__(self, bins: int, capacity: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.most = [capacity] * (2 * self.leaves)

    def first(self, need: int) -> int:
        """Takes `need` from the first bin that has it, and says which."""
        most, at = self.most, 1
        if most[1] < need:
            raise ValueError("no bin has room")
        while at < self.leaves:
            at *= 2
            at += most[at] < need
        found = at - self.leaves
        most[at] -= need
        while at > 1:
            at //= 2
            left, right = most[2 * at], most[2 * at + 1]
            most[at] = left if left > right else right
        return found


def first_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """For lengths in falling order, none above the capacity: each one's bin, and its offset there."""
    full = 0
    while full < len(lengths) and lengths[full] == capacity:
        full += 1
    room = FreeRoom(len(lengths) - full, capacity)
    bins, offsets = list(range(full)), [0] * full
    for n in lengths[full:]:
        b = room.first(n)
        bins.append(full + b)
        offsets.append(capacity - room.most[room.leaves + b] - n)
    return bins, offsets


def _cutter(path: str, end: int, length: int, with_ids: bool):
    names = NAMES if with_ids else NAMES[:5]

    def cut(batches):
        encode = encoder(path, "spaced")
        width = encode.dtype.itemsize
        last = np.array([end], encode.dtype).tobytes()
        for ids, texts in slices(batches):
            rows: dict[str, list] = {k: [] for k in names}
            for doc, data in zip(ids, encode(texts)):
                data += last
                for at in range(0, len(data), length * width):
                    piece = data[at:at + length * width]
                    whole = np.frombuffer(piece, encode.dtype).astype("<u4").tobytes()
                    # without ids, the last two stay behind
                    for k, v in zip(rows, (doc, at // width, len(piece) // width, len(data) // width, zlib.crc32(whole), width, piece)):
                        rows[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), KINDS)], list(rows))

    return cut


NAMES = "doc_id", "start", "length", "doc_tokens", "ids_crc32", "width", "ids"
KINDS = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]


def _packer(length: int):
    def pack(table: pa.Table) -> pa.Table:
        group = table.column("_group")[0].as_py()
        table = table.drop_columns("_group").sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        bins, offsets = first_fit_decreasing(table.column("length").to_pylist(), length)
        ids = np.array(bins, np.int64) + (group << 32)
        return table.append_column("sequence_id", pa.array(ids)).append_column("offset", pa.array(offsets, pa.int64()))

    return pack


def pack(docs: DataFrame, model_path: str | None = None, length: int = LENGTH, end: int = END, with_ids: bool = True) -> DataFrame:
    """The pieces of all docs(doc_id, text) with their ids (unsigned numbers of `width` bytes,
    little-endian) and their place: sequence_id, and offset within it. with_ids: without it the
    ids stay where they were made, and the columns `width` and `ids` are left out.

    A document is its ids and one end id; one longer than a sequence is cut at each `length` ids, and
    each part is a piece. A null or empty text has the end id alone. Rows of one doc_id stay apart,
    and so do repeated rows; a null doc_id is kept. An empty table gives an empty one; other columns
    are ignored. A group is bounded by the text it was dealt."""
    path = model_path or tokenizer_path(MODEL)
    rows, size = text_bytes(docs)
    groups = max(1, -(-(size + 16 * rows) // GROUP_BYTES))
    columns = PLACES + IDS * with_ids
    pieces = texts_of(docs).mapInArrow(_cutter(path, end, length, with_ids), columns)
    dealt = pieces.withColumn("_group", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(groups)))
    return dealt.groupBy("_group").applyInArrow(_packer(length), f"{columns}, sequence_id long, offset long")
