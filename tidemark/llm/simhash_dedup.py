"""Near duplicates by SimHash fingerprints that differ in few bits.

Fingerprints are embedded by the number of set bits in each two-bit segment. Bits that differ move
the counts by one at most, so the Manhattan distance of two embeddings is never above the number
of differing bits. Of two fingerprints that differ in d bits, one 32-bit half differs in d // 2 at
most, and so the halves' embeddings lie that near. Each half goes to the cells of the integer grid
within half that distance: two that are near enough share a cell on the way from one to the other.
What meets in a cell is then verified bit by bit."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored, texts_of
from tidemark.llm.components import components

# Fixed values of the contract.
SHINGLE, SEED, MOST_BITS = 4, 42, 4
#: Cells with more fingerprints are searched by breadth first instead of pair by pair.
FEW = 16
#: Shingles whose bits are added up at a time.
BITS_AT_ONCE = 1 << 15


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The 64 bits that more than half of the shingles' hashes set."""
    import xxhash

    words = text.lower().split()
    if not words:
        return 0
    joined = memoryview(b" ".join(words))
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], ends[:-1]])
    n = max(1, len(words) - shingle + 1)
    digest = xxhash.xxh64_intdigest
    lasts = (ends[min(shingle, len(words)) - 1:] - 1).tolist()
    hashes = np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), lasts)), np.uint64, n)
    counts = np.zeros(64, np.int64)
    for i in range(0, n, BITS_AT_ONCE):
        part = hashes[i:i + BITS_AT_ONCE].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE, *keep: str) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and the columns to keep of each row."""
    @F.pandas_udf("long")
    def made(texts: pd.Series) -> pd.Series:
        return pd.Series(np.array([fingerprint(t or b"", shingle) for t in texts], np.uint64).view(np.int64))

    return texts_of(docs, *keep).select("doc_id", made("text").alias("fp"), *keep)


def embedded(half: np.ndarray) -> np.ndarray:
    """For 32-bit numbers: the set bits of each two-bit segment, in the segment's two bits."""
    even = np.uint64(0x55555555)
    return (half & even) + (half >> np.uint64(1) & even)


def cells_near(half: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Which number, and the grid cells within Manhattan distance `reach` of its embedding."""
    points = embedded(half)
    who, cells = [np.arange(len(points))], [points]
    segments = range(16)
    # moves of `reach` units at most: how far each segment goes
    moves = [m for steps in range(1, reach + 1) for m in _moves(segments, steps)]
    for move in moves:
        ok, cell = np.ones(len(points), bool), points
        for segment, by in move:
            shift = np.uint64(2 * segment)
            value = (points >> shift & np.uint64(3)).astype(np.int64) + by
            ok &= (value >= 0) & (value <= 2)
            cell = cell + (np.uint64(abs(by)) << shift) if by > 0 else cell - (np.uint64(abs(by)) << shift)
        who.append(np.flatnonzero(ok))
        cells.append(cell[ok])
    return np.concatenate(who), np.concatenate(cells)


def _moves(segments, steps: int):
    """All ways to go `steps` units along the segments, each by one or two either way."""
    for k in range(1, steps + 1):
        for some in combinations(segments, k):
            for sizes in _sizes(k, steps):
                for signs in range(1 << k):
                    yield [(s, -n if signs >> i & 1 else n) for i, (s, n) in enumerate(zip(some, sizes))]


def _sizes(parts: int, total: int):
    if parts == 1:
        if total in (1, 2):
            yield (total,)
        return
    for first in (1, 2):
        for rest in _sizes(parts - 1, total - first):
            yield (first, *rest)


def _celled(most_bits: int):
    # a half is within most_bits // 2; two points that far apart meet at a cell half way
    reach = (most_bits // 2 + 1) // 2

    def make(batches):
        for batch in batches:
            fps = batch.column("fp").to_numpy(zero_copy_only=False)
            for at in range(0, len(fps), 20_000):
                some = fps[at:at + 20_000]
                bits = some.view(np.uint64)
                for side in (0, 1):
                    who, cells = cells_near(bits >> np.uint64(32 * side) & np.uint64(0xFFFFFFFF), reach)
                    yield pa.RecordBatch.from_arrays([pa.array((cells | np.uint64(side << 32)).view(np.int64)), pa.array(some[who])], ["cell", "fp"])

    return make


def spanning_links(fps: np.ndarray, most_bits: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Links that connect what is connected within one cell: each fingerprint that has been reached
    takes along all it is linked to, so a dense group costs about one comparison a member."""
    left, out = fps, []
    while len(left):
        queue, left = [left[:1]], left[1:]
        while queue and len(left):
            some = queue.pop()
            for at in some:
                near = np.bitwise_count(left ^ at) <= most_bits
                if near.any():
                    new = left[near]
                    out.append((np.full(len(new), at), new))
                    queue.append(new)
                    left = left[~near]
                    if not len(left):
                        break
    return out


def _linked(most_bits: int):
    def links_of(cells: np.ndarray, fps: np.ndarray):
        """Of whole cells, in order."""
        first = np.flatnonzero(np.concatenate([[True], cells[1:] != cells[:-1]]))
        sizes = np.diff(np.concatenate([first, [len(cells)]]))
        a, b = [], []
        small = np.repeat(sizes <= FEW, sizes)
        for lag in range(1, min(FEW, int(sizes.max()))):
            near = small[lag:] & (cells[lag:] == cells[:-lag]) & (np.bitwise_count(fps[lag:] ^ fps[:-lag]) <= most_bits)
            a.append(fps[:-lag][near])
            b.append(fps[lag:][near])
        for at, n in zip(first[sizes > FEW].tolist(), sizes[sizes > FEW].tolist()):
            for x, y in spanning_links(fps[at:at + n], most_bits):
                a.append(x)
                b.append(y)
        if not a:
            return None
        found = np.unique(np.stack([np.concatenate(a), np.concatenate(b)], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(found[:, i].view(np.int64).copy()) for i in (0, 1)], ["a", "b"]) if len(found) else None

    def make(batches):
        cells, fps = np.zeros(0, np.int64), np.zeros(0, np.uint64)
        for batch in batches:
            cells = np.concatenate([cells, batch.column("cell").to_numpy(zero_copy_only=False)])
            fps = np.concatenate([fps, batch.column("fp").to_numpy(zero_copy_only=False).view(np.uint64)])
            if not len(cells):
                continue
            whole = int(np.searchsorted(cells, cells[-1]))  # the last cell may go on
            if whole:
                found = links_of(cells[:whole], np.ascontiguousarray(fps[:whole]))
                if found is not None:
                    yield found
                cells, fps = cells[whole:], fps[whole:]
        if len(cells):
            found = links_of(cells, fps)
            if found is not None:
                yield found

    return make


def fingerprint_links(distinct: DataFrame, most_bits: int = MOST_BITS) -> DataFrame:
    """Links a, b that connect all of distinct(fp) that are `most_bits` or fewer bits apart, directly
    or by way of others; each one is a true pair."""
    celled = distinct.select("fp").mapInArrow(_celled(most_bits), "cell long, fp long")
    met = celled.repartition("cell").sortWithinPartitions("cell", "fp")
    return met.mapInArrow(_linked(most_bits), "a long, b long").distinct()


def simhash_groups(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS, *keep: str) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id reached by links, itself included), root (a
    name of the component that is never null) and the columns to keep, of each row of docs(doc_id, text).

    A text of fewer words than a shingle is one shingle; a null, empty or blank one has the
    fingerprint zero and is linked like any other. Rows with a null doc_id take part; a component of
    such rows alone has a null id. Repeated rows stay; an empty table gives an empty one; other
    columns are ignored. Equal fingerprints are one node, so a group of copies of any size is."""
    all_fps = stored(fingerprints(docs, shingle, *keep), "simhash")
    nodes = stored(all_fps.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    found = components(fingerprint_links(nodes, most_bits))
    rooted = nodes.join(found.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    names = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = stored(rooted.select("fp", "root").join(names, "root").select("fp", "component_id", "root"), "simhash-named")
    return all_fps.join(named, "fp").select("doc_id", "fp", "component_id", "root", *keep)


def one_of_each_group(docs: DataFrame, shingle: int = SHINGLE, most_bits: int = MOST_BITS) -> DataFrame:
    """One row of each group, all columns as they are: that of the smallest doc_id (null ids last),
    and of several rows of this id that whose hash is smaller."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    keyed = docs.withColumn(row, F.xxhash64("doc_id", F.col("text").cast("string")))
    groups = simhash_groups(keyed, shingle, most_bits, row)
    first = groups.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)).alias("m"))
    return keyed.join(first.select(F.col(f"m.{row}").alias(row)), row, "left_semi").dropDuplicates([row]).drop(row)
