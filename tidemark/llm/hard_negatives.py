"""Hard negatives for anchors: rows of another label that score nearly as high as a row of the same one.

Rows are sorted by label and by the coordinate that varies most, and runs of them become trees, packed
by sort-tile-recursion over the coordinates that vary next: each level sorts its rows by one
coordinate and cuts them into equal slabs, the last slabs are leaves. A box's bounds give, coordinate
by coordinate, the interval of the inner products that its rows can have with an anchor. A search
takes the boxes with the highest bounds first; boxes outside all score windows, or strictly below the
k-th score found so far, are left out.

Anchors meet trees in blocks. The roots' boxes decide first which blocks and trees meet at all; an
anchor's own tree gives the first bound on its k-th positive."""

from __future__ import annotations

from heapq import heappop, heappush

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import block_number, stored

#: Components become whole numbers of 1 / SCALE, rounded down.
SCALE = 256
#: Rows of a tree, of a leaf, and children of an inner node.
TREE_ROWS, LEAF_ROWS, FANOUT = 4096, 64, 8
#: Trees that one task packs, anchors of a block, and trees whose roots lie on one shelf of the directory.
TREES_A_TASK, BLOCK_ANCHORS, SHELF_TREES = 32, 1024, 256


def str_order(x: np.ndarray, axes: list[int], leaf: int) -> np.ndarray:
    """The order of rows that packs them, leaf by leaf, by sort-tile-recursion over the axes."""
    def tiled(rows: np.ndarray, axes: list[int]) -> list[np.ndarray]:
        leaves = -(-len(rows) // leaf)
        if not axes or leaves <= 1:
            return [rows]
        rows = rows[np.argsort(x[rows, axes[0]], kind="stable")]
        slabs = int(np.ceil(leaves ** (1 / len(axes))))
        size = leaf * -(-leaves // slabs)  # whole leaves
        return [part for at in range(0, len(rows), size) for part in tiled(rows[at:at + size], axes[1:])]

    return np.concatenate(tiled(np.arange(len(x)), axes)) if len(x) else np.zeros(0, np.int64)


class Tree:
    """Packed rows and the boxes over them: level 0 has the leaves, the last level the root."""

    def __init__(self, x: np.ndarray, ids: np.ndarray, rows: np.ndarray):
        top = int(np.abs(x).max()) if x.size else 0
        # sums of products are whole numbers that doubles hold, or else are made of long integers
        self.kind = np.float64 if top * top * x.shape[1] < 1 << 53 else np.int64
        self.x, self.ids, self.rows = x.astype(self.kind), ids, rows
        starts = np.arange(0, len(x), LEAF_ROWS)
        self.levels = [(np.minimum.reduceat(self.x, starts), np.maximum.reduceat(self.x, starts))]
        while len(self.levels[-1][0]) > 1:
            low, high = self.levels[-1]
            starts = np.arange(0, len(low), FANOUT)
            self.levels.append((np.minimum.reduceat(low, starts), np.maximum.reduceat(high, starts)))

    def search(self, q: np.ndarray, own_id: int, k: int, lows: np.ndarray, highs: np.ndarray) -> list[np.ndarray]:
        """For each score window (both ends inclusive) the places of its first k rows, those of own_id
        left out: higher scores first, then smaller ids."""
        q = q.astype(self.kind)
        floors, top = lows.copy(), highs.max()
        least = floors.min()
        score, place = np.zeros(0, np.int64), np.zeros(0, np.int64)
        queue = self.needed(len(self.levels) - 1, slice(0, 1), q, floors, highs)
        batch = 1
        while queue:
            leaves = []
            while queue and len(leaves) < batch:
                bound, level, i = heappop(queue)
                if -bound < least:
                    queue = []
                elif level == 0:
                    leaves.append(i)
                else:
                    for entry in self.needed(level - 1, slice(i * FANOUT, (i + 1) * FANOUT), q, floors, highs):
                        heappush(queue, entry)
            if not leaves:
                continue
            at = np.concatenate([np.arange(i * LEAF_ROWS, min((i + 1) * LEAF_ROWS, len(self.x))) for i in leaves])
            found = (self.x[at] @ q).astype(np.int64)
            good = (found >= least) & (found <= top) & (self.ids[at] != own_id)
            batch *= 2
            if good.any():
                score, place = np.concatenate([score, found[good]]), np.concatenate([place, at[good]])
                for j, (low, high) in enumerate(zip(lows, highs)):
                    mine = score[(score >= low) & (score <= high)]
                    if len(mine) >= k:
                        floors[j] = max(floors[j], np.partition(mine, len(mine) - k)[len(mine) - k])
                least = floors.min()
                keep = score >= least
                score, place = score[keep], place[keep]
        best = np.lexsort((self.rows[place], self.ids[place], -score))
        score, place = score[best], place[best]
        return [place[(score >= low) & (score <= high)][:k] for low, high in zip(lows, highs)]

    def needed(self, level: int, boxes: slice, q: np.ndarray, floors: np.ndarray, highs: np.ndarray) -> list[tuple]:
        """Those of the boxes that a window reaches, as entries of the queue."""
        low, high = self.levels[level]
        lower, upper = intervals(low[boxes], high[boxes], q)
        inside = np.flatnonzero(reached(lower[:, None], upper[:, None], floors, highs))
        return sorted((-upper[i].item(), level, boxes.start + int(i)) for i in inside)


def intervals(low: np.ndarray, high: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Between what sums the inner products of q with the rows of a box lie, for many boxes or many q."""
    a, b = low * q, high * q
    return np.minimum(a, b).sum(1), np.maximum(a, b).sum(1)


def reached(lower: np.ndarray, upper: np.ndarray, floors: np.ndarray, highs: np.ndarray) -> np.ndarray:
    """Which intervals meet one of their windows, along the last axis."""
    return ((lower <= highs) & (upper >= floors)).any(-1)


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(3).compress(b"".join(a.tobytes() for a in arrays))


def _unpacked(data: bytes, n: int, d: int):
    """Vectors, ids, row numbers, and a number more for each row."""
    raw = zstandard.ZstdDecompressor().decompress(data)
    x = np.frombuffer(raw, np.int32, n * d).reshape(n, d)
    return x, *(np.frombuffer(raw, np.int64, n, 4 * n * d + 8 * n * i) for i in range(3))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int32).reshape(-1, d)


TREES = "tree long, label long, n int, anchors int, low array<int>, high array<int>, data binary"


def _trees(d: int, axes: list[int]):
    """Trees of the rows as they come: in order of label and first coordinate, of one label each."""
    def tree(number: int, label: int, parts: list) -> pa.RecordBatch:
        x, ids, rows, asks = (np.concatenate(p) for p in zip(*parts))
        order = str_order(x, axes, LEAF_ROWS)
        x, ids, rows, asks = x[order], ids[order], rows[order], asks[order]
        return pa.RecordBatch.from_pylist([{
            "tree": number, "label": label, "n": len(x), "anchors": int(asks.sum()), "low": x.min(0).tolist(), "high": x.max(0).tolist(),
            "data": pack(x, ids, rows, asks)}], schema=TREE_SCHEMA)

    def build(batches):
        numbers, held, size, now = block_number(), [], 0, None
        for batch in batches:
            x, labels = _matrix(batch.column("vector"), d), batch.column("label").to_numpy()
            columns = x, *(batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("vec_id", "row", "asks"))
            at = 0
            while at < len(x):
                change = np.flatnonzero(labels[at:] != labels[at])
                end = min(at + TREE_ROWS - (size if labels[at] == now else 0), at + int(change[0]) if len(change) else len(x))
                if held and (labels[at] != now or end == at):
                    yield tree(next(numbers), now, held)
                    held, size = [], 0
                    now = labels[at]
                    continue
                now = labels[at]
                held.append(tuple(c[at:end] for c in columns))
                size += end - at
                at = end
        if held:
            yield tree(next(numbers), now, held)

    return build


TREE_SCHEMA = pa.schema([
    ("tree", pa.int64()), ("label", pa.int64()), ("n", pa.int32()), ("anchors", pa.int32()),
    ("low", pa.list_(pa.int32())), ("high", pa.list_(pa.int32())), ("data", pa.binary())])
BLOCKS = "block long, label long, n int, data binary"
LOWEST, HIGHEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def _anchors(d: int, k: int):
    """Blocks of the anchors of one label, each with a bound on its k-th positive from its own tree."""
    def block(number: int, label: int, parts: list) -> pa.RecordBatch:
        x, ids, rows, floors = (np.concatenate(p) for p in zip(*parts))
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([label], pa.int64()), pa.array([len(x)], pa.int32()), pa.array([pack(x, ids, rows, floors)])], ["block", "label", "n", "data"])

    def make(batches):
        numbers, held, now = block_number(), [], None
        for batch in batches:
            for row in batch.select(["label", "n", "data"]).to_pylist():
                x, ids, rows, asks = _unpacked(row["data"], row["n"], d)
                tree, open_end = Tree(x, ids, rows), np.array([HIGHEST])
                for at in np.flatnonzero(asks):
                    first = tree.search(x[at], ids[at], k, np.array([LOWEST]), open_end)[0]
                    floor = int(tree.x[first[-1]] @ tree.x[at]) if len(first) == k else LOWEST
                    if held and (row["label"] != now or len(held) == BLOCK_ANCHORS):
                        yield block(next(numbers), now, held)
                        held = []
                    now = row["label"]
                    held.append((x[at:at + 1], ids[at:at + 1], rows[at:at + 1], np.array([floor])))
        if held:
            yield block(next(numbers), now, held)

    return make


def _windows(row: dict, floors: np.ndarray, percent: tuple[int, int]) -> list[tuple]:
    """For each anchor of a block that looks for something: its place, the ends of its score windows,
    and what each belongs to (number, id and score of a positive). Without positives an anchor has
    one window, from its bound up."""
    if "positives" not in row:
        return [(i, floors[i:i + 1], np.array([HIGHEST]), [(0, None, None)]) for i in range(len(floors))]
    out = []
    for p in row["positives"]:
        # whole numbers of any size: a hundred times a score may pass 64 bits
        ends = [(-(-percent[0] * s["score"] // 100), percent[1] * s["score"] // 100, (i, s["vec_id"], s["score"])) for i, s in enumerate(p["first"])]
        ends = [e for e in ends if e[0] <= e[1]]
        if ends:
            lows, highs, of = zip(*ends)
            out.append((p["place"], np.array(lows, np.int64), np.array(highs, np.int64), of))
    return out


def _met(d: int, percent: tuple[int, int]):
    """The pairs of a block and a tree where the tree's box reaches a window of an anchor."""
    def meet(batches):
        for batch in batches:
            pairs, block = [], None
            for row in batch.to_pylist():
                if row["block"] != block:  # the trees of a block come one after the other
                    block = row["block"]
                    x, _, _, floors = _unpacked(row["anchors"], row["n"], d)
                    windows = _windows(row, floors, percent)
                    of = np.repeat([w[0] for w in windows], [len(w[1]) for w in windows]) if windows else np.zeros(0, np.int64)
                    lows, highs = (np.concatenate([np.zeros(0, np.int64), *(w[i] for w in windows)]) for i in (1, 2))
                lower, upper = intervals(np.array(row["low"], np.int64), np.array(row["high"], np.int64), x.astype(np.int64))
                if reached(lower[of], upper[of], lows, highs):
                    pairs.append((block, row["tree"]))
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*pairs) if pairs else ([], []))], ["block", "tree"])

    return meet


FOUND = "block long, place int, nth int, anchor_id long, positive_id long, positive_score long, vec_id long, row long, score long"
FOUND_SCHEMA = pa.schema([(n, pa.int32() if kind == "int" else pa.int64()) for n, kind in map(str.split, FOUND.split(", "))])


def _search(d: int, k: int, percent: tuple[int, int]):
    """The first k rows of a tree for each window of each anchor of a block."""
    def find(batches):
        for batch in batches:
            for r in range(batch.num_rows):
                row = batch.slice(r, 1).to_pylist()[0]
                tree = Tree(*_unpacked(row["data"], row["rows"], d)[:3])
                x, ids, _, floors = _unpacked(row["anchors"], row["n"], d)
                out = []
                for i, lows, highs, of in _windows(row, floors, percent):
                    for positive, places in zip(of, tree.search(x[i], ids[i], k, lows, highs)):
                        scores = (tree.x[places] @ x[i].astype(tree.kind)).astype(np.int64)
                        for at, score in zip(places, scores):
                            out.append((row["block"], i, positive[0], ids[i], *positive[1:], tree.ids[at], tree.rows[at], score))
                columns = zip(*out) if out else [[]] * len(FOUND_SCHEMA)
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FOUND_SCHEMA)], schema=FOUND_SCHEMA)

    return find


def _spreads(d: int):
    """Rows, sums and sums of squares of a task's vectors."""
    def add(batches):
        n, sums, squares = 0, np.zeros(d), np.zeros(d)
        for batch in batches:
            x = _matrix(batch.column("vector"), d).astype(np.float64)
            n, sums, squares = n + len(x), sums + x.sum(0), squares + (x * x).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([float(n)]), pa.array([sums]), pa.array([squares])], ["n", "sums", "squares"])

    return add


def _axes(rows: DataFrame, d: int) -> list[int]:
    """The coordinates, those that vary most first."""
    parts = rows.select("vector").mapInArrow(_spreads(d), "n double, sums array<double>, squares array<double>")
    each = parts.select("n", F.posexplode(F.arrays_zip("sums", "squares")).alias("axis", "s"))
    total = each.groupBy("axis").agg(F.sum("n").alias("n"), F.sum("s.sums").alias("s"), F.sum("s.squares").alias("q"))
    spread = F.col("q") / F.col("n") - (F.col("s") / F.col("n")) * (F.col("s") / F.col("n"))
    return [r.axis for r in total.select("axis", spread.alias("v")).orderBy(F.desc("v"), "axis").collect()]  # a row a coordinate


def hard_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 5, percent: tuple[int, int] = (80, 100)) -> DataFrame:
    """anchor_id, positive_id, rank (from 1), negative_id, positive_score and negative_score, of
    vectors(vec_id, embedding, label): the first `negatives` rows of another label whose score lies
    within `percent` of a positive's score, for each of the first `positives` rows of the anchor's label.

    Components are counted in 1 / SCALE, rounded down; a score is the inner product; higher ones come
    first, ties by the smaller vec_id. A positive of a negative score has no negatives, one of score
    zero those of score zero. Anchors are the rows where `is_anchor` holds; each row is an anchor of its
    own, also a repeated one, and never meets rows of its own vec_id; other repeated rows count as often
    as they are there. Rows with a null vec_id, label or vector, without components or with a null or
    non-finite one, or with another number of them than most rows have take no part, nor do those
    with a component beyond 2**31 / sqrt(components) after counting: their scores could not be told
    in 64 bits. A table without anchors or without other labels gives an empty result; other columns
    are ignored. All rows are searched; the boxes only leave out what cannot be among the first."""
    spark = vectors.sparkSession
    names = "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    finite = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    rows = vectors.select(
        F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"),
        F.col("embedding").cast("array<double>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    rows = rows.filter(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & finite)
    lengths = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").head()
    if lengths is None:
        return spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    d, n = lengths
    largest = float(int(2**31 / d**0.5) - 1)
    rows = rows.filter((F.size("v") == d) & F.forall("v", lambda c: F.abs(SCALE * c) < largest))
    counted = F.transform("v", lambda c: F.floor(SCALE * c).cast("int")).alias("vector")
    rows = stored(rows.select("vec_id", "label", counted, "asks", F.monotonically_increasing_id().alias("row")), "vector-rows")
    axes = _axes(rows, d)
    parts = max(1, -(-n // (TREES_A_TASK * TREE_ROWS)), min(-(-n // TREE_ROWS), int(spark.conf.get("spark.sql.shuffle.partitions"))))
    order = ["label", F.get("vector", F.lit(axes[0] if axes else 0)), "row"]
    packed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    trees = stored(packed.mapInArrow(_trees(d, axes[1:4]), TREES), "packed-trees")
    blocks = stored(trees.filter("anchors > 0").select("label", "n", "data").mapInArrow(_anchors(d, positives), BLOCKS), "anchor-blocks").withColumnRenamed("data", "anchors")
    shelves = max(1, -(-trees.count() // SHELF_TREES))
    directory = trees.select("tree", F.col("label").alias("of"), "low", "high", F.pmod(F.xxhash64("tree"), F.lit(shelves)).cast("int").alias("shelf"))

    def searched(asking: DataFrame, k: int, label: Column) -> DataFrame:
        """Blocks go to every shelf of the directory; a pair that meets there fetches its tree."""
        near = asking.withColumn("shelf", F.explode(F.sequence(F.lit(0), F.lit(shelves - 1)))).join(directory, "shelf").filter(label)
        pairs = near.drop("shelf", "label", "of").mapInArrow(_met(d, percent), "block long, tree long")
        data = trees.select("tree", F.col("n").alias("rows"), "data")
        return pairs.join(asking.drop("label"), "block").join(data, "tree").mapInArrow(_search(d, k, percent), FOUND)

    def first(found: DataFrame, k: int, *keys: str) -> DataFrame:
        best = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id", "row")
        return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)

    best = first(searched(blocks, positives, F.col("label") == F.col("of")), positives, "block", "place")
    each = best.groupBy("block", "place").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("first"))
    asking = blocks.join(each.groupBy("block").agg(F.collect_list(F.struct("place", "first")).alias("positives")), "block")
    found = searched(stored(asking, "positive-scores"), negatives, F.col("label") != F.col("of"))
    told = first(found, negatives, "block", "place", "nth")
    return told.withColumnsRenamed({"vec_id": "negative_id", "score": "negative_score"}).select(*names)
