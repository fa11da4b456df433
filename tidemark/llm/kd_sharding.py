"""Documents dealt to shards of equal bytes by a k-d tree over their metadata, in DataFrame functions only.

A node that holds more than the target is split at the weighted median of the dimension in which it
is widest. Medians are found by sums over bins, for all nodes of a level in one job a pass: a pass
narrows each node's search to one bin, until what the bin holds no longer matters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, stored

#: Bins of a pass, passes of a split at most, and the share of its node that a split may be off.
BINS, PASSES, NEAR = 1024, 8, 2e-4
#: Copies of one text stay together up to this share of a shard; a larger group is split by a hash.
GROUP_SHARE = 1 / 20
#: Rows of a shard that are numbered in one task.
PART_ROWS = 100_000
#: Width of a coordinate: each dimension is an integer from 0 to SCALE, the hash of a group below it.
SCALE = 1 << 30


def _dimensions() -> dict[str, Column]:
    """Each dimension as a share of 0 to 1: where the source and the language stand (by a hash, for they have no
    order), the logarithm of the size, and where the doc_id stands between the least and the largest."""
    def named(c: str) -> Column:
        return F.coalesce(F.crc32(F.col(c).cast("string").cast("binary")), F.lit(0)) / float(1 << 32)

    return {
        "source": named("source"), "lang": named("lang"),
        "size": F.log2(F.col("size").cast("double")) / 64,
        "doc_id": F.coalesce((F.col("doc_id") - F.col("_least")) / F.greatest(F.col("_most") - F.col("_least") + 1.0, F.lit(1.0)), F.lit(0.0)),
    }


def _points(docs: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """The rows without texts, and the points to be dealt: groups of equal texts, or parts of them."""
    text = F.col("text").cast("string").cast("binary")
    columns = [c if c in docs.columns else F.lit(None).cast("string").alias(c) for c in ("source", "lang")]
    light = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), *columns, (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.coalesce(F.crc32(text), F.lit(0)).cast("long").alias("text_crc32"), F.xxhash64(text).alias("_text"), F.xxhash64("doc_id", text).alias("_row"))
    light = stored(light, "kd-rows")
    total = light.agg(F.sum("size"), F.min("doc_id"), F.max("doc_id")).head()
    most = max(1, int((total[0] or 0) * GROUP_SHARE / shards))
    sums = light.groupBy("_text", "text_crc32").agg(F.sum("size").alias("_bytes"))
    # a group above the limit is dealt to parts by the row's hash
    large = sums.filter(F.col("_bytes") > most).select("_text", "text_crc32", F.ceil(F.col("_bytes") / most * 2).alias("_parts"))
    # such groups hold more than a fixed share of all bytes, so there are at most shards / GROUP_SHARE
    rows = light.join(F.broadcast(large), ["_text", "text_crc32"], "left").withColumn("_part", F.coalesce(F.pmod(F.col("_row"), F.col("_parts")), F.lit(0))).drop("_parts")
    # dealt anew by part: else the join's dealing would do for the sums, and keep a hot text together
    rows = rows.repartition("_text", "text_crc32", "_part")
    first = F.min_by(F.struct("source", "lang", "size", "doc_id"), F.struct(F.coalesce("doc_id", F.lit(0)), "_row"))
    points = rows.groupBy("_text", "text_crc32", "_part").agg(F.sum("size").alias("weight"), first.alias("_first"))
    points = points.select("_text", "text_crc32", "_part", "weight", "_first.*").withColumn("_least", F.lit(total[1]).cast("double")).withColumn("_most", F.lit(total[2]).cast("double"))
    tie = F.pmod(F.xxhash64("_text", "text_crc32", "_part"), F.lit(SCALE))
    keys = [(F.floor(share * (SCALE - 1)).cast("long") * SCALE + tie).alias(f"_k{i}") for i, share in enumerate(_dimensions().values())]
    return rows, stored(points.select("_text", "text_crc32", "_part", "weight", *keys), "kd-points")


def _medians(points: DataFrame, nodes: dict[int, int], of: int) -> dict[int, tuple[int, int]]:
    """For nodes (number to shards it is to become): the dimension and the first key of the right half.

    nodes and bins are as few as shards; what the driver sees is their sums, not points."""
    spread = points.groupBy("_node").agg(F.sum("weight").alias("w"), *[f(f"_k{i}").alias(f"{f.__name__}{i}") for i in range(of) for f in (F.min, F.max)])
    search = {}
    for r in spread.filter(F.col("_node").isin(list(nodes))).collect():
        widths = [r[f"max{i}"] // SCALE - r[f"min{i}"] // SCALE for i in range(of)]
        d = max(range(of), key=lambda i: (widths[i], -i))
        k = nodes[r._node]
        # low and high bound the key of the split; below: the weight before low
        search[r._node] = {"d": d, "low": r[f"min{d}"], "high": r[f"max{d}"] + 1, "below": 0, "want": r.w * (k // 2) / k, "w": r.w, "at": None}
    for _ in range(PASSES):
        open_ = {n: s for n, s in search.items() if s["at"] is None}
        if not open_:
            break
        steps = {n: max(1, -(-(s["high"] - s["low"]) // BINS)) for n, s in open_.items()}
        bins, inside = F.lit(None).cast("long"), F.lit(False)
        for n, s in open_.items():
            key = F.col(f"_k{s['d']}")
            mine = (F.col("_node") == n) & (key >= s["low"]) & (key < s["high"])
            bins = F.when(mine, F.floor((key - s["low"]) / F.lit(steps[n]).cast("decimal(38,0)")).cast("long")).otherwise(bins)
            inside = inside | mine
        sums: dict[int, dict[int, int]] = {n: {} for n in open_}
        for r in points.filter(inside).groupBy("_node", bins.alias("b")).agg(F.sum("weight").alias("w")).collect():
            sums[r._node][r.b] = r.w
        for n, s in open_.items():
            below = s["below"]
            for b in sorted(sums[n]):
                w = sums[n][b]
                if below + w >= s["want"]:
                    edge = s["low"] + b * steps[n]
                    before, after = s["want"] - below, below + w - s["want"]
                    if min(before, after) <= NEAR * s["w"] or steps[n] == 1:
                        s["at"] = edge if before <= after else edge + steps[n]
                    else:
                        s.update(low=edge, high=min(s["high"], edge + steps[n]), below=below)
                    break
                below += w
            else:
                s["at"] = s["high"]
    return {n: (s["d"], s["at"] if s["at"] is not None else s["low"]) for n, s in search.items()}


def kd_shards(docs: DataFrame, shards: int) -> DataFrame:
    """doc_id, size (bytes of the text and one), text_crc32, law, shard, slot (a gapless number in the
    shard from 0) and grown_shard (null: a further shard would move bytes anew) of each row of
    docs(doc_id, text, source, lang).

    The target is all bytes by `shards`; a node that is to become k shards is split into k // 2 and the
    rest. A null text has no bytes; a null doc_id, source or lang stands before all others; a missing
    source or lang column counts as null; rows of an empty text are rows like any other; repeated rows
    stay, and copies of a text stay together unless they are more than a small part of a shard. An
    empty table gives an empty one; other columns are ignored. Rows travel without their texts."""
    if shards < 1:
        raise ValueError("shards must be 1 or more")
    rows, points = _points(docs, shards)
    of = len(_dimensions())
    # number of a node: its first shard; nodes: what each is to become
    node, nodes = F.col("_node"), {0: shards}
    points = points.withColumn("_node", F.lit(0))
    while any(k > 1 for k in nodes.values()):
        medians = _medians(points, {n: k for n, k in nodes.items() if k > 1}, of)
        grown, into = {}, node
        for n, k in nodes.items():
            if k == 1:
                grown[n] = 1
                continue
            grown[n], grown[n + k // 2] = k // 2, k - k // 2
            if n in medians:
                d, at = medians[n]
                into = F.when((node == n) & (F.col(f"_k{d}") >= F.lit(at).cast("long")), n + k // 2).otherwise(into)
        points, nodes = stored(points.withColumn("_node", into), "kd-nodes"), grown
    placed = points.select("_text", "text_crc32", "_part", node.cast("int").alias("shard"))
    dealt = rows.join(placed, ["_text", "text_crc32", "_part"])
    parts = max(1, -(-rows.count() // (PART_ROWS * shards)))
    dealt = dealt.withColumn("_share", F.pmod(F.xxhash64("_row", F.lit(7)), F.lit(parts)))
    slots = numbered(dealt, ["shard"], ["doc_id", "_row", "text_crc32"], "_share", "slot")
    return slots.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
