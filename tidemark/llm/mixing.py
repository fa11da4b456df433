"""Sources mixed to target weights by entropy balancing, in DataFrame functions only.

Each document gets a rate: how often it is to be taken. Of all rates between 0 and MOST that meet
every source's token target, balancing takes those nearest to 1 in relative entropy. They are
exponentially tilted, exp(tilt * size), and the tilts solve a convex dual problem, one unknown for
each source, by Newton steps whose sums are taken over the sources' histograms of sizes, in parts. Rates are
then rounded into copies, and what one size rounds off is handed on to the next smaller size of its part, what
is left of the parts to the part of the smallest sizes."""

from __future__ import annotations

from collections.abc import Callable
from math import log

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.common import numbered, stored

# Fixed values of the contract: weights of the sources in turn, and how often a document may be taken.
WEIGHTS = (5, 2, 1)
MOST = 3
SPACE = r"[\x20\x09-\x0D]+"

#: Newton steps at most, and the share of its target that a source's tokens may be off.
STEPS, NEAR = 60, 1e-9
#: Distinct sizes of one source that one row holds.
PART_SIZES = 1024
#: Documents of one source and size that are numbered in one task.
PART_ROWS = 20_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.size(F.array_remove(F.split(text, SPACE), "")), F.lit(0)).cast("long")


def source_key(source: Column) -> Column:
    """A text for each source that is never null: the null source sorts behind all others."""
    return F.coalesce(F.concat(F.lit("0"), source.cast("string")), F.lit("1"))


def targets(sources: DataFrame) -> DataFrame:
    """From _source and source_size: target. All targets together are all tokens; a source gets its
    share by weight, or MOST times its size if that is less. Filling up by weight raises one level
    until the tokens are gone, and a source is full when the level passes its size by weight."""
    everything = Window.partitionBy()
    weights = F.array(*map(F.lit, WEIGHTS))
    ranked = sources.withColumn("_w", F.get(weights, (F.row_number().over(Window.orderBy("_source")) - 1) % len(WEIGHTS)).cast("double"))
    full = F.col("source_size") * MOST
    by_level = Window.orderBy(full / F.col("_w"), "_source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    left = (
        ranked.withColumn("_total", F.sum("source_size").over(everything)).withColumn("_weights", F.sum("_w").over(everything))
        .withColumn("_full", F.coalesce(F.sum(full).over(before), F.lit(0)))
        .withColumn("_gone", F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
        # the level if all sources before this one are full, and no other
        .withColumn("_level", (F.col("_total") - F.col("_full")) / (F.col("_weights") - F.col("_gone")))
        # of the levels that do not fill the source they are reckoned for, the first is the highest
        .withColumn("_level", F.max(F.when(F.col("_level") * F.col("_w") <= full, F.col("_level"))).over(everything))
    )
    return left.select("_source", "source_size", F.least(full.cast("double"), F.coalesce(F.col("_level") * F.col("_w"), full.cast("double"))).alias("target"))


def histograms(sizes: DataFrame, wanted: DataFrame) -> DataFrame:
    """The documents with words of each source as (size, n), the largest size first, in even parts of at
    most PART_SIZES sizes: _source, _part (0 holds the largest sizes), _parts and _steps; and of the whole
    source its target, _tokens, _mean and _least size."""
    known = sizes.filter("size > 0")
    whole = known.groupBy("_source").agg(
        F.sum(F.col("n") * F.col("size")).alias("_tokens"), (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("_mean"),
        F.min("size").alias("_least"), F.count(F.lit(1)).alias("_sizes"))
    whole = whole.join(wanted.select("_source", "target"), "_source").withColumn("_parts", F.ceil(F.col("_sizes") / PART_SIZES))
    # ranked by ranges of sizes, so that no task sorts all sizes of a source
    ranked = numbered(known.withColumn("_range", F.floor(-F.col("size") / PART_SIZES)), ["_source"], [F.desc("size")], "_range", "_rank")
    part = F.floor(F.col("_rank") * F.col("_parts") / F.col("_sizes")).alias("_part")
    steps = ranked.join(whole.select("_source", "_sizes", "_parts"), "_source").groupBy("_source", part).agg(
        F.sort_array(F.collect_list(F.struct("size", "n")), asc=False).alias("_steps"))
    return steps.join(whole.drop("_sizes"), "_source")


def _rate(tilt: Column, size: Column, mean: Column) -> Column:
    return F.least(F.lit(float(MOST)), F.exp(tilt * size / mean))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _sums(tilt: Column) -> Column:
    """Of one part: its tokens at a tilt, and how fast they rise with it."""
    mean = F.col("_mean")

    def add(a: Column, s: Column) -> Column:
        return _bound(_rate(tilt, s["size"], mean), lambda rate: F.struct(
            (a.tokens + s.n * s["size"] * rate).alias("tokens"),
            (a.slope + F.when(rate < MOST, s.n * s["size"] * rate * s["size"] / mean).otherwise(0.0)).alias("slope")))

    return F.aggregate("_steps", F.struct(F.lit(0.0).alias("tokens"), F.lit(0.0).alias("slope")), add)


def solve_tilts(parts: DataFrame) -> DataFrame:
    """_source, _mean and tilt of each source of parts (see `histograms`).

    For one source, tokens(tilt) = sum of n * size * min(MOST, exp(tilt * x)), x being size over the
    source's mean size, rise with the tilt: the gradient of its dual. A step is one job for all sources
    that are not there yet: each part sums its sizes, the parts of a source are added up in their order,
    so reruns agree to the last bit, and a Newton step that leaves the bounds known so far is replaced by
    their middle. The state, a row a source, is written after each step."""
    target = F.col("target")
    # here every document is at MOST
    high = F.lit(log(MOST)) * F.col("_mean") / F.col("_least") + 1e-9
    state = stored(
        parts.filter("_part = 0").withColumn("high", high).select(
            "_source", "_mean", "target", F.when(target >= F.col("_tokens") * MOST * (1 - NEAR), F.col("high")).otherwise(0.0).alias("tilt"),
            F.lit(-1e4).alias("low"), "high", F.lit(False).alias("done")).coalesce(1), "mixing-tilts")
    for _ in range(STEPS):
        each = parts.join(state.filter("not done").select("_source", "tilt"), "_source").select("_source", "_part", _sums(F.col("tilt")).alias("s"))
        summed = each.groupBy("_source").agg(F.sort_array(F.collect_list(F.struct("_part", "s.tokens", "s.slope"))).alias("s")).select("_source", *(
            F.aggregate(f"s.{c}", F.lit(0.0), lambda a, x: a + x).alias(c) for c in ("tokens", "slope")))
        over = F.col("tokens") > target
        moved = (
            state.join(summed, "_source", "left").withColumn("done", F.col("done") | (F.abs(F.col("tokens") - target) <= NEAR * target))
            .withColumn("low", F.when(over | F.col("done"), F.col("low")).otherwise(F.col("tilt")))
            .withColumn("high", F.when(over & ~F.col("done"), F.col("tilt")).otherwise(F.col("high")))
            .withColumn("newton", F.col("tilt") + (target - F.col("tokens")) / F.when(F.col("slope") > 0, F.col("slope")))
            .withColumn("tilt", F.when(F.col("done"), F.col("tilt")).when((F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high")), F.col("newton"))
                        .otherwise((F.col("low") + F.col("high")) / 2))
        )
        state = stored(moved.select(*state.columns), "mixing-tilts")
        if state.filter("not done").isEmpty():
            break
    return state.select("_source", "_mean", "tilt")


def copies_by_size(parts: DataFrame, tilts: DataFrame) -> DataFrame:
    """_source, size and copies, the copies of all documents of one source and size together.

    Sizes are rounded from the largest of a part down, and each takes on the tokens that those before
    rounded off. What the other parts are left with, at most half a document of their smallest size
    each, the part of the smallest sizes starts with."""
    tilted = parts.join(tilts.select("_source", "tilt"), "_source")

    def rounded(a: Column, s: Column) -> Column:
        real = s.n * _rate(F.col("tilt"), s["size"], F.col("_mean"))
        copies = F.greatest(F.lit(0), F.least(s.n * MOST, F.round(real + a / s["size"]).cast("long"))).cast("long")
        return _bound(copies, lambda c: F.struct(c.alias("copies"), (a + (real - c) * s["size"]).alias("carry")))

    left = tilted.select("_source", "_part", "_parts", F.aggregate("_steps", F.lit(0.0), lambda a, s: rounded(a, s).carry).alias("_left"))
    # a row a part
    before = Window.partitionBy("_source").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    handed = left.withColumn("_start", F.when(F.col("_part") == F.col("_parts") - 1, F.sum("_left").over(before))).select("_source", "_part", F.coalesce("_start", F.lit(0.0)).alias("_start"))
    start = F.struct(F.col("_start").alias("carry"), F.array().cast("array<struct<size:bigint,copies:bigint>>").alias("made"))

    def step(a: Column, s: Column) -> Column:
        return _bound(rounded(a.carry, s), lambda r: F.struct(
            r.carry.alias("carry"), F.concat(a.made, F.array(F.struct(s["size"].alias("size"), r.copies.alias("copies")))).alias("made")))

    made = tilted.join(handed, ["_source", "_part"]).select("_source", F.explode(F.aggregate("_steps", start, step, lambda a: a.made)).alias("m"))
    return made.select("_source", "m.size", "m.copies")


def _row_keys(docs: DataFrame) -> DataFrame:
    """Two hashes that tell rows apart unless their id, source and text are equal."""
    text = F.col("text").cast("string")
    return docs.withColumn("_h", F.xxhash64("doc_id", "source", text)).withColumn("_c", F.coalesce(F.crc32(text.cast("binary")), F.lit(-1)))


def mix(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies * size) of each row of
    docs(doc_id, text, source).

    A null or empty text has no words and is not taken; the null source is a source of its own, the
    last; a null doc_id and repeated rows stay; an empty table gives an empty one; other columns are
    ignored. The targets follow from all rows. Which documents of one source and size get a copy more
    than others is decided by a hash, so reruns agree. Documents travel once, without texts; a source
    of any share of the rows is split by size, and one size by the hash."""
    light = stored(
        _row_keys(docs).select("doc_id", source_key(F.col("source")).alias("_source"), size_of(F.col("text")).alias("size"), "_h", "_c"), "mixing-rows")
    sizes = stored(light.groupBy("_source", "size").agg(F.count(F.lit(1)).alias("n")), "mixing-sizes")
    wanted = stored(targets(sizes.groupBy("_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))), "mixing-targets")
    parts = stored(histograms(sizes, wanted), "mixing-parts")
    copies = copies_by_size(parts, solve_tilts(parts))
    plan = stored(
        sizes.join(copies, ["_source", "size"], "left").join(wanted, "_source")
        .select("_source", "size", "n", F.coalesce("copies", F.lit(0)).alias("_copies"), "source_size", "target"), "mixing-copies")
    parts = F.ceil(F.col("n") / PART_ROWS)
    rows = light.join(plan, ["_source", "size"]).withColumn("_part", F.pmod(F.xxhash64("_h", "_c"), parts))
    # dealt anew by part: else the join's dealing would do for the numbering, and keep a hot size together
    rows = rows.repartition("_source", "size", "_part")
    some = numbered(rows, ["_source", "size"], ["_h", "_c", "doc_id"], "_part", "_number")
    each = F.floor(F.col("_copies") / F.col("n")) + F.when(F.col("_number") < F.col("_copies") % F.col("n"), 1).otherwise(0)
    return some.withColumn("copies", each.cast("long")).select(
        "doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"), "_h", "_c")


def mixed_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, all columns as they are."""
    counted = mix(docs).groupBy("_h", "_c").agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    joined = _row_keys(docs).join(counted.filter("_copies > 0"), ["_h", "_c"])
    # rows that are equal share the copies of all of them
    place = F.row_number().over(Window.partitionBy("_h", "_c").orderBy("_h"))
    times = F.floor(F.col("_copies") / F.col("_rows")) + F.when(place <= F.col("_copies") % F.col("_rows"), 1).otherwise(0)
    many = joined.withColumn("_times", times).filter("_times > 0")
    return many.withColumn("_time", F.explode(F.sequence(F.lit(1).cast("long"), F.col("_times").cast("long")))).select(*docs.columns)
