"""Shards of near equal size: sampled splitters, exact ranges, overfull ranges subdivided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import materialize
from vigilframe.llm.common import small_side

# Ranges that one round makes of an overfull range, and sampled keys for each of them.
FANOUT = 512
DRAWS = 32
# A range is overfull above this share of a shard, or above these bytes or rows, whichever is least.
RANGES_PER_SHARD = 4
RANGE_BYTES = 1 << 30
RANGE_ROWS = 1_000_000
# Groups of rows with one key up to this share of a shard stay together.
WHOLE = 0.005
_KEY = ("key", "doc_id", "tie")


def place_in(bounds: Column, key: Column, most: int = FANOUT) -> Column:
    """Number of the sorted ``bounds`` that are not above ``key``, by binary search."""
    steps = [1 << k for k in reversed(range(most.bit_length()))]
    step = lambda lo, s: F.when(F.get(bounds, lo + s - 1) <= key, lo + s).otherwise(lo)
    return F.aggregate(F.array(*[F.lit(s) for s in steps]), F.lit(0), step)


def splitters(rows: DataFrame, full: DataFrame) -> DataFrame:
    """(range, bounds): sorted splitters of each overfull range, from (range, pieces, measure) of these ranges.

    A row is drawn with a chance in proportion to its measure, by a hash of its key, so that a range gives some
    ``DRAWS`` keys a piece. A drawn row stands for its measure over its chance; quantiles of these are the bounds.
    """
    some = rows.join(small_side(full), "range")
    chance = F.least(F.lit(1.0), F.col("pieces") * DRAWS * F.col("m") / F.col("measure"))
    luck = F.shiftrightunsigned(F.xxhash64(*_KEY, F.lit(11)), 11) / F.lit(float(1 << 53))
    drawn = some.where(luck < chance).select("range", "pieces", *_KEY, (F.col("m") / chance).alias("stands"))
    order = Window.partitionBy("range").orderBy(*_KEY)
    upto = F.sum("stands").over(order.rowsBetween(Window.unboundedPreceding, 0))
    drawn = drawn.withColumn("upto", upto).withColumn("all", F.sum("stands").over(Window.partitionBy("range")))
    step = F.col("all") / F.col("pieces")
    crosses = F.floor(F.col("upto") / step) > F.floor((F.col("upto") - F.col("stands")) / step)
    return drawn.where(crosses).groupBy("range").agg(F.array_sort(F.collect_list(F.struct(*_KEY))).alias("bounds"))


def ranges(rows: DataFrame, shards: int) -> tuple[DataFrame, DataFrame]:
    """Rows with their ``range``, and (range, weight, rows) in order of the keys.

    The first round splits all rows, later ones only the ranges that are still overfull. A range whose weight is that
    of one row cannot be divided and is left alone.
    """
    total, count = rows.agg(F.coalesce(F.sum("w"), F.lit(0)), F.count("*")).first()
    limit = max(1.0, min(total / (shards * RANGES_PER_SHARD), float(RANGE_BYTES)))
    row_limit = min(RANGE_ROWS, max(1, count // (shards * RANGES_PER_SHARD)))
    # A row of more than a range's weight counts as one range, so that it does not hide its neighbours from the sample.
    rows = rows.withColumn("m", F.least(F.col("w") / limit, F.lit(1.0)) + F.lit(1.0 / row_limit)).withColumn("range", F.lit(0).cast("long"))
    was = None
    for left in reversed(range(62 // FANOUT.bit_length())):  # numbers of ranges are paths and must fit 62 bits
        sizes = rows.groupBy("range").agg(
            F.sum("w").alias("weight"), F.count("*").alias("rows"), F.max("w").alias("largest"), F.sum("m").alias("measure")
        )
        sizes = materialize(sizes, "ranges")
        over = ((F.col("weight") - F.col("largest") > limit) | (F.col("rows") > row_limit)) & (F.col("rows") > 1)
        pieces = F.least(F.ceil(2 * F.col("measure")), F.lit(FANOUT)).cast("int")
        full = materialize(sizes.where(over).select("range", pieces.alias("pieces"), "measure"), "overfull")
        now = (sizes.count(), full.count())
        if not now[1] or now == was or not left:
            return rows, sizes.select("range", "weight", "rows")
        was = now
        bounds = materialize(splitters(rows, full), "splitters")
        bounds = small_side(bounds, 1_000_000 // FANOUT)
        part = F.coalesce(place_in(F.col("bounds"), F.struct(*_KEY)), F.lit(0))
        rows = rows.join(bounds, "range", "left").withColumn("range", F.col("range") * (FANOUT + 1) + part).drop("bounds")
        rows = materialize(rows, "ranged")


def assign(
    docs: DataFrame,
    shards: int = 8,
    law: str = "bytes",
    doc_id: str = "doc_id",
    text: str = "text",
    key: Column | None = None,
    tie: str | None = None,
    whole: float = WHOLE,
) -> DataFrame:
    """Deal documents into ``shards`` ranges of the key: doc_id, size, text_crc32, law, shard, slot, key, tie.

    By ``law`` the shards' sizes are near equal (``bytes``) or their counts at most one apart (``rows``). The key is any
    orderable column and by default a hash of the text, so equal texts lie together.

    1. Size-weighted samples of the keys give splitters; rows fall into ranges by binary search among them, and ranges
       with too many bytes or rows are split again until none is (a key that a third of the rows share is split by
       doc_id, and rows that agree in that too by their place in the input).
    2. Each range is summed by itself, and the sums of the ranges before it are added. So every row knows its exact
       place, and a row belongs to the shard that holds its middle. The sample decides only how the work is split.
    3. Where a shard would end within a group of one key of at most ``whole`` of a shard, it ends at the nearer side of
       the group (``bytes`` only). Sizes are thus within 2 * ``whole`` of a shard and one document of each other.

    Size is the text's UTF-8 bytes plus one. A null text has size 1, the crc32 of an empty one and a key of its own; null
    ids are ids; repeated rows get slots of their own. Fewer rows than shards leave some shards empty; an empty table
    gives no rows. Other columns are not read. ``tie`` names a column that numbers rows, where the caller has one.
    """
    size = (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + 1).cast("long")
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        size.alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("text_crc32"),
        (F.xxhash64(F.col(text)) if key is None else key).alias("key"),
        (F.monotonically_increasing_id() if tie is None else F.col(tie)).alias("tie"),
        (size if law == "bytes" else F.lit(1).cast("long")).alias("w"),
    )
    rows, sizes = ranges(materialize(rows, "sizes"), shards)
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(
        "range",
        F.coalesce(F.sum("weight").over(earlier), F.lit(0)).alias("from"),
        F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("row"),
    )
    inside = Window.partitionBy("range").orderBy(*_KEY).rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.withColumns({"before": F.coalesce(F.sum("w").over(inside), F.lit(0)), "rows_before": F.count("*").over(inside)})
    placed = placed.join(small_side(materialize(starts, "starts")), "range").select(
        *_KEY, "size", "text_crc32", "w", (F.col("before") + F.col("from")).alias("at"), (F.col("rows_before") + F.col("row")).alias("row")
    )
    placed = materialize(placed, "placed")
    total = sizes.agg(F.coalesce(F.sum("weight"), F.lit(0))).first()[0]
    ends = F.array(*[F.lit(k * total // shards) for k in range(1, shards)]).cast("array<bigint>")
    if law == "bytes" and whole > 0:
        ends = F.lit(_snapped(placed, total, shards, whole)).cast("array<bigint>")
    middle = F.col("at") + (F.expr("w div 2") if law == "bytes" else F.lit(0))
    placed = placed.withColumn("shard", place_in(ends, middle, max(shards - 1, 1)))
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))
    return placed.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit(law).alias("law"), "shard", (F.col("row") - F.col("first")).alias("slot"), "key", "tie"
    )


def _snapped(placed: DataFrame, total: int, shards: int, whole: float) -> list[int]:
    """Ends of all shards but the last, moved to the sides of small groups. One row a shard reaches the driver."""
    number = lambda at: F.floor(at.cast("decimal(38,0)") * shards / F.lit(max(total, 1))).cast("int")
    lo, hi = number(F.col("at")), number(F.col("at") + F.col("w"))
    at_end = placed.where(lo < hi).select("key", F.explode(F.sequence(lo + 1, hi)).alias("end"))
    at_end = materialize(at_end.where(F.col("end") < shards), "ends")
    sides = placed.alias("p").join(F.broadcast(at_end.select("key").distinct().alias("k")), F.col("p.key").eqNullSafe(F.col("k.key")))
    sides = sides.groupBy("p.key").agg(F.min("p.at").alias("lo"), F.max(F.col("p.at") + F.col("p.w")).alias("hi"))
    met = at_end.alias("e").join(F.broadcast(sides.alias("s")), F.col("e.key").eqNullSafe(F.col("s.key"))).select("end", "lo", "hi").collect()
    ends = {k: k * total // shards for k in range(1, shards)}
    for end, low, high in met:
        if high - low <= whole * total / shards:
            ends[end] = low if ends[end] - low < high - ends[end] else high
    return [ends[k] for k in range(1, shards)]


def write_shards(docs: DataFrame, folder: str, shards: int = 8, files: int | None = None, **options) -> DataFrame:
    """Write whole rows as Parquet, a folder ``__shard=k`` for each shard, in the order of the slots; returns ``assign``'s rows.

    Rows are numbered and written once, so that a lost task numbers them alike; the shards' first keys then place each row
    by binary search, without a join. Columns of ``docs`` may have any names but those that begin with ``__shard``.
    """
    key = options.pop("key", None)
    key = F.xxhash64(F.col(options.get("text", "text"))) if key is None else key
    staged = docs.withColumns({"__shard_key": key, "__shard_tie": F.monotonically_increasing_id()})
    staged = materialize(staged, "numbered")
    placed = materialize(assign(staged, shards, key=F.col("__shard_key"), tie="__shard_tie", **options), "placed")
    firsts = placed.groupBy("shard").agg(F.min(F.struct(*_KEY)).alias("k"))
    firsts = firsts.agg(F.array_sort(F.collect_list(F.struct("k", "shard"))).alias("__shard_firsts"))
    own = F.struct(F.col("__shard_key").alias("key"), F.col(options.get("doc_id", "doc_id")).alias("doc_id"), F.col("__shard_tie").alias("tie"))
    at = place_in(F.transform("__shard_firsts", lambda f: f["k"]), own, shards)
    rows = staged.crossJoin(F.broadcast(firsts)).withColumn("__shard", F.get("__shard_firsts", at - 1)["shard"]).drop("__shard_firsts")
    order = ["__shard", "__shard_key", options.get("doc_id", "doc_id"), "__shard_tie"]
    dealt = rows.repartitionByRange(files, *order) if files else rows.repartitionByRange(*order)
    dealt.sortWithinPartitions(*order).drop("__shard_key", "__shard_tie").write.partitionBy("__shard").parquet(folder)
    return placed
