"""Mixing sources to target weights along a time-varying curriculum."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import materialize
from vigilframe.llm.common import running_totals, small_side, split_words

WEIGHTS = (5, 2, 1)
RAMPS = (0.5, 0.0, -0.5)
CAP = 3
ROWS_PER_BUCKET = 10_000


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, ramps: tuple[float, ...] = RAMPS, cap: int = CAP) -> DataFrame:
    """(source, source_size, target, ramp) from (source, size) rows.

    Sources in code point order, null last, take the weights in turn. A target stops at ``cap`` times the source; the
    excess goes to the others by weight. The order of cap over weight tells which sources are full: the first one whose
    share of what the fuller ones leave is no larger than its cap ends them.
    """
    sums = materialize(sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size")), "sources")
    ranked = running_totals(sums, [F.col("source")], {"rank": F.lit(1)})
    turn = (F.col("rank") % len(weights)).cast("int") + 1
    ranked = ranked.select(
        "source",
        "source_size",
        F.element_at(F.array(*[F.lit(float(w)) for w in weights]), turn).alias("weight"),
        F.element_at(F.array(*[F.lit(float(r)) for r in ramps]), turn).alias("ramp"),
        (F.col("source_size") * cap).alias("most"),
    )
    order = [F.col("most") / F.col("weight"), F.col("source")]
    filled = running_totals(ranked, order, {"most_before": F.col("most"), "weight_before": F.col("weight")})
    total = filled.agg(F.sum("source_size").alias("all_size"), F.sum("weight").alias("all_weight"))
    filled = filled.crossJoin(F.broadcast(total))
    share = (F.col("all_size") - F.col("most_before")) / (F.col("all_weight") - F.col("weight_before"))
    filled = materialize(filled.withColumn("full", F.col("most") < F.col("weight") * share), "targets")
    rest = filled.agg(
        ((F.max("all_size") - F.coalesce(F.sum(F.when(F.col("full"), F.col("most"))), F.lit(0)))
         / F.sum(F.when(~F.col("full"), F.col("weight")))).alias("unit")
    )
    target = F.when(F.col("full"), F.col("most").cast("double")).otherwise(F.col("weight") * F.col("unit"))
    return filled.crossJoin(F.broadcast(rest)).select("source", "source_size", target.alias("target"), "ramp")


def mix(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    source: str = "source",
    weights: tuple[int, ...] = WEIGHTS,
    ramps: tuple[float, ...] = RAMPS,
    cap: int = CAP,
) -> DataFrame:
    """What a mix takes of each document, and when, in order of training position.

    A source's documents lie behind each other in a fixed hashed order, again and again, up to ``cap`` times. It gives
    the words of that line up to its target, so its last document may give only a part. At time t in [0, 1] a source
    is drawn with weight target * (1 + ramp * (2t - 1)); the integral of that is its demand, and the time at which the
    demand reaches a document's place in the line is the document's training position.

    A source is summed in many hash buckets whose totals are carried on, so a source with most rows is never one group.
    All sums are of whole numbers: reruns and other partitionings give the same rows.

    Returns doc_id, text_hash, source, size, source_size, target, taken, copies (whole and part reads of it), position (of the
    first; null if none), rows by position, unread ones last. Null texts have size 0 and are never read; a null source
    is one source; repeated rows count each by itself; an empty table gives no rows. Other columns are not read.
    """
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        F.size(split_words(F.col(text))).cast("long").alias("size"),
        F.xxhash64(F.col(doc_id)).alias("h"),
        F.xxhash64(F.col(text)).alias("text_hash"),
    )
    rows = materialize(rows, "sizes")
    targets = materialize(source_targets(rows, weights, ramps, cap), "targets")
    bits = min(20, max(8, math.ceil(math.log2(max(1, rows.count() / ROWS_PER_BUCKET)))))
    bucketed = rows.withColumn("bucket", F.shiftrightunsigned("h", 64 - bits))
    totals = bucketed.groupBy("source", "bucket").agg(F.sum("size").alias("bucket_size"))
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select("source", "bucket", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)).alias("bucket_start"))
    totals = materialize(totals, "buckets")
    inside = (
        Window.partitionBy("source", "bucket").orderBy("h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = bucketed.withColumn("inside", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.alias("p").join(
        small_side(totals).alias("b"), F.col("p.source").eqNullSafe(F.col("b.source")) & (F.col("p.bucket") == F.col("b.bucket"))
    ).select("p.doc_id", "p.text_hash", "p.source", "p.size", (F.col("inside") + F.col("bucket_start")).alias("start"))
    placed = placed.alias("p").join(
        small_side(targets).alias("s"), F.col("p.source").eqNullSafe(F.col("s.source"))
    ).select("p.*", "source_size", "target", "ramp")
    goal = F.round("target").cast("long")
    reads = [F.least(F.greatest(goal - F.col("source_size") * e - F.col("start"), F.lit(0)), F.col("size")) for e in range(cap)]
    taken = sum(reads[1:], reads[0])
    copies = sum([(r > 0).cast("int") for r in reads[1:]], (reads[0] > 0).cast("int"))
    demand, a = F.col("start") / F.col("target"), F.col("ramp")
    late = (-(1 - a) + F.sqrt((1 - a) * (1 - a) + 4 * a * demand)) / (2 * a)
    position = F.when(taken > 0, F.when(a == 0, demand).otherwise(late))
    out = placed.select(
        "doc_id", "text_hash", "source", "size", "source_size", "target", taken.cast("long").alias("taken"), copies.alias("copies"), position.alias("position")
    )
    return out.orderBy(F.col("position").asc_nulls_last(), "doc_id")
