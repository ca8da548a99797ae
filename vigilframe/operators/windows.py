"""Count, time and adaptive record windows, in long and packed form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.text import is_ood_record
from vigilframe.operators.ordering import match_keys, match_small, position, top_k


def assign_count_windows(pos: str, n: str, size: int, stride: int) -> tuple[Column, Column]:
    """First and last candidate window of a record at a position."""
    first = F.greatest(F.lit(0), F.ceil((F.col(pos) - size + 1) / F.lit(stride))).cast("long")
    last = F.least(
        F.floor(F.col(pos) / F.lit(stride)), F.floor((F.col(n) - size) / F.lit(stride))
    ).cast("long")
    return first, last


def count_windows(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    size: int,
    stride: int,
    buckets: int | None = None,
) -> DataFrame:
    """Full windows of ``size`` records every ``stride`` records, never across groups.

    Long form: one row per (window, record) with ``window_idx`` and ``window_pos``.
    """
    placed = position(df, [group], order, "__pos", size_name="__n", buckets=buckets)
    return expand_count_windows(placed, size, stride)


def expand_count_windows(placed: DataFrame, size: int, stride: int) -> DataFrame:
    first, last = assign_count_windows("__pos", "__n", size, stride)
    return (
        placed.withColumns({"__first": first, "__last": last})
        .where(F.col("__first") <= F.col("__last"))
        .withColumn("window_idx", F.explode(F.sequence("__first", "__last")))
        .withColumn("window_pos", F.col("__pos") - F.col("window_idx") * stride)
        .drop("__pos", "__n", "__first", "__last")
    )


def window_settings(
    df: DataFrame,
    group: str,
    order: Sequence[str],
    settings: Sequence[tuple[int, int]],
    buckets: int | None = None,
) -> DataFrame:
    """All (size, stride) settings in one pass over positions."""
    placed = position(df, [group], order, "__pos", size_name="__n", buckets=buckets)
    pairs = F.array(*[F.struct(F.lit(a).alias("size"), F.lit(b).alias("stride")) for a, b in settings])
    each = placed.withColumn("__s", F.explode(pairs)).select(
        "*", F.col("__s.size").alias("window_size"), F.col("__s.stride").alias("stride")
    )
    first = F.greatest(F.lit(0), F.ceil((F.col("__pos") - F.col("window_size") + 1) / F.col("stride"))).cast("long")
    last = F.least(
        F.floor(F.col("__pos") / F.col("stride")), F.floor((F.col("__n") - F.col("window_size")) / F.col("stride"))
    ).cast("long")
    return (
        each.withColumns({"__first": first, "__last": last})
        .where(F.col("__first") <= F.col("__last"))
        .withColumn("window_idx", F.explode(F.sequence("__first", "__last")))
        .withColumn("window_pos", F.col("__pos") - F.col("window_idx") * F.col("stride"))
        .drop("__pos", "__n", "__first", "__last", "__s")
    )


def time_windows(
    df: DataFrame, group: str, ts_micros: str, record_id: str, length_micros: int, size: int
) -> DataFrame:
    """Windows of a fixed length every half length, anchored at the group's first record.

    Closed-open; only windows the group's latest record completes; first ``size`` records.
    """
    hop = length_micros // 2
    length = hop * 2
    bounds = df.groupBy(group).agg(F.min(ts_micros).alias("__t0"), F.max(ts_micros).alias("__t1"))
    k = F.floor((F.col(ts_micros) - F.col("__t0")) / F.lit(hop)).cast("long")
    placed = (
        match_small(df, bounds, [group])
        .withColumn("window_idx", F.explode(F.array(k - 1, k)))
        .where(F.col("window_idx") >= 0)
        .withColumn("window_start", F.col("__t0") + F.col("window_idx") * hop)
        .where(F.col("__t1") >= F.col("window_start") + length)
        .drop("__t0", "__t1")
    )
    kept = top_k(placed, [group, "window_idx"], [ts_micros, record_id], size, "window_pos")
    return kept.withColumn("window_pos", (F.col("window_pos") - 1).cast("long"))


def adaptive_windows(
    df: DataFrame,
    group: str,
    ts_seconds: str,
    order: Sequence[str],
    size: int,
    stride: int,
    min_size: int,
    max_size: int,
    live_cut: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Windows whose length follows the local record rate.

    ``live_cut`` keeps only the records a live buffer holds when it fires.
    """
    placed = position(df, [group], order, "__pos", buckets=buckets)
    span_end = placed.select(group, (F.col("__pos") - (size - 1)).alias("__pos"), F.col(ts_seconds).alias("__end"))
    starts = placed.where(F.col("__pos") % stride == 0).select(group, "__pos", F.col(ts_seconds).alias("__start"))
    span = F.greatest(F.col("__end") - F.col("__start"), F.lit(1e-6))
    rate = F.greatest(F.lit(float(size)) / span, F.lit(1e-6))
    wanted = F.least(
        F.greatest(F.lit(float(size)) * (1 + 0.5 / rate), F.lit(float(min_size))), F.lit(float(max_size))
    )
    length = F.floor(wanted).cast("long") if size >= 2 else F.lit(size).cast("long")
    shown = F.least(length, F.lit(size).cast("long")) if live_cut else length
    anchors = (
        match_keys(starts, span_end, [group, "__pos"], "inner")
        .select(group, F.floor(F.col("__pos") / stride).cast("long").alias("window_idx"),
                F.col("__pos").alias("__from"), shown.alias("window_length"))
        .withColumn("__pos", F.explode(F.sequence(F.col("__from"), F.col("__from") + F.col("window_length") - 1)))
        .withColumn("window_pos", F.col("__pos") - F.col("__from"))
        .drop("__from")
    )
    return match_keys(placed, anchors, [group, "__pos"], "inner").drop("__pos")


def pack_windows(long: DataFrame, keys: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """One row per window with its records as a position-ordered array (bounded by the size)."""
    item = F.struct("window_pos", *fields)
    return long.groupBy(*keys).agg(F.sort_array(F.collect_list(item)).alias("records"))


def pad_window(records: Column, target: int) -> Column:
    """Repeat the last record up to the target length."""
    missing = F.greatest(F.lit(target) - F.size(records), F.lit(0))
    return F.concat(records, F.array_repeat(F.element_at(records, -1), missing))


def valid_mask(records: Column, target: int) -> Column:
    n = F.least(F.size(records), F.lit(target))
    return F.concat(F.array_repeat(F.lit(True), n), F.array_repeat(F.lit(False), F.lit(target) - n))


def window_labels(long: DataFrame, keys: Sequence[str], labels: str, id_classes: Sequence[str]) -> DataFrame:
    """Multi-hot label vector over the known classes and the OOD flag of each window."""
    flags = {
        f"__c{i}": F.max(F.array_contains(F.col(labels), c).cast("int")) for i, c in enumerate(id_classes)
    }
    grouped = long.groupBy(*keys).agg(
        *[v.alias(k) for k, v in flags.items()],
        F.max(is_ood_record(F.col(labels), list(id_classes)).cast("int")).alias("__ood"),
    )
    return grouped.select(
        *keys, F.array(*[F.col(k) for k in flags]).alias("y"), (F.col("__ood") == 1).alias("is_ood")
    )


def pure_id_windows(windows: DataFrame, flag: str = "is_ood") -> DataFrame:
    return windows.where(~F.col(flag))


def flatten_window(records_features: Column, mask: Column | None = None, append_mask: bool = True) -> Column:
    """Window features as one vector; invalid steps become zeros."""
    if mask is None:
        return F.flatten(records_features)
    zeroed = F.zip_with(
        records_features, mask, lambda x, ok: F.when(ok, x).otherwise(F.transform(x, lambda v: v * 0))
    )
    flat = F.flatten(zeroed)
    return F.concat(flat, F.transform(mask, lambda ok: ok.cast("double"))) if append_mask else flat


def input_statistics(long: DataFrame, keys: Sequence[str], features: Sequence[str]) -> DataFrame:
    """Window means of per-record missing ratio, zero ratio, mean and std, and the degenerate rule."""
    f = len(features)
    filled = [F.coalesce(F.col(c), F.lit(0.0)) for c in features]
    missing = sum((F.col(c).isNull().cast("double") for c in features), F.lit(0.0)) / f
    zero = sum(((x == 0).cast("double") for x in filled), F.lit(0.0)) / f
    mean = sum(filled, F.lit(0.0)) / f
    var = sum(((x - F.col("__mean")) * (x - F.col("__mean")) for x in filled), F.lit(0.0)) / f
    rows = long.withColumns({"__missing": missing, "__zero": zero, "__mean": mean}).withColumn("__std", F.sqrt(var))
    out = rows.groupBy(*keys).agg(
        F.avg("__missing").alias("missing_ratio"),
        F.avg("__zero").alias("zero_ratio"),
        F.avg("__mean").alias("input_mean"),
        F.avg("__std").alias("input_std"),
    )
    return out.withColumn(
        "degenerate",
        (F.col("missing_ratio") >= 0.999) | ((F.col("missing_ratio") >= 0.95) & (F.col("input_std") <= 1e-8)),
    )


def has_mixed_labels(label: str) -> Column:
    """Aggregate: the group shows more than one label.

    Compares two independent hashes (96 bits) of the label: numbers stay in the hash
    aggregate, while minima of strings would sort every row first.
    """
    wide, narrow = F.xxhash64(label), F.crc32(F.col(label).cast("binary"))
    return (F.min(wide) != F.max(wide)) | (F.min(narrow) != F.max(narrow))


def window_mix(long: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Per window: whether it holds more than one label."""
    return long.groupBy(*keys).agg(has_mixed_labels(label).alias("mixed"))


def mix_statistics(mixed: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    out = mixed.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col("mixed")).alias("mixed_windows"),
        F.count_if(~F.col("mixed")).alias("pure_windows"),
    )
    return out.withColumn("mixed_ratio", F.col("mixed_windows") / F.greatest(F.col("windows"), F.lit(1)))


def window_phase(long: DataFrame, keys: Sequence[str], phase: str) -> DataFrame:
    """Majority phase of a window; ties go to the phase seen first."""
    counts = long.groupBy(*keys, phase).agg(
        F.count(F.lit(1)).alias("__n"), F.min("window_pos").alias("__first")
    )
    return counts.groupBy(*keys).agg(
        F.max_by(F.col(phase), F.struct("__n", (-F.col("__first")).alias("f"))).alias("window_phase")
    )


def attack_fraction(long: DataFrame, keys: Sequence[str], attack: Column) -> DataFrame:
    return long.groupBy(*keys).agg(F.avg(attack.cast("double")).alias("attack_fraction"))


def mix_bucket(fraction: Column, cuts: Sequence[float] = (0.05, 0.10, 0.20, 0.50)) -> Column:
    out = F.lit("pure_benign")
    for cut in cuts:
        out = F.when(fraction >= cut, F.lit(f">={cut:.2f}")).otherwise(out)
    return F.when((fraction > 0) & (fraction < cuts[0]), F.lit(f"<{cuts[0]:.2f}")).otherwise(out)


def group_index(value: Column, known: Sequence[str]) -> Column:
    """Index in the sorted known groups; anything else is the unknown token."""
    table = F.create_map(*[x for i, g in enumerate(sorted(known)) for x in (F.lit(g), F.lit(i))])
    return F.coalesce(F.try_element_at(table, value), F.lit(len(known)))


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last row per key as a partial aggregate."""
    others = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*others), F.struct(*order)).alias("__row"))
        .select(*keys, "__row.*")
    )
