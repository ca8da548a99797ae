"""Column resolution, leakage control, feature selection, guards and de-duplication."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vigilframe.functions import fixed
from vigilframe.functions import text as X
from vigilframe.operators.ordering import last_known, match_keys, position, previous


# --- column resolution -----------------------------------------------------------
def resolve_column(
    columns: Sequence[str],
    requested: str | None,
    candidates: Sequence[str],
    purpose: str,
    required: bool = True,
    match: str = "key",
) -> str | None:
    """Requested name or first candidate, compared exactly, by lower case or by key."""
    norm: Callable[[str], str] = {"key": X.column_key, "lower": str.lower, "exact": str}[match]
    known: dict[str, str] = {}
    for c in columns:
        known.setdefault(norm(c), c)
    if requested:
        if norm(requested) in known:
            return known[norm(requested)]
        raise ValueError(f"no {purpose} column {requested!r} among {list(columns)}")
    for c in candidates:
        if norm(c) in known:
            return known[norm(c)]
    if required:
        raise ValueError(f"no {purpose} column among {list(columns)}")
    return None


def drop_reason(
    column: str, protected: Sequence[str], allow_ports: bool = False, patterns: Sequence[str] = fixed.DROP_PATTERNS
) -> str | None:
    """Why a column may not be a feature, or None."""
    low = column.lower()
    if low in {p.lower() for p in protected} | {"__labels", "__is_ood_record"}:
        return "protected"
    if low.startswith(fixed.RESERVED_PREFIXES):
        return "reserved_prefix"
    if low in fixed.RESERVED_COLUMNS:
        return "reserved_column"
    if any(p in low for p in patterns):
        return "leakage_pattern"
    if not allow_ports and any(p in low for p in fixed.PORT_PATTERNS):
        return "port"
    return None


def leakage_safe(df: DataFrame, protected: Sequence[str], allow_ports: bool = False) -> DataFrame:
    return df.select(*[c for c in df.columns if drop_reason(c, protected, allow_ports) is None])


def leakage_report(df: DataFrame, features: Sequence[str], protected: Sequence[str]) -> DataFrame:
    rows = [
        (c, c in features, "retained" if c in features else (drop_reason(c, protected) or "not_selected"))
        for c in df.columns
    ]
    return df.sparkSession.createDataFrame(rows, "column_name string, retained boolean, reason string")


def _is_number(field: T.StructField) -> bool:
    return isinstance(field.dataType, T.NumericType)


def numeric_ratios(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Share of cells that read as numbers, one pass over all columns."""
    aggs = [F.avg(X.coerce_number(F.col(c)).isNotNull().cast("double")).alias(c) for c in columns]
    row = df.agg(*aggs)
    items = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("numeric_ratio")) for c in columns])
    return row.select(F.inline(items))


def infer_features(df: DataFrame, protected: Sequence[str], min_ratio: float = 0.9) -> list[str]:
    open_cols = [c for c in df.columns if drop_reason(c, protected) is None]
    text = [c for c in open_cols if not _is_number(df.schema[c])]
    ok = set(open_cols) - set(text)
    if text:
        ok |= {r[0] for r in numeric_ratios(df, text).where(F.col("numeric_ratio") >= min_ratio).collect()}
    if not ok:
        raise ValueError("no feature columns left")
    return [c for c in open_cols if c in ok]


def monotone_fractions(df: DataFrame, columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Share of neighbouring non-decreasing steps in row order, per column."""
    both = previous(df.withColumn("__cur", F.struct(*columns)), [], order, "__cur", "__prev")
    aggs = [F.avg((F.col(f"__cur.{c}") >= F.col(f"__prev.{c}")).cast("double")).alias(c) for c in columns]
    return both.where(F.col("__prev").isNotNull()).agg(*aggs)


def feature_report(
    df: DataFrame,
    columns: Sequence[str],
    order: Sequence[str],
    forced: Sequence[str] = (),
    min_ratio: float = 0.95,
    approx: bool = False,
) -> DataFrame:
    """Selection decision per column; the first reason in rejection order wins.

    Values are counted as (column, value) pairs, combined before the shuffle, then pairs per column; so a wide table
    needs two groupings, whatever the number of its columns. An empty table has all counts 0.
    """
    nums = df.select(*order, *[X.coerce_number(F.col(c)).alias(f"v_{c}") for c in columns])
    vals = [f"v_{c}" for c in columns]
    pairs = nums.select(F.posexplode(F.array(*vals)).alias("i", "x"))
    if approx:
        counts = pairs.groupBy("i").agg(
            F.count(F.lit(1)).alias("rows"), F.count("x").alias("n"), F.approx_count_distinct("x").alias("unique_count")
        )
    else:
        counts = pairs.groupBy("i", "x").agg(F.count(F.lit(1)).alias("m")).groupBy("i").agg(
            F.sum("m").alias("rows"), F.sum(F.when(F.col("x").isNotNull(), F.col("m"))).alias("n"), F.count("x").alias("unique_count")
        )
    mono = monotone_fractions(nums, vals, order)
    forced_low = {f.lower() for f in forced}
    items = [
        F.struct(
            F.lit(i).alias("i"),
            F.lit(c).alias("column_name"),
            F.lit(c.lower() in forced_low or drop_reason(c, []) is not None).alias("forced"),
            F.coalesce(F.col(f"v_{c}"), F.lit(0.0)).alias("monotone_fraction"),
        )
        for i, c in enumerate(columns)
    ]
    n, rows = (F.coalesce(c, F.lit(0)) for c in (F.col("n"), F.col("rows")))
    unique = F.coalesce("unique_count", F.lit(0))
    d = mono.select(F.inline(F.array(*items))).join(F.broadcast(counts), "i", "left").select(
        "column_name",
        "forced",
        (n / F.greatest(rows, F.lit(1))).alias("numeric_ratio"),
        unique.alias("unique_count"),
        (unique / F.greatest(n, F.lit(1))).alias("unique_ratio"),
        "monotone_fraction",
    )
    reason = (
        F.when(F.col("forced"), "forced_leakage_or_identifier_drop")
        .when(F.col("numeric_ratio") < min_ratio, "mostly_non_numeric")
        .when(F.col("unique_count") <= 1, "constant_or_empty")
        .when((F.col("unique_ratio") > 0.90) & (F.col("monotone_fraction") > 0.95), "capture_counter_like")
        .otherwise("kept")
    )
    return d.withColumn("reason", reason).drop("forced")


def unique_names(columns: Sequence[str], prefix: str = "raw_") -> dict[str, str]:
    """Sanitised output names, numbered on collision."""
    used: set[str] = set()
    out: dict[str, str] = {}
    for c in columns:
        low = re.sub(r"[./\- ]", "_", c.strip().lower())
        base = prefix + (re.sub(r"[^a-z0-9_]+", "_", low).strip("_") or "feature")
        name, i = base, 2
        while name in used:
            name, i = f"{base}_{i}", i + 1
        used.add(name)
        out[c] = name
    return out


# --- canonical frames --------------------------------------------------------------
def build_timestamp(df: DataFrame, column: str | None, index: str) -> DataFrame:
    """Add ``timestamp``: numeric, ISO text or plain text by an 80 % rule, row index where empty."""
    if column is None:
        return df.withColumn("timestamp", F.col(index).cast("string"))
    c = F.col(column).cast("string")
    num = c.try_cast("double")
    when = F.try_to_timestamp(c)
    r = df.agg(
        F.avg(num.isNotNull().cast("double")).alias("num"), F.avg(when.isNotNull().cast("double")).alias("dt")
    ).first()
    idx = F.col(index).cast("string")
    if (r["num"] or 0) >= 0.8:
        return df.withColumn("timestamp", F.coalesce(num, F.col(index).cast("double")))
    if (r["dt"] or 0) >= 0.8:
        return df.withColumn("timestamp", F.coalesce(F.date_format(when, "yyyy-MM-dd'T'HH:mm:ss"), idx))
    return df.withColumn("timestamp", F.coalesce(F.nullif(F.trim(c), F.lit("")), idx))


def prepared_frame(
    df: DataFrame,
    order: Sequence[str],
    label: str,
    timestamp: str | None,
    split: str | None,
    uav_id: str,
    dataset_name: str,
    source_type: str,
    normalizer: Callable[[Column], Column],
) -> DataFrame:
    """The eight metadata columns first, then the remaining raw columns."""
    indexed = build_timestamp(position(df.withColumnsRenamed(
        {c: f"__raw_{c}" for c in fixed.PREPARED_PREFIX if c in df.columns}), [],
        [f"__raw_{o}" if o in fixed.PREPARED_PREFIX else o for o in order], "record_id"),
        None if timestamp is None else (f"__raw_{timestamp}" if timestamp in fixed.PREPARED_PREFIX else timestamp),
        "record_id")
    ref = lambda c: f"__raw_{c}" if c in fixed.PREPARED_PREFIX else c
    raw = X.raw_label(F.col(ref(label)))
    meta = {
        "uav_id": F.lit(uav_id),
        "dataset_name": F.lit(dataset_name),
        "source_type": F.lit(source_type),
        "label": raw,
        "label_normalized": normalizer(raw),
        "split": F.lit("all") if split is None else X.split_name(F.col(ref(split))),
    }
    rest = [c for c in df.columns if c not in fixed.PREPARED_PREFIX]
    return indexed.withColumns(meta).select(*fixed.PREPARED_PREFIX, *rest)


def label_precedence(columns: Sequence[str], label: str | None, normalized: str | None) -> tuple[str, str]:
    """Which columns give label and label_normalized of an already prepared table."""
    source = "source_label" if "source_label" in columns else None
    if normalized is not None:
        return label or source or normalized, normalized
    if label is not None:
        return (source, label) if source is not None and label == "label" else (label, label)
    raise ValueError("no recognizable label column")


def adapt_dataset(
    df: DataFrame, order: Sequence[str], label: str | None = None, timestamp: str | None = None, record_id: str | None = None
) -> DataFrame:
    """Generic adapter: label, numeric timestamp, record id and numeric direction flags."""
    label = label or resolve_column(df.columns, None, fixed.ADAPTER_LABEL_CANDIDATES, "label", False, "lower")
    timestamp = timestamp or resolve_column(df.columns, None, fixed.ADAPTER_TIME_CANDIDATES, "time", False, "lower")
    record_id = record_id or resolve_column(df.columns, None, fixed.ADAPTER_ID_CANDIDATES, "id", False, "lower")
    out = position(df, [], order, "__row")
    out = adapter_timestamp(out, timestamp, ["__row"])
    out = out.withColumn("__label", F.lit("benign") if label is None else X.adapter_label(F.col(label)))
    rid = F.col("__row").cast("string") if record_id in (None, "Flow ID") else F.col(record_id).cast("string")
    out = out.withColumn("__rid", rid)
    for c in df.columns:
        if c.lower() in ("direction", "dir", "flow_direction") and not _is_number(df.schema[c]):
            out = out.withColumn(f"{c}_numeric", X.direction_flag(F.col(c)))
    return (
        out.withColumns({"label": F.col("__label"), "timestamp": F.col("__ts"), "record_id": F.col("__rid")})
        .drop("__label", "__ts", "__rid", "__row")
    )


def adapter_timestamp(df: DataFrame, column: str | None, order: Sequence[str]) -> DataFrame:
    """Numeric time with forward fill, or seconds since the first parsed time, as ``__ts``."""
    if column is None:
        return df.withColumn("__ts", F.col(order[0]).cast("double"))
    c = F.col(column).cast("string")
    num = c.try_cast("double")
    when = F.unix_micros(F.try_to_timestamp(c)) / 1e6
    r = df.agg(
        F.avg(num.isNotNull().cast("double")).alias("num"),
        F.min_by(when, F.when(when.isNotNull(), F.col(order[0]))).alias("base"),
    ).first()
    if (r["num"] or 0) > 0.8:
        value = num
    elif r["base"] is not None:
        value = when - float(r["base"])
    else:
        return df.withColumn("__ts", F.col(order[0]).cast("double"))
    filled = last_known(df.withColumn("__v", value), [], order, "__v", "__f")
    return filled.withColumn("__ts", F.coalesce(F.col("__f"), F.lit(0.0))).drop("__v", "__f")


def prefixed_ids(record_id: Column, group: Column, index: Column) -> Column:
    text = F.trim(record_id.cast("string"))
    prefix = F.concat(group, F.lit("_"))
    suffix = F.when(text.isNull() | (text == ""), index.cast("string")).otherwise(text)
    return F.when(F.coalesce(text.startswith(prefix), F.lit(False)), text).otherwise(F.concat(prefix, suffix))


# --- guards -------------------------------------------------------------------------
def guard_profile(df: DataFrame, label: str, known: Sequence[str], required: Sequence[str]) -> DataFrame:
    """Counts of unknown labels and blank cells; the caller raises on any."""
    missing = [c for c in required if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    aggs = [F.count_if(~F.col(label).isin(list(known))).alias("unknown_label")]
    aggs += [F.count_if(F.col(c).isNull() | (F.trim(F.col(c).cast("string")) == "")).alias(f"blank_{c}") for c in required]
    return df.agg(*aggs)


def enforce(profile: DataFrame) -> None:
    bad = {k: v for k, v in profile.first().asDict().items() if v}
    if bad:
        raise ValueError(f"input check failed: {bad}")


def single_source_type(df: DataFrame, column: str, expected: str | None) -> str:
    """The one source type of a table, checked without collecting the column."""
    r = df.agg(F.min(column).alias("a"), F.max(column).alias("b")).first()
    if r["a"] != r["b"] or r["a"] is None:
        raise ValueError(f"expected one source type, found {r['a']!r} .. {r['b']!r}")
    if expected is not None and r["a"] != expected:
        raise ValueError(f"source type {r['a']!r} does not equal {expected!r}")
    return r["a"]


def partition_flag(label: Column, id_classes: Sequence[str]) -> Column:
    return F.when(label.isin(list(id_classes)), "id").otherwise("ood")


# --- de-duplication -------------------------------------------------------------------
def drop_duplicates_first(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """First row per key in row order, NULL equal to NULL."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), order).alias("__r")).select(*keys, "__r.*")


def drop_ambiguous(df: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Remove every row whose feature pattern carries more than one label."""
    bad = df.groupBy(*features).agg(F.min(label).alias("a"), F.max(label).alias("b")).where("a <> b")
    return match_keys(df, bad.select(*features), features, "left_anti") if features else df


# --- serving --------------------------------------------------------------------------
def serving_frame(df: DataFrame, features: Sequence[str], protected: Sequence[str]) -> DataFrame:
    """Exactly the trained features; missing cells become 0 and are reported per row."""
    bad = [c for c in features if drop_reason(c, protected) is not None]
    if bad:
        raise ValueError(f"leakage columns requested as features: {bad}")
    present = [c for c in features if c in df.columns]
    values = {c: (X.finite(F.col(c)) if c in present else F.lit(None).cast("double")) for c in features}
    meta = [c for c in df.columns if c in protected]
    missing = F.array(*[values[c].isNull() for c in features])
    zero = F.array(*[F.coalesce(values[c], F.lit(0.0)) == 0 for c in features])
    return df.select(
        *meta,
        *[F.coalesce(values[c], F.lit(0.0)).alias(c) for c in features],
        missing.alias("missing_mask"),
        zero.alias("zero_mask"),
    )
