"""Score fusion, thresholds, temperature and class-threshold search."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import scores as S
from vigilframe.functions.fixed import FUSION_ALIASES, FUSION_MODES, SCORE_NAMES
from vigilframe.functions.text import group_id
from vigilframe.operators.metrics import auroc
from vigilframe.operators.ordering import quantiles, wide_quantiles

TEMPERATURE_GRID = tuple(round(0.5 + 0.25 * i, 2) for i in range(15))
CLASS_GRID = tuple(round(0.05 * i, 2) for i in range(1, 20))


@dataclass
class Calibration:
    """Fitted fusion model: a few numbers per score."""

    names: tuple[str, ...]
    fusion: str
    q: float
    directions: dict[str, float] = field(default_factory=dict)
    medians: dict[str, float] = field(default_factory=dict)
    iqrs: dict[str, float] = field(default_factory=dict)
    weights: dict[str, float] = field(default_factory=dict)
    score_thresholds: dict[str, float] = field(default_factory=dict)
    threshold: float = 0.0


def canonical_fusion(mode: str) -> str:
    name = FUSION_ALIASES.get(mode.strip().lower(), mode.strip().lower())
    if name not in FUSION_MODES:
        raise ValueError(f"unsupported fusion: {mode}")
    return name


def robust_scales(df: DataFrame, names: Sequence[str], directions: Mapping[str, float]) -> dict[str, tuple[float, float]]:
    """Median and floored inter-quartile range per oriented score."""
    values = {n: S.orient(F.col(n).cast("double"), directions.get(n, 1.0)) for n in names}
    r = wide_quantiles(df, [], values, {"q25": 0.25, "q50": 0.5, "q75": 0.75}).first()
    return {n: (float(r[f"{n}_q50"]), max(float(r[f"{n}_q75"] - r[f"{n}_q25"]), 1e-6)) for n in names}


def _thresholds(df: DataFrame, values: dict[str, Column], q: float) -> dict[str, float]:
    r = wide_quantiles(df, [], values, {"t": q}).first()
    return {n: float(r[f"{n}_t"]) for n in values}


def normalized_columns(cal: Calibration) -> dict[str, Column]:
    return {
        n: S.robust_normalize(S.orient(F.col(n).cast("double"), cal.directions.get(n, 1.0)), cal.medians[n], cal.iqrs[n])
        for n in cal.names
    }


def correlation(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Score correlation as (score_a, score_b, corr); NaN counts as 0, identity for two rows or fewer."""
    pairs = [(a, b) for a in names for b in names]
    # the built-in corr raises on a constant column in ANSI mode
    aggs = [
        F.try_divide(F.covar_pop(F.col(a), F.col(b)), F.stddev_pop(a) * F.stddev_pop(b)).alias(f"c_{a}__{b}")
        for a, b in pairs
    ]
    row = df.agg(F.count(F.lit(1)).alias("n"), *aggs)
    items = []
    for a, b in pairs:
        value = F.coalesce(F.nanvl(F.col(f"c_{a}__{b}"), F.lit(0.0)), F.lit(0.0))
        items.append(
            F.struct(
                F.lit(a).alias("score_a"),
                F.lit(b).alias("score_b"),
                F.when(F.col("n") > 2, value).otherwise(F.lit(1.0 if a == b else 0.0)).alias("corr"),
            )
        )
    return row.select(F.inline(F.array(*items)))


def fusion_weights(df: DataFrame, names: Sequence[str], mode: str) -> dict[str, float]:
    """Weights over normalised score columns."""
    mode = canonical_fusion(mode)
    if mode in names:
        return {n: 1.0 if n == mode else 0.0 for n in names}
    if mode in ("mean", "hard_voting"):
        return {n: 1.0 / len(names) for n in names}
    if mode == "variance_weighted":
        r = df.agg(*[F.stddev_pop(n).alias(n) for n in names]).first()
        inv = {n: 1.0 / ((r[n] or 0.0) + 1e-6) for n in names}
    else:
        load = {n: 0.0 for n in names}
        for r in correlation(df, names).collect():  # one row per score pair
            load[r["score_a"]] += abs(r["corr"])
        inv = {n: 1.0 / max(load[n], 1e-6) for n in names}
    total = sum(inv.values())
    return {n: v / total for n, v in inv.items()}


def fit_calibration(
    df: DataFrame,
    fusion: str = "correlation_aware",
    q: float = 0.95,
    directions: Mapping[str, float] | None = None,
    names: Sequence[str] = SCORE_NAMES,
) -> Calibration:
    """Fit on in-distribution validation scores only."""
    cal = Calibration(tuple(names), canonical_fusion(fusion), q, dict(directions or {n: 1.0 for n in names}))
    for n, (med, iqr) in robust_scales(df, names, cal.directions).items():
        cal.medians[n], cal.iqrs[n] = med, iqr
    norm = df.select(*[c.alias(n) for n, c in normalized_columns(cal).items()])
    cal.weights = fusion_weights(norm, names, cal.fusion)
    cal.score_thresholds = _thresholds(norm, {n: F.col(n) for n in names}, q)
    cal.threshold = _thresholds(norm, {"fused": fused_column(cal, {n: F.col(n) for n in names})}, q)["fused"]
    return cal


def fused_column(cal: Calibration, normalized: Mapping[str, Column]) -> Column:
    return S.fuse(normalized, cal.weights, cal.score_thresholds if cal.fusion == "hard_voting" else None)


def apply_calibration(df: DataFrame, cal: Calibration) -> DataFrame:
    """Normalised scores, fused score and dominant source of every row."""
    norm = {f"norm_{n}": c for n, c in normalized_columns(cal).items()}
    out = df.withColumns(norm)
    cols = {n: F.col(f"norm_{n}") for n in cal.names}
    return out.withColumns({"fused": fused_column(cal, cols), "dominant_source": S.dominant_source(cols, cal.names)})


def fusion_sweep(df: DataFrame, q: float = 0.95, names: Sequence[str] = SCORE_NAMES) -> dict[str, Calibration]:
    """All fusion modes on the same scores, sharing one normalisation and one threshold pass."""
    base = Calibration(tuple(names), "mean", q, {n: 1.0 for n in names})
    for n, (med, iqr) in robust_scales(df, names, base.directions).items():
        base.medians[n], base.iqrs[n] = med, iqr
    norm = df.select(*[c.alias(n) for n, c in normalized_columns(base).items()])
    votes = _thresholds(norm, {n: F.col(n) for n in names}, q)
    out = {}
    for mode in FUSION_MODES:
        weights = fusion_weights(norm, names, mode)
        out[mode] = Calibration(base.names, mode, q, base.directions, base.medians, base.iqrs, weights, votes)
    fused = {m: fused_column(cal, {n: F.col(n) for n in names}) for m, cal in out.items()}
    for mode, t in _thresholds(norm, fused, q).items():
        out[mode].threshold = t
    return out


def group_thresholds(
    df: DataFrame,
    group: str,
    fused: str,
    global_threshold: float,
    q: float,
    min_samples: int = 10,
    strategy: str = "raw",
    shrink_k: float = 1000.0,
    min_ratio: float = 1.0,
) -> DataFrame:
    """Threshold, provenance and counts per group.

    Groups below ``min_samples`` keep a row with NULL threshold and the fallback reason.
    """
    clean = df.withColumn("__g", group_id(F.col(group))).where(F.col("__g").isNotNull())
    raw = quantiles(clean, ["__g"], fused, {"raw_threshold": q})
    counts = clean.groupBy("__g").agg(F.count(F.lit(1)).alias("n"))
    d = counts.join(raw, "__g")
    g, r = float(global_threshold), F.col("raw_threshold")
    alpha = F.lit(1.0) if shrink_k <= 0 else F.col("n") / (F.col("n") + float(shrink_k))
    shrunk = alpha * r + (1 - alpha) * g
    if strategy == "raw":
        smooth, final, source = r, r, F.lit("group_raw")
    elif strategy == "shrink":
        smooth, final, source = shrunk, shrunk, F.lit("group_shrink")
    elif strategy == "conservative":
        floor = g * float(min_ratio)
        smooth, final = shrunk, F.greatest(shrunk, F.lit(floor))
        source = F.when(final == floor, "group_conservative_floor").otherwise("group_conservative")
    elif strategy == "global_floor":
        smooth, final, source = r, F.greatest(r, F.lit(g)), F.lit("group_global_floor")
    else:
        raise ValueError(f"unsupported strategy: {strategy}")
    enough = F.col("n") >= max(int(min_samples), 0)
    return d.select(
        F.col("__g").alias("group_id"),
        "n",
        F.when(enough, r).alias("raw_threshold"),
        F.when(enough, smooth).alias("smoothed_threshold"),
        F.when(enough, final).alias("threshold"),
        F.when(enough, source).alias("source"),
        F.when(~enough, F.lit("fallback_to_global_due_to_small_validation_size")).alias("fallback_reason"),
    )


def phase_thresholds(
    df: DataFrame, phase: str, fused: str, global_threshold: float, q: float, min_samples: int
) -> DataFrame:
    clean = df.withColumn("__p", group_id(F.col(phase))).where(F.col("__p").isNotNull())
    d = clean.groupBy("__p").agg(F.count(F.lit(1)).alias("n")).join(quantiles(clean, ["__p"], fused, {"t": q}), "__p")
    enough = F.col("n") >= int(min_samples)
    return d.select(
        F.col("__p").alias("phase"),
        "n",
        F.when(enough, F.col("t")).otherwise(F.lit(float(global_threshold))).alias("threshold"),
        F.when(enough, "phase").otherwise("global_fallback").alias("source"),
    )


def resolve_thresholds(
    df: DataFrame,
    global_threshold: float,
    group: str | None = None,
    group_table: DataFrame | None = None,
    phase: str | None = None,
    phase_table: DataFrame | None = None,
) -> DataFrame:
    """Threshold and its source per row; the group table wins over the phase table."""
    g = F.lit(float(global_threshold))
    if group_table is not None and group is not None:
        fitted = group_table.where(F.col("threshold").isNotNull()).select(
            F.col("group_id").alias("__k"), F.col("threshold").alias("__t"), F.col("source").alias("__s")
        )
        keyed = df.withColumn("__k", group_id(F.col(group)))
    elif phase_table is not None and phase is not None:
        fitted = phase_table.select(
            F.col("phase").alias("__k"), F.col("threshold").alias("__t"), F.col("source").alias("__s")
        )
        keyed = df.withColumn("__k", group_id(F.col(phase)))
    else:
        return df.withColumns({"threshold": g, "threshold_source": F.lit("global")})
    out = keyed.join(fitted, "__k", "left")
    source = F.when(F.col("__k").isNull(), "global").otherwise(F.coalesce("__s", F.lit("global_fallback")))
    return out.withColumns({"threshold": F.coalesce("__t", g), "threshold_source": source}).drop("__k", "__t", "__s")


def bootstrap_thresholds(df: DataFrame, group: str, fused: str, benign: Column, margin: float) -> DataFrame:
    """Group threshold just above the largest benign score."""
    return df.where(benign).groupBy(group).agg(
        F.count(F.lit(1)).alias("n"), (F.max(fused) + float(margin)).alias("threshold")
    )


def explode_classes(df: DataFrame, ids: Sequence[str], labels: str, values: Mapping[str, str]) -> DataFrame:
    """Window x class long form: ``class_idx``, ``y`` and one column per named array."""
    zipped = F.arrays_zip(F.col(labels).alias("y"), *[F.col(v).alias(k) for k, v in values.items()])
    return df.select(*ids, F.posexplode(zipped).alias("class_idx", "__z")).select(*ids, "class_idx", "__z.*")


def temperature_losses(long: DataFrame, grid: Sequence[float] = TEMPERATURE_GRID) -> DataFrame:
    """Mean BCE-with-logits per temperature over all windows and classes."""
    losses = [
        F.avg(S.softplus(F.col("logit") / float(t)) - F.col("y") * F.col("logit") / float(t)).alias(f"t{i}")
        for i, t in enumerate(grid)
    ]
    row = long.agg(*losses)
    items = [F.struct(F.lit(i).alias("ord"), F.lit(float(t)).alias("temperature"), F.col(f"t{i}").alias("loss"))
             for i, t in enumerate(grid)]
    return row.select(F.inline(F.array(*items)))


def best_temperature(losses: DataFrame) -> DataFrame:
    """First temperature with the smallest loss."""
    return losses.agg(
        F.min_by("temperature", F.struct("loss", "ord")).alias("temperature"), F.min("loss").alias("loss")
    )


def class_thresholds(long: DataFrame, grid: Sequence[float] = CLASS_GRID) -> DataFrame:
    """Best-F1 threshold per class; the first one wins, no positives gives 0.95."""
    aggs = [F.sum("y").alias("__pos")]
    for i, t in enumerate(grid):
        hit = F.col("p") >= float(t)
        aggs += [F.sum(F.when(hit, F.col("y")).otherwise(0)).alias(f"tp{i}"), F.count_if(hit).alias(f"n{i}")]
    row = long.groupBy("class_idx").agg(*aggs)
    items = []
    for i, t in enumerate(grid):
        precision = F.col(f"tp{i}") / F.greatest(F.col(f"n{i}"), F.lit(1))
        recall = F.col(f"tp{i}") / F.greatest(F.col("__pos"), F.lit(1))
        f1 = 2 * precision * recall / F.greatest(precision + recall, F.lit(1e-12))
        items.append(F.struct(f1.alias("f1"), F.lit(-i).alias("ord"), F.lit(float(t)).alias("t")))
    best = F.array_max(F.array(*items))
    return row.select(
        "class_idx",
        F.col("__pos").cast("long").alias("positives"),
        F.when(F.col("__pos") == 0, F.lit(0.95)).otherwise(best["t"]).alias("threshold"),
        F.when(F.col("__pos") == 0, F.lit(0.0)).otherwise(best["f1"]).alias("f1"),
    )


def pseudo_ood(df: DataFrame, labels: str, classes: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Leave-one-class-out copies of the windows and the summary of usable classes."""
    tagged = df.select("*", F.posexplode(labels).alias("class_idx", "__y")).withColumn(
        "pseudo_ood", (F.col("__y") > 0.5).cast("int")
    )
    names = F.array(*[F.lit(c) for c in classes])
    summary = tagged.groupBy("class_idx").agg(
        F.sum("pseudo_ood").alias("pseudo_ood_windows"),
        (F.count(F.lit(1)) - F.sum("pseudo_ood")).alias("pseudo_id_windows"),
    )
    summary = summary.withColumns(
        {
            "used": (F.col("pseudo_ood_windows") > 0) & (F.col("pseudo_id_windows") > 0),
            "class_name": F.element_at(names, F.col("class_idx") + 1),
        }
    )
    used = summary.where("used").select("class_idx")
    return tagged.join(used, "class_idx", "left_semi").drop("__y"), summary


def score_directions(df: DataFrame, truth: str, names: Sequence[str] = SCORE_NAMES) -> DataFrame:
    """Raw AUROC per score; a score that ranks the wrong way round is flipped."""
    items = F.array(*[F.struct(F.lit(n).alias("score_name"), F.col(n).cast("double").alias("score")) for n in names])
    long = df.select(F.col(truth).cast("int").alias("y"), F.inline(items))
    a = auroc(long, ["score_name"], "score", "y")
    flipped = F.coalesce(F.col("auroc") < 0.5, F.lit(False))
    return a.select(
        "score_name",
        F.col("auroc").alias("raw_auroc"),
        flipped.alias("flipped"),
        F.when(flipped, 1 - F.col("auroc")).otherwise(F.col("auroc")).alias("effective_auroc"),
        F.when(flipped, -1.0).otherwise(1.0).alias("direction"),
    )
