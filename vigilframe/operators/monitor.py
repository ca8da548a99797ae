"""Fleet-monitoring tables over records and detections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.functions import fixed
from vigilframe.functions import scores as S
from vigilframe.functions.text import attack_tokens
from vigilframe.operators.joins import asof_backward, entity_order, interval_join, phase_order
from vigilframe.operators.metrics import auroc
from vigilframe.operators.ordering import match_keys, top_k, wide_quantiles


def _ratio(a: Column, b: Column, default: float | None = 0.0) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(default).cast("double"))


def normalize_detections(df: DataFrame) -> DataFrame:
    """Detection rows with every fallback applied, from the nested detection document."""
    has = set(df.columns)

    def col(*names: str, default=None) -> Column:
        cols = [F.col(n) for n in names if n.split(".")[0] in has]
        return F.coalesce(*cols, F.lit(default)) if cols else F.lit(default)

    first_id = F.split(F.element_at(F.col("record_ids"), 1), ":")[0] if "record_ids" in has else F.lit(None)
    truth_attack = col("gt_attack_active", "ground_truth.attack_active").cast("boolean")
    truth_ood = col("ground_truth_is_ood", "ground_truth.is_ood").cast("boolean")
    is_ood = F.coalesce(col("is_ood").cast("boolean"), F.lit(False))
    known = F.coalesce(col("known_attack_alert").cast("boolean"), F.lit(False))
    ood_alert = F.coalesce(col("ood_alert").cast("boolean"), is_ood)
    level = F.lower(F.trim(F.coalesce(F.nullif(col("alert_level").cast("string"), F.lit("")), F.lit("normal"))))
    has_alert = F.coalesce(col("has_alert").cast("boolean"), known | ood_alert | level.isin("warning", "critical"))
    reason = F.lower(F.trim(F.coalesce(col("alert_reason").cast("string"), F.lit(""))))
    false_alert = F.coalesce(
        col("false_alert").cast("boolean"), has_alert & ~F.coalesce(truth_attack, F.lit(False))
    )
    threshold = F.coalesce(col("threshold", "ood_threshold").cast("double"), F.lit(0.0))
    return df.select(
        "window_id",
        F.coalesce(F.nullif(col("group_id").cast("string"), F.lit("")), first_id).alias("group_id"),
        F.coalesce(col("raw_ood_score", "ood_score").cast("double"), F.lit(0.0)).alias("raw_ood_score"),
        F.coalesce(col("normalized_ood_score", "ood_score").cast("double"), F.lit(0.0)).alias("ood_score"),
        threshold.alias("threshold"),
        F.coalesce(col("threshold_source", "ood_threshold_source").cast("string"), F.lit("global")).alias("threshold_source"),
        is_ood.alias("is_ood"),
        ood_alert.alias("ood_alert"),
        known.alias("known_attack_alert"),
        F.when(reason.isin("known_attack", "ood", "known_attack+ood", "none"), reason)
        .otherwise(S.alert_reason(known, ood_alert)).alias("alert_reason"),
        level.alias("alert_level"),
        has_alert.alias("has_alert"),
        false_alert.alias("false_alert"),
        F.coalesce(truth_attack, F.lit(False)).alias("attack_active"),
        truth_ood.alias("ground_truth_is_ood"),
        S.window_partition(truth_ood, truth_attack).alias("window_partition"),
    )


# --- per window and per group summaries ---------------------------------------------
def detection_summary(
    det: DataFrame, group: str, window: str, score: str = "ood_score", threshold: str = "threshold",
    source: str = "threshold_source", flag: str = "is_ood", top: int = 10,
) -> DataFrame:
    """Group rows and one global row from a single grouping-sets pass, with the top windows."""
    d = det.withColumn("__g", F.coalesce(F.col(group).cast("string"), F.lit(fixed.UNGROUPED)))
    first = F.min_by(threshold, window)
    close = (F.max(threshold) - first <= 1e-8 + 1e-5 * F.abs(first)) & (
        first - F.min(threshold) <= 1e-8 + 1e-5 * F.abs(first)
    )
    agg = d.groupingSets([["__g"], []], "__g").agg(
        F.grouping("__g").alias("__level"),
        F.count(F.lit(1)).alias("windows"),
        F.count_if(F.col(flag)).alias("ood_alerts"),
        F.avg(F.col(flag).cast("double")).alias("alert_rate"),
        F.avg(score).alias("mean_ood_score"),
        F.max(score).alias("max_ood_score"),
        F.when(close, first).otherwise(F.avg(threshold)).alias("threshold"),
        F.min_by(source, window).alias("threshold_source"),
        F.avg(threshold).alias("mean_ood_threshold"),
    )
    best = top_k(d, ["__g"], [f"-{score}", window], top, "__r").groupBy("__g").agg(
        F.array_sort(F.collect_list(F.struct("__r", F.col(window).alias("w")))).alias("__t")
    ).select("__g", F.transform("__t", lambda x: x["w"]).alias("top_window_ids"))
    return (
        agg.join(best, "__g", "left")
        .withColumn("group_id", F.when(F.col("__level") == 1, "__global__").otherwise(F.col("__g")))
        .drop("__g", "__level")
    )


def metrics_by_keys(det: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Detection metrics by any key list, NULL keys kept."""
    hit = F.col("has_alert") & F.col("attack_active")
    out = det.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("window_count"),
        F.count_if(F.col("attack_active")).alias("attack_windows"),
        F.count_if(hit).alias("detected_attack_windows"),
        F.count_if(F.col("is_ood")).alias("ood_windows"),
        F.count_if(F.col("has_alert")).alias("alert_windows"),
        F.count_if(F.col("has_alert") & ~F.col("attack_active")).alias("false_alert_windows"),
        F.avg("ood_score").alias("mean_ood_score"),
        F.max("ood_score").alias("peak_ood_score"),
    )
    return out.withColumn("detection_rate", _ratio(F.col("detected_attack_windows"), F.col("attack_windows")))


DETECTION_COUNTS = [
    "window_count", "attack_windows", "detected_attack_windows", "ood_windows", "alert_windows", "false_alert_windows",
]
DETECTION_VALUES = ["detection_rate", "mean_ood_score", "peak_ood_score"]


def dimension_metrics(records: DataFrame, det: DataFrame, keys: Sequence[str], entity: str) -> DataFrame:
    """Record and detection metrics per dimension; dimensions without detections show zeros."""
    rec = records.groupBy(*keys, entity).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("attack_active")).alias("attacks"),
        F.sum("total_energy_wh").alias("energy"),
        F.sum("battery_soc").alias("soc"),
        F.count("battery_soc").alias("soc_n"),
    )
    rec = rec.groupBy(*keys).agg(
        F.array_join(F.sort_array(F.collect_list(entity)), ", ").alias("uav_ids"),
        F.count(entity).alias("uav_count"),
        F.sum("n").alias("record_count"),
        F.sum("attacks").alias("attack_record_count"),
        F.sum("energy").alias("total_energy_wh"),
        F.try_divide(F.sum("soc"), F.sum("soc_n")).alias("mean_battery_soc"),
    )
    d = metrics_by_keys(det.where(F.col(entity).isNotNull()), keys)
    joined = match_keys(rec, d, keys)
    return joined.fillna(0, DETECTION_COUNTS).fillna(0.0, DETECTION_VALUES)


def external_subset(metrics: DataFrame) -> DataFrame:
    return metrics.where((F.col("simulation_role") == "external_ood") | (F.col("source_type") == "external_non_uav"))


def ood_comparison(det: DataFrame, entity: str) -> DataFrame:
    return det.where(F.col(entity).isNotNull()).groupBy(entity).agg(
        F.count_if(F.col("is_ood")).alias("ood_windows"),
        F.count_if(F.col("has_alert")).alias("alert_windows"),
        F.count_if(F.col("has_alert") & ~F.col("attack_active")).alias("false_alert_windows"),
        F.max("ood_score").alias("peak_ood_score"),
    )


# --- energy and phases ------------------------------------------------------------------
def energy_totals(records: DataFrame, entity: str, components: Sequence[str]) -> DataFrame:
    return records.groupBy(entity).agg(*[F.sum(c).alias(c) for c in components])


def energy_shares(records: DataFrame, components: dict[str, str]) -> DataFrame:
    row = records.agg(*[F.sum(c).alias(n) for n, c in components.items()])
    total = sum([F.col(n) for n in components], F.lit(0.0))
    items = F.array(*[F.struct(F.lit(n).alias("component"), F.col(n).alias("energy_wh")) for n in components])
    return row.withColumn("__t", total).select("__t", F.inline(items)).select(
        "component", "energy_wh", _ratio(F.col("energy_wh"), F.col("__t")).alias("share")
    )


def energy_report(records: DataFrame, ts_seconds: str, flight: str, comm: str, ids: str, total: str) -> DataFrame:
    """Joules, detection share and mean extra power of a run."""
    span = F.max(ts_seconds) - F.min(ts_seconds)
    row = records.agg(
        F.sum(flight).alias("f"), F.sum(comm).alias("c"), F.sum(ids).alias("i"), F.sum(total).alias("t"),
        F.when(span > 0, span).otherwise(F.count(F.lit(1)).cast("double")).alias("duration_s"),
    )
    whole = F.coalesce(
        F.col("t"), F.coalesce("f", F.lit(0.0)) + F.coalesce("c", F.lit(0.0)) + F.coalesce("i", F.lit(0.0))
    )
    return row.select(
        (F.col("f") * 3600).alias("total_flight_energy_j"),
        (F.col("c") * 3600).alias("total_communication_energy_j"),
        (F.col("i") * 3600).alias("total_ids_energy_j"),
        (whole * 3600).alias("total_energy_j"),
        _ratio(F.col("i"), whole, None).alias("ids_energy_ratio"),
        _ratio(F.col("i") * 3600, F.col("duration_s"), None).alias("extra_power_w"),
        "duration_s",
    )


def phase_durations(records: DataFrame, entity: str, phase: str, dt: float) -> DataFrame:
    out = records.groupBy(entity, phase).agg((F.count(F.lit(1)) * float(dt)).alias("duration_s"))
    return out.orderBy(entity_order(entity), phase_order(phase))


def detections_with_phase(
    records: DataFrame, det: DataFrame, entity: str, ts: str, order: str, columns: Sequence[str], buckets: int | None = None
) -> DataFrame:
    return asof_backward(det.where(F.col(entity).isNotNull()), records, entity, ts, order, columns, buckets)


def phase_false_positives(det_phase: DataFrame, phase: str) -> DataFrame:
    """False-positive rate for every phase, also those never seen."""
    benign = ~F.col("attack_active")
    agg = det_phase.groupBy(phase).agg(
        F.count_if(benign).alias("benign_windows"),
        F.count_if(F.col("has_alert") & benign).alias("false_positive_windows"),
    )
    spine = det_phase.sparkSession.createDataFrame([(p,) for p in fixed.PHASE_ORDER], f"{phase} string")
    full = spine.join(agg, phase, "left").fillna(0, ["benign_windows", "false_positive_windows"])
    return full.withColumn(
        "false_positive_rate", _ratio(F.col("false_positive_windows"), F.col("benign_windows"))
    ).orderBy(phase_order(phase))


# --- per-entity analysis -----------------------------------------------------------------
def entity_analysis(records: DataFrame, det: DataFrame, entity: str, order: Sequence[str]) -> DataFrame:
    """Last, mean, peak and total record values with the detection block."""
    rec = records.groupBy(entity).agg(
        F.max_by(F.struct("mission_phase", "battery_soc"), F.struct(*order)).alias("__last"),
        F.avg("rssi").alias("avg_rssi"),
        F.max("temperature").alias("peak_temperature"),
        F.count(F.lit(1)).alias("record_count"),
        F.sum("total_energy_wh").alias("total_energy_wh"),
        F.count_if(F.col("attack_active")).alias("attack_record_count"),
    ).select("*", F.col("__last.mission_phase").alias("current_phase"), F.col("__last.battery_soc").alias("battery_soc")).drop("__last")
    d = det.groupBy(entity).agg(
        F.count(F.lit(1)).alias("window_count"),
        F.count_if(F.col("is_ood")).alias("ood_windows"),
        F.count_if(F.col("known_attack_alert")).alias("known_attack_alert_windows"),
        F.count_if(F.col("has_alert")).alias("alert_windows"),
        F.count_if(F.col("known_attack_alert") & F.col("is_ood")).alias("dual_alert_windows"),
        F.count_if(F.col("has_alert") & ~F.col("attack_active")).alias("false_alert_windows"),
        F.avg("ood_score").alias("mean_ood_score"),
        F.max("ood_score").alias("peak_ood_score"),
    )
    counts = [c for c in d.columns if c.endswith("windows") or c == "window_count"]
    return match_keys(rec, d, [entity]).fillna(0, counts).fillna(0.0, ["mean_ood_score", "peak_ood_score"])


def fleet_status(
    records: DataFrame, det: DataFrame, entity: str, ts: str, record_order: str, window_order: str, at: int | float
) -> DataFrame:
    """Latest record and latest detection of every entity at one time, with defaults."""
    rec = records.where(F.col(ts) <= at).groupBy(entity).agg(
        F.max_by(F.struct("mission_phase", "battery_soc", "attack_active", "attack_type"), F.struct(ts, record_order)).alias("r")
    )
    d = det.where(F.col(ts) <= at).groupBy(entity).agg(
        F.max_by(
            F.struct("ood_score", "alert_level", "alert_reason", "known_attack_alert", "is_ood"), F.struct(ts, window_order)
        ).alias("d")
    )
    return match_keys(rec, d, [entity]).select(
        entity,
        F.coalesce("r.mission_phase", F.lit("n/a")).alias("mission_phase"),
        F.coalesce("r.battery_soc", F.lit(0.0)).alias("battery_soc"),
        F.coalesce("r.attack_active", F.lit(False)).alias("attack_active"),
        F.coalesce("r.attack_type", F.lit("benign")).alias("attack_type"),
        F.coalesce("d.ood_score", F.lit(0.0)).alias("ood_score"),
        F.coalesce("d.alert_level", F.lit("normal")).alias("alert_level"),
        F.coalesce("d.alert_reason", F.lit("none")).alias("alert_reason"),
        F.coalesce("d.known_attack_alert", F.lit(False)).alias("known_attack_alert"),
        F.coalesce("d.is_ood", F.lit(False)).alias("ood_alert"),
    )


# --- attack scenes --------------------------------------------------------------------------
def attack_scene(records: DataFrame, ts: str, entity: str, attack_type: str) -> DataFrame:
    """Active entities and attack names per timestamp; distinct pairs are formed before grouping."""
    active = records.where("attack_active")
    entities = active.select(ts, entity).distinct().groupBy(ts).agg(F.count(entity).alias("active_uav_count"))
    names = (
        active.select(ts, F.explode_outer(attack_tokens(F.col(attack_type))).alias("t")).distinct()
        .groupBy(ts).agg(F.sort_array(F.collect_list("t")).alias("__types"))
    )
    mixed = (F.col("active_uav_count") > 1) | (F.size("__types") > 1)
    return entities.join(names, ts).select(
        ts, "active_uav_count", F.array_join("__types", "+").alias("scene_attack_types"),
        F.when(mixed, "mixed_attack").otherwise("single_attack").alias("attack_scene_mode"),
    )


def detections_with_scene(det: DataFrame, scene: DataFrame, ts: str) -> DataFrame:
    out = match_keys(det, scene, [ts])
    mode = F.when(~F.col("attack_active"), "benign").otherwise(F.coalesce("attack_scene_mode", F.lit("single_attack")))
    return out.withColumns(
        {
            "active_uav_count": F.coalesce("active_uav_count", F.lit(0)),
            "scene_attack_types": F.coalesce("scene_attack_types", F.lit("")),
            "attack_scene_mode": mode,
        }
    )


def mode_summary(det_scene: DataFrame) -> DataFrame:
    """Detection by attack mode; both modes always present."""
    agg = det_scene.groupBy(F.col("attack_scene_mode").alias("attack_mode")).agg(
        F.count(F.lit(1)).alias("attack_windows"),
        F.count_if(F.col("has_alert")).alias("detected_windows"),
        F.avg("ood_score").alias("mean_ood_score"),
        F.max("ood_score").alias("peak_ood_score"),
        F.count_if(F.col("alert_level") == "critical").alias("critical_alerts"),
    )
    spine = det_scene.sparkSession.createDataFrame([(m,) for m in fixed.ATTACK_MODES], "attack_mode string")
    full = spine.join(agg, "attack_mode", "left").fillna(0)
    return full.withColumns(
        {
            "missed_windows": F.col("attack_windows") - F.col("detected_windows"),
            "detection_rate": _ratio(F.col("detected_windows"), F.col("attack_windows")),
        }
    )


def entity_detection_comparison(records: DataFrame, det: DataFrame, entity: str) -> DataFrame:
    spine = records.select(entity).distinct()
    d = metrics_by_keys(det, [entity]).select(
        entity, "attack_windows", F.col("detected_attack_windows").alias("detected_windows"), "false_alert_windows",
        "detection_rate", "mean_ood_score", "peak_ood_score",
    )
    return match_keys(spine, d, [entity]).fillna(0)


# --- diagnostics -------------------------------------------------------------------------------
QS = {"q50": 0.50, "q90": 0.90, "q95": 0.95, "q99": 0.99}


def entity_diagnostics(det: DataFrame, entity: str, part: str = "window_partition", buckets: int | None = None) -> DataFrame:
    """Partition counts, score means, separation, direction warning, quantiles and rates."""
    is_part = {p: F.col(part) == p for p in ("benign", "attack", "ood")}
    mean = lambda p: F.avg(F.when(is_part[p], F.col("ood_score")))
    agg = det.groupBy(entity).agg(
        F.count(F.lit(1)).alias("window_count"),
        *[F.count_if(c).alias(f"{p}_windows") for p, c in is_part.items()],
        F.count_if(F.col("has_alert")).alias("alert_windows"),
        F.count_if(F.col("is_ood")).alias("ood_alert_windows"),
        F.count_if(F.col("false_alert")).alias("false_alert_windows"),
        F.avg("threshold").alias("threshold"),
        *[mean(p).alias(f"{p}_score_mean") for p in is_part],
        F.max("ood_score").alias("peak_ood_score"),
    )
    sep = F.col("attack_score_mean") - F.col("benign_score_mean")
    out = agg.withColumns(
        {
            "score_separation": sep,
            "direction_warning": F.coalesce(sep < 0, F.lit(False)),
            "alert_rate": _ratio(F.col("alert_windows"), F.col("window_count")),
            "false_alert_rate": _ratio(F.col("false_alert_windows"), F.col("benign_windows")),
        }
    )
    values = {
        "raw": F.col("raw_ood_score"),
        "normalized": F.col("ood_score"),
        "benign": F.when(is_part["benign"], F.col("raw_ood_score")),
    }
    return match_keys(out, wide_quantiles(det, [entity], values, QS, buckets=buckets), [entity])


def fleet_diagnostics(diag: DataFrame, source_type: str) -> DataFrame:
    """Roll-up of the entity diagnostics and false-alert rates by source class."""
    ext = F.col(source_type) == "external_non_uav"
    own = F.coalesce(~ext, F.lit(True))
    rate = lambda c: _ratio(
        F.sum(F.when(c, F.col("false_alert_windows"))), F.sum(F.when(c, F.col("benign_windows"))), None
    )
    cols = ["window_count", "benign_windows", "attack_windows", "ood_windows", "alert_windows", "false_alert_windows"]
    return diag.agg(
        *[F.sum(c).alias(c) for c in cols],
        rate(own).alias("uav_only_false_alert_rate"),
        rate(ext).alias("external_false_alert_rate"),
    )


def direction_check(det: DataFrame, entity: str, truth: str, fallback: str) -> DataFrame:
    """Observed AUROC overall (entity NULL) and per entity; the truth column has a fallback."""
    any_truth = det.agg(F.max(F.col(truth).isNotNull()).alias("t")).first()["t"]
    label = truth if any_truth else fallback
    d = det.select(entity, F.col(label).cast("int").alias("y"), "ood_score").where(F.col("y").isNotNull())
    overall = auroc(d, [], "ood_score", "y").select(F.lit("__all__").alias(entity), "auroc")
    rows = overall.unionByName(auroc(d, [entity], "ood_score", "y").withColumn(entity, F.col(entity).cast("string")))
    flip = F.coalesce(F.col("auroc") < 0.5, F.lit(False))
    return rows.withColumns(
        {
            "flip_suspected": flip,
            "effective_auroc": F.when(flip, 1 - F.col("auroc")).otherwise(F.col("auroc")),
            "label_source": F.lit(label),
        }
    )


def run_summary(records: DataFrame, det: DataFrame, entity: str) -> DataFrame:
    r = records.agg(
        F.count_distinct(entity).alias("uav_count"),
        F.count(F.lit(1)).alias("record_count"),
        F.count_if(F.col("attack_active")).alias("attack_record_count"),
        F.avg("rssi").alias("mean_rssi"),
        F.max("temperature").alias("peak_temperature"),
        F.sum("total_energy_wh").alias("total_energy_wh"),
        F.sum("detection_energy_wh").alias("ids_energy_wh"),
    )
    d = det.agg(
        F.count(F.lit(1)).alias("window_count"),
        F.count_if(F.col("has_alert")).alias("alert_count"),
        F.count_if(F.col("has_alert") & ~F.col("attack_active")).alias("false_alert_count"),
        F.max("ood_score").alias("peak_ood_score"),
    )
    return r.join(F.broadcast(d)).withColumns(
        {
            "energy_per_window_wh": _ratio(F.col("ids_energy_wh"), F.col("window_count")),
            "ids_energy_ratio": _ratio(F.col("ids_energy_wh"), F.col("total_energy_wh")),
        }
    )


def input_drift(df: DataFrame, group: str, features: Sequence[str]) -> DataFrame:
    """Missing ratio, zero ratio, mean and std of serving inputs from running sums."""
    n = len(features)
    row = {c: F.coalesce(F.col(c), F.lit(0.0)) for c in features}
    missing = sum((F.col(c).isNull().cast("long") for c in features), F.lit(0))
    zero = sum(((v == 0).cast("long") for v in row.values()), F.lit(0))
    s1 = sum(row.values(), F.lit(0.0))
    s2 = sum((v * v for v in row.values()), F.lit(0.0))
    agg = df.groupBy(group).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(missing).alias("m"), F.sum(zero).alias("z"), F.sum(s1).alias("s1"),
        F.sum(s2).alias("s2"),
    )
    cells = F.col("rows") * n
    mean = F.col("s1") / cells
    return agg.select(
        group, "rows", (F.col("m") / cells).alias("missing_ratio"), (F.col("z") / cells).alias("zero_ratio"),
        mean.alias("mean"), F.sqrt(F.greatest(F.col("s2") / cells - mean * mean, F.lit(0.0))).alias("std"),
    )


def score_diagnostics(
    df: DataFrame, group: str, raw: str, normalized: str, warmup: Column, error: Column, buckets: int | None = None
) -> DataFrame:
    """Score quantiles per group, unique scores and error counts."""
    base = df.groupBy(group).agg(F.count(F.lit(1)).alias("windows"), F.count_if(error).alias("errors"))
    uniq = df.select(group, F.round(normalized, 8).alias("s")).distinct().groupBy(group).agg(F.count("s").alias("unique_scores"))
    out = match_keys(base, uniq, [group])
    values = {"raw": F.col(raw), "normalized": F.col(normalized), "warmup": F.when(warmup, F.col(raw))}
    return match_keys(out, wide_quantiles(df, [group], values, QS, buckets=buckets), [group])


def raw_row_counts(det: DataFrame, entity: str) -> DataFrame:
    alert = F.col("is_ood") | F.col("alert_level").isin("warning", "critical")
    return det.groupBy(entity).agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.count_if(F.col("attack_active")).alias("attack_count"),
        F.count_if(alert).alias("alert_count"),
        F.count_if(alert & ~F.col("attack_active")).alias("false_alert_count"),
    )


def alert_delays(alerts: DataFrame, schedule: DataFrame, key: str, ts: str, start: str, end: str, event: str) -> DataFrame:
    """First alert of each scheduled attack and the mean delay; unanswered attacks are counted apart."""
    hits = interval_join(alerts.select(key, ts), schedule, key, ts, start, end, "inner")
    first = hits.groupBy(event).agg(F.min(F.col(ts) - F.col(start)).alias("delay"))
    return schedule.select(event).join(first, event, "left").agg(
        F.count(F.lit(1)).alias("attacks"),
        F.count("delay").alias("answered"),
        F.count_if(F.col("delay").isNull()).alias("unanswered"),
        F.avg("delay").alias("mean_delay"),
    )
