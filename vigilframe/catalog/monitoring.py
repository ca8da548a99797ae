"""Fleet-monitoring queries on telemetry and detections derived from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.catalog.registry import query
from vigilframe.catalog.views import DET, REC, detections, r6, records
from vigilframe.functions import fixed
from vigilframe.operators import joins as J
from vigilframe.operators import monitor as M

UAVS = [r[0] for r in fixed.REGISTRY_ROWS]
_UAV_SQL = "[" + ", ".join(f"'{u}'" for u in UAVS) + "][grp % 6 + 1]"
_PHASE_SQL = "[" + ", ".join(f"'{p}'" for p in fixed.PHASE_ORDER) + "][CAST(k AS BIGINT) % 7 + 1]"

TEL = f"""tel AS (
  SELECT record_id, ts_us, CAST(floor(ts_us / 3600000000.0) AS BIGINT) AS hour, grp, {_UAV_SQL} AS uav_id,
    {_PHASE_SQL} AS mission_phase, k AS battery_soc, -value AS rssi, value AS temperature, label,
    label <> 'view' AS attack_active,
    CASE WHEN label = 'view' THEN 'benign' WHEN label = 'click' THEN 'click+Scan' ELSE label END AS attack_type,
    value / 10 AS flight_energy_wh, k / 10 AS communication_energy_wh, 0.5 AS detection_energy_wh,
    value / 10 + k / 10 + 0.5 AS total_energy_wh FROM rec)"""
DT = DET + ", " + TEL + f""",
dt AS (SELECT det.*, {_UAV_SQL} AS uav_id, has_alert AND NOT attack_active AS false_alert,
  CASE WHEN truth_ood THEN 'ood' WHEN attack_active THEN 'attack' ELSE 'benign' END AS window_partition,
  CASE WHEN known_attack_alert AND is_ood THEN 'known_attack+ood' WHEN known_attack_alert THEN 'known_attack'
       WHEN is_ood THEN 'ood' ELSE 'none' END AS alert_reason FROM det)"""
REG = "reg AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, '{r[0]}', '{r[1]}', '{r[2]}', '{r[3]}', '{r[4]}', '{r[5]}')" for i, r in enumerate(fixed.REGISTRY_ROWS)
) + ") t(uav_order, uav_id, dataset_name, dataset_display, dataset_role, source_type, simulation_role))"


def _uav():
    return F.element_at(F.array(*[F.lit(u) for u in UAVS]), (F.col("grp") % 6 + 1).cast("int"))


def telemetry(spark, sf):
    r = records(spark, sf)
    phase = F.element_at(F.array(*[F.lit(p) for p in fixed.PHASE_ORDER]), (F.col("k").cast("long") % 7 + 1).cast("int"))
    return r.select(
        "record_id",
        "ts_us",
        F.floor(F.col("ts_us") / 3600000000).cast("long").alias("hour"),
        "grp",
        _uav().alias("uav_id"),
        phase.alias("mission_phase"),
        F.col("k").alias("battery_soc"),
        (-F.col("value")).alias("rssi"),
        F.col("value").alias("temperature"),
        "label",
        (F.col("label") != "view").alias("attack_active"),
        F.when(F.col("label") == "view", "benign").when(F.col("label") == "click", "click+Scan").otherwise(F.col("label")).alias(
            "attack_type"
        ),
        (F.col("value") / 10).alias("flight_energy_wh"),
        (F.col("k") / 10).alias("communication_energy_wh"),
        F.lit(0.5).alias("detection_energy_wh"),
        (F.col("value") / 10 + F.col("k") / 10 + 0.5).alias("total_energy_wh"),
    )


def uav_detections(spark, sf):
    from vigilframe.functions import scores as S

    d = detections(spark, sf)
    return d.withColumns(
        {
            "uav_id": _uav(),
            "false_alert": F.col("has_alert") & ~F.col("attack_active"),
            "window_partition": S.window_partition(F.col("truth_ood"), F.col("attack_active")),
            "alert_reason": S.alert_reason(F.col("known_attack_alert"), F.col("is_ood")),
            "threshold_source": F.lit("global"),
        }
    )


def _r(df, *names):
    return df.withColumns({n: r6(n) for n in names})


# --- joins ---------------------------------------------------------------------------
_ASOF = DT + """,
ph AS (SELECT d.window_id, d.grp, d.ts_us, d.has_alert, d.attack_active, t.mission_phase, t.battery_soc
  FROM (SELECT * FROM dt WHERE label IN ('error', 'view')) d ASOF LEFT JOIN
       (SELECT grp, ts_us, arg_max(mission_phase, record_id) AS mission_phase, arg_max(battery_soc, record_id) AS battery_soc
        FROM tel WHERE label NOT IN ('error', 'view') GROUP BY ALL) t ON d.grp = t.grp AND d.ts_us >= t.ts_us)"""


def _asof(spark, sf):
    d = uav_detections(spark, sf).where(F.col("label").isin("error", "view")).select(
        "window_id", "grp", "ts_us", "has_alert", "attack_active"
    )
    t = telemetry(spark, sf).where(~F.col("label").isin("error", "view"))
    return M.detections_with_phase(t, d, "grp", "ts_us", "record_id", ["mission_phase", "battery_soc"])


@query("j01_asof_phase", f"WITH {_ASOF} SELECT window_id, mission_phase, battery_soc FROM ph")
def asof_phase(spark, sf):
    return _asof(spark, sf).select("window_id", "mission_phase", "battery_soc")


@query(
    "a35_phase_false_positives",
    f"""WITH {_ASOF}, p AS (SELECT unnest([{", ".join(f"'{p}'" for p in fixed.PHASE_ORDER)}]) AS mission_phase),
    c AS (SELECT mission_phase, count(*) FILTER (NOT attack_active) AS b, count(*) FILTER (has_alert AND NOT attack_active) AS f
      FROM ph GROUP BY 1)
    SELECT p.mission_phase, coalesce(b, 0) AS benign_windows, coalesce(f, 0) AS false_positive_windows,
      round(CASE WHEN b > 0 THEN f / b ELSE 0.0 END, 6) AS false_positive_rate FROM p LEFT JOIN c ON p.mission_phase = c.mission_phase""",
)
def phase_false_positives(spark, sf):
    return _r(M.phase_false_positives(_asof(spark, sf), "mission_phase"), "false_positive_rate")


_SCENE = DT + """,
tok AS (SELECT hour, uav_id, unnest(CASE WHEN attack_type = 'click+Scan' THEN ['click', 'scan'] ELSE [attack_type] END) AS t
  FROM tel WHERE attack_active),
scene AS (SELECT hour, count(DISTINCT uav_id) AS active_uav_count, string_agg(DISTINCT t, '+' ORDER BY t) AS scene_attack_types,
  CASE WHEN count(DISTINCT uav_id) > 1 OR count(DISTINCT t) > 1 THEN 'mixed_attack' ELSE 'single_attack' END AS attack_scene_mode
  FROM tok GROUP BY hour),
ds AS (SELECT dt.*, coalesce(active_uav_count, 0) AS active_uav_count, coalesce(scene_attack_types, '') AS scene_attack_types,
  CASE WHEN NOT attack_active THEN 'benign' ELSE coalesce(attack_scene_mode, 'single_attack') END AS attack_scene_mode
  FROM dt LEFT JOIN scene ON dt.hour = scene.hour)"""


@query("a39_attack_scene", f"WITH {_SCENE} SELECT * FROM scene")
def attack_scene(spark, sf):
    return M.attack_scene(telemetry(spark, sf), "hour", "uav_id", "attack_type")


def _scene_det(spark, sf):
    scene = M.attack_scene(telemetry(spark, sf), "hour", "uav_id", "attack_type")
    return M.detections_with_scene(uav_detections(spark, sf), scene, "hour")


@query(
    "j02_detections_with_scene",
    f"WITH {_SCENE} SELECT window_id, active_uav_count, scene_attack_types, attack_scene_mode FROM ds",
)
def detections_with_scene(spark, sf):
    return _scene_det(spark, sf).select("window_id", "active_uav_count", "scene_attack_types", "attack_scene_mode")


@query(
    "a40_mode_summary",
    f"""WITH {_SCENE}, m AS (SELECT unnest(['single_attack', 'mixed_attack']) AS attack_mode),
    c AS (SELECT attack_scene_mode, count(*) AS a, count(*) FILTER (has_alert) AS d, avg(ood_score) AS m, max(ood_score) AS p,
      count(*) FILTER (alert_level = 'critical') AS c FROM ds GROUP BY 1)
    SELECT attack_mode, coalesce(a, 0) AS attack_windows, coalesce(d, 0) AS detected_windows, coalesce(a - d, 0) AS missed_windows,
      round(coalesce(d / a, 0.0), 6) AS detection_rate, round(coalesce(m, 0.0), 6) AS mean_ood_score,
      coalesce(p, 0.0) AS peak_ood_score, coalesce(c, 0) AS critical_alerts FROM m LEFT JOIN c ON attack_mode = attack_scene_mode""",
)
def mode_summary(spark, sf):
    return _r(M.mode_summary(_scene_det(spark, sf)), "detection_rate", "mean_ood_score")


_KEYS = """count(*) AS window_count, count(*) FILTER (attack_active) AS attack_windows,
  count(*) FILTER (has_alert AND attack_active) AS detected_attack_windows, count(*) FILTER (is_ood) AS ood_windows,
  count(*) FILTER (has_alert) AS alert_windows, count(*) FILTER (has_alert AND NOT attack_active) AS false_alert_windows,
  round(avg(ood_score), 6) AS mean_ood_score, max(ood_score) AS peak_ood_score,
  round(CASE WHEN count(*) FILTER (attack_active) > 0 THEN count(*) FILTER (has_alert AND attack_active)
    / count(*) FILTER (attack_active) ELSE 0.0 END, 6) AS detection_rate"""


@query(
    "a37_metrics_by_keys",
    f"""WITH {DT} SELECT CASE WHEN uav_id = 'uav_03' THEN NULL ELSE uav_id END AS uav_id, alert_level, {_KEYS} FROM dt
    GROUP BY 1, 2""",
)
def metrics_by_keys(spark, sf):
    d = uav_detections(spark, sf).withColumn("uav_id", F.when(F.col("uav_id") != "uav_03", F.col("uav_id")))
    return _r(M.metrics_by_keys(d, ["uav_id", "alert_level"]), "mean_ood_score", "detection_rate")


@query(
    "a41_entity_detection_comparison",
    f"""WITH {DT}, m AS (SELECT uav_id, {_KEYS} FROM dt WHERE label <> 'purchase' AND uav_id <> 'uav_07' GROUP BY 1)
    SELECT s.uav_id, coalesce(attack_windows, 0) AS attack_windows, coalesce(detected_attack_windows, 0) AS detected_windows,
      coalesce(false_alert_windows, 0) AS false_alert_windows, coalesce(detection_rate, 0.0) AS detection_rate,
      coalesce(mean_ood_score, 0.0) AS mean_ood_score, coalesce(peak_ood_score, 0.0) AS peak_ood_score
    FROM (SELECT DISTINCT uav_id FROM tel) s LEFT JOIN m ON s.uav_id = m.uav_id""",
)
def entity_detection_comparison(spark, sf):
    d = uav_detections(spark, sf).where((F.col("label") != "purchase") & (F.col("uav_id") != "uav_07"))
    return _r(
        M.entity_detection_comparison(telemetry(spark, sf), d, "uav_id"), "detection_rate", "mean_ood_score"
    )


_DIM = f"""WITH {DT}, {REG}, r AS (SELECT tel.*, dataset_name, dataset_display, source_type, simulation_role FROM tel JOIN reg
      ON tel.uav_id = reg.uav_id),
    d AS (SELECT dt.*, dataset_name, source_type, simulation_role FROM dt JOIN reg ON dt.uav_id = reg.uav_id
      WHERE dt.uav_id <> 'uav_02')"""


def _dim_sql(keys: str, where: str = "") -> str:
    on = " AND ".join(f"a.{k} = b.{k}" for k in keys.split(", "))
    sel = ", ".join(f"a.{k}" for k in keys.split(", "))
    counts = ", ".join(f"coalesce(b.{c}, 0) AS {c}" for c in [*M.DETECTION_COUNTS, *M.DETECTION_VALUES])
    return f"""{_DIM}, a AS (SELECT {keys}, string_agg(DISTINCT uav_id, ', ' ORDER BY uav_id) AS uav_ids,
      count(DISTINCT uav_id) AS uav_count, count(*) AS record_count, count(*) FILTER (attack_active) AS attack_record_count,
      round(sum(total_energy_wh), 4) AS total_energy_wh, round(avg(battery_soc), 6) AS mean_battery_soc FROM r GROUP BY ALL),
    b AS (SELECT {keys}, {_KEYS} FROM d GROUP BY ALL)
    SELECT {sel}, uav_ids, uav_count, record_count, attack_record_count, total_energy_wh, mean_battery_soc, {counts}
    FROM a LEFT JOIN b ON {on} {where}"""


def _dimension(spark, sf, keys):
    r = J.attach_entity(telemetry(spark, sf), "uav_id")
    d = J.attach_entity(uav_detections(spark, sf).where(F.col("uav_id") != "uav_02"), "uav_id")
    m = M.dimension_metrics(r, d, keys, "uav_id")
    m = m.withColumn("total_energy_wh", F.round("total_energy_wh", 4))
    return _r(m, "mean_battery_soc", "mean_ood_score", "detection_rate")


@query("a38_metrics_by_dataset", _dim_sql("dataset_name, source_type, simulation_role"))
def metrics_by_dataset(spark, sf):
    return _dimension(spark, sf, ["dataset_name", "source_type", "simulation_role"])


@query("a38_metrics_by_source_type", _dim_sql("source_type, simulation_role"))
def metrics_by_source_type(spark, sf):
    return _dimension(spark, sf, ["source_type", "simulation_role"])


@query(
    "a38_external_metrics",
    _dim_sql("dataset_name, source_type, simulation_role", "WHERE a.simulation_role = 'external_ood' OR a.source_type = 'external_non_uav'"),
)
def external_metrics(spark, sf):
    return M.external_subset(_dimension(spark, sf, ["dataset_name", "source_type", "simulation_role"]))


@query(
    "j03_null_safe_metric_join",
    f"""WITH {DT}, a AS (SELECT CASE WHEN mission_phase = 'idle' THEN NULL ELSE mission_phase END AS phase, uav_id, count(*) AS
      records FROM tel GROUP BY ALL),
    b AS (SELECT CASE WHEN mission_phase = 'idle' THEN NULL ELSE mission_phase END AS phase, tel.uav_id, count(*) AS windows FROM dt
      JOIN tel ON window_id = record_id WHERE is_ood GROUP BY ALL)
    SELECT a.phase, a.uav_id, records, coalesce(windows, 0) AS windows FROM a LEFT JOIN b
      ON a.phase IS NOT DISTINCT FROM b.phase AND a.uav_id = b.uav_id""",
)
def null_safe_metric_join(spark, sf):
    from vigilframe.operators.ordering import match_keys

    phase = F.when(F.col("mission_phase") != "idle", F.col("mission_phase")).alias("phase")
    t = telemetry(spark, sf)
    a = t.groupBy(phase, "uav_id").agg(F.count(F.lit(1)).alias("records"))
    hit = uav_detections(spark, sf).where("is_ood").select(F.col("window_id").alias("record_id"))
    b = t.join(hit, "record_id").groupBy(phase, "uav_id").agg(F.count(F.lit(1)).alias("windows"))
    return match_keys(a, b, ["phase", "uav_id"]).fillna(0, ["windows"])


@query(
    "j04_registry_lookup",
    f"""WITH {REC}, {REG}, t AS (SELECT record_id, {_UAV_SQL} AS u FROM rec)
    SELECT record_id, reg.dataset_display, dataset_role, dataset_name AS by_alias FROM t JOIN reg ON t.u = reg.uav_id""",
)
def registry_lookup(spark, sf):
    t = telemetry(spark, sf).select("record_id", "uav_id")
    known = J.attach_entity(t, "uav_id").withColumn("cell", F.upper(F.regexp_replace("dataset_display", "-", " ")))
    return J.canonical_dataset(known, "cell", "by_alias").select("record_id", "dataset_display", "dataset_role", "by_alias")


_NOW = 1705276800000000


@query(
    "j09_fleet_status",
    f"""WITH {DT}, r AS (SELECT * FROM tel WHERE ts_us <= {_NOW} QUALIFY row_number() OVER (PARTITION BY grp ORDER BY ts_us DESC,
      record_id DESC) = 1),
    d AS (SELECT * FROM dt WHERE ts_us <= {_NOW} AND label IN ('error', 'click') QUALIFY row_number() OVER (PARTITION BY grp
      ORDER BY ts_us DESC, window_id DESC) = 1)
    SELECT r.grp, mission_phase, battery_soc, r.attack_active, attack_type, coalesce(ood_score, 0.0) AS ood_score,
      coalesce(alert_level, 'normal') AS alert_level, coalesce(alert_reason, 'none') AS alert_reason,
      coalesce(known_attack_alert, false) AS known_attack_alert, coalesce(is_ood, false) AS ood_alert
    FROM r LEFT JOIN d ON r.grp = d.grp""",
)
def fleet_status(spark, sf):
    d = uav_detections(spark, sf).where(F.col("label").isin("error", "click"))
    return M.fleet_status(telemetry(spark, sf), d, "grp", "ts_us", "record_id", "window_id", _NOW)


_DAY = 86400000000
_SCHED = REC + f""",
sch AS (SELECT 'g' || grp || '_' || i AS plan_id, grp, 1704067200000000 + (grp % 7 + i * 9) * {_DAY} AS start_us,
  1704067200000000 + (grp % 7 + i * 9 + 2 + grp % 3) * {_DAY} AS end_us,
  CASE i WHEN 0 THEN 'replay' WHEN 1 THEN 'flood' ELSE 'scan' END AS attack FROM (SELECT DISTINCT grp FROM rec), range(3) t(i))"""


def schedule(spark, sf):
    """Three attack intervals per entity, derived from the entities present."""
    i = F.explode(F.sequence(F.lit(0), F.lit(2)).cast("array<long>")).alias("i")
    g = records(spark, sf).select("grp").distinct().select("grp", i)
    base = F.lit(1704067200000000).cast("long")
    day = F.lit(_DAY).cast("long")
    return g.select(
        F.concat(F.lit("g"), F.col("grp"), F.lit("_"), F.col("i")).alias("plan_id"),
        "grp",
        (base + (F.col("grp") % 7 + F.col("i") * 9) * day).alias("start_us"),
        (base + (F.col("grp") % 7 + F.col("i") * 9 + 2 + F.col("grp") % 3) * day).alias("end_us"),
        F.when(F.col("i") == 0, "replay").when(F.col("i") == 1, "flood").otherwise("scan").alias("attack"),
    )


_INTERVAL = f"""WITH {_SCHED} SELECT record_id, rec.grp, plan_id, coalesce(attack, 'benign') AS attack FROM rec LEFT JOIN sch
    ON rec.grp = sch.grp AND ts_us >= start_us AND ts_us < end_us"""


@query("j14_interval_labels", _INTERVAL)
def interval_labels(spark, sf):
    out = J.interval_join(records(spark, sf), schedule(spark, sf), "grp", "ts_us", "start_us", "end_us")
    return out.select("record_id", "grp", "plan_id", F.coalesce("attack", F.lit("benign")).alias("attack"))


@query("j14_interval_labels_bucketed", _INTERVAL)
def interval_labels_bucketed(spark, sf):
    out = J.interval_join(
        records(spark, sf), schedule(spark, sf), "grp", "ts_us", "start_us", "end_us", bucket_width=float(_DAY)
    )
    return out.select("record_id", "grp", "plan_id", F.coalesce("attack", F.lit("benign")).alias("attack"))


@query(
    "a58_alert_delay",
    f"""WITH {_SCHED}, al AS (SELECT grp, ts_us FROM rec WHERE label = 'error'),
    f AS (SELECT plan_id, min(al.ts_us - start_us) AS delay FROM sch JOIN al ON al.grp = sch.grp AND ts_us >= start_us
      AND ts_us < end_us GROUP BY 1)
    SELECT count(*) AS attacks, count(delay) AS answered, count(*) - count(delay) AS unanswered,
      round(avg(delay) / 1e6, 3) AS mean_delay FROM sch LEFT JOIN f ON sch.plan_id = f.plan_id""",
)
def alert_delay(spark, sf):
    alerts = records(spark, sf).where(F.col("label") == "error")
    d = M.alert_delays(alerts, schedule(spark, sf), "grp", "ts_us", "start_us", "end_us", "plan_id")
    return d.withColumn("mean_delay", F.round(F.col("mean_delay") / 1e6, 3))


# --- summaries -------------------------------------------------------------------------
@query(
    "a28_detection_summary",
    f"""WITH {DT}, g AS (SELECT *, CASE WHEN uav_id = 'uav_06' THEN '__ungrouped__' ELSE uav_id END AS gid,
      CASE WHEN uav_id IN ('uav_01', 'uav_02') THEN 0.9 ELSE 0.5 + k / 100 END AS thr FROM dt),
    s AS (SELECT gid, count(*) AS windows, count(*) FILTER (is_ood) AS ood_alerts, round(avg(is_ood::INT), 6) AS alert_rate,
      round(avg(ood_score), 6) AS mean_ood_score, max(ood_score) AS max_ood_score,
      round(CASE WHEN max(thr) - min(thr) < 1e-9 THEN min(thr) ELSE avg(thr) END, 6) AS threshold, 'global' AS threshold_source,
      round(avg(thr), 6) AS mean_ood_threshold FROM g GROUP BY GROUPING SETS ((gid), ())),
    t AS (SELECT gid, string_agg(CAST(window_id AS VARCHAR), ',' ORDER BY rn) AS top_window_ids FROM (SELECT gid, window_id,
      row_number() OVER (PARTITION BY gid ORDER BY ood_score DESC, window_id) AS rn FROM g) WHERE rn <= 10 GROUP BY gid)
    SELECT coalesce(s.gid, '__global__') AS group_id, s.* EXCLUDE (gid), top_window_ids FROM s LEFT JOIN t ON s.gid = t.gid""",
)
def detection_summary(spark, sf):
    d = uav_detections(spark, sf).withColumns(
        {
            "gid": F.when(F.col("uav_id") != "uav_06", F.col("uav_id")),
            "threshold": F.when(F.col("uav_id").isin("uav_01", "uav_02"), 0.9).otherwise(F.col("k") / 100 + 0.5),
        }
    )
    s = M.detection_summary(d, "gid", "window_id")
    s = s.withColumn("top_window_ids", F.array_join(F.transform("top_window_ids", lambda x: x.cast("string")), ","))
    return _r(s, "alert_rate", "mean_ood_score", "threshold", "mean_ood_threshold")


@query(
    "a32_energy_totals",
    f"""WITH {REC}, {TEL} SELECT uav_id, round(sum(flight_energy_wh), 4) AS flight_energy_wh,
      round(sum(communication_energy_wh), 4) AS communication_energy_wh, round(sum(total_energy_wh), 4) AS total_energy_wh
    FROM tel GROUP BY 1""",
)
def energy_totals(spark, sf):
    cols = ["flight_energy_wh", "communication_energy_wh", "total_energy_wh"]
    e = M.energy_totals(telemetry(spark, sf), "uav_id", cols)
    return e.withColumns({c: F.round(c, 4) for c in cols})


@query(
    "a32_energy_shares",
    f"""WITH {REC}, {TEL}, s AS (SELECT sum(flight_energy_wh) AS f, sum(communication_energy_wh) AS c, sum(detection_energy_wh) AS d
      FROM tel)
    SELECT 'Flight' AS component, round(f, 4) AS energy_wh, round(f / (f + c + d), 6) AS share FROM s
    UNION ALL SELECT 'Communication', round(c, 4), round(c / (f + c + d), 6) FROM s
    UNION ALL SELECT 'Detection', round(d, 4), round(d / (f + c + d), 6) FROM s""",
)
def energy_shares(spark, sf):
    s = M.energy_shares(
        telemetry(spark, sf),
        {"Flight": "flight_energy_wh", "Communication": "communication_energy_wh", "Detection": "detection_energy_wh"},
    )
    return _r(s, "share").withColumn("energy_wh", F.round("energy_wh", 4))


@query(
    "a32_energy_report",
    f"""WITH {REC}, {TEL}, s AS (SELECT sum(flight_energy_wh) AS f, sum(communication_energy_wh) AS c, sum(detection_energy_wh) AS d,
      sum(total_energy_wh) AS t, (max(ts_us) - min(ts_us)) / 1e6 AS span FROM tel)
    SELECT round(f * 3600, 2) AS total_flight_energy_j, round(c * 3600, 2) AS total_communication_energy_j,
      round(d * 3600, 2) AS total_ids_energy_j, round(t * 3600, 2) AS total_energy_j, round(d / t, 6) AS ids_energy_ratio,
      round(d * 3600 / span, 6) AS extra_power_w, round(span, 3) AS duration_s FROM s""",
)
def energy_report(spark, sf):
    t = telemetry(spark, sf).withColumn("ts", F.col("ts_us") / 1e6)
    e = M.energy_report(t, "ts", "flight_energy_wh", "communication_energy_wh", "detection_energy_wh", "total_energy_wh")
    joules = [c for c in e.columns if c.endswith("_j")]
    return _r(e, "ids_energy_ratio", "extra_power_w").withColumns(
        {**{c: F.round(c, 2) for c in joules}, "duration_s": F.round("duration_s", 3)}
    )


@query(
    "a33_phase_durations",
    f"WITH {REC}, {TEL} SELECT uav_id, mission_phase, count(*) * 0.5 AS duration_s FROM tel GROUP BY ALL",
)
def phase_durations(spark, sf):
    return M.phase_durations(telemetry(spark, sf), "uav_id", "mission_phase", 0.5)


@query(
    "t04_business_order",
    f"""WITH {REC}, {TEL}, c AS (SELECT uav_id, mission_phase, count(*) AS n FROM tel GROUP BY ALL)
    SELECT uav_id, mission_phase, n, CAST(row_number() OVER (ORDER BY uav_id, list_position([{", ".join(f"'{p}'" for p in
      fixed.PHASE_ORDER)}], mission_phase)) AS BIGINT) AS display_rank FROM c""",
)
def business_order(spark, sf):
    from vigilframe.operators.ordering import position

    c = telemetry(spark, sf).groupBy("uav_id", "mission_phase").agg(F.count(F.lit(1)).alias("n"))
    keyed = c.withColumns({"eo": J.entity_order("uav_id"), "po": J.phase_order("mission_phase")})
    out = position(keyed, [], ["eo", "po"], "display_rank").withColumn("display_rank", F.col("display_rank") + 1)
    return out.drop("eo", "po")


@query(
    "a34_entity_analysis",
    f"""WITH {DT}, r AS (SELECT uav_id, arg_max(mission_phase, struct_pack(a := ts_us, b := record_id)) AS current_phase,
      arg_max(battery_soc, struct_pack(a := ts_us, b := record_id)) AS battery_soc, round(avg(rssi), 6) AS avg_rssi,
      max(temperature) AS peak_temperature, count(*) AS record_count, round(sum(total_energy_wh), 4) AS total_energy_wh,
      count(*) FILTER (attack_active) AS attack_record_count FROM tel GROUP BY 1),
    d AS (SELECT uav_id, count(*) AS window_count, count(*) FILTER (is_ood) AS ood_windows, count(*) FILTER (known_attack_alert) AS
      known_attack_alert_windows, count(*) FILTER (has_alert) AS alert_windows, count(*) FILTER (known_attack_alert AND is_ood) AS
      dual_alert_windows, count(*) FILTER (has_alert AND NOT attack_active) AS false_alert_windows, round(avg(ood_score), 6) AS
      mean_ood_score, max(ood_score) AS peak_ood_score FROM dt GROUP BY 1)
    SELECT r.*, d.* EXCLUDE (uav_id) FROM r JOIN d ON r.uav_id = d.uav_id""",
)
def entity_analysis(spark, sf):
    a = M.entity_analysis(telemetry(spark, sf), uav_detections(spark, sf), "uav_id", ["ts_us", "record_id"])
    return _r(a, "avg_rssi", "mean_ood_score").withColumn("total_energy_wh", F.round("total_energy_wh", 4))


@query(
    "a36_ood_comparison",
    f"""WITH {DT} SELECT uav_id, count(*) FILTER (is_ood) AS ood_windows, count(*) FILTER (has_alert) AS alert_windows,
      count(*) FILTER (has_alert AND NOT attack_active) AS false_alert_windows, max(ood_score) AS peak_ood_score FROM dt GROUP BY 1""",
)
def ood_comparison(spark, sf):
    return M.ood_comparison(uav_detections(spark, sf), "uav_id")


def _q_sql(col: str, name: str, where: str = "") -> str:
    f = f" FILTER ({where})" if where else ""
    return ", ".join(f"round(quantile_cont({col}, {p}){f}, 6) AS {name}_{k}" for k, p in M.QS.items())


_DIAG = f"""diag AS (SELECT grp, count(*) AS window_count, count(*) FILTER (window_partition = 'benign') AS benign_windows,
  count(*) FILTER (window_partition = 'attack') AS attack_windows, count(*) FILTER (window_partition = 'ood') AS ood_windows,
  count(*) FILTER (has_alert) AS alert_windows, count(*) FILTER (is_ood) AS ood_alert_windows,
  count(*) FILTER (false_alert) AS false_alert_windows, round(avg(threshold), 6) AS threshold,
  round(avg(ood_score) FILTER (window_partition = 'benign'), 6) AS benign_score_mean,
  round(avg(ood_score) FILTER (window_partition = 'attack'), 6) AS attack_score_mean,
  round(avg(ood_score) FILTER (window_partition = 'ood'), 6) AS ood_score_mean, max(ood_score) AS peak_ood_score,
  round(avg(ood_score) FILTER (window_partition = 'attack') - avg(ood_score) FILTER (window_partition = 'benign'), 6) AS
    score_separation,
  coalesce(avg(ood_score) FILTER (window_partition = 'attack') < avg(ood_score) FILTER (window_partition = 'benign'), false) AS
    direction_warning,
  round(count(*) FILTER (has_alert) / count(*), 6) AS alert_rate,
  round(CASE WHEN count(*) FILTER (window_partition = 'benign') > 0 THEN count(*) FILTER (false_alert)
    / count(*) FILTER (window_partition = 'benign') ELSE 0.0 END, 6) AS false_alert_rate,
  {_q_sql('raw_ood_score', 'raw')}, {_q_sql('ood_score', 'normalized')},
  {_q_sql('raw_ood_score', 'benign', "window_partition = 'benign'")} FROM dt GROUP BY grp)"""


def _diagnostics(spark, sf):
    d = M.entity_diagnostics(uav_detections(spark, sf), "grp")
    floats = [c for c, t in d.dtypes if t == "double" and c != "peak_ood_score"]
    return _r(d, *floats)


@query("a42_entity_diagnostics", f"WITH {DT}, {_DIAG} SELECT * FROM diag")
def entity_diagnostics(spark, sf):
    return _diagnostics(spark, sf)


@query(
    "a43_fleet_diagnostics",
    f"""WITH {DT}, {REG}, {_DIAG}, j AS (SELECT diag.*, source_type FROM diag JOIN reg ON reg.uav_id = {_UAV_SQL})
    SELECT CAST(sum(window_count) AS BIGINT) AS window_count, CAST(sum(benign_windows) AS BIGINT) AS benign_windows,
      CAST(sum(attack_windows) AS BIGINT) AS attack_windows, CAST(sum(ood_windows) AS BIGINT) AS ood_windows,
      CAST(sum(alert_windows) AS BIGINT) AS alert_windows, CAST(sum(false_alert_windows) AS BIGINT) AS false_alert_windows,
      round(sum(false_alert_windows) FILTER (source_type <> 'external_non_uav')
        / sum(benign_windows) FILTER (source_type <> 'external_non_uav'), 6) AS uav_only_false_alert_rate,
      round(sum(false_alert_windows) FILTER (source_type = 'external_non_uav')
        / sum(benign_windows) FILTER (source_type = 'external_non_uav'), 6) AS external_false_alert_rate FROM j""",
)
def fleet_diagnostics(spark, sf):
    d = _diagnostics(spark, sf).withColumn("uav_id", _uav())
    out = M.fleet_diagnostics(J.attach_entity(d, "uav_id"), "source_type")
    return _r(out, "uav_only_false_alert_rate", "external_false_alert_rate")


@query(
    "a44_direction_check",
    f"""WITH {DT}, x AS (SELECT uav_id, ood_score, attack_active AS y FROM dt UNION ALL SELECT '__all__', ood_score, attack_active FROM dt),
    k AS (SELECT *, (2 * rank() OVER (PARTITION BY uav_id ORDER BY ood_score) + count(*) OVER (PARTITION BY uav_id, ood_score) - 1)
      / 2.0 AS rk FROM x),
    a AS (SELECT uav_id, (sum(CASE WHEN y THEN rk ELSE 0 END) - count(*) FILTER (y) * (count(*) FILTER (y) + 1) / 2.0)
      / (count(*) FILTER (y) * count(*) FILTER (NOT y)) AS auroc FROM k GROUP BY 1)
    SELECT uav_id, round(auroc, 6) AS auroc, auroc < 0.5 AS flip_suspected,
      round(CASE WHEN auroc < 0.5 THEN 1 - auroc ELSE auroc END, 6) AS effective_auroc, 'attack_active' AS label_source FROM a""",
)
def direction_check(spark, sf):
    d = uav_detections(spark, sf).withColumn("ground_truth_is_ood", F.lit(None).cast("boolean"))
    return _r(M.direction_check(d, "uav_id", "ground_truth_is_ood", "attack_active"), "auroc", "effective_auroc")


@query(
    "a45_run_summary",
    f"""WITH {DT}, r AS (SELECT count(DISTINCT uav_id) AS uav_count, count(*) AS record_count, count(*) FILTER (attack_active) AS
      attack_record_count, round(avg(rssi), 6) AS mean_rssi, max(temperature) AS peak_temperature,
      round(sum(total_energy_wh), 4) AS total_energy_wh, round(sum(detection_energy_wh), 4) AS ids_energy_wh,
      round(sum(detection_energy_wh) / sum(total_energy_wh), 6) AS ids_energy_ratio,
      round(sum(detection_energy_wh) / count(*), 6) AS energy_per_window_wh FROM tel)
    SELECT r.*, count(*) AS window_count, count(*) FILTER (has_alert) AS alert_count,
      count(*) FILTER (has_alert AND NOT attack_active) AS false_alert_count, max(ood_score) AS peak_ood_score FROM dt, r GROUP BY ALL""",
)
def run_summary(spark, sf):
    s = M.run_summary(telemetry(spark, sf), uav_detections(spark, sf), "uav_id")
    s = s.withColumns({"total_energy_wh": F.round("total_energy_wh", 4), "ids_energy_wh": F.round("ids_energy_wh", 4)})
    return _r(s, "mean_rssi", "ids_energy_ratio", "energy_per_window_wh")


@query(
    "a47_raw_row_counts",
    f"""WITH {DT} SELECT uav_id, count(*) AS sample_count, count(*) FILTER (attack_active) AS attack_count,
      count(*) FILTER (is_ood OR alert_level IN ('warning', 'critical')) AS alert_count,
      count(*) FILTER ((is_ood OR alert_level IN ('warning', 'critical')) AND NOT attack_active) AS false_alert_count
    FROM dt GROUP BY 1""",
)
def raw_row_counts(spark, sf):
    return M.raw_row_counts(uav_detections(spark, sf), "uav_id")


@query(
    "a49_input_drift",
    f"""WITH {REC}, f AS (SELECT grp, CASE WHEN label <> 'error' THEN value END AS a, CASE WHEN k < 10 THEN 0 ELSE k END AS b FROM rec),
    c AS (SELECT grp, a AS x FROM f UNION ALL SELECT grp, b FROM f)
    SELECT grp, count(*) // 2 AS rows, round(count(*) FILTER (x IS NULL) / count(*), 6) AS missing_ratio,
      round(count(*) FILTER (coalesce(x, 0) = 0) / count(*), 6) AS zero_ratio, round(avg(coalesce(x, 0)), 6) AS mean,
      round(stddev_pop(coalesce(x, 0)), 5) AS std FROM c GROUP BY grp""",
)
def input_drift(spark, sf):
    r = records(spark, sf).select(
        "grp", F.when(F.col("label") != "error", F.col("value")).alias("a"),
        F.when(F.col("k") < 10, 0.0).otherwise(F.col("k")).alias("b"),
    )
    d = M.input_drift(r, "grp", ["a", "b"])
    return _r(d, "missing_ratio", "zero_ratio", "mean").withColumn("std", F.round("std", 5))


@query(
    "a50_score_diagnostics",
    f"""WITH {DT} SELECT grp, count(*) AS windows, count(*) FILTER (k = 0) AS errors, count(DISTINCT round(ood_score, 8)) AS
      unique_scores, {_q_sql('raw_ood_score', 'raw')}, {_q_sql('ood_score', 'normalized')},
      {_q_sql('raw_ood_score', 'warmup', "label = 'view'")} FROM dt GROUP BY grp""",
)
def score_diagnostics(spark, sf):
    d = M.score_diagnostics(
        uav_detections(spark, sf), "grp", "raw_ood_score", "ood_score", F.col("label") == "view", F.col("k") == 0
    )
    return _r(d, *[c for c, t in d.dtypes if t == "double"])


@query(
    "p22_detection_normalization",
    f"""WITH {DT} SELECT window_id, CASE WHEN label = 'view' THEN 'u' ELSE group_id END AS group_id,
      raw_ood_score, ood_score, threshold, 'global' AS threshold_source, is_ood, is_ood AS ood_alert, known_attack_alert,
      alert_reason, alert_level, has_alert, false_alert, attack_active, truth_ood AS ground_truth_is_ood, window_partition FROM dt""",
)
def detection_normalization(spark, sf):
    d = uav_detections(spark, sf)
    docs = d.select(
        "window_id",
        F.when(F.col("label") != "view", F.col("group_id")).alias("group_id"),
        F.array(F.concat(F.lit("u:"), F.col("window_id"))).alias("record_ids"),
        "raw_ood_score",
        "ood_score",
        F.col("threshold").alias("ood_threshold"),
        "is_ood",
        "known_attack_alert",
        F.upper("alert_level").alias("alert_level"),
        F.lit(" bogus").alias("alert_reason"),
        F.struct(F.col("attack_active"), F.col("truth_ood").alias("is_ood")).alias("ground_truth"),
    )
    return M.normalize_detections(docs)
