"""Scaling, scoring, fusion and threshold queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.catalog.registry import query
from vigilframe.catalog.views import DET, PROTO, REC, SCORES, VEC, VECTOR_CLASSES, detections, r6, records, vectors
from vigilframe.config import materialize
from vigilframe.functions.fixed import FUSION_MODES, SCORE_NAMES
from vigilframe.operators import calibrate as K
from vigilframe.operators import scaling as Z
from vigilframe.operators import scoring as G
from vigilframe.operators.ordering import quantiles

ORDER = ["ts_us", "record_id"]


# --- scaling -----------------------------------------------------------------------
def _dirty(spark, sf):
    r = records(spark, sf)
    return r.withColumns(
        {
            "a": F.when(F.col("label") == "error", F.lit(float("nan"))).when(
                F.col("label") == "signup", F.lit(float("inf"))).otherwise(F.col("value")),
            "b": F.col("k"),
        }
    )


@query(
    "p08_feature_extraction",
    f"""WITH {REC}, m AS (SELECT quantile_cont(value, 0.5) FILTER (label NOT IN ('error', 'signup')) AS ma FROM rec)
    SELECT record_id, round(CASE WHEN label IN ('error', 'signup') THEN ma ELSE value END, 6) AS a, k AS b FROM rec, m""",
)
def feature_extraction(spark, sf):
    d = _dirty(spark, sf)
    med = Z.feature_medians(d, ["a", "b"])
    return Z.extract_features(d, ["a", "b"], med).select("record_id", r6("a").alias("a"), "b")


@query(
    "a06_feature_medians",
    f"""WITH {REC} SELECT 'a' AS feature, quantile_cont(value, 0.5) FILTER (label NOT IN ('error', 'signup')) AS median FROM rec
    UNION ALL SELECT 'b', quantile_cont(k, 0.5) FROM rec""",
)
def feature_medians(spark, sf):
    d = _dirty(spark, sf)
    med = Z.feature_medians(d, ["a", "b"])
    return spark.createDataFrame([(k, v) for k, v in med.items()], "feature string, median double")


@query(
    "a07_global_scaler",
    f"""WITH {REC}, s AS (SELECT avg(value) AS m1, stddev_pop(value) AS s1, avg(k) AS m2, stddev_pop(k) AS s2 FROM rec)
    SELECT record_id, round((value - m1) / s1, 6) AS value, round((k - m2) / s2, 6) AS k FROM rec, s""",
)
def global_scaler(spark, sf):
    r = records(spark, sf)
    out = Z.apply_global_scaler(r, Z.fit_global_scaler(r, ["value", "k"]), ["value", "k"])
    return out.select("record_id", r6("value").alias("value"), r6("k").alias("k"))


@query(
    "a08_group_scaler",
    f"""WITH {REC} SELECT CAST(grp AS VARCHAR) AS group_id, count(*) AS n, count(*) < 65 AS fallback,
      CASE WHEN count(*) < 65 THEN '{Z.SMALL_GROUP}' ELSE 'group_scaler' END AS reason FROM rec GROUP BY grp""",
)
def group_scaler(spark, sf):
    return Z.scaling_summary(Z.fit_group_scaler(records(spark, sf), "grp", ["value", "k"], 65), "grp")


@query(
    "j05_scaler_lookup",
    f"""WITH {REC}, g AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM rec),
    p AS (SELECT grp, avg(value) AS m, stddev_pop(value) AS s FROM rec GROUP BY grp HAVING count(*) >= 65)
    SELECT record_id, round((value - coalesce(p.m, g.m)) / coalesce(p.s, g.s), 6) AS value,
      CASE WHEN p.m IS NULL THEN 'global' ELSE 'group' END AS scaler_source FROM rec LEFT JOIN p ON rec.grp = p.grp, g""",
)
def scaler_lookup(spark, sf):
    r = records(spark, sf)
    out = Z.apply_group_scaler(r, Z.fit_group_scaler(r, "grp", ["value"], 65), "grp", ["value"])
    return out.select("record_id", r6("value").alias("value"), "scaler_source")


# --- score tables --------------------------------------------------------------------
def score_table(spark, sf):
    v = vectors(spark, sf)
    known = v.where(F.col("label") < 8)
    model = G.fit_prototypes(known, "vec", F.array("label"), VECTOR_CLASSES, precision=False, scale=4.0)
    raw = G.raw_scores(v, ["vec_id", "grp", "label", "truth_ood"], "vec", model, known.select("vec"), "vec")
    return raw


@query(
    "f13_raw_scores",
    f"WITH {SCORES} SELECT vec_id, round(conf, 5) AS conf, round(energy, 5) AS energy, round(proto, 5) AS proto, "
    "round(knn, 5) AS knn FROM raw",
)
def raw_scores(spark, sf):
    return score_table(spark, sf).select("vec_id", *[F.round(c, 5).alias(c) for c in SCORE_NAMES])


@query(
    "j10_bank_cosine",
    f"""WITH {VEC}, s AS (SELECT a.vec_id, list_cosine_similarity(a.v, b.v) AS c FROM vec a, vec b WHERE b.label < 8)
    SELECT vec_id, round(-avg(c), 5) AS knn FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY c DESC) AS rn FROM s)
    WHERE rn <= 10 GROUP BY vec_id""",
)
def bank_cosine(spark, sf):
    v = vectors(spark, sf)
    fields = "`vec_id` bigint"
    keep = v.select("vec_id", F.col("vec").alias("__x"))
    return G.blocked_knn(keep, ["vec_id"], fields, v.where(F.col("label") < 8), "vec", 10, rows_per_block=256).select(
        "vec_id", F.round("knn", 5).alias("knn")
    )


@query(
    "j10_prototype_distance",
    f"WITH {PROTO} SELECT vec_id, round(min(list_distance(v, mu)), 5) AS proto FROM vec, proto GROUP BY vec_id",
)
def prototype_distance(spark, sf):
    v = vectors(spark, sf)
    model = G.fit_prototypes(v.where(F.col("label") < 8), "vec", F.array("label"), VECTOR_CLASSES, precision=False)
    return G.distance_scores(v, ["vec_id"], "vec", model).select("vec_id", F.round("proto", 5).alias("proto"))


@query(
    "a15_class_prototypes",
    f"""WITH {PROTO}, g AS (SELECT list(m ORDER BY i) AS mu FROM (SELECT i, avg(x) AS m FROM elem WHERE label < 8 GROUP BY i)),
    c AS (SELECT class, (SELECT count(*) FROM vec WHERE label = class) AS n, mu FROM proto
          UNION ALL SELECT 77, 0, mu FROM g)
    SELECT class, n, unnest(range(64)) AS dim, round(unnest(mu), 6) AS x FROM c""",
)
def class_prototypes(spark, sf):
    v = vectors(spark, sf).where(F.col("label") < 8)
    m = G.class_means(v, "vec", F.array("label"), [*VECTOR_CLASSES, 77])
    return m.select("class", "n", F.posexplode("vec").alias("dim", "x")).withColumn("x", r6("x"))


@query("a15_mahalanobis_scores")
def mahalanobis_scores(spark, sf):
    v = vectors(spark, sf)
    known = v.where(F.col("label") < 8)
    model = G.fit_prototypes(known, "vec", F.array("label"), VECTOR_CLASSES, precision=True, scale=4.0)
    return G.distance_scores(v, ["vec_id"], "vec", model).select("vec_id", r6("proto").alias("proto"))


def _validation(spark, sf):
    return score_table(spark, sf).where(~F.col("truth_ood"))


_VAL = SCORES + ", val AS (SELECT * FROM raw WHERE NOT truth_ood)"
_ROBUST = _VAL + """,
rs AS (SELECT """ + ", ".join(
    f"quantile_cont({n}, 0.5) AS m_{n}, greatest(quantile_cont({n}, 0.75) - quantile_cont({n}, 0.25), 1e-6) AS i_{n}"
    for n in SCORE_NAMES
) + """ FROM val),
nv AS (SELECT vec_id, grp, label, """ + ", ".join(f"({n} - m_{n}) / i_{n} AS {n}" for n in SCORE_NAMES) + """ FROM val, rs),
na AS (SELECT vec_id, grp, label, truth_ood, """ + ", ".join(f"({n} - m_{n}) / i_{n} AS {n}" for n in SCORE_NAMES) + """ FROM raw, rs)"""


@query(
    "a09_robust_scaling",
    f"WITH {_ROBUST} "
    + " UNION ALL ".join(f"SELECT '{n}' AS score, round(m_{n}, 5) AS median, round(i_{n}, 5) AS iqr FROM rs" for n in SCORE_NAMES),
)
def robust_scaling(spark, sf):
    val = _validation(spark, sf)
    scales = K.robust_scales(val, SCORE_NAMES, {})
    rows = spark.createDataFrame([(n, m, i) for n, (m, i) in scales.items()], "score string, median double, iqr double")
    return rows.select("score", F.round("median", 5).alias("median"), F.round("iqr", 5).alias("iqr"))


_CORR = " UNION ALL ".join(
    f"SELECT '{a}' AS score_a, '{b}' AS score_b, coalesce(corr({a}, {b}), 0) AS corr FROM nv" for a in SCORE_NAMES for b in SCORE_NAMES
)


@query(
    "a10_score_correlation",
    f"WITH {_ROBUST} SELECT score_a, score_b, round(corr, 5) AS corr FROM ({_CORR})",
)
def score_correlation(spark, sf):
    c = K.correlation(_validation(spark, sf), SCORE_NAMES)
    return c.withColumn("corr", F.round("corr", 5))


_WEIGHTS = _ROBUST + f""",
cr AS (SELECT score_a AS score, 1 / greatest(sum(abs(corr)), 1e-6) AS w FROM ({_CORR}) GROUP BY 1),
vr AS ({" UNION ALL ".join(f"SELECT '{n}' AS score, 1 / (stddev_pop({n}) + 1e-6) AS w FROM nv" for n in SCORE_NAMES)}),
wt AS (SELECT 'correlation_aware' AS mode, score, w / sum(w) OVER () AS w FROM cr
  UNION ALL SELECT 'variance_weighted', score, w / sum(w) OVER () FROM vr
  UNION ALL SELECT m, score, 0.25 FROM cr, (SELECT unnest(['mean', 'hard_voting']) AS m)
  UNION ALL SELECT m, score, CASE WHEN m = score THEN 1.0 ELSE 0.0 END FROM cr,
    (SELECT unnest(['conf', 'energy', 'proto', 'knn']) AS m))"""


def _modes_table(spark, rows):
    fields = list(rows[0])
    return spark.createDataFrame([tuple(r[f] for f in fields) for r in rows], fields)


@query("a11_fusion_weights", f"WITH {_WEIGHTS} SELECT mode, score, round(w, 5) AS weight FROM wt")
def fusion_weights(spark, sf):
    sweep = K.fusion_sweep(materialize(_validation(spark, sf), "scores"))
    rows = [{"mode": m, "score": n, "weight": float(c.weights[n])} for m, c in sweep.items() for n in SCORE_NAMES]
    return _modes_table(spark, rows).withColumn("weight", F.round("weight", 5))


_FUSED = _WEIGHTS + """,
st AS (SELECT """ + ", ".join(f"quantile_cont({n}, 0.95) AS t_{n}" for n in SCORE_NAMES) + """ FROM nv),
fz AS (SELECT mode, a.vec_id, a.grp, a.label, a.truth_ood,
  CASE WHEN mode = 'hard_voting' THEN any_value(""" + " + ".join(f"CAST({n} > t_{n} AS INT)" for n in SCORE_NAMES) + """) / 4.0
       ELSE sum(w * CASE score """ + " ".join(f"WHEN '{n}' THEN {n}" for n in SCORE_NAMES) + """ END) END AS fused
  FROM na a, wt, st GROUP BY mode, a.vec_id, a.grp, a.label, a.truth_ood),
th AS (SELECT mode, quantile_cont(fused, 0.95) AS thr FROM fz WHERE NOT truth_ood GROUP BY mode)"""


@query(
    "a12_global_thresholds",
    f"""WITH {_FUSED} SELECT 'fused' AS score, round(thr, 4) AS threshold FROM th WHERE mode = 'mean' UNION ALL """
    + " UNION ALL ".join(f"SELECT '{n}', round(t_{n}, 4) FROM st" for n in SCORE_NAMES),
)
def global_thresholds(spark, sf):
    cal = K.fit_calibration(materialize(_validation(spark, sf), "scores"), "mean")
    rows = [{"score": n, "threshold": float(t)} for n, t in {"fused": cal.threshold, **cal.score_thresholds}.items()]
    return _modes_table(spark, rows).withColumn("threshold", F.round("threshold", 4))


@query(
    "a53_fusion_sweep",
    f"""WITH {_FUSED} SELECT fz.mode, round(any_value(thr), 4) AS threshold,
      count(*) FILTER (round(fused, 4) > round(thr, 4)) AS alerts,
      count(*) FILTER (round(fused, 4) > round(thr, 4) AND truth_ood) AS hits
    FROM fz JOIN th ON fz.mode = th.mode GROUP BY fz.mode""",
)
def fusion_sweep(spark, sf):
    raw = materialize(score_table(spark, sf), "scores")
    sweep = K.fusion_sweep(raw.where(~F.col("truth_ood")))
    norm = K.normalized_columns(sweep[FUSION_MODES[0]])  # the modes share their scales
    fused = raw.select("truth_ood", *[K.fused_column(sweep[m], norm).alias(m) for m in FUSION_MODES])
    cuts = {m: round(sweep[m].threshold, 4) for m in FUSION_MODES}
    hit = {m: F.round(m, 4) > cuts[m] for m in FUSION_MODES}
    counts = fused.agg(
        *[F.count_if(h).alias(f"a_{m}") for m, h in hit.items()], *[F.count_if(h & F.col("truth_ood")).alias(f"h_{m}") for m, h in hit.items()]
    )
    return counts.select(F.inline(F.array(*[
        F.struct(F.lit(m).alias("mode"), F.lit(cuts[m]).alias("threshold"), F.col(f"a_{m}").alias("alerts"), F.col(f"h_{m}").alias("hits"))
        for m in FUSION_MODES
    ])))


@query(
    "f14_fused_decisions",
    f"""WITH {_FUSED} SELECT vec_id, round(fused, 4) AS fused, round(fused, 4) > (SELECT round(thr, 4) FROM th WHERE mode = 'mean')
      AS is_ood FROM fz WHERE mode = 'mean'""",
)
def fused_decisions(spark, sf):
    raw = materialize(score_table(spark, sf), "scores")
    cal = K.fit_calibration(raw.where(~F.col("truth_ood")), "mean")
    return K.apply_calibration(raw, cal).select(
        "vec_id", F.round("fused", 4).alias("fused"), (F.round("fused", 4) > round(cal.threshold, 4)).alias("is_ood")
    )


# --- thresholds on the detection view ---------------------------------------------------
def _id_detections(spark, sf):
    return detections(spark, sf).where(~F.col("truth_ood"))


_G = DET + ", idd AS (SELECT * FROM det WHERE NOT truth_ood), gt AS (SELECT quantile_cont(ood_score, 0.9) AS g FROM idd)"
_GQ = _G + """, q AS (SELECT group_id, count(*) AS n, quantile_cont(ood_score, 0.9) AS r FROM idd GROUP BY 1),
a AS (SELECT *, n / (n + 40.0) AS al FROM q, gt)"""


def _group_sql(final: str, smooth: str, source: str) -> str:
    return f"""WITH {_GQ} SELECT group_id, n, CASE WHEN n >= 50 THEN round(r, 6) END AS raw_threshold,
      CASE WHEN n >= 50 THEN round({smooth}, 6) END AS smoothed_threshold,
      CASE WHEN n >= 50 THEN round({final}, 6) END AS threshold, CASE WHEN n >= 50 THEN {source} END AS source,
      CASE WHEN n < 50 THEN 'fallback_to_global_due_to_small_validation_size' END AS fallback_reason FROM a"""


def _group(spark, sf, strategy, min_ratio=1.0):
    d = _id_detections(spark, sf)
    g = quantiles(d, [], "ood_score", {"g": 0.9}).first()["g"]
    t = K.group_thresholds(d, "group_id", "ood_score", g, 0.9, 50, strategy, 40.0, min_ratio)
    return t.select(
        "group_id", "n", *[r6(c).alias(c) for c in ("raw_threshold", "smoothed_threshold", "threshold")], "source",
        "fallback_reason",
    )


_SHRUNK = "(al * r + (1 - al) * g)"


@query("a13_group_thresholds_raw", _group_sql("r", "r", "'group_raw'"))
def group_thresholds_raw(spark, sf):
    return _group(spark, sf, "raw")


@query("a13_group_thresholds_shrink", _group_sql(_SHRUNK, _SHRUNK, "'group_shrink'"))
def group_thresholds_shrink(spark, sf):
    return _group(spark, sf, "shrink")


@query(
    "a13_group_thresholds_conservative",
    _group_sql(
        f"greatest({_SHRUNK}, g * 0.95)", _SHRUNK,
        f"CASE WHEN {_SHRUNK} <= g * 0.95 THEN 'group_conservative_floor' ELSE 'group_conservative' END",
    ),
)
def group_thresholds_conservative(spark, sf):
    return _group(spark, sf, "conservative", 0.95)


@query("a13_group_thresholds_global_floor", _group_sql("greatest(r, g)", "r", "'group_global_floor'"))
def group_thresholds_global_floor(spark, sf):
    return _group(spark, sf, "global_floor")


_PH = "CASE WHEN k < 3 THEN 'takeoff' WHEN k < 50 THEN 'cruise' ELSE 'hover' END"


def _phase(d):
    return d.withColumn("phase", F.when(F.col("k") < 3, "takeoff").when(F.col("k") < 50, "cruise").otherwise("hover"))


@query(
    "a14_phase_thresholds",
    f"""WITH {_G}, q AS (SELECT {_PH} AS phase, count(*) AS n, quantile_cont(ood_score, 0.9) AS t FROM idd GROUP BY 1)
    SELECT phase, n, round(CASE WHEN n >= 1000 THEN t ELSE g END, 6) AS threshold,
      CASE WHEN n >= 1000 THEN 'phase' ELSE 'global_fallback' END AS source FROM q, gt""",
)
def phase_thresholds(spark, sf):
    d = _phase(_id_detections(spark, sf))
    g = quantiles(d, [], "ood_score", {"g": 0.9}).first()["g"]
    return K.phase_thresholds(d, "phase", "ood_score", g, 0.9, 1000).withColumn("threshold", r6("threshold"))


@query(
    "j05_threshold_lookup",
    f"""WITH {_GQ} SELECT window_id, round(CASE WHEN a.n >= 50 THEN r ELSE gt.g END, 6) AS threshold,
      CASE WHEN a.n >= 50 THEN 'group_raw' ELSE 'global_fallback' END AS threshold_source,
      round(ood_score, 6) > round(CASE WHEN a.n >= 50 THEN r ELSE gt.g END, 6) AS is_ood
    FROM det LEFT JOIN a ON det.group_id = a.group_id, gt""",
)
def threshold_lookup(spark, sf):
    d = _id_detections(spark, sf)
    g = quantiles(d, [], "ood_score", {"g": 0.9}).first()["g"]
    t = K.group_thresholds(d, "group_id", "ood_score", g, 0.9, 50)
    out = K.resolve_thresholds(detections(spark, sf).drop("threshold"), g, "group_id", t)
    return out.select(
        "window_id", r6("threshold").alias("threshold"), "threshold_source",
        (r6("ood_score") > r6("threshold")).alias("is_ood"),
    )


@query(
    "a57_bootstrap_thresholds",
    f"""WITH {DET} SELECT group_id, count(*) AS n, round(max(ood_score) + 0.05, 6) AS threshold FROM det
      WHERE NOT attack_active GROUP BY group_id""",
)
def bootstrap_thresholds(spark, sf):
    b = K.bootstrap_thresholds(detections(spark, sf), "group_id", "ood_score", ~F.col("attack_active"), 0.05)
    return b.withColumn("threshold", r6("threshold"))


# --- temperature, class thresholds, directions, pseudo-OOD ---------------------------------
_LOGITS = PROTO + """,
lo AS (SELECT vec_id, label, class, 4.0 * list_dot_product(v, mu) AS z, CAST(label = class AS INT) AS y FROM vec, proto
       WHERE label < 8)"""


def _class_long(spark, sf):
    v = vectors(spark, sf).where(F.col("label") < 8)
    model = G.fit_prototypes(v, "vec", F.array("label"), VECTOR_CLASSES, precision=False, scale=4.0)
    s = G.score_windows(v, ["vec_id", "label"], "vec", G.prototype_scorer(model))
    y = F.transform(F.array(*[F.lit(c) for c in VECTOR_CLASSES]), lambda c: (c == F.col("label")).cast("int"))
    return K.explode_classes(s.withColumn("y", y), ["vec_id"], "y", {"logit": "logits", "p": "probs"})


@query(
    "a18_temperature_search",
    f"""WITH {_LOGITS}, g AS (SELECT 0.5 + 0.25 * i AS t FROM range(15) r(i)),
    l AS (SELECT t, avg(greatest(z / t, 0) + ln(1 + exp(-abs(z / t))) - y * z / t) AS loss FROM lo, g GROUP BY t)
    SELECT round(arg_min(t, loss), 6) AS temperature, round(min(loss), 6) AS loss FROM l""",
)
def temperature_search(spark, sf):
    best = K.best_temperature(K.temperature_losses(_class_long(spark, sf)))
    return best.select(r6("temperature").alias("temperature"), r6("loss").alias("loss"))


@query(
    "a19_class_thresholds",
    f"""WITH {_LOGITS}, g AS (SELECT round(0.05 * i, 2) AS t FROM range(1, 20) r(i)),
    p AS (SELECT class, y, round(1 / (1 + exp(-z)), 9) AS p FROM lo),
    c AS (SELECT class, t, sum(CASE WHEN p >= t THEN y ELSE 0 END) AS tp, count(*) FILTER (p >= t) AS n, sum(y) AS pos
          FROM p, g GROUP BY ALL),
    f AS (SELECT class, t, pos, tp / greatest(n, 1) AS pr, tp / greatest(pos, 1) AS re FROM c),
    s AS (SELECT *, 2 * pr * re / greatest(pr + re, 1e-12) AS f1 FROM f)
    SELECT class AS class_idx, CAST(pos AS BIGINT) AS positives, t AS threshold, round(f1, 6) AS f1 FROM s
    QUALIFY row_number() OVER (PARTITION BY class ORDER BY round(f1, 12) DESC, t) = 1""",
)
def class_thresholds(spark, sf):
    long = _class_long(spark, sf).withColumn("p", F.round("p", 9))
    return K.class_thresholds(long).withColumn("f1", r6("f1"))


@query(
    "a16_pseudo_ood",
    f"""WITH {VEC}, c AS (SELECT unnest(range(8)) AS class_idx)
    SELECT CAST(class_idx AS BIGINT) AS class_idx, 'class_' || class_idx AS class_name,
      count(*) FILTER (label = class_idx) AS pseudo_ood_windows, count(*) FILTER (label <> class_idx) AS pseudo_id_windows,
      count(*) FILTER (label = class_idx) > 0 AND count(*) FILTER (label <> class_idx) > 0 AS used
    FROM vec, c WHERE label < 8 GROUP BY class_idx""",
)
def pseudo_ood(spark, sf):
    v = vectors(spark, sf).where(F.col("label") < 8)
    y = F.transform(F.array(*[F.lit(c) for c in VECTOR_CLASSES]), lambda c: (c == F.col("label")).cast("double"))
    _, summary = K.pseudo_ood(v.withColumn("y", y), "y", [f"class_{c}" for c in VECTOR_CLASSES])
    return summary


def _auroc_sql(score: str, src: str, truth: str) -> str:
    return f"""SELECT '{score}' AS score_name, (sum(CASE WHEN {truth} THEN rk ELSE 0 END)
      - count(*) FILTER ({truth}) * (count(*) FILTER ({truth}) + 1) / 2.0)
      / (count(*) FILTER ({truth}) * count(*) FILTER (NOT {truth})) AS auroc FROM (SELECT *, (rank() OVER (ORDER BY {score})
      + rank() OVER (ORDER BY {score}) + count(*) OVER (PARTITION BY {score}) - 1) / 2.0 AS rk FROM {src})"""


@query(
    "a17_score_directions",
    f"""WITH {DET}, s AS (SELECT ood_score, -ood_score AS inverted, k, truth_ood FROM det),
    a AS ({_auroc_sql('ood_score', 's', 'truth_ood')} UNION ALL {_auroc_sql('inverted', 's', 'truth_ood')}
      UNION ALL {_auroc_sql('k', 's', 'truth_ood')})
    SELECT score_name, round(auroc, 6) AS raw_auroc, auroc < 0.5 AS flipped,
      round(CASE WHEN auroc < 0.5 THEN 1 - auroc ELSE auroc END, 6) AS effective_auroc,
      CASE WHEN auroc < 0.5 THEN -1.0 ELSE 1.0 END AS direction FROM a""",
)
def score_directions(spark, sf):
    d = detections(spark, sf).withColumn("inverted", -F.col("ood_score"))
    out = K.score_directions(d, "truth_ood", ["ood_score", "inverted", "k"])
    return out.withColumns({"raw_auroc": r6("raw_auroc"), "effective_auroc": r6("effective_auroc")})


@query(
    "m08_deployment_threshold",
    f"""WITH {VEC}, p AS (SELECT vec_id, label, 1 - list_max(list_transform(v, lambda z: 1 / (1 + exp(-z / 1.5))))
      AS conf FROM vec)
    SELECT round(quantile_cont(conf, 0.9), 6) AS threshold, count(*) AS validation_windows FROM p WHERE label < 8""",
)
def deployment_threshold(spark, sf):
    from vigilframe.functions import scores as S

    v = vectors(spark, sf).where(F.col("label") < 8)
    p = v.select(F.transform("vec", lambda z: S.sigmoid(z, 1.5)).alias("p"))
    conf = p.select(S.binary_uncertainty(F.col("p"))["conf"].alias("conf"))
    t = quantiles(conf, [], "conf", {"threshold": 0.9})
    n = conf.agg(F.count(F.lit(1)).alias("validation_windows"))
    return t.join(F.broadcast(n)).withColumn("threshold", r6("threshold"))
