"""Hand-computed cases of single operators."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.functions import text as X
from vigilframe.catalog.views import ieee_divide, round_double
from vigilframe.operators import attribution as AT
from vigilframe.operators import calibrate as K
from vigilframe.operators import clean as C
from vigilframe.operators import joins as J
from vigilframe.operators import merge as M
from vigilframe.operators import metrics as E
from vigilframe.operators import monitor as MO
from vigilframe.operators import replay as RP
from vigilframe.operators import reports as R
from vigilframe.operators import scaling as Z
from vigilframe.operators import splits as P
from vigilframe.operators import windows as W


def group_rows(spark):
    rows = [(f"a{i}", i, "uav_01", float(i), 2.0 * i + 10) for i in range(12)]
    rows += [(f"b{i}", i, "uav_02", 100.0 + i, 3.0 * i - 50) for i in range(12)]
    rows += [("c0", 0, "uav_small", 999.0, -999.0), ("c1", 1, "uav_small", 1001.0, -1001.0)]
    return spark.createDataFrame(rows, "record_id string, timestamp int, uav_id string, feat_a double, feat_b double")


def test_group_scaler_and_fallback(spark):
    df, feats = group_rows(spark), ["feat_a", "feat_b"]
    model = Z.fit_group_scaler(df, "uav_id", feats, 3)
    out = Z.apply_group_scaler(df, model, "uav_id", feats)
    means = out.where("uav_id <> 'uav_small'").groupBy("uav_id").agg(F.avg("feat_a").alias("a"), F.avg("feat_b").alias("b"))
    for r in means.collect():
        assert abs(r["a"]) < 1e-9 and abs(r["b"]) < 1e-9
    summary = {r["group_id"]: r["reason"] for r in Z.scaling_summary(model, "uav_id").collect()}
    assert summary["uav_small"] == "fallback_to_global_due_to_small_group_size"
    x = np.array([r["feat_a"] for r in df.collect()])
    small = out.where("record_id = 'c0'").first()
    assert small["scaler_source"] == "global" and math.isclose(small["feat_a"], (999 - x.mean()) / x.std())


def test_constant_feature_is_centred_only(spark):
    df = spark.createDataFrame([(5.0,), (5.0,)], "v double")
    assert [r["v"] for r in Z.apply_global_scaler(df, Z.fit_global_scaler(df, ["v"]), ["v"]).collect()] == [0.0, 0.0]


def test_feature_inference_keeps_only_safe_columns(spark):
    cols = "record_id timestamp label uav_id feat_a feat_b domain_id source_type mission_phase sim_time battery_soc source_x".split()
    df = spark.createDataFrame([tuple(range(len(cols)))] * 2, cols)
    assert C.infer_features(df, ["label", "timestamp", "record_id", "uav_id"]) == ["feat_a", "feat_b"]


@pytest.mark.parametrize(
    "scores, groups, q, min_samples, expected",
    [
        ([0.05, 0.10, 0.20, 0.80, 0.90, 1.10], ["1"] * 3 + ["2"] * 3, 0.5, 1, {"1": (0.10, "group_raw"), "2": (0.90, "group_raw")}),
        ([0.10, 0.20, 0.30, 0.80], ["1", "1", "1", "2"], 0.5, 2, {"1": (0.20, "group_raw"), "2": (10.0, "global_fallback")}),
    ],
)
def test_group_thresholds(spark, scores, groups, q, min_samples, expected):
    df = spark.createDataFrame(list(zip(groups, scores)), "g string, fused double")
    t = K.group_thresholds(df, "g", "fused", 10.0, q, min_samples)
    out = K.resolve_thresholds(df, 10.0, "g", t).select("g", "threshold", "threshold_source").distinct().collect()
    got = {r["g"]: (round(r["threshold"], 9), r["threshold_source"]) for r in out}
    assert got == expected


@pytest.mark.parametrize(
    "value, strategy, k, ratio, threshold, source",
    [
        (2.0, "raw", 1, 1.0, 2.0, "group_raw"),
        (2.0, "global_floor", 1, 1.0, 10.0, "group_global_floor"),
        (2.0, "conservative", 1, 0.8, 8.0, "group_conservative_floor"),
        (2.0, "conservative", 1, 1.0, 10.0, "group_conservative_floor"),
        (12.0, "global_floor", 1, 1.0, 12.0, "group_global_floor"),
        (12.0, "shrink", 1, 1.0, 11.5, "group_shrink"),
        (12.0, "shrink", 0, 1.0, 12.0, "group_shrink"),
    ],
)
def test_threshold_strategies(spark, value, strategy, k, ratio, threshold, source):
    df = spark.createDataFrame([("g", value)] * 3, "g string, fused double")
    r = K.group_thresholds(df, "g", "fused", 10.0, 0.5, 1, strategy, k, ratio).first()
    assert (r["threshold"], r["source"]) == (threshold, source)


def test_single_row_of_equal_scores_uses_the_identity_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 1.0)], "a double, b double")
    got = {(r["score_a"], r["score_b"]): r["corr"] for r in K.correlation(df, ["a", "b"]).collect()}
    assert got == {("a", "a"): 1.0, ("b", "b"): 1.0, ("a", "b"): 0.0, ("b", "a"): 0.0}


def test_constant_score_takes_almost_all_correlation_weight(spark):
    df = spark.createDataFrame([(1.0, float(i), float(-i)) for i in range(5)], "a double, b double, c double")
    w = K.fusion_weights(df, ["a", "b", "c"], "correlation_aware")
    assert w["a"] > 0.999 and abs(sum(w.values()) - 1) < 1e-12


def test_direction_flips_inverted_scores(spark):
    df = spark.createDataFrame([(0.9, 0), (0.8, 0), (0.2, 1), (0.1, 1)], "conf double, y int")
    r = K.score_directions(df, "y", ["conf"]).first()
    assert (r["raw_auroc"], r["flipped"], r["effective_auroc"], r["direction"]) == (0.0, True, 1.0, -1.0)


def test_pseudo_ood(spark):
    df = spark.createDataFrame([([1.0, 0.0],), ([1.0, 0.0],), ([0.0, 1.0],), ([1.0, 1.0],)], "y array<double>")
    rows, summary = K.pseudo_ood(df, "y", ["class_a", "class_b"])
    assert rows.count() == 8 and summary.count() == 2 and all(r["used"] for r in summary.collect())


@pytest.mark.parametrize(
    "d, exp", [([0, 1, 1, 1], (2 / 3, 1.0, 0.8, 0.5)), ([0, 0, 1, 1], (1.0, 1.0, 1.0, 0.0))]
)
def test_decision_metrics(spark, d, exp):
    df = spark.createDataFrame(list(zip([0, 0, 1, 1], d)), "y int, d int")
    r = E.decision_metrics(df, [], F.col("d") == 1, F.col("y") == 1).first()
    assert np.allclose((r["precision"], r["recall"], r["f1"], r["fpr"]), exp)


def test_present_class_f1(spark):
    rows = [(w, c, y, y) for w in range(4) for c, y in enumerate([int(w < 3), int(w == 3), 0, 0, 0])]
    per = E.class_rates(spark.createDataFrame(rows, "w int, class_idx int, y int, pred int"))
    assert math.isclose(per.agg(F.avg("f1")).first()[0], 0.4)
    assert tuple(E.present_class_f1(per, 1).first()) == (1.0, 2, 3)
    assert E.present_class_f1(per, 2).first()["present_class_count"] == 1
    assert E.present_class_f1(per, 9).first()["present_class_macro_f1"] is None


def test_one_class_has_no_auroc(spark):
    df = spark.createDataFrame([(0.1, 1), (0.4, 1)], "s double, y int")
    assert E.auroc(df, [], "s", "y").first()["auroc"] is None


@pytest.mark.parametrize("buckets", [1, 6])
def test_ranking_metrics_brute_force(spark, buckets):
    rng = np.random.default_rng(0)
    y, s = rng.integers(0, 2, 400), rng.integers(0, 30, 400) / 30
    df = spark.createDataFrame([("g", float(a), int(b)) for a, b in zip(s, y)], "g string, s double, y int")
    r = E.ranking_metrics(df, ["g"], "s", "y", buckets=buckets).first()
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > neg).mean() + 0.5 * (p == neg).mean() for p in pos])
    cuts = np.unique(s)[::-1]
    tp = np.array([(pos >= c).sum() for c in cuts])
    fp = np.array([(neg >= c).sum() for c in cuts])
    ap = np.sum(np.diff(np.r_[0, tp]) / len(pos) * tp / (tp + fp))
    assert np.isclose(r["auroc"], auc) and np.isclose(r["average_precision"], ap)
    assert np.isclose(r["fpr_at_tpr"], fp[np.argmax(tp / len(pos) >= 0.95)] / len(neg))


def test_detection_summary(spark):
    rows = [(0, "uav_01", False, 0.2), (1, "uav_01", True, 0.9), (2, None, True, 0.6), (3, "uav_02", False, 0.3)]
    det = spark.createDataFrame(rows, "window_id int, group_id string, is_ood boolean, ood_score double").withColumns(
        {"threshold": F.lit(0.5), "threshold_source": F.lit("global")}
    )
    got = {r["group_id"]: r for r in MO.detection_summary(det, "group_id", "window_id").collect()}
    u = got["uav_01"]
    assert (u["windows"], u["alert_rate"], round(u["mean_ood_score"], 9), u["max_ood_score"], u["top_window_ids"]) == (2, 0.5, 0.55, 0.9, [1, 0])
    assert got["__ungrouped__"]["windows"] == 1
    g = got["__global__"]
    assert (g["windows"], g["ood_alerts"], g["alert_rate"], round(g["mean_ood_score"], 9), g["max_ood_score"]) == (4, 2, 0.5, 0.5, 0.9)


def test_homogeneous_against_heterogeneous(spark):
    h = spark.createDataFrame([("m", 0.4), ("m", 0.6), ("n", None)], "method string, f1 double")
    x = spark.createDataFrame([("m", None, 0), ("m", 0.3, 1)], "method string, f1 double, seq int")
    out = {r["method"]: r for r in R.homogeneous_vs_heterogeneous(h, x, "method", "f1", "seq").collect()}
    m = out["m"]
    assert np.allclose((m["homogeneous_mean"], m["homogeneous_std"], m["drop"], m["drop_ratio"]), (0.5, 0.1, 0.2, 0.4))
    assert out["n"]["drop"] is None
    cell = h.groupBy("method").agg(X.format_mean_std(F.avg("f1"), F.stddev_pop("f1")).alias("c")).where("method = 'm'").first()["c"]
    assert cell == "0.5000 ± 0.1000"


def test_prefer_success_keeps_the_newest_success(spark):
    s = "k string, status string, v int"
    a = spark.createDataFrame([("x", "success", 1), ("y", "failed", 1)], s)
    b = spark.createDataFrame([("x", "failed", 2), ("y", "failed", 2)], s)
    assert {r["k"]: r["v"] for r in R.prefer_success([a, b], "k", "status").collect()} == {"x": 1, "y": 2}


@pytest.mark.parametrize("buckets", [None, 4])
def test_asof_phases(spark, buckets):
    rec = spark.createDataFrame(
        [("u1", 0.0, "idle", 0), ("u1", 5.0, "cruise", 1), ("u2", 2.0, "hover", 2)], "uav string, ts double, phase string, rid int"
    )
    det = spark.createDataFrame(
        [("u1", 1.0, 0), ("u1", 5.0, 1), ("u1", 5.0, 2), ("u2", 1.0, 3), ("u2", 9.0, 4)], "uav string, ts double, w int"
    )
    out = J.asof_backward(det, rec, "uav", "ts", "rid", ["phase"], buckets).collect()
    assert {r["w"]: r["phase"] for r in out} == {0: "idle", 1: "cruise", 2: "cruise", 3: None, 4: "hover"}


@pytest.mark.parametrize("width", [None, 2.0])
def test_interval_join_is_closed_open(spark, width):
    rec = spark.createDataFrame([("u", float(t)) for t in range(8)], "k string, ts double")
    sch = spark.createDataFrame([("u", 2.0, 5.0, "a"), ("u", 4.0, 6.0, "b")], "k string, s double, e double, name string")
    got = J.interval_join(rec, sch, "k", "ts", "s", "e", bucket_width=width).collect()
    pairs = sorted((r["ts"], r["name"] or "") for r in got)
    assert pairs == [(0, ""), (1, ""), (2, "a"), (3, "a"), (4, "a"), (4, "b"), (5, "b"), (6, ""), (7, "")]


@pytest.mark.parametrize("width", [1.0, 3.0])
def test_interval_join_of_very_different_lengths(spark, width):
    """A year among seconds: an interval is a few cells, each record meets it once, and others are found as before."""
    year = 365 * 86_400.0
    plans = [("u", 100.0 + 7 * i, 101.5 + 7 * i, f"s{i}") for i in range(200)] + [("u", -5.0, year, "year"), ("u", 3.0, 3.0, "none"), ("v", 0.0, 4.0, "v")]
    sch = spark.createDataFrame(plans, "k string, s double, e double, name string")
    times = [float(t) / 2 for t in range(-20, 3200, 3)] + [year - 0.5, year, 3.0, -5.0]
    rec = spark.createDataFrame([(k, t) for t in times for k in ("u", "w")], "k string, ts double")
    for how in ("left", "inner"):
        got = sorted((r["k"], r["ts"], r["name"] or "") for r in J.interval_join(rec, sch, "k", "ts", "s", "e", how, bucket_width=width).collect())
        want = [(k, t, n) for k in ("u", "w") for t in times for n in ([x[3] for x in plans if x[0] == k and x[1] <= t < x[2]] or ([""] if how == "left" else []))]
        assert got == sorted(want)
    unit = lambda c: F.floor(F.col(c) / width).cast("long")
    cells = sch.where("s < e").select(F.size(J.dyadic_cells(unit("s"), unit("e"))).alias("n")).agg(F.max("n"), F.sum("n")).first()
    assert cells[0] <= 2 * 26 and cells[1] <= 52 + 3 * len(plans)


def test_quota_fixture(spark):
    counts = spark.createDataFrame(
        [("benign", 20), ("dos", 20), ("replay", 8), ("video_interception", 8)], "label string, n long"
    )
    got = {r["label"]: r["quota"] for r in P.quotas(counts, "label", "n", 24, 0).collect()}
    assert got == {"benign": 9, "dos": 9, "replay": 3, "video_interception": 3}


def test_quota_larger_than_the_table_keeps_everything(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 2)], "label string, n long")
    assert {r["label"]: r["quota"] for r in P.quotas(counts, "label", "n", 99, 0).collect()} == {"a": 3, "b": 2}


@pytest.mark.parametrize("n, exp", [(3, (1, 1, 1)), (4, (2, 1, 1)), (10, (7, 2, 1)), (100, (70, 15, 15))])
def test_stratified_cuts(spark, n, exp):
    def brute(n):
        t, v = max(1, round(n * 0.7)), max(1, round(n * 0.15))
        while n - t - v < 1:
            if t >= v and t > 1:
                t -= 1
            elif v > 1:
                v -= 1
            else:
                break
        return t, v, n - t - v

    r = P.stratified_cuts(spark.createDataFrame([("a", n)], "label string, n long"), "label").first()
    assert (r["n_train"], r["n_val"], r["n_test"]) == brute(n) == exp


def test_chronological_split_covers_and_separates(spark):
    rows = [(i, "dos" if i % 4 == 0 else "benign") for i in range(20)] + [(i, "evil") for i in range(20, 30)]
    df = spark.createDataFrame(rows, "i int, label string")
    out = P.chronological_split(df, F.col("label") == "evil", ["i"], buckets=4).groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"train": 14, "val": 3, "test_id": 3, "test_ood": 10}


@pytest.mark.parametrize("mode, exp", [("sequential", [1.0, 2.0]), ("loop", [1.0, 2.0, 1.0, 2.0, 1.0, 2.0])])
def test_replay(spark, mode, exp):
    pool = spark.createDataFrame([("u", "scan", 1.0, 0), ("u", "scan", 2.0, 1), ("u", "benign", 9.0, 2)], "k string, label string, v double, i int")
    steps = spark.createDataFrame([("u", 0), ("u", 1)], "k string, step long")
    out = RP.replay_pool(pool, steps, "k", "label", ["scan"], ["i"], "step", 3, mode).orderBy("step", "draw").collect()
    assert [r["v"] for r in out] == exp


def test_label_precedence():
    assert C.label_precedence(["label", "source_label"], "label", None) == ("source_label", "label")
    assert C.label_precedence(["label"], "label", None) == ("label", "label")
    assert C.label_precedence(["label", "source_label"], "label", "label_normalized") == ("label", "label_normalized")


def test_merge_fills_missing_features_and_keeps_order(spark):
    a = spark.createDataFrame([("1", 1.0)], "record_id string, feat_a double")
    b = spark.createDataFrame([("2", "nan"), ("3", "4")], "record_id string, feat_b string")
    out, filled = M.merge_sources([a, b], ["record_id"])
    assert out.columns == ["feat_a", "feat_b", "record_id"] and filled == {0: ["feat_b"], 1: ["feat_a"]}
    assert sorted(tuple(r) for r in out.collect()) == [(0.0, 0.0, "2"), (0.0, 4.0, "3"), (1.0, 0.0, "1")]


def test_label_maps(spark):
    cells = [("normal", "uavids"), ("Flooding attack", "uavids"), ("WPA2-PSK WIFI Cracking Attack", "ecu_ioft"), ("Reconnassiance", "uav_ndd"), ("Odd Label", "uav_ndd"), (" Reply", "gcs_to_uav_updated")]
    got = [spark.createDataFrame([(c,)], "c string").select(X.map_label(F.col("c"), s)).first()[0] for c, s in cells]
    assert got == ["benign", "flooding", "wpa_cracking", "recon_scanning", "odd_label", "replay"]


def test_mixed_number_cells(spark):
    df = spark.createDataFrame([("0x1F",), (" 2.5 ",), ("abc",), (None,), ("1e3",)], "c string")
    assert [r[0] for r in df.select(X.coerce_number(F.col("c"))).collect()] == [31.0, 2.5, None, None, 1000.0]


@pytest.mark.parametrize("buckets", [1, 8])
@pytest.mark.parametrize("n, size, stride", [(20, 8, 4), (7, 8, 4), (8, 8, 4), (23, 4, 6), (16, 4, 4)])
def test_count_windows_brute_force(spark, buckets, n, size, stride):
    df = spark.createDataFrame([("u", i) for i in range(n)], "g string, i long")
    got = W.count_windows(df, "g", ["i"], size, stride, buckets=buckets).select("window_idx", "window_pos", "i").collect()
    exp = [(w, p, w * stride + p) for w in range(n) if w * stride + size <= n for p in range(size)]
    assert sorted(tuple(r) for r in got) == exp


def test_padding_and_flattening(spark):
    df = spark.createDataFrame([("g", 0, 0, 1.0), ("g", 0, 1, 2.0)], "g string, window_idx int, window_pos int, v double")
    p = W.pack_windows(df, ["g", "window_idx"], ["v"])
    feats = F.transform(W.pad_window(F.col("records"), 3), lambda r: F.array(r["v"]))
    row = p.select(W.flatten_window(feats, W.valid_mask(F.col("records"), 3)).alias("f")).first()
    assert row["f"] == [1.0, 2.0, 0.0, 1.0, 1.0, 0.0]


def test_ambiguous_and_duplicate_rows(spark):
    df = spark.createDataFrame([(1, None, "a", 0), (1, None, "b", 1), (2, None, "a", 2), (2, None, "a", 3)], "x int, y int, label string, i int")
    kept = C.drop_ambiguous(df, ["x", "y"], "label")
    assert sorted(r["i"] for r in kept.collect()) == [2, 3]
    assert [r["i"] for r in C.drop_duplicates_first(kept, ["x", "y", "label"], "i").collect()] == [2]


def test_attribution_metrics_on_planted_records(spark):
    df = spark.createDataFrame([(i, i in (1, 2, 9)) for i in range(1, 11)], "rank int, bad boolean")
    r = {x["k"]: x for x in E.attribution_metrics(df, "rank", "bad", [2, 5]).collect()}
    assert r[2]["precision"] == 1.0 and math.isclose(r[2]["recall"], 2 / 3) and r[5]["analyst_reduction"] == 0.5


def test_resample_reaches_the_target_with_lineage(spark):
    df = spark.createDataFrame([("a", i) for i in range(7)] + [("b", 100), ("b", 101)], "label string, rid int")
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    out = P.resample(df, P.balance_targets(counts, "label", "n", "max"), "label", "rid", 1)
    got = {(r["label"], r["row_origin"]): r["count"] for r in out.groupBy("label", "row_origin").count().collect()}
    assert got == {("a", "real"): 7, ("b", "real"): 2, ("b", "resampled"): 5}
    per = [r["count"] for r in out.where("row_origin = 'resampled'").groupBy("rid").count().collect()]
    assert sorted(per) == [2, 3]


def test_feature_report_of_wide_and_empty_tables(spark):
    names = [f"c{i}" for i in range(12)]
    rows = spark.range(40).select("id", *[(F.col("id") % (i + 1)).cast("double").alias(c) for i, c in enumerate(names)])
    report = C.feature_report(rows, names, ["id"])
    assert {r.column_name: r.unique_count for r in report.collect()} == {c: i + 1 for i, c in enumerate(names)}
    assert "Expand" not in report._jdf.queryExecution().optimizedPlan().toString()
    none = C.feature_report(rows.where("id < 0"), names, ["id"]).collect()
    assert len(none) == 12 and {(r.unique_count, r.numeric_ratio, r.reason) for r in none} == {(0, 0.0, "mostly_non_numeric")}


def test_shares_of_a_count_are_exact(spark):
    df = spark.range(90).withColumn("g", F.lit("a"))
    out = P.chronological_split(df, F.lit(False), ["id"], group="g").groupBy("split").count().collect()
    assert {r["split"]: r["count"] for r in out} == {"train": 63, "val": 13, "test_id": 14}


def test_contributions_equal_to_nine_places_tie(spark):
    rows = [(1, 7, 1.0, 0.5, 0.5), (1, 8, 1.0 + 1e-12, 0.5, 0.5)]
    ev = spark.createDataFrame(rows, "r long, w long, fused double, thr double, att double")
    assert AT.record_suspiciousness(ev, "r", "w", "fused", "thr", "att").first()["window_id"] == 7


def test_division_and_rounding_as_in_sql(spark):
    rows = [(0.0, 0.0), (2.0, 0.0), (-2.0, 0.0), (1.0, 4.0), (None, 0.0)]
    got = [r[0] for r in spark.createDataFrame(rows, "a double, b double").select(ieee_divide(F.col("a"), F.col("b"))).collect()]
    assert math.isnan(got[0]) and got[1:] == [math.inf, -math.inf, 0.25, None]
    rounded = spark.createDataFrame([((0.95 - 25.73) / 1e-6,), (-0.125,), (1e300,), (None,)], "x double")
    assert [r[0] for r in rounded.select(round_double("x", 8)).collect()] == [-24780000.00000001, -0.125, 1e300, None]
