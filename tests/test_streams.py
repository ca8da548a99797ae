"""Stream results equal their batch twins under several micro-batch cuts."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from vigilframe.catalog.streams import mean_in_order
from vigilframe.config import shared_dir
from vigilframe.operators import calibrate as K
from vigilframe.operators import scoring as G
from vigilframe.operators import windows as W
from vigilframe.operators.monitor import score_diagnostics
from vigilframe.streaming import jobs as J
from vigilframe.streaming.micro_batch import CountWindowBatches
from vigilframe.streaming.detection import FusedDetectionBatches, save_snapshot
from vigilframe.streaming.processors import CountedScores, WarmupState
from vigilframe.streaming.records import file_stream, run_to_table
from vigilframe.streaming.state_tables import ScoreDiagnosticsBatches, WarmupBatches

SCHEMA = "record_id long, grp string, ts_us long, label string, value double"


def rows(n=600, seed=0):
    rng = np.random.default_rng(seed)
    t = np.cumsum(rng.integers(1, 4_000_000, n))
    g = np.where(rng.random(n) < 0.4, "hot", rng.choice(["a", "b", "c"], n))
    lab = rng.choice(["view", "view", "view", "error"], n)
    return [(i, str(g[i]), int(t[i]), str(lab[i]), float(np.round(rng.normal(50, 9), 2))) for i in range(n)]


def sliced(spark, data, cuts, name):
    root = shared_dir(spark, name)
    edges = [0, *cuts, len(data)]
    df = spark.createDataFrame(data, SCHEMA)
    for i, (a, b) in enumerate(zip(edges, edges[1:])):
        df.where(F.col("record_id").between(a, b - 1)).coalesce(1).write.parquet(f"{root}/in/s={i}")
    return root, df, file_stream(spark, f"{root}/in/*", df.schema, 1)


def triples(df, key):
    return sorted((str(r[key]), r["window_idx"], r["window_pos"], r["record_id"]) for r in df.collect())


@pytest.mark.parametrize("cuts", [[], [100, 101, 350]])
def test_count_windows(spark, cuts):
    root, df, s = sliced(spark, rows(), cuts, "t1")
    out = run_to_table(J.count_windows(s, F.col("grp"), 8, 3), f"{root}/o", f"{root}/c")
    assert triples(out, "key") == triples(W.count_windows(df, "grp", ["ts_us", "record_id"], 8, 3), "grp")


@pytest.mark.parametrize("cuts, size, stride, buckets", [([], 8, 3, 1), ([5, 100, 101, 350], 8, 3, 4), ([40, 90, 400], 4, 6, 4), ([8, 300], 4, 4, 1)])
def test_micro_batch_count_windows(spark, cuts, size, stride, buckets):
    root, df, s = sliced(spark, rows(), cuts, "t2")
    sink = CountWindowBatches(f"{root}/st", "grp", ["ts_us", "record_id"], size, stride, buckets)
    s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/c").trigger(availableNow=True).start().awaitTermination()
    out = spark.read.parquet(f"{root}/st/out")
    assert triples(out, "grp") == triples(W.count_windows(df, "grp", ["ts_us", "record_id"], size, stride), "grp")


@pytest.mark.parametrize("cuts", [[], [120, 300]])
def test_time_windows(spark, cuts):
    root, df, s = sliced(spark, rows(), cuts, "t3")
    out = run_to_table(J.time_windows(s, F.col("grp"), 60_000_000, 8), f"{root}/o", f"{root}/c")
    assert out.where("kind = 'late'").count() == 0
    assert triples(out, "key") == triples(W.time_windows(df, "grp", "ts_us", "record_id", 60_000_000, 8), "grp")


def test_time_windows_over_a_long_gap(spark):
    data = [(0, "g", 0, "view", 1.0), (1, "g", 10, "view", 1.0), (2, "g", 10_000_003, "view", 1.0), (3, "g", 10_000_100, "view", 1.0)]
    root, df, s = sliced(spark, data, [1, 2, 3], "t4")
    out = run_to_table(J.time_windows(s, F.col("grp"), 20, 8), f"{root}/o", f"{root}/c")
    assert triples(out, "key") == triples(W.time_windows(df, "grp", "ts_us", "record_id", 20, 8), "grp")


def test_warmup_stream_equals_batch(spark):
    rng = np.random.default_rng(3)
    data = [(g, i, float(rng.normal(0, 1)), 0.1, bool(i < cut or rng.random() < 0.5)) for g, cut in (("a", 12), ("b", 0), ("c", 99)) for i in range(40)]
    data = [(g, i, r, c, b and not (g == "b" and i == 0)) for g, i, r, c, b in data]
    df = spark.createDataFrame(data, "key string, window_idx long, raw_score double, calibrated double, benign boolean")
    root = shared_dir(spark, "t5")
    for i in range(4):
        df.where((F.col("window_idx") / 10).cast("int") == i).coalesce(1).write.parquet(f"{root}/in/s={i}")
    s = file_stream(spark, f"{root}/in/*", df.schema, 1)
    cols = ["key", "window_idx", "score", "threshold", "threshold_source", "collecting", "is_ood"]
    for mode in ("normalized", "raw"):
        got = run_to_table(J.warmup_thresholds(s, mode), f"{root}/o{mode}", f"{root}/c{mode}").orderBy("key", "window_idx").toPandas()
        exp = J.warmup_thresholds_batch(df, mode).orderBy("key", "window_idx").toPandas()
        done = ~exp["collecting"]
        assert got["collecting"].tolist() == exp["collecting"].tolist() and got["is_ood"].tolist() == exp["is_ood"].tolist()
        assert got["threshold_source"].tolist() == exp["threshold_source"].tolist()
        assert np.allclose(got.loc[done, "score"], exp.loc[done, "score"])
        assert exp.loc[exp["key"] == "c", "collecting"].any() and set(cols) <= set(got.columns)


def test_warmup_state_machine():
    s = WarmupState([], None, "normalized", 0.95, 1.5, 1e-6)
    for v in (1.0, 2.0, 3.0):
        assert s.step(v, 0.0, True)["collecting"]
    hit = s.step(9.0, 0.0, False)
    assert hit["threshold_source"] == "normalized_static" and hit["threshold"] == 1.5 and hit["is_ood"] and hit["score"] == 7.0
    assert not s.step(2.0, 0.0, True)["collecting"]
    cold = WarmupState([], None, "normalized", 0.95, 1.5, 1e-6).step(1.0, 2.0, False)
    assert cold["threshold_source"] == "normalized_static_no_warmup" and cold["raw_threshold"] is None and cold["is_ood"]
    raw = WarmupState([], None, "raw", 0.95, 1.5, 1e-6).step(1.0, 2.0, False)
    assert raw["threshold_source"] == "no_benign_warmup" and raw["threshold"] is None and not raw["is_ood"]


@pytest.mark.parametrize("cuts", [[], [7, 100, 101, 350, 500]])
def test_adaptive_windows_by_position(spark, cuts):
    """Cut positions over ranges equal the walk of the state machine and the batch form."""
    root, df, s = sliced(spark, rows(), cuts, "t6")
    batch = W.adaptive_windows(df.withColumn("ts", F.col("ts_us") / 1e6), "grp", "ts", ["ts_us", "record_id"], 8, 3, 2, 40, live_cut=True)
    for buckets in (8,) if cuts else (1, 8):
        sink = CountWindowBatches(f"{root}/st{buckets}", "grp", ["ts_us", "record_id"], 8, 3, buckets, adaptive=(2, 40))
        s.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/c{buckets}").trigger(availableNow=True).start().awaitTermination()
        assert triples(spark.read.parquet(f"{root}/st{buckets}/out"), "grp") == triples(batch, "grp")
    walked = run_to_table(J.adaptive_windows(s, F.col("grp"), 8, 3, 2, 40), f"{root}/o", f"{root}/c")
    assert triples(walked, "key") == triples(batch, "grp")


def test_counted_scores():
    rng = np.random.default_rng(4)
    for values in (rng.integers(0, 5, 3000) / 4, rng.normal(size=3000), [2.0]):
        held = CountedScores()
        for v in values:
            held.add(float(v))
        for p in (0, 0.25, 0.5, 0.75, 0.95, 1):
            assert np.isclose(held.quantile(p), np.quantile(values, p))
        again = CountedScores(held.changed.items())
        assert len(again) == len(values) and again.quantile(0.5) == held.quantile(0.5)
        assert len(held.changed) == len(set(values)) == sum(len(b[0]) for b in held.blocks)


def warm_rows():
    rng = np.random.default_rng(5)
    data = [(g, i, float(rng.integers(0, 6)), 0.1, i < cut) for g, cut in (("a", 22), ("b", 0), ("c", 99), ("d", 7), ("e", 40)) for i in range(50)]
    return data + [("late", i, 1.0, 0.1, i != 44) for i in range(40, 50)] + [(None, i, 2.0, 0.3, i < 3) for i in range(6)]


WARM = "key string, window_idx long, raw_score double, calibrated double, benign boolean"


@pytest.mark.parametrize("cuts", [[50], [1, 50], [7, 8, 22, 50], [25, 44, 50], [22, 45, 50]])
def test_warmup_state_tables_equal_batch(spark, cuts):
    df = spark.createDataFrame(warm_rows(), WARM)
    cols = ["key", "window_idx", "score", "threshold", "threshold_source", "collecting", "is_ood"]
    mode, root = ("raw" if len(cuts) == 4 else "normalized"), shared_dir(spark, "warm")
    sink = WarmupBatches(root, mode)
    for epoch, (low, high) in enumerate(zip([0, *cuts], cuts)):
        sink(df.where(F.col("window_idx").between(low, high - 1)), epoch)
    sink(df.where(F.col("window_idx").between(low, high - 1)).repartition(2), epoch)  # a replayed epoch repeats its result
    got = sorted(spark.read.parquet(f"{root}/out").select(cols).collect(), key=str)
    assert got == sorted(J.warmup_thresholds_batch(df, mode).select(cols).collect(), key=str)
    # what is kept: different scores of collecting keys, and one row for each frozen key
    last = len(cuts) - 1
    assert spark.read.parquet(f"{root}/counts/epoch={last}").groupBy("key").count().where("count > 6 or key <> 'c'").count() == 0
    assert spark.read.parquet(f"{root}/frozen/epoch={last}").count() == 6


def test_idle_keys_are_forgotten(spark):
    df = spark.createDataFrame(warm_rows(), WARM)
    root = shared_dir(spark, "idle")
    sink = WarmupBatches(root, keep=2)
    sink(df.where("key = 'a' or key = 'c'"), 0)
    for epoch in (1, 2):
        sink(df.where("key = 'b'"), epoch)
    assert [r.key for r in spark.read.parquet(f"{root}/frozen/epoch=2").collect()] == ["b"] and spark.read.parquet(f"{root}/counts/epoch=2").count() == 0


@pytest.mark.parametrize("cuts", [[1, 300, 600]])
def test_score_diagnostics_of_a_stream(spark, cuts):
    df = spark.createDataFrame(rows(), SCHEMA).withColumn("norm", F.round(F.col("value") / 3)).withColumn(
        "value", F.when(F.col("record_id") % 9 > 0, F.col("value"))
    )
    args = ("grp", "value", "norm", F.col("label") == "view", F.col("record_id") % 5 == 0)
    root = shared_dir(spark, "diag")
    sink = ScoreDiagnosticsBatches(root, *args)
    for epoch, (low, high) in enumerate(zip([0, *cuts], cuts)):
        sink(df.where(F.col("record_id").between(low, high - 1)), epoch)
    got = spark.read.parquet(f"{root}/out")
    names = [c for c in got.columns if c not in ("grp", "epoch")]
    last = got.groupBy("grp").agg(F.max_by(F.struct(*names), "epoch").alias("r")).select("grp", "r.*").orderBy("grp").toPandas()
    want = score_diagnostics(df, *args).orderBy("grp").toPandas()[last.columns]
    assert len(last) == 4 and np.allclose(last.drop(columns="grp").astype(float), want.drop(columns="grp").astype(float), equal_nan=True)


def test_fused_rows_equal_batch(spark):
    """Windows of several epochs, scored by the model version at hand, equal fusion and warm-up over all of them; empty windows never alert."""
    rng = np.random.default_rng(6)
    vec = lambda i: None if 200 <= i < 212 else [float(x) for x in rng.normal(i % 3, 1, 6)]
    data = [(i, "hot" if i % 5 < 3 or 190 < i < 220 else "b", i % 3, i > 150 and i % 7 == 0, vec(i)) for i in range(300)]
    df = spark.createDataFrame(data, "id long, g string, label int, ood boolean, vec array<double>")
    known = df.where("vec is not null")
    model = G.fit_prototypes(known, "vec", F.array("label"), [0, 1, 2], precision=False)
    raw = G.raw_scores(known, ["id"], "vec", model, known.select("vec"), "vec")
    cal = K.fit_calibration(raw, "mean")
    root = shared_dir(spark, "fused")
    for version in (1, 2):
        save_snapshot(spark, f"{root}/models", version, model, cal, known)
    sink = FusedDetectionBatches(f"{root}/s", f"{root}/models", "g", ["id"], 4, 2, "vec", "id", benign=~F.col("ood"), ood=F.lit(False))
    for epoch, (low, high) in enumerate([(0, 209), (209, 300)]):
        sink(df.where(F.col("id").between(low, high - 1)), epoch)
    got = spark.read.parquet(f"{root}/s/out")
    long = W.count_windows(df, "g", ["id"], 4, 2)
    sums = long.where("vec is not null").select("g", "window_idx", F.posexplode("vec").alias("i", "x")).groupBy("g", "window_idx", "i").agg(F.avg("x").alias("x"))
    packed = sums.groupBy("g", "window_idx").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"]).alias("vec"))
    fused = K.apply_calibration(G.raw_scores(packed, ["g", "window_idx"], "vec", model, known.select("vec"), "vec"), cal)
    truth = long.groupBy("g", "window_idx").agg(F.bool_and(~F.col("ood")).alias("benign"))
    fused = fused.join(truth, ["g", "window_idx"]).withColumn("raw_score", (F.col("conf") + F.col("energy") + F.col("proto") + F.col("knn")) / 4)
    warm = J.warmup_thresholds_batch(fused.select(F.col("g").alias("key"), "window_idx", "raw_score", F.col("fused").alias("calibrated"), "benign"))
    want = {(r.key, r.window_idx): r for r in warm.join(fused.select(F.col("g").alias("key"), "window_idx", "fused", "dominant_source"), ["key", "window_idx"]).collect()}
    seen = got.collect()
    assert len(seen) == truth.count() and {r.model_version for r in seen} == {2}
    for r in seen:
        if r.degenerate:
            assert (r.key, r.window_idx) not in want and not r.has_alert and r.fused is None
            continue
        w = want[r.key, r.window_idx]
        assert np.isclose(r.fused, w.fused) and r.dominant_source == w.dominant_source and r.is_ood == w.is_ood and r.collecting == w.collecting
        assert (r.score is None) == (w.score is None) and (r.score is None or np.isclose(r.score, w.score))
    assert any(r.degenerate for r in seen) and any(r.is_ood for r in seen)


WARM = "key string, window_idx long, raw_score double, calibrated double, benign boolean"
# the last score is 1.5 but for its last places
AT_THRESHOLD = [("a", i, v, 0.0, i < 3) for i, v in enumerate([0.1, 0.2, 0.3, 0.35000000000000003])]


def test_a_score_at_the_threshold_is_not_above_it(spark):
    out = J.warmup_thresholds_batch(spark.createDataFrame(AT_THRESHOLD, WARM)).where("not collecting").first()
    assert out["score"] > 1.5 and out["score"] - 1.5 < 1e-9 and not out["is_ood"]


def test_state_tables_at_the_threshold(spark):
    out = WarmupBatches(shared_dir(spark, "t12")).step(spark.createDataFrame(AT_THRESHOLD, WARM), 0).where("not collecting").first()
    assert out["score"] > 1.5 and not out["is_ood"]


def test_window_means_add_in_order(spark):
    rows = [(i, v) for i, v in enumerate([0.1, 0.2, 0.3, 1e16])]
    for order in (rows, rows[::-1]):
        got = spark.createDataFrame(order, "p long, v double").agg(mean_in_order("v", "p", 4)).first()[0]
        assert got == (((0.1 + 0.2) + 0.3) + 1e16) / 4


def test_state_machine_at_the_threshold():
    s = WarmupState([], None, "normalized", 0.95, 1.5, 1e-6)
    out = [s.step(raw, cal, benign) for _, _, raw, cal, benign in AT_THRESHOLD][-1]
    assert out["score"] > 1.5 and not out["is_ood"]
