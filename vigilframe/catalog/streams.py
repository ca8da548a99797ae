"""Streaming queries. Each one feeds the events through a file stream in several micro-batches."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from vigilframe.catalog.calibration import _FUSED, score_table
from vigilframe.catalog.monitoring import uav_detections
from vigilframe.catalog.registry import SQL, query
from vigilframe.catalog.views import REC, VECTOR_CLASSES, count_window_sql, r6, records, round_double, vectors
from vigilframe.catalog.windows import _adaptive_sql
from vigilframe.config import materialize, shared_dir
from vigilframe.functions.fixed import SCORE_NAMES
from vigilframe.operators import calibrate as K
from vigilframe.operators import scoring as G
from vigilframe.operators import windows as W
from vigilframe.streaming import jobs as J
from vigilframe.streaming.detection import FusedDetectionBatches, save_snapshot
from vigilframe.streaming.micro_batch import CountWindowBatches
from vigilframe.streaming.state_tables import ScoreDiagnosticsBatches, WarmupBatches
from vigilframe.streaming.records import file_stream, run_to_table, state_partitions, stream_key

ORDER = ["ts_us", "record_id"]
# borders of the micro-batches, inside January 2024
CUTS = [1704067200000000 + d * 86400000000 for d in (9, 18)]


# files of a slice, read as one micro-batch
FILES = 4


def write_slices(parts, root):
    """A folder per arrival slice, oldest first; rows lie in the files in no order."""
    for i, part in enumerate(parts):
        part.repartition(FILES).write.parquet(f"{root}/slice={i}")


def record_files(spark, sf, root):
    """The record view as one folder per arrival slice."""
    r = records(spark, sf)
    edges = [None, *CUTS, None]
    parts = []
    for low, high in zip(edges, edges[1:]):
        part = r if low is None else r.where(F.col("ts_us") >= low)
        parts.append(part if high is None else part.where(F.col("ts_us") < high))
    write_slices(parts, root)
    return r.schema


def record_stream(spark, sf, name):
    root = shared_dir(spark, name)
    schema = record_files(spark, sf, f"{root}/in")
    return root, file_stream(spark, f"{root}/in/*", schema, files_per_trigger=FILES)


def _sink(root, stream, sink):
    """Run a ``foreachBatch`` sink over everything available and read its output."""
    writer = stream.writeStream.foreachBatch(sink).option("checkpointLocation", f"{root}/ckpt").trigger(availableNow=True)
    writer.start().awaitTermination()
    return stream.sparkSession.read.parquet(f"{sink.root}/out")


def _run(root, stream):
    cores = stream.sparkSession.sparkContext.defaultParallelism
    return run_to_table(stream, f"{root}/out", f"{root}/ckpt", partitions=cores)


def _windows(df):
    return df.where("kind = 'window'").select(F.col("key").cast("long").alias("grp"), "window_idx", "window_pos", "record_id")


_W2 = (
    f"WITH {count_window_sql(8, 4)} SELECT grp, CAST(window_idx AS BIGINT) AS window_idx, "
    "CAST(window_pos AS BIGINT) AS window_pos, record_id FROM win"
)


@query("st01_stream_count_windows", _W2)
def stream_count_windows(spark, sf):
    root, s = record_stream(spark, sf, "st01")
    out = _sink(root, s, CountWindowBatches(f"{root}/state", "grp", ORDER, 8, 4))
    return out.select("grp", "window_idx", "window_pos", "record_id")


@query("st01_stream_adaptive_windows", _adaptive_sql(True))
def stream_adaptive_windows(spark, sf):
    root, s = record_stream(spark, sf, "st01a")
    out = _sink(root, s, CountWindowBatches(f"{root}/state", "grp", ORDER, 8, 4, adaptive=(4, 32)))
    return out.select("grp", "window_idx", "window_pos", "record_id")


@query("st01_micro_batch_count_windows", _W2)
def micro_batch_count_windows(spark, sf):
    """With forced ranges, as large tables take them."""
    root, s = record_stream(spark, sf, "st01m")
    out = _sink(root, s, CountWindowBatches(f"{root}/state", "grp", ORDER, 8, 4, buckets=8))
    return out.select("grp", "window_idx", "window_pos", "record_id")


@query("st01_keyed_state_count_windows", _W2)
def keyed_state_count_windows(spark, sf):
    """The same windows from a state machine per key."""
    root, s = record_stream(spark, sf, "st01k")
    return _windows(_run(root, J.count_windows(s, stream_key("grp"), 8, 4)))


_W3 = f"""WITH {REC}, b AS (SELECT grp, min(ts_us) AS t0, max(ts_us) AS t1 FROM rec GROUP BY grp),
    k AS (SELECT rec.*, t0, t1, CAST(floor((ts_us - t0) / 43200000000.0) AS BIGINT) AS hop FROM rec JOIN b USING (grp)),
    w AS (SELECT k.*, u.w AS window_idx FROM k, LATERAL (SELECT unnest([hop - 1, hop]) AS w) u WHERE u.w >= 0),
    d AS (SELECT *, row_number() OVER (PARTITION BY grp, window_idx ORDER BY ts_us, record_id) - 1 AS window_pos
          FROM w WHERE t1 >= t0 + window_idx * 43200000000 + 86400000000)
    SELECT grp, window_idx, CAST(window_pos AS BIGINT) AS window_pos, record_id FROM d WHERE window_pos < 8"""
DAY = 24 * 3600 * 1_000_000


@query("st02_stream_time_windows", _W3)
def stream_time_windows(spark, sf):
    root, s = record_stream(spark, sf, "st02")
    return _windows(_run(root, J.time_windows(s, stream_key("grp"), DAY, 8)))


@query(
    "st02_epoch_windows",
    f"""WITH {REC}, w AS (SELECT grp, value, u.s * 43200000000 AS start_us FROM rec, LATERAL (SELECT unnest([ts_us // 43200000000 - 1,
      ts_us // 43200000000]) AS s) u),
    m AS (SELECT max(ts_us) - 86400000000 AS wm FROM rec)
    SELECT grp, start_us, count(*) AS records, round(avg(value), 6) AS mean_value FROM w, m
    WHERE start_us + 86400000000 <= wm GROUP BY ALL""",
)
def epoch_windows(spark, sf):
    root, s = record_stream(spark, sf, "st02e")
    stamped = s.withColumn("ts", F.timestamp_micros("ts_us"))
    out = _run(root, J.epoch_windows(stamped, "ts", "grp", "24 hours", "12 hours", "24 hours"))
    return out.withColumn("mean_value", r6("mean_value"))


@query(
    "st03_late_records",
    f"""WITH {REC}, b AS (SELECT grp, max(ts_us) AS t1, min(ts_us) AS t0 FROM rec WHERE ts_us >= {CUTS[0]} GROUP BY grp)
    SELECT rec.grp, count(*) AS late FROM rec JOIN b ON rec.grp = b.grp WHERE ts_us < {CUTS[0]} AND ts_us < t0 GROUP BY 1""",
)
def late_records(spark, sf):
    """The oldest slice arrives last: its records precede every open window."""
    root = shared_dir(spark, "st03")
    r = records(spark, sf)
    write_slices([r.where(F.col("ts_us") >= CUTS[0]), r.where(F.col("ts_us") < CUTS[0])], f"{root}/in")
    s = file_stream(spark, f"{root}/in/*", r.schema, files_per_trigger=FILES)
    out = _run(root, J.time_windows(s, stream_key("grp"), DAY, 8))
    return out.where("kind = 'late'").groupBy(F.col("key").cast("long").alias("grp")).agg(F.count(F.lit(1)).alias("late"))


@query(
    "st04_global_stream_key",
    f"""WITH {REC}, k AS (SELECT CASE WHEN k < 50 THEN '__stream__global__' ELSE CAST(grp AS VARCHAR) END AS key, record_id, ts_us FROM rec),
    n AS (SELECT key, count(*) AS n FROM k GROUP BY 1)
    SELECT key, CAST(n // 8 AS BIGINT) AS windows FROM n WHERE n >= 8""",
)
def global_stream_key(spark, sf):
    root, s = record_stream(spark, sf, "st04")
    keyed = s.withColumn("g", F.when(F.col("k") >= 50, F.col("grp").cast("string")).otherwise(" "))
    out = _sink(root, keyed.withColumn("key", stream_key("g")), CountWindowBatches(f"{root}/state", "key", ORDER, 8, 8))
    return out.groupBy("key").agg(F.count_distinct("window_idx").alias("windows"))


# benign = the window is mostly ordinary traffic, so a warm-up phase exists
_WIN = REC + """,
p AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts_us, record_id) - 1 AS p,
      count(*) OVER (PARTITION BY grp) AS n FROM rec),
w AS (SELECT CAST(grp AS VARCHAR) AS key, CAST(p // 4 AS BIGINT) AS window_idx, avg(value) AS raw_score,
  sum(CASE WHEN label = 'error' THEN 1 ELSE 0 END) <= 1 AS benign FROM p WHERE (p // 4) * 4 + 4 <= n GROUP BY ALL)"""


def _warm_sql(mode: str) -> str:
    score = "raw_score" if mode == "raw" else "CASE WHEN m IS NULL THEN raw_score / 100 ELSE (raw_score - m) / i END"
    thr = "t" if mode == "raw" else "1.5"
    names = ("warmup_raw_quantile", "no_benign_warmup") if mode == "raw" else ("normalized_static", "normalized_static_no_warmup")
    return f"""WITH {_WIN}, f AS (SELECT key, min(window_idx) FILTER (NOT benign) AS fz FROM w GROUP BY 1),
    s AS (SELECT w.key, quantile_cont(raw_score, 0.5) AS m, greatest(quantile_cont(raw_score, 0.75) - quantile_cont(raw_score, 0.25), 1e-6)
      AS i, quantile_cont(raw_score, 0.95) AS t FROM w JOIN f ON w.key = f.key WHERE window_idx < fz GROUP BY 1),
    j AS (SELECT w.*, fz IS NULL OR window_idx < fz AS collecting, m, i, t FROM w JOIN f ON w.key = f.key LEFT JOIN s ON w.key = s.key)
    SELECT key, window_idx, round(raw_score, 5) AS raw_score, collecting, CASE WHEN collecting THEN 'warmup_collecting'
      WHEN m IS NOT NULL THEN '{names[0]}' ELSE '{names[1]}' END AS threshold_source,
      CASE WHEN NOT collecting THEN round({score}, 8) END AS score,
      coalesce(NOT collecting AND round({score}, 9) > round({thr}, 9), false) AS is_ood FROM j"""


def mean_in_order(value, pos, size):
    """Mean of a window of a few doubles, added in the order of their positions: other orders differ in the last place."""
    total = F.lit(0.0)
    for i in range(size):
        total = total + F.coalesce(F.max(F.when(F.col(pos) == i, F.col(value))), F.lit(0.0))
    return F.try_divide(total, F.count(value))


def warm_windows(spark, sf):
    long = W.count_windows(records(spark, sf), "grp", ORDER, 4, 4)
    return long.groupBy(F.col("grp").cast("string").alias("key"), "window_idx").agg(
        mean_in_order("value", "window_pos", 4).alias("raw_score"),
        (F.count_if(F.col("label") == "error") <= 1).alias("benign"),
    ).withColumn("calibrated", F.col("raw_score") / 100)


def _warm_out(df):
    return df.select(
        "key", "window_idx", F.round("raw_score", 5).alias("raw_score"), "collecting", "threshold_source",
        round_double("score", 8).alias("score"), "is_ood",
    )


def _warm_stream(spark, sf, name):
    root = shared_dir(spark, name)
    w = warm_windows(spark, sf)
    write_slices([w.where(c) for c in (F.col("window_idx") < 5, F.col("window_idx").between(5, 9), F.col("window_idx") > 9)], f"{root}/in")
    return root, file_stream(spark, f"{root}/in/*", w.schema, files_per_trigger=FILES)


@query("st05_warmup_stream", _warm_sql("normalized"))
def warmup_stream(spark, sf):
    root, s = _warm_stream(spark, sf, "st05")
    return _warm_out(_run(root, J.warmup_thresholds(s, "normalized")))


@query("st05_warmup_state_tables", _warm_sql("normalized"))
def warmup_state_tables(spark, sf):
    root, s = _warm_stream(spark, sf, "st05t")
    return _warm_out(_sink(root, s, WarmupBatches(f"{root}/state")))


@query("st05_warmup_batch", _warm_sql("normalized"))
def warmup_batch(spark, sf):
    return _warm_out(J.warmup_thresholds_batch(warm_windows(spark, sf)))


@query("st06_raw_score_selection", _warm_sql("raw"))
def raw_score_selection(spark, sf):
    root, s = _warm_stream(spark, sf, "st06")
    return _warm_out(_run(root, J.warmup_thresholds(s, "raw")))


@query("st06_raw_state_tables", _warm_sql("raw"))
def raw_state_tables(spark, sf):
    root, s = _warm_stream(spark, sf, "st06t")
    return _warm_out(_sink(root, s, WarmupBatches(f"{root}/state", "raw")))


def mean_score(x):
    return x.mean()


@query(
    "st07_online_detection",
    f"""WITH {_WIN}, v AS (SELECT CAST(grp AS VARCHAR) AS key, CAST(p // 4 AS BIGINT) AS window_idx, min(p) AS p0, avg(value) AS raw,
      bool_and(label = 'view') AS allb, bool_or(label = 'error') AS ood, count(*) FILTER (label <> 'view') AS attack_records,
      max(value) > 150 AS known FROM p WHERE (p // 4) * 4 + 4 <= n GROUP BY ALL),
    f AS (SELECT key, min(window_idx) FILTER (NOT allb) AS fz FROM v GROUP BY 1),
    s AS (SELECT v.key, quantile_cont(raw, 0.5) AS m, greatest(quantile_cont(raw, 0.75) - quantile_cont(raw, 0.25), 1e-6) AS i
      FROM v JOIN f ON v.key = f.key WHERE window_idx < fz GROUP BY 1),
    j AS (SELECT v.*, fz IS NULL OR window_idx < fz AS collecting, CASE WHEN m IS NULL THEN raw ELSE (raw - m) / i END AS sc, m
      FROM v JOIN f ON v.key = f.key LEFT JOIN s ON v.key = s.key),
    o AS (SELECT *, NOT collecting AND round(sc, 9) > 1.5 AS is_ood FROM j)
    SELECT key, window_idx, round(raw, 5) AS raw_score, is_ood, known OR is_ood AS has_alert,
      (known OR is_ood) AND allb AS false_alert, CASE WHEN known AND is_ood THEN 'known_attack+ood' WHEN known THEN 'known_attack'
      WHEN is_ood THEN 'ood' ELSE 'none' END AS alert_reason, CASE WHEN is_ood AND round(sc, 9) - 1.5 >= 1 THEN 'critical' WHEN is_ood OR known
      THEN 'warning' ELSE 'normal' END AS alert_level, CASE WHEN ood THEN 'ood' WHEN NOT allb THEN 'attack' ELSE 'benign' END AS
      window_partition, attack_records, CASE WHEN collecting THEN 'warmup_collecting' WHEN m IS NULL THEN 'normalized_static_no_warmup'
      ELSE 'normalized_static' END AS threshold_source FROM o""",
)
def online_detection(spark, sf):
    root, s = record_stream(spark, sf, "st07")
    out = _run(root, J.online_detection(s, stream_key("grp"), 4, 4, "view", "error", mean_score, 150.0))
    return out.select(
        "key", "window_idx", F.round("raw_score", 5).alias("raw_score"), "is_ood", "has_alert", "false_alert", "alert_reason",
        "alert_level", "window_partition", "attack_records", "threshold_source",
    )


# windows of four vectors per group, scored against the model of the known classes' single vectors
_FUSED_ROWS = _FUSED + """,
pv AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY vec_id) - 1 AS p, count(*) OVER (PARTITION BY grp) AS n FROM vec),
wm AS (SELECT grp, CAST(p // 4 AS BIGINT) AS window_idx, count(*) FILTER (label >= 6) AS attack_records, bool_or(truth_ood) AS truth_ood FROM pv
  WHERE (p // 4) * 4 + 4 <= n GROUP BY ALL),
wl AS (SELECT grp, window_idx, i, avg(x) AS m FROM (SELECT grp, CAST(p // 4 AS BIGINT) AS window_idx, unnest(v) AS x,
  generate_subscripts(v, 1) AS i FROM pv WHERE (p // 4) * 4 + 4 <= n) GROUP BY ALL),
wv AS (SELECT grp, window_idx, list(m ORDER BY i) AS v FROM wl GROUP BY ALL),
wz AS (SELECT grp, window_idx, 4.0 * list_dot_product(v, mu) AS z, list_distance(v, mu) AS dist FROM wv, proto),
wb AS (SELECT grp, window_idx, 1 - max(1 / (1 + exp(-z))) AS conf, -(max(z) + ln(sum(exp(z - zm)))) AS energy, min(dist) AS proto
  FROM (SELECT *, max(z) OVER (PARTITION BY grp, window_idx) AS zm FROM wz) GROUP BY ALL),
wk AS (SELECT grp, window_idx, -avg(s) AS knn FROM (SELECT a.grp, a.window_idx, list_cosine_similarity(a.v, b.v) AS s,
  row_number() OVER (PARTITION BY a.grp, a.window_idx ORDER BY list_cosine_similarity(a.v, b.v) DESC) AS rn FROM wv a, vec b WHERE b.label < 8)
  WHERE rn <= 5 GROUP BY ALL),
wr AS (SELECT wb.*, knn, attack_records, truth_ood, attack_records = 0 AND NOT truth_ood AS benign, """ + ", ".join(
    f"({n} - m_{n}) / i_{n} AS n_{n}" for n in SCORE_NAMES
) + """ FROM wb JOIN wk USING (grp, window_idx) JOIN wm USING (grp, window_idx), rs),
wf AS (SELECT *, (n_conf + n_energy + n_proto + n_knn) / 4 AS fused, (conf + energy + proto + knn) / 4 AS raw_score FROM wr),
we AS (SELECT grp, min(window_idx) FILTER (NOT benign) AS fz FROM wf GROUP BY 1),
ws AS (SELECT grp, quantile_cont(raw_score, 0.5) AS md, greatest(quantile_cont(raw_score, 0.75) - quantile_cont(raw_score, 0.25), 1e-6) AS iq
  FROM wf JOIN we USING (grp) WHERE window_idx < fz GROUP BY 1)
SELECT CAST(wf.grp AS VARCHAR) AS key, window_idx, round(conf, 5) AS conf, round(energy, 5) AS energy, round(proto, 5) AS proto, round(knn, 5) AS knn,
  round(fused, 3) AS fused, CASE greatest(n_conf, n_energy, n_proto, n_knn) WHEN n_conf THEN 'conf' WHEN n_energy THEN 'energy'
    WHEN n_proto THEN 'proto' ELSE 'knn' END AS dominant_source,
  fz IS NULL OR window_idx < fz AS collecting, CASE WHEN truth_ood THEN 'ood' WHEN attack_records > 0 THEN 'attack' ELSE 'benign' END AS window_partition,
  CASE WHEN fz IS NULL OR window_idx < fz THEN 'warmup_collecting' WHEN md IS NULL THEN 'normalized_static_no_warmup' ELSE 'normalized_static' END
    AS threshold_source, CASE WHEN NOT (fz IS NULL OR window_idx < fz) THEN round(CASE WHEN md IS NULL THEN fused ELSE (raw_score - md) / iq END, 2) END AS score
FROM wf JOIN we USING (grp) LEFT JOIN ws USING (grp)"""


@query("st07_fused_rows", f"WITH {_FUSED_ROWS}")
def fused_rows(spark, sf):
    root = shared_dir(spark, "st07f")
    v = vectors(spark, sf)
    known = v.where(F.col("label") < 8)
    model = G.fit_prototypes(known, "vec", F.array("label"), VECTOR_CLASSES, precision=False, scale=4.0)
    cal = K.fit_calibration(materialize(score_table(spark, sf).where(~F.col("truth_ood")), "scores"), "mean")
    save_snapshot(spark, f"{root}/models", 1, model, cal, known)
    third = F.ntile(3).over(Window.partitionBy("grp").orderBy("vec_id"))
    sliced = materialize(v.withColumn("slice", third), "slices")
    write_slices([sliced.where(F.col("slice") == i).drop("slice") for i in (1, 2, 3)], f"{root}/in")
    stream = file_stream(spark, f"{root}/in/*", v.schema, files_per_trigger=FILES)
    sink = FusedDetectionBatches(
        f"{root}/state", f"{root}/models", "grp", ["vec_id"], 4, 4, "vec", "vec_id", benign=F.col("label") < 6, ood=F.col("truth_ood")
    )
    out = _sink(root, stream, sink)
    return out.select(
        "key", "window_idx", *[F.round(n, 5).alias(n) for n in SCORE_NAMES], F.round("fused", 3).alias("fused"), "dominant_source", "collecting",
        "window_partition", "threshold_source", F.round("score", 2).alias("score"),
    )


@query(
    "st08_degenerate_windows",
    f"""WITH {REC}, d AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts_us, record_id) - 1 AS p,
      count(*) OVER (PARTITION BY grp) AS n FROM rec)
    SELECT CAST(grp AS VARCHAR) AS key, CAST(p // 2 AS BIGINT) AS window_idx, bool_and(label IN ('error', 'click')) AS degenerate,
      bool_and(label IN ('error', 'click')) AS no_score FROM d WHERE (p // 2) * 2 + 2 <= n GROUP BY ALL""",
)
def degenerate_windows(spark, sf):
    root, s = record_stream(spark, sf, "st08")
    gaps = s.withColumn("value", F.when(~F.col("label").isin("error", "click"), F.col("value")))
    out = _run(root, J.online_detection(gaps, stream_key("grp"), 2, 2, "view", "error", mean_score, 1e9))
    return out.select("key", "window_idx", "degenerate", F.col("raw_score").isNull().alias("no_score"))


@query(
    "st09_ground_truth",
    f"""WITH {count_window_sql(8, 4)} SELECT grp, CAST(window_idx AS BIGINT) AS window_idx,
      string_agg(DISTINCT label, ',' ORDER BY label) AS labels,
      coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label <> 'view'), '') AS attack_types,
      count(*) FILTER (label = 'view') AS benign_records, count(*) FILTER (label NOT IN ('view', 'error')) AS attack_records,
      count(*) FILTER (label = 'error') AS ood_records, count(*) AS truth_records, bool_or(label <> 'view') AS attack_active, bool_or(label = 'error') AS is_ood
    FROM win GROUP BY ALL""",
)
def ground_truth(spark, sf):
    long = W.count_windows(records(spark, sf), "grp", ORDER, 8, 4)
    packed = W.pack_windows(long, ["grp", "window_idx"], ["record_id", "label"])
    g = J.ground_truth(packed, ["grp", "window_idx"], "view", "error")
    g = g.withColumn("truth_records", F.size("truth_records"))
    return g.withColumns({c: F.col(c).cast("long") for c in ("benign_records", "attack_records", "ood_records", "truth_records")})


@query(
    "st10_split_keyed_replay",
    f"""WITH {REC}, k AS (SELECT grp, CASE WHEN label = 'error' THEN 'test_ood' ELSE 'test_id' END AS split, record_id, ts_us FROM rec),
    p AS (SELECT *, row_number() OVER (PARTITION BY grp, split ORDER BY ts_us, record_id) - 1 AS p,
      count(*) OVER (PARTITION BY grp, split) AS n FROM k)
    SELECT split || ':' || grp AS key, CAST(p // 4 AS BIGINT) AS window_idx, CAST(p % 4 AS BIGINT) AS window_pos, record_id FROM p
    WHERE (p // 4) * 4 + 4 <= n""",
)
def split_keyed_replay(spark, sf):
    root, s = record_stream(spark, sf, "st10")
    split = F.when(F.col("label") == "error", "test_ood").otherwise("test_id")
    keyed = s.withColumn("key", F.concat_ws(":", split, F.col("grp").cast("string")))
    out = _sink(root, keyed, CountWindowBatches(f"{root}/state", "key", ORDER, 4, 4))
    return out.select("key", "window_idx", "window_pos", "record_id")


@query(
    "st11_continuous_drift",
    f"""WITH {REC}, c AS (SELECT grp, value AS x FROM rec UNION ALL SELECT grp, k FROM rec)
    SELECT grp, count(*) // 2 AS rows, round(avg(x), 8) AS mean, round(stddev_pop(x), 5) AS std,
      round(count(*) FILTER (x = 0) / count(*), 6) AS zero_ratio FROM c GROUP BY grp""",
)
def continuous_drift(spark, sf):
    root, s = record_stream(spark, sf, "st11")
    drift = J.continuous_drift(s, "grp", ["value", "k"])

    def keep_latest(batch, epoch):
        batch.withColumn("epoch", F.lit(epoch)).write.mode("overwrite").parquet(f"{root}/out/batch={epoch}")

    writer = (
        drift.writeStream.outputMode("update").foreachBatch(keep_latest).option("checkpointLocation", f"{root}/ckpt")
        .trigger(availableNow=True)
    )
    with state_partitions(spark, spark.sparkContext.defaultParallelism):
        writer.start().awaitTermination()
    rows = spark.read.parquet(f"{root}/out")
    last = rows.groupBy("grp").agg(F.max_by(F.struct("rows", "mean", "std", "zero_ratio"), "epoch").alias("r")).select("grp", "r.*")
    return last.select("grp", "rows", F.round("mean", 8).alias("mean"), F.round("std", 5).alias("std"), r6("zero_ratio").alias("zero_ratio"))


@query("st11_score_diagnostics", SQL["a50_score_diagnostics"])
def stream_score_diagnostics(spark, sf):
    """The last update of each group equals the batch table."""
    root = shared_dir(spark, "st11s")
    d = uav_detections(spark, sf).select("grp", "ts_us", "raw_ood_score", "ood_score", "label", "k")
    write_slices([d.where(F.col("ts_us") < CUTS[0]), d.where((F.col("ts_us") >= CUTS[0]) & (F.col("ts_us") < CUTS[1])), d.where(F.col("ts_us") >= CUTS[1])], f"{root}/in")
    s = file_stream(spark, f"{root}/in/*", d.schema, files_per_trigger=FILES)
    sink = ScoreDiagnosticsBatches(f"{root}/state", "grp", "raw_ood_score", "ood_score", F.col("label") == "view", F.col("k") == 0)
    rows = _sink(root, s, sink)
    names = [c for c in rows.columns if c not in ("grp", "epoch")]
    last = rows.groupBy("grp").agg(F.max_by(F.struct(*names), "epoch").alias("r")).select("grp", "r.*")
    return last.select(*[r6(c).alias(c) if t == "double" else c for c, t in last.dtypes])
