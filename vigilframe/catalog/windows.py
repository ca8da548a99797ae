"""Window operators on the record view."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.catalog.registry import query
from vigilframe.catalog.views import ID_CLASSES, POS, REC, count_window_sql, r6, records
from vigilframe.functions.fixed import WINDOW_SETTINGS
from vigilframe.operators import windows as W
from vigilframe.operators.ordering import previous

ORDER = ["ts_us", "record_id"]


@query(
    "w01_group_time_order",
    f"WITH {POS} SELECT record_id, grp, CAST(p AS BIGINT) AS pos, CAST(n AS BIGINT) AS n FROM pos",
)
def group_time_order(spark, sf):
    from vigilframe.operators.ordering import position

    return position(records(spark, sf), ["grp"], ORDER, "pos", size_name="n").select("record_id", "grp", "pos", "n")


@query(
    "w02_count_windows",
    f"WITH {count_window_sql(8, 4)} SELECT grp, CAST(window_idx AS BIGINT) AS window_idx, "
    "CAST(window_pos AS BIGINT) AS window_pos, record_id FROM win",
)
def count_windows(spark, sf):
    return W.count_windows(records(spark, sf), "grp", ORDER, 8, 4).select(
        "grp", "window_idx", "window_pos", "record_id"
    )


@query(
    "w03_time_windows",
    f"""WITH {REC}, b AS (SELECT grp, min(ts_us) AS t0, max(ts_us) AS t1 FROM rec GROUP BY grp),
    k AS (SELECT rec.*, t0, t1, CAST(floor((ts_us - t0) / 43200000000.0) AS BIGINT) AS hop FROM rec JOIN b USING (grp)),
    w AS (SELECT k.*, u.w AS window_idx FROM k, LATERAL (SELECT unnest([hop - 1, hop]) AS w) u WHERE u.w >= 0),
    d AS (SELECT *, row_number() OVER (PARTITION BY grp, window_idx ORDER BY ts_us, record_id) - 1 AS window_pos
          FROM w WHERE t1 >= t0 + window_idx * 43200000000 + 86400000000)
    SELECT grp, window_idx, CAST(window_pos AS BIGINT) AS window_pos, record_id FROM d WHERE window_pos < 8""",
)
def time_windows(spark, sf):
    day = 24 * 3600 * 1_000_000
    return W.time_windows(records(spark, sf), "grp", "ts_us", "record_id", day, 8).select(
        "grp", "window_idx", "window_pos", "record_id"
    )


def _adaptive_sql(live: bool) -> str:
    cut = "least(len, 8)" if live else "len"
    return f"""WITH {POS},
    s AS (SELECT a.grp, a.p AS p0, greatest((b.ts_us - a.ts_us) / 1e6, 1e-6) AS span
          FROM pos a JOIN pos b ON a.grp = b.grp AND b.p = a.p + 7 WHERE a.p % 4 = 0),
    l AS (SELECT grp, p0, CAST(floor(least(greatest(8.0 * (1 + 0.5 / greatest(8.0 / span, 1e-6)), 4.0), 32.0)) AS BIGINT)
          AS len FROM s)
    SELECT l.grp, CAST(p0 // 4 AS BIGINT) AS window_idx, CAST(pos.p - p0 AS BIGINT) AS window_pos, record_id
    FROM l JOIN pos ON pos.grp = l.grp AND pos.p >= p0 AND pos.p < p0 + {cut}"""


@query("w04_adaptive_windows", _adaptive_sql(False))
def adaptive_windows(spark, sf):
    r = records(spark, sf).withColumn("ts", F.col("ts_us") / 1e6)
    return W.adaptive_windows(r, "grp", "ts", ORDER, 8, 4, 4, 32).select("grp", "window_idx", "window_pos", "record_id")


@query("w04_adaptive_windows_live", _adaptive_sql(True))
def adaptive_windows_live(spark, sf):
    r = records(spark, sf).withColumn("ts", F.col("ts_us") / 1e6)
    return W.adaptive_windows(r, "grp", "ts", ORDER, 8, 4, 4, 32, live_cut=True).select(
        "grp", "window_idx", "window_pos", "record_id"
    )


@query(
    "w05_padded_windows",
    f"""WITH {count_window_sql(6, 3)},
    p AS (SELECT grp, window_idx, list(record_id ORDER BY window_pos) AS ids FROM win GROUP BY ALL)
    SELECT grp, CAST(window_idx AS BIGINT) AS window_idx,
           array_to_string(list_concat(ids, [ids[6], ids[6]]), ',') AS ids, '11111100' AS mask FROM p""",
)
def padded_windows(spark, sf):
    long = W.count_windows(records(spark, sf), "grp", ORDER, 6, 3)
    packed = W.pack_windows(long, ["grp", "window_idx"], ["record_id"])
    mask = F.transform(W.valid_mask(F.col("records"), 8), lambda ok: F.when(ok, "1").otherwise("0"))
    return packed.select(
        "grp",
        "window_idx",
        F.array_join(F.transform(W.pad_window(F.col("records"), 8), lambda r: r["record_id"].cast("string")), ",").alias(
            "ids"
        ),
        F.array_join(mask, "").alias("mask"),
    )


_LABEL_SQL = count_window_sql(8, 4) + """,
lab AS (SELECT grp, CAST(window_idx AS BIGINT) AS window_idx,
  max(CASE WHEN label = 'view' THEN 1 ELSE 0 END) AS y0, max(CASE WHEN label = 'click' THEN 1 ELSE 0 END) AS y1,
  max(CASE WHEN label = 'purchase' THEN 1 ELSE 0 END) AS y2, max(CASE WHEN label = 'signup' THEN 1 ELSE 0 END) AS y3,
  max(CASE WHEN label = 'error' THEN 1 ELSE 0 END) = 1 AS is_ood FROM win GROUP BY ALL)"""


def _window_labels(spark, sf):
    r = records(spark, sf).withColumn("labels", F.array("label"))
    long = W.count_windows(r, "grp", ORDER, 8, 4)
    lab = W.window_labels(long, ["grp", "window_idx"], "labels", ID_CLASSES)
    return lab.select("grp", "window_idx", *[F.col("y")[i].alias(f"y{i}") for i in range(4)], "is_ood")


@query("w06_window_labels", f"WITH {_LABEL_SQL} SELECT * FROM lab")
def window_labels(spark, sf):
    return _window_labels(spark, sf)


@query("w07_pure_id_windows", f"WITH {_LABEL_SQL} SELECT * FROM lab WHERE NOT is_ood")
def pure_id_windows(spark, sf):
    return W.pure_id_windows(_window_labels(spark, sf))


@query(
    "w08_group_index",
    """WITH g AS (SELECT DISTINCT c_mktsegment AS s FROM customer WHERE c_mktsegment <> 'MACHINERY'),
    i AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS idx FROM g)
    SELECT c_custkey, CAST(coalesce(idx, (SELECT count(*) FROM g)) AS BIGINT) AS group_index
    FROM customer LEFT JOIN i ON c_mktsegment = s""",
)
def group_index(spark, sf):
    from vigilframe.catalog.views import table

    c = table(spark, sf, "customer")
    known = [r[0] for r in c.select("c_mktsegment").where("c_mktsegment <> 'MACHINERY'").distinct().collect()]
    return c.select("c_custkey", W.group_index(F.col("c_mktsegment"), known).cast("long").alias("group_index"))


@query(
    "w09_flattened_windows",
    f"""WITH {count_window_sql(4, 4)}
    SELECT grp, CAST(window_idx AS BIGINT) AS window_idx,
      array_to_string(list_transform(flatten(list([value, k] ORDER BY window_pos)), lambda v: printf('%.2f', v)), ',')
      || ',' || '0.00,0.00,0.00,0.00,1.00,1.00,1.00,1.00,0.00,0.00' AS flat
    FROM win GROUP BY ALL""",
)
def flattened_windows(spark, sf):
    long = W.count_windows(records(spark, sf), "grp", ORDER, 4, 4)
    packed = W.pack_windows(long, ["grp", "window_idx"], ["value", "k"])
    feats = F.transform(W.pad_window(F.col("records"), 6), lambda r: F.array(r["value"], r["k"]))
    flat = W.flatten_window(feats, W.valid_mask(F.col("records"), 6))
    return packed.select(
        "grp", "window_idx", F.array_join(F.transform(flat, lambda v: F.format_string("%.2f", v)), ",").alias("flat")
    )


@query(
    "w10_input_statistics",
    f"""WITH {count_window_sql(8, 4)},
    f AS (SELECT grp, window_idx, CASE WHEN label = 'error' THEN NULL ELSE value END AS a,
                 CASE WHEN k < 10 THEN 0 ELSE k END AS b FROM win),
    s AS (SELECT grp, window_idx, (CASE WHEN a IS NULL THEN 1.0 ELSE 0 END) / 2 AS m,
                 ((CASE WHEN coalesce(a, 0) = 0 THEN 1.0 ELSE 0 END) + (CASE WHEN b = 0 THEN 1.0 ELSE 0 END)) / 2 AS z,
                 (coalesce(a, 0) + b) / 2 AS mu, abs(coalesce(a, 0) - b) / 2 AS sd FROM f)
    SELECT grp, CAST(window_idx AS BIGINT) AS window_idx, round(avg(m), 6) AS missing_ratio,
           round(avg(z), 6) AS zero_ratio, round(avg(mu), 6) AS input_mean, round(avg(sd), 6) AS input_std,
           avg(m) >= 0.999 OR (avg(m) >= 0.95 AND avg(sd) <= 1e-8) AS degenerate
    FROM s GROUP BY ALL""",
)
def input_statistics(spark, sf):
    r = records(spark, sf).withColumns(
        {
            "a": F.when(F.col("label") != "error", F.col("value")),
            "b": F.when(F.col("k") < 10, 0.0).otherwise(F.col("k")),
        }
    )
    long = W.count_windows(r, "grp", ORDER, 8, 4)
    s = W.input_statistics(long, ["grp", "window_idx"], ["a", "b"])
    return s.select(
        "grp", "window_idx", *[r6(c).alias(c) for c in ("missing_ratio", "zero_ratio", "input_mean", "input_std")],
        "degenerate",
    )


@query(
    "w11_latest_per_entity",
    f"""WITH {REC} SELECT grp, record_id, ts_us, label, value FROM rec
    QUALIFY row_number() OVER (PARTITION BY grp ORDER BY ts_us DESC, record_id DESC) = 1""",
)
def latest_per_entity(spark, sf):
    return W.latest_per_key(records(spark, sf), ["grp"], ORDER).select("grp", "record_id", "ts_us", "label", "value")


@query(
    "w20_attack_fraction_buckets",
    f"""WITH {count_window_sql(8, 4)},
    f AS (SELECT grp, window_idx, avg(CASE WHEN label IN ('error', 'purchase') THEN 1.0 ELSE 0 END) AS fr,
                 avg(value) AS s FROM win GROUP BY ALL),
    b AS (SELECT CASE WHEN fr >= 0.5 THEN '>=0.50' WHEN fr >= 0.2 THEN '>=0.20' WHEN fr >= 0.1 THEN '>=0.10'
                      WHEN fr >= 0.05 THEN '>=0.05' WHEN fr > 0 THEN '<0.05' ELSE 'pure_benign' END AS bucket,
                 fr > 0 AS truth, round(s, 6) > 50 AS pred FROM f),
    c AS (SELECT bucket, count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp,
                 count(*) FILTER (NOT pred AND NOT truth) AS tn, count(*) FILTER (NOT pred AND truth) AS fn
          FROM b GROUP BY bucket)
    SELECT bucket, tp, fp, tn, fn, round(tp / greatest(tp + fn, 1), 6) AS recall,
           round(fp / greatest(fp + tn, 1), 6) AS fpr FROM c""",
)
def attack_fraction_buckets(spark, sf):
    from vigilframe.operators.metrics import decision_metrics

    long = W.count_windows(records(spark, sf), "grp", ORDER, 8, 4)
    per = long.groupBy("grp", "window_idx").agg(
        F.avg(F.col("label").isin("error", "purchase").cast("double")).alias("fr"), F.avg("value").alias("s")
    )
    per = per.withColumn("bucket", W.mix_bucket(F.col("fr")))
    m = decision_metrics(per, ["bucket"], r6("s") > 50, F.col("fr") > 0)
    return m.select("bucket", "tp", "fp", "tn", "fn", r6("recall").alias("recall"), r6("fpr").alias("fpr"))


@query(
    "j16_window_phase",
    f"""WITH {count_window_sql(8, 4)},
    c AS (SELECT grp, window_idx, CASE WHEN k < 30 THEN 'hover' WHEN k < 70 THEN 'cruise' ELSE 'climb' END AS ph,
                 count(*) AS n, min(window_pos) AS f FROM win GROUP BY ALL)
    SELECT grp, CAST(window_idx AS BIGINT) AS window_idx, ph AS window_phase FROM c
    QUALIFY row_number() OVER (PARTITION BY grp, window_idx ORDER BY n DESC, f) = 1""",
)
def window_phase(spark, sf):
    r = records(spark, sf).withColumn(
        "ph", F.when(F.col("k") < 30, "hover").when(F.col("k") < 70, "cruise").otherwise("climb")
    )
    return W.window_phase(W.count_windows(r, "grp", ORDER, 8, 4), ["grp", "window_idx"], "ph")


@query(
    "a51_window_mix",
    f"""WITH {count_window_sql(2, 1)},
    m AS (SELECT grp, window_idx, count(DISTINCT label) > 1 AS mixed FROM win GROUP BY ALL)
    SELECT count(*) AS windows, count(*) FILTER (mixed) AS mixed_windows, count(*) FILTER (NOT mixed) AS pure_windows,
           round(count(*) FILTER (mixed) / greatest(count(*), 1), 6) AS mixed_ratio FROM m""",
)
def window_mix(spark, sf):
    long = W.count_windows(records(spark, sf), "grp", ORDER, 2, 1)
    m = W.mix_statistics(W.window_mix(long, ["grp", "window_idx"], "label"))
    return m.withColumn("mixed_ratio", r6("mixed_ratio"))


@query(
    "a52_metrics_by_phase",
    f"""WITH {REC}, ph AS (SELECT *, CASE WHEN k < 50 THEN 'hovering_proxy' ELSE 'cruising_proxy' END AS phase FROM rec),
    pos AS (SELECT *, row_number() OVER (PARTITION BY phase, grp ORDER BY ts_us, record_id) - 1 AS p,
                   count(*) OVER (PARTITION BY phase, grp) AS n FROM ph),
    win AS (SELECT phase, grp, p // 4 AS w, value, label FROM pos WHERE (p // 4) * 4 + 4 <= n),
    s AS (SELECT phase, grp, w, round(avg(value), 6) > 60 AS pred, bool_or(label = 'error') AS truth
          FROM win GROUP BY ALL),
    c AS (SELECT phase, count(*) FILTER (pred AND truth) AS tp, count(*) FILTER (pred AND NOT truth) AS fp,
                 count(*) FILTER (NOT pred AND NOT truth) AS tn, count(*) FILTER (NOT pred AND truth) AS fn
          FROM s GROUP BY phase)
    SELECT phase, tp, fp, tn, fn, round(tp / greatest(tp + fp, 1), 6) AS precision,
           round(tp / greatest(tp + fn, 1), 6) AS recall FROM c""",
)
def metrics_by_phase(spark, sf):
    from vigilframe.operators.metrics import decision_metrics
    from vigilframe.operators.ordering import position

    r = records(spark, sf).withColumn("phase", F.when(F.col("k") < 50, "hovering_proxy").otherwise("cruising_proxy"))
    placed = position(r, ["phase", "grp"], ORDER, "__pos", size_name="__n")
    long = W.expand_count_windows(placed, 4, 4)
    per = long.groupBy("phase", "grp", "window_idx").agg(
        F.avg("value").alias("s"), F.max((F.col("label") == "error").cast("int")).alias("t")
    )
    m = decision_metrics(per, ["phase"], r6("s") > 60, F.col("t") == 1)
    return m.select("phase", "tp", "fp", "tn", "fn", r6("precision").alias("precision"), r6("recall").alias("recall"))


def _sensitivity_sql() -> str:
    parts = []
    for size, stride in WINDOW_SETTINGS:
        parts.append(
            f"""SELECT {size} AS window_size, {stride} AS stride, CAST(count(*) AS BIGINT) AS windows,
            CAST(sum(mixed) AS BIGINT) AS mixed_windows FROM (
            SELECT grp, w.w, CAST(count(DISTINCT label) > 1 AS INT) AS mixed
            FROM pos, LATERAL (SELECT unnest(range(greatest(0, CAST(ceil((p - {size} + 1) / {stride}.0) AS BIGINT)),
                CAST(floor(p / {stride}.0) AS BIGINT) + 1)) AS w) w
            WHERE w.w * {stride} + {size} <= n GROUP BY ALL)"""
        )
    return f"WITH {POS} SELECT * FROM (" + " UNION ALL ".join(parts) + ") WHERE windows > 0"


@query("a54_window_size_sensitivity", _sensitivity_sql())
def window_size_sensitivity(spark, sf):
    keys = ["window_size", "stride"]
    long = W.window_settings(records(spark, sf), "grp", ORDER, WINDOW_SETTINGS)
    mixed = W.window_mix(long, [*keys, "grp", "window_idx"], "label")
    return W.mix_statistics(mixed, keys).select(*keys, "windows", "mixed_windows")


@query(
    "p05_monotone_fraction",
    f"""WITH {REC}, d AS (SELECT value - lag(value) OVER (ORDER BY ts_us, record_id) AS dv,
                                 record_id - lag(record_id) OVER (ORDER BY ts_us, record_id) AS di FROM rec)
    SELECT round(avg(CASE WHEN dv >= 0 THEN 1.0 ELSE 0 END), 6) AS value_fraction,
           round(avg(CASE WHEN di >= 0 THEN 1.0 ELSE 0 END), 6) AS id_fraction FROM d WHERE dv IS NOT NULL""",
)
def monotone_fraction(spark, sf):
    both = previous(
        records(spark, sf).withColumn("pair", F.struct("value", F.col("record_id").alias("id"))), [], ORDER, "pair", "prev"
    ).where(F.col("prev").isNotNull())
    return both.agg(
        r6(F.avg((F.col("value") >= F.col("prev.value")).cast("double"))).alias("value_fraction"),
        r6(F.avg((F.col("record_id") >= F.col("prev.id")).cast("double"))).alias("id_fraction"),
    )
