"""Consolidated result tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.catalog.monitoring import DT, REG, uav_detections
from vigilframe.catalog.registry import query
from vigilframe.catalog.views import DET, r6, table
from vigilframe.operators import reports as R
from vigilframe.operators.joins import attach_entity


@query(
    "j11_consolidated_entities",
    """WITH c AS (SELECT n_nationkey AS k, count(*) AS n, round(avg(c_acctbal), 4) AS bal FROM customer JOIN nation
      ON c_nationkey = n_nationkey WHERE n_nationkey > 3 GROUP BY 1),
    s AS (SELECT s_nationkey AS k, round(avg(s_acctbal), 4) AS bal, max(s_name) AS top FROM supplier WHERE s_nationkey < 20 GROUP BY 1),
    o AS (SELECT c_nationkey AS k, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1),
    k AS (SELECT k FROM c UNION SELECT k FROM s UNION SELECT k FROM o)
    SELECT k.k AS entity, coalesce(c.bal, s.bal) AS balance, coalesce(o.orders, c.n) AS activity, s.top AS top
    FROM k LEFT JOIN c ON k.k = c.k LEFT JOIN s ON k.k = s.k LEFT JOIN o ON k.k = o.k""",
)
def consolidated_entities(spark, sf):
    cust = table(spark, sf, "customer")
    c = cust.where("c_nationkey > 3").groupBy(F.col("c_nationkey").alias("entity")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("c_acctbal"), 4).alias("bal"))
    s = table(spark, sf, "supplier").where("s_nationkey < 20").groupBy(F.col("s_nationkey").alias("entity")).agg(
        F.round(F.avg("s_acctbal"), 4).alias("bal"), F.max("s_name").alias("top"))
    o = table(spark, sf, "orders").join(cust, F.col("o_custkey") == F.col("c_custkey")).groupBy(
        F.col("c_nationkey").alias("entity")).agg(F.count(F.lit(1)).alias("orders"))
    return R.consolidate(
        {"c": c, "s": s, "o": o}, "entity",
        {"balance": [("c", "bal"), ("s", "bal")], "activity": [("o", "orders"), ("c", "n")], "top": [("s", "top")]},
    )


_HOMO = """h AS (SELECT o_orderpriority AS method, year(o_orderdate) AS grp, count(*) FILTER (o_orderstatus = 'F') / count(*) AS f1
      FROM orders GROUP BY ALL),
    x AS (SELECT o_orderpriority AS method, count(*) FILTER (o_totalprice > 200000) / count(*) AS f1 FROM orders GROUP BY 1)"""


@query(
    "j12_homogeneous_vs_heterogeneous",
    f"""WITH {_HOMO}, a AS (SELECT method, count(f1) AS n, avg(f1) AS m, stddev_pop(f1) AS s FROM h GROUP BY 1)
    SELECT a.method, n AS group_count, round(m, 6) AS homogeneous_mean, round(s, 6) AS homogeneous_std,
      round(x.f1, 6) AS heterogeneous, round(m - x.f1, 6) AS "drop", round((m - x.f1) / m, 6) AS drop_ratio
    FROM a JOIN x ON a.method = x.method""",
)
def homogeneous_vs_heterogeneous(spark, sf):
    o = table(spark, sf, "orders").withColumn("method", F.col("o_orderpriority"))
    h = o.groupBy("method", F.year("o_orderdate").alias("grp")).agg(
        (F.count_if(F.col("o_orderstatus") == "F") / F.count(F.lit(1))).alias("f1"))
    x = o.groupBy("method").agg((F.count_if(F.col("o_totalprice") > 200000) / F.count(F.lit(1))).alias("f1"))
    out = R.homogeneous_vs_heterogeneous(h, x.withColumn("seq", F.lit(0)), "method", "f1", "seq")
    return out.withColumns({c: r6(c) for c in ("homogeneous_mean", "homogeneous_std", "heterogeneous", "drop", "drop_ratio")})


@query(
    "j13_merge_partial_results",
    """SELECT c_custkey, CASE WHEN c_nationkey % 3 = 0 THEN 'success' WHEN c_nationkey % 2 = 0 THEN 'success' ELSE 'failed' END AS status,
      CASE WHEN c_nationkey % 2 = 0 THEN 2 WHEN c_nationkey % 3 = 0 THEN 1 ELSE 2 END AS run FROM customer""",
)
def merge_partial_results(spark, sf):
    c = table(spark, sf, "customer")
    first = c.select("c_custkey", F.when(F.col("c_nationkey") % 3 == 0, "success").otherwise("failed").alias("status"),
                     F.lit(1).alias("run"))
    second = c.select("c_custkey", F.when(F.col("c_nationkey") % 2 == 0, "success").otherwise("failed").alias("status"),
                      F.lit(2).alias("run"))
    return R.prefer_success([first, second], "c_custkey", "status")


@query(
    "a46_weighted_rollup",
    f"""WITH {DT}, {REG}, c AS (SELECT uav_id, count(*) AS sample_count, count(*) FILTER (attack_active) AS attack_count,
      count(*) FILTER (has_alert) / count(*) AS rate, CASE WHEN uav_id = 'uav_01' THEN NULL ELSE avg(ood_score) END AS score
      FROM dt GROUP BY 1),
    j AS (SELECT c.*, source_type, CASE WHEN source_type = 'uav_iot_wifi' THEN 0 ELSE attack_count END AS w FROM c
      JOIN reg ON c.uav_id = reg.uav_id)
    SELECT source_type, CAST(sum(sample_count) AS BIGINT) AS sample_count,
      round(CASE WHEN sum(w) FILTER (w > 0) > 0 THEN sum(rate * w) FILTER (w > 0) / sum(w) FILTER (w > 0) ELSE avg(rate) END, 6) AS rate,
      round(sum(score * sample_count) / sum(sample_count) FILTER (score IS NOT NULL), 6) AS score FROM j GROUP BY 1""",
)
def weighted_rollup(spark, sf):
    d = uav_detections(spark, sf)
    c = d.groupBy("uav_id").agg(
        F.count(F.lit(1)).alias("sample_count"), F.count_if("attack_active").alias("attack_count"),
        (F.count_if("has_alert") / F.count(F.lit(1))).alias("rate"), F.avg("ood_score").alias("score"),
    ).withColumn("score", F.when(F.col("uav_id") != "uav_01", F.col("score")))
    j = attach_entity(c, "uav_id").withColumn(
        "w", F.when(F.col("source_type") == "uav_iot_wifi", 0).otherwise(F.col("attack_count")))
    out = R.weighted_rollup(j, "source_type", {"rate": "w", "score": "sample_count"}, ["sample_count"])
    return out.withColumns({"rate": r6("rate"), "score": r6("score")})


@query(
    "a48_dominant_source",
    f"""WITH {DET}, c AS (SELECT grp, label, count(*) AS n FROM det WHERE is_ood GROUP BY ALL)
    SELECT grp, arg_min(label, struct_pack(a := -n, b := label)) AS dominant_label FROM c GROUP BY grp""",
)
def dominant_source(spark, sf):
    return R.dominant_value(uav_detections(spark, sf).where("is_ood"), ["grp"], "label")


@query(
    "a48_best_experiment",
    """WITH e AS (SELECT p_brand AS name, min(p_partkey) AS seq, CASE WHEN count(*) % 5 = 0 THEN 'failed' ELSE 'success' END AS status,
      avg(p_retailprice) AS a, avg(p_size) * 20 AS b FROM part GROUP BY 1),
    l AS (SELECT name, seq, 0 AS i, 'a' AS metric_name, a AS v FROM e WHERE status <> 'failed'
      UNION ALL SELECT name, seq, 1, 'b', b FROM e WHERE status <> 'failed')
    SELECT name, metric_name, round(v, 6) AS metric_value FROM l ORDER BY v DESC, seq, i LIMIT 1""",
)
def best_experiment(spark, sf):
    e = table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(
        F.min("p_partkey").alias("seq"), F.when(F.count(F.lit(1)) % 5 == 0, "failed").otherwise("success").alias("status"),
        F.avg("p_retailprice").alias("a"), (F.avg("p_size") * 20).alias("b"))
    return R.best_experiment(e, "name", "status", "seq", ["a", "b"]).withColumn("metric_value", r6("metric_value"))


@query(
    "a55_result_rows",
    f"""WITH {DET} SELECT group_id AS method, count(*) FILTER (is_ood) AS alerts, round(avg(ood_score), 6) AS mean_score,
      max(ood_score) AS peak, CAST(NULL AS DOUBLE) AS auroc FROM det GROUP BY 1""",
)
def result_rows(spark, sf):
    d = uav_detections(spark, sf).groupBy(F.col("group_id").alias("method")).agg(
        F.count_if("is_ood").alias("n"), F.avg("ood_score").alias("m"), F.max("ood_score").alias("p"))
    nested = d.select(
        "method",
        F.struct(F.struct(F.col("n").alias("alerts"), r6("m").alias("mean")).alias("ood_test"), F.col("p").alias("peak")).alias(
            "report"))
    return R.result_rows(
        nested, "method",
        {"alerts": "report.ood_test.alerts", "mean_score": "report.ood_test.mean", "peak": "report.peak",
         "auroc": "report.ood_test.auroc"},
    )


