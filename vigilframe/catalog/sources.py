"""Source and sink queries: the given tables are written out and read back through each format."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.catalog.calibration import _FUSED
from vigilframe.catalog.registry import query
from vigilframe.catalog.views import DET, REC, detections, records, table, vectors
from vigilframe.config import materialize, shared_dir
from vigilframe.operators.merge import select_sources
from vigilframe.sources import model_store as MS
from vigilframe.sources import readers as S


@query(
    "s01_load_records",
    """SELECT f AS format, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders,
      (SELECT unnest(['csv', 'jsonl', 'json', 'parquet', 'containers.json']) AS f) GROUP BY f""",
)
def load_records(spark, sf):
    """Every format back through the loader; the last one spreads the table over documents of all kinds."""
    root = shared_dir(spark, "load")
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    for kind in ("csv", "jsonl", "json", "parquet"):
        S.save_records(o, f"{root}/o.{kind}")
    turn = F.floor(F.col("o_orderkey") / 500) % 4
    packed = o.groupBy(F.floor(F.col("o_orderkey") / 500).alias("b"), turn.alias("turn")).agg(
        F.collect_list(F.struct("o_orderkey", "o_totalprice")).alias("rows")
    )
    held = [F.when(F.col("turn") == i, F.col("rows")).alias(c) for i, c in enumerate(S.CONTAINERS)]
    packed = packed.select(*held, F.when(F.col("turn") == 3, F.col("rows")).alias("array"))
    lines = packed.select(F.coalesce(F.to_json("array"), F.to_json(F.struct(*S.CONTAINERS))).alias("value"))
    lines.write.text(f"{root}/containers.json")
    out = None
    for name in ("o.csv", "o.jsonl", "o.json", "o.parquet", "containers.json"):
        d = S.load_records(spark, f"{root}/{name}")
        one = d.agg(
            F.lit(name.removeprefix("o.")).alias("format"), F.count(F.lit(1)).alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total")
        )
        out = one if out is None else out.unionByName(one)
    return out


@query("s02_save_records", "SELECT c_custkey, c_acctbal, c_mktsegment FROM customer")
def save_records(spark, sf):
    path = shared_dir(spark, "save") + "/customer.csv"
    S.save_records(table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment"), path)
    return S.load_records(spark, path, schema="c_custkey long, c_acctbal double, c_mktsegment string")


@query(
    "s03_detection_documents",
    f"WITH {DET} SELECT window_id, group_id, ood_score, is_ood, attack_active, truth_ood AS truth_ood, label AS label0 FROM det",
)
def detection_documents(spark, sf):
    path = shared_dir(spark, "detections")
    d = detections(spark, sf).select(
        "window_id", "group_id", "ood_score", "is_ood", F.array("label").alias("labels"),
        F.struct("attack_active", F.col("truth_ood").alias("is_ood")).alias("ground_truth"),
    )
    S.write_detections(d, path)
    back = S.read_detections(spark, path, d.schema)
    return back.select(
        "window_id", "group_id", "ood_score", "is_ood", "ground_truth.attack_active",
        F.col("ground_truth.is_ood").alias("truth_ood"), F.col("labels")[0].alias("label0"),
    )


def _nation_files(spark, sf, name):
    """Customers as CSV, one folder per market segment."""
    root = shared_dir(spark, name)
    c = table(spark, sf, "customer").select("c_custkey", "c_acctbal", "c_mktsegment")
    c.write.partitionBy("c_mktsegment").csv(root, header=True)
    return root


@query("s04_csv_discovery", "SELECT count(DISTINCT c_mktsegment) AS folders, true AS all_csv FROM customer")
def csv_discovery(spark, sf):
    files = S.list_csv(spark, _nation_files(spark, sf, "discover"))
    return files.agg(
        F.count_distinct(F.element_at(F.split("path", "/"), -2)).alias("folders"),
        F.min(F.lower("name").endswith(".csv")).alias("all_csv"),
    )


@query(
    "s05_folder_labels",
    """SELECT c_custkey, c_acctbal, lower(c_mktsegment) AS label FROM customer""",
)
def folder_labels(spark, sf):
    root = _nation_files(spark, sf, "folders")
    segs = [r[0] for r in table(spark, sf, "customer").select("c_mktsegment").distinct().collect()]
    rows, _ = S.folder_labelled(
        spark, root, {f"c_mktsegment={s}": s.lower() for s in segs}, "c_custkey long, c_acctbal double"
    )
    return rows.select("c_custkey", "c_acctbal", "label")


@query(
    "s05_folder_counts",
    "SELECT lower(c_mktsegment) AS label, count(*) AS n FROM customer GROUP BY 1",
)
def folder_counts(spark, sf):
    root = _nation_files(spark, sf, "foldercounts")
    segs = [r[0] for r in table(spark, sf, "customer").select("c_mktsegment").distinct().collect()]
    _, counts = S.folder_labelled(
        spark, root, {f"c_mktsegment={s}": s.lower() for s in segs}, "c_custkey long, c_acctbal double"
    )
    return counts.groupBy("label").agg(F.sum("rows").alias("n"))


@query(
    "s06_malformed_tail",
    "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_suppkey < (SELECT count(*) // 2 FROM supplier)",
)
def malformed_tail(spark, sf):
    path = shared_dir(spark, "tail")
    s = table(spark, sf, "supplier").select("s_suppkey", "s_acctbal")
    half = s.count() // 2
    line = F.when(F.col("s_suppkey") == half, F.concat_ws(",", "s_suppkey", "s_acctbal", F.lit("x"))).otherwise(
        F.concat_ws(",", "s_suppkey", "s_acctbal")
    )
    head = spark.range(1).select(F.lit("s_suppkey,s_acctbal").alias("value"), F.lit(-1).alias("o"))
    lines = head.unionByName(s.select(line.alias("value"), F.col("s_suppkey").alias("o")))
    lines.coalesce(1).sortWithinPartitions("o").select("value").write.text(path)
    return S.truncate_malformed(spark, path, "s_suppkey long, s_acctbal double")


@query(
    "s07_train_test_union",
    "SELECT o_orderkey, o_totalprice, CASE WHEN o_orderstatus = 'F' THEN 'train' ELSE 'test' END AS part, "
    "CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_orderpriority END AS extra FROM orders",
)
def train_test_union(spark, sf):
    root = shared_dir(spark, "pair")
    o = table(spark, sf, "orders")
    o.where("o_orderstatus = 'F'").select("o_orderkey", "o_totalprice", F.lit("train").alias("part")).write.parquet(f"{root}/train")
    o.where("o_orderstatus <> 'F'").select(
        "o_orderkey", "o_totalprice", F.lit("test").alias("part"), F.col("o_orderpriority").alias("extra")
    ).write.parquet(f"{root}/test")
    u = S.pair_union(spark, [f"{root}/train", f"{root}/test"], "parquet")
    return u.where(F.col("source_file").isNotNull()).select("o_orderkey", "o_totalprice", "part", "extra")


@query(
    "s08_known_class_rows",
    f"""WITH {REC} SELECT count(*) AS rows, count(*) FILTER (label IN ('view', 'click') AND k >= 4) AS kept,
      count(*) FILTER (k < 2) AS repeated_headers, count(*) FILTER (k >= 2 AND k < 4) AS blank FROM rec""",
)
def known_class_rows(spark, sf):
    cls = F.when(F.col("k") < 2, "cls").when(F.col("k") < 4, " ").otherwise(F.col("label"))
    _, profile = S.known_class_rows(records(spark, sf).withColumn("cls", cls), "cls", {"view": "benign", "click": "dos"})
    return profile


@query(
    "s09_configured_sources",
    """SELECT 'part' AS source, 0 AS ord, count(*) AS n FROM part UNION ALL SELECT 'customer', 1, count(*) FROM customer""",
)
def configured_sources(spark, sf):
    chosen = select_sources(["customer", "supplier", "part", "orders"], ["part", "customer", "orders"], ["orders"])
    out = None
    for i, name in enumerate(chosen):
        one = table(spark, sf, name).agg(F.lit(name).alias("source"), F.lit(i).alias("ord"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query(
    "s10_header_union",
    """SELECT 'a' AS folder, c_custkey AS key, CAST(c_acctbal AS VARCHAR) AS acctbal, NULL AS size FROM customer WHERE false
    UNION ALL SELECT 'cust', c_custkey, printf('%.2f', c_acctbal), NULL FROM customer
    UNION ALL SELECT 'part', p_partkey, NULL, CAST(p_size AS VARCHAR) FROM part""",
)
def header_union(spark, sf):
    root = shared_dir(spark, "headers")
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("key"), F.format_string("%.2f", "c_acctbal").alias("acctbal"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("key"), F.col("p_size").alias("size"))
    c.coalesce(1).write.csv(f"{root}/cust", header=True)
    p.coalesce(1).write.csv(f"{root}/part", header=True)
    u = S.header_union_files(spark, root)
    return u.select(F.col("source_folder").alias("folder"), F.col("key").cast("long").alias("key"), "acctbal", "size")


@query(
    "s11_model_tables",
    f"""WITH {_FUSED} SELECT raw.vec_id, round(proto, 5) AS proto, round(fused, 4) AS fused FROM raw
      JOIN fz ON raw.vec_id = fz.vec_id WHERE mode = 'mean'""",
)
def model_tables(spark, sf):
    from vigilframe.catalog.calibration import score_table
    from vigilframe.catalog.views import VECTOR_CLASSES
    from vigilframe.operators import calibrate as K
    from vigilframe.operators import scoring as G

    root = shared_dir(spark, "model")
    v = vectors(spark, sf)
    model = G.fit_prototypes(v.where(F.col("label") < 8), "vec", F.array("label"), VECTOR_CLASSES, precision=False)
    MS.save_prototypes(spark, model, f"{root}/prototypes")
    raw = materialize(score_table(spark, sf), "scores")
    cal = K.fit_calibration(raw.where(~F.col("truth_ood")), "mean")
    MS.save_calibration(spark, cal, f"{root}/calibration")
    back = MS.load_prototypes(spark, f"{root}/prototypes")
    cal2 = MS.load_calibration(spark, f"{root}/calibration")
    dist = G.distance_scores(v, ["vec_id"], "vec", back).select("vec_id", F.round("proto", 5).alias("proto"))
    fused = K.apply_calibration(raw, cal2).select("vec_id", F.round("fused", 4).alias("fused"))
    return dist.join(fused, "vec_id")


@query(
    "s12_report_collection",
    """SELECT 'm' || p_size AS run, p_size AS "cfg.size", round(avg(p_retailprice), 4) AS "ood_test.auroc" FROM part GROUP BY p_size""",
)
def report_collection(spark, sf):
    root = shared_dir(spark, "reports")
    r = table(spark, sf, "part").groupBy("p_size").agg(F.round(F.avg("p_retailprice"), 4).alias("a")).select(
        F.concat(F.lit("m"), "p_size").alias("folder"), F.struct(F.col("p_size").alias("size")).alias("cfg"),
        F.struct(F.col("a").alias("auroc")).alias("ood_test"),
    )
    r.write.partitionBy("folder").json(root)
    return S.read_reports(spark, root, "*.json").withColumn("run", F.regexp_replace("run", "^folder=", ""))


@query(
    "s13_stream_normalization",
    f"""WITH {REC} SELECT record_id, CASE WHEN k < 3 THEN 'missing_group' END AS reject_reason,
      CASE WHEN k >= 3 THEN CAST(grp AS VARCHAR) END AS grp,
      coalesce(CASE WHEN label = 'error' THEN NULL ELSE 'e' || record_id END, CASE WHEN k >= 3 THEN CAST(grp AS VARCHAR) ELSE 'stream' END
        || ':' || printf('%.6f', ts_us / 1e6) || ':' || record_id) AS rid,
      CASE WHEN label = 'view' THEN 'benign' ELSE label END AS label FROM rec""",
)
def stream_normalization(spark, sf):
    from vigilframe.streaming.records import normalize_records

    r = records(spark, sf).select(
        F.col("record_id").alias("n"),
        F.when(F.col("k") >= 3, F.col("grp").cast("string")).alias("grp"),
        (F.col("ts_us") / 1e6).alias("timestamp"),
        F.when(F.col("label") != "error", F.concat(F.lit("e"), F.col("record_id"))).alias("record_id"),
        (F.col("label") != "view").alias("attack_active"),
        F.col("label").alias("attack_type"),
    )
    out = normalize_records(r, "grp", "timestamp", "record_id", "n")
    return out.select(F.col("n").alias("record_id"), "reject_reason", "grp", F.col("record_id").alias("rid"), "label")
