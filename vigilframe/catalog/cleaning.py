"""Cleaning, merging, joins on keys and count summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.catalog.registry import query
from vigilframe.catalog.views import REC, r6, records, table
from vigilframe.functions import text as X
from vigilframe.operators import clean as C
from vigilframe.operators import merge as M
from vigilframe.operators import quality as Q
from vigilframe.operators import windows as W
from vigilframe.operators.ordering import position

ORDER = ["ts_us", "record_id"]


@query(
    "p01_column_resolution",
    """SELECT 'o_totalprice' AS column_name, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders""",
)
def column_resolution(spark, sf):
    o = table(spark, sf, "orders")
    c = C.resolve_column(o.columns, None, ["price", "O TotalPrice"], "price")
    return o.agg(
        F.lit(c).alias("column_name"), F.count(F.lit(1)).alias("n"), F.round(F.sum(c), 2).alias("total")
    )


@query(
    "p02_leakage_projection",
    """SELECT o_orderkey, o_totalprice FROM orders""",
)
def leakage_projection(spark, sf):
    o = table(spark, sf, "orders").select(
        "o_orderkey",
        "o_totalprice",
        F.col("o_custkey").alias("source_uav_id"),
        F.col("o_orderstatus").alias("tls_sni_hash"),
        F.col("o_orderpriority").alias("label"),
        F.col("o_custkey").alias("dst_port"),
        F.col("o_orderdate").alias("sim_time_x"),
    )
    return C.leakage_safe(o, ["label", "timestamp", "record_id"])


@query(
    "p03_feature_inference",
    """SELECT unnest(['number', 'mixed']) AS feature, (SELECT count(*) FROM orders) AS n""",
)
def feature_inference(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_totalprice").alias("number"),
        F.when(F.col("o_orderkey") % 20 == 0, "bad").otherwise(F.col("o_custkey").cast("string")).alias("mixed"),
        F.col("o_orderpriority").alias("words"),
        F.col("o_orderstatus").alias("label"),
    )
    feats = C.infer_features(o, ["label"])
    return o.agg(F.count(F.lit(1)).alias("n")).select(F.explode(F.array(*[F.lit(f) for f in feats])).alias("feature"), "n")


@query(
    "p04_feature_report",
    f"""WITH {REC}, d AS (SELECT *, record_id >= lag(record_id) OVER (ORDER BY ts_us, record_id) AS mi,
      value >= lag(value) OVER (ORDER BY ts_us, record_id) AS mv,
      record_id IS NOT NULL AND row_number() OVER (ORDER BY ts_us, record_id) > 1 AS later FROM rec)
    SELECT 'counter' AS column_name, 1.0 AS numeric_ratio, count(DISTINCT record_id) AS unique_count,
      round(avg(CASE WHEN mi THEN 1.0 ELSE 0 END) FILTER (later), 6) AS monotone_fraction,
      'capture_counter_like' AS reason FROM d
    UNION ALL SELECT 'value', 1.0, count(DISTINCT value), round(avg(CASE WHEN mv THEN 1.0 ELSE 0 END) FILTER (later), 6),
      'kept' FROM d
    UNION ALL SELECT 'word', 0.0, 0, 0.0, 'mostly_non_numeric'
    UNION ALL SELECT 'fixed', 1.0, 1, 1.0, 'constant_or_empty'
    UNION ALL SELECT 'src_ip', 1.0, count(DISTINCT k), round((SELECT avg(CASE WHEN k >= pk THEN 1.0 ELSE 0 END)
      FROM (SELECT k, lag(k) OVER (ORDER BY ts_us, record_id) AS pk FROM rec) WHERE pk IS NOT NULL), 6),
      'forced_leakage_or_identifier_drop' FROM d""",
)
def feature_report(spark, sf):
    r = records(spark, sf).select(
        *ORDER, F.col("record_id").alias("counter"), "value", F.col("label").alias("word"), F.lit("0x1F").alias("fixed"),
        F.col("k").alias("src_ip"),
    )
    rep = C.feature_report(r, ["counter", "value", "word", "fixed", "src_ip"], ORDER)
    return rep.select(
        "column_name", r6("numeric_ratio").alias("numeric_ratio"), "unique_count",
        r6("monotone_fraction").alias("monotone_fraction"), "reason",
    )


@query(
    "p06_hex_coercion",
    """SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS from_hex, CASE WHEN o_orderstatus = 'F' THEN NULL ELSE
       o_totalprice END AS from_text FROM orders""",
)
def hex_coercion(spark, sf):
    o = table(spark, sf, "orders")
    return o.select(
        "o_orderkey",
        X.coerce_number(F.concat(F.lit("0x"), F.hex("o_custkey"))).alias("from_hex"),
        X.coerce_number(F.when(F.col("o_orderstatus") == "F", "n/a").otherwise(F.col("o_totalprice").cast("string"))).alias(
            "from_text"
        ),
    )


@query(
    "p07_leakage_report",
    """SELECT * FROM (VALUES ('s_suppkey', true, 'retained'), ('s_name', false, 'not_selected'),
      ('s_nationkey', true, 'retained'), ('s_acctbal', true, 'retained'), ('label', false, 'protected'),
      ('source_x', false, 'reserved_prefix'), ('payload_len', false, 'leakage_pattern'), ('sport', false, 'port'))
      t(column_name, retained, reason) WHERE (SELECT count(*) FROM supplier) > 0""",
)
def leakage_report(spark, sf):
    s = table(spark, sf, "supplier")
    s = s.withColumns(
        {
            "label": F.lit("a"),
            "source_x": F.lit(1),
            "payload_len": F.length("s_name"),
            "sport": F.col("s_nationkey"),
        }
    )
    feats = C.infer_features(s, ["label"])
    return C.leakage_report(s, feats, ["label"])


@query(
    "p09_prepared_frame",
    """SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS record_id, CAST(c_acctbal AS DOUBLE) AS timestamp,
      'uav_01' AS uav_id, 'crm' AS dataset_name, 'uav' AS source_type, c_mktsegment AS label,
      CASE WHEN c_mktsegment = 'BUILDING' THEN 'building' ELSE lower(c_mktsegment) END AS label_normalized,
      'train' AS split, c_custkey FROM customer""",
)
def prepared_frame(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey", F.col("c_acctbal").alias("time"), F.concat(F.lit(" "), "c_mktsegment").alias("label"),
        F.lit("Training").alias("split"),
    )
    return C.prepared_frame(
        c, ["c_custkey"], "label", "time", "split", "uav_01", "crm", "uav", X.normalize_token
    ).drop("time")


@query(
    "p10_label_precedence",
    """SELECT c_custkey, c_mktsegment AS label, CASE WHEN c_acctbal < 0 THEN 'ood' ELSE 'benign' END AS label_normalized
    FROM customer""",
)
def label_precedence(spark, sf):
    c = table(spark, sf, "customer").select(
        "c_custkey",
        F.col("c_mktsegment").alias("source_label"),
        F.when(F.col("c_acctbal") < 0, "ood").otherwise("benign").alias("label"),
    )
    label, norm = C.label_precedence(c.columns, "label", None)
    return c.select("c_custkey", F.trim(F.col(label)).alias("label"), F.trim(F.col(norm)).alias("label_normalized"))


@query(
    "p11_dataset_adapter",
    """SELECT CAST(l_orderkey * 10 + l_linenumber AS VARCHAR) AS record_id,
      round((epoch_us(l_shipdate) - (SELECT min_by(epoch_us(l_shipdate), l_orderkey * 10 + l_linenumber) FROM lineitem)) / 1e6, 3)
        AS timestamp,
      CASE WHEN l_returnflag = 'N' THEN 'benign' ELSE lower(l_returnflag) || '_flag' END AS label,
      CAST(l_linestatus = 'O' AS INT) AS direction_numeric
    FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey,
      l_extendedprice) = 1""",
)
def dataset_adapter(spark, sf):
    li = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.min_by(F.struct("l_shipdate", "l_returnflag", "l_linestatus"),
                 F.struct("l_partkey", "l_suppkey", "l_extendedprice")).alias("r")
    )
    src = li.select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("id"),
        F.date_format("r.l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("StartTime"),
        F.when(F.col("r.l_returnflag") == "N", "Normal").otherwise(F.concat("r.l_returnflag", F.lit(" flag"))).alias(
            "Category"
        ),
        F.when(F.col("r.l_linestatus") == "O", "OUTbound").otherwise("in").alias("direction"),
    )
    return C.adapt_dataset(src, ["id"]).select(
        "record_id", F.round("timestamp", 3).alias("timestamp"), "label", "direction_numeric"
    )


@query("p12_single_source_type", "SELECT 'uav' AS source_type, count(*) AS n FROM region")
def single_source_type(spark, sf):
    r = table(spark, sf, "region").withColumn("source_type", F.lower(F.lit("UAV")))
    kind = C.single_source_type(r, "source_type", "uav")
    return r.agg(F.lit(kind).alias("source_type"), F.count(F.lit(1)).alias("n"))


@query(
    "p13_feature_alignment",
    """SELECT s_suppkey, CAST(s_nationkey AS DOUBLE) AS s_nationkey, s_acctbal, 0.0 AS extra_a, 0.0 AS s_name,
       'extra_a' AS filled FROM supplier""",
)
def feature_alignment(spark, sf):
    s = table(spark, sf, "supplier")
    out, filled = M.align_features(s, ["s_suppkey"], ["s_nationkey", "s_acctbal", "extra_a", "s_name"])
    return out.withColumn("filled", F.lit(",".join(filled)))


@query(
    "p14_prefixed_ids",
    """SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'uav_01_' || (row_number() OVER (ORDER BY c_custkey) - 1)
      ELSE 'uav_01_' || c_custkey END AS record_id FROM customer""",
)
def prefixed_ids(spark, sf):
    c = position(table(spark, sf, "customer").select("c_custkey"), [], ["c_custkey"], "idx")
    rid = (
        F.when(F.col("c_custkey") % 3 == 0, F.lit(None))
        .when(F.col("c_custkey") % 3 == 1, F.concat(F.lit("uav_01_"), F.col("c_custkey")))
        .otherwise(F.col("c_custkey").cast("string"))
    )
    return c.select("c_custkey", C.prefixed_ids(rid, F.lit("uav_01"), F.col("idx")).alias("record_id"))


@query(
    "p15_unique_names",
    """SELECT p_partkey AS raw_part_key, p_size AS raw_part_key_2, p_retailprice AS raw_price_usd FROM part""",
)
def unique_names(spark, sf):
    p = table(spark, sf, "part").select(
        F.col("p_partkey").alias("Part Key"), F.col("p_size").alias("part-key"), F.col("p_retailprice").alias("Price/USD ")
    )
    return p.toDF(*C.unique_names(p.columns).values())


@query(
    "p16_split_filter",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'p' END AS split
    FROM orders WHERE o_orderstatus IN ('F', 'O')""",
)
def split_filter(spark, sf):
    raw = F.when(F.col("o_orderstatus") == "F", " Training").when(F.col("o_orderstatus") == "O", "DEV").otherwise("p")
    o = table(spark, sf, "orders").select("o_orderkey", X.split_name(raw).alias("split"))
    return o.where(F.col("split").isin("train", "val"))


@query(
    "p17_guards",
    f"""WITH {REC} SELECT count(*) FILTER (label NOT IN ('view', 'click')) AS unknown_label,
      count(*) FILTER (trim(label) = '') AS blank_label, count(*) FILTER (k < 10) AS blank_k FROM rec""",
)
def guards(spark, sf):
    r = records(spark, sf).withColumn("k", F.when(F.col("k") >= 10, F.col("k")))
    return C.guard_profile(r, "label", ["view", "click"], ["label", "k"])


@query(
    "p18_global_row_index",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
      row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1
        AS record_id FROM lineitem""",
)
def global_row_index(spark, sf):
    cols = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = table(spark, sf, "lineitem").select("l_shipdate", *cols).withColumn("l_shipdate", F.unix_date(F.to_date("l_shipdate")))
    return position(li, [], ["l_shipdate", *cols], "record_id").drop("l_shipdate")


@query(
    "p19_partition_flag",
    f"""WITH {REC} SELECT record_id, CASE WHEN label IN ('view', 'click') THEN 'id' ELSE 'ood' END AS part,
      label NOT IN ('view', 'click') AS is_ood_record FROM rec""",
)
def partition_flag(spark, sf):
    r = records(spark, sf)
    labels = X.label_list(F.col("label"))
    return r.select(
        "record_id",
        C.partition_flag(F.col("label"), ["view", "click"]).alias("part"),
        X.is_ood_record(labels, ["view", "click"]).alias("is_ood_record"),
    )


@query(
    "p20_serving_features",
    f"""WITH {REC} SELECT record_id, CASE WHEN label = 'error' THEN 0.0 ELSE value END AS value, k, 0.0 AS absent,
      CASE WHEN label = 'error' THEN '1' ELSE '0' END || '01' AS missing_mask,
      CASE WHEN label = 'error' OR value = 0 THEN '1' ELSE '0' END || CASE WHEN k = 0 THEN '1' ELSE '0' END || '1' AS zero_mask
    FROM rec""",
)
def serving_features(spark, sf):
    r = records(spark, sf).withColumn("value", F.when(F.col("label") != "error", F.col("value")))
    s = C.serving_frame(r, ["value", "k", "absent"], ["record_id"])
    bits = lambda c: F.array_join(F.transform(c, lambda b: b.cast("int").cast("string")), "")
    return s.withColumns({"missing_mask": bits(F.col("missing_mask")), "zero_mask": bits(F.col("zero_mask"))})


@query(
    "p21_entity_time_slice",
    f"""WITH {REC} SELECT record_id, grp, ts_us FROM rec
      WHERE grp = 7 AND ts_us <= epoch_us(TIMESTAMP '2024-01-15 00:00:00')""",
)
def entity_time_slice(spark, sf):
    limit = 1705276800 * 1_000_000
    return records(spark, sf).where((F.col("grp") == 7) & (F.col("ts_us") <= limit)).select("record_id", "grp", "ts_us")


@query(
    "p23_label_universe",
    f"""WITH {REC} SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INT) AS class_idx
      FROM (SELECT DISTINCT label FROM rec WHERE label <> 'error')""",
)
def label_universe(spark, sf):
    r = records(spark, sf).select(X.label_list(F.col("label")).alias("labels"))
    return Q.label_universe(r, "labels", ["error"])


# --- label and set operators -----------------------------------------------------
@query(
    "j06_drop_ambiguous_patterns",
    """WITH f AS (SELECT l_quantity, l_discount, l_tax, l_linenumber, l_returnflag, l_orderkey FROM lineitem),
    b AS (SELECT l_quantity, l_discount, l_tax, l_linenumber FROM f GROUP BY ALL HAVING count(DISTINCT l_returnflag) > 1)
    SELECT f.l_orderkey, f.l_linenumber, f.l_returnflag FROM f
    WHERE NOT EXISTS (SELECT 1 FROM b WHERE b.l_quantity = f.l_quantity AND b.l_discount = f.l_discount
      AND b.l_tax = f.l_tax AND b.l_linenumber = f.l_linenumber)""",
)
def drop_ambiguous(spark, sf):
    li = table(spark, sf, "lineitem")
    kept = C.drop_ambiguous(li, ["l_quantity", "l_discount", "l_tax", "l_linenumber"], "l_returnflag")
    return kept.select("l_orderkey", "l_linenumber", "l_returnflag")


@query(
    "u03_exact_duplicates",
    """SELECT l_quantity, l_discount, l_returnflag, min(l_orderkey * 100000000 + l_partkey * 1000 + l_linenumber) AS rid
    FROM lineitem GROUP BY ALL""",
)
def exact_duplicates(spark, sf):
    li = table(spark, sf, "lineitem").select(
        "l_quantity", "l_discount", "l_returnflag",
        (F.col("l_orderkey") * 100000000 + F.col("l_partkey") * 1000 + F.col("l_linenumber")).alias("rid"),
    )
    return C.drop_duplicates_first(li, ["l_quantity", "l_discount", "l_returnflag"], "rid")


@query(
    "u01_union_splits",
    """SELECT o_orderkey, split, split_rank, row_number() OVER (ORDER BY split_rank, o_orderkey) - 1 AS record_id FROM (
      SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'train' WHEN 'O' THEN 'val' ELSE 'test' END AS split,
        CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 ELSE 2 END AS split_rank FROM orders)""",
)
def union_splits(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus")
    part = lambda s: o.where(F.col("o_orderstatus") == s).select("o_orderkey")
    u = M.union_splits([("train", part("F")), ("val", part("O")), ("test", part("P"))])
    return position(u, [], ["split_rank", "o_orderkey"], "record_id")


@query(
    "u02_merge_sources",
    """SELECT c_acctbal AS acctbal, CAST(c_nationkey AS DOUBLE) AS nationkey, 0.0 AS size, 'c' || c_custkey AS record_id,
      'customer' AS dataset_name FROM customer
    UNION ALL SELECT s_acctbal, CAST(s_nationkey AS DOUBLE), 0.0, 's' || s_suppkey, 'supplier' FROM supplier
    UNION ALL SELECT 0.0, 0.0, CAST(p_size AS DOUBLE), 'p' || p_partkey, 'part' FROM part""",
)
def merge_sources(spark, sf):
    meta = ["record_id", "dataset_name"]
    c = table(spark, sf, "customer").select(
        F.col("c_acctbal").alias("acctbal"), F.col("c_nationkey").alias("nationkey"),
        F.concat(F.lit("c"), "c_custkey").alias("record_id"), F.lit("customer").alias("dataset_name"))
    s = table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").alias("nationkey"),
        F.concat(F.lit("s"), "s_suppkey").alias("record_id"), F.lit("supplier").alias("dataset_name"))
    p = table(spark, sf, "part").select(
        F.col("p_size").alias("size"), F.concat(F.lit("p"), "p_partkey").alias("record_id"),
        F.lit("part").alias("dataset_name"))
    return M.merge_sources([c, s, p], meta)[0]


@query(
    "u04_ordered_distinct_lists",
    """SELECT grp, string_agg(label, ',' ORDER BY first_ts) AS labels FROM (
      SELECT user_id AS grp, event_type AS label, min(struct_pack(t := epoch_us(ts), i := event_id)) AS first_ts
      FROM events GROUP BY ALL) GROUP BY grp""",
)
def ordered_distinct_lists(spark, sf):
    first = records(spark, sf).groupBy("grp", "label").agg(F.min(F.struct("ts_us", "record_id")).alias("t"))
    ordered = first.groupBy("grp").agg(F.sort_array(F.collect_list(F.struct("t", "label"))).alias("l"))
    return ordered.select("grp", F.array_join(F.array_distinct(F.col("l.label")), ",").alias("labels"))


@query(
    "u05_key_set_difference",
    """SELECT 'both' AS part, user_id AS grp FROM (SELECT user_id FROM events WHERE event_type = 'error'
      INTERSECT SELECT user_id FROM events WHERE event_type = 'view')
    UNION ALL SELECT 'only_error', user_id FROM (SELECT user_id FROM events WHERE event_type = 'error'
      EXCEPT SELECT user_id FROM events WHERE event_type = 'view')""",
)
def key_set_difference(spark, sf):
    r = records(spark, sf)
    a = r.where(F.col("label") == "error").select("grp").distinct()
    b = r.where(F.col("label") == "view").select("grp").distinct()
    both = a.intersect(b).withColumn("part", F.lit("both"))
    only = a.join(b, "grp", "left_anti").withColumn("part", F.lit("only_error"))
    return both.unionByName(only)


# --- counts --------------------------------------------------------------------------
@query(
    "a01_label_counts",
    f"""WITH {REC}, c AS (SELECT label, count(*) AS n FROM rec GROUP BY label),
    s AS (SELECT * FROM (VALUES ('view', 0), ('scan', 1), ('click', 2)) t(label, class_order))
    SELECT coalesce(c.label, s.label) AS label, coalesce(n, 0) AS n, class_order FROM c FULL JOIN s ON c.label = s.label""",
)
def label_counts(spark, sf):
    return Q.label_counts(records(spark, sf), "label", ["view", "scan", "click"])


@query("a02_value_counts_by_group", f"WITH {REC} SELECT grp, label, count(*) AS n FROM rec GROUP BY ALL")
def value_counts_by_group(spark, sf):
    return Q.value_counts(records(spark, sf), "label", ["grp"])


def _dirty(spark, sf):
    r = records(spark, sf)
    return r.select(
        F.when(F.col("k") >= 5, F.col("value")).alias("value"),
        F.when(F.col("k") < 3, F.lit(" ")).otherwise(F.col("label")).alias("label"),
        "record_id",
    )


@query(
    "a03_missing_counts",
    f"""WITH {REC} SELECT 'value' AS column_name, count(*) FILTER (k < 5) AS missing FROM rec
    UNION ALL SELECT 'label', count(*) FILTER (k < 3) FROM rec""",
)
def missing_counts(spark, sf):
    return Q.missing_counts(_dirty(spark, sf))


@query(
    "a04_processing_summary",
    f"""WITH {REC}, c AS (SELECT CASE WHEN k < 3 THEN ' ' ELSE label END AS name, count(*) AS n FROM rec GROUP BY 1)
    SELECT CASE WHEN name = 'view' THEN 'benign_samples' ELSE 'attack_samples' END AS section, name, n FROM c
    UNION ALL SELECT 'missing', 'value', count(*) FILTER (k < 5) FROM rec
    UNION ALL SELECT 'missing', 'label', count(*) FILTER (k < 3) FROM rec""",
)
def processing_summary(spark, sf):
    return Q.processing_summary(_dirty(spark, sf), "label", "view")


@query(
    "a05_merge_summary",
    """SELECT 'o_orderstatus' AS dimension, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
    UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
    UNION ALL SELECT 'year', CAST(year(o_orderdate) AS VARCHAR), count(*) FROM orders GROUP BY 2""",
)
def merge_summary(spark, sf):
    o = table(spark, sf, "orders").withColumn("year", F.year("o_orderdate"))
    return Q.merge_summary(o, ["o_orderstatus", "o_orderpriority", "year"])


@query(
    "a27_split_summary",
    f"""WITH {REC}, s AS (SELECT CASE WHEN k < 70 THEN 'train' ELSE 'test' END AS split, * FROM rec)
    SELECT split, 'records' AS kind, 'all' AS value, count(*) AS n FROM s GROUP BY 1
    UNION ALL SELECT split, 'group', CAST(grp AS VARCHAR), count(*) FROM s GROUP BY 1, 3
    UNION ALL SELECT split, 'label', label, count(*) FROM s GROUP BY 1, 3
    UNION ALL SELECT split, 'ood_label', label, count(*) FROM s WHERE label = 'error' GROUP BY 1, 3
    UNION ALL SELECT split, 'windows', 'all', CAST(sum((n - 8) // 4 + 1) AS BIGINT) FROM (SELECT split, grp, count(*) AS n FROM s GROUP BY ALL) WHERE n >= 8 GROUP BY 1
    UNION ALL SELECT split, 'window_group', CAST(grp AS VARCHAR), CAST((n - 8) // 4 + 1 AS BIGINT) FROM (SELECT split, grp, count(*) AS n FROM s GROUP BY ALL) WHERE n >= 8""",
)
def split_summary(spark, sf):
    split = F.when(F.col("k") < 70, "train").otherwise("test").alias("split")
    r = records(spark, sf).select("record_id", "ts_us", split, F.array("label").alias("labels"), "grp", (F.col("label") == "error").alias("ood"))
    keyed = r.withColumn("key", F.concat_ws(":", "split", "grp"))
    windows = W.count_windows(keyed, "key", ["ts_us", "record_id"], 8, 4).select("key", "split", "grp", "window_idx").distinct()
    return Q.split_summary(r, "split", "labels", "grp", "ood", windows)


@query(
    "a56_group_statistics",
    f"""WITH {REC} SELECT grp, count(*) AS records, count(*) FILTER (label <> 'error') AS id_records,
      count(*) FILTER (label = 'error') AS ood_records, count(DISTINCT label) AS unique_labels,
      coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label <> 'error'), '') AS id_labels,
      coalesce(string_agg(DISTINCT label, ',' ORDER BY label) FILTER (label = 'error'), '') AS ood_labels
    FROM rec GROUP BY grp""",
)
def group_statistics(spark, sf):
    return Q.group_statistics(records(spark, sf), "grp", "label", ["view", "click", "purchase", "signup"])


