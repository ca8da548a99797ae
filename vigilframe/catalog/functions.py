"""Scalar functions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import functions as F

from vigilframe.catalog.registry import query
from vigilframe.catalog.views import DET, REC, VEC, detections, r6, records, table, vectors
from vigilframe.functions import fixed
from vigilframe.functions import scores as S
from vigilframe.functions import text as X


@query(
    "f01_token_normalize",
    r"""SELECT doc_id, CASE WHEN t = '' THEN 'unknown' ELSE t END AS token FROM (
      SELECT doc_id, regexp_replace(regexp_replace(replace(lower(trim(text, ' ')), '&', ' and '), '[^a-z0-9]+', '_', 'g'),
        '^_+|_+$', '', 'g') AS t FROM documents)""",
)
def token_normalize(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.normalize_token(F.col("text")).alias("token"))


def _label_cases() -> str:
    keys = list(dict.fromkeys(chain.from_iterable(m for m in fixed.LABEL_MAPS.values())))
    return ", ".join("'" + k + "'" for k in keys)


def _map_sql(source: str) -> str:
    whens = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in fixed.LABEL_MAPS[source].items())
    if source in fixed.RAW_LABEL_MAPS:
        return f"CASE raw {whens} ELSE lower(replace(replace(raw, ' ', '_'), '-', '_')) END AS {source}"
    token = "regexp_replace(regexp_replace(lower(raw), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"CASE {token} {whens} ELSE {token} END AS {source}"


@query(
    "f02_label_maps",
    f"""WITH names AS (SELECT [{_label_cases()}, 'Odd-Label x'] AS l),
    src AS (SELECT event_id AS record_id, l[event_id % len(l) + 1] AS raw FROM events, names)
    SELECT record_id, {", ".join(_map_sql(s) for s in fixed.LABEL_MAPS)} FROM src""",
)
def label_maps(spark, sf):
    names = [*dict.fromkeys(chain.from_iterable(m for m in fixed.LABEL_MAPS.values())), "Odd-Label x"]
    raw = F.element_at(F.array(*[F.lit(n) for n in names]), (F.col("record_id") % len(names) + 1).cast("int"))
    r = records(spark, sf).select("record_id", F.concat(F.lit(" "), raw).alias("raw"))
    return r.select("record_id", *[X.map_label(F.col("raw"), s).alias(s) for s in fixed.LABEL_MAPS])


@query(
    "f03_adapter_label",
    """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'benign' WHEN 'P' THEN 'benign'
      ELSE lower(replace(replace(o_orderpriority, ' ', '_'), '-', '_')) END AS label FROM orders""",
)
def adapter_label(spark, sf):
    raw = (
        F.when(F.col("o_orderstatus") == "F", F.lit(None))
        .when(F.col("o_orderstatus") == "P", F.lit(" Normal "))
        .otherwise(F.col("o_orderpriority"))
    )
    return table(spark, sf, "orders").select("o_orderkey", X.adapter_label(raw).alias("label"))


@query(
    "f04_group_id",
    f"WITH {REC} SELECT record_id, CASE WHEN label IN ('view', 'error') THEN NULL ELSE CAST(grp AS VARCHAR) END AS g FROM rec",
)
def group_id(spark, sf):
    raw = F.when(F.col("label") == "view", "  ").when(F.col("label") == "error", "nan").otherwise(
        F.concat(F.lit(" "), F.col("grp").cast("string"))
    )
    return records(spark, sf).select("record_id", X.group_id(raw).alias("g"))


@query(
    "f05_timestamp_build",
    """WITH i AS (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS idx FROM orders)
    SELECT o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN CAST(idx AS VARCHAR)
      ELSE strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') END AS timestamp FROM i""",
)
def timestamp_build(spark, sf):
    from vigilframe.operators.clean import build_timestamp
    from vigilframe.operators.ordering import position

    o = table(spark, sf, "orders").select(
        "o_orderkey",
        F.when(F.col("o_orderkey") % 10 == 0, "?").otherwise(F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")).alias("t"),
    )
    return build_timestamp(position(o, [], ["o_orderkey"], "idx"), "t", "idx").select("o_orderkey", "timestamp")


@query(
    "f06_forward_filled_time",
    """WITH n AS (SELECT event_id, CASE WHEN event_id % 7 = 3 THEN NULL ELSE value END AS v FROM events)
    SELECT event_id, coalesce(last_value(v IGNORE NULLS) OVER (ORDER BY event_id), 0.0) AS ts FROM n""",
)
def forward_filled_time(spark, sf):
    from vigilframe.operators.clean import adapter_timestamp

    e = table(spark, sf, "events").select(
        "event_id", F.when(F.col("event_id") % 7 == 3, "?").otherwise(F.col("value").cast("string")).alias("t")
    )
    return adapter_timestamp(e, "t", ["event_id"]).select("event_id", F.col("__ts").alias("ts"))


@query(
    "f07_token_lists",
    f"""WITH {REC} SELECT record_id, label || ',scan' AS comma,
      CASE WHEN label = 'view' THEN 'flood' WHEN label = 'click' THEN 'click,flood' ELSE label || ',flood' END AS attacks,
      CASE WHEN label = 'view' THEN 'benign' ELSE label END AS collapsed FROM rec""",
)
def token_lists(spark, sf):
    r = records(spark, sf)
    named = F.when(F.col("label") == "view", "benign").otherwise(F.col("label"))
    return r.select(
        "record_id",
        F.array_join(X.comma_list(F.concat(F.lit(" "), "label", F.lit(" , ,scan"))), ",").alias("comma"),
        F.array_join(X.attack_tokens(F.concat(F.upper(named), F.lit("+ Flood, "), F.upper(named))), ",").alias("attacks"),
        X.collapse_attacks(F.array(named, F.lit("benign"), named)).alias("collapsed"),
    )


@query(
    "f08_alert_level",
    f"""WITH {REC} SELECT record_id, CASE WHEN m >= 1 THEN 'critical' WHEN m >= 0 THEN 'warning' WHEN m >= -0.25 THEN 'watch'
      ELSE 'normal' END AS level FROM (SELECT record_id, round(value / 40 - 0.5, 6) AS m FROM rec)""",
)
def alert_level(spark, sf):
    return records(spark, sf).select("record_id", S.alert_level(F.round(F.col("value") / 40 - 0.5, 6)).alias("level"))


@query(
    "f09_alert_channels",
    f"""WITH {DET} SELECT window_id, CASE WHEN known_attack_alert AND is_ood THEN 'known_attack+ood'
      WHEN known_attack_alert THEN 'known_attack' WHEN is_ood THEN 'ood' ELSE 'none' END AS reason, has_alert,
      has_alert AND NOT attack_active AS false_alert,
      CASE WHEN truth_ood THEN 'ood' WHEN attack_active THEN 'attack' ELSE 'benign' END AS part FROM det""",
)
def alert_channels(spark, sf):
    return detections(spark, sf).select(
        "window_id",
        S.alert_reason(F.col("known_attack_alert"), F.col("is_ood")).alias("reason"),
        "has_alert",
        (F.col("has_alert") & ~F.col("attack_active")).alias("false_alert"),
        S.window_partition(F.col("truth_ood"), F.col("attack_active")).alias("part"),
    )


@query(
    "f10_record_id_synthesis",
    f"""WITH {REC} SELECT record_id, CASE WHEN label = 'error' THEN 'stream' ELSE CAST(grp AS VARCHAR) END || ':' ||
      printf('%.6f', ts_us / 1e6) || ':' || record_id AS rid,
      CASE label WHEN 'view' THEN 'benign' WHEN 'click' THEN 'udp_flooding' ELSE label END AS attack_label,
      value + k AS throughput FROM rec""",
)
def record_id_synthesis(spark, sf):
    r = records(spark, sf)
    g = F.when(F.col("label") != "error", F.col("grp").cast("string"))
    kind = F.when(F.col("label") == "click", "flood").otherwise(F.col("label"))
    return r.select(
        "record_id",
        X.synthesize_record_id(g, F.col("ts_us") / 1e6, F.col("record_id")).alias("rid"),
        X.attack_label(F.col("label") != "view", kind).alias("attack_label"),
        (F.col("value") + F.col("k")).alias("throughput"),
    )


@query(
    "f11_hypothesis_text",
    "WITH s AS (SELECT vec_id, CASE vec_id % 5 WHEN 0 THEN 'knn' WHEN 1 THEN 'proto' WHEN 2 THEN 'energy' WHEN 3 THEN 'conf' "
    "ELSE 'other' END AS s FROM embeddings) SELECT vec_id, CASE s "
    + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.HYPOTHESES.items())
    + f" ELSE '{S.HYPOTHESIS_DEFAULT}' END AS text FROM s",
)
def hypothesis_text(spark, sf):
    src = F.element_at(F.array(*[F.lit(x) for x in ("knn", "proto", "energy", "conf", "other")]),
                       (F.col("vec_id") % 5 + 1).cast("int"))
    return vectors(spark, sf).select("vec_id", S.hypothesis(src).alias("text"))


@query(
    "f12_baseline_uncertainty",
    f"""WITH {VEC}, p AS (SELECT vec_id, list_transform(v, lambda z: 1 / (1 + exp(-z / 1.5))) AS p FROM vec)
    SELECT vec_id, round(list_max(p), 6) AS max_prob, round(1 - list_max(p), 6) AS conf,
      round(-list_sum(list_transform(p, lambda q: ln(1 + exp(ln(q / (1 - q)))))), 6) AS energy FROM p""",
)
def baseline_uncertainty(spark, sf):
    v = vectors(spark, sf).select("vec_id", F.transform("vec", lambda z: S.sigmoid(z, 1.5)).alias("p"))
    return v.select("vec_id", *[r6(c).alias(n) for n, c in S.binary_uncertainty(F.col("p")).items()])


@query(
    "f15_dominant_source",
    f"""WITH {VEC}, s AS (SELECT vec_id, v[1] AS a, v[2] AS b, v[3] AS c, v[4] AS d FROM vec)
    SELECT vec_id, CASE greatest(a, b, c, d) WHEN a THEN 'conf' WHEN b THEN 'energy' WHEN c THEN 'proto' ELSE 'knn' END
      AS source FROM s""",
)
def dominant_source(spark, sf):
    cols = {n: F.col("vec")[i] for i, n in enumerate(fixed.SCORE_NAMES)}
    return vectors(spark, sf).select("vec_id", S.dominant_source(cols, fixed.SCORE_NAMES).alias("source"))


PHASE_SQL = """ph AS (
  SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, ln(1 + l_quantity) AS log_packets_s,
    ln(1 + l_extendedprice) AS log_bytes_s, ln(1 + l_tax) AS log_iat_mean, ln(1 + l_discount) AS log_duration,
    ln(1 + greatest(l_extendedprice / l_quantity, 0)) AS log_packet_size, ln(1 + l_quantity + l_linenumber) AS log_total_packets,
    l_quantity / greatest(l_quantity + l_linenumber, 1e-6) AS direction_ratio,
    greatest(0, 1 - abs(l_quantity / greatest(l_quantity + l_linenumber, 1e-6) - 0.5) * 2) AS direction_balance
  FROM lineitem)"""
PHASE_NAMES = [
    "log_packets_s", "log_bytes_s", "log_iat_mean", "log_duration", "log_packet_size", "log_total_packets",
    "direction_ratio", "direction_balance",
]


def phase_table(spark, sf):
    li = table(spark, sf, "lineitem")
    feats = S.phase_features(
        F.col("l_quantity"), F.col("l_extendedprice"), F.col("l_tax"), F.col("l_discount"),
        F.col("l_extendedprice") / F.col("l_quantity"), F.col("l_quantity"), F.col("l_linenumber").cast("double"),
    )
    return li.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", *[c.alias(n) for n, c in feats.items()]
    )


@query(
    "f16_phase_features",
    f"WITH {PHASE_SQL} SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, "
    + ", ".join(f"round({n}, 5) AS {n}" for n in PHASE_NAMES)
    + " FROM ph",
)
def phase_features(spark, sf):
    p = phase_table(spark, sf)
    return p.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", *[F.round(n, 5).alias(n) for n in PHASE_NAMES]
    )


@query(
    "f17_json_metric_pick",
    f"""WITH {REC} SELECT record_id, k AS metric, round(value, 2) AS parsed, k >= 50 AS flag FROM rec""",
)
def json_metric_pick(spark, sf):
    e = table(spark, sf, "events")
    picked = X.pick_json(F.col("props"), ["$.missing.deep", "$.k"]).cast("double")
    cell = F.format_string("%.2f ± 0.10", F.col("value"))
    return e.select(
        F.col("event_id").alias("record_id"),
        picked.alias("metric"),
        X.loose_number(cell).alias("parsed"),
        X.loose_bool(F.when(picked >= 50, " Yes").otherwise("0")).alias("flag"),
    )


@query(
    "f18_mean_std_format",
    """SELECT l_returnflag, printf('%.4f ± %.4f', avg(l_discount), stddev_pop(l_discount)) AS cell FROM lineitem GROUP BY 1""",
)
def mean_std_format(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_returnflag").agg(
        X.format_mean_std(F.avg("l_discount"), F.stddev_pop("l_discount")).alias("cell")
    )


@query(
    "f19_row_fingerprint",
    """SELECT count(*) AS patterns, count(*) AS fingerprints FROM (SELECT DISTINCT l_quantity, l_discount, l_tax,
      l_returnflag FROM lineitem)""",
)
def row_fingerprint(spark, sf):
    li = table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax", "l_returnflag").distinct()
    return li.withColumn("h", X.row_fingerprint(*li.columns)).agg(
        F.count(F.lit(1)).alias("patterns"), F.count_distinct("h").alias("fingerprints")
    )
