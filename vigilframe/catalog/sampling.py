"""Splits, quotas, interleaving, balancing and replay sampling."""

from __future__ import annotations

from pyspark.sql import functions as F

from vigilframe.catalog.registry import query
from vigilframe.catalog.views import REC, records, table
from vigilframe.operators import splits as P
from vigilframe.operators.replay import replay_pool

ORDER = ["ts_us", "record_id"]


def h(seed: int, *cols: str) -> str:
    return "md5(concat_ws('|', " + ", ".join([f"'{seed}'", *[f"CAST({c} AS VARCHAR)" for c in cols]]) + "))"


@query(
    "w12_interleave",
    f"""WITH {REC}, q AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h(7, 'record_id')}, record_id) - 1 AS r
      FROM rec), o AS (SELECT *, r // 4 AS rd FROM q)
    SELECT record_id, label, row_number() OVER (ORDER BY rd, {h(7, 'rd', 'label')}, r) - 1 AS seq FROM o""",
)
def interleave(spark, sf):
    return P.interleave(records(spark, sf), "label", "record_id", 4, 7).select("record_id", "label", "seq")


_STRAT = f"""WITH {REC}, c AS (SELECT label, count(*) AS n, greatest(1, CAST(round_even(count(*) * 0.7, 0) AS BIGINT)) AS t,
      greatest(1, CAST(round_even(count(*) * 0.15, 0) AS BIGINT)) AS v FROM rec GROUP BY label),
    p AS (SELECT rec.*, row_number() OVER (PARTITION BY label ORDER BY {h(11, 'record_id')}, record_id) - 1 AS i FROM rec)
    """


@query(
    "w13_stratified_split",
    _STRAT + """SELECT record_id, p.label, CASE WHEN i < t THEN 'train' WHEN i < t + v THEN 'val' ELSE 'test' END AS split
    FROM p JOIN c ON p.label = c.label""",
)
def stratified_split(spark, sf):
    return P.stratified_split(records(spark, sf), "label", "record_id", 11).select("record_id", "label", "split")


def _remainder_sql(counts: str, target: str, out: str) -> str:
    """Largest-remainder allocation CTEs over (label, n)."""
    return f"""{out}_e AS (SELECT label, n, {target} * n / sum(n) OVER () AS ex FROM {counts}),
    {out}_f AS (SELECT label, n, CAST(floor(ex) AS BIGINT) AS fl,
      row_number() OVER (ORDER BY ex - floor(ex) DESC, label) AS turn FROM {out}_e),
    {out} AS (SELECT label, n, fl + CASE WHEN turn <= {target} - (SELECT sum(fl) FROM {out}_f) THEN 1 ELSE 0 END AS q
      FROM {out}_f)"""


@query(
    "w13_global_ratio_split",
    f"""WITH {REC}, c AS (SELECT label, count(*) AS n FROM rec GROUP BY label),
    tot AS (SELECT CAST(sum(n) AS BIGINT) AS n FROM c),
    {_remainder_sql('c', '(SELECT CAST(floor(n * 0.7) AS BIGINT) FROM tot)', 'a')},
    c2 AS (SELECT label, n - q AS n FROM a),
    {_remainder_sql('c2', '(SELECT CAST(floor(n * 0.15) AS BIGINT) FROM tot)', 'b')}
    SELECT a.label, a.n, CAST(a.q AS BIGINT) AS n_train, CAST(b.q AS BIGINT) AS n_val,
      CAST(a.n - a.q - b.q AS BIGINT) AS n_test FROM a JOIN b ON a.label = b.label""",
)
def global_ratio_split(spark, sf):
    counts = records(spark, sf).groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).first()[0]
    return P.global_ratio_cuts(counts, "label", total)


def _chrono_sql(part: str, order: str) -> str:
    return f"""WITH {REC}, p AS (SELECT *, label = 'error' AS ood,
      row_number() OVER (PARTITION BY {part} ORDER BY {order}) - 1 AS i, count(*) OVER (PARTITION BY {part}) AS n FROM rec),
    c AS (SELECT *, greatest(1, floor(n * 0.7)) AS t, greatest(1, floor(n * 0.15)) AS v FROM p)
    SELECT record_id, grp, CASE WHEN ood THEN 'test_ood' WHEN i < t THEN 'train'
      WHEN i < t + CASE WHEN n - t - v <= 0 AND least(v, greatest(n - t, 0)) > 1 THEN floor(least(v, greatest(n - t, 0)) / 2)
                        ELSE least(v, greatest(n - t, 0)) END THEN 'val' ELSE 'test_id' END AS split FROM c"""


@query("w14_chronological_split", _chrono_sql("label = 'error'", "grp, ts_us, record_id"))
def chronological_split(spark, sf):
    return P.chronological_split(records(spark, sf), F.col("label") == "error", ["grp", *ORDER]).select(
        "record_id", "grp", "split"
    )


@query("w14_chronological_split_per_group", _chrono_sql("label = 'error', grp", "ts_us, record_id"))
def chronological_split_per_group(spark, sf):
    return P.chronological_split(records(spark, sf), F.col("label") == "error", ORDER, group="grp").select(
        "record_id", "grp", "split"
    )


@query(
    "w15_explicit_split_check",
    f"""WITH {REC}, s AS (SELECT *, CASE WHEN k < 2 THEN ' ' WHEN k < 4 THEN 'dev' WHEN k < 60 THEN 'train'
      WHEN label = 'error' THEN 'test_ood' ELSE 'test_id' END AS split FROM rec)
    SELECT count(*) AS records, count(*) FILTER (trim(split) = '') AS blank, count(*) FILTER (split = 'dev') AS unknown_name,
      count(*) FILTER (label = 'error' AND split IN ('train', 'test_id')) AS ood_in_id_split,
      count(*) FILTER (label <> 'error' AND split = 'test_ood') AS id_in_ood_split, false AS valid FROM s""",
)
def explicit_split_check(spark, sf):
    s = (
        F.when(F.col("k") < 2, " ").when(F.col("k") < 4, "dev").when(F.col("k") < 60, "train")
        .when(F.col("label") == "error", "test_ood").otherwise("test_id")
    )
    return P.check_explicit_split(records(spark, sf).withColumn("split", s), "split", F.col("label") == "error")


_QUOTA = """WITH c AS (SELECT l_returnflag || l_linestatus AS label, count(*) AS n FROM lineitem GROUP BY 1),
    b AS (SELECT label, n, least(n, 40) AS base, n - least(n, 40) AS hr FROM c),
    e AS (SELECT *, (500 - (SELECT sum(base) FROM b)) * hr / (SELECT sum(hr) FROM b) AS ex FROM b),
    f AS (SELECT *, CAST(floor(ex) AS BIGINT) AS fl, row_number() OVER (ORDER BY ex - floor(ex) DESC, label) AS turn FROM e),
    q AS (SELECT label, n, CAST(base + fl + CASE WHEN turn <= 500 - (SELECT sum(base) + sum(fl) FROM f) THEN 1 ELSE 0 END
      AS BIGINT) AS quota FROM f)
    """


def _quota_source(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("label"),
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("rid"),
    )


def _alloc(df):
    counts = df.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return P.quotas(counts, "label", "n", 500, 40)


@query("w16_label_quotas", _QUOTA + "SELECT * FROM q")
def label_quotas(spark, sf):
    return _alloc(_quota_source(spark, sf))


@query(
    "w16_quota_sample",
    _QUOTA + f""", s AS (SELECT l_returnflag || l_linestatus AS label,
      concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS rid FROM lineitem),
    r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {h(5, 'rid')}, rid) AS rn FROM s)
    SELECT r.label, rid FROM r JOIN q ON r.label = q.label WHERE rn <= quota""",
)
def quota_sample(spark, sf):
    src = _quota_source(spark, sf)
    return P.take_quota(src, _alloc(src), "label", "quota", "rid", 5)


@query(
    "w16_rebalance",
    """WITH c AS (SELECT o_orderpriority AS label, count(*) AS n FROM orders GROUP BY 1),
    w AS (SELECT label, n, CASE WHEN label = '1-URGENT' THEN n + 100 ELSE n - 90 END AS want FROM c),
    s AS (SELECT *, least(n, want) AS take, greatest(n - want, 0) AS sur FROM w),
    e AS (SELECT *, least((SELECT sum(greatest(want - n, 0)) FROM s), (SELECT sum(sur) FROM s)) AS mv FROM s),
    x AS (SELECT *, mv * sur / (SELECT sum(sur) FROM s) AS ex FROM e),
    f AS (SELECT *, CAST(floor(ex) AS BIGINT) AS fl, row_number() OVER (ORDER BY ex - floor(ex) DESC, label) AS turn FROM x)
    SELECT label, n, CAST(want AS BIGINT) AS want, CAST(take + fl + CASE WHEN turn <= mv - (SELECT sum(fl) FROM f) THEN 1 ELSE 0 END
      AS BIGINT) AS final FROM f""",
)
def rebalance(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    w = c.withColumn("want", F.when(F.col("label") == "1-URGENT", F.col("n") + 100).otherwise(F.col("n") - 90))
    return P.rebalance(w, "label", "n", "want")


@query(
    "w16_oversample_targets",
    """SELECT o_orderpriority AS label, count(*) AS n, CAST(least(count(*), greatest(count(*) // 3,
      CAST(ceil((count(*) // 3) * 1.25) AS BIGINT))) AS BIGINT) AS raw_target FROM orders GROUP BY 1""",
)
def oversample_targets(spark, sf):
    c = table(spark, sf, "orders").groupBy(F.col("o_orderpriority").alias("label")).agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("raw_target", P.oversample_target(F.floor(F.col("n") / 3), F.col("n"), 1.25))


_SPLIT3 = "CASE WHEN k < 70 THEN 'train' WHEN k < 85 THEN 'val' ELSE 'test' END"


def _with_split(spark, sf):
    return records(spark, sf).withColumn(
        "split", F.when(F.col("k") < 70, "train").when(F.col("k") < 85, "val").otherwise("test")
    )


_GROUP_BASE = f"""WITH {REC}, p AS (SELECT record_id, label, {_SPLIT3} AS split,
      row_number() OVER (PARTITION BY {_SPLIT3} ORDER BY ts_us, record_id) - 1 AS i,
      count(*) OVER (PARTITION BY {_SPLIT3}) AS n, ts_us FROM rec)"""


@query(
    "w17_groups_round_robin",
    _GROUP_BASE + " SELECT record_id, split, 'uav_' || lpad(CAST(i % 6 AS VARCHAR), 2, '0') AS uav_id FROM p",
)
def groups_round_robin(spark, sf):
    return P.assign_groups(_with_split(spark, sf), "split", ORDER, 6).select("record_id", "split", "uav_id")


@query(
    "w17_groups_block",
    _GROUP_BASE + """ SELECT record_id, split, 'uav_' || lpad(CAST(CASE WHEN i < (n % 6) * (n // 6 + 1) THEN i // (n // 6 + 1)
      ELSE n % 6 + (i - (n % 6) * (n // 6 + 1)) // (n // 6) END AS VARCHAR), 2, '0') AS uav_id FROM p""",
)
def groups_block(spark, sf):
    return P.assign_groups(_with_split(spark, sf), "split", ORDER, 6, "block").select("record_id", "split", "uav_id")


@query(
    "w17_groups_stratified",
    _GROUP_BASE + """, l AS (SELECT split, label, count(*) AS c, min(i) AS f FROM p GROUP BY ALL),
    o AS (SELECT *, sum(c) OVER (PARTITION BY split ORDER BY f) - c AS off FROM l),
    q AS (SELECT p.*, row_number() OVER (PARTITION BY split, label ORDER BY i) - 1 AS j FROM p)
    SELECT record_id, q.split, 'uav_' || lpad(CAST(CAST((j + off) % 6 AS BIGINT) AS VARCHAR), 2, '0') AS uav_id
    FROM q JOIN o ON q.split = o.split AND q.label = o.label""",
)
def groups_stratified(spark, sf):
    return P.assign_groups(_with_split(spark, sf), "split", ORDER, 6, "stratified", "label").select(
        "record_id", "split", "uav_id"
    )


@query(
    "w18_balance_resample",
    f"""WITH s AS (SELECT o_orderkey, o_orderstatus AS label FROM orders),
    c AS (SELECT label, count(*) AS n FROM s GROUP BY 1), g AS (SELECT CAST(floor(max(n)) AS BIGINT) AS target FROM c),
    d AS (SELECT label, n, CASE WHEN n >= 1 AND n < target THEN target - n ELSE 0 END AS copies FROM c, g),
    p AS (SELECT s.*, row_number() OVER (PARTITION BY label ORDER BY {h(3, 'o_orderkey')}, o_orderkey) - 1 AS p FROM s)
    SELECT o_orderkey, label, 'real' AS row_origin, 0 AS copy_no FROM s
    UNION ALL SELECT o_orderkey, p.label, 'resampled', j + 1 FROM p JOIN d ON p.label = d.label,
      LATERAL (SELECT unnest(range(p.p, d.copies, d.n)) AS j)""",
)
def balance_resample(spark, sf):
    s = table(spark, sf, "orders").select("o_orderkey", F.col("o_orderstatus").alias("label"))
    counts = s.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return P.resample(s, P.balance_targets(counts, "label", "n", "max"), "label", "o_orderkey", 3)


@query(
    "w18_balance_targets",
    """WITH c AS (SELECT CAST(p_size AS BIGINT) AS size, count(*) AS n FROM part GROUP BY 1),
    t AS (SELECT CAST(floor(quantile_cont(n, 0.5)) AS BIGINT) AS m, CAST(floor(quantile_cont(n, 0.9)) AS BIGINT) AS q FROM c)
    SELECT size, n, 'median' AS mode, m AS target, CASE WHEN n >= 10 AND n < m THEN m - n ELSE 0 END AS copies FROM c, t
    UNION ALL SELECT size, n, 'quantile', q, CASE WHEN n >= 10 AND n < q THEN q - n ELSE 0 END FROM c, t
    UNION ALL SELECT size, n, 'fixed', 60, CASE WHEN n >= 10 AND n < 60 THEN 60 - n ELSE 0 END FROM c""",
)
def balance_targets(spark, sf):
    c = table(spark, sf, "part").groupBy(F.col("p_size").cast("long").alias("size")).agg(F.count(F.lit(1)).alias("n"))
    parts = [
        P.balance_targets(c, "size", "n", m, v, min_real=10).withColumn("mode", F.lit(m))
        for m, v in (("median", 0.5), ("quantile", 0.9), ("fixed", 60))
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "w19_leave_one_class_out",
    f"""WITH {REC}, f AS (SELECT unnest(['view', 'click', 'purchase', 'signup', 'error']) AS held_out)
    SELECT held_out, CASE WHEN label = held_out THEN 'test_ood' ELSE 'id' END AS part, count(*) AS n FROM rec, f GROUP BY ALL""",
)
def leave_one_class_out(spark, sf):
    folds = P.leave_one_class_out(records(spark, sf), "label", ["view", "click", "purchase", "signup", "error"])
    return folds.groupBy("held_out", "part").agg(F.count(F.lit(1)).alias("n"))


@query(
    "w19_family_holdout",
    f"""WITH {REC} SELECT record_id, CASE WHEN label IN ('purchase', 'signup') THEN 'conversion' WHEN label = 'error'
      THEN 'fault' ELSE 'browse' END AS family, CASE WHEN label = 'error' THEN 'test_ood' ELSE 'id' END AS part FROM rec""",
)
def family_holdout(spark, sf):
    fam = F.when(F.col("label").isin("purchase", "signup"), "conversion").when(F.col("label") == "error", "fault").otherwise(
        "browse"
    )
    return P.family_holdout(records(spark, sf), "label", fam, ["fault"]).select("record_id", "family", "part")


@query(
    "w19_cross_group",
    """SELECT 'EU' AS train_group, 'NA' AS test_group, c_custkey, CASE r WHEN 'EU' THEN 'train' ELSE 'test' END AS part FROM
      (SELECT c_custkey, CASE WHEN n_regionkey < 2 THEN 'EU' ELSE 'NA' END AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)
    UNION ALL SELECT 'NA', 'EU', c_custkey, CASE r WHEN 'NA' THEN 'train' ELSE 'test' END FROM
      (SELECT c_custkey, CASE WHEN n_regionkey < 2 THEN 'EU' ELSE 'NA' END AS r FROM customer JOIN nation ON c_nationkey = n_nationkey)""",
)
def cross_group(spark, sf):
    c = table(spark, sf, "customer").join(
        table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")
    ).select("c_custkey", F.when(F.col("n_regionkey") < 2, "EU").otherwise("NA").alias("r"))
    return P.cross_group(c, "r", [("EU", "NA"), ("NA", "EU")]).drop("r")


def _pool_sql(mode: str) -> str:
    pick = {
        "sequential": "JOIN q ON q.grp = d.grp AND q.rn = d.slot WHERE d.slot < d.n",
        "loop": "JOIN q ON q.grp = d.grp AND q.rn = d.slot % d.n",
        "random": "JOIN q ON q.grp = d.grp AND q.rn = CAST('0x' || substr(" + h(9, "d.grp", "d.slot") + ", 1, 12) AS BIGINT) % d.n",
    }[mode]
    return f"""WITH {REC}, q AS (SELECT grp, record_id, row_number() OVER (PARTITION BY grp ORDER BY ts_us, record_id) - 1 AS rn,
      count(*) OVER (PARTITION BY grp) AS n FROM rec WHERE label IN ('error', 'click')),
    s AS (SELECT DISTINCT grp, n FROM q),
    d AS (SELECT grp, n, step, step * 3 + r AS slot, r FROM s, range(12) t(step), range(3) u(r))
    SELECT d.grp, CAST(d.step AS BIGINT) AS step, CAST(d.r AS BIGINT) AS draw, q.record_id FROM d {pick}"""


def _replay(spark, sf, mode):
    r = records(spark, sf)
    steps = r.select("grp").distinct().withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(11)).cast("array<long>")))
    return replay_pool(r, steps, "grp", "label", ["error", "click"], ORDER, "step", 3, mode, seed=9).select(
        "grp", "step", "draw", "record_id"
    )


@query("j17_replay_sequential", _pool_sql("sequential"))
def replay_sequential(spark, sf):
    return _replay(spark, sf, "sequential")


@query("j17_replay_loop", _pool_sql("loop"))
def replay_loop(spark, sf):
    return _replay(spark, sf, "loop")


@query("j17_replay_random", _pool_sql("random"))
def replay_random(spark, sf):
    return _replay(spark, sf, "random")
