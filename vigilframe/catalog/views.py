"""The record, window-vector and detection views the queries share, in both languages."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ID_CLASSES = ["view", "click", "purchase", "signup"]  # "view" is benign, "error" is out of distribution
VECTOR_CLASSES = [0, 1, 2, 3, 4, 5, 6, 7]  # labels 8 and 9 are out of distribution


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(df: DataFrame, name: str) -> Column:
    """Epoch microseconds of a timestamp column; a column without zone counts as UTC."""
    c = F.col(name)
    if isinstance(df.schema[name].dataType, T.TimestampNTZType):
        seconds = (F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000
        fraction = (F.extract(F.lit("SECOND"), c) * 1_000_000).cast("long")
        return F.unix_date(c.cast("date")).cast("long") * 86_400_000_000 + seconds + fraction
    return F.unix_micros(c)


def r6(c: Column | str) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def ieee_divide(a: Column, b: Column) -> Column:
    """Quotient of doubles as the SQL has it: by zero it is infinite, or NaN for 0 / 0."""
    by_zero = F.when(a > 0, F.lit(math.inf)).when(a < 0, F.lit(-math.inf)).when(a.isNotNull(), F.lit(math.nan))
    return F.when(b == 0, by_zero).otherwise(F.try_divide(a, b))


def round_double(c: Column | str, places: int) -> Column:
    """round() of a double as the SQL has it: the scaled number is rounded, half away from zero, and scaled back.

    ``F.round`` rounds the decimal digits of the number instead; the two part where the scaled number has no room for a
    fraction.
    """
    c = F.col(c) if isinstance(c, str) else c
    scaled = F.abs(c) * F.lit(10.0**places)
    whole = F.when(scaled < 2.0**52, F.floor(scaled + 0.5).cast("double")).otherwise(scaled)
    return F.when(F.isnan(c) | (scaled == math.inf), c).otherwise(F.signum(c) * whole / F.lit(10.0**places))


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Events as a keyed, time-ordered, labelled record table."""
    e = table(spark, sf, "events")
    return e.select(
        F.col("event_id").alias("record_id"),
        F.col("user_id").alias("grp"),
        micros(e, "ts").alias("ts_us"),
        F.col("event_type").alias("label"),
        "value",
        F.get_json_object("props", "$.k").cast("double").alias("k"),
    )


REC = """rec AS (
  SELECT event_id AS record_id, user_id AS grp, epoch_us(ts) AS ts_us, event_type AS label, value,
         CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k
  FROM events)"""

# 0-based position and group size
POS = REC + """,
pos AS (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY ts_us, record_id) - 1 AS p,
         count(*) OVER (PARTITION BY grp) AS n
  FROM rec)"""


def count_window_sql(size: int, stride: int) -> str:
    """Long-form count windows as a CTE named win."""
    return POS + f""",
win AS (
  SELECT pos.*, w.w AS window_idx, p - w.w * {stride} AS window_pos
  FROM pos, LATERAL (SELECT unnest(range(
      greatest(0, CAST(ceil((p - {size} + 1) / {stride}.0) AS BIGINT)),
      CAST(floor(p / {stride}.0) AS BIGINT) + 1)) AS w) w
  WHERE w.w * {stride} + {size} <= n)"""


def detections(spark: SparkSession, sf: str) -> DataFrame:
    """One-record windows of the events with a score, a threshold and the truth."""
    r = records(spark, sf)
    score = F.round(F.col("value") / 50, 6)
    attack = ~F.col("label").isin("view")
    known = F.col("label").isin("click", "signup") & (F.col("k") >= 40)
    thr = F.lit(0.9)
    return r.select(
        F.col("record_id").alias("window_id"),
        F.concat(F.lit("u"), F.col("grp").cast("string")).alias("group_id"),
        F.col("grp"),
        "ts_us",
        F.floor(F.col("ts_us") / 3600000000).cast("long").alias("hour"),
        score.alias("ood_score"),
        F.round(score * 2 - 1, 6).alias("raw_ood_score"),
        thr.alias("threshold"),
        (score > thr).alias("is_ood"),
        known.alias("known_attack_alert"),
        (known | (score > thr)).alias("has_alert"),
        attack.alias("attack_active"),
        (F.col("label") == "error").alias("truth_ood"),
        "label",
        "k",
        F.when(score - thr >= 1.0, "critical").when(score > thr, "warning").otherwise("normal").alias("alert_level"),
    )


DET = REC + """,
det AS (
  SELECT record_id AS window_id, 'u' || CAST(grp AS VARCHAR) AS group_id, grp, ts_us,
         CAST(floor(ts_us / 3600000000.0) AS BIGINT) AS hour,
         round(value / 50, 6) AS ood_score, round(round(value / 50, 6) * 2 - 1, 6) AS raw_ood_score,
         CAST(0.9 AS DOUBLE) AS threshold,
         round(value / 50, 6) > CAST(0.9 AS DOUBLE) AS is_ood,
         (label IN ('click', 'signup') AND k >= 40) AS known_attack_alert,
         ((label IN ('click', 'signup') AND k >= 40) OR round(value / 50, 6) > CAST(0.9 AS DOUBLE)) AS has_alert,
         label <> 'view' AS attack_active, label = 'error' AS truth_ood, label, k,
         CASE WHEN round(value / 50, 6) - CAST(0.9 AS DOUBLE) >= 1.0 THEN 'critical'
              WHEN round(value / 50, 6) > CAST(0.9 AS DOUBLE) THEN 'warning' ELSE 'normal' END AS alert_level
  FROM rec)"""


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Embeddings standing in for scored windows."""
    e = table(spark, sf, "embeddings")
    return e.select(
        "vec_id",
        (F.col("vec_id") % 7).alias("grp"),
        "label",
        F.col("embedding").cast("array<double>").alias("vec"),
        F.col("label").isin(8, 9).alias("truth_ood"),
    )


VEC = """vec AS (
  SELECT vec_id, vec_id % 7 AS grp, label, CAST(embedding AS DOUBLE[]) AS v, label IN (8, 9) AS truth_ood
  FROM embeddings)"""

# class means of the known classes
PROTO = VEC + """,
elem AS (SELECT label, vec_id, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM vec),
proto AS (
  SELECT label AS class, list(m ORDER BY i) AS mu
  FROM (SELECT label, i, avg(x) AS m FROM elem WHERE label < 8 GROUP BY label, i) GROUP BY label)"""

# raw scores: logits are 4 * dot, identity precision, bank = known-class vectors, k = 5
SCALE = 4.0
SCORES = PROTO + """,
lg AS (SELECT vec_id, grp, label, truth_ood, class, 4.0 * list_dot_product(v, mu) AS z,
              list_distance(v, mu) AS dist FROM vec, proto),
base AS (
  SELECT vec_id, any_value(grp) AS grp, any_value(label) AS label, any_value(truth_ood) AS truth_ood,
         1 - max(1 / (1 + exp(-z))) AS conf, -(max(z) + ln(sum(exp(z - zm)))) AS energy, min(dist) AS proto
  FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS zm FROM lg) GROUP BY vec_id),
sims AS (
  SELECT a.vec_id, list_cosine_similarity(a.v, b.v) AS s,
         row_number() OVER (PARTITION BY a.vec_id ORDER BY list_cosine_similarity(a.v, b.v) DESC) AS rn
  FROM vec a, vec b WHERE b.label < 8),
raw AS (
  SELECT base.*, s.knn FROM base
  JOIN (SELECT vec_id, -avg(s) AS knn FROM sims WHERE rn <= 5 GROUP BY vec_id) s USING (vec_id))"""
