"""The plain and the ranged path of every ordered helper agree for all key types."""

import datetime as dt
import decimal
import math

import pytest
from pyspark.sql import functions as F

from vigilframe.operators import ordering as O

DAY = dt.date(2024, 1, 1)
VALUES = {
    "double": [float("nan"), math.inf, -math.inf, None, *[i * 0.5 for i in range(-20, 20)]],
    "bigint": [None, 2**60, 2**60 + 1, 2**60 + 2, -(2**62), *range(30)],
    "date": [None, *[DAY + dt.timedelta(days=3 * i) for i in range(40)]],
    "timestamp_ntz": [None, *[dt.datetime(2024, 1, 1) + dt.timedelta(seconds=7 * i) for i in range(40)]],
    "decimal(30,4)": [None, *[decimal.Decimal(10) ** 20 + decimal.Decimal(i) / 10000 for i in range(40)]],
    "string": [None, *[f"uav_01_00000000{i:05d}" for i in range(60)]],
}


@pytest.fixture(scope="module", params=sorted(VALUES))
def rows(spark, request):
    values = VALUES[request.param]
    data = [(i, "ab"[i % 3 == 0], values[(i * 7) % len(values)], float(i % 11) if i % 4 else None) for i in range(400)]
    return spark.createDataFrame(data, f"id long, g string, k {request.param}, v double").cache()


def same(a, b):
    key = lambda r: tuple("nan" if isinstance(x, float) and x != x else repr(x) for x in r)
    assert sorted(map(key, a.select(sorted(a.columns)).collect())) == sorted(map(key, b.select(sorted(b.columns)).collect()))


@pytest.mark.parametrize("keys", [[], ["g"]])
@pytest.mark.parametrize(
    "apply",
    [
        lambda d, k, n: O.position(d, k, ["k", "id"], "p", "m", buckets=n),
        lambda d, k, n: O.position(d, k, ["-k", "-id"], "p", buckets=n),
        lambda d, k, n: O.running_sums(d.withColumn("one", F.lit(1)), k, ["k", "id"], {"s": "one"}, buckets=n),
        lambda d, k, n: O.previous(d, k, ["k", "id"], "v", "prev", buckets=n),
        lambda d, k, n: O.last_known(d, k, ["k", "id"], "v", "known", buckets=n),
    ],
    ids=["position", "position_desc", "running_sums", "previous", "last_known"],
)
def test_both_paths_agree(rows, keys, apply):
    same(apply(rows, keys, 1), apply(rows, keys, 8))


def test_quantiles_keep_keys_without_values(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None), (None, 2.0)], "g string, v double")
    got = [O.quantiles(df, ["g"], "v", {"q": 0.5}, buckets=n) for n in (1, 8)]
    same(*got)
    assert got[1].count() == 3


def test_a_common_prefix_does_not_fill_one_range(spark):
    df = spark.range(20000).select(F.format_string("uav_01_%012d", "id").alias("k"))
    sizes = [r["count"] for r in O.with_bucket(df, ["k"], 8).groupBy(O.BUCKET).count().collect()]
    assert len(sizes) == 8 and max(sizes) <= 2 * 20000 / 8


def test_small_join_broadcasts_or_salts(spark, monkeypatch):
    left = spark.range(3000).select(F.when(F.col("id") % 3 > 0, "hot").alias("g"), "id")
    right = spark.createDataFrame([("hot", 1), (None, 2)], "g string, n int")
    plain = O.match_small(left, right, ["g"])
    monkeypatch.setattr(O, "auto_buckets", lambda *a: 8)
    same(plain, O.match_small(left, right, ["g"]))
    monkeypatch.setattr(O, "SMALL_ROWS", 0)
    same(plain, O.match_small(left, right, ["g"]))
