"""The bucketed ordering helpers equal a plain computation, also on skewed and tied keys."""

import numpy as np
import pandas as pd
import pytest

from vigilframe.operators import ordering as O


def skewed(n=3000, seed=1):
    """One group holds a third of the rows, one time value a third of those, plus NULLs."""
    rng = np.random.default_rng(seed)
    g = np.where(rng.random(n) < 0.34, "hot", rng.choice(list("abcdef"), n))
    ts = rng.integers(0, 500, n).astype(float)
    ts[rng.random(n) < 0.33] = 77.0
    v = rng.normal(size=n).round(2)
    df = pd.DataFrame({"g": g, "ts": ts, "id": np.arange(n), "v": v})
    df.loc[rng.random(n) < 0.3, "v"] = np.nan
    df.loc[rng.random(n) < 0.02, "g"] = None
    return df.sample(frac=1, random_state=seed).reset_index(drop=True)


@pytest.fixture(scope="module")
def frames(spark):
    pdf = skewed()
    sdf = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "g string, ts double, id long, v double")
    ordered = pdf.sort_values(["ts", "id"]).reset_index(drop=True)
    ordered["g"] = ordered["g"].fillna("~null~")
    return sdf, ordered


@pytest.mark.parametrize("buckets", [1, 2, 16])
def test_position_per_group(frames, buckets):
    sdf, pdf = frames
    got = O.position(sdf, ["g"], ["ts", "id"], "p", size_name="n", buckets=buckets).toPandas().set_index("id").sort_index()
    exp = pdf.assign(p=pdf.groupby("g").cumcount(), n=pdf.groupby("g")["id"].transform("size")).set_index("id").sort_index()
    assert (got["p"] == exp["p"]).all() and (got["n"] == exp["n"]).all()


@pytest.mark.parametrize("order", [["ts", "id"], ["-ts", "-id"], ["-ts", "id"]])
def test_global_position(frames, order):
    sdf, pdf = frames
    got = O.position(sdf, [], order, "p", buckets=9).toPandas().sort_values("p")
    exp = pdf.sort_values(["ts", "id"], ascending=[not o.startswith("-") for o in order])
    assert got["p"].tolist() == list(range(len(pdf)))
    assert got["id"].tolist() == exp["id"].tolist()


def test_position_by_string_order(spark):
    words = ["b", "", "aa", "aab", "zz", "éa", None, "aaaaaaab", "aaaaaaaa"] * 20
    sdf = spark.createDataFrame([(w, i) for i, w in enumerate(words)], "w string, i long")
    got = O.position(sdf, [], ["w", "i"], "p", buckets=8).toPandas().sort_values("p")
    key = [(w is not None, (w or "").encode(), i) for i, w in enumerate(words)]
    assert got["i"].tolist() == [i for *_, i in sorted(key)]


@pytest.mark.parametrize("buckets", [1, 16])
def test_running_sum_previous_and_last_known(frames, buckets):
    sdf, pdf = frames
    got = O.running_sums(sdf.fillna(0, ["v"]), ["g"], ["ts", "id"], {"s": "v"}, buckets=buckets)
    got = got.toPandas().set_index("id").sort_index()["s"]
    exp = pdf.assign(s=pdf["v"].fillna(0).groupby(pdf["g"]).cumsum()).set_index("id").sort_index()["s"]
    assert np.allclose(got, exp)
    prev = O.previous(sdf, ["g"], ["ts", "id"], "id", "q", buckets=buckets).toPandas().set_index("id").sort_index()["q"]
    exp = pdf.assign(q=pdf.groupby("g")["id"].shift()).set_index("id").sort_index()["q"]
    assert prev.fillna(-1).tolist() == exp.fillna(-1).tolist()
    filled = O.last_known(sdf, ["g"], ["ts", "id"], "v", "q", buckets=buckets).toPandas().set_index("id").sort_index()["q"]
    exp = pdf.assign(q=pdf.groupby("g")["v"].ffill()).set_index("id").sort_index()["q"]
    assert np.allclose(filled.astype(float), exp, equal_nan=True)


@pytest.mark.parametrize("buckets", [1, 12])
def test_quantiles(frames, buckets):
    sdf, pdf = frames
    got = O.quantiles(sdf, ["g"], "v", {"a": 0.25, "b": 0.95}, buckets=buckets).toPandas()
    got["g"] = got["g"].fillna("~null~")
    got = got.set_index("g").sort_index()
    exp = pdf.groupby("g")["v"].quantile([0.25, 0.95]).unstack().sort_index()
    assert np.allclose(got[["a", "b"]], exp)
    wide = O.wide_quantiles(sdf, [], {"v": sdf["v"], "t": sdf["ts"]}, {"m": 0.5}, buckets=buckets).first()
    assert np.isclose(wide["v_m"], pdf["v"].median()) and np.isclose(wide["t_m"], pdf["ts"].median())


def test_heavy_value_is_split_by_the_next_order_column(frames):
    sdf, _ = frames
    b = O.with_bucket(sdf, ["ts", "id"], 16)
    sizes = b.groupBy(O.BUCKET).count().toPandas()["count"]
    assert sizes.max() < 0.15 * sizes.sum()


def test_top_k_limits_before_the_shuffle(frames):
    sdf, pdf = frames
    top = O.top_k(sdf, ["g"], ["-ts", "id"], 3)
    assert "WindowGroupLimit" in top._jdf.queryExecution().executedPlan().toString()
    exp = pdf.sort_values(["ts", "id"], ascending=[False, True]).groupby("g").head(3)
    assert sorted(r["id"] for r in top.collect()) == sorted(exp["id"].tolist())
