"""Model operators against brute force."""

import math
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from vigilframe.operators import baselines as B
from vigilframe.operators import cluster as C
from vigilframe.operators import graph as GR
from vigilframe.operators import scoring as G


def vectors(spark, x, label=None):
    label = np.zeros(len(x), int) if label is None else label
    rows = [(i, [float(v) for v in r], int(c)) for i, (r, c) in enumerate(zip(x, label))]
    return spark.createDataFrame(rows, "id long, vec array<double>, label int")


def test_precision_matrix_matches_the_shrinkage_formula(spark):
    x = np.random.default_rng(0).normal(size=(60, 4)) @ np.diag([1, 2, 3, 4])
    mean = x.mean(axis=0)
    got = G.precision_matrix(vectors(spark, x).repartition(5), "vec", mean)
    c = x - mean
    n, d = c.shape
    emp = c.T @ c / n
    mu = np.trace(emp) / d
    delta = np.square(emp - mu * np.eye(d)).sum() / d
    beta = sum(np.square(np.outer(r, r) - emp).sum() for r in c) / (n * n * d)
    s = min(beta, delta) / delta
    assert np.allclose(got, np.linalg.inv((1 - s) * emp + s * mu * np.eye(d)))


def test_small_sample_uses_a_ridge(spark):
    x = np.random.default_rng(1).normal(size=(5, 4))
    got = G.precision_matrix(vectors(spark, x), "vec", x.mean(axis=0))
    assert np.allclose(got, np.linalg.pinv(np.cov(x.T) + 1e-3 * np.eye(4)))


def test_mahalanobis_scores(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(80, 3)), rng.integers(0, 2, 80)
    df = vectors(spark, x, y)
    m = G.fit_prototypes(df, "vec", F.array("label"), [0, 1])
    got = np.array([r["proto"] for r in G.distance_scores(df, ["id"], "vec", m).orderBy("id").collect()])
    mu = np.stack([x[y == c].mean(axis=0) for c in (0, 1)])
    diff = x[:, None, :] - mu[None]
    assert np.allclose(m.prototypes, mu)
    assert np.allclose(got, np.sqrt(np.einsum("ncd,df,ncf->nc", diff, m.precision, diff).min(axis=1)))


def test_blocked_knn_with_a_third_of_copies(spark):
    rng = np.random.default_rng(3)
    bank = rng.normal(size=(90, 5))
    bank[:30] = bank[0]
    x = rng.normal(size=(40, 5))
    q = vectors(spark, x).select("id", F.col("vec").alias("__x"))
    got = G.blocked_knn(q, ["id"], "`id` bigint", vectors(spark, bank), "vec", 7, rows_per_block=16).orderBy("id").collect()
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    sim = np.sort(unit(x) @ unit(bank).T, axis=1)[:, -7:]
    assert len(got) == 40 and np.allclose([r["knn"] for r in got], -sim.mean(axis=1))
    small = G.knn_scores(vectors(spark, x), ["id"], "vec", vectors(spark, bank), "vec", 7).orderBy("id").collect()
    assert np.allclose([r["knn"] for r in small], -sim.mean(axis=1))


def test_knn_of_a_large_bank_is_bounded(spark, monkeypatch):
    rng = np.random.default_rng(5)
    bank, x = rng.normal(size=(300, 4)), rng.normal(size=(50, 4))
    widest = []
    keep = np.partition
    monkeypatch.setattr(G, "BLOCK_ROWS", 32)
    monkeypatch.setattr(G.np, "partition", lambda a, *r, **o: widest.append(a.shape[1]) or keep(a, *r, **o))
    unit = lambda a: a / np.linalg.norm(a, axis=1, keepdims=True)
    exp = -np.sort(unit(x) @ unit(bank).T, axis=1)[:, -5:].mean(axis=1)
    assert np.allclose(G._nearest(x, unit(bank), 5), exp) and max(widest) <= 37
    monkeypatch.undo()
    q = vectors(spark, x).select("id", F.lit(None).cast("string").alias("g"), F.col("vec").alias("__x"))
    monkeypatch.setattr(G, "BANK_PART_BYTES", 2000)
    df = G.blocked_knn(q, ["id", "g"], "`id` bigint, `g` string", vectors(spark, bank), "vec", 5, rows_per_block=16)
    assert np.allclose([r["knn"] for r in df.orderBy("id").collect()], exp)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan


def test_knn_holds_one_batch_and_a_strip_of_cosines():
    rng = np.random.default_rng(5)
    unit = G._unit(rng.normal(size=(2048, 8)))
    held = []

    def batches():
        for chunk in np.repeat(np.arange(3), 4):
            x = unit[chunk * 10:chunk * 10 + 10]
            rows = pa.array([[{"__row": int(chunk * 10 + i)} for i in range(10)]])
            filler = pa.array([bytes(1 << 22)])  # stands for a full batch
            held.append(pa.total_allocated_bytes())
            yield pa.RecordBatch.from_arrays([pa.array([chunk]), rows, pa.array([x.tobytes()]), pa.array([unit.tobytes()]), filler],
                                             ["chunk", "rows", "x", "block", "filler"])
            del rows, filler

    got = [r for b in G._pass_blocks(batches(), 4) for r in b.to_pylist()]
    assert max(held) - held[0] < 1 << 20
    near = np.sort(unit[:30] @ unit.T, axis=1)
    for r in got:  # each block came four times
        assert np.allclose(r["sims"], near[r["__row"], -1])
    assert len(got) == 30

    tracemalloc.start()
    G._merge_best(G._merge_best(None, unit, unit, 5), unit, unit[::-1], 5)
    assert tracemalloc.get_traced_memory()[1] < 24 << 20
    tracemalloc.stop()


@pytest.mark.parametrize("seed", range(8))
def test_nearest_of_a_bank_whose_cosines_differ_beyond_single_precision(seed):
    """Later blocks improve the best by less than single precision shows."""
    rng = np.random.default_rng(seed)
    centre = G._unit(rng.normal(size=(1, 64)))
    away = rng.normal(size=(40, 64))
    away -= (away @ centre.T) * centre
    # cosines to the centre grow by some 1e-10 from row to row, block after block
    bank = G._unit(centre + (1e-2 - 1e-8 * np.arange(40))[:, None] * G._unit(away))
    best = G._merge_best(None, centre, bank[:5], 5)
    for lo in range(5, 40):
        best = G._merge_best(best, centre, bank[lo:lo + 1], 5)
    assert np.allclose(np.sort(best[0]), np.sort((centre @ bank.T)[0])[-5:], rtol=0, atol=1e-15)


def test_model_tables_score_their_windows_once(spark, monkeypatch, tmp_path):
    from vigilframe.catalog import QUERIES, load

    load()
    passes = spark.sparkContext.accumulator(0)
    scores = G._nearest

    def counted(x, bank, k):
        passes.add(len(x))
        return scores(x, bank, k)

    monkeypatch.setattr(G, "_nearest", counted)
    x = np.random.default_rng(12).normal(size=(90, 64))
    rows = [(i, [float(v) for v in r], i % 10) for i, r in enumerate(x)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert QUERIES["s11_model_tables"](spark, str(tmp_path)).count() == 90
    assert passes.value == 90


def brute_dbscan(x, eps, m):
    near = np.linalg.norm(x[:, None] - x[None], axis=2) <= eps
    core = near.sum(axis=1) >= m
    comp = np.where(core, np.arange(len(x)), -1)
    for _ in range(len(x)):
        for i in np.flatnonzero(core):
            comp[i] = comp[near[i] & core].min()
    for i in np.flatnonzero(~core & (near & core[None]).any(axis=1)):
        comp[i] = comp[np.flatnonzero(near[i] & core)[0]]
    names = {c: k for k, c in enumerate(sorted(set(comp) - {-1}))}
    return [names.get(c, -1) for c in comp]


@pytest.mark.parametrize("chunk", [8, 1024])
def test_dbscan_brute_force(spark, monkeypatch, chunk):
    """A third of the points are copies of one point; chunks are split and results stay whole."""
    monkeypatch.setattr(C, "CHUNK_ROWS", chunk)
    rng = np.random.default_rng(4)
    x = np.concatenate([np.full((40, 2), 3.0), rng.normal(size=(50, 2)), rng.uniform(-9, 9, size=(30, 2))])
    got = C.dbscan(vectors(spark, x).select("id", "vec"), 0.6, 4).orderBy("id").collect()
    assert [r["cluster"] for r in got] == brute_dbscan(x, 0.6, 4)


def test_dbscan_counts_do_not_go_by_the_order_in_a_chunk(spark):
    # a chunk meets itself as two reads of a shuffle, which need not agree in their order
    points = [(i, [10.0 * i], False) for i in range(6)]
    struct = "array<struct<id: bigint, vec: array<double>, core: boolean>>"
    pairs = spark.createDataFrame([(points, points[::-1], True)], f"a {struct}, b {struct}, same boolean")
    assert {r["id"]: r["n"] for r in C._neighbour_counts(pairs, 1.0).collect()} == {i: 1 for i in range(6)}


def test_dbscan_pairs_of_vectors_of_one_length_are_dealt_over_tasks(spark, monkeypatch):
    """Unit vectors lie in one band around the origin; their pairs of chunks must not meet in one task."""
    monkeypatch.setattr(C, "CHUNK_ROWS", 20)
    shares, counts = [], C._neighbour_counts

    def spy(pairs, eps):
        n = [r["count"] for r in pairs.groupBy(F.spark_partition_id()).count().collect()]
        shares.append(max(n) / sum(n))
        return counts(pairs, eps)

    monkeypatch.setattr(C, "_neighbour_counts", spy)
    x = np.random.default_rng(6).normal(size=(400, 16))
    x = np.concatenate([x, np.repeat(x[:1], 60, axis=0), x[100:160] + 0.01])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = C.dbscan(vectors(spark, x).select("id", "vec"), 0.8, 3).orderBy("id").collect()
    assert [r["cluster"] for r in got] == brute_dbscan(x, 0.8, 3)
    assert shares and max(shares) < 0.5


@pytest.mark.parametrize("scale,shift", [(1.0, 0.0), (1.0, 1e6), (1e-3, 0.0), (1e12, 0.0), (1e18, 0.0)])
def test_near_pairs_at_eps_itself(scale, shift):
    """A lattice has many pairs at eps to the last bit."""
    x = np.stack(np.meshgrid(*[np.arange(6.0)] * 3), axis=-1).reshape(-1, 3) * scale + shift
    x = np.concatenate([x, [[np.nan, 0, 0], [np.inf, 0, 0]]])
    with np.errstate(all="ignore"):
        exact = np.sqrt(np.square(x[:, None] - x[None]).sum(axis=2)) <= scale
    got = np.zeros_like(exact)
    for i, j in C._near(x, x, scale):
        got[i, j] = True
    assert (got == exact).all()


def test_dbscan_of_missing_and_infinite_vectors(spark):
    rows = [(0, [0.0]), (1, [0.1]), (2, None), (3, [math.nan]), (4, [math.inf]), (5, [math.inf]), (6, [9.0])]
    got = C.dbscan(spark.createDataFrame(rows, "id long, vec array<double>"), 0.5, 2).collect()
    assert {r["id"]: r["cluster"] for r in got} == {0: 0, 1: 0, 2: -1, 3: -1, 4: -1, 5: -1, 6: -1}


def test_dbscan_of_vectors_far_from_the_origin(spark):
    x = np.array([[1e9, 0.0], [1e9, 0.5], [1e9, 1.0], [1e9, 3.0]])
    got = C.dbscan(vectors(spark, x).select("id", "vec"), 0.6, 2).orderBy("id").collect()
    assert [r["cluster"] for r in got] == [0, 0, 0, -1]


def test_components_of_a_long_chain(spark):
    nodes = spark.range(200).select("id")
    edges = spark.range(199).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst")).where("src <> 120")
    got = C.connected_components(nodes, edges).groupBy("component").count().collect()
    assert sorted((r["component"], r["count"]) for r in got) == [(0, 121), (121, 79)]


def test_isolation_forest_finds_planted_outliers(spark):
    rng = np.random.default_rng(5)
    x = np.concatenate([rng.normal(size=(400, 3)), rng.normal(size=(8, 3)) + 9])
    df = vectors(spark, x)
    forest = B.isolation_forest(df, "id", "vec", trees=60)
    s = np.array([r["isolation_score"] for r in B.isolation_scores(df, ["id"], "vec", forest).orderBy("id").collect()])
    assert len(forest) == 60 and s[400:].min() > np.quantile(s[:400], 0.97) and ((s > 0) & (s <= 1)).all()


@pytest.mark.parametrize("name", B.BASELINES)
def test_baselines_separate_classes_and_keep_constant_labels(spark, name):
    rng = np.random.default_rng(6)
    x = np.concatenate([rng.normal(size=(60, 3)) - 2, rng.normal(size=(60, 3)) + 2])
    y = [[int(i >= 60), 1] for i in range(120)]
    df = spark.createDataFrame([(i, [float(v) for v in r], t) for i, (r, t) in enumerate(zip(x, y))], "id int, vec array<double>, y array<int>")
    p = B.MultiLabelModel(name, settings=B.LIGHT[name]).fit(df, "vec", "y", 2).predict(df, "vec").orderBy("id").collect()
    first = np.array([r["probs"][0] for r in p])
    assert ((first > 0.5) == (np.arange(120) >= 60)).mean() > 0.97
    assert {r["probs"][1] for r in p} == {1.0}


def test_kmeans_size_rule(spark):
    x = np.concatenate([np.random.default_rng(7).normal(size=(10, 2)) + c for c in (0, 50, 100)])
    got = C.kmeans_clusters(vectors(spark, x).select("id", "vec"), 3).toPandas().sort_values("id")["cluster"].to_numpy()
    assert len(set(got)) == 3 and all(len(set(got[i:i + 10])) == 1 for i in (0, 10, 20))


def test_affinity_is_taken_to_nine_places():
    x = np.array([[[1.0, 2.0], [3.0, 4.0], [0.0, 0.0]]])
    for kind, s in (("cosine", round(11 / math.sqrt(125), 9)), ("rbf", -8.0)):
        sim, w = GR.window_affinity(x, kind, 1.0)
        assert sim[0, 0, 1] == s and w[0, 0, 1] == np.exp(s)
    assert GR.window_affinity(x, "cosine", 1.0)[0][0, 0, 2] == 0


def test_cosine_graph_of_records_of_zeros_equals_its_sql(spark, tmp_path):
    import duckdb

    from vigilframe.catalog import QUERIES, SQL, load

    load()
    records = [(7 * j % 5, 3 * j % 4) for j in range(40)] + [(0, 0)] * 8  # pairs of zeros alone, together and in a whole window
    rows = [(i, i, i % 3 // 2, "view", float(v), f'{{"k": {k}}}') for i, (v, k) in enumerate(records)]
    path = str(tmp_path / "events.parquet")
    fields = "event_id long, ts long, user_id long, event_type string, value double, props string"
    events = spark.createDataFrame(rows, fields).withColumn("ts", F.timestamp_micros("ts").cast("timestamp_ntz"))
    events.coalesce(1).write.parquet(path)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{path}/*.parquet'")
    for name in (n for n in SQL if n.startswith("j15_graph")):
        got, exp = (sorted(map(repr, r)) for r in (
            map(tuple, QUERIES[name](spark, str(tmp_path)).select("grp", "window_idx", "src", "dst", "weight").collect()),
            con.execute(f"SELECT grp, window_idx, src, dst, CAST(weight AS DOUBLE) FROM ({SQL[name]})").fetchall(),
        ))
        assert got == exp, name
        assert name != "j15_graph_cosine_sym_weighted" or any("nan" in r for r in exp)


def test_random_graph_differs_from_nearest(spark):
    rng = np.random.default_rng(8)
    packed = spark.createDataFrame([(0, rng.normal(size=(12, 3)).tolist())], "w long, features array<array<double>>")
    near = {tuple(r)[1:3] for r in GR.behaviour_graph(packed, ["w"], 2, variant="binary").collect()}
    rand = {tuple(r)[1:3] for r in GR.behaviour_graph(packed, ["w"], 2, variant="binary", random_seed=1).collect()}
    assert near != rand
    ident = GR.behaviour_graph(packed, ["w"], variant="identity").collect()
    assert {(r["src"], r["dst"], r["weight"]) for r in ident} == {(i, i, 1.0) for i in range(12)}


def test_phase_names(spark):
    cols = ["log_packets_s", "log_bytes_s", "log_iat_mean", "log_total_packets", "log_duration", "direction_balance"]
    rows = [(0, 1.0, 1.0, 9.0, 1.0, 1.0, 0.2), (1, 9.0, 9.0, 1.0, 9.0, 1.0, 0.2), (2, 5.0, 5.0, 5.0, 5.0, 9.0, 0.9), (3, 5.0, 5.0, 5.0, 5.0, 1.0, 0.1)]
    out = C.name_phases(spark.createDataFrame(rows, ["cluster", *cols]), "cluster").collect()
    assert {r["cluster"]: r["phase"] for r in out} == {
        0: "hovering_proxy", 1: "high_rate_sensing_proxy", 2: "cruising_proxy", 3: "maneuvering_proxy"}


def test_fit_subset_priority(spark):
    df = spark.range(200).select(F.when(F.col("id") < 100, "train").otherwise("test").alias("split"), F.when(F.col("id") < 50, "benign").otherwise("dos").alias("label"))
    assert C.choose_fit_subset(df, 4, "split", "label", None)[0] == "train_all"


def test_model_tables_round_trip(spark):
    from vigilframe.config import shared_dir
    from vigilframe.operators.calibrate import fit_calibration
    from vigilframe.sources import model_store as MS

    rng = np.random.default_rng(9)
    df = vectors(spark, rng.normal(size=(50, 3)), rng.integers(0, 2, 50))
    model = G.fit_prototypes(df, "vec", F.array("label"), [0, 1])
    root = shared_dir(spark, "store")
    MS.save_prototypes(spark, model, f"{root}/p")
    back = MS.load_prototypes(spark, f"{root}/p")
    assert back.classes == [0, 1] and np.allclose(back.prototypes, model.prototypes) and np.allclose(back.precision, model.precision)
    cal = fit_calibration(df.select(*[F.col("vec")[i].alias(n) for i, n in enumerate("abc")]), "mean", 0.9, names=["a", "b", "c"])
    MS.save_calibration(spark, cal, f"{root}/c")
    assert MS.load_calibration(spark, f"{root}/c") == cal
    assert MS.load_calibration(spark, f"{root}/c", {"threshold": 7.0}).threshold == 7.0


def test_best_of_several_kmeans_starts_beats_each_single_one(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (25, 2)) for c in ((0, 0), (0, 6), (7, 0), (7, 7), (20, 3), (20, 9))])
    points = vectors(spark, x).select("id", "vec")
    centres, cost = C.kmeans_centres(points, 6, 5, 1, 50)
    plain = ((x[:, None] - centres) ** 2).sum(axis=2)
    assert np.isclose(cost, plain.min(axis=1).sum())
    assert cost <= C.kmeans_centres(points, 6, 1, 1, 50)[1] + 1e-9
    means = np.array([x[plain.argmin(axis=1) == j].mean(axis=0) for j in range(6)])
    assert np.allclose(means, centres, atol=1e-3)
    got = C.nearest_centre(points, "vec", centres).toPandas().sort_values("id")["cluster"].to_numpy()
    assert (got == plain.argmin(axis=1)).all()


def test_kmeans_round_takes_all_starts_at_once(spark, monkeypatch):
    """Sums and costs equal plain ones whatever the rows of a matrix."""
    rng = np.random.default_rng(3)
    x, centres = rng.normal(size=(203, 5)), rng.normal(size=(4, 3, 5))
    points = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    monkeypatch.setattr(C, "ROUND_ROWS", 16)
    n, sums, cost = C._round(points, centres)
    for s in range(4):
        d = ((x[:, None, :] - centres[s]) ** 2).sum(axis=2)
        at = d.argmin(axis=1)
        assert n[s].tolist() == np.bincount(at, minlength=3).tolist() and np.isclose(cost[s], d.min(axis=1).sum())
        assert np.allclose(sums[s], [x[at == c].sum(axis=0) for c in range(3)])


def test_kmeans_of_few_and_equal_points(spark):
    same = vectors(spark, np.ones((9, 2))).select("id", "vec")
    assert C.kmeans_clusters(same, 3).count() == 9
    assert C.kmeans_clusters(same.limit(2), 5).count() == 2
    assert C.kmeans_clusters(same.where("id < 0")).count() == 0
