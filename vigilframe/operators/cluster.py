"""Clustering of out-of-distribution windows and the summary of the clusters."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.config import materialize
from vigilframe.functions.scores import hypothesis
from vigilframe.operators.ordering import order_hash, top_k

# Points of a DBSCAN chunk, points that order the chunks, and bytes of chunks that one task passes its own chunks over.
CHUNK_ROWS = 5000
PIVOTS = 256
PART_BYTES = 64 * 1024 * 1024
# Rows of a chunk whose distances to another chunk are one matrix, and pairs whose differences are taken at once.
STRIP_ROWS = 64
SETTLED_PAIRS = 65_536
# What a chunk holds of each point.
CELLS = {"id": np.int64, "vec": np.float64, "core": np.bool_, "comp": np.int64}
# Points of a K-means round whose distances to the centres of all starts are one matrix.
ROUND_ROWS = 1024


def ood_vectors(df: DataFrame, ident: str, embedding: str, scores: Sequence[str], flag: str = "is_ood") -> DataFrame:
    """(id, vec) of flagged windows: embedding followed by the scores, missing scores 0."""
    tail = F.array(*[F.coalesce(F.col(s).cast("double"), F.lit(0.0)) for s in scores])
    return df.where(F.col(flag)).select(
        F.col(ident).alias("id"), F.concat(F.col(embedding).cast("array<double>"), tail).alias("vec")
    )


def _spread(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k rows of a small matrix, each drawn by its squared distance to those before."""
    chosen = [int(rng.integers(len(x)))]
    near = ((x - x[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < k:
        total = near.sum()
        chosen.append(int(rng.choice(len(x), p=near / total)) if total > 0 else int(rng.integers(len(x))))
        near = np.minimum(near, ((x - x[chosen[-1]]) ** 2).sum(axis=1))
    return x[chosen]


def _round(points: DataFrame, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows, sums and cost by start and cluster, of all starts in one job.

    A task returns one row per start, cluster and dimension, whatever its number of points.
    """
    starts, k, d = centres.shape
    flat = centres.reshape(-1, d)
    lengths = (flat**2).sum(axis=1)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((starts, k, d + 2))
        for batch in batches:
            rows = batch.column("vec").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
            if len(rows) != len(batch):
                raise ValueError(f"every point needs {d} dimensions")
            for lo in range(0, len(rows), ROUND_ROWS):
                x = rows[lo:lo + ROUND_ROWS].astype(np.float64)
                # all starts at once: distances but for the rows' own lengths, which decide no minimum
                far = (lengths - 2 * x @ flat.T).reshape(len(x), starts, k)
                at = far.argmin(axis=2)
                least = np.take_along_axis(far, at[:, :, None], axis=2)[:, :, 0] + (x**2).sum(axis=1)[:, None]
                member = (at[:, :, None] == np.arange(k)).astype(np.float64)
                sums[:, :, : d + 1] += (member.reshape(len(x), -1).T @ np.column_stack([x, np.ones(len(x))])).reshape(starts, k, d + 1)
                sums[:, 0, d + 1] += np.maximum(least, 0.0).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(sums.size)), pa.array(sums.ravel())], ["i", "v"])

    got = points.select("vec").mapInArrow(add, "i long, v double").groupBy("i").agg(F.sum("v").alias("v")).toPandas()
    sums = np.zeros(starts * k * (d + 2))
    sums[got["i"].to_numpy()] = got["v"].to_numpy()
    sums = sums.reshape(starts, k, d + 2)
    return sums[:, :, d], sums[:, :, :d], sums[:, :, d + 1].sum(axis=1)


def kmeans_centres(points: DataFrame, k: int, starts: int, seed: int, max_iter: int, tol: float = 1e-4) -> tuple[np.ndarray, float]:
    """Centres and cost of the best of several K-means starts over (id, vec).

    All starts move side by side: a round is one job whose result is bounded by starts x clusters x dimensions. The first
    centres of a start are drawn by distance from 8 k points of its own that a seeded hash of the id picks (from all
    points where there are too few); the rounds read all points. A cluster without points keeps its centre. Rounds end when no centre of any start moves by more than ``tol``.
    """
    size = starts * 8 * k
    picked = points.select(order_hash(seed, "id").alias("h"), "id", "vec").orderBy("h", "id").limit(size).toPandas()
    x = np.stack(picked["vec"].to_numpy()).astype(np.float64)
    draws = [x[s::starts] if len(x) == size else x for s in range(starts)]
    centres = np.stack([_spread(own, k, np.random.default_rng([seed, s])) for s, own in enumerate(draws)])
    for _ in range(max_iter):
        n, sums, cost = _round(points, centres)
        new = np.where(n[:, :, None] > 0, sums / np.maximum(n, 1)[:, :, None], centres)
        moved = np.sqrt(((new - centres) ** 2).sum(axis=2)).max()
        centres = new
        if moved <= tol:
            break
    _, _, cost = _round(points, centres)
    best = int(cost.argmin())
    return centres[best], float(cost[best])


def nearest_centre(df: DataFrame, vector: str, centres: np.ndarray) -> DataFrame:
    """Adds ``cluster``, the number of the nearest centre; ties go to the first."""
    dist = [
        F.aggregate(F.zip_with(vector, F.lit(c.tolist()), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda acc, x: acc + x) for c in centres
    ]
    return df.withColumn("__d", F.array(*dist)).withColumn("cluster", (F.array_position("__d", F.array_min("__d")) - 1).cast("int")).drop("__d")


def kmeans_clusters(points: DataFrame, k: int | None = None, seed: int = 42, starts: int = 10) -> DataFrame:
    """(id, cluster) with k = clamp(floor(sqrt(n)), 1, 8) unless given; the best of ``starts`` fits. An empty table has no rows."""
    points = materialize(points.select("id", F.col("vec").cast("array<double>").alias("vec")), "points")
    n = points.count()
    k = min(k or max(1, min(8, int(math.sqrt(n)))), max(n, 1))
    if k < 2:
        return points.select("id", F.lit(0).alias("cluster"))
    centres, _ = kmeans_centres(points, k, starts, seed, 50)
    return nearest_centre(points, "vec", centres).select("id", "cluster")


# --- DBSCAN ----------------------------------------------------------------------------
def _pivots(points: DataFrame) -> np.ndarray:
    """At most PIVOTS points that a hash of the id picks; only the order of the chunks hangs on them."""
    picked = points.select(order_hash(0, "id").alias("h"), "id", "vec").orderBy("h", "id").limit(PIVOTS).toPandas()
    return np.stack(picked["vec"].to_numpy()).astype(np.float64)


def _spans(rows: int, most: int) -> Iterator[tuple[int, int]]:
    """Bounds of even parts of at most ``most`` rows."""
    cuts = np.linspace(0, rows, -(-rows // most) + 1).astype(int)
    return zip(cuts[:-1].tolist(), cuts[1:].tolist())


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _chunks(points: DataFrame, eps: float, pivots: np.ndarray) -> DataFrame:
    """(chunk, rows, centre, radius): points (id, vec, core) packed as bytes into chunks of at most CHUNK_ROWS, each inside a ball.

    Points lie in the order of their nearest pivot, so that near ones share a chunk. ``comp`` of a core point is the
    smallest id that core points of its own chunk link it with.
    """

    def nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        half = (pivots**2).sum(axis=1) / 2
        for batch in batches:
            x = _matrix(batch.column("vec"))
            cells, far = np.zeros(len(x), np.int32), np.zeros(len(x))
            for lo in range(0, len(x), ROUND_ROWS):
                at = slice(lo, lo + ROUND_ROWS)
                cells[at] = (half - x[at] @ pivots.T).argmin(axis=1)
                far[at] = np.square(x[at] - pivots[cells[at]]).sum(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("id", "vec", "core")), pa.array(cells), pa.array(far)], ["id", "vec", "core", "cell", "far"]
            )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo, hi in _spans(len(batch), CHUNK_ROWS):
                part = batch.slice(lo, hi - lo)
                ids, x = part.column("id").to_numpy(), _matrix(part.column("vec"))
                core = part.column("core").to_numpy(zero_copy_only=False)
                finite = x[np.isfinite(x).all(axis=1)]  # the others are near nothing
                centre = finite.mean(axis=0) if len(finite) else np.zeros(x.shape[1])
                radius = np.sqrt(np.square(finite - centre).sum(axis=1).max(initial=0.0))
                slack = 1e-9 * (1 + radius + np.abs(finite).max(initial=0.0))
                comp = _local_components(ids, x, core, eps)
                held = {"id": ids, "vec": x, "core": core, "comp": comp}
                cells = pa.StructArray.from_arrays([pa.array([np.ascontiguousarray(v).tobytes()], pa.binary()) for v in held.values()], list(held))
                row = [pa.array([number]), cells, pa.array([centre.tolist()], pa.list_(pa.float64())), pa.array([float(radius + slack)])]
                yield pa.RecordBatch.from_arrays(row, ["chunk", "rows", "centre", "radius"])
                number += 1

    placed = points.select("id", "vec", "core").mapInArrow(nearest, "id long, vec array<double>, core boolean, cell int, far double")
    dealt = placed.repartitionByRange("cell", "far", "id").sortWithinPartitions("cell", "far", "id").select("id", "vec", "core")
    row = f"struct<{', '.join(f'{n}: binary' for n in CELLS)}>"
    return materialize(dealt.mapInArrow(pack, f"chunk long, rows {row}, centre array<double>, radius double"), "chunks")


def _chunk_pairs(chunks: DataFrame, eps: float) -> DataFrame:
    """Every unordered pair of chunks whose balls come within eps, once, in a Cartesian product without a shuffle of pairs.

    A hash of the pair says which of the two stands on the left, so each does about as often.
    """
    size = chunks.agg(F.sum(F.octet_length("rows.vec")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    tasks = min(max(size["n"], 1), 2 * chunks.sparkSession.sparkContext.defaultParallelism)
    side = lambda c, rows: chunks.select(*[F.col(o).alias(f"{o}_{c}") for o in ("chunk", "centre", "radius")], F.col("rows").alias(rows))
    left, right = side("a", "a").repartition(tasks), side("b", "b").coalesce(-(-(size["b"] or 0) // PART_BYTES) or 1)
    a, b = F.col("chunk_a"), F.col("chunk_b")
    gap = F.sqrt(F.aggregate(F.zip_with("centre_a", "centre_b", lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda acc, x: acc + x))
    turn = (a == b) | ((a < b) == (F.pmod(F.xxhash64(F.least(a, b), F.greatest(a, b)), F.lit(2)) == 0))
    met = left.join(right.hint("shuffle_replicate_nl"), turn & (gap <= F.col("radius_a") + F.col("radius_b") + float(eps)))
    return met.select("a", "b", (a == b).alias("same"))


def _near(a: np.ndarray, b: np.ndarray, eps: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (i, j) of rows at a distance of at most eps, strip by strip of ``a``.

    Products in single precision decide where their error cannot; the rest is settled by the squared differences, added
    up in the order of the dimensions.
    """
    finite = a[np.isfinite(a).all(axis=1)]
    centre = finite.mean(axis=0) if len(finite) else np.zeros(a.shape[1])
    u, v = a - centre, b - centre
    with np.errstate(all="ignore"):
        nu, nv = np.square(u).sum(axis=1), np.square(v).sum(axis=1)
        reach = np.sqrt(nu[np.isfinite(nu)].max(initial=0.0)) + np.sqrt(nv[np.isfinite(nv)].max(initial=0.0))
        # beyond this single precision has no room for the squares
        kind = np.float32 if reach < 1e15 else np.float64
        far = max(np.abs(a[np.isfinite(a)]).max(initial=0.0), np.abs(b[np.isfinite(b)]).max(initial=0.0))
        d = a.shape[1]
        slack = (d + 4) * float(np.finfo(kind).eps) * (reach**2 + eps**2) + 4 * (eps + 1e-15 * far) * math.sqrt(d) * 2.0**-52 * far
        # the product is minus half of the squared distance
        left = np.column_stack([u, -nu / 2, np.ones(len(u))]).astype(kind)
        right = np.ascontiguousarray(np.column_stack([v, np.ones(len(v)), -nv / 2]).astype(kind).T)
        for lo in range(0, len(left), STRIP_ROWS):
            product = left[lo:lo + STRIP_ROWS] @ right
            at = np.flatnonzero(product >= -eps * eps / 2 - slack)
            if not len(at):
                continue
            open_ = product.ravel()[at] < -eps * eps / 2 + slack
            i, j = np.divmod(at, len(b))
            i += lo
            if open_.any():
                keep = ~open_
                for s in range(0, len(at), SETTLED_PAIRS):
                    some = s + np.flatnonzero(open_[s:s + SETTLED_PAIRS])
                    total = np.zeros(len(some))
                    for c in range(d):
                        total += np.square(a[i[some], c] - b[j[some], c])
                    keep[some] = np.sqrt(total) <= eps
                i, j = i[keep], j[keep]
            yield i, j


def _local_components(ids: np.ndarray, x: np.ndarray, core: np.ndarray, eps: float) -> np.ndarray:
    """Of each core point the smallest id that it is linked with through core points; -1 for the others."""
    comp = np.full(len(ids), -1, np.int64)
    todo = np.flatnonzero(core)
    todo = todo[np.argsort(ids[todo], kind="stable")]
    while len(todo):
        reached, todo = todo[:1], todo[1:]
        name = ids[reached[0]]
        comp[reached] = name
        while len(reached) and len(todo):
            hit = np.zeros(len(todo), bool)
            for _, j in _near(x[reached], x[todo], eps):
                hit[j] = True
            reached, todo = todo[hit], todo[~hit]
            comp[reached] = name
    return comp


def _cells(cell: pa.StructScalar | pa.ListScalar) -> dict[str, np.ndarray]:
    """Columns of a chunk's rows, which are packed as bytes or listed one by one."""
    if pa.types.is_struct(cell.type):
        found = {n: np.frombuffer(cell[n].as_buffer(), kind) for n, kind in CELLS.items()}
        return {**found, "vec": found["vec"].reshape(len(found["id"]), -1)}
    found = dict(zip((f.name for f in cell.values.type), cell.values.flatten()))
    return {n: _matrix(v) if n == "vec" else v.to_numpy(zero_copy_only=False) for n, v in found.items()}


def _members(chunks: DataFrame) -> DataFrame:
    """(id, comp) of the core points."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell in batch.column("rows"):
                rows = _cells(cell)
                yield pa.RecordBatch.from_arrays([pa.array(rows[n][rows["core"]]) for n in ("id", "comp")], ["id", "comp"])

    return chunks.select("rows").mapInArrow(run, "id long, comp long")


def _neighbour_counts(pairs: DataFrame, eps: float) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for cell_a, cell_b, same in zip(*(batch.column(c) for c in ("a", "b", "same"))):
                a, b = _cells(cell_a), _cells(cell_b)
                rows, cols = np.zeros(len(a["id"]), np.int64), np.zeros(len(b["id"]), np.int64)
                for i, j in _near(a["vec"], b["vec"], eps):
                    rows += np.bincount(i, minlength=len(rows))
                    cols += np.bincount(j, minlength=len(cols))
                if same.as_py():
                    # both sides hold the same rows, but not in the same order: nothing may go by places
                    ids, n = a["id"], rows
                else:
                    ids, n = np.concatenate([a["id"], b["id"]]), np.concatenate([rows, cols])
                yield pa.RecordBatch.from_arrays([pa.array(ids[n > 0]), pa.array(n[n > 0])], ["id", "n"])

    return pairs.select("a", "b", "same").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def _links(pairs: DataFrame, eps: float) -> DataFrame:
    """Links between the components of core points in chunks, and the smallest core neighbour of border points.

    A task emits a spanning forest of the components that it meets, not all of their links.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(i: int) -> int:
            while parent.setdefault(i, i) != i:
                parent[i] = i = parent.setdefault(parent[i], parent[i])
            return i

        none = np.iinfo(np.int64).max
        for batch in batches:
            for cell_a, cell_b, same in zip(*(batch.column(c) for c in ("a", "b", "same"))):
                a, b, same = _cells(cell_a), _cells(cell_b), same.as_py()
                (names_a, at_a), (names_b, at_b) = (np.unique(c["comp"], return_inverse=True) for c in (a, b))
                linked = np.zeros((len(names_a), len(names_b)), bool)
                best_a, best_b = np.full(len(a["id"]), none), np.full(len(b["id"]), none)
                for i, j in _near(a["vec"], b["vec"], eps):
                    core_i, core_j = a["core"][i], b["core"][j]
                    both = core_i & core_j
                    linked[at_a[i[both]], at_b[j[both]]] = True
                    border = ~core_i & core_j
                    np.minimum.at(best_a, i[border], b["id"][j[border]])
                    if not same:
                        border = core_i & ~core_j
                        np.minimum.at(best_b, j[border], a["id"][i[border]])
                src, dst = [], []
                for i, j in zip(*np.nonzero(linked)):
                    u, v = int(names_a[i]), int(names_b[j])
                    x, y = find(u), find(v)
                    if x != y:
                        parent[max(x, y)] = min(x, y)
                        src.append(u), dst.append(v)
                ids, best = np.concatenate([a["id"], b["id"]]), np.concatenate([best_a, best_b])
                met = best < none
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.concatenate([np.asarray(src, np.int64), ids[met]])),
                        pa.array(np.concatenate([np.asarray(dst, np.int64), best[met]])),
                        pa.array(["core"] * len(src) + ["border"] * int(met.sum()), pa.string()),
                    ],
                    ["src", "dst", "kind"],
                )

    return pairs.select("a", "b", "same").mapInArrow(run, "src long, dst long, kind string").distinct()


def connected_components(nodes: DataFrame, edges: DataFrame, max_rounds: int = 100) -> DataFrame:
    """(id, component) with the smallest id of each component.

    Rounds of min-label exchange followed by pointer jumping; each round is written to the
    shared folder, so a lost executor never replays the whole loop.
    """
    both = materialize(
        edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct(),
        "edges",
    )
    labels = materialize(nodes.select("id", F.col("id").alias("component")), "labels")
    for _ in range(max_rounds):
        heard = both.join(labels, both["dst"] == labels["id"]).groupBy("src").agg(F.min("component").alias("m"))
        lower = labels.join(heard, labels["id"] == heard["src"], "left").select(
            "id", "component", F.least("component", F.coalesce("m", "component")).alias("next")
        )
        jump = labels.select(F.col("id").alias("__i"), F.col("component").alias("__c"))
        moved = lower.join(jump, lower["next"] == jump["__i"], "left").select(
            "id", F.col("component").alias("old"), F.least("next", F.coalesce("__c", "next")).alias("component")
        )
        moved = materialize(moved, "labels")
        changed = moved.where("old <> component").limit(1).count()
        labels = moved.select("id", "component")
        if not changed:
            return labels
    raise RuntimeError("connected components did not converge")


def dbscan(points: DataFrame, eps: float = 1.2, min_samples: int = 3) -> DataFrame:
    """(id, cluster) with -1 for noise; clusters are numbered by their smallest core id.

    A border point joins the cluster of its smallest core neighbour.
    """
    if points.where("vec is not null").limit(1).count() == 0:
        return points.select("id", F.lit(-1).cast("long").alias("cluster"))
    points = points.select("id", F.col("vec").cast("array<double>").alias("vec"))
    known = points.where("vec is not null")
    pivots = _pivots(known)
    counts = _neighbour_counts(_chunk_pairs(_chunks(known.withColumn("core", F.lit(False)), eps, pivots), eps), eps)
    # a point that is near itself alone takes no part in any link
    cored = materialize(known.join(counts, "id").withColumn("core", F.col("n") >= min_samples).where("core or n > 1").drop("n"), "core")
    chunks = _chunks(cored, eps, pivots)
    links = materialize(_links(_chunk_pairs(chunks, eps), eps), "links")
    members = _members(chunks)
    parts = connected_components(members.select(F.col("comp").alias("id")).distinct(), links.where("kind = 'core'"))
    comp = members.join(parts.select(F.col("id").alias("comp"), "component"), "comp").select("id", "component")
    border = links.where("kind = 'border'").groupBy("src").agg(F.min("dst").alias("dst"))
    border = border.join(comp, border["dst"] == comp["id"]).select(F.col("src").alias("id"), "component")
    named = comp.unionByName(border)
    order = named.select("component").distinct()
    from vigilframe.operators.ordering import position

    numbered = position(order, [], ["component"], "cluster")
    out = points.select("id").join(named, "id", "left").join(numbered, "component", "left")
    return out.select("id", F.coalesce("cluster", F.lit(-1).cast("long")).alias("cluster"))


# --- summary -----------------------------------------------------------------------------
def cluster_summary(rows: DataFrame, cluster: str, window: str, labels: str, scores: Sequence[str], top_ids: str) -> DataFrame:
    """Size, mean scores, dominant labels and source, examples and hypothesis per cluster."""
    base = rows.groupBy(cluster).agg(
        F.count(F.lit(1)).alias("num_windows"),
        F.avg("ood_score").alias("avg_ood_score"),
        *[F.avg(F.coalesce(F.col(s), F.lit(0.0))).alias(f"avg_{s}") for s in scores],
    )

    def most_common(df: DataFrame, value: str, k: int, out: str) -> DataFrame:
        counts = df.groupBy(cluster, value).agg(F.count(F.lit(1)).alias("n"))
        kept = top_k(counts, [cluster], ["-n", value], k, "r")
        return kept.groupBy(cluster).agg(
            F.transform(F.array_sort(F.collect_list(F.struct("r", value, "n"))), lambda x: x[value].cast("string")).alias(out)
        )

    names = rows.select(cluster, F.explode(labels).alias("label"))
    sources = rows.select(cluster, F.coalesce("dominant_source", F.lit("unknown")).alias("source"))
    top_recs = rows.select(cluster, F.explode(F.slice(top_ids, 1, 5)).alias("record"))
    first = top_k(rows.select(cluster, window), [cluster], [window], 5, "r").groupBy(cluster).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", window))), lambda x: x[window].cast("string")).alias(
            "representative_windows"
        )
    )
    out = base
    for part in (
        most_common(names, "label", 5, "known_predictions"),
        most_common(sources, "source", 1, "__src"),
        most_common(top_recs, "record", 10, "suspicious_records"),
        first,
    ):
        out = out.join(part, cluster, "left")
    out = out.withColumn("dominant_source", F.coalesce(F.try_element_at("__src", F.lit(1)), F.lit("unknown")))
    return out.withColumn("hypothesis", hypothesis(F.col("dominant_source"))).drop("__src")


# --- traffic phase proxy ---------------------------------------------------------------
def choose_fit_subset(df: DataFrame, k: int, split: str | None, label: str | None, partition: str | None) -> tuple[str, DataFrame]:
    """First subset in priority order with at least max(20 k, 80) rows."""
    true = F.lit(True)
    tr = F.col(split) == "train" if split else None
    options = []
    if split and label:
        options.append(("train_benign", tr & (F.col(label) == "benign")))
    if split and partition:
        options.append(("train_id", tr & (F.col(partition) == "id")))
    if split:
        options.append(("train_all", tr))
    if label:
        options.append(("all_benign", F.col(label) == "benign"))
    options.append(("all_rows", true))
    counts = df.agg(*[F.count_if(c).alias(n) for n, c in options]).first()
    for n, c in options:
        if counts[n] >= max(20 * k, 80):
            return n, df.where(c)
    return options[-1][0], df


def name_phases(centroids: DataFrame, cluster: str) -> DataFrame:
    """Phase name per centroid row by z-scored rate and cruise rules; runs on k rows."""
    cols = ["log_packets_s", "log_bytes_s", "log_iat_mean", "log_total_packets", "log_duration", "direction_balance"]
    stats = centroids.agg(
        *[F.avg(c).alias(f"m_{c}") for c in cols], *[F.stddev_pop(c).alias(f"s_{c}") for c in cols]
    )
    z = lambda c: F.when(F.col(f"s_{c}") > 1e-9, (F.col(c) - F.col(f"m_{c}")) / F.col(f"s_{c}")).otherwise(0.0)
    d = centroids.join(F.broadcast(stats))
    d = d.withColumn("rate", z("log_packets_s") + z("log_bytes_s") - z("log_iat_mean") + 0.25 * z("log_total_packets"))
    d = d.withColumn("cruise", z("log_duration") + z("direction_balance") - 0.25 * F.abs("rate"))
    ends = d.agg(
        F.min_by(cluster, F.struct("rate", cluster)).alias("lo"),
        F.max_by(cluster, F.struct("rate", (-F.col(cluster)).alias("c"))).alias("hi"),
    )
    d = d.join(F.broadcast(ends))
    rest = d.where((F.col(cluster) != F.col("lo")) & (F.col(cluster) != F.col("hi"))).agg(
        F.max_by(cluster, F.struct("cruise", (-F.col(cluster)).alias("c"))).alias("cr")
    )
    name = (
        F.when(F.col(cluster) == F.col("hi"), "high_rate_sensing_proxy")
        .when(F.col(cluster) == F.col("lo"), "hovering_proxy")
        .when(F.col(cluster) == F.col("cr"), "cruising_proxy")
        .otherwise("maneuvering_proxy")
    )
    return d.join(F.broadcast(rest)).select(cluster, F.round("rate", 6).alias("rate"), F.round("cruise", 6).alias("cruise"), name.alias("phase"))


def fit_phase_model(
    fit: DataFrame, features: Sequence[str], k: int = 4, seed: int = 42, starts: int = 20
) -> tuple[np.ndarray, dict[str, tuple[float, float]]]:
    """Centres of the best of ``starts`` fits, and mean and deviation of each feature."""
    row = fit.agg(*[a for c in features for a in (F.avg(c).alias(f"m_{c}"), F.stddev_pop(c).alias(f"s_{c}"))]).first()
    scale = {c: (float(row[f"m_{c}"]), float(row[f"s_{c}"]) or 1.0) for c in features}
    scaled = phase_vector(fit, features, scale).select(F.xxhash64(*features).alias("id"), F.col("features").alias("vec"))
    centres, _ = kmeans_centres(materialize(scaled, "points"), k, starts, seed, 40)
    return centres, scale


def phase_vector(df: DataFrame, features: Sequence[str], scale: dict[str, tuple[float, float]]) -> DataFrame:
    return df.withColumn("features", F.array(*[(F.col(c) - scale[c][0]) / scale[c][1] for c in features]))


def assign_phases(df: DataFrame, fit: DataFrame, features: Sequence[str], k: int = 4, seed: int = 42) -> DataFrame:
    """K-means traffic regimes with names derived from the fit subset's centroids."""
    centres, scale = fit_phase_model(fit, features, k, seed)
    fitted = nearest_centre(phase_vector(fit, features, scale), "features", centres)
    # k rows that the naming reads several times
    cent = materialize(fitted.groupBy("cluster").agg(*[F.avg(c).alias(c) for c in features]), "centroids")
    names = name_phases(cent, "cluster").select("cluster", "phase")
    out = nearest_centre(phase_vector(df, features, scale), "features", centres).drop("features")
    return out.join(F.broadcast(names), "cluster")
