"""Prototype model, raw out-of-distribution scores and the pluggable window scorer."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import is_small, materialize
from vigilframe.operators.ordering import match_keys

BLOCK_ROWS = 2048
# Windows whose cosines to a block are one matrix.
STRIP_ROWS = 256
# A bank of more rows is never collected, whatever its estimated size.
BANK_ROWS = 20_000
# Part of a packed bank that one task passes its windows over.
BANK_PART_BYTES = 64 * 1024 * 1024


@dataclass
class PrototypeModel:
    """Class means and shared precision; sizes are bounded by classes and dimensions."""

    classes: list
    prototypes: np.ndarray
    precision: np.ndarray | None = None
    scale: float = 1.0
    bank: DataFrame | None = field(default=None, repr=False)


def class_means(df: DataFrame, vector: str, labels: Column, classes: Sequence) -> DataFrame:
    """Mean vector per class; a class without members gets the global mean.

    ``labels`` is an array column, so a window may count for several classes.
    """
    vec = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v"), labels.alias("labels"))
    wanted = F.array(*[F.lit(c) for c in classes])
    per_class = (
        vec.select("v", F.explode(F.array_intersect("labels", wanted)).alias("class"))
        .groupBy("class")
        .agg(Summarizer.mean(F.col("v")).alias("m"), F.count(F.lit(1)).alias("n"))
    )
    overall = vec.agg(Summarizer.mean(F.col("v")).alias("g"))
    spine = df.sparkSession.createDataFrame([(c,) for c in classes], f"class {_type_of(classes)}")
    return (
        spine.join(per_class, "class", "left")
        .join(F.broadcast(overall))
        .select("class", F.coalesce("n", F.lit(0)).alias("n"), vector_to_array(F.coalesce("m", "g")).alias("vec"))
    )


def _type_of(classes: Sequence) -> str:
    return "string" if isinstance(classes[0], str) else "int"


def covariance_parts(df: DataFrame, vector: str, mean: np.ndarray) -> tuple[int, np.ndarray, float]:
    """Row count, centred Gram matrix and sum of fourth powers of the norms.

    Each Arrow batch contributes one d x d matrix; Spark adds the matrices up.
    """

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = len(mean)
        gram, quad, n = np.zeros((d, d)), 0.0, 0
        for b in batches:
            if len(b) == 0:
                continue
            x = np.stack(b["v"].to_numpy()).astype(np.float64) - mean
            gram += x.T @ x
            quad += float((np.square(x).sum(axis=1) ** 2).sum())
            n += len(x)
        yield pd.DataFrame({"gram": [gram.ravel().tolist()], "quad": [quad], "n": [n]})

    parts = df.select(F.col(vector).cast("array<double>").alias("v")).mapInPandas(
        partial, "gram array<double>, quad double, n long"
    )
    row = parts.agg(
        vector_to_array(Summarizer.sum(array_to_vector("gram"))).alias("gram"),
        F.sum("quad").alias("quad"),
        F.sum("n").alias("n"),
    ).first()
    d = len(mean)
    return int(row["n"]), np.asarray(row["gram"]).reshape(d, d), float(row["quad"])


def precision_matrix(df: DataFrame, vector: str, mean: np.ndarray, shrinkage: bool = True) -> np.ndarray:
    """Inverse covariance: Ledoit-Wolf shrinkage when there are enough rows, else a ridge."""
    n, gram, quad = covariance_parts(df, vector, mean)
    d = len(mean)
    if shrinkage and n > d + 2:
        emp = gram / n
        mu = np.trace(emp) / d
        delta = (np.square(emp).sum() - 2 * mu * np.trace(emp) + d * mu * mu) / d
        beta = min((quad / n - np.square(emp).sum()) / (d * n), delta)
        s = 0.0 if beta == 0 else beta / delta
        return np.linalg.pinv((1 - s) * emp + s * mu * np.eye(d), hermitian=True)
    cov = gram / (n - 1) if n > 1 else np.eye(d)
    return np.linalg.pinv(cov + 1e-3 * np.eye(d), hermitian=True)


def fit_prototypes(
    df: DataFrame,
    vector: str,
    labels: Column,
    classes: Sequence,
    precision: bool = True,
    scale: float = 1.0,
) -> PrototypeModel:
    rows = class_means(df, vector, labels, classes).collect()  # one row per class
    by_class = {r["class"]: np.asarray(r["vec"], dtype=np.float64) for r in rows}
    protos = np.stack([by_class[c] for c in classes])
    prec = None
    if precision:
        mean = df.select(array_to_vector(F.col(vector).cast("array<double>")).alias("v")).agg(
            vector_to_array(Summarizer.mean(F.col("v"))).alias("m")
        ).first()["m"]
        prec = precision_matrix(df, vector, np.asarray(mean))
    return PrototypeModel(list(classes), protos, prec, scale)


Scorer = Callable[[np.ndarray], dict[str, np.ndarray]]


def prototype_scorer(model: PrototypeModel, temperature: float = 1.0) -> Scorer:
    """Default model: logits are scaled dot products with the class prototypes."""
    protos, scale = model.prototypes, model.scale

    def score(x: np.ndarray) -> dict[str, np.ndarray]:
        logits = scale * (x @ protos.T)
        return {"logits": logits, "probs": 1 / (1 + np.exp(-logits / temperature)), "embedding": x}

    return score


def score_windows(df: DataFrame, ids: Sequence[str], vector: str, scorer: Scorer, sizes: str | None = None) -> DataFrame:
    """Run a model over windows in Arrow batches.

    Adds logits, probs, embedding and attention; attention is uniform over the window's
    records when the model gives none.
    """
    keep = df.select(*ids, F.col(vector).cast("array<double>").alias("__x"),
                     (F.col(sizes) if sizes else F.lit(1)).cast("int").alias("__n"))
    fields = ", ".join(f"`{c}` {keep.schema[c].dataType.simpleString()}" for c in ids)
    schema = fields + ", logits array<double>, probs array<double>, embedding array<double>, attention array<double>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b) == 0:
                continue
            out = scorer(np.stack(b["__x"].to_numpy()).astype(np.float64))
            frame = b[list(ids)].copy()
            for name in ("logits", "probs", "embedding"):
                frame[name] = list(out[name])
            given = out.get("attention")
            frame["attention"] = list(given) if given is not None else [np.full(n, 1.0 / max(n, 1)) for n in b["__n"]]
            yield frame

    return keep.mapInPandas(run, schema)


def _distances(x: np.ndarray, model: PrototypeModel, t: float) -> dict[str, np.ndarray]:
    logits = model.scale * (x @ model.prototypes.T)
    z = logits / max(t, 1e-6)
    top = z.max(axis=1, keepdims=True)
    energy = -t * (top[:, 0] + np.log(np.exp(z - top).sum(axis=1)))
    best = np.full(len(x), np.inf)
    for mu in model.prototypes:
        diff = x - mu
        dist = np.square(diff).sum(axis=1) if model.precision is None else np.einsum("nd,nd->n", diff @ model.precision, diff)
        best = np.minimum(best, dist)
    return {"conf": 1 - (1 / (1 + np.exp(-z))).max(axis=1), "energy": energy, "proto": np.sqrt(np.clip(best, 0, None))}


def _merge_best(best: np.ndarray | None, unit: np.ndarray, block: np.ndarray, k: int) -> np.ndarray:
    """The k largest cosines of each row so far, after one more block of unit vectors; no order inside a row."""
    best = np.empty((len(unit), 0)) if best is None else best
    out = np.empty((len(unit), min(k, best.shape[1] + len(block))))
    quick = block.astype(np.float32).T if best.shape[1] == k else None
    for lo in range(0, len(unit), STRIP_ROWS):
        at = slice(lo, lo + STRIP_ROWS)
        out[at] = _merge_strip(best[at], unit[at], block, quick, k)
    return out


def _merge_strip(best: np.ndarray, unit: np.ndarray, block: np.ndarray, quick: np.ndarray | None, k: int) -> np.ndarray:
    if quick is not None:
        # only rows that the block may improve, by single precision and its largest error, are multiplied and sorted again
        most = (unit.astype(np.float32) @ quick).max(axis=1) + (unit.shape[1] + 4) * np.finfo(np.float32).eps
        rows = np.flatnonzero(most > best.min(axis=1))
        best[rows] = np.partition(np.hstack([best[rows], unit[rows] @ block.T]), -k, axis=1)[:, -k:]
        return best
    wide = np.hstack([best, unit @ block.T])
    return np.partition(wide, -k, axis=1)[:, -k:] if wide.shape[1] > k else wide


def _nearest(x: np.ndarray, bank: np.ndarray, k: int) -> np.ndarray:
    """Negative mean of the k largest cosines, in blocks of the bank."""
    unit, best = _unit(x), None
    for lo in range(0, len(bank), BLOCK_ROWS):
        best = _merge_best(best, unit, bank[lo:lo + BLOCK_ROWS], max(1, k))
    return -best.mean(axis=1)


def _batched(keep: DataFrame, ids: Sequence[str], names: Sequence[str], score) -> DataFrame:
    """Columns ``names`` of a function of the vectors, beside the ids."""
    fields = ", ".join(f"`{c}` {keep.schema[c].dataType.simpleString()}" for c in ids)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for lo in range(0, len(batch), BLOCK_ROWS):
                part = batch.iloc[lo:lo + BLOCK_ROWS]
                frame = part[list(ids)].copy()
                for name, values in score(np.stack(part["__x"].to_numpy()).astype(np.float64)).items():
                    frame[name] = values
                yield frame

    return keep.mapInPandas(run, fields + "".join(f", {n} double" for n in names))


def _vectors(df: DataFrame, ids: Sequence[str], vector: str) -> DataFrame:
    return df.select(*ids, F.col(vector).cast("array<double>").alias("__x"))


def distance_scores(
    df: DataFrame, ids: Sequence[str], vector: str, model: PrototypeModel, temperature: float = 1.0
) -> DataFrame:
    """conf, energy and proto per window from the prototype model."""
    t = float(temperature)
    return _batched(_vectors(df, ids, vector), ids, ("conf", "energy", "proto"), lambda x: _distances(x, model, t))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.clip(np.linalg.norm(x, axis=1, keepdims=True), 1e-8, None)


def _small_bank(df: DataFrame, bank: DataFrame, bank_vector: str):
    """The bank as a broadcast matrix if its size and its counted rows are small, else None."""
    if not is_small(bank) or bank.count() > BANK_ROWS:
        return None
    rows = bank.select(F.col(bank_vector).cast("array<double>").alias("b")).collect()
    return df.sparkSession.sparkContext.broadcast(_unit(np.asarray([r["b"] for r in rows], dtype=np.float64)))


def knn_scores(
    df: DataFrame, ids: Sequence[str], vector: str, bank: DataFrame, bank_vector: str, k: int = 5
) -> DataFrame:
    """Negative mean of the k largest cosines to the bank, exact for any bank size.

    A bank of proven small size goes to every executor. A larger one is packed into
    blocks of bounded size; a task passes the blocks of a part of the bank by each of its
    window chunks and keeps the k best, so k numbers per window and part are merged instead of all pairs.
    """
    keep = _vectors(df, ids, vector)
    shared = _small_bank(df, bank, bank_vector)
    if shared is not None:
        return _batched(keep, ids, ("knn",), lambda x: {"knn": _nearest(x, shared.value, k)})
    fields = ", ".join(f"`{c}` {keep.schema[c].dataType.simpleString()}" for c in ids)
    return blocked_knn(keep, ids, fields, bank, bank_vector, k)


def blocked_knn(
    keep: DataFrame, ids: Sequence[str], fields: str, bank: DataFrame, bank_vector: str, k: int,
    rows_per_block: int = BLOCK_ROWS,
) -> DataFrame:
    """Block-wise top-k of cosines merged per window; ``fields`` are the ids with their types.

    Both sides are packed where they lie, unit vectors as bytes. Chunks of windows and parts of the bank meet in a
    Cartesian product, which repeats neither in a shuffle: memory is bounded by a chunk, a block and their cosines.
    """
    k = max(1, k)
    windows = materialize(_packed(keep, "__x", rows_per_block, fields), "windows")
    blocks = materialize(_packed(bank.select(F.col(bank_vector).cast("array<double>").alias("__x")), "__x", rows_per_block, ""), "bank")
    size = blocks.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    parts = blocks.select(F.col("x").alias("block")).coalesce(-(-size // BANK_PART_BYTES) or 1)
    # a small file is one task, however many chunks it holds
    tasks = min(max(windows.count(), 1), 4 * windows.sparkSession.sparkContext.defaultParallelism)
    pairs = windows.repartition(tasks).join(parts.hint("shuffle_replicate_nl"))

    listed = "__row long" + (f", {fields}" if fields else "")
    found = pairs.mapInArrow(lambda batches: _pass_blocks(batches, k), f"{listed}, sims array<double>")
    merged = found.groupBy("__row", *ids).agg(F.flatten(F.collect_list("sims")).alias("s"))
    top = F.slice(F.reverse(F.array_sort("s")), 1, k)
    return merged.select(
        *ids, (-F.aggregate(top, F.lit(0.0), lambda a, x: a + x) / F.size(top)).alias("knn")
    )


def _pass_blocks(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    """The k best cosines of the rows of each chunk, from rows (chunk, rows, x, block) in which a chunk's rows lie together."""
    chunk = best = unit = rows = None
    for batch in batches:
        for i, key in enumerate(batch.column("chunk").to_pylist()):
            if key != chunk:
                if best is not None:
                    yield _best_rows(rows, best)
                # copies: a view would hold its whole batch while the next ones come
                rows = batch.column("rows")[i].values
                rows = rows.take(pa.array(np.arange(len(rows))))
                chunk, unit, best = key, _matrix(batch.column("x")[i], len(rows)).copy(), None
            block = batch.column("block")[i].as_buffer()
            best = _merge_best(best, unit, np.frombuffer(block, dtype=np.float64).reshape(-1, unit.shape[1]), k)
        block = batch = None  # free before the next batch is read
    if best is not None:
        yield _best_rows(rows, best)


def _packed(df: DataFrame, vector: str, rows: int, fields: str) -> DataFrame:
    """Chunks of at most ``rows`` rows: chunk, rows (their number and the other columns), and x, their unit vectors as bytes."""
    struct = "__row: bigint" + "".join(f", `{n}`: {df.schema[n].dataType.simpleString()}" for n in df.columns if n != vector)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = TaskContext.get().partitionId() << 33
        for batch in batches:
            for lo in range(0, len(batch), rows):
                part = batch.slice(lo, rows)
                x = _unit(np.stack(part.column(vector).to_numpy(zero_copy_only=False)).astype(np.float64))
                others = [n for n in part.schema.names if n != vector]
                numbers = pa.array(np.arange(first, first + len(part)))
                cells = pa.StructArray.from_arrays([numbers, *[part.column(n) for n in others]], ["__row", *others])
                listed = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), cells)
                yield pa.RecordBatch.from_arrays([pa.array([first]), listed, pa.array([x.tobytes()], pa.binary())], ["chunk", "rows", "x"])
                first += len(part)

    return df.mapInArrow(run, f"chunk long, rows array<struct<{struct}>>, x binary")


def _matrix(cell: pa.BinaryScalar, rows: int) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), dtype=np.float64).reshape(rows, -1)


def _best_rows(rows: pa.StructArray, best: np.ndarray) -> pa.RecordBatch:
    """The rows of a chunk, each with its best cosines."""
    offsets = pa.array(np.arange(0, best.size + 1, best.shape[1]), pa.int32())
    sims = pa.ListArray.from_arrays(offsets, pa.array(best.ravel()))
    return pa.RecordBatch.from_arrays([*rows.flatten(), sims], [*[f.name for f in rows.type], "sims"])


def raw_scores(
    df: DataFrame,
    ids: Sequence[str],
    vector: str,
    model: PrototypeModel,
    bank: DataFrame,
    bank_vector: str,
    temperature: float = 1.0,
    k: int = 5,
) -> DataFrame:
    """conf, energy, proto and knn of every window, in one pass where the bank is small. Ids may be null."""
    shared = _small_bank(df, bank, bank_vector)
    if shared is None:
        dist = distance_scores(df, ids, vector, model, temperature)
        return match_keys(dist, knn_scores(df, ids, vector, bank, bank_vector, k), list(ids), how="inner")
    t = float(temperature)
    names = ("conf", "energy", "proto", "knn")
    return _batched(
        _vectors(df, ids, vector), ids, names, lambda x: {**_distances(x, model, t), "knn": _nearest(x, shared.value, k)}
    )
