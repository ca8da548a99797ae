"""k-nearest-neighbour behaviour graph inside each window."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

STACK_WINDOWS = 512
VARIANTS = ("binary", "directed", "mutual", "sym_weighted", "identity")


def window_affinity(x: np.ndarray, kind: str, tau: float, zero: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Ranking similarity and edge affinity for a stack of windows (windows, records, features).

    Similarities are taken to nine places, for the rank and for the affinity: those equal to nine places count as ties.
    ``zero`` is the cosine of a vector of zeros to any other.
    """
    if kind == "cosine":
        dots = (x[:, :, None, :] * x[:, None, :, :]).sum(axis=3)
        square = np.clip(np.einsum("wii->wi", dots), 1e-16, None)
        sim = np.round(np.clip(dots / np.sqrt(square[:, :, None] * square[:, None, :]), -1.0, 1.0), 9)
        empty = ~x.any(axis=2)
        sim[empty[:, :, None] | empty[:, None, :]] = zero
        return sim, np.exp(sim / tau)
    if kind in ("rbf", "euclidean"):
        d2 = np.round(np.square(x[:, :, None, :] - x[:, None, :, :]).sum(axis=3), 9)
        return -d2, np.exp(-d2 / tau)
    raise ValueError(f"unknown affinity: {kind}")


def window_adjacency(
    x: np.ndarray, k: int, kind: str, tau: float, variant: str, normalize: bool, rank: np.ndarray | None = None, zero: float = 0.0
) -> np.ndarray:
    """Dense adjacency of equally long windows; the length bounds its size.

    A similarity of NaN ranks before all numbers, and its edge and the weights of both its records are NaN.
    """
    m, n, _ = x.shape
    loops = np.broadcast_to(np.eye(n), (m, n, n))
    if variant == "identity":
        return loops
    if variant not in VARIANTS:
        raise ValueError(f"unknown graph variant: {variant}")
    sim, w = window_affinity(x, kind, tau, zero)
    # ties go to the lower position
    order = np.where(np.isnan(sim), np.inf, sim) if rank is None else -rank
    order[:, np.arange(n), np.arange(n)] = -np.inf
    mask = np.zeros((m, n, n))
    if n > 1:
        near = np.argsort(-order, axis=2, kind="stable")[:, :, : max(1, min(k, n - 1))]
        np.put_along_axis(mask, near, 1.0, axis=2)
    back = mask.transpose(0, 2, 1)
    weighted = np.where(mask > 0, w, 0.0)
    if variant == "binary":
        adj = (mask + back) / 2
    elif variant == "directed":
        adj = weighted
    elif variant == "mutual":
        adj = np.where(back > 0, weighted, 0.0)
    else:
        adj = (weighted + weighted.transpose(0, 2, 1)) / 2
    adj = adj + loops
    if not normalize:
        return adj
    scale = 1 / np.sqrt(np.clip(adj.sum(axis=2), 1e-8, None))
    # a scale of NaN makes no edge where there is none
    return np.where(adj != 0, scale[:, :, None] * adj * scale[:, None, :], 0.0)


def random_rank(n: int, prefix: str) -> np.ndarray:
    """Seeded order of the possible neighbours of each record."""
    digest = [[hashlib.md5(f"{prefix}|{i}|{j}".encode()).hexdigest()[:12] for j in range(n)] for i in range(n)]
    return np.asarray([[float(int(h, 16)) for h in row] for row in digest]).reshape(n, n)


def behaviour_graph(
    packed: DataFrame,
    keys: Sequence[str],
    k: int = 4,
    kind: str = "cosine",
    tau: float = 1.0,
    variant: str = "sym_weighted",
    normalize: bool = True,
    random_seed: int | None = None,
    zero: float = 0.0,
) -> DataFrame:
    """Edge table (keys, src, dst, weight) from packed windows.

    ``packed`` has one bounded row per window with ``features`` as an array of vectors. A
    window is one row, so no pairs are shuffled; only non-zero edges leave the task. With
    ``random_seed`` the neighbours are seeded random ones instead of the nearest. ``zero`` is the
    cosine of a record of zeros to any other: none is defined, 0 keeps its edges finite.
    """
    fields = ", ".join(f"`{c}` {packed.schema[c].dataType.simpleString()}" for c in keys)

    def edges(rows: pd.DataFrame, x: np.ndarray) -> pd.DataFrame:
        rank = None
        if random_seed is not None:
            names = ["|".join(str(v) for v in (random_seed, *r)) for r in rows[list(keys)].itertuples(index=False, name=None)]
            rank = np.stack([random_rank(x.shape[1], name) for name in names])
        adj = window_adjacency(x, k, kind, tau, variant, normalize, rank, zero)
        which, src, dst = np.nonzero(adj)
        out = {c: rows[c].to_numpy()[which] for c in keys}
        return pd.DataFrame({**out, "src": src, "dst": dst, "weight": adj[which, src, dst]})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            lengths = b["features"].map(len)
            for n in np.unique(lengths):
                same = b[lengths == n]
                for lo in range(0, len(same), STACK_WINDOWS):
                    part = same.iloc[lo:lo + STACK_WINDOWS]
                    flat = np.concatenate([np.stack(f) for f in part["features"]]).astype(np.float64)
                    yield edges(part, flat.reshape(len(part), n, -1))

    out = packed.select(*keys, F.col("features")).mapInPandas(run, fields + ", src long, dst long, weight double")
    # pandas hands NaN over as NULL
    return out.withColumn("weight", F.coalesce("weight", F.lit(math.nan)))
