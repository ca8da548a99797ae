"""Union of heterogeneous prepared tables over one feature list."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.functions.text import finite


def ordered_union(lists: Sequence[Sequence[str]]) -> list[str]:
    seen: dict[str, None] = {}
    for items in lists:
        for x in items:
            seen.setdefault(x)
    return list(seen)


def align_features(df: DataFrame, meta: Sequence[str], features: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Select metadata and the feature union; absent or missing features are 0.0."""
    filled = [c for c in features if c not in df.columns]
    cols = [
        F.lit(0.0).alias(c) if c in filled else F.coalesce(finite(F.col(c)), F.lit(0.0)).alias(c) for c in features
    ]
    return df.select(*cols, *meta), filled


def merge_sources(frames: Sequence[DataFrame], meta: Sequence[str]) -> tuple[DataFrame, dict[int, list[str]]]:
    """Features first in order of first appearance, metadata last."""
    features = ordered_union([[c for c in f.columns if c not in meta] for f in frames])
    aligned, filled = [], {}
    for i, f in enumerate(frames):
        d, missing = align_features(f, meta, features)
        aligned.append(d)
        filled[i] = missing
    return reduce(DataFrame.unionByName, aligned), filled


def header_union(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def union_splits(frames: Sequence[tuple[str, DataFrame]]) -> DataFrame:
    """Splits in fixed order; the rank column keeps that order for later numbering."""
    tagged = [
        f.withColumns({"split": F.lit(name), "split_rank": F.lit(i)}) for i, (name, f) in enumerate(frames)
    ]
    return reduce(DataFrame.unionByName, tagged)


def select_sources(
    names: Sequence[str], include: Sequence[str] | None = None, exclude: Sequence[str] = ()
) -> list[str]:
    """Configured sources in include order without the excluded ones."""
    if len(set(names)) != len(names):
        raise ValueError("source names must be unique")
    chosen = list(include) if include else list(names)
    unknown = [c for c in [*chosen, *exclude] if c not in names]
    if unknown:
        raise ValueError(f"unknown sources: {unknown}")
    if len(set(chosen)) != len(chosen):
        raise ValueError("include list repeats a source")
    kept = [c for c in chosen if c not in set(exclude)]
    if not kept:
        raise ValueError("no sources left")
    return kept
