"""Quality rules: robust multivariate outliers by minimum-covariance-determinant estimates per language and source."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import TEXT_BATCH_BYTES, materialize
from vigilframe.llm.common import small_side

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
# Statistics are whole thousandths, so sums over any partitioning are equal to the last digit.
SCALE = 1000
# Name of each transformed statistic, what it is a mean over, and how many of these one event counts: a repeat is a
# 3-word window that stands twice. A mean over n has, square-rooted, a counting noise of sqrt(event / n) / 2 whatever
# its size (a word's length varies by about half of its mean, so the logarithm of the mean length has it too).
FEATURES = (
    ("f_length", "n_words", 1), ("f_symbols", "word_chars", 1), ("f_lines", "n_lines", 1),
    ("f_repeats", "n_words", 6),
)
# Share of the rows that the estimate concentrates on, rows that a group needs, and the share of normal rows that may be
# rejected.
KEEP_SHARE = 0.75
MIN_ROWS = 100
TAIL = 1e-3
# Starts of the estimate, the most concentration steps, and the least fall of the determinant's logarithm that goes on.
STARTS = 3
STEPS = 12
FALL = 1e-3
BINS_PER_E = 16
_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")


def count_text(text: bytes) -> tuple[int, ...]:
    """The counts named in _COUNTS of one text."""
    words = text.split()
    n = len(words)
    in_words = sum(map(len, words))
    chars = len(text.decode("utf-8", "replace")) - (len(text) - in_words)
    symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    lines = [x for x in text.split(b"\n") if x.strip()]
    grams = list(zip(words, words[1:], words[2:]))
    repeats = 0
    if len(set(grams)) < len(grams):
        often = Counter(grams)
        end = 0
        for i, g in enumerate(grams):
            if often[g] > 1:
                repeats += i + 3 - max(i, end)
                end = i + 3
    return n, chars, symbols, len(lines) - len(set(lines)), repeats, len(lines)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("__t")
        rows = []
        for t in texts:
            t = t.as_buffer()
            rows.append(count_text(bytes(t) if t else b""))
        counts = np.array(rows, np.int64).reshape(len(rows), len(_COUNTS))
        others = [i for i, name in enumerate(batch.schema.names) if name != "__t"]
        yield pa.RecordBatch.from_arrays(
            [batch.column(i) for i in others] + [pa.array(counts[:, k]) for k in range(len(_COUNTS))],
            [batch.schema.names[i] for i in others] + list(_COUNTS),
        )


def _ratio(a: str, b: str) -> Column:
    return F.coalesce(F.try_divide(F.col(a), F.col(b)), F.lit(0.0))


def _features() -> list[Column]:
    values = (
        F.log(F.greatest(_ratio("word_chars", "n_words"), F.lit(0.5))),
        F.sqrt(_ratio("n_symbols", "word_chars")),
        F.sqrt(_ratio("n_dup_lines", "n_lines")),
        F.sqrt(_ratio("n_repeat_words", "n_words")),
    )
    return [F.round(v * SCALE).cast("long").alias(name) for v, (name, *_) in zip(values, FEATURES)]


def chi2_cdf(x: float, d: int) -> float:
    """Chi-square distribution function by the series of the incomplete gamma function."""
    a, y = d / 2, x / 2
    if y <= 0:
        return 0.0
    term = total = 1 / a
    k = a
    while term > total * 1e-15:
        k += 1
        term *= y / k
        total += term
    return min(1.0, total * math.exp(-y + a * math.log(y) - math.lgamma(a)))


def chi2_quantile(p: float, d: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        middle = (low + high) / 2
        low, high = (middle, high) if chi2_cdf(middle, d) < p else (low, middle)
    return high


def typical_sizes(rows: DataFrame) -> list[int]:
    """Medians, over all rows, of what each statistic is a mean over."""
    of = sorted({n for _, n, _ in FEATURES})
    found = rows.agg(*[F.percentile_approx(n, 0.5, 10000).alias(n) for n in of]).first()
    return [max(1, found[n] or 1) for _, n, _ in FEATURES]


def least_deviations(typical: list[int]) -> list[float]:
    """Counting noise of each statistic in a text of typical size; no estimate can be finer."""
    return [SCALE / 2 * math.sqrt(event / n) for (_, _, event), n in zip(FEATURES, typical)]


def _estimate(cell: str, start: int, n: int, mean: np.ndarray, cov: np.ndarray, least: list[float]) -> pd.DataFrame:
    least = np.array(least, float) ** 2
    cov = cov + np.diag(np.maximum(least - np.diag(cov), 0))
    fields = {"cell": [cell], "start": [start], "n": [n], "mean": [mean.tolist()], "precision": [np.linalg.inv(cov).ravel().tolist()]}
    return pd.DataFrame({**fields, "log_det": [float(np.linalg.slogdet(cov)[1])]})


_MODEL = "cell string, start int, n long, mean array<double>, precision array<double>, log_det double"


def _start(least: list[float]):
    """Estimates of a cell to start from: independent statistics, and the correlations of bounded and of projected deviations."""
    d = len(FEATURES)

    def start(group: pd.DataFrame) -> pd.DataFrame:
        r = group.iloc[0]
        middle = np.array([r[f"m_{name}"] for name, *_ in FEATURES], float)
        spread = np.maximum(np.array([r[f"d_{name}"] for name, *_ in FEATURES], float) * 1.4826, least)
        out = [_estimate(r["cell"], 0, r["n"], middle, np.diag(spread**2), least)]
        for k, kind in enumerate(("t", "u")):
            sums = np.array([[r[f"{kind}{min(i, j)}_{max(i, j)}"] for j in range(d)] for i in range(d)], float)
            scale = np.sqrt(np.maximum(np.diag(sums), 1.0))
            # Never quite singular.
            relation = 0.95 * sums / np.outer(scale, scale)
            np.fill_diagonal(relation, 1.0)
            out.append(_estimate(r["cell"], k + 1, r["n"], middle, relation * np.outer(spread, spread), least))
        return pd.concat(out)

    return start


def _concentrate(share: float | None, least: list[float]):
    """Estimate from the nearest rows of a cell: a share of them, or those below the 97.5 % distance."""
    d = len(FEATURES)
    limit = chi2_quantile(0.975 if share is None else share, d)
    factor = (0.975 if share is None else share) / chi2_cdf(limit, d + 2)
    last = math.floor(math.log(limit + 1e-6) * BINS_PER_E)

    def estimate(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("bin")
        total = int(group["k"].sum())
        if share is None:
            chosen = group[group["bin"] <= last]
            chosen = chosen if chosen["k"].sum() > 2 * d else group
        else:
            chosen = group.iloc[: int(np.searchsorted(group["k"].cumsum(), share * total)) + 1]
        k = int(chosen["k"].sum())
        mean = np.array([int(chosen[f"s{i}"].sum()) for i in range(d)], float) / k
        cov = np.empty((d, d))
        for i in range(d):
            for j in range(i, d):
                cov[i, j] = cov[j, i] = int(chosen[f"s{i}_{j}"].sum()) / k - mean[i] * mean[j]
        return _estimate(group["cell"].iloc[0], int(group["start"].iloc[0]), total, mean, cov * factor, least)

    return estimate


def _distance(typical: list[int]) -> Column:
    """Squared distance; a text of less than typical size has more noise, and its deviations count for less by it."""
    d = len(FEATURES)
    off = [
        (F.col(name) - F.col("mean")[i]) * F.sqrt(F.least(F.lit(1.0), F.col(n) / F.lit(float(typical[i]))))
        for i, (name, n, _) in enumerate(FEATURES)
    ]
    parts = [off[i] * off[j] * F.col("precision")[i * d + j] * (1 if i == j else 2) for i in range(d) for j in range(i, d)]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return F.greatest(total, F.lit(0.0))


def fit_outliers(rows: DataFrame, typical: list[int]) -> DataFrame:
    """(cell, n, mean, precision) from rows of a cell, counts and transformed statistics.

    Starts side by side from the medians and median deviations with three guesses of the correlations. Each concentration
    step keeps the nearest 75 % of a cell's rows and estimates anew, until no determinant falls any more; the start of the
    least determinant wins, and a last step keeps the rows within its 97.5 % distance. A step is one pass that adds up
    counts, sums and products per cell, start and distance bin before anything is shuffled, so a cell's size does not
    matter; choosing the bins and inverting the matrix is done per cell on its few bins.
    """
    names, least, d = [n for n, *_ in FEATURES], least_deviations(typical), len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    middle = rows.groupBy("cell").agg(F.count("*").alias("n"), *[F.percentile_approx(c, 0.5, 10000).alias(f"m_{c}") for c in names])
    middle = materialize(middle, "medians")
    centred = rows.join(small_side(middle), "cell")
    spread = centred.groupBy("cell").agg(
        F.first("n").alias("n"),
        *[F.first(f"m_{c}").alias(f"m_{c}") for c in names],
        *[F.percentile_approx(F.abs(F.col(c) - F.col(f"m_{c}")), 0.5, 10000).alias(f"d_{c}") for c in names],
    )
    spread = materialize(spread, "deviations")
    off = [(F.col(c) - F.col(f"m_{c}")) / F.greatest(F.col(f"d_{c}") * 1.4826, F.lit(least[i])) for i, c in enumerate(names)]
    bounded = {f"t{i}": F.round(F.tanh(x) * SCALE).cast("long") for i, x in enumerate(off)}
    far = F.sqrt(sum((x * x for x in off[1:]), off[0] * off[0]))
    projected = {f"u{i}": F.coalesce(F.round(F.try_divide(x, far) * SCALE), F.lit(0)).cast("long") for i, x in enumerate(off)}
    deviations = rows.join(small_side(spread), "cell").select("cell", *[c.alias(k) for k, c in {**bounded, **projected}.items()])
    products = deviations.groupBy("cell").agg(*[F.sum(F.col(f"{k}{i}") * F.col(f"{k}{j}")).alias(f"{k}{i}_{j}") for k in "tu" for i, j in pairs])
    model = materialize(spread.join(products, "cell").groupBy("cell").applyInPandas(_start(least), _MODEL), "model")

    def step(model: DataFrame, share: float | None) -> DataFrame:
        near = rows.join(small_side(model.select("cell", "start", "mean", "precision")), "cell")
        near = near.withColumn("bin", F.floor(F.log(_distance(typical) + 1e-6) * BINS_PER_E))
        sums = near.groupBy("cell", "start", "bin").agg(
            F.count("*").alias("k"),
            *[F.sum(names[i]).alias(f"s{i}") for i in range(d)],
            *[F.sum(F.col(names[i]) * F.col(names[j])).alias(f"s{i}_{j}") for i, j in pairs],
        )
        return materialize(sums.groupBy("cell", "start").applyInPandas(_concentrate(share, least), _MODEL), "model")

    for k in range(STEPS):
        was = model.select("cell", "start", F.col("log_det").alias("was"))
        model = step(model, KEEP_SHARE)
        if k and not model.join(was, ["cell", "start"]).where(F.col("log_det") < F.col("was") - FALL).limit(1).count():
            break
    best = model.groupBy("cell").agg(F.min_by(F.struct("start", "mean", "precision"), F.struct("log_det", "start")).alias("b"))
    return step(materialize(best.select("cell", "b.*"), "model"), None)


def quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """Counts, base rules and outlier verdict of every document.

    A document fails the base rules with fewer than 50 words, or if over half of its words lie in repeated 3-word
    windows. Of the others, the vector of transformed statistics (mean word length, symbols, equal lines, repeats)
    is compared with its language's and source's robust estimate; a squared Mahalanobis distance that a
    normal row exceeds with a chance of TAIL rejects it. No deviation is taken to be less than the counting noise of a
    text of the rows' own median size. Groups of fewer than 100 rows are estimated together with
    the other such groups of their language, or, if those are few too, of all languages; if these are fewer than 100
    as well, nothing is rejected by distance.

    Returns doc_id, text_hash, the counts, base_failed, distance, kept: a row per row of ``docs``. A null or empty text
    has no words and fails. Null languages and sources are groups of their own. Ties and repeated rows get equal
    verdicts. An empty table gives no rows. Other columns are not read.
    """
    read = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(lang).cast("string").alias("lang"),
        F.col(source).cast("string").alias("source"),
        F.xxhash64(F.col(text)).alias("text_hash"),
        F.col(text).cast("binary").alias("__t"),
    )
    kind = docs.schema[doc_id].dataType.simpleString()
    counted = read.mapInArrow(
        _count, f"doc_id {kind}, lang string, source string, text_hash long, " + ", ".join(f"{c} long" for c in _COUNTS)
    )
    counted = counted.withColumn(
        "base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    )
    counted = materialize(counted.select("*", *_features()), "counts", TEXT_BATCH_BYTES)

    fit = counted.where("not base_failed")
    groups = materialize(fit.groupBy("lang", "source").agg(F.count("*").alias("n")), "groups")
    few = groups.where(F.col("n") < MIN_ROWS).groupBy("lang").agg(F.sum("n").alias("n_lang"))
    placed = groups.alias("g").join(few.alias("f"), F.col("g.lang").eqNullSafe(F.col("f.lang")), "left").select(
        "g.lang",
        "g.source",
        F.when(F.col("n") >= MIN_ROWS, _cell("g", True)).when(F.col("n_lang") >= MIN_ROWS, _cell("g", False)).otherwise("{}").alias("cell"),
    )
    placed = materialize(placed, "cells")

    def with_cell(rows: DataFrame) -> DataFrame:
        same = F.col("r.lang").eqNullSafe(F.col("p.lang")) & F.col("r.source").eqNullSafe(F.col("p.source"))
        return rows.alias("r").join(small_side(placed).alias("p"), same, "left").select("r.*", "p.cell")

    typical = typical_sizes(fit)
    sizes = sorted({n for _, n, _ in FEATURES})
    model = fit_outliers(with_cell(fit).select("cell", *sizes, *[n for n, *_ in FEATURES]), typical)
    model = model.where(F.col("n") >= MIN_ROWS).select("cell", "mean", "precision")
    judged = with_cell(counted).join(small_side(model), "cell", "left").withColumn("distance", _distance(typical))
    limit = chi2_quantile(1 - TAIL, len(FEATURES))
    return judged.select(
        "doc_id", "text_hash", *_COUNTS[:5], "base_failed", "distance",
        (~F.col("base_failed") & (F.coalesce("distance", F.lit(0.0)) <= limit)).alias("kept"),
    )


def _cell(side: str, with_source: bool) -> Column:
    fields = [F.col(f"{side}.lang").alias("lang")] + ([F.col(f"{side}.source").alias("source")] if with_source else [])
    return F.to_json(F.struct(F.lit(with_source).alias("own"), *fields))
