"""Multi-label, ranking and decision metrics as grouped aggregates."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.operators.ordering import match_small, quantiles, running_sums, settle


def decision_counts(pred: Column, truth: Column) -> list[Column]:
    return [
        F.count_if(pred & truth).alias("tp"),
        F.count_if(pred & ~truth).alias("fp"),
        F.count_if(~pred & ~truth).alias("tn"),
        F.count_if(~pred & truth).alias("fn"),
    ]


def rates(df: DataFrame) -> DataFrame:
    """Precision, recall, F1 and FPR from tp, fp, tn, fn."""
    p = F.col("tp") / F.greatest(F.col("tp") + F.col("fp"), F.lit(1))
    r = F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))
    return df.withColumns({"precision": p, "recall": r}).withColumns(
        {
            "f1": 2 * F.col("precision") * F.col("recall")
            / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12)),
            "fpr": F.col("fp") / F.greatest(F.col("fp") + F.col("tn"), F.lit(1)),
        }
    )


def decision_metrics(df: DataFrame, keys: Sequence[str], pred: Column, truth: Column) -> DataFrame:
    return rates(df.groupBy(*keys).agg(*decision_counts(pred, truth)))


def ranked_counts(
    df: DataFrame, keys: Sequence[str], score: str, truth: str, buckets: int | None = None
) -> DataFrame:
    """Distinct scores, best first, with positives, negatives and running totals."""
    collapsed = (
        df.where(F.col(score).isNotNull() & F.col(truth).isNotNull())
        .groupBy(*keys, F.col(score).cast("double").alias("__s"))
        .agg(F.sum(F.col(truth).cast("long")).alias("pos"), F.sum(1 - F.col(truth).cast("long")).alias("neg"))
    )
    collapsed = settle(collapsed, bool(keys), buckets)
    return running_sums(collapsed, keys, ["-__s"], {"tp": "pos", "fp": "neg"}, buckets=buckets)


def _with_totals(ranked: DataFrame, keys: Sequence[str]) -> DataFrame:
    totals = ranked.groupBy(*keys).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    return match_small(ranked, totals, keys) if keys else ranked.join(F.broadcast(totals))


def _both(value: Column) -> Column:
    return F.when((F.max("P") > 0) & (F.max("N") > 0), value)


def ranking_metrics(
    df: DataFrame, keys: Sequence[str], score: str, truth: str, target_tpr: float = 0.95, buckets: int | None = None
) -> DataFrame:
    """AUROC with averaged ties, average precision and FPR at the target TPR.

    Tied scores enter together. One class only gives NULL.
    """
    d = _with_totals(ranked_counts(df, keys, score, truth, buckets), keys)
    below = F.col("N") - F.col("fp")
    area = F.sum(F.col("pos") * (below + F.col("neg") / 2))
    ap = F.sum(F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp")))
    reach = F.min(F.when(F.col("tp") / F.greatest(F.col("P"), F.lit(1)) >= target_tpr, F.col("fp")))
    return d.groupBy(*keys).agg(
        F.max("P").alias("positives"),
        F.max("N").alias("negatives"),
        _both(area / (F.max("P") * F.max("N"))).alias("auroc"),
        _both(ap / F.max("P")).alias("average_precision"),
        _both(reach / F.max("N")).alias("fpr_at_tpr"),
    )


def auroc(df: DataFrame, keys: Sequence[str], score: str, truth: str, buckets: int | None = None) -> DataFrame:
    return ranking_metrics(df, keys, score, truth, buckets=buckets).select(*keys, "auroc")


def best_cut(df: DataFrame, score: str, truth: str) -> DataFrame:
    """Report-only threshold: the best F1 among 19 quantile cuts, first one wins."""
    probs = {f"c{i:02d}": round(0.05 * i, 2) for i in range(1, 20)}
    row = quantiles(df, [], score, probs).first()
    cuts = [row[k] for k in probs]
    t = F.col(truth).cast("boolean")
    aggs = []
    for i, c in enumerate(cuts):
        hit = F.col(score) > float(c)
        aggs += [a.alias(f"{n}{i}") for a, n in zip(decision_counts(hit, t), ("tp", "fp", "tn", "fn"))]
    counts = df.agg(*aggs)
    items = [
        F.struct(
            F.lit(i).alias("ord"), F.lit(float(c)).alias("cut"),
            *[F.col(f"{n}{i}").alias(n) for n in ("tp", "fp", "tn", "fn")],
        )
        for i, c in enumerate(cuts)
    ]
    each = rates(counts.select(F.inline(F.array(*items))))
    best = each.agg(
        F.max_by(F.struct("cut", "precision", "recall", "f1", "fpr"), F.struct("f1", (-F.col("ord")).alias("o"))).alias("b")
    )
    won = F.col("b.f1") > 0
    return best.select(
        F.when(won, F.col("b.precision")).otherwise(0.0).alias("precision"),
        F.when(won, F.col("b.recall")).otherwise(0.0).alias("recall"),
        F.when(won, F.col("b.f1")).otherwise(0.0).alias("f1"),
        F.when(won, F.col("b.cut")).otherwise(0.0).alias("threshold"),
        F.when(won, F.col("b.fpr")).alias("fpr"),
    )


def class_counts(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """tp, fp, fn and support per class from (class_idx, y, pred)."""
    y, p = F.col("y") > 0.5, F.col("pred") > 0.5
    return long.groupBy(*keys, "class_idx").agg(*decision_counts(p, y), F.count_if(y).alias("support"))


def class_rates(long: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    return rates(class_counts(long, keys))


def multilabel_summary(long: DataFrame, window: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """micro/macro F1, Hamming loss and subset accuracy."""
    per_class = class_rates(long, keys)
    f = per_class.groupBy(*keys).agg(
        F.sum("tp").alias("tp"), F.sum("fp").alias("fp"), F.sum("fn").alias("fn"), F.sum("tn").alias("tn"),
        F.avg("f1").alias("macro_f1"),
    )
    all_cells = F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")
    f = f.select(
        *keys,
        (2 * F.col("tp") / F.greatest(2 * F.col("tp") + F.col("fp") + F.col("fn"), F.lit(1))).alias("micro_f1"),
        "macro_f1",
        ((F.col("fp") + F.col("fn")) / all_cells).alias("hamming_loss"),
    )
    exact = (
        long.groupBy(*keys, *window)
        .agg(F.min((F.col("y") == F.col("pred")).cast("int")).alias("same"))
        .groupBy(*keys)
        .agg(F.avg("same").alias("subset_accuracy"))
    )
    return match_small(f, exact, keys) if keys else f.join(F.broadcast(exact))


def mean_average_precision(long: DataFrame, score: str = "p", buckets: int | None = None) -> DataFrame:
    """Mean over classes that show both values; 0 when there is none."""
    per = ranking_metrics(long, ["class_idx"], score, "y", buckets=buckets)
    return per.agg(F.coalesce(F.avg("average_precision"), F.lit(0.0)).alias("map"))


def present_class_f1(per_class: DataFrame, min_support: int = 1) -> DataFrame:
    """Macro F1 over classes with enough support; NULL when none has."""
    there = F.col("support") >= min_support
    return per_class.agg(
        F.avg(F.when(there, F.col("f1"))).alias("present_class_macro_f1"),
        F.count_if(there).alias("present_class_count"),
        F.count_if(~there).alias("absent_class_count"),
    )


def attribution_metrics(ranked: DataFrame, rank: str, malicious: str, ks: Sequence[int]) -> DataFrame:
    """Hit rate, precision, recall, F1 and analyst reduction at several K.

    ``rank`` starts at 1; all K are read off one pass of conditional sums.
    """
    bad = F.col(malicious)
    aggs = [F.count(F.lit(1)).alias("records"), F.count_if(bad).alias("bad")]
    for k in ks:
        inside = F.col(rank) <= k
        aggs += [F.count_if(inside).alias(f"n{k}"), F.count_if(inside & bad).alias(f"h{k}")]
    row = ranked.agg(*aggs)
    items = [
        F.struct(F.lit(k).alias("k"), F.col(f"n{k}").alias("n"), F.col(f"h{k}").alias("hits"), "records", "bad")
        for k in ks
    ]
    d = row.select(F.inline(F.array(*items)))
    p = F.col("hits") / F.greatest(F.col("n"), F.lit(1))
    r = F.col("hits") / F.greatest(F.col("bad"), F.lit(1))
    return d.select(
        "k",
        "hits",
        F.when(F.col("hits") > 0, 1.0).otherwise(0.0).alias("hit_rate"),
        p.alias("precision"),
        r.alias("recall"),
        (2 * p * r / F.greatest(p + r, F.lit(1e-12))).alias("f1"),
        (1 - F.col("n") / F.greatest(F.col("records"), F.lit(1))).alias("analyst_reduction"),
    )
