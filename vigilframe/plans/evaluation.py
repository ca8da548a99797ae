"""Fit, calibrate and evaluate a window model end to end."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import materialize
from vigilframe.functions.fixed import SCORE_NAMES
from vigilframe.operators import calibrate as K
from vigilframe.operators import metrics as E
from vigilframe.operators import scoring as G
from vigilframe.operators.ordering import match_keys


def multi_hot(label: Column, classes: Sequence) -> Column:
    return F.transform(F.array(*[F.lit(c) for c in classes]), lambda c: (c == label).cast("int"))


def evaluate_prototype_model(
    windows: DataFrame,
    ident: str,
    group: str,
    vector: str,
    label: str,
    truth_ood: str,
    part: str,
    classes: Sequence,
    fusion: str = "mean",
    q: float = 0.95,
    precision: bool = False,
    scale: float = 4.0,
) -> dict[str, DataFrame]:
    """Prototype fit on train, calibration on validation, metrics on test.

    ``part`` holds train, val or test. Rows out of distribution never reach the fit or a
    threshold.
    """
    train = windows.where((F.col(part) == "train") & ~F.col(truth_ood))
    model = G.fit_prototypes(train, vector, F.array(label), classes, precision, scale)
    ids = [ident, group, label, truth_ood, part]
    scored = materialize(G.raw_scores(windows, ids, vector, model, train.select(vector), vector), "scores")
    val = scored.where((F.col(part) == "val") & ~F.col(truth_ood))
    pseudo, _ = K.pseudo_ood(val.withColumn("y", multi_hot(F.col(label), classes)), "y", [str(c) for c in classes])
    directions = {r["score_name"]: r["direction"] for r in K.score_directions(pseudo, "pseudo_ood").collect()}
    cal = K.fit_calibration(val, fusion, q, directions)
    test = K.apply_calibration(scored.where(F.col(part) == "test"), cal)
    decided = test.withColumn("is_ood", F.col("fused") > float(cal.threshold))
    whole = E.ranking_metrics(decided, [], "fused", truth_ood).join(
        F.broadcast(E.decision_metrics(decided, [], F.col("is_ood"), F.col(truth_ood)))
    )
    per_group = match_keys(
        E.decision_metrics(decided, [group], F.col("is_ood"), F.col(truth_ood)),
        E.ranking_metrics(decided, [group], "fused", truth_ood),
        [group],
    )
    return {"decisions": decided.select(*ids, *SCORE_NAMES, "fused", "is_ood", "dominant_source"), "global": whole, "groups": per_group}
