"""Score, decision and alert expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe.functions.text import lookup

# --- fixed values: hypothesis text by dominant source ---------------------------
HYPOTHESES = {
    "knn": "weak neighborhood consistency; possible new mission behavior, unseen relay path, or low-rate probing.",
    "proto": "large prototype distance; possible attack-family shift or mission-phase distribution drift.",
    "energy": "abnormal logit energy; possible high-rate burst, replay-like repetition, or dense anomalous block.",
    "conf": "low known-class confidence; possible ambiguous mixed window or unseen traffic subtype.",
}
HYPOTHESIS_DEFAULT = "unresolved unknown pattern requiring analyst review."


def hypothesis(source: Column) -> Column:
    return F.coalesce(lookup(HYPOTHESES, source), F.lit(HYPOTHESIS_DEFAULT))


def alert_level(margin: Column) -> Column:
    return (
        F.when(margin >= 1.0, "critical").when(margin >= 0.0, "warning").when(margin >= -0.25, "watch").otherwise("normal")
    )


def alert_reason(known: Column, ood: Column) -> Column:
    return (
        F.when(known & ood, "known_attack+ood").when(known, "known_attack").when(ood, "ood").otherwise("none")
    )


def window_partition(is_ood: Column, attack: Column) -> Column:
    return F.when(F.coalesce(is_ood, F.lit(False)), "ood").when(F.coalesce(attack, F.lit(False)), "attack").otherwise(
        "benign"
    )


def sigmoid(z: Column, temperature: float = 1.0) -> Column:
    t = max(float(temperature), 1e-6)
    return 1 / (1 + F.exp(-z / t))


def logit(p: Column, eps: float = 1e-6) -> Column:
    q = F.least(F.greatest(p, F.lit(eps)), F.lit(1 - eps))
    return F.ln(q / (1 - q))


def softplus(z: Column) -> Column:
    return F.greatest(z, F.lit(0.0)) + F.log1p(F.exp(-F.abs(z)))


def binary_uncertainty(probs: Column) -> dict[str, Column]:
    """Confidence gap, energy and top probability of a multi-label output."""
    top = F.array_max(probs)
    energy = -F.aggregate(
        F.transform(probs, lambda p: softplus(logit(p))), F.lit(0.0), lambda acc, x: acc + x
    )
    return {"max_prob": top, "conf": 1 - top, "energy": energy}


def logsumexp(values: Column) -> Column:
    top = F.array_max(values)
    return top + F.ln(F.aggregate(F.transform(values, lambda v: F.exp(v - top)), F.lit(0.0), lambda a, x: a + x))


def conf_score(probs: Column) -> Column:
    return 1 - F.array_max(probs)


def energy_score(logits: Column, temperature: float = 1.0) -> Column:
    t = float(temperature)
    return -t * logsumexp(F.transform(logits, lambda z: z / max(t, 1e-6)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def orient(score: Column, direction: float) -> Column:
    return score * float(direction)


def robust_normalize(score: Column, median: float, iqr: float) -> Column:
    return (score - float(median)) / max(float(iqr), 1e-6)


def fuse(
    normalized: Mapping[str, Column],
    weights: Mapping[str, float],
    votes: Mapping[str, float] | None = None,
) -> Column:
    """Weighted sum, or the share of scores above their own threshold when ``votes`` is given."""
    if votes is not None:
        hits = [(normalized[k] > float(votes[k])).cast("double") for k in normalized]
        return sum(hits[1:], hits[0]) / len(hits)
    terms = [normalized[k] * float(weights.get(k, 0.0)) for k in normalized]
    return sum(terms[1:], terms[0])


def dominant_source(normalized: Mapping[str, Column], names: Sequence[str]) -> Column:
    """Name of the largest score; the first name wins ties."""
    best = F.greatest(*[normalized[n] for n in names])
    out = F.lit(None).cast("string")
    for n in reversed(names):
        out = F.when(normalized[n] == best, F.lit(n)).otherwise(out)
    return out


# --- traffic phase features ------------------------------------------------------
def phase_features(
    packets_per_s: Column,
    bytes_per_s: Column,
    iat_mean: Column,
    duration: Column,
    packet_size: Column,
    fwd_packets: Column,
    bwd_packets: Column,
) -> dict[str, Column]:
    """Clipped, log-scaled flow features used for the phase proxy."""

    def pos(c: Column) -> Column:
        return F.greatest(F.coalesce(c, F.lit(0.0)), F.lit(0.0))

    total = pos(fwd_packets) + pos(bwd_packets)
    ratio = pos(fwd_packets) / F.greatest(total, F.lit(1e-6))
    balance = 1 - F.abs(ratio - 0.5) * 2
    return {
        "log_packets_s": F.log1p(pos(packets_per_s)),
        "log_bytes_s": F.log1p(pos(bytes_per_s)),
        "log_iat_mean": F.log1p(pos(iat_mean)),
        "log_duration": F.log1p(pos(duration)),
        "log_packet_size": F.log1p(pos(packet_size)),
        "log_total_packets": F.log1p(total),
        "direction_ratio": F.least(F.greatest(ratio, F.lit(0.0)), F.lit(1.0)),
        "direction_balance": F.least(F.greatest(balance, F.lit(0.0)), F.lit(1.0)),
    }
