"""Token, label, group and number expressions."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from vigilframe.functions import fixed

HEX_PATTERN = "^0[xX][0-9a-fA-F]+$"


def normalize_token(value: Column) -> Column:
    """Lower-case token with ``&`` spelled out; NULL-like cells become ``unknown``."""
    text = F.lower(F.trim(value.cast("string")))
    joined = F.regexp_replace(F.regexp_replace(text, "&", " and "), "[^a-z0-9]+", "_")
    token = F.regexp_replace(joined, "^_+|_+$", "")
    missing = value.isNull() | text.isin("", "nan", "none", "null") | (token == "")
    return F.when(missing, F.lit("unknown")).otherwise(token)


def raw_label(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when(text.isNull() | (text == ""), F.lit("unknown")).otherwise(text)


def column_key(name: str) -> str:
    return "".join(ch for ch in str(name).strip().lower() if ch.isascii() and ch.isalnum())


def lookup(mapping: dict[str, str], key: Column) -> Column:
    pairs = F.create_map(*[F.lit(x) for x in chain.from_iterable(mapping.items())])
    return F.try_element_at(pairs, key)


def map_label(value: Column, source: str) -> Column:
    """Label map of one source with its fallback spelling."""
    table = fixed.LABEL_MAPS[source]
    if source in fixed.RAW_LABEL_MAPS:
        raw = F.trim(value.cast("string"))
        return F.coalesce(lookup(table, raw), F.lower(F.translate(raw, " -", "__")))
    token = normalize_token(value)
    return F.coalesce(lookup(table, token), token)


def adapter_label(value: Column) -> Column:
    text = F.lower(F.translate(F.trim(value.cast("string")), " -", "__"))
    return F.when(value.isNull() | text.isin(fixed.BENIGN_ALIASES), F.lit("benign")).otherwise(text)


def group_id(value: Column) -> Column:
    text = F.trim(value.cast("string"))
    return F.when((text != "") & (F.lower(text) != "nan"), text)


def split_name(value: Column) -> Column:
    token = normalize_token(value)
    return F.when(token == "unknown", F.lit("all")).otherwise(
        F.coalesce(lookup(fixed.SPLIT_ALIASES, token), token)
    )


def coerce_number(value: Column) -> Column:
    """Number from a mixed text cell, including ``0x`` hexadecimals."""
    text = F.trim(value.cast("string"))
    return F.when(
        text.rlike(HEX_PATTERN), F.conv(F.substring(text, 3, 64), 16, 10).cast("double")
    ).otherwise(text.try_cast("double"))


def finite(value: Column) -> Column:
    """NULL for NaN, infinities and cells that are not numbers."""
    v = value.try_cast("double")
    return F.when(F.isnan(v) | (F.abs(v) == F.lit(float("inf"))), F.lit(None)).otherwise(v)


def comma_list(value: Column) -> Column:
    parts = F.transform(F.split(value, ","), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def attack_tokens(value: Column) -> Column:
    """Distinct lower-case attack names of a ``a+b`` or ``a,b`` cell, without benign."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), "[+,]"), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: (x != "") & (x != "benign")))


def collapse_attacks(items: Column) -> Column:
    kept = F.array_distinct(F.filter(F.transform(items, lambda x: F.trim(x)), lambda x: (x != "") & (x != "benign")))
    return F.when(F.coalesce(F.size(kept), F.lit(0)) <= 0, F.lit("benign")).otherwise(F.array_join(kept, "+"))


def label_list(value: Column, sep: str = ",") -> Column:
    """Labels held by one cell."""
    return comma_list(F.regexp_replace(value.cast("string"), f"[{sep}]", ","))


def is_ood_record(labels: Column, id_classes: list[str]) -> Column:
    known = F.array(*[F.lit(c) for c in id_classes])
    return F.exists(labels, lambda x: ~F.array_contains(known, x))


def direction_flag(value: Column) -> Column:
    text = F.lower(value.cast("string"))
    hit = F.lit(False)
    for marker in fixed.DIRECTION_MARKERS:
        hit = hit | text.contains(marker)
    return F.coalesce(hit, F.lit(False)).cast("int")


def synthesize_record_id(group: Column, seconds: Column, n: Column) -> Column:
    return F.concat_ws(":", F.coalesce(group, F.lit("stream")), F.format_string("%.6f", seconds), n.cast("string"))


def attack_label(active: Column, attack_type: Column) -> Column:
    kind = F.when((attack_type.isNull()) | (attack_type == ""), F.lit("benign")).otherwise(attack_type)
    return F.when(~F.coalesce(active, F.lit(False)), F.lit("benign")).otherwise(
        F.coalesce(lookup(fixed.ATTACK_LABEL_ALIASES, kind), kind)
    )


def row_fingerprint(*cols: str) -> Column:
    """64-bit row hash for debugging; never used as a key."""
    return F.xxhash64(*cols)


def loose_number(text: Column) -> Column:
    """First number of a report cell such as ``"0.5 ± 0.1"``."""
    return F.nullif(
        F.regexp_extract(text.cast("string"), r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?", 0), F.lit("")
    ).try_cast("double")


def loose_bool(text: Column) -> Column:
    t = F.lower(F.trim(text.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y"), F.lit(True)).when(t.isin("false", "0", "no", "n"), F.lit(False))


def pick_json(doc: Column, paths: list[str]) -> Column:
    return F.coalesce(*[F.get_json_object(doc, p) for p in paths])


def format_mean_std(mean: Column, std: Column) -> Column:
    return F.when(mean.isNotNull(), F.format_string("%.4f ± %.4f", mean, F.coalesce(std, F.lit(0.0))))
