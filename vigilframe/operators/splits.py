"""Splits, quotas, balancing and seeded ordering."""

from __future__ import annotations

from collections.abc import Sequence
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.operators.ordering import match_keys, match_small, order_hash, position, running_sums, settle


def exact_share(share: float) -> Column:
    """A share as the decimal it is written as, so that a share of a count lies on neither side of its true value."""
    return F.lit(Decimal(repr(share)))


def interleave(
    df: DataFrame, label: str, record_id: str, chunk: int, seed: int, keys: Sequence[str] = (), name: str = "seq"
) -> DataFrame:
    """Per-label shuffled queues visited in shuffled rounds of ``chunk`` rows per label."""
    queued = position(
        df.withColumn("__h", order_hash(seed, record_id)), [*keys, label], ["__h", record_id], "__r"
    )
    rounds = queued.withColumn("__round", F.floor(F.col("__r") / chunk).cast("long"))
    rounds = rounds.withColumn("__lab", order_hash(seed, F.col("__round"), F.col(label)))
    rounds = settle(rounds, bool(keys))
    return position(rounds, keys, ["__round", "__lab", "__r"], name).drop("__h", "__r", "__round", "__lab")


def stratified_cuts(counts: DataFrame, label: str, n: str = "n", train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Train and validation sizes per label, each part at least one row."""
    total = F.col(n)
    t0 = F.greatest(F.lit(1), F.bround(total * exact_share(train))).cast("long")
    v0 = F.greatest(F.lit(1), F.bround(total * exact_share(val))).cast("long")
    sized = counts.select(label, total.alias("n"), t0.alias("t0"), v0.alias("v0"))
    short = F.greatest(F.lit(0), 1 - (F.col("n") - F.col("t0") - F.col("v0")))
    # repair one row at a time; at most two rows can be missing
    step = sized.withColumn("short", short)
    for _ in range(2):
        from_train = (F.col("t0") >= F.col("v0")) & (F.col("t0") > 1)
        from_val = ~from_train & (F.col("v0") > 1)
        step = step.withColumns(
            {
                "t0": F.col("t0") - ((F.col("short") > 0) & from_train).cast("long"),
                "v0": F.col("v0") - ((F.col("short") > 0) & from_val).cast("long"),
                "short": F.greatest(F.lit(0), F.col("short") - 1),
            }
        )
    return step.select(
        label, "n", F.col("t0").alias("n_train"), F.col("v0").alias("n_val"),
        (F.col("n") - F.col("t0") - F.col("v0")).alias("n_test"),
    )


def stratified_split(df: DataFrame, label: str, record_id: str, seed: int) -> DataFrame:
    cuts = stratified_cuts(df.groupBy(label).agg(F.count(F.lit(1)).alias("n")), label)
    bad = [r[label] for r in cuts.where((F.col("n_train") < 1) | (F.col("n_val") < 1) | (F.col("n_test") < 1))
           .select(label).limit(5).collect()]
    if bad:
        raise ValueError(f"labels too small for a three-way split: {bad}")
    placed = position(df.withColumn("__h", order_hash(seed, record_id)), [label], ["__h", record_id], "__p")
    joined = match_small(placed, cuts, [label])
    split = (
        F.when(F.col("__p") < F.col("n_train"), "train")
        .when(F.col("__p") < F.col("n_train") + F.col("n_val"), "val")
        .otherwise("test")
    )
    return joined.withColumn("split", split).drop("__h", "__p", "n", "n_train", "n_val", "n_test")


def global_ratio_cuts(counts: DataFrame, label: str, total: int, train: float = 0.70, val: float = 0.15) -> DataFrame:
    """Exact overall sizes, shared out over labels by largest remainder."""
    n_train, n_val = (max(1, int(total * Decimal(repr(share)))) for share in (train, val))
    if total - n_train - n_val < 1:
        raise ValueError("too few rows for the requested split ratios")
    first = quotas(counts, label, "n", n_train, 0).withColumnRenamed("quota", "n_train")
    rest = first.withColumn("left", F.col("n") - F.col("n_train"))
    second = quotas(rest.select(label, "left"), label, "left", n_val, 0).withColumnRenamed("quota", "n_val")
    out = match_keys(first, second, [label])
    return out.select(label, "n", "n_train", "n_val", (F.col("n") - F.col("n_train") - F.col("n_val")).alias("n_test"))


def chronological_split(
    df: DataFrame,
    is_ood: Column,
    order: Sequence[str],
    train: float = 0.70,
    val: float = 0.15,
    group: str | None = None,
    buckets: int | None = None,
) -> DataFrame:
    """Ordered split of the in-distribution rows; the others become ``test_ood``."""
    flagged = df.withColumn("__ood", is_ood)
    keys = ["__ood"] if group is None else ["__ood", group]
    placed = position(flagged, keys, order, "__p", size_name="__n", buckets=buckets)
    n = F.col("__n")
    n_train = F.greatest(F.lit(1), F.floor(n * exact_share(train)))
    n_val0 = F.greatest(F.lit(1), F.floor(n * exact_share(val)))
    v_avail = F.least(n_val0, F.greatest(n - n_train, F.lit(0)))
    empty_test = (n - n_train - n_val0) <= 0
    n_val = F.when(empty_test & (v_avail > 1), F.floor(v_avail / 2)).otherwise(v_avail)
    split = (
        F.when(F.col("__ood"), "test_ood")
        .when(F.col("__p") < n_train, "train")
        .when(F.col("__p") < n_train + n_val, "val")
        .otherwise("test_id")
    )
    return placed.withColumn("split", split).drop("__ood", "__p", "__n")


def check_explicit_split(df: DataFrame, split: str, is_ood: Column) -> DataFrame:
    """One validation row for a given split column in strict mode."""
    s = F.col(split)
    names = ["train", "val", "test_id", "test_ood"]
    return df.agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(s.isNull() | (F.trim(s) == "")).alias("blank"),
        F.count_if(s.isNotNull() & (F.trim(s) != "") & ~s.isin(names)).alias("unknown_name"),
        F.count_if(is_ood & s.isin("train", "val", "test_id")).alias("ood_in_id_split"),
        F.count_if(~is_ood & (s == "test_ood")).alias("id_in_ood_split"),
    ).withColumn(
        "valid",
        F.col("blank") + F.col("unknown_name") + F.col("ood_in_id_split") + F.col("id_in_ood_split") == 0,
    )


def quotas(counts: DataFrame, label: str, n: str, target: int, floor: int) -> DataFrame:
    """Largest-remainder allocation of ``target`` rows over labels with a floor.

    Runs on the label counts, one row per label.
    """
    whole = Window.partitionBy(F.lit(0))
    c = F.col(n)
    d = counts.withColumn("__total", F.sum(c).over(whole))
    d = d.withColumn("__cap", F.least(F.lit(target).cast("long"), F.col("__total")))
    d = d.withColumn("__floor", F.least(c, F.lit(floor).cast("long")))
    d = d.withColumn("__base", F.when(F.sum("__floor").over(whole) <= F.col("__cap"), F.col("__floor")).otherwise(0))
    d = d.withColumn("__left", F.col("__cap") - F.sum("__base").over(whole))
    d = d.withColumn("__head", c - F.col("__base"))
    d = d.withColumn("__heads", F.sum("__head").over(whole))
    exact = F.when(F.col("__heads") > 0, F.col("__left") * F.col("__head") / F.col("__heads")).otherwise(0.0)
    d = d.withColumn("__exact", exact)
    d = d.withColumn("__whole", F.floor("__exact").cast("long"))
    d = d.withColumn("__rest", F.col("__left") - F.sum("__whole").over(whole))
    turn = F.row_number().over(whole.orderBy((F.col("__exact") - F.col("__whole")).desc(), F.col(label).asc()))
    d = d.withColumn("quota", F.col("__base") + F.col("__whole") + (turn <= F.col("__rest")).cast("long"))
    return d.select(label, F.col(n), F.least(F.col("quota"), c).cast("long").alias("quota"))


def rebalance(alloc: DataFrame, label: str, available: str, wanted: str) -> DataFrame:
    """Move the shortfall of short labels to the surplus of the others."""
    whole = Window.partitionBy(F.lit(0))
    a, w = F.col(available), F.col(wanted)
    d = alloc.withColumns({"__take": F.least(a, w), "__surplus": F.greatest(a - w, F.lit(0))})
    d = d.withColumn("__short", F.sum(F.greatest(w - a, F.lit(0))).over(whole))
    d = d.withColumn("__pool", F.sum("__surplus").over(whole))
    d = d.withColumn("__move", F.least(F.col("__short"), F.col("__pool")))
    exact = F.when(F.col("__pool") > 0, F.col("__move") * F.col("__surplus") / F.col("__pool")).otherwise(0.0)
    d = d.withColumn("__exact", exact).withColumn("__whole", F.floor("__exact").cast("long"))
    d = d.withColumn("__rest", F.col("__move") - F.sum("__whole").over(whole))
    turn = F.row_number().over(whole.orderBy((F.col("__exact") - F.col("__whole")).desc(), F.col(label).asc()))
    final = F.col("__take") + F.col("__whole") + (turn <= F.col("__rest")).cast("long")
    return d.select(label, a, w, final.cast("long").alias("final"))


def take_quota(df: DataFrame, alloc: DataFrame, label: str, quota: str, record_id: str, seed: int) -> DataFrame:
    """Seeded down-sampling to the quota of each label."""
    placed = position(df.withColumn("__h", order_hash(seed, record_id)), [label], ["__h", record_id], "__p")
    limits = alloc.select(label, F.col(quota).alias("__q"))
    return match_small(placed, limits, [label], "inner").where(F.col("__p") < F.col("__q")).drop("__h", "__p", "__q")


def oversample_target(final: Column, raw: Column, factor: float) -> Column:
    return F.least(raw, F.greatest(final, F.ceil(final * factor))).cast("long")


def assign_groups(
    df: DataFrame,
    split: str,
    order: Sequence[str],
    groups: int,
    mode: str = "round_robin",
    label: str | None = None,
    prefix: str = "uav_",
    name: str = "uav_id",
    buckets: int | None = None,
) -> DataFrame:
    """Synthetic group per row and split: round robin, block, or stratified round robin."""
    placed = position(df, [split], order, "__i", size_name="__n", buckets=buckets)
    if mode == "round_robin":
        index = F.col("__i") % groups
    elif mode == "block":
        small = F.floor(F.col("__n") / groups)
        extra = F.col("__n") % groups
        border = extra * (small + 1)
        index = F.when(F.col("__i") < border, F.floor(F.col("__i") / (small + 1))).otherwise(
            extra + F.floor((F.col("__i") - border) / F.greatest(small, F.lit(1)))
        )
    elif mode == "stratified":
        placed = settle(placed, True, buckets)
        sizes = placed.groupBy(split, label).agg(F.count(F.lit(1)).alias("__c"), F.min("__i").alias("__seen"))
        starts = running_sums(sizes, [split], ["__seen"], {"__upto": "__c"}, buckets=1).select(
            split, label, (F.col("__upto") - F.col("__c")).alias("__off")
        )
        placed = match_small(placed, starts, [split, label])
        placed = position(placed, [split, label], order, "__k", buckets=buckets)
        index = (F.col("__k") + F.col("__off")) % groups
    else:
        raise ValueError(f"unknown assignment mode: {mode}")
    named = F.concat(F.lit(prefix), F.lpad(index.cast("long").cast("string"), 2, "0"))
    return placed.withColumn(name, named).drop("__i", "__n", "__k", "__off")


def balance_targets(counts: DataFrame, label: str, n: str, mode: str, value: float = 0.5, min_real: int = 1) -> DataFrame:
    """Target size from the label counts and the copies each label still needs."""
    if mode == "median":
        target = F.percentile(F.col(n), 0.5)
    elif mode == "quantile":
        target = F.percentile(F.col(n), value)
    elif mode == "max":
        target = F.max(n).cast("double")
    elif mode == "fixed":
        target = F.max(F.lit(float(value)))
    else:
        raise ValueError(f"unknown balance mode: {mode}")
    goal = counts.agg(F.floor(target).cast("long").alias("target"))
    eligible = (F.col(n) >= min_real) & (F.col(n) < F.col("target"))
    return counts.join(F.broadcast(goal)).select(
        label, F.col(n), "target", F.when(eligible, F.col("target") - F.col(n)).otherwise(0).cast("long").alias("copies")
    )


def resample(df: DataFrame, needs: DataFrame, label: str, record_id: str, seed: int, n: str = "n") -> DataFrame:
    """Real rows plus seeded copies; copy j of a label is row ``j mod n`` of its shuffled queue.

    A row at queue position p is copied once for every j = p, p+n, p+2n, ... below the need.
    """
    placed = position(df.withColumn("__h", order_hash(seed, record_id)), [label], ["__h", record_id], "__p")
    joined = match_small(placed, needs.select(label, F.col(n).alias("__n"), F.col("copies").alias("__c")), [label])
    real = df.withColumns({"row_origin": F.lit("real"), "copy_no": F.lit(0).cast("long")})
    made = (
        joined.where(F.col("__c") > F.col("__p"))
        .withColumn("copy_no", F.explode(F.sequence(F.col("__p"), F.col("__c") - 1, F.col("__n"))))
        .withColumn("copy_no", F.col("copy_no") + 1)
        .withColumn("row_origin", F.lit("resampled"))
        .drop("__h", "__p", "__n", "__c")
    )
    return real.unionByName(made)


def leave_one_class_out(df: DataFrame, label: str, classes: Sequence[str]) -> DataFrame:
    """Every fold in one table: the held-out class becomes the OOD part."""
    folds = df.withColumn("held_out", F.explode(F.array(*[F.lit(c) for c in classes])))
    return folds.withColumn("part", F.when(F.col(label) == F.col("held_out"), "test_ood").otherwise("id"))


def family_holdout(df: DataFrame, label: str, family: Column, held_out: Sequence[str]) -> DataFrame:
    return df.withColumn("family", family).withColumn(
        "part", F.when(F.col("family").isin(list(held_out)), "test_ood").otherwise("id")
    )


def cross_group(df: DataFrame, group: str, pairs: Sequence[tuple[object, object]]) -> DataFrame:
    """Train on one group, test on another; all pairs in one table."""
    table = F.array(*[F.struct(F.lit(a).alias("train_group"), F.lit(b).alias("test_group")) for a, b in pairs])
    out = df.withColumn("__p", F.explode(table)).select("*", "__p.train_group", "__p.test_group").drop("__p")
    part = F.when(F.col(group) == F.col("train_group"), "train").when(F.col(group) == F.col("test_group"), "test")
    return out.withColumn("part", part).where(F.col("part").isNotNull())
