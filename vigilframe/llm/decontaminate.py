"""Benchmark decontamination by a prefix-filtered set join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import materialize
from vigilframe.llm.common import lower_ascii, small_side, split_words

NOT_IN_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
WINDOW_WORDS = 10
GRAM_WORDS = 4


def _words(text: Column) -> Column:
    return split_words(lower_ascii(text), NOT_IN_WORDS)


def _grams(hashes: Column, size: int) -> Column:
    """Hash of each run of ``size`` words, at the place of its first word."""
    n = F.size(hashes)
    runs = F.transform(
        hashes, lambda h, i: F.xxhash64(F.lit(size), h, *[F.get(hashes, i + k) for k in range(1, size)])
    )
    return F.when(n >= size, F.slice(runs, 1, n - size + 1)).otherwise(F.array().cast("array<bigint>"))


def item_windows(items: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW_WORDS) -> DataFrame:
    """(item, wid, words, len): every window of an item; an item with fewer words is one window, one without has none."""
    words = items.select(F.col(item_id).cast("string").alias("item"), _words(F.col(text)).alias("all"))
    size = F.least(F.size("all"), F.lit(window))
    starts = F.sequence(F.lit(1), F.size("all") - size + 1)
    cut = words.where(F.size("all") > 0).select("item", "all", size.alias("len"), F.explode_outer(starts).alias("s"))
    cut = cut.select("item", "len", F.slice("all", F.col("s"), F.col("len")).alias("words"))
    return cut.withColumn("wid", F.md5(F.concat_ws(" ", "words"))).distinct()


def contamination(
    docs: DataFrame,
    items: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    window: int = WINDOW_WORDS,
    gram: int = GRAM_WORDS,
) -> DataFrame:
    """Words of documents that lie in windows of benchmark items.

    A window is a set of word shingles that a document must hold completely, so its prefix is one shingle: the one
    rarest in the corpus. Documents join on that shingle; its offset in the window gives the place where the window
    must start (positional bound) and the place must leave room for all of it (length bound). A place counts after
    every shingle of the window was found there in order.

    One pass over the texts keeps the shingles that any window has, with their places; counting, joining and checking
    read only those. The benchmark's shingles are broadcast if they were counted to be few, else joined by shuffle.

    Returns doc_id, n_words, n_hit, n_items, items_sha256, contaminated, one row per different (doc_id, text).
    Null and empty texts, and all texts with an empty benchmark, have no hits. Repeated rows come once. Columns of
    ``docs`` other than the two named ones are not read.
    """
    cut = materialize(item_windows(items, window=window), "windows")
    windows = cut.select("wid", "len", "words").distinct()
    window_items = cut.select("wid", "item").distinct()
    sizes = sorted(r[0] for r in cut.select(F.least("len", F.lit(gram)).alias("g")).distinct().collect()) or [gram]

    def tokens(size: int) -> DataFrame:
        mine = windows.where(F.least("len", F.lit(gram)) == size)
        hashed = mine.select("wid", "len", F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
        return hashed.select("wid", "len", F.posexplode_outer(_grams(F.col("h"), size)).alias("off", "tok")).where("tok is not null")

    parts = tokens(sizes[0])
    for size in sizes[1:]:
        parts = parts.unionByName(tokens(size))
    parts = materialize(parts, "shingles")
    wanted = materialize(parts.select("tok").distinct().withColumn("known", F.lit(True)), "wanted")

    base = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("th"), _words(F.col(text)).alias("w"))
    base = base.select("doc_id", "th", F.size("w").cast("long").alias("n_words"), F.transform("w", lambda w: F.xxhash64(w)).alias("h"))
    found = None
    for i, size in enumerate(sizes):
        places = base.select("doc_id", "th", "n_words", F.posexplode_outer(_grams(F.col("h"), size)).alias("pos", "tok"))
        places = places.join(small_side(wanted), "tok", "left")
        keep = F.col("known") if i else F.col("known") | F.col("pos").isNull() | (F.col("pos") == 0)
        places = places.where(F.coalesce(keep, F.lit(False)))
        found = places if found is None else found.unionByName(places)
    found = materialize(found, "hits")
    all_docs = found.select("doc_id", "th", "n_words").distinct()
    hits = found.where("known").select("doc_id", "th", "n_words", "pos", "tok")

    counts = hits.groupBy("tok").agg(F.count("*").alias("freq"))
    rarest = Window.partitionBy("wid").orderBy("freq", "tok", "off")
    prefix = (
        parts.join(counts, "tok", "left")
        .select("wid", "len", "off", "tok", F.coalesce("freq", F.lit(0)).alias("freq"))
        .withColumn("r", F.row_number().over(rarest))
        .where("r = 1 and freq > 0")
        .select("wid", "len", "off", "tok")
    )
    starts = (
        hits.join(prefix, "tok")
        .select("doc_id", "th", "n_words", "wid", "len", (F.col("pos") - F.col("off")).alias("start"))
        .where("start >= 0 and start + len <= n_words")
        .select("doc_id", "th", "wid", "len", "start")
        .distinct()
    )
    due = starts.join(parts.select("wid", "off", "tok"), "wid").withColumn("pos", F.col("start") + F.col("off"))
    same_doc = F.col("a.doc_id").eqNullSafe(F.col("b.doc_id")) & (F.col("a.th") == F.col("b.th"))
    checked = (
        due.alias("a")
        .join(hits.alias("b"), same_doc & (F.col("a.pos") == F.col("b.pos")) & (F.col("a.tok") == F.col("b.tok")))
        .groupBy("a.doc_id", "a.th", "a.wid", "a.len", "a.start")
        .agg(F.count_distinct("a.off").alias("n"))
        .where(F.col("n") == F.col("len") - F.least("len", F.lit(gram)) + 1)
        .select("doc_id", "th", "wid", "start", (F.col("start") + F.col("len")).alias("end"))
    )
    checked = materialize(checked, "places")

    order = Window.partitionBy("doc_id", "th").orderBy("start", "end")
    seen = F.coalesce(F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spans = checked.select("doc_id", "th", "start", "end").distinct()
    covered = (
        spans.withColumn("new", F.greatest(F.col("end") - F.greatest("start", seen), F.lit(0)))
        .groupBy("doc_id", "th")
        .agg(F.sum("new").cast("long").alias("n_hit"))
    )
    named = (
        checked.select("doc_id", "th", "wid")
        .distinct()
        .join(window_items, "wid")
        .groupBy("doc_id", "th")
        .agg(F.array_sort(F.collect_set("item")).alias("item_ids"))
    )
    found_in = covered.alias("c").join(
        named.alias("i"), F.col("c.doc_id").eqNullSafe(F.col("i.doc_id")) & (F.col("c.th") == F.col("i.th"))
    ).select("c.doc_id", "c.th", "n_hit", "item_ids")
    out = all_docs.alias("d").join(
        found_in.alias("f"), F.col("d.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("d.th") == F.col("f.th")), "left"
    )
    ids = F.coalesce("item_ids", F.array().cast("array<string>"))
    return out.select(
        "d.doc_id",
        F.col("d.th").alias("text_hash"),
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", ids), 256).alias("items_sha256"),
        F.col("n_hit").isNotNull().alias("contaminated"),
    )
