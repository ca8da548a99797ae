"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard checks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import TEXT_BATCH_BYTES, materialize
from vigilframe.llm.common import connected_components, may_match, small_side
from vigilframe.llm.words import WordHashes

# 16 bands of 3 coordinates: a pair at a similarity of 0.8 shares no band with a chance of (1 - 0.8^3)^16 = 1e-5.
BANDS = 16
ROWS = 3
# The permuted domain: shingles are hashed into 62 bits, their places in it.
DOMAIN = 1 << 62
SHIFT = 0x1E3779B97F4A7C15 % DOMAIN
PERCENT = 80
# Shingles permuted at once; a document is never cut.
BLOCK = 1 << 16
# Pairs of one document that one task compares.
PAIRS_PER_PART = 200
# In buckets of up to this many nodes all pairs are compared.
SMALL_BUCKET = 8
# Above this, members of a bucket are tried on each other before the exact join, whose pairs grow with the square of a bucket.
LARGE_BUCKET = 64


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers, in place."""
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def shingle_places(words: np.ndarray, size: int) -> np.ndarray:
    """Sorted distinct places, in the domain, of the runs of ``size`` words; fewer words are one run."""
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    length = min(n, size)
    run = np.full(n - length + 1, length, np.uint64)
    for k in range(length):
        run = run * np.uint64(0x9E3779B97F4A7C15) + words[k : n - length + 1 + k]
    return np.unique(_mix(run) & np.uint64(DOMAIN - 1))


def circulant_minima(places: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """A row of coordinates for each of the sets that begin at ``starts``.

    Two permutations: a shingle's hash is its place (the first), and coordinate k is the smallest value that the second
    one gives to the set's places shifted k steps around the domain.
    """
    out = np.empty((len(starts), BANDS * ROWS), np.uint64)
    for k in range(BANDS * ROWS):
        moved = (places + np.uint64(SHIFT * k % DOMAIN)) & np.uint64(DOMAIN - 1)
        out[:, k] = np.minimum.reduceat(_mix(moved), starts)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[tuple[list, list, list[np.ndarray]]]:
    """(ids, digests, sets) of documents, with some BLOCK shingles at a time."""
    hashes = WordHashes()
    ids, digests, sets, total = [], [], [], 0
    for batch in batches:
        for i, digest, text in zip(*(batch.column(c) for c in range(3))):
            text = text.as_buffer()
            s = shingle_places(hashes.of((bytes(text) if text else b"").lower().split()), size)
            ids.append(i.as_py())
            digests.append(digest.as_py())
            sets.append(s)
            total += len(s)
            if total >= BLOCK:
                yield ids, digests, sets
                ids, digests, sets, total = [], [], [], 0
        batch = i = digest = text = None  # free before the next batch is read
    if ids:
        yield ids, digests, sets


def signatures(docs: DataFrame, doc_id: str, text: str, size: int) -> DataFrame:
    """(doc_id, digest, n_shingles, bands): a hash of each band's coordinates."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, digests, sets in _blocks(batches, size):
            lengths = np.array([len(s) for s in sets])
            some = lengths > 0
            bands = np.zeros((len(ids), BANDS), np.uint64)
            if some.any():
                starts = np.concatenate([[0], np.cumsum(lengths[some])[:-1]])
                minima = circulant_minima(np.concatenate(sets), starts)
                band = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), (len(minima), BANDS)).copy()
                for r in range(ROWS):
                    band = _mix(band * np.uint64(0x9E3779B97F4A7C15) + minima[:, r::ROWS])
                bands[some] = band
            flat = pa.FixedSizeListArray.from_arrays(pa.array(bands.view(np.int64).ravel()), BANDS)
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(digests, pa.string()), pa.array(lengths, pa.int64()), flat.cast(pa.list_(pa.int64()))],
                ["doc_id", "digest", "n_shingles", "bands"],
            )

    base = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.md5(F.col(text)).alias("digest"), F.col(text).cast("binary").alias("t"))
    return base.mapInArrow(sign, "doc_id long, digest string, n_shingles long, bands array<long>")


def shingle_sets(texts: DataFrame, size: int) -> DataFrame:
    """(node, digest, k, s): the full set of each text, from (node, digest, k, t) rows."""

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, others, sets in _blocks(batches, size):
            offsets = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
            values = pa.array(np.concatenate(sets).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([o["digest"] for o in others], pa.string()), pa.array([o["k"] for o in others], pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), values)],
                ["node", "digest", "k", "s"],
            )

    base = texts.select(F.col("node").cast("long").alias("node"), F.struct("digest", "k").alias("o"), F.col("t").cast("binary").alias("t"))
    return base.mapInArrow(collect, "node long, digest string, k long, s array<long>")


def _linked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of the pairs (a, b) whose full sets are similar enough. A ``b`` of many pairs is joined in parts.

    Sets that stand on no such side of a pair are dropped where they lie: only the others are moved.
    """
    pairs = materialize(pairs.select("a", "b"), "pairs")
    asked = lambda side: may_match(sets, F.col("node"), pairs, F.col(side)).where("__may")
    counts = pairs.groupBy("b").agg(F.ceil(F.count("*") / PAIRS_PER_PART).cast("int").alias("parts")).where("parts > 1")
    counts = materialize(counts, "parts")
    dealt = pairs.join(small_side(counts), "b", "left").select("a", "b", F.pmod(F.xxhash64("a"), F.coalesce("parts", F.lit(1))).alias("part"))
    left = asked("a").select(F.col("node").alias("a"), F.col("s").alias("sa"))
    right = asked("b").select(F.col("node").alias("b"), F.col("s").alias("sb")).join(small_side(counts), "b", "left")
    right = right.withColumn("part", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1))).drop("parts")
    both = F.size(F.array_intersect("sa", "sb"))
    joined = dealt.join(left, "a").join(right, ["b", "part"])
    return joined.where(100 * both >= PERCENT * (F.size("sa") + F.size("sb") - both)).select("a", "b").distinct()


def _can_reach(a: str, b: str) -> Column:
    """Whether sets of ``a`` and ``b`` shingles can be similar enough."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def prefix_pairs(rows: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that can reach the similarity, from (node, digest, component, s) rows.

    Each set is ordered by rarity among the rows. Similar sets share one of their first 20 % of shingles, and the first
    shared one leaves room for the overlap that the similarity needs (positional bound); sizes must be near too. A text
    whose own changes fill its prefix meets nobody, however large the group around it is.
    """
    rows = rows if "digest" in rows.columns else rows.withColumn("digest", F.lit(""))
    rows = rows.select("node", "digest", "component", F.size("s").alias("n"), "s")
    single = rows.select("node", "digest", "component", "n", F.explode_outer("s").alias("x"))
    counts = single.groupBy("x").agg(F.count("*").alias("df"))
    ordered = single.join(counts, "x").groupBy("node", "digest", "component", "n").agg(F.array_sort(F.collect_list(F.struct("df", "x"))).alias("o"))
    first = F.col("n") - F.ceil(F.col("n") * PERCENT / 100) + 1
    prefix = ordered.select("node", "component", "n", F.posexplode_outer(F.slice("o", 1, first.cast("int"))).alias("at", "t"))
    prefix = materialize(prefix.where("t.df > 1").select("node", "component", "n", "at", F.col("t.x").alias("x")), "prefix")
    a, b = prefix.alias("a"), prefix.alias("b")
    most = F.least(F.col("a.n") - F.col("a.at"), F.col("b.n") - F.col("b.at"))
    near = (
        (F.col("a.x") == F.col("b.x"))
        & (F.col("a.node") < F.col("b.node"))
        & (F.col("a.component") != F.col("b.component"))
        & _can_reach("a.n", "b.n")
        & ((100 + PERCENT) * most >= PERCENT * (F.col("a.n") + F.col("b.n")))
    )
    return a.join(b, near).select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", size: int = 4) -> DataFrame:
    """Group documents whose sets of ``size``-word shingles have a Jaccard similarity of 0.8 or more.

    1. Equal texts become one node, the smallest doc_id, so copies cost a row and no comparison.
    2. Nodes that share a band meet in a bucket. In a bucket of more than ``SMALL_BUCKET`` nodes every node is compared
       with the smallest one only, so a bucket of n costs n comparisons. Links are confirmed on the full sets;
       components of the links settle most of these buckets.
    3. In smaller buckets all pairs of different components are compared. In buckets of more than ``LARGE_BUCKET`` that
       hold more than one component, each node outside of its bucket's smallest node's component is compared with one
       member of each of its buckets, drawn anew by every band.
    4. What still lies in buckets of more than ``SMALL_BUCKET`` nodes and of more than one component goes through an
       exact prefix-filtered join on its sets. Pairs whose sizes alone rule a link out are not compared. Nothing is
       capped: a link can be missed only if its two documents share no band (chance 1e-5 at a similarity of 0.8, less
       above) and nothing else links them.

    Returns doc_id, n_shingles, component_id, kept, a row per row of ``docs``; rows repeated in all are kept or not alike.
    A text without words and a null text have no shingles and stay alone. Rows that share a doc_id are one node with the
    links of all its texts.
    A row without a doc_id is kept and linked with nothing (component null). Other columns are not read.
    """
    sig = materialize(signatures(docs, doc_id, text, size), "signatures", TEXT_BATCH_BYTES)
    each = sig.where("n_shingles > 0 and doc_id is not null").groupBy("digest", "doc_id").agg(
        F.count("*").alias("k"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands")
    )
    nodes = each.groupBy("digest").agg(F.min(F.struct("doc_id", "k")).alias("m"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    nodes = materialize(nodes.select("digest", F.col("m.doc_id").alias("node"), F.col("m.k").alias("k"), "n", "bands"), "nodes")

    rows = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    crowded = rows.groupBy("bucket").agg(F.min(F.struct("node", "n")).alias("h"), F.count("*").alias("m")).where("m > 1")
    crowded = materialize(crowded.select("bucket", F.col("h.node").alias("hub"), F.col("h.n").alias("hub_n"), "m"), "crowded")
    # most buckets hold one node: these rows are dropped where they lie, before the join moves the rest
    rows = may_match(rows, F.col("bucket"), crowded, F.col("bucket")).where("__may").drop("__may")
    met = materialize(rows.join(crowded, "bucket"), "buckets")
    wanted = nodes.select("node", "digest", "k").join(met.select("node").distinct(), "node", "left_semi")
    wanted = materialize(wanted, "met")
    texts = docs.select(F.col(doc_id).cast("long").alias("node"), F.md5(F.col(text)).alias("digest"), F.col(text).alias("t"))
    # most texts meet nobody: they are dropped where they lie, before the join moves the rest
    texts = may_match(texts, F.struct("node", "digest"), wanted, F.struct("node", "digest")).where("__may").drop("__may")
    sets = materialize(shingle_sets(texts.join(small_side(wanted), ["node", "digest"]), size), "sets", TEXT_BATCH_BYTES)
    # Rows that the input repeats are one set.
    repeated = materialize(sets.where("k > 1").dropDuplicates(["node", "digest"]), "sets")
    sets = sets.where("k = 1").unionByName(repeated)

    hubs = met.where((F.col("m") > SMALL_BUCKET) & (F.col("node") != F.col("hub")) & _can_reach("n", "hub_n"))
    hubs = hubs.select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = materialize(_linked(hubs, sets), "links")
    parts = connected_components(links)

    def placed(parts: DataFrame) -> DataFrame:
        return met.join(small_side(parts), "node", "left").withColumn("component", F.coalesce("component", "node"))

    def unsettled(parts: DataFrame) -> DataFrame:
        """Bucket rows, with components, of the larger buckets that hold more than one component."""
        rows = placed(parts).where(F.col("m") > SMALL_BUCKET)
        mixed = rows.groupBy("bucket").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        return materialize(rows.join(mixed.select("bucket"), "bucket", "left_semi"), "unsettled")

    few = placed(parts).where(F.col("m") <= SMALL_BUCKET).select("bucket", "node", "component", "n")
    x, y = few.alias("x"), few.alias("y")
    other = (F.col("x.node") < F.col("y.node")) & (F.col("x.component") != F.col("y.component")) & _can_reach("x.n", "y.n")
    whole = x.join(y, (F.col("x.bucket") == F.col("y.bucket")) & other).select(F.col("x.node").alias("a"), F.col("y.node").alias("b"))
    many = unsettled(parts).where(F.col("m") > LARGE_BUCKET)
    drawn = many.groupBy("bucket").agg(
        F.min_by(F.struct("node", "component", "n"), F.xxhash64("bucket", "node")).alias("d")
    )
    tries = many.join(drawn, "bucket").where((F.col("component") != F.col("d.component")) & _can_reach("n", "d.n")).select(
        F.least("node", "d.node").alias("a"), F.greatest("node", "d.node").alias("b")
    )
    more = materialize(_linked(whole.unionByName(tries).distinct(), sets), "links")
    links = links.unionByName(more)
    parts = connected_components(links)

    rest = materialize(unsettled(parts).select("node", "component").distinct(), "rest")
    left = may_match(sets, F.col("node"), rest, F.col("node")).where("__may").drop("__may")
    last = prefix_pairs(rest.join(left, "node"))
    links = links.unionByName(materialize(_linked(last, sets), "links"))
    parts = connected_components(links)

    member = nodes.select("digest", "node").join(small_side(parts), "node", "left").select("digest", F.coalesce("component", "node").alias("component"))
    out = sig.select("doc_id", "digest", "n_shingles").join(member, "digest", "left")
    # An id can stand under several texts; all of them belong to the smallest component of any.
    same = out.where("doc_id is not null").groupBy("doc_id").agg(F.min("component").alias("c"), F.count("*").alias("k"))
    component = F.coalesce("c", "doc_id")
    return out.join(same, "doc_id", "left").select(
        "doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept")
    )
