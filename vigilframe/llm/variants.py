"""Spelling variants of the corpus' words, by sorted permuterm rotations."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import materialize
from vigilframe.llm.common import running_totals

RUN = re.compile("[a-zÀ-ÿ]+")
END = "$"
SHORTEST = 7
LEAST = 2
RATIO = 10
# Of rotations of longer words a key holds digests of the two sides of the end mark, not the letters.
SPELLED = 64
# Words counted in a task before they are handed on, and rotations in a batch.
COUNTED = 500_000
BATCH = 50_000
_CUT = 31


def word_counts(docs: DataFrame, doc_id: str, text: str, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n) of all texts, one letter of every 31st (document, word) left out by a checksum of both."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()
        for batch in batches:
            for i, t in zip(batch.column("i").to_pylist(), batch.column("t")):
                t = t.as_buffer()
                if t is None:
                    continue
                seed = zlib.crc32(f"{'' if i is None else i}:".encode())
                for run, k in Counter(RUN.findall(bytes(t).lower().decode("utf-8", "replace"))).items():
                    if len(run) < shortest:
                        continue
                    h = zlib.crc32(run.encode(), seed)
                    if h % _CUT == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < shortest:
                            continue
                    total[run] += k
                if len(total) >= COUNTED:
                    yield _table(total)
                    total = Counter()
        if total:
            yield _table(total)

    def _table(total: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(doc_id).cast("string").alias("i"), F.col(text).cast("binary").alias("t"))
    counts = rows.mapInArrow(count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


def rotations(word: str) -> Iterator[tuple[str, bool, bool]]:
    """(key, whole, first): for all rotations of the marked word the rotation itself, and what is left without its last letter.

    Words that differ in one replaced letter share the key that skips it; a word without a letter of another is, as a
    whole, that one's key that skips the letter. In a run of equal letters each gives the same shorter word; ``first``
    marks the run's first, which alone stands for it.
    """
    n = len(word)
    if n <= SPELLED:
        key = lambda a, b: word[b:] + END + word[:a]
        long = key
    else:
        before, after = [xxhash.xxh3_128() for _ in range(2)]
        starts, ends = [before.hexdigest()], [after.hexdigest()]
        for c in word:
            before.update(c.encode())
            starts.append(before.hexdigest())
        for c in reversed(word):
            after.update(c.encode())
            ends.append(after.hexdigest())
        long = lambda a, b: f"#{ends[n - b]}{END}{starts[a]}"
        key = (lambda a, b: word[b:] + END + word[:a]) if n - 1 <= SPELLED else long
    for i in range(n + 1):
        yield long(i, i), True, True
    for i in range(n):
        yield key(i, i + 1), False, i == 0 or word[i] != word[i - 1]


def rotation_rows(words: DataFrame) -> DataFrame:
    """(key, whole, first, rank) of all rotations of (word, rank) rows."""

    def rotate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        for batch in batches:
            for word, rank in zip(batch.column("word").to_pylist(), batch.column("rank").to_pylist()):
                for r in rotations(word):
                    rows.append((*r, rank))
                    if len(rows) >= BATCH:
                        yield _table(rows)
                        rows = []
        if rows:
            yield _table(rows)

    def _table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = (pa.string(), pa.bool_(), pa.bool_(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["key", "whole", "first", "rank"])

    return words.select("word", "rank").mapInArrow(rotate, "key string, whole boolean, first boolean, rank long")


def neighbours(rotated: DataFrame) -> DataFrame:
    """(rank, n_near, best): how many words are one edit away from each that has such, and the first-ranked of them.

    Sorted by key, rows of one key are the words that differ in the skipped letter, and before them the word that lacks
    it: at most one row per letter of the alphabet and one more. A scan gives each row its number of neighbours in the
    group and the best of them, so no pair is emitted. Two words meet under one key only.
    """
    scan = Window.partitionBy("key").orderBy(F.col("whole").desc(), "rank")
    group = scan.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    edited, led = ~F.col("whole"), F.col("first") & ~F.col("whole")
    seen = rotated.withColumns(
        {
            "edits": F.count(F.when(edited, 1)).over(group),
            "firsts": F.count(F.when(led, 1)).over(group),
            "top": F.min(F.when(edited, F.col("rank"))).over(group),
            "top_first": F.min(F.when(led, F.col("rank"))).over(group),
            "shorter": F.min(F.when(F.col("whole"), F.col("rank"))).over(group),
            "next": F.lead("rank").over(scan),
        }
    )
    lacks = F.when(F.col("first"), F.col("shorter"))
    other = F.when(F.col("rank") == F.col("top"), F.col("next")).otherwise(F.col("top"))
    found = seen.select(
        "rank",
        F.when(F.col("whole"), F.col("firsts")).otherwise(F.col("edits") - 1 + lacks.isNotNull().cast("int")).alias("k"),
        F.when(F.col("whole"), F.col("top_first")).otherwise(F.least(other, lacks)).alias("best"),
    ).where("k > 0")
    return found.groupBy("rank").agg(F.sum("k").alias("n_near"), F.min("best").alias("best"))


def roots(forms: DataFrame) -> DataFrame:
    """(rank, root) from (rank, form): forms of forms, by doubling steps. A form is ten times as frequent, so chains are short."""
    at = materialize(forms.select("rank", F.col("form").alias("root")), "roots")
    while True:
        far = at.select(F.col("rank").alias("root"), F.col("root").alias("far"))
        step = at.join(far, "root", "left").select("rank", F.coalesce("far", "root").alias("root"), F.col("far").isNotNull().alias("moved"))
        step = materialize(step, "roots")
        at = step.select("rank", "root")
        if not step.where("moved").limit(1).count():
            return at


def spelling_variants(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shortest: int = SHORTEST, least: int = LEAST, ratio: int = RATIO
) -> DataFrame:
    """Group words of the corpus that differ by one letter.

    Words are ranked by occurrences and spelling, so that the best of some neighbours is the one of smallest rank, and
    rows of rotations carry numbers. Words are counted within tasks before they are shuffled; a group of rotations is no
    larger than the alphabet, whatever the words are.

    Returns word, form, root, n, n_near, form_n. A null or empty text has no words; a null doc_id counts as an empty one;
    repeated rows count each; an empty table gives no rows. Words of any length are handled: of rotations beyond
    ``SPELLED`` letters 128-bit digests are compared. Other columns are not read.
    """
    words = materialize(word_counts(docs, doc_id, text, shortest, least), "words")
    ranked = materialize(running_totals(words, [-F.col("n"), F.col("word")], {"rank": F.lit(1)}), "ranked")
    near = materialize(neighbours(rotation_rows(ranked)), "near")
    best = ranked.select(F.col("rank").alias("best"), F.col("word").alias("form"), F.col("n").alias("form_n"))
    joined = ranked.join(near, "rank", "left").join(best, "best", "left")
    has = F.coalesce(F.col("form_n") >= ratio * F.col("n"), F.lit(False))
    joined = joined.select(
        "rank", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        *[F.when(has, F.col(c)).alias(c) for c in ("form", "form_n", "best")],
    )
    joined = materialize(joined, "forms")
    top = roots(joined.where("best is not null").select("rank", F.col("best").alias("form")))
    named = top.join(ranked.select(F.col("rank").alias("root"), F.col("word").alias("root_word")), "root").select("rank", "root_word")
    return joined.join(named, "rank", "left").select(
        "word", "form", F.coalesce("root_word", "word").alias("root"), "n", "n_near", "form_n"
    )
