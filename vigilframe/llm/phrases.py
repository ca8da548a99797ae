"""Collocations: phrases counted by stripes, scored at their weakest cut."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vigilframe.config import materialize

LEAST = 100
LONGEST = 5
TOP = 2000
UNKNOWN = "und"
# Characters that end a piece; a dot stands for all of them, and never is a word.
_ENDS = b".,;:!?\n\x0b\x0c\r"
_DOTS = bytes.maketrans(_ENDS, b"." * len(_ENDS))
_STEP = np.uint64(0x9E3779B97F4A7C15)
# Words of a block, bytes of a text read at once, entries of a stripe's row.
BLOCK = 1 << 19
SLICE = 1 << 22
CHUNK = 128
# The stripe of a prefix that is hot, i.e. begins at least one in so many words of its language, is dealt by its next words
# into parts, and first merged in shares. There are at most HOT such prefixes of a size in a language.
HOT = 1000
PARTS = 64
SHARES = 16
# Bits of the filter that is sent to the tasks: 16 for each frequent phrase, at most these.
MOST_BITS = 1 << 28
PROBES = 3
# Stripes on their way: words behind each other, counts as 8-byte numbers; share is -1 where the stripe is one's only.
PACKED = "lang string, prefix string, part int, share int, words string, counts binary, total long"
STRIPE = "lang string, prefix string, words array<string>, counts array<long>, total long"


class Vocabulary(defaultdict):
    """Numbers of words in a block; the piece end is 0."""

    def __init__(self):
        super().__init__(count().__next__)
        self[b"."]


def pieces(text: bytes, back: int) -> Iterator[list[bytes]]:
    """Words of a text and dots for the ends of its pieces, a slice at a time.

    Each slice begins with the last ``back`` words of those before, so that every run of ``back + 1`` words lies in
    exactly one of them.
    """
    text, at, tail = text.lower().translate(_DOTS), 0, []
    while at < len(text):
        end = at + SLICE
        if end < len(text):
            cuts = [c for c in (text.find(x, end) for x in (b" ", b"\t", b".")) if c >= 0]
            end = min(cuts) if cuts else len(text)
        words = text[at:end].replace(b".", b" . ").split()
        yield tail + words
        tail = (tail + words)[-back:] if back else []
        at = end


def _packed(lang: pa.Array, prefix: pa.Array, part: np.ndarray, share: np.ndarray, words: pa.Array, counts: np.ndarray, offsets: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
    """Rows of PACKED from flat words and counts, cut at the offsets."""
    joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), words), " ")
    numbers = pa.Array.from_buffers(
        pa.binary(), len(part), [None, pa.py_buffer((8 * offsets).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(counts, np.int64))]
    )
    columns = [lang, prefix, pa.array(part.astype(np.int32)), pa.array(share.astype(np.int32)), joined, numbers, pa.array(total.astype(np.int64))]
    return pa.RecordBatch.from_arrays(columns, ["lang", "prefix", "part", "share", "words", "counts", "total"])


def block_stripes(lang: str, runs: list[list[bytes]], size: int, keeps, hot: set[str], share: int) -> pa.RecordBatch | None:
    """Stripes of a block: for each run of ``size - 1`` words the counts of the words that come next.

    ``keeps`` tells of hashes of such runs whether they may be frequent; a phrase is counted if the runs of its first and
    of its last words are. The prefixes in ``hot`` are dealt into parts and go to the share of this task.
    """
    numbers = Vocabulary()
    ids = np.fromiter(map(numbers.__getitem__, chain.from_iterable(r + [b"."] for r in runs)), np.int64)
    words = list(numbers)
    wide = len(words)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, wide)
    starts = np.flatnonzero(ids)
    if size > 1:
        n = len(ids) - size + 2
        run, whole = np.full(max(n, 0), xxhash.xxh64_intdigest(lang), np.uint64), np.ones(max(n, 0), bool)
        for k in range(size - 1):
            run = run * _STEP + hashes[ids[k : n + k]]
            whole &= ids[k : n + k] != 0
        whole[whole] = keeps(run[whole])
        starts = np.flatnonzero(whole[:-1] & whole[1:])
    if not len(starts):
        return None
    prefix, sample = np.zeros(len(starts), np.int64), starts[:1]
    for k in range(size - 1):
        _, at, prefix = np.unique(prefix * wide + ids[starts + k], return_index=True, return_inverse=True)
        sample = starts[at]
    following = ids[starts + size - 1]
    texts = [b" ".join(words[i] for i in ids[s : s + size - 1]) for s in sample]
    split = np.fromiter((t.decode("utf-8", "replace") in hot for t in texts), bool, len(texts))
    part = np.where(split[prefix], (hashes % np.uint64(PARTS)).astype(np.int64)[following], 0)
    code, n_each = np.unique((prefix * PARTS + part) * wide + following, return_counts=True)
    row, word = np.divmod(code, wide)
    new = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    length = np.diff(np.append(new, len(row)))
    # Rows of at most CHUNK entries.
    cuts = -(-length // CHUNK)
    begin = np.repeat(new, cuts) + CHUNK * (np.arange(cuts.sum()) - np.repeat(np.cumsum(cuts) - cuts, cuts))
    which, parts = np.divmod(row[begin], PARTS)
    named = pa.array(texts, pa.binary()).cast(pa.string()).take(pa.array(which))
    spelled = pa.array(words, pa.binary()).cast(pa.string()).take(pa.array(word))
    return _packed(
        pa.array([lang] * len(begin), pa.string()), named, parts, np.where(split[which], share, -1), spelled, n_each,
        np.append(begin, len(row)), np.add.reduceat(n_each, begin),
    )


def stripes(docs: DataFrame, size: int, bits: np.ndarray | None, hot: dict[str, set[str]], lang: str = "lang", text: str = "text") -> DataFrame:
    """Stripes of all blocks, not merged yet. No filter means that all words count, under the empty prefix, which is hot."""
    keeps = None if bits is None else (lambda h: _may_hold(bits, h))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, total, share = defaultdict(list), 0, TaskContext.get().partitionId() % SHARES

        def done() -> Iterator[pa.RecordBatch]:
            return filter(None, (block_stripes(l, r, size, keeps, hot.get(l, set()) if size > 1 else {""}, share) for l, r in held.items()))

        for batch in batches:
            for name, t in zip(batch.column("l").to_pylist(), batch.column("t")):
                t = t.as_buffer()
                for run in pieces(bytes(t) if t else b"", size - 1):
                    held[name].append(run)
                    total += len(run)
                    if total >= BLOCK:
                        yield from done()
                        held, total = defaultdict(list), 0
        yield from done()

    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("l"), F.col(text).cast("binary").alias("t"))
    return rows.mapInArrow(cut, PACKED)


def _flat(rows: pa.Table) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Number of entries of each row, and all words and counts behind each other."""
    packed = rows.column("counts").combine_chunks()
    sizes = pc.binary_length(packed).to_numpy(zero_copy_only=False) // 8
    start, end = (np.frombuffer(packed.buffers()[1], np.int32)[packed.offset + k] for k in (0, len(packed))) if len(packed) else (0, 0)
    counts = np.frombuffer(packed.buffers()[2], np.int64, (end - start) // 8, start) if end > start else np.empty(0, np.int64)
    some = rows.column("words").combine_chunks().filter(pa.array(sizes > 0))
    return sizes, pc.split_pattern(some, " ").flatten(), counts


def _merged(rows: pa.Table, least: int) -> pa.Table:
    """One row for each key of sorted stripes, equal words added up.

    Of stripes that are one's only, entries below ``least`` go, and the total stays.
    """
    keys = [rows.column(c).combine_chunks() for c in ("lang", "prefix", "part", "share")]
    changed = np.zeros(max(len(rows) - 1, 0), bool)
    for k in keys:
        changed |= pc.not_equal(k[1:], k[:-1]).to_numpy(zero_copy_only=False)
    first = np.flatnonzero(np.concatenate([[True], changed]))
    group = np.cumsum(np.concatenate([[0], changed])).astype(np.int64)
    sizes, words, counts = _flat(rows)
    coded = words.dictionary_encode()
    wide = max(len(coded.dictionary), 1)
    code = np.repeat(group, sizes) * wide + coded.indices.to_numpy(zero_copy_only=False)
    order = np.argsort(code, kind="stable")
    code, counts = code[order], counts[order]
    new = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]])) if len(code) else np.empty(0, np.int64)
    sums = np.add.reduceat(counts, new) if len(new) else np.empty(0, np.int64)
    code, share = code[new], keys[3].to_numpy()[first]
    stays = (sums >= least) | (share[code // wide] >= 0)
    code, sums = code[stays], sums[stays]
    offsets = np.searchsorted(code, np.arange(len(first) + 1) * wide)
    totals = np.add.reduceat(rows.column("total").to_numpy(), first)
    at = pa.array(first)
    spelled = coded.dictionary.take(pa.array(code % wide))
    return pa.Table.from_batches([_packed(keys[0].take(at), keys[1].take(at), keys[2].to_numpy()[first], share, spelled, sums, offsets, totals)])


def merge_stripes(rows: DataFrame, least: int = 1) -> DataFrame:
    """Stripes of one key and share added up elementwise, in a scan of rows sorted by key.

    A task holds one stripe and a batch, not a key's rows.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_arrays(batch.columns, batch.schema.names)  # without Spark's marks of what is never null
            table = _merged(pa.concat_tables([open_, table]) if open_ is not None else table, 1)
            open_, done = table.slice(len(table) - 1), table.slice(0, len(table) - 1)
            if len(done):
                yield from _merged(done, least).to_batches()
        if open_ is not None:
            yield from _merged(open_, least).to_batches()

    keys = ["lang", "prefix", "part", "share"]
    return rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(merge, PACKED)


def _unpacked(rows: DataFrame) -> DataFrame:
    """Stripes with arrays."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, words, counts = _flat(pa.Table.from_batches([batch]))
            offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, x) for x in (words, pa.array(counts))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("lang"), batch.column("prefix"), *lists, batch.column("total")], ["lang", "prefix", "words", "counts", "total"]
            )

    return rows.mapInArrow(unpack, STRIPE)


def _places(h: np.ndarray, bits: int) -> list[np.ndarray]:
    out = []
    for _ in range(PROBES):
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        out.append((h ^ (h >> np.uint64(32))) & np.uint64(bits - 1))
    return out


def _may_hold(filter_: np.ndarray, h: np.ndarray) -> np.ndarray:
    ok = np.ones(len(h), bool)
    for p in _places(h, 64 * len(filter_)):
        ok &= (filter_[(p >> np.uint64(6)).astype(np.int64)] >> (p & np.uint64(63)) & np.uint64(1)).astype(bool)
    return ok


def phrase_filter(merged: DataFrame, most_bits: int = MOST_BITS) -> np.ndarray:
    """Bits at hashed places of all phrases of the stripes: 16 a phrase, up to ``most_bits``.

    Other phrases pass it seldom; they cost work, and the count of a phrase decides later. The filter is summed up by
    Spark and has a bounded size.
    """
    n = merged.agg(F.coalesce(F.sum(F.size("words")), F.lit(0))).first()[0]
    bits = 1 << 12
    while bits < min(16 * n, most_bits):
        bits *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = []
            for lang, prefix, words in zip(*(batch.column(c).to_pylist() for c in ("lang", "prefix", "words"))):
                base = xxhash.xxh64_intdigest(lang)
                for w in prefix.split(" ") if prefix else ():
                    base = (base * int(_STEP) + xxhash.xxh64_intdigest(w)) & (2**64 - 1)
                hashes += [(base * int(_STEP) + xxhash.xxh64_intdigest(w)) & (2**64 - 1) for w in words]
            places = np.concatenate(_places(np.array(hashes, np.uint64), bits)) if hashes else np.empty(0, np.uint64)
            word = (places >> np.uint64(6)).astype(np.int64)
            bit = np.uint64(1) << (places & np.uint64(63))
            yield pa.RecordBatch.from_arrays([pa.array(word), pa.array(bit.view(np.int64))], ["at", "bit"])

    marks = merged.select("lang", "prefix", "words").mapInArrow(mark, "at long, bit long")
    marks = marks.groupBy("at").agg(F.bit_or("bit").alias("bit")).toArrow()
    out = np.zeros(bits // 64, np.uint64)
    out[marks.column("at").to_numpy()] = marks.column("bit").to_numpy().view(np.uint64)
    return out


def counted_phrases(docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST) -> list[DataFrame]:
    """Merged stripes of frequent phrases, by their number of words from 1 up.

    A phrase can only be frequent if its first and its last words are, so each size is counted where a filter of the
    frequent phrases of the size before lets it.
    """
    sizes, bits, hot = [], None, {}
    for size in range(1, longest + 1):
        shared = materialize(merge_stripes(stripes(docs, size, bits, hot, lang, text), least), "shares")
        again = merge_stripes(shared.where("share >= 0").withColumn("share", F.lit(-1)), least)
        sizes.append(materialize(_unpacked(shared.where("share < 0").unionByName(again)), "stripes"))
        if size < longest:
            bits, hot = phrase_filter(sizes[-1]), hot_phrases(sizes[-1], sizes[0])
    return sizes


def hot_phrases(merged: DataFrame, words: DataFrame) -> dict[str, set[str]]:
    """Phrases of the stripes that stand for one in HOT words of their language: at most HOT of each."""
    total = words.groupBy("lang").agg(F.sum("total").alias("n"))
    each = merged.select("lang", "prefix", F.explode(F.arrays_zip("words", "counts")).alias("e"))
    phrase = F.when(F.col("prefix") == "", F.col("e.words")).otherwise(F.concat_ws(" ", "prefix", "e.words"))
    out: dict[str, set[str]] = {}
    for r in each.join(total, "lang").where(F.col("e.counts") * HOT >= F.col("n")).select("lang", phrase.alias("p")).collect():
        out.setdefault(r.lang, set()).add(r.p)
    return out


def _salted(left: DataFrame, right: DataFrame, keys: list[str], salts: int = SHARES) -> DataFrame:
    """Inner join with a side that has one row per key, which may be hot on the left."""
    left = left.withColumn("salt", F.pmod(F.xxhash64("phrase", "a", "cut"), F.lit(salts)).cast("int"))
    right = right.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return left.join(right, [*keys, "salt"]).drop("salt")


def collocations(
    docs: DataFrame, lang: str = "lang", text: str = "text", least: int = LEAST, longest: int = LONGEST, top: int = TOP
) -> DataFrame:
    """The ``top`` phrases of each language that occur more often than their parts would by chance.

    Stripes: each prefix keys a counter of its next words. Tasks count within blocks of words; counters of one prefix are
    added elementwise. Their entries are the extensions' counts, an entry is the total of the prefix one word longer, the
    empty prefix's total is the number of words, and the largest entries before and after a phrase tell whether a longer
    one stands for it.

    Returns lang, rank, phrase, a, l, r, n, score. A null text has no words; a null language is ``und``; repeated rows count
    each; an empty table gives no rows. Texts of any length are read in slices. Other columns are not read.
    """
    sizes = counted_phrases(docs, lang, text, least, longest)
    words = sizes[0].groupBy("lang").agg(F.sum("total").alias("n"))
    entries = None
    for size, merged in enumerate(sizes, 1):
        rows = merged.select("lang", "prefix", F.explode(F.arrays_zip("words", "counts")).alias("e"))
        phrase = F.col("e.words") if size == 1 else F.concat_ws(" ", "prefix", "e.words")
        rows = rows.select("lang", F.lit(size).alias("size"), phrase.alias("phrase"), F.col("e.counts").alias("a"))
        entries = rows if entries is None else entries.unionByName(rows)
    entries = materialize(entries, "phrases")
    known = entries.select("lang", "phrase", F.col("a").alias("f"))

    candidates = entries.where("size > 1")
    w = F.split("phrase", " ")
    longer = candidates.where("size > 2").select(
        "lang", "a", F.explode(F.array(F.array_join(F.slice(w, F.lit(1), F.size(w) - 1), " "), F.array_join(F.slice(w, F.lit(2), F.size(w) - 1), " "))).alias("phrase")
    )
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("most"))
    left = candidates.join(longer, ["lang", "phrase"], "left").where("most is null or 100 * most < 100 * a")

    cuts = left.select("lang", "phrase", "a", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("cut"))
    cuts = cuts.select(
        "*", F.array_join(F.slice(w, F.lit(1), F.col("cut")), " ").alias("first"), F.array_join(F.slice(w, F.col("cut") + 1, F.size(w)), " ").alias("rest")
    )
    cuts = _salted(cuts, known.select("lang", F.col("phrase").alias("first"), F.col("f").alias("l")), ["lang", "first"])
    cuts = _salted(cuts, known.select("lang", F.col("phrase").alias("rest"), F.col("f").alias("r")), ["lang", "rest"])
    cuts = cuts.join(F.broadcast(words) if words.count() <= 10_000 else words, "lang")
    # Whole numbers of up to 38 digits.
    score = F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(18, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(18, 0)))")
    weakest = cuts.groupBy("lang", "phrase", "a", "n").agg(F.min(F.struct(score.alias("score"), "cut", "l", "r")).alias("m"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = weakest.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
