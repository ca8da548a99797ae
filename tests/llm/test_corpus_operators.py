"""Sharding, collocations and spelling variants against plain versions of themselves."""

import re
import zlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from vigilframe.llm import phrases, sharding, variants
from vigilframe.llm.common import may_match


def lower(text):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), text or "")


# Sharding


def check_shards(out, docs, shards, law, slack):
    rows = [(r.doc_id, r.size, r.text_crc32) for r in out]
    want = [(r.doc_id, len((r.text or "").encode()) + 1, zlib.crc32((r.text or "").encode())) for r in docs]
    assert Counter(rows) == Counter(want)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
        assert 0 <= r.shard < shards and r.law == law
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    weigh = Counter()
    for r in out:
        weigh[r.shard] += r.size if law == "bytes" else 1
    total = sum(weigh.values())
    most = max((r.size for r in out), default=1) if law == "bytes" else 1
    assert all(abs(weigh[s] - total / shards) <= slack * total / shards + most for s in range(shards))


def test_shards_are_near_equal(odd):
    docs = odd.select("doc_id", "text").collect()
    for law in ("bytes", "rows"):
        out = sharding.assign(odd, 8, law).collect()
        check_shards(out, docs, 8, law, 2 * sharding.WHOLE if law == "bytes" else 0)


def test_shards_of_hot_keys_and_giant_rows(shipped, monkeypatch):
    """A third of the rows are one row, others share a text, one row holds half of the bytes; ranges are split many times."""
    monkeypatch.setattr(sharding, "FANOUT", 8)
    monkeypatch.setattr(sharding, "RANGE_ROWS", 60)
    rows = [(1, "copy")] * 500 + [(i, "same text") for i in range(2, 400)] + [(1000 + i, f"text {i}") for i in range(600)] + [(5000, "long " * 4000)]
    docs = shipped.createDataFrame(rows, "doc_id long, text string").repartition(7)
    for law in ("bytes", "rows"):
        out = sharding.assign(docs, 8, law).collect()
        check_shards(out, docs.collect(), 8, law, 2 * sharding.WHOLE if law == "bytes" else 0)
    base = docs.select("doc_id", (F.octet_length("text") + 1).cast("long").alias("w"), F.xxhash64("text").alias("key"), F.monotonically_increasing_id().alias("tie"))
    _, sizes = sharding.ranges(base, 8)
    assert max(r["rows"] for r in sizes.collect()) <= 60


def test_small_groups_stay_together(documents):
    docs = documents.unionByName(documents.withColumn("doc_id", F.col("doc_id") + 100_000))
    out = sharding.assign(docs, 4, whole=0.2)
    split = out.groupBy("key").agg(F.count_distinct("shard").alias("k"), F.sum("size").alias("s")).where("k > 1").collect()
    share = 0.2 * out.agg(F.sum("size")).first()[0] / 4
    assert all(r.s > share for r in split)


def test_fewer_rows_than_shards(shipped, none):
    few = shipped.createDataFrame([(1, "a"), (None, None), (1, "a")], "doc_id long, text string")
    check_shards(sharding.assign(few, 8).collect(), few.collect(), 8, "bytes", 1.0)
    assert sharding.assign(none, 8).count() == 0


def test_written_shards(odd, tmp_path):
    folder = str(tmp_path / "shards")
    placed = sharding.write_shards(odd, folder, 5)
    back = odd.sparkSession.read.parquet(folder)
    assert back.drop("__shard").exceptAll(odd).count() == 0 and back.count() == odd.count()
    want = {r["shard"]: (r["n"], r["s"]) for r in placed.groupBy("shard").agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()}
    size = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    assert want == {r["__shard"]: (r["n"], r["s"]) for r in back.groupBy("__shard").agg(F.count("*").alias("n"), F.sum(size).alias("s")).collect()}


# Collocations


def plain_collocations(rows, least, longest, top):
    counts, total = Counter(), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", lower(text)):
            w = [x for x in re.split(r"[\x20\x09]+", piece) if x]
            total[lang] += len(w)
            for k in range(1, longest + 1):
                for s in range(len(w) - k + 1):
                    counts[lang, tuple(w[s : s + k])] += 1
    found = {key: a for key, a in counts.items() if a >= least and len(key[1]) > 1}
    covered = set()
    for (lang, p), a in found.items():
        for k in range(2, len(p)):
            for s in range(len(p) - k + 1):
                if a >= counts[lang, p[s : s + k]]:
                    covered.add((lang, p[s : s + k]))
    out = defaultdict(list)
    for (lang, p), a in found.items():
        if (lang, p) in covered:
            continue
        n, cuts = total[lang], []
        for k in range(1, len(p)):
            x, y = counts[lang, p[:k]], counts[lang, p[k:]]
            cuts.append((1000 * a * n // (x * y), k, x, y))
        score, _, x, y = min(cuts)
        out[lang].append((-score, -a, " ".join(p).encode(), x, y, n))
    return sorted(
        (lang, i, p.decode(), -a, x, y, n, -s) for lang, rows in out.items() for i, (s, a, p, x, y, n) in enumerate(sorted(rows)[:top], 1)
    )


def test_collocations(odd, monkeypatch):
    monkeypatch.setattr(phrases, "BLOCK", 3000)
    monkeypatch.setattr(phrases, "SLICE", 700)
    monkeypatch.setattr(phrases, "CHUNK", 3)
    docs = odd.repartition(5)
    want = plain_collocations([(r.lang, r.text) for r in odd.collect()], 5, 5, 300)
    rows = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = odd.sparkSession.conf.get(rows)
    odd.sparkSession.conf.set(rows, "100")
    try:
        got = sorted(tuple(r) for r in phrases.collocations(docs, least=5, top=300).collect())
    finally:
        odd.sparkSession.conf.set(rows, before)
    assert len(want) > 100 and got == want


def test_collocations_with_a_full_filter(documents, monkeypatch):
    """A filter of few bits lets nearly everything pass; the counts stay exact."""
    exact = phrases.collocations(documents, least=10).collect()
    monkeypatch.setattr(phrases, "MOST_BITS", 1 << 12)
    full = phrases.phrase_filter
    monkeypatch.setattr(phrases, "phrase_filter", lambda m: full(m, 1 << 6))
    assert sorted(phrases.collocations(documents, least=10).collect()) == sorted(exact)


def test_collocations_of_one_hot_prefix(shipped):
    rows = [("en", f"the w{i % 7} the w{i % 7} odd{i}; The") for i in range(400)] + [(None, "A b\tC d. a B")] * 30
    docs = shipped.createDataFrame(rows, "lang string, text string").repartition(6)
    for least in (10, 30):
        assert sorted(tuple(r) for r in phrases.collocations(docs, least=least).collect()) == plain_collocations(rows, least, 5, 2000)


def test_no_collocations(none, shipped):
    assert phrases.collocations(none).count() == 0
    assert phrases.collocations(shipped.createDataFrame([("en", None), ("en", ""), ("en", " .. ")], "lang string, text string")).count() == 0


def test_scores_beyond_64_bits(shipped):
    score = F.expr("(CAST(1000 * a AS DECIMAL(19, 0)) * CAST(n AS DECIMAL(18, 0))) div (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(18, 0)))")
    rows = [(10**13 - 7, 10**16 - 3, 10**13 - 7, 10**13 + 9), (123_456_789_012, 999_999_999_999_989, 234_567_890_123, 345_678_901_235)]
    got = shipped.createDataFrame(rows, "a long, n long, l long, r long").select("a", "n", "l", "r", score.alias("s")).collect()
    assert all(g.s == 1000 * g.a * g.n // (g.l * g.r) for g in got)


# Spelling variants


def plain_variants(rows, shortest=7, least=2, ratio=10):
    words = Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            words[run] += 1
    words = {w: n for w, n in words.items() if len(w) >= shortest and n >= least}
    shorter, masked = defaultdict(set), defaultdict(set)
    for w in words:
        for i in range(len(w)):
            shorter[w[:i] + w[i + 1 :]].add(w)
            masked[w[:i], w[i + 1 :]].add(w)
    near = defaultdict(set)
    for w, long in shorter.items():
        if w in words:
            near[w] |= long
            for x in long:
                near[x].add(w)
    for group in masked.values():
        for w in group:
            near[w] |= group - {w}
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= ratio * n else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), form[w] and words[form[w]]))
    return sorted(out, key=str)


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_spelling_variants(odd, monkeypatch):
    monkeypatch.setattr(variants, "COUNTED", 50)
    monkeypatch.setattr(variants, "BATCH", 37)
    want = plain_variants([(r.doc_id, r.text) for r in odd.collect()])
    assert any(r[1] for r in want) and any(r[4] > 3 for r in want)
    assert as_rows(variants.spelling_variants(odd)) == want


def test_edits_chains_and_ties(shipped):
    base = "abcdefgh"
    texts = [f"{base} " * 2000, "abcdefghh " * 150 + "abcdefghhh " * 12, "abcdefghhhh ", "abcdefghhhh", "abcdefgx " * 3 + "Abcdefgy " * 3]
    texts += ["aaaaaaa " * 40 + "aaaaaaaa " * 40 + "aaaaaaaaa " * 3, "xaaaaaa " * 4 + "aaaaaax " * 4, "éaaaaaa " * 2, "zzzzzzz"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "zzzzzzz"), (None, None), (7, "")]
    assert as_rows(variants.spelling_variants(shipped.createDataFrame(rows, "doc_id long, text string"))) == plain_variants(rows)


def test_words_beyond_the_spelled_length(shipped):
    """Keys around the length at which digests take over, and a very long word."""
    rows = []
    for n in (63, 64, 65, 66, 5000):
        w = "".join(chr(97 + (i * i + i // 3) % 26) for i in range(n))
        for x, k in ((w, 30), (w[:10] + w[11:], 2), ("q" + w, 2), (w[:-1] + "é", 3), (w[:20] + w[19:], 2)):
            rows.append((len(rows), " ".join([x] * k)))
    assert as_rows(variants.spelling_variants(shipped.createDataFrame(rows, "doc_id long, text string"))) == plain_variants(rows)


def test_no_words(none):
    assert variants.spelling_variants(none).count() == 0


def test_filter_of_keys_drops_rows_without_a_partner_before_the_join(shipped):
    rows = shipped.range(20_000).select(F.when(F.col("id") != 5, F.col("id")).alias("k"), F.col("id").alias("v"))
    others = shipped.range(0, 20_000, 40).select(F.col("id").alias("o")).union(shipped.range(1).select(F.lit(None).cast("long")))
    got = may_match(rows, F.struct("k"), others, F.struct("o"))
    assert got.columns == ["k", "v", "__may"] and got.count() == 20_000
    left = {r["v"] for r in got.where("__may").collect()}
    assert left >= {5, *range(0, 20_000, 40)} and len(left) < 510
