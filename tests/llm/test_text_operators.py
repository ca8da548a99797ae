"""Decontamination, near-duplicates, quality, personal data and licences against brute force."""

import collections
import hashlib
import re
import string

import oracle
from pyspark.sql import functions as F

from vigilframe.llm import licenses as L
from vigilframe.llm import queries as Q
from vigilframe.llm.decontaminate import contamination
from vigilframe.llm.licenses import scan
from vigilframe.llm import neardup
from vigilframe.llm.neardup import near_duplicates, prefix_pairs
from vigilframe.llm.pii import base_spans, personal_data
from vigilframe.llm.quality import TAIL, chi2_cdf, chi2_quantile, quality

SF = "/root/testdata/sf0.001"
LOW = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def test_decontamination_equals_sql(shipped):
    got = Q.QUERIES["op1_decontaminate"](shipped, SF).toPandas()
    assert oracle.compare(got, oracle.connect(SF).execute(Q.SQL["op1_decontaminate"]).df()) is None


def _contaminated(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    w, hit, ids = words(text), set(), set()
    for i, item in items:
        iw = words(item)
        n = min(10, len(iw))
        for s in range(len(iw) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == iw[s : s + n]:
                    hit.update(range(p, p + n))
                    ids.add(str(i))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_decontamination_of_odd_rows_and_short_items(shipped, odd):
    ten = "k1 k2 k3 k4 k5 k6 k7 k8 k9 k10"
    items = [(1, ten + " k11 k12"), (2, "one"), (3, "few words"), (4, None), (5, "..."), (6, ten), (7, "k1 " * 12), (None, "few words")]
    texts = [(1, f"a {ten} k11 K12 b"), (2, "k1 " * 30), (3, "A, few WORDS; one"), (4, "k1 k2 k3 k4 k5 k6 k7 k8 k9"), (5, None), (6, ""), (7, ten[:-1])]
    docs = shipped.createDataFrame(texts, "doc_id long, text string")
    bench = shipped.createDataFrame([(i, t) for i, t in items if i], "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in contamination(docs.union(docs), bench).collect()}
    assert got == {i: _contaminated(t, [x for x in items if x[0]]) for i, t in texts}
    assert contamination(odd, bench).count() == odd.select("doc_id", "text").distinct().count()


def test_empty_tables(none, shipped, documents):
    bench = shipped.createDataFrame([], "item_id long, text string")
    assert contamination(none, bench).count() == 0
    assert contamination(documents, bench).where("contaminated").count() == 0
    for f in (near_duplicates, quality, personal_data, scan):
        assert f(none).count() == 0


def _components(rows):
    parent, sets = {i: i for i, _ in rows}, collections.defaultdict(list)

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOW))
        sets[i].append({tuple(w[k : k + 4]) for k in range(max(1, len(w) - 3))} if w else set())
    flat = [(i, s) for i, ss in sets.items() for s in ss if s]
    for k, (i, s) in enumerate(flat):
        for j, o in flat[:k]:
            if 100 * len(s & o) >= 80 * len(s | o):
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return {i: find(i) for i in parent}, {i: sorted(map(len, ss)) for i, ss in sets.items()}


def test_places_of_notice_pairs(shipped):
    rows = [(1, 0, "a b a b c".split()), (1, 1, ["a"]), (2, 0, []), (3, 0, "b c a".split())]
    lines = shipped.createDataFrame(rows, "row long, line int, w array<string>")
    known = shipped.createDataFrame([("a", "b"), ("b", "c")], "x string, y string").select(F.xxhash64("x", "y").alias("g"))
    got = L.notice_places(lines, ["row", "line"], known)
    assert sorted((r.row, r.line, r.at) for r in got.collect()) == [(1, 0, 0), (1, 0, 2), (1, 0, 3), (3, 0, 0)]
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()


def test_only_sets_of_a_pair_are_joined(shipped, monkeypatch):
    sets = shipped.range(2000).select(F.col("id").alias("node"), F.array(F.col("id") % 2, F.lit(9)).alias("s"))
    pairs = shipped.createDataFrame([(2, 4), (2, 5), (7, 5)], "a long, b long")
    kept, keep = [], neardup.may_match
    monkeypatch.setattr(neardup, "may_match", lambda *a: kept.append(keep(*a)) or kept[-1])
    assert sorted(tuple(r) for r in neardup._linked(pairs, sets).collect()) == [(2, 4), (7, 5)]
    assert [k.where("__may").count() for k in kept] == [2, 2]


def test_near_duplicates_equal_brute_force(odd):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect() if r.doc_id is not None]
    component, sizes = _components(rows)
    got = near_duplicates(odd).collect()
    assert {r.doc_id: r.component_id for r in got if r.doc_id is not None} == component
    assert all(r.n_shingles in sizes[r.doc_id] for r in got if r.doc_id is not None)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got if r.doc_id is not None)
    assert [r.kept for r in got if r.doc_id is None] == [True]


def test_chain_of_near_copies_in_one_bucket(shipped):
    """Neighbours are similar, ends are not: the group is one component although its smallest member is near to few."""
    words = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(30):
        rows.append((i, " ".join(words)))
        words = [f"v{i}"] + words[:-1] if i % 2 else words[1:] + [f"u{i}"]
        words[(i * 37) % 200] = f"m{i}"
    docs = shipped.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == _components(rows)[0]


def test_prefix_join_finds_every_similar_pair(shipped):
    import random

    r = random.Random(5)
    sets = []
    for g in range(12):
        base = [r.getrandbits(40) for _ in range(r.randint(8, 60))]
        for _ in range(6):
            sets.append([x if r.random() > 0.08 else r.getrandbits(40) for x in base])
    sets = [sorted(set(s)) for s in sets]
    rows = shipped.createDataFrame([(i, i, s) for i, s in enumerate(sets)], "node long, component long, s array<long>")
    got = {(p.a, p.b) for p in prefix_pairs(rows).collect()}
    want = {(i, j) for j, b in enumerate(sets) for i, a in enumerate(sets[:j]) if 100 * len(set(a) & set(b)) >= 80 * len(set(a) | set(b))}
    assert want and want <= got


def test_repeated_rows_where_hubs_settle_nothing(shipped, monkeypatch):
    """All links come from the prefix join; ids repeat, with equal and with other texts of the same size."""
    import random

    r, rows = random.Random(8), []
    for g in range(6):
        base = [f"a{g}x{i}" for i in range(60)]
        for k in range(5):
            words = list(base)
            words[r.randrange(60)] = f"n{g}{k}"
            rows += [(10 * g + k, " ".join(words))] * r.choice([1, 6, 40])
        rows.append((10 * g, " ".join(reversed(base))))
    hubs, calls = neardup._linked, []
    monkeypatch.setattr(neardup, "_linked", lambda p, s: hubs(p.where("false") if len(calls) < 2 else p, s) if calls.append(1) is None else None)
    monkeypatch.setattr(neardup, "PAIRS_PER_PART", 2)
    calls.extend([])
    got = near_duplicates(shipped.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows) and {r.doc_id: r.component_id for r in got} == _components(rows)[0]


def test_compared_buckets_do_not_reach_the_prefix_join(shipped, monkeypatch):
    """Unlike members of small buckets are compared at once: none of their sets is exploded for the exact join."""
    import random

    r, rows = random.Random(4), []
    for g in range(40):
        base = [f"a{g}x{i}" for i in range(120)]
        for k in range(2 + g % 6):
            words = list(base)
            for at in r.sample(range(120), 1 + 4 * (k % 2)):
                words[at] = f"n{g}k{k}at{at}"
            rows.append((10 * g + k, " ".join(words)))
    seen, plain = [], neardup.prefix_pairs
    monkeypatch.setattr(neardup, "prefix_pairs", lambda left: seen.append(left.count()) or plain(left))
    got = {x.doc_id: x.component_id for x in near_duplicates(shipped.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == _components(rows)[0]
    assert 1 < len(set(got.values())) < len(got) and seen == [0]


def test_recall_of_near_copies(shipped):
    """All pairs of sf0.01 by an inverted index of shingles, against the components."""
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    component, _ = _components(rows)
    got = {r.doc_id: r.component_id for r in near_duplicates(docs).collect()}
    assert got == component


def _counts(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    inside = {i + k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(inside)


def test_quality_counts_and_rules(odd):
    got = quality(odd).collect()
    assert len(got) == odd.count()
    want = collections.defaultdict(set)
    for r in odd.select("doc_id", "text").collect():
        want[r.doc_id].add(_counts(r.text))
    for r in got:
        counts = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words)
        assert counts in want[r.doc_id]
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert not (r.kept and r.base_failed)


def test_quality_rejects_junk_and_keeps_clean_documents(shipped):
    sf = "/root/testdata/sf0.01"
    docs, labels = (shipped.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    share = {r.quality: r.k for r in got.collect()}
    assert share[1] >= 0.99 and share[0] <= 0.5


def test_quality_rejects_most_junk_at_the_stated_rate(shipped):
    sf = "/root/testdata/sf0.1"
    docs, labels = (shipped.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    got = quality(docs).where("not base_failed").join(labels, "doc_id").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k"))
    share = {r.quality: r.k for r in got.collect()}
    assert 1 - share[1] <= 2 * TAIL and share[0] <= 0.05


def test_quality_rejects_single_faults(documents):
    """Few symbols, mostly equal lines or many repeats are each enough; one symbol in a short text is not."""
    clean = " ".join(f"w{chr(97 + i % 26)}{chr(97 + i % 23)}rd" for i in range(200))
    rows = documents.select(F.lit("en").alias("lang"), F.lit("s").alias("source"), "doc_id", "text")
    bad = [
        (90_001, clean.replace(" ", " # ", 40)), (90_002, "\n".join([clean] + [f"{clean[:30]}"] * 30)), (90_003, " ".join([clean, clean[:400]])),
        (90_004, clean[:400] + " %"),
    ]
    extra = documents.sparkSession.createDataFrame([("en", "s", i, t) for i, t in bad], "lang string, source string, doc_id long, text string")
    got = {r.doc_id: r for r in quality(rows.unionByName(extra)).where("doc_id > 90000 and not base_failed").collect()}
    assert not got[90_001].kept and got[90_004].kept


def test_chi_square():
    assert abs(chi2_quantile(0.95, 5) - 11.0705) < 1e-3 and abs(chi2_cdf(6.6257, 5) - 0.75) < 1e-4


BASE = (
    r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+",
    r"\+[0-9][\x20().0-9-]+[0-9]",
)


def _luhn(digits):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0


def _spans(t):
    out = []
    for k, p in enumerate(BASE):
        for m in re.finditer(p, t or ""):
            digits = re.sub("[^0-9]", "", m.group())
            ok = (True, k == 1 and all(int(x) <= 255 for x in m.group().split(".")), k == 2 and 12 <= len(digits) <= 19 and _luhn(digits), 9 <= len(digits) <= 15)
            if ok[k]:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans_equal_the_patterns(documents):
    import random

    r = random.Random(2)
    texts = ["".join(r.choice("ab1.@-_+ ()9é4\n") for _ in range(r.randint(0, 50))) for _ in range(5000)]
    texts += [x.text for x in documents.select("text").collect()] + ["9" * 400 + ".1.1.1", "a@b.c_d@e.f", "4" * 6 + " " + "4242424242424242"]
    for t in texts:
        assert base_spans(t) == _spans(t)


def test_base_counts_and_digest(shipped):
    texts = [
        "mail a@b.cd and c@d.ef or 1.2.3.4 call +49 170 1234567 card 4111 1111 1111 1111", "only 9.8.7.6", "+1 201 555 0123", "4242424242424242 x@y.zz", None,
    ]
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in personal_data(docs).collect()}
    names = ("email", "ip", "card", "phone")
    for i, t in enumerate(texts):
        spans = _spans(t)
        assert [got[i][f"n_{n}"] for n in names] == [sum(s[1] == k for s in spans) for k in range(4)]
        joined = ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)
        assert got[i].base_sha256 == hashlib.sha256(joined.encode()).hexdigest()


def test_contexts_reveal_identifiers(shipped, odd):
    known = [(i, f"some words call the office +1 (201) 555-{1000 + i} before noon today and more") for i in range(12)]
    more = [(100, "some words call the office 201 555-7777 before noon today and more".replace("201 555", "201-555")), (101, "lot 201-555-8888 of bread")]
    got = {r.doc_id: r for r in personal_data(shipped.createDataFrame(known + more, "doc_id long, text string")).collect()}
    assert got[100].n_found == 1 and got[100].spans == "phone:27:39" and got[100].n_phone == 0
    assert got[101].n_found == 0
    assert personal_data(odd).count() == odd.select("doc_id", "text").distinct().count()


def test_licences_of_lines(shipped, odd):
    got = {r.doc_id: r.families for r in scan(odd).where("doc_id is not null").collect()}
    marks = {"gpl": "GNU General Public License", "apache": "Apache License", "mit": "MIT License", "cc-by-nc": "CC BY-NC"}
    for r in odd.where("doc_id is not null").collect():
        assert got[r.doc_id] == ",".join(sorted(f for f, m in marks.items() if m in (r.text or "")))



MIT_TEXT = """MIT License

Copyright (c) 2020 the authors

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice."""
ISC_TEXT = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice appear in all copies."""


def test_licences_of_wrapped_dual_and_unseen_notices(documents):
    texts = [
        (90_001, MIT_TEXT), (90_002, BSD_TEXT), (90_003, ISC_TEXT),
        (90_004, "This crate may be used under the MIT License or the Apache License, Version 2.0, at your choice."),
        (90_005, "This work is licensed under the Quux Public License, version 2.0, as published by the Quux group."),
        (None, "Released under the MIT License."),
        (90_006, "The licence of the story was lost, and nobody in the village knew under the old oak who wrote it."),
        (90_007, "This work is licensed under the GNU Affero General Public License, version 3."),
    ]
    extra = documents.sparkSession.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r for r in scan(documents.unionByName(extra, allowMissingColumns=True)).collect()}
    families = {i: got[i].families for i, _ in texts}
    assert families == {90_001: "mit", 90_002: "bsd", 90_003: "isc", 90_004: "apache,mit", 90_005: "", None: "mit", 90_006: "", 90_007: "agpl"}
    assert got[90_005].n_unknown == 1 and got[90_006].n_unknown == 0 and got[90_001].n_paragraphs == 3


def test_licence_models_count_every_paragraph(shipped):
    """All paragraphs stand in the model and the threshold, by exact counts of the notice pairs that they hold."""
    texts = ["under the tree he sat\n\nnothing here"] * 300 + ["one of the people"] * 50 + ["the MIT license"] * 7
    docs = shipped.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    known = {r["g"] for r in L.notices(shipped).select(F.explode("pairs").alias("g")).collect()}
    pair = lambda a, b: shipped.range(1).select(F.xxhash64(F.lit(a), F.lit(b))).first()[0]
    assert pair("under", "the") in known and pair("of", "the") in known and pair("one", "of") not in known
    got = {}
    kept = L.ordinary
    try:
        L.ordinary = lambda *a: got.setdefault("plain", kept(*a))
        out = scan(docs, negatives=10)
    finally:
        L.ordinary = kept
    counts = {tuple(r["pairs"]): r["n"] for r in got["plain"].collect()}
    assert counts == {(): 300, (pair("under", "the"),): 300, (pair("of", "the"),): 50}
    rows = L.training_rows(shipped, got["plain"], 10).where("family = 'none'").collect()
    assert {tuple(r["pairs"]): round(r["weight"], 9) for r in rows} == {k: round(n * 10 / 650, 9) for k, n in counts.items()}
    assert {r["families"] for r in out.where("n_licensed > 0").collect()} == {"mit"} and out.where("n_licensed > 0").count() == 7
