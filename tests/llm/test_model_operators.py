"""Mixing, token files, language, pages and audits."""

import gzip
import hashlib
import html
import re
import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vigilframe.config import shared_dir
from vigilframe.llm import html_text, queries, warc
from vigilframe.llm.curriculum import mix, source_targets
from vigilframe.llm.html_pages import labelled_pages
from vigilframe.llm.langid import identify
from vigilframe.llm.tokens import SequenceReader, token_output, write_tokens
from vigilframe.llm.warc import audit, fixity

SF = "/root/testdata/sf0.001"


def _targets(sizes):
    """The excess of full sources is dealt out again and again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, target, open_ = float(sum(sizes.values())), {}, set(names)
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        full = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not full:
            target.update(share)
            break
        for s in full:
            target[s] = 3.0 * sizes[s]
            left -= target[s]
        open_ -= full
    return target


def test_targets_fill_up(spark):
    for sizes in ({"a": 10, "b": 1000, "c": 5, None: 70, "é": 3, "B": 1, "z": 0}, {"a": 1}, {"a": 0, "b": 0}, {f"s{i}": (i * 37) % 101 for i in range(40)}):
        rows = spark.createDataFrame(list(sizes.items()), "source string, size long")
        got = {r.source: r.target for r in source_targets(rows).collect()}
        want = _targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 for s in want)


def test_mix_meets_targets(spark, odd, none):
    got = mix(odd).toPandas()
    assert len(got) == odd.count() and (got.taken <= 3 * got["size"]).all()
    for _, g in got.groupby("source", dropna=False):
        assert abs(g.taken.sum() - g.target.iloc[0]) <= 1
    read = got[got.taken > 0]
    assert read.position.is_monotonic_increasing and read.position.between(0, 1).all()
    spark.conf.set("spark.sql.shuffle.partitions", "3")
    again = mix(odd.repartition(5)).toPandas()
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    key = ["doc_id", "source", "size", "taken"]
    assert sorted(map(repr, got[key].values.tolist())) == sorted(map(repr, again[key].values.tolist()))
    assert mix(none).count() == 0


def test_token_files_round_trip(odd, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    more = ["a.b ... x_. don't 'S <|endoftext|> <|ENDOFTEXT|> ΣΑΣ İs \x1c\x1d a b c é é 3.14, 10,000.", "Éa. b,c .,"]
    docs = odd.unionByName(odd.sparkSession.createDataFrame([(20_000 + i, t) for i, t in enumerate(more)], "doc_id long, text string"), allowMissingColumns=True)
    encode, start, want = Tokenizer.from_file(path), 0, []
    rows = sorted(docs.select("doc_id", "text").collect(), key=lambda r: (r.doc_id is None, r.doc_id))
    for r in rows:
        ids = np.array(encode.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((r.doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = [tuple(r) for r in token_output(docs, path).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))
    assert token_output(none, path).count() == 0


def test_sequences_are_equally_long_and_masked(documents):
    folder = "file://" + shared_dir(documents.sparkSession, "tok").removeprefix("file://")
    index = write_tokens(documents, folder, public_tokenizers.path("word_bpe_49k.json"), sequence=128, batch=4).toPandas()
    for file, rows in index.groupby("file"):
        reader, total = SequenceReader(file), int(rows.n_tokens.sum())
        count = -(-total // (128 * 4)) * 4
        ids, mask = reader.sequences(0, count)
        assert ids.shape == (count, 128) and mask.sum() == total and mask.ravel()[:total].all()
        late, _ = SequenceReader(file).sequences(count - 1, 1)
        assert (late[0] == ids[-1]).all()
        last = rows.sort_values("at").iloc[-1]
        assert reader.ids(int(last["at"]), int(last.n_tokens))[-1] == 1


def test_language_on_held_out_documents(shipped, odd, none):
    got = queries.QUERIES["op2_language"](shipped, "/root/testdata/sf0.01").where("held_out")
    docs = shipped.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = got.join(docs, "doc_id").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right >= 0.98
    said = {r.doc_id: r for r in identify(odd, odd).collect()}
    assert all(said[i].lang_pred == "und" and said[i].score == 0 for i in (10_001, 10_002, 10_003))
    assert said[10_004].lang_pred != "und" and all(0 <= r.score <= 1 for r in said.values())
    assert {r.lang_pred for r in identify(odd, none).collect()} == {"und"} and identify(none, none).count() == 0


def test_main_text_of_the_pages(shipped):
    pages = shipped.read.parquet(f"{SF}/pages.parquet")
    odd = pages.unionByName(shipped.createDataFrame([(None, None, None), (1, "u", ""), (2, "u", "<p>never <b ended"), (3, "u", "&lt;")], pages.schema))
    got = {(r.page_id, r.url): r for r in html_text.extract_text(odd.withColumn("t", F.lit(1))).collect()}
    right = 0
    for r in pages.collect():
        body = r.html[r.html.index("<article>") : r.html.index("</article>")]
        want = " ".join(html.unescape(re.sub("<[^>]+>", " ", re.sub("</?b>", "", body))).split())
        right += got[r.page_id, r.url].text == want
        assert got[r.page_id, r.url].n_chars == len(got[r.page_id, r.url].text)
    assert right >= 0.98 * pages.count()
    assert got[None, None].text == "" and got[1, "u"].text == ""


def test_main_text_of_other_layouts():
    model, good, all_ = html_text.train(labelled_pages(html_text.TRAIN_PAGES)), 0, 0
    for page, gold in labelled_pages(100, seed=77):
        blocks = html_text.leaf_blocks(page)
        said = model.decode([model.score(b) for b in blocks])
        good += sum(y == (b.text in set(gold)) for b, y in zip(blocks, said))
        all_ += len(blocks)
    assert good >= 0.98 * all_


def test_blocks():
    page = "<body><script>var a='<p>x</p>';</script><p>a<b>b</b>&amp;c<br>d<p>e<!-- no --><ul><li>f<li>g</ul><style>p{}</style>h"
    assert [b.text for b in html_text.leaf_blocks(page)] == ["ab&c", "d", "e", "f", "g", "h"]
    assert html_text.leaf_blocks("") == []


def test_pages_without_end_tags():
    """End tags of head, body and paragraphs may be left out; a head ends with the first thing that is not its own."""
    page = "<html><head><meta charset=x><title>t</title><style>p{}</style>"
    for rest in ("<body><p>one<p>two", "<p>one<p>two", "one<p>two", "<b>one</b><div>two"):
        assert [b.text for b in html_text.leaf_blocks(page + rest)] == ["one", "two"]
    assert [b.text for b in html_text.leaf_blocks("<head><script>x</script></head><p>a<!-- b <p>c")] == ["a"]
    assert [(b.text, b.link_chars) for b in html_text.leaf_blocks("<p>a <a href=x>bc</a> d<p><a>e</p>f")] == [("a bc d", 2), ("e", 1), ("f", 0)]


def test_deep_and_broken_pages_take_linear_time():
    import time

    began = time.time()
    for piece in ("<div>", "<div class=x>w", "<center>", "<b>x", "<i><b>", "</p>", "<!", "<a ", "<a '\">", "<li>y", "<table><tr><td>z", "</script", "<p><a>", "&"):
        html_text.leaf_blocks(piece * 100_000 + "<p>end")
    html_text.leaf_blocks("".join(f"<div class=k{chr(97 + i % 26)}{chr(97 + i // 26 % 26)}{chr(97 + i // 676 % 26)}>" for i in range(20_000)))
    assert time.time() - began < 60


def test_main_text_of_a_page_of_another_hand(shipped):
    """A layout that no generator of this library draws."""
    words = "the river ran past the mill, and the miller's two sons watched the boats go down to the sea until evening came."
    page = (
        "<!doctype html><html lang=en><head><meta charset=utf-8><title>River</title><link rel=stylesheet href=a.css>"
        "<body class='layout wide'><div id=top-bar><a href=/>Home</a> <a href=/news>News</a> <a href=/about>About us</a></div>"
        f"<main><article class=post><h1>The river</h1><p>{words.capitalize()}<p>{words.capitalize()} {words.capitalize()}</article></main>"
        "<aside class=sidebar><ul><li><a href=/1>Most read</a><li><a href=/2>Subscribe</a></ul></aside>"
        "<footer>Copyright © 2020. <a href=/terms>Terms</a> <a href=/privacy>Privacy</a></footer>"
    )
    got = html_text.extract_text(shipped.createDataFrame([(1, "u", page)], "page_id long, url string, html string")).first()
    assert words.capitalize() in got.text and "Subscribe" not in got.text and "Terms" not in got.text and "Home" not in got.text


def test_viterbi_equals_all_paths():
    import itertools
    import random

    r, model = random.Random(1), html_text.ChainField()
    for _ in range(50):
        model.moves = np.array([[r.uniform(-2, 2) for _ in range(2)] for _ in range(2)])
        scores = [r.uniform(-3, 3) for _ in range(6)]
        value = lambda p: sum(s for s, y in zip(scores, p) if y) + sum(model.moves[a, b] for a, b in zip(p, p[1:]))
        assert tuple(model.decode(scores)) == max(itertools.product((0, 1), repeat=6), key=value)


def test_audit_finds_damage(shipped):
    pages = shipped.read.parquet(f"{SF}/pages.parquet")
    long = "".join(map(chr, np.random.default_rng(1).integers(33, 0x2FFF, 400_000)))
    more = [(None, None, None), (1, "u", ""), (2, "u", "WARC/1.0\r\n\r\nWARC/1.0\r\nx: 1\r\n\r\n"), (9, "v", long)] + [(3, "u", "same")] * 50 + [(None, None, f"x{i}") for i in range(40)]
    odd = pages.unionByName(shipped.createDataFrame(more, pages.schema)).withColumns({c: F.lit(1) for c in ("i", "u", "t", "file", "copies", "shard")})
    hurt = odd.withColumn("html", F.when(F.col("page_id") == 7, F.concat("html", F.lit("x"))).otherwise(F.col("html")))
    got = fixity(odd, hurt).toPandas()
    assert len(got) == odd.count()
    bad = got[got.status != "intact"]
    assert set(bad.page_id) == {7} and (bad.status == "damaged").all()
    record = warc.read_record(*bad.iloc[0][["file", "offset", "length"]])
    assert record.startswith(b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:7>\r\nWARC-Date: 1970-01-01T00:00:00Z\r\n")
    html_of = {r.page_id: r.html for r in pages.collect()}
    assert record.endswith(b"\r\n\r\n" + html_of[7].encode() + b"\r\n\r\n") and hashlib.sha256(record).hexdigest() == bad.iloc[0].digest
    lost = fixity(odd, odd.where("page_id is null or page_id <> 9")).toPandas()
    assert (lost[lost.page_id == 9].status == "missing").all() and set(lost.status) <= {"intact", "missing", "damaged"}
    assert (fixity(odd, odd).toPandas().status == "intact").all()
    assert fixity(pages.where("false"), pages.where("false")).count() == 0


def test_files_are_bounded_and_damage_on_disk_is_found(shipped, monkeypatch):
    """A page longer than a file's bound ends a file; bytes changed on disk cost one record, cut files those behind the cut."""
    monkeypatch.setattr(warc, "FILE_BYTES", 20_000)
    monkeypatch.setattr(warc, "CHUNK", 1000)
    noise = "".join(map(chr, np.random.default_rng(2).integers(33, 0x2FFF, 60_000)))
    rows = [(i, f"u{i}", f"page {i} " * (i % 40) + noise[i * 50 : i * 50 + 400]) for i in range(300)] + [(1000, "long", noise)]
    folder = "file://" + shared_dir(shipped, "warc").removeprefix("file://")
    index = warc.write_warc(shipped.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), folder)
    at = index.toPandas().sort_values(["file", "offset"])
    assert at.file.nunique() > 2 and len(at) == 301
    for _, g in at.groupby("file"):
        assert (g.offset.iloc[1:].to_numpy() == (g.offset + g.length).iloc[:-1].to_numpy()).all()
        assert (g.offset < 20_000).all()
    held = warc.read_back(index).toPandas()
    assert sorted(held.digest) == sorted(at.digest)
    file = at[at.page_id == "1000"].iloc[0].file
    inside = at[(at.file == file) & (at.page_id != "1000")]
    one, cut = inside.iloc[3], at[at.page_id == "1000"].iloc[0]
    path = file.removeprefix("file://")
    data = bytearray(open(path, "rb").read())
    data[one.offset + 2 : one.offset + one.length] = b"\x00" * (one.length - 2)
    open(path, "wb").write(data[: cut.offset + 500])
    now = warc.read_back(index).toPandas().merge(at, on="page_id")
    assert set(now[now.digest_x != now.digest_y].page_id) == {one.page_id, "1000"}
    joined = gzip.decompress(open(at.iloc[0].file.removeprefix("file://"), "rb").read()) if at.iloc[0].file != file else b"WARC/1.0"
    assert joined.startswith(b"WARC/1.0")


def test_audit_of_lost_and_added_records(shipped):
    rows = [("a", i, i * 10, 10, f"d{i}") for i in range(300)] + [("b", i, i * 10, 10, f"e{i}") for i in range(5)]
    make = lambda r: shipped.createDataFrame(r, "shard string, seq long, offset long, length long, digest string")
    changed = [r if r[:2] != ("a", 123) else (*r[:4], "bad") for r in rows if r[:2] != ("b", 4)] + [("c", 0, 0, 10, "new")]
    got = {(r.shard, r.seq, r.status) for r in audit(make(rows), make(changed)).collect()}
    assert got == {("a", 123, "damaged"), ("b", 4, "missing"), ("c", 0, "extra")}
