"""Stages of the corpus pipeline, each against its operator on its own input."""

import corpus_pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from vigilframe.llm.curriculum import mix
from vigilframe.llm.decontaminate import contamination

SF = "/root/testdata/sf0.001"


def test_stages(shipped, odd, tmp_path):
    docs = odd.select("doc_id", "text", "lang", "source", "n_chars")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path / str(k))
        stage(shipped, docs, SF).write.parquet(path)
        out = shipped.read.parquet(path)
        if name != "token output":
            assert out.columns == docs.columns
            assert out.join(docs.select("doc_id", "text").distinct(), ["doc_id", "text"], "left_anti").where("doc_id is not null").count() == 0
        if name == "quality rules":
            assert out.where(F.col("text").isNull() | (F.length("text") < 50)).count() == 0
        if name == "near duplicates":
            assert out.count() < docs.count() and out.groupBy("text").count().where("count > 1").count() == 0
        if name == "decontamination":
            bench = shipped.read.parquet(f"{SF}/benchmark.parquet")
            assert out.count() == docs.join(contamination(docs, bench).where("not contaminated"), "doc_id", "left_semi").count()
        if name == "mixing":
            want = mix(docs).where("taken > 0").agg(F.sum(F.round(F.col("taken") / F.col("size")))).first()[0]
            assert out.count() == want
        if name == "token output":
            assert out.count() == docs.count()
        docs = out


def test_rejected_rows_leave_without_moving_the_rest(shipped, monkeypatch):
    docs = shipped.range(3000).select(F.when(F.col("id") % 500 != 7, F.col("id") % 2900).alias("doc_id"), F.concat_ws(" ", F.lit("text"), F.col("id") % 700).alias("text"))
    hashed = docs.withColumn("text_hash", F.xxhash64("text"))
    rejected = hashed.where("doc_id % 40 = 3 or (doc_id is null and text like '%7')")
    want = sorted(str(r) for r in docs.where("not coalesce(doc_id % 40 = 3, false) and not (doc_id is null and text like '%7')").collect())
    assert sorted(map(str, corpus_pipeline._without(docs, rejected).collect())) == want
    monkeypatch.setattr(corpus_pipeline, "BROADCAST_ROWS", 10)
    moved, keep = [], corpus_pipeline.may_match
    monkeypatch.setattr(corpus_pipeline, "may_match", lambda *a: moved.append(keep(*a)) or moved[-1])
    assert sorted(map(str, corpus_pipeline._without(docs, rejected).collect())) == want
    assert moved[0].where("__may").count() < 100


def test_text_batches_are_bounded_in_bytes(spark):
    """Whole texts reach Python in batches of some 4 MB; the session's own bound is as before afterwards."""
    from vigilframe.config import ARROW_BYTES, TEXT_BATCH_BYTES, materialize

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes])], ["n"])

    before = spark.conf.get(ARROW_BYTES)
    texts = spark.range(600, numPartitions=1).select(F.repeat(F.lit("word "), 10_000).alias("t"))
    held = materialize(texts.mapInArrow(sizes, "n long"), "sizes", TEXT_BATCH_BYTES).agg(F.max("n")).first()[0]
    assert held < 1.1 * TEXT_BATCH_BYTES
    assert spark.conf.get(ARROW_BYTES) == before


def test_word_hashes_keep_a_bounded_number_of_words():
    from vigilframe.llm.words import WordHashes

    words = [b"%d" % i for i in range(120_000)]
    hashes = WordHashes()
    assert (hashes.of(words + words[:10])[-10:] == hashes.of(words)[:10]).all()
    assert len(hashes) <= 50_000
