"""Language identification by averaged hashed subword embeddings under a linear softmax."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vigilframe.config import materialize

SUBWORDS = (1, 2, 3)
BUCKETS = 1 << 15
DIMENSIONS = 16
# Training rows of a language, at the mean; a hash of the id decides, so nothing is sorted.
TRAIN_ROWS = 400
MAX_LANGUAGES = 1000
PIECE_CHARS = 200
EPOCHS = 4
RATE = 20.0
MINIBATCH = 64
# Right answers on held-back pieces that a rejection may cost.
REJECT_SHARE = 0.005
BLOCK = 1 << 18
_LETTER = re.compile(r"[^\W\d_]")


def subword_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all runs of 1 to 3 characters of a lower-cased text, a block of characters at a time."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32).astype(np.uint64)
    longest = max(SUBWORDS)
    for start in range(0, len(points), BLOCK):
        block = points[start : start + BLOCK + longest - 1]
        found = []
        run = np.zeros(len(block), np.uint64)
        for n in range(1, longest + 1):
            run = run[: len(block) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + block[n - 1 :] + np.uint64(1)
            if n in SUBWORDS:
                found.append(((run * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BUCKETS.bit_length() + 1))[:BLOCK])
        yield np.concatenate(found).astype(np.int64)


@dataclass
class Model:
    """Languages, the score that each bucket adds to them, a bias, a temperature and the least accepted score."""

    languages: list[str]
    scores: np.ndarray
    bias: np.ndarray
    temperature: float
    least: float

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not text or not self.languages or not _LETTER.search(text):
            return "und", 0.0, True
        total, n = np.zeros(len(self.languages)), 0
        for buckets in subword_buckets(text):
            total += self.scores[buckets].sum(axis=0, dtype=np.float64)
            n += len(buckets)
        p = _softmax((total / n + self.bias) / self.temperature)
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.least)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(texts: list[str], langs: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent on pieces of whole texts; every tenth text is held back for calibration."""
    languages = sorted(set(langs))
    pieces: tuple[list, list] = ([], [])
    for i, (text, lang) in enumerate(zip(texts, langs)):
        for start in range(0, len(text), PIECE_CHARS):
            piece = text[start : start + PIECE_CHARS]
            if _LETTER.search(piece):
                pieces[i % 10 == 9].append((np.concatenate(list(subword_buckets(piece))), languages.index(lang)))
    if not languages or not pieces[0]:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0, 0.0)
    rng = np.random.default_rng(seed)
    k = len(languages)
    embed = rng.normal(0, 1 / DIMENSIONS, (BUCKETS, DIMENSIONS))
    out, bias = np.zeros((DIMENSIONS, k)), np.zeros(k)
    steps = EPOCHS * -(-len(pieces[0]) // MINIBATCH)
    done = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(pieces[0]))
        for start in range(0, len(order), MINIBATCH):
            some = [pieces[0][i] for i in order[start : start + MINIBATCH]]
            hidden, ids, lengths = _hidden(embed, [b for b, _ in some])
            wrong = _softmax(hidden @ out + bias)
            wrong[np.arange(len(some)), [y for _, y in some]] -= 1
            wrong /= len(some)
            rate = RATE * (1 - done / steps)
            back = np.repeat((wrong @ out.T) / lengths[:, None], lengths, axis=0)
            out -= rate * hidden.T @ wrong / 10
            bias -= rate * wrong.sum(axis=0) / 10
            for d in range(DIMENSIONS):
                embed[:, d] -= rate * np.bincount(ids, back[:, d], BUCKETS) * 10
            done += 1
    held = pieces[1] or pieces[0]
    logits = np.concatenate([_hidden(embed, [b])[0] @ out + bias for b, _ in held])
    truth = np.array([y for _, y in held])
    heat = 2.0 ** np.arange(-3, 6.01, 0.25)
    loss = [-np.log(_softmax(logits / t)[np.arange(len(truth)), truth] + 1e-12).mean() for t in heat]
    temperature = float(heat[int(np.argmin(loss))])
    p = _softmax(logits / temperature)
    right = p.max(axis=1)[p.argmax(axis=1) == truth]
    least = float(np.quantile(right, REJECT_SHARE)) if len(right) else 0.0
    return Model(languages, (embed @ out).astype(np.float32), bias, temperature, least)


def _hidden(embed: np.ndarray, pieces: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    ids, lengths = np.concatenate(pieces), np.array([len(b) for b in pieces])
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
    return np.add.reduceat(embed[ids], starts) / lengths[:, None], ids, lengths


def training_rows(docs: DataFrame, doc_id: str, text: str, lang: str) -> DataFrame:
    """(text, lang) of about TRAIN_ROWS labelled rows of each language, chosen by a hash of the id."""
    labelled = docs.where(F.col(text).isNotNull() & F.col(lang).isNotNull())
    counts = materialize(labelled.groupBy(F.col(lang).alias("lang")).agg(F.count("*").alias("n")), "languages")
    counts = counts.orderBy(F.desc("n"), "lang").limit(MAX_LANGUAGES)
    # 2^20 classes of the hash: enough to take a few hundred rows of a very common language.
    part = F.pmod(F.xxhash64(F.col(doc_id)), F.lit(1 << 20)) / F.lit(float(1 << 20))
    rows = labelled.select(F.col(doc_id).alias("id"), F.col(text).alias("text"), F.col(lang).alias("lang"), part.alias("part"))
    return rows.join(F.broadcast(counts), "lang").where(F.col("part") < TRAIN_ROWS / F.col("n")).select("id", "text", "lang")


def identify(
    docs: DataFrame, train_on: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang"
) -> DataFrame:
    """Language of each whole text of ``docs``, learned from the labelled rows ``train_on``.

    The model is fitted on the driver from a bounded sample (TRAIN_ROWS rows of each of at most MAX_LANGUAGES languages,
    whole texts); a prediction reads nothing but the text. Scores are calibrated by a temperature on held-back texts;
    a score below the one that 99.5 % of right answers reach is marked ``rejected``.

    Returns doc_id, lang_pred, score, rejected, a row per row. A null text, one without letters, and every text where
    nothing could be learned, is ``und`` with score 0. Repeated rows get equal answers; other columns are not read.
    """
    sample = training_rows(train_on, doc_id, text, lang).collect()
    sample = sorted((str(r["id"]), r["text"], r["lang"]) for r in sample)
    model = train([t for _, t, _ in sample], [y for _, _, y in sample])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [model.predict(t.as_py()) for t in batch.column("t")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([s[0] for s in said], pa.string()), pa.array([s[1] for s in said], pa.float64()), pa.array([s[2] for s in said], pa.bool_())],
                ["doc_id", "lang_pred", "score", "rejected"],
            )

    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("t"))
    return read.mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double, rejected boolean")
