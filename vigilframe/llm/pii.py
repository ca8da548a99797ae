"""Personal data: base rules, and bootstrapped contextual extraction of identifiers that no rule covers."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vigilframe.config import materialize
from vigilframe.llm.common import small_side

KINDS = ("email", "ip", "card", "phone")
# A longer run without white space is no identifier.
LONGEST = 64
CONTEXT_WORDS = 2
# Different instances that a pattern needs, smoothing of its score, least score of a discovery, rounds.
SUPPORT = 3
SMOOTHING = 0.5
LEAST_SCORE = 0.8
ROUNDS = 3

_ANY = re.compile(r"[0-9@]")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_TOKEN = re.compile(r"[0-9@]\S*")
_DIGITS = re.compile(r"[^0-9]")


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind index, end) of the base rules, in order; each kind leftmost and without overlap."""
    if not _ANY.search(text):
        return []
    spans = []
    free, at = 0, text.find("@")
    while at >= 0:
        left = at
        while left > free and text[left - 1] in _LOCAL:
            left -= 1
        domain = _DOMAIN.match(text, at + 1) if left < at else None
        free = domain.end() if domain else at + 1
        if domain:
            spans.append((left, 0, free))
        at = text.find("@", free)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            spans.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = _DIGITS.sub("", m.group())
        if 12 <= len(digits) <= 19 and _luhn(digits):
            spans.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 9 <= len(_DIGITS.sub("", m.group())) <= 15:
            spans.append((m.start(), 3, m.end()))
    return sorted(spans)


def _shapes(token: str) -> list[int]:
    """Kinds that a token could be at all."""
    digits = len(_DIGITS.sub("", token))
    rest = len(token) - digits
    kinds = [0] if "@" in token.strip("@") else []
    if token.count(".") == 3 and rest == 3:
        kinds.append(1)
    if 12 <= digits <= 19 and rest <= 4:
        kinds.append(2)
    if 7 <= digits <= 15 and rest <= 5:
        kinds.append(3)
    return kinds


def _hash(s: str) -> int:
    return xxhash.xxh64_intdigest(s) - (1 << 63)


def _contexts(text: str, start: int, end: int) -> list[int]:
    """Lexical patterns around a span: the words before it and the words after it, digits as 0."""
    before = text[max(0, start - 80) : start].lower().split()[-CONTEXT_WORDS:]
    after = text[end : end + 80].lower().split()[:CONTEXT_WORDS]
    out = []
    for side, words in (("<", before), (">", after)):
        if len(words) == CONTEXT_WORDS:
            out.append(_hash(side + re.sub("[0-9]", "0", " ".join(words))))
    return out


def mentions(text: str, spans: list[tuple[int, int, int]]) -> list[dict]:
    """Base instances and identifier-like tokens outside of them, with their patterns."""
    found = [
        {"kinds": [k], "seed": k, "start": s, "end": e, "instance": _hash(text[s:e].lower()), "patterns": _contexts(text, s, e)}
        for s, k, e in spans
    ]
    ends, i = [(s, e) for s, _, e in spans], 0
    done = 0
    for m in _TOKEN.finditer(text):
        start, end = m.start(), m.end()
        while start > done and end - start <= LONGEST and not text[start - 1].isspace():
            start -= 1
        done = end
        while end > start and not text[end - 1].isalnum():
            end -= 1
        while start < end and not text[start].isalnum():
            start += 1
        while i < len(ends) and ends[i][1] <= start:
            i += 1
        if not 5 <= end - start <= LONGEST or any(s < end and start < e for s, e in ends[i : i + 4]):
            continue
        kinds = _shapes(text[start:end])
        if kinds:
            where = _contexts(text, start, end)
            found.append({"kinds": kinds, "seed": None, "start": start, "end": end, "instance": _hash(text[start:end].lower()), "patterns": where})
    return found


_SPAN = pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())])
_MENTION = pa.struct(
    [("kinds", pa.list_(pa.int32())), ("seed", pa.int32()), ("start", pa.int64()), ("end", pa.int64()), ("instance", pa.int64()), ("patterns", pa.list_(pa.int64()))]
)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans, around = [], []
        for t in batch.column("t"):
            text = t.as_py() or ""
            found = base_spans(text)
            spans.append([{"start": s, "kind": k, "end": e} for s, k, e in found])
            around.append(mentions(text, found) if found or _ANY.search(text) else [])
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_hash"), pa.array(spans, pa.list_(_SPAN)), pa.array(around, pa.list_(_MENTION))],
            ["doc_id", "text_hash", "base", "mentions"],
        )


def score_instances(edges: DataFrame, seeds: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(instance, kind, score) over the graph of patterns and instances.

    A pattern scores, for a kind, the sum of its instances' scores over their number; an instance that is no seed
    scores one minus the product of what its patterns leave open. Seeds score 1. Patterns of fewer than SUPPORT
    instances are left out. Each round is two grouped sums over the edges.
    """
    sizes = edges.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    graph = materialize(edges.join(sizes, "pattern"), "graph")
    known = seeds.select("instance", "kind", F.lit(1.0).alias("score"))
    scores = known
    for _ in range(rounds):
        patterns = (
            graph.join(scores, "instance")
            .groupBy("pattern", "kind")
            .agg((F.sum("score") / (F.first("n") + SMOOTHING)).alias("p"))
            .where("p > 0.05")
        )
        reached = graph.join(patterns, "pattern").groupBy("instance", "kind").agg(
            (1 - F.exp(F.sum(F.log(F.greatest(1 - F.col("p"), F.lit(1e-6)))))).alias("score")
        )
        fresh = reached.join(seeds.select("instance").distinct(), "instance", "left_anti").where("score >= 0.5")
        scores = materialize(known.unionByName(fresh), "scores")
    return scores


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])))


def personal_data(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Personal data of every whole text: the base rules' spans and those that the corpus's own contexts reveal.

    Instances of the base rules are seeds. The words before and after an instance are patterns; tokens that look like
    an identifier but match no rule are candidates. Patterns and instances are scored in turn over the whole corpus;
    a candidate whose score for a kind it could be reaches LEAST_SCORE becomes a span of that kind.

    Returns doc_id, text_hash, n_email, n_ip, n_card, n_phone (base), base_sha256, n_found, spans; one row per
    different (doc_id, text). A null or empty text has none. Other columns are not read.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    read = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_hash"), F.col(text).alias("t"))
    struct = "array<struct<kinds:array<int>,seed:int,start:long,end:long,instance:long,patterns:array<long>>>"
    rows = read.mapInArrow(
        _extract, f"doc_id {kind}, text_hash long, base array<struct<start:long,kind:int,end:long>>, mentions {struct}"
    )
    rows = materialize(rows, "mentions")
    all_mentions = rows.select("doc_id", "text_hash", F.explode("mentions").alias("m")).select("doc_id", "text_hash", "m.*")
    edges = all_mentions.select("instance", F.explode("patterns").alias("pattern")).distinct()
    seeds = all_mentions.where("seed is not null").select("instance", F.col("seed").alias("kind")).distinct()
    scores = score_instances(edges, materialize(seeds, "seeds"))
    good = materialize(scores.where(F.col("score") >= LEAST_SCORE).select("instance", "kind", "score"), "good")
    open_ones = all_mentions.where("seed is null").select("doc_id", "text_hash", "start", "end", "instance", F.explode("kinds").alias("kind"))
    found = (
        open_ones.join(small_side(good), ["instance", "kind"])
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("start", "kind", "end")).alias("found"))
    )
    same = F.col("r.doc_id").eqNullSafe(F.col("f.doc_id")) & (F.col("r.text_hash") == F.col("f.text_hash"))
    whole = rows.drop("mentions").dropDuplicates(["doc_id", "text_hash"]).alias("r").join(found.alias("f"), same, "left")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    found_spans = F.coalesce("found", none)
    # one parameter only: Spark hands a second one the place in the array, whatever its default
    counts = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{name}") for k, name in enumerate(KINDS)]  # noqa: B023
    return whole.select(
        "r.doc_id", F.col("r.text_hash").alias("text_hash"), *counts,
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        F.size(found_spans).cast("long").alias("n_found"),
        _joined(F.array_sort(F.concat("base", found_spans))).alias("spans"),
    )
