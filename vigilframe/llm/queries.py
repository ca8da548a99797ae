"""Registered queries of the training-data operators and the SQL they must equal."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


DECONTAMINATE_SQL = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS k
        FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM bw WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
places AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS k
           FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, sizes WHERE len(w) >= n)),
hit AS (SELECT p.doc_id, p.s, p.n, v.item_id FROM places p JOIN win v ON p.k = v.k AND p.n = v.n),
cov AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(s, s + n)) AS p FROM hit) GROUP BY 1),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY 1)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items,
       sha256(coalesce(i.ids, '')) AS items_sha256, c.n_hit IS NOT NULL AS contaminated
FROM dw d LEFT JOIN cov c USING (doc_id) LEFT JOIN its i USING (doc_id)
"""


@query("op1_decontaminate", DECONTAMINATE_SQL)
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilframe.llm.decontaminate import contamination

    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("text_hash")


@query("op8_mix")
def op8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilframe.llm.curriculum import mix

    return mix(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op9_near_duplicates")
def op9_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilframe.llm.neardup import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


@query("op3_quality_outliers")
def op3_quality_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilframe.llm.quality import quality

    return quality(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op5_token_files")
def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilframe.llm.tokens import token_output

    return token_output(table(spark, sf_dir, "documents"))


@query("op2_language")
def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilframe.llm.langid import identify

    held_out = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2
    docs = table(spark, sf_dir, "documents")
    said = identify(docs, docs.where(~held_out))
    return said.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


@query("op4_personal_data")
def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilframe.llm.pii import personal_data

    return personal_data(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op6_main_text")
def op6_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilframe.llm.html_text import extract_text

    return extract_text(table(spark, sf_dir, "pages"))


@query("op10_merkle_fixity")
def op10_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audits a replica of the pages in which every page with id 7 modulo 50 has a byte changed."""
    from vigilframe.llm.warc import fixity

    pages = table(spark, sf_dir, "pages")
    hurt = F.concat(F.lit("~"), F.substring("html", 2, 1 << 30))
    replica = pages.withColumn("html", F.when((F.col("page_id") % 50 == 7) & (F.octet_length("html") > 0), hurt).otherwise(F.col("html")))
    return fixity(pages, replica)


@query("op7_licenses")
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilframe.llm.licenses import scan

    return scan(table(spark, sf_dir, "documents")).drop("text_hash")


@query("op11_sharding")
def op11_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilframe.llm.sharding import assign

    return assign(table(spark, sf_dir, "documents")).drop("key", "tie").withColumn("grown_shard", F.lit(None).cast("int"))


COLLOCATIONS_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
runs AS (SELECT lang, list_filter(regexp_split_to_array(p, '[\x20\x09]+'), lambda x: x <> '') AS w FROM pieces),
words AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM runs GROUP BY 1),
places AS (SELECT lang, k, array_to_string(w[s:s + k - 1], ' ') AS phrase
           FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS s FROM runs, range(1, 6) t(k) WHERE len(w) >= k)),
f AS (SELECT lang, k, phrase, count(*) AS f FROM places GROUP BY ALL HAVING count(*) >= 100),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1),
inner_ AS (SELECT DISTINCT lang, array_to_string(w[s:s + m - 1], ' ') AS phrase, a
           FROM (SELECT lang, w, a, m, unnest(range(1, k - m + 2)) AS s FROM cand, range(2, 5) t(m) WHERE m < k)),
keep AS (SELECT c.* FROM cand c WHERE NOT EXISTS (SELECT 1 FROM inner_ i WHERE i.lang = c.lang AND i.phrase = c.phrase AND 100 * i.a >= 100 * c.a)),
cuts AS (SELECT lang, phrase, a, cut, array_to_string(w[:cut], ' ') AS p, array_to_string(w[cut + 1:], ' ') AS q FROM (SELECT *, unnest(range(1, k)) AS cut FROM keep)),
scored AS (SELECT c.lang, c.phrase, c.a, c.cut, l.f AS l, r.f AS r, n.n, CAST((1000::HUGEINT * c.a * n.n) // (l.f::HUGEINT * r.f) AS BIGINT) AS score
           FROM cuts c JOIN f l ON l.lang = c.lang AND l.phrase = c.p JOIN f r ON r.lang = c.lang AND r.phrase = c.q JOIN words n ON n.lang = c.lang),
weakest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM weakest)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= 2000
"""


@query("op12_collocations", COLLOCATIONS_SQL)
def op12_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilframe.llm.phrases import collocations

    return collocations(table(spark, sf_dir, "documents"))


@query("op13_spelling_variants")
def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from vigilframe.llm.variants import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))
