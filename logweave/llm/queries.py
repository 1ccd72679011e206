"""Registered queries of the operators, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, exact_dedup, language_id, license_scan, line_dedup, mixing, ngram_join, secret_scan, token_alignment, token_output, toxicity, url_filter, whitening
from .common import id_crc, table


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


END_ID = 1


#: Target token shares by domain of the mixing query and stage.
TARGETS = {"good": 0.86, "poor": 0.12, "toxic": 0.02}


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The label table as domains: toxic before quality; one row an id."""
    labels = table(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return labels.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").when(F.col("quality") == 0, "poor").alias("domain"))


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = license_scan.scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.size("sentence_ids").cast("long").alias("n_sentences"), F.array_join("sentence_ids", ",").alias("sentence_ids"), F.array_join("licenses", ",").alias("licenses"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.drop_recurring(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    rated = mixing.mix(table(spark, sf_dir, "documents").select("doc_id", "text"), domain_labels(spark, sf_dir), TARGETS)
    names = sorted(TARGETS)
    return rated.select("doc_id", "n_tokens", *[F.col("p")[k].alias(f"p_{d}") for k, d in enumerate(names)], "rate", "copies", *[F.col("reached")[k].alias(f"reached_{d}") for k, d in enumerate(names)])


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    manifest = token_output.write_shards(table(spark, sf_dir, "documents"), vocabulary(), END_ID)
    return token_output.read_back(manifest)


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), n=4, percent=85)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").where(F.col("toxic").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    held_out = id_crc("doc_id") % 3 == 1
    model = toxicity.fit(toxicity.labelled_sample(docs, labels.where(~held_out)))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", (id_crc("doc_id") % 3 == 1).alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_matches(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), window=10)
    judged = decontaminate.contamination(found)
    return judged.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = exact_dedup.dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_scan.find_secrets(table(spark, sf_dir, "documents").select("doc_id", "text"))
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    told = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*secret_scan.BASE_KINDS))
    return found.select("doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"), F.sha2(told(base).cast("binary"), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language_id.fit(docs.where(id_crc("doc_id") % 4 != 2))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_crc("doc_id") % 4 == 2).alias("held_out"), "lang_pred", "score")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_alignment.align(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json"), vocabulary("piece_bpe_32k.model"))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def page_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages whose id is labelled: block if toxic or of low quality."""
    labels = table(spark, sf_dir, "labels").groupBy(F.col("doc_id").alias("page_id")).agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    verdict = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), "block").when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), "allow")
    return table(spark, sf_dir, "pages").select("page_id", "url").join(labels, "page_id").select("url", verdict.alias("verdict"))


def op13_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), url_filter.mine(page_labels(spark, sf_dir)), url_filter.RULES)


SQL6 = r"""
WITH dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
bw AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
q AS (SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[p:p + least(10, len(w)) - 1], ' ') AS g FROM bw, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS t(p) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM q),
d AS (SELECT doc_id, n, p, array_to_string(w[p:p + n - 1], ' ') AS g FROM dw, sizes, unnest(range(1, len(w) - n + 2)) AS t(p) WHERE len(w) >= n),
hit AS (SELECT d.doc_id, q.item_id, d.p, d.n FROM d JOIN q ON d.g = q.g AND d.n = q.n),
spot AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM hit, unnest(range(p, p + n)) AS t(i) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hit) GROUP BY doc_id)
SELECT dw.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN spot USING (doc_id) LEFT JOIN items USING (doc_id)
"""

SQL7 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY h ORDER BY n DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY h) AS group_size FROM t)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""

SQL4 = r"""
WITH RECURSIVE dw AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[p:p + 3], ' ') AS g FROM dw, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS t(p) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * k >= 85 * (na.n + nb.n - k)),
r AS (SELECT doc_id, doc_id AS c FROM documents UNION SELECT r.doc_id, l.b FROM r JOIN l ON l.a = r.c)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(r.c) AS component_id
FROM documents d JOIN r ON r.doc_id = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id GROUP BY d.doc_id, n.n
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_license_scan, op2_line_dedup, op3_token_output, op4_ngram_join, op5_toxicity, op6_decontaminate, op7_exact_dedup, op8_secret_scan, op9_language_id, op10_mixing, op11_token_alignment, op12_whitening, op13_url_filter)}


def oracle_sql() -> dict[str, str]:
    return {"op1_license_scan": license_scan.oracle(), "op2_line_dedup": line_dedup.oracle(), "op4_ngram_join": SQL4, "op6_decontaminate": SQL6, "op7_exact_dedup": SQL7}
