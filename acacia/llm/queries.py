"""The registered queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from acacia.llm import decontaminate, licenses, mixing, pages, pii, repeats, repair, resample, simhash, tokens, topk, toxicity, urls


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("removal_spans")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.scored(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return pii.report(docs, pii.fit(docs))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.main_text(_table(spark, sf_dir, "pages"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.selected(_table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(_table(spark, sf_dir, "pages"), urls.rule_table(spark))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.without_repeats(_table(spark, sf_dir, "documents")).drop("removed_spans")


def op10_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"))


def op11_sentencepiece(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    """``model``: the vocabulary file, read on the driver; the public 32,000 pieces where none is given."""
    if model is None:
        from public_tokenizers import path

        model = path("piece_bpe_32k.model")
    out = tokens.encoded(_table(spark, sf_dir, "documents").select("doc_id", "text"), tokens.Vocabulary.read(model))
    return out.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample.drawn(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.repaired(_table(spark, sf_dir, "conversations"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_toxicity,
        op3_license_scan,
        op4_pii,
        op5_html_extraction,
        op6_simhash,
        op7_mixing,
        op8_url_filter,
        op9_substring_dedup,
        op10_top_k,
        op11_sentencepiece,
        op12_importance,
        op13_conversations,
    )
}

_RULES = ", ".join(f"('{host}', '{path}', '{verdict}')" for host, path, verdict in urls.RULES)

_ALNUM, _SPACED = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", r"[^\x20\x09-\x0D]+"

ORACLES = {
    "op1_decontamination": f"""
WITH d AS (
  SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '{_ALNUM}') AS w FROM documents
),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), '{urls.UPPER}', '{urls.LOWER}'), '{_ALNUM}') AS w FROM benchmark WHERE item_id IS NOT NULL
),
phrases AS (
  SELECT DISTINCT item, w[k : k + 12] AS phrase FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS k FROM i WHERE len(w) > 0)
),
sizes AS (SELECT DISTINCT len(phrase) AS size FROM phrases),
places AS (
  SELECT n, k, size, w[k : k + size - 1] AS phrase FROM (SELECT n, w, size, unnest(range(1, len(w) - size + 2)) AS k FROM d, sizes WHERE len(w) >= size)
),
found AS (SELECT n, k, size, item FROM places JOIN phrases USING (phrase)),
hits AS (SELECT n, count(DISTINCT p) AS n_hit FROM (SELECT n, unnest(range(k, k + size)) AS p FROM (SELECT DISTINCT n, k, size FROM found)) GROUP BY n),
items AS (SELECT n, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT n, item FROM found) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits USING (n) LEFT JOIN items USING (n)
""",
    "op9_substring_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS n, doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') AS w FROM documents),
windows AS (
  SELECT n, k, sha256(array_to_string(w[k : k + 34], ' ')) AS name FROM (SELECT n, w, unnest(range(1, len(w) - 33)) AS k FROM d WHERE len(w) >= 35)
),
twice AS (SELECT name FROM windows GROUP BY name HAVING count(*) > 1),
gone AS (SELECT DISTINCT n, unnest(range(k, k + 35)) AS p FROM windows SEMI JOIN twice USING (name)),
words AS (SELECT n, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT n, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n_kept FROM words ANTI JOIN gone USING (n, p) GROUP BY n)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (n)
""",
    "op7_mixing": mixing.oracle(),
    "op8_url_filter": f"""
WITH rules(rule_host, rule_path, rule_verdict) AS (VALUES {_RULES}),
rest AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
),
located AS (
  SELECT row_number() OVER () AS n, page_id,
    translate(regexp_extract(rest, '^[^/?#]*'), '{urls.UPPER}', '{urls.LOWER}') AS host,
    regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM rest
),
fitting AS (
  SELECT n, rule_host || rule_path AS rule, rule_verdict,
    row_number() OVER (PARTITION BY n ORDER BY length(rule_host || rule_path) DESC, length(rule_host) DESC, rule_verdict DESC) AS place
  FROM located JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
)
SELECT page_id, host, path, rule, coalesce(rule_verdict, 'allow') AS verdict
FROM located LEFT JOIN (SELECT * FROM fitting WHERE place = 1) USING (n)
""",
    "op10_top_k": """
WITH whole AS (
  SELECT row_number() OVER () AS n, CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(1024 * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.n, q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON q.vec_id % 100 = 0 AND c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY n ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored QUALIFY rank <= 10
""",
}
