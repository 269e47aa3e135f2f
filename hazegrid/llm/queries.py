"""Queries of this package: each operator over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hazegrid.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


@query(
    "op1_url_filter",
    """
    WITH rules(r_host, r_path, r_verdict) AS (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'),
           ('example.org', '/en/1', 'block'), ('com', '/fr/', 'allow'), ('com', '/de/', 'block')),
    parts AS (
      SELECT page_id,
             coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
      FROM pages),
    best AS (
      SELECT host, path, max_by(r_host || r_path, length(r_host || r_path)) AS rule,
             max_by(r_verdict, length(r_host || r_path)) AS verdict
      FROM (SELECT DISTINCT host, path FROM parts) JOIN rules
        ON (host = r_host OR ends_with(host, '.' || r_host)) AND starts_with(path, r_path)
      GROUP BY host, path)
    SELECT page_id, parts.host, parts.path, rule, coalesce(verdict, 'allow') AS verdict
    FROM parts LEFT JOIN best USING (host, path)""",
)
def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazegrid.llm.url_filter import judge_urls

    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules).drop("url")


@query(
    "op2_decontaminate",
    r"""
    WITH d AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
    b AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
    items AS (
      SELECT DISTINCT item_id, least(len(w), 10) AS n,
             array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
      FROM b, unnest(generate_series(1, greatest(len(w) - 9, 1))) AS t(i) WHERE len(w) > 0),
    grams AS (
      SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g
      FROM d, (SELECT DISTINCT n FROM items), unnest(generate_series(1, len(w) - n + 1)) AS t(i)
      WHERE len(w) >= n),
    met AS (SELECT doc_id, item_id, i, grams.n AS n FROM grams JOIN items ON grams.n = items.n AND grams.g = items.g),
    hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit
            FROM (SELECT doc_id, unnest(generate_series(i, i + n - 1)) AS p FROM met) GROUP BY doc_id),
    its AS (SELECT doc_id, count(*) AS n_items, string_agg(k, ',' ORDER BY k) AS ids
            FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS k FROM met) GROUP BY doc_id)
    SELECT doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
           coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
           coalesce(n_hit, 0) > 0 AS contaminated
    FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)""",
)
def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazegrid.llm.decontaminate import find_leaks

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    listed = F.array_join(F.array_sort(F.col("items").cast("array<string>")), ",")
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(listed, 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


@query(
    "op3_line_dedup",
    r"""
    WITH lines AS (
      SELECT doc_id, i, l, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS k
      FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
                   generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)
      WHERE trim(l, ' ') <> ''),
    windows AS (
      SELECT a.doc_id, a.k, a.l || chr(10) || b.l || chr(10) || c.l AS g
      FROM lines a JOIN lines b ON a.doc_id = b.doc_id AND b.k = a.k + 1
                   JOIN lines c ON a.doc_id = c.doc_id AND c.k = a.k + 2),
    later AS (SELECT doc_id, k FROM (
      SELECT doc_id, k, row_number() OVER (PARTITION BY g ORDER BY doc_id, k) AS r FROM windows) WHERE r > 1),
    gone AS (SELECT DISTINCT lines.doc_id, i FROM later JOIN lines
             ON lines.doc_id = later.doc_id AND lines.k BETWEEN later.k AND later.k + 2),
    every AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS l,
                     generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
    kept AS (SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS t
             FROM every ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id),
    removed AS (SELECT doc_id, count(*) AS n_removed FROM gone GROUP BY doc_id)
    SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines,
           coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
    FROM documents LEFT JOIN removed USING (doc_id) LEFT JOIN kept USING (doc_id)""",
)
def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazegrid.llm.line_dedup import dedup_lines

    cleaned = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    kept = F.sha2(F.coalesce("text", F.lit("")), 256)
    return cleaned.select("doc_id", "n_lines", "n_removed", kept.alias("kept_sha256"))


@query("op4_suffix_dedup")
def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazegrid.llm.suffix_dedup import dedup_bytes

    found = dedup_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"))
    spans = F.size("spans").cast("bigint").alias("n_spans")
    return found.select("doc_id", "n_bytes", "n_removed", spans, F.sha2("kept", 256).alias("kept_sha256"))


@query("op5_jaccard_join")
def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazegrid.llm.jaccard_join import jaccard_groups

    return jaccard_groups(table(spark, sf_dir, "documents"))


@query("op6_toxicity")
def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazegrid.llm.toxicity import fit, in_training, score_texts

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_texts(docs, fit(docs, table(spark, sf_dir, "labels")))
    return scored.select("doc_id", (~in_training(F.col("doc_id"))).alias("held_out"), "score", "predicted")


PIECE_MODEL = "piece_bpe_32k.model"


@query("op7_sentencepiece")
def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazegrid.llm.sentencepiece_codec import round_trip

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return round_trip(docs, public_tokenizers.path(PIECE_MODEL)).drop("text")


@query("op8_token_files")
def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazegrid.llm.token_file import read_token_files, write_token_files

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    tokenizer = public_tokenizers.path("byte_bpe_50k.json")
    manifest = write_token_files(docs, tokenizer, public_tokenizers.PATTERN)
    return read_token_files(manifest).withColumnRenamed("id", "doc_id")


@query("op9_embedding_dedup")
def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazegrid.llm.embedding_dedup import near_vectors

    found = near_vectors(table(spark, sf_dir, "embeddings"))
    return found.withColumn("kept", F.col("vec_id") == F.col("component_id"))


@query("op10_token_counts")
def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazegrid.llm.token_counts import count_tokens

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).drop("text")


@query(
    "op11_topk_search",
    """
    WITH entries AS (SELECT vec_id, unnest(embedding)::DOUBLE AS e, generate_subscripts(embedding, 1) AS i FROM embeddings),
    v AS (SELECT vec_id, i, floor(256 * e)::BIGINT AS x FROM entries
          WHERE vec_id IN (SELECT vec_id FROM entries GROUP BY vec_id HAVING count(*) = count(e) AND bool_and(isfinite(e)))),
    scores AS (
      SELECT q.vec_id AS query_id, c.vec_id, sum(q.x * c.x)::BIGINT AS score
      FROM v q JOIN v c ON q.i = c.i AND q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0 GROUP BY q.vec_id, c.vec_id)
    SELECT query_id, rank, vec_id, score FROM (
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scores)
    WHERE rank <= 5""",
)
def op11_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazegrid.llm.topk_search import top_k

    vectors = table(spark, sf_dir, "embeddings")
    found = top_k(vectors, vectors.where(F.col("vec_id") % 50 == 0))
    return found.withColumn("score", F.col("score").try_cast("bigint"))


@query("op12_spelling_variants")
def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazegrid.llm.spelling import group_variants

    return group_variants(table(spark, sf_dir, "documents"))


@query("op13_embedding_whitening")
def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    from hazegrid.llm.whitening import whiten

    # A deviation that no long holds is null.
    return whiten(table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("bigint"))
