"""Queries that choose rows: filter audit, importance resampling, exact search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from boxweave.llm.common import table
from boxweave.llm.interactions import filter_interactions
from boxweave.llm.registry import query
from boxweave.llm.resample import resampled
from boxweave.llm.topk import top_products


@query(
    "op11_filter_interactions",
    r"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(lang, '') AS part FROM documents),
    firsts AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
    w AS (SELECT d.*, regexp_extract_all(d.text, '[^\x20\x09-\x0D]+') AS words, coalesce(firsts.least < d.doc_id, false) AS copy FROM d JOIN firsts USING (text)),
    m AS (
        SELECT part, (len(words) < 100)::INT + 2 * (100 * len(list_distinct(words)) < 80 * len(words))::INT
            + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * copy::INT AS mask,
            coalesce(l.quality = 1, false) AS good, coalesce(l.toxic = 1, false) AS toxic
        FROM w LEFT JOIN (SELECT doc_id, max(quality) AS quality, max(toxic) AS toxic FROM labels GROUP BY doc_id) l USING (doc_id)),
    c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS t FROM m GROUP BY ALL),
    o AS (SELECT '' AS filter_order UNION ALL SELECT o.filter_order || f FROM o, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) x WHERE NOT contains(o.filter_order, f)),
    s AS (
        SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS own,
            list_sum([0] || [1 << (ascii(filter_order[i]) - 65) FOR i IN range(1, step)])::INT AS earlier
        FROM o, (SELECT unnest(range(1, 6)) AS step) k WHERE length(filter_order) = 5)
    SELECT part, filter_order, step, sum(n * (mask & (own | earlier) = 0)::INT)::BIGINT AS kept, sum(n * gone)::BIGINT AS removed,
        sum(n * (mask & own <> 0 AND mask & earlier <> 0)::INT)::BIGINT AS redundant, sum(n * (mask = own)::INT)::BIGINT AS unique_fails,
        sum(g * gone)::BIGINT AS good_lost, sum(t * gone)::BIGINT AS toxic_lost, (sum(sum(n * gone)) OVER (PARTITION BY part, own))::BIGINT AS shapley
    FROM (SELECT *, (mask & own <> 0 AND mask & earlier = 0)::INT AS gone FROM c, s) GROUP BY part, filter_order, step, own
    """,
)
def op11_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each of five filters removes in every order, by language."""
    return filter_interactions(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))


@query("op12_importance_resampling")
def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the benchmark texts, with weight, score and rank."""
    return resampled(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query(
    "op13_exact_topk",
    """
    WITH v AS (
        SELECT vec_id, [floor(256 * x::DOUBLE)::BIGINT FOR x IN embedding] AS c FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
    s AS (
        SELECT q.vec_id AS query_id, x.vec_id, list_sum([q.c[i] * x.c[i] FOR i IN range(1, 1 + len(q.c))])::BIGINT AS score
        FROM v q JOIN v x ON q.vec_id % 50 = 0 AND x.vec_id <> q.vec_id)
    SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s) WHERE rank <= 5
    """,
)
def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best partners of each query vector."""
    return top_products(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
