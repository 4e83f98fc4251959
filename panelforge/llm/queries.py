"""The thin queries that __spark_entry__.py registers, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .common import read


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import personal_data

    return personal_data(read(spark, sf_dir, "documents"))


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_classifier import quality_scores

    return quality_scores(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality_rules import quality_rules

    return quality_rules(read(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .mixing import mix_documents

    return mix_documents(read(spark, sf_dir, "documents"))


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import plan_records, read_archives, write_archives

    records = read_archives(write_archives(plan_records(read(spark, sf_dir, "pages"))))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring import remove_duplicates

    return remove_duplicates(read(spark, sf_dir, "documents"))


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .media import media_columns

    return media_columns(read(spark, sf_dir, "documents"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack

    return pack(read(spark, sf_dir, "documents"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .divergence import source_divergence

    return source_divergence(read(spark, sf_dir, "documents"))


def op12_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clustering import centroid_clusters

    return centroid_clusters(read(spark, sf_dir, "embeddings"))


def op13_tokenizer(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(read(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_pii, op2_quality_classifier, op3_token_counts, op4_quality_rules, op5_simhash, op6_mixing, op7_warc, op8_substring, op9_media, op10_packing, op11_divergence, op12_clustering, op13_tokenizer)
}

def _clustering_sql(k: int = 40, rounds: int = 5, dims: int = 64) -> str:
    """Centroids round by round: v are the vectors, c0 the first centroids, a<r> the assignments, c<r> the centroids after them."""
    assigned = """
a{r} AS MATERIALIZED (SELECT id, arg_min(cluster, (d, cluster)) AS cluster, min(d) AS distance
  FROM (SELECT id, cluster, list_sum(list_transform(list_zip(v.x, c.x), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{r} AS c) GROUP BY id)"""
    moved = """
c{s} AS MATERIALIZED (SELECT c.cluster, coalesce(m.x, c.x) AS x FROM c{r} AS c LEFT JOIN (
  SELECT cluster, list(CAST((total - (total % n + n) % n) // n AS BIGINT) ORDER BY i) AS x FROM (
    SELECT cluster, i, sum(e)::BIGINT AS total, count(*) AS n FROM (SELECT cluster, unnest(v.x) AS e, unnest(range({dims})) AS i FROM a{r} JOIN v USING (id)) GROUP BY ALL) GROUP BY cluster) AS m USING (cluster))"""
    steps = ",".join(assigned.format(r=r) + "," + moved.format(r=r, s=r + 1, dims=dims) for r in range(rounds)) + "," + assigned.format(r=rounds)
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS id, vec_id, list_transform(embedding, lambda e: CAST(floor(256 * e::DOUBLE) AS BIGINT)) AS x
  FROM embeddings WHERE len(embedding) = {dims} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dims}),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS cluster, x FROM v ORDER BY sha256('2:' || vec_id) LIMIT {k}),{steps},
i AS (SELECT cluster, sum(distance)::BIGINT AS cluster_inertia FROM a{rounds} GROUP BY cluster)
SELECT vec_id, CAST(a.cluster AS INT) AS cluster, distance, cluster_inertia, (SELECT sum(distance)::BIGINT FROM a{rounds}) AS inertia, sha256(array_to_string(c.x, ',')) AS centroid_sha256
FROM a{rounds} AS a JOIN v USING (id) JOIN c{rounds} AS c ON c.cluster = a.cluster JOIN i ON i.cluster = a.cluster
"""


ORACLE_SQL: dict[str, str] = {
    "op12_clustering": _clustering_sql(),
    "op11_divergence": r"""
WITH d AS (SELECT row_number() OVER () AS k, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
o AS (SELECT k, lang, source, translate(unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM d),
t AS (SELECT lang, term FROM o GROUP BY ALL HAVING count(DISTINCT k) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM o SEMI JOIN t USING (lang, term) GROUP BY ALL),
g AS (SELECT DISTINCT lang, source FROM d),
full_counts AS (SELECT g.lang, g.source, t.term, coalesce(n, 0) AS n FROM g JOIN t USING (lang) LEFT JOIN c USING (lang, source, term)),
p AS (SELECT *, CAST(1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang, source) + count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM full_counts),
q AS (SELECT lang, term, CAST(1 + (1000000000 * (n + 1)) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q
      FROM (SELECT lang, term, sum(n) AS n FROM full_counts GROUP BY ALL)),
s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
      FROM p AS a JOIN p AS b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(value, 0) AS BIGINT) AS value
          FROM g AS a JOIN g AS b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, CAST((p - q) * (p - q) // q AS BIGINT) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(rank AS INT) AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
WHERE part = 'pair' OR rank <= 200
""",
    "op6_mixing": r"""
WITH d AS (
  SELECT doc_id, CASE WHEN right(source, 1) IN ('0', '1', '2') THEN 'web' WHEN right(source, 1) IN ('3', '4', '5', '6') THEN 'news' ELSE 'forum' END AS domain,
         lang, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS n_tokens
  FROM (SELECT doc_id, text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents)),
l3 AS (SELECT domain, lang, source, sum(n_tokens) AS tokens, CAST(sum(n_tokens) * 4 AS DOUBLE) AS capacity, 1.0::DOUBLE AS weight FROM d GROUP BY ALL),
l2 AS (SELECT domain, lang, sum(capacity) AS capacity, CASE lang WHEN 'en' THEN 4.0 WHEN 'de' THEN 2.0 WHEN 'fr' THEN 2.0 WHEN 'es' THEN 2.0 ELSE 1.0 END::DOUBLE AS weight FROM l3 GROUP BY ALL),
l1 AS (SELECT domain, sum(capacity) AS capacity, CASE domain WHEN 'web' THEN 5.0 WHEN 'news' THEN 3.0 ELSE 2.0 END::DOUBLE AS weight FROM l2 GROUP BY ALL),
a1 AS (SELECT *, (floor((SELECT sum(tokens) FROM l3) * 0.5) - coalesce(sum(capacity) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l1),
b1 AS (SELECT *, first_value(CASE WHEN capacity / weight > level THEN level END IGNORE NULLS) OVER (ORDER BY capacity / weight, domain ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS water FROM a1),
c1 AS (SELECT domain, CASE WHEN water IS NULL THEN capacity ELSE least(capacity, water * weight) END AS budget FROM b1),
a2 AS (SELECT l2.*, (budget - coalesce(sum(capacity) OVER (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l2 JOIN c1 USING (domain)),
b2 AS (SELECT *, first_value(CASE WHEN capacity / weight > level THEN level END IGNORE NULLS) OVER (PARTITION BY domain ORDER BY capacity / weight, lang ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS water FROM a2),
c2 AS (SELECT domain, lang, CASE WHEN water IS NULL THEN capacity ELSE least(capacity, water * weight) END AS budget FROM b2),
a3 AS (SELECT l3.*, (budget - coalesce(sum(capacity) OVER (PARTITION BY domain, lang ORDER BY capacity / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (PARTITION BY domain, lang ORDER BY capacity / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM l3 JOIN c2 USING (domain, lang)),
b3 AS (SELECT *, first_value(CASE WHEN capacity / weight > level THEN level END IGNORE NULLS) OVER (PARTITION BY domain, lang ORDER BY capacity / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS water FROM a3),
c3 AS (SELECT domain, lang, source, tokens, floor(CASE WHEN water IS NULL THEN capacity ELSE least(capacity, water * weight) END + 1e-6) AS due FROM b3),
e AS (SELECT domain, lang, source, CASE WHEN tokens > 0 THEN CAST(floor(due / tokens) AS INT) ELSE 0 END AS whole, due - tokens * CASE WHEN tokens > 0 THEN floor(due / tokens) ELSE 0 END AS rest FROM c3),
p AS (SELECT d.*, whole, rest, sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('17:' || whole || ':' || doc_id), doc_id, n_tokens ROWS UNBOUNDED PRECEDING) AS run
      FROM d JOIN e USING (domain, lang, source))
SELECT doc_id, unnest(range(0, whole))::INT AS epoch, domain, lang, source, n_tokens FROM p
UNION ALL
SELECT doc_id, whole AS epoch, domain, lang, source, n_tokens FROM p WHERE whole < 4 AND run <= rest
""",
    "op8_substring": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS k
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT k, min(doc_id) AS least FROM x GROUP BY k),
r AS (SELECT DISTINCT doc_id, i + o AS i FROM (SELECT x.doc_id, x.i FROM x JOIN f USING (k) WHERE f.least < x.doc_id), range(50) AS t(o)),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT p.doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY p.i) AS kept
      FROM p LEFT JOIN r ON p.doc_id = r.doc_id AND p.i = r.i WHERE r.i IS NULL GROUP BY p.doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
""",
    "op7_warc": """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS largest
  FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         CAST(1 + ((CAST('0x' || substr(hex, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS INT)) & 31) AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = largest THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> largest THEN largest END AS refers_to
FROM p
""",
}
