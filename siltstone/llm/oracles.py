"""DuckDB SQL for the operators that SQL can express.

Toxicity, n-gram quality, nearest neighbours, secret spans, SentencePiece and
SimHash have none: their models, searches, positions or hashes are beyond it,
and tests hold them against brute-force versions or the library itself.
"""

from __future__ import annotations

from .mixing import DIMENSIONS

#: Rounds by which raking and scaling have settled on the driver tables.
ROUNDS, CAP_ROUNDS = 40, 8


def mixing_sql(share: float = 0.8, seed: str = "mix") -> str:
    powers = {"source": 0.7, "lang": 0.7, "topic": 0.8}
    parts = [
        """WITH body AS (SELECT doc_id, coalesce(source, '') AS source, coalesce(lang, '') AS lang, coalesce(text, '') AS text FROM documents),
rows AS (SELECT doc_id, source, lang,
  CASE WHEN contains(text, ' | ') THEN 'table' WHEN contains(text, '=') OR contains(text, '{') THEN 'code' WHEN contains(text, '@') THEN 'contact' ELSE 'prose' END AS topic,
  CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, ' ', '')) + 1 END AS tokens FROM body),
c0 AS MATERIALIZED (SELECT source, lang, topic, sum(tokens)::DOUBLE AS tokens, sum(tokens)::DOUBLE AS weight FROM rows GROUP BY ALL),
whole AS MATERIALIZED (SELECT sum(weight) AS whole FROM c0)"""
    ]
    for d in DIMENSIONS:
        parts.append(f"p_{d} AS MATERIALIZED (SELECT {d} AS value, pow(sum(weight), {powers[d]}) AS raw FROM c0 GROUP BY 1)")
        parts.append(f"g_{d} AS MATERIALIZED (SELECT value, raw / (SELECT sum(raw) FROM p_{d}) * (SELECT whole FROM whole) AS goal FROM p_{d})")
    k = 0
    for _ in range(ROUNDS):
        for d in DIMENSIONS:
            parts.append(
                f"c{k + 1} AS MATERIALIZED (SELECT source, lang, topic, tokens, weight * f.factor AS weight FROM c{k} JOIN "
                f"(SELECT s.{d} AS value, CASE WHEN s.sum > 0 THEN g.goal / s.sum ELSE 0 END AS factor FROM (SELECT {d}, sum(weight) AS sum FROM c{k} GROUP BY 1) s JOIN g_{d} g ON g.value = s.{d}) f ON f.value = c{k}.{d})"
            )
            k += 1
    parts.append(f"s0 AS MATERIALIZED (SELECT {share} * (SELECT whole FROM whole) / sum(weight) AS scale FROM c{k})")
    for n in range(CAP_ROUNDS):
        parts.append(
            f"s{n + 1} AS MATERIALIZED (SELECT CASE WHEN coalesce(free, 0) = 0 THEN scale ELSE greatest({share} * (SELECT whole FROM whole) - full_, 0) / free END AS scale FROM "
            f"(SELECT any_value(scale) AS scale, sum(CASE WHEN weight * scale >= tokens THEN tokens ELSE 0 END) AS full_, sum(CASE WHEN weight * scale >= tokens THEN NULL ELSE weight END) AS free FROM c{k}, s{n}))"
        )
    parts.append(
        f"cells AS (SELECT source, lang, topic, round(CASE WHEN tokens > 0 THEN weight / tokens ELSE 1 END, 6) AS weight, "
        f"round(CASE WHEN tokens > 0 THEN least(1.0, weight * scale / tokens) ELSE {share} END, 6) AS probability FROM c{k}, s{CAP_ROUNDS})"
    )
    return ",\n".join(parts) + (
        "\nSELECT doc_id, source, lang, topic, tokens::BIGINT AS tokens, weight, probability, "
        f"('0x' || substr(md5('{seed}' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT / 4294967296.0 < probability AS kept, 0.0::DOUBLE AS residual FROM rows JOIN cells USING (source, lang, topic)"
    )


EMBEDDING_SQL = """WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS size FROM v
  WHERE label IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.vec_id AS a, b.vec_id AS b FROM ok a JOIN ok b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_dot_product(a.e, b.e) / (a.size * b.size) >= 0.93),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
root AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY 1),
many AS (SELECT a AS vec_id, count(*) AS n FROM links GROUP BY 1)
SELECT v.vec_id, coalesce(many.n, 0)::BIGINT AS n_links, root.component_id, v.vec_id = root.component_id AS kept
FROM v JOIN root USING (vec_id) LEFT JOIN many USING (vec_id)"""

URL_SQL = r"""WITH parts AS (SELECT page_id, coalesce(translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
  coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '') AS query FROM pages),
named AS (SELECT *, CASE WHEN host <> '' THEN regexp_replace(host, ':(80|443)$', '') || regexp_replace(path, '/+$', '') ||
  CASE WHEN kept <> '' THEN '?' || kept ELSE '' END END AS url FROM
  (SELECT *, coalesce(array_to_string(list_sort(list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&'), '') AS kept FROM parts)),
listed AS (SELECT prefix || name || '.example.' || tld || '/' || lang || '/' || number AS url FROM
  (SELECT unnest(['cheap-pills', 'casino-win', 'free-bets', 'adult-x', 'spam-farm']) AS name, unnest(range(5)) AS i) a, (SELECT unnest(['', 'www.', 'm.', 'blog.']) AS prefix, unnest(range(4)) AS j) b,
  (SELECT unnest(['com', 'net', 'org']) AS tld, unnest(range(3)) AS k) c, (SELECT unnest(['en', 'de', 'fr', 'es']) AS lang) d, range(10000) e(number) WHERE number < 9999 AND number % 3 = (i + 5 * (j + 4 * k)) % 3),
ruled AS (SELECT *, CASE
  WHEN (host = 'www.example.com' OR ends_with(host, '.www.example.com')) AND starts_with(path, '/en/') THEN 'www.example.com/en/'
  WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/en/') THEN 'example.com/en/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/fr/') THEN 'net/fr/'
  WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/es/') THEN 'net/es/'
  WHEN (host = 'com' OR ends_with(host, '.com')) AND starts_with(path, '/') THEN 'com/' END AS rule FROM named)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('www.example.com/en/', 'com/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block'
  WHEN url IN (SELECT url FROM listed) THEN 'block' ELSE 'allow' END AS verdict, coalesce(url IN (SELECT url FROM listed), false) AS listed FROM ruled"""

WARC_SQL = """WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + (((('0x' || substr(hex, 1 + 10 * (i // 8)::INTEGER, 10))::BIGINT >> (35 - 5 * (i % 8))::INTEGER) & 31))::INTEGER, 1)), '') AS payload_digest FROM d),
w AS (SELECT *, max(page_id) OVER (PARTITION BY hex, payload_bytes) AS first FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NULL OR page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id = first THEN NULL ELSE first END AS refers_to FROM w"""


def oracle_sql() -> dict[str, str]:
    return {"op1_mixing": mixing_sql(), "op2_embedding_dedup": EMBEDDING_SQL, "op5_url_filter": URL_SQL, "op8_warc": WARC_SQL}
