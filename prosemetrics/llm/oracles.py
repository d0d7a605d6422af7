"""DuckDB twins of the queries that SQL can express, over the whole tables."""

from __future__ import annotations

import re

from prosemetrics.llm.mixing import LEVELS, Mixture
from prosemetrics.llm.url_filter import BLOCK, UrlPolicy

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_sql(policy: UrlPolicy) -> str:
    def hits(terms: tuple[str, ...]) -> str:
        one = "CAST(regexp_matches(low, '(^|[^a-z0-9]){}([^a-z0-9]|$)') AS INTEGER)"
        return " + ".join(one.format(re.escape(t).replace(r"\-", "-")) for t in terms)

    rules = sorted(policy.rules, key=lambda r: (-len(r.name), r.name))
    fits = [f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')" for r in rules]
    names = " ".join(f"WHEN {f} THEN '{r.name}'" for f, r in zip(fits, rules))
    verdicts = " ".join(f"WHEN {f} THEN '{r.verdict}'" for f, r in zip(fits, rules))
    by_terms = f"CASE WHEN n_strict >= 1 OR n_soft >= {policy.vocabulary.soft_needed} THEN '{BLOCK}' ELSE 'allow' END"
    return f"""
WITH cut AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), '{UPPER}', '{LOWER}') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path,
         translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS low
  FROM pages),
counted AS (
  SELECT page_id, host, path, {hits(policy.vocabulary.strict)} AS n_strict, {hits(policy.vocabulary.soft)} AS n_soft
  FROM cut)
SELECT page_id, host, path, CASE {names} END AS rule, CASE {verdicts} ELSE {by_terms} END AS verdict,
       CAST(n_strict AS INTEGER) AS n_strict, CAST(n_soft AS INTEGER) AS n_soft
FROM counted"""


def top_k_sql(k: int, every: int, scale: int = 1024) -> str:
    return f"""
WITH whole AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.v, c.v) AS BIGINT) AS score
  FROM whole q JOIN whole c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v)
  WHERE q.vec_id % {every} = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM scored
QUALIFY rank <= {k}"""


def _case(column: str, values, default) -> str:
    if not values:
        return repr(default)
    return f"CASE {column} " + " ".join(f"WHEN '{k}' THEN {v!r}" for k, v in values.items()) + f" ELSE {default!r} END"


def mixing_sql(m: Mixture) -> str:
    weights = {"domain": m.domain_weights, "lang": m.lang_weights, "source": m.source_weights}
    steps = []
    above, keys = "b0", []
    for depth, level in enumerate(LEVELS):
        path = [*keys, level]
        on = " AND ".join(f"c.{k} = p.{k}" for k in keys) or "TRUE"
        by = ", ".join(keys) or "TRUE"
        order = f"PARTITION BY {by} ORDER BY CAST(supply AS DOUBLE) / weight, {level}"
        steps.append(f"""
c{depth} AS (
  SELECT c.*, p.budget FROM (
    SELECT {', '.join(path)}, CAST(sum(supply) AS HUGEINT) AS supply, {_case(level, weights[level], 1)} AS weight
    FROM leaves GROUP BY {', '.join(path)}) c JOIN {above} p ON {on}),
r{depth} AS (
  SELECT *, greatest(budget - coalesce(sum(supply) OVER ({order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 0) AS rest,
         sum(weight) OVER ({order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights,
         row_number() OVER ({order}) AS place
  FROM c{depth} WHERE weight > 0),
f{depth} AS (
  SELECT *, min(CASE WHEN supply * weights >= rest * weight THEN place END) OVER (PARTITION BY {by}) AS first FROM r{depth}),
u{depth} AS (
  SELECT *, max(CASE WHEN place = first THEN rest END) OVER (PARTITION BY {by}) AS unit_rest,
         max(CASE WHEN place = first THEN weights END) OVER (PARTITION BY {by}) AS unit_weights
  FROM f{depth}),
b{depth + 1} AS (
  SELECT {', '.join(path)}, supply,
         CASE WHEN first IS NULL OR place < first THEN supply ELSE unit_rest * weight // unit_weights END AS budget
  FROM u{depth})""")
        above, keys = f"b{depth + 1}", path
    leaf = ", ".join(LEVELS)
    return f"""
WITH rows AS (
  SELECT doc_id, {_case('source', m.domains, m.other_domain)} AS domain, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS tokens, md5(coalesce(text, '')) AS text_hash
  FROM documents),
leaves AS (SELECT {leaf}, sum(tokens) * {m.epochs} AS supply FROM rows GROUP BY {leaf}),
b0 AS (SELECT coalesce(sum(tokens), 0) * {m.share_pct} // 100 AS budget FROM rows),{','.join(steps)},
ordered AS (
  SELECT rows.*, epoch, md5(concat('{m.seed}:', epoch, ':', coalesce(CAST(doc_id AS VARCHAR), 'null'), ':', text_hash)) AS place
  FROM rows CROSS JOIN range(1, {m.epochs + 1}) t(epoch)),
summed AS (
  SELECT *, coalesce(sum(tokens) OVER (PARTITION BY {leaf} ORDER BY epoch, place
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM ordered)
SELECT s.doc_id, s.domain, s.lang, s.source, CAST(s.tokens AS BIGINT) AS tokens, CAST(s.epoch AS INTEGER) AS epoch,
       CAST(b.supply AS BIGINT) AS leaf_supply, CAST(b.budget AS BIGINT) AS leaf_budget
FROM summed s JOIN b{len(LEVELS)} b ON s.domain = b.domain AND s.lang = b.lang AND s.source = b.source
WHERE s.before < b.budget"""


def exact_duplicates_sql() -> str:
    return r"""
WITH digests AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       doc_id = min(doc_id) OVER same AS kept, text_sha256
FROM digests
WINDOW same AS (PARTITION BY text_sha256)"""


def hard_negatives_sql(positives: int = 5, negatives: int = 10, least: int = 30, most: int = 90, scale: int = 256, every: int = 100) -> str:
    """A DuckDB twin for tables without repeated ids, over vectors of equal dimension; labels move where ids divide by 7."""
    return f"""
WITH whole AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor({scale} * CAST(x AS DOUBLE))) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, c.vec_id, a.label = c.label AS same, CAST(list_dot_product(a.v, c.v) AS BIGINT) AS score
  FROM whole a JOIN whole c ON c.vec_id <> a.vec_id AND len(c.v) = len(a.v)
  WHERE a.vec_id % {every} = 0),
positive AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score
  FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {positives})
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND {least} * positive_score <= 100 * score AND 100 * score <= {most} * positive_score
QUALIFY rank <= {negatives}"""
