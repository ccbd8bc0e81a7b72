"""The queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from granary.llm import jaccard, licenses, mixing, phrases, quality, rules, secrets, tokens, toxicity, urls

JACCARD = r"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
s AS (
  SELECT DISTINCT r, array_to_string(w[p:p + 3], ' ') AS g
  FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS p FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
pairs AS (SELECT a.r AS a, b.r AS b, count(*) AS x FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n na ON a = na.r JOIN n nb ON b = nb.r WHERE 100 * x >= 85 * (na.n + nb.n - x)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, component_id
FROM d LEFT JOIN n USING (r) JOIN (SELECT a AS r, min(o.doc_id) AS component_id FROM reach JOIN d o ON reach.b = o.r GROUP BY a) USING (r)
"""

QUERIES = {
    "op1_toxicity": toxicity.op1_toxicity,
    "op2_quality_classifier": quality.op2_quality_classifier,
    "op3_token_counts": tokens.op3_token_counts,
    "op4_benchmark_decontamination": phrases.op4_benchmark_decontamination,
    "op5_secret_scans": secrets.op5_secret_scans,
    "op6_jaccard_join": jaccard.op6_jaccard_join,
    "op7_quality_rules": rules.op7_quality_rules,
    "op8_license_scans": licenses.op8_license_scans,
    "op9_url_filters": urls.op9_url_filters,
    "op10_mix_sources": mixing.op10_mix_sources,
}

SQL: dict[str, str] = {
    "op4_benchmark_decontamination": phrases.SQL,
    "op6_jaccard_join": JACCARD,
    "op8_license_scans": licenses.SQL,
}
