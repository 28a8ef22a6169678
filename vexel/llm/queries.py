"""Registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vexel.llm import codes, embeddings, html, lm, mixing, packing, quality, secrets, simhash, tokencount, toxicity, warc, whitening

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html": html.op1_html,
    "op2_warc": warc.op2_warc,
    "op3_simhash": simhash.op3_simhash,
    "op4_quality": quality.op4_quality,
    "op5_tokens": tokencount.op5_tokens,
    "op6_packing": packing.op6_packing,
    "op7_secrets": secrets.op7_secrets,
    "op8_scores": lm.op8_scores,
    "op9_embeddings": embeddings.op9_embeddings,
    "op10_mixing": mixing.op10_mixing,
    "op11_whitening": whitening.op11_whitening,
    "op12_toxicity": toxicity.op12_toxicity,
    "op13_codes": codes.op13_codes,
}

# Base32 of a SHA-1: five hexadecimal digits are four of base 32 (RFC 4648).
_SHA1 = "upper(sha1(coalesce(html, '')))"
_HEX = f"list_reduce([CAST(strpos('0123456789ABCDEF', d) - 1 AS BIGINT) FOR d IN string_split(substr({_SHA1}, CAST(1 + 5 * g AS BIGINT), 5), '')], lambda a, b: a * 16 + b)"
_BASE32 = f"array_to_string([array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(1 + ({_HEX} // p) % 32 AS BIGINT), 1) FOR p IN [32768, 1024, 32, 1]], '') FOR g IN range(8)], '')"
_CLEAN = "label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0"



def _codes_sql(rounds: int = 2) -> str:
    """Vector codes round by round: ``c0`` has the first entries, ``a`` the parts' nearest entries, ``c`` the next ones."""
    ctes = """
e AS (SELECT vec_id, label, CAST(floor(256 * CAST(u.x AS DOUBLE)) AS BIGINT) AS x, u.i - 1 AS i, (u.i - 1) // (len(embedding) // 16) AS p, dense_rank() OVER (ORDER BY vec_id) - 1 AS place
  FROM (SELECT vec_id, label, embedding, unnest(list_zip(embedding, range(1, len(embedding) + 1))) AS z FROM embeddings
    WHERE embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0) q, LATERAL (SELECT q.z[1] AS x, q.z[2] AS i) u),
c0 AS (SELECT p, place AS k, i, x AS v FROM e WHERE place < 64)"""
    for r in range(rounds + 1):
        ctes += f""",
d{r} AS (SELECT vec_id, e.p, k, CAST(sum((x - v) * (x - v)) AS BIGINT) AS d FROM e JOIN c{r} ON e.p = c{r}.p AND e.i = c{r}.i GROUP BY vec_id, e.p, k),
a{r} AS (SELECT vec_id, p, k, d FROM d{r} QUALIFY row_number() OVER (PARTITION BY vec_id, p ORDER BY d, k) = 1)"""
        if r < rounds:
            ctes += f""",
m{r} AS (SELECT e.p, k, i, CAST(floor(sum(x)::DOUBLE / count(*)) AS BIGINT) AS v FROM e JOIN a{r} USING (vec_id, p) GROUP BY e.p, k, i),
c{r + 1} AS (SELECT o.p, o.k, o.i, coalesce(n.v, o.v) AS v FROM c{r} o LEFT JOIN m{r} n ON o.p = n.p AND o.k = n.k AND o.i = n.i)"""
    return f"""
WITH {ctes},
r AS (SELECT vec_id, string_agg(printf('%02x', k), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id),
l AS (SELECT DISTINCT vec_id, label FROM e)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(string_agg(CAST(v AS VARCHAR), ',' ORDER BY p, k, i)) FROM c{rounds}) AS codebooks_sha256
FROM r JOIN l USING (vec_id)"""


ORACLE_SQL: dict[str, str] = {
    "op2_warc": f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, {_BASE32} AS payload_digest, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS first FROM pages)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to FROM p""",
    "op9_embeddings": f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE {_CLEAN}),
link AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x) AND list_cosine_similarity(a.x, b.x) >= 0.98),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a),
low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a, count(*) AS n_links FROM link GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n_links, 0) AS BIGINT) AS n_links, low.component_id, e.vec_id = low.component_id AS kept
FROM embeddings e JOIN low ON low.a = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op13_codes": _codes_sql(),
}
