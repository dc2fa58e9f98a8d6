"""DuckDB SQL for the corpus queries that SQL can express, with patterns written out again."""

from __future__ import annotations

_TOP_K = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS q
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
pairs AS (
  SELECT a.vec_id AS query_id, b.vec_id,
         CAST(coalesce(list_sum(list_transform(list_zip(a.q, b.q), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
  FROM valid a JOIN valid b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q))
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""

# kind, pattern, group whose length counts, least length
_SECRETS = [
    ("assign", """([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", "AKIA[A-Z0-9]+", 0, 20),
    ("hex", "[0-9a-f]+", 0, 24),
    ("private_key", "-----BEGIN ([A-Z]+ )?PRIVATE KEY-----", 0, 0),
    ("jwt", "eyJ[A-Za-z0-9_-]{8,}\\.eyJ[A-Za-z0-9_-]{8,}\\.[A-Za-z0-9_-]{8,}", 0, 0),
    ("hub_token", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 0),
    ("chat_token", "xox[abprs]-[A-Za-z0-9-]{10,}", 0, 0),
    ("maps_key", "AIza[A-Za-z0-9_-]{35}", 0, 0),
    ("pay_key", "[sr]k_live_[A-Za-z0-9]{16,}", 0, 0),
    ("url_login", "[a-z]{3,8}://[A-Za-z0-9._%-]+:[A-Za-z0-9._~!$&*+%-]{3,}@[A-Za-z0-9.-]{3,}", 0, 0),
]


def _secrets() -> str:
    """A span starts where the pieces and the matches before it end."""
    kinds = "\nUNION ALL\n".join(
        f"""SELECT doc_id, {rank} AS rank, '{kind}' AS kind, {least} AS least,
       string_split_regex(t, '{pattern}') AS p, regexp_extract_all(t, '{pattern}') AS m, regexp_extract_all(t, '{pattern}', {group}) AS g
FROM d WHERE regexp_matches(t, '{pattern}')""" for rank, (kind, pattern, group, least) in enumerate(_SECRETS))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
found AS ({kinds}),
spans AS (
  SELECT doc_id, rank, kind, began + gap AS s, began + gap + size AS e FROM (
    SELECT doc_id, rank, kind, least, unnest(list_transform(m, lambda x: length(x))) AS size, unnest(list_transform(p[:len(m)], lambda x: length(x))) AS gap,
           unnest(list_transform(g, lambda x: length(x))) AS counted,
           unnest(list_transform(range(1, len(m) + 1), lambda i: coalesce(list_sum(list_transform(m[:i-1], lambda x: length(x))), 0)
                                 + coalesce(list_sum(list_transform(p[:i-1], lambda x: length(x))), 0))) AS began
    FROM found) WHERE counted >= least),
texts AS (SELECT doc_id, rank, kind, s, e, kind || ':' || CAST(CAST(s AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(e AS BIGINT) AS VARCHAR) AS one FROM spans),
joined AS (
  SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
         coalesce(string_agg(one, ',' ORDER BY s, rank, e) FILTER (rank < 3), '') AS base, string_agg(one, ',' ORDER BY s, rank, e) AS every
  FROM texts GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(every, '') AS spans
FROM d LEFT JOIN joined USING (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op5_topk": _TOP_K, "op6_secrets": _secrets()}
