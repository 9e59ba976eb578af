"""SQL for the queries of this subpackage that SQL can express."""

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRING = f"""
    WITH w AS (SELECT doc_id, unnest({_WORDS}) AS word, generate_subscripts({_WORDS}, 1) AS i FROM documents),
    win AS (SELECT doc_id, i, word, string_agg(word, ' ') OVER s AS said, count(*) OVER s AS n FROM w
        WINDOW s AS (PARTITION BY doc_id ORDER BY i ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)),
    twice AS (SELECT said FROM win WHERE n = 35 GROUP BY said HAVING count(*) > 1),
    hit AS (SELECT doc_id, i, word, CASE WHEN n = 35 AND said IN (SELECT said FROM twice) THEN 1 ELSE 0 END AS h FROM win),
    gone AS (SELECT doc_id, i, word, max(h) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS g FROM hit),
    kept AS (SELECT doc_id, count(*) AS n_words, sum(g) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (g = 0) AS text FROM gone GROUP BY doc_id)
    SELECT d.doc_id, CAST(coalesce(n_words, 0) AS BIGINT) AS n_words, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
    FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id"""

_GROUPED = """
    reach AS (SELECT DISTINCT x AS id, x AS m FROM links UNION SELECT l.x AS id, r.m FROM reach r JOIN links l ON l.y = r.id),
    least AS (SELECT id, min(m) AS m FROM reach GROUP BY id),
    degree AS (SELECT x AS id, count(*) AS n FROM links GROUP BY x)"""

JACCARD = f"""
    WITH RECURSIVE w AS (SELECT doc_id, {_WORDS} AS ws FROM documents),
    grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i : i + 4], ' ')) END) AS gram FROM w),
    size AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
    shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b ON a.gram = b.gram AND a.doc_id <> b.doc_id GROUP BY ALL),
    links AS (SELECT x, y FROM shared JOIN size p ON p.doc_id = x JOIN size q ON q.doc_id = y WHERE 9 * c >= 4 * (p.n + q.n)),
    {_GROUPED}
    SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_grams, CAST(coalesce(g.n, 0) AS BIGINT) AS n_links, coalesce(m, d.doc_id) AS class_id, d.doc_id = coalesce(m, d.doc_id) AS kept
    FROM documents d LEFT JOIN size s ON s.doc_id = d.doc_id LEFT JOIN degree g ON g.id = d.doc_id LEFT JOIN least l ON l.id = d.doc_id"""

EMBEDDINGS = f"""
    WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
        WHERE label IS NOT NULL AND len(list_filter(embedding, lambda z: z IS NULL OR NOT isfinite(z))) = 0 AND len(list_filter(embedding, lambda z: z <> 0)) > 0),
    links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    {_GROUPED}
    SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(m, vec_id) AS component_id, vec_id = coalesce(m, vec_id) AS kept
    FROM embeddings d LEFT JOIN degree g ON g.id = d.vec_id LEFT JOIN least l ON l.id = d.vec_id"""
