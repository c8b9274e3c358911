"""SQL for the queries of this subpackage that SQL can express over whole tables."""

from tarrafa.llm.linkage import TRACKING

_SITE = r"regexp_replace(lower(regexp_extract(trim(sourceurl, chr(9) || chr(10) || chr(13) || chr(32) || chr(160)), '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#]*@)?([^/:?#]*)', 1)), '^(?:www|m)\.', '')"
_LINES = f"""
lines AS (
  SELECT id, sourceurl, {_SITE} AS site, unnest(string_split(article_content, chr(10))) AS line, unnest(range(1, len(string_split(article_content, chr(10))) + 1)) AS line_no
  FROM gdelt_brazil_events WHERE article_content IS NOT NULL
),
norm AS (
  SELECT id, sourceurl, site, CAST(line_no AS INTEGER) AS line_no, line AS raw, lower(trim(regexp_replace(line, '[\\s\\x{{00a0}}\\x{{0085}}\\x{{1680}}\\x{{2000}}-\\x{{200a}}\\x{{2028}}\\x{{2029}}\\x{{202f}}\\x{{205f}}\\x{{3000}}]+', ' ', 'g'))) AS key FROM lines
),
often AS (SELECT site, key FROM norm WHERE key <> '' GROUP BY site, key HAVING count(DISTINCT sourceurl) >= 6)
"""

_TRIMMED = "trim(sourceurl, chr(9) || chr(10) || chr(13) || chr(32) || chr(160))"
_PAGES = rf"""
raw AS (SELECT source_file, id, {_SITE} AS site, regexp_replace({_TRIMMED}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*|#.*$', '', 'g') AS rest FROM gdelt_brazil_events),
cut AS (SELECT source_file, id, site, list_filter(string_split(regexp_extract(rest, '^[^?#]*'), '/'), lambda x: x <> '') AS segments,
    list_filter(string_split(replace(regexp_extract(rest, '\?([^#]*)', 1), ';', '&'), '&'), lambda x: x <> '' AND NOT regexp_matches(regexp_extract(x, '^([^=]*)', 1), '{TRACKING}')) AS parameters FROM raw),
parts AS (SELECT source_file, id, site, list_concat(list_transform(segments, lambda x: url_decode(x)), list_transform(parameters, lambda x: url_decode(replace(regexp_replace(x, '^[^=]*=?', ''), '+', ' ')))) AS parts FROM cut),
slugs AS (SELECT source_file, id, site, array_to_string(regexp_extract_all(array_to_string(parts, '/'), '\d+'), ',') AS numbers,
    list_filter(list_transform(parts, lambda x: lower(regexp_replace(x, '\.[A-Za-z][A-Za-z0-9]{{0,5}}$', ''))), lambda x: contains(x, '-')) AS hyphened FROM parts),
pages AS (SELECT source_file, id, site, numbers, list_distinct(list_filter(string_split(coalesce(list_filter(hyphened, lambda x: length(x) = list_max(list_transform(hyphened, lambda y: length(y))))[1], ''), '-'), lambda w: w <> '')) AS words FROM slugs)
"""

SQL: dict[str, str] = {
    "p4_found": f"""WITH {_PAGES} SELECT a.id FROM pages a WHERE EXISTS (SELECT 1 FROM pages b WHERE b.site = a.site AND b.numbers = a.numbers AND (b.source_file, b.id) < (a.source_file, a.id)
        AND 4 * len(list_intersect(a.words, b.words)) >= 3 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words))))""",
    "p6_found": """
        SELECT 'g1_articles' AS item_table, url AS item_key FROM g1_articles WHERE length(text_content) > 1024
        UNION ALL SELECT 'g1_chunks', CAST(id AS VARCHAR) FROM g1_chunks WHERE length(chunk) > 1024""",
    "p6_limits": """
        SELECT 'g1_articles' AS item_table, url AS item_key, true AS within_limit, true AS overlapping FROM g1_articles WHERE length(text_content) > 1024
        UNION ALL SELECT 'g1_chunks', CAST(id AS VARCHAR), true, true FROM g1_chunks WHERE length(chunk) > 1024""",
    "p6_rejoined": """
        SELECT 'g1_articles' AS item_table, url AS item_key, text_content AS item FROM g1_articles WHERE text_content IS NOT NULL
        UNION ALL SELECT 'g1_chunks', CAST(id AS VARCHAR), chunk FROM g1_chunks WHERE chunk IS NOT NULL""",
    "p7_found": f"WITH {_LINES} SELECT n.id, n.line_no FROM norm n JOIN often o ON n.site = o.site AND n.key = o.key",
    "p7_cleaned": f"""WITH {_LINES}, kept AS (
        SELECT n.id, string_agg(n.raw, chr(10) ORDER BY n.line_no) AS text FROM norm n LEFT JOIN often o ON n.site = o.site AND n.key = o.key WHERE o.key IS NULL GROUP BY n.id)
        SELECT e.id, CASE WHEN e.article_content IS NOT NULL THEN coalesce(k.text, '') END AS article_content FROM gdelt_brazil_events e LEFT JOIN kept k ON k.id = e.id""",
    "p9_reached": """
        SELECT t.source, max(t.target_share) AS target_share, count(d.doc_id) > 0 AS has_tokens, true AS reached
        FROM source_targets t LEFT JOIN documents d ON d.source = t.source AND d.text <> '' WHERE t.source IS NOT NULL GROUP BY t.source""",
    "p8_decoded": "SELECT doc_id, text FROM documents",
}

SQL["p4_ingested"] = SQL["p4_found"]
