"""SQL of the pN_ queries that plain SQL can express over whole tables, for the comparison with DuckDB."""

from __future__ import annotations

from tessella.llm.survivors import FOUND_FIELDS, MISSING_WORDS


def _quoted(words) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def _p1_found() -> str:
    parts = []
    for f in FOUND_FIELDS:
        if f == "published":
            filled = "a.published IS NOT NULL AND a.published <> TIMESTAMP '1970-01-01 00:00:00'"
        else:
            filled = f"a.{f} IS NOT NULL AND regexp_replace(a.{f}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') <> '' AND lower(regexp_replace(a.{f}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')) NOT IN ({_quoted(MISSING_WORDS)})"
        parts.append(f"SELECT m.cluster_id, '{f}' AS field_name, a.url, a.fetch_status, a.fetched_at FROM m JOIN labeled_articles a ON a.url = m.url WHERE {filled}")
    return f"""
WITH m AS (
  SELECT DISTINCT cluster_id, url FROM dedupe_map
  WHERE cluster_id IN (SELECT cluster_id FROM dedupe_map GROUP BY cluster_id HAVING count(DISTINCT url) >= 2)
), c AS ({' UNION ALL '.join(parts)}),
r AS (
  SELECT cluster_id, field_name, url, row_number() OVER (
    PARTITION BY cluster_id, field_name
    ORDER BY CASE WHEN fetch_status IN ('OK', 'OK_WAYBACK') THEN 0 ELSE 1 END, fetched_at DESC NULLS LAST, url) AS n
  FROM c)
SELECT cluster_id, field_name, url FROM r WHERE n = 1
"""


_P5_FOUND = """
WITH a AS (SELECT DISTINCT url, lower(trim(outlet)) AS outlet, article_text FROM labeled_articles WHERE url IS NOT NULL AND outlet IS NOT NULL AND article_text IS NOT NULL),
l AS (SELECT url, outlet, unnest(string_split(article_text, chr(10))) AS line, unnest(range(len(string_split(article_text, chr(10))))) AS line_no FROM a),
f AS (SELECT url, outlet, line_no, regexp_replace(trim(regexp_replace(lower(replace(line, chr(304), 'i' || chr(775))), '[\\s\\p{Z}\\x{85}\\x{0B}\\x{1C}-\\x{1F}]+', ' ', 'g')), '[0-9]+', '0', 'g') AS form FROM l),
k AS (SELECT outlet, form FROM f WHERE form <> '' GROUP BY 1, 2 HAVING count(DISTINCT url) >= 6)
SELECT DISTINCT url, CAST(line_no AS INT) AS line_no FROM f JOIN k ON f.outlet = k.outlet AND f.form = k.form
"""


_P5_CLEANED = _P5_FOUND.replace("SELECT DISTINCT url, CAST(line_no AS INT) AS line_no FROM f JOIN k ON f.outlet = k.outlet AND f.form = k.form", """
, g AS (SELECT DISTINCT url, line_no FROM f JOIN k ON f.outlet = k.outlet AND f.form = k.form), o AS (SELECT DISTINCT url, outlet, article_text FROM labeled_articles WHERE url IS NOT NULL),
p AS (SELECT url, article_text, unnest(string_split(article_text, chr(10))) AS line, unnest(range(len(string_split(article_text, chr(10))))) AS line_no FROM o)
SELECT p.url, coalesce(string_agg(line, chr(10) ORDER BY p.line_no) FILTER (WHERE g.url IS NULL), '') AS clean_text FROM p LEFT JOIN g ON p.url = g.url AND p.line_no = g.line_no GROUP BY p.url
UNION ALL SELECT url, NULL FROM o WHERE article_text IS NULL""")

_RUNS = """
WITH t AS (SELECT DISTINCT cluster_id, article_text FROM deduped_articles WHERE length(article_text) >= 200),
w AS MATERIALIZED (SELECT cluster_id, i, md5_number(substring(article_text, i, 200)) AS h FROM (SELECT cluster_id, article_text, unnest(range(1, length(article_text) - 198)) AS i FROM t)),
s AS MATERIALIZED (SELECT h, min(cluster_id) AS owner FROM w GROUP BY h HAVING min(cluster_id) <> max(cluster_id)), m AS MATERIALIZED (SELECT w.cluster_id, i, w.h, owner FROM w JOIN s ON w.h = s.h)
"""
_P7_FOUND = _RUNS + "SELECT DISTINCT a.cluster_id AS cluster_a, b.cluster_id AS cluster_b FROM m a JOIN m b ON a.h = b.h AND a.cluster_id < b.cluster_id"
_LENGTH = "SELECT cluster_id, sum(least(200, coalesce(following - i, 200))) AS n FROM (SELECT cluster_id, i, lead(i) OVER (PARTITION BY cluster_id ORDER BY i) AS following FROM (SELECT DISTINCT cluster_id, i FROM m {0})) GROUP BY 1"
_P7_SHARED = _RUNS + f""", x AS ({_LENGTH.format("")}), y AS ({_LENGTH.format("WHERE owner <> cluster_id")}), c AS (SELECT cluster_id, coalesce(length(min(article_text)), 0) AS chars FROM deduped_articles GROUP BY 1)
SELECT c.cluster_id, chars, CAST(coalesce(x.n, 0) AS BIGINT) AS shared_chars, CAST(coalesce(y.n, 0) AS BIGINT) AS removable_chars, CASE WHEN chars > 0 THEN coalesce(x.n, 0) / chars ELSE 0.0 END AS shared_share FROM c LEFT JOIN x ON c.cluster_id = x.cluster_id LEFT JOIN y ON c.cluster_id = y.cluster_id"""
_P7_REMOVALS = _RUNS + """, d AS (SELECT DISTINCT cluster_id, i FROM m WHERE owner <> cluster_id), n AS (SELECT cluster_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY cluster_id ORDER BY i) <= 200 THEN 0 ELSE 1 END AS opened FROM d),
g AS (SELECT cluster_id, i, sum(opened) OVER (PARTITION BY cluster_id ORDER BY i) AS island FROM n) SELECT cluster_id, CAST(min(i) - 1 AS INT) AS start_pos, CAST(max(i) + 199 AS INT) AS end_pos FROM g GROUP BY cluster_id, island"""


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": _p1_found(), "p5_found": _P5_FOUND, "p5_cleaned_equal": _P5_CLEANED, "p7_found": _P7_FOUND, "p7_shared": _P7_SHARED, "p7_removals": _P7_REMOVALS,
    }
