"""DuckDB SQL of the queries that SQL can express."""

_P1 = r"""
WITH a AS (
  SELECT *, lower(regexp_replace(document_id, '^\s+|\s+$', '', 'g')) AS d,
    regexp_replace(regexp_replace(lower(regexp_replace(field, '^\s+|\s+$', '', 'g')), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS f,
    lower(regexp_replace(confidence, '^\s+|\s+$', '', 'g')) AS conf,
    regexp_replace(correction_date, '^\s+|\s+$', '', 'g') AS cd
  FROM field_values),
b AS (
  SELECT *, CASE conf WHEN 'high' THEN 3 WHEN 'medium' THEN 2 WHEN 'low' THEN 1 ELSE 0 END AS cr,
    CASE WHEN regexp_full_match(cd, '[0-9OolI|SB]{1,2}[/.\-][0-9OolI|SB]{1,2}[/.\-]([0-9OolI|SB]{4}|[0-9OolI|SB]{2})') THEN translate(cd, 'OolI|SB', '0011158')
         WHEN regexp_full_match(cd, '[0-9OolI|SB]{4}[/.\-][0-9OolI|SB]{1,2}[/.\-][0-9OolI|SB]{1,2}') THEN translate(cd, 'OolI|SB', '0011158')
         ELSE cd END AS dd
  FROM a WHERE d IS NOT NULL AND f IS NOT NULL),
c AS (
  SELECT *, CASE
    WHEN regexp_full_match(dd, '\d{1,2}[/.\-]\d{1,2}[/.\-]\d{2}') THEN try_strptime(regexp_replace(dd, '(\d+)[/.\-](\d+)[/.\-](\d\d)$', '\1/\2/20\3'), '%m/%d/%Y')
    WHEN regexp_full_match(dd, '\d{1,2}[/.\-]\d{1,2}[/.\-]\d{4}') THEN try_strptime(regexp_replace(dd, '[/.\-]', '/', 'g'), '%m/%d/%Y')
    WHEN regexp_full_match(dd, '\d{4}[/.\-]\d{1,2}[/.\-]\d{1,2}') THEN try_strptime(regexp_replace(dd, '[/.\-]', '-', 'g'), '%Y-%m-%d')
    ELSE coalesce(try_strptime(dd, '%B %d, %Y'), try_strptime(dd, '%d %b %Y'), try_strptime(dd, '%b %d, %Y'), try_strptime(dd, '%d %B %Y')) END AS day
  FROM b),
u AS (
  SELECT d, f, fv_id, cr, day, source_page, captured_at, count(*) OVER (PARTITION BY d, f) AS n, raw_value, evidence, correction_date,
    raw_value IS NOT NULL AND lower(regexp_replace(raw_value, '^\s+|\s+$', '', 'g')) NOT IN ('', '-', '--', 'null', 'none', 'nil', 'n/a', 'na', 'n.a.', 'not applicable', 'unknown', 'undated', 'tbd', '?') AS u1,
    evidence IS NOT NULL AND lower(regexp_replace(evidence, '^\s+|\s+$', '', 'g')) NOT IN ('', '-', '--', 'null', 'none', 'nil', 'n/a', 'na', 'n.a.', 'not applicable', 'unknown', 'undated', 'tbd', '?') AS u2,
    day IS NOT NULL AS u3
  FROM c),
l AS (
  SELECT d, f, n, 'raw_value' AS attribute, raw_value AS value, fv_id, cr, day, source_page, captured_at FROM u WHERE u1
  UNION ALL SELECT d, f, n, 'evidence', evidence, fv_id, cr, day, source_page, captured_at FROM u WHERE u2
  UNION ALL SELECT d, f, n, 'correction_date', correction_date, fv_id, cr, day, source_page, captured_at FROM u WHERE u3),
w AS (
  SELECT * FROM l WHERE n >= 2
  QUALIFY row_number() OVER (PARTITION BY d, f, attribute ORDER BY cr DESC, day DESC NULLS LAST, source_page DESC NULLS LAST, captured_at DESC NULLS LAST, fv_id) = 1)
"""

ORACLES = {
    "p3_agreement": r"""
WITH g AS (SELECT task_id, trim(reviewer) AS reviewer, lower(regexp_replace(reviewer_verdict, '^\s+|\s+$', '', 'g')) AS label, reviewed_at, review_id FROM import_corrections),
l AS (SELECT * FROM g WHERE label IN ('correct', 'wrong', 'unsure') AND task_id IS NOT NULL AND reviewer IS NOT NULL QUALIFY row_number() OVER (PARTITION BY task_id, reviewer ORDER BY reviewed_at DESC NULLS LAST, review_id DESC) = 1),
p AS (SELECT task_id, label, count(*) AS n FROM l WHERE label <> 'unsure' GROUP BY 1, 2),
i AS (SELECT task_id, sum(n) AS m, sum(n * n) AS ss FROM p GROUP BY 1 HAVING sum(n) > 1),
o AS (SELECT count(*) AS n_items, sum(m) AS n_values, sum((m * m - ss) / (m - 1)) AS d FROM i),
e AS (SELECT sum(n_c * n_c) AS s FROM (SELECT label, CAST(sum(n) AS DOUBLE) AS n_c FROM p WHERE task_id IN (SELECT task_id FROM i) GROUP BY 1))
SELECT n_items, CAST(n_values AS BIGINT) AS n_values, d / n_values AS observed, (n_values * n_values - s) / (n_values * (n_values - 1)) AS expected, 1 - (d / n_values) / ((n_values * n_values - s) / (n_values * (n_values - 1))) AS alpha FROM o, e""",
    "p1_found": _P1 + "SELECT d AS document_id, f AS field, attribute, fv_id FROM w",
    "p1_survivors": _P1
    + """SELECT g.d AS document_id, g.f AS field, g.n AS n_records,
  r.value AS raw_value, r.fv_id AS raw_value_fv_id, e.value AS evidence, e.fv_id AS evidence_fv_id, c.value AS correction_date, c.fv_id AS correction_date_fv_id
FROM (SELECT DISTINCT d, f, n FROM u WHERE n >= 2) g
LEFT JOIN (SELECT * FROM w WHERE attribute = 'raw_value') r ON r.d = g.d AND r.f = g.f
LEFT JOIN (SELECT * FROM w WHERE attribute = 'evidence') e ON e.d = g.d AND e.f = g.f
LEFT JOIN (SELECT * FROM w WHERE attribute = 'correction_date') c ON c.d = g.d AND c.f = g.f""",
}
