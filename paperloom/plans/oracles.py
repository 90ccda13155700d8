"""DuckDB SQL of the core's queries that SQL can express."""

from __future__ import annotations

import re

from paperloom.rules import mortgage as M


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _in(names) -> str:  # noqa: ANN001
    return "(" + ", ".join(map(_q, names)) + ")"


def _strip(c: str) -> str:
    return rf"regexp_replace({c}, '^[\s\x{{A0}}\x{{FEFF}}]+|[\s\x{{A0}}\x{{FEFF}}]+$', '', 'g')"


def _any(c: str, phrases) -> str:  # noqa: ANN001
    return f"regexp_matches(coalesce({c}, ''), {_q('(?i)' + '|'.join(re.escape(p).replace('\\\\ ', ' ').replace('\\ ', ' ').replace('\\-', '-') for p in phrases))})"


_DOC = f"lower({_strip('document_id')})"
_FIELD = f"regexp_replace(regexp_replace(lower({_strip('field')}), '[^\\p{{L}}\\p{{N}}]+', '_', 'g'), '^_+|_+$', '', 'g')"
_PAGES = f"pg AS (SELECT {_DOC} AS doc_id, page_number AS page, page_id, filename, coalesce(raw_text, '') AS text, is_correction_page, has_degraded_text, lower({_strip('text_quality')}) AS text_quality FROM page_analyses)"
_ROWS = f"""fr AS (SELECT {_DOC} AS doc_id, {_FIELD} AS field, source_page AS page, fv_id AS ord, raw_value AS value,
  CASE WHEN lower({_strip('confidence')}) IN ('high', 'medium', 'low') THEN lower({_strip('confidence')}) ELSE 'medium' END AS confidence, confidence_reason, evidence, corrected, correction_page, correction_date FROM field_values)"""
_NULLISH = lambda c: f"({c} IS NULL OR lower({_strip(c)}) IN {_in(M.NULL_LIKE)})"
_RESOLVED = f"""{_PAGES}, {_ROWS},
occ AS (SELECT fr.*, cp.doc_id IS NOT NULL AS on_corr FROM fr LEFT JOIN (SELECT DISTINCT doc_id, page FROM pg WHERE is_correction_page) cp ON cp.doc_id = fr.doc_id AND cp.page = fr.page
  WHERE NOT corrected AND NOT {_NULLISH('value')} AND field IS NOT NULL),
f_any AS (SELECT * FROM occ QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY page NULLS FIRST, ord) = 1),
f_plain AS (SELECT * FROM occ WHERE NOT on_corr QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY page NULLS FIRST, ord) = 1),
cand0 AS (SELECT doc_id, field, value, correction_page AS page, correction_date AS date, ord, regexp_extract(correction_date, '(\\d{{1,2}})[/.\\-](\\d{{1,2}})[/.\\-](\\d{{2,4}})', ['m', 'd', 'y']) AS t FROM fr
  WHERE corrected AND NOT {_NULLISH('value')} AND correction_page IS NOT NULL AND field NOT IN {_in(M.UNCORRECTED_FIELDS)}),
cand AS (SELECT *, try_cast(t.m AS INT) AS m, try_cast(t.d AS INT) AS d, CASE WHEN try_cast(t.y AS INT) < 100 THEN try_cast(t.y AS INT) + 2000 ELSE try_cast(t.y AS INT) END AS y FROM cand0),
win AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY (y IS NOT NULL) DESC, y DESC NULLS LAST, m DESC NULLS LAST, d DESC NULLS LAST, page DESC, ord) = 1),
res AS (SELECT coalesce(a.doc_id, w.doc_id) AS doc_id, coalesce(a.field, w.field) AS field,
  CASE WHEN w.doc_id IS NOT NULL THEN w.value ELSE a.value END AS raw_value, CASE WHEN w.doc_id IS NOT NULL THEN w.page ELSE a.page END AS source_page,
  CASE WHEN w.doc_id IS NOT NULL THEN 'high' ELSE a.confidence END AS confidence, CASE WHEN w.doc_id IS NULL THEN a.confidence_reason END AS confidence_reason, CASE WHEN w.doc_id IS NULL THEN a.evidence END AS evidence,
  w.doc_id IS NOT NULL AS corrected,
  CASE WHEN w.doc_id IS NOT NULL THEN coalesce(p.value, a.value, 'unknown') END AS original_value,
  CASE WHEN w.doc_id IS NOT NULL THEN coalesce(CASE WHEN p.doc_id IS NOT NULL THEN p.page ELSE a.page END, 1) END AS original_page,
  w.page AS correction_page, CASE WHEN w.doc_id IS NOT NULL THEN coalesce(w.date, '') END AS correction_date,
  CASE WHEN w.doc_id IS NULL THEN NULL WHEN coalesce(w.date, '') <> '' THEN 'latest dated correction' ELSE 'latest correction page, undated' END AS rule
  FROM f_any a LEFT JOIN f_plain p ON p.doc_id = a.doc_id AND p.field = a.field FULL OUTER JOIN win w ON w.doc_id = a.doc_id AND w.field = a.field)"""
_CHECK = lambda c: f"CASE WHEN regexp_matches({_strip(c)}, '(?s)^\\(.*\\)$') THEN -abs(try_cast(regexp_replace({_strip(c)}, '[^0-9.\\-]', '', 'g') AS DOUBLE)) ELSE try_cast(regexp_replace({_strip(c)}, '[^0-9.\\-]', '', 'g') AS DOUBLE) END"
_CELL = lambda c: f"""CASE WHEN regexp_matches({_strip(c)}, '^\\(.*\\)$') THEN -abs(CASE WHEN regexp_matches({_strip(f"regexp_replace(regexp_replace({_strip(c)}, '^\\(|\\)$', '', 'g'), '[,$]', '', 'g')")}, '^[+\\-]?(\\d+\\.?\\d*|\\.\\d+)$') THEN try_cast({_strip(f"regexp_replace(regexp_replace({_strip(c)}, '^\\(|\\)$', '', 'g'), '[,$]', '', 'g')")} AS DOUBLE) END)
  ELSE CASE WHEN regexp_matches({_strip(f"regexp_replace({_strip(c)}, '[,$]', '', 'g')")}, '^[+\\-]?(\\d+\\.?\\d*|\\.\\d+)$') THEN try_cast({_strip(f"regexp_replace({_strip(c)}, '[,$]', '', 'g')")} AS DOUBLE) END END"""  # noqa: E731


def _without_lookaround(pattern: str, replacement: str) -> tuple[str, str, int]:
    """A cleaning rule for an engine without lookaround: pattern, replacement, passes.

    What stood in the look-behind and look-ahead is captured and put back; a second pass
    finds the matches that shared such a character.
    """
    before = re.match(r"\(\?<=((?:\\.|\[[^\]]*\]|[^)])+)\)", pattern)
    rest = pattern[before.end() :] if before else pattern
    after = re.search(r"\(\?=((?:\\.|\[[^\]]*\]|[^)])+)\)$", rest)
    core = rest[: after.start()] if after else rest
    own = re.match(r"^\((\\\$\\s\{0,2\})\)(.*)$", core)
    if own:
        return pattern, r"\1" + "0", 1
    made, out = "", ""
    if before:
        made, out = f"({before[1]})", r"\1"
    made, out = made + core, out + replacement
    if after:
        if after[1] == r"\b":
            made += r"\b"
        else:
            made, out = made + f"({after[1]})", out + rf"\{2 if before else 1}"
    return made, out, 2


def _cleaned(c: str) -> str:
    for pattern, replacement in (*M.NOISE_RULES, M.SPACE_RULE):
        c = f"regexp_replace({c}, {_q(pattern)}, {_q(replacement)}, 'g')"
    for pattern, replacement in (*M.NUMBER_RULES, *M.WORD_RULES):
        p, r, n = _without_lookaround(pattern, replacement)
        for _ in range(n):
            c = f"regexp_replace({c}, {_q(p)}, {_q(r)}, 'g')"
    return f"array_to_string(list_filter(list_transform(string_split({c}, chr(10)), lambda x: {_strip('x')}), lambda x: x <> ''), chr(10))"


def _scores() -> str:
    longest = max(len(s) for ss in M.TYPE_SIGNALS.values() for s in ss)
    rows = ", ".join(f"({i}, {_q(t)}, {_q(s)}, {3 if x else 1})" for i, (t, ss) in enumerate(M.TYPE_SIGNALS.items()) for s, x in ss.items())
    return f"""{_PAGES}, sig AS (SELECT * FROM (VALUES {rows}) AS v(type_ord, doc_type, signal, points)),
lo AS (SELECT p.doc_id, lower(concat_ws(' ', right(t.text, {longest}), p.text)) AS low FROM pg p LEFT JOIN (SELECT doc_id, page + 1 AS page, min(text) AS text, count(*) AS n FROM pg GROUP BY 1, 2) t ON t.doc_id = p.doc_id AND t.page = p.page),
sc AS (SELECT doc_id, type_ord, doc_type, sum(points) AS score FROM (SELECT DISTINCT doc_id, type_ord, doc_type, signal, points FROM lo JOIN sig ON contains(low, signal)) GROUP BY 1, 2, 3),
rk AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, type_ord) AS r FROM sc),
cl0 AS (SELECT d.doc_id, b.doc_type AS best, coalesce(b.score, 0) AS b, coalesce(s.score, 0) AS s FROM (SELECT DISTINCT doc_id FROM pg) d LEFT JOIN rk b ON b.doc_id = d.doc_id AND b.r = 1 LEFT JOIN rk s ON s.doc_id = d.doc_id AND s.r = 2),
cl AS (SELECT doc_id, CASE WHEN b >= 3 AND (s = 0 OR b >= 1.5 * s) THEN best WHEN b >= 2 THEN best ELSE 'Unknown' END AS doc_type,
  CASE WHEN b >= 3 AND (s = 0 OR b >= 1.5 * s) THEN 'high' WHEN b >= 2 THEN 'medium' ELSE 'low' END AS confidence, CAST(b AS BIGINT) AS best_score, CAST(s AS BIGINT) AS second_score FROM cl0)"""


def _sums() -> str:
    parts = []
    names = sorted({t for _, t, _, _ in M.SUM_CHECKS} | {c for _, _, cs, _ in M.SUM_CHECKS for c in cs})
    wide = ", ".join(f"max(CASE WHEN field = {_q(n)} THEN x END) AS v_{n}" for n in names)
    for check, total, cs, unless in M.SUM_CHECKS:
        computed = " + ".join(f"coalesce(v_{c}, 0)" for c in cs)
        some = " OR ".join(f"v_{c} IS NOT NULL" for c in cs)
        missing = f"array_to_string(list_filter([{', '.join(f'CASE WHEN v_{c} IS NULL THEN {_q(c)} END' for c in cs)}], lambda z: z IS NOT NULL), ',')"
        cond = f"({some}) AND abs({computed} - v_{total}) > {M.SUM_TOLERANCE}"
        if unless:
            u = next(x for x in M.SUM_CHECKS if x[0] == unless)
            uc = " + ".join(f"coalesce(v_{c}, 0)" for c in u[2])
            us = " OR ".join(f"v_{c} IS NOT NULL" for c in u[2])
            cond += f" AND NOT coalesce(({us}) AND abs({uc} - v_{u[1]}) > {M.SUM_TOLERANCE}, false)"
        parts.append(f"SELECT doc_id, {_q(check)} AS \"check\", {_q(total)} AS field, v_{total} AS stated, {computed} AS computed, abs({computed} - v_{total}) AS difference, 'error' AS severity, {_q(','.join(cs))} AS components, {missing} AS missing FROM wd WHERE {cond}")
    return f"nm AS (SELECT doc_id, field, {_CHECK('raw_value')} AS x FROM res), wd AS (SELECT doc_id, {wide} FROM nm GROUP BY 1), sm AS ({' UNION ALL '.join(parts)})"


_RATIO = f"""rt0 AS (SELECT doc_id, CASE field WHEN 'note_rate' THEN 'ltv_revised' WHEN 'interest_rate' THEN 'ltv_original' ELSE field END AS field, {_CHECK('raw_value')} AS x FROM res),
rt1 AS (SELECT doc_id, {', '.join(f"max(CASE WHEN field = '{n}' THEN x END) AS {n}, bool_or(field = '{n}') AS has_{n}" for n in ('ltv_revised', 'ltv_original', 'loan_amount', 'appraised_value'))} FROM rt0 GROUP BY 1),
rt2 AS (SELECT *, CASE WHEN has_ltv_revised THEN ltv_revised ELSE ltv_original END AS l, CASE WHEN loan_amount <> 0 AND appraised_value > 0 THEN loan_amount / appraised_value * 100 END AS computed FROM rt1),
rt3 AS (SELECT *, CASE WHEN l <= 1 THEN l * 100 ELSE l END AS stated FROM rt2),
rt AS (SELECT doc_id, 'ltv' AS "check", CASE WHEN has_ltv_original THEN 'ltv_original' ELSE 'ltv_revised' END AS field, stated, computed, abs(stated - computed) AS difference, 'error' AS severity, 'loan_amount,appraised_value' AS components, '' AS missing FROM rt3 WHERE abs(stated - computed) > {M.RATIO_TOLERANCE})"""
_FLAGS = 'SELECT doc_id, "check", field, round(stated, 4) AS stated, round(computed, 4) AS computed, round(difference, 4) AS difference, severity, components, missing FROM '
_GENERIC = ("total_closing_costs", "total_loan_costs", "origination_charges", "prepaids", "escrow_deposit", "taxes_and_govt_fees", "monthly_escrow")


def _generic(name: str, rows: str, known) -> str:  # noqa: ANN001
    total = "(starts_with(field, 'total_') OR ends_with(field, '_total'))"
    return f"""{name} AS (SELECT t.doc_id, 'generic_total' AS "check", t.field, t.x AS stated, list_sum(list(c.x ORDER BY c.field)) AS computed, abs(list_sum(list(c.x ORDER BY c.field)) - t.x) AS difference, 'warning' AS severity, string_agg(c.field, ',' ORDER BY c.field) AS components, '' AS missing
  FROM (SELECT * FROM {rows} WHERE {total} AND x > 0{f' AND field NOT IN {_in(known)}' if known else ''}) t JOIN (SELECT * FROM {rows} WHERE NOT {total} AND x > 0 AND field NOT IN {_in(M.GENERIC_EXCLUDED)}) c ON c.doc_id = t.doc_id AND c.x < t.x
  GROUP BY t.doc_id, t.field, t.x HAVING count(*) BETWEEN 2 AND 6 AND abs(list_sum(list(c.x ORDER BY c.field)) - t.x) > {M.SUM_TOLERANCE})"""


def _format_bad(field: str, c: str) -> str:
    s = _strip(c)
    return f"""CASE WHEN {field} IN {_in(M.MONEY_FIELDS)} AND NOT coalesce(regexp_matches(replace({s}, ',', ''), '^[+\\-]?\\(?\\$?[0-9,]+(?:\\.[0-9]{{1,2}})?\\)?\\s*$'), false) THEN 'money'
  WHEN {field} IN {_in(M.PERCENT_FIELDS)} AND NOT coalesce(regexp_matches({s}, '^[+\\-]?[0-9]{{1,3}}(?:\\.[0-9]{{1,6}})?\\s*%?\\s*$'), false) THEN 'percent'
  WHEN {field} IN {_in(M.DATE_FIELDS)} AND NOT coalesce(regexp_matches({s}, '^[0-9]{{1,2}}[/\\-.][0-9]{{1,2}}[/\\-.][0-9]{{2,4}}$'), false) THEN 'date' END"""


def _money(c: str) -> str:
    for _ in range(2):
        c = f"regexp_replace(regexp_replace({c}, '(\\d)O(\\d)', '\\10\\2', 'g'), '(\\d)[Il](\\d)', '\\11\\2', 'g')"
    n = f"try_cast(regexp_replace({c}, '[^0-9.\\-()]', '', 'g') AS DOUBLE)"
    return f"CASE WHEN (contains({c}, '(') AND contains({c}, ')')) OR regexp_matches({c}, '^\\s*-') THEN -abs({n}) ELSE {n} END"


_V = "nullif(raw_value, '')"
_PCT = f"try_cast(regexp_replace(translate(split_part({_V}, '%', 1), 'OIl', '011'), '[^0-9.]', '', 'g') AS DOUBLE)"
_DV = f"regexp_replace(regexp_replace({_V}, '(\\d)O(\\d)', '\\10\\2', 'g'), '(\\d)O(\\d)', '\\10\\2', 'g')"
_DP = "\\b(\\d{1,2})[/\\-.](\\d{1,2})[/\\-.](\\d{2,4})\\b"
_DATE = f"CASE WHEN regexp_matches({_DV}, '{_DP}') THEN lpad(regexp_extract({_DV}, '{_DP}', 1), 2, '0') || '/' || lpad(regexp_extract({_DV}, '{_DP}', 2), 2, '0') || '/' || CASE WHEN length(regexp_extract({_DV}, '{_DP}', 3)) = 2 THEN '20' ELSE '' END || regexp_extract({_DV}, '{_DP}', 3) ELSE {_strip(_V)} END"
_TP = "(\\d{1,2})[/\\-.](\\d{1,2})[/\\-.](\\d{2,4})"
_INITCAP = lambda c: f"array_to_string(list_transform(string_split(replace({c}, '_', ' '), ' '), lambda w: upper(left(w, 1)) || lower(substr(w, 2))), ' ')"
_KIND = f"CASE WHEN {_V} IS NULL THEN NULL WHEN field IN {_in(M.MONEY_FIELDS)} OR contains({_V}, '$') THEN 'money' WHEN field IN {_in(M.PERCENT_FIELDS)} OR ends_with({_V}, '%') THEN 'percent' WHEN field IN {_in(M.DATE_FIELDS)} THEN 'date' ELSE 'text' END"
_ALIASES = ", ".join(f"({_q(n)}, {_q(f)})" for f, ns in M.ALIASES.items() for n in ns)
_LABELS = ", ".join(f"({_q(n)}, {_q(f)})" for f, ns in M.TABLE_LABELS.items() for n in ns)
_ANY_DOC = "lower(coalesce(raw_text, ''))"
_REVISION = (*M.REVISION_PATTERNS, ("replaced_amount", r"(?i)addendum\s+replaces\s+the\s+earlier\s+amount\s+of\s+\$([\d,]+\.\d{2})", "$", ""))
_WRONG = "lower(trim(reviewer_verdict)) = 'wrong'"

_MADE = {
    "classified": f"WITH {_scores()} SELECT * FROM cl",
    "classify_summary": f"WITH {_scores()} SELECT doc_type, confidence, count(*) AS n, round(avg(best_score), 6) AS mean_score FROM cl GROUP BY 1, 2",
    "clean_text": f"WITH {_PAGES} SELECT page_id, md5(c) AS digest, length(c) AS n FROM (SELECT page_id, {_cleaned('text')} AS c FROM pg)",
    "page_grades": f"WITH {_PAGES} SELECT page_id, CASE WHEN n < 80 THEN 200 ELSE 150 END AS dpi, CASE WHEN n > 200 THEN 'clean' WHEN n > 0 THEN 'degraded' ELSE 'unreadable' END AS quality, n < 100 AS degraded, {_any('text', M.CORRECTION_KEYWORDS)} OR regexp_matches(text, {_q('(?i)' + M.CORRECTION_VALUE)}) AS correction FROM (SELECT *, length({_strip('text')}) AS n FROM pg)",
    "page_report": f"WITH {_PAGES} SELECT doc_id, page, page_id, text_quality, has_degraded_text, is_correction_page, length(text) AS n_chars FROM pg",
    "absent_elements": f"SELECT fv_id FROM field_values WHERE {_any('evidence', M.NEGATIONS)}",
    "coerced_enums": f"SELECT fv_id, CASE WHEN confidence IN ('high', 'medium', 'low') THEN confidence ELSE 'medium' END AS confidence, translate({_strip('lower(field)')}, ' -.', '__') AS key FROM field_values",
    "parsed_values": f"""SELECT fv_id, {_money(_V)} AS money, {_PCT} AS pct, {_DATE} AS day, {_CELL('raw_value')} AS cell, {_CHECK('raw_value')} AS checked,
  CASE WHEN try_cast(regexp_extract(raw_value, '{_TP}', 3) AS INT) < 100 THEN try_cast(regexp_extract(raw_value, '{_TP}', 3) AS INT) + 2000 ELSE try_cast(regexp_extract(raw_value, '{_TP}', 3) AS INT) END AS y,
  try_cast(regexp_extract(raw_value, '{_TP}', 1) AS INT) AS m, try_cast(regexp_extract(raw_value, '{_TP}', 2) AS INT) AS d FROM field_values""",
    "normalized_fields": f"WITH n AS (SELECT fv_id, {_FIELD} AS field, raw_value FROM field_values) SELECT fv_id, {_KIND} AS kind, CASE {_KIND} WHEN 'money' THEN {_money(_V)} WHEN 'percent' THEN {_PCT} END AS num, CASE {_KIND} WHEN 'date' THEN {_DATE} WHEN 'text' THEN {_strip(_V)} END AS str FROM n",
    "format_failures": f"WITH {_ROWS} SELECT ord AS fv_id, {_format_bad('field', 'value')} AS bad FROM fr",
    "name_exact": f"""WITH k AS (SELECT DISTINCT field AS name, translate({_strip('lower(field)')}, ' -.', '__') AS key FROM field_values WHERE field IS NOT NULL), al(name, f) AS (VALUES {_ALIASES})
SELECT key, coalesce(al.f, key) AS canonical, CASE WHEN al.f IS NOT NULL THEN 'alias' WHEN key IN {_in(M.SCHEMA_FIELDS)} THEN 'schema' ELSE 'key' END AS layer, count(*) AS n_spellings FROM k LEFT JOIN al ON al.name = k.key GROUP BY ALL""",
    "name_semantic": """WITH f AS (SELECT label, min(vec_id) AS vec_id FROM embeddings GROUP BY 1), v AS (SELECT f.label, e.embedding FROM f JOIN embeddings e USING (vec_id)),
s AS (SELECT e.vec_id, v.label, list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])) AS score FROM embeddings e, v)
SELECT vec_id, CAST(label AS VARCHAR) AS canonical, round(score, 4) AS score FROM s WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY score DESC, label) = 1""",
    "first_occurrence": f"WITH {_ROWS} SELECT doc_id, field, page, ord AS fv_id, value FROM fr WHERE NOT {_NULLISH('value')} QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY page NULLS FIRST, ord) = 1",
    "text_corrections": f"WITH {_PAGES} SELECT page_id, field, value, date, ord FROM (" + " UNION ALL ".join(f"SELECT page_id, {_q(f)} AS field, {_q(b)} || regexp_extract(text, {_q(p)}, 1) || {_q(a)} AS value, list_extract(regexp_extract_all(text, '(\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}})', 1), -1) AS date, {i} AS ord FROM pg WHERE regexp_matches(text, {_q('(?i)' + M.CORRECTION_TRIGGER)}) AND regexp_extract(text, {_q(p)}, 1) <> ''" for i, (f, p, b, a) in enumerate(_REVISION)) + ")",
    "resolved_fields": f"WITH {_RESOLVED} SELECT * FROM res",
    "corrections": f"WITH {_RESOLVED} SELECT doc_id, field, original_value, original_page, raw_value AS corrected_value, correction_page, correction_date, rule FROM res WHERE corrected",
    "sum_mismatches": f"WITH {_RESOLVED}, {_sums()} {_FLAGS} sm",
    "generic_totals": f"WITH {_RESOLVED}, gx AS (SELECT doc_id, field, {_CHECK('raw_value')} AS x FROM res WHERE field IN {_in(_GENERIC)}), {_generic('gn', 'gx', ())} {_FLAGS} gn",
    "ratio_mismatches": f"WITH {_RESOLVED}, {_RATIO} {_FLAGS} rt",
    "all_mismatches": f"WITH {_RESOLVED}, {_sums()}, {_RATIO}, {_generic('gn', 'rt0', tuple({t for _, t, _, _ in M.SUM_CHECKS}))}, nmd AS (SELECT * FROM sm UNION ALL SELECT * FROM rt) {_FLAGS} (SELECT * FROM nmd UNION ALL SELECT * FROM gn WHERE (doc_id, field) NOT IN (SELECT (doc_id, field) FROM nmd))",
    "adjusted_confidence": f"""WITH {_RESOLVED}, dg AS (SELECT DISTINCT doc_id, page FROM pg WHERE coalesce(has_degraded_text, false) OR text_quality IN ('degraded', 'unreadable')),
a AS (SELECT r.*, dg.doc_id IS NOT NULL AS degraded, CASE confidence WHEN 'high' THEN 2 WHEN 'low' THEN 0 ELSE 1 END AS lv, {_format_bad('r.field', 'r.raw_value')} AS bad FROM res r LEFT JOIN dg ON dg.doc_id = r.doc_id AND dg.page = r.source_page),
b AS (SELECT *, CASE WHEN bad IS NOT NULL THEN greatest(lv - 1, 0) ELSE lv END AS l1 FROM a),
c AS (SELECT *, l1 = 2 AND degraded AS worn FROM b)
SELECT doc_id, field, ['low', 'medium', 'high'][CASE WHEN worn THEN 2 ELSE l1 + 1 END] AS confidence,
  CASE WHEN l1 < 2 OR worn THEN nullif(concat_ws('; ', nullif(confidence_reason, ''), CASE WHEN bad IS NOT NULL THEN 'not in the format of ' || bad END, CASE WHEN worn THEN 'page ' || source_page || ' is degraded' END), '') END AS confidence_reason FROM c""",
    "review_queue": f"""WITH {_RESOLVED} SELECT doc_id, field, {_INITCAP('field')} AS field_display, coalesce(raw_value, '') AS pipeline_value, coalesce(confidence, 'low') AS confidence, coalesce(confidence_reason, '') AS confidence_reason,
  CASE WHEN length(evidence) > 400 THEN left(evidence, 400) || '…' ELSE coalesce(evidence, '') END AS evidence, 'Page ' || coalesce(CAST(source_page AS VARCHAR), '?') AS source_page FROM res WHERE confidence IS DISTINCT FROM 'high'""",
    "verdict_summary": f"SELECT lower({_strip('reviewer_verdict')}) AS verdict, count(*) AS n FROM import_corrections WHERE reviewer_verdict IS NOT NULL GROUP BY 1",
    "override_rate": f"""WITH {_RESOLVED}, r AS (SELECT string_split(split_part(document, '.', 1), '_')[-1] AS doc_id, {_FIELD} AS field, lower({_strip('reviewer_verdict')}) AS verdict FROM import_corrections WHERE reviewer_verdict IS NOT NULL)
SELECT confidence, count(*) AS n, count(*) FILTER (verdict = 'wrong') AS n_wrong, count(*) FILTER (verdict = 'wrong') / count(*) AS rate, count(*) FILTER (verdict = 'wrong') / count(*) > 0.2 AS alarm FROM r JOIN res USING (doc_id, field) GROUP BY 1""",
    "latest_annotation": f"SELECT task_id, lower({_strip('reviewer_verdict')}) AS verdict, reviewer_corrected_value AS corrected_value, reviewer_notes AS notes, strftime(reviewed_at, '%Y-%m-%d %H:%M:%S') AS reviewed_at FROM import_corrections QUALIFY row_number() OVER (PARTITION BY task_id ORDER BY reviewed_at DESC NULLS LAST, review_id DESC) = 1 AND verdict IS NOT NULL",
    "cache_misses": "SELECT DISTINCT md5(text) AS key FROM documents WHERE text IS NOT NULL AND md5(text) NOT IN (SELECT md5(text) FROM documents WHERE text IS NOT NULL AND lang = 'de')",
    "frequent_corrections": f"WITH c AS (SELECT {_FIELD} AS field, CAST(reviewed_at AS DATE) AS day, count(*) AS n FROM import_corrections WHERE {_WRONG} AND reviewed_at IS NOT NULL GROUP BY 1, 2) SELECT a.field, a.day, CAST(sum(b.n) AS BIGINT) AS n FROM c a JOIN c b ON a.field = b.field AND b.day BETWEEN a.day - INTERVAL 29 DAY AND a.day GROUP BY 1, 2 HAVING sum(b.n) >= 3",
    "changed_values": f"WITH {_RESOLVED} SELECT doc_id, field, raw_value AS old_value, CASE WHEN field = 'nmls' THEN NULL WHEN field = 'loan_type' THEN upper(raw_value) ELSE raw_value END AS new_value FROM res WHERE confidence = 'high' AND raw_value IS DISTINCT FROM CASE WHEN field = 'nmls' THEN NULL WHEN field = 'loan_type' THEN upper(raw_value) ELSE raw_value END",
    "document_counts": f"WITH {_RESOLVED} SELECT p.doc_id, p.n AS n_pages, coalesce(f.n, 0) AS n_fields, coalesce(f.c, 0) AS n_corrections FROM (SELECT doc_id, count(*) AS n FROM pg GROUP BY 1) p LEFT JOIN (SELECT doc_id, count(*) AS n, count(*) FILTER (corrected) AS c FROM res GROUP BY 1) f USING (doc_id)",
    "field_report": f"WITH {_RESOLVED} SELECT doc_id, {_INITCAP('field')} AS field_display, raw_value AS value, {_KIND} AS kind, source_page, corrected, CASE WHEN length(evidence) > 80 THEN left(evidence, 80) || '…' ELSE evidence END AS evidence FROM res",
    "json_recovery": "SELECT event_id, CAST(props->>'$.k' AS BIGINT) AS k FROM events",
    "failure_classes": "SELECT CASE fv_id % 5 WHEN 0 THEN 'rate limit' WHEN 1 THEN 'model missing' WHEN 2 THEN 'outage' WHEN 3 THEN 'credentials' ELSE 'other' END AS class, count(*) AS n FROM field_values GROUP BY 1",
    "document_sources": "SELECT source, lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1, 2",
}

_SCHEMA = ", ".join(f"({i}, {_q(n)})" for i, n in enumerate(M.SCHEMA_FIELDS))
_MADE |= {
    # a row of the common subsequences' lengths for each letter of the key; a row only grows, so its own running maximum closes it
    "name_fuzzy": f"""WITH RECURSIVE k AS (SELECT DISTINCT field AS name, translate({_strip('lower(field)')}, ' -.', '__') AS key FROM field_values WHERE field IS NOT NULL), al(name, f) AS (VALUES {_ALIASES}), sc(o, w) AS (VALUES {_SCHEMA}),
e AS (SELECT k.name, key, al.f, key IN {_in(M.SCHEMA_FIELDS)} AS own FROM k LEFT JOIN al ON al.name = k.key),
dp AS (SELECT key, o, w, 0 AS i, list_transform(range(length(w) + 1), lambda x: 0) AS row FROM (SELECT DISTINCT key FROM e WHERE f IS NULL AND NOT own), sc
  UNION ALL SELECT key, o, w, i + 1, list_transform(range(1, length(w) + 2), lambda j: list_max(list_transform(range(1, j + 1), lambda m: CASE WHEN m > 1 AND substr(w, m - 1, 1) = substr(key, i + 1, 1) THEN row[m - 1] + 1 ELSE row[m] END))) FROM dp WHERE i < length(key)),
near AS (SELECT key, w FROM (SELECT key, o, w, 200.0 * row[length(w) + 1] / (length(key) + length(w)) AS score FROM dp WHERE i = length(key)) WHERE score >= 65 AND key <> '' QUALIFY row_number() OVER (PARTITION BY key ORDER BY score DESC, o) = 1)
SELECT e.name, e.key, coalesce(f, CASE WHEN own THEN e.key END, near.w, e.key) AS canonical, CASE WHEN f IS NOT NULL THEN 'alias' WHEN own THEN 'schema' WHEN near.w IS NOT NULL THEN 'fuzzy' ELSE 'key' END AS layer FROM e LEFT JOIN near ON near.key = e.key""",
    "json_arms": "SELECT event_id, CASE WHEN event_id % 7 IN (5, 6) THEN NULL ELSE CAST(props->>'$.k' AS BIGINT) END AS k FROM events",
    "wrong_answers": f"SELECT * FROM ({_MADE['latest_annotation']}) WHERE verdict = 'wrong'",
    "form_faults": """SELECT * FROM (SELECT review_id, CASE WHEN coalesce(reviewer_verdict, '') = '' THEN 'no verdict' WHEN reviewer_verdict NOT IN ('correct', 'wrong', 'unsure') THEN 'unknown verdict'
  WHEN reviewer_verdict = 'wrong' AND trim(coalesce(reviewer_corrected_value, '')) = '' THEN 'no corrected value' WHEN reviewer_verdict <> 'wrong' AND trim(coalesce(reviewer_corrected_value, '')) <> '' THEN 'needless corrected value' END AS fault FROM import_corrections) WHERE fault IS NOT NULL""",
    "extended_aliases": f"""WITH al(name, canonical) AS (VALUES {_ALIASES}), n AS (SELECT lower(trim(field_display)) AS name, min({_FIELD}) AS canonical FROM import_corrections WHERE {_WRONG} AND field_display IS NOT NULL AND field IS NOT NULL GROUP BY 1)
SELECT * FROM al UNION ALL SELECT * FROM n WHERE name NOT IN (SELECT name FROM al)""",
    "low_confidence": f"SELECT a.doc_id, a.field, r.raw_value FROM ({_MADE['adjusted_confidence']}) a JOIN ({_MADE['resolved_fields']}) r USING (doc_id, field) WHERE a.confidence = 'low'",
    "cache_keys": f"WITH {_PAGES} SELECT page_id, 'v4:m1:' || md5(text) || ':' || md5('page ' || coalesce(CAST(page AS VARCHAR), '?')) AS key, left(sha256(coalesce(filename, '')), 8) AS doc_key FROM pg",
    "document_rollup": f"""WITH {_RESOLVED} SELECT doc_id, count(*) AS n_fields, count(*) FILTER (confidence = 'high') AS n_high, count(*) FILTER (confidence = 'medium') AS n_medium, count(*) FILTER (confidence = 'low') AS n_low, count(*) FILTER (corrected) AS n_corrected,
  sum(CAST(CASE WHEN field IN {_in(M.MONEY_FIELDS)} THEN {_CHECK('raw_value')} END AS DECIMAL(18,2))) AS amounts FROM res GROUP BY 1""",
}
_LAB, _AMT = ("label", "Label", "description", "Description", "item", "Item"), ("amount", "Amount", "value", "Value", "cost", "Cost")
_FIRST = lambda ks: "coalesce(" + ", ".join(f"nullif({_strip(f'(e->>{chr(39)}{k}{chr(39)})')}, '')" for k in ks) + ")"
_MADE |= {
    "header_tables": f"""WITH {_PAGES}, x AS (SELECT page_id, page, regexp_extract_all(text, '(?m)^([A-Z][A-Za-z ]+?) {{3,}}(\\$[0-9,.]+)$') AS l FROM pg),
u AS (SELECT page_id, page, unnest(range(len(l))) AS row_ord, l FROM x)
SELECT page_id, 'Parsed Table 1 (p' || coalesce(page, 0) || ')' AS name, CAST(row_ord AS INT) AS row_ord, regexp_extract(l[row_ord + 1], '^(.*?) {{3,}}', 1) AS item, regexp_extract(l[row_ord + 1], ' {{3,}}(\\$.*)$', 1) AS amount FROM u""",
    "added_tables": f"""WITH {_PAGES}, x AS (SELECT page_id, page, regexp_extract_all(text, '(?m)^([A-Z][A-Za-z ]+?) {{3,}}(\\$[0-9,.]+)$') AS l FROM pg WHERE page IS NOT NULL AND page_id % 3 <> 0),
u AS (SELECT page_id, page, unnest(range(len(l))) AS row_ord, l FROM x)
SELECT page_id, 'Parsed Table 1 (p' || page || ')' AS name, CAST(row_ord AS INT) AS row_ord, 'high' AS confidence, regexp_extract(l[row_ord + 1], '^(.*?) {{3,}}', 1) AS item, regexp_extract(l[row_ord + 1], ' {{3,}}(\\$.*)$', 1) AS amount FROM u""",
    "checked_corrections": f"""WITH c AS (SELECT review_id AS id, {_FIELD} AS field, reviewer_corrected_value AS value, reviewed_at AS moment FROM import_corrections WHERE {_WRONG}),
f AS (SELECT id, field, value, CASE WHEN id % 9 > 0 AND moment IS NOT NULL AND field IS NOT NULL AND value IS NOT NULL THEN row_number() OVER (PARTITION BY field, value, time_bucket(INTERVAL 7 DAY, CASE WHEN id % 9 > 0 THEN moment END, TIMESTAMP '1970-01-01') ORDER BY id) ELSE 1 END AS k FROM c)
SELECT id, CASE WHEN coalesce(field, '') = '' THEN 'missing field' WHEN coalesce(value, '') = '' THEN 'missing value' WHEN field IN {_in(M.MONEY_FIELDS)} AND (NOT starts_with(value, '$') OR {_money("nullif(value, '')")} IS NULL) THEN 'bad amount' WHEN k > 1 THEN 'repeat' END AS problem FROM f""",
    "cross_validated": f"""WITH {_RESOLVED}, j AS (SELECT result_id, try_cast(regexp_extract(result_json, '(?s)\\{{.*\\}}') AS JSON) AS o FROM extraction_results), r AS (SELECT result_id, coalesce(o->'$.result', o) AS o FROM j WHERE json_type(o) = 'OBJECT'),
t AS (SELECT result_id, lower({_strip("(o->>'$.document_id')")}) AS doc_id, CASE WHEN json_type(o->'$.tables') = 'VARCHAR' THEN try_cast(o->>'$.tables' AS JSON) ELSE o->'$.tables' END AS v FROM r),
tl AS (SELECT result_id, doc_id, CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] ELSE [] END AS l FROM t),
ti AS (SELECT result_id, doc_id, i - 1 AS a, l[i]->'$.rows' AS v FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM tl)),
rl AS (SELECT result_id, doc_id, a, CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] ELSE [] END AS l FROM ti),
ri AS (SELECT result_id, doc_id, '$/tables[' || a || ']/rows[' || (i - 1) || ']' AS row, l[i] AS e FROM (SELECT *, unnest(range(1, len(l) + 1)) AS i FROM rl) WHERE json_type(l[i]) <> 'NULL'),
lb(label, f) AS (VALUES {_LABELS}),
c AS (SELECT ri.result_id, ri.row, ri.doc_id, lb.f AS field, {_FIRST(_AMT)} AS amount FROM ri LEFT JOIN lb ON lb.label = lower({_strip(_FIRST(_LAB))})),
d AS (SELECT c.result_id, c.row, c.doc_id, c.field, {_CELL('amount')} AS cell_value, CASE WHEN res.doc_id IS NOT NULL THEN {_CELL('res.raw_value')} END AS field_value FROM c LEFT JOIN res ON res.doc_id = c.doc_id AND res.field = c.field)
SELECT *, coalesce(abs(cell_value - field_value) > {M.CELL_TOLERANCE}, false) AS differs FROM d""",
}

ORACLES = _MADE | {
    "p5_found": r"""
WITH j AS (
  SELECT result_id, try_cast(regexp_extract(result_json, '(?s)\{.*\}') AS JSON) AS o FROM extraction_results),
r AS (
  SELECT result_id, coalesce(o->'$.result', o) AS o FROM j WHERE json_type(o) = 'OBJECT'),
t AS (
  SELECT result_id, o->'$.fields' AS fields,
    CASE WHEN json_type(o->'$.tables') = 'VARCHAR' THEN try_cast(o->>'$.tables' AS JSON) ELSE o->'$.tables' END AS tables,
    o->'$.corrections_applied' AS corrections_applied, o->'$.mismatches' AS mismatches FROM r),
named AS (
  SELECT result_id, unnest(json_keys(fields)) AS k FROM t WHERE json_type(fields) = 'OBJECT'
  UNION ALL
  SELECT result_id, e->>'$.name' FROM (SELECT result_id, unnest(CAST(fields AS JSON[])) AS e FROM t WHERE json_type(fields) = 'ARRAY') WHERE json_type(e) <> 'NULL'),
lists AS (
  SELECT result_id, c, CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] ELSE [] END AS l
  FROM (SELECT result_id, 'tables' AS c, tables AS v FROM t UNION ALL SELECT result_id, 'corrections_applied', corrections_applied FROM t UNION ALL SELECT result_id, 'mismatches', mismatches FROM t)),
items AS (
  SELECT result_id, c, i - 1 AS pos, l[i] AS e FROM (SELECT result_id, c, l, unnest(range(1, len(l) + 1)) AS i FROM lists)),
inner_lists AS (
  SELECT result_id, c, pos, CASE json_type(v) WHEN 'ARRAY' THEN CAST(v AS JSON[]) WHEN 'OBJECT' THEN [v] ELSE [] END AS l
  FROM (SELECT result_id, 'table_rows' AS c, pos, e->'$.rows' AS v FROM items WHERE c = 'tables'
        UNION ALL SELECT result_id, 'component_fields', pos, e->'$.component_fields' FROM items WHERE c = 'mismatches')),
inner_items AS (
  SELECT result_id, c, pos, i - 1 AS k, l[i] AS e FROM (SELECT result_id, c, pos, l, unnest(range(1, len(l) + 1)) AS i FROM inner_lists))
SELECT result_id, 'fields' AS child, '' AS parent_key, k AS child_key FROM named
UNION ALL SELECT result_id, c, '', CAST(pos AS VARCHAR) FROM items WHERE json_type(e) <> 'NULL'
UNION ALL SELECT result_id, c, CAST(pos AS VARCHAR), CAST(k AS VARCHAR) FROM inner_items WHERE json_type(e) <> 'NULL'
""",
}

_P5 = ORACLES["p5_found"]
_P5 = _P5[: _P5.index("SELECT result_id, 'fields' AS child")]
_P5_KEYED = r""", keyed AS (
  SELECT result_id, k, k AS place, json_extract(fields, '$."' || k || '"') AS e FROM (SELECT result_id, fields, unnest(json_keys(fields)) AS k FROM t WHERE json_type(fields) = 'OBJECT') WHERE json_type(json_extract(fields, '$."' || k || '"')) <> 'NULL'
  UNION ALL
  SELECT result_id, coalesce(l[i]->>'$.name', CAST(i - 1 AS VARCHAR)), CAST(i - 1 AS VARCHAR), l[i] FROM (SELECT result_id, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT result_id, CAST(fields AS JSON[]) AS l FROM t WHERE json_type(fields) = 'ARRAY')) WHERE json_type(l[i]) <> 'NULL')
"""


def _p5_table(columns: dict[str, str], rows: str) -> str:
    """A flat table of problem 5: the keys of rows, and columns of their entry e."""
    made = ", ".join(f"""try_cast(e->>'$.{c}' AS {kind}) AS "{c}\"""" for c, kind in columns.items())
    return f"{_P5}{_P5_KEYED} SELECT doc_key, row, parent, parent_row, parent_key, child_key, {made} FROM ({rows})"


def _p5_items(label: str) -> str:
    return f"SELECT result_id AS doc_key, '$/{label}[' || pos || ']' AS row, '$' AS parent, '$' AS parent_row, '' AS parent_key, CAST(pos AS VARCHAR) AS child_key, e FROM items WHERE c = '{label}' AND json_type(e) <> 'NULL'"


def _p5_inner(label: str, parent: str, child: str) -> str:
    return f"SELECT result_id AS doc_key, '$/{parent}[' || pos || ']/{child}[' || k || ']' AS row, '{parent}' AS parent, '$/{parent}[' || pos || ']' AS parent_row, CAST(pos AS VARCHAR) AS parent_key, CAST(k AS VARCHAR) AS child_key, e FROM inner_items WHERE c = '{label}' AND json_type(e) <> 'NULL'"


_texts = lambda *names: dict.fromkeys(names, "VARCHAR")
ORACLES |= {
    "p5_fields": _p5_table(
        _texts("confidence", "confidence_reason", "correction_date", "evidence", "name", "normalized_value", "raw_value") | {"corrected": "BOOLEAN", "correction_page": "BIGINT", "source_page": "BIGINT"},
        "SELECT result_id AS doc_key, '$/fields[' || place || ']' AS row, '$' AS parent, '$' AS parent_row, '' AS parent_key, k AS child_key, e FROM keyed",
    ),
    "p5_tables": _p5_table(_texts("confidence", "name") | {"source_page": "BIGINT"}, _p5_items("tables")),
    "p5_table_rows": _p5_table(_texts("Item", "amount", "description", "label", "notes", "value"), _p5_inner("table_rows", "tables", "rows")),
    "p5_corrections_applied": _p5_table(_texts("corrected_value", "correction_date", "field", "original_value", "resolution_rule") | {"correction_page": "BIGINT", "original_page": "BIGINT"}, _p5_items("corrections_applied")),
    "p5_mismatches": _p5_table(_texts("action", "description", "field", "severity", "stated_value") | {"difference": "DOUBLE"}, _p5_items("mismatches")),
    "p5_component_fields": _p5_table({}, "").replace(",  FROM ()", f", e->>'$' AS value FROM ({_p5_inner('component_fields', 'mismatches', 'component_fields')})"),
}
