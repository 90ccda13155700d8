"""DuckDB SQL of the queries that run the whole engine, from the tables and ids that made the answers."""

from __future__ import annotations

from paperloom.plans import oracles as O
from paperloom.rules import mortgage as M

_S, _Q, _IN = O._strip, O._q, O._in

#: A page's own row, what rules say of it, and what its answer lays over that.
_PAGES = f"""
p0 AS (SELECT {O._DOC} AS doc_id, page_number AS page, page_id, coalesce(raw_text, '') AS text FROM page_analyses WHERE document_id IS NOT NULL AND page_number IS NOT NULL),
p1 AS (SELECT doc_id, page, page_id, {_S('text')} AS text, text AS whole FROM p0 QUALIFY row_number() OVER (PARTITION BY doc_id, page ORDER BY page_id) = 1),
p2 AS (SELECT *, page_id % 6 <> 0 AS answered, length(text) AS n, {O._any('whole', M.CORRECTION_KEYWORDS)} OR regexp_matches(whole, {_Q('(?i)' + M.CORRECTION_VALUE)}) AS rule_corr, {O._cleaned('text')} AS clean FROM p1),
pe AS (SELECT doc_id, page, page_id, answered, clean, CASE WHEN n < 80 THEN 200 ELSE 150 END AS dpi,
  CASE WHEN answered AND page_id % 4 = 1 THEN 'noisy' WHEN answered AND page_id % 4 = 3 THEN 'degraded' WHEN n > 200 THEN 'clean' WHEN n > 0 THEN 'degraded' ELSE 'unreadable' END AS text_quality,
  CASE WHEN answered AND page_id % 3 = 1 THEN false WHEN answered AND page_id % 3 = 2 THEN true ELSE n < 100 END AS has_degraded_text,
  CASE WHEN NOT answered OR page_id % 5 = 0 THEN rule_corr ELSE page_id % 5 IN (2, 3) END AS is_correction_page, answered AND page_id % 5 IN (2, 3) AS told_correction,
  CASE WHEN answered AND page_id % 4 = 1 THEN 'main' WHEN answered AND page_id % 4 = 2 THEN 'addendum' ELSE 'unknown' END AS page_type FROM p2)"""
_VALUES = f"""
v AS (SELECT {O._DOC} AS doc_id, field, {O._FIELD} AS clean, fv_id, raw_value, confidence, confidence_reason, evidence, source_page, corrected, correction_page, correction_date FROM field_values WHERE field IS NOT NULL),
al(name, f) AS (VALUES {O._ALIASES}),
vk AS (SELECT v.*, coalesce(al.f, translate({_S('lower(v.field)')}, ' -.', '__')) AS canonical FROM v LEFT JOIN al ON al.name = translate({_S('lower(v.field)')}, ' -.', '__')),
-- one entry a name of a page
en AS (SELECT vk.* FROM vk JOIN pe ON pe.doc_id = vk.doc_id AND pe.page = vk.source_page WHERE pe.answered AND NOT corrected QUALIFY row_number() OVER (PARTITION BY vk.doc_id, vk.source_page, vk.field ORDER BY fv_id) = 1)"""
_CANDIDATES = f"""
oc0 AS (SELECT doc_id, source_page AS page, fv_id, field AS name, canonical AS field, {_S('raw_value')} AS value, CASE WHEN confidence IN ('high', 'medium', 'low') THEN confidence ELSE 'medium' END AS confidence, confidence_reason, evidence FROM en
  WHERE fv_id % 10 NOT IN (7, 8, 9) AND field <> '' AND NOT {O._NULLISH('raw_value')}),
sn AS (SELECT doc_id, name, min((page, fv_id)) AS first FROM oc0 GROUP BY 1, 2),
occ AS (SELECT o.*, s.first, cp.doc_id IS NOT NULL AS on_corr FROM oc0 o JOIN sn s ON s.doc_id = o.doc_id AND s.name = o.name LEFT JOIN pe cp ON cp.doc_id = o.doc_id AND cp.page = o.page AND cp.is_correction_page),
f_any AS (SELECT * FROM occ QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY page, first, fv_id) = 1),
f_plain AS (SELECT * FROM occ WHERE NOT on_corr QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY page, first, fv_id) = 1),
td AS (SELECT vk.doc_id, canonical AS field, CASE WHEN fv_id % 7 = 1 OR raw_value IS NULL THEN 'None' ELSE {_S('raw_value')} END AS value, pe.page, coalesce(correction_date, '') AS date, fv_id AS ord, 0 AS origin FROM vk JOIN pe ON pe.doc_id = vk.doc_id AND pe.page = vk.correction_page
  WHERE corrected AND pe.answered AND pe.is_correction_page AND fv_id % 7 NOT IN (0, 2) AND vk.field <> ''),
td1 AS (SELECT * FROM td WHERE value <> '' AND field <> ''),
tx AS ({" UNION ALL ".join(f"SELECT doc_id, {_Q(f)} AS field, {_Q(b)} || regexp_extract(clean, {_Q(p)}, 1) || {_Q(a)} AS value, page, list_extract(regexp_extract_all(clean, '(\\d{{1,2}}/\\d{{1,2}}/\\d{{2,4}})', 1), -1) AS date, {i} AS ord, 1 AS origin FROM pe WHERE regexp_matches(clean, {_Q('(?i)' + M.CORRECTION_TRIGGER)}) AND regexp_extract(clean, {_Q(p)}, 1) <> ''" for i, (f, p, b, a) in enumerate(M.REVISION_PATTERNS))}),
cand0 AS (SELECT * FROM td1 UNION ALL SELECT * FROM tx WHERE (doc_id, field, page) NOT IN (SELECT (doc_id, field, page) FROM td1)),
cand1 AS (SELECT *, regexp_extract(date, '(\\d{{1,2}})[/.\\-](\\d{{1,2}})[/.\\-](\\d{{2,4}})', ['m', 'd', 'y']) AS t FROM cand0 WHERE field NOT IN {_IN(M.UNCORRECTED_FIELDS)}),
cand AS (SELECT *, try_cast(t.m AS INT) AS m, try_cast(t.d AS INT) AS d, CASE WHEN try_cast(t.y AS INT) < 100 THEN try_cast(t.y AS INT) + 2000 ELSE try_cast(t.y AS INT) END AS y FROM cand1),
win AS (SELECT * FROM cand QUALIFY row_number() OVER (PARTITION BY doc_id, field ORDER BY (y IS NOT NULL) DESC, y DESC NULLS LAST, m DESC NULLS LAST, d DESC NULLS LAST, page DESC, origin, ord) = 1)"""
# from the winners on, the same as for the resolver alone
_FIELDS = f"{_PAGES}, {_VALUES}, {_CANDIDATES}, {O._RESOLVED[O._RESOLVED.index('res AS (') :]}"
_ADJUSTED = f"""dg AS (SELECT DISTINCT doc_id, page FROM pe WHERE has_degraded_text OR text_quality IN ('degraded', 'unreadable')),
aj0 AS (SELECT r.*, dg.doc_id IS NOT NULL AS degraded, CASE confidence WHEN 'high' THEN 2 WHEN 'low' THEN 0 ELSE 1 END AS lv, {O._format_bad('r.field', 'r.raw_value')} AS bad FROM res r LEFT JOIN dg ON dg.doc_id = r.doc_id AND dg.page = r.source_page),
aj1 AS (SELECT *, CASE WHEN bad IS NOT NULL THEN greatest(lv - 1, 0) ELSE lv END AS l1 FROM aj0),
aj AS (SELECT *, l1 = 2 AND degraded AS worn FROM aj1)"""
_TABLES = f"""
tr0 AS (SELECT doc_id, source_page AS page, fv_id, row_number() OVER (PARTITION BY doc_id, source_page ORDER BY fv_id) - 1 AS row_ord, replace(clean, '_', ' ') AS label, coalesce(raw_value, '') AS amount FROM en),
lb(l, f) AS (VALUES {O._LABELS}),
tr1 AS (SELECT t.doc_id, t.page, t.row_ord, {_S('t.label')} AS label, {_S('t.amount')} AS amount, CASE WHEN pe.page_id % 2 = 1 THEN 'Fees' ELSE 'Table (p' || pe.page || ')' END AS name, CASE WHEN pe.text_quality = 'clean' THEN 'high' ELSE 'medium' END AS confidence FROM tr0 t JOIN pe ON pe.doc_id = t.doc_id AND pe.page = t.page),
tr2 AS (SELECT tr1.*, lb.f AS field, {O._CELL("nullif(amount, '')")} AS cell FROM tr1 LEFT JOIN lb ON lb.l = lower(nullif(label, ''))),
tr AS (SELECT tr2.*, CASE WHEN res.doc_id IS NOT NULL THEN {O._CELL('res.raw_value')} END AS fval FROM tr2 LEFT JOIN res ON res.doc_id = tr2.doc_id AND res.field = tr2.field)"""
_KINDS = O._KIND.replace(O._V, "nullif(raw_value, '')")
_ELEMENTS = f"""
el AS (SELECT v.doc_id, pe.page, CASE WHEN v.fv_id % 3 = 1 THEN 'stamp' ELSE 'image' END AS element_type, {_S('v.evidence')} AS description, CASE WHEN v.fv_id % 2 = 1 AND v.confidence IN ('high', 'medium', 'low') THEN v.confidence ELSE 'medium' END AS confidence
  FROM v JOIN pe ON pe.doc_id = v.doc_id AND pe.page = v.source_page WHERE pe.answered AND v.evidence IS NOT NULL AND v.fv_id % 11 <> 0 AND NOT {O._any('v.evidence', M.NEGATIONS)})"""
_BLOCKS = f"""
bl0 AS (SELECT {O._DOC} AS doc_id, b.page, coalesce({_S('location')}, 'unknown') AS location, coalesce({_S('partial_text')}, '') AS partial_text, coalesce(reason, 'degraded scan') AS reason, CASE WHEN confidence IN ('medium', 'low') THEN confidence ELSE 'low' END AS confidence FROM degraded_blocks b),
bl AS (SELECT bl0.* FROM bl0 JOIN pe ON pe.doc_id = bl0.doc_id AND pe.page = bl0.page WHERE pe.answered AND (partial_text <> '' OR location <> ''))"""
_FLAGGED = f"{O._sums()}, {O._generic('gn', 'nm', tuple({t for _, t, _, _ in M.SUM_CHECKS}))}, {O._RATIO.replace(chr(39) + 'note_rate' + chr(39), chr(39) + '-' + chr(39)).replace(chr(39) + 'interest_rate' + chr(39), chr(39) + '-' + chr(39))}, nmd AS (SELECT * FROM sm UNION ALL SELECT * FROM rt), fl AS (SELECT * FROM nmd UNION ALL SELECT * FROM gn WHERE (doc_id, field) NOT IN (SELECT (doc_id, field) FROM nmd))"
_SCORED = O._scores().replace(O._PAGES, f"{_PAGES}, pg AS (SELECT doc_id, page, clean AS text FROM pe)")
_SCORED = _SCORED[: _SCORED.index("cl AS (")]
_SUMMARY = f"""sf AS (SELECT doc_id, source_page AS page, string_agg(field, '|' ORDER BY fv_id) AS fields FROM en GROUP BY 1, 2),
su AS (SELECT pe.doc_id, pe.page, page_type, coalesce(sf.fields, '') AS fields, told_correction AS is_correction_page FROM pe LEFT JOIN sf ON sf.doc_id = pe.doc_id AND sf.page = pe.page)"""
_TYPES = f"""{_SCORED}
td0 AS (SELECT doc_id, arg_min(page_type, page) AS page_type, count(*) AS n FROM pe GROUP BY 1),
tdt AS (SELECT doc_id, CASE page_type WHEN 'main' THEN 'Deed of Trust' WHEN 'addendum' THEN 'Closing Disclosure' ELSE 'Other' END AS tt, ['low', 'medium', 'high'][n % 3 + 1] AS tc FROM td0 WHERE n % 4 > 0),
ty AS (SELECT c.doc_id, CASE WHEN sure THEN best WHEN tt IS NULL THEN CASE WHEN b >= 2 THEN best ELSE 'Unknown' END WHEN tc = 'high' THEN tt WHEN b > 0 THEN best ELSE tt END AS doc_type,
  CASE WHEN sure AND (tt IS NULL OR tt = best) THEN 'high' WHEN sure THEN 'medium' WHEN tt IS NULL THEN CASE WHEN b >= 2 THEN 'medium' ELSE 'low' END WHEN tc = 'high' THEN 'high' WHEN tc = 'medium' AND b >= 2 THEN 'medium' ELSE 'low' END AS confidence,
  CAST(b AS BIGINT) AS best_score, CAST(s AS BIGINT) AS second_score, CAST(NULL AS VARCHAR) AS reason FROM (SELECT *, b >= 3 AND (s = 0 OR b >= 1.5 * s) AS sure FROM cl0) c LEFT JOIN tdt ON tdt.doc_id = c.doc_id
  UNION ALL SELECT 'err-' || unit_code, 'Unknown', 'low', 0, 0, 'ValueError: ' || unit_code FROM measure_units)"""
_COUNT = lambda t: f"(SELECT doc_id, count(*) AS n FROM {t} GROUP BY 1)"
_ALL = f"WITH {_TYPES}, {_FIELDS.replace(_PAGES + ',', '')}, {_FLAGGED}, {_TABLES}, {_ELEMENTS}, {_BLOCKS}"
_N = lambda names: "".join(f" LEFT JOIN {_COUNT(t)} {t}_n ON {t}_n.doc_id = ty.doc_id" for t in names)

ORACLES = {
    "engine_pages": f"WITH {_PAGES} SELECT doc_id, page, dpi, text_quality, has_degraded_text, is_correction_page, page_type, md5(clean) AS digest FROM pe",
    "engine_fields": f"""WITH {_FIELDS}, {_ADJUSTED} SELECT doc_id, field, raw_value, source_page, ['low', 'medium', 'high'][CASE WHEN worn THEN 2 ELSE l1 + 1 END] AS confidence,
  CASE WHEN l1 < 2 OR worn THEN nullif(concat_ws('; ', nullif(confidence_reason, ''), CASE WHEN bad IS NOT NULL THEN 'not in the format of ' || bad END, CASE WHEN worn THEN 'page ' || source_page || ' is degraded' END), '') END AS confidence_reason,
  corrected, original_value, original_page, correction_page, correction_date, rule, {_KINDS} AS kind, CASE {_KINDS} WHEN 'money' THEN {O._money(O._V)} WHEN 'percent' THEN {O._PCT} END AS num, CASE {_KINDS} WHEN 'date' THEN {O._DATE} WHEN 'text' THEN {_S(O._V)} END AS str FROM aj""",
    "engine_corrections": f"WITH {_FIELDS} SELECT doc_id, field, original_value, original_page, raw_value AS corrected_value, correction_page, correction_date, rule FROM res WHERE corrected",
    "engine_table_rows": f"""WITH {_FIELDS}, {_TABLES} SELECT doc_id, page, 1 AS table_ord, name, confidence, CAST(row_ord AS INT) AS row_ord, label, amount, CASE WHEN abs(cell - fval) > {M.CELL_TOLERANCE} THEN 'possible read error: field says ' || format('{{:,.2f}}', fval) END AS notes, field, coalesce(abs(cell - fval) > {M.CELL_TOLERANCE}, false) AS differs FROM tr""",
    "engine_elements": f"WITH {_PAGES}, {_VALUES}, {_ELEMENTS} SELECT * FROM el",
    "engine_blocks": f"WITH {_PAGES}, {_BLOCKS} SELECT * FROM bl",
    "engine_mismatches": f"WITH {_FIELDS}, {_FLAGGED} {O._FLAGS} fl",
    "engine_summaries": f"WITH {_PAGES}, {_VALUES}, {_SUMMARY} SELECT * FROM su",
    "engine_types": f"WITH {_TYPES} SELECT * FROM ty",
    "engine_counts": f"""{_ALL}, tn AS (SELECT DISTINCT doc_id, page, name FROM tr), co AS (SELECT * FROM res WHERE corrected)
SELECT ty.doc_id, coalesce(pe_n.n, 0) AS n_pages, coalesce(res_n.n, 0) AS n_fields, coalesce(tn_n.n, 0) AS n_tables, coalesce(co_n.n, 0) AS n_corrections, coalesce(fl_n.n, 0) AS n_mismatches FROM ty{_N(('pe', 'res', 'tn', 'co', 'fl'))}""",
    "engine_documents": f"""{_ALL}, co AS (SELECT * FROM res WHERE corrected), fd AS (SELECT doc_id, md5(string_agg(field, '|' ORDER BY field)) AS digest FROM res GROUP BY 1)
SELECT ty.doc_id, ty.doc_type, ty.confidence, CAST(coalesce(res_n.n, 0) AS INT) AS n_fields, CAST(coalesce(co_n.n, 0) AS INT) AS n_corrections, CAST(coalesce(tr_n.n, 0) AS INT) AS n_table_rows, CAST(coalesce(el_n.n, 0) AS INT) AS n_elements, CAST(coalesce(bl_n.n, 0) AS INT) AS n_degraded_blocks,
  CAST(coalesce(fl_n.n, 0) AS INT) AS n_mismatches, coalesce(fd.digest, md5('')) AS digest FROM ty{_N(('res', 'co', 'tr', 'el', 'bl', 'fl'))} LEFT JOIN fd ON fd.doc_id = ty.doc_id""",
}
