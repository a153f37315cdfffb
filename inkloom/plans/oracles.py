"""DuckDB SQL that gives what the queries give, over the same tables."""

from __future__ import annotations

from inkloom.functions import patterns as P


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def has(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {q(pattern)})"


def count(t: str, pattern: str) -> str:
    return f"len(regexp_extract_all({t}, {q(pattern)}))"


def listed(words: list[str]) -> str:
    return "[" + ", ".join(map(q, words)) + "]"


def among(words: list[str]) -> str:
    return "(" + ", ".join(map(q, words)) + ")"


TRIM = r"'^\s+|\s+$', '', 'g'"
SQUEEZE = r"trim(regexp_replace({0}, '\s+', ' ', 'g'))"

BLOCKS = rf"""
d AS (SELECT d.*, l.quality, l.toxic FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
b0 AS (
  SELECT 'p' || (doc_id // 100) AS project_id, coalesce(source, 'unknown') AS series_label, CAST(doc_id // 10 AS INT) AS page_index, doc_id AS seq, 'd' || doc_id AS block_id,
    'pages/' || source || '/v' || (doc_id % 3) || '/p' || (doc_id // 10) || '.png' AS image_name,
    CAST(doc_id % 2 * 100 AS INT) AS x1, CAST(doc_id % 10 // 2 * 60 + doc_id // 10 % 3 * 5 AS INT) AS y1, coalesce(lang, 'en') AS source_lang, coalesce(text, '') AS ocr_text,
    CASE WHEN doc_id % 5 = 0 THEN coalesce(replace(text, 'the', 'The'), '') ELSE '' END AS ocr_corrected_text,
    CASE doc_id % 4 WHEN 0 THEN coalesce(text, '') WHEN 1 THEN regexp_extract(coalesce(text, ''), '^[^.!?]*') WHEN 2 THEN translate(regexp_extract(coalesce(text, ''), '^[^ .]*'), 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE '' END AS translation_fr,
    CASE doc_id % 11 WHEN 0 THEN '[sfx] bruit' WHEN 1 THEN '[fusion] bulle' WHEN 2 THEN '[zone] coupé' ELSE '' END AS review_notes,
    CASE WHEN quality IS NOT NULL THEN doc_id % 101 / 100 END AS confidence, CAST(doc_id % 10 AS INT) AS reading_order,
    CASE WHEN toxic = 1 THEN 'ignored' WHEN quality = 1 THEN 'validated' WHEN quality = 0 THEN 'review' ELSE 'unchecked' END AS manual_status,
    CASE doc_id % 7 WHEN 0 THEN ['w1'] WHEN 1 THEN ['w1', 'w2'] ELSE [] END AS warnings
  FROM d),
b AS (SELECT *, x1 + 80 AS x2, y1 + 40 AS y2, CASE WHEN seq % 6 = 0 THEN lower(translation_fr) ELSE '' END AS raw_translation_fr, len(warnings) AS nw,
    regexp_replace(coalesce(nullif(ocr_corrected_text, ''), ocr_text), {TRIM}) AS source, regexp_replace(translation_fr, {TRIM}) AS translation FROM b0)"""

TOKENS = f"regexp_extract_all({{0}}, {q(P.TOKEN)})"


def _tokens(t: str, least: int = 1) -> str:
    return f"list_distinct([trim(lower(w), '''') for w in {TOKENS.format(t)} if len(w) >= {least}])"


def _safe(t: str) -> str:
    return f"regexp_replace(lower({t}), '[^a-z]+', '', 'g') IN {among(P.SAFE_UNTRANSLATED)}"


def quality_rules() -> list[tuple[str, str, str]]:
    s, t = "source", "translation"
    copied = f"len([w for w in list_intersect({_tokens(s, 4)}, {_tokens(t, 4)}) if NOT list_contains({listed(P.SAFE_COPIES)}, w)])"
    same = f"lower({SQUEEZE.format(s)}) = lower({SQUEEZE.format(t)})"
    return [
        ("nw > 0", "least(35, 9 * nw)", "'QC warnings: ' || nw"),
        ("confidence < 0.35", "30", q("OCR confidence very low")),
        ("confidence >= 0.35 AND confidence < 0.60", "16", q("OCR confidence low")),
        ("source = ''", "30", q("empty source")),
        ("translation = ''", "35", q("empty translation")),
        (f"source <> '' AND {same} AND NOT {_safe(s)}", "32", q("translation identical to source")),
        (f"{has(s, P.SYMBOLS)} OR {has(t, P.SYMBOLS)}", "22", q("suspicious symbols")),
        (has(s, P.TYPO), "22", q("known OCR typo pattern")),
        (has(s, P.LINE_BREAK), "16", q("probable OCR line-break hyphen")),
        ("ns >= 3 AND nt <= 1", "24", q("translation too short")),
        ("ns <= 2 AND confidence < 0.75", "12", q("short uncertain OCR fragment")),
        (f"len(list_intersect({_tokens(t)}, {listed(P.ENGLISH)})) >= 2 AND NOT {_safe(t)}", "24", q("obvious English residue in French translation")),
        (f"{has(t, P.RESIDUE_WORD)} AND NOT {_safe(t)}", "28", q("probable English residue in French translation")),
        (f"{copied} > 0 AND NOT {_safe(s)}", f"CASE WHEN {copied} = 1 THEN 22 ELSE 30 END", q("source residue copied into translation")),
        (has(s, P.DIGIT_MIX), "18", q("OCR digit/symbol confusion")),
        (f"len([w for w in regexp_split_to_array(translation, '[^\\p{{L}}\\p{{N}}_]+') if regexp_matches(w, '^[A-Z]{{3,}}$') AND w NOT IN {among(P.SAFE_UPPERCASE)}]) > 0", "18", q("uppercase residue in translation")),
        (has(s, P.RANDOM_CASE), "10", q("random OCR casing")),
        (f"contains(source, ':') AND NOT {has(s, P.COLON_OK)}", "16", q("suspect colon punctuation")),
        (f"ns >= 3 AND {has(s, P.WEAK_END)}", "16", q("probable missing ellipsis or strong punctuation")),
        (f"{has(s, P.QUESTION_START)} AND NOT contains(source, '?')", "18", q("probable missing question mark")),
    ]


_RULES = quality_rules()
QUALITY = f"""{BLOCKS},
q0 AS (SELECT *, len({TOKENS.format('source')}) AS ns, len({TOKENS.format('translation')}) AS nt FROM b),
q1 AS (SELECT *, [{', '.join(f'CASE WHEN {c} THEN {p} ELSE 0 END' for c, p, _ in _RULES)}] AS points, [{', '.join(f'CASE WHEN {c} THEN {r} END' for c, _, r in _RULES)}] AS whys FROM q0),
q2 AS (SELECT *, CAST(least(100, list_sum(points)) AS INT) AS risk_score, array_to_string([w for w in whys if w IS NOT NULL], ' | ') AS reasons FROM q1),
qq AS (SELECT *, CASE WHEN manual_status IN ('validated', 'ignored') THEN manual_status WHEN risk_score >= 55 THEN 'review_high' WHEN risk_score >= 25 THEN 'review_medium' ELSE 'probably_ok' END AS suggested_action FROM q2)"""
ACTIVE = "suggested_action NOT IN ('ignored', 'validated')"
HIGH = "(risk_score >= 55 OR suggested_action = 'review_high')"

QUEUE = f"""{BLOCKS},
fr AS (SELECT *, lower(regexp_replace(coalesce(nullif(translation_fr, ''), raw_translation_fr), {TRIM})) AS t, lower(source) AS s, lower(review_notes) AS note FROM b),
qu AS (SELECT *, greatest(0, least(100, least(70, 15 * nw) + CASE WHEN confidence < 0.35 THEN 25 ELSE 0 END + CASE WHEN t = '' THEN 35 ELSE 0 END + CASE WHEN s <> '' AND s = t THEN 35 ELSE 0 END
    + CASE WHEN manual_status IN ('review', 'unchecked') THEN 5 WHEN manual_status IN ('validated', 'ignored') THEN -20 ELSE 0 END)) AS risk,
  CASE WHEN manual_status = 'ignored' AND note LIKE '[sfx]%' THEN 'sfx' WHEN manual_status = 'review' AND note LIKE '[fusion]%' THEN 'fused' WHEN manual_status = 'review' AND note LIKE '[zone]%' THEN 'zone'
    WHEN manual_status = 'validated' THEN 'validate' WHEN manual_status = 'ignored' THEN 'ignore' WHEN manual_status = 'review' THEN 'review' WHEN manual_status = 'edited' THEN 'correct' ELSE 'unchecked' END AS decision FROM fr),
qv AS (SELECT *, CASE WHEN risk >= 55 THEN 'HIGH' WHEN risk >= 25 THEN 'MED' ELSE 'OK' END AS band FROM qu)"""

SENTENCES = r"""
d AS (SELECT d.*, l.quality FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id),
s0 AS (SELECT *, unnest(regexp_extract_all(text, '[^.!?\n]+[.!?]*')) AS part, generate_subscripts(regexp_extract_all(text, '[^.!?\n]+[.!?]*'), 1) - 1 AS i FROM d),
s1 AS (SELECT *, trim(part) AS t FROM s0),
st AS (SELECT 'p' || (doc_id // 100) AS project_id, CAST(doc_id AS INT) AS page_index, 's_' || doc_id || '_' || i AS block_id, coalesce(lang, 'en') AS source_lang,
    CASE WHEN doc_id % 3 = 0 THEN 'phase 4 ' || t WHEN i % 9 = 0 THEN 'SLAM!' WHEN i % 13 = 0 THEN 'card fee ' || t WHEN i % 7 = 0 THEN 'only ' || t ELSE t END AS text,
    CASE WHEN quality = 1 THEN 'validated' WHEN quality = 0 THEN 'review' ELSE 'unchecked' END AS manual_status FROM s1),
sv AS (SELECT *, regexp_replace(text, '^\s+|\s+$', '', 'g') AS t, trim(regexp_replace(text, '\s+', ' ', 'g')) AS v FROM st)"""


def _noise() -> str:
    up, bare = "upper(v)", "trim(upper(v), ' .!?:,-')"
    capitals = "regexp_replace(upper(v), '[^A-Z]', '', 'g')"
    return f"""CASE WHEN v = '' THEN true WHEN {bare} IN ('NO', 'OK') THEN false WHEN {up} IN {among(P.SFX_WORDS)} OR {bare} IN {among(P.SFX_WORDS)} THEN true
      WHEN {has('v', r'(?i)(?:^|[^\p{L}\p{N}_])sfx\s*:')} AND {count('v', '[A-Za-z0-9]+')} <= 6 THEN true
      WHEN {has('v', P.bounded('sparkle'))} AND {count('v', '[A-Za-z]+')} <= 3 THEN true
      WHEN {count('v', r'\p{L}')} <= 2 THEN true
      WHEN len({capitals}) >= 5 AND len(list_distinct(regexp_extract_all({capitals}, '.'))) <= 3 AND {up} = v THEN true
      WHEN {has('v', P.LONG_CRY)} THEN true ELSE false END"""


_SIGNS = " + ".join(f"CAST({has('lower(v)', P.bounded(w))} AS INT)" for w in P.SIGNAGE)
_TECH = f"({has('v', P.MEASURE)} OR {has('v', P.bounded(P.TECHNICAL))} OR lower(v) IN ('stab', 'hall', 'drift', 'main hall', 'phase 4', 'phase 5'))"
_TALK = f"({count('t', P.DIALOGUE_WORD)} >= 5 OR {has('t', P.bounded(P.either(P.DIALOGUE)))})"
_PROFILE = f"({has('v', P.bounded(P.PROFILE))} OR ({count('v', P.DIALOGUE_WORD)} >= 8 AND len([w for w in regexp_extract_all(v, {q(P.DIALOGUE_WORD)}) if regexp_matches(w, '^[A-Z][a-z]{{2,}}$')]) >= 4 AND NOT {has('v', '[!?]')}))"
REASONS = f"""{SENTENCES},
r0 AS (SELECT *, CASE WHEN {has('t', P.bounded(P.CREDIT))} THEN 'credit scantrad' WHEN {_SIGNS} >= 2 THEN 'signalétique/interface' WHEN {_TECH} THEN 'infographie/signaletique' WHEN {_noise()} THEN 'sfx/bruit' ELSE '' END AS own,
    {_TECH} AS technical, {_TALK} AS talk, {_PROFILE} AS prof, {has('t', '[!?]')} AS marks FROM sv),
pg AS (SELECT project_id, page_index, count(*) AS n, count(*) FILTER (technical) AS nt, count(*) FILTER (talk) AS nd, count(*) FILTER (prof) AS np, count(*) FILTER (marks) AS nm, count(*) FILTER (own <> '') AS nr FROM r0 GROUP BY ALL),
pv AS (SELECT project_id, page_index, CASE WHEN n < 6 THEN '' WHEN nt >= 5 AND nr / n >= 0.55 AND nd <= greatest(2, n // 5) THEN 'page non exploitable: infographie/signaletique'
    WHEN np >= greatest(4, n // 2) AND nm <= greatest(1, n // 5) THEN 'page non exploitable: fiche personnages/extra dense' WHEN nr / n >= 0.75 AND nd <= greatest(1, n // 6) THEN 'page non exploitable: non-dialogue' ELSE '' END AS page_reason FROM pg),
rr AS (SELECT r0.*, page_reason, coalesce(nullif(page_reason, ''), own) AS reason FROM r0 JOIN pv USING (project_id, page_index))"""


def _zones() -> tuple[str, str]:
    n = count("v", P.ZONE_WORD)
    closed, end, start, phrase = has("v", P.TERMINAL), has("v", P.ZONE_END), has("v", P.ZONE_START), has("v", P.ZONE_PHRASE)
    dots = has("v", r"^(?:\.\.\.|\. )")
    small = f"{n} >= 2 AND ({phrase} OR {has('v', '[,:;]$')} OR ({n} >= 3 AND NOT {closed} AND {end}))"
    split = f"{n} >= 2 AND ({dots} OR ({start} AND NOT {closed}))"
    mixed = f"{has('v', P.ZONE_SFX)} AND {n} >= 4"
    fused = f"{n} >= 3 AND (({mixed}) OR {has('v', P.FUSED_PHRASE)} OR ({n} >= 14 AND {has('v', P.INNER_BREAK)}))"
    cats = ", ".join(f"CASE WHEN {c} THEN '{k}' END" for c, k in ((small, "zone_too_small"), (split, "split_bubble"), (mixed, "sfx_mixed"), (fused, "fused_bubble")))
    incomplete = f"{n} >= 2 AND ({phrase} OR ({has('v', '[,:;]$')} AND {n} >= 3) OR {dots} OR (NOT {closed} AND ({start} OR {end} OR ({n} >= 5 AND {has('v', P.CLAUSE)}))))"
    return f"array_to_string([c for c in [{cats}] if c IS NOT NULL], ',')", incomplete


def ignore_key(t: str) -> str:
    x = f"trim(lower({SQUEEZE.format(f'replace({t}, {q(chr(8217))}, {q(chr(39))})')}), {q(chr(34) + chr(39) + '`´‘’“” ')})"
    x = f"regexp_replace({x}, '\\s+([,.;:!?])', '\\1', 'g')"
    return SQUEEZE.format(x)


def memory_key(t: str) -> str:
    return f"regexp_replace(regexp_replace(regexp_replace({ignore_key(t)}, '[:.]+$', ''), '!+$', '!'), '\\?+$', '?')"


def replay_key(t: str) -> str:
    x = f"lower({SQUEEZE.format(f'replace({t}, {q(chr(8217))}, {q(chr(39))})')})"
    x = f"regexp_replace({x}, '\\s+([,.;:!?])', '\\1', 'g')"
    return f"regexp_replace(regexp_replace({x}, {q('[“”' + chr(34) + '`´]')}, '', 'g'), '\\.{{2,}}', '...', 'g')"


TURNS = """
c AS (SELECT *, CASE WHEN lead(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' THEN lead(text) OVER (PARTITION BY conv_id ORDER BY turn) END AS reply FROM conversations),
tb AS (SELECT 'conversations' AS project_id, 'c' || (conv_id % 5) AS series_label, CAST(conv_id AS INT) AS page_index, conv_id * 1000 + turn AS seq, 't_' || conv_id || '_' || turn AS block_id, coalesce(text, '') AS ocr_text, coalesce(reply, '') AS translation_fr,
  CASE conv_id % 5 WHEN 0 THEN replace(text, '.', '!') WHEN 1 THEN reverse(text) WHEN 2 THEN translate(text, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE '' END AS fixed FROM c WHERE role = 'user')"""

REVIEW = r"""
rv AS (SELECT page_index, CASE WHEN seq % 20 = 18 THEN 'x' || block_id ELSE block_id END AS block_id, ['ignore', 'sfx', 'fused', 'zone', 'ok', 'edit', '', 'maybe', 'a revoir', 'merge'][CAST(seq // 2 % 10 AS INT) + 1] AS d,
    CASE WHEN seq % 3 = 0 THEN 'ocr ' || block_id ELSE '' END AS ocr, CASE WHEN seq % 7 = 0 THEN 'fr' ELSE '' END AS fr, CASE WHEN seq % 4 = 0 THEN 'note' ELSE '' END AS note FROM b WHERE seq % 2 = 0),
rn AS (SELECT *, trim(CASE WHEN d = 'sfx' THEN '[sfx] ' || note WHEN d IN ('fused', 'merge') THEN '[fusion] ' || note WHEN d = 'zone' THEN '[zone] ' || note ELSE note END) AS notes,
    CASE WHEN d IN ('ignore', 'sfx') THEN 'ignored' WHEN d IN ('fused', 'zone', 'a revoir', 'merge', 'maybe') AND NOT (d = 'maybe' AND (ocr <> '' OR fr <> '')) THEN 'review' WHEN d = 'ok' THEN 'validated' WHEN d = 'edit' OR ocr <> '' OR fr <> '' THEN 'corrected' ELSE 'skipped' END AS outcome FROM rv),
ap AS (SELECT b.*, rn.d, rn.ocr, rn.notes, rn.outcome FROM b LEFT JOIN rn USING (page_index, block_id))"""

TERM = r"[A-Z][A-Za-z'’-]+"
LEARN = "manual_status IN ('edited', 'validated') AND translation <> ''"
VOTES = "v AS (SELECT lower(regexp_extract(text, '^[A-Za-z]+')) AS key, lang AS value, doc_id AS seq FROM documents WHERE regexp_extract(text, '^[A-Za-z]+') <> '')"
MAJORITY = """n AS (SELECT key, value, count(*) AS votes, min(seq) AS f FROM {0} GROUP BY ALL),
m AS (SELECT key, value, votes, row_number() OVER (PARTITION BY key ORDER BY votes DESC, f, value) AS rn, count(*) OVER (PARTITION BY key) AS n_values FROM n)
SELECT key, value, votes, n_values FROM m WHERE rn = 1"""
VOLUMES = "v AS (SELECT DISTINCT series_label, 'v' || (seq % 12) AS volume, seq % 12 AS k FROM b)"
BENCH = "bm AS (SELECT {0} AS key, max_by(CAST(item_id AS VARCHAR), item_id) AS found FROM benchmark GROUP BY 1)".format(memory_key("text"))
LINES = "ln AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line FROM documents UNION ALL SELECT -item_id - 1, '  ' || text || ' ...', 0 FROM benchmark)"


def _iou() -> str:
    ix, iy = "greatest(0, least(t.x2, f.x2) - greatest(t.x1, f.x1))", "greatest(0, least(t.y2, f.y2) - greatest(t.y1, f.y1))"
    return f"""{BLOCKS},
f AS (SELECT project_id, page_index, 'n' || block_id AS mid, seq, x1 + CAST(seq % 5 * 9 AS INT) AS x1, y1 + CAST(seq % 5 * 9 AS INT) AS y1, x2 + CAST(seq % 5 * 9 AS INT) AS x2, y2 + CAST(seq % 5 * 9 AS INT) AS y2 FROM b WHERE seq % 8 <> 7),
pr AS (SELECT t.project_id, t.page_index, t.block_id, f.mid, f.seq, ({ix} * {iy}) / (3200 + 3200 - {ix} * {iy}) AS iou FROM b t JOIN f ON t.project_id = f.project_id AND t.page_index = f.page_index WHERE {ix} * {iy} > 0),
bp AS (SELECT *, row_number() OVER (PARTITION BY project_id, page_index, block_id ORDER BY iou DESC, seq) AS rn FROM pr)
SELECT t.page_index, t.block_id AS target_id, CASE WHEN coalesce(iou, 0) >= 0.35 THEN mid END AS matched_id, round(coalesce(iou, 0), 6) AS bbox_iou FROM b t LEFT JOIN bp ON t.project_id = bp.project_id AND t.page_index = bp.page_index AND t.block_id = bp.block_id AND rn = 1"""


def _filter(test: str) -> str:
    return f"WITH {BLOCKS} SELECT project_id, page_index, block_id, manual_status FROM b WHERE {test}"


K = "project_id, page_index, block_id"


def oracle_sql() -> dict[str, str]:
    zones, incomplete = _zones()
    stats = """count(*) AS total, count(*) FILTER (manual_status <> 'ignored') AS active, count(*) FILTER (nw > 0) AS warnings, count(*) FILTER (manual_status = 'review') AS review,
      count(*) FILTER (manual_status <> 'ignored' AND translation = '') AS untranslated, count(*) FILTER (manual_status = 'validated') AS validated, count(*) FILTER (manual_status = 'ignored') AS ignored"""
    token = f"unnest(regexp_extract_all(source, {q(P.PROFILE_TOKEN)}))"
    weird = f"len(token) >= 3 AND ({has('token', '[0-9$]')} OR {has('token', P.WEIRD_CASE)} OR (lower(token) NOT IN {among(P.ENGLISH_COMMON)} AND {has('lower(token)', P.WEIRD_RUN)}))"
    words4 = "list_distinct([lower(w) for w in regexp_extract_all({0}, " + q(P.PROFILE_TOKEN) + ") if len(w) >= 4])"
    names = rf"(?:^|[^\p{{L}}\p{{N}}_'’-])({P.CAPITALISED})"
    return {
        "block_view": f"WITH {BLOCKS} SELECT {K}, series_label, source_lang, reading_order, manual_status, round(confidence, 4) AS confidence, CAST(len(ocr_text) AS INT) AS n_text, CAST(nw AS INT) AS n_warnings, x1 || ',' || y1 || ',' || x2 || ',' || y2 AS box FROM b",
        "project_json_round_trip": f"WITH {BLOCKS} SELECT {K}, manual_status, reading_order, ocr_text, translation_fr, round(confidence, 4) AS confidence, CAST(nw AS INT) AS n_warnings FROM b",
        "review_pack_round_trip": f"WITH {QUALITY} SELECT page_index, block_id, risk_score, '' AS review_decision, source AS source_for_review FROM qq WHERE risk_score >= 25 AND {ACTIVE} ORDER BY risk_score DESC, page_index, block_id LIMIT 200",
        "manifest_entries": f"WITH {BLOCKS} SELECT DISTINCT regexp_replace(image_name, '/p(\\d+)\\.png$', '/scan__page_\\1.png') AS image_path, series_label, split_part(image_name, '/', 3) AS volume_label, greatest(0, page_index - 1) AS source_page_index FROM b",
        "light_quality": f"WITH {QUALITY} SELECT {K}, risk_score, suggested_action, CAST(ns AS INT) AS source_tokens, CAST(nt AS INT) AS translation_tokens, reasons FROM qq",
        "review_pack_balanced": f"""WITH {QUALITY}, e AS (SELECT *, row_number() OVER (PARTITION BY series_label ORDER BY risk_score DESC, page_index, block_id) AS rn, count(*) OVER (PARTITION BY series_label) AS size FROM qq WHERE risk_score >= 25 AND {ACTIVE})
            SELECT {K}, series_label, risk_score, suggested_action FROM e ORDER BY rn, size DESC, lower(series_label), series_label LIMIT 200""",
        "risk_bands": f"WITH {QUEUE} SELECT band, count(*) AS n, CAST(sum(risk) AS BIGINT) AS total FROM qv GROUP BY band",
        "filter_warnings": _filter("nw > 0"),
        "filter_review": _filter("manual_status = 'review'"),
        "filter_untranslated": _filter("manual_status <> 'ignored' AND translation = ''"),
        "filter_unvalidated": _filter("manual_status NOT IN ('validated', 'ignored')"),
        "filter_validated": _filter("manual_status = 'validated'"),
        "filter_ignored": _filter("manual_status = 'ignored'"),
        "search_terms": f"WITH {BLOCKS}, h AS (SELECT *, lower(concat_ws(chr(10), block_id, ocr_text, ocr_corrected_text, raw_translation_fr, translation_fr, array_to_string(warnings, chr(10)))) AS hay FROM b) SELECT {K} FROM h WHERE contains(hay, 'the') AND contains(hay, 'ing') AND contains(hay, 'w1')",
        "queue_view": f"""WITH {QUEUE} SELECT {K}, CAST(risk AS INT) AS risk, band, decision, MAP {{'validate': 'validé', 'correct': 'corrigé', 'review': 'à revoir', 'fused': 'fusion', 'zone': 'zone', 'ignore': 'ignoré', 'sfx': 'SFX', 'unchecked': 'brut'}}[decision] AS label, substring(replace(source, chr(10), ' '), 1, 70) AS source FROM qv""",
        "queue_summary": f"""WITH {QUEUE} SELECT count(*) AS total, count(*) FILTER (band = 'HIGH') AS high, count(*) FILTER (band = 'MED') AS medium, {', '.join(f"count(*) FILTER (decision = '{d}') AS {q_(d)}" for d in ('unchecked', 'validate', 'correct', 'review', 'fused', 'zone', 'ignore', 'sfx'))}, count(*) FILTER (decision IN ('unchecked', 'review')) AS todo FROM qv""",
        "refreshable_blocks": f"WITH {BLOCKS} SELECT {K}, manual_status IN ('validated', 'ignored') AS protected, {LEARN} AS learnable FROM b WHERE source_lang = 'en' AND manual_status IN ('unchecked', 'review')",
        "block_stats": f"WITH {BLOCKS} SELECT project_id, page_index, {stats} FROM b GROUP BY ALL",
        "project_stats": f"""WITH {BLOCKS}, p AS (SELECT project_id, page_index, {stats} FROM b GROUP BY ALL) SELECT project_id, count(*) AS pages, CAST(sum(total) AS BIGINT) AS blocks, CAST(sum(validated) AS BIGINT) AS validated_blocks, CAST(sum(warnings) AS BIGINT) AS warning_blocks, CAST(sum(review) AS BIGINT) AS review_blocks,
            count(*) FILTER (active > 0 AND untranslated = 0) AS translated_pages, count(*) FILTER (active > 0 AND validated = active) AS validated_pages FROM p GROUP BY project_id""",
        "renumber_order": f"WITH {BLOCKS} SELECT {K}, CAST(row_number() OVER (PARTITION BY project_id, page_index ORDER BY seq % 3, y1, x1, block_id) - 1 AS INT) AS reading_order FROM b",
        "spatial_order": f"WITH {BLOCKS} SELECT {K}, CAST(row_number() OVER (PARTITION BY project_id, page_index ORDER BY y1 + y2, x1 + x2, seq) - 1 AS INT) AS reading_order FROM b",
        "move_blocks": f"""WITH {BLOCKS}, o AS (SELECT *, row_number() OVER w - 1 AS pos, max(CASE WHEN seq % 10 = 3 THEN seq END) OVER (PARTITION BY project_id, page_index) AS mover FROM b WINDOW w AS (PARTITION BY project_id, page_index ORDER BY reading_order, seq)),
            f AS (SELECT *, max(CASE WHEN seq = mover THEN pos END) OVER (PARTITION BY project_id, page_index) AS src FROM o)
            SELECT {K}, CAST(CASE WHEN src >= 1 AND pos = src THEN src - 1 WHEN src >= 1 AND pos = src - 1 THEN src ELSE pos END AS INT) AS reading_order FROM f""",
        "edit_cascade": f"WITH {BLOCKS} SELECT {K}, CASE WHEN seq % 3 = 0 THEN 'edited ' || block_id ELSE ocr_corrected_text END AS ocr_corrected_text, CASE WHEN seq % 3 = 0 THEN '' ELSE raw_translation_fr END AS raw_translation_fr, CAST(CASE WHEN seq % 3 = 0 THEN 0 ELSE len(translation_fr) END AS INT) AS n_fr, CASE WHEN seq % 3 = 0 AND manual_status <> 'ignored' THEN 'edited' ELSE manual_status END AS manual_status, CAST(CASE WHEN seq % 3 = 0 THEN 0 ELSE nw END AS INT) AS n_warnings FROM b",
        "set_status": f"WITH {BLOCKS} SELECT {K}, CASE WHEN seq % 5 = 0 THEN 'validated' WHEN seq % 2 = 0 THEN 'review' ELSE manual_status END AS manual_status, CASE WHEN seq % 5 = 0 THEN '' WHEN seq % 2 = 0 THEN array_to_string(list_append(warnings, 'marqué à revoir manuellement'), '|') ELSE array_to_string(warnings, '|') END AS warnings FROM b",
        "split_lines": f"""WITH {BLOCKS}, l AS (SELECT *, [regexp_replace(s, {TRIM}) for s in string_split(replace(coalesce(nullif(ocr_corrected_text, ''), ocr_text), chr(13) || chr(10), chr(10)), chr(10)) if regexp_replace(s, {TRIM}) <> ''] AS ls FROM b),
            e AS (SELECT *, unnest(ls) AS line, generate_subscripts(ls, 1) - 1 AS i, len(ls) AS n FROM l WHERE len(ls) >= 2)
            SELECT project_id, page_index, block_id || '_s' || (i + 1) AS block_id, line AS ocr_text, CAST(row_number() OVER (PARTITION BY project_id, page_index ORDER BY reading_order, seq, i) - 1 AS INT) AS reading_order, CAST(y1 + floor(40 * i / n) AS INT) AS y1, CAST(greatest(y1 + floor(40 * i / n) + 1, y1 + floor(40 * (i + 1) / n)) AS INT) AS y2 FROM e""",
        "merge_blocks": f"""WITH {BLOCKS} SELECT project_id, page_index, arg_min(block_id, seq) AS block_id, string_agg(source, chr(10) ORDER BY reading_order, seq) FILTER (source <> '') AS ocr_text, round(avg(confidence), 6) AS confidence, count(*) AS n_merged, min(x1) || ',' || min(y1) || ',' || max(x2) || ',' || max(y2) AS box
            FROM b GROUP BY project_id, page_index, seq // 2 HAVING count(*) >= 2""",
        "apply_review": f"""WITH {BLOCKS}, {REVIEW} SELECT {K}, CASE outcome WHEN 'corrected' THEN 'edited' WHEN 'ignored' THEN 'ignored' WHEN 'review' THEN 'review' WHEN 'validated' THEN 'validated' ELSE manual_status END AS manual_status,
            CASE WHEN ocr <> '' THEN ocr ELSE ocr_corrected_text END AS ocr_corrected_text, CASE WHEN notes <> '' THEN notes ELSE review_notes END AS review_notes, outcome FROM ap""",
        "apply_review_counts": f"""WITH {BLOCKS}, {REVIEW} SELECT count(*) FILTER (outcome <> 'skipped') AS changed, count(*) FILTER (outcome = 'validated') AS validated, count(*) FILTER (outcome = 'corrected') AS corrected, count(*) FILTER (outcome = 'ignored') AS ignored, count(*) FILTER (outcome = 'review') AS review,
            count(*) FILTER (outcome = 'skipped') + (SELECT count(*) FROM rv WHERE block_id LIKE 'x%') AS skipped FROM ap""",
        "auto_ignore": f"""WITH {REASONS}, h AS (SELECT *, source_lang = 'en' AND reason <> '' AS hit FROM rr) SELECT {K}, CASE WHEN hit AND manual_status IN ('unchecked', 'review') THEN 'ignored' ELSE manual_status END AS manual_status, hit AND manual_status IN ('unchecked', 'review') AS auto_changed, CASE WHEN hit THEN 'auto-ignore: non-dialogue probable: ' || reason ELSE '' END AS warnings FROM h""",
        "page_verdict": f"WITH {REASONS} SELECT project_id, page_index, max(page_reason) AS page_reason, count(*) FILTER (reason <> '') AS n_reasons FROM rr GROUP BY ALL",
        "zone_categories": f"WITH {SENTENCES} SELECT {K}, {zones} AS categories, {incomplete} AS incomplete FROM sv",
        "canonical_keys": f"WITH {TURNS} SELECT {K}, {ignore_key('ocr_text')} AS ignore_key, {memory_key('ocr_text')} AS memory_key, {replay_key('ocr_text')} AS replay_key, regexp_replace(lower(ocr_text), '[^a-z0-9]', '', 'g') AS identity_key, left(sha1(lower(block_id)), 10) AS hash, series_label AS slug FROM tb",
        "natural_sort": r"""WITH p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host, [CASE WHEN regexp_matches(r, '^[0-9]') THEN '0' || lpad(regexp_replace(r, '^0+([0-9])', '\1'), 20, '0') ELSE '1' || r END for r in regexp_extract_all(lower(url), '\d+|\D+')] AS key FROM pages WHERE url IS NOT NULL)
            SELECT page_id, host, CAST(row_number() OVER (PARTITION BY host ORDER BY key, url, page_id) AS INT) AS rank FROM p""",
        "stratified_limit": "WITH r AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn, min(doc_id) OVER (PARTITION BY source) AS f FROM documents) SELECT doc_id, source FROM r ORDER BY rn, f LIMIT 150",
        "random_limit": "SELECT doc_id FROM documents WHERE doc_id >= 10 ORDER BY ((doc_id + 47) * 1103515245 + 12345) % 2147483647, doc_id LIMIT 100",
        "volume_ordinals": f"WITH {BLOCKS}, {VOLUMES}, s AS (SELECT low, row_number() OVER (ORDER BY low) AS series_index FROM (SELECT DISTINCT lower(series_label) AS low FROM v)) SELECT series_label, volume, CAST(series_index AS INT) AS series_index, CAST(row_number() OVER (PARTITION BY series_label ORDER BY k) AS INT) AS series_volume_number, count(*) OVER (PARTITION BY series_label) AS series_volume_count FROM v JOIN s ON low = lower(series_label)",
        "chosen_volumes": f"WITH {BLOCKS}, {VOLUMES} SELECT series_label, volume FROM v QUALIFY row_number() OVER (PARTITION BY series_label ORDER BY k) <= 2",
        "best_candidates": "SELECT doc_id, lower(regexp_extract(text, '^[A-Za-z]+')) AS word, CAST(len(text) AS INT) AS score FROM documents QUALIFY row_number() OVER (PARTITION BY lower(regexp_extract(text, '^[A-Za-z]+')) ORDER BY len(text) DESC, doc_id) = 1",
        "repeated_sources": f"""WITH {BLOCKS}, n AS (SELECT source, translation, count(*) AS n, min(seq) AS f FROM b WHERE source <> '' GROUP BY ALL), r AS (SELECT *, sum(n) OVER (PARTITION BY source) AS c, row_number() OVER (PARTITION BY source ORDER BY n DESC, f, translation) AS rn FROM n)
            SELECT source, CAST(any_value(c) AS BIGINT) AS count, string_agg(translation, '|' ORDER BY rn) FILTER (rn <= 5) AS translations FROM r WHERE c >= 2 GROUP BY source""",
        "suspicious_tokens": f"WITH {QUALITY}, t AS (SELECT {token} AS token, {HIGH} AS high FROM qq) SELECT token, count(*) AS count, count(*) FILTER (high) AS high_risk_count FROM t WHERE {weird} GROUP BY token",
        "name_candidates": f"WITH {BLOCKS}, t AS (SELECT unnest(regexp_extract_all(source, {q(names)}, 1)) AS token FROM b) SELECT token, count(*) AS count FROM t WHERE token NOT IN {among(P.NAME_STOP)} AND lower(token) NOT IN {among(P.ENGLISH_COMMON)} GROUP BY token",
        "residue_tokens": f"""WITH {TURNS}, s AS (SELECT coalesce(nullif(fixed, ''), ocr_text) AS source, translation_fr AS translation FROM tb), t AS (SELECT unnest(list_intersect({words4.format('source')}, {words4.format('translation')})) AS token FROM s) SELECT token, count(*) AS count FROM t WHERE token NOT IN {among(P.FRENCH_STOP)} GROUP BY token""",
        "token_risk_weights": f"WITH {QUALITY}, t AS (SELECT lower(token) AS token, high FROM (SELECT {token} AS token, {HIGH} AS high FROM qq)) SELECT token, count(*) AS count, count(*) FILTER (high) AS high_risk_count, round((count(*) FILTER (high) + 1) / (count(*) + 2), 4) AS risk_weight FROM t GROUP BY token HAVING count(*) >= 2 AND (count(*) FILTER (high) + 1) / (count(*) + 2) >= 0.55",
        "glossary_candidates": f"WITH {BLOCKS}, t AS (SELECT seq, unnest(regexp_extract_all(source, {q(TERM)})) AS term FROM b WHERE {LEARN}) SELECT term, count(*) AS count FROM t WHERE len(term) >= 3 AND upper(term) <> term GROUP BY term ORDER BY count(*) DESC, min(seq), term LIMIT 100",
        "translation_counts": f"WITH {BLOCKS} SELECT source_lang, source, translation AS translation_fr, count(*) AS count FROM b WHERE {LEARN} AND source <> '' GROUP BY source_lang, source, translation ORDER BY count(*) DESC, lower(source), min(seq) LIMIT 100",
        "correction_counts": f"WITH {BLOCKS}, c AS (SELECT regexp_replace(ocr_text, {TRIM}) AS ocr_raw, regexp_replace(ocr_corrected_text, {TRIM}) AS ocr_corrected, seq FROM b WHERE {LEARN}) SELECT ocr_raw, ocr_corrected, count(*) AS count FROM c WHERE ocr_raw <> '' AND ocr_corrected <> '' AND ocr_raw <> ocr_corrected GROUP BY ocr_raw, ocr_corrected ORDER BY count(*) DESC, lower(ocr_raw), min(seq) LIMIT 100",
        "riskiest_blocks": f"WITH {QUALITY} SELECT {K}, risk_score FROM qq WHERE risk_score >= 55 AND {ACTIVE} ORDER BY risk_score DESC, seq LIMIT 100",
        "learning_summary": f"WITH {QUALITY} SELECT count(DISTINCT (project_id, page_index)) AS pages, count(*) AS blocks, count(*) FILTER ({LEARN} AND source <> '') AS learnable_blocks, count(*) FILTER (manual_status = 'validated') AS validated_blocks, count(*) FILTER (risk_score >= 55 AND {ACTIVE}) AS high_risk_blocks FROM qq",
        "profile_summary": f"WITH {QUALITY} SELECT count(*) AS rows, count(*) FILTER ({HIGH}) AS high, count(*) FILTER (risk_score >= 25 AND risk_score < 55) AS medium, count(*) FILTER (risk_score < 25) AS ok, count(DISTINCT series_label) AS series FROM qq",
        "quality_report": f"""WITH {QUALITY}, act AS (SELECT * FROM qq WHERE {ACTIVE}), w AS (SELECT unnest(string_split(reasons, ' | ')) AS name FROM act WHERE reasons <> '')
            SELECT 'band' AS section, suggested_action AS name, count(*) AS value FROM act GROUP BY ALL
            UNION ALL (SELECT 'reason', name, count(*) FROM w GROUP BY ALL ORDER BY count(*) DESC, name LIMIT 20)
            UNION ALL (SELECT 'series', series_label, count(*) FROM qq GROUP BY ALL ORDER BY count(*) DESC, series_label LIMIT 30)""",
        "majority_memory": f"WITH {VOTES}, {MAJORITY.format('v')}",
        "memory_conflicts": f"WITH {VOTES}, n AS (SELECT key, value, count(*) AS votes FROM v GROUP BY ALL) SELECT key, value, votes FROM n QUALIFY count(*) OVER (PARTITION BY key) > 1",
        "ignore_memory": f"""WITH {BLOCKS}, s AS (SELECT seq, CASE WHEN contains(lower(review_notes), 'sfx') THEN 'ignore appris: sfx/bruit' WHEN contains(lower(review_notes), 'fusion') THEN 'ignore appris: fusion/non-dialogue' ELSE 'ignore appris' END AS value, unnest([ocr_text, ocr_corrected_text]) AS s FROM b WHERE manual_status = 'ignored'),
            v AS (SELECT DISTINCT {ignore_key('s')} AS key, value, seq FROM s WHERE regexp_replace(s, {TRIM}) <> '' AND len({ignore_key('s')}) >= 2), {MAJORITY.format('v')}""",
        "memory_lookup_exact": f"WITH {BENCH}, {LINES} SELECT doc_id, CAST(line AS INT) AS line, found FROM ln JOIN bm ON bm.key = {memory_key('ln.text')}",
        "glossary_union": """WITH w AS (SELECT lower(regexp_extract(text, '^[A-Za-z]+')) AS source, min(doc_id) AS pos FROM documents WHERE regexp_extract(text, '^[A-Za-z]+') <> '' GROUP BY 1)
            SELECT CASE WHEN pos % 3 = 0 THEN upper(source) ELSE source END AS source, CASE WHEN pos % 3 = 0 THEN 'x' ELSE source END AS target, 0 AS first_list, pos FROM w""",
        "iou_best_match": f"WITH {_iou()}",
        "corpus_totals": f"WITH {BLOCKS}, p AS (SELECT project_id, page_index, count(*) AS n, count(*) FILTER (nw > 0) AS w, count(*) FILTER (translation = '' AND manual_status <> 'ignored') AS u FROM b GROUP BY ALL) SELECT count(*) AS pages, count(*) AS processed, 0 AS skipped, CAST(sum(n) AS BIGINT) AS blocks, CAST(sum(w) AS BIGINT) AS blocks_with_warnings, CAST(sum(u) AS BIGINT) AS untranslated FROM p",
        "resumed_pages": f"WITH {BLOCKS} SELECT DISTINCT project_id, page_index FROM b WHERE page_index % 2 <> 0",
    }


def q_(name: str) -> str:
    return '"' + name + '"'


