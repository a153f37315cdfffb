"""DuckDB SQL of further queries. The lists here are its own copies, so that a word missing in the engine shows."""

from __future__ import annotations

from inkloom.plans.oracles import BLOCKS, MAJORITY, QUEUE, SENTENCES, TRIM, TURNS, K, _zones, among, ignore_key, memory_key, q

# Words of the checks, as SQL compares them.
QUOTE_MARKS = "\"'`´‘’“” "
FRENCH = "je tu il elle nous vous ils elles le la les un une des de du ce cette ca est suis sont etre avoir pas que qui quoi ou pourquoi comment avec sans dans sur plus moins tres faire faut voila mais donc alors comme pour"
ENGLISH = "i you we they he she it what why how where when who the a an to of and or is are was were be been have has had do does did not can will would should could wanna gonna gotta"
LABELS = "whisper|sob|shock|jaka|sfx|bam|bang|boom|thud|clap|rustle|slam|tap|tch|ugh|huh|hey|yeah|jolt|gasp|slap|wobble|yawn|sposh|flash|tremble|fidget|twitch|fwooo|woosh|crash|nod|scribble"
CONTRACTIONS = (
    (r"\bgonna\b", "going to"), (r"\bwanna\b", "want to"), (r"\bwould['’]?ve\b", "would have"), (r"\bcould['’]?ve\b", "could have"), (r"\bshould['’]?ve\b", "should have"),
    (r"\bi['’]?m\b", "I am"), (r"\bi['’]?d\b", "I would"), (r"\bi['’]?ll\b", "I will"), (r"\bi['’]?ve\b", "I have"),
)
# End of the fixed values.

VIEWS = {
    "À traiter": "decision IN ('unchecked', 'review', 'fused', 'zone')",
    "Risques HIGH/MED": "band IN ('HIGH', 'MED') AND decision NOT IN ('validate', 'ignore', 'sfx')",
    "High": "band = 'HIGH' AND decision NOT IN ('validate', 'ignore', 'sfx')",
    "Tous": "true",
    "Alternatives OCR": "contains(array_to_string(warnings, ' '), 'alternative')",
    **{v: f"decision = '{d}'" for v, d in (("Corrections faites", "correct"), ("À revoir", "review"), ("Fusion", "fused"), ("Zones", "zone"), ("Validés", "validate"), ("Ignorés", "ignore"), ("SFX", "sfx"))},
}
LIBRARY = f"""WITH {BLOCKS}, lib AS (SELECT '/lib/' || CASE WHEN seq % 3 = 0 THEN translate(series_label, 'abcdefghijklmnopqrstuvwxyz', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ') ELSE series_label END
    || '/v' || (seq % 3) || '.cbz' AS volume_path, page_index FROM b)"""


def hits(key: str, words: str) -> str:
    return rf"len([w for w in regexp_split_to_array({key}, '[^\p{{L}}\p{{N}}_]+') if w IN {among(words.split())}])"


def known(t: str, fr: str) -> str:
    """The source is French, or says what the translation says."""
    key = memory_key(t)
    return f"({key} <> '' AND (({fr} <> '' AND {key} = {memory_key(fr)}) OR ({hits(key, FRENCH)} >= 2 AND {hits(key, ENGLISH)} = 0)))"


def lost(mark: str) -> str:
    return f"(contains(raw, '{mark}') AND NOT contains(value, '{mark}'))"


CORRECTIONS = f"""WITH {BLOCKS}, x AS (SELECT seq, regexp_replace(ocr_text, {TRIM}) AS raw, regexp_replace(ocr_corrected_text, {TRIM}) AS value, regexp_replace(coalesce(nullif(translation_fr, ''), raw_translation_fr), {TRIM}) AS fr
    FROM b WHERE manual_status IN ('edited', 'validated')),
v AS (SELECT {ignore_key('raw')} AS key, value, seq FROM x WHERE raw <> '' AND value <> '' AND raw <> value AND NOT {known('value', 'fr')} AND NOT ({lost('?')} OR {lost('!')} OR {lost('...')}) AND len({ignore_key('raw')}) >= 3)"""


def contracted(c: str) -> str:
    for pattern, to in CONTRACTIONS:
        c = f"regexp_replace({c}, {q(pattern)}, {q(to)}, 'gi')"
    return c


TRANSLATIONS = f"""WITH {BLOCKS}, x AS (SELECT seq, regexp_replace(coalesce(nullif(translation_fr, ''), raw_translation_fr), {TRIM}) AS fr,
    unnest(list_distinct([regexp_replace(ocr_text, {TRIM}), regexp_replace(ocr_corrected_text, {TRIM}), source])) AS s FROM b WHERE manual_status IN ('edited', 'validated')),
y AS (SELECT *, {contracted('s')} AS plain FROM x WHERE s <> '' AND fr <> ''),
z AS (SELECT seq, fr, unnest([{memory_key('s')}, {memory_key('plain')}]) AS key FROM y WHERE NOT {known('s', 'fr')}),
v AS (SELECT DISTINCT key, fr AS value, seq FROM z WHERE len(key) >= 2)"""

SAMPLED = f"""WITH {BLOCKS}, p0 AS (SELECT DISTINCT series_label AS v, page_index AS p FROM b),
p1 AS (SELECT *, count(*) OVER (PARTITION BY v) AS n, row_number() OVER (PARTITION BY v ORDER BY p) - 1 AS pos FROM p0),
p2 AS (SELECT *, count(*) FILTER (pos >= 2 AND pos < n - 1) OVER (PARTITION BY v) AS kept FROM p1),
p3 AS (SELECT v, p, CAST('0x' || substr(md5('47|' || v || '|' || p), 1, 8) AS BIGINT) AS h, count(*) OVER (PARTITION BY v) AS n, row_number() OVER (PARTITION BY v ORDER BY p) - 1 AS pos FROM p2 WHERE (pos >= 2 AND pos < n - 1) OR kept = 0),
p4 AS (SELECT *, (2 * pos + 1) * least(8, n) // (2 * n) - CASE WHEN (2 * pos + 1) * least(8, n) % (2 * n) = 0 AND pos % 2 = 1 THEN 1 ELSE 0 END AS bucket FROM p3),
p5 AS (SELECT *, count(*) OVER (PARTITION BY v, bucket) AS size, min(h) OVER (PARTITION BY v, bucket) % 3 - 1 AS jitter, row_number() OVER (PARTITION BY v, bucket ORDER BY pos) - 1 AS place FROM p4),
p6 AS (SELECT *, place = greatest(0, least(size - 1, size // 2 + jitter)) AS pick FROM p5)
SELECT v AS volume_label, p AS page_index FROM p6 QUALIFY row_number() OVER (PARTITION BY v ORDER BY pick DESC, h, p) <= 10"""

LOUD, LATIN = "len(regexp_extract_all(c, '[A-ZÀ-ÖØ-Þ]'))", "len(regexp_extract_all(c, '[A-Za-zÀ-ÖØ-öø-ÿ]'))"
SINGLE_I = r"'(^|[^\p{L}\p{N}])i($|[^\p{L}\p{N}])', '\1I\2', 'g'"
SOFT = rf"""WITH {BLOCKS}, y AS (SELECT *, regexp_replace(trim(regexp_replace(trim(regexp_replace(translation_fr, {TRIM}), {q(QUOTE_MARKS)}), '\s+', ' ', 'g')), '\s+([,.;:!?])', '\1', 'g') AS c FROM b)
SELECT {K}, CASE WHEN NOT regexp_matches(c, '[ぁ-んァ-ン一-龯々ー]') AND {LATIN} >= 4 AND {LOUD} / {LATIN} >= 0.75 THEN regexp_replace(regexp_replace(lower(c), {SINGLE_I}), {SINGLE_I}) ELSE c END AS soft FROM y"""


def html(c: str) -> str:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = f"replace({c}, {q(a)}, {q(b)})"
    return c


def shown(label: str, c: str) -> str:
    return f"CASE WHEN {c} <> '' AND {c} <> source THEN '<p class=''{label}''>' || {html(c)} || '</p>' ELSE '' END"


META = "block_id || ' · ' || manual_status || CASE WHEN confidence IS NULL THEN '' ELSE ' · ' || printf('%.2f', confidence) END"
FINAL = "coalesce(nullif(trim(coalesce(nullif(translation_fr, ''), raw_translation_fr)), ''), '[non traduit]')"
HTML = f"""WITH {BLOCKS}, i AS (SELECT *, '<li><p class=''meta''>' || {html(META)} || '</p><p>' || {html('source')} || '</p><p>' || {html(FINAL)} || '</p>' || {shown('raw', 'ocr_text')} || {shown('corrected', 'ocr_corrected_text')} || {shown('notes', 'review_notes')}
    || CASE WHEN nw > 0 THEN '<ul>' || array_to_string(['<li class=''warning''>' || w || '</li>' for w in warnings], '') || '</ul>' ELSE '' END || '</li>' AS item FROM b),
g AS (SELECT project_id, page_index, arg_min(coalesce(image_name, ''), seq) AS image, string_agg(item, '' ORDER BY reading_order, seq) AS body FROM i GROUP BY ALL)
SELECT project_id, page_index, '<section data-status="new"><img src="' || {html('image')} || '"><ol>' || body || '</ol></section>' AS html FROM g"""

NOISE = rf"""WITH {SENTENCES}, f AS (SELECT page_index, CAST(split_part(block_id, '_', 3) AS INT) AS raw_order, v, 1.0 - (CAST(split_part(block_id, '_', 3) AS INT) % 100) / 100 AS conf, len(regexp_extract_all(v, '[A-Za-zÀ-ÖØ-öø-ÿぁ-んァ-ン一-龯々]')) AS letters FROM sv)
SELECT page_index, raw_order FROM f WHERE v = '' OR conf < 0.20 OR len(v) <= 1 OR regexp_matches(v, '^[0-9\s<>{{}}\[\]().,;:!?/\\|_+*=~`''"-]+$') OR letters = 0 OR (conf < 0.55 AND letters <= 2)"""


# Words, patterns and messages of the translation checks.
RESIDUE = "ain't aint ah ya yer y'all doin doing climbin climbing looky look gramma grandma told toid what where there here now dangerous contrail boy only being good orphanage food shelter steal tiger agency skills bomb button press battle fault cry days boss company dorm".split()
SLANG = "ain't aint ah ya yer y'all doin goin comin climbin looky gramma grampa gonna wanna gotta lemme gimme outta kinda sorta cuz cos 'tis tis donezo".split()
ALONE = "did do does with from that the or and but right gotta basically then".split()
PREFIX = "have left saved where but and then with maybe after right only".split()
SUFFIX = "on give goes gotta hey and about guys basically then".split()
COPIES = "naru miwa atsushi dazai kanade fujimura usami rashomon gozen kariu vayne provost ichinose public transit".split()
UPPERCASE = "OK NON SFX RASHOMON DAZAI TANIZAKI ATSUSHI NAOMI KUNIKIDA".split()
SIGNAL = "je|tu|il|elle|nous|vous|ils|elles|le|la|les|un|une|des|de|du|ce|cet|cette|ça|cela|est|suis|sont|être|avoir|pas|ne|que|quoi|qui|où|pourquoi|comment|dans|sur|avec|sans|regarde|grand|grand-mère|mère|père|monsieur|madame|maintenant|là-haut|dangereux|danger"
LEFTOVER = "orphanage|food|shelter|steal|tiger|agency|skills?|earn|master|animal|form|staff|backup|sake|bomb|dampen|explosion|button|press|boss|company|dorm|posthaste|lad|ideals|mafia|battle|fault|cry|days?|place|else|worldly|knowledge|individuals?|bandit|star|mercenary|guy|dollarman|fick|smug|slam|contents|beans?"
MISREAD = (
    ("to[i1l!]d", "OCR probable: 'toid/to1d' devrait être 'told'"),
    ("c[l1i!]imbin.*", "OCR probable sur 'climbin/climbing'"),
    ("narl[i1]?", "OCR probable sur un nom propre: vérifier Naru/Nari/etc."),
    ("enolgh", "OCR probable: 'enolgh' devrait être 'enough'"),
    ("folr", "OCR probable: 'FOLR' devrait être 'four'"),
    ("fopm", "OCR probable: 'Fopm' devrait être 'form'"),
    ("colld", "OCR probable: 'Colld' devrait être 'could'"),
    ("hlnger", "OCR probable: 'Hlnger' devrait être 'hunger'"),
    ("didnta|closb|boprow|pepson|loks|ahemi|secl|4nder|ou'd", "OCR probable: token appris du dernier batch à vérifier"),
    ("big-twme|fltile|full3|shiti|folind|sholld|withoraw|fortlne|communiies|mlch|y0u|ldoes|wrone|hlnt|g0t|momey|calght|rlnaway|bandis|thepe", "OCR probable: token appris des corrections récentes à vérifier"),
    (r"(?:could|should|would)\s+ve", "contraction anglaise probable: lire could've/should've/would've"),
    ("im|ive|ill|id", "contraction avec I probable: vérifier I'm/I've/I'll/I'd"),
    ("tslrlmi|napehouse|nestern|individlals", "OCR probable: token inconnu/rompu à vérifier"),
    (r"bmusthvb\s+gallenl\s+asle+p\s+inifront\s+computers?", "OCR évident: devrait être \"I must've fallen asleep in front of my computer\""),
    ("rlpted|lnneces|hideolt|yol|iwas|idont|iguess|wolld|bizarpe|wopld|iaeely|lessil|evepy|theip|dsich|aohto|dollarman|thess|bmusthvb|gallenl|aslep|inifront|t0", "OCR probable: token appris du corpus à vérifier"),
    (r"lrabe|colincil|colncil|wolld|becalse|o4t|youl|seriolsly|unapmed|supve|tkinbs|doine|kin[o0]a|dancepols|unneces+aqy|jols|s4y|men[.]{3}\s*tioned|st[ul][.]{3}\s*dent|exx?[.]{3}\s*istence|al[.]{3}\s*read|what\s+9i", "profil fonte manga: confusion U/L/I/!/1 probable"),
)
START = "have|left|saved|only|where|but|and|then|with|without|after|before|right|maybe|because|until|unless|when|while"
END = "and|but|or|if|that|this|the|a|an|to|of|for|from|with|without|before|after|because|about|into|onto|on|in|at|as|than|then|while|when|where|who|what|why|how|gotta|gonna|wanna|lemme|should|could|would|can|cannot|can't|will|still|just|is|isn't|isnt|aren't|arent|don't|dont|doesn't|doesnt|are|am|was|were|be|been|being|do|does|did|has|have|had|catches|counting|change|sources|place|understanding|mis|doi"
SHORT = "and this is what|only found|wait a sec|where will it end|now i gotta|but our solrces say that|but our sources say that|i'm counting on|i am counting on"
MIX = "whisper|sob|shock|jaka|sfx|bam|bang|boom|thud|clap|rustle|slam|tap|tch|jolt|gasp|slap|wobble|yawn|fidget|twitch|fwooo|woosh|crash|nod|scribble|krehble|krembue|shivr|fwoop|brip|whooosh"
# End of the fixed values.


def word(t: str, words: str) -> str:
    return f"regexp_matches({t}, {q(rf'(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{words})(?:$|[^\p{{L}}\p{{N}}_])')})"


def test(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {q(pattern)})"


def tokens(t: str) -> str:
    return f"[trim(lower(w), '''') for w in regexp_extract_all({t}, '[A-Za-z'']+')]"


def some(words: str, listed: list[str]) -> str:
    return f"list_sort(list_distinct([w for w in {words} if w IN {among(listed)}]))"


def checks() -> list[tuple[str, str]]:
    """(condition, message as SQL) of an English block with a text and a translation, in order."""
    n, open_ = "len(sw)", test("s", r"[.!?][\"')\]]*\s*$")
    start, end = test("s", rf"(?i)^\s*(?:\.\.\.)?\s*(?:{START})(?:$|[^\p{{L}}\p{{N}}_])"), test("s", rf"(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{END})\s*$")
    dots, stop, short, mixed = test("s", r"^(?:\.\.\.|\. )"), test("s", "[,:;]$"), word("s", SHORT), f"({word('s', MIX)} AND {n} >= 4)"
    breaks = test("s", r"[.!?][\"')\]]?\s+[A-Z\"']")
    closed = test("s", r"[.!?][\"')\]]?$")
    question = r"(?i)^\s*(?:what|why|how|where|when|who|is|are|do|did|does|can|could|would|should|will)(?:$|[^\p{L}\p{N}_])"
    first = lambda words: f"array_to_string({words}[1:4], ', ')"
    m = q
    return [
        (f"{n} >= 2 AND ({short} OR {stop} OR ({n} >= 3 AND NOT {open_} AND {end}))", m("zone trop petite probable: texte coupe dans la bulle")),
        (f"{n} >= 2 AND ({dots} OR ({start} AND NOT {open_}))", m("bulle probablement separee en plusieurs zones")),
        (f"{n} >= 2 AND ({short} OR ({stop} AND {n} >= 3) OR {dots} OR (NOT {open_} AND ({start} OR {end} OR ({n} >= 5 AND {word('s', 'before|after|because|that|if|when')}))))", m("zone/bulle probablement incomplete: relire avec crop elargi/fallback")),
        (mixed, m("SFX probablement melange avec une bulle de dialogue")),
        (f"{n} >= 3 AND ({mixed} OR {test('s', r'(?i)(?:^|[^\p{L}\p{N}_])all\s+righty!\s+then\?\s+we(?:\'re| are)\s+off\.?$')} OR ({n} >= 14 AND {breaks}))", m("fusion probable: bulle, SFX ou plusieurs bulles dans la meme bbox")),
        (f"{n} = 1 AND sw[1] IN {among(ALONE)}", m("fragment OCR isolé probable: vérifier/fusionner avec une bulle voisine")),
        (f"{n} <= 2 AND ends_with(s, ':')", m("fragment OCR terminé par ':' probable: vérifier/fusionner")),
        (f"contains(raw, ':') AND NOT {test('raw', r'(?i)(?:^|[^\p{L}\p{N}_])(?:chapter|vol|volume|no|number|page)\s*:')}", m("ponctuation ':' suspecte: souvent '.', '...', '!' ou '?' en fonte manga")),
        (f"{test('s', question)} AND NOT contains(s, '?')", m("point d'interrogation probablement manquant: relire la ponctuation de la bulle")),
        (f"sw[1] IN {among(PREFIX)} AND NOT {closed}", m("début de phrase possiblement manquant: en manga vérifier aussi la bulle à droite")),
        (f"sw[-1] IN {among(SUFFIX)}", m("fin de bulle possiblement manquante: vérifier la suite du texte")),
        (f"{n} <= 5 AND {word('s', 'and this is what|only found|wait a sec|basically|then|god|where will it end')}", m("zone de texte probablement trop courte: OCR à relire avec crop élargi/fallback")),
        (f"{n} >= 4 AND {test('s', r'[A-Za-z0-9\"\')]$')}", m("ponctuation finale possiblement manquante")),
        (f"{n} >= 3 AND {test('raw', r'[:,]\s*$')}", m("fin en ':' ou ',' suspecte: probablement ellipse ou ponctuation forte")),
        ("starts_with(s, '...')", m("fragment commençant par ellipse: probablement suite d'une bulle précédente")),
        (test("s", r"\.\.$|\.\.(?:[^.]|$)"), m("points de suspension incomplets: normaliser en '...' ou '...?'")),
        (test("raw", "[=()%@#]"), m("symboles OCR suspects dans le texte: relire la bulle complète")),
        (f"{word('raw', 'krehble|krembue|shivr|jmile|fwoop|brip|whooosh|sfx')} AND {n} >= 3", m("SFX probablement fusionné avec une bulle: séparer/ignorer la zone sonore")),
        (test("s", "(?i)^right[?.]?$"), m("ambiguïté: 'right?' peut signifier 'n'est-ce pas ?' selon le contexte")),
        (word("s", "stats|slime|handy|clear my name|come up with|don't be silly|no way|here you go"), m("expression anglaise/contextuelle: vérifier le rendu naturel en français")),
        (f"{n} >= 14 AND {breaks}", m("bloc long avec plusieurs phrases: vérifier si deux bulles ont été fusionnées")),
        *((word("raw", p), m(t)) for p, t in MISREAD),
        (word("fr", r"TOLD\s+YA|I\s+TOLD|WHAT\s+YA|NO\s+CLIMB|LOOKY|GRAMMA|TOID"), m("résidu anglais évident dans la traduction")),
        (f"{word('raw', 'gramma|grandma')} AND NOT {test('raw', r'(?i)\blook')} AND NOT {test('fr', r'(?i)\bregarde')}", m("OCR probablement incomplet: bulle 'grandma/look' à vérifier")),
        ("len(residue) > 0", f"'mots anglais restants: ' || {first('residue')}"),
        (word("fr", LEFTOVER), m("résidu anglais probable dans la traduction")),
        ("len(copied) > 0", f"'termes source recopiés dans la traduction: ' || {first('copied')}"),
        (test("raw", "[A-Za-z]+[0-9]+|[0-9]+[A-Za-z]+|[$]"), m("confusion OCR chiffre/symbole probable")),
        ("len(regexp_replace(lower(raw), '[^a-z0-9]', '', 'g')) >= 8 AND regexp_replace(lower(raw), '[^a-z0-9]', '', 'g') = regexp_replace(lower(fr), '[^a-z0-9]', '', 'g')", m("traduction identique à l'OCR")),
        (f"len([w for w in regexp_extract_all(fr, '[A-Za-z'']+') if len(w) >= 3 AND upper(w) = w AND upper(w) NOT IN {among(UPPERCASE)}]) > 0", m("fragments MAJUSCULES suspects")),
        (test("raw", r"(?:^|[^\p{L}\p{N}_])[A-Za-z]{2,}-\s+[A-Za-z]{2,}(?:$|[^\p{L}\p{N}_])"), m("césure OCR probable à corriger")),
        (test("raw", r"(?i)\b[a-z]{2,}-\s*(?:what|who|where|why|huh)\b"), m("mot volontairement coupé: conserver la coupure si elle porte le sens")),
        (f"len(fr) >= 8 AND NOT {test('fr', rf'(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:{SIGNAL})')} AND {test('fr', '[A-Za-z]')} AND len(rw) >= 3", m("peu d'indices de français naturel")),
        (f"{word('fr', 'gamma')} AND {word('raw', 'gramma')}", m("'gramma' probablement mal rendu: grand-mère")),
    ]


def qc_warnings(turns: str) -> str:
    squeeze = lambda c: rf"trim(regexp_replace({c}, '\s+', ' ', 'g'))"
    latin = lambda t: f"[trim(lower(w), '''') for w in regexp_extract_all({t}, '[A-Za-zÀ-ÖØ-öø-ÿ'']+')]"
    long = lambda t: f"[trim(lower(w), '''') for w in regexp_extract_all({t}, '[A-Za-z'']+') if len(w) >= 4]"
    rules = ",\n".join(f"CASE WHEN {c} THEN {m} END" for c, m in checks())
    return f"""WITH {turns},
c0 AS (SELECT block_id, {squeeze('ocr_text')} AS raw, {squeeze("coalesce(fixed, '')")} AS fixed, {squeeze('translation_fr')} AS fr FROM tb),
c1 AS (SELECT *, coalesce(nullif(fixed, ''), raw) AS s FROM c0),
c2 AS (SELECT *, {tokens('s')} AS sw, {tokens('raw')} AS rw, {some(tokens('fr'), RESIDUE)} AS residue, {some(f"list_concat({latin('raw')}, {latin('fixed')})", SLANG)} AS slang,
  list_sort([w for w in list_distinct(list_intersect({long('raw')}, {long('fr')})) if w <> '' AND w NOT IN {among(COPIES)}]) AS copied FROM c1),
c3 AS (SELECT block_id, slang, CASE WHEN raw = '' THEN ['OCR vide'] WHEN fr = '' THEN ['traduction vide'] ELSE [w for w in [{rules}] if w IS NOT NULL] END AS own, raw <> '' AND fr <> '' AS whole FROM c2),
c4 AS (SELECT block_id, CASE WHEN whole AND len(slang) > 0 AND len(own) > 0 THEN list_append(own, 'anglais familier impliqué: ' || array_to_string(slang[1:4], ', ')) ELSE own END AS ws FROM c3)
SELECT block_id, CAST(generate_subscripts(ws, 1) - 1 AS INT) AS pos, unnest(ws) AS warning FROM c4"""


# Misread tokens of readings.
BAD = "inhook lnhook lhook toid to1d lookv loooky l00k l0ok repect respecl enolgh folr fopm colld hlnger individlals napehouse nestern tslrlmi houps ramn rarn setupi morningb howdid tholsand entipe etire sevenn".split()
# End of the fixed values.


def suspect_readings(turns: str) -> str:
    rules = [c for c, _ in checks()]
    words = "regexp_extract_all(s, '[A-Za-zÀ-ÖØ-öø-ÿぁ-んァ-ン一-龯々ー'']+')"
    return rf"""WITH {turns}, c0 AS (SELECT {K}, trim(regexp_replace(ocr_text, '\s+', ' ', 'g')) AS s FROM tb WHERE page_index % 4 NOT IN (0, 2)), c1 AS (SELECT *, {tokens('s')} AS sw FROM c0)
SELECT {K} FROM c1 WHERE s = '' OR len([w for w in {words} if trim(lower(w), '''') IN {among(BAD)}]) > 0 OR (contains(s, ';') AND len({words}) <= 4) OR ({rules[2]}) OR ({rules[4]})"""


HYPHENS = r"""
WITH c AS (SELECT CASE WHEN doc_id % 7 = 0 THEN regexp_replace(text, '([A-Za-z]{4})([A-Za-z]{4,})', '\1- \2', 'g') ELSE text END AS t0 FROM documents),
    x AS (SELECT lower(coalesce(t0, '')) AS t, row_number() OVER () AS r FROM c),
    runs AS (SELECT r, unnest(regexp_extract_all(t, '[a-z]{2,}(?:-\s+[a-z]{2,})+')) AS run FROM x),
    halves AS (SELECT regexp_split_to_array(run, '-\s+') AS h FROM runs),
    cut AS (SELECT unnest([{'l': h[i], 'r': h[i + 1]} for i in range(1, len(h))]) AS p FROM halves),
    pairs AS (SELECT p.l AS l, p.r AS r, count(*) AS n FROM cut GROUP BY 1, 2),
    w AS (SELECT r, unnest(regexp_extract_all(regexp_replace(t, '[a-z]{2,}(?:-\s+[a-z]{2,})+', ' ', 'g'), '[a-z]+(?:-[a-z]+)*')) AS w FROM x),
    f AS (SELECT r, w AS form FROM w UNION SELECT r, unnest(string_split(w, '-')) FROM w),
    d AS (SELECT form, count(*) AS docs FROM f GROUP BY 1),
    j AS (SELECT pairs.*, coalesce(a.docs, 0) AS joined_docs, coalesce(b.docs, 0) AS compound_docs, least(coalesce(p.docs, 0), coalesce(q.docs, 0)) AS parts_docs
        FROM pairs LEFT JOIN d a ON a.form = l || r LEFT JOIN d b ON b.form = l || '-' || r LEFT JOIN d p ON p.form = l LEFT JOIN d q ON q.form = r)
SELECT l AS "left", r AS "right", n, joined_docs, compound_docs, parts_docs,
    CASE WHEN r IN ('what', 'who', 'where', 'why', 'huh') THEN 'apart' WHEN compound_docs > joined_docs THEN 'compound' WHEN joined_docs = 0 AND compound_docs = 0 AND parts_docs > 0 THEN 'apart' ELSE 'join' END AS decision
FROM j"""


def oracle_sql() -> dict[str, str]:
    zones, _ = _zones()
    return {
        "queue_views": f"WITH {QUEUE} " + " UNION ALL ".join(f"SELECT block_id, {q(v)} AS view FROM qv WHERE {t}" for v, t in VIEWS.items()),
        "zone_fallbacks": f"WITH {SENTENCES} SELECT {K} FROM sv WHERE {zones} <> ''",
        "memory_round_trip": f"{CORRECTIONS}, {MAJORITY.format('v')}".replace("SELECT key, value, votes, n_values FROM m", "SELECT key, trim(value) AS value FROM m"),
        "ocr_memory": f"{CORRECTIONS}, {MAJORITY.format('v')}",
        "translation_memory": f"{TRANSLATIONS}, {MAJORITY.format('v')}",
        "duplicate_parents": f"{LIBRARY}, u AS (SELECT DISTINCT volume_path FROM lib) SELECT lower(regexp_replace(volume_path, '/[^/]*$', '')) AS parent, count(*) AS volumes, string_agg(volume_path, ',' ORDER BY volume_path) AS paths FROM u GROUP BY 1 HAVING count(*) > 1",
        "pages_of_volumes": f"{LIBRARY} SELECT volume_path, count(DISTINCT page_index) FILTER (page_index % 7 = 0) AS sampled_pages FROM lib GROUP BY 1",
        "sampled_pages": SAMPLED,
        "softened_capitals": SOFT,
        "sfx_labels": f"WITH {SENTENCES} SELECT {K} FROM sv WHERE regexp_matches(v, '(?i)^(?:{LABELS})[.!?:, -]*$')",
        "html_pages": HTML,
        "fragment_noise": NOISE,
        "qc_warnings": qc_warnings(TURNS),
        "suspect_readings": suspect_readings(TURNS),
        "hyphen_lexicon": HYPHENS,
    }
