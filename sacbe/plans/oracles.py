"""SQL for a second engine that gives the same rows as the queries of the registry."""

from sacbe.functions.text import ACCENTED, LIGATURES, PLAIN
from sacbe.functions.vocabulary import LABEL_WORDS, LEVEL_NAMES, LEXICON, STOP_ENGLISH, STOP_SPANISH, STOP_STUDY, SUBJECT_NAMES, SUBJECTS

W = "[a-záéíóúüñA-ZÁÉÍÓÚÜÑ]+"
L = "a-záéíóúüñA-ZÁÉÍÓÚÜÑ"
V = "aeoáéóAEOÁÉÓiuíúüIUÍÚÜ"
S = "aeoáéóAEOÁÉÓ"


def n(c: str, pattern: str, options: str = "") -> str:
    return f"len(regexp_extract_all({c}, '{pattern}'{', 0, ' + repr(options) if options else ''}))"


def quoted(words) -> str:
    return ", ".join(f"'{w}'" for w in words)


def fold(c: str) -> str:
    for a, b in {**LIGATURES, "…": "..."}.items():
        c = f"replace({c}, '{a}', '{b}')"
    return f"lower(translate({c}, '{ACCENTED}', '{PLAIN}'))"


def case(c: str, names: dict) -> str:
    return f"CASE {c} " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in names.items()) + " END"


def read(source: str, key: str, text: str) -> str:
    """CTEs that end in r: counts and score of each text."""
    return f"""
t AS (SELECT *, coalesce({text}, '') AS x FROM {source}),
c AS (SELECT *, {n('x', W)} AS palabras, {n('x', f'[{V}]+')} + {n('x', f'[{S}]')} - {n('x', f'[{S}]+')} + {n('x', W)} - {n('x', f'[{L}]*[{V}][{L}]*')} AS silabas, {n('x', '[.!?…]+')} AS o FROM t),
k AS (SELECT *, CASE WHEN palabras = 0 THEN 0 ELSE greatest(o, 1) END AS oraciones FROM c),
m AS (SELECT *, CASE WHEN palabras > 0 THEN silabas::DOUBLE / palabras ELSE 0 END AS silabas_por_palabra, CASE WHEN palabras > 0 THEN palabras::DOUBLE / oraciones ELSE 0 END AS palabras_por_oracion FROM k),
p AS (SELECT *, CASE WHEN palabras > 0 THEN 206.84::DOUBLE - 0.6::DOUBLE * (silabas_por_palabra * 100) - 1.02::DOUBLE * palabras_por_oracion ELSE 0 END AS puntuacion FROM m),
r AS (SELECT *, CASE WHEN palabras = 0 THEN 'basicos' WHEN puntuacion >= 83 THEN 'primaria_baja' WHEN puntuacion >= 60 THEN 'primaria_alta' ELSE 'basicos' END AS nivel FROM p)"""


DOCS = f"WITH {read('documents', 'doc_id', 'text')}"
PAGES = "b AS (SELECT DISTINCT libro, pagina, pos, texto, confianza FROM paginas WHERE libro IS NOT NULL AND pagina >= 1 AND (confianza IS NULL OR confianza BETWEEN 0 AND 1))"


def share(words) -> str:
    return f"len(list_filter(regexp_extract_all(lower(x), '[a-záéíóúüñ]+'), lambda w: w IN ({quoted(sorted(set(words)))})))"


def feature(columns: dict) -> str:
    return DOCS + " SELECT doc_id, " + ", ".join(f"round(CASE WHEN palabras > 0 THEN {v} ELSE 0 END, 9) AS {k}" for k, v in columns.items()) + " FROM r"


EX = "e AS (SELECT DISTINCT ON (ejemplo_id) * FROM ejemplos)"
GRADED = f"WITH {EX}, g AS (SELECT ejemplo_id, texto FROM e), {read('g', 'ejemplo_id', 'texto')}, j AS (SELECT r.ejemplo_id, r.nivel AS predicho, s.real FROM r JOIN (SELECT DISTINCT ejemplo_id, nivel AS real FROM metricas_legibilidad WHERE nivel IS NOT NULL) s USING (ejemplo_id)), f AS (SELECT real, predicho, count(*) AS n FROM j GROUP BY ALL)"
REPORT = """, h AS (SELECT real AS clase, sum(n) AS soporte, sum(CASE WHEN real = predicho THEN n ELSE 0 END) AS tp FROM f GROUP BY real),
d AS (SELECT predicho AS clase, sum(n) AS dichos FROM f GROUP BY predicho),
q AS (SELECT coalesce(h.clase, d.clase) AS clase, coalesce(soporte, 0) AS soporte, coalesce(tp, 0) AS tp, coalesce(dichos, 0) AS dichos FROM h FULL JOIN d ON h.clase = d.clase),
u AS (SELECT clase, soporte, CASE WHEN dichos > 0 THEN tp::DOUBLE / dichos ELSE 0 END AS p, CASE WHEN soporte > 0 THEN tp::DOUBLE / soporte ELSE 0 END AS r FROM q),
z AS (SELECT clase, soporte, p, r, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f1 FROM u)"""
STRATA = f"""WITH {EX}, h AS (SELECT ejemplo_id, materia, md5(ejemplo_id::VARCHAR || ':42') AS h FROM e),
u AS (SELECT min(n) < 2 AS sola FROM (SELECT count(*) AS n FROM h GROUP BY materia)),
v AS (SELECT h.*, CASE WHEN NOT sola THEN materia END AS estrato FROM h, u),
s AS (SELECT *, row_number() OVER (PARTITION BY estrato ORDER BY h, ejemplo_id) AS k, count(*) OVER (PARTITION BY estrato) AS n FROM v),
t AS (SELECT ejemplo_id, materia, CASE WHEN k <= ceil(n * 0.25::DOUBLE) THEN 'prueba' ELSE 'entrenamiento' END AS parte FROM s)"""
WORDS = r"""w0 AS (SELECT DISTINCT ON (reconocida_id) reconocida_id AS doc, numero AS pagina, texto FROM paginas_reconocidas),
w1 AS (SELECT doc, pagina, unnest(string_split(texto, chr(10))) AS linea, generate_subscripts(string_split(texto, chr(10)), 1) - 1 AS l FROM w0),
w2 AS (SELECT doc, pagina, l, unnest(string_split(linea, ' ')) AS text, generate_subscripts(string_split(linea, ' '), 1) - 1 AS w FROM w1),
w3 AS (SELECT doc, pagina, l, w, trim(text) AS text, l // 5 AS par, ((doc * 31 + l * 7 + w * 17) % 102 - 1)::DOUBLE AS conf FROM w2 WHERE trim(text) <> '')"""
# This engine counts bytes between texts: each letter of more than one byte becomes one unused byte, after sorting.
WIDE = "áéíóúüñ¿¡ÁÉÍÓÚÜÑ«»—…ﬁﬂ"
NARROW = " || ".join(f"chr({k})" for k in [*range(1, 9), *range(14, 28)][: len(WIDE)])


def one_byte(c: str) -> str:
    return f"translate({c}, '{WIDE}', {NARROW})"


def in_order(c: str) -> str:
    return f"array_to_string(list_sort(string_split({c}, ' ')), ' ')"


CER = rf"""p AS (SELECT *, trim(regexp_replace(coalesce(referencia, ''), '\s+', ' ', 'g')) AS a, trim(regexp_replace(coalesce(obtenido, ''), '\s+', ' ', 'g')) AS b FROM evaluacion_ocr),
c AS (SELECT *, length(a) AS caracteres, CASE WHEN length(a) > 0 THEN levenshtein({one_byte('a')}, {one_byte('b')}) END AS errores, CASE WHEN length(a) > 0 THEN levenshtein({one_byte(in_order('a'))}, {one_byte(in_order('b'))}) END AS errores_sin_orden FROM p)"""
EVENTS = """e AS (SELECT DISTINCT trabajo, pagina, evento, ts FROM eventos_ocr WHERE trabajo IS NOT NULL AND evento IS NOT NULL),
m AS (SELECT trabajo, count(DISTINCT pagina) AS total, min(ts) FILTER (evento = 'created') AS creado, min(ts) FILTER (evento = 'started') AS iniciado, min(ts) FILTER (evento = 'cancelled') AS cancelado, min(ts) FILTER (evento = 'page_failed') AS fallo FROM e GROUP BY trabajo),
p AS (SELECT trabajo, pagina, min(ts) AS hecha FROM e WHERE evento = 'page_done' AND pagina IS NOT NULL GROUP BY ALL),
l AS (SELECT trabajo, count(*) AS vistas, max(hecha) AS ultima FROM p GROUP BY trabajo),
f AS (SELECT m.*, least(cancelado, fallo, CASE WHEN vistas >= total THEN ultima END) AS terminado FROM m LEFT JOIN l USING (trabajo)),
q AS (SELECT p.trabajo, count(*) FILTER (f.terminado IS NULL OR p.hecha <= f.terminado) AS hechas, count(*) FILTER (p.hecha > f.terminado) AS tardias FROM p JOIN f USING (trabajo) GROUP BY ALL),
x AS (SELECT e.trabajo, 'pagina ' || min(pagina) AS fallida FROM e JOIN f USING (trabajo) WHERE evento = 'page_failed' AND e.ts = f.fallo GROUP BY e.trabajo),
s AS (SELECT f.trabajo, CASE WHEN fallo = terminado OR cancelado = terminado THEN 'error' WHEN terminado IS NOT NULL THEN 'listo' WHEN iniciado IS NOT NULL OR coalesce(hechas, 0) > 0 THEN 'procesando' ELSE 'pendiente' END AS estado, coalesce(hechas, 0) AS hechas, total, coalesce(tardias, 0) AS tardias, CASE WHEN fallo = terminado THEN fallida WHEN cancelado = terminado THEN 'cancelado' END AS error, terminado FROM f LEFT JOIN q USING (trabajo) LEFT JOIN x USING (trabajo))"""

# Sentences: marks are masked and replaced by separators, since this engine's patterns can't look around.
EDGE = r" \t\-–—•·"
CAP = r'[A-ZÁÉÍÓÚÑ¿¡«"(—\-–]'
LABELS = "Relaciono|Relacionamos|Investigo|Investigamos|Organizo|Organizamos|Taller|Nota de inter[eé]s|Actividades adicionales|Evaluaci[oó]n del? proyecto"
TITLE_WORD = r"""(len(regexp_replace(w, '\P{L}', '', 'g')) >= 2 AND len(regexp_replace(w, '[^\p{L}]|\p{Lu}', '', 'g')) <= CASE WHEN len(regexp_replace(w, '\P{L}', '', 'g')) >= 4 THEN 1 ELSE 0 END AND regexp_matches(regexp_replace(w, '\P{L}', '', 'g'), '^\p{Lu}')) OR w IN ('Y', 'DE', '—', '-', ':')"""


def pieces(source: str) -> str:
    """CTEs that end in pc: libro, pagina, pos, trozo, texto from pages in ``source``."""
    return rf"""
s0 AS (SELECT libro, pagina, pos, regexp_replace(coalesce(texto, ''), '(^|[^\p{{L}}\p{{N}}_])(?:{LABELS})(\s+[A-ZÁÉÍÓÚÑ¿¡\d])', '\1' || chr(10) || '\2', 'g') AS x FROM {source}),
s1 AS (SELECT libro, pagina, pos, regexp_replace(x, '(^|[^\p{{L}}\p{{N}}_])([ad])\.(\s+)', '\1\2' || chr(2) || '\3', 'g') AS x FROM s0),
s2 AS (SELECT libro, pagina, pos, regexp_replace(regexp_replace(x, '([.!?…])\s+({CAP})', '\1' || chr(1) || '\2', 'g'), '\n+', chr(1), 'g') AS x FROM s1),
s3 AS (SELECT libro, pagina, pos, string_split(replace(x, chr(2), '.'), chr(1)) AS a FROM s2),
s4 AS (SELECT libro, pagina, pos, unnest(a) AS t, generate_subscripts(a, 1) AS i FROM s3),
s5 AS (SELECT *, i > 1 AND regexp_matches(regexp_replace(t, '^\s+', ''), '^[\-–—]') AND regexp_matches(regexp_replace(t, '^[{EDGE}]+', ''), '^\p{{Ll}}') AS sigue FROM s4),
s6 AS (SELECT *, sum(CASE WHEN sigue THEN 0 ELSE 1 END) OVER (PARTITION BY libro, pagina, pos, confia ORDER BY i) AS g FROM (SELECT *, 0 AS confia FROM s5)),
s7 AS (SELECT libro, pagina, pos, g - 1 AS trozo, trim(regexp_replace(string_agg(t, ' ' ORDER BY i), '\s+', ' ', 'g')) AS x FROM s6 GROUP BY ALL),
s8 AS (SELECT libro, pagina, pos, trozo, regexp_replace(regexp_replace(x, '^[{EDGE}]+', ''), '[{EDGE}]+$', '') AS x FROM s7),
s9 AS (SELECT libro, pagina, pos, trozo, regexp_replace(x, '^(?:\d{{1,3}}\s+)+([A-ZÁÉÍÓÚÑ¿¡])', '\1') AS x FROM s8),
s10 AS (SELECT libro, pagina, pos, trozo, regexp_replace(x, '^(?:[IVXLC]{{1,8}}|(?i:cap[íi]tulo|unidad|lecci[óo]n|tema|bloque|secci[óo]n|parte)\s+\S+(?:\s*[-–:.]\s*(?i:p[áa]g(?:ina)?\.?)\s*\d+)?)\s*[-–:.]?\s+([A-ZÁÉÍÓÚÑ¿¡«"])', '\1') AS x FROM s9),
s11 AS (SELECT *, list_filter(string_split(x, ' '), lambda w: w <> '') AS ws FROM s10),
s12 AS (SELECT *, coalesce(list_position(list_transform(ws, lambda w: {TITLE_WORD}), false), len(ws) + 1) - 1 AS k0 FROM s11),
s13 AS (SELECT *, CASE WHEN k0 < 0 THEN len(ws) ELSE k0 END AS k FROM s12),
pc AS (SELECT libro, pagina, pos, trozo, CASE WHEN k >= 2 THEN array_to_string(ws[k+1:], ' ') ELSE x END AS texto FROM s13)"""


STUDY = "[a-záéíóúüñA-ZÁÉÍÓÚÜÑ][a-záéíóúüñA-ZÁÉÍÓÚÜÑ''-]*"
PARTS = r"list_filter(list_transform(list_filter(regexp_split_to_array(texto, '\s+'), lambda y: y <> ''), lambda y: regexp_replace(regexp_replace(y, '^[^\p{L}\p{N}_\p{M}]+', ''), '[^\p{L}\p{N}_\p{M}]+$', '')), lambda y: y <> '')"
FLAGS = rf"""fl AS (SELECT libro, pagina, pos, trozo, texto, {n('texto', STUDY)} AS palabras, {n('texto', chr(92) + 'p{Nd}')} AS cifras, {PARTS} AS partes FROM pc),
fg AS (SELECT *, len(list_filter(partes, lambda y: regexp_matches(y, '^\p{{L}}+(?:[-''’]\p{{L}}+)*$') AND CASE WHEN length(y) = 1 THEN lower(y) IN ('a', 'e', 'o', 'u', 'y') ELSE regexp_matches(y, '(?i)[aeiouáéíóúüy]') END)) AS buenas, len(list_filter(partes, lambda y: regexp_matches(y, '^\p{{Nd}}+(?:[.,]\p{{Nd}}+)*%?$'))) AS numeros FROM fl),
fh AS (SELECT *, len(partes) > 0 AND buenas + numeros >= 0.85::DOUBLE * len(partes) AND buenas >= 0.5::DOUBLE * len(partes) AS legible FROM fg)"""
KEPT = f"""us AS (SELECT libro, pagina, pos, trozo, texto, {fold('texto')} AS clave FROM fh WHERE palabras BETWEEN 6 AND 60 AND cifras <= palabras AND legible),
fi AS (SELECT *, row_number() OVER (PARTITION BY libro, clave ORDER BY pagina, pos, trozo, texto) AS k FROM us),
se AS (SELECT libro, (row_number() OVER (PARTITION BY libro ORDER BY pagina, pos, trozo) - 1)::INT AS orden, pagina, texto FROM fi WHERE k = 1)"""


def border(source: str, last: bool = False) -> str:
    """CTEs that end in fr: the repeated phrase of each book's first (or last) words."""
    p = "f" if last else "h"
    return rf"""
{p}1 AS (SELECT libro, {'list_reverse(' if last else ''}list_filter(regexp_split_to_array(coalesce(texto, ''), '\s+'), lambda x: x <> ''){')' if last else ''} AS w FROM {source}),
{p}2 AS (SELECT libro, w[1:least(32, floor(len(w) * 0.25::DOUBLE)::INT)] AS e FROM {p}1 WHERE len(w) >= 30),
{p}3 AS (SELECT libro, e, coalesce(list_position(list_transform(e, lambda x: regexp_matches(x, '^[.\-–—·]*\d+[.\-–—·]*$')), false), 0) AS a FROM {p}2),
{p}4 AS (SELECT libro, CASE WHEN a > 0 THEN e[a:] ELSE [] END AS r FROM {p}3),
{p}5 AS (SELECT libro, r, coalesce(list_position(list_transform(r, lambda x: regexp_matches(x, '^[.\-–—·]*\d+[.\-–—·]*$')), true), 0) AS z FROM {p}4),
{p}6 AS (SELECT libro, list_transform(CASE WHEN z > 0 THEN r[1:z-1] ELSE r END, lambda x: {fold('x')}) AS o FROM {p}5),
{p}7 AS (SELECT libro, count(*) AS paginas FROM {p}6 GROUP BY libro HAVING count(*) >= 3),
{p}8 AS (SELECT libro, o, unnest(range(3, least(len(o), 16) + 1)) AS largo FROM {p}6 WHERE len(o) >= 3),
{p}9 AS (SELECT libro, largo, array_to_string(o[1:largo], ' ') AS frase, count(*) AS veces FROM {p}8 GROUP BY ALL),
{p}10 AS (SELECT {p}9.* FROM {p}9 JOIN {p}7 USING (libro) WHERE veces >= greatest(3, ceil(paginas * 0.3::DOUBLE))),
{p}11 AS (SELECT *, max(veces) OVER (PARTITION BY libro) AS tope FROM {p}10),
{p}12 AS (SELECT *, row_number() OVER (PARTITION BY libro ORDER BY largo DESC, veces DESC, frase DESC) AS k FROM {p}11 WHERE veces >= tope * 0.9::DOUBLE),
{p}r AS (SELECT libro, frase, largo, veces FROM {p}12 WHERE k = 1)"""


def without(source: str, phrases: str, out: str, last: bool) -> str:
    """CTEs that end in ``out``: the pages of ``source`` without the phrase of their book."""
    order = "list_reverse(ww)" if last else "ww"
    cut = "'(?:\\s+\\S+){' || d || '}\\s*$'" if last else "'^\\s*(?:\\S+\\s+){' || d || '}'"
    return rf"""
{out}1 AS (SELECT x.*, string_split(p.frase, ' ') AS q, list_filter(regexp_split_to_array(coalesce(x.texto, ''), '\s+'), lambda y: y <> '') AS ww FROM {source} x LEFT JOIN {phrases} p USING (libro)),
{out}2 AS (SELECT *, {order} AS w FROM {out}1),
{out}3 AS (SELECT *, list_filter(range(1, len(w) + 1), lambda i: NOT regexp_matches(w[i], '^[.\-–—·]*\d+[.\-–—·]*$')) AS a FROM {out}2),
{out}4 AS (SELECT *, CASE WHEN q IS NULL OR len(a) < len(q) OR list_transform(a[1:len(q)], lambda i: {fold('w[i]')}) <> q THEN 0 WHEN len(a) > len(q) THEN a[len(q) + 1] - 1 ELSE len(w) END AS d FROM {out}3),
{out} AS (SELECT libro, pagina, pos, CASE WHEN d = 0 THEN texto WHEN d >= len(w) THEN '' ELSE regexp_replace(texto, {cut}, '') END AS texto, confianza FROM {out}4)"""




def sentences(pages: str, more: str = "") -> str:
    """CTEs that end in se: the sentences of the pages ``pages``, which ``more`` may define."""
    return f"WITH {PAGES}{more}, {border(pages)}, {without(pages, 'hr', 'n1', False)}, {border('n1', True)}, {without('n1', 'fr', 'n2', True)}, {pieces('n2')}, {FLAGS}, {KEPT}"


SENTENCES = sentences("b")

STOPS = quoted(sorted(set(STOP_STUDY)))
TOKENS = f"""g1 AS (SELECT libro, orden, regexp_extract_all(texto, '{STUDY}') AS w FROM se),
g2 AS (SELECT libro, orden, w, list_transform(w, lambda x: CASE WHEN length({fold('x')}) < 3 OR {fold('x')} IN ({STOPS}) THEN '' ELSE {fold('x')} END) AS t FROM g1),
g3 AS (SELECT libro, orden, w, t, unnest(range(1, len(t) + 1)) AS i FROM g2),
g4 AS (SELECT libro, orden, w, t, i, unnest([1, 2, 3]) AS n FROM g3),
gr AS (SELECT libro, orden, i - 1 AS i, array_to_string(t[i:i+n-1], ' ') AS clave, lower(array_to_string(w[i:i+n-1], ' ')) AS forma FROM g4 WHERE i + n - 1 <= len(t) AND NOT list_contains(t[i:i+n-1], ''))"""
RANK = f"""nc AS (SELECT libro, clave, count(*)::INT AS veces FROM gr GROUP BY ALL),
rk AS (SELECT libro, clave, veces, veces * (1 + 0.5::DOUBLE * (length(clave) - length(replace(clave, ' ', '')))) AS puntos FROM nc WHERE veces >= 2 AND clave NOT IN ({quoted(sorted(set(LABEL_WORDS)))})),
rn AS (SELECT *, (row_number() OVER (PARTITION BY libro ORDER BY puntos DESC, clave DESC))::INT AS puesto FROM rk),
rc AS (SELECT libro, puesto, clave, veces, puntos FROM rn WHERE puesto <= 180)"""
WEIGHTS = f"""x1 AS (SELECT libro, orden, unnest(list_filter(regexp_extract_all({fold('texto')}, '[a-z0-9_]+'), lambda y: regexp_full_match(y, '[a-z]{{3,}}') AND y NOT IN ({STOPS}))) AS termino FROM se),
x2 AS (SELECT libro, orden, termino, count(*) AS tf FROM x1 GROUP BY ALL),
x3 AS (SELECT libro, count(*) AS n FROM se GROUP BY libro),
x4 AS (SELECT libro, termino, count(*) AS df FROM x2 GROUP BY ALL),
x5 AS (SELECT x2.*, (1 + ln(tf)) * (ln((1 + n)::DOUBLE / (1 + df)) + 1) AS w FROM x2 JOIN x3 USING (libro) JOIN x4 USING (libro, termino)),
tw AS (SELECT libro, orden, termino, w / sqrt(sum(w * w) OVER (PARTITION BY libro, orden)) AS peso FROM x5)"""
# Separators are doubled so that neighbouring numbers don't share one.
DATES = r"""d1 AS (SELECT *, regexp_extract_all(texto, '(?i)(?:^|[^\p{L}\p{N}_])(\d{1,4})\s*a\.?\s*(?:de\s*)?C(?:$|[^\p{L}\p{N}_])', 1) AS bc, regexp_extract_all(' ' || regexp_replace(texto, '([^\d.,])', '\1\1', 'g') || ' ', '[^\d.,](1\d{3}|20\d{2})[^\d.,]', 1) AS an FROM se),
d2 AS (SELECT libro, orden, pagina, texto, list_concat(list_transform(bc, lambda x: {'valor': -(x::INT), 'fecha': x || ' a. C.'}), list_transform(an, lambda x: {'valor': x::INT, 'fecha': x})) AS f FROM d1),
d3 AS (SELECT *, len(list_distinct(list_transform(f, lambda x: x.valor))) AS k FROM d2),
ev AS (SELECT libro, orden, pagina, texto, list_sort(f)[1].valor AS valor, list_sort(f)[1].fecha AS fecha FROM d3 WHERE k BETWEEN 1 AND 2),
fe AS (SELECT libro, valor, fecha, texto, pagina FROM (SELECT *, row_number() OVER (PARTITION BY libro, valor ORDER BY orden) AS k1 FROM ev) WHERE k1 = 1)"""
CLEAN_LINE = r"trim(regexp_replace(y, '[ \t\x{00A0}\x{2000}-\x{200B}\x{202F}\x{3000}]+', ' ', 'g'))"
HY = "[-‐‑­¬]"
JOIN = rf"regexp_replace(regexp_replace(X, '(\p{{L}}){HY}[ \t]*\n[ \t]*(\p{{Lu}})', '\1-\2', 'g'), '(\p{{L}}){HY}[ \t]*\n[ \t]*(\p{{L}})', '\1\2', 'g')"
LIGATED = "replace(replace(replace(replace(replace(replace(replace(coalesce(texto, ''), 'ﬀ', 'ff'), 'ﬁ', 'fi'), 'ﬂ', 'fl'), 'ﬃ', 'ffi'), 'ﬄ', 'ffl'), 'ﬅ', 'st'), 'ﬆ', 'st')"
HEADING = r"(?im)^\s*(?:cap[íi]tulo|unidad|lecci[óo]n|tema|bloque|secci[óo]n)\s+(?:\d+|[ivxlcdm]+|uno|dos|tres|cuatro|cinco|seis|siete|ocho|nueve|diez)(?:$|[^\p{L}\p{N}_])"
PRED = rf"""(regexp_matches(texto, '^[—\-–¡¿"«]') OR regexp_matches(texto, '\s—\s?(?:dijo|preguntó|respondió|añadió|exclamó|contestó)(?:$|[^\p{{L}}\p{{N}}_])')) AS dialogo,
regexp_matches({fold('texto')}, '\b(?:yo|me|mi|mis|mio|mia|mios|mias|conmigo|soy|estoy|tu|tus|te|ti|contigo|eres)\b') AS persona,
(contains(texto, '•') OR contains(texto, '¿') OR regexp_matches(texto, '^[A-ZÁÉÍÓÚÑ][a-záéíóúñ]+(?:amos|emos|imos)(?:$|[^\p{{L}}\p{{N}}_])') OR regexp_matches(texto, '[\p{{L}}\p{{N}}_](?:aremos|eremos|iremos)(?:$|[^\p{{L}}\p{{N}}_])') OR regexp_matches(texto, '\(\s*[A-Z]{{1,3}}\s*\d+\s*\)|^Est[aá]ndar\s+\d|(?:^|[^\p{{L}}\p{{N}}_])[Ee]l maestro o (?:la )?maestra(?:$|[^\p{{L}}\p{{N}}_])') OR regexp_matches(texto, '(?i)(?:^|[^\p{{L}}\p{{N}}_])(?:palabras clave|materiales|instrucciones|procedimiento|hip[oó]tesis)\s*:') OR regexp_matches({fold('texto')}, '\b(?:en (?:mi|el|tu|su) cuaderno|(?:observ|copi|dibuj|coment|convers|investig|identific|complet|recort|pint|elabor|subray|anot|realiz|pregunt|organiz|compar|explic|clasific|dialog|reflexion|solicit|marc|busc)(?:o|amos)|(?:escrib|describ)(?:o|imos)|(?:respond|le|hac)(?:o|emos)|peg(?:o|amos)|el juego consiste|(?:lanz|tir)(?:ar|a|an) el dado|su turno|por turnos|gana (?:quien|el que)|participantes?|con el apoyo del maestro|cada uno marca)\b')) AS actividad,
({n('texto', chr(92) + 'p{L}')} >= 6 AND {n('texto', chr(92) + 'p{Lu}')} >= 0.6::DOUBLE * {n('texto', chr(92) + 'p{L}')}) AS mayusculas"""

_ART = "(?:el |la |los |las |un |una |unos |unas )?"
_VERB = rf"(?i)^{_ART}([^,;:()]{{2,45}}?)\s+(es|son|era|eran|consiste en|significa|quiere decir|se define como|se denomina|se llama|se refiere a|se conoce como|se entiende por|comprende|abarca)\s+(\S.{{15,}})$"
_NAMED = rf"(?i)^(.{{15,}}?)\b(?:se (?:llama|denomina|conoce como)|llamad[oa]s?|denominad[oa]s?|conocid[oa]s? como)\s+{_ART}([^,;:().]{{2,45}})\.?$"
_COLON = r"^([^:]{2,45}):\s+(\S.{15,})$"


def _sound(t: str, r: str) -> str:
    toks = f"list_transform(regexp_extract_all({t}, '{STUDY}'), lambda x: CASE WHEN length({fold('x')}) < 3 OR {fold('x')} IN ({STOPS}) THEN '' ELSE {fold('x')} END)"
    end = r"(?:$|[^\p{L}\p{N}_])"
    return rf"({n(t, STUDY)} <= 4 AND NOT regexp_matches({r}, '(?i)^(?:muy|tan|m[aá]s|menos|casi|s[oó]lo|bastante|demasiado|un poco|as[ií]){end}') AND NOT ({n(t, chr(92) + 'p{L}')} >= 6 AND {n(t, chr(92) + 'p{Lu}')} >= 0.6::DOUBLE * {n(t, chr(92) + 'p{L}')}) AND NOT regexp_matches({t}, '\p{{Nd}}') AND len({toks}) > 0 AND ({toks})[1] <> '' AND ({toks})[-1] <> '')"


_TRIM = "regexp_replace({}, '^[ \"«»'']+|[ \"«»'']+$', '', 'g')"
_ITEMS = r"list_filter(regexp_split_to_array(r3, ',|(?:^|\b)y\b'), lambda x: trim(x) <> '')"
DEFINITIONS = rf""", da AS (SELECT libro, orden, pagina, texto, {PRED} FROM se),
db AS (SELECT libro, orden, pagina, texto, {_TRIM.format(f"regexp_extract(texto, '{_VERB}', 1)")} AS t1, lower(regexp_extract(texto, '{_VERB}', 2)) AS v1, trim(regexp_extract(texto, '{_VERB}', 3)) AS r1,
  {_TRIM.format(f"regexp_extract(texto, '{_NAMED}', 2)")} AS t2, trim(regexp_extract(texto, '{_NAMED}', 1)) AS r2, {_TRIM.format(f"regexp_extract(texto, '{_COLON}', 1)")} AS t3, trim(regexp_extract(texto, '{_COLON}', 2)) AS r3 FROM da WHERE NOT (dialogo OR persona OR actividad)),
dc AS (SELECT *, regexp_matches(texto, '{_VERB}') AND {_sound('t1', 'r1')} AND (v1 NOT IN ('es', 'era') OR regexp_matches(r1, '(?i)^(?:el|la|lo|los|las|un|una|unos|unas|aquel|aquella|aquello)(?:$|[^\p{{L}}\p{{N}}_])')) AS k1,
  regexp_matches(texto, '{_NAMED}') AND {_sound('t2', 'r2')} AS k2,
  regexp_matches(texto, '{_COLON}') AND {_sound('t3', 'r3')} AND NOT (len({_ITEMS}) >= 3 AND list_sum(list_transform({_ITEMS}, lambda x: len(list_filter(regexp_split_to_array(x, '\s+'), lambda y: y <> '')))) <= 3 * len({_ITEMS})) AND {fold('t3')} NOT IN ({quoted(sorted(set(LABEL_WORDS)))}) AS k3 FROM db),
dd AS (SELECT libro, orden, pagina, texto, CASE WHEN k1 THEN t1 WHEN k2 THEN t2 ELSE t3 END AS termino, k1 AND v1 NOT IN ('es', 'son', 'era', 'eran', 'comprende', 'abarca') AS fuerte FROM dc WHERE k1 OR k2 OR k3),
df AS (SELECT *, array_to_string(list_filter(list_transform(regexp_extract_all(termino, '{STUDY}'), lambda x: CASE WHEN length({fold('x')}) < 3 OR {fold('x')} IN ({STOPS}) THEN '' ELSE {fold('x')} END), lambda x: x <> ''), ' ') AS clave FROM dd)"""


KEPT_KEYS = "ol AS (SELECT libro, list({'clave': clave, 'veces': veces} ORDER BY puesto) AS c FROM rc GROUP BY libro), od AS (SELECT libro, list_reduce(list_transform(c, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda s: (contains(s.clave, x[1].clave) OR contains(x[1].clave, s.clave)) AND abs(s.veces - x[1].veces) <= x[1].veces * 0.4::DOUBLE)) > 0 THEN a ELSE list_concat(a, x) END)[1:60] AS k FROM ol), oe AS (SELECT libro, unnest(k) AS x, generate_subscripts(k, 1) AS puesto FROM od)"
#: Sentences that explain, by the flags of PRED.
EXPLAINS = r"NOT (dialogo OR persona OR actividad OR regexp_matches(texto, '^\p{Ll}') OR len(texto) - len(replace(texto, ',', '')) >= 3)"


def names(c: str, term: str) -> str:
    return f"regexp_matches({fold(c)}, '(^|[^a-z0-9])' || regexp_escape({fold(term)}) || '($|[^a-z0-9])') AND regexp_matches({fold(term)}, '[a-z0-9]')"


# The concepts of each book from the sentences of confident pages: definitions first, then frequent terms.
CONCEPTS = (
    sentences("cb", ", cb AS (SELECT * FROM b WHERE confianza IS NULL OR confianza >= 0.6::DOUBLE)")
    + DEFINITIONS
    + rf""", {TOKENS}, {RANK}, {KEPT_KEYS},
kk AS (SELECT libro, puesto, x.clave AS clave FROM oe),
dg AS (SELECT df.*, row_number() OVER (PARTITION BY libro, df.clave ORDER BY orden) AS k FROM df WHERE clave <> '' AND (fuerte OR (libro, clave) IN (SELECT (libro, clave) FROM kk))),
mf AS (SELECT libro, clave, forma, row_number() OVER (PARTITION BY libro, clave ORDER BY count(*) DESC, min((orden, i))) AS k FROM gr WHERE (libro, clave) IN (SELECT (libro, clave) FROM kk) GROUP BY libro, clave, forma),
ky AS (SELECT libro, CASE WHEN fuerte THEN 0 ELSE 1 END AS nivel, orden AS lugar, clave, termino FROM dg WHERE k = 1 UNION ALL SELECT kk.libro, 2, puesto, kk.clave, forma FROM kk JOIN mf ON kk.libro = mf.libro AND kk.clave = mf.clave AND mf.k = 1 WHERE (kk.libro, kk.clave) NOT IN (SELECT (libro, clave) FROM dg WHERE k = 1)),
pr AS (SELECT libro, orden, texto, {PRED} FROM se),
us2 AS (SELECT ky.libro, ky.clave, count(*) AS n, bool_or({EXPLAINS}) AS alguna FROM ky JOIN pr ON ky.libro = pr.libro AND {names('texto', 'termino')} GROUP BY ALL),
ft AS (SELECT ky.*, n, row_number() OVER (PARTITION BY ky.libro ORDER BY nivel, lugar, ky.clave) AS puesto FROM ky LEFT JOIN us2 USING (libro, clave) WHERE nivel < 2 OR (n >= 2 AND alguna)),
co AS (SELECT libro, puesto, clave, nivel < 2 AS es_definicion, greatest(coalesce(n, 0), coalesce(nz.veces, 1))::INT AS veces, CASE WHEN regexp_matches(termino, '^\p{{Lu}}') THEN termino ELSE lower(termino) END AS termino FROM ft LEFT JOIN (SELECT * FROM nc WHERE veces >= 2) nz USING (libro, clave) WHERE puesto <= 12)"""
)

ORACLES = {
    "readability": DOCS + " SELECT doc_id, palabras, oraciones, silabas, silabas_por_palabra, palabras_por_oracion, round(puntuacion, 6) AS puntuacion, nivel FROM r",
    "level_band": DOCS + " SELECT doc_id, nivel, CASE WHEN round(puntuacion, 2) >= 90 THEN 'primaria_baja' WHEN round(puntuacion, 2) >= 75 THEN 'primaria_alta' ELSE 'basicos' END AS nivel_clasico FROM r",
    "level_distribution": DOCS + " SELECT lang, nivel, count(*) AS n, sum(palabras) AS palabras FROM r GROUP BY ALL",
    "features_density": feature({"densidad_matematica": f"{n('x', '[+' + chr(92) + '-×÷=<>≤≥±%°√∑πΔ/*^]')}::DOUBLE / greatest(length(x), 1)", "densidad_digitos": f"{n('x', chr(92) + 'p{Nd}')}::DOUBLE / greatest(length(x), 1)", "largo_promedio_palabra": f"length(regexp_replace(x, '[^{L}]+', '', 'g'))::DOUBLE / palabras"}),
    "features_stopwords": feature({"prop_stopwords_ingles": f"{share(STOP_ENGLISH)}::DOUBLE / palabras", "prop_stopwords_espanol": f"{share(STOP_SPANISH)}::DOUBLE / palabras"}),
    "features_lexicon": feature({f"lexico_{s}": f"{share(v)}::DOUBLE / palabras * 1000" for s, v in LEXICON.items()}),
    "features_headings": feature({"encabezados_por_1000_palabras": f"{n('x', HEADING)}::DOUBLE / palabras * 1000"}),
    "msttr": f"WITH t AS (SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '{W}'), lambda x: lower(x)) AS w FROM documents) SELECT doc_id, round(CASE WHEN len(w) = 0 THEN 0 WHEN len(w) < 100 THEN len(list_distinct(w))::DOUBLE / len(w) ELSE list_avg(list_transform(range(0, len(w) // 100), lambda i: len(list_distinct(w[i*100+1:i*100+100])) / 100::DOUBLE)) END, 9) AS riqueza_lexica FROM t",
    "min_chars_gate": r"SELECT doc_id FROM documents WHERE length(regexp_replace(regexp_replace(coalesce(text, ''), '^[\s\x{00A0}\x{2028}]+', ''), '[\s\x{00A0}\x{2028}]+$', '')) >= 200",
    "fold_text": f"SELECT doc_id, md5({fold(chr(99) + 'oalesce(text, ' + chr(39) * 2 + ')')}) AS huella FROM documents",
    "corpus_accept_reject": rf"""WITH m AS (SELECT DISTINCT fila_id, trim(archivo) AS archivo, regexp_replace(regexp_replace(materia, '^\s+', ''), '\s+$', '') AS materia, trim(grado) AS grado, trim(fuente) AS fuente, alta_ts FROM manifiesto WHERE archivo IS NOT NULL AND trim(archivo) <> '' AND NOT starts_with(trim(archivo), '#')),
t AS (SELECT archivo, min(texto) AS texto FROM ejemplos WHERE archivo IS NOT NULL GROUP BY archivo),
j AS (SELECT m.*, t.texto, len(list_filter(regexp_split_to_array(coalesce(t.texto, ''), '\s+'), lambda x: x <> '')) AS palabras FROM m LEFT JOIN t USING (archivo))
SELECT fila_id, palabras, CASE WHEN materia IS NULL OR materia NOT IN ({quoted(SUBJECTS)}) THEN 'materia desconocida' WHEN texto IS NULL THEN 'falta el texto' WHEN palabras < 120 THEN 'texto corto' END AS motivo FROM j""",
    "class_counts": f"WITH {EX} SELECT materia, count(*) AS ejemplos FROM e GROUP BY materia",
    "label_names": f"WITH {EX} SELECT ejemplo_id, {case('materia', SUBJECT_NAMES)} AS nombre FROM e",
    "level_names": f"SELECT DISTINCT ejemplo_id, {case('nivel', LEVEL_NAMES)} AS nombre FROM metricas_legibilidad",
    "confidence_filter": f"WITH {PAGES} SELECT libro, count(*) FILTER (confianza IS NULL OR confianza >= 0.6::DOUBLE) AS usadas, count(*) FILTER (NOT (confianza IS NULL OR confianza >= 0.6::DOUBLE)) AS excluidas FROM b GROUP BY libro",
    "low_text_books": rf"WITH {PAGES}, q AS (SELECT libro, len(list_filter(regexp_split_to_array(coalesce(texto, ''), '\s+'), lambda x: x <> '')) < 20 AS pocas FROM b) SELECT libro, count(*) AS paginas, count(*) FILTER (pocas) AS casi_vacias, count(*) FILTER (pocas) > count(*) * 0.5::DOUBLE AS escaneado FROM q GROUP BY libro",
    "page_list_parse": "SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN array_to_string(list_sort(list_distinct([doc_id % 7, doc_id % 3, 12])), ',') END AS paginas FROM documents",
    "repeated_header": f"WITH {PAGES}, {border('b')} SELECT * FROM hr",
    "without_headers": f"WITH {PAGES}, {border('b')}, {without('b', 'hr', 'n1', False)}, {border('n1', True)}, {without('n1', 'fr', 'n2', True)} SELECT libro, pagina, pos, length(texto) AS largo FROM n2",
    "sentence_split": f"WITH {PAGES}, {pieces('b')} SELECT libro, pagina, pos, trozo, texto FROM pc",
    "sentence_filters": f"WITH {PAGES}, {pieces('b')}, {FLAGS} SELECT libro, pagina, pos, trozo, palabras, cifras, legible FROM fh",
    "sentence_dedup": f"WITH {PAGES}, {pieces('b')}, {FLAGS}, {KEPT} SELECT * FROM se",
    "sentences": SENTENCES + " SELECT * FROM se",
    "sentence_predicates": SENTENCES + f", pr AS (SELECT libro, orden, texto, {PRED} FROM se) SELECT libro, orden, dialogo, persona, actividad, mayusculas, NOT (dialogo OR persona OR actividad OR regexp_matches(texto, '^\\p{{Ll}}') OR len(texto) - len(replace(texto, ',', '')) >= 3) AS explica FROM pr",
    "ngram_freq": SENTENCES + f", {TOKENS} SELECT libro, clave, count(*)::INT AS veces FROM gr GROUP BY ALL",
    "modal_form": SENTENCES + f", {TOKENS}, mf AS (SELECT libro, clave, forma, count(*) AS n, min((orden, i)) AS p FROM gr GROUP BY ALL) SELECT libro, clave, forma FROM (SELECT *, row_number() OVER (PARTITION BY libro, clave ORDER BY n DESC, p) AS k FROM mf) WHERE k = 1",
    "candidate_rank": SENTENCES + f", {TOKENS}, {RANK} SELECT * FROM rc",
    "overlap_removal": SENTENCES + f", {TOKENS}, {RANK}, ol AS (SELECT libro, list({{'clave': clave, 'veces': veces}} ORDER BY puesto) AS c FROM rc GROUP BY libro), od AS (SELECT libro, list_reduce(list_transform(c, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda s: (contains(s.clave, x[1].clave) OR contains(x[1].clave, s.clave)) AND abs(s.veces - x[1].veces) <= x[1].veces * 0.4::DOUBLE)) > 0 THEN a ELSE list_concat(a, x) END)[1:60] AS k FROM ol), oe AS (SELECT libro, unnest(k) AS x, generate_subscripts(k, 1) AS puesto FROM od) SELECT libro, puesto::INT AS puesto, x.clave AS clave, x.veces AS veces FROM oe",
    "tfidf_weights": SENTENCES + f", {WEIGHTS} SELECT libro, orden, termino, round(peso, 6) AS peso FROM tw",
    "sentence_similarity": SENTENCES + f", {WEIGHTS}, sp AS (SELECT p.libro, p.orden AS a, q.orden AS b, sum(p.peso * q.peso) AS similitud FROM tw p JOIN tw q ON p.libro = q.libro AND p.termino = q.termino AND p.orden < q.orden GROUP BY ALL) SELECT libro, a, b, round(similitud, 6) AS similitud FROM sp WHERE similitud >= 0.05::DOUBLE",
    "timeline_dates": SENTENCES + f", {DATES} SELECT * FROM ev",
    "timeline_first": SENTENCES + f", {DATES} SELECT * FROM fe",
    "timeline_even_sample": SENTENCES + f", {DATES}, ti AS (SELECT *, row_number() OVER (PARTITION BY libro ORDER BY valor, pagina) - 1 AS i, count(*) OVER (PARTITION BY libro) AS n FROM fe), tp AS (SELECT *, CASE WHEN n <= 3 THEN i + 1 ELSE list_position(list_transform(range(0, 3), lambda k: round_even(k * (n - 1) / 2::DOUBLE, 0)::INT), i::INT) END AS puesto FROM ti) SELECT libro, puesto::INT AS puesto, fecha, valor, texto, pagina FROM tp WHERE puesto > 0",
    "roman_numeral": "SELECT doc_id, ([1, 4, 9, 40, 49, 80, 90, 100, NULL, NULL, 19])[doc_id % 11 + 1]::INT AS valor FROM documents",
    "ocr_lines": f"WITH {WORDS}, w4 AS (SELECT doc, pagina, par, l, string_agg(text, ' ' ORDER BY w) AS linea FROM w3 GROUP BY ALL), w5 AS (SELECT *, lag(par) OVER (PARTITION BY doc, pagina ORDER BY l) AS antes FROM w4) SELECT doc, pagina, md5(string_agg(CASE WHEN antes IS NULL THEN '' WHEN antes <> par THEN chr(10) || chr(10) ELSE chr(10) END || linea, '' ORDER BY l)) AS huella FROM w5 GROUP BY ALL",
    "ocr_confidence": f"WITH {WORDS} SELECT doc, pagina, round(coalesce(avg(CASE WHEN conf >= 0 THEN conf END) / 100, 0), 6) AS confianza FROM w3 GROUP BY ALL",
    "ocr_clean": rf"WITH q AS (SELECT DISTINCT reconocida_id, texto FROM paginas_reconocidas), l AS (SELECT reconocida_id, list_filter(list_transform(string_split({JOIN.replace('X', LIGATED)}, chr(10)), lambda y: {CLEAN_LINE}), lambda y: y = '' OR len(regexp_extract_all(y, '\p{{L}}')) >= 0.4::DOUBLE * len(regexp_extract_all(y, '\S'))) AS a FROM q) SELECT reconocida_id, md5(regexp_replace(regexp_replace(regexp_replace(array_to_string(a, chr(10)), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')) AS huella FROM l",
    "hyphen_join": rf"SELECT DISTINCT reconocida_id, md5({JOIN.replace('X', chr(99) + 'oalesce(texto, ' + chr(39) * 2 + ')')}) AS huella FROM paginas_reconocidas",
    "cer_pages": f"WITH {CER} SELECT pagina, caracteres, errores, round(errores::DOUBLE / caracteres, 9) AS cer FROM c",
    "cer_order_free": f"WITH {CER} SELECT pagina, errores_sin_orden FROM c",
    "cer_summary": f"WITH {CER} SELECT count(*) AS paginas, round(sum(errores)::DOUBLE / sum(caracteres) FILTER (caracteres > 0), 9) AS cer_global, round(sum(errores_sin_orden)::DOUBLE / sum(caracteres) FILTER (caracteres > 0), 9) AS cer_sin_orden, round(median(errores::DOUBLE / nullif(caracteres, 0)), 9) AS cer_mediana, round(avg(confianza), 9) AS confianza_media, round(avg(segundos), 9) AS segundos_por_pagina FROM c",
    "concepts": CONCEPTS + " SELECT libro, puesto::INT AS puesto, clave, termino, es_definicion, veces FROM co",
    # Power iteration over the links of each book; every node has a link of no weight to itself, so that none is lost.
    "textrank": SENTENCES.replace("WITH ", "WITH RECURSIVE ", 1) + f""", {WEIGHTS}, sp AS (SELECT p.libro, p.orden AS a, q.orden AS b, sum(p.peso * q.peso) AS w FROM tw p JOIN tw q ON p.libro = q.libro AND p.termino = q.termino AND p.orden <> q.orden GROUP BY ALL HAVING sum(p.peso * q.peso) >= 0.05::DOUBLE),
nd AS (SELECT se.libro, se.orden, count(*) OVER (PARTITION BY se.libro) AS n, z FROM se LEFT JOIN (SELECT libro, a, sum(w) AS z FROM sp GROUP BY ALL) t ON se.libro = t.libro AND se.orden = t.a),
ed AS (SELECT nd.libro, nd.orden AS a, sp.b, w / z AS p FROM sp JOIN nd ON sp.libro = nd.libro AND sp.a = nd.orden UNION ALL SELECT libro, orden, orden, 0 FROM nd),
r AS (SELECT libro, orden, 0 AS k, 1::DOUBLE / n AS s FROM nd UNION ALL
  SELECT ed.libro, ed.b, v.k + 1, 0.15::DOUBLE / max(v.n) + 0.85::DOUBLE * (sum(v.s * ed.p) + max(v.l) / max(v.n)) FROM (SELECT r.*, nd.n, sum(CASE WHEN z IS NULL THEN s ELSE 0 END) OVER (PARTITION BY r.libro) AS l FROM r JOIN nd ON r.libro = nd.libro AND r.orden = nd.orden WHERE k < 60) v JOIN ed ON ed.libro = v.libro AND ed.a = v.orden GROUP BY ed.libro, ed.b, v.k)
SELECT libro, orden, round(s, 9) AS puntos FROM r WHERE k = 60""",
    "term_coverage": CONCEPTS + f" SELECT se.libro, se.orden, count(DISTINCT termino)::INT AS cuantos FROM se JOIN co ON se.libro = co.libro AND {names('texto', 'termino')} GROUP BY ALL",
    "extracted_text": r"""WITH q AS (SELECT DISTINCT reconocida_id, regexp_replace(coalesce(texto, ''), '([\p{L}\p{M}\p{N}_])-\s*\n\s*([\p{L}\p{M}\p{N}_])', '\1\2', 'g') AS x FROM paginas_reconocidas),
l AS (SELECT reconocida_id, string_split(x, chr(10)) AS a FROM q),
m AS (SELECT reconocida_id, array_to_string(list_transform(range(1, len(a) + 1), lambda i: CASE WHEN i = 1 THEN '' WHEN regexp_matches(a[i-1], '[.:;]$') OR (a[i-1] = '' AND i > 2) OR regexp_matches(array_to_string(a[i:], chr(10)), '^\s*[A-ZÁÉÍÓÚÑ0-9]') THEN chr(10) ELSE ' ' END || a[i]), '') AS x FROM l)
SELECT DISTINCT reconocida_id, length(regexp_replace(regexp_replace(regexp_replace(regexp_replace(x, '[ \t]+', ' ', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), '^\s+', ''), '\s+$', '')) AS largo FROM m""",
    "pages_json": f"WITH {PAGES} SELECT libro, pagina, 0 AS pos, length(texto) AS largo, round(confianza, 9) AS confianza FROM b",
    "requested_pages": "SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'lista no valida' WHEN doc_id % 7 = 0 OR doc_id % 3 = 0 OR doc_id % 7 > doc_id % 15 OR doc_id % 3 > doc_id % 15 OR 12 > doc_id % 15 THEN 'pagina inexistente' END AS motivo FROM documents",
    "recogniser_hook": "SELECT DISTINCT trabajo AS doc, numero AS pagina, CASE WHEN numero % 7 <> 0 THEN trabajo || ':' || numero END AS texto, CASE WHEN numero % 7 <> 0 THEN 0.5::DOUBLE END AS confianza, CASE WHEN numero % 7 = 0 THEN 'ilegible' END AS error FROM paginas_reconocidas WHERE trabajo IS NOT NULL AND numero IS NOT NULL",
    "stream_windows": "WITH e AS (SELECT DISTINCT ON (evento_id) * FROM eventos_ocr WHERE ts IS NOT NULL), w AS (SELECT date_trunc('day', ts AT TIME ZONE 'UTC') AS desde, evento FROM e), m AS (SELECT max(ts AT TIME ZONE 'UTC') - INTERVAL 7 DAY AS marca FROM e) SELECT strftime(desde, '%Y-%m-%d') AS desde, count(*) FILTER (evento = 'page_done') AS hechas, count(*) FILTER (evento = 'page_failed') AS fallidas FROM w, m WHERE desde + INTERVAL 1 DAY <= marca GROUP BY ALL",
    "confusion_matrix": GRADED + " SELECT real, predicho, n FROM f",
    "class_report": GRADED + REPORT + " SELECT clase, round(p, 9) AS precision, round(r, 9) AS recall, round(f1, 9) AS f1, soporte FROM z",
    "overall_report": GRADED + REPORT + " SELECT round((SELECT sum(CASE WHEN real = predicho THEN n ELSE 0 END)::DOUBLE / sum(n) FROM f), 9) AS exactitud, round(avg(p), 9) AS macro_precision, round(avg(r), 9) AS macro_recall, round(avg(f1), 9) AS macro_f1, round(sum(p * soporte) / sum(soporte), 9) AS ponderado_precision, round(sum(r * soporte) / sum(soporte), 9) AS ponderado_recall, round(sum(f1 * soporte) / sum(soporte), 9) AS ponderado_f1 FROM z",
    "majority_baseline": STRATA + ", b AS (SELECT materia AS clase FROM t WHERE parte = 'entrenamiento' AND materia IS NOT NULL GROUP BY materia ORDER BY count(*) DESC, materia LIMIT 1) SELECT clase, round(avg(CASE WHEN materia = clase THEN 1.0 ELSE 0 END), 9) AS exactitud FROM t, b WHERE parte = 'prueba' AND materia IS NOT NULL GROUP BY clase",
    "stratified_split": STRATA + " SELECT ejemplo_id, parte FROM t",
    "level_accuracy": rf"WITH {EX}, y0 AS (SELECT ejemplo_id, texto, archivo, regexp_extract(grado, '^([1-6])[a-z]*_primaria$', 1) AS y FROM e), y1 AS (SELECT * FROM y0 WHERE y <> '' AND NOT coalesce(contains(archivo, 'material_manipulable'), false)), {read('y1', 'ejemplo_id', 'texto')} SELECT count(*) AS libros, count(*) FILTER (CASE WHEN y::INT <= 3 THEN puntuacion >= 83 ELSE puntuacion < 83 AND puntuacion >= 60 END) AS aciertos, count(*) FILTER (CASE WHEN y::INT <= 3 THEN round(puntuacion, 2) >= 90 ELSE round(puntuacion, 2) < 90 AND round(puntuacion, 2) >= 75 END) AS aciertos_clasicos, round(min(puntuacion), 6) AS minimo FROM r",
    "job_status": f"WITH {EVENTS} SELECT trabajo, estado, hechas, total, tardias, error FROM s",
    "job_pages": f"WITH {EVENTS} SELECT p.trabajo, array_to_string(list_sort(list(pagina)), ',') AS paginas FROM p JOIN s USING (trabajo) WHERE estado = 'listo' AND hecha <= terminado GROUP BY p.trabajo",
    "job_purge": f"WITH {EVENTS} SELECT trabajo, estado FROM s WHERE terminado IS NOT NULL AND epoch_us(TIMESTAMP '2025-01-01 00:00:00') - epoch_us(terminado) > 1800 * 1000000",
    "definition_match": SENTENCES + DEFINITIONS + " SELECT libro, orden, pagina, clave, termino, fuerte, texto FROM df WHERE clave <> ''",
    "first_definition": SENTENCES + DEFINITIONS + f", {TOKENS}, {RANK}, ol AS (SELECT libro, list({{'clave': clave, 'veces': veces}} ORDER BY puesto) AS c FROM rc GROUP BY libro), od AS (SELECT libro, unnest(list_reduce(list_transform(c, lambda x: [x]), lambda a, x: CASE WHEN len(list_filter(a, lambda s: (contains(s.clave, x[1].clave) OR contains(x[1].clave, s.clave)) AND abs(s.veces - x[1].veces) <= x[1].veces * 0.4::DOUBLE)) > 0 THEN a ELSE list_concat(a, x) END)[1:60]).clave AS clave FROM ol), dg AS (SELECT df.*, row_number() OVER (PARTITION BY libro, df.clave ORDER BY orden) AS k FROM df WHERE clave <> '' AND (fuerte OR (libro, clave) IN (SELECT (libro, clave) FROM od))) SELECT libro, clave, orden, pagina, termino, fuerte, texto FROM dg WHERE k = 1",
}
