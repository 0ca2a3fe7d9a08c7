"""SQL that gives the same rows as a query, where SQL can express it on whole tables."""

ORACLES = {
    "p10_found": """
WITH w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}]+'), lambda x: x <> '') AS words FROM documents WHERE text IS NOT NULL
), g AS (
  SELECT doc_id, len(words) AS n, unnest(list_transform(range(1, len(words) - 6), lambda i: {'p': i, 'passage': array_to_string(words[i:i+7], ' ')})) AS s FROM w WHERE len(words) >= 8
), again AS (
  SELECT doc_id, n, s['p'] AS p FROM (SELECT doc_id, n, s, row_number() OVER (PARTITION BY doc_id, s['passage'] ORDER BY s['p']) AS k FROM g) WHERE k > 1
), inside AS (
  SELECT doc_id, n, count(DISTINCT p + o) AS covered FROM again, (SELECT unnest(range(0, 8)) AS o) GROUP BY doc_id, n
)
SELECT doc_id FROM inside WHERE covered::DOUBLE / n >= 0.3
""",
    # Links through shared keys, closed by recursion; the smallest record reached names the group.
    "p7_found": r"""
WITH RECURSIVE m AS (
  SELECT DISTINCT fila_id, archivo, fuente FROM manifiesto WHERE fila_id IS NOT NULL AND (archivo IS NULL OR NOT starts_with(ltrim(archivo), '#'))
), s0 AS (
  SELECT fila_id, archivo, fuente, regexp_replace(translate(lower(fuente), 'áéíóú', 'aeiou'), '[^a-z]', '', 'g') AS letters,
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(fuente, '^\s+|\s+$', '', 'g'), '^(?i)[a-z][a-z0-9+.-]*://', ''), '[?#].*$', ''), '^(?i)www\.', '') AS u FROM m
), s1 AS (
  SELECT *, regexp_replace(url_decode(replace(u, '+', '%2B')), '[/\s]+$', '') AS v FROM s0
), s2 AS (
  SELECT fila_id, CASE WHEN fuente IS NOT NULL AND v <> '' AND letters NOT IN ('', 'sf', 'nd', 'na', 'desconocida', 'desconocido', 'sinfuente', 'sindato', 'sindatos', 'ninguna', 'ninguno', 'noaplica', 'nodisponible', 'pordefinir', 'pendiente', 'unknown', 'none', 'null', 'nan', 'xxx')
      THEN CASE WHEN contains(v, '/') THEN lower(v[1:strpos(v, '/') - 1]) || v[strpos(v, '/'):] ELSE lower(v) END END AS fk,
    regexp_replace(regexp_replace(regexp_replace(translate(lower(regexp_replace(archivo, '^.*[/\\]', '')), 'áéíóúüñ', 'aeiouun'), '\.[a-z0-9]{1,5}\s*$', ''), '[\s_.-]+', '_', 'g'), '^_?(?:(?:copia|copy)(?:_(?:de|of))?_(?:\(\d+\)_)?)+', '') AS a FROM s1
), s3 AS (
  SELECT fila_id, fk, regexp_replace(a, '(?:_*\(\d+\)|_+\(?(?:copia|copy)\)?(?:_?\(?\d+\)?)?|_+v(?:er(?:sion)?)?_?\d+|_+(?:final|definitiv[oa]|rev\d*|borrador))_*$', '') AS a FROM s2
), s4 AS (
  SELECT fila_id, fk, regexp_replace(regexp_replace(a, '(?:_*\(\d+\)|_+\(?(?:copia|copy)\)?(?:_?\(?\d+\)?)?|_+v(?:er(?:sion)?)?_?\d+|_+(?:final|definitiv[oa]|rev\d*|borrador))_*$', ''), '^_+|_+$', '', 'g') AS ak FROM s3
), k AS (
  SELECT fila_id, 'f' || fk AS clave FROM s4 WHERE fk IS NOT NULL UNION SELECT fila_id, 'a' || ak FROM s4 WHERE ak <> ''
), r AS (
  SELECT fila_id, fila_id AS otra FROM s4 UNION SELECT r.fila_id, z.fila_id FROM r JOIN k ON k.fila_id = r.otra JOIN k z ON z.clave = k.clave
)
SELECT fila_id, min(otra) AS grupo FROM r GROUP BY fila_id
""",
}
