"""DuckDB SQL of the operators that SQL can express."""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = rf"list_filter(regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {ALNUM} AS ws FROM documents),
i AS (SELECT item_id::VARCHAR AS item, {ALNUM} AS ws FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, size, array_to_string(ws[p:p + size - 1], ' ') AS win
  FROM (SELECT item, ws, least(len(ws), 13) AS size, unnest(generate_series(1, len(ws) - least(len(ws), 13) + 1)) AS p FROM i WHERE len(ws) > 0)),
dw AS (SELECT r, size, p, array_to_string(ws[p:p + size - 1], ' ') AS win
  FROM (SELECT r, ws, size, unnest(generate_series(1, len(ws) - size + 1)) AS p FROM d, (SELECT DISTINCT size FROM iw) WHERE len(ws) >= size)),
h AS (SELECT r, p, dw.size, item FROM dw JOIN iw ON dw.size = iw.size AND dw.win = iw.win),
n AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + size - 1)) AS q FROM h) GROUP BY r),
k AS (SELECT r, count(DISTINCT item) AS n_items, array_to_string(list_sort(list(DISTINCT item)), ',') AS items FROM h GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM d LEFT JOIN n USING (r) LEFT JOIN k USING (r)"""

QUALITY = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT r, t, list_filter(regexp_extract_all(t, '[^\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT r, p, count(*) OVER (PARTITION BY r, ws[p], ws[p + 1], ws[p + 2]) AS n FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS p FROM w)),
c AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM g WHERE n > 1) GROUP BY r),
b AS (SELECT r, len(ws) AS n_words, length(array_to_string(ws, '')) AS word_chars, length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
  len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words FROM w LEFT JOIN c USING (r)),
l AS (SELECT r, source, list_sort(list_distinct(list_transform(ls, lambda x: lower(regexp_replace(trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '[\x20\x09-\x0D]+', ' ', 'g'))))) AS lines FROM w JOIN d USING (r)),
v AS (SELECT r, source, lines, ('0x' || substr(md5(array_to_string(lines, chr(10))), 1, 15))::BIGINT AS fp FROM l),
u AS (SELECT DISTINCT source, fp, lines FROM v),
x AS (SELECT source, fp, unnest(lines) AS line FROM u),
f AS (SELECT source, line, count(*) AS holders, min(fp) AS home FROM x GROUP BY ALL),
z AS (SELECT source, count(*) AS docs FROM u GROUP BY source),
o AS (SELECT x.source, x.fp, sum(length(x.line)) AS removed FROM x JOIN f ON x.source IS NOT DISTINCT FROM f.source AND x.line = f.line JOIN z ON z.source IS NOT DISTINCT FROM f.source
  WHERE (holders > {max_docs} OR (holders > {min_docs} AND holders > {max_share} * docs)) AND x.fp <> home GROUP BY ALL),
gone AS (SELECT u.source, u.fp FROM o JOIN u ON u.source IS NOT DISTINCT FROM o.source AND u.fp = o.fp WHERE list_sum(list_transform(lines, lambda y: length(y))) - removed < {min_left} * list_sum(list_transform(lines, lambda y: length(y))))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND NOT EXISTS (SELECT 1 FROM gone WHERE gone.source IS NOT DISTINCT FROM v.source AND gone.fp = v.fp) AS kept
FROM d JOIN b USING (r) JOIN v USING (r)"""


def quality(max_docs: int, min_docs: int, max_share: float, min_left: float) -> str:
    return QUALITY.replace("{max_docs}", str(max_docs)).replace("{min_docs}", str(min_docs)).replace("{max_share}", str(max_share)).replace("{min_left}", str(min_left))
