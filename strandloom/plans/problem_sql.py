"""SQL with the rows of p3 and p6."""

P3_SQL = r"""
WITH o AS (SELECT row_id, min(table_name) AS table_name, min(partners) AS partners FROM merged_events WHERE row_id IS NOT NULL GROUP BY row_id),
l AS (SELECT row_id, table_name, regexp_extract_all(partners, '"(?:[^"]|"")*"|''(?:[^'']|'''')*''|[\w.\-]+|[^\w.\-"'']+|["'']') AS toks FROM o),
t AS (SELECT row_id, table_name, unnest(toks) AS tok, generate_subscripts(toks, 1) AS i FROM l),
u AS (SELECT *, CASE WHEN tok[1] = '"' AND length(tok) > 1 THEN replace(tok[2:-2], '""', '"') WHEN tok[1] = '''' AND length(tok) > 1 THEN replace(tok[2:-2], '''''', '''') END AS inside FROM t),
k AS (SELECT *, CASE
  WHEN inside IS NOT NULL THEN CASE WHEN regexp_full_match(inside, '(?s).*[,:]\s*\d+(\.0+)?\s*') THEN 'P' WHEN regexp_full_match(inside, '\d+(\.0+)?') THEN 'I' WHEN trim(inside) = '' THEN 'X' ELSE 'N' END
  WHEN regexp_matches(tok[1], '[\w.\-]') THEN CASE WHEN regexp_full_match(tok, '\d+(\.0+)?') THEN 'I' WHEN regexp_full_match(tok, '[+\-]?(\d+\.?\d*|\.\d+)([eE][+\-]?\d+)?') OR NOT regexp_matches(tok, '[A-Za-z0-9]') THEN 'X' ELSE 'N' END
  ELSE 'S' END AS kind FROM u),
w AS (SELECT *, lag(kind, 1) OVER b AS k1, regexp_replace(lag(tok, 1) OVER b, '\s', '', 'g') AS t1, lag(kind, 2) OVER b AS k2, lag(coalesce(inside, tok), 2) OVER b AS n2 FROM k WINDOW b AS (PARTITION BY row_id ORDER BY i)),
p AS (SELECT row_id, i, CASE WHEN kind = 'P' THEN coalesce(nullif(rtrim(regexp_extract(inside, '(?s)^(.*)[,:]\s*\d+(\.0+)?\s*$', 1)), ''), table_name) WHEN k1 = 'S' AND t1 IN (',', ':') AND k2 = 'N' THEN n2 ELSE table_name END AS partner_table,
  CAST(CASE WHEN kind = 'P' THEN regexp_extract(inside, '(?s)^.*[,:]\s*(\d+)(\.0+)?\s*$', 1) ELSE regexp_extract(coalesce(inside, tok), '^(\d+)', 1) END AS BIGINT) AS partner_event_id FROM w WHERE kind IN ('P', 'I'))
SELECT row_id, CAST(row_number() OVER (PARTITION BY row_id ORDER BY i) AS INTEGER) AS item_no, partner_table, partner_event_id FROM p
"""

_P6 = """
WITH l AS (SELECT DISTINCT feed_id, file_no, payload FROM call_files WHERE feed_id IS NOT NULL AND file_no IS NOT NULL),
f AS (SELECT feed_id, file_no, lag(file_no) OVER (PARTITION BY feed_id ORDER BY file_no) AS before FROM (SELECT DISTINCT feed_id, file_no FROM l)),
h AS (SELECT feed_id, file_no, field_name, alias_path, CASE json_type(payload, '$.' || alias_path) WHEN 'VARCHAR' THEN 'string' WHEN 'BIGINT' THEN 'integer' WHEN 'UBIGINT' THEN 'integer' WHEN 'HUGEINT' THEN 'integer' WHEN 'DOUBLE' THEN 'number' WHEN 'ARRAY' THEN 'array' WHEN 'OBJECT' THEN 'object' WHEN 'BOOLEAN' THEN 'boolean' END AS kind
  FROM (SELECT * FROM l WHERE json_valid(payload)) v, (SELECT DISTINCT alias_path, field_name FROM field_alias) a WHERE json_exists(payload, '$.' || alias_path)),
g AS (SELECT feed_id, file_no, field_name, array_to_string(list_sort(list_distinct(list(alias_path))), ',') AS names, list_sort(list_distinct(list(kind))) AS kinds FROM h GROUP BY 1, 2, 3),
k AS (SELECT feed_id, file_no, field_name, names, CASE WHEN len(kinds) = 0 THEN NULL WHEN len(kinds) = 1 THEN kinds[1] WHEN kinds = ['integer', 'number'] THEN 'number' ELSE 'mixed' END AS kind FROM g),
x AS (SELECT f.feed_id, f.file_no, n.field_name, o.names AS old_name, k.names AS new_name, o.kind AS old_type, k.kind AS new_type FROM f CROSS JOIN (SELECT DISTINCT field_name FROM field_alias) n
  LEFT JOIN k ON k.feed_id = f.feed_id AND k.file_no = f.file_no AND k.field_name = n.field_name LEFT JOIN k o ON o.feed_id = f.feed_id AND o.file_no = f.before AND o.field_name = n.field_name WHERE f.before IS NOT NULL),
c AS (SELECT *, 'added' AS change_kind FROM x WHERE old_name IS NULL AND new_name IS NOT NULL UNION ALL SELECT *, 'removed' FROM x WHERE old_name IS NOT NULL AND new_name IS NULL
  UNION ALL SELECT *, 'renamed' FROM x WHERE old_name <> new_name UNION ALL SELECT *, 'retyped' FROM x WHERE old_type <> new_type)
"""
P6_SQL = _P6 + "SELECT feed_id, file_no, field_name, change_kind FROM c"
P6_CHANGES_SQL = _P6 + "SELECT feed_id, file_no, field_name, change_kind, old_name, new_name, old_type, new_type FROM c"

P6_SCHEMA_SQL = """
WITH l AS (SELECT DISTINCT feed_id, file_no, payload FROM call_files WHERE feed_id IS NOT NULL AND file_no IS NOT NULL),
h AS (SELECT feed_id, file_no, field_name, alias_path, json_type(payload, '$.' || alias_path) AS kind FROM (SELECT * FROM l WHERE json_valid(payload)) v, (SELECT DISTINCT alias_path, field_name FROM field_alias) a WHERE json_exists(payload, '$.' || alias_path)),
f AS (SELECT field_name, count(DISTINCT (feed_id, file_no)) AS n_files, count(DISTINCT alias_path) AS n_names, bool_or(kind IN ('ARRAY', 'OBJECT')) AS deep, bool_or(kind IN ('VARCHAR')) AS words, bool_or(kind = 'DOUBLE') AS fractions, bool_or(kind IN ('BIGINT', 'UBIGINT')) AS wholes FROM h GROUP BY 1)
SELECT n.field_name, coalesce(n_files, 0) AS n_files, coalesce(n_names, 0) AS n_names, CASE WHEN deep THEN 'json' WHEN words THEN 'string' WHEN fractions THEN 'number' WHEN wholes THEN 'integer' END AS union_type
FROM (SELECT DISTINCT field_name FROM field_alias) n LEFT JOIN f ON n.field_name = f.field_name
"""

_TEXT = "(SELECT arg_min(json_extract_string(payload, '$.' || alias_path), alias_path) FROM (SELECT DISTINCT alias_path FROM field_alias WHERE field_name = '{0}') a WHERE json_valid(payload) AND json_exists(payload, '$.' || alias_path) AND json_extract_string(payload, '$.' || alias_path) IS NOT NULL)".format

P6_TABLE_SQL = f"""
WITH v AS (SELECT row_id, feed_id, file_no, line_no, coalesce(json_valid(payload), false) AS readable, {_TEXT('svtype')} AS svtype_text, {_TEXT('svlen')} AS svlen_text, {_TEXT('chr2')} AS chr2_text FROM call_files),
u AS (SELECT *, regexp_replace(svtype_text, '^\\["(.*)"\\]$', '\\1') AS t, regexp_replace(replace(regexp_replace(svlen_text, '[\\[\\]"]', '', 'g'), ',', ''), '\\s*(bp)?$', '') AS l, regexp_replace(chr2_text, '^\\["(.*)"\\]$', '\\1') AS c FROM v),
w AS (SELECT *, split_part(upper(regexp_replace(trim(t, ' \t\r\n'), '[<>]', '', 'g')), ':', 1) AS kind, CAST(trunc(TRY_CAST(l AS DOUBLE)) AS BIGINT) AS size FROM u)
SELECT row_id, feed_id, file_no, line_no, readable, CASE WHEN kind IN ('DEL', 'INS', 'DUP', 'INV', 'TRA', 'BND') THEN kind END AS svtype, CASE WHEN size NOT IN (0, -1) THEN abs(size) END AS svlen,
  'chr' || upper(regexp_replace(trim(c, ' \t\r\n'), '^(?i)chr', '')) AS chr2, svtype_text, svlen_text, chr2_text,
  concat_ws(',', CASE WHEN svtype_text IS NOT NULL AND coalesce(kind, '') NOT IN ('DEL', 'INS', 'DUP', 'INV', 'TRA', 'BND') THEN 'svtype' END, CASE WHEN svlen_text IS NOT NULL AND size IS NULL THEN 'svlen' END) AS unread FROM w
"""
