"""SQL with the same rows as the queries of this subpackage, where SQL can say it."""

from ..plans.problems import SQL_LENGTH, SQL_TYPE

_P2 = f"""c AS MATERIALIZED (
  SELECT call_id, min(grp) AS grp, coalesce(min(sample_name), '') AS src, min(filt) AS filt, min(su) AS su, min(called_at) AS called_at,
         min(CASE WHEN {SQL_TYPE('svtype')} IN ('DEL', 'INS', 'DUP', 'INV', 'TRA', 'BND') THEN {SQL_TYPE('svtype')} END) AS t, min({SQL_LENGTH('svlen')}) AS l
  FROM sv_calls WHERE grp >= 0 AND call_id IS NOT NULL GROUP BY call_id),
r AS MATERIALIZED (
  SELECT *, row_number() OVER (PARTITION BY grp ORDER BY CASE WHEN filt = 'PASS' THEN 0 ELSE 1 END, su DESC NULLS LAST, call_id) AS a,
         row_number() OVER (PARTITION BY grp ORDER BY called_at DESC NULLS LAST, call_id) AS b FROM c)"""
P2_SQL = f"""
WITH {_P2}
SELECT grp, arg_min(call_id, a) AS call_id, coalesce(arg_min(t, a) FILTER (WHERE t IS NOT NULL), '.') AS svtype, coalesce(arg_min(l, b) FILTER (WHERE l IS NOT NULL), -1) AS svlen
FROM r GROUP BY grp HAVING count(*) >= 2
"""


def _fitted(rounds: int) -> str:
    """The latent truth model as a chain of tables: q<i> are the qualities after i rounds, v<i> the values judged by them."""
    claims = """x AS MATERIALIZED (SELECT DISTINCT grp AS g, 'svtype' AS field, t AS value, src FROM c WHERE t IS NOT NULL UNION ALL SELECT DISTINCT grp, 'svlen', CAST(l AS VARCHAR), src FROM c WHERE l IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT g, field, src FROM x), q0 AS MATERIALIZED (SELECT DISTINCT field, src, 0.7 AS sens, 0.2 AS fpr FROM s)"""
    steps = [claims]
    held = "greatest(0.0001, least(0.9999, {0}))".format
    for i in range(rounds + 1):
        deny = "ln((1 - sens) / (1 - fpr))"
        steps.append(f"""v{i} AS MATERIALIZED (SELECT k.g, k.field, k.value, n_src, 1 / (1 + exp(-greatest(-60, least(60, base + gain)))) AS p
  FROM (SELECT x.g, x.field, x.value, count(*) AS n_src, sum(ln(sens / fpr) - {deny}) AS gain FROM x JOIN q{i} USING (field, src) GROUP BY 1, 2, 3) k
  JOIN (SELECT s.g, s.field, sum({deny}) AS base FROM s JOIN q{i} USING (field, src) GROUP BY 1, 2) d ON k.g = d.g AND k.field = d.field)""")
        if i < rounds:
            steps.append(f"""q{i + 1} AS MATERIALIZED (SELECT h.field, h.src, {held('(tp + 5) / (t + 10)')} AS sens, {held('(fp + 1) / (f + 10)')} AS fpr
  FROM (SELECT x.field, x.src, sum(p) AS tp, sum(1 - p) AS fp FROM x JOIN v{i} USING (g, field, value) GROUP BY 1, 2) h
  JOIN (SELECT s.field, s.src, sum(t) AS t, sum(f) AS f FROM s JOIN (SELECT g, field, sum(p) AS t, sum(1 - p) AS f FROM v{i} GROUP BY 1, 2) w USING (g, field) GROUP BY 1, 2) n ON h.field = n.field AND h.src = n.src)""")
    return ",\n".join(steps)


_ROUNDS = 6
_FIT = f"WITH {_P2}, {_fitted(_ROUNDS)}"
P2_VALUES_SQL = f"{_FIT} SELECT g AS grp, field, value, n_src, round(p, 6) AS p_true, p >= 0.5 AS judged_true FROM v{_ROUNDS}"
P2_SOURCES_SQL = f"{_FIT} SELECT field, src AS sample_name, round(sens, 6) AS sensitivity, round(fpr, 6) AS false_positive_rate FROM q{_ROUNDS}"
_JOINED = f"""{_FIT}, j AS (SELECT r.*, vt.p AS pt, vl.p AS pl FROM r LEFT JOIN v{_ROUNDS} vt ON vt.g = grp AND vt.field = 'svtype' AND vt.value = t LEFT JOIN v{_ROUNDS} vl ON vl.g = grp AND vl.field = 'svlen' AND vl.value = CAST(l AS VARCHAR))"""
P2_SURVIVORS_SQL = f"""{_JOINED}
SELECT grp, arg_min(call_id, a) AS call_id, count(*) AS n_records, coalesce(arg_min(t, a) FILTER (WHERE t IS NOT NULL), '.') AS svtype, coalesce(arg_min(l, b) FILTER (WHERE l IS NOT NULL), -1) AS svlen,
  round(arg_min(pt, a) FILTER (WHERE t IS NOT NULL), 6) AS p_svtype, round(arg_min(pl, b) FILTER (WHERE l IS NOT NULL), 6) AS p_svlen FROM j GROUP BY grp HAVING count(*) >= 2
"""
P2_FUSED_SQL = f"""{_JOINED}, o AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY t IS NULL, -round(pt, 9), a) AS ra, row_number() OVER (PARTITION BY grp ORDER BY l IS NULL, -round(pl, 9), b) AS rb FROM j),
n AS (SELECT g, count(*) FILTER (WHERE field = 'svtype' AND p >= 0.5) AS nt, count(*) FILTER (WHERE field = 'svlen' AND p >= 0.5) AS nl FROM v{_ROUNDS} GROUP BY g)
SELECT grp, arg_min(call_id, a) AS call_id, coalesce(arg_min(t, ra) FILTER (WHERE t IS NOT NULL), '.') AS svtype, coalesce(arg_min(l, rb) FILTER (WHERE l IS NOT NULL), -1) AS svlen,
  round(arg_min(pt, ra) FILTER (WHERE t IS NOT NULL), 6) AS p_svtype, round(arg_min(pl, rb) FILTER (WHERE l IS NOT NULL), 6) AS p_svlen, coalesce(max(nt), 0) AS n_true_svtype, coalesce(max(nl), 0) AS n_true_svlen
FROM o LEFT JOIN n ON g = grp GROUP BY grp HAVING count(*) >= 2
"""

P4_SQL = """
WITH d AS (SELECT rec_id, min(info) AS info FROM vcf_records WHERE rec_id IS NOT NULL AND info IS NOT NULL GROUP BY rec_id),
i AS (SELECT DISTINCT rec_id, trim(x, ' \t\r\n') AS item FROM (SELECT rec_id, unnest(string_split(info, ';')) AS x FROM d) WHERE trim(x, ' \t\r\n') <> ''),
n AS (SELECT rec_id, count(*) AS n FROM i GROUP BY rec_id),
s AS (SELECT a.rec_id AS rec_id_a, b.rec_id AS rec_id_b, count(*) AS shared FROM i a JOIN i b ON a.item = b.item AND a.rec_id < b.rec_id GROUP BY 1, 2)
SELECT rec_id_a, rec_id_b FROM s JOIN n x ON x.rec_id = rec_id_a JOIN n y ON y.rec_id = rec_id_b WHERE shared * 5 >= (x.n + y.n - shared) * 4
"""

_P7 = """
WITH o AS (SELECT read_id, min(rg) AS rg, min(abs(CAST(tlen AS BIGINT))) AS v FROM alignments WHERE tlen IS NOT NULL AND tlen <> 0 GROUP BY read_id),
p AS (SELECT rg, unnest([50, 90, 99]) AS pct, unnest([quantile_disc(v, 0.50), quantile_disc(v, 0.90), quantile_disc(v, 0.99)]) AS value, count(*) AS n_all FROM o GROUP BY rg)
"""
P7_SQL = _P7 + "SELECT rg, CAST(pct AS INTEGER) AS pct FROM p WHERE value > CASE pct WHEN 50 THEN 500 WHEN 90 THEN 800 ELSE 3000 END"

P4_GROUPS_SQL = """
WITH RECURSIVE d AS (SELECT rec_id, min(info) AS info FROM vcf_records WHERE rec_id IS NOT NULL AND info IS NOT NULL GROUP BY rec_id),
i AS (SELECT DISTINCT rec_id, trim(x, ' \t\r\n') AS item FROM (SELECT rec_id, unnest(string_split(info, ';')) AS x FROM d) WHERE trim(x, ' \t\r\n') <> ''),
k AS (SELECT rec_id, upper(md5(string_agg(item, chr(10) ORDER BY item))) AS class_key FROM i GROUP BY rec_id),
c AS (SELECT class_key, count(*) AS n_copies, min(rec_id) AS rec_id FROM k GROUP BY class_key),
ci AS (SELECT class_key, item FROM c JOIN i ON c.rec_id = i.rec_id), n AS (SELECT class_key, count(*) AS n FROM ci GROUP BY class_key),
s AS (SELECT a.class_key AS ka, b.class_key AS kb, count(*) AS shared FROM ci a JOIN ci b ON a.item = b.item AND a.class_key < b.class_key GROUP BY 1, 2),
e AS (SELECT ka, kb FROM s JOIN n x ON x.class_key = ka JOIN n y ON y.class_key = kb WHERE shared * 5 >= (x.n + y.n - shared) * 4),
l AS (SELECT ka AS a, kb AS b FROM e UNION SELECT kb, ka FROM e), walk AS (SELECT class_key AS a, class_key AS b FROM c UNION SELECT walk.a, l.b FROM walk JOIN l ON walk.b = l.a),
g AS (SELECT a AS class_key, min(b) AS group_id FROM walk GROUP BY a), o AS (SELECT a AS class_key, sum(n_copies) AS others FROM l JOIN c ON c.class_key = b GROUP BY a)
SELECT rec_id, k.class_key, group_id, n_copies, CAST(n_copies - 1 + coalesce(others, 0) AS BIGINT) AS n_links FROM k JOIN g ON k.class_key = g.class_key JOIN (SELECT class_key, n_copies FROM c) c ON k.class_key = c.class_key LEFT JOIN o ON k.class_key = o.class_key
"""

P7_PERCENTILES_SQL = _P7 + "SELECT rg, CAST(pct AS INTEGER) AS pct, CAST(value AS DOUBLE) AS value, CAST(value AS DOUBLE) AS at_least, CAST(value AS DOUBLE) AS at_most, n_all FROM p"
P7_DAILY_SQL = """
WITH o AS (SELECT read_id, min((rg, abs(CAST(tlen AS BIGINT)), CAST(aligned_at AS DATE))) AS r FROM alignments WHERE tlen IS NOT NULL AND tlen <> 0 GROUP BY read_id),
m AS (SELECT r[1] AS rg, r[2] AS v, strftime(r[3], '%Y-%m') AS month FROM o)
SELECT rg, month, CAST(unnest([50, 90, 99]) AS INTEGER) AS pct, CAST(unnest([quantile_disc(v, 0.50), quantile_disc(v, 0.90), quantile_disc(v, 0.99)]) AS DOUBLE) AS value, count(*) AS n_all FROM m GROUP BY rg, month
"""

ORACLES = {"p2_found": P2_SQL, "p2_survivors": P2_SURVIVORS_SQL, "p2_fused": P2_FUSED_SQL, "p2_values": P2_VALUES_SQL, "p2_sources": P2_SOURCES_SQL, "p4_found": P4_SQL, "p4_groups": P4_GROUPS_SQL, "p7_found": P7_SQL, "p7_daily": P7_DAILY_SQL}
