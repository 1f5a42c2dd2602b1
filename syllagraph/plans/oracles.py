"""SQL of the registered queries, on the relational tables."""

from __future__ import annotations

from syllagraph.operators.report import GRAPH_NOTE

BASE = """
course AS (
  SELECT curriculum_id, course_id, name, prefix, number, credits, prefix || number AS natural_key,
         CASE WHEN count(*) OVER (PARTITION BY curriculum_id, prefix || number) > 1 THEN prefix || number || '_' || course_id ELSE prefix || number END AS course_key
  FROM (SELECT o_custkey AS curriculum_id,
               row_number() OVER (PARTITION BY o_custkey ORDER BY l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS course_id,
               p_name AS name, p_brand AS prefix, CAST(p_size AS VARCHAR) AS number, CAST(1 + l_quantity % 4 AS DOUBLE) AS credits
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON p_partkey = l_partkey) AS x
), curriculum AS (
  SELECT CAST(c_custkey AS BIGINT) AS curriculum_id, 'Plan ' || c_custkey AS name, n_name AS institution, c_mktsegment AS degree_type,
         CASE WHEN c_custkey % 5 = 0 THEN 'quarter' ELSE 'semester' END AS system_type, '11.0701' AS cip_code
  FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_custkey IN (SELECT curriculum_id FROM course)
), spot AS (
  SELECT *, lag(course_id) OVER (PARTITION BY curriculum_id, prefix ORDER BY course_id) AS same_prefix,
         lag(prefix || ' ' || number || ' (note)') OVER (PARTITION BY curriculum_id ORDER BY course_id) AS words FROM course
), edge AS (
  SELECT curriculum_id, same_prefix AS src, course_id AS dst, 'prereq' AS kind, 1 AS ord FROM spot WHERE same_prefix IS NOT NULL
  UNION ALL SELECT curriculum_id, course_id - 3, course_id, 'prereq', 2 FROM spot WHERE course_id > 3 AND course_id % 5 = 0 AND (same_prefix IS NULL OR same_prefix <> course_id - 3)
  UNION ALL SELECT curriculum_id, course_id - 1, course_id, 'coreq', 1 FROM spot WHERE course_id > 1 AND course_id % 8 = 0
  UNION ALL SELECT curriculum_id, course_id - 2, course_id, 'strict', 1 FROM spot WHERE course_id > 2 AND course_id % 11 = 0
), req AS (SELECT DISTINCT curriculum_id, src, dst FROM edge),
kedge AS (
  SELECT e.curriculum_id, a.course_key AS src, b.course_key AS dst, e.kind, e.ord, b.course_id AS dst_pos
  FROM (SELECT curriculum_id, src, dst, CASE WHEN kind = 'prereq' THEN 'prereq' ELSE 'coreq' END AS kind, min(ord + CASE WHEN kind = 'strict' THEN 10000 ELSE 0 END) AS ord
        FROM edge GROUP BY curriculum_id, src, dst, CASE WHEN kind = 'prereq' THEN 'prereq' ELSE 'coreq' END) AS e
  JOIN course AS a ON a.curriculum_id = e.curriculum_id AND a.course_id = e.src
  JOIN course AS b ON b.curriculum_id = e.curriculum_id AND b.course_id = e.dst
)"""

PATHS = """,
fwd(curriculum_id, v, k) AS (
  SELECT curriculum_id, course_id, 0 FROM course AS c WHERE NOT EXISTS (SELECT 1 FROM req AS r WHERE r.curriculum_id = c.curriculum_id AND r.dst = c.course_id)
  UNION ALL SELECT f.curriculum_id, r.dst, f.k + 1 FROM fwd AS f JOIN req AS r ON r.curriculum_id = f.curriculum_id AND r.src = f.v
), bwd(curriculum_id, v, k) AS (
  SELECT curriculum_id, course_id, 0 FROM course AS c WHERE NOT EXISTS (SELECT 1 FROM req AS r WHERE r.curriculum_id = c.curriculum_id AND r.src = c.course_id)
  UNION ALL SELECT f.curriculum_id, r.src, f.k + 1 FROM bwd AS f JOIN req AS r ON r.curriculum_id = f.curriculum_id AND r.dst = f.v
), paths AS (
  SELECT f.curriculum_id, f.v, a, b, a + b + 1 AS delay, CASE WHEN a > 0 AND b > 0 THEN lp * s + ls * p - p * s ELSE 0 END AS centrality
  FROM (SELECT curriculum_id, v, max(k) AS a, count(*) AS p, sum(k + 1) AS lp FROM fwd GROUP BY curriculum_id, v) AS f
  JOIN (SELECT curriculum_id, v, max(k) AS b, count(*) AS s, sum(k + 1) AS ls FROM bwd GROUP BY curriculum_id, v) AS g ON g.curriculum_id = f.curriculum_id AND g.v = f.v
)"""

REACH = """,
reach(curriculum_id, src, dst) AS (
  SELECT curriculum_id, src, dst FROM req
  UNION SELECT x.curriculum_id, x.src, r.dst FROM reach AS x JOIN req AS r ON r.curriculum_id = x.curriculum_id AND r.src = x.dst
)"""

METRICS = PATHS + REACH + """,
metrics AS (
  SELECT c.curriculum_id, c.course_id, c.course_key, c.name, c.credits, CAST(p.delay AS BIGINT) AS delay, CAST(coalesce(n, 0) AS BIGINT) AS blocking,
         CAST(p.delay + coalesce(n, 0) AS BIGINT) AS complexity, CAST(p.centrality AS BIGINT) AS centrality
  FROM course AS c JOIN paths AS p ON p.curriculum_id = c.curriculum_id AND p.v = c.course_id
  LEFT JOIN (SELECT curriculum_id, src, count(*) AS n FROM reach GROUP BY curriculum_id, src) AS b ON b.curriculum_id = c.curriculum_id AND b.src = c.course_id
)"""

DELAYS = PATHS + """,
delays AS (SELECT c.curriculum_id, c.course_id, c.course_key, c.credits, p.delay, p.a, p.centrality FROM course AS c JOIN paths AS p ON p.curriculum_id = c.curriculum_id AND p.v = c.course_id)"""

BEST = DELAYS + """,
best AS (
  SELECT curriculum_id, dst AS course_key, src AS best FROM (
    SELECT e.*, row_number() OVER (PARTITION BY e.curriculum_id, e.dst ORDER BY d.delay DESC, e.ord DESC) AS r
    FROM kedge AS e JOIN delays AS d ON d.curriculum_id = e.curriculum_id AND d.course_key = e.src WHERE e.kind = 'prereq') AS x WHERE r = 1
)"""

TRACES = BEST + """,
longest AS (SELECT curriculum_id, max(delay) AS delay FROM delays GROUP BY curriculum_id),
trace(curriculum_id, course_key, pos, head, path, n) AS (
  SELECT d.curriculum_id, d.course_key, d.course_id, d.course_key, d.course_key, 1 FROM delays AS d JOIN longest AS l ON l.curriculum_id = d.curriculum_id AND l.delay = d.delay
  UNION ALL SELECT t.curriculum_id, t.course_key, t.pos, b.best, b.best || '->' || t.path, t.n + 1 FROM trace AS t JOIN best AS b ON b.curriculum_id = t.curriculum_id AND b.course_key = t.head
), traced AS (
  SELECT curriculum_id, course_key, pos, path, n FROM (SELECT *, row_number() OVER (PARTITION BY curriculum_id, course_key ORDER BY n DESC) AS r FROM trace) AS x WHERE r = 1
)"""

STEPS = TRACES + """,
way AS (SELECT curriculum_id, string_split(path, '->') AS path FROM (SELECT *, row_number() OVER (PARTITION BY curriculum_id ORDER BY n DESC, pos) AS q FROM traced) AS x WHERE q = 1),
asks AS (SELECT curriculum_id, dst AS c, list(DISTINCT src) AS near FROM kedge WHERE kind = 'coreq' GROUP BY curriculum_id, dst),
asked AS (SELECT curriculum_id, src AS c, list(DISTINCT dst) AS near FROM kedge WHERE kind = 'coreq' GROUP BY curriculum_id, src),
item AS (
  SELECT i.curriculum_id, i.pos, i.c, list_concat(coalesce(a.near, []), list_intersect(coalesce(b.near, []), i.path)) AS near
  FROM (SELECT curriculum_id, path, generate_subscripts(path, 1) AS pos, unnest(path) AS c FROM way) AS i
  LEFT JOIN asks AS a ON a.curriculum_id = i.curriculum_id AND a.c = i.c LEFT JOIN asked AS b ON b.curriculum_id = i.curriculum_id AND b.c = i.c
), fold(curriculum_id, pos, seen, steps) AS (
  SELECT curriculum_id, 0, CAST([] AS VARCHAR[]), CAST([] AS VARCHAR[]) FROM way
  UNION ALL SELECT curriculum_id, pos, CASE WHEN again THEN seen ELSE list_distinct(list_concat(seen, own)) END,
    CASE WHEN again THEN steps ELSE list_append(steps, CASE WHEN len(own) = 1 THEN c ELSE '(' || array_to_string(list_transform(own, lambda x: CASE WHEN x = c THEN own[1] WHEN x = own[1] THEN c ELSE x END), '+') || ')' END) END
  FROM (
    SELECT f.curriculum_id, i.pos, i.c, f.seen, f.steps, list_contains(f.seen, i.c) AS again, list_sort(list_distinct(list_prepend(i.c, list_filter(i.near, lambda x: NOT list_contains(f.seen, x))))) AS own
    FROM fold AS f JOIN item AS i ON i.curriculum_id = f.curriculum_id AND i.pos = f.pos + 1
  ) AS x
), steps AS (SELECT f.curriculum_id, f.steps FROM fold AS f JOIN way AS w ON w.curriculum_id = f.curriculum_id AND f.pos = len(w.path))"""

ITEMS = """,
listed AS (
  SELECT curriculum_id, course_id, 'prereq' AS kind, 1 AS pos, CAST(same_prefix AS VARCHAR) AS item FROM spot WHERE same_prefix IS NOT NULL
  UNION ALL SELECT curriculum_id, course_id, 'prereq', 2, CAST(course_id - 3 AS VARCHAR) FROM spot WHERE course_id > 3 AND course_id % 5 = 0
  UNION ALL SELECT curriculum_id, course_id, 'prereq', 3, '9999' FROM spot WHERE course_id % 13 = 0
  UNION ALL SELECT curriculum_id, course_id, 'prereq', 4, words FROM spot WHERE course_id % 17 = 0 AND words IS NOT NULL
  UNION ALL SELECT curriculum_id, course_id, 'coreq', 1, CAST(course_id - 1 AS VARCHAR) FROM spot WHERE course_id > 1 AND course_id % 8 = 0
  UNION ALL SELECT curriculum_id, course_id, 'coreq', 2, '8888' FROM spot WHERE course_id % 19 = 0
  UNION ALL SELECT curriculum_id, course_id, 'strict', 1, CAST(course_id - 2 AS VARCHAR) FROM spot WHERE course_id > 2 AND course_id % 11 = 0
), items AS (
  SELECT curriculum_id, course_id, kind, row_number() OVER (PARTITION BY curriculum_id, course_id, kind ORDER BY pos) AS ord, item
  FROM (SELECT curriculum_id, course_id, kind, item, min(pos) AS pos FROM listed GROUP BY curriculum_id, course_id, kind, item) AS x
), required AS (
  SELECT i.curriculum_id, o.course_key, o.course_id, i.kind, i.ord, coalesce(c.course_key, replace(replace(i.item, ' (note)', ''), ' ', '')) AS required_key
  FROM items AS i JOIN course AS o ON o.curriculum_id = i.curriculum_id AND o.course_id = i.course_id
  LEFT JOIN course AS c ON c.curriculum_id = i.curriculum_id AND CAST(c.course_id AS VARCHAR) = i.item
  WHERE i.kind = 'prereq' OR c.course_id IS NOT NULL
)"""

TEXT = """,
listing AS (
  SELECT s.curriculum_id, s.course_id, s.name, s.prefix, s.number, s.credits,
         concat_ws('; ', CAST(same_prefix AS VARCHAR), CASE WHEN course_id > 3 AND course_id % 5 = 0 THEN CAST(course_id - 3 AS VARCHAR) END, CASE WHEN course_id % 13 = 0 THEN '9999' END, CASE WHEN course_id % 17 = 0 THEN words END) || CASE WHEN course_id % 7 = 0 THEN ' ;' ELSE '' END AS prereq_text,
         concat_ws(';', CASE WHEN course_id > 1 AND course_id % 8 = 0 THEN CAST(course_id - 1 AS VARCHAR) END, CASE WHEN course_id % 19 = 0 THEN '8888' END) AS coreq_text,
         CASE WHEN course_id > 2 AND course_id % 11 = 0 THEN CAST(course_id - 2 AS VARCHAR) ELSE '' END AS strict_text,
         CASE WHEN course_id % 4 = 0 THEN name END AS canonical_name
  FROM spot AS s
)"""

FLAGS = """,
flags AS (
  SELECT d.curriculum_id, d.course_id, d.course_key, d.credits, d.delay,
         EXISTS (SELECT 1 FROM kedge AS e WHERE e.kind = 'prereq' AND e.curriculum_id = d.curriculum_id AND e.dst = d.course_key) AS has_prereq,
         EXISTS (SELECT 1 FROM kedge AS e WHERE e.kind = 'prereq' AND e.curriculum_id = d.curriculum_id AND e.src = d.course_key) AS has_dependent
  FROM delays AS d
), priority AS (
  SELECT *, CAST(CASE WHEN NOT has_prereq AND has_dependent THEN delay * 10 + 100 WHEN has_dependent THEN delay * 5 ELSE delay END AS BIGINT) AS priority FROM flags
)"""

GROUPS = """,
tie AS (SELECT curriculum_id, src AS a, dst AS b FROM kedge WHERE kind = 'coreq' UNION SELECT curriculum_id, dst, src FROM kedge WHERE kind = 'coreq'),
joined(curriculum_id, a, b) AS (
  SELECT curriculum_id, course_key, course_key FROM course
  UNION SELECT j.curriculum_id, j.a, t.b FROM joined AS j JOIN tie AS t ON t.curriculum_id = j.curriculum_id AND t.a = j.b
), grouped AS (SELECT curriculum_id, a AS course_key, min(b) AS group_key FROM joined GROUP BY curriculum_id, a)"""

#: Schedules, told one step a row: the order of groups, their terms, then the moves of light courses. Groups are numbered with
#: the chained ones first, by rank; lists hold a curriculum's state by group number or term.
SCHEDULE = DELAYS + FLAGS + GROUPS + """,
grp AS (
  SELECT *, row_number() OVER (PARTITION BY curriculum_id ORDER BY chained DESC, CASE WHEN chained THEN -prio ELSE 0 END, group_key) AS g FROM (
    SELECT p.curriculum_id, group_key, max(priority) AS prio, sum(p.credits) AS credits, bool_or(has_prereq OR has_dependent) AS chained, bool_and(delay <= 1) AS light
    FROM priority AS p JOIN grouped AS o ON o.curriculum_id = p.curriculum_id AND o.course_key = p.course_key GROUP BY p.curriculum_id, group_key) AS x
), need AS (
  SELECT curriculum_id, g, list(DISTINCT p) AS needs FROM (
    SELECT e.curriculum_id, b.g, a.g AS p FROM kedge AS e JOIN grouped AS x ON x.curriculum_id = e.curriculum_id AND x.course_key = e.src JOIN grouped AS y ON y.curriculum_id = e.curriculum_id AND y.course_key = e.dst
    JOIN grp AS a ON a.curriculum_id = e.curriculum_id AND a.group_key = x.group_key JOIN grp AS b ON b.curriculum_id = e.curriculum_id AND b.group_key = y.group_key WHERE e.kind = 'prereq' AND a.g <> b.g) AS z GROUP BY curriculum_id, g
), job AS (
  SELECT r.curriculum_id, list(r.credits ORDER BY r.g) AS c, list(coalesce(n.needs, []) ORDER BY r.g) AS needs, list(r.light ORDER BY r.g) AS light, count(*) FILTER (r.chained) AS k, count(*) AS m,
    any_value(CASE WHEN system_type = 'quarter' THEN 12 ELSE 8 END) AS terms, 15.0::DOUBLE AS target, any_value(CASE WHEN system_type = 'quarter' THEN 19.0 ELSE 21.0 END)::DOUBLE AS most
  FROM grp AS r JOIN curriculum AS u ON u.curriculum_id = r.curriculum_id LEFT JOIN need AS n ON n.curriculum_id = r.curriculum_id AND n.g = r.g GROUP BY r.curriculum_id
), kahn(curriculum_id, done) AS (
  SELECT curriculum_id, CAST([] AS BIGINT[]) FROM job
  UNION ALL SELECT curriculum_id, list_append(done, free) FROM (
    SELECT q.curriculum_id, q.done, list_filter(range(1, j.k + 1), lambda i: NOT list_contains(q.done, i) AND len(list_filter(j.needs[i], lambda p: NOT list_contains(q.done, p))) = 0)[1] AS free
    FROM kahn AS q JOIN job AS j ON j.curriculum_id = q.curriculum_id) AS x WHERE free IS NOT NULL
), line AS (
  SELECT j.*, list_concat(CASE WHEN len(q.done) = j.k THEN q.done ELSE range(1, j.k + 1) END, range(j.k + 1, j.m + 1)) AS line
  FROM job AS j JOIN (SELECT curriculum_id, arg_max(done, len(done)) AS done FROM kahn GROUP BY curriculum_id) AS q ON q.curriculum_id = j.curriculum_id
), berth(curriculum_id, n, tm, held) AS (
  SELECT curriculum_id, 0, list_transform(range(0, m), lambda i: CAST(0 AS BIGINT)), list_transform(range(0, terms), lambda i: 0.0::DOUBLE) FROM line
  UNION ALL SELECT curriculum_id, n, list_transform(tm, lambda v, i: CASE WHEN i = g THEN t ELSE v END), list_transform(range(1, greatest(len(held), t) + 1), lambda i: coalesce(held[i], 0.0) + CASE WHEN i = t THEN cr ELSE 0.0 END)
  FROM (
    SELECT *, CASE WHEN g <= k THEN coalesce(
        list_filter(range(start, len(held) + 1), lambda t: held[t] + cr <= target)[1], list_filter(range(start, len(held) + 1), lambda t: held[t] + cr <= most)[1], len(held) + 1)
      ELSE coalesce(list_sort(list_transform(list_filter(range(1, len(held) + 1), lambda t: held[t] + cr <= most), lambda t: {'l': held[t], 't': t}))[1].t, len(held) + 1) END AS t
    FROM (
      SELECT s.curriculum_id, s.n + 1 AS n, s.tm, l.k, l.target, l.most, l.line[s.n + 1] AS g, l.c[l.line[s.n + 1]] AS cr, 1 + coalesce(list_max(list_transform(l.needs[l.line[s.n + 1]], lambda p: s.tm[p])), 0) AS start,
        CASE WHEN l.line[s.n + 1] <= l.k AND len(s.held) < 1 + coalesce(list_max(list_transform(l.needs[l.line[s.n + 1]], lambda p: s.tm[p])), 0) THEN list_resize(s.held, 1 + list_max(list_transform(l.needs[l.line[s.n + 1]], lambda p: s.tm[p])), 0.0::DOUBLE) ELSE s.held END AS held
      FROM berth AS s JOIN line AS l ON l.curriculum_id = s.curriculum_id WHERE s.n < l.m) AS x) AS y
), placed AS (
  SELECT s.curriculum_id, s.tm, s.held, list_transform(range(1, l.m + 1), lambda g: list_position(l.line, g)) AS seq, l.m, l.c, l.light, l.target FROM berth AS s JOIN line AS l ON l.curriculum_id = s.curriculum_id AND s.n = l.m
), move(curriculum_id, n, pass, i, j, heavy, easy, own, tm, held, seq, top) AS (
  SELECT curriculum_id, 0, 0, 1, 1, CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT[]), tm, held, seq, m FROM placed
  UNION ALL SELECT curriculum_id, n + 1,
    CASE WHEN turn THEN pass + 1 ELSE pass END, CASE WHEN turn THEN 1 WHEN opens OR tries THEN i ELSE i + 1 END, CASE WHEN tries THEN j + 1 ELSE 1 END,
    CASE WHEN turn THEN list_filter(range(1, len(held) + 1), lambda t: held[t] > target + 3) ELSE heavy END,
    CASE WHEN turn THEN list_filter(range(1, len(held) + 1), lambda t: held[t] < target - 3 AND list_contains(tm, t)) ELSE easy END,
    CASE WHEN opens THEN list_transform(list_sort(list_transform(list_filter(range(1, m + 1), lambda g: light[g] AND tm[g] = heavy[i]), lambda g: {'s': seq[g], 'g': g})), lambda x: x.g) WHEN tries THEN own END,
    CASE WHEN goes IS NULL THEN tm ELSE list_transform(tm, lambda v, g: CASE WHEN g = own[j] THEN goes ELSE v END) END,
    CASE WHEN goes IS NULL THEN held ELSE list_transform(held, lambda v, t: v + CASE WHEN t = goes THEN c[own[j]] WHEN t = heavy[i] THEN -c[own[j]] ELSE 0.0 END) END,
    CASE WHEN goes IS NULL THEN seq ELSE list_transform(seq, lambda v, g: CASE WHEN g = own[j] THEN top + 1 ELSE v END) END, CASE WHEN goes IS NULL THEN top ELSE top + 1 END
  FROM (
    SELECT *, CASE WHEN tries THEN list_filter(easy, lambda u: u <> heavy[i] AND held[u] + c[own[j]] <= target + 1 AND held[heavy[i]] - c[own[j]] >= target - 3)[1] END AS goes
    FROM (
      SELECT v.*, p.m, p.c, p.light, p.target, i > len(heavy) OR len(easy) = 0 AS turn, i <= len(heavy) AND len(easy) > 0 AND own IS NULL AS opens, i <= len(heavy) AND len(easy) > 0 AND own IS NOT NULL AND j <= len(own) AS tries
      FROM move AS v JOIN placed AS p ON p.curriculum_id = v.curriculum_id) AS x
    WHERE NOT (pass = 3 AND turn)) AS y
), settled AS (SELECT curriculum_id, arg_max(tm, n) AS tm, arg_max(seq, n) AS seq FROM move GROUP BY curriculum_id),
schedule AS (
  SELECT o.curriculum_id, CAST(s.tm[r.g] AS INTEGER) AS term, CAST(row_number() OVER (PARTITION BY o.curriculum_id, s.tm[r.g] ORDER BY s.seq[r.g], o.course_key) AS INTEGER) AS pos, o.course_key, p.credits, o.group_key
  FROM grouped AS o JOIN grp AS r ON r.curriculum_id = o.curriculum_id AND r.group_key = o.group_key JOIN settled AS s ON s.curriculum_id = o.curriculum_id JOIN priority AS p ON p.curriculum_id = o.curriculum_id AND p.course_key = o.course_key
)"""


def sql(select: str, *parts: str) -> str:
    return f"WITH RECURSIVE {BASE}{''.join(parts)}\n{select}"


HEADER = "Course ID,Course Name,Prefix,Number,Prerequisites,Corequisites,Strict-Corequisites,Credit Hours,Institution,Canonical Name"
LABEL = "course_key || '<br/>' || CASE WHEN length(name) > 20 THEN substr(name, 1, 17) || '...' ELSE name END || '<br/>C:' || complexity"
EXPECTED = """, expected AS (
  SELECT curriculum_id, course_id, complexity + CASE WHEN course_id % 50 = 0 THEN 1 ELSE 0 END AS complexity, blocking + CASE WHEN course_id % 70 = 0 THEN 1 ELSE 0 END AS blocking,
         delay + CASE WHEN course_id % 60 = 0 THEN 1 ELSE 0 END AS delay, centrality + CASE WHEN course_id % 40 = 0 THEN 1 ELSE 0 END AS centrality FROM metrics
), different AS (
  SELECT e.curriculum_id, e.course_id, 'complexity' AS field FROM expected AS e JOIN metrics AS m USING (curriculum_id, course_id) WHERE e.complexity <> m.complexity
  UNION ALL SELECT e.curriculum_id, e.course_id, 'blocking' FROM expected AS e JOIN metrics AS m USING (curriculum_id, course_id) WHERE e.blocking <> m.blocking
  UNION ALL SELECT e.curriculum_id, e.course_id, 'delay' FROM expected AS e JOIN metrics AS m USING (curriculum_id, course_id) WHERE e.delay <> m.delay
  UNION ALL SELECT e.curriculum_id, e.course_id, 'centrality' FROM expected AS e JOIN metrics AS m USING (curriculum_id, course_id) WHERE e.centrality <> m.centrality
  UNION ALL SELECT curriculum_id, 100000, 'missing' FROM metrics WHERE course_id = 1 AND curriculum_id % 10 = 0
)"""
SUMMARY = """SELECT curriculum_id, CAST(sum(complexity) AS BIGINT) AS total_complexity, max(centrality) AS highest_centrality, max(CASE WHEN rc = 1 AND centrality > 0 THEN course_key ELSE '' END) AS highest_centrality_course,
  max(delay) AS longest_delay, max(CASE WHEN rd = 1 THEN course_key ELSE '' END) AS longest_delay_course
FROM (SELECT *, row_number() OVER (PARTITION BY curriculum_id ORDER BY centrality DESC, course_id) AS rc, row_number() OVER (PARTITION BY curriculum_id ORDER BY delay DESC, course_id) AS rd FROM metrics) AS x GROUP BY curriculum_id"""
SCALED = "round(m.complexity * CASE WHEN system_type = 'quarter' THEN 2.0 / 3.0 ELSE 1.0 END, 1)"
NOT_NULL_LISTS = ", ".join(f"coalesce(string_agg(CASE WHEN kind = '{k}' THEN coalesce(CAST(back_id AS VARCHAR), required_key) END, ';' ORDER BY ord), '') AS {n}" for k, n in (("prereq", "prereq_ids"), ("coreq", "coreq_ids"), ("strict", "strict_ids")))

SQL: dict[str, str] = {
    "parse_lines": sql(
        f"""SELECT curriculum_id, pos, line FROM (
  SELECT curriculum_id, CAST(h.pos AS BIGINT) AS pos, CASE h.pos WHEN 0 THEN chr(65279) || 'Curriculum,' || name || ',,,' WHEN 1 THEN CASE WHEN curriculum_id % 2 = 0 THEN 'Institution,' ELSE 'Insitution,' END || institution
    WHEN 2 THEN '"Degree Type",' || degree_type WHEN 3 THEN 'System Type,' || system_type WHEN 4 THEN 'Year,2020' WHEN 5 THEN 'CIP,' || cip_code WHEN 6 THEN 'Courses,,,' ELSE '{HEADER}' END AS line
  FROM curriculum CROSS JOIN (VALUES (0), (1), (2), (3), (4), (5), (6), (7)) AS h(pos)
  UNION ALL SELECT curriculum_id, course_id + 7, course_id || ', "' || name || '" ,' || prefix || ',' || number || ',' || prereq_text || ',' || coreq_text || ',' || strict_text || ',' || CAST(CAST(credits AS BIGINT) AS VARCHAR) || ',,' || coalesce(canonical_name, '')
  FROM listing) AS x""",
        TEXT,
    ),
    "parse_metadata": sql("SELECT curriculum_id, name, institution, degree_type, system_type, cip_code FROM curriculum"),
    "parse_sections": sql(f"SELECT curriculum_id, CAST(6 AS BIGINT) AS marker_pos, '{HEADER}' AS header FROM curriculum"),
    "parse_courses": sql("SELECT curriculum_id, CAST(course_id AS VARCHAR) AS course_id, name, prefix, number, trim(prereq_text) AS prereq_text, coreq_text, strict_text, credits, canonical_name FROM listing", TEXT),
    "export_rows": sql(
        f"""SELECT m.curriculum_id, m.course_id AS place, CAST(m.course_id AS VARCHAR) AS course_id, m.name, c.prefix, c.number, coalesce(prereq_ids, '') AS prereq_ids, coalesce(coreq_ids, '') AS coreq_ids, coalesce(strict_ids, '') AS strict_ids,
  CAST(CAST(m.credits AS BIGINT) AS VARCHAR) AS credits, institution, CASE WHEN m.course_id % 4 = 0 THEN m.name ELSE '' END AS canonical_name, printf('%.1f', CAST({SCALED} AS DOUBLE)) AS complexity, blocking, delay, centrality
FROM metrics AS m JOIN course AS c USING (curriculum_id, course_id) JOIN curriculum AS k USING (curriculum_id)
LEFT JOIN (SELECT curriculum_id, course_id, {NOT_NULL_LISTS} FROM (SELECT q.*, b.course_id AS back_id FROM required AS q LEFT JOIN course AS b ON b.curriculum_id = q.curriculum_id AND b.course_key = q.required_key) AS back GROUP BY curriculum_id, course_id) AS r USING (curriculum_id, course_id)""",
        METRICS,
        ITEMS,
    ),
    "clean_fields": sql("SELECT curriculum_id, course_id, name AS first_field, 'x ' || prefix AS second_field FROM course"),
    "natural_keys": sql("SELECT curriculum_id, course_id, natural_key FROM course"),
    "normalize_keys": sql("SELECT curriculum_id, course_id, CASE WHEN course_id % 2 = 0 THEN natural_key ELSE prefix END AS normalized FROM course"),
    "explode_requisites": sql("SELECT curriculum_id, course_id, kind, ord, item FROM items", ITEMS),
    "degree_dim": sql("SELECT curriculum_id, degree_type || ' ' || name AS degree_id, system_type = 'quarter' AS is_quarter, CAST(CASE WHEN system_type = 'quarter' THEN 2.0 / 3.0 ELSE 1.0 END AS DOUBLE) AS scale FROM curriculum"),
    "scaled_complexity": sql(f"SELECT m.curriculum_id, CAST(sum(m.complexity) AS BIGINT) AS total_complexity, CAST(round(sum({SCALED}), 1) AS DOUBLE) AS scaled_total FROM metrics AS m JOIN curriculum AS k ON k.curriculum_id = m.curriculum_id GROUP BY m.curriculum_id", METRICS),
    "complexity_bands": sql("SELECT curriculum_id, course_key, complexity, CASE WHEN complexity <= 5 THEN 'low' WHEN complexity <= 15 THEN 'medium' ELSE 'high' END AS band FROM metrics", METRICS),
    "node_labels": sql(f"SELECT curriculum_id, course_key, replace(course_key, '#', '_') AS node_id, {LABEL} AS label FROM metrics", METRICS),
    "lookup_natural_key": sql("SELECT curriculum_id, natural_key, course_key FROM (SELECT *, row_number() OVER (PARTITION BY curriculum_id, natural_key ORDER BY course_id) AS r FROM course) AS x WHERE r = 1"),
    "lookup_course": sql("SELECT curriculum_id, course_key, true AS contained, name FROM course WHERE course_id % 5 = 0 UNION ALL SELECT curriculum_id, course_key || '?', false, NULL FROM course WHERE course_id % 10 = 0"),
    "lookup_course_by_natural_key": sql(
        """SELECT w.curriculum_id, w.natural_key, f.course_key IS NOT NULL AS contained, f.course_key, f.name
FROM (SELECT DISTINCT curriculum_id, natural_key FROM course WHERE course_id % 5 = 0 UNION SELECT curriculum_id, natural_key || '?' FROM course WHERE course_id % 10 = 0) AS w
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY curriculum_id, natural_key ORDER BY course_id) AS r FROM course) AS f ON f.curriculum_id = w.curriculum_id AND f.natural_key = w.natural_key AND f.r = 1"""
    ),
    "lookup_degree": sql("SELECT degree_type || ' ' || name AS degree_id, curriculum_id, degree_type, system_type, cip_code FROM curriculum WHERE curriculum_id % 3 = 0 UNION ALL SELECT degree_type || ' ' || name || '?', NULL, NULL, NULL, NULL FROM curriculum WHERE curriculum_id % 9 = 0"),
    "neighbour_lists": sql(
        """SELECT c.curriculum_id, c.course_key, coalesce(p, '') AS prerequisites, coalesce(d, '') AS dependents, coalesce(q, '') AS corequisites, coalesce(t, '') AS coreq_dependents FROM course AS c
LEFT JOIN (SELECT curriculum_id, dst AS course_key, string_agg(CASE WHEN kind = 'prereq' THEN src END, ',' ORDER BY ord, src) AS p, string_agg(CASE WHEN kind = 'coreq' THEN src END, ',' ORDER BY ord, src) AS q FROM kedge GROUP BY curriculum_id, dst) AS a ON a.curriculum_id = c.curriculum_id AND a.course_key = c.course_key
LEFT JOIN (SELECT curriculum_id, src AS course_key, string_agg(CASE WHEN kind = 'prereq' THEN dst END, ',' ORDER BY dst) AS d, string_agg(CASE WHEN kind = 'coreq' THEN dst END, ',' ORDER BY dst) AS t FROM kedge GROUP BY curriculum_id, src) AS b ON b.curriculum_id = c.curriculum_id AND b.course_key = c.course_key"""
    ),
    "dag_listing": sql(
        """SELECT c.curriculum_id, c.course_key, c.course_key || ' → ' || CASE WHEN p IS NULL AND q IS NULL THEN '(no prerequisites or corequisites)' ELSE concat_ws(' | ', 'prereq: ' || p, 'coreq: ' || q) END AS line FROM course AS c
LEFT JOIN (SELECT curriculum_id, dst AS course_key, string_agg(CASE WHEN kind = 'prereq' THEN src END, ', ' ORDER BY ord, src) AS p, string_agg(CASE WHEN kind = 'coreq' THEN src END, ', ' ORDER BY ord, src) AS q FROM kedge GROUP BY curriculum_id, dst) AS a ON a.curriculum_id = c.curriculum_id AND a.course_key = c.course_key"""
    ),
    "storage_keys": sql("SELECT curriculum_id, course_id, natural_key, course_key FROM course"),
    "duplicate_ids": sql(
        """SELECT r.curriculum_id, CAST(r.course_id AS VARCHAR) AS course_id, r.course_id AS plan_pos, r.name, r.nk AS natural_key, CASE WHEN n > 1 THEN r.nk || '_' || r.course_id ELSE r.nk END AS course_key
FROM (SELECT curriculum_id, course_id, CASE WHEN course_id % 10 = 0 THEN upper(name) ELSE name END AS name, CASE WHEN course_id % 10 = 0 THEN natural_key || 'X' ELSE natural_key END AS nk FROM course) AS r
JOIN (SELECT curriculum_id, nk, count(*) AS n FROM (SELECT curriculum_id, natural_key AS nk FROM course UNION ALL SELECT curriculum_id, natural_key || 'X' FROM course WHERE course_id % 10 = 0) AS y GROUP BY curriculum_id, nk) AS k ON k.curriculum_id = r.curriculum_id AND k.nk = r.nk"""
    ),
    "resolve_prereqs": sql("SELECT curriculum_id, course_key, ord, required_key FROM required WHERE kind = 'prereq'", ITEMS),
    "resolve_coreqs": sql("SELECT curriculum_id, course_key, kind, ord, required_key FROM required WHERE kind <> 'prereq'", ITEMS),
    "build_edges": sql("SELECT DISTINCT curriculum_id, required_key AS src, course_key AS dst, CASE WHEN kind = 'prereq' THEN 'prereq' ELSE 'coreq' END AS kind FROM required AS r WHERE EXISTS (SELECT 1 FROM course AS c WHERE c.curriculum_id = r.curriculum_id AND c.course_key = r.required_key)", ITEMS),
    "requisite_edges": sql("SELECT DISTINCT curriculum_id, src, dst FROM kedge"),
    "degrees": sql("SELECT c.curriculum_id, c.course_key, coalesce(i, 0) AS indegree, coalesce(o, 0) AS outdegree FROM course AS c LEFT JOIN (SELECT curriculum_id, dst, count(*) AS i FROM req GROUP BY curriculum_id, dst) AS a ON a.curriculum_id = c.curriculum_id AND a.dst = c.course_id LEFT JOIN (SELECT curriculum_id, src, count(*) AS o FROM req GROUP BY curriculum_id, src) AS b ON b.curriculum_id = c.curriculum_id AND b.src = c.course_id"),
    "sources_sinks": sql("SELECT * FROM (SELECT c.curriculum_id, c.course_key, NOT EXISTS (SELECT 1 FROM req AS r WHERE r.curriculum_id = c.curriculum_id AND r.dst = c.course_id) AS is_source, NOT EXISTS (SELECT 1 FROM req AS r WHERE r.curriculum_id = c.curriculum_id AND r.src = c.course_id) AS is_sink FROM course AS c) AS x WHERE is_source OR is_sink"),
    "validate_plans": sql("SELECT curriculum_id, 'plan0' AS plan_id, 'Plan ''plan0'': missing course ''' || course_key || '?''' AS message FROM course WHERE course_id % 50 = 0"),
    "validate_requisites": sql("SELECT curriculum_id, course_key, kind, 'Course ''' || (SELECT natural_key FROM course AS n WHERE n.curriculum_id = r.curriculum_id AND n.course_key = r.course_key) || ''': missing ' || CASE WHEN kind = 'prereq' THEN 'prerequisite' ELSE 'corequisite' END || ' ''' || required_key || '''' AS message FROM required AS r WHERE kind <> 'strict' AND NOT EXISTS (SELECT 1 FROM course AS c WHERE c.curriculum_id = r.curriculum_id AND c.course_key = r.required_key)", ITEMS),
    "plans_for_degree": sql("SELECT degree_type || ' ' || k.name AS degree_id, k.curriculum_id, plan_id FROM curriculum AS k JOIN (SELECT DISTINCT curriculum_id, 'plan' || (course_id % 2) AS plan_id FROM course) AS p ON p.curriculum_id = k.curriculum_id WHERE system_type = 'quarter'"),
    "plan_edit": sql("SELECT curriculum_id, course_key, CASE WHEN course_id % 2 = 1 THEN course_id ELSE course_id + 1000 END AS pos FROM course WHERE (course_id % 2 = 1 OR course_id % 3 = 0) AND course_id % 4 <> 1"),
    "course_upsert": sql("SELECT curriculum_id, course_key, credits + CASE WHEN course_id % 6 = 0 THEN 1 ELSE 0 END AS credits, course_id + CASE WHEN course_id % 6 = 0 THEN 1000 ELSE 0 END AS seq, course_id % 6 = 0 AS replaced FROM course"),
    "plan_edges": sql("SELECT curriculum_id, src AS \"from\", dst AS \"to\", kind = 'coreq' AS dashes FROM kedge"),
    "compare_metrics": sql("SELECT curriculum_id, course_id, field FROM different", METRICS, EXPECTED),
    "compare_summary": sql("SELECT count(*) AS curricula, count(*) FILTER (WHERE NOT bad) AS passed, count(*) FILTER (WHERE bad) AS failed FROM (SELECT DISTINCT curriculum_id, curriculum_id IN (SELECT curriculum_id FROM different) OR curriculum_id % 9 = 0 AS bad FROM course) AS x", METRICS, EXPECTED),
    "compare_totals": sql(f"SELECT m.curriculum_id, CAST(round(sum({SCALED}) + 1, 1) AS DOUBLE) AS expected_total, CAST(round(sum({SCALED}), 1) AS DOUBLE) AS found_total FROM metrics AS m JOIN curriculum AS k ON k.curriculum_id = m.curriculum_id WHERE m.curriculum_id % 9 = 0 GROUP BY m.curriculum_id", METRICS),
    "curriculum_summary": sql(SUMMARY, METRICS),
    "metrics_ranked": sql("SELECT curriculum_id, row_number() OVER (PARTITION BY curriculum_id ORDER BY complexity DESC, course_id) AS place, course_key, complexity, blocking, delay, centrality FROM metrics", METRICS),
    "max_delay_courses": sql("SELECT d.curriculum_id, d.course_key, CAST(d.delay AS BIGINT) AS delay FROM delays AS d JOIN (SELECT curriculum_id, max(delay) AS delay FROM delays GROUP BY curriculum_id) AS l ON l.curriculum_id = d.curriculum_id AND l.delay = d.delay", DELAYS),
    "coreq_group_priority": sql("SELECT p.curriculum_id, group_key, max(priority) AS group_priority, sum(credits) AS group_credits, count(*) AS members FROM priority AS p JOIN grouped AS g ON g.curriculum_id = p.curriculum_id AND g.course_key = p.course_key GROUP BY p.curriculum_id, group_key", DELAYS, FLAGS, GROUPS),
    "delay": sql("SELECT curriculum_id, course_key, CAST(delay AS BIGINT) AS delay FROM delays", DELAYS),
    "blocking": sql("SELECT curriculum_id, course_key, blocking FROM metrics", METRICS),
    "complexity": sql("SELECT curriculum_id, course_key, complexity FROM metrics", METRICS),
    "centrality": sql("SELECT curriculum_id, course_key, CAST(centrality AS BIGINT) AS centrality FROM delays", DELAYS),
    "course_metrics": sql("SELECT curriculum_id, course_key, delay, blocking, complexity, centrality FROM metrics", METRICS),
    "cycles": sql(
        """, pair AS (SELECT curriculum_id, src, dst FROM req UNION SELECT curriculum_id, 1, 2 FROM course WHERE course_id = 2 AND curriculum_id % 97 = 0 UNION SELECT curriculum_id, 2, 1 FROM course WHERE course_id = 2 AND curriculum_id % 97 = 0),
walk(curriculum_id, src, dst) AS (SELECT curriculum_id, src, dst FROM pair UNION SELECT w.curriculum_id, w.src, p.dst FROM walk AS w JOIN pair AS p ON p.curriculum_id = w.curriculum_id AND p.src = w.dst)
SELECT DISTINCT curriculum_id FROM walk WHERE src = dst"""
    ),
    "topo_levels": sql("SELECT curriculum_id, course_key, CAST(a AS BIGINT) AS level FROM delays", DELAYS),
    "course_chains": sql(
        """, chain AS (SELECT curriculum_id, src AS course_id, dst AS member FROM reach UNION SELECT curriculum_id, dst, src FROM reach UNION SELECT curriculum_id, course_id, course_id FROM course),
co AS (SELECT curriculum_id, src AS a, dst AS b FROM edge WHERE kind <> 'prereq' UNION SELECT curriculum_id, dst, src FROM edge WHERE kind <> 'prereq')
SELECT curriculum_id, course_id, member FROM chain UNION SELECT c.curriculum_id, c.course_id, co.b FROM chain AS c JOIN co ON co.curriculum_id = c.curriculum_id AND co.a = c.member""",
        REACH,
    ),
    "transitive_prereqs": sql(", above(curriculum_id, src, dst) AS (SELECT DISTINCT curriculum_id, src, dst FROM edge WHERE kind = 'prereq' UNION SELECT x.curriculum_id, x.src, e.dst FROM above AS x JOIN edge AS e ON e.curriculum_id = x.curriculum_id AND e.src = x.dst AND e.kind = 'prereq')\nSELECT curriculum_id, dst AS course_id, src AS requires FROM above"),
    "best_prereq": sql("SELECT curriculum_id, course_key, best FROM best", BEST),
    "delay_paths": sql("SELECT curriculum_id, course_key, path FROM traced", TRACES),
    "longest_delay_path": sql("SELECT curriculum_id, path FROM (SELECT *, row_number() OVER (PARTITION BY curriculum_id ORDER BY n DESC, pos) AS q FROM traced) AS x WHERE q = 1", TRACES),
    "critical_path": sql(
        """, before AS (
  SELECT r.curriculum_id, r.dst, min(r.src) AS src FROM req AS r JOIN delays AS x ON x.curriculum_id = r.curriculum_id AND x.course_id = r.src JOIN delays AS y ON y.curriculum_id = r.curriculum_id AND y.course_id = r.dst
  WHERE x.a = y.a - 1 GROUP BY r.curriculum_id, r.dst
), way(curriculum_id, v, path, length) AS (
  SELECT curriculum_id, course_id, course_key, 1 FROM (SELECT *, row_number() OVER (PARTITION BY curriculum_id ORDER BY a DESC, course_id) AS r FROM delays) AS x WHERE r = 1
  UNION ALL SELECT w.curriculum_id, b.src, c.course_key || '->' || w.path, w.length + 1 FROM way AS w JOIN before AS b ON b.curriculum_id = w.curriculum_id AND b.dst = w.v JOIN course AS c ON c.curriculum_id = b.curriculum_id AND c.course_id = b.src
)
SELECT w.curriculum_id, CAST(w.length AS BIGINT) AS length, w.path FROM way AS w JOIN (SELECT curriculum_id, max(delay) AS delay FROM delays GROUP BY curriculum_id) AS m ON m.curriculum_id = w.curriculum_id AND m.delay = w.length""",
        DELAYS,
    ),
    "plan_edges_json": sql(
        """SELECT c.curriculum_id, coalesce('[' || edges || ']', '[]') AS edges_json FROM (SELECT DISTINCT curriculum_id FROM course) AS c
LEFT JOIN (SELECT curriculum_id, string_agg('{"from":"' || src || '","to":"' || dst || '","dashes":' || CASE WHEN kind = 'coreq' THEN 'true' ELSE 'false' END || '}', ',' ORDER BY CASE WHEN kind = 'prereq' THEN 0 ELSE 1 END, dst_pos, ord, src) AS edges FROM kedge GROUP BY curriculum_id) AS e ON e.curriculum_id = c.curriculum_id"""
    ),
    "longest_delay_path_grouped": sql("SELECT curriculum_id, array_to_string(steps, '->') AS path FROM steps", STEPS),
    "critical_path_ids": sql("SELECT curriculum_id, step, unnest(string_split(trim(one, '()'), '+')) AS course_key FROM (SELECT curriculum_id, CAST(generate_subscripts(steps, 1) - 1 AS BIGINT) AS step, unnest(steps) AS one FROM steps) AS x", STEPS),
    "chain_priority": sql("SELECT curriculum_id, course_key, priority FROM priority", DELAYS, FLAGS),
    "coreq_groups": sql("SELECT curriculum_id, course_key, group_key FROM grouped", GROUPS),
    "filler_groups": sql("SELECT p.curriculum_id, group_key, count(*) AS members FROM priority AS p JOIN grouped AS g ON g.curriculum_id = p.curriculum_id AND g.course_key = p.course_key GROUP BY p.curriculum_id, group_key HAVING bool_and(NOT has_prereq AND NOT has_dependent)", DELAYS, FLAGS, GROUPS),
    "mermaid_dag": sql(
        f"""SELECT n.curriculum_id, '```mermaid' || chr(10) || 'flowchart LR' || chr(10) || nodes || chr(10) || chr(10) || coalesce(links || chr(10), '') || '```' || chr(10) AS body
FROM (SELECT curriculum_id, string_agg('    ' || replace(course_key, '#', '_') || '["' || {LABEL} || '"]', chr(10) ORDER BY course_id) AS nodes FROM metrics GROUP BY curriculum_id) AS n
LEFT JOIN (SELECT curriculum_id, string_agg('    ' || replace(src, '#', '_') || CASE WHEN kind = 'prereq' THEN ' --> ' ELSE ' -.-> ' END || replace(dst, '#', '_'), chr(10) ORDER BY CASE WHEN kind = 'prereq' THEN 0 ELSE 1 END, dst_pos, ord, src) AS links FROM kedge GROUP BY curriculum_id) AS l ON l.curriculum_id = n.curriculum_id""",
        METRICS,
    ),
}

SQL["export_text"] = sql(
    f"""SELECT k.curriculum_id, concat_ws(chr(10), 'Curriculum,' || k.name, 'Institution,' || k.institution, 'Degree Type,"' || degree_type || '"', 'System Type,' || system_type, 'CIP,"' || cip_code || '"',
  'Total Structural Complexity,' || printf('%.1f', t.scaled_total), 'Longest Delay,' || s.longest_delay || ',' || array_to_string(g.steps, '->'), 'Highest Centrality Course,"' || s.highest_centrality_course || '",' || s.highest_centrality,
  'Courses', '{HEADER},Complexity,Blocking,Delay,Centrality', e.lines) AS body
FROM curriculum AS k JOIN steps AS g ON g.curriculum_id = k.curriculum_id JOIN ({SUMMARY}) AS s ON s.curriculum_id = k.curriculum_id
JOIN (SELECT m.curriculum_id, round(sum({SCALED}), 1) AS scaled_total FROM metrics AS m JOIN curriculum AS c ON c.curriculum_id = m.curriculum_id GROUP BY m.curriculum_id) AS t ON t.curriculum_id = k.curriculum_id
JOIN (SELECT curriculum_id, string_agg(concat_ws(',', course_id, name, '"' || prefix || '"', '"' || number || '"', '"' || prereq_ids || '"', '"' || coreq_ids || '"', '"' || strict_ids || '"', credits, '"' || institution || '"', '"' || canonical_name || '"', complexity, blocking, delay, centrality), chr(10) ORDER BY place) AS lines
  FROM ({SQL["export_rows"][SQL["export_rows"].rindex("SELECT m.curriculum_id, m.course_id AS place") :]}) AS x GROUP BY curriculum_id) AS e ON e.curriculum_id = k.curriculum_id""",
    METRICS,
    ITEMS,
    STEPS.removeprefix(PATHS),
)

#: Everything that reports are made of.
REPORT = METRICS + STEPS.removeprefix(PATHS) + SCHEDULE.removeprefix(DELAYS) + f""",
header AS (
  SELECT k.curriculum_id, k.name AS plan_name, institution, degree_type || ' ' || k.name AS degree_name, system_type, CAST(ceil(u.used / CASE WHEN system_type = 'quarter' THEN 3.0 ELSE 2.0 END) AS BIGINT) AS years, cip_code,
    printf('%.1f', t.credits) AS total_credits, t.n AS course_count, s.total_complexity, s.longest_delay, s.longest_delay_course, s.highest_centrality, s.highest_centrality_course, array_to_string(g.steps, ' → ') AS delay_path
  FROM curriculum AS k JOIN (SELECT curriculum_id, sum(credits) AS credits, count(*) AS n FROM course GROUP BY curriculum_id) AS t ON t.curriculum_id = k.curriculum_id JOIN ({SUMMARY}) AS s ON s.curriculum_id = k.curriculum_id
  JOIN steps AS g ON g.curriculum_id = k.curriculum_id JOIN (SELECT curriculum_id, count(DISTINCT term) AS used FROM schedule GROUP BY curriculum_id) AS u ON u.curriculum_id = k.curriculum_id
), term_row AS (
  SELECT s.curriculum_id, s.term, string_agg(s.course_key || ' - ' || c.name, ', ' ORDER BY s.pos) AS courses, printf('%.1f', sum(s.credits)) AS credits FROM schedule AS s JOIN course AS c ON c.curriculum_id = s.curriculum_id AND c.course_key = s.course_key GROUP BY s.curriculum_id, s.term
), span AS (
  SELECT k.curriculum_id, CASE WHEN system_type = 'quarter' THEN 'Quarter' ELSE 'Semester' END AS label, greatest(max(term), CASE WHEN system_type = 'quarter' THEN 12 ELSE 8 END) AS terms
  FROM curriculum AS k JOIN schedule AS s ON s.curriculum_id = k.curriculum_id GROUP BY k.curriculum_id, system_type
), node AS (
  SELECT curriculum_id, term, string_agg('        ' || replace(course_key, '#', '_') || '["' || label || '"]', chr(10) ORDER BY pos) AS nodes FROM (
    SELECT s.curriculum_id, s.term, s.pos, m.course_key, {LABEL.replace("course_key", "m.course_key")} AS label FROM schedule AS s JOIN metrics AS m ON m.curriculum_id = s.curriculum_id AND m.course_key = s.course_key) AS x GROUP BY curriculum_id, term
), diagram AS (
  SELECT b.curriculum_id, '```mermaid' || chr(10) || 'flowchart LR' || chr(10) || blocks || list_aggregate(list_transform(range(1, b.terms), lambda i: '    term' || i || ' ~~~ term' || (i + 1) || chr(10)), 'string_agg', '') || chr(10) || coalesce(links || chr(10), '') || '```' || chr(10) AS body
  FROM (
    SELECT e.curriculum_id, any_value(e.terms) AS terms, string_agg('    subgraph term' || e.term || '["' || e.label || ' ' || e.term || '"]' || chr(10) || coalesce(n.nodes, '        empty' || e.term || '[" "]' || chr(10) || '        style empty' || e.term || ' fill:none,stroke:none') || chr(10) || '    end' || chr(10) || chr(10), '' ORDER BY e.term) AS blocks
    FROM (SELECT curriculum_id, label, terms, unnest(range(1, terms + 1)) AS term FROM span) AS e LEFT JOIN node AS n ON n.curriculum_id = e.curriculum_id AND n.term = e.term GROUP BY e.curriculum_id) AS b
  LEFT JOIN (SELECT curriculum_id, string_agg('    ' || replace(src, '#', '_') || CASE WHEN kind = 'prereq' THEN ' --> ' ELSE ' -.-> ' END || replace(dst, '#', '_'), chr(10) ORDER BY CASE WHEN kind = 'prereq' THEN 0 ELSE 1 END, dst_pos, ord, src) AS links FROM kedge GROUP BY curriculum_id) AS l ON l.curriculum_id = b.curriculum_id
)"""

SQL |= {
    "schedule_violations": sql(
        """SELECT e.curriculum_id, 'prerequisite not earlier' AS problem, CASE WHEN a.group_key = b.group_key THEN 'own group' ELSE 'order of groups' END AS reason, e.dst AS course_key
FROM kedge AS e JOIN schedule AS a ON a.curriculum_id = e.curriculum_id AND a.course_key = e.src JOIN schedule AS b ON b.curriculum_id = e.curriculum_id AND b.course_key = e.dst WHERE e.kind = 'prereq' AND a.term >= b.term
UNION ALL SELECT e.curriculum_id, 'corequisite in another term', 'moved', e.dst FROM kedge AS e JOIN schedule AS a ON a.curriculum_id = e.curriculum_id AND a.course_key = e.src JOIN schedule AS b ON b.curriculum_id = e.curriculum_id AND b.course_key = e.dst WHERE e.kind = 'coreq' AND a.term <> b.term
UNION ALL SELECT s.curriculum_id, 'term too heavy', 'load', '' FROM schedule AS s JOIN curriculum AS k ON k.curriculum_id = s.curriculum_id GROUP BY s.curriculum_id, s.term, system_type
HAVING sum(s.credits) > CASE WHEN system_type = 'quarter' THEN 19 ELSE 21 END AND count(DISTINCT s.group_key) > 1""",
        SCHEDULE,
    ),
    "report_header": sql("SELECT * FROM header", REPORT),
    "mermaid_terms": sql("SELECT curriculum_id, body FROM diagram", REPORT),
    "report_markdown": sql(
        f"""SELECT h.curriculum_id, h.curriculum_id || '_report.md' AS file_name, concat_ws(chr(10), '# Curriculum Report: ' || plan_name, '', '## Overview', '', '| Property | Value |', '|----------|-------|',
  '| **Institution** | ' || institution || ' |', '| **Degree** | ' || degree_name || ' |', '| **System** | ' || system_type || ' |', '| **Years** | ' || years || ' |', '| **CIP Code** | ' || cip_code || ' |', '| **Total Credits** | ' || total_credits || ' |', '| **Total Courses** | ' || course_count || ' |',
  '', '## Complexity Metrics Summary', '', '| Metric | Value | Details |', '|--------|-------|---------|', '| **Total Structural Complexity** | ' || total_complexity || ' | Sum of all course complexities |',
  '| **Longest Delay** | ' || longest_delay || ' | Course: ' || longest_delay_course || ' |', '| **Highest Centrality** | ' || highest_centrality || ' | Course: ' || highest_centrality_course || ' |',
  '', '### Longest Delay Path (Critical Path)', '', delay_path, '', '---', '', '## Term-by-Term Schedule', '', '| ' || s.label || ' | Courses | Credits |', '|---|---|---|', t.rows, '', '---', '', '## Course Metrics', '',
  '| Course | Name | Credits | Complexity | Blocking | Delay | Centrality |', '|---|---|---|---|---|---|---|', m.rows, '', '---', '', '## Curriculum Graph', '', $note$
{GRAPH_NOTE}$note$[2:], d.body) AS body
FROM header AS h JOIN span AS s ON s.curriculum_id = h.curriculum_id JOIN diagram AS d ON d.curriculum_id = h.curriculum_id
JOIN (SELECT curriculum_id, string_agg('| ' || term || ' | ' || courses || ' | ' || credits || ' |', chr(10) ORDER BY term) AS rows FROM term_row GROUP BY curriculum_id) AS t ON t.curriculum_id = h.curriculum_id
JOIN (SELECT curriculum_id, string_agg('| ' || concat_ws(' | ', course_key, name, printf('%.1f', credits), complexity, blocking, delay, centrality) || ' |', chr(10) ORDER BY complexity DESC, course_id) AS rows FROM metrics GROUP BY curriculum_id) AS m ON m.curriculum_id = h.curriculum_id""",
        REPORT,
    ),
    "term_schedule": sql("SELECT curriculum_id, term, pos, course_key, credits FROM schedule", SCHEDULE),
    "term_totals": sql("SELECT curriculum_id, term, sum(credits) AS term_credits, count(*) AS courses FROM schedule GROUP BY curriculum_id, term", SCHEDULE),
    "report_terms": sql("SELECT s.curriculum_id, CAST(s.term AS BIGINT) AS term, string_agg(s.course_key || ' - ' || c.name, ', ' ORDER BY s.pos) AS courses, printf('%.1f', sum(s.credits)) AS credits FROM schedule AS s JOIN course AS c ON c.curriculum_id = s.curriculum_id AND c.course_key = s.course_key GROUP BY s.curriculum_id, s.term", SCHEDULE),
}
