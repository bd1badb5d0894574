"""SQL of the registered queries, written from the definitions and independently of the Spark plans."""

from __future__ import annotations

PERCENTILES = (("p2", "0.02"), ("p25", "0.25"), ("median", "0.5"), ("p75", "0.75"), ("p98", "0.98"))

CALLS = """
WITH RECURSIVE e AS (
  SELECT event_id, user_id AS process, epoch_us(ts) AS t,
    CAST(list_position(['signup', 'view', 'click', 'purchase', 'error'], event_type) AS INTEGER) AS f FROM events
), o AS (SELECT *, row_number() OVER (PARTITION BY process ORDER BY t, event_id) AS i FROM e WHERE f > 0),
up AS (SELECT c.process, c.i, max(p.i) AS pi FROM o c JOIN o p ON c.process = p.process AND p.i < c.i AND p.f < c.f GROUP BY ALL),
nx AS (SELECT c.process, c.i, min(n.i) AS ni FROM o c JOIN o n ON c.process = n.process AND n.i > c.i AND n.f <= c.f GROUP BY ALL),
w AS (SELECT process, max(t) AS last_t FROM o GROUP BY ALL),
c0 AS (
  SELECT o.process, o.i, up.pi, o.event_id AS call_id, p.event_id AS parent_call_id, o.f AS function, coalesce(p.f, 0) AS caller,
    o.t AS t_begin, coalesce(n.t, w.last_t) AS t_end, coalesce(n.t, w.last_t) - o.t AS inclusive
  FROM o JOIN w USING (process) LEFT JOIN up USING (process, i) LEFT JOIN nx USING (process, i)
  LEFT JOIN o p ON p.process = o.process AND p.i = up.pi LEFT JOIN o n ON n.process = o.process AND n.i = nx.ni
), below AS (SELECT process, pi, sum(inclusive) AS s FROM c0 WHERE pi IS NOT NULL GROUP BY ALL),
calls AS (
  SELECT c0.*, CAST(c0.inclusive - coalesce(b.s, 0) AS BIGINT) AS exclusive
  FROM c0 LEFT JOIN below b ON b.process = c0.process AND b.pi = c0.i
), walk AS (
  SELECT process, i, [function] AS path FROM c0 WHERE pi IS NULL
  UNION ALL SELECT c.process, c.i, list_append(v.path, c.function) FROM walk v JOIN c0 c ON c.process = v.process AND c.pi = v.i
), paths AS (SELECT calls.*, walk.path, len(walk.path) AS depth FROM calls JOIN walk USING (process, i))
"""


def measure(x: str, name: str, source: str = "") -> str:
    parts = [f"CAST(sum({x}) AS BIGINT) AS {name}_accumulated"]
    parts += [f"list_sort(list(CAST({x} AS BIGINT)))[CAST(floor(count(*) * {q}::DOUBLE) AS INTEGER) + 1] AS {name}_{p}" for p, q in PERCENTILES]
    parts += [f"CAST(min({x}) AS BIGINT) AS {name}_min", f"CAST(max({x}) AS BIGINT) AS {name}_max", f"CAST(sum({x}) AS DOUBLE) / count(*) AS {name}_mean", f"count(*) AS {name}_n"]
    return ", ".join(parts)


TIMES = f"count(*) AS invocations, {measure('exclusive', 'exc')}, {measure('inclusive', 'inc')}"


def profile(keys: str, using: str) -> str:
    return (
        CALLS
        + f""", per AS (SELECT process, {keys}, count(*) AS n, sum(exclusive) AS x, sum(inclusive) AS y FROM named GROUP BY ALL),
filled AS (
  SELECT {using}, coalesce(n, 0) AS n, coalesce(x, 0) AS x, coalesce(y, 0) AS y
  FROM (SELECT DISTINCT {using} FROM per) k CROSS JOIN (SELECT DISTINCT process FROM calls) p LEFT JOIN per USING (process, {using})
)
SELECT {using}, {measure("n", "inv")}, {measure("x", "exc")}, {measure("y", "inc")} FROM filled GROUP BY {using}
"""
    )


def _named(sql: str, named: str) -> str:
    return sql.replace(", per AS (", f", named AS ({named}), per AS (", 1)


PAIR_SETS = CALLS + ", m AS (SELECT DISTINCT process AS p, caller, function AS callee FROM calls), n AS (SELECT p, count(*) AS n FROM m GROUP BY ALL)"
CLOSED = CALLS + """, d AS (SELECT DISTINCT process, caller AS a, function AS b FROM calls),
c AS (SELECT process, a, b FROM d UNION SELECT c.process, c.a, d.b FROM c JOIN d ON c.process = d.process AND c.b = d.a)
"""
SUPPLIERS = """
WITH RECURSIVE delivered AS (
  SELECT l_suppkey AS object, p_brand AS attr, sum(CAST(l_quantity AS BIGINT)) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL
), ctx AS (
  SELECT object, attr FROM (SELECT *, sum(q) OVER (PARTITION BY attr) AS s, count(*) OVER (PARTITION BY attr) AS n FROM delivered) WHERE 5 * q * n > 6 * s
), intents AS (SELECT object, list_sort(list(attr)) AS intent FROM ctx GROUP BY ALL),
attrs AS (SELECT DISTINCT attr FROM ctx),
attr_intent AS (
  SELECT a.attr, list_sort(list(x.attr)) AS intent FROM attrs a JOIN attrs x
    ON NOT EXISTS (SELECT 1 FROM ctx c WHERE c.attr = a.attr AND NOT EXISTS (SELECT 1 FROM ctx d WHERE d.object = c.object AND d.attr = x.attr))
  GROUP BY ALL
), ends AS (
  SELECT (SELECT list_sort(list(attr)) FROM attrs) AS intent, false AS is_min, true AS is_max
  UNION ALL SELECT coalesce((SELECT list_sort(list(attr)) FROM attrs a WHERE NOT EXISTS (SELECT 1 FROM intents i WHERE NOT list_contains(i.intent, a.attr))), []), true, false
), rows AS (
  SELECT intent, list_sort(list(object)) AS objects, CAST([] AS VARCHAR[]) AS reduced, false AS is_min, false AS is_max FROM intents GROUP BY intent
  UNION ALL SELECT intent, [], list_sort(list(attr)), false, false FROM attr_intent GROUP BY intent
  UNION ALL SELECT intent, [], [], is_min, is_max FROM ends
), nodes AS (
  SELECT intent, list_sort(flatten(list(objects))) AS objects, list_sort(flatten(list(reduced))) AS reduced, bool_or(is_min) AS is_min, bool_or(is_max) AS is_max FROM rows GROUP BY intent
), below AS (SELECT a.intent AS lower, b.intent AS upper FROM nodes a JOIN nodes b ON len(a.intent) < len(b.intent) AND list_has_all(b.intent, a.intent))
"""


def tree_similarity(weights: str, value: str) -> str:
    return (
        CALLS
        + f""", nodes AS (SELECT DISTINCT process, path FROM paths), wt AS ({weights}), tot AS (SELECT process, CAST(sum(w) AS BIGINT) AS t FROM wt GROUP BY ALL),
met AS (SELECT x.process AS p, y.process AS q, CAST(sum(least(x.w, y.w)) AS BIGINT) AS m FROM wt x JOIN wt y ON x.a = y.a AND x.b = y.b GROUP BY ALL)
SELECT a.process AS p, b.process AS q, {value} AS value FROM tot a CROSS JOIN tot b LEFT JOIN met ON met.p = a.process AND met.q = b.process
"""
    )


def lcs(segments: str) -> str:
    """Tables of longest common subsequences, row by row, of segments (p, q, part, a, b), and their last entries as `lengths`."""
    return f""", seg AS ({segments}),
lcs AS (
  SELECT p, q, part, a, b, 0 AS i, list_transform(range(len(b) + 1), lambda x: CAST(0 AS BIGINT)) AS line FROM seg
  UNION ALL SELECT p, q, part, a, b, i + 1, list_prepend(CAST(0 AS BIGINT), list_transform(range(1, len(b) + 1), lambda j: list_max(list_transform(range(1, j + 1), lambda k: CASE WHEN a[i + 1] = b[k] THEN line[k] + 1 ELSE line[k + 1] END))))
  FROM lcs WHERE i < len(a)
), lengths AS (SELECT p, q, CAST(sum(line[-1]) AS INTEGER) AS score FROM lcs WHERE i = len(a) GROUP BY p, q)
"""


TOURS = CALLS + """, s AS (
  SELECT process, i, path, depth, greatest(coalesce(lead(depth) OVER (PARTITION BY process ORDER BY i), 1) - 1, 1) AS back_to FROM paths
), parts AS (SELECT process, i, list_concat([path[-1]], list_reverse(path[back_to:depth - 1])) AS part FROM s),
tours AS (SELECT process, flatten(list(part ORDER BY i)) AS seq FROM parts GROUP BY process),
pairs AS (SELECT x.process AS p, y.process AS q, x.seq AS a, y.seq AS b FROM tours x JOIN tours y ON y.process = x.process + 1)
"""

#: A stack machine over enters (41 click, 42 view, 43 signup: functions 1 to 3) and leaves, one row at a time.
STACK = """
WITH RECURSIVE e AS (
  SELECT user_id AS process, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS BIGINT) AS line, epoch_us(ts) AS t,
    list_position(['click', 'view', 'signup'], event_type) AS f FROM events WHERE event_type IN ('signup', 'view', 'click', 'purchase', 'error')
), ends AS (SELECT process, max(line) AS n, max(t) AS last_t FROM e GROUP BY ALL),
run AS (
  SELECT process, CAST(0 AS BIGINT) AS line, CAST([] AS BIGINT[]) AS stack, CAST([] AS BIGINT[]) AS gone FROM ends
  UNION ALL SELECT run.process, e.line, CASE WHEN e.f IS NOT NULL THEN list_append(stack, e.line) ELSE stack[:-2] END,
    CASE WHEN e.f IS NULL AND len(stack) > 0 THEN stack ELSE CAST([] AS BIGINT[]) END
  FROM run JOIN e ON e.process = run.process AND e.line = run.line + 1
), open_ AS (SELECT process, stack AS still, last_t FROM run JOIN ends USING (process) WHERE line = n),
done AS (SELECT process, gone[-1] AS call_id, gone AS chain, line AS ended FROM run WHERE len(gone) > 0)
"""


def stack_calls(chain: str, unclosed: str = "") -> str:
    return (
        STACK
        + f""", met AS (
  SELECT d.process, d.call_id, {chain} AS chain, x.t AS t_end FROM done d JOIN open_ o USING (process) JOIN e x ON x.process = d.process AND x.line = d.ended {unclosed}
), c0 AS (
  SELECT b.process, b.call_id, CASE WHEN len(chain) > 1 THEN chain[-2] END AS parent_call_id, CAST(len(chain) AS INTEGER) AS depth, CAST(e.f AS INTEGER) AS function, chain,
    CAST(coalesce(p.f, 0) AS INTEGER) AS caller, e.t AS t_begin, b.t_end, b.t_end - e.t AS inclusive
  FROM met b JOIN e ON e.process = b.process AND e.line = b.call_id LEFT JOIN e p ON p.process = b.process AND p.line = CASE WHEN len(chain) > 1 THEN chain[-2] END
), below AS (SELECT process, parent_call_id AS call_id, sum(inclusive) AS s FROM c0 WHERE parent_call_id IS NOT NULL GROUP BY ALL),
calls AS (SELECT c0.*, CAST(inclusive - coalesce(s, 0) AS BIGINT) AS exclusive FROM c0 LEFT JOIN below USING (process, call_id))
"""
    )


DROPPED = stack_calls("list_filter(d.chain, lambda x: NOT list_contains(o.still, x))")
CLAMPED = stack_calls("d.chain", "UNION ALL SELECT process, still[k], still[:k], last_t FROM (SELECT process, still, last_t, unnest(range(1, len(still) + 1)) AS k FROM open_)")
_CALL = "process, call_id, parent_call_id, depth, function, caller, t_begin, t_end, inclusive, exclusive"
_SCORES = "SELECT p, q, score, CAST(least(len(a), len(b)) AS INTEGER) AS achievable, CAST(greatest(len(a), len(b)) AS INTEGER) AS most FROM pairs"


def crc(text: str) -> str:
    """CRC-16 of an ASCII text modulo 255, bit by bit: a byte enters with the first of its eight steps."""
    steps = f"flatten(list_transform(string_split({text}, ''), lambda c: [CAST(ord(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))"
    step = "CASE WHEN xor(a, x) & 1 = 1 THEN xor(xor(a, x) >> 1, 33800) ELSE xor(a, x) >> 1 END"
    return f"CAST(xor(list_reduce(list_prepend(CAST(65535 AS BIGINT), {steps}), lambda a, x: {step}), 65535) % 255 AS INTEGER)"


ORACLES: dict[str, str] = {
    "colours": f"""SELECT function, {crc("name")} AS r, {crc("repeat(name, 2)")} AS g, {crc("repeat(name, 3)")} AS b
FROM (VALUES (1, 'signup'), (2, 'view'), (3, 'click'), (4, 'purchase'), (5, 'error')) v(function, name)""",
    "stack_calls": DROPPED + f"SELECT {_CALL}, (SELECT string_agg(e.f, '>' ORDER BY e.line) FROM e WHERE e.process = calls.process AND list_contains(calls.chain, e.line)) AS path FROM calls",
    "stack_calls_clamped": CLAMPED + f"SELECT {_CALL} FROM calls",
    "selected_processes": DROPPED + "SELECT process, count(*) AS calls, CAST(sum(exclusive) AS BIGINT) AS exclusive FROM calls WHERE process = 2 OR process BETWEEN 4 AND 9 GROUP BY process",
    "flat_score": TOURS + lcs("SELECT p, q, 0 AS part, a, b FROM pairs") + _SCORES + " JOIN lengths USING (p, q)",
    "anchored_diff": TOURS + lcs("SELECT p, q, 0 AS part, a[:len(a) // 2] AS a, b[:len(b) // 2] AS b FROM pairs UNION ALL SELECT p, q, 1, a[len(a) // 2 + 2:], b[len(b) // 2 + 2:] FROM pairs")
    + """SELECT p, q, CAST(score + e AS INTEGER) AS score, CAST(score + e + least(len(a), len(b)) - score - e AS INTEGER) AS achievable, CAST(greatest(len(a), len(b)) AS INTEGER) AS most
FROM (SELECT *, CASE WHEN a[len(a) // 2 + 1] = b[len(b) // 2 + 1] THEN 1 ELSE 0 END AS e FROM pairs) JOIN lengths USING (p, q)""",
    "flat_sequences_to_depth": CALLS + """, s AS (
  SELECT process, i, path, depth, greatest(coalesce(lead(depth) OVER (PARTITION BY process ORDER BY i), 1) - 1, 1) AS back_to FROM paths WHERE depth <= 2
), parts AS (SELECT process, i, list_concat([path[-1]], list_reverse(path[back_to:depth - 1])) AS part FROM s)
SELECT process, array_to_string(flatten(list(part ORDER BY i)), ' ') AS seq FROM parts GROUP BY process""",
    "trace_lines": CALLS + """, s AS (SELECT process, i, function, depth, greatest(depth - coalesce(lead(depth) OVER (PARTITION BY process ORDER BY i), 1) + 1, 0) AS n FROM paths),
steps AS (SELECT process, i, function, unnest(range(0, n + 1)) AS k FROM s),
timed AS (SELECT *, row_number() OVER (PARTITION BY process ORDER BY i, k) AS t FROM steps)
SELECT process, t, lower(to_hex(t)) || ' ' || CASE WHEN k = 0 THEN 'E' || lower(to_hex(function + 9)) ELSE 'L' END AS line FROM timed""",
    "threshold_groups": PAIR_SETS + """, s AS (SELECT p, list_sort(list(caller || '-' || callee)) AS intent FROM m GROUP BY p),
g AS (SELECT intent, min(p) AS o, count(*) AS n, CAST(row_number() OVER (ORDER BY min(p)) AS BIGINT) AS k FROM s GROUP BY intent),
v AS (SELECT a.k, list(b.n * len(list_intersect(a.intent, b.intent))::DOUBLE / len(list_distinct(a.intent || b.intent)) ORDER BY b.k) AS js, list(b.n ORDER BY b.k) AS ns FROM g a JOIN g b ON a.k >= b.k GROUP BY a.k),
st AS (
  SELECT CAST(1 AS BIGINT) AS k, [CAST(0 AS BIGINT)] AS assign
  UNION ALL SELECT k + 1, list_append(assign, CASE WHEN list_max(means) >= 0.9 THEN list_position(means, list_max(means)) - 1 ELSE len(means) END) FROM (
    SELECT st.k, assign, list_transform(range(0, list_max(assign) + 1), lambda c: list_sum(list_transform(list_filter(range(1, st.k + 1), lambda j: assign[j] = c), lambda j: js[j])) / list_sum(list_transform(list_filter(range(1, st.k + 1), lambda j: assign[j] = c), lambda j: ns[j]))) AS means
    FROM st JOIN v ON v.k = st.k + 1)
), last AS (SELECT assign FROM st ORDER BY k DESC LIMIT 1)
SELECT CAST(assign[g.k] AS INTEGER) AS cluster, s.p AS object FROM g JOIN s USING (intent) CROSS JOIN last""",
    "dot_lines": SUPPLIERS + """, named AS (SELECT *, substr(sha256(CAST(to_json(intent) AS VARCHAR)), 1, 12) AS id, array_to_string(reduced, ', ') AS r, array_to_string(objects, ', ') AS o FROM nodes)
SELECT 0 AS ord, 'digraph {' AS line UNION ALL SELECT 3, '}'
UNION ALL SELECT 1, '  "' || id || '" [label="' || CASE WHEN length(r) > 40 THEN substr(r, 1, 40) || '...' ELSE r END || '\\n' || CASE WHEN length(o) > 40 THEN substr(o, 1, 40) || '...' ELSE o END || '"];' FROM named
UNION ALL SELECT 2, '  "' || x.id || '" -> "' || y.id || '";' FROM below b JOIN named x ON x.intent = b.lower JOIN named y ON y.intent = b.upper
  WHERE NOT EXISTS (SELECT 1 FROM below p JOIN below q ON p.upper = q.lower WHERE p.lower = b.lower AND q.upper = b.upper)""",
    "group_members": "SELECT * FROM (VALUES (1, '1,2,3'), (2, '4,5')) v(grp, functions)",
    "unifier_dump": """WITH names AS (
  SELECT 1 AS trace_id, 1 + row_number() OVER (ORDER BY n_nationkey) AS token, n_name AS name FROM nation
  UNION ALL SELECT 2, 1 + row_number() OVER (ORDER BY r_regionkey), r_name FROM region
  UNION ALL SELECT 3, 1 + row_number() OVER (ORDER BY n_nationkey DESC), n_name FROM nation
), f AS (SELECT name, min(row(trace_id, token)) AS pos FROM names GROUP BY name), ids AS (SELECT name, row_number() OVER (ORDER BY pos) AS function FROM f)
SELECT 0 AS ord, 'functions: { ' || string_agg(function || ' : ' || name, ', ' ORDER BY function) || ' }' AS line FROM ids
UNION ALL SELECT CAST(trace_id AS INTEGER), 'trace ' || trace_id || ': { ' || string_agg(token || ' : ' || function, ', ' ORDER BY token) || ' }' FROM names JOIN ids USING (name) GROUP BY trace_id
ORDER BY ord""",
    "sim_compressed": PAIR_SETS + """, s AS (SELECT x.p, y.p AS q, count(*) AS c FROM m x JOIN m y USING (caller, callee) GROUP BY ALL)
SELECT a.p, b.p AS q, coalesce(c, 0)::DOUBLE / (a.n + b.n - coalesce(c, 0)) AS value FROM n a CROSS JOIN n b LEFT JOIN s ON s.p = a.p AND s.q = b.p""",
    "alike_groups": PAIR_SETS + """, s AS (SELECT p, list_sort(list(caller || '-' || callee)) AS intent FROM m GROUP BY p), g AS (SELECT intent, min(p) AS o, count(*) AS k FROM s GROUP BY intent),
v AS (SELECT a.o AS a, b.o AS b, a.k AS members_a, len(list_intersect(a.intent, b.intent))::DOUBLE / len(list_distinct(a.intent || b.intent)) AS value FROM g a JOIN g b ON a.o > b.o)
SELECT a, b, members_a, value FROM v WHERE value >= 0.75""",
    "pair_totals": PAIR_SETS + "SELECT count(DISTINCT caller) AS callers, count(DISTINCT callee) AS callees, (SELECT count(*) FROM (SELECT caller FROM m UNION SELECT callee FROM m)) AS functions FROM m",
    "lattice_objects": SUPPLIERS + "SELECT array_to_string(n.intent, ',') AS intent, i.object FROM nodes n JOIN intents i ON list_has_all(i.intent, n.intent)",
    "box_plot": _named(profile("function", "function"), "SELECT * FROM calls").replace("\nSELECT function", ", stats AS (\nSELECT function")
    + """), top AS (SELECT max(exc_p98)::DOUBLE AS t FROM stats)
SELECT function, round(exc_p2 / t, 9) AS low, round(exc_p25 / t, 9) AS box_low, round(exc_median / t, 9) AS line, round(exc_p75 / t, 9) AS box_high, round(exc_p98 / t, 9) AS high FROM stats CROSS JOIN top""",
    "timing_roll_up": """WITH r AS (SELECT event_id % 7 AS procs, 'total' AS part, value AS s FROM events UNION ALL SELECT event_id % 7, 'loading', value / 2 FROM events)
SELECT procs, part, count(*) AS runs, min(s) AS min, round(avg(s), 6) AS avg, (list_sort(list(s)))[count(*) // 2 + 1] AS med, max(s) AS max FROM r GROUP BY procs, part""",
    "calls_nested": CALLS + "SELECT process, call_id, parent_call_id, CAST(depth AS INTEGER) AS depth, function, caller, t_begin, t_end, inclusive, exclusive, array_to_string(path, '>') AS path FROM paths",
    "call_list_stats": CALLS + f"SELECT process, function, {TIMES} FROM calls GROUP BY process, function",
    "call_matrix_stats": CALLS + f"SELECT process, caller, function, {TIMES} FROM calls GROUP BY process, caller, function",
    "call_tree_stats": CALLS + f"SELECT process, array_to_string(path, '>') AS path, {TIMES} FROM paths GROUP BY ALL",
    "call_matrix_accumulated": CALLS + f"SELECT caller, function, {TIMES} FROM calls GROUP BY caller, function",
    "call_list_rollup": CALLS + "SELECT process, function, count(*) AS invocations, CAST(sum(exclusive) AS BIGINT) AS exc_accumulated, CAST(sum(inclusive) AS BIGINT) AS inc_accumulated FROM calls GROUP BY GROUPING SETS ((process, function), (function))",
    "call_list_neighbors": CALLS + """, pr AS (SELECT DISTINCT process, caller, function FROM calls),
k AS (SELECT process, function FROM pr UNION SELECT process, caller FROM pr WHERE caller <> 0)
SELECT process, function, coalesce((SELECT string_agg(caller, ',' ORDER BY caller) FROM pr WHERE pr.process = k.process AND pr.function = k.function), '') AS callers,
  coalesce((SELECT string_agg(function, ',' ORDER BY function) FROM pr WHERE pr.process = k.process AND pr.caller = k.function), '') AS callees FROM k""",
    "profile_function": _named(profile("function", "function"), "SELECT * FROM calls"),
    "profile_group": _named(profile("grp", "grp"), "SELECT *, CASE WHEN function >= 4 THEN 2 ELSE 1 END AS grp FROM calls"),
    "profile_pair": _named(profile("caller, function", "caller, function"), "SELECT * FROM calls"),
    "profile_path": _named(profile("path", "path"), "SELECT process, exclusive, inclusive, array_to_string(path, '>') AS path FROM paths"),
    "weighted_median_order": CALLS + f""", s AS (SELECT process, function, {TIMES} FROM calls GROUP BY process, function)
SELECT function, CAST(sum(invocations) AS BIGINT) AS invocations, CAST(sum(exc_median * invocations) AS DOUBLE) / sum(invocations) AS exc_weighted_median,
  CAST(sum(inc_median * invocations) AS DOUBLE) / sum(invocations) AS inc_weighted_median, max(exc_p98) AS exc_max_p98, max(inc_p98) AS inc_max_p98, max(invocations) AS max_invocations
FROM s GROUP BY function ORDER BY exc_weighted_median DESC, function""",
    "unified_functions": """WITH names AS (
  SELECT 1 AS trace_id, 1 + row_number() OVER (ORDER BY n_nationkey) AS token, n_name AS name FROM nation
  UNION ALL SELECT 2, 1 + row_number() OVER (ORDER BY r_regionkey), r_name FROM region
  UNION ALL SELECT 3, 1 + row_number() OVER (ORDER BY n_nationkey DESC), n_name FROM nation
), f AS (SELECT name, min(row(trace_id, token)) AS pos FROM names GROUP BY name), ids AS (SELECT name, row_number() OVER (ORDER BY pos) AS function FROM f)
SELECT CAST(trace_id AS INTEGER) AS trace_id, CAST(token AS INTEGER) AS token, CAST(function AS INTEGER) AS function FROM names JOIN ids USING (name)""",
    "unified_members": """WITH f AS (
  SELECT 1 AS trace_id, n_nationkey + 1 AS token, n_name AS name, n_regionkey + 1 AS grp FROM nation
  UNION ALL SELECT 2, n_nationkey + 1, n_name, (n_regionkey + n_nationkey % 2) % 5 + 1 FROM nation
), ids AS (SELECT name, row_number() OVER (ORDER BY min(row(trace_id, token))) AS function FROM f GROUP BY name),
g AS (SELECT r_regionkey + 1 AS grp, row_number() OVER (ORDER BY r_regionkey) AS group_id FROM region)
SELECT CAST(function AS INTEGER) AS function, CAST(arg_max(group_id, row(trace_id, token)) AS INTEGER) AS grp, count(DISTINCT group_id) > 1 AS conflict
FROM f JOIN ids USING (name) JOIN g USING (grp) GROUP BY function""",
    "lattice_metrics": SUPPLIERS + "SELECT (SELECT count(*) FROM attrs) AS attributes, (SELECT count(*) FROM intents) AS objects, (SELECT count(DISTINCT intent) FROM intents) AS groups, (SELECT count(*) FROM nodes) AS nodes",
    "sim_jaccard": PAIR_SETS + """, s AS (SELECT x.p, y.p AS q, count(*) AS c FROM m x JOIN m y USING (caller, callee) GROUP BY ALL)
SELECT a.p, b.p AS q, coalesce(c, 0)::DOUBLE / (a.n + b.n - coalesce(c, 0)) AS value FROM n a CROSS JOIN n b LEFT JOIN s ON s.p = a.p AND s.q = b.p""",
    "sim_functions": CALLS + """, m AS (SELECT DISTINCT process AS p, function AS f FROM calls), n AS (SELECT p, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT x.p, y.p AS q, count(*) AS c FROM m x JOIN m y USING (f) GROUP BY ALL)
SELECT a.p, b.p AS q, coalesce(c, 0)::DOUBLE / (a.n + b.n - coalesce(c, 0)) AS value FROM n a CROSS JOIN n b LEFT JOIN s ON s.p = a.p AND s.q = b.p""",
    "sim_subsumption": CLOSED + """, n AS (SELECT process AS p, count(*) AS n FROM c GROUP BY ALL), s AS (SELECT x.process AS p, y.process AS q, count(*) AS k FROM c x JOIN c y ON x.a = y.a AND x.b = y.b GROUP BY ALL)
SELECT a.p, b.p AS q, coalesce(k, 0)::DOUBLE / b.n AS value FROM n a CROSS JOIN n b LEFT JOIN s ON s.p = a.p AND s.q = b.p""",
    "sim_function_subsumption": CALLS + """, m AS (SELECT DISTINCT process AS p, function AS f FROM calls), n AS (SELECT p, count(*) AS n FROM m GROUP BY ALL), s AS (SELECT x.p, y.p AS q, count(*) AS c FROM m x JOIN m y USING (f) GROUP BY ALL)
SELECT a.p, b.p AS q, coalesce(c, 0)::DOUBLE / b.n AS value FROM n a CROSS JOIN n b LEFT JOIN s ON s.p = a.p AND s.q = b.p""",
    "sim_invocation": CALLS + """, m AS (SELECT process AS p, caller, function AS f, count(*) AS w FROM calls GROUP BY ALL), n AS (SELECT p, count(*) AS n FROM m GROUP BY ALL),
s AS (SELECT x.p, y.p AS q, count(*) AS c, sum(least(x.w, y.w)::DOUBLE / greatest(x.w, y.w)) AS v FROM m x JOIN m y USING (caller, f) GROUP BY ALL)
SELECT a.p, b.p AS q, round(coalesce(v, 0) / (a.n + b.n - coalesce(c, 0)), 9) AS value FROM n a CROSS JOIN n b LEFT JOIN s ON s.p = a.p AND s.q = b.p""",
    "sim_call_tree": tree_similarity(
        "SELECT process, CASE WHEN len(path) > 1 THEN path[-2] ELSE 0 END AS a, path[-1] AS b, CASE WHEN len(path) > 1 THEN count(*) ELSE 1 END AS w FROM nodes GROUP BY process, a, b, len(path) > 1",
        "coalesce(m, 0)::DOUBLE / (a.t + b.t - coalesce(m, 0))",
    ),
    "sim_call_tree_subsumption": tree_similarity(
        "SELECT process, a, b, count(*) AS w FROM (SELECT process, unnest(list_prepend(0, path[:-2])) AS a, path[-1] AS b FROM nodes) GROUP BY ALL", "a.t::DOUBLE / (a.t + b.t - coalesce(m, 0))"
    ),
    "closure_pairs": CLOSED + 'SELECT process, a AS "from", b AS "to" FROM c',
    "equality_groups": PAIR_SETS + """, s AS (SELECT p, string_agg(caller || '-' || callee, ',' ORDER BY caller, callee) AS intent FROM m GROUP BY p)
SELECT intent, string_agg(p, ',' ORDER BY p) AS objects, min(p) AS first FROM s GROUP BY intent""",
    "concept_nodes": SUPPLIERS + "SELECT array_to_string(intent, ',') AS intent, array_to_string(reduced, ',') AS reduced, array_to_string(objects, ',') AS objects, is_min, is_max FROM nodes",
    "full_lattice": SUPPLIERS + """, closed AS (
  SELECT DISTINCT intent FROM intents UNION SELECT coalesce(list_sort(list_intersect(c.intent, i.intent)), CAST([] AS VARCHAR[])) FROM closed c CROSS JOIN (SELECT DISTINCT intent FROM intents) i
) SELECT array_to_string(intent, ',') AS intent FROM (SELECT intent FROM closed UNION SELECT list_sort(list(attr)) FROM attrs)""",
    "concept_edges": SUPPLIERS + """SELECT array_to_string(lower, ',') AS lower, array_to_string(upper, ',') AS upper FROM below b
WHERE NOT EXISTS (SELECT 1 FROM below x JOIN below y ON x.upper = y.lower WHERE x.lower = b.lower AND y.upper = b.upper)""",
    "lattice_reachable": SUPPLIERS + "SELECT array_to_string(lower, ',') AS lower, array_to_string(upper, ',') AS upper FROM below",
    "lattice_group_matrix": SUPPLIERS + """, g AS (SELECT intent, min(object) AS o FROM intents GROUP BY intent)
SELECT a.o AS a, b.o AS b, len(list_intersect(a.intent, b.intent))::DOUBLE / len(list_distinct(a.intent || b.intent)) AS value FROM g a JOIN g b ON a.o > b.o""",
    "lattice_group_subsumption": SUPPLIERS + """, g AS (SELECT intent, min(object) AS o FROM intents GROUP BY intent)
SELECT a.o AS a, b.o AS b, len(list_intersect(a.intent, b.intent))::DOUBLE / len(b.intent) AS value FROM g a JOIN g b ON a.o <> b.o""",
    "cxt_rows": SUPPLIERS + """SELECT o.object, string_agg(CASE WHEN c.attr IS NULL THEN '.' ELSE 'X' END, '' ORDER BY a.attr) AS crosses
FROM (SELECT DISTINCT object FROM ctx) o CROSS JOIN attrs a LEFT JOIN ctx c ON c.object = o.object AND c.attr = a.attr GROUP BY o.object""",
    "pair_statistics": CALLS + """, ps AS (SELECT DISTINCT process AS object, caller, function AS callee FROM calls)
SELECT object, count(DISTINCT caller) AS callers, count(DISTINCT callee) AS callees, (SELECT count(DISTINCT f) FROM (SELECT caller AS f FROM ps q WHERE q.object = ps.object UNION ALL SELECT callee FROM ps q WHERE q.object = ps.object)) AS functions FROM ps GROUP BY object""",
    "selected_cells": CALLS + "SELECT process, caller, function, count(*) AS invocations FROM calls WHERE caller IN (1, 2) AND function IN (3, 4) GROUP BY ALL",
    "subtree_edges": CALLS + """, t AS (SELECT DISTINCT process, path FROM paths UNION SELECT DISTINCT process, CAST([] AS INTEGER[]) FROM paths)
SELECT a.process, array_to_string(a.path, '>') AS path, count(b.path) AS sub_tree_edges FROM t a LEFT JOIN t b ON a.process = b.process AND len(b.path) > len(a.path) AND b.path[:len(a.path)] = a.path GROUP BY a.process, a.path""",
    "tree_node_count": CALLS + "SELECT count(*) + count(DISTINCT process) AS nodes FROM (SELECT DISTINCT process, path FROM paths)",
    "tree_compressed_count": CALLS + """, t AS (SELECT DISTINCT process, path FROM paths),
l5 AS (SELECT process, path, path[-1]::VARCHAR || '()' AS h FROM t WHERE len(path) = 5),
l4 AS (SELECT t.process, t.path, t.path[-1]::VARCHAR || '(' || coalesce(string_agg(k.h, ',' ORDER BY k.h), '') || ')' AS h FROM t LEFT JOIN l5 k ON k.process = t.process AND k.path[:-2] = t.path WHERE len(t.path) = 4 GROUP BY t.process, t.path),
l3 AS (SELECT t.process, t.path, t.path[-1]::VARCHAR || '(' || coalesce(string_agg(k.h, ',' ORDER BY k.h), '') || ')' AS h FROM t LEFT JOIN l4 k ON k.process = t.process AND k.path[:-2] = t.path WHERE len(t.path) = 3 GROUP BY t.process, t.path),
l2 AS (SELECT t.process, t.path, t.path[-1]::VARCHAR || '(' || coalesce(string_agg(k.h, ',' ORDER BY k.h), '') || ')' AS h FROM t LEFT JOIN l3 k ON k.process = t.process AND k.path[:-2] = t.path WHERE len(t.path) = 2 GROUP BY t.process, t.path),
l1 AS (SELECT t.process, t.path, t.path[-1]::VARCHAR || '(' || coalesce(string_agg(k.h, ',' ORDER BY k.h), '') || ')' AS h FROM t LEFT JOIN l2 k ON k.process = t.process AND k.path[:-2] = t.path WHERE len(t.path) = 1 GROUP BY t.process, t.path),
u AS (SELECT h FROM l5 UNION SELECT h FROM l4 UNION SELECT h FROM l3 UNION SELECT h FROM l2 UNION SELECT h FROM l1)
SELECT (SELECT count(*) FROM u) + (SELECT count(DISTINCT process) FROM t) AS nodes""",
    "flat_sequences": CALLS + """, s AS (
  SELECT process, i, path, depth, greatest(coalesce(lead(depth) OVER (PARTITION BY process ORDER BY i), 1) - 1, 1) AS back_to FROM paths
), parts AS (SELECT process, i, list_concat([path[-1]], list_reverse(path[back_to:depth - 1])) AS part FROM s)
SELECT process, array_to_string(flatten(list(part ORDER BY i)), ' ') AS seq FROM parts GROUP BY process""",
    "tree_sequences": CALLS + """SELECT process, call_id, CAST(depth AS INTEGER) AS depth, function, CAST(i AS INTEGER) AS i,
  CAST(row_number() OVER (PARTITION BY process, parent_call_id ORDER BY t_begin, call_id) - 1 AS INTEGER) AS pos FROM paths""",
    "tikz_rectangles": CALLS + """, b AS (SELECT process, min(t_begin) AS t0, max(t_end) AS t1 FROM paths GROUP BY ALL)
SELECT process, call_id, CAST(depth AS INTEGER) AS level, round(CASE WHEN t1 > t0 THEN inclusive::DOUBLE / (t1 - t0) ELSE 1 END, 9) AS width,
  round(CASE WHEN t1 > t0 THEN ((t_begin - t0) + inclusive / 2.0::DOUBLE) / (t1 - t0) ELSE 0.5 END, 9) AS middle FROM paths JOIN b USING (process)""",
    "metric_dump": PAIR_SETS + """, a AS (SELECT caller, callee FROM m WHERE p = 1), b AS (SELECT caller, callee FROM m WHERE p = 2)
SELECT caller, callee, CASE WHEN EXISTS (SELECT 1 FROM a WHERE a.caller = u.caller AND a.callee = u.callee) THEN CASE WHEN EXISTS (SELECT 1 FROM b WHERE b.caller = u.caller AND b.callee = u.callee) THEN 'both' ELSE 'only_p' END ELSE 'only_q' END AS side
FROM (SELECT * FROM a UNION SELECT * FROM b) u""",
    "process_list": "SELECT DISTINCT user_id AS process FROM events ORDER BY 1",
    "function_list": CALLS + "SELECT CASE WHEN function >= 4 THEN 2 ELSE 1 END AS grp, function, (['signup', 'view', 'click', 'purchase', 'error'])[function] AS name, count(*) AS calls FROM calls GROUP BY ALL ORDER BY grp, function",
    "label_search": "SELECT p_partkey, p_type FROM part WHERE contains(p_type, 'PROMO') OR contains(p_type, 'promo')",
    "attribute_count": PAIR_SETS + "SELECT (SELECT count(*) FROM (SELECT DISTINCT caller, callee FROM m)) AS pairs, (SELECT count(DISTINCT callee) FROM m) AS functions",
}
