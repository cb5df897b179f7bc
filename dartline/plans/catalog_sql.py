"""Pieces of DuckDB SQL that the registered queries share."""

from __future__ import annotations

from dartline.functions.rng import exponential_sql, rand01_sql, raw52_sql  # noqa: F401

ROUNDS = 16

PARTS = """l AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem),
e AS MATERIALIZED (SELECT a.p AS u, b.p AS v, count(*) AS w FROM l a JOIN l b ON a.o = b.o AND a.p < b.p GROUP BY ALL HAVING count(*) >= 2)"""
PARTS_ALL = PARTS.replace(" HAVING count(*) >= 2", "")
SUPPLIERS = """l AS (SELECT DISTINCT l_orderkey AS o, l_suppkey AS p FROM lineitem),
e0 AS MATERIALIZED (SELECT a.p AS u, b.p AS v, count(*) AS w FROM l a JOIN l b ON a.o = b.o AND a.p < b.p GROUP BY ALL),
e AS MATERIALIZED (SELECT * FROM e0 WHERE w > (SELECT avg(w) FROM e0))"""
DARTS = "d AS MATERIALIZED (SELECT u, v FROM e UNION ALL SELECT v, u FROM e)"
DEGREES = "g AS MATERIALIZED (SELECT u AS id, count(*) AS degree FROM d GROUP BY u)"
LARGEST = """big AS (SELECT component FROM comp GROUP BY component ORDER BY count(*) DESC, component LIMIT 1),
ln AS MATERIALIZED (SELECT id FROM comp JOIN big USING (component)),
le AS MATERIALIZED (SELECT u, v FROM e JOIN ln ON e.u = ln.id)"""
#: nodes and the smallest node that each reaches
COMPONENTS = """n AS (SELECT DISTINCT u AS id FROM d),
reach(id, c) AS (SELECT id, id FROM n UNION SELECT d.v, r.c FROM reach r JOIN d ON d.u = r.id WHERE r.c <= d.v),
comp AS MATERIALIZED (SELECT id, min(c) AS component FROM reach GROUP BY id)"""
EVENTS = """k AS (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS token FROM (SELECT DISTINCT event_type FROM events)),
t AS MATERIALIZED (SELECT user_id AS walk, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, token FROM events JOIN k USING (event_type))"""


def bfs(sources: str, cap: int) -> str:
    """Distances x(i, j, x) up to cap from a table of sources (id) over d."""
    return f"""walk(i, j, x) AS (SELECT id, id, 0 FROM {sources} UNION SELECT w.i, d.v, w.x + 1 FROM walk w JOIN d ON d.u = w.j WHERE w.x < {cap}),
x AS MATERIALIZED (SELECT i, j, min(x) AS x FROM walk GROUP BY ALL)"""


def orbits(name: str = "s") -> str:
    """From {name}(id, nxt): o(id, orbit, pos), by pointer doubling for orbits of up to 2^ROUNDS."""
    parts = [f"m0 AS MATERIALIZED (SELECT id, nxt, least(id, nxt) AS m FROM {name})"]
    for k in range(1, ROUNDS + 1):
        parts.append(f"m{k} AS MATERIALIZED (SELECT a.id, b.nxt, least(a.m, b.m) AS m FROM m{k - 1} a JOIN m{k - 1} b ON a.nxt = b.id)")
    parts.append(f"r0 AS MATERIALIZED (SELECT s.id, l.m AS orbit, CASE WHEN s.nxt <> l.m THEN s.nxt END AS nxt, CASE WHEN s.nxt <> l.m THEN 1 ELSE 0 END AS q FROM {name} s JOIN m{ROUNDS} l USING (id))")
    for k in range(1, ROUNDS + 1):
        parts.append(f"r{k} AS MATERIALIZED (SELECT a.id, a.orbit, b.nxt, a.q + coalesce(b.q, 0) AS q FROM r{k - 1} a LEFT JOIN r{k - 1} b ON a.nxt = b.id)")
    parts.append(f"o AS MATERIALIZED (SELECT id, orbit, count(*) OVER (PARTITION BY orbit) - 1 - q AS pos FROM r{ROUNDS})")
    return ",\n".join(parts)


def faces(rotation: str = "rot") -> str:
    """From {rotation}(config, u, pos, v): pi(config, u, pos, v, nxt) and f(config, face, pos, u, v)."""
    return f"""pi AS MATERIALIZED (SELECT config, u, pos, v, coalesce(lead(v) OVER w, first_value(v) OVER w) AS nxt FROM {rotation} WINDOW w AS (PARTITION BY config, u ORDER BY pos)),
ids AS MATERIALIZED (SELECT *, row_number() OVER (ORDER BY config, u, pos) - 1 AS id FROM pi),
s AS MATERIALIZED (SELECT a.id, b.id AS nxt FROM ids a JOIN ids b ON b.config = a.config AND b.u = a.nxt AND b.v = a.u),
{orbits()},
f AS MATERIALIZED (SELECT ids.config, dense_rank() OVER (PARTITION BY ids.config ORDER BY o.orbit) - 1 AS face, o.pos, ids.u, ids.v FROM ids JOIN o USING (id))"""


def signs(nodes: str, configs: int, seed: int | str) -> str:
    return f"sg AS MATERIALIZED (SELECT config, id, CASE WHEN {rand01_sql(str(seed), 'config', 'id')} < 0.5 THEN -1 ELSE 1 END AS sign FROM {nodes}, range({configs}) c(config))"


def sorted_rotation(configs: int, seed: int | str) -> str:
    """rot, with the degree as curvature; seed: a number or a quoted text."""
    return f"""{signs('g', configs, seed)},
rot AS MATERIALIZED (SELECT sg.config, d.u, row_number() OVER (PARTITION BY sg.config, d.u ORDER BY sg.sign * g.degree, d.v) - 1 AS pos, d.v FROM d JOIN sg ON sg.id = d.u JOIN g ON g.id = d.v)"""


def random_rotation(configs: int, seed: int) -> str:
    r = rand01_sql(str(seed), "config", "u", "v")
    return f"rot AS MATERIALIZED (SELECT config, u, row_number() OVER (PARTITION BY config, u ORDER BY {r}, v) - 1 AS pos, v FROM d, range({configs}) c(config))"


def solution(name: str) -> str:
    """From {name}_rows(i, r), r a row of a square matrix and its right sides: {name}(i, x), x the i-th unknown for each
    right side, by elimination with the largest pivot of the rows not used."""
    return f"""{name}_steps(k, m, used) AS (SELECT 0, (SELECT list(r ORDER BY i) FROM {name}_rows), []::BIGINT[] UNION ALL
 SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = p THEN top ELSE list_transform(r, lambda y, j: y - r[k + 1] * top[j]) END), list_append(used, p)
 FROM (SELECT k, m, used, p, list_transform(m[p], lambda y: y / m[p][k + 1]) AS top
  FROM (SELECT *, list_position(z, list_max(z))::BIGINT AS p FROM (SELECT *, list_transform(m, lambda r, i: CASE WHEN list_contains(used, i) THEN -1.0::DOUBLE ELSE abs(r[k + 1]) END) AS z FROM {name}_steps WHERE k < len(m))))),
{name} AS MATERIALIZED (SELECT i, m[used[i]][len(m) + 1:] AS x FROM (SELECT m, used, unnest(range(1, len(m) + 1)) AS i FROM {name}_steps WHERE k = len(m)))"""


#: om(i, j, omega) over ln and le, ids numbered from 1: from the inverse of the Laplacian plus 1/n
RESISTANCES = f"""ids AS MATERIALIZED (SELECT id, row_number() OVER (ORDER BY id) AS i FROM ln),
ld AS MATERIALIZED (SELECT a.i, b.i AS j FROM (SELECT u, v FROM le UNION ALL SELECT v, u FROM le) q JOIN ids a ON a.id = q.u JOIN ids b ON b.id = q.v),
cell AS (SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN (SELECT count(*) FROM ld WHERE ld.i = a.i) ELSE 0 END - CASE WHEN ld.i IS NULL THEN 0 ELSE 1 END + 1.0::DOUBLE / (SELECT count(*) FROM ids) AS x, (a.i = b.i)::INT::DOUBLE AS one
 FROM ids a CROSS JOIN ids b LEFT JOIN ld ON ld.i = a.i AND ld.j = b.i),
inv_rows AS MATERIALIZED (SELECT i, list_concat(list(x ORDER BY j), list(one ORDER BY j)) AS r FROM cell GROUP BY i),
{solution('inv')},
om AS MATERIALIZED (SELECT a.i, b.i AS j, CASE WHEN a.i = b.i THEN 0.0::DOUBLE ELSE a.x[a.i] + b.x[b.i] - a.x[b.i] - b.x[a.i] END AS omega FROM inv a, inv b)"""


def row_seeds(seed: int) -> str:
    """From s(u, v, w): t(u, v), an edge for each row in order, of those that no earlier row took."""
    return f"""own AS MATERIALIZED (SELECT u, row_number() OVER (ORDER BY u) AS k FROM (SELECT DISTINCT u FROM s WHERE u <> v AND w > 0)),
rw AS MATERIALIZED (SELECT own.k, own.u, list(struct_pack(v := s.v, k := coalesce(b.k, 0), w := s.w) ORDER BY s.v) AS o FROM s JOIN own ON own.u = s.u LEFT JOIN own b ON b.u = s.v WHERE s.u <> s.v AND s.w > 0 GROUP BY own.k, own.u),
turn(k, took) AS (SELECT 0::BIGINT, []::BIGINT[] UNION ALL
 SELECT k, list_append(took, coalesce(o[list_filter(range(1, len(o) + 1), lambda j: list_sum(list_transform(o[1:j], lambda x: x.w)) > draw)[1]].v, -1)::BIGINT)
 FROM (SELECT *, {rand01_sql(str(seed), "'row'", 'u')} * list_sum(list_transform(o, lambda x: x.w)) AS draw
  FROM (SELECT rw.k, rw.u, turn.took, list_filter(rw.o, lambda x: x.v > rw.u OR x.k = 0 OR turn.took[x.k] <> rw.u) AS o FROM turn JOIN rw ON rw.k = turn.k + 1))),
t AS MATERIALIZED (SELECT DISTINCT least(own.u, x.v) AS u, greatest(own.u, x.v) AS v FROM own JOIN (SELECT unnest(range(1, len(took) + 1)) AS k, unnest(took) AS v FROM turn WHERE k = (SELECT count(*) FROM own)) x USING (k) WHERE x.v >= 0)"""


def filled(seed: int, target: str) -> str:
    """From s and t: the edges of t, and more of the upper triangle up to the target."""
    draw = f"{exponential_sql(str(seed), chr(39) + 'fill' + chr(39), 'u', 'v')} / w"
    return f"""fi AS (SELECT u, v, row_number() OVER (ORDER BY {draw}, u, v) AS k FROM s WHERE u < v AND w > 0 AND (u, v) NOT IN (SELECT (u, v) FROM t))
SELECT u, v FROM t UNION ALL SELECT u, v FROM fi WHERE k <= least({target}, (SELECT count(*) FROM s WHERE u < v AND w <> 0)) - (SELECT count(*) FROM t)"""


def generated(seed: int, count: int, length: int, facial: bool, n: int = 5) -> str:
    """From EVENTS: gw(walk, tokens) drawn from counts of what follows one or two tokens, smoothed by 0.1."""
    draw = lambda what, *more: rand01_sql(str(seed), "f", f"'{what}'", "walk", *more)
    banned = "CASE WHEN f <= 2 THEN free[1] ELSE free[f] END" if facial else "free[f]"
    copy = f"CASE WHEN f >= 2 AND len(tokens) + 1 < {length} THEN [CASE WHEN f = 2 THEN free[1] ELSE free[f] END] ELSE [] END" if facial else "[]"
    return f"""lw AS (SELECT pos, token, lag(token) OVER o AS p1, lag(token, 2) OVER o AS p2 FROM t WINDOW o AS (PARTITION BY walk ORDER BY pos)),
fo AS MATERIALIZED (SELECT 1 AS k, -1 AS p2, p1, token, count(*) AS n FROM lw WHERE pos > 0 GROUP BY ALL UNION ALL SELECT 2, p2, p1, token, count(*) FROM lw WHERE pos > 1 GROUP BY ALL),
ge(walk, f, tokens, free) AS (SELECT walk, 1, [{n}, a]::BIGINT[], [a]::BIGINT[] FROM (SELECT walk, floor({draw('free').replace("f, 'free'", "0, 'free'")} * {n})::BIGINT AS a FROM range({count}) r(walk)) UNION ALL
 SELECT walk, f + 1, list_concat(list_append(tokens, nxt), {copy}::BIGINT[]), list_append(free, nxt) FROM
 (SELECT *, CASE WHEN seen IS NULL OR {draw('mix')} * (mass + 0.1::DOUBLE * {n - 1}) < 0.1::DOUBLE * {n - 1} THEN other + (other >= banned)::INT ELSE seen END AS nxt FROM
  (SELECT walk, f, tokens, free, banned, floor({draw('free')} * {n - 1})::BIGINT AS other, sum(n) AS mass, arg_min(token, {exponential_sql(str(seed), 'f', "'seen'", 'walk', 'token')} / n) AS seen FROM
   (SELECT g.*, fo.token, fo.n FROM (SELECT *, {banned} AS banned FROM ge WHERE len(tokens) < {length}) g
    LEFT JOIN fo ON fo.p1 = g.tokens[-1] AND (fo.k = 1 OR fo.p2 = g.tokens[-2]) AND fo.token <> g.banned
    QUALIFY fo.k IS NOT DISTINCT FROM max(fo.k) OVER (PARTITION BY g.walk)) GROUP BY ALL))),
gw AS MATERIALIZED (SELECT walk, tokens FROM ge WHERE len(tokens) = {length})"""
