"""DuckDB SQL for the registered queries: independent of the engine, on the same Parquet tables."""

from __future__ import annotations

DAY = 86_400_000_000

EVENTS = """event_edges AS (
  SELECT * FROM (SELECT user_id AS src, lead(user_id) OVER w AS dst, epoch_us(lead(ts) OVER w) AS t, lead(event_id) OVER w AS edge_key
                 FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts, event_id))
  WHERE dst IS NOT NULL AND src <> dst)"""
TOKENS = """token_edges AS (
  SELECT * FROM (SELECT o_custkey AS src, lead(o_custkey) OVER w AS dst, epoch_us(lead(o_orderdate) OVER w) AS t, l_partkey AS token_id,
                        lead(l_extendedprice) OVER w AS price_usd, lead(l_orderkey * 8 + l_linenumber) OVER w AS edge_key
                 FROM lineitem JOIN orders ON l_orderkey = o_orderkey WINDOW w AS (PARTITION BY l_partkey ORDER BY o_orderdate, l_orderkey, l_linenumber, l_extendedprice, l_suppkey))
  WHERE dst IS NOT NULL AND src <> dst)"""


def cycles(edges: str, omega: int, name: str = "cycles") -> str:
    return f"""walk AS (
  SELECT src AS root, t AS t_start, t AS t_end, dst AS cur, [src] AS path, [t] AS times, [edge_key] AS keys, false AS closed FROM {edges}
  UNION ALL
  SELECT p.root, p.t_start, e.t, e.dst, list_append(p.path, p.cur), list_append(p.times, e.t), list_append(p.keys, e.edge_key), e.dst = p.root
  FROM walk p JOIN {edges} e ON e.src = p.cur AND e.t > p.t_end AND e.t < p.t_start + {omega}
  WHERE NOT p.closed AND (e.dst = p.root OR NOT list_contains(list_append(p.path, p.cur), e.dst))
), {name} AS (SELECT root, t_start, t_end, len(path) AS length, path, times, keys FROM walk WHERE closed)"""


def reach(edges: str, omega: int) -> str:
    return f"""reach AS (
  SELECT dst AS v, src AS x, t AS tx, t AS ta FROM {edges}
  UNION SELECT e.dst, r.x, r.tx, e.t FROM reach r JOIN {edges} e ON e.src = r.v AND e.t > r.ta AND e.t < r.tx + {omega} AND e.dst <> r.x)"""


#: Seeds from reachability alone, then their greedy combination, row by row.
SEEDS = """back AS (SELECT DISTINCT r.x AS root, r.tx AS b, e.t AS e, r.v AS last FROM reach r JOIN {edges} e ON e.src = r.v AND e.dst = r.x AND e.t > r.ta AND e.t < r.tx + {omega}),
on_walk AS (SELECT root, b, e, root AS c FROM back UNION SELECT root, b, e, last FROM back
            UNION SELECT k.root, k.b, k.e, o.x FROM back k JOIN reach o ON o.v = k.last AND o.tx > k.b AND o.ta < k.e AND o.x <> k.root
                  JOIN reach i ON i.x = k.root AND i.tx = k.b AND i.v = o.x AND i.ta < o.tx),
raw AS (SELECT root, b, e, list_sort(list(c)) AS c FROM on_walk GROUP BY 1, 2, 3),
numbered AS (SELECT *, row_number() OVER (PARTITION BY root ORDER BY b, e DESC) AS n FROM raw),
fold AS (
  SELECT root, n, b AS g, b, e FROM numbered WHERE n = 1
  UNION ALL
  SELECT f.root, x.n, CASE WHEN x.e < f.g + {omega} THEN f.g ELSE x.b END, x.b, x.e FROM fold f JOIN numbered x ON x.root = f.root AND x.n = f.n + 1
), groups AS (SELECT f.root, f.g AS s_begin, max(f.e) AS s_end, list_sort(list_distinct(flatten(list(x.c)))) AS candidates
              FROM fold f JOIN numbered x USING (root, n) GROUP BY 1, 2),
seeds AS (SELECT *, coalesce(lead(s_begin) OVER (PARTITION BY root ORDER BY s_begin), s_begin + {omega}) AS next_begin FROM groups)"""

BUNDLES = """assigned AS (SELECT c.*, s.s_begin, s.s_end FROM cycles c JOIN seeds s ON s.root = c.root AND c.t_start >= s.s_begin AND c.t_start < s.next_begin),
hop_times AS (SELECT DISTINCT root, s_begin, s_end, path, unnest(range(1, len(path) + 1)) AS hop, unnest(times) AS t FROM assigned),
bundle_edges AS (
  SELECT concat_ws('|', h.root, h.s_begin, array_to_string(h.path, '>')) AS bundle, h.root, e.* FROM hop_times h
  JOIN {edges} e ON e.src = h.path[h.hop] AND e.dst = coalesce(h.path[h.hop + 1], h.root) AND e.t = h.t)"""


def with_(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n"


def seeded(edges: str, omega: int) -> list[str]:
    return [EVENTS if edges == "event_edges" else TOKENS, reach(edges, omega), SEEDS.format(edges=edges, omega=omega)]


def bundled(edges: str, omega: int) -> list[str]:
    return [*seeded(edges, omega), cycles(edges, omega), BUNDLES.format(edges=edges)]


DWELL = """arrivals AS (SELECT bundle, src AS sender, dst AS intermediate, t AS t_in, lead(t) OVER (PARTITION BY bundle, src, dst ORDER BY t) AS next_t FROM bundle_edges),
dwell AS (SELECT a.bundle, a.intermediate, a.sender, min((o.t - a.t_in) / 1e6) AS dwell FROM arrivals a
          JOIN bundle_edges o ON o.bundle = a.bundle AND o.src = a.intermediate AND o.t > a.t_in AND (a.next_t IS NULL OR o.t <= a.next_t) GROUP BY 1, 2, 3)"""

SPANS = """spans AS (SELECT bundle, min(t) AS b, max(t) AS e, list_distinct(list(src)) AS vs FROM bundle_edges GROUP BY 1),
ids AS (SELECT row_number() OVER (ORDER BY bundle) AS cycle, b, e, vs FROM spans)"""
PAIRS = """members AS (SELECT cycle, b, e, unnest(vs) AS v FROM ids),
pairs AS (SELECT DISTINCT x.cycle AS i, y.cycle AS j FROM members x JOIN members y ON x.v = y.v AND x.cycle < y.cycle
          AND y.b - {slack} < x.e AND y.e + {slack} > x.b)"""
LABELS = """both_ways AS (SELECT i AS a, j AS b FROM pairs UNION SELECT j, i FROM pairs),
flood AS (SELECT DISTINCT a AS node, a AS label FROM both_ways UNION SELECT w.b, f.label FROM flood f JOIN both_ways w ON w.a = f.node),
labels AS (SELECT node AS cycle, min(label) AS component FROM flood GROUP BY 1)"""
