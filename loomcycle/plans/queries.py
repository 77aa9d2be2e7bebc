"""Registered queries over whole tables, each with SQL that says the same."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from loomcycle.functions.times import micros_of
from loomcycle.functions.sequences import after, before, bundle_text, cardinality, path_text, trim
from loomcycle.operators import bundle_search as P, bundles as B, cycles as C, edges as E, exploration as X, measures as M, overlap as O, seeds as S, static_cycles as K, summary as R
from loomcycle.plans import oracle as Q
from loomcycle.session import cut_lineage, ensure_checkpoint_dir, share, shares_of, written
from loomcycle.streaming.windows import CycleStream, read_found
from loomcycle.sources import files as I, sinks as W_
from loomcycle.sources.derived import event_edges, table, token_edges

DAY = Q.DAY
MONTH = 30 * DAY
HOUR = DAY // 24
_SIX_HOURS = DAY // 4

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(sql: str | None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _event_cycles(spark: SparkSession, sf: str) -> DataFrame:
    with _written_events(spark, sf) as edges:
        return C.temporal_cycles(edges, HOUR, on_disk=True)


def _written_events(spark: SparkSession, sf: str):
    """Written once, in shares of days."""
    n = shares_of(table(spark, sf, "events").count())
    return written(spark, (event_edges(spark, sf, share("day", k, n) if n > 1 else None) for k in range(n)))


def _event_seeds(spark: SparkSession, sf: str) -> DataFrame:
    return S.combined_seeds(S.reachability_seeds(event_edges(spark, sf), HOUR), HOUR)


def _bundles(edges: DataFrame, omega: int) -> tuple[DataFrame, DataFrame]:
    """Detection's main path: reachability gives seeds, whose subgraphs are searched by whole bundles. `edges` are written ones."""
    seeds = cut_lineage(S.combined_seeds(S.reachability_seeds(edges, omega, on_disk=True), omega))
    return seeds, P.bundled_cycles(edges, seeds, shares=shares_of(edges.count()))


def _event_bundles(spark: SparkSession, sf: str) -> DataFrame:
    with written(spark, [event_edges(spark, sf)]) as edges:
        return _bundles(edges, HOUR)[1]


def _written_tokens(spark: SparkSession, sf: str):
    """Written once: the join and the sort of all lines behind it would run again for each use."""
    n = shares_of(table(spark, sf, "lineitem").count())
    return written(spark, (token_edges(spark, sf, share("l_partkey", k, n) if n > 1 else None) for k in range(n)))


def _token_bundles(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bundles, seeds and the bundles' edges."""
    with _written_tokens(spark, sf) as edges:
        seeds, found = _bundles(edges, MONTH)
        n = shares_of(edges.count())
        with written(spark, (B.to_edges(found, edges.where(share("src", k, n)) if n > 1 else edges) for k in range(n))) as rows:
            return found, seeds, cut_lineage(rows)


def _token_bundle_edges(spark: SparkSession, sf: str) -> DataFrame:
    return _token_bundles(spark, sf)[-1]


def _numbered(bundle_edges: DataFrame) -> DataFrame:
    """cycle (rank of the bundle's name), begin, end, vertices."""
    spans = bundle_edges.groupBy("bundle").agg(F.min("t").alias("begin"), F.max("t").alias("end"), F.collect_set("src").alias("vertices"))
    return O.ranked(spans, "bundle").select(F.col("rank").cast("long").alias("cycle"), "begin", "end", "vertices")


# --- detection -------------------------------------------------------------------------------------------------

_EVENT = [Q.EVENTS, Q.cycles("event_edges", HOUR)]
_SEEDS = Q.seeded("event_edges", HOUR)
_CYCLE_TEXT = "SELECT root, t_start, t_end, length, array_to_string(path, '>') AS path, array_to_string(times, '>') AS times, array_to_string(keys, '>') AS edge_keys FROM cycles"


def _cycle_text(found: DataFrame) -> DataFrame:
    return found.select("root", "t_start", "t_end", "length", *[path_text(F.col(c)).alias(c) for c in ("path", "times", "edge_keys")])


@register(Q.with_(*_EVENT) + _CYCLE_TEXT)
def cycles_event_1h(spark, sf):
    return _cycle_text(_event_cycles(spark, sf))


@register(Q.with_(Q.EVENTS, Q.cycles("event_edges", _SIX_HOURS)) + _CYCLE_TEXT)
def cycles_event_6h(spark, sf):
    with _written_events(spark, sf) as edges:
        return _cycle_text(C.temporal_cycles(edges, _SIX_HOURS, on_disk=True))


@register(Q.with_(Q.TOKENS, Q.cycles("token_edges", MONTH)) + _CYCLE_TEXT)
def cycles_token_30d(spark, sf):
    return _cycle_text(C.temporal_cycles(token_edges(spark, sf), MONTH))


@register(Q.with_(*_EVENT) + "SELECT length, count(*) AS cycles, count(DISTINCT root) AS roots FROM cycles GROUP BY 1")
def cycle_counts(spark, sf):
    return _event_cycles(spark, sf).groupBy("length").agg(F.count("*").alias("cycles"), F.count_distinct("root").alias("roots"))


@register(Q.with_(Q.EVENTS) + "SELECT a.src AS u, a.dst AS v, a.t AS t1, b.t AS t2 FROM event_edges a JOIN event_edges b ON a.dst = b.src AND b.dst = a.src AND b.t > a.t")
def digons(spark, sf):
    return C.temporal_digons(event_edges(spark, sf))


_TRIANGLE = f"""SELECT a.src AS u, b.src AS v, c.src AS w, a.t AS t1, b.t AS t2, c.t AS t3 FROM event_edges a
JOIN event_edges b ON b.src = a.dst AND b.t > a.t AND b.t < a.t + {DAY} AND b.dst <> a.src
JOIN event_edges c ON c.src = b.dst AND c.dst = a.src AND c.t > b.t AND c.t < a.t + {DAY}"""


@register(Q.with_(Q.EVENTS) + _TRIANGLE)
def triangles(spark, sf):
    return C.temporal_triangles(event_edges(spark, sf), DAY, chordless=False)


@register(Q.with_(Q.EVENTS, "p AS (SELECT DISTINCT src, dst FROM event_edges)", f"x AS ({_TRIANGLE})") + """SELECT * FROM x
WHERE NOT EXISTS (SELECT 1 FROM p WHERE src = v AND dst = u) AND NOT EXISTS (SELECT 1 FROM p WHERE src = w AND dst = v) AND NOT EXISTS (SELECT 1 FROM p WHERE src = u AND dst = w)""")  # fmt: skip
def triangles_chordless(spark, sf):
    return C.temporal_triangles(event_edges(spark, sf), DAY)


@register(Q.with_(*_SEEDS) + "SELECT root, b AS begin, e AS \"end\", array_to_string(c, ',') AS candidates FROM raw")
def seeds_raw(spark, sf):
    return S.reachability_seeds(event_edges(spark, sf), HOUR).withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@register(Q.with_(*_SEEDS) + "SELECT root, s_begin AS begin, s_end AS \"end\", next_begin, array_to_string(candidates, ',') AS candidates FROM seeds")
def seeds_combined(spark, sf):
    return _event_seeds(spark, sf).withColumn("candidates", F.array_join(F.col("candidates").cast("array<string>"), ","))


@register(Q.with_(*_SEEDS) + "SELECT root, count(*) AS seeds, round(avg((s_end - s_begin) / 1e6), 3) AS mean_duration, max((s_end - s_begin) / 1e6) AS max_duration FROM seeds GROUP BY 1")
def seed_statistics(spark, sf):
    return X.seed_statistics(_event_seeds(spark, sf)).withColumn("mean_duration", F.round("mean_duration", 3))


_LAST = "(SELECT max(t) FROM event_edges)"


@register(Q.with_(*_SEEDS) + f"SELECT root, s_begin AS begin, s_end AS \"end\" FROM seeds WHERE s_end <= {_LAST} - {10 * DAY}")
def seeds_primed(spark, sf):
    edges = event_edges(spark, sf)
    now = edges.agg(F.max("t")).first()[0] - 10 * DAY + HOUR
    return S.primed(_event_seeds(spark, sf), now, HOUR).select("root", "begin", "end")


@register(Q.with_(*_SEEDS) + """SELECT root, begin, "end" FROM (SELECT root, b AS begin, e AS "end", row_number() OVER (PARTITION BY root ORDER BY b, e DESC) AS n FROM raw) WHERE n = 1""")
def first_interval_per_root(spark, sf):
    return O.first_per_group(S.reachability_seeds(event_edges(spark, sf), HOUR), ["root"]).select("root", "begin", "end")


_WEEK_IN = f"(SELECT min(t) + {3 * DAY} FROM event_edges)"


@register(Q.with_(*_SEEDS) + f"""SELECT root, s_begin AS begin, s_end AS "end" FROM seeds WHERE s_begin >= {_WEEK_IN} AND s_end <= {_WEEK_IN} + {7 * DAY}""")
def seeds_enveloped(spark, sf):
    edges = event_edges(spark, sf)
    lo = edges.agg(F.min("t")).first()[0] + 3 * DAY
    return S.enveloped(_event_seeds(spark, sf), lo, lo + 7 * DAY).select("root", "begin", "end")


@register(Q.with_(*Q.bundled("token_edges", MONTH)) + "SELECT DISTINCT concat_ws('|', root, s_begin, array_to_string(path, '>')) AS bundle, root, array_to_string(path, '>') AS path FROM assigned")
def path_bundles(spark, sf):
    return B.path_bundle(_token_bundle_edges(spark, sf)).select("bundle", "root", path_text(F.col("path")).alias("path"))


_REACH = Q.reach("event_edges", _SIX_HOURS)


@register(Q.with_(Q.EVENTS, _REACH) + "SELECT v, x, tx, min(ta) AS ta FROM reach GROUP BY 1, 2, 3")
def reverse_reachability(spark, sf):
    return S.reverse_reachability(event_edges(spark, sf), _SIX_HOURS)


@register(Q.with_(Q.EVENTS, f"""s AS (SELECT dst AS v, src AS x, t FROM event_edges),
m AS (SELECT v, x, t FROM s UNION SELECT e.dst, s.x, s.t FROM s JOIN event_edges e ON e.src = s.v),
c AS (SELECT * FROM m WHERE v <> x AND t > (SELECT min(t) FROM event_edges) + {DAY})""") + "SELECT v, count(*) AS points, count(DISTINCT x) AS vertices, count(DISTINCT t) AS times FROM c GROUP BY 1")
def summary_sizes(spark, sf):
    edges = event_edges(spark, sf)
    points = edges.select(F.col("dst").alias("v"), F.col("src").alias("x"), "t")
    into = edges.select(F.col("src").alias("a"), F.col("dst").alias("b")).distinct()
    first = edges.agg(F.min("t")).first()[0]
    return R.sizes(R.cut(R.exclude(R.merge(points, points, into)), first + DAY))


@register(Q.with_(Q.EVENTS, _REACH) + f"SELECT DISTINCT r.x AS root, r.tx AS begin, e.t AS \"end\" FROM reach r JOIN event_edges e ON e.src = r.v AND e.dst = r.x AND e.t > r.ta AND e.t < r.tx + {_SIX_HOURS}")
def return_walks(spark, sf):
    return S.return_walks(event_edges(spark, sf), _SIX_HOURS)


@register(Q.with_(*_SEEDS) + """SELECT s.root AS seed_root, s.s_begin AS begin, count(*) AS edges, CAST(sum(e.t - s.s_begin) AS BIGINT) AS offset_sum
FROM seeds s JOIN event_edges e ON e.t BETWEEN s.s_begin AND s.s_end AND list_contains(s.candidates, e.src) AND list_contains(s.candidates, e.dst) GROUP BY 1, 2""")  # fmt: skip
def seed_subgraphs(spark, sf):
    found = S.seed_subgraph(_event_seeds(spark, sf), event_edges(spark, sf))
    return found.groupBy("seed_root", "begin").agg(F.count("*").alias("edges"), F.sum(F.col("t") - F.col("begin")).alias("offset_sum"))


# --- bundles and measures --------------------------------------------------------------------------------------

_BUNDLE_ROWS = """, per_hop AS (SELECT root, s_begin, s_end, path, hop, array_to_string(list_sort(list(t)), ',') AS ts FROM hop_times GROUP BY ALL),
shape AS (SELECT root, s_begin, s_end, path, string_agg(ts, ';' ORDER BY hop) AS bundle FROM per_hop GROUP BY ALL)
SELECT s.root, s.s_begin AS begin, s.s_end AS "end", array_to_string(s.path, '>') AS path, s.bundle, count(*) AS cardinality
FROM shape s JOIN assigned a ON a.root = s.root AND a.s_begin = s.s_begin AND a.path = s.path GROUP BY ALL"""


@register(Q.with_(*Q.bundled("event_edges", HOUR)) + _BUNDLE_ROWS)
def bundle_cardinality(spark, sf):
    found = _event_bundles(spark, sf)
    return found.select("root", "begin", "end", path_text(F.col("path")).alias("path"), bundle_text(F.col("bundle")).alias("bundle"), "cardinality")


@register(Q.with_(*Q.bundled("token_edges", MONTH)) + _BUNDLE_ROWS)
def bundles_token_30d(spark, sf):
    """Order dates repeat, so parallel edges of one time count apart."""
    with _written_tokens(spark, sf) as edges:
        _, found = _bundles(edges, MONTH)
    return found.select("root", "begin", "end", path_text(F.col("path")).alias("path"), bundle_text(F.col("bundle")).alias("bundle"), "cardinality")


@register(Q.with_(*Q.bundled("event_edges", HOUR)) + _BUNDLE_ROWS)
def bundles_enumerated(spark, sf):
    """The same bundles grouped from single cycles."""
    edges = event_edges(spark, sf)
    found = C.temporal_cycles(edges, HOUR)
    grouped = B.bundles(B.assign(found, S.combined_seeds(S.raw_seeds(found), HOUR)))
    return grouped.select("root", "begin", "end", path_text(F.col("path")).alias("path"), bundle_text(F.col("bundle")).alias("bundle"), "cardinality")


@register(Q.with_(*Q.bundled("event_edges", HOUR)) + "SELECT root, s_begin AS begin, array_to_string(path, '>') AS path, count(*) AS choices FROM assigned GROUP BY ALL")
def bundle_choices(spark, sf):
    """Cardinality by the fold over hop times (event times are distinct, so it equals the enumerated count)."""
    found = _event_bundles(spark, sf)
    return found.select("root", "begin", path_text(F.col("path")).alias("path"), cardinality(trim(F.col("bundle"))).alias("choices"))


@register(Q.with_(*Q.bundled("token_edges", MONTH)) + "SELECT bundle, src, dst, t, edge_key, token_id, price_usd FROM bundle_edges")
def bundle_edges(spark, sf):
    return _token_bundle_edges(spark, sf).select("bundle", "src", "dst", "t", "edge_key", "token_id", "price_usd")


@register(Q.with_(*Q.bundled("token_edges", MONTH)) + """SELECT bundle, count(*) AS edges, count(DISTINCT src) AS nodes, min(t) AS begin, max(t) AS "end", (max(t) - min(t)) / 1e6 AS duration,
CASE WHEN max(t) > min(t) THEN count(*) / count(DISTINCT src) / ((max(t) - min(t)) / 1e6) END AS rate FROM bundle_edges GROUP BY 1""")  # fmt: skip
def cycle_measures(spark, sf):
    return M.graph_counts(_token_bundle_edges(spark, sf))


@register(Q.with_(*Q.bundled("token_edges", MONTH), Q.DWELL) + "SELECT * FROM dwell")
def dwell_min(spark, sf):
    return M.aggregate_dwell(M.dwell_times(_token_bundle_edges(spark, sf)))


@register(Q.with_(*Q.bundled("token_edges", MONTH), Q.DWELL) + """SELECT bundle, round(avg(dwell), 3) AS avg_dwell,
round(CASE WHEN stddev_pop(dwell) = avg(dwell) THEN 0 ELSE (stddev_pop(dwell) - avg(dwell)) / (stddev_pop(dwell) + avg(dwell)) END, 6) AS burstiness FROM dwell GROUP BY 1""")  # fmt: skip
def burstiness(spark, sf):
    return M.dwell_statistics(_token_bundle_edges(spark, sf)).select("bundle", F.round("avg_dwell", 3).alias("avg_dwell"), F.round("burstiness", 6).alias("burstiness"))


@register(Q.with_(*Q.bundled("token_edges", MONTH), """tokens AS (SELECT bundle, token_id, count(*) AS n, arg_max(price_usd, (t, price_usd)) - arg_min(price_usd, (t, price_usd)) AS delta FROM bundle_edges GROUP BY 1, 2)""")
          + "SELECT bundle, round(sum(delta) FILTER (WHERE n > 1) / count(*), 4) AS price_delta FROM tokens GROUP BY 1")
def price_delta(spark, sf):
    return M.price_delta(_token_bundle_edges(spark, sf)).select("bundle", F.round("price_delta", 4).alias("price_delta"))


_PAIRED = [*Q.bundled("token_edges", MONTH), Q.SPANS]


@register(Q.with_(*_PAIRED, Q.PAIRS.format(slack=MONTH)) + "SELECT i, j FROM pairs")
def overlap_pairs(spark, sf):
    return O.overlap_pairs(_numbered(_token_bundle_edges(spark, sf)), MONTH)


@register(Q.with_(*_PAIRED, Q.PAIRS.format(slack=MONTH), Q.LABELS) + "SELECT cycle, component FROM labels")
def cycle_components(spark, sf):
    return O.cycle_components(_numbered(_token_bundle_edges(spark, sf)), MONTH)


@register(Q.with_(*_PAIRED, Q.PAIRS.format(slack=MONTH), Q.LABELS, "joined AS (SELECT * FROM labels JOIN ids USING (cycle))")
          + """SELECT component, min(b) AS begin, max(e) AS "end", round(avg((e - b) / 1e6), 3) AS avg_duration, array_to_string(list_sort(list(cycle)), ',') AS cycles,
array_to_string(list_sort(list_distinct(flatten(list(vs)))), ',') AS vertices FROM joined GROUP BY 1""")  # fmt: skip
def component_aggregates(spark, sf):
    cycles = _numbered(_token_bundle_edges(spark, sf))
    found = O.component_aggregates(cycles, O.cycle_components(cycles, MONTH))
    return found.select("component", "begin", "end", F.round("avg_duration", 3).alias("avg_duration"), *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("cycles", "vertices")])


@register(Q.with_(*_PAIRED, "marks AS (SELECT b AS k FROM ids UNION ALL SELECT e + 1 FROM ids)", "per AS (SELECT k, count(*) AS n, (row_number() OVER (ORDER BY k) - 1) // 10 AS chunk FROM marks GROUP BY k)")
          + "SELECT chunk, round(avg(k) / 1e6, 3) AS mean_key, CAST(sum(n) AS BIGINT) AS boundaries FROM per GROUP BY 1")
def boundary_table(spark, sf):
    return O.boundary_table(_numbered(_token_bundle_edges(spark, sf)), 10).withColumn("mean_key", F.round(F.col("mean_key") / 1e6, 3))


# --- edges -----------------------------------------------------------------------------------------------------


@register(Q.with_(Q.TOKENS) + "SELECT t, dst, array_to_string(list_sort(list(src)), ',') AS sources, count(*) AS n_sources FROM token_edges GROUP BY 1, 2")
def block_sources(spark, sf):
    return E.blocks(token_edges(spark, sf)).withColumn("sources", F.array_join(F.col("sources").cast("array<string>"), ","))


_MID = "(SELECT min(t) + (max(t) - min(t)) // 3 FROM token_edges)"


@register(Q.with_(Q.TOKENS) + f"SELECT src, dst, t, edge_key FROM token_edges WHERE t >= {_MID} AND t <= {_MID} + {30 * DAY} AND src % 3 <> 0 AND dst % 3 <> 0")
def time_slice(spark, sf):
    edges = token_edges(spark, sf)
    lo, hi = edges.agg(F.min("t"), F.max("t")).first()
    nodes = E.vertices(edges).where("vertex % 3 <> 0")
    return E.time_slice(edges, lo + (hi - lo) // 3, lo + (hi - lo) // 3 + 30 * DAY, nodes, closed=True).select("src", "dst", "t", "edge_key")


@register(Q.with_(Q.TOKENS) + f"SELECT src, dst, t, edge_key FROM token_edges WHERE t >= {_MID}")
def prune_older(spark, sf):
    edges = token_edges(spark, sf)
    lo, hi = edges.agg(F.min("t"), F.max("t")).first()
    return E.prune(edges, lo + (hi - lo) // 3).select("src", "dst", "t", "edge_key")


@register(Q.with_(Q.EVENTS, "ends AS (SELECT t, edge_key, 0 AS side, src AS vertex FROM event_edges UNION ALL SELECT t, edge_key, 1, dst FROM event_edges)",
                  "firsts AS (SELECT vertex, min((t, edge_key, side)) AS f FROM ends GROUP BY 1)") + "SELECT vertex, row_number() OVER (ORDER BY f) - 1 AS vertex_id FROM firsts")
def vertex_dictionary(spark, sf):
    return E.vertex_dictionary(event_edges(spark, sf))


@register(Q.with_(Q.EVENTS) + "SELECT src, dst, array_to_string(list_sort(list_distinct(list(t))), ',') AS ts FROM event_edges GROUP BY 1, 2")
def adjacency_times(spark, sf):
    return E.adjacency(event_edges(spark, sf)).withColumn("ts", F.array_join(F.col("ts").cast("array<string>"), ","))


@register(Q.with_(Q.EVENTS, f"a AS (SELECT src, list_sort(list_distinct(list(t))) AS ts, min(t) + {7 * DAY} AS cut FROM event_edges GROUP BY 1)")
          + "SELECT src, len(list_filter(ts, lambda x: x < cut)) AS n_before, len(list_filter(ts, lambda x: x >= cut)) AS n_after FROM a")
def sequence_cuts(spark, sf):
    a = event_edges(spark, sf).groupBy("src").agg(F.sort_array(F.collect_set("t")).alias("ts"), (F.min("t") + 7 * DAY).alias("cut"))
    return a.select("src", F.size(before(F.col("ts"), F.col("cut"))).alias("n_before"), F.size(after(F.col("ts"), F.col("cut"), include=True)).alias("n_after"))


@register(Q.with_(Q.EVENTS) + "SELECT src, dst, t, edge_key FROM event_edges WHERE src = 1 OR dst = 1")
def star_edges(spark, sf):
    return E.star(event_edges(spark, sf), 1).select("src", "dst", "t", "edge_key")


@register(Q.with_(Q.TOKENS, "q AS (SELECT token_id, quantile_cont(price_usd, 0.75) AS m FROM token_edges GROUP BY 1)") + "SELECT token_id, count(*) AS n FROM token_edges JOIN q USING (token_id) WHERE price_usd <= m GROUP BY 1")
def quantile_filter(spark, sf):
    return E.quantile_filter(token_edges(spark, sf), "price_usd", 0.75, ["token_id"]).groupBy("token_id").agg(F.count("*").alias("n"))


@register(Q.with_(Q.EVENTS, "ends AS (SELECT t, edge_key, 0 AS side, src AS vertex FROM event_edges UNION ALL SELECT t, edge_key, 1, dst FROM event_edges)",
                  "d AS (SELECT vertex, row_number() OVER (ORDER BY min((t, edge_key, side))) - 1 AS id FROM ends GROUP BY 1)")
          + "SELECT s.id AS src, x.id AS dst, e.t, e.edge_key FROM event_edges e JOIN d s ON s.vertex = e.src JOIN d x ON x.vertex = e.dst")
def encoded_edges(spark, sf):
    edges = event_edges(spark, sf)
    return E.encode(edges, E.vertex_dictionary(edges)).select("src", "dst", "t", "edge_key")


@register(Q.with_(Q.TOKENS) + "SELECT src, dst, t, edge_key FROM (SELECT *, row_number() OVER (PARTITION BY src, dst, t, edge_key) AS n FROM token_edges) WHERE n = 1")
def composed_edges(spark, sf):
    edges = token_edges(spark, sf)
    return E.compose(edges.unionByName(edges)).select("src", "dst", "t", "edge_key")


@register(Q.with_(Q.EVENTS) + "SELECT t // 600000000 AS block, src, dst FROM event_edges")
def retimed_edges(spark, sf):
    return E.retime(event_edges(spark, sf), F.floor(F.col("t") / 600_000_000)).withColumnRenamed("t", "block")


# --- exploration -----------------------------------------------------------------------------------------------


@register(Q.with_(Q.EVENTS, "o AS (SELECT src AS vertex, count(*) AS n FROM event_edges GROUP BY 1)", "i AS (SELECT dst AS vertex, count(*) AS n FROM event_edges GROUP BY 1)")
          + "SELECT vertex, coalesce(o.n, 0) AS out_degree, coalesce(i.n, 0) AS in_degree, coalesce(o.n, 0) + coalesce(i.n, 0) AS degree FROM o FULL JOIN i USING (vertex)")
def degrees(spark, sf):
    return X.degrees(event_edges(spark, sf))


@register(Q.with_(Q.EVENTS, "o AS (SELECT src AS vertex, count(*) AS sent FROM event_edges GROUP BY 1)", "i AS (SELECT dst AS vertex, max(t) AS last FROM event_edges GROUP BY 1)") + "SELECT vertex, sent, last FROM o FULL JOIN i USING (vertex)")
def aligned_on_index(spark, sf):
    edges = event_edges(spark, sf)
    sent = edges.groupBy(F.col("src").alias("vertex")).agg(F.count("*").alias("sent"))
    return X.align_on_index(sent, edges.groupBy(F.col("dst").alias("vertex")).agg(F.max("t").alias("last")), "vertex")


@register(Q.with_(Q.EVENTS) + "SELECT src, count(*) AS out_degree FROM event_edges GROUP BY 1 HAVING count(*) > 5")
def frequent_sources(spark, sf):
    return X.frequent_sources(event_edges(spark, sf), 5)


_SUMMARY = "min({0}) AS {1}_min, max({0}) AS {1}_max, round(avg({0}), 3) AS {1}_mean, round(quantile_cont({0}, 0.5), 3) AS {1}_median"


def _rounded(df: DataFrame, prefix: str) -> DataFrame:
    return df.withColumns({f"{prefix}_{c}": F.round(F.col(f"{prefix}_{c}").cast("double"), 3) for c in ("mean", "median")})


@register(Q.with_(Q.EVENTS, "g AS (SELECT src, t - lag(t) OVER (PARTITION BY src ORDER BY t) AS gap FROM event_edges)", "q AS (SELECT src, quantile_cont(gap, 0.9) AS m FROM g WHERE gap IS NOT NULL GROUP BY 1)")
          + "SELECT src, " + _SUMMARY.format("gap", "gap") + " FROM g JOIN q USING (src) WHERE gap <= m GROUP BY 1")
def interevent_quantiles(spark, sf):
    return _rounded(X.inter_event_times(event_edges(spark, sf), 0.9), "gap")


@register(Q.with_(Q.TOKENS, "g AS (SELECT src, dst, t - lag(t) OVER (PARTITION BY src, dst ORDER BY t) AS gap FROM token_edges)", "m AS (SELECT dst, avg(gap) AS gap FROM g WHERE gap IS NOT NULL GROUP BY src, dst)")
          + "SELECT dst, " + _SUMMARY.format("gap", "gap") + " FROM m GROUP BY 1")
def incoming_interevent(spark, sf):
    return _rounded(X.incoming_inter_event_times(token_edges(spark, sf)), "gap")


@register(Q.with_(Q.TOKENS, "m AS (SELECT dst, count(*) AS n FROM token_edges GROUP BY src, dst)") + "SELECT dst, " + _SUMMARY.format("n", "edges") + " FROM m GROUP BY 1")
def multiplicity(spark, sf):
    return _rounded(X.multiplicity(token_edges(spark, sf)), "edges")


@register(Q.with_(Q.EVENTS, f"n AS (SELECT t // {DAY} AS day, src AS v FROM event_edges UNION SELECT t // {DAY}, dst FROM event_edges)", "c AS (SELECT day, count(*) AS nodes FROM n GROUP BY 1)",
                  f"m AS (SELECT t // {DAY} AS day, count(*) AS edges FROM event_edges GROUP BY 1)")
          + "SELECT day, edges, nodes, edges / nodes AS edges_per_node, CASE WHEN nodes > 1 THEN edges / (nodes * (nodes - 1)) END AS density FROM m JOIN c USING (day)")
def daily_features(spark, sf):
    return X.graph_features(event_edges(spark, sf), F.floor(F.col("t") / DAY), "day")


@register("SELECT CAST(least(floor((l_extendedprice - 0) / 5000.0) + 1, 20) AS INTEGER) AS bin, count(*) AS count FROM lineitem WHERE l_extendedprice BETWEEN 0 AND 100000 GROUP BY 1")
def price_histogram(spark, sf):
    return X.histogram(table(spark, sf, "lineitem"), "l_extendedprice", 20, 0.0, 100000.0)


_EDGES = X.adaptive_edges(1.0, 100_000.0, 12)
_CASES = " ".join(f"WHEN l_extendedprice >= {a!r} AND l_extendedprice < {b!r} THEN {k}" for k, (a, b) in enumerate(zip(_EDGES, _EDGES[1:])))


@register(f"SELECT bin, count(*) AS count FROM (SELECT CASE {_CASES} END AS bin FROM lineitem) WHERE bin IS NOT NULL GROUP BY 1")
def adaptive_bins(spark, sf):
    return X.bin_counts(table(spark, sf, "lineitem"), "l_extendedprice", _EDGES)


@register("""SELECT event_id // 500 AS bucket, min(value) AS min, round(quantile_cont(value, 0.25), 6) AS q25, round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q75,
round(avg(value), 6) AS mean, max(value) AS max FROM events GROUP BY 1""")  # fmt: skip
def time_bucket_stats(spark, sf):
    found = X.time_buckets(table(spark, sf, "events"), "event_id", 500, "value")
    return found.withColumns({c: F.round(c, 6) for c in ("q25", "median", "q75", "mean")})


@register("SELECT event_type, event_id, epoch_us(ts) - min(epoch_us(ts)) OVER (PARTITION BY event_type) AS t FROM events")
def rebased_times(spark, sf):
    rows = table(spark, sf, "events").select("event_type", "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"))
    return X.rebase(rows, "t", ["event_type"])


@register(Q.with_(*_EVENT) + "SELECT length, count(*) AS count FROM cycles GROUP BY 1")
def cycle_size_counts(spark, sf):
    return X.value_counts(_event_cycles(spark, sf), "length")


_RUNS = """runs AS (SELECT event_type AS run, ms, CAST(row_number() OVER (PARTITION BY event_type ORDER BY ms) AS DOUBLE) AS value
FROM (SELECT DISTINCT event_type, epoch_ms(ts) - min(epoch_ms(ts)) OVER (PARTITION BY event_type) AS ms FROM events))"""


def _runs(spark: SparkSession, sf: str) -> DataFrame:
    ms = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000)
    rows = X.rebase(table(spark, sf, "events").select(F.col("event_type").alias("run"), ms.alias("ms")).distinct(), "ms", ["run"])
    from pyspark.sql import Window as W

    return rows.withColumn("value", F.row_number().over(W.partitionBy("run").orderBy("ms")).cast("double"))


_STEP = 6 * 3_600_000


@register(Q.with_(_RUNS, f"g AS (SELECT run, unnest(range(0, max(ms) // {_STEP} * {_STEP} + 1, {_STEP})) AS ms FROM runs GROUP BY run)", """
met AS (SELECT g.run, g.ms, (SELECT max(r.ms) FROM runs r WHERE r.run = g.run AND r.ms <= g.ms) AS lo, (SELECT min(r.ms) FROM runs r WHERE r.run = g.run AND r.ms >= g.ms) AS hi FROM g)""")
          + """SELECT met.ms, round(avg(CASE WHEN hi > lo THEN a.value + (b.value - a.value) * (met.ms - lo) / (hi - lo) ELSE a.value END), 2) AS mean_value, count(*) AS runs
FROM met JOIN runs a ON a.run = met.run AND a.ms = lo JOIN runs b ON b.run = met.run AND b.ms = hi GROUP BY 1""")  # fmt: skip
def cross_run_mean(spark, sf):
    return X.cross_run_mean(_runs(spark, sf), _STEP).withColumn("mean_value", F.round("mean_value", 2))


def _savgol_sql(window: int = 11, order: int = 2) -> str:
    """Every place of the window with its weights."""
    cases = " ".join(f"WHEN spot = {k} THEN " + " + ".join(f"{c!r} * v[f + {i}]" for i, c in enumerate(X.savgol_coefficients(window, order, k), 1)) for k in range(window))
    return f"""WITH d AS (SELECT date_trunc('day', ts) AS day, CAST(count(*) AS DOUBLE) AS n FROM events GROUP BY 1),
a AS (SELECT list(n ORDER BY day) AS v, count(*) AS m FROM d), r AS (SELECT day, n, row_number() OVER (ORDER BY day) - 1 AS i FROM d),
p AS (SELECT day, n, v, greatest(0, least(i - {window // 2}, m - {window})) AS f, i - greatest(0, least(i - {window // 2}, m - {window})) AS spot, m FROM r, a)
SELECT CAST(epoch_us(day) // {DAY} AS BIGINT) AS day, n, round(CASE WHEN m < {window} THEN NULL {cases} END, 6) AS smoothed FROM p"""


@register(_savgol_sql())
def smoothed_daily_counts(spark, sf):
    days = table(spark, sf, "events").groupBy(F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / DAY).alias("day")).agg(F.count("*").cast("double").alias("n"))
    found = X.savgol(days.withColumn("series", F.lit(1)), ["series"], "day", "n")
    return found.select("day", "n", F.round("smoothed", 6).alias("smoothed"))


# --- static graph ----------------------------------------------------------------------------------------------


def _static(length: int) -> str:
    return f"""p AS (SELECT DISTINCT src, dst FROM event_edges),
walk AS (SELECT src AS root, dst AS cur, [src] AS path FROM p WHERE src < dst
  UNION ALL SELECT w.root, p.dst, list_append(w.path, w.cur) FROM walk w JOIN p ON p.src = w.cur
  WHERE w.cur <> w.root AND len(w.path) < {length} AND p.dst >= w.root AND (p.dst = w.root OR NOT list_contains(list_append(w.path, w.cur), p.dst))),
closed AS (SELECT path FROM walk WHERE cur = root AND len(path) > 1)"""


@register(Q.with_(Q.EVENTS, _static(3)) + "SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS length FROM closed")
def static_cycles(spark, sf):
    return K.static_cycles(event_edges(spark, sf), 3).withColumn("path", path_text(F.col("path")))


@register(Q.with_(Q.EVENTS, _static(3)) + """SELECT array_to_string(path, '>') AS path, CAST(len(path) AS INTEGER) AS length FROM closed WHERE len(path) = 2 OR NOT EXISTS (
SELECT 1 FROM range(1, len(path) + 1) a(i), range(1, len(path) + 1) b(j), p WHERE i <> j AND j <> i % len(path) + 1 AND p.src = path[i] AND p.dst = path[j])""")  # fmt: skip
def static_chordless_cycles(spark, sf):
    return K.static_cycles(event_edges(spark, sf), 3, chordless=True).withColumn("path", path_text(F.col("path")))


@register(Q.with_(Q.EVENTS, "s AS (SELECT DISTINCT src, dst FROM event_edges)", "r AS (SELECT src AS a, src AS b FROM s UNION SELECT dst, dst FROM s UNION SELECT r.a, s.dst FROM r JOIN s ON s.src = r.b)")
          + "SELECT x.a AS node, min(x.b) AS component FROM r x JOIN r y ON y.a = x.b AND y.b = x.a GROUP BY 1")
def strong_components(spark, sf):
    return O.strongly_connected_components(event_edges(spark, sf))


# --- sources, sinks, streams -------------------------------------------------------------------------------------


@register(Q.with_(*Q.bundled("token_edges", MONTH)) + """SELECT bundle, CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, t, CAST(edge_key AS VARCHAR) AS edge_key, CAST(token_id AS VARCHAR) AS token_id, price_usd FROM bundle_edges""")
def graph_json_round_trip(spark, sf):
    rows = W_.graph_json(_token_bundle_edges(spark, sf))
    decoded = rows.withColumn("graph", I.decode_graph(F.col("graph")))
    return I.graph_edges(decoded, keep=["bundle"]).select("bundle", "src", "dst", "t", "edge_key", "token_id", "price_usd")


@register(Q.with_(*Q.bundled("token_edges", MONTH)) + """SELECT DISTINCT concat_ws('|', a.root, a.s_begin, array_to_string(a.path, '>')) AS bundle, s.s_begin / 1e6 AS seed_begin, s.s_end / 1e6 AS seed_end, s.next_begin / 1e6 AS next_seed_begin,
'["' || array_to_string(s.candidates, '","') || '"]' AS candidates FROM assigned a JOIN seeds s ON s.root = a.root AND s.s_begin = a.s_begin""")  # fmt: skip
def cycle_table(spark, sf):
    return W_.cycle_table(*_token_bundles(spark, sf)).drop("graph")


@register("SELECT event_id, epoch_us(ts) AS from_text, epoch_us(date_trunc('second', ts)) AS from_seconds, epoch_us(ts) AS from_timestamp FROM events")
def timestamp_extraction(spark, sf):
    e = table(spark, sf, "events")
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("double")
    return e.select("event_id", micros_of(text, "string").alias("from_text"), micros_of(seconds, "double").alias("from_seconds"), micros_of(F.col("ts"), "timestamp_ntz").alias("from_timestamp"))


@register("SELECT o_orderkey AS src, l_linenumber AS dst, l_extendedprice AS price_usd FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey % 5 <> 0 AND l_linenumber = o_custkey % 5 AND l_discount > 0.02")
def trade_filter(spark, sf):
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = both.select(F.col("o_orderkey").alias("from"), F.col("l_linenumber").alias("to"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 5).alias("buyer"), F.when(F.col("l_discount") > 0.02, F.col("l_extendedprice")).alias("price_usd"))
    return E.from_transactions(E.clean_trades(rows))


@register(Q.with_(Q.EVENTS, Q.cycles("event_edges", _SIX_HOURS)) + "SELECT root, t_start, t_end, length, array_to_string(path, '>') AS path, array_to_string(times, '>') AS times FROM cycles")
def streaming_cycles_6h(spark, sf):
    """Edges from files that are there already; a last edge far beyond the end flushes the open windows."""
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/stream-{uuid.uuid4().hex}"
    edges = event_edges(spark, sf).withColumn("ts", F.timestamp_micros("t")).drop("t")
    edges.write.parquet(f"{folder}/in")
    edges.agg(F.lit(0).cast("long").alias("src"), F.lit(0).cast("long").alias("dst"), F.lit(-1).cast("long").alias("edge_key"), F.timestamp_micros(F.unix_micros(F.max("ts")) + 9 * _SIX_HOURS).alias("ts")).write.mode("append").parquet(f"{folder}/in")
    stream = spark.readStream.schema(edges.schema).parquet(f"{folder}/in")
    CycleStream(_SIX_HOURS, f"{folder}/found").start(stream, availableNow=True).awaitTermination()
    rows = read_found(spark, f"{folder}/found")
    return rows.select("root", "t_start", "t_end", "length", path_text(F.col("path")).alias("path"), path_text(F.col("times")).alias("times"))
