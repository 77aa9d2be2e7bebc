import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomcycle.functions.sequences import after, before, cardinality, split_index, trim
from loomcycle.operators import bundle_search as P, bundles as B, cycles as C, edges as E, exploration as X, measures as M, overlap as O, seeds as S, static_cycles as K, summary as R
from loomcycle.operators.components import connected_components
from tests import brute

EDGE = "src string, dst string, t long, edge_key long"
EXAMPLE = "ac5 ab1 bc5 cd6 ce7 bc8 da8 bc10 ef10 ch11 fa12 hj13 hk14 kj15 jb16 ba17".split()


def frame(spark, rows):
    return spark.createDataFrame([(r[0], r[1], int(r[2:]), i) if isinstance(r, str) else r for i, r in enumerate(rows)], EDGE)


def bundle_rows(spark, rows, omega, length=8):
    found = C.temporal_cycles(frame(spark, rows), omega, length)
    seeds = S.combined_seeds(S.raw_seeds(found), omega)
    return found, seeds, B.bundles(B.assign(found, seeds))


def test_worked_example(spark):
    _, _, found = bundle_rows(spark, EXAMPLE, 17)
    got = {("".join(r.path), tuple(t[0] for t in r.bundle)): r.cardinality for r in found.where("root = 'a'").collect()}
    assert got == {
        ("ab", (1, 17)): 1, ("abcd", (1, 5, 6, 8)): 1, ("abcef", (1, 5, 7, 10, 12)): 1, ("acd", (5, 6, 8)): 1,
        ("acef", (5, 7, 10, 12)): 1, ("achjb", (5, 11, 13, 16, 17)): 1, ("achkjb", (5, 11, 14, 15, 16, 17)): 1,
    }


def test_reopening(spark):
    found = C.temporal_cycles(frame(spark, "sx1 sy1 xv2 yv4 vx6 xs8".split()), 10)
    assert {("".join(r.path), tuple(r.times)) for r in found.where("root = 's'").collect()} == {("sx", (1, 8)), ("syvx", (1, 4, 6, 8))}


def test_multi_edge_bundle(spark):
    rows = "ab1 ab3 bc2 bc4 ca5".split()
    _, _, found = bundle_rows(spark, rows, 10)
    (r,) = found.withColumn("n", cardinality(F.col("bundle"))).withColumn("same", trim(F.col("bundle")) == F.col("bundle")).where("root = 'a'").collect()
    assert (r.path, r.bundle, r.cardinality, r.n, r.same) == (["a", "b", "c"], [[1, 3], [2, 4], [5]], 3, 3, True)
    edges = B.to_edges(found.where("root = 'a'"), frame(spark, [(s[0], s[1], int(s[2:]) * 1_000_000, i) for i, s in enumerate(rows)]).withColumn("t", F.col("t") / 1_000_000))
    assert edges.count() == 5
    scaled = edges.withColumn("t", (F.col("t") * 1_000_000).cast("long"))
    stats = M.dwell_statistics(scaled).first()
    assert (stats.avg_dwell, stats.burstiness) == (1.0, -1.0)
    back = B.path_bundle(edges).first()
    assert (back.root, back.path, back.bundle_times) == ("a", ["a", "b", "c"], [[1, 3], [2, 4], [5]])


@pytest.mark.parametrize(("rows", "omega", "count"), [("ab1 bc1 ca2", 9, 0), ("ab1 ba1", 9, 0), ("ab0 bc1 ca5", 5, 0), ("ab0 bc1 ca5", 6, 1), ("aa1 ab2 bb3 ba4", 9, 1)])
def test_strictness(spark, rows, omega, count):
    assert (C.temporal_cycles(frame(spark, rows.split()), omega)).count() == count


def test_time_slice(spark):
    edges = frame(spark, "ab1 bc5 ca10".split())
    assert [E.time_slice(edges, 1, e, closed=c).count() for e in (5, 10) for c in (True, False)] == [2, 1, 3, 2]
    nodes = spark.createDataFrame([("a",), ("b",)], "n string")
    assert E.time_slice(edges, nodes=nodes).count() == 1
    assert E.prune(edges, 5).count() == 2


def test_seed_combination(spark):
    rows = [("r", 0, 3, ["r"]), ("r", 2, 4, ["r", "x"]), ("r", 7, 9, ["r"]), ("r", 8, 10, ["r", "y"])]
    got = S.combined_seeds(spark.createDataFrame(rows, "root string, begin long, end long, candidates array<string>"), 5).collect()
    assert sorted((r.begin, r.end, r.next_begin, r.candidates) for r in got) == [(0, 4, 7, ["r", "x"]), (7, 10, 12, ["r", "y"])]


def test_same_block_sources(spark):
    found, seeds, _ = bundle_rows(spark, "bx1 xp2 xq2 pb3 qb3".split(), 10)
    assert {"".join(r.path) for r in found.collect()} == {"bxp", "bxq"}
    assert [(r.root, r.begin, r.end, r.candidates) for r in seeds.collect()] == [("b", 1, 3, ["b", "p", "q", "x"])]
    assert {r.t: r.sources for r in E.blocks(frame(spark, "bx1 xp2 xq2 pb3 qb3".split())).where("dst = 'b'").collect()} == {3: ["p", "q"]}


def test_price_delta(spark):
    rows = [("k", 1, "1", 10.0), ("k", 2, "1", 14.0), ("k", 1, "2", 5.0), ("s", 1, "3", 1.0)]
    got = {r.bundle: r.price_delta for r in M.price_delta(spark.createDataFrame(rows, "bundle string, t long, token_id string, price_usd double")).collect()}
    assert got == {"k": 2.0, "s": None}


def test_overlap_components(spark):
    s = 1_000_000
    rows = [(0, 0, 3 * s, ["a", "b"]), (1, 4 * s, 6 * s, ["b", "c"]), (2, 20 * s, 25 * s, ["b", "d"]), (3, 3 * s, 4 * s, ["x", "y"])]
    cycles = spark.createDataFrame(rows, "cycle long, begin long, end long, vertices array<string>")
    assert O.overlap_pairs(cycles, s).count() == 0
    assert [(r.i, r.j) for r in O.overlap_pairs(cycles, 2 * s).collect()] == [(0, 1)]
    (r,) = O.component_aggregates(cycles, O.cycle_components(cycles, 2 * s)).collect()
    assert (r.component, r.begin, r.end, r.avg_duration, r.cycles, r.vertices) == (0, 0, 6 * s, 2.5, [0, 1], ["a", "b", "c"])
    assert O.cycle_components(cycles, 2 * s, keep_single=True).count() == 4


def test_random_graphs(spark):
    """Enumeration, raw and combined seeds, bundles and cardinality against a depth-first search, many graphs in one."""
    rng, rows = random.Random(5), []
    for g in range(40):  # graphs far apart in time and with their own vertices
        for _ in range(rng.randint(5, 18)):
            rows.append((f"{g}-{rng.randrange(5)}", f"{g}-{rng.randrange(5)}", 1000 * g + rng.randrange(12), len(rows)))
    want = brute.cycles(rows, 8, 5)
    found, seeds, bundles = bundle_rows(spark, rows, 8, 5)
    assert sorted((r.root, tuple(r.times), tuple(r.path), tuple(r.edge_keys)) for r in found.collect()) == sorted(want)
    by_root = defaultdict(list)
    for root, times, *_ in want:
        by_root[root].append((times[0], times[-1]))
    groups = brute.combined(by_root, 8)
    assert sorted((r.root, r.begin, r.end, r.next_begin) for r in seeds.collect()) == sorted(groups)
    expect = defaultdict(list)
    for root, times, path, _ in want:
        (g,) = [g for g in groups if g[0] == root and g[1] <= times[0] < g[3]]
        assert times[-1] <= g[2]
        expect[root, g[1], path].append(times)
    got = {(r.root, r.begin, tuple(r.path)): (r.bundle, r.cardinality) for r in bundles.collect()}
    assert got == {k: ([sorted(set(hop)) for hop in zip(*v)], len(v)) for k, v in expect.items()}
    grown = P.bundled_cycles(frame(spark, rows), seeds, 5)
    assert {(r.root, r.begin, tuple(r.path)): (r.bundle, r.cardinality) for r in grown.collect()} == got
    # without a bound on length, the walks that return are just the seeds, and candidates hold all of their cycles
    edges, every = frame(spark, rows), brute.cycles(rows, 8, 99)
    walks = {(r.root, r.begin, r.end) for r in S.return_walks(edges, 8).collect()}
    assert walks == {(root, times[0], times[-1]) for root, times, *_ in every}
    reached = {(r.root, r.begin, r.end): set(r.candidates) for r in S.reachability_seeds(edges, 8).collect()}
    assert reached == brute.walk_seeds(rows, 8)
    assert all(set(path) <= reached[root, times[0], times[-1]] for root, times, path, _ in every)
    # so search within these seeds finds all bundles
    whole = bundle_rows(spark, rows, 8, 99)[2]
    searched = P.bundled_cycles(edges, S.combined_seeds(S.reachability_seeds(edges, 8), 8))
    columns = ["root", "begin", "path", "length", "bundle", "cardinality"]
    assert sorted(map(str, searched.select(*columns).collect())) == sorted(map(str, whole.select(*columns).collect()))


def test_cycles_without_a_bound_on_length(spark):
    rows = [(f"v{i}", f"v{(i + 1) % 9}", i, i) for i in range(9)] + [("v3", "v0", 20, 9), ("v4", "v1", 21, 10)]
    edges = frame(spark, rows)
    found = C.temporal_cycles(edges, 100)
    assert sorted((r.root, tuple(r.times), tuple(r.path), tuple(r.edge_keys)) for r in found.collect()) == sorted(brute.cycles(rows, 100, 99))
    assert found.agg(F.max("length")).first()[0] == 9
    seeds = S.combined_seeds(S.raw_seeds(found), 100)
    assert P.bundled_cycles(edges, seeds).agg(F.max(F.size("path"))).first()[0] == 9
    with pytest.warns(UserWarning, match="still open at max_length"):
        C.temporal_cycles(edges, 100, 6)


def test_reachability_without_a_bound_on_hops(spark):
    rows = [(f"v{i}", f"v{i + 1}", i, i) for i in range(25)] + [("v25", "v0", 25, 25)]
    edges = frame(spark, rows)
    assert S.reverse_reachability(edges, 100).where("x = 'v0' AND v = 'v25' AND ta = 24").count() == 1
    assert [tuple(r) for r in S.return_walks(edges, 100).collect()] == [("v0", 0, 25)]
    few = frame(spark, rows[:4])
    assert S.reverse_reachability(few, 100, 3).count() == 10
    with pytest.raises(RuntimeError):
        S.reverse_reachability(few, 100, 2)


def test_sequences(spark):
    df = spark.createDataFrame([([1, 3, 3, 7],)], "ts array<long>")
    r = df.select(before(F.col("ts"), F.lit(3)), before(F.col("ts"), F.lit(3), True), after(F.col("ts"), F.lit(3)), after(F.col("ts"), F.lit(3), True), split_index(F.col("ts"), F.lit(3)), split_index(F.col("ts"), F.lit(3), "after")).first()
    assert list(r) == [[1], [1, 3, 3], [7], [3, 3, 7], 1, 3]


def test_trim_drops_dead_times(spark):
    df = spark.createDataFrame([([[1, 9], [1, 4, 12], [5]],)], "b array<array<long>>")
    r = df.select(trim(F.col("b")), cardinality(F.col("b"))).first()
    assert list(r) == [[[1], [4], [5]], 1]


def test_components_and_scc(spark):
    rng = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100 + rng.randrange(60), 100 + rng.randrange(60)) for _ in range(45)]
    for local in (0, 1000):  # by rounds of stars, and in one task
        got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "a long, b long"), local_edges=local).collect()}
        assert got == brute.components([p for p in pairs if p[0] != p[1]])
    named = spark.createDataFrame([(f"n{a}", f"n{b}") for a, b in pairs], "a string, b string")
    assert {r.node: r.component for r in connected_components(named).collect()} == brute.components([(f"n{a}", f"n{b}") for a, b in pairs if a != b])
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (4, 5), (5, 4), (6, 6)], "src long, dst long")
    assert {r.node: r.component for r in O.strongly_connected_components(edges).collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 6}


def whole_events(monkeypatch, spark):
    """The event edges of the queries: two days, the second one without a time that 7 divides."""
    from loomcycle.plans import queries as Q

    rows = [(1, 2, 0, 0), (2, 3, 7, 1), (3, 1, 2 * Q.DAY + 1, 2), (3, 4, 2 * Q.DAY + 3, 3), (4, 5, 2 * Q.DAY + 4, 4), (5, 4, 2 * Q.DAY + 5, 5)]
    assert all(t % 7 for _, _, t, _ in rows[2:])
    monkeypatch.setattr(Q, "event_edges", lambda spark, sf: spark.createDataFrame(rows, "src long, dst long, t long, edge_key long"))
    return Q, rows


def test_strong_components_of_whole_tables(spark, monkeypatch):
    Q, _ = whole_events(monkeypatch, spark)
    assert {r.node: r.component for r in Q.QUERIES["strong_components"](spark, "").collect()} == {1: 1, 2: 1, 3: 1, 4: 4, 5: 4}


def test_summaries_merged_over_whole_tables(spark, monkeypatch):
    Q, rows = whole_events(monkeypatch, spark)
    points = {(dst, src, t) for src, dst, t, _ in rows}
    points |= {(b, x, t) for v, x, t in points for a, b, *_ in rows if a == v}
    want = {}
    for v, x, t in points:
        if v != x and t > Q.DAY:
            want.setdefault(v, []).append((x, t))
    got = {r.v: (r.points, r.vertices, r.times) for r in Q.QUERIES["summary_sizes"](spark, "").collect()}
    assert got == {v: (len(p), len({x for x, _ in p}), len({t for _, t in p})) for v, p in want.items()}


def test_static_cycles(spark):
    edges = frame(spark, "ab1 bc1 cd1 da1 ac1 ba1".split())
    assert {"".join(r.path) for r in K.static_cycles(edges, 4).collect()} == {"ab", "acd", "abcd"}
    assert {"".join(r.path) for r in K.static_cycles(edges, 4, chordless=True).collect()} == {"ab", "acd"}
    assert {"".join(r.path) for r in K.static_cycles(edges, 3).collect()} == {"ab", "acd"}
    assert {"".join(r.path) for r in K.static_cycles(edges, 2, chordless=True).collect()} == {"ab"}


def test_interpolation_and_smoothing(spark):
    runs = spark.createDataFrame([("a", 0, 0.0), ("a", 250, 5.0), ("b", 0, 2.0), ("b", 100, 4.0)], "run string, ms long, value double")
    got = {r.ms: (r.mean_value, r.runs) for r in X.cross_run_mean(runs, 100).collect()}
    assert got == {0: (1.0, 2), 100: (3.0, 2), 200: (4.0, 1)}
    # a parabola is its own least-squares fit, at the ends too
    rows = spark.createDataFrame([(1, k, float(k * k - 3 * k)) for k in range(20)], "s int, k int, v double")
    assert all(abs(r.smoothed - r.v) < 1e-8 for r in X.savgol(rows, ["s"], "k", "v").collect())


def test_empty_edges(spark):
    empty = spark.createDataFrame([], EDGE)
    found = C.temporal_cycles(empty, 5)
    assert found.count() == 0
    assert S.combined_seeds(S.raw_seeds(found), 5).count() == 0
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_dictionary_round_trip(spark):
    edges = frame(spark, EXAMPLE)
    d = {r.vertex: r.vertex_id for r in E.vertex_dictionary(edges).collect()}
    assert sorted(d.values()) == list(range(len(d))) and d["a"] == 0 and d["b"] == 1
    coded = E.encode(edges, E.vertex_dictionary(edges))
    assert {(r.src, r.dst, r.t) for r in coded.collect()} == {(d[x[0]], d[x[1]], int(x[2:])) for x in EXAMPLE}


def test_summaries(spark):
    """Times 1-3, vertices v1-v3: adding, series, excluding, merging, cutting."""
    points = spark.createDataFrame([("v", "v1", 1), ("v", "v2", 1), ("v", "v1", 2)], "v string, x string, t long")
    more = R.add(points, spark.createDataFrame([("v", "v3", 3), ("v", "v1", 1)], "v string, x string, t long"))
    assert (points.count(), more.count()) == (3, 4)
    assert {r.x: r.ts for r in R.series(more).collect()} == {"v1": [1, 2], "v2": [1], "v3": [3]}
    other = spark.createDataFrame([("w", "v", 4), ("w", "v9", 4)], "v string, x string, t long")
    both = R.merge(points, other, spark.createDataFrame([("w", "v")], "a string, b string"))
    assert both.count() == 5 and R.exclude(both).count() == 4 and other.count() == 2
    assert [R.cut(points, 1, a, i).count() for a in (True, False) for i in (True, False)] == [3, 1, 2, 0]
    assert [(r.points, r.vertices, r.times) for r in R.sizes(points).collect()] == [(3, 2, 2)]


def test_table_function(spark):
    from loomcycle.functions import udtf

    udtf.register(spark)
    edges = "array(struct(1L AS src, 2L AS dst, 1L AS t, 0L AS edge_key), struct(2L AS src, 1L AS dst, 3L AS t, 1L AS edge_key), struct(2L AS src, 3L AS dst, 2L AS t, 2L AS edge_key), struct(3L AS src, 1L AS dst, 4L AS t, 3L AS edge_key))"
    got = spark.sql(f"SELECT * FROM subgraph_cycles({edges}, 10L, 0L, 2L, 5)").collect()
    assert sorted(r.path for r in got) == [[1, 2], [1, 2, 3]]
