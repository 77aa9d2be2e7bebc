"""What the queries on bundles shuffle at a time, on tables that count as large."""

import datetime as dt
import random

import pytest

from loomcycle import session
from loomcycle.plans import file_queries, queries as core  # noqa: F401 file_queries registers its own
from loomcycle.sources.derived import event_edges, token_edges

LINES, EVENTS = 1200, 900
TOKENS = ["price_delta", "boundary_table", "cycle_files", "dwell_min", "graph_json_round_trip", "overlap_pairs_closed", "path_bundles", "component_files", "cycle_components", "cycle_measures", "dwell_lists", "overlap_pairs"]
ON_EVENTS = ["bundle_cardinality", "bundle_choices"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng, top = random.Random(11), tmp_path_factory.mktemp("tables")
    day = lambda k: dt.datetime(2020, 1, 1) + dt.timedelta(days=k)
    orders = [(k, rng.randrange(60), day(rng.randrange(900))) for k in range(400)]
    lines = [(k % 400, k // 400, rng.randrange(80), rng.randrange(9), rng.randrange(900) / 8) for k in range(LINES)]
    events = [(k, dt.datetime(2024, 1, 1) + dt.timedelta(minutes=9 * k, seconds=k % 50), rng.randrange(12), rng.choice("ab")) for k in range(EVENTS)]
    for name, rows, schema in [
        ("orders", orders, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        ("lineitem", lines, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_extendedprice double"),
        ("events", events, "event_id long, ts timestamp_ntz, user_id long, event_type string"),
    ]:
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{top}/{name}.parquet")
    return str(top)


def taken(spark, work):
    """What the work gives, and the stages that it took."""
    store, gateway = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway
    stages = lambda: store.stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
    last = max((x.stageId() for x in map(stages().apply, range(stages().size()))), default=-1)
    got, found = work(), stages()
    return got, [x for x in (found.apply(i) for i in range(found.size())) if x.stageId() > last]


def rows_of(frames):
    return [sorted(map(str, x.collect())) for x in frames]


@pytest.fixture(scope="module")
def bundles(spark, tables):
    return core._token_bundles(spark, tables)


def test_lines_and_edges_are_shuffled_in_shares(spark, tables, bundles, monkeypatch):
    monkeypatch.setattr(session, "SHARE_ROWS", 100)
    got, stages = taken(spark, lambda: core._token_bundles(spark, tables))
    assert rows_of(got) == rows_of(bundles) and got[2].count() > 9
    assert max(x.shuffleWriteRecords() for x in stages) < LINES


def test_token_edges_are_written_once(spark, tables):
    edges = token_edges(spark, tables).count()
    _, stages = taken(spark, lambda: core._token_bundles(spark, tables))
    assert sum(x.outputRecords() >= edges for x in stages) == 1


def test_written_relations_are_zstd(spark):
    with session.written(spark, [spark.range(500)]) as rows:
        assert rows.inputFiles() and all(".zstd." in x for x in rows.inputFiles())


@pytest.mark.parametrize("name", TOKENS)
def test_queries_take_the_written_bundle_edges(spark, tables, bundles, monkeypatch, name):
    for module in (core, file_queries):
        monkeypatch.setattr(module, "_token_bundles", lambda *_: bundles)
    rows, stages = taken(spark, lambda: core.QUERIES[name](spark, tables).collect())
    assert rows and max(x.inputRecords() for x in stages) < LINES


@pytest.mark.parametrize("name", ON_EVENTS)
def test_event_edges_are_derived_once(spark, tables, name):
    """Their own two scans of all events, and no more."""
    rows, stages = taken(spark, lambda: core.QUERIES[name](spark, tables).collect())
    assert rows and sum(x.inputRecords() >= EVENTS for x in stages) == 2


@pytest.mark.parametrize("name", ["cycles_event_1h", "cycle_counts", "cycle_size_counts"])
def test_event_cycles_take_events_in_shares_of_days(spark, tables, monkeypatch, name):
    """Nor are the edges written a second time for their return walks."""
    want = rows_of([core.QUERIES[name](spark, tables)])
    monkeypatch.setattr(session, "SHARE_ROWS", 100)
    got, stages = taken(spark, lambda: rows_of([core.QUERIES[name](spark, tables)]))
    assert got == want and got[0]
    edges = event_edges(spark, tables).count()
    assert max(x.outputRecords() for x in stages) < edges <= sum(x.outputRecords() for x in stages if x.outputRecords() > edges // 20) < 2 * edges


def test_written_relations_leave_the_disk(spark, tables):
    from tests.test_blocks import on_disk

    spark.range(1).count()
    before = on_disk(spark)
    with session.written(spark, (spark.range(5000).where(session.share("id", k, 3)) for k in range(3))) as rows:
        assert rows.count() == 5000 and rows.distinct().count() == 5000
        assert on_disk(spark) > before
    assert on_disk(spark) <= before
