import datetime as dt

import pytest
from pyspark.sql import functions as F

from loomcycle.functions.times import edge_time, micros_of, omega_micros
from loomcycle.operators import bundles as B, cycles as C, seeds as S
from loomcycle.sources import files as R, sinks as K
from loomcycle.streaming.windows import CycleStream, read_found, window_cycles
from tests import brute
from tests.test_core import EXAMPLE, frame

S1 = 1_000_000


def example(spark):
    edges = frame(spark, EXAMPLE).withColumn("t", F.col("t") * S1).withColumn("token_id", F.lit("7")).withColumn("price_usd", F.lit(2.5))
    found = C.temporal_cycles(edges, 17 * S1, 8)
    seeds = S.combined_seeds(S.raw_seeds(found), 17 * S1)
    bundles = B.bundles(B.assign(found, seeds))
    return edges, seeds, bundles, B.to_edges(bundles, edges)


def test_cycle_files_round_trip(spark, tmp_path):
    _, seeds, bundles, rows = example(spark)
    table = K.cycle_table(bundles, seeds, rows)
    K.write_cycles(table, str(tmp_path / "cycles"))
    back = R.read_cycles(spark, str(tmp_path / "cycles"))
    assert back.count() == bundles.count()
    got = R.graph_edges(back).select("src", "dst", "t", "price_usd").collect()
    assert sorted(map(tuple, got)) == sorted((r.src, r.dst, r.t, r.price_usd) for r in rows.collect())


def test_edges_by_date(spark, tmp_path):
    day = 86_400 * S1
    edges = spark.createDataFrame([(1, 2, k * day + 5, k) for k in range(4)], "src long, dst long, t long, edge_key long")
    K.write_edges(edges, str(tmp_path / "e"))
    part = R.read_edges(spark, str(tmp_path / "e"), dt.date(1970, 1, 2), dt.date(1970, 1, 3))
    assert part.count() == 2 and "PartitionFilters: [isnotnull(date" in part._jdf.queryExecution().toString()
    assert [r.t for r in R.ordered(part).collect()] == [day + 5, 2 * day + 5]


def test_file_names(spark):
    rows = spark.createDataFrame([("/x/12__2021-10-01__a.parquet",), ("12__2021-13-01__a",), ("odd",)], "n string")
    block, date = R.file_parts(F.col("n"))
    assert [tuple(r) for r in rows.select(block, date).collect()] == [(12, dt.date(2021, 10, 1)), (12, None), (None, None)]
    with pytest.raises(ValueError):
        R.parse_date("2021-13-01")


def test_transactions(spark, tmp_path):
    (tmp_path / "t.csv").write_text("timestamp,from,to,buyer,price_usd,token_id\n5,a,b,b,1.5,7\n6,a,b,c,1.5,7\n7,a,b,,1.5,7\n8,a,b,b,,7\n")
    (r,) = R.read_transactions(spark, str(tmp_path / "t.csv")).collect()
    assert (r.src, r.dst, r.t, r.price_usd, r.token_id) == ("a", "b", 5 * S1, 1.5, "7") and "buyer" not in r.asDict()


def test_text_and_lists(spark, tmp_path):
    edges, _, _, _ = example(spark)
    K.write_text(C.temporal_cycles(edges, 17 * S1, 2), str(tmp_path / "c"))
    assert [r.value for r in spark.read.text(str(tmp_path / "c")).collect()] == ["a b"]
    first = K.integer_edges(edges).first()
    assert (first.u, first.v, first.t) == (0, 1, S1)


def test_dictionary_of_several_files(spark, tmp_path):
    """A long last file is read first; ids still go by line."""
    names = [f"{i:04x}" * (1 if i < 400 else 9) for i in range(600)]
    for part in range(3):
        (tmp_path / f"part-{part:05d}.txt").write_text("".join(f"0x{n}\n" for n in names[part * 200 : part * 200 + 200]))
    assert sorted((x.vertex_id, x.vertex) for x in R.read_dictionary(spark, str(tmp_path)).collect()) == list(enumerate(names))


def test_logs_dictionary_receipts(spark, tmp_path):
    (tmp_path / "log.csv").write_text("time_seconds,iteration_time,iterations_total,cycles_total,memory_usage_bytes,task_queue_size,running_tasks\n2,1,10,4,5,0,0\n")
    from loomcycle.operators.exploration import throughput

    r = throughput(R.read_run_log(spark, str(tmp_path / "log.csv"))).first()
    assert (r.iterations_rate, r.cycles_rate) == (5.0, 2.0)
    (tmp_path / "ids.txt").write_text("0xAB\n0xcd\n")
    assert sorted((x.vertex, x.vertex_id) for x in R.read_dictionary(spark, str(tmp_path / "ids.txt")).collect()) == [("ab", 0), ("cd", 1)]
    receipts = spark.createDataFrame([("h", [("adr", ["t0", "a", "b", "c"]), ("other", ["t0"])])], "tx_hash string, logs array<struct<address:string,topics:array<string>>>")
    edges = spark.createDataFrame([("h", 1), ("none", 2)], "tx_hash string, n int")
    assert {x.tx_hash: x.contract_id for x in R.with_receipts(edges, receipts, "t0").collect()} == {"h": "adr", "none": None}
    trades = spark.createDataFrame([("0xH",), ("0xZ",)], ["Transaction Hash"]).withColumn("tx_hash", F.lower(F.regexp_replace("Transaction Hash", "^0x", "")))
    assert {x.tx_hash: x.n for x in R.trades_with_edges(trades, edges).collect()} == {"h": 1, "z": None}


def test_read_through(spark, tmp_path):
    made = []
    make = lambda: made.append(1) or spark.range(3)
    assert [R.cached(spark, str(tmp_path / "c"), make).count() for _ in range(2)] == [3, 3] and made == [1]


def test_paged_source(spark):
    R.register_paged_source(spark, "pages_of_numbers", "n long", lambda page: [(k,) for k in range(page * 4, min(10, page * 4 + 4))], 4)
    assert sorted(r.n for r in spark.read.format("pages_of_numbers").load().collect()) == list(range(10))


def test_times(spark):
    df = spark.createDataFrame([("1970-01-01T00:00:02", 3.5)], "datetime string, timestamp double")
    assert df.select(edge_time(dict(df.dtypes))).first()[0] == 2 * S1
    assert df.select(micros_of(F.col("timestamp"), "double")).first()[0] == 3_500_000
    assert df.select(micros_of(F.lit("no time"), "string"), micros_of(F.lit("2.5"), "string")).first()[:] == (None, 2_500_000)
    assert omega_micros(dt.timedelta(hours=1)) == 3600 * S1 and omega_micros(2) == 2 * S1
    with pytest.raises(TypeError):
        micros_of(F.col("x"), "binary")
    with pytest.raises(ValueError):
        omega_micros(0)


def test_window_search_equals_enumeration():
    import random

    rng = random.Random(8)
    for _ in range(200):
        rows = [(rng.randrange(5), rng.randrange(5), rng.randrange(30), k) for k in range(rng.randint(3, 16))]
        omega, found = 7, []
        for k in range(-1, 5):
            inside = [e for e in rows if k * omega <= e[2] < (k + 2) * omega]
            found += window_cycles(inside, omega, (k + 1) * omega, 5)
        assert sorted((c[0], tuple(c[5]), tuple(c[4]), tuple(c[6])) for c in found) == sorted(brute.cycles(rows, 7, 5))


def test_window_search_without_a_bound_on_length():
    rows = [(v, (v + 1) % 9, v, v) for v in range(9)] + [(3, 0, 20, 9), (4, 1, 21, 10)]
    found = sorted((c[0], tuple(c[5]), tuple(c[4]), tuple(c[6])) for c in window_cycles(rows, 100, 100))
    assert found == sorted(brute.cycles(rows, 100, 99)) and max(len(c[1]) for c in found) == 9


def test_streaming_equals_batch(spark, tmp_path):
    import random

    rng, omega = random.Random(4), 10 * S1
    rows = sorted((rng.randrange(6), rng.randrange(6), rng.randrange(100) * S1, k) for k in range(150))
    rows.sort(key=lambda e: e[2])
    for part in range(3):
        chunk = rows[part * 50 : part * 50 + 50] + ([(0, 0, 10_000 * S1, 999)] if part == 2 else [])
        spark.createDataFrame(chunk, "src long, dst long, t long, edge_key long").withColumn("ts", F.timestamp_micros("t")).drop("t").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("src long, dst long, edge_key long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    CycleStream(omega, str(tmp_path / "out")).start(stream, availableNow=True).awaitTermination(240)
    got = sorted((r.root, tuple(r.times), tuple(r.path), tuple(r.edge_keys)) for r in read_found(spark, str(tmp_path / "out")).collect())
    assert got == sorted(brute.cycles(rows, omega, 99)) and got


def test_stream_drops_late_edges_and_repeats_batches(spark, tmp_path):
    omega = 10
    stream = CycleStream(omega, str(tmp_path / "out"))
    frame_of = lambda rows: spark.createDataFrame(rows, "src long, dst long, t long, edge_key long")
    stream.batch(frame_of([(1, 2, 5, 0), (2, 1, 8, 1), (None, 1, 6, 2), (3, 4, 41, 3)]), 0)  # watermark 21, windows below 10 closed
    late = [(2, 1, 9, 4), (4, 3, 44, 5), (5, 5, 200, 6)]  # the first is behind the watermark
    for _ in range(2):
        stream.batch(frame_of(late), 1)
    assert sorted((r.root, r.t_start, r.t_end) for r in read_found(spark, str(tmp_path / "out")).collect()) == [(1, 5, 8), (3, 41, 44)]
