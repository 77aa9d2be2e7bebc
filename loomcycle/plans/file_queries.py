"""Registered queries that write files and read them again, and small operators, over whole tables."""

from __future__ import annotations

import datetime as dt
import uuid

from pyspark.sql import SparkSession, functions as F

from loomcycle.functions.times import period
from loomcycle.operators import edges as E, measures as M, overlap as O
from loomcycle.plans import oracle as Q
from loomcycle.plans.queries import DAY, MONTH, _numbered, _token_bundle_edges, _token_bundles, register
from loomcycle.session import ensure_checkpoint_dir
from loomcycle.sources import files as I, sinks as K
from loomcycle.sources.derived import event_edges, table


def _folder(spark: SparkSession, name: str) -> str:
    """A fresh folder that driver and executors share."""
    ensure_checkpoint_dir(spark)
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


_FIRST = "(SELECT CAST(make_timestamp(min(t)) AS DATE) FROM event_edges)"


@register(Q.with_(Q.EVENTS) + f"SELECT src, dst, t, edge_key, strftime(make_timestamp(t), '%Y-%m-%d') AS day FROM event_edges WHERE CAST(make_timestamp(t) AS DATE) BETWEEN {_FIRST} + 5 AND {_FIRST} + 20")
def edges_by_day(spark, sf):
    edges, folder = event_edges(spark, sf), _folder(spark, "edges")
    K.write_edges(edges, folder)
    first = edges.agg(F.to_date(F.timestamp_micros(F.min("t")))).first()[0]
    found = I.read_edges(spark, folder, first + dt.timedelta(5), first + dt.timedelta(20))
    return found.select("src", "dst", "t", "edge_key", F.date_format("date", "yyyy-MM-dd").alias("day"))


@register("""SELECT CAST(o_orderkey AS VARCHAR) AS src, CAST(l_linenumber AS VARCHAR) AS dst, CAST(l_partkey AS VARCHAR) AS token_id, l_extendedprice AS price_usd, epoch_us(date_trunc('second', o_orderdate)) AS t
FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_linenumber = o_custkey % 5""")
def transactions_csv(spark, sf):
    both = table(spark, sf, "lineitem").join(table(spark, sf, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    seconds = F.floor(F.unix_micros(F.col("o_orderdate").cast("timestamp")) / 1_000_000)
    rows = both.select(seconds.alias("timestamp"), F.col("o_orderkey").alias("from"), F.col("l_linenumber").alias("to"), F.when(F.col("o_custkey") % 5 != 0, F.col("o_custkey") % 5).alias("buyer"), F.col("l_extendedprice").alias("price_usd"), F.col("l_partkey").alias("token_id"))
    folder = _folder(spark, "transactions")
    K.write_transactions(rows, folder)
    return I.read_transactions(spark, folder).select("src", "dst", "token_id", "price_usd", "t")


@register(Q.with_(*Q.bundled("token_edges", MONTH)) + "SELECT CAST(src AS VARCHAR) AS src, CAST(dst AS VARCHAR) AS dst, t, CAST(token_id AS VARCHAR) AS token_id, price_usd FROM bundle_edges")
def cycle_files(spark, sf):
    folder = _folder(spark, "cycles")
    K.write_cycles(K.cycle_table(*_token_bundles(spark, sf)), folder)
    return I.graph_edges(I.read_cycles(spark, folder)).select("src", "dst", "t", "token_id", "price_usd")


@register("SELECT event_type, count(*) AS events FROM events GROUP BY 1")
def cached_table(spark, sf):
    """Made once, read twice."""
    folder = _folder(spark, "cache")
    made = lambda: table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("events"))
    I.cached(spark, folder, made)
    return I.cached(spark, folder, lambda: made().where("false"))


_LOG = "SELECT CAST(event_id AS DOUBLE) AS time_seconds, event_id * 2 AS iterations_total, CAST(user_id AS BIGINT) AS cycles_total FROM events"


@register(f"SELECT time_seconds, iterations_total, cycles_total, CASE WHEN time_seconds > 0 THEN iterations_total / time_seconds END AS iterations_rate, CASE WHEN time_seconds > 0 THEN cycles_total / time_seconds END AS cycles_rate FROM ({_LOG})")
def run_log_files(spark, sf):
    from loomcycle.operators.exploration import throughput

    e = table(spark, sf, "events")
    rows = e.select(F.col("event_id").cast("double").alias("time_seconds"), F.lit(1.0).alias("iteration_time"), (F.col("event_id") * 2).alias("iterations_total"), F.col("user_id").cast("long").alias("cycles_total"), *[F.lit(0).cast("long").alias(c) for c in ("memory_usage_bytes", "task_queue_size", "running_tasks")])
    folder = _folder(spark, "log")
    K.write_log(rows, folder, I.RUN_LOG)
    return throughput(I.read_run_log(spark, folder)).select("time_seconds", "iterations_total", "cycles_total", "iterations_rate", "cycles_rate")


@register("SELECT CAST(event_id AS DOUBLE) AS time_seconds, event_id * 2 AS iterations_total, 0.5 AS iterations_rate, user_id * 10 AS memory_usage_bytes FROM events")
def iteration_log_files(spark, sf):
    rows = table(spark, sf, "events").select(F.col("event_id").cast("double").alias("time_seconds"), (F.col("event_id") * 2).alias("iterations_total"), F.lit(0.5).alias("iterations_rate"), (F.col("user_id") * 10).cast("long").alias("memory_usage_bytes"))
    folder = _folder(spark, "iterations")
    K.write_log(rows, folder, I.ITERATION_LOG)
    return I.read_run_log(spark, folder, I.ITERATION_LOG)


@register("SELECT lower(hex(c_name)) AS vertex, row_number() OVER (ORDER BY c_custkey) - 1 AS vertex_id FROM customer")
def dictionary_file(spark, sf):
    folder = _folder(spark, "dictionary")
    K.write_dictionary(table(spark, sf, "customer").select(F.concat(F.lit("0x"), F.hex("c_name")).alias("vertex"), F.col("c_custkey").alias("vertex_id")), folder)
    return I.read_dictionary(spark, folder)


@register("SELECT i AS id, i * i AS square FROM range(0, 2345) r(i)")
def paged_source(spark, sf):
    I.register_paged_source(spark, "squares", "id long, square long", lambda page: [(i, i * i) for i in range(page * 100, min(2345, page * 100 + 100))], 100)
    return spark.read.format("squares").load()


@register("SELECT o_orderkey AS edge_key, CASE WHEN o_orderkey % 3 = 0 THEN 'c' || o_custkey END AS contract_id FROM orders")
def edges_with_receipts(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("h"), "o_orderkey").alias("tx_hash"))
    four = F.array(F.lit("topic"), *[F.lit("x")] * 3)
    other = F.struct(F.lit("other").alias("address"), F.array(F.lit("topic")).alias("topics"))
    hit = F.struct(F.concat(F.lit("c"), "o_custkey").alias("address"), four.alias("topics"))
    receipts = o.select("tx_hash", F.when(F.col("o_orderkey") % 3 == 0, F.array(other, hit)).otherwise(F.array(other)).alias("logs"))
    return I.with_receipts(o.select("tx_hash", F.col("o_orderkey").alias("edge_key")), receipts, "topic").select("edge_key", "contract_id")


@register("SELECT 'ab' || o_orderkey AS tx_hash, CAST(o_custkey AS VARCHAR) AS \"Value\", CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey ELSE -1 END AS edge_key FROM orders")
def trades_csv(spark, sf):
    o, folder = table(spark, sf, "orders"), _folder(spark, "trades")
    o.select(F.concat(F.lit("0xAB"), "o_orderkey").alias("Transaction Hash"), F.col("o_custkey").alias("Value")).write.csv(folder, header=True)
    edges = o.where("o_orderkey % 2 = 0").select(F.concat(F.lit("0xAB"), "o_orderkey").alias("tx_hash"), F.col("o_orderkey").alias("edge_key"))
    return I.trades_with_edges(I.read_trades(spark, folder), edges).select("tx_hash", "Value", F.coalesce("edge_key", F.lit(-1).cast("long")).alias("edge_key"))


@register(Q.with_(*Q.bundled("token_edges", MONTH), Q.SPANS, Q.PAIRS.format(slack=MONTH), Q.LABELS) + "SELECT CAST(component AS VARCHAR) AS component, '[' || array_to_string(list_sort(list(cycle)), ',') || ']' AS cycles FROM labels GROUP BY 1")
def component_files(spark, sf):
    cycles, folder = _numbered(_token_bundle_edges(spark, sf)), _folder(spark, "components")
    K.write_components(O.component_aggregates(cycles, O.cycle_components(cycles, MONTH)), folder)
    return spark.read.csv(folder, header=True, sep=";", escape='"', quote='"').select("component", "cycles")


@register(Q.with_(*Q.bundled("token_edges", MONTH), Q.SPANS, Q.PAIRS.format(slack=MONTH), Q.LABELS, "ids2 AS (SELECT *, row_number() OVER (ORDER BY bundle) AS cycle FROM spans)")
          + "SELECT l.component, count(DISTINCT (e.src, e.dst, e.t, e.edge_key)) AS edges, min(e.t) AS begin, max(e.t) AS \"end\" FROM labels l JOIN ids2 i ON i.cycle = l.cycle JOIN bundle_edges e ON e.bundle = i.bundle GROUP BY 1")
def component_graphs(spark, sf):
    """The composed graph of each component: its bundles' edges, each once."""
    edges = _token_bundle_edges(spark, sf)
    cycles = O.ranked(edges.groupBy("bundle").agg(F.min("t").alias("begin"), F.max("t").alias("end"), F.collect_set("src").alias("vertices")), "bundle").withColumn("cycle", F.col("rank").cast("long"))
    labels = O.cycle_components(cycles.select("cycle", "begin", "end", "vertices"), MONTH)
    return O.component_edges(edges, cycles.select("bundle", "cycle"), labels).groupBy("component").agg(F.count("*").alias("edges"), F.min("t").alias("begin"), F.max("t").alias("end"))


@register(Q.with_(Q.EVENTS, "ends AS (SELECT t, edge_key, 0 AS side, src AS vertex FROM event_edges UNION ALL SELECT t, edge_key, 1, dst FROM event_edges)",
                  "d AS (SELECT vertex, row_number() OVER (ORDER BY min((t, edge_key, side))) - 1 AS id FROM ends GROUP BY 1)")
          + "SELECT s.id AS u, x.id AS v, e.t FROM event_edges e JOIN d s ON s.vertex = e.src JOIN d x ON x.vertex = e.dst")
def integer_edge_files(spark, sf):
    folder = _folder(spark, "integers")
    K.write_integer_edges(event_edges(spark, sf), folder)
    return spark.read.csv(folder, schema="u long, v long, t long")


@register("SELECT o_custkey || ' ' || o_orderkey AS value FROM orders")
def text_dump(spark, sf):
    folder = _folder(spark, "text")
    K.write_text(table(spark, sf, "orders").select(F.array("o_custkey", "o_orderkey").alias("path")), folder)
    return spark.read.text(folder)


@register(Q.with_(*Q.bundled("token_edges", MONTH), Q.DWELL.replace("min((o.t - a.t_in) / 1e6) AS dwell", "array_to_string(list_sort(list(CAST((o.t - a.t_in) // 1000000 AS BIGINT))), ',') AS dwell")) + "SELECT * FROM dwell")
def dwell_lists(spark, sf):
    found = M.aggregate_dwell(M.dwell_times(_token_bundle_edges(spark, sf)), None)
    return found.withColumn("dwell", F.array_join(F.col("dwell").cast("array<bigint>").cast("array<string>"), ","))


@register(Q.with_(*Q.bundled("token_edges", MONTH), Q.SPANS, Q.PAIRS.format(slack=0).replace("y.b - 0 < x.e AND y.e + 0 > x.b", "y.b <= x.e AND y.e >= x.b")) + "SELECT i, j FROM pairs")
def overlap_pairs_closed(spark, sf):
    return O.overlap_pairs(_numbered(_token_bundle_edges(spark, sf)), 0, closed_end=True)


@register(Q.with_(Q.EVENTS) + "SELECT (SELECT count(*) FROM event_edges) AS events, (SELECT count(*) FROM lineitem) AS tokens")
def edge_counts(spark, sf):
    return E.edge_count(event_edges(spark, sf)).withColumnRenamed("edges", "events").crossJoin(F.broadcast(E.edge_count(table(spark, sf, "lineitem")).withColumnRenamed("edges", "tokens")))  # one row each


@register(Q.with_(Q.EVENTS) + f"SELECT day, edges, nodes FROM (SELECT t // {DAY} AS day, count(*) AS edges, len(list_distinct(list_concat(list(src), list(dst)))) AS nodes FROM event_edges GROUP BY 1) WHERE nodes BETWEEN 120 AND 145 AND edges >= 331")
def graphs_of_size(spark, sf):
    from loomcycle.operators.exploration import graph_features

    days = graph_features(event_edges(spark, sf), F.floor(F.col("t") / DAY), "day")
    return E.of_size(days, nodes=(120, 145), edges=(331, None)).select("day", "edges", "nodes")


@register("""SELECT o_orderkey, strftime(o_orderdate, '%Y-%m') AS month, year(o_orderdate) || '-Q' || quarter(o_orderdate) AS quarter, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') AS iso,
lower(hex(CAST(o_orderkey AS VARCHAR))) AS hexed FROM orders""")
def time_formats(spark, sf):
    t = F.col("t")
    rows = table(spark, sf, "orders").select("o_orderkey", F.unix_micros(F.col("o_orderdate").cast("timestamp")).alias("t"))
    return rows.select("o_orderkey", *[period(t, k).alias(k) for k in ("month", "quarter", "iso")], F.lower(F.hex(F.col("o_orderkey").cast("string"))).alias("hexed"))
