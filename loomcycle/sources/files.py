"""Readers: partitioned edges, transactions, cycles, graph JSON, logs, dictionaries and receipts."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: The columns and keys of the file formats.
GRAPH_JSON = "directed boolean, multigraph boolean, graph map<string,string>, nodes array<struct<id:string>>, edges array<struct<source:string,target:string,key:double,timestamp:double,token_id:string,price_usd:double,edge_key:string>>"
RUN_LOG = "time_seconds double, iteration_time double, iterations_total long, cycles_total long, memory_usage_bytes long, task_queue_size long, running_tasks long"
ITERATION_LOG = "time_seconds double, iterations_total long, iterations_rate double, memory_usage_bytes long"
CYCLE_CSV = "seed_begin double, seed_end double, next_seed_begin double, candidates string, graph string"


def file_parts(name: F.Column) -> tuple[F.Column, F.Column]:
    """(block, date) of names like 123__2021-10-01__x; a bad date gives null."""
    base = F.split(F.element_at(F.split(name, "/"), -1), "__")
    return F.try_element_at(base, F.lit(1)).try_cast("long"), F.to_date(F.try_to_timestamp(F.try_element_at(base, F.lit(2)), F.lit("yyyy-MM-dd")))


def parse_date(text: str) -> dt.date:
    try:
        return dt.datetime.strptime(text, "%Y-%m-%d").date()
    except ValueError as e:
        raise ValueError(f"not a date (YYYY-MM-DD): {text!r}") from e


def read_edges(spark: SparkSession, path: str, start: dt.date | None = None, end: dt.date | None = None) -> DataFrame:
    """Edges in Parquet partitioned by `date`; both ends inclusive and optional, pruned before any file is opened."""
    edges = spark.read.parquet(path)
    if start is not None:
        edges = edges.where(F.col("date") >= F.lit(start))
    if end is not None:
        edges = edges.where(F.col("date") <= F.lit(end))
    return edges


def ordered(edges: DataFrame) -> DataFrame:
    """Global order (t, src, dst, edge_key): only for sinks that need one."""
    return edges.orderBy("t", "src", "dst", "edge_key")


def read_transactions(spark: SparkSession, path: str, extra: str = "") -> DataFrame:
    """Transaction CSV with a timestamp in seconds; the buyer's own purchases with a price, as edges."""
    from loomcycle.operators.edges import clean_trades, from_transactions

    schema = "timestamp long, `from` string, `to` string, buyer string, price_usd double, token_id string" + extra
    rows = clean_trades(spark.read.csv(path, header=True, schema=schema, enforceSchema=False))
    return from_transactions(rows.withColumn("t", F.col("timestamp") * 1_000_000))


def read_cycles(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True, sep=";", schema=CYCLE_CSV, escape='"', quote='"')
    return rows.withColumn("candidates", F.from_json("candidates", "array<string>")).withColumn("graph", decode_graph(F.col("graph")))


def decode_graph(text: F.Column) -> F.Column:
    return F.from_json(text, GRAPH_JSON)


def graph_edges(rows: DataFrame, graph: str = "graph", keep: list[str] | None = None) -> DataFrame:
    """One row for each edge of decoded graphs; times are seconds in the file, microseconds here."""
    flat = rows.select(*(keep or []), F.inline(F.col(graph)["edges"]))
    return flat.withColumnsRenamed({"source": "src", "target": "dst"}).withColumn("t", F.round(F.coalesce("timestamp", "key") * 1_000_000).cast("long")).drop("key", "timestamp")


def read_run_log(spark: SparkSession, path: str, schema: str = RUN_LOG) -> DataFrame:
    return spark.read.csv(path, header=True, schema=schema)


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(vertex, vertex_id) of a text file with one address a line: the line's number.

    Lines follow each other by file name and place in the file; the scan's partitions take the longest parts first.
    """
    from loomcycle.operators.overlap import ranked

    place = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("line"))
    lines = spark.read.text(path).select(F.lower(F.regexp_replace("value", "^0x", "")).alias("vertex"), place.alias("at"))
    return ranked(lines, "at").select("vertex", (F.col("rank") - 1).alias("vertex_id"))


def read_trades(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.csv(path, header=True)
    return rows.withColumn("tx_hash", F.lower(F.regexp_replace("Transaction Hash", "^0x", ""))).drop("Transaction Hash")


def trades_with_edges(trades: DataFrame, edges: DataFrame) -> DataFrame:
    """Every trade with the edge of its transaction, if any."""
    return trades.join(edges.withColumn("tx_hash", F.lower(F.regexp_replace("tx_hash", "^0x", ""))), "tx_hash", "left")


def with_receipts(edges: DataFrame, receipts: DataFrame, topic: str) -> DataFrame:
    """edges with contract_id: the address of the receipt's first log with the topic and four topics; unchanged without one."""
    logs = F.filter("logs", lambda x: (x["topics"][0] == topic) & (F.size(x["topics"]) == 4))
    found = receipts.select("tx_hash", F.try_element_at(logs, F.lit(1))["address"].alias("contract_id"))
    return edges.join(found, "tx_hash", "left")


def cached(spark: SparkSession, path: str, make: Callable[[], DataFrame]) -> DataFrame:
    """Reads a Parquet table if it is there, else writes it first."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        make().write.parquet(path)
    return spark.read.parquet(path)


def register_paged_source(spark: SparkSession, name: str, schema: T.StructType | str, fetch: Callable[[int], list[tuple]], page_size: int) -> None:
    """A batch source over a paged service: fetch(page) gives a page's rows; a short page is the last.

    The network client, its credentials and its waiting are the caller's; pages are read in one task, as the end
    is known only when it comes.
    """
    from pyspark.sql.datasource import DataSource, DataSourceReader

    class Reader(DataSourceReader):
        def read(self, partition):
            page = 0
            while True:
                rows = fetch(page)
                yield from rows
                if len(rows) < page_size:
                    return
                page += 1

    class Paged(DataSource):
        @classmethod
        def name(cls):
            return name

        def schema(self):
            return schema

        def reader(self, schema):
            return Reader()

    spark.dataSource.register(Paged)
