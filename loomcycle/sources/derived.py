"""Edge tables derived from the test tables: hand-offs between users, and owners of parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F


DAY = 86_400_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def micros(column: str) -> F.Column:
    """TIMESTAMP_NTZ to microseconds; the session's zone is UTC."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def event_edges(spark: SparkSession, sf_dir: str, days_where: F.Column | None = None) -> DataFrame:
    """src, dst, t, edge_key: consecutive users of one event type.

    An event type has a large share of all events, so the order is taken within its days; a day's last event is
    followed by the first of the next day that has one, from a table of one row a day. A condition on `day` takes
    the edges from those days' events.
    """
    e = table(spark, sf_dir, "events").select("event_type", F.floor(micros("ts") / DAY).alias("day"), F.struct("ts", "event_id").alias("at"), F.struct(F.col("user_id").alias("dst"), micros("ts").alias("t"), F.col("event_id").alias("edge_key")).alias("x"))
    day = W.partitionBy("event_type", "day").orderBy("at")
    firsts = e.groupBy("event_type", "day").agg(F.min_by("x", "at").alias("x"))
    tomorrow = firsts.select("event_type", "day", F.lead("x").over(W.partitionBy("event_type").orderBy("day")).alias("tomorrow"))
    e = e if days_where is None else e.where(days_where)
    follow = e.select("event_type", "day", F.col("x.dst").alias("src"), F.lead("x").over(day).alias("follow")).join(tomorrow, ["event_type", "day"])
    return follow.select("src", F.coalesce("follow", "tomorrow").alias("x")).where("x IS NOT NULL").select("src", "x.*").where("dst IS NOT NULL AND src <> dst")


def token_edges(spark: SparkSession, sf_dir: str, lines_where: F.Column | None = None) -> DataFrame:
    """src, dst, t, token_id, price_usd, edge_key: a part goes from one customer to the next who orders it.

    A condition on lines must hold for all or none of a part's.
    """
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_suppkey")
    if lines_where is not None:
        lines = lines.where(lines_where)
    w = W.partitionBy("l_partkey").orderBy("o_orderdate", "l_orderkey", "l_linenumber", "l_extendedprice", "l_suppkey")
    chain = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return chain.select(
        F.col("o_custkey").alias("src"),
        F.lead("o_custkey").over(w).alias("dst"),
        F.lead(micros("o_orderdate")).over(w).alias("t"),
        F.col("l_partkey").alias("token_id"),
        F.lead("l_extendedprice").over(w).alias("price_usd"),
        F.lead(F.col("l_orderkey") * 8 + F.col("l_linenumber")).over(w).alias("edge_key"),
    ).where("dst IS NOT NULL AND src <> dst")
