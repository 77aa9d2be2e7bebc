"""Writers: cycle tables, graph JSON, edge lists, logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

#: What `measures.measure` gives of a component's edges again.
MEASURED = ("nodes", "edges", "begin", "end", "duration", "rate", "avg_dwell", "burstiness", "price_delta", "vertices")


def graph_json(bundle_edges: DataFrame, key: str = "bundle") -> DataFrame:
    """key, graph: node-link JSON; parallel edges keep their edge_key, times are seconds."""
    attrs = [F.col(c).cast("string").alias(c) for c in ("token_id",) if c in bundle_edges.columns] + [F.col(c) for c in ("price_usd",) if c in bundle_edges.columns]
    seconds = F.col("t") / F.lit(1e6)
    edge = F.struct(F.col("src").cast("string").alias("source"), F.col("dst").cast("string").alias("target"), seconds.alias("key"), seconds.alias("timestamp"), F.col("edge_key").cast("string").alias("edge_key"), *attrs)
    edges = bundle_edges.groupBy(key).agg(F.sort_array(F.collect_list(edge)).alias("edges"))
    node = F.struct(F.col("v").cast("string").alias("id"))
    nodes = bundle_edges.select(key, F.explode(F.array("src", "dst")).alias("v")).distinct().groupBy(key).agg(F.sort_array(F.collect_list(node)).alias("nodes"))
    whole = F.struct(F.lit(True).alias("directed"), F.lit(True).alias("multigraph"), F.create_map().cast("map<string,string>").alias("graph"), "nodes", "edges")
    return edges.join(nodes, key).select(key, F.to_json(whole).alias("graph"))


def cycle_table(found: DataFrame, seeds: DataFrame, bundle_edges: DataFrame) -> DataFrame:
    """bundle, seed_begin, seed_end, next_seed_begin, candidates, graph: the row format of cycle files."""
    from loomcycle.operators.bundles import bundle_id

    ids = found.select(bundle_id().alias("bundle"), "root", "begin")
    seconds = lambda c: F.col(c) / F.lit(1e6)
    rows = ids.join(seeds, ["root", "begin"]).join(graph_json(bundle_edges), "bundle")
    return rows.select("bundle", seconds("begin").alias("seed_begin"), seconds("end").alias("seed_end"), seconds("next_begin").alias("next_seed_begin"), F.to_json(F.col("candidates").cast("array<string>")).alias("candidates"), "graph")


def write_cycles(rows: DataFrame, path: str) -> None:
    rows.select("seed_begin", "seed_end", "next_seed_begin", "candidates", "graph").write.csv(path, sep=";", header=True, escape='"', quote='"')


def to_serializable(components: DataFrame) -> DataFrame:
    """Without what the graph says again; arrays and structs as JSON."""
    kept = components.drop(*MEASURED)
    return kept.select(*[F.to_json(c).alias(c) if kind.startswith(("array", "struct", "map")) else F.col(c) for c, kind in kept.dtypes])


def write_components(components: DataFrame, path: str) -> None:
    to_serializable(components).write.csv(path, sep=";", header=True, escape='"', quote='"')


def integer_edges(edges: DataFrame) -> DataFrame:
    """u, v, t with dense ids, in order of time: the input of edge-list tools."""
    from loomcycle.operators.edges import encode, vertex_dictionary

    coded = encode(edges.select("src", "dst", "t", "edge_key"), vertex_dictionary(edges))
    return coded.select(F.col("src").alias("u"), F.col("dst").alias("v"), "t", "edge_key").orderBy("t", "edge_key").drop("edge_key")


def write_integer_edges(edges: DataFrame, path: str) -> None:
    integer_edges(edges).write.csv(path)


def write_edges(edges: DataFrame, path: str, date: Column | None = None) -> None:
    """Parquet by day, which readers prune; rows of a day are clustered into few files first."""
    day = date if date is not None else F.to_date(F.timestamp_micros("t"))
    edges.withColumn("date", day).repartition("date").sortWithinPartitions("t").write.partitionBy("date").parquet(path)


def write_text(cycles: DataFrame, path: str) -> None:
    """One cycle a line."""
    cycles.select(F.array_join(F.col("path").cast("array<string>"), " ").alias("value")).write.text(path)


def write_transactions(rows: DataFrame, path: str) -> None:
    """CSV with a header: timestamp in seconds, from, to, buyer, price_usd, token_id."""
    rows.select("timestamp", "from", "to", "buyer", "price_usd", "token_id").write.csv(path, header=True)


def write_log(rows: DataFrame, path: str, schema: str) -> None:
    """CSV with a header and a log format's columns, in their order."""
    rows.select(*[part.split()[0] for part in schema.split(",")]).write.csv(path, header=True)


def write_dictionary(dictionary: DataFrame, path: str) -> None:
    """One vertex a line, in the order of ids: line numbers are the ids again."""
    dictionary.repartitionByRange("vertex_id").sortWithinPartitions("vertex_id").select(F.col("vertex").alias("value")).write.text(path)
