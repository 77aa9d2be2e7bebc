"""Length-bounded simple and chordless cycles of the static graph (times ignored)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomcycle.session import cut_lineage


def static_cycles(edges: DataFrame, max_length: int, chordless: bool = False) -> DataFrame:
    """path, length: each directed simple cycle once, from its smallest vertex. Self loops are ignored.

    Chordless: no edge, in either direction, joins two vertices of the path but the cycle's own edges; a cycle of
    two is chordless by itself, and the reverse of an own edge is a chord of longer ones.
    """
    e = cut_lineage(edges.where("src <> dst").select("src", "dst").distinct())
    step = e.select(F.col("src").alias("_s"), F.col("dst").alias("_d"))
    # a root is the smallest vertex, so it needs a larger neighbour and a larger predecessor
    back = e.where("src > dst").select(F.col("dst").alias("_r")).distinct()
    paths = e.where("src < dst").join(back, F.col("src") == F.col("_r"), "left_semi").select(F.col("src").alias("root"), F.col("dst").alias("cur"), F.array("src").alias("path"))
    found = None
    for length in range(2, max_length + 1):
        if length == max_length:  # nothing goes on, so the root is a key too
            met = paths.join(step, (F.col("cur") == F.col("_s")) & (F.col("root") == F.col("_d")))
        else:
            met = paths.join(step, F.col("cur") == F.col("_s")).where((F.col("_d") >= F.col("root")) & ((F.col("_d") == F.col("root")) | ((F.col("_d") != F.col("cur")) & ~F.array_contains("path", F.col("_d")))))
        grown = met.select("root", F.col("_d").alias("cur"), F.array_append("path", F.col("cur")).alias("path"))
        if chordless and length > 2:
            grown = _without_chords(grown, e)
        grown = cut_lineage(grown)
        closed = grown.where("cur = root").select("path", F.size("path").alias("length"))
        found = closed if found is None else found.unionByName(closed)
        if length == max_length:
            break
        paths = grown.where("cur <> root")
        if chordless and length == 2:
            # a path over an edge that goes both ways can't be part of a longer chordless cycle
            paths = _without_chords(paths, e)
        if paths.isEmpty():
            break
    return found


def _without_chords(paths: DataFrame, e: DataFrame) -> DataFrame:
    """Drops rows whose newest path vertex has a chord: checked as each vertex is added, so paths die early."""
    row = paths.withColumn("_id", F.xxhash64("path", "cur"))
    n = F.size("path")
    newest = F.element_at("path", -1)
    pairs = row.select("_id", "path", "cur", newest.alias("x"), F.posexplode("path").alias("i", "y"), n.alias("n"), (F.col("cur") == F.col("root")).alias("closed")).where("x <> y")
    forward = pairs.select("_id", "path", "cur", F.col("x").alias("a"), F.col("y").alias("b"), ((F.col("i") == 0) & F.col("closed")).alias("own"))
    backward = pairs.select("_id", "path", "cur", F.col("y").alias("a"), F.col("x").alias("b"), (F.col("i") == F.col("n") - 2).alias("own"))
    chords = forward.unionByName(backward).where("not own").join(e, (F.col("a") == e["src"]) & (F.col("b") == e["dst"]), "left_semi")
    bad = chords.select(F.col("path").alias("_p"), F.col("cur").alias("_c")).distinct()
    return row.drop("_id").join(bad, (F.col("path") == F.col("_p")) & (F.col("cur") == F.col("_c")), "left_anti")
