"""Mixing sources to target weights by balanced sampling with the cube method.

Targets: sources in code-point order (null last) have weights from a repeating list and share a budget;
a target stops at `most` times its source's words, and what is over is shared by weight among the others.
A document is taken floor(r) times for sure, r being its source's target over its size, and once more
with probability r - floor(r). The flight phase moves these probabilities along the null space of two
balancing equations - words and number of documents - until all but a few are 0 or 1:

* a source's documents are dealt by a hash of id and text into blocks of about `BLOCK`, so a source with a third
  of all rows is many tasks; a block that one often repeated row overfills is dealt again by row number; each
  block flies on its own and stops at `LANDING` fractional documents;
* the blocks' leftovers, `LANDING` each, fly together in groups, and again, until one group is left;
* the landing problem of at most `LANDING` documents is solved by looking at all roundings.

Each step keeps a source's expected words and documents exactly, so only the landing errs.

Defined cases: a null text has no words; documents without words are never taken. A source whose ratio
is a whole number needs no sampling. Repeated rows and null doc_ids are documents of their own. A very long text
counts all of its words. An empty table gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from loomcycle.session import cut_lineage

WEIGHTS, SHARE, MOST = (3.0, 1.0, 2.0), 1.5, 2.0
BLOCK, LANDING = 20_000, 12
_EPS = 1e-9


def words(text):
    """Number of runs of characters that aren't white space."""
    return F.when(F.col(text).isNull(), 0).otherwise(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+"))).cast("long")


def targets(sized: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """source, source_size, target: one row per source.

    The level L with sum(min(most * size, weight * L)) = budget: in the order of most * size / weight, a
    source is capped if L lies beyond its own ratio, which running sums over the sources tell.
    """
    sums = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = W.orderBy(F.col("source").asc_nulls_last())
    ws = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(F.col("n") - 1, F.lit(len(weights))) + 1).cast("int"))
    # these windows see one row per source
    s = sums.withColumn("n", F.row_number().over(order)).withColumn("w", ws).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    everything = W.partitionBy()
    by_ratio = W.orderBy(F.col("cap") / F.col("w"), "n")
    before = by_ratio.rowsBetween(W.unboundedPreceding, -1)
    s = (
        s.withColumn("budget", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("cap_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("w_left", F.sum("w").over(everything) - F.coalesce(F.sum("w").over(before), F.lit(0.0)))
        .withColumn("level_here", (F.col("budget") - F.col("cap_before")) / F.col("w_left"))
        .withColumn("capped", F.col("level_here") >= F.col("cap") / F.col("w"))
        .withColumn("level", F.min(F.when(~F.col("capped"), F.struct("cap_before", "level_here"))).over(everything)["level_here"])
    )
    target = F.when(F.col("capped") | F.col("level").isNull(), F.col("cap")).otherwise(F.col("w") * F.col("level"))
    return s.select("source", "source_size", target.alias("target"))


def fly(p: np.ndarray, x: np.ndarray, rng: np.random.Generator, stop: int = LANDING) -> np.ndarray:
    """Flight phase for the equations sum(p) and sum(p * x): three fractional units at a time move along
    the null space of their two equations until one is 0 or 1, while more than `stop` are fractional."""
    p = p.astype(float).copy()
    todo = [int(i) for i in np.flatnonzero((p > _EPS) & (p < 1 - _EPS))]
    left, held, nxt = len(todo), todo[:3], 3
    while left > max(stop, 2) and len(held) == 3:
        a, b, c = held
        u = (float(x[b] - x[c]), float(x[c] - x[a]), float(x[a] - x[b]))
        if not any(u):  # equal sizes: moving two against each other keeps both sums
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[i]) / v if v > 0 else p[i] / -v for i, v in zip(held, u) if v)
        down = min(p[i] / v if v > 0 else (1 - p[i]) / -v for i, v in zip(held, u) if v)
        # either way with the probability that keeps each unit's expectation
        step = up if rng.random() * (up + down) < down else -down
        kept = []
        for i, v in zip(held, u):
            p[i] += step * v
            if p[i] <= _EPS or p[i] >= 1 - _EPS:
                p[i], left = round(p[i]), left - 1
            else:
                kept.append(i)
        while len(kept) < 3 and nxt < len(todo):
            kept.append(todo[nxt])
            nxt += 1
        held = kept
    return p


def land(p: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The rounding of the fractional units that comes nearest to their words, then to their number."""
    p = p.copy()
    open_ = np.flatnonzero((p > _EPS) & (p < 1 - _EPS))
    if len(open_):
        bits = (np.arange(1 << len(open_))[:, None] >> np.arange(len(open_))) & 1
        words_off = np.abs(bits @ x[open_] - p[open_] @ x[open_])
        count_off = np.abs(bits.sum(1) - p[open_].sum())
        p[open_] = bits[np.lexsort((count_off, np.round(words_off, 6)))[0]]
    return p


def _flight(final: bool):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["key", "size", "row_no"], kind="stable")  # by content, so reruns agree
        p, x = frame["p"].to_numpy(float), frame["size"].to_numpy(float)
        p = fly(p, x, np.random.default_rng(int(frame["key"].iloc[0]) & 0xFFFFFFFF))
        return frame[["source", "row_no", "key", "size"]].assign(p=land(p, x) if final else p)

    return run


_ROWS = "source string, row_no long, key long, size long, p double"


def mix(
    docs: DataFrame,
    weights: tuple[float, ...] = WEIGHTS,
    share: float = SHARE,
    most: float = MOST,
    block: int = BLOCK,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    row_col: str | None = None,
) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken, row_no: one row per input row; row_col names unique longs to use as row_no."""
    if block < 4 * LANDING:
        raise ValueError(f"blocks of fewer than {4 * LANDING} rows may leave as many as they take")
    sized = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(source_col).cast("string").alias("source"), words(text_col).alias("size"), F.xxhash64(F.col(id_col).cast("long"), text_col).alias("key"), F.col(row_col).alias("row_no") if row_col else F.monotonically_increasing_id().alias("row_no"))
    sized = cut_lineage(sized)
    per_source = cut_lineage(targets(sized, weights, share, most))
    same = sized["source"].eqNullSafe(per_source["source"])
    # one row per source; Spark broadcasts it only below its own size threshold and joins by shuffle above
    rows = sized.join(per_source, same).drop(per_source["source"])
    ratio = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most)))).otherwise(F.lit(0.0))
    sure = F.floor(ratio + F.lit(_EPS))
    rows = rows.withColumn("sure", F.when(F.col("size") > 0, sure).otherwise(0).cast("long")).withColumn("p", F.when(F.col("size") > 0, F.greatest(ratio - sure, F.lit(0.0))).otherwise(0.0))
    rows = cut_lineage(rows)

    open_ = rows.where((F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)).select("source", "row_no", "key", "size", "p")
    counts = open_.groupBy("source").agg((F.floor(F.count("*") / F.lit(block)) + 1).alias("blocks"))
    blocked = open_.join(counts, open_["source"].eqNullSafe(counts["source"])).drop(counts["source"])
    blocked = cut_lineage(blocked.withColumn("block", F.pmod(F.xxhash64("key"), "blocks")).drop("blocks"))
    # blocks vary little around `block`; one of several times that has a row that repeats
    full = blocked.groupBy("source", "block").count().where(F.col("count") > 4 * block).select(F.col("source").alias("_s"), F.col("block").alias("_b"), F.floor(F.col("count") / block).alias("parts"))
    parted = blocked.join(full, blocked["source"].eqNullSafe(F.col("_s")) & (F.col("block") == F.col("_b")), "left").drop("_s", "_b")
    parted = parted.withColumn("part", F.coalesce(F.pmod(F.xxhash64("row_no"), "parts"), F.lit(0)))
    state = cut_lineage(parted.groupBy("source", "block", "part").applyInPandas(_flight(False), _ROWS))
    settled = state.where((F.col("p") <= _EPS) | (F.col("p") >= 1 - _EPS))
    fractional = state.where((F.col("p") > _EPS) & (F.col("p") < 1 - _EPS))
    while True:  # each round leaves LANDING of `block` rows, so a few rounds reach one group a source
        most_left = fractional.groupBy("source").count().agg(F.max("count")).first()[0] or 0
        groups = -(-most_left // block)
        if groups <= 1:
            break
        state = cut_lineage(fractional.withColumn("block", F.pmod(F.xxhash64("key"), F.lit(groups))).groupBy("source", "block").applyInPandas(_flight(False), _ROWS))
        settled = settled.unionByName(state.where((F.col("p") <= _EPS) | (F.col("p") >= 1 - _EPS)))
        fractional = state.where((F.col("p") > _EPS) & (F.col("p") < 1 - _EPS))
    landed = fractional.groupBy("source").applyInPandas(_flight(True), _ROWS)
    chosen = settled.unionByName(landed).where(F.col("p") > 0.5).select("row_no", F.lit(1).alias("once"))
    copies = F.col("sure") + F.coalesce("once", F.lit(0))
    return rows.join(chosen, "row_no", "left").select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "row_no"
    )
