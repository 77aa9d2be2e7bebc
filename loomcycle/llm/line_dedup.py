"""Line deduplication: documents probe sharded minimal perfect hashes instead of joining their lines.

A line's key is the line without the white space at both ends and with A-Z in lower case; keys of at
least `min_chars` code points count. Keys are 128-bit hashes: 64 bits choose shard and slot, the
other 64 are the fingerprint that a slot must repeat, so keys outside the index fall through.

1. A narrow pass emits each document's distinct key hashes; Spark counts them with map-side combine
   (a line that a third of all documents hold is one row per task).
2. The distinct hashes are dealt to shards of about `SHARD_KEYS`; each shard's task builds a hash-and-displace
   minimal perfect hash and lays the fingerprint, count and largest doc_id of slot i at place i of three arrays.
   A hash that one document alone holds keeps its line whatever the counts of others, so it needs no slot: a
   probe for it meets another's fingerprint.
3. Documents probe: a line goes if its count reaches `min_docs` and its largest holder is another document.
   Arrays that fit in `broadcast_bytes` together go to every executor. Beyond that the documents' hashes travel
   to the shards and the marks travel back; a shard gets as many salted copies as its counts say it has probes
   for, and only the shards with several, `HOT_SHARDS` at most, are told to the tasks.

Two keys of a shard that share 64 bits are told apart by folding the other 64 in (`fold`).

Defined cases: a null or empty text is one empty line, which no key covers. A very long text or line is read
whole. A null doc_id counts as smaller than all others. Rows that repeat a doc_id count as documents of their own
and all keep a line whose largest holder is that doc_id. An empty table gives an empty result. Further columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from xxhash import xxh3_128_digest

from loomcycle.session import cut_lineage

MIN_CHARS, MIN_DOCS = 20, 3
SHARD_KEYS = 1 << 15
BROADCAST_BYTES = 48 << 20
PROBES, HOT_SHARDS = 1 << 20, 10_000
_ARRAYS = ("fold", "seeds", "prints", "counts", "last")
_NO_ID = -(1 << 63)
_SPACE = " \t\n\x0b\x0c\r"
_KEYS = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("doc", pa.int64())])


def key_hashes(lines: list[str], min_chars: int) -> tuple[list[int], np.ndarray]:
    """Places of the lines with a key, and an (n, 2) array of their hashes."""
    at, out = [], []
    for i, line in enumerate(lines):
        if len(line) >= min_chars and len(key := line.strip(_SPACE)) >= min_chars:
            at.append(i)
            out.append(xxh3_128_digest(key.encode("utf-8", "surrogatepass").lower()))  # of bytes: only A-Z
    return at, np.frombuffer(b"".join(out), np.int64).reshape(-1, 2)


def _mix(h: np.ndarray, seed: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (h.astype(np.uint64) ^ (np.asarray(seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xD6E8FEB86659FD93)
        x ^= x >> np.uint64(32)
        x *= np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


class MinimalPerfectHash:
    """Hash and displace: keys fall into buckets of about four; each bucket gets the first seed that sends its keys to free slots."""

    def __init__(self, seeds: np.ndarray, n: int):
        self.seeds, self.n = seeds, n

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        n = len(keys)
        seeds, used = np.zeros(max(1, n // 4), np.uint32), np.zeros(n, bool)
        bucket = (_mix(keys, 1) % np.uint64(len(seeds))).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        starts = np.searchsorted(bucket[order], np.arange(len(seeds) + 1))
        for b in np.argsort(-np.diff(starts), kind="stable"):
            mine = keys[order[starts[b] : starts[b + 1]]]
            if not len(mine):
                break
            seed = 2
            while True:
                tries = np.arange(seed, seed + 64, dtype=np.uint64)
                slots = (_mix(mine[None, :], tries[:, None]) % np.uint64(n)).astype(np.int64)
                good = ~used[slots].any(axis=1)
                if len(mine) > 1:
                    ordered = np.sort(slots, axis=1)
                    good &= (ordered[:, 1:] != ordered[:, :-1]).all(axis=1)
                if good.any():
                    k = int(good.argmax())
                    seeds[b] = seed + k
                    used[slots[k]] = True
                    break
                seed += 64
        return cls(seeds, n)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        bucket = (_mix(keys, 1) % np.uint64(len(self.seeds))).astype(np.int64)
        return (_mix(keys, self.seeds[bucket].astype(np.uint64)) % np.uint64(self.n)).astype(np.int64)


def _folded(h1: np.ndarray, h2: np.ndarray, fold: int) -> np.ndarray:
    return h1 if not fold else (h1.astype(np.uint64) ^ _mix(h2, fold)).view(np.int64)


class LineShard:
    """One shard: the perfect hash and its arrays."""

    def __init__(self, fold: int, seeds: bytes, prints: bytes, counts: bytes, last: bytes):
        self.fold, self.counts = fold, np.frombuffer(counts, np.uint32)
        self.prints, self.last = (np.frombuffer(x, np.int64) for x in (prints, last))
        self.hash = MinimalPerfectHash(np.frombuffer(seeds, np.uint32), len(self.prints))

    def probe(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many documents hold each key (0 if the shard lacks it), and the largest doc_id among them."""
        slot = self.hash.slots(_folded(h1, h2, self.fold))
        return np.where(self.prints[slot] == h2, self.counts[slot], 0), self.last[slot]


def _shard_of(h1: np.ndarray, shards: int) -> np.ndarray:
    return (_mix(h1, 0) % np.uint64(shards)).astype(np.int64)


def _split(text: str | None) -> list[str]:
    return (text or "").split("\n")


def _emit_keys(batches: Iterable[pa.RecordBatch], min_chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found, docs = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            _, hashes = key_hashes(_split(text), min_chars)
            if len(hashes):
                hashes = np.unique(hashes, axis=0) if len(hashes) > 1 else hashes
                found.append(hashes)
                docs.append(np.full(len(hashes), _NO_ID if doc is None else doc, np.int64))
        if found:
            both = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.concatenate(docs))], schema=_KEYS)


def _build_shard(frame: pd.DataFrame) -> pd.DataFrame:
    h1, h2 = frame["h1"].to_numpy(np.int64), frame["h2"].to_numpy(np.int64)
    fold = 0
    while len(np.unique(keys := _folded(h1, h2, fold))) < len(h1):  # the pairs differ, so some fold parts them
        fold += 1
    mph = MinimalPerfectHash.build(keys)
    slot = mph.slots(keys)
    prints, counts, last = np.empty(len(h1), np.int64), np.empty(len(h1), np.uint32), np.empty(len(h1), np.int64)
    prints[slot], counts[slot], last[slot] = h2, np.minimum(frame["n"], 0xFFFFFFFF), frame["last"]
    row = {"shard": int(frame["shard"].iloc[0]), "load": int(frame["n"].sum()), "fold": fold, "seeds": mph.seeds.tobytes()}
    return pd.DataFrame([row | {k: a.tobytes() for k, a in (("prints", prints), ("counts", counts), ("last", last))}])


def repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, least: int = 2) -> DataFrame:
    """h1, h2, n (documents), last (largest doc_id) of the distinct keys that at least `least` documents hold."""
    keys = docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(lambda it: _emit_keys(it, min_chars), "h1 long, h2 long, doc long")
    return keys.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc").alias("last")).where(F.col("n") >= least)


def line_index(lines: DataFrame, shards: int) -> DataFrame:
    """One row per shard: shard, load (probes that will hit it), fold, seeds, prints, counts, last."""

    @F.pandas_udf("long")
    def shard(h1: pd.Series) -> pd.Series:
        return pd.Series(_shard_of(h1.to_numpy(np.int64), shards))

    return lines.withColumn("shard", shard("h1")).groupBy("shard").applyInPandas(_build_shard, "shard long, load long, fold long, seeds binary, prints binary, counts binary, last binary")


def _dropped(doc: int | None, text: str | None, shards: dict[int, LineShard], n: int, min_chars: int, min_docs: int) -> tuple[list[str], np.ndarray]:
    lines = _split(text)
    at, hashes = key_hashes(lines, min_chars)
    drop = np.zeros(len(lines), bool)
    if at:
        owner, me = _shard_of(hashes[:, 0], n), _NO_ID if doc is None else doc
        for s in np.unique(owner):
            if (shard := shards.get(int(s))) is not None:
                mine = np.flatnonzero(owner == s)
                count, last = shard.probe(hashes[mine, 0], hashes[mine, 1])
                drop[np.array(at)[mine[(count >= min_docs) & (last != me)]]] = True
    return lines, drop


_OUT = "doc_id long, n_lines long, n_dropped long, text string"


def _clean(doc: int | None, lines: list[str], drop: np.ndarray) -> tuple:
    return doc, len(lines), int(drop.sum()), "\n".join(x for x, d in zip(lines, drop) if not d)


def _frame(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "n_lines", "n_dropped", "text"])


def line_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = MIN_CHARS,
    min_docs: int = MIN_DOCS,
    broadcast_bytes: int = BROADCAST_BYTES,
    shard_keys: int = SHARD_KEYS,
    probes: int = PROBES,
) -> DataFrame:
    """doc_id, n_lines (before), n_dropped, text (the lines that stay)."""
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    lines = cut_lineage(repeated_lines(docs, "doc_id", "text", min_chars, min(2, min_docs)))
    n = max(1, -(-lines.count() // shard_keys))
    index = cut_lineage(line_index(lines, n))
    size = sum(F.length(c) for c in _ARRAYS[1:])
    if (index.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes:
        sent = spark.sparkContext.broadcast({r["shard"]: (r["fold"], *(bytes(r[c]) for c in _ARRAYS[1:])) for r in index.collect()})

        def probe(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shards = {k: LineShard(*v) for k, v in sent.value.items()}
            for batch in batches:
                rows = [_clean(d, *_dropped(d, t, shards, n, min_chars, min_docs)) for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
                if rows:
                    yield _frame(rows)

        return docs.mapInArrow(probe, _OUT)
    return _probe_by_shuffle(docs, index, n, min_chars, min_docs, probes)


def _probe_by_shuffle(docs: DataFrame, index: DataFrame, n: int, min_chars: int, min_docs: int, per_task: int) -> DataFrame:
    """For an index of any size: hashes go to (shard, salt), marked places come back to their rows."""
    total = index.agg(F.sum("load")).first()[0] or 0
    per_task = max(per_task, -(-total // HOT_SHARDS))  # so fewer than HOT_SHARDS shards can have more
    salted = index.withColumn("salts", F.floor(F.col("load") / per_task) + 1)
    hot = {r["shard"]: r["salts"] for r in salted.where("salts > 1").select("shard", "salts").collect()}
    docs = cut_lineage(docs.withColumn("row_no", F.monotonically_increasing_id()))

    def places(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, doc, place, keys = [], [], [], []
            for r, d, t in zip(*(c.to_pylist() for c in batch.columns)):
                at, hashes = key_hashes(_split(t), min_chars)
                row += [r] * len(at)
                doc += [_NO_ID if d is None else d] * len(at)
                place += at
                keys.append(hashes)
            if row:
                both = np.concatenate(keys)
                owner = _shard_of(both[:, 0], n)
                salts = np.ones(len(owner), np.int64)
                for shard in np.unique(owner).tolist():
                    if shard in hot:
                        salts[owner == shard] = hot[shard]
                columns = [row, doc, place, both[:, 0], both[:, 1], owner, np.array(row) % salts]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names=["row_no", "doc", "place", "h1", "h2", "shard", "salt"])

    def mark(key: tuple, probes: pd.DataFrame, shard: pd.DataFrame) -> pd.DataFrame:
        if not len(probes) or not len(shard):
            return pd.DataFrame({"row_no": [], "place": []})
        one = LineShard(int(shard["fold"].iloc[0]), *(bytes(shard[c].iloc[0]) for c in _ARRAYS[1:]))
        count, last = one.probe(probes["h1"].to_numpy(np.int64), probes["h2"].to_numpy(np.int64))
        return probes.loc[(count >= min_docs) & (last != probes["doc"].to_numpy(np.int64)), ["row_no", "place"]]

    probes = docs.select("row_no", "doc_id", "text").mapInArrow(places, "row_no long, doc long, place long, h1 long, h2 long, shard long, salt long")
    salted = salted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).select("shard", "salt", *_ARRAYS)
    marks = probes.groupBy("shard", "salt").cogroup(salted.groupBy("shard", "salt")).applyInPandas(mark, "row_no long, place long")
    by_row = marks.groupBy("row_no").agg(F.collect_set("place").alias("places"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, text, marked in zip(*(c.to_pylist() for c in batch.columns)):
                lines = _split(text)
                drop = np.zeros(len(lines), bool)
                drop[marked or []] = True
                rows.append(_clean(doc, lines, drop))
            if rows:
                yield _frame(rows)

    return docs.join(by_row, "row_no", "left").select("doc_id", "text", "places").mapInArrow(cut, _OUT)
