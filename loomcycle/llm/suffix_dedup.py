"""Passages repeated across documents, by a sparse suffix array.

Of all word suffixes only those at minimiser places are kept: the place of the smallest hash of an
ANCHOR-word stretch within every window of `min_words` words. The choice depends on content alone, so two
copies of a passage of min_words keep suffixes at the same places of it.

1. A narrow pass emits the anchors. Those whose stretch occurs in two documents of one Arrow batch are
   known to repeat and travel spread out; of each such stretch two go on as its representatives, so a
   passage in a third of all documents is a few rows per task. Sorted by stretch, runs with two documents
   leave their places.
2. The documents that hold such places give each suffix its context: the min_words - ANCHOR words before
   and after the stretch, as 32-bit word hashes.
3. Suffixes are range-partitioned and sorted by (stretch, words after, words before); every suffix is
   compared with its nearest neighbours of other documents and the match is extended left and right.
4. The neighbour with the longest match after the stretch needn't be the one with the longest before it.
   Where a stretch has suffixes that aren't matched in full, the splits of the remaining words into before
   and after that no neighbour settled are compared by hash, sorted, in the manner of step 1.
5. Matches of min_words at least are merged into maximal spans of each document.

Defined cases: null and short texts have no span; very long texts and words count whole. Rows with a null doc_id take no part; rows that repeat a
doc_id count as one document, and repeats within one document don't count. An empty table gives an empty
result. Further columns of the input are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window as W, functions as F

from loomcycle.llm.shingles import finalise, split_words, window_hashes

MIN_WORDS, ANCHOR = 50, 32
_NONE = -(1 << 63)


def anchor_places(words: list[bytes], min_words: int, anchor: int) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the minimisers; none for texts shorter than min_words."""
    if len(words) < min_words:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h, window = window_hashes(words, anchor), min_words - anchor + 1
    best = np.lib.stride_tricks.sliding_window_view(h, window).argmin(1)  # of equal ones the first
    places = np.unique(best + np.arange(len(best)))
    return places, h[places]


def _contexts(words: list[bytes], places: np.ndarray, anchor: int, reach: int, own: int) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes before (nearest first) and after each stretch; places beyond the text get values that match nothing."""
    one = (window_hashes(words, 1) >> np.uint64(32)).astype(np.uint32)
    odd = finalise(finalise(np.full(2 * reach, own).view(np.uint64)) + np.arange(2 * reach, dtype=np.uint64)).astype(np.uint32)
    padded = np.concatenate([odd[:reach], one, odd[reach:]])
    before = padded[places[:, None] + reach - 1 - np.arange(reach)]
    after = padded[places[:, None] + reach + anchor + np.arange(reach)]
    return before, after


def _emit_anchors(batches: Iterable[pa.RecordBatch], min_words: int, anchor: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        h, doc, place = [], [], []
        for d, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            at, found = anchor_places(split_words(text), min_words, anchor)
            h.append(found)
            place.append(at)
            doc.append(np.full(len(at), d, np.int64))
        if not sum(map(len, h)):
            continue
        h, doc, place = np.concatenate(h), np.concatenate(doc), np.concatenate(place)
        order = np.lexsort((doc, h))
        h, doc, place = h[order], doc[order], place[order]
        start = np.ones(len(h), bool)
        start[1:] = h[1:] != h[:-1]
        run, first = np.cumsum(start) - 1, np.flatnonzero(start)
        last = np.append(first[1:], len(h)) - 1
        known = (doc[first] != doc[last])[run]
        stay = known.copy()
        stay[first] = False
        stay[last] = False
        key = np.where(stay, finalise(h ^ finalise(doc.view(np.uint64) + place.astype(np.uint64))), h)
        columns = [key.view(np.int64), doc, place.astype(np.int32), known, stay]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["h", "doc_id", "place", "known", "stay"])


def _repeated(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, place, another document) where a hash is in two documents, from rows sorted by (h, doc_id).

    Rows that are known or stay pass in any case, without the other document; rows that stay stand for no
    others. A run crosses batches with its first document's rows at most.
    """
    held: list[np.ndarray] = []
    run_h = run_doc = None
    several = False
    for batch in batches:
        h, doc, place, known, stay = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        passed = known | stay
        out = [np.stack([doc, place, np.full(len(doc), _NONE)])[:, passed]]
        h, doc, place, asks = h[~stay], doc[~stay], place[~stay].astype(np.int64), ~passed[~stay]
        if len(h):
            edges = np.append(np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])), len(h))
            first, last = doc[edges[:-1]], doc[edges[1:] - 1]
            run = np.repeat(np.arange(len(first)), np.diff(edges))
            other = np.where(doc == first[run], last[run], first[run])
            rows, multi = np.stack([doc, place, other]), first != last
            done = multi[run]
            for k in sorted({0, len(first) - 1}):
                a, b = edges[k], edges[k + 1]
                mine = rows[:, a:b]
                if k == 0 and run_h == h[a]:
                    if several or multi[0] or doc[a] != run_doc:
                        several = True
                        mine[2] = np.where(mine[0] == run_doc, doc[b - 1], run_doc)
                        for part in held:
                            part[2] = doc[b - 1]
                else:
                    held, run_h, run_doc, several = [], h[a], doc[a], bool(multi[k])
                done[a:b] = False
                mine = mine[:, asks[a:b]]
                if several:
                    out += [*held, mine]
                    held = []
                else:
                    held.append(mine)
            out.append(rows[:, done & asks])
        found = np.concatenate(out, axis=1)
        if found.shape[1]:
            yield pa.RecordBatch.from_arrays([pa.array(found[0]), pa.array(found[1].astype(np.int32)), pa.array(found[2], mask=found[2] == _NONE)], names=["doc_id", "place", "other"])


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Length of the common beginning of rows."""
    return np.logical_and.accumulate(a == b, axis=1).sum(1)


def _compare(h: np.ndarray, doc: np.ndarray, before: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, words before, words after, other document) for each row's nearest neighbours of other documents."""
    n = len(h)
    start = np.ones(n, bool)
    start[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
    runs = np.flatnonzero(start)
    run = np.cumsum(start) - 1
    prev = runs[run] - 1
    nxt = np.append(runs[1:], n)[run]
    out = []
    for other in (prev, nxt):
        row = np.flatnonzero((other >= 0) & (other < n))
        row = row[h[other[row]] == h[row]]
        o = other[row]
        out.append((row, _common(before[row], before[o]), _common(after[row], after[o]), doc[o]))
    return tuple(np.concatenate(x) for x in zip(*out))


_ROWS = "kind int, h long, doc_id long, place int, x binary, y binary, start int, end int, other long"
_NAMES = [c.split()[0] for c in _ROWS.split(", ")]
#: Kinds of rows: a match, and a suffix whose splits are still to be compared.
_MATCH, _OPEN = 0, 1


def _neighbours(batches: Iterable[pa.RecordBatch], min_words: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Looks at rows sorted by (h, words after, words before); passes matches on. `start` of an open row has a bit for
    each number of words before the stretch with which a match is known."""
    reach = min_words - anchor
    every = (1 << (reach + 1)) - 1
    for batch in batches:
        settled = pc.equal(batch["kind"], _MATCH)
        if pc.any(settled).as_py():
            yield batch.filter(settled)
            batch = batch.filter(pc.invert(settled))
        n = len(batch)
        if not n:
            continue
        h, doc, place = (batch[c].to_numpy() for c in ("h", "doc_id", "place"))
        after, before = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint32).reshape(-1, reach) for c in "xy")
        row, left, right, other = _compare(h, doc, before, after)
        good = left + right >= reach
        row, left, right, other = row[good], left[good], right[good], other[good]
        mask = np.zeros(n, np.int64)
        np.bitwise_or.at(mask, row, (1 << (left + 1)) - (1 << (reach - right)))
        if len(row):
            yield _found(_MATCH, batch, row, place[row] - left, place[row] + anchor + right, other)
        # stretches all of whose suffixes here are matched in full are done, unless they go on in another batch
        begin = np.concatenate([[True], h[1:] != h[:-1]])
        run = np.cumsum(begin) - 1
        undone = np.zeros(run[-1] + 1, bool)
        undone[run[mask != every]] = True
        undone[[0, -1]] = True
        alike = np.zeros(n, bool)
        alike[1:] = ~begin[1:] & (after[1:] == after[:-1]).all(1) & (before[1:] == before[:-1]).all(1)
        inner = alike & np.append(alike[1:], False) & (mask == every)
        rest = np.flatnonzero(undone[run] & ~inner)
        yield _found(_OPEN, batch, rest, mask[rest])


def _found(kind: int, batch: pa.RecordBatch, row: np.ndarray, start: np.ndarray, end: np.ndarray | None = None, other: np.ndarray | None = None) -> pa.RecordBatch:
    picked, n = batch.take(pa.array(row, pa.int64())), len(row)
    columns = [picked[c] for c in ("h", "doc_id", "place")] + ([pa.nulls(n, pa.binary())] * 2 if kind == _MATCH else [picked["x"], picked["y"]])
    more = [pa.nulls(n, pa.int32()) if end is None else pa.array(end.astype(np.int32)), pa.nulls(n, pa.int64()) if other is None else pa.array(other)]
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, kind, np.int32)), *columns, pa.array(start.astype(np.int32)), *more], names=_NAMES)


def _splits(batches: Iterable[pa.RecordBatch], reach: int) -> Iterator[pa.RecordBatch]:
    """A hash for each split of an open row's context; place is where the min_words words begin."""
    for batch in batches:
        n = len(batch)
        if not n:
            continue
        h, doc, place, mask = (batch.column(i).to_numpy() for i in range(4))
        after, before = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint32).reshape(-1, reach) for i in (4, 5))
        chain = [np.zeros((n, reach + 1), np.uint64) for _ in range(2)]
        for sums, side in zip(chain, (before, after)):
            for k in range(reach):
                sums[:, k + 1] = finalise(sums[:, k] + side[:, k].astype(np.uint64) + np.uint64(1))
        split = np.arange(reach + 1)
        key = finalise(finalise(h.view(np.uint64)[:, None] ^ chain[0]) + chain[1][:, ::-1] + split.astype(np.uint64))
        known = (mask[:, None] >> split) & 1 == 1
        columns = [key.view(np.int64), np.repeat(doc, reach + 1), place[:, None] - split.astype(np.int32), known]
        flat = [np.ascontiguousarray(c).reshape(-1) for c in columns]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*flat, np.zeros(len(flat[0]), bool))], names=["h", "doc_id", "place", "known", "stay"])


def _merged(matches: DataFrame) -> DataFrame:
    """Unions of overlapping or touching matches: a match beyond all ends before it begins a new span."""
    spans = matches.groupBy("doc_id", "start", "end").agg(F.min("other").alias("other"))
    by_start = W.partitionBy("doc_id").orderBy("start", "end")
    reached = F.max("end").over(by_start.rowsBetween(W.unboundedPreceding, -1))
    begun = spans.withColumn("new", F.coalesce(F.col("start") > reached, F.lit(True)).cast("int"))
    numbered = begun.withColumn("span", F.sum("new").over(by_start.rowsBetween(W.unboundedPreceding, 0)))
    found = numbered.groupBy("doc_id", "span").agg(F.min("start").alias("start_word"), F.max("end").alias("end_word"), F.min("other").alias("other_doc_id"))
    return found.drop("span")


def _suffixes(batches: Iterable[pa.RecordBatch], min_words: int, anchor: int) -> Iterator[pa.RecordBatch]:
    """Suffixes with contexts. Of those alike in stretch and contexts, in two documents of the batch, two go on as
    representatives; the others are matched in full already and travel spread out."""
    reach = min_words - anchor
    weigh = finalise(np.arange(1, 2 * reach + 1, dtype=np.uint64)) | np.uint64(1)
    for batch in batches:
        parts = []
        for d, text, places in zip(*(c.to_pylist() for c in batch.columns)):
            words = split_words(text)
            at = np.array(sorted(places), np.int64)
            at = at[at + anchor <= len(words)]  # a repeated doc_id may have a shorter text too
            if len(at):
                parts.append((window_hashes(words, anchor)[at], np.full(len(at), d, np.int64), at, *_contexts(words, at, anchor, reach, d)))
        if not parts:
            continue
        h, doc, at, before, after = (np.concatenate(x) for x in zip(*parts))
        key = finalise(h ^ finalise((np.hstack([before, after]).astype(np.uint64) * weigh).sum(1, dtype=np.uint64)))
        order = np.lexsort((doc, key))
        h, doc, at, before, after, key = (x[order] for x in (h, doc, at, before, after, key))
        start = np.ones(len(key), bool)
        start[1:] = key[1:] != key[:-1]
        first = np.flatnonzero(start)
        last = np.append(first[1:], len(key)) - 1
        run = np.cumsum(start) - 1
        settled = (doc[first] != doc[last])[run]
        settled[first] = False
        settled[last] = False
        other = np.where(doc[first][run] != doc, doc[first][run], doc[last][run])
        spread = finalise(key ^ finalise(at.astype(np.uint64) ^ doc.view(np.uint64)))
        columns = [
            pa.array(np.where(settled, _MATCH, _OPEN).astype(np.int32)),
            pa.array(np.where(settled, spread, h).view(np.int64)),
            pa.array(doc),
            pa.array(at.astype(np.int32)),
            *(pa.array([None if s else x.tobytes() for s, x in zip(settled, side)], pa.binary()) for side in (after, before)),
            pa.array((at - reach).astype(np.int32), mask=~settled),
            pa.array((at + anchor + reach).astype(np.int32), mask=~settled),
            pa.array(other, mask=~settled),
        ]
        yield pa.RecordBatch.from_arrays(columns, names=_NAMES)


_HASHED = "h long, doc_id long, place int, known boolean, stay boolean"


def _in_two_documents(hashed: DataFrame) -> DataFrame:
    return hashed.repartition("h").sortWithinPartitions("h", "doc_id").mapInArrow(_repeated, "doc_id long, place int, other long")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, anchor: int = ANCHOR) -> DataFrame:
    """doc_id, start_word, end_word (after the last), other_doc_id: spans that matches of min_words words or more with other documents cover."""
    if min_words - anchor > 30:
        raise ValueError("min_words may exceed anchor by 30 at most: a row keeps its open splits as the bits of an int")
    docs = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    reach = min_words - anchor
    anchors = docs.mapInArrow(lambda it: _emit_anchors(it, min_words, anchor), _HASHED)
    by_doc = _in_two_documents(anchors).groupBy(F.col("doc_id").alias("p_id")).agg(F.collect_set("place").alias("places"))
    rows = docs.join(by_doc, docs["doc_id"] == by_doc["p_id"]).select("doc_id", "text", "places").mapInArrow(lambda it: _suffixes(it, min_words, anchor), _ROWS)
    order = ["h", "x", "y", "doc_id", "place"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = rows.repartitionByRange(parts, *order[:3]).sortWithinPartitions(*order).mapInArrow(lambda it: _neighbours(it, min_words, anchor), _ROWS)
    matches = found.where(F.col("kind") == _MATCH).select("doc_id", "start", "end", "other")
    open_ = found.where(F.col("kind") == _OPEN).select("h", "doc_id", "place", "start", "x", "y")
    more = _in_two_documents(open_.mapInArrow(lambda it: _splits(it, reach), _HASHED)).where(F.col("other").isNotNull())
    return _merged(matches.unionByName(more.select("doc_id", F.col("place").alias("start"), (F.col("place") + min_words).alias("end"), "other")))
