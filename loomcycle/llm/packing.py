"""Vector best-fit packing of token pieces into sequences.

A sequence has three capacities: tokens, documents and attention cost (the sum of squared lengths).
Pieces are placed in order of decreasing length. Among the open sequences that a piece fits under
every constraint, the one with the smallest weighted norm of what would be left, or the largest
weighted dot product of piece and residual, takes it; if none fits, a sequence opens. Open sequences
lie in buckets by residual tokens, so the search starts at the tightest and ends where the token term
alone is worse than the best found.

Pieces of full length need no search. All others are dealt by hash into groups of about `GROUP_PIECES`,
packed in one task each: memory is bounded, no group grows with the input, and each group can leave at
most a few sequences partly filled. Lengths alone move; the ids stay where they were made.

Defined cases: a null or empty text, or one without any token, still gets the closing id 0. Rows that
repeat a doc_id are packed as documents of their own. A null doc_id is kept as null. An empty table
gives an empty result. Further columns of the input are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from loomcycle.llm.tokens import tokenizer
from loomcycle.session import cut_lineage

MAX_TOKENS = 2048
GROUP_PIECES = 30_000
WEIGHTS = (1.0, 0.05, 0.05)


def cut_pieces(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, end_id: int = 0, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: documents longer than max_tokens are cut, no others."""
    columns = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.list_(pa.int32()))] * with_ids
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokenizer(tokenizer_path).encode
        for batch in batches:
            rows = []
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc, found in zip(batch.column(0).to_pylist(), encode(texts)):
                ids = np.append(found, np.uint32(end_id)).astype("<u4")
                for piece, start in enumerate(range(0, len(ids), max_tokens)):
                    part = ids[start : start + max_tokens]
                    rows.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())) + (part.astype(np.int32),) * with_ids)
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, (_, k) in zip(zip(*rows), columns)], names=[n for n, _ in columns])

    return docs.select(F.col(id_col).cast("long"), F.col(text_col)).mapInArrow(pieces, schema)


class Bins:
    """Open sequences by residual tokens; those alike in all residuals share a list."""

    def __init__(self, capacity: tuple[int, int, int], weights: tuple[float, float, float], score: str):
        self.capacity, self.score = capacity, score
        self.scale = tuple(w / (c * c) for w, c in zip(weights, capacity))
        self.by_tokens: list[dict[tuple[int, int], list[int]]] = [{} for _ in range(capacity[0] + 1)]
        self.full = np.zeros(capacity[0] + 2, bool)
        self.opened = 0

    def _cost(self, left: tuple[int, int, int], need: tuple[int, int, int]) -> float:
        if self.score == "dot":
            return -sum(s * a * b for s, a, b in zip(self.scale, left, need))
        return sum(s * (a - b) ** 2 for s, a, b in zip(self.scale, left, need))

    def _store(self, bin_no: int, left: tuple[int, int, int]) -> None:
        if left[0] > 0 and left[1] > 0 and left[2] > 0:
            self.by_tokens[left[0]].setdefault(left[1:], []).append(bin_no)
            self.full[left[0]] = True

    def place(self, length: int) -> tuple[int, int]:
        """(sequence, offset) for a piece."""
        need = (length, 1, length * length)
        best, where = None, None
        tokens = length
        while True:
            tokens += int(self.full[tokens:].argmax())
            if tokens > self.capacity[0] or not self.full[tokens]:
                break
            if self.score == "norm" and best is not None and self.scale[0] * (tokens - length) ** 2 >= best:
                break
            for rest in self.by_tokens[tokens]:
                if rest[0] >= 1 and rest[1] >= need[2]:
                    cost = self._cost((tokens, *rest), need)
                    if best is None or cost < best:
                        best, where = cost, (tokens, rest)
            tokens += 1
        if where is None:
            bin_no, left = self.opened, self.capacity
            self.opened += 1
        else:
            tokens, rest = where
            same = self.by_tokens[tokens][rest]
            bin_no, left = same.pop(), (tokens, *rest)
            if not same:
                del self.by_tokens[tokens][rest]
                self.full[tokens] = bool(self.by_tokens[tokens])
        self._store(bin_no, tuple(a - b for a, b in zip(left, need)))
        return bin_no, self.capacity[0] - left[0]


def pack_lengths(lengths: np.ndarray, capacity: tuple[int, int, int], weights: tuple[float, float, float] = WEIGHTS, score: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece, by decreasing length."""
    if len(lengths) and (lengths.max() > capacity[0] or int(lengths.max()) ** 2 > capacity[2]):
        raise ValueError("a piece is larger than a sequence")
    bins, sequence, offset = Bins(capacity, weights, score), np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
    for i in np.argsort(-lengths, kind="stable"):
        sequence[i], offset[i] = bins.place(int(lengths[i]))
    return sequence, offset


def pack(
    pieces: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_documents: int | None = None,
    max_attention: int | None = None,
    weights: tuple[float, float, float] = WEIGHTS,
    score: str = "norm",
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """pieces with sequence_id and offset. Without limits on documents and attention, those that max_tokens implies hold."""
    capacity = (max_tokens, max_documents or max_tokens, max_attention or max_tokens**2)
    pieces = cut_lineage(pieces.withColumn("row_no", F.monotonically_increasing_id()))
    part = pieces.where(F.col("length") < max_tokens)
    groups = max(1, -(-part.count() // group_pieces))
    ids = {c: pieces.schema[c].dataType for c in pieces.columns}
    schema = ", ".join(f"`{c}` {t.simpleString()}" for c, t in ids.items()) + ", grp long, bin long, offset long"

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "row_no"], ascending=[False, True], kind="stable")
        bin_no, offset = pack_lengths(frame["length"].to_numpy(np.int64), capacity, weights, score)
        return frame.assign(bin=bin_no, offset=offset)

    # an odd id for a group's sequences, an even one for a full piece: neither needs numbering across tasks
    dealt = part.withColumn("grp", F.pmod(F.xxhash64("row_no"), F.lit(groups)).cast("long")).repartition(groups, "grp")
    packed = dealt.groupBy("grp").applyInPandas(one, schema)
    packed = packed.withColumn("sequence_id", ((F.col("bin") * F.lit(groups) + F.col("grp")) * 2 + 1).cast("long")).drop("grp", "bin")
    full = pieces.where(F.col("length") >= max_tokens).withColumn("offset", F.lit(0).cast("long")).withColumn("sequence_id", F.col("row_no") * 2)
    return packed.unionByName(full).drop("row_no")
