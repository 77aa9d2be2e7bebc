"""Toxicity by multiple-instance learning: sentences are the instances, documents carry the labels.

A sentence's probability is a logistic function of its distinct words, each a sum of hashed weights of
the word and its character 4- and 5-grams; a document is toxic unless every sentence is clean
(noisy-or). Training climbs the likelihood of document labels only, so the blame settles on the
sentences that tell toxic documents from clean ones, and those are returned with the score.

The model is fitted on at most `sample_per_class` labelled documents of each class, taken in the order
of a hash of their ids; those of more than `longest` bytes are left out, so what reaches the driver is bounded.
Scoring reads every document whole, whatever its length, in one narrow pass.

Defined cases: a null or empty text has no sentence and scores 0. Null labels and labels of unknown
documents are left out; of several labels the most toxic counts. A null doc_id has no label and counts
as held out. Without labels of both classes every score is 0. Repeated rows are scored alike. An empty
table gives an empty result. Further columns of the input are kept by `score` and never used.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

BITS, GRAMS = 18, (4, 5)
SAMPLE_PER_CLASS, LONGEST = 2000, 1 << 16
THRESHOLD = 0.7
_WORDS, _ENDS = re.compile(r"\w+"), re.compile(r"[.!?\n]+")
_CACHE = 300_000


def sentences(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of the stretches between sentence ends and line ends."""
    at = 0
    for m in _ENDS.finditer(text):
        if m.start() > at:
            yield at, m.start()
        at = m.end()
    if at < len(text):
        yield at, len(text)


def word_features(word: str) -> list[int]:
    padded, mask = f"<{word}>", (1 << BITS) - 1
    grams = {padded} | {padded[i : i + n] for n in GRAMS for i in range(len(padded) - n + 1)}
    return [zlib.crc32(g.encode("utf-8", "surrogatepass")) & mask for g in sorted(grams)]


class ToxicityModel:
    def __init__(self, weights: np.ndarray, bias: float):
        self.weights, self.bias = weights.astype(np.float32), float(bias)
        self._cache: dict[str, float] = {}

    def __getstate__(self):
        return {"weights": self.weights, "bias": self.bias, "_cache": {}}

    def _word(self, word: str) -> float:
        if len(self._cache) >= _CACHE:
            self._cache.clear()
        value = self._cache[word] = float(self.weights[word_features(word)].sum())
        return value

    def sentence_logits(self, text: str) -> tuple[list[tuple[int, int]], np.ndarray]:
        spans, logits, known = [], [], self._cache.get
        low = text.lower()
        if len(low) != len(text):  # a few letters change their length; spans refer to the text itself
            low = text
        for start, end in sentences(low):
            total = self.bias
            for word in dict.fromkeys(_WORDS.findall(low, start, end)):
                value = known(word)
                total += self._word(word) if value is None else value
            spans.append((start, end))
            logits.append(total)
        return spans, np.array(logits)

    def score(self, text: str | None) -> tuple[float, list[tuple[int, int, float]]]:
        """Noisy-or of the sentences, and (start, end, probability) of those that are likelier toxic than not."""
        if not text:
            return 0.0, []
        spans, z = self.sentence_logits(text)
        if not spans:
            return 0.0, []
        clean = -np.logaddexp(0, z)  # log of the probability that a sentence is clean
        p = -np.expm1(clean)
        return float(-np.expm1(clean.sum())), [(*spans[i], float(p[i])) for i in np.flatnonzero(p >= 0.5)]


def fit(texts: list[str], toxic: np.ndarray, rounds: int = 200, rate: float = 400.0, shrink: float = 3e-3, min_docs: int = 4) -> ToxicityModel:
    """Proximal gradient ascent with momentum on the noisy-or likelihood of the labels; classes weigh alike.

    `shrink` is an L1 penalty: of some hundred thousand features a few hundred keep a weight.
    """
    if not len(texts) or toxic.min() == toxic.max():
        return ToxicityModel(np.zeros(1 << BITS), -np.inf)
    vocab: dict[str, int] = {}
    occ_word, occ_sent, sent_doc = array("i"), array("i"), array("i")
    for d, text in enumerate(texts):
        low = (text or "").lower()
        for start, end in sentences(low):
            for word in dict.fromkeys(_WORDS.findall(low, start, end)):
                occ_word.append(vocab.setdefault(word, len(vocab)))
                occ_sent.append(len(sent_doc))
            sent_doc.append(d)
    occ_word, occ_sent, sent_doc = (np.array(x, np.int64) for x in (occ_word, occ_sent, sent_doc))
    flat, many = array("i"), array("i")
    for word in vocab:
        found = word_features(word)
        flat.extend(found)
        many.append(len(found))
    n_words, col = len(vocab), np.array(flat, np.int32)
    row = np.repeat(np.arange(n_words, dtype=np.int32), np.array(many))
    # features of fewer than min_docs sampled documents would only memorise
    pair = np.unique(occ_word * len(texts) + sent_doc[occ_sent])
    word_docs = np.bincount(pair // len(texts), minlength=n_words)
    keep = np.bincount(col, weights=word_docs[row], minlength=1 << BITS)[col] >= min_docs
    row, col = row[keep], col[keep]

    y = toxic.astype(float)
    share = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum())
    used, col = np.unique(col, return_inverse=True)
    docs_of = np.bincount(col, weights=word_docs[row], minlength=len(used))
    pace = 1 / np.sqrt(docs_of)  # rare features learn nearly as fast as frequent ones
    w, v, bias, vb = np.zeros(len(used)), np.zeros(len(used)), -5.0, 0.0
    for _ in range(rounds):
        word_z = np.bincount(row, weights=w[col], minlength=n_words)
        z = np.clip(bias + np.bincount(occ_sent, weights=word_z[occ_word], minlength=len(sent_doc)), -40, 40)
        log_clean = np.bincount(sent_doc, weights=-np.logaddexp(0, z), minlength=len(texts))
        doc = np.clip(-np.expm1(log_clean), 1e-9, 1)
        pull = np.where(y == 1, (1 - doc) / doc, -1.0) * share
        g = pull[sent_doc] / (1 + np.exp(-z))
        word_g = np.bincount(occ_word, weights=g[occ_sent], minlength=n_words)
        v = 0.9 * v + np.bincount(col, weights=word_g[row], minlength=len(used)) * pace
        vb = 0.9 * vb + g.sum()
        step = min(rate, 0.3 / max(float(np.abs(v).max()), 1e-12))  # no weight moves further than 0.3 at once
        w = w + step * v
        w = np.sign(w) * np.maximum(np.abs(w) - step * shrink * pace, 0)  # what stands on little evidence goes back to 0
        bias += min(max(step * vb * 0.1, -0.2), 0.2)
    weights = np.zeros(1 << BITS)
    weights[used] = w
    return ToxicityModel(weights, bias)


def held_out(doc_id: Column) -> Column:
    """Rows that training never sees: one third, by a checksum of the id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 3 == 1, F.lit(True))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_per_class: int = SAMPLE_PER_CLASS, longest: int = LONGEST) -> ToxicityModel:
    known = labels.where(F.col("toxic").isin(0, 1) & ~held_out(F.col("doc_id"))).groupBy(F.col("doc_id").cast("long").alias("l_id")).agg(F.max("toxic").cast("int").alias("y"))
    order = F.xxhash64("l_id")
    sample = None
    for y in (0, 1):  # bounded: two ordered limits
        part = known.where(F.col("y") == y).orderBy(order, "l_id").limit(sample_per_class)
        sample = part if sample is None else sample.unionByName(part)
    joined = docs.select(F.col(id_col).cast("long").alias("d_id"), F.col(text_col).alias("t")).join(F.broadcast(sample), F.col("d_id") == F.col("l_id")).where(F.coalesce(F.octet_length("t"), F.lit(0)) <= longest)
    rows = joined.groupBy("d_id", "y").agg(F.min("t").alias("t")).orderBy("d_id").collect()  # at most 2 * sample_per_class rows
    return fit([r["t"] or "" for r in rows], np.array([r["y"] for r in rows], int))


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", into: str = "toxicity") -> DataFrame:
    """docs with a column struct<score double, spans array<struct<start, end, p>>>; spans are the offending sentences."""
    sent = docs.sparkSession.sparkContext.broadcast(model)  # 2^BITS weights, whatever the input's size

    @F.pandas_udf("score double, spans array<struct<start:int,end:int,p:double>>")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        mine = sent.value
        for texts in parts:
            found = [mine.score(t) for t in texts]
            spans = [[{"start": a, "end": b, "p": p} for a, b, p in s] for _, s in found]
            yield pd.DataFrame({"score": [s for s, _ in found], "spans": spans})

    return docs.withColumn(into, scored(F.col(text_col)))


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted, spans: one row per document."""
    scored = score(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), train(docs, labels, id_col, text_col), "text")
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        F.col("toxicity.score").alias("score"),
        (F.col("toxicity.score") >= threshold).cast("int").alias("predicted"),
        F.col("toxicity.spans").alias("spans"),
    )
