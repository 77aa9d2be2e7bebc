import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from loomcycle.llm.exact_dedup import chunks, exact_dedup
from loomcycle.llm.line_dedup import MinimalPerfectHash, line_dedup
from loomcycle.llm.ngram_join import ngram_join
from loomcycle.llm.shingles import shingle_set, split_words, window_hashes
from loomcycle.llm.signature_tree import Forest, link_sets
from loomcycle.llm.suffix_dedup import repeated_passages

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}
ODD = [None, "", " ", "\n\n", "a", "A", "a b", "a\tb", "a  b ", "é É", "x" * 5000, "w " * 3000, None, "", "A B c d E", "a b c d e", "a b c d e f"]


def prose(rng, n, words=400):
    return [f"w{rng.randrange(words)}" for _ in range(n)]


def mixture(seed=1, n=60):
    """Texts with copies, near copies, shared passages and odd ones."""
    rng = random.Random(seed)
    base, out = [prose(rng, rng.randint(5, 300)) for _ in range(8)], list(ODD)
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 3, 20])):
            words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        if rng.random() < 0.3:
            words += base[0][:80]
        seps = [rng.choice([" ", " ", "\n", "  "]) for _ in words]
        out.append("".join(w + s for w, s in zip(words, seps)))
    out += out[:5]
    return out


# --- exact ---


def want_exact(rows):
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in rows}
    groups = defaultdict(list)
    for i, t in norm.items():
        groups[t].append(i)
    return {i: (min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm.items()}


@pytest.mark.parametrize("id_bits", [64, 3])  # three bits: nearly all identifiers stand for several chunks
def test_exact_dedup(docs_of, id_bits):
    rows = list(enumerate(mixture()))
    got = {r.doc_id: (r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact_dedup(docs_of(rows, extra=True), id_bits=id_bits).collect()}
    assert got == want_exact(rows)


def test_exact_dedup_null_and_repeated_ids(docs_of):
    got = exact_dedup(docs_of([(None, "a"), (3, "a"), (3, "a"), (None, "b")])).collect()
    assert sorted((r.doc_id or -1, r.keep_id, r.group_size, r.kept) for r in got if r.group_size == 3) == [(-1, 3, 3, False), (3, 3, 3, False), (3, 3, 3, True)]
    assert [(r.doc_id, r.keep_id, r.kept) for r in got if r.group_size == 1] == [(None, None, True)]
    assert exact_dedup(docs_of([])).count() == 0


def test_chunks_are_the_text(docs_of):
    rows = docs_of(["Some words. " * 400, "no end " * 2000, "x", "", "😀. " * 900])
    for r in rows.select("text", chunks(rows["text"]).alias("c")).collect():
        assert "".join(r.c) == r.text and all(len(c) <= 2048 for c in r.c)


# --- lines ---


def want_lines(rows, min_chars=20, min_docs=3):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(LOW)
    where = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                where[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(where.get(key(x), ())) < min_docs or max(where[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("broadcast_bytes", [1 << 20, 0])
def test_line_dedup(docs_of, broadcast_bytes):
    rng = random.Random(3)
    lines = [f"line number {k} of some length {'é' * (k % 4)}" for k in range(60)] + ["", "short", "x" * 19, "y" * 20]
    texts = [None, "", "\n"] + ["\n".join(rng.choice([str.upper, str.lower, "  {}\t".format])(rng.choice(lines)) for _ in range(rng.randint(1, 30))) for _ in range(50)]
    rows = list(enumerate(texts))
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup(docs_of(rows, extra=True), broadcast_bytes=broadcast_bytes, shard_keys=10).collect()}
    assert got == want_lines(rows)
    assert any(v[1] for v in got.values())


def test_line_dedup_odd_tables(docs_of):
    line = "a line that is long enough"
    got = line_dedup(docs_of([(None, line), (1, line), (2, line), (2, line)])).collect()
    assert sorted((r.doc_id or -1, r.n_dropped) for r in got) == [(-1, 1), (1, 1), (2, 0), (2, 0)]
    assert line_dedup(docs_of([])).count() == 0


def test_minimal_perfect_hash():
    keys = np.unique(np.random.default_rng(1).integers(-(1 << 63), 1 << 63, 5000))
    for n in (1, 2, 3, 50, len(keys)):
        assert sorted(MinimalPerfectHash.build(keys[:n]).slots(keys[:n])) == list(range(n))


# --- near duplicates ---


def shingles(text):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def want_classes(rows):
    sets = {i: shingles(t) for i, t in rows}
    ids = sorted(sets)
    forest, at = Forest(len(ids)), {d: k for k, d in enumerate(ids)}
    for i in ids:
        for j in ids:
            o = len(sets[i] & sets[j])
            if j < i and o and 100 * o >= 80 * len(sets[i] | sets[j]):
                forest.union(at[i], at[j])
    return {i: (len(sets[i]), ids[forest.find(at[i])]) for i in ids}


@pytest.mark.parametrize("options", [{}, {"tile_tokens": 300, "bits": 6}])
def test_ngram_join(docs_of, options):
    rows = list(enumerate(mixture(2, 80)))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join(docs_of(rows, extra=True), **options).collect()}
    assert got == want_classes(rows)
    assert max(Counter(c for _, c in got.values()).values()) > 5


def test_ngram_join_null_repeated_and_empty(docs_of):
    a, b = " ".join(f"a{k}" for k in range(40)), " ".join(f"b{k}" for k in range(40))
    got = ngram_join(docs_of([(None, a), (5, a), (5, b), (7, a + " z"), (9, b), (9, b), (4, None)])).collect()
    assert sorted((r.doc_id or -1, r.n_shingles, r.component_id) for r in got) == [(-1, 36, None), (4, 0, 4), (5, 36, 5), (5, 36, 5), (7, 37, 5), (9, 36, 5), (9, 36, 5)]
    assert ngram_join(docs_of([])).count() == 0


def test_ngram_join_ships_sets_in_shares(spark, docs_of, monkeypatch):
    """Chains of near copies are one cell of many tiles, whose sets go to many tasks: not all of them at once."""
    from tests.test_shares import taken

    rng, texts = random.Random(7), []
    words = prose(rng, 120, 10**6)
    for _ in range(150):
        words[rng.randrange(len(words))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    docs, tokens = docs_of(texts).cache(), sum(len(shingles(t)) for t in texts)
    monkeypatch.setattr("loomcycle.llm.ngram_join.SHARE_TOKENS", 1, raising=False)
    got, stages = taken(spark, lambda: sorted((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join(docs, tile_tokens=1000).collect()))
    classes = want_classes(list(enumerate(texts)))
    assert got == [(i, len(shingles(t)), classes[i][1]) for i, t in enumerate(texts)]
    assert len(texts) < max(x.shuffleWriteRecords() for x in stages)
    # all sets take 8 bytes a token; without shares, they are shuffled several times over by one stage
    assert max(x.shuffleWriteBytes() for x in stages) < 8 * tokens
    docs.unpersist()


def test_link_sets_between_groups():
    sets = [shingle_set(" ".join(f"{g}{k}" for k in range(30))) for g in "aabb"]
    assert link_sets(sets, np.array([0, 1, 0, 1])) and len(link_sets(sets)) == 2
    assert link_sets(sets, np.array([0, 0, 0, 0])) == []


def test_window_hashes_of_long_texts_and_words():
    words = [b"w%d" % (k % 1000) for k in range(100_000)]
    whole = window_hashes(words, 5)
    assert len(whole) == len(words) - 4 and (whole[70_000:70_010] == window_hashes(words[70_000:70_014], 5)).all()
    long_word = b"y" * 300_000
    assert len(set(window_hashes([long_word, b"a", b"b", b"c", b"d", long_word + b"z", b"a", b"b", b"c", b"d"], 5).tolist())) == 6


def test_long_words_hash_alike_whatever_else_a_text_holds():
    passage = [b"w%d" % k for k in range(25)] + [b"http://" + b"u" * 63] + [b"v%d" % k for k in range(24)]
    whole = window_hashes(passage, 32)
    assert (window_hashes([*passage, b"x" * 9_000], 32)[: len(whole)] == whole).all()
    runs = [bytes([97 + k]) * 90 for k in range(20)]
    alone = window_hashes(runs, 5)
    assert (window_hashes([*runs, b"z" * 60_000], 5)[: len(alone)] == alone).all()
    for n in (4_094, 4_095, 4_096, 5_000):  # 63 words of the longest fit the tables
        words = [b"%d-" % (k % 10) + b"y" * (n - 2) for k in range(200)]
        got = window_hashes(words, 32)
        assert len(got) == 169 and (got[100:110] == window_hashes(words[100:141], 32)).all()
        assert (got == window_hashes([*words, b"q" * 100_000], 32)[:169]).all() and len(set(got.tolist())) == 10


# --- passages ---


def want_spans(rows, n=50):
    words = {i: split_words(t) for i, t in rows}
    where = defaultdict(set)
    for i, w in words.items():
        for k in range(len(w) - n + 1):
            where[tuple(w[k : k + n])].add(i)
    out = {}
    for i, w in words.items():
        spans = []
        for k in range(len(w) - n + 1):
            if len(where[tuple(w[k : k + n])]) > 1:
                if spans and k <= spans[-1][1]:
                    spans[-1][1] = k + n
                else:
                    spans.append([k, k + n])
        if spans:
            out[i] = [tuple(s) for s in spans]
    return out


def test_repeated_passages(docs_of):
    rng = random.Random(9)
    pool = [prose(rng, rng.randint(8, 70), 10**6) for _ in range(30)]
    texts = [None, "", "few words", "w " * 300, "w " * 200]
    for _ in range(70):  # lines in any order: matches that end anywhere
        parts = [rng.choice(pool) if rng.random() < 0.7 else prose(rng, 30, 10**6) for _ in range(rng.randint(1, 8))]
        texts.append(" ".join(w for p in parts for w in p))
    rows = list(enumerate(texts))
    got = defaultdict(list)
    for r in repeated_passages(docs_of(rows, extra=True)).collect():
        got[r.doc_id].append((r.start_word, r.end_word))
        assert r.other_doc_id != r.doc_id
    assert {k: sorted(v) for k, v in got.items()} == want_spans(rows)


def test_repeated_passages_odd_tables(docs_of):
    a = " ".join(f"a{k}" for k in range(60))
    got = repeated_passages(docs_of([(None, a), (1, a), (1, a)])).collect()
    assert got == []
    assert [(r.doc_id, r.other_doc_id) for r in repeated_passages(docs_of([(1, a), (1, "short"), (2, a + " b")])).orderBy("doc_id").collect()] == [(1, 2), (2, 1)]
    assert repeated_passages(docs_of([])).count() == 0


def test_candidates_of_salted_shingles():
    """Runs that salts and batches cut are joined again: what the runs of unsalted rows join stays joined."""
    import pyarrow as pa

    from loomcycle.llm.ngram_join import _candidates

    rng = random.Random(8)
    nodes = [(rng.randrange(3), rng.randint(1, 60), i + 100) for i in range(200)]

    def run(rows, step):
        rows = sorted(rows)
        cut = [rows[i : i + step] for i in range(0, len(rows), step)]
        batches = (pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*part), (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int64()))], names=["h", "salt", "lo", "hi", "node"]) for part in cut)
        return [r for b in _candidates(batches, 80) for r in b.to_pylist()]

    def classes(pairs):
        forest = Forest(400)
        for a, b in pairs:
            forest.union(a, b)
        return [forest.find(i) for i in range(400)]

    want = classes((r["a"], r["b"]) for r in run([(h, -1, n, n, i) for h, n, i in nodes], 1000))
    for step in (1, 7, 1000):
        assert classes((r["a"], r["b"]) for r in run([(h, -1, n, n, i) for h, n, i in nodes], step)) == want
        salted = run([(h, i % 5, n, n, i) for h, n, i in nodes], step)
        runs = [(r["h"], -1, r["lo"], r["hi"], r["a"]) for r in salted if r["h"] is not None]
        pairs = [(r["a"], r["b"]) for r in salted if r["h"] is None] + [(r["a"], r["b"]) for r in run(runs, step)]
        got = classes(pairs)
        for h, n, i in nodes:  # salted runs may join more, never less
            for k, m, j in nodes:
                if h == k and 100 * min(n, m) >= 80 * max(n, m):
                    assert got[i] == got[j]


def test_line_dedup_hot_shards_and_shared_bits(docs_of):
    from loomcycle.llm import line_dedup as L

    lines = [f"a line that is long enough {k}" for k in range(6)]
    rows = [(i, "\n".join(lines[: 1 + i % 6])) for i in range(90)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in line_dedup(docs_of(rows), broadcast_bytes=0, shard_keys=2, probes=20).collect()}
    assert got == want_lines(rows)
    import pandas as pd

    frame = pd.DataFrame({"shard": 0, "h1": [5, 5, 7], "h2": [1, 2, 3], "n": [3, 4, 5], "last": [9, 8, 7]})
    r = L._build_shard(frame).iloc[0]
    count, last = L.LineShard(r["fold"], *(r[c] for c in L._ARRAYS[1:])).probe(np.array([5, 5, 7, 7]), np.array([1, 2, 3, 4]))
    assert r["fold"] > 0 and count.tolist() == [3, 4, 5, 0] and last[:3].tolist() == [9, 8, 7]


def test_spread_join(spark):
    from pyspark.sql import functions as F

    from loomcycle.llm.spread import spread_join

    rows = spark.createDataFrame([(1 if i < 700 else i, i) for i in range(1000)], "k long, id long")
    unique = spark.createDataFrame([(k, k * 2) for k in [1, *range(700, 990)]], "k long, v long")
    got = sorted(map(tuple, spread_join(rows, unique, "k", F.col("id"), 50).select("k", "id", "v").collect()))
    assert got == sorted((k, i, 2 * k) for k, i in [(1 if i < 700 else i, i) for i in range(1000)] if k < 990)
