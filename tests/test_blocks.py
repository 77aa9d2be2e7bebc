import os
import random

import numpy as np
import pyarrow as pa
import pytest

from loomcycle.operators import blocks, bundle_search as P, cycles as C, seeds as S
from loomcycle.session import ensure_checkpoint_dir
from tests import brute
from tests.test_core import frame


def random_rows(rng, n, vertices, span):
    return [(f"v{rng.randrange(vertices)}", f"v{rng.randrange(vertices)}", rng.randrange(span) - 20, i) for i in range(n)]


def answers(edges, omega, **how):
    reach = S.reverse_reachability(edges, omega, **how).collect()
    seeds = S.reachability_seeds(edges, omega, **how).collect()
    return sorted(map(tuple, reach)), sorted(map(tuple, S.return_walks(edges, omega, **how).collect())), sorted((r.root, r.begin, r.end, tuple(r.candidates)) for r in seeds)


def test_blocks_give_what_joins_give(spark):
    rows = random_rows(random.Random(3), 150, 9, 80)
    edges = frame(spark, rows)
    in_blocks, by_joins = answers(edges, 17), answers(edges, 17, block_edges=0)
    assert in_blocks == by_joins
    assert {x[:3]: set(x[3]) for x in in_blocks[2]} == brute.walk_seeds(rows, 17)
    empty = frame(spark, rows).where("false")
    assert answers(empty, 17) == ([], [], [])


@pytest.mark.parametrize(("cells", "dense", "sparse", "expanded"), [(1 << 22, 256, 2048, 1 << 22), (40, 2, 2048, 3), (1, 256, 3, 2)])
def test_tables_and_parts_of_any_size(monkeypatch, cells, dense, sparse, expanded):
    for name, value in (("_CELLS", cells), ("_DENSE_STARTS", dense), ("_SPARSE_STARTS", sparse), ("_EXPANDED", expanded)):
        monkeypatch.setattr(blocks, name, value)
    for number in range(5):
        rows = [r for r in random_rows(random.Random(number), 60, 7, 30) if r[0] != r[1]]
        src, dst = (pa.chunked_array([[r[k] for r in rows]]) for k in (0, 1))
        block = blocks._Block(src, dst, np.array([r[2] for r in rows]), np.ones(len(rows), bool), 12)
        got = {}
        for columns in blocks.seeds(block):
            got |= {tuple(x[:3]): set(x[3]) for x in zip(*[c.to_pylist() for c in columns])}
        assert got == brute.walk_seeds(rows, 12)


def test_tasks_of_a_block_share_its_starts(spark):
    edges = frame(spark, random_rows(random.Random(5), 120, 8, 60)).where("src <> dst")
    one, many = (blocks.by_block(edges, 15, blocks.walks, "root string, begin bigint, end bigint", n).collect() for n in (1, 5))
    assert len(many) == len(one) > 0 and sorted(many) == sorted(one)


def on_disk(spark):
    ensure_checkpoint_dir(spark)
    top = spark.sparkContext._jsc.sc().getCheckpointDir().get().removeprefix("file:")
    return sum(os.path.getsize(f"{d}/{f}") for d, _, names in os.walk(top) for f in names)


@pytest.mark.parametrize("run", [lambda e: C.temporal_cycles(e, 100), lambda e: S.reachability_seeds(e, 100, block_edges=0), lambda e: P.bundled_cycles(e, S.combined_seeds(S.reachability_seeds(e, 100), 100))])
def test_finished_rounds_leave_the_disk(spark, run):
    """Many open paths of up to 24 edges and one cycle: what is kept is the cycle, not the rounds."""
    rows = [(f"v{i}", f"v{i + 1}", i, i) for i in range(24)] + [("v24", "v0", 30, 24)]
    rows += [(f"v{i}", f"w{i}-{k}", i, 100 + 400 * i + k) for i in range(24) for k in range(400)]
    edges = frame(spark, rows)
    before = on_disk(spark)
    found = run(edges)
    assert found.count() == 1
    assert on_disk(spark) - before < 200_000


def test_return_walks_take_one_pass(monkeypatch):
    """No rounds: long paths cost no more than short ones."""
    import numpy as np
    import pyarrow as pa

    from loomcycle.operators import blocks

    rng, omega = np.random.default_rng(8), 30
    for bits in (1 << 28, 64):
        src, t = rng.integers(0, 9, 90), rng.integers(0, 60, 90)
        dst = (src + rng.integers(1, 9, 90)) % 9
        column = lambda x: pa.chunked_array([pa.array(x)])
        make = lambda: blocks._Block(column(src), column(dst), t, t < omega, omega)
        want = {x for c in blocks.seeds(make()) for x in zip(*[y.to_pylist() for y in c[:3]])}
        with monkeypatch.context() as patch:
            patch.setattr(blocks, "_BITS", bits, raising=False)
            patch.delattr(blocks._Block, "forward")
            got = [x for c in blocks.walks(make()) for x in zip(*[y.to_pylist() for y in c])]
        assert len(got) == len(set(got)) and set(got) == want and want
