"""Higher-order functions on sorted arrays of times and on bundles."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def before(ts: Column, limit: Column, include: bool = False) -> Column:
    return F.filter(ts, lambda x: (x <= limit) if include else (x < limit))


def after(ts: Column, limit: Column, include: bool = False) -> Column:
    return F.filter(ts, lambda x: (x >= limit) if include else (x > limit))


def split_index(ts: Column, limit: Column, direction: str = "before", include: bool = False) -> Column:
    """How many elements lie before the cut."""
    if direction not in ("before", "after"):
        raise ValueError(direction)
    left = before(ts, limit, include if direction == "before" else not include)
    return F.size(left)


def sorted_set(ts: Column) -> Column:
    return F.array_sort(F.array_distinct(ts))


def consecutive_pairs(xs: Column) -> Column:
    return F.arrays_zip(F.slice(xs, 1, F.greatest(F.size(xs) - 1, F.lit(0))).alias("a"), F.slice(xs, 2, F.greatest(F.size(xs) - 1, F.lit(0))).alias("b"))


def cardinality(bundle: Column) -> Column:
    """Number of strictly ascending choices of one time per hop: a fold of running counts."""
    one = F.transform(bundle[0], lambda t: F.struct(t.alias("t"), F.lit(1).cast("long").alias("n")))
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x["n"])
    step = lambda acc, ts: F.transform(ts, lambda t: F.struct(t.alias("t"), total(F.filter(acc, lambda x: x["t"] < t)).alias("n")))
    return total(F.aggregate(F.slice(bundle, 2, F.size(bundle)), one, step))


def trim(bundle: Column) -> Column:
    """Drops times that lie on no strict choice: forwards against the last minimum, then backwards against the next maximum."""
    keep = lambda ts, acc, good: F.concat(acc, F.array(F.filter(ts, lambda t: good(t, F.element_at(acc, -1)))))
    rest = lambda b: F.slice(b, 2, F.size(b))
    forward = F.aggregate(rest(bundle), F.array(bundle[0]), lambda acc, ts: keep(ts, acc, lambda t, prev: t > F.array_min(prev)))
    turned = F.reverse(forward)
    return F.reverse(F.aggregate(rest(turned), F.array(turned[0]), lambda acc, ts: keep(ts, acc, lambda t, nxt: t < F.array_max(nxt))))


def path_text(path: Column) -> Column:
    return F.array_join(path.cast("array<string>"), ">")


def bundle_text(bundle: Column) -> Column:
    return F.array_join(F.transform(bundle, lambda ts: F.array_join(ts.cast("array<string>"), ",")), ";")
