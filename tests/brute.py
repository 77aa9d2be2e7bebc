"""Plain Python versions of the core operators, for small graphs."""

from collections import defaultdict


def cycles(edges, omega, max_length):
    """(root, times, path, keys) of simple temporal cycles, by depth-first search."""
    out = defaultdict(list)
    for src, dst, t, key in edges:
        if src != dst:
            out[src].append((dst, t, key))
    found = []

    def go(path, times, keys, cur):
        if cur == path[0]:
            found.append((path[0], tuple(times), tuple(path), tuple(keys)))
            return
        if cur in path or len(path) == max_length:
            return
        for dst, t, key in out[cur]:
            if times[-1] < t < times[0] + omega:
                go(path + [cur], times + [t], keys + [key], dst)

    for src, dst, t, key in edges:
        if src != dst:
            go([src], [t], [key], dst)
    return found


def walk_seeds(edges, omega):
    """(root, begin, end) -> vertices c with strict walks root (from begin) -> c -> closing edge's source, then root at end; root and source included."""
    e = [x[:3] for x in edges if x[0] != x[1]]

    def arrivals(src, first, until):
        """vertex -> earliest time a walk that leaves src by the edges `first` gets there before until, never back in src."""
        at = {}
        for s, d, t in sorted(first, key=lambda x: x[2]):
            at[d] = min(at.get(d, t), t)
        for s, d, t in sorted(e, key=lambda x: x[2]):
            if t < until and d != src and s in at and t > at[s]:
                at[d] = min(at.get(d, t), t)
        return at

    out = {}
    for root, begin in {(s, t) for s, _, t in e}:
        there = arrivals(root, [x for x in e if x[0] == root and x[2] == begin], begin + omega)
        for last, _, end in [x for x in e if x[1] == root and x[0] in there and there[x[0]] < x[2] < begin + omega]:
            found = out.setdefault((root, begin, end), set())
            found |= {root, last}
            for c, t, leave in [(c, t, x) for c, t in there.items() for x in e if x[0] == c and c != root and x[2] > t]:
                if arrivals(c, [leave], end).get(last, end) < end and leave[2] < end:
                    found.add(c)
    return out


def combined(seeds, omega):
    """seeds: root -> [(begin, end)]; greedy groups (root, begin, end, next_begin)."""
    out = []
    for root, intervals in seeds.items():
        group = None
        for b, e in sorted(set(intervals), key=lambda x: (x[0], -x[1])):
            if group and e < group[0] + omega:
                group[1] = max(group[1], e)
            else:
                if group:
                    out.append((root, *group, b))
                group = [b, e]
        out.append((root, *group, group[0] + omega))
    return out


def components(pairs):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            up[max(a, b)] = min(a, b)
    return {x: find(x) for x in up}
