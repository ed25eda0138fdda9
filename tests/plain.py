"""Re-derivations in plain Python, row by row, for the randomized tests."""

from __future__ import annotations

import math


def cap(n, total, beta):
    p = n / total
    return (1 + min(beta, -math.log(p))) * p


def beta_buckets(hist, beta):
    """[(names, freq, cap)] of a {value: count} histogram."""
    total = sum(hist.values())
    out, names, share, bound = [], [], 0.0, math.inf
    for sa, n in sorted(hist.items(), key=lambda x: (x[1], x[0])):
        c, p = cap(n, total, beta), n / total
        if share + p > min(bound, c):
            out.append((sorted(names), bound))
            names, share, bound = [], 0.0, math.inf
        names.append(sa)
        share += p
        bound = min(bound, c)
    out.append((sorted(names), bound))
    return sorted(((n, sum(hist[s] for s in n), b) for n, b in out), key=lambda x: (x[0], x[1]))


def overlap_buckets(hist, parent, height, beta):
    """Buckets as ({value: n}, cap), one unit row at a time where it is cut."""
    total = sum(hist.values())
    items = [([(sa, n)], cap(n, total, beta)) for sa, n in hist.items()]
    closed = []

    def ancestor(sa, steps):
        for _ in range(steps):
            sa = parent[sa]
        return sa

    for level in range(1, height + 2):
        nodes = {}
        for content, bound in items:
            nodes.setdefault(ancestor(content[0][0], level), []).append((content, bound))
        items = []
        for children in nodes.values():
            children.sort(key=lambda c: (c[1], [s for s, _ in c[0]]))
            made, units, share, bound = [], [], 0.0, math.inf
            for content, own in children:
                rows = [sa for sa, n in content for _ in range(n)]
                bound = min(bound, own)
                share += len(rows) / total
                over = share > bound
                if over:
                    room = min(max(math.floor(bound * total) - len(units), 0), len(rows))
                    if room and cap(room, total, beta) < bound:
                        room = 0
                    made.append((units + rows[:room], bound))
                    rows, units, share, bound = rows[room:], [], 0.0, math.inf
                    if not rows:
                        continue
                    share = len(rows) / total
                    if room == 0 or len(set(rows)) > 1:
                        bound = own
                units = units + rows
                bound = min(bound, cap(len(rows), total, beta))
            made.append((units, bound))
            for rows, b in made:
                if not rows:
                    continue
                content = sorted((s, rows.count(s)) for s in set(rows))
                full = len(rows) == math.floor(b * total)
                (closed if full else items).append((content, b))
    return closed + items


def classes(sizes, good):
    """Leaves {(level, path): sizes} of the halving, by recursion."""
    out, open_ = {}, [(0, 0, tuple(sizes))]
    while open_:
        level, path, s = open_.pop()
        left = tuple(x // 2 for x in s)
        right = tuple(x - x // 2 for x in s)
        if sum(left) and sum(right) and good(left) and good(right):
            open_ += [(level + 1, path, left), (level + 1, path + 2**level, right)]
        else:
            out[level, path] = s
    return out


def likeness(caps):
    def good(s):
        return all(
            math.floor(x / sum(s) * 100 + 0.5) <= math.floor(c * 100 + 0.5)
            for x, c in zip(s, caps)
        )

    return good


def closeness(sizes, caps, t):
    share = [x / sum(sizes) for x in sizes]

    def good(s):
        run = total = 0.0
        for x, p in zip(s, share):
            run += x / sum(s) - p
            total += abs(run)
        return sum(caps) + total <= t

    return good


def mondrian(rows, k):
    """{pid: group} of [(pid, tie, values)] with standardized values."""
    out, open_ = {}, [(1, rows)]
    while open_:
        group, part = open_.pop()
        if len(part) <= 2 * k:
            out.update({pid: group for pid, _, _ in part})
            continue
        dims = range(len(part[0][2]))
        width = [max(r[2][i] for r in part) - min(r[2][i] for r in part) for i in dims]
        d = width.index(max(width))
        part = sorted(part, key=lambda r: (r[2][d], r[1]))
        half = len(part) // 2
        open_ += [(2 * group, part[:half]), (2 * group + 1, part[half:])]
    return out
