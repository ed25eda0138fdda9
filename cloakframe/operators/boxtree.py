"""Nearest centre in few dimensions, by a tree of boxes over the centres.

A node is cut into ``FAN`` parts of equal number along its longest side, down to
leaves of at most ``LEAF`` centres; every node knows the box of its centres. A row
first goes down to the leaf whose box is closest, which gives it a bound; then all
boxes that are not farther than the bound are followed from the root, for a block of
rows at once. So a row costs about the depth of the tree, not the root of the number
of centres. The distance to a box is made by the same operations in the same order as
the distance to a centre, and rounding keeps the order of numbers: no centre in a box
is nearer than the box, so results are exact and need no slack. Ties go to the smaller
number.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Most coordinates that a tree is made for; in more, boxes exclude little.
MAX_DIMENSIONS = 6
#: Parts of a node, and most centres of a leaf.
FAN, LEAF = 8, 16
#: Rows of a block, and distances that are held at once.
BLOCK, TILE = 4096, 1 << 20
#: A number that no centre has.
NONE = np.iinfo(np.int64).max


def _add(out: np.ndarray | None, gap: np.ndarray) -> np.ndarray:
    """``out`` plus the squares of ``gap`` (which is used up)."""
    gap *= gap
    if out is None:
        return gap
    out += gap
    return out


def build_tree(
    ids: np.ndarray,
    numeric: Sequence[np.ndarray],
    other: Sequence[np.ndarray] = (),
    limit: tuple[np.ndarray, np.ndarray] | None = None,
) -> dict:
    """The tree over centres; those with a coordinate that is not finite are no one's
    nearest. ``limit`` gives (squared distance, tie) that a row must stay below for each
    centre; without it only the smallest number of equal centres is kept."""
    use = np.flatnonzero(np.logical_and.reduce([np.isfinite(c) for c in numeric]))
    if limit is None:
        keys = [*numeric, *other]
        use = use[np.lexsort((ids[use], *[k[use] for k in keys]))]
        fresh = np.ones(len(use), bool)
        fresh[1:] = np.logical_or.reduce([k[use[1:]] != k[use[:-1]] for k in keys])
        use = use[fresh]
    use = use[np.argsort(ids[use], kind="stable")]
    n, depth = len(use), 0
    while FAN**depth * LEAF < n:
        depth += 1
    spots = np.array([c[use] for c in numeric], np.float64).reshape(len(numeric), n)
    order, boxes = np.arange(n), []

    def bounds(level: int) -> np.ndarray:
        return np.arange(FAN**level + 1) * n // FAN**level

    for level in range(depth):
        ends = bounds(level)
        mine = spots[:, order]
        node = np.repeat(np.arange(FAN**level), np.diff(ends))
        side = np.maximum.reduceat(mine, ends[:-1], axis=1) - np.minimum.reduceat(mine, ends[:-1], axis=1)
        order = order[np.lexsort((mine[side.argmax(axis=0)[node], np.arange(n)], node))]
    ends = bounds(depth)
    leaf = np.repeat(np.arange(FAN**depth), np.diff(ends))
    order = order[np.lexsort((order, leaf))]  # by number, as they are sorted by it
    width = int(np.diff(ends).max()) if n else 0
    places = leaf * width + np.arange(n) - ends[leaf]

    def padded(values: np.ndarray, fill) -> np.ndarray:
        out = np.full(FAN**depth * width, fill, values.dtype)
        out[places] = values
        return out.reshape(FAN**depth, width)

    mine, numbers = spots[:, order], ids[use][order].astype(np.int64)
    for level in range(1, depth + 1):
        starts = bounds(level)[:-1]
        boxes.append(
            {
                "low": [np.minimum.reduceat(c, starts).reshape(-1, FAN) for c in mine],
                "high": [np.maximum.reduceat(c, starts).reshape(-1, FAN) for c in mine],
                "first": np.minimum.reduceat(numbers, starts).reshape(-1, FAN),
            }
        )
    tree = {
        "count": n,
        "depth": depth,
        "ids": padded(numbers, NONE),
        "numeric": [padded(c, np.inf) for c in mine],
        "other": [padded(c[use][order], 0) for c in other],
        "boxes": boxes,
        "at": use[order],
        "places": places,
        "limit": None,
    }
    if limit is not None:
        set_limit(tree, *limit)
    return tree


def set_limit(tree: dict, most: np.ndarray, last: np.ndarray, only: np.ndarray | None = None) -> None:
    """Put limits (arrays over the centres that the tree was built of) in their place, or
    only those of the centres at ``only``."""
    shape, width = tree["ids"].shape, tree["ids"].shape[1]
    if not tree["count"]:
        tree["limit"] = np.zeros(shape), np.zeros(shape, np.int64)
        return
    if tree["limit"] is None:
        tree["limit"] = np.full(shape, -np.inf), np.zeros(shape, np.int64)
        tree["spot"] = np.full(len(most), -1)
        tree["spot"][tree["at"]] = tree["places"]
        for box in tree["boxes"]:
            box["most"] = np.full(box["first"].shape, -np.inf)
    only = np.arange(len(most)) if only is None else only
    only = only[tree["spot"][only] >= 0]
    spots = tree["spot"][only]
    far, tie = tree["limit"]
    far.reshape(-1)[spots], tie.reshape(-1)[spots] = most[only], last[only]
    changed = np.unique(spots // width)
    top = far[changed].max(axis=1)
    for box in reversed(tree["boxes"]):
        box["most"].reshape(-1)[changed] = top
        changed = np.unique(changed // FAN)
        top = box["most"][changed].max(axis=1)


def search_tree(
    tree: dict,
    numeric: Sequence[np.ndarray],
    other: Sequence[np.ndarray] = (),
    weights: Sequence[float] = (),
    tie: np.ndarray | None = None,
    below: np.ndarray | None = None,
    after: tuple[np.ndarray, np.ndarray] | None = None,
) -> tuple[np.ndarray, np.ndarray, int]:
    """(number, squared distance) of each row's nearest centre, and the distances to
    centres and boxes that were computed. Rows without one have an infinite distance; so
    have those whose nearest lies beyond ``below``. With ``after`` (squared distance, number)
    it is the nearest of those that come later than this in a row's order."""
    count, work = len(numeric[0]), 0
    ids, dist = np.full(count, NONE), np.full(count, np.inf)
    if tree["count"]:
        usable = np.flatnonzero(np.logical_and.reduce([np.isfinite(c) for c in numeric]))
        blocks = [usable[lo : lo + BLOCK] for lo in range(0, len(usable), BLOCK)][::-1]
        while blocks:
            at = blocks.pop()
            found = _search_block(
                tree, [c[at] for c in numeric], [c[at] for c in other], weights,
                None if tree["limit"] is None else tie[at], None if below is None else below[at],
                None if after is None else [a[at] for a in after],
            )
            if found is None:  # too many boxes at once
                blocks += [at[len(at) // 2 :], at[: len(at) // 2]]
            else:
                ids[at], dist[at] = found[:2]
                work += found[2]
    return np.where(np.isfinite(dist), ids, 0), dist, work


def _search_block(tree, numeric, other, weights, tie, below, after):
    """:func:`search_tree` for some rows; None if they have too many boxes to follow."""
    limited, width = tree["limit"] is not None, tree["ids"].shape[1]
    rows, work = len(numeric[0]), 0
    each, parts = np.arange(rows), np.arange(FAN)

    def to_boxes(box: dict, row: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Distances of rows to the parts of their nodes; infinite where no limit allows it."""
        nonlocal work
        out = None
        for c, low, high in zip(numeric, box["low"], box["high"]):
            x = c[row][:, None]
            gap = np.maximum(low[node] - x, x - high[node])
            out = _add(out, np.maximum(gap, 0, out=gap))
        if limited:
            out[out > box["most"][node]] = np.inf
        work += out.size
        return out

    def to_leaves(row: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, distance) of the nearest centre in a leaf."""
        nonlocal work
        number, near = np.full(len(row), NONE), np.full(len(row), np.inf)
        step = max(1, TILE // width)
        for lo in range(0, len(row), step):
            some, its = row[lo : lo + step], leaf[lo : lo + step]
            far = None
            for mine, theirs in zip(numeric, tree["numeric"]):
                far = _add(far, mine[some][:, None] - theirs[its])
            for mine, theirs, weight in zip(other, tree["other"], weights):
                far += weight * (mine[some][:, None] != theirs[its])
            work += far.size
            if limited:
                most, last = (x[its] for x in tree["limit"])
                far[~((far < most) | ((far == most) & (tie[some][:, None] < last)))] = np.inf
            if after is not None:
                passed, number_of = (a[some][:, None] for a in after)
                far[(far < passed) | ((far == passed) & (tree["ids"][its] <= number_of))] = np.inf
            low = far.argmin(axis=1)
            at = np.arange(len(some))
            near[lo : lo + step] = far[at, low]
            number[lo : lo + step] = tree["ids"][its, low]
        number[~np.isfinite(near)] = NONE
        return number, near

    if after is not None and tree["boxes"]:  # the closest leaf mostly holds what is passed
        ids, dist, node = np.full(rows, NONE), np.full(rows, np.inf), np.full(rows, -1)
    else:
        node = np.zeros(rows, np.int64)
        for box in tree["boxes"]:
            node = node * FAN + to_boxes(box, each, node).argmin(axis=1)
        ids, dist = to_leaves(each, node)
        if not tree["boxes"]:
            return ids, dist, work
    own, bound = node, dist.copy() if below is None else np.minimum(dist, below)
    row, node = each, np.zeros(rows, np.int64)
    for box in tree["boxes"]:
        if len(row) * FAN > 4 * TILE and rows > 1:
            return None
        far = to_boxes(box, row, node)
        if limited:
            # The centre of the highest limit takes a row that no centre of the box is as far
            # from: none farther is needed. Rows that found one have a bound already.
            open_ = np.flatnonzero(np.isinf(dist[row]))
            if len(open_):
                reach = None
                for c, low, high in zip(numeric, box["low"], box["high"]):
                    x = c[row[open_]][:, None]
                    reach = _add(reach, np.maximum(high[node[open_]] - x, x - low[node[open_]]))
                for weight in weights:
                    reach += weight
                reach[reach >= box["most"][node[open_]]] = np.inf
                if after is not None:
                    reach[far[open_] <= after[0][row[open_]][:, None]] = np.inf
                np.minimum.at(bound, row[open_], reach.min(axis=1))
        limit = bound[row][:, None]
        keep = (far < limit) | ((far == limit) & (box["first"][node] < ids[row][:, None]))
        keep &= far < np.inf
        at, part = np.nonzero(keep)
        row, node = row[at], node[at] * FAN + part
    other_leaf = node != own[row]
    row, node = row[other_leaf], node[other_leaf]
    if len(row):
        number, near = to_leaves(row, node)
        starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
        who = row[starts]
        least = np.minimum.reduceat(near, starts)
        number[near > np.repeat(least, np.diff(np.r_[starts, len(row)]))] = NONE
        number = np.minimum.reduceat(number, starts)
        better = (least < dist[who]) | ((least == dist[who]) & (number < ids[who]))
        ids[who[better]], dist[who[better]] = number[better], least[better]
    return ids, dist, work
