"""Bin completion branch-and-bound on a histogram of lengths.

The input is the number of items of each length, at most one entry per length up
to the capacity, so its size does not depend on the number of items. A *pattern*
is a multiset of lengths that share a bin, used a number of times at once.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field


#: Items of a filling up to which dominance is worked out.
FEW = 4
#: Steps in making fillings that a search may spend for each that it may try.
STEPS = 100


@dataclass
class Packing:
    """Patterns (lengths, times), the bins they take, and a proven lower bound."""

    patterns: list[tuple[tuple[int, ...], int]] = field(default_factory=list)
    bins: int = 0
    bound: int = 0


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins that any packing needs (the bound of Martello and Toth).

    For each threshold a: items over capacity - a stand alone, items over half the
    capacity are never together, and items down to a fill what these leave.
    """
    total = sum(size * n for size, n in counts.items())
    best = -(-total // capacity)
    for a in range(capacity // 2 + 1):
        alone = sum(n for size, n in counts.items() if size > capacity - a)
        large = {s: n for s, n in counts.items() if capacity // 2 < s <= capacity - a}
        small = sum(s * n for s, n in counts.items() if a <= s <= capacity // 2)
        room = sum((capacity - s) * n for s, n in large.items())
        best = max(best, alone + sum(large.values()) + max(0, -(-(small - room) // capacity)))
    return best


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing: each item to the fullest bin that takes it."""
    open_bins: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # by room left
    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            room = min((r for r in open_bins if r >= size), default=None)
            if room is None:
                fits = capacity // size
                full, rest = divmod(left, fits)
                for held, times in ((fits, full), (rest, 1)):
                    if held and times:
                        open_bins.setdefault(capacity - held * size, []).append(((size,) * held, times))
                break
            pattern, times = open_bins[room].pop()
            used = min(times, left)
            if times > used:
                open_bins[room].append((pattern, times - used))
            if not open_bins[room]:
                del open_bins[room]
            open_bins.setdefault(room - size, []).append(((*pattern, size), used))
            left -= used
    return [p for group in open_bins.values() for p in group]


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """The items of b can be shared out among the items of a without excess.

    Told for up to ``FEW`` items; fillings of more are never said to be dominated
    (keeping a dominated one loses nothing but time).
    """
    if len(a) > FEW or len(b) > FEW:
        return False

    def place(i: int, rooms: list[int]) -> bool:
        if i == len(b):
            return True
        tried = set()
        for j, room in enumerate(rooms):
            if room >= b[i] and room not in tried:
                tried.add(room)
                if place(i + 1, [*rooms[:j], room - b[i], *rooms[j + 1 :]]):
                    return True
        return False

    return a != b and sum(a) >= sum(b) and place(0, list(a))


def fillings(
    room: int, sizes: list[int], counts: dict[int, int], width: int = 12
) -> list[tuple[int, ...]]:
    """Some good fillings of ``room``, fullest first; ``sizes`` ascending, all in stock.

    One item that fills the room dominates every other filling. Where two items
    fill it, such pairs come first, with the largest single item after them: what
    a pair leaves unused is nothing. Otherwise, from each first item, the largest
    that still fit are added in turn, and with three items the second is varied
    as well.
    """
    if counts.get(room):
        return [(room,)]
    pairs = []
    for small in range(1, room // 2 + 1):
        large = room - small
        if counts.get(small) and counts.get(large) and (small != large or counts[small] > 1):
            pairs.append((large, small))
            if len(pairs) == width:
                break
    if pairs:
        return [*pairs, (sizes[bisect_right(sizes, room) - 1],)]
    fitting = sizes[: bisect_right(sizes, room)]
    if not fitting:
        return [()]
    found: set[tuple[int, ...]] = set()

    def grow(first: int) -> None:
        """Add the largest that fit, none larger than the first, as often as they fit."""
        chosen, left, top = [first], room - first, first
        while left and top:
            i = bisect_right(sizes, min(left, top)) - 1
            if i < 0:
                break
            top = sizes[i]
            times = min(counts[top] - (top == first), left // top)
            chosen += [top] * times
            left -= top * times
            top -= 1
        found.add(tuple(chosen))

    for first in reversed(fitting):
        grow(first)
    if all(sum(f) < room for f in found):
        for first in reversed(fitting):
            rest = room - first
            for second in reversed(sizes[: bisect_right(sizes, min(first, rest))]):
                if second == first and counts[first] < 2:
                    continue
                third = rest - second
                if third and third <= second and counts.get(third, 0) > [first, second].count(third):
                    found.add((first, second, third))
            if len(found) > 2000 or any(sum(f) == room for f in found):
                break
    ranked = sorted(found, key=lambda f: (-sum(f), tuple(-x for x in f)))[: 4 * width]
    kept: list[tuple[int, ...]] = []
    for filling in ranked:
        if not any(_dominates(k, filling) for k in kept):
            kept.append(filling)
        if len(kept) == width:
            break
    return kept


def all_fillings(room: int, counts: dict[int, int], slack: int) -> Iterator[tuple[int, ...] | None]:
    """Every filling of ``room`` that leaves ``slack`` at most and to which no item in stock can be added.

    Any filling to which one can be added is dominated. A None for each step that
    yields no filling, so that the caller can bound the work.
    """
    sizes = sorted((s for s, n in counts.items() if n and s <= room), reverse=True)
    upto = [0] * (len(sizes) + 1)  # what the sizes from here on have together
    for i in range(len(sizes) - 1, -1, -1):
        upto[i] = upto[i + 1] + sizes[i] * counts[sizes[i]]
    # (next size, room left, chosen, the smallest size of which some stayed in stock)
    todo = [(0, room, (), room + 1)]
    while todo:
        i, left, chosen, over = todo.pop()
        if left - upto[i] > slack or over <= left - upto[i]:
            yield None
            continue
        if i == len(sizes) or not left:
            # a size not looked at any more is larger than the room left, which is 0
            yield chosen if left < over else None
            continue
        most = min(counts[sizes[i]], left // sizes[i])
        for n in range(most + 1):  # the largest number is taken from the stack first
            least = sizes[i] if n < counts[sizes[i]] else over
            todo.append((i + 1, left - n * sizes[i], chosen + (sizes[i],) * n, min(over, least)))
        yield None


def pack(counts: dict[int, int], capacity: int, max_nodes: int = 3000) -> Packing:
    """Few bins for the items; the lower bound tells how few are possible.

    Best-fit decreasing is the first incumbent. The search goes around the largest
    item left: it takes a filling a number of times and goes on; a branch is left
    when its waste exceeds what a better packing than the incumbent could waste.
    The first search tries the fillings of ``fillings`` only, as often as the stock
    allows. If it does not reach the bound, a second one goes on after these with
    all other fillings and with each smaller number of times. A search ends after
    ``max_nodes`` fillings (or ``STEPS`` steps for each in making them) with the
    incumbent. Only if the second ends before that is the incumbent proven to be the
    best; then the bound is raised to it.
    """
    counts = {int(s): int(n) for s, n in counts.items() if n}
    if any(not 0 < s <= capacity for s in counts):
        raise ValueError("lengths must be from 1 to the capacity")
    found = Packing(best_fit(counts, capacity), 0, lower_bound(counts, capacity))
    found.bins = sum(times for _, times in found.patterns)
    for whole in (False, True):
        if found.bins > found.bound and _search(counts, capacity, max_nodes, found, whole) and whole:
            found.bound = found.bins
    return found


def _search(counts: dict[int, int], capacity: int, max_nodes: int, found: Packing, whole: bool) -> bool:
    """Improve ``found``; whether no branch was left untried (of those that are looked at)."""
    total = sum(s * n for s, n in counts.items())
    stock, sizes = dict(counts), sorted(counts)
    path: list[tuple[tuple[int, ...], int]] = []
    waits: list[Iterator[tuple[tuple[int, ...], int] | None]] = []
    waste = nodes = bins = steps = 0

    def take(pattern: tuple[int, ...], times: int, sign: int) -> None:
        nonlocal waste, bins
        for size in pattern:
            stock[size] -= sign * times
            i = bisect_right(sizes, size)
            there = bool(i) and sizes[i - 1] == size
            if stock[size] and not there:
                sizes.insert(i, size)
            elif not stock[size] and there:
                del sizes[i - 1]
        if sign > 0:
            path.append((pattern, times))
        else:
            path.pop()
        waste += sign * (capacity - sum(pattern)) * times
        bins += sign * times

    def spare() -> int:
        """What a better packing than the incumbent may still waste."""
        return (found.bins - 1) * capacity - total - waste

    def patterns() -> Iterator[tuple[int, ...] | None]:
        largest = sizes[-1]
        room, rest = capacity - largest, {s: stock[s] - (s == largest) for s in sizes}
        first = fillings(room, [s for s in sizes if rest[s]], rest)
        yield from ((largest, *f) for f in first)
        if whole and first != [(room,)]:
            done = {tuple(sorted(f, reverse=True)) for f in first}
            for f in all_fillings(room, rest, spare()):
                if f not in done:
                    yield f if f is None else (largest, *f)

    def choices() -> Iterator[tuple[tuple[int, ...], int] | None]:
        # fillings that the last steps have taken just as often as they shall be
        largest, taken = sizes[-1], set()
        for pattern, _ in reversed(path if whole else []):
            if pattern[0] != largest:
                break
            taken.add(tuple(sorted(pattern)))
        # one item that fills the room (or no room) leaves no other choice
        filled = largest == capacity or bool(
            stock.get(capacity - largest, 0) > (2 * largest == capacity)
        )
        for pattern in patterns():
            if pattern is None:
                yield None
                continue
            if tuple(sorted(pattern)) in taken:
                continue
            lost = capacity - sum(pattern)
            times = min(stock[s] // pattern.count(s) for s in set(pattern))
            if lost:
                # fewer times may still pass, where the last bins hold the waste
                times = min(times, max(0, spare() // lost))
            fewest = 1 if whole and not filled else times
            for n in range(times, fewest - 1, -1):
                if n * lost <= spare():
                    yield pattern, n
            if not times:
                yield pattern, 0

    descend = True
    while found.bins > found.bound:
        if descend and not sizes:
            found.patterns, found.bins = list(path), bins
            descend = False
            continue
        if descend:
            waits.append(choices())
        if not waits:
            return True
        if len(path) == len(waits):  # the last choice at this depth is given back
            take(*path[-1], -1)
        descend = False
        choice = next(waits[-1], ())
        if choice == ():
            waits.pop()
        elif choice is None:
            steps += 1
        else:
            nodes += 1
            if choice[1]:
                take(*choice, 1)
                descend = True
        if nodes >= max_nodes or steps >= STEPS * max_nodes:
            # what was just taken may be a whole packing
            if descend and not sizes:
                found.patterns, found.bins = list(path), bins
            return False
    return True
