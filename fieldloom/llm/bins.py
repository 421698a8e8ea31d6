"""Bin completion on a histogram of lengths.

The items are given as how many there are of each length, so the work depends on the
number of different lengths (at most the capacity), never on the number of items.  A
filling, once chosen, is used as often as the counts allow.
"""

from __future__ import annotations

from collections import deque

import numpy as np

#: Fillings tried around one largest item, best first.
BRANCHES = 3
#: Steps of the search before the best packing so far is taken, and open branches it returns to: the latest.
STEPS, OPEN = 8_000, 64
#: Items tried first at each level when no one or two items fill a space exactly.
WIDTH = 3
DEPTH = 4

Filling = tuple[tuple[int, int], ...]  # (length, how many), longest first


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[int, Filling]]:
    """Best-fit decreasing: around each largest item, always the longest item that still fits."""
    counts = counts.copy()
    out = []
    while counts.any():
        largest = int(np.flatnonzero(counts)[-1])
        chosen = {largest: 1}
        left = capacity - largest
        while left:
            fits = np.flatnonzero(counts[: left + 1])
            fits = [int(f) for f in fits[::-1][:8] if counts[f] > chosen.get(int(f), 0)]
            if not fits:
                fits = [int(f) for f in np.flatnonzero(counts[: left + 1])[::-1] if counts[f] > chosen.get(int(f), 0)]
            if not fits:
                break
            chosen[fits[0]] = chosen.get(fits[0], 0) + 1
            left -= fits[0]
        out.append(_use(counts, tuple(sorted(chosen.items(), reverse=True))))
    return out


def _use(counts: np.ndarray, filling: Filling) -> tuple[int, Filling]:
    """Take a filling from the counts as often as they allow."""
    times = min(int(counts[length]) // n for length, n in filling)
    for length, n in filling:
        counts[length] -= times * n
    return times, filling


def fillings(counts: np.ndarray, largest: int, capacity: int, whole: bool = True) -> list[Filling]:
    """Undominated fillings of a bin around its largest item, least waste first.

    A filling is dominated by one that fills the same space with fewer and so longer items:
    one item that fits exactly leaves nothing else to try, and pairs that do leave other pairs.
    Where no few items fill the space exactly, fillings of any number of items come from :func:`tightest`.
    Without ``whole``, neither other pairs nor these are looked for.
    """
    free = counts.copy()
    free[largest] -= 1
    found: list[tuple[int, int, tuple[int, ...]]] = []  # (waste, items, the items), the best few

    def note(waste: int, items: tuple[int, ...]) -> None:
        if not whole or (waste, len(items), items) not in found:
            found.append((waste, len(items), items))
            found.sort(key=(lambda f: (f[0], f[1], [-x for x in f[2]])) if whole else None)
            del found[BRANCHES:]

    def search(space: int, most: int, chosen: tuple[int, ...], depth: int) -> bool:
        """Whether the space could be filled exactly."""
        if space == 0:
            note(0, chosen)
            return True
        top = min(space, most)
        if space == top and free[space] > 0:
            note(0, (*chosen, space))
            return True
        first = np.arange(top, (space + 1) // 2 - 1, -1)  # pairs that fill the space, longest first
        first = first[(first > 0) & (first < space)]
        pairs = (free[first] > 0) & (free[space - first] > (2 * first == space))
        if pairs.any():
            for item in first[pairs][: BRANCHES if whole else 1].tolist():
                note(0, (*chosen, item, space - item))
            return True
        choice = np.flatnonzero(free[: top + 1])[::-1][:WIDTH].tolist()
        if not choice:
            note(space, chosen)
        if choice and depth == 0:
            note(space - choice[0], (*chosen, choice[0]))
            return False
        for item in choice:
            free[item] -= 1
            exact = search(space - item, item, (*chosen, item), depth - 1)
            free[item] += 1
            if exact:
                return True
        return False

    if not search(capacity - largest, largest, (), DEPTH) and whole:
        for items in tightest(free, capacity - largest):
            note(capacity - largest - sum(items), items)
    out = []
    for _, _, items in found:
        many: dict[int, int] = {largest: 1}
        for item in items:
            many[item] = many.get(item, 0) + 1
        out.append(tuple(sorted(many.items(), reverse=True)))
    return out


def tightest(free: np.ndarray, space: int) -> list[tuple[int, ...]]:
    """Items that leave the least of a space, however many it takes: subset sums within the counts.

    Longest items first; up to ``BRANCHES`` ways, each with a shorter longest item than the one before.
    """
    lengths = np.flatnonzero(free[: space + 1]).tolist()
    within = (1 << space + 1) - 1
    sums = [1]  # bit s of sums[k]: the first k lengths can make s
    for length in lengths:
        made, left, step = sums[-1], min(int(free[length]), space // length), 1
        while left:  # 1, 2, 4, ... items and the rest, so that every number up to the count is made
            step = min(step, left)
            made |= made << step * length & within
            left, step = left - step, 2 * step
        sums.append(made)
    goal = sums[-1].bit_length() - 1
    out: list[tuple[int, ...]] = []
    top = len(lengths)
    while goal and top and len(out) < BRANCHES and sums[top] >> goal & 1:
        items: list[int] = []
        rest = goal
        for k in range(top, 0, -1):
            length, left = lengths[k - 1], int(free[lengths[k - 1]])
            many = min(left, rest // length)
            while many and not sums[k - 1] >> (rest - many * length) & 1:
                many -= 1
            items += [length] * many
            rest -= many * length
            if not rest:
                break
        out.append(tuple(items))
        top = lengths.index(items[0])
    return out


def pack(counts: np.ndarray, capacity: int) -> list[tuple[int, Filling]]:
    """Pack ``counts[length]`` items of every length into few bins: ``(times, filling)`` pairs.

    Branch and bound: fillings around the largest item are tried in order of waste; a branch is
    left when its waste so far can no longer beat the best packing known, which starts as
    best-fit decreasing.  The search ends when the lower bound is met or ``STEPS`` steps after
    the first packing or cut branch, with the best packing found; every item is packed in any case.
    """
    counts = np.asarray(counts, np.int64)
    lengths = np.arange(len(counts))
    total = int((counts * lengths).sum())
    if not total:
        return []
    least = max(-(-total // capacity), int(counts[capacity // 2 + 1 :].sum()))
    best = best_fit(counts, capacity)
    for whole in (False, True):  # few items first: with fewer branches, the steps reach further up
        if sum(t for t, _ in best) > least:
            best = _searched(counts, capacity, least, best, whole)
    return best


def _searched(counts: np.ndarray, capacity: int, least: int, best: list, whole: bool) -> list:
    total = int((counts * np.arange(len(counts))).sum())
    bins = sum(t for t, _ in best)
    steps, turned = 0, not whole
    stack: deque[tuple] = deque(maxlen=OPEN)
    state, used, waste = counts.copy(), None, 0  # used: (times, filling) and what was used before
    while bins > least and steps < STEPS:
        steps += turned
        options: list[Filling] = []
        if waste < bins * capacity - total:  # else it cannot use fewer bins than the best
            if state.any():
                options = fillings(state, int(np.flatnonzero(state)[-1]), capacity, whole)
            else:
                now = _listed(used)
                if sum(t for t, _ in now) < bins:
                    best, bins = now, sum(t for t, _ in now)
        if not options:
            turned = True
            if not stack:
                break
            state, used, waste, options = stack.pop()
        chosen, later = options[0], options[1:]
        if later:
            stack.append((state, used, waste, later))
        state = state.copy()
        times, chosen = _use(state, chosen)
        used = ((times, chosen), used)
        waste += times * (capacity - sum(length * n for length, n in chosen))
    return best


def _listed(used: tuple | None) -> list:
    out = []
    while used is not None:
        out.append(used[0])
        used = used[1]
    return out
