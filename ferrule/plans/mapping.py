"""Partition planning over the supernodal tree: costs, subtree cut, and balancers."""

from __future__ import annotations

import heapq
from array import array

import numpy as np

from ferrule.functions.basic import panel_flops


def subtree_costs(sparent: np.ndarray, cost: np.ndarray) -> np.ndarray:
    total = array("d", cost.astype(float).tobytes())
    for s, p in enumerate(sparent):
        if p >= 0:
            total[p] += total[s]
    return np.array(total)


#: Operations that a task should have at least: below it, starting a task costs more than it saves.
GRAIN = 2e8
#: Rows of the largest dense front of a subtree (8 bytes squared); a taller supernode belongs to the top, whose cells are bounded.
MAX_FRONT = 4096
#: Entries of panels that a task should have at most, and supernodes.
PANELS = 16_000_000
SUPERNODES = 32_768
#: A factor of so few entries may be one task's: where the tree is a long chain, as under orderings by bandwidth, tasks can only wait for each other.
WHOLE = 64_000_000
#: What a level of the top and a supernode take besides their operations, in operations.
LEVEL, STEP = 2e10, 1e6


def cut(sparent: np.ndarray, width: np.ndarray, height: np.ndarray, slots: int, limit: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(grp, step) of each supernode. Whole subtrees of at most ``limit`` operations and of no front over ``MAX_FRONT`` are one group each and form step 0; a
    supernode above is a group of its own, one step after its last child. With no ``limit`` it is a quarter of a slot's share, or ``GRAIN`` if that is more, or
    4, 16, ... times as much where that saves more tiers and steps than the largest subtree then takes longer; such a subtree has ``PANELS`` entries at most, or
    ``WHOLE`` if the whole factor has."""
    cost = panel_flops(width.astype(float), height.astype(float))
    total = subtree_costs(sparent, np.where(height > MAX_FRONT, np.inf, cost))
    if limit is not None:
        return _cut(sparent, total, limit)
    entries, steps = width.astype(float) * height, subtree_costs(sparent, np.full(len(width), STEP))
    held = subtree_costs(sparent, entries)
    total[held > (WHOLE if entries.sum() <= WHOLE else max(PANELS, entries.sum() / (4 * slots)))] = np.inf
    limit, best = max(cost.sum() / (4 * slots), GRAIN), None
    while True:
        found = _cut(sparent, total, limit)
        low = total <= limit
        takes = (total + steps)[low].max(initial=0) + LEVEL * _waits(sparent, width, height, found[1], slots)
        if best is None or takes < best[0]:
            best = takes, found
        if limit >= cost.sum() or not found[1].any():
            return best[1]
        limit *= 4


def _waits(sparent: np.ndarray, width: np.ndarray, height: np.ndarray, step: np.ndarray, slots: int) -> int:
    """Tiers of the top, and steps of what isn't in one."""
    tier, _ = tiers(sparent, width, height, step, slots)
    return int(tier.max(initial=-1)) + 1 + len(np.unique(step[(step > 0) & (tier < 0)]))


def _cut(sparent: np.ndarray, total: np.ndarray, limit: float) -> tuple[np.ndarray, np.ndarray]:
    ns = len(sparent)
    up, low = array("q", sparent.astype(np.int64).tobytes()), bytearray((total <= limit).tobytes())
    grp, step = array("q", np.arange(ns).tobytes()), array("q", np.where(total > limit, 1, 0).astype(np.int64).tobytes())
    for s in range(ns - 1, -1, -1):
        p = up[s]
        if low[s] and p >= 0 and low[p]:
            grp[s] = grp[p]
    for s in range(ns):
        p = up[s]
        if p >= 0 and not low[p] and step[p] <= step[s]:
            step[p] = step[s] + 1
    return np.array(grp), np.array(step)


def bundles(grp: np.ndarray, step: np.ndarray, width: np.ndarray, height: np.ndarray, slots: int) -> np.ndarray:
    """``grp`` with subtrees put together, so that a task has several small ones: the largest first, each to the bundle of least cost so far; there are four
    bundles a slot, or more if their panels would pass ``PANELS`` entries or ``SUPERNODES`` supernodes each. Above the subtrees nothing changes."""
    low = step == 0
    trees, of = np.unique(grp[low], return_inverse=True)
    cost = np.bincount(of, panel_flops(width[low].astype(float), height[low].astype(float)), len(trees))
    parts = max(1, min(len(trees), max(4 * slots, -(-int((width * height)[low].sum()) // PANELS), -(-int(low.sum()) // SUPERNODES))))
    largest = np.argsort(-cost, kind="stable")
    own = np.empty(len(trees), np.int64)
    own[largest] = balance(cost[largest], parts)
    first = np.full(parts, len(grp), np.int64)
    np.minimum.at(first, own, trees)  # a bundle has the name of one of its subtrees
    out = grp.copy()
    out[low] = first[own[of]]
    return out


#: Entries of the top that a task has at most where many share a tier, and where it has a tier to itself; and operations of the latter.
SHARE, ALONE, ONE = 4_000_000, 24_000_000, 1e11


def tiers(sparent: np.ndarray, width: np.ndarray, height: np.ndarray, step: np.ndarray, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(tier, part) of each supernode of the top, -1 for those that are left to go level by level. Tier by tier, whole subtrees of what is left of the top are put
    together in parts, each of which one task factors, however deep it is; a tier waits for those before it. No front of a part is over ``MAX_FRONT``."""
    ns, left = len(width), step > 0
    cost = panel_flops(width.astype(float), height.astype(float)) + STEP
    entries = width.astype(float) * height
    tier, part, now, named = np.full(ns, -1), np.full(ns, -1), 0, 0
    while left.any():
        total = subtree_costs(sparent, np.where(left, np.where(height > MAX_FRONT, np.inf, cost), 0))
        held = subtree_costs(sparent, np.where(left, entries, 0))
        whole = cost[left].sum()
        choices = [(max(whole / (4 * slots), LEVEL), SHARE), (ONE, ALONE)]
        if whole <= ONE and entries[left].sum() <= SHARE and height[left].max() <= MAX_FRONT:
            choices = [(np.inf, np.inf)]
        for limit, most in choices:
            low = left & (total <= limit) & (held <= most)
            own = np.arange(ns)
            for s in np.flatnonzero(low)[::-1].tolist():
                p = sparent[s]
                if p >= 0 and low[p]:
                    own[s] = own[p]
            trees, of = np.unique(own[low], return_inverse=True)
            if len(trees) > 4:
                break
        if not len(trees):
            break
        load = np.bincount(of, cost[low], len(trees))
        parts = max(1, min(len(trees), max(min(4 * slots, int(load.sum() // GRAIN)), -int(-entries[low].sum() // SHARE))))
        largest = np.argsort(-load, kind="stable")
        bundle = np.empty(len(trees), np.int64)
        bundle[largest] = balance(load[largest], parts)
        tier[low], part[low] = now, named + bundle[of]
        left, now, named = left & ~low, now + 1, named + parts
    return tier, part


def panels(sparent: np.ndarray, width: np.ndarray, step: np.ndarray, tier: np.ndarray, part: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """``tier`` and ``part`` with those that ``tiers`` left in panels: a supernode is in one panel with its children's, if that has no more than ``most`` columns, so a
    chain of thin supernodes isn't a chain of as many steps. A panel's level is one more than the highest below it; its part is an even number under -1."""
    left = (step > 0) & (tier < 0)
    low, high = int(tier.max(initial=-1)) + 1, np.full(len(width), -1)
    columns, joined, below = np.where(left, width, 0), np.zeros(len(width), bool), [[] for _ in width]
    for s in np.flatnonzero(left).tolist():
        together = int(width[s]) + sum(int(columns[c]) for c in below[s])
        high[s] = max((high[c] for c in below[s]), default=low)
        if together <= most:
            columns[s] = together
            joined[below[s]] = True
        elif below[s]:
            high[s] += 1
        if sparent[s] >= 0:
            below[sparent[s]].append(s)
    own = np.arange(len(width))
    for s in np.flatnonzero(joined)[::-1].tolist():
        own[s] = own[sparent[s]]
    number = np.unique(own[left], return_inverse=True)[1]
    tier, part = tier.copy(), part.copy()
    tier[left], part[left] = high[own[left]], -2 - 2 * number
    return tier, part


def block_levels(rows: list[np.ndarray], width: np.ndarray, step: np.ndarray, size: int, tier: np.ndarray | None = None, part: np.ndarray | None = None) -> tuple[np.ndarray, list, list]:
    """For each supernode: its first column's number among the columns of the top (-1 below it); the levels of its columns' blocks (None below the
    top); and, for roots of subtrees, the numbers of the rows above (None elsewhere).

    The parts of ``tiers`` and ``panels`` come first, each from a multiple of ``size`` on, in the order of the factor, and have their tier as level; a block may hold columns that
    wait for each other, as one task has them all; those of panels are filled up. The rest of the top is numbered step by step, each step from a multiple of ``size`` on, so that numbers have gaps and no block of ``size`` numbers holds columns of two
    steps, nor parts of a supernode that one block could hold: supernodes of one step don't depend on each other, nor do their blocks, unless one supernode has several. A block's level is one more than the
    highest of the blocks with a column that has rows in it, so there are about as many levels as steps."""
    ns, high = len(width), step > 0
    first, at = np.full(ns, -1, np.int64), 0
    shared = np.zeros(ns, bool) if tier is None else tier >= 0
    runs = [] if tier is None else np.split(by := np.lexsort((np.arange(ns), part, tier))[ns - int(shared.sum()) :], np.flatnonzero(np.diff(part[by])) + 1)
    for run in (*runs, *(np.flatnonzero((step == k) & ~shared) for k in np.unique(step[high & ~shared]))):
        for s in run.tolist():
            if at % size + width[s] > size and (part is None or part[s] >= -1):  # one that wouldn't fit begins a block
                at = -(-at // size) * size
            first[s] = at
            at += int(width[s])
        at = -(-at // size) * size
    number = np.full(int(width.sum()), -1, np.int64)
    for s in np.flatnonzero(high).tolist():
        number[rows[s][: width[s]]] = first[s] + np.arange(width[s])
    blocks = at // size
    reach: list[set[int]] = [set() for _ in range(blocks)]
    for s in np.flatnonzero(high & ~shared).tolist():
        own = np.unique(number[rows[s]] // size)
        for b in np.unique(number[rows[s][: width[s]]] // size).tolist():
            reach[b].update(own[own > b].tolist())
    level = np.full(blocks, int(tier.max(initial=-1)) + 1 if tier is not None else 0, np.int64)
    for s in np.flatnonzero(shared).tolist():
        level[first[s] // size : (first[s] + width[s] - 1) // size + 1] = tier[s]
    for b in range(blocks):
        for r in reach[b]:
            level[r] = max(level[r], level[b] + 1)
    levels = [level[(first[s] + np.arange(width[s])) // size] if high[s] else None for s in range(ns)]
    last = np.cumsum(width)  # the first row below a supernode tells whether it is the root of a subtree with something above it
    own = rows.ptr[:-1]
    after = np.where(rows.end[own] > last, last, np.where(np.diff(rows.ptr) > 1, rows.start[np.minimum(own + 1, len(rows.start) - 1)], -1))
    above: list = [None] * ns
    for s in np.flatnonzero(~high & (after >= 0) & (number[after] >= 0)).tolist():
        above[s] = number[rows[s][width[s] :]]
    return first, levels, above


def balance(load: np.ndarray, parts: int) -> np.ndarray:
    """Each item to the least loaded part, in order; of equal ones to the first."""
    held, out = [(0.0, k) for k in range(parts)], np.zeros(len(load), np.int64)
    for k, x in enumerate(load.tolist()):
        least, out[k] = heapq.heappop(held)
        heapq.heappush(held, (least + x, int(out[k])))
    return out


def find_least(load: np.ndarray, group: list[int]) -> int:
    """The least loaded process of a group."""
    return group[int(np.argmin(load[group]))]


def update_costs(rows: list[np.ndarray], width: np.ndarray, owner: np.ndarray, fan_in: bool, volume: bool = False) -> np.ndarray:
    """What the updates among supernodes cost each of them: charged to the one that they come from (fan-in) or go to (fan-out). An update by m rows, n of them
    in its target, over k columns costs the operations of the product of its m by k and k by n parts, or, as ``volume``, the m n entries that it moves."""
    out = np.zeros(len(width))
    for s, r in enumerate(rows):
        below = r[width[s] :]
        target, first = np.unique(owner[below], return_index=True)
        m = len(below) - first
        n = np.diff(np.append(first, len(below)))
        np.add.at(out, np.full(len(target), s) if fan_in else target, m * n * (1.0 if volume else 2.0 * width[s]))
    return out


#: Names of ``assign``: greedy by entries or operations; or process groups split down the tree, with updates charged to their source (FI) or target (FO).
BALANCERS = ("NNZ", "WORK", "SUBCUBE-FI", "SUBCUBE-FO", "SUBCUBE-VOLUME-FI", "SUBCUBE-VOLUME-FO")


def assign(kind: str, sparent: np.ndarray, rows: list[np.ndarray], width: np.ndarray, parts: int) -> np.ndarray:
    """The process of each supernode."""
    if kind not in BALANCERS:
        raise ValueError(f"unknown balancer {kind}")
    height = np.array([len(r) for r in rows], np.int64)
    if kind == "NNZ":
        return balance(width * height, parts)
    cost = panel_flops(width.astype(float), height.astype(float))
    if kind == "WORK":
        return balance(cost, parts)
    volume = "VOLUME" in kind
    owner = np.repeat(np.arange(len(width)), width)
    cost = update_costs(rows, width, owner, kind.endswith("FI"), volume) + (0 if volume else width.astype(float) ** 3 / 3 + width**2 * (height - width))
    groups = proportional(sparent, cost, parts)
    load, out = np.zeros(parts), np.zeros(len(width), np.int64)
    for s, (a, b) in enumerate(groups):
        out[s] = find_least(load, list(range(a, b)))
        load[out[s]] += cost[s]
    return out


def proportional(sparent: np.ndarray, cost: np.ndarray, parts: int) -> list[tuple[int, int]]:
    """The range of processes of each supernode: all for the roots' forest, split among children by the cost of their subtrees."""
    total = subtree_costs(sparent, cost)
    ns = len(sparent)
    children: list[list[int]] = [[] for _ in range(ns + 1)]
    for s, p in enumerate(sparent.tolist()):
        children[p if p >= 0 else ns].append(s)
    out = [(0, parts)] * ns
    todo = [(ns, 0.0, float(parts))]
    while todo:
        s, a, b = todo.pop()
        if s < ns:
            low = min(int(a), parts - 1)
            out[s] = (low, max(low + 1, min(parts, int(np.ceil(b - 1e-9)))))
        whole = sum(total[c] for c in children[s])
        at = a
        for c in sorted(children[s], key=lambda c: -total[c]):
            share = (b - a) * (total[c] / whole if whole else 1 / len(children[s]))
            todo.append((c, at, at + share))
            at += share
    return out


def tree_map(sparent: np.ndarray, owner: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The process of each block (i, j), i in the subtree of supernode j: by the wrapped square grid over that subtree's supernodes, each at its own process."""
    first = np.arange(len(sparent))
    for s, p in enumerate(sparent.tolist()):
        if p >= 0:
            first[p] = min(first[p], first[s])
    size = j - first[j] + 1
    side = np.ceil(np.sqrt(size)).astype(np.int64)
    a, b = i - first[j], j - first[j]
    low, high = np.minimum(a, b), np.maximum(a, b)
    return owner[first[j] + np.minimum(size - 1, low % side + side * (high % size // side))]
