"""Metric trees by the anchors hierarchy, and nearest-entry assignment on them.

A tree starts in the middle: about sqrt(n) anchors are placed one after the other, each on the point that
is furthest from its anchor, and take over the points that are nearer to them; the triangle inequality tells
which points need no look.  Each anchor's points get a tree of their own, and the anchors' balls are then
joined in pairs, the tightest joint ball first.  Every ball keeps the sum and count of its points.

To find each point's nearest entry of a codebook, the list of entries that may be nearest to some point of a
ball is handed down from ball to ball and shrinks.  If one entry is left, the whole ball is its own: sum and
count are added without a look at the points.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

LEAF = 24


@dataclass
class Tree:
    """Balls over points; a ball's points are ``order[lo:hi]``. A leaf has no children (-1). The root is ball 0."""

    order: np.ndarray
    lo: np.ndarray
    hi: np.ndarray
    left: np.ndarray
    right: np.ndarray
    centre: np.ndarray
    radius: np.ndarray
    sums: np.ndarray


@dataclass
class _Node:
    points: np.ndarray | None = None
    children: tuple["_Node", ...] = field(default=())


def place_anchors(points: np.ndarray, wanted: int) -> list[np.ndarray]:
    """The points (as places) of up to ``wanted`` anchors, nearest anchor first come; fewer if points coincide."""
    where = [0]
    owner = np.zeros(len(points), np.int64)
    far = np.sqrt(((points - points[0]) ** 2).sum(1))
    while len(where) < wanted:
        fresh = int(far.argmax())
        if far[fresh] == 0:
            break
        # A point nearer to its own anchor than half the way between the anchors cannot change hands.
        half = np.sqrt(((points[where] - points[fresh]) ** 2).sum(1)) / 2
        open_ = np.flatnonzero(far >= half[owner] * (1 - 1e-12))
        distance = np.sqrt(((points[open_] - points[fresh]) ** 2).sum(1))
        taken = distance < far[open_]
        owner[open_[taken]], far[open_[taken]] = len(where), distance[taken]
        where.append(fresh)
    by_owner = np.argsort(owner, kind="stable")
    return [x for x in np.split(by_owner, np.searchsorted(owner[by_owner], np.arange(1, len(where)))) if len(x)]


def _grow(points: np.ndarray, places: np.ndarray) -> _Node:
    if len(places) <= LEAF:
        return _Node(places)
    groups = place_anchors(points[places], int(np.ceil(np.sqrt(len(places)))))
    if len(groups) == 1:
        return _Node(places)  # all the same point
    return _join(points, [_grow(points, places[g]) for g in groups], [places[g] for g in groups])


def _join(points: np.ndarray, nodes: list[_Node], owned: list[np.ndarray]) -> _Node:
    """Join balls in pairs, the pair with the smallest joint ball first, until one is left."""
    count = np.array([len(x) for x in owned], float)
    centre = np.array([points[x].mean(0) for x in owned])
    radius = np.array([np.sqrt(((points[x] - c) ** 2).sum(1).max()) for x, c in zip(owned, centre, strict=True)])
    alive = np.ones(len(nodes), bool)

    def joint(i: int) -> np.ndarray:
        """Radius of the ball around both, for ball i with every other."""
        apart = np.sqrt(((centre - centre[i]) ** 2).sum(1))
        share = count / (count + count[i])
        size = np.maximum(apart * share + radius[i], apart * (1 - share) + radius)
        size[~alive] = np.inf
        size[i] = np.inf
        return size

    cost = np.array([joint(i) for i in range(len(nodes))])
    for _ in range(len(nodes) - 1):
        i, j = divmod(int(cost.argmin()), len(nodes))
        both, size = count[i] + count[j], cost[i, j]
        nodes[i] = _Node(children=(nodes[i], nodes[j]))
        centre[i], count[i], radius[i] = (centre[i] * count[i] + centre[j] * count[j]) / both, both, size
        alive[j] = False
        cost[j, :] = cost[:, j] = np.inf
        cost[i, :] = cost[:, i] = joint(i)
    return nodes[int(alive.argmax())]


def build(points: np.ndarray) -> Tree:
    """The tree over integer points (one row each, at least one)."""
    root = _grow(points.astype(float), np.arange(len(points)))
    order, lo, hi, left, right = [], [], [], [], []
    at, stack = 0, [(root, -1, True)]
    while stack:
        node, parent, is_left = stack.pop()
        ball = len(lo)
        if parent >= 0:
            (left if is_left else right)[parent] = ball
        lo.append(at)
        hi.append(0)
        left.append(-1)
        right.append(-1)
        if node.points is not None:
            order.append(node.points)
            at += len(node.points)
            hi[ball] = at
        else:
            stack += [(node.children[1], ball, False), (node.children[0], ball, True)]
    for ball in range(len(lo) - 1, -1, -1):  # children come after their ball
        if left[ball] >= 0:
            hi[ball] = hi[right[ball]]
    places = np.concatenate(order)
    sums = np.array([points[places[a:b]].sum(0) for a, b in zip(lo, hi, strict=True)], np.int64)
    centre = sums / (np.array(hi) - np.array(lo))[:, None]
    radius = [np.sqrt(((points[places[a:b]] - c) ** 2).sum(1).max()) for a, b, c in zip(lo, hi, centre, strict=True)]
    whole = [np.array(x, np.int32) for x in (places, lo, hi, left, right)]
    return Tree(*whole, centre, np.array(radius), sums)


@dataclass
class Assignment:
    """Each point's entry, and of each entry the count and sum of its points; balls owned without a look at points."""

    entries: np.ndarray
    counts: np.ndarray
    sums: np.ndarray
    owned: int


def assign(tree: Tree, points: np.ndarray, codebook: np.ndarray) -> Assignment:
    """The nearest entry of each point by squared Euclidean distance of integers, ties to the lower index.

    Points and entries are int64 whose squared distances fit in 63 bits.  Balls are judged in floating point
    with room for its rounding, points by exact integers.
    """
    # Of equal entries only the first can win.
    first = np.sort(np.unique(codebook, axis=0, return_index=True)[1]) if codebook.shape[1] else np.zeros(1, np.int64)
    entries = codebook[first]
    real = entries.astype(float)
    apart = np.sqrt(((real[:, None] - real[None]) ** 2).sum(2))
    chosen = np.zeros(len(points), np.int64)
    counts, sums, owned = np.zeros(len(codebook), np.int64), np.zeros(codebook.shape, np.int64), 0
    stack = [(0, np.arange(len(first)))]
    while stack:
        ball, listed = stack.pop()
        square = ((real[listed] - tree.centre[ball]) ** 2).sum(1)
        best = int(square.argmin())
        # Beyond the middle between two entries by more than the radius, every point is strictly nearer to the best.
        room = 2 * tree.radius[ball] * apart[listed, listed[best]]
        listed = listed[square - square[best] <= room * (1 + 1e-9) + 1e-10 * (square + square[best]) + 1e-3]
        lo, hi = int(tree.lo[ball]), int(tree.hi[ball])
        if len(listed) == 1:
            entry = first[listed[0]]
            chosen[tree.order[lo:hi]] = entry
            counts[entry] += hi - lo
            sums[entry] += tree.sums[ball]
            owned += 1
        elif tree.left[ball] < 0:
            own = tree.order[lo:hi]
            exact = ((points[own][:, None] - entries[listed][None]) ** 2).sum(2)
            nearest = first[listed[exact.argmin(1)]]
            chosen[own] = nearest
            np.add.at(counts, nearest, 1)
            np.add.at(sums, nearest, points[own])
        else:
            stack += [(int(tree.left[ball]), listed), (int(tree.right[ball]), listed)]
    return Assignment(chosen, counts, sums, owned)
