"""Agglomerative clustering of a bounded set of weighted points, and squarified treemaps. Both work on the driver."""

from __future__ import annotations

import numpy as np

#: Points that linkage() takes; it keeps their distance matrix.
MOST_POINTS = 4000


def linkage(points: np.ndarray, weights: np.ndarray | None = None, method: str = "ward") -> list[tuple[int, int, float, float]]:
    """Merges (left, right, height, weight) with the Lance-Williams update; a merge's number follows the points' numbers.

    ward: height is the square root of twice the increase of the sum of squares. average: height is
    the weighted mean distance. Ties: smallest numbers. No points, or one: no merges.
    """
    n = len(points)
    if n > MOST_POINTS:
        raise ValueError(f"{n} points; linkage() takes {MOST_POINTS}: cluster centroids of a coarser grouping instead")
    if method not in ("ward", "average"):
        raise ValueError(f"unknown method {method}")
    if n < 2:
        return []
    w = np.ones(n) if weights is None else np.asarray(weights, float).copy()
    x = np.asarray(points, float)
    square = (x * x).sum(1)
    d = np.maximum(square[:, None] + square[None, :] - 2 * x @ x.T, 0)
    d = d * (2 * w[:, None] * w[None, :] / (w[:, None] + w[None, :])) if method == "ward" else np.sqrt(d)
    np.fill_diagonal(d, np.inf)
    names = np.arange(n)
    out = []
    for step in range(n - 1):
        i, j = np.unravel_index(d.argmin(), d.shape)
        i, j = min(i, j), max(i, j)
        total, height = w[i] + w[j], d[i, j]
        if method == "ward":
            new = ((w + w[i]) * d[i] + (w + w[j]) * d[j] - w * height) / (w + total)
        else:
            new = (w[i] * d[i] + w[j] * d[j]) / total
        out.append((int(min(names[i], names[j])), int(max(names[i], names[j])), float(np.sqrt(height) if method == "ward" else height), float(total)))
        d[i], d[:, i] = new, new
        d[j], d[:, j] = np.inf, np.inf
        d[i, i] = np.inf
        w[i], names[i] = total, n + step
    return out


def ward(points: np.ndarray, weights: np.ndarray | None = None) -> list[tuple[int, int, float, float]]:
    """``linkage`` by Ward's criterion."""
    return linkage(points, weights)


def cut(merges: list[tuple[int, int, float, float]], n: int, k: int) -> list[int]:
    """Cluster numbers of n points when the last k - 1 merges are undone, numbered by their first point."""
    owner = list(range(n + len(merges)))

    def root(x: int) -> int:
        while owner[x] != x:
            x = owner[x]
        return x

    for step, (a, b, _, _) in enumerate(merges[: max(0, n - k)]):
        owner[root(a)] = owner[root(b)] = n + step
    seen: dict[int, int] = {}
    return [seen.setdefault(root(i), len(seen)) for i in range(n)]


#: Points that leaf_order() takes; it works on all pairs of leaves at each merge.
MOST_LEAVES = 600


def _min_plus(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([(row[:, None] + b).min(0) for row in a])


def leaf_order(merges: list[tuple[int, int, float, float]], distances: np.ndarray) -> list[int]:
    """The order of the leaves of a tree, its branches turned, with the least sum of distances of neighbours (Bar-Joseph, Gifford and Jaakkola 2001).

    cost[i, j] is the least sum for a branch that begins with leaf i and ends with leaf j. Of equal
    orders, that whose ends and joints come first counts.
    """
    n = len(merges) + 1
    if n > MOST_LEAVES:
        raise ValueError(f"{n} leaves; leaf_order() takes {MOST_LEAVES}")
    d = np.asarray(distances, float)
    cost = np.full((n, n), np.inf)
    np.fill_diagonal(cost, 0)
    leaves: list[list[int]] = [[i] for i in range(n)]

    def whole(node: int) -> np.ndarray:
        """Costs by the ends of a branch; its ends lie in different halves of it."""
        out = cost[np.ix_(leaves[node], leaves[node])]
        if node >= n:
            size = len(leaves[merges[node - n][0]])
            out[:size, :size] = out[size:, size:] = np.inf
        return out

    for a, b, *_ in merges:
        left, right = leaves[a], leaves[b]
        found = _min_plus(_min_plus(whole(a), d[np.ix_(left, right)]), whole(b))
        cost[np.ix_(left, right)] = found
        cost[np.ix_(right, left)] = found.T
        leaves.append(left + right)
    if n == 1:
        return [0]
    # a merge's pairs lie in different branches, so those of the root are the pairs of its two branches
    left, right = (leaves[k] for k in merges[-1][:2])
    i, j = np.unravel_index(cost[np.ix_(left, right)].argmin(), (len(left), len(right)))
    out: list[int] = []
    todo = [(2 * n - 2, left[i], right[j])]
    while todo:
        node, first, last = todo.pop()
        if node < n:
            out.append(node)
            continue
        a, b = merges[node - n][:2]
        if first not in leaves[a]:
            a, b = b, a
        one, two = leaves[a], leaves[b]
        total = whole(a)[one.index(first)][:, None] + d[np.ix_(one, two)] + whole(b)[:, two.index(last)][None, :]
        k, m = np.unravel_index(total.argmin(), total.shape)
        todo += [(b, two[m], last), (a, first, one[k])]
    return out


def treemap(sizes: list[float], width: float, height: float) -> list[tuple[float, float, float, float]]:
    """Rectangles (x, y, w, h) with areas in proportion to the sizes, largest first (Bruls, Huizing and van Wijk 2000); sizes of 0 have none."""
    total = sum(sizes)
    if total <= 0:
        return [(0.0, 0.0, 0.0, 0.0) for _ in sizes]
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    areas = [sizes[i] * width * height / total for i in order]
    out: list[tuple[float, float, float, float]] = [(0.0, 0.0, 0.0, 0.0)] * len(sizes)
    x, y, w, h, at = 0.0, 0.0, width, height, 0
    while at < len(areas) and areas[at] > 0:
        side = min(w, h)
        worst = lambda row: max(max(side * side * a / sum(row) ** 2, sum(row) ** 2 / (side * side * a)) for a in row)  # noqa: E731, B023
        end = at + 1
        while end < len(areas) and areas[end] > 0 and worst(areas[at : end + 1]) <= worst(areas[at:end]):
            end += 1
        thick, place = sum(areas[at:end]) / side, 0.0
        for i in range(at, end):
            long = areas[i] / thick
            out[order[i]] = (x, y + place, thick, long) if w >= h else (x + place, y, long, thick)
            place += long
        if w >= h:
            x, w = x + thick, w - thick
        else:
            y, h = y + thick, h - thick
        at = end
    return out
