"""Geometry and statistics of one cloud or one series."""

from __future__ import annotations

import numpy as np


def squares(columns: np.ndarray, point: np.ndarray) -> np.ndarray:
    """Squared distances of points, given coordinate by coordinate, from one point."""
    out = (columns[0] - point[0]) ** 2
    for x, p in zip(columns[1:], point[1:], strict=True):
        out += (x - p) ** 2
    return out


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(a), len(b)))
    for x, y in zip(a.T, b.T, strict=True):
        out += (x[:, None] - y) ** 2
    return np.sqrt(out, out=out)


def farthest_points(points: np.ndarray, size: int, first: int) -> np.ndarray:
    """Numbers of size points: first, then again and again the one farthest from those chosen (first on ties)."""
    n = len(points)
    if n <= size:
        return np.arange(n)
    chosen, columns = [first], np.ascontiguousarray(points.T)
    near = squares(columns, points[first])
    while len(chosen) < size:
        k = int(near.argmax())
        chosen.append(k)
        np.minimum(near, squares(columns, points[k]), out=near)
    return np.array(chosen)


#: Points that an order is followed beyond its size, for the distance below which a point is left out; steps between clearings.
BEYOND, CLEARED = 32, 16


class Farthest:
    """The farthest points of a pool, and those without each of its series.

    Without a series the order is the pool's until the series' first point in it. A point that is nearer to those chosen than the last one taken is
    never taken, so such points are dropped on the way. How near that will be is guessed from the pool's own order; an order that
    comes below the guess is made again with all points.
    """

    def __init__(self, points: np.ndarray, series: np.ndarray, size: int, first: int):
        self.points, self.series, self.size, n = points, series, size, len(points)
        self.columns = np.ascontiguousarray(points.T)
        self.order, self.guess = np.arange(n), 0.0
        if n > size:
            near, order = np.full(n, np.inf), [first]
            while True:
                np.minimum(near, squares(self.columns, points[order[-1]]), out=near)
                if len(order) >= min(size + BEYOND, n - 1):
                    break
                order.append(int(near.argmax()))
            self.order, self.guess = np.array(order[:size]), float(near.max())
        self.owners = set(series[self.order].tolist())

    def without(self, asked: dict[int, int]) -> dict[int, np.ndarray]:
        """asked: the number of the first point without each series. Numbers of the points without it."""
        out, n = {}, len(self.points)
        counts = dict(zip(*(x.tolist() for x in np.unique(self.series, return_counts=True)), strict=True))
        begins: list[tuple[int, int]] = []
        for s, first in asked.items():
            if n - counts.get(s, 0) <= self.size:
                out[s] = np.flatnonzero(self.series != s)
            elif n > self.size and len(at := np.flatnonzero(self.series[self.order] == s)) and at[0]:
                begins.append((int(at[0]), s))
            elif n > self.size and len(at) == 0:
                out[s] = self.order
            else:
                out[s] = self._whole(s, first)
        # The pool's own order, as far as each of them shares it; rows: points that may still be taken.
        rows, near, step = np.arange(n), np.full(n, np.inf), 0
        columns, series = self.columns, self.series
        for at, s in sorted(begins):
            while step < at:
                np.minimum(near, squares(columns, self.points[self.order[step]]), out=near)
                step += 1
                if step % CLEARED == 0:
                    keep = near >= self.guess
                    rows, near, columns, series = rows[keep], near[keep], np.ascontiguousarray(columns[:, keep]), series[keep]
            keep = (near >= self.guess) & (series != s)
            found = self._greedy(rows[keep], near[keep], columns.compress(keep, 1), self.size - at)
            out[s] = self._whole(s, asked[s]) if found is None else np.concatenate([self.order[:at], found])
        return out

    def _greedy(self, rows: np.ndarray, near: np.ndarray, columns: np.ndarray, more: int) -> np.ndarray | None:
        chosen: list[int] = []
        while len(chosen) < more:
            k = int(near.argmax()) if len(near) else 0
            if not len(near) or near[k] < self.guess or not near[k]:
                return None
            chosen.append(int(rows[k]))
            apart = columns - columns[:, k, None]
            np.multiply(apart, apart, out=apart)
            np.minimum(near, np.add.reduce(apart, axis=0), out=near)  # summed as squares() does
            if len(chosen) % CLEARED == 0:
                keep = np.flatnonzero(near >= self.guess)
                rows, near, columns = rows[keep], near[keep], columns.take(keep, 1)
        return np.array(chosen, int)

    def _whole(self, s: int, first: int) -> np.ndarray:
        left = np.flatnonzero(self.series != s)
        return left[farthest_points(self.points[left], self.size, int(np.searchsorted(left, first)))]


def tree_edges(dist: np.ndarray) -> np.ndarray:
    """(n - 1, 3): the ends and length of the edges of a minimum spanning tree (Prim, a row of distances a step)."""
    n = len(dist)
    best, parent, inside = dist[0].copy(), np.zeros(n, int), np.zeros(n, bool)
    inside[0] = True
    out = []
    for _ in range(n - 1):
        k = int(np.where(inside, np.inf, best).argmin())
        out.append((parent[k], k, best[k]))
        inside[k] = True
        closer = dist[k] < best
        best[closer], parent[closer] = dist[k][closer], k
    return np.array(out).reshape(-1, 3)


class Sets:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = i = up[up[i]]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        self.up[max(i, j)] = min(i, j)
        return i != j


def merges(edges: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """How a tree's edges, shortest first, join its points: the two parts of each merge (points, then merges by number) and its length."""
    n = len(edges) + 1
    sets, part = Sets(n), list(range(n))
    left, right, length = [], [], []
    for k, (a, b, d) in enumerate(edges[np.argsort(edges[:, 2], kind="stable")].tolist()):
        a, b = sets.find(int(a)), sets.find(int(b))
        left.append(part[a])
        right.append(part[b])
        length.append(d)
        sets.join(a, b)
        part[min(a, b)] = n + k
    return left, right, length


def kept_tree(points: np.ndarray) -> tuple[list[int], list[int], list[float]]:
    """The merges of a kept cloud's own tree; made once, they serve every pair that the cloud is in."""
    return merges(tree_edges(distances(points, points)) if len(points) > 1 else np.zeros((0, 3)))


def cross_h0(tree: tuple[list[int], list[int], list[float]], kept: np.ndarray, collapsed: np.ndarray) -> np.ndarray:
    """Lengths of the finite H0 bars of a cloud against one whose inner distances are 0.

    They are the edges of a minimum spanning tree on the cloud and a star at distance min_q d(p, q). By the
    cycle property only edges of the cloud's own tree and the star's can be in it: where the tree joins two parts, the
    part farther from the star is joined by the tree's edge or by its own way to the star, whichever is shorter. Bars of
    length 0 are left out.
    """
    if not len(kept) or not len(collapsed):
        return np.zeros(0)
    star = distances(kept, collapsed).min(1).tolist()
    bars = []
    for a, b, d in zip(*tree, strict=True):
        x, y = star[a], star[b]
        if x > y:
            x, y = y, x
        star.append(x)
        bars.append(d if d < y else y)
    bars.append(star[-1])
    out = np.array(bars)
    return out[out > 0]


def trees(points: np.ndarray) -> list[np.ndarray]:
    """tree_edges() of clouds of one size (clouds, points, coordinates), all at once; distances are made as they are needed."""
    g, n, _ = points.shape
    columns, best, parent, number = np.ascontiguousarray(np.moveaxis(points, 2, 0)), np.full((g, n), np.inf), np.zeros((g, n), int), np.tile(np.arange(n), (g, 1))
    out, each, k = np.zeros((g, max(n - 1, 0), 3)), np.arange(g), np.zeros(g, int)
    for step in range(n - 1):
        last, at, own = n - 1 - step, columns[:, each, k], number[each, k]
        for table in (*columns, best, parent, number):  # the last takes the place of the one that is in the tree now
            table[each, k] = table[:, last]
        apart = columns[:, :, :last] - at[:, :, None]
        np.multiply(apart, apart, out=apart)
        apart = np.add.reduce(apart, axis=0)
        closer = apart < best[:, :last]
        np.copyto(best[:, :last], apart, where=closer)
        np.copyto(parent[:, :last], own[:, None], where=closer)
        k = best[:, :last].argmin(1)
        out[:, step, 0], out[:, step, 1], out[:, step, 2] = parent[each, k], number[each, k], np.sqrt(best[each, k])
    return list(out)


def cross_many(tree: tuple[list[int], list[int], list[float]], star: np.ndarray) -> np.ndarray:
    """cross_h0() of one kept cloud against many: star is (points, clouds), each point's distance from each cloud. (points, clouds) lengths, those of 0 among them."""
    n, many = star.shape
    near, bars = np.empty((2 * n - 1, many)), np.empty((n, many))
    near[:n] = star
    for k, (a, b, d) in enumerate(zip(*tree, strict=True)):
        np.minimum(near[a], near[b], out=near[n + k])
        np.maximum(near[a], near[b], out=bars[k])
        np.minimum(bars[k], d, out=bars[k])
    bars[n - 1] = near[-1]
    return bars


def kde_tail(sample: np.ndarray, values: np.ndarray, grid: int = 512) -> np.ndarray:
    """Upper tail of each value under the density of sample and its mirror image (Gaussian kernels, Scott's width).

    The distribution is summed on a grid from 0 to a fifth more than the larger of the value and the sample's
    most. A value not above 0, or not finite, has tail 1; a sample of one distinct value falls back to counts.
    """
    values = np.asarray(values, float)
    n = len(sample)
    both = np.concatenate([sample, -sample])
    width = both.std(ddof=1) * len(both) ** -0.2 if n else 0.0
    out = np.ones(len(values))
    good = np.isfinite(values) & (values > 0)
    if not n or np.unique(sample).size < 2 or width <= 0:
        return np.where(np.isfinite(values), 1 - np.searchsorted(np.sort(sample), values, "left") / max(n, 1), 1.0)
    most = sample.max()

    def cdf(top: float) -> tuple[np.ndarray, np.ndarray]:
        at = np.linspace(0, 1.2 * top + 1e-6, grid)
        total = np.cumsum(np.exp(-0.5 * ((at[:, None] - both[None, :]) / width) ** 2).sum(1))
        return at, total / total[-1]

    shared = cdf(most)
    for k in np.flatnonzero(good):
        at, total = shared if values[k] <= most else cdf(values[k])
        i = np.searchsorted(at, values[k], "left")
        out[k] = 1 - total[i - 1] if i else 1.0
    return np.clip(out, 0, 1)


def beyond_tail(values: np.ndarray, weights: np.ndarray, width: float, at: float, grid: int = 512) -> float:
    """The tail of kde_tail for a value beyond the sample, given as values and weights: the grid reaches a fifth beyond it."""
    steps = np.linspace(0, 1.2 * at + 1e-6, grid)
    total = np.zeros(grid)
    for a in range(0, len(values), 1024):
        x, w = values[a : a + 1024], weights[a : a + 1024]
        total += (np.exp(-0.5 * ((steps[:, None] - x) / width) ** 2) + np.exp(-0.5 * ((steps[:, None] + x) / width) ** 2)) @ w
    i = int(np.searchsorted(steps, at, "left"))
    return float(np.clip(1 - total[:i].sum() / total.sum(), 0, 1)) if i and total.sum() > 0 else 1.0


def mutual_information(x: np.ndarray, lag: int, bins: int = 16) -> float:
    counts = np.histogram2d(x[:-lag], x[lag:], bins=bins)[0]
    p = counts / counts.sum()
    q = p.sum(1, keepdims=True) * p.sum(0, keepdims=True)
    return float((p[p > 0] * np.log(p[p > 0] / q[p > 0])).sum())


def embedding_parameters(x: np.ndarray, max_tau: int, max_m: int) -> tuple[int, int]:
    """(tau, m): the first minimum of mutual information; the dimension from which few neighbours are false."""
    max_tau = max(1, min(max_tau, len(x) // 3))
    info = [mutual_information(x, t) for t in range(1, max_tau + 1)]
    tau = next((t + 1 for t in range(1, len(info) - 1) if info[t] <= info[t - 1] and info[t] < info[t + 1]), int(np.argmin(info)) + 1)
    for m in range(1, max_m + 1):
        count = len(x) - m * tau
        if count < 3:
            return tau, max(1, m - 1)
        cloud = np.stack([x[k * tau : k * tau + count] for k in range(m)], 1)
        d = distances(cloud, cloud)
        np.fill_diagonal(d, np.inf)
        near = d.argmin(1)
        gap = np.abs(x[m * tau : m * tau + count] - x[m * tau + near])
        if (gap > 10 * np.maximum(d[np.arange(count), near], 1e-12)).mean() < 0.05:
            return tau, m
    return tau, max_m


def cloud_statistics(points: np.ndarray) -> np.ndarray:
    """Mean (3) and population deviation (3) along the cloud's own principal axes, and its size."""
    centred = points - points.mean(0)
    _, _, axes = np.linalg.svd(centred, full_matrices=False)
    # An axis points to where its largest weight is positive.
    axes = axes[:3] * np.sign(axes[:3][np.arange(min(3, len(axes))), np.abs(axes[:3]).argmax(1)])[:, None]
    along = np.zeros((len(points), 3))
    along[:, : len(axes)] = centred @ axes.T
    return np.concatenate([along.mean(0), along.std(0), [len(points)]])
