"""Small numerical kernels on NumPy: simplex search, Hessians, assignment, union area."""

from __future__ import annotations

import heapq
import math

import numpy as np


def simplex(f, start, tol: float = 1e-9, most: int = 10_000) -> tuple[np.ndarray, float]:
    """Nelder-Mead minimum of ``f`` from ``start``: (point, value)."""
    x0 = np.asarray(start, float)
    n = len(x0)
    pts = np.tile(x0, (n + 1, 1))
    for i in range(n):
        pts[i + 1, i] = x0[i] * 1.05 if x0[i] else 0.00025
    val = np.asarray([f(p) for p in pts])
    for _ in range(most):
        order = np.argsort(val, kind="stable")
        pts, val = pts[order], val[order]
        if np.max(np.abs(pts[1:] - pts[0])) <= tol and np.max(np.abs(val[1:] - val[0])) <= tol:
            break
        mid = pts[:-1].mean(axis=0)
        reach = lambda k: mid + k * (mid - pts[-1])
        r = reach(1.0)
        fr = f(r)
        if fr < val[0]:
            e = reach(2.0)
            fe = f(e)
            pts[-1], val[-1] = (e, fe) if fe < fr else (r, fr)
        elif fr < val[-2]:
            pts[-1], val[-1] = r, fr
        else:
            c = reach(0.5) if fr < val[-1] else reach(-0.5)
            fc = f(c)
            if fc < min(fr, val[-1]):
                pts[-1], val[-1] = c, fc
            else:
                pts[1:] = pts[0] + 0.5 * (pts[1:] - pts[0])
                val[1:] = [f(p) for p in pts[1:]]
    i = int(np.argmin(val))
    return pts[i], float(val[i])


def gradient(f, x: np.ndarray) -> np.ndarray:
    h = 1e-6 * np.maximum(np.abs(x), 1.0)
    unit = np.eye(len(x))
    return np.asarray([(f(x + h[i] * unit[i]) - f(x - h[i] * unit[i])) / (2 * h[i]) for i in range(len(x))])


def hessian(f, x, eps: float) -> np.ndarray:
    """Central differences with steps of eps * max(|x|, 1)."""
    x = np.asarray(x, float)
    n = len(x)
    step = np.diag(eps * np.maximum(np.abs(x), 1.0))
    out = np.empty((n, n))
    for i in range(n):
        for j in range(i + 1):
            a, b = step[i], step[j]
            out[i, j] = out[j, i] = (f(x + a + b) - f(x + a - b) - f(x - a + b) + f(x - a - b)) / (4 * a[i] * b[j])
    return out


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """One-to-one assignment of least total cost, all rows or all columns: shortest augmenting paths with potentials."""
    cost = np.asarray(cost, float)
    if cost.size == 0:
        return []
    if cost.shape[0] > cost.shape[1]:
        return sorted((i, j) for j, i in assign(cost.T))
    n, m = cost.shape
    u, v = np.zeros(n), np.zeros(m)
    row_of = np.full(m, -1)
    for i in range(n):
        least, before, used = np.full(m, np.inf), np.full(m, -1), np.zeros(m, bool)
        row, last = i, -1
        while True:
            slack = np.where(used, np.inf, cost[row] - u[row] - v)
            better = slack < least
            least[better], before[better] = slack[better], last
            col = int(np.argmin(np.where(used, np.inf, least)))
            delta = least[col]
            u[i] += delta
            for k in np.flatnonzero(used):
                u[row_of[k]] += delta
            v[used] -= delta
            least[~used] -= delta
            used[col], last = True, col
            if row_of[col] < 0:
                break
            row = row_of[col]
        while last >= 0:
            prior = before[last]
            row_of[last] = row_of[prior] if prior >= 0 else i
            last = prior
    return sorted((int(r), j) for j, r in enumerate(row_of) if r >= 0)


def sparse_pairs(candidates: list[tuple[int, int, float]], alone: float) -> list[tuple[int, int]]:
    """One-to-one pairs of candidates (row, column, cost of 0 or more) with the least total, where a row without a pair costs ``alone``.

    Rows come in one after the other; each takes the shortest path of swaps to a free column, or to leaving one row
    alone, on costs that are reduced by prices of rows and columns. Work and memory grow with the candidates.
    """
    ways: dict = {}
    for row, column, cost in candidates:
        ways.setdefault(row, []).append(((0, column), cost))
    price_of_row, price, taken, held = dict.fromkeys(ways, 0.0), {}, {}, {}
    for row in sorted(ways):
        ways[row].append(((1, row), alone))  # a column of its own
        reached: dict = {}
        behind: dict = {}
        queue: list = []
        now, far = row, 0.0
        while True:
            for column, cost in ways[now]:
                if column not in reached:
                    heapq.heappush(queue, (far + cost - price_of_row[now] - price.get(column, 0.0), column, now))
            while queue[0][1] in reached:
                heapq.heappop(queue)
            far, column, now = heapq.heappop(queue)
            reached[column], behind[column] = far, now
            if column not in taken:
                break
            now = taken[column]
        price_of_row[row] += far
        for c, d in reached.items():
            if c in taken:
                price_of_row[taken[c]] += far - d
            price[c] = price.get(c, 0.0) - (far - d)
        while True:  # swap back along the path
            now = behind[column]
            before = held.get(now)
            taken[column], held[now] = now, column
            if now == row:
                break
            column = before
    return sorted((row, column[1]) for column, row in taken.items() if column[0] == 0)


def union_area(rings: list) -> float:
    """Area covered by simple polygons (even-odd within each), by vertical slabs between all vertices and crossings."""
    edges = []
    for k, ring in enumerate(rings):
        pts = [(float(x), float(y)) for x, y in ring]
        for (ax, ay), (bx, by) in zip(pts, pts[1:] + pts[:1]):
            if ax != bx:
                edges.append((ax, ay, bx, by, k) if ax < bx else (bx, by, ax, ay, k))
    if not edges:
        return 0.0
    e = np.asarray([x[:4] for x in edges])
    owner = np.asarray([x[4] for x in edges])
    xs = set(e[:, 0]) | set(e[:, 2])
    slope = (e[:, 3] - e[:, 1]) / (e[:, 2] - e[:, 0])
    for i in range(len(e)):
        ds = slope[i] - slope
        with np.errstate(divide="ignore", invalid="ignore"):
            x = (e[:, 1] - slope * e[:, 0] - e[i, 1] + slope[i] * e[i, 0]) / ds
        ok = (ds != 0) & (x > np.maximum(e[i, 0], e[:, 0])) & (x < np.minimum(e[i, 2], e[:, 2]))
        xs |= set(x[ok])
    cuts = np.sort(np.asarray(list(xs)))
    total = 0.0
    for a, b in zip(cuts, cuts[1:]):
        mid = (a + b) / 2
        on = np.flatnonzero((e[:, 0] < mid) & (e[:, 2] > mid))
        heights = e[on, 1] + slope[on] * (mid - e[on, 0])
        inside: set[int] = set()
        last = 0.0
        for h, k in sorted(zip(heights, owner[on])):
            if inside:
                total += (h - last) * (b - a)
            inside ^= {k}
            last = h
    return total
