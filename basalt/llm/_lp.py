"""Cutting stock by column generation: a revised simplex over patterns, priced by knapsack."""

from __future__ import annotations

import numpy as np


def knapsack(value: np.ndarray, size: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best unbounded knapsack: (total value, how often each item is taken)."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    order = np.argsort(size, kind="stable")
    size, value = size[order], value[order]
    for c in range(1, capacity + 1):
        best[c] = best[c - 1]
        k = np.searchsorted(size, c, "right")
        if k:
            gain = best[c - size[:k]] + value[:k]
            i = int(gain.argmax())
            if gain[i] > best[c]:
                best[c], took[c] = gain[i], i
    counts, c = np.zeros(len(size), np.int64), capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            counts[took[c]] += 1
            c -= size[took[c]]
    out = np.zeros_like(counts)
    out[order] = counts
    return float(best[capacity]), out


def patterns(size: np.ndarray, demand: np.ndarray, capacity: int, gap: float = 0.0005) -> list[tuple[np.ndarray, int]]:
    """Integral patterns (counts per item, times) that cover ``demand`` exactly within ``capacity``.

    Columns enter until the linear program is within ``gap`` of what the items' sizes alone need, or no
    pattern can lower it by more than ``gap`` of it; the solution is rounded down, and what is left (less than one sequence a pattern) goes by
    first fit decreasing.
    """
    m = len(size)
    if not m:
        return []
    columns = np.diag(capacity // size).astype(float)
    inverse = np.diag(1.0 / np.diag(columns))
    x = inverse @ demand
    least = float(demand @ size) / capacity
    for _ in range(40 * m):
        if x.sum() <= (1 + gap) * least:
            break
        price, entering = knapsack(np.maximum(inverse.sum(0), 0), size, capacity)
        if price <= 1 + gap:
            break
        d = inverse @ entering
        ok = d > 1e-9
        ratio = np.where(ok, x / np.where(ok, d, 1), np.inf)
        r = int(ratio.argmin())
        step = max(ratio[r], 0.0)
        x -= step * d
        x[r] = step
        pivot = inverse[r] / d[r]
        inverse -= np.outer(d, pivot)
        inverse[r] = pivot
        columns[:, r] = entering
    left = demand.astype(np.int64).copy()
    out: dict[tuple, int] = {}

    def use(counts: np.ndarray, times: int) -> None:
        key = tuple((int(i), int(counts[i])) for i in np.flatnonzero(counts))
        out[key] = out.get(key, 0) + times

    whole = columns.astype(np.int64)
    for r in np.argsort(-x, kind="stable"):
        has = whole[:, r] > 0
        times = min(int(np.floor(x[r] + 1e-6)), int((left[has] // whole[has, r]).min()))
        if times > 0:
            use(whole[:, r], times)
            left -= times * whole[:, r]
    for r in np.argsort(-(x - np.floor(x)), kind="stable"):
        if x[r] > 1e-6 and (whole[:, r] <= left).all():
            use(whole[:, r], 1)
            left -= whole[:, r]
    room: list[int] = []
    filled: list[np.ndarray] = []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    for i in np.argsort(-size, kind="stable"):
        for _ in range(int(left[i])):
            fit = next((c for c in range(int(size[i]), capacity + 1) if by_room[c]), None)
            if fit is None:
                room.append(capacity)
                filled.append(np.zeros(m, np.int64))
                b = len(room) - 1
            else:
                b = by_room[fit].pop()
            filled[b][i] += 1
            room[b] -= int(size[i])
            by_room[room[b]].append(b)
    for counts in filled:
        use(counts, 1)
    result = []
    for key, times in out.items():
        counts = np.zeros(m, np.int64)
        for i, n in key:
            counts[i] = n
        result.append((counts, times))
    return result
