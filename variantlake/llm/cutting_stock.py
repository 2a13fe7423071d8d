"""The cutting-stock problem by column generation, on integer size classes.

Everything here is bounded by the number of classes, whatever the input holds.

Defined cases: no demand gives no patterns; a class without demand is in none; equal values
go to the smaller class first. Inputs are counts by class, so there are no nulls, texts or
repeated rows here.
"""

from __future__ import annotations

import numpy as np


def best_pattern(values: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the pattern of largest value. Class
    c (1, 2, ...) takes c units; negative values are never taken."""
    best = np.zeros(capacity + 1)
    taken = np.zeros(capacity + 1, int)
    for c in range(1, capacity + 1):
        n = min(c, len(values))
        options = best[c - 1 :: -1][:n] + values[:n]  # class k leaves c - k units
        k = int(np.argmax(options))
        best[c], taken[c] = (options[k], k + 1) if options[k] > best[c - 1] else (best[c - 1], 0)
    pattern = np.zeros(len(values), int)
    c = capacity
    while c > 0:
        if taken[c]:
            pattern[taken[c] - 1] += 1
            c -= taken[c]
        else:
            c -= 1
    return float(best[capacity]), pattern


def times(matrix: np.ndarray, vector: np.ndarray) -> np.ndarray:
    return (matrix * vector).sum(axis=1)


def inverted(matrix: np.ndarray) -> np.ndarray:
    """The inverse by elimination with partial pivoting. In numpy's own loops: beside a
    live session the threads of its linear algebra library may never return."""
    n = len(matrix)
    both = np.hstack([matrix.astype(float), np.eye(n)])
    for k in range(n):
        pivot = k + int(np.argmax(np.abs(both[k:, k])))
        both[[k, pivot]] = both[[pivot, k]]
        both[k] /= both[k, k]
        factors = both[:, k].copy()
        factors[k] = 0
        both -= np.outer(factors, both[k])
    return both[:, n:]


def solve(demand: np.ndarray, capacity: int, gap: float = 2e-3, max_rounds: int = 2_000) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often each is used in the linear relaxation; together they meet
    ``demand`` exactly. Revised simplex; knapsack prices the columns. A best column
    worth w proves a plan within a factor w of the optimum, so it ends at 1 + ``gap``;
    an earlier end leaves a feasible plan."""
    at = np.nonzero(demand > 0)[0]
    if not len(at):
        return []
    d = demand[at].astype(float)
    basis = np.zeros((len(at), len(at)))  # a pattern per column, classes in use only
    np.fill_diagonal(basis, capacity // (at + 1))
    inverse = np.diag(1 / np.diag(basis))
    x = times(inverse, d)
    for turn in range(max_rounds):
        dual = inverse.sum(axis=0)
        values = np.zeros(len(demand))
        values[at] = dual
        worth, pattern = best_pattern(values, capacity)
        if worth <= 1 + gap:
            break
        column = pattern[at].astype(float)
        u = times(inverse, column)
        up = u > 1e-9
        ratio = np.full(len(u), np.inf)
        ratio[up] = np.maximum(x[up], 0) / u[up]
        out = int(np.argmin(ratio))
        basis[:, out] = column
        row = inverse[out] / u[out]
        inverse -= np.outer(u, row)
        inverse[out] = row
        x -= ratio[out] * u
        x[out] = ratio[out]
        if turn % 200 == 199:
            inverse = inverted(basis)
            x = times(inverse, d)
    out_plan = []
    for k in range(len(at)):
        pattern = np.zeros(len(demand), int)
        pattern[at] = basis[:, k].round().astype(int)
        out_plan.append((pattern, max(0.0, float(x[k]))))
    return out_plan


def integral(demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """A whole-numbered plan that meets ``demand`` exactly: the relaxation rounded
    down, then the rest filled greedily, the largest classes first."""
    plan: list[tuple[np.ndarray, int]] = []
    rest = demand.astype(np.int64).copy()
    for pattern, times in solve(demand, capacity):
        used = pattern > 0
        n = min(int(times + 1e-6), int((rest[used] // pattern[used]).min()))
        if n > 0:
            plan.append((pattern, n))
            rest -= n * pattern
    while rest.any():
        pattern, left = np.zeros(len(demand), np.int64), capacity
        for c in range(len(demand), 0, -1):
            n = min(int(rest[c - 1]), left // c)
            pattern[c - 1] = n
            left -= n * c
        used = pattern > 0
        n = int((rest[used] // pattern[used]).min())
        plan.append((pattern, n))
        rest -= n * pattern
    return plan
