"""Many small linear programs: min c x with A x <= b and x >= 0, one per row, b >= 0."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def simplex(c: np.ndarray, a: np.ndarray, b: np.ndarray, most: int = 100, tiny: float = 1e-12) -> tuple[np.ndarray, bool]:
    """The tableau method from the slack basis, the steepest cost first; x and whether it is optimal."""
    m, n = a.shape
    t = np.block([[a, np.eye(m), b[:, None]], [c[None], np.zeros((1, m + 1))]])
    basis = list(range(n, n + m))
    done = False
    for _ in range(most):
        k = int(t[-1, :-1].argmin())
        if t[-1, k] >= -tiny:
            done = True
            break
        column = t[:-1, k]
        ratio = np.where(column > tiny, t[:-1, -1] / np.where(column > tiny, column, 1), np.inf)
        r = int(ratio.argmin())
        if ratio[r] == np.inf:
            break
        t[r] /= t[r, k]
        others = np.arange(m + 1) != r
        t[others] -= t[others, k][:, None] * t[r]
        basis[r] = k
    x = np.zeros(n + m)
    x[basis] = t[:-1, -1]
    return x[:n], done


def solve(programs: DataFrame, most: int = 100) -> DataFrame:
    """Rows of k, c, a (rows one after the other) and b with x, value and done."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for c, a, b in zip(pdf["c"], pdf["a"], pdf["b"]):
                c, b = np.asarray(c, float), np.asarray(b, float)
                x, done = simplex(c, np.asarray(a, float).reshape(len(b), len(c)), b, most)
                out.append((x.tolist(), float(c @ x), done))
            yield pd.DataFrame({"k": pdf["k"], "x": [o[0] for o in out], "value": [o[1] for o in out], "done": [o[2] for o in out]})

    kind = programs.schema["k"].dataType.simpleString()
    return programs.select("k", "c", "a", "b").mapInPandas(run, f"k {kind}, x array<double>, value double, done boolean")
