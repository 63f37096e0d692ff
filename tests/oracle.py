"""A dense brute-force matrix with masks, to compare the engine with."""

from __future__ import annotations

import numpy as np


def dense(m) -> np.ma.MaskedArray:
    """The dense form that the engine gives, of a single matrix."""
    n = len(m)
    out = np.ma.masked_all((n, n))
    for r in m.todense().collect():
        if r["value"] is not None:
            out[r["row"], r["col"]] = r["value"]
    return out


def build(n: int, d: int, cells: dict, masked=(), bins=(), fill: float = 0.0, default: float = 0.0) -> np.ma.MaskedArray:
    """cells: {(row, col): value} of the upper triangle."""
    a = np.ma.array(np.full((n, n), float(default)), mask=np.zeros((n, n), dtype=bool))
    i, j = np.indices((n, n))
    a[np.abs(i - j) < d] = fill
    for (r, c), v in cells.items():
        if abs(r - c) < d:
            a[r, c] = a[c, r] = v
    for r, c in masked:
        if abs(r - c) < d:
            a.mask[r, c] = a.mask[c, r] = True
    for b in bins:
        a.mask[b, :] = a.mask[:, b] = True
    return a


def same(a: np.ma.MaskedArray, b: np.ma.MaskedArray) -> None:
    assert np.array_equal(np.ma.getmaskarray(a), np.ma.getmaskarray(b))
    np.testing.assert_allclose(a.filled(-99.0), b.filled(-99.0), rtol=1e-9, atol=1e-9)
