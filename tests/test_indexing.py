import gzip

import numpy as np
import pytest

from tests.oracle import build, dense, same
from tests.test_matrix import F3, MASK, make
from tessera.operators.indexing import assert_equal
from tessera.sources import bias_cli

CELLS = F3 | {(4, 4): 9, (2, 4): 3}


def test_brackets(spark):
    m, a = make(spark, 5, 3, CELLS, MASK, (3,), default=0.5), build(5, 3, CELLS, MASK, (3,), default=0.5)
    one = lambda df: [r["value"] for r in df.collect()]
    assert one(m[1, 2]) == [6] and one(m[2, 1]) == [6] and one(m[0, 1]) == [None] and one(m[0, 4]) == [0.5]
    assert [r["value"] for r in m[[0, 4, 2], [2, 2, 2]].orderBy("place").collect()] == [0, 3, None]
    assert [r["value"] for r in m[[0, 1], 1].orderBy("place").collect()] == [None, 2]
    same(dense(m[1:4]), a[1:4, 1:4])
    same(dense(m[:3, 0:3]), a[:3, :3])
    got = {(r["row"], r["col"]): r["value"] for r in m[0:5:2, 1:3].collect()}
    assert got == {(i, j): None if a[i, j] is np.ma.masked else a[i, j] for i in (0, 2, 4) for j in (1, 2)}
    assert {r["col"] for r in m[1, :].collect()} == set(range(5))
    assert {(r["i"], r["k"]): r["v"] for r in m[m > 2.0].collect()} == {(1, 1): 6.0, (2, 2): 3.0, (4, 0): 9.0}
    with pytest.raises(ValueError):
        m[-2:3]


def test_put(spark):
    m = make(spark, 5, 3, CELLS)
    a = build(5, 3, CELLS)
    a[1, 2] = a[2, 1] = 8
    same(dense(m.put((2, 1), 8)), a)
    b = build(5, 3, CELLS)
    for j, v in zip((2, 3), (10, 20), strict=True):
        b[1, j] = b[j, 1] = v
    same(dense(m.put((1, slice(2, 4)), [10, 20])), b)
    c = build(5, 3, CELLS)
    c[c > 5] = 0
    same(dense(m.put(m > 5.0, 0)), c)
    d = build(5, 3, CELLS)
    d[0, 0], d[1, 1] = 7, 6
    same(dense(m.put(([0, 1], [0, 1]), [7, 6])), d)


def test_numpy_protocols(spark):
    m, a = make(spark, 5, 3, CELLS, MASK), build(5, 3, CELLS, MASK)
    same(dense(np.add(m, 2)), a + 2)
    same(dense(np.subtract(2.0, m)), 2.0 - a)
    same(dense(np.float64(3.0) * m), 3.0 * a)
    same(dense(np.sqrt(m)), np.sqrt(a))
    q, r = np.divmod(m, 2)
    same(dense(q), a // 2)
    same(dense(r), a % 2)
    assert np.sum(m).first()["value"] == a.sum() and np.max(m, axis="diag").count() == 3
    same(dense(np.clip(m, 1, 4)), np.ma.clip(a, 1, 4))
    for bad in (lambda: np.add(m, m, where=True), lambda: np.sum(m, keepdims=True)):
        with pytest.raises(ValueError):
            bad()
    for bad in (lambda: np.add.reduce(m), lambda: np.add(m, np.ones(3)), lambda: np.matmul(m, m), lambda: np.linalg.inv(m)):
        with pytest.raises(TypeError):
            bad()


def test_where(spark):
    """Stored and unstored cells, fills other than 0, masks of cells and bins on all sides."""
    i, j = np.indices((5, 5))
    band = abs(i - j) < 3
    for fill in (0.0, 2.0):
        m, a = make(spark, 5, 3, CELLS, MASK, (3,)) + fill, build(5, 3, CELLS, MASK, (3,)) + fill
        w, b = make(spark, 5, 3, {(0, 0): 1, (1, 2): 1, (2, 4): 5, (3, 4): -1, (0, 2): 0}, (), (0,)), build(5, 3, {(0, 0): 1, (1, 2): 1, (2, 4): 5, (3, 4): -1, (0, 2): 0}, (), (0,))
        cases = (
            (np.multiply(m, 10, where=w), a * 10, b),
            (np.add(m, m, where=w), a + a, b),
            (np.sqrt(m, where=w), np.sqrt(a), b),
            (np.subtract(1.0, m, where=w), 1.0 - a, b),
            (np.negative(m, where=w + 1.0), -a, b + 1.0),
        )
        for got, full, chosen in cases:
            want = np.where(band & (chosen.data == 0), a.data, full.data)
            same(dense(got), np.ma.array(want, mask=np.ma.getmaskarray(a) | np.ma.getmaskarray(b)))
    q, r = np.divmod(m, 2, where=w)
    assert dense(q).shape == dense(r).shape == (5, 5)
    with pytest.raises(ValueError):
        np.add(m, 1, where=np.ones((5, 5), dtype=bool))


def test_iteration_counts_and_masks(spark):
    m, a = make(spark, 5, 3, CELLS, MASK, (3,)), build(5, 3, CELLS, MASK, (3,))
    assert [(k, len(v)) for _, k, v in m] == [(0, 5), (1, 4), (2, 3)]
    assert [v for _, _, v in m.iterrows()] == [[None if x is np.ma.masked else float(x) for x in row] for row in a]
    assert 9 in m and 77 not in m and 4 not in m
    assert m.count_masked().first()["value"] == a.mask.sum() and m.count_in_band().first()["value"] == 19
    assert_equal(m, m.copy())
    with pytest.raises(AssertionError, match="different: c"):
        assert_equal(m, m.clear_mask())
    again = m.set_mask(spark.createDataFrame([("c", 4, 0)], "chrom string, i int, k int"))
    same(dense(again), build(5, 3, CELLS, ((4, 4),), (3,)))


def test_bias_from_text(spark, tmp_path):
    with gzip.open(tmp_path / "f.gz", "wt") as f:
        f.writelines(f"chr1 0 {10 * i + 5} 1\n" for i in range(6))
    with gzip.open(tmp_path / "i.gz", "wt") as f:
        f.writelines(f"chr1 {10 * i + 5} chr1 {10 * j + 5} {5 + (i * j) % 4}\n" for i in range(6) for j in range(i, 6))
    assert bias_cli.main(["-i", f"file://{tmp_path}/i.gz", "-f", f"file://{tmp_path}/f.gz", "-o", f"file://{tmp_path}/out"], spark)
    lines = [x.split("\t") for p in sorted((tmp_path / "out").glob("*.gz")) for x in gzip.open(p, "rt").read().split("\n") if x]
    assert [x[1] for x in lines] == ["5", "15", "25", "35", "45", "55"]
    kept = [float(x[2]) for x in lines if float(x[2]) != -1]
    assert len(kept) >= 4 and abs(np.mean(kept) - 1) < 1e-9
