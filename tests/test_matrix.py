import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.oracle import build, dense, same
from tessera.functions import numpy_api
from tessera.functions.ufuncs import BINARY, UNARY
from tessera.operators import BandMatrix
from tessera.operators.reductions import reduce

F1 = {(0, 0): 1, (1, 1): 2, (2, 2): 3, (3, 3): 4}
F3 = F1 | {(0, 1): 5, (1, 2): 6, (2, 3): 7}
MASK = ((0, 1), (2, 2))
FIXTURES = {"F1": (F1, ()), "F2": (F1, MASK), "F3": (F3, ()), "F4": (F3, MASK)}


def make(spark, n, d, cells, masked=(), bins=(), fill=0.0, default=0.0):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([("c", r, c, float(v)) for (r, c), v in cells.items()], "chrom string, row int, col int, value double")
    sizes = spark.createDataFrame([("c", n)], "chrom string, n long")
    m = BandMatrix.from_coo(df, d, sizes, how="sum")
    m = BandMatrix(m.cells, m.meta.withColumn("band_fill", F.lit(float(fill))).withColumn("default_value", F.lit(float(default))))
    if masked:
        m = m.add_mask(spark.createDataFrame([("c", r, c) for r, c in masked], "chrom string, row int, col int"))
    return m.mask_bins(spark.createDataFrame([("c", b) for b in bins], "chrom string, i int")) if bins else m


def vector(df, n, key):
    out = np.ma.masked_all(n)
    for r in df.collect():
        if r["value"] is not None:
            out[r[key]] = r["value"]
    return out


def expected(a, name, axis, d):
    f = {"ptp": lambda x: x.max() - x.min(), "all": lambda x: x.astype(bool).all(), "any": lambda x: x.astype(bool).any()}.get(name, lambda x: getattr(x, name)())
    parts = [a.ravel()] if axis is None else [a[i] for i in range(len(a))] if axis == "row" else [np.ma.diagonal(a, k) for k in range(d)]
    out = np.ma.masked_all(len(parts))
    for i, p in enumerate(parts):
        p = p.compressed()
        if len(p):
            out[i] = f(p)
    return out


NAMES = ("sum", "prod", "min", "max", "ptp", "mean", "var", "std", "all", "any")


def check_reductions(m, a, d, names=NAMES):
    for name in names:
        for axis, key, size in ((None, None, 1), ("row", "i", len(a)), ("diag", "k", d)):
            df = reduce(m, name, axis)
            got = vector(df.withColumn("z", df["chrom"].isNull().cast("int")), size, key or "z")
            want = expected(a, name, axis, d)
            assert np.array_equal(np.ma.getmaskarray(got), np.ma.getmaskarray(want)), (name, axis)
            np.testing.assert_allclose(got.filled(0), want.filled(0), rtol=1e-9, atol=1e-9, err_msg=f"{name} {axis}")


@pytest.mark.parametrize("name", FIXTURES)
def test_fixtures(spark, name):
    cells, masked = FIXTURES[name]
    m, a = make(spark, 4, 2, cells, masked), build(4, 2, cells, masked)
    same(dense(m), a)
    assert m.counts().first()["masked"] == (3 if masked else 0)
    check_reductions(m, a, 2, ("sum", "mean", "min", "all"))


def test_reductions_with_two_backgrounds(spark):
    cells = {(0, 0): 2, (0, 2): -3, (3, 4): 4, (6, 6): 0}
    kw = {"masked": ((1, 2), (0, 0)), "bins": (5,), "fill": 0.5, "default": -0.25}
    m, a = make(spark, 8, 3, cells, **kw), build(8, 3, cells, **kw)
    same(dense(m), a)
    check_reductions(m, a, 3)
    c = m.counts().first()
    i, j = np.indices((8, 8))
    inside = np.abs(i - j) < 3
    assert (c["masked"], c["unmasked"]) == (a.mask.sum(), (~a.mask).sum())
    assert (c["in_band_masked"], c["out_band_masked"], c["in_band"], c["out_band"]) == ((a.mask & inside).sum(), (a.mask & ~inside).sum(), inside.sum(), (~inside).sum())


def test_everything_masked_and_full_band(spark):
    m = make(spark, 3, 3, {(0, 1): 1}, bins=(0, 1, 2))
    assert [r["value"] for r in reduce(m, "sum").collect()] == [None]
    check_reductions(make(spark, 3, 3, {(0, 1): 1}, fill=2.0), build(3, 3, {(0, 1): 1}, fill=2.0), 3)


@settings(max_examples=6, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.data())
def test_random_matrices(spark, data):
    n = data.draw(st.integers(1, 7))
    d = data.draw(st.integers(1, n))
    at = st.tuples(st.integers(0, n - 1), st.integers(0, n - 1)).map(lambda x: (min(x), max(x)))
    cells = data.draw(st.dictionaries(at, st.integers(-3, 3), max_size=8))
    kw = {"masked": data.draw(st.lists(at, max_size=4)), "bins": data.draw(st.lists(st.integers(0, n - 1), max_size=2, unique=True)), "fill": data.draw(st.sampled_from([0.0, 1.5])), "default": data.draw(st.sampled_from([0.0, 0.1]))}
    m, a = make(spark, n, d, cells, **kw), build(n, d, cells, **kw)
    same(dense(m), a)
    check_reductions(m, a, d, data.draw(st.lists(st.sampled_from(NAMES), min_size=3, max_size=3)))


@pytest.mark.parametrize("fill", [0.0, -1e60, 2.5])
def test_logarithm_of_products(spark, fill):
    kw = {"masked": [(0, 1)], "bins": [4], "fill": fill, "default": 1e-200}
    cells = {(0, 0): 1e300, (0, 1): 7.0, (1, 2): -1e200, (2, 2): 1e250}
    m, a = make(spark, 7, 3, cells, **kw), build(7, 3, cells, **kw)
    with np.errstate(divide="ignore"):
        logs = np.ma.array(np.log10(np.abs(a.filled(1.0))), mask=np.ma.getmaskarray(a))
    assert np.isclose(reduce(m, "log10_prod").first()["value"], logs.sum())
    rows = {r["i"]: r["value"] for r in reduce(m, "log10_prod", "row").collect()}
    assert rows.pop(4) is None
    assert all(np.isclose(v, logs[i].sum()) for i, v in rows.items())
    for r in reduce(m, "log10_prod", "diag").collect():
        assert np.isclose(r["value"], logs.diagonal(r["k"]).sum())


def test_documented_values(spark):
    cells = {(i, j): 3 * i + j for i in range(3) for j in range(i, 3)}
    m = make(spark, 3, 2, cells)
    row = lambda name: [r["value"] for r in reduce(m, name, "row").orderBy("i").collect()]
    assert row("min") == [0, 1, 0] and row("max") == [1, 5, 8] and row("sum") == [1, 10, 13] and row("ptp") == [1, 4, 8]
    np.testing.assert_allclose(row("var"), [0.22222222, 2.88888889, 10.88888889])
    one = lambda name: reduce(m, name).first()["value"]
    assert (one("sum"), one("mean"), one("ptp")) == (24, 24 / 9, 8)
    np.testing.assert_allclose((one("var"), one("std")), (7.555555555555555, 2.748737083745107))
    eye = BandMatrix.eye(spark, {"c": 4}, 2).counts().first()
    assert (eye["in_band"], eye["out_band"], eye["unmasked"]) == (10, 6, 16)


def test_masks(spark):
    at = lambda *x: spark.createDataFrame([("c", r, c) for r, c in x], "chrom string, row int, col int")
    m = make(spark, 5, 2, F3 | {(4, 4): 9})
    a = m.add_mask(at((1, 0), (0, 4)))  # one in the lower triangle, one out of the band
    assert {(r["i"], r["k"]) for r in a.get_mask().collect()} == {(0, 1)}
    same(dense(a.unmask(at((0, 1)))), dense(m))
    b = a.mask_bins(spark.createDataFrame([("c", 2)], "chrom string, i int"))
    same(dense(b), build(5, 2, F3 | {(4, 4): 9}, ((0, 1),), (2,)))
    same(dense(b.drop_mask_bins()), dense(a))
    same(dense(b.drop_mask()), build(5, 2, F3 | {(4, 4): 9}, (), (2,)))
    same(dense(b.clear_mask()), dense(m))
    f = b.filled(7.0)
    want = build(5, 2, F3 | {(4, 4): 9}, ((0, 1),), (2,), default=7.0)
    same(dense(f), np.ma.array(want.filled(7.0), mask=np.zeros((5, 5), dtype=bool)))


def test_reads(spark):
    cells = {(0, 0): 2, (0, 2): -3, (3, 4): 4, (2, 3): 5}
    kw = {"masked": ((2, 3),), "bins": (5,), "fill": 0.5, "default": 0.25}
    m, a = make(spark, 7, 3, cells, **kw), build(7, 3, cells, **kw)
    same(dense(m.submatrix(1, 5)), a[1:5, 1:5])
    got = np.ma.masked_all((3, 2))
    for r in m.rectangle(range(0, 6, 2), range(3, 7, 3)).collect():
        if r["value"] is not None:
            got[r["row"] // 2, (r["col"] - 3) // 3] = r["value"]
    same(got, a[0:6:2, 3:7:3])
    q = spark.createDataFrame([("c", 2, 0, 1), ("c", 0, 6, 2), ("c", 3, 2, 3), ("c", 5, 0, 4)], "chrom string, row int, col int, place int")
    assert [r["value"] for r in m.get_values(q).orderBy("place").collect()] == [-3, 0.25, None, None]
    with pytest.raises(Exception, match="index out of range"):
        m.get_values(spark.createDataFrame([("c", 0, 7)], "chrom string, row int, col int")).collect()
    same(vector(m.diag(1), 6, "i"), np.ma.diagonal(a, 1))
    same(vector(m.extract_row(3), 7, "col"), a[3])
    assert [r["col"] for r in m.extract_row(3, False).orderBy("col").collect()] == [1, 2, 3, 4, 5]
    assert vector(m.extract_row(5), 7, "col").mask.all()
    assert {r["i"]: r["values"] for r in m.full_rows().collect()} == {i: [None if x is np.ma.masked else float(x) for x in a[i]] for i in range(7)}
    assert {r["k"]: len(r["values"]) for r in m.diagonals().collect()} == {0: 7, 1: 6, 2: 5}
    w = {(r["start"], r["i"], r["k"]): r["v"] for r in m.windows(3, 2).collect()}
    assert {s for s, _, _ in w} == {0, 2, 4} and w[0, 0, 2] == -3 and w[2, 2, 1] is None and len(w) == 18
    found = {x: m.contains(x).first()["found"] for x in (-3.0, 0.5, 0.25, 5.0)}
    assert found == {-3.0: True, 0.5: True, 0.25: True, 5.0: False}
    for bad in (lambda: m.diag(-1), lambda: m.submatrix(-1, 3), lambda: m.windows(0), lambda: m.rectangle(range(-2, 3), range(2))):
        with pytest.raises(ValueError):
            bad()


def test_writes(spark):
    m = make(spark, 5, 2, F3, ((0, 1),))
    s = m.set_values(spark.createDataFrame([("c", 1, 0, 8.0), ("c", 4, 4, 9.0), ("c", 0, 4, 1.0)], "chrom string, row int, col int, value double"))
    want = build(5, 2, F3 | {(0, 1): 8, (4, 4): 9}, ((0, 1),))
    same(dense(s), want)
    assert {(r["i"], r["k"]): r["v"] for r in s.cells.collect()}[0, 1] == 8.0  # changed under its mask
    same(np.ma.diagonal(dense(m.set_diag(1, 3.0)), 1), np.ma.array([0, 3, 3, 3.0], mask=[1, 0, 0, 0]))
    with pytest.raises(Exception, match="n - k values"):
        m.set_diag(0, spark.createDataFrame([("c", 0, 1.0)], "chrom string, i int, value double")).cells.collect()
    same(dense(m.clip(2, 5)), np.ma.clip(build(5, 2, F3, ((0, 1),)), 2, 5))
    z = dense(make(spark, 5, 2, F3, fill=0.5, default=0.3).normalize())
    a = build(5, 2, F3, fill=0.5, default=0.3)
    for k in (0, 1):
        x = np.diagonal(a, k)
        np.testing.assert_allclose(np.diagonal(z, k), (x - x.mean()) / x.std())
    assert z[0, 4] == 0.3
    assert not np.diagonal(dense(make(spark, 4, 2, {}, fill=2.0).normalize()), 0).any()  # equal values become 0
    assert dense(m.astype("long") / 2.0)[0, 0] == 0.5


def test_construction(spark):
    rows = [("c", 1, 0, 1.0, 1), ("c", 0, 1, 2.0, 2), ("c", 0, 3, 5.0, 3), ("c", 3, 3, 4.0, 4)]
    df = spark.createDataFrame(rows, "chrom string, row int, col int, value double, ord int")
    last = BandMatrix.from_coo(df, 2, how="last", order="ord")
    assert {(r["i"], r["k"]): r["v"] for r in last.cells.collect()} == {(0, 1): 2.0, (3, 0): 4.0} and last.shape() == {"c": (4, 4)}
    assert {(r["i"], r["k"]): r["v"] for r in BandMatrix.from_coo(df, 2, how="sum").cells.collect()}[0, 1] == 3.0
    with pytest.raises(ValueError, match="orders"):
        BandMatrix.from_coo(df, 2)
    with pytest.raises(ValueError):
        BandMatrix.from_coo(df, 0, how="sum")
    with pytest.warns(UserWarning, match="clamped"):
        assert BandMatrix.zeros(spark, {"c": 3}, 9).meta.first()["d"] == 3
    d = BandMatrix.from_dense(spark.createDataFrame([("c", i, [float(3 * i + j) for j in range(3)]) for i in range(3)], "chrom string, i int, values array<double>"), 2)
    same(dense(d), build(3, 2, {(i, j): 3 * i + j for i in range(3) for j in range(i, 3)}))
    b = BandMatrix.from_band(spark.createDataFrame([("c", i, [float(i), 10.0 + i], [i == 1, False]) for i in range(3)], "chrom string, i int, values array<double>, masks array<boolean>"))
    same(dense(b), build(3, 2, {(i, i): i for i in range(3)} | {(0, 1): 10, (1, 2): 11}, ((1, 1),)))
    assert dense(BandMatrix.full(spark, {"c": 3}, 1, 2.5)).sum() == 22.5
    one = BandMatrix.ones(spark, {"c": 1}, 1)
    assert bool(one) and len(one) == 1 and "1x1" in repr(one)
    with pytest.raises(ValueError):
        bool(d)
    assert dense(d.ones_like()).sum() == 9 and dense(d.eye_like()).sum() == 3


def test_equality_and_export(spark):
    m = make(spark, 4, 2, F3, MASK, (3,))
    stored = BandMatrix(m.band().select("chrom", "i", "k", "v").na.fill(0.0).selectExpr("chrom", "i", "k", "v", "false as masked"), m.meta, m.bins).add_mask(spark.createDataFrame([("c", 0, 1), ("c", 2, 2)], "chrom string, row int, col int"))
    assert m.equals(stored).first()["equal"] and not m.equals(m.drop_mask_bins()).first()["equal"] and not m.equals(m.clip(0, 1)).first()["equal"]
    assert hash(m) == hash(make(spark, 4, 2, F3, MASK, (3,)))
    coo = {(r["row"], r["col"]): r["value"] for r in make(spark, 4, 2, F1).tocoo().collect()}
    assert coo == F1
    assert make(spark, 4, 2, F1).tocoo(False).count() == 7
    csr = {r["row"]: (r["cols"], r["data"]) for r in make(spark, 4, 2, F3).tocsr().collect()}
    assert csr[0] == ([0, 1], [1, 5]) and csr[3] == ([3], [4])


def test_operators_and_mask_union(spark):
    x, y = make(spark, 4, 2, F3, ((0, 1),), fill=1.0, default=2.0), make(spark, 4, 2, F1, ((2, 2),), (3,), fill=0.5, default=3.0)
    a, b = build(4, 2, F3, ((0, 1),), fill=1.0, default=2.0), build(4, 2, F1, ((2, 2),), (3,), fill=0.5, default=3.0)
    same(dense(x + y), a + b)
    same(dense(x * 2.0 - y), a * 2.0 - b)
    same(dense(3.0 / x), 3.0 / a)
    same(dense(2.0 ** (-y)), 2.0 ** (-b))
    same(dense(x // y), a // b)
    same(dense(x % y), a % b)
    same(dense(x > y), (a > b).astype(float))
    same(dense(abs(y - x)), abs(b - a))
    q, r = divmod(x, 2.0)
    same(dense(q), a // 2.0)
    same(dense(r), a % 2.0)
    with pytest.raises(Exception, match="different size"):
        dense(x + make(spark, 5, 2, F1))
    with pytest.raises(TypeError):
        x + "a"
    assert numpy_api.call("sum", x).first()["value"] == a.sum()
    with pytest.raises(ValueError):
        numpy_api.call("sum", x, keepdims=True)
    numpy_api.register_array_function(lambda m: m.sum(), "total")
    assert numpy_api.call("total", x).first()["value"] == a.sum()


VALUES = [0.0, 1.0, -1.0, 2.5, -2.5, 0.5, -0.5, 3.0, -7.0, 1e10, float("inf"), float("-inf"), float("nan")]
INTS = [0, 1, -1, 2, -7, 12, 63, 64, 100, -8]
LONG = {"invert", "gcd", "lcm", "bitwise_and", "bitwise_or", "bitwise_xor", "left_shift", "right_shift"}


def test_ufuncs_follow_numpy(spark):
    from pyspark.sql import functions as F

    pairs = [(float(a), float(b)) for a in VALUES for b in VALUES]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "n int, a double, b double")
    ints = [(a, b) for a in INTS for b in INTS]
    di = spark.createDataFrame([(i, *p) for i, p in enumerate(ints)], "n int, a long, b long")
    a, b = (np.array(x) for x in zip(*pairs, strict=True))
    ia, ib = (np.array(x) for x in zip(*ints, strict=True))
    with np.errstate(all="ignore"):
        for kind, frame, names in (("double", df, [n for n in [*UNARY, *BINARY] if n not in LONG]), ("long", di, sorted(LONG))):
            cols = [(UNARY[n](F.col("a")) if n in UNARY else BINARY[n](F.col("a"), F.col("b"))).cast("double").alias(n) for n in names]
            got = frame.select("n", *cols).orderBy("n").toPandas()
            nulls = frame.select("n", *cols).agg(*[F.count_if(F.col(n).isNull()).alias(n) for n in names]).first()
            assert not any(nulls)
            for n in names:
                f = getattr(np, n)
                want = (f(a) if n in UNARY else f(a, b)) if kind == "double" else f(ia) if n in UNARY else f(ia, ib)
                mine = got[n].to_numpy(dtype=float)
                ok = np.ones(len(mine), dtype=bool)
                if n in ("power", "float_power"):
                    ok = ~(((np.abs(a) == 1) & ~np.isfinite(b)) | (a == 1) | (b == 0))  # Java has NaN where NumPy has 1
                if n in ("floor_divide", "remainder", "mod"):
                    ok = np.isfinite(a) & np.isfinite(b) & (np.abs(a) < 1e9)
                if n in ("left_shift", "right_shift"):
                    ok = ib >= 0
                np.testing.assert_allclose(mine[ok], want.astype(float)[ok], rtol=1e-9, atol=1e-12, err_msg=n)


def test_indices_out_of_range_raise(spark):
    m = BandMatrix.zeros(spark, {"c": 4}, 2)
    for row, col in ((-1, 0), (0, -1), (4, 0), (3, 4), (9, 9)):
        at = spark.createDataFrame([("c", row, col, 5.0)], "chrom string, row int, col int, value double")
        with pytest.raises(Exception, match="index out of range"):
            m.set_values(at).cells.collect()
        for n in (4, {"c": 4}, spark.createDataFrame([("c", 4)], "chrom string, n long")):
            with pytest.raises(Exception, match="index out of range"):
                BandMatrix.from_coo(at, 2, n, how="sum").cells.collect()
    unknown = spark.createDataFrame([("x", 0, 0, 5.0)], "chrom string, row int, col int, value double")
    with pytest.raises(Exception, match="index out of range"):
        m.set_values(unknown).cells.collect()
    far = spark.createDataFrame([("c", 0, 3, 5.0), ("c", 3, 3, 2.0), ("c", 1, 0, 3.0)], "chrom string, row int, col int, value double")
    assert sorted((r["i"], r["k"], r["v"]) for r in m.set_values(far).cells.collect()) == [(0, 1, 3.0), (3, 0, 2.0)]
    for k in (-1, 2, 7):
        with pytest.raises(ValueError):
            m.diag(k)
        with pytest.raises(ValueError):
            m.set_diag(k, 1.0)
