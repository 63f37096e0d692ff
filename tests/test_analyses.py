import gzip
import math

import numpy as np
import pytest

from tests.oracle import build, dense, same
from tests.test_matrix import F3, MASK, make
from tessera.operators import BandMatrix, balance, tad
from tessera.sources import readers


def blocks(n, cuts, inside=8.0, outside=1.0, seed=0):
    rng = np.random.default_rng(seed)
    side = np.searchsorted(cuts, np.arange(n), side="right")
    return {(i, j): float((inside if side[i] == side[j] else outside) + rng.random()) for i in range(n) for j in range(i, n)}


def test_diamond_and_gaps_against_dense(spark):
    cells = {k: v for k, v in blocks(15, [7]).items() if 3 not in k and 14 not in k}
    for kw in ({}, {"masked": ((4, 5), (5, 7)), "bins": (9,), "default": 0.5}):
        for w, d in ((3, 6), (3, 4), (2, 15)):
            m, a = make(spark, 15, d, cells, **kw), build(15, d, cells, **kw)
            got = {r["i"]: r["mean_cf"] for r in tad.diamond_mean(m, w).collect()}
            gaps = {r["i"] for r in tad.gap_bins(m, w).collect()}
            for b in range(15):
                part = a[max(0, b - w + 1) : b + 1, b + 1 : min(b + w, 14) + 1].compressed()
                want = 0.0 if b == 14 else part.mean() if len(part) else None
                assert got[b] == want if want is None else math.isclose(got[b], want, abs_tol=1e-12), (kw, w, d, b)
                row = a[b, max(0, b - w) : min(b + w, 15)].compressed()
                assert (b in gaps) == (row.sum() == 0 if len(row) else True), (kw, w, d, b)


def test_runs(spark):
    df = spark.createDataFrame([("c", i) for i in (0, 1, 2, 5, 7, 8)] + [("d", 3)], "chrom string, i int")
    got = sorted((r["chrom"], r["start"], r["end"]) for r in tad.runs(df, 1).collect())
    assert got == [("c", 0, 3), ("c", 7, 9)]
    assert sorted((r["chrom"], r["start"], r["end"]) for r in tad.runs(df, 0).collect()) == [("c", 0, 3), ("c", 5, 6), ("c", 7, 9), ("d", 3, 4)]


def test_change_points_and_extremes():
    y = np.array([5.0, 4, 3, 2, 1, 2, 3, 4, 5, 4, 3, 2, 1, 2, 3])
    ext = tad.local_extremes(y)
    assert ext[4] == -1 and ext[8] == 1 and ext[12] == -1 and np.abs(ext).sum() == 3
    assert tad.local_extremes(np.array([2.0, 1.0, 3.0])).tolist() == [0, -1, 1]
    assert not tad.local_extremes(np.full(8, 2.0)).any()
    cp = tad.change_points(np.arange(5.0), np.array([0.0, 1, 2, 1, 0]))
    assert cp[0] == 0 and cp[-1] == 4 and 2 in cp


def test_rank_sum():
    x, y = np.array([1.0, 2, 3, 2]), np.array([4.0, 5, 2, 6, 7])
    ranks = {1: 1, 2: 3, 3: 5, 4: 6, 5: 7, 6: 8, 7: 9}
    z = (sum(ranks[int(v)] for v in x) - 4 * 10 / 2) / math.sqrt(4 * 5 * 10 / 12)
    assert math.isclose(tad.rank_sum_p(x, y), 0.5 * (1 + math.erf(z / math.sqrt(2))))
    assert tad.rank_sum_p(np.append(x, np.nan), y) == tad.rank_sum_p(x, y)
    assert tad.rank_sum_p(np.array([]), y) == 1.0


def test_p_values_against_dense(spark):
    n, w = 24, 4
    cells = blocks(n, [8, 16])
    m, a = make(spark, n, 2 * w, cells), build(n, 2 * w, cells)
    labels = spark.createDataFrame([("c", b, -1.0, 0, n) for b in (3, 7, 15, n - 1)], "chrom string, i int, local_ext double, start int, end int")
    got = {r["i"]: r["pvalue"] for r in tad.p_values(m, labels, w).collect()}
    z = np.full((n, n), np.nan)
    for k in range(2 * w):
        d = np.ma.diagonal(a, k)
        for i in range(n - k):
            z[i, i + k] = (d[i] - d.mean()) / d.std()
    assert set(got) == {3, 7, 15}
    for b, p in got.items():
        across = [z[i, j] for i in range(max(0, b - w + 1), b + 1) for j in range(b + 1, min(b + w, n - 1) + 1)]
        side = [z[i, j] for i in range(max(0, b - w), b + 1) for j in range(i + 1, b + 1)] + [z[i, j] for i in range(b + 1, min(b + w, n - 1) + 1) for j in range(i + 1, min(b + w, n - 1) + 1)]
        assert math.isclose(p, tad.rank_sum_p(np.array(across), np.array(side)), rel_tol=1e-9)
    assert got[7] < 0.05 and got[15] < 0.05 and got[3] > 0.05


def test_domains_of_two_blocks(spark):
    n = 30
    cells = {k: v for k, v in blocks(n, [12]).items() if not any(20 <= x < 24 for x in k)}
    m = make(spark, n, 10, cells)
    domains, bins = tad.call_tad(m, 1000, 4000)
    rows = [(r["from_id"], r["to_id"], r["tag"]) for r in domains.orderBy("from_coord").collect()]
    assert [r for r in rows if r[2] == "gap"] == [(20, 24, "gap")]
    assert any(abs(to - 12) <= 1 for _, to, tag in rows if tag == "domain")
    assert rows[0][0] == 0 and rows[-1][1] == n and all(x[1] == y[0] or y[0] - x[1] <= 1 for x, y in zip(rows, rows[1:], strict=False))
    b = {r["i"]: r for r in bins.collect()}
    assert all(b[i]["local_ext"] == -0.5 for i in range(20, 24)) and b[5]["from_coord"] == 5000 and b[5]["to_coord"] == 6000
    merged = tad.call_tad(m, 1000, 4000, 5000)[0].collect()
    assert {r["tag"] for r in merged} <= {"domain", "gap", "boundary"} and len(merged) <= len(rows)
    for bad in (lambda: tad.call_tad(m, 1000, 500), lambda: tad.call_tad(m, 1000, 4000, 500), lambda: tad.call_tad(m, 1000, 4000, 1.5)):
        with pytest.raises(ValueError):
            bad()


def test_merging_small_domains():
    row = lambda a, b, tag="domain": {"chrom": "c", "from_id": a, "from_coord": a * 10, "to_id": b, "to_coord": b * 10, "tag": tag}
    spans = lambda rows: [(r["from_id"], r["to_id"], r["tag"]) for r in rows]
    means = np.arange(100.0)
    # rising means: the middle joins the next; the last joins the one before
    assert spans(tad.merge_small([row(0, 10), row(10, 20), row(20, 22), row(22, 30), row(30, 32)], means, 5)) == [(0, 10, "domain"), (10, 20, "domain"), (20, 32, "domain")]
    assert spans(tad.merge_small([row(0, 10), row(10, 20), row(20, 22), row(22, 30)], -means, 5)) == [(0, 10, "domain"), (10, 22, "domain"), (22, 30, "domain")]
    # between gaps it stays; beside one it joins the other side
    assert spans(tad.merge_small([row(0, 4, "gap"), row(4, 6), row(6, 9, "gap")], means, 5)) == [(0, 4, "gap"), (4, 6, "domain"), (6, 9, "gap")]
    assert spans(tad.merge_small([row(0, 4, "gap"), row(4, 6), row(6, 20)], means, 5)) == [(0, 4, "gap"), (4, 20, "domain")]
    assert spans(tad.merge_small([row(0, 9), row(9, 20), row(20, 22), row(22, 30, "gap")], means, 5)) == [(0, 9, "domain"), (9, 22, "domain"), (22, 30, "gap")]
    # the first segment takes nothing from its right
    assert spans(tad.merge_small([row(0, 9), row(9, 11), row(11, 20)], -means, 5)) == [(0, 9, "domain"), (9, 20, "domain")]


def test_balancing(spark):
    rng = np.random.default_rng(1)
    n = 8
    cells = {(i, j): float(rng.integers(1, 20)) for i in range(n) for j in range(i, n) if 6 not in (i, j)}
    m = make(spark, n, n, cells)
    a = np.zeros((n, n))
    for (i, j), v in cells.items():
        a[i, j] += v
        a[j, i] += v
    sums = [r["total"] for r in balance.row_sums(m).orderBy("i").collect()]
    np.testing.assert_allclose(sums, a.sum(axis=1))
    keep = np.array([0, 1, 3, 4, 5, 7])
    x = balance.knight_ruiz(balance.symmetric(m).select("row", "col", "v"), keep)
    b = a[np.ix_(keep, keep)]
    np.testing.assert_allclose(x * (b @ x), 1, atol=1e-5)
    assert {r["i"] for r in balance.sparse_bins(m, 1 / n).collect()} == {i for i in range(n) if sums[i] <= sorted(sums)[1]}
    bias, valid = balance.compute_bin_bias(m, "c")
    got = [r["bias"] for r in bias.orderBy("i").collect()]
    assert got[6] == -1.0 and valid
    kept = np.array([i for i in range(n) if got[i] != -1])
    values = np.array(got)[kept]
    assert math.isclose(values.mean(), 1.0)
    scaled = a[np.ix_(kept, kept)] / np.outer(values, values)
    np.testing.assert_allclose(scaled.sum(axis=1) / scaled.sum(axis=1).mean(), 1, atol=1e-4)
    with pytest.raises(ValueError):
        balance.compute_bin_bias(make(spark, 3, 2, {(0, 0): 0}), "c")


def test_round_trips(spark, tmp_path):
    m = make(spark, 4, 2, F3, MASK, (3,), fill=0.0, default=0.0)
    readers.save(m, f"file://{tmp_path}/m")
    same(dense(readers.load(spark, f"file://{tmp_path}/m")), build(4, 2, F3, MASK, (3,)))
    readers.save_npz(m, "c", f"{tmp_path}/c.npz")
    z = np.load(f"{tmp_path}/c.npz", allow_pickle=True)
    assert z["data"].shape == (4, 2) and z["mask"][3, 1] and z["mask"][0, 1] and z["mask_row_col"].tolist() == [False, False, False, True]
    same(dense(readers.load_npz(spark, f"file://{tmp_path}/c.npz")), build(4, 2, F3, MASK, (3,)))
    readers.save_npz(make(spark, 4, 2, F3), "c", f"{tmp_path}/d.npz")
    same(dense(readers.load_npz(spark, f"file://{tmp_path}/d.npz")), build(4, 2, F3))


def test_text_sources(spark, tmp_path):
    with gzip.open(tmp_path / "contacts.gz", "wt") as f:
        f.write("chr1 5 25 2\nchr1 27 3 3\nchrM 1 1 9\n1 10 10 4\nchr2\t0  0\t1\n")
    m = readers.read_contacts(spark, f"file://{tmp_path}/contacts.gz", 10, 3)
    assert {(r["chrom"], r["i"], r["k"]): r["v"] for r in m.cells.collect()} == {("1", 0, 2): 5.0, ("1", 1, 0): 4.0, ("2", 0, 0): 1.0}
    with gzip.open(tmp_path / "frags.gz", "wt") as f:
        f.write("chr1 0 5 1\nchr1 0 15 1\nchr2 0 5 1\n")
    with gzip.open(tmp_path / "inter.gz", "wt") as f:
        f.write("chr1 5 chr1 15 2\nchr2 5 chr1 15 7\nchr1 15 chr1 5 1\n")
    frags = readers.read_fragments(spark, f"file://{tmp_path}/frags.gz")
    m = readers.read_interactions(spark, f"file://{tmp_path}/inter.gz", frags, 3)
    assert {(r["i"], r["k"]): r["v"] for r in m.cells.collect()} == {(0, 1): 3.0, (1, 1): 7.0} and len(m) == 3
    bias = spark.createDataFrame([("genome", i, 1.0 + i) for i in range(3)], "chrom string, i int, bias double")
    readers.write_bias(bias, frags, f"file://{tmp_path}/bias")
    lines = [x for p in sorted((tmp_path / "bias").glob("*.gz")) for x in gzip.open(p, "rt").read().split("\n") if x]
    assert lines == ["chr1\t5\t1.0", "chr1\t15\t2.0", "chr2\t5\t3.0"]


def test_pixels(spark):
    bins = spark.createDataFrame([(0, "1", 0.5), (1, "1", 2.0), (2, "1", None), (3, "2", 1.0)], "bin long, chrom string, weight double")
    pixels = spark.createDataFrame([(0, 1, 4.0), (1, 1, 3.0), (0, 2, 9.0), (1, 3, 5.0), (3, 3, 6.0)], "bin1 long, bin2 long, count double")
    m = readers.from_pixels(pixels, bins, 2)
    assert {(r["chrom"], r["i"], r["k"]): r["v"] for r in m.cells.collect()} == {("1", 0, 1): 4.0, ("1", 1, 0): 12.0, ("2", 0, 0): 6.0}
    assert [(r["chrom"], r["i"]) for r in m.bins.collect()] == [("1", 2)]
    raw = readers.from_pixels(pixels, bins, 3, balance=False)
    assert {(r["chrom"], r["i"], r["k"]): r["v"] for r in raw.cells.where("chrom = '1'").collect()}[("1", 0, 2)] == 9.0
    assert raw.shape() == {"1": (3, 3), "2": (1, 1)} and isinstance(raw, BandMatrix)


def test_extremes_follow_the_rule_segment_by_segment():
    rng = np.random.default_rng(3)
    seen = 0
    for _ in range(200):
        n = int(rng.integers(4, 60))
        means = np.round(np.cumsum(rng.normal(size=n)), int(rng.integers(0, 3)))
        got = tad.local_extremes(means)
        y = tad._rescaled(means)
        cp = tad.change_points(tad._rescaled(np.arange(n, dtype=float)), y)
        want = {}
        if 2 < len(cp) < n:
            for p in cp[1:-1]:
                if y[p] >= max(y[p - 1], y[p + 1]):
                    want[p] = 1
                elif y[p] < min(y[p - 1], y[p + 1]):
                    want[p] = -1
            for a, b in list(zip(cp, cp[1:], strict=False))[:-1]:
                low, high = min(range(a, b), key=lambda i: (y[i], i)), min(range(a, b), key=lambda i: (-y[i], i))
                if y[low] < min(y[a], y[b]):
                    want[low] = -1
                if y[high] > max(y[a], y[b]):
                    want[high] = 1
        assert {i: v for i, v in enumerate(got) if v} == want
        seen += len(want)
    assert seen > 500


def test_equilibrate_dense():
    rng = np.random.default_rng(4)
    for n in (1, 2, 7, 60):
        a = rng.random((n, n)) * 10 ** rng.integers(-3, 4, (n, 1)).astype(float)
        a = a + a.T + np.eye(n)
        x = balance.equilibrate(lambda p, a=a: a @ p, n)
        np.testing.assert_allclose(x * (a @ x), 1, atol=1e-6)
    with np.errstate(all="ignore"):
        assert not np.isfinite(balance.equilibrate(lambda p: np.array([0.0, p[1]]), 2)).all()
