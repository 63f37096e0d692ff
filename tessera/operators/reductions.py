"""Reductions over all cells, rows (equal to columns) and diagonals.

One shuffle aggregates the stored cells; cells that are not stored enter by
closed-form counts times their value and are never made.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ufuncs import UNARY
from .matrix import BandMatrix, in_band, row_span

_PARTS = ("n_stored", "s", "s2", "lo", "hi", "p", "l", "a", "o")


def _log10(c: Column) -> Column:
    """Of the magnitude; -inf for 0."""
    return UNARY["log10"](F.abs(c))


def _stored(cells: DataFrame, by: list[str]) -> DataFrame:
    """Partial results of unmasked stored cells, and n_seen: stored cells outside masked bins, masked themselves or not."""
    v = F.when(~F.col("masked"), F.col("v").cast("double"))
    return cells.where("not bin_masked").groupBy(*by).agg(
        F.count("*").alias("n_seen"), F.count(v).alias("n_stored"), F.sum(v).alias("s"), F.sum(v * v).alias("s2"), F.min(v).alias("lo"), F.max(v).alias("hi"),
        F.product(v).alias("p"), F.sum(_log10(v)).alias("l"), F.min(v != 0).alias("a"), F.max(v != 0).alias("o"),
    )


def _power(base: Column, n: Column) -> Column:
    return F.when(n > 0, F.pow(base, n.cast("double"))).otherwise(1.0)


def _finish(df: DataFrame, keys: list[str]) -> DataFrame:
    """Join stored results with n_implicit cells of band_fill and n_out cells of default_value."""
    imp, out, fill, default = F.col("n_implicit"), F.col("n_out"), F.col("band_fill"), F.col("default_value")
    have = lambda c, n: F.when(n > 0, c)
    count = F.coalesce("n_stored", F.lit(0)) + imp + out
    total = lambda stored, f, d: F.coalesce(stored, F.lit(0.0)) + F.when(imp > 0, imp * f).otherwise(0.0) + F.when(out > 0, out * d).otherwise(0.0)
    return df.select(
        *keys, "n_implicit", "n_out", "band_fill", "default_value", count.alias("count"),
        F.when(count > 0, total(F.col("s"), fill, default)).alias("sum"),
        F.when(count > 0, total(F.col("s2"), fill * fill, default * default)).alias("sumsq"),
        F.least("lo", have(fill, imp), have(default, out)).alias("min"),
        F.greatest("hi", have(fill, imp), have(default, out)).alias("max"),
        F.when(count > 0, F.coalesce("p", F.lit(1.0)) * _power(fill, imp) * _power(default, out)).alias("prod"),
        F.when(count > 0, total(F.col("l"), _log10(fill), _log10(default))).alias("log10_prod"),
        F.when(count > 0, F.coalesce("a", F.lit(True)) & ((imp == 0) | (fill != 0)) & ((out == 0) | (default != 0))).alias("all"),
        F.when(count > 0, F.coalesce("o", F.lit(False)) | ((imp > 0) & (fill != 0)) | ((out > 0) & (default != 0))).alias("any"),
    )


def stats(m: BandMatrix, axis: str | None) -> DataFrame:
    """Keys (chrom, and i or k), counts and every partial result: count, sum, sumsq, min, max, prod, log10_prod, all, any."""
    axis = {0: "row", 1: "row", "col": "row"}.get(axis, axis)
    if axis == "row":
        return _rows(m)
    if axis == "diag":
        return _diagonals(m)
    if axis is None:
        return _whole(m)
    raise ValueError(f"no axis {axis!r}")


def _diagonals(m: BandMatrix) -> DataFrame:
    stored = _stored(m.flagged(), ["chrom", "k"])
    every = m.meta.withColumn("k", F.explode(F.sequence(F.lit(0), (F.col("d") - 1).cast("int"))))
    out = every.join(stored, ["chrom", "k"], "left").join(m.touched(), ["chrom", "k"], "left")
    free = F.col("n") - F.col("k") - F.coalesce("touched", F.lit(0)) - F.coalesce("n_seen", F.lit(0))
    return _finish(out.withColumn("n_implicit", free).withColumn("n_out", F.lit(0).cast("long")), ["chrom", "k"])


def _whole(m: BandMatrix) -> DataFrame:
    twice = m.flagged().withColumn("t", F.explode(F.when(F.col("k") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
    stored = _stored(twice, ["chrom"])
    t = m.touched().groupBy("chrom").agg(F.sum(F.when(F.col("k") == 0, F.col("touched")).otherwise(2 * F.col("touched"))).alias("t"))
    r = m.get_mask_bins().groupBy("chrom").agg(F.count("*").alias("r"))
    out = m.meta.join(stored, "chrom", "left").join(t, "chrom", "left").join(r, "chrom", "left").fillna(0, ["t", "r", "n_seen"])
    free_in = in_band(F.col("n"), F.col("d")) - F.col("t")
    free_out = (F.col("n") - F.col("r")) * (F.col("n") - F.col("r")) - free_in
    return _finish(out.withColumn("n_implicit", free_in - F.col("n_seen")).withColumn("n_out", free_out), ["chrom"])


def _rows(m: BandMatrix) -> DataFrame:
    c = m.flagged()
    ends = c.withColumn("i", F.explode(F.when(F.col("k") == 0, F.array("i")).otherwise(F.array(F.col("i"), F.col("i") + F.col("k")))))
    stored = _stored(ends, ["chrom", "i"])
    rows = m.rows()
    if m.bins is None:
        rows = rows.withColumn("r", F.lit(0)).withColumn("near", F.lit(0)).withColumn("own", F.lit(False))
    else:
        b = m.bins.join(m.meta.select("chrom", "n", "d"), "chrom")
        # a masked bin is within the band of rows b - d + 1 to b + d - 1
        steps = b.select("chrom", F.greatest(F.lit(0), F.col("i") - F.col("d") + 1).cast("int").alias("i"), F.lit(1).alias("step")).union(
            b.where(F.col("i") + F.col("d") < F.col("n")).select("chrom", (F.col("i") + F.col("d")).cast("int").alias("i"), F.lit(-1).alias("step"))
        )
        steps = steps.groupBy("chrom", "i").agg(F.sum("step").alias("step"))
        own = m.bins.select("chrom", "i", F.lit(True).alias("own"))
        total = m.bins.groupBy("chrom").agg(F.count("*").alias("r"))
        rows = rows.join(steps, ["chrom", "i"], "left").join(own, ["chrom", "i"], "left").join(total, "chrom", "left")
        rows = rows.withColumn("near", F.sum(F.coalesce("step", F.lit(0))).over(Window.partitionBy("chrom").orderBy("i"))).fillna(0, ["r"]).fillna(False, ["own"])
    out = rows.join(stored, ["chrom", "i"], "left")
    span = row_span(F.col("n"), F.col("d"), F.col("i"))
    free = lambda c: F.when(F.col("own"), F.lit(0)).otherwise(c).cast("long")
    out = out.withColumn("n_implicit", free(span - F.col("near") - F.coalesce("n_seen", F.lit(0)))).withColumn("n_out", free(F.col("n") - span - (F.col("r") - F.col("near"))))
    return _finish(out, ["chrom", "i"])


_VALUES: dict[str, Callable[[], Column]] = {
    "sum": lambda: F.col("sum"),
    "prod": lambda: F.col("prod"),
    "log10_prod": lambda: F.col("log10_prod"),
    "min": lambda: F.col("min"),
    "max": lambda: F.col("max"),
    "ptp": lambda: F.col("max") - F.col("min"),
    "mean": lambda: F.col("sum") / F.col("count"),
    "var": lambda: F.greatest(F.lit(0.0), F.col("sumsq") / F.col("count") - F.pow(F.col("sum") / F.col("count"), F.lit(2.0))),
    "std": lambda: F.sqrt(_VALUES["var"]()),
    "all": lambda: F.col("all"),
    "any": lambda: F.col("any"),
}


def register(name: str, value: Callable[[], Column]) -> None:
    """Add a reduction: an expression of count, sum, sumsq, min, max, prod, log10_prod, all and any."""
    _VALUES[name] = value


def reduce(m: BandMatrix, name: str, axis: str | int | None = None, banded_only: bool = False) -> DataFrame:
    """(chrom[, i or k], value) of a reduction; NULL where every cell is masked.

    axis: None for all cells, "row", "col", 0 or 1 for rows, "diag". Cells out
    of the band count with the default for None and rows, unless ``banded_only``.
    "prod" is a double, infinite or 0 beyond its range as in NumPy; "log10_prod",
    the logarithm of the product's magnitude, is summed cell by cell and has no such limit.
    """
    s = stats(m, axis)
    if banded_only:
        s = _in_band_only(m, axis)
    keys = [c for c in ("chrom", "i", "k") if c in s.columns]
    value = F.when(F.col("count") > 0, _VALUES[name]())
    return s.select(*keys, value.alias("value"))


def _in_band_only(m: BandMatrix, axis) -> DataFrame:
    """Partial results with no cell out of the band: as if every matrix ended there."""
    axis = {0: "row", 1: "row", "col": "row"}.get(axis, axis)
    if axis == "diag":
        return _diagonals(m)
    if axis is None:
        d = m.band().where("v is not null").withColumn("t", F.explode(F.when(F.col("k") == 0, F.array(F.lit(0))).otherwise(F.array(F.lit(0), F.lit(1)))))
        by = ["chrom"]
    else:
        d = m.band().where("v is not null").withColumn("i", F.explode(F.when(F.col("k") == 0, F.array("i")).otherwise(F.array(F.col("i"), F.col("i") + F.col("k")))))
        by = ["chrom", "i"]
    own = _stored(d.withColumn("masked", F.lit(False)).withColumn("bin_masked", F.lit(False)), by)
    every = m.meta if axis is None else m.rows()
    none = F.lit(0).cast("long")
    return _finish(every.join(own, by, "left").withColumn("n_implicit", none).withColumn("n_out", none), by)
