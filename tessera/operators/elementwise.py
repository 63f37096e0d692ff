"""Applying element-wise functions to matrices, and Python's operators."""

from __future__ import annotations


from pyspark.sql import functions as F

from ..functions.ufuncs import BINARY, UNARY
from .matrix import KEY, BandMatrix


def _masked_by(m: BandMatrix):
    return m.flagged().withColumn("masked", F.col("masked") | F.col("bin_masked")).drop("bin_masked")


def apply(name: str, a: BandMatrix, b: BandMatrix | float | None = None, reverse: bool = False) -> BandMatrix:
    """A ufunc of one matrix, of a matrix and a number, or of two matrices of the same size and band.

    Cells that neither stores have the function of the fills, cells out of the
    band the function of the defaults; a cell is masked if it is in either.
    """
    if b is None:
        if name not in UNARY:
            raise ValueError(f"{name} takes two operands")
        f = UNARY[name]
        return a.map_values(lambda c: f(c))
    g = BINARY[name]
    f = (lambda x, y: g(y, x)) if reverse else g
    if isinstance(b, (int, float)):
        return a.map_values(lambda c: f(c, F.lit(float(b))))
    if not isinstance(b, BandMatrix):
        raise TypeError(f"no operand of type {type(b).__name__}")
    m = a.meta.select("chrom", "n", "d", F.col("band_fill").alias("fa"), F.col("default_value").alias("da")).join(
        b.meta.select("chrom", F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("band_fill").alias("fb"), F.col("default_value").alias("db")), "chrom")
    m = m.withColumn("n", F.when((F.col("n") == F.col("n2")) & (F.col("d") == F.col("d2")), F.col("n")).otherwise(F.raise_error(F.lit("matrices of different size or band"))))
    x = a.cells.select(*KEY, F.col("v").alias("va"), F.col("masked").alias("ma"))
    y = b.cells.select(*KEY, F.col("v").alias("vb"), F.col("masked").alias("mb"))
    both = x.join(y, KEY, "full").join(m.select("chrom", "fa", "fb"), "chrom")
    v = f(F.coalesce("va", "fa"), F.coalesce("vb", "fb")).cast("double")
    cells = both.select(*KEY, v.alias("v"), (F.coalesce("ma", F.lit(False)) | F.coalesce("mb", F.lit(False))).alias("masked"))
    meta = m.select("chrom", "n", "d", f(F.col("fa"), F.col("fb")).cast("double").alias("band_fill"), f(F.col("da"), F.col("db")).cast("double").alias("default_value"))
    return BandMatrix(cells, meta, _either_bins(a, b))


def _either_bins(a: BandMatrix, b: BandMatrix):
    return a.bins if b.bins is None else b.bins if a.bins is None else a.bins.union(b.bins).distinct()


def keep_where(result: BandMatrix, first: BandMatrix, where: BandMatrix) -> BandMatrix:
    """``result`` in the band's cells where ``where`` is not 0, the values of ``first`` in the others.

    NumPy leaves the others undefined; here they keep the first matrix's value.
    Masked cells of ``where`` are masked; the default out of the band is the result's.
    """
    r = result.cells.select(*KEY, F.col("v").alias("vr"), F.col("masked").alias("mr"))
    w = where.cells.select(*KEY, F.col("v").alias("w"), F.col("masked").alias("mw"))
    cells = r.join(first.cells.select(*KEY, F.col("v").alias("vf")), KEY, "full").join(w, KEY, "full")
    fills = result.meta.select("chrom", "n", "d", F.col("band_fill").alias("fr"), "default_value")
    for m, name in ((first, "ff"), (where, "fw")):
        fills = fills.join(m.meta.select("chrom", F.col("n").alias("n2"), F.col("d").alias("d2"), F.col("band_fill").alias(name)), "chrom")
        fills = fills.withColumn("n", F.when((F.col("n") == F.col("n2")) & (F.col("d") == F.col("d2")), F.col("n")).otherwise(F.raise_error(F.lit("matrices of different size or band")))).drop("n2", "d2")
    choose = lambda w, x, y: F.when(w != 0, x).otherwise(y)
    v = choose(F.coalesce("w", "fw"), F.coalesce("vr", "fr"), F.coalesce("vf", "ff"))
    cells = cells.join(fills.select("chrom", "fr", "ff", "fw"), "chrom")
    cells = cells.select(*KEY, v.alias("v"), (F.coalesce("mr", F.lit(False)) | F.coalesce("mw", F.lit(False))).alias("masked"))
    meta = fills.select("chrom", "n", "d", choose(F.col("fw"), F.col("fr"), F.col("ff")).alias("band_fill"), "default_value")
    return BandMatrix(cells, meta, _either_bins(result, where))


def divmod_(a: BandMatrix, b: BandMatrix | float) -> tuple[BandMatrix, BandMatrix]:
    return apply("floor_divide", a, b), apply("remainder", a, b)


def _install() -> None:
    """Methods under every function's name, and operators."""
    for name in UNARY:
        setattr(BandMatrix, name, lambda self, _n=name: apply(_n, self))
    for name in BINARY:
        setattr(BandMatrix, name, lambda self, other, _n=name: apply(_n, self, other))
    BandMatrix.divmod = divmod_
    names = {"add": "add", "sub": "subtract", "mul": "multiply", "truediv": "divide", "floordiv": "floor_divide", "mod": "remainder", "pow": "power", "and": "bitwise_and", "or": "bitwise_or", "xor": "bitwise_xor", "lshift": "left_shift", "rshift": "right_shift"}
    for op, name in names.items():
        setattr(BandMatrix, f"__{op}__", lambda self, other, _n=name: apply(_n, self, other))
        setattr(BandMatrix, f"__r{op}__", lambda self, other, _n=name: apply(_n, self, other, reverse=True))
    for op, name in {"lt": "less", "le": "less_equal", "gt": "greater", "ge": "greater_equal", "eq": "equal", "ne": "not_equal"}.items():
        setattr(BandMatrix, f"__{op}__", lambda self, other, _n=name: apply(_n, self, other))
    for op, name in {"neg": "negative", "pos": "positive", "abs": "absolute", "invert": "invert"}.items():
        setattr(BandMatrix, f"__{op}__", lambda self, _n=name: apply(_n, self))
    BandMatrix.__divmod__ = divmod_
    BandMatrix.__hash__ = lambda self: hash(tuple(sorted((r["chrom"], r["hash"]) for r in self.digest().collect())))
    from .reductions import reduce

    for name in ("sum", "prod", "min", "max", "ptp", "mean", "var", "std", "all", "any"):
        setattr(BandMatrix, name, lambda self, axis=None, banded_only=False, _n=name: reduce(self, _n, axis, banded_only))


_install()
