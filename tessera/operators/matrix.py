"""Symmetric banded matrices as three relations.

``cells(chrom, i, k, v, masked)``: stored upper-triangle cells, column i + k, 0 <= k < d, i + k < n.
``bins(chrom, i)``: masked bins. ``meta(chrom, n, d, band_fill, default_value)``: one row for each matrix;
``band_fill`` is the value of in-band cells that are not stored, ``default_value`` of all cells out of the band.
NULL stands for masked and for nothing else. Every operation returns a new matrix.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["chrom", "i", "k"]


def in_band(n: Column, d: Column) -> Column:
    """Cells of both triangles within the band."""
    return n * n - (n - d) * (n - d + 1)


def row_span(n: Column, d: Column, i: Column) -> Column:
    """In-band cells of row i."""
    return F.least(n, i + d) - F.greatest(F.lit(0), i - d + 1)


def make_meta(spark: SparkSession, sizes: dict[str, int], d: int, band_fill: float, default_value: float) -> DataFrame:
    if d < 1:
        raise ValueError("diag_num must be 1 or more")
    if not isinstance(default_value, (int, float)):
        raise ValueError("default_value must be a number")
    for chrom, n in sizes.items():
        if d > n:
            warnings.warn(f"diag_num {d} is larger than {n}, the size of {chrom}; it is clamped", stacklevel=3)
    rows = [(c, int(n), min(d, int(n)), float(band_fill), float(default_value)) for c, n in sizes.items()]
    return local(spark.createDataFrame(rows, "chrom string, n long, d long, band_fill double, default_value double"))


def local(df: DataFrame) -> DataFrame:
    """A table of one row for each matrix as literal rows: found by one job, where a plan over the source would read it again at every use."""
    return df.sparkSession.createDataFrame(df.toArrow(), df.schema)  # from Arrow it is a local relation, whose size the planner knows


@dataclass(frozen=True)
class BandMatrix:
    cells: DataFrame
    meta: DataFrame
    bins: DataFrame | None = None

    # ---- construction -------------------------------------------------------------------------------------------

    @staticmethod
    def from_coo(df: DataFrame, d: int, n: DataFrame | dict[str, int] | int | None = None, default_value: float = 0.0, how: str = "last", order: str | None = None) -> BandMatrix:
        """``df(chrom, row, col, value)``; lower-triangle entries are mirrored, entries out of the band dropped.

        how: of duplicates, the "last" by the column ``order`` (needed for it), or their "sum". n: a size for all
        matrices, ``(chrom, n)``, or None for the largest index + 1; the sizes are collected by one job, or by none
        if ``n`` is a dict of them, which spares a pass over the source. Entries with an index outside 0 to n - 1
        raise; so do those of a matrix that given sizes don't name.
        """
        if d < 1:
            raise ValueError("diag_num must be 1 or more")
        i, k = F.least("row", "col").cast("int"), F.abs(F.col("row") - F.col("col")).cast("int")
        if how == "last" and order is None:
            raise ValueError("'last' needs a column that orders the input; distributed rows have no order of their own")
        value = F.sum("value") if how == "sum" else F.max_by("value", order)
        if isinstance(n, dict):
            meta = make_meta(df.sparkSession, n, d, default_value, default_value)
        else:
            if n is None:
                sizes = df.groupBy("chrom").agg((F.max(F.greatest("row", "col")) + 1).cast("long").alias("n"))
            elif isinstance(n, int):
                sizes = df.select("chrom").distinct().withColumn("n", F.lit(n).cast("long"))
            else:
                sizes = n.select("chrom", F.col("n").cast("long").alias("n"))
            meta = local(sizes.select("chrom", "n", F.least(F.lit(d).cast("long"), "n").alias("d"), F.lit(float(default_value)).alias("band_fill"), F.lit(float(default_value)).alias("default_value")))
        if n is None or isinstance(n, int):
            size, rows = F.lit(n) if n is not None else F.lit(2**62), df
        else:
            size, rows = F.coalesce("_size", F.lit(0)), df.join(F.broadcast(meta.select("chrom", F.col("n").alias("_size"))), "chrom", "left")
        bad = (F.least("row", "col") < 0) | (F.greatest("row", "col") >= size)
        near = F.abs(F.col("row") - F.col("col")) < d
        cells = rows.where(F.when(bad, F.raise_error(F.lit("index out of range")).cast("boolean")).otherwise(near)).select("chrom", i.alias("i"), k.alias("k"), *(["value"] if how == "sum" else ["value", order]))
        cells = cells.groupBy(*KEY).agg(value.alias("v")).withColumn("masked", F.lit(False))
        return BandMatrix(cells, meta)

    @staticmethod
    def from_dense(df: DataFrame, d: int, default_value: float = 0.0) -> BandMatrix:
        """``df(chrom, i, values)``: rows of square matrices; only the upper triangle is used."""
        long = df.select("chrom", "i", F.size("values").alias("n"), F.posexplode("values").alias("j", "v"))
        sizes = df.groupBy("chrom").agg(F.max(F.size("values")).cast("long").alias("n"))
        k = (F.col("j") - F.col("i")).cast("int")
        cells = long.where((F.col("j") >= F.col("i")) & (k < d)).select("chrom", F.col("i").cast("int").alias("i"), k.alias("k"), "v", F.lit(False).alias("masked"))
        meta = sizes.select("chrom", "n", F.least(F.lit(d).cast("long"), "n").alias("d"), F.lit(float(default_value)).alias("band_fill"), F.lit(float(default_value)).alias("default_value"))
        return BandMatrix(cells, local(meta))

    @staticmethod
    def from_band(df: DataFrame, default_value: float = 0.0) -> BandMatrix:
        """``df(chrom, i, values[, masks])``: row i of the band, diagonal k at position k; padding is dropped."""
        sizes = local(df.groupBy("chrom").agg(F.count("*").alias("n"), F.max(F.size("values")).cast("long").alias("d")))
        cols = [F.arrays_zip("values", "masks").alias("z")] if "masks" in df.columns else [F.transform("values", lambda x: F.struct(x.alias("values"), F.lit(False).alias("masks"))).alias("z")]
        long = df.select("chrom", "i", *cols).select("chrom", "i", F.posexplode("z").alias("k", "z")).join(sizes, "chrom")
        cells = long.where(F.col("i") + F.col("k") < F.col("n")).select("chrom", F.col("i").cast("int").alias("i"), F.col("k").cast("int").alias("k"), F.col("z.values").alias("v"), F.coalesce("z.masks", F.lit(False)).alias("masked"))
        meta = sizes.select("chrom", "n", "d", F.lit(float(default_value)).alias("band_fill"), F.lit(float(default_value)).alias("default_value"))
        return BandMatrix(cells, meta)

    @staticmethod
    def full(spark: SparkSession, sizes: dict[str, int], d: int = 1, fill: float = 0.0) -> BandMatrix:
        """No stored cell; every value is the fill."""
        return BandMatrix(spark.createDataFrame([], "chrom string, i int, k int, v double, masked boolean"), make_meta(spark, sizes, d, fill, fill))

    @staticmethod
    def zeros(spark: SparkSession, sizes: dict[str, int], d: int = 1) -> BandMatrix:
        return BandMatrix.full(spark, sizes, d, 0.0)

    @staticmethod
    def ones(spark: SparkSession, sizes: dict[str, int], d: int = 1) -> BandMatrix:
        return BandMatrix.full(spark, sizes, d, 1.0)

    @staticmethod
    def eye(spark: SparkSession, sizes: dict[str, int], d: int = 1) -> BandMatrix:
        return BandMatrix.zeros(spark, sizes, d).set_diag(0, 1.0)

    def full_like(self, fill: float) -> BandMatrix:
        """Same sizes and band, no masks."""
        meta = self.meta.withColumn("band_fill", F.lit(float(fill))).withColumn("default_value", F.lit(float(fill)))
        return BandMatrix(self.cells.where(F.lit(False)), meta)

    def zeros_like(self) -> BandMatrix:
        return self.full_like(0.0)

    def ones_like(self) -> BandMatrix:
        return self.full_like(1.0)

    def eye_like(self) -> BandMatrix:
        return self.zeros_like().set_diag(0, 1.0)

    # ---- shared views -------------------------------------------------------------------------------------------

    def rows(self) -> DataFrame:
        """(chrom, i) of every row with its matrix's meta, spread over tasks."""
        return self.meta.withColumn("i", F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int")))).repartition("chrom", "i")

    def flagged(self, cells: DataFrame | None = None) -> DataFrame:
        """Stored cells with ``bin_masked``: whether either of their bins is masked."""
        c = self.cells if cells is None else cells
        if self.bins is None:
            return c.withColumn("bin_masked", F.lit(False))
        b = self.bins.select("chrom", F.col("i").alias("b")).distinct()
        left = b.select("chrom", F.col("b").alias("i"), F.lit(True).alias("hit_i"))
        right = b.select("chrom", F.col("b").alias("j"), F.lit(True).alias("hit_j"))
        out = c.withColumn("j", F.col("i") + F.col("k")).join(left, ["chrom", "i"], "left").join(right, ["chrom", "j"], "left")
        return out.withColumn("bin_masked", F.col("hit_i").isNotNull() | F.col("hit_j").isNotNull()).drop("j", "hit_i", "hit_j")

    def band(self) -> DataFrame:
        """Every in-band upper-triangle cell: chrom, i, k, v (NULL if masked), n, d; costs n * d rows."""
        every = self.rows().withColumn("k", F.explode(F.sequence(F.lit(0), (F.least("d", F.col("n") - F.col("i")) - 1).cast("int"))))
        all_cells = self.flagged(every.join(self.cells, KEY, "left"))
        return all_cells.select("chrom", "i", "k", F.when(F.coalesce("masked", F.lit(False)) | F.col("bin_masked"), None).otherwise(F.coalesce("v", "band_fill")).alias("v"), "n", "d")

    def _with(self, cells: DataFrame) -> BandMatrix:
        return replace(self, cells=cells.select("chrom", "i", "k", "v", "masked"))

    # ---- masks --------------------------------------------------------------------------------------------------

    def _at(self, at: DataFrame) -> DataFrame:
        """``at(chrom, row, col)`` as distinct in-band cells."""
        where = at.select("chrom", F.least("row", "col").cast("int").alias("i"), F.abs(F.col("row") - F.col("col")).cast("int").alias("k")).distinct()
        return where.join(self.meta, "chrom").where((F.col("k") < F.col("d")) & (F.col("i") >= 0) & (F.col("i") + F.col("k") < F.col("n")))

    def add_mask(self, at: DataFrame) -> BandMatrix:
        """Mask cells ``at(chrom, row, col)``, given in either triangle; out-of-band ones are ignored. Unstored ones become stored."""
        hit = self._at(at).select(*KEY, "band_fill", F.lit(True).alias("hit"))
        out = self.cells.join(hit, KEY, "full")
        return self._with(out.select(*KEY, F.coalesce("v", F.col("band_fill")).alias("v"), (F.coalesce("masked", F.lit(False)) | F.coalesce("hit", F.lit(False))).alias("masked")))

    def mask_where(self, condition: Column) -> BandMatrix:
        """Mask the stored and unstored in-band cells where a condition on i, k and n holds."""
        every = self.rows().withColumn("k", F.explode(F.sequence(F.lit(0), (F.least("d", F.col("n") - F.col("i")) - 1).cast("int"))))
        return self.add_mask(every.where(condition).select("chrom", F.col("i").alias("row"), (F.col("i") + F.col("k")).alias("col")))

    def mask_bins(self, bins: DataFrame) -> BandMatrix:
        """Mask whole bins ``(chrom, i)``; replaces the bins masked before. Kept as a relation, never written into cells."""
        return replace(self, bins=bins.select("chrom", F.col("i").cast("int").alias("i")).distinct())

    def unmask(self, at: DataFrame | None = None) -> BandMatrix:
        """Clear the element mask of ``at(chrom, row, col)``; of everything, and the bin mask, without it."""
        if at is None:
            return self.clear_mask()
        hit = self._at(at).select(*KEY, F.lit(True).alias("hit"))
        return self._with(self.cells.join(hit, KEY, "left").withColumn("masked", F.col("masked") & F.col("hit").isNull()))

    def clear_mask(self) -> BandMatrix:
        return BandMatrix(self.cells.withColumn("masked", F.lit(False)), self.meta)

    def drop_mask(self) -> BandMatrix:
        """Drop the element mask; masked bins stay."""
        return replace(self, cells=self.cells.withColumn("masked", F.lit(False)))

    def drop_mask_bins(self) -> BandMatrix:
        """Drop the bin mask; element masks stay."""
        return replace(self, bins=None)

    def get_mask(self) -> DataFrame:
        """(chrom, i, k) of all masked in-band cells, whether by themselves or by a bin."""
        own = self.cells.where("masked").select(*KEY)
        return own if self.bins is None else own.union(self._of_bins().select("chrom", F.col("r").alias("i"), "k")).distinct()

    def get_mask_bins(self) -> DataFrame:
        return self.meta.select("chrom").where(F.lit(False)).withColumn("i", F.lit(0)) if self.bins is None else self.bins

    def touched(self) -> DataFrame:
        """(chrom, k, touched): in-band upper-triangle cells of each diagonal with a masked bin."""
        if self.bins is None:
            return self.meta.select("chrom", F.lit(0).alias("k"), F.lit(0).cast("long").alias("touched")).where(F.lit(False))
        return self._of_bins().groupBy("chrom", "k").agg(F.count("*").alias("touched"))

    def _of_bins(self) -> DataFrame:
        """(chrom, r, k): in-band upper-triangle cells of masked bins."""
        b = self.bins.join(self.meta, "chrom")
        as_left = b.select("chrom", F.col("i").alias("r"), F.explode(F.sequence(F.lit(0), (F.least("d", F.col("n") - F.col("i")) - 1).cast("int"))).alias("k"))
        as_right = b.withColumn("k", F.explode(F.sequence(F.lit(0), F.least(F.col("d") - 1, F.col("i")).cast("int")))).select("chrom", (F.col("i") - F.col("k")).alias("r"), "k")
        return as_left.union(as_right).distinct()

    def _largest(self, column: str) -> float:
        """The largest size, band or fill of the matrices; meta is local rows, so this runs no job."""
        return max((r[0] for r in self.meta.select(column).collect()), default=0)

    def counts(self) -> DataFrame:
        """One row for each matrix: masked, unmasked, in-band masked, out-of-band masked, in-band and out-of-band cells of both triangles."""
        per = self.flagged().where("masked and not bin_masked").groupBy("chrom").agg(F.sum(F.when(F.col("k") == 0, 1).otherwise(2)).alias("e"))
        t = self.touched().groupBy("chrom").agg(F.sum(F.when(F.col("k") == 0, F.col("touched")).otherwise(2 * F.col("touched"))).alias("t"))
        r = self.get_mask_bins().groupBy("chrom").agg(F.count("*").alias("r"))
        m = self.meta.join(per, "chrom", "left").join(t, "chrom", "left").join(r, "chrom", "left").fillna(0, ["e", "t", "r"])
        band = in_band(F.col("n"), F.col("d"))
        masked = F.col("e") + 2 * F.col("r") * F.col("n") - F.col("r") * F.col("r")
        inside = F.col("e") + F.col("t")
        return m.select("chrom", masked.alias("masked"), (F.col("n") * F.col("n") - masked).alias("unmasked"), inside.alias("in_band_masked"), (masked - inside).alias("out_band_masked"), band.alias("in_band"), (F.col("n") * F.col("n") - band).alias("out_band"))

    def filled(self, fill: float | None = None) -> BandMatrix:
        """Masked cells become the fill (by default default_value), masks go, and the fill is the new default_value.

        Cells of masked bins are written in the band; out of the band they have the new default as well.
        """
        value = F.lit(float(fill)) if fill is not None else F.col("default_value")
        meta = self.meta.withColumn("default_value", value)
        if self.bins is None:
            cells = self.cells.join(self.meta.select("chrom", value.alias("f")), "chrom").withColumn("v", F.when(F.col("masked"), F.col("f")).otherwise(F.col("v")))
        else:
            every = self.band().join(self.meta.select("chrom", value.alias("f")), "chrom")
            cells = every.withColumn("v", F.coalesce("v", "f"))
        return BandMatrix(cells.select(*KEY, "v", F.lit(False).alias("masked")), meta)

    # ---- reads --------------------------------------------------------------------------------------------------

    def get_values(self, at: DataFrame) -> DataFrame:
        """``at(chrom, row, col, ...)`` with ``value``: NULL if masked, the default out of the band. Other columns pass."""
        cols = at.columns
        q = at.withColumn("i", F.least("row", "col").cast("int")).withColumn("k", F.abs(F.col("row") - F.col("col")).cast("int"))
        q = self.flagged(q.join(self.meta, "chrom").join(self.cells, KEY, "left"))
        bad = (F.col("i") < 0) | (F.col("i") + F.col("k") >= F.col("n"))
        value = F.when(F.col("bin_masked") | F.coalesce("masked", F.lit(False)), None).when(F.col("k") >= F.col("d"), F.col("default_value")).otherwise(F.coalesce("v", "band_fill"))
        return q.select(*cols, F.when(bad, F.raise_error(F.lit("index out of range"))).otherwise(value).alias("value"))

    def rectangle(self, rows: range, cols: range) -> DataFrame:
        """(chrom, row, col, value) of a slice by ranges of any step, as in the dense matrix."""
        if min(rows.start, cols.start, rows.stop, cols.stop) < 0:
            raise ValueError("negative slice bounds")
        span = lambda r: F.sequence(F.lit(r.start), F.lit(r[-1]), F.lit(r.step)) if len(r) else F.array().cast("array<int>")
        grid = self.meta.select("chrom", F.explode(span(rows)).alias("row")).repartition("chrom", "row").withColumn("col", F.explode(span(cols)))
        return self.get_values(grid)

    def submatrix(self, a: int, b: int) -> BandMatrix:
        """Rows and columns a to b - 1 as a matrix of their own, masks included."""
        if a < 0 or b <= a:
            raise ValueError("slice bounds")
        cells = self.cells.where((F.col("i") >= a) & (F.col("i") + F.col("k") < b)).withColumn("i", F.col("i") - a)
        size = F.least(F.col("n"), F.lit(b)) - a
        meta = self.meta.withColumn("n", size).withColumn("d", F.least("d", "n"))
        bins = None if self.bins is None else self.bins.where((F.col("i") >= a) & (F.col("i") < b)).withColumn("i", F.col("i") - a)
        return replace(self, meta=meta, bins=bins)._with(cells.where(F.col("k") < b - a))

    def where(self, condition: DataFrame) -> DataFrame:
        """Unmasked in-band upper-triangle cells (chrom, i, k, v) at which ``condition(chrom, i, k)`` has a row."""
        at = condition.select("chrom", F.col("i").cast("int").alias("i"), F.col("k").cast("int").alias("k")).distinct().join(self.meta, "chrom")
        at = at.where((F.col("k") >= 0) & (F.col("i") >= 0) & (F.col("k") < F.col("d")) & (F.col("i") + F.col("k") < F.col("n")))
        hit = self.flagged(at.join(self.cells, KEY, "left")).where(~(F.coalesce("masked", F.lit(False)) | F.col("bin_masked")))
        return hit.select(*KEY, F.coalesce("v", "band_fill").alias("v"))

    def diag(self, k: int) -> DataFrame:
        """(chrom, i, value) of diagonal k; no rows of matrices that store fewer, and an error if all do."""
        if k < 0 or k >= self._largest("d"):
            raise ValueError("diagonals count from 0 to d - 1")
        every = self.rows().where((F.col("i") + k < F.col("n")) & (F.lit(k) < F.col("d"))).withColumn("k", F.lit(k))
        out = self.flagged(every.join(self.cells.where(F.col("k") == k), KEY, "left"))
        return out.select("chrom", "i", F.when(F.coalesce("masked", F.lit(False)) | F.col("bin_masked"), None).otherwise(F.coalesce("v", "band_fill")).alias("value"))

    def extract_row(self, i: int, out_of_band: bool = True) -> DataFrame:
        """(chrom, col, value) of row i; only its in-band span without ``out_of_band``."""
        at = self.rows().where(F.lit(i) < F.col("n")).where(F.lit(out_of_band) | (F.abs(F.col("i") - i) < F.col("d")))
        out = self.get_values(at.select("chrom", F.lit(i).alias("row"), F.col("i").alias("col")))
        return out.select("chrom", "col", "value")

    def diagonals(self) -> DataFrame:
        """(chrom, k, values): each diagonal in order, masked values NULL."""
        pairs = F.sort_array(F.collect_list(F.struct("i", "v")))
        return self.band().groupBy("chrom", "k").agg(F.transform(pairs, lambda x: x["v"]).alias("values"))

    def full_rows(self) -> DataFrame:
        """(chrom, i, values): each dense row; columns are the same by symmetry."""
        pairs = F.sort_array(F.collect_list(F.struct("col", "value")))
        return self.todense().groupBy("chrom", F.col("row").alias("i")).agg(F.transform(pairs, lambda x: x["value"]).alias("values"))

    def windows(self, width: int, step: int = 1) -> DataFrame:
        """(chrom, start, i, k, v) of the cells of sliding squares at 0, step, ...; k < width <= d."""
        if width < 1 or step < 1:
            raise ValueError("width and step must be positive")
        last = F.least(F.col("i"), F.col("n") - width)
        first = F.greatest(F.lit(0), F.col("i") + F.col("k") - width + 1)
        first = (F.ceil(first / step) * step).cast("int")
        b = self.band().where((F.col("k") < width) & (F.lit(width) <= F.col("d")))
        return b.where(first <= last).withColumn("start", F.explode(F.sequence(first, last.cast("int"), F.lit(step)))).select("chrom", "start", "i", "k", "v")

    def contains(self, x: float) -> DataFrame:
        """(chrom, found): whether any unmasked cell has the value."""
        from .reductions import stats

        s = stats(self, None)
        hit = self.flagged().where("not masked and not bin_masked").groupBy("chrom").agg(F.max(F.col("v") == x).alias("hit"))
        implicit = ((F.col("n_implicit") > 0) & (F.col("band_fill") == x)) | ((F.col("n_out") > 0) & (F.col("default_value") == x))
        return s.join(hit, "chrom", "left").select("chrom", (F.coalesce("hit", F.lit(False)) | implicit).alias("found"))

    # ---- writes -------------------------------------------------------------------------------------------------

    def set_values(self, at: DataFrame) -> BandMatrix:
        """Upsert ``at(chrom, row, col, value)``; out-of-band entries are ignored, masked cells change and stay masked.

        An index outside 0 to n - 1 raises, as does a matrix that is not there. Of several values for a cell the largest is taken: rows of a table have no order.
        """
        near = at.select("chrom", "row", "col", F.col("value").cast("double").alias("new")).join(F.broadcast(self.meta), "chrom", "left")
        bad = F.col("n").isNull() | (F.least("row", "col") < 0) | (F.greatest("row", "col") >= F.col("n"))
        k = F.abs(F.col("row") - F.col("col"))
        near = near.where(F.when(bad, F.raise_error(F.lit("index out of range")).cast("boolean")).otherwise(k < F.col("d")))
        new = near.groupBy("chrom", F.least("row", "col").cast("int").alias("i"), k.cast("int").alias("k")).agg(F.max("new").alias("new"))
        out = self.cells.join(new, KEY, "full")
        return self._with(out.select(*KEY, F.coalesce("new", "v").alias("v"), F.coalesce("masked", F.lit(False)).alias("masked")))

    def set_diag(self, k: int, value: float | DataFrame) -> BandMatrix:
        """Replace diagonal k by a number or by ``(chrom, i, value)``, which must have all its n - k rows."""
        if k < 0 or k >= self._largest("d"):
            raise ValueError("diagonals count from 0 to d - 1")
        at = self.rows().where((F.col("i") + k < F.col("n")) & (F.lit(k) < F.col("d")))
        if isinstance(value, (int, float)):
            at = at.withColumn("value", F.lit(float(value)))
        else:
            at = at.join(value.select("chrom", "i", "value", F.lit(1).alias("given")), ["chrom", "i"], "left").withColumn("value", F.when(F.col("given").isNull(), F.raise_error(F.lit("a diagonal needs n - k values"))).otherwise(F.col("value")))
        return self.set_values(at.select("chrom", F.col("i").alias("row"), (F.col("i") + k).alias("col"), "value"))

    def map_values(self, f) -> BandMatrix:
        """Apply a Column function to stored values and to both fills; masks stay. Truth values become 1 and 0."""
        return replace(self, cells=self.cells.withColumn("v", f(F.col("v")).cast("double")), meta=self.meta.withColumn("band_fill", f(F.col("band_fill")).cast("double")).withColumn("default_value", f(F.col("default_value")).cast("double")))

    def clip(self, low: float | None = None, high: float | None = None) -> BandMatrix:
        def f(c: Column) -> Column:
            c = c if low is None else F.greatest(c, F.lit(low).cast("double"))
            return c if high is None else F.least(c, F.lit(high).cast("double"))

        return self.map_values(f)

    def astype(self, kind: str) -> BandMatrix:
        """Cast values; fractions are cut off for integers."""
        return self.map_values(lambda c: c.cast(kind).cast("double") if kind != "double" else c.cast("double"))

    def normalize(self) -> BandMatrix:
        """z-scores within each diagonal over its unmasked cells, 0 where all are equal; default_value stays.

        The value of unstored cells then depends on the diagonal, so the band becomes stored: n * d cells.
        """
        from .reductions import stats

        s = stats(self, "diag").select("chrom", "k", (F.col("sum") / F.col("count")).alias("mean"), F.sqrt(F.greatest(F.lit(0.0), F.col("sumsq") / F.col("count") - (F.col("sum") / F.col("count")) ** 2)).alias("std"))
        every = self.rows().withColumn("k", F.explode(F.sequence(F.lit(0), (F.least("d", F.col("n") - F.col("i")) - 1).cast("int"))))
        c = every.join(self.cells, KEY, "left").join(s, ["chrom", "k"], "left")
        z = F.when(F.col("std") > 1e-12, (F.coalesce("v", "band_fill") - F.col("mean")) / F.col("std")).otherwise(0.0)
        return self._with(c.select(*KEY, z.alias("v"), F.coalesce("masked", F.lit(False)).alias("masked")))

    # ---- sinks --------------------------------------------------------------------------------------------------

    def todense(self) -> DataFrame:
        """(chrom, row, col, value) of all n * n cells; masked ones are NULL, also out of the band. For small n."""
        at = self.rows().select("chrom", F.col("i").alias("row"), F.explode(F.sequence(F.lit(0), (F.col("n") - 1).cast("int"))).alias("col"))
        return self.get_values(at)

    def tocoo(self, drop_zeros: bool = True) -> DataFrame:
        """(chrom, row, col, value) of unmasked upper-triangle in-band cells; without ``drop_zeros`` the whole band."""
        if drop_zeros and not any(r[0] for r in self.meta.select("band_fill").collect()):
            b = self.flagged().where("not masked and not bin_masked and v <> 0")  # cells that are not stored are 0
        else:
            b = self.band().where("v is not null")
            b = b.where("v <> 0") if drop_zeros else b
        return b.select("chrom", F.col("i").alias("row"), (F.col("i") + F.col("k")).alias("col"), F.col("v").alias("value"))

    def tocsr(self) -> DataFrame:
        """(chrom, row, cols, data) with columns in order."""
        pairs = F.sort_array(F.collect_list(F.struct("col", "value")))
        return self.tocoo(False).groupBy("chrom", "row").agg(pairs.alias("p")).select("chrom", "row", F.col("p.col").alias("cols"), F.col("p.value").alias("data"))

    def toarray(self) -> DataFrame:
        """(chrom, i, values): the band itself, padding left out."""
        pairs = F.sort_array(F.collect_list(F.struct("k", "v")))
        return self.band().groupBy("chrom", "i").agg(F.transform(pairs, lambda x: x["v"]).alias("values"))

    def digest(self) -> DataFrame:
        """(chrom, hash) over sizes, fills, stored cells and masks; equal matrices stored alike agree."""
        h = self.flagged().groupBy("chrom").agg(F.bit_xor(F.xxhash64("i", "k", "v", F.col("masked") | F.col("bin_masked"))).alias("h"))
        return self.meta.join(h, "chrom", "left").select("chrom", F.xxhash64("n", "d", "band_fill", "default_value", F.coalesce("h", F.lit(0).cast("long"))).alias("hash"))

    def memory_usage(self) -> DataFrame:
        """(chrom, bytes): 8 bytes for each in-band upper-triangle cell that a dense band would hold."""
        return self.meta.select("chrom", (F.col("n") * F.col("d") * 8).alias("bytes"))

    def equals(self, other: BandMatrix) -> DataFrame:
        """(chrom, equal): sizes, default, masked cells and unmasked values of both, whatever is stored."""
        fills = [{r["chrom"]: r["band_fill"] for r in m.meta.select("chrom", "band_fill").collect()} for m in (self, other)]
        if fills[0] == fills[1]:  # cells stored in neither agree, unless bins differ, which is told below
            x, y = (m.flagged().select(*KEY, F.struct(F.when(~(F.col("masked") | F.col("bin_masked")), F.col("v")).alias("v"), "bin_masked").alias(c)) for m, c in ((self, "a"), (other, "b")))
            both = x.join(y, KEY, "full").join(F.broadcast(self.meta.select("chrom", "band_fill")), "chrom")
            value = lambda c, o: F.when(F.col(c).isNull(), F.when(~F.col(f"{o}.bin_masked"), F.col("band_fill"))).otherwise(F.col(f"{c}.v"))
            agree = value("a", "b").eqNullSafe(value("b", "a"))
        else:
            a = self.band().select(*KEY, F.struct("v").alias("a"))
            b = other.band().select(*KEY, F.struct("v").alias("b"))
            both = a.join(b, KEY, "full")
            agree = F.col("a").isNotNull() & F.col("b").isNotNull() & F.col("a.v").eqNullSafe(F.col("b.v"))
        same = both.groupBy("chrom").agg(F.min(agree).alias("same"))
        o = other.meta.select("chrom", F.struct("n", "d", "default_value").alias("o"))
        m = self.meta.select("chrom", F.struct("n", "d", "default_value").alias("m"))
        bins = self.get_mask_bins().select("chrom", "i", F.lit(1).alias("x")).join(other.get_mask_bins().select("chrom", "i", F.lit(1).alias("y")), ["chrom", "i"], "full")
        bins = bins.groupBy("chrom").agg(F.max(F.col("x").isNull() | F.col("y").isNull()).alias("differ"))
        out = m.join(o, "chrom", "full").join(same, "chrom", "left").join(bins, "chrom", "left")
        return out.select("chrom", (F.col("m").eqNullSafe(F.col("o")) & F.coalesce("same", F.lit(True)) & ~F.coalesce("differ", F.lit(False))).alias("equal"))

    def shape(self) -> dict[str, tuple[int, int]]:
        return {r["chrom"]: (r["n"], r["n"]) for r in self.meta.collect()}

    def __len__(self) -> int:
        sizes = {r["n"] for r in self.meta.select("n").distinct().collect()}
        if len(sizes) != 1:
            raise ValueError("matrices of several sizes have no one length")
        return sizes.pop()

    def __bool__(self) -> bool:
        rows = self.todense().limit(2).collect() if all(n == 1 for n, _ in self.shape().values()) else []
        if len(rows) != 1:
            raise ValueError("only a single 1 by 1 matrix has a truth value")
        return bool(rows[0]["value"])

    def __repr__(self) -> str:
        return "BandMatrix(" + ", ".join(f"{r['chrom']}: {r['n']}x{r['n']}, diag_num={r['d']}, default_value={r['default_value']:g}" for r in self.meta.orderBy("chrom").limit(5).collect()) + ")"
