"""Reading and writing matrices: Parquet tables, npz archives, contact text files, and optional contact-map formats."""

from __future__ import annotations

import io
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import BandMatrix


def save(m: BandMatrix, path: str) -> None:
    """Native form: three Parquet tables, cells partitioned by matrix."""
    m.cells.write.mode("overwrite").partitionBy("chrom").parquet(f"{path}/cells")
    m.meta.write.mode("overwrite").parquet(f"{path}/meta")
    m.get_mask_bins().write.mode("overwrite").parquet(f"{path}/bins")


def load(spark: SparkSession, path: str) -> BandMatrix:
    cells = spark.read.schema("i int, k int, v double, masked boolean, chrom string").parquet(f"{path}/cells")
    bins = spark.read.schema("chrom string, i int").parquet(f"{path}/bins")
    return BandMatrix(cells.select("chrom", "i", "k", "v", "masked"), spark.read.parquet(f"{path}/meta"), bins)


def load_npz(spark: SparkSession, path: str) -> BandMatrix:
    """Archives of data (n, d), mask (n, d) or None, mask_row_col (n) or None, default_value, dtype; one matrix for each file, named by it."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    name = lambda p: p.rsplit("/", 1)[-1].removesuffix(".npz")

    def read(content: bytes):
        with zipfile.ZipFile(io.BytesIO(content)) as z:

            def member(key: str):
                """An array, or None for a member of objects, which stands for no mask; objects are never unpickled."""
                with z.open(f"{key}.npy") as f:
                    version = np.lib.format.read_magic(f)
                    _, _, dtype = (np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0)(f)
                if dtype.hasobject:
                    return None
                with z.open(f"{key}.npy") as f:
                    return np.lib.format.read_array(f, allow_pickle=False)

            return member("data"), member("mask"), member("mask_row_col"), float(member("default_value"))

    def cells(batches):
        for b in batches:
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                data, mask, bins, _ = read(c)
                n, d = data.shape
                for lo in range(0, n, 10_000):
                    i, k = np.divmod(np.arange(lo * d, min(n, lo + 10_000) * d), d)
                    ok = i + k < n
                    i, k = i[ok], k[ok]
                    masked = np.zeros(len(i), dtype=bool) if mask is None else mask[i, k]
                    if bins is not None:
                        masked = masked & ~(bins[i] | bins[i + k])  # bin masks are kept by themselves
                    yield pa.RecordBatch.from_arrays([pa.array([name(p)] * len(i)), pa.array(i, pa.int32()), pa.array(k, pa.int32()), pa.array(data[i, k].astype(float)), pa.array(masked)], ["chrom", "i", "k", "v", "masked"])

    def meta(batches):
        for b in batches:
            rows = [(name(p), *read(c)[0].shape, read(c)[3]) for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{"chrom": r[0], "n": r[1], "d": r[2], "band_fill": r[3], "default_value": r[3]} for r in rows], schema=pa.schema([("chrom", pa.string()), ("n", pa.int64()), ("d", pa.int64()), ("band_fill", pa.float64()), ("default_value", pa.float64())]))

    def bins(batches):
        for b in batches:
            for p, c in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                m = read(c)[2]
                at = np.flatnonzero(m) if m is not None else np.empty(0, dtype=int)
                yield pa.RecordBatch.from_arrays([pa.array([name(p)] * len(at), pa.string()), pa.array(at, pa.int32())], ["chrom", "i"])

    return BandMatrix(files.mapInArrow(cells, "chrom string, i int, k int, v double, masked boolean"), files.mapInArrow(meta, "chrom string, n long, d long, band_fill double, default_value double"), files.mapInArrow(bins, "chrom string, i int"))


def save_npz(m: BandMatrix, chrom: str, path: str) -> None:
    """One matrix as an archive, put together on the driver: n * d numbers must fit there."""
    meta = m.meta.where(F.col("chrom") == chrom).first()
    n, d = meta["n"], meta["d"]
    data = np.full((n, d), meta["band_fill"])
    mask = np.add.outer(np.arange(n), np.arange(d)) >= n
    got = m.cells.where(F.col("chrom") == chrom).select("i", "k", F.col("v").cast("double").alias("v"), "masked").toArrow()
    i, k, v, masked = (got.column(c).to_numpy() for c in ("i", "k", "v", "masked"))
    data[i, k] = v
    mask[i, k] |= masked.astype(bool)
    bins = np.zeros(n, dtype=bool)
    bins[[r["i"] for r in m.get_mask_bins().where(F.col("chrom") == chrom).collect()]] = True
    for k in range(d):
        hit = bins[: n - k] | bins[k:]
        mask[: n - k, k] |= hit
    has = mask[np.add.outer(np.arange(n), np.arange(d)) < n].any()
    np.savez(path, data=data, mask=mask if has else np.array(None), mask_row_col=bins if bins.any() else np.array(None), default_value=meta["default_value"], dtype="float64")


def read_contacts(spark: SparkSession, path: str, resolution: int, d: int, sizes: DataFrame | None = None, skip: tuple[str, ...] = ("ALL", "M", "MT")) -> BandMatrix:
    """Text of ``chrom start1 start2 count`` by white space, gzip allowed: positions become bins, "chr" is stripped, equal cells are added up."""
    cols = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).select(F.regexp_replace(cols[0], "^chr", "").alias("chrom"), cols[1].cast("long").alias("a"), cols[2].cast("long").alias("b"), cols[3].cast("double").alias("value"))
    t = t.where(~F.col("chrom").isin(*skip)).select("chrom", F.expr(f"a div {resolution}").alias("row"), F.expr(f"b div {resolution}").alias("col"), "value")
    return BandMatrix.from_coo(t, d, sizes, how="sum")


def read_fragments(spark: SparkSession, path: str) -> DataFrame:
    """(chrom, mid, i): fragments of a text file ``chrom _ mid ...``, numbered in file order."""
    cols = F.split(F.trim("value"), r"\s+")
    # numbered by place in the file: a compressed file is one partition, and ids rise within and between partitions
    t = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).select(cols[0].alias("chrom"), cols[2].cast("long").alias("mid"), "at")
    number = t.rdd.map(lambda r: (r["chrom"], r["mid"], r["at"])).sortBy(lambda r: r[2]).zipWithIndex().map(lambda x: (x[0][0], x[0][1], x[1]))
    return spark.createDataFrame(number, "chrom string, mid long, i long")


def read_interactions(spark: SparkSession, path: str, fragments: DataFrame, d: int, name: str = "genome") -> BandMatrix:
    """``chrom1 mid1 chrom2 mid2 count`` over numbered fragments, as one genome-wide matrix; equal cells are added up."""
    cols = F.split(F.trim("value"), r"\s+")
    t = spark.read.text(path).select(cols[0].alias("c1"), cols[1].cast("long").alias("m1"), cols[2].alias("c2"), cols[3].cast("long").alias("m2"), cols[4].cast("double").alias("value"))
    f = lambda c, m, out: fragments.select(F.col("chrom").alias(c), F.col("mid").alias(m), F.col("i").alias(out))
    t = t.join(f("c1", "m1", "row"), ["c1", "m1"]).join(f("c2", "m2", "col"), ["c2", "m2"]).select(F.lit(name).alias("chrom"), "row", "col", "value")
    sizes = fragments.agg(F.count("*").alias("n")).select(F.lit(name).alias("chrom"), "n")
    return BandMatrix.from_coo(t, d, sizes, how="sum")


def write_bias(bias: DataFrame, fragments: DataFrame, path: str) -> None:
    """Tab-separated ``chrom mid bias``, gzip, in bin order."""
    out = bias.select("i", "bias").join(fragments, "i").orderBy("i").select("chrom", "mid", "bias")
    out.write.mode("overwrite").csv(path, sep="\t", compression="gzip")


def from_pixels(pixels: DataFrame, bins: DataFrame, d: int, balance: bool = True) -> BandMatrix:
    """Genome-wide pixels ``(bin1, bin2, count)`` and ``bins(bin, chrom, weight)`` to one matrix for each chromosome.

    With ``balance``, counts are multiplied by both bins' weights and bins without one are masked.
    Keys of several cells can be put into ``chrom`` as "cell/chrom".
    """
    first = bins.groupBy("chrom").agg(F.min("bin").alias("first"), F.count("*").alias("n"))
    b = bins.join(first, "chrom").select("chrom", "bin", (F.col("bin") - F.col("first")).alias("at"), "weight")
    one = b.select(F.col("chrom"), F.col("bin").alias("bin1"), F.col("at").alias("row"), F.col("weight").alias("w1"))
    two = b.select(F.col("chrom").alias("chrom2"), F.col("bin").alias("bin2"), F.col("at").alias("col"), F.col("weight").alias("w2"))
    t = pixels.join(one, "bin1").join(two, "bin2").where("chrom = chrom2")
    value = F.col("count") * F.col("w1") * F.col("w2") if balance else F.col("count").cast("double")
    t = t.select("chrom", "row", "col", value.alias("value")).where("value is not null")
    m = BandMatrix.from_coo(t, d, first.select("chrom", "n"), how="sum")
    return m.mask_bins(b.where("weight is null").select("chrom", F.col("at").alias("i"))) if balance else m


def read_cool(spark: SparkSession, path: str, d: int, chrom: str | None = None, resolution: int | None = None, cell: str | None = None, balance: bool = True) -> BandMatrix:
    """A .cool, .mcool (with a resolution) or .scool (with a cell) file through the optional library ``cooler``.

    Pixels are read by row ranges in the tasks; the path must be readable there.
    """
    import cooler

    uri = f"{path}::resolutions/{resolution}" if path.endswith(".mcool") else f"{path}::/cells/{cell}" if path.endswith(".scool") else path
    c = cooler.Cooler(uri)
    table = c.bins()[:]
    table = table if chrom is None else table[table["chrom"] == chrom]
    weight = table["weight"] if "weight" in table else np.ones(len(table))
    bins = spark.createDataFrame([(int(i), str(x), float(w) if w == w else None) for i, x, w in zip(table.index, table["chrom"], weight, strict=True)], "bin long, chrom string, weight double")
    size = 1_000_000
    spans = spark.range(0, int(c.info["nnz"]), size).repartition(max(1, int(c.info["nnz"]) // size))

    def pixels(batches):
        import cooler

        for b in batches:
            for at in b.column("id").to_pylist():
                p = cooler.Cooler(uri).pixels()[at : at + size]
                yield pa.RecordBatch.from_arrays([pa.array(p["bin1_id"], pa.int64()), pa.array(p["bin2_id"], pa.int64()), pa.array(p["count"].astype(float))], ["bin1", "bin2", "count"])

    return from_pixels(spans.mapInArrow(pixels, "bin1 long, bin2 long, count double"), bins, d, balance)


def read_cool_cells(spark: SparkSession, path: str, d: int, cells: list[str], **more) -> BandMatrix:
    """All chromosomes of several cells of a .scool file, named "cell/chrom"."""
    out = None
    for cell in cells:
        m = read_cool(spark, path, d, cell=cell, **more)
        name = F.concat(F.lit(f"{cell}/"), F.col("chrom"))
        m = BandMatrix(m.cells.withColumn("chrom", name), m.meta.withColumn("chrom", name), m.get_mask_bins().withColumn("chrom", name))
        out = m if out is None else BandMatrix(out.cells.unionByName(m.cells), out.meta.unionByName(m.meta), out.bins.unionByName(m.bins))
    if out is None:
        raise ValueError("no cells")
    return out


def read_hic(spark: SparkSession, path: str, chroms: list[str], resolution: int, d: int, data_type: str = "observed", normalization: str = "NONE", unit: str = "BP") -> BandMatrix:
    """A .hic file through the optional library ``hicstraw``, one task for each chromosome; ALL and M are skipped."""
    names = [c for c in chroms if c.removeprefix("chr") not in ("ALL", "M")]

    def records(batches):
        import hicstraw

        for b in batches:
            for c in b.column("chrom").to_pylist():
                found = hicstraw.straw(data_type, normalization, path, c, c, unit, resolution)
                for lo in range(0, len(found), 100_000):
                    some = found[lo : lo + 100_000]
                    yield pa.RecordBatch.from_arrays([pa.array([c] * len(some)), pa.array([r.binX // resolution for r in some], pa.int64()), pa.array([r.binY // resolution for r in some], pa.int64()), pa.array([float(r.counts) for r in some])], ["chrom", "row", "col", "value"])

    asked = spark.createDataFrame([(c.removeprefix("chr"),) for c in names], "chrom string").repartition(len(names), "chrom")
    return BandMatrix.from_coo(asked.mapInArrow(records, "chrom string, row long, col long, value double"), d, how="sum")
