"""Contact matrices derived from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import BandMatrix

#: Six-hour bins of January 2024, stored diagonals, TAD window.
N, D, W = 120, 40, 5


def _pairs(counts: DataFrame, by: list[str]) -> DataFrame:
    """``counts(*by, b, c)`` of members in bins to pairs of members: (.., i, k, v). Bins are counted before they meet, so a busy group has no more pairs than bins squared."""
    x = counts.select(*by, F.col("b").alias("x"), F.col("c").alias("cx"))
    y = counts.select(*by, F.col("b").alias("y"), F.col("c").alias("cy"))
    v = F.when(F.col("x") == F.col("y"), F.expr("cx * (cx - 1) div 2")).otherwise(F.col("cx") * F.col("cy"))
    return x.join(y, by).where("x <= y").withColumn("v", v).where("v > 0")


def events_coo(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(chrom, row, col, value): pairs of events of one user and type, by six-hour bin."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    b = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', cast(ts as timestamp_ntz)) div 21600000000").cast("int")
    counts = e.select("user_id", F.col("event_type").alias("chrom"), b.alias("b")).groupBy("user_id", "chrom", "b").agg(F.count("*").alias("c"))
    p = _pairs(counts, ["user_id", "chrom"]).groupBy("chrom", F.col("x").alias("row"), F.col("y").alias("col")).agg(F.sum("v").cast("double").alias("value"))
    return p


def events(spark: SparkSession, sf_dir: str, d: int = D) -> BandMatrix:
    """Five matrices, one for each event type; unstored cells are 0."""
    kinds = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_type").distinct().collect()  # sizes by a scan of one column
    return BandMatrix.from_coo(events_coo(spark, sf_dir), d, {r[0]: N for r in kinds}, how="sum")


def masked_events(spark: SparkSession, sf_dir: str) -> BandMatrix:
    """The same with masked cells and bins, and 0.1 out of the band."""
    m = events(spark, sf_dir)
    m = BandMatrix(m.cells, m.meta.withColumn("default_value", F.lit(0.1)))
    m = m.mask_where((F.col("i") * 7 + F.col("k") * 3) % 11 == 0)
    bins = m.meta.select("chrom", F.explode(F.sequence(F.lit(3), F.lit(N - 1), F.lit(17))).alias("i"))
    return m.mask_bins(bins)


def parts(spark: SparkSession, sf_dir: str, d: int | None = None) -> BandMatrix:
    """One matrix: pairs of lines of an order, by groups of twenty parts."""
    items = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    # pairs are of lines with different numbers; lines of one number are counted together and make none
    lines = items.select("l_orderkey", "l_linenumber", F.expr("l_partkey div 20").cast("int").alias("b"))
    counts = lines.groupBy("l_orderkey", "b").agg(F.count("*").alias("c"))
    every = _pairs(counts, ["l_orderkey"]).select(F.col("x").alias("row"), F.col("y").alias("col"), "v")
    same = lines.groupBy("l_orderkey", "l_linenumber", "b").agg(F.count("*").alias("c"))
    none = _pairs(same, ["l_orderkey", "l_linenumber"]).select(F.col("x").alias("row"), F.col("y").alias("col"), (-F.col("v")).alias("v"))
    coo = every.union(none).groupBy("row", "col").agg(F.sum("v").cast("double").alias("value")).where("value <> 0").withColumn("chrom", F.lit("parts"))
    n = (spark.read.parquet(f"{sf_dir}/part.parquet").agg(F.max("p_partkey").alias("m")).first()["m"] or 0) // 20 + 1
    return BandMatrix.from_coo(coo, n if d is None else d, {"parts": n}, how="sum")
