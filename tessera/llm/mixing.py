"""Mixing sources to target weights by nested hash thresholds found from histograms.

Words are summed by source and hash bucket; the bucket in which a source's
budget ends is split further, level by level, down to one hash value. Documents
are then kept by a comparison with their source's threshold: nothing is sorted,
and a larger budget always keeps a superset.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

#: The hash has 60 bits, found 12 bits at a time.
BITS, STEP = 60, 12
#: Sources up to this number are sent to every task; beyond it they are joined by shuffle.
BROADCAST_SOURCES = 50_000


def _hash(col: str):
    return F.conv(F.substring(F.md5(F.coalesce(F.col(col).cast("string"), F.lit("")).cast("binary")), 1, BITS // 4), 16, 10).cast("long")


def targets(sizes: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``sizes(source, source_size)`` with the target of each source.

    Sources in code point order, null last, take the weights in turn. A target
    is min(most * size, level * weight) with the one level at which targets add
    up to ``share`` of all sizes: what resharing the excess by weight ends at.
    One row for each source is all that meets in the windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    s = sizes.select("source", "source_size", w.alias("w"), (F.col("source_size") * F.lit(float(most))).alias("cap"))
    by_fill = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    room = F.lit(float(share)) * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(by_fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    s = s.withColumn("level", room / F.sum("w").over(by_fill.rowsBetween(0, Window.unboundedFollowing)))
    return s.select("source", "source_size", F.least("cap", F.max("level").over(everything) * F.col("w")).alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", F.regexp_count(F.coalesce("text", F.lit("")), F.lit(common.WORD)).cast("long").alias("size"), _hash("doc_id").alias("h"))


def _small(df: DataFrame, sources: int) -> DataFrame:
    """A table of one row for each source, sent to every task if they are few."""
    return F.broadcast(df) if sources <= BROADCAST_SOURCES else df


def thresholds(rows: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> tuple[DataFrame, int]:
    """``rows(source, size, h)`` to ``s, source_size, target, all_copies, threshold``, and the number of sources.

    Each document of the source is taken ``all_copies`` times, and once more if
    its hash is no larger than the threshold.
    """
    goal = common.materialise(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    n = goal.count()
    goal = goal.withColumn("copies", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    goal = goal.withColumn("rest", F.col("target") - F.col("copies") * F.col("source_size"))
    # at each level: the words before the boundary bucket, and the bucket's number
    edge = goal.select(F.col("source").alias("s"), "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("bucket"))
    for left in range(BITS - STEP, -1, -STEP):
        inside = rows.join(_small(edge, n), F.col("source").eqNullSafe(F.col("s")) & (F.shiftright("h", left + STEP) == F.col("bucket")))
        sums = inside.groupBy("s", F.shiftright("h", left).alias("b")).agg(F.sum("size").alias("n"), F.first("rest").alias("rest"), F.first("before").alias("before"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy("s").orderBy("b"))
        edge = sums.withColumn("upto", upto).where("upto > rest").groupBy("s", "rest").agg(F.min(F.struct("b", "upto", "n")).alias("m"))
        edge = edge.select("s", "rest", (F.col("m.upto") - F.col("m.n")).alias("before"), F.col("m.b").alias("bucket"), F.col("m.upto").alias("upto"))
        edge = common.materialise(edge, "edge")
    nearer = F.col("upto") - F.col("rest") < F.col("rest") - F.col("before")
    edge = edge.select("s", F.when(nearer, F.col("bucket")).otherwise(F.col("bucket") - 1).alias("threshold"))
    goal = goal.join(edge, F.col("source").eqNullSafe(F.col("s")), "left")
    return goal.select(F.col("source").alias("s"), "source_size", "target", F.col("copies").alias("all_copies"), F.coalesce("threshold", F.lit(2**BITS)).alias("threshold")), n


def _copies(h, most: float):
    return F.least(F.col("all_copies") + (h <= F.col("threshold")).cast("long"), F.lit(int(most)))


def mix(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """``docs(doc_id, text, source)`` to ``doc_id, source, size, source_size, target, taken, copies``.

    Each document is taken floor(target / source_size) times, and once more if
    its hash is within its source's threshold; the last hash value is in if that
    brings the source nearer to its target. Null texts have size 0; null sources
    are one source of their own, last; null ids share one hash; equal ids of a
    source are taken alike, and every repeated row is kept. A source of size 0
    has target 0. An empty table gives an empty result. Other columns are ignored.
    """
    rows = common.materialise(_sized(docs), "sizes")
    goal, n = thresholds(rows, weights, share, most)
    out = rows.join(_small(goal, n), F.col("source").eqNullSafe(F.col("s")))
    copies = _copies(F.col("h"), most)
    return out.select("doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).alias("taken"), copies.alias("copies"))


def mixed_documents(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """The rows of ``docs`` with all their columns, each as often as ``mix`` takes it."""
    goal, n = thresholds(common.materialise(_sized(docs), "sizes"), weights, share, most)
    goal = goal.select(*(F.col(c).alias(f"__mix_{c}") for c in ("s", "all_copies", "threshold")))
    copies = F.least(F.col("__mix_all_copies") + (_hash("doc_id") <= F.col("__mix_threshold")).cast("long"), F.lit(int(most)))
    out = docs.join(_small(goal, n), F.col("source").eqNullSafe(F.col("__mix_s")))
    return out.withColumn("__mix_copy", F.explode(F.array_repeat(F.lit(0), copies.cast("int")))).select(*docs.columns)


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(common.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Takes {docs} with doc_id, source and text.
MIX_SQL = r"""
with rows as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 15))::bigint h from {docs}
), sums as (select source, sum(size)::bigint source_size from rows group by source
), weighed as (
  select source, source_size, [3.0::double, 1.0, 2.0][1 + (row_number() over (order by encode(source) nulls last) - 1) % 3] w, 2.0::double * source_size as cap from sums
), filled as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, encode(source) nulls last rows between unbounded preceding and 1 preceding), 0))
            / sum(w) over (order by cap / w, encode(source) nulls last rows between current row and unbounded following) lvl from weighed
), goal as (select source, source_size, least(cap, max(lvl) over () * w) target from filled
), split as (
  select *, case when source_size > 0 then floor(target / source_size) else 0 end::bigint copies from goal
), by_hash as (
  select r.source, r.h, sum(r.size) n from rows r group by all
), cum as (
  select b.*, sum(n) over (partition by b.source order by h) upto, s.target - s.copies * s.source_size rest
  from by_hash b join split s on b.source is not distinct from s.source
), edge as (
  select source, min_by(case when upto - rest < rest - (upto - n) then h else h - 1 end, h) threshold from cum where upto > rest group by source
)
select r.doc_id, r.size, s.source_size, s.target,
       r.size * least(s.copies + (r.h <= coalesce(e.threshold, 1152921504606846976))::bigint, 2) taken {more}
from rows r join split s on r.source is not distinct from s.source left join edge e on r.source is not distinct from e.source
"""

QUERIES = {"op7_source_mixing": op7_source_mixing}
ORACLE = {"op7_source_mixing": MIX_SQL.format(docs="documents", more="")}
