"""What the operators share: scratch tables, bounded samples, words, components.

Scratch tables go to the folder in ``spark.checkpoint.dir``, which every
executor can reach. Where it is unset, a private folder serves one local
process, as in tests; a cluster without it raises.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space; everything else belongs to words.
SPACES = "\x20\x09\x0a\x0b\x0c\x0d"
WORD = r"[^\x20\x09-\x0D]+"
_own_root: dict[str, str] = {}
_made: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "root" not in _own_root:
        _own_root["root"] = "file://" + tempfile.mkdtemp(prefix="tessera-")
    return _own_root["root"]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path under the scratch folder, removed when the driver exits."""
    path = f"{scratch_root(spark)}/tessera/{label}-{uuid.uuid4().hex}"
    _made.append((spark, path))
    return path


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        with contextlib.suppress(Exception):
            _delete(spark, path)


def release(*frames: DataFrame) -> None:
    """Delete the scratch tables behind frames that ``materialise`` returned."""
    for df in frames:
        path = getattr(df, "_scratch_path", None)
        if path:
            _delete(df.sparkSession, path)


def text_batches(spark: SparkSession, rows: int = 1000, read: int = 256) -> None:
    """Send texts to Python workers by 1000 rows instead of the default 10,000, and read them by 256 instead of 4096, which for long texts are hundreds of MB; a smaller setting stays."""
    for name, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", rows), ("spark.sql.parquet.columnarReaderBatchSize", read)):
        if not 0 < int(spark.conf.get(name)) <= most:
            spark.conf.set(name, str(most))


#: Bytes of a scratch table's row group; a task holds one while it writes, and its pages while it reads.
ROW_GROUP = 16 << 20


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and return it reread; later reads survive lost executors."""
    spark = df.sparkSession
    text_batches(spark)
    path = new_path(spark, label)
    df.write.option("parquet.block.size", ROW_GROUP).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bounded_sample(df: DataFrame, key: str, bound: int, seed: int) -> DataFrame:
    """At most ``bound`` rows of ``df``, those with the smallest hash of ``key``; every row if there are no more.

    The hash threshold leaves about ``bound`` rows before they are ordered, so
    neither a task nor the driver holds more than a small multiple of the bound.
    """
    n = df.count()
    h = F.xxhash64(F.lit(seed), F.col(key))
    if n <= bound:
        return df
    edge = int(-(2**63) + (2**64) * min(1.0, 1.2 * bound / n))
    return df.where(h < F.lit(min(edge, 2**63 - 1))).orderBy(h, key).limit(bound)


#: Rows of one key from which a join splits it.
SPREAD = 200_000


def salted_join(left: DataFrame, right: DataFrame, key: list[str], how: str = "inner", spread: int | None = None, counted: DataFrame | None = None) -> DataFrame:
    """``left`` joined with ``right``, which has one row for each key, so that no task gets much more than ``spread`` rows of one key.

    Keys with more rows on the left are split by a salt and their right rows
    copied once for each part; rows that are alike in all columns share a salt.
    The table of such keys has at most one row for ``spread`` rows of ``left``
    and is all that is sent to every task. Null keys meet nothing and are spread.
    counted: a frame with the rows of ``left``, fewer columns and a cheaper plan, from which rows are counted.
    """
    spread = spread or SPREAD
    counted = left if counted is None else counted
    hot = counted.groupBy(*key).agg(F.ceil(F.count("*") / spread).cast("int").alias("_parts")).where("_parts > 1")
    hot = hot.where(" and ".join(f"`{k}` is not null" for k in key))
    parts = F.coalesce("_parts", F.lit(1))
    none = F.lit(False)
    for k in key:
        none = none | F.col(k).isNull()
    mark = F.xxhash64(*counted.columns)
    salt = F.when(none, F.pmod(mark, F.lit(1009))).otherwise(F.pmod(mark, parts)).cast("int")
    dealt = left.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_parts")
    copies = right.join(F.broadcast(hot), key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(copies, [*key, "_salt"], how).drop("_salt")


def doc_ids_mod(col: str, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null ids count as remainder of the empty string, 0."""
    return F.coalesce(F.crc32(F.col(col).cast("string").cast("binary")) % modulus, F.lit(0).cast("long"))


def connected_components(edges: DataFrame, spread: int | None = None) -> DataFrame:
    """Components of an undirected graph: ``edges(a, b)`` to ``(node, component)``, the least node that it reaches.

    Each round every neighbour of a node, and the node, is tied to the least
    node next to it: first its greater neighbours (large star), then its smaller
    ones (small star). Components become stars around their least node in a
    logarithmic number of rounds, and the number of edges does not grow. The
    least neighbour is an aggregate with partial sums in every task and goes
    back to the edges by a salted join, so a node with any number of edges is no
    task's alone. Each round is a written table. Null ends and loops are
    ignored; an empty input gives an empty result.
    """
    now = edges.where("a is not null and b is not null and a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    now = materialise(now, "edges")
    mark = F.xxhash64("a", "b")
    state = lambda e: tuple(e.agg(F.count("*"), F.bit_xor(mark), F.sum(mark.cast("decimal(38,0)"))).first())
    was = state(now)
    while True:
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min(F.least("a", "b")).alias("m"))
        large = salted_join(both.where("b > a"), least, ["a"], spread=spread).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        tied = salted_join(large, least, ["a"], spread=spread).where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        new = materialise(tied.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        release(large, now)
        is_now = state(new)
        now, done, was = new, is_now == was, is_now
        if done:
            roots = now.select(F.col("b").alias("node")).distinct()
            return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(roots.select("node", F.col("node").alias("component")))


def words(text: str | None) -> list[bytes]:
    """Words of a text as UTF-8, in order; A-Z keep their case."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_caches: dict[str, list] = {}
_cache_owner = ""


def register_cache(owner: str, clear) -> None:
    """A cache that a Python worker keeps between tasks."""
    _caches.setdefault(owner, []).append(clear)


def use_caches(owner: str) -> None:
    """Empty what other operators have left in this worker, which serves one stage after the other."""
    global _cache_owner
    if _cache_owner != owner:
        for name, clears in _caches.items():
            if name != owner:
                for clear in clears:
                    clear()
        _cache_owner = owner


def slices(batches, rows: int = 1000):
    """Arrow batches in parts of some rows, so that few texts are Python objects at a time."""
    for b in batches:
        for lo in range(0, b.num_rows, rows):
            yield b.slice(lo, rows)


def groups_by_size(texts: list, most: int = 2_000_000):
    """Index ranges of ``texts`` whose characters add up to about ``most`` at most; a longer text stands alone."""
    start = total = 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(texts):
        yield start, len(texts)
