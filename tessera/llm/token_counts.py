"""Token counts from a digest cache: only distinct texts that the cache lacks are encoded, then appended to it."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, tokens

CACHE = "tokenizer_digest string, content_digest binary, n_tokens long"


class TokenCountCache:
    """A Parquet folder of (tokenizer digest, content digest, tokens).

    Appending the same entry twice, as after a repeated run, is harmless: an
    entry is read as the least count of its key, and all counts of a key agree.
    """

    def __init__(self, spark: SparkSession, path: str | None = None):
        self.spark, self.path = spark, path or common.new_path(spark, "token-cache")
        self.written = path is not None and self._exists()

    def _exists(self) -> bool:
        p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def entries(self, version: str) -> DataFrame | None:
        if not self.written:
            return None
        found = self.spark.read.schema(CACHE).parquet(self.path).where(F.col("tokenizer_digest") == version)
        return found.groupBy("content_digest").agg(F.min("n_tokens").alias("n_tokens"))

    def append(self, fresh: DataFrame) -> None:
        fresh.write.mode("append").parquet(self.path)
        self.written = True


def _encode(path: str, version: str):
    def run(batches):
        enc = tokens.encoder(path)
        for b in common.slices(batches):
            digests, texts = b.column("content_digest"), b.column("body").to_pylist()
            counts: list[int] = []
            for lo, hi in common.groups_by_size(texts):
                counts += enc.counts(texts[lo:hi])
            yield pa.RecordBatch.from_arrays([pa.array([version] * len(texts), pa.string()), digests.cast(pa.binary()), pa.array(counts, pa.int64())], ["tokenizer_digest", "content_digest", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, tokenizer: str | None = None, cache_path: str | None = None, normalise=None, limit: int = 1024) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_bytes, n_tokens, over_limit``, one row for each input row.

    cache_path: a folder that later runs find again, in which only what it lacks
    is encoded; without it, a scratch folder that ends with the driver.
    normalise: a function from Column to Column that must not change counts;
    none by default, as byte-level BPE sees every byte. Null texts count as
    empty (0 bytes, 0 tokens); null and repeated ids keep their own rows; other
    columns are ignored, so their names can't clash. Texts are digested in the
    JVM; equal texts meet after a map-side combine, so a group of copies of any
    size moves once a task, and counts go back to it by a join that splits large
    groups. An empty table gives an empty result.
    """
    spark = docs.sparkSession
    common.text_batches(spark)
    path = tokenizer or tokens.default_path()
    version = tokens.version_digest(path)
    cache = TokenCountCache(spark, cache_path)
    body = F.coalesce(F.col("text"), F.lit(""))
    body = normalise(body) if normalise else body
    rows = docs.select("doc_id", F.octet_length(F.coalesce(F.col("text"), F.lit(""))).cast("long").alias("n_bytes"), body.alias("body"))
    rows = rows.withColumn("content_digest", F.unhex(F.sha2("body", 256)))
    small = common.materialise(rows.select("doc_id", "n_bytes", "content_digest"), "digests")
    distinct = rows.groupBy("content_digest").agg(F.first("body").alias("body"))
    known = cache.entries(version)
    misses = distinct if known is None else distinct.join(known, "content_digest", "left_anti")
    cache.append(misses.mapInArrow(_encode(path, version), CACHE))
    # a group of copies with more rows than half a task's share is split
    spread = max(1000, small.count() // (2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    counted = common.salted_join(small, cache.entries(version), ["content_digest"], spread=spread)
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(common.table(spark, sf_dir, "documents"), cache_path=f"{common.scratch_root(spark)}/tessera-token-counts")


QUERIES = {"op10_token_counts": op10_token_counts}
ORACLE: dict[str, str] = {}
