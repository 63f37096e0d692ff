"""Document fingerprints: every character shingle hash below a fixed fraction of the hash range.

The sketch of a text is a fixed share of its shingles, so sketches of any two
texts are comparable and the sketch of a union is the union of sketches, however
unequal the texts are.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Code points in a shingle; one in FRACTION hashes is retained.
WIDTH, FRACTION = 8, 16
_MULTIPLIERS = np.array([int.from_bytes(hashlib.sha256(b"shingle%d" % i).digest()[:8], "little") | 1 for i in range(WIDTH)], dtype=np.uint64)
_PAD = 0x110000
_BLOCK = 1 << 20
OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, contained_in_edited double"


def _hashes(points: np.ndarray) -> np.ndarray:
    """Hash of each window of WIDTH code points."""
    n = len(points) - WIDTH + 1
    x = points.astype(np.uint64)
    x += np.uint64(1)
    h = x[:n] * _MULTIPLIERS[0]
    for j in range(1, WIDTH):
        h += x[j : n + j] * _MULTIPLIERS[j]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    return h


def sketches(texts: list[str], fraction: int = FRACTION) -> list[np.ndarray]:
    """Sorted distinct retained hashes of each text; texts shorter than a shingle are padded to one, the empty text has none."""
    most = np.uint64(min(2**64 // fraction, 2**64 - 1))
    found: list[list[np.ndarray]] = [[] for _ in texts]
    group: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal group, held
        if not group:
            return
        parts = [texts[i] for i in group]
        lengths = np.array([max(len(p), WIDTH) for p in parts])
        points = np.full(int(lengths.sum()), _PAD, dtype=np.uint32)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        for p, at in zip(parts, starts, strict=True):
            points[at : at + len(p)] = np.frombuffer(p.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        h = _hashes(points)
        at = np.flatnonzero(h < most)
        owner = np.searchsorted(starts, at, side="right") - 1
        inside = at + WIDTH <= starts[owner] + lengths[owner]
        at, owner = at[inside], owner[inside]
        edges = np.searchsorted(owner, np.arange(len(group) + 1))
        for k, i in enumerate(group):
            found[i].append(h[at[edges[k] : edges[k + 1]]])
        group, held = [], 0

    for i, t in enumerate(texts):
        if not t:
            continue
        if len(t) > _BLOCK:  # in blocks that overlap by a shingle less one
            for lo in range(0, len(t) - WIDTH + 1, _BLOCK):
                h = _hashes(np.frombuffer(t[lo : lo + _BLOCK + WIDTH - 1].encode("utf-32-le", "surrogatepass"), dtype="<u4"))
                found[i].append(np.unique(h[h < most]))
            continue
        if held + len(t) > _BLOCK:
            flush()
        group.append(i)
        held += len(t)
    flush()
    return [np.unique(np.concatenate(f)) if f else np.empty(0, dtype=np.uint64) for f in found]


def encode(text: str, sketch: np.ndarray) -> str:
    """16 hexadecimal digits of the text's SHA-256, a dot, the retained hashes in base64."""
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()[:16] + "." + base64.b64encode(sketch.astype("<u8").tobytes()).decode()


def decode(fingerprint: str) -> tuple[str, np.ndarray]:
    digest, _, body = fingerprint.partition(".")
    return digest, np.frombuffer(base64.b64decode(body), dtype="<u8")


def merge(fingerprints: list[str]) -> np.ndarray:
    """The sketch of all the texts' shingles together."""
    return np.unique(np.concatenate([np.empty(0, dtype=np.uint64), *(decode(f)[1] for f in fingerprints)]))


def compare(a: str, b: str) -> tuple[float, float | None]:
    """Estimated Jaccard likeness, and the estimated share of a's shingles that b has (None if a retains none)."""
    return _compare(*decode(a), *decode(b))


def _compare(da: str, a: np.ndarray, db: str, b: np.ndarray) -> tuple[float, float | None]:
    both = len(np.intersect1d(a, b, assume_unique=True))
    if da == db:
        return 1.0, 1.0
    union = len(a) + len(b) - both
    return (both / union if union else 0.0), (both / len(a) if len(a) else None)


def _finish(rows: list[tuple]) -> pa.RecordBatch:
    """rows: (doc_id, text, text of the next document)."""
    texts = [r[1] for r in rows]
    edited = [t[: len(t) - len(t) // 2] + after[: len(t) // 2] for _, t, after in rows]
    heads = [*texts, rows[-1][2]]  # rows follow each other: the next document of one is the next row
    s = sketches(heads + edited)
    own, new = s[: len(heads)], s[len(heads) :]
    digest = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest()[:16] for t in heads]
    sha = [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in edited]
    code = lambda d, x: d[:16] + "." + base64.b64encode(x.astype("<u8").tobytes()).decode()
    like = [_compare(digest[k], own[k], sha[k][:16], new[k]) for k in range(len(rows))]
    cols = [
        pa.array([r[0] for r in rows], pa.int64()),
        pa.array([len(t) for t in texts], pa.int64()),
        pa.array(sha, pa.string()),
        pa.array([code(digest[k], own[k]) for k in range(len(rows))], pa.string()),
        pa.array([code(sha[k], new[k]) for k in range(len(rows))], pa.string()),
        pa.array([x[0] for x in like], pa.float64()),
        pa.array([_compare(digest[k], own[k], digest[k + 1], own[k + 1])[0] for k in range(len(rows))], pa.float64()),
        pa.array([x[1] for x in like], pa.float64()),
    ]
    return pa.RecordBatch.from_arrays(cols, ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next", "contained_in_edited"])


def _run(batches):
    """Rows by (part, tail, order): a document's next is the row below it, or the first tail row of its part."""
    pending = None
    ready: list[tuple] = []
    size = 0
    for b in batches:
        for part, tail, doc, text in zip(b.column("part").to_pylist(), b.column("tail").to_pylist(), b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
            text = text or ""
            if pending is not None and pending[0] == part and not pending[1]:
                ready.append((pending[2], pending[3], text))
                size += len(pending[3])
            if ready and (size > _BLOCK or tail):
                yield _finish(ready)
                ready, size = [], 0
            pending = (part, tail, doc, text)
    if ready:
        yield _finish(ready)


#: Ranges of ids, at most.
RANGES = 4096


def fingerprint(docs: DataFrame, rows_per_part: int = 2_000) -> DataFrame:
    """``docs(doc_id, text)`` to fingerprints of each text and of its edited text.

    The edited text has its last half (rounded down) replaced by the start of
    the next document's text. The next document is the one below in order of
    descending id, null ids last and equal ids by text, and the first after the
    last; a single document is its own next. Null texts are empty; the sketch of
    an empty text is empty, and two different texts without retained hashes have
    likeness 0. Repeated rows keep their rows. Other columns are ignored. An
    empty table gives an empty result.

    Ids are cut into ranges, at most RANGES of them, by approximate quantiles;
    texts are dealt once by range, and the first document of a range is also
    sent to the range before it. The driver gets one id for each range. A range
    is sorted on disk and passes through its task in slices.
    """
    common.text_batches(docs.sparkSession)
    least = -(2**63)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("doc_id", F.lit(least)).alias("at"))
    n = rows.count()
    ranges = min(RANGES, max(1, -(-n // rows_per_part)))
    shares = [k / ranges for k in range(1, ranges)]
    found = rows.agg(F.max("at").alias("top"), *([F.percentile_approx("at", shares, 10 * ranges).alias("inner")] if shares else [])).first()
    # any ids of the table may part ranges; the greatest must be one of them
    rising = np.array(sorted({found["top"], *(found["inner"] or [] if shares else [])} - {None}), dtype=np.int64)
    m = len(rising)

    @F.pandas_udf("array<struct<part:int,tail:boolean>>")
    def parts(at: pd.Series) -> pd.Series:
        x = at.to_numpy(dtype=np.int64)
        k = np.searchsorted(rising, x, side="left")
        first = rising[np.minimum(k, m - 1)] == x
        p = m - 1 - k
        return pd.Series([[{"part": int(i), "tail": False}, {"part": int(i - 1) % m, "tail": True}] if f else [{"part": int(i), "tail": False}] for i, f in zip(p, first, strict=True)])

    deals = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-m // 4))
    dealt = rows.withColumn("to", F.explode(parts("at"))).select(F.col("to.part").alias("part"), F.col("to.tail").alias("tail"), "doc_id", "at", "text")
    dealt = dealt.repartition(deals, "part").sortWithinPartitions("part", "tail", F.col("at").desc(), "text")
    return dealt.select("part", "tail", "doc_id", "text").mapInArrow(_run, OUT)


def op3_threshold_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint(common.table(spark, sf_dir, "documents"))


QUERIES = {"op3_threshold_fingerprints": op3_threshold_fingerprints}
ORACLE: dict[str, str] = {}
