"""Best-fit packing of token pieces after Martello-Toth dominance reduction.

The instance is a histogram of piece lengths (at most ``capacity`` numbers), so
the driver solves it whole for any number of documents; rows then look up their
place by their rank within their length.
"""

from __future__ import annotations

import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


def reduce_by_dominance(counts: dict[int, int], capacity: int) -> tuple[list[tuple[tuple[int, ...], int]], dict[int, int]]:
    """Fix bins that dominate every other bin of their largest item; return (bin, times) and what is left.

    A set dominates another if the other's items can be split into parts that
    each fit in an item of the first; then some best solution holds it. Fixed
    are: an item with which nothing else fits; an item and its exact complement;
    an item and the largest that fits, when no two others fit beside the item,
    or when no three do and no two that fit outweigh the one.
    """
    left = Counter({s: n for s, n in counts.items() if n > 0})
    fixed: list[tuple[tuple[int, ...], int]] = []

    def take(items: tuple[int, ...], times: int) -> None:
        for s, k in Counter(items).items():
            left[s] -= k * times
            if not left[s]:
                del left[s]
        fixed.append((items, times))

    moved = True
    while moved:
        moved = False
        for s in sorted(left, reverse=True):
            while left.get(s, 0):
                room = capacity - s
                rest = sorted(x for x in left if x <= room and left[x] - (x == s) > 0)
                if not rest:
                    take((s,), left[s])
                    moved = True
                    break
                best = rest[-1]
                least: list[int] = []
                for x in rest[:3]:
                    least += [x] * min(3, left[x] - (x == s))
                least = least[:3]
                pair = False
                if best == room or len(least) < 2 or least[0] + least[1] > room:
                    pair = True
                elif len(least) < 3 or sum(least) > room:
                    lo, hi, heaviest = 0, len(rest) - 1, 0
                    while lo <= hi:
                        both = rest[lo] + rest[hi]
                        if both > room or (lo == hi and left[rest[lo]] - (rest[lo] == s) < 2):
                            hi -= 1
                        else:
                            heaviest = max(heaviest, both)
                            lo += 1
                    pair = heaviest <= best
                if not pair:
                    break
                take((s, best), left[s] // 2 if best == s else min(left[s], left[best]))
                moved = True
    return fixed, dict(left)


def best_fit(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on a histogram: equal items go in bulk to the tightest open bins that hold them."""
    open_bins: dict[int, list[list]] = defaultdict(list)
    rooms = np.zeros(capacity + 1, dtype=bool)

    def put(items: tuple[int, ...], room: int, times: int) -> None:
        open_bins[room].append([items, times])
        rooms[room] = True

    for s in sorted(counts, reverse=True):
        n = counts[s]
        while n:
            fits = np.flatnonzero(rooms[s:])
            room = int(fits[0]) + s if len(fits) else capacity
            if len(fits):
                items, times = open_bins[room].pop()
                rooms[room] = bool(open_bins[room])
            else:
                items, times = (), n
            each = room // s
            full = min(times, n // each)
            if full:
                put(items + (s,) * each, room - each * s, full)
            n -= full * each
            if n and n < each and times > full:
                put(items + (s,) * n, room - n * s, 1)
                full, n = full + 1, 0
            if items and times > full:
                put(items, room, times - full)
    return [(items, times) for group in open_bins.values() for items, times in group]


def solve(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    fixed, rest = reduce_by_dominance(counts, capacity)
    return fixed + best_fit(rest, capacity)


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: first ranks, first sequences and offsets of runs of equal places."""
    runs: dict[int, list[tuple[int, int, int]]] = defaultdict(list)
    used: Counter = Counter()
    sequence = 0
    for items, times in bins:
        offset = 0
        for s in items:
            runs[s].append((used[s], sequence, offset))
            used[s] += times
            offset += s
        sequence += times
    return {s: tuple(np.array(x, dtype=np.int64) for x in zip(*r, strict=True)) for s, r in runs.items()}


def _cut(path: str, capacity: int, eos: int, with_ids: bool = False):
    names = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids]
    types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids)

    def run(batches):
        enc = tokens.encoder(path)
        end = eos.to_bytes(4, "little")
        for b in common.slices(batches):
            ids_of, texts = b.column("doc_id").to_pylist(), b.column("text").to_pylist()
            for lo, hi in common.groups_by_size(texts):
                out: list[tuple] = []
                for doc, ids in zip(ids_of[lo:hi], enc.ids([t or "" for t in texts[lo:hi]]), strict=True):
                    ids += end
                    n = len(ids) // 4
                    at = 0
                    size = n % capacity or capacity
                    k = 0
                    while at < n:
                        part = ids[4 * at : 4 * (at + size)]
                        out.append((doc, k, at, size, zlib.crc32(part), *[part] * with_ids))
                        at, size, k = at + size, capacity, k + 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def _place(runs):
    def run(batches):
        for b in batches:
            size, rank = (b.column(c).to_numpy(zero_copy_only=False) for c in ("length", "place"))
            sequence, offset = np.empty_like(rank), np.empty_like(rank)
            for s in np.unique(size):
                at = np.flatnonzero(size == s)
                first, seq, off = runs[int(s)]
                k = np.searchsorted(first, rank[at], side="right") - 1
                sequence[at], offset[at] = seq[k] + rank[at] - first[k], off[k]
            keep = [b.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")]
            yield pa.RecordBatch.from_arrays([*keep, pa.array(sequence), pa.array(offset)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = 1024, eos: int = 2, rows_per_group: int = 20_000) -> DataFrame:
    """``docs(doc_id, text)`` to a row for each piece with its sequence and place there.

    Null and empty texts are the end id alone, one piece of length 1. Longer
    documents are cut so that only the first piece may be short. Repeated rows
    are packed each, as are rows without an id; other columns are ignored. An
    empty table gives an empty result. Ranks within a length are counted by hash
    groups of about ``rows_per_group`` pieces, so that one very common length
    doesn't meet in one task.
    """
    common.text_batches(docs.sparkSession)
    path = tokenizer or tokens.default_path()
    pieces = common.materialise(docs.select("doc_id", "text").mapInArrow(_cut(path, capacity, eos), PIECE), "pieces")
    counts = {int(r["length"]): int(r["n"]) for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs = places(solve(counts, capacity))
    groups = max(64, -(-max(counts.values(), default=0) // rows_per_group))
    dealt = pieces.withColumn("g", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(groups)))
    sums = dealt.groupBy("length", "g").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("length", "g", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    ranked = dealt.withColumn("k", F.row_number().over(Window.partitionBy("length", "g").orderBy("doc_id", "piece", "ids_crc32")))
    ranked = ranked.join(sums, ["length", "g"]).withColumn("place", F.col("base") + F.col("k") - 1)
    ranked = ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "place")
    return ranked.mapInArrow(_place(runs), PIECE + ", sequence_id long, offset long")


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str | None = None, capacity: int = 1024, eos: int = 2) -> DataFrame:
    """The ids of each packed sequence, little-endian unsigned 32 bits, in order: ``sequence_id, length, ids``.

    ``docs`` are cut as ``pack`` cut them, and every place of ``packed`` finds
    its piece by id, number, start, length and checksum: repeated rows, null ids
    and several texts under one id give each place once.
    """
    common.text_batches(docs.sparkSession)
    path = tokenizer or tokens.default_path()
    cut = docs.select("doc_id", "text").mapInArrow(_cut(path, capacity, eos, with_ids=True), PIECE + ", ids binary")
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    cut = cut.dropDuplicates(key).select(*[F.col(k).alias(f"of_{k}") for k in key], F.col("ids").alias("part"))
    same = F.lit(True)
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"of_{k}"))
    parts = packed.select("sequence_id", "offset", *key).join(cut, same).select("sequence_id", "offset", "length", "part")
    made = parts.groupBy("sequence_id").agg(F.sum("length").alias("length"), F.sort_array(F.collect_list(F.struct("offset", "part"))).alias("parts"))
    return made.select("sequence_id", "length", F.expr("aggregate(parts, X'', (a, x) -> concat(a, x.part))").alias("ids"))


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(common.table(spark, sf_dir, "documents"))


QUERIES = {"op2_best_fit_packing": op2_best_fit_packing}
ORACLE: dict[str, str] = {}
