"""MinHash near-duplicates by tensored banding, every candidate verified on its full shingle set.

Only COLLECTIONS small collections of ROWS minhashes are computed; table keys
are all pairs of them, so COLLECTIONS * ROWS minhashes serve
COLLECTIONS * (COLLECTIONS - 1) / 2 tables of 2 * ROWS each. A pair of sets at
similarity s shares a table unless fewer than two collections agree; with 16
collections of 3 that is a chance of 1.8e-4 at s = 0.8 and of 3e-5 at 0.83.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

COLLECTIONS, ROWS = 16, 3
#: Members of a bucket that are compared with all its others in one round.
HUBS = 512
#: Bits of the smallest parity bitmap.
BITS = 512


def _constants(n: int, name: str) -> np.ndarray:
    return np.array([int.from_bytes(hashlib.sha256(f"{name}{i}".encode()).digest()[:8], "little") | 1 for i in range(n)], dtype=np.uint64)


_A, _B = _constants(COLLECTIONS * ROWS, "a"), _constants(COLLECTIONS * ROWS, "b")
_PLACE = _constants(64, "place")


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


class _Words(dict):
    """64-bit hashes of words; forgotten when there are many."""

    def __missing__(self, w: bytes) -> int:
        import xxhash

        if len(self) >= 250_000:
            self.clear()
        v = self[w] = xxhash.xxh3_64_intdigest(w)
        return v


_words = _Words()
common.register_cache("near_dedup", _words.clear)


def shingle_set(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word shingles, A-Z lower-cased; fewer words than ``width`` are one shingle, no words none."""
    w = common.words(text)
    if not w:
        return np.empty(0, dtype=np.uint64)
    w = b" ".join(w).lower().split(b" ")
    h = np.fromiter(map(_words.__getitem__, w), dtype=np.uint64, count=len(w))
    n = max(1, len(h) - width + 1)
    if len(h) < width:
        s = h[:1] * _PLACE[0]
        for j in range(1, len(h)):
            s = s + h[j : j + 1] * _PLACE[j]
        s = s + np.uint64(len(h))
    else:
        s = h[:n] * _PLACE[0]
        for j in range(1, width):
            s = s + h[j : j + n] * _PLACE[j]
    return np.unique(_mix(s))


def collections_of(sets: list[np.ndarray]) -> np.ndarray:
    """One 64-bit value for each set (none empty) and collection."""
    flat = np.concatenate(sets)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])[:-1]])
    out = np.zeros((len(sets), COLLECTIONS), dtype=np.uint64)
    for c in range(COLLECTIONS):
        for r in range(ROWS):
            k = c * ROWS + r
            h = flat * _A[k]
            h += _B[k]
            h ^= h >> np.uint64(31)
            out[:, c] = _mix(out[:, c] * np.uint64(3) + np.minimum.reduceat(h, starts))
    return out


def bitmap(s: np.ndarray) -> np.ndarray:
    """Parities of a set's elements by place: two bitmaps of one length differ in no more bits than their sets do in elements.

    Two to four bits for each element keep that bound close for sets of any size.
    """
    m = max(BITS, 1 << (2 * len(s) - 1).bit_length()) if len(s) else BITS
    bits = np.bincount((s >> np.uint64(33)).astype(np.int64) & (m - 1), minlength=m) & 1
    return np.packbits(bits.astype(np.uint8)).view("<u8")


def _halved(x: np.ndarray) -> np.ndarray:
    """Bitmaps as they would be with half the places."""
    half = x.shape[1] // 2
    return x[:, :half] ^ x[:, half:]


def near_size(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """False only where sizes rule out a Jaccard similarity of ``percent``."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def bits_apart(maps: list[bytes], others: list[bytes]) -> np.ndarray:
    """At least so many elements are in one set of each pair only; the sizes of a pair are near."""
    out = np.zeros(len(maps), dtype=np.int64)
    long_a, long_b = (np.fromiter(map(len, x), dtype=np.int64, count=len(x)) // 8 for x in (maps, others))
    size = np.minimum(long_a, long_b)  # of two near sets one may have a bitmap of twice the length
    for words in np.unique(size).tolist():
        some = np.flatnonzero(size == words)
        step = max(1, (1 << 20) // words)
        for lo in range(0, len(some), step):
            part = some[lo : lo + step]
            both = []
            for x, length in ((maps, long_a), (others, long_b)):
                flat = np.empty((len(part), words), dtype="<u8")
                for twice in (False, True):
                    at = np.flatnonzero((length[part] > words) == twice)
                    if len(at):
                        got = np.frombuffer(b"".join([x[k] for k in part[at].tolist()]), dtype="<u8").reshape(len(at), -1)
                        flat[at] = _halved(got) if twice else got
                both.append(flat)
            out[part] = np.bitwise_count(both[0] ^ both[1]).sum(axis=1, dtype=np.int64)
    return out


def near_bits(total: np.ndarray, apart: np.ndarray, percent: int) -> np.ndarray:
    """False only where so many elements apart, of a total of both sizes, rule out a Jaccard similarity of ``percent``."""
    return (100 + percent) * (total - apart) >= 2 * percent * total


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def _sketch(width: int):
    def run(batches):
        common.use_caches("near_dedup")
        for b in common.slices(batches):
            ids, texts = b.column("doc_id"), b.column("text").to_pylist()
            for lo, hi in common.groups_by_size(texts):
                sets = [shingle_set(t, width) for t in texts[lo:hi]]
                sizes = np.array([len(s) for s in sets], dtype=np.int64)
                full = np.flatnonzero(sizes)
                d1, d2 = np.zeros(hi - lo, dtype=np.uint64), np.zeros(hi - lo, dtype=np.uint64)
                sig = np.zeros((hi - lo, COLLECTIONS), dtype=np.uint64)
                if len(full):
                    sig[full] = collections_of([sets[i] for i in full])
                    for i in full:
                        d1[i], d2[i] = sets[i].sum(dtype=np.uint64), _mix(sets[i] ^ _A[0]).sum(dtype=np.uint64)
                raw = [x.astype("<u8").tobytes() for x in sig]
                bits = [bitmap(x).tobytes() for x in sets]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(sizes), _signed(d1), _signed(d2), pa.array(raw, pa.binary()), pa.array(bits, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "sig", "bits"])

    return run


def _keys(batches):
    left, right = np.triu_indices(COLLECTIONS, 1)
    salt = _constants(len(left), "table")
    for b in batches:
        rep = b.column("rep").to_numpy(zero_copy_only=False)
        sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype="<u8").reshape(-1, COLLECTIONS)
        for lo in range(0, len(rep), 1000):
            s = sig[lo : lo + 1000]
            key = _mix(_mix(s[:, left] + salt) * np.uint64(5) + s[:, right])
            # the low 7 bits are the table, so that a key never stands for two of them
            key = (key & ~np.uint64(127)) | np.arange(len(left), dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([_signed(key.ravel()), pa.array(np.repeat(rep[lo : lo + 1000], len(left)))], ["key", "rep"])


def _shared(batches):
    """Rows by key: those of keys with two members at least, with the key's first member as ``hub``."""
    held = None  # the last row so far, with its key's first member, and whether it went out
    for b in batches:
        key, rep = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "rep"))
        if not len(key):
            continue
        new = np.concatenate([[held is None or key[0] != held[0]], key[1:] != key[:-1]])
        first = np.maximum.accumulate(np.where(new, np.arange(len(key)), -1))
        hub = np.where(first >= 0, rep[np.maximum(first, 0)], held[2] if held else 0)
        same_next = np.concatenate([key[1:] == key[:-1], [False]])
        out = ~new | same_next
        k, r, h = key[out], rep[out], hub[out]
        if held and not held[3] and not new[0]:
            k, r, h = np.concatenate([[held[0]], k]), np.concatenate([[held[1]], r]), np.concatenate([[held[2]], h])
        held = (key[-1], rep[-1], hub[-1], bool(out[-1]))
        if len(k):
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(r), pa.array(h)], ["key", "rep", "hub"])


def first_table(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first table in which signatures agree, row by row: the pair of the first two equal collections; -1 without two."""
    same = x == y
    first = same.argmax(axis=1)
    rest = same.copy()
    rest[np.arange(len(same)), first] = False
    second = rest.argmax(axis=1)
    table = first * (2 * COLLECTIONS - first - 1) // 2 + second - first - 1
    return np.where(rest.any(axis=1), table, -1)


def _cross(percent: int, best: bool):
    """Rows by (key, salt), those with ``hub`` first: pairs of a hub and any row of another component that may be linked.

    best: of a row's pairs in a bucket only the one that seems nearest.

    A pair stands in every bucket that its signatures share; it goes out of the
    first of these tables alone. Hubs of one key and salt are held while its
    other rows pass, so memory is bounded for any bucket.
    """

    def pairs(key, held, rows, shift):
        comp, rep, n, sig, bits = held
        i, j = np.nonzero((comp[:, None] != rows[0][None, :]) & near_size(n[:, None], rows[2][None, :], percent))
        if shift is not None:  # these rows are the last of the hubs held: each pair once
            i, j = i[i < j + shift], j[i < j + shift]
        some = first_table(sig[i], rows[3][j]) == (key & 127)
        i, j = i[some], j[some]
        apart, total = bits_apart([bits[k] for k in i.tolist()], [rows[4][k] for k in j.tolist()]), n[i] + rows[2][j]
        some = np.flatnonzero(near_bits(total, apart, percent))
        if best and len(some):
            some = some[np.lexsort((i[some], apart[some] / total[some], j[some]))]
            some = some[np.append(True, j[some][1:] != j[some][:-1])]
        return rep[i[some]], rows[1][j[some]], apart[some] / total[some]

    def run(batches):
        now, held = None, None
        for b in batches:
            key, salt, hub, comp, rep, n = (b.column(c).to_numpy(zero_copy_only=False) for c in ("key", "salt", "hub", "component", "rep", "n_shingles"))
            sig = np.frombuffer(b"".join(b.column("sig").to_pylist()), dtype="<u8").reshape(-1, COLLECTIONS)
            bits = b.column("bits").to_pylist()
            new = np.flatnonzero((key[1:] != key[:-1]) | (salt[1:] != salt[:-1]) | (hub[1:] != hub[:-1])) + 1
            edges = [0, *new.tolist(), len(key)]
            found = []
            for start, end in zip(edges, edges[1:], strict=False):
                if end == start:
                    continue
                if now != (key[start], salt[start]):
                    now, held = (key[start], salt[start]), None
                for lo in range(start, end, 256):
                    hi = min(lo + 256, end)
                    rows = comp[lo:hi], rep[lo:hi], n[lo:hi], sig[lo:hi], bits[lo:hi]
                    if hub[lo]:
                        held = rows if held is None else tuple(x + y if isinstance(x, list) else np.concatenate([x, y]) for x, y in zip(held, rows, strict=True))
                        if salt[lo] == 0:  # hubs meet each other in this part alone
                            found.append(pairs(key[lo], held, rows, len(held[0]) - (hi - lo)))
                    elif held is not None:
                        found.append(pairs(key[lo], held, rows, None))
            if sum(len(f[0]) for f in found):
                x, y, z = (np.concatenate([f[k] for f in found]) for k in range(3))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y)), pa.array(y), pa.array(z)], ["a", "b", "rep", "apart"])

    return run


def _verify(percent: int):
    def run(batches):
        for b in batches:
            keep = []
            for x, y in zip(b.column("set_a").to_pylist(), b.column("set_b").to_pylist(), strict=True):
                x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
                if 100 * min(len(x), len(y)) < percent * max(len(x), len(y)):
                    keep.append(False)
                    continue
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(keep, pa.bool_())], ["a", "b", "linked"])

    return run


def _sets(width: int):
    def run(batches):
        for b in batches:
            sets = [shingle_set(t, width).astype("<u8").tobytes() for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("rep"), pa.array(sets, pa.binary())], ["rep", "set"])

    return run


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80, hubs: int = HUBS, spread: int = 8192) -> DataFrame:
    """``docs(doc_id, text)`` to ``doc_id, n_shingles, component_id, kept, class_id``, one row for each input row.

    Documents are linked if their sets of ``width``-word shingles have a Jaccard
    similarity of ``percent`` or more; the component is the least id reachable
    and its document is kept. class_id is the least id with the same set. Null
    and empty texts and texts without words have empty sets, are linked with
    nothing and kept. Rows with a null id are linked with nothing, have a null
    component and are kept. Rows with equal ids are one document: its component
    is the least of any of its rows' texts. Other columns are ignored; an empty
    table gives an empty result.

    Equal sets become one class before any comparison. In the first round each
    class is verified against the least of its buckets' first members. Later
    rounds look at buckets whose members are still in different components: up
    to ``hubs`` members of the smaller components meet all others there, until
    every pair of a bucket has met or shares a component. Of these pairs only
    those are verified that sizes and bitmaps don't prove to be apart, each at
    the first table only. The second round takes each member's nearest pair
    alone, which joins most of a group before all of its pairs are looked at. No bucket is capped, none is expanded into all its
    pairs where components already join them, and a large one is split over
    tasks of about ``spread`` rows, each with a copy of the hubs.
    """
    base = common.materialise(docs.select("doc_id", "text").mapInArrow(_sketch(width), "doc_id long, n_shingles long, d1 long, d2 long, sig binary, bits binary"), "sketches")
    full = base.where("n_shingles > 0 and doc_id is not null")
    reps = full.groupBy("d1", "d2", "n_shingles").agg(F.min("doc_id").alias("rep"), F.first("sig").alias("sig"), F.first("bits").alias("bits"))
    reps = common.materialise(reps, "classes")
    keyed = reps.select("rep", "sig").mapInArrow(_keys, "key long, rep long").repartition("key").sortWithinPartitions("key", "rep")
    shared = common.materialise(keyed.mapInArrow(_shared, "key long, rep long, hub long"), "buckets")

    member = shared.select("rep").distinct()
    own = docs.where("doc_id is not null").select(F.col("doc_id").alias("rep"), "text").join(member.hint("merge"), "rep", "left_semi")
    sets = common.materialise(own.mapInArrow(_sets(width), "rep long, set binary"), "sets")  # an id repeated with other texts has a set for each

    def verify(pairs: DataFrame) -> DataFrame:
        left, right = (sets.select(F.col("rep").alias(c), F.col("set").alias(f"set_{c}")) for c in "ab")
        with_a = common.salted_join(pairs, left, ["a"], spread=spread)
        both = common.salted_join(with_a, right, ["b"], spread=spread, counted=pairs).select("a", "b", "set_a", "set_b")
        each = both.mapInArrow(_verify(percent), "a long, b long, linked boolean")
        return common.materialise(each.groupBy("a", "b").agg(F.max("linked").alias("linked")), "verified")

    first = common.materialise(shared.where("hub <> rep").groupBy(F.col("rep").alias("b")).agg(F.min("hub").alias("a")).select("a", "b"), "pairs")
    tested = verify(first)
    common.release(first)
    name = ["d1", "d2", "n_shingles"]
    repeated = common.salted_join(full.select("doc_id", *name), reps.select(*name, "rep"), name)
    classes = common.materialise(repeated.select("doc_id", "rep").distinct(), "membership")
    # an id with several texts joins their classes
    extra = classes.join(classes.groupBy("doc_id").agg(F.count("*").alias("n"), F.min("rep").alias("low")).where("n > 1"), "doc_id").select(F.col("low").alias("a"), F.col("rep").alias("b"))
    waiting, best = shared.select("key", "rep"), True
    while True:
        comps = common.connected_components(tested.where("linked").select("a", "b").union(extra))
        if waiting is None:
            break
        here = common.salted_join(waiting, comps.select(F.col("node").alias("rep"), "component"), ["rep"], "left").select("key", "rep", F.coalesce("component", "rep").alias("component"))
        here = common.materialise(here, "waiting")
        mixed = here.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("size")).where("low <> high").select("key", "size")
        still = common.materialise(common.salted_join(here, mixed, ["key"]), "mixed")
        common.release(here)
        parts = still.groupBy("key", "component").agg(F.count("*").alias("n"))
        outside = parts.groupBy("key").agg((F.sum("n") - F.max("n")).alias("outside"))
        parts = parts.join(outside, "key")
        still = common.materialise(common.salted_join(still, parts, ["key", "component"]), "open")
        # a limit by rank within a key, which tasks apply to their own rows before these are dealt out
        rank = F.row_number().over(Window.partitionBy("key").orderBy("n", "component", "rep"))
        hub = still.select("key", "n", "component", "rep").withColumn("rank", rank).where(F.col("rank") <= hubs).select("key", "rep", F.lit(True).alias("hub"))
        told = still.join(hub, ["key", "rep"], "left").select("key", "size", "component", "rep", "outside", F.coalesce("hub", F.lit(False)).alias("hub"))
        told = common.materialise(told, "hubs")
        common.release(still)
        share = F.ceil(F.col("size") / spread).cast("int")
        salts = F.when(F.col("hub"), F.sequence(F.lit(0), share - 1)).otherwise(F.array(F.pmod(F.xxhash64("rep"), share).cast("int")))
        dealt = told.select("key", "component", "rep", "hub", F.explode(salts).alias("salt")).join(reps.select("rep", "n_shingles", "sig", "bits"), "rep")
        dealt = dealt.repartition("key", "salt").sortWithinPartitions("key", "salt", F.desc("hub"))
        pairs = dealt.mapInArrow(_cross(percent, best), "a long, b long, rep long, apart double")
        if best:
            pairs = pairs.groupBy("rep").agg(F.min(F.struct("apart", "a", "b")).alias("p")).select("p.a", "p.b")
        pairs = pairs.select("a", "b").distinct()
        pairs = common.materialise(pairs.join(tested, ["a", "b"], "left_anti"), "pairs")
        rest = told if best else told.where((F.col("outside") > hubs) & ~F.col("hub"))
        waiting, best = None if rest.isEmpty() else common.materialise(rest.select("key", "rep"), "waiting"), False
        common.release(told)
        if waiting is None and pairs.isEmpty():
            break
        tested = common.materialise(tested.union(verify(pairs)), "verified")
    named = common.salted_join(classes, comps.select(F.col("node").alias("rep"), "component"), ["rep"], "left").select("doc_id", "rep", F.coalesce("component", "rep").alias("component"))
    # ids join whole components: an id's component is the least of its classes'
    of_id = named.groupBy("doc_id").agg(F.min("component").alias("component_id"), F.min("rep").alias("class_id"))
    out = base.select("doc_id", "n_shingles").join(of_id, "doc_id", "left")
    component = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.coalesce("component_id", "doc_id"))
    kept = F.coalesce(F.col("doc_id") == component, F.lit(True))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), kept.alias("kept"), F.coalesce("class_id", "doc_id").alias("class_id"))
    common.release(reps, shared, sets, tested)
    return out


def deduplicate(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """One row of each group of near duplicates, with all its columns: that of the least id.

    Rows with a null id all stay, as do texts without words. Of several rows with one id one stays.
    """
    gone = near_duplicates(docs, width, percent).where(~F.col("kept")).select("doc_id").distinct()
    rows = docs.join(gone.hint("merge"), "doc_id", "left_anti").select(*docs.columns)
    twice = docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if twice.isEmpty():
        return rows
    again = rows.join(twice, "doc_id", "left_semi").select(*docs.columns).dropDuplicates(["doc_id"])
    return rows.join(twice, "doc_id", "left_anti").select(*docs.columns).union(again)


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(common.table(spark, sf_dir, "documents"), width=2).select("doc_id", "n_shingles", "component_id", "kept")


SQL = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') ws from documents
), s as (
  select doc_id, case when len(ws) < 2 then ws else list_distinct([ws[i] || ' ' || ws[i + 1] for i in range(1, len(ws))]) end sh from w
), e as (select doc_id, len(sh) n, unnest(sh) x from s
), links as (
  select a.doc_id a, b.doc_id b from e a join e b on a.x = b.x and a.doc_id < b.doc_id and 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)
  group by a.doc_id, b.doc_id, a.n, b.n having 100 * count(*) >= 80 * (a.n + b.n - count(*))
), both_ways as (select a, b from links union select b, a from links),
reach(a, b) as (select a, b from both_ways union select r.a, t.b from reach r join both_ways t on r.b = t.a),
least_of as (select a, min(b) m from reach group by a)
select s.doc_id, len(sh)::bigint n_shingles, least(s.doc_id, coalesce(m, s.doc_id)) component_id, s.doc_id <= coalesce(m, s.doc_id) kept
from s left join least_of l on s.doc_id = l.a
"""

QUERIES = {"op5_minhash_near_dedup": op5_minhash_near_dedup}
ORACLE = {"op5_minhash_near_dedup": SQL}
