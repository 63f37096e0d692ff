"""Toxicity by the nearest labelled examples under exact TF-IDF cosine, found through a block-max inverted index.

Terms are all words of the examples; words that no example
has count in the length of a document's vector. A term's weight is its TF-IDF
times how much more common it is in toxic examples, and never zero. The index
holds a bounded sample of labelled documents and is sent to every task. Each
document is a query: postings of rare terms are added up first, then those of
frequent terms, block by block of examples, where the largest weights of a block
leave room for a nearer example than those found; what comes within rounding of
the nearest is scored in full, so the nearest are exact.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Labelled documents in the index, neighbours, examples in a block, queries at a time.
EXAMPLES, NEIGHBOURS, BLOCK, QUERIES_AT_ONCE = 8_192, 15, 1024, 256
#: A term is frequent if at least so many examples have it, and one in so many.
FREQUENT, ONE_IN = 64, 16
#: Share of a sum that single precision may lose for each of its terms, none of which is negative, and once for the rest.
ROUNDING, MARGIN = 1.2e-7, 1e-5
#: Factor of terms that are no more common in toxic examples; examples' worth of the prior in that comparison.
FLOOR, SHRINK = 0.1, 16.0
PREFIXES: tuple[int, ...] = ()
MARKS = b".,!?;:*%&$#|()[]\"'<>-_"
OUT = "doc_id long, held_out boolean, score double, predicted int, evidence array<struct<example:long,cosine:double,toxic:int>>"


def term_keys(word: bytes) -> list[str]:
    """A word without outer marks, A-Z lower-cased, and, if PREFIXES asks for them, its beginnings (marked ^) of so many characters."""
    w = word.strip(MARKS).lower().decode("utf-8", "surrogatepass")
    return [w, *("^" + w[:n] for n in PREFIXES if len(w) > n)] if w else []


def term_number(key: str) -> int:
    """64 bits of a digest; the same in every process."""
    return int.from_bytes(hashlib.blake2b(key.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little")


class _Numbers(dict):
    """Numbers of all terms of a word."""

    def __missing__(self, word: bytes) -> tuple[int, ...]:
        if len(self) >= 200_000:
            self.clear()
        v = self[word] = tuple(map(term_number, term_keys(word)))
        return v


_numbers = _Numbers()
common.register_cache("toxicity", _numbers.clear)


def text_terms(text: str | None, numbers: _Numbers) -> tuple[np.ndarray, np.ndarray]:
    """Distinct term numbers of a text, in order, and how often each occurs."""
    words = Counter(common.words(text))
    each = [numbers[w] for w in words]
    n = np.fromiter(map(len, each), dtype=np.int64, count=len(each))
    found, at = np.unique(np.fromiter(chain.from_iterable(each), dtype=np.uint64, count=int(n.sum())), return_inverse=True)
    often = np.repeat(np.fromiter(words.values(), dtype=np.int64, count=len(words)), n)
    return found, np.bincount(at, often, len(found)).astype(np.int64)


def _spans(lo: np.ndarray, n: np.ndarray) -> np.ndarray:
    """All positions of the ranges that start at lo and have n positions."""
    ends = np.cumsum(n)
    return np.repeat(lo - ends + n, n) + np.arange(int(ends[-1]) if len(n) else 0)


@dataclass
class Index:
    """Examples as unit vectors: counts by example, and by term the postings in example order with the largest weights."""

    terms: np.ndarray  # numbers of all terms, in order
    factor: np.ndarray  # idf * relevance of each term; last, that of a term of no example
    toxic: np.ndarray
    ids: np.ndarray
    edges: np.ndarray  # of examples in own_terms and own_counts
    own_terms: np.ndarray
    own_counts: np.ndarray
    norm: np.ndarray
    curve: np.ndarray = field(default_factory=lambda: np.array([8.0, -4.0]))
    prior: float = 0.0
    postings: tuple | None = None  # made where they are first used, never sent
    query: np.ndarray | None = None  # room for one query's weights
    sent: Broadcast | None = None  # the index as tasks have it, before its curve was known

    def __getstate__(self):
        return self.__dict__ | {"postings": None, "query": None, "sent": None}

    def by_term(self) -> tuple:
        """Starts of terms in rows and weights; these two; each term's place among the frequent, or -1; weights of frequent terms by example, and their largest by block; examples in the order of rows, and the rows of examples."""
        if self.postings is None:
            n, v = len(self.ids), len(self.terms)
            weights = (1 + np.log(self.own_counts, dtype=np.float32)) * self.factor.astype(np.float32)[self.own_terms]
            order = np.argsort(self.own_terms, kind="stable")
            rows = np.repeat(np.arange(n, dtype=np.int32), np.diff(self.edges))
            weights /= self.norm.astype(np.float32)[rows]
            rows, weights = rows[order], weights[order]
            del order
            df = np.bincount(self.own_terms, minlength=v)
            starts = np.concatenate([[0], np.cumsum(df)]).astype(np.int64)
            often = np.flatnonzero(df >= max(FREQUENT, n / ONE_IN))
            frequent = np.full(v, -1, dtype=np.int32)
            frequent[often] = np.arange(len(often))
            # examples alike stand in one block: in the order of their commonest term, then of the next
            rank = np.zeros(v, dtype=np.int64)
            rank[np.argsort(-df, kind="stable")] = np.arange(v)
            lead = np.full((n, 3), v, dtype=np.int64)
            for i in range(n):
                own = np.sort(rank[self.own_terms[self.edges[i] : self.edges[i + 1]]])[:3]
                lead[i, : len(own)] = own
            order = np.lexsort(lead.T[::-1])
            slot = np.empty(n, dtype=np.int32)
            slot[order] = np.arange(n, dtype=np.int32)
            rows = slot[rows]
            blocks = max(1, -(-n // BLOCK))
            by_block = np.zeros((blocks, len(often), BLOCK), dtype=np.float32)
            for j, t in enumerate(often):
                r = rows[starts[t] : starts[t + 1]]
                by_block[r // BLOCK, j, r % BLOCK] = weights[starts[t] : starts[t + 1]]
            self.postings = starts, rows, weights, frequent, by_block, by_block.max(axis=2), order, slot
        return self.postings

    def known(self, numbers: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of the index and unit weights, (1 + log tf) * idf * relevance; terms of no example count in the norm only."""
        at = np.searchsorted(self.terms, numbers)
        found = np.zeros(len(numbers), dtype=bool)
        inside = at < len(self.terms)
        found[inside] = self.terms[at[inside]] == numbers[inside]
        w = (1 + np.log(counts)) * self.factor[np.where(found, at, len(self.terms))]
        return at[found], w[found] / np.sqrt((w * w).sum()) if len(w) else w

    def vector(self, counts: dict[int, int]) -> tuple[np.ndarray, np.ndarray]:
        """Terms and unit weights from counts by position in ``terms``."""
        t = np.array(sorted(counts), dtype=np.int64)
        w = (1 + np.log(np.array([counts[int(x)] for x in t], dtype=float))) * self.factor[t]
        return t, w / np.sqrt((w * w).sum()) if len(t) else w

    def example(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        lo, hi = self.edges[i], self.edges[i + 1]
        t = self.own_terms[lo:hi]
        return t, (1 + np.log(self.own_counts[lo:hi].astype(float))) * self.factor[t] / self.norm[i]

    def cosines(self, some: np.ndarray, t: np.ndarray, w: np.ndarray) -> np.ndarray:
        """Exact cosines of some examples."""
        if self.query is None:
            self.query = np.zeros(len(self.terms))
        self.query[t] = w
        n = np.diff(self.edges)[some]
        at = _spans(self.edges[:-1][some], n)
        q = self.query[self.own_terms[at]]
        same = np.flatnonzero(q)
        x = (1 + np.log(self.own_counts[at[same]].astype(float))) * self.factor[self.own_terms[at[same]]] * q[same]
        self.query[t] = 0
        return np.bincount(np.repeat(np.arange(len(some)), n)[same], x, len(some)) / self.norm[some]

    def nearest(self, t: np.ndarray, w: np.ndarray, k: int = NEIGHBOURS, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Examples and cosines of the k nearest with a positive cosine; the earlier example of equal ones first."""
        return self.nearest_of([(t, w)], k, [without])[0]

    def nearest_of(self, queries: list, k: int = NEIGHBOURS, without: list | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of several queries, some at a time."""
        out = []
        for lo in range(0, len(queries), QUERIES_AT_ONCE):
            out += self._nearest_of(queries[lo : lo + QUERIES_AT_ONCE], k, None if without is None else without[lo : lo + QUERIES_AT_ONCE])
        return out

    def _nearest_of(self, queries: list, k: int, without: list | None) -> list[tuple[np.ndarray, np.ndarray]]:
        n, m = len(self.ids), len(queries)
        if not n:
            return [(np.empty(0, dtype=np.int64), np.empty(0))] * m
        starts, rows, weights, frequent, by_block, most, order, slot = self.by_term()
        sums = np.zeros((m, len(by_block) * BLOCK), dtype=np.float32)
        often = np.zeros((m, by_block.shape[1]), dtype=np.float32)
        for q, (t, w) in enumerate(queries):
            place = frequent[t]
            often[q, place[place >= 0]] = w[place >= 0]
            rare = t[place < 0]
            size = starts[rare + 1] - starts[rare]
            at = _spans(starts[rare], size)
            if len(at):
                sums[q, :n] = np.bincount(rows[at], np.repeat(w[place < 0], size) * weights[at], n)
            if without is not None and without[q] >= 0:
                sums[q, slot[without[q]]] = -8.0
        # block by block, those with the greatest bounds first; a query skips blocks that hold nothing nearer than its k-th
        parts = sums.reshape(m, len(by_block), BLOCK)
        lost = np.array([MARGIN + ROUNDING * len(t) for t, _ in queries])
        bound = (parts.max(axis=2) + often @ most.T) * (1 + 2 * lost)[:, None]
        best = np.zeros((m, k), dtype=np.float32)
        passed = np.zeros((m, len(by_block)), dtype=bool)
        for block in np.argsort(-bound.max(axis=0), kind="stable"):
            some = np.flatnonzero(bound[:, block] >= best.min(axis=1))
            if not len(some):
                continue
            passed[some, block] = True
            parts[some, block] += often[some] @ by_block[block]
            both = np.concatenate([best[some], parts[some, block]], axis=1)
            best[some] = np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        edge = best.min(axis=1) * (1 - 2 * lost)
        out = []
        for q, (t, w) in enumerate(queries):
            near = parts[q] > max(edge[q], 0.0)
            near[~passed[q]] = False
            some = np.sort(order[np.flatnonzero(near.ravel()[:n])])
            s = self.cosines(some, t, w)
            some, s = some[s > 0], s[s > 0]
            first = np.lexsort((some, -s))[:k]
            out.append((some[first], s[first]))
        return out

    def vote(self, i: np.ndarray, s: np.ndarray) -> float:
        """Share of toxic examples, weighted by the inverse distance, with the prior as one more vote of weight 0.1."""
        x = s / (1.0 + 1e-3 - s)
        return float((x @ self.toxic[i] + 0.1 * self.prior) / (x.sum() + 0.1))


def _index(terms: np.ndarray, edges: np.ndarray, own_terms: np.ndarray, own_counts: np.ndarray, toxic: np.ndarray, ids: np.ndarray) -> Index:
    """The index of examples whose terms, as positions in ``terms``, and counts stand one example after the other."""
    n, v = len(ids), len(terms)
    bad = np.asarray(toxic) > 0
    n1 = float(bad.sum())
    n0 = n - n1
    df = np.bincount(own_terms, minlength=v + 1).astype(float)
    a = np.bincount(own_terms[np.repeat(bad, np.diff(edges))], minlength=v + 1).astype(float)
    relevance = np.ones(v + 1)
    if n1 and n0:
        relevance = FLOOR + np.maximum(np.log((a + SHRINK * n1 / n) / (n1 + SHRINK)) - np.log((df - a + SHRINK * n0 / n) / (n0 + SHRINK)), 0)
    factor = (np.log((n + 1) / (df + 1)) + 1) * relevance
    norm = np.ones(n)
    for i in range(n):
        x = (1 + np.log(own_counts[edges[i] : edges[i + 1]].astype(float))) * factor[own_terms[edges[i] : edges[i + 1]]]
        norm[i] = np.sqrt(x @ x) if len(x) else 1.0
    return Index(terms, factor, bad.astype(float), ids, edges, own_terms.astype(np.int32, copy=False), own_counts.astype(np.min_scalar_type(int(own_counts.max(initial=1)))), norm, prior=float(bad.mean()) if n else 0.0)


def build(counts: list[dict[int, int]], toxic: np.ndarray, ids: np.ndarray, terms: Iterable[str]) -> Index:
    """The index of counts by position in ``terms``; numbers of terms take the place of ordered ones."""
    terms = np.arange(len(list(terms)), dtype=np.uint64)
    edges = np.concatenate([[0], np.cumsum([len(c) for c in counts])]).astype(np.int64)
    t = np.array([k for c in counts for k in sorted(c)], dtype=np.int64)
    return _index(terms, edges, t, np.array([c[k] for c in counts for k in sorted(c)], dtype=np.int64), toxic, ids)


def _calibrate(votes: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Slope and intercept from a vote to log odds, by Newton's method with a weak pull to (8, -4)."""
    w, start = np.array([8.0, -4.0]), np.array([8.0, -4.0])
    x = np.column_stack([votes, np.ones_like(votes)])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (p - toxic) + 0.5 * (w - start)
        h = (x * (p * (1 - p))[:, None]).T @ x + 0.5 * np.eye(2)
        w = w - np.clip(np.linalg.solve(h, g), -4, 4)
    return np.array([max(w[0], 0.5), w[1]])


def fit(docs: DataFrame, labels: DataFrame, examples: int = EXAMPLES, modulus: int = 4, held: int = 2, seed: int = 5) -> Index:
    """Index all terms of at most ``examples`` labelled documents, those of least hashed id, none of the held-out ids.

    Labels with null doc_id or toxic are ignored; of repeated ids the largest
    label counts. Equal texts are one example. Calibration asks each example
    for its neighbours without itself.
    """
    spark = docs.sparkSession
    common.text_batches(spark)
    known = labels.where("doc_id is not null and toxic is not null").where(common.doc_ids_mod("doc_id", modulus) != held).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    some = common.bounded_sample(known, "doc_id", examples, seed).select(F.col("doc_id").alias("id"), F.col("toxic"))
    rows = docs.select("doc_id", "text").join(F.broadcast(some), F.col("doc_id") == F.col("id")).select("doc_id", "toxic", F.sha2(F.coalesce("text", F.lit("")), 256).alias("digest"), "text")
    one = common.materialise(rows.groupBy("digest").agg(F.min("doc_id").alias("id"), F.max("toxic").alias("most")), "digests")

    def run(batches):
        common.use_caches("toxicity")
        for b in common.slices(batches, 256):
            got = [text_terms(t, _numbers) for t in b.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("toxic"), b.column("digest"), pa.array([h.tobytes() for h, _ in got], pa.binary()), pa.array([c.astype(np.int32).tobytes() for _, c in got], pa.binary())], ["doc_id", "toxic", "digest", "h", "c"])

    # repeated rows of an id with one text give the same terms: the first stands for all
    texts = rows.drop("toxic").join(F.broadcast(one.withColumnRenamed("digest", "d")), (F.col("doc_id") == F.col("id")) & (F.col("digest") == F.col("d"))).select("doc_id", F.col("most").alias("toxic"), "digest", "text")
    terms_of = common.materialise(texts.mapInArrow(run, "doc_id long, toxic int, digest string, h binary, c binary"), "examples")
    keys, toxic, sizes, h, c, seen = [], [], [0], bytearray(), bytearray(), set()
    for r in terms_of.toLocalIterator():
        key = r["doc_id"], r["digest"]
        if key in seen:
            continue
        seen.add(key)
        keys.append(key)
        toxic.append(float(r["toxic"] > 0))
        sizes.append(len(r["c"]) // 4)
        h += r["h"]
        c += r["c"]
    common.release(terms_of)
    common.release(one)
    numbers, toxic = np.frombuffer(h, dtype=np.uint64), np.array(toxic, dtype=float)
    terms = np.sort(numbers)
    terms = terms[np.append(True, terms[1:] != terms[:-1])[: len(terms)]]
    own = np.empty(len(numbers), dtype=np.int32)
    for lo in range(0, len(own), 1 << 20):
        own[lo : lo + (1 << 20)] = np.searchsorted(terms, numbers[lo : lo + (1 << 20)])
    del numbers, h
    order = np.array(sorted(range(len(keys)), key=keys.__getitem__), dtype=np.int64)
    starts, sizes = np.cumsum(sizes, dtype=np.int64)[:-1], np.array(sizes[1:], dtype=np.int64)
    at = np.concatenate([np.empty(0, dtype=np.int32), *(np.arange(starts[i], starts[i] + sizes[i], dtype=np.int32) for i in order)])
    own, counts = own[at], np.frombuffer(c, dtype=np.int32)[at]
    del at, c
    index = _index(terms, np.append(0, np.cumsum(sizes[order])), own, counts, toxic[order], np.array([keys[i][0] for i in order], dtype=np.int64))
    if len(toxic):
        sent = index.sent = spark.sparkContext.broadcast(index)

        def left_out(batches):
            ix = sent.value
            for b in batches:
                i = b.column("id").to_pylist()
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([ix.vote(*x) for x in ix.nearest_of([ix.example(k) for k in i], without=i)], pa.float64())], ["id", "vote"])

        votes = spark.range(0, len(toxic), 1, max(1, min(len(toxic) // 256, 32))).mapInArrow(left_out, "id long, vote double").toArrow().sort_by("id").column("vote").to_numpy()
        index.curve = _calibrate(votes, toxic)
    return index


def score(docs: DataFrame, index: Index, threshold: float = 0.3, modulus: int = 4, held: int = 2) -> DataFrame:
    """``docs(doc_id, text)`` to score, prediction and the nearest examples as evidence, one row for each input row.

    Only the text is an input of the score. Null and empty texts, and texts
    that share no term with any example, have no neighbours and the calibrated
    prior. Null and repeated ids keep their rows; other columns are ignored; an
    empty table gives an empty result.
    """
    common.text_batches(docs.sparkSession)
    sent, curve = index.sent or docs.sparkSession.sparkContext.broadcast(index), index.curve

    def run(batches):
        ix = sent.value
        common.use_caches("toxicity")
        seen: dict = {}
        for b in common.slices(batches, 512):
            texts = b.column("text").to_pylist()
            keys = [hashlib.blake2b((text or "").encode("utf-8", "surrogatepass"), digest_size=16).digest() for text in texts]
            if len(seen) > 50_000:
                seen.clear()
            new = {key: i for i, key in enumerate(keys) if key not in seen}
            found = ix.nearest_of([ix.known(*text_terms(texts[i], _numbers)) for i in new.values()])
            for key, (i, s) in zip(new, found, strict=True):
                z = curve[0] * ix.vote(i, s) + curve[1]
                seen[key] = float(1 / (1 + np.exp(-z))), [{"example": int(ix.ids[j]), "cosine": float(x), "toxic": int(ix.toxic[j])} for j, x in zip(i[:3], s, strict=False)]
            scores, evidence = [seen[key][0] for key in keys], [seen[key][1] for key in keys]
            kind = pa.list_(pa.struct([("example", pa.int64()), ("cosine", pa.float64()), ("toxic", pa.int32())]))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32()), pa.array(evidence, kind)], ["doc_id", "held_out", "score", "predicted", "evidence"])

    return docs.select("doc_id", (common.doc_ids_mod("doc_id", modulus) == held).alias("held_out"), "text").mapInArrow(run, OUT)


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return score(docs, fit(docs, common.table(spark, sf_dir, "labels")))


QUERIES = {"op9_toxicity": op9_toxicity}
ORACLE: dict[str, str] = {}
