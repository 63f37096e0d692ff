"""Language model scores: a hashed maximum-entropy model with class-factored softmax.

log P(word | history) = log P(class | features of the history) + log P(word | class).
Features are hashed: the word before, the word before that (skip), both, and the
classes of the last three. Class weights are trained by minibatch gradient
updates over all training documents, in shards whose number follows from the
tokens alone, averaged by how often each row was touched. Words are counted over the whole corpus; the HEAD commonest
have classes by topic and frequency, any other has a class by its ending, and
its count is joined, never sent to every task.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Words sent to every task, at most; numbers of a document's profile; steps of k-means, at most; profiles in a row of their table.
HEAD, PROFILE, STEPS, BLOCK = 131_072, 256, 20, 64
TOPICS, BANDS = 6, 4
CLASSES = 32
END_CLASS = TOPICS * BANDS + TOPICS
#: Rows of the weight matrix; training rounds; tokens in an update.
HASHED, ROUNDS, BATCH = 1 << 15, 2, 8192
#: Tokens of a shard, about; tasks of a round, at most, each of which walks its shards one after the other.
SHARD, TASKS = 1_500_000, 4096
END = b"\n"  # no word holds white space
MARKS = b".,!?;:*%&$#|()[]\"'-_"
_K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0xD6E8FEB86659FD93)]
ROWS = "key long, doc_id long, held_out boolean, n_tokens long, n_head long, base double, score double, tail array<binary>, tail_z array<int>, tail_n array<int>"


def _lower(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def _profile(raw: bytes) -> np.ndarray:
    """Square roots of the shares of hashed pairs of bytes in a lower-cased text, as 0 to 255; nothing but zeros without a pair."""
    x = np.frombuffer(raw, dtype=np.uint8).astype(np.uint16)
    if len(x) < 2:
        return np.zeros(PROFILE, dtype=np.uint8)
    n = np.bincount((x[:-1] * np.uint16(0x9E37) + x[1:] * np.uint16(0xC2B5)) >> np.uint16(8), minlength=PROFILE)
    return np.rint(255 * np.sqrt(n / (len(x) - 1))).astype(np.uint8)


@dataclass
class Topics:
    """Centroids of documents' profiles, as whole numbers of sixteenths, so that sums and distances are exact."""

    centroids: np.ndarray

    def far(self, x: np.ndarray) -> np.ndarray:
        """Squared distances of profiles from all centroids, in units of 1/256; every product is a whole number below 2**24."""
        x, c = x.astype(np.float32), self.centroids.astype(np.float32)
        return 256.0 * np.einsum("ij,ij->i", x, x).astype(float)[:, None] - 32.0 * (x @ c.T).astype(float) + (self.centroids**2).sum(axis=1)

    def of(self, profiles: np.ndarray) -> np.ndarray:
        return self.far(profiles).argmin(axis=1)


def _profiles(batches):
    """Rows of BLOCK documents: their marks and profiles."""
    for b in common.slices(batches):
        texts, mark = b.column("text").to_pylist(), b.column("mark").to_numpy()
        x = [_profile((t or "").encode("utf-8", "surrogatepass").lower()).tobytes() for t in texts]
        at = range(0, len(x), BLOCK)
        yield pa.RecordBatch.from_arrays([pa.array([mark[k : k + BLOCK].tobytes() for k in at], pa.binary()), pa.array([b"".join(x[k : k + BLOCK]) for k in at], pa.binary())], ["mark", "x"])


def _blocks(batches, most: int = 128):
    """(marks, profiles) of some thousand documents at a time."""
    for b in common.slices(batches, most):
        yield tuple(np.frombuffer(b"".join(b.column(c).to_pylist()), dtype=d) for c, d in (("mark", np.int64), ("x", np.uint8)))


def find_topics(train: DataFrame, seed: int = 3) -> Topics:
    """Topics by k-means over the profiles of all rows of ``train``, each start far from the others (k-means++).

    A step is a pass over the written profiles. Its sums are of whole numbers
    and draws follow from hashes of texts, so the result is the same however
    rows are partitioned; the driver gets one row for each topic.
    """
    rows = common.materialise(train.select(F.xxhash64(F.lit(seed), "text").alias("mark"), "text").mapInArrow(_profiles, "mark binary, x binary"), "profiles")
    centroids = np.zeros((0, PROFILE), dtype=np.int64)

    def drawn(topics: Topics, step: int):
        """Of each task the row whose draw is least; chances are in proportion to the distance from the nearest centroid."""

        def run(batches):
            best = None
            for mark, x in _blocks(batches):
                x = x.reshape(-1, PROFILE)
                d = topics.far(x).min(axis=1) if len(topics.centroids) else np.ones(len(x))
                h = _draw(mark, step)
                with np.errstate(divide="ignore"):
                    z = np.where(d > 0, -np.log(h) / d, np.inf)
                k = np.lexsort((mark, z))[0]
                if np.isfinite(z[k]) and (best is None or (z[k], mark[k]) < best[:2]):
                    best = z[k], mark[k], x[k].tobytes()
            if best:
                yield pa.RecordBatch.from_arrays([pa.array([best[0]]), pa.array([best[1]]), pa.array([best[2]], pa.binary())], ["z", "mark", "x"])

        return rows.mapInArrow(run, "z double, mark long, x binary").orderBy("z", "mark").limit(1).collect()

    for step in range(TOPICS):
        got = drawn(Topics(centroids), step)
        # fewer profiles than topics: the others stay empty
        new = 16 * np.frombuffer(bytes(got[0]["x"]), dtype=np.uint8).astype(np.int64) if got else centroids[0] if len(centroids) else np.zeros(PROFILE, dtype=np.int64)
        centroids = np.concatenate([centroids, new[None, :]])

    def summed(topics: Topics):
        def run(batches):
            n, sums = np.zeros(TOPICS, dtype=np.int64), np.zeros((TOPICS, PROFILE), dtype=np.int64)
            for _, x in _blocks(batches):
                x = x.reshape(-1, PROFILE)
                near = topics.of(x)
                n += np.bincount(near, minlength=TOPICS)
                sums += ((near[None, :] == np.arange(TOPICS)[:, None]).astype(np.float32) @ x.astype(np.float32)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(TOPICS)), pa.array(n), pa.array([s.tobytes() for s in sums], pa.binary())], ["z", "n", "sums"])

        def add(batches):
            n, sums = np.zeros(TOPICS, dtype=np.int64), np.zeros((TOPICS, PROFILE), dtype=np.int64)
            for b in batches:
                for z, k, raw in zip(*(b.column(c).to_pylist() for c in ("z", "n", "sums")), strict=True):
                    n[z] += k
                    sums[z] += np.frombuffer(raw, dtype=np.int64)
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some]), pa.array([s.tobytes() for s in sums[some]], pa.binary())], ["z", "n", "sums"])

        kind = "z long, n long, sums binary"
        return rows.mapInArrow(run, kind).repartition(TOPICS, "z").mapInArrow(add, kind).collect()

    for _ in range(STEPS):
        was = centroids.copy()
        for r in summed(Topics(was)):
            centroids[r["z"]] = np.rint(16 * np.frombuffer(bytes(r["sums"]), dtype=np.int64) / r["n"]).astype(np.int64)
        if np.array_equal(was, centroids):
            break
    common.release(rows)
    return Topics(centroids)


def _draw(mark: np.ndarray, step: int) -> np.ndarray:
    """Numbers above 0, below 1, that follow from marks."""
    h = (mark.view(np.uint64) + np.uint64(step)) * _K[0]
    h ^= h >> np.uint64(31)
    h *= _K[1]
    h ^= h >> np.uint64(29)
    return ((h >> np.uint64(12)).astype(float) + 0.5) / 2.0**52


def count_words(train: DataFrame, topics: Topics) -> DataFrame:
    """(word, c, topic) over all training tokens: the count and the topic in whose documents most of it stands."""
    sent = train.sparkSession.sparkContext.broadcast(topics)

    def run(batches):
        held = [Counter() for _ in range(TOPICS)]

        def flush():
            for z, n in enumerate(held):
                if n:
                    yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array([z] * len(n), pa.int32()), pa.array(list(n.values()), pa.int64())], ["word", "z", "n"])
                    n.clear()

        for b in common.slices(batches):
            texts = b.column("text").to_pylist()
            for lo, hi in common.groups_by_size(texts):
                raw = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts[lo:hi]]
                for d, z in zip(raw, sent.value.of(np.stack([_profile(d) for d in raw])), strict=True):
                    held[z].update(d.split())
                    held[z][END] += 1
                if sum(map(len, held)) > 400_000:
                    yield from flush()
        yield from flush()

    parts = train.select("text").mapInArrow(run, "word binary, z int, n long")
    sums = parts.groupBy("word").agg(*[F.sum(F.when(F.col("z") == z, F.col("n")).otherwise(0)).alias(f"n{z}") for z in range(TOPICS)])
    total = sum((F.col(f"n{z}") for z in range(TOPICS)), F.lit(0).cast("long"))
    best = F.array_max(F.array(*[F.struct(F.col(f"n{z}").alias("n"), F.lit(-z).alias("z")) for z in range(TOPICS)]))
    return common.materialise(sums.select("word", total.alias("c"), (-best["z"]).alias("topic")), "words")


class Endings:
    """The topic of any word by its last four to one bytes without outer marks, learned from the head."""

    def __init__(self, words: list[bytes], counts: np.ndarray, topics: np.ndarray):
        sums: dict[bytes, np.ndarray] = {}
        for w, c, z in zip(words, counts, topics, strict=True):
            e = w.rstrip(MARKS)
            for k in range(1, min(4, len(e)) + 1):
                if e[-k:] not in sums:
                    sums[e[-k:]] = np.zeros(TOPICS)
                sums[e[-k:]][z] += np.log1p(c)
        self.best = {e: int(s.argmax()) for e, s in sums.items()}

    def of(self, word: bytes) -> int:
        e = word.rstrip(MARKS)
        best = self.best
        for k in (4, 3, 2, 1):
            z = best.get(e[-k:])
            if z is not None:
                return z
        return 0


@dataclass
class Vocabulary:
    """What every task knows of words. Symbols: a head word's number, HEAD + topic for others, HEAD + TOPICS before the start."""

    number: dict[bytes, int]
    endings: Endings
    symbol_class: np.ndarray
    in_class: np.ndarray  # log10 P(word | class) of head words
    base: np.ndarray  # log10 of head words' base probability
    end_base: float
    tail_known: np.ndarray  # for each class of other words: log10 of what a count + 0.1 is multiplied with
    tail_unknown: np.ndarray  # log10 P(a word never counted | class)
    base_scale: float
    log_prior: np.ndarray  # of classes, in natural logarithms; -30 where a class has no words
    total: int
    end_known: bool

    def symbols(self, words: list[bytes]) -> np.ndarray:
        if not isinstance(self.number, _Symbols):
            self.number = _Symbols(self.number, self.endings)
        return np.fromiter(map(self.number.__getitem__, words), dtype=np.int64, count=len(words))


class _Symbols(dict):
    """Numbers of head words, and symbols of others by their ending."""

    def __init__(self, number: dict[bytes, int], endings: Endings):
        super().__init__(number)
        self.endings = endings

    def __missing__(self, word: bytes) -> int:
        return HEAD + self.endings.of(word)

    def __reduce__(self):
        return _Symbols, (dict(self), self.endings)


def vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[Vocabulary, DataFrame]:
    """The shared vocabulary, and (word, c) of all other words.

    Head words are those with a count at least so high that no more than
    ``head`` have it, and of 4 at least; the driver learns where from counts by
    sixteenths of a doubling. In a class of other words, the words never counted
    together have the share of those counted once (Good and Turing).
    """
    real = counts.where(F.col("word") != F.lit(END))
    step = F.floor(F.log2("c") * 16)
    steps = sorted(((r["s"], r["k"]) for r in real.groupBy(step.alias("s")).agg(F.count("*").alias("k")).collect()), reverse=True)
    least, used = None, 0
    for s, k in steps:
        if used + k > head or s < 32:
            break
        least, used = s, used + k
    totals = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = int(totals["n"]), int(totals["v"])
    end = counts.where(F.col("word") == F.lit(END)).select("c").collect()
    end_c = int(end[0]["c"]) if end else 0
    top = real.where(step >= least).select("word", "c", "topic").toArrow() if least is not None else None
    words = [] if top is None else top.column("word").to_pylist()
    c = np.array([] if top is None else top.column("c").to_numpy(), dtype=np.int64)
    z = np.array([] if top is None else top.column("topic").to_numpy(), dtype=np.int64)
    order = np.lexsort((np.array(words, dtype=object), -c)) if len(words) else np.empty(0, dtype=np.int64)
    words, c, z = [words[i] for i in order], c[order], z[order]
    endings = Endings(words, c, z)
    symbol_class = np.full(HEAD + TOPICS + 1, END_CLASS, dtype=np.int64)
    symbol_class[HEAD : HEAD + TOPICS] = TOPICS * BANDS + np.arange(TOPICS)
    in_class = np.zeros(len(words))
    for t in range(TOPICS):
        mine = np.flatnonzero(z == t)
        if not len(mine):
            continue
        share = (np.cumsum(c[mine]) - c[mine]) / c[mine].sum()
        band = np.minimum((share * BANDS).astype(np.int64), BANDS - 1)
        symbol_class[mine] = t * BANDS + band
        for b in range(BANDS):
            some = mine[band == b]
            if len(some):
                in_class[some] = np.log10(c[some] / c[some].sum())
    rest = real.where(step < least) if least is not None else real
    sent = counts.sparkSession.sparkContext.broadcast(endings)

    def by_topic(batches):
        n, v, once = (np.zeros(TOPICS, dtype=np.int64) for _ in range(3))
        for b in batches:
            t = np.fromiter((sent.value.of(w) for w in b.column("word").to_pylist()), dtype=np.int64, count=b.num_rows)
            c = b.column("c").to_numpy()
            n += np.bincount(t, weights=c, minlength=TOPICS).astype(np.int64)
            v += np.bincount(t, minlength=TOPICS)
            once += np.bincount(t[c == 1], minlength=TOPICS)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(TOPICS)), pa.array(n), pa.array(v), pa.array(once)], ["z", "n", "v", "once"])

    sums = np.zeros((TOPICS, 3))
    for r in rest.select("word", "c").mapInArrow(by_topic, "z long, n long, v long, once long").groupBy("z").agg(F.sum("n").alias("n"), F.sum("v").alias("v"), F.sum("once").alias("once")).collect():
        sums[r["z"]] = r["n"], r["v"], r["once"]
    new = np.where(sums[:, 1] > 0, np.clip((sums[:, 2] + 0.5) / (sums[:, 0] + 1), 1e-9, 0.9), 1.0)
    tail_known = np.log10(np.maximum(1 - new, 1e-300)) - np.log10(np.maximum(sums[:, 0] + 0.1 * sums[:, 1], 0.1))
    class_counts = np.bincount(symbol_class[: len(c)], weights=c, minlength=CLASSES)
    class_counts[TOPICS * BANDS : END_CLASS] = sums[:, 0] + 0.5
    class_counts[END_CLASS] = end_c
    log_prior = np.where(class_counts > 0, np.log(np.maximum(class_counts, 1e-300) / max(class_counts.sum(), 1e-300)), -30.0).astype(np.float32)
    base_scale = float(np.log10(total + 0.1 * (distinct + 1)))
    number = {w: i for i, w in enumerate(words)}
    return Vocabulary(number, endings, symbol_class, in_class, np.log10(c + 0.1) - base_scale, float(np.log10(end_c + 0.1)) - base_scale, tail_known, np.log10(new), base_scale, log_prior, total, end_c > 0), rest.select("word", "c")


def features(symbols: np.ndarray, lengths: np.ndarray, symbol_class: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For the words and the end of each document: rows of four hashed features, and the class to be predicted.

    symbols: words of all documents, one after the other; lengths: words of each.
    """
    start = HEAD + TOPICS
    n = len(lengths)
    ends = np.cumsum(lengths + 4)  # three starts before and an end after each
    seq = np.full(int(ends[-1]) if n else 0, start, dtype=np.int64)
    own = np.ones(len(seq), dtype=bool)
    for k in (0, 1, 2):
        own[ends - lengths - 4 + k] = False
    last = np.zeros(len(seq), dtype=bool)
    last[ends - 1] = True
    seq[own & ~last] = symbols
    at = np.flatnonzero(own)
    w1, w2, w3 = (seq[at - k].astype(np.uint64) for k in (1, 2, 3))
    c1, c2, c3 = (symbol_class[seq[at - k]].astype(np.uint64) for k in (1, 2, 3))
    f = np.stack([w1 * _K[0] + _K[1], w2 * _K[1] + _K[2], (w1 * _K[2] + w2) * _K[3] + _K[4], ((c1 * np.uint64(64) + c2) * np.uint64(64) + c3) * _K[0] + _K[3]])
    f ^= f >> np.uint64(29)
    f *= _K[4]
    goal = np.where(last[at], END_CLASS, symbol_class[seq[at]])
    return (f >> np.uint64(49)).astype(np.int64), goal


def softmax(weights: np.ndarray, bias: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Scores of all classes, their exponentials and the sums of these, for each row of hashed features."""
    z = weights[f[0]]
    for k in range(1, len(f)):
        z += weights[f[k]]
    z += bias
    e = np.exp(z)
    total = e.sum(axis=1)
    if not (np.isfinite(total).all() and total.min() > 1e-30):  # scores too large or small for plain exponentials
        z -= z.max(axis=1, keepdims=True)
        e = np.exp(z)
        total = e.sum(axis=1)
    return z, e, total


def _sum_by_row(rows: np.ndarray, g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct rows, the sums of g over each, and how often each occurs."""
    order = np.argsort(rows.astype(np.uint16), kind="stable")  # a radix sort at 16 bits
    r = rows[order]
    first = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
    n = np.diff(np.append(first, len(r)))
    out = g[order[first]]
    some = np.flatnonzero((n > 1) & (n <= 16))
    k = 1
    while len(some):  # the second of each row, then the third, ...
        out[some] += g[order[first[some] + k]]
        k += 1
        some = some[n[some] > k]
    for i in np.flatnonzero(n > 16):
        out[i] = g[order[first[i] : first[i] + n[i]]].sum(axis=0)
    return r[first], out, n


def _documents(texts: list, vocab: Vocabulary, most: int = 600_000):
    for lo, hi in common.groups_by_size(texts, most):
        docs = [_lower(t) for t in texts[lo:hi]]
        lengths = np.array([len(d) for d in docs], dtype=np.int64)
        flat = list(chain.from_iterable(docs))
        yield lo, docs, lengths, flat, vocab.symbols(flat)


def _in_order(batches, most: int = 600_000):
    """(shard, texts) from rows sorted by shard; cut by size alone, not where Arrow's batches end."""
    shard, held, size = None, [], 0
    for b in common.slices(batches):
        for s, t in zip(b.column("shard").to_pylist(), b.column("text").to_pylist(), strict=True):
            n = len(t) if t else 0
            if held and (s != shard or size + n > most):
                yield shard, held
                held, size = [], 0
            shard = s
            held.append(t)
            size += n
    if held:
        yield shard, held


class _Walk:
    """Gradient steps over one shard, from weights that all shards share."""

    def __init__(self, weights: np.ndarray, bias: np.ndarray, rate: float):
        self.start, self.rate, self.steps = (weights, bias), rate, 0
        self.w, self.b = weights.copy(), bias.copy()
        self.scale = np.full(HASHED, 1e-2, dtype=np.float32)
        self.touched = np.zeros(HASHED, dtype=np.int64)

    def step(self, f: np.ndarray, goal: np.ndarray) -> None:
        _, g, total = softmax(self.w, self.b, f)
        g /= total[:, None]
        g[np.arange(len(goal)), goal] -= 1
        self.steps += 1
        self.b -= self.rate / np.sqrt(self.steps) * g.mean(axis=0)
        for rows in f:
            u, s, n = _sum_by_row(rows, g)
            self.scale[u] += np.einsum("ij,ij->i", s, s)
            s *= (self.rate / np.sqrt(self.scale[u]))[:, None]
            self.w[u] -= s
            self.touched[u] += n

    def blocks(self, shard: int, block: int):
        """What the shard changed, by blocks of rows; rows weigh as often as they were touched."""
        change = (self.w - self.start[0]) * self.touched[:, None].astype(np.float32)
        bias = ((self.b - self.start[1]) * self.steps).astype(np.float64).tobytes()
        for k in range(0, HASHED, block):
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([shard]), pa.array([change[k : k + block].tobytes()], pa.binary()), pa.array([self.touched[k : k + block].tobytes()], pa.binary()), pa.array([self.steps]), pa.array([bias], pa.binary())], ["k", "shard", "change", "touched", "steps", "bias"])


def train_round(train: DataFrame, sent_vocab, weights: np.ndarray, bias: np.ndarray, rate: float = 0.15, shards: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Every shard takes gradient steps over its documents from the same weights; rows are averaged by touches.

    Shards are dealt by a hash of id and text and walked in order of id, and
    their changes are added in order of shard, so the result is the same however
    ``train(doc_id, text)`` is partitioned and however many tasks run.
    """
    sent = train.sparkSession.sparkContext.broadcast((weights, bias))
    block = 512

    def run(batches):
        vocab, walk, at = sent_vocab.value, None, None
        for shard, texts in _in_order(batches):
            if shard != at:
                if walk:
                    yield from walk.blocks(at, block)
                walk, at = _Walk(*sent.value, rate), shard
            for _, _, lengths, _, symbols in _documents(texts, vocab):
                f, goal = features(symbols, lengths, vocab.symbol_class)
                for lo in range(0, len(goal), BATCH):
                    walk.step(f[:, lo : lo + BATCH], goal[lo : lo + BATCH])
        if walk:
            yield from walk.blocks(at, block)

    def add(batches):
        sums: dict[int, list] = {}
        for batch in batches:
            for r in batch.to_pylist():
                s = sums.setdefault(r["k"], [np.zeros(block * CLASSES), np.zeros(block, dtype=np.int64), 0, np.zeros(CLASSES)])
                s[0] += np.frombuffer(r["change"], dtype=np.float32)
                s[1] += np.frombuffer(r["touched"], dtype=np.int64)
                s[2] += r["steps"]
                s[3] += np.frombuffer(r["bias"])
        for k, s in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([s[0].tobytes()], pa.binary()), pa.array([s[1].tobytes()], pa.binary()), pa.array([s[2]]), pa.array([s[3].tobytes()], pa.binary())], ["k", "change", "touched", "steps", "bias"])

    kind = "k long, change binary, touched binary, steps long, bias binary"
    weights, bias = weights.copy(), bias.copy()
    tasks = min(shards, TASKS)
    dealt = train.select(F.pmod(F.xxhash64(F.lit(23), "doc_id", "text"), F.lit(shards)).alias("shard"), "doc_id", F.xxhash64("text").alias("mark"), "text")
    dealt = dealt.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "doc_id", "mark").select("shard", "text")
    changes = dealt.mapInArrow(run, "k long, shard long, change binary, touched binary, steps long, bias binary")
    for r in changes.repartition("k").sortWithinPartitions("k", "shard").mapInArrow(add, kind).toLocalIterator():
        n = np.frombuffer(r["touched"], dtype=np.int64)
        weights[r["k"] : r["k"] + block] += (np.frombuffer(r["change"]).reshape(block, CLASSES) / np.maximum(n, 1)[:, None]).astype(np.float32)
        if r["k"] == 0:
            bias += (np.frombuffer(r["bias"]) / max(r["steps"], 1)).astype(np.float32)
    return weights, bias


@dataclass
class Model:
    vocab: Vocabulary
    weights: np.ndarray
    bias: np.ndarray
    tail: DataFrame

    def __getstate__(self):
        raise TypeError("send its parts")


def fit(train: DataFrame, rounds: int = ROUNDS) -> Model:
    """Count and train over all rows of ``train(doc_id, text)``, each of which takes part in one of the rounds.

    The number of shards of a round grows with the tokens of the table and
    depends on nothing else.
    """
    common.text_batches(train.sparkSession)
    counts = count_words(train, find_topics(train))
    vocab, tail = vocabulary(counts)
    sent = train.sparkSession.sparkContext.broadcast(vocab)
    weights, bias = np.zeros((HASHED, CLASSES), dtype=np.float32), vocab.log_prior
    shards = max(1, -(-vocab.total // (rounds * SHARD)))
    for k in range(rounds):
        weights, bias = train_round(train.where(F.pmod(F.xxhash64(F.lit(17), "doc_id"), F.lit(rounds)) == k), sent, weights, bias, shards=shards)
    return Model(vocab, weights, bias, tail)


def score(docs: DataFrame, model: Model, modulus: int = 10) -> DataFrame:
    """``docs(doc_id, text)`` to the contract's columns and ``score``, log10 of the model's probability of the text and its end.

    Null and empty texts are the end alone. Words never counted are one outcome
    in the class of their ending. Without any
    training token every word has probability 1 in base and score. Null ids
    count as held out; repeated rows keep their rows; other columns are
    ignored; an empty table gives an empty result.
    """
    sc = docs.sparkSession.sparkContext
    sent, sent_weights = sc.broadcast(model.vocab), sc.broadcast((model.weights, model.bias))

    def run(batches):
        from pyspark import TaskContext

        vocab, (w, bias) = sent.value, sent_weights.value
        key = TaskContext.get().partitionId() << 40
        for b in common.slices(batches, 2000):
            texts, ids, held = b.column("text").to_pylist(), b.column("doc_id"), b.column("held_out")
            for lo, docs_, lengths, flat, symbols in _documents(texts, vocab):
                f, goal = features(symbols, lengths, vocab.symbol_class)
                p = np.empty(len(goal))
                for at in range(0, len(goal), BATCH):
                    g = goal[at : at + BATCH]
                    z, _, sums = softmax(w, bias, f[:, at : at + BATCH])
                    p[at : at + BATCH] = z[np.arange(len(g)), g] - np.log(sums)
                edges = np.concatenate([[0], np.cumsum(lengths + 1)])
                by_class = np.add.reduceat(p, edges[:-1]) / np.log(10) if len(lengths) else p
                head = symbols < HEAD
                inner, base = np.zeros(len(symbols)), np.full(len(symbols), -vocab.base_scale)
                inner[head], base[head] = vocab.in_class[symbols[head]], vocab.base[symbols[head]]
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (inner, base, head.astype(np.int64))]
                word_edges = np.concatenate([[0], np.cumsum(lengths)])
                inner, base, n_head = (s[word_edges[1:]] - s[word_edges[:-1]] for s in sums)
                others = np.flatnonzero(~head)
                spans = np.searchsorted(others, word_edges).tolist()
                others = others.tolist()
                tails = [Counter([flat[i] for i in others[x:y]]) for x, y in zip(spans, spans[1:], strict=False)]
                topic = vocab.endings.of
                total = by_class + inner if vocab.total else np.zeros(len(docs_))
                n = len(docs_)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.arange(key, key + n)), ids.slice(lo, n), held.slice(lo, n), pa.array(lengths + 1), pa.array(n_head.astype(np.int64) + int(vocab.end_known)), pa.array(base + vocab.end_base), pa.array(total), pa.array([list(t) for t in tails], pa.list_(pa.binary())), pa.array([[topic(w) for w in t] for t in tails], pa.list_(pa.int32())), pa.array([list(t.values()) for t in tails], pa.list_(pa.int32()))],
                    ["key", "doc_id", "held_out", "n_tokens", "n_head", "base", "score", "tail", "tail_z", "tail_n"],
                )
                key += n

    held = common.doc_ids_mod("doc_id", modulus) == 0
    rows = common.materialise(docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(run, ROWS), "scored")
    tail = rows.select("key", F.explode(F.arrays_zip("tail", "tail_z", "tail_n")).alias("t")).select("key", F.col("t.tail").alias("word"), F.col("t.tail_z").alias("z"), F.col("t.tail_n").alias("n"))
    c = F.coalesce(F.col("c"), F.lit(0))
    of_class = lambda x: F.element_at(F.array(*[F.lit(float(v)) for v in x]), F.col("z") + 1)
    plain = F.log10(c + 0.1)
    inner = F.when(c > 0, plain + of_class(model.vocab.tail_known)).otherwise(of_class(model.vocab.tail_unknown))
    sums = tail.join(model.tail, "word", "left").groupBy("key").agg(F.sum(F.col("n") * plain).alias("log_tail"), F.sum(F.col("n") * inner).alias("log_inner"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("n_tail"))
    out = rows.drop("tail", "tail_z", "tail_n").join(sums, "key", "left")
    log_tail = F.coalesce("log_tail", F.lit(0.0))
    learned = F.coalesce("log_inner", F.lit(0.0)) if model.vocab.total else F.col("base") - F.col("score") + log_tail
    return out.select("doc_id", "held_out", "n_tokens", (F.col("n_head") + F.coalesce("n_tail", F.lit(0))).alias("n_known"), F.lit(model.vocab.total).cast("long").alias("train_tokens"), (F.col("base") + log_tail).alias("base_score"), (F.col("score") + learned).alias("score"))


def op8_maxent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    return score(docs, fit(docs.where(common.doc_ids_mod("doc_id", 10) != 0)))


QUERIES = {"op8_maxent_lm": op8_maxent_lm}
ORACLE: dict[str, str] = {}
