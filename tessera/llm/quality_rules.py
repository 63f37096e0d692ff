"""Quality rules: text statistics, plain limits, and an isolation forest on the statistics.

The forest's path lengths tell how anomalous a document is, and its splits by
which statistic. For each statistic, labelled rows calibrate from which anomaly
score the documents isolated by it are rejected: much repetition may be common
in good texts where few symbols are not.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

_SYMBOLS = b"#*$%&|<>"
_UPPER = bytes(range(ord("A"), ord("Z") + 1))
STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_upper", "n_marks", "n_lines")
SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, anomaly double, isolated_by string, kept boolean"
#: Trees, and rows that each is grown from, at least; the depth of a tree follows from these.
TREES, PER_TREE = 100, 256


def statistics(text: str | None) -> tuple[int, ...]:
    """The rule statistics of a whole text, in the order of STATS; all 0 for a null or empty text."""
    if not text:
        return (0,) * len(STATS)
    raw = text.encode("utf-8", "surrogatepass")
    w = raw.split()
    n = len(w)
    spaces = sum(map(text.count, common.SPACES))
    lines = [x for x in text.split("\n") if x.strip(common.SPACES)] if n else []
    repeat = 0
    triples = list(zip(w, w[1:], w[2:], strict=False))
    if len(set(triples)) < len(triples):
        seen = Counter(triples)
        upto = 0  # words before this one are counted
        for i, t in enumerate(triples):
            if seen[t] > 1:
                repeat += i + 3 - max(upto, i)
                upto = i + 3
    upper = len(raw) - len(raw.translate(None, _UPPER))
    marks = raw.count(b"!") + raw.count(b"?")
    return n, len(text) - spaces, len(raw) - len(raw.translate(None, _SYMBOLS)), len(lines) - len(set(lines)), repeat, upper, marks, len(lines)


def base_failed(n_words, n_repeat_words, min_words: int = 50, max_repeat: int = 50):
    return (n_words < min_words) | (100 * n_repeat_words > max_repeat * n_words)


#: What the forest sees of a text.
FEATURES = ("log_words", "word_length", "symbols", "dup_lines", "repeat_words", "capitals", "marks")


def features(stats: np.ndarray) -> np.ndarray:
    """The columns of FEATURES: the logarithm of words, characters a word, and the raw rates of the other statistics."""
    s = np.asarray(stats, dtype=float).reshape(-1, len(STATS))
    words, chars, lines = (np.maximum(s[:, k], 1) for k in (0, 1, 7))
    return np.column_stack([np.log(words), s[:, 1] / words, s[:, 2] / words, s[:, 3] / lines, s[:, 4] / words, s[:, 5] / chars, s[:, 6] / words])


@dataclass
class Forest:
    """Isolation trees as arrays: split feature (-1 in leaves), threshold, left child (right is next), leaf path length, and how many halvings of the rows lead into a node."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    path: np.ndarray
    gain: np.ndarray
    depth: int
    scale: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """2 ** -(mean path / expected path): towards 1 for rows that few splits isolate."""
        return self.explain(x)[0]

    def explain(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores, and the feature whose splits left most rows behind on the paths of each row; the first of equal ones."""
        out, by = np.empty(len(x)), np.zeros((len(x), x.shape[1]))
        trees = np.arange(len(self.feature))[None, :]
        for lo in range(0, len(x), 2048):
            part = x[lo : lo + 2048]
            at = np.zeros((len(part), len(self.feature)), dtype=np.int64)
            for _ in range(self.depth):
                f = self.feature[trees, at]
                go = np.take_along_axis(part, np.maximum(f, 0), axis=1) >= self.cut[trees, at]
                at = np.where(f >= 0, self.left[trees, at] + go, at)
                gain = self.gain[trees, at]
                for j in range(x.shape[1]):
                    by[lo : lo + 2048, j] += np.where(f == j, gain, 0.0).sum(axis=1)
            out[lo : lo + 2048] = self.path[trees, at].mean(axis=1)
        return 2.0 ** -(out / self.scale), by.argmax(axis=1) if x.shape[1] else np.zeros(len(x), dtype=np.int64)


def _expected(n: float) -> float:
    return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (np.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


class _Growing:
    """Trees that grow by a level at a time from what their nodes hold: rows, and least and greatest values. Children of node i are 2i + 1 and 2i + 2."""

    def __init__(self, trees: int, per_tree: int, width: int, seed: int):
        self.limit, self.width, self.seed = max(1, int(np.ceil(np.log2(max(per_tree, 2))))), width, seed
        self.size = 2 ** (self.limit + 1)
        self.feature, self.left = np.full((trees, self.size), -1, dtype=np.int64), np.zeros((trees, self.size), dtype=np.int64)
        self.cut, self.path, self.gain = (np.zeros((trees, self.size)) for _ in range(3))
        self.rows = np.zeros((trees, self.size), dtype=np.int64)

    def held(self, x: np.ndarray, tree: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For the nodes of a level that rows ``x`` of trees ``tree`` reach: node (tree * size + number), rows, least and greatest values."""
        at = np.zeros(len(x), dtype=np.int64)
        for _ in range(level):
            f = self.feature[tree, at]
            go = x[np.arange(len(x)), np.maximum(f, 0)] >= self.cut[tree, at]
            at = np.where(f >= 0, self.left[tree, at] + go, -1)
            x, tree, at = x[at >= 0], tree[at >= 0], at[at >= 0]
        node = tree * self.size + at
        order = np.argsort(node, kind="stable")
        node, x = node[order], x[order]
        first = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.empty(0, dtype=np.int64)
        least, most = (f.reduceat(x, first) if len(first) else x[:0] for f in (np.minimum, np.maximum))
        return node[first], np.diff(np.append(first, len(node))), least, most

    def split(self, node: np.ndarray, n: np.ndarray, least: np.ndarray, most: np.ndarray, level: int) -> None:
        """Every node of ``level`` gets a random split, or the path length of a leaf."""
        for i in np.argsort(node).tolist():
            t, k = divmod(int(node[i]), self.size)
            self.rows[t, k] = n[i]
            if k:
                self.gain[t, k] = np.log2(self.rows[t, (k - 1) // 2] / n[i])
            spread = np.flatnonzero(least[i] < most[i])
            if level >= self.limit or not len(spread):
                self.path[t, k] = level + _expected(n[i])
                continue
            rng = np.random.default_rng([self.seed, t, k])
            f = rng.choice(spread)
            c = rng.uniform(least[i, f], most[i, f])
            self.feature[t, k], self.cut[t, k], self.left[t, k] = f, c if c > least[i, f] else most[i, f], 2 * k + 1

    def forest(self) -> Forest:
        # rows of a tree on average; a child has rows, as cuts are above the least value and not above the greatest
        return Forest(self.feature, self.cut, self.left, self.path, self.gain, self.limit, max(_expected(self.rows[:, 0].mean()), 1.0))


def grow(x: np.ndarray, trees: int = TREES, per_tree: int = PER_TREE, seed: int = 7) -> Forest:
    """Random splits of the rows that follow each other in ``x``, from its start again at its end; without rows every path is as long as expected."""
    per_tree = min(per_tree, max(len(x), 1))
    new = _Growing(trees, per_tree, x.shape[1], seed)
    tree = np.repeat(np.arange(trees), per_tree) if len(x) else np.empty(0, dtype=np.int64)
    rows = x[np.arange(len(tree)) % max(len(x), 1)]
    for level in range(new.limit + 1):
        new.split(*new.held(rows, tree, level), level)
    return new.forest()


def grow_all(stats: DataFrame, trees: int = TREES, per_tree: int = PER_TREE, min_words: int = 50, max_repeat: int = 50, seed: int = 7) -> Forest:
    """As ``grow``, from all rows of ``stats(mark, STATS)`` that pass the base rules, whatever their number.

    Every row is dealt to a tree by ``mark``, and to others too while there are
    fewer than ``per_tree`` rows for each, in steps that also follow from
    ``mark`` so that no two trees share most rows. A level is one pass:
    tasks send the rows, least and greatest values of nodes, which are
    aggregated, so the driver gets one row for each node at most.
    """
    spark = stats.sparkSession
    # words and repeats are whole numbers far below 2**53, and the rule is that of base_failed
    total = stats.where(~base_failed(F.col("n_words"), F.col("n_repeat_words"), min_words, max_repeat)).count()
    copies = min(trees, -(-trees * per_tree // max(total, 1)))
    new = _Growing(trees, min(per_tree, max(total, 1)), len(FEATURES), seed)
    steps = np.array([k for k in range(1, trees + 1) if np.gcd(k, trees) == 1])
    ends = [f"{e}{j}" for e in ("least", "most") for j in range(len(FEATURES))]
    for level in range(new.limit + 1) if total else ():
        sent = spark.sparkContext.broadcast(new)

        def run(batches, sent=sent, level=level):
            for b in common.slices(batches, 100_000 // copies + 1):
                s = np.column_stack([b.column(c).to_numpy() for c in STATS])
                some = ~base_failed(s[:, 0], s[:, 4], min_words, max_repeat)
                x, mark = features(s[some]), b.column("mark").to_numpy()[some]
                step = steps[(mark // trees) % len(steps)]
                node, n, least, most = sent.value.held(np.tile(x, (copies, 1)), np.concatenate([(mark % trees + k * step) % trees for k in range(copies)]), level)
                yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(n), *(pa.array(c) for c in (*least.T, *most.T))], ["node", "n", *ends])

        found = stats.select("mark", *STATS).mapInArrow(run, "node long, n long, " + ", ".join(f"{c} double" for c in ends))
        got = found.groupBy("node").agg(F.sum("n").alias("n"), *[(F.min if c[0] == "l" else F.max)(c).alias(c) for c in ends]).toArrow()
        x = np.column_stack([got.column(c).to_numpy() for c in ends])
        new.split(got.column("node").to_numpy(), got.column("n").to_numpy(), x[:, : len(FEATURES)], x[:, len(FEATURES) :], level)
        sent.unpersist()
    return new.forest()


def calibrate(score: np.ndarray, good: np.ndarray, all_bad: int | None = None, all_good: int | None = None, weight: float = 20.0) -> float:
    """The score from which documents are rejected: the largest share of ``all_bad`` caught, a lost share of ``all_good`` counting ``weight`` times.

    Of equally good scores the middle of the widest gap; below the least
    labelled score nothing is known, so that score itself is the least. Without
    bad rows, or where no score catches more than it costs, nothing is rejected
    (infinity), and so it is if all labelled rows are good, or there is no good
    one at all. Without totals the given rows are all there are.
    """
    all_bad, all_good = int((~good).sum()) if all_bad is None else all_bad, int(good.sum()) if all_good is None else all_good
    if good.all() or not all_good:
        return float("inf")
    at = np.unique(score)
    caught = ((~good).sum() - np.searchsorted(np.sort(score[~good]), at)) / all_bad
    lost = (good.sum() - np.searchsorted(np.sort(score[good]), at)) / all_good
    value = caught - weight * lost
    if value.max() <= 0:
        return float("inf")
    gap = at - np.concatenate([[at[0]], at[:-1]])
    best = np.flatnonzero(value >= value.max() - 1e-12)
    k = best[int(np.argmax(gap[best]))]
    return float(at[k] - gap[k] / 2)


@dataclass
class Model:
    forest: Forest
    threshold: np.ndarray  # for each feature that isolates
    min_words: int
    max_repeat: int


def _stats_rows(batches):
    for b in common.slices(batches):
        s = np.array([statistics(t) for t in b.column("text").to_pylist()], dtype=np.int64).reshape(-1, len(STATS))
        rest = [b.column(c) for c in b.schema.names if c != "text"]
        yield pa.RecordBatch.from_arrays([*rest, *(pa.array(s[:, k]) for k in range(len(STATS)))], [*(c for c in b.schema.names if c != "text"), *STATS])


_STAT_COLS = ", ".join(f"{c} long" for c in STATS)


def stat_rows(docs: DataFrame) -> DataFrame:
    """``docs`` to doc_id, STATS and ``mark``, a hash of these, one row for each."""
    common.text_batches(docs.sparkSession)
    rows = docs.select("doc_id", "text").mapInArrow(_stats_rows, "doc_id long, " + _STAT_COLS)
    return rows.withColumn("mark", F.xxhash64("doc_id", *STATS))


def written_stats(docs: DataFrame) -> DataFrame:
    """``stat_rows`` as a written table."""
    return common.materialise(stat_rows(docs), "statistics")


#: Parts of the range of scores within which scores are put in order.
SCORE_PARTS = 4096


def calibrate_all(rows: DataFrame, kinds: int, weight: float = 20.0) -> np.ndarray:
    """``calibrate`` for each ``by`` from 0 to ``kinds - 1`` over ``rows(by, score, good)``, scores from 0 to 1, with totals over all of them.

    Rows of any number: scores are put in order within parts of their range, and
    the driver gets the sums of each part.
    """
    counts = rows.groupBy("by", "score").agg(F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    counts = common.materialise(counts.withColumn("part", F.floor(F.col("score") * SCORE_PARTS).cast("int")), "scores")
    parts = counts.groupBy("by", "part").agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), F.max("score").alias("last")).orderBy("by", "part").collect()
    all_good, all_bad = sum(r["good"] for r in parts), sum(r["bad"] for r in parts)
    out = np.full(kinds, np.inf)
    if all_good and all_bad:
        above, good, bad, by = [], 0, 0, None
        for r, below in zip(reversed(parts), [*reversed(parts[:-1]), None], strict=True):
            if r["by"] != by:
                good, bad, by = 0, 0, r["by"]
            above.append((r["by"], r["part"], good, bad, below["last"] if below and below["by"] == by else None))
            good, bad = good + r["good"], bad + r["bad"]
        above = rows.sparkSession.createDataFrame(above, "by int, part int, more_good long, more_bad long, before double")
        up = Window.partitionBy("by", "part").orderBy("score")
        down = Window.partitionBy("by", "part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
        caught = (F.sum("bad").over(down) + F.col("more_bad")) / F.lit(float(all_bad))
        lost = (F.sum("good").over(down) + F.col("more_good")) / F.lit(float(all_good))
        gap = F.col("score") - F.coalesce(F.lag("score").over(up), "before", "score")
        values = counts.join(F.broadcast(above), ["by", "part"]).select("by", "score", (caught - weight * lost).alias("value"), gap.alias("gap"))
        values = common.materialise(values, "values")
        most = values.groupBy("by").agg(F.max("value").alias("most")).where("most > 0")
        best = values.join(F.broadcast(most), "by").where(F.col("value") >= F.col("most") - 1e-12).groupBy("by").agg(F.max(F.struct("gap", (-F.col("score")).alias("less"))).alias("b"))
        for r in best.collect():
            out[r["by"]] = -r["b"]["less"] - r["b"]["gap"] / 2
        common.release(values)
    common.release(counts)
    return out


def fit(docs: DataFrame, labels: DataFrame, min_words: int = 50, max_repeat: int = 50, seed: int = 7, stats: DataFrame | None = None) -> Model:
    """Grow TREES trees from all documents, and set thresholds on all labelled ones.

    Documents that the base rules fail are left out: the forest judges the
    others only. Rows of labels with null doc_id or quality are ignored; of
    repeated ids the least quality counts. stats: ``written_stats(docs)`` where it is at hand.
    """
    seen = written_stats(docs) if stats is None else stats
    forest = grow_all(seen, min_words=min_words, max_repeat=max_repeat, seed=seed)
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = common.salted_join(seen.drop("mark"), known, ["doc_id"]).select("quality", *STATS)
    sent = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches):
        for b in common.slices(batches):
            s = np.column_stack([b.column(c).to_numpy() for c in STATS])
            some = ~base_failed(s[:, 0], s[:, 4], min_words, max_repeat)
            score, by = sent.value.explain(features(s[some]))
            yield pa.RecordBatch.from_arrays([pa.array(by.astype(np.int32)), pa.array(score), pa.array(b.column("quality").to_numpy()[some] > 0)], ["by", "score", "good"])

    threshold = calibrate_all(rows.mapInArrow(run, "by int, score double, good boolean"), len(FEATURES))
    if stats is None:
        common.release(seen)
    return Model(forest, threshold, min_words, max_repeat)


def judge(text_stats: np.ndarray, m: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """base_failed, anomaly score, the feature that isolates, kept."""
    failed = base_failed(text_stats[:, 0], text_stats[:, 4], m.min_words, m.max_repeat)
    score, by = m.forest.explain(features(text_stats))
    return failed, score, by, ~failed & (score < m.threshold[by])


def apply_rules(docs: DataFrame, model: Model, stats: DataFrame | None = None) -> DataFrame:
    """``docs(doc_id, text)`` to statistics, anomaly score and verdict, one row for each input row.

    Null and empty texts have no words and fail the base rules. Null and
    repeated ids keep their rows; other columns are ignored; an empty table
    gives an empty result. stats: ``written_stats(docs)`` where it is at hand.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for b in common.slices(batches):
            s = np.column_stack([b.column(c).to_numpy() for c in STATS])
            failed, score, by, kept = judge(s, m)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(s[:, k]) for k in range(5)), pa.array(failed), pa.array(score), pa.array(np.array(FEATURES)[by], pa.string()), pa.array(kept)], ["doc_id", *STATS[:5], "base_failed", "anomaly", "isolated_by", "kept"])

    seen = stat_rows(docs) if stats is None else stats
    return seen.select("doc_id", *STATS).mapInArrow(run, SCHEMA)


def filter_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    common.text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in common.slices(batches):
            s = np.array([statistics(t) for t in b.column("text").to_pylist()], dtype=np.int64).reshape(-1, len(STATS))
            yield b.filter(pa.array(judge(s, sent.value)[3]))

    return docs.mapInArrow(run, docs.schema)


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    seen = written_stats(docs)
    return apply_rules(docs, fit(docs, common.table(spark, sf_dir, "labels"), stats=seen), seen)


QUERIES = {"op4_quality_rules": op4_quality_rules}
ORACLE: dict[str, str] = {}
