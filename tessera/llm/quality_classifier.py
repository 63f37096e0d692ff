"""Quality classifier by co-training of two views: what a text says, and what is known about its page.

Each view is a logistic model. In every round each model judges all documents
outside the labelled rows and hands the most confident guesses to the other;
held-out labels then calibrate both views and their combination. Both views of
every document are computed once and written, words and marks as sparse rows.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .quality_rules import calibrate

CONTENT, SHAPES = 1024, 255
META_HASHED, META = 40, 45
#: Labelled documents that the views are fitted on, at most; guesses that a view hands over in a round.
LABELLED_ROWS, EXCHANGED = 6_000, 300
VIEWS = "at binary, value binary, meta binary"
OUT = "doc_id long, content_score double, metadata_score double, score double, kept boolean"

_RUN = re.compile(r"(.)\1+", re.S)
_CLASSES = str.maketrans({**{chr(c): "A" for c in range(65, 91)}, **{chr(c): "a" for c in range(97, 123)}, **{chr(c): "0" for c in range(48, 58)}})


class _Terms(dict):
    """Feature numbers (shape, ending) of words; forgotten when there are many."""

    def __missing__(self, w: str) -> tuple[int, int]:
        if len(self) >= 150_000:
            self.clear()
        shape = _RUN.sub(r"\1", "".join(c if ord(c) < 128 else "A" if c.isupper() else "a" for c in w).translate(_CLASSES))
        end = w.lower().rstrip(".,;:!?")[-3:]
        v = self[w] = (1 + zlib.crc32(shape.encode("utf-8", "surrogatepass")) % SHAPES, 1 + SHAPES + zlib.crc32(end.encode("utf-8", "surrogatepass")) % (CONTENT - 1 - SHAPES))
        return v


_terms = _Terms()
common.register_cache("quality_classifier", _terms.clear)


def content_view(text: str | None) -> np.ndarray:
    """Square roots of the shares of word shapes and word endings, and the share of words equal to the one before."""
    out = np.zeros(CONTENT, dtype=np.float32)
    w = [x.decode("utf-8", "surrogatepass") for x in common.words(text)]
    if w:
        pairs = np.fromiter((i for x in w for i in _terms[x]), dtype=np.int64, count=2 * len(w))
        out += np.sqrt(np.bincount(pairs, minlength=CONTENT) / len(w)).astype(np.float32)
        out[0] = sum(map(str.__eq__, w, w[1:])) / len(w)
    return out


def metadata_view(lang, source, n_chars) -> np.ndarray:
    """Hashed language and source, and the stated length; nulls have features of their own. The text is not looked at."""
    out = np.zeros(META, dtype=np.float32)
    out[zlib.crc32(b"l" + (lang or "\0").encode("utf-8", "surrogatepass")) % 8] = 1
    out[8 + zlib.crc32(b"s" + (source or "\0").encode("utf-8", "surrogatepass")) % (META_HASHED - 8)] = 1
    out[META_HASHED:] = (1, np.log1p(max(0, n_chars or 0)) / 10, n_chars is None, lang is None, source is None)
    return out


class Sparse:
    """Content views of some documents: places and values of what is not zero, one document after the other."""

    def __init__(self, at: np.ndarray, value: np.ndarray, lengths: np.ndarray):
        self.at, self.value, self.lengths = at, value, lengths
        self.row = np.repeat(np.arange(len(lengths)), lengths)

    def __matmul__(self, w: np.ndarray) -> np.ndarray:
        return np.bincount(self.row, weights=self.value * w[self.at], minlength=len(self.lengths))

    def dense(self) -> np.ndarray:
        out = np.zeros((len(self.lengths), CONTENT), dtype=np.float32)
        out[self.row, self.at] = self.value
        return out


def _views(b: pa.RecordBatch) -> list[pa.Array]:
    """The columns of VIEWS for a batch of documents."""
    content = [content_view(t) for t in b.column("text").to_pylist()]
    at = [np.flatnonzero(x) for x in content]
    meta = [metadata_view(*x).tobytes() for x in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "n_chars")), strict=True)]
    parts = [x.astype(np.uint16).tobytes() for x in at], [x[i].tobytes() for x, i in zip(content, at, strict=True)], meta
    return [pa.array(x, pa.binary()) for x in parts]


def _flat(column, dtype: str) -> tuple[np.ndarray, np.ndarray]:
    """All numbers of a binary column, and how many each row has, without a Python object for each row."""
    size, flat, lengths = np.dtype(dtype).itemsize, [np.empty(0, dtype)], [np.empty(0, np.int64)]
    for c in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(c):
            kind = np.dtype("int64" if pa.types.is_large_binary(c.type) else "int32")
            edges = np.frombuffer(c.buffers()[1], dtype=kind, count=len(c) + 1, offset=c.offset * kind.itemsize).astype(np.int64)
            n = int(edges[-1] - edges[0]) // size
            if n:
                flat.append(np.frombuffer(c.buffers()[2], dtype=dtype, count=n, offset=int(edges[0])))
            lengths.append(np.diff(edges) // size)
    return np.concatenate(flat), np.concatenate(lengths)


def _read(at, value, meta) -> tuple[Sparse, np.ndarray]:
    places, lengths = _flat(at, "uint16")
    return Sparse(places, _flat(value, "float32")[0], lengths), _flat(meta, "float32")[0].reshape(-1, META)


def view_rows(docs: DataFrame) -> DataFrame:
    """``docs`` to doc_id and VIEWS, one row for each."""

    def run(batches):
        for b in _parts(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *_views(b)], ["doc_id", "at", "value", "meta"])

    common.text_batches(docs.sparkSession)
    return docs.select("doc_id", "lang", "source", "n_chars", "text").mapInArrow(run, f"doc_id long, {VIEWS}")


def written_views(docs: DataFrame) -> DataFrame:
    """``view_rows`` as a written table, with a hash of the content view in ``mark``."""
    return common.materialise(view_rows(docs).withColumn("mark", F.xxhash64("at", "value")), "views")


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 150, l2: float = 1e-4) -> np.ndarray:
    """Weights and, last, the intercept, by full-batch Adam."""
    w = np.zeros(x.shape[1] + 1)
    m, v = np.zeros_like(w), np.zeros_like(w)
    total = weight.sum()
    for t in range(1, steps + 1):
        r = (_sigmoid(x @ w[:-1].astype(x.dtype) + w[-1]) - y) * weight / total
        g = np.append(x.T @ r.astype(x.dtype) + l2 * w[:-1], r.sum())
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.2 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return w


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _balance(y: np.ndarray) -> np.ndarray:
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    return np.where(y > 0, 0.5 / share, 0.5 / (1 - share))


@dataclass
class Model:
    content: np.ndarray
    metadata: np.ndarray
    content_scale: np.ndarray
    metadata_scale: np.ndarray
    mix: np.ndarray
    threshold: float

    def scores(self, content: np.ndarray, metadata: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a = self.content_scale[0] * (content @ self.content[:-1].astype(np.float32) + self.content[-1]) + self.content_scale[1]
        b = self.metadata_scale[0] * (metadata @ self.metadata[:-1].astype(np.float32) + self.metadata[-1]) + self.metadata_scale[1]
        return _sigmoid(a), _sigmoid(b), _sigmoid(self.mix[0] * a + self.mix[1] * b + self.mix[2])


def _first(z: np.ndarray, mark: np.ndarray, n: int) -> np.ndarray:
    """Where the ``n`` least values of z stand, one for each mark; ties by mark."""
    order = np.lexsort((mark, z))
    _, first = np.unique(mark[order], return_index=True)
    return order[np.sort(first)[:n]]


def _logit(x, model: np.ndarray) -> np.ndarray:
    return x @ model[:-1].astype(np.float32) + model[-1]


#: Logit of a probability of 0.9, from which a guess is handed over.
SURE = float(np.log(9.0))


class Pool:
    """Unlabelled documents in memory, as arrays (content, metadata)."""

    def __init__(self, content, meta):
        self.views, self.mark = (content, meta), np.arange(len(meta))

    def confident(self, models, wanted, given):
        """For each view: what it hands over, as (views for the other model, guesses, marks)."""
        out = []
        for v in (0, 1):
            z, free = _logit(self.views[v], models[v]), ~np.isin(self.mark, list(given[1 - v]))
            rows, guess = [], []
            for label, s in ((0.0, z), (1.0, -z)):
                may = np.flatnonzero(free & (s < -SURE))
                some = may[_first(s[may], self.mark[may], wanted[int(label)])]
                rows.append(some)
                guess.append(np.full(len(some), label))
            rows = np.concatenate(rows)
            out.append((self.views[1 - v][rows], np.concatenate(guess), self.mark[rows]))
        return out


class WrittenPool:
    """All rows of ``written_views`` but those of some ids (at most LABELLED_ROWS); Spark judges them in every round."""

    BUCKETS = 32

    def __init__(self, views: DataFrame, ids: np.ndarray):
        self.views, self.ids = views, ids

    def confident(self, models, wanted, given):
        """As ``Pool.confident``. A task keeps ``wanted`` rows of each kind, as do the buckets that tasks' rows are dealt to."""
        sent = self.views.sparkSession.sparkContext.broadcast((models, wanted, [np.array(sorted(g), dtype=np.int64) for g in given], self.ids))
        names = ["kind", "z", "mark", "at", "value", "meta"]

        def least(parts, most):
            t = pa.concat_tables(parts).combine_chunks()
            return t.take(pa.array(_first(t.column("z").to_numpy(), t.column("mark").to_numpy(), most)))

        def judge(batches):
            models, wanted, given, ids = sent.value
            held: dict[int, pa.Table] = {}
            for b in batches:
                content = _read(b.column("at"), b.column("value"), b.column("meta"))
                mark = b.column("mark").to_numpy()
                known = np.isin(b.column("doc_id").fill_null(0).to_numpy(zero_copy_only=False), ids) & b.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
                for v in (0, 1):
                    z, free = _logit(content[v], models[v]), ~known & ~np.isin(mark, given[1 - v])
                    for label, s in ((0, z), (1, -z)):
                        may = np.flatnonzero(free & (s < -SURE))
                        if not len(may):
                            continue
                        may = may[_first(s[may], mark[may], wanted[label])]
                        none = pa.nulls(len(may), pa.binary())
                        views = [b.column(c).take(pa.array(may)) if (c == "meta") == (v == 0) else none for c in ("at", "value", "meta")]
                        new = pa.table([pa.array(np.full(len(may), 2 * v + label, dtype=np.int32)), pa.array(s[may], pa.float64()), pa.array(mark[may]), *views], names)
                        kind = 2 * v + label
                        held[kind] = least([held[kind], new], wanted[label]) if kind in held else new
            for t in held.values():
                yield from t.to_batches()

        def meet(batches):
            wanted, held = sent.value[1], {}
            for b in batches:
                t = pa.Table.from_batches([b])
                for kind in range(4):
                    some = t.filter(pa.array(t.column("kind").to_numpy() == kind))
                    if len(some):
                        held[kind] = least([held[kind], some] if kind in held else [some], wanted[kind % 2])
            for t in held.values():
                yield from t.cast(pa.schema(list(zip(names, [pa.int32(), pa.float64(), pa.int64(), *[pa.binary()] * 3], strict=True)))).to_batches()

        schema = f"kind int, z double, mark long, {VIEWS}"
        got = self.views.mapInArrow(judge, schema).repartition(self.BUCKETS, "mark").mapInArrow(meet, schema).toArrow()
        sent.unpersist()
        out = []
        for v in (0, 1):
            rows, guess = [], []
            for label in (0, 1):
                some = got.filter(pa.array(got.column("kind").to_numpy() == 2 * v + label)).combine_chunks()
                rows.append(some.take(pa.array(_first(some.column("z").to_numpy(), some.column("mark").to_numpy(), wanted[label]))))
                guess.append(np.full(len(rows[-1]), float(label)))
            rows = pa.concat_tables(rows)
            if v == 0:
                views = _flat(rows.column("meta"), "float32")[0].reshape(-1, META)
            else:
                places, lengths = _flat(rows.column("at"), "uint16")
                views = Sparse(places, _flat(rows.column("value"), "float32")[0], lengths).dense()
            out.append((views, np.concatenate(guess), rows.column("mark").to_numpy()))
        return out


def co_train(lab, y: np.ndarray, pool, held: np.ndarray, rounds: int = 3, exchanged: int = EXCHANGED) -> Model:
    """lab: (content, metadata) of labelled rows; pool: the unlabelled, the same in memory or a WrittenPool; held: labelled rows kept for calibration.

    In a round a view hands over ``exchanged`` guesses with a probability
    of 0.9 or more, in the proportion of the labelled classes, the surest first;
    documents with equal content views count once, and none goes twice to the same view. With labels of one class only,
    every document has that class's score and is kept.
    """
    if len(np.unique(y[~held])) < 2 or len(np.unique(y[held])) < 2:
        one = np.array([0.0, 20.0])
        return Model(np.zeros(CONTENT + 1), np.zeros(META + 1), one, one, np.array([1.0, 0.0, 0.0]), -1.0)
    pool = Pool(*pool) if isinstance(pool, tuple) else pool
    given: list[set[int]] = [set(), set()]  # marks of what each view was handed
    good = y[~held].mean()
    wanted = [max(1, int(exchanged * (1 - good))), max(1, int(exchanged * good))]
    x, yy, weight = [lab[v][~held] for v in (0, 1)], [y[~held]] * 2, [_balance(y[~held])] * 2
    for k in range(rounds + 1):
        models = [_logistic(x[v], yy[v], weight[v]) for v in (0, 1)]
        if k == rounds:
            break
        for v, (views, guess, marks) in enumerate(pool.confident(models, wanted, given)):
            x[1 - v] = np.concatenate([x[1 - v], views])
            yy[1 - v] = np.concatenate([yy[1 - v], guess])
            weight[1 - v] = np.concatenate([weight[1 - v], np.full(len(guess), 0.5)])
            given[1 - v].update(marks.tolist())
    z = [_logit(lab[v][held], models[v]) for v in (0, 1)]
    one = np.ones(int(held.sum()))
    scales = [_logistic(s[:, None].astype(float), y[held], one, 300) for s in z]
    a, b = (s[0] * t + s[1] for s, t in zip(scales, z, strict=True))
    mix = _logistic(np.column_stack([a, b]), y[held], one, 300)
    p = _sigmoid(mix[0] * a + mix[1] * b + mix[2])
    return Model(models[0], models[1], scales[0], scales[1], mix, min(0.5, -calibrate(-p, y[held] > 0)))


def fit(docs: DataFrame, labels: DataFrame, labelled_rows: int = LABELLED_ROWS, exchanged: int = EXCHANGED, seed: int = 11, views: DataFrame | None = None) -> Model:
    """Co-train on at most ``labelled_rows`` labelled documents, those of least hashed id, and on all others without labels.

    A third of the labelled rows is held out for calibration. Labels with null
    doc_id or quality are ignored; of repeated ids the least quality counts, and
    of repeated documents the content view of least hash. views:
    ``written_views(docs)`` where it is at hand.
    """
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    some = common.bounded_sample(known, "doc_id", labelled_rows, seed).select(F.col("doc_id").alias("id"), "quality")
    seen = written_views(docs) if views is None else views
    rows = seen.join(F.broadcast(some), F.col("doc_id") == F.col("id")).groupBy("doc_id", "quality").agg(F.min(F.struct("mark", "at", "value", "meta")).alias("r"))
    got = rows.select("doc_id", "quality", "r.at", "r.value", "r.meta").toArrow().sort_by("doc_id")
    content, meta = _read(*(got.column(c) for c in ("at", "value", "meta")))
    ids, q = got.column("doc_id").to_numpy(), got.column("quality").to_numpy()
    held = np.array([zlib.crc32(b"held%d" % i) % 3 == 0 for i in ids], dtype=bool)
    model = co_train((content.dense(), meta), (q > 0).astype(float), WrittenPool(seen, ids), held, exchanged=exchanged)
    if views is None:
        common.release(seen)
    return model


def _scored(model: Model, columns) -> tuple:
    a, m, s = model.scores(*_read(*columns))
    return a, m, s, s > model.threshold


def _parts(batches):
    common.use_caches("quality_classifier")
    return common.slices(batches)


def classify(docs: DataFrame, model: Model, views: DataFrame | None = None) -> DataFrame:
    """``docs(doc_id, text, lang, source, n_chars)`` to the scores of both views, their combination and the verdict.

    One row for each input row. Nulls in any column, empty and very long texts
    are scored like others; further columns are ignored; an empty table gives an
    empty result. views: ``written_views(docs)`` where it is at hand.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            scores = _scored(sent.value, [b.column(c) for c in ("at", "value", "meta")])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *(pa.array(x) if x.dtype == bool else pa.array(x, pa.float64()) for x in scores)], ["doc_id", "content_score", "metadata_score", "score", "kept"])

    seen = view_rows(docs) if views is None else views
    return seen.select("doc_id", "at", "value", "meta").mapInArrow(run, OUT)


def filter_documents(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that the classifier keeps, with all their columns."""
    common.text_batches(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in _parts(batches):
            yield b.filter(pa.array(_scored(sent.value, _views(b))[3]))

    return docs.mapInArrow(run, docs.schema)


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    seen = written_views(docs)
    return classify(docs, fit(docs, common.table(spark, sf_dir, "labels"), views=seen), seen)


QUERIES = {"op6_quality_classifier": op6_quality_classifier}
ORACLE: dict[str, str] = {}
