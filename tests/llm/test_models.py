import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from pyspark.sql import functions as F

from tessera.llm import common, language_model, quality_classifier, quality_rules, toxicity

D = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{D}/documents.parquet"), spark.read.parquet(f"{D}/labels.parquet")


def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    dup = sum(x in lines[:i] for i, x in enumerate(lines))
    triples = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(triples)
    covered = {i + j for i, t in enumerate(triples) if seen[t] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def hard_rows(odd_texts):
    return [*odd_texts, "a b c a b c", "x x x x", "l one\nl one\n\n \nl one\nl two", "#$% <b> | & *\n#$% <b> | & *", "A B! C?", "w1 w2 w3 w1 w2 w3 w2 w3 w1 " * 9]


def test_statistics(odd_texts):
    rng = random.Random(0)
    texts = hard_rows(odd_texts) + [" ".join(rng.choice("abc") for _ in range(rng.randrange(30))) for _ in range(200)]
    for t in texts:
        assert quality_rules.statistics(t)[:5] == brute_statistics(t), t


def test_rules_over_the_table(spark, tables, make, odd_texts):
    docs, labels = tables
    model = quality_rules.fit(docs, labels)
    rows = {r.doc_id: r for r in quality_rules.apply_rules(docs, model).collect()}
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(rows) == len(texts)
    for i, r in rows.items():
        s = brute_statistics(texts[i])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == s
        assert r.base_failed == (s[0] < 50 or 100 * s[4] > 50 * s[0])
        assert r.kept == (not r.base_failed and r.anomaly < model.threshold[quality_rules.FEATURES.index(r.isolated_by)])
    quality = {r.doc_id: r.quality for r in labels.collect()}
    passed = [i for i in quality if i in rows and not rows[i].base_failed]
    good = [rows[i].kept for i in passed if quality[i] == 1]
    bad = [rows[i].kept for i in passed if quality[i] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.5
    again = quality_rules.fit(docs.repartition(7), labels)
    assert (again.threshold == model.threshold).all() and (again.forest.cut == model.forest.cut).all()
    kept = quality_rules.filter_documents(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}

    odd = make([*enumerate(hard_rows(odd_texts)), (None, "null id"), (0, ""), (0, "")]).selectExpr("*", "1 as kept", "2 as n_words", "3 as quality")
    assert quality_rules.apply_rules(odd, model).count() == odd.count()
    assert quality_rules.filter_documents(odd, model).columns == odd.columns
    nothing = quality_rules.fit(docs.limit(0), labels.limit(0))
    assert quality_rules.apply_rules(docs.limit(0), nothing).count() == 0
    assert quality_rules.apply_rules(odd, nothing).where("kept and base_failed").count() == 0


def ordinary(rng, words=120):
    """A text whose statistics are those of many others."""
    w = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(3, 8))) for _ in range(rng.randrange(words // 2 + 1, words * 2))]
    return "\n".join(" ".join(w[i : i + 12]).capitalize() for i in range(0, len(w), 12))


def odd_in(rng, kind):
    t = ordinary(rng)
    w = t.split()
    if kind == "symbols":
        return " ".join(x + rng.choice(["#$%", "**", "<|>"]) for x in w)
    if kind == "word_length":
        return " ".join(x * 6 for x in w)
    if kind == "dup_lines":
        line = " ".join(w[:3])
        return "\n".join([" ".join(w), *[line + " " + str(k // 12) for k in range(80)]])
    if kind == "capitals":
        return t.upper()
    if kind == "marks":
        return " ".join(x + "!?" for x in w)
    if kind == "log_words":
        return " ".join(ordinary(rng, 4000).split())
    return odd_in(rng, "symbols").upper() + " " + odd_in(rng, "marks")  # several at once


def test_forest_rejects_what_is_odd_in_any_statistic(make, spark):
    rng = random.Random(8)
    kinds = ["symbols", "word_length", "dup_lines", "capitals", "marks", "log_words", "several"]
    texts = [(ordinary(rng), 1, "ordinary") for _ in range(1500)] + [(odd_in(rng, k), 0, k) for k in kinds for _ in range(14)]
    # good texts with much of one statistic: no single threshold on the score can part them from the bad
    texts += [(ordinary(rng, 1500), 1, "long") for _ in range(40)]
    docs = make([(i, t) for i, (t, _, _) in enumerate(texts)])
    labels = spark.createDataFrame([(i, q, 0) for i, (_, q, _) in enumerate(texts) if i % 2], "doc_id long, quality int, toxic int")
    model = quality_rules.fit(docs, labels)
    rows = {r.doc_id: r for r in quality_rules.apply_rules(docs, model).collect()}
    unseen = [i for i in rows if not i % 2 and not rows[i].base_failed]
    kept = {k: [rows[i].kept for i in unseen if texts[i][2] == k] for k in [*kinds, "ordinary", "long"]}
    assert np.mean(kept["ordinary"]) > 0.97, {k: np.mean(v) for k, v in kept.items()}
    for k in kinds:
        assert not kept[k] or np.mean(kept[k]) < 0.35, (k, np.mean(kept[k]))
    assert len({r.isolated_by for i, r in rows.items() if not r.kept and not r.base_failed}) >= 4
    # no threshold on one statistic, in either direction, and none on the score gives these verdicts
    x = quality_rules.features(np.array([quality_rules.statistics(texts[i][0]) for i in unseen]))
    verdict = np.array([rows[i].kept for i in unseen])
    for column in [*x.T, np.array([rows[i].anomaly for i in unseen])]:
        assert column[verdict].min() <= column[~verdict].max() and column[verdict].max() >= column[~verdict].min()


def test_forest_against_plain_recursion():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(500, 3))
    forest = quality_rules.grow(x, trees=10, per_tree=64)

    def path(t, row, node=0):
        f = forest.feature[t, node]
        return forest.path[t, node] if f < 0 else path(t, row, forest.left[t, node] + (row[f] >= forest.cut[t, node]))

    want = [2 ** -(np.mean([path(t, row) for t in range(10)]) / forest.scale) for row in x[:50]]
    np.testing.assert_allclose(forest.score(x[:50]), want)
    outlier = np.array([[9.0, -9.0, 9.0]])
    assert forest.score(outlier)[0] > np.quantile(forest.score(x), 0.99)


def test_forest_grows_from_every_row(spark):
    """Each passing row is in one tree at least, more than TREES * per_tree of them too; the extremes of all are seen."""
    rows = [(k * 7919, 100 + k % 50, 500 + k, k % 3, 0, 0, k % 5, 0, 9) for k in range(3000)] + [(k, 10, 40, 99, 0, 0, 0, 0, 1) for k in range(50)]
    stats = spark.createDataFrame(rows, "mark long, " + quality_rules._STAT_COLS)
    forest, again = (quality_rules.grow_all(s, trees=10, per_tree=16) for s in (stats, stats.repartition(5)))
    s = np.array(rows)[:3000]
    x, tree = quality_rules.features(s[:, 1:]), s[:, 0] % 10
    for a, b in ((forest.cut, again.cut), (forest.path, again.path), (forest.gain, again.gain)):
        assert np.array_equal(a, b)
    assert forest.scale == pytest.approx(quality_rules._expected(300))
    for t in range(10):  # shares of rows on each side of the first cut, among all rows of the tree
        side = x[tree == t][:, forest.feature[t, 0]] >= forest.cut[t, 0]
        np.testing.assert_allclose(forest.gain[t, 1:3], [np.log2(300 / (~side).sum()), np.log2(300 / side.sum())])
    few = quality_rules.grow_all(stats.limit(40), trees=10, per_tree=64)
    assert few.scale == pytest.approx(quality_rules._expected(40))  # each of few rows is in all trees


def test_thresholds_from_every_labelled_row(spark):
    """The same as ``calibrate`` on all rows at once, with ties, gaps between parts, and kinds without bad or without any rows."""
    rng = np.random.default_rng(4)
    by = rng.choice([0, 1, 3, 4], size=4000)
    good = (rng.random(4000) < 0.8) | (by == 3)
    score = np.round(np.where(good, rng.normal(0.45, 0.05, 4000), rng.normal(0.6, 0.1, 4000)).clip(0.01, 0.99), 3)
    rows = spark.createDataFrame([(int(b), float(s), bool(g)) for b, s, g in zip(by, score, good, strict=True)], "by int, score double, good boolean")
    got = quality_rules.calibrate_all(rows, 5)
    want = [quality_rules.calibrate(score[by == j], good[by == j], int((~good).sum()), int(good.sum())) if (by == j).any() else np.inf for j in range(5)]
    assert np.isfinite(want).sum() == 3
    np.testing.assert_allclose(got, want)
    assert np.isinf(quality_rules.calibrate_all(rows.where("good"), 5)).all() and np.isinf(quality_rules.calibrate_all(rows.limit(0), 5)).all()


def test_classifier(spark, tables, make, odd_texts):
    docs, labels = tables
    model = quality_classifier.fit(docs, labels)
    rows = {r.doc_id: r for r in quality_classifier.classify(docs, model).collect()}
    quality = {r.doc_id: r.quality for r in labels.collect()}
    held = [i for i in quality if i in rows and zlib.crc32(b"held%d" % i) % 3 == 0]
    good, bad = [[rows[i].kept for i in held if quality[i] == q] for q in (1, 0)]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3
    assert all(0 <= x <= 1 for r in rows.values() for x in (r.content_score, r.metadata_score, r.score))
    kept = quality_classifier.filter_documents(docs, model)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, r in rows.items() if r.kept}

    odd = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(odd_texts)] + [(None, "x", "en", "s", -5), (1, None, "en", "s", 10**12)] * 2, docs.schema).selectExpr("*", "1 as score", "2 as id", "3 as content")
    assert quality_classifier.classify(odd, model).count() == odd.count()
    assert quality_classifier.classify(docs.limit(0), model).count() == 0
    nothing = quality_classifier.fit(docs, labels.limit(0))
    assert quality_classifier.classify(odd, nothing).where("not kept").count() == 0


def test_co_training_uses_both_views():
    """Each view alone knows half of the classes' signs; pseudo-labels carry it over."""
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 900).astype(float)
    content = np.zeros((900, quality_classifier.CONTENT), dtype=np.float32)
    content[:, :3] = (y[:, None] * 2 - 1 + rng.normal(size=(900, 3)))[:, :3]
    meta = np.zeros((900, quality_classifier.META), dtype=np.float32)
    meta[:, :3] = y[:, None] * 2 - 1 + rng.normal(size=(900, 3))
    held = np.arange(150) % 3 == 0
    m = quality_classifier.co_train((content[:150], meta[:150]), y[:150], (content[150:500], meta[150:500]), held)
    a, b, s = m.scores(content[500:], meta[500:])
    right = [((x > 0.5) == y[500:]).mean() for x in (a, b, s)]
    assert right[2] >= max(right[:2]) - 0.01 and right[2] > 0.95


def test_confident_documents_come_from_all_rows(spark, tables):
    """Spark's choice from the written views equals that of arrays in memory; marks given before and labelled ids are left out."""
    docs, labels = tables
    docs = docs.union(docs.limit(40)).repartition(7)
    seen = quality_classifier.written_views(docs)
    rows = sorted(seen.collect(), key=lambda r: (r.mark, r.doc_id))
    first = {r.mark: r for r in reversed(rows)}
    content = quality_classifier.Sparse(np.frombuffer(b"".join(r.at for r in first.values()), np.uint16), np.frombuffer(b"".join(r.value for r in first.values()), np.float32), np.array([len(r.at) // 2 for r in first.values()])).dense()
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r, c in zip(first.values(), content, strict=True):
        np.testing.assert_array_equal(c, quality_classifier.content_view(texts[r.doc_id]))
    meta = np.frombuffer(b"".join(r.meta for r in first.values()), np.float32).reshape(-1, quality_classifier.META)
    rng = np.random.default_rng(1)
    models = [rng.normal(size=x.shape[1] + 1) * 6 for x in (content, meta)]
    pool = quality_classifier.Pool(content, meta)
    pool.mark = np.array(list(first), dtype=np.int64)
    given = [set(pool.mark[:30].tolist()), set(pool.mark[20:60].tolist())]
    wanted = [25, 40]
    want = pool.confident(models, wanted, given)
    got = quality_classifier.WrittenPool(seen, np.empty(0, dtype=np.int64)).confident(models, wanted, given)
    assert set(got[0][2].tolist()) == set(want[0][2].tolist())  # equal content views have one content score
    assert all(len(g[1]) == len(g[2]) == len(g[0]) <= sum(wanted) for g in got)
    by_mark = {m: c for m, c in zip(pool.mark.tolist(), content, strict=True)}
    for c, m in zip(got[1][0], got[1][2].tolist(), strict=True):
        np.testing.assert_array_equal(c, by_mark[m])
        assert m not in given[0]
    best = {}
    for r in rows:
        if r.mark not in given[0]:
            z = float(quality_classifier._logit(np.frombuffer(r.meta, np.float32)[None], models[1])[0])
            best[r.mark] = [min(best.get(r.mark, [9e9, 0])[0], z), min(best.get(r.mark, [0, 9e9])[1], -z)]
    for label in (0, 1):
        least = sorted((z[label], m) for m, z in best.items() if z[label] < -quality_classifier.SURE)[: wanted[label]]
        assert {m for _, m in least} == set(got[1][2][got[1][1] == label].tolist())
    everyone = quality_classifier.WrittenPool(seen, np.array(sorted({r.doc_id for r in rows})))
    assert all(not len(g[2]) for g in everyone.confident(models, wanted, given))


def test_nearest_examples_are_exact():
    rng = np.random.default_rng(3)
    counts = [dict(zip(rng.choice(30, k, replace=False).tolist(), rng.integers(1, 5, k).tolist(), strict=True)) for k in rng.integers(0, 6, 700)]
    toxic = rng.integers(0, 2, 700)
    ix = toxicity.build(counts, toxic, np.arange(700), [str(i) for i in range(30)])
    dense = np.zeros((700, 30))
    for i, c in enumerate(counts):
        t, w = ix.vector(c)
        dense[i, t] = w
    for i in range(0, 700, 7):
        got_i, got_s = ix.nearest(*ix.vector(counts[i]), without=i)
        cosine = dense @ dense[i]
        cosine[i] = -1
        order = [j for j in np.lexsort((np.arange(700), -np.round(cosine, 12))) if cosine[j] > 1e-12][: toxicity.NEIGHBOURS]
        np.testing.assert_allclose(got_s, cosine[order])
        assert len(got_i) == len(set(got_i)) and i not in got_i


def test_toxicity_on_held_out_rows(spark, tables, make, odd_texts):
    docs, labels = tables
    ix = toxicity.fit(docs, labels)
    rows = {r.doc_id: r for r in toxicity.score(docs, ix).collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i, r in rows.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    toxic = {r.doc_id: r.toxic for r in labels.collect()}
    assert not {int(i) for i in ix.ids} & {i for i in toxic if zlib.crc32(str(i).encode()) % 4 == 2}
    held = [i for i in toxic if i in rows and rows[i].held_out]
    found = [rows[i].predicted for i in held if toxic[i]]
    clean = [rows[i].predicted for i in held if not toxic[i]]
    assert np.mean(found) >= 0.6 and np.mean(clean) <= 0.03  # 41 toxic examples only
    by_text = {}
    for r in docs.collect():
        by_text.setdefault(r.text, set()).add(rows[r.doc_id].score)
    assert all(len(s) == 1 for s in by_text.values())  # nothing but the text counts
    odd = make([*enumerate(odd_texts), (None, "null"), (3, "tie"), (3, "tie")]).selectExpr("*", "1 as score", "2 as toxic", "3 as id")
    assert toxicity.score(odd, ix).count() == odd.count() and toxicity.score(docs.limit(0), ix).count() == 0
    nothing = toxicity.fit(docs, labels.limit(0))
    assert all(r.predicted == 0 for r in toxicity.score(odd, nothing).collect())


def test_toxicity_indexes_every_word(spark, make):
    """Words of one example only, and words no more common in toxic examples, find their nearest examples too."""
    texts = [f"common words here plain{i} other{i % 7}" for i in range(40)] + [f"common words here vile{i % 3} only{i}" for i in range(6)]
    ids = [i for i in range(400) if zlib.crc32(str(i).encode()) % 4 != 2][: len(texts)]
    docs = make(list(zip(ids, texts, strict=True)))
    labels = spark.createDataFrame([(i, 0, int("vile" in t)) for i, t in zip(ids, texts, strict=True)], "doc_id long, quality int, toxic int")
    ix = toxicity.fit(docs, labels)
    assert len(ix.terms) == len({k for t in texts for w in common.words(t) for k in toxicity.term_keys(w)})
    got = {r.doc_id: r for r in toxicity.score(make([(1000, "plain5"), (1001, "only3"), (1002, "never seen")]), ix).collect()}
    assert got[1000].evidence[0].example == ids[5] and got[1001].evidence[0].example == ids[43] and not got[1002].evidence
    dense = np.zeros((len(ids), len(ix.terms)))
    for i in range(len(ids)):
        t, w = ix.example(i)
        dense[i, t] = w
    for text in texts[::5]:
        t, w = ix.known(*toxicity.text_terms(text, toxicity._Numbers()))
        np.testing.assert_allclose(ix.nearest(t, w)[1], -np.sort(-(dense[:, t] @ w))[: toxicity.NEIGHBOURS])
    t, w = ix.known(*toxicity.text_terms("plain5 never seen", toxicity._Numbers()))
    assert (w * w).sum() < 1  # words of no example count in the length


def brute_base(rows):
    train = [t or "" for i, t in rows if i is not None and zlib.crc32(str(i).encode()) % 10 != 0]
    lower = lambda t: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    tokens = lambda t: [*WORD.findall(lower(t)), "\n"]
    c = Counter(x for t in train for x in tokens(t))
    n, v = sum(c.values()), len(c)
    out = []
    for i, t in rows:
        x = tokens(t or "")
        out.append((i, i is None or zlib.crc32(str(i).encode()) % 10 == 0, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in x)))
    return out


def fitted(docs):
    d = docs.select("doc_id", "text")
    return language_model.fit(d.where(common.doc_ids_mod("doc_id", 10) != 0))


def test_language_model_base_and_gain(spark, tables):
    docs, _ = tables
    got = {r.doc_id: r for r in language_model.score(docs, fitted(docs)).collect()}
    for i, held, n, known, total, base in brute_base([(r.doc_id, r.text) for r in docs.collect()]):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert math.isclose(r.base_score, base, rel_tol=1e-9)
    held = [r for r in got.values() if r.held_out]
    assert sum(r.score for r in held) > 0.9 * sum(r.base_score for r in held)  # a tenth fewer digits at least
    assert all(r.score < 0 for r in got.values())


def test_topics_come_from_every_document(spark, make):
    """More documents than the 3,000 that topics were found from; the centroids are means of all profiles next to them."""
    rng = random.Random(6)
    kinds = ["abcd", "efgh", "ijkl", "mnop", "qrst", "uvwx"]
    texts = [" ".join("".join(rng.choice(kinds[k % 6]) for _ in range(4)) for _ in range(30)) for k in range(4800)]
    docs = make([*texts, "", None, "x"]).select("doc_id", "text")
    topics, again = language_model.find_topics(docs), language_model.find_topics(docs.repartition(5))
    assert np.array_equal(topics.centroids, again.centroids)
    x = np.stack([language_model._profile(t.encode()) for t in [*texts, "", "", "x"]])
    z = topics.of(x)
    assert len(np.unique(z)) == language_model.TOPICS
    for k in range(language_model.TOPICS):
        assert np.array_equal(topics.centroids[k], np.rint(16 * x[z == k].sum(axis=0, dtype=np.int64) / (z == k).sum()))
    brute = ((16.0 * x[:, None, :] - topics.centroids) ** 2).sum(axis=2)
    assert np.array_equal(topics.far(x), brute)
    few = language_model.find_topics(docs.limit(2))
    assert few.centroids.shape == topics.centroids.shape and not language_model.find_topics(docs.limit(0)).centroids.any()


def test_language_model_is_the_same_for_any_split(spark, tables, monkeypatch):
    """The number of partitions and Arrow's batches leave no trace; several shards in a task, ties of ids with other texts."""
    monkeypatch.setattr(language_model, "SHARD", 1_000)
    monkeypatch.setattr(language_model, "TASKS", 3)
    docs = tables[0].select("doc_id", "text")
    docs = docs.union(docs.where("doc_id < 5").selectExpr("doc_id", "concat(text, ' and more')"))
    train = docs.where(common.doc_ids_mod("doc_id", 10) != 0)
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    was = spark.conf.get(name)
    models = []
    for parts, rows in ((1, 1000), (7, 13), (40, 200)):
        spark.conf.set(name, str(rows))
        models.append(language_model.fit(train.repartition(parts)))
    spark.conf.set(name, was)
    one = models[0]
    assert one.vocab.total > 3 * language_model.ROUNDS * language_model.SHARD
    for m in models[1:]:
        assert np.array_equal(m.weights, one.weights) and np.array_equal(m.bias, one.bias)
        assert m.vocab.number == one.vocab.number and m.vocab.total == one.vocab.total


def test_language_model_is_a_distribution(spark, make):
    """After any history, the probabilities of all counted words, the end and the classes of new words add up to 1."""
    rng = random.Random(5)
    vocab = [f"{rng.choice('abc')}{i}" for i in range(30)]
    texts = [" ".join(rng.choices(vocab, weights=range(1, 31), k=20)) for _ in range(60)]
    docs = make(texts)
    model = fitted(docs)
    v = model.vocab
    known = {w for i, t in enumerate(texts) if zlib.crc32(str(i).encode()) % 10 for w in t.split()}
    by_topic = {}  # one new word for each class of endings
    for k in range(5000):
        w = f"new{rng.choice('abcxyz')}{k}"
        by_topic.setdefault(v.endings.of(w.encode()), w)
    new = list(by_topic.values())
    heads = ["", "a1 b2", vocab[3]]
    rows = [(10**6 * h + k, f"{head} {w}".strip()) for h, head in enumerate(heads) for k, w in enumerate([*sorted(known), *new])] + [(10**9 + h, head) for h, head in enumerate(heads)]
    got = {r.doc_id: r.score for r in language_model.score(make(rows), model).collect()}
    ends = {}
    for h, head in enumerate(heads):
        # P(head, w, end): the end's probability is taken out by scoring it after the same words
        f = lambda text: [text.encode().split()]
        total = 0.0
        for i, text in rows:
            if i // 10**6 != h or i >= 10**9:
                continue
            words = f(text)[0]
            z, _, sums = language_model.softmax(model.weights, model.bias, language_model.features(v.symbols(words), np.array([len(words)]), v.symbol_class)[0])
            end = z[-1, language_model.END_CLASS] - math.log(sums[-1])
            words = f(head)[0]
            z, _, sums = language_model.softmax(model.weights, model.bias, language_model.features(v.symbols(words), np.array([len(words)]), v.symbol_class)[0])
            ends[h] = z[-1, language_model.END_CLASS] - math.log(sums[-1])
            before = got[10**9 + h] - ends[h] / math.log(10)
            total += 10 ** (got[i] - end / math.log(10) - before)
        classes_without_words = 1.0 - total - math.exp(ends[h])
        assert -1e-4 < classes_without_words < 0.1  # classes of endings that no new word above has


def test_language_model_edge_cases(spark, make, odd_texts):
    rows = [*enumerate(odd_texts), (None, "null id"), (3, "tie"), (3, "tie")]
    docs = make(rows).selectExpr("*", "1 as key", "2 as base", "3 as word", "4 as score")
    got = language_model.score(docs, fitted(docs)).collect()
    want = brute_base(rows)
    assert sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)) for r in got), key=repr) == sorted(((*w[:5], round(w[5], 4)) for w in want), key=repr)
    empty = docs.limit(0)
    assert language_model.score(empty, fitted(empty)).count() == 0
    unseen = language_model.score(docs, fitted(empty)).collect()
    assert all(math.isclose(r.score, r.base_score, abs_tol=1e-9) and r.train_tokens == 0 for r in unseen)


def test_rows_sum():
    rng = np.random.default_rng(0)
    rows = np.concatenate([rng.integers(0, 50, 500), np.zeros(400, dtype=int), [7]])
    g = rng.normal(size=(len(rows), 3))
    u, s, n = language_model._sum_by_row(rows, g)
    for k, r in enumerate(u):
        np.testing.assert_allclose(s[k], g[rows == r].sum(axis=0))
        assert n[k] == (rows == r).sum()
    assert set(u) == set(rows)


def test_bounded_sample_of_more_rows_than_its_bound(spark):
    """The rows of least hash, the same however the table is partitioned; all rows where there are no more than the bound."""
    df = spark.range(5000).withColumnRenamed("id", "doc_id")
    want = [r.doc_id for r in df.orderBy(F.xxhash64(F.lit(7), "doc_id")).limit(600).collect()]
    for parts in (1, 9):
        got = common.bounded_sample(df.repartition(parts), "doc_id", 600, 7)
        assert [r.doc_id for r in got.collect()] == want
    assert common.bounded_sample(df, "doc_id", 5000, 7).count() == 5000 and common.bounded_sample(df.limit(0), "doc_id", 5, 7).count() == 0
