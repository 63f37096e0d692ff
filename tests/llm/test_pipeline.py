from collections import Counter

import pytest

import corpus_pipeline
from tessera.llm import common, mixing, near_dedup, quality_classifier, quality_rules, queries

D = "/root/testdata/sf0.001"


def test_names():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "quality classifier", "near-dedup", "mixing", "packing"]
    assert sorted({int(n[2:].split("_")[0]) for n in queries.QUERIES}) == list(range(1, 11))


def test_each_stage_does_what_its_operator_says(spark):
    docs = common.table(spark, D, "documents")
    labels = common.table(spark, D, "labels")
    columns, order = docs.columns, {n: f for n, f in corpus_pipeline.STAGES}
    ids = lambda df: Counter(r.doc_id for r in df.collect())

    def stage(name, df):
        out = common.materialise(order[name](spark, df, D), "stage")
        assert name == "packing" or out.columns == columns
        return out

    one = stage("quality rules", docs)
    rules = quality_rules.apply_rules(docs, quality_rules.fit(docs, labels))
    assert ids(one) == ids(rules.where("kept"))

    two = stage("quality classifier", one)
    judged = quality_classifier.classify(one, quality_classifier.fit(docs, labels))
    assert ids(two) == ids(judged.where("kept"))

    three = stage("near-dedup", two)
    rows = [(r.doc_id, r.text) for r in two.collect()]
    from tests.llm.test_near import brute

    assert ids(three) == Counter(i for i, _, _, kept in brute(rows, 5) if kept)
    assert ids(three) == ids(near_dedup.near_duplicates(two, 5).where("kept"))

    four = stage("mixing", three)
    assert ids(four) == Counter({r.doc_id: r.copies for r in mixing.mix(three).collect() if r.copies})

    five = stage("packing", four)
    assert ids(five.where("piece = 0")) == ids(four)
    rows = five.collect()
    used = Counter()
    for r in rows:
        used[r.sequence_id] += r.length
    assert max(used.values()) <= 1024 and len(used) <= 1.05 * (sum(used.values()) / 1024) + 2

    run = corpus_pipeline.run(spark, D)
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(run) == key(five)
    assert corpus_pipeline.ORACLE_SQL is None


@pytest.mark.parametrize("empty", [True, False])
def test_stages_on_odd_tables(spark, odd_texts, empty):
    schema = common.table(spark, D, "documents").schema
    rows = [(i, t, None, None, None) for i, t in enumerate(odd_texts)] + [(None, "word " * 60, "en", None, 1), (None, None, None, "s", None), (4, "tie " * 60, "x", "s", -1), (4, "tie " * 60, "x", "s", -1)]
    docs = spark.createDataFrame([] if empty else rows, schema)
    for name, f in corpus_pipeline.STAGES:
        out = f(spark, docs, D)  # each stage by itself
        assert out.count() == 0 if empty else out.count() <= 2 * len(rows) + 20, name
        if name != "packing":
            assert out.columns == docs.columns


def test_memory_for_texts_is_bounded(spark):
    """A task holds a row group while it writes and a batch of rows while it reads, both small whatever the table's size."""
    import pyarrow.parquet as pq

    docs = spark.range(0, 4000, 1, 1).selectExpr("id doc_id", "concat_ws('', transform(sequence(1, 150), x -> sha2(cast(id * 1000 + x as string), 256))) text")
    out = common.materialise(docs, "test")
    files = [f.removeprefix("file://") for f in out.inputFiles()]
    sizes = [m.row_group(k).total_byte_size for m in (pq.ParquetFile(f).metadata for f in files) for k in range(m.num_row_groups)]
    assert sum(sizes) > 2 * common.ROW_GROUP and max(sizes) < 1.5 * common.ROW_GROUP
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 256
    assert out.count() == 4000
