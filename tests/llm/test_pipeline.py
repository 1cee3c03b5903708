from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tests.conftest import SF
from tests.llm.test_packing import check_pieces


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = [docs.count()]
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == pipeline.COLUMNS and docs.join(before, "doc_id", "left_anti").count() == 0
            sizes.append(docs.count())
    assert sizes[0] > sizes[1] >= sizes[2] >= sizes[3] == sizes[4] > 0
    check_pieces(docs.collect(), {r.doc_id: r.text for r in before.collect()}, 2048)


def test_clean_documents_stay_and_copies_go(spark):
    clean = " ".join(f"word{i}" for i in range(120))
    rows = [(1, clean, "en", "src0", 9), (2, clean.upper(), "en", "src0", 9), (3, " ".join(f"other{i}" for i in range(120)), "en", None, 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    assert stages["quality rules"](spark, docs.where("doc_id <> 2"), SF).count() == 2
    assert sorted(r.doc_id for r in stages["near dedup"](spark, docs, SF).collect()) == [1, 3]
    assert sorted(r.doc_id for r in stages["line dedup"](spark, docs, SF).collect()) == [1, 3]
    assert sorted(r.doc_id for r in stages["mixing"](spark, docs, SF).collect()) == [1, 2, 3]
    empty = docs.limit(0)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run_equals_the_stages(spark):
    rows = pipeline.run(spark, SF)
    assert rows.where(F.col("length") <= 0).count() == 0 and rows.groupBy("doc_id").agg(F.sum("length").alias("n"), F.first("doc_tokens").alias("d")).where("n <> d").count() == 0


def test_null_and_repeated_doc_ids(spark):
    text = lambda k, n=120: " ".join(f"{k}{i}" for i in range(n))
    junk = "same " * 40
    rows = [
        (None, text("alpha"), "src0"), (None, text("beta"), "src1"), (None, junk, "src0"), (None, text("copied"), None),
        (7, text("gamma"), "src0"), (7, text("delta"), "src1"), (7, junk, "src1"), (8, text("epsilon"), "src2"), (9, text("copied"), "src2"),
    ]
    docs = spark.createDataFrame([(i, t, "en", s, len(t)) for i, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    stages = dict(pipeline.STAGES)
    listed = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=repr)
    good = sorted(((i, t) for i, t, _ in rows if t != junk), key=repr)
    once = [x for x in good if x != (None, text("copied"))]
    assert listed(stages["quality rules"](spark, docs, SF)) == good
    clean = docs.where(F.col("text") != junk)
    assert listed(stages["line dedup"](spark, clean, SF)) == once
    assert listed(stages["near dedup"](spark, clean, SF)) == once
    assert listed(stages["mixing"](spark, docs, SF)) == sorted(((i, t) for i, t, _ in rows), key=repr)
    assert stages["packing"](spark, docs, SF).where("start = 0").count() == len(rows)


def test_shared_doc_ids_keep_their_own_lines(spark):
    line = lambda k: " ".join(f"{k}{i}" for i in range(12))
    rows = [(1, line("a") + "\n" + line("b")), (1, line("c") + "\n" + line("a")), (None, line("b") + "\n" + line("d"))]
    docs = spark.createDataFrame([(i, t, "en", "src0", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = [r.text for r in pipeline.drop_lines(spark, docs, SF).collect()]
    assert sorted("\n".join(got).split("\n")) == [line(k) for k in "abcd"]


def test_sequences_follow_the_mix(spark, tmp_path):
    text = lambda i: " ".join(f"w{(i * 7919 + k * 104729) % 99991}" for k in range(1200))
    rows = [(i, text(i), "en", "src0" if i < 380 else "src1", 9) for i in range(480)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartitionByRange(6, "doc_id").write.parquet(str(tmp_path / "docs"))  # no file has the mix
    pipeline.mix_sources(spark, spark.read.parquet(str(tmp_path / "docs")), SF).write.parquet(str(tmp_path / "mix"))
    packed = pipeline.pack(spark, spark.read.parquet(str(tmp_path / "mix")), SF).collect()
    packed.sort(key=lambda r: (r.sequence_id, r.offset))
    assert {r.sequence_id for r in packed} == set(range(packed[-1].sequence_id + 1))
    size = {0: 0, 1: 0}
    for r in packed[: len(packed) // 3]:
        size[int(r.doc_id >= 380)] += r.length
    assert abs(size[1] / sum(size.values()) - 9 / 29) < 0.05  # of all it is 0.21
