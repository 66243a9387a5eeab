"""The pipeline's stages: what each keeps, their order, and odd rows."""

from __future__ import annotations

import corpus_pipeline
from textlode.llm import nearjoin, quality, toxicity
from textlode.llm.common import held_out

FOLDER = "/root/testdata/sf0.001"


def test_order_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "toxicity", "ngram_jaccard_join", "mixing", "best_fit_packing"]


def test_each_stage_works_on_all_that_its_predecessor_kept(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = docs.columns
    ids = []
    for _, stage in corpus_pipeline.STAGES[:3]:
        before, docs = docs, stage(spark, docs, FOLDER).cache()
        assert docs.columns == names
        assert docs.exceptAll(before).count() == 0
        ids.append({r["doc_id"] for r in docs.select("doc_id").collect()})
    source = spark.read.parquet(f"{FOLDER}/documents.parquet")
    verdicts = quality.quality_verdicts(source.select("doc_id", "text"))
    assert ids[0] == {r["doc_id"] for r in verdicts.where("_quality.kept").collect()}
    good = source.join(verdicts.where("_quality.kept").select("doc_id"), "doc_id", "left_semi")
    labels = spark.read.parquet(f"{FOLDER}/labels.parquet").where(~held_out("doc_id", 5, 0))
    scores = toxicity.score(good, toxicity.train(*toxicity.sample(good, labels)))
    assert ids[1] == {r["doc_id"] for r in scores.where("score < 0.5").collect()}
    clean = good.where(good["doc_id"].isin(sorted(ids[1])))
    assert ids[2] == {r["component_id"] for r in nearjoin.similar_classes(clean).collect()}
    mixed = corpus_pipeline.mixed(spark, docs, FOLDER).cache()
    assert mixed.columns == names and mixed.exceptAll(mixed.dropDuplicates()).count() >= 0
    pieces = corpus_pipeline.packed(spark, mixed, FOLDER).collect()
    assert sum(r["piece"] == 0 for r in pieces) == mixed.count()


def test_run_gives_pieces_of_kept_documents(spark):
    rows = corpus_pipeline.run(spark, FOLDER).collect()
    assert rows and {"doc_id", "piece", "length", "sequence_id", "offset"} <= set(rows[0].asDict())


def test_stages_take_odd_rows(spark):
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    rows = [(1, None, None, None, None), (1, None, None, None, None), (None, "x y z", "en", "src0", 5), (3, "", "en", "src1", 0)]
    rows += [(i, " ".join(f"w{i}x{j}." for j in range(80)), "en", "src1", 9) for i in range(10, 16)]
    for docs in (spark.createDataFrame(rows, schema), spark.createDataFrame([], schema)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, FOLDER)
            out.collect()
