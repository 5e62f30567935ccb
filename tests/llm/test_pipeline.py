"""The pipeline's stages decide as their operators do, each on what the one before kept."""

from pyspark.sql import functions as F

import corpus_pipeline
from chunkloom.llm import classifier, quality_rules
from chunkloom.session import written
from llm.helpers import jaccard_brute, plain


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "jaccard_join", "packing"]
    kept = []
    now = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        now = written(stage(spark, now, sf_dir), "stage")
        assert now.columns == docs.columns
        kept.append(now)
    scores = plain(classifier.scored(docs, classifier.train(docs, labels)))
    assert {r.doc_id for r in kept[0].collect()} == set(scores[scores.predicted == 1].doc_id)
    counts = quality_rules.measured(kept[0])
    verdicts = plain(quality_rules.judged(counts, quality_rules.choose_cutoffs(counts, labels)))
    assert {r.doc_id for r in kept[1].collect()} == set(verdicts[verdicts.kept].doc_id)
    classes = jaccard_brute([(r.doc_id, r.text) for r in kept[1].collect()])
    assert {r.doc_id for r in kept[2].collect()} == {i for i, c in classes.items() if c[1] == i}
    pieces = plain(corpus_pipeline.run(spark, sf_dir))
    assert set(pieces.doc_id) == {r.doc_id for r in kept[2].collect()}
    assert (pieces.groupby("sequence_id").length.sum().iloc[:-1] == 1024).all()
    good = {r.doc_id for r in labels.where("quality = 1").collect()} & {r.doc_id for r in docs.collect()}
    assert len(good & {r.doc_id for r in kept[0].collect()}) > 0.97 * len(good)


def all_stages(spark, docs, sf_dir):
    """What each stage but the last keeps, and the pieces."""
    kept = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), "stage")
        kept.append(docs)
    return kept, corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir)


def test_stages_without_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    kept, pieces = all_stages(spark, docs, sf_dir)
    assert [k.count() for k in kept] == [0, 0, 0] and all(k.columns == docs.columns for k in kept) and pieces.count() == 0


def test_stages_on_awkward_rows(spark, sf_dir):
    """Null ids, texts and languages, empty and very long texts, repeated rows and columns that the stages use themselves."""
    given = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = given.join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id"), "doc_id").select(given.columns)
    first = good.orderBy("doc_id").limit(1)
    odd = first.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in given.schema.fields])
    odd = odd.union(first.withColumn("doc_id", F.lit(-1).cast("long")).withColumn("text", F.lit("")).select(given.columns))
    odd = odd.union(first.withColumn("doc_id", F.lit(-2).cast("long")).withColumn("text", F.expr("repeat('all work and no play ', 100000)")).select(given.columns))
    odd = odd.union(first.withColumn("lang", F.lit(None).cast("string")).select(given.columns)).union(first)
    clashing = {n: F.lit(1) for n in ("score", "predicted", "kept", "stratum", "n_words", "component_id", "id", "a", "part", "ids", "base_failed")}
    docs = given.union(odd).withColumns(clashing)
    kept, pieces = all_stages(spark, docs, sf_dir)
    assert all(k.columns == docs.columns for k in kept)
    counts = [docs.count(), *[k.count() for k in kept]]
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    before = docs
    for k in kept:  # whole rows are kept or dropped
        assert k.exceptAll(before).count() == 0
        before = k
    # Neither a null, an empty nor a repetitive text is left; rows that repeat are rows of one document and stay together.
    assert kept[1].where("doc_id is null or doc_id < 0").count() == 0
    number = first.head().doc_id
    assert kept[1].where(F.col("doc_id") == number).count() in (0, 3)
    assert pieces.select("doc_id").distinct().count() == kept[-1].select("doc_id").distinct().count()
