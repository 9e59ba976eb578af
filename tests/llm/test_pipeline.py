import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F

from glyphvein.llm import jaccard, secrets, toxicity
from glyphvein.llm.bpe import encoding

SF = "/root/testdata/sf0.001"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, counts = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, docs, SF).cache()
        counts.append((name, kept.count()))
        if name == "toxicity":
            ids = {r.doc_id for r in kept.select("doc_id").collect()}
            labelled = spark.read.parquet(f"{SF}/labels.parquet").where("toxic = 0").collect()
            assert sum(r.doc_id not in ids for r in labelled) <= 0.05 * len(labelled)
        if name == "ngram_jaccard_join":
            assert kept.count() == kept.select("doc_id").distinct().count()
            assert jaccard.jaccard_links(jaccard._keyed(kept)).where("n_links > 0").count() == 0
        if name == "secret_scans":
            assert kept.count() == docs.count() and secrets.find_secrets(kept).where(F.size("secret_spans") > 0).count() == 0
            assert kept.where("n_chars <> length(text)").count() == 0
        if name == "source_mixing":
            assert kept.groupBy("doc_id").count().agg(F.max("count")).first()[0] <= 2
        if name == "byte_level_bpe":
            enc = encoding(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
            texts = {r.doc_id: r.text for r in docs.collect()}
            assert all(r.n_tokens == len(enc.encode_ordinary(texts[r.doc_id])) for r in kept.collect()) and kept.count() == docs.count()
        else:
            assert kept.columns == columns
        docs = kept
    assert corpus_pipeline.ORACLE_SQL is None and toxicity.CATEGORIES[-1] == "toxic"


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF)
    assert rows.count() > 0 and {"doc_id", "n_tokens"} <= set(rows.columns)


def test_odd_tables(spark, tmp_path):
    """No documents; then repeats, nulls, ties and a column of an operator's own name."""
    spark.read.parquet(f"{SF}/labels.parquet").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    docs.limit(0).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    odd = docs.limit(40).unionByName(docs.limit(40)).unionByName(docs.limit(3).withColumn("text", F.lit(None).cast("string")).withColumn("source", F.lit(None).cast("string")).withColumn("doc_id", F.lit(None).cast("long")))
    odd.withColumn("__key", F.lit("mine")).withColumn("rejected", F.lit("mine")).write.mode("overwrite").parquet(f"{tmp_path}/documents.parquet")
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and sum(r.doc_id is None for r in rows) <= 6
