"""Training corpus from raw documents: every stage works on all that the one before kept, and its decisions take effect.

Documents that the quality classifier rejects go, one document of each near-duplicate class stays, secrets in texts are
replaced, sources are mixed to their target weights by repeating or leaving out documents, and what is left is encoded.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkfolio.llm import bpe, kneser_ney, mixing, ngram_join, secret_scan
from sparkfolio.llm.common import scratch, staged
from sparkfolio.session import clear_written, written_so_far

#: Stages draw at random or iterate, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the perplexity classifier keeps; trusted are those that ``labels`` call good and not toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return kneser_ney.keep_good(docs, kneser_ney.trusted_of(labels))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of similar ones: five-word shingles, Jaccard similarity of 0.8 or more."""
    return ngram_join.keep_one(docs, n=5, percent=80)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, found secrets replaced in their texts; ``n_chars`` follows the text."""
    labelled = secret_scan.samples(docs).unionByName(secret_scan.random_strings(spark).withColumn("n", F.lit(1).cast("long")))
    clean = secret_scan.redact(docs, secret_scan.train(labelled))
    return clean.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast(docs.schema["n_chars"].dataType)))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, 0 to 2 times."""
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "mixed")
    taken = mixing.mix(rows, row=F.col("_row")).filter("copies > 0").select(F.col("row").alias("_row"), "copies")
    return (rows.join(taken, "_row").withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*docs.columns))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document."""
    import public_tokenizers

    return bpe.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality classifier", quality), ("n-gram Jaccard join", near_copies), ("secret scans", secrets),
          ("mixing", mix), ("BPE encoding", encode)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; each stage is written to the shared folder and read again.

    What a stage wrote on its way, and the table that it read, are deleted once its own table is there.
    """
    docs, mark = spark.read.parquet(f"{sf_dir}/documents.parquet"), written_so_far(spark)
    for name, stage in STAGES:
        result = stage(spark, docs, sf_dir)
        path = scratch(spark, name.replace(" ", "-"))
        result.write.parquet(path)
        docs = spark.read.schema(result.schema).parquet(path)
        clear_written(spark, mark, (path,))
    return docs
