"""Corpus pipeline: from raw documents to token ids, one operator a stage.

Each stage takes (spark, docs, sf_dir), works on every row that its predecessor
kept, and returns a DataFrame; all but the last return the columns of
``documents``.  Stages follow each other in the same executors, whose memory
Python workers share, so each bounds the Arrow batches that they hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import bpe, decontam, langid, simhash, suffix_dedup
from sievewright.llm.common import scratch_uri, small_batches

#: A document whose best language is less likely than this is rejected.
MIN_LANGUAGE_SCORE = 0.5
#: Repeats of so many words ("over 50") are removed, but for the first, whatever their bytes.
MIN_REPEAT_WORDS = 51


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or of no language that the network is sure of, go."""
    small_batches(spark)
    net = langid.fit(docs, "text", "lang")
    keep = tuple(c for c in docs.columns if c != "doc_id")
    out = langid.predict(docs, net, keep=keep)
    return out.where((F.col("lang_pred") != "und") & (F.col("score") >= MIN_LANGUAGE_SCORE)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of linked fingerprints the document of the least id stays.

    Rows are told apart by id and the hash of all columns, so rows of one id but
    other content are documents of their own, equal rows count once, and rows
    without an id come after those with one.
    """
    small_batches(spark)
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", F.xxhash64(*docs.columns).alias("row"))
    keyed = docs.withColumn("_key_", key)
    first = simhash.near_duplicates(keyed, "_key_").where("_key_ = component").select("_key_").distinct()
    return keyed.join(first, "_key_", "left_semi").dropDuplicates(["_key_"]).select(*docs.columns)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of long passages are cut out; a document that was nothing else goes."""
    small_batches(spark)
    others = tuple(c for c in docs.columns if c not in ("doc_id", "text"))
    cut = suffix_dedup.remove_repeats(docs, min_words=MIN_REPEAT_WORDS, keep="first", whole_letters=True, columns=others)
    text = F.decode("kept", "UTF-8")
    left = cut.where(~((F.col("n_removed") > 0) & (F.trim(text) == ""))).withColumn("text", text)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more is benchmark text go."""
    small_batches(spark)
    keep = tuple(c for c in docs.columns if c != "doc_id")
    out = decontam.contaminated_words(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), keep=keep)
    return out.where(~decontam.is_contaminated()).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and the digests of ids and decoded text."""
    small_batches(spark)
    import public_tokenizers

    out = bpe.encode_decode(docs, public_tokenizers.path("word_bpe_49k.json"))
    return out.select("doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language", language),
    ("near_duplicates", near_duplicates),
    ("repeats", repeats),
    ("decontaminated", decontaminated),
    ("tokens", tokens),
]

#: The network and the SimHash votes are beyond SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's rows are written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = scratch_uri(spark, "pipeline")
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
