"""The corpus pipeline: five stages over ``documents``, each of them one operator of porelake.llm.

Quality rules reject documents; of each class of near-duplicates one stays; secrets are replaced in
the texts; sources are mixed to target weights; what is left is encoded. Each stage's result is
written as Parquet in the shared folder and read again as the next one's documents.

Defined results: the stages return the columns of ``documents``; lang and n_chars are null where the
input lacks them, further columns go. Null and empty texts have no words, so the quality stage rejects
them. Rows that repeat a doc_id are judged by their own texts; of rows alike one stays. A null doc_id
stays only if its class has no other. A null source is a host, and in the mixture the source ''. Ties
of doc_id within a class are settled by a hash of the text. Very long texts are taken whole by every
stage. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from porelake.llm import bpe_codec, quality_rules, secret_scan, simhash_dedup, source_mixing
from porelake.llm._shared import materialize, ship_package

COLUMNS = {"doc_id": "long", "text": "string", "lang": "string", "source": "string", "n_chars": "long"}


def _columns(docs: DataFrame) -> DataFrame:
    """The columns of documents, whatever else there is; lang and n_chars may be absent."""
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(kind).alias(c) for c, kind in COLUMNS.items()])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule, or the verdict on their host, rejects go."""
    ship_package(spark)
    return quality_rules.keep_good(_columns(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates (Jaccard similarity of 5-word shingles of 0.8 or more) the
    document with the smallest doc_id stays."""
    return simhash_dedup.one_per_class(_columns(docs), words_in=5, similarity=0.8)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced by a mark; no document goes."""
    return secret_scan.redact_secrets(_columns(docs))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents appear as often as the weights of their sources ask; each at least once."""
    return source_mixing.mixed(_columns(docs))


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, ids, n_tokens) of each use of a document."""
    import public_tokenizers

    return bpe_codec.encode_columns(docs, public_tokenizers.path("byte_bpe_50k.json"), ("doc_id", "source")).withColumn("n_tokens", F.size("ids").cast("long"))


STAGES = [
    ("quality_rules", quality),
    ("simhash_near_dedup", near_duplicates),
    ("secret_scans", secrets),
    ("source_mixing", mixing),
    ("bpe_encoding", encoding),
]

# Near-duplicate classes of fingerprints and token ids can't be written in SQL; tests hold run()
# against a brute-force version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
