"""From raw documents to packed training sequences, in five stages.

Each stage takes what the one before it kept, as a Parquet table in the folder that all executors share.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from arcframe.llm.jaccard import deduplicate
from arcframe.llm.langid import keep_identified
from arcframe.llm.mixing import mixed
from arcframe.llm.packing import pack_documents
from arcframe.llm.secrets import redact_secrets
from arcframe.session import checkpoint_folder


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language isn't in doubt; the others go.

    A null text, an empty one and one without letters have no language and go. Every row is judged by its own
    text: repeated rows stay or go together, null ids stay, columns are kept.
    """
    return keep_identified(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that a Jaccard similarity of 0.8 on five-word shingles connects.

    The smallest id of a group stays, once if its row is repeated. Texts that are null, empty or without words
    link with nothing and stay, and so do rows without an id.
    """
    return deduplicate(docs, words=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with credentials that look live masked in their texts.

    No row goes: null and empty texts and repeated rows pass as they are. A null source counts as one owner.
    """
    return redact_secrets(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of the sources takes them, 0 to 2 times each.

    Sources are weighed 5, 2, 1, repeating, by code point, null last. Texts without words, null ones too, are
    taken as often as their source is passed over as a whole. Equal rows are taken as often as they are together.
    """
    return mixed(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The places of the documents' pieces in sequences of 2048 tokens.

    A null or empty text is one separator token. Repeated rows, which the mix makes, are packed each, as are
    rows without an id.
    """
    return pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("language_id", language_id), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan), ("source_mix", source_mix), ("packing", packing)]

#: The stages learn a model, search and fit: no SQL says the same. The tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each is written and read again.

    A stage's table is deleted once the next one's is written; the last one's stays, as the rows returned are read from it.
    An empty documents table goes through all stages and gives an empty result.
    """
    folder = f"{checkpoint_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    done = None
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(path := f"{folder}/{k}-{name}")
        docs = spark.read.parquet(path)
        if done:
            _delete(spark, done)
        done = path
    return docs


def _delete(spark: SparkSession, path: str) -> None:
    """Deletes a folder of whatever file system the shared folder is on."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)
