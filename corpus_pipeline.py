"""The corpus pipeline: five stages, each on all that its predecessor kept.

Counted as part of the subpackage ``rewritelab.llm``.  A stage is (name, function of (spark, docs, sf_dir)); its
result is written as Parquet and read again as the next one's docs.  All but the last return the columns of documents.

Rows without an id are documents like others, told apart by their texts; extra columns are carried, whatever their names.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rewritelab.llm import decontamination, language, mixing, sharding, simhash
from rewritelab.llm.common import columns_of, free, row_id, small, table, with_checkpoints

SHARDS = 24


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learn from the labelled rows and drop what has no language: null texts and texts without a letter.

    Without labelled rows to learn from, no language is told from another, and the same is dropped, no more.
    """
    model = language.learn(docs.filter(~language.held_out()), "text", "lang")
    if not model[0]:
        model = ["any"], np.zeros((language.BUCKETS, 1), np.float32), np.zeros(1)
    lang, score = free(docs, "__lang", "__score")
    return language.predict(docs, model, lang=lang, score=score).filter(F.col(lang) != "und").select(*columns_of(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the row of the smallest id of each SimHash component; rows of one id with other texts are told apart by these.

    Null and empty texts, and texts without words, are one component; of rows equal in id and text one stays; an empty
    table gives none.
    """
    key, kept, place, order = free(docs, "__key", "__kept", "__n", "__id")
    keyed = docs.withColumn(order, row_id()).withColumn(key, F.xxhash64(order, F.col("text").cast("string")))
    marks = simhash.near_duplicates(keyed, id_col=key).distinct()
    ids = keyed.groupBy(key).agg(F.min(order).alias(order))
    firsts = marks.join(ids, F.col("doc_id") == F.col(key)).groupBy("component_id").agg(F.min(F.struct(order, key)).alias("first")).select(F.col(f"first.{key}").alias(kept))
    rows = keyed.join(firsts, F.col(key) == F.col(kept), "left_semi")
    return rows.withColumn(place, F.row_number().over(Window.partitionBy(key, order, F.crc32("text"), F.length("text")).orderBy("text"))).filter(F.col(place) == 1).select(*columns_of(docs))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that contain a benchmark item; null and empty texts contain none and stay, as do all if there are no items."""
    key, bad = free(docs, "__key", "__bad")
    keyed = docs.withColumn(key, F.concat_ws(":", F.col("doc_id").cast("string"), F.hex(F.xxhash64("text")), F.crc32("text").cast("string")))  # rows of one id, or of none, may differ
    found = decontamination.contained(keyed, table(spark, sf_dir, "benchmark"), doc_id=key)
    return keyed.join(small(found.select(F.col(key).alias(bad)).distinct()), F.col(key) == F.col(bad), "left_anti").select(*columns_of(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as the mix takes them (not at all, once or twice), range-sorted by training position.

    Texts without words are taken not at all; a null source is a source; rows without an id are told apart by texts.
    """
    return mixing.mixed_documents(docs)


def assign_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and slot of every row of the mix, in the order in which it is stored: slots follow the training positions.

    Null texts have size 8; every row has a place of its own, repeated ones too; an empty table gives none.
    """
    return sharding.shard_stored(docs, SHARDS)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("mixing", mix_sources),
    ("sharding", assign_shards),
]

#: The stages hash, learn and cluster, which SQL does not express; tests hold each against a brute-force version.
ORACLE_SQL = None


def _delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; between stages, Parquet in the shared checkpoint folder, kept until the next stage is written."""
    with_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir() or spark.sparkContext.getConf().get('spark.checkpoint.dir')}/pipeline-{uuid.uuid4().hex}"
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs.write.parquet(f"{folder}/{name}")
            docs = spark.read.parquet(f"{folder}/{name}")
            if before is not None:
                _delete(spark, before)
            before = f"{folder}/{name}"
    return docs
