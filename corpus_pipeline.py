"""A training-data pipeline: four stages over the whole table of documents.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run``
writes to the shared folder and reads again for the next one.  All but the last return the
columns of their input, whatever their names; columns that an operator makes never replace them.

Cases: null, empty and letterless texts go in the first stage; very long texts are read whole; rows
whose id is null or shared are judged by their own texts in the second stage, where they come after all
other ids, so of repeated rows one stays; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from basewright.llm import language_id, ngram_join, packing, substring_dedup
from basewright.llm.common import Scratch, free_name, read_table, small_or_shuffled

#: A document whose language is less sure than this goes.
LEAST_SCORE = 0.3


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without letters, or whose language can't be told, go."""
    model = language_id.train(docs)
    known = language_id.predict(docs, model)
    known = known.filter((F.col("lang_pred") != language_id.UNDETERMINED) & (F.col("score") >= LEAST_SCORE))
    return known.drop("lang_pred", "score").toDF(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 or more on five-word shingles, the one of smallest id stays.

    Rows whose id is null or shared are judged by themselves: where there are any, all rows are numbered in
    the order of their ids, those rows last, whatever longs the ids are.
    """
    scratch, key = Scratch(spark), free_name(docs, "__key")
    odd = scratch.written(docs.groupBy("doc_id").agg(F.count("*").alias("rows")).filter("rows > 1 or doc_id is null").select("doc_id"), "odd-ids")
    keyed = docs.withColumn(key, F.col("doc_id").cast("long"))
    if odd.limit(1).count():
        row, last = free_name(keyed, "__row"), free_name(keyed, "__last")
        rows = scratch.written(docs.withColumn(row, F.monotonically_increasing_id()), "numbered")  # written once, so that the numbers stay
        flags = small_or_shuffled(odd.select(F.col("doc_id").alias("__odd"), F.lit(True).alias(last)))
        rows = rows.join(flags, F.col("doc_id").eqNullSafe(F.col("__odd")), "left").drop("__odd").withColumn(last, F.col(last).isNotNull())
        # numbers of sorted rows ascend with their order; null ids in great numbers are spread by their row
        keyed = scratch.written(rows.orderBy(last, "doc_id", row).withColumn(key, F.monotonically_increasing_id()).drop(row, last), "own-keys")
    found = ngram_join.link(keyed, width=5, p=4, q=5, id_col=key)
    gone = scratch.written(found.filter("component_id <> doc_id").select(F.col("doc_id").alias(key)), "near-copies")
    return keyed.join(small_or_shuffled(gone), key, "left_anti").select(docs.columns)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that stand in an earlier document go; documents of which nothing is left go too."""
    done = substring_dedup.dedup(docs)
    changed = F.col("removed").isNotNull()
    done = done.filter(~changed | (F.length(F.trim("text")) > 0))
    if "n_chars" in docs.columns:
        done = done.withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars")))
    return done.drop("removed").toDF(*docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of every document that is left, with their ids."""
    return packing.pack(docs)


STAGES = [("language_id", identify_language), ("ngram_jaccard", drop_near_copies), ("substring_dedup", cut_repeated_passages), ("packing", pack_tokens)]

#: Stages of trained models and hashes can't be written in SQL; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, in order."""
    docs, scratch = read_table(spark, sf_dir, "documents"), Scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = scratch.written(stage(spark, docs, sf_dir), name)
        scratch.drop(but=(docs,))
    return STAGES[-1][1](spark, docs, sf_dir)
