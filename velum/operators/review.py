"""Merging and reviewing entities across documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.functions.text import trim_all


def merge(entities: DataFrame) -> DataFrame:
    """(key, type, original_text, pseudonym, confirmed, occurrences, file_count) of entities(doc_id, seq, …).

    The first row of a key, in order of document and seq, supplies what is not summed. Null texts have no key.
    """
    at = F.struct("doc_id", "seq")
    first = F.min_by(F.struct("type", "original_text", "pseudonym", "confirmed"), at)
    rows = entities.filter("original_text is not null")
    return (
        rows.groupBy(F.lower("original_text").alias("key"))
        .agg(first.alias("f"), F.sum(F.coalesce("occurrences", F.lit(0))).alias("occurrences"), F.countDistinct("doc_id").alias("file_count"))
        .select("key", "f.*", "occurrences", F.col("file_count").cast("int").alias("file_count"))
    )


def overridden(merged: DataFrame, overrides: DataFrame) -> DataFrame:
    """`merged` with the choices of overrides(key, confirmed, pseudonym); blank pseudonyms change nothing."""
    o = overrides.select("key", F.col("confirmed").alias("o_confirmed"), F.nullif(trim_all(F.col("pseudonym")), F.lit("")).alias("o_pseudonym"))
    return merged.join(o, "key", "left").withColumn("confirmed", F.coalesce("o_confirmed", "confirmed")).withColumn("pseudonym", F.coalesce("o_pseudonym", "pseudonym")).drop("o_confirmed", "o_pseudonym")


def for_files(merged: DataFrame, entities: DataFrame) -> DataFrame:
    """(doc_id, merged.*): the merged entities that occur in each file."""
    held = entities.filter("original_text is not null").select("doc_id", F.lower("original_text").alias("key")).distinct()
    return held.join(merged, "key")


def review_counts(entities: DataFrame) -> DataFrame:
    """(doc_id, confirmed, entities)."""
    return entities.groupBy("doc_id").agg(F.count_if(F.col("confirmed")).alias("confirmed"), F.count("*").alias("entities"))


def results(docs: DataFrame, redacted: DataFrame) -> DataFrame:
    """(doc_id, text, entities_replaced, error) of every document: its rewritten text, or why there is none.

    docs(doc_id, text) may carry the `error` of its reading; a document without a text or with a blank one has failed.
    """
    read = F.col("error") if "error" in docs.columns else F.lit(None).cast("string")
    state = docs.select("doc_id", F.coalesce(read, F.when(F.coalesce(trim_all(F.col("text")), F.lit("")) == "", F.lit("no text"))).alias("error"))
    joined = state.join(redacted.select("doc_id", "text", "entities_replaced"), "doc_id", "left")
    ok = F.col("error").isNull()
    return joined.select("doc_id", F.when(ok, F.col("text")).alias("text"), F.when(ok, F.col("entities_replaced")).alias("entities_replaced"), "error")


def batch_totals(results: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """(*by, done, failed, replaced) of results(doc_id, entities_replaced, error)."""
    return results.groupBy(*by).agg(
        F.count_if(F.col("error").isNull()).alias("done"), F.count_if(F.col("error").isNotNull()).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("error").isNull(), F.col("entities_replaced"))), F.lit(0)).alias("replaced"),
    )
