"""The dictionary of pseudonyms: first arrivals, codes, initials with suffixes, reuse across sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.lexicons import CODE_PREFIX, FALLBACK_PREFIX
from velum.functions.text import initials, trim_all
from velum.operators.numbering import numbered

DICTIONARY = "key string, type string, base string, pseudonym string"


def _lookup(c: Column, table: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in table.items() for x in kv])[c]


def arrivals(entities: DataFrame, replacement: str | None = None) -> DataFrame:
    """(key, type, original_text, base, doc_id, phase, seq): the first arrival of each key, in document order.

    entities(doc_id, seq, type, original_text); a name given by a language model comes with its own `replacement`,
    which becomes its base; such names of a document (phase 0) arrive before its others (phase 1). Null and blank
    texts have no key, blank replacements count as none.
    """
    rows = entities.withColumn("key", F.lower(trim_all(F.col("original_text")))).filter("key is not null and key <> ''")
    given = F.nullif(trim_all(F.col(replacement)), F.lit("")) if replacement else F.lit(None).cast("string")
    rows = rows.withColumn("given", given).withColumn("phase", F.when(F.col("given").isNotNull(), 0).otherwise(1))
    first = rows.groupBy("key").agg(F.min_by(F.struct("type", "original_text", "given", "doc_id", "phase", "seq"), F.struct("doc_id", "phase", "seq")).alias("f")).select("key", "f.*")
    coded = _lookup(F.col("type"), CODE_PREFIX).isNotNull()
    return first.withColumn("base", F.when(~coded | F.col("given").isNotNull(), F.coalesce("given", initials(F.col("original_text"))))).drop("given")


def assign(first: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(key, type, base, pseudonym) of the arrivals: codes by type, initials by base with the count of their bearers.

    `known` is the dictionary of earlier sessions: its keys keep their pseudonyms and its counts are carried on.
    """
    new = assign_new(first, known)
    return new if known is None else new.unionByName(known.select("key", "type", "base", "pseudonym"))


def assign_new(first: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """As `assign`, but only the keys that `known` lacks."""
    if known is not None:
        first = first.join(known.select("key"), "key", "left_anti")
    code = F.coalesce(_lookup(F.col("type"), CODE_PREFIX), _lookup(F.col("type"), FALLBACK_PREFIX), F.lit("LUOGO"))
    # names without letters draw on their type's counter, as coded types do
    series = F.when(F.col("base").isNull(), F.concat(F.lit("code:"), F.coalesce("type", F.lit("")))).otherwise(F.concat(F.lit("base:"), F.col("base")))
    ranked = numbered(first.withColumn("series", series), ["series"], ["doc_id", "phase", "seq", "key"])
    if known is not None:
        offset = known.withColumn("series", series).groupBy("series").agg(F.count("*").alias("had"))
        ranked = ranked.join(offset, "series", "left").withColumn("rank", F.col("rank") + F.coalesce("had", F.lit(0)))
    name = F.when(F.col("base").isNull(), F.format_string("%s_%03d", code, F.col("rank"))).when(F.col("rank") == 1, F.col("base")).otherwise(F.format_string("%s (%d)", F.col("base"), F.col("rank")))
    return ranked.select("key", "type", "base", name.alias("pseudonym"))


def enrich(entities: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Entities with the pseudonym of their key; types do not matter to the lookup."""
    names = dictionary.select("key", F.col("pseudonym").alias("dictionary_pseudonym"))
    keyed = entities.withColumn("key", F.lower(trim_all(F.col("original_text"))))
    return keyed.join(names, "key", "left")


def stats(dictionary: DataFrame) -> DataFrame:
    """(type, entries, coded): entries by type, and those that carry a number of their type."""
    return dictionary.groupBy("type").agg(F.count("*").alias("entries"), F.count_if(F.col("base").isNull()).alias("coded"))
