"""Pattern matches, their acceptance, and the ordered first of each, all within a document's row: no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.lexicons import CAPITALS_BLOCKED
from velum.functions.patterns import PATTERNS, Pattern
from velum.functions.text import SPACES, WS, java, literal_count, trim_all
from velum.sources.tables import spread

MATCH = "array<struct<stage:int,pattern:string,place:int,ord:int,raw:string,type:string>>"


def words(c: Column) -> Column:
    return F.split(trim_all(c), f"{WS}+")


def accepted(stage: int, pattern: str, type_: str, raw: Column) -> Column:
    """Whether a match counts: names need two words, those in capitals no short or blocked one."""
    if type_ != "PERSONA" or pattern == "signature":
        return F.lit(True)
    enough = F.size(words(raw)) >= 2
    if stage != 1:
        return enough
    capitals = raw.rlike(f"^[A-ZÀ-Ü{SPACES}']+\\z")
    bad = F.exists(words(raw), lambda w: (F.length(w) <= 2) | F.lower(w).isin(*CAPITALS_BLOCKED))
    return enough & ~(capitals & bad)


def pattern_matches(text: Column, p: Pattern, place: int) -> Column:
    """The trimmed values of one pattern, in text order, with their place among all values of the pattern."""
    regex = F.lit(java(p.regex))
    if p.groups == 2:
        a, b = F.regexp_extract_all(text, regex, F.lit(1)), F.regexp_extract_all(text, regex, F.lit(2))
        values = F.zip_with(a, b, lambda x, y: F.when(x != "", x).otherwise(y))
    else:
        values = F.regexp_extract_all(text, regex, F.lit(p.groups))
    if p.name == "lawyers":
        values = F.flatten(F.transform(values, lambda v: F.filter(F.transform(F.split(v, ","), trim_all), lambda n: F.length(n) > 2)))
    values = F.transform(values, trim_all)
    rows = F.transform(
        values,
        lambda v, i: F.struct(F.lit(p.stage).alias("stage"), F.lit(p.name).alias("pattern"), F.lit(place).alias("place"), i.cast("int").alias("ord"), v.alias("raw"), F.lit(p.type).alias("type")),
    )
    gate = text.rlike(java(p.gate)) if p.gate else text.isNotNull()
    return F.when(gate, F.filter(rows, lambda m: accepted(p.stage, p.name, p.type, m["raw"]) & (m["raw"] != ""))).otherwise(F.array().cast(MATCH))


def with_matches(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, text: str = "text") -> DataFrame:
    """`docs` with `matches`, the accepted matches in the order of stages, patterns and text; null texts have none."""
    parts = [pattern_matches(F.col(text), p, k) for k, p in enumerate(patterns)]
    return docs.withColumn("matches", F.coalesce(F.concat(*parts), F.array().cast(MATCH)))


def matches(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """(doc_id, stage, pattern, ord, raw, type), one row per accepted match."""
    return with_matches(spread(docs.select("doc_id", "text")), patterns).select("doc_id", F.inline("matches")).select("doc_id", "stage", "pattern", "ord", "raw", "type")


def first_matches(c: Column) -> Column:
    """The first match of each value whatever its case; the earlier pattern owns it."""
    keys = F.transform(c, lambda m: F.lower(m["raw"]))
    return F.transform(F.array_distinct(keys), lambda k: F.get(c, (F.array_position(keys, k) - 1).cast("int")))


def entities(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS) -> DataFrame:
    """(doc_id, seq, type, original_text, key, occurrences, confirmed): a document's entities, most frequent first.

    Null and empty texts have none; equal counts keep the order of detection; extra columns are ignored.
    """
    found = with_matches(spread(docs.select("doc_id", "text")), patterns).withColumn("firsts", first_matches(F.col("matches")))
    counted = F.transform(
        "firsts",
        lambda m, i: F.struct((-literal_count(F.col("text"), m["raw"])).alias("less"), i.alias("i"), m["type"].alias("type"), m["raw"].alias("original_text")),
    )
    return (
        found.select("doc_id", F.posexplode(F.array_sort(F.filter(counted, lambda e: e["less"] < 0))).alias("seq", "e"))
        .select("doc_id", "seq", "e.type", "e.original_text", F.lower("e.original_text").alias("key"), (-F.col("e.less")).alias("occurrences"), (F.col("e.type") != "LUOGO").alias("confirmed"))
    )
