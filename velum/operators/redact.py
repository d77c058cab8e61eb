"""Replacement of entities in texts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.functions.text import escaped, plain_quotes, replacement


def redact(docs: DataFrame, entities: DataFrame, mode: str = "compat") -> DataFrame:
    """(doc_id, text, entities_replaced) of every document with a text.

    docs(doc_id, text), entities(doc_id, seq, original_text, pseudonym, confirmed). Confirmed entities are replaced
    longest first, ties in order of seq, whatever their case. compat: one after the other, so a replacement can be
    hit again and words can be hit inside longer ones. safe: all at once, at word boundaries, each place once. Null
    pseudonyms count as empty, null and empty originals and unconfirmed entities are left out.
    """
    if mode not in ("compat", "safe"):
        raise ValueError(f"no mode {mode}")
    ready = entities.filter("confirmed and original_text is not null and original_text <> ''").select(
        "doc_id",
        F.struct(
            (-F.length("original_text")).alias("less"), F.col("seq"), plain_quotes(F.col("original_text")).alias("original"), F.coalesce("pseudonym", F.lit("")).alias("pseudonym"),
        ).alias("e"),
    )
    per_doc = ready.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("es"))
    joined = docs.select("doc_id", plain_quotes(F.col("text")).alias("text")).filter("text is not null").join(per_doc, "doc_id", "left")
    if mode == "compat":
        start = F.struct(F.col("text").alias("t"), F.lit(0).alias("n"))
        regex = lambda e: F.concat(F.lit("(?iu)"), escaped(e["original"]))
        folded = F.aggregate(
            "es", start, lambda acc, e: F.struct(F.regexp_replace(acc["t"], regex(e), replacement(e["pseudonym"])).alias("t"), (acc["n"] + F.regexp_like(acc["t"], regex(e)).cast("int")).alias("n"))
        )
        out = joined.withColumn("r", F.when(F.col("es").isNull(), start).otherwise(folded))
        return out.select("doc_id", F.col("r.t").alias("text"), F.col("r.n").alias("entities_replaced"))
    letter = r"[\p{L}\p{M}\p{N}_]"
    any_ = F.concat(F.lit(f"(?iu)(?<!{letter})(?:"), F.array_join(F.transform("es", lambda e: escaped(e["original"])), "|"), F.lit(f")(?!{letter})"))
    marked = joined.withColumn("any", F.when(F.size("es") > 0, any_))
    found = marked.withColumn("hits", F.regexp_extract_all("text", F.col("any"), F.lit(0))).withColumn("gaps", F.split("text", F.col("any"), -1))
    name = lambda hit: F.get(F.filter("es", lambda e: F.lower(e["original"]) == F.lower(hit)), F.lit(0))["pseudonym"]
    built = F.concat(F.array_join(F.zip_with(F.slice("gaps", 1, F.size("hits")), "hits", lambda g, h: F.concat(g, F.coalesce(name(h), F.lit("")))), ""), F.element_at("gaps", -1))
    hit = F.size(F.filter("es", lambda e: F.exists("hits", lambda h: F.lower(h) == F.lower(e["original"]))))
    return found.select("doc_id", F.when(F.size("hits") > 0, built).otherwise(F.col("text")).alias("text"), F.when(F.size("hits") > 0, hit).otherwise(F.lit(0)).alias("entities_replaced"))


def output_path(path: str = "path"):
    """dir/base_anonimizzato.ext of a path; a path without a suffix gets none."""
    return F.regexp_replace(path, r"(?s)^(.*?)(\.[^./\\]*)?\z", "$1_anonimizzato$2")


def boxes(hits: DataFrame) -> DataFrame:
    """(doc_id, page, x, y, width, height, font_size, pseudonym) of hits(…, page_height, quads): page boxes, origin at the bottom."""
    xs = F.transform("quads", lambda q: F.get(q, F.lit(0)))
    ys = F.transform("quads", lambda q: F.get(q, F.lit(1)))
    box = hits.select("doc_id", "page", "pseudonym", "page_height", F.array_min(xs).alias("x"), F.array_max(xs).alias("x1"), F.array_min(ys).alias("y0"), F.array_max(ys).alias("y1"))
    height = F.col("y1") - F.col("y0")
    return box.select("doc_id", "page", "x", (F.col("page_height") - F.col("y1")).alias("y"), (F.col("x1") - F.col("x")).alias("width"), height.alias("height"), F.least(F.greatest(height * 0.75, F.lit(5.0)), F.lit(10.0)).alias("font_size"), "pseudonym")
