"""From documents to entities, dictionary and rewritten texts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.functions.patterns import PATTERNS, Pattern
from velum.operators import extract, pseudonyms, redact, resolve, review
from velum.operators.spans import aggregate_tokens, filter_spans
from velum.sources.tables import saved, spread


@dataclass(frozen=True)
class Settings:
    """Settings of an optional language model, with the ranges they may take."""

    enabled: bool = False
    base_url: str = "http://localhost:11434/v1"
    model: str = ""
    max_tokens: int = 8192
    timeout_ms: int = 120_000
    parallel_requests: int = 1
    chunk_size: int = 3000
    prompt_language: str = "it"
    custom_prompt: str | None = None

    def __post_init__(self) -> None:
        for name, low, high in (("max_tokens", 256, 32768), ("timeout_ms", 5000, 600_000), ("parallel_requests", 1, 4), ("chunk_size", 1000, 8000)):
            if not low <= getattr(self, name) <= high:
                raise ValueError(f"{name} must lie between {low} and {high}")
        if self.prompt_language not in ("it", "en"):
            raise ValueError("prompt_language must be it or en")
        if not self.base_url.rstrip("/").endswith("/v1"):
            object.__setattr__(self, "base_url", self.base_url.rstrip("/") + "/v1")


def analyze(docs: DataFrame, patterns: tuple[Pattern, ...] = PATTERNS, tokens: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """(doc_id, seq, type, original_text, key, occurrences, confirmed, replacement, aliases) of docs(doc_id, text).

    Patterns first; spans of a model's `tokens` and `names`(doc_id, chunk, idx, original, replacement, type) of a
    language model are added where their text is new. Names that are one, absent or noisy are then resolved; the other
    spellings of a name that stays are its `aliases`.
    """
    base = extract.with_matches(spread(docs.select("doc_id", "text")), patterns).select("doc_id", F.inline(extract.first_matches(F.col("matches"))))
    rows = base.select("doc_id", F.struct("stage", "place", "ord").alias("at"), "type", F.col("raw").alias("original_text"), F.lit(None).cast("string").alias("replacement"))
    if tokens is not None:
        spans = filter_spans(aggregate_tokens(tokens))
        rows = rows.unionByName(spans.select("doc_id", F.struct(F.lit(4).alias("stage"), F.col("chunk").alias("place"), F.col("span").alias("ord")).alias("at"), "type", F.col("clean").alias("original_text"), F.lit(None).cast("string").alias("replacement")))
    if names is not None:
        rows = rows.unionByName(names.select("doc_id", F.struct(F.lit(5).alias("stage"), F.col("chunk").alias("place"), F.col("idx").alias("ord")).alias("at"), "type", F.col("original").alias("original_text"), "replacement"))
    first = rows.groupBy("doc_id", F.lower("original_text").alias("key")).agg(F.min_by(F.struct("at", "type", "original_text", "replacement"), "at").alias("f")).select("doc_id", "f.*")
    ordered = first.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("at", "type", "original_text", "replacement"))).alias("es")).select("doc_id", F.posexplode("es").alias("seq", "e")).select("doc_id", "seq", "e.type", "e.original_text", "e.replacement")
    ordered = saved(ordered, "entities")
    gone = resolve.greedy_dedupe(ordered, docs).filter("dropped").select("doc_id", "seq")
    kept = ordered.join(gone, ["doc_id", "seq"], "left_anti")
    others = resolve.aliases(ordered, docs).groupBy("doc_id", "seq").agg(F.sort_array(F.collect_set("alias")).alias("aliases"))
    flags = resolve.noise_flags(kept, docs).filter("kept").select("doc_id", "seq", "occurrences")
    row = F.struct((-F.col("occurrences")).alias("less"), "seq", "type", "original_text", "replacement", F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"))
    final = kept.join(flags, ["doc_id", "seq"]).join(others, ["doc_id", "seq"], "left").groupBy("doc_id").agg(F.array_sort(F.collect_list(row)).alias("es"))
    out = final.select("doc_id", F.posexplode("es").alias("seq", "e")).select("doc_id", "seq", "e.type", "e.original_text", "e.replacement", "e.aliases", (-F.col("e.less")).alias("occurrences"))
    return out.withColumn("key", F.lower("original_text")).withColumn("confirmed", F.col("type") != "LUOGO")


def _named(entities: DataFrame, known: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(entities with pseudonyms, dictionary); a `replacement` that a language model gave is a name's base."""
    given = "replacement" if "replacement" in entities.columns else None
    dictionary = saved(pseudonyms.assign(pseudonyms.arrivals(entities, given), known), "dictionary")
    return pseudonyms.enrich(entities, dictionary).withColumn("pseudonym", F.col("dictionary_pseudonym")), dictionary


def anonymize(docs: DataFrame, entities: DataFrame, known: DataFrame | None = None, mode: str = "compat") -> tuple[DataFrame, DataFrame]:
    """(texts, dictionary): rewritten documents, and the dictionary with the new keys.

    In mode "safe" the `aliases` of an entity, where it has some, are replaced by its pseudonym as well; in "compat" they stay.
    """
    named, dictionary = _named(entities, known)
    if mode == "safe" and "aliases" in entities.columns:
        # seq orders ties of one length only; entities come before aliases
        also = named.select("doc_id", (F.col("seq") + F.lit(1 << 20)).alias("seq"), F.explode("aliases").alias("original_text"), "pseudonym", "confirmed")
        named = named.select("doc_id", "seq", "original_text", "pseudonym", "confirmed").unionByName(also)
    return redact.redact(docs, named, mode), dictionary


def batch(docs: DataFrame, overrides: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(results, totals) of a batch: entities merged over its documents, reviewed, and applied to each.

    results(doc_id, text, entities_replaced, error): a document that could not be read, or has no text, is an error row.
    """
    entities = saved(extract.entities(docs), "batch-entities")
    named, _ = _named(entities)
    merged = review.merge(named)
    if overrides is not None:
        merged = review.overridden(merged, overrides)
    chosen = review.for_files(merged, entities).join(entities.select("doc_id", "key", "seq"), ["doc_id", "key"])
    results = review.results(docs, redact.redact(docs, chosen))
    return results, review.batch_totals(results)
