"""Duplicate and noisy names of a document, resolved within one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.lexicons import NAME_STOPWORDS, NAME_TYPES
from velum.functions.text import SPACES, WS, literal_count, standalone_count, trim_all


def name_tokens(c: Column) -> Column:
    """Distinct telling words of a name, in lower case."""
    flat = F.regexp_replace(F.lower(c), r"[.\-–,;:()]", " ")
    return F.array_distinct(F.filter(F.split(flat, f"{WS}+"), lambda w: (F.length(w) > 1) & ~w.isin(*NAME_STOPWORDS)))


def same_name(a: Column, b: Column) -> Column:
    """Whether the smaller of two token sets, of at least two, lies in the larger."""
    return (F.size(a) >= 2) & (F.size(b) >= 2) & (F.size(F.array_intersect(a, b)) == F.least(F.size(a), F.size(b)))


def gathered(entities: DataFrame, docs: DataFrame, alone: bool = False) -> DataFrame:
    """(doc_id, text, es): a document's entities by seq, with tokens and counts; a document bounds the array.

    `alone` adds how often an entity stands by itself, counted only where a longer one of its type holds it.
    """
    rows = entities.select("doc_id", F.struct("seq", "type", "original_text").alias("e")).filter("e.original_text is not null and e.original_text <> ''")
    per_doc = rows.groupBy("doc_id").agg(F.array_sort(F.collect_list("e")).alias("raw"))

    def held(e: Column) -> Column:
        longer = lambda o: (F.length(o["original_text"]) > F.length(e["original_text"])) & o["type"].eqNullSafe(e["type"]) & F.lower(o["original_text"]).contains(F.lower(e["original_text"]))
        return F.when(F.exists("raw", longer), F.coalesce(standalone_count(F.col("text"), e["original_text"]), F.lit(0))).otherwise(F.lit(0))

    counted = F.transform(
        "raw",
        lambda e: F.struct(
            e["seq"].alias("seq"), e["type"].alias("type"), e["original_text"].alias("original_text"), F.lower(e["original_text"]).alias("low"), name_tokens(e["original_text"]).alias("tokens"),
            F.coalesce(literal_count(F.col("text"), e["original_text"]), F.lit(0)).alias("occ"), (held(e) if alone else F.lit(0)).alias("alone"),
            F.size(F.split(trim_all(e["original_text"]), f"[{SPACES}]+")).alias("n_words"),
        ),
    )
    return per_doc.join(docs.select("doc_id", "text"), "doc_id").select("doc_id", counted.alias("es"))


def same_name_pairs(entities: DataFrame) -> DataFrame:
    """(doc_id, seq_a, seq_b), seq_a < seq_b: pairs of a document's persons and organisations of one name."""
    t = entities.filter("type in ('PERSONA', 'ORGANIZZAZIONE')").select("doc_id", "seq", name_tokens(F.col("original_text")).alias("tokens")).filter("size(tokens) >= 2")
    a, b = t.select("doc_id", F.col("seq").alias("seq_a"), F.col("tokens").alias("ta")), t.select("doc_id", F.col("seq").alias("seq_b"), F.col("tokens").alias("tb"))
    return a.join(b, "doc_id").filter("seq_a < seq_b").filter(same_name(F.col("ta"), F.col("tb"))).select("doc_id", "seq_a", "seq_b").distinct()


_FOLD = """
aggregate(sequence(0, size(ns) - 1), cast(array() as array<int>), (gone, i) ->
  IF(array_contains(gone, i) OR i >= size(ns) - 1, gone,
    aggregate(sequence(i + 1, size(ns) - 1), gone, (g, j) ->
      IF(array_contains(g, j) OR size(ns[i].tokens) < 2 OR size(ns[j].tokens) < 2
         OR size(array_intersect(ns[i].tokens, ns[j].tokens)) < least(size(ns[i].tokens), size(ns[j].tokens)), g,
        array_append(g, IF(size(ns[i].tokens) <= size(ns[j].tokens) AND (size(ns[i].tokens) < size(ns[j].tokens) OR ns[i].occ >= ns[j].occ), j, i))))))
"""


def greedy_dedupe(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, seq, dropped): names of a document after the pairwise comparison in order of detection.

    Of two of one name the one with fewer words stays, at a tie the more frequent, then the earlier; dropped names
    meet no later one, but one that is dropped while it is compared is compared to the end.
    """
    gone = _resolved(entities, docs)
    flags = F.transform("ns", lambda e, i: F.struct(e["seq"].alias("seq"), F.array_contains("gone", i.cast("int")).alias("dropped")))
    return gone.select("doc_id", F.inline(flags))


def _resolved(entities: DataFrame, docs: DataFrame) -> DataFrame:
    es = gathered(entities, docs).withColumn("ns", F.filter("es", lambda e: e["type"].isin("PERSONA", "ORGANIZZAZIONE"))).filter("size(ns) > 0")
    return es.select("doc_id", "ns").withColumn("gone", F.expr(_FOLD))


def aliases(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, seq, alias): for each name that stays, the spellings dropped in its favour.

    A dropped name belongs to the first one that stays and is the same name; one that was dropped for a name that was
    dropped in turn, and is the same as none that stays, belongs to none.
    """
    numbered = _resolved(entities, docs).withColumn("all", F.transform("ns", lambda e, i: F.struct(e["seq"].alias("seq"), e["original_text"].alias("original_text"), e["tokens"].alias("tokens"), F.array_contains("gone", i.cast("int")).alias("dropped"))))
    owner = lambda d: F.get(F.filter("all", lambda e: ~e["dropped"] & same_name(e["tokens"], d["tokens"])), F.lit(0))["seq"]
    pairs = F.transform(F.filter("all", lambda e: e["dropped"]), lambda d: F.struct(owner(d).alias("seq"), d["original_text"].alias("alias")))
    return numbered.select("doc_id", F.inline(pairs)).filter("seq is not null")


def noise_flags(entities: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, seq, occurrences, absent, within_longer, holds_shorter, kept): the three filters, on the full set.

    absent: the text does not hold it. within_longer: one word inside a longer name of its type, standing alone at
    most twice as often as the most frequent of these. holds_shorter: a shorter name of two words or more inside it
    stands alone no more often than it occurs. Types found by patterns are only checked for absence.
    """
    es = gathered(entities, docs, alone=True)

    def flags(e: Column) -> Column:
        others = lambda longer: F.filter(
            "es",
            lambda o: (o["seq"] != e["seq"]) & o["type"].eqNullSafe(e["type"])
            & ((F.length(o["original_text"]) > F.length(e["original_text"])) & o["low"].contains(e["low"]) if longer else (F.length(o["original_text"]) < F.length(e["original_text"])) & e["low"].contains(o["low"]) & (o["n_words"] >= 2)),
        )
        holders = others(True)
        named = F.coalesce(e["type"].isin(*NAME_TYPES), F.lit(False))
        within = named & (e["n_words"] == 1) & (F.size(holders) > 0) & (e["alone"] <= 2 * F.array_max(F.transform(holders, lambda o: o["occ"])))
        holds = named & F.exists(others(False), lambda o: o["alone"] <= e["occ"])
        absent = e["occ"] == 0
        return F.struct(
            e["seq"].alias("seq"), e["occ"].alias("occurrences"), absent.alias("absent"), F.coalesce(within, F.lit(False)).alias("within_longer"), F.coalesce(holds, F.lit(False)).alias("holds_shorter"),
            (~absent & ~F.coalesce(within, F.lit(False)) & ~F.coalesce(holds, F.lit(False))).alias("kept"),
        )

    return es.select("doc_id", F.inline(F.transform("es", flags)))
