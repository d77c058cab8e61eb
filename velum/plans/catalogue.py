"""The queries of the core, each over whole tables, and the SQL they are checked by."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.functions import text as tx
from velum.functions.lexicons import (
    ALLOWED_SUFFIXES,
    ANSWER_SPURIOUS,
    ANSWER_STOPWORDS,
    CAPITALS_BLOCKED,
    CERTIFICATE_NOISE,
    CHUNK_BACK,
    CHUNK_WORDS,
    CODE_PREFIX,
    DEFAULT_THRESHOLD,
    FALLBACK_PREFIX,
    FORMATS,
    LABEL_TYPE,
    MODEL_WORDS_MAX,
    NAME_STOPWORDS,
    NAME_TYPES,
    PUBLIC_BODIES,
    SCORE_THRESHOLD,
)
from velum.functions.patterns import BY_NAME, PATTERNS, Pattern
from velum.operators import extract, pseudonyms, redact, resolve, review, spans
from velum.plans import pipeline
from velum.sources import files, pdf
from velum.sources.tables import latest, load, saved

Query = Callable[[SparkSession, str], DataFrame]


def docs(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The last delivery of each file, with the columns named (text where none is); no other column is read."""
    t = load(spark, sf_dir, "documents_in").select("doc_id", *(columns or ("text",)), "loaded_at")
    return latest(t, ["doc_id"], "loaded_at").drop("loaded_at")


def entity_rows(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """Detected entities, repeated rows once, the last delivery of each; with the columns named, or all."""
    t = load(spark, sf_dir, "entities_in")
    return latest(t.select("entity_id", *columns, "detected_at") if columns else t, ["entity_id"], "detected_at")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(load(spark, sf_dir, "ocr_pages"), ["doc_id", "page"], "scanned_at")


DOCS = "docs AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC NULLS LAST) AS rn FROM documents_in) WHERE rn = 1)"
ENTS = "ents AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY detected_at DESC NULLS LAST) AS rn FROM entities_in) WHERE rn = 1)"
PAGES = "pages AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY scanned_at DESC NULLS LAST) AS rn FROM ocr_pages) WHERE rn = 1)"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def sql_trim(c: str) -> str:
    return f"regexp_replace({c}, {q(f'^{tx.WS}+|{tx.WS}+$')}, '', 'g')"


def sql_list(xs: "list[str] | tuple[str, ...]") -> str:
    return "(" + ", ".join(map(q, xs)) + ")"


def sql_case(c: str, table: dict[str, str], other: str = "NULL") -> str:
    return f"CASE {c} " + " ".join(f"WHEN {q(k)} THEN {q(v)}" for k, v in table.items()) + f" ELSE {other} END"


def sql_matches(p: Pattern, place: int, source: str = "docs") -> str:
    """(doc_id, stage, pattern, place, ord, raw, type) of one pattern."""
    r = q(tx.re2(p.regex))
    if p.groups == 2:
        both = f"list_zip(regexp_extract_all(text, {r}, 1), regexp_extract_all(text, {r}, 2))"
        values = f"list_transform({both}, lambda z: coalesce(nullif(z[1], ''), z[2]))"
    else:
        values = f"regexp_extract_all(text, {r}, {p.groups})"
    if p.name == "lawyers":
        values = f"flatten(list_transform({values}, lambda v: list_filter(list_transform(string_split(v, ','), lambda n: {sql_trim('n')}), lambda n: length(n) > 2)))"
    gate = f" AND regexp_matches(text, {q(tx.re2(p.gate))})" if p.gate else ""
    rows = f"SELECT doc_id, unnest({values}) AS v, generate_subscripts({values}, 1) - 1 AS ord FROM {source} WHERE text IS NOT NULL{gate}"
    words = f"regexp_split_to_array(raw, {q(tx.WS + '+')})"
    ok = "raw <> ''"
    if p.type == "PERSONA" and p.name != "signature":
        ok += f" AND len({words}) >= 2"
        if p.stage == 1:
            short = f"len(list_filter({words}, lambda w: length(w) <= 2 OR lower(w) IN {sql_list(CAPITALS_BLOCKED)})) > 0"
            ok += f" AND NOT (regexp_full_match(raw, {q(f'[A-ZÀ-Ü{tx.SPACES}' + chr(39) + ']+')}) AND {short})"
    return f"SELECT doc_id, {p.stage} AS stage, {q(p.name)} AS pattern, {place} AS place, CAST(ord AS INTEGER) AS ord, raw, {q(p.type)} AS type FROM (SELECT doc_id, {sql_trim('v')} AS raw, ord FROM ({rows})) WHERE {ok}"


ALL = " UNION ALL ".join(f"({sql_matches(p, k)})" for k, p in enumerate(PATTERNS))
COUNT = "CAST((length(lower(d.text)) - length(replace(lower(d.text), lower({x}), ''))) / length({x}) AS INTEGER)"
SQL_ENTITIES = (
    f"{DOCS}, m AS ({ALL}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(raw) ORDER BY stage, place, ord) AS k FROM m) WHERE k = 1), "
    f"c AS (SELECT f.*, {COUNT.format(x='f.raw')} AS occurrences FROM f JOIN docs d ON f.doc_id = d.doc_id)"
)


def _match_query(p: Pattern) -> Query:
    return lambda spark, d: extract.matches(docs(spark, d), (p,))


def _match_sql(p: Pattern) -> str:
    return f"WITH {DOCS} SELECT doc_id, stage, pattern, ord, raw, type FROM ({sql_matches(p, 0)})"


def match_email_docs(spark: SparkSession, d: str) -> DataFrame:
    return extract.matches(load(spark, d, "documents"), (BY_NAME["email"],))


def occurrences(spark: SparkSession, d: str) -> DataFrame:
    rows = entity_rows(spark, d).filter("original_text <> ''").join(docs(spark, d).filter("text is not null").select("doc_id", "text"), "doc_id")
    return rows.select("entity_id", tx.literal_count(F.col("text"), F.col("original_text")).alias("occurrences"))


def standalone(spark: SparkSession, d: str) -> DataFrame:
    rows = entity_rows(spark, d).filter("original_text <> ''").join(docs(spark, d).filter("text is not null").select("doc_id", "text"), "doc_id")
    return rows.select("entity_id", tx.standalone_count(F.col("text"), F.col("original_text")).cast("int").alias("standalone"))


def first_arrivals(spark: SparkSession, d: str) -> DataFrame:
    rows = entity_rows(spark, d).filter("type is not null").select("doc_id", F.col("entity_id").alias("seq"), "type", "original_text")
    return pseudonyms.arrivals(rows)


def dictionary(spark: SparkSession, d: str) -> DataFrame:
    return pseudonyms.assign(first_arrivals(spark, d))


_TRIMKEY = f"lower({sql_trim('original_text')})"
_BARE = f"regexp_replace(regexp_replace(original_text, '\\(.*?\\)', '', 'g'), '[0-9]', '', 'g')"
_PARTS = f"list_filter(list_transform(regexp_split_to_array({sql_trim(_BARE)}, {q(f'[{tx.SPACES}' + chr(92) + '-_]+')}), lambda p: regexp_replace(p, '[^A-Za-zÀ-ÿ]', '', 'g')), lambda p: length(p) > 0)"
_INITIALS = f"CASE WHEN len({_PARTS}) > 0 THEN array_to_string(list_transform({_PARTS}, lambda p: upper(substring(p, 1, 1)) || '.'), ' ') END"
SQL_DICTIONARY = f"""
WITH {ENTS}, keyed AS (SELECT doc_id, entity_id AS seq, type, original_text, {_TRIMKEY} AS key FROM ents WHERE type IS NOT NULL AND original_text IS NOT NULL),
first AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id, seq) AS k FROM keyed WHERE key <> '') WHERE k = 1),
based AS (SELECT *, CASE WHEN type NOT IN {sql_list(list(CODE_PREFIX))} THEN {_INITIALS} END AS base FROM first),
ranked AS (SELECT *, row_number() OVER (PARTITION BY CASE WHEN base IS NULL THEN 'code:' || type ELSE 'base:' || base END ORDER BY doc_id, seq, key) AS rank FROM based),
dict AS (SELECT key, type, base, CASE WHEN base IS NULL THEN {sql_case('type', CODE_PREFIX | FALLBACK_PREFIX, q('LUOGO'))} || '_' || CASE WHEN rank < 1000 THEN lpad(CAST(rank AS VARCHAR), 3, '0') ELSE CAST(rank AS VARCHAR) END
  WHEN rank = 1 THEN base ELSE base || ' (' || rank || ')' END AS pseudonym FROM ranked)
"""


def dictionary_reuse(spark: SparkSession, d: str) -> DataFrame:
    """Names of the language model that the dictionary of detected entities knows."""
    names = load(spark, d, "llm_names").select("name_id", F.col("original").alias("original_text"))
    return pseudonyms.enrich(names, dictionary(spark, d)).select("name_id", F.col("dictionary_pseudonym").alias("pseudonym"))


def seq_entities(spark: SparkSession, d: str) -> DataFrame:
    return entity_rows(spark, d).select("doc_id", F.col("entity_id").alias("seq"), "type", "original_text", "pseudonym", "occurrences", "confirmed")


def merged(spark: SparkSession, d: str) -> DataFrame:
    return review.merge(seq_entities(spark, d))


def redacted_texts(spark: SparkSession, d: str) -> DataFrame:
    return redact.redact(docs(spark, d), seq_entities(spark, d))


def redacted_safe(spark: SparkSession, d: str) -> DataFrame:
    return redact.redact(docs(spark, d), seq_entities(spark, d), "safe")


def batch_results(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the files by batch: done with their text, failed without."""
    t = docs(spark, d, "batch_id", "text")
    n = entity_rows(spark, d, "doc_id", "confirmed", "pseudonym").filter("confirmed").groupBy("doc_id").agg(F.countDistinct("pseudonym").alias("entities_replaced"))
    results = review.results(t, t.select("doc_id", "text").join(n, "doc_id", "left"))
    return review.batch_totals(t.select("doc_id", "batch_id").join(results, "doc_id"), ("batch_id",))


def filings(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text): a filing for each detected person, in the wording of headers, policies, contracts, lawyers' lists and signatures."""
    t = entity_rows(spark, d, "type", "original_text").filter("type = 'PERSONA' and original_text is not null")
    return t.select(F.col("entity_id").alias("doc_id"), F.format_string(FILING.replace("{0}", "%1$s").replace("{1}", "%2$s"), F.col("original_text"), F.upper("original_text")).alias("text"))


FILING = "Dott. {0} - Presidente -\nContraente: {0}\ntra {0}, nato a Roma,\navvocati {0}, Carla Neri Verdi\nFirmato Da: {1} Emesso Da: ARUBA\n"
FILED = ("header", "policy", "contract", "lawyers", "signature")


def llm_dictionary(spark: SparkSession, d: str) -> DataFrame:
    """The dictionary of detected entities and of the language model's names, which bring their own replacements."""
    found = entity_rows(spark, d, "doc_id", "type", "original_text").filter("type is not null").select("doc_id", F.col("entity_id").alias("seq"), "type", "original_text", F.lit(None).cast("string").alias("replacement"))
    t = load(spark, d, "llm_names").filter(spans.valid_answer(F.col("original")) & F.col("replacement").isNotNull())
    names = t.select("doc_id", F.col("name_id").alias("seq"), spans.answer_type(F.col("replacement")).alias("type"), F.col("original").alias("original_text"), "replacement")
    return pseudonyms.assign(pseudonyms.arrivals(found.unionByName(names), "replacement"))


def scanned_routes(spark: SparkSession, d: str) -> DataFrame:
    out = pdf.routed(docs(spark, d, "format", "text", "page_count"), pdf.ocr_texts(pages(spark, d)))
    return out.select("doc_id", "text", "page_count", "source", F.array_join("warnings", "; ").alias("warnings"))


def spans_of_names(spark: SparkSession, d: str) -> DataFrame:
    """The language model's names read as spans of a token model, with labels and scores by rule, and filtered."""
    t = load(spark, d, "llm_names").filter("original is not null")
    label = F.element_at(F.array(*map(F.lit, ("B-PER", "ORG", "I-LOC", "MISC"))), (F.col("name_id") % 4 + 1).cast("int"))
    made = t.select("name_id", F.col("original").alias("word"), label.alias("label"), ((F.col("name_id") * 37) % 100 / F.lit(100.0)).alias("score"))
    return spans.filter_spans(made).select("name_id", "type", "clean")


def token_spans(spark: SparkSession, d: str) -> DataFrame:
    """Words of the language model's names read as a token model's output, and joined to spans."""
    t = load(spark, d, "llm_names").filter("original is not null")
    words = t.select("doc_id", "chunk", "name_id", F.posexplode(F.filter(F.split("original", " "), lambda w: w != "")).alias("k", "word"))
    # a place by name and word, not by one number of both: keys are of any size, and names of any length
    tokens = words.select(
        "doc_id", "chunk", F.struct(F.col("name_id").isNull().alias("last"), "name_id", "k").alias("idx"), "word",
        F.when(F.col("k") == 0, F.lit("B-PER")).otherwise(F.lit("I-PER")).alias("label"), (F.lit(1.0) - F.col("k") / 10).alias("score"),
    )
    return spans.aggregate_tokens(tokens.dropDuplicates(["doc_id", "chunk", "idx"]))


def llm_rows(spark: SparkSession, d: str) -> DataFrame:
    t = load(spark, d, "llm_names")
    return t.select("name_id", spans.valid_answer(F.col("original")).alias("valid"), F.when(F.col("replacement").isNotNull(), spans.answer_type(F.col("replacement"))).alias("type"))


def llm_parse(spark: SparkSession, d: str) -> DataFrame:
    """The names of each document and chunk as a language model's answer, parsed again."""
    t = load(spark, d, "llm_names").filter("original is not null and replacement is not null")
    answer = F.concat(F.lit("Ecco:\n```json\n"), F.to_json(F.array_sort(F.collect_list(F.struct("name_id", "original", "replacement")))), F.lit("\n```"))
    return spans.parse_answers(t.groupBy("doc_id", "chunk").agg(answer.alias("content"))).select("doc_id", "chunk", "original", "replacement", "type")


def _tokens(spark: SparkSession, d: str) -> DataFrame:
    return load(spark, d, "pdf_tokens")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of all tokens with a place, as hits with one quad each on pages of 842 points."""
    t = _tokens(spark, d).filter("x is not null and y is not null and width is not null and height is not null").distinct()
    quad = F.array(F.array(F.col("x"), F.col("y")), F.array(F.col("x") + F.col("width"), F.col("y") + F.col("height")))
    hits = t.select("doc_id", "page", F.lit(842.0).alias("page_height"), quad.alias("quads"), F.col("token_id").cast("string").alias("pseudonym"))
    return redact.boxes(hits).select("doc_id", "page", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), F.round("width", 4).alias("width"), F.round("height", 4).alias("height"), F.round("font_size", 4).alias("font_size"), "pseudonym")


def report(spark: SparkSession, d: str) -> DataFrame:
    """Entities and documents with them, by type, language and source of the corpus."""
    t = load(spark, d, "documents")
    found = extract.entities(t, tuple(p for p in PATTERNS if p.stage == 3))
    return found.join(t.select("doc_id", "lang", "source"), "doc_id").groupBy("type", "lang", "source").agg(F.count("*").alias("entities"), F.countDistinct("doc_id").alias("documents"), F.sum("occurrences").alias("occurrences"))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """Mail addresses of the corpus: found, numbered in order of arrival, replaced in their texts."""
    t = load(spark, d, "documents")
    found = saved(extract.entities(t, (BY_NAME["email"],)), "flagship")
    texts, _ = pipeline.anonymize(t.join(found.select("doc_id").distinct(), "doc_id", "left_semi"), found)
    return texts


def analysed(spark: SparkSession, d: str) -> DataFrame:
    t = docs(spark, d)
    valid = load(spark, d, "llm_names").filter(spans.valid_answer(F.col("original"))).filter("replacement is not null")
    names = valid.select("doc_id", "chunk", F.col("name_id").cast("int").alias("idx"), F.col("original"), "replacement", spans.answer_type(F.col("replacement")).alias("type"))
    return pipeline.analyze(t, names=names).select("doc_id", "seq", "type", "original_text", "occurrences", "confirmed")


def queries() -> dict[str, Query]:
    return {
        "flagship": flagship,
        "match_email_docs": match_email_docs,
        **{f"match_{p.name}": _match_query(p) for p in PATTERNS},
        "matches_all": lambda s, d: extract.matches(docs(s, d)),
        "entities_distinct_first": lambda s, d: extract.entities(docs(s, d)).select("doc_id", "type", "original_text", "occurrences", "confirmed"),
        "entities_sorted": lambda s, d: extract.entities(docs(s, d)).select("doc_id", "seq", "original_text"),
        "analyze": analysed,
        "occurrences": occurrences,
        "standalone": standalone,
        "default_confirmed": lambda s, d: entity_rows(s, d).select("entity_id", (F.col("type") != "LUOGO").alias("confirmed")),
        "confirmed_filter": lambda s, d: entity_rows(s, d).filter("confirmed").select("entity_id", "type", "original_text"),
        "initials": lambda s, d: entity_rows(s, d).select("entity_id", tx.initials(F.col("original_text")).alias("initials")),
        "dictionary": lambda s, d: dictionary(s, d).select("key", "type", "base", "pseudonym"),
        "structured_codes": lambda s, d: dictionary(s, d).filter("base is null").select("key", "type", "pseudonym"),
        "suffix_numbering": lambda s, d: dictionary(s, d).filter("base is not null").select("key", "base", "pseudonym"),
        "dictionary_stats": lambda s, d: pseudonyms.stats(dictionary(s, d)),
        "dictionary_reuse": dictionary_reuse,
        "same_name_pairs": lambda s, d: resolve.same_name_pairs(seq_entities(s, d)),
        "greedy_dedupe": lambda s, d: resolve.greedy_dedupe(seq_entities(s, d), docs(s, d)),
        "noise_flags": lambda s, d: resolve.noise_flags(seq_entities(s, d), docs(s, d)),
        "merge_entities": merged,
        "batch_file_entities": lambda s, d: review.for_files(merged(s, d), seq_entities(s, d)).select("doc_id", "key", "occurrences", "file_count"),
        "batch_totals": batch_results,
        "review_counts": lambda s, d: review.review_counts(entity_rows(s, d)),
        "quote_normalise": lambda s, d: load(s, d, "documents").select("doc_id", tx.plain_quotes(F.col("text")).alias("text")),
        "redact_text": redacted_texts,
        "redact_safe": redacted_safe,
        "redacted_pseudonyms": lambda s, d: entity_rows(s, d).filter("confirmed").groupBy("doc_id").agg(F.countDistinct("pseudonym").alias("pseudonyms")),
        "detect_format": lambda s, d: docs(s, d, "path").select("doc_id", files.detect_format(F.col("path")).alias("detected")),
        "allowed_suffix": lambda s, d: docs(s, d, "path").select("doc_id", files.allowed(F.col("path")).alias("allowed")),
        "output_path": lambda s, d: docs(s, d, "path").select("doc_id", redact.output_path().alias("output_path")),
        "txt_normalise": lambda s, d: docs(s, d).select("doc_id", tx.unified_breaks(F.col("text")).alias("text")),
        "page_count": lambda s, d: docs(s, d).filter("text is not null").select("doc_id", tx.page_count(F.col("text")).alias("pages")),
        "strip_markdown": lambda s, d: docs(s, d, "format", "text").filter("format = 'markdown'").select("doc_id", files.strip_markdown(F.col("text")).alias("text")),
        "page_chunks": lambda s, d: docs(s, d).select("doc_id", F.posexplode(spans.page_chunks(F.col("text"))).alias("chunk", "text")),
        "char_chunks": lambda s, d: docs(s, d).filter("text is not null").select("doc_id", F.posexplode(spans.char_chunks(F.col("text"), 1000)).alias("chunk", "text")),
        "word_chunks": lambda s, d: spans.word_chunks(docs(s, d)),
        "span_filter": spans_of_names,
        "token_spans": token_spans,
        "llm_valid": llm_rows,
        "llm_parse": llm_parse,
        "scanned_flag": lambda s, d: pdf.scanned(docs(s, d, "text", "page_count")).select("doc_id", "is_scanned"),
        "spaced_letters": lambda s, d: load(s, d, "documents").select("doc_id", tx.fused_letters(F.regexp_replace("text", r"\b(\p{L})(\p{L})(\p{L})\b", "$1 $2 $3")).alias("text")),
        **{f"filing_{n}": (lambda s, d, n=n: extract.matches(filings(s, d), (BY_NAME[n],))) for n in FILED},
        "llm_dictionary": llm_dictionary,
        "scanned_routes": scanned_routes,
        "pdf_lines": lambda s, d: pdf.lines(_tokens(s, d)).withColumn("avg_font_size", F.round("avg_font_size", 4)),
        "pdf_page_text": lambda s, d: pdf.page_texts(_tokens(s, d)),
        "pdf_document_text": lambda s, d: pdf.document_texts(pdf.page_texts(_tokens(s, d))),
        "ocr_document": lambda s, d: pdf.ocr_texts(pages(s, d)).withColumn("mean_confidence", F.round("mean_confidence", 6)),
        "bbox_flip": boxes,
        "pii_report": report,
    }


def _replaced(text: str, values: dict[str, str]) -> str:
    for k, v in values.items():
        text = text.replace("$" + k, v)
    return text


_OCC = COUNT.format(x="e.original_text")
_ALONE = "len(regexp_extract_all(d.text, '(?i)\\b' || regexp_escape(e.original_text) || '\\b'))"
_NOISE = """
WITH $DOCS, $ENTS, n AS (
  SELECT e.doc_id, e.entity_id AS seq, e.type, e.original_text AS o, lower(e.original_text) AS low, CAST(coalesce($OCC, 0) AS INTEGER) AS occ, coalesce($ALONE, 0) AS alone,
         len(regexp_split_to_array($TRIM, '$WS+')) AS words
  FROM ents e JOIN docs d ON e.doc_id = d.doc_id WHERE e.original_text <> ''
), longer AS (
  SELECT s.doc_id, s.seq, max(b.occ) AS most FROM n s JOIN n b ON s.doc_id = b.doc_id AND s.type IS NOT DISTINCT FROM b.type AND length(b.o) > length(s.o) AND contains(b.low, s.low) GROUP BY s.doc_id, s.seq
), shorter AS (
  SELECT DISTINCT b.doc_id, b.seq FROM n b JOIN n s ON s.doc_id = b.doc_id AND s.type IS NOT DISTINCT FROM b.type AND length(b.o) > length(s.o) AND contains(b.low, s.low) AND s.words >= 2 AND s.alone <= b.occ
), flagged AS (
  SELECT n.doc_id, n.seq, n.occ AS occurrences, n.occ = 0 AS absent, coalesce(n.type IN $TYPES AND n.words = 1 AND n.alone <= 2 * l.most, false) AS within_longer, coalesce(n.type IN $TYPES AND h.seq IS NOT NULL, false) AS holds_shorter
  FROM n LEFT JOIN longer l ON n.doc_id = l.doc_id AND n.seq = l.seq LEFT JOIN shorter h ON n.doc_id = h.doc_id AND n.seq = h.seq
)
SELECT *, NOT absent AND NOT within_longer AND NOT holds_shorter AS kept FROM flagged
"""
_GREEDY = """
WITH RECURSIVE $DOCS, $ENTS, n AS (
  SELECT e.doc_id, list(struct_pack(seq := e.entity_id, toks := $TOKS, occ := coalesce($OCC, 0)) ORDER BY e.entity_id) AS ns
  FROM ents e JOIN docs d ON e.doc_id = d.doc_id WHERE e.type IN ('PERSONA', 'ORGANIZZAZIONE') AND e.original_text <> '' GROUP BY e.doc_id
), s AS (
  SELECT doc_id, 1 AS i, 2 AS j, CAST([] AS BIGINT[]) AS gone, ns FROM n
  UNION ALL
  SELECT doc_id, CASE WHEN outer_gone OR j >= len(ns) THEN i + 1 ELSE i END, CASE WHEN outer_gone OR j >= len(ns) THEN i + 2 ELSE j + 1 END,
    CASE WHEN outer_gone OR list_contains(gone, j) OR len(ns[i].toks) < 2 OR len(ns[j].toks) < 2 OR len(list_intersect(ns[i].toks, ns[j].toks)) < least(len(ns[i].toks), len(ns[j].toks)) THEN gone
      WHEN len(ns[i].toks) < len(ns[j].toks) OR len(ns[i].toks) = len(ns[j].toks) AND ns[i].occ >= ns[j].occ THEN list_append(gone, CAST(j AS BIGINT)) ELSE list_append(gone, CAST(i AS BIGINT)) END, ns
  FROM (SELECT *, j = i + 1 AND list_contains(gone, i) AS outer_gone FROM s WHERE i < len(ns))
), ended AS (SELECT doc_id, ns, gone, unnest(range(1, len(ns) + 1)) AS k FROM s WHERE i >= len(ns))
SELECT doc_id, ns[k].seq AS seq, list_contains(gone, k) AS dropped FROM ended
"""
_CHAR_CHUNKS = """
WITH RECURSIVE $DOCS, c AS (
  SELECT doc_id, 0 AS chunk, 0 AS pos, text, CASE WHEN length(text) <= $MOST THEN length(text) ELSE $CUT0 END AS cut FROM docs WHERE text IS NOT NULL
  UNION ALL
  SELECT doc_id, chunk + 1, pos + cut, text, $CUT1 FROM c WHERE pos + cut < length(text)
)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, substr(text, pos + 1, cut) AS text FROM c
"""


def _cut_sql(at: str, most: int) -> str:
    """The length of the chunk that begins at `at`: up to the last line break within reach, or full."""
    window = f"substr(text, {at} + 1, {most} + 1)"
    back = f"(length({window}) - length(regexp_extract({window}, '[^\\n]*$')) - 1)"
    return f"CASE WHEN {at} + {most} < length(text) AND instr({window}, chr(10)) > 0 AND {back} > 0 THEN {back} ELSE least({most}, length(text) - {at}) END"


_WORD_CHUNKS = """
WITH RECURSIVE $DOCS, w AS (SELECT doc_id, text, regexp_split_to_array(text, '$WS+') AS ws FROM docs WHERE text IS NOT NULL),
c AS (
  SELECT doc_id, -1 AS chunk, 0 AS a, 0 AS e, ws FROM w WHERE len(ws) > $TARGET
  UNION ALL
  SELECT doc_id, chunk + 1, e, CASE WHEN e + $TARGET >= len(ws) THEN len(ws)
    ELSE coalesce(list_max(list_filter(range(greatest(e + $TARGET - $BACK, e) + 1, e + $TARGET + 1), lambda i: regexp_matches(ws[i], '[.?!]$'))), e + $TARGET) END, ws
  FROM c WHERE e < len(ws)
)
SELECT doc_id, CAST(chunk AS INTEGER) AS chunk, array_to_string(ws[a + 1 : e], ' ') AS text FROM c WHERE chunk >= 0
UNION ALL SELECT doc_id, 0, text FROM w WHERE len(ws) <= $TARGET
"""
_TOKEN_SPANS = """
WITH RECURSIVE t AS (SELECT DISTINCT doc_id, chunk, name_id, list_filter(string_split(original, ' '), lambda w: w <> '') AS ws FROM llm_names WHERE original IS NOT NULL),
s AS (
  SELECT doc_id, chunk, name_id, 1 AS k, 0 AS part, ws[1] AS word, CAST(1.0 AS DOUBLE) AS score, ws FROM t WHERE len(ws) > 0
  UNION ALL
  SELECT doc_id, chunk, name_id, k + 1, CASE WHEN goes_on THEN part ELSE part + 1 END, CASE WHEN NOT goes_on THEN ws[k + 1] WHEN starts_with(ws[k + 1], '##') THEN word || substr(ws[k + 1], 3)
    ELSE word || CASE WHEN suffix(word, chr(39)) OR starts_with(ws[k + 1], chr(39)) THEN '' ELSE ' ' END || ws[k + 1] END, CAST(1.0 AS DOUBLE) - CAST(k AS DOUBLE) / 10, ws
  FROM (SELECT *, starts_with(ws[k + 1], '##') OR length(word) - length(replace(word, ' ', '')) + 1 < $MOST AS goes_on FROM s WHERE k < len(ws))
), ended AS (SELECT doc_id, chunk, name_id, part, arg_max(word, k) AS word, min(score) AS score FROM s GROUP BY ALL)
SELECT doc_id, chunk, CAST(row_number() OVER (PARTITION BY doc_id, chunk ORDER BY name_id, part) - 1 AS INTEGER) AS span, word, 'PER' AS label, score FROM ended
"""
_PDF_LINES = """
WITH RECURSIVE t AS (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY y DESC, x, pos, str) AS k FROM
  (SELECT DISTINCT doc_id, page, pos, str, x, y, font_size FROM pdf_tokens WHERE x IS NOT NULL AND y IS NOT NULL AND trim(str) <> '')),
s AS (
  SELECT doc_id, page, k, str, x, y, pos, font_size, [y] AS anchors, CAST(1 AS BIGINT) AS line FROM t WHERE k = 1
  UNION ALL
  SELECT n.doc_id, n.page, n.k, n.str, n.x, n.y, n.pos, n.font_size, CASE WHEN n.hit IS NULL THEN list_append(n.anchors, n.y) ELSE n.anchors END, coalesce(n.hit, len(n.anchors) + 1)
  FROM (SELECT t.*, s.anchors, list_min(list_filter(range(1, len(s.anchors) + 1), lambda i: abs(s.anchors[i] - t.y) < $NEAR)) AS hit FROM s JOIN t ON s.doc_id = t.doc_id AND s.page = t.page AND t.k = s.k + 1) n
)
SELECT doc_id, page, CAST(line AS INTEGER) AS line_no, max(anchors[line]) AS y, round(avg(coalesce(font_size, 0)), 4) AS avg_font_size, string_agg(str, '' ORDER BY x, k) AS text FROM s GROUP BY doc_id, page, line
"""


def oracle_sql() -> dict[str, str]:
    stop = sql_list(NAME_STOPWORDS)
    toks = f"list_distinct(list_filter(regexp_split_to_array(regexp_replace(lower(original_text), '[.\\-–,;:()]', ' ', 'g'), {q(tx.WS + '+')}), lambda w: length(w) > 1 AND w NOT IN {stop}))"
    low = f"lower({sql_trim('original')})"
    first = f"regexp_split_to_array({low}, {q(tx.WS + '+')})[1]"
    valid = f"coalesce({low} NOT IN {sql_list(ANSWER_STOPWORDS)} AND length({sql_trim('original')}) > 2 AND {first} NOT IN {sql_list(ANSWER_STOPWORDS)} AND len(regexp_split_to_array({low}, {q(tx.WS + '+')})) <= 6"
    valid += "".join(f" AND NOT regexp_matches({sql_trim('original')}, {q(tx.re2(p))})" for p in ANSWER_SPURIOUS) + ", false)"
    dotted = f"CASE WHEN regexp_full_match({sql_trim('replacement')}, {q(f'(?:[A-Z]{chr(92)}.{tx.WS}*)+')}) THEN 'PERSONA' ELSE 'ORGANIZZAZIONE' END"
    suffix = "lower(string_split(path, '.')[-1])"
    md = "text"
    for pattern, new in [
        (f"(?m)^#{{1,6}}{tx.WS}+", ""), (r"\*{1,3}([^*\n]+)\*{1,3}", r"\1"), (r"_{1,3}([^_\n]+)_{1,3}", r"\1"), (r"`([^`]+)`", r"\1"), (r"```[\s\S]*?```", ""), (r"\[([^\]]*)\]\([^)]*\)", r"\1"),
        (r"!\[([^\]]*)\]\([^)]*\)", r"\1"), (f"(?m)^>{tx.WS}?", ""), (f"(?m)^{tx.WS}*[-*+]{tx.WS}+", ""), (f"(?m)^{tx.WS}*\\d+\\.{tx.WS}+", ""), (f"(?m)^[-*_]{{3,}}{tx.WS}*$", ""), (r"\n{3,}", "\n\n"),
    ]:
        md = f"regexp_replace({md}, {q(pattern)}, {q(new)}, 'g')"
    merge = f"WITH {ENTS}, m AS (SELECT lower(original_text) AS key, min_by(struct_pack(type := type, original_text := original_text, pseudonym := pseudonym, confirmed := confirmed), struct_pack(a := doc_id, b := entity_id)) AS f, CAST(sum(coalesce(occurrences, 0)) AS BIGINT) AS occurrences, CAST(count(DISTINCT doc_id) AS INTEGER) AS file_count FROM ents WHERE original_text IS NOT NULL GROUP BY 1)"
    plain = lambda c: f"translate({c}, {q(tx.QUOTES_FROM)}, {q(tx.QUOTES_TO)})"
    hit = "'(?i)' || regexp_escape(x.o)"
    fold = (
        "CASE WHEN es IS NULL THEN struct_pack(t := {text}, n := 0, o := '', p := '') ELSE list_reduce(es, lambda acc, x: struct_pack(t := regexp_replace(acc.t, {hit}, replace(x.p, chr(92), chr(92) || chr(92)), 'g'), "
        "n := acc.n + CASE WHEN regexp_matches(acc.t, {hit}) THEN 1 ELSE 0 END, o := '', p := ''), struct_pack(t := {text}, n := 0, o := '', p := '')) END"
    ).format(text=plain("d.text"), hit=hit)
    ws = tx.WS.replace("'", "''")
    words = {"DOCS": DOCS, "ENTS": ENTS, "OCC": _OCC, "ALONE": _ALONE, "TRIM": sql_trim("e.original_text"), "WS": ws, "TYPES": sql_list(NAME_TYPES), "CUT0": _cut_sql("0", 1000), "CUT1": _cut_sql("(pos + cut)", 1000)}
    filed = "SELECT entity_id AS doc_id, " + " || ".join(q(x) if k % 2 == 0 else {"0": "original_text", "1": "upper(original_text)"}[x] for k, x in enumerate(re.split(r"\{(\d)\}", FILING))) + " AS text FROM ents WHERE type = 'PERSONA' AND original_text IS NOT NULL"
    label = "CASE name_id % 4 WHEN 0 THEN 'PER' WHEN 1 THEN 'ORG' WHEN 2 THEN 'LOC' ELSE 'MISC' END"
    clean = f"regexp_replace({sql_trim('original')}, '^#+{ws}*', '')"
    head = f"regexp_split_to_array(lower(clean), '{ws}+')[1]"
    given = f"nullif({sql_trim('replacement')}, '')"
    generic = " UNION ALL ".join(f"({sql_matches(p, k, 'documents')})" for k, p in enumerate(p for p in PATTERNS if p.stage == 3))
    return {
        "match_email_docs": f"SELECT doc_id, stage, pattern, ord, raw, type FROM ({sql_matches(BY_NAME['email'], 0, 'documents')})",
        **{f"match_{p.name}": _match_sql(p) for p in PATTERNS},
        "matches_all": f"WITH {DOCS}, m AS ({ALL}) SELECT doc_id, stage, pattern, ord, raw, type FROM m",
        "entities_distinct_first": f"WITH {SQL_ENTITIES} SELECT doc_id, type, raw AS original_text, occurrences, type <> 'LUOGO' AS confirmed FROM c WHERE occurrences > 0",
        "entities_sorted": f"WITH {SQL_ENTITIES} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY occurrences DESC, stage, place, ord) - 1 AS INTEGER) AS seq, raw AS original_text FROM c WHERE occurrences > 0",
        "occurrences": f"WITH {DOCS}, {ENTS} SELECT e.entity_id, {COUNT.format(x='e.original_text')} AS occurrences FROM ents e JOIN docs d ON e.doc_id = d.doc_id WHERE e.original_text <> '' AND d.text IS NOT NULL",
        "default_confirmed": f"WITH {ENTS} SELECT entity_id, type <> 'LUOGO' AS confirmed FROM ents",
        "confirmed_filter": f"WITH {ENTS} SELECT entity_id, type, original_text FROM ents WHERE confirmed",
        "initials": f"WITH {ENTS} SELECT entity_id, {_INITIALS} AS initials FROM ents",
        "dictionary": SQL_DICTIONARY + "SELECT key, type, base, pseudonym FROM dict",
        "structured_codes": SQL_DICTIONARY + "SELECT key, type, pseudonym FROM dict WHERE base IS NULL",
        "suffix_numbering": SQL_DICTIONARY + "SELECT key, base, pseudonym FROM dict WHERE base IS NOT NULL",
        "dictionary_stats": SQL_DICTIONARY + "SELECT type, count(*) AS entries, count(*) FILTER (WHERE base IS NULL) AS coded FROM dict GROUP BY type",
        "dictionary_reuse": SQL_DICTIONARY + f"SELECT name_id, pseudonym FROM llm_names LEFT JOIN dict ON key = lower({sql_trim('original')})",
        "same_name_pairs": f"WITH {ENTS}, t AS (SELECT doc_id, entity_id AS seq, {toks} AS ts FROM ents WHERE type IN ('PERSONA', 'ORGANIZZAZIONE') AND original_text IS NOT NULL) SELECT a.doc_id, a.seq AS seq_a, b.seq AS seq_b FROM t a JOIN t b ON a.doc_id = b.doc_id AND a.seq < b.seq WHERE len(a.ts) >= 2 AND len(b.ts) >= 2 AND len(list_intersect(a.ts, b.ts)) = least(len(a.ts), len(b.ts))",
        "merge_entities": merge + " SELECT key, f.type AS type, f.original_text AS original_text, f.pseudonym AS pseudonym, f.confirmed AS confirmed, occurrences, file_count FROM m",
        "batch_file_entities": merge + ", h AS (SELECT DISTINCT doc_id, lower(original_text) AS key FROM ents WHERE original_text IS NOT NULL) SELECT h.doc_id, h.key, m.occurrences, m.file_count FROM h JOIN m ON h.key = m.key",
        "batch_totals": f"WITH {DOCS}, {ENTS}, n AS (SELECT doc_id, count(DISTINCT pseudonym) AS r FROM ents WHERE confirmed GROUP BY doc_id), t AS (SELECT d.batch_id, coalesce({sql_trim('d.text')}, '') = '' AS bad, n.r FROM docs d LEFT JOIN n ON d.doc_id = n.doc_id) SELECT batch_id, count(*) FILTER (WHERE NOT bad) AS done, count(*) FILTER (WHERE bad) AS failed, CAST(coalesce(sum(r) FILTER (WHERE NOT bad), 0) AS BIGINT) AS replaced FROM t GROUP BY batch_id",
        "review_counts": f"WITH {ENTS} SELECT doc_id, count(*) FILTER (WHERE confirmed) AS confirmed, count(*) AS entities FROM ents GROUP BY doc_id",
        "quote_normalise": f"SELECT doc_id, translate(text, {q(tx.QUOTES_FROM)}, {q(tx.QUOTES_TO)}) AS text FROM documents",
        "redact_text": f"WITH {DOCS}, {ENTS}, e AS (SELECT doc_id, list(struct_pack(t := '', n := 0, o := {plain('original_text')}, p := coalesce(pseudonym, '')) ORDER BY length(original_text) DESC, entity_id) AS es FROM ents WHERE confirmed AND original_text <> '' GROUP BY doc_id), r AS (SELECT d.doc_id, {fold} AS r FROM docs d LEFT JOIN e ON d.doc_id = e.doc_id WHERE d.text IS NOT NULL) SELECT doc_id, r.t AS text, r.n AS entities_replaced FROM r",
        "flagship": f"WITH m AS ({sql_matches(BY_NAME['email'], 0, 'documents')}), f AS (SELECT * FROM (SELECT *, lower(raw) AS key, row_number() OVER (PARTITION BY doc_id, lower(raw) ORDER BY ord) AS k FROM m) WHERE k = 1), c AS (SELECT f.*, row_number() OVER (PARTITION BY f.doc_id ORDER BY {COUNT.format(x='f.raw')} DESC, f.ord) AS seq FROM f JOIN documents d ON f.doc_id = d.doc_id), g AS (SELECT key, min(struct_pack(a := doc_id, b := seq)) AS arrived FROM c GROUP BY key), p AS (SELECT key, 'EMAIL_' || lpad(CAST(row_number() OVER (ORDER BY arrived) AS VARCHAR), CAST(greatest(3, length(CAST(row_number() OVER (ORDER BY arrived) AS VARCHAR))) AS INTEGER), '0') AS pseudonym FROM g), e AS (SELECT c.doc_id, list(struct_pack(t := '', n := 0, o := {plain('c.raw')}, p := p.pseudonym) ORDER BY length(c.raw) DESC, c.seq) AS es FROM c JOIN p ON c.key = p.key GROUP BY c.doc_id) SELECT doc_id, r.t AS text, r.n AS entities_replaced FROM (SELECT d.doc_id, {fold} AS r FROM documents d JOIN e ON d.doc_id = e.doc_id)",
        "redacted_pseudonyms": f"WITH {ENTS} SELECT doc_id, count(DISTINCT pseudonym) AS pseudonyms FROM ents WHERE confirmed GROUP BY doc_id",
        "detect_format": f"WITH {DOCS} SELECT doc_id, {sql_case(suffix, FORMATS, q('txt'))} AS detected FROM docs",
        "allowed_suffix": f"WITH {DOCS} SELECT doc_id, coalesce(contains(path, '.') AND {suffix} IN {sql_list(ALLOWED_SUFFIXES)}, false) AS allowed FROM docs",
        "output_path": f"WITH {DOCS} SELECT doc_id, regexp_replace(path, '(?s)^(.*?)(\\.[^./\\\\]*)?$', '\\1_anonimizzato\\2') AS output_path FROM docs",
        "txt_normalise": f"WITH {DOCS} SELECT doc_id, regexp_replace(text, '\\r\\n?', chr(10), 'g') AS text FROM docs",
        "page_count": f"WITH {DOCS} SELECT doc_id, CAST(greatest(1, ceil(length(text) / 3000.0)) AS INTEGER) AS pages FROM docs WHERE text IS NOT NULL",
        "strip_markdown": f"WITH {DOCS} SELECT doc_id, {sql_trim(md)} AS text FROM docs WHERE format = 'markdown'",
        "page_chunks": f"WITH {DOCS}, c AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '\\n\\n+'), lambda p: length({sql_trim('p')}) > 50) AS l FROM docs WHERE text IS NOT NULL) SELECT doc_id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS chunk, unnest(l) AS text FROM c",
        "llm_valid": f"SELECT name_id, {valid} AS valid, CASE WHEN replacement IS NOT NULL THEN {dotted} END AS type FROM llm_names",
        "llm_parse": f"SELECT doc_id, chunk, original, replacement, {dotted} AS type FROM llm_names WHERE original IS NOT NULL AND replacement IS NOT NULL AND {valid}",
        "scanned_flag": f"WITH {DOCS} SELECT doc_id, length(coalesce(text, '')) / greatest(coalesce(page_count, 1), 1) < 80 AS is_scanned FROM docs",
        "ocr_document": f"WITH {PAGES} SELECT doc_id, array_to_string(list(coalesce(text, '') ORDER BY page, text), chr(10) || chr(10)) AS text, count(*) AS page_count, round(avg(confidence), 6) AS mean_confidence, count(*) FILTER (WHERE confidence < 60) AS low_pages FROM pages GROUP BY doc_id",
        "standalone": f"WITH {DOCS}, {ENTS} SELECT e.entity_id, CAST({_ALONE} AS INTEGER) AS standalone FROM ents e JOIN docs d ON e.doc_id = d.doc_id WHERE e.original_text <> '' AND d.text IS NOT NULL",
        "greedy_dedupe": _replaced(_GREEDY, words | {"TOKS": toks.replace("original_text", "e.original_text")}),
        "noise_flags": _replaced(_NOISE, words),
        "char_chunks": _replaced(_CHAR_CHUNKS, words | {"MOST": "1000"}),
        "word_chunks": _replaced(_WORD_CHUNKS, words | {"TARGET": str(CHUNK_WORDS), "BACK": str(CHUNK_BACK)}),
        "token_spans": _replaced(_TOKEN_SPANS, {"MOST": str(MODEL_WORDS_MAX)}),
        "span_filter": f"SELECT name_id, type, clean FROM (SELECT name_id, {sql_case('label', LABEL_TYPE)} AS type, {clean} AS clean, score, {sql_case('label', {k: str(v) for k, v in SCORE_THRESHOLD.items()}, q(str(DEFAULT_THRESHOLD)))}::DOUBLE AS least FROM (SELECT *, {label} AS label, ((name_id * 37) % 100) / 100.0::DOUBLE AS score FROM llm_names WHERE original IS NOT NULL)) WHERE score >= least AND type IS NOT NULL AND length(clean) >= 3 AND NOT regexp_matches(clean, '^[. ]') AND {head} NOT IN {stop} AND lower(clean) NOT IN {sql_list(CERTIFICATE_NOISE)} AND NOT (type = 'ORGANIZZAZIONE' AND {head} IN {sql_list(PUBLIC_BODIES)})",
        "pdf_lines": _replaced(_PDF_LINES, {"NEAR": str(pdf.LINE_NEAR)}),
        **{f"filing_{n}": f"WITH {ENTS}, docs AS ({filed}) SELECT doc_id, stage, pattern, ord, raw, type FROM ({sql_matches(BY_NAME[n], 0)})" for n in FILED},
        "llm_dictionary": SQL_DICTIONARY.replace(
            "original_text IS NOT NULL),", f"original_text IS NOT NULL), given AS (SELECT doc_id, name_id AS seq, {dotted} AS type, original AS original_text, lower({sql_trim('original')}) AS key, {given} AS given FROM llm_names WHERE replacement IS NOT NULL AND {valid}), every AS (SELECT *, NULL AS given, 1 AS phase FROM keyed UNION ALL SELECT *, CASE WHEN given IS NULL THEN 1 ELSE 0 END FROM given),", 1
        ).replace("ORDER BY doc_id, seq) AS k FROM keyed", "ORDER BY doc_id, phase, seq) AS k FROM every").replace("CASE WHEN type NOT IN", "CASE WHEN given IS NOT NULL THEN given WHEN type NOT IN").replace("ORDER BY doc_id, seq, key)", "ORDER BY doc_id, phase, seq, key)") + "SELECT key, type, base, pseudonym FROM dict",
        "scanned_routes": f"WITH {DOCS}, {PAGES}, o AS (SELECT doc_id, array_to_string(list(coalesce(text, '') ORDER BY page, text), chr(10) || chr(10)) AS o_text, count(*) AS o_pages, count(*) FILTER (WHERE confidence < 60) AS low FROM pages GROUP BY doc_id), j AS (SELECT d.doc_id, d.format, d.text, d.page_count, length(coalesce(d.text, '')) / greatest(coalesce(d.page_count, 1), 1) AS per, coalesce(d.format = 'pdf', false) AND length(coalesce(d.text, '')) / greatest(coalesce(d.page_count, 1), 1) < 80 AS thin, o.*, coalesce({sql_trim('o_text')} <> '', false) AS has FROM docs d LEFT JOIN o ON d.doc_id = o.doc_id), u AS (SELECT *, (thin OR coalesce(format = 'image', false)) AND has AS used FROM j) SELECT doc_id, CASE WHEN used THEN o_text ELSE text END AS text, CASE WHEN used THEN CAST(o_pages AS INTEGER) ELSE page_count END AS page_count, CASE WHEN used THEN 'ocr' ELSE 'digital' END AS source, concat_ws('; ', CASE WHEN thin THEN 'scanned: ' || CAST(round(per) AS INTEGER) || ' characters a page' END, CASE WHEN used AND low > 0 THEN 'low confidence: ' || low || ' pages' END, CASE WHEN (thin OR format = 'image') AND NOT used THEN 'no readings of its pages' END) AS warnings FROM u",
        "bbox_flip": "SELECT doc_id, page, round(x, 4) AS x, round(842 - (y + height), 4) AS y, round((x + width) - x, 4) AS width, round((y + height) - y, 4) AS height, round(least(greatest(((y + height) - y) * 0.75, 5.0), 10.0), 4) AS font_size, CAST(token_id AS VARCHAR) AS pseudonym FROM (SELECT DISTINCT * FROM pdf_tokens) WHERE x IS NOT NULL AND y IS NOT NULL AND width IS NOT NULL AND height IS NOT NULL",
        "pii_report": f"WITH m AS ({generic}), f AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(raw) ORDER BY stage, place, ord) AS k FROM m) WHERE k = 1), c AS (SELECT f.type, d.lang, d.source, f.doc_id, {COUNT.format(x='f.raw')} AS n FROM f JOIN documents d ON f.doc_id = d.doc_id) SELECT type, lang, source, count(*) AS entities, count(DISTINCT doc_id) AS documents, CAST(sum(n) AS BIGINT) AS occurrences FROM c WHERE n > 0 GROUP BY type, lang, source",
    }
