"""Chunks of texts, spans of a model's tokens, and the answers of a language model."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from velum.functions.lexicons import (
    ANSWER_SPURIOUS,
    ANSWER_STOPWORDS,
    CERTIFICATE_NOISE,
    CHUNK_BACK,
    CHUNK_CHARS,
    CHUNK_WORDS,
    DEFAULT_THRESHOLD,
    LABEL_TYPE,
    MODEL_WORDS_MAX,
    NAME_STOPWORDS,
    PAGE_LEAST,
    PUBLIC_BODIES,
    SCORE_THRESHOLD,
)
from velum.functions.text import SPACES, WS, java, trim_all


def page_chunks(text: Column) -> Column:
    """Parts between blank lines that hold more than PAGE_LEAST characters."""
    return F.filter(F.split(text, "\n\n+"), lambda p: F.length(trim_all(p)) > PAGE_LEAST)


def char_chunks(text: Column, most: int = CHUNK_CHARS) -> Column:
    """Chunks of at most `most` characters, cut before the last line break within reach."""
    step = F.aggregate(
        F.sequence(F.lit(1), F.size(F.split(text, "\n")) + F.ceil(F.length(text) / F.lit(most)).cast("int") + 1),
        F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("out")),
        lambda acc, _: F.when(acc["at"] >= F.length(text), acc).otherwise(_cut(text, acc, most)),
        lambda acc: acc["out"],
    )
    # a chunk ends at a line break or is full, so there are no more than both together
    return F.when(F.length(text) <= most, F.array(text)).otherwise(step)


def _cut(text: Column, acc: Column, most: int) -> Column:
    at = acc["at"]
    window = F.substr(text, at + 1, F.lit(most + 1))
    back = F.length(window) - F.instr(F.reverse(window), "\n")
    cut = F.when((at + most < F.length(text)) & (F.instr(window, "\n") > 0) & (back > 0), back).otherwise(F.least(F.lit(most), F.length(text) - at))
    return F.struct((at + cut).alias("at"), F.array_append(acc["out"], F.substr(text, at + 1, cut)).alias("out"))


def split_words(text: str, target: int = CHUNK_WORDS, back: int = CHUNK_BACK) -> list[str]:
    words = pd.Series([text]).str.split(f"[{_PY_SPACES}]+", regex=True).iloc[0]
    if len(words) <= target:
        return [text]
    out, start = [], 0
    while start < len(words):
        end = min(start + target, len(words))
        if end < len(words):
            for i in range(end, max(end - back, start), -1):
                if words[i - 1][-1:] in (".", "?", "!"):
                    end = i
                    break
        out.append(" ".join(words[start:end]))
        start = end
    return out


_PY_SPACES = "\\t\\n\\x0b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff"


def word_chunks(docs: DataFrame) -> DataFrame:
    """(doc_id, chunk, text): windows of CHUNK_WORDS words that end, where they can, with a sentence."""

    def cut(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(d, k, c) for d, t in zip(pdf["doc_id"], pdf["text"], strict=True) for k, c in enumerate(split_words(t))]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "text"])

    return docs.select("doc_id", "text").filter("text is not null").mapInPandas(cut, "doc_id long, chunk int, text string")


def chunks(docs: DataFrame, most: int = CHUNK_CHARS) -> DataFrame:
    """(doc_id, chunk, text): pages if a text has more than one, else chunks of characters."""
    pages = page_chunks(F.col("text"))
    return docs.filter("text is not null").select("doc_id", F.posexplode(F.when(F.size(pages) > 1, pages).otherwise(char_chunks(F.col("text"), most))).alias("chunk", "text"))


def aggregate_tokens(tokens: DataFrame) -> DataFrame:
    """(doc_id, chunk, span, word, label, score) of tokens(doc_id, chunk, idx, word, label, score).

    Tokens of one chunk are read in order: O closes a span, a ## piece goes on with it whatever its label, a token of
    its label that does not begin a new one is added while it has fewer than MODEL_WORDS_MAX words. The least score counts.
    """
    label = F.upper(F.regexp_replace("label", "^[BI]-", ""))
    rows = tokens.select("doc_id", "chunk", F.struct("idx", "word", label.alias("label"), F.col("label").startswith("B-").alias("begins"), "score").alias("t"))
    per_chunk = rows.groupBy("doc_id", "chunk").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    span = "struct<word:string,label:string,score:double>"
    start = F.struct(F.array().cast(f"array<{span}>").alias("done"), F.lit(None).cast(span).alias("cur"))

    def closed(acc: Column) -> Column:
        return F.when(acc["cur"].isNull(), acc["done"]).otherwise(F.array_append(acc["done"], acc["cur"]))

    def step(acc: Column, t: Column) -> Column:
        cur = acc["cur"]
        least = F.least(cur["score"], t["score"])
        glued = F.struct(F.concat(cur["word"], F.regexp_replace(t["word"], "^##", "")).alias("word"), cur["label"].alias("label"), least.alias("score"))
        tight = cur["word"].endswith("'") | t["word"].startswith("'")
        added = F.struct(F.concat(cur["word"], F.when(tight, F.lit("")).otherwise(F.lit(" ")), t["word"]).alias("word"), cur["label"].alias("label"), least.alias("score"))
        fresh = F.struct(t["word"].alias("word"), t["label"].alias("label"), t["score"].alias("score"))
        more = cur.isNotNull() & (cur["label"] == t["label"]) & ~t["begins"] & (F.size(F.split(cur["word"], " ")) < MODEL_WORDS_MAX)
        return (
            F.when(t["label"] == "O", F.struct(closed(acc).alias("done"), F.lit(None).cast(span).alias("cur")))
            .when(cur.isNotNull() & t["word"].startswith("##"), F.struct(acc["done"].alias("done"), glued.cast(span).alias("cur")))
            .when(more, F.struct(acc["done"].alias("done"), added.cast(span).alias("cur")))
            .otherwise(F.struct(closed(acc).alias("done"), fresh.cast(span).alias("cur")))
        )

    spans = F.aggregate("ts", start, step, closed)
    return per_chunk.select("doc_id", "chunk", F.posexplode(spans).alias("span", "s")).select("doc_id", "chunk", "span", "s.word", "s.label", "s.score")


def filter_spans(spans: DataFrame) -> DataFrame:
    """`spans` with type and clean word: scores over their label's threshold, known labels, no noise."""
    pairs = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    label = F.upper(F.regexp_replace("label", "^[BI]-", ""))
    word = F.regexp_replace(trim_all(F.col("word")), f"^#+{WS}*", "")
    first = F.get(F.split(F.lower(word), f"{WS}+"), F.lit(0))
    typed = spans.withColumn("type", pairs(LABEL_TYPE)[label]).withColumn("clean", word).withColumn("first", first).filter(F.col("score") >= F.coalesce(pairs(SCORE_THRESHOLD)[label], F.lit(DEFAULT_THRESHOLD)))
    noise = (
        (F.length("clean") < 3) | F.col("clean").rlike("^[. ]") | F.col("first").isin(*NAME_STOPWORDS) | F.lower("clean").isin(*CERTIFICATE_NOISE)
        | ((F.col("type") == "ORGANIZZAZIONE") & F.col("first").isin(*PUBLIC_BODIES))
    )
    return typed.filter(F.col("type").isNotNull() & ~noise).drop("first")


def valid_answer(original: Column) -> Column:
    """Whether a name found by a language model can be one."""
    t = trim_all(original)
    low = F.lower(t)
    words = F.split(low, f"[{SPACES}]+")
    ok = ~low.isin(*ANSWER_STOPWORDS) & (F.length(t) > 2) & ~F.get(words, F.lit(0)).isin(*ANSWER_STOPWORDS) & (F.size(words) <= 6)
    for p in ANSWER_SPURIOUS:
        ok = ok & ~t.rlike(java(p))
    return F.coalesce(ok, F.lit(False))


def answer_type(replacement: Column) -> Column:
    """Dotted capitals stand for a person, anything else for an organisation."""
    return F.when(trim_all(replacement).rlike(f"^(?:[A-Z]\\.{WS}*)+\\z"), F.lit("PERSONA")).otherwise(F.lit("ORGANIZZAZIONE"))


def parse_answers(responses: DataFrame) -> DataFrame:
    """(doc_id, chunk, idx, original, replacement, type) of responses(doc_id, chunk, content).

    The first to the last square bracket are read as JSON; elements that are no objects with two strings, and names
    that cannot be names, are passed over; content that is no JSON array gives no row.
    """
    bare = F.regexp_replace(F.regexp_replace(trim_all(F.col("content")), r"(?m)^```(?:json)?\s*", ""), r"(?m)\s*```$", "")
    array = F.from_json(F.regexp_extract(bare, r"\[[\s\S]*\]", 0), "array<string>")
    item = lambda k: F.get_json_object("item", f"$.{k}")
    is_text = lambda k: F.col("item").rlike(f'"{k}"\\s*:\\s*"')
    rows = responses.select("doc_id", "chunk", F.posexplode(array).alias("idx", "item")).filter(F.col("item").startswith("{") & is_text("original") & is_text("replacement"))
    named = rows.select("doc_id", "chunk", "idx", item("original").alias("original"), item("replacement").alias("replacement"))
    return named.filter(valid_answer(F.col("original"))).withColumn("type", answer_type(F.col("replacement")))


class Scorer(Protocol):
    """A token classifier: called once per batch of chunk texts, gives (word, label, score) tokens of each."""

    def __call__(self, texts: list[str]) -> list[list[tuple[str, str, float]]]: ...


def score_tokens(parts: DataFrame, make: "type[Scorer]") -> DataFrame:
    """(doc_id, chunk, idx, word, label, score) by a classifier that each task makes once; none is shipped."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make()
        for pdf in batches:
            found = scorer(pdf["text"].tolist())
            rows = [(d, c, i, *t) for d, c, ts in zip(pdf["doc_id"], pdf["chunk"], found, strict=True) for i, t in enumerate(ts)]
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "idx", "word", "label", "score"])

    return parts.select("doc_id", "chunk", "text").mapInPandas(run, "doc_id long, chunk int, idx int, word string, label string, score double")


def ask(parts: DataFrame, make: "type[Scorer]") -> DataFrame:
    """(doc_id, chunk, content, error) by a client that each task makes once; a failure becomes the row's error."""

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        client = make()
        for pdf in batches:
            rows = []
            for d, c, t in zip(pdf["doc_id"], pdf["chunk"], pdf["text"], strict=True):
                try:
                    rows.append((d, c, client(t), None))
                except Exception as e:  # noqa: BLE001 - any failure of the service is data here
                    rows.append((d, c, None, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "chunk", "content", "error"])

    return parts.select("doc_id", "chunk", "text").mapInPandas(run, "doc_id long, chunk int, content string, error string")
