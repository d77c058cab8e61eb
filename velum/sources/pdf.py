"""Text of PDF pages from tables of tokens, and of scanned pages from tables of readings."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from velum.functions.text import LOW_CONFIDENCE, SCANNED_BELOW, trim_all

#: How far a token may lie from its line, what counts as noise, a paragraph's gap, and headings, in parts of the median size.
LINE_NEAR, SIZE_LEAST, LEADING, PARAGRAPH, H1, H2 = 3.0, 5.0, 1.4, 1.5, 1.6, 1.3

_LETTERS = "A-Za-zÀ-ÿ"
_SPACED = re.compile(f"(?<![{_LETTERS}])([{_LETTERS}](?: [{_LETTERS}]){{2,}})(?![{_LETTERS}])")


def fuse_letters(text: str) -> str:
    return _SPACED.sub(lambda m: m.group().replace(" ", ""), text)


def cluster(tokens: list[dict]) -> list[dict]:
    """Lines of a page: from the top, each token joins the first line whose anchor is near, else opens one."""
    lines: list[dict] = []
    for t in sorted(tokens, key=lambda t: (-t["y"], t["x"])):
        line = next((k for k in lines if abs(k["y"] - t["y"]) < LINE_NEAR), None)
        if line is None:
            lines.append({"y": t["y"], "size": t["font_size"] or 0.0, "tokens": [t]})
        else:
            line["tokens"].append(t)
            n = len(line["tokens"])
            line["size"] += ((t["font_size"] or 0.0) - line["size"]) / n
    lines.sort(key=lambda k: -k["y"])
    for k in lines:
        k["tokens"].sort(key=lambda t: t["x"])
    return lines


def page_text(lines: list[dict]) -> str:
    """Lines as text: headings by size, blank lines at wide gaps, spaced letters fused."""
    sizes = sorted(t["font_size"] for k in lines for t in k["tokens"] if (t["font_size"] or 0) >= SIZE_LEAST)
    if not sizes:
        return "\n".join("".join(t["str"] for t in k["tokens"]) for k in lines)
    median = sizes[len(sizes) // 2]
    out: list[str] = []
    above = None
    for k in lines:
        text = "".join(t["str"] for t in k["tokens"]).strip()
        if not text:
            continue
        if above is not None and above - k["y"] > median * LEADING * PARAGRAPH:
            out.append("")
        ratio = k["size"] / median
        out.append(f"# {text}" if ratio >= H1 else f"## {text}" if ratio >= H2 else fuse_letters(text))
        above = k["y"]
    return "\n".join(out)


def _pages(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, ts): a page's distinct tokens with a place and a text; a page bounds the array."""
    rows = tokens.select("doc_id", "page", "pos", "str", "x", "y", "font_size").filter("x is not null and y is not null and trim(str) <> ''").distinct()
    return rows.groupBy("doc_id", "page").agg(F.array_sort(F.collect_list(F.struct("pos", "str", "x", "y", "font_size"))).alias("ts"))


def lines(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, y, avg_font_size, text) of tokens(doc_id, page, pos, str, x, y, font_size).

    Blank tokens and those without a place are left out, repeated rows count once, a null size counts as 0.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [
                (d, p, i, k["y"], float(k["size"]), "".join(t["str"] for t in k["tokens"]))
                for d, p, ts in zip(*(b.column(c).to_pylist() for c in range(3)), strict=True)
                for i, k in enumerate(cluster(ts), 1)
            ]
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.float64(), pa.float64(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "page", "line_no", "y", "avg_font_size", "text"])

    return _pages(tokens).mapInArrow(run, "doc_id long, page int, line_no int, y double, avg_font_size double, text string")


def page_texts(tokens: DataFrame) -> DataFrame:
    """(doc_id, page, text)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [page_text(cluster(ts)) for ts in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string())], names=["doc_id", "page", "text"])

    return _pages(tokens).mapInArrow(run, "doc_id long, page int, text string")


def document_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, text, page_count): pages(doc_id, page, text) in order, parted by blank lines."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc_id").agg(F.array_join(F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), "\n\n").alias("text"), F.countDistinct("page").cast("int").alias("page_count"))


def scanned(docs: DataFrame) -> DataFrame:
    """(doc_id, chars_per_page, is_scanned) of docs(doc_id, text, page_count); no pages count as one, no text as scanned."""
    per_page = F.length(F.coalesce("text", F.lit(""))) / F.greatest(F.coalesce("page_count", F.lit(1)), F.lit(1))
    return docs.select("doc_id", per_page.alias("chars_per_page"), (per_page < SCANNED_BELOW).alias("is_scanned"))


def ocr_texts(pages: DataFrame) -> DataFrame:
    """(doc_id, text, page_count, mean_confidence, low_pages) of pages(doc_id, page, text, confidence)."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "text")))
    return pages.groupBy("doc_id").agg(
        F.array_join(F.transform(ordered, lambda p: F.coalesce(p["text"], F.lit(""))), "\n\n").alias("text"), F.count("*").alias("page_count"),
        F.avg("confidence").alias("mean_confidence"), F.count_if(F.col("confidence") < LOW_CONFIDENCE).alias("low_pages"),
    )


def page_fallback(ocr: DataFrame, digital: DataFrame) -> DataFrame:
    """(doc_id, page, text, confidence): readings of scanned pages, and a page's digital text, taken as certain, where its reading is missing or blank.

    ocr(doc_id, page, text, confidence), digital(doc_id, page, text).
    """
    o, d = ocr.select("doc_id", "page", "text", "confidence"), digital.select("doc_id", "page", F.col("text").alias("digital"))
    read = F.coalesce(trim_all(F.col("text")), F.lit("")) != ""
    joined = o.join(d, ["doc_id", "page"], "full")
    return joined.select("doc_id", "page", F.when(read, F.col("text")).otherwise(F.coalesce("digital", "text")).alias("text"), F.when(read | F.col("digital").isNull(), F.col("confidence")).otherwise(F.lit(100.0)).alias("confidence"))


def routed(docs: DataFrame, ocr: DataFrame) -> DataFrame:
    """(doc_id, text, page_count, source, warnings): scanned PDF files and images with the text of their scanned pages.

    docs(doc_id, format, text, page_count), ocr as `ocr_texts` gives it. A scanned file without readings keeps its digital
    text; every other file keeps its own.
    """
    o = ocr.select("doc_id", F.col("text").alias("o_text"), F.col("page_count").alias("o_pages"), "low_pages", F.lit(True).alias("has"))
    joined = docs.select("doc_id", "format", "text", "page_count").join(scanned(docs), "doc_id").join(o, "doc_id", "left")
    thin = F.coalesce((F.col("format") == "pdf") & F.col("is_scanned"), F.lit(False))
    use = (thin | F.coalesce(F.col("format") == "image", F.lit(False))) & F.coalesce("has", F.lit(False)) & (trim_all(F.col("o_text")) != "")
    notes = F.filter(
        F.array(
            F.when(thin, F.concat(F.lit("scanned: "), F.round("chars_per_page").cast("int").cast("string"), F.lit(" characters a page"))),
            F.when(use & (F.col("low_pages") > 0), F.concat(F.lit("low confidence: "), F.col("low_pages").cast("string"), F.lit(" pages"))),
            F.when((thin | (F.col("format") == "image")) & ~use, F.lit("no readings of its pages")),
        ),
        lambda x: x.isNotNull(),
    )
    return joined.select(
        "doc_id", F.when(use, F.col("o_text")).otherwise(F.col("text")).alias("text"), F.when(use, F.col("o_pages").cast("int")).otherwise(F.col("page_count")).alias("page_count"),
        F.when(use, F.lit("ocr")).otherwise(F.lit("digital")).alias("source"), notes.alias("warnings"),
    )
