"""Splitting texts over a size limit at natural boundaries (problem 4): a recursive hierarchy of separators.

A text is split by section, paragraph, sentence, word and, at last, character; parts that fit are packed greedily
into pieces up to the limit, and each piece starts with the last code points of the one before.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.sources.tables import latest, load

LIMIT = 3000
OVERLAP = 200

#: A line end, taken whole: the two characters of one are never read as two.
_EOL = r"(?>\r\n|\r|\n)"
#: A paragraph break: a line end, then lines of nothing but blanks.
_PARAGRAPH = re.compile(rf"{_EOL}(?:[^\S\r\n]*{_EOL})+|\A(?:[^\S\r\n]*{_EOL})+|{_EOL}[^\S\r\n]*\Z")
#: A section starts after a paragraph break with a heading: markup, a number with a title, or a line in capitals.
_SECTION = re.compile(rf"(?:{_EOL}[^\S\r\n]*){{2,}}(?=#{{1,6}}[^\S\r\n]|\\(?:chapter|section)|[IVXLC]+\.[^\S\r\n]|(?:Art|Capo|Titolo|Sezione)\b|[A-ZÀ-Þ][A-ZÀ-Þ .'’-]{{3,80}}{_EOL})")
_SENTENCE = re.compile(r"(?:[.!?…]+[»”\"’')\]]*(?=\s)|[。！？]+[」』”’）]*|[؟।]+(?=\s))\s*")
_WORD = re.compile(r"\s+")


class Block(NamedTuple):
    start: int
    end: int


def blocks(text: str) -> list[Block]:
    """The stretches between lines of nothing but blanks, without the line breaks at their own ends."""
    out, at = [], 0
    for m in _PARAGRAPH.finditer(text):
        if m.start() > at:
            out.append(Block(at, m.start()))
        at = m.end()
    if at < len(text):
        out.append(Block(at, len(text)))
    trimmed = []
    for s, e in out:
        while s < e and text[s] in "\r\n":
            s += 1
        while e > s and text[e - 1] in "\r\n":
            e -= 1
        if s < e and not text[s:e].isspace():
            trimmed.append(Block(s, e))
    return trimmed


def _cuts(text: str, pattern: re.Pattern[str], start: int, end: int, starts: bool = False) -> list[int]:
    cuts = [m.end() for m in pattern.finditer(text, start, end)]
    return [c for c in cuts if start < c < end] + [end]


def _parts(text: str, start: int, end: int, room: int, level: int = 0) -> Iterator[tuple[int, int]]:
    """Parts of text[start:end] of at most `room` code points, cut at the highest level that gives such parts."""
    if end - start <= room:
        yield start, end
        return
    levels = (_SECTION, _PARAGRAPH, _SENTENCE, _WORD)
    if level == len(levels):
        for s in range(start, end, room):
            yield s, min(end, s + room)
        return
    at = start
    for cut in _cuts(text, levels[level], start, end):
        yield from _parts(text, at, cut, room, level + 1)
        at = cut


def pieces(text: str, limit: int = LIMIT, overlap: int = OVERLAP) -> list[tuple[int, int]]:
    """[start, end) of the ordered pieces; from the second on, a piece's first `overlap` code points end the one before."""
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be less than limit")
    if len(text) <= limit:
        return [(0, len(text))] if text else []
    ends: list[int] = []
    begin = 0  # where the current piece's own text starts
    at = 0
    for _, e in _parts(text, 0, len(text), limit - overlap):
        lead = overlap if ends else 0
        if e - begin + lead > limit:
            ends.append(at)
            begin = at
        at = e
    ends.append(at)
    return [(max(0, (ends[i - 1] if i else 0) - (overlap if i else 0)), e) for i, e in enumerate(ends)]


def _cut(batches: Iterable[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
        rows: list[tuple] = []
        for i, text in zip(ids, texts, strict=True):
            if text is None or len(text) <= limit:
                continue
            rows.extend((i, n, s, e, text[s:e]) for n, (s, e) in enumerate(pieces(text, limit, overlap)))
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "piece", "start_pos", "end_pos", "text"])


def split(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, piece, start_pos, end_pos, text) of every text over `limit` code points, pieces numbered from 0.

    Null, empty and shorter texts have no row: they are one piece as they stand. A text without any boundary is
    cut by characters. Repeated rows give repeated pieces.
    """
    big = docs.select("doc_id", "text").filter(F.length("text") > limit)
    return big.mapInArrow(lambda it: _cut(it, limit, overlap), "doc_id long, piece int, start_pos int, end_pos int, text string")


def _oversized(batches: Iterable[pa.RecordBatch], limit: int, overlap: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            ends = [e for _, e in pieces(text, limit, overlap)]
            rows.extend((i, b.start, b.end) for b in blocks(text) if b.end - b.start > limit and any(b.start < e < b.end for e in ends))
        cols = list(zip(*rows, strict=True)) or [()] * 3
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.int32(), pa.int32()), strict=True)], names=["doc_id", "start_pos", "end_pos"])


def oversized_blocks(docs: DataFrame, limit: int = LIMIT, overlap: int = OVERLAP) -> DataFrame:
    """(doc_id, start_pos, end_pos) of every block that alone exceeds `limit`, in which the splitting ends a piece."""
    big = docs.select("doc_id", "text").filter(F.length("text") > limit)
    return big.mapInArrow(lambda it: _oversized(it, limit, overlap), "doc_id long, start_pos int, end_pos int").distinct()


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return latest(load(spark, sf_dir, "documents_in").select("doc_id", "text", "loaded_at"), ["doc_id"], "loaded_at")


def p4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return split(_docs(spark, sf_dir))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return oversized_blocks(_docs(spark, sf_dir))
