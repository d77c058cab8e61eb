"""Personal data inside free text (problem 3): the tagger's spans, checked exactly, and texts with typed placeholders.

The tagger (a character-level BiLSTM with CRF transitions) finds the data. An exact check follows each span: its ends
are moved to those of the form its kind has (a mail address, eleven digits, whole words of a name); a span that has
the form of another kind takes that kind, one that has none is dropped.
"""

from __future__ import annotations

import importlib.resources
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm import tagger
from velum.llm.lookalikes import _FROM, _TO
from velum.llm.tagger import KINDS
from velum.sources.tables import latest, load, spread

#: Characters around a span in which the form of its kind is sought.
MARGIN = 40
#: Texts are tagged in groups of about so many characters, so that memory does not follow the batch.
GROUP_CHARS = 400_000

_PLAIN = {ord(a): b for a, b in zip(_FROM, _TO, strict=True)}
_STREET = r"(?:[Vv][Ii][Aa]|[Vv]iale|V\.le|[Cc]orso|C\.so|[Pp]iazza(?:le)?|P\.zza|[Ll]argo|L\.go|[Vv]icolo|[Ss]trada|[Cc]ontrada|[Ll]oc\.|[Ll]ocalità|[Ff]raz\.|VIALE|CORSO|PIAZZA|LARGO|VICOLO|STRADA)"
_W = r"[\p{L}\p{M}'’~]+"
_TOWN = rf"\p{{Lu}}{_W}(?:[ \n](?:d['’])?\p{{Lu}}{_W}){{0,2}}"
_FORMS = {
    "EMAIL": regex.compile(r"(?<![\w.])[\w.+%~-]+(?:[ \n]?@[ \n]?|[ \n]?[(\[](?:at|chiocciola)[)\]][ \n]?)[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}(?!\w)"),
    "IBAN": regex.compile(r"(?<!\w)[Ii][Tt][ \n]?\d\d[ \n]?[A-Za-z](?:[ \n]?\d){22}(?!\d)"),
    "CODICE_FISCALE": regex.compile(r"(?<!\w)[A-Za-z]{3}[ \n-]?[A-Za-z]{3}[ \n-]?\d\d[A-Za-z]\d\d[ \n-]?[A-Za-z]\d{3}[A-Za-z](?!\w)"),
    "PARTITA_IVA": regex.compile(r"(?<![\w/])(?:[Ii][Tt][ \n]?)?(?:\d{11}|\d{3}[ \n.]\d{3}[ \n.]\d{3}[ \n.]\d{2})(?![\w/])"),
    "NUMERO_DOCUMENTO": regex.compile(r"(?<!\w)(?:[A-Z]{2}[ \n]?\d{7}|[A-Z]{2}\d{5}[A-Z]{2})(?!\w)"),
    "TELEFONO": regex.compile(r"(?<![\w/])(?:(?:\(\+39\)|\+39|0039)[ \n]?)?(?:0\d{1,3}|3\d\d)(?:[ \n./-]?\d){5,8}(?![\w/])"),
}
#: How kinds of digits are tried: the strictest form first.
_ORDER = ("EMAIL", "IBAN", "CODICE_FISCALE", "NUMERO_DOCUMENTO", "TELEFONO", "PARTITA_IVA")
_ADDRESS = regex.compile(
    rf"(?<!\w){_STREET}[ \n](?:[\p{{L}}\p{{M}}'’.~]+[ \n]){{0,6}}?[\p{{L}}\p{{M}}'’.~]+,?[ \n](?:(?:n\.|n°|nr\.|n)[ \n]?)?\d{{1,4}}(?:[ \n]?/[ \n]?[A-Za-z]\b|[ \n](?:bis|ter|quater)\b|[A-Z]\b)?"
    rf"(?:(?:[ \n]?[-–][ \n]?|,[ \n])\d{{5}}[ \n]{_TOWN}(?:[ \n]\(\p{{Lu}}{{2}}\))?|,[ \n]{_TOWN}(?:[ \n]\(\p{{Lu}}{{2}}\))?)?"
)
#: Titles, which belong to no name.
_TITLE = regex.compile(
    r"(?:\[[^\]]*\]\s*|v\.\s+|(?:sig\.ra|sig\.na|sigg?\.?|signora?|dott\.ssa|dott\.?|dr\.?|avv\.ti|avv\.?|prof\.ssa|prof\.?|ing\.?|geom\.?|arch\.?|rag\.?|notaio|mrs?\.?|ms\.?|herr|frau|mme|me|pr|sra\.|sr\.|dra\.|κ\.|डॉ\.)\s+)+",
    regex.I,
)
_NAME_END = regex.compile(r"[\p{L}\p{M}]\.?$")
_ORGANISATION = regex.compile(r"(?i)\b(?:s\.?\s?p\.?\s?a|s\.?\s?r\.?\s?l|s\.?\s?n\.?\s?c|s\.?\s?a\.?\s?s|ltd|inc)\b|^(?:tribunale|corte|procura|giudice|ufficio|registro)\b")
_PSEUDONYM = regex.compile(r"(?:\p{Lu}\.\s?)+|[A-Z]+_\d+")
_WORDCHAR = regex.compile(r"[\p{L}\p{M}\p{Cf}'’]")


def plain(text: str) -> str:
    """The text with look-alikes as the characters they show and invisible ones as '~', position by position."""
    if text.isascii():
        return text
    out = text.translate(_PLAIN)
    return "".join("~" if ord(c) > 127 and unicodedata.category(c) == "Cf" else " " if c in "\t  " else c for c in out) if not out.isascii() else out


@lru_cache(1)
def _weights() -> dict[str, np.ndarray]:
    return tagger.read(importlib.resources.files("velum.llm").joinpath("pii_weights.npz").read_bytes())


def _word_ends(text: str, s: int, e: int) -> tuple[int, int]:
    """[s, e) grown to whole words, without blanks and marks at its ends."""
    while s < e and not (text[s].isalnum()):
        s += 1
    while e > s and not (text[e - 1].isalnum() or unicodedata.category(text[e - 1]) in ("Mn", "Mc") or text[e - 1] == "."):
        e -= 1
    while s > 0 and _WORDCHAR.match(text[s - 1]) and _WORDCHAR.match(text[s]) and text[s - 1] not in "'’":
        s -= 1
    while e < len(text) and e > 0 and _WORDCHAR.match(text[e]) and _WORDCHAR.match(text[e - 1]) and text[e] not in "'’":
        e += 1
    return s, e


def _name(text: str, s: int, e: int) -> tuple[int, int] | None:
    s, e = _word_ends(text, s, e)
    if m := _TITLE.match(text, s, e):
        s = m.end()
    words = regex.findall(r"[\p{L}\p{M}'’~]+", text[s:e])
    if e > s and text[e - 1] == ".":
        # a stop belongs to a name only as that of an initial
        tail = regex.search(r"[\p{L}]+\.$", text[s:e])
        if not tail or len(tail.group()) > 2:
            e -= 1
    elif e < len(text) and text[e] == "." and words and len(words[-1]) == 1 and len(words) > 1:
        e += 1
    name = text[s:e]
    if not any(len(w) > 1 for w in words) or regex.search(r"\d|@", name) or _ORGANISATION.search(name) or not any(w[0].isupper() or not (w[0].islower()) for w in words) and len(words) < 2:
        return None
    return s, e


def _joined(view: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Spans with those of one name joined that only a blank parts, or in a string that is nothing but a name and titles, a comma."""
    out: list[tuple[int, int, int]] = []
    for s, e, k in found:
        if out and k == 0 and out[-1][2] == 0:
            gap = view[out[-1][1] : s]
            if gap.strip() == "" and len(gap) <= 1 or gap in (", ", ",") and "\n" not in view and not _TITLE.sub("", view[: out[-1][0]]).strip() and not view[e:].strip():
                out[-1] = (out[-1][0], e, 0)
                continue
        out.append((s, e, k))
    return out


def check(text: str, found: list[tuple[int, int, int]]) -> list[tuple[int, int, str]]:
    """The tagger's spans of a text after the exact check, in order and without overlaps."""
    view = plain(text).replace("\r", "\n")
    # forms are sought without invisible characters; `at` leads back
    at = [i for i, c in enumerate(view) if c != "~"] if "~" in view else range(len(view))
    solid = view.replace("~", "") if "~" in view else view
    to = {i: j for j, i in enumerate(at)} if "~" in view else None
    inner = lambda i: i if to is None else next((to[x] for x in range(i, len(view)) if x in to), len(solid))
    found = _joined(view, found)
    out: list[tuple[int, int, str]] = []
    names: list[tuple[int, int]] = []
    for s, e, k in found:
        kind = KINDS[k]
        if kind == "PERSONA":
            names.append((s, e))
            continue
        a, b = inner(s), inner(e)
        m = None
        if kind == "INDIRIZZO":
            hits = [m for m in _ADDRESS.finditer(solid, max(0, a - 12), min(len(solid), b + 60)) if m.start() < b and m.end() > a]
            m = max(hits, key=lambda m: min(b, m.end()) - max(a, m.start()), default=None)
        else:
            for other in (kind, *(o for o in _ORDER if o != kind)):
                hits = [m for m in _FORMS[other].finditer(solid, max(0, a - MARGIN), min(len(solid), b + MARGIN)) if m.start() < b and m.end() > a]
                if hits:
                    m = max(hits, key=lambda m: min(b, m.end()) - max(a, m.start()))
                    kind = other
                    break
            if m and kind == "TELEFONO" and m.group() == solid.strip() and _FORMS["PARTITA_IVA"].fullmatch(m.group()):
                kind = "PARTITA_IVA"  # eleven digits alone
        if m:
            out.append((at[m.start()], at[m.end() - 1] + 1, kind))
    taken = sorted(set(out), key=lambda x: (x[0], -x[1]))
    kept: list[tuple[int, int, str]] = []
    for x in taken:
        if not kept or x[0] >= kept[-1][1]:
            kept.append(x)
    for s, e in names:
        if (n := _name(view, s, e)) and not any(n[0] < b and n[1] > a for a, b, _ in kept):
            kept.append((*n, "PERSONA"))
    kept.sort()
    return kept


def _rows(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[list, list, list]]:
    for batch in batches:
        fields, ids, texts = (batch.column(c).to_pylist() for c in range(3))
        start = 0
        while start < len(texts):
            end, size = start, 0
            while end < len(texts) and (end == start or size + len(texts[end]) <= GROUP_CHARS):
                size += len(texts[end])
                end += 1
            yield fields[start:end], ids[start:end], texts[start:end]
            start = end


#: Spans of short strings that a worker has met; forgotten when they grow too many.
_met: dict[str, list[tuple[int, int, str]]] = {}
MET, SHORT = 200_000, 200


def _tag(fields: list, texts: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans of each text; a text that stands several times in a group, or a short one met before, is tagged once."""
    new = [t for t in dict.fromkeys(texts) if t not in _met]
    found = {t: check(t, raw) for t, raw in zip(new, tagger.tag(_weights(), new), strict=True)}
    out = [[] if f == "pseudonym" and _PSEUDONYM.fullmatch(t.strip()) else found[t] if t in found else _met[t] for f, t in zip(fields, texts, strict=True)]
    if len(_met) > MET:
        _met.clear()
    _met.update((t, spans) for t, spans in found.items() if len(t) <= SHORT)
    return out


def tag_texts(texts: list[str]) -> list[list[tuple[int, int, str]]]:
    return _tag(["text"] * len(texts), texts)


def _find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for fields, ids, texts in _rows(batches):
        rows = [(f, i, s, e, k) for f, i, found in zip(fields, ids, _tag(fields, texts), strict=True) for s, e, k in found]
        cols = list(zip(*rows, strict=True)) or [()] * 5
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["field", "id", "start_pos", "end_pos", "kind"])


def redact(text: str, found: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for s, e, kind in found:
        out += [text[at:s], f"[{kind}]"]
        at = e
    return "".join(out) + text[at:]


def _hide(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for fields, ids, texts in _rows(batches):
        hidden = [redact(t, found) for t, found in zip(texts, _tag(fields, texts), strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(fields, pa.string()), pa.array(ids, pa.int64()), pa.array(hidden, pa.string())], names=["field", "id", "text"])


def personal_data(strings: DataFrame) -> DataFrame:
    """(field, id, start_pos, end_pos, kind) of strings(field, id, text), in code points.

    Null, empty and blank strings hold nothing; repeated rows count once; very long texts are read in windows.
    """
    distinct = strings.select("field", "id", "text").filter("text is not null and text <> ''").distinct()
    return spread(distinct).mapInArrow(_find, "field string, id long, start_pos int, end_pos int, kind string").distinct()


def redacted(strings: DataFrame) -> DataFrame:
    """(field, id, text) with each datum replaced by its kind in brackets and all else unchanged; empty and null stay out."""
    distinct = strings.select("field", "id", "text").filter("text is not null and text <> ''").distinct()
    return spread(distinct).mapInArrow(_hide, "field string, id long, text string")


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = latest(load(spark, sf_dir, "documents_in").select("doc_id", "text", "loaded_at"), ["doc_id"], "loaded_at")
    entities = load(spark, sf_dir, "entities_in")
    return (
        docs.select(F.lit("text").alias("field"), F.col("doc_id").alias("id"), "text")
        .unionByName(entities.select(F.lit("original_text").alias("field"), F.col("entity_id").alias("id"), F.col("original_text").alias("text")))
        .unionByName(entities.select(F.lit("pseudonym").alias("field"), F.col("entity_id").alias("id"), F.col("pseudonym").alias("text")))
    )


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return personal_data(_strings(spark, sf_dir))


def p3_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return redacted(_strings(spark, sf_dir))
