"""One form for strings that look alike (problem 2): DuckDB inside Arrow partitions.

The mapping is embedded SQL: `regexp_replace` drops invisible characters, `replace` opens ligatures, `translate`
maps compatibility forms, blanks and look-alike letters one to one, `nfc_normalize` joins combining accents.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.sources.tables import load

#: Letters of other scripts whose shape is that of a Latin letter, by Latin letter.
LOOKALIKES = {
    "a": "аɑα", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "іι", "j": "јϳ", "l": "ӏ", "o": "оοօ",
    "p": "рρ", "q": "ԛ", "s": "ѕ", "u": "սυ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у",
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ",
    "N": "Ν", "O": "ОΟՕ", "P": "РΡ", "Q": "Ԛ", "S": "Ѕ", "T": "ТΤ", "V": "Ѵ", "W": "Ԝ", "X": "ХΧ", "Y": "УΥҮ", "Z": "Ζ",
}
#: Kinds of Unicode compatibility decomposition whose result a reader takes for the same letters.
SAME_LOOK = ("<wide>", "<narrow>", "<font>", "<compat>", "<noBreak>")


def _tables() -> tuple[str, str, dict[str, str], str]:
    """(translate from, translate to, openings of ligatures, class of invisible characters), by rule from Unicode."""
    one: dict[str, str] = {ch: latin for latin, chars in LOOKALIKES.items() for ch in chars}
    many: dict[str, str] = {}
    invisible = []
    for cp in range(0xA0, sys.maxunicode + 1):
        ch = chr(cp)
        kind = unicodedata.category(ch)
        if kind in ("Cs", "Co", "Cn"):
            continue
        if kind == "Cf" or 0xFE00 <= cp <= 0xFE0F or 0xE0100 <= cp <= 0xE01EF or cp in (0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0):
            invisible.append(cp)
        elif kind == "Zs":
            one[ch] = " "
        elif ch in one:
            continue
        elif (form := unicodedata.decomposition(ch)).startswith(SAME_LOOK):
            plain = unicodedata.normalize("NFKC", ch)
            plain = "".join(one.get(c, c) for c in plain)
            if len(plain) == 1:
                one[ch] = plain
            elif plain.isascii() and plain.isalpha():
                many[ch] = plain
        elif form and not form.startswith("<"):
            parts = unicodedata.normalize("NFD", ch)
            if parts[0] in one and len(joined := unicodedata.normalize("NFC", one[parts[0]] + parts[1:])) == 1:
                one[ch] = joined
    runs: list[list[int]] = []
    for cp in invisible:
        if runs and runs[-1][1] == cp - 1:
            runs[-1][1] = cp
        else:
            runs.append([cp, cp])
    hidden = "[" + "".join(f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs) + "]"
    return "".join(one), "".join(one.values()), many, hidden


_FROM, _TO, _MANY, _HIDDEN = _tables()


def canonical_sql(column: str) -> str:
    """DuckDB expression of the consistent form of `column`; null stays null."""
    out = f"regexp_replace({column}, '{_HIDDEN}', '', 'g')"
    for ch, plain in _MANY.items():
        out = f"replace({out}, '{ch}', '{plain}')"
    plain = _TO.replace("'", "''")
    return f"nfc_normalize(translate({out}, '{_FROM}', '{plain}'))"


#: Forms of strings that a worker has met; forgotten when they grow too many.
_met: dict[str, str] = {}
MET = 500_000


def _canonicalise(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the form of the last column: each different string of a batch that is not ASCII is mapped once."""
    import duckdb

    con = duckdb.connect(config={"threads": 1})
    query = f"SELECT original, {canonical_sql('original')} AS canonical FROM part"  # noqa: S608
    for batch in batches:
        column = batch.column(batch.num_columns - 1).cast(pa.string()).dictionary_encode()
        strings = column.dictionary
        mapped = pc.invert(pc.string_is_ascii(strings))
        different = strings.filter(mapped).to_pylist()
        if len(_met) > MET:
            _met.clear()
        if new := [s for s in different if s not in _met]:
            con.register("part", pa.table({"original": pa.array(new, pa.string())}))
            _met.update(con.sql(query).fetchall())
            con.unregister("part")
        forms = pc.replace_with_mask(strings, mapped, pa.array([_met[s] for s in different], pa.string()))
        yield pa.RecordBatch.from_arrays([*batch.columns, forms.take(column.indices)], names=[*batch.schema.names, "canonical"])


def canonical(strings: DataFrame, column: str) -> DataFrame:
    """`strings` with `canonical`, the consistent form of `column`, as a further column.

    Null and empty strings stay as they are, blank ones become plain spaces; rows and other columns are kept,
    repeated rows included. `strings` must not have a column named canonical.
    """
    if "canonical" in strings.columns:
        raise ValueError("a column is already named canonical")
    keep = [c for c in strings.columns if c != column]
    ordered = strings.select(*keep, column)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ordered.schema)
    return ordered.mapInArrow(_canonicalise, f"{schema}, canonical string")


def _strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = load(spark, sf_dir, "pdf_tokens").select(F.lit("str").alias("field"), F.col("token_id").alias("id"), F.col("str").alias("original"))
    entities = load(spark, sf_dir, "entities_in").select(F.lit("original_text").alias("field"), F.col("entity_id").alias("id"), F.col("original_text").alias("original"))
    return tokens.unionByName(entities)


def p2_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return canonical(_strings(spark, sf_dir), "original").select("field", "id", "original", "canonical").distinct()


def found(strings: DataFrame, terms: DataFrame) -> DataFrame:
    """(field, id, term_id) of the strings (field, id, original) that look like a term but are stored otherwise.

    Null strings match nothing; repeated rows count once; terms that look alike each give a row.
    """
    looks = canonical(strings.filter("original is not null"), "original")
    plain = canonical(terms.select("term_id", F.col("term").alias("original")).filter("original is not null"), "original")
    plain = plain.select("term_id", F.col("original").alias("term"), "canonical")
    return looks.join(plain, "canonical").filter("original <> term").select("field", "id", "term_id").distinct()


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(_strings(spark, sf_dir), load(spark, sf_dir, "terms"))


_UNION = (
    "SELECT 'str' AS field, token_id AS id, str AS original FROM pdf_tokens"
    " UNION ALL SELECT 'original_text', entity_id, original_text FROM entities_in"
)
ORACLE = {
    "p2_canonical": f"SELECT DISTINCT field, id, original, {canonical_sql('original')} AS canonical FROM ({_UNION})",  # noqa: S608
    "p2_found": (
        f"SELECT DISTINCT s.field, s.id, t.term_id FROM (SELECT *, {canonical_sql('original')} AS canonical FROM ({_UNION})) s"  # noqa: S608
        f" JOIN (SELECT *, {canonical_sql('term')} AS canonical FROM terms) t ON s.canonical = t.canonical WHERE s.original <> t.term"
    ),
}
