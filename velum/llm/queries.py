"""The queries of this subpackage, and the SQL that some of them can be checked by."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from velum.llm import leakage, lexicon, lookalikes, markup, names, pieces, pii, scans, sentences, stuffing


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "p1_found": sentences.p1_found,
        "p2_found": lookalikes.p2_found,
        "p2_canonical": lookalikes.p2_canonical,
        "p3_found": pii.p3_found,
        "p3_redacted": pii.p3_redacted,
        "p4_found": pieces.p4_found,
        "p4_pieces": pieces.p4_pieces,
        "p5_found": scans.p5_found,
        "p5_text": scans.p5_text,
        "p6_found": markup.p6_found,
        "p6_clean": markup.p6_clean,
        "p7_found": names.p7_found,
        "p7_classes": names.p7_classes,
        "p8_ids": lexicon.p8_ids,
        "p9_found": leakage.p9_found,
        "p10_found": stuffing.p10_found,
        "p10_measures": stuffing.p10_measures,
    }


#: Blocks between blank lines that exceed the limit, read line by line: runs of lines that are not blank.
_BLOCKS = r"""
WITH docs AS (SELECT doc_id, text FROM (SELECT doc_id, text, row_number() OVER (PARTITION BY doc_id ORDER BY loaded_at DESC NULLS LAST, text DESC) AS rn FROM documents_in) WHERE rn = 1 AND length(text) > 3000),
split AS (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(1) || chr(10)), chr(13), chr(10)), chr(10)) AS ls FROM docs),
lines AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS k FROM split),
placed AS (SELECT doc_id, k, line, regexp_full_match(line, '[\s\x01\x0B\x1C-\x1F\x{85}\p{Z}]*') AS blank, sum(length(line) + 1) OVER (PARTITION BY doc_id ORDER BY k) - length(line) - 1 AS pos FROM lines),
runs AS (SELECT *, count(*) FILTER (WHERE blank) OVER (PARTITION BY doc_id ORDER BY k) AS run FROM placed),
blocks AS (SELECT doc_id, run, min(pos) AS start_pos, max(pos + length(rtrim(line, chr(1)))) AS end_pos FROM runs WHERE NOT blank GROUP BY doc_id, run)
SELECT doc_id, CAST(start_pos AS INTEGER) AS start_pos, CAST(end_pos AS INTEGER) AS end_pos FROM blocks WHERE end_pos - start_pos > 3000
"""


def oracle_sql() -> dict[str, str]:
    return {**lookalikes.ORACLE, "p4_found": _BLOCKS}
