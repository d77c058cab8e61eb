"""Keyword-stuffed and link-list pages (problem 10): rank-frequency curves and divergence from prose, in SQL windows.

Per page: the counts of its words, ranked; a straight line through log count over log rank (slope and residual);
how far the curve reaches (log of different words over log of words). A page's windows need no other page, so DuckDB
runs them inside Arrow partitions and no text is shuffled. Per language: the words that most of its pages share. A
page's language is the one whose prose it diverges from least, so a wrong or missing `lang` does no harm. Pages are
compared with pages of their language and of comparable length.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.lexicon import parts
from velum.sources.tables import load, publish, saved

#: A word: a link or tag counts as a link; single characters in scripts that write no blanks; a run of letters.
WORD = r"<[^<>]{1,1000}>|(?:https?://|www\.)[^\s\v]+|[\p{L}\p{N}-]+\.[a-z]{2,}/[^\s\v]+|[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}]|[\p{L}\p{M}]+"
#: Last code points of the blocks that tell scripts; fixed values.
_BLOCKS = ((0x36F, "Latin"), (0x3FF, "Greek"), (0x52F, "Cyrillic"), (0x58F, "other"), (0x5FF, "Hebrew"), (0x77F, "Arabic"), (0x8FF, "other"), (0x97F, "Devanagari"), (0xDFF, "other"), (0xE7F, "Thai"), (0x1DFF, "other"), (0x1EFF, "Latin"), (0x1FFF, "Greek"), (0x303F, "other"), (0x30FF, "Kana"), (0x4DFF, "other"), (0x9FFF, "Han"), (0xABFF, "other"), (0xD7AF, "Hangul"))
#: The script of a word that is no link, by its first character.
SCRIPT = "CASE " + " ".join(f"WHEN {{0}}(word) <= {last} THEN '{name}'" for last, name in _BLOCKS) + " ELSE 'other' END"
#: Share of a language's pages that hold a word for it to count as common, and pages needed for a language.
COMMON_SHARE = 0.3
LEAST_PAGES = 8
#: Codes by which a label says that it names no one language.
NO_LANGUAGE = ("und", "mul", "mis", "zxx")
#: A label that names a language: two or three letters, by themselves or before a subtag.
LANGUAGE = r"^([a-z]{2,3})(?:[-_]|$)"
#: Pages of a language and length class needed to compare with the class rather than with the language.
LEAST_CLASS = 30
#: A link, a link's tag or a hash tag.
LINK = r"(?i)<a\s[^<>]{1,1000}>|(?:https?://|www\.)[^\s\v]+|[\p{L}\p{N}-]+\.[a-z]{2,}/[^\s\v]+|#[\p{L}\p{N}_]+"
#: Shorter pages show no curve.
LEAST_WORDS = 20
#: How many deviations (of half the distance between the quartiles) make divergence or curve extreme.
FAR = 6.0
#: Least distance from the median that counts, whatever the deviation: nats, slope, residual and reach.
LEAST_DIVERGENCE, LEAST_SLOPE, LEAST_RESIDUAL, LEAST_REACH = 0.25, 0.6, 0.2, 0.2
#: Nats by which chance moves the divergence of a page of one word; of n words, an n-th of it.
CHANCE = 2.0
#: An extreme curve counts only on a page that diverges by at least so many nats more than its language's median.
RISE = 0.01


#: Per page of `part`(page, doc_id, lang, text): its words and their counts, links as one word.
_COUNTS = f"""
WITH raws AS (SELECT page, unnest(regexp_extract_all(lower(text), '{WORD}')) AS raw FROM part),
counts AS (SELECT page, CASE WHEN contains(raw, '/') OR contains(raw, '.') OR contains(raw, '<') THEN '<link>' ELSE raw END AS word, count(*) AS n FROM raws GROUP BY ALL),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY page) AS total, row_number() OVER (PARTITION BY page ORDER BY n DESC, word) AS rank FROM counts)
"""
#: Pages of each language that hold a word, and the sum of its shares in them; pages of the language without a word.
_SHARES = f"""{_COUNTS}
SELECT lang, word, count(*) AS df, sum(n / total) AS mass FROM ranked JOIN part USING (page) WHERE lang IS NOT NULL AND word <> '<link>' GROUP BY ALL
UNION ALL SELECT lang, NULL, count(DISTINCT page), 0 FROM ranked JOIN part USING (page) WHERE lang IS NOT NULL GROUP BY lang
"""
#: One row per page: its curve, the divergence from the nearest language's `prose`(lang, word, mass, script), and whether a
#: page too short for a curve holds more links than other words.
_PAGES = f"""{_COUNTS}, lines AS (
  SELECT page, max(total) AS total, count(*) AS types, regr_slope(ln(n), ln(rank)) AS a, regr_syy(ln(n), ln(rank)) AS yy, regr_sxy(ln(n), ln(rank)) AS xy FROM ranked GROUP BY page
), scripts AS (
  SELECT page, arg_max(script, (held, script)) AS script FROM
    (SELECT page, {SCRIPT.format("unicode")} AS script, sum(n) AS held FROM counts WHERE word <> '<link>' GROUP BY ALL) GROUP BY page
), hits AS (
  SELECT page, p.lang, least(max(p.mass), 0.999) AS q, least(sum(n / total), max(p.mass), 0.999) AS m FROM ranked JOIN prose p USING (word) GROUP BY page, p.lang
), langs AS (SELECT page, lang, q * ln(q / m) + (1 - q) * ln((1 - q) / (1 - m)) AS divergence FROM hits),
best AS (SELECT page, arg_min(lang, (divergence, lang)) AS lang, min(divergence) AS divergence FROM langs GROUP BY page),
known AS (SELECT script, least(max(mass), 0.999) AS q FROM prose GROUP BY script),
listed AS (
  SELECT page, len(regexp_extract_all(text, '{LINK}')) > len(regexp_extract_all(lower(regexp_replace(text, '{LINK}|<[^<>]{{1,1000}}>', ' ', 'g')), '{WORD}')) AS listed
  FROM part LEFT JOIN lines USING (page) WHERE coalesce(total, 0) < {LEAST_WORDS} AND regexp_matches(text, '{LINK}')
)
SELECT doc_id, coalesce(b.lang, CASE WHEN k.q IS NULL THEN 'und' ELSE 'none' END) AS lang, CAST(total AS BIGINT) AS total,
       CASE WHEN types > 1 THEN a WHEN types = 1 THEN 0.0 END AS slope, CASE WHEN types > 1 THEN sqrt(greatest(yy - a * xy, 0) / types) WHEN types = 1 THEN 0.0 END AS residual,
       ln(types) / ln(greatest(total, 2)) AS reach,
       CASE WHEN total > 0 THEN coalesce(b.divergence, k.q * ln(k.q * 2 * total) + (1 - k.q) * ln(1 - k.q), 0.0) END AS divergence, coalesce(listed, false) AS listed
FROM part LEFT JOIN lines USING (page) LEFT JOIN scripts s USING (page) LEFT JOIN best b USING (page) LEFT JOIN listed USING (page) LEFT JOIN known k ON k.script = coalesce(s.script, 'Latin')
"""


def _run(query: str, name: str | None = None):
    """The query over each part of a task's pages, each row a page of its own, with the published table `prose`."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import duckdb

        con = duckdb.connect(config={"threads": 1})
        if name is not None:
            with pa.ipc.open_file(SparkFiles.get(name)) as f:
                con.register("shared", f.read_all())
            con.execute("CREATE TABLE prose AS SELECT * FROM shared")
        for rows, _ in parts(batches, 2):
            con.register("part", pa.Table.from_batches([rows]).append_column("page", pa.array(range(rows.num_rows), pa.int64())))
            yield from con.sql(query).to_arrow_table().to_batches()
            con.unregister("part")

    return run


def _prose(pages: DataFrame) -> pa.Table:
    """(lang, word, mass, script): the words that COMMON_SHARE of a language's pages share, with the mean share of all of them.

    Every page counts once, whatever its length. Bounded: a language has at most (mean words a page) / COMMON_SHARE such
    words, and LANGUAGE admits fewer than 20,000 languages.
    """
    saved(pages.mapInArrow(_run(_SHARES), "lang string, word string, df long, mass double"), "p10-shares").createOrReplaceTempView("velum_p10_shares")
    return pages.sparkSession.sql(
        f"""
        WITH shares AS (SELECT lang, word, sum(df) AS df, sum(mass) AS mass FROM velum_p10_shares GROUP BY lang, word),
        common AS (
          SELECT s.lang, s.word, s.mass / p.df AS q FROM shares s JOIN shares p ON s.lang = p.lang
          WHERE p.word IS NULL AND s.word IS NOT NULL AND p.df >= {LEAST_PAGES} AND s.df >= {COMMON_SHARE} * p.df
        )
        SELECT lang, word, sum(q) OVER (PARTITION BY lang) AS mass, max({SCRIPT.format("ascii")}) OVER (PARTITION BY lang) AS script FROM common
        """
    ).toArrow()


def page_measures(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, total, slope, residual, reach, divergence, listed) of every page; lang is the one found.

    A page without words has null measures. Every row of `docs` with a text is a page of its own.
    """
    label = F.nullif(F.regexp_extract(F.lower("lang"), LANGUAGE, 1), F.lit(""))
    pages = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.when(~label.isin(*NO_LANGUAGE), label).alias("lang"), "text").filter("text is not null")
    prose, out = _prose(pages), pa.BufferOutputStream()
    with pa.ipc.new_file(out, prose.schema) as f:
        f.write_table(prose)
    name = publish(docs.sparkSession, out.getvalue().to_pybytes(), ".arrow")
    schema = "doc_id long, lang string, total long, slope double, residual double, reach double, divergence double, listed boolean"
    return pages.mapInArrow(_run(_PAGES, name), schema)


def stuffed(docs: DataFrame) -> DataFrame:
    """(doc_id) of the pages whose curve or divergence is extreme for their language and length.

    Pages of fewer than LEAST_WORDS words, which show no curve, are flagged if they hold more links and tags than
    other words. Null, empty and blank texts are never flagged; repeated rows are pages of their own and give one
    row; an empty table gives an empty one.
    """
    saved(page_measures(docs), "p10-pages").createOrReplaceTempView("velum_p10_pages")
    quarters = ", ".join(f"percentile_approx({m}, array(0.25, 0.5, 0.75), 1000) AS {m}" for m in ("slope", "residual", "reach", "divergence"))
    # 'none' shares no common word with a language of its script: compared with all pages
    value = {"mid": "{0}[1]", "dev": "({0}[2] - {0}[0]) / 2"}
    quarter = lambda t, m, s: value[s].format(f"{t}.{m}")
    own = lambda m, s: f"IF(k.pages >= {LEAST_CLASS}, {quarter('k', m, s)}, {quarter('l', m, s)})"
    pick = lambda m, s: f"IF(p.lang = 'none', coalesce({quarter('a', m, s)}, {quarter('b', m, s)}), {own(m, s)})"
    chance = f"{LEAST_DIVERGENCE} + {CHANCE} / p.total"
    beyond = lambda m, sign, least, of: f"{sign}(p.{m} - {of(m, 'mid')}) > greatest({FAR} * {of(m, 'dev')}, {least})"
    curve = lambda of: f"({beyond('slope', '-', LEAST_SLOPE, of)} OR {beyond('residual', '', LEAST_RESIDUAL, of)} OR {beyond('reach', '-', LEAST_REACH, of)})"
    return docs.sparkSession.sql(
        f"""
        WITH p AS (SELECT *, CAST(log2(total) AS INT) AS size FROM velum_p10_pages WHERE total >= {LEAST_WORDS}),
        k AS (SELECT lang, size, count(*) AS pages, {quarters} FROM p GROUP BY lang, size),
        l AS (SELECT lang, {quarters} FROM p GROUP BY lang),
        a AS (SELECT size, {quarters} FROM p WHERE lang NOT IN ('und', 'none') GROUP BY size),
        b AS (SELECT {quarters} FROM p WHERE lang NOT IN ('und', 'none')),
        -- 'und' has a script of no known language, so no prose to diverge from: its curve must be extreme beside every known language's
        -- (languages differ, above all those written without blanks); beside the other such pages if no language is known
        u AS (
          SELECT p.doc_id FROM p JOIN l ON l.lang NOT IN ('und', 'none') OR l.lang = 'und' AND (SELECT count_if(lang NOT IN ('und', 'none')) FROM l) = 0
          LEFT JOIN k ON k.lang = l.lang AND k.size = p.size WHERE p.lang = 'und' GROUP BY p.doc_id HAVING bool_and({curve(own)})
        )
        SELECT DISTINCT p.doc_id FROM p JOIN k ON p.lang = k.lang AND p.size = k.size JOIN l ON p.lang = l.lang LEFT JOIN a ON p.size = a.size LEFT JOIN b ON true
        WHERE p.lang <> 'und' AND ({beyond("divergence", "", chance, pick)} OR p.divergence - {pick("divergence", "mid")} > {RISE} AND {curve(pick)})
        UNION
        SELECT doc_id FROM u
        UNION
        SELECT doc_id FROM velum_p10_pages WHERE listed
        """
    )


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stuffed(load(spark, sf_dir, "documents"))


def p10_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page_measures(load(spark, sf_dir, "documents"))
