import io
import zipfile

import duckdb
import pytest
from pyspark.sql import functions as F

from velum.functions import text as tx
from velum.functions.patterns import BY_NAME, PATTERNS
from velum.operators import extract, pseudonyms, redact, resolve, review, spans
from velum.operators.numbering import numbered
from velum.plans import catalogue, pipeline
from velum.plans.pipeline import Settings, analyze
from velum.sources import files, pdf

CASES = [
    ("cf", "c.f. RSSMRA80A01H501U.", ["RSSMRA80A01H501U"]), ("cf", "rssmra80a01h501u", ["rssmra80a01h501u"]), ("cf", "RSSMRA80A01H501", []), ("cf", "àRSSMRA80A01H501U", ["RSSMRA80A01H501U"]),
    ("piva", "P.IVA: 01234567890", ["01234567890"]), ("piva", "P. IVA 01234567890 e 98765432109", ["01234567890", "98765432109"]), ("piva", "1234567890", []),
    ("iban", "IT60X0542811101000000123456", ["IT60X0542811101000000123456"]), ("iban", "DE89370400440532013000", []),
    ("email", "a mario.rossi@studio.it.", ["mario.rossi@studio.it"]), ("email", "mario at studio.it", []),
    ("phone", "tel. 06 12345678", ["06 12345678"]), ("phone", "+39 347 1234567", ["347 1234567"]), ("phone", "333 1234567", ["333 1234567"]), ("phone", "12345", []),
    ("header", "ROSSI MARIO - Presidente -", ["ROSSI MARIO"]), ("header", "Dott. Mario Rossi – Rel. Consigliere –", ["Mario Rossi"]), ("header", "Mario Rossi - avvocato -", []),
    ("party", "Ricorrente: Mario Rossi,", ["Mario Rossi"]), ("party", "ricorrente: Mario", []), ("defender", "difeso dall'avv. Carlo Bianchi.", ["Carlo Bianchi"]), ("defender", "rappresentata dall’avvocato Carla Neri,", ["Carla Neri"]),
    ("allcaps", "MARIO ROSSI", ["MARIO ROSSI"]), ("allcaps", "INPS ROMA", []), ("allcaps", "CORTE DI ROMA", []),
    ("birthdate", "nato a Roma il 01/02/1980", ["01/02/1980"]), ("birthdate", "data di nascita: 1.2.1980", ["1.2.1980"]), ("birthdate", "il 01/02/1980", []),
    ("address", "residente in Via Roma 12, 00100", ["residente in Via Roma 12, 00100"]), ("address", "Via Roma 12", []),
    ("docno", "carta d'identità n. AB12345", ["AB12345"]), ("docno", "passaporto YA1234567", ["YA1234567"]), ("docno", "numero documento: AB123456X", ["AB123456X"]), ("docno", "patente 12345", []),
    ("policy", "Contraente: Mario Rossi", ["Mario Rossi"]), ("contract", "tra Mario Rossi, nato a Roma", ["Mario Rossi"]), ("contract", "tra Mario Rossi e Carla Neri", []),
    ("expert", "CTU: Mario Rossi", ["Mario Rossi"]), ("lawyers", "avvocati Mario Rossi, Carla Neri Verdi", ["Mario Rossi", "Carla Neri Verdi"]), ("signature", "Firmato Da: ROSSI MARIO Emesso Da: ARUBA", ["ROSSI MARIO"]),
]


def test_patterns(spark):
    rows = [(i, t) for i, (_, t, _) in enumerate(CASES)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {}
    for name in {c[0] for c in CASES}:
        for r in extract.matches(docs, (BY_NAME[name],)).collect():
            got.setdefault((name, r.doc_id), []).append((r.ord, r.raw))
    for i, (name, text, expected) in enumerate(CASES):
        assert [v for _, v in sorted(got.get((name, i), []))] == expected, (name, text)


def test_entities_nulls_and_order(spark):
    t = "Scrivere a b@x.it, A@x.it e a@x.it; P.IVA 01234567890"
    docs = spark.createDataFrame([(1, t, "x"), (2, None, "x"), (3, "", "x")], "doc_id long, text string, key string")
    rows = extract.entities(docs).orderBy("doc_id", "seq").collect()
    assert [(r.original_text, r.occurrences) for r in rows] == [("A@x.it", 2), ("01234567890", 1), ("b@x.it", 1)]
    assert extract.entities(docs.limit(0)).count() == 0


def test_distinct_first_across_types(spark):
    # eleven digits that begin with 0 are a VAT number before they are a phone number
    docs = spark.createDataFrame([(1, "01234567890")], "doc_id long, text string")
    assert [(r.type, r.original_text) for r in extract.entities(docs).collect()] == [("PARTITA_IVA", "01234567890")]


def session(rows):
    """Pseudonyms as a loop over arrivals gives them."""
    import re

    d, counters = {}, {}
    for text, type_ in rows:
        key = text.strip().lower()
        if not key or key in d:
            continue
        prefix = {"EMAIL": "EMAIL", "CODICE_FISCALE": "CF"}.get(type_)
        parts = [re.sub("[^A-Za-zÀ-ÿ]", "", p) for p in re.split(r"[\s\-_]+", re.sub("[0-9]", "", re.sub(r"\(.*?\)", "", text)).strip())]
        base = None if prefix else " ".join(p[0].upper() + "." for p in parts if p) or None
        if base is None:
            counters[type_] = counters.get(type_, 0) + 1
            d[key] = f"{prefix or {'PERSONA': 'SOGGETTO', 'ORGANIZZAZIONE': 'ENTE'}.get(type_, 'LUOGO')}_{counters[type_]:03d}"
        else:
            n = sum(p == base or p.startswith(base + " (") for p in d.values())
            d[key] = f"{base} ({n + 1})" if n else base
    return d


def test_dictionary_equals_loop(spark):
    import random

    r = random.Random(3)
    rows = []
    for _ in range(300):
        t = r.choice(["PERSONA", "ORGANIZZAZIONE", "EMAIL", "CODICE_FISCALE", "LUOGO"])
        text = r.choice(["Mario", "Marco", "Anna", "De Luca", "123", "x-y"]) + " " + r.choice(["Rossi", "Riva", "Neri", "", "Verdi (n.)"])
        rows.append((text if t not in ("EMAIL", "CODICE_FISCALE") else f"{r.randrange(40)}@x.it", t))
    df = spark.createDataFrame([(i // 7, i % 7, t, x) for i, (x, t) in enumerate(rows)], "doc_id long, seq int, type string, original_text string")
    got = {x.key: x.pseudonym for x in pseudonyms.assign(pseudonyms.arrivals(df)).collect()}
    assert got == session(rows)


def test_dictionary_over_sessions(spark):
    first = spark.createDataFrame([(1, 0, "PERSONA", "Mario Rossi"), (1, 1, "EMAIL", "a@x.it"), (1, 2, "PERSONA", None), (1, 3, "PERSONA", "  ")], "doc_id long, seq int, type string, original_text string")
    known = pseudonyms.assign(pseudonyms.arrivals(first)).select("key", "type", "base", "pseudonym")
    assert {r.pseudonym for r in known.collect()} == {"M. R.", "EMAIL_001"}
    more = spark.createDataFrame([(2, 0, "PERSONA", "MARIO ROSSI "), (2, 1, "PERSONA", "Mara Riva"), (2, 2, "EMAIL", "b@x.it")], "doc_id long, seq int, type string, original_text string")
    both = {r.key: r.pseudonym for r in pseudonyms.assign(pseudonyms.arrivals(more), known).collect()}
    assert both == {"mario rossi": "M. R.", "a@x.it": "EMAIL_001", "mara riva": "M. R. (2)", "b@x.it": "EMAIL_002"}


def test_numbering_of_a_hot_group(spark):
    rows = [("hot" if i % 3 else f"g{i % 7}", i * 7919 % 5000) for i in range(5000)]
    out = numbered(spark.createDataFrame(rows, "g string, v int"), ["g"], ["v"]).collect()
    want = {}
    for g, v in sorted(rows):
        want.setdefault(g, []).append(v)
    assert all(want[r.g][r["rank"] - 1] == r.v for r in out) and len(out) == 5000


def greedy(names, text):
    toks = lambda s: {w for w in "".join(" " if c in ".-–,;:()" else c for c in s.lower()).split() if len(w) > 1 and w not in resolve.NAME_STOPWORDS}
    gone = set()
    for i, a in enumerate(names):
        if i in gone:
            continue
        for j in range(i + 1, len(names)):
            if j in gone:
                continue
            x, y = toks(a), toks(names[j])
            if len(x) < 2 or len(y) < 2 or not (x <= y or y <= x):
                continue
            n, m = text.lower().count(a.lower()), text.lower().count(names[j].lower())
            gone.add(j if len(x) <= len(y) and (len(x) < len(y) or n >= m) else i)
    return gone


def test_greedy_dedupe_equals_loop(spark):
    import random

    r = random.Random(5)
    docs, ents, want = [], [], {}
    for d in range(25):
        pool = ["Mario Rossi", "ROSSI MARIO", "Dott. Mario Rossi - Presidente", "Mario Rossi Neri", "Anna Neri", "Neri Anna", "Rossi", "Carla Neri Anna"]
        names = list(dict.fromkeys(r.choice(pool) for _ in range(r.randrange(1, 8))))
        text = " ".join(r.choice(pool) for _ in range(6))
        docs.append((d, text))
        ents += [(d, i, "PERSONA", n) for i, n in enumerate(names)]
        want[d] = greedy(names, text)
    out = resolve.greedy_dedupe(spark.createDataFrame(ents, "doc_id long, seq int, type string, original_text string"), spark.createDataFrame(docs, "doc_id long, text string"))
    got = {}
    for row in out.collect():
        got.setdefault(row.doc_id, set())
        if row.dropped:
            got[row.doc_id].add(row.seq)
    assert got == want


def test_noise_flags(spark):
    text = "Luca Bianchi parla. Luca Bianchi tace. Bianchi. Luca Bianchi Mario Rossi"
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    ents = spark.createDataFrame([(1, 0, "PERSONA", "Luca Bianchi"), (1, 1, "PERSONA", "Bianchi"), (1, 2, "PERSONA", "Luca Bianchi Mario Rossi"), (1, 3, "PERSONA", "Zeta Zeta"), (1, 4, "EMAIL", "x@y.it"), (1, 5, "PERSONA", None)], "doc_id long, seq int, type string, original_text string")
    kept = {r.seq: r.kept for r in resolve.noise_flags(ents, docs).collect()}
    assert kept == {0: True, 1: False, 2: True, 3: False, 4: False}


def test_merge_review_and_files(spark):
    ents = spark.createDataFrame(
        [(1, 0, "PERSONA", "Mario", "M.", 2, True), (2, 0, "PERSONA", "MARIO", "X.", 3, False), (2, 1, "EMAIL", "a@x.it", "E", None, True), (3, 0, "EMAIL", None, None, 1, True)],
        "doc_id long, seq int, type string, original_text string, pseudonym string, occurrences int, confirmed boolean",
    )
    m = review.merge(ents)
    rows = {r.key: r for r in m.collect()}
    assert rows["mario"].occurrences == 5 and rows["mario"].file_count == 2 and rows["mario"].original_text == "Mario" and rows["mario"].confirmed
    o = spark.createDataFrame([("mario", False, " "), ("a@x.it", None, "MAIL")], "key string, confirmed boolean, pseudonym string")
    r = {x.key: (x.confirmed, x.pseudonym) for x in review.overridden(m, o).collect()}
    assert r == {"mario": (False, "M."), "a@x.it": (True, "MAIL")}
    assert {(x.doc_id, x.key) for x in review.for_files(m, ents).collect()} == {(1, "mario"), (2, "mario"), (2, "a@x.it")}


def test_redact_modes(spark):
    docs = spark.createDataFrame([(1, "Mario Rossi e Rossini; l’ente US$ – Rossi"), (2, None), (3, "nulla")], "doc_id long, text string")
    ents = spark.createDataFrame([(1, 0, "Rossi", "$R.", True), (1, 1, "Mario Rossi", "M. R.", True), (1, 2, "ente", "X", False), (1, 3, None, "Y", True)], "doc_id long, seq int, original_text string, pseudonym string, confirmed boolean")
    a = {r.doc_id: (r.text, r.entities_replaced) for r in redact.redact(docs, ents).collect()}
    assert a == {1: ("M. R. e $R.ni; l'ente US$ - $R.", 2), 3: ("nulla", 0)}
    b = {r.doc_id: (r.text, r.entities_replaced) for r in redact.redact(docs, ents, "safe").collect()}
    assert b == {1: ("M. R. e Rossini; l'ente US$ - $R.", 2), 3: ("nulla", 0)}
    with pytest.raises(ValueError):
        redact.redact(docs, ents, "other")


def test_output_path_and_formats(spark):
    df = spark.createDataFrame([("/a/b.c/x.PDF",), ("/a/y",), ("z.md",), ("w.tar.gz",)], "path string")
    rows = df.select("path", redact.output_path().alias("o"), files.detect_format(F.col("path")).alias("f"), files.allowed(F.col("path")).alias("ok")).collect()
    assert [(r.o, r.f, r.ok) for r in rows] == [("/a/b.c/x_anonimizzato.PDF", "pdf", True), ("/a/y_anonimizzato", "txt", False), ("z_anonimizzato.md", "markdown", True), ("w.tar_anonimizzato.gz", "txt", False)]


def docx(paragraphs):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join("<w:p>" + "".join(f'<w:r><w:t xml:space="preserve">{t}</w:t></w:r>' for t in p) + "</w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<?xml version="1.0"?><w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def odt(xml):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("content.xml", f'<?xml version="1.0"?><office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><office:body><office:text>{xml}</office:text></office:body></office:document-content>')
    return out.getvalue()


def test_containers_round_trip(spark):
    a = docx([["Il sig. Ma", "rio Ros", "si paga."], ["Anna Neri &amp; C."]])
    b = odt("<text:h>Titolo</text:h><text:list><text:list-item><text:p>Mario <text:span>Rossi</text:span><text:tab/>fine</text:p></text:list-item></text:list>")
    src = spark.createDataFrame([("x.docx", bytearray(a)), ("y.odt", bytearray(b)), ("bad.docx", bytearray(b"no zip"))], "path string, content binary")
    read = {r.path: r for r in files.parse(src).collect()}
    assert read["x.docx"].text == "Il sig. Mario Rossi paga.\nAnna Neri & C." and read["y.odt"].text == "Titolo\nMario Rossi fine" and "no DOCX file" in read["bad.docx"].error
    ents = spark.createDataFrame([("x.docx", "mario rossi", "M. R.", True), ("x.docx", "Rossi", "R.", True), ("y.odt", "Mario Rossi", "M. R.", True)], "path string, original_text string, pseudonym string, confirmed boolean")
    out = {r.path: r for r in files.redact_containers(src, ents).collect()}
    assert files.docx_text(bytes(out["x.docx"].content))[0] == "Il sig. M. R. paga.\nAnna Neri & C." and out["x.docx"].entities_replaced == 1
    assert files.odt_text(bytes(out["y.odt"].content))[0] == "Titolo\nM. R. fine" and out["bad.docx"].error


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("città\r\nb".encode())
    (tmp_path / "b.txt").write_bytes("città".encode("latin-1"))
    (tmp_path / "c.md").write_text("# T\n\n**x** [l](u) ![a](b)\n- i\n")
    (tmp_path / "d.exe").write_bytes(b"x")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.parse(files.read_binary(spark, str(tmp_path))).collect()}
    assert rows["a.txt"].text == "città\nb" and rows["b.txt"].text == "città" and rows["c.md"].text == "T\n\nx l !a\ni" and rows["d.exe"].error == "suffix not allowed"
    files.write_texts(spark.createDataFrame([("/x/a_anonimizzato.txt", "ok")], "output_path string, text string"), str(tmp_path / "out"))
    assert (tmp_path / "out" / "a_anonimizzato.txt").read_text() == "ok"


def test_pdf_pages(spark):
    schema = "token_id long, doc_id long, page int, pos int, str string, x double, y double, font_size double"
    rows = [(1, 1, 1, 1, "TITOLO", 10.0, 800.0, 20.0), (2, 1, 1, 2, "a ", 10.0, 700.0, 10.0), (3, 1, 1, 3, "b", 30.0, 698.0, 10.0), (4, 1, 1, 4, "L A C", 10.0, 685.0, 10.0), (4, 1, 1, 4, "L A C", 10.0, 685.0, 10.0), (5, 1, 1, 5, " ", 1.0, 1.0, None), (6, 1, 1, 6, "n", None, 1.0, None), (7, 1, 1, 7, "d", 10.0, 671.0, 10.0)]
    t = spark.createDataFrame(rows, schema)
    assert pdf.page_texts(t).collect()[0].text == "# TITOLO\n\na b\nLAC\nd"
    assert [r.text for r in pdf.lines(t).orderBy("line_no").collect()] == ["TITOLO", "a b", "L A C", "d"]
    assert pdf.lines(t.limit(0)).count() == 0


def test_token_spans(spark):
    rows = [(1, 0, 0, "Mar", "B-PER", 0.9), (1, 0, 1, "##io", "I-PER", 0.8), (1, 0, 2, "D'", "I-PER", 0.7), (1, 0, 3, "Alba", "PER", 0.95), (1, 0, 4, ",", "O", 1.0), (1, 0, 5, "Roma", "LOC", 0.6), (1, 0, 6, "Ente", "ORG", 0.9)]
    t = spark.createDataFrame(rows, "doc_id long, chunk int, idx int, word string, label string, score double")
    got = spans.aggregate_tokens(t)
    assert [(r.word, r.label, r.score) for r in got.orderBy("span").collect()] == [("Mario D'Alba", "PER", 0.7), ("Roma", "LOC", 0.6), ("Ente", "ORG", 0.9)]
    assert {(r.clean, r.type) for r in spans.filter_spans(got).collect()} == {("Mario D'Alba", "PERSONA"), ("Ente", "ORGANIZZAZIONE")}


def test_token_spans_of_any_keys(spark, tmp_path):
    long = " ".join(f"w{i}" for i in range(104))
    ids = [(21_474_837, "D' Alba Mario"), (30_000_000, "Anna  Neri"), (10**17, long), (10**17 + 1, "Carlo ##tta Verdi"), (5, "Ugo"), (2**63 - 1, "Ada Bo"), (None, "Eva Sala")]
    rows = [(n, d, 0, 0, o, None) for d in (1, 2**40) for n, o in ids]
    t = spark.createDataFrame([*rows, rows[0], (7, 3, 1, 0, None, None)], "name_id long, doc_id long, chunk int, idx int, original string, replacement string")
    t.write.parquet(str(tmp_path / "llm_names.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW llm_names AS FROM '{tmp_path}/llm_names.parquet/*.parquet'")
    want = con.sql(catalogue.oracle_sql()["token_spans"]).fetchall()
    got = [tuple(r) for r in catalogue.token_spans(spark, str(tmp_path)).select("doc_id", "chunk", "span", "word", "label", "score").collect()]
    assert sorted(got) == sorted(want) and len(got) == 2 * (21 + 6)


def test_answers(spark):
    rows = [(1, 0, 'Ecco ```json\n[{"original": "Mario Rossi", "replacement": "M. R."}, 3, {"original": "di Roma", "replacement": "X"}, {"original": "Alfa Srl", "replacement": "Ente"}, {"original": 5, "replacement": "Y"}]\n```'), (2, 0, "niente"), (3, 0, None), (4, 0, "[rotto")]
    got = spans.parse_answers(spark.createDataFrame(rows, "doc_id long, chunk int, content string")).collect()
    assert [(r.original, r.replacement, r.type) for r in got] == [("Mario Rossi", "M. R.", "PERSONA"), ("Alfa Srl", "Ente", "ORGANIZZAZIONE")]


def char_chunks(text, most):
    if len(text) <= most:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = min(at + most, len(text))
        if end < len(text):
            nl = text.rfind("\n", 0, end + 1)
            if nl > at:
                end = nl
        out.append(text[at:end])
        at = end
    return out


def test_chunks(spark):
    texts = ["a" * 2500, ("riga di testo\n" * 300), "x" * 999 + "\n" + "y" * 1500 + "\nz", "", "breve", "\n" * 1500]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.c for r in df.select("doc_id", spans.char_chunks(F.col("text"), 1000).alias("c")).collect()}
    for i, t in enumerate(texts):
        assert got[i] == char_chunks(t, 1000), i
    long = " ".join(f"w{i}" + ("." if i % 13 == 0 else "") for i in range(1000))
    parts = spans.split_words(long)
    assert " ".join(parts) == long and all(len(p.split()) <= 400 for p in parts) and parts[0].endswith(".")


def test_spaced_letters(spark):
    df = spark.createDataFrame([("L A C O R T E dice a b",), ("P.Q. x y z!",), ("àb c d",), (None,)], "t string")
    assert [r.o for r in df.select(tx.fused_letters(F.col("t")).alias("o")).collect()] == ["LACORTE dice a b", "P.Q. xyz!", "àb c d", None]
    assert pdf.fuse_letters("L A C O R T E dice a b") == "LACORTE dice a b"


def test_boxes(spark):
    df = spark.createDataFrame([(1, 1, 800.0, [[10.0, 20.0], [30.0, 28.0], [10.0, 28.0]], "X")], "doc_id long, page int, page_height double, quads array<array<double>>, pseudonym string")
    r = redact.boxes(df).collect()[0]
    assert (r.x, r.y, r.width, r.height, r.font_size) == (10.0, 772.0, 20.0, 8.0, 6.0)


def test_settings():
    assert Settings(base_url="http://h:1/").base_url == "http://h:1/v1"
    for bad in ({"max_tokens": 1}, {"timeout_ms": 1}, {"parallel_requests": 9}, {"chunk_size": 10}, {"prompt_language": "xx"}):
        with pytest.raises(ValueError):
            Settings(**bad)


def test_analyze_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "Ricorrente: Mario Rossi, difeso dall'avv. Carlo Bianchi. Scrivere a m@x.it. ROSSI MARIO"), (2, None)], "doc_id long, text string")
    names = spark.createDataFrame([(1, 0, 0, "ROSSI MARIO", "M. R.", "PERSONA")], "doc_id long, chunk int, idx int, original string, replacement string, type string")
    got = {r.original_text for r in analyze(docs, names=names).collect()}
    assert "m@x.it" in got and "Carlo Bianchi" in got and len({"Mario Rossi", "ROSSI MARIO"} & got) == 1
    assert analyze(docs.limit(0)).count() == 0


def test_stream_reuses_the_dictionary(spark, tmp_path):
    from velum.streaming.dictionary import pseudonymise

    src = tmp_path / "in"
    spark.createDataFrame([(1, "a@x.it")], "doc_id long, text string").write.parquet(str(src))
    run = lambda: pseudonymise(spark.readStream.schema("doc_id long, text string").parquet(str(src)), str(tmp_path / "out"), str(tmp_path / "dict"), str(tmp_path / "cp")).awaitTermination()
    run()
    spark.createDataFrame([(2, "b@x.it e A@x.it")], "doc_id long, text string").write.mode("append").parquet(str(src))
    run()
    got = {r.doc_id: r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {1: "EMAIL_001", 2: "EMAIL_002 e EMAIL_001"}
    assert len(PATTERNS) == 17


def packed(xml, part="word/document.xml"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(part, xml)
    return out.getvalue()


def test_docx_keeps_its_markup(spark):
    w, mc = "http://schemas.openxmlformats.org/wordprocessingml/2006/main", "http://schemas.openxmlformats.org/markup-compatibility/2006"
    xml = (
        f'<?xml version="1.0" encoding="UTF-8" standalone="yes"?><w:document xmlns:w="{w}" xmlns:mc="{mc}" xmlns:w14="urn:w14" xmlns:ns1="urn:x" mc:Ignorable="w14 ns1"><w:body>'
        "<w:p><w:r><w:t>Mario </w:t></w:r><w:r><w:t>Rossi &amp; Rossi</w:t></w:r><w:r><w:pict><w:p><w:r><w:t>den<![CDATA[tro Ro]]>ssi</w:t></w:r></w:p></w:pict></w:r><w:r><w:t> paga</w:t></w:r></w:p>"
        "</w:body></w:document>"
    )
    content = packed(xml)
    assert files.docx_text(content) == ("Mario Rossi & Rossi paga\ndentro Rossi", 1)
    data, n = files.redact_container("a.docx", content, [("Mario Rossi", "M. R."), ("rossi", "<R>")])
    new = zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml").decode()
    assert n == 3 and new.startswith(xml[: xml.index("<w:p>")])
    assert files.docx_text(data)[0] == "M. R. & <R> paga\ndentro <R>"
    # an unchanged file keeps every byte of its part
    assert zipfile.ZipFile(io.BytesIO(files.redact_container("a.docx", content, [("Zeta", "Z")])[0])).read("word/document.xml").decode() == xml
    rows = [("a.docx", bytearray(content)), ("b.docx", bytearray(packed("<w:x"))), ("c.odt", bytearray(b"")), ("d.docx", bytearray(packed(f'<w:document xmlns:w="{w}"><w:body/></w:document>')))]
    src = spark.createDataFrame(rows, "path string, content binary")
    ents = spark.createDataFrame([(p, "Rossi", "R.", True) for p, _ in rows], "path string, original_text string, pseudonym string, confirmed boolean")
    out = {r.path: r.error for r in files.redact_containers(src, ents).collect()}
    assert out["a.docx"] is None and out["b.docx"] and out["c.odt"] and out["d.docx"] is None
    assert {r.path: list(r.warnings) for r in files.parse(src).collect()}["d.docx"] == ["no text in its body"]


def test_text_sinks(spark, tmp_path):
    rows = [("/d/a.txt", bytearray("Mario\r\nRossi e MARIO".encode())), ("/d/b.md", bytearray(b"# Mario\n\n*Rossi*")), ("/d/c.pdf", bytearray(b"x"))]
    src = spark.createDataFrame(rows, "path string, content binary")
    ents = spark.createDataFrame([(p, 0, "Mario", "M.", True) for p, _ in rows], "path string, seq int, original_text string, pseudonym string, confirmed boolean")
    out = files.redact_texts(src, ents)
    assert {r.output_path: (r.text, r.entities_replaced) for r in out.collect()} == {"/d/a_anonimizzato.txt": ("M.\r\nRossi e M.", 1), "/d/b_anonimizzato.md": ("# M.\n\n*Rossi*", 1)}
    files.write_texts(out, f"file://{tmp_path}/out")
    assert (tmp_path / "out" / "a_anonimizzato.txt").read_bytes() == b"M.\r\nRossi e M." and len(list((tmp_path / "out").iterdir())) == 2


def test_pseudonyms_of_a_language_model(spark):
    rows = [(1, 0, "PERSONA", "Mara Riva", None), (1, 1, "PERSONA", "Mario Rossi", "M. R."), (2, 0, "PERSONA", "Anna Neri", " "), (2, 1, "ORGANIZZAZIONE", "Alfa Srl", "Società A"), (3, 0, "PERSONA", "MARIO ROSSI", "X. Y.")]
    ents = spark.createDataFrame(rows, "doc_id long, seq int, type string, original_text string, replacement string")
    got = {r.key: r.pseudonym for r in pseudonyms.assign(pseudonyms.arrivals(ents, "replacement")).collect()}
    # names that come with a replacement arrive before the others of their document
    assert got == {"mario rossi": "M. R.", "mara riva": "M. R. (2)", "anna neri": "A. N.", "alfa srl": "Società A"}


def test_aliases_in_safe_mode(spark):
    docs = spark.createDataFrame([(1, "Mario Rossi paga. ROSSI MARIO tace. Il dott. Mario Rossi Neri no.")], "doc_id long, text string")
    names = spark.createDataFrame([(1, 0, 0, "Mario Rossi", "M. R.", "PERSONA"), (1, 0, 1, "Rossi  Mario", "X", "PERSONA"), (1, 0, 2, "ROSSI MARIO", "Y", "PERSONA")], "doc_id long, chunk int, idx int, original string, replacement string, type string")
    found = pipeline.analyze(docs, names=names)
    rows = {r.original_text: list(r.aliases) for r in found.collect()}
    assert rows["Mario Rossi"] == ["ROSSI MARIO", "Rossi  Mario"] and "ROSSI MARIO" not in rows
    safe, _ = pipeline.anonymize(docs, found, mode="safe")
    assert safe.collect()[0].text == "M. R. paga. M. R. tace. Il dott. M. R. Neri no."
    compat, _ = pipeline.anonymize(docs, found)
    assert "ROSSI MARIO" in compat.collect()[0].text


def test_batch_errors(spark):
    docs = spark.createDataFrame([(1, "scrivere a a@x.it", None), (2, None, "no DOCX file"), (3, " ", None)], "doc_id long, text string, error string")
    results, totals = pipeline.batch(docs)
    assert {r.doc_id: (r.text, r.entities_replaced, r.error) for r in results.collect()} == {1: ("scrivere a EMAIL_001", 1, None), 2: (None, None, "no DOCX file"), 3: (None, None, "no text")}
    assert tuple(totals.collect()[0]) == (1, 2, 1)


def test_scanned_routes(spark):
    docs = spark.createDataFrame([(1, "pdf", "ab", 1), (2, "pdf", "x" * 100, 1), (3, "image", None, None), (4, "pdf", None, 2), (5, "txt", "ab", 1)], "doc_id long, format string, text string, page_count int")
    pages = spark.createDataFrame([(1, 1, "uno", 50.0), (1, 2, "due", 90.0), (2, 1, "no", 90.0), (3, 1, "tre", None), (5, 1, "no", 90.0)], "doc_id long, page int, text string, confidence double")
    got = {r.doc_id: (r.text, r.page_count, r.source, list(r.warnings)) for r in pdf.routed(docs, pdf.ocr_texts(pages)).collect()}
    assert got[1] == ("uno\n\ndue", 2, "ocr", ["scanned: 2 characters a page", "low confidence: 1 pages"]) and got[2] == ("x" * 100, 1, "digital", [])
    assert got[3] == ("tre", 1, "ocr", []) and got[4] == (None, 2, "digital", ["scanned: 0 characters a page", "no readings of its pages"]) and got[5][2] == "digital"
    digital = spark.createDataFrame([(1, 2, "DUE"), (1, 3, "TRE")], "doc_id long, page int, text string")
    rows = {(r.doc_id, r.page): (r.text, r.confidence) for r in pdf.page_fallback(pages.withColumn("text", F.when(F.col("page") == 2, " ").otherwise(F.col("text"))), digital).collect()}
    assert rows[1, 1] == ("uno", 50.0) and rows[1, 2] == ("DUE", 100.0) and rows[1, 3] == ("TRE", 100.0) and rows[3, 1] == ("tre", None)
