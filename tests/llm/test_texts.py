import itertools
import random
import unicodedata

import numpy as np
import pytest
from pyspark import SparkFiles

from velum.llm import leakage, lexicon, lookalikes, markup, names, pieces, pii, pii_train, scans, sentences, stuffing, tagger

# --- problem 1


MODEL = sentences.train(frozenset(["buongiorno"]))


def units(text):
    return [text[s:e] for s, e in sentences.units(text, MODEL, frozenset(["buongiorno"]))]


@pytest.mark.parametrize(
    ("text", "expected"),
    [
        ("Il sig. Rossi paga. Chi tace? Nulla!", ["Il sig. Rossi paga.", "Chi tace?", "Nulla!"]),
        ("Vale l'art. 5, co. 2, del d.lgs. n. 3/2001. La spesa è di 3.5 euro.", ["Vale l'art. 5, co. 2, del d.lgs. n. 3/2001.", "La spesa è di 3.5 euro."]),
        ("IN FATTO\n \t\nIl fatto è\nnoto.\n\n3. Si decide.", ["IN FATTO", "Il fatto è\nnoto.", "3. Si decide."]),
        ("Il teste: «Era tardi. Pioveva.» Poi tacque.", ["Il teste: «Era tardi. Pioveva.»", "Poi tacque."]),
        ("«Chi è? Non so.», si legge nel verbale. Fine.", ["«Chi è? Non so.», si legge nel verbale.", "Fine."]),
        ("Paga Alfa S.p.A. Il resto è noto. Alfa S.p.A. ha pagato.", ["Paga Alfa S.p.A.", "Il resto è noto.", "Alfa S.p.A. ha pagato."]),
        ("Ha vinto.È noto.", ["Ha vinto.", "È noto."]),
        ("原告提起诉讼。证人说：“我不知道。我不在。”法院驳回！", ["原告提起诉讼。", "证人说：“我不知道。我不在。”", "法院驳回！"]),
        ("証人は「知らない。」と述べた。契約は有効か？", ["証人は「知らない。」と述べた。", "契約は有効か？"]),
        ("ศาลยกคำร้อง โจทก์ยื่นฟ้อง", ["ศาลยกคำร้อง", "โจทก์ยื่นฟ้อง"]),
        ("Ισχύει ο όρος; Το ποσό είναι 5.", ["Ισχύει ο όρος;", "Το ποσό είναι 5."]),
        ("هل الشرط صحيح؟ رفض الطلب!", ["هل الشرط صحيح؟", "رفض الطلب!"]),
        ("Am 3. Juni kam Herr Dr. Braun nach Bonn und sah das Haus. Er ging.", ["Am 3. Juni kam Herr Dr. Braun nach Bonn und sah das Haus.", "Er ging."]),
        ("Grazie. buongiorno, sono qui.", ["Grazie.", "buongiorno, sono qui."]),
        ("La prova\r\nmanca. Fine.\r\n\r\nAltro", ["La prova\r\nmanca.", "Fine.", "Altro"]),
        ("", []), (" \n\n ", []),
    ],
)
def test_sentence_units(text, expected):
    assert units(text) == expected


def test_sentence_table(spark):
    df = spark.createDataFrame([(1, "Uno. Due."), (1, "Uno. Due."), (2, None), (3, "")], "doc_id long, text string")
    assert sorted(map(tuple, sentences.sentence_units(df).collect())) == [(1, 0, 4), (1, 5, 9)]
    assert sentences.sentence_units(df.limit(0)).count() == 0


def test_start_words_count_uses_of_all_tasks(spark):
    texts = ["alfa è qui."] * 6 + ["Qui alfa tace."] * 30 + ["beta è qui."] * 6
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert sentences.start_words(df) == sentences.start_words(df.coalesce(1)) == {"beta"}


# --- problem 2


def brute_form(s):
    table = {ch: latin for latin, chars in lookalikes.LOOKALIKES.items() for ch in chars}
    s = "".join(c for c in s if unicodedata.category(c) != "Cf")
    s = "".join(" " if unicodedata.category(c) == "Zs" else c for c in s)
    s = "".join(table.get(c, c) for c in unicodedata.normalize("NFD", s))
    return unicodedata.normalize("NFKC", s)


def test_lookalikes(spark):
    strings = ["Ｔribunale", "Tr\u200bibunale", "сausa", "citta\u0300", "𝐩𝐫𝐨𝐯𝐚", "buona\u2009fede", "ﬁrma", "ⅼegge", "è", "", "prova", "Тrіbunаlе", "gia\u0300\u00ad"]
    rows = [(i, s) for i, s in enumerate(strings)] + [(99, None)]
    got = {r.id: r.canonical for r in lookalikes.canonical(spark.createDataFrame(rows, "id long, original string"), "original").collect()}
    assert got.pop(99) is None
    assert got == {i: brute_form(s) for i, s in enumerate(strings)}


def test_lookalike_terms(spark):
    strings = spark.createDataFrame([("str", 1, "сausa"), ("str", 1, "сausa"), ("str", 2, "causa"), ("str", 3, None), ("str", 4, "Causa"), ("str", 5, "causà")], "field string, id long, original string")
    terms = spark.createDataFrame([(7, "causa"), (8, None)], "term_id long, term string")
    assert [tuple(r) for r in lookalikes.found(strings, terms).collect()] == [("str", 1, 7)]


# --- problem 3


def test_gradient_of_the_tagger():
    p = tagger.fresh()
    x, y = pii_train.batch(1, 3)
    x, y = x[:16], y[:16]
    _, g = tagger.gradient(p, x, y)
    for k in ("embed", "f_h", "b_x", "out", "move"):
        i = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = {**p, k: p[k].copy()}, {**p, k: p[k].copy()}
        up[k][i] += 1e-2
        down[k][i] -= 1e-2
        assert abs((tagger.gradient(up, x, y)[0] - tagger.gradient(down, x, y)[0]) / 2e-2 - g[k][i]) < 2e-3, k


def test_viterbi_against_all_paths():
    r = np.random.default_rng(3)
    p = tagger.fresh()
    p["move"] = r.standard_normal(p["move"].shape).astype(np.float32)
    allowed = lambda a, b: b % 2 or not b or a in (b - 1, b)
    es = [r.standard_normal((n, tagger.LABELS)).astype(np.float32) for n in (3, 0, 1, 3, 2)]
    for e, found in zip(es, tagger.viterbi(p, es), strict=True):
        paths = [x for x in itertools.product(range(tagger.LABELS), repeat=len(e)) if not x or (x[0] % 2 or not x[0]) and all(map(allowed, x, x[1:]))]
        score = lambda x: sum(e[t, y] for t, y in enumerate(x)) + (p["begin"][x[0]] if x else 0) + sum(p["move"][a, b] for a, b in itertools.pairwise(x))  # noqa: B023, E731
        assert tuple(found.tolist()) == max(paths, key=score)


def test_tagger_on_held_out_wording():
    # whole templates that no training text was made from, filled with data of another seed
    maker = pii_train.Maker(987_654_321)
    assert not set(pii_train.HELD_OUT.splitlines()) & set((pii_train.TEMPLATES + pii_train.NEGATIVES).splitlines()) - {""}
    hits = wrong = missed = 0
    texts, gold = [], []
    for _ in range(300):
        t, labels = maker.sentence(maker.r.choice(pii_train.HELD_OUT.strip().splitlines()))
        texts.append(t)
        gold.append({(s, e, tagger.KINDS[k]) for s, e, k in tagger.spans(np.array(labels))})
    for found, want in zip(pii.tag_texts(texts), gold, strict=True):
        hits += len(set(found) & want)
        wrong += len(set(found) - want)
        missed += len(want - set(found))
    assert hits / (hits + wrong) > 0.9 and hits / (hits + missed) > 0.9


def test_personal_data(spark):
    text = "Il sig. Mario Rossi, C.F. RSSMRA80A01H501U, abita in via Roma 12/B, 10100 Torino (TO); scrivere a m.rossi@studio.test."
    rows = [("text", 1, text), ("text", 1, text), ("text", 2, None), ("text", 3, ""), ("pseudonym", 4, "M. R."), ("pseudonym", 5, "CF_001"), ("original_text", 6, "Tribunale di Torino")]
    df = spark.createDataFrame(rows, "field string, id long, text string")
    got = {(r.kind, text[r.start_pos : r.end_pos]) for r in pii.personal_data(df).collect() if r.id == 1}
    assert got == {("PERSONA", "Mario Rossi"), ("CODICE_FISCALE", "RSSMRA80A01H501U"), ("INDIRIZZO", "via Roma 12/B, 10100 Torino (TO)"), ("EMAIL", "m.rossi@studio.test")}
    assert pii.personal_data(df.filter("id > 1")).count() == 0
    hidden = {r.id: r.text for r in pii.redacted(df).collect()}
    assert hidden[1] == "Il sig. [PERSONA], C.F. [CODICE_FISCALE], abita in [INDIRIZZO]; scrivere a [EMAIL]."


# --- problem 4


def test_pieces():
    r = random.Random(1)
    for _ in range(60):
        words = ["x" * r.choice([1, 5, 9, 30, 4000 if r.random() < 0.01 else 3]) for _ in range(r.randrange(1, 2500))]
        text = "".join(w + r.choice([" ", " ", " ", ". ", "\n", "\n\n", "\r\n \r\n"]) for w in words)
        p = pieces.pieces(text)
        assert p[0][0] == 0 and p[-1][1] == len(text)
        for i, (s, e) in enumerate(p):
            assert e - s <= 3000 and (i == 0 or s == p[i - 1][1] - 200)
            if e < len(text) and "x" * 2800 not in text[max(0, e - 3000) : e + 3000]:
                assert text[e - 1].isspace() or text[e].isspace()
    assert pieces.pieces("") == [] and pieces.pieces("abc") == [(0, 3)] and len(pieces.pieces("z" * 9000)) == 4


def test_line_ends_of_blocks():
    assert pieces.blocks("a\r\nb") == [(0, 4)] and pieces.blocks("a\r\n\r\nb") == [(0, 1), (5, 6)]
    assert pieces.blocks("a\rb\r\rc\n\rd") == [(0, 3), (5, 6), (8, 9)]


def test_oversized_blocks(spark):
    big = "a " * 1600
    df = spark.createDataFrame([(1, f"uno\n\n{big}\nb\n \ndue"), (2, None), (3, "x\n\n" * 2000), (4, "")], "doc_id long, text string")
    assert [tuple(r) for r in pieces.oversized_blocks(df).collect()] == [(1, 5, 5 + 3202)]
    assert {r.doc_id for r in pieces.split(df).collect()} == {1, 3}


# --- problem 5


def test_scans():
    words = {w: 500.0 for w in "il giudice ha letto la memoria della banca e conferma tutto documento tecnico contabile profilo".split()}
    m = scans.Model(words, {}, {"tecnico-contabile": 9.0}, {"A - A. civile"})
    pages = [(1, "Tribunale di Roma - Sez. civile\nIl giudlce ha letto la me-\nmoria della bar-\n\npag. 1 di 2"), (2, "Tribunale di Roma - Sez. civile\nca e un profilo tecnico-\ncontabile. Conferrna tutto.\n- 2 -"), (3, "")]
    m.words["barca"] = 300.0
    got = {(x.page, x.number, k) for x in scans.read_file(pages, m) for k in x.kinds}
    assert got == {(1, 1, "furniture"), (1, 2, "misread"), (1, 2, "hyphen"), (1, 3, "hyphen"), (1, 5, "furniture"), (2, 1, "furniture"), (2, 3, "misread"), (2, 4, "furniture")}
    assert scans.paragraphs(scans.read_file(pages, m)) == "Il giudice ha letto la memoria della barca e un profilo tecnico-contabile. Conferma tutto."
    assert scans.read_file([], m) == []


def test_scans_keep_every_candidate():
    token = "casaluce"
    ways = [token[:i] + t + token[i + 1 :] for i, c in enumerate(token) for t in scans._BY_READ.get(c, ()) if len(t) == 1]
    words = {w: 900.0 - 10 * i for i, w in enumerate(ways)} | {"giusta": 500.0}
    options = [w for w, _ in sorted(scans.candidates(token, words).items(), key=lambda x: -(x[1] + scans.math.log(words[x[0]])))]
    assert len(options) > 6
    last = options[-1]
    m = scans.Model(words, {(last, "giusta"): 1e12}, {}, set())
    assert scans.decode([token, "giusta"], m) == [last, "giusta"]
    assert scans.decode([], m) == []
    long = "illuminiferiillerinniilliilliiuniilli"
    true = long.replace("feri", "teri").replace("uni", "vni")
    assert true in scans.candidates(long, {true: 9.0})


def test_scan_tables(spark):
    docs = spark.createDataFrame([("Il giudice ha letto la memoria. " * 40,), (None,)], "text string")
    pages = spark.createDataFrame([(1, 1, "Il giudice ha lctto la\nmemoria."), (2, 1, None), (3, 1, "")], "doc_id long, page int, text string")
    assert [tuple(r) for r in scans.lines_found(pages, docs).collect()] == [(1, 1, 1, "misread")]
    assert {r.doc_id: r.text for r in scans.repaired(pages, docs).collect()} == {1: "Il giudice ha letto la memoria.", 3: ""}


def test_scan_model_holds_all_words(spark):
    syllables = [c + v for c in "bcdfglmnprst" for v in "aeiou"]
    many = [a + b + c + "no" for a in syllables for b in syllables for c in syllables] + [a + b + c + "ni" for a in syllables for b in syllables for c in syllables]
    docs = spark.createDataFrame([(" ".join(many[i : i + 4000] * 2),) for i in range(0, len(many), 4000)] + [("zzuio " * 100,), ("Il zzulo tace.",), ("lo zzabo",)], "text string")
    pages = spark.createDataFrame([(1, 1, "Il zzulo tace.")], "doc_id long, page int, text string")
    assert len(set(many)) > 400_000
    assert scans.lines_found(pages, docs).count() == 0  # a rare word is no misread of a frequent one
    m = scans.open_model(SparkFiles.get(scans.publish_model(scans.counts(pages, docs))))
    assert all(w in m.words for w in (*many[::997], "zzulo", "zzabo")) and "zzula" not in m.words
    assert m.words["zzuio"] == 100 and m.pairs.get(("lo", "zzabo")) == 1 and m.pairs.get(("zzabo", "lo")) == 0


def test_running_lines_by_thirds(spark):
    r = random.Random(3)
    known = ["".join(r.choice("ab 9A") for _ in range(r.randrange(5, 16))) for _ in range(400)]
    table = spark.createDataFrame([("edge", k, "", 9) for k in set(known)] + [("word", "a", "", 1)], "kind string, a string, b string, n long")
    m = scans.open_model(SparkFiles.get(scans.publish_model(table)))
    lines = known + [k[:3] + "b" + k[4:9] + k[10:] for k in known] + [k[1:] + "z" for k in known] + ["".join(r.choice("ab 9A") for _ in range(12)) for _ in range(200)]
    assert [scans.running_line(x, m.running) for x in lines] == [scans.running_line(x, set(known)) for x in lines]


# --- problem 6


def kinds(text):
    return [(x.kind, x.text) for x in markup.leaves(text) if x.kind != "text"]


def test_markup_dialects():
    assert kinds("# A *b* #\n\nTitolo\n======\n\n- x `y`\n- [z](http://u)\n\n```py\nif a:\n  b\n```\n\n$$q = 1$$\n\nImporto: $ 500, poi $ 700.") == [("heading", "A b"), ("heading", "Titolo"), ("item", "x y"), ("item", "z"), ("code", "if a:\n  b"), ("formula", "q = 1")]
    assert kinds("<html><head><title>No</title></head><H2>A <b>b</b>&nbsp;c</H2><ul><li>uno<li>due &egrave;</ul><pre><code>a &lt; b</code></pre><p>\\[x\\]</p>") == [("heading", "A b c"), ("item", "uno"), ("item", "due è"), ("code", "a < b"), ("formula", "x")]
    assert kinds("== A '''b''' ==\n* [[x|y]]\n# due\n<source>\n c\n</source>\n:<math display=\"block\">q</math>\n[[Categoria:Z]]") == [("heading", "A b"), ("item", "y"), ("item", "due"), ("code", " c"), ("formula", "q")]
    assert kinds("\\section*{A \\emph{b}~c}\n% no\n\\begin{itemize}\\item uno \\textbf{x}\n\\item 5\\% \\end{itemize}\n\\begin{verbatim}\n# x\n\\end{verbatim}\n\\begin{equation}q\\end{equation} \\$ 5") == [("heading", "A b c"), ("item", "uno x"), ("item", "5%"), ("code", "# x"), ("formula", "q")]
    assert kinds("") == [] and kinds("solo testo, 3 * 4 * 5") == []


def test_markup_tables(spark):
    df = spark.createDataFrame([(1, "# A\n\n# A\n\nb"), (2, None), (3, "")], "doc_id long, text string")
    assert [tuple(r) for r in markup.structure(df).collect()] == [(1, "heading", "A")]
    assert {r.doc_id: r.text for r in markup.cleaned(df).collect()} == {1: "# A\n\n# A\n\nb", 3: ""}


def test_markup_paths_that_are_no_content():
    menu = "".join(f'<li><a href="/{k}">{k}</a></li>' for k in ("Home", "Sentenze", "Massime", "Contatti"))
    body = "".join(f"<p>Il giudice, sentite le parti, ha disposto la consulenza n. {i}; il perito ha depositato la relazione.</p>" for i in range(4))
    page = (
        f"<html><body><nav><h2>Menu</h2><ul>{menu}</ul></nav><div><h1>Fatto</h1>{body}<ul><li>il verbale</li><li>la <a href='/p'>perizia</a> giurata</li></ul>"
        "<pre>x = 1</pre></div><footer><a href='/x'>Privacy</a> <a href='/y'>Cookie</a></footer></body></html>"
    )
    assert kinds(page) == [("heading", "Fatto"), ("item", "il verbale"), ("item", "la perizia giurata"), ("code", "x = 1")]
    assert "Privacy" not in markup.clean(page) and "consulenza n. 3" in markup.clean(page)
    # the ratios decide: without them the menu stays
    everything = [(x.kind, x.text) for x in markup.html_leaves(page) if x.kind != "text"]
    assert ("heading", "Menu") in everything and ("item", "Home") in everything
    # a page of nothing but links has no other content to stand back to
    assert kinds(f"<ul>{menu}</ul>") == [("item", k) for k in ("Home", "Sentenze", "Massime", "Contatti")]


def test_markup_of_two_kinds():
    prose = "Il giudice, sentite le parti, ha disposto la consulenza; il perito ha depositato la relazione."
    text = f"# Fatto\n\n{prose}\n\n<div>\n<h3>Atti</h3>\n<ul><li>il verbale<li>la <b>perizia</b></ul>\n</div>\n\n- due *note*\n\n```\n<p># no</p>\n```\n"
    assert kinds(text) == [("heading", "Fatto"), ("heading", "Atti"), ("item", "il verbale"), ("item", "la perizia"), ("item", "due note"), ("code", "<p># no</p>")]


# --- problem 7

COMMON = frozenset("mario anna teresa alessandro tipografia ceramiche maria".split())


def likeness(a, b):
    return names.same(names.parse(a), names.parse(b), COMMON) > 0


def test_names():
    for a, b in [("Mario Rossetti", "ROSSETTI MARIO"), ("Rossetti, Mario", "M. Rossetti"), ("Mario Rossetti", "Mario Rosestti"), ("Dott. Mario De Luca", "M.De Luca"), ("Sandro Vergani", "Alessandro Vergani"), ("Tipografia Montasco S.r.l.", "Montasco Tipografia srl"), ("Tipografia Montasco S.r.l.", "T.M. S.r.l."), ("Tip. Montasco S.r.l.", "Tipografia Montasco"), ("Maria Teresa Volpi", "M. T. Volpi"), ("Rossetti", "Mario Rossetti")]:
        assert likeness(a, b) and likeness(b, a), (a, b)
    for a, b in [("Mario Rossetti", "Anna Rossetti"), ("Tipografia Montasco S.r.l.", "Ceramiche Montasco S.r.l."), ("Mario Rossetti", "Mario Bianchini"), ("Maria Volpi", "Maria Teresa Volpi"), ("Alfa Nova S.p.A.", "Alfa Nova S.r.l.")]:
        assert not likeness(a, b), (a, b)
    assert names.parse("Tribunale di Roma") is None and names.parse("") is None and names.parse("non trovato") is None
    assert 1 - (1 - names.MEET**names.ROWS) ** names.bands_for() >= names.RECALL


def test_name_classes(spark):
    rows = []
    for c in range(30):
        fam = "".join(random.Random(c).choice("bcdfglmnprst") + random.Random(c * 7 + k).choice("aeio") for k in range(4)) + "ni"
        rows += [(f"c{c}", c * 10 + k, n) for k, n in enumerate([f"Mario {fam}", f"{fam.upper()} MARIO", f"M. {fam}", f"Anna {fam}", f"Mario {fam}", "Roma"])]
    rows += [(f"d{c}", 500 + c, f"Maria {'bcdfghlmnp'[c]}orettini") for c in range(10)]
    rows += [("amb", 900, "Mario Verdini"), ("amb", 901, "Maria Verdini"), ("amb", 902, "M. Verdini"), ("c0", 903, None)]
    df = spark.createDataFrame([r for r in rows if r[2]], "case_ref string, id long, name string")
    got = {(r.case_ref, r.id): r.center for r in names._classed(df).collect()}
    for c in range(30):
        k = [got.get((f"c{c}", c * 10 + i)) for i in range(6)]
        assert k[0] == k[1] == k[2] == k[4] and k[3] != k[0] and k[5] is None
    assert len({got["amb", i] for i in (900, 901, 902)}) == 3


def test_popular_names_keep_their_links(spark):
    rows = []
    for c in range(30):  # the same parties in every proceeding
        for k, n in enumerate(["Mario Rossi", "ROSSI MARIO", "M. Rossi", "Rossi", "Banca Valmora S.p.A.", "Banca Valmora", "Pievecorta", "Pievecorta"]):
            rows.append((f"c{c}", c * 10 + k, n, 1, int(n == "Pievecorta")))
        rows.append((f"c{c}", c * 10 + 8, f"Mario {'bcdfg'[c % 5]}e{'lmnpr'[c // 6]}ottini", 1, 0))
    rows += [("e", 500, "Ermenegildo Rossi", 1, 0), ("e", 501, "Rossi", 1, 0), ("e", 502, "Banca", 1, 0), ("e", 503, "Rossi Ermenegildo", 1, 1)]
    df = spark.createDataFrame(rows, "case_ref string, id long, name string, typed long, placed long")
    got = {(r.case_ref, r.id): r.center for r in names._classed(df).collect()}
    for c in range(30):
        k = [got.get((f"c{c}", c * 10 + i)) for i in range(9)]
        assert k[0] and k[0] == k[1] == k[2] == k[3] and k[4] and k[4] == k[5] and k[6] is None and k[7] is None and k[8] not in (None, k[0])
    assert got["e", 500] == got["e", 501] == got["e", 503] != got["e", 502]


# --- problem 8


def test_lexicon_round_trip(tmp_path):
    r = random.Random(2)
    entries = {"".join(r.choice("abcàè ") for _ in range(r.randrange(1, 9))).encode(): [r.randrange(50_000) for _ in range(r.randrange(1, 5))] for _ in range(3000)}
    path = tmp_path / "x.lexicon"
    path.write_bytes(lexicon.compile_lexicon(entries))
    lex = lexicon.Lexicon(str(path))
    assert all(lex.find(w) == ids for w, ids in entries.items())
    assert all(lex.find(w) is None for w in (b"", b"zzz", b"ab" * 9) if w not in entries)
    assert len(lex.target) < sum(map(len, entries)) / 2  # suffixes are shared


def test_token_ids(spark):
    tiktoken = pytest.importorskip("tiktoken")
    ranks = lexicon.read_ranks(f"{lexicon.TOKENIZER_DIR}/{lexicon.VOCABULARY}")
    enc = tiktoken.Encoding("own", pat_str=lexicon.PATTERN, mergeable_ranks=ranks, special_tokens={})
    texts = ["Il giudice, l'atto e 12 città…", "", None, "<|endoftext|> \n\n  fine ", "原告提起诉讼。🙂", "a" * 5000, "Il giudice"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, ids string")
    got = {r.doc_id: r.ids for r in lexicon.token_ids(df, lexicon_words=5).collect()}
    assert got == {i: enc.encode_ordinary(t) if t else [] for i, t in enumerate(texts)}
    assert lexicon.token_ids(df.limit(0)).count() == 0


# --- problem 9


def test_tiles_cover_greedily():
    r = random.Random(4)
    for _ in range(200):
        a, b = [r.randrange(6) for _ in range(r.randrange(0, 40))], [r.randrange(6) for _ in range(r.randrange(0, 60))]
        used_a, used_b = set(), set()
        for i, j, n in leakage.tiles(a, b):
            assert a[i : i + n] == b[j : j + n] and n >= leakage.TILE
            assert not used_a & set(range(i, i + n)) and not used_b & set(range(j, j + n))
            used_a |= set(range(i, i + n))
            used_b |= set(range(j, j + n))
        for i in range(len(a) - 2):
            for j in range(len(b) - 2):
                if a[i : i + 3] == b[j : j + 3]:
                    assert used_a & set(range(i, i + 3)) or used_b & set(range(j, j + 3))


def test_leaks(spark):
    r = random.Random(6)
    vocabulary = [f"parola{i}" for i in range(3000)]
    items = {i: [r.choice(vocabulary) for _ in range(60)] for i in range(5)}
    noise = lambda n: [r.choice(vocabulary) for _ in range(n)]
    two = items[0][:24] + noise(30) + items[0][36:]  # two quotations, neither of them half
    changed = list(items[2])
    changed[10] = changed[30] = changed[50] = "altro"
    docs = {
        0: noise(50) + [w.upper() + "," for w in items[0]] + noise(40), 1: noise(30) + items[1][20:55], 2: changed, 3: items[3][:12] + noise(60), 4: items[4][30:] + noise(20) + items[4][:30], 5: noise(100), 6: two,
    }
    df = spark.createDataFrame([(i, " ".join(d)) for i, d in docs.items()] + [(0, " ".join(docs[0])), (8, None), (9, "")], "doc_id long, text string")
    it = spark.createDataFrame([(i, " ".join(d)) for i, d in items.items()] + [(77, None), (78, "")], "item_id long, text string")
    assert {tuple(x) for x in leakage.leaks(df, it).collect()} == {(0, 0), (1, 1), (2, 2), (4, 4)}
    assert {tuple(x) for x in leakage.leaks(df, it, in_memory=0).collect()} == {(0, 0), (1, 1), (2, 2), (4, 4)}
    assert leakage.leaks(df, it.limit(0)).count() == 0 and leakage.leaks(df.limit(0), it).count() == 0


# --- problem 10


def test_stuffed_pages(spark):
    r = random.Random(8)
    function = "il la di che e per non con una del".split()
    content = ["".join(r.choice("bcdfgl") + r.choice("aeiou") for _ in range(4)) for _ in range(400)]
    prose = lambda n: " ".join(r.choice(function) if r.random() < 0.5 else r.choice(content) for _ in range(n))
    rows = [(i, prose(r.randrange(60, 160)), "it") for i in range(150)]
    rows += [(1000, " ".join(["mutuo", "avvocato", "sconto"] * 50), "it"), (1001, " ".join(f"http://a{i}.test/x" for i in range(60)), None), (1002, " | ".join(r.choice(content[:12]) for _ in range(120)), "en"), (1003, prose(120) + " http://a.test/x http://b.test/y", "it")]
    rows += [(2000, None, "it"), (2001, "", "it"), (2002, "due parole", "it"), (1000, rows[150][1], "it")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert {x.doc_id for x in stuffing.stuffed(df).collect()} == {1000, 1001, 1002}
    assert stuffing.stuffed(df.limit(0)).count() == 0


def test_stuffed_pages_of_unknown_scripts(spark):
    r = random.Random(9)
    function = "il la di che e per non con una del".split()
    content = ["".join(r.choice("bcdfgl") + r.choice("aeiou") for _ in range(4)) for _ in range(400)]
    greek = str.maketrans("abcdefgilnoptu", "αβκδεφγιλνοπτυ")
    prose = lambda n: " ".join(r.choice(function) if r.random() < 0.5 else r.choice(content) for _ in range(n))
    latin = [(i, prose(r.randrange(60, 160)), "it") for i in range(150)]
    other = [(500 + i, prose(r.randrange(60, 160)).translate(greek), None if i % 2 else "und") for i in range(40)]
    other += [(1000, "αγορά φθηνό δάνειο " * 50, None), (1001, "αγορά " * 90, "und"), (1002, "ხელშეკრულება სესხი " * 60, "ka"), (1003, "μικρή σελίδα", None)]
    schema = "doc_id long, text string, lang string"
    assert {x.doc_id for x in stuffing.stuffed(spark.createDataFrame(latin + other, schema)).collect()} == {1000, 1001, 1002}
    assert {x.doc_id for x in stuffing.stuffed(spark.createDataFrame(other, schema)).collect()} == {1000, 1001, 1002}  # no language known


def test_short_pages_of_links(spark):
    rows = [(i, "Il giudice ha letto la memoria della parte e decide per la banca con la somma di venti euro oggi.", "it") for i in range(12)]
    rows += [(100, "\n".join(f"https://a{i}.test/mutuo/sconto" for i in range(9)), "it"), (101, "#mutuo #avvocato #sconto", None), (102, "<a href='http://a.test/x'>mutuo</a> <a href='http://b.test/x'></a>", "it")]
    rows += [(200, "Vedi qui: https://a.test/x", "it"), (201, "<p>Titolo</p>", "it"), (202, "Due parole", "it"), (203, "", "it"), (204, None, "it")]
    assert {r.doc_id for r in stuffing.stuffed(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {100, 101, 102}


# --- all queries


def test_queries_run(spark, sf):
    import duckdb

    from velum.llm.queries import oracle_sql, queries

    con = duckdb.connect()
    for name in ("documents", "documents_in", "entities_in", "pdf_tokens", "terms"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf}/{name}.parquet')")
    count = lambda sql: con.execute(sql).fetchone()[0]
    # what the tables alone say of the rows; every other query has cases in them
    exactly = {n: count(f"SELECT count(*) FROM ({sql})") for n, sql in oracle_sql().items()} | {
        "p8_ids": count("SELECT count(*) FROM documents"), "p10_measures": count("SELECT count(*) FROM documents WHERE text IS NOT NULL"),
        "p6_clean": count("SELECT count(DISTINCT doc_id) FROM documents_in WHERE format = 'markdown' AND text IS NOT NULL"),
    }
    least = {"p1_found": count("SELECT count(DISTINCT doc_id) FROM documents_in WHERE format <> 'markdown' AND trim(text, E' \\t\\r\\n') <> ''")}
    assert set(oracle_sql()) <= set(queries())
    for name, query in queries().items():
        df = query(spark, sf)
        n = df.count()
        assert len(set(df.columns)) == len(df.columns), name
        assert n == exactly[name] if name in exactly else n >= least.get(name, 1), (name, n)
