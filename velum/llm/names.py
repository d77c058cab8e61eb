"""Spellings of one person or organisation (problem 7): MinHash banding, Monge-Elkan, star clustering.

Within a proceeding each different string is one node. Nodes whose tokens share a MinHash band over padded q-grams
(or the initials of a name) are compared by Monge-Elkan similarity over tokens; stars around the most complete
spellings become the classes. Common given names and trades are learned from the corpus: words that occur in the
names of many proceedings and mostly don't end a name, as family and company words do, however frequent. Commonness
weighs words and orders blocking keys only; places are told by the rows' types.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from velum.llm.lookalikes import canonical
from velum.sources.tables import latest, load, saved, spread

#: q of the q-grams; rows of a band; similarity from which tokens must be met, with at least RECALL.
Q, ROWS, MEET, RECALL = 2, 2, 0.35, 0.99
#: Monge-Elkan similarity from which two names are the same.
SAME = 0.8
#: A word is common (a given name, a trade) if it occurs in this share of proceedings, in at least so many, and not mostly last.
COMMON_SHARE, LEAST_CASES = 0.004, 4

#: Fixed value: the type of entities_in that says place.
PLACE = "LUOGO"

#: Titles, courts and offices, particles of family names, words that say that no name was found.
TITLES = "sig sigg signor signora sigra sig.ra sig.na dott dottssa dott.ssa dr drssa avv avvssa avv.ti ing geom prof profssa prof.ssa arch rag on notaio mr mrs ms herr frau dra me mme pr dr.".split()
OFFICES = "tribunale corte procura giudice ufficio registro pretura questura ministero comune regione provincia prefettura agenzia camera cancelleria inps inail".split()
ARTICLES = "il lo la i gli le l".split()
PARTICLES = "di de del della dello dei degli delle dal dalla da la lo le li d dell dall san santa van von".split()
NO_NAMES = ("non trovato", "non indicato", "nessuno", "ignoto", "sconosciuto", "omissis", "null", "none", "nd", "na")
#: Legal forms, spelled out and in letters.
FORMS = {
    "spa": r"s\W*p\W*a|societa per azioni", "srl": r"s\W*r\W*l\W*s?|societa a responsabilita limitata(?: semplificata)?",
    "snc": r"s\W*n\W*c|(?:societa )?in nome collettivo", "sas": r"s\W*a\W*s|(?:societa )?in accomandita semplice",
    "sapa": r"s\W*a\W*p\W*a", "scarl": r"s\W*c\W*a\W*r\W*l|societa cooperativa(?: a responsabilita limitata)?", "ltd": "ltd|limited", "gmbh": r"g\W*m\W*b\W*h",
}
#: Familiar forms of given names.
NICKNAMES = {
    "alessandro": "sandro ale alex", "alessandra": "sandra ale", "andrea": "andre", "anna": "nina annina annetta", "antonietta": "nietta tonia etta", "antonio": "tonio toni tonino nino totò",
    "beatrice": "bice bea", "bruno": "brunetto", "carlo": "carletto", "carmelo": "melo", "caterina": "rina cate katia", "chiara": "chiaretta", "domenico": "mimmo menico nico", "donatella": "dona lella",
    "elisabetta": "betta lisa elisa eli", "ettore": "ettorino", "federica": "fede kika chicca", "federico": "fede rico chicco", "francesca": "franca cesca checca", "francesco": "franco cesco ciccio checco",
    "gabriele": "lele gabri", "giovanna": "gianna vanna nanna", "giovanni": "gianni nanni vanni giannino", "giulia": "giulietta", "giuseppe": "beppe peppe pino geppe peppino", "isabella": "isa bella", "lorenzo": "renzo enzo lollo",
    "lucia": "lucy lucetta", "luigi": "gigi gino luigino", "marco": "marchino", "margherita": "ghita rita marghe", "maria": "mariuccia marietta mary", "michele": "lele michi miche", "nazario": "nazareno zario", "niccolo": "nico nicco nicola",
    "nicoletta": "nico letta", "ornella": "nella orni", "pietro": "piero pierino", "pier luigi": "pigi", "raffaele": "lele raffa lello", "riccardo": "ricky ricci cardo", "roberto": "berto roby robi", "rosanna": "rosy rosa rossana",
    "salvatore": "totò toto salvo turi tore", "stefano": "ste stefanino", "teresa": "resi resy tesa", "ulisse": "uli", "valentina": "tina vale", "vincenzo": "enzo cenzo vince", "wanda": "wandina", "zoe": "zoetta",
    "maria teresa": "marisa", "maria grazia": "mariagrazia", "alberto": "berto", "ferdinando": "nando", "fernando": "nando", "filippo": "pippo", "giacomo": "mino", "giorgio": "giorgino", "leonardo": "leo nardo", "massimiliano": "massi max",
    "edoardo": "edo", "eleonora": "nora", "maddalena": "lena", "matteo": "teo", "paolo": "paolino", "rosa": "rosetta rosina", "sebastiano": "bastiano", "tommaso": "masino tommy", "umberto": "berto", "vittorio": "vito", "daniele": "dani",
}
_FULL: dict[str, set[str]] = {}
for _full, _short in NICKNAMES.items():
    for _s in _short.split():
        _FULL.setdefault(_s, set()).add(_full)

_FORM = re.compile("(?:[ ,]|^)(?:" + "|".join(f"(?P<{k}>{v})" for k, v in FORMS.items()) + r")\W*$")


class Name(NamedTuple):
    form: str  # legal form, or ''
    tokens: tuple[str, ...]  # particles joined to the word they belong to


def plain(text: str) -> str:
    text = unicodedata.normalize("NFD", text.casefold().replace("’", "'"))
    return " ".join("".join(c for c in text if not unicodedata.combining(c)).split())


@lru_cache(50_000)
def parse(text: str) -> Name | None:
    """The parts of a name; None for strings that name no person or organisation."""
    s = re.sub(r"^(?:v\.|vedi|c/o|\[[^\]]*\])\s+", "", plain(text))
    if not s or s.strip(" .[]()-") in NO_NAMES or re.search(r"[\d@/=<>]", s):
        return None
    form = ""
    if m := _FORM.search(s):
        form, s = m.lastgroup or "", s[: m.start()]
    words = re.findall(r"[^\W_]+", re.sub(r"\b((?:dott|prof|avv|sig|dr)\.?)\s*(?:ssa|ra|na|ti)\b", r"\1", s))
    while len(words) > 1 and words[0] in TITLES:
        words = words[1:]
    if not words or words[0] in OFFICES or (words[0] in ARTICLES and words[1:2] and words[1] in OFFICES) or (words[0] in ("sentenza", "ricorso", "atto")):
        return None
    tokens: list[str] = []
    lead = ""
    for i, w in enumerate(words):
        if w in PARTICLES and i + 1 < len(words) and (len(w) > 1 or re.search(rf"\b{w}'", s)):
            lead += w
        else:
            tokens.append(lead + w)
            lead = ""
    return Name(form, tuple(tokens))


def distance(a: str, b: str, most: int = 2) -> int:
    """Edits between a and b, swapped neighbours counting one; most + 1 if more than `most`."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        after = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, after[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and y == a[i - 2]:
                d = min(d, before[j - 2] + 1)
            after.append(d)
        if min(after) > most:
            return most + 1
        before, row = row, after
    return min(row[-1], most + 1)


def alike(x: str, y: str, common: frozenset[str] | set[str]) -> float:
    """Similarity of two tokens: equal, familiar form, initial, abbreviation or misspelling."""
    if x == y:
        return 1.0
    if len(x) > len(y):
        x, y = y, x
    if len(x) == 1:
        return 0.9 if y[0] == x else 0.0
    if 3 <= len(x) <= 4 and len(y) >= len(x) + 3 and y in common and y.startswith(x):
        return 0.9
    if x in common and y in common and not (y in _FULL.get(x, ()) or x in _FULL.get(y, ())):
        return 0.0
    if y in _FULL.get(x, ()) or x in _FULL.get(y, ()) or (_FULL.get(x, set()) & _FULL.get(y, set())):
        return 0.95
    most = 1 if len(y) < 7 else 2
    if len(x) >= 3 and (d := distance(x, y, most)) <= most:
        return 1 - d / len(y) * 0.6
    return 0.0


def monge_elkan(a: tuple[str, ...], b: tuple[str, ...], common: frozenset[str] | set[str]) -> tuple[float, list[tuple[str, str, float]]]:
    """(mean over the shorter name's tokens of their best likeness, the pairs), each token used once."""
    if len(a) > len(b):
        a, b = b, a
    scored = sorted(((alike(x, y, common), min(len(x), len(y)), i, j) for i, x in enumerate(a) for j, y in enumerate(b)), key=lambda s: (-s[0] - 0.001 * min(s[1], 9), s[2], s[3]))
    left, right, pairs = set(range(len(a))), set(range(len(b))), []
    for sim, _, i, j in scored:
        if sim and i in left and j in right:
            left.discard(i)
            right.discard(j)
            pairs.append((a[i], b[j], sim))
    return sum(p[2] for p in pairs) / max(1, len(a)), pairs


def expand(name: Name, common: frozenset[str] | set[str]) -> Name:
    """A first word shortened around its middle ("Imm.re") becomes the common word it stands for."""
    t = name.tokens
    if len(t) >= 3 and len(t[0]) >= 3 and len(t[1]) == 2 and t[1] not in PARTICLES:
        full = [c for c in common if c.startswith(t[0]) and c.endswith(t[1])]
        if full:
            return Name(name.form, (min(full), *t[2:]))
    return name


def completeness(name: Name, common: frozenset[str] | set[str]) -> int:
    """2 for a name with two full words or more, 1 if one of them is a familiar form, else 0."""
    full = [t for t in name.tokens if len(t) > 1]
    if len(full) < 2 or len(full) < len(name.tokens):
        return 0
    return 1 if any(t in _FULL and t not in common for t in full) else 2


def same(a: Name, b: Name, common: frozenset[str] | set[str]) -> float:
    """Likeness of two names of one proceeding, 0 if they name different bearers."""
    a, b = expand(a, common), expand(b, common)
    if a.form and b.form and a.form != b.form:
        return 0.0
    if bool(a.form) != bool(b.form):
        bare = b if a.form else a
        if len(bare.tokens) > 1 and not any(t in common for t in bare.tokens):
            return 0.0  # nothing says that the bare name is an organisation's
        if any(len(t) == 1 for t in bare.tokens):
            return 0.0
    for x, y in ((a, b), (b, a)):  # the initials of an organisation
        if x.form and y.form and len(x.tokens) >= 2 and all(len(t) == 1 for t in x.tokens):
            return 0.9 if sorted(x.tokens) == sorted(t[0] for t in y.tokens) and not all(len(t) == 1 for t in y.tokens) else float(x.tokens == y.tokens)
    score, pairs = monge_elkan(a.tokens, b.tokens, common)
    rest_a, rest_b = list(a.tokens), list(b.tokens)
    for x, y, _ in pairs:
        (rest_a if x in rest_a else rest_b).remove(x)
        (rest_b if y in rest_b else rest_a).remove(y)
    if rest_a and rest_b:
        return 0.0
    full = [(x, y) for x, y, _ in pairs if len(x) >= 4 and len(y) >= 4]
    if not full or (rest_a or rest_b) and all(x in common and y in common for x, y in full):
        return 0.0  # a given name or a trade alone tells no bearer; names that match in every word do
    short = min(len(a.tokens), len(b.tokens))
    if short > 1 and (rest_a or rest_b) and not (a.form or b.form):
        return 0.0  # one more given name
    return score if score >= SAME else 0.0


def bands_for(rows: int = ROWS, meet: float = MEET, recall: float = RECALL) -> int:
    """Bands so that 1 - (1 - meet^rows)^bands, the collision curve at similarity `meet`, is at least `recall`."""
    return math.ceil(math.log(1 - recall) / math.log(1 - meet**rows))


_DRAW = np.random.default_rng(20)  # the same hash functions in every process
_A = _DRAW.integers(1, 1 << 62, 2 * 100, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _DRAW.integers(0, 1 << 62, 2 * 100, dtype=np.uint64)


def _code(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text)


@lru_cache(20_000)
def band_keys(token: str) -> tuple[int, ...]:
    """One key a band: the least values of its rows' hash functions over the token's padded q-grams."""
    padded = "#" * (Q - 1) + token + "#" * (Q - 1)
    grams = np.array([_code(padded[i : i + Q]) for i in range(len(padded) - Q + 1)], np.uint64)
    n = bands_for() * ROWS
    least = ((_A[:n, None] * grams + _B[:n, None]) >> np.uint64(20)).min(axis=1).reshape(-1, ROWS)
    band = np.arange(1, len(least) + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        band = (band ^ least[:, r]) * np.uint64(0xBF58476D1CE4E5B9)
        band ^= band >> np.uint64(31)
    return tuple(band.view(np.int64).tolist())


def keys(name: Name, common: frozenset[str] | set[str]) -> set[int]:
    """Blocking keys: bands of every word that isn't a common one (of all, if all are), the other words, and the initials of organisations."""
    long = [t for t in name.tokens if len(t) >= 3]
    rare = [t for t in long if t not in common and t not in _FULL] or long
    out = {k for t in rare for k in band_keys(t)} | {_code("word:" + t) - (1 << 63) for t in long if t in common or t in _FULL}
    if name.form:
        out.add(_code("initials:" + name.form + "".join(sorted(t[0] for t in name.tokens))) - (1 << 63))
    return out


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = latest(load(spark, sf_dir, "documents_in").select("doc_id", "case_ref", "loaded_at"), ["doc_id"], "loaded_at").filter("case_ref is not null").select("doc_id", "case_ref")
    entities = load(spark, sf_dir, "entities_in").select(F.col("entity_id").alias("id"), "doc_id", F.col("original_text").alias("name"), "type")
    llm = load(spark, sf_dir, "llm_names").select(F.col("name_id").alias("id"), "doc_id", F.col("original").alias("name"), F.lit(None).cast("string").alias("type"))
    typed = entities.unionByName(llm).filter("name is not null").groupBy("id", "doc_id", "name").agg(F.count("type").alias("typed"), F.count_if(F.col("type") == PLACE).alias("placed"))
    return typed.join(cases, "doc_id").select("case_ref", "id", "name", "typed", "placed")


def _parsed(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        names = [parse(s) for s in pdf["node"]]
        keep = [n is not None for n in names]
        out = pdf.loc[keep].copy()
        out["tokens"] = [list(n.tokens) for n in names if n]
        out["formed"] = [bool(n.form) for n in names if n]
        yield out


def _words(parsed: DataFrame) -> DataFrame:
    """(t, n, uses, last, longer, typed, placed) of every word of three letters or more: its proceedings, its names, those
    it ends, those that hold more than it, and the types' votes."""
    each = parsed.select("case_ref", "formed", "typed", "placed", F.size("tokens").alias("size"), F.posexplode("tokens").alias("pos", "t")).filter("length(t) > 2")
    return each.groupBy("t").agg(
        F.countDistinct("case_ref").alias("n"), F.count("*").alias("uses"), F.count_if(F.expr("pos = size - 1")).alias("last"),
        F.count_if(F.expr("formed or size > 1")).alias("longer"), F.sum("typed").alias("typed"), F.sum("placed").alias("placed"),
    )


def _places(parsed: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """(case_ref, node) of the places: names without a legal form, all of whose words the types mostly call places.

    Where no row of a word is typed, a word of many proceedings that only ever stands alone is one.
    """
    told = words.filter(f"IF(typed > 0, 2 * placed > typed, longer = 0 and n >= {least})").select("t")
    long = parsed.filter("not formed").select("case_ref", "node", F.expr("array_distinct(filter(tokens, t -> length(t) > 2))").alias("long"))
    each = long.select("case_ref", "node", F.size("long").alias("size"), F.explode("long").alias("t")).join(told, "t")
    return each.groupBy("case_ref", "node", "size").count().filter("count = size").select("case_ref", "node")


def classes(names: DataFrame) -> DataFrame:
    """(case_ref, node, center, n_links) of every different canonical name of a proceeding; center is its class.

    names(case_ref, id, name), and as far as known typed and placed, how many deliveries of the row have a type and how
    many say place. Null, empty and nonsense names, courts, offices, places and rows without a case_ref are left out.
    A spelling that fits several bearers (an initial, a bare family name) stays alone. Ties go to the more complete
    spelling, then to the smaller string; repeated rows change nothing.
    """
    for vote in ("typed", "placed"):
        if vote not in names.columns:
            names = names.withColumn(vote, F.lit(0).cast("long"))
    nodes = names.groupBy("case_ref", F.col("canonical").alias("node")).agg(F.sum("typed").alias("typed"), F.sum("placed").alias("placed"))
    parsed = saved(spread(nodes).mapInPandas(_parsed, "case_ref string, node string, typed long, placed long, tokens array<string>, formed boolean"), "p7-names")
    cases = parsed.select("case_ref").distinct().count()
    least = max(LEAST_CASES, COMMON_SHARE * cases)
    words = saved(_words(parsed), "p7-words")
    # bounded: a word in 0.4 % of all proceedings; a proceeding's names hold a few dozen words
    common = frozenset(r.t for r in words.filter((F.col("n") >= least) & (2 * F.col("last") <= F.col("uses"))).select("t").collect())
    parsed = parsed.join(_places(parsed, words, least), ["case_ref", "node"], "left_anti")

    def blocked(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, k, s) for c, s in zip(pdf["case_ref"], pdf["node"], strict=True) for k in keys(parse(s), common)]
            yield pd.DataFrame(rows, columns=["case_ref", "key", "node"])

    def verified(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            score = [same(parse(a), parse(b), common) for a, b in zip(pdf["a"], pdf["b"], strict=True)]
            rank_a = [completeness(parse(a), common) for a in pdf["a"]]
            rank_b = [completeness(parse(b), common) for b in pdf["b"]]
            yield pdf.assign(score=score, rank_a=rank_a, rank_b=rank_b)

    keyed = parsed.select("case_ref", "node").mapInPandas(blocked, "case_ref string, key long, node string")
    a, b = keyed.withColumnRenamed("node", "a"), keyed.withColumnRenamed("node", "b")
    pairs = a.join(b, ["case_ref", "key"]).filter("a < b").select("case_ref", "a", "b").distinct()
    edges = pairs.mapInPandas(verified, "case_ref string, a string, b string, score double, rank_a int, rank_b int").filter("score > 0")
    both = edges.select("case_ref", F.col("a").alias("node"), F.col("b").alias("other"), "score", F.col("rank_a").alias("rank"), F.col("rank_b").alias("other_rank")).unionByName(
        edges.select("case_ref", F.col("b").alias("node"), F.col("a").alias("other"), "score", F.col("rank_b").alias("rank"), F.col("rank_a").alias("other_rank"))
    )
    return stars(parsed.select("case_ref", "node"), saved(both, "p7-edges"))


def stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Star clustering: the best ranked undecided node is a center, its undecided neighbours are its satellites.

    Every round settles all nodes that outrank their undecided neighbours at once, so rounds are few; nothing is
    gathered in one task. A satellite of several centers joins the most alike one, unless two are equally alike
    to it: then it stands for itself.
    """
    degree = edges.groupBy("case_ref", "node").agg(F.count("*").alias("n_links"))
    order = F.struct(F.col("rank"), F.col("n_links"), F.col("node"))
    ranked = edges.join(degree, ["case_ref", "node"]).select("case_ref", "node", "other", "score", order.alias("mine"))
    other = ranked.select("case_ref", F.col("node").alias("other"), F.col("other").alias("node"), F.col("mine").alias("theirs"))
    live = saved(ranked.join(other, ["case_ref", "node", "other"]), "p7-live")
    links = live
    centers = None
    while not live.isEmpty():
        top = live.groupBy("case_ref", "node").agg(F.max("theirs").alias("best"), F.max("mine").alias("mine")).filter("mine > best").select("case_ref", "node")
        top = saved(top, "p7-centers")
        centers = top if centers is None else centers.unionByName(top)
        gone = top.unionByName(live.join(top.withColumnRenamed("node", "other"), ["case_ref", "other"]).select("case_ref", "node")).distinct()
        live = live.join(gone, ["case_ref", "node"], "left_anti").join(gone.withColumnRenamed("node", "other"), ["case_ref", "other"], "left_anti")
        live = saved(live.select("case_ref", "node", "other", "score", "mine", "theirs"), "p7-live")
    if centers is None:
        return nodes.select("case_ref", "node", F.col("node").alias("center"), F.lit(0).cast("long").alias("n_links"))
    around = links.join(centers.withColumnRenamed("node", "other"), ["case_ref", "other"]).join(centers, ["case_ref", "node"], "left_anti")
    top = F.max("score").over(Window.partitionBy("case_ref", "node"))
    best = around.withColumn("top", top).groupBy("case_ref", "node").agg(F.max_by("other", F.struct("score", "theirs")).alias("center"), F.count_if(F.col("score") >= F.col("top") - 0.02).alias("ties"))
    best = best.withColumn("center", F.expr("IF(ties > 1, node, center)"))
    return (
        nodes.join(best.select("case_ref", "node", "center"), ["case_ref", "node"], "left")
        .join(degree, ["case_ref", "node"], "left")
        .select("case_ref", "node", F.coalesce("center", "node").alias("center"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"))
    )


def _classed(names: DataFrame) -> DataFrame:
    looks = saved(canonical(names, "name").withColumn("canonical", F.trim(F.regexp_replace("canonical", r"\s+", " "))), "p7-looks")
    found = classes(looks)
    return looks.withColumnRenamed("canonical", "node").join(found, ["case_ref", "node"]).select("case_ref", "id", "name", "center", "n_links")


def p7_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _classed(_names(spark, sf_dir)).select("case_ref", "id", "center", "n_links")


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id_a, id_b): all pairs of differently stored names of one class, as the result's form asks for."""
    members = saved(_classed(_names(spark, sf_dir)), "p7-members")
    a = members.select("case_ref", "center", F.col("id").alias("id_a"), F.col("name").alias("name_a"))
    b = members.select("case_ref", "center", F.col("id").alias("id_b"), F.col("name").alias("name_b"))
    return a.join(b, ["case_ref", "center"]).filter("id_a < id_b and name_a <> name_b").select("id_a", "id_b").distinct()
