"""Repair of text from scanned pages (problem 5): a noisy channel over character confusions and corpus n-grams.

Three corpus passes give counts: words and word pairs of all texts, and the shapes of lines at page edges. A file's
pages are then read in order: running lines are set apart, words that a full line cut are joined, and Viterbi chooses
for every line the words that most likely stood on the paper. The counts are one memory-mapped sorted table a machine,
however many words, pairs and shapes there are.
"""

from __future__ import annotations

import math
import mmap
import os
import re
import shutil
import struct
import tempfile
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.sources.tables import latest, load, publish, saved, shared_dir, spread

#: A line's shape is a running line's if it stands at page edges so often, and so seldom elsewhere.
EDGE_COUNT, EDGE_SHARE = 4, 0.95
#: Weight of a word's count on scanned pages, which hold misread words too, against its count in digital texts.
SCAN_WEIGHT = 0.02
#: Probability of a listed confusion, of any other wrong character, and the weight of word pairs.
LISTED, OTHER, PAIR_WEIGHT = 0.004, 0.000005, 0.6
FLUSH = 300_000

#: Fixed values: (read, true) characters that scanners confuse.
CONFUSIONS = [
    ("0", "o"), ("1", "l"), ("1", "i"), ("l", "i"), ("i", "l"), ("5", "s"), ("6", "b"), ("8", "b"), ("2", "z"), ("9", "g"), ("3", "e"), ("4", "a"), ("7", "t"),
    ("c", "e"), ("e", "c"), ("f", "t"), ("t", "f"), ("rn", "m"), ("m", "rn"), ("ri", "n"), ("n", "ri"), ("in", "m"), ("ii", "u"), ("u", "ii"), ("li", "h"), ("h", "li"),
    ("h", "ti"), ("cl", "d"), ("d", "cl"), ("vv", "w"), ("a'", "à"), ("e'", "è"), ("i'", "ì"), ("o'", "ò"), ("u'", "ù"), ("b", "h"), ("h", "b"), ("o", "c"), ("c", "o"), ("a", "o"), ("u", "v"), ("ni", "m"), ("nn", "m"), ("lo", "b"), ("ó", "o"), ("á", "a"),
]
_BY_READ: dict[str, list[str]] = {}
for _r, _t in CONFUSIONS:
    _BY_READ.setdefault(_r, []).append(_t)

_WORD = re.compile(r"[^\W_]+(?:['’](?=[^\W\d_]))?|[^\W\d_]+'(?=\W|$)")
_HYPHEN = re.compile(r"([^\W\d_]+)([-­¬‐])[ \t]*$")
_PAGE_NO = re.compile(r"^\W*(?:(?:pag(?:ina)?|p|page|seite|foglio)\W*)?\d{1,4}(?:\W*(?:di|/|of)\W*\d{1,4})?\W*$", re.I)
_TAIL_NO = re.compile(r"\s{2,}\W*(?:(?:pag(?:ina)?|p)\W*)?\d{1,4}(?:\s*(?:di|/)\s*\d{1,4})?\W*$", re.I)


def shape(line: str) -> str:
    """A line with digits as 9 and runs of capitalised words as A, without a page number at its end."""
    s = _TAIL_NO.sub("", line.strip())
    s = re.sub(r"\d+", "9", s)
    return re.sub(r"\b[A-ZÀ-Ý][\w'’]*(?:\s+(?:d'|di |de )?[A-ZÀ-Ý][\w'’]*)*", "A", s)


def page_number(line: str) -> bool:
    return bool(_PAGE_NO.match(line)) and "€" not in line and "%" not in line and not re.search(r"\d[.,]$|\d\.\d", line.strip())


def edges(lines: list[str]) -> tuple[set[int], list[int]]:
    """(places of the first and last two lines with text, places of all lines with text)."""
    full = [i for i, x in enumerate(lines) if x.strip()]
    return set(full[:2] + full[-2:]), full


def distance(a: str, b: str, most: int) -> int:
    if abs(len(a) - len(b)) > most:
        return most + 1
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            before, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, before + (x != y))
        if min(row) > most:
            return most + 1
    return row[-1]


SEED = 42  # of Spark's xxhash64


def _key(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text, SEED) - (1 << 63)


class Table:
    """Counts in a memory-mapped table sorted by key, read like a dict; keys of one kind share a prefix."""

    def __init__(self, keys: memoryview, values: memoryview, kind: str) -> None:
        self.keys, self.values, self.kind = keys, values, kind

    def get(self, word: str | tuple[str, str], default: float = 0.0) -> float:
        k = _key(self.kind + (word if isinstance(word, str) else " ".join(word)))
        i = bisect_left(self.keys, k)
        return self.values[i] if i < len(self.keys) and self.keys[i] == k else default

    def __contains__(self, word: str) -> bool:
        return self.get(word, -1.0) >= 0

    def __getitem__(self, word: str) -> float:
        return self.get(word)


def _thirds(n: int) -> tuple[int, int, int, int]:
    return 0, n // 3, 2 * n // 3, n


def segments(known: str) -> list[str]:
    """Keys of a shape: its thirds, one of which two edits leave whole, with its length."""
    at = _thirds(len(known))
    return [f"s{len(known)} {i} {known[at[i] : at[i + 1]]}" for i in range(3)]


class Shapes:
    """Running lines in a memory-mapped table of their thirds."""

    def __init__(self, exact: Table, keys: memoryview, ends: memoryview, texts: memoryview) -> None:
        self.exact, self.keys, self.ends, self.texts = exact, keys, ends, texts

    def __contains__(self, line: str) -> bool:
        return line in self.exact

    def like(self, line: str) -> Iterator[str]:
        """All shapes within two edits of `line`, and some more."""
        for n in range(max(3, len(line) - 2), len(line) + 3):
            at = _thirds(n)
            for i in range(3):
                size = at[i + 1] - at[i]
                for part in {line[b : b + size] for b in range(max(0, at[i] - 2), min(at[i] + 2, len(line) - size) + 1)}:
                    k = _key(f"s{n} {i} {part}")
                    j = bisect_left(self.keys, k)
                    while j < len(self.keys) and self.keys[j] == k:
                        yield bytes(self.texts[self.ends[j - 1] if j else 0 : self.ends[j]]).decode()
                        j += 1


class Model(NamedTuple):
    words: dict[str, float] | Table
    pairs: dict[tuple[str, str], float] | Table
    hyphened: dict[str, float] | Table
    running: set[str] | Shapes


def running_line(s: str, running: set[str] | Shapes) -> bool:
    """Whether a shape is a running line's, or a misread one's."""
    if s in running:
        return True
    return len(s) > 8 and any(distance(s, k, 2) <= 2 for k in (running.like(s) if isinstance(running, Shapes) else running) if abs(len(k) - len(s)) <= 2 and len(k) > 10)


def candidates(word: str, words: dict[str, float]) -> dict[str, float]:
    """Known words that could have been read as `word`, with the log-probability of the misreading."""
    out: dict[str, float] = {}
    steps = [(i, r, t) for i in range(len(word)) for r in (word[i], word[i : i + 2]) if r in _BY_READ for t in _BY_READ[r] if len(r) <= len(word) - i]
    one = math.log(LISTED)
    for i, r, t in dict.fromkeys(steps):
        w = word[:i] + t + word[i + len(r) :]
        if w in words:
            out[w] = max(out.get(w, -99), one)
        elif len(word) > 4:
            at = i + len(t)
            for j in range(at, len(w)):
                for r2 in (w[j], w[j : j + 2]):
                    for t2 in _BY_READ.get(r2, ()):
                        x = w[:j] + t2 + w[j + len(r2) :]
                        if x in words:
                            out[x] = max(out.get(x, -99), 2 * one)
    if word not in words and len(word) >= 5:
        other = math.log(OTHER)
        for i in range(len(word)):
            for c in "abcdefghilmnopqrstuvzàèéìòù":
                x = word[:i] + c + word[i + 1 :]
                if x != word and x in words and x not in out:
                    out[x] = other
    return out


_candidates = lru_cache(50_000)(candidates)  # of a task's table; dicts have no hash


def decode(tokens: list[str], m: Model) -> list[str]:
    """The most likely true words of a line, by Viterbi over each token's candidates."""
    scores: dict[str, float] = {"": 0.0}  # of every candidate of the token before
    back: list[dict[str, str]] = []
    near = candidates if isinstance(m.words, dict) else _candidates
    for token in tokens:
        low = token.lower()
        options = {low: math.log(m.words.get(low, 0.0) + SCAN_WEIGHT)}
        if len(low) > 1 and not (sum(c.isdigit() for c in low) > max(1, len(low) // 3)) and any(c.isalpha() for c in low):
            for w, p in near(low, m.words).items():
                options[w] = p + math.log(m.words[w] + SCAN_WEIGHT)
        nxt: dict[str, float] = {}
        came: dict[str, str] = {}
        for w, p in options.items():
            score, came[w] = max(((s + PAIR_WEIGHT * math.log(1 + m.pairs.get((b, w), 0.0)), b) for b, s in scores.items()), key=lambda x: x[0])
            nxt[w] = score + p
        scores = nxt
        back.append(came)
    word = max(scores, key=lambda w: scores[w])
    out: list[str] = []
    for came in reversed(back):
        out.append(word)
        word = came[word]
    return out[::-1]


class Line(NamedTuple):
    page: int
    number: int
    text: str
    kinds: tuple[str, ...]
    repaired: str


def _skips(line: str) -> list[tuple[int, int]]:
    """Mail addresses, links and codes, whose characters follow no words."""
    return [m.span() for m in re.finditer(r"\S*[@/_]\S*|\S+\.(?:test|example|invalid|it|com|org|net)\b|\b(?=\w*\d\w*\d)(?=\w*[A-Za-z])[A-Za-z]{0,6}\d[\w-]{5,}|\b[A-Z]{3,6}\b", line)]


def read_file(pages: list[tuple[int, str]], m: Model) -> list[Line]:
    """The lines of a file's pages in order, with their kinds and repaired text."""
    rows: list[list] = []  # page, number, text, kinds
    repeated: Counter[str] = Counter()
    for _, text in pages:
        lines = text.split("\n")
        edge, _ = edges(lines)
        repeated.update({shape(lines[i]) for i in edge if shape(lines[i]) and lines[i].strip()})
    for page, text in pages:
        lines = text.split("\n")
        edge, full = edges(lines)
        running = set()
        for part in (full[:2], full[::-1][:2]):
            for i in part:
                s = shape(lines[i])
                known = page_number(lines[i]) or running_line(s, m.running)
                if not known and repeated[s] > 1 and len(s) < 60 and not re.search(r"[.;,]$", s) and len(pages) > 1 and repeated[s] >= 0.6 * len(pages) and len(s) > 3:
                    known = True
                if not known:
                    break
                running.add(i)
        for i, line in enumerate(lines):
            rows.append([page, i + 1, line.rstrip("\r"), {"furniture"} if i in running else set()])
    body = [r for r in rows if "furniture" not in r[3]]
    filled = [r for r in body if r[2].strip()]
    joined: dict[int, tuple[str, int]] = {}
    for a, b in zip(filled, filled[1:], strict=False):
        h, n = _HYPHEN.search(a[2]), re.match(r"\s*([^\W\d_]+)", b[2])
        if not h or not n:
            continue
        left, right = h.group(1), n.group(1)
        if right[0].isupper() and not left[-1].isupper():
            continue
        whole, compound = (left + right).lower(), f"{left}-{right}".lower()
        if h.group(2) == "-" and m.hyphened.get(compound, 0) > m.words.get(whole, 0):
            continue
        if h.group(2) == "-" and m.words.get(whole, 0) <= 0 and m.words.get(left.lower(), 0) > 0 and m.words.get(right.lower(), 0) > 0 and len(left) > 3 and len(right) > 3 and not candidates(whole, m.words):
            if m.hyphened.get(compound, 0) > 0:
                continue
        a[3].add("hyphen")
        joined[id(a)] = (right, len(left))
    carried = 0
    fixed: dict[int, str] = {}
    for k, r in enumerate(filled):
        line, skip = r[2], _skips(r[2])
        tail = joined.get(id(r))
        h = _HYPHEN.search(line) if tail else None
        found = [w for w in _WORD.finditer(line) if w.start() >= carried and not any(s <= w.start() < e for s, e in skip)]
        tokens = [w.group() for w in found]
        if h and found and found[-1].start() == h.start(1):
            tokens[-1] = h.group(1) + tail[0]
        true = decode(tokens, m)
        out, at = [], 0
        lead = carried
        carried = 0
        for j, (w, t, token) in enumerate(zip(found, true, tokens, strict=True)):
            last = h is not None and j == len(found) - 1 and w.start() == h.start(1)
            if t != token.lower():
                split = next((x for x in range(min(len(t), len(token))) if t[x] != token.lower()[x]), 0)
                if last and split >= tail[1] and k + 1 < len(filled):
                    filled[k + 1][3].add("misread")
                else:
                    r[3].add("misread")
                t = t.upper() if token.isupper() and len(token) > 1 else t[0].upper() + t[1:] if token[0].isupper() else t
            else:
                t = token
            out.append(line[at : w.start()] + t)
            at = w.end()
            if last:
                at = len(line)
        if h:
            carried = len(filled[k + 1][2]) - len(filled[k + 1][2].lstrip()) + len(tail[0]) if k + 1 < len(filled) else 0
        fixed[id(r)] = ("".join(out) + line[at:])[lead:] if lead <= len(line) else ""
    return [Line(r[0], r[1], r[2], tuple(sorted(r[3])), fixed.get(id(r), r[2])) for r in rows]


def paragraphs(lines: list[Line]) -> str:
    """Continuous text: blank lines part paragraphs, lines of one are joined by a blank, cut words by nothing."""
    out: list[str] = []
    glue, blank, page = "", True, 0
    for x in lines:
        if "furniture" in x.kinds:
            continue
        if not x.text.strip():
            blank = True
            continue
        # a page ends no paragraph by itself: what follows goes on unless a blank line or a sentence's end says otherwise
        ends = not out or out[-1].rstrip()[-1:] in ".!?…»”\""
        if out:
            out.append("\n\n" if glue == " " and blank and (x.page == page or ends) else glue)
        out.append(x.repaired.strip())
        # a cut word stands whole on its first line; a hyphen that belongs to the word takes no blank
        glue = "" if _HYPHEN.search(x.text) and "hyphen" not in x.kinds else " "
        if "hyphen" in x.kinds:
            glue = "  "
        blank, page = False, x.page
    return "".join(out).replace("  ", " ")


# --- counts over the whole corpus


def _counted(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: Counter[tuple[str, str, str]] = Counter()

    def out() -> pa.RecordBatch:
        keys = list(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.string()), pa.array([k[2] for k in keys], pa.string()), pa.array(list(counts.values()), pa.int64())],
            names=["kind", "a", "b", "n"],
        )

    for batch in batches:
        for scanned, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if scanned:
                lines = text.split("\n")
                edge, full = edges(lines)
                for i in full:
                    counts["edge" if i in edge else "inner", shape(lines[i]), ""] += 1
            kind = "scan" if scanned else "word"
            last = ""
            for w in _WORD.findall(text.lower()):
                counts[kind, w, ""] += 1
                if not scanned and last:
                    counts["pair", last, w] += 1
                last = w
            for c in re.findall(r"[^\W\d_]{2,}-[^\W\d_]{2,}", text.lower()):
                counts["hyphened", c, ""] += 1
            if len(counts) > FLUSH:
                yield out()
                counts.clear()
    if counts:
        yield out()


def counts(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(kind, a, b, n): words, word pairs and hyphened words of all texts, and line shapes of pages by place."""
    texts = pages.select(F.lit(True).alias("scanned"), "text").unionByName(docs.select(F.lit(False).alias("scanned"), "text")).filter("text is not null")
    return spread(texts).mapInArrow(_counted, "kind string, a string, b string, n long").groupBy("kind", "a", "b").agg(F.sum("n").alias("n"))


def _packed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Columns of a batch as bytes: keys and counts, or keys, lengths and texts."""
    for batch in batches:
        keys = batch.column(0).to_numpy(zero_copy_only=False).astype("<i8").tobytes()
        if pa.types.is_string(batch.column(1).type):
            texts = [t.encode() for t in batch.column(1).to_pylist()]
            values, text = struct.pack(f"<{len(texts)}q", *map(len, texts)), b"".join(texts)
        else:
            values, text = batch.column(1).to_numpy(zero_copy_only=False).astype("<f8").tobytes(), b""
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in (keys, values, text)], names=["keys", "data", "text"])


def _segmented(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(_key(k), shape) for shape in batch.column(0).to_pylist() for k in segments(shape)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], names=["key", "value"])


def _write(rows: DataFrame, folder: str, name: str) -> list[str]:
    """Files of the keys, counts or text ends, and texts of rows(key, value) in the order of keys, a batch at a time."""
    packed = rows.repartitionByRange("key").sortWithinPartitions("key").mapInArrow(_packed, "keys binary, data binary, text binary")
    paths = [os.path.join(folder, f"{name}.{part}") for part in ("keys", "data", "text")]
    end = 0
    with open(paths[0], "wb") as keys, open(paths[1], "wb") as data, open(paths[2], "wb") as text:
        for r in packed.toLocalIterator():
            keys.write(r["keys"])
            if r.text:
                ends = []
                for n in memoryview(bytes(r.data)).cast("q"):
                    end += n
                    ends.append(end)
                data.write(struct.pack(f"<{len(ends)}q", *ends))
                text.write(r.text)
            else:
                data.write(r.data)
    return paths


def publish_model(table: DataFrame) -> str:
    """Writes the language model of counts into one file and hands it to every executor; nothing is held in memory."""
    table = saved(table, "p5-counts")
    words = (
        table.filter("kind in ('word', 'scan')").groupBy("a").agg(F.sum(F.when(F.col("kind") == "word", F.col("n")).otherwise(F.col("n") * SCAN_WEIGHT)).alias("w"))
        .filter(f"w > {SCAN_WEIGHT}").select(F.concat(F.lit("w"), "a").alias("text"), F.col("w").cast("double").alias("value"))
    )
    pairs = table.filter("kind = 'pair'").select(F.concat(F.lit("p"), "a", F.lit(" "), "b").alias("text"), F.col("n").cast("double").alias("value"))
    hyphened = table.filter("kind = 'hyphened' and n > 1").select(F.concat(F.lit("h"), "a").alias("text"), F.col("n").cast("double").alias("value"))
    shapes = saved(
        table.filter("kind in ('edge', 'inner')").groupBy("a").agg(F.sum(F.when(F.col("kind") == "edge", F.col("n"))).alias("edge"), F.sum("n").alias("n"))
        .filter(f"edge >= {EDGE_COUNT} and edge >= {EDGE_SHARE} * n and length(a) > 3 and not a rlike '[.;,!?:»]$'").select("a"), "p5-shapes"
    )
    known = shapes.select(F.concat(F.lit("r"), "a").alias("text"), F.lit(1.0).alias("value"))
    counted = words.unionByName(pairs).unionByName(hyphened).unionByName(known)
    # unsigned order of the hash, as _key
    counted = counted.select(F.xxhash64("text").bitwiseXOR(F.lit(-(1 << 63)).cast("long")).alias("key"), "value")
    # the driver puts the file together beside the other shared files, where that folder is one of its own file system
    shared = shared_dir(table.sparkSession).removeprefix("file://").removeprefix("file:")
    folder = tempfile.mkdtemp(prefix="velum-scans-", dir=shared if os.path.isdir(shared) else None)
    try:
        parts = _write(counted, folder, "counts")[:2] + _write(shapes.mapInArrow(_segmented, "key long, value string"), folder, "shapes")
        path = os.path.join(folder, "model")
        with open(path, "wb") as out:
            out.write(struct.pack("<5q", *map(os.path.getsize, parts)))
            for part in parts:
                with open(part, "rb") as f:
                    shutil.copyfileobj(f, out, 1 << 20)
        with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
            return publish(table.sparkSession, data, ".scans")
    finally:
        shutil.rmtree(folder)


def open_model(path: str) -> Model:
    with open(path, "rb") as f:
        data = memoryview(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ))
    at, parts = 40, []
    for size, kind in zip(struct.unpack("<5q", data[:40]), "qdqqB", strict=True):
        parts.append(data[at : at + size].cast(kind))
        at += size
    words, pairs, hyphened, known = (Table(parts[0], parts[1], kind) for kind in "wphr")
    return Model(words, pairs, hyphened, Shapes(known, *parts[2:]))


_models: dict[str, Model] = {}


def _model(name: str) -> Model:
    if name not in _models:
        from pyspark import SparkFiles

        _models.clear()
        _candidates.cache_clear()
        _models[name] = open_model(SparkFiles.get(name))
    return _models[name]


def _files(pages: DataFrame) -> DataFrame:
    """(doc_id, pages): a file's pages in order; a file is the unit that a task reads."""
    return pages.filter("text is not null").groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page", "text"))).alias("pages"))


def lines_found(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, page, line_no, kind) of pages(doc_id, page, text), with words counted in docs(text) as well.

    Null and empty pages have no lines of a kind; pages delivered again must be settled before; ties between readings
    go to the text as it stands.
    """
    name = publish_model(counts(pages, docs))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(name)
        for batch in batches:
            rows = [
                (doc, x.page, x.number, kind)
                for doc, group in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                for x in read_file([(p["page"], p["text"]) for p in group], m)
                for kind in x.kinds
            ]
            cols = list(zip(*rows, strict=True)) or [()] * 4
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["doc_id", "page", "line_no", "kind"])

    return spread(_files(pages)).mapInArrow(find, "doc_id long, page int, line_no int, kind string")


def repaired(pages: DataFrame, docs: DataFrame) -> DataFrame:
    """(doc_id, text): every file's pages as continuous paragraphs."""
    name = publish_model(counts(pages, docs))

    def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = _model(name)
        for batch in batches:
            texts = [paragraphs(read_file([(p["page"], p["text"]) for p in group], m)) for group in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return spread(_files(pages)).mapInArrow(join, "doc_id long, text string")


def _tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    pages = latest(load(spark, sf_dir, "ocr_pages").select("doc_id", "page", "text", "scanned_at"), ["doc_id", "page"], "scanned_at").select("doc_id", "page", "text")
    docs = latest(load(spark, sf_dir, "documents_in").select("doc_id", "text", "loaded_at"), ["doc_id"], "loaded_at").select("text")
    return pages, docs


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines_found(*_tables(spark, sf_dir))


def p5_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(*_tables(spark, sf_dir))
