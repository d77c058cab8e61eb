"""Sentence units in any script (problem 1): a hidden-event n-gram model with forward-backward posteriors.

A block is read as classes of words and marks. Between any two of them the hidden event <S>, a boundary, may
stand. A trigram model over the stream of classes and events, trained on SEED_TEXT with its boundaries and adapted
to how the corpus' own blocks begin, scores every way to place the events; the forward and backward passes give each
gap's posterior. Where a script writes no stop, blanks between its runs are gaps of their own class.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.llm.sentence_seed import ABBREVIATIONS, FINAL_ABBREVIATIONS, GERMAN, SEED
from velum.sources.tables import latest, load, spread

THRESHOLD = 0.5
#: Word of lower case that begins at least so many blocks, and so large a share of its uses, begins sentences too.
LEAST_STARTS, START_SHARE = 5, 0.2

_EOL = r"(?>\r\n|\r|\n)"  # taken whole: the two characters of one line end are never read as two
_BREAK = regex.compile(rf"{_EOL}(?:[^\S\r\n]*{_EOL})+")
_NO_STOP = r"\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}"
_WIDE = r"\p{Han}\p{Hiragana}\p{Katakana}"
_TOKEN = regex.compile(
    rf"(?P<mail>[\w.+'-]+(?:\s?@\s?|\s?\(at\)\s?)[\w-]+(?:\.[\w-]+)+|https?://\S+?(?=[.,;:!?)»\"]*(?:\s|$)))"
    rf"|(?P<dotted>(?:\p{{L}}{{1,3}}\.(?:\s(?=\p{{L}}\.))?)+\p{{L}}{{1,3}}\.(?!\p{{L}}))"
    rf"|(?P<num>\d+(?:[.,:/\-](?:\d+|\p{{Lu}}\b))*(?:º|ª|°|\p{{L}}{{1,3}}\b)?)"
    rf"|(?P<thai>[{_NO_STOP}\p{{M}}]+)"
    rf"|(?P<wide>[{_WIDE}ー々]+)"
    rf"|(?P<word>\p{{L}}[\p{{L}}\p{{M}}]*(?:['’‑-]\p{{L}}[\p{{L}}\p{{M}}]*)*['’]?)"
    r"|(?P<stop>[.!?…]+|[。！？｡]+|[؟۔।॥]+|;)"
    r"|(?P<open>[«“„‘「『（(\[{《〈‹]+)"
    r"|(?P<close>[»”」』）)\]}》〉›]+)"
    r"|(?P<quote>[\"])"
    r"|(?P<mark>\S)"
)
_PAIRS = {"«": "»", "“": "”", "„": "“”", "「": "」", "『": "』", "‹": "›", "‘": "’", "《": "》", "(": ")", "（": "）", "[": "]"}
_QUOTES = set("«»“”„「」『』‹›\"")
S, N = "<S>", "<N>"


class Token:
    __slots__ = ("start", "end", "kind", "text", "spaced", "inside", "cls")

    def __init__(self, start: int, end: int, kind: str, text: str, spaced: bool) -> None:
        self.start, self.end, self.kind, self.text, self.spaced, self.inside, self.cls = start, end, kind, text, spaced, False, ""


def tokens(text: str, start: int, end: int) -> list[Token]:
    out: list[Token] = []
    for m in _TOKEN.finditer(text, start, end):
        kind, s, e = m.lastgroup or "mark", m.start(), m.end()
        spaced = s > start and text[s - 1].isspace()
        word = m.group()
        if kind == "stop" and word == ";":
            # the Greek question mark looks like a semicolon
            kind = "stop" if out and out[-1].text and unicodedata.name(out[-1].text[-1], "").startswith("GREEK") else "mark"
        if kind == "mark" and word == ";":
            kind = "stop" if unicodedata.normalize("NFKD", word) == ";" and word != ";" else kind
        out.append(Token(s, e, kind, word, spaced))
    _quoted(out)
    return out


def _quoted(ts: list[Token]) -> None:
    """Marks tokens inside quotations; an opening mark without its closing one opens nothing."""
    stack: list[int] = []
    spans: list[tuple[int, int]] = []
    straight = -1
    for i, t in enumerate(ts):
        if t.kind == "quote":
            if straight < 0:
                straight = i
            else:
                spans.append((straight, i))
                straight = -1
        elif t.kind in ("open", "close"):
            for ch in t.text:
                if stack and ch in _PAIRS.get(ts[stack[-1]].text[-1], ""):
                    spans.append((stack.pop(), i))
                    t.kind = "close"  # some marks open in one language and close in another
                elif ch in _PAIRS:
                    stack.append(i)
    for a, b in spans:
        for t in ts[a + 1 : b]:
            t.inside = True


def classify(ts: list[Token], starts: frozenset[str] | set[str]) -> None:
    german = sum(t.text.lower() in GERMAN for t in ts) >= max(2, 0.12 * len(ts))
    for i, t in enumerate(ts):
        w = t.text
        following = ts[i + 1] if i + 1 < len(ts) else None
        if t.kind == "word":
            low = w.lower()
            dot = following is not None and following.kind == "stop" and following.text == "." and following.start == t.end
            if dot and low in ABBREVIATIONS:
                t.cls = "ABBR"
            elif dot and low in FINAL_ABBREVIATIONS:
                t.cls = "ABBRF"
            elif dot and len(w) == 1 and w.isupper():
                t.cls = "INITIAL"
            elif low in starts and w[0].islower():
                t.cls = "start"
            elif w[0].isupper() or w[0].istitle():
                t.cls = "Word"
            elif w[0].islower():
                t.cls = "word"
            else:
                t.cls = "letters"  # scripts without case
        elif t.kind == "dotted":
            low = regex.sub(r"\s", "", w.lower())
            t.cls = "ABBRF" if low in FINAL_ABBREVIATIONS or low.rstrip(".") in FINAL_ABBREVIATIONS else "ABBR" if low in ABBREVIATIONS or low.rstrip(".") in ABBREVIATIONS else "DOTS"
        elif t.kind == "stop":
            t.cls = {"!": "!", "?": "?"}.get(w[-1], "...") if len(w) > 1 or w in "!?…" else "." if w == "." else "full"
        elif t.kind == "num":
            t.cls = "ord" if i == 0 else "day" if german and len(w) <= 2 else "num"
        elif t.kind == "wide":
            t.cls = "kana" if unicodedata.name(w[0], "").startswith("HIRAGANA") else "wide"
        else:
            t.cls = t.kind


def _stream(ts: list[Token]) -> list[tuple[int, str]]:
    """(gap before it, class) of the items that carry the model; closing marks belong to what they close."""
    out: list[tuple[int, str]] = []
    for i, t in enumerate(ts):
        if t.inside:
            continue
        before = ts[i - 1] if i else None
        if t.kind == "close" and out:
            # a quotation that ends in a stop may end the sentence as well
            if before is not None and before.kind == "stop":
                out.append((i, "stop" + ("」" if t.text[-1] in "」』" else '"' if t.text[-1] in _QUOTES else ")")))
            else:
                out.append((i, "close"))
            continue
        if t.kind == "quote":
            closing = before is not None and before.inside
            out.append((i, 'stop"' if closing and before.kind == "stop" else "close" if closing else "open"))
            continue
        cls = t.cls
        if cls == "letters" and before is not None and (before.kind == "stop" or out and out[-1][1].startswith("stop")):
            cls = "Word"  # nothing tells upper from lower case
        if t.kind == "stop" and out:
            cls = ("close" if before is not None and before.kind in ("close", "quote") else before.cls if before is not None else "") + cls
        if t.kind == "thai" and before is not None and before.kind == "thai" and t.spaced:
            cls = "thai_"
        out.append((i, cls))
    return out


class Model:
    """Trigrams over classes and events, with Witten-Bell smoothing down to uniform."""

    def __init__(self) -> None:
        self.counts: list[Counter] = [Counter(), Counter(), Counter()]
        self.totals: list[Counter] = [Counter(), Counter(), Counter()]
        self.kinds: list[Counter] = [Counter(), Counter(), Counter()]
        self.cache: dict[tuple[str, str, str], float] = {}

    def add(self, stream: list[str]) -> None:
        for i in range(2, len(stream)):
            for n in range(3):
                ctx, item = tuple(stream[i - n : i]), stream[i]
                if not self.counts[n][ctx, item]:
                    self.kinds[n][ctx] += 1
                self.counts[n][ctx, item] += 1
                self.totals[n][ctx] += 1

    def p(self, a: str, b: str, item: str) -> float:
        key = (a, b, item)
        if (v := self.cache.get(key)) is None:
            v = 1 / 40
            for n, ctx in ((0, ()), (1, (b,)), (2, (a, b))):
                if total := self.totals[n][ctx]:
                    kinds = self.kinds[n][ctx]
                    v = (self.counts[n][ctx, item] + kinds * v) / (total + kinds)
            self.cache[key] = v
        return v


def train(starts: frozenset[str] | set[str] = frozenset()) -> Model:
    """The model of the labelled seed sentences: each may follow each of the same language."""
    model = Model()
    for sentences in SEED:
        for shift in range(1, min(8, len(sentences))):
            stream = [S, S]
            for k in range(len(sentences)):
                s = sentences[(k * shift) % len(sentences)]
                ts = tokens(s, 0, len(s))
                classify(ts, starts)
                classes = [c for _, c in _stream(ts)]
                for j, c in enumerate(classes):
                    stream += [c, S if j == len(classes) - 1 else N]
            model.add(stream)
    return model


def posteriors(stream: list[str], model: Model) -> list[float]:
    """For each gap after an item (but the last), the probability that <S> stands there, by forward-backward."""
    n = len(stream)
    if n < 2:
        return []
    # states: the event before the item; moving on emits the event after it and the next item
    step: list[tuple[tuple[float, float], tuple[float, float]]] = []
    for i in range(n - 1):
        rows = []
        for before in (N, S):
            row = []
            for after in (N, S):
                row.append(model.p(before, stream[i], after) * model.p(stream[i], after, stream[i + 1]))
            rows.append((row[0], row[1]))
        step.append((rows[0], rows[1]))
    forward = [(0.0, 1.0)]
    for (nn, ns), (sn, ss) in step:
        a, b = forward[-1]
        x, y = a * nn + b * sn, a * ns + b * ss
        z = (x + y) or 1e-300
        forward.append((x / z, y / z))
    back = (1.0, 1.0)
    out = [0.0] * (n - 1)
    last = (model.p(N, stream[-1], S), model.p(S, stream[-1], S))
    back = last
    for i in range(n - 2, -1, -1):
        f = forward[i + 1]
        x, y = f[0] * back[0], f[1] * back[1]
        out[i] = y / ((x + y) or 1e-300)
        (nn, ns), (sn, ss) = step[i]
        a, b = nn * back[0] + ns * back[1], sn * back[0] + ss * back[1]
        z = (a + b) or 1e-300
        back = (a / z, b / z)
    return out


def blocks(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in _BREAK.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


def units(text: str, model: Model, starts: frozenset[str] | set[str] = frozenset()) -> list[tuple[int, int]]:
    """[start, end) of the sentence units of a text, first to last non-blank character each."""
    out = []
    for s, e in blocks(text):
        ts = tokens(text, s, e)
        if not ts:
            continue
        classify(ts, starts)
        items = _stream(ts)
        begin = ts[0].start
        found = posteriors([c for _, c in items], model)
        if any(t.kind == "stop" for t in ts) or any(c == "thai_" for _, c in items):
            for k, p in enumerate(found):
                if p > THRESHOLD:
                    nxt = items[k + 1][0]
                    out.append((begin, ts[nxt - 1].end))
                    begin = ts[nxt].start
        out.append((begin, ts[-1].end))
    return out


def _starts(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    first, uses = Counter(), Counter()
    word = regex.compile(r"\p{Ll}[\p{L}\p{M}]*")
    for batch in batches:
        for text in batch.column(0).to_pylist():
            uses.update(word.findall(text))
            for s, e in blocks(text):
                if m := word.match(text, e - len(text[s:e].lstrip()), e):
                    first[m.group()] += 1
    rows = [(w, first[w], uses[w]) for w in uses.keys() | first.keys()]  # all words: another task may hold their starts
    cols = list(zip(*rows, strict=True)) or [(), (), ()]
    yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.int64())], names=["word", "first", "uses"])


def start_words(docs: DataFrame) -> frozenset[str]:
    """Words of lower case that often begin blocks of the corpus, by the counts of all texts."""
    rows = (
        spread(docs.select("text").filter("text is not null")).mapInArrow(_starts, "word string, first long, uses long").groupBy("word")
        .agg(F.sum("first").alias("first"), F.sum("uses").alias("uses")).filter(f"first >= {LEAST_STARTS} and first >= {START_SHARE} * uses")
        .select("word").collect()
    )
    return frozenset(r.word for r in rows)


def sentence_units(docs: DataFrame) -> DataFrame:
    """(doc_id, start_pos, end_pos) of the sentence units of docs(doc_id, text), in code points.

    Null, empty and blank texts have none; repeated rows count once. A line of blanks ends a unit, a line break does
    not; a block without a sentence end is one unit; quotations stay whole; very long texts are read block by block.
    """
    starts = start_words(docs)

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = train(starts)
        for batch in batches:
            ids, begins, ends = [], [], []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = units(text, model, starts)
                ids.extend([doc] * len(found))
                begins.extend(s for s, _ in found)
                ends.extend(e for _, e in found)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], names=["doc_id", "start_pos", "end_pos"])

    texts = docs.select("doc_id", "text").filter("text is not null").dropDuplicates(["doc_id", "text"])
    return spread(texts).mapInArrow(cut, "doc_id long, start_pos int, end_pos int")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = latest(load(spark, sf_dir, "documents_in").select("doc_id", "format", "text", "loaded_at"), ["doc_id"], "loaded_at")
    return sentence_units(docs.filter("format is null or format <> 'markdown'"))
