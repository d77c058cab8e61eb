"""Token ids of a whole corpus through a minimal acyclic transducer of its frequent words (problem 8).

Pass 1 counts the corpus' pre-tokens. The frequent ones are merged once and compiled into a minimal acyclic
automaton over bytes; each arc carries how many words it skips, so the sum along a path is the word's number
and addresses its ids. The automaton is one file that tasks memory-map. Pass 2 looks every distinct pre-token
of a batch up in it, all of them side by side, a byte a step; words it does not hold are merged exactly by rank.
"""

from __future__ import annotations

import base64
import heapq
import mmap
import os
import re
import struct
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.sources.tables import load, publish, saved

#: The public pre-token pattern of the byte-level vocabularies; fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
TOKENIZER_DIR = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: How many of the most frequent pre-tokens the lexicon holds. Bounds the driver's work; never changes a result.
LEXICON_WORDS = 40_000
#: Distinct pre-tokens a task gathers before it hands partial counts on.
FLUSH = 300_000
MAGIC = b"VLX1"
#: Bytes of text handled at once in a task.
PART_BYTES = 32 << 20
#: Classes of counts per doubling, by which the lexicon's words are chosen.
CLASSES = 8
#: Stretches between such blanks whose ids a task keeps.
KEPT = 400_000
#: Bytes up to which a word is merged by looking at all pairs again; longer ones keep a heap.
SHORT = 24
NO_RANK = 1 << 62


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merge(word: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one pre-token: the pair of lowest rank is joined first, the leftmost of equal ones; O(n log n)."""
    if word in ranks:
        return [ranks[word]]
    n = len(word)
    if n <= SHORT:
        get = ranks.get
        pieces = [word[i : i + 1] for i in range(n)]
        pairs = [get(word[i : i + 2], NO_RANK) for i in range(n - 1)]
        while pairs and (best := min(pairs)) < NO_RANK:
            i = pairs.index(best)
            pieces[i] += pieces[i + 1]
            del pieces[i + 1], pairs[i]
            if i < len(pairs):
                pairs[i] = get(pieces[i] + pieces[i + 1], NO_RANK)
            if i:
                pairs[i - 1] = get(pieces[i - 1] + pieces[i], NO_RANK)
        return [ranks[p] for p in pieces]
    parts: list[bytes | None] = [word[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i, parts[i] + parts[i + 1]) for i in range(n - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joined = heapq.heappop(heap)
        j = after[i]
        if parts[i] is None or j >= n or parts[i] + parts[j] != joined:
            continue
        parts[i], parts[j] = joined, None
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
            pair = joined + parts[after[i]]
            if (r := ranks.get(pair)) is not None:
                heapq.heappush(heap, (r, i, pair))
        if (k := before[i]) >= 0:
            pair = parts[k] + joined
            if (r := ranks.get(pair)) is not None:
                heapq.heappush(heap, (r, k, pair))
    return [ranks[p] for p in parts if p is not None]


def compile_lexicon(entries: dict[bytes, list[int]]) -> bytes:
    """The file of a minimal acyclic automaton over `entries`, with ids addressed by word number.

    States are made from sorted words and merged with equal ones as soon as no later word can reach them, so
    all shared suffixes are stored once.
    """
    words = sorted(entries)
    register: dict[tuple, int] = {}
    final: list[bool] = []
    arcs: list[tuple[tuple[int, int], ...]] = []

    def settle(node: list) -> int:
        key = (node[0], tuple(node[1]))
        if (state := register.get(key)) is None:
            state = register[key] = len(final)
            final.append(node[0])
            arcs.append(key[1])
        return state

    path: list[list] = [[False, []]]
    last = b""
    for word in words:
        k = len(os.path.commonprefix((last, word)))
        for depth in range(len(last), k, -1):
            path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
        path.extend([False, []] for _ in range(len(word) - k))
        path[-1][0] = True
        last = word
    for depth in range(len(last), 0, -1):
        path[depth - 1][1].append((last[depth - 1], settle(path.pop())))
    root = settle(path[0])

    below = [0] * len(final)
    for s in range(len(final)):  # children are always settled before their parents
        below[s] = final[s] + sum(below[t] for _, t in arcs[s])
    keys, targets, skips = [], [], []
    for s in range(len(final)):
        passed = int(final[s])
        for label, t in arcs[s]:
            keys.append(s << 8 | label)
            targets.append(t)
            skips.append(passed)
            passed += below[t]
    ids = [entries[w] for w in words]
    offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids], dtype=np.int64))).astype("<u4")
    blocks = [
        np.array(keys, "<u8").tobytes(),
        np.array(targets, "<u4").tobytes(),
        np.array(skips, "<u4").tobytes(),
        offsets.tobytes(),
        np.fromiter(chain.from_iterable(ids), "<u4").tobytes(),
        bytes(final),
    ]
    head = MAGIC + struct.pack("<7I", root, *map(len, blocks))
    return head + b"".join(blocks)


class Lexicon:
    """A compiled lexicon, memory-mapped: processes on one machine share its pages."""

    def __init__(self, path: str) -> None:
        with open(path, "rb") as f:
            self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        if self.map[:4] != MAGIC:
            raise ValueError(f"{path} is no lexicon")
        self.root, *sizes = struct.unpack_from("<7I", self.map, 4)
        at, views = 4 + 28, []
        for size, kind in zip(sizes, ("<u8", "<u4", "<u4", "<u4", "<u4", "u1"), strict=True):
            views.append(np.frombuffer(self.map, kind, size // np.dtype(kind).itemsize, at))
            at += size
        self.keys, self.target, self.skip, self.offset, self.ids, self.final = views

    def find(self, word: bytes) -> list[int] | None:
        return self.find_all([word])[0]

    def find_all(self, words: list[bytes]) -> list[list[int] | None]:
        """Ids of each word, None for those the lexicon does not hold: all walk the automaton together, a byte a step."""
        found: list[list[int] | None] = [None] * len(words)
        if not len(self.keys):
            return found
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        raw, starts = np.frombuffer(b"".join(words), np.uint8), np.cumsum(lengths) - lengths
        alive, state, number = np.flatnonzero(lengths), np.full(len(words), self.root, np.uint64), np.zeros(len(words), np.int64)
        step = 0
        while len(alive):
            key = state[alive] << np.uint64(8) | raw[starts[alive] + step].astype(np.uint64)
            arc = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            on = self.keys[arc] == key
            alive, arc = alive[on], arc[on]
            number[alive] += self.skip[arc]
            state[alive] = self.target[arc]
            step += 1
            ended = lengths[alive] == step
            for k in alive[ended & (self.final[state[alive].astype(np.int64)] == 1)].tolist():
                found[k] = self.ids[self.offset[number[k]] : self.offset[number[k] + 1]].tolist()
            alive = alive[~ended]
        return found


_SPLIT = regex.compile(PATTERN).findall
#: The pattern for ASCII alone, where \p{L}, \p{N} and \s are short lists: the same pieces, found faster.
_SPLIT_ASCII = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^ \t\n\r\f\vA-Za-z0-9]+|[ \t\n\r\f\v]+(?![^ \t\n\r\f\v])|[ \t\n\r\f\v]+").findall


def pre_tokens(text: str) -> list[str]:
    return _SPLIT_ASCII(text) if text.isascii() else _SPLIT(text)


def stretches(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """(stretches of all texts, where each text's begin), cut before blanks between two characters that are none.

    A pre-token always begins at such a blank, so stretches can be split each by itself. A place is left uncut where
    the bytes beside it may be those of a blank outside ASCII, which changes no pre-token.
    """
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    data = texts.buffers()[2]
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if last > first else np.empty(0, np.uint8)
    at = np.flatnonzero(raw[3:-2] == 32) + 3
    p, q, r, n, m = raw[at - 1], raw[at - 2], raw[at - 3], raw[at + 1], raw[at + 2]
    blank = _BLANK[p] | _BLANK[n] | (q == 0xC2) & ((p == 0x85) | (p == 0xA0)) | (n == 0xC2) & ((m == 0x85) | (m == 0xA0))
    blank |= (r == 0xE2) & (q <= 0x81) & (q >= 0x80) | (r == 0xE3) & (q == 0x80) | (r == 0xE1) & (q == 0x9A)
    blank |= (n == 0xE2) & (m <= 0x81) | (n == 0xE3) & (m == 0x80) | (n == 0xE1) & (m == 0x9A)
    begins = np.zeros(last - first + 1, bool)
    begins[at[~blank]] = True
    begins[offsets - first] = True
    cuts = np.flatnonzero(begins)
    out = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer((cuts + first).astype(np.int32)), data if data is not None else pa.py_buffer(b""))
    return out, np.searchsorted(cuts, offsets - first)


#: ASCII characters that one of the two patterns may take for blanks.
_BLANK = np.isin(np.arange(256), [*range(9, 14), *range(28, 33)])


def parts(batches: Iterable[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, pa.StringArray]]:
    """(rows, their texts) of the batches, at most PART_BYTES of text at once where texts are shorter than that."""
    for batch in batches:
        step = max(1, int(batch.num_rows * PART_BYTES / max(PART_BYTES, batch.column(column).nbytes)))
        for k in range(0, batch.num_rows, step):
            part = batch.slice(k, step)
            yield part, part.column(column).cast(pa.string())


class _Worker:
    """What a worker process keeps from task to task: the mapped lexicon, the ranks once needed, ids of stretches and words met."""

    name = ""
    lexicon: Lexicon
    ranks: dict[bytes, int]
    known: dict[str, list[int]]
    words: dict[str, list[int]]

    @classmethod
    def of(cls, name: str) -> type[_Worker]:
        if cls.name != name:
            cls.name, cls.lexicon, cls.ranks, cls.known, cls.words = name, Lexicon(SparkFiles.get(name)), {}, {}, {}
        return cls

    @classmethod
    def learn(cls, new: list[str], ranks_path: str) -> None:
        """Adds the ids of stretches not met before."""
        split = list(map(pre_tokens, new))
        unmet = [w for w in set(chain.from_iterable(split)) if w not in cls.words]
        raw = [w.encode() for w in unmet]
        for word, bytes_, ids in zip(unmet, raw, cls.lexicon.find_all(raw), strict=True):
            if ids is None:
                cls.ranks = cls.ranks or read_ranks(ranks_path)
                ids = merge(bytes_, cls.ranks)
            cls.words[word] = ids
        get = cls.words.__getitem__
        for stretch, ws in zip(new, split, strict=True):
            cls.known[stretch] = get(ws[0]) if len(ws) == 1 else list(chain.from_iterable(map(get, ws)))


def count_words(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n) of each task: stretches are counted first, each different one is split into pre-tokens once."""
    counts: Counter[str] = Counter()

    def out() -> pa.RecordBatch:
        words: Counter[str] = Counter()
        for stretch, n in counts.items():
            for word in pre_tokens(stretch):
                words[word] += n
        counts.clear()
        return pa.RecordBatch.from_pydict({"word": pa.array(list(words), pa.string()), "n": pa.array(list(words.values()), pa.int64())})

    for _, texts in parts(batches, 0):
        found = stretches(texts)[0].dictionary_encode()
        for stretch, n in zip(found.dictionary.to_pylist(), np.bincount(found.indices, minlength=len(found.dictionary)).tolist(), strict=True):
            counts[stretch] += n
        if len(counts) > FLUSH:
            yield out()
    if counts:
        yield out()


def encoder(name: str, ranks_path: str, ids_column: str):
    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept = _Worker.of(name)
        for part, texts in parts(batches, 1):
            found, begins = stretches(texts)
            found = found.dictionary_encode()
            different = found.dictionary.to_pylist()
            if len(kept.known) + len(kept.words) > KEPT:
                kept.known.clear()
                kept.words.clear()
            kept.learn([s for s in different if s not in kept.known], ranks_path)
            of = list(map(kept.known.__getitem__, different))
            lengths = np.fromiter(map(len, of), np.int64, len(of))
            ids = np.fromiter(chain.from_iterable(of), np.int32, int(lengths.sum()))
            starts = np.cumsum(lengths) - lengths
            index = found.indices.to_numpy()
            sizes = lengths[index]
            ends = np.cumsum(sizes)
            values = ids[np.repeat(starts[index] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
            offsets = np.concatenate(([0], ends))[begins].astype(np.int32)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32()))], names=["doc_id", ids_column])

    return encode


def frequent_words(texts: DataFrame, limit: int) -> list[str]:
    """At most `limit` pre-tokens of texts(text): those whose counts lie in the highest classes that hold no more in all."""
    counted = saved(texts.mapInArrow(count_words, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).filter("n > 1"), "p8-words")
    size = F.floor(F.log2("n") * CLASSES).cast("int")
    cut, held = 1 << 30, 0
    for row in counted.groupBy(size.alias("size")).count().orderBy(F.desc("size")).collect():  # at most 64 * CLASSES rows
        held += row["count"]
        if held > limit:
            break
        cut = row["size"]
    return [r.word for r in counted.filter(size >= cut).select("word").collect()]


def token_ids(docs: DataFrame, *, id_column: str = "doc_id", text_column: str = "text", ranks_path: str = f"{TOKENIZER_DIR}/{VOCABULARY}", lexicon_words: int = LEXICON_WORDS) -> DataFrame:
    """(doc_id, ids) of every row. A null and an empty text give an empty list; a null id stays null; repeated
    rows stay repeated; an empty table gives an empty table; other columns are ignored. Strings that spell a
    special token are ordinary text. `ranks_path` must exist on every machine."""
    spark = docs.sparkSession
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).alias("text"))
    frequent = frequent_words(texts.select("text"), lexicon_words)
    ranks = read_ranks(ranks_path)
    name = publish(spark, compile_lexicon({w.encode(): merge(w.encode(), ranks) for w in frequent}), ".lexicon")
    return texts.mapInArrow(encoder(name, ranks_path, "ids"), "doc_id long, ids array<int>")


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(load(spark, sf_dir, "documents"))
