"""Evaluation items inside training texts (problem 9): greedy string tiling over shared word seeds.

Texts are folded to words without case, accents and punctuation. Documents that share a seed of five words with an
item are joined with it; within such a pair the longest non-overlapping matches are marked again and again,
found by running Karp-Rabin hashes. Tiles on neighbouring diagonals make a passage; an item leaks when one dense
passage covers at least half of its words, or several that were reordered cover nearly all of them.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from velum.sources.tables import load, publish, spread

#: Words of a seed; least words of a tile; words by which neighbouring tiles may be apart; passage and cover limits.
SEED, TILE, GAP = 5, 3, 4
PASSAGE, DENSITY, COVER = 0.3, 0.75, 0.5
#: Part of an item that passages in another order must cover together.
WHOLE = 0.9
#: Share of the words needed that must start a seed the texts share, on neighbouring diagonals, to try tiling.
SEEDED = 0.2
#: Words of an item by which its cover may fall short: a replaced word at the end of a passage.
SLACK = 1
#: Seeds of all items that a task may hold at once (some 200 bytes each with their places); beyond it seeds are joined by shuffle.
SEEDS_IN_MEMORY = 1_000_000
#: Parts into which that join splits each seed, so that a stock formula's seeds stand in no one task.
SALTS = 32

_WORD = re.compile(r"[^\W_]+")
_MARKS = regex.compile(r"[\p{Mn}\p{Cf}]+")
_MOD, _BASE = (1 << 61) - 1, 1_000_003


def words(text: str | None) -> list[str]:
    """Words without case, accents, punctuation and compatibility forms; null and empty texts have none."""
    if not text:
        return []
    plain = unicodedata.normalize("NFKD", text).casefold()
    if not plain.isascii():
        plain = _MARKS.sub("", plain)
    return _WORD.findall(plain)


class _Codes(dict):
    """Codes of words met before; forgotten when they grow too many."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 500_000:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_codes = _Codes()


def word_codes(ws: list[str]) -> np.ndarray:
    """64-bit codes of words, the same in every process."""
    return np.fromiter(map(_codes.__getitem__, ws), np.uint64, len(ws))


def seeds(codes: np.ndarray, size: int = SEED) -> np.ndarray:
    """A running hash of every `size` words, modulo 2^64."""
    if len(codes) < size:
        return np.empty(0, np.uint64)
    out = np.zeros(len(codes) - size + 1, np.uint64)
    for k in range(size):
        out = out * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + len(out)]
    return out ^ (out >> np.uint64(29))


def _running(codes: list[int], size: int) -> Iterator[int]:
    """Karp-Rabin hashes of all windows of `size` words."""
    top = pow(_BASE, size - 1, _MOD)
    h = 0
    for i, c in enumerate(codes):
        if i >= size:
            h = (h - codes[i - size] * top) % _MOD
        h = (h * _BASE + c) % _MOD
        if i >= size - 1:
            yield h


def tiles(a: list[int], b: list[int], least: int = TILE) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (start in a, start in b, words) of the longest non-overlapping matches of a and b.

    Each round finds the maximal matches of unmarked words that start with an equal Karp-Rabin window, longest
    first; those that no earlier tile touches are marked. Rounds go from long windows down to `least`.
    """
    used_a, used_b = bytearray(len(a)), bytearray(len(b))
    out: list[tuple[int, int, int]] = []
    size = max(least, 20)
    while size >= least:
        at: dict[int, list[int]] = defaultdict(list)
        for i, h in enumerate(_running(a, size)):
            if not any(used_a[i : i + size]):
                at[h].append(i)
        found = []
        for j, h in enumerate(_running(b, size)):
            if h in at and not any(used_b[j : j + size]):
                for i in at[h]:
                    if a[i : i + size] != b[j : j + size] or (i and j and a[i - 1] == b[j - 1] and not used_a[i - 1] and not used_b[j - 1]):
                        continue  # hashes that clash, and matches that began further left
                    n = size
                    while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and not used_a[i + n] and not used_b[j + n]:
                        n += 1
                    found.append((n, i, j))
        found.sort(key=lambda m: (-m[0], m[1], m[2]))
        for n, i, j in found:
            if not any(used_a[i : i + n]) and not any(used_b[j : j + n]):
                used_a[i : i + n] = used_b[j : j + n] = b"\1" * n
                out.append((i, j, n))
        size = size // 2 if size > 2 * least else size - 1
    return sorted(out)


def seeded_part(item_seeds: dict[int, list[int]], doc_seeds: list[int], need: float) -> tuple[int, int] | None:
    """[first, last) words of the document between which seeds lie densely enough on neighbouring diagonals."""
    on: dict[int, list[int]] = defaultdict(list)
    for j, h in enumerate(doc_seeds):
        for i in item_seeds.get(h, ()):
            on[(j - i) // (2 * GAP)].append(j)
    kept: list[int] = []
    for d, js in on.items():
        near = js + on.get(d + 1, [])
        if len(near) >= SEEDED * need * PASSAGE / COVER:
            kept.extend(near)
    if len(set(kept)) < SEEDED * need:
        return None
    return max(0, min(kept) - 4 * SEED), max(kept) + 5 * SEED


def leaked(item: list[int], doc: list[int]) -> bool:
    """Whether a dense passage of `doc` covers at least half of `item`, or several cover WHOLE of it."""
    need = COVER * len(item) - SLACK
    marks = tiles(item, doc)
    if sum(n for _, _, n in marks) < DENSITY * need:
        return False
    chains: list[list[tuple[int, int, int]]] = []
    for i, j, n in sorted(marks, key=lambda m: m[1]):
        best = None
        for c in chains:
            pi, pj, pn = c[-1]
            gi, gj = i - pi - pn, j - pj - pn
            if 0 <= gi <= GAP and 0 <= gj <= GAP and (best is None or gj < best[0]):
                best = (gj, c)
        if best:
            best[1].append((i, j, n))
        else:
            chains.append([(i, j, n)])
    held = bytearray(len(item))
    for c in chains:
        first, last = c[0][0], c[-1][0] + c[-1][2]
        if sum(n for _, _, n in c) >= DENSITY * (last - first):
            if last - first >= need:
                return True
            if last - first >= PASSAGE * COVER * len(item):
                held[first:last] = b"\1" * (last - first)
    return sum(held) >= WHOLE * len(item)


def _item_seeds(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes, least = [], [], []
        for item, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            codes = word_codes(words(text))
            found = np.unique(seeds(codes)).view(np.int64).tolist()
            ids.extend([item] * len(found))
            hashes.extend(found)
            least.extend([max(1, int(SEEDED * (COVER * len(codes) - SLACK)))] * len(found))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64()), pa.array(least, pa.int32())], names=["item_id", "seed", "least"])


def _doc_seeds(batches: Iterable[pa.RecordBatch], known: np.ndarray | None) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, hashes = [], []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            found = np.unique(seeds(word_codes(words(text)))).view(np.int64)
            if known is not None and len(found):
                at = np.minimum(np.searchsorted(known, found), len(known) - 1)
                found = found[known[at] == found]
            ids.extend([doc] * len(found))
            hashes.extend(found.tolist())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hashes, pa.int64())], names=["doc_id", "seed"])


def _verify(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    folded: dict[str, tuple[list[int], dict[int, list[int]]]] = {}

    def fold(item: str) -> tuple[list[int], dict[int, list[int]]]:
        if item not in folded:
            codes, at = word_codes(words(item)), defaultdict(list)
            for k, h in enumerate(seeds(codes).tolist()):
                at[h].append(k)
            if len(folded) > 10_000:
                folded.clear()
            folded[item] = codes.tolist(), at
        return folded[item]

    for batch in batches:
        rows = []
        for doc, text, items in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
            array = word_codes(words(text))
            codes, hashes = array.tolist(), seeds(array).tolist()
            for x in items:
                item, at = fold(x["item"])
                part = seeded_part(at, hashes, COVER * len(item) - SLACK)
                if part and leaked(item, codes[slice(*part)]):
                    rows.append((doc, x["item_id"]))
        cols = list(zip(*rows, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id"])


class _Items:
    """Items held in memory: their words as codes, places of their seeds, and all seeds sorted with their items."""

    def __init__(self, rows: list[tuple[int, str]]) -> None:
        self.ids: list[int] = []
        self.codes: list[list[int]] = []
        self.places: list[dict[int, list[int]]] = []
        self.least: list[int] = []
        seed, owner = [], []
        for item_id, text in rows:
            codes = word_codes(words(text))
            at: dict[int, list[int]] = defaultdict(list)
            for k, h in enumerate(seeds(codes).tolist()):
                at[h].append(k)
            seed.extend(at)
            owner.extend([len(self.ids)] * len(at))
            self.ids.append(item_id)
            self.codes.append(codes.tolist())
            self.places.append(at)
            self.least.append(max(1, int(SEEDED * (COVER * len(codes) - SLACK))))
        order = np.argsort(np.array(seed, np.uint64), kind="stable")
        self.seed, self.owner = np.array(seed, np.uint64)[order], np.array(owner, np.int64)[order]

    def held_by(self, text: str) -> Iterator[int]:
        """Ids of the items that a text holds."""
        array = word_codes(words(text))
        hashes = seeds(array)
        unique = np.unique(hashes)
        left = np.searchsorted(self.seed, unique, "left")
        right = np.searchsorted(self.seed, unique, "right")
        hit = right > left
        if not hit.any():
            return
        counts = np.bincount(np.concatenate([self.owner[a:b] for a, b in zip(left[hit], right[hit], strict=True)]))
        codes, listed = array.tolist(), hashes.tolist()
        for k in np.flatnonzero(counts).tolist():
            if counts[k] >= self.least[k]:
                part = seeded_part(self.places[k], listed, COVER * len(self.codes[k]) - SLACK)
                if part and leaked(self.codes[k], codes[slice(*part)]):
                    yield self.ids[k]


_items: dict[str, _Items] = {}


def _held(batches: Iterable[pa.RecordBatch], name: str) -> Iterator[pa.RecordBatch]:
    import pickle

    from pyspark import SparkFiles

    if name not in _items:
        _items.clear()
        with open(SparkFiles.get(name), "rb") as f:
            _items[name] = _Items(pickle.load(f))  # noqa: S301 - written by leaks of this run
    items = _items[name]
    for batch in batches:
        rows = [(doc, k) for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for k in items.held_by(text)]
        cols = list(zip(*rows, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "item_id"])


def leaks(docs: DataFrame, items: DataFrame, in_memory: int = SEEDS_IN_MEMORY) -> DataFrame:
    """(doc_id, item_id): the documents that hold an item in whatever order, or a passage of at least half of its words.

    docs(doc_id, text), items(item_id, text). Null, empty and blank texts hold nothing and are held by nothing;
    items of fewer than SEED words have no seed and match nothing; repeated rows count once. A pair is tiled if it
    shares SEEDED of the seeds needed; a seed that many documents share (a stock formula) only makes more
    candidates: no bucket is capped. Items of at most `in_memory` seeds are handed to the tasks, which read each
    document once and move nothing; more are joined with the documents on their seeds.
    """
    docs = docs.select("doc_id", "text").filter("text is not null")
    items = items.select("item_id", F.col("text").alias("item")).filter("item is not null").dropDuplicates(["item_id", "item"])
    seeded = items.mapInArrow(_item_seeds, "item_id long, seed long, least int")
    if seeded.limit(in_memory + 1).count() <= in_memory:
        import pickle

        # items without a seed stay out, so the words handed on are at most five times the seeds
        wanted = items.join(seeded.select("item_id").distinct(), "item_id", "left_semi")
        name = publish(docs.sparkSession, pickle.dumps([tuple(r) for r in wanted.collect()], 5), ".items")
        return spread(docs).mapInArrow(lambda it: _held(it, name), "doc_id long, item_id long").distinct()
    marked = spread(docs).mapInArrow(lambda it: _doc_seeds(it, None), "doc_id long, seed long")
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    parted = seeded.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    pairs = marked.withColumn("salt", salt).join(parted, ["seed", "salt"]).groupBy("doc_id", "item_id").agg(F.countDistinct("seed").alias("n"), F.max("least").alias("least")).filter("n >= least")
    of_doc = pairs.join(items, "item_id").groupBy("doc_id").agg(F.collect_list(F.struct("item_id", "item")).alias("items"))
    return docs.join(of_doc, "doc_id").select("doc_id", "text", "items").mapInArrow(_verify, "doc_id long, item_id long").distinct()


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(load(spark, sf_dir, "documents"), load(spark, sf_dir, "benchmark"))
