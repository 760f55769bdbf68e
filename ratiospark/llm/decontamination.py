"""Benchmark decontamination by spaced seeds."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from .common import table

#: Seeds: at the zeros any word may stand. Two substitutions in 13 words, or three in 15, leave one of them untouched.
SEEDS = ("11111", "111101", "110111", "111011")
#: Words of a reported overlap (an item shorter than that must be covered whole), and its least share of equal words.
LEAST_WORDS = 13
LEAST_SIMILARITY = 0.8
#: Hits, and cells of diagonals, that are held at once.
HITS = 1 << 20
CELLS = 1 << 20
#: Words of an item beyond which its diagonals are scored one by one.
LONG_ITEM = 512
#: Words of benchmark items searched for in one pass over the documents.
BLOCK_WORDS = 500_000

_WORD = re.compile(r"\w+")
_SHIFT_BITS = 42
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5, 0x85EBCA77C2B2AE63, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)


def tokens(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


def _seeded(ids: np.ndarray, seed: str) -> tuple[np.ndarray, np.ndarray]:
    """Hash of every window under the seed, and whether all its words are known (id not 0)."""
    n = len(ids) - len(seed) + 1
    if n <= 0:
        return np.array([], np.uint64), np.array([], bool)
    h, known = np.zeros(n, np.uint64), np.ones(n, bool)
    for k, c in enumerate(seed):
        if c == "1":
            part = ids[k : k + n]
            h += part * _MIX[k]
            known &= part != 0
    return h, known


def segments(n: int) -> list[tuple[int, int]]:
    """Place and length of parts of an item of n words, one more than it may have words replaced, so that one part is left whole."""
    parts = n - -(-round(100 * LEAST_SIMILARITY) * n // 100) + 1
    cuts = [n * k // parts for k in range(parts + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


@dataclass
class _Seed:
    """The items' windows under one mask, by their hash and that of the window before: items and positions. pairs: sorted hashes of both
    together, with where their windows begin and end."""

    mask: str
    hashes: np.ndarray
    item: np.ndarray
    at: np.ndarray
    pairs: np.ndarray
    begin: np.ndarray
    end: np.ndarray

    @classmethod
    def of(cls, mask: str, hashes: np.ndarray, before: np.ndarray, item: np.ndarray, at: np.ndarray) -> _Seed:
        order = np.lexsort((before, hashes))
        hashes, before = hashes[order], before[order]
        begin = np.flatnonzero(np.concatenate([[True], (hashes[1:] != hashes[:-1]) | (before[1:] != before[:-1])]))
        end, pairs = np.append(begin[1:], len(hashes)), _both(hashes[begin], before[begin])
        by = np.argsort(pairs)
        return cls(mask, hashes, item[order], at[order], pairs[by], begin[by], end[by])

    def lines(self, ids: np.ndarray) -> Iterator[np.ndarray]:
        """Diagonals (see _line) with a hit, in portions of about HITS hits. A hit whose neighbour before is a hit too lies on a diagonal that is
        known, so repeated words don't multiply."""
        h, known = _seeded(ids, self.mask)
        where = np.flatnonzero(known)
        if not len(where) or not len(self.hashes):
            return
        left = np.searchsorted(self.hashes, h[where], "left")
        hit = self.hashes[np.minimum(left, len(self.hashes) - 1)] == h[where]
        where, left = where[hit], left[hit]
        if not len(where):
            return
        right = np.searchsorted(self.hashes, h[where], "right")
        before = np.where((where > 0) & known[where - 1], h[where - 1], 0)
        pair = _both(h[where], before)
        k = np.minimum(np.searchsorted(self.pairs, pair), len(self.pairs) - 1)
        same = (self.pairs[k] == pair) & (before != 0)
        first, last = np.where(same, self.begin[k], right), np.where(same, self.end[k], right)
        start, times, where = np.concatenate([left, last]), np.concatenate([first - left, right - last]), np.concatenate([where, where])
        total = np.cumsum(times)
        cuts = np.searchsorted(total, np.arange(HITS, total[-1] + HITS, HITS), "left") + 1
        for a, b in zip([0, *cuts[:-1].tolist()], cuts.tolist(), strict=True):
            n = times[a:b]
            entry = np.repeat(start[a:b] - np.cumsum(n) + n, n) + np.arange(n.sum())
            yield np.unique(_line(self.item[entry], np.repeat(where[a:b], n) - self.at[entry]))


def _both(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = a * _MIX[0] + b
    return (x ^ (x >> np.uint64(31))) * _MIX[1]


def _line(item: np.ndarray, shift: np.ndarray) -> np.ndarray:
    """An item and by how much its words stand earlier than the text's, as one number."""
    return (item.astype(np.int64) << _SHIFT_BITS) + shift + (1 << (_SHIFT_BITS - 1))


@dataclass
class SeedIndex:
    """Benchmark items as word ids, and for each seed their windows. Items of under LEAST_WORDS words, which must be covered whole, are
    looked up by parts of which one is left whole (see segments)."""

    vocabulary: dict[str, int]
    names: list
    items: list[np.ndarray]
    seeds: list[_Seed]

    @classmethod
    def of(cls, rows: list[tuple]) -> SeedIndex:
        words = [tokens(text) for _, text in rows]
        vocabulary = {w: xxhash.xxh64_intdigest(w) or 1 for ws in words for w in ws}
        items = [np.array([vocabulary[w] for w in ws], np.uint64) for ws in words]
        entries: dict[str, list[tuple]] = {}  # seed -> (hashes, those before, item, places)
        for k, x in enumerate(items):
            for seed, places in [(s, None) for s in SEEDS] if len(x) >= LEAST_WORDS else [("1" * n, [at]) for at, n in segments(len(x))]:
                h = _seeded(x, seed)[0]
                before = np.concatenate([np.zeros(min(1, len(h)), np.uint64), h[:-1]]) if places is None else np.zeros(len(places), np.uint64)
                places = np.arange(len(h)) if places is None else np.array(places)
                entries.setdefault(seed, []).append((h[places], before, np.full(len(places), k), places))
        seeds = [_Seed.of(seed, *[np.concatenate(c) for c in zip(*entries[seed], strict=True)]) for seed in sorted(entries)]
        return cls(vocabulary, [name for name, _ in rows], items, seeds)

    def overlaps(self, text: str | None) -> list[tuple]:
        """(item, start in the text's words, start in the item, words, equal words): the longest overlap for each item, of these the first."""
        ids = np.fromiter(map(lambda w, get=self.vocabulary.get: get(w, 0), tokens(text)), np.uint64)
        if not ids.any():
            return []
        lines = np.array([], np.int64)
        for seed in self.seeds:
            for found in seed.lines(ids):
                lines = np.union1d(lines, found)
        item, shift = lines >> _SHIFT_BITS, (lines & ((1 << _SHIFT_BITS) - 1)) - (1 << (_SHIFT_BITS - 1))
        cuts = np.flatnonzero(np.diff(item)) + 1
        best = []
        for k, shifts in zip(item[np.concatenate([[0], cuts])].tolist() if len(item) else [], np.split(shift, cuts), strict=False):
            if found := best_overlap(self.items[k], ids, shifts):
                best.append((self.names[k], *found))
        return best


def best_overlap(x: np.ndarray, ids: np.ndarray, shifts: np.ndarray) -> tuple[int, int, int, int] | None:
    """Of item x against text ids on the diagonals shifts: (start in the text, start in the item, words, equal words) of the longest range of
    LEAST_WORDS (or all of x) with LEAST_SIMILARITY equal, of equally long ones the first in the text, then in the item."""
    m = len(x)
    least, best = min(m, LEAST_WORDS), None
    percent = round(100 * LEAST_SIMILARITY)
    rows = max(1, CELLS // (m + 1))
    for k in range(0, len(shifts), rows):
        part = shifts[k : k + rows]
        at = part[:, None] + np.arange(m)
        inside = (at >= 0) & (at < len(ids))
        equal = (ids[np.clip(at, 0, len(ids) - 1)] == x) & inside
        # no more words than this have the similarity
        bound = np.minimum(equal.sum(axis=1) * 100 // percent, m)
        some = np.flatnonzero(bound >= (best[2] if best else least))
        if not len(some):
            continue
        if m > LONG_ITEM:
            found = []
            for r in some.tolist():
                a, b = max(0, -int(part[r])), min(m, len(ids) - int(part[r]))
                i, j = longest(equal[r, a:b])
                if j - i >= least:
                    found.append((-(j - i), a + i + int(part[r]), a + i, r))
            if found:
                size, start, place, r = min(found)
                if best is None or (-size, -start) > (best[2], -best[0]):
                    best = (start, place, -size, int(equal[r, place : place - size].sum()))
            continue
        score = np.where(equal, 100 - percent, np.where(inside, -percent, -100 * (m + 1)))
        sums = np.concatenate([np.zeros((len(some), 1), np.int64), np.cumsum(score[some], axis=1)], axis=1)
        for size in range(int(bound[some].max()), (best[2] if best else least) - 1, -1):
            r, i = np.nonzero(sums[:, size:] >= sums[:, : m + 1 - size])
            if len(r):
                start = part[some[r]] + i
                first = np.lexsort((i, start))[0]
                if best is None or (size, -int(start[first])) > (best[2], -best[0]):
                    place = int(i[first])
                    best = (int(start[first]), place, size, int(equal[some[r[first]], place : place + size].sum()))
                break
    return best


def longest(equal: np.ndarray) -> tuple[int, int]:
    """The longest range, the first of these, of which LEAST_SIMILARITY is equal."""
    percent = round(100 * LEAST_SIMILARITY)
    sums = np.concatenate([[0], np.cumsum(np.where(equal, 100 - percent, -percent))])
    highest = np.maximum.accumulate(sums[::-1])[::-1]
    starts = np.flatnonzero(np.concatenate([[True], sums[1:] < np.minimum.accumulate(sums)[:-1]]))  # others are never better
    # the last end that is as high as the start
    ends = np.searchsorted(-highest, -sums[starts], "right") - 1
    k = int(np.argmax(ends - starts))
    return int(starts[k]), int(ends[k])


def _indexes(benchmark: DataFrame, item_col: str, text_col: str, block_words: int):
    """The items in blocks of about block_words words."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(text_col).alias("t")).filter(F.col("t").isNotNull())
    size = items.agg(F.sum(F.length("t"))).first()[0] or 0
    blocks = max(1, -(-size // (6 * block_words)))
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(blocks)) == b).collect() if blocks > 1 else items.collect()
        yield benchmark.sparkSession.sparkContext.broadcast(SeedIndex.of(sorted(((r["i"], r["t"]) for r in rows), key=lambda r: (r[0] is None, r))))


def contaminated(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of docs and item that it overlaps: doc_id, item_id, doc_start, item_start, words, equal_words, similarity.

    Words are runs of \\w in lower case. Windows under fixed masks that ignore some of their words are hashed; the documents'
    hashes are looked up in the items' (a stated set, taken in blocks of block_words words, so that each broadcast is
    bounded), and every hit is extended along its diagonal. An overlap counts from LEAST_WORDS words, or the whole item
    if that is shorter, with LEAST_SIMILARITY of them equal. Whole texts are searched.

    Items of under LEAST_WORDS words are looked up by parts of one to six words, of which one must be left whole; so an item of one to
    four words counts wherever it stands verbatim. Null and empty texts overlap nothing; null ids stay null; repeated rows are each
    reported; equal items each; items without words and null ones overlap nothing. Empty tables give no rows."""
    out = None
    for index in _indexes(benchmark, item_col, item_text_col, block_words):

        def search(batches: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = [(i, *o) for i, t in zip(pdf["doc_id"], pdf["t"], strict=True) for o in index.value.overlaps(t)]
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "doc_start", "item_start", "words", "equal_words"]).assign(doc_id=lambda d: d["doc_id"].astype("Int64"), item_id=lambda d: d["item_id"].astype("Int64"))

        part = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("t")).mapInPandas(search, "doc_id long, item_id long, doc_start long, item_start long, words long, equal_words long")
        out = part if out is None else out.unionByName(part)
    return out.withColumn("similarity", F.col("equal_words") / F.col("words"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs without the rows that overlap an item (see contaminated), columns unchanged. Null and empty texts stay; repeated rows and
    equal texts stay or go together, whatever their ids; empty tables of documents or items drop nothing."""
    for index in _indexes(benchmark, item_col, item_text_col, block_words):
        docs = docs.filter(_clean(index)(F.col(text_col)))
    return docs


def _clean(index):
    @pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not index.value.overlaps(t) for t in texts], dtype=bool)

    return clean


def op5(spark, sf_dir):
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
