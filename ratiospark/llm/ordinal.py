"""Ordinal regression with cumulative links: one weight vector over hashed text features, ordered thresholds between grades."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

from .words import Lanes, U, bounds, mix, portions

BUCKETS = 1 << 20
PREFIXES = (4, 5, 6)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: ASCII symbols.
_SYMBOLS = np.zeros(256, bool)
_SYMBOLS[[*range(33, 48), *range(58, 65), *range(91, 97), *range(123, 127)]] = True


def _bucket(h: np.ndarray, kind: int) -> np.ndarray:
    """Buckets of hashes; each kind of feature mixes them in its own way."""
    return (mix(h + U((kind + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF), 0xA0761D6478BD642F) >> U(44)).astype(np.int64)


def text_features(texts: pa.Array, weights: np.ndarray | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """First row, number of rows, and distinct (row, bucket) in their order, for portions of the texts; buckets of weight zero are left out.

    Of each word: its core (lower-case A-Z, without outer symbols), the core's first 4, 5 and 6 bytes, the last symbols behind it, and
    whether it has a capital first and no small letter. Of each text: the share of each kind of word (symbols alone, two or more symbols
    behind, capitals, plain) and of words distinct in core and symbols behind in tenths, and the length in powers of two."""
    used = None if weights is None else weights != 0
    for data, begins, first in portions(texts):
        rows = len(begins)
        starts, ends = bounds(data, begins)
        n = np.diff(np.append(np.searchsorted(starts, begins), len(starts)))
        row = np.repeat(np.arange(rows), n)
        lanes = Lanes(_LOWER[data])
        core, stop, symbols = starts.copy(), ends.copy(), np.zeros(len(starts), bool)
        outer = np.flatnonzero(_SYMBOLS[data[starts]] | _SYMBOLS[data[ends - 1]])
        if len(outer):
            inner = np.append(np.flatnonzero(~_SYMBOLS[data]), len(data))
            core[outer], stop[outer] = inner[np.searchsorted(inner, starts[outer])], inner[np.searchsorted(inner, ends[outer]) - 1] + 1
            symbols[outer] = core[outer] >= ends[outer]
            bare = np.flatnonzero(symbols)
            core[bare] = stop[bare] = starts[bare]
        tail = ends - stop
        upper = np.zeros(len(starts), bool)
        first_up = np.flatnonzero((data[np.minimum(core, len(data) - 1)] - np.uint8(65) <= 25) & (stop - core > 1))
        if len(first_up):
            small = np.append(data - np.uint8(97) <= 25, False)
            upper[first_up] = ~np.logical_or.reduceat(small, np.stack([core[first_up], stop[first_up]], axis=1).ravel())[::2]
        found_row, found = [], []

        def add(where, buckets, found_row=found_row, found=found, row=row):
            if weights is not None:
                use = used[buckets]
                where, buckets = where[use], buckets[use]
            found_row.append(row[where])
            found.append(buckets)

        whole = lanes.hashes(core, stop)
        word = np.flatnonzero(~symbols)
        add(word, _bucket(whole[word], 0))
        size = stop - core
        for kind, k in enumerate(PREFIXES, 1):
            word = np.flatnonzero(size >= k)
            add(word, _bucket(lanes.head(core[word], k), kind))
        word = np.flatnonzero(tail > 0)
        last = np.minimum(tail[word], 3)
        add(word, _bucket(lanes.head(ends[word] - last, last), 4))
        word = np.flatnonzero(upper)
        add(word, np.full(len(word), _bucket(np.zeros(1, U), 5)[0]))

        kinds = np.where(symbols, 0, np.where(tail > 1, 1, np.where(upper, 2, 3)))
        full = np.sort((row.astype(U) << U(40)) | (mix(whole + tail.astype(U) + symbols.astype(U), 3) >> U(24)))
        fresh = full[np.concatenate([[True], full[1:] != full[:-1]])] if len(full) else full
        distinct = np.bincount((fresh >> U(40)).astype(np.int64), minlength=rows)
        length = np.ceil(np.log2(n + 1)).astype(np.int64)
        tenths = lambda c: -(-10 * c // np.maximum(n, 1))  # noqa: E731,B023
        shape = [(20 + k, tenths(np.bincount(row[kinds == k], minlength=rows))) for k in range(4)] + [(30, tenths(distinct)), (31, length), (32, 64 * tenths(distinct) + length)]
        for kind, value in shape:
            here = np.flatnonzero(value > 0) if kind < 30 else np.arange(rows)
            buckets = _bucket(value[here].astype(U), kind)
            use = slice(None) if used is None else used[buckets]
            found_row.append(here[use])
            found.append(buckets[use])
        pairs = np.unique((np.concatenate(found_row) << 20) | np.concatenate(found))
        yield first, rows, pairs >> 20, pairs & (BUCKETS - 1)


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade >= k) = sigmoid(score - thresholds[k - 1]); weights of the buckets that count."""

    buckets: np.ndarray
    values: np.ndarray
    thresholds: tuple[float, ...]

    def table(self) -> np.ndarray:
        weights = np.zeros(BUCKETS)
        weights[self.buckets] = self.values
        return weights

    def scores(self, texts: pa.Array, table: np.ndarray | None = None) -> np.ndarray:
        table, out = self.table() if table is None else table, np.zeros(len(texts))
        for first, rows, row, bucket in text_features(texts, table):
            out[first : first + rows] = np.bincount(row, weights=table[bucket], minlength=rows)
        return out

    def tails(self, scores: np.ndarray) -> np.ndarray:
        z = np.asarray(scores, float)[:, None] - np.array(self.thresholds)[None, :]
        return 1 / (1 + np.exp(-np.clip(z, -700, 700)))

    def column(self, text: Column) -> Column:
        """STRUCT<score, expected, grade, tails>: expected grade, the median one (the highest k with P(grade >= k) of a half or more),
        and P(grade >= k) for k from 1."""

        @arrow_udf("struct<score: double, expected: double, grade: int, tails: array<double>>")
        def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            table = self.table()
            for texts in batches:
                scores = self.scores(texts, table)
                tails = self.tails(scores)
                each = pa.ListArray.from_arrays(pa.array(np.arange(len(scores) + 1) * tails.shape[1], pa.int32()), pa.array(tails.ravel()))
                yield pa.StructArray.from_arrays([pa.array(scores), pa.array(tails.sum(axis=1)), pa.array((tails >= 0.5).sum(axis=1), pa.int32()), each], ["score", "expected", "grade", "tails"])

        return scored(text)


#: Rounds of steps over the weights in use, and how often those are chosen anew; the gradient's excess over l1, as a share of it, at which a fit has ended.
ROUNDS, CHOICES, CLOSE = 120, 8, 0.1


def fit(features: list[np.ndarray], grades: np.ndarray, row_weights: np.ndarray, n_grades: int, l1: float = 3e-4, least_rows: int = 3, close: float = CLOSE, choices: int = CHOICES) -> OrdinalModel:
    """Weights under an L1 penalty by accelerated proximal gradient steps, the same on every run.

    features: distinct buckets of each row. A step is 1 / h for a weight, where h bounds the curvature: the share of
    the rows that have the feature, times their number of features and the most that their grade's loss bends. Steps go over the weights
    that aren't zero or whose gradient exceeds the penalty most; those are chosen anew until no gradient exceeds it by more than `close`
    of the penalty. A grade without rows keeps a threshold far up."""
    n = len(grades)
    nothing = np.array([], np.int64)
    if not n:
        return OrdinalModel(nothing, np.array([]), tuple(700.0 for _ in range(n_grades - 1)))
    if (top := int(grades.max())) < n_grades - 1:  # grades above the highest seen stay out of reach
        seen = fit(features, grades, row_weights, max(top + 1, 2), l1, least_rows, close, choices) if top else OrdinalModel(nothing, np.array([]), ())
        return OrdinalModel(seen.buckets, seen.values, (*seen.thresholds, *(700.0 for _ in range(n_grades - 1 - len(seen.thresholds)))))
    flat, rows = np.concatenate([nothing, *features]).astype(np.int64), np.repeat(np.arange(n), [len(f) for f in features])
    times = np.bincount(flat, minlength=BUCKETS)
    use = times[flat] >= least_rows
    names = np.flatnonzero(times >= least_rows)
    order = np.argsort(flat[use], kind="stable")  # by feature, so that a choice of features is a choice of ranges
    column, rows, count = np.searchsorted(names, flat[use][order]), rows[use][order].astype(np.int32), times[names]
    ends = np.cumsum(count)
    share = row_weights / row_weights.sum()
    above = np.clip([(share * (grades >= k)).sum() for k in range(1, n_grades)], 1e-6, 1 - 1e-6)
    edges = np.maximum.accumulate(-np.log(above / (1 - above)) + 1e-3 * np.arange(n_grades - 1))
    if not len(names):
        return OrdinalModel(nothing, np.array([]), tuple(float(x) for x in edges))
    bend = np.where((grades == 0) | (grades == n_grades - 1), 0.25, 0.5)
    w, f = np.zeros(len(names)), np.zeros(n)
    for _ in range(choices):
        for _ in range(4):
            edges = _edges(edges, f, grades, share)
        a, b = _below(edges, f, grades)
        grad = np.add.reduceat((share * (1 - a - b))[rows], ends - count)
        excess = np.where(w != 0, np.abs(grad + l1 * np.sign(w)), np.abs(grad) - l1)
        if excess.max() <= close * l1:
            break
        chosen = np.flatnonzero((w != 0) | (excess > 0.2 * excess.max()))
        size = count[chosen]
        at = np.repeat(ends[chosen] - np.cumsum(size), size) + np.arange(size.sum())
        r, c = rows[at], np.repeat(np.arange(len(chosen)), size)
        begins = np.cumsum(size) - size
        # the bound of the chosen features alone
        h = np.add.reduceat((bend * share * np.bincount(r, minlength=n))[r], begins)
        own = ahead = w[chosen]
        t = 1.0
        for _ in range(ROUNDS):
            f = np.bincount(r, weights=ahead[c], minlength=n)
            edges = _edges(edges, f, grades, share)
            a, b = _below(edges, f, grades)
            grad = np.add.reduceat((share * (1 - a - b))[r], begins)
            new = ahead - grad / h
            new = np.sign(new) * np.maximum(np.abs(new) - l1 / h, 0)
            if ((ahead - new) * (new - own)).sum() > 0:  # the momentum points the wrong way: start it anew
                t = 1.0
            faster = (1 + math.sqrt(1 + 4 * t * t)) / 2
            step = np.abs((new - own) * h).max()
            ahead, own, t = new + (t - 1) / faster * (new - own), new, faster
            if step < 0.1 * close * l1:
                break
        w[chosen] = own
        f = np.bincount(r, weights=own[c], minlength=n)
    used = np.flatnonzero(w)
    return OrdinalModel(names[used], w[used], tuple(float(x) for x in edges))


def loss(model: OrdinalModel, features: list[np.ndarray], grades: np.ndarray, row_weights: np.ndarray, l1: float = 3e-4) -> float:
    """What fit makes small: the mean negative log likelihood plus l1 times the weights' sizes."""
    table, share = model.table(), row_weights / row_weights.sum()
    a, b = _below(np.array(model.thresholds), np.array([table[f].sum() for f in features]), grades)
    return float(-(share * np.log(np.maximum(a - b, 1e-300))).sum() + l1 * np.abs(model.values).sum())


def _below(edges: np.ndarray, f: np.ndarray, grades: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(grade <= y) and P(grade <= y - 1)."""
    wide = np.concatenate([[-np.inf], edges, [np.inf]])
    with np.errstate(over="ignore"):
        return 1 / (1 + np.exp(f - wide[grades + 1])), 1 / (1 + np.exp(f - wide[grades]))


def _edges(edges: np.ndarray, f: np.ndarray, grades: np.ndarray, share: np.ndarray) -> np.ndarray:
    """A bounded Newton step for each threshold, which stays between its neighbours. The loss is convex in each."""
    edges = edges.copy()
    for k in range(len(edges)):
        a, b = _below(edges, f, grades)
        p, up, down = np.maximum(a - b, 1e-12), grades == k, grades == k + 1
        da, db = a * (1 - a) / p, b * (1 - b) / p
        slope = (share * (down * db - up * da)).sum()
        curve = (share * (up * (da * da - da * (1 - 2 * a)) + down * (db * db + db * (1 - 2 * b)))).sum() + 1e-4
        low = edges[k - 1] + 1e-2 if k else -700.0
        high = edges[k + 1] - 1e-2 if k + 1 < len(edges) else 700.0
        edges[k] = min(max(edges[k] - np.clip(slope / curve, -1, 1), low), max(low, high))
    return edges


def graded(features: list[np.ndarray], label: np.ndarray, row_weights: np.ndarray, fold: np.ndarray, **how) -> np.ndarray:
    """Grades 0, 1, 2 from labels 0 and 1: label 1 is graded 2 where the evidence for it, scored by a model of the label that was fitted
    without the row's own fold, is above the median of label 1. All grades so lie on one scale, that of the label."""
    score = np.zeros(len(label))
    for half in (0, 1):
        train_, test = np.flatnonzero(fold != half), np.flatnonzero(fold == half)
        if len(train_) and len(test):
            table = fit([features[i] for i in train_], label[train_], row_weights[train_], 2, **{"close": 0.5, "choices": 5} | how).table()
            score[test] = [table[features[i]].sum() for i in test]
    one = label == 1
    return np.where(one, 1 + (score > np.median(score[one]) if one.any() else 0), 0).astype(int)


def train(docs: DataFrame, labels: DataFrame, grade: Column, n_grades: int, rows_per_grade: int = 4000, id_col: str = "doc_id", text_col: str = "text", seed: int = 7, split: bool = False, **how) -> OrdinalModel:
    """Fits on about rows_per_grade labelled rows of each grade, chosen by a hash of the id and weighted back to the grades' shares.

    split: grade is a label of 0 or 1, and 1 is divided by evidence into grades 1 and 2 (see graded). labels with null id or grade don't
    count; of several labels of an id the highest counts. Documents with null text have only the features of an empty one.
    Without a labelled row every document gets tail probabilities of 0."""
    given = labels.select(F.col(id_col).cast("long").alias("_i"), grade.cast("int").alias("_g")).dropna().groupBy("_i").agg(F.max("_g").alias("_g"))
    counts = {r["_g"]: r["count"] for r in given.groupBy("_g").count().collect()}  # a row for each grade
    share = F.lit(0.0)
    for g, c in counts.items():
        share = F.when(F.col("_g") == g, F.lit(min(1.0, rows_per_grade / c))).otherwise(share)
    draw = F.shiftrightunsigned(F.xxhash64("_i", F.lit(seed)), 11) / F.lit(float(1 << 53))
    # about n_grades * rows_per_grade rows
    sample = F.broadcast(given.withColumn("_s", share).filter(draw < F.col("_s")))
    texts = docs.select(F.col(id_col).cast("long").alias("_i"), F.col(text_col).alias("_t")).join(sample, "_i").select("_i", "_g", F.when(F.col("_s") > 0, 1 / F.col("_s")).alias("_w"), "_t")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, rows, row, bucket in text_features(batch.column("_t")):
                part = batch.slice(first, rows)
                ends = np.concatenate([[0], np.cumsum(np.bincount(row, minlength=rows))])
                yield pa.RecordBatch.from_arrays([part.column("_i"), part.column("_g"), part.column("_w"), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bucket, pa.int32()))], ["i", "g", "w", "f"])

    got = texts.mapInArrow(extract, "i long, g int, w double, f array<int>").toArrow().combine_chunks()
    sets = got.column("f").combine_chunks() if len(got) else pa.array([], pa.list_(pa.int32()))
    flat, ends = sets.flatten().to_numpy(), np.concatenate([[0], np.cumsum(np.asarray(sets.value_lengths()))]).astype(np.int64)
    ids = got.column("i").to_numpy()
    # in a fixed order, so that sums agree between runs
    order = np.lexsort(([zlib.crc32(flat[ends[i] : ends[i + 1]].tobytes()) for i in range(len(ids))], ids)) if len(ids) else np.array([], int)
    features = [flat[ends[i] : ends[i + 1]] for i in order]
    grades, row_weights = got.column("g").to_numpy()[order].astype(int), got.column("w").to_numpy()[order]
    if split:
        grades = graded(features, grades, row_weights, mix(ids[order].view(U), 5).astype(np.int64) & 1, **how)
        n_grades = 3
    return fit(features, grades, row_weights, n_grades, **how)
